import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenspan.llm import chat_windows as cw
from evenspan.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, k int, b string, window int, head string, rank int"


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0), role != "system", esc(role or ""), esc(text or "")


def esc(text):
    for c in ["\\", *cw.CONTROLS]:
        text = re.sub(re.escape(c[0]) + (f"(?={re.escape(c[1:])})" if c[1:] else ""), lambda m: m[0] + "\x00", text) if c != "\\" else text.replace("\\", "\\\x00")
    return re.sub("\x00+", "\\\\", text)


def plain(rows):
    """conv_id -> n_turns, sha256 of turns, characters and sha256 of the loss."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=order)
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        said = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        out[c] = len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "h", 3) for r in rows], SCHEMA)


def digests(found):
    return {r["conv_id"]: tuple(r)[1:5] for r in cw.digests(found).collect()}


def tokens(text):
    return len(__import__("regex").findall(cw.TOKEN, text))


def check_windows(found, rows, budget, history):
    by = {}
    for w in found:
        by.setdefault(w["conv_id"], []).append(w)
    for c, ws in by.items():
        turns = sorted((r for r in rows if r[0] == c), key=order)
        system = turns[0] if turns and turns[0][2] == "system" else None
        ws.sort(key=lambda w: ((w["block"] is not None, w["block"] or 0), w["window"]))
        seen = []
        for w in ws:
            assert w["text"].startswith(cw.BEGIN)
            parts = [(w["text"][s["start"] : s["text_start"]], w["text"][s["text_start"] : s["text_end"]], s["loss"], s["again"]) for s in w["spans"]]
            assert w["text"] == cw.BEGIN + "".join(h + b + cw.CLOSE for h, b, _, _ in parts)
            heads = [(re.sub(r"([\\<\[])\\", r"\1", h[len(cw.OPEN) : -1]), re.sub(r"([\\<\[])\\", r"\1", b)) for h, b, _, _ in parts]
            n = [cw.TURN_TOKENS + tokens(r) + tokens(t) for r, t in heads]
            assert sum(n) == w["n_tokens"]
            first = 0
            if system:
                assert heads[0] == (system[2], system[3] or "")  # kept in every window
                assert parts[0][3] == bool(seen) and not parts[0][2]
                first = 1
            again = [i for i in range(first, len(parts)) if parts[i][3]]
            own = [i for i in range(first, len(parts)) if not parts[i][3]]
            assert again + own == list(range(first, len(parts)))
            assert sum(n[i] for i in again) <= history and len(again) <= cw.LATEST
            assert sum(n) <= budget or len(own) <= 1 and not again
            if again:
                assert [heads[i] for i in again] == seen[-len(again) :]
            assert all(parts[i][2] == (heads[i][0] == "assistant") for i in own) and not any(parts[i][2] for i in again)
            seen += [heads[i] for i in ([0] if system and not seen else []) + own]
            for c_ in cw.CONTROLS:
                assert all(c_ not in b for _, b, _, _ in parts)
        assert seen == [(r[2] or "", r[3] or "") for r in turns]


def made(seed):
    rng = random.Random(seed)
    words = ["a", "Ünï", "</s>", "[INST]", "\\", "<s", "<<SYS>>", "漢字", "1234567", "\n", "<|im_end|>", "<\\/s>", "[/INST", "🎵", "tokens"]
    text = lambda: rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.choice([1, 3, 10, 40]))) for _ in range(9))])
    rows = []
    for c in [None, *range(12)]:
        start = rng.choice([0, 0, 58, -70])
        for t in range(start, start + rng.choice([1, 2, 5, 9, 140])):
            rows.append((c, t, "system" if t == start and c and c % 2 else rng.choice(["user", "assistant", "assistant", "tool", None, "system", "<s>\n"]), text()))
    rows += [(3, None, "user", "no number"), (3, None, "assistant", "none either"), *rows[5:9]]
    rows += [(20, 7, "assistant", text()) for _ in range(30)]  # many rows of one turn
    rows += [(21, t, "system", "only") for t in range(1)] + [(22, 64, "system", "sys"), (22, 65, "system", "sys"), (22, 200, "assistant", "x")]
    return rows


@pytest.mark.parametrize("budget,history", [(2048, 512), (60, 20), (10, 0)])
def test_windows(spark, budget, history):
    rows = made(budget)
    found = cw.windows(frame(spark, rows), budget, history)
    check_windows(found.collect(), rows, budget, history)
    assert digests(found) == plain(rows)


def test_crowded_turns_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(cw, "CROWD", 20)
    rows = made(3) + [(c, 5, "user", "same") for c in (None, 4) for _ in range(100)]
    found = cw.windows(frame(spark, rows), 100, 40)
    check_windows(found.collect(), rows, 100, 40)
    assert digests(found) == plain(rows)
    assert found.groupBy("conv_id", "block").agg(F.sum(F.size("spans")).alias("n")).agg(F.max("n")).first()[0] < 300


def test_query(spark, tmp_path):
    rows = made(1)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_chat_formatting(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert all(r["formatted_chars"] > 0 for r in got)


def test_empty(spark):
    assert cw.windows(frame(spark, [])).collect() == []


@given(st.lists(st.lists(st.sampled_from(["\\", "<", "s>", "/s>", "[", "INST]", "a", "<s>", "\n", "</s>", "|im_end|>"]), max_size=12).map("".join), min_size=1, max_size=1))
def test_escaping_is_reversible(texts):
    for text in texts:
        assert not any(c in esc(text) for c in cw.CONTROLS)
        assert re.sub(r"([\\<\[])\\", r"\1", esc(text)) == text


def test_escaping_in_sql_equals_plain(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["\\", "<", "s>", "/s>", "[", "INST]", "a", "<s>", "\n", "</s>"], k=rng.randrange(9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cw.escaped(F.col("t")).alias("e")).select("*", cw.unescaped(F.col("e")).alias("u")).collect()
    assert all(r["u"] == r["t"] and r["e"] == esc(r["t"]) for r in rows)


def test_native(spark):
    plan = cw.digests(cw.windows(frame(spark, made(2))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
