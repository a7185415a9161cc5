"""Operators on small cases, against plain loops."""

import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenspan import cli
from evenspan.functions import pitch, timegrid
from evenspan.operators import batches, bpe, carrier, codelen, events, governance, ledger, lineage, relations, validate
from evenspan.sources import midi, readers, sinks

FACTS = "song_id long, event_type string, onset long, duration long, pitch int"


def facts(spark, rows):
    return spark.createDataFrame([(1, "NOTE", o, d, p) for o, d, p in rows], FACTS)


def test_time_round_trip_and_errors(spark):
    rows = spark.range(0, 2000, 7).select(timegrid.musical_time(F.col("id")).alias("m"), "id")
    assert rows.where(timegrid.onset_of(F.col("m.bar"), F.col("m.tick")) != F.col("id")).count() == 0
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(timegrid.musical_time(F.lit(-1).cast("bigint"))).collect()


def test_buckets_are_signed(spark):
    r = spark.createDataFrame([(d,) for d in (-97, -96, -1, 0, 1, 96, 97)], "d bigint")
    got = r.select(timegrid.unit_distance(F.col("d"), 96), timegrid.floor_distance(F.col("d"), 96), timegrid.signed_log_bucket(F.col("d"))).collect()
    assert [x[0] for x in got] == [-1, -1, 0, 0, 0, 1, 1]
    assert [x[1] for x in got] == [-2, -1, -1, 0, 0, 1, 1]
    assert [x[2] for x in got] == [-7, -7, -1, 0, 1, 7, 7]


def test_canonical_shift_is_the_only_one(spark):
    got = spark.range(12).select("id", pitch.canonical_shift(F.col("id")).alias("s")).collect()
    assert all((r["id"] + r["s"]) % 12 == 0 and -5 <= r["s"] <= 6 for r in got)


def test_rests(spark):
    f = facts(spark, [(10, 5, 60), (12, 50, 61), (100, 1, 62)])
    rests = events.insert_rests(f).where("event_type = 'REST'").orderBy("onset").select("onset", "duration").collect()
    assert [tuple(r) for r in rests] == [(0, 10), (62, 38)]
    assert events.insert_rests(f, 96, leading=False).count() == 3


def test_windows_cover_and_guard(spark):
    f = facts(spark, [(384 * b, 10, 60) for b in range(20)])
    assert events.windows(f, 8, 4).groupBy("start_bar").count().where("count > 8").count() == 0
    with pytest.raises(Exception, match="too many"):
        events.windows(f, most=3).collect()


def test_carrier_round_trips_and_rejects(spark):
    f = events.insert_rests(facts(spark, [(10, 5, 60), (384 * 3 + 2, 900, 61), (384 * 3 + 2, 900, 60)]))
    back = carrier.deserialize(carrier.serialize(f)).select(*f.columns)
    assert f.exceptAll(back).isEmpty() and back.exceptAll(f).isEmpty()
    broken = spark.createDataFrame([(1, ["POSITION_1", "REST"])], "song_id long, tokens array<string>")
    with pytest.raises(Exception, match="malformed"):
        carrier.deserialize(broken).collect()


def plain_fit(sequences, merges):
    rules = []
    for _ in range(merges):
        counts = {}
        for s in sequences:
            for a, b in zip(s, s[1:]):
                counts[a, b] = counts.get((a, b), 0) + 1
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        rules.append((a, b, n))
        sequences = [plain_merge(s, a, b) for s in sequences]
    return rules


def plain_merge(s, a, b):
    out = []
    for x in s:
        if out and out[-1] == a and x == b:
            out[-1] = f"{a} {b}"
        else:
            out.append(x)
    return out


def test_merges_equal_a_plain_loop(spark):
    sequences = ["aababaab", "abcabcab", "aaaaa", ""]
    rows = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sequences)], "song_id long, symbols array<string>")
    rules = bpe.fit(rows, 4)
    assert rules == plain_fit([list(s) for s in sequences], 4)
    back = rows.select(bpe.decoded(bpe.encoded(F.col("symbols"), [r[:2] for r in rules])).alias("b"), "symbols")
    assert back.where("b <> symbols and size(symbols) > 0").isEmpty()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), max_size=14))
def test_components_equal_union_find(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(i, f"x{a}", f"y{b}") for i, (a, b) in enumerate(pairs)] or [(0, "x", "y")]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b in rows:
        for j, c, d in rows:
            if a == c or b == d:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = dict(lineage.components(spark.createDataFrame(rows, "song_id long, x string, y string"), ["x", "y"]).collect())
    assert got == {i: find(i) for i in range(len(rows))}


def test_splits_are_greedy(spark):
    rows = [(f"c{i}", 1 + i * 7 % 5, float(i % 11)) for i in range(60)]
    c = spark.createDataFrame(rows, "id string, n long, density double")
    order = {r["id"]: r["place"] for r in batches.balanced_order(c, 3, "test").collect()}
    left, want = 40, set()
    for i, n, _ in sorted(rows, key=lambda r: order[r[0]]):
        if n <= left:
            want.add(i)
            left -= n
    got = {r["id"] for r in lineage.take_if_fits(c, 40, 3, "test").collect()}
    assert left == 0 and got == want
    split = lineage.assign_splits(c, 40, 30, 3)
    assert split.count() == 60 and split.groupBy("id").count().where("count > 1").isEmpty()


def test_ledger_is_micro(spark):
    e = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 5.0)], "arm string, facts int, time double")
    for c in ledger.CHANNELS[1:]:
        e = e.withColumn(c, F.lit(0.0))
    assert ledger.ledger(e, ["arm"]).first()["bits_per_fact"] == 1.5


def test_scorer_prefers_what_it_saw(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("ababab")], "song_id long, ord long, symbol string")
    new = spark.createDataFrame([(2, 0, "a"), (2, 1, "b"), (2, 2, "z")], "song_id long, ord long, symbol string")
    got = {r["symbol"]: r["bits"] for r in codelen.Scorer(rows).score(new, F.lit(9.0)).collect()}
    assert got["b"] < got["a"] < got["z"] and got["z"] > 9


def test_firewall():
    f = governance.Firewall()
    with pytest.raises(governance.SealedError):
        f.training(None, "test")
    with pytest.raises(governance.SealedError):
        f.read_test_once(None)
    assert f.denied == 2


def test_midi_faults():
    data = midi.render([(0, 60, 96), (10, 61, 4), (96, 60, 1)])
    assert [n[2:] for n in midi.parse(data, strict=True)["notes"]] == [(0, 60, 96), (10, 61, 4), (96, 60, 1)]
    for broken in (b"", b"MThd", data[:-6], b"RIFF" + data):
        with pytest.raises((midi.MidiError, IndexError)):
            midi.parse(broken)
    off = data[:22] + bytes([0, 0x80, 60, 0]) + data[22:]
    off = off[:18] + (len(data) - 22 + 4).to_bytes(4, "big") + off[22:]
    assert midi.parse(off)["notes"]
    with pytest.raises(midi.MidiError):
        midi.parse(off, strict=True)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, "train"), (2, "b", 2.5, "test")], "id long, name string, x double, split string")
    receipt = sinks.write_manifest(df, str(tmp_path / "m"), "id")
    assert [(r["split"], r["samples"]) for r in receipt] == [("test", 1), ("train", 1)]
    assert readers.read_split(spark, str(tmp_path / "m"), "train").count() == 1
    with pytest.raises(Exception, match="exist"):
        sinks.write_parquet(df, str(tmp_path / "m"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "x"])
    assert sorted(r["x"] or "" for r in readers.read_csv(spark, str(tmp_path / "c"), "id long, x string").collect()) == ["", "2.5"]
    inv = readers.file_inventory(spark, str(tmp_path / "j"))
    assert readers.tree_digest(inv).first()["files"] == inv.count()
    sinks.write_json({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().startswith('{\n  "a"')


def test_selection_and_commands(spark):
    h = spark.createDataFrame([(5, 1.0, 1), (3, 1.0, 1), (1, 2.0, 1)], "exposure long, bits double, k int")
    assert validate.best_checkpoint(h, ["k"]).first()["exposure"] == 3
    assert cli.smoke(spark)["status"] == "PASS"
    found = spark.createDataFrame([("a", 0), ("b", 1)], "field string, crossing long")
    assert cli.audit(found, ["a"])["status"] == "PASS" and cli.audit(found, ["a", "c"])["status"] == "FAIL" and cli.audit(found, ["b"])["status"] == "FAIL"


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "evenspan"), tmp_path / "evenspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_halves_balance_rows_and_events(spark):
    rows = [(f"c{i}", 1 + i % 3, 10 + (i * i) % 50) for i in range(40)]
    got = dict(lineage.balanced_halves(spark.createDataFrame(rows, "id string, n long, events long"), 3).collect())
    n = {s: sum(r[1] for r in rows if got[r[0]] == s) for s in ("validation", "test")}
    e = {s: sum(r[2] for r in rows if got[r[0]] == s) for s in ("validation", "test")}
    assert abs(n["validation"] - n["test"]) <= 3 and abs(e["validation"] - e["test"]) <= 4
    assert lineage.balanced_halves(spark.createDataFrame([], "id string, n long, events long"), 3).count() == 0


def test_tokenizer_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", ["a", "a"]]}}')
    vocabulary, merges = readers.tokenizer_tables(spark, str(tmp_path / "t.json"))
    assert dict(vocabulary.collect()) == {"a": 0, "b": 1, "ab": 2}
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == [(0, "a", "b"), (1, "a", "a")]


def test_merges_by_plain_rules_however_many(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]) for i in range(40)] + [(99, None), (100, ["a"] * 31)]
    known, rules = ["a", "b", "c", "d"], []
    while len(rules) < 1000:
        rules.append((rng.choice(known[:60]), rng.choice(known[:60])))
        known.append(" ".join(rules[-1]))

    def plain(symbols, rules):
        for left, right in rules:
            out = []
            for x in symbols:
                if out and out[-1] == left and x == right and not (left == right and out[-1] is marked):
                    out[-1] = marked = f"{left} {right}"
                else:
                    out.append(x)
                    marked = None
            symbols = out
        return symbols

    df = spark.createDataFrame(rows, "song_id long, symbols array<string>")
    many = {r[0]: r[1] for r in bpe.encode(df, rules).collect()}
    assert many == {i: s and plain(s, rules) for i, s in rows} | {i: s for i, s in rows if not s}
    few = rules[:24] + [("a", "a"), ("a a", "a a")]
    folded = {r[0]: r[1] for r in df.select("song_id", bpe.encoded(F.col("symbols"), few)).collect()}
    assert folded == {i: s and plain(s, few) for i, s in rows} | {i: s for i, s in rows if not s}
    back = bpe.encode(df, rules).select("song_id", bpe.decoded(F.col("symbols")).alias("symbols"))
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_merges_are_fitted_on_train_only(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "train"), (2, ["a", "b"], "test")], "song_id long, symbols array<string>, split string")
    with pytest.raises(ValueError, match="train only"):
        bpe.fit(df, 1)
    with pytest.raises(ValueError, match="train only"):
        bpe.fit(df.drop("split"), 1, split="test")
    assert bpe.fit(df.where("split = 'train'"), 1) == [] and len(bpe.fit(df.drop("split"), 1)) == 1


def test_redaction_walks_json(spark):
    cases = {
        r'{"user":"a\"secret","k":1}': (r'{"user":"<REDACTED_INFRASTRUCTURE_IDENTITY>","k":1}', ["/user"]),
        '{"user":["x",["y"],{"z":"w","host":"h"}]}': ('{"user":["<REDACTED_INFRASTRUCTURE_IDENTITY>",["<REDACTED_INFRASTRUCTURE_IDENTITY>"],{"z":"w","host":"<REDACTED_INFRASTRUCTURE_IDENTITY>"}]}', ["/user/0", "/user/1/0", "/user/2/host"]),
        '["/HOME/x", "/homely/x", "d:/y", "a@b", "http://a@b", 7, null]': ('["<REDACTED_ABSOLUTE_PATH>","/homely/x","<REDACTED_ABSOLUTE_PATH>","<REDACTED_CONTACT_OR_LOGIN>","http://a@b",7,null]', ["/0", "/2", "/3"]),
        '"a@b"': ('"<REDACTED_CONTACT_OR_LOGIN>"', [""]), "no json": (None, None), "{}": ("{}", []),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: (r["g"]["clean"], r["g"]["changed"]) for r in df.select("t", governance.redacted(F.col("t")).alias("g")).collect()}
    assert got == cases | {None: (None, None)}


def test_donors_are_far_and_differ(spark):
    bars = [0, 8, 16, 24, 40, 48]
    rows = [(1, b, b != 16) for b in bars] + [(2, 0, True), (2, 8, True), (3, 0, True), (3, 4, True), (4, 0, True), (4, 8, False)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in relations.donor_triples(spark.createDataFrame(rows, "song_id long, start_bar long, melody boolean")).collect()}
    assert set(got) == {(1, b) for b in bars if b != 16} | {(2, 0), (2, 8)}
    for (song, bar), (melody, context) in got.items():
        assert abs(bar - melody) >= 8 and abs(bar - context) >= 8 and melody != 16
        assert melody != context or song == 2


def test_rows_have_donors_where_no_rotation_serves(spark):
    def rows(songs):
        return spark.createDataFrame(list(enumerate(songs)), "i long, song_id long")

    mixed = rows([5, 5, 5, 7, 8])
    assert relations.rotation_for(mixed) is None
    assert sorted((r["i"], r["donor"]) for r in relations.first_donors(mixed).collect()) == [(0, 3), (1, 3), (2, 3), (3, 0), (4, 0)]
    assert relations.first_donors(rows([5, 5])) is None and relations.first_donors(rows([5]).where("false")) is None


def test_counts_that_changed_are_errors(spark):
    f = facts(spark, [(0, 5, 60), (0, 9, 64), (500, 5, 61)])
    assert events.target_counts(f).collect() == [(1, 5)]  # three notes, a rest and the end
    assert validate.unchanged_counts(events.target_counts(f), events.target_counts(f)).count() == 1
    other = spark.createDataFrame([(1, 4)], "song_id long, target_event_count long")
    for given, counted in ((other, events.target_counts(f)), (events.target_counts(f), other.where("false"))):
        with pytest.raises(Exception, match="count changed for 1"):
            validate.unchanged_counts(given, counted).collect()


def test_translated_windows_stay_inside(spark):
    w = events.windows(facts(spark, [(0, 5, 60), (384 * 250, 5, 60)]))
    assert sorted(r[0] for r in events.translated(w, 7).select("start_bar").collect()) == [7, 255]
    for bars in (-1, 8):
        with pytest.raises(Exception, match="leaves the bars"):
            events.translated(w, bars).collect()


def test_source_song_ids_and_versions(spark, tmp_path):
    path = spark.createDataFrame([("src_001/12.mid",), ("src_b/7",)], "p string")
    assert [r[0] for r in path.select(readers.source_song_id(F.col("p"), "c")).collect()] == ["c:src_001:12", "c:src_b:7"]
    for bad in ("12.mid", "src_1/x.mid", "a/src_1/2.mid", "other/2.mid", None):
        with pytest.raises(Exception, match="unexpected path"):
            spark.createDataFrame([(bad,)], "p string").select(readers.source_song_id(F.col("p"), "c")).collect()
    (tmp_path / "c.json").write_text('{"schema_version": "v2", "k": [1]}')
    assert readers.load_config(str(tmp_path / "c.json"), "v2")["k"] == [1]
    with pytest.raises(ValueError, match="schema version"):
        readers.load_config(str(tmp_path / "c.json"), "v1")
