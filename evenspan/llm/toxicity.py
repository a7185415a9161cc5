"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel.  What was written is a noisy form of what was meant: letters appear as look-alike digits and signs, are
repeated, or are set apart by spaces and marks.  A token with such traces spans a lattice of the letters it may stand
for; Viterbi decoding finds the most likely path under a character language model (four-letter sequences over a-z,
any other character, and the word's end, counted in all texts) and the costs of the channel.  Tokens without such
traces have one path, themselves, and so have addresses and long hexadecimal keys.  A run of pieces of one or two signs
is one lattice in which each space is an arc that either ends a word or is silent.  Time and memory are in proportion to
a token's length, so none is too long.

Score.  A logistic regression on whether a text holds a word or a word's first letters, for features that labelled
texts prove: their counts in toxic and other texts differ by more than chance.  It is fitted on at most ``SAMPLE``
labelled rows (all of them where there are fewer, else those with the smallest hash of their id), and keeps all
features that they prove, which that bound bounds; scoring reads all rows and whole texts.

Defined cases: a null or empty text has the score of a text without features.  Labels that are null, or of rows that
aren't there, teach nothing; a row with several labels counts with each.  Without labels of both kinds all scores
are the share of toxic ones (0 for none).  Only named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, once_a_worker, small_or_shuffled, stored, taken
from .langid import held_out

SAMPLE = 40_000
#: Toxic texts of the sample that a feature has at least, and the chance that one passes by luck.
SUPPORT, LUCK = 4, 1e-6
STEMS = (4, 5)
HELD = 200_000
#: Longest token or run whose restored form a worker remembers.
REMEMBERED = 64

#: The letters that look-alikes stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Marks that set letters apart.
APART = set(".-_*~'’`^,:;/\\")
#: Log costs of a look-alike, of a mark between letters, of a repeated letter taken once, of a letter left as it is, and
#: of a look-alike that stands for itself.
ALIKE, MARK, REPEAT, KEEP, ITSELF = -1.0, -1.0, -0.5, -0.05, -3.0

LETTERS = 28  # a-z, 26: any other character, 27: the word's end
OTHER, END = 26, 27

RUNS = re.compile(r"(.)\1*", re.S)
#: Pieces of one or two signs, one after the other.
SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2})+(?!\S)")
EDGE = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$|(?:([%#&*$!@|+.,?~=_-])\1{2,})+$|[!?.,]+$")
#: A look-alike, a mark, or the same letter three times.
TRACES = re.compile(r"[0-9@$!|+(€£.\-_*~'’`^,:;/\\]|([a-z])\1\1")
TRIPLE = re.compile(r"([a-z])\1\1")
#: Addresses and keys, which aren't decoded: URLs, e-mail addresses, long hexadecimal numbers and UUIDs.
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://.*|www\..*|[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}|(?=[a-f]*[0-9])(?:0x)?[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.S)


def folded(text: str) -> np.ndarray:
    """Codes of a lower-cased text: letters, ends for white space, other characters."""
    return once_a_worker("toxicity", ("folding",), _folding)[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def _folding() -> np.ndarray:
    table = np.full(256, OTHER, np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[[32, *range(9, 14)]] = END
    return table


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LETTERS**4, np.int64)
    for batch in batches:
        texts = [t.lower() for t in batch.column(0).to_pylist() if t]
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < 1 << 20):
                part.append(texts[at])
                size += len(part[-1])
                at += 1
            c = folded(" " + " ".join(part) + " ")
            if len(c) > 3:
                code = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
                counts += np.bincount(code, minlength=LETTERS**4)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], ["code", "n"])


class LetterModel:
    """Log probability of a letter after three others, backed off by mixing with shorter histories."""

    def __init__(self, codes: list[int], counts: list[int]) -> None:
        n4 = np.zeros(LETTERS**4)
        n4[codes] = counts
        n4 = n4.reshape((LETTERS,) * 4)
        p = np.full(LETTERS, 1 / LETTERS)
        for table in (n4.sum((0, 1, 2)), n4.sum((0, 1)), n4.sum(0), n4):
            kinds = (table > 0).sum(-1, keepdims=True) + 1  # as much weight for shorter histories as kinds of letters followed
            p = (table + kinds * p) / (table.sum(-1, keepdims=True) + kinds)
        self.log = np.log(p)

    def decode(self, token: str) -> str:
        """The best path through the lattice of a lower-cased token, or of a run of pieces with single spaces between."""
        best: dict = {(END, END, END): (0.0, None)}
        for k, (char, times, inside, before) in enumerate(self.arcs(token)):
            if before and k:
                best = self._step(best, [("", 0.0), (" ", 0.0)])
            best = self._step(best, self._ways(char, times, inside))
        _, out = max(((score + self.log[h][END], out) for h, (score, out) in best.items()), key=lambda x: x[0])
        parts = []
        while out is not None:
            out, letters = out
            parts.append(letters)
        return "".join(reversed(parts))

    @staticmethod
    def arcs(token: str) -> list[tuple[str, int, bool, bool]]:
        """(character, how often it is repeated, whether spaces stand between, whether one stands before)."""
        out, at = [], [len(piece) for piece in token.split(" ")]
        starts = set(np.cumsum([0, *at[:-1]]).tolist())
        for run in RUNS.finditer(token.replace(" ", "")):
            spaces = [i in starts for i in range(*run.span())]
            out.append((run[1], len(spaces), any(spaces[1:]), spaces[0]))
        return out

    @staticmethod
    def _ways(char: str, times: int, spaced: bool = False) -> list[tuple[str, float]]:
        """(letters, cost) that a run of a character may stand for."""
        if "a" <= char <= "z":
            ways = [(char * min(times, 3), KEEP * times)]
            if times > 2:
                ways = [(char, REPEAT), (char * 2, 2 * REPEAT)]
            if spaced and times > 1:
                ways.append((f"{char} {char}", KEEP * times if times == 2 else 2 * REPEAT))
            return ways
        alike = LOOKALIKES.get(char, "")
        ways = [(x * min(times, 2), ALIKE * times) for x in alike]
        if times > 1:
            ways += [(x, ALIKE + REPEAT) for x in alike]
        if char in APART or char == "!":
            ways.append(("", MARK))
        if char.isdigit() and ways:
            ways.append((char * times, ITSELF * times))
        return ways or [(char, KEEP)]

    def _step(self, best: dict, ways: list[tuple[str, float]]) -> dict:
        """Scores and paths (the path before, letters) by the last three letters."""
        new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for history, (score, out) in best.items():
            for letters, cost in ways:
                h, s = history, score + cost
                for x in letters:
                    code = ord(x) - 97 if "a" <= x <= "z" else END if x == " " else OTHER
                    s += self.log[h][code]
                    h = (h[1], h[2], code)
                if h not in new or s > new[h][0]:
                    new[h] = (s, (out, letters) if letters else out)
        return new


class Restorer:
    def __init__(self, codes: list[int], counts: list[int]) -> None:
        self.model, self.known = LetterModel(codes, counts), {}

    def _restored(self, shown: str, spaced: bool) -> str:
        if spaced:
            return self.model.decode(shown)
        for _ in range(2):
            shown = EDGE.sub("", shown)
        if TRACES.search(shown) and not ADDRESS.fullmatch(shown):
            return self.model.decode(shown)
        return shown

    def token(self, token: str, spaced: bool = False) -> str:
        got = self.known.get((token, spaced))
        if got is None:
            got = self._restored(token, spaced)
            if len(token) <= REMEMBERED:
                if len(self.known) > HELD:
                    self.known.clear()
                self.known[token, spaced] = got
        return got

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        low = (text or "").lower()
        shown = set(low.split())
        words = {w for w in shown if w.isalpha() and not TRIPLE.search(w)}  # stand for themselves
        words.update(map(self.token, shown - words))
        for run in SPACED.findall(low):  # letters set apart by spaces
            words.update(self.token(" ".join(run.split()), True).split())
        return words


def features_of(words: set[str]) -> set[str]:
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "~" for w in words if len(w) > n])
    return out


def _count_features(name: str, shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = once_a_worker("toxicity", ("restorer", name), lambda: Restorer(*taken(shared)))
        counts = (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            both = list(counts[0] | counts[1])
            made = [pa.array(both, pa.string()), *(pa.array([c[f] for f in both], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(made, ["feature", "n0", "n1"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(features_of(restore.words(text)))
            if sum(map(len, counts)) > HELD:
                yield handed()
        yield handed()

    return of


def _found(name: str, shared, features: dict[str, int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = once_a_worker("toxicity", ("restorer", name), lambda: Restorer(*taken(shared)))
        for batch in batches:
            rows = [sorted(features[f] for f in features_of(restore.words(t)) if f in features) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    return of


def fit(rows: list[tuple[int, list[int]]], n: int, penalty: float = 0.1, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on presence, by Newton steps with conjugate gradients; rows with the same features are one."""
    seen = Counter((y, tuple(x)) for y, x in rows)
    weight = np.array(list(seen.values()), float)
    y = np.array([k[0] for k in seen], float)
    doc = np.repeat(np.arange(len(seen)), [len(k[1]) + 1 for k in seen])
    col = np.array([f for k in seen for f in (*k[1], n)], np.int64)  # the constant is feature n
    ridge = np.full(n + 1, penalty)
    ridge[n] = 1e-6

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, w[col], len(y))

    def back(x: np.ndarray) -> np.ndarray:
        return np.bincount(col, x[doc], n + 1)

    def loss(w: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, scores(w)) - y * scores(w))).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(n + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(scores(w), -30, 30)))
        gradient = back(weight * (p - y)) + ridge * w
        if np.abs(gradient).max() < 1e-4:
            break
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        scale = back(curve) + ridge
        step, residual = np.zeros(n + 1), -gradient
        z = residual / scale
        along, size = z.copy(), residual @ z
        for _ in range(100):
            product = back(curve * scores(along)) + ridge * along
            rate = size / max(along @ product, 1e-300)
            step += rate * along
            residual = residual - rate * product
            z = residual / scale
            size, before = residual @ z, size
            if size < 1e-10:
                break
            along = z + size / before * along
        rate, at = 1.0, loss(w)
        while rate > 1e-4 and loss(w + rate * step) > at:
            rate /= 2
        w = w + rate * step
    return w[:n], float(w[n])


def _scored(name: str, shared, weights: dict[str, float], constant: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = once_a_worker("toxicity", ("restorer", name), lambda: Restorer(*taken(shared)))
        known = once_a_worker("toxicity", ("weights", name), dict)

        def weight(word: str) -> tuple[str, ...]:
            return tuple(f for f in features_of({word}) if f in weights)

        for batch in batches:
            scores = []
            for text in batch.column(2).to_pylist():
                held: set[str] = set()
                for word in restore.words(text):
                    got = known.get(word)
                    if got is None:
                        if len(known) > HELD:
                            known.clear()
                        got = known[word] = weight(word)
                    if got:
                        held.update(got)
                total = constant + sum(weights[f] for f in sorted(held))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return of


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for all ``docs``; learned from ``labels`` (doc_id, toxic) of rows that aren't held out."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    letters = stored(docs.select("text").transform(in_batches, _count_letters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")), "letters").collect()
    shared = spark.sparkContext.broadcast(([r[0] for r in letters], [r[1] for r in letters]))  # at most LETTERS**4 rows
    name = uuid.uuid4().hex

    out_of = held_out("doc_id", 5, 0)
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~out_of & F.col("doc_id").isNotNull())
    there = learn.count()
    if there > sample:
        learn = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(sample / there * (1 << 40)))
    rows = stored(docs.join(small_or_shuffled(learn, min(there, 2 * sample), 16), "doc_id").select("text", "toxic"), "labelled")

    counts = rows.transform(in_batches, _count_features(name, shared), "feature string, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kinds = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    total0, total1 = kinds.get(0, 0), kinds.get(1, 0)
    if total0 and total1:
        a, b = F.col("n1") / total1, F.col("n0") / total0
        pooled = (F.col("n0") + F.col("n1")) / (total0 + total1)
        z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / total0 + 1 / total1) + 1e-12)
        limit = (2 * math.log(1 / LUCK)) ** 0.5  # above the normal quantile of that chance
        picked = counts.where((F.col("n1") >= SUPPORT) & (z > limit)).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature")
        features = {r[0]: i for i, r in enumerate(picked.collect())}
        found = rows.transform(in_batches, _found(name, shared, features), "toxic int, found array<int>").collect()  # a bounded sample
        w, constant = fit([(r[0], r[1]) for r in found], len(features))
        weights = {f: float(w[i]) for f, i in features.items()}
    else:
        weights, constant = {}, 30.0 if total1 else -30.0
    scores = docs.select("doc_id", out_of.alias("held_out"), "text").transform(in_batches, _scored(name, shared, weights, constant), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
