"""Language identification, word first.

A known word scores its log frequency in each language; an unseen word backs off to its characters: at each place
the longest known n-gram (four characters down to one, with the word's ends marked) gives its log frequency.  A word
or n-gram is known if any language has it; languages that lack it take one floor, a quarter of a single occurrence in
the largest language.  Log frequencies count from that floor, so a language that lacks something scores 0 for it, and
a floor or a cost that all languages share needs no place in the sums.  A text's scores are the sums over its words,
and its score the share of the best language among their exponentials (for texts of many words it is close to 1).

Word counts cover all training rows, and every word and n-gram that was seen is in the model, which grows with the
corpus.  The ``FREQUENT`` most frequent words are held by the workers, which sum them; what a text has besides
is joined, as distinct words by text, with the table of all words, and the unseen ones with the table of n-grams, so
how many words the workers hold changes nothing in the result.  Equal texts are one text in that join.

Defined cases: rows with a null language or text teach nothing.  A null text, or one without a letter, is ``und``
with score 0, and so is every text where nothing was learned.  Ties go to the first language in order.  Words are
runs of letters and their marks (categories L and M) that begin with a letter, in lower case; whole texts are read.
Repeated rows get equal results, null ids are kept.  Empty tables give empty results.  Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_join, in_batches, once_a_worker, stored, taken, without

ORDERS = (4, 3, 2, 1)
#: Words that the workers hold, at most; all others are joined.
FREQUENT = 200_000
#: Bins of word counts for each doubling.
BINS = 8
#: Distinct words or n-grams that a task counts before it hands them on.
HELD = 150_000
UNDETERMINED = "und"
#: The letters of a language's text, ASCII in lower case or any.
ASCII, ANY = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return ASCII.findall(low) if low.isascii() else ANY.findall(low)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def _counted(counts: dict[str, Counter], name: str) -> pa.RecordBatch:
    """The counts by language as rows; they begin anew."""
    langs, texts, numbers = [], [], []
    for lang, c in counts.items():
        langs += [lang] * len(c)
        texts += c
        numbers += c.values()
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(numbers, pa.int64())], ["lang", name, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield _counted(counts, "word")
    yield _counted(counts, "word")


def marked(word: str) -> str:
    return "<" * (ORDERS[0] - 1) + word + ">"


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams that end at each character of a word and at its end mark."""
    text = marked(word)
    return [text[end - order : end] for end in range(ORDERS[0], len(text) + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the highest order; the others are their ends."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            c = counts.setdefault(lang, Counter())
            for g in grams_of(word, ORDERS[0]):
                c[g] = c.get(g, 0) + n
        if sum(map(len, counts.values())) > HELD:
            yield _counted(counts, "gram")
    yield _counted(counts, "gram")


class Model:
    """Tables in the shared folder: ``words`` (word, n, gains) and ``grams`` (gram, o, gains); gains has a value for each of ``langs``."""

    def __init__(self, docs: DataFrame) -> None:
        """Learned from the columns ``lang`` and ``text``."""
        words = docs.where("lang is not null and text is not null").select("lang", "text").transform(in_batches, _count_words, "lang string, word string, n long")
        words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
        grams = words.transform(in_batches, _count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        ends = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.substring("gram", -o, o).alias("gram")) for o in ORDERS))).alias("x")
        grams = stored(grams.select("lang", ends, "n").groupBy("lang", "x.o", "x.gram").agg(F.sum("n").alias("n")), "gram-counts")
        totals: dict[int, dict[str, int]] = {o: {} for o in (0, *ORDERS)}
        for lang, total in words.groupBy("lang").agg(F.sum("n")).collect():  # a row for each language
            totals[0][lang] = total
        for lang, o, total in grams.groupBy("lang", "o").agg(F.sum("n")).collect():
            totals[o][lang] = total
        self.langs = sorted(totals[0])
        self.words = stored(self._gains(words, ["word"], {0: totals[0]}), "words")
        self.grams = stored(self._gains(grams, ["gram", "o"], {o: totals[o] for o in ORDERS}), "grams")

    def _gains(self, counts: DataFrame, keys: list[str], totals: dict[int, dict[str, int]]) -> DataFrame:
        """The log frequencies above the floor of the key's order."""
        scale = {(o, lang): 4 * max(by.values()) / by[lang] for o, by in totals.items() for lang in by}
        order = F.col("o") if "o" in keys else F.lit(0)

        def gain(lang: str) -> Column:
            mine = F.sum(F.when(F.col("lang") == lang, F.col("n")))
            by = F.coalesce(*(F.when(order == o, F.lit(scale[o, lang])) for o in totals if (o, lang) in scale), F.lit(1.0))
            return F.coalesce(F.log(mine * by), F.lit(0.0))

        gains = F.array(*map(gain, self.langs)) if self.langs else F.array().cast("array<double>")
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), gains.alias("gains"))

    def frequent(self, many: int) -> bytes:
        """word, gains of the most frequent words, ``many`` at most, as an Arrow stream; where counts are alike, none of them."""
        at = F.floor(F.log2("n") * BINS).cast("int")
        least, left = None, many
        for k, rows in sorted(self.words.groupBy(at.alias("k")).count().collect(), reverse=True):  # a row for each bin
            left -= rows
            if left < 0:
                break
            least = k
        found = self.words.where(F.lit(False) if least is None else at >= least).select("word", "gains").toArrow()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, found.schema) as stream:
            stream.write_table(found)
        return out.getvalue().to_pybytes()


class Held:
    """The frequent words, and sums of their gains."""

    def __init__(self, stream: bytes, langs: int) -> None:
        table = pa.ipc.open_stream(stream).read_all()
        self.at = {w: i for i, w in enumerate(table.column(0).to_pylist())}
        gains = table.column(1).combine_chunks()
        self.gains = np.array(gains.flatten() if len(gains) else [], np.float64).reshape(len(self.at), langs)

    def of(self, words: list[str]) -> tuple[np.ndarray, Counter]:
        """The sum of the held words, and the others with their numbers."""
        found = list(map(self.at.get, words))
        return self.gains[[k for k in found if k is not None]].sum(0), Counter([w for w, k in zip(words, found) if k is None])


def _scan(name: str, shared, langs: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = once_a_worker("langid", ("words", name), lambda: Held(taken(shared), langs))
        for batch in batches:
            *before, texts = batch.columns
            letters, sums, words, times, ends = [], [], [], [], [0]
            for text in texts.to_pylist():
                found = words_of(text)
                total, rest = held.of(found)
                letters.append(bool(found))
                sums.append(total.tolist())
                words += rest
                times += rest.values()
                ends.append(len(words))
            others = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["w", "c"])
            made = [pa.array(letters, pa.bool_()), pa.array(sums, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)]
            yield pa.RecordBatch.from_arrays([*before, *made], [*batch.schema.names[:-1], "letters", "sums", "others"])

    return of


def _added(gains: str, langs: int, times: str = "1") -> list[Column]:
    return [F.sum(F.col(gains)[k] * F.expr(times)).alias(f"v{k}") for k in range(langs)]


def _joined(rest: DataFrame, model: Model) -> DataFrame:
    """id and the sums v0, v1, ... of the words in ``rest`` (id, w, c)."""
    n = len(model.langs)
    values = [f"v{k}" for k in range(n)]
    found = stored(rest.groupBy("w").agg(F.count("*").alias("m")), "other-words")
    found = found.join(model.words.select(F.col("word").alias("w"), "gains"), "w", "left")
    found = stored(found, "other-gains")
    known = found.where("gains is not null").select("w", "m", *(F.col("gains")[k].alias(f"v{k}") for k in range(n)))

    # the longest known n-gram at a place depends on the last characters only, which many words share
    text = F.concat(F.lit("<" * (ORDERS[0] - 1)), F.col("w"), F.lit(">"))
    at = F.sequence(F.lit(1), F.length("w") + 1)
    places = found.where("gains is null").select("w", "m", F.explode(F.transform(at, lambda i: F.substring(text, i, F.lit(ORDERS[0])))).alias("place"))
    windows = stored(places.groupBy("place").agg(F.count("*").alias("n")), "windows")
    ends = windows.select("place", "n", F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.substring("place", -o, o).alias("gram")) for o in ORDERS))).alias("x"))
    ends = ends.select("place", "n", "x.o", "x.gram").join(model.grams.select("gram", "o", "gains"), ["gram", "o"])
    best = stored(ends.groupBy("place").agg(F.first("n").alias("n"), F.max_by("gains", "o").alias("gains")), "window-gains")
    backed = hot_join(places, best, ["place"], "inner", best.count(), 64 + 16 * n, "n").groupBy("w", "m").agg(*_added("gains", n))

    scored = stored(known.unionByName(backed), "word-gains")
    out = hot_join(rest, scored, ["w"], "inner", scored.count(), 64 + 8 * n, "m")
    return out.groupBy("id").agg(*(F.sum(F.col(v) * F.col("c")).alias(v) for v in values))


def _others(scanned: DataFrame, model: Model) -> DataFrame:
    """k1, k2, copies and ``more``, the sums of the words that weren't held, of each different text that has such."""
    texts = scanned.where(F.size("others") > 0).select("k1", "k2", "others")
    copies = stored(texts.groupBy("k1", "k2").agg(F.count("*").alias("copies")), "text-copies")
    many = copies.where("copies > 1")
    rows = many.count()
    once = without(texts, many, ["k1", "k2"], rows, 40, "copies")
    texts = once.unionByName(hot_join(texts, many, ["k1", "k2"], "left_semi", rows, 40, "copies").dropDuplicates(["k1", "k2"]))
    texts = stored(texts.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "others"), "other-places")
    sums = _joined(texts.select("id", F.explode("others").alias("x")).select("id", "x.w", "x.c"), model)
    sums = sums.select("id", F.array(*(f"v{k}" for k in range(len(model.langs)))).alias("more"))
    return stored(texts.select("id", "k1", "k2").join(sums, "id").drop("id").join(copies, ["k1", "k2"]), "other-sums")


def text_keys(text: str = "text") -> tuple[Column, Column]:
    """Two hashes of a text, by which equal texts are one."""
    return F.xxhash64(text), F.xxhash64(F.lit("b"), text)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, k1 and k2 (the text's hashes), lang_pred and score of every row."""
    n = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent(FREQUENT))
    k1, k2 = text_keys()
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    texts = docs.select(*keep, k1.alias("k1"), k2.alias("k2"), "text")
    made = texts.transform(in_batches, _scan(uuid.uuid4().hex, shared, n), kinds + "k1 long, k2 long, letters boolean, sums array<double>, others array<struct<w:string,c:long>>")
    scanned = stored(made, "scanned")
    if n:
        more = _others(scanned, model)
        total = hot_join(scanned.drop("others"), more, ["k1", "k2"], "left", more.count(), 48 + 8 * n, "copies")
        total = total.withColumn("total", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b)))
    else:
        total = scanned.withColumn("total", F.col("sums"))
    top = F.array_max("total")
    share = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(F.greatest(x - top, F.lit(-700.0))))
    langs = F.array(*map(F.lit, model.langs)) if n else F.array().cast("array<string>")
    told = F.col("letters") & F.lit(n > 0)
    best = F.try_element_at(langs, F.array_position("total", top).cast("int"))
    return total.select(*keep, "k1", "k2", F.when(told, best).otherwise(UNDETERMINED).alias("lang_pred"), F.when(told, share).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all ``docs``; learned from the rows of ``training`` (or ``docs``) that aren't held out."""
    model = Model((docs if training is None else training).where(~held_out()))
    docs = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(docs, model, ["doc_id", "held_out"]).drop("k1", "k2")


def determined(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told; each row is judged by its own text."""
    model = Model(docs.where(~held_out()))
    told = predict(docs.select("text"), model, []).where(F.col("lang_pred") == UNDETERMINED)
    h1, h2 = fresh(docs, "_h1", "_h2")
    gone = stored(told.groupBy(F.col("k1").alias(h1), F.col("k2").alias(h2)).agg(F.count("*").alias("n")), "undetermined")
    keyed = docs.withColumns(dict(zip((h1, h2), text_keys())))
    return without(keyed, gone, [h1, h2], gone.count(), 40, "n").select(*docs.columns)
