"""Personal data with SQL functions only: fixed patterns, then information-theoretic sanitisation.

Base spans: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.

A word can reveal a protected value although it is none itself: a name that stands in one number's documents only.  So
words are counted by documents, and with the protected values of the same documents.  A word's disclosure of a value is
the share of the word's documents that hold the value.  Words with a disclosure of at least ``DISCLOSURE``, in at least
``SUPPORT`` documents and in more than chance explains, are generalised wherever they occur, so that a text can't be
joined with its protected value.  Chance: were the word's documents drawn from all, so many of them or more would hold
the value with a probability of at most exp(-docs * KL(disclosure || value's share)), which has to be ``LUCK`` or less.

Words are runs of letters, marks and digits; one of three letters or fewer without a digit first counts where it is
written as a name, that is, not in lower case (or in a script without cases), and is then found however it is written.

All counts cover all documents.  What arithmetic rules out is never paired: values in fewer than ``SUPPORT`` documents,
words that stand in fewer documents with such values, and words in more documents than disclosure allows for the most
frequent value beside them.  Values that share all their documents are one in the count, and so are words, so a
directory that is found in many places is a few pairs and not all its values with all its words.  Equal texts are one
text with a number of copies.  Corpus counts join words with the few that are left; that side is broadcast where its
counted size is small, else joined by shuffling with the most frequent ones apart.

Defined cases: null and empty texts have no spans; repeated rows count as documents each and get equal results; null
ids are kept; an empty table gives an empty result.  Whole texts are read, and only the named columns.  What is stored
meanwhile are places and hashes, never a protected value or a name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored, text_or_empty
from .spans import PLACE, apart, by_start, listed, matches, overlaid, placed

KINDS = ["email", "ip", "card", "phone", "term"]
# A match can't start inside a run that has just failed from its start; \G lets one start where the last has ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer than 13 digits can't be cards, and no match starts inside a run.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSIDE = r"[\p{L}\p{M}\p{N}]"
WORD = INSIDE + "+"
#: Short words that start in lower case are left out.
NAME = rf"(?<!{INSIDE})(?![\p{{Ll}}][\p{{L}}\p{{M}}]{{0,2}}(?!{INSIDE})){WORD}"

SUPPORT, DISCLOSURE, LUCK = 3, 0.5, 1e-3


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def base_spans(text: Column) -> Column:
    """By kind as listed, then by start."""
    email = matches(text, EMAIL, "email")
    ip = F.filter(matches(text, IP, "ip"), lambda x: F.forall(F.split(x["v"], "\\."), _small))

    def is_card(x: Column) -> Column:
        d = _digits(x["v"])
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))

    card = F.filter(matches(text, CARD, "card"), is_card)
    phone = F.filter(matches(text, PHONE, "phone"), lambda x: F.length(_digits(x["v"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def _words(text: Column) -> Column:
    """Hashes of a text's words in lower case."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda x: F.xxhash64(x))


def _names(text: Column, base: Column) -> Column:
    """Hashes of the words outside of the base spans that may reveal a value, in lower case."""
    return F.array_distinct(F.transform(apart(matches(text, NAME, "term"), base), lambda x: F.xxhash64(F.lower(x["v"]))))


KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With two hashes of the text, by which equal texts are one."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("b"), F.col("text"))})


def _evidence(share: Column, expected: Column) -> Column:
    """Kullback-Leibler divergence in nats; 0 where the share isn't above what is expected."""
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - expected))).otherwise(0.0)
    return F.when(share > expected, share * F.log(share / expected) + rest).otherwise(0.0)


def _alike(rows: DataFrame, what: str) -> DataFrame:
    """``what`` (of ``rows``: k1, k2, copies, ``what``) with its number of documents and its class: what stands in the same texts."""
    places = F.bit_xor(F.xxhash64(*KEY)), F.bit_xor(F.xxhash64(F.lit("c"), *KEY))
    counted = rows.groupBy(what).agg(F.sum("copies").alias("of"), F.count("*").alias("texts"), *(x.alias(f"x{i}") for i, x in enumerate(places)))
    return counted.select(what, "of", "texts", F.xxhash64("of", "texts", "x0", "x1").alias("class"))


def _texts(docs: DataFrame, wanted: DataFrame, many: int, row_bytes: int, weight: str) -> DataFrame:
    """k1, k2, text of the wanted texts, and the columns of ``wanted``, one row each."""
    found = hot_join(_keyed(docs.select("text")), wanted, KEY, "inner", many, row_bytes, weight)
    return found.groupBy(*KEY).agg(*(F.any_value(c).alias(c) for c in found.columns if c not in KEY))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """term (hash of a word in lower case), docs (that hold it), disclosure, bits.  ``found`` has k1, k2, base and values (hashes) of every row of ``docs``."""
    none = found.sparkSession.createDataFrame([], "term long, docs long, disclosure double, bits double")
    holding = found.where(F.size("values") > 0)
    copies = holding.groupBy(*KEY).agg(F.count("*").alias("copies"), F.any_value("values").alias("values"), F.any_value("base").alias("base"))
    copies = stored(copies, "holding")
    values = stored(copies.select(*KEY, "copies", F.explode("values").alias("value")), "values")
    frequent = stored(_alike(values, "value").where(F.col("of") >= SUPPORT), "frequent-values")
    many = frequent.count()
    if not many:
        return none
    beside = stored(hot_join(values, frequent, ["value"], "inner", many, 56, "texts").select(*KEY, "copies", F.col("class").alias("value"), "of").distinct(), "value-classes")
    texts = stored(beside.groupBy(*KEY).agg(F.max("of").alias("most")).join(copies.drop("values"), KEY), "protected-texts")
    rows, spans = texts.agg(F.count("*"), F.sum(F.size("base"))).first()
    words = _texts(docs, texts, 1, 96 * rows + 48 * spans, "copies")
    words = stored(words.select(*KEY, "copies", "most", F.explode(_names(F.col("text"), F.col("base"))).alias("term")), "near-words")
    terms = stored(_alike(words, "term").where(F.col("of") >= SUPPORT).withColumnRenamed("of", "around"), "near-terms")
    near = hot_join(words, terms, ["term"], "inner", terms.count(), 64, "texts").where(F.col("around") * DISCLOSURE <= F.col("most"))
    near = near.select(*KEY, F.col("class").alias("terms"), "around").distinct()
    pairs = near.join(beside, KEY).where(F.col("around") * DISCLOSURE <= F.col("of"))
    pairs = pairs.groupBy("value", "terms", "around", "of").agg(F.sum("copies").alias("n"))
    pairs = stored(pairs.where((F.col("n") >= SUPPORT) & (F.col("n") >= F.col("around") * DISCLOSURE)), "pairs")
    classes = pairs.select(F.col("terms").alias("class")).distinct()
    left = stored(terms.join(classes, "class", "left_semi").select("term", "class", "around"), "terms")
    many = left.count()
    if not many:
        return none
    everywhere = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    held = hot_join(everywhere, left, ["term"], "left_semi", many, 64, "around").groupBy("term").agg(F.count("*").alias("docs"))
    total = found.count()
    told = left.join(held, "term").select("term", "class", "docs").join(pairs.select(F.col("terms").alias("class"), "n", "of"), "class")
    told = told.withColumn("disclosure", F.least(F.col("n") / F.col("docs"), F.lit(1.0))).withColumn("bits", F.log2(F.col("disclosure") * total / F.col("of")))
    proof = F.col("docs") * _evidence(F.col("disclosure"), F.least(F.col("of") / F.lit(total), F.lit(1.0)))
    told = told.where((F.col("disclosure") >= DISCLOSURE) & (proof >= -math.log(LUCK)))
    return told.groupBy("term").agg(F.max("docs").alias("docs"), F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (kind, s, e) for every row."""
    return _spans(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))).select("doc_id", "base", "spans")


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, base, spans of every row of (doc_id, text)."""
    found = _keyed(docs).select("doc_id", *KEY, base_spans(F.col("text")).alias("base"))
    values = F.array_distinct(F.transform("base", lambda x: F.xxhash64(x["kind"], x["v"])))
    found = stored(found.select("doc_id", *KEY, placed(F.col("base")).alias("base"), values.alias("values")), "pii")
    terms = stored(disclosing_terms(docs, found), "disclosing")
    many = terms.count()
    if not many:
        return found.select("doc_id", *KEY, "base", F.col("base").alias("spans"))
    words = _keyed(docs).select(*KEY, F.explode(_words(F.col("text"))).alias("term"))
    holders = stored(hot_join(words, terms, ["term"], "left_semi", many, 64, "docs").groupBy(*KEY).agg(F.count("*").alias("n")), "holders")
    places = _texts(docs, holders, holders.count(), 40, "n")
    spans = F.transform(matches(F.col("text"), WORD, "term"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(F.lower(x["v"])).alias("term")))
    places = places.select(*KEY, "n", F.explode(spans).alias("x")).select(*KEY, "n", "x.term", "x.s", "x.e")
    places = hot_join(places, terms, ["term"], "left_semi", many, 64, "docs").groupBy(*KEY, "n").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("more"))
    places = stored(places.select(*KEY, "n", F.transform("more", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("more")), "term-places")
    rows, spans = places.agg(F.count("*"), F.coalesce(F.sum(F.size("more")), F.lit(0))).first()
    out = hot_join(found, places, KEY, "left", 1, 96 * rows + 48 * spans, "n", size=96 + 48 * F.size("more"))
    more = apart(F.coalesce("more", F.array().cast(PLACE)), F.col("base"))
    return out.select("doc_id", *KEY, "base", F.when(F.col("more").isNotNull(), F.concat("base", more)).otherwise(F.col("base")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text of every row: each span replaced by its kind in square brackets; of overlapping spans the first stays.

    Spans meet their row by its text, on which alone they depend, so repeated and null ids are rows as others are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    spans = _spans(rows).where(F.size("spans") > 0).groupBy(*KEY).agg(F.count("*").alias("n"), F.any_value(by_start(F.col("spans"), KINDS)).alias("spans"))
    spans = stored(spans, "text-spans")
    many, places = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()

    def first(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] >= F.element_at(acc, -1)["e"], F.concat(acc, F.array(x))).otherwise(acc)

    apart_ = F.aggregate(F.coalesce("spans", F.array().cast(PLACE)), F.array().cast(PLACE), first)
    out = hot_join(_keyed(rows), spans, KEY, "left", 1, 96 * many + 48 * places, "n", size=96 + 48 * F.size("spans"))
    return out.select("doc_id", overlaid(F.col("text"), apart_, lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    found = find(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS[:4]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
