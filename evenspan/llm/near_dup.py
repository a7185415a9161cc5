"""Near-duplicate documents by SetSketch registers over word shingles.

A document's set holds 64-bit hashes of its distinct shingles of five words.  Its sketch has exponentially spaced
truncated minima as registers: register i is 1 - log_b of the set's smallest value under the i-th hash, a value
that is exponentially distributed, rounded down and cut to 0..Q+1.  Sketches of two sets merge by the larger
register, and two sets share a register with (almost exactly) their Jaccard similarity.

1. Sets with the same signature (size and two sums) are one class, whose smallest id stands for it.
2. Bands of registers are hashed; in each bucket all members are tied to the smallest one (a star, never all pairs).
   Connected stars are candidate groups: whatever shares a bucket is in one group.  With the default bands a pair
   at the threshold shares no bucket with a probability of about 3e-6.
3. Inside a group, a member's similarity to the others is estimated jointly from the numbers of larger, smaller and
   equal registers by maximum likelihood; what passes (six standard errors below the threshold) is confirmed on the
   full sets.  A member already in the group's main component needs no search of its own, as pairs within it are
   connected anyhow; so a large group of near copies costs little more than its size, and no link is lost.
   Groups of over ``ROWS`` members or ``BLOCK`` shingles are dealt into parts, each searched together with the
   group's hub, the member that has most others in its buckets, in a task for each part.  After that, only buckets with
   members of several components are searched, and in them only pairs of different components; large buckets are dealt
   into parts too.  A task gives as many links as it joins components, never all its pairs.
4. Components of the confirmed links give each class its smallest reachable id.

Defined cases: a text of fewer words than a shingle is one shingle; a null, empty or blank text has an empty set and
is linked with nothing.  Classes are nodes by numbers of their own, so repeated and null ids link nothing; rows with a
null id get the smallest id of their component, null if there is none.  Repeated rows get equal results.  Very long
texts are handled in blocks of bytes.  An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hot_join, in_batches, once_a_worker, small_or_shuffled, stored, without
from .graph import connected_components

WORDS = 5
#: Base, rate and limit of the registers.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Bytes of text that are hashed at once, about.
CHUNK = 1 << 20
#: Members and shingles that one part of a candidate group holds, about.
ROWS, BLOCK = 100, 2_000_000
#: What tells classes apart.
KEY = ["n_shingles", "s1", "s2"]

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed)) | np.uint64(1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for a chunk."""

    def of(p: int) -> np.ndarray:
        out = np.full(CHUNK + 1, p, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_P), of(pow(_P, -1, 1 << 64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of lower-cased bytes: a difference of prefix sums, shifted to the word's start.

    A word that goes over a part's end is carried on, so its hash depends on its bytes only.
    """
    up, down = once_a_worker("near_dup", ("powers",), _powers)
    hashes, starts, at, carried = [], [], 0, None
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        part = np.frombuffer(raw, np.uint8, end - at, at)
        word = ~_SPACE[part]
        edges = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        values, first = (sums[last] - sums[first]) * down[first], first + at
        if carried is not None:
            value, since = carried
            if word[0]:
                values[:1] = value + values[:1] * np.uint64(pow(_P, at - int(since[0]), 1 << 64))
                first[:1] = since
            else:
                values, first = np.concatenate((value, values)), np.concatenate((since, first))
            carried = None
        if end < len(raw) and word[-1]:  # the next part goes on with this word
            carried, values, first = (values[-1:], first[-1:]), values[:-1], first[:-1]
        hashes.append(mix(values))
        starts.append(first)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    salts, at = _odd(words, 7), 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < CHUNK):
            raw.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            size += len(raw[-1]) + 1
            at += 1
        w, first = word_hashes(b" ".join(raw))
        ends = np.searchsorted(first, np.cumsum([len(x) + 1 for x in raw]))
        total = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            total += w[k : k + len(total)] * salts[k]
        total = mix(total)
        lo = 0
        for hi in ends.tolist():
            if hi - lo >= words:
                yield np.unique(total[lo : hi - words + 1])
            elif hi > lo:
                yield mix((w[lo:hi] * salts[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
            lo = hi


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, as signed 64-bit integers: equal sets have equal signatures, others differ but for chance."""
    a, b = int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return a - (1 << 64 if a >> 63 else 0), b - (1 << 64 if b >> 63 else 0)


def sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The registers of non-empty sets, a row each."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((m, len(sets)), np.uint64)
    for i, salt in enumerate(_odd(m, 11)):
        np.minimum.reduceat(flat * salt, starts, out=least[i])
    value = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def joint_estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: float, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of a set of size ``na`` with sets of sizes ``nb``, given how many registers of the first are larger, smaller and equal."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    a, b = p(u - v * j), p(v - u * j)
    score = more[:, None] * np.log(a) + less[:, None] * np.log(b) + same[:, None] * np.log(np.clip(1 - a - b, 1e-9, 1))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def links(sets: list[np.ndarray], threshold: float, m: int, wanted: list[bool] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs that connect exactly what the pairs of similarity ``threshold`` or more connect, among non-empty sets.

    With ``wanted``, only pairs of the sets that are marked there count, and ``known`` has a number for each set's
    component so far: pairs inside a component aren't looked at.  There are never more pairs than components.
    """
    n = len(sets)
    if n < 2 or wanted is not None and not any(wanted):
        return []
    registers, sizes = sketches(sets, m), np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    postings = doc[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    begins = ends - np.bincount(code)
    own = np.cumsum(sizes) - sizes
    floor = threshold - 6 * (threshold * (1 - threshold) / m) ** 0.5
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found: list[tuple[int, int]] = []

    comp = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1].reshape(-1)

    def search(z: int) -> np.ndarray:
        gap = np.minimum(sizes, sizes[z]) >= threshold * np.maximum(sizes, sizes[z]) - 1e-9
        gap[comp == comp[z]] = False
        others = np.flatnonzero(gap)
        if len(others):
            r = registers[others]
            more, less = (registers[z] > r).sum(1), (registers[z] < r).sum(1)
            others = others[joint_estimate(more, less, m - more - less, float(sizes[z]), sizes[others].astype(float)) >= floor]
        if not len(others):
            return others
        if len(others) < 20:
            shared = np.array([len(np.intersect1d(sets[z], sets[o], assume_unique=True)) for o in others])
        else:
            codes = code[own[z] : own[z] + sizes[z]]
            shared = np.bincount(np.concatenate([postings[a:b] for a, b in zip(begins[codes], ends[codes])]), minlength=n)[others]
        union = sizes[z] + sizes[others] - shared
        return others[100 * shared >= round(100 * threshold) * union]

    if wanted is not None:
        for z in np.flatnonzero(wanted).tolist():
            for y in search(z).tolist():
                if comp[y] != comp[z]:
                    comp[comp == comp[y]] = comp[z]
                    found.append((z, y))
        return found
    main: np.ndarray = np.zeros(n, bool)
    for z in range(n):
        if main[z]:
            continue
        near = search(z)
        for y in near.tolist():
            a, b = root(z), root(y)
            if a != b:
                parent[a] = b
                found.append((z, y))
        if not main.any() or main[near].any():  # the main component grows from the first member that has links
            main[near] = main[z] = len(near) > 0
    return found


def _sketched(words: int, rows: int, bands: int):
    """The first columns as they are, and of the last one, the text, the set's size, signature and hashed bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rows * bands
        weights = _odd(rows, 13)
        for batch in batches:
            *before, texts = batch.columns
            size, s1, s2, keys = [], [], [], []
            for at in range(0, len(batch), 256):
                sets = list(shingle_sets(texts.slice(at, 256).to_pylist(), words))
                size += [len(s) for s in sets]
                full = [s for s in sets if len(s)]
                if full:
                    cut = sketches(full, m).astype(np.uint64).reshape(len(full), bands, rows)
                    hashed = mix((mix(cut) * weights).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)).astype(np.int64)
                    made = iter(hashed.tolist())
                for s in sets:
                    a, b = signature(s)
                    s1.append(a)
                    s2.append(b)
                    keys.append(next(made) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [*before, pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                [*batch.schema.names[:-1], "n_shingles", "s1", "s2", "bands"],
            )

    return of


def _linked(threshold: float, m: int, words: int):
    """Links within each (grp, x, y) of the sorted rows; where y isn't negative, those of marked rows with other components only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(task: tuple, members: dict) -> pa.RecordBatch:
            ids = list(members)
            sets = list(shingle_sets([members[i][0] for i in ids], words))
            pairs = links(sets, threshold, m, *(([members[i][1] for i in ids], [members[i][2] for i in ids]) if task[2] >= 0 else ()))
            return pa.RecordBatch.from_arrays([pa.array([ids[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        task, members = None, {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for group, x, y, rep, marked, root, text in zip(*(part.column(i).to_pylist() for i in range(7))):
                    if (group, x, y) != task:
                        if len(members) > 1:
                            yield made(task, members)
                        task, members = (group, x, y), {}
                    members[rep] = text, marked, root
        if len(members) > 1:
            yield made(task, members)

    return of


def _searched(tasks: DataFrame, texts: DataFrame, threshold: float, m: int, words: int) -> DataFrame:
    """a, b: the links of each task's members (grp, x, y, rep, marked, root), each there once but for a part's hub; ``texts`` has rep and text."""
    dealt = tasks.join(texts, "rep").select("grp", "x", "y", "rep", "marked", "root", "text")
    dealt = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "rep")
    return stored(dealt.transform(in_batches, _linked(threshold, m, words), "a long, b long"), "links")


def _parts() -> Column:
    """In how many parts members are dealt."""
    return F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n_shingles") / BLOCK)).cast("int")


def _confirmed(classes: DataFrame, groups: DataFrame, held: DataFrame, texts_of, threshold: float, m: int, words: int) -> DataFrame:
    """node, root: the components of the confirmed links; ``groups`` has node and root of the candidate groups, ``held`` the members (rep, band, n) of buckets."""
    crowds = held.groupBy("rep").agg(F.sum("n").alias("crowd"))
    members = classes.join(groups, classes["rep"] == groups["node"]).select("rep", F.col("root").alias("grp"), "n_shingles", "least", "t").join(crowds, "rep")
    members = stored(members, "groups")
    hub = F.max_by("rep", F.struct("crowd", -F.col("rep"))).alias("hub")
    sizes = stored(members.groupBy("grp").agg(_parts().alias("parts"), hub, F.count("*").alias("n")), "group-sizes")
    members = hot_join(members, sizes, ["grp"], "inner", sizes.count(), 56, "n")
    members = members.withColumn("x", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    texts = stored(texts_of(members.select("rep", "least", "t"), members.count()), "group-texts")

    none, no, own = F.lit(-1).alias("y"), F.lit(False).alias("marked"), F.col("rep").alias("root")
    split = sizes.where("parts > 1").select("grp", F.explode(F.expr("sequence(0, parts - 1)")).alias("x"), none, F.col("hub").alias("rep"), no, F.col("hub").alias("root"))
    links_ = _searched(members.select("grp", "x", none, "rep", no, own).unionByName(split), texts, threshold, m, words)
    so_far = connected_components(links_)
    if sizes.where("parts > 1").isEmpty():
        return so_far
    so_far = stored(so_far, "components-so-far")
    large = members.where("parts > 1").select("rep", "n_shingles").join(so_far.withColumnRenamed("node", "rep"), "rep", "left")
    large = stored(large.select("rep", "n_shingles", F.coalesce("root", "rep").alias("root")), "large-groups")
    more = _searched(_mixed(held, large), texts, threshold, m, words)
    if more.isEmpty():
        return so_far
    return connected_components(so_far.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _mixed(held: DataFrame, large: DataFrame) -> DataFrame:
    """Tasks (grp, x, y, rep, marked, root) for the buckets in which members (rep, n_shingles, root) of several components meet.

    Those outside the bucket's largest component are marked, in a task for each block y of them and each part x of the bucket.
    """
    inside = stored(held.select("rep", F.col("band").alias("grp")).join(large, "rep"), "large-buckets")
    by_root = inside.groupBy("grp", "root").agg(F.count("*").alias("n"))
    by_root = by_root.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    kept = stored(by_root.where("roots > 1").select("grp", "main", "n"), "mixed-buckets")
    inside = hot_join(inside, kept, ["grp"], "inner", kept.count(), 48, "n").withColumn("outside", F.col("root") != F.col("main"))
    inside = stored(inside.select("grp", "rep", "root", "n_shingles", "outside"), "mixed-members")
    out = F.when(F.col("outside"), F.col("n_shingles"))
    blocks = F.greatest(F.ceil(F.count(out) / ROWS), F.ceil(F.sum(out) / BLOCK)).cast("int").alias("blocks")
    dealt = stored(inside.groupBy("grp").agg(_parts().alias("parts"), blocks, F.count("*").alias("n")), "mixed-sizes")
    inside = hot_join(inside, dealt, ["grp"], "inner", dealt.count(), 48, "n")
    inside = inside.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    there = inside.select("grp", F.col("part").alias("x"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("y"), "rep", "root", "outside", "block")
    there = there.select("grp", "x", "y", "rep", (F.col("outside") & (F.col("block") == F.col("y"))).alias("marked"), "root")
    asked = inside.where("outside and parts > 1").select("grp", F.explode(F.expr("sequence(0, parts - 1)")).alias("x"), F.col("block").alias("y"), "rep", F.lit(True).alias("marked"), "root", "part")
    return there.unionByName(asked.where("x <> part").drop("part"))


def _components(docs: DataFrame, threshold: float, words: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (any columns, doc_id, text last): the rows with their set's size and signature, and the classes of several rows or with links (least id of the component, number of rows, comp)."""
    before = [f.name for f in docs.schema if f.name != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in before)
    ready = docs.select(*before, F.xxhash64("text").alias("t"), "text")
    sketched = stored(ready.transform(in_batches, _sketched(words, rows, bands), f"{kinds}, t long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    # a class has the smallest id, and for its text that of one row with that id
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t").alias("t"))).alias("one")
    classes = sketched.where("n_shingles > 0").groupBy(*KEY).agg(one, F.count("*").alias("rows"), F.any_value("bands").alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), *KEY, F.col("one.id").alias("least"), F.col("one.t").alias("t"), "rows", "bands"), "classes")

    keys = classes.select("rep", F.explode("bands").alias("band"))
    buckets = stored(keys.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets")
    held = stored(hot_join(keys, buckets, ["band"], "inner", buckets.count(), 48, "n").select("rep", "band", "centre", "n"), "held")
    stars = held.where("rep <> centre")
    # a member is tied to the smallest of its centres, and the others to that one: as connected, with far fewer different ties
    ties = stars.groupBy("rep").agg(F.collect_set("centre").alias("centres")).withColumn("first", F.array_min("centres"))
    ties = ties.select(F.explode(F.array_append("centres", F.col("rep"))).alias("a"), F.col("first").alias("b"))
    groups = connected_components(ties)

    def texts_of(wanted: DataFrame, many: int) -> DataFrame:
        found = docs.select(F.col("doc_id").alias("least"), F.xxhash64("text").alias("t"), "text")
        found = found.join(small_or_shuffled(wanted, many, 48), found["t"].eqNullSafe(wanted["t"]) & found["least"].eqNullSafe(wanted["least"]))
        return found.groupBy("rep").agg(F.any_value("text").alias("text"))

    components = _confirmed(classes.drop("bands"), groups, held, texts_of, threshold, rows * bands, words)
    known = classes.drop("bands").join(components, classes["rep"] == components["node"], "left").where("root is not null or rows > 1")
    known = stored(known.select(*KEY, "least", "rows", F.coalesce("root", "rep").alias("comp")), "component-classes")
    least = stored(known.groupBy("comp").agg(F.min("least").alias("to"), F.count("*").alias("n")), "component-ids")
    known = hot_join(known.drop("least"), least, ["comp"], "inner", least.count(), 40, "n").drop("n")
    return sketched.drop("bands", "t"), stored(known, "components")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, words: int = WORDS, rows: int = 8, bands: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ids are integers."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched, known = _components(docs, threshold, words, rows, bands)
    out = hot_join(sketched, known.withColumn("known", F.lit(True)), KEY, "left", known.count(), 72, "rows")
    component = F.when(F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("to"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _plain(kind: T.DataType) -> bool:
    """Whether values of the type can be hashed."""
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def distinct_documents(docs: DataFrame, threshold: float = 0.85, words: int = WORDS, rows: int = 8, bands: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates one row, with all its columns: the one with the smallest id (null last).

    Rows are told apart by two hashes of all their columns (maps excepted); of rows with equal ones, exact copies, one
    stays.  Rows without words are in no group and all stay.
    """
    h1, h2 = fresh(docs, "_h1", "_h2")
    parts = [F.col(f"`{f.name}`") for f in docs.schema if _plain(f.dataType)]
    marked = docs.withColumns({h1: F.xxhash64(*parts), h2: F.xxhash64(F.lit("b"), *reversed(parts))})
    ready = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col(text_col).alias("text"))
    sketched, known = _components(ready, threshold, words, rows, bands)
    members = hot_join(sketched, known, KEY, "inner", known.count(), 72, "rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    members = stored(members.groupBy("comp", row.alias("row")).agg(F.count("*").alias("n")), "members")
    first = stored(members.groupBy("comp").agg(F.min("row").alias("first"), F.count("*").alias("many")), "first-members")
    told = hot_join(members, first, ["comp"], "inner", first.count(), 96, "many")
    told = told.select(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2), "n", (F.col("row") == F.col("first")).alias("stays"))
    told = stored(told, "told")
    gone, copied = told.where("not stays or n > 1"), told.where("stays and n > 1")
    out = without(marked, gone, [h1, h2], gone.count(), 40, "n")
    many = copied.count()
    if many:  # of exact copies, ids included, any one
        same = hot_join(marked, copied.select(h1, h2, "n"), [h1, h2], "left_semi", many, 40, "n")
        one = same.groupBy(h1, h2).agg(F.any_value(F.struct(*docs.columns)).alias("row")).select("row.*", h1, h2)
        out = out.unionByName(one)
    return out.select(*docs.columns)
