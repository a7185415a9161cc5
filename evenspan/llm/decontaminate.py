"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as normalised bytes: lower case, every ASCII character but letters and digits a space, one space
between words.  An item of m bytes that occurs in a document with at most k edits shares at least m + 1 - q (k + 1)
of its q-grams with it, on diagonals that differ by at most k each way.  So q-grams (eight bytes, compared as
integers after a bitmap of the items' q-grams) are counted in overlapping diagonal bands of twice that width; a band
that reaches the bound is a region, in which as many different places of the item have to be met (repetitive text meets few
places often).  The region is verified by banded alignment: the least number of edits that
turn the whole item into some part of the region, computed on the region's diagonals and k more to each side.  The budget k is ``share`` of the item's length, or less for items
so short that the bound would not be positive; items shorter than q bytes are found only as they stand, as whole
words.

Benchmark items are held in blocks of about ``BLOCK`` bytes, one at a time: driver and workers get a block, documents
are scanned with it and the block is dropped.  So memory doesn't grow with the benchmark, and time does, by a scan for
each block.  No documents are shuffled.

Defined cases: null and empty texts contain nothing, and null, empty or unlettered items are nowhere.  Each row is
judged by its own text, whatever its id; repeated rows give repeated results, and so do items of equal text.  Several places of one item in a document give one row, the one
with the fewest edits.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, once_a_worker, stored, taken

QGRAM = 8
SHARE = 0.1
#: Bytes of benchmark text in a block, about.
BLOCK = 2 << 20
#: Rows whose texts are Python strings at a time.
AT_ONCE = 256
#: Bytes of documents that are scanned at once, about, and pairs of places that are counted at once.
CHUNK, PAIRS = 1 << 18, 1 << 21
BITS = 22

_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """With one space at either end, or a single space."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    return b" " + b" ".join(raw.split()) + b" "


def budget(m: int, share: float = SHARE, q: int = QGRAM) -> int:
    return max(0, min(int(share * m), m // q - 1))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def qgrams(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as an integer."""
    n = len(raw) - QGRAM + 1
    out = np.empty(max(0, n), np.uint64)
    for k in range(QGRAM):
        if n > k:
            out[k::QGRAM] = np.frombuffer(raw, "<u8", (n - k + QGRAM - 1) // QGRAM, k)
    return out


class Items:
    """An index of the q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE) -> None:
        kept = [(i, b.strip()) for i, t in items if (b := normalised(t)).strip()]
        self.ids, self.raw = [i for i, _ in kept], [b for _, b in kept]
        size = np.array([len(b) for b in self.raw], np.int64)
        self.size, self.short = size, [k for k, n in enumerate(size) if n < QGRAM]
        self.k = np.array([budget(n, share) for n in size], np.int64)
        self.least = size + 1 - QGRAM * (self.k + 1)
        self.grams = grams = [qgrams(b) for b in self.raw]
        gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.gram, first, number = np.unique(gram[order], return_index=True, return_counts=True)
        self.first, self.number, self.item, self.place = first, number, item[order], place[order].astype(np.int64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[_slot(self.gram)] = True

    def meets(self, item: int, region: bytes) -> bool:
        """Whether the region holds the q-grams of as many places of the item as the bound asks for."""
        return np.count_nonzero(np.isin(self.grams[item], qgrams(region))) >= self.least[item]

    def regions(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(item, first and last diagonal) of the bands that reach the bound."""
        grams = qgrams(raw)
        at = np.flatnonzero(self.bitmap[_slot(grams)])
        if not len(at) or not len(self.gram):
            return []
        code = np.searchsorted(self.gram, grams[at])
        code[code == len(self.gram)] = 0
        same = self.gram[code] == grams[at]
        at, code = at[same], code[same]
        number = self.number[code]
        ends = np.cumsum(number)
        # item, band -> count; a band is twice as wide as the diagonals of one occurrence, and starts every half
        counts: dict[tuple[int, int], int] = {}
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            n = number[lo:hi]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.first[code[lo:hi]], n) + within
            item = self.item[entry]
            width = 2 * self.k[item] + 1
            half = (np.repeat(at[lo:hi], n) - self.place[entry] + len(raw)) // width
            key, seen = np.unique(np.concatenate((half, half - 1)) * len(self.ids) + np.concatenate((item, item)), return_counts=True)
            enough = slice(None) if len(at) > hi or lo else seen >= self.least[key % len(self.ids)]
            for x, c in zip(key[enough].tolist(), seen[enough].tolist()):
                counts[x] = counts.get(x, 0) + c
            lo = hi
        out = []
        for x, c in counts.items():
            band, item = divmod(x, len(self.ids))
            if c >= self.least[item]:
                width = int(2 * self.k[item] + 1)
                out.append((item, band * width - len(raw), (band + 2) * width - 1 - len(raw)))
        return out


def align(item: bytes, region: bytes, k: int, ahead: int = 0) -> int | None:
    """The fewest edits, up to ``k``, that turn ``item`` into some part of ``region``, whose first ``ahead`` diagonals lie before its start.

    The table has a row for each byte of the item, and in it only the region's diagonals: places less the row's number.
    """
    if item in region:
        return 0
    n, wide = len(region), len(region) + ahead - len(item) + 1
    if wide < 1:
        return None
    # what lies outside the region matches nothing
    around = np.full(len(item) + wide + 1, -1, np.int16)
    around[ahead + 1 : ahead + 1 + n] = np.frombuffer(region, np.uint8)[: len(around) - ahead - 1]
    steps, far = np.arange(wide), np.int64(1 << 30)
    place = steps - ahead
    row = np.where((place >= 0) & (place <= n), 0, far)
    for i, c in enumerate(item, 1):
        place = steps + (i - ahead)
        new = row + (around[i : i + wide] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(place > 0, new, np.where(place == 0, i, far))
        new[place > n] = far
        row = np.minimum.accumulate(new - steps) + steps
        if i >= ahead and row.min() > k:
            return None
    return int(row.min()) if row.min() <= k else None


def matches(index: Items, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """(number of the text, number of the item, edits) of each item that occurs in a text."""
    at = 0
    while at < len(texts):
        parts, starts, size = [], [], 0
        while at + len(parts) < len(texts) and (not parts or size < CHUNK):
            parts.append(normalised(texts[at + len(parts)]))
            starts.append(size)
            size += len(parts[-1]) + QGRAM
        raw = (b"\0" * QGRAM).join(parts)
        best: dict[tuple[int, int], int] = {}
        for item, first, last in index.regions(raw):
            m, k = int(index.size[item]), int(index.k[item])
            lo, hi = first - k, last + m + k
            t = int(np.searchsorted(starts, max(0, lo), "right")) - 1
            while t < len(parts) and starts[t] < hi:
                region = parts[t][max(0, lo - starts[t]) : max(0, hi - starts[t])]
                if len(region) >= m - k and index.meets(item, region):
                    edits = align(index.raw[item], region, k, max(0, starts[t] - lo))
                    if edits is not None and edits <= best.get((t, item), k):
                        best[t, item] = edits
                t += 1
        for item in index.short:
            word = b" " + index.raw[item] + b" "
            best |= {(t, item): 0 for t, part in enumerate(parts) if word in part}
        for (t, item), edits in sorted(best.items()):
            yield at + t, item, edits
        at += len(parts)


def _found(index: Items, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    for begin in range(0, len(texts), AT_ONCE):
        for t, item, edits in matches(index, texts.slice(begin, AT_ONCE).to_pylist()):
            yield begin + t, item, edits


def _scan(name: str, shared, share: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once_a_worker("decontamination", ("items", name), lambda: Items(taken(shared), share))
        for batch in batches:
            rows = list(_found(index, batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())),
                    pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([int(index.size[r[1]]) for r in rows], pa.int64()),
                ],
                ["doc_id", "item_id", "edits", "item_bytes"],
            )

    return of


def _clean(name: str, shared, share: float, at: int):
    """The rows whose text, column ``at``, holds no item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once_a_worker("decontamination", ("items", name), lambda: Items(taken(shared), share))
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[r[0] for r in _found(index, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return of


def _blocks(benchmark: DataFrame) -> Iterator[tuple[str, Any, bool]]:
    """(name, broadcast items, whether they are the last) of each block; all but the last are dropped when the next one is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)  # about BLOCK bytes
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])
        yield uuid.uuid4().hex, shared, k == blocks - 1
        if k < blocks - 1:
            shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_bytes: each benchmark item that a document holds."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for name, shared, last in _blocks(benchmark):
        found = docs.transform(in_batches, _scan(name, shared, share), f"doc_id {kind}, item_id long, edits long, item_bytes long")
        found = found if last else stored(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    schema, at = docs.schema, docs.columns.index(text_col)
    for name, shared, last in _blocks(benchmark):
        docs = docs.transform(in_batches, _clean(name, shared, share, at), schema)
        docs = docs if last else stored(docs, "clean")
    return docs
