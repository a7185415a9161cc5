"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

A document's ids (those of a public tokenizer, then an end id) are cut into pieces of at most ``size`` tokens,
the first piece taking the remainder.  What decides the packing is only how many pieces there are of each length,
a table of at most ``size`` rows.  On it, minimum bin slack runs in rounds: subset-sum dynamic programming over the
available lengths, with an integer as the bitset of reachable sums, finds the fullest combination that holds the
longest remaining piece; that combination is taken as often as the counts allow, so that each round uses up some
length and the plan has few rows whatever the input's size.  A piece is then placed by its rank among the pieces of
its length: ranks are counted within buckets of documents and shifted by the buckets' totals, so no task holds all
pieces of one length.

Defined cases: a null or empty text is the end id alone.  Only documents of more than ``size`` ids are cut.  Rows
are placed each by itself, so repeated rows and ids are packed as often as they occur; null ids are kept.  An
empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, once_a_worker, stored

SIZE, END = 1024, 2
#: A worker's memory of encoded words is emptied beyond this many bytes; longer words than ``REMEMBERED`` aren't kept.
HELD, REMEMBERED = 40 << 20, 64
#: Rows whose texts are Python strings at a time.
AT_ONCE = 256
#: Pieces of one bucket, about; the ranks of a bucket are counted in one task.
BUCKET = 20_000
#: White space next to white space, or other than a space or line feed, and special tokens: such texts are cut in another way.
ODD = ("  ", "\n\n", " \n", "\n ", *map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31)), "<|")
ODD_FURTHER = re.compile(r"[^\S\x00-\x7f]")
#: Where white space follows something else a token always ends, so each run of white space goes with what follows it.
SEGMENTS = re.compile(r"(?<=\S)(?=[\t-\r ])")
#: What tokenizers differ in: white space of some libraries only, and special tokens.
STRANGE = re.compile(r"[^\S\t-\r ]|\u180e|<\|")


def odd(text: str) -> bool:
    return any(x in text for x in ODD) or not text.isascii() and ODD_FURTHER.search(text) is not None


#: How byte-level pre-tokenizers cut a text before pairs are merged.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(path: str):
    """The tokenizer of a byte-level file as byte ranks, which merge several times faster; None where ids don't follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or whole.get("normalizer") or model.get("ignore_merges"):
        return None
    # byte-level files write bytes as characters: the printable ones as themselves, the others from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in whole.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][m] for m in merges]
    if made != sorted(made) or len(ranks) != 256 + len(set(made)) or max(model["vocab"][c] for c in byte) >= min(made, default=1 << 30):
        return None
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids as little-endian 32-bit integers.

    The byte-level pre-tokenizer always starts a new token where white space begins, so words are encoded by themselves,
    each with the white space before it, and remembered.  So the tokenizer's own encoding of a text, which takes some
    hundred bytes a token, is never made of a long text with odd white space, but of its segments.
    """

    def __init__(self, path: str) -> None:
        self.path, self.of, self.fast = path, None, ranked(path)
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.feed = self._word("\n")

    def _encode(self, text: str) -> bytes:
        if self.of is None:
            from tokenizers import Tokenizer

            self.of = Tokenizer.from_file(self.path)
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array(self.fast.encode_ordinary(word), "<u4").tobytes() if self.fast else self._encode(word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if odd(text) or text[0] in " \n" or text[-1] in " \n":
            return self._segments(text) if self.fast else self._encode(text)
        known, out = self.words, []
        for line in text.split("\n"):
            words = line.replace(" ", "\0 ").split("\0")
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                out.append(b"".join([known.get(w) or self._learned(w) for w in words]))
        return self.feed.join(out)

    def _segments(self, text: str) -> bytes:
        known, out, at = self.words, [], 0
        for end in [m.start() for m in SEGMENTS.finditer(text)] + [len(text)]:
            word, at = text[at:end], end
            if (ids := known.get(word)) is None:
                # a long run of white space makes the faster library backtrack
                slow = STRANGE.search(word) or len(word) > REMEMBERED and word[:2].isspace()
                ids = self._encode(word) if slow else self._learned(word)
            out.append(ids)
        return b"".join(out)

    def _learned(self, word: str) -> bytes:
        ids = self._word(word)
        if 0 < len(word) <= REMEMBERED:
            self.held += 260 + len(word) + len(ids)  # both objects with their headers, and a place in the table
            if self.held > HELD:
                self.words.clear()
                self.held = 0
            self.words[word] = ids
        return ids


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids; the first takes the remainder."""
    first = n % size or size
    return [(0, min(n, first))] + [(at, size) for at in range(first, n, size)]


def _cutter(path: str, size: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_a_worker("packing", ("encoder", path), lambda: Encoder(path))
        for batch in batches:
            at, rows = [], []
            for begin in range(0, len(batch), AT_ONCE):
                for i, text in enumerate(batch.column(1).slice(begin, AT_ONCE).to_pylist(), begin):
                    ids = encode(text or "") + tail
                    for k, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                        at.append(i)
                        rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = zip(*rows) if rows else [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(df: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of each document."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(in_batches, _cutter(path, size, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; longer lengths are preferred."""
    reach, mask, seen = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        most = min(counts[length], room // length)
        took = 1
        while most:  # binary splitting: 1, 2, 4, ... and the rest
            took = min(took, most)
            seen.append((reach, length, took))
            reach = (reach | reach << (length * took)) & mask
            most -= took
            took *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, took in reversed(seen):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + took
            total -= length * took
    return chosen


def minimum_bin_slack(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence with their numbers, how many such sequences) until all pieces are placed."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest(left, size - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[x] // n for x, n in bin_.items())
        plan.append((bin_, times))
        for x, n in bin_.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def placements(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies in a sequence, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            rows.append((length, used.get(length, 0), n * times, n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return rows


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`cut_pieces`."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(buckets)).cast("int"))
    counted = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    plan = minimum_bin_slack({r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}, size)  # at most ``size`` rows
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "first", "ranks", "copies", "sequence", "at")])
    places = F.broadcast(spark.createDataFrame(placements(plan), schema))  # a few rows for each length
    before = F.sum("n").over(_by("length", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counted.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(_by(["length", "bucket"], ["doc_id", "piece", "start", "ids_crc32"])) - 1)
    ranked = ranked.join(shifts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    within = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    placed = ranked.alias("r").join(places.alias("p"), (F.col("r.length") == F.col("p.length")) & within)
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div copies")).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("copies")) * F.col("r.length")).alias("offset"),
    )


def _by(keys: str | list[str], order: str | list[str]) -> WindowSpec:
    keys, order = ([x] if isinstance(x, str) else x for x in (keys, order))
    return Window.partitionBy(*keys).orderBy(*order)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    return pack(cut_pieces(docs, path, size, end), size)
