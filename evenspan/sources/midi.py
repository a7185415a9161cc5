"""Standard MIDI files as a source: a parser for workers, and scans over binary files."""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRUMS = 9
#: Files and notes that a worker holds as Python objects at once, about; one file is held whole.
FILES, NOTES_AT_ONCE = 64, 20_000
NOTES = "array<struct<track:int,channel:int,onset:bigint,pitch:int,duration:bigint>>"
SCHEMA = f"path string, status string, error string, ppq int, meters array<string>, keys array<string>, drum_notes bigint, notes {NOTES}"


class MidiError(ValueError):
    """What makes a file unreadable, or unsound under the strict rules."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        if at >= len(data):
            raise MidiError("truncated number")
        byte = data[at]
        at += 1
        value = value << 7 | byte & 127
        if byte < 128:
            return value, at
    raise MidiError("overlong number")


#: Keys from seven flats to seven sharps.
MAJOR = "Cb Gb Db Ab Eb Bb F C G D A E B F# C#".split()
MINOR = "Abm Ebm Bbm Fm Cm Gm Dm Am Em Bm F#m C#m G#m D#m A#m".split()


def events(data: bytes) -> tuple[int, int, list[list[tuple]]]:
    """(format, ticks a beat, tracks of (tick, kind, a, b, c)): kinds are on, off, meter and key."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise MidiError("no MIDI header")
    size, form, tracks, ppq = struct.unpack(">IHHH", data[4:14])
    if ppq & 0x8000 or not ppq:
        raise MidiError("times aren't in beats")
    at, out = 8 + size, []
    while at + 8 <= len(data) and len(out) < tracks:
        kind, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if kind == b"MTrk":
            if len(body) < size:
                raise MidiError("truncated track")
            out.append(_track(body))
    if len(out) < tracks:
        raise MidiError("missing track")
    return form, ppq, out


def _track(body: bytes) -> list[tuple]:
    at, tick, status, out = 0, 0, 0, []
    while at < len(body):
        step, at = _varint(body, at)
        tick += step
        if at >= len(body):
            raise MidiError("truncated event")
        if body[at] >= 128:
            status = body[at]
            at += 1
        if status == 0xFF:
            kind = body[at]
            size, at = _varint(body, at + 1)
            value, at = body[at : at + size], at + size
            if kind == 0x58 and size >= 2:
                out.append((tick, "meter", value[0], 1 << value[1], 0))
            elif kind == 0x59 and size >= 2:
                sharps = value[0] - 256 if value[0] > 127 else value[0]
                out.append((tick, "key", (MINOR if value[1] else MAJOR)[max(-7, min(7, sharps)) + 7], 0, 0))
            elif kind == 0x2F:
                break
        elif status in (0xF0, 0xF7):
            size, at = _varint(body, at)
            at += size
        elif status >= 0x80:
            first = body[at]
            second = body[at + 1] if status >> 4 not in (0xC, 0xD) else 0
            at += 1 if status >> 4 in (0xC, 0xD) else 2
            if status >> 4 in (8, 9):
                out.append((tick, "on" if status >> 4 == 9 and second else "off", status & 15, first, second))
        else:
            raise MidiError("no status")
    return out


def _paired(track: list[tuple[int, tuple]], strict: bool) -> list[tuple[int, int, int, int, int]]:
    """(track, channel, onset, pitch, end), first in first out for each channel and pitch."""
    waiting, out = defaultdict(deque), []
    for number, (tick, kind, channel, pitch, _) in track:
        if kind == "on":
            waiting[channel, pitch].append((number, tick))
        elif kind == "off":
            if waiting[channel, pitch]:
                started, onset = waiting[channel, pitch].popleft()
                out.append((started, channel, onset, pitch, tick))
            elif strict:
                raise MidiError("note off without a note")
    if any(waiting.values()):
        raise MidiError("note without an end")
    return out


def parse(data: bytes, strict: bool = False, per_beat: int | None = 96) -> dict:
    """Notes in ticks of ``per_beat`` (the file's own if None), sorted by onset, pitch and duration, drums counted apart.

    Lenient: one stream of all tracks; stray ends are ignored, and a duration is at least 1.  Strict: formats 0 and 1
    only; tracks are paired by themselves; stray ends, empty notes, inexact times and files without notes are errors.
    """
    form, ppq, tracks = events(data)
    if strict and form not in (0, 1):
        raise MidiError("unknown format")
    own = [[(i, e) for e in t if e[1] in ("on", "off")] for i, t in enumerate(tracks)]
    streams = own if strict else [sorted((x for t in own for x in t), key=lambda x: x[1][0])]
    notes, drums = [], 0
    for stream in streams:
        for track, channel, onset, pitch, end in _paired(stream, strict):
            if channel == DRUMS:
                drums += 1
                continue
            if strict and end <= onset:
                raise MidiError("note without a duration")
            if per_beat is not None:
                if strict and (onset * per_beat % ppq or end * per_beat % ppq):
                    raise MidiError("times don't fit the grid")
                onset, end = round(onset * per_beat / ppq), round(end * per_beat / ppq)
            notes.append((track, channel, onset, pitch, max(1, end - onset)))
    if strict and not notes:
        raise MidiError("no notes")
    notes.sort(key=lambda n: (n[2], n[3], n[4]))
    flat = [e for t in tracks for e in t]
    meters = list(dict.fromkeys(f"{e[2]}/{e[3]}" for e in flat if e[1] == "meter")) or ["4/4"]
    return {"ppq": ppq, "meters": meters, "keys": [e[2] for e in flat if e[1] == "key"], "drum_notes": drums, "notes": notes}


def render(notes: list[tuple[int, int, int]], per_beat: int = 96, key: str | None = None, meter: tuple[int, int] | None = None) -> bytes:
    """A format 0 file of (onset, pitch, duration): ends come before notes of the same tick; a key and a meter (its lower number a power of two) stand at the start."""
    moves = sorted([(o + d, 0, p) for o, p, d in notes] + [(o, 1, p) for o, p, d in notes])
    body, now = bytearray(), 0
    if meter:
        body += bytes((0, 0xFF, 0x58, 4, meter[0], meter[1].bit_length() - 1, 24, 8))
    if key:
        names = MINOR if key in MINOR else MAJOR
        body += bytes((0, 0xFF, 0x59, 2, (names.index(key) - 7) & 255, int(names is MINOR)))
    for tick, on, pitch in moves:
        step, parts = tick - now, []
        while True:
            parts.append(step & 127 | (128 if parts else 0))
            step >>= 7
            if not step:
                break
        body += bytes(reversed(parts)) + bytes((0x90 if on else 0x80, pitch, 64 if on else 0))
        now = tick
    body += b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, per_beat) + b"MTrk" + struct.pack(">I", len(body)) + bytes(body)


def _cut(batch: pa.RecordBatch, sizes: list[int | None]) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``FILES`` rows, and of ``NOTES_AT_ONCE`` notes in all unless one row has more."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == FILES or held + (size or 0) > NOTES_AT_ONCE):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _cut(batch, pc.list_value_length(batch.column(1)).to_pylist()):
            files = [render([(n["onset"], n["pitch"], n["duration"]) for n in notes or []]) for notes in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["path", "content"])


def rendered(songs: DataFrame) -> DataFrame:
    """path, content of each song (path, notes of onset, pitch, duration) as a MIDI file; without notes it has an end only."""
    return songs.select(F.col("path").cast("string").alias("path"), "notes").mapInArrow(_rendered, "path string, content binary")


def _scan(strict: bool, per_beat: int | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note = pa.struct([("track", pa.int32()), ("channel", pa.int32()), ("onset", pa.int64()), ("pitch", pa.int32()), ("duration", pa.int64())])
        kinds = [("path", pa.string()), ("status", pa.string()), ("error", pa.string()), ("ppq", pa.int32()), ("meters", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("drum_notes", pa.int64()), ("notes", pa.list_(note))]
        # a note takes about eight bytes of a file
        for part in (p for batch in batches for p in _cut(batch, [n and n // 8 for n in pc.binary_length(batch.column(1)).to_pylist()])):
            rows = []
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                row = {"path": path, "status": "ok", "error": None}
                try:
                    row |= parse(content or b"", strict, per_beat)
                    row["notes"] = [dict(zip(("track", "channel", "onset", "pitch", "duration"), n)) for n in row["notes"]]
                except (MidiError, IndexError, struct.error) as e:
                    row |= {"status": "corrupt", "error": str(e)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return of


def parsed(files: DataFrame, strict: bool = False, per_beat: int | None = 96) -> DataFrame:
    """A row for each file (path, content); a broken one is a row too, with its error."""
    return files.select("path", "content").mapInArrow(_scan(strict, per_beat), SCHEMA)


def read_midi(spark: SparkSession, path: str, strict: bool = False, per_beat: int | None = 96) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid*").option("recursiveFileLookup", "true").load(path)
    return parsed(files, strict, per_beat)


def facts_of(files: DataFrame) -> DataFrame:
    """Facts of the files that parsed: song_id is the path."""
    n = files.where("status = 'ok'").select(F.col("path").alias("song_id"), F.explode("notes").alias("n"))
    return n.select("song_id", F.lit("NOTE").alias("event_type"), "n.onset", "n.duration", "n.pitch")


def file_records(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Per file: digest of its bytes, status, note and onset counts, span in beats, meter."""
    onsets = F.size(F.array_distinct(F.transform("notes", lambda n: n["onset"])))
    span = F.array_max(F.transform("notes", lambda n: n["onset"] + n["duration"])) - F.array_min(F.transform("notes", lambda n: n["onset"]))
    digest = raw.select("path", F.sha2("content", 256).alias("sha256"))
    shown = files.select("path", "status", F.coalesce(F.size("notes"), F.lit(0)).alias("note_count"), F.coalesce(onsets, F.lit(0)).alias("onset_count"), F.coalesce(span / 96, F.lit(0.0)).alias("beats"), F.array_join("meters", ";").alias("meter"))
    return digest.join(shown, "path")
