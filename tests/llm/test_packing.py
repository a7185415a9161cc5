import zlib

import numpy as np
from evenspan.llm import packing
from evenspan.llm.queries import tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .conftest import EDGES


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=8))
def test_every_piece_is_placed_and_bins_hold(counts):
    plan = packing.minimum_bin_slack(counts, 20)
    placed = {}
    for bin_, times in plan:
        assert times > 0 and sum(k * n for k, n in bin_.items()) <= 20
        for k, n in bin_.items():
            placed[k] = placed.get(k, 0) + n * times
    assert placed == counts


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6), st.integers(0, 30))
def test_fullest_is_the_best_sum(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    got = packing.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,'\n\t1é _-", max_size=40))
def test_words_encode_as_the_whole(text):
    encode = ENCODER.setdefault(1, packing.Encoder(tokenizer_path())) if not ENCODER else ENCODER[1]
    assert encode(text) == encode._encode(text)


ENCODER: dict = {}


def test_long_texts_with_odd_white_space_are_not_encoded_whole(monkeypatch):
    encode = packing.Encoder(tokenizer_path())
    text = "  one\ttwo\n\nthree " * 2000 + " " * 5000 + "x\u3000y" + "<|endoftext|>"
    want, longest, whole = encode._encode(text), [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda t: longest.append(len(t)) or whole(t))
    assert encode(text) == want
    assert longest and max(longest) < 5100


def test_against_the_tokenizer(edges):
    rows = packing.pack_documents(edges, tokenizer_path()).collect()
    of = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in EDGES:
        ids = of.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    assert len(filled) == -(-sum(filled.values()) // 1024)


def test_empty(table):
    assert packing.pack_documents(table([]), tokenizer_path()).collect() == []
