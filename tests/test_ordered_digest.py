import hashlib

import numpy as np

from evenspan.operators import ordered_digest as od


def test_chain_equals_hashlib():
    data = [b"", b"a", bytes(range(256)) * 3, b"x" * 63, b"y" * 64, b"z" * 65]
    want = hashlib.sha256()
    chain = od.Chain()
    assert chain.hexdigest() == want.hexdigest()
    for x in data:
        chain = od.Chain(chain.state())
        chain.update(x)
        want.update(x)
        assert chain.hexdigest() == want.hexdigest()


def test_source_tree(spark):
    rows = [(f"src/é{i % 7}/f_{i}.py", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(200)] + [("Z", "0" * 64)]
    want = hashlib.sha256()
    for path, sha in sorted(rows, key=lambda r: r[0].encode()):
        want.update(path.encode() + b"\0" + sha.encode() + b"\n")
    got = od.source_tree_receipt(spark.createDataFrame(rows, "path string, sha256 string").repartition(5))
    assert got == {"algorithm": "sha256(path NUL file_sha256 LF)", "source_tree_sha256": want.hexdigest(), "files": 201}
    assert od.source_tree_receipt(spark.createDataFrame([], "path string, sha256 string"))["source_tree_sha256"] == hashlib.sha256().hexdigest()


def test_tensors(spark):
    tensors = {"b": np.arange(30, dtype="int64").reshape(5, 6), "a.weight": np.ones((2, 3), "float32"), "empty": np.zeros((0, 4), "int64")}
    want, heads, pieces = hashlib.sha256(), [], []
    for name in sorted(tensors):
        t = tensors[name]
        want.update(name.encode() + str(t.dtype).encode() + str(tuple(t.shape)).encode() + t.tobytes())
        heads.append((name, str(t.dtype), str(tuple(t.shape))))
        raw = t.tobytes()
        pieces += [(name, i, raw[at : at + 7]) for i, at in enumerate(range(0, len(raw), 7))]
    got = od.tensor_digest(spark.createDataFrame(heads, "name string, dtype string, shape string"), spark.createDataFrame(pieces, "name string, i int, data binary").repartition(4))
    assert got == want.hexdigest()
