import hashlib
import random
import zlib
from bisect import bisect_right

import pyarrow.parquet as pq
import pytest

from evenspan.llm import keyed_upsert, queries

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double, home int, action string, new_city string, count long"


def crc(x):
    return zlib.crc32(str(x).encode())


def plain(clients, changes, size=None):
    """first_id, n_rows, cents, rows_crc, ids_sha256, rewritten of each file: clients and changes as dicts."""
    m = size or 1 + len(clients) // 1500
    start = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[i : i + m] for i in range(0, len(start), m)]
    if not files:
        return []
    fences = [f[0]["client_id"] for f in files]
    best = {}
    for c in changes:
        if c["client_id"] is not None:
            k = tuple((x is not None, x or 0) for x in (c["seq"], c["change_id"]))
            if c["client_id"] not in best or k > best[c["client_id"]][0]:
                best[c["client_id"]] = k, c
    homes = [{c["client_id"]: dict(c) for c in f} for f in files]
    for i, (_, c) in best.items():
        at = max(0, bisect_right(fences, i) - 1)
        h = crc(fences[at]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            homes[at].pop(i, None)
        else:
            row = homes[at].setdefault(i, dict.fromkeys(clients[0]) | {"client_id": i})
            row.update({k: c[k] for k in ("source", "segment", "city", "balance")})
    out = []  # rows, rewritten
    for f, home in zip(files, homes):
        rows = [home[i] for i in sorted(home)]
        if rows == f:
            out.append([f, False])
            continue
        k = -(-len(rows) // m)
        sizes = [len(rows) // k + (j < len(rows) % k) for j in range(k)]
        for n in sizes:
            out.append([rows[:n], True])
            rows = rows[n:]
    final = []
    for rows, new in out:
        if new and final and final[-1][1] and len(final[-1][0]) + len(rows) <= m:
            final[-1][0] = final[-1][0] + rows
        else:
            final.append([rows, new])
    return [digest(rows, new) for rows, new in final]


def digest(rows, new):
    cents = sum(0 if r["balance"] is None else int((100 * r["balance"] + 0.5) // 1) for r in rows)
    sums = sum(crc("|".join(r[k] or "" for k in ("source", "segment", "city"))) for r in rows)
    return rows[0]["client_id"], len(rows), cents, sums, hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(), new


def made(seed, n, changed, top, nulls=True):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None])
    clients = [dict(zip([c.split()[0] for c in CLIENTS.split(", ")], (i, i, pick("a", "b"), None, "n", "e", pick("x", "ö"), 3, pick("s"), pick(0.125, -7.5, 3.0)))) for i in rng.sample(range(top), n)]
    known = rng.sample(range(top), changed) if changed else []
    changes = []
    for j in range(changed * 3):
        i = rng.choice(known) if rng.random() < 0.6 else known[0]  # one key has a third of all
        changes.append({"change_id": j, "client_id": i, "seq": rng.randrange(5), "op": pick("U", "U", "I", "D"), "source": pick("a", "b"), "segment": pick("s"), "city": pick("x", "ö"), "balance": pick(0.125, 3.0)})
    changes += changes[: len(changes) // 10]  # repeated rows
    if nulls:
        clients.append(dict.fromkeys(clients[0]) if clients else dict.fromkeys([c.split()[0] for c in CLIENTS.split(", ")]))
        changes += [dict.fromkeys(changes[0]) if changes else {}, *({**c, "seq": None} for c in changes[:3]), *({**c, "change_id": None, "seq": 9 + j} for j, c in enumerate(changes[3:5]))]
    return clients, changes


def frames(spark, clients, changes):
    rows = [tuple(c.get(f.split()[0]) for f in CLIENTS.split(", ")) for c in clients]
    more = [tuple({**c, "home": 1, "action": "x", "new_city": "z", "count": 3}.get(f.split()[0]) for f in CHANGES.split(", ")) for c in changes]
    return spark.createDataFrame(rows, CLIENTS), spark.createDataFrame(more, CHANGES)


def run(spark, tmp_path, clients, changes):
    for name, df in zip(("clients", "client_changes"), frames(spark, clients, changes)):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return queries.op13_copy_on_write_keyed_upsert(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("n,changed,top", [(1000, 300, 1500), (4000, 900, 4200), (1600, 1, 1700), (30, 400, 5000)])
def test_equals_plain(spark, tmp_path, n, changed, top):
    clients, changes = made(n, n, changed, top)
    got = sorted(run(spark, tmp_path, clients, changes))
    assert [tuple(r[k] for k in ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "rewritten")) for r in got] == plain(clients, changes)
    folder = got[0]["path"].split("evenspan_file=")[0].removeprefix("file:")
    import pathlib

    files = {str(p) for p in pathlib.Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
    assert files == {"/" + r["path"].removeprefix("file:").lstrip("/") for r in got}  # no other data file remains
    for r in got[:: max(1, len(got) // 20)]:
        t = pq.ParquetFile("/" + r["path"].removeprefix("file:").lstrip("/")).read()
        ids = t.column("client_id").to_pylist()
        assert ids == sorted(ids) and ids[0] == r["first_id"]
        assert ",".join(t.column_names) == r["columns"] == ",".join(c.split()[0] for c in CLIENTS.split(", "))


def test_untouched_files_stay(spark, tmp_path):
    clients, changes = made(5, 3000, 40, 3000)
    table = keyed_upsert.cut(frames(spark, clients, changes)[0], "client_id", 100, f"{tmp_path}/t")
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    replaced = keyed_upsert.upsert(spark, table, frames(spark, clients, changes)[1], ["seq"], ["city"], lambda first: keyed_upsert.F.when(first < 1000, "S"))
    now = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert replaced and max(replaced) <= 10
    assert {p for p in stamp if p in now} == {p for p in stamp if int(p.parent.name[-9:]) not in replaced}
    assert all(now[p] == stamp[p] for p in stamp if p in now)


def test_empty(spark, tmp_path):
    clients, changes = made(1, 100, 20, 200)
    for i, (a, b) in enumerate((([], changes), (clients, []), ([], []))):
        (tmp_path / str(i)).mkdir()
        got = run(spark, tmp_path / str(i), a, b)
        assert [r["rewritten"] for r in got] == [False] * len(got)
        assert sorted(r["first_id"] for r in got) == [x[0] for x in plain(a, b)]


def test_small_files_join(tmp_path):
    assert keyed_upsert.laid_out({0: 3, 1: 2, 3: 2, 4: 0, 5: 2, 6: 11}, 7, 5) == ([1, 1, 0, 1, 0, 1, 3], ["w000000000-000000000"] * 2 + ["", "w000000003-000000000", "", "w000000003-000000000", "w000000006-000000000"])
    assert all(sum(sorted([n // k + (j < n % k) for j in range(k)])[:2]) > m for m in range(1, 40) for n in range(m + 1, 400) for k in [-(-n // m)])
