"""The cache's base, deltas, touches and history against a plain model."""

import os
import random

import pytest

from siftstone.operators import cache
from siftstone.plans import store as module
from siftstone.plans.store import Store

SEEN = "hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long"


def seen_rows(files):
    return [(h, p, p, os.path.basename(p), root, size, size) for p, (root, h, size) in sorted(files.items())]


def scan(spark, s, files, scan_id, roots):
    now = f"t{scan_id}"
    after = cache.upsert_files(s.read("files"), spark.createDataFrame(seen_rows(files), SEEN), scan_id, now)
    s.save_scan(after, scan_id, now, roots)


def written(tmp_path, *tables):
    return sum(os.path.getsize(os.path.join(d, f)) for t in tables for d, _, fs in os.walk(f"{tmp_path}/store/{t}") for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("deltas", [1, 3, 99])
def test_versions_against_a_model(spark, tmp_path, monkeypatch, deltas):
    monkeypatch.setattr(module, "DELTAS", deltas)
    if deltas == 99:
        monkeypatch.setattr(Store, "_bytes", lambda self, table: 0)
    rng = random.Random(deltas)
    s = Store(spark, f"file://{tmp_path}/store")
    disk = {f"/{r}/f{i}": (f"/{r}", f"h{i}", i) for r in "ab" for i in range(12)}
    model, snapshots = {}, {}
    for turn in range(1, 8):
        for p in rng.sample(sorted(disk), min(3, len(disk))):
            disk[p] = (disk[p][0], f"{disk[p][1]}x", disk[p][2] + 1) if rng.random() < 0.5 else disk[p]
            if rng.random() < 0.3:
                del disk[p]
        if turn > 3:
            disk[f"/a/f{turn}"] = ("/a", "back", turn)
        roots = rng.choice([["/a"], ["/b"], ["/a", "/b"]])
        files = {p: v for p, v in disk.items() if v[0] in roots}
        id_ = s.start_scan("dry", roots, f"t{turn}")
        scan(spark, s, files, id_, roots)
        for p, v in files.items():
            first = model[p][3] if p in model else f"t{turn}"
            model[p] = (*v, first, f"t{turn}", id_)
            snapshots[id_, p] = v
        if turn in (3, 6):
            gone = rng.sample(sorted(model), 3)
            s.delete_paths(gone)
            for p in gone:
                model.pop(p)
                disk.pop(p, None)
                snapshots = {k: v for k, v in snapshots.items() if k[1] != p}
        got = {r["normalized_path"]: (r["source_root"], r["hash"], r["size"], r["first_seen_ts"], r["last_seen_ts"], r["last_scan_id"]) for r in s.read("files").collect()}
        assert got == model
        assert s.read("files").select("id").distinct().count() == len(model)
        assert sorted(((r["scan_id"], r["normalized_path"]), (r["source_root"], r["hash"], r["size"])) for r in s.read("scan_files").collect()) == sorted(snapshots.items())
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.read("files").count() == len(model) and (deltas != 1 or not again.state["tables"]["deltas"])


def test_a_rescan_writes_what_changed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    n = 20_000
    files = {f"/a/folder{i % 97}/a file of some name {i}.jpg": ("/a", f"{i * 2654435761 % (1 << 64):064x}", i) for i in range(n)}
    scan(spark, s, files, s.start_scan("dry", ["/a"], "t"), ["/a"])
    first = written(tmp_path, "files", "deltas", "history", "touches", "scan_files")
    for p in sorted(files)[:: n // 200]:
        files[p] = ("/a", "f" * 64, 1)
    scan(spark, s, files, s.start_scan("dry", ["/a"], "t"), ["/a"])
    more = written(tmp_path, "files", "deltas", "history", "touches", "scan_files") - first
    changed = s._held("deltas").count()
    assert changed in (200, 201) and more < first / 20  # 1 % of the rows; a file's footer weighs here
    assert s.read("scan_files").where("scan_id = 2").count() == n == s.read("scan_files").where("scan_id = 1").count()
    assert s.read("files").where("last_scan_id = 2").count() == n


def test_a_store_of_plain_tables_is_read(spark, tmp_path):
    """States written before there were deltas: no op, and what scans saw as a table."""
    s = Store(spark, f"file://{tmp_path}/store")
    one = [(1, "h", "/a/x", "/a/x", "x", "/a", 1, 1, "t", "t", 1)]
    where = f"file://{tmp_path}/store/files/old"
    spark.createDataFrame(one, module.TABLES["files"]).write.parquet(where)
    seen = f"file://{tmp_path}/store/scan_files/old"
    spark.createDataFrame([(1, "h", "/a/x", "/a/x", "x", "/a", 1, 1)], module.TABLES["scan_files"]).write.parquet(seen)
    s._commit({"version": 3, "tables": {"files": [where], "scan_files": [seen]}})
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("files").count() == 1 and s.read("scan_files").count() == 1
    scan(spark, s, {"/a/x": ("/a", "h", 1), "/a/y": ("/a", "k", 2)}, 2, ["/a"])
    assert {(r["normalized_path"], r["last_scan_id"]) for r in s.read("files").collect()} == {("/a/x", 2), ("/a/y", 2)}
    assert sorted((r["scan_id"], r["normalized_path"]) for r in s.read("scan_files").collect()) == [(1, "/a/x"), (2, "/a/x"), (2, "/a/y")]
    s.delete_paths(["/a/x"])
    assert [(r["scan_id"], r["normalized_path"]) for r in s.read("scan_files").collect()] == [(2, "/a/y")]
