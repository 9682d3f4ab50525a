"""Whole runs over temporary trees: scan, cache, plan, apply, undo, history, exports."""

import json
import os
import shutil
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions.errors import BadInput, Canceled, NoPendingPlan, NotConfirmed, PathOutsideRoot, ScanAlreadyRunning, StoreError, WouldDeleteUniqueCopy
from siftstone.operators.inventory import ScanOptions
from siftstone.plans import quarantine
from siftstone.plans.engine import DataPaths, Engine
from siftstone.plans.store import Store
from siftstone.sources.content import files_equal
from siftstone.sources.logs import LogSink
from siftstone.sources.manifest import append_log, csv_cell, read_log, read_manifests

ALL = ScanOptions()


def write(root, **files):
    for name, data in files.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def base_tree(root):
    for n in ("a/one.txt", "b/two.txt", "b/sub/three.txt"):
        put(root, n, b"hello world")
    put(root, "a/unique.txt", b"only one of these")
    put(root, "a/big1.bin", b"\x01" * 4096)
    put(root, "b/big2.bin", b"\x01" * 4096)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    os.makedirs(root)
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "data"))


def listing(root):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs)


def test_scan_rescan_move_and_run(engine, tree, spark):
    base_tree(tree)
    before = listing(tree)
    told = []
    r = engine.run_scan([tree], options=ALL, progress=told.append)
    groups = r.groups().collect()
    assert [(g["copies"], g["wasted_bytes"]) for g in groups] == [(2, 4096), (3, 22)]
    assert r.totals == {"total_files": 6, "duplicate_groups": 2, "total_duplicate_files": 5, "total_wasted_bytes": 4118, "largest_single_file_in_dup": 4096}
    assert listing(tree) == before and not os.path.exists(engine.data.quarantine_dir)
    one = [f for f in r.folders if f["source_root"]][0]
    assert (one["total_discovered"], one["top_level"], one["nested"]) == (3, 2, 1)
    assert r.counters["hashes_computed"] == 6 and [p["phase"] for p in told] == ["inventory", "checking-cache", "hashing", "saving", "done"]

    again = engine.run_scan([tree], options=ALL)
    assert again.counters["hashes_computed"] == 0 and again.counters["hashes_reused"] == 6
    stats = engine.memory_stats()
    assert (stats["files"], stats["distinct_hashes"], stats["duplicate_hashes"], stats["folders"]) == (6, 3, 2, 1)

    # A pure move needs no hashing; a rename is found by its content.
    os.makedirs(f"{tree}/c")
    shutil.move(f"{tree}/a/unique.txt", f"{tree}/c/unique.txt")
    moved = engine.run_scan([tree], options=ALL)
    assert moved.counters["hashes_computed"] == 0 and moved.counters["moved_reused"] == 1
    os.rename(f"{tree}/c/unique.txt", f"{tree}/c/renamed.txt")
    renamed = engine.run_scan([tree], options=ALL)
    row = renamed.files.where("file_name = 'renamed.txt'").first()
    assert row["moved_from"].endswith("c/unique.txt") and row["reused_from_cache"] and renamed.counters["hashes_computed"] == 1
    assert engine.memory_stats()["files"] == 6

    # Plan, rules, overrides.
    plan = engine.get_default_plan().collect()
    assert sum(p["action"] == "keep" for p in plan) == 2 and len(plan) == 5
    keeper = next(p for p in plan if p["action"] == "keep" and p["size"] == 4096)
    with pytest.raises(WouldDeleteUniqueCopy):
        engine.set_plan_action(keeper["normalized_path"], "quarantine")
    assert engine.get_default_plan().where("action = 'keep'").count() == 2
    longest = engine.set_keeper_rule("longest_path").where("action = 'keep' and size = 11").first()
    assert longest["path"].endswith("b/sub/three.txt")
    with pytest.raises(BadInput):
        engine.set_keeper_rule("largest")
    assert engine.preview_plan().count() == 5

    # Exports.
    csv = engine.export_report("csv")
    lines = open(os.path.join(csv["path"], "report.csv"), encoding="utf-8").read().splitlines()
    assert lines[0].startswith("hash,media_kind,group_size_bytes,copies") and len(lines) == 6 and csv["bytes_written"] > 0
    report = json.load(open(engine.export_report("json")["path"], encoding="utf-8"))
    assert len(report["report"]["groups"]) == 2 and report["mode"] == "dry"
    with pytest.raises(BadInput):
        engine.export_report("xml")

    # Apply and undo.
    with pytest.raises(NotConfirmed):
        engine.apply_plan(False)
    done = engine.apply_plan(True)
    assert (done.quarantined, done.failed, done.kept, done.bytes_freed) == (3, 0, 2, 4096 + 22)
    assert sorted(os.listdir(done.output_dir))[0] == "Quarantine-Log.csv" and len(os.listdir(done.output_dir)) == 4
    assert engine.memory_stats()["files"] == 3
    rows = read_manifests(spark, done.manifest_path)
    assert rows.where("status = 'moved'").count() == 3
    with pytest.raises(NoPendingPlan):
        engine.apply_plan(True)
    with pytest.raises(PathOutsideRoot):
        engine.undo_run(engine.data.manifests + "/../../x.json")
    blocked = rows.first()["original_path"]
    put(os.path.dirname(blocked), os.path.basename(blocked), b"new file")
    undone = engine.undo_run(done.manifest_path)
    assert (undone.restored, undone.failed) == (2, 1) and open(blocked, "rb").read() == b"new file"

    # History, folders, logs.
    scans = engine.recent_scans().collect()
    assert [s["id"] for s in scans] == [4, 3, 2, 1] and scans[0]["files_seen"] == 6
    assert engine.peek_folder(tree)["last_file_count"] == 6
    entries, cursor = engine.get_logs(0)
    assert cursor == len(entries) > 0 and engine.get_logs(cursor)[0] == []
    engine.clear_logs()
    assert engine.get_logs(0) == ([], 0)
    engine.forget_folder(tree)
    assert engine.list_remembered_folders().count() == 0 and engine.memory_stats()["files"] == 3
    assert engine.data_paths()["root"] and engine.get_app_info()["name"] == "siftstone"

    # The cache outlives the engine.
    assert Engine(spark, engine.data.root).memory_stats()["files"] == 3


def test_filters_and_counters(engine, tree):
    put(tree, "tiny.jpg", b"x")
    put(tree, "a.jpg", b"\x02" * 5000)
    put(tree, "b.jpg", b"\x02" * 5000)
    put(tree, "Skip/c.jpg", b"\x02" * 5000)
    put(tree, "note.txt", b"text")
    put(tree, ".DS_Store", b"junk")
    put(tree, "node_modules/d.jpg", b"\x02" * 5000)
    put(tree, "movie.MOV", b"\x03" * 10)
    r = engine.run_scan([tree], options=ScanOptions.interactive(min_size=2, exclude=["/SKIP/"]))
    assert r.totals["duplicate_groups"] == 1 and r.totals["total_files"] == 3
    c = r.counters
    assert (c["photos"], c["videos"], c["unsupported_files"], c["files_walked"], c["files_skipped"]) == (4, 1, 1, 3, 4)
    folders = [f for f in r.folders if f["source_root"]][0]
    assert (folders["total_discovered"], folders["pruned"], folders["scanned"]) == (2, 1, 1)
    tree_map = {x["name"]: x["file_count"] for x in r.folder_map().collect()}
    assert tree_map["Skip"] == 1 and tree_map["tree"] == 6  # before filters; pruned contents aren't read
    whole = engine.run_scan([tree], options=ScanOptions.interactive(skip_dev_dirs=False, media_only=False), commit_results=False)
    assert whole.totals["total_files"] == 7 and engine.get_last_results() is r


def test_content_not_names_decides(engine, tree):
    put(tree, "x/clip1.mp4", b"H" * 100 + b"1" + b"T" * 100)
    put(tree, "y/clip2.mp4", b"H" * 100 + b"2" + b"T" * 100)
    put(tree, "e1.txt", b"")
    put(tree, "e2.txt", b"")
    r = engine.run_scan([tree], options=ALL)
    assert r.totals["duplicate_groups"] == 1 and r.totals["total_wasted_bytes"] == 0  # the empty ones
    assert r.counters["hashes_computed"] == 4


def test_hardlinks_overlapping_roots_and_unicode(engine, tree):
    put(tree, "a/original.txt", b"linked")
    os.link(f"{tree}/a/original.txt", f"{tree}/a/link.txt")
    name = "café.txt"
    put(tree, name, b"unicode")
    r = engine.run_scan([tree, f"{tree}/a"], options=ALL)
    plan = engine.get_default_plan().collect()
    assert all(p["action"] == "keep" for p in plan) and len(plan) == 4
    row = r.files.where("normalized_path like '%café.txt'").first()
    assert row["file_name"] == name  # the name stays as it is, the stored path is composed


def test_same_name_at_a_live_path_is_hashed_again(engine, tree):
    a = put(tree, "one/photo.jpg", b"AAAA")
    engine.run_scan([tree], options=ALL)
    b = put(tree, "two/photo.jpg", b"BBBB")
    os.utime(b, ns=(os.stat(a).st_atime_ns, os.stat(a).st_mtime_ns))
    r = engine.run_scan([tree], options=ALL)
    assert r.totals["duplicate_groups"] == 0 and r.counters["hashes_computed"] == 1 and r.counters["stale_ignored"] == 1


def test_two_copies_compete_for_one_stale_row(engine, tree):
    put(tree, "old.txt", b"same bytes")
    engine.run_scan([tree], options=ALL)
    os.remove(f"{tree}/old.txt")
    put(tree, "n1.txt", b"same bytes")
    put(tree, "n2.txt", b"same bytes")
    r = engine.run_scan([tree], options=ALL)
    came = {x["file_name"]: x["moved_from"] for x in r.files.collect()}
    assert came["n1.txt"].endswith("old.txt") and came["n2.txt"] is None and engine.memory_stats()["files"] == 2


def test_duplicate_dirs_and_rules(engine, tree):
    for d in ("p", "q"):
        put(tree, f"{d}/x.txt", b"xx")
        put(tree, f"{d}/y.txt", b"yy")
    os.utime(f"{tree}/p/x.txt", (100, 100))
    os.rename(f"{tree}/p", f"{tree}/p_a_longer_name")
    r = engine.run_scan([tree], options=ALL)
    d = r.duplicate_dirs().collect()
    assert len(d) == 1 and len(d[0]["dirs"]) == 2 and d[0]["file_count"] == 2 and d[0]["wasted_bytes"] == 4
    keeps = lambda rule: {p["path"] for p in engine.set_keeper_rule(rule).where("action = 'keep'").collect()}
    assert f"{tree}/p_a_longer_name/x.txt" in keeps("oldest") and f"{tree}/q/x.txt" in keeps("shortest_path")
    assert f"{tree}/q/x.txt" in keeps("newest")
    assert engine.compare_folders(f"{tree}/p_a_longer_name", f"{tree}/q").where("n_roots = 2").count() == 2


def test_apply_refuses_changed_and_missing_files(engine, tree):
    for i, n in enumerate(("k.txt", "v1.txt", "v22.txt", "v333.txt")):
        put(tree, f"d{i}/{n}", b"original bytes")
    engine.run_scan([tree], options=ALL)
    put(tree, "d1/v1.txt", b"changed! bytes")
    os.remove(f"{tree}/d2/v22.txt")
    done = engine.apply_plan(True)
    assert (done.quarantined, done.failed) == (1, 2)
    log = read_log(done.output_dir)
    assert sorted(e["status"] for e in log) == ["failed", "moved", "skipped"]


def test_cancel_leaves_the_rest(engine, tree):
    for i in range(3):
        put(tree, f"f{i}/same.txt", b"copy")
    engine.run_scan([tree], options=ALL)
    asked = iter([False, True])
    done = engine.apply_plan(True, canceled=lambda: next(asked))
    assert (done.quarantined, done.not_processed, done.canceled) == (1, 1, True)


def test_names_never_clash(tmp_path):
    out = str(tmp_path)
    put(out, "dup.jpg", b"there already")
    used = set()
    assert [os.path.basename(quarantine.free_name(out, p, used)) for p in ("/a/dup.jpg", "/b/dup.jpg", "/c/dup_2.jpg", "/d/Makefile", "/e/Makefile", "/f/.hid", "/g/.hid")] == [
        "dup_2.jpg", "dup_3.jpg", "dup_2_2.jpg", "Makefile", "Makefile_2", ".hid", ".hid_2",
    ]


@pytest.mark.parametrize("actions,lost", [([], False), ([("a", "keep")], False), ([("a", "keep"), ("a", "quarantine")], False), ([("a", "quarantine")], True), ([("a", "keep"), ("b", "quarantine")], True)])
def test_plan_check(actions, lost):
    rows = [{"hash": h, "action": a} for h, a in actions]
    if lost:
        with pytest.raises(WouldDeleteUniqueCopy):
            quarantine.check_plan(rows)
    else:
        quarantine.check_plan(rows)


def test_gates(engine, tree):
    for call in (engine.get_default_plan, lambda: engine.set_keeper_rule("oldest"), lambda: engine.export_report("csv"), engine.find_similar_videos):
        with pytest.raises(NoPendingPlan):
            call()
    with pytest.raises(BadInput):
        engine.run_scan([])
    with pytest.raises(BadInput):
        engine.run_scan([tree], mode="maybe")
    engine._busy.acquire()
    with pytest.raises(ScanAlreadyRunning):
        engine.run_scan([tree])
    engine._busy.release()


def test_canceled_scan_is_closed_with_zeros(engine, tree):
    base_tree(tree)
    with pytest.raises(Canceled):
        engine.run_scan([tree], options=ALL, progress=lambda p: engine.cancel_scan())
    row = engine.recent_scans().first()
    assert row["ended_ts"] and row["files_seen"] == 0 and engine.memory_stats()["files"] == 0
    assert engine.run_scan([tree], options=ALL).totals["total_files"] == 6


def test_missing_root_is_an_error_not_a_failure(engine, tree):
    put(tree, "a.txt", b"a")
    r = engine.run_scan([tree, tree + "/none"], options=ALL)
    assert r.counters["errors"] >= 1 and r.totals["total_files"] == 1


def test_canceling_stops_the_jobs_of_a_scan(engine, tree, monkeypatch):
    from siftstone.plans import engine as module

    def slow(files, digest, done=None):
        def wait(batches):
            for pdf in batches:
                time.sleep(60)
                yield pdf

        return files.select("path").mapInPandas(wait, "path string")

    put(tree, "a.txt", b"a")
    monkeypatch.setattr(module, "hash_files", slow)
    threading.Timer(4, engine.cancel_scan).start()
    began = time.time()
    with pytest.raises(Canceled):
        engine.run_scan([tree], options=ALL)
    assert time.time() - began < 40
    monkeypatch.undo()
    assert engine.run_scan([tree], options=ALL).totals["total_files"] == 1


def test_progress_within_hashing(engine, tree):
    for k in range(40):
        put(tree, f"{k}.txt", str(k).encode())
    told = []
    engine.run_scan([tree], options=ALL, progress=told.append)
    steps = [p for p in told if p["phase"] == "hashing"]
    assert steps and all(0 <= p["percent"] <= 100 and p["total"] == 40 for p in steps) and [p["processed"] for p in steps] == sorted(p["processed"] for p in steps)


def test_a_second_writer_loses_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a = Store(spark, root)
    b = Store(spark, root)
    handed = a.read("scans")
    a.start_scan("dry", ["/x"], "t")
    seen = a.read("scans")
    with pytest.raises(StoreError):
        b.start_scan("dry", ["/y"], "t")
    assert [r["roots"] for r in b.read("scans").collect()] == [["/x"]] and handed.count() == 0
    assert b.start_scan("dry", ["/y"], "t") == 2
    b.finish_scan(1, "end")
    assert seen.count() == 1 and b.read("scans").where("ended_ts = 'end'").count() == 1  # frames over earlier states can still be read
    for k in range(6):
        b.finish_scan(2, f"end {k}")
    assert len([f for f in os.listdir(f"{tmp_path}/store/scans")]) <= 5 and Store(spark, root).read("scans").count() == 2


def test_legacy_store_is_purged(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = Store(spark, root)
    s.start_scan("dry", ["/x"], "t")
    s.replace({"files": spark.createDataFrame([(1, "p:abc", "/x", "/x", "x", "/", 1, 1, "t", "t", 1)], s.read("files").schema)}, version=2)
    again = Store(spark, root)
    assert again.state["version"] == 3 and again.read("files").count() == 0 and again.read("scans").count() == 0
    again.replace({}, version=9)
    with pytest.raises(Exception, match="version 9"):
        Store(spark, root)


def test_similar_videos_for_review_only(engine, tree):
    for n in ("a.mp4", "b.mp4", "c.mp4"):
        put(tree, n, n.encode())
    engine.run_scan([tree], options=ALL)
    rng = np.random.default_rng(5)
    films = [rng.integers(0, 255, (8, 40, 40)).astype(np.uint8) for _ in range(2)]
    np.save(os.path.join(tree, "films.npy"), np.stack(films))
    store = os.path.join(tree, "films.npy")

    def frame(path, seconds):
        films = np.load(store)
        k = 1 if path.endswith("c.mp4") else 0
        image = films[k][int(seconds)]
        return np.rot90(image) if path.endswith("b.mp4") else image

    got = engine.find_similar_videos(frame=frame, duration=lambda p: 8.0)
    assert (got["considered"], got["fingerprinted"], got["failed"]) == (3, 3, 0)
    assert [os.path.basename(r["path"]) for r in got["members"].orderBy("path").collect()] == ["a.mp4", "b.mp4"]
    assert got["clusters"].first()["avg_distance"] == 0.0
    assert engine.get_default_plan().count() == 0
    with pytest.raises(BadInput):
        engine.find_similar_videos(max_distance=40)


def test_logs_and_csv(tmp_path):
    sink = LogSink(str(tmp_path / "l.jsonl"), ring=3)
    for i in range(5):
        sink.info(str(i))
    rows, cursor = sink.tail(0)
    assert [r["message"] for r in rows] == ["2", "3", "4"] and cursor == 5 and sink.tail(4)[0][0]["message"] == "4"
    m = {"entries": [{"moved_ts": "t", "status": "moved", "original_path": "=a,b", "quarantine_path": "q", "size": 1, "hash": "h", "reason": None}]}
    append_log(str(tmp_path), m)
    append_log(str(tmp_path), m)
    assert [r["original_path"] for r in read_log(str(tmp_path))] == ["'=a,b"] * 2
    assert csv_cell("a\rb") == "a\rb" and csv_cell(None) == ""
    a, b = put(str(tmp_path), "x", b"1" * 70000), put(str(tmp_path), "y", b"1" * 69999 + b"2")
    assert files_equal(a, a) and not files_equal(a, b)


def test_links_are_followed_on_request(spark, tree):
    from siftstone.sources.inventory import read_inventory

    put(tree, "real/f.txt", b"x")
    os.symlink(f"{tree}/real", f"{tree}/loop")
    os.symlink(tree, f"{tree}/real/up")
    plain = read_inventory(spark, [tree])
    assert sorted(r["file_name"] for r in plain.where("not is_dir").collect()) == ["f.txt"] and plain.where("is_dir").count() == 2
    assert read_inventory(spark, [tree], follow_symlinks=True).where("not is_dir").count() >= 2
    assert plain.where(F.col("modified_ns") > 0).count() == 3


def test_data_paths_default(tmp_path):
    d = DataPaths(str(tmp_path / "x"))
    assert os.path.isdir(d.manifests) and not os.path.exists(d.quarantine_dir)
