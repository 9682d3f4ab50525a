"""Moves from executors: names, journals, attempts that go on, runs that broke off."""

import json
import os

import pytest

from siftstone.functions import constants as K
from siftstone.operators import dedupe
from siftstone.plans import quarantine
from siftstone.sources.logs import LogSink
from siftstone.sources.manifest import Journal, journal_folder, journal_steps, load_manifest, read_log, read_manifests, write_manifest

PLAN = "hash string, path string, normalized_path string, size long, action string, reason string"


@pytest.fixture
def place(tmp_path):
    for d in ("in", "out", "manifests"):
        (tmp_path / d).mkdir()
    return tmp_path


def put(path, data=b"same"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def victim(path, keeper=None, k=1):
    return {"hash": "h", "path": path, "normalized_path": path, "size": 4, "name": os.path.basename(path), "k": k, "keeper": keeper}


def test_a_run_of_many_tasks(spark, place, monkeypatch):
    """Equal names in many folders, taken names, hot hash, files that changed or went."""
    monkeypatch.setattr(quarantine, "BUCKET_FILES", 7)
    rows = [("hot", put(f"{place}/in/d{i}/dup.jpg"), "keep" if i == 0 else "quarantine") for i in range(60)]
    rows += [(f"h{i}", put(f"{place}/in/{x}{i}/f{i}.txt", b"%d" % i), a) for i in range(10) for x, a in (("p", "keep"), ("q", "quarantine"))]
    put(f"{place}/out/dup.jpg", b"there already")
    put(f"{place}/in/d7/dup.jpg", b"diff")
    os.remove(f"{place}/in/d9/dup.jpg")
    plan = spark.createDataFrame([(h, p, p, 4, a, "") for h, p, a in rows], PLAN)
    logs = LogSink()
    done = quarantine.run(plan, f"{place}/out", f"{place}/manifests", logs)
    assert (done.quarantined, done.failed, done.kept, done.bytes_freed, done.canceled) == (67, 2, 11, 4 * 67, False)
    held = sorted(os.listdir(f"{place}/out"))
    assert len(held) == 67 + 2 and open(f"{place}/out/dup.jpg", "rb").read() == b"there already"
    assert {f"dup_{k}.jpg" for k in range(2, 59)} <= set(held) and not any(os.path.getsize(f"{place}/out/{f}") == 0 for f in held)
    m = json.load(open(done.manifest_path, encoding="utf-8"))
    assert [(e["hash"], e["original_path"]) for e in m["entries"]] == sorted((h, p) for h, p, a in rows if a == "quarantine")
    assert set(m) == {"run_id", "started_ts", "mode", "entries"} and not os.path.exists(journal_folder(done.manifest_path))
    assert {e["status"] for e in m["entries"] if "/d7/" in e["original_path"]} == {"failed"} and {e["status"] for e in m["entries"] if "/d9/" in e["original_path"]} == {"skipped"}
    assert read_manifests(spark, done.manifest_path).where("status = 'moved'").count() == 67 == done.moved.count()
    assert len(read_log(f"{place}/out")) == 69 and any(e["message"].startswith("QUARANTINED") for e in logs.tail()[0])
    undone = quarantine.undo(done.manifest_path, logs)
    assert (undone.restored, undone.failed) == (67, 0) and all(os.path.exists(p) for _, p, _ in rows if "/d9/" not in p)


def test_a_canceled_run_leaves_the_rest(spark, place):
    plan = spark.createDataFrame([("h", put(f"{place}/in/{i}/a"), f"{place}/in/{i}/a", 4, "quarantine" if i else "keep", "") for i in range(5)], PLAN)
    seen = []
    done = quarantine.run(plan, f"{place}/out", f"{place}/manifests", LogSink(), lambda: bool(seen.append(1)) or True)
    assert done.quarantined + done.not_processed == 4 and seen
    assert done.quarantined == 4 or done.canceled
    assert sum(os.path.exists(f"{place}/in/{i}/a") for i in range(5)) == 1 + done.not_processed


def test_an_attempt_goes_on_where_the_last_one_ended(place):
    folder, out = f"{place}/manifests/run.journal", f"{place}/out"
    keeper = put(f"{place}/in/keep")
    a, b, c, d = (put(f"{place}/in/{x}/n.txt") for x in "abcd")
    first = Journal(folder, 3)
    assert quarantine.apply_one(victim(a, keeper), out, first)["quarantine_path"] == f"{out}/n.txt"
    # b: claimed and noted, not moved; c: moved, not noted as done; d: nothing yet.
    for path, moved in ((b, False), (c, True)):
        target = quarantine.claim(out, "n.txt")
        first.write({"path": path, "state": "moving", "entry": quarantine._entry(victim(path), "moved", target)})
        if moved:
            quarantine.move(path, target)
    first.file.write('{"path": "' + d)  # cut off
    first.close()
    known = journal_steps(folder, 3)
    assert {p: s["state"] for p, s in known.items()} == {a: "done", b: "moving", c: "moving"} and journal_steps(folder, 4) == {}
    second = Journal(folder, 3)
    entries = [quarantine.apply_one(victim(p, keeper), out, second, known.get(p)) for p in (a, b, c, d)]
    second.close()
    assert [e["status"] for e in entries] == ["moved"] * 4
    assert [os.path.basename(e["quarantine_path"]) for e in entries] == ["n.txt", "n_2.txt", "n_3.txt", "n_4.txt"] and len(os.listdir(out)) == 4
    assert all(open(e["quarantine_path"], "rb").read() == b"same" for e in entries) and not any(os.path.exists(p) for p in (a, b, c, d))
    again = [quarantine.apply_one(victim(p, keeper), out, Journal(folder, 3), s) for p, s in journal_steps(folder, 3).items()]
    assert sorted(e["quarantine_path"] for e in again) == sorted(e["quarantine_path"] for e in entries)


def test_a_run_that_broke_off_can_be_undone(place):
    """The driver ended before the manifest was put together."""
    path = f"{place}/manifests/run.json"
    write_manifest(path, {"run_id": "run", "started_ts": "t", "mode": "quarantine", "entries": []})
    a, b, c = (put(f"{place}/in/{x}") for x in "abc")
    journal = Journal(journal_folder(path), 0)
    quarantine.apply_one(victim(a), f"{place}/out", journal)
    for p, moved in ((b, True), (c, False)):
        target = quarantine.claim(f"{place}/out", os.path.basename(p))
        journal.write({"path": p, "state": "moving", "entry": quarantine._entry(victim(p), "moved", target)})
        if moved:
            quarantine.move(p, target)
    journal.close()
    assert sorted(e["original_path"] for e in load_manifest(path)["entries"]) == [a, b]
    undone = quarantine.undo(path, LogSink())
    assert (undone.restored, undone.failed) == (2, 0) and all(open(p, "rb").read() == b"same" for p in (a, b, c))


def test_a_move_that_fails_gives_its_name_back(place):
    journal = Journal(f"{place}/manifests/run.journal", 0)
    folder = f"{place}/in/folder"
    put(f"{folder}/x")
    e = quarantine.apply_one(victim(folder), f"{place}/out", journal)  # a folder can't take a file's place
    assert e["status"] == "failed" and e["reason"].startswith(K.REASON_MOVE) and os.listdir(f"{place}/out") == [] and os.path.exists(f"{folder}/x")


def test_a_move_that_cannot_be_noted_is_taken_back(place, monkeypatch):
    journal = Journal(f"{place}/manifests/run.journal", 0)
    a, write = put(f"{place}/in/a"), journal.write

    def full(step):
        if step["state"] == "done":
            raise OSError(28, "No space left on device")
        write(step)

    monkeypatch.setattr(journal, "write", full)
    with pytest.raises(OSError):
        quarantine.apply_one(victim(a), f"{place}/out", journal)
    assert open(a, "rb").read() == b"same" and not os.path.lexists(f"{place}/out/a")


def test_plans_of_rules_are_victims(spark):
    files = spark.createDataFrame([("h", f"/r/{x}/n", f"/r/{x}/n", "n", "/r", 1, i, 1, i) for i, x in enumerate(["b", "a", "cc"])], "hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long, dev long, ino long")
    got = quarantine.victims(dedupe.plan(files, "shortest_path")).collect()
    assert sorted((r["path"], r["k"], r["keeper"]) for r in got) == [("/r/b/n", 1, "/r/a/n"), ("/r/cc/n", 2, "/r/a/n")]
