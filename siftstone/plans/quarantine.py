"""Applying a plan to files, and undoing it.

Planning and checking are queries, and files are moved by the executors, each task with a
journal of its own.  No last copy is moved, every victim is compared with the copy that stays, nothing is overwritten.
"""

from __future__ import annotations

import errno
import os
import shutil
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions.errors import WouldDeleteUniqueCopy
from siftstone.operators.reports import numbered_victims
from siftstone.sources.content import files_equal
from siftstone.sources.logs import LogSink, now
from siftstone.sources.manifest import Journal, append_log, journal_folder, journal_steps, load_manifest, write_manifest, write_run
from siftstone.sources.scratch import cut


@dataclass
class ApplyResult:
    run_id: str
    manifest_path: str
    output_dir: str
    quarantined: int = 0
    failed: int = 0
    bytes_freed: int = 0
    kept: int = 0
    canceled: bool = False
    not_processed: int = 0
    moved: list[str] | DataFrame = field(default_factory=list)  # normalized paths


@dataclass
class UndoResult:
    run_id: str
    restored: int = 0
    failed: int = 0


def check_plan(rows: Iterable[dict]) -> None:
    kept, victims = set(), set()
    for r in rows:
        (kept if r["action"] == "keep" else victims).add(r["hash"])
    lost = sorted(victims - kept)
    if lost:
        raise WouldDeleteUniqueCopy(lost[0])


def split_name(name: str) -> tuple[str, str]:
    """Stem and extension with its dot; a dot that is first or last makes none."""
    at = name.rfind(".")
    return (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")


def free_name(folder: str, source: str, used: set[str]) -> str:
    """The source's name, or with the first number from 2 that neither this run nor a file in the folder has."""
    name = os.path.basename(source.rstrip("/")) or "file"
    stem, ext = split_name(name)
    n, candidate = 1, name
    while candidate in used or os.path.lexists(os.path.join(folder, candidate)):
        n += 1
        candidate = f"{stem}_{n}{ext}"
    used.add(candidate)
    return os.path.join(folder, candidate)


def move(source: str, target: str) -> None:
    try:
        os.rename(source, target)
    except OSError as e:
        if e.errno != errno.EXDEV:
            raise
        part = target + ".part"
        shutil.copy2(source, part)
        os.replace(part, target)
        os.remove(source)


def claim(folder: str, name: str, number: int = 1) -> str:
    """An empty file of the name, or with the first free number from ``number`` on: made by the
    file system if and only if it isn't there, so of any number of tasks one gets a name."""
    stem, ext = split_name(name)
    while True:
        path = os.path.join(folder, name if number == 1 else f"{stem}_{number}{ext}")
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))
            return path
        except FileExistsError:
            number += 1


def _entry(r: dict, status: str, at: str = "", reason: str | None = None) -> dict:
    return {"hash": r["hash"], "original_path": r["path"], "quarantine_path": at, "size": r["size"], "moved_ts": now(), "status": status, "reason": reason}


def apply_one(r: dict, out_dir: str, journal: Journal, before: dict | None = None, canceled: bool = False) -> dict:
    """Move one victim (hash, path, size, keeper, name, k), or say why not: its entry.

    A name is claimed, the journal says what goes where, and then the file moves.  ``before``
    is the last step that an earlier attempt noted: what it did isn't done again, and what it began goes on to the
    name it had claimed, so nothing is overwritten and no claimed name is given up.
    """
    if before and before["state"] == "done":
        return before["entry"]
    target = before["entry"]["quarantine_path"] if before else None

    def done(entry: dict) -> dict:
        journal.write({"path": r["path"], "state": "done", "entry": entry})
        return entry

    if target and os.path.lexists(target) and not os.path.lexists(r["path"]):  # it had moved, only the note was missing
        return done(_entry(r, "moved", target))
    if canceled:
        return done(_entry(r, "skipped", reason=K.REASON_CANCELED))
    problem = _problem(r, r["keeper"])
    if problem:
        return done(_entry(r, problem[0], reason=problem[1]))
    if not target:
        target = claim(out_dir, r["name"] or "file", r["k"])
        journal.write({"path": r["path"], "state": "moving", "entry": _entry(r, "moved", target)})
    try:
        move(r["path"], target)
    except OSError as e:
        entry = done(_entry(r, "failed", reason=f"{K.REASON_MOVE}{e}"))
        if os.path.lexists(r["path"]) and os.path.getsize(target) == 0:
            os.remove(target)
        return entry
    try:
        return done(_entry(r, "moved", target))
    except OSError:
        move(target, r["path"])  # a move that isn't on record is taken back
        raise


_COLUMNS = ["hash", "original_path", "quarantine_path", "size", "moved_ts", "status", "reason"]
_ENTRY = "hash string, original_path string, quarantine_path string, size long, moved_ts string, status string, reason string, normalized_path string"


def _moves(out_dir: str, folder: str):
    """A partition is a bucket: every attempt at it gets the same victims, and finds what earlier attempts noted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        journal, known = None, {}
        for pdf in batches:
            entries = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if journal is None:
                    known = journal_steps(folder, r["bucket"])
                    journal = Journal(folder, r["bucket"])
                entries.append(apply_one(r, out_dir, journal, known.get(r["path"]), os.path.exists(os.path.join(folder, CANCELED))) | {"normalized_path": r["normalized_path"]})
            yield pd.DataFrame(entries, columns=[*_COLUMNS, "normalized_path"])
        if journal:
            journal.close()

    return run


#: A file in a run's journal folder: victims that haven't moved by now stay.
CANCELED = "CANCELED"
#: Victims of one task, about.
BUCKET_FILES = 1000


def _begun(out_dir: str, manifests_dir: str) -> tuple[ApplyResult, dict]:
    run = f"{datetime.now(timezone.utc):%Y%m%d-%H%M%S}-{uuid.uuid4().hex}"
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(manifests_dir, f"{run}.json")
    head = {"run_id": run, "started_ts": now(), "mode": "quarantine"}
    write_manifest(path, head | {"entries": []})
    return ApplyResult(run, path, out_dir), head


def victims(plan: DataFrame) -> DataFrame:
    """What a task has to know of each victim: hash, path, normalized_path, size, name, k, and
    ``keeper``, the last kept path of its hash (null if none is)."""
    keeper = plan.where("action = 'keep'").groupBy("hash").agg(F.max_by("path", "normalized_path").alias("keeper"))
    return numbered_victims(plan).join(keeper, "hash", "left").select("hash", "path", "normalized_path", "size", "name", F.col("k").cast("int").alias("k"), "keeper")


def run(plan: DataFrame, out_dir: str, manifests_dir: str, logs: LogSink, canceled: Callable[[], bool] = lambda: False) -> ApplyResult:
    """Move the plan's victims into ``out_dir``, flat, from the executors, which have to see
    the files.  Nothing of the plan is collected: the manifest and the table of moved files are written
    from a stream of entries.  A task that is lost is run again and goes on where its journal ends."""
    result, head = _begun(out_dir, manifests_dir)
    folder = journal_folder(result.manifest_path)
    os.makedirs(folder)
    flag = os.path.join(folder, CANCELED)
    given = cut(victims(plan), "run-victims")
    buckets = max(1, min(given.count() // BUCKET_FILES + 1, 100_000))
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    over = threading.Event()

    def watch() -> None:
        while not over.wait(0.1):
            if canceled() and not os.path.exists(flag):
                open(flag, "w").close()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        dealt = given.withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket"))
        entries = cut(dealt.mapInPandas(_moves(out_dir, folder), _ENTRY), "run-entries")
    finally:
        over.set()
        watcher.join()
    ordered = entries.orderBy("hash", "normalized_path")
    stream = lambda: ({c: r[c] for c in _COLUMNS} for r in ordered.toLocalIterator())

    def counted() -> Iterator[dict]:
        for e in stream():
            _count(result, e, logs)
            yield e

    write_run(result.manifest_path, head, counted())
    result.kept = plan.where("action = 'keep'").count()
    result.moved = entries.where("status = 'moved'").select("normalized_path")
    return _ended(result, stream(), logs)


def _count(result: ApplyResult, e: dict, logs: LogSink) -> None:
    at = e["original_path"]
    if e["status"] == "moved":
        result.quarantined += 1
        result.bytes_freed += e["size"]
        logs.real(f"QUARANTINED {at} -> {e['quarantine_path']}")
    elif e["reason"] == K.REASON_CANCELED:
        result.canceled, result.not_processed = True, result.not_processed + 1
        logs.warn(f"run stopped; {at} stays where it is")
    else:
        result.failed += 1
        (logs.error if e["reason"].startswith(K.REASON_MOVE) else logs.warn)(f"{e['reason']}: {at}")


def _ended(result: ApplyResult, entries: Iterable[dict], logs: LogSink) -> ApplyResult:
    """The manifest is whole: the journals go, and the table of moved files is extended."""
    shutil.rmtree(journal_folder(result.manifest_path))
    logs.real(f"manifest written: {result.manifest_path}; {result.kept} files kept")
    try:
        append_log(result.output_dir, {"entries": entries})
    except OSError as e:
        logs.warn(f"the table of moved files was not extended: {e}")
    return result


def apply(rows: Iterable[dict], out_dir: str, manifests_dir: str, logs: LogSink, canceled: Callable[[], bool]) -> ApplyResult:
    """The same on the driver, victim by victim (rows of :func:`victims`), for callers who want to be asked before each."""
    result, head = _begun(out_dir, manifests_dir)
    journal = Journal(journal_folder(result.manifest_path), 0)
    entries = []
    for r in rows:
        e = apply_one(r, out_dir, journal, canceled=canceled())
        _count(result, e, logs)
        entries.append(e)
        if e["status"] == "moved":
            result.moved.append(r["normalized_path"])
    journal.close()
    write_run(result.manifest_path, head, entries)
    return _ended(result, entries, logs)


def _problem(r: dict, keeper: str | None) -> tuple[str, str] | None:
    """Status and reason why a victim may not be moved; None if it may."""
    if not os.path.exists(r["path"]):
        return "skipped", K.REASON_GONE
    if keeper is None:
        return None
    try:
        return None if files_equal(keeper, r["path"]) else ("failed", f"{K.REASON_DIFFERS}{keeper}")
    except OSError as e:
        return "failed", f"{K.REASON_VERIFY}{e}"


def undo(manifest_path: str, logs: LogSink) -> UndoResult:
    """Move a run's files back.  A path where a file is again by now is left alone."""
    manifest = load_manifest(manifest_path)
    result = UndoResult(manifest["run_id"])
    for e in manifest["entries"]:
        if e["status"] not in ("", "moved") or not e["quarantine_path"]:
            continue
        source, target = e["quarantine_path"], e["original_path"]
        try:
            if not os.path.exists(source):
                raise FileNotFoundError(errno.ENOENT, "no such file in the quarantine folder", source)
            if os.path.lexists(target):
                raise FileExistsError(errno.EEXIST, "a file is there already", target)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            move(source, target)
        except OSError as err:
            result.failed += 1
            logs.error(f"restore failed: {err}")
            continue
        result.restored += 1
        logs.real(f"RESTORED {source} -> {target}")
    return result
