"""The engine's commands: scans, plans, runs, history, exports."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions.errors import BadInput, Canceled, NoPendingPlan, NotConfirmed, ScanAlreadyRunning
from siftstone.operators import cache, dedupe, inventory, reports, similar
from siftstone.operators.inventory import ScanOptions
from siftstone.plans import quarantine
from siftstone.plans.store import Store
from siftstone.sources import media
from siftstone.sources.content import hash_files
from siftstone.sources.inventory import stored, walk_tree
from siftstone.sources.logs import LogSink, now
from siftstone.sources.manifest import guard
from siftstone.sources.scratch import cut

VERSION = "1.0.0"


def _exist(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(path_exists=[os.path.exists(p) for p in pdf["path"]])


@contextmanager
def _every(seconds: float, value: Callable[[], int], tell: Callable[[], None]):
    """Calls ``tell`` meanwhile, whenever the value has changed."""
    over, last = threading.Event(), [value()]

    def watch() -> None:
        while not over.wait(seconds):
            if value() != last[0]:
                last[0] = value()
                tell()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()


@dataclass
class DataPaths:
    """Where the engine keeps things; the output folder is made by the first run that moves files."""

    root: str
    quarantine_dir: str | None = None

    def __post_init__(self) -> None:
        self.root = os.path.abspath(self.root)
        self.store = os.path.join(self.root, "store")
        self.logs = os.path.join(self.root, "logs")
        self.exports = os.path.join(self.root, "exports")
        self.manifests = os.path.join(self.root, "manifests")
        self.quarantine_dir = self.quarantine_dir or os.path.join(self.root, "Quarantine")
        for d in (self.logs, self.exports, self.manifests):
            os.makedirs(d, exist_ok=True)


@dataclass
class ScanResult:
    scan_id: int
    mode: str
    roots: list[str]
    files: DataFrame  # scanned: hash and inventory of every file
    counters: dict
    per_root: list[dict]
    folders: list[dict]
    totals: dict
    entries: DataFrame = field(repr=False, default=None)

    def groups(self) -> DataFrame:
        return dedupe.duplicate_groups(self.files)

    def duplicate_dirs(self) -> DataFrame:
        return dedupe.duplicate_dirs(self.files)

    def folder_map(self) -> DataFrame:
        found = self.entries.where("not is_dir and error is null")
        dirs = self.entries.where("is_dir and depth > 0 and error is null").select("source_root", F.col("normalized_path").alias("path"))
        return inventory.folder_map(found, dirs)

    def sample_files(self) -> DataFrame:
        return inventory.sample_files(self.files)


class Engine:
    def __init__(self, spark: SparkSession, data: DataPaths | str, digest: str = "sha256"):
        self.spark = spark
        self.data = data if isinstance(data, DataPaths) else DataPaths(data)
        self.digest = digest
        self.logs = LogSink(os.path.join(self.data.logs, "activity.jsonl"))
        self.store = Store(spark, "file://" + self.data.store)
        self._busy, self._cancel = threading.Lock(), threading.Event()
        self._tag: str | None = None
        self._last: ScanResult | None = None
        self._plan: DataFrame | None = None

    # --- scans --------------------------------------------------------------------------

    def run_scan(
        self, roots: list[str], mode: str = "dry", options: ScanOptions | None = None, commit_results: bool = True, progress: Callable[[dict], None] | None = None
    ) -> ScanResult:
        """Walk, look up, hash what is new, store, and group.

        A scan that doesn't commit its results (a comparison) leaves the last results and
        the plan as they are, but writes the cache and a row of history like any other.
        """
        if mode not in ("dry", "real"):
            raise BadInput(f"unknown mode {mode}")
        if not roots:
            raise BadInput("no folders to scan")
        if not self._busy.acquire(blocking=False):
            raise ScanAlreadyRunning()
        try:
            self._cancel.clear()
            self._tag = f"scan-{uuid.uuid4().hex}"
            self.spark.sparkContext.addJobTag(self._tag)
            given = options or ScanOptions.interactive(data_root=self.data.root)
            self.store.remember_folders([(r, stored(os.path.abspath(r))) for r in dict.fromkeys(roots)], now())
            scan_id = self.store.start_scan(mode, list(roots), now())
            try:
                result = self._scan(scan_id, mode, roots, given, progress or (lambda p: None))
            except BaseException as e:
                self._untag()
                self.store.finish_scan(scan_id, now())
                if self._cancel.is_set() and not isinstance(e, Canceled):  # its jobs were stopped
                    self._checked()
                raise
            if commit_results:
                self._last, self._plan = result, dedupe.plan(result.files)
            return result
        finally:
            self._untag()
            self._busy.release()

    def _untag(self) -> None:
        tag, self._tag = self._tag, None
        if tag:
            self.spark.sparkContext.removeJobTag(tag)

    def _checked(self) -> None:
        if self._cancel.is_set():
            self.logs.warn("scan canceled")
            raise Canceled("scan canceled")

    def _scan(self, scan_id: int, mode: str, roots: list[str], options: ScanOptions, progress) -> ScanResult:
        told = lambda phase, done, total, **more: progress({"phase": phase, "processed": done, "total": total, "percent": min(100, done * 100 // max(total, 1)), **more})
        told("inventory", 0, 0)
        entered = self.spark.sparkContext.accumulator(0)
        with _every(0.1, lambda: entered.value // K.PROGRESS_DIRS, lambda: told("inventory", entered.value, 0, folders=entered.value)):
            walked = walk_tree(self.spark, roots, options.skip_dev_dirs, options.follow_symlinks, done=entered)
        self._checked()
        files = walked.where("not is_dir")
        kept = inventory.filtered(files, options).select("source_root", "path", "normalized_path", "file_name", "media_kind", "size", "modified_ns", "dev", "ino")
        bank = self.store.read("files")
        told("checking-cache", 0, 0)
        live = self._alive(bank, walked)
        looked = cut(cache.lookup(kept, live), "scan-lookup")
        n = looked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit_kind") != "miss").alias("hits")).first()
        self._checked()
        told("hashing", n["hits"], n["n"], hashes_reused=n["hits"], hashes_computed=0)
        misses = looked.where("hit_kind = 'miss'")
        done = self.spark.sparkContext.accumulator(0)
        tell = lambda: told("hashing", min(n["n"], n["hits"] + done.value), n["n"], hashes_reused=n["hits"], hashes_computed=min(n["n"] - n["hits"], done.value))
        with _every(0.25, lambda: done.value // K.PROGRESS_FILES, tell):
            hashed = cut(hash_files(misses, self.digest, done=done), "scan-hashes")
        self._checked()
        told("saving", n["n"], n["n"])
        fresh = cache.with_hashes(misses, hashed)
        self._log_errors(fresh.where("hash is null").select("path", "message", "denied"))
        new = fresh.where("hash is not null")
        moves = cache.moves_by_hash(new, live, looked).select("normalized_path", F.col("moved_from").alias("hash_moved_from"))
        got = looked.where("hit_kind != 'miss'").withColumn("computed", F.lit(False)).select(*kept.columns, "hash", "hit_kind", "moved_from", "claimed", "computed")
        computed = new.join(moves, "normalized_path", "left").withColumn("moved_from", F.col("hash_moved_from")).withColumn("claimed", F.col("hash_moved_from"))
        computed = computed.withColumn("computed", F.lit(True)).select(got.columns)
        both = got.unionByName(computed).withColumn("reused_from_cache", ~F.col("computed") | F.col("moved_from").isNotNull())
        scanned = cut(both, "scan-files")
        self._save(scanned, bank, scan_id, roots)
        return self._report(scan_id, mode, roots, options, walked, looked, scanned, fresh, told)

    def _alive(self, bank: DataFrame, walked: DataFrame) -> DataFrame:
        """The cache with ``path_exists``: by the walk for paths it met, else by the file system."""
        met = cut(cache.live_only(bank, walked.where("not is_dir")), "scan-live")
        asked = met.where("not path_exists").mapInPandas(_exist, met.schema)  # cached paths that no walk met
        return met.where("path_exists").unionByName(asked)

    def _log_errors(self, errors: DataFrame) -> None:
        for r in inventory.error_summary(errors).collect():  # the first twenty and two totals
            self.logs.warn(r["line"])

    def _save(self, scanned: DataFrame, bank: DataFrame, scan_id: int, roots: list[str]) -> None:
        at = now()
        moves = scanned.where("claimed is not null").select(F.col("claimed").alias("moved_from"), "path", "normalized_path", "file_name", "source_root")
        moved = bank if moves.isEmpty() else cut(cache.relocate(bank, moves, scan_id, at), "store-moved")
        files = cut(cache.upsert_files(moved, scanned.select(cache.SNAPSHOT), scan_id, at), "store-files")
        self.store.save_scan(files, scan_id, at, [stored(os.path.abspath(r)) for r in roots])

    def _report(self, scan_id, mode, roots, options, walked, looked, scanned, fresh, told) -> ScanResult:
        files = walked.where("not is_dir")
        per_root = {r["source_root"]: r.asDict() for r in inventory.root_counters(files, options).collect()}
        for r in cache.counters(looked).collect():
            per_root.setdefault(r["source_root"], {}).update(r.asDict())
        saved = {r["source_root"]: r.asDict() for r in cache.outcome_counters(scanned).collect()}
        failed = {r["source_root"]: r["n"] for r in fresh.rollup("source_root").agg(F.count_if(F.col("hash").isNull()).alias("n")).collect()}
        walk_errors = walked.where("is_dir and error is not null").count()
        for root, row in per_root.items():
            row.update(saved.get(root, {"new_hashes_saved": 0, "hashes_reused": 0, "hashes_computed": 0, "moved_reused": 0, "bytes_seen": 0, "bytes_hashed": 0}))
            row["errors"] = row.get("errors", 0) + failed.get(root, 0) + (walk_errors if root is None else 0)
            row["source_root"] = root
        dirs = walked.where("is_dir and error is null").select("source_root", F.col("normalized_path").alias("path"), "depth", "pruned")
        folders = [r.asDict() | {"selected_roots": 1 if r["source_root"] else len(roots), "skipped_errors": walk_errors} for r in inventory.folder_taxonomy(dirs, files.where("error is null")).collect()]
        totals = dedupe.report_totals(scanned).first().asDict()
        all_ = per_root.get(None) or {"hashes_reused": 0, "hashes_computed": 0, "bytes_seen": 0, "files_walked": 0, "source_root": None}
        self.store.finish_scan(
            scan_id, now(), files_seen=all_.get("files_walked", 0), bytes_seen=all_.get("bytes_walked", 0), hashes_reused=all_["hashes_reused"], hashes_computed=all_["hashes_computed"],
            duplicate_groups=totals["duplicate_groups"], wasted_bytes=totals["total_wasted_bytes"],
        )
        sums = scanned.groupBy(F.col("source_root").alias("normalized_path")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))
        self.store.replace({"folders": cache.update_folder_stats(self.store.read("folders"), sums, now())})
        told("done", totals["total_files"], totals["total_files"], hashes_reused=all_["hashes_reused"], hashes_computed=all_["hashes_computed"])
        self.logs.info(f"scan {scan_id}: {totals['total_files']} files, {totals['duplicate_groups']} groups")
        return ScanResult(scan_id, mode, list(roots), scanned, all_, [r for k, r in per_root.items() if k is not None], folders, totals, walked)

    def cancel_scan(self) -> None:
        """Stop a running scan, its Spark jobs included, or the remaining moves of a run."""
        self._cancel.set()
        tag = self._tag
        if tag:
            self.spark.sparkContext.cancelJobsWithTag(tag)

    def get_last_results(self) -> ScanResult | None:
        return self._last

    def compare_folders(self, a: str, b: str) -> DataFrame:
        """Groups over two folders, all kinds of files; a group may lie in one folder."""
        result = self.run_scan([a, b], options=ScanOptions(skip_dev_dirs=True, exclude=[self.data.root]), commit_results=False)
        return dedupe.compare_roots(result.files)

    # --- similar videos -----------------------------------------------------------------

    def find_similar_videos(self, max_distance: int = K.MAX_DISTANCE, frame=media.extract_frame, duration=media.probe_duration, frames_root: str | None = None) -> dict:
        """Clusters of the last scan's videos, for review; they never reach the plan.

        With ``frames_root`` frames are read from image files there (:func:`media.stored_fingerprints`), without the tools.
        """
        if self._last is None:
            raise NoPendingPlan()
        if not 0 <= max_distance <= 32:
            raise BadInput("distance must lie between 0 and 32")
        videos = inventory.video_paths(self._last.files).distinct()
        if frames_root is None and frame is media.extract_frame and not media.tools_available():
            return {"available": False, "message": "the tools that read video frames were not found", "considered": videos.count(), "fingerprinted": 0, "failed": 0, "clusters": None, "members": None}
        if not self._busy.acquire(blocking=False):
            raise ScanAlreadyRunning()
        try:
            taken = media.fingerprints(videos, frame, duration) if frames_root is None else media.stored_fingerprints(videos, frames_root)
            prints = cut(taken, "similar-prints")
            good = prints.where("frames is not null")
            edges = cut(similar.video_edges(good, max_distance), "similar-edges")
            totals = similar.similar_totals(videos, good).first().asDict()
            return {"available": True, "message": "", **totals, "clusters": similar.clusters(edges), "members": similar.members(edges)}
        finally:
            self._busy.release()

    # --- plans --------------------------------------------------------------------------

    def get_default_plan(self) -> DataFrame:
        if self._plan is None:
            raise NoPendingPlan()
        return self._plan

    def set_keeper_rule(self, rule: str) -> DataFrame:
        """A new plan by another rule; overrides are lost."""
        if self._last is None:
            raise NoPendingPlan()
        if rule not in K.KEEPER_REASONS:
            raise BadInput(f"unknown keeper rule {rule}")
        fresh = cut(dedupe.plan(self._last.files, rule), "plan")
        self._validate(fresh)
        self._plan = fresh
        return fresh

    def set_plan_action(self, normalized_path: str, action: str) -> DataFrame:
        """One entry's action; a plan that would lose a last copy is refused and the old one stays."""
        if action not in ("keep", "quarantine"):
            raise BadInput(f"unknown action {action}")
        plan = self.get_default_plan()
        if plan.where(F.col("normalized_path") == normalized_path).isEmpty():
            raise BadInput(f"not in the plan: {normalized_path}")
        one = self.spark.createDataFrame([(normalized_path, action)], "normalized_path string, action string")
        fresh = cut(dedupe.with_overrides(plan, one), "plan")
        self._validate(fresh)
        self._plan = fresh
        return fresh

    def _validate(self, plan: DataFrame) -> None:
        bad = dedupe.plan_counts(plan).where("would_delete_unique").select("hash").limit(1).collect()
        if bad:
            quarantine.check_plan([{"hash": bad[0]["hash"], "action": "quarantine"}])

    def preview_plan(self) -> DataFrame:
        return dedupe.plan_preview(self.get_default_plan())

    def apply_plan(self, confirmed: bool, canceled: Callable[[], bool] | None = None) -> quarantine.ApplyResult:
        """Move the victims of the plan; needs a confirmation and a plan that isn't empty.
        The executors move them, unless ``canceled`` is given, which is asked before each."""
        if not confirmed:
            raise NotConfirmed()
        plan = self.get_default_plan()
        self._validate(plan)
        if plan.isEmpty():
            raise NoPendingPlan()
        self._cancel.clear()
        if canceled is None:
            result = quarantine.run(plan, self.data.quarantine_dir, self.data.manifests, self.logs, self._cancel.is_set)
        else:
            rows = (r.asDict() for r in quarantine.victims(plan).orderBy("hash", "normalized_path").toLocalIterator())
            result = quarantine.apply(rows, self.data.quarantine_dir, self.data.manifests, self.logs, canceled)
            result.kept = plan.where("action = 'keep'").count()
        if result.quarantined:
            self.store.delete_paths(result.moved)
        self._plan = None
        return result

    def undo_run(self, manifest_path: str, confirmed: bool = True) -> quarantine.UndoResult:
        if not confirmed:
            raise NotConfirmed()
        return quarantine.undo(guard(manifest_path, self.data.manifests), self.logs)

    # --- history, logs, exports -----------------------------------------------------------

    def list_remembered_folders(self) -> DataFrame:
        return cache.list_folders(self.store.read("folders"))

    def peek_folder(self, path: str) -> dict | None:
        row = cache.peek_folder(self.store.read("folders"), stored(os.path.abspath(path))).first()
        return row.asDict() if row else None

    def forget_folder(self, path: str) -> None:
        self.store.forget_folder(stored(os.path.abspath(path)))

    def recent_scans(self, limit: int = K.RECENT_SCANS) -> DataFrame:
        return cache.recent_scans(self.store.read("scans"), limit)

    def memory_stats(self) -> dict:
        return self.store.stats() | {"db_path": self.data.store}

    def get_logs(self, since: int = 0) -> tuple[list[dict], int]:
        return self.logs.tail(since)

    def clear_logs(self) -> None:
        self.logs.clear()

    def data_paths(self) -> dict:
        return asdict(self.data) | {"store": self.data.store, "logs": self.data.logs, "exports": self.data.exports, "manifests": self.data.manifests}

    def get_app_info(self) -> dict:
        return {"name": "siftstone", "version": VERSION}

    def export_report(self, format: str) -> dict:
        """The last report as one JSON file or one CSV file in a folder of its own."""
        if self._last is None:
            raise NoPendingPlan()
        ts = f"{datetime.now(timezone.utc):%Y%m%d-%H%M%S}"
        if format == "json":
            path = target = os.path.join(self.data.exports, f"report-{ts}.json")
            head = {"mode": self._last.mode, "roots": self._last.roots, "scan_id": self._last.scan_id}
            with open(path, "w", encoding="utf-8") as f:
                f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "report": {"totals": ' + json.dumps(self._last.totals) + ', "groups": [')
                for i, r in enumerate(self._last.groups().toJSON().toLocalIterator()):
                    f.write(("," if i else "") + "\n" + r)
                f.write("]}}\n")
        elif format == "csv":
            path = os.path.join(self.data.exports, f"scan-{ts}")
            os.makedirs(path, exist_ok=True)
            target = os.path.join(path, "report.csv")
            rows = reports.export_lines(self._last.files).select("line")
            with open(target, "w", encoding="utf-8", newline="") as f:
                f.write(",".join(K.REPORT_COLUMNS) + "\n")
                for r in rows.toLocalIterator():
                    f.write(r["line"] + "\n")
        else:
            raise BadInput(f"unknown export format {format}")
        self.logs.info(f"exported {format.upper()}: {path}")
        return {"path": path, "format": format, "bytes_written": os.path.getsize(target)}
