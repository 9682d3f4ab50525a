"""The persistent cache: Parquet tables behind one pointer.

The cache of files is a base and deltas.  A change of files writes only the rows that it
changes: ``put`` (a new version of a path's row), ``miss`` (a scan of its root didn't meet it; the row
stays), ``drop`` (the row goes) or ``purge`` (the row and what scans remember of it go).  Rows that a
scan met unchanged aren't written: the scan leaves one row for each of its roots, a *touch*, and
a row that is ``put`` was last seen at its root's last touch.  What a scan saw (``scan_files``) is read from the same versions:
those of its roots that were put before its end and not closed by then.  After ``DELTAS`` deltas, or when they outgrow half
the base, the base is written anew and closed versions go to the history.

A change writes new snapshot folders and then a new pointer, so a
reader sees the state before or after it, never between; a lost executor costs a retry of
a Spark write, nothing else.  Pointers are numbered, and a number is taken once: of two
writers that start from one state the second fails and changes nothing.  The folders of
the last ``KEPT`` states stay, for frames that were handed out over them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions.errors import StoreError
from siftstone.operators import cache

VERSION = 3
#: Deltas after which a base is written anew.
DELTAS = 16
#: States whose folders are kept, the current one included.
KEPT = 4
TABLES = {
    "folders": "id long, path string, normalized_path string, first_seen_ts string, last_scan_ts string, last_file_count long, last_total_bytes long",
    "scans": "id long, started_ts string, ended_ts string, mode string, roots array<string>, files_seen long, bytes_seen long, hashes_reused long, "
    "hashes_computed long, duplicate_groups long, wasted_bytes long",
    "files": "id long, hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long, "
    "first_seen_ts string, last_seen_ts string, last_scan_id long",
    "scan_files": "scan_id long, hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long",
}
_VERSION = ", op string, scan long, seq long"
#: What the store keeps beside: deltas and closed versions of files, and touches of roots.
LOGS = {
    "files": TABLES["files"] + _VERSION,
    "deltas": TABLES["files"] + _VERSION,
    "history": TABLES["files"] + _VERSION + ", until long",
    "touches": "scan_id long, ts string, root string",
}
_FILES = [c.split()[0] for c in TABLES["files"].split(", ")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.FileContext.getFileContext(jvm.Path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._number, self.state = 0, None
        self.refresh()
        if self.state is None:
            self._commit({"version": VERSION, "tables": {}})
        self._migrate()

    # pointers
    def _numbers(self) -> list[int]:
        """The numbers of the states that are there."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for m in map(re.compile(r"STATE-(\d+)$").match, names) if m)

    def _state(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/STATE-{number}", wholetext=True).first()[0])

    def refresh(self) -> None:
        """Take up the newest state."""
        numbers = self._numbers()
        if numbers:
            self._number = numbers[-1]
            self.state = self._state(self._number)

    def _commit(self, state: dict) -> None:
        part = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:  # a number that is taken stays as it is
            self._files.rename(part, self._path(f"{self.root}/STATE-{self._number + 1}"), keep)
        except Exception as e:
            self._fs.delete(part, False)
            mine = {p for ps in state["tables"].values() for p in ps} - {p for ps in (self.state or {}).get("tables", {}).values() for p in ps}
            for p in mine:
                self._fs.delete(self._path(p), True)
            self.refresh()
            raise StoreError("the store was changed meanwhile; nothing was written") from e
        self._number, self.state = self._number + 1, state
        old = [n for n in self._numbers() if n <= self._number - KEPT]
        if not old:
            return
        used = {p for n in self._numbers()[len(old) :] for ps in self._state(n)["tables"].values() for p in ps}
        for n in old:
            for p in {p for ps in self._state(n)["tables"].values() for p in ps} - used:
                self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(f"{self.root}/STATE-{n}"), False)

    def _migrate(self) -> None:
        v = self.state["version"]
        if v == VERSION:
            return
        if v not in (1, 2):
            raise StoreError(f"unsupported schema version {v}")
        n = cache.legacy_rows(self.read("files"), self.read("scan_files")).first()[0]
        changed = {}
        if n:  # scans that saw partial hashes can't be trusted
            changed = {"files": cache.purge_legacy(self.read("files")), "scan_files": self.read("scan_files").limit(0), "scans": self.read("scans").limit(0)}
        self.replace(changed, version=VERSION)

    # tables
    def _held(self, table: str) -> DataFrame:
        """A table as it lies; columns that older states lack are null."""
        paths, schema = self.state["tables"].get(table, []), LOGS.get(table) or TABLES[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, table: str) -> DataFrame:
        if table == "files":
            return self._seen(self._current()).select(_FILES)
        if table == "scan_files":
            return self._held(table).unionByName(self._snapshots())
        return self._held(table)

    def _versions(self, table: str) -> DataFrame:
        usual = {"op": F.coalesce("op", F.lit("put")), "scan": F.coalesce("scan", "last_scan_id", F.lit(0)), "seq": F.coalesce("seq", F.lit(0))}
        return self._held(table).withColumns(usual)

    def _current(self) -> DataFrame:
        """The newest version of each path that is there."""
        base = self._versions("files")
        if not self.state["tables"].get("deltas"):
            return base
        whole = F.struct(*base.columns)
        last = self._versions("deltas").groupBy("normalized_path").agg(F.max_by(whole, "seq").alias("v")).select("v.*")
        return base.join(last, "normalized_path", "left_anti").unionByName(last.where(F.col("op").isin("put", "miss")))

    def _seen(self, rows: DataFrame) -> DataFrame:
        """Rows with the time and the scan that last saw them: their own, or the last touch of their root."""
        if not self.state["tables"].get("touches"):
            return rows
        last = self._held("touches").groupBy("root").agg(F.max(F.struct("scan_id", "ts")).alias("t"))
        met = rows.join(last, rows["source_root"] == last["root"], "left")
        later = (F.col("op") == "put") & (F.col("t.scan_id") > F.coalesce("last_scan_id", F.lit(-1)))
        return met.withColumns({"last_seen_ts": F.when(later, F.col("t.ts")).otherwise(F.col("last_seen_ts")), "last_scan_id": F.when(later, F.col("t.scan_id")).otherwise(F.col("last_scan_id"))}).select(rows.columns)

    def _lives(self, versions: DataFrame) -> DataFrame:
        """Versions that were put, with ``until``, the scan that closed each; purged ones left out."""
        path = Window.partitionBy("normalized_path")
        ends = versions.withColumn("until", F.lead("scan").over(path.orderBy("seq"))).withColumn("purged", F.max(F.when(F.col("op") == "purge", F.col("seq"))).over(path))
        return ends.where("op = 'put' and (purged is null or seq > purged)").drop("purged")

    def _past(self) -> DataFrame:
        """The history without the paths that were purged since."""
        purged = self._versions("deltas").where("op = 'purge'").select("normalized_path").distinct()
        return self._held("history").join(purged, "normalized_path", "left_anti")

    def _snapshots(self) -> DataFrame:
        lives = self._lives(self._versions("files").unionByName(self._versions("deltas"))).unionByName(self._past())
        touch = self._held("touches").select("scan_id", "root")
        met = lives.join(touch, lives["source_root"] == touch["root"]).where("scan_id >= scan and (until is null or scan_id < until)")
        return met.select([c.split()[0] for c in TABLES["scan_files"].split(", ")])

    def _write(self, table: str, rows: DataFrame) -> str:
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        schema = LOGS.get(table) or TABLES[table]
        rows.select([c.split()[0] for c in schema.split(", ")]).write.parquet(path)
        return path

    def _bytes(self, table: str) -> int:
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in self.state["tables"].get(table, []))

    def _next_scan(self) -> int:
        return (self.read("scans").agg(F.max("id")).first()[0] or 0) + 1

    def _changes(self, files: DataFrame, scan: int | None = None, roots: list[str] | None = None) -> DataFrame:
        """The versions that make the cache equal ``files``; of a scan, times and scans of unchanged rows are left to its touches."""
        fixed = [c for c in _FILES if scan is None or c not in ("last_seen_ts", "last_scan_id")]
        old = self._seen(self._current()).select("normalized_path", F.struct(*fixed).alias("was"), F.struct(*_FILES).alias("old"), F.col("op").alias("old_op"))
        new = files.select("normalized_path", F.struct(*fixed).alias("is"), F.struct(*_FILES).alias("new"))
        seen = F.coalesce(F.col("new.last_scan_id") == scan, F.lit(False)) if scan is not None else F.lit(False)
        missed = F.lit(False) if scan is None else ~seen & F.col("new.source_root").isin(roots or []) & (F.col("old_op") == "put")
        changed = F.col("old").isNull() | ~F.col("is").eqNullSafe(F.col("was")) | (seen & (F.col("old_op") == "miss"))
        stays = F.when(F.coalesce(F.col("old_op") == "miss", F.lit(False)) & ~seen, "miss").otherwise("put")
        op = F.when(F.col("new").isNull(), "drop").when(missed, "miss").when(changed, stays)
        # A row that a scan missed keeps what it was last seen at.
        rows = old.join(new, "normalized_path", "full").withColumn("op", op).where("op is not null")
        body = F.when((F.col("op") == "drop") | (missed & ~changed), F.col("old")).otherwise(F.col("new"))
        since = F.lit(scan if scan is not None else self._next_scan()).cast("long")
        return rows.select(body.alias("v"), "op", since.alias("scan"), F.lit(self._number + 1).cast("long").alias("seq")).select("v.*", "op", "scan", "seq")

    def _with_changes(self, tables: dict, changes: DataFrame) -> None:
        first = "deltas" if tables.get("files") or tables.get("deltas") else "files"
        tables[first] = [*tables.get(first, []), self._write(first, changes)]

    def replace(self, changed: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, version: int | None = None) -> None:
        """New contents for some tables and more rows for others, as one change.  Of files only
        what differs is written; new contents of what scans saw end what was remembered of them."""
        tables = {k: list(v) for k, v in self.state["tables"].items()}
        for t, rows in changed.items():
            if t == "files":
                self._with_changes(tables, self._changes(rows))
                continue
            tables[t] = [self._write(t, rows)]
            if t == "scan_files":
                tables["history"], tables["touches"] = [], []
        for t, rows in (appended or {}).items():
            tables[t] = [*tables.get(t, []), self._write(t, rows)]
        self._commit({"version": version or self.state["version"], "tables": tables})
        self._compact_if_due()

    def save_scan(self, files: DataFrame, scan_id: int, now: str, roots: list[str]) -> None:
        """The cache after a scan of some roots: ``files`` is all of it, what changed is written."""
        tables = {k: list(v) for k, v in self.state["tables"].items()}
        self._with_changes(tables, self._changes(files, scan_id, roots))
        touches = self.spark.createDataFrame([(scan_id, now, r) for r in dict.fromkeys(roots)], LOGS["touches"]).coalesce(1)
        tables["touches"] = [*tables.get("touches", []), self._write("touches", touches)]
        self._commit({"version": self.state["version"], "tables": tables})
        self._compact_if_due()

    def _compact_if_due(self) -> None:
        if len(self.state["tables"].get("deltas", [])) >= DELTAS or self._bytes("deltas") > self._bytes("files") // 2:
            self.compact()

    def compact(self) -> None:
        """A base of the newest versions; closed ones go to the history, purged ones go."""
        deltas = self._versions("deltas")
        met = self._versions("files").join(deltas.select("normalized_path").distinct(), "normalized_path", "left_semi")
        closed = self._lives(met.unionByName(deltas)).where("until is not null")
        tables = {k: list(v) for k, v in self.state["tables"].items()}
        past = self._past() if not deltas.where("op = 'purge'").isEmpty() else None
        old = [self._write("history", past)] if past is not None else tables.get("history", [])
        tables |= {"history": [*old, self._write("history", closed)], "files": [self._write("files", self._current())], "deltas": []}
        if len(tables.get("touches", [])) > DELTAS:
            tables["touches"] = [self._write("touches", self._held("touches").coalesce(1))]
        self._commit({"version": self.state["version"], "tables": tables})

    # statements
    def start_scan(self, mode: str, roots: list[str], now: str) -> int:
        id_ = (self.read("scans").agg(F.max("id")).first()[0] or 0) + 1
        row = (id_, now, None, mode, roots, 0, 0, 0, 0, 0, 0)
        self.replace({}, {"scans": self.spark.createDataFrame([row], TABLES["scans"])})
        return id_

    def finish_scan(self, id_: int, now: str, **metrics: int) -> None:
        """Closes a scan; one that failed is closed with zeros."""
        self.replace({"scans": cache.finish_scan(self.read("scans"), F.col("id") == id_, now, **metrics)})

    def remember_folders(self, roots: list[tuple[str, str]], now: str) -> None:
        new = self.spark.createDataFrame(roots, "path string, normalized_path string")
        self.replace({"folders": cache.remember_folders(self.read("folders"), new, now)})

    def forget_folder(self, normalized: str) -> None:
        self.replace({"folders": cache.forget_folder(self.read("folders"), normalized)})

    def delete_paths(self, paths: list[str] | DataFrame) -> None:
        """Rows of these paths go from the cache and from what scans saw."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "normalized_path string") if isinstance(paths, list) else paths
        since, seq = F.lit(self._next_scan()).cast("long"), F.lit(self._number + 1).cast("long")
        blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in TABLES["files"].split(", ") if not c.startswith("normalized_path ")]
        rows = gone.select("normalized_path").distinct().select("normalized_path", *blank, F.lit("purge").alias("op"), since.alias("scan"), seq.alias("seq"))
        tables = {k: list(v) for k, v in self.state["tables"].items()}
        tables["deltas"] = [*tables.get("deltas", []), self._write("deltas", rows)]
        if tables.get("scan_files"):
            tables["scan_files"] = [self._write("scan_files", cache.delete_paths(self._held("scan_files"), gone))]
        self._commit({"version": self.state["version"], "tables": tables})
        self._compact_if_due()

    def stats(self) -> dict:
        return cache.memory_stats(self.read("folders"), self.read("files"), self.read("scans")).first().asDict()
