"""A Spark data source that walks folder trees: one row for each file and directory.

    spark.dataSource.register(InventorySource)
    spark.read.format("inventory").option("roots", json.dumps([...])).load()

The built-in file sources skip hidden and empty files and directories and cut times to
milliseconds; this one keeps them.  Each root is one partition for its own entries and one
for each folder below it, to a given depth, so a wide tree is walked in parallel; pruned
folders are listed but not entered.  The roots must be visible to the executors.  Tests of sizes, names, paths and kinds
are made while walking where ``spark.sql.python.filterPushdown.enabled`` is set (and the option ``pushFilters``,
which :func:`read_inventory` sets by it).

A tree of any shape is walked by :func:`walk_tree`: a task enters a bounded number of folders
and hands on those it hasn't come to, which are dealt to tasks anew.
"""

from __future__ import annotations

import json
import os
import stat
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith,
)

from siftstone.functions import constants as K
from siftstone.sources.scratch import cut

SCHEMA = (
    "source_root string, root_path string, path string, normalized_path string, file_name string, is_dir boolean, depth int, pruned boolean, "
    "size long, modified_ns long, dev long, ino long, error string, denied boolean"
)
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


def lossy(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


def stored(path: str) -> str:
    """A path's canonical text, by which it is looked up."""
    return unicodedata.normalize("NFC", lossy(path))


def _signed(n: int) -> int:
    return n - (1 << 64) if n > _LONG_MAX else n


def is_pruned(name: str, skip_dev_dirs: bool) -> bool:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return name in K.METADATA_DIRS or (skip_dev_dirs and (name in K.DEV_DIRS or low.endswith(tuple(K.BUNDLE_SUFFIXES))))


class Walk(InputPartition):
    def __init__(self, root: str, folder: str, depth: int, deep: bool, first: bool):
        self.root, self.folder, self.depth, self.deep, self.first = root, folder, depth, deep, first


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.skip_dev = options.get("skipdevdirs", "false") == "true"
        self.follow = options.get("followsymlinks", "false") == "true"
        self.split = int(options.get("splitdepth", "1"))
        self.tests: list[Callable[[tuple], bool]] = []

    def partitions(self) -> list[Walk]:
        out = []
        for root in self.roots:
            level, depth = [root], 0
            while level and depth < self.split:
                out += [Walk(root, f, depth, False, depth == 0) for f in level]
                level = [e.path for f in level for e in self._folders(f) if not is_pruned(e.name, self.skip_dev)]
                depth += 1
            out += [Walk(root, f, depth, True, False) for f in level]
        return out

    def _folders(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as entries:
                return sorted((e for e in entries if e.is_dir(follow_symlinks=self.follow)), key=lambda e: e.name)
        except OSError:  # the walk itself reports it
            return []

    def _row(self, root: str, path: str, name: str, is_dir: bool, depth: int, pruned: bool, st=None, error: OSError | None = None) -> tuple:
        ns = min(max(st.st_mtime_ns, _LONG_MIN), _LONG_MAX) if st else 0
        text = str(error.strerror or error) if error else None
        denied = isinstance(error, PermissionError)
        size = st.st_size if st and not is_dir else 0
        ids = (_signed(st.st_dev), _signed(st.st_ino)) if st else (0, 0)
        return (stored(root), lossy(root), lossy(path), stored(path), lossy(name), is_dir, depth, pruned, size, ns, *ids, text, denied)

    def read(self, part: Walk) -> Iterator[tuple]:
        rows = self.walk(part)
        return (r for r in rows if all(t(r) for t in self.tests)) if self.tests else rows

    def walk(self, part: Walk, budget: int | None = None, left: list | None = None, told: Callable[[int], None] | None = None) -> Iterator[tuple]:
        """Rows of a part.  After ``budget`` folders the ones not entered yet go to ``left``, as
        (folder, depth, dev, ino); ``told`` hears of every 64 folders, and of the rest at the end."""
        seen: set[tuple[int, int]] = set()  # followed links can lead back
        stack, entered = [(part.folder, part.depth, 0, 0)], 0
        if part.first:
            try:
                st = os.stat(part.folder)
                if stat.S_ISREG(st.st_mode):  # a root may be a single file
                    yield self._row(part.root, part.folder, os.path.basename(part.folder), False, 0, False, st)
                    return
                yield self._row(part.root, part.folder, os.path.basename(part.folder.rstrip("/")), True, 0, False, st)
            except OSError as e:
                yield self._row(part.root, part.folder, os.path.basename(part.folder.rstrip("/")), True, 0, False, None, e)
                return
        while stack:
            if budget is not None and entered >= budget:
                left.extend(stack)
                break
            folder, depth, dev, ino = stack.pop()
            entered += 1
            if self.follow and (dev, ino) != (0, 0):
                seen.add((dev, ino))
            if told and entered % K.PROGRESS_DIRS == 0:
                told(K.PROGRESS_DIRS)
            try:
                with os.scandir(folder) as entries:
                    listed = sorted(entries, key=lambda e: e.name)
            except OSError as e:
                yield self._row(part.root, folder, os.path.basename(folder), True, -1, False, None, e)
                continue
            for e in listed:
                try:
                    if e.is_dir(follow_symlinks=self.follow):
                        pruned = is_pruned(e.name, self.skip_dev)
                        st = e.stat(follow_symlinks=self.follow)
                        yield self._row(part.root, e.path, e.name, True, depth + 1, pruned, st)
                        if part.deep and not pruned and (st.st_dev, st.st_ino) not in seen:
                            if self.follow:
                                seen.add((st.st_dev, st.st_ino))
                            stack.append((e.path, depth + 1, st.st_dev, st.st_ino))
                    elif e.is_file(follow_symlinks=self.follow):
                        yield self._row(part.root, e.path, e.name, False, depth + 1, False, e.stat(follow_symlinks=self.follow))
                except OSError as error:
                    yield self._row(part.root, e.path, e.name, False, depth + 1, False, None, error)
        if told and entered % K.PROGRESS_DIRS:
            told(entered % K.PROGRESS_DIRS)


class TestingReader(InventoryReader):
    """Spark takes a reader with this method only where pushing filters is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the tests that rows can be given here (sizes, names, paths, kinds); Spark keeps the others."""
        for f in filters:
            test = row_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def row_test(f: Filter) -> Callable[[tuple], bool] | None:
    """A test of a row for one of Spark's filters; None for those that aren't known here.  A null passes none but its own."""
    if isinstance(f, Not):
        inner, child = row_test(f.child), f.child
        if inner is None or isinstance(child, Not):
            return None
        at = _COLUMNS.index(child.attribute[0])
        return lambda r: isinstance(child, IsNull | IsNotNull) and not inner(r) or r[at] is not None and not inner(r)
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in _COLUMNS:
        return None
    at, value = _COLUMNS.index(f.attribute[0]), getattr(f, "value", None)
    if isinstance(f, IsNull | IsNotNull):
        null = isinstance(f, IsNull)
        return lambda r: (r[at] is None) == null
    known = {
        EqualTo: lambda v: v == value, GreaterThan: lambda v: v > value, GreaterThanOrEqual: lambda v: v >= value, LessThan: lambda v: v < value,
        LessThanOrEqual: lambda v: v <= value, In: lambda v: v in value, StringStartsWith: lambda v: v.startswith(value),
        StringEndsWith: lambda v: v.endswith(value), StringContains: lambda v: value in v,
    }
    test = known.get(type(f))
    if test is None or (isinstance(f, In) and None in value):
        return None
    if type(f) in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and isinstance(value, str):
        return None  # Spark orders texts by bytes
    return lambda r: r[at] is not None and test(r[at])


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        options = dict(self.options)
        return TestingReader(options) if options.get("pushfilters") == "true" else InventoryReader(options)


def read_inventory(spark: SparkSession, roots: list[str], skip_dev_dirs: bool = False, follow_symlinks: bool = False, split_depth: int = 1) -> DataFrame:
    """Entries of all roots, each tagged with its root; overlapping roots list files twice."""
    spark.dataSource.register(InventorySource)
    reader = spark.read.format("inventory").option("roots", json.dumps([os.path.abspath(r) for r in roots]))
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    flags = {"skipDevDirs": skip_dev_dirs, "followSymlinks": follow_symlinks, "pushFilters": push}
    return reader.options(**{k: str(v).lower() for k, v in flags.items()}).option("splitDepth", str(split_depth)).load()


#: Folders that a task of a walk enters before it hands on the rest.
TASK_FOLDERS = 1024
_PENDING = SCHEMA + ", pending boolean"


def _some(options: dict[str, str], budget: int, done: Accumulator | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, spent = InventoryReader(options), [0]

        def told(n: int) -> None:
            spent[0] += n
            if done is not None:
                done.add(n)

        for pdf in batches:
            for r in pdf.to_dict("records"):
                left: list[tuple] = []
                part = Walk(os.fsdecode(bytes(r["root"])), os.fsdecode(bytes(r["folder"])), int(r["depth"]), True, bool(r["first"]))
                rows = [(*row, False) for row in reader.walk(part, max(1, budget - spent[0]), left, told)]
                for folder, depth, dev, ino in left:
                    rows.append((stored(part.root), os.fsencode(part.root).hex(), os.fsencode(folder).hex(), "", "", True, depth, False, 0, 0, _signed(dev), _signed(ino), None, False, True))
                yield pd.DataFrame(rows, columns=[*_COLUMNS, "pending"])

    return run


def walk_tree(
    spark: SparkSession, roots: list[str], skip_dev_dirs: bool = False, follow_symlinks: bool = False, task_folders: int = TASK_FOLDERS, done: Accumulator | None = None
) -> DataFrame:
    """The rows of :func:`read_inventory`, walked by rounds and written: each round's folders
    are dealt to tasks evenly, and what the tasks leave is the next round's.  So one deep or huge folder is
    many tasks' work.  A followed link's folder that was listed in an earlier round isn't entered again.
    ``done`` counts folders, 64 at a time, as tasks end."""
    options = {"roots": json.dumps([]), "skipdevdirs": str(skip_dev_dirs).lower(), "followsymlinks": str(follow_symlinks).lower()}
    begin = [(os.fsencode(os.path.abspath(r)), os.fsencode(os.path.abspath(r)), 0, True) for r in roots]
    ahead = spark.createDataFrame(begin, "root binary, folder binary, depth int, first boolean") if begin else None
    walked: list[DataFrame] = []
    wide = spark.sparkContext.defaultParallelism * 4
    while ahead is not None:
        dealt = ahead.repartition(max(1, min(wide, ahead.count())))
        walked.append(cut(dealt.mapInPandas(_some(options, task_folders, done), _PENDING), "walk-round"))
        left = walked[-1].where("pending")
        if follow_symlinks and len(walked) > 1:
            listed = reduce(DataFrame.unionByName, (w.where("is_dir and not pending").select("source_root", "dev", "ino") for w in walked[:-1])).distinct()
            left = left.dropDuplicates(["source_root", "dev", "ino"]).join(listed, ["source_root", "dev", "ino"], "left_anti")
        # A pending row holds the names as they are on disk, as hexadecimal digits.
        ahead = left.select(F.unhex("root_path").alias("root"), F.unhex("path").alias("folder"), "depth", F.lit(False).alias("first"))
        ahead = None if ahead.isEmpty() else ahead
    if not walked:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, (w.where("not pending").drop("pending") for w in walked))


def dedupe_roots(roots: list[str]) -> list[str]:
    """Roots in order of first mention."""
    return list(dict.fromkeys(roots))
