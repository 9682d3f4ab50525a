"""Filters and tallies over walked entries.

``entries``: source_root, path, normalized_path, file_name, dir, is_dir, depth, pruned,
size, modified_ns, dev, ino, error - one row for each file and directory that a walk met.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions import scalars as S


@dataclass
class ScanOptions:
    """Unfiltered by default; :meth:`interactive` has what a user's scan starts from."""

    min_size: int = 0
    skip_dev_dirs: bool = False
    exclude: list[str] = field(default_factory=list)
    media_only: bool = False
    follow_symlinks: bool = False

    def __post_init__(self) -> None:
        self.min_size = max(0, int(self.min_size or 0))
        self.exclude = [e.strip() for e in self.exclude if e and e.strip()]

    @classmethod
    def interactive(cls, min_size: int = 0, skip_dev_dirs: bool = True, exclude=(), media_only: bool = True, follow_symlinks: bool = False, data_root: str | None = None):
        """Defaults of an interactive scan; the data root is always excluded."""
        return cls(min_size, skip_dev_dirs, [*exclude, *([data_root] if data_root else [])], media_only, follow_symlinks)


def classified(entries: DataFrame) -> DataFrame:
    return entries.withColumn("media_kind", S.media_kind("file_name"))


def excluded(path: Column | str, patterns: list[str]) -> Column:
    """True if the path has one of the substrings, whatever their case."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for x in patterns:
        if x.strip():
            out = out | F.lower(p).contains(x.strip().lower())
    return out


def drop_reason(options: ScanOptions) -> Column:
    """Why a file is left out, by the first test it fails; null if it stays."""
    out = F.when(S.is_metadata_file("file_name"), "metadata")
    if options.media_only:
        out = out.when(F.col("media_kind") == "other", "unsupported")
    out = out.when(F.coalesce(F.col("error"), F.lit("")) != "", "error")
    if options.min_size > 0:
        out = out.when(F.col("size") < options.min_size, "small")
    if options.exclude:
        out = out.when(excluded("normalized_path", options.exclude), "excluded")
    return out


def with_reasons(entries: DataFrame, options: ScanOptions) -> DataFrame:
    if "error" not in entries.columns:
        entries = entries.withColumn("error", F.lit(None).cast("string"))
    return classified(entries).withColumn("dropped", drop_reason(options))


def filtered(entries: DataFrame, options: ScanOptions) -> DataFrame:
    """The files that a scan goes on with."""
    return with_reasons(entries, options).where("dropped is null").drop("dropped", "error")


def under_pruned(entries: DataFrame, pruned: DataFrame) -> DataFrame:
    """Entries without those below a pruned folder (column ``path``), found by an equi-join
    on exploded ancestors; the pruned folders themselves stay."""
    up = entries.select("normalized_path", F.explode(S.ancestors("source_root", S.parent("normalized_path"))).alias("path"))
    below = up.join(pruned.select("path").distinct(), "path", "left_semi").select("normalized_path").distinct()
    return entries.join(below, "normalized_path", "left_anti")


def root_counters(entries: DataFrame, options: ScanOptions) -> DataFrame:
    """Counters of each root and, with a null root, of all.  Kinds are counted before the
    media, size and exclude filters; ``files_walked`` after them."""
    files = with_reasons(entries, options)
    real = F.coalesce(F.col("dropped"), F.lit("")) != "metadata"
    kept = F.col("dropped").isNull()
    out = files.rollup("source_root").agg(
        F.count_if(real & (F.col("media_kind") == "photo")).alias("photos"), F.count_if(real & (F.col("media_kind") == "video")).alias("videos"),
        F.count_if(real & (F.col("media_kind") == "other")).alias("unsupported_files"), F.count_if(kept).alias("files_walked"),
        F.count_if(F.col("dropped").isin("metadata", "unsupported", "small", "excluded")).alias("files_skipped"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes_walked"), F.count_if(F.col("dropped") == "error").alias("errors"),
    )
    return out


def folder_tallies(files: DataFrame) -> DataFrame:
    """(source_root, dir, files, supported, photos, videos): direct files of each folder,
    bookkeeping files left out, all else before any filter."""
    rows = classified(files).where(~S.is_metadata_file("file_name")).withColumn("dir", S.parent("normalized_path"))
    return rows.groupBy("source_root", "dir").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("media_kind") != "other").alias("supported"),
        F.count_if(F.col("media_kind") == "photo").alias("photos"), F.count_if(F.col("media_kind") == "video").alias("videos"),
    )


def folder_taxonomy(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Taxonomy of each root's folders, and with a null root of all roots together.

    ``dirs``: source_root, path, depth, pruned.  The root itself (depth 0) isn't counted.
    Pruned folders are discovered but not classified.  A folder with folders alone is empty.
    """
    tallies = folder_tallies(files).withColumnRenamed("dir", "path")
    rows = dirs.where("depth > 0").join(tallies, ["source_root", "path"], "left").na.fill(0, ["files", "supported", "photos", "videos"])
    seen = ~F.col("pruned")
    n = lambda c: F.count_if(c)
    out = rows.rollup("source_root").agg(
        F.count(F.lit(1)).alias("total_discovered"), n(F.col("depth") == 1).alias("top_level"), n(F.col("depth") > 1).alias("nested"),
        n(seen).alias("scanned"), n(F.col("pruned")).alias("pruned"), n(seen & (F.col("files") == 0)).alias("empty"),
        n(seen & (F.col("supported") > 0)).alias("with_supported"), n(seen & (F.col("files") > 0) & (F.col("supported") == 0)).alias("without_supported"),
        n(seen & (F.col("photos") > 0)).alias("with_photos"), n(seen & (F.col("videos") > 0)).alias("with_videos"),
        n(seen & (F.col("photos") > 0) & (F.col("videos") > 0)).alias("with_both"),
    )
    return out


def folder_map(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(source_root, path, parent, name, depth, direct_files, file_count): subtree counts.

    Each folder's direct count is exploded to its ancestors, so a deep tree is one
    aggregation, partial sums first, and no recursion.  All files but bookkeeping files
    count, before any filter.  ``dirs`` adds folders that hold no files.
    """
    direct = files.where(~S.is_metadata_file("file_name")).groupBy("source_root", S.parent("normalized_path").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    if dirs is not None:
        direct = direct.unionByName(dirs.select("source_root", F.col("path").alias("dir"), F.lit(0).cast("long").alias("n")))
    up = direct.select("source_root", "dir", "n", F.explode(S.ancestors("source_root", "dir")).alias("path"))
    own = F.sum(F.when(F.col("path") == F.col("dir"), F.col("n")).otherwise(0))
    nodes = up.groupBy("source_root", "path").agg(F.sum("n").alias("file_count"), own.alias("direct_files"))
    at_root = F.col("path") == F.col("source_root")
    return nodes.select(
        "source_root", "path", F.when(~at_root, S.parent("path")).alias("parent"), S.file_name("path").alias("name"),
        S.depth_below("source_root", "path").alias("depth"), "direct_files", "file_count",
    )


def children(nodes: DataFrame) -> DataFrame:
    """Parent and child folders with both counts, children by path."""
    up = nodes.select("source_root", F.col("path").alias("parent"), F.col("file_count").alias("parent_count"))
    return nodes.where("parent is not null").join(up, ["source_root", "parent"]).orderBy("parent", "path")


def remembered_roots(roots: DataFrame, folders: DataFrame) -> DataFrame:
    """Chosen roots (source_root) with what is remembered of each, and whether anything is."""
    known = folders.withColumnRenamed("normalized_path", "source_root").withColumn("remembered", F.lit(True))
    return roots.join(known, "source_root", "left").na.fill(False, ["remembered"])


def sample_files(files: DataFrame, cap: int = K.SAMPLE_CAP) -> DataFrame:
    """At most ``cap`` files, the first by root and path."""
    return files.orderBy("source_root", "normalized_path").limit(cap).select("path", "file_name", "media_kind", "size", "source_root")


def video_paths(files: DataFrame) -> DataFrame:
    return files.where("media_kind = 'video'").select("path")


def error_summary(errors: DataFrame, detailed: int = K.DETAILED_ERRORS) -> DataFrame:
    """Log lines for failed files (path, message, denied): the first in full, by path, then
    one line that says how many more there were, then totals."""
    top = errors.orderBy("path").limit(detailed).select(F.lit(0).alias("part"), "path", F.concat_ws(": ", "path", "message").alias("line"))
    totals = errors.agg(F.count(F.lit(1)).alias("n"), F.count_if("denied").alias("denied"))
    more = totals.where(F.col("n") > detailed).select(F.lit(1).alias("part"), F.lit("").alias("path"), F.format_string("%d further errors not listed", F.col("n") - detailed).alias("line"))
    total = totals.where("n > 0").select(F.lit(2).alias("part"), F.lit("").alias("path"), F.format_string("%d files failed, %d without permission", "n", "denied").alias("line"))
    return top.unionByName(more).unionByName(total).orderBy("part", "path").select("line")
