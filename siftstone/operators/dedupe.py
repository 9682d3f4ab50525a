"""Exact duplicates: groups, totals, duplicate directories, keepers and plans.

The input everywhere is ``scanned``: hash, path, normalized_path, file_name, media_kind,
source_root, size, modified_ns, dev, ino.  A hot hash (a third of all files alike) is
aggregated map-side first; windows by hash are used only where every row of the group is
part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions import scalars as S
from siftstone.sources.scratch import cut, numbered


def group_stats(files: DataFrame) -> DataFrame:
    """One row for each hash that two files or more have: media_kind and size are those of
    the first file by path."""
    first = F.min(F.struct("normalized_path", "size", "media_kind"))
    groups = files.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), first.alias("f"))
    return groups.where("copies > 1").select(
        "hash", F.col("f.media_kind").alias("media_kind"), F.col("f.size").alias("size"), "copies",
        (F.col("f.size") * (F.col("copies") - 1)).alias("wasted_bytes"),
    )


def ordered(groups: DataFrame) -> DataFrame:
    """Most wasted bytes first, then larger files, then hash."""
    return groups.orderBy(F.desc("wasted_bytes"), F.desc("size"), "hash")


def group_members(files: DataFrame) -> DataFrame:
    """The files of all groups with their group's figures; an equi-join, so that a hot
    group's rows stay spread and none is collected into a list."""
    return files.join(group_stats(files).select("hash", "copies", F.col("size").alias("group_size"), F.col("media_kind").alias("group_kind"), "wasted_bytes"), "hash")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """The nested report form: each group with its files, sorted by path.  A list holds a
    whole group; for groups beyond one task's memory use :func:`group_members`."""
    row = F.struct("normalized_path", "path", "file_name", "media_kind", "source_root", "size", "modified_ns")
    lists = group_members(files).groupBy("hash").agg(F.array_sort(F.collect_list(row)).alias("files"))
    return ordered(group_stats(files).join(lists, "hash"))


def report_totals(files: DataFrame) -> DataFrame:
    """One row: files, files in groups (keepers too), wasted bytes, the largest file in a group."""
    total = files.agg(F.count(F.lit(1)).alias("total_files"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = group_stats(files).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), zero(F.sum("copies")).alias("total_duplicate_files"),
        zero(F.sum("wasted_bytes")).alias("total_wasted_bytes"), zero(F.max("size")).alias("largest_single_file_in_dup"),
    )
    key = F.lit(1).alias("k")
    return total.select("*", key).join(groups.select("*", key), "k").drop("k")


def _named(files: DataFrame, folder: Column | None) -> DataFrame:
    """(dir, file_name, hash, bytes): of several files of one name the greatest path's hash."""
    dirs = files.withColumn("dir", S.parent("normalized_path") if folder is None else folder)
    return dirs.groupBy("dir", "file_name").agg(F.max_by("hash", F.struct("normalized_path", "hash")).alias("hash"), F.sum("size").alias("bytes"))


def signatures(files: DataFrame, folder: Column | None = None) -> DataFrame:
    """(dir, signature, file_count, total_bytes): digest of each folder's direct names and
    hashes in name order.  Of up to ``CHUNK_NAMES`` names it is the digest of their list; the names of a larger
    folder are cut into lists of that many, and it is the digest of the lists' digests, so no task holds a folder."""
    names = _named(files, folder)
    return _signed(names, names.groupBy("dir").agg(F.count(F.lit(1)).alias("n")))


#: Names in one list of a folder's signature.
CHUNK_NAMES = 4096


def _digest(rows: DataFrame, by: list[str]) -> DataFrame:
    mark = F.lit("\u0000")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("file_name", "hash"))), lambda p: F.concat(p["file_name"], mark, p["hash"], mark))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(pairs, ""), 256).alias("signature"), F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"))


def _signed(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """Signatures of the folders in ``sizes`` (dir, n)."""
    sizes = cut(sizes, "folder-sizes")
    small = _digest(names.join(sizes.where(F.col("n") <= CHUNK_NAMES), "dir", "left_semi"), ["dir"])
    large = sizes.where(F.col("n") > CHUNK_NAMES)
    if large.isEmpty():
        return small
    lain = numbered(names.join(large, "dir", "left_semi"), "dir", "file_name", tag="folder-names")
    chunks = _digest(lain.withColumn("chunk", F.floor((F.col("k") - 1) / CHUNK_NAMES)), ["dir", "chunk"])
    digests = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "signature"))), lambda x: x["signature"])
    whole = chunks.groupBy("dir").agg(F.sha2(F.array_join(digests, ""), 256).alias("signature"), F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"))
    return small.unionByName(whole)


def _twins(names: DataFrame) -> DataFrame:
    """(dir, n): folders that share the number of their names and two sums of their hashes with
    another.  Sums are partial in each task, so a folder with most of all files is one row a
    task, and it is listed only if another folder may have the same files."""
    sums = [F.sum(F.xxhash64(*([F.lit(1)] * k), "file_name", "hash").cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    prints = names.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), *sums)
    key = ["n", "s0", "s1"]
    several = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*key)
    return prints.join(several, key, "left_semi").select("dir", "n")


def duplicate_dirs(files: DataFrame, folder: Column | None = None) -> DataFrame:
    """Sets of folders with equal direct contents; figures are those of the first folder."""
    names = _named(files, folder)
    sets = _signed(names, _twins(names)).groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_dirs"), F.array_sort(F.collect_list("dir")).alias("dirs"), F.min(F.struct("dir", "file_count", "total_bytes")).alias("f")
    )
    out = sets.where("n_dirs > 1").select(
        F.substring("signature", 1, 12).alias("signature"), "dirs", F.col("f.file_count").alias("file_count"), F.col("f.total_bytes").alias("total_bytes"),
        (F.col("f.total_bytes") * (F.col("n_dirs") - 1)).alias("wasted_bytes"),
    )
    return out.orderBy(F.desc("wasted_bytes"), F.desc("file_count"), "signature")


def keepers(files: DataFrame, rule: str = "shortest_path") -> DataFrame:
    """(hash, keeper path, dev, ino, copies) of each group, by one aggregate: the best of a
    group is a minimum, so no window sorts the group."""
    if rule not in K.KEEPER_REASONS:
        raise ValueError(f"unknown keeper rule {rule}")
    n, t = F.octet_length("normalized_path"), F.col("modified_ns")
    rows = files.where("hash is not null")
    tail = [F.col(c) for c in ("normalized_path", "path", "dev", "ino", "source_root")]
    if rule == "longest_path":
        best = F.max(F.struct(n.alias("n"), *tail))
    else:
        lead = {"shortest_path": [], "oldest": [t.alias("t")], "newest": [(-t).alias("t")]}[rule]
        best = F.min(F.struct(*lead, n.alias("n"), *tail))
    out = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), best.alias("b")).where("copies > 1")
    return out.select("hash", "copies", *(F.col(f"b.{c}").alias(f"keeper_{c}") for c in ("normalized_path", "path", "dev", "ino")))


def plan(files: DataFrame, rule: str = "shortest_path") -> DataFrame:
    """(hash, path, normalized_path, size, action, reason) for every file of every group.

    The keeper and its hardlinks are kept, the rest is to be quarantined.  Where a path is
    listed twice (overlapping roots), the row that isn't the keeper's own is a hardlink of
    it, or a duplicate if the file's identity is unknown.
    """
    rows = files.join(keepers(files, rule), "hash")
    # Only rows at the keepers' own paths are ranked, to find the one row that is the keeper.
    same = F.col("normalized_path") == F.col("keeper_normalized_path")
    w = Window.partitionBy("hash", "normalized_path").orderBy("path", "source_root")
    rows = rows.where(same).withColumn("turn", F.row_number().over(w)).unionByName(rows.where(~same).withColumn("turn", F.lit(0)))
    is_keeper = F.col("turn") == 1
    linked = (F.col("ino") != 0) & (F.col("ino") == F.col("keeper_ino")) & (F.col("dev") == F.col("keeper_dev"))
    reason = F.when(is_keeper, K.KEEPER_REASONS[rule]).when(linked, K.HARDLINK_REASON).otherwise(K.DUPLICATE_REASON)
    action = F.when(is_keeper | linked, "keep").otherwise("quarantine")
    return rows.select("hash", "path", "normalized_path", "size", action.alias("action"), reason.alias("reason"))


def plan_counts(plan_rows: DataFrame) -> DataFrame:
    """(hash, keepers, victims, would_delete_unique): the check before anything is moved."""
    by = plan_rows.groupBy("hash").agg(F.count_if(F.col("action") == "keep").alias("keepers"), F.count_if(F.col("action") == "quarantine").alias("victims"))
    return by.withColumn("would_delete_unique", (F.col("keepers") == 0) & (F.col("victims") > 0))


def plan_summary(plan_rows: DataFrame) -> DataFrame:
    freed = F.sum(F.when(F.col("action") == "quarantine", F.col("size")).otherwise(0))
    return plan_rows.agg(
        F.count_if(F.col("action") == "keep").alias("n_keep"), F.count_if(F.col("action") == "quarantine").alias("n_quarantine"),
        F.coalesce(freed, F.lit(0)).alias("bytes_to_free"),
    )


def with_overrides(plan_rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """A plan with the actions of ``overrides`` (normalized_path, action) in place of its own."""
    new = overrides.select("normalized_path", F.col("action").alias("new_action"))
    joined = plan_rows.join(new, "normalized_path", "left")
    return joined.withColumn("action", F.coalesce("new_action", "action")).select(plan_rows.columns)


def plan_preview(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.select("normalized_path", S.preview_line("action", "size", "path", "reason").alias("line"))


def planned_members(files: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Files of groups with their planned action; without a plan entry: quarantine."""
    chosen = plan_rows.groupBy("normalized_path").agg(F.min("action").alias("action"))
    joined = group_members(files).join(chosen, "normalized_path", "left")
    return joined.withColumn("action", F.coalesce("action", F.lit("quarantine")))


def waste_by_extension(files: DataFrame, top: int = K.TOP_EXTENSIONS) -> DataFrame:
    """Bytes of all but each group's first file, by extension: the largest ``top`` and the rest together."""
    rows = group_members(files).join(group_stats_first(files), "hash")
    same = F.col("normalized_path") == F.col("first_path")
    turn = F.row_number().over(Window.partitionBy("hash", "normalized_path").orderBy("path", "source_root"))
    again = rows.where(same).withColumn("turn", turn).where("turn > 1").drop("turn")
    spare = rows.where(~same).unionByName(again)
    sums = spare.groupBy(S.file_ext("path").alias("ext")).agg(F.sum("size").alias("bytes"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bytes"), "ext")))
    name = F.when(F.col("rank") <= top, F.col("ext")).otherwise("other")
    return ranked.groupBy(name.alias("ext"), F.least("rank", F.lit(top + 1)).alias("rank")).agg(F.sum("bytes").alias("wasted_bytes"))


def group_stats_first(files: DataFrame) -> DataFrame:
    return files.where("hash is not null").groupBy("hash").agg(F.min("normalized_path").alias("first_path"))


def compare_roots(files: DataFrame) -> DataFrame:
    """Groups over the union of roots, with the number of roots each spans.  A group may
    lie wholly inside one root, as in the two-folder comparison."""
    return group_stats(files).join(files.groupBy("hash").agg(F.count_distinct("source_root").alias("n_roots")), "hash")


def only_across_roots(files: DataFrame) -> DataFrame:
    """Extension: groups with files in two roots at least."""
    return compare_roots(files).where("n_roots > 1")
