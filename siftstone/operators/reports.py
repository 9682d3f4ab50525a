"""Exports, simulated runs and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions import scalars as S
from siftstone.operators.dedupe import group_members
from siftstone.sources.scratch import numbered


def export_rows(files: DataFrame) -> DataFrame:
    """The report's rows, in report order: one for each file of each group."""
    rows = group_members(files).select(
        "hash", F.col("group_kind").alias("media_kind"), F.col("group_size").alias("group_size_bytes"), "copies", "wasted_bytes", "path", "normalized_path", "source_root"
    )
    return rows.orderBy(F.desc("wasted_bytes"), F.desc("group_size_bytes"), "hash", "normalized_path")


def export_lines(files: DataFrame) -> DataFrame:
    """The report's CSV lines without the header."""
    texts = {"path", "normalized_path", "source_root"}
    cells = [S.csv_field(c) if c in texts else F.col(c).cast("string") for c in K.REPORT_COLUMNS]
    return export_rows(files).select("hash", "normalized_path", F.concat_ws(",", *cells).alias("line"))


def quarantine_names(plan_rows: DataFrame) -> DataFrame:
    """A first guess at flat names: the k-th victim of a name, by path, gets ``_k``.  Names
    that files already have are settled when files are moved.  One name may be most files'."""
    victims, k = numbered_victims(plan_rows), F.col("k")
    ext, stem = S.extension("name"), S.stem("name")
    tail = F.when(ext.isNull(), "").otherwise(F.concat(F.lit("."), ext))
    later = F.concat(stem, F.lit("_"), F.col("k").cast("string"), tail)
    return victims.select("normalized_path", F.when(F.col("k") == 1, F.col("name")).otherwise(later).alias("quarantine_name"))


def numbered_victims(plan_rows: DataFrame) -> DataFrame:
    """The victims, all their columns, with ``name`` and ``k``, the victim's number among those of its name, by path."""
    return numbered(plan_rows.where("action = 'quarantine'").withColumn("name", S.file_name("path")), "name", "normalized_path", tag="victims")


def simulate_apply(plan_rows: DataFrame, on_disk: DataFrame) -> DataFrame:
    """What applying a plan would do to each victim: (normalized_path, size, status, reason).

    ``on_disk``: normalized_path, current_hash of what exists now.  A victim that is gone
    is skipped; one whose content differs from its keeper's fails; the others move.  The
    keeper is the last kept row of the hash, in path order.
    """
    disk = on_disk.select("normalized_path", "current_hash")
    keeper = plan_rows.where("action = 'keep'").groupBy("hash").agg(F.max(F.struct("normalized_path", "path")).alias("k"))
    keeper = keeper.select("hash", F.col("k.path").alias("keeper"), F.col("k.normalized_path").alias("kp"))
    keeper = keeper.join(disk.select(F.col("normalized_path").alias("kp"), F.col("current_hash").alias("keeper_hash")), "kp", "left")
    rows = plan_rows.where("action = 'quarantine'").join(disk, "normalized_path", "left").join(keeper, "hash", "left")
    gone, lost = F.col("current_hash").isNull(), F.col("keeper").isNotNull() & F.col("keeper_hash").isNull()
    differs = F.col("keeper").isNotNull() & (F.col("current_hash") != F.col("keeper_hash"))
    status = F.when(gone, "skipped").when(lost | differs, "failed").otherwise("moved")
    reason = (
        F.when(gone, K.REASON_GONE).when(lost, F.concat(F.lit(K.REASON_VERIFY), "keeper", F.lit(" no longer exists")))
        .when(differs, F.concat(F.lit(K.REASON_DIFFERS), "keeper"))
    )
    return rows.select("hash", "path", "normalized_path", "size", status.alias("status"), reason.alias("reason"))


def apply_totals(simulated: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """One row: quarantined, failed, bytes_freed, kept; a skipped victim counts as failed,
    unless it was skipped by cancellation, which counts as not processed."""
    canceled = F.coalesce(F.col("reason") == K.REASON_CANCELED, F.lit(False))
    k = F.lit(1).alias("k")
    t = simulated.agg(
        F.count_if(F.col("status") == "moved").alias("quarantined"), F.count_if((F.col("status") != "moved") & ~canceled).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "moved", F.col("size"))), F.lit(0)).alias("bytes_freed"), F.count_if(canceled).alias("not_processed"),
    )
    kept = plan_rows.agg(F.count_if(F.col("action") == "keep").alias("kept"))
    return t.select("*", k).join(kept.select("*", k), "k").drop("k")


def restorable(manifest_rows: DataFrame) -> DataFrame:
    """Manifest rows that an undo restores."""
    status = F.coalesce("status", F.lit(""))
    return manifest_rows.where(status.isin("", "moved") & (F.coalesce("quarantine_path", F.lit("")) != ""))


def simulate_undo(manifest_rows: DataFrame, on_disk: DataFrame) -> DataFrame:
    """What an undo would do with each row it restores: it fails where the file has left the
    quarantine, and where a file is at its old place again.  ``on_disk``: path."""
    here = on_disk.select("path").distinct()
    held = here.select(F.col("path").alias("quarantine_path"), F.lit(True).alias("held"))
    taken = here.select(F.col("path").alias("original_path"), F.lit(True).alias("taken"))
    rows = restorable(manifest_rows).join(held, "quarantine_path", "left").join(taken, "original_path", "left")
    fine = F.col("held").isNotNull() & F.col("taken").isNull()
    return rows.withColumn("outcome", F.when(fine, "restored").otherwise("failed")).drop("held", "taken")


def undo_totals(simulated: DataFrame) -> DataFrame:
    return simulated.agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("restored", "failed")))


def quarantine_lines(manifest_rows: DataFrame) -> DataFrame:
    """Manifest rows with ``line``: their lines in the quarantine log."""
    texts = {c: S.csv_field(F.coalesce(c, F.lit(""))) for c in ("moved_ts", "status", "original_path", "quarantine_path", "hash", "reason")}
    cells = [texts["moved_ts"], texts["status"], texts["original_path"], texts["quarantine_path"], F.col("size").cast("string"), texts["hash"], texts["reason"]]
    return manifest_rows.withColumn("line", F.concat_ws(",", *cells))


def in_folder(folder: Column, path: Column) -> Column:
    """Whether a path is a manifest below the folder once ``.`` and ``..`` are resolved by text."""
    return S.is_under(folder, path) & path.endswith(".json")


def log_tail(log: DataFrame, since: int, ring: int = K.LOG_RING) -> DataFrame:
    """Log rows after a cursor (rows ever written), no older than the ring's start.

    ``seq`` counts from 0.  The ring's start comes from one maximum, not from a sort.
    """
    top = log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).withColumn("k", F.lit(1))
    rows = log.withColumn("k", F.lit(1)).join(F.broadcast(top), "k")  # one row
    return rows.where(F.col("seq") >= F.greatest(F.lit(since), F.col("n") - ring)).drop("k", "n")


def log_ring(log: DataFrame, ring: int = K.LOG_RING) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(ring)
