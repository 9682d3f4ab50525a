"""The hash cache: lookups with precedence, moves, and changes of the stored tables.

``entries`` are walked files; ``bank`` is the cache: id, hash, path, normalized_path,
file_name, source_root, size, modified_ns, and what else it stores; ``live`` are the paths
that exist now.  All lookups read one state of the bank; changes return a new state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions import scalars as S
from siftstone.sources.scratch import cut, numbered

SNAPSHOT = ["hash", "path", "normalized_path", "file_name", "source_root", "size", "modified_ns"]


def live_only(bank: DataFrame, live: DataFrame) -> DataFrame:
    """The bank with ``path_exists``; the live paths are the current inventory."""
    here = live.select("normalized_path").distinct().withColumn("path_exists", F.lit(True))
    return bank.join(here, "normalized_path", "left").na.fill(False, ["path_exists"])


def lookup(entries: DataFrame, bank: DataFrame) -> DataFrame:
    """Entries with hit_kind (primary, filename, miss), hash, moved_from and stale_ignored.

    Primary: path, size and time agree.  Filename: name, size and time agree, with the row
    of the smallest id.  A legacy hash is no hit: on the primary row it ends the search; a
    filename hit whose other path still exists is none either.  ``bank`` needs
    ``path_exists``.
    """
    own = bank.select(F.col("normalized_path"), "size", "modified_ns", F.col("hash").alias("p_hash"))
    by_name = bank.groupBy("file_name", "size", "modified_ns").agg(F.min(F.struct("id", "hash", "normalized_path", "path", "path_exists")).alias("f"))
    rows = entries.join(own, ["normalized_path", "size", "modified_ns"], "left").join(by_name, ["file_name", "size", "modified_ns"], "left")
    primary = F.col("p_hash").isNotNull()
    named = F.col("f").isNotNull() & ~primary
    other = F.col("f.normalized_path") != F.col("normalized_path")
    usable = named & ~S.is_legacy_hash("f.hash") & ~(other & F.col("f.path_exists"))
    kind = F.when(primary & ~S.is_legacy_hash("p_hash"), "primary").when(usable, "filename").otherwise("miss")
    out = rows.withColumn("hit_kind", kind).withColumn("stale_ignored", F.coalesce((primary | named) & (F.col("hit_kind") == "miss"), F.lit(False)))
    found = F.when(F.col("hit_kind") == "primary", F.col("p_hash")).when(F.col("hit_kind") == "filename", F.col("f.hash"))
    came = F.when((F.col("hit_kind") == "filename") & other, F.col("f.path"))
    taken = F.when((F.col("hit_kind") == "filename") & other, F.col("f.normalized_path"))
    return out.select(entries.columns + ["hit_kind", "stale_ignored", found.alias("hash"), came.alias("moved_from"), taken.alias("claimed")])


def counters(looked: DataFrame) -> DataFrame:
    """Cache counters of each root, and of all with a null root."""
    return looked.rollup("source_root").agg(
        F.count_if(F.col("hit_kind") != "miss").alias("cache_hits"), F.count_if(F.col("hit_kind") == "miss").alias("cache_misses"),
        F.count_if("stale_ignored").alias("stale_ignored"), F.count_if(F.col("moved_from").isNotNull()).alias("moved_reused"),
    )


def with_hashes(misses: DataFrame, hashed: DataFrame) -> DataFrame:
    """Misses with what hashing gave for their paths; the hash of a file in error is null."""
    return misses.drop("hash").join(hashed, "path")


def outcome_counters(scanned: DataFrame) -> DataFrame:
    """What a scan saved, reused, computed and read, for each root and, with a null root, for all.
    ``scanned``: source_root, size, computed, moved_from."""
    reused, size = ~F.col("computed") | F.col("moved_from").isNotNull(), F.col("size")
    return scanned.rollup("source_root").agg(
        F.count_if("computed").alias("new_hashes_saved"), F.count_if(reused).alias("hashes_reused"), F.count_if("computed").alias("hashes_computed"),
        F.count_if(F.col("moved_from").isNotNull()).alias("moved_reused"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_seen"),
        F.coalesce(F.sum(F.when(F.col("computed"), size)), F.lit(0)).alias("bytes_hashed"),
    )


def moves_by_hash(hashed: DataFrame, bank: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Files (normalized_path, hash) new to the cache, with ``moved_from``: the k-th file of
    a hash, by path, takes the k-th stale row of that hash, by id; no row twice.

    Stale rows have no live path.  Rows that a filename hit has ``claimed`` are gone.  A hash that a third of
    all files have is no task's: see :func:`numbered`.
    """
    stale = bank.where("not path_exists").select("hash", "id", F.col("normalized_path").alias("moved_from"))
    if claimed is not None:
        stale = stale.join(claimed.select(F.col("claimed").alias("moved_from")).where("moved_from is not null").distinct(), "moved_from", "left_anti")
    # Written, as each is counted and ranked: what is left of both is what moved, at most.
    new = cut(hashed.select("hash", "normalized_path").join(stale.select("hash").distinct(), "hash", "left_semi"), "moves-new")
    stale = cut(stale.join(new.select("hash").distinct(), "hash", "left_semi"), "moves-stale")

    of_new, of_stale = numbered(new, "hash", "normalized_path", tag="moves"), numbered(stale, "hash", "id", tag="moves")
    return of_new.join(of_stale, ["hash", "k"]).select("normalized_path", "hash", "moved_from")


def upsert_files(bank: DataFrame, seen: DataFrame, scan_id: int | Column, now: str | Column) -> DataFrame:
    """The cache with ``seen`` files by path: first_seen_ts of a known path stays, the rest
    is replaced; new paths get ids after the greatest, in path order."""
    now = F.lit(now) if isinstance(now, str) else now
    scan = F.lit(scan_id).cast("long") if isinstance(scan_id, int) else scan_id
    fresh = seen.groupBy("normalized_path").agg(F.max(F.struct(*(c for c in SNAPSHOT if c != "normalized_path"))).alias("s"))
    fresh = fresh.select("normalized_path", *(F.col(f"s.{c}").alias(f"new_{c}") for c in SNAPSHOT if c != "normalized_path"))
    both = bank.join(fresh, "normalized_path", "full")
    new = F.col("new_hash").isNotNull()
    out = both.select(
        "id", *(F.when(new, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c != "normalized_path" else F.col(c) for c in SNAPSHOT),
        F.coalesce("first_seen_ts", now).alias("first_seen_ts"), F.when(new, now).otherwise(F.col("last_seen_ts")).alias("last_seen_ts"),
        F.when(new, scan).otherwise(F.col("last_scan_id")).alias("last_scan_id"),
    )
    return _numbered(out, bank)


def _numbered(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Null ids become consecutive numbers after the bank's greatest.  Numbers are dealt by
    ranges: counts of hash buckets give each bucket its start, so no task sorts all rows."""
    new = rows.where("id is null").withColumn("b", F.pmod(F.xxhash64("normalized_path"), F.lit(1024)))
    starts = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.orderBy("b")) - F.col("n")).select("b", "start")
    top = bank.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    turn = F.row_number().over(Window.partitionBy("b").orderBy("normalized_path"))
    given = new.withColumn("turn", turn).join(starts, "b").withColumn("k", F.lit(1)).join(top.withColumn("k", F.lit(1)), "k")
    filled = given.withColumn("id", F.col("top") + F.col("start") + F.col("turn"))
    return rows.where("id is not null").unionByName(filled.select(rows.columns))


def upsert_snapshot(snapshot: DataFrame, seen: DataFrame, scan_id: int) -> DataFrame:
    """Per-scan snapshot rows by (scan_id, normalized_path)."""
    rows = seen.groupBy("normalized_path").agg(F.max(F.struct(*(c for c in SNAPSHOT if c != "normalized_path"))).alias("s"))
    rows = rows.select(F.lit(scan_id).cast("long").alias("scan_id"), *(F.col("normalized_path") if c == "normalized_path" else F.col(f"s.{c}").alias(c) for c in SNAPSHOT))
    kept = snapshot.join(rows.select("scan_id", "normalized_path"), ["scan_id", "normalized_path"], "left_anti")
    return kept.unionByName(rows.select(snapshot.columns))


def relocate(bank: DataFrame, moves: DataFrame, scan_id: int, now: str) -> DataFrame:
    """The cache after moves (moved_from, path, normalized_path, file_name, source_root):
    a moved row keeps id, hash, size, time and first_seen_ts; a row already at the new path
    gets the hash and keeps its size and time.  Of moves of one row the first, by new path, counts."""
    first = cut(moves.groupBy("moved_from").agg(F.min(F.struct("normalized_path", "path", "file_name", "source_root")).alias("m")), "relocate-moves")
    old = bank.join(first.withColumnRenamed("moved_from", "normalized_path"), "normalized_path")
    target = old.select(
        "id", "hash", F.col("m.path").alias("path"), F.col("m.normalized_path").alias("normalized_path"), F.col("m.file_name").alias("file_name"),
        F.col("m.source_root").alias("source_root"), "size", "modified_ns", "first_seen_ts", F.lit(now).alias("last_seen_ts"), F.lit(scan_id).cast("long").alias("last_scan_id"),
    )
    stay = bank.join(first.select(F.col("moved_from").alias("normalized_path")), "normalized_path", "left_anti")
    meets = stay.select("normalized_path", F.col("id").alias("o_id"), F.col("size").alias("o_size"), F.col("modified_ns").alias("o_ns"), F.col("first_seen_ts").alias("o_ts"))
    joined = target.join(meets, "normalized_path", "left")
    moved = joined.select(
        F.coalesce("o_id", "id").alias("id"), "hash", "path", "normalized_path", "file_name", "source_root", F.coalesce("o_size", "size").alias("size"),
        F.coalesce("o_ns", "modified_ns").alias("modified_ns"), F.coalesce("o_ts", "first_seen_ts").alias("first_seen_ts"), "last_seen_ts", "last_scan_id",
    )
    rest = stay.join(target.select("normalized_path"), "normalized_path", "left_anti")
    return rest.select(moved.columns).unionByName(moved)


def delete_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """A stored table (cache or snapshot) without these paths."""
    return table.join(paths.select("normalized_path").distinct(), "normalized_path", "left_anti").select(table.columns)


def legacy_rows(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: the number of stored rows with a legacy hash, in both tables."""
    marks = files.select("hash").unionAll(snapshot.select("hash"))
    return marks.agg(F.count_if(S.is_legacy_hash("hash")).alias("legacy_rows"))


def purge_legacy(files: DataFrame) -> DataFrame:
    """The cache without legacy rows, its scan references cleared."""
    return files.where(~S.is_legacy_hash("hash")).withColumn("last_scan_id", F.lit(None).cast("long"))


def records_for_hash(bank: DataFrame, limit: int = K.HASH_PROBE) -> DataFrame:
    """The first rows of each hash by id: an ordered limit that Spark applies before the shuffle too."""
    turn = F.row_number().over(Window.partitionBy("hash").orderBy("id"))
    return bank.withColumn("turn", turn).where(F.col("turn") <= limit).drop("turn")


def memory_stats(folders: DataFrame, files: DataFrame, scans: DataFrame) -> DataFrame:
    """One row: folders, files, distinct and duplicate hashes, the last finished scan's end.
    One aggregation by hash gives the three counts of files."""
    per = files.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    f = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count("hash").alias("distinct_hashes"), F.count_if((F.col("n") > 1) & F.col("hash").isNotNull()).alias("duplicate_hashes"))
    d = folders.agg(F.count(F.lit(1)).alias("folders"))
    s = scans.where("ended_ts is not null").agg(F.max_by("ended_ts", "id").alias("last_scan_ts"))
    k = F.lit(1).alias("k")
    return d.select("*", k).join(f.select("*", k), "k").join(s.select("*", k), "k").drop("k")


def recent_scans(scans: DataFrame, limit: int = K.RECENT_SCANS) -> DataFrame:
    return scans.orderBy(F.desc("id")).limit(limit)


SCAN_FIGURES = ["files_seen", "bytes_seen", "hashes_reused", "hashes_computed", "duplicate_groups", "wasted_bytes"]


def start_scan(scans: DataFrame, mode: str, roots: list[str], now: str) -> DataFrame:
    """The history with one more scan, which hasn't ended and counts nothing yet."""
    row = scans.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).withColumns(
        {"started_ts": F.lit(now), "ended_ts": F.lit(None).cast("string"), "mode": F.lit(mode), "roots": F.array(*map(F.lit, roots)).cast("array<string>")}
        | {c: F.lit(0).cast("long") for c in SCAN_FIGURES}
    )
    return scans.unionByName(row.select(scans.columns))


def finish_scan(scans: DataFrame, mine: Column, now: str, **figures: int) -> DataFrame:
    """The history with some scans ended; figures that aren't given are 0, as for a scan that failed."""
    given = {c: F.when(mine, F.lit(int(figures.get(c, 0))).cast("long")).otherwise(F.col(c)) for c in SCAN_FIGURES}
    return scans.withColumns({"ended_ts": F.when(mine, F.lit(now)).otherwise(F.col("ended_ts"))} | given)


def list_folders(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.desc_nulls_last("last_scan_ts"), F.desc("id"))


def peek_folder(folders: DataFrame, normalized: str) -> DataFrame:
    return folders.where(F.col("normalized_path") == normalized)


def remember_folders(folders: DataFrame, roots: DataFrame, now: str) -> DataFrame:
    """Upsert by normalized_path: a known folder gets the new display path alone."""
    new = roots.select("normalized_path", F.col("path").alias("new_path")).groupBy("normalized_path").agg(F.max("new_path").alias("new_path"))
    both = folders.join(new, "normalized_path", "full")
    zero = F.lit(0).cast("long")
    out = both.select(
        "id", F.coalesce("new_path", "path").alias("path"), "normalized_path", F.coalesce("first_seen_ts", F.lit(now)).alias("first_seen_ts"), "last_scan_ts",
        F.coalesce("last_file_count", zero).alias("last_file_count"), F.coalesce("last_total_bytes", zero).alias("last_total_bytes"),
    )
    return _numbered(out, folders)


def update_folder_stats(folders: DataFrame, stats: DataFrame, now: str) -> DataFrame:
    """New last-scan figures (normalized_path, file_count, total_bytes) of known folders."""
    s = stats.select("normalized_path", F.col("file_count").alias("n"), F.col("total_bytes").alias("b"))
    hit = F.col("n").isNotNull()
    return folders.join(s, "normalized_path", "left").select(
        "id", "path", "normalized_path", "first_seen_ts", F.when(hit, F.lit(now)).otherwise(F.col("last_scan_ts")).alias("last_scan_ts"),
        F.coalesce("n", "last_file_count").alias("last_file_count"), F.coalesce("b", "last_total_bytes").alias("last_total_bytes"),
    )


def forget_folder(folders: DataFrame, normalized: str) -> DataFrame:
    """The folder's row goes; hashes cached below it stay."""
    return folders.where(F.col("normalized_path") != normalized)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extension: new, changed, moved, gone and same files between two scans' snapshots."""
    a = old.select("normalized_path", F.col("hash").alias("old_hash"))
    b = new.select("normalized_path", F.col("hash").alias("new_hash"))
    both = a.join(b, "normalized_path", "full")
    known = old.select(F.col("hash").alias("new_hash")).distinct().withColumn("known", F.lit(True))
    state = (
        F.when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash").isNotNull() & (F.col("old_hash") == F.col("new_hash")), "same")
        .when(F.col("old_hash").isNotNull(), "changed").when(F.col("known"), "moved").otherwise("new")
    )
    return both.join(known, "new_hash", "left").select("normalized_path", state.alias("state"))
