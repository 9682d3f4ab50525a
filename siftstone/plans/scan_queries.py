"""Registered queries over walks, folders, scans and manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import scalars as S
from siftstone.operators import cache, dedupe, inventory, reports, similar
from siftstone.operators.inventory import ScanOptions
from siftstone.plans import fixtures as X
from siftstone.plans.catalogue import _CLUSTERS, register
from siftstone.plans.fixtures import sql

# --- walks -----------------------------------------------------------------------------


@register("walk_files", sql("walk", "select source_root, normalized_path, file_name, size from walk where not bookkeeping"))
def walk_files(spark, sf_dir):
    return X.walk(spark, sf_dir).where(~S.is_metadata_file("file_name")).select("source_root", "normalized_path", "file_name", "size")


@register(
    "walk_reasons",
    sql(
        "walk",
        """select source_root, case when bookkeeping then 'metadata' when kind = 'other' then 'unsupported' when error is not null then 'error' when size < 900 then 'small'
        when contains(lower(normalized_path), '/vault/src1') then 'excluded' else 'kept' end as fate, count(*)::bigint as n, sum(size)::bigint as bytes from walk group by all""",
    ),
)
def walk_reasons(spark, sf_dir):
    """An interactive scan's tests in their order; the engine's own folder is always left out."""
    options = ScanOptions.interactive(min_size=900, data_root="/VAULT/src1")
    rows = inventory.with_reasons(X.walk(spark, sf_dir), options).withColumn("fate", F.coalesce("dropped", F.lit("kept")))
    return rows.groupBy("source_root", "fate").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register("scan_defaults", sql("walk", "select count(*)::bigint as n, sum(size)::bigint as bytes from walk where not bookkeeping and error is null"))
def scan_defaults(spark, sf_dir):
    """Without options nothing is left out but bookkeeping files and files in error; a size below zero is none."""
    kept = inventory.filtered(X.walk(spark, sf_dir), ScanOptions(min_size=-5, exclude=["  ", ""]))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register(
    "walk_error_summary",
    sql(
        "walk",
        """select line from (select normalized_path || ': ' || error as line from walk where error is not null order by normalized_path limit 20)
        union all select (count(*) - 20) || ' further errors not listed' from walk where error is not null having count(*) > 20
        union all select count(*) || ' files failed, ' || count(*) filter (where error = 'Permission denied') || ' without permission' from walk where error is not null having count(*) > 0""",
    ),
)
def walk_error_summary(spark, sf_dir):
    bad = X.walk(spark, sf_dir).where("error is not null")
    return inventory.error_summary(bad.select(F.col("normalized_path").alias("path"), F.col("error").alias("message"), (F.col("error") == "Permission denied").alias("denied")))


@register(
    "name_tests",
    sql(
        "walk",
        """select doc_id, bookkeeping as metadata_file, folder in ('.Spotlight-V100', '.Trashes') as metadata_dir, folder in ('.git', 'node_modules', 'Tool.APP') as dev_dir from walk""",
    ),
)
def name_tests(spark, sf_dir):
    w = X.walk(spark, sf_dir)
    return w.select("doc_id", S.is_metadata_file("file_name").alias("metadata_file"), S.is_metadata_dir("folder").alias("metadata_dir"), S.is_dev_dir("folder").alias("dev_dir"))


@register(
    "walk_pruned",
    sql(
        "walk",
        """select source_root, count(*) filter (where folder in ('.git', 'node_modules', 'Tool.APP', '.Spotlight-V100', '.Trashes'))::bigint as pruned_dirs, sum(files)::bigint as files_met
        from (select source_root, folder, case when folder in ('.git', 'node_modules', 'Tool.APP', '.Spotlight-V100', '.Trashes') then 0 else count(*) end as files from walk group by 1, 2) group by 1""",
    ),
)
def walk_pruned(spark, sf_dir):
    """Folders that a walk lists and doesn't enter, and the files it meets without them."""
    w = X.walk(spark, sf_dir).withColumn("dir", S.parent("normalized_path"))
    dirs = w.select("source_root", "folder", "dir").distinct().withColumn("pruned", S.is_dev_dir("folder") | S.is_metadata_dir("folder"))
    met = inventory.under_pruned(w, dirs.where("pruned").select(F.col("dir").alias("path"))).groupBy("source_root").agg(F.count(F.lit(1)).alias("files_met"))
    cut = dirs.groupBy("source_root").agg(F.count_if("pruned").alias("pruned_dirs"))
    return cut.join(met, "source_root", "left").na.fill(0, ["files_met"])


@register("file_names", sql("doc_files", "select doc_id, file_name as plain, file_name as slashed, '' as up, split_part(source_root, '/', 3) as root_name from doc_files"))
def file_names(spark, sf_dir):
    f = X.doc_files(spark, sf_dir)
    over = lambda *parts: S.file_name(F.concat("path", *map(F.lit, parts)))
    return f.select("doc_id", over().alias("plain"), over("//").alias("slashed"), over("/..").alias("up"), S.file_name("source_root").alias("root_name"))


@register("nfc_texts", "select doc_id, sha256(nfc_normalize(text || chr(101) || chr(769) || chr(8491))) as composed from documents")
def nfc_texts(spark, sf_dir):
    text = F.concat("text", F.lit("e\u0301\u212b"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.nfc(text), 256).alias("composed"))


@register(
    "map_children",
    sql(
        "doc_files",
        """, nodes as (select source_root as path, count(*)::bigint as n from doc_files group by 1 union all select regexp_replace(normalized_path, '/[^/]*$', ''), count(*)::bigint from doc_files group by 1)
        select c.path, p.path as parent, c.n as file_count, p.n as parent_count from nodes c join nodes p on regexp_replace(c.path, '/[^/]*$', '') = p.path""",
    ),
)
def map_children(spark, sf_dir):
    return inventory.children(inventory.folder_map(X.doc_files(spark, sf_dir))).select("path", "parent", "file_count", "parent_count")


# --- folders and scans -----------------------------------------------------------------

_FOLDERS = """, folders as (select id, path, normalized_path, null::varchar as first_seen_ts, last_scan_ts::varchar as last_scan_ts, (id % 50)::bigint as last_file_count, (id * 3)::bigint as last_total_bytes from folder_log)"""


def _folders(spark, sf_dir):
    f = X.folder_log(spark, sf_dir)
    return f.select(
        "id", "path", "normalized_path", F.lit(None).cast("string").alias("first_seen_ts"), F.col("last_scan_ts").cast("string").alias("last_scan_ts"),
        (F.col("id") % 50).alias("last_file_count"), (F.col("id") * 3).alias("last_total_bytes"),
    )


def _with_folders(body: str) -> str:
    return sql("folder_log", "").rstrip("\n") + _FOLDERS + "\n" + body


@register(
    "remember_folders",
    _with_folders(
        """select id, case when id % 5 = 0 then upper(path) else path end as path, normalized_path, last_file_count from folders
        union all select null, '/NEW/' || s_suppkey, '/new/' || s_suppkey, 0::bigint from supplier"""
    ),
)
def remember_folders(spark, sf_dir):
    """Known folders get a new display path, others a row; ids of new rows come after the known."""
    known = _folders(spark, sf_dir)
    again = known.where("id % 5 = 0").select("normalized_path", F.upper("path").alias("path"))
    s = X.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/new/"), "s_suppkey").alias("normalized_path"), F.concat(F.lit("/NEW/"), "s_suppkey").alias("path"))
    out = cache.remember_folders(known, again.unionByName(s), X.NOW)
    new = F.col("normalized_path").startswith("/new/")
    return out.select(F.when(~new, F.col("id")).alias("id"), "path", "normalized_path", "last_file_count")


@register(
    "update_folder_stats",
    _with_folders(
        f"""select id, case when id % 3 = 0 then '{X.NOW}' else last_scan_ts end as last_scan_ts, case when id % 3 = 0 then 7::bigint else last_file_count end as last_file_count,
        case when id % 3 = 0 then id else last_total_bytes end as last_total_bytes from folders"""
    ),
)
def update_folder_stats(spark, sf_dir):
    known = _folders(spark, sf_dir)
    stats = known.where("id % 3 = 0").select("normalized_path", F.lit(7).cast("long").alias("file_count"), F.col("id").alias("total_bytes"))
    return cache.update_folder_stats(known, stats, X.NOW).select("id", "last_scan_ts", "last_file_count", "last_total_bytes")


@register("forget_folder", _with_folders("select id, path from folders where normalized_path <> '/home/Customer#7'"))
def forget_folder(spark, sf_dir):
    return cache.forget_folder(_folders(spark, sf_dir), "/home/Customer#7").select("id", "path")


@register(
    "remembered_roots",
    sql(
        "doc_files",
        """, roots as (select distinct source_root from doc_files), remembered as (select '/vault/' || source as normalized_path, max(doc_id) as last_file_count from documents where doc_id % 2 = 0 group by 1)
        select source_root, m.normalized_path is not null as remembered, last_file_count from roots r left join remembered m on r.source_root = m.normalized_path""",
    ),
)
def remembered_roots(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    known = docs.groupBy(F.concat(F.lit("/vault/"), "source").alias("normalized_path")).agg(F.max("doc_id").alias("last_file_count"))
    roots = X.doc_files(spark, sf_dir).select("source_root").distinct()
    return inventory.remembered_roots(roots, known).select("source_root", "remembered", "last_file_count")


@register(
    "scan_history",
    sql(
        "scan_log",
        f"""select id, case when id % 10 = 1 then '{X.NOW}' else ended_ts::varchar end as ended_ts, case when id % 10 = 1 then 12 else 1 end::bigint as files_seen, case when id % 10 = 1 then 0 else 2 end::bigint as wasted_bytes from scan_log
        union all select (select max(id) from scan_log) + 1, null, 0::bigint, 0::bigint""",
    ),
)
def scan_history(spark, sf_dir):
    """A scan begins, and those whose id ends in 1 end, with the figures they are given."""
    log = X.scan_log(spark, sf_dir).withColumn("started_ts", F.col("started_ts").cast("string")).withColumn("ended_ts", F.col("ended_ts").cast("string"))
    for name, n in (("files_seen", 1), ("bytes_seen", 0), ("hashes_reused", 0), ("hashes_computed", 0), ("duplicate_groups", 0), ("wasted_bytes", 2)):
        log = log.withColumn(name, F.lit(n).cast("long"))
    log = log.withColumn("roots", F.array(F.lit("/r")))
    done = cache.finish_scan(log, F.col("id") % 10 == 1, X.NOW, files_seen=12)
    return cache.start_scan(done, "dry", ["/r"], X.NOW).select("id", "ended_ts", "files_seen", "wasted_bytes")


# --- cache -----------------------------------------------------------------------------


@register(
    "live_rows",
    sql("doc_files doc_bank", "select b.id, f.normalized_path is not null as path_exists from doc_bank b left join (select distinct normalized_path from doc_files where doc_id % 4 <> 0) f on b.normalized_path = f.normalized_path"),
)
def live_rows(spark, sf_dir):
    here = X.doc_files(spark, sf_dir).where("doc_id % 4 != 0")
    return cache.live_only(X.doc_bank(spark, sf_dir).drop("path_exists"), here).select("id", "path_exists")


_HASHED = """, hashed as (select normalized_path, size, source_root, case when doc_id % 19 = 0 then null else hash end as hash from doc_files where doc_id % 3 = 0)
"""


def _hashed(spark, sf_dir):
    f = X.doc_files(spark, sf_dir).where("doc_id % 3 = 0")
    digests = f.select("path", F.when(F.col("doc_id") % 19 != 0, F.col("hash")).alias("hash"))
    return cache.with_hashes(f.drop("hash"), digests)


@register("hashed_misses", sql("doc_files", "").rstrip("\n") + _HASHED + "select normalized_path, hash from hashed where hash is not null")
def hashed_misses(spark, sf_dir):
    """Misses with the hash that was computed; a file that couldn't be read is dropped."""
    return _hashed(spark, sf_dir).where("hash is not null").select("normalized_path", "hash")


@register(
    "outcome_counters",
    sql("doc_files", "").rstrip("\n")
    + _HASHED
    + """select source_root, count(*) filter (where computed)::bigint as hashes_computed, count(*) filter (where not computed)::bigint as hashes_reused, count(*) filter (where computed)::bigint as new_hashes_saved,
    sum(size)::bigint as bytes_seen, coalesce(sum(size) filter (where computed), 0)::bigint as bytes_hashed
    from (select source_root, size, true as computed from hashed where hash is not null union all select source_root, size, false from doc_files where doc_id % 3 <> 0) group by rollup(source_root)""",
)
def outcome_counters(spark, sf_dir):
    new = _hashed(spark, sf_dir).where("hash is not null").select("source_root", "size", F.lit(True).alias("computed"))
    old = X.doc_files(spark, sf_dir).where("doc_id % 3 != 0").select("source_root", "size", F.lit(False).alias("computed"))
    both = new.unionByName(old).withColumn("moved_from", F.lit(None).cast("string"))
    return cache.outcome_counters(both).select("source_root", "hashes_computed", "hashes_reused", "new_hashes_saved", "bytes_seen", "bytes_hashed")


@register(
    "rescan",
    sql("doc_files", "select normalized_path, case when doc_id % 13 = 0 then 'miss' else 'primary' end as hit_kind, case when doc_id % 13 = 0 then null else hash end as hash from doc_files where doc_id % 4 <> 1"),
)
def rescan(spark, sf_dir):
    """A second scan after a first one: files as they were are found by path, changed ones are misses."""
    f = X.doc_files(spark, sf_dir)
    empty = X.doc_bank(spark, sf_dir).drop("path_exists").limit(0)
    bank = cache.upsert_files(empty, f, 1, X.NOW)
    now = f.where("doc_id % 4 != 1").withColumn("modified_ns", F.when(F.col("doc_id") % 13 == 0, F.col("modified_ns") + 1).otherwise(F.col("modified_ns")))
    return cache.lookup(now.drop("hash"), cache.live_only(bank, f)).select("normalized_path", "hit_kind", "hash")


# --- reports ---------------------------------------------------------------------------


@register("group_files", sql("doc_files groups", "select hash, sha256(string_agg(normalized_path, chr(10) order by normalized_path)) as files from doc_files where hash in (select hash from groups) group by hash"))
def group_files(spark, sf_dir):
    """The nested report form: the files of each group in path order."""
    groups = dedupe.duplicate_groups(X.doc_files(spark, sf_dir))
    return groups.select("hash", F.sha2(F.array_join(F.transform("files", lambda x: x["normalized_path"]), "\n"), 256).alias("files"))


_MANIFEST = """with m as (select o_orderkey as id, 'h' || o_orderkey as hash, '/a/' || case when o_orderkey % 5 = 0 then '=1,"' else 'x' end || o_orderkey as original_path,
    case when o_orderkey % 3 = 0 then '' else '/q/' || o_orderkey end as quarantine_path, o_orderkey * 2 as size, case o_orderstatus when 'F' then 'moved' when 'P' then '' else 'skipped' end as status from orders)
"""


def _manifest(spark, sf_dir):
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("h"), k).alias("hash"), F.concat(F.lit("/a/"), F.when(k % 5 == 0, '=1,"').otherwise("x"), k).alias("original_path"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/q/"), k)).alias("quarantine_path"), (k * 2).alias("size"),
        F.when(F.col("o_orderstatus") == "F", "moved").when(F.col("o_orderstatus") == "P", "").otherwise("skipped").alias("status"),
        F.lit(X.NOW).alias("moved_ts"), F.lit(None).cast("string").alias("reason"),
    )


@register(
    "undo_totals",
    _MANIFEST + "select count(*) filter (where id % 7 <> 0 and id % 11 <> 0)::bigint as restored, count(*) filter (where id % 7 = 0 or id % 11 = 0)::bigint as failed from m where status in ('', 'moved') and quarantine_path <> ''",
)
def undo_totals(spark, sf_dir):
    """A seventh of the moved files are gone from quarantine, an eleventh find a file at their old place."""
    m = _manifest(spark, sf_dir)
    disk = m.where("id % 7 != 0").select(F.col("quarantine_path").alias("path")).unionByName(m.where("id % 11 = 0").select(F.col("original_path").alias("path")))
    return reports.undo_totals(reports.simulate_undo(m, disk))


@register(
    "quarantine_log",
    _MANIFEST
    + f"""select id, '{X.NOW}' || ',' || status || ',' || case when id % 5 = 0 then '"' || replace(original_path, '"', '""') || '"' else original_path end || ',' || quarantine_path || ',' || size || ',' || hash || ',' as line from m""",
)
def quarantine_log(spark, sf_dir):
    return reports.quarantine_lines(_manifest(spark, sf_dir)).select("id", "line")


@register(
    "manifest_guard",
    "select o_orderkey as id, o_orderkey % 3 <> 1 and o_orderkey % 2 = 0 as allowed from orders",
)
def manifest_guard(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, "/data/manifests/").when(k % 3 == 1, "/data/manifests/../../etc/").otherwise("/data/manifests/x/./../"), k, F.when(k % 2 == 0, ".json").otherwise(".txt"))
    return X.table(spark, sf_dir, "orders").select(k.alias("id"), reports.in_folder(F.lit("/data/manifests"), path).alias("allowed"))


@register(
    "similar_totals",
    """select count(*)::bigint as considered, count(*) filter (where vec_id % 6 <> 0)::bigint as fingerprinted, count(*) filter (where vec_id % 6 = 0)::bigint as failed from embeddings""",
)
def similar_totals(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/v/"), "vec_id").alias("path"), "vec_id")
    return similar.similar_totals(e, e.where("vec_id % 6 != 0"))


@register("video_edges_default", sql("emb_fp video", "select path_a, path_b, total_distance, total_distance / 8.0::double as avg_distance from edges", distance=10))
def video_edges_default(spark, sf_dir):
    """Videos at the default distance; few unlike ones are that near."""
    return similar.video_edges(X.emb_video(spark, sf_dir))


@register("video_recoded", sql("emb_fp video recoded", "select path_a, path_b, total_distance, total_distance / 8.0::double as avg_distance from recoded", distance=10))
def video_recoded(spark, sf_dir):
    """Videos and second encodings of them, 0 to 12 bits away in four frames, at the default distance."""
    return similar.video_edges(X.recoded(spark, sf_dir))


@register(
    "hamming_recoded",
    sql("emb_fp hashes", """, two as (select id, hash from hashes union all select id + 1000000000, xor(hash, (1::bigint << (id % 14)::int) - 1) from hashes)
    select a.id as id_a, b.id as id_b, bit_count(xor(a.hash, b.hash))::int as distance from two a join two b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= 10""").replace("\n, two", ", two"),
)
def hamming_recoded(spark, sf_dir):
    """Hashes and ones 0 to 13 bits away from them, at the default distance."""
    rows = similar.hash_bits(X.emb_fp(spark, sf_dir)).select("id", "hash")
    moved = rows.select((F.col("id") + 1000000000).alias("id"), F.col("hash").bitwiseXOR(F.expr("shiftleft(1L, cast(id % 14 as int)) - 1")).alias("hash"))
    return similar.hamming_pairs(rows.unionByName(moved), 10)


@register(
    "similar_cluster_means",
    sql("emb_fp video", "", distance=26).rstrip("\n")
    + _CLUSTERS
    + """select n.cluster, avg(e.total_distance / 8.0::double) as avg_distance from edges e join named n on e.path_a = n.path group by n.cluster""",
)
def similar_cluster_means(spark, sf_dir):
    return similar.video_clusters(X.emb_video(spark, sf_dir), 26).select("cluster", "avg_distance")


# --- scalars ---------------------------------------------------------------------------


@register(
    "display_scalars",
    """select o_orderkey as id, (o_orderkey * 100 // greatest(o_custkey, 1))::int as pct, coalesce(strftime(case when o_orderkey % 4 = 0 then null else o_orderdate end, '%Y-%m-%d %H:%M:%S'), 'never') as shown,
    substr(regexp_replace(o_orderpriority || '/' || o_orderstatus, '[^\\p{L}\\p{N}]', '_', 'g'), 1, 40) as slug, '["/r/' || o_custkey || '","/s"]' as roots from orders""",
)
def display_scalars(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), S.percent("o_orderkey", "o_custkey").alias("pct"), S.fmt_ts(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))).alias("shown"),
        S.slug(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus")).alias("slug"), S.roots_json(F.array(F.concat(F.lit("/r/"), "o_custkey"), F.lit("/s"))).alias("roots"),
    )


@register("sample_times", "select p_partkey, sum(round((greatest(p_size / 4.0, 0.1) * (i + 0.5) / 8) * 1000)::bigint)::bigint as total_ms, count(*)::bigint as n from part, (select unnest(range(8)) as i) group by p_partkey")
def sample_times(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select("p_partkey", F.explode(S.sample_times(F.col("p_size") / 4.0)).alias("t"))
    return p.groupBy("p_partkey").agg(F.sum(F.round(F.col("t") * 1000).cast("long")).alias("total_ms"), F.count(F.lit(1)).alias("n"))
