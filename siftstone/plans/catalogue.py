"""Registered queries over the fixture views, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import scalars as S
from siftstone.operators import cache, dedupe, inventory, reports, similar
from siftstone.operators.inventory import ScanOptions
from siftstone.plans import fixtures as X
from siftstone.plans.fixtures import sql
from siftstone.sources import media
from siftstone.sources.scratch import scratch_path

QUERIES = {}
ORACLES = {}


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# --- duplicates ------------------------------------------------------------------------


@register("dup_groups", sql("doc_files groups", "select hash, media_kind, size, copies, wasted_bytes from groups"))
def dup_groups(spark, sf_dir):
    return dedupe.ordered(dedupe.group_stats(X.doc_files(spark, sf_dir)))


@register(
    "dup_group_members",
    sql("doc_files groups", "select f.hash, f.normalized_path, f.size, g.copies, g.wasted_bytes from doc_files f join groups g on f.hash = g.hash"),
)
def dup_group_members(spark, sf_dir):
    return dedupe.group_members(X.doc_files(spark, sf_dir)).select("hash", "normalized_path", "size", "copies", "wasted_bytes")


@register(
    "dedupe_report",
    sql(
        "doc_files groups",
        """select (select count(*) from doc_files)::bigint as total_files, count(*)::bigint as duplicate_groups, coalesce(sum(copies), 0)::bigint as total_duplicate_files,
        coalesce(sum(wasted_bytes), 0)::bigint as total_wasted_bytes, coalesce(max(size), 0)::bigint as largest_single_file_in_dup from groups""",
    ),
)
def dedupe_report(spark, sf_dir):
    return dedupe.report_totals(X.doc_files(spark, sf_dir))


_ORDER = {
    "shortest_path": "strlen(normalized_path), normalized_path", "longest_path": "strlen(normalized_path) desc, normalized_path desc",
    "oldest": "modified_ns, strlen(normalized_path), normalized_path", "newest": "modified_ns desc, strlen(normalized_path), normalized_path",
}
_WHY = {
    "shortest_path": "keeper: shortest path", "longest_path": "keeper: longest path",
    "oldest": "keeper: oldest modified time", "newest": "keeper: newest modified time",
}


def _plan_cte(rule: str) -> str:
    return f""", ranked as (
    select f.*, row_number() over w as rn, first_value(ino) over w as k_ino, first_value(dev) over w as k_dev
    from doc_files f join groups g on f.hash = g.hash window w as (partition by f.hash order by {_ORDER[rule].replace("normalized_path", "f.normalized_path")})
), plan as (
    select hash, path, normalized_path, size, case when rn = 1 or (ino <> 0 and ino = k_ino and dev = k_dev) then 'keep' else 'quarantine' end as action,
        case when rn = 1 then '{_WHY[rule]}' when ino <> 0 and ino = k_ino and dev = k_dev then 'hardlink of keeper — no space freed' else 'duplicate of keeper' end as reason
    from ranked
)"""


def _with_plan(body: str, rule: str = "shortest_path", views: str = "doc_files groups", more: str = "") -> str:
    return sql(views, "").rstrip("\n") + _plan_cte(rule) + more + "\n" + body


def _register_plans():
    for rule in _ORDER:
        short = rule.removesuffix("_path")
        register(f"plan_{short}", _with_plan("select hash, normalized_path, size, action, reason from plan", rule))(
            lambda spark, sf_dir, rule=rule: dedupe.plan(X.doc_files(spark, sf_dir), rule).select("hash", "normalized_path", "size", "action", "reason")
        )


_register_plans()


@register("plan_hardlinks", _with_plan("select reason, count(*)::bigint as n, sum(size)::bigint as bytes from plan group by reason"))
def plan_hardlinks(spark, sf_dir):
    return dedupe.plan(X.doc_files(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register(
    "plan_validate",
    _with_plan(
        """select hash, keepers, victims, keepers = 0 and victims > 0 as would_delete_unique from (
    select hash, count(*) filter (where action = 'keep')::bigint as keepers, count(*) filter (where action = 'quarantine')::bigint as victims from plan group by hash)"""
    ),
)
def plan_validate(spark, sf_dir):
    return dedupe.plan_counts(dedupe.plan(X.doc_files(spark, sf_dir)))


@register(
    "plan_summary",
    _with_plan(
        """select count(*) filter (where action = 'keep')::bigint as n_keep, count(*) filter (where action = 'quarantine')::bigint as n_quarantine,
        coalesce(sum(size) filter (where action = 'quarantine'), 0)::bigint as bytes_to_free from plan"""
    ),
)
def plan_summary(spark, sf_dir):
    return dedupe.plan_summary(dedupe.plan(X.doc_files(spark, sf_dir)))


@register(
    "plan_overrides",
    _with_plan("select normalized_path, case when regexp_matches(normalized_path, '[05]\\.[^.]*$') then 'keep' else action end as action from plan"),
)
def plan_overrides(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    new = files.where(F.col("normalized_path").rlike(r"[05]\.[^.]*$")).select("normalized_path", F.lit("keep").alias("action"))
    return dedupe.with_overrides(dedupe.plan(files), new).select("normalized_path", "action")


@register(
    "plan_preview",
    _with_plan("select normalized_path, printf('%-8s %12d bytes  %s  (%s)', case when action = 'keep' then 'KEEP' else 'QUARANT' end, size, path, reason) as line from plan"),
)
def plan_preview(spark, sf_dir):
    return dedupe.plan_preview(dedupe.plan(X.doc_files(spark, sf_dir)))


@register(
    "planned_members",
    _with_plan(
        "select f.normalized_path, coalesce(p.action, 'quarantine') as action from doc_files f join groups g on f.hash = g.hash left join (select * from plan where size % 2 = 0) p on f.normalized_path = p.normalized_path"
    ),
)
def planned_members(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    return dedupe.planned_members(files, dedupe.plan(files).where("size % 2 = 0")).select("normalized_path", "action")


@register(
    "dup_dirs",
    sql(
        "order_dirs",
        """select substr(signature, 1, 12) as signature, to_json(list(dir order by dir))::varchar as dirs, arg_min(file_count, dir)::bigint as file_count, arg_min(total_bytes, dir)::bigint as total_bytes,
        (arg_min(total_bytes, dir) * (count(*) - 1))::bigint as wasted_bytes
        from (select dir, sha256(string_agg(file_name || chr(0) || hash || chr(0), '' order by file_name)) as signature, count(*)::bigint as file_count, sum(size)::bigint as total_bytes
            from order_dirs group by dir) group by signature having count(*) > 1""",
    ),
)
def dup_dirs(spark, sf_dir):
    rows = X.order_dirs(spark, sf_dir).withColumn("normalized_path", F.concat_ws("/", F.col("dir").cast("string"), "file_name"))
    return dedupe.duplicate_dirs(rows, F.col("dir")).withColumn("dirs", F.to_json("dirs"))


# --- inventory -------------------------------------------------------------------------


@register("media_inventory", sql("doc_files", "select source_root, media_kind, count(*)::bigint as n, sum(size)::bigint as bytes from doc_files group by 1, 2"))
def media_inventory(spark, sf_dir):
    return inventory.classified(X.doc_files(spark, sf_dir)).groupBy("source_root", "media_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


_OPTIONS = ScanOptions(min_size=1000, media_only=True, exclude=[" /FR/", "SRC11", ""])


@register(
    "scan_filters",
    sql(
        "doc_files",
        """select normalized_path, size, media_kind from doc_files where media_kind <> 'other' and size >= 1000
        and not contains(lower(normalized_path), '/fr/') and not contains(lower(normalized_path), 'src11')""",
    ),
)
def scan_filters(spark, sf_dir):
    return inventory.filtered(X.doc_files(spark, sf_dir), _OPTIONS).select("normalized_path", "size", "media_kind")


@register(
    "root_counters",
    sql(
        "doc_files",
        """select source_root, count(*) filter (where media_kind = 'photo')::bigint as photos, count(*) filter (where media_kind = 'video')::bigint as videos,
        count(*) filter (where media_kind = 'other')::bigint as unsupported_files, count(*) filter (where kept)::bigint as files_walked,
        count(*) filter (where not kept)::bigint as files_skipped, coalesce(sum(size) filter (where kept), 0)::bigint as bytes_walked, 0::bigint as errors
        from (select *, media_kind <> 'other' and size >= 1000 and not contains(lower(normalized_path), '/fr/') and not contains(lower(normalized_path), 'src11') as kept from doc_files)
        group by rollup (source_root)""",
    ),
)
def root_counters(spark, sf_dir):
    return inventory.root_counters(X.doc_files(spark, sf_dir), _OPTIONS)


def _dirs(files):
    """Folders of the file view: one for each language, some of them pruned, and an empty folder in each root."""
    real = files.select("source_root", S.parent("normalized_path").alias("path")).distinct()
    empty = files.select("source_root", F.concat("source_root", F.lit("/empty/deep")).alias("path")).distinct()
    rows = real.unionByName(empty)
    return rows.withColumn("depth", S.depth_below("source_root", "path")).withColumn("pruned", F.octet_length("path") % 7 == 0)


@register(
    "folder_taxonomy",
    sql(
        "doc_files",
        """select source_root, count(*)::bigint as total_discovered, count(*) filter (where depth = 1)::bigint as top_level, count(*) filter (where depth > 1)::bigint as nested,
        count(*) filter (where not pruned)::bigint as scanned, count(*) filter (where pruned)::bigint as pruned, count(*) filter (where not pruned and files = 0)::bigint as empty,
        count(*) filter (where not pruned and supported > 0)::bigint as with_supported, count(*) filter (where not pruned and files > 0 and supported = 0)::bigint as without_supported,
        count(*) filter (where not pruned and photos > 0)::bigint as with_photos, count(*) filter (where not pruned and videos > 0)::bigint as with_videos,
        count(*) filter (where not pruned and photos > 0 and videos > 0)::bigint as with_both
        from (select source_root, 1 as depth, strlen(regexp_replace(normalized_path, '/[^/]*$', '')) % 7 = 0 as pruned, count(*) as files, count(*) filter (where media_kind <> 'other') as supported,
            count(*) filter (where media_kind = 'photo') as photos, count(*) filter (where media_kind = 'video') as videos from doc_files group by source_root, regexp_replace(normalized_path, '/[^/]*$', '')
            union all select distinct source_root, 2, strlen(source_root || '/empty/deep') % 7 = 0, 0, 0, 0, 0 from doc_files)
        group by rollup (source_root)""",
    ),
)
def folder_taxonomy(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    return inventory.folder_taxonomy(_dirs(files), files)


@register(
    "folder_tallies",
    sql(
        "doc_files",
        """select source_root, regexp_replace(normalized_path, '/[^/]*$', '') as dir, count(*)::bigint as files, count(*) filter (where media_kind <> 'other')::bigint as supported,
        count(*) filter (where media_kind = 'photo')::bigint as photos, count(*) filter (where media_kind = 'video')::bigint as videos from doc_files group by 1, 2""",
    ),
)
def folder_tallies(spark, sf_dir):
    return inventory.folder_tallies(X.doc_files(spark, sf_dir))


@register(
    "folder_map",
    sql(
        "doc_files",
        """select path, depth, count(*) filter (where depth = 2)::bigint as direct_files, count(*)::bigint as file_count from (
        select unnest(['/vault', source_root, regexp_replace(normalized_path, '/[^/]*$', '')]) as path, unnest([0, 1, 2])::int as depth from doc_files) group by 1, 2""",
    ),
)
def folder_map(spark, sf_dir):
    files = X.doc_files(spark, sf_dir).withColumn("source_root", F.lit("/vault"))
    return inventory.folder_map(files).select("path", "depth", "direct_files", "file_count")


@register("sample_files", sql("doc_files", "select path, file_name, media_kind, size, source_root from doc_files order by source_root, normalized_path limit 500"))
def sample_files(spark, sf_dir):
    return inventory.sample_files(X.doc_files(spark, sf_dir))


@register("video_paths", sql("doc_files", "select path from doc_files where media_kind = 'video'"))
def video_paths(spark, sf_dir):
    return inventory.video_paths(X.doc_files(spark, sf_dir))


@register(
    "pruned_entries",
    sql("doc_files", "select normalized_path from doc_files where not (normalized_path like '/vault/src1/%' or normalized_path like '/vault/%/fr/%')"),
)
def pruned_entries(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    up = files.select(F.explode(S.ancestors("source_root", S.parent("normalized_path"))).alias("path")).distinct()
    return inventory.under_pruned(files, up.where(F.col("path").endswith("/src1") | F.col("path").endswith("/fr"))).select("normalized_path")


# --- cache -----------------------------------------------------------------------------

_LOOKUP = """, named as (
    select file_name, size, modified_ns, id, hash, normalized_path as other, path_exists, row_number() over (partition by file_name, size, modified_ns order by id) as rn from doc_bank
), looked as (
    select f.normalized_path, f.source_root, f.hash as content_hash, p.hash as p_hash, n.hash as n_hash, n.other,
        case when p.hash is not null and p.hash not like 'p:%' then 'primary'
             when p.hash is null and n.hash is not null and n.hash not like 'p:%' and not (n.other <> f.normalized_path and n.path_exists) then 'filename' else 'miss' end as hit_kind
    from doc_files f left join doc_bank p on f.normalized_path = p.normalized_path and f.size = p.size and f.modified_ns = p.modified_ns
    left join named n on f.file_name = n.file_name and f.size = n.size and f.modified_ns = n.modified_ns and n.rn = 1
), hits as (
    select *, hit_kind = 'miss' and (p_hash is not null or n_hash is not null) as stale_ignored,
        case hit_kind when 'primary' then p_hash when 'filename' then n_hash end as hash, case when hit_kind = 'filename' and other <> normalized_path then other end as moved_from
    from looked
)
"""


def _cached(body: str, more: str = "") -> str:
    return sql("doc_files doc_bank", "").rstrip("\n") + _LOOKUP.rstrip("\n") + more + "\n" + body


@register("cache_lookup", _cached("select normalized_path, hit_kind, stale_ignored, hash, moved_from from hits"))
def cache_lookup(spark, sf_dir):
    return cache.lookup(X.doc_files(spark, sf_dir).drop("hash"), X.doc_bank(spark, sf_dir)).select("normalized_path", "hit_kind", "stale_ignored", "hash", "moved_from")


@register(
    "cache_counters",
    _cached(
        """select source_root, count(*) filter (where hit_kind <> 'miss')::bigint as cache_hits, count(*) filter (where hit_kind = 'miss')::bigint as cache_misses,
        count(*) filter (where stale_ignored)::bigint as stale_ignored, count(*) filter (where moved_from is not null)::bigint as moved_reused from hits group by rollup (source_root)"""
    ),
)
def cache_counters(spark, sf_dir):
    return cache.counters(cache.lookup(X.doc_files(spark, sf_dir).drop("hash"), X.doc_bank(spark, sf_dir)))


_MOVES = """, stale as (
    select hash, id, normalized_path as moved_from, row_number() over (partition by hash order by id) as k from doc_bank
    where not path_exists and normalized_path not in (select moved_from from hits where moved_from is not null)
), fresh as (select normalized_path, content_hash as hash, row_number() over (partition by content_hash order by normalized_path) as k from hits where hit_kind = 'miss')
, moves as (select f.normalized_path, f.hash, s.moved_from from fresh f join stale s on f.hash = s.hash and f.k = s.k)
"""


def _moves(spark, sf_dir):
    files, bank = X.doc_files(spark, sf_dir), X.doc_bank(spark, sf_dir)
    looked = cache.lookup(files.withColumnRenamed("hash", "content_hash"), bank)
    missing = looked.where("hit_kind = 'miss'").select("normalized_path", F.col("content_hash").alias("hash"))
    return cache.moves_by_hash(missing, bank, looked), bank, files


@register("move_by_hash", _cached("select normalized_path, hash, moved_from from moves", _MOVES.rstrip("\n")))
def move_by_hash(spark, sf_dir):
    return _moves(spark, sf_dir)[0]


@register(
    "cache_upsert",
    sql(
        "doc_files doc_bank",
        f"""select coalesce(f.normalized_path, b.normalized_path) as normalized_path, coalesce(f.hash, b.hash) as hash, coalesce(f.size, b.size) as size, coalesce(f.modified_ns, b.modified_ns) as modified_ns,
        coalesce(b.first_seen_ts, '2024-02-02T00:00:00+00:00') as first_seen_ts, case when f.hash is null then '{X.NOW}' else '2024-02-02T00:00:00+00:00' end as last_seen_ts,
        case when f.hash is null then 1 else 2 end::bigint as last_scan_id, b.id is null as is_new
        from doc_bank b full join (select * from doc_files where size % 3 <> 0) f on b.normalized_path = f.normalized_path""",
    ),
)
def cache_upsert(spark, sf_dir):
    bank = X.doc_bank(spark, sf_dir)
    out = cache.upsert_files(bank, X.doc_files(spark, sf_dir).where("size % 3 != 0"), 2, "2024-02-02T00:00:00+00:00")
    top = bank.agg(F.max("id").alias("top"))
    marked = out.join(F.broadcast(top))  # one row
    return marked.select("normalized_path", "hash", "size", "modified_ns", "first_seen_ts", "last_seen_ts", "last_scan_id", (F.col("id") > F.col("top")).alias("is_new"))


@register(
    "cache_relocate",
    _cached(
        f"""select b.id, b.hash, m.normalized_path, b.size, b.modified_ns, b.first_seen_ts, '2024-02-02T00:00:00+00:00' as last_seen_ts
        from doc_bank b join moves m on b.normalized_path = m.moved_from where m.normalized_path not in (select normalized_path from doc_bank)
        union all
        select t.id, b.hash, m.normalized_path, t.size, t.modified_ns, t.first_seen_ts, '2024-02-02T00:00:00+00:00'
        from doc_bank b join moves m on b.normalized_path = m.moved_from join doc_bank t on t.normalized_path = m.normalized_path
        union all
        select id, hash, normalized_path, size, modified_ns, first_seen_ts, '{X.NOW}' from doc_bank
        where normalized_path not in (select moved_from from moves) and normalized_path not in (select normalized_path from moves)""",
        _MOVES.rstrip("\n"),
    ),
)
def cache_relocate(spark, sf_dir):
    moves, bank, files = _moves(spark, sf_dir)
    full = moves.select("normalized_path", "moved_from").join(files.select("normalized_path", "path", "file_name", "source_root"), "normalized_path")
    out = cache.relocate(bank.drop("path_exists"), full, 2, "2024-02-02T00:00:00+00:00")
    return out.select("id", "hash", "normalized_path", "size", "modified_ns", "first_seen_ts", "last_seen_ts")


@register(
    "cache_delete",
    _with_plan(
        "select id, hash, normalized_path from doc_bank where normalized_path not in (select normalized_path from plan where action = 'quarantine')", views="doc_files groups doc_bank"
    ),
)
def cache_delete(spark, sf_dir):
    victims = dedupe.plan(X.doc_files(spark, sf_dir)).where("action = 'quarantine'")
    return cache.delete_paths(X.doc_bank(spark, sf_dir), victims).select("id", "hash", "normalized_path")


@register(
    "legacy_purge",
    sql("doc_files doc_bank", "select id, hash, normalized_path, cast(null as bigint) as last_scan_id, (select count(*) from doc_bank where hash like 'p:%')::bigint as purged from doc_bank where hash not like 'p:%'"),
)
def legacy_purge(spark, sf_dir):
    bank = X.doc_bank(spark, sf_dir)
    n = cache.legacy_rows(bank, bank.limit(0)).withColumnRenamed("legacy_rows", "purged")
    return cache.purge_legacy(bank).select("id", "hash", "normalized_path", "last_scan_id").join(F.broadcast(n))  # one row


@register(
    "records_for_hash",
    sql("doc_files doc_bank", "select hash, id, normalized_path from (select *, row_number() over (partition by hash order by id) as rn from doc_bank) where rn <= 8"),
)
def records_for_hash(spark, sf_dir):
    return cache.records_for_hash(X.doc_bank(spark, sf_dir)).select("hash", "id", "normalized_path")


@register(
    "memory_stats",
    sql(
        "doc_files doc_bank scan_log folder_log",
        """select (select count(*) from folder_log)::bigint as folders, (select count(*) from doc_bank)::bigint as files, (select count(distinct hash) from doc_bank)::bigint as distinct_hashes,
        (select count(*) from (select hash from doc_bank group by hash having count(*) > 1))::bigint as duplicate_hashes,
        (select ended_ts from scan_log where ended_ts is not null order by id desc limit 1) as last_scan_ts""",
    ),
)
def memory_stats(spark, sf_dir):
    return cache.memory_stats(X.folder_log(spark, sf_dir), X.doc_bank(spark, sf_dir), X.scan_log(spark, sf_dir))


@register("recent_scans", sql("scan_log", "select * from scan_log order by id desc limit 50"))
def recent_scans(spark, sf_dir):
    return cache.recent_scans(X.scan_log(spark, sf_dir))


@register("list_folders", sql("folder_log", "select * from folder_log"))
def list_folders(spark, sf_dir):
    return cache.list_folders(X.folder_log(spark, sf_dir))


@register("peek_folder", sql("folder_log", "select * from folder_log where normalized_path = '/home/Customer#000000007'"))
def peek_folder(spark, sf_dir):
    return cache.peek_folder(X.folder_log(spark, sf_dir), "/home/Customer#000000007")


@register(
    "snapshot_diff",
    sql(
        "doc_files doc_bank",
        """select coalesce(f.normalized_path, b.normalized_path) as normalized_path, case when f.hash is null then 'gone' when b.hash = f.hash then 'same' when b.hash is not null then 'changed'
        when f.hash in (select hash from doc_bank) then 'moved' else 'new' end as state from doc_bank b full join doc_files f on b.normalized_path = f.normalized_path""",
    ),
)
def snapshot_diff(spark, sf_dir):
    return cache.snapshot_diff(X.doc_bank(spark, sf_dir), X.doc_files(spark, sf_dir))


# --- similarity ------------------------------------------------------------------------


@register("phash_bits", sql("emb_fp hashes", "select id, hash from hashes"))
def phash_bits(spark, sf_dir):
    return similar.hash_bits(X.emb_fp(spark, sf_dir)).select("id", "hash")


@register(
    "hamming_pairs",
    sql("emb_fp hashes", "select a.id as id_a, b.id as id_b, bit_count(xor(a.hash, b.hash))::int as distance from hashes a join hashes b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= 20"),
)
def hamming_pairs(spark, sf_dir):
    return similar.hamming_pairs(similar.hash_bits(X.emb_fp(spark, sf_dir)).select("id", "hash"), 20)


@register(
    "hamming_pairs_default",
    sql("emb_fp hashes", "select a.id as id_a, b.id as id_b, bit_count(xor(a.hash, b.hash))::int as distance from hashes a join hashes b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= 10"),
)
def hamming_pairs_default(spark, sf_dir):
    """At the default distance, which the index serves."""
    return similar.hamming_pairs(similar.hash_bits(X.emb_fp(spark, sf_dir)).select("id", "hash"), 10)


@register("video_edges", sql("emb_fp video", "select path_a, path_b, total_distance from edges", distance=26))
def video_edges(spark, sf_dir):
    return similar.video_edges(X.emb_video(spark, sf_dir), 26).select("path_a", "path_b", "total_distance")


_CLUSTERS = """, reach(a, b) as (
    select path_a, path_b from edges union select path_b, path_a from edges union select r.a, e.b from reach r join (select path_a as a, path_b as b from edges union select path_b, path_a from edges) e on r.b = e.a
), named as (select a as path, least(a, min(b)) as cluster from reach group by a)
"""


@register(
    "similar_clusters",
    sql("emb_fp video", "", distance=26).rstrip("\n")
    + _CLUSTERS
    + """select n.cluster, any_value(n.size) as size, count(*)::bigint as n_edges, sum(e.total_distance)::bigint as total_distance
    from edges e join (select *, count(*) over (partition by cluster) as size from named) n on e.path_a = n.path group by n.cluster""",
)
def similar_clusters(spark, sf_dir):
    return similar.video_clusters(X.emb_video(spark, sf_dir), 26).select("cluster", "size", "n_edges", "total_distance")


@register(
    "decoded_images",
    sql(
        "emb_fp",
        """select image, count(*)::int as height, 64::int as width, string_agg(luma, '' order by place) as luma from (
        select image, place, array_to_string(list_transform(tones, lambda p: format('{:02X}', (2126 * (127 - p) + 7152 * ((p * 3) % 128) + 722 * p) // 10000)), '') as luma from (
        select id // 8 as image, id % 8 as place, list_transform(min(c), lambda v: least(greatest(floor((v + 1) * 63.5), 0), 127)::int) as tones from emb_fp where id is not null group by 1, 2)) group by image""",
    ),
)
def decoded_images(spark, sf_dir):
    """Vectors written as image files, a file for each eight, and read back as luma through the image source."""
    root = scratch_path(spark, "frame-images")
    X.frame_images(spark, sf_dir).write.partitionBy("image").text(root)
    read = media.luma(media.images(spark, root))
    return read.select(F.regexp_extract("origin", r"image=(\d+)/", 1).cast("long").alias("image"), "height", "width", F.hex("luma").alias("luma"))


# --- reports ---------------------------------------------------------------------------


@register(
    "waste_by_ext",
    sql(
        "doc_files",
        """select case when rn <= 7 then ext else 'other' end as ext, sum(bytes)::bigint as wasted_bytes from (
        select ext, bytes, row_number() over (order by bytes desc, ext) as rn from (
        select lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) as ext, sum(size) as bytes from (select *, row_number() over (partition by hash order by normalized_path) as rn from doc_files) where rn > 1 group by 1))
        group by 1""",
    ),
)
def waste_by_ext(spark, sf_dir):
    return dedupe.waste_by_extension(X.doc_files(spark, sf_dir)).select("ext", "wasted_bytes")


@register(
    "csv_export",
    sql(
        "doc_files groups",
        """select f.normalized_path, f.hash || ',' || g.media_kind || ',' || g.size || ',' || g.copies || ',' || g.wasted_bytes || ',' || f.path || ',' || f.normalized_path || ',' || f.source_root as line
        from doc_files f join groups g on f.hash = g.hash""",
    ),
)
def csv_export(spark, sf_dir):
    return reports.export_lines(X.doc_files(spark, sf_dir)).select("normalized_path", "line")


@register(
    "csv_escape",
    """select doc_id, sha256(case when contains(s, ',') or contains(s, '"') or contains(s, chr(10)) then '"' || replace(s, '"', '""') || '"' else s end) as cell from (
    select doc_id, case when text[1] in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || text else text end as s from documents)""",
)
def csv_escape(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.csv_field("text"), 256).alias("cell"))


@register(
    "quarantine_names",
    _with_plan(
        """select normalized_path, case when k = 1 then name else regexp_replace(name, '\\.[^.]*$', '') || '_' || k || '.' || regexp_extract(name, '\\.([^.]*)$', 1) end as quarantine_name
        from (select normalized_path, name, row_number() over (partition by name order by normalized_path) as k from (
        select normalized_path, regexp_replace(normalized_path, '^.*/doc_\\d+\\.', 'doc.') as name from plan where action = 'quarantine'))"""
    ),
)
def quarantine_names(spark, sf_dir):
    p = dedupe.plan(X.doc_files(spark, sf_dir))
    same = p.withColumn("path", F.regexp_replace("path", r"/doc_\d+\.", "/doc."))  # names that clash
    return reports.quarantine_names(same)


@register(
    "apply_simulated",
    _with_plan(
        """select v.normalized_path, case when v.now is null then 'skipped' when k.now is null or k.now <> v.now then 'failed' else 'moved' end as status from (select p.*, d.now from plan p left join disk d on p.normalized_path = d.normalized_path where action = 'quarantine') v
        left join (select p.hash, arg_max(d.now, p.normalized_path) filter (where true) as now from (select p.hash, max(normalized_path) as normalized_path from plan p where action = 'keep' group by p.hash) p left join disk d on p.normalized_path = d.normalized_path group by p.hash) k on v.hash = k.hash""",
        more=", disk as (select normalized_path, case when doc_id % 7 = 0 then 'changed' else hash end as now from doc_files where doc_id % 9 <> 0)",
    ),
)
def apply_simulated(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    now = F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("hash"))
    disk = files.where("doc_id % 9 != 0").select("normalized_path", now.alias("current_hash"))
    return reports.simulate_apply(dedupe.plan(files), disk).select("normalized_path", "status")


@register(
    "apply_totals",
    _with_plan(
        """select count(*) filter (where action = 'quarantine')::bigint as quarantined, 0::bigint as failed, coalesce(sum(size) filter (where action = 'quarantine'), 0)::bigint as bytes_freed,
        0::bigint as not_processed, count(*) filter (where action = 'keep')::bigint as kept from plan"""
    ),
)
def apply_totals(spark, sf_dir):
    files = X.doc_files(spark, sf_dir)
    p = dedupe.plan(files)
    return reports.apply_totals(reports.simulate_apply(p, files.select("normalized_path", F.col("hash").alias("current_hash"))), p)


@register(
    "undo_filter",
    """select o_orderkey as id, status, quarantine_path from (select o_orderkey, case o_orderstatus when 'F' then 'moved' when 'P' then '' else 'skipped' end as status,
    case when o_orderkey % 3 = 0 then '' else '/q/' || o_orderkey end as quarantine_path from orders) where status in ('', 'moved') and quarantine_path <> ''""",
)
def undo_filter(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "moved").when(F.col("o_orderstatus") == "P", "").otherwise("skipped")
    at = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("/q/"), F.col("o_orderkey").cast("string")))
    return reports.restorable(o.select(F.col("o_orderkey").alias("id"), status.alias("status"), at.alias("quarantine_path")))


@register("log_tail", sql("event_log", "select seq, level, message from event_log where seq >= greatest(500, (select max(seq) + 1 from event_log) - 2000)"))
def log_tail(spark, sf_dir):
    return reports.log_tail(X.event_log(spark, sf_dir), 500).select("seq", "level", "message")


@register("log_ring", sql("event_log", "select seq, level, message from event_log order by seq desc limit 2000"))
def log_ring(spark, sf_dir):
    return reports.log_ring(X.event_log(spark, sf_dir)).select("seq", "level", "message")


# --- scalars ---------------------------------------------------------------------------


@register(
    "fmt_bytes",
    sql(
        "doc_files",
        """select doc_id, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.2f KB', floor(b / 1024.0 * 100 + 0.5) / 100) when b < 1073741824 then printf('%.2f MB', floor(b / 1048576.0 * 100 + 0.5) / 100)
        else printf('%.2f GB', floor(b / 1073741824.0 * 100 + 0.5) / 100) end as text from (select doc_id, size * (case doc_id % 3 when 0 then 1 when 1 then 1024 else 1048576 end) as b from doc_files)""",
    ),
)
def fmt_bytes(spark, sf_dir):
    b = F.col("size") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1024).otherwise(1048576)
    return X.doc_files(spark, sf_dir).select("doc_id", S.fmt_bytes(b).alias("text"))


@register("short_hash", sql("doc_files", "select doc_id, substr(hash, 1, 10) || '…' || right(hash, 4) as short from doc_files"))
def short_hash(spark, sf_dir):
    return X.doc_files(spark, sf_dir).select("doc_id", S.short_hash("hash").alias("short"))


@register(
    "file_ext",
    sql("doc_files", "select doc_id, lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) as ext, regexp_replace(file_name, '\\.[^.]*$', '') as stem, regexp_replace(normalized_path, '/[^/]*$', '') as folder, source_root[8:] as root_name from doc_files"),
)
def file_ext(spark, sf_dir):
    f = X.doc_files(spark, sf_dir)
    return f.select("doc_id", S.file_ext("path").alias("ext"), S.stem("file_name").alias("stem"), S.parent("path").alias("folder"), S.folder_name("source_root").alias("root_name"))


@register(
    "version_compare",
    """select p_partkey, case when x < y then -1 when x > y then 1 else 0 end::int as cmp from (
    select p_partkey, [p_size // 10, p_size % 10, p_partkey % 4] as x, [2, p_partkey % 7, 0] as y from part)""",
)
def version_compare(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    a = F.format_string("v%d.%d.%d-beta", F.expr("p_size div 10").cast("long"), (F.col("p_size") % 10).cast("long"), F.col("p_partkey") % 4)
    b = F.format_string("2.%d", F.col("p_partkey") % 7)
    return p.select("p_partkey", S.compare_versions(a, b).alias("cmp"))


@register(
    "paths_sanitized",
    sql("doc_files", "select doc_id, source_root || '/' || file_name as clean, true as under from doc_files"),
)
def paths_sanitized(spark, sf_dir):
    f = X.doc_files(spark, sf_dir)
    odd = F.concat("source_root", F.lit("/./x/..//"), "file_name")
    return f.select("doc_id", S.sanitize(odd).alias("clean"), S.is_under("source_root", odd).alias("under"))


@register(
    "compare_folders",
    sql(
        "doc_files",
        """select hash, count(*)::bigint as copies, count(distinct source_root)::bigint as n_roots from doc_files where right(source_root, 1) in ('0', '2', '4', '6', '8') group by hash having count(*) > 1""",
    ),
)
def compare_folders(spark, sf_dir):
    some = X.doc_files(spark, sf_dir).where(F.right("source_root", F.lit(1)).isin("0", "2", "4", "6", "8"))
    return dedupe.compare_roots(some).select("hash", "copies", "n_roots")


# More queries, in a module of their own, which registers them here.
from siftstone.plans import scan_queries  # noqa: E402, F401
