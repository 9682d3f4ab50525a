"""Test tables seen as files, caches, directories and fingerprints, for both engines.

Each view is defined twice, as a DataFrame and as a DuckDB common table expression of the
same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import scalars as S

EXTENSIONS = ["JPG", "jpeg", "mov", "MP4", "txt", "heic", "mkv", "pdf"]
T0 = 1700000000000000000
NOW = "2024-01-01T00:00:00+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    text = F.coalesce("text", F.lit(""))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.expr("(doc_id div 20) % 8") + 1).cast("int"))
    base = d.select("doc_id", "lang", "source", S.content_hash(text).alias("hash"), F.octet_length(text).cast("long").alias("size"), ext.alias("ext"))
    link = base.where("doc_id % 3 = 0").groupBy("hash").agg(F.min("doc_id").alias("link"))
    rows = base.join(link, "hash", "left")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), "ext")
    root = F.concat(F.lit("/vault/"), "source")
    rows = rows.withColumn("file_name", name).withColumn("source_root", root)
    rows = rows.withColumn("normalized_path", F.concat_ws("/", "source_root", "lang", "file_name"))
    ino = F.when(F.col("doc_id") % 3 == 0, F.lit(1) + F.col("link")).otherwise(F.lit(1000000) + F.col("doc_id"))
    return rows.select(
        "doc_id", "hash", F.col("normalized_path").alias("path"), "normalized_path", "file_name", S.media_kind("file_name").alias("media_kind"), "source_root", "size",
        (F.lit(T0) + ((F.col("doc_id") * 7919) % 1000) * 1000000000).alias("modified_ns"), F.lit(1).cast("long").alias("dev"), ino.cast("long").alias("ino"),
    )


def doc_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = doc_files(spark, sf_dir).where("doc_id % 5 != 0")
    legacy, renamed = F.col("doc_id") % 17 == 0, F.col("doc_id") % 11 == 0
    moved, changed = ~renamed & (F.col("doc_id") % 7 == 0), F.col("doc_id") % 13 == 0
    name = F.when(renamed, F.concat(F.lit("r_"), F.col("doc_id").cast("string"), F.lit(".bin"))).otherwise(F.col("file_name"))
    path = F.when(renamed, F.concat(F.lit("/vault/renamed/"), name)).when(moved, F.concat(F.lit("/vault/old/"), "file_name")).otherwise(F.col("normalized_path"))
    exists = F.when(renamed, False).when(moved, F.col("doc_id") % 21 == 0).otherwise(True)
    return f.select(
        (F.col("doc_id") + 1).alias("id"), F.when(legacy, F.concat(F.lit("p:"), F.substring("hash", 1, 16))).otherwise(F.col("hash")).alias("hash"),
        path.alias("path"), path.alias("normalized_path"), name.alias("file_name"), "source_root", "size",
        F.when(changed, F.col("modified_ns") - 1).otherwise(F.col("modified_ns")).alias("modified_ns"), exists.alias("path_exists"),
        F.lit(NOW).alias("first_seen_ts"), F.lit(NOW).alias("last_seen_ts"), F.lit(1).cast("long").alias("last_scan_id"),
    )


FOLDERS = ["src", ".git", "node_modules", "Tool.APP", ".Spotlight-V100", ".Trashes", "lib", "img"]


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk over all roots meets: bookkeeping files, files in error, folders of all kinds."""
    id_ = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.expr("(doc_id div 3) % 8") + 1).cast("int"))
    name = F.when(id_ % 31 == 0, ".DS_Store").when(id_ % 37 == 0, F.concat(F.lit("._"), "file_name")).when(id_ % 41 == 0, "Icon\r").otherwise(F.col("file_name"))
    usual = (id_ % 31 != 0) & (id_ % 37 != 0) & (id_ % 41 != 0)
    error = F.when(usual & (id_ % 29 == 0), "Permission denied").when(usual & (id_ % 23 == 0), "No such file or directory")
    rows = doc_files(spark, sf_dir).withColumn("file_name", name).withColumn("folder", folder).withColumn("error", error)
    return rows.withColumn("normalized_path", F.concat_ws("/", "source_root", "folder", "file_name")).drop("hash")


def order_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("dir"), F.col("o_orderpriority").alias("file_name")).agg(
        F.max("o_orderstatus").alias("hash"), F.sum(F.round("o_totalprice").cast("long")).alias("size")
    )


def emb_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("coefficients"))


def emb_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of eight vectors each, of all videos that have all eight; an orientation turns the coefficients by 16."""
    e = emb_fp(spark, sf_dir).where("id is not null")
    turned = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda o: F.concat(F.slice("coefficients", o * 16 + 1, F.lit(64)), F.slice("coefficients", F.lit(1), o * 16)),
    )
    long = e.select(F.expr("id div 8").alias("video"), (F.col("id") % 8).alias("frame"), F.posexplode(turned).alias("orient", "c"))
    hashed = long.select("video", "frame", "orient", S.phash_bits("c").alias("hash"))
    by = hashed.groupBy("video", "orient").agg(F.transform(F.array_sort(F.collect_set(F.struct("frame", "hash"))), lambda x: x["hash"]).alias("f")).where(F.size("f") == 8)
    out = by.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("orient", "f"))), lambda x: x["f"]).alias("frames"))
    return out.select(F.format_string("/vault/video/v_%04d.mp4", "video").alias("path"), "frames")


def recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos, and for each a second encoding of another path: four frames differ in 0 to 12 bits, the others in 24."""
    n = F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long")
    near, far = F.expr("shiftleft(1L, cast(n % 13 as int)) - 1"), F.lit((1 << 24) - 1)
    flipped = F.transform("frames", lambda o: F.transform(o, lambda h, k: h.bitwiseXOR(F.when(k % 2 == 0, near).otherwise(far))))
    videos = emb_video(spark, sf_dir)
    return videos.unionByName(videos.withColumn("n", n).select(F.format_string("/vault/video/r_%04d.mp4", "n").alias("path"), flipped.alias("frames")))


def _tone(v):
    """A vector's value as a pixel of 7 bits."""
    return F.least(F.greatest(F.floor((v + 1) * 63.5), F.lit(0)), F.lit(127)).cast("int")


def frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight vectors as one BMP of 64 pixels a row, as (image, bytes): blue is the tone, green thrice that, red its inverse.

    All bytes are below 128, so that a text file can hold the picture.
    """
    e = emb_fp(spark, sf_dir).where("id is not null")
    rows = [F.min(F.when(F.col("id") % 8 == i, F.col("coefficients"))) for i in range(8)]
    held = e.groupBy(F.expr("id div 8").alias("image")).agg(F.array_compact(F.array(*rows)).alias("rows"))
    letter = lambda n: F.call_function("chr", n.cast("long"))
    pixel = lambda v: F.concat(letter(_tone(v)), letter(_tone(v) * 3 % 128), letter(127 - _tone(v)))
    # A BMP's two headers, 14 and 40 bytes, for 24 bits a pixel, with the size of eight rows; rows go from the bottom up.
    zeros = lambda n: F.lit("\0" * n)
    head = F.concat(F.lit("BM6\6"), zeros(6), F.lit("6"), zeros(3), F.lit("("), zeros(3), F.lit("@"), zeros(3), letter(F.size("rows")), zeros(3), F.lit("\1\0\x18"), zeros(25))
    body = F.array_join(F.transform(F.reverse("rows"), lambda r: F.array_join(F.transform(r, pixel), "")), "")
    return held.select("image", F.concat(head, body).alias("bytes"))


LEVELS = ["info", "warn", "error", "dry", "real"]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log in event_id order; ids are dense, so they number the rows."""
    e = table(spark, sf_dir, "events")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.length("event_type") % 5 + 1).cast("int"))
    return e.select((F.col("event_id") - F.lit(_first(e, "event_id"))).alias("seq"), "ts", level.alias("level"), F.col("props").alias("message"))


def _first(df: DataFrame, c: str) -> int:
    return df.agg(F.min(c)).first()[0] or 0


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_ts"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("ended_ts"), F.lit("dry").alias("mode")
    )


def folder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("/home/"), "c_name").alias("path"), F.concat(F.lit("/home/"), "c_name").alias("normalized_path"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("last")).alias("last_scan_ts"),
    )


# --- the same views for DuckDB ----------------------------------------------------------

_PHOTO = "('jpg','jpeg','heic')"
_VIDEO = "('mov','mp4','mkv')"

CTE = {
    "doc_files": f"""doc_base as (
    select doc_id, lang, source, sha256(coalesce(text, '')) as hash, strlen(coalesce(text, ''))::bigint as size,
        (['JPG','jpeg','mov','MP4','txt','heic','mkv','pdf'])[((doc_id // 20) % 8 + 1)::int] as ext
    from documents where doc_id is not null
), doc_link as (select hash, min(doc_id) as link from doc_base where doc_id % 3 = 0 group by hash),
doc_files as (
    select doc_id, b.hash, '/vault/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext as path,
        '/vault/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext as normalized_path, 'doc_' || doc_id || '.' || ext as file_name,
        case when lower(ext) in {_PHOTO} then 'photo' when lower(ext) in {_VIDEO} then 'video' else 'other' end as media_kind,
        '/vault/' || source as source_root, size, ({T0} + ((doc_id * 7919) % 1000) * 1000000000)::bigint as modified_ns,
        1::bigint as dev, (case when doc_id % 3 = 0 then 1 + link else 1000000 + doc_id end)::bigint as ino
    from doc_base b left join doc_link l on b.hash = l.hash
)""",
    "walk": """walk_base as (
    select doc_id, source_root, size, media_kind as kind, file_name as plain, (['src','.git','node_modules','Tool.APP','.Spotlight-V100','.Trashes','lib','img'])[((doc_id // 3) % 8 + 1)::int] as folder,
        doc_id % 31 = 0 or doc_id % 37 = 0 or doc_id % 41 = 0 as bookkeeping from doc_files
), walk as (
    select *, source_root || '/' || folder || '/' || file_name as normalized_path from (select *,
        case when doc_id % 31 = 0 then '.DS_Store' when doc_id % 37 = 0 then '._' || plain when doc_id % 41 = 0 then 'Icon' || chr(13) else plain end as file_name,
        case when bookkeeping then null when doc_id % 29 = 0 then 'Permission denied' when doc_id % 23 = 0 then 'No such file or directory' end as error from walk_base)
)""",
    "doc_bank": f"""doc_bank as (
    select doc_id + 1 as id, case when doc_id % 17 = 0 then 'p:' || substr(hash, 1, 16) else hash end as hash,
        case when doc_id % 11 = 0 then '/vault/renamed/r_' || doc_id || '.bin' when doc_id % 7 = 0 then '/vault/old/' || file_name else normalized_path end as path,
        case when doc_id % 11 = 0 then '/vault/renamed/r_' || doc_id || '.bin' when doc_id % 7 = 0 then '/vault/old/' || file_name else normalized_path end as normalized_path,
        case when doc_id % 11 = 0 then 'r_' || doc_id || '.bin' else file_name end as file_name, source_root, size,
        case when doc_id % 13 = 0 then modified_ns - 1 else modified_ns end as modified_ns,
        case when doc_id % 11 = 0 then false when doc_id % 7 = 0 then doc_id % 21 = 0 else true end as path_exists,
        '{NOW}' as first_seen_ts, '{NOW}' as last_seen_ts, 1::bigint as last_scan_id
    from doc_files where doc_id % 5 <> 0
)""",
    "groups": """grouped as (
    select hash, count(*)::bigint as copies, arg_min(size, normalized_path) as size, arg_min(media_kind, normalized_path) as media_kind
    from doc_files group by hash having count(*) > 1
), groups as (select *, size * (copies - 1) as wasted_bytes from grouped)""",
    "order_dirs": """order_dirs as (
    select o_custkey as dir, o_orderpriority as file_name, max(o_orderstatus) as hash, sum(cast(round(o_totalprice) as bigint))::bigint as size
    from orders group by 1, 2
)""",
    "emb_fp": """emb_fp as (select vec_id as id, list_transform(embedding, lambda v: v::double) as c from embeddings where len(embedding) = 64)""",
    "hashes": """mids as (select id, c, list_sort(c)[33] as mid from emb_fp), long_bits as (
    select id, unnest(range(64)) as i, unnest(c) as v, mid from mids
), hashes as (
    select id, sum(case when v > mid then (case when i = 63 then -9223372036854775808::hugeint else (1::hugeint << i) end) else 0 end)::bigint as hash
    from long_bits group by id
)""",
    "video": """vids as (
    select id // 8 as video, id % 8 as frame, o.o as orient, list_concat(c[o.o * 16 + 1:], c[1:o.o * 16]) as c
    from emb_fp, (select unnest(range(4)) as o) o where id // 8 in (select id // 8 from emb_fp group by 1 having count(distinct id % 8) = 8)
), vmid as (select *, list_sort(c)[33] as mid from vids), vbits as (
    select video, frame, orient, unnest(range(64)) as i, unnest(c) as v, mid from vmid
), frames as (
    select video, frame, orient, sum(case when v > mid then (case when i = 63 then -9223372036854775808::hugeint else (1::hugeint << i) end) else 0 end)::bigint as hash
    from vbits group by 1, 2, 3
), orient_pairs as (
    select a.video as va, b.video as vb, a.orient as oa, b.orient as ob, sum(bit_count(xor(a.hash, b.hash))) as total, count(*) filter (where bit_count(xor(a.hash, b.hash)) <= {distance}) as matches
    from frames a join frames b on a.frame = b.frame and a.video < b.video group by 1, 2, 3, 4
), edges as (
    select printf('/vault/video/v_%04d.mp4', va) as path_a, printf('/vault/video/v_%04d.mp4', vb) as path_b, min(total)::bigint as total_distance
    from orient_pairs where matches >= 4 group by va, vb
)""",
    "recoded": """encoded as (
    select printf('/vault/video/v_%04d.mp4', video) as path, frame, orient, hash from frames union all
    select printf('/vault/video/r_%04d.mp4', video), frame, orient, xor(hash, case when frame % 2 = 0 then (1::bigint << (video % 13)::int) - 1 else 16777215 end) from frames
), encoded_pairs as (
    select a.path as path_a, b.path as path_b, sum(bit_count(xor(a.hash, b.hash))) as total, count(*) filter (where bit_count(xor(a.hash, b.hash)) <= {distance}) as matches
    from encoded a join encoded b on a.frame = b.frame and a.path < b.path group by a.path, b.path, a.orient, b.orient
), recoded as (select path_a, path_b, min(total)::bigint as total_distance from encoded_pairs where matches >= 4 group by path_a, path_b)""",
    "event_log": """event_log as (
    select event_id - (select min(event_id) from events) as seq, ts, (['info','warn','error','dry','real'])[(length(event_type) % 5 + 1)::int] as level, props as message from events
)""",
    "scan_log": """scan_log as (
    select o_orderkey as id, o_orderdate as started_ts, case when o_orderstatus <> 'O' then o_orderdate end as ended_ts, 'dry' as mode from orders
)""",
    "folder_log": """folder_log as (
    select c_custkey as id, '/home/' || c_name as path, '/home/' || c_name as normalized_path, case when c_custkey % 4 <> 0 then last end as last_scan_ts
    from customer left join (select o_custkey, max(o_orderdate) as last from orders group by 1) on c_custkey = o_custkey
)""",
}


def sql(views: str, body: str, distance: int | None = None) -> str:
    """``body`` after the named views (and those they build on), in the order given."""
    names = " ".join("doc_files walk" if v == "walk" else v for v in views.split()).split()
    return ("with recursive " + ", ".join(CTE[v] for v in names) + "\n" + body).replace("{distance}", str(distance))
