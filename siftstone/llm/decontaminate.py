"""Benchmark passages inside documents, found by a prefix-filtered set join.

An item's windows (10 consecutive words, or all of a shorter item) are sets of shingles, three
words each.  A document contains a window only if it contains all its shingles, so a
prefix of one shingle is necessary, and any one will do: shingles are ordered by their number
in the documents, and the rarest is joined.  A window with a shingle that no document has
can't occur and is left out before the join.  A shingle met at word ``i``, which stands at
``o`` in the window, puts the window's start at ``i - o``: within the document, by position and
length, or the pair goes.  What is left is compared word by word.

The documents are read twice, once to count the items' shingles and once to join prefixes.  Each
time a bitmap of the wanted shingles' hashes, of a fixed largest size, sits in the plan and
picks positions before any row is exploded; the joins behind it are exact, so it changes
no result.  Only Spark's own expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import columns, free_name, table
from siftstone.sources.scratch import cut

WINDOW = 10
SHINGLE = 3
#: Words, once A-Z are lower-case: all that isn't ASCII, letters and digits.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: 64-bit words of a bitmap, at least and at most (512 KiB).
SLOTS = (1 << 8, 1 << 16)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str = "text") -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(low, F.lit(PATTERN), F.lit(0))


def _starts(w: Column, size: int) -> Column:
    """Places, from 0, at which ``size`` words begin."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))


def _hash(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(w, i + k) for k in range(size)))


def _named(w: Column, starts: Column, size: int, place: str) -> Column:
    """Array of (place, h, s): the shingles that begin at some places."""
    return F.transform(starts, lambda i: F.struct(i.alias(place), _hash(w, i, size).alias("h"), F.lit(size).alias("s")))


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, item_id), and (window, words, size) of each distinct window; ``window`` is its
    words with spaces between.  Items without an id or a word have none."""
    named = items.where("item_id is not null").select("item_id", words().alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - size))
    cut_out = named.select("item_id", "w", size.alias("size"), at.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, F.col("size")).alias("words"), "size")
    rows = cut(cut_out.withColumn("window", F.array_join("words", " ")).distinct(), "leak-windows")
    return rows.select("window", "item_id"), rows.select("window", "words", "size").distinct()


def _shingles(distinct: DataFrame, sizes: list[int]) -> DataFrame:
    """(window, words, size, o, h, s): each shingle of each window."""
    each = F.lit(None)
    for s in sizes:
        own = _starts(F.col("words"), s)
        each = F.when(F.least("size", F.lit(SHINGLE)) == s, _named(F.col("words"), own, s, "o")).otherwise(each)
    return distinct.select("window", "words", "size", F.explode(each).alias("x")).select("window", "words", "size", "x.*")


def bitmap(hashes: DataFrame):
    """A test of a hash column by a bitmap of ``hashes`` (h), two bits each: false only for hashes
    not among them, and true for one in a thousand of those.  64 bits for each hash, up to the largest size."""
    n = hashes.count()
    slots = min(SLOTS[1], max(SLOTS[0], 1 << n.bit_length()))
    slot = lambda h, k: F.shiftrightunsigned(h, 6 + 29 * k).bitwiseAND(F.lit(slots - 1)).cast("int")
    bit = lambda h, k: F.shiftrightunsigned(h, 29 * k).bitwiseAND(F.lit(63)).cast("int")
    pair = F.explode(F.array(*(F.struct(slot(F.col("h"), k).alias("k"), bit(F.col("h"), k).alias("b")) for k in (0, 1)))).alias("x")
    rows = hashes.select(pair).groupBy("x.k").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.b"))).alias("v"))
    held = [0] * slots
    for r in rows.collect():  # at most one row for each slot
        held[r["k"]] = r["v"]
    whole = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")  # folded into one literal
    return lambda h: (F.getbit(F.get(whole, slot(h, 0)), bit(h, 0)) == 1) & (F.getbit(F.get(whole, slot(h, 1)), bit(h, 1)) == 1)


def _met(w: Column, sizes: list[int], wanted) -> Column:
    """Array of (at, h, s): the places whose shingle passes the bitmap."""

    def of(s: int) -> Column:
        return _named(w, F.filter(_starts(w, s), lambda i: F.exists(F.array(_hash(w, i, s)), wanted)), s, "at")

    found = [of(s) for s in sizes]
    return found[0] if len(found) == 1 else F.concat(*found)


def _digests() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def _occurrences(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d1, d2, n_words) of each row, and (doc_id, d1, d2, start, size, item_id)."""
    of_items, distinct = windows(items, window)
    sizes = sorted(r[0] for r in distinct.select(F.least("size", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    shingles = cut(_shingles(distinct, sizes), "leak-shingles")
    # Rarity: how often the documents have each shingle.
    wanted = bitmap(shingles.select("h").distinct())
    tokens = docs.select(words().alias("w"))
    counted = tokens.select(F.explode(_met(F.col("w"), sizes, wanted)).alias("x")).groupBy("x.h").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(counted, "h", "left").groupBy("window", "words", "size")
    rarest = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o", "s")).alias("p")).where("p.n > 0")
    prefix = cut(rarest.select("window", "words", "size", "p.h", "p.o", "p.s"), "leak-prefixes")
    # Each place that passes the prefixes' bitmap takes along the words a window could hold there.
    wanted = bitmap(prefix.select("h").distinct())
    w, at = F.col("w"), F.col("x.at")
    named = docs.select("doc_id", *_digests(), words().alias("w"))
    low = F.greatest(at - (window - 1), F.lit(0))
    met = named.select("doc_id", "d1", "d2", F.size("w").cast("long").alias("n_words"), F.transform(
        _met(w, sizes, wanted),
        lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), x["s"].alias("s"), F.slice(w, F.greatest(x["at"] - (window - 1), F.lit(0)) + 1, 2 * window).alias("near")),
    ).alias("xs")).select("doc_id", "d1", "d2", "n_words", F.posexplode_outer("xs").alias("k", "x"))
    met = cut(met, "leak-places")
    start = F.col("at") - F.col("o")
    placed = met.where("x is not null").select("doc_id", "d1", "d2", "n_words", at.alias("at"), low.alias("low"), "x.h", "x.s", "x.near").join(prefix, ["h", "s"])
    bounded = placed.where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    exact = bounded.where(F.slice("near", start - F.col("low") + 1, F.col("size")) == F.col("words"))
    found = exact.select("doc_id", "d1", "d2", start.alias("start"), "size", "window").join(of_items, "window").drop("window")
    return met.where("k is null or k = 0").select("doc_id", "d1", "d2", "n_words"), found


def _per_text(found: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n_hit, item_ids): words inside an occurrence, and the items, of each text."""
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    sets = found.groupBy("doc_id", "d1", "d2").agg(F.collect_set(span).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))

    def longer(s: Column, x: Column) -> Column:
        reach = F.greatest(s["reach"], x["end"])
        return F.struct((s["n"] + reach - F.greatest(s["reach"], x["start"])).alias("n"), reach.alias("reach"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    n_hit = F.aggregate(F.array_sort("spans"), zero, longer, lambda s: s["n"].cast("long"))
    return sets.select("doc_id", "d1", "d2", n_hit.alias("n_hit"), F.array_sort("items").alias("item_ids"))


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, size, item_id): every occurrence of an item's window in a text, in words
    from 0; texts that rows repeat with their id give theirs once."""
    found = _occurrences(docs, items, window)[1]
    return found.select("doc_id", "d1", "d2", "start", "size", "item_id").distinct().drop("d1", "d2")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of each row of ``docs``: its words, those inside any
    occurrence of an item's window, and the items with such windows, sorted as strings.

    Null and empty texts have no words; texts of any length are read whole.  Rows of ``items`` that repeat
    an id add their windows to it; those without an id or a word have none.  Repeated rows of ``docs``
    get equal results, each its own; a null doc_id is kept.  Rows meet their results by id and two
    hashes of the text, so neither row numbers nor the order of rows matter.  Empty tables give no rows, or
    no hits.  Only doc_id and text, and item_id and text, are read.
    """
    every, found = _occurrences(docs, items, window)
    hits = _per_text(found).withColumnsRenamed({"doc_id": "id", "d1": "e1", "d2": "e2"})
    met = every.join(hits, every["doc_id"].eqNullSafe(hits["id"]) & (every["d1"] == hits["e1"]) & (every["d2"] == hits["e2"]), "left")
    none = F.array().cast("array<string>")
    return met.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no window of an item occurs in, all their columns, whatever
    their names; odd rows as in :func:`contamination`."""
    found = _occurrences(docs, items, window)[1].select(F.col("doc_id").alias("id"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).distinct()
    d1, d2 = _digests()
    n1, n2 = free_name(docs, "digest"), free_name(docs, "digest_more")
    named = docs.withColumns({n1: d1, n2: d2})
    met = named["doc_id"].eqNullSafe(found["id"]) & (named[n1] == found["e1"]) & (named[n2] == found["e2"])
    return named.join(found, met, "left_anti").select(*columns(docs))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
with d as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null
), begun as (
  select item_id, w, least(len(w), 10) as size, unnest(range(len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0
), windows as (
  select distinct item_id, size, array_to_string(w[i + 1:i + size], ' ') as span from begun
), sizes as (
  select distinct size from windows
), places as (
  select k, w, size, unnest(range(len(w) - size + 1)) as i from d, sizes where len(w) >= size
), met as (
  select k, i, p.size, item_id
  from (select k, i, size, array_to_string(w[i + 1:i + size], ' ') as span from places) p join windows using (span, size)
), hit as (
  select k, count(distinct place) as n_hit from (select k, unnest(range(i, i + size)) as place from met) group by k
), items as (
  select k, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct k, cast(item_id as varchar) as item from met) group by k
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (k) left join items using (k)
"""
