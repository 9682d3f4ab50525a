"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has 64 bits, cut into a ring of four 16-bit segments.  Two fingerprints at
Hamming distance 3 or less have a segment ``i`` from which every chain of consecutive
segments keeps within its proportional budget: after ``l`` segments at most
``floor(3 * l / 4)`` bits differ, that is 0, 1, 2, 3.  The chain of length two gives a
32-bit equi-join key (segment ``i`` equal, segment ``i + 1`` with at most one flipped bit:
17 probes), and the chains of length three and four are checked inside the join, before a
pair leaves it.  All links of distance 3 or less are found and no others.

Equal fingerprints are one node.  A key under which a family of thousands of near copies
meets is not expanded into pairs: there the members meet at *hubs* (see ``_hot_links``),
which give the same components with a number of rows linear in the family.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, col, columns, free_name, has_map, table
from siftstone.operators.graph import components
from siftstone.sources.scratch import cut

#: A key with more candidate pairs than this is resolved through hubs.
HOT_PAIRS = 4096


def simhash64(text: str | None) -> int:
    """Unsigned fingerprint: majority bits of XXH64 (seed 42) over 3-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - 2)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8", count=n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(simhash64, text), dtype=np.uint64, count=len(text)).view(np.int64))


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp long, and ``more``): the fingerprint of each whole text; null text counts as empty."""
    return docs.select("doc_id", F.pandas_udf(_fingerprint, "long")("text").alias("fp"), *more)


def _turned(fp, i: int):
    """``fp`` rotated so that segment ``i`` (from the top) comes first."""
    s = 16 * i
    return fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))


def _keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows (key, fp, rest) and probe rows (key, fp, rest, flips)."""
    fp = F.col("fp")
    low = F.lit(0xFFFFFFFF)
    turns = F.array(
        *(
            F.struct(
                F.lit(i).cast("long").alias("i"),
                F.shiftrightunsigned(_turned(fp, i), 32).alias("head"),
                _turned(fp, i).bitwiseAND(low).alias("rest"),
            )
            for i in range(4)
        )
    )
    each = nodes.select("fp", F.explode(turns).alias("t")).select(
        "fp", "t.rest", F.shiftleft("t.i", 32).bitwiseOR(F.col("t.head")).alias("key")
    )
    masks = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << b for b in range(16)))))
    probes = each.select("fp", "rest", "key", F.explode(masks).alias("m")).select(
        F.col("key").bitwiseXOR(F.col("m")).alias("key"),
        "fp",
        "rest",
        F.when(F.col("m") == 0, 0).otherwise(1).alias("flips"),
    )
    return each.select("key", "fp", "rest"), probes


def _cold_links(index: DataFrame, probes: DataFrame) -> DataFrame:
    # Merge joins are asked for wherever a side is exploded: its estimated size isn't.
    a, b = probes.hint("merge").alias("a"), index.alias("b")
    third = F.bit_count(F.shiftrightunsigned(F.col("a.rest").bitwiseXOR(F.col("b.rest")), 16))
    whole = F.bit_count(F.col("a.rest").bitwiseXOR(F.col("b.rest")))
    return a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.col("a.flips") + third <= 2)
        & (F.col("a.flips") + whole <= 3),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _hot_links(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Links of the same components for keys under which too many candidates meet.

    Under one key, members whose key is exactly this one (``near``, ``far``) differ only
    in the 32 remaining bits, and members one flip away (``side``) may differ there in two
    bits.  Every 32-bit word ``x`` within one bit of a member is a hub.  If a ``near``
    member (at most one bit from ``x``) exists, every other ``near`` member, every ``far``
    member (two bits from ``x``) and every ``side`` member (one bit from ``x``) is within
    three bits of it, so linking all to the smallest ``near`` member adds no false link.
    Each true link meets at some hub, so none is lost.  Rows grow linearly in the members.
    """
    one = [1 << b for b in range(32)]
    near = F.array(*(F.lit(m).cast("long") for m in (0, *one)))
    two = F.array(*(F.lit(x | y).cast("long") for k, x in enumerate(one) for y in one[:k]))

    def hubs(rows: DataFrame, masks) -> DataFrame:
        return rows.select(
            "key", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("rest")))).alias("x"), "fp"
        )

    centre = hubs(index, near)
    ring = hubs(index, two)
    side = hubs(probes.where("flips = 1"), near)
    heads = centre.groupBy("key", "x").agg(F.min("fp").alias("u"))
    rows = centre.unionByName(ring).unionByName(side).select("key", "x", F.col("fp").alias("v"))
    return rows.hint("merge").join(heads, ["key", "x"]).where("u != v").select("u", "v")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose transitive closure is that of all
    pairs at distance 3 or less.  ``nodes`` has one row for each distinct ``fp``."""
    index, probes = _keys(nodes)
    busy = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Probe sides are counted only where the index side repeats.
    cost = (
        probes.select("key")
        .join(busy.hint("merge"), "key")
        .groupBy("key")
        .agg((F.count(F.lit(1)) * F.first("n")).alias("cost"))
        .where(F.col("cost") > HOT_PAIRS)
        .select("key")
    )
    hot = cut(cost, "simhash-hot")
    if hot.isEmpty():
        return _cold_links(index, probes)
    cold = _cold_links(index.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti"))
    warm = _hot_links(index.join(hot, "key", "left_semi"), probes.join(hot, "key", "left_semi"))
    return cold.unionByName(warm)


def _classified(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp, and ``more``, root, component_id): ``root`` names the class."""
    with arrow_batches(docs.sparkSession):
        small = cut(fingerprints(docs, *more), "simhash-fp")
    nodes = cut(small.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    names = components(links(nodes.select("fp")))
    named = nodes.join(names.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "root").select("fp", "root", "component_id")
    return small.join(classes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): class of each document, by its smallest doc_id.

    Null or empty texts have fingerprint zero and are linked like any other; texts of any
    length are read whole.  Repeated
    rows stay, each with its class.  A null doc_id takes part with its text; a class of
    null ids alone has a null component_id.  An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    return _classified(docs).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate class one row stays.

    It is the one with the smallest doc_id, null ids last; of rows with that id the one whose
    text's digest is smallest; of rows that repeat id and text the one whose other columns are
    smallest, or, where a column holds a map, whose row's digest is.  So no class is lost where ids repeat with different texts or are null.  Null and
    empty texts are one class; long texts are read whole.  All columns stay, whatever their names; an empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    digest = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    found = cut(_classified(docs, digest[0].alias("d1"), digest[1].alias("d2")), "simhash-classes")
    rows = found.groupBy("root", "doc_id", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d1", "d2")).alias("k")
    heads = found.groupBy("root").agg(best)
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d1") == F.col("k.d1")) & (F.col("d2") == F.col("k.d2"))
    judged = rows.join(heads, "root").select(F.col("doc_id").alias("id"), "d1", "d2", "n", stays.alias("stays"))
    judged = cut(judged.where("not stays or n > 1"), "simhash-judged")
    n1, n2 = free_name(docs, "digest"), free_name(docs, "digest_more")
    named = docs.withColumns({n1: digest[0], n2: digest[1]})

    # Merge joins at every size: what goes can be as much as what there is, and its table says little of its size.
    def met(some: DataFrame) -> Column:
        return named["doc_id"].eqNullSafe(some["id"]) & (named[n1] == some["d1"]) & (named[n2] == some["d2"])

    gone, repeated = judged.where("not stays"), judged.where("stays")
    if repeated.isEmpty():
        return named.join(gone.hint("merge"), met(gone), "left_anti").select(*columns(docs))
    once = named.join(judged.hint("merge"), met(judged), "left_anti").select(*columns(docs))
    several = named.join(repeated.hint("merge"), met(repeated), "left_semi")
    row = F.struct(*columns(docs))
    # Columns without an order (maps) are told apart by a digest.
    least = F.min_by(row, F.sha2(F.to_json(row), 256)) if has_map(docs.schema) else F.min(row)
    one = several.groupBy("doc_id", n1, n2).agg(least.alias("r")).select("r.*")
    return once.unionByName(one)
