"""How filters interact: what each removes in every order they could be applied in.

Every row holds a bit for each filter it fails and for each label.  A task packs its rows
into bitsets, one for each filter and label, in which the rows of a part (a source) fill
whole 64-bit words, so that a part is a run of words.  The rows that pass a set of filters are
those of the set without one filter, AND NOT that filter's bitset; their number is a
popcount, summed over a part's words.  Each of the ``2 ** k`` sets is visited once for all
``k!`` orders that have it as a prefix, and only the counts leave the task: they are
summed over tasks, and any step of any order is a difference of two of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, table
from siftstone.sources.scratch import cut

#: Filters whose orders are listed, at most: 8! orders of 8 steps for each part.
MAX_FILTERS = 8
FLAG_ROWS = 1 << 16
_SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))


def bitset(bits: np.ndarray) -> np.ndarray:
    """Booleans, a multiple of 64 of them, as 64-bit words."""
    return np.packbits(bits, bitorder="little").view("<u8")


def subset_counts(part: np.ndarray, flags: np.ndarray, k: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts, and for each part and set of ``k`` filters (a mask) the rows that pass the set:
    all of them, and those with each label.  ``flags`` has the filters' bits and then the labels'."""
    parts, code, size = np.unique(part, return_inverse=True, return_counts=True)
    words = -(-size // 64)
    first = np.cumsum(words) - words  # each part's first word
    order = np.argsort(code, kind="stable")
    place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + 64 * np.repeat(first, size)
    lain = np.zeros((k + labels + 1, 64 * int(words.sum())), dtype=bool)
    lain[:, place] = np.concatenate([(flags[order] >> np.arange(k + labels)[:, None]) & 1 == 1, np.ones((1, len(part)), dtype=bool)])
    sets = [bitset(row) for row in lain]
    passing = [sets[-1]]
    for s in range(1, 1 << k):
        top = s.bit_length() - 1
        passing.append(passing[s ^ (1 << top)] & ~sets[top])
    masks = [None, *sets[k : k + labels]]
    count = lambda p, m: np.add.reduceat(np.bitwise_count(p if m is None else p & m).astype(np.int64), first)
    return parts, np.array([[count(p, m) for m in masks] for p in passing]).transpose(2, 0, 1)  # part, set, label


def _index(k: int, labels: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            parts, n = subset_counts(pdf["part"].to_numpy(dtype=object), pdf["flags"].to_numpy(dtype=np.int64), k, len(labels))
            rows = {"part": np.repeat(parts, 1 << k), "subset": np.tile(np.arange(1 << k, dtype=np.int32), len(parts))}
            yield pd.DataFrame(rows | {c: n[:, :, i].ravel() for i, c in enumerate(["n", *labels])})

    return run


def passing_counts(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, n, and each label): the rows of ``rows`` (part string, a boolean for each
    filter, true if it fails, and for each label) that pass all filters of the mask ``subset``."""
    bits = [F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate([*filters, *labels])]
    flags = sum(bits[1:], bits[0]).cast("long")
    schema = ", ".join(["part string", "subset int", *(f"`{c}` long" for c in ["n", *labels])])
    packed = rows.select("part", flags.alias("flags")).mapInPandas(_index(len(filters), labels), schema)
    sums = packed.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ["n", *labels]))
    with arrow_batches(rows.sparkSession, FLAG_ROWS):
        return cut(sums, "audit-counts")


def _steps(filters: list[str]) -> tuple[str, str]:
    steps = []
    for order in permutations(range(len(filters))):
        name, seen = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append({"o": name, "s": step, "f": i, "b": seen, "a": seen | 1 << i})
            seen |= 1 << i
    return json.dumps(steps), "array<struct<o:string,s:int,f:int,b:int,a:int>>"


def audit(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost for each
    label, shapley) for each part of ``rows`` and each step of each order of the filters.

    ``rows`` has part (null: the empty string), a boolean for each filter (null: passes) and
    for each label (null: without).  Every row counts, repeated ones each.  A part without rows
    has no result, so an empty table gives none.  Other columns are not read.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters")
    k = len(filters)
    named = rows.select(F.coalesce("part", F.lit("")).alias("part"), *(F.coalesce(c, F.lit(False)).alias(c) for c in [*filters, *labels]))
    cell = F.struct("subset", "n", *labels)  # 2 ** k of them in a part
    parts = passing_counts(named, filters, labels).groupBy("part").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    full = (1 << k) - 1

    def at(subset, column: str = "n") -> Column:
        return F.element_at("c", F.lit(subset) + 1 if isinstance(subset, int) else subset + 1)[column]

    def shapley(i: int) -> Column:
        """Removed by a filter, over all orders: a prefix of p filters begins p! (k - p - 1)! of them."""
        total = F.lit(0).cast("long")
        for s in range(1 << k):
            if not s >> i & 1:
                times = factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
                total = total + F.lit(times) * (at(s) - at(s | 1 << i))
        return total

    fixed = parts.select(
        "part",
        "c",
        F.array(*(at(0) - at(1 << i) for i in range(k))).alias("fails"),
        F.array(*(at(full ^ 1 << i) - at(full) for i in range(k))).alias("unique"),
        F.array(*(shapley(i) for i in range(k))).alias("shares"),
    )
    text, schema = _steps(filters)
    each = fixed.select("*", F.explode(F.from_json(F.lit(text), schema)).alias("x"))
    before, after, own = F.col("x.b"), F.col("x.a"), F.col("x.f") + 1
    removed = at(before) - at(after)
    return each.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        at(after).alias("kept"),
        removed.alias("removed"),
        (F.element_at("fails", own) - removed).alias("redundant"),
        F.element_at("unique", own).alias("unique_fails"),
        *((at(before, c) - at(after, c)).alias(f"{c}_lost") for c in labels),
        F.element_at("shares", own).alias("shapley"),
    )


def text_fails(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    text = text or ""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    upper = len(b) - len(b.translate(None, _UPPER))
    fails = (n < 50, 100 * len(set(words)) < 65 * n, 100 * upper > 5 * len(text), len(b.translate(None, _SYMBOLS)) < len(b))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _text_fails(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(text_fails, text), dtype=np.int32, count=len(text)))


def text_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, A to E, good, toxic) of each row of ``docs``, texts read whole.

    E: another row has this text and a smaller doc_id; a null doc_id comes after all others,
    and rows that repeat an id with its text are alike.  The first of a text is found by its SHA-256 in an
    aggregation, and rows meet it by digest and id, so a text of many copies is no hot key.
    Null texts are empty.  Labels that repeat a doc_id count if any of them is 1; rows without a label
    or an id have none.  Only doc_id, text and source are read, and doc_id, quality and toxic.
    """
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.pandas_udf(_text_fails, "int")("text").alias("fails"),
    )
    with arrow_batches(docs.sparkSession):
        facts = cut(facts, "audit-facts")
    first = facts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("h"))
    first = first.select(F.col("digest").alias("d"), F.col("h.doc_id").alias("id"), F.lit(True).alias("first"))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("l"))
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = facts.join(first, (facts["digest"] == first["d"]) & facts["doc_id"].eqNullSafe(first["id"]), "left")
    rows = met.join(marked, met["doc_id"] == marked["l"], "left")
    bit = lambda i: F.col("fails").bitwiseAND(F.lit(1 << i)) != 0
    return rows.select("doc_id", "part", *(bit(i).alias(c) for i, c in enumerate("ABCD")), F.col("first").isNull().alias("E"), "good", "toxic")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, list("ABCDE"), ["good", "toxic"])


OP12_SQL = r"""
with rows as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
), flags as (
  select part,
         (case when len(words) < 50 then 1 else 0 end)
         + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end)
         + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
         + (case when coalesce(rows.doc_id, 9223372036854775807) > min(coalesce(rows.doc_id, 9223372036854775807)) over (partition by text) then 16 else 0 end) as m,
         coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from rows left join marks using (doc_id)
), cells as (
  select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by part, m
), letters as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, b)
), orders as (
  select v.l || w.l || x.l || y.l || z.l as filter_order, [v.b, w.b, x.b, y.b, z.b] as bits
  from letters v, letters w, letters x, letters y, letters z
  where v.b + w.b + x.b + y.b + z.b = 31 and (v.b | w.b | x.b | y.b | z.b) = 31
), steps as (
  select filter_order, step, bits[step] as f, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as seen
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)
), counts as (
  select part, filter_order, step, f,
         sum(case when (m & (seen | f)) = 0 then n else 0 end) as kept,
         sum(case when (m & seen) = 0 and (m & f) <> 0 then n else 0 end) as removed,
         sum(case when (m & seen) <> 0 and (m & f) <> 0 then n else 0 end) as redundant,
         sum(case when m = f then n else 0 end) as unique_fails,
         sum(case when (m & seen) = 0 and (m & f) <> 0 then good else 0 end) as good_lost,
         sum(case when (m & seen) = 0 and (m & f) <> 0 then toxic else 0 end) as toxic_lost
  from steps, cells group by part, filter_order, step, f
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from counts
"""
