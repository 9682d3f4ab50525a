"""Quality rules whose thresholds follow the data.

Each document gets counts; the rates of those that have words are put into mergeable
quantile sketches for each language and source (relative-error buckets: a sketch is a count
for each bucket, sketches merge by adding counts, and a merge in any order gives the same
sketch).  A cell's fences are its 10 and 90 % quantiles, moved outwards by twice their
distance from the median.  Nothing is added: where 90 % of a source's texts hold no symbols,
its fence is none, and where symbols are usual, it is higher.  Every cell's sketch is blended
with that of its language, and that with all documents', each as heavy as ``BORROWED``
documents: a cell of few documents mostly borrows, a large one goes by its own, and there
is no step between the two.

A rate measured on few words varies by chance, so a text is outside a fence only if its
count is, less three standard errors (of a Poisson count).  A joined filter applies the fences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, bound_batches, columns, table
from siftstone.sources.scratch import cut

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Relative width of a sketch's buckets.
GAMMA = 1.05
#: Rates below this count as none.
LEAST = 1e-3
#: Documents that the wider distribution weighs as many as, in a cell's and in a language's.
BORROWED = 50
#: The share of a cell between its tail quantiles and each end, and how far fences lie outside
#: them, in distances from the median.
TAIL = 0.1
SPREADS = 2.0
#: Standard errors of a count that chance is allowed.
CHANCE = 3.0
#: Each rate: a count, and what it is measured by.
RATES = {
    "symbols": ("n_symbols", "n_words"), "upper": ("n_upper", "n_letters"), "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"),
}
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    v = len(known)
    if v == n:
        return 0
    key, base = ids[: n - width + 1].copy(), v  # base: keys are below it
    for k in range(1, width):
        if base * v >= 1 << 62:  # ranks in place of keys; they stay exact
            _, key = np.unique(key, return_inverse=True)
            base = n
        key = key * v + ids[k : n - width + 1 + k]
        base *= v
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    b = text.encode("utf-8", "surrogatepass")
    n = len(b)
    words = b.split()
    without = lambda chars: n - len(b.translate(None, chars))
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper = without(_UPPER)
    return (
        len(words), len(text) - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), upper, upper + without(_LOWER),
    )


def _counts(text: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return pd.DataFrame([counts(t) for t in text], columns=names, dtype="int64")


def _udf():
    return F.pandas_udf(_counts, COUNTS)


def _cell(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def _bucket(v: Column) -> Column:
    return F.when(v < LEAST, F.lit(_NONE)).otherwise(F.ceil(F.log(v) / float(np.log(GAMMA)))).cast("int")


_NONE = -1000


def _edge(bucket: str, upper: bool) -> Column:
    """An end of a bucket."""
    return F.when(F.col(bucket) == _NONE, F.lit(LEAST if upper else 0.0)).otherwise(F.pow(F.lit(GAMMA), F.col(bucket) - (0 if upper else 1)))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, bucket, n): one sketch for each cell and rate, of the
    documents that have words, also those that fail the base rules: without their repeats a
    cell's usual ones would look like its tail."""
    of = lambda count, by: F.col(count) / F.greatest(F.col(by), F.lit(1))
    pairs = F.array(*(F.struct(F.lit(k).alias("rate"), of(*v).alias("v")) for k, v in RATES.items()))
    rows = measured.where("n_words > 0").select("lang_key", "source_key", F.explode(pairs).alias("p"))
    return rows.groupBy("lang_key", "source_key", "p.rate", _bucket(F.col("p.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def blended(sketches: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, bucket, weight): each cell's sketch and what it borrows."""
    keys = ["lang_key", "source_key", "rate"]
    cells = sketches.select(*keys).distinct()
    by_lang = sketches.groupBy("lang_key", "rate", "bucket").agg(F.sum("n").alias("n"))
    size = by_lang.groupBy("lang_key", "rate").agg(F.sum("n").alias("size"))
    every = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    total = every.groupBy("rate").agg(F.sum("n").alias("total"))
    share = F.lit(float(BORROWED)) / (F.col("size") + BORROWED)
    # The language's share of what a cell borrows, and the share of all documents.
    lang = cells.join(size, ["lang_key", "rate"]).join(by_lang, ["lang_key", "rate"]).select(*keys, "bucket", (F.col("n") * share).alias("weight"))
    rest = cells.join(size, ["lang_key", "rate"]).join(every.join(total, "rate"), "rate").select(*keys, "bucket", (share * BORROWED * F.col("n") / F.col("total")).alias("weight"))
    own = sketches.select(*keys, "bucket", F.col("n").cast("double").alias("weight"))
    return own.unionByName(lang).unionByName(rest).groupBy(*keys, "bucket").agg(F.sum("weight").alias("weight"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang_key, source_key, and for each rate its lower and upper fence)."""
    keys = ["lang_key", "source_key", "rate"]
    w = Window.partitionBy(*keys)
    # Rounded, as sums of the same weights in another order may differ in the last digits.
    upto = F.round(F.sum("weight").over(w.orderBy("bucket")) / F.sum("weight").over(w), 9)
    at = lambda q, upper: F.min(F.when(F.col("upto") >= q, _edge("bucket", upper)))
    # Of a bucket that holds a quantile the end that lies outside counts.
    quantiles = {"low": at(TAIL, False), "low_mid": at(0.5, False), "high_mid": at(0.5, True), "high": at(1 - TAIL, True)}
    found = blended(sketches).withColumn("upto", upto).groupBy(*keys).agg(*(q.alias(k) for k, q in quantiles.items()))
    low = F.col("low") - SPREADS * (F.col("low_mid") - F.col("low"))
    high = F.col("high") + SPREADS * (F.col("high") - F.col("high_mid"))
    flat = found.withColumn("low_fence", low).withColumn("high_fence", high).groupBy("lang_key", "source_key")
    return flat.agg(*(F.max(F.when(F.col("rate") == k, F.col(f"{side}_fence"))).alias(f"{side}_{k}") for k in RATES for side in ("low", "high")))


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _verdict() -> Column:
    inside = F.lit(True)
    for k, (count, by) in RATES.items():
        chance, by = CHANCE * F.sqrt(count), F.greatest(F.col(by), F.lit(1))
        fits = ((F.col(count) - chance) / by <= F.col(f"high_{k}")) & ((F.col(count) + chance) / by >= F.col(f"low_{k}"))
        inside = inside & F.coalesce(fits, F.lit(True))
    return ~F.col("base_failed") & inside


def _measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", _cell("lang").alias("lang_key"), _cell("source").alias("source_key"), _udf()("text").alias("m"))
    with arrow_batches(docs.sparkSession):
        return cut(rows.select("doc_id", "lang_key", "source_key", "m.*"), "rules-counts")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept) for each row of ``docs``.

    Null texts count as empty and fail the base rules, as all texts of under 10 words.  Texts
    of any length are measured whole.  Null languages and sources are cells of their own.
    Equal rows get equal verdicts: repeated rows are judged each, and count each in the sketches; a null
    doc_id is kept.  A rate that equals its fence is inside.  An empty table gives no rows.  Only doc_id, text, lang and
    source are read, so other columns may have any name.
    """
    rows = _measured(docs)
    limits = cut(fences(sketch(rows)), "rules-fences")
    joined = rows.join(limits, ["lang_key", "source_key"], "left").withColumn("base_failed", _base_failed())
    return joined.select("doc_id", *BASE, "base_failed", _verdict().alias("kept"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, all their columns, whatever their
    names.  Nulls, long and repeated texts and empty tables are treated as in :func:`judge`.
    The texts are measured a second time where they lie, which is cheaper than moving them
    to their counts."""
    limits = cut(fences(sketch(_measured(docs))), "rules-fences")
    bound_batches(spark)
    row = F.struct(*columns(docs))
    again = docs.select(row.alias("row"), _cell("lang").alias("lang_key"), _cell("source").alias("source_key"), _udf()("text").alias("m"))
    joined = again.select("row", "lang_key", "source_key", "m.*").join(limits, ["lang_key", "source_key"], "left")
    return joined.withColumn("base_failed", _base_failed()).where(_verdict()).select("row.*")
