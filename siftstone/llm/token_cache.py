"""Token counts through a digest cache.

The content is normalised (null becomes the empty text; nothing else, since any other
change could change a count) and named by its SHA-256.  The tokenizer version is the
SHA-256 of the vocabulary file and the library's version.  Stored counts are joined by both digests; only
distinct misses are encoded, by the library itself, and appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, table
from siftstone.sources.scratch import cut, scratch_path

VOCABULARY = "piece_bpe_32k.model"
SCHEMA = "version string, digest binary, n_tokens long"
LIMIT = 4096


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


_loaded: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:
            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = _loaded[path]
        for pdf in batches:
            counts = [len(sp.encode(t)) for t in pdf["text"]]
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": counts})

    return run


class TokenCache:
    """Append-only Parquet table of (version, digest, n_tokens) in a shared folder, a folder for
    each version, so that the counts of other tokenizers are not read.

    An append is one Spark write, so it is whole or absent.  Two runs may append the same
    digest; they append the same count, and reads keep one row for a digest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("version").parquet(path)

    def counts(self, version: str) -> DataFrame:
        """(digest, n_tokens) stored for this version."""
        stored = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("version") == version)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(self.path)


def count_tokens(docs: DataFrame, cache: TokenCache, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs``; the cache gains the misses.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are kept, each with its
    count; a null doc_id is kept as null.  Texts of any length are encoded whole.  Only
    the columns doc_id and text are read.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    version = tokenizer_version(vocabulary)
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = cut(named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "tokens-keys")
    # The row that stands for a content is that of its smallest id: one row for each digest
    # and task is shuffled, however many copies a content has.
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("s")
    contents = keys.groupBy("digest").agg(stand).select("digest", "s.doc_id", "s.none")
    missing = contents.join(cache.counts(version), "digest", "left_anti")
    # Where only rows without an id have a content, or the row repeats, one of several equal
    # rows is taken below.
    repeats = keys.where("doc_id is not null").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = F.col("none") | F.col("n").isNotNull()
    misses = cut(missing.join(repeats, ["digest", "doc_id"], "left").select("digest", "doc_id", several.alias("several")), "tokens-misses")
    if not misses.isEmpty():
        texts = named.join(misses.where("not several").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("digest", "text")
        odd = misses.where("several").select("digest")
        if not odd.isEmpty():
            texts = texts.unionByName(named.join(odd, "digest", "left_semi").select("digest", "text").dropDuplicates(["digest"]))
        with arrow_batches(spark):
            cache.append(texts.mapInPandas(_counter(vocabulary), "digest binary, n_tokens long"), version)
    # As a table of its own the counts leave the join free to split a content of many copies.
    counts = cut(cache.counts(version).join(contents.select("digest"), "digest", "left_semi"), "tokens-counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that its figures are those of encoding every text."""
    cache = TokenCache(spark, scratch_path(spark, "token-cache"))
    out = count_tokens(table(spark, sf_dir, "documents"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
