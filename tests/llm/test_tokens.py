"""Token counts and packing beside the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import packing, token_cache
from siftstone.sources.scratch import scratch_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPECIAL = ["<|endoftext|>", "<|startoftext|>"]
ODD = [
    *(f(t).join(x) for t in SPECIAL for f in (str, str.upper, str.title) for x in (["", ""], ["in", "side"], ["a ", " b."], ["é", "É"], ["汉", " q"])), "<|EndOfText", "<|ENDOFTEXT|", "<| ENDOFTEXT |>",
    "", " ", "plain words, and stops.", "<|endoftext|> inside <s> </s> <unk>", "a$$$, b.. c., d", "it's, don't. ÀÉß² 3.5, 10.", "x\x1cy z\x1d", "ΣΑΣ İstanbul é q",
    "a\xa0b\x85c", "汉字, and. 𝔘nicode.", "é Å. É. É", "word " * 9000, "don.t a.,b A. B, Ab. aB,", "▁ ▁▁ tabs\t\tand\nlines\n",
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(50, None, None, None, None), (2, ODD[2], "en", "s", 1), (None, ODD[3], "en", "s", 1), (None, "only here", "en", "s", 1)]
    clash = {"digest": "x", "n_tokens": 1, "n_bytes": "y", "version": 0, "piece": "p", "length": 3, "mix": 1, "group": 2}
    df = spark.createDataFrame(rows, DOCS)
    for k, v in clash.items():
        df = df.withColumn(k, F.lit(v))
    return df, [(r[0], r[1] or "") for r in rows]


def test_counts(spark, odd):
    df, rows = odd
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, len(t.encode()), len(sp.encode(t))) for i, t in rows), key=str)
    cache = token_cache.TokenCache(spark, scratch_path(spark, "test-cache"))
    got = lambda: sorted(map(tuple, token_cache.count_tokens(df, cache).collect()), key=str)
    assert got() == want
    stored = spark.read.parquet(cache.path).count()
    assert stored == len({t for _, t in rows})
    assert got() == want and spark.read.parquet(cache.path).count() == stored  # nothing is encoded again
    more = df.limit(1).withColumn("text", F.lit("a new text"))
    token_cache.count_tokens(more, cache).collect()
    assert spark.read.parquet(cache.path).count() == stored + 1
    assert token_cache.count_tokens(df.limit(0), cache).count() == 0
    assert cache.counts("another version").count() == 0


def test_count_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = token_cache.op5_tokens(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out} == {
        i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs.items()
    }


def check_packing(rows, docs, size=2048):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in docs:
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, odd):
    df, rows = odd
    check_packing(packing.pack(df).collect(), rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_special_strings_in_any_case_are_what_the_library_makes_of_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    tk, ours = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    assert ours.special == [t.lower() for t in (a.content for a in tk.get_added_tokens_decoder().values())]
    for t in ODD:
        assert np.frombuffer(ours.encode([t])[0], dtype="<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("look_ahead,group", [(1, 100_000), (1024, 100_000), (7, 20)])
def test_lots_and_stretches(spark, look_ahead, group):
    """No sequence holds pieces of two lots, however pieces are grouped; rows that are all alike too."""
    rows = [(k, f"word {'more ' * (k % 50)}", "en", f"s{k // 100}", 1) for k in range(300)] + [(None, "", None, None, None)] * 200
    df = spark.createDataFrame(rows, DOCS).repartitionById(5, F.coalesce(F.substring("source", 2, 1).cast("int"), F.lit(4)))
    out = packing.pack(df, size=64, look_ahead=look_ahead, group=group, lot=F.coalesce(F.substring("source", 2, 1).cast("int"), F.lit(4)))
    got = out.collect()
    assert len([r for r in got if r["doc_id"] is None]) == 200
    check_packing(got, [(r[0], r[1]) for r in rows], 64)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], set()).add(4 if r["doc_id"] is None else r["doc_id"] // 100)
    assert all(len(lots) == 1 for lots in held.values())


def test_packing_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.op6_packing(spark, SF).collect()
    n = check_packing(rows, docs)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1
    assert sorted(map(tuple, packing.op6_packing(spark, SF).collect())) == sorted(map(tuple, rows))


def test_bounded_best_fit_against_a_plain_one():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 3000)
    bins, offset = packing.pack_lengths(lengths, 100, 10)
    open_, n, want = [], 0, []  # (free, bin), the newest of equal ones last
    for x in lengths:
        fit = [k for k, (free, _) in enumerate(open_) if free >= x]
        if fit:
            k = max((k for k in fit if open_[k][0] == min(open_[j][0] for j in fit)), default=None)
            free, b = open_.pop(k)
        else:
            free, b, n = 100, n, n + 1
            if len(open_) >= 10:
                least = min(f for f, _ in open_)
                open_.pop(max(k for k, (f, _) in enumerate(open_) if f == least))
        want.append((b, 100 - free))
        if free > x:
            open_.append((free - x, b))
    assert list(zip(bins.tolist(), offset.tolist())) == [(int(b), int(o)) for b, o in want]
