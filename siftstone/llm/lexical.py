"""Ranked lexical search over inverted treaps.

A task holds its documents' postings as one treap for each term: a search tree by document,
a heap by impact (what the term adds to the document's score).  A query walks the treaps of all its terms at once.
Its state is an interval of documents with, for each term, the root of the smallest subtree that covers the interval's postings:
those roots' impacts are the largest in the interval, and their sum bounds every score there.  The best intervals are
taken first.  The document of the largest impact is scored and splits its interval in two, and
an interval whose bound can't enter the ten best is dropped with all its subtrees.  Ties of impact are broken by a hash,
so copies of one document don't make a chain.  A short interval is scored document by document.

Documents are dealt to tasks, each task answers every query, and only its best leave it.
The queries come in blocks of bounded size: a block's terms and weights are all that tasks are sent, and a block is one pass.
All numbers but a term's weight are integers, so results don't depend on how documents are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, table
from siftstone.sources.scratch import cut

TOP = 10
#: Percent of a document's length in the saturation of a term.
LENGTH_PERCENT = 75
#: Bytes of query text in a block, about.
BLOCK_BYTES = 4 << 20
#: Postings that one set of treaps holds (a document more, at most).
TREAP_POSTINGS = 1 << 21
#: Intervals of no more documents are scored document by document.
LEAF = 16
#: Intervals split at once, at least.
WIDTH = 64
_UPPER, _LOWER = range(65, 91), range(97, 123)
#: Letters lower-cased; ASCII that is neither letter nor digit becomes a space.
_TABLE = bytes(b + 32 if b in _UPPER else b if b >= 128 or b in _LOWER or 48 <= b <= 57 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _firsts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


@dataclass
class Treaps:
    """Nodes of all terms; ``left`` and ``right`` are -1 where there is none.  ``of`` and
    ``worth`` list each document's own terms and impacts, from ``first``, ``size`` of them."""

    doc: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray  # by term
    first: np.ndarray
    size: np.ndarray
    of: np.ndarray
    worth: np.ndarray


def _greater(key: np.ndarray, nodes: np.ndarray, step: int) -> np.ndarray:
    """The nearest place with a larger key before (-1) or after (1) each node: pointers jump over
    what is smaller, so their number of rounds grows with the logarithm of the nodes."""
    to = np.arange(len(key)) + step
    left = nodes[key[to[nodes]] < key[nodes]]
    while len(left):
        to[left] = to[to[left]]
        left = left[key[to[left]] < key[left]]
    return to


def build(n_terms: int, size: np.ndarray, of: np.ndarray, worth: np.ndarray) -> Treaps:
    """Treaps of documents, in order, from their lists of terms and positive impacts."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(of, kind="stable")  # by term, then by document
    term, doc, impact = of[order], owner[order], worth[order]
    # A wall before each term, and one behind the last.
    place = np.arange(len(term)) + term + 1
    length = len(term) + n_terms + 1
    key = np.full(length, np.iinfo(np.int64).max)
    rank = np.empty(len(term), dtype=np.int64)
    chance = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    rank[np.lexsort((chance, impact))] = np.arange(len(term))
    key[place] = rank
    wall = np.ones(length, dtype=bool)
    wall[place] = False
    before, after = _greater(key, place, -1)[place], _greater(key, place, 1)[place]
    left, right, root = np.full(length, -1), np.full(length, -1), np.full(n_terms, -1)
    top = wall[before] & wall[after]
    under = ~top & (key[before] < key[after])
    right[before[under]] = place[under]
    under = ~top & ~(key[before] < key[after])
    left[after[under]] = place[under]
    root[term[top]] = place[top]
    lain = lambda v: np.put_along_axis(out := np.full(length, -1), place, v, 0) or out
    return Treaps(lain(doc), lain(term), lain(impact), left, right, root, _firsts(size), size, of, worth)


def _cover(t: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """From each node down to the first one whose document is between ``low`` and ``high``, or -1."""
    node = node.copy()
    left = np.flatnonzero(node >= 0)
    while len(left):
        at = node[left]
        doc = t.doc[at]
        small, large = doc < low[left], doc > high[left]
        node[left] = np.where(small, t.right[at], np.where(large, t.left[at], at))
        left = left[(small | large) & (node[left] >= 0)]
    return node


class Best:
    """The best (score, id) so far, at most ``k``; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + [(-int(s), i is None, i) for s, i in zip(scores, ids, strict=True)]
        self.rows = sorted(rows, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[: self.k]

    def bar(self, ids: np.ndarray) -> tuple[int, int]:
        """(score, place): what is at most the score is out, unless it equals it and lies before the place in ``ids``."""
        if len(self.rows) < self.k:
            return 0, 0
        score, none, last = self.rows[-1]
        return -score, len(ids) if none else int(np.searchsorted(ids, last))


def _scores(t: Treaps, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
    size = t.size[docs]
    at = spread(t.first[docs], size)
    sums = np.concatenate([[0], np.cumsum(times[t.of[at]] * t.worth[at])])
    ends = np.cumsum(size)
    return sums[ends] - sums[ends - size]


def search(t: Treaps, ids: np.ndarray, n_docs: int, query: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Puts the best documents for a query into ``best``; returns how many were scored.

    ``query`` has the query's terms, ``times`` how often each of all terms stands in it;
    ``ids`` are the documents' ids that aren't null, which come first, in order."""
    node = t.root[query]
    node = node[node >= 0]
    if not len(node):
        return 0
    low, high, size = np.array([0]), np.array([n_docs - 1]), np.array([len(node)])
    bound = np.array([(t.impact[node] * times[t.term[node]]).sum()])
    scored = 0
    while len(low):
        score, place = best.bar(ids)
        stays = (bound > score) | ((bound == score) & (low < place) & (score > 0))
        if not stays.all():
            node = node[np.repeat(stays, size)]
            low, high, size, bound = low[stays], high[stays], size[stays], bound[stays]
        if not len(low):
            break
        width = max(WIDTH, len(low) // 4)
        now = np.zeros(len(low), dtype=bool)
        now[np.argpartition(-bound, width)[:width] if len(low) > width else slice(None)] = True
        mine = np.repeat(now, size)
        a, b, n, f = low[now], high[now], size[now], node[mine]
        low, high, size, bound, node = low[~now], high[~now], size[~now], bound[~now], node[~mine]
        # Short intervals whole, and of long ones the document of the largest impact.
        short = b - a < LEAF
        worth = t.impact[f] * times[t.term[f]]
        owner = np.repeat(np.arange(len(n)), n)
        largest = np.flatnonzero(worth == np.maximum.reduceat(worth, _firsts(n))[owner])
        pivot = t.doc[f[largest[np.r_[True, owner[largest][1:] != owner[largest][:-1]]]]]
        docs = np.concatenate([pivot[~short], spread(a[short], (b - a + 1)[short])])
        got = _scores(t, docs, times)
        scored += len(docs)
        fits = np.flatnonzero((got > score) | ((got == score) & (docs < place) & (score > 0)))
        if len(fits) > best.k:
            fits = fits[np.lexsort((docs[fits], -got[fits]))[: best.k]]
        best.add(got[fits], [ids[d].item() if d < len(ids) and hasattr(ids[d], "item") else ids[d] if d < len(ids) else None for d in docs[fits]])
        if short.all():
            continue
        keep = np.repeat(~short, n)
        f, n, a, b, p = f[keep], n[~short], a[~short], b[~short], pivot[~short]
        owner = np.repeat(np.arange(len(n)), n)
        sides = []
        for lo, hi, child, outside in ((a, p - 1, t.left, t.doc[f] >= p[owner]), (p + 1, b, t.right, t.doc[f] <= p[owner])):
            at = _cover(t, np.where(outside, child[f], f), lo[owner], hi[owner])
            there = at >= 0
            count = np.bincount(owner[there], minlength=len(n))
            some = count > 0
            sides.append((lo[some], hi[some], count[some], at[there]))
        new = [np.concatenate(x) for x in zip(*sides, strict=True)]
        if len(new[2]):
            worth = t.impact[new[3]] * times[t.term[new[3]]]
            limit = np.add.reduceat(worth, _firsts(new[2]))
            low, high, size, node = (np.concatenate(x) for x in zip((low, high, size, node), new, strict=True))
            bound = np.concatenate([bound, limit])
    return scored


def _facts(vocabulary: dict[bytes, int], id_type: pa.DataType):
    """Of each document with a term: its id, its length, and its terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, size, ids, tfs = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                held = terms(text)
                if held:
                    found = [(vocabulary[t], c) for t, c in Counter(held).items() if t in vocabulary]
                    keep.append(k)
                    n.append(len(held))
                    size.append(len(found))
                    ids.extend(i for i, _ in found)
                    tfs.extend(c for _, c in found)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(v, pa.int32())) for v in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _answers(queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, id_type: pa.DataType):
    def chunk(held: list[pa.RecordBatch], best: list[Best]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        order = pa.compute.sort_indices(rows.column(0), null_placement="at_end")
        rows = rows.take(order)
        n = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        of, tf = _flat(rows.column(2)), _flat(rows.column(3))
        size = rows.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), size)
        m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // n_terms
        worth = weights[of] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
        some = worth > 0
        treaps = build(len(weights), np.bincount(owner[some], minlength=len(n)), of[some], worth[some])
        known = rows.column(0).drop_null().to_numpy(zero_copy_only=False)
        times = np.zeros(len(weights), dtype=np.int64)
        for query, top in zip(queries, best, strict=True):
            q = np.fromiter(query, dtype=np.int64, count=len(query))
            times[q] = list(query.values())
            search(treaps, known, len(n), q, times, top)
            times[q] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        best, held, postings = [Best(k) for _ in queries], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= TREAP_POSTINGS:
                chunk(held, best)
                held, postings = [], 0
        if held:
            chunk(held, best)
        rows = [(q, i, -s) for q, b in enumerate(best) for s, _, i in b.rows]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return run


def _best_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[object, str]], item_type: str, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    counted = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))} if counted else {}
    kind = docs.schema["doc_id"].dataType
    name, id_type = kind.simpleString(), to_arrow_type(kind)
    with arrow_batches(spark):
        found = docs.select("doc_id", "text").mapInArrow(_facts(vocabulary, id_type), f"doc_id {name}, n long, terms array<int>, tfs array<int>")
        facts = cut(found, "search-facts")
    n_docs, n_terms = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    for r in facts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # the block's terms
        weights[r["t"]] = weight(n_docs, r["df"])
    queries = [{vocabulary[t]: c for t, c in q.items()} for q in counted]
    with arrow_batches(spark):
        answers = facts.mapInArrow(_answers(queries, weights, n_docs, n_terms, k, id_type), f"query int, doc_id {name}, score long")
        answers = cut(answers, "search-answers")
    # Each task sent its best; they are brought together in two steps, so that no task gets all of a query's.
    some = _best_of(answers.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))), ["query", "salt"], k).drop("salt")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"query int, item_id {item_type}")
    return _best_of(some, ["query"], k).join(names, "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of the highest scores above 0.

    Every row of ``docs`` is a document, also where ids repeat; equal scores are ranked by
    doc_id, null ids last.  Null and empty texts have no terms and are no documents; texts of any length are
    read whole.  Rows of ``items`` that repeat an id are one item with all their terms; rows without an id,
    and items without a term that a document has, have no results.  Empty tables give no rows.  doc_id may be of
    any type that has an order.  Only doc_id and text, and item_id and text, are read.
    """
    whole = items.where("item_id is not null").groupBy("item_id").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), " ").alias("text"))
    whole = cut(whole.select("item_id", "text"), "search-items")
    size = whole.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // block_bytes)), None
    for b in range(blocks):
        mine = whole.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        if mine or blocks == 1:
            got = _block(docs, [(r["item_id"], r["text"]) for r in mine], items.schema["item_id"].dataType.simpleString(), k)
            out = got if out is None else out.unionByName(got)
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), docs as (
  select k, doc_id, w, cast(len(w) as bigint) as n from d where len(w) > 0
), totals as (
  select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from docs
), q as (
  select item_id, t, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from benchmark where item_id is not null
  ) group by item_id, t
), postings as (
  select k, doc_id, n, t, count(*) as tf from (select k, doc_id, n, unnest(w) as t from docs) where t in (select t from q) group by k, doc_id, n, t
), weights as (
  select t, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from postings, totals group by t, n_docs
), scored as (
  select item_id, k, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms))))) as score
  from q join postings using (t) join weights using (t), totals group by item_id, k, doc_id
), best as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from best where rank <= 10
"""
