"""Decontamination, the filter audit and lexical search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import decontaminate, filter_audit, lexical

DOCS = "doc_id long, text string, source string, n long, words string, h string"
ITEMS = "item_id long, text string, w string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents():
    """Texts over few words, with planted passages, copies, nulls, repeats and one long text."""
    rng = random.Random(7)
    voc = ["the", "of", "a", "Über", "naïve", "x1", "data", "Spark", "join", "tree", "日本", "ß", "end", "zz"]
    text = lambda n: " ".join(rng.choice(voc) + rng.choice(["", "", ".", ", "]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(30)]
    items += [(3, "added to item three " + text(9)), (100, ""), (101, None), (None, text(12)), (102, items[5][1]), (103, "..."), (104, "unseen words only here " * 4)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    docs += [(200 + i, text(8) + " " + items[i][1].upper() + " " + text(8)) for i in range(30)]
    docs += [(300, items[7][1]), (301, items[7][1]), (301, items[7][1]), (302, None), (303, ""), (304, " \n."), (None, items[6][1]), (None, None), (305, text(60_000) + " " + items[20][1])]
    docs += [(400 + i, docs[3][1]) for i in range(25)]
    return docs, items


def frames(spark, docs, items):
    rows = [(d, t, random.Random(str(d)).choice(["a", "b", None]), 1, "w", "h") for d, t in docs]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS)


def key(row):
    return tuple((x is None, x) if not isinstance(x, list) else tuple(x) for x in row)


def leaks(docs, items, window=10):
    spans = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if i is not None and w:
            m = min(window, len(w))
            for k in range(len(w) - m + 1):
                spans.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    sizes = {len(s) for s in spans}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, names = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if found := spans.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    names |= found
        out.append((d, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("window", [10, 4])
def test_leaks_against_plain_search(spark, window):
    docs, items = documents()
    d, b = frames(spark, docs, items)
    got = [tuple(r) for r in decontaminate.contamination(d, b, window).collect()]
    want = leaks(docs, items, window)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] > 0 for r in want) > 30


def test_clean_rows_and_spans(spark):
    docs, items = documents()
    items = [(i, t) for i, t in items if len(WORD.findall(t or "")) >= 5]
    d, b = frames(spark, docs, items)
    clean = decontaminate.decontaminated(d, b)
    want = [x for x, r in zip(docs, leaks(docs, items), strict=True) if not r[2]]
    assert clean.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=key) == sorted(want, key=key)
    assert 0 < len(want) < len(docs)
    for r in decontaminate.spans(d.where("doc_id = 207"), b).collect():
        words = WORD.findall(low(dict(docs)[207]))
        assert tuple(words[r["start"] : r["start"] + r["size"]]) in {tuple(WORD.findall(low(t))[k : k + r["size"]]) for i, t in items if i == r["item_id"] for k in range(200)}


def test_no_documents_or_items(spark):
    docs, items = documents()
    d, b = frames(spark, docs, items)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}
    assert lexical.ranked(d.limit(0), b).count() == 0
    assert lexical.ranked(d, b.limit(0)).count() == 0
    assert filter_audit.audit(d.limit(0).selectExpr("source as part", "true as A"), ["A"], []).count() == 0


def test_bitmap_holds_what_it_was_given(spark):
    h = spark.range(1000).selectExpr("xxhash64(id) as h")
    test = decontaminate.bitmap(h)
    assert h.where(test(F.col("h"))).count() == 1000
    assert spark.range(1000, 21000).selectExpr("xxhash64(id) as h").where(test(F.col("h"))).count() < 200


# --- filter audit ------------------------------------------------------------------------------


def replay(rows, filters, labels):
    """(part, fails, labels) rows, filtered in every order."""
    out = {}
    removed = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before, left = left, [r for r in left if f not in r[1]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                fails = sum(f in r[1] for r in mine)
                lost = tuple(sum(x in r[2] for r in gone) for x in labels)
                out[part, "".join(order), step] = (f, len(left), len(before) - len(left), fails - len(gone), sum(r[1] == {f} for r in mine), *lost)
    return {k: (*v[1:], removed[k[0], v[0]]) for k, v in out.items()}


@pytest.mark.parametrize("filters", ["A", "ABC", "ABCD"])
def test_audit_against_replay(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice(["x", "y", ""] + ["z"] * 9), {f for f in filters if rng.random() < 0.3}, {x for x in ("good", "toxic") if rng.random() < 0.4}) for _ in range(700)]
    schema = "part string, " + ", ".join(f"{c} boolean" for c in [*filters, "good", "toxic"])
    given = [(p or rng.choice(["", None]), *(c in f or (False if rng.random() < 0.5 else None) for c in filters), "good" in x, "toxic" in x) for p, f, x in rows]
    got = filter_audit.audit(spark.createDataFrame(given, schema).repartition(3), list(filters), ["good", "toxic"]).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == replay(rows, filters, ["good", "toxic"])


def test_bitsets_of_many_parts():
    rng = np.random.default_rng(3)
    part, flags = rng.integers(0, 300, 5000).astype(str).astype(object), rng.integers(0, 64, 5000)
    parts, n = filter_audit.subset_counts(part, flags, 5, 1)
    for i in (0, 7, len(parts) - 1):
        mine = flags[part == parts[i]]
        for s in range(32):
            assert n[i, s, 0] == ((mine & s) == 0).sum() and n[i, s, 1] == ((mine & s == 0) & (mine >> 5 == 1)).sum()


def test_flags_of_odd_texts(spark):
    long = "word " * 300_000
    docs = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (5, "A B c $"), (None, "alone"), (None, "alone"), (6, " ".join(map(str, range(60))))]
    d, _ = frames(spark, docs, [])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (5, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter((r["doc_id"], "".join(c for c in "ABCDE" if r[c]), bool(r["good"]), bool(r["toxic"])) for r in filter_audit.text_flags(d, labels).collect())
    assert got == Counter({
        (1, "A", False, False): 1, (2, "AE", False, False): 1, (3, "B", True, True): 1, (4, "BE", False, False): 2, (None, "BE", False, False): 1,
        (5, "ACD", False, True): 1, (None, "A", False, False): 2, (6, "", False, False): 1,
    })
    with pytest.raises(ValueError):
        filter_audit.audit(d, list("ABCDEFGHI"), [])


# --- lexical search ----------------------------------------------------------------------------


def plain_scores(docs, items):
    held = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))
    out = []
    for i, q in wanted.items():
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return out


@pytest.mark.parametrize(("postings", "block"), [(1 << 21, 1 << 22), (50, 700)])
def test_search_against_plain_scores(spark, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "TREAP_POSTINGS", postings)
    docs, items = documents()
    d, b = frames(spark, docs, items)
    got = [tuple(r) for r in lexical.ranked(d.repartition(3), b, block_bytes=block).collect()]
    assert sorted(got, key=key) == sorted(plain_scores(docs, items), key=key)


def test_search_of_string_ids(spark):
    docs, items = documents()
    d, b = frames(spark, [x for x in docs if x[0] is not None], items)
    names = {r["item_id"]: set() for r in b.collect()}
    for r in lexical.ranked(d.selectExpr("concat('d', lpad(doc_id, 5, '0')) as doc_id", "text"), b).collect():
        names[r["item_id"]].add((r["rank"], int(r["doc_id"][1:]), r["score"]))
    for i, n, k, s in plain_scores([x for x in docs if x[0] is not None], items):
        assert (n, k, s) in names[i]


@pytest.mark.parametrize("seed", range(12))
def test_treaps(seed):
    """Order, heap and the best of a walk, on many ties, copies and rising impacts."""
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 400)), int(rng.integers(1, 9))
    has = rng.random((n, terms)) < rng.random()
    worth = np.sort(rng.integers(1, [3, 1000][seed % 2], (n, terms)), axis=0) if seed % 3 else rng.integers(1, 9, (n, terms))
    docs, of = np.nonzero(has)
    t = lexical.build(terms, has.sum(1), of, worth[has])
    for k in range(terms):
        stack, seen = [(t.root[k], 0, n, 1 << 60)], []
        while stack:
            x, lo, hi, top = stack.pop()
            if x >= 0:
                assert lo <= t.doc[x] < hi and t.impact[x] <= top and t.term[x] == k and t.impact[x] == worth[t.doc[x], k]
                seen.append(t.doc[x])
                stack += [(t.left[x], lo, t.doc[x], t.impact[x]), (t.right[x], t.doc[x] + 1, hi, t.impact[x])]
        assert sorted(seen) == list(np.flatnonzero(has[:, k]))
    times = rng.integers(1, 4, terms)
    scores = (has * worth * times).sum(1)
    best = lexical.Best(10)
    scored = lexical.search(t, np.arange(n) * 2, n, np.arange(terms), times, best)
    want = sorted((-s, False, 2 * i) for i, s in enumerate(scores) if s > 0)[:10]
    assert best.rows == want and scored <= n


def test_pruning_skips_most_documents():
    rng = np.random.default_rng(1)
    n = 20_000
    has = rng.random((n, 2)) < 0.5
    worth = rng.integers(1, 10**6, (n, 2))
    t = lexical.build(2, has.sum(1), np.nonzero(has)[1], worth[has])
    best = lexical.Best(10)
    assert lexical.search(t, np.arange(n), n, np.arange(2), np.ones(2, dtype=np.int64), best) < n // 10
    copies = lexical.build(1, np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, 5))
    best = lexical.Best(10)
    assert lexical.search(copies, np.arange(n), n, np.arange(1), np.ones(1, dtype=np.int64), best) < 2000
    assert [r[2] for r in best.rows] == list(range(10))


def test_digest_columns(spark):
    docs, items = documents()
    d, b = frames(spark, docs[:90], items)
    none = hashlib.sha256(b"").hexdigest()
    got = decontaminate.contamination(d, b).selectExpr("n_hit", "sha2(array_join(item_ids, ','), 256) as s").collect()
    assert all((r["s"] == none) == (r["n_hit"] == 0) for r in got)
