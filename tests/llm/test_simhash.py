import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from siftstone.llm import simhash
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints):
    """Smallest index reachable over links of three bits or fewer."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in ["", None, "  \n", "many words " * 50_000, "One", "one two", "A b C", "ÀB c d\te\x0bf", "x " * 500, "a b c d e f g h i j k"]:
        assert simhash.simhash64(t) == brute(t), t


def family(rng, n, bits):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_links_against_all_pairs(spark, monkeypatch, hot):
    """With a low bound nearly every key goes through hubs; components must not change."""
    monkeypatch.setattr(simhash, "HOT_PAIRS", hot)
    rng = random.Random(hot)
    prints = sorted({p for _ in range(12) for p in family(rng, 6, 3)} | set(family(rng, 60, 2)) | {0, 1, 3, 15, 31} | {rng.getrandbits(64) for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    names = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = closure(prints)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(names.get(s, s), set()).add(i)
    expected = {}
    for i, r in enumerate(want):
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_classes_of_odd_rows(spark):
    text = "the same words in the same order every time for all of these"
    rows = [(5, text, "en", "s", 1), (3, text.upper(), "en", "s", 1), (9, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, text, "en", "s", 1), (1, "quite another text here", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1)).withColumn("root", F.lit(2))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (7, 7), (7, 7), (None, 3), (1, 1)], key=str)
    kept = simhash.dedup_stage(spark, df, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.dedup_stage(spark, df.limit(0), SF).count() == 0
    lonely = spark.createDataFrame([(None, "x y z", "en", "s", 1)], DOCS)
    assert simhash.dedup_stage(spark, lonely, SF).count() == 1


def test_stage_keeps_one_row_of_each_class(spark):
    """Against the classes themselves, where ids repeat with other texts or are null."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    bases = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = [(1, bases[0]), (2, bases[0] + " "), (2, bases[1]), (None, bases[2]), (None, bases[2].upper()), (None, bases[3]), (4, bases[3]), (5, bases[4]), (5, bases[4]), (6, "long " * 100_000), (None, None), (7, "")]
    rows += [(rng.choice([None, *range(10, 16)]), rng.choice(bases[5:])) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    for c in ("digest", "d1", "id", "n", "k", "root", "a.b", "stays"):
        df = df.withColumn(c, F.lit("user's"))
    kept = simhash.dedup_stage(spark, df, SF)
    assert kept.columns == df.columns
    got = kept.collect()
    roots = closure([brute(t) for _, t in rows])
    classes = {}
    for (i, t), r in zip(rows, roots):
        classes.setdefault(r, []).append((i, t))
    assert sorted(roots[r["n_chars"]] for r in got) == sorted(classes)
    for r in got:
        ids = [i for i, _ in classes[roots[r["n_chars"]]] if i is not None]
        assert r["doc_id"] == (min(ids) if ids else None) and r["a.b"] == r["digest"] == "user's"


def test_query_on_whole_table(spark):
    out = simhash.op1_simhash(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [brute(docs[i]) for i in ids]
    want = {i: ids[r] for i, r in zip(ids, closure(prints))}
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in zip(ids, prints)}


def test_rows_with_maps_are_told_apart(spark):
    """Rows that repeat id and text, with a column that has no order."""
    rows = [(1, "some words of a text", {"k": i % 2}, [{"a": 1}]) for i in range(4)] + [(2, "some words of a text", None, None), (3, "quite another one here", {}, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, n array<map<string,int>>")
    first = [r.asDict() for r in simhash.dedup_stage(spark, df, SF).orderBy("doc_id").collect()]
    again = [r.asDict() for r in simhash.dedup_stage(spark, df.repartition(3), SF).orderBy("doc_id").collect()]
    assert [r["doc_id"] for r in first] == [1, 3] and first == again
