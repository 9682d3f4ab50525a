import numpy as np

from siftstone.llm import ann
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    for q in queries:
        scored = [(-float(np.dot(np.array(rows[q], float), np.array(v, float))), i) for i, v in rows.items() if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_recall_and_scores_on_the_table(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    out = ann.op2_ann(spark, SF).collect()
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(np.dot(np.array(rows[r["query_id"]], float), np.array(rows[r["vec_id"]], float)))) < 1e-12
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.99, recall


def test_recall_over_many_candidates():
    """One large block: the bound prunes most vectors and still finds the nearest."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 64))
    x *= rng.uniform(0.5, 2, (6000, 1))
    ids = np.arange(6000)
    turn = ann.rotation(64)
    code, norm, cos = ann.encode(x, turn)
    q = x[:40]
    hits, total = 0, 0
    for i, got, score in ann.search_block(ids[:40], q, ids, x, code, norm, cos, 20):
        exact = x @ q[i]
        exact[i] = -np.inf
        want = set(np.argsort(-exact)[:20].tolist())
        hits, total = hits + len(want & set(got.tolist())), total + 20
        assert i not in got and list(score) == sorted(score, reverse=True)
    assert hits / total > 0.99
    # The estimate is unbiased and its bound holds.
    est = (q @ turn.T) @ (np.unpackbits(code, axis=1).astype(float) * 2 - 1).T * (norm / (cos * np.sqrt(256)))
    err = np.abs(est - q @ x.T)
    slack = norm * np.sqrt(1 - cos**2) / cos * (ann.EPSILON / np.sqrt(255)) * np.linalg.norm(q, axis=1)[:, None]
    assert (err <= slack).mean() > 0.995


def test_estimates_from_packed_words_are_those_of_the_signs():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, 40)), rng.standard_normal(40)
    turn = ann.rotation(40)
    code, _, _ = ann.encode(x, turn)
    packed = np.ascontiguousarray(code).view(np.uint64)
    z = turn @ q
    got, step = ann.estimates(z, list(packed.T), np.bitwise_count(packed).sum(1, dtype=np.int32))
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    bits, low, same = ann.planes(z)
    level = sum(np.unpackbits(p.view(np.uint8)).astype(float) * (1 << b) for b, p in enumerate(bits))
    assert same == step and np.abs(low + step * level - z).max() <= step / 2 + 1e-12
    assert np.allclose(got, 2 * (signs > 0) @ (low + step * level) - z.sum())
    assert np.abs(got - signs @ z).std() < 2 * step * np.sqrt(256 / 12)


def test_double_vectors_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 12))
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], 0) for i in range(120)], "vec_id long, embedding array<double>, label int")
    df = df.withColumn("query_id", df["label"]).withColumn("a.b", df["label"])
    out = ann.nearest(df.where("vec_id % 20 = 0"), df, 7).collect()
    assert len(out) == 42
    for r in out:
        exact = x @ x[r["query_id"]]
        exact[r["query_id"]] = -np.inf
        assert r["vec_id"] == np.argsort(-exact)[r["rank"] - 1] and abs(r["score"] - exact[r["vec_id"]]) < 1e-14 * 50


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0),
        (8, [-1.0, 0.5], 0), (9, [1.0, 2.0, 3.0], 0), (20, [0.5, 0.5], None), (None, [1.0, 1.0], 0), (40, [], 0), (60, [9.0, 9.0, 9.0], 1),
    ]
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for r in sorted(ann.nearest(df.where("vec_id % 20 = 0"), df, 20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.5), (8, -1.0)], 20: [(0, 0.5), (1, 0.5), (2, 0.5), (8, -0.25)], 60: [(9, 54.0)]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_blocks_give_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.standard_normal(8)], 0) for i in range(300)], KIND)
    one = sorted(map(tuple, ann.nearest(df.where("vec_id % 20 = 0"), df, 5).collect()))
    monkeypatch.setattr(ann, "BLOCK", 50)
    assert sorted(map(tuple, ann.nearest(df.where("vec_id % 20 = 0"), df, 5).collect())) == one


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    """Rows that repeat an id meet a query in several blocks, and all count."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((900, 16)).astype("float32")
    ids = [7] * 600 + list(range(100, 400))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(rows.where("vec_id in (100, 101, 102)"), rows, 20).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = vectors.astype(float)
    for q in (100, 101, 102):
        v = exact[ids.index(q)]
        want = sorted((-float((x * v).sum()), i) for i, x in zip(ids, exact) if i != q)[:20]
        assert len(got[q]) == 20 and len({(i, round(s, 6)) for i, s in got[q]} & {(i, round(-s, 6)) for s, i in want}) >= 19
