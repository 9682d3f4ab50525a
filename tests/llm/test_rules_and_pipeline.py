import math
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftstone.llm import quality_rules, queries
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


ODD = [
    None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "l1\nl1\n\nl1 \n \n", "é ü\xa0x #*$%&|<>", "a b c d e f a b c d e g", " ".join(map(str, range(9000))) + " 1 2 3 4 5",
    "\x1c \x85 z", "long" * 50000,
]


def test_counts():
    for t in ODD:
        assert quality_rules.counts(t)[:5] == brute(t), (t or "")[:40]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = quality_rules.op10_rules(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        want = brute(docs[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.BASE) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in out if not r["base_failed"]}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    assert sum(good) / len(good) > 0.98


def brute_kept(rows):
    """Verdicts from plain counts, exact quantiles of bucketed rates, and the same blend."""
    rates, cells, langs, every = {}, {}, {}, []
    for key, m in rows:
        if not m["n_words"]:
            continue
        of = {}
        for r, (c, by) in quality_rules.RATES.items():
            v = m[c] / max(1, m[by])
            k = math.ceil(math.log(v) / math.log(quality_rules.GAMMA)) if v >= quality_rules.LEAST else None
            of[r] = (0.0, quality_rules.LEAST) if k is None else (quality_rules.GAMMA ** (k - 1), quality_rules.GAMMA**k)
        cells.setdefault(key, []).append(of)
        langs.setdefault(key[0], []).append(of)
        every.append(of)
    out = []
    for key, m in rows:
        kept = not (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"])
        if key in cells:
            if key not in rates:
                borrowed, lang = quality_rules.BORROWED, langs[key[0]]
                share = borrowed / (len(lang) + borrowed)
                rates[key] = {}
                for r in quality_rules.RATES:
                    weights = Counter()
                    for group, w in ((cells[key], 1.0), (lang, share), (every, share * borrowed / len(every))):
                        for of in group:
                            weights[of[r]] += w
                    total, upto, q = sum(weights.values()), 0.0, []
                    for v in sorted(weights):
                        upto += weights[v]
                        q += [v] * (sum(round(upto / total, 9) >= t for t in (0.1, 0.5, 0.9)) - len(q))
                    rates[key][r] = (q[0][0] - 2 * (q[1][0] - q[0][0]), q[2][1] + 2 * (q[2][1] - q[1][1]))
            for r, (c, by) in quality_rules.RATES.items():
                low, high = rates[key][r]
                n, chance = max(1, m[by]), 3 * math.sqrt(m[c])
                kept = kept and (m[c] - chance) / n <= high and (m[c] + chance) / n >= low
        out.append(kept)
    return out


def measured(t):
    return dict(zip([c.split()[0] for c in quality_rules.COUNTS.split(", ")], quality_rules.counts(t)))


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000_000)).collect()
    rows = [r for r in docs if r["doc_id"] % 2 or r["lang"] != "fr"] + [r for r in docs[:40]]
    want = brute_kept([((r["lang"], r["source"]), measured(r["text"])) for r in rows])
    out = quality_rules.judge(spark.createDataFrame([(k, r["text"], r["lang"], r["source"], 1) for k, r in enumerate(rows)], DOCS)).collect()
    got = [r["kept"] for r in sorted(out, key=lambda r: r["doc_id"])]
    assert got == want and 0 < sum(got) < len(got)


def many(k, change):
    """A source of 400 texts like each other, some of whose words or lines are changed."""
    words = [f"word{(7 * k + j) % 60:02d}" for j in range(60)]
    return change([f"{w} and {w[::-1]} of these{k} {j}" for j, w in enumerate(words)])


#: Each rate: a text in which it is high.
HIGH = {
    "symbols": lambda lines: "\n".join(x + " ##" for x in lines),
    "upper": lambda lines: "\n".join(x.upper() for x in lines),
    "repeats": lambda lines: "\n".join(lines + [f"{x} again" for x in lines[:5]]),
    "dup_lines": lambda lines: "\nsame\n".join(lines),
    "word_length": lambda lines: "\n".join(x.replace("word", "extraordinarily") for x in lines),
}


@pytest.mark.parametrize("rate", list(HIGH))
def test_each_fence_follows_its_source(spark, rate):
    """A text with much of one thing goes where that is rare, and stays where it is usual."""
    usual = [(k, many(k, "\n".join), "en", "usual", 1) for k in range(400)]
    other = [(1000 + k, many(k, HIGH[rate]), "en", "other", 1) for k in range(400)]
    odd = [(5000, many(401, HIGH[rate]), "en", "usual", 1), (5001, many(401, HIGH[rate]), "en", "other", 1)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(usual + other + odd, DOCS)).collect()}
    assert not out[5000] and out[5001]
    assert sum(out[k] for k in range(400)) > 390 and sum(out[1000 + k] for k in range(400)) > 390
    alone = spark.createDataFrame([(i, t, g, s, n) for i, t, g, s, n in usual + odd[:1]], DOCS)
    limits = {r["source_key"]: r for r in quality_rules.fences(quality_rules.sketch(quality_rules._measured(alone.unionByName(spark.createDataFrame(other, DOCS))))).collect()}
    assert limits["=other"][f"high_{rate}"] > limits["=usual"][f"high_{rate}"]


def test_odd_rows(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "ten words are in this one text so it passes all", None, None, None)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("rate", F.lit(1)).withColumn("row", F.lit(2)).withColumn("m", F.lit(0)).withColumn("a.b", F.lit(3))
    out = quality_rules.judge(df).collect()
    assert len(out) == len(rows) and [r["kept"] for r in out if r["doc_id"] is None] == [True, True]
    kept = quality_rules.rules_stage(spark, df, SF)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in out)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_thresholds_follow_the_source(spark):
    """Symbols are usual in one source and a fault in the other; small cells borrow."""
    plain = "these are some ordinary words of a text without any signs at all number {}"
    code = "if ( a < b ) & c > d then x * y # note number {} | more words here"
    rows = [(i, plain.format(i), "en", "prose", 1) for i in range(300)] + [(1000 + i, code.format(i), "en", "code", 1) for i in range(300)]
    rows += [(5000, code.format(1), "en", "prose", 1), (5001, code.format(2), "en", "code", 1), (5002, plain.format(7), "fr", "tiny", 1)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not out[5000] and out[5001] and out[5002] and all(v for k, v in out.items() if k < 5000)


def test_sketches_merge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = quality_rules.sketch(quality_rules._measured(docs))
    halves = [quality_rules.sketch(quality_rules._measured(docs.where(F.col("doc_id") % 2 == k))) for k in (0, 1)]
    keys = ["lang_key", "source_key", "rate", "bucket"]
    merged = halves[0].unionByName(halves[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.select(*keys, "n").collect())) == sorted(map(tuple, whole.select(*keys, "n").collect()))


def test_pipeline(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.count())
    assert 0 < seen[1] <= seen[0] and seen[2] == seen[1]
    last = docs.collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert {r["doc_id"] for r in last} <= {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeats, a very long text, and columns of any name, through all stages."""
    good = "these are {} quite ordinary words of a text that says something about number {} and then ends here"
    rows = [(k, good.format(k, " and ".join(str(k * j) for j in range(3, 40))), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += rows[:3] + [(None, good.format("no", "id"), None, None, None), (70, None, "en", "s1", 0), (71, "", "en", "s1", 0), (72, "few words", "en", None, 2)]
    rows += [(73, " ".join(f"long{k}" for k in range(60_000)), "fr", "s2", None), (5, good.format("another", "text of the same id"), "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("a.b", "row", "shard", "root", "entity", "place", "lot", "n_words", "n_entities"):
        df = df.withColumn(c, F.lit("user's"))
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert sorted(out.columns) == sorted(df.columns), name
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert docs.where(F.col("`a.b`") != "user's").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in rows} - {70, 71, 72} and len(out) > 40
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
