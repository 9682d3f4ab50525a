"""Walks by rounds, tests pushed into the walk, and progress while it goes on."""

import os

import pytest
from pyspark.sql import functions as F

from siftstone.operators.inventory import ScanOptions
from siftstone.plans import engine as engine_module
from siftstone.plans.engine import Engine
from siftstone.sources.inventory import read_inventory, walk_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    deep = root / "only"
    for k in range(30):  # one deep folder, with side folders on its way
        deep = deep / f"d{k}"
        (deep / "side").mkdir(parents=True)
        (deep / f"f{k}.jpg").write_bytes(b"x" * k)
    for k in range(40):
        (root / "wide" / f"w{k}").mkdir(parents=True)
        (root / "wide" / f"w{k}" / ".hidden.TXT").write_bytes(b"y" * 100)
    (root / "node_modules" / "in").mkdir(parents=True)
    (root / "node_modules" / "in" / "x.js").write_bytes(b"")
    (root / "café\n.txt").write_bytes(b"z")
    with open(os.fsencode(root) + b"/only/bad\xff.bin", "wb") as f:
        f.write(b"w")
    os.mkdir(os.fsencode(root) + b"/only/bad\xffdir")
    with open(os.fsencode(root) + b"/only/bad\xffdir/in.bin", "wb") as f:
        f.write(b"v")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("budget", [7, 1024])
def test_rounds_give_the_same_rows(spark, tree, budget):
    one = f"{tree}/only/d0/f0.jpg"
    for roots in ([tree], [tree, f"{tree}/wide", one, f"{tree}/none"]):
        got = walk_tree(spark, roots, skip_dev_dirs=True, task_folders=budget)
        assert rows(got) == rows(read_inventory(spark, roots, skip_dev_dirs=True))
    assert rows(walk_tree(spark, [tree], task_folders=budget).where("not is_dir").select("file_name")) == rows(read_inventory(spark, [tree]).where("not is_dir").select("file_name"))
    assert walk_tree(spark, []).count() == 0


def test_one_deep_folder_is_many_tasks_work(spark, tree):
    done = spark.sparkContext.accumulator(0)
    got = walk_tree(spark, [f"{tree}/only"], task_folders=4, done=done)
    tasks = got.select(F.input_file_name().alias("f")).distinct().count()
    assert tasks >= 8 and done.value == got.where("is_dir").count() == 62


def test_followed_links_end(spark, tree):
    os.symlink(tree, f"{tree}/only/d0/loop")
    os.symlink(f"{tree}/wide", f"{tree}/only/link")
    for budget in (5, 1024):
        got = walk_tree(spark, [tree], follow_symlinks=True, task_folders=budget)
        names = {r["file_name"] for r in got.where("not is_dir").collect()}
        assert names == {r["file_name"] for r in read_inventory(spark, [tree]).where("not is_dir").collect()}
    assert walk_tree(spark, [tree]).where("path like '%/loop/%'").count() == 0


def test_tests_are_made_in_the_walk(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        whole = read_inventory(spark, [tree]).collect()
        tests = [
            ("size >= 5 and not is_dir", lambda r: r["size"] >= 5 and not r["is_dir"]), ("file_name like '%.jpg'", lambda r: r["file_name"].endswith(".jpg")),
            ("not (normalized_path like '%/wide/%') and size < 3", lambda r: "/wide/" not in r["normalized_path"] and r["size"] < 3),
            ("file_name in ('f3.jpg', '.hidden.TXT') and error is null", lambda r: r["file_name"] in ("f3.jpg", ".hidden.TXT")), ("error is not null or size = 100", lambda r: r["size"] == 100),
            ("depth > 10 and file_name like 'f%'", lambda r: r["depth"] > 10 and r["file_name"].startswith("f")), ("not (file_name = 'side')", lambda r: r["file_name"] != "side"),
        ]
        for sql, test in tests:
            got = read_inventory(spark, [tree]).where(sql)
            assert sorted(r["path"] for r in got.collect()) == sorted(r["path"] for r in whole if test(r)), sql
        df = read_inventory(spark, [tree]).where("size >= 5 and not (normalized_path like '%/wide/%')")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "GreaterThanOrEqual(size,5)" in plan and "Not(StringContains(normalized_path,/wide/))" in plan and ") Filter" not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_progress_during_the_walk(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / "tree" / f"d{k}").mkdir(parents=True)
    heard = []
    monkeypatch.setattr(engine_module, "walk_tree", lambda *a, **k: walk_tree(*a, **k, task_folders=32))
    result = Engine(spark, str(tmp_path / "data")).run_scan([str(tmp_path / "tree")], options=ScanOptions(), progress=heard.append)
    steps = [p["folders"] for p in heard if p["phase"] == "inventory" and "folders" in p]
    assert len(steps) >= 2 and steps == sorted(set(steps)) and 64 <= steps[-1] <= 301 and result.totals["total_files"] == 0
