"""Operators on small hand-made tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import cache, dedupe, inventory, reports, similar
from siftstone.operators.graph import components
from siftstone.operators.inventory import ScanOptions
from siftstone.plans import catalogue, fixtures
from siftstone.sources import scratch

FILES = "hash string, path string, normalized_path string, file_name string, media_kind string, source_root string, size long, modified_ns long, dev long, ino long"


def files(spark, rows):
    """rows: (hash, path, size, time, ino)"""
    full = [(h, p, p, p.rsplit("/", 1)[-1], "photo", "/r", s, t, 1, i) for h, p, s, t, i in rows]
    return spark.createDataFrame(full, FILES)


def test_no_files(spark):
    none = files(spark, [])
    assert dedupe.group_stats(none).count() == 0 and dedupe.plan(none).count() == 0 and dedupe.duplicate_dirs(none).count() == 0
    assert dedupe.report_totals(none).first()["total_files"] == 0 and dedupe.plan_summary(dedupe.plan(none)).first()["bytes_to_free"] == 0


def test_group_order(spark):
    rows = [("a", f"/a{i}", 100, 0, 0) for i in range(2)] + [("b", f"/b{i}", 50, 0, 0) for i in range(3)] + [("c", f"/c{i}", 300, 0, 0) for i in range(2)] + [("d", "/d", 9, 0, 0)]
    assert [g["hash"] for g in dedupe.ordered(dedupe.group_stats(files(spark, rows))).collect()] == ["c", "a", "b"]


def test_groups_do_not_depend_on_partitions(spark):
    rows = [(f"h{i % 7}", f"/p{i:03d}", 10 + i % 7, i, i) for i in range(100)]
    df = files(spark, rows)
    a = sorted(map(tuple, dedupe.plan(df).collect()))
    assert a == sorted(map(tuple, dedupe.plan(df.repartition(7)).collect())) and len(a) == 100


def test_same_path_twice_is_a_hardlink_or_a_duplicate(spark):
    twice = files(spark, [("h", "/a", 1, 1, 5), ("h", "/a", 1, 1, 5)])
    assert [p["action"] for p in dedupe.plan(twice).collect()] == ["keep", "keep"]
    unknown = files(spark, [("h", "/a", 1, 1, 0), ("h", "/a", 1, 1, 0)])
    assert sorted(p["action"] for p in dedupe.plan(unknown).collect()) == ["keep", "quarantine"]


def test_longest_path_ties_take_the_last(spark):
    df = files(spark, [("h", "/aa", 1, 1, 1), ("h", "/bb", 1, 1, 2)])
    kept = lambda rule: dedupe.plan(df, rule).where("action = 'keep'").first()["path"]
    assert kept("longest_path") == "/bb" and kept("shortest_path") == "/aa" and kept("newest") == "/aa"
    with pytest.raises(ValueError):
        dedupe.plan(df, "none")


def test_rollup(spark):
    rows = [("h", p, 1, 1, 1) for p in ["/r/a"] * 2 + ["/r/s/a"] * 3 + ["/r/s/t/a"] * 5 + ["/r/u/a"]]
    got = {r["path"]: (r["file_count"], r["direct_files"], r["parent"]) for r in inventory.folder_map(files(spark, rows)).collect()}
    assert got == {"/r": (11, 2, None), "/r/s": (8, 3, "/r"), "/r/s/t": (5, 5, "/r/s"), "/r/u": (1, 1, "/r")}
    assert inventory.children(inventory.folder_map(files(spark, rows))).count() == 3


def test_options():
    o = ScanOptions(min_size=-5, exclude=[" a ", "", "  "])
    assert o.min_size == 0 and o.exclude == ["a"]
    i = ScanOptions.interactive(data_root="/data")
    assert i.media_only and i.skip_dev_dirs and not i.follow_symlinks and i.exclude == ["/data"]


def test_error_summary(spark):
    rows = [(f"/p{i:02d}", "broken", i == 0) for i in range(25)]
    lines = [r["line"] for r in inventory.error_summary(spark.createDataFrame(rows, "path string, message string, denied boolean")).collect()]
    assert len(lines) == 22 and lines[20] == "5 further errors not listed" and lines[21] == "25 files failed, 1 without permission"


BANK = "id long, hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long, path_exists boolean"


def test_lookup_precedence(spark):
    bank = spark.createDataFrame(
        [
            (1, "h1", "/a", "/a", "a", "/", 1, 1, True), (2, "p:x", "/b", "/b", "b", "/", 1, 1, True), (3, "hb", "/old/b", "/old/b", "b", "/", 1, 1, False),
            (4, "hc", "/old/c", "/old/c", "c", "/", 1, 1, False), (5, "hd", "/old/d", "/old/d", "d", "/", 1, 1, True), (6, "p:e", "/old/e", "/old/e", "e", "/", 1, 1, False),
        ],
        BANK,
    )
    entries = files(spark, [(None, f"/{n}", 1, 1, 1) for n in "abcdef"]).drop("hash")
    got = {r["file_name"]: (r["hit_kind"], r["hash"], r["moved_from"], r["stale_ignored"]) for r in cache.lookup(entries, bank).collect()}
    assert got == {
        "a": ("primary", "h1", None, False), "b": ("miss", None, None, True), "c": ("filename", "hc", "/old/c", False),
        "d": ("miss", None, None, True), "e": ("miss", None, None, True), "f": ("miss", None, None, False),
    }


def test_relocation_onto_a_known_path_keeps_its_size_and_time(spark):
    kind = "id long, hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long, first_seen_ts string, last_seen_ts string, last_scan_id long"
    bank = spark.createDataFrame([(1, "h", "/old", "/old", "old", "/", 5, 5, "t1", "t1", 1), (2, "x", "/new", "/new", "new", "/", 7, 7, "t2", "t2", 1)], kind)
    moves = spark.createDataFrame([("/old", "/new", "/new", "new", "/")], "moved_from string, path string, normalized_path string, file_name string, source_root string")
    rows = cache.relocate(bank, moves, 9, "t9").collect()
    assert [(r["id"], r["hash"], r["size"], r["first_seen_ts"], r["last_scan_id"]) for r in rows] == [(2, "h", 7, "t2", 9)]


def test_upsert_numbers_new_paths(spark):
    kind = "id long, hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long, first_seen_ts string, last_seen_ts string, last_scan_id long"
    bank = spark.createDataFrame([(7, "h", "/a", "/a", "a", "/", 5, 5, "t1", "t1", 1)], kind)
    seen = files(spark, [("h2", "/a", 6, 6, 1), ("n1", "/b", 1, 1, 1), ("n2", "/c", 1, 1, 1)])
    rows = {r["normalized_path"]: r for r in cache.upsert_files(bank, seen, 2, "t2").collect()}
    assert rows["/a"]["id"] == 7 and rows["/a"]["first_seen_ts"] == "t1" and rows["/a"]["hash"] == "h2" and {rows["/b"]["id"], rows["/c"]["id"]} == {8, 9}


@pytest.mark.parametrize("distance", [0, 3, 10, 16])
def test_hamming_pairs_against_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 30)
    close = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 13), replace=False)) for b in base for _ in range(3)]
    hashes = [int(b) for b in base] + close
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    want = {(i, j, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j}
    want = {w for w in want if w[2] <= distance}
    assert {tuple(r) for r in similar.hamming_pairs(df, distance).collect()} == want


def test_long_chains_are_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    roots = components(edges).groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in roots) == [2, n + 1]


def flipped(x, bits, rng):
    for b in rng.choice(64, bits, replace=False):
        x = int(x) ^ (1 << int(b))
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5, 10, 11])
def test_near_hashes_against_all_pairs(spark, distance):
    """Each pair once, at every distance that the index serves; equal hashes and equal segments among them."""
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 25)]
    held = base + [flipped(base[k % 5] & ((1 << 64) - 1), k % 14, rng) for k in range(120)] + base[:3]
    rows = spark.createDataFrame(list(enumerate(held)), "id long, hash long")
    got = [tuple(r) for r in similar.hamming_pairs(rows, distance).collect()]
    off = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = [(i, j, off(held[i], held[j])) for i in range(len(held)) for j in range(i + 1, len(held)) if off(held[i], held[j]) <= distance]
    assert sorted(got) == want and len(want) > 2


def test_video_edges_with_and_without_index_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, (30, 4, 8))
    base[1] = base[0][[1, 2, 3, 0]] ^ 7  # turned, three bits off
    base[2][:, :4] = base[3][:, :4]
    base[2][:, 4:] = base[4][:, 4:]
    base[5:16] = base[16]  # a family: the same four frames, 0 to 10 bits off, of any number, and four others
    for k in range(11):
        places = rng.choice(8, 4, replace=False)
        for f in range(8):
            for o in range(4):
                base[5 + k, o, f] = flipped(int(base[16, o, f]) & ((1 << 64) - 1), k if f in places else 30, rng)
    base[:, :, 7] = np.where(np.arange(30)[:, None] > 16, 0, base[:, :, 7])  # black frames that many films share
    base[20] = base[21]
    rows = [(f"/v{i:02d}", [[int(x) for x in o] for o in v]) for i, v in enumerate(base)] + [("/none", None)]
    df = spark.createDataFrame(rows, "path string, frames array<array<bigint>>")
    for distance in (7, 10):
        indexed = {(r["path_a"], r["path_b"], r["total_distance"]) for r in similar.video_edges(df, distance).collect()}
        with monkeypatch.context() as m:
            m.setattr(similar, "INDEXED_DISTANCE", -1)
            blocked = {(r["path_a"], r["path_b"], r["total_distance"]) for r in similar.video_edges(df, distance).collect()}
        pairs = {e[:2] for e in indexed}
        assert indexed == blocked and {("/v00", "/v01"), ("/v02", "/v03"), ("/v02", "/v04"), ("/v20", "/v21")} <= pairs
        assert {(f"/v{5 + k:02d}", "/v16") for k in range(distance + 1)} <= pairs and not any("/v17" in p for p in pairs)


def test_videos_of_the_whole_table_beside_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if len(r["embedding"]) == 64}
    videos = fixtures.emb_video(spark, sf)
    held = {r["path"]: np.array(r["frames"], dtype=np.int64).view(np.uint64) for r in videos.collect()}
    assert set(held) == {f"/vault/video/v_{v:04d}.mp4" for v in {i // 8 for i in ids} if all(v * 8 + k in ids for k in range(8))} and len(held) > 62
    paths, want = sorted(held), set()
    for i, a in enumerate(paths):
        rest = np.array([held[b] for b in paths[i + 1 :]], dtype=np.uint64).reshape(-1, 4, 8)
        off = np.bitwise_count(held[a][None, :, None] ^ rest[:, None]).astype(int)
        total = np.where((off <= 26).sum(-1) >= 4, off.sum(-1), 9999).min((1, 2))
        want |= {(a, b, int(t)) for b, t in zip(paths[i + 1 :], total) if t < 9999}
    assert {tuple(r)[:3] for r in similar.video_edges(videos, 26).collect()} == want


def test_blocks_of_few_rows_are_many_tasks(spark):
    """a table of one block was one task's work, all pairs of it."""
    rng = np.random.default_rng(5)
    held = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 2000)]
    rows = spark.createDataFrame([*enumerate(held), (7, held[7]), (None, 1), (5000, None)], "id long, hash long")
    got = similar.hamming_pairs(rows, 22).select("*", F.spark_partition_id().alias("task")).collect()
    words = np.array([*held, held[7]], dtype=np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(words[:, None] ^ words) <= 22)
    ids = [*range(2000), 7]
    want = sorted((ids[a], ids[b], (held[ids[a]] ^ held[ids[b]]) & ((1 << 64) - 1)) for a, b in zip(i, j) if ids[a] < ids[b])
    assert sorted(tuple(r)[:3] for r in got) == [(a, b, x.bit_count()) for a, b, x in want]
    assert len({r["task"] for r in got}) > 8


@pytest.mark.parametrize("tile", [1, 50, 1 << 17])
def test_videos_in_many_small_blocks(spark, monkeypatch, tile):
    """all pairs, also over blocks and tiles of a few rows; a turn that lacks a frame matches nothing."""
    for name, value in (("BLOCK_ROWS", 7), ("TILE", tile)):
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(6)
    held = rng.integers(-(1 << 62), 1 << 62, (40, 4, 8))
    held[30:] = held[:10]  # equal fingerprints
    rows = [(f"/v{i:02d}", [[int(x) for x in o] for o in v]) for i, v in enumerate(held)]
    rows += [("/v01", rows[1][1]), ("/cut", [o[:7] for o in rows[3][1]]), ("/hole", [[None, *o[1:]] for o in rows[4][1]]), ("/none", None)]
    got = [(r["path_a"], r["path_b"], r["total_distance"]) for r in similar.video_edges(spark.createDataFrame(rows, "path string, frames array<array<bigint>>"), 26).collect()]
    words, want = held.view(np.uint64), set()
    for i in range(40):
        off = np.bitwise_count(words[i][None, :, None] ^ words[i + 1 :, None]).astype(int)
        total = np.where((off <= 26).sum(-1) >= 4, off.sum(-1), 9999).min((1, 2))
        want |= {(f"/v{i:02d}", f"/v{i + 1 + k:02d}", int(t)) for k, t in enumerate(total) if t < 9999}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


@pytest.mark.parametrize(("distance", "block"), [(10, 2048), (22, 2048), (22, 5)])
def test_clusters_need_no_row_for_each_edge(spark, monkeypatch, distance, block):
    """clusters came from a table of all edges; now from sums and forests, the same ones."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    held = rng.integers(-(1 << 62), 1 << 62, (50, 4, 8))
    for k in range(1, 12):  # a chain of near ones
        for f in range(5):
            for o in range(4):
                held[k, o, f] = flipped(int(held[k - 1, o, f]) & ((1 << 64) - 1), 9, rng)
    held[20:30] = held[19]  # copies, and copies within the chain
    held[30:33] = held[4]
    rows = [(f"/v{i:02d}", [[int(x) for x in o] for o in v]) for i, v in enumerate(held)]
    rows += [rows[0], ("/v19", rows[3][1]), ("/v40", rows[41][1]), ("/v42", rows[40][1]), ("/none", None)]  # repeated rows, paths with two fingerprints
    df = spark.createDataFrame(rows, "path string, frames array<array<bigint>>")
    want = similar.clusters(similar.video_edges(df, distance)).collect()
    monkeypatch.setattr(similar, "video_edges", None)
    assert similar.video_clusters(df, distance).collect() == want and len(want) > 0 and want[0]["size"] > 20
    assert similar.video_clusters(df.where("false"), distance).collect() == []


@pytest.mark.parametrize("name", ["similar_cluster_means", "similar_clusters"])
def test_cluster_queries_read_no_edges(spark, monkeypatch, name):
    """the registered queries take the sums."""
    monkeypatch.setattr(similar, "video_edges", None)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_joined_takes_links_in_any_order():
    rng = np.random.default_rng(2)
    links = rng.integers(0, 300, (220, 2))
    root = np.arange(300)
    for part in np.array_split(links, 7):
        root = similar.joined(root, *part.T)
    want = np.arange(300)
    while True:
        least = want.copy()
        for a, b in links:
            least[[a, b]] = min(least[a], least[b])
        if (least == want).all():
            break
        want = least
    assert (root == want).all()


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_moves_within_one_hot_hash(spark, monkeypatch, hot):
    """The k-th new file of a hash takes the k-th stale row, also where nearly all files have it."""
    monkeypatch.setattr(scratch.numbered, "__defaults__", (hot,))
    n = 3000
    bank = spark.createDataFrame([(i, "hot", "hot" if i % 50 else f"h{i}", f"/old/{i:05d}", False) for i in range(n)], "id long, x string, hash string, normalized_path string, path_exists boolean")
    new = spark.createDataFrame([("hot" if i % 50 else f"h{i}", f"/new/{(i * 7919) % n:05d}") for i in range(n)], "hash string, normalized_path string")
    got = {(r["normalized_path"], r["moved_from"]) for r in cache.moves_by_hash(new, bank).collect()}
    want = set()
    for h in {"hot" if i % 50 else f"h{i}" for i in range(n)}:
        paths = sorted(f"/new/{(i * 7919) % n:05d}" for i in range(n) if ("hot" if i % 50 else f"h{i}") == h)
        want |= set(zip(paths, [f"/old/{i:05d}" for i in range(n) if ("hot" if i % 50 else f"h{i}") == h]))
    assert got == want


def test_only_folders_with_a_twin_are_listed(spark):
    rows = [(f"h{i}", f"/r/{d}/f{i}", 1, 1, 1) for d in ("a", "b") for i in range(5)] + [(f"h{i}", f"/r/big/f{i}", 1, 1, 1) for i in range(500)] + [("h1", "/r/c/f1", 1, 1, 1)]
    df = files(spark, rows)
    assert {r["dir"] for r in dedupe._twins(dedupe._named(df, None)).collect()} == {"/r/a", "/r/b"}
    assert [r["dirs"] for r in dedupe.duplicate_dirs(df).collect()] == [["/r/a", "/r/b"]]


def test_folders_larger_than_a_list(spark, monkeypatch):
    """Equal huge folders are found by their lists' digests; one name in another place makes another folder."""
    monkeypatch.setattr(dedupe, "CHUNK_NAMES", 16)
    monkeypatch.setattr(scratch.numbered, "__defaults__", (40,))
    rows = [(f"h{i}", f"/r/{d}/f{i:03d}", 1, 1, 1) for d in ("a", "b") for i in range(90)]
    rows += [(f"h{(i + 1) % 90}", f"/r/c/f{i:03d}", 1, 1, 1) for i in range(90)] + [(f"h{i}", f"/r/{d}/f{i:03d}", 1, 1, 1) for d in ("s", "t") for i in range(16)]
    df = files(spark, rows)
    found = {tuple(r["dirs"]): (r["file_count"], r["total_bytes"]) for r in dedupe.duplicate_dirs(df).collect()}
    assert found == {("/r/a", "/r/b"): (90, 90), ("/r/s", "/r/t"): (16, 16)}
    signed = {r["dir"]: r["signature"] for r in dedupe.signatures(df).collect()}
    lists = [hashlib.sha256("".join(f"f{i:03d}\0h{i}\0" for i in range(k, min(90, k + 16))).encode()).hexdigest() for k in range(0, 90, 16)]
    assert signed["/r/a"] == signed["/r/b"] == hashlib.sha256("".join(lists).encode()).hexdigest() != signed["/r/c"]
    assert signed["/r/s"] == hashlib.sha256("".join(f"f{i:03d}\0h{i}\0" for i in range(16)).encode()).hexdigest()


def test_simulated_run(spark):
    plan = spark.createDataFrame(
        [("h", "/k", "/k", 1, "keep", ""), ("h", "/v", "/v", 1, "quarantine", ""), ("h", "/w", "/w", 1, "quarantine", ""), ("h", "/x", "/x", 1, "quarantine", "")],
        "hash string, path string, normalized_path string, size long, action string, reason string",
    )
    disk = spark.createDataFrame([("/k", "h"), ("/v", "h"), ("/w", "other")], "normalized_path string, current_hash string")
    done = reports.simulate_apply(plan, disk)
    assert {r["path"]: r["status"] for r in done.collect()} == {"/v": "moved", "/w": "failed", "/x": "skipped"}
    assert tuple(reports.apply_totals(done, plan).first()) == (1, 2, 1, 0, 1)
