"""Near-duplicate videos by perceptual fingerprints.

A fingerprint has 4 orientations of 8 frames of 64 bits (``frames``: array of 4 arrays of 8
longs).  Two videos are similar if in some pair of orientations at least four of the eight
frames differ by at most ``max_distance`` bits; their distance is the least mean over all
eight frames among such pairs.  Clusters are components of this relation, for review only:
nothing of this module goes into a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions import constants as K
from siftstone.functions import scalars as S
from siftstone.operators.graph import components
from siftstone.sources.scratch import cut

#: The farthest hashes that the index serves: at two differing bits of a segment either side
#: flips one.
INDEXED_DISTANCE = 11
#: Frames of a video's orientation that are looked up: of eight frames four have to match, so
#: of any five one does.
PREFIX_FRAMES = K.FRAMES - K.MIN_MATCHES + 1
#: Rows of a block in the comparison of all blocks with all: fingerprints of 32 words, hashes of one.
BLOCK_ROWS = 2048
BLOCK_HASHES = 16384
#: Small tables are dealt to as many blocks, so that their cells are many tasks' work; blocks of fewer rows aren't worth a task.
SPREAD_BLOCKS = 16
LEAST_ROWS = 256
#: Pairs that a task compares at a time.
TILE = 1 << 17


def hash_bits(rows: DataFrame, coefficients: str = "coefficients") -> DataFrame:
    return rows.withColumn("hash", S.phash_bits(coefficients))


def _masks(flips: int) -> list[int]:
    """All 16-bit words with at most ``flips`` bits set."""
    return [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(16), k)]


def thresholds(max_distance: int) -> list[int]:
    """Differing bits allowed in each of four segments.  Were each segment over its own, all
    together would differ in at least ``max_distance + 1`` bits; a segment at -1 isn't needed."""
    rest = max_distance - 3
    return [rest // 4 + (1 if i < rest % 4 else 0) for i in range(4)]


def _segment(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _variants(rows: DataFrame, name: str, flips: list[int], also: str | None) -> DataFrame:
    """(name: the row as a struct, seg, m, key): each needed segment's value with some bits flipped by the mask ``m``."""
    base = F.col(also).cast("long") * (1 << 18) if also else F.lit(0).cast("long")

    def of(i: int, n: int) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in _masks(n)))
        own = base + (i << 16) + _segment(F.col("hash"), i)
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("seg"), m.alias("m"), own.bitwiseXOR(m).alias("key")))

    each = F.concat(*(of(i, n) for i, n in enumerate(flips) if n >= 0))
    return rows.select(F.struct(*rows.columns).alias(name), F.explode(each).alias("v")).select(name, "v.*")


def near_hashes(left: DataFrame, right: DataFrame, max_distance: int, also: str | None = None) -> DataFrame:
    """Pairs (columns of ``left`` as l, of ``right`` as r) of 64-bit hashes at most
    ``max_distance`` (up to 11) bits apart, each once; with equal values of the integer column ``also``, if given.

    Of four 16-bit segments one keeps within its threshold (see :func:`thresholds`).  At two
    bits each side flips one, at one bit the left side does, and variants meet in an
    equi-join.  A pair is kept for the first such segment, and where the left side has
    flipped the lowest differing bit, so none comes twice.
    """
    if not 0 <= max_distance <= INDEXED_DISTANCE:
        raise ValueError(f"the index serves distances up to {INDEXED_DISTANCE}")
    allowed = thresholds(max_distance)
    probes = _variants(left, "l", [t - t // 2 if t >= 0 else t for t in allowed], also)
    index = _variants(right, "r", [t // 2 if t >= 0 else t for t in allowed], also).select("r", "key")
    x = F.col("l.hash").bitwiseXOR(F.col("r.hash"))
    mine, earlier = F.lit(0).cast("long"), F.lit(True)
    for i, t in enumerate(allowed):
        part = _segment(x, i)
        mine = F.when(F.col("seg") == i, part).otherwise(mine)
        if t >= 0:
            earlier = earlier & ((F.col("seg") <= i) | (F.bit_count(part) > t))
    lowest = mine.bitwiseAND(F.negate(mine))
    met = probes.hint("merge").join(index, "key")
    return met.where((F.bit_count(x) <= max_distance) & earlier & (F.col("m") == lowest)).select("l", "r", F.bit_count(x).alias("distance"))


Near = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def near_words(max_distance: int) -> Near:
    """(i, j, distance) of single hashes at most ``max_distance`` apart; words lie in columns."""

    def near(a: np.ndarray, b: np.ndarray):
        off = np.bitwise_count(a[0][:, None] ^ b[0])
        i, j = np.nonzero(off <= max_distance)
        return i, j, off[i, j]

    return near


def near_prints(max_distance: int) -> Near:
    """(i, j, total distance) of similar fingerprints, given as columns of :func:`_flat`."""
    turns, frames = K.ORIENTATIONS, K.FRAMES

    def near(a: np.ndarray, b: np.ndarray):
        (a, whole_a), (b, whole_b) = ((v[: turns * frames].reshape(turns, frames, -1), v[turns * frames :] > 0) for v in (a, b))
        shape = a.shape[2], b.shape[2]
        bits, off, hit = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, bool)
        met = np.zeros(shape, bool)
        each = [(x, y) for x in range(turns) for y in range(turns)]
        for x, y in each:
            matches = np.zeros(shape, np.uint8)
            for f in range(frames):
                np.bitwise_xor(a[x, f][:, None], b[y, f], out=bits)
                np.less_equal(np.bitwise_count(bits, out=off), max_distance, out=hit)
                matches += hit.view(np.uint8)
            met |= (matches >= K.MIN_MATCHES) & whole_a[x][:, None] & whole_b[y]
        i, j = np.nonzero(met)
        best = np.full(len(i), 64 * frames, np.int32)
        for x, y in each:  # distances are summed for similar pairs alone
            off = np.bitwise_count(a[x][:, i] ^ b[y][:, j])
            match = ((off <= max_distance).sum(0) >= K.MIN_MATCHES) & whole_a[x][i] & whole_b[y][j]
            best = np.where(match, np.minimum(best, off.sum(0, dtype=np.int32)), best)
        return i, j, best

    return near


def _flat(frames: str) -> Column:
    """A fingerprint's 32 words, then for each orientation 1 if it has all its frames."""
    word = lambda k: F.get(F.get(frames, F.floor(k / K.FRAMES).cast("int")), k % K.FRAMES)
    words = F.transform(F.array(*map(F.lit, range(K.ORIENTATIONS * K.FRAMES))), lambda k: F.coalesce(word(k), F.lit(0).cast("long")))
    whole = lambda o: F.size(F.filter(F.get(frames, o), lambda h: h.isNotNull())) == K.FRAMES
    return F.concat(words, F.transform(F.array(*map(F.lit, range(K.ORIENTATIONS))), lambda o: F.when(whole(o), 1).otherwise(0).cast("long")))


def _tiles(near: Near, left: np.ndarray, right: np.ndarray, same: bool, tile: int):
    """``near`` of two blocks, some rows of the left one at a time; each pair once if the blocks are the same."""
    rows = max(1, tile // max(1, right.shape[1]))
    for start in range(0, left.shape[1], rows):
        first = start if same else 0
        i, j, distance = near(np.ascontiguousarray(left[:, start : start + rows]), right[:, first:])
        if same:
            once = i < j
            i, j, distance = i[once], j[once], distance[once]
        yield i + start, j + first, distance


def _opened(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray, bool]:
    """A cell's rows, where those of its two blocks lie, the blocks' words in columns, and whether it is one block."""
    cell = pa.Table.from_batches(batches).combine_chunks()
    own, row, column = (cell[c].to_numpy() for c in ("own", "row", "column"))
    words = cell["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(own), -1)
    at = [np.flatnonzero(own == row), np.flatnonzero(own == column)]
    left, right = (np.ascontiguousarray(words[x].T) for x in at)
    return cell, at, left, right, bool(row[0] == column[0])


def _compared(near: Near, tile: int):
    """The pairs of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at, left, right, same = _opened(batches)
        key = cell["key"].combine_chunks()
        for i, j, distance in _tiles(near, left, right, same, tile):
            if len(i):
                yield pa.RecordBatch.from_arrays([key.take(pa.array(at[0][i])), key.take(pa.array(at[1][j])), pa.array(distance.astype(np.int32))], ["a", "b", "distance"])

    return run


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each node's root, the least of its component) after the links i - j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _summed(near: Near, tile: int):
    """A cell's pairs as sums of their left rows, and as a forest that links the same rows: a row for each row at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at, left, right, same = _opened(batches)
        key, copies = cell["key"].to_numpy(), cell["copies"].to_numpy()
        root, n, total = np.arange(len(key)), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for i, j, distance in _tiles(near, left, right, same, tile):
            i, j = at[0][i], at[1][j]
            pairs = copies[i] * copies[j]
            np.add.at(n, i, pairs)
            np.add.at(total, i, pairs * distance)
            root = joined(root, i, j)
        kept = np.flatnonzero((n > 0) | (root != np.arange(len(root))))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[kept], key[root[kept]], n[kept], total[kept])], ["node", "root", "n", "total"])

    return run


def _cells(rows: DataFrame, block_rows: int) -> GroupedData:
    """``rows`` (key, words: as many longs in every row, and what else is needed) dealt to cells of two blocks.

    Each row goes once to each pair of blocks that its own is in, and such a cell is one task's work: two blocks
    of bounded size, compared in bounded tiles.  No side is broadcast.  For thresholds that no index can serve:
    pairs are quadratic, so only their cost is kept low.
    """
    rows = cut(rows.where("key is not null"), "blocks")  # the count reads it too
    count = rows.count()
    n = max(1, -(-count // block_rows), min(SPREAD_BLOCKS, -(-count // LEAST_ROWS)))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = dealt.withColumn("row", F.least("own", "other")).withColumn("column", F.greatest("own", "other")).drop("other")
    return cells.repartition(n * (n + 1) // 2, "row", "column").groupBy("row", "column")


def in_blocks(rows: DataFrame, key: str, words: Column, near: Near, block_rows: int) -> DataFrame:
    """(a, b, distance), a < b: the pairs of ``rows`` that ``near`` finds among all unordered pairs (see :func:`_cells`)."""
    of = rows.schema[key].dataType
    kind = T.StructType([T.StructField("a", of), T.StructField("b", of), T.StructField("distance", T.IntegerType())])
    met = _cells(rows.select(F.col(key).alias("key"), words.alias("words")), block_rows).applyInArrow(_compared(near, TILE), kind)
    return met.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def hamming_pairs(rows: DataFrame, max_distance: int, key: str = "id") -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b, for hashes at most ``max_distance`` apart."""
    if max_distance <= INDEXED_DISTANCE:
        met = near_hashes(rows.select(key, "hash"), rows.select(key, "hash"), max_distance).where(F.col(f"l.{key}") < F.col(f"r.{key}"))
        met = met.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), "distance")
    else:
        met = in_blocks(rows.where("hash is not null"), key, F.array("hash"), near_words(max_distance), BLOCK_HASHES)
    return met.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("distance").cast("int").alias("distance"))


def _pair_distance(a: str, b: str, max_distance: int) -> Column:
    """Least total distance over orientation pairs with enough matching frames, or null."""
    match = 1 << 16  # a matching frame counts beside its bits

    def of(k: Column) -> Column:
        bits = F.zip_with(F.get(a, F.floor(k / K.ORIENTATIONS).cast("int")), F.get(b, k % K.ORIENTATIONS), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda s, v: s + v + F.when(v <= max_distance, match).otherwise(0))

    sums = F.transform(F.array(*map(F.lit, range(K.ORIENTATIONS**2))), of)
    return F.array_min(F.transform(F.filter(sums, lambda s: s >= K.MIN_MATCHES * match), lambda s: s % match))


def _prefixes(frames: DataFrame) -> DataFrame:
    """Of (id, orient, frame, hash) the five frames of each orientation that are rarest: those
    whose segments fewest videos have at that frame, so that frames which all films share, as black ones, aren't looked up."""
    segments = F.array(*(_segment(F.col("hash"), i) for i in range(4)))
    long = frames.select("id", "orient", "frame", "hash", F.posexplode(segments).alias("seg", "value"))
    count = long.groupBy("frame", "seg", "value").agg(F.count(F.lit(1)).alias("n"))
    usual = long.join(count, ["frame", "seg", "value"]).groupBy("id", "orient").agg(F.collect_list(F.struct("frame", "hash", "n")).alias("all"))
    each = usual.select("id", "orient", F.explode("all").alias("x")).groupBy("id", "orient", "x.frame", "x.hash").agg(F.sum("x.n").alias("n"))
    turn = F.row_number().over(Window.partitionBy("id", "orient").orderBy("n", "frame"))
    return each.withColumn("turn", turn).where(F.col("turn") <= PREFIX_FRAMES).select("id", "frame", "hash").distinct()


def _met_videos(classes: DataFrame, max_distance: int) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of videos with a near frame among the rarest five of an orientation."""
    frames = cut(classes.select("id", F.posexplode("frames").alias("orient", "f")).select("id", "orient", F.posexplode("f").alias("frame", "hash")), "video-hashes")
    near = near_hashes(_prefixes(frames), frames.select("id", "frame", "hash").distinct(), max_distance, "frame")
    return near.where(F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b")).distinct()


def _classes(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (id, d1, d2, frames, n: paths), and their members (id, path)."""
    digests = [F.xxhash64("frames").alias("d1"), F.xxhash64(F.lit(1), "frames").alias("d2")]
    rows = cut(fingerprints.where("frames is not null").select("path", "frames", *digests).dropDuplicates(["path", "d1", "d2"]), "video-prints")
    named = rows.groupBy("d1", "d2").agg(F.first("frames").alias("frames"), F.count(F.lit(1)).alias("n"))
    named = cut(named.withColumn("id", F.monotonically_increasing_id()), "video-classes")  # ids are fixed once written
    return named, rows.select("path", "d1", "d2").join(named.select("d1", "d2", "id"), ["d1", "d2"]).select("id", "path")


def _indexed(classes: DataFrame, max_distance: int) -> DataFrame:
    """(id_a, id_b, total) of similar classes that the index finds."""
    a = classes.select(F.col("id").alias("id_a"), F.col("frames").alias("fa"))
    b = classes.select(F.col("id").alias("id_b"), F.col("frames").alias("fb"))
    met = _met_videos(classes, max_distance).join(a, "id_a").join(b, "id_b")
    return met.select("id_a", "id_b", _pair_distance("fa", "fb", max_distance).alias("total")).where("total is not null")


def video_edges(fingerprints: DataFrame, max_distance: int = K.MAX_DISTANCE) -> DataFrame:
    """(path_a, path_b, total_distance, avg_distance), path_a < path_b.

    Videos of equal fingerprints are one node, and their links are written out at the end.
    Up to the index's distance, the default among them, only nodes that share a near frame of
    the same number are compared: a similar pair has four of eight, so looking up the five rarest of one side finds it.
    Frames are fetched for distinct pairs alone.  Beyond that distance, where half of all unlike frames would
    meet, all blocks are compared with all.
    """
    named, members = _classes(fingerprints)
    if max_distance <= INDEXED_DISTANCE:
        near = _indexed(named.select("id", "frames"), max_distance)
    else:
        met = in_blocks(named, "id", _flat("frames"), near_prints(max_distance), BLOCK_ROWS)
        near = met.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("distance").alias("total"))
    alike = named.where("n > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("total"))
    near = cut(near.unionByName(alike), "video-near")
    both = near.join(members.select(F.col("id").alias("id_a"), F.col("path").alias("p")), "id_a").join(members.select(F.col("id").alias("id_b"), F.col("path").alias("q")), "id_b")
    both = both.where((F.col("id_a") != F.col("id_b")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b"), F.col("total").cast("long").alias("total_distance"), (F.col("total") / K.FRAMES).alias("avg_distance"))


def video_clusters(fingerprints: DataFrame, max_distance: int = K.MAX_DISTANCE) -> DataFrame:
    """``clusters(video_edges(fingerprints, max_distance))`` without a row for each edge.

    Classes of equal fingerprints stay one node, whose number of paths is the weight of its pairs.  Beyond
    the index's distance a cell of two blocks hands on the sums of its rows and a forest that links what its pairs link.
    """
    named, members = _classes(fingerprints)
    if max_distance <= INDEXED_DISTANCE:
        near = _indexed(named.select("id", "frames"), max_distance)
        a, b = (named.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        pairs = F.col("n_a") * F.col("n_b")
        sums = near.join(a, "id_a").join(b, "id_b").select(F.col("id_a").alias("node"), F.col("id_b").alias("root"), pairs.alias("n"), (pairs * F.col("total")).alias("total"))
    else:
        cells = _cells(named.select(F.col("id").alias("key"), _flat("frames").alias("words"), F.col("n").alias("copies")), BLOCK_ROWS)
        sums = cells.applyInArrow(_summed(near_prints(max_distance), TILE), "node long, root long, n long, total long")
    sums = cut(sums, "video-sums")
    members = cut(members, "video-members")
    # A path that is listed with several fingerprints links their classes.
    twice = members.groupBy("path").agg(F.min("id").alias("u"), F.collect_set("id").alias("all")).where(F.size("all") > 1).select("u", F.explode("all").alias("v"))
    found = components(sums.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(twice)).withColumnRenamed("node", "id")
    classes = cut(named.select("id", "n").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("alike")), "video-roots")
    per = sums.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    edges = F.sum(F.col("alike") + F.coalesce("n", F.lit(0)))
    inside = classes.join(per, "id", "left").groupBy("root").agg(edges.alias("n_edges"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total_distance"))
    paths = members.join(classes, "id").select("root", "path").distinct().groupBy("root").agg(F.min("path").alias("cluster"), F.count(F.lit(1)).alias("size"))
    mean = (F.col("total_distance") / K.FRAMES / F.col("n_edges")).alias("avg_distance")
    return paths.where("size > 1").join(inside, "root").select("cluster", "size", "n_edges", "total_distance", mean).orderBy(F.desc("size"), "avg_distance", "cluster")


def clusters(edges: DataFrame) -> DataFrame:
    """(cluster, size, n_edges, total_distance, avg_distance) of each component of two or
    more; named by its first path.  The mean is over qualifying pairs alone."""
    names = _named(edges)
    size = names.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    per = edges.join(names.select(F.col("path").alias("path_a"), "cluster"), "path_a").groupBy("cluster")
    sums = per.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("total_distance").alias("total_distance"), F.avg("avg_distance").alias("avg_distance"))
    return size.join(sums, "cluster").orderBy(F.desc("size"), "avg_distance", "cluster")


def members(edges: DataFrame) -> DataFrame:
    """(cluster, path, file_name) of every clustered video."""
    return _named(edges).select("cluster", "path", S.file_name("path").alias("file_name"))


def _named(edges: DataFrame) -> DataFrame:
    found = components(edges.select(F.col("path_a").alias("u"), F.col("path_b").alias("v")))
    least = found.groupBy("root").agg(F.min("node").alias("cluster"))
    return found.join(least, "root").select(F.col("node").alias("path"), "cluster")


def similar_totals(candidates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One row: videos considered, fingerprinted and failed."""
    done = fingerprints.select("path").distinct().withColumn("done", F.lit(True))
    joined = candidates.select("path").join(done, "path", "left")
    return joined.agg(F.count(F.lit(1)).alias("considered"), F.count("done").alias("fingerprinted"), F.count_if(F.col("done").isNull()).alias("failed"))
