import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import scalars as S
from siftstone.functions.blake3 import Hasher, blake3_hex
from siftstone.functions.phash import dct2d, orientations, phash, resize


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


TABLE = [
    (S.file_name, ["/a/b.jpg", "/a/b/", "", "x", "/a/.."], ["b.jpg", "b", "", "x", ""]),
    (S.parent, ["/a/b.jpg", "/b.jpg", "b.jpg", "/a/b/c"], ["/a", "/", "", "/a/b"]),
    (S.sanitize, ["/a/../b/./c", "a//b/", "/../..", "a/b/../../../c"], ["/b/c", "a/b", "/", "c"]),
    (S.media_kind, ["a.JPG", "b.mov", "c.txt", "jpg", ".jpg", "x.tar.MP4"], ["photo", "video", "other", "other", "photo", "video"]),
    (S.is_metadata_file, [".DS_Store", "Icon\r", "._x", "Icons", "a"], [True, True, True, False, False]),
    (S.is_metadata_dir, [".Trashes", "Trashes"], [True, False]),
    (S.is_dev_dir, ["node_modules", "Node_Modules", "X.APP", "target", "targets", "lib.photoslibrary"], [True, False, True, True, False, False]),
    (S.stem, ["photo.jpg", "Makefile", ".gitignore", "a.tar.gz", "x."], ["photo", "Makefile", ".gitignore", "a.tar", "x."]),
    (S.extension, ["photo.jpg", "Makefile", ".gitignore", "a.tar.gz", "x."], ["jpg", None, None, "gz", None]),
    (S.file_ext, ["/a/B.JPG", "/a/.hidden", "/a.b/c", "x.tar.GZ"], ["jpg", "(no ext)", "(no ext)", "gz"]),
    (S.folder_name, ["/a/b/", "/a", "/", ""], ["b", "a", "/", ""]),
    (S.short_hash, ["0123456789abcdef", "abc", "", None], ["0123456789…cdef", "abc…abc", "", ""]),
    (
        S.csv_field,
        ["plain", "a,b", 'say "x"', "l\nf", "=1+1", "+1", "-1", "@x", "\tx", "\rx", "=a,b", ""],
        ["plain", '"a,b"', '"say ""x"""', '"l\nf"', "'=1+1", "'+1", "'-1", "'@x", "'\tx", "'\rx", '"\'=a,b"', ""],
    ),
    (S.is_legacy_hash, ["p:ab", "ab"], [True, False]),
    (S.slug, ["a b/ç.mp4"], ["a_b_ç_mp4"]),
    (S.nfc, ["é", "abc", None], ["é", "abc", None]),
    (lambda c: S.roots_from_json(c), ['["/a","/b"]', "broken", None], [["/a", "/b"], [], []]),
]


@pytest.mark.parametrize("f,rows,expected", TABLE, ids=[getattr(t[0], "__name__", "f") for t in TABLE])
def test_text_functions(spark, f, rows, expected):
    assert values(spark, f, rows) == expected


def test_fmt_bytes(spark):
    got = values(spark, S.fmt_bytes, [0, 1023, 1024, 1536, 1 << 20, 5 << 30, 1 << 50, 3 << 60, None], "bigint")
    assert got == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB", "1.00 PB", "3072.00 PB", "–"]


def test_versions(spark):
    rows = [("1.2.3", "1.2.4"), ("v2.0.0", "1.9.9"), ("1", "1.0.0"), ("a.b.c", "1.0.0"), ("1.b.c", "1.0.0"), ("1.2.3-beta", "1.2.3"), (" vv1.10 ", "1.9")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(S.compare_versions("a", "b")).collect()] == [-1, 1, 0, 0, 0, 0, 1]


def test_is_under(spark):
    rows = [("/a", "/a/b"), ("/a", "/ab"), ("/a/", "/a"), ("/a/b", "/a/b/../c"), ("/", "/x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(S.is_under("a", "b")).collect()] == [True, False, True, False, True]


def test_ancestors_and_depth(spark):
    df = spark.createDataFrame([("/r", "/r/a/b"), ("/r", "/r")], "r string, p string")
    assert [tuple(x) for x in df.select(S.ancestors("r", "p"), S.depth_below("r", "p")).collect()] == [(["/r", "/r/a", "/r/a/b"], 2), (["/r"], 0)]


def test_times_percent_preview(spark):
    df = spark.createDataFrame([(16.0, 3, 0)], "d double, n int, z int")
    r = df.select(S.sample_times("d"), S.percent("n", F.lit(8)), S.percent("n", "z"), S.preview_line(F.lit("keep"), F.lit(5), F.lit("/p"), F.lit("why")), S.fmt_ts(F.lit(None).cast("timestamp"))).first()
    assert r[0] == [1.0, 3.0, 5.0, 7.0, 9.0, 11.0, 13.0, 15.0] and r[1] == 37 and r[2] == 300
    assert r[3] == "KEEP                5 bytes  /p  (why)" and r[4] == "never"


def test_blake3_vectors():
    # Published test vectors: bytes counting modulo 251.
    data = lambda n: bytes(i % 251 for i in range(n))
    known = {0: "af1349b9f5f9a1a6", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2048: "e776b6028c7cd22a", 3072: "b98cb0ff3623be03"}
    assert {n: blake3_hex(data(n))[:16] for n in known} == known
    h = Hasher()
    for i in range(0, 5000, 777):
        h.update(data(5000)[i : i + 777])
    assert h.hexdigest() == blake3_hex(data(5000))


def test_phash_and_column_agree(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (48, 64)).astype(np.uint8)
    c = dct2d(resize(image))[:8, :8].ravel()[1:].tolist() + [0.0]
    df = spark.createDataFrame([(c,)], "c array<double>")
    assert df.select(S.phash_bits("c")).first()[0] == phash(image)
    x = rng.random((32, 32))
    assert np.allclose((dct2d(x) ** 2).sum(), (x**2).sum())  # orthonormal
    turns = [phash(t) for t in orientations(image)]
    assert phash(np.rot90(image, -1)) == turns[1] and len(turns) == 4
