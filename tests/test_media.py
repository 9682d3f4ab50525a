"""Image files decoded by Spark, and fingerprints of stored frames."""

import os
import struct
import zlib

import numpy as np
import pytest

from siftstone.functions.phash import orientations, phash
from siftstone.sources import media

RNG = np.random.default_rng(11)


def png(path, image):
    """A PNG of 8 bits: grey, colour, or colour with alpha."""
    kind = {2: 0, 3: 2, 4: 6}[image.ndim if image.ndim == 2 else image.shape[2]]
    part = lambda tag, d: struct.pack(">I", len(d)) + tag + d + struct.pack(">I", zlib.crc32(tag + d))
    h, w = image.shape[:2]
    lines = b"".join(b"\0" + r.tobytes() for r in image)
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def converted(spark, source, target, kind):
    """An image written in another format by the JVM."""
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    assert io.write(io.read(file(source)), kind, file(target))


def want(rgb):
    r, g, b = (rgb[:, :, i].astype(int) for i in range(3))
    return ((2126 * r + 7152 * g + 722 * b) // 10000).astype(np.uint8)


def test_formats_equal_the_stored_pixels(spark, tmp_path):
    colour, alpha, grey = (RNG.integers(0, 256, s).astype(np.uint8) for s in ((17, 23, 3), (9, 5, 4), (12, 31)))
    at = lambda n: str(tmp_path / "in" / n)
    png(at("c.png"), colour), png(at("deep/a.png"), alpha), png(at("g.png"), grey)
    for kind in ("bmp", "tiff"):
        converted(spark, at("c.png"), at(f"c.{kind}"), kind)
    smooth = np.add.outer(np.arange(48) * 2, np.arange(64) * 2).astype(np.uint8)
    png(at("s.png"), smooth)
    converted(spark, at("s.png"), at("s.jpg"), "jpg")
    converted(spark, at("s.png"), at("s.gif"), "gif")
    for n, data in (("empty.png", b""), ("text.jpg", b"no image"), ("cut.png", open(at("c.png"), "rb").read()[:60])):
        with open(at(n), "wb") as f:
            f.write(data)
    got = {os.path.basename(r["origin"]): r for r in media.luma(media.images(spark, str(tmp_path / "in"))).collect()}
    pixels = lambda n: np.frombuffer(got[n]["luma"], np.uint8).reshape(got[n]["height"], got[n]["width"])
    for n in ("c.png", "c.bmp", "c.tiff"):
        assert (pixels(n) == want(colour)).all()
    assert (pixels("a.png") == want(alpha)).all() and (pixels("g.png") == grey).all()
    assert np.abs(pixels("s.jpg").astype(int) - smooth).max() <= 4 and pixels("s.gif").shape == smooth.shape
    for n in ("text.jpg", "cut.png"):
        assert got[n]["luma"] is None and got[n]["height"] == -1
    assert len(got) == 10  # files without a byte are no rows


def test_fingerprints_of_stored_frames(spark, tmp_path):
    """Whole, missing, broken and doubled frames, no folder at all, and folders of other videos."""
    root, films = str(tmp_path / "frames"), {}
    paths = ["/v/trip one.mp4", "/v/été.mov", "/v/gap.mp4", "/v/broken.mp4", "/v/none.mp4", "/v/.mp4", "/w/trip one.mp4"]
    videos = spark.createDataFrame([(p,) for p in paths], "path string")
    folder = {r["path"]: r["f"] for r in videos.select("path", media.frame_folder("path").alias("f")).collect()}
    assert folder["/v/trip one.mp4"].startswith("v_trip_one_") and len(set(folder.values())) == len(paths)
    for p in paths:
        if p == "/v/none.mp4":
            continue
        films[p] = RNG.integers(0, 256, (8, 40, 50)).astype(np.uint8)
        for i in range(8):
            if (p, i) != ("/v/gap.mp4", 5):
                png(os.path.join(root, folder[p], f"{i}.png"), films[p][i])
    with open(os.path.join(root, folder["/v/broken.mp4"], "2.png"), "wb") as f:
        f.write(b"\x89PNG")
    png(os.path.join(root, folder["/v/.mp4"], "0.tif"), films["/v/.mp4"][7])
    png(os.path.join(root, folder["/v/.mp4"], "8.png"), films["/v/.mp4"][0])
    png(os.path.join(root, "other_0123456789abcdef", "0.png"), films["/v/.mp4"][0])
    got = {r["path"]: r for r in media.stored_fingerprints(videos, root).collect()}
    assert len(got) == len(paths)
    for p in ("/v/trip one.mp4", "/v/été.mov", "/v/.mp4", "/w/trip one.mp4"):
        turned = [orientations(x) for x in films[p]]
        assert got[p]["frames"] == [[phash(t[o]) for t in turned] for o in range(4)] and got[p]["error"] is None
    for p, i in (("/v/gap.mp4", 5), ("/v/broken.mp4", 2), ("/v/none.mp4", 0)):
        assert got[p]["frames"] is None and got[p]["error"] == f"no image of frame {i}"


def test_no_frames_and_no_videos(spark, tmp_path):
    os.makedirs(tmp_path / "empty")
    one = spark.createDataFrame([("/v/a.mp4",)], "path string")
    assert media.stored_fingerprints(one, str(tmp_path / "empty")).first()["error"] == "no image of frame 0"
    assert media.stored_fingerprints(one.limit(0), str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        media.stored_fingerprints(one, str(tmp_path / "nowhere")).count()


def test_engine_reads_stored_frames(spark, tmp_path):
    """Two encodings of one film meet in a cluster though no tool is there, a film without frames fails."""
    from siftstone.operators.inventory import ScanOptions
    from siftstone.plans.engine import Engine

    tree, root = tmp_path / "tree", str(tmp_path / "frames")
    tree.mkdir()
    for n in ("a.mp4", "b.mp4", "c.mp4", "d.mp4"):
        (tree / n).write_bytes(n.encode())
    engine = Engine(spark, str(tmp_path / "data"))
    engine.run_scan([str(tree)], options=ScanOptions())
    films = RNG.integers(0, 256, (2, 8, 40, 40)).astype(np.uint8)
    paths = spark.createDataFrame([(str(tree / n),) for n in ("a.mp4", "b.mp4", "c.mp4")], "path string")
    for r in paths.select("path", media.frame_folder("path").alias("f")).collect():
        for i in range(8):
            image = films[int(r["path"].endswith("c.mp4"))][i]
            png(os.path.join(root, r["f"], f"{i}.png"), np.ascontiguousarray(np.rot90(image)) if r["path"].endswith("b.mp4") else image)
    got = engine.find_similar_videos(frames_root=root)
    assert (got["available"], got["considered"], got["fingerprinted"], got["failed"]) == (True, 4, 3, 1)
    assert [os.path.basename(r["path"]) for r in got["members"].orderBy("path").collect()] == ["a.mp4", "b.mp4"]
