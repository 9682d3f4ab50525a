"""Frames of videos, by external tools or from image files, and their fingerprints.

Without the tools and without stored frames every video fails and reports say that they are not
available; what follows the hashes is relational and needs none of this.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions import scalars as S
from siftstone.functions.phash import orientations, phash

# Folders that are looked in before the search path.
TOOL_DIRS = ["/opt/homebrew/bin", "/usr/local/bin"]
SCHEMA = "path string, frames array<array<bigint>>, error string"
# Shares of red, green and blue in 8-bit luma, in parts of 10,000.
LUMA = [2126, 7152, 722]


def find_tool(name: str) -> str | None:
    for d in TOOL_DIRS:
        at = os.path.join(d, name)
        if os.path.isfile(at):
            return at
    return shutil.which(name)


def tools_available() -> bool:
    return find_tool("ffmpeg") is not None and find_tool("ffprobe") is not None


def probe_duration(path: str) -> float:
    """Seconds, 1 if they can't be read, at least 0.1."""
    try:
        said = subprocess.run(
            [find_tool("ffprobe"), "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path], capture_output=True, text=True, timeout=60
        ).stdout
        return max(0.1, float(said.strip()))
    except (OSError, ValueError, TypeError, subprocess.TimeoutExpired):
        return 1.0


def read_pgm(data: bytes) -> np.ndarray:
    """Grey pixels of a binary PGM."""
    head, at = [], 0
    while len(head) < 4:
        end = at
        while data[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
            end += 1
        if data[at:end]:
            head.append(data[at:end])
        at = end + 1
    if head[0] != b"P5":
        raise ValueError("not a grey image")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(data, dtype=np.uint8, count=width * height, offset=at).reshape(height, width)


def extract_frame(path: str, seconds: float) -> np.ndarray:
    with tempfile.TemporaryDirectory() as d:
        out = os.path.join(d, "frame.pgm")
        tool = find_tool("ffmpeg")
        if tool is None:
            raise ValueError("no tool for frames")
        done = subprocess.run([tool, "-v", "error", "-ss", f"{seconds:.3f}", "-i", path, "-frames:v", "1", "-pix_fmt", "gray", "-y", out], capture_output=True, timeout=120)
        if done.returncode or not os.path.exists(out):
            raise ValueError(done.stderr.decode(errors="replace")[:200] or "no frame")
        with open(out, "rb") as f:
            return read_pgm(f.read())


def fingerprint(path: str, frame: Callable[[str, float], np.ndarray] = extract_frame, duration: Callable[[str], float] = probe_duration) -> list[list[int]]:
    """Hashes of 8 frames in 4 orientations; one failed frame fails the video."""
    length = duration(path)
    images = [frame(path, length * (i + 0.5) / K.FRAMES) for i in range(K.FRAMES)]
    turned = [orientations(p) for p in images]
    return [[phash(t[o]) for t in turned] for o in range(K.ORIENTATIONS)]


def _fingerprints(frame, duration):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append((path, fingerprint(path, frame, duration), None))
                except (OSError, ValueError, subprocess.SubprocessError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "frames", "error"])

    return run


def fingerprints(paths: DataFrame, frame=extract_frame, duration=probe_duration) -> DataFrame:
    """(path, frames, error) for each video."""
    n = max(1, min(10_000, paths.count()))
    return paths.select("path").repartition(n).mapInPandas(_fingerprints(frame, duration), SCHEMA)


# --- image files -----------------------------------------------------------------------


def images(spark: SparkSession, root: str) -> DataFrame:
    """(origin, height, width, channels, pixels) of all files under a folder, decoded by Spark's image source.

    JPEG, PNG, GIF, BMP and TIFF; any other file has a height of -1 and no pixels, one without a byte is no row.  Pixels lie row by
    row, as one grey byte or as blue, green, red and perhaps alpha.  Samples of 16 bits are only
    right in colour: of grey ones Spark's source takes the low byte.
    """
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    return found.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def grey(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """8-bit luma of decoded pixels; alpha takes no part."""
    image = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return image[:, :, 0]
    red, green, blue = LUMA
    return ((image[:, :, 2] * np.int64(red) + image[:, :, 1] * np.int64(green) + image[:, :, 0] * np.int64(blue)) // 10_000).astype(np.uint8)


def _luma(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["luma"] = [grey(*row).tobytes() if row[1] > 0 else None for row in zip(b["pixels"], b["height"], b["width"], b["channels"])]
        yield b[["origin", "height", "width", "luma"]]


def luma(found: DataFrame) -> DataFrame:
    """(origin, height, width, luma binary) of :func:`images`; luma is null where a file is no image."""
    return found.mapInPandas(_luma, "origin string, height int, width int, luma binary")


def _turned_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pixels = zip(b["pixels"], b["height"], b["width"], b["channels"])
        b["hashes"] = [[phash(t) for t in orientations(grey(*row))] if row[1] > 0 else None for row in pixels]
        yield b[["origin", "hashes"]]


def frame_folder(path: Column | str) -> Column:
    """Name of the folder that holds a video's frames: its file's name, made plain, and a digest of its path.

    It begins with a letter, as readers pass over folders that begin with a point or an underscore.
    """
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit("v_"), S.slug(name), F.lit("_"), F.substring(F.sha2(p, 256), 1, 16))


def stored_fingerprints(videos: DataFrame, root: str) -> DataFrame:
    """(path, frames, error) for each of ``videos`` (path) from frames 0 to 7 that lie as image files in
    ``root``/:func:`frame_folder`, such as ``v_clip_0123456789abcdef/3.jpg``.

    A video fails if one of its frames is missing or can't be decoded; of two files for one frame the
    one whose name is first and that can be decoded counts.  Other files are passed over.  Files are
    decoded where they are read, and a video's eight hashes meet in one aggregation.
    """
    hashed = images(videos.sparkSession, root).mapInPandas(_turned_hashes, "origin string, hashes array<bigint>").where("hashes is not null")
    at = r"_([0-9a-f]{16})/([0-9])\.[^/.]+$"
    placed = hashed.select("origin", "hashes", F.regexp_extract("origin", at, 1).alias("digest"), F.regexp_extract("origin", at, 2).alias("frame"))
    each = [F.min_by(F.when(F.col("frame") == str(i), F.col("hashes")), F.when(F.col("frame") == str(i), F.col("origin"))) for i in range(K.FRAMES)]
    eight = placed.where("digest <> ''").groupBy("digest").agg(F.array(*each).alias("eight"))
    turned = F.transform(F.sequence(F.lit(1), F.lit(K.ORIENTATIONS)), lambda o: F.transform("eight", lambda h: F.element_at(h, o)))
    lost = F.coalesce(F.array_position(F.transform("eight", lambda h: h.isNull()), True) - 1, F.lit(0))
    whole = F.coalesce(~F.exists("eight", lambda h: h.isNull()), F.lit(False))
    named = videos.select("path", F.substring(F.sha2("path", 256), 1, 16).alias("digest"))
    return named.join(eight, "digest", "left").select(
        "path", F.when(whole, turned).alias("frames"), F.when(~whole, F.concat(F.lit("no image of frame "), lost.cast("string"))).alias("error")
    )
