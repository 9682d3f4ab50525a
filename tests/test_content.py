"""Digests of whole files and of files read in ranges."""

import os

import numpy as np
import pytest

from siftstone.functions import blake3
from siftstone.functions.blake3 import CHUNK, Hasher, blake3_hex, merge
from siftstone.sources import content

SPAN = 4 * CHUNK


def data(n):
    return np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("n", [SPAN + 1, 2 * SPAN, 2 * SPAN + 1, 5 * SPAN + 700, 8 * SPAN, 13 * SPAN + CHUNK])
@pytest.mark.parametrize("fan", [2, 4, 1024])
def test_ranges_merge_to_the_digest(n, fan):
    d = data(n)
    values = []
    for i in range(0, n, SPAN):
        h = Hasher(i // CHUNK)
        for k in range(i, min(n, i + SPAN), 999):
            h.update(d[k : min(n, i + SPAN, k + 999)])
        values.append(h.value())
    while len(values) > 1:
        groups = [values[i : i + fan] for i in range(0, len(values), fan)]
        values = [g[0] if len(g) == 1 else merge(g, len(groups) == 1) for g in groups]
    assert values[0].hex() == blake3_hex(d)


def test_tiles_change_nothing(monkeypatch):
    d = data(100 * CHUNK + 5)
    whole = blake3_hex(d)
    monkeypatch.setattr(blake3, "TILE", 7)
    assert blake3_hex(d) == whole


def test_files_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Sizes around the range's, one file of many ranges, and several levels of merging."""
    monkeypatch.setattr(content, "FAN", 4)
    sizes = [0, 1, SPAN - 1, SPAN, SPAN + 1, 2 * SPAN, 37 * SPAN + 123]
    rows = []
    for n in sizes:
        p = tmp_path / f"f{n}"
        p.write_bytes(data(n))
        rows.append((str(p), n))
    grown = str(tmp_path / "grown")
    with open(grown, "wb") as f:
        f.write(data(3 * SPAN))
    rows += [(str(tmp_path / "gone"), 9 * SPAN), (grown, 3 * SPAN - 5), (rows[1][0], 1), (rows[1][0], 0)]
    files = spark.createDataFrame(rows, "path string, size long")
    got = {r["path"]: r for r in content.hash_files(files, "blake3", span=SPAN).collect()}
    assert len(got) == len(sizes) + 2
    for n in sizes:
        r = got[str(tmp_path / f"f{n}")]
        assert r["hash"] == content.hash_file(r["path"], "blake3") == blake3_hex(data(n)) and r["message"] is None
    assert got[str(tmp_path / "gone")]["hash"] is None and "No such file" in got[str(tmp_path / "gone")]["message"]
    assert got[grown]["hash"] is None and got[grown]["message"] == content.CHANGED
    sha = {r["path"]: r["hash"] for r in content.hash_files(files, "sha256").collect()}
    assert sha[str(tmp_path / "f1")] == content.hash_file(str(tmp_path / "f1")) and len(sha) == len(got)


def test_one_huge_file_is_many_units(spark, tmp_path):
    """A sparse file of 256 MiB: four ranges of 64 MiB."""
    p = str(tmp_path / "huge")
    with open(p, "wb") as f:
        f.truncate(1 << 28)
    done = spark.sparkContext.accumulator(0)
    (r,) = content.hash_files(spark.createDataFrame([(p, os.path.getsize(p))], "path string, size long"), "blake3", bytes_per_task=1 << 26, done=done).collect()
    assert r["hash"] == content.hash_file(p, "blake3") and done.value == 1
