"""Manifests of quarantine runs: written whole and renamed into place, read as a table.

While a run goes on, each of its tasks appends what it does to a journal of its own, in a folder
beside the manifest.  The manifest is put together at the end, once; a run that broke off has its journals.
"""

from __future__ import annotations

import csv
import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions.errors import BadInput, PathOutsideRoot

ENTRY = "struct<hash:string,original_path:string,quarantine_path:string,size:bigint,moved_ts:string,status:string,reason:string>"
SCHEMA = f"run_id string, started_ts string, mode string, entries array<{ENTRY}>"


def write_manifest(path: str, manifest: dict) -> None:
    """The old or the new manifest is there at any time, never a part of one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = path + ".tmp"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_run(path: str, head: dict, entries: Iterable[dict]) -> None:
    """The same, with entries that come one by one: none are held."""
    part = path + ".tmp"
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "entries": [')
        for i, e in enumerate(entries):
            f.write(("," if i else "") + "\n    " + json.dumps(e, ensure_ascii=False))
        f.write("\n  ]\n}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


class Journal:
    """Steps of one task, a JSON line each; a line is on disk before the next step is made."""

    def __init__(self, folder: str, bucket: int):
        os.makedirs(folder, exist_ok=True)
        self.file = open(os.path.join(folder, f"{bucket:06d}-{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")  # noqa: SIM115

    def write(self, step: dict) -> None:
        self.file.write(json.dumps(step, ensure_ascii=False) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


def journal_folder(manifest_path: str) -> str:
    return manifest_path.removesuffix(".json") + ".journal"


def journal_steps(folder: str, bucket: int | None = None) -> dict[str, dict]:
    """The last step of each path, of one task's attempts or of all; a line that was cut off is none."""
    last: dict[str, dict] = {}
    begin = "" if bucket is None else f"{bucket:06d}-"
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not (name.startswith(begin) and name.endswith(".jsonl")):
            continue
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    step = json.loads(line)
                except ValueError:
                    continue
                if last.get(step["path"], {}).get("state") != "done":
                    last[step["path"]] = step
    return last


def load_manifest(path: str) -> dict:
    """A run's manifest; of a run that broke off, its journals' entries: what was being moved counts as moved if it is there."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    for step in journal_steps(journal_folder(path)).values():
        e = step["entry"]
        if step["state"] == "done" or (os.path.exists(e["quarantine_path"]) and not os.path.lexists(e["original_path"])):
            m["entries"].append(e)
    for e in m["entries"]:  # older manifests have neither
        e.setdefault("status", "")
        e.setdefault("reason", None)
    return m


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one manifest or a folder of them."""
    m = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = m.select("run_id", "started_ts", "mode", F.explode("entries").alias("e")).select("run_id", "started_ts", "mode", "e.*")
    return rows.withColumn("status", F.coalesce("status", F.lit("")))


def guard(path: str, folder: str) -> str:
    """The path, if it lies under the folder once ``.`` and ``..`` are resolved by text."""
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    clean = "/" + "/".join(parts)
    if not (clean + "/").startswith(os.path.abspath(folder).rstrip("/") + "/"):
        raise PathOutsideRoot(path)
    if not clean.endswith(".json"):
        raise BadInput("not a manifest")
    return clean


def csv_cell(s: str | None) -> str:
    """A guard before what a spreadsheet would run, then quotes where they are needed."""
    s = s or ""
    if s[:1] in ("=", "+", "-", "@", "\t", "\r") and s:
        s = "'" + s
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s


def append_log(folder: str, manifest: dict) -> None:
    """The run's entries (any iterable) after those of earlier runs, under one header."""
    path = os.path.join(folder, K.QUARANTINE_LOG)
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8", newline="") as f:
        if new:
            f.write(",".join(K.QUARANTINE_COLUMNS) + "\n")
        for e in manifest["entries"]:
            cells = [csv_cell(e["moved_ts"]), csv_cell(e["status"]), csv_cell(e["original_path"]), csv_cell(e["quarantine_path"]), str(e["size"]), csv_cell(e["hash"]), csv_cell(e["reason"])]
            f.write(",".join(cells) + "\n")


def read_log(folder: str) -> list[dict]:
    with open(os.path.join(folder, K.QUARANTINE_LOG), encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))
