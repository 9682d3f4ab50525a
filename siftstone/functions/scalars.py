"""Scalar functions over paths, names, sizes and texts, as Column expressions.

All stay inside generated code but :func:`nfc`, for which Spark has no built-in.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions import constants as K


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- paths -----------------------------------------------------------------------------


def nfc_text(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFC", s)


def nfc(path: Column | str) -> Column:
    """Canonical composition; ASCII texts, which are nearly all, never reach Python's normalizer."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(_c(path))


def file_name(path: Column | str) -> Column:
    """Last segment of a path; empty for the root, ``..`` or an empty path."""
    last = F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)
    return F.when(last.isin("..", "."), "").otherwise(last)


def parent(path: Column | str) -> Column:
    """Path without its last segment; ``/`` for its children, empty for a bare name."""
    p = _c(path)
    cut = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(~p.contains("/"), "").when((cut == "") & p.startswith("/"), "/").otherwise(cut)


def sanitize(path: Column | str) -> Column:
    """Lexical removal of ``.``, empty parts and ``..``, which pops a part and never climbs out."""
    p = _c(path)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, start,
        lambda a, x: F.when(x != "..", F.array_append(a, x)).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a),
    )
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def is_under(root: Column | str, path: Column | str) -> Column:
    """Lexical containment by whole path components."""
    r, p = F.regexp_replace(sanitize(root), "/$", ""), sanitize(path)
    return (p == r) | p.startswith(F.concat(r, F.lit("/"))) | ((r == "") & ~p.startswith("/"))


def is_metadata_file(name: Column | str) -> Column:
    n = F.regexp_replace(_c(name), "\r+$", "")
    return n.isin(K.METADATA_FILES) | n.startswith(K.METADATA_PREFIX)


def is_metadata_dir(name: Column | str) -> Column:
    return _c(name).isin(K.METADATA_DIRS)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_dev_dir(name: Column | str) -> Column:
    low = _ascii_lower(_c(name))
    out = _c(name).isin(K.DEV_DIRS)
    for s in K.BUNDLE_SUFFIXES:
        out = out | low.endswith(s)
    return out


def media_kind(name: Column | str) -> Column:
    """photo, video or other, by the text after the last dot, if there is a dot."""
    n = _c(name)
    ext = _ascii_lower(F.substring_index(n, ".", -1))
    return (
        F.when(~n.contains("."), "other").when(ext.isin(K.PHOTO_EXTENSIONS), "photo").when(ext.isin(K.VIDEO_EXTENSIONS), "video").otherwise("other")
    )


def stem(name: Column | str) -> Column:
    n = _c(name)
    return F.when(n.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_extract(n, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(n)


def extension(name: Column | str) -> Column:
    """Text after the last dot, where that is neither first nor last; else null."""
    n = _c(name)
    return F.when(n.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_extract(n, r"(?s)^.+\.([^.]+)$", 1))


def file_ext(path: Column | str) -> Column:
    """Display extension: lower case after a dot that isn't first in the name, else ``(no ext)``."""
    base = F.substring_index(_c(path), "/", -1)
    return F.when(base.rlike(r"(?s)^.+\."), F.lower(F.substring_index(base, ".", -1))).otherwise("(no ext)")


def folder_name(path: Column | str) -> Column:
    """Last non-empty part of a path, else the path itself."""
    p = F.coalesce(_c(path), F.lit(""))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(p)


def depth_below(root: Column | str, path: Column | str) -> Column:
    """Number of path components below the root."""
    rest = F.substr(_c(path), F.length(_c(root)) + 1, F.length(_c(path)))
    return F.size(F.filter(F.split(rest, "/"), lambda x: x != ""))


def ancestors(root: Column | str, folder: Column | str) -> Column:
    """The folder and all above it down to the root, as an array of paths."""
    r, f = _c(root), _c(folder)
    parts = F.filter(F.split(F.substr(f, F.length(r) + 1, F.length(f)), "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.when(i == 0, r).otherwise(F.concat(r, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    )


def slug(name: Column | str) -> Column:
    """Letters and digits kept, all else ``_``, 40 characters at most."""
    return F.substring(F.regexp_replace(_c(name), r"[^\p{L}\p{N}]", "_"), 1, 40)


# --- hashes ----------------------------------------------------------------------------


def is_legacy_hash(h: Column | str) -> Column:
    return _c(h).startswith(K.LEGACY_PREFIX)


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def short_hash(h: Column | str) -> Column:
    """First ten and last four characters; empty for null and empty."""
    c = F.coalesce(_c(h), F.lit(""))
    return F.when(c == "", "").otherwise(F.concat(F.substring(c, 1, 10), F.lit("…"), F.right(c, F.lit(4))))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def phash_bits(coefficients: Column | str) -> Column:
    """64 coefficients to 64 bits: bit i is set where value i is above element 32 of the sorted 64."""
    c = _c(coefficients)

    def above(middle: Column) -> Column:
        bits = F.transform(c, lambda v, i: F.when(v > middle, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    # As the variable of a function the middle is found once, not for each value.
    return F.element_at(F.transform(F.array(F.element_at(F.array_sort(c), 33)), above), 1)


# --- texts -----------------------------------------------------------------------------


def csv_field(value: Column | str) -> Column:
    """A quote before a formula's first character; then CSV quoting where it is needed."""
    v = _c(value)
    safe = F.when(F.substring(v, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), v)).otherwise(v)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.contains(",") | safe.contains('"') | safe.contains("\n"), quoted).otherwise(safe)


def version_key(version: Column | str) -> Column:
    """struct(major, minor, patch), or null where the major part is no number."""
    v = F.regexp_replace(F.trim(_c(version)), "^v+", "")
    parts = F.split(v, r"\.")
    whole = lambda s: F.when(s.rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace(s, r"^\+", "").cast("long"))
    major = whole(F.get(parts, F.lit(0)))
    minor = F.coalesce(whole(F.get(parts, F.lit(1))), F.lit(0).cast("long"))
    patch = F.coalesce(whole(F.regexp_extract(F.coalesce(F.get(parts, F.lit(2)), F.lit("0")), "^[0-9]*", 0)), F.lit(0).cast("long"))
    return F.when(major.isNotNull(), F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch")))


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; 0 where either side can't be read."""
    x, y = version_key(a), version_key(b)
    return F.when(x.isNull() | y.isNull(), 0).when(x < y, -1).when(x > y, 1).otherwise(0)


def percent(done: Column | str, total: Column | str) -> Column:
    return F.floor(_c(done) * 100 / F.greatest(_c(total), F.lit(1))).cast("int")


def preview_line(action: Column | str, size: Column | str, path: Column | str, reason: Column | str) -> Column:
    tag = F.when(_c(action) == "keep", "KEEP").otherwise("QUARANT")
    return F.format_string("%-8s %12d bytes  %s  (%s)", tag, _c(size), _c(path), _c(reason))


UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def fmt_bytes(n: Column | str) -> Column:
    """Powers of 1024; whole numbers for B, else two decimals; a dash for null."""
    v = _c(n).cast("double")
    out = F.when(v.isNull(), "–").when(v < 1024, F.concat(v.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS[1:], 1):
        text = F.format_string(f"%.2f {unit}", v / float(1024**i))
        out = out.when(v < float(1024 ** (i + 1)), text) if unit != UNITS[-1] else out.otherwise(text)
    return out


def fmt_ts(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("never"))


def roots_json(roots: Column | str) -> Column:
    return F.to_json(_c(roots))


def roots_from_json(text: Column | str) -> Column:
    return F.coalesce(F.from_json(_c(text), "array<string>"), F.array().cast("array<string>"))


def run_id() -> Column:
    return F.concat(F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss"), F.lit("-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def sample_times(duration: Column | str, frames: int = K.FRAMES) -> Column:
    """Times at the middles of equal parts of a video."""
    d = F.greatest(_c(duration), F.lit(0.1))
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: d * (i + 0.5) / frames)
