"""Best-fit packing of token sequences, with a bounded number of open bins.

Documents are tokenized where they lie; only piece lengths are shuffled.  Pieces arrive in
the order of the input.  Stretches of that order, of equal length, are packed online side
by side: a fixed number of bins is open, a bitset keyed by free space finds the tightest bin
that holds a piece in a few word operations, and when no bin fits and all are open, the
fullest closes.  A look-ahead of as many pieces as bins may be open takes the longest of
them first, which needs no more space and loses less; with a look-ahead of 1 each piece is
placed as it comes.  In the pipeline the input's files are the shards of the mix, and no
sequence holds pieces of two of them.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm.common import arrow_batches, table
from siftstone.sources.scratch import cut, placed

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
OPEN_BINS = 1024
#: Pieces in a stretch: large enough that the bins left open at its end are few.
GROUP = 100_000
#: Remembered chunks in each of the two generations of a Python worker's memory.
MEMORY = 300_000
#: Characters of text that are encoded together, about.
TOGETHER = 2_000_000
#: Controls that Python takes for white space and the vocabulary's splitter doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Marks that the splitter takes as one piece after a word, and how many such runs are remembered.
_MARKS = string.punctuation
_TAILS = 10_000


def _lower_latin(word: str) -> bool:
    """True for a word of Latin-1 letters that lower-casing leaves as it is."""
    if word.isascii():
        return word.islower()
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return word == word.lower()


def _byte_letters() -> dict[int, str]:
    """The vocabulary's stand-ins for bytes: printable ones stand for themselves, the
    others are counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_loaded: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of texts as little-endian bytes.

    The vocabulary's normalizer lower-cases and turns white space into spaces, and its
    splitter never joins across white space.  So the ids of a text are those of its chunks,
    which repeat and are remembered.  A run of letters is one piece to the splitter, so the
    library's merge model gets it directly; a run of marks after it is the next piece.
    All other chunks, and texts beyond Latin-1, which libraries may lower-case and compose
    in their own ways, go through the whole tokenizer.  So do texts that hold a special
    token's string in any case, which the library looks for before it lower-cases.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str] | None:
        if _CONTROLS.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        low = text.lower()
        return None if any(t in low for t in self.special) else low.split()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if not word.isalpha() or not _lower_latin(word):
            return self._whole(chunk)
        if word == chunk:
            return self._word(word)
        ids = self.known.get(word) or self.older.get(word)
        if ids is None:
            ids = self.known[word] = self._word(word)
        marks = chunk[len(word) :]
        tail = self.tails.get(marks)
        if tail is None:
            tail = self._whole(marks)
            if len(self.tails) < _TAILS:
                self.tails[marks] = tail
        return ids + tail

    def _learn(self, chunks: set[str]) -> None:
        """Make sure that all these chunks are in the newer generation."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for c in chunks.difference(known):
            got = older.get(c)
            known[c] = self._ids(c) if got is None else got

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and (n == 0 or n + len(texts[stop]) <= TOGETHER):
                n += len(texts[stop]) + 1
                stop += 1
            out += self._some(texts[at:stop])
            at = stop
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        chunks = [self._chunks(t) for t in texts]
        self._learn(set(chain.from_iterable(c for c in chunks if c)))
        ids = self.known.__getitem__
        return [self._whole(t) if c is None else b"".join(map(ids, c)) for t, c in zip(texts, chunks)]


def _pieces(path: str, end: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:
            _loaded[path] = ChunkEncoder(path)
        encoder, tail = _loaded[path], int(end).to_bytes(4, "little")
        for pdf in batches:
            rows = []
            for doc_id, lot, ids in zip(pdf["doc_id"], pdf["lot"], encoder.encode([t or "" for t in pdf["text"]])):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, lot, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "lot", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "lot": "int64", "piece": "int32"})

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, end: int = 0, size: int = SIZE, lot: Column | None = None) -> DataFrame:
    """(doc_id, lot, piece, start, length, ids_crc32): each document's ids and the end id, cut
    into pieces of ``size`` where they are longer.  ``lot`` (long) is carried along."""
    run = _pieces(vocabulary or public_tokenizers.path(VOCABULARY), end, size)
    rows = docs.select("doc_id", "text", (F.lit(0) if lot is None else lot).cast("long").alias("lot"))
    return rows.mapInPandas(run, "doc_id long, lot long, piece int, start long, length long, ids_crc32 long")


class BinSet:
    """At most ``most`` open bins; ``bits`` has a bit for each free space that some open
    bin has, ``at[free]`` lists those bins."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.at, self.count = 0, [[] for _ in range(size + 1)], 0

    def _add(self, free: int, bin_: int) -> None:
        self.at[free].append(bin_)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        held = self.at[free]
        bin_ = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, length: int, fresh) -> tuple[int, int]:
        """(bin, offset) for a piece; ``fresh()`` names a new bin."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, fresh()
            if self.count >= self.most and length < free:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        if free > length:
            self._add(free - length, bin_)
        return bin_, self.size - free


def pack_lengths(lengths, size: int = SIZE, most: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    bins, names = BinSet(size, most), iter(range(1 << 62))
    fresh = lambda: next(names)
    got = [bins.place(int(n), fresh) for n in lengths]
    return np.array([b for b, _ in got], dtype=np.int64), np.array([o for _, o in got], dtype=np.int64)


def _packed(size: int, most: int, look_ahead: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        n = pdf.groupby("lot", sort=False).cumcount().to_numpy() // look_ahead
        lot = pd.factorize(pdf["lot"])[0]  # lots in the order of their coming
        pdf = pdf.iloc[np.lexsort((-pdf["length"].to_numpy(), n, lot))].reset_index(drop=True)
        lots, used, found = pdf["lot"].to_numpy(), 0, []
        edges = [0, *(np.flatnonzero(lots[1:] != lots[:-1]) + 1).tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):  # no sequence holds pieces of two lots
            bins, offset = pack_lengths(pdf["length"][a:b], size, most)
            found.append((bins + used, offset))
            used += int(bins.max()) + 1
        pdf["sequence_id"] = (int(key[0]) << 32) + np.concatenate([b for b, _ in found])
        pdf["offset"] = np.concatenate([o for _, o in found])
        return pdf.drop(columns=["lot", "place", "stretch"])

    return run


def pack(
    docs: DataFrame, vocabulary: str | None = None, end: int = 0, size: int = SIZE, most: int = OPEN_BINS, look_ahead: int = OPEN_BINS, lot: Column | None = None, group: int = GROUP
) -> DataFrame:
    """Pieces of :func:`pieces` with (sequence_id, offset).

    Whole pieces of ``size`` fill a sequence each.  Null and empty texts are one piece with
    the end id; texts of any length are cut into as many pieces as they need.  Pieces are
    taken as the rows lie in the input, the longest of each look-ahead first, equally long ones in
    their order; of bins that fit equally well the newest is taken.  Repeated
    rows are packed each; a null doc_id is kept as null.  With ``lot`` a sequence holds pieces
    of one lot only; rows of a lot lie together.  An empty table gives no rows; only doc_id, text and what ``lot``
    names are read, so other columns may have any name.
    """
    with arrow_batches(docs.sparkSession):
        cutting = cut(pieces(docs, vocabulary, end, size, lot), "pack-pieces")
    total = cutting.count()
    length = max(1, -(-total // max(1, round(total / group))))
    dealt = placed(cutting).withColumn("stretch", F.floor(F.col("place") / length).cast("long"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("stretch").applyInPandas(_packed(size, most, look_ahead), kind)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: its result is the packing of the documents it gets.

    The files of ``docs`` are the mix's shards, and their rows lie in the shard's shuffled
    order; each is packed by itself.  Rows that come from no file are packed together.  Odd
    rows and tables are treated as in :func:`pack`.
    """
    lot = F.xxhash64("_metadata.file_path")
    try:
        docs.select(lot)
    except AnalysisException:  # no table of files
        lot = None
    return pack(docs, lot=lot)
