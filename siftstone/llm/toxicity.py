"""Toxicity scores of texts restored from obfuscation by a noisy-channel decoder.

1. A character language model (trigrams over a small fixed alphabet) is counted over all
   documents, in parallel; its table is bounded by the alphabet, not by the data.
2. Stretches that look disguised (digits or signs among letters, letters repeated three
   times, single characters in a row) become character lattices: each sign may stand for
   itself, for the letters it resembles, or for nothing; a run of a letter may be one or two
   of it; separators between single characters vanish.  Viterbi decoding under the language
   model and the channel's costs gives the likeliest plain spelling.
3. A logistic model over the restored words and their beginnings, fitted to a bounded
   sample of labelled texts, scores the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, fold, labelled_rows, sigmoid, table
from siftstone.sources.scratch import cut

#: Labelled texts the model is fitted to, at most, and their bytes; those whose ids hash lowest.
TRAIN_ROWS = 8192
TRAIN_BYTES = 64 << 20
FEATURES = 4000
#: Standard errors of surplus in toxic texts from which a feature counts.
SURPLUS = 5.0
RIDGE = 0.02
#: Standard errors below a feature's share of toxic texts that its bound allows for.
CONFIDENCE = 2.5
#: A feature with at least this bound decides alone.
ALONE = 0.9
SYMBOLS = 64
_BETWEEN, _DIGIT = 0, 27

# Which letters a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¥": "y",
}

_L = r"[^\W\d_]"
_ONE = rf"(?:{_L}|[\d@$!|+€])"
#: Single characters in a row.  Possessive, so that a text is read once.
_SPACED = re.compile(rf"(?<!\w){_ONE}(?:[ .\-_*]++{_ONE}){{3,}}+")
#: What every such row holds, and few other texts: two of them with separators around.
_TWO_APART = re.compile(rf"[ .\-_*]{_ONE}[ .\-_*]+{_ONE}[ .\-_*]")
_LAST = re.compile(rf"[ .\-_*]+{_ONE}\Z")
#: Between the characters of a spaced-out word: maybe a word's end.
_JOINT = "\x1f"
#: In a word: a sign before a letter, signs closing it, a letter three times, letters with marks between.
SUSPECT = re.compile(
    rf"[\d@$!|+€(£¥](?={_L})|(?<={_L})[\d@$!|+€£¥]*[\d@$|+€£¥](?![^.,;:!?])|({_L})\1\1|(?<={_L})[*._\-](?={_L}[*._\-]{_L})"
)
_TWICE = re.compile(rf"({_L})\1")
_RUN = re.compile(r"(.)\1+")
_MARKED = re.compile(rf"(?:{_L}[*._\-]){{2}}{_L}")
_INNER = re.compile(rf"(?<={_L})[*._\-](?={_L})")
#: Characters that are decoded together, and words that are remembered.
STRETCH = 64
MEMORY = 500_000
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|-_"


def _symbol_table() -> np.ndarray:
    code = np.full(0x110000, _BETWEEN, dtype=np.uint8)
    for k in range(26):
        code[97 + k] = code[65 + k] = 1 + k
    code[48:58] = _DIGIT
    letters = np.array([k for k in range(128, 0x3000) if chr(k).isalpha()])
    code[letters] = 28 + letters % (SYMBOLS - 28)
    return code


@lru_cache(1)
def _codes() -> np.ndarray:
    return _symbol_table()


def symbols(text: str) -> np.ndarray:
    return _codes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for pdf in batches:
        for text in pdf["text"]:
            s = symbols("  " + (text or "") + " ").astype(np.int64)
            grams, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
            total[grams] += n
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) from the trigram counts of all texts, as a 64 x 64 x 64 table.  What
    reaches the driver is at most one count for each trigram of the alphabet."""
    grams = docs.select("text").mapInPandas(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for r in grams.collect():
        n[r["gram"]] = r["n"]
    three = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 5 * p2) / (three.sum(2, keepdims=True) + 5)).astype(np.float32)


class Decoder:
    """Viterbi decoding of disguised stretches under a character language model."""

    SWAP, DROP, KEEP_SIGN, DOUBLE = 0.7, 4.5, 6.0, 0.6
    #: What saying nothing costs, and a word's end within a spaced-out stretch.
    GAP, BREAK = 1.5, 1.0

    #: Hypotheses kept in each state, and what a word that the model knows is worth.
    KEEP, KNOWN = 3, 4.0

    def __init__(self, model: np.ndarray, lexicon=frozenset()):
        self.costs, self.lexicon = (-model).ravel().tolist(), lexicon
        self.bare = frozenset(_RUN.sub(r"\1", w) for w in lexicon)
        self.lengths = sorted({len(w) for w in self.bare})
        self.known: dict[str, str] = {}

    def suspect(self, word: str) -> bool:
        """Whether a word looks disguised.  Letters that stand twice are usual; they count
        where, taken once, they let the word begin as one that the model knows."""
        if SUSPECT.search(word):
            return True
        if not self.bare or not _TWICE.search(word):
            return False
        once = _RUN.sub(r"\1", word.strip(_EDGE))
        return any(once[:n] in self.bare for n in self.lengths)

    def word(self, word: str) -> str:
        """A word between white space: as it is, or decoded without the signs at its edges."""
        if not self.suspect(word):
            return word
        core = word.strip(".,;:?\"'#%&")
        if core[-1:] in ("$", "*", "|", "!"):  # noise put after a word, unless little else is left
            bare = core.rstrip(core[-1])
            core = bare if len(bare) > 2 and len(core) - len(bare) > 1 else core
        plain = _INNER.sub("", core) if _MARKED.search(core) else core
        return self.decode(plain) if plain else word

    def spaced(self, text: str) -> str:
        """The text with its rows of single characters decoded."""
        if not _TWO_APART.search(text):
            return text

        def one(m: re.Match) -> str:
            row, rest = m[0], ""
            if text[m.end() : m.end() + 1].isalnum():  # the last character begins a word
                at = _LAST.search(row[-STRETCH:])
                if at is None:
                    return row
                cut = len(row) - len(at[0])
                row, rest = row[:cut], row[cut:]
            letters = re.split(r"[ .\-_*]+", row)
            return self.decode(_JOINT.join(letters)) + rest if len(letters) > 3 else m[0]

        return _SPACED.sub(one, text)

    def _lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """For each run of a character, what it may stand for, and at which cost."""
        runs, out = re.findall(r"((.)\2*)", text, re.DOTALL), []
        for run, c in runs:
            n = len(run)
            if c == _JOINT:
                out.append([("", -self.GAP), (" ", self.BREAK)])
            elif c.isalpha():
                if n < 3:
                    out.append([(run, 0.0)] + ([(c, 2.5)] if n == 2 else []))
                else:
                    out.append([(c, 0.2), (c * 2, 0.2 + self.DOUBLE)])
            else:
                likes = LOOKALIKES.get(c, "")
                arcs = [(run, self.KEEP_SIGN), ("", self.DROP)]
                for s in likes:
                    cost = self.SWAP if n < 3 else 0.2
                    arcs.append((s, cost + 0.4 * (n > 1)))
                    if n > 1:
                        arcs.append((s * 2, cost + self.DOUBLE))
                out.append(arcs)
        return out

    def decode(self, text: str) -> str:
        """The likeliest plain spelling.  Stretches beyond ``STRETCH`` characters, longer than
        any word, are decoded in parts of that size, so that time grows with the length."""
        if len(text) > STRETCH:
            return "".join(self.decode(text[at : at + STRETCH]) for at in range(0, len(text), STRETCH))
        if text.isalpha() and not _TWICE.search(text):  # one path
            return text
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= MEMORY // 3:
                self.known.clear()
            got = self.known[text] = self._viterbi(text)
        return got

    def _viterbi(self, text: str) -> str:
        codes, costs = _codes(), self.costs
        # A state is the last two symbols; it holds its cheapest few (cost, back pointer).
        states: dict[tuple[int, int], list] = {(_BETWEEN, _BETWEEN): [(0.0, None)]}
        for arcs in self._lattice(text):
            fresh: dict[tuple[int, int], list] = {}
            spelled = [(said, [int(codes[ord(ch)]) for ch in said], extra + (self.GAP if said == "" else 0.0)) for said, extra in arcs]
            for (a, b), held in states.items():
                for said, sounds, step in spelled:
                    x, y = a, b
                    for z in sounds:
                        step += costs[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                    fresh.setdefault((x, y), []).extend((cost + step, (said, back)) for cost, back in held)
            states = {s: sorted(h, key=lambda c: c[0])[: self.KEEP] for s, h in fresh.items()}
        best, answer = float("inf"), text
        for (a, b), held in states.items():
            end = costs[(a * SYMBOLS + b) * SYMBOLS + _BETWEEN]
            for cost, back in held:
                said = []
                while back is not None:
                    said.append(back[0])
                    back = back[1]
                word = "".join(reversed(said))
                cost += end - self.KNOWN * sum(w in self.lexicon for w in word.split(" "))
                if cost < best:
                    best, answer = cost, word
        return answer


def restore(text: str, decoder: Decoder) -> str:
    """The lower-cased words of a text, disguised ones decoded."""
    return " ".join(map(decoder.word, decoder.spaced(text.lower()).split()))


def features(word: str) -> list[str]:
    """The parts of a restored word, without signs at their edges, and their beginnings."""
    out = []
    for w in word.split():
        w = w.strip(_EDGE)
        if w:
            out.append(w)
            if len(w) > 4:
                out += [w[:k] + "~" for k in range(4, min(8, len(w)))]
    return out


class Marks:
    """The features of a text among those of a set; those of a word are remembered."""

    def __init__(self, decoder: Decoder, among=None):
        self.decoder, self.among = decoder, among
        #: How features begin: most plain words begin like none.
        self.heads = None if among is None else {f.rstrip("~")[:4] for f in among}
        self.words: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        core = word.rstrip(".,;:!?")
        if core.isalpha() and not _TWICE.search(core):  # nothing in it looks disguised
            if self.heads is not None and core[:4] not in self.heads:
                return ()
            got = features(core)
        else:
            got = features(self.decoder.word(word))
        return tuple(got if self.among is None else filter(self.among.__contains__, got))

    def of(self, text: str) -> set[str]:
        out, words = set(), self.words
        for w in set(self.decoder.spaced(text.lower()).split()):
            got = words.get(w)
            if got is None:
                got = self._of(w)
                if len(w) <= STRETCH:
                    if len(words) >= MEMORY:
                        words.clear()
                    words[w] = got
            if got:
                out.update(got)
        return out


def _least(k: int, n: int) -> float:
    """The share of toxic texts among those with a feature, at the least (Wilson bound)."""
    z2 = CONFIDENCE**2
    return float((k + z2 / 2 - CONFIDENCE * np.sqrt(k * (n - k) / n + z2 / 4)) / (n + z2))


def _each(shared, known: frozenset, among, f):
    """``f(batches of rows, marks)`` as a function for mapInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(batches, Marks(Decoder(shared.value, known), among))

    return run


def _counts(batches: Iterator[pd.DataFrame], marks: Marks) -> Iterator[pd.DataFrame]:
    n = Counter()
    for pdf in batches:
        for t in pdf["text"]:
            n.update(marks.of(t))
    yield pd.DataFrame({"feature": list(n), "n": list(n.values())})


def _indices(batches: Iterator[pd.DataFrame], marks: Marks) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "at": [sorted(marks.among[f] for f in marks.of(t)) for t in pdf["text"]]})


def _counted(sample: DataFrame, shared, known: frozenset) -> tuple[dict[str, int], dict[str, int]]:
    """How many toxic texts, and how many texts, have each feature of three toxic ones or more."""

    def counted(label: int, among, least: int) -> dict[str, int]:
        rows = sample.where(F.col("y") == label).select("text").mapInPandas(_each(shared, known, among, _counts), "feature string, n long")
        return {r["feature"]: r["n"] for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    toxic = counted(1, None, 3)
    return toxic, Counter(toxic) + Counter(counted(0, frozenset(toxic), 1))


def fit(sample: DataFrame, lm: np.ndarray) -> dict:
    """Weights of a ridge logistic model over the features that toxic texts have in surplus,
    from the bounded table ``sample`` (doc_id, text, y).  Its texts are decoded in parallel;
    only counts and indices of features reach the driver.

    The words that mark toxic texts are learned first, by a decoder that knows none; then
    all is counted again with the decoder that knows them, which is the one that scores.
    """
    spark = sample.sparkSession
    n0, n1 = (sample.where(F.col("y") == v).count() for v in (0, 1))
    if not n1 or not n0:
        return {"weights": {}, "lexicon": frozenset(), "b": float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else -3.0}
    sample = sample.repartition(spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(lm)
    toxic, seen = _counted(sample, shared, frozenset())
    known = frozenset(f for f in toxic if f[-1] != "~" and _least(toxic[f], seen[f]) >= 0.5)
    toxic, seen = _counted(sample, shared, known)

    def surplus(f: str) -> float:
        """Standard errors by which toxic texts have the feature more often than all."""
        share = n1 / (n0 + n1)
        return (toxic[f] - seen[f] * share) / np.sqrt(seen[f] * share * (1 - share))

    names = sorted((f for f in toxic if surplus(f) > SURPLUS), key=lambda f: (-surplus(f), f))[:FEATURES]
    index = {f: k for k, f in enumerate(names)}
    held = sorted(map(tuple, sample.mapInPandas(_each(shared, known, index, _indices), f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, at array<int>").collect()))
    y = np.array([v for _, v, _ in held], dtype=float)
    rows = np.array([i for i, (_, _, at) in enumerate(held) for _ in at], dtype=np.int64)
    cols = np.array([k for _, _, at in held for k in at], dtype=np.int64)
    w, b = np.zeros(len(names)), float(np.log(n1 / n0))
    step_w, step_b = np.full(len(names), 1e-6), 1e-6  # AdaGrad: rare features move as far
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(y)) + b, -30, 30)))
        e = p - y
        g = np.bincount(cols, e[rows], len(names)) + RIDGE * w
        step_w += g * g
        w -= 0.5 * g / np.sqrt(step_w)
        gb = e.sum()
        step_b += gb * gb
        b -= 0.5 * gb / np.sqrt(step_b)
    return {"weights": {f: (float(v), _least(toxic[f], seen[f])) for f, v in zip(names, w)}, "lexicon": known, "b": b}


def score(found: set[str], model: dict) -> float:
    """The score of a text with these features."""
    got = [model["weights"][f] for f in sorted(found)]
    # One feature alone may decide, where all that have it leave little doubt.
    return max([sigmoid(sum(w for w, _ in got) + model["b"]), *(least for _, least in got if least >= ALONE)])


_held: dict[int, Marks] = {}


def _scorer(shared):
    def run(text: pd.Series) -> pd.Series:
        model = shared.value["model"]
        if shared.id not in _held:
            _held.clear()
            _held[shared.id] = Marks(Decoder(shared.value["lm"], model["lexicon"]), model["weights"])
        marks = _held[shared.id]
        return pd.Series([score(marks.of(t or ""), model) for t in text], dtype=float)

    return run


class _Shared:
    """A broadcast model with a name for the workers' memory."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; ``learn`` says of which ids labels may be
    learned.

    Only texts are inputs of a score; null and empty texts get the score of no words.  Texts
    of any length are read whole, in time that grows with their length.  Equal texts have
    equal scores: repeated rows are scored each, and a null doc_id is kept.  Of labels that
    repeat an id the larger counts, of texts that do the smallest.  Without labels of both
    kinds every text gets the base rate.  An empty table gives no rows.  Other columns of
    ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        lm = language_model(docs)
        model = fit(labelled_rows(docs, labels, "toxic", learn, TRAIN_ROWS, TRAIN_BYTES), lm)
        shared = _Shared(spark.sparkContext.broadcast({"lm": lm, "model": model}))
        return cut(docs.select("doc_id", F.pandas_udf(_scorer(shared), "double")("text").alias("score")), "toxicity-scores")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
