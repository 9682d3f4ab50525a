"""BLAKE3 from its published specification, over many chunks at once with numpy.

The digest is a binary tree over chunks of a KiB, so a file's ranges can be read by different
tasks: a range of a power of two of chunks, aligned to its length, is a whole subtree, whose
value (:meth:`Hasher.value`) is all that the rest of the tree needs (:func:`merge`).
"""

from __future__ import annotations

import numpy as np

# Fixed values of the specification: initial words, message permutation, flags.
IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Blocks mixed at once, about 90 MB a second on one core; fewer cost more calls, and memory is 128 bytes a block.
TILE = 8192
_U = np.uint32


def _mix(v: np.ndarray, x: np.ndarray, y: np.ndarray, spare: np.ndarray) -> None:
    """One half round of a state (4, 4, n), its four columns side by side."""
    a, b, c, d = v

    def turned(z: np.ndarray, by: np.ndarray, right: int) -> None:
        z ^= by
        np.left_shift(z, _U(32 - right), out=spare)
        z >>= _U(right)
        z |= spare

    for m, r, s in ((x, 16, 12), (y, 8, 7)):
        a += b
        a += m
        turned(d, a, r)
        c += d
        turned(b, c, s)


def _tile(h: np.ndarray, words: np.ndarray, tail: np.ndarray) -> np.ndarray:
    n = words.shape[1]
    v = np.concatenate([h, _start(n)[:4], tail]).reshape(4, 4, n)
    spare, order = np.empty((4, n), dtype=_U), np.arange(16)
    for _ in range(7):
        _mix(v, words[order[0:8:2]], words[order[1:8:2]], spare)
        for row in (1, 2, 3):  # diagonals become columns, and columns again
            v[row] = np.roll(v[row], -row, axis=0)
        _mix(v, words[order[8::2]], words[order[9::2]], spare)
        for row in (1, 2, 3):
            v[row] = np.roll(v[row], row, axis=0)
        order = order[PERMUTATION]
    v = v.reshape(16, n)
    return v[:8] ^ v[8:]


def _compress(h: np.ndarray, words: np.ndarray, counter: np.ndarray, length: int, flags: int) -> np.ndarray:
    """Chaining values (8, n) after one block (16, n) each."""
    n = words.shape[1]
    tail = np.empty((4, n), dtype=_U)
    tail[0], tail[1] = (counter & 0xFFFFFFFF).astype(_U), (counter >> 32).astype(_U)
    tail[2], tail[3] = length, flags
    if n <= TILE:
        return _tile(h, words, tail)
    return np.concatenate([_tile(h[:, i : i + TILE], words[:, i : i + TILE], tail[:, i : i + TILE]) for i in range(0, n, TILE)], axis=1)


def _start(n: int) -> np.ndarray:
    return np.repeat(np.array(IV, dtype=_U)[:, None], n, axis=1)


def _words(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4").astype(_U).reshape(n, -1).T


def _level(values: np.ndarray, root: bool) -> np.ndarray:
    """The top of a tree over chaining values (8, n); an odd one waits for a later level."""
    zero = lambda n: np.zeros(n, dtype=np.int64)
    while values.shape[1] > 1:
        n = values.shape[1]
        even = n - n % 2
        pairs = np.concatenate([values[:, 0:even:2], values[:, 1:even:2]])
        top = _compress(_start(n // 2), pairs, zero(n // 2), BLOCK, PARENT | (ROOT if root and n == 2 else 0))
        values = np.concatenate([top, values[:, even:]], axis=1)
    return values


def _bytes(value: np.ndarray) -> bytes:
    return value[:, 0].astype("<u4").tobytes()


def merge(values: list[bytes], root: bool) -> bytes:
    """The value of two or more neighbouring subtrees, all but the last of one size, a power of
    two of chunks; with ``root`` the digest."""
    return _bytes(_level(np.stack([np.frombuffer(v, dtype="<u4").astype(_U) for v in values], axis=1), root))


class Hasher:
    """Incremental digest; keeps one chaining value for each chunk read (32 bytes a KiB).
    ``first`` is the number of chunks before, where a range of a file is read."""

    def __init__(self, first: int = 0):
        self.rest, self.first, self.chunks, self.values = b"", first, first, []

    def update(self, data: bytes) -> None:
        data = self.rest + data
        full = max(0, (len(data) - 1) // CHUNK)  # the last chunk may be the root: it waits
        if full:
            self.values.append(self._full(data[: full * CHUNK], full))
        self.rest = data[full * CHUNK :]

    def _full(self, data: bytes, n: int) -> np.ndarray:
        words = np.ascontiguousarray(_words(data, n)).reshape(16, 16, n)
        h, counter = _start(n), np.arange(self.chunks, self.chunks + n, dtype=np.int64)
        for b in range(16):
            h = _compress(h, words[b], counter, BLOCK, (CHUNK_START if b == 0 else 0) | (CHUNK_END if b == 15 else 0))
        self.chunks += n
        return h

    def _top(self, root: bool) -> bytes:
        blocks = [self.rest[i : i + BLOCK] for i in range(0, len(self.rest), BLOCK)] or [b""]
        alone = root and self.chunks == self.first
        h, counter = _start(1), np.array([self.chunks], dtype=np.int64)
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END if last else 0) | (ROOT if last and alone else 0)
            h = _compress(h, _words(b.ljust(BLOCK, b"\0"), 1), counter, len(b), flags)
        return _bytes(_level(np.concatenate([*self.values, h], axis=1), root))

    def value(self) -> bytes:
        """The chaining value of what was read, as a subtree below the root."""
        return self._top(False)

    def hexdigest(self) -> str:
        return self._top(True).hex()


def blake3_hex(data: bytes) -> str:
    h = Hasher()
    h.update(data)
    return h.hexdigest()
