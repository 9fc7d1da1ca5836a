"""Sets of word shingles as sorted arrays of 64-bit hashes, and what the similarity join derives from a set."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

SHINGLE = 5
BINS = 128
_U = np.uint64


class _WordHashes(dict):
    """Hash of each word; emptied when large, so that a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def word_hashes(words: list[bytes]) -> Iterator[int]:
    return map(_HASHES.__getitem__, words)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; a shorter text is one window, a blank one has none.

    ``bytes.split`` parts words at exactly the six ASCII white space characters.
    """
    words = text.split()
    if not words:
        return np.empty(0, _U)
    codes = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    n = max(1, len(codes) - size + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, min(len(codes), size), _U)
        for k in range(min(size, len(codes))):
            total = mix(total * _U(0x9E3779B97F4A7C15) + codes[k:k + n])
    return np.unique(total)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def sketch(shingles: np.ndarray) -> bytes:
    """One half-byte for each of 128 parts of the hash range: drawn from the smallest shingle there, 0 where none is."""
    edges = np.arange(BINS, dtype=_U) << _U(57)
    first = np.searchsorted(shingles, edges)
    filled = np.append(first[1:], len(shingles)) > first
    codes = np.zeros(BINS, np.uint8)
    codes[filled] = (mix(shingles[first[filled]]) % _U(15)).astype(np.uint8) + 1
    return (codes[::2] | (codes[1::2] << 4)).tobytes()


def _zeros(x: np.ndarray) -> np.ndarray:
    """How many half-bytes of each row are 0."""
    return ((x & 15) == 0).sum(-1, dtype=np.int32) + ((x >> 4) == 0).sum(-1, dtype=np.int32)


def sketches_allow(a: np.ndarray, b: np.ndarray, threshold: float, deviations: float = 4.5) -> np.ndarray:
    """Whether rows of sketches (uint8) agree as much as a similarity of ``threshold`` lets expect, less so many standard
    deviations. Parts that are empty in both sets say nothing."""
    neither = _zeros(a | b)
    told = BINS - neither
    least = threshold * told - deviations * np.sqrt(threshold * (1 - threshold) * told)
    return _zeros(a ^ b) - neither >= least


def coordinate_paths(shingles: np.ndarray, width: int, keys: int, seed: int) -> np.ndarray:
    """``keys`` paths, each through ``width`` coordinates, as int64 hashes. Every coordinate is a MinHash of the whole set by
    a salt of its own, so the paths of a pair are independent however small the sets are."""
    salts = _path_salts(width, keys, seed)
    least = np.full(len(salts), ~_U(0))
    with np.errstate(over="ignore"):
        step = max(1, (1 << 18) // len(salts))
        for start in range(0, len(shingles), step):
            least = np.minimum(least, mix(shingles[start:start + step, None] ^ salts[None, :]).min(0))
        values = least.reshape(keys, width)
        path = np.arange(keys, dtype=_U) + _U(seed + width)
        for k in range(width):
            path = mix(path * _U(0x9E3779B97F4A7C15) + values[:, k])
    return path.view(np.int64)


@functools.cache
def _path_salts(width: int, keys: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + width).integers(1, 2**63 - 1, width * keys).astype(_U)


def chosen(shingles: np.ndarray, per_set: float, salts: Sequence[int]) -> list[np.ndarray]:
    """For each salt the shingles whose salted hash is below ``per_set / size``, as salted hashes (int64).

    Sets that share a shingle and have about the same size choose it together. A set no larger than ``per_set`` chooses
    all its shingles.
    """
    salted = np.array(salts, _U)[:, None]
    limit = _U(min(2**64 - 1, int(per_set / max(1, len(shingles)) * 2**64)))
    found: list[list[np.ndarray]] = [[] for _ in salts]
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 4096):
            g = mix(shingles[None, start:start + 4096] ^ salted)
            row, col = np.nonzero(g <= limit)
            values, cuts = g[row, col], np.searchsorted(row, np.arange(len(salts) + 1))
            for k in range(len(salts)):
                if cuts[k + 1] > cuts[k]:
                    found[k].append(values[cuts[k]:cuts[k + 1]])
    empty = np.empty(0, np.int64)
    return [np.concatenate(x).view(np.int64) if x else empty for x in found]


def all_similar(values: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets, given one after the other, have a Jaccard similarity of ``threshold`` or more (bool matrix).

    Only shingles that at least two of the sets hold are laid out, a slice of them at a time, so memory is bounded by the
    number of sets and by what they hold.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    shared = held > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sizes), 4096), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    common = common.astype(np.float64)
    near = common / (sizes[:, None] + sizes[None, :] - common) >= threshold
    np.fill_diagonal(near, False)
    return near


def spread(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each set reaches over the relation ``near``."""
    labels = ids.copy()
    while True:
        reach = np.where(near, labels[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        new = np.minimum(labels, reach)
        if (new == labels).all():
            return labels
        labels = new
