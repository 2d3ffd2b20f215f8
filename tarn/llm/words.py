"""Words of whole texts: their places, 64-bit hashes of words and of runs of words, and the real shingles.

A word is `[^\\x20\\x09-\\x0D]+`: white space is the six ASCII characters, which are single bytes in UTF-8, so the
work is done on bytes. A word's hash mixes its bytes eight at a time, each step non-linear in the ones before; words of
over `SHORT` bytes are hashed by BLAKE2. Hashes only propose (minimizers, MinHash values, counts of common shingles);
what links or removes anything compares the words themselves or a 128-bit BLAKE2 digest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import U64, mixed, text_buffers

SHORT = 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(SHORT + 1)], U64)
_ODD, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def word_places(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, byte starts and ends of the words, word offsets of the texts."""
    raw, offsets = text_buffers(column)
    if lower:
        raw = _LOWER[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~_SPACE[raw]
    step = word[1:-1] & ~word[:-2]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    step[inner] |= word[1:-1][inner]
    starts = np.flatnonzero(step)
    step = word[1:-1] & ~word[2:]
    stop = offsets[1:][offsets[1:] > 0] - 1
    step[stop] |= word[1:-1][stop]
    ends = np.flatnonzero(step) + 1
    return raw, offsets, starts, ends, np.searchsorted(starts, offsets, "left")


def hashes_at(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word."""
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", wide, strides=(1,))
    size = ends - starts
    h = mixed(size.astype(U64) * _ODD + _STEP)
    rows, at = np.arange(len(starts)), 0
    while len(rows) and at < SHORT:
        left = np.minimum(size[rows] - at, SHORT)
        h[rows] = mixed((h[rows] ^ (eight[starts[rows] + at] & _MASK[left])) * _ODD + _STEP)
        at += 8
        rows = rows[left > 8]
    for k in np.flatnonzero(size > SHORT).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the n + 1 word offsets of the texts."""
    raw, _, starts, ends, offs = word_places(column, lower)
    return hashes_at(raw, starts, ends), offs


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of a run from those of its two parts."""
    return mixed(mixed(x * _ODD + _STEP) + y)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each start; crosses text ends."""
    n = max(0, len(h) - k + 1)
    out, done, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power[:n] if out is None else joined(out, power[done : done + n])
            done += size
        if done == k:
            return out
        power, size = joined(power[: len(power) - size], power[size:]), 2 * size


def single_spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends: a run of words is one slice."""
    size = ends - starts
    stop = np.cumsum(size + 1) - 1
    out = np.full(int(stop[-1]) + 1 if len(stop) else 0, 32, np.uint8)
    here = np.ones(len(out), bool)
    here[stop] = False
    change = np.zeros(len(raw) + 1, np.int8)
    change[starts] = 1
    np.add.at(change, ends, -1)  # a word may begin where the text before ends with one
    out[here] = raw[np.cumsum(change[:-1], dtype=np.int8) > 0]
    return out.tobytes(), stop - size, stop


def shingle_texts(column: pa.Array, k: int) -> Iterator[set[bytes]]:
    """For each text the set of its distinct k-word shingles, ASCII lower case; a text of fewer words has one shingle."""
    raw, _, starts, ends, offs = word_places(column, lower=True)
    line, first, last = single_spaced(raw, starts, ends)
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if hi == lo:
            yield set()
            continue
        n = max(1, hi - lo - k + 1)
        yield {line[a:b] for a, b in zip(first[lo : lo + n].tolist(), last[min(lo + k, hi) - 1 : hi].tolist())}


def digest128(parts: list[bytes]) -> np.ndarray:
    """(n, 2) uint64: BLAKE2 digests."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<u8").reshape(-1, 2)
