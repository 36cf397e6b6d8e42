"""Vectorised hashing of whole texts: words, word shingles and byte prefixes.

Everything works on UTF-8 bytes with 64-bit arithmetic that wraps around, so
a hash depends only on the bytes hashed and is the same on every executor.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer single word makes a longer block.
BLOCK = 1 << 20

SPACE = 32
_BLANKS = bytes([9, 10, 11, 12, 13])
LOWER = bytes.maketrans(bytes(range(65, 91)) + _BLANKS, bytes(range(97, 123)) + b" " * 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers = {BASE: np.ones(1, U), BASE_INV: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between calls."""
    have = _powers.get(base, np.ones(1, U))
    if len(have) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, 1 << 16), U(base), U)
            step[0] = U(1)
            have = np.multiply.accumulate(step)
        _powers[base] = have
    return have[:n]


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE**i * hash(data[i:j]) for byte values."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """hash(data[start:end]) for arrays of positions."""
    return (prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start]


def words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte offset of every blank-separated word of a buffer whose
    blanks are all spaces already (see ``LOWER``)."""
    hashes, starts, at, total = [], [], 0, len(buffer)
    while at < total:
        end = min(at + BLOCK, total)
        if end < total:
            cut = buffer.find(b" ", end)
            end = total if cut < 0 else cut + 1
        data = np.frombuffer(buffer, np.uint8, end - at, at)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = data != SPACE
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            prefix = prefix_hashes(data)
            hashes.append(mix(slice_hashes(prefix, first, last) + (last - first).astype(U)))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def batches(texts, most: int = 4 << 20):
    """Index ranges of consecutive texts of about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, (str, bytes)) else 0
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def text_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts (A-Z lower-cased; words are runs without
    blanks \\x20, \\x09-\\x0D) and the bounds of each text's words."""
    blobs = [utf8(t if isinstance(t, str) else None) for t in texts]
    buffer = b" ".join(blobs).translate(LOWER)
    hashes, starts = words_of(buffer)
    offset = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in blobs], out=offset[1:])
    return hashes, np.searchsorted(starts, offset)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (across text bounds too)."""
    count = max(len(hashes) - n + 1, 0)
    out = np.full(count, U(n), U)
    for k in range(n):
        out = out * U(BASE) + hashes[k : k + count]
    return mix(out)


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; a text of fewer
    words gives its whole sequence as one, a text without words none."""
    hashes, bound = text_words(texts)
    grams = ngrams(hashes, n)
    out = []
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(hashes[a:b], int(b - a)))
        else:
            out.append(np.empty(0, U))
    return out
