"""Word shingles of whole texts as hashed multisets, computed on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes of text handled at once (at least one text); arrays of 8 bytes for each of them are held meanwhile.
CHUNK = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
# An odd number, so that it has an inverse modulo 2^64, and distinct odd weights for the words of a shingle.
BASE = 0x9E3779B97F4A7C15
STEPS = np.array([pow(BASE, 2 * i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
_INVERSE, _STRIDE = pow(BASE, -1, 1 << 64), 1 << 10
# Powers 1 to _STRIDE of the inverse.
_INVERSES = np.cumprod(np.full(_STRIDE, _INVERSE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without NULLs."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets.astype(np.int64)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``size`` bytes."""
    if not len(texts):
        return
    raw, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes in a string or binary column (at least one row),
    which bounds what a worker holds at once."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        _, ends, _ = batch.column(column).buffers()
        wide = batch.column(column).type in (pa.large_string(), pa.large_binary())
        offset = batch.column(column).offset
        at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[offset : offset + batch.num_rows + 1].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = min(max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _inverse_powers(places: np.ndarray) -> np.ndarray:
    """The inverse of the base to the power of each place plus one, from two short tables."""
    rough = np.full(int(places.max(initial=0)) // _STRIDE + 1, _INVERSES[-1], dtype=np.uint64)
    rough[0] = 1
    return np.cumprod(rough)[places // _STRIDE] * _INVERSES[places % _STRIDE]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word: maximal runs of digits, letters a-z and non-ASCII bytes, A-Z lower-cased."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = LOWER[raw]
    inside = WORD[low]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~border[:-1]
    after = np.concatenate((inside[1:], [False])) & ~border[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # One array of so many numbers: powers, then terms, then their sums up to each place.
    sums = np.full(n + 1, BASE, dtype=np.uint64)
    sums[0] = 0
    np.cumprod(sums[1:], out=sums[1:])
    sums[1:] *= low + np.uint16(1)
    np.cumsum(sums, out=sums)
    hashes = mix((sums[ends] - sums[starts]) * _inverse_powers(starts) + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def multisets(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by both. A text of fewer words, but not none, is one shingle."""
    words, text = word_hashes(raw, offsets)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    per_text = np.bincount(text, minlength=len(offsets) - 1)
    place = np.arange(len(words)) - (np.cumsum(per_text) - per_text)[text]
    first = place <= np.maximum(per_text[text] - size, 0)
    at = np.flatnonzero(first)
    shingles = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    own = np.concatenate((text, np.full(size, -1)))
    for i in range(size):
        same = own[at + i] == text[at]
        shingles += np.where(same, padded[at + i] * STEPS[i], STEPS[size + i])
    shingles, doc = mix(shingles), text[at]
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])))
    where = np.flatnonzero(new)
    return doc[where], shingles[where], np.diff(np.append(where, len(doc)))
