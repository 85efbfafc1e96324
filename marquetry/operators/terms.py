"""Words of texts as Arrow arrays: found and counted inside the rows that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time, or one text.
PART = 8 << 20
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", *, size: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of some ``size`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        bounds = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(batch)]
        yield from (batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


def text_words(texts: pa.Array, *, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, offsets, data)``: the words of lower-cased texts, as ``functions.text.words``
    finds them, of at least ``least`` letters, in order; null texts have none.

    Word ``i`` of row ``row[i]`` is ``data[offsets[i] : offsets[i + 1]]``. A word's letters are
    single bytes that no other character of UTF-8 holds, so bytes are looked at.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A word ends where its text does.
    begins, stops = ends[:-1][np.diff(ends) > 0], ends[1:][np.diff(ends) > 0] - 1
    first[begins], last[stops] = inside[begins], inside[stops]
    at, size = np.flatnonzero(first), np.flatnonzero(last)
    size = size - at + 1
    short = size < least
    if short.any():
        for j in range(least - 1):
            inside[(at + j)[short & (size > j)]] = False
        at, size = at[~short], size[~short]
    return np.searchsorted(ends, at, side="right") - 1, np.concatenate([[0], np.cumsum(size)]), data[inside]


def _named(offsets: np.ndarray, data: np.ndarray) -> pa.DictionaryArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()


def term_counts(texts: pa.Array, *, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``(row, code, tf, names)``: how often each row has the word ``names[code]``."""
    row, offsets, data = text_words(texts, least=least)
    found = _named(offsets, data)
    names = found.dictionary
    key, tf = np.unique(row * max(len(names), 1) + found.indices.to_numpy(), return_counts=True)
    return key // max(len(names), 1), key % max(len(names), 1), tf, names


def distinct_grams(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, words)`` of lower-cased texts: each row's distinct word ``k``-grams, exactly
    told apart, with their hash (see ``murmur3``); ``words`` are the distinct words of each row."""
    row, offsets, data = text_words(texts)
    n, sizes = len(row), np.diff(offsets)
    word = _named(offsets, data).indices.to_numpy().astype(np.int64)
    kinds = int(word.max(initial=0)) + 1
    words = np.bincount(np.unique(row * kinds + word) // kinds, minlength=len(texts))
    # A space after each word: then a gram is a slice.
    spaced = np.full(len(data) + n, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
    begin = offsets[:-1] + np.arange(n)
    whole = np.flatnonzero(row[: max(n - k + 1, 0)] == row[k - 1 :])
    code, first = np.zeros(len(whole), np.int64), np.zeros(0, np.int64)
    for j in range(k):
        _, first, code = np.unique(code * kinds + word[whole + j], return_index=True, return_inverse=True)
    at = whole[first]
    hashes = murmur3(spaced, begin[at], begin[at + k - 1] + sizes[at + k - 1] - begin[at])
    key = np.unique(row[whole] * max(len(first), 1) + code)
    return key // max(len(first), 1), hashes[key % max(len(first), 1)], words


_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
#: The seed of theta sketches, and the hash of it that they hold.
SEED, SEED_HASH = 9001, 0x93CC


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def murmur3(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first half of MurmurHash3 (x64, 128 bits, seed ``SEED``) of slices of ``data``."""
    order = np.argsort(-(size // 16), kind="stable")
    start, size = start[order], size[order]
    blocks = size // 16
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    span = np.arange(16)
    h1 = np.full(len(start), SEED, np.uint64)
    h2 = h1.copy()
    for b in range(int(blocks[0]) if len(blocks) else 0):
        m = int(np.searchsorted(-blocks, -b, side="left"))  # slices that have this block
        both = padded[start[:m, None] + (16 * b + span)].view("<u8")
        x, y = h1[:m], h2[:m]
        x = (_rotl(x ^ (_rotl(both[:, 0] * _C1, 31) * _C2), 27) + y) * np.uint64(5) + np.uint64(0x52DCE729)
        h2[:m] = (_rotl(y ^ (_rotl(both[:, 1] * _C2, 33) * _C1), 31) + x) * np.uint64(5) + np.uint64(0x38495AB5)
        h1[:m] = x
    rest = padded[(start + 16 * blocks)[:, None] + span]
    rest[span >= (size % 16)[:, None]] = 0
    both = rest.view("<u8")
    total = size.astype(np.uint64)
    h1 = h1 ^ (_rotl(both[:, 0] * _C1, 31) * _C2) ^ total
    h2 = h2 ^ (_rotl(both[:, 1] * _C2, 33) * _C1) ^ total
    h1 = h1 + h2
    h2 = h2 + h1
    out = np.empty_like(h1)
    out[order] = _final(h1) + _final(h2)
    return out


def theta_sketches(row: np.ndarray, hashes: np.ndarray, rows: int, lg_k: int) -> pa.Array:
    """A compact theta sketch, as Spark's functions read it, of each row's hashes: all of them,
    or the least ``2 ** lg_k`` and the next as theta; empty for rows without one."""
    most, hashes = 1 << lg_k, hashes >> np.uint64(1)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = hashes > 0
    keep[1:] &= (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[keep], hashes[keep]
    n = np.bincount(row, minlength=rows)
    held = np.minimum(n, most)
    ahead = np.where(n > most, 3, np.where(n > 1, 2, 1))
    ends = np.concatenate([[0], np.cumsum(ahead + held)])
    begin, rank = ends[:-1], np.arange(len(row)) - (np.cumsum(n) - n)[row]
    out = np.zeros(ends[-1], "<u8")
    # Read only, compact and ordered; 4 says that there is nothing, 32 that there is one hash.
    flags = np.where(n == 0, 0x0E, np.where(n == 1, 0x3A, 0x1A)).astype(np.uint64)
    out[begin] = ahead.astype(np.uint64) | np.uint64(0x030300) | (flags << np.uint64(40)) | np.uint64(SEED_HASH << 48)
    some = n > 1
    out[begin[some] + 1] = held[some].astype(np.uint64) | np.uint64(0x3F800000 << 32)
    next_ = rank == most
    out[begin[row[next_]] + 2] = hashes[next_]
    inner = rank < most
    out[(begin + ahead)[row[inner]] + rank[inner]] = hashes[inner]
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(out)])
