"""Byte pair merges of very many short pieces at once, by array operations.

All pieces stand in one flat array of symbols. A round finds each piece's pair of lowest
rank (the leftmost of equal ones), joins it, and looks up the ranks of the two pairs it
touches; pieces without a pair that merges are done. This is the textbook order of merges
piece by piece, so the ids are those of a tokenizer that merges one piece at a time.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, joined symbol); open addressing in three arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        self.joined = np.zeros(1 << bits, np.int32)
        self.probes = 0
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.ranks[at] == _NONE
            slots, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            who = rest[placed]
            self.keys[slots], self.ranks[slots], self.joined[slots] = keys[who], who, joined[who]
            left_over = np.ones(len(rest), bool)
            left_over[placed] = False
            rest, at = rest[left_over], (at[left_over] + 1) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each pair, and its rank (a largest number where there is none)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(keys)
        ranks = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((ranks == _NONE) & (self.ranks[at] != _NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            ranks[open_[hit]] = self.ranks[here[hit]]
            open_ = open_[~hit & (self.ranks[here] != _NONE)]
        return at, ranks


def merge_all(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Flat symbols of pieces of ``sizes`` (1 at least) -> flat ids and how many each has."""
    n = len(sizes)
    out_sizes = np.zeros(n, np.int64)
    done_pieces, done_symbols = [], []
    piece = np.arange(n)  # those still open
    sym = symbols.astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
    joined = np.zeros(len(sym), np.int32)
    inner = np.ones(len(sym), bool)
    inner[starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    slot, rank[at] = table.slots(sym[at], sym[at + 1])
    joined[at] = table.joined[slot]
    while len(piece):
        best = np.minimum.reduceat(rank, starts)
        more = best != _NONE
        if not more.all():
            keep = np.repeat(more, sizes)
            done_pieces.append(piece[~more])
            done_symbols.append(sym[~keep])
            out_sizes[piece[~more]] = sizes[~more]
            piece, sizes, best = piece[more], sizes[more], best[more]
            sym, rank, joined = sym[keep], rank[keep], joined[keep]
            if not len(piece):
                break
            starts = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(rank == np.repeat(best, sizes))
        owner = np.searchsorted(starts, hits, side="right")
        hits = hits[np.concatenate([[True], owner[1:] != owner[:-1]])]  # one a piece, the leftmost
        sym[hits] = joined[hits]
        rank[hits] = rank[hits + 1]  # marks the piece's last pair as none; the others are looked up below
        keep = np.ones(len(sym), bool)
        keep[hits + 1] = False
        last = hits + 1 == starts + sizes - 1
        sym, rank, joined = sym[keep], rank[keep], joined[keep]
        here = hits - np.arange(len(hits))  # each earlier hit took one symbol away
        sizes = sizes - 1
        starts = np.cumsum(sizes) - sizes
        after, before = here[~last], here[here > starts] - 1
        for at in (after, before):
            slot, found = table.slots(sym[at], sym[at + 1])
            rank[at], joined[at] = found, table.joined[slot]
        rank[here[last]] = _NONE
    order = np.concatenate(done_pieces) if done_pieces else np.zeros(0, np.int64)
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int32)
    # Pieces were done in another order than they came in.
    had = out_sizes[order]
    begins = np.zeros(n, np.int64)
    begins[order] = np.cumsum(had) - had
    return gather(flat, begins, out_sizes), out_sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
