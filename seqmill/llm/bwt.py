"""Merging of shard Burrows-Wheeler transforms, and the repeated strings that fall out.

A transform lists, for suffixes in sorted order, the symbols before them. Here a symbol is eight
bytes wide, and of each shard only the suffixes are listed that windows of the wanted depth lead
to: the tails of its windows, which start as the empty string and grow by one symbol a round.
"""

from __future__ import annotations

import numpy as np

PACK = 8


class Symbols:
    """Rank of the bytes before each place of a text, for each round of a window's refinement."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        padded = np.concatenate((data, np.zeros(PACK, np.uint8)))
        whole = np.zeros(len(data), np.uint64)
        for j in range(PACK):
            whole = (whole << np.uint64(8)) | padded[j : j + len(data)]
        self.rounds: list[tuple[int, np.ndarray]] = []
        if depth % PACK:  # the tail that is no whole symbol
            self.rounds.append((depth - depth % PACK, self._ranks(whole >> np.uint64(8 * (PACK - depth % PACK)))))
        if depth >= PACK:
            ranks = self._ranks(whole)
            self.rounds += [(at, ranks) for at in range(depth - depth % PACK - PACK, -1, -PACK)]

    @staticmethod
    def _ranks(words: np.ndarray) -> np.ndarray:
        return np.unique(words, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)


def refine(order: np.ndarray, starts: np.ndarray, symbols: Symbols, known: np.ndarray, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of windows that are equal throughout: the windows in order, and which begin a block.

    ``order`` is the interleave to begin with: all windows of the first shard, then those of the
    next. Each round sorts it stably by the symbol before the present tails, so it is ordered by
    one symbol more, and neighbours part in the round that first tells them apart. A block is
    closed, and costs nothing more, when it holds one window, windows of one shard only (that
    shard's own transform has settled them), or only windows known to be repeated.
    """
    block = np.zeros(len(order), np.int64)
    first = np.zeros(min(1, len(order)), np.int64)
    low = np.uint64(0xFFFFFFFF)
    for offset, ranks in symbols.rounds:
        n = len(order)
        if n == 0:
            break
        key = ranks[starts[order] + offset] | np.arange(n, dtype=np.uint64)
        key.sort()
        by = (key & low).astype(np.int64)
        key >>= np.uint64(32)
        order, block = order[by], block[by]
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        open_ = (size > 1) & ~np.logical_and.reduceat(known[order], first)
        if shard is not None:
            of = shard[order]
            open_ &= np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        held = np.repeat(open_, size)
        order, size = order[held], size[open_]
        block = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
    begins = np.zeros(len(order), bool)
    begins[first[: len(order)]] = True
    return order, begins


def repeated(strings: list[bytes], depth: int, weights: np.ndarray | None = None, shard_bytes: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, first, last) of the starts of ``depth``-byte windows that are found twice or more.

    ``weights`` says how often a string is there; what is there twice repeats throughout. Shards
    are refined by themselves, then merged two by two: a merge takes one window of each kind from
    either shard, and only blocks that hold both shards stay open.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    count = np.maximum(sizes - depth + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = (np.cumsum(sizes) - sizes)[owner] + within
    known = np.zeros(len(owner), bool) if weights is None else (np.asarray(weights) > 1)[owner]
    if len(owner):
        symbols = Symbols(np.frombuffer(b"".join(strings), np.uint8), depth)
        part = ((np.cumsum(sizes) - sizes) // shard_bytes)[owner]
        shards = [np.flatnonzero(part == p) for p in np.unique(part)]

        def settled(order: np.ndarray, shard: np.ndarray | None) -> np.ndarray:
            """Marks the windows of equal blocks; the windows that add no new kind."""
            same, begins = refine(order, starts, symbols, known, shard)
            known[same] = True
            return same[~begins]

        extra = [settled(s, None) for s in shards]
        twin = np.zeros(len(owner), bool)
        for e in extra:
            twin[e] = True
        shards = [s[~twin[s]] for s in shards]
        number = np.zeros(len(owner), np.int32)
        while len(shards) > 1:
            merged = []
            for i in range(0, len(shards), 2):
                pair = shards[i : i + 2]
                if len(pair) == 2:
                    number[pair[0]], number[pair[1]] = 0, 1
                    both = np.concatenate(pair)
                    twin[settled(both, number)] = True
                    pair = [both[~twin[both]]]
                merged += pair
            shards = merged
    found = np.flatnonzero(known)
    run = np.ones(len(found), bool)
    run[1:] = (np.diff(found) != 1) | (owner[found[1:]] != owner[found[:-1]])
    a = np.flatnonzero(run)
    z = np.append(a[1:], len(found))[: len(a)] - 1
    return owner[found[a]], within[found[a]], within[found[z]]
