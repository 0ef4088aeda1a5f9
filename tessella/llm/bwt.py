"""Burrows-Wheeler transforms of string shards and their merging.

Texts are read eight bytes at a time: the symbol before a suffix is the word of the
eight bytes that precede it, so one refinement extends contexts by eight bytes.

A shard keeps its suffixes in order, truncated to 64 bytes and padded with zeros, and
its column, the symbols before them. Merging never sorts suffixes again. It keeps only
the interleave, which shard comes next, first by two bytes, and refines it: read the
columns in the interleave's order, distribute the entries stably by their symbol, and
the result is the interleave by eight more bytes. Neighbours with one symbol that were
in one block stay in one block; so after the last round the blocks are the intervals of
suffixes whose common prefix has the full length, and the round that separates two
neighbours bounds their common prefix.
"""

from __future__ import annotations

import numpy as np

WORD, FIRST = 8, 2
_ROW = np.uint64(32)


def words_of(text: np.ndarray, left: np.ndarray, width: int = WORD) -> np.ndarray:
    """Big-endian words of the next ``width`` bytes; ``left`` counts a string's bytes from there."""
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    found = np.zeros(len(text), np.uint64)
    for i in range(width):
        byte = padded[i : i + len(text)].astype(np.uint64)
        if i:
            byte[left <= i] = 0
        found |= byte << np.uint64(8 * (width - 1 - i))
    return found


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys and each one's rank from 1."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([1], sorted_keys[1:] != sorted_keys[:-1])), dtype=np.uint64) if len(keys) else 0
    return order, ranks


def distribute(symbols: np.ndarray) -> np.ndarray:
    """The stable order of dense symbol ranks, by counting sixteen bits at a time: nothing is compared."""
    by = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) > 0xFFFF:
        by = by[np.argsort((symbols >> 16).astype(np.uint16)[by], kind="stable")]
    return by


class Strings:
    """Strings laid end to end, with what a suffix has left and how far in it begins."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(parts)), self.lengths)
        self.within = np.arange(len(self.text)) - self.starts[self.owner]
        self.left = self.lengths[self.owner] - self.within


class Shard:
    """Some strings' suffixes in order and the symbols before them (-1: none)."""

    def __init__(self, strings: Strings, symbols: np.ndarray, first: int, last: int):
        a = int(strings.starts[first])
        b = int(strings.starts[last - 1] + strings.lengths[last - 1])
        left = strings.left[a:b]
        ranks = symbols[a:b].astype(np.uint64) + np.uint64(1)
        depth = WORD
        order = np.arange(b - a)
        while depth < 8 * WORD:
            after = np.zeros(b - a, np.uint64)
            reach = np.flatnonzero(left > depth)
            after[reach] = ranks[reach + depth]
            order, ranks = _dense(ranks << _ROW | after)
            depth *= 2
        self.order = order + a
        before = np.where(strings.within[self.order] >= WORD, self.order - WORD, -1)
        self.column = np.where(before >= 0, symbols[before].astype(np.int64), -1)
        self.left = strings.left[self.order]


def merge_intervals(strings: Strings, shard_bytes: int, depth: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with ``depth`` bytes left, in order, and where intervals with that common prefix begin.

    ``depth`` must be FIRST more than a multiple of WORD.
    """
    if (depth - FIRST) % WORD:
        raise ValueError("the depth isn't reached by whole words")
    if not len(strings.text):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, symbols = _dense(words_of(strings.text, strings.left))
    cuts, size = [0], 0
    for i, n in enumerate(strings.lengths.tolist()):
        if size and size + n > shard_bytes:
            cuts.append(i)
            size = 0
        size += n
    shards = [Shard(strings, symbols, a, b) for a, b in zip(cuts, [*cuts[1:], len(strings.lengths)])]
    kind = np.uint8 if len(shards) < 256 else np.int32
    lefts = np.concatenate([s.left for s in shards])
    columns = np.concatenate([s.column for s in shards])
    orders = np.concatenate([s.order for s in shards])
    numbers = np.repeat(np.arange(len(shards), dtype=kind), [len(s.order) for s in shards])

    # the interleave by the first two bytes merges lists that are in order already
    alive = lefts >= FIRST
    key = words_of(strings.text, strings.left, FIRST).astype(np.uint16)[orders[alive]]
    by = np.argsort(key, kind="stable")
    interleave, key = numbers[alive][by], key[by]
    block = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])), dtype=np.int64) if len(key) else np.zeros(0, np.int64)
    column = columns[alive]
    for h in range(FIRST + WORD, depth + 1, WORD):
        # read the columns in the interleave's order
        place = np.argsort(interleave, kind="stable")
        symbol = np.empty(len(interleave), np.int64)
        symbol[place] = column
        kept = symbol >= 0
        symbol, block, interleave = symbol[kept], block[kept], interleave[kept]
        # and distribute them stably by symbol
        by = distribute(symbol)
        symbol, block, interleave = symbol[by], block[by], interleave[by]
        if len(by):
            block = np.cumsum(np.concatenate(([0], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))), dtype=np.int64)
        column = columns[lefts >= h]
    suffixes = np.empty(len(interleave), np.int64)
    suffixes[np.argsort(interleave, kind="stable")] = orders[lefts >= depth]
    fresh = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    return suffixes, fresh
