"""Canonical, length-limited Huffman codes and bit packing over numpy arrays."""

from __future__ import annotations

import numpy as np

# No code is longer; the decoding table has 2**MOST_BITS entries at most.
MOST_BITS = 20
# A block of a payload holds this many ids; the bit at which each block starts is its checkpoint.
BLOCK_IDS = 128
_LENGTH_BITS = 6  # of a table entry; the id stands above


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Length of the code of each symbol with a count, at most ``most_bits``, 0 for the others; package-merge.

    At each level neighbours of the sorted list are packed in pairs and merged with the symbols again. The symbols among
    the first 2n - 2 entries of the last list, and so on down the packages, each add a bit.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most_bits:
        raise ValueError(f"{len(used)} symbols need codes of more than {most_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(most_bits):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(weights))
        merged = merged[by_weight][: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    taken = 2 * len(order) - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:taken].sum())
        lengths[order[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, ties by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        self.bits = int(self.lengths.max(initial=0))
        used = np.flatnonzero(self.lengths)
        self.order = used[np.argsort(self.lengths[used], kind="stable")]
        widths = np.int64(1) << (self.bits - self.lengths[self.order])
        starts = np.cumsum(widths) - widths
        self.widths = widths
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.order] = (starts >> (self.bits - self.lengths[self.order])).astype(np.uint64)

    def table(self) -> np.ndarray:
        """For each value of the next ``bits`` bits: the id and, below it, the length of its code."""
        entries = np.repeat(self.order << _LENGTH_BITS | self.lengths[self.order], self.widths)
        return np.concatenate([entries, np.zeros((1 << self.bits) - len(entries), np.int64)])


def pack(code: Code, ids: np.ndarray, ends: np.ndarray, block: int = BLOCK_IDS) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload and checkpoints of each of several sequences, laid end to end in ``ids`` with their ends in ``ends``.

    A code goes into 32-bit words, big end first, by its bit position; words are sums of disjoint parts. A payload starts
    on a word of its own and has one spare word. Checkpoints are bits from the payload's start, one each ``block`` ids.
    """
    lengths = code.lengths[ids]
    if len(ids) and not lengths.all():
        raise ValueError("an id has no code")
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)])
    words = (before[ends] - before[begins] + 31) // 32 + 1
    bases = np.cumsum(words) - words
    sizes = ends - begins
    shift = np.repeat(bases * 32 - before[begins], sizes)
    bit = before[:-1] + shift
    word, room = bit >> 5, 64 - lengths - (bit & 31)
    parts = code.codes[ids] << room.astype(np.uint64)
    total = int(words.sum()) + 1
    high = np.bincount(word, parts >> np.uint64(32), total)
    low = np.bincount(word + 1, parts & np.uint64(0xFFFFFFFF), total)
    data = (high + low).astype(np.uint32).astype(">u4")
    payloads, checkpoints = [], []
    for begin, end, base, n in zip(begins, ends, bases, words):
        payloads.append(data[base:base + n].tobytes())
        checkpoints.append(bit[begin:end:block] - base * 32)
    return payloads, checkpoints


def unpack(
    table: np.ndarray, bits: int, payloads: list[bytes], checkpoints: list[np.ndarray], counts: np.ndarray,
    block: int = BLOCK_IDS,
) -> np.ndarray:
    """The ids of several sequences, end to end. All blocks are decoded at once, one id of each at a time."""
    counts = np.asarray(counts, np.int64)
    out = np.empty(int(counts.sum()), np.uint32)
    if not len(out):
        return out
    data = np.frombuffer(b"".join(payloads) + bytes(8), ">u4").astype(np.uint64)
    pairs = data[:-1] << np.uint64(32) | data[1:]
    bases = np.cumsum([0, *map(len, payloads)])[:-1] * 8
    blocks = -(-counts // block)
    position = np.concatenate([np.asarray(c, np.int64) for c in checkpoints]) + np.repeat(bases, blocks)
    number = np.arange(len(position)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    target = np.repeat(np.cumsum(counts) - counts, blocks) + number * block
    sizes = np.minimum(np.repeat(counts, blocks) - number * block, block)
    by_size = np.argsort(-sizes, kind="stable")
    position, target, sizes = position[by_size], target[by_size], sizes[by_size]
    mask = np.uint64((1 << bits) - 1)
    for step in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        at = position[:live]
        entry = table[((pairs[at >> 5] >> (64 - bits - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)]
        out[target[:live] + step] = entry >> _LENGTH_BITS
        position[:live] += entry & ((1 << _LENGTH_BITS) - 1)
    return out
