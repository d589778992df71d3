"""Hamming neighbours within groups of fingerprints, bit-sliced.

Fingerprints are rows of 64-bit words and are stored vertically: each group is
padded to blocks of 64 lanes, and word b of a block holds bit b of its 64
fingerprints. A query is compared with a whole block at a time. Planes are
XORed with the query's bits and added to bitwise counters, two at a time with a
carry-save adder. Counters start so that the radius is the last value before
they overflow; an overflow latches. A (query, block) pair is abandoned once
every lane has latched, which for unrelated fingerprints happens early.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

RADIUS = 2
_LANES = 64
_STRIDE = 8  # planes between two looks at what can be abandoned
_CHUNK = 1 << 15  # (query, block) pairs held at once
_ALL, _NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)

#: Groups above this size are cut again by the bits that vary in them. Only the
#: work depends on it; the links are the same.
WIDE = 4096
_PARTS = 4


def _transpose(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (bits, blocks), lanes in use by block, first block by group."""
    blocks = -(-sizes // _LANES)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    lane = np.arange(len(words)) - np.repeat(first, sizes) + np.repeat(first_block, sizes) * _LANES
    padded = np.zeros((int(blocks.sum()) * _LANES, words.shape[1]), dtype=np.uint64)
    padded[lane] = words
    used = np.zeros(len(padded), dtype=np.uint8)
    used[lane] = 1
    packed = lambda bits: np.packbits(bits, bitorder="little").view("<u8")
    planes = [packed(((padded[:, w] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for w in range(words.shape[1]) for b in range(64)]
    return np.stack(planes), packed(used), first_block


def _matches(planes: np.ndarray, used: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs with a lane within the radius, and those lanes."""
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    alive = np.arange(len(queries))
    over = ~used[blocks]
    count = [np.full(len(queries), _ALL if start >> k & 1 else _NONE) for k in range(width)]
    differ = lambda b: planes[b][blocks] ^ -((queries[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
    for b in range(0, len(planes), 2):
        x, y = differ(b), differ(b + 1)
        either = x ^ y
        carry = (x & y) | (either & count[0])  # two planes and the lowest counter
        count[0] = count[0] ^ either
        for k in range(1, width):
            up = count[k] & carry
            count[k] = count[k] ^ carry
            carry = up
        over |= carry
        if b % _STRIDE == _STRIDE - 2:
            keep = over != _ALL
            if not keep.all():
                alive, over, queries, blocks = alive[keep], over[keep], queries[keep], blocks[keep]
                count = [c[keep] for c in count]
            if not len(alive):
                break
    return alive, ~over


def pairs(words: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (one, later one) of a group's members within the radius, in chunks.

    ``words`` has a row of 64-bit words for each fingerprint; groups lie one
    after another, ``sizes`` long.
    """
    if not len(words):
        return
    planes, used, first_block = _transpose(words, sizes)
    blocks = -(-sizes // _LANES)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    # A query meets the blocks from its own on; earlier ones have met it.
    own = (np.arange(len(words)) - base[group_of]) // _LANES
    per_query = blocks[group_of] - own
    starts = np.concatenate(([0], np.cumsum(per_query)))
    low = 0
    while low < len(words):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + _CHUNK, "right")) - 1)
        query = np.repeat(np.arange(low, high), per_query[low:high])
        block = first_block[group_of[query]] + own[query] + np.arange(len(query)) - np.repeat(starts[low:high] - starts[low], per_query[low:high])
        at, lanes = _matches(planes, used, words[query], block, radius)
        pair, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        q = query[at[pair]]
        other = base[group_of[q]] + (block[at[pair]] - first_block[group_of[q]]) * _LANES + lane
        later = other > q
        yield q[later], other[later]
        low = high


def _cut(group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``pairs`` of one large group of 64-bit fingerprints.

    The bits that vary are dealt to parts; two fingerprints within the radius
    agree in all parts but ``radius`` of them, so each choice of the others
    cuts the group into smaller ones that lose no pair.
    """
    varied = int(np.bitwise_or.reduce(group ^ group[0]))
    bits = [1 << b for b in range(64) if varied >> b & 1]
    parts = [sum(bits[k::_PARTS]) for k in range(_PARTS)]
    for chosen in combinations(parts, _PARTS - radius):
        key = group & np.uint64(sum(chosen))
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.diff(key[order])) + 1
        sizes = np.diff(np.concatenate(([0], ends, [len(group)])))
        for u, v in pairs(group[order, None], sizes, radius):
            yield order[u], order[v]


def roots(words: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least position it is connected with."""
    found = np.arange(len(words))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    wide = (sizes > WIDE) & (words.shape[1] == 1) & (radius < _PARTS)
    for at in np.flatnonzero(wide):
        group = slice(first[at], first[at] + sizes[at])
        for u, v in _cut(words[group, 0], radius):
            found = _joined(found, u + first[at], v + first[at])
    rest = np.flatnonzero(np.repeat(~wide & (sizes > 1), sizes))
    for u, v in pairs(words[rest], sizes[~wide & (sizes > 1)], radius):
        found = _joined(found, rest[u], rest[v])
    return found


def links(fingerprints: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least fingerprint it is connected with) by group.

    ``fingerprints`` are distinct within a group and ascend. Every group's links
    within the radius are kept up to connectedness: fewer edges than
    fingerprints come out.
    """
    least = fingerprints[roots(fingerprints[:, None], sizes, radius)]
    other = least != fingerprints
    return fingerprints[other], least[other]


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least connected positions after more edges (hook and compress)."""
    u, v = u[root[u] != root[v]], v[root[u] != root[v]]
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root
