"""Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from itertools import count


def difference(sizes: list[int], ways: int) -> list[tuple[int, list[int]]]:
    """Split positions of ``sizes`` into ``ways`` sets of near-equal sums.

    A partial partition is a list of (sum, members), largest sum first; sets
    that are still empty are left out. The two partial partitions with the
    largest spread are merged so that the large sums of one meet the small sums
    of the other, until one is left. Members are nested pairs until the end, so
    that a merge does not copy them.
    """
    if not sizes:
        return []
    order = count()  # ties: first come, first served
    heap = [(-size, next(order), [(size, at)]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - ways
        if over > 0:  # the small ends overlap: smallest of a with largest of b's part
            pairs = zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)
            merged = a[: len(a) - over] + b[: len(b) - over] + [(x + y, (m, n)) for (x, m), (y, n) in pairs]
        else:
            merged = a + b
        merged.sort(key=_sum, reverse=True)
        least = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (least - merged[0][0], next(order), merged))
    return [(total, _flat(members)) for total, members in heap[0][2]]


def _sum(entry: tuple) -> int:
    return entry[0]


def _flat(members) -> list[int]:
    out, stack = [], [members]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += top
        else:
            out.append(top)
    return sorted(out)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by window; no window's sum exceeds ``capacity``.

    The window count starts at the least possible and rises as long as
    differencing leaves a window above capacity. With a window for each piece
    it always fits, as no piece is larger than the capacity.
    """
    ways = -(-sum(sizes) // capacity)
    while sizes:
        parts = difference(sizes, ways)
        if max(total for total, _ in parts) <= capacity:
            return [members for _, members in parts]
        ways += 1
    return []
