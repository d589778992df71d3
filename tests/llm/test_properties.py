"""Properties of the parts that run inside tasks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rowcraft.llm import bitslice, differencing, html_extract, spotsigs
from rowcraft.llm.simhash import fingerprint


def connected(group):
    """Least connected fingerprint of each that has a smaller one."""
    root = list(range(len(group)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(group)):
        for j in range(i):
            if (int(group[i]) ^ int(group[j])).bit_count() <= bitslice.RADIUS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {int(g): int(group[find(i)]) for i, g in enumerate(group) if find(i) != i}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), min_size=1, max_size=90, unique=True), min_size=1, max_size=5))
def test_bit_sliced_links(groups):
    made = [np.array(sorted(g), dtype=np.uint64) for g in groups]
    for wide in (4096, 2):
        for g in made:
            before, bitslice.WIDE = bitslice.WIDE, wide
            try:
                u, v = bitslice.links(g, np.array([len(g)]))
            finally:
                bitslice.WIDE = before
            assert dict(zip(u.tolist(), v.tolist(), strict=True)) == connected(g)
    u, _ = bitslice.links(np.concatenate(made), np.array([len(g) for g in made]))
    assert len(u) == sum(len(connected(g)) for g in made)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=4), st.integers(1, 4), st.integers(1, 120), st.integers(0, 99))
def test_pairs_within_any_radius(sizes, width, radius, seed):
    pick = np.random.default_rng(seed)
    centre = pick.integers(0, 2**64, width, dtype=np.uint64)
    words = np.stack([centre ^ np.bitwise_and.reduce(pick.integers(0, 2**64, (pick.integers(1, 6), width), dtype=np.uint64)) for _ in range(sum(sizes))])
    got = {(a, b) for u, v in bitslice.pairs(words, np.array(sizes), radius) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    whole = [sum(int(x) << (64 * k) for k, x in enumerate(w)) for w in words]
    group = np.repeat(np.arange(len(sizes)), sizes)
    assert got == {(a, b) for b in range(len(whole)) for a in range(b) if group[a] == group[b] and (whole[a] ^ whole[b]).bit_count() <= radius}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=120))
def test_windows_hold_every_piece_once(sizes):
    found = differencing.windows(sizes, 2048)
    assert sorted(p for m in found for p in m) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in m) <= 2048 for m in found)
    assert len(found) >= -(-sum(sizes) // 2048)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_whole_texts_of_any_kind(text):
    made = spotsigs.signatures(text)
    assert len(made) and spotsigs.likeness(made, made) == 1.0
    assert fingerprint(text.encode("utf-8", "replace")) == fingerprint(text.encode("utf-8", "replace"))
    out = html_extract.extract(text)
    assert out == "\n".join(line for line in out.split("\n") if line.strip() == line)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.lists(st.integers(0, 50), max_size=60), st.floats(0, 1))
def test_pruned_likeness(a, b, least):
    x, y = (np.unique(np.array([1000, *v], dtype=np.uint32)) for v in (a, b))
    true = len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()})
    got = spotsigs.likeness(x, y, least)
    assert got == true or (got == 0.0 and true < least)
