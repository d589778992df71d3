"""Every operator against brute force, on odd rows and on none."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rowcraft.llm import components, differencing, mixing, packing, quality_rules, sharding, simhash, spotsigs, substring_dedup
from tests.llm.conftest import made

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def same_rows(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


# 1


def measured(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, none):
    got = quality_rules.judge(odd.select("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns


def test_rules_are_a_table(odd):
    strict = (quality_rules.Rule("symbol_ratio", None, 0.0), quality_rules.Rule("n_words", 60))
    got = quality_rules.judge(odd.select("doc_id", "text"), strict).collect()
    assert all(r.kept == (not r.base_failed and r.n_symbols == 0 and r.n_words >= 60) for r in got)


# 2


def test_ring_walks_clockwise():
    positions, owners = sharding.ring(4, 8)
    assert positions == sorted(positions) and Counter(owners) == {s: 8 for s in range(4)}
    assert sharding.arc_of(positions, positions[3]) == 3 and sharding.arc_of(positions, positions[-1] + 1) == 0
    counts = [10] * 32
    plan = sharding.plan(counts, owners, 4)
    assert sum(b - a for _, a, b, _, _ in plan) == 320
    assert Counter({s: sum(b - a for _, a, b, t, _ in plan if t == s) for s in range(4)}) == {s: 80 for s in range(4)}


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding_law(odd, none, shards):
    got = sharding.assign(odd, shards, 16).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.assign(odd.repartition(5), shards, 16).collect()
    same_rows(got, again)
    assert sharding.assign(none, shards, 16).count() == 0


def test_sharding_of_one_row_repeated(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(rows, 4, 8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {tuple(r) for r in got} == {(s, 750, 750, 749) for s in range(4)}


def test_sharding_moves_little(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = (sharding.assign(rows, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    moved = a.join(b, "doc_id").filter("s16 <> s17").count() / 20000
    assert moved < 0.16  # a seventeenth has to move; rehashing moves most


# 3


def test_differencing():
    assert differencing.difference([], 3) == []
    parts = differencing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(p for _, m in parts for p in m) == list(range(5)) and max(t for t, _ in parts) - min(t for t, _ in parts) <= 2
    for capacity, sizes in ((10, [10, 10, 1]), (100, list(range(1, 60))), (7, [4] * 9)):
        found = differencing.windows(sizes, capacity)
        assert sorted(p for m in found for p in m) == list(range(len(sizes)))
        assert all(sum(sizes[p] for p in m) <= capacity for m in found)


def test_packing(odd, none):
    encode = packing.encoder()
    expected = Counter(tuple([*encode(r.text or ""), 1]) for r in odd.collect())
    got = packing.pack(odd, capacity=256, piece=64, group=32).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[(r.doc_id, r.doc_tokens)].append((r.start, struct.unpack(f"<{r.length}I", r.ids)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    tokens = Counter(t for ids, n in expected.items() for t in ids for _ in range(n))
    assert Counter(t for v in documents.values() for _, ids in v for t in ids) == tokens
    for (doc_id, total), pieces in documents.items():
        if doc_id not in (None, 16, 17):
            pieces.sort()
            whole = tuple(t for _, ids in pieces for t in ids)
            assert whole in expected and len(whole) == total
    assert packing.pack(none).count() == 0


def test_tokens_equal_those_of_tokenizers():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    pick = np.random.default_rng(5)
    parts = ["<|endoftext|>", " the", "  ", "\n\n", "'s", "é", "漢", "\U0001f600", "12", "$$", "\t", "word", "A", "\r\n", " "]
    for _ in range(500):
        text = "".join(pick.choice(parts, size=pick.integers(0, 40)))
        assert encode(text) == other.encode(text, add_special_tokens=False).ids


# 4


def removed(rows, window):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), key(doc_id))
    out = []
    for doc_id, text in rows:
        w = words(text)
        lost = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key(doc_id) for p in range(i, i + window)}
        out.append((doc_id, len(w), len(lost), " ".join(x for p, x in enumerate(w) if p not in lost)))
    return out


@pytest.mark.parametrize(("part_rows", "window", "mer"), [(None, 50, 8), (1, 50, 8), (2, 20, 5)])
def test_substring_dedup(odd, none, part_rows, window, mer):
    expected = removed([(r.doc_id, r.text) for r in odd.collect()], window)
    for docs in (odd, odd.select("doc_id", "text")):
        got = substring_dedup.remove_repeats(docs, window, mer, part_rows).select("_row.doc_id", "n_words", "n_removed", "kept").collect()
        same_rows([tuple(r) for r in got], expected)
    assert substring_dedup.remove_repeats(none, window, mer, part_rows).count() == 0


def test_substring_dedup_keeps_columns(odd):
    got = substring_dedup.without_repeats(odd)
    assert got.dtypes == odd.dtypes and got.count() == odd.count()
    assert got.filter("doc_id = 1").first().text == odd.filter("doc_id = 1").first().text
    assert got.filter("doc_id = 2").first().text == ""


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.without_repeats(none).columns == none.columns and substring_dedup.without_repeats(none).count() == 0


# 5


def level(sizes, weights=(1, 2, 3), most=3):
    """Targets by the words of the contract: cap, reshare, repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        spare = total - sum(target.values())
        share = {s: spare * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(odd, none):
    rows = odd.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    got = mixing.copies(odd).collect()
    goal = level(sizes)
    assert len(got) == len(rows)
    for r in got:
        source = r["_row"].source
        assert r["size"] == len(words(r["_row"].text)) and r.source_size == sizes[source]
        assert r.target == pytest.approx(goal[source])
        rate = r.target / r.source_size
        assert int(rate) <= r.n_copies <= min(3, int(rate) + 1)
    mixed = mixing.mix(odd)
    assert mixed.dtypes == odd.dtypes and mixed.count() == sum(r.n_copies for r in got)
    same_rows(mixed.collect(), mixing.mix(odd.repartition(7)).collect())
    assert mixing.mix(none).count() == 0 and mixing.copies(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else concat('s', id % 40) end").alias("source"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"))
    got = mixing.copies(docs).groupBy("_row.source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.count("*").alias("n")).collect()
    assert all(abs(r.taken - r.target) < 6 * 4 * r.n**0.5 for r in got)


# 6


def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, none):
    rows = odd.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        known = [x for x in (least.get(find(i)), r.doc_id) if x is not None]
        least[find(i)] = min(known, default=None)
    expected = [(r.doc_id, prints[i] - (1 << 64) if prints[i] >> 63 else prints[i], least[find(i)]) for i, r in enumerate(rows)]
    same_rows([tuple(r) for r in simhash.near_duplicates(odd).collect()], expected)
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (5000, 5000), (7, 7)] + [(3000, 3000 + k) for k in range(1, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000, **{3000 + k: 3000 for k in range(50)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9


def brute_spots(text):
    """Spots by the words of the module, as (spot, occurrence)."""
    words_ = [w for w in (raw.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) for raw in re.findall(r"[^ \t-\r]+", text.lower())) if w]
    content = [w for w in words_ if w not in spotsigs.STOP_WORDS]
    found, seen, since = [], 0, 0
    for w in words_:
        if w in spotsigs.STOP_WORDS:
            found.append((w, seen))
            since = 0
        else:
            if since >= 4:
                found.append(("", seen))
            since, seen = since + 1, seen + 1
    spots = [(a, *content[at : at + 2]) for a, at in found if at < len(content)]
    spots = spots or [tuple(words_[k : k + 2]) for k in range(len(words_))] or [(text,)]
    times = Counter()
    return {(s, times.update([s]) or times[s]) for s in spots}


def test_spotsigs(odd, none):
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: -r[0])
    got = spotsigs.compare_with_edits(odd).collect()
    assert Counter(-1 if r.doc_id is None else r.doc_id for r in got) == Counter(d for d, _ in rows)
    ids = Counter(d for d, _ in rows)
    by_id = {r.doc_id: r for r in got}
    for k, (d, text) in enumerate(rows):
        following, after = rows[(k + 1) % len(rows)]
        if ids[d] == 1 and ids[following] == 1:
            n = len(text) // 3
            edited = text[: len(text) - n] + after[:n]
            a, b, c = map(brute_spots, (text, edited, after))
            like = lambda x, y: len(x & y) / len(x | y) if min(len(x), len(y)) >= 0.05 * max(len(x), len(y)) else 0.0
            r = by_id[d]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
            assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)
    assert spotsigs.compare_with_edits(none).count() == 0


def test_spotsigs_of_equal_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 700).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, "the same text").otherwise(F.concat(F.lit("the text "), "id")).alias("text"))
    sent = spotsigs.with_next(docs, 30)
    assert sent.filter("key = 700").count() <= 2 and sent.filter("not guest").agg(F.sum("n")).first()[0] == 3000
    got = spotsigs.compare_with_edits(docs).filter("doc_id = 700").groupBy("edited_sha256", "near_next").count().collect()
    assert sum(r["count"] for r in got) == 1000 and sorted(r["count"] for r in got) == [1, 999] and [r.near_next for r in got if r["count"] == 999] == [1.0]


def test_spotsigs_next_wraps_at_any_partitioning(spark):
    docs = spark.range(300).select((F.col("id") * 7 % 300).alias("doc_id"), F.concat(F.lit("the text number "), F.col("id").cast("string")).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for ranges in (1, 2, 50):
        found = spotsigs.with_next(docs, ranges).collect()
        assert sum(not r.guest for r in found) == 300
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.compare_with_edits(docs).collect()}
    assert got == {d: hashlib.sha256(spotsigs.edited(t, texts[(d - 1) % 300]).encode()).hexdigest() for d, t in texts.items()}
    hot = docs.withColumn("doc_id", F.when(F.col("doc_id") > 100, 150).otherwise(F.col("doc_id")))
    found = spotsigs.with_next(hot, 20).filter("not guest").collect()
    assert len(found) == 300 and len({r.place for r in found if r.key == 150}) > 10
    assert all(r.n == 1 for r in found)
    ordered = sorted(found, key=lambda r: (-r.key, -r.tie))
    assert [r.place for r in ordered] == sorted(r.place for r in found)
    following = [b.body for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)]
    expected = sorted((r.key, hashlib.sha256(spotsigs.edited(r.body, n).encode()).hexdigest()) for r, n in zip(ordered, following, strict=True))
    assert sorted((r.doc_id, r.edited_sha256) for r in spotsigs.compare_with_edits(hot).collect()) == expected
    one = docs.filter("doc_id = 5")
    assert spotsigs.compare_with_edits(one).first().near_next == 1.0


def test_spotsigs_pairs(odd):
    docs = odd.filter("doc_id is not null and doc_id not in (16, 17)")
    members, found = spotsigs.similar(docs, 0.6)
    sets = {r.doc_id: set(spotsigs.signatures(r.text or "").tolist()) for r in docs.collect()}
    classes = {r.doc_id: r.class_id for r in members.collect()}
    assert all(classes[d] == min(e for e in sets if sets[e] == sets[d]) for d in sets)
    heads = sorted(set(classes.values()))
    expected = {(a, b) for a in heads for b in heads if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in found.collect()} == expected
    # one id on two texts, and none at all: classes are told apart by their sets
    mixed = docs.sparkSession.createDataFrame([(1, "the red fox and the dog"), (1, "the red fox and the dog"), (1, "the blue fox of the dog to me"), (None, "the red fox and the cat")], "doc_id long, text string")
    members, found = spotsigs.similar(mixed, 0.2)
    assert members.select("set_key").distinct().count() == 3 and members.count() == 4
    assert [(r.a, r.b) for r in found.collect()] == [(1, None)]


def test_spotsigs_pairs_at_the_threshold(spark):
    """Nested sets whose likeness is the threshold itself, where products round upwards."""
    spots = [f"the word{k} next{k}" for k in range(100)]
    docs = spark.createDataFrame([(k, " ".join(spots[:n])) for k, n in ((1, 55), (2, 100), (3, 54), (4, 29))], "doc_id long, text string")
    _, found = spotsigs.similar(docs, 0.55)
    assert sorted((r.a, r.b, r.likeness) for r in found.collect()) == [(1, 2, 0.55), (1, 3, 54 / 55)]


def test_spotsigs_pairs_with_frequent_signatures(spark, monkeypatch):
    """Signatures that most sets share are met last; links are those of all pairs."""
    docs = spark.createDataFrame([(k, "the common words of every page here " * (k % 4) + made(k // 3, 40, 60) + f" the odd{k} end{k}" * (k % 3)) for k in range(90)] + [(900, None), (901, "")], "doc_id long, text string")
    sets = {r.doc_id: frozenset(spotsigs.signatures(r.text or "").tolist()) for r in docs.collect()}
    heads = {s: min(d for d in sets if sets[d] == s) for s in sets.values()}
    expected = {(min(heads[x], heads[y]), max(heads[x], heads[y])) for x in heads for y in heads if x != y and len(x & y) / len(x | y) >= 0.5}
    assert len(expected) > 20
    for share, most in ((0.001, 200_000), (0.3, 200_000), (0.001, 0), (2.0, 200_000)):
        monkeypatch.setattr(spotsigs, "FREQUENT", share)
        monkeypatch.setattr(spotsigs, "MOST_BROADCAST", most)
        assert {(r.a, r.b) for r in spotsigs.similar(docs, 0.5)[1].collect()} == expected


def test_spotsigs_pairs_of_none(none):
    members, found = spotsigs.similar(none)
    assert members.count() == 0 and found.count() == 0
