"""Near-dedup against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowcraft.llm import similar_texts
from tests.llm.conftest import made


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def cosine(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y))


def edited(text, n, seed):
    """A text with n words replaced, far enough apart to break 5 shingles each."""
    w, pick = text.split(), random.Random(seed)
    for k in range(n):
        w[10 + k * 20 + pick.randrange(10)] = f"edit{seed}x{k}"
    return " ".join(w)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("hot", [similar_texts.HOT, 8])
def test_stage_removes_edited_copies(spark, monkeypatch, hot):
    base = [made(k, 300, 2000) for k in range(30)]
    copies = [edited(t, 1 + k % 6, k) for k, t in enumerate(base)]
    far = [edited(t, 14, 500 + k) + " " + made(700 + k, 250, 2000) for k, t in enumerate(base)]
    assert all(cosine(a, b) >= 0.88 for a, b in zip(base, copies, strict=True)) and all(cosine(a, b) < 0.62 for a, b in zip(base, far, strict=True))
    texts = dict(enumerate(base)) | {100 + k: t for k, t in enumerate(copies)} | {200 + k: t for k, t in enumerate(far)}
    # Many copies of one text, which is not the least of them: a star whose
    # arms are less alike than the threshold.
    star = made(900, 300, 2000)
    texts |= {400 + k: edited(star, 5, 1000 + k) for k in range(60)} | {470: star}
    docs = frame(spark, texts)
    kept = similar_texts.keep_one(docs, hot=hot)
    assert {r.doc_id for r in kept.collect()} == set(range(30)) | set(range(200, 230)) | {400}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {r.doc_id for r in kept.collect()}


def test_fingerprints_by_brute_force():
    for text in ("", "one", "a b c d e", "a b c d e f", made(3, 80)):
        found = similar_texts.shingles(text.encode())
        ones = np.zeros(512)
        for h in found:
            ones += [int(similar_texts._mixed(np.array([h]), k)[0]) >> b & 1 for k in range(8) for b in range(64)]
        tie = [int(similar_texts._mixed(found[:1], k)[0]) >> b & 1 for k in range(8) for b in range(64)] if len(found) and len(found) % 2 == 0 else np.zeros(512)
        bits = (2 * ones + tie > len(found)) if len(found) else np.zeros(512, bool)
        assert similar_texts.fingerprint(found).tolist() == [sum(int(bits[64 * k + b]) << b for b in range(64)) for k in range(8)]


def test_estimate_of_the_cosine():
    text = made(1, 400, 3000)
    for n in (2, 5, 9, 14):
        true = cosine(text, edited(text, n, n))
        a, b = (similar_texts.fingerprint(similar_texts.shingles(t.encode())) for t in (text, edited(text, n, n)))
        differ = sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True))
        assert math.cos(math.pi * differ / 512) == pytest.approx(true, abs=0.12)
    assert similar_texts.radius() == 114


def test_odd_rows(spark, odd, none):
    got = similar_texts.keep_one(odd)
    assert got.columns == odd.columns
    left = [(r.doc_id, r.text or "") for r in got.collect()]
    rows = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert set(left) <= rows and len(left) == len(set(left))
    # nothing is lost: each text is there, or one that is alike
    for _, text in rows:
        assert any(grams(text) == grams(t) or (grams(text) and grams(t) and cosine(text, t) > 0.7) for _, t in left)
    ids = [d for d, _ in left]
    assert 1 in ids and 2 not in ids and 3 not in ids and 19 not in ids and 6 not in ids
    assert ids.count(17) == 1 and ids.count(16) == 2 and ids.count(None) == 0
    assert similar_texts.keep_one(none).count() == 0 and similar_texts.keep_one(none).columns == none.columns


def test_no_text_is_lost_with_a_repeated_id(spark):
    one, two = made(1, 90), made(2, 90)
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (5, two), (None, two), (None, made(3, 90)), (None, made(3, 90))], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in similar_texts.keep_one(docs).collect()) == sorted([(1, one), (5, two), (0, made(3, 90))])
    many = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    assert similar_texts.keep_one(many).count() == 3
