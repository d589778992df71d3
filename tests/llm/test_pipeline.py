"""The pipeline against its stages by brute force, its odd rows, and its registration."""

import os
import struct

import pytest

import __spark_entry__
from rowcraft.llm import similar_texts, support
from tests.llm.conftest import made
from tests.llm.test_operators import measured, removed

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = made(1, 150)
    texts = [base, base, base + " tail", *[made(k, 60 + k) for k in range(20, 50)], made(60, 100) + " " + base, "short", "### " * 80, made(61, 30) + " " + made(20, 80)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def alike(texts):
    """Groups of linked documents as {doc_id: least of its group}, all pairs compared."""
    prints = {d: similar_texts.fingerprint(similar_texts.shingles(t.encode())) for d, t in texts.items()}
    least = {d: d for d in texts}
    for _ in texts:
        for d in texts:
            for e in texts:
                if sum(int(x ^ y).bit_count() for x, y in zip(prints[d], prints[e], strict=True)) <= similar_texts.radius():
                    least[d] = least[e] = min(least[d], least[e])
    return least


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeated_passages", "mix", "pack"]
    (_, quality), (_, near), (_, passages), (_, mix), (_, pack) = corpus_pipeline.STAGES

    docs = quality(spark, docs, sf_dir)
    kept = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and kept == {d for d, t in texts.items() if measured(t)[0] >= 50 and "###" not in t}

    docs = near(spark, docs, sf_dir)
    left = {r.doc_id for r in docs.collect()}
    groups = alike({d: texts[d] for d in kept})
    assert docs.columns == columns and 0 in left and 1 not in left and 2 not in left
    assert left == {d for d in kept if groups[d] == d}

    docs = passages(spark, docs, sf_dir)
    expected = {d: (n, words) for d, _, n, words in removed([(d, texts[d]) for d in left], 50)}
    for r in docs.collect():
        n, words = expected[r.doc_id]
        assert r.text == (words if n else texts[r.doc_id]) and r.n_chars == len(r.text)
    assert docs.columns == columns and any(n for n, _ in expected.values())

    mixed = mix(spark, docs, sf_dir)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= left
    packed = pack(spark, mixed, sf_dir).collect()
    encode = corpus_pipeline.packing.encoder()
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in mixed.collect())
    assert all(len(struct.unpack(f"<{r.length}I", r.ids)) == r.length for r in packed)


def test_run(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


def test_stages_on_odd_rows_and_none(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = {(r.doc_id, r["size"]) for r in docs.collect()}
            docs = support.materialise(stage(spark, docs, ""), name)
            assert docs.columns == odd.columns and {(r.doc_id, r["size"]) for r in docs.collect()} <= before
        packed = corpus_pipeline.pack(spark, docs, "").collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert not packed


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_scratch_is_dropped(spark, tmp_path):
    found = support.materialise(spark.range(3), "numbers")
    path = found.inputFiles()[0].removeprefix("file://")
    assert found.count() == 3 and os.path.exists(path)
    support.drop_scratch(spark)
    assert not os.path.exists(path)
