"""Token ids of texts with long runs, against the ``tokenizers`` form."""

import pytest

from rowcraft.llm import packing


@pytest.fixture(scope="module")
def other():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t ", "a", "!", "7", "\u00a0", "漢"])
@pytest.mark.parametrize("frame", ["{}", "a{}b", "x {}", "{} y"])
def test_a_million_characters(other, run, frame):
    text = frame.format(run * (1_000_000 // len(run)))
    assert packing.encoder()(text) == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [packing.LONGEST_BLANK - 1, packing.LONGEST_BLANK, packing.LONGEST_BLANK + 1])
def test_both_sides_of_the_bound(other, n):
    for text in (" " * n + "a", "a" + "\n" * n, "b" + " " * n + "<|endoftext|>"):
        assert packing.encoder()(text) == other.encode(text, add_special_tokens=False).ids


def test_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000)], "doc_id long, text string")
    got = packing.pack(docs).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == 2 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
