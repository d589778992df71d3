"""Documents with everything that can be odd about a row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `_row` string, kept string, `a.b` int"


def made(seed: int, n: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    words = [f"{'the of and to in'.split()[k % 5]}" if pick.random() < 0.3 else f"w{pick.randrange(vocabulary)}" for k in range(n)]
    return " ".join(w + ("\n" if pick.random() < 0.03 else "") for w in words)


def rows() -> list[tuple]:
    base = made(1, 140)
    texts = [
        (1, base), (2, base), (3, base + " more"), (4, "THE End"), (5, ""), (6, None), (7, " \t\n\x0b\x0c\r "), (8, "  x\u0085y"), (9, made(9, 60) + "\n" + made(9, 60)),
        (10, "same line\nsame line\n\nsame line\n" + made(10, 80)), (11, made(11, 20) + " " + base[: len(base) // 2 * 1]), (12, "héé ß 漢字 \U0001f600 <|endoftext|> x"), (13, "a " * 4000),
        (14, made(14, 9000, 5000)), (None, base), (None, None), (None, made(15, 70)), (16, made(15, 70)), (16, made(16, 70)), (17, made(17, 55)), (17, made(17, 55)), (18, "###" * 50), (19, made(1, 140).upper()),
    ]
    out = []
    for k, (doc_id, text) in enumerate(texts):
        out.append((doc_id, text, (None, "en", "de")[k % 3], (None, "s1", "s2", "S3", "é")[k % 5], None if text is None else len(text), k, "r", "k", k))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
