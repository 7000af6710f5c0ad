"""Documents with every oddity the operators must take."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, skey string, start int, node string,"
    " keep_id int, text_sha256 string, tie string, block int, `key` int, label int, score double, ids int, _hot string, __text string"
)


def _words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple[int | None, str | None, str | None]]:
    """``doc_id, text, source``."""
    long, base = _words(6000, 1), _words(120, 2).split()
    near = [*base[:60], "changed", *base[61:]]
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"),
        (None, "two words", "a"), (None, None, None), (7, long, "big"), (8, long + " tail", "big"), (9, long, "big"),
        (10, " ".join(base), "c"), (11, " ".join(near), "c"), (12, " ".join(base), None), (13, _words(200, 5), "c"),
        (14, "Grüße  aus Köln \U0001f600▁ x\r\n\x0b\x0c y\x85z", "dé"), (14, "same id, other text", "dé"),
        (-3, "a b c d", "c"), (15, " lead and trail ", "c"), (16, "tab\there", "c"), (17, "a b c d e f g h", "c"), (18, "A b C d E f g h", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", s, None if t is None else len(t), *[None] * 14) for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
