import random

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bits int, name string, k1 int, spans string, row int, rule int"


@pytest.fixture(scope="session")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, one-word, blank, very long, repeated and foreign texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    long = " ".join(word() for _ in range(60_000))
    shared = " ".join(word() for _ in range(150))
    texts = [
        (1, None), (2, ""), (3, "word"), (4, " \n\t "), (5, long), (6, shared), (6, shared), (7, "Ärger über  Straße. \u3000 é é́ x\x1cy"),
        (None, "a text without an id " + shared), (8, "<|endoftext|> stop <|startoftext|> <|im_start|>user"), (9, shared + " tail of its own"),
        (10, "na " * 3000), (11, "a b c d e f"), (12, "日本語のテキスト。" * 100), (13, "x" * 5000), (14, "1 22 333 " * 40),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None, 7, 1, "n", 2, "s", 3, 4) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows beside columns whose names the operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
