import random

import pytest

SPACES = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    words = ["Alpha", "beta,", "gamma.", "the", "of", "é-u", "naïve", "straße", "and", "to", "IN", "x" * 12, "don't", "12", "a|b", "ok!!"]
    return "".join(r.choice(words) + str(r.randrange(40)) * (r.random() < 0.5) + r.choice([" ", " ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, copies and repeated rows."""
    r = random.Random(7)
    texts = [prose(r, r.randrange(1, 160)) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "a b c d", "A  B\nC d", " lead and trail ", "é" * 20, "tail\n", "\n\nx\n", "<|endoftext|> x <|endoftext|>", "\u00a0nbsp\u2003x y", "z\x85y z"]
    texts += [prose(r, 30_000), "word " * 20_000, "y" * 300_000]
    texts += [texts[0], texts[1], texts[1], texts[2] + " more", "Extra " + texts[3]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows[5] = (5, texts[5], None, None, None)
    return [*rows, rows[7], rows[7], (None, texts[8], "en", "s0", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
