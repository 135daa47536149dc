import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _hash string, fp string"

WORDS = "the quick brown fox jumps over a lazy dog while seven small owls watch from an old oak tree near rivers".split()


def prose(seed: int, n: int) -> str:
    """Words from a small vocabulary, the same for the same seed."""
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = x * 1664525 % 2**32 + 1013904223
        out.append(WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows; extra columns whose names the operators use themselves."""
    texts = [prose(i, 5 + 7 * i) for i in range(30)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(40, None), (41, ""), (42, "   \n\t"), (43, "one"), (44, "one two"), (45, prose(3, 9000)), (46, prose(3, 9000) + " end")]
    out += [(50, texts[20]), (51, texts[20].replace(" ", "  ")), (52, texts[20].replace(" ", "\n")), (53, texts[21] + " x"), (7, texts[7]), (7, texts[7])]
    out += [(54, "Über naïve Καλημέρα Σ ΟΔΟΣ don't <|endoftext|> 12 34.5   x"), (55, "á  b\t\tc  d"), (-3, "Released under the MIT License.\nmore")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "r", "h", "f") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
