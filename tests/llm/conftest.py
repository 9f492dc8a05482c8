import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (3 + seed % 5) + i * i * (1 + seed % 3)) % len(WORDS)] + str((seed + i) % 9) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    base = sentence(3, 60)
    rows = [
        (1, base, "en", "a"),
        (2, base + " extra", "en", "a"),
        (3, None, None, "a"),
        (4, "", "fr", None),
        (5, " \n\t\x0b ", None, "b"),
        (6, sentence(9, 40_000), "de", "b"),
        (7, base, "en", "a"),
        (7, base, "en", "a"),
        (None, sentence(5, 30), "en", "c"),
        (8, "two words", "en", "c"),
        (9, "é ñ 漢字 <|endoftext|> 💡", None, None),
        (10, "1234 !!! ...", "en", "b"),
        (11, "Dup line one two\nDup line one two\n" * 40, "en", "a"),
    ] + [(100 + i, sentence(i + 20, 25 + i), ("en", "fr", "de")[i % 3], "abc"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["n_chars", "size", "score", "rep", "shard", "h", "epochs", "run", "_row", "copies", "ids", "part", "count", "kept", "spans", "n"]
    return df.withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
