import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, repeated and short texts, null fields, and columns whose names clash with results."""
    long = "wind and water over the old stone bridge " * 4000
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, "Call +1 (212) 555-0199 or write to jo.doe@mail.example.org today.", "en", None, 66),
        (4, "one two three", "en", "b", 13),
        (5, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 59),
        (6, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 59),
        (6, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 59),
        (7, "THE  QUICK brown\tfox jumps over the lazy dog again and again ", "en", "c", 61),
        (8, long, "en", "c", len(long)),
        (9, "12345 !!! ???", "en", "c", 13),
        (10, "дом и сад Ω ñandú 日本語 <|endoftext|>", "xx", "c", 38),
    ]
    return spark.createDataFrame([(*r, 9.5, "x", True, 7) for r in rows], SCHEMA + ", score double, fingerprint string, rejected boolean, slot int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
