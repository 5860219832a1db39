import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("row", "block", "k", "_t", "size", "rep", "ids", "length", "h", "x"):
                df = df.selectExpr("*", f"'other' as `{name}`")
        return df

    return make


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "A b c  d e f g"),
    (None, "no id here at all today"), (7, "é x ß\x1cy <|endoftext|> 日本語 \r\n tail "), (8, "word " * 3000),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
