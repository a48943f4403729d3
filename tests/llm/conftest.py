import pytest

CLASH = ["run", "file", "digest", "features", "node", "mix_slot", "spans", "ids", "key"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like an operator's own."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [None, "", " \t\n", "one", "two words", "a b c", "A  b\nc", long, long, "x" * 70_000, "é漢😀 \x01\x02 token = abcdefgh123 " + "ab12" * 10, "same text here now", "same text here now"]
    rows = [(k, t, "en", ["src0", None, "odd"][k % 3], len(t or ""), *[f"c{k}"] * len(CLASH)) for k, t in enumerate(texts)]
    rows += [rows[-1], (None, "same text here now", None, None, None, *[None] * len(CLASH))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, schema)
