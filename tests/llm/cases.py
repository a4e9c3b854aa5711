"""Small tables for the tests of this folder."""

#: Extra columns whose names operators use inside.
NAMES = ["chunk", "bucket", "data", "kind", "node", "token", "words", "row", "key", "order", "label", "doc", "more", "part", "n", "set", "query_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def docs_of(spark, texts, ids=None, sources=None):
    """documents with extra columns; repeated entries are repeated rows unless ids differ."""
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}" if sources is None else sources[i], len(t or ""), *["kept"] * len(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
