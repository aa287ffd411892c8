import pytest

#: Columns whose names the operators use themselves.
CLASHES = "i long, t string, fp long, sig string, tag long, slice int, queue int, nid long, rid long, h long, __sig string, __spans string"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, source]) as a documents table with extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) + (None,) * 12 for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)

    return make


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small_docs):
    return {r["doc_id"]: r["text"] for r in small_docs.collect()}
