import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema=DOCS):
        full = [(i, t, *(rest + ["en", "src1"][len(rest):])) for i, t, *rest in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], schema)

    return make
