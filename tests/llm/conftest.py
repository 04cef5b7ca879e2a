import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls, empty and repeated rows, equal ids with other texts, a very long text, signs."""
    rows = [(1, "The same words again and again in one short text.", "en", "a"), (1, "The same words again and again in one short text.", "en", "a"), (1, "another text under the same id", "en", None), (2, None, None, None), (None, "no id here at all", None, "b"), (3, "", "en", "a"), (4, " \n\t ", "de", "a"), (5, "12 34 %%", "de", "b"), (6, "word " * 30000, "en", "a"), (7, "x", "fr", "b"), (8, "É日本 'll don't <|endoftext|> ½", "fr", "b"), (None, None, None, None)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def folder(spark, tmp_path):
    """Write tables as a scale folder and return its path."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return make
