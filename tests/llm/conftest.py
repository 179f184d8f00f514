import os

import pandas as pd
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture
def docs(spark):
    """A documents table of (id, text) pairs, with an extra column of a name that operators use themselves."""

    def of(*rows, source="s", lang="en"):
        full = [(i, t, lang, source, None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string")

    return of
