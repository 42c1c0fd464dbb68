import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark):
    def read(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    return read


ODD_TEXTS = [None, "", " ", "\n\n", "a", "A  b", "word " * 30_000, "x" * 200_000, "日本語 テスト", "😀 a", "a\u00a0b", "<|im_end|> <|endoftext|>", "a\x00b"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, long, repeated and tied rows, null ids, and columns whose names clash."""
    rows = [(i, t, "xx", f"s{i}") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id one two three", None, None), (None, None, None, None), (3, "\n\n", "xx", "s3"), (4, "other text of the same id", "xx", "s4"), (5, "A  b", "xx", "again")]
    schema = "doc_id long, text string, lang string, score string"
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "'x' AS leaks", "'y' AS lang_pred", "1 AS n_chunks", "'z' AS piece_ids", "2 AS part", "3 AS node", "4 AS p", "5 AS comp",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
