import os

import pytest

SF = os.environ.get("PAYTALLY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """(doc_id, text) rows; ``extra`` adds columns whose names clash with results and helpers."""
        schema = "doc_id long, text string"
        if not extra:
            return spark.createDataFrame(rows, schema)
        wide = [(*r, "x", 7, "y") for r in rows]
        return spark.createDataFrame(wide, schema + ", score string, component_id int, spans string")

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a long text, other scripts.
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a text without id"),
        (None, None), (6, "word " * 30_000), (7, "Ünïcode ßtraße 中文 текст " * 40), (8, "UPPER!! CASE!! " * 50),
        (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 20), (10, "x" * 50_000)]
