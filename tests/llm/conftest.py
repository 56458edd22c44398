from __future__ import annotations

import pytest

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table with rows that are easily mishandled, and its rows as tuples.

    Columns: doc_id, text, lang, source and two whose names operators use themselves.
    """
    base = [tuple(r) for r in spark.read.parquet(f"{SMALL_DIR}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    odd = [
        (10_001, None, None, None),
        (10_002, "", "en", "src1"),
        (10_003, " \t\n\x0b\x0c\r ", "en", "src1"),
        (10_004, "word", None, "src2"),
        (10_005, "Éàü ñ Σ \U0001f600     x", "fr", None),
        (10_006, base[0][1], "en", "src3"),
        (10_006, base[0][1], "en", "src3"),
        (10_007, base[1][1] + " tail", "en", "src3"),
        (None, base[2][1], "en", "src4"),
        (10_008, "lorem ipsum dolor " * 60_000, "en", "src5"),
        (10_009, "x" * 300_000, "en", "src5"),
    ]
    rows = [(*r, 7, "clash") for r in base + odd]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node int, size string"), rows


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
