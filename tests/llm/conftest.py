from __future__ import annotations

import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n_tokens string, score string, c string, rank string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    near = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, near), (2, near.replace("w7 ", "other ")), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "two words"),
        (9, near + " end"), (9, near + " end"), (10, "a" * 300), (11, "é" * 150), (12, " ".join(["x"] * 50_000)), (None, near), (None, None), (13, "first"), (13, "other text of one id"),
        (14, "mail a.b@c.example and +1 (555) 123-4567 or 10.0.0.1"),
    ]
    return spark.createDataFrame([(i, t, None, "x", "x", "x", "x") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
