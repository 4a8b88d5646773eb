"""Chunking by columns against the line-by-line version, on random pages and on the query's table."""

import hashlib
import os
import random

import plain_chunking as plain
import pytest
from pyspark.sql import functions as F

from datamill.operators import chunking
from datamill.plans.catalogue import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LINES = [
    "", "", "  ", "word", "some words that go on for a while " * 3, "```python", "```", "  ```", "x = 1", "Output:", "Output: 3", "# Title", "## Slide two", "## Part", "### Small", "---",
    "[IMAGE:a]", "see [IMAGE:b] and [IMAGE:c] here", "[IMAGE:broken", "<div class='Alert'>", "y" * 600, "[IMAGE:d] " * 6, "z\t \t",
]


def page(r):
    return "\n".join(r.choice(LINES) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("limits", [(4096, 850, 0, 4, 4), (300, 90, 0, 2, 2), (120, 60, 50, 1, 3), (50, 200, 1000, 4, 1)])
def test_pages_of_every_kind(spark, limits):
    r = random.Random(limits[0])
    given = [(i % 50 if i % 7 else None, page(r), r.choice(["notebook", "slides", "page", None])) for i in range(150)] + [(1, None, "page"), (2, "", "notebook")]
    df = spark.createDataFrame(given, "doc_id long, content string, kind string").repartition(3)
    got = [(r["doc_id"], r["chunk_id"], r["text"], tuple(r["code"]), r["n_images"]) for r in chunking.chunk_documents(df, chunking.Limits(*limits)).collect()]
    want = [
        (doc_id, n, p.text, tuple(p.code), p.images)
        for doc_id, content, kind in given
        for n, p in enumerate(plain.chunked(content, kind == "notebook", kind == "slides", plain.Limits(*limits)))
    ]
    assert sorted(got, key=repr) == sorted(((*w[:4], w[4]) for w in want), key=repr)


def test_query(spark):
    """The rows of the query from the same contents."""
    def content(text):
        lead = {2: "```python\n", 3: "Output:\n", 5: "## Slide ", 7: "---\n[IMAGE:a] "}
        return "\n".join(lead.get(i % 9, "") + x + ("\n```" if i % 9 == 2 else "\n") for i, x in enumerate(text.split("\n")))

    want = []
    for doc_id, text in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        for n, p in enumerate(plain.chunked(content(text), doc_id % 3 == 0, doc_id % 3 == 1)):
            want.append((doc_id, n, hashlib.md5(p.text.encode()).hexdigest(), len(p.code), p.images))
    assert sorted(map(tuple, QUERIES["q60_chunk_documents"](spark, SF_DIR).collect())) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, content string, kind string")
    assert chunking.chunk_documents(df).collect() == [] and chunking.chunk_documents(df).agg(F.count("*")).first()[0] == 0
