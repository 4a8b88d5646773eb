"""Pages of an index, and earlier code by offsets."""

import random

import pytest
from pyspark.sql import functions as F

from datamill.operators import browse, context


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    keys = [f"k{i:05d}" for i in range(5000)]
    random.Random(1).shuffle(keys)
    browse.build_index(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v int"), "key", folder, range_rows=250)
    return folder


@pytest.mark.parametrize("offset", [0, 7, 240, 2500, 4990, 5000, 9000])
def test_pages_in_order(spark, index, offset):
    got = browse.page(spark, index, "key", offset, 40)
    rows = got.collect()
    assert [r["key"] for r in rows] == [f"k{i:05d}" for i in range(offset, min(offset + 40, 5000))]
    assert all(r["total"] == 5000 and r["has_more"] == (5000 > offset + 40) for r in rows)


def test_a_deep_page_reads_as_little_as_the_first(spark, index):
    read = lambda offset: sum(spark.read.parquet(f).count() for f in browse.page(spark, index, "key", offset, 40).inputFiles())
    assert 0 < read(0) < 800 and 0 < read(4900) < 800 and read(9000) == 0


def test_empty_index(spark, tmp_path):
    browse.build_index(spark.createDataFrame([], "key string, v int"), "key", str(tmp_path))
    assert browse.page(spark, str(tmp_path), "key").collect() == []


def test_earlier_code_by_offsets(spark):
    r = random.Random(2)
    rows = [(d, i, [r.choice(["x", "", "long é line", "a\nb"]) for _ in range(r.randint(0, 3))]) for d in range(6) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "doc int, i int, code array<string>").repartition(3)
    for between in ("\n\n", "|"):
        key = ("doc", "i", "code", between)
        got = context.with_earlier_code(context.with_code_range(df, *key), context.code_store(df, *key), "doc").select("doc", "i", "n_earlier", "earlier_code").collect()
        want = []
        for d, i, _ in rows:
            before = [c for e, j, codes in rows if e == d and j < i for c in codes]
            want.append((d, i, len(before), between.join(before) if before else None))
        assert sorted(map(tuple, got)) == sorted(want)
    assert context.code_store(df.where(F.lit(False)), "doc", "i", "code").collect() == []
