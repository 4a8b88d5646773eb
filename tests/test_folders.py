"""Data sources over folders: blocks, broken files, parsers, Arrow in both formats, columns, splits."""

import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from datamill.sources import arrow_folder, stores
from datamill.sources.documents import FORMAT, Document, DocumentParser, read_documents, use_parsers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Reversed(DocumentParser):
    name, suffixes = "reversed", (".rev",)

    def parse(self, path, text):
        if not text:
            raise ValueError("nothing in it")
        return Document(text[::-1], title=path, code_blocks=[text], metadata={"n": str(len(text))})


class Anything(DocumentParser):
    name = "anything"

    def can_parse(self, path):
        return "special" in path

    def parse(self, path, text):
        return Document("special")


def put(folder, files):
    for path, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "wb") as f:
            f.write(data)


def test_documents_of_all_kinds(spark, tmp_path):
    put(tmp_path, {"a/one.rev": b"abc", "a/two.REV": b"", "b/special.md": b"x", "b/plain.md": "# Título\ntext".encode(), "b/c/bad.txt": b"\xff\xfe", ".hidden/x.md": b"no", "_x/y.md": b"no", "z.bin": b"data"})
    use_parsers(spark, Anything(), Reversed())
    got = {r["source_path"]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/one.rev", "a/two.REV", "b/special.md", "b/plain.md", "b/c/bad.txt", "z.bin"}
    assert (got["a/one.rev"]["content"], got["a/one.rev"]["code_blocks"], got["a/one.rev"]["parser"]) == ("cba", ["abc"], "reversed")
    assert (got["a/two.REV"]["parser"], got["a/two.REV"]["_error"]) == ("reversed", "ValueError: nothing in it")
    assert (got["b/special.md"]["content"], got["b/plain.md"]["content"], got["b/plain.md"]["title"]) == ("special", "# Título\ntext", "Título")
    assert (got["b/c/bad.txt"]["_error"], got["z.bin"]["_error"]) == ("not UTF-8", "no parser for this file")


def test_blocks_bound_files_and_bytes(spark, tmp_path):
    files = [("a", 10), ("b", 10), ("c", 100), ("d", 1), ("e", 1), ("f", 1)]
    assert list(stores.blocks(files, 2, 50)) == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert list(stores.blocks([], 2, 50)) == []
    put(tmp_path, {f"{i}.txt": b"x" for i in range(10)})
    use_parsers(spark)
    rows = spark.read.format(FORMAT).option("block_files", 3).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 10


def test_a_file_that_goes_meanwhile_is_a_row(spark, tmp_path):
    from datamill.sources.documents import Block, DocumentReader

    rows = list(DocumentReader({"path": str(tmp_path)}, []).read(Block(str(tmp_path), ["gone.md"])))
    assert rows == [("gone.md", None, None, None, None, None, None, None, "the file is gone")]


def test_written_files(spark, tmp_path):
    use_parsers(spark)
    df = spark.createDataFrame([("a/b.md", b"one"), ("c.txt", None)], "source_path string, value binary")
    for _ in range(2):  # the second time writes the same files
        df.write.format(FORMAT).mode("append").save(f"{tmp_path}/out")
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["out/a/b.md", "out/c.txt"]
    assert sorted((r["source_path"], r["value"]) for r in spark.read.format(FORMAT).load(f"{tmp_path}/out").collect()) == [("a/b.md", "one"), ("c.txt", "")]
    with pytest.raises(Exception, match="isn't below"):
        df.withColumn("source_path", F.lit("../x")).write.format(FORMAT).mode("append").save(f"{tmp_path}/out")


def test_empty_folder(spark, tmp_path):
    use_parsers(spark)
    assert read_documents(spark, str(tmp_path)).collect() == []


def write_ipc(path, tables, stream=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    make = pa.ipc.new_stream if stream else pa.ipc.new_file
    with make(path, tables[0].schema) as out:
        for t in tables:
            out.write_table(t)


def test_arrow_ranges_columns_and_both_formats(spark, tmp_path):
    part = lambda a: pa.table({"id": pa.array(range(a, a + 5)), "text": [f"t{i}" if i % 3 else None for i in range(a, a + 5)], "tags": [["x"] * (i % 2) for i in range(a, a + 5)]})
    write_ipc(f"{tmp_path}/s/a.arrow", [part(0), part(5), part(10)])
    write_ipc(f"{tmp_path}/s/b.arrow", [part(15), part(20)], stream=True)
    rows = arrow_folder.read_arrow(spark, f"{tmp_path}/s", batches=2)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, rows.collect())) == [(i, f"t{i}" if i % 3 else None, ["x"] * (i % 2)) for i in range(25)]
    some = arrow_folder.read_arrow(spark, f"{tmp_path}/s", ["tags", "id"])
    assert some.columns == ["tags", "id"] and sorted(r["id"] for r in some.collect()) == list(range(25))


def test_arrow_reads_the_asked_columns_only(tmp_path):
    """The other column's bytes are taken away, and nothing misses them."""
    t = pa.table({"id": pa.array(range(1000)), "text": ["x" * 100] * 1000})
    write_ipc(f"{tmp_path}/a.arrow", [t])
    data = open(f"{tmp_path}/a.arrow", "rb").read()
    open(f"{tmp_path}/a.arrow", "wb").write(data.replace(b"x" * 100, b"\xff" * 100))
    reader = arrow_folder.ArrowReader({"path": str(tmp_path)}, ["id"])
    (part,) = reader.partitions()
    assert [b.schema.names for b in reader.read(part)] == [["id"]]


def test_arrow_round_trip_and_splits(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.concat(F.lit("é"), F.col("id").cast("string"))).repartition(3)
    arrow_folder.write_arrow(df, f"{tmp_path}/train")
    arrow_folder.write_arrow(df.limit(0), f"{tmp_path}/empty")
    assert all(f.endswith(".arrow") for f in os.listdir(f"{tmp_path}/train"))
    got = arrow_folder.arrow_splits(spark, str(tmp_path), ["train", "test", "empty"])
    assert sorted(map(tuple, got.collect())) == sorted((i, f"é{i}", "train") for i in range(100))
    with pytest.raises(ValueError, match="no Arrow files"):
        arrow_folder.arrow_splits(spark, str(tmp_path), ["test"])
    assert arrow_folder.read_arrow(spark, f"{tmp_path}/train").agg(F.sum("id")).first()[0] == 4950


def test_whole_texts_are_written_in_small_batches(spark, tmp_path):
    """A batch is what a task's Python holds at a time."""
    import pyarrow as pa

    from datamill.sources import arrow_folder
    from datamill.tables import ROWS_PER_BATCH

    arrow_folder.write_arrow(spark.range(2500).selectExpr("id", "repeat('word ', 20) AS text").coalesce(1), str(tmp_path / "small"))
    (path,) = (tmp_path / "small").glob("*.arrow")
    with pa.ipc.open_file(str(path)) as file:
        sizes = [file.get_batch(i).num_rows for i in range(file.num_record_batches)]
    assert sum(sizes) == 2500 and max(sizes) <= ROWS_PER_BATCH
    assert arrow_folder.read_arrow(spark, str(tmp_path / "small"), ["id"]).count() == 2500
