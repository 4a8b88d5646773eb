"""Queries over folders that tasks write from the given tables and read back through the library's data sources, and over images."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.operators import images
from datamill.plans.registry import query
from datamill.sources import arrow_folder
from datamill.sources.documents import FORMAT, Document, DocumentParser, read_documents, use_parsers
from datamill.tables import read_table, written_dir


class Records(DocumentParser):
    """Files that a user's own parser reads; it fails on some."""

    name, suffixes = "record", (".rec",)

    def parse(self, path: str, text: str) -> Document:
        if int(path.rpartition("/")[2].removesuffix(".rec")) % 2 == 0:
            raise ValueError("even")
        return Document(text, title=path)


SUFFIXES = [".md", ".ipynb", ".txt", ".rec", ".ipynb"]


@query(
    "q100_document_source",
    f"""SELECT 'd' || doc_id % 3 || '/' || doc_id || {SUFFIXES}[CAST(doc_id % 5 AS INTEGER) + 1] AS source_path,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 3 THEN 'record' WHEN doc_id % 5 IN (0, 2) THEN 'text' ELSE 'notebook' END AS parser,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 10 = 8 THEN NULL WHEN doc_id % 5 = 4 THEN md5('') ELSE md5(text) END AS digest,
  CASE WHEN doc_id % 7 = 0 THEN 'not UTF-8' WHEN doc_id % 10 = 8 THEN 'ValueError: even' WHEN doc_id % 5 = 4 THEN 'not a notebook' END AS error FROM documents""",
)
def q100(spark, sf_dir):
    """Whole texts as files of several kinds, some of them broken, read back by registered parsers and those of columns."""
    folder, i = f"{written_dir(spark)}/documents-{uuid.uuid4().hex}", F.col("doc_id")
    use_parsers(spark, Records())
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (i % 5).cast("int") + 1)
    path = F.concat(F.lit("d"), (i % 3).cast("string"), F.lit("/"), i.cast("string"), suffix)
    notebook = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":'), F.get(F.split(F.to_json(F.struct(F.col("text").alias("t"))), '^\\{"t":'), F.lit(1)), F.lit("]}"))
    value = F.when(i % 5 == 1, notebook).when(i % 5 == 4, F.concat(F.lit("broken "), "text")).otherwise(F.col("text"))
    data = F.encode(value, "UTF-8")
    rows = read_table(spark, sf_dir, "documents").select(path.alias("source_path"), F.when(i % 7 == 0, F.concat(data, F.unhex(F.lit("FF")))).otherwise(data).alias("value"))
    rows.write.format(FORMAT).mode("append").save(folder)
    return read_documents(spark, folder).select("source_path", "parser", F.md5("content").alias("digest"), F.col("_error").alias("error"))


@query("q101_arrow_folder", "SELECT doc_id, source, lang, md5(text) AS digest FROM documents")
def q101(spark, sf_dir):
    """Documents written as Arrow files, and some of their columns read back."""
    folder = f"{written_dir(spark)}/arrow-{uuid.uuid4().hex}"
    arrow_folder.write_arrow(read_table(spark, sf_dir, "documents"), folder)
    return arrow_folder.read_arrow(spark, folder, ["doc_id", "lang", "text", "source"]).select("doc_id", "source", "lang", F.md5("text").alias("digest"))


@F.arrow_udf(T.BinaryType())
def drawn(texts: pa.Array, doc_ids: pa.Array) -> pa.Array:
    """Images of whole texts, a grey pixel a byte; each fourth is white, some are broken off, and each eighth has lines of all filters."""
    out = []
    for text, doc_id in zip(texts.to_pylist(), doc_ids.to_pylist()):
        data, width = np.frombuffer((text or "").encode(), np.uint8), 40 + doc_id % 60
        height = max(1, -(-len(data) // width))
        pixels = np.full(width * height, 255 if doc_id % 4 == 0 else 0, np.uint8)
        if doc_id % 4:
            pixels[: len(data)] = data
        png = images.encoded(pixels.reshape(height, width, 1), np.arange(height) % 5 if doc_id % 8 == 3 else doc_id % 3)
        out.append(png[:40] if doc_id % 11 == 0 else png)
    return pa.array(out, pa.binary())


LONGEST_SIDE = 64


@query(
    "q103_images",
    f"""WITH v_sizes AS (SELECT doc_id, 40 + doc_id % 60 AS w, greatest(1, CAST(ceil(strlen(text) / (40 + doc_id % 60)) AS BIGINT)) AS h FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN w END AS width, CASE WHEN doc_id % 11 > 0 THEN h END AS height, CASE WHEN doc_id % 11 > 0 THEN doc_id % 4 = 0 END AS blank,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN greatest(w, h) <= {LONGEST_SIDE} THEN w ELSE greatest(1, CAST(floor(w * ({LONGEST_SIDE}::DOUBLE / greatest(w, h))) AS BIGINT)) END AS new_width,
  CASE WHEN doc_id % 11 = 0 THEN 'the file is cut off' END AS error FROM v_sizes""",
)
def q103(spark, sf_dir):
    """Images drawn from whole texts: their size, whether they are blank, and the size of what is made of them."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", drawn("text", "doc_id").alias("image"))
    made = rows.select("doc_id", images.prepare(F.col("image"), LONGEST_SIDE).alias("i"))
    long = lambda c: F.col(f"i.{c}").cast("long").alias(c)
    return made.select("doc_id", long("width"), long("height"), F.col("i.blank").alias("blank"), long("new_width"), F.col("i.error").alias("error"))
