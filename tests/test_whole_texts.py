"""Queries without SQL take whole texts: what stands behind a long lead is seen."""

import hashlib

from datamill.plans.catalogue import QUERIES


def results(spark, folder, name, text, doc_id=3):
    rows = [(doc_id, text, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return QUERIES[name](spark, str(folder)).collect()


def test_outdated_calls_behind_a_long_lead(spark, tmp_path):
    (plain,) = results(spark, tmp_path / "a", "q38_outdated_calls", "word " * 400)
    (found,) = results(spark, tmp_path / "b", "q38_outdated_calls", "word " * 400 + "\nfrom qiskit.opflow import X\n")
    assert plain["message"] is None and found["message"]


def test_functions_and_structure_behind_a_long_lead(spark, tmp_path):
    text = "word " * 400 + "def test_it assert the end"
    (function,) = results(spark, tmp_path / "a", "q61_function_extract", text, doc_id=1)
    assert function["path"] == "shown_1" and function["docstring"] == hashlib.md5(text.encode()).hexdigest()
    (checked,) = results(spark, tmp_path / "b", "q62_syntax_check", text)
    assert checked["error"] is None


def test_items_of_any_length_are_found(spark):
    from datamill.operators.dedup import contained_items

    text = "one two three\nfour five six seven eight nine ten eleven twelve thirteen"
    items = ["o three\nfo", "ee\nfour five six seven eight nine ten elev", "two", "wo thr", "hree", "two  three", "three four", "", "twelve thirteen", text, "ne two three\nfour five six seven eight nine", None]
    docs = spark.createDataFrame([(1, text), (2, "x " + text + " y"), (3, ""), (4, None), (5, "three")], "doc_id long, text string")
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((d["doc_id"], i) for d in docs.collect() for i, x in enumerate(items) if x and d["text"] and x in d["text"])
    assert sorted(map(tuple, contained_items(rows, docs).collect())) == want
    assert contained_items(rows.where("item_id < 0"), docs).count() == 0


def test_items_in_very_long_documents(spark):
    """Work grows with the length of a text, by words as by characters (once with its square: some minutes for these)."""
    import time

    from datamill.operators.dedup import contained_items, documents_of_items

    text = " ".join(f"w{i}\U0001f600" for i in range(60_000))
    items = ["w59990\U0001f600 w59991\U0001f600 w59992\U0001f600", "w5999\U0001f600 w6000\U0001f600 w6001\U0001f600 w6002\U0001f600 w6004\U0001f600", "\U0001f600 w41", "w7\U0001f600", "w7\U0001f600", "\U0001f600w"]
    docs = spark.createDataFrame([(1, text), (2, "w7\U0001f600"), (3, None)], "doc_id long, text string")
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    begin = time.monotonic()
    want = [(d["doc_id"], i) for d in docs.collect() for i, x in enumerate(items) if x in (d["text"] or "")]
    assert sorted(map(tuple, contained_items(rows, docs).collect())) == want
    assert {r["item_id"]: r["documents"] for r in documents_of_items(rows, docs).collect()} == {0: 1, 2: 1, 3: 2, 4: 2}
    assert time.monotonic() - begin < 60


def test_deep_tables_of_contents_keep_all_levels(spark):
    from datamill.sources import files

    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(40)], "id long, parent long, ord long")
    got = {r["id"]: r["depth"] for r in files.toc_paths(nodes).collect()}
    assert got == {i: i for i in range(40)}
