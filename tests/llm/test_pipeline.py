import random

import corpus_pipeline
from datamill.tables import materialize

WORDS = "the cat sat near old trees while birds sang loudly again over green hills and rivers".split()


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(120) + (" " + passage if i % 10 == 0 else ""), "en", f"s{i % 3}") for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(600 + i, "!! ".join(prose(100).upper().split()), "en", "s1") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars")
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, at, str(tmp_path)), "test")
        if stage is not corpus_pipeline.encode:
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        at = out
    good = seen["quality classifier"]
    assert len([i for i in good if i >= 600]) <= 3 and len([i for i in good if i < 600]) >= 127
    assert set(seen["near-duplicates"]) == {i for i in good if not 500 <= i < 600 or i - 500 not in good}
    repeated = [r["text"] for i, r in sorted(seen["repeated passages"].items()) if i < 120 and i % 10 == 0]
    assert sum(passage in t for t in repeated) == 1 and all(r["n_chars"] == len(r["text"]) for r in seen["repeated passages"].values())
    assert set(seen["tokens"]) == set(seen["source mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
