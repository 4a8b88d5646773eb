"""Every query of the subpackage, and the pipeline, over whole tables against plain versions."""

import base64
import hashlib
import math
import os
import re

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from test_chat import plain as plain_chat
from test_lattice import brute as plain_links
from test_rules import brute as plain_counts

from datamill.llm import rules, toxicity
from datamill.llm.htmlblocks import blocks_of
from datamill.llm.labelled import auc, crc_fold, training_labels
from datamill.llm.q01_bpe import VOCABULARY
from datamill.llm.q06_quality import quality_params
from datamill.llm.queries import QUERIES
from datamill.tables import read_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text", "source", "lang").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in read_table(spark, SF_DIR, "labels").collect()}


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(VOCABULARY), "rb").read().splitlines())}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, doc_id, text):
    ids = encoder.encode_ordinary(text or "")
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode("utf-8", "replace"))


def rows_of(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF_DIR).collect()]


def test_op1(spark, docs, encoder):
    got = rows_of(spark, "op1_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(got) == sorted(encoded(encoder, d, t) for d, t, *_ in docs)


def test_op2(spark, docs):
    prints = [plain.shingle_fingerprint(t) for _, t, *_ in docs]
    group = plain.near_groups(set(prints))
    least = {g: min(d[0] for d, f in zip(docs, prints) if group[f] == g) for g in set(group.values())}
    want = sorted((d[0], f"{f:016x}", least[group[f]]) for d, f in zip(docs, prints))
    assert sorted(rows_of(spark, "op2_simhash", "doc_id", "fingerprint", "component_id")) == want


def test_op3(spark):
    given = [tuple(r) for r in read_table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted(rows_of(spark, "op3_chat", *names), key=repr) == plain_chat(given)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_rules"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for lang in {d[3] for d in docs}:
        mine = [d for d in docs if d[3] == lang]
        ppl = dict(zip((d[0] for d in mine), plain.kneser_ney_logs([d[1] for d in mine])))
        good = []
        for d in mine:
            r, counts = got[d[0]], plain_counts(d[1] or "")
            assert tuple(r[c] for c in rules.COUNTS) == counts and abs(r["log_ppl"] - ppl[d[0]]) < 1e-5
            assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
            if not r["base_failed"]:
                good.append(d[0])
        size = {d[0]: len((d[1] or "").encode()) for d in mine}
        # A quantile is the first value that reaches its share.
        at = lambda values, q: sorted(values)[math.ceil(q * len(values)) - 1]
        middle = at([ppl[i] for i in good], 0.5)
        away = {i: (ppl[i] - middle) * math.sqrt(size[i]) for i in good}
        low, high = at(away.values(), 0.25), at(away.values(), 0.75)
        slack = rules.FENCE * max(high - low, rules.LEAST_SPREAD)
        for d in mine:
            inside = d[0] in away and low - slack <= away[d[0]] <= high + slack
            near_edge = d[0] in away and min(abs(away[d[0]] - low + slack), abs(away[d[0]] - high - slack)) < 0.05
            assert got[d[0]]["kept"] == inside or near_edge
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values()) < 0.2 * len(got)


def test_op5(spark, docs, labels):
    table = read_table(spark, SF_DIR, "documents")
    model = toxicity.fit(table, training_labels(read_table(spark, SF_DIR, "labels"), "toxic", 3, 1))
    got = {d: (h, s, p) for d, h, s, p in rows_of(spark, "op5_toxicity", "doc_id", "held_out", "score", "predicted")}
    for doc_id, text, *_ in docs:
        held, score, predicted = got[doc_id]
        assert held == (crc_fold(doc_id, 3) == 1) and predicted == (score >= 0.7)
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, plain.toxicity_margin(model, text)))))) < 1e-4


def test_op6(spark, docs, labels):
    params = quality_params(read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels"))
    got = {d: (h, s, p) for d, h, s, p in rows_of(spark, "op6_quality", "doc_id", "held_out", "score", "predicted")}
    for doc_id, text, *_ in docs:
        held, score, predicted = got[doc_id]
        assert held == (crc_fold(doc_id, 4) == 2) and predicted == (score >= 0.7)
        assert abs(score - plain.network_score(params, text)) < 1e-7
    held = [d for d in labels if got[d][0] and labels[d]["quality"] is not None]
    assert auc(np.array([got[d][1] for d in held]), np.array([labels[d]["quality"] for d in held])) > 0.8


def test_op7(spark):
    rows = [tuple(r) for r in read_table(spark, SF_DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert sorted(rows_of(spark, "op7_embeddings", "vec_id", "n_links", "component_id"), key=repr) == plain_links(rows)


def test_op8(spark):
    pages = {r["page_id"]: r["html"] for r in read_table(spark, SF_DIR, "pages").collect()}
    got = rows_of(spark, "op8_html", "page_id", "text", "n_chars")
    assert len(got) == len(pages)
    for i, text, n in got:
        # The given pages mark their article; what is in it is read block by block.
        marked = re.search(r"<article>(.*?)</article>", pages[i], re.S)[1]
        assert text == "\n".join(b[0] for b in blocks_of(marked)) and n == len(text)


def test_op9(spark, docs):
    want = []
    for doc_id, (data, gone) in plain.without_repeats([d[:2] for d in docs]).items():
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want.append((doc_id, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(kept)))
    assert sorted(rows_of(spark, "op9_repeats", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want)


def test_op10(spark, docs):
    want = {docs[i][0]: (n, total, target, n * copies) for i, (n, total, target, copies) in plain.mixed([d[:3] for d in docs]).items()}
    got = rows_of(spark, "op10_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(want)
    for doc_id, size, total, target, taken in got:
        assert (size, total, taken) == (want[doc_id][0], want[doc_id][1], want[doc_id][3]) and abs(target - want[doc_id][2]) < 1e-6


def test_pipeline(spark, docs, encoder):
    params = quality_params(read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels"))
    good = [d for d in docs if plain.network_score(params, d[1]) >= corpus_pipeline.LEAST_QUALITY]
    prints = {d[0]: plain.shingle_fingerprint(d[1]) for d in good}
    group = plain.near_groups(set(prints.values()))
    first = {}
    for d in sorted(good):
        first.setdefault(group[prints[d[0]]], d)
    kept = sorted(first.values())
    left = plain.without_repeats([d[:2] for d in kept])
    cut = [(d[0], np.frombuffer(left[d[0]][0], np.uint8)[~left[d[0]][1]].tobytes().decode("utf-8", "ignore"), d[2]) for d in kept]
    mix = plain.mixed(cut)
    want = sorted(encoded(encoder, *cut[i][:2]) for i, (*_, copies) in mix.items() for _ in range(copies))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, SF_DIR).collect()]
    assert 0 < len(cut) < len(docs) and sorted(got) == want


def test_pipeline_takes_nulls_empty_texts_and_empty_tables(spark, tmp_path, docs):
    table, labelled = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")
    odd = spark.createDataFrame(
        [(None, docs[0][1], None, None, None), (None, None, "en", "src0", None), (-5, "", "en", None, 0), (-6, None, None, "src1", 3), (-7, " word" * 30000, "en", "src1", 1), (docs[1][0], docs[1][1], docs[1][3], docs[1][2], 7)], table.schema
    )
    table.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    at = read_table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)), "test")
        assert at.count() > 0
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labelled.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
