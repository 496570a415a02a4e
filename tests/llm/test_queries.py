"""The registered queries against their SQL, and the pipeline as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from cohortlens.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences, type_differences
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con, df = connect(SF), QUERIES[name](spark, SF)
    assert type_differences(df, con, ORACLE[name]) == {}
    assert differences(df, con, ORACLE[name]) == {}


def test_all_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry_point.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry_point.queries()


def test_pii_query_equals_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_pii"](spark, SF).collect():
        assert r.base_sha256 == brute.sha(",".join(brute.base_spans(text[r.doc_id])))


def test_bpe_query_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("want"))
    assert QUERIES["op9_byte_bpe"](spark, SF).join(docs, "doc_id").filter("decoded_sha256 = want").count() == docs.count()


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, last, SF).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns and now.join(last, "doc_id", "left_anti").isEmpty()
            before, last = last, now
    text = {r.doc_id: r.text for r in last.collect()}
    assert now.filter("exact").count() == len(text) == now.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x[1] for x in brute.contamination(text.values(), items))
    sets = [brute.components(text, 5, 80)]
    assert all(i == c for i, (_, c) in sets[0].items())
    clean = {i: t for i, t in text.items() if t}
    assert brute.deduplicated([clean[i] for i in sorted(clean)]) == [clean[i] for i in sorted(clean)]
    assert before.count() - len(text) == sum(bool(x[1]) for x in brute.contamination([r.text for r in before.collect()], items))


def test_stages_on_odd_documents(spark, tmp_path):
    """Null and repeated ids, empty texts, repeated rows, clashing columns and no rows, as a chain."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.filter("lang = 'en' and length(text) between 400 and 3000").orderBy("doc_id").select("text").limit(12).collect()
    rows = [(k, r.text) for k, r in enumerate(text)] + [(3, text[3].text), (None, text[4].text), (None, None), (5, text[6].text + " more"), (90, ""), (91, None), (92, "12 34")]
    names = ["row", "own_row", "n_words", "spans", "score", "lines", "ids", "removed", "component_id", "text_hash"]
    odd = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[f"{n} {i}" for n in names]) for i, t in rows], base.schema.simpleString()[7:-1].replace(":", " ") + ", " + ", ".join(f"`{n}` string" for n in names))
    (tmp_path / "sf").mkdir()
    odd.write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    last = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, last, str(tmp_path / "sf")).write.parquet(f"{tmp_path}/{name}")
        last = spark.read.parquet(f"{tmp_path}/{name}")
        assert last.columns == odd.columns
        assert all(r[n] == f"{n} {r.doc_id}" for r in last.collect() for n in names)
    texts = [r.text for r in last.collect()]
    assert len(texts) == len(set(texts)) <= 13 and None not in texts and "" not in texts
    done = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert sorted(r.doc_id for r in done.collect() if r.doc_id is not None) == sorted(r.doc_id for r in last.collect() if r.doc_id is not None)
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path / "sf"))
        assert empty.isEmpty()


def test_the_pipeline_leaves_one_staged_table(spark):
    import os

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/llm"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(set(os.listdir(folder)) - before) == 1 and done.count() > 0


def test_bpe_query_equals_tiktoken(spark):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = plain.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
