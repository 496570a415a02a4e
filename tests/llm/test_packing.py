"""Packing: ids of the library, places without gaps, as few sequences as plain best fit makes."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import chunks, packing

END = np.array([2], "<u4").tobytes()
ODD = [
    None, "", " ", "\n", "a", "  two  spaces \n\n and\tlines\n ", "x  y　 z  q\u0085 w\x1c b \x1c c", "don't we'll I'D 'tis",
    "é😀 ǘ " * 30, "word" * 700, "<|endoftext|> a <|endoftext|>b", "1234567 12 3.14 !!?? ...", " ​ x﻿ y", "\r\n a\r b \r c",
]


def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(sizes, capacity):
    gaps = []
    n = 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        n += at == len(gaps)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - s)
    return n


def check_places(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == best_fit([r["length"] for r in rows], capacity)


def check_pieces(rows, texts, capacity, library):
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert sorted(of) == sorted(texts)
    for i, own in of.items():
        raw = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids, "<u4").tobytes() + END
        own.sort(key=lambda r: r["piece"])
        lengths = [r["length"] for r in own]
        assert sum(lengths) * 4 == len(raw) and all(n == capacity for n in lengths[1:]) and (lengths[0] == capacity or len(raw) // 4 % capacity == lengths[0])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]


@pytest.mark.parametrize("capacity", [6, 100, 1024])
def test_plan_uses_as_few_sequences_as_best_fit(capacity):
    r = random.Random(capacity)
    for n in (0, 1, 2, 7, 60, 900):
        sizes = [min(capacity, 1 + int(r.expovariate(3 / capacity))) for _ in range(n)] + [capacity // 2] * r.randrange(4) + [1] * r.randrange(9)
        counts = {s: sizes.count(s) for s in set(sizes)}
        found = packing.plan(counts, capacity)
        assert found.sequences == best_fit(sizes, capacity)
        key, rows = (found.length << 44) + found.first, []
        for s, m in counts.items():
            for k in range(m):
                i = int(np.searchsorted(key, (s << 44) + k, "right")) - 1
                later = k - found.first[i]
                rows.append({"length": s, "sequence_id": int(found.bin[i] + later // found.per[i]), "offset": int(found.offset[i] + later % found.per[i] * s)})
        if rows:
            check_places(rows, capacity)


def test_a_plan_does_not_grow_with_the_number_of_pieces():
    r = random.Random(5)
    counts = {s: r.randrange(1, 2000) for s in range(1, 1025)}
    small, large = packing.plan(counts), packing.plan({s: n * 1_000_000 for s, n in counts.items()})
    total = sum(s * n for s, n in counts.items()) * 1_000_000
    assert len(large.length) < 2 * len(small.length) and -(-total // 1024) <= large.sequences < 1.01 * total / 1024


def test_packed_of_odd_texts(spark):
    rows = [*enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, part string").repartition(3)
    for capacity in (8, 1024):
        got = packing.packed(docs, capacity=capacity, keep_ids=True)
        found = [r.asDict() for r in got.collect()]
        check_pieces(found, dict(rows), capacity, model())
        check_places(found, capacity)
        filled = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(got).collect()}
        for r in found:
            n, raw = filled[r["sequence_id"]]
            assert raw[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and len(raw) == 4 * n <= 4 * capacity
    assert packing.packed(docs.limit(0)).isEmpty()


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = [r.asDict() for r in packing.packed(docs).collect()]
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    check_places(got, 1024)


def test_packing_query_on_whole_documents(spark):
    from cohortlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.asDict() for r in QUERIES["op11_packing"](spark, sf).collect()]
    check_pieces(rows, texts, 1024, model())
    check_places(rows, 1024)


def test_chunks_forget_and_learn_again(monkeypatch):
    from cohortlens.llm.byte_bpe import split_pattern, vocabulary
    import pyarrow as pa

    from cohortlens.llm.words import byte_rows

    tokens, library, r = packing.Tokens(vocabulary(), split_pattern()), model(), random.Random(3)
    tokens.kept_bytes = 20_000
    monkeypatch.setattr(chunks, "CALL_CHARS", 50)
    for _ in range(30):
        texts = ["".join(r.choice(["ab", "é", " ", "\n", "x" * 40, "7", ".", "　", " the"]) for _ in range(r.randrange(60))) for _ in range(20)]
        ids, bounds = tokens.ids(*byte_rows(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert tokens.found.n == len(tokens.number)


def test_many_counts_are_not_broadcast(spark, monkeypatch):
    from tests.helpers import plan_of

    docs = spark.createDataFrame([(i, "a " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(3)
    assert "BroadcastHashJoin" in plan_of(packing.packed(docs))
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 100)
    assert "SortMergeJoin" in plan_of(packing.packed(docs))


def test_few_counts_move_no_piece_and_make_no_further_files(spark, monkeypatch):
    staged, write = {}, packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, name, *a: staged.setdefault(name, write(df, name, *a)))
    texts = {i: "a b c " * (i % 40) for i in range(400)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        got = packing.packed(docs)
        files = {name: len(df.inputFiles()) for name, df in staged.items()}
        assert files["lengths"] <= packing.LEAST_FILES and got.rdd.getNumPartitions() <= files["pieces"] == 3
        staged.clear()
        monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
        joined = packing.packed(docs)
        for rows in ([r.asDict() for r in x.collect()] for x in (got, joined)):
            check_pieces(rows, texts, 1024, model())
            check_places(rows, 1024)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
