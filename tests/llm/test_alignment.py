"""Alignment of tokenizers against a plain version that reads whole texts by the libraries."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortlens.llm import alignment
from cohortlens.llm.byte_bpe import byte_of_character
from tests.llm.test_packing import ODD

TEXTS = [*ODD, "▁ a ▁b", "日本語のテキスト is 中文 ­ x", "naïve café ½ ﬁ é 🤦🏽‍♂️ 𝒳", "\x00 a\x01b", "a" * 3000, "same words same words", "same words", "� ퟿"]


def plain(texts):
    spec, back = json.load(open(public_tokenizers.path("byte_bpe_50k.json"))), byte_of_character()
    byte_level = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    first, second = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    rows, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_bytes = [byte_level[i] for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a = b = []
        if not a:
            rows.append((0, 0, 0, [], ""))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, groups, x, y = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end), b_ends.index(end)
            links.append((a[p], b[q]))
            groups.append(",".join(map(str, a[x : p + 1])) + "|" + ",".join(map(str, b[y : q + 1])))
            x, y = p + 1, q + 1
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(n_a, n_b, n, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for n_a, n_b, n, ls, sha in rows]


def found(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}


def test_alignment_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, links string").repartition(3)
    assert found(alignment.alignment(docs)) == dict(enumerate(plain(TEXTS)))
    assert alignment.alignment(docs.limit(0)).isEmpty()


def test_alignment_query_equals_plain_version(spark):
    from cohortlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert found(QUERIES["op12_alignment"](spark, sf)) == dict(zip([i for i, _ in rows], plain([t for _, t in rows])))


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r)[1:7] for r in alignment.alignment(docs).collect())
    assert got == [(0, 0, 0, 0, 0, 0)] + [(2, 2, 2, 2, 2, 6)] * 3


def test_groups_are_the_hashed_text(spark):
    docs = spark.createDataFrame([(1, "日本 x"), (2, "a b")], "doc_id long, text string")
    for r in alignment.aligned(docs, keep_groups=True).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and len(r.groups.split(";")) == r.n_groups == len(r.links) // 4


def test_spans_refine_split_characters():
    aligner = alignment.Aligner(alignment.vocabulary(), alignment.piece_model())
    text = " 🤦🏽‍♂️ ᚠ x͸ end"
    a, a_ends, b, b_ends, same = aligner.spans(text)
    assert same and a_ends.tolist() == np.cumsum(aligner.sizes[0][a]).tolist() and b_ends.tolist() == np.cumsum(aligner.sizes[1][b]).tolist()
    assert any(aligner.processor.is_byte(int(i)) for i in b) and alignment.refined_ends(np.array([0, 0]), np.array([4, 4]), np.array([2, 2])).tolist() == [2, 4]
