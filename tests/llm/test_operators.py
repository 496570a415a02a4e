"""Each operator on small hand-made tables: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import base64
import html
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, components, decontaminate, html_text, language, licences, line_dedup, near_dedup, pii, quality, topk
from tests.llm import brute

rng = random.Random(7)
VOCAB = [f"w{k}" for k in range(400)]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(r.choice(VOCAB) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


# exact top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def best_of(rows, k=5):
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in rows:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows if i != q)[:k]
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


def test_topk_equals_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(topk, "QUERY_GROUP_BLOCKS", 1)
    r = np.random.default_rng(1)
    rows = [(int(i), r.normal(size=40).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(400, None), (450, [1.0, None] + [0.0] * 38), (451, [float("nan")] * 40), (452, [float("inf")] * 40), (None, [1.0] * 40)]
    assert {tuple(x) for x in topk.every_fiftieth(vectors(spark, rows)).collect()} == best_of(rows)


def test_topk_of_few_and_of_none(spark):
    assert [tuple(x) for x in topk.every_fiftieth(vectors(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])])).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.every_fiftieth(vectors(spark, [])).isEmpty()


# personal data

PII_TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y.z.w-1.é@a.b mail@q 1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 é",
    "4111-1111 1111 1111 4111 1111 1111 1112 +1 (582) 555-6684- +49.30.1234567 +1 2 😀 +4 123456789 5",
    "a@b.c " * 700 + "1.2.3.4 " * 700,
    "1" * 20000 + " " + "a" * 20000 + "@" + "b." * 9000 + " +1" + " " * 20000,
    "9" * 20000 + "." + "1.2" * 9000,
]


def test_pii_base_spans_and_added_ones(spark):
    rows = [*enumerate(PII_TEXTS), (100, "write to joe [at] host [dot] org now"), (3, "again a@b.cd")]
    found = pii.personal_data(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    want = sorted((i, brute.sha(",".join(brute.base_spans(t)))) for i, t in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in found) == want
    for r in found:
        counts = [sum(s.startswith(k) for s in r.spans.split(",")) for k in brute.KINDS]
        assert sum(counts) == r.n_spans == r.n_added + sum(r[f"n_{k}"] for k in brute.KINDS)
    assert "email:9:32" in by_id(pii.personal_data(documents(spark, rows)).filter("doc_id = 100"))[100].spans
    assert pii.personal_data(documents(spark, [])).isEmpty()


def test_topk_of_large_components_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = np.random.default_rng(2)
    for scale in (1e6, 1e8, 1e30):
        rows = [(int(i), (r.normal(size=40) * scale).astype(np.float32).tolist()) for i in range(120)]
        rows += [(120 + i, rows[3][1]) for i in range(8)]  # ties
        rows += [(200 + i, r.normal(size=40).astype(np.float32).tolist()) for i in range(40)]
        got = {tuple(x) for x in topk.every_fiftieth(vectors(spark, rows)).collect()}
        held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        assert got == {(q, n, i, held(s)) for q, n, i, s in best_of(rows)}, scale


# licences


def test_licences_and_inheritance(spark):
    apache = licences.TEMPLATES["Apache-2.0"][1]
    rows = [
        ("LICENSE", apache), ("a/x.py", "Released under the MIT License.\n" + prose(300)), ("a/y.py", prose(50)),
        ("a/b/COPYING", licences.TEMPLATES["GPL-3.0"][2]), ("a/b/c/z.py", prose(20)), ("a/b/c/z.py", prose(20)), (None, None), ("n.py", ""),
    ]
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, share int")
    got = sorted((r.path or "", r.licence, r.origin) for r in licences.licences(files).collect())
    assert got == sorted([
        ("LICENSE", "Apache-2.0", "own"), ("a/x.py", "MIT", "own"), ("a/y.py", "Apache-2.0", "directory"), ("a/b/COPYING", "GPL-3.0", "own"),
        ("a/b/c/z.py", "GPL-3.0", "directory"), ("a/b/c/z.py", "GPL-3.0", "directory"), ("", "Apache-2.0", "directory"), ("n.py", "Apache-2.0", "directory"),
    ])
    assert licences.licences(files.limit(0)).isEmpty()


def test_licence_lines_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    text = {r.doc_id: r.text for r in docs.collect()}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for r in licences.all_licences(docs, pages).collect():
        assert {k for k, v in marks.items() if v in text[r.id]} == {r.own_licence} - {None} == {r.licence} - {None}
        assert (r.kind, r.path, r.origin) == ("document", None, "own" if r.licence else "none")


def test_licences_of_pages_go_down_their_addresses(spark):
    apache = licences.TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, "https://a.org/lib/LICENSE?raw=1", apache), (2, "http://a.org/lib//src/x.html#top", prose(30)), (3, "https://a.org/other/y", prose(30)),
        (4, "https://b.org/z", None), (None, None, "Released under the MIT License."), (2, "ftp://a.org/lib/src/x.html", prose(5)),
    ]
    docs = spark.createDataFrame([(7, None)], "doc_id long, text string")
    got = sorted((r.kind, r.id or 0, r.path or "", r.licence or "", r.origin) for r in licences.all_licences(docs, spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [
        ("document", 7, "", "", "none"), ("page", 0, "", "MIT", "own"), ("page", 1, "a.org/lib/LICENSE", "Apache-2.0", "own"),
        ("page", 2, "a.org/lib/src/x.html", "Apache-2.0", "directory"), ("page", 2, "a.org/lib/src/x.html", "Apache-2.0", "directory"),
        ("page", 3, "a.org/other/y", "", "none"), ("page", 4, "b.org/z", "", "none"),
    ]


def test_licences_do_not_depend_on_the_number_of_files(spark, monkeypatch):
    lines = [
        ("MIT", "foolib is released under the MIT License."),
        ("MIT", "This file is released under the MIT License."),
        ("Apache-2.0", "Copyright Jane Roe. Licensed under the Apache License, Version 2.0."),
        ("MIT", f"{prose(40, 1)} Released under the MIT License. {prose(40, 2)}"),
        ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0"), ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0 (c) Jane Roe"),
        ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), (None, "SPDX-License-Identifier: Foo"), (None, "SPDX-License-Identifier: AGPL-3.0"),
        (None, prose(60, 3)), (None, "The terms of use and the conditions of the work."),
        ("Apache-2.0", licences.TEMPLATES["Apache-2.0"][1].replace(" ", "\n", 6) + " " + prose(90, 4)),
    ]
    files = spark.createDataFrame([(str(k), t) for k, (_, t) in enumerate(lines)], "path string, text string")
    counts, seen = licences.document_counts, []
    for times in (1, 1000, 1000000):
        monkeypatch.setattr(licences, "document_counts", lambda f, t: tuple(times * x for x in counts(f, t)))
        seen.append({int(r.path): (r.own_licence, round(r.cosine, 9)) for r in licences.matched(files, licences.TEMPLATES).collect()})
        assert [seen[-1][k][0] for k in range(len(lines))] == [name for name, _ in lines]
    assert seen[0] == seen[1] == seen[2]

    # the weights of a corpus in which the templates' words are in a tenth of the files, and grows
    for total in (10**3, 10**6, 10**9):
        monkeypatch.setattr(licences, "document_counts", lambda f, t: (total, np.full(len(t), total / 10)))
        got = {int(r.path): r.own_licence for r in licences.matched(files, licences.TEMPLATES).collect()}
        assert [got[k] for k in range(len(lines))] == [name for name, _ in lines]


# language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language.languages(docs).collect() if r.held_out]
    assert np.mean([true[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("score"))
    odd = spark.createDataFrame([(-1, None, None, 1), (-2, "", "en", 1), (-3, "12 !? \0", "en", 1), (-4, "ẞ İ", None, 1), (None, "the", "en", 1)], docs.schema)
    rows = language.languages(docs.union(odd)).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert [got[-k] for k in (1, 2, 3)] == ["und"] * 3 and got[-4] != "und" and len(rows) == docs.count() + 5
    assert language.languages(docs.limit(0)).isEmpty()
    kept = language.in_known_language(docs.union(odd))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 2
    again = docs.limit(1).select("*", F.explode(F.expr("sequence(1, 9000)")).alias("k")).drop("k")
    assert language.trained(docs.union(again)) is not None
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.languages(unlabelled).collect()} == {"und"}


def test_language_sample_counts_usable_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang in ('en', 'de')")
    used = docs.filter("lang = 'de'").limit(1).select(F.explode(F.expr("sequence(1, 60000)")).alias("k"), "text", "lang")
    odd = used.select(F.expr("if(k % 2 = 0, -k, -1)").alias("doc_id"), F.expr("if(k % 2 = 0, '12 !', text)").alias("text"), "lang")
    sizes = []
    monkeypatch.setattr(language, "fit", lambda x, langs: sizes.append({s: langs.count(s) for s in set(langs)}))
    language.trained(docs, 100)
    language.trained(docs.union(odd), 100)
    assert sizes[0] == sizes[1] == {"en": 50, "de": 50}


def test_language_stage_without_labels_and_with_some(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 !?", None), (-3, "a word", None)], docs.schema)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).union(odd)
    kept = language.in_known_language(unlabelled).collect()
    assert len(kept) == docs.count() + 1 and {r.lang for r in kept} == {None}
    true = {r.doc_id: r.lang for r in docs.collect()}
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = language.in_known_language(some).collect()
    assert len(got) == len(true) and np.mean([r.lang == true[r.doc_id] for r in got]) > 0.95
    assert all(r.lang == true[r.doc_id] for r in got if r.doc_id % 5)


# quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.quality(docs, labels).collect() if r.held_out and r.doc_id in true]
    good, bad = ([r.score for r in held if true[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([true[r.doc_id] == r.predicted for r in held]) > 0.97


def test_quality_without_labels_and_with_odd_texts(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "\n\n"), (4, prose(20000)), (None, "x"), (1, "again")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, none).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 1, 1), (2, None, 0)], none.schema)
    assert {r.predicted for r in quality.quality(docs, ones).collect()} == {1}
    assert quality.quality(docs.limit(0), ones).isEmpty()


# decontamination


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, block_chars):
    items = [(k, prose(rng.choice([3, 9, 10, 11, 40]), k)) for k in range(25)] + [(50, None), (51, ""), (52, prose(40, 3)), (None, prose(12, 5))]
    copies = [f"{prose(5)} {t.upper()}! {prose(4)} {t}" for _, t in items[:12]]
    texts = [None, "", prose(3000), " ".join(copies), *copies, copies[0], items[1][1], ("w1 " * 4000).strip(), prose(3) + " " + items[-1][1]]
    docs = documents(spark, list(enumerate(texts))).withColumn("spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated_spans(docs, bench, 10, block_chars)
    got = {r.doc_id: r for r in found.collect()}
    want = brute.contamination(texts, items)
    for k, (n_words, n_hit, n_items, digest) in enumerate(want):
        r = got[k]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), len(r.item_ids)) == (n_words, n_hit, n_items)
        assert brute.sha(",".join(r.item_ids)) == digest
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, w in enumerate(want) if not w[1]}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()


def test_fm_index_counts_and_places():
    text = np.array([1, 2, 1, 2, 1, 4, 2, 1, 1, 2, 4, 0])  # 4 parts the runs
    index = decontaminate.FMIndex(text, 3)
    low, high = index.search(np.array([[1, 2], [2, 1], [1, 0], [3, 0]]), np.array([2, 2, 1, 1]))
    assert [sorted(index.locate(np.arange(a, b)).tolist()) for a, b in zip(low, high)] == [[0, 2, 8], [1, 3, 6], [0, 2, 4, 7, 8], []]


# html

PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy now</div><div id=cookie-notice>We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>First&nbsp; <b>bold
text</b>.<p>Second &lt;x&gt; &#233;<br>third<div class="ad slot">Ad</div><ul><li>one<li>two</ul><form><input><label>Mail</label></form>
<section class="comments"><p>Reader says</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html_text_of_marked_pages():
    want = ["Head & line", "First bold text.", "Second <x> é", "third", "one", "two"]
    assert html_text.main_text(PAGE).split("\n\n") == want


def test_html_text_by_line_blocks_alone():
    body = "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(6))
    menu = "".join(f"<div><a href=x>Item {k}</a></div>" for k in range(8))
    got = html_text.main_text(f"<body><div>{menu}</div><div>{body}</div><div>{menu}</div>").split("\n\n")
    assert [g[-2:] for g in got] == [f"{k}." for k in range(6)]


@pytest.mark.parametrize(
    "names", ["class='content has-sidebar'", "class=with-sidebar", "class=content-sidebar-wrap", "class=no-comments", "id=header-and-content"]
)
def test_html_text_in_wrappers_named_like_what_stands_beside(names):
    for tag in ("article", "main", "section"):
        page = f"<body><div class=nav-menu><p>Menu</div><div {names}><{tag}><p>First one.<p>Second one.</{tag}></div><div id=comment-list><p>Reader</div>"
        assert html_text.main_text(page) == "First one.\n\nSecond one.", tag


def test_html_text_article_ends_an_open_mark():
    for before in ("<div class=ad>Buy", "<div class='ad ad-300x250'><p>Buy", "<aside>Buy", "<div class=comments>", "<form>", "<div class=sidebar>"):
        assert html_text.main_text(f"<body>{before}<article><p>First<div class=ad>Ad</div><p>Second</article>") == "First\n\nSecond", before
    beside = "<aside><article>Teaser</article></aside><ol class=comment-list><li><article class=comment-body>Reader</article></ol>"
    article = "<article><p>First</p><section class=comments><article>Reader</article></section></article>"
    assert html_text.main_text(f"<body>{beside}{article}{beside}<article class=ad>Buy</article>") == "First"


def test_html_text_keeps_every_stretch():
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(5))
    half = lambda a, b: "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(a, b))
    ends = lambda page: [g[-2:] for g in html_text.main_text(page).split("\n\n")]
    want = [f"{k}." for k in range(6)]
    assert ends(f"<body><ul>{links}</ul>{half(0, 3)}<ul>{links}</ul>{half(3, 6)}<ul>{links}</ul>") == want
    assert ends(f"<body><p>{'long ' * 2000}0.</p><ul>{links}</ul>{half(1, 6)}") == want
    assert ends(f"<body><article>{half(0, 2)}</article>{'<div>Between</div>' * 4}<article>{half(2, 6)}</article>") == want
    label = "<p>See:</p><div><a href=x>A long link that says much</a></div><p>And:</p>"
    assert ends(f"<body>{half(0, 6)}<ul>{links}</ul>{label}<ul>{links}</ul>") == want


def test_html_text_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<p>open <b>text"), (None, "u", "&am"), (5, "u", "<article></article>"), (6, "u", "<" * 5000)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, text int")
    got = html_text.extracted(pages).collect()
    assert len(got) == 7 and [r.text for r in got][:4] == ["", "", "", "open text"] and got[5].n_chars == 0
    assert html_text.extracted(pages.limit(0)).isEmpty()


# line dedup


def test_line_dedup_equals_brute_force(spark):
    passage = [prose(18, 900 + k) for k in range(6)]
    texts = [
        "\n".join([prose(10), *passage, prose(60)]), None, "", "\n\n \n",
        "\n".join(["", *passage[1:5], "", prose(8)]), "\n".join([prose(5), *passage, "", "", passage[0]]),
        "\n".join(["one", "two"] * 40), "\n".join(["x"] * 200), "short\nlines\nshort", passage[0] + "\n" + passage[1],
        "\n".join(passage[2:4]) + "\n" + prose(70, 5), prose(70, 5), "\n".join(f"a{k % 7}" for k in range(3000)),
    ]
    docs = documents(spark, list(enumerate(texts))).withColumn("removed", F.lit("own"))
    got = by_id(line_dedup.line_dedup(docs))
    for k, want in enumerate(brute.deduplicated(texts)):
        assert got[k].text == want
        lost = 0 if want is None else len(texts[k].split("\n")) - (len(want.split("\n")) if want or not got[k].n_removed else 0)
        assert got[k].n_removed in (lost, lost + 1 if want == "" else lost)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and {11} == set(range(len(texts))) - {r.doc_id for r in kept.collect()}
    assert line_dedup.line_dedup(docs.limit(0)).isEmpty()


def test_line_dedup_of_repeated_and_null_ids(spark):
    text = prose(80, 1)
    got = line_dedup.line_dedup(documents(spark, [(4, text), (4, text), (4, text + " x"), (None, text), (9, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 1), (4, 0), (4, 0), (4, 0), (9, 1)]


# byte-level BPE


def test_byte_bpe_equals_tiktoken_and_comes_back(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "a  b", " a", "a ", "x \n y\n", "a😀é <|endoftext|> 　x", "ab" * 5000, "w " * 20000, "it's​ 12!!"]
    texts += ["".join(rng.choice("ab 'sA1!\n\t\x1c\x85　é😀 .") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    vocab, pattern = byte_bpe.vocabulary(), byte_bpe.split_pattern()
    docs = documents(spark, list(enumerate(texts))).withColumn("ids", F.lit(1))
    rows = byte_bpe.decoded(byte_bpe.encoded(docs, vocab, pattern, offsets=True), vocab, pattern).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = np.frombuffer(bytes(r.ids), np.uint32)
        assert ids.tolist() == true.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert len(r.starts) == len(ids) and (not len(ids) or (r.starts[0], r.ends[-1]) == (0, len(text)))
        assert all(text[a:b].encode().find(true.decode_single_token_bytes(t)) >= 0 for a, b, t in zip(r.starts, r.ends, ids.tolist()))
    assert byte_bpe.round_trip(docs.limit(0), vocab, pattern).isEmpty()
    model = byte_bpe.ByteBPE(vocab, pattern)
    assert "".join(model.pieces(model.ids("é😀 a").tolist())) == "é😀 a"
    digest = {r.doc_id: r.ids_sha256 for r in byte_bpe.round_trip(docs, vocab, pattern).collect()}
    assert digest[4] == hashlib.sha256(np.array(true.encode_ordinary(" a"), np.uint32).tobytes()).hexdigest()


def test_decoding_holds_no_model_and_caches_keep_what_came_first(spark, monkeypatch):
    vocab, pattern = byte_bpe.vocabulary(), byte_bpe.split_pattern()
    model, tokens = byte_bpe.ByteBPE(vocab, pattern), byte_bpe.TokenBytes(vocab)
    assert tokens.bytes_of(model.ids("é😀 a  b")) == "é😀 a  b".encode() and not hasattr(tokens, "model")
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 20_000)
    text = " ".join(f"word{k}" for k in range(2000))
    want = byte_bpe.ByteBPE(vocab, pattern)._run(text)
    assert model.ids("x " + text).tobytes().endswith(want[8:])
    for seen in (model.words_seen, model.pieces_seen):
        assert 5_000 < seen.n_bytes <= 20_000 and seen.n_bytes == sum(seen._size(*x) for x in seen.items())
    assert "word0" in model.words_seen


def test_texts_do_not_go_through_the_tasks_that_decode(spark):
    import corpus_pipeline

    rows = corpus_pipeline.tokenize(spark, documents(spark, [(1, "a b"), (2, None)]), "")
    decoding = re.split(r"\bstruct\(", rows._jdf.queryExecution().optimizedPlan().toString())[1]
    assert "ids, ids#" in decoding.split("AS row")[0] and ", text, " not in decoding.split("AS row")[0]
    assert [(r.doc_id, r.exact) for r in rows.orderBy("doc_id").collect()] == [(1, True), (2, True)]


def test_no_task_encodes_and_decodes(spark):
    import corpus_pipeline

    docs = documents(spark, [(1, "a b"), (2, None)])
    vocab, pattern = byte_bpe.vocabulary(), byte_bpe.split_pattern()
    for rows in (corpus_pipeline.tokenize(spark, docs, ""), byte_bpe.round_trip(docs, vocab, pattern)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert rows.count() == 2


def test_an_encoding_task_keeps_no_words_and_returns_memory(monkeypatch):
    import pyarrow as pa

    from cohortlens.llm import stage

    def of(batches):
        held = [np.ones(1000) for _ in range(40_000)]  # 320 MB in small blocks, but for one behind them
        kept.append(np.ones(1000))
        del held
        yield from batches

    def mb():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    kept, before = [], mb()
    assert len(list(stage.lean(of)(iter([pa.record_batch([pa.array([1])], ["x"])])))) == 1
    assert mb() - before < 100
    parts = byte_bpe._Parts(str.encode)
    assert parts["a"] == b"a" and parts.n_bytes
    parts.clear()
    assert not parts and not parts.n_bytes


# near-duplicates


def variant(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 8)
    bases = [prose(200, k) for k in range(6)]
    texts = [None, "", "one", "ONE", "one two", prose(4000, 99), prose(4000, 99)]
    texts += [variant(b, s / 1000, 10 * k + s) for k, b in enumerate(bases) for s in (0, 5, 10, 15, 20, 25, 30, 40, 60)]
    texts += [variant(bases[0], 0.03, 500 + k) for k in range(60)] + [bases[1]] * 30
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = {i: texts[k] for i, k in enumerate(order)}
    got = by_id(near_dedup.near_duplicates(documents(spark, docs.items()).withColumn("kept", F.lit(1)), size, percent))
    want = brute.components(docs, size, percent)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = prose(60, 1), prose(60, 2)
    docs = documents(spark, [(5, a), (5, b), (7, a), (8, b), (None, a), (2, ""), (2, "")])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False)]
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 2, 5, 5]
    assert near_dedup.near_duplicates(docs.limit(0)).isEmpty()


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(5, a), (5, b), (7, a), (8, b), (None, a), (None, a + " more"), (None, c), (None, c), (9, c + " x"), (4, prose(60, 4)), (4, prose(60, 4)), (None, prose(60, 5)), (2, ""), (2, "")]
    docs = documents(spark, rows)
    kept = near_dedup.one_of_each(docs)
    got = sorted((r.doc_id or -1, r.text) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted([(5, a), (5, b), (9, c + " x"), (4, prose(60, 4)), (-1, prose(60, 5)), (2, ""), (2, "")])
    own = documents(spark, [(3, a), (1, a + " more"), (6, b), (7, "")])
    assert sorted(r.doc_id for r in near_dedup.one_of_each(own).collect()) == [1, 6, 7]
    assert near_dedup.one_of_each(docs.limit(0)).isEmpty()


def test_components_write_few_files_and_stop_at_stars(spark, monkeypatch):
    written = []
    real = components.staged
    monkeypatch.setattr(components, "staged", lambda *a: written.append(real(*a)) or written[-1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "67")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stars = spark.range(300).selectExpr("id", "id div 3 * 3 as v")
        got = components.components(stars.toDF("u", "v"), files=8).collect()
        assert {(r.node, r.component) for r in got} == {(k, k // 3 * 3) for k in range(300) if k % 3} and len(written) == 1
        assert len(written[0].inputFiles()) <= 8
        chain = spark.range(300).selectExpr("id as u", "id + 1 as v")
        got = components.components(chain, files=8).collect()
        assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(1, 301)}
        assert len(written) > 2 and all(len(x.inputFiles()) <= 32 for x in written)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(60, 60), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: got[k] for k in range(1, 41)} == dict.fromkeys(range(1, 41), 0)
    assert {got[k] for k in range(101, 130)} == {100} and 60 not in got


def test_html_text_without_marks_loses_bars_and_notices():
    body = [f"Paragraph number {k} goes on for a while, as paragraphs of an article do." for k in range(4)]
    plain = "".join(f"<div>{x}</div>" for x in body)
    page = f"<body><div>Site menu words here</div>{plain}<p>We use cookies to improve this site.</p><div>Copyright 2024 The Site</div></body>"
    assert html_text.main_text(page).split("\n\n") == body
    for name in ("id='post-comments'", "class='user-comments'", "class='comments-wrapper'", "id=respond"):
        for tag in ("div", "section"):
            page = f"<body>{plain}<{tag} {name}><p>Nice!</p><p>A reader says a whole sentence here.</p></{tag}></body>"
            assert html_text.main_text(page).split("\n\n") == body, name
    for name in ("main-menu", "site-footer", "left-sidebar", "newsletter-signup", "top-banner"):
        assert html_text.main_text(f"<body><div class={name}><p>Some sentence stands here.</p></div>{plain}").split("\n\n") == body, name
    # a name that holds all the text means something else
    assert html_text.main_text(f"<body><div class='right-sidebar'>{plain}</div>").split("\n\n") == body


def test_html_text_runs_the_distribution_on_every_page(monkeypatch):
    import pyarrow.parquet as pq

    calls, regions = [], html_text.main_regions
    monkeypatch.setattr(html_text, "main_regions", lambda *x: calls.append(1) or regions(*x))
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    hits = [0, 0, 0]
    for page in pages:
        # the supplied pages: one article without lists, with <br> and <p> alone
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        cut = re.sub(r"<(?:/?(?:p|h[1-6]|li|ul|ol|blockquote|br)|table|tr|td|th|/table|/tr|/td|/th)(?: [^>]*)?>", "\n", re.sub(r"(?s)<(div|aside|form|script|style)[ >].*?</\1>", "\n", inner))
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in cut.split("\n")]
        want = [x for x in want if x]
        got = html_text.main_text(page).split("\n\n")
        hits[0] += len(set(want) & set(got))
        hits[1] += len(set(got))
        hits[2] += len(set(want))
    assert len(calls) == len(pages)
    assert hits[0] / hits[1] > 0.98 and hits[0] / hits[2] > 0.98, hits


def test_html_text_of_deep_pages_takes_time_in_proportion():
    import time

    def seconds(n):
        page = "<body>" + "<div><a>" * n + "word. " * 9 + "</b></i>" * n + "</a></div>" * n
        start = time.process_time()
        assert html_text.main_text(page) is not None
        return time.process_time() - start

    seconds(100)
    assert seconds(16_000) < 12 * max(0.05, seconds(4_000))


def test_pii_of_very_many_spans(spark):
    """Many base spans and many further ones in one text, beside and inside each other."""
    r = random.Random(4)
    parts = [r.choice(["a@b.cd", "joe [at] host [dot] org", "555-123-4567", "+49 30 1234567", "10.20.30.40", "4111 1111 1111 1112", "word"]) for _ in range(50_000)]
    rows = [(1, " ".join(parts)), (2, " ".join(parts[:300])), (3, " ".join(["joe [at] host [dot] org"] * 30)), (4, "a@b.cd " * 30)]
    found = {x.doc_id: x for x in pii.candidates(documents(spark, rows)).collect()}
    for i in (2, 3, 4):
        base, loose = [(b.start, b.end) for b in found[i].base], [(x.start, x.end) for x in found[i].loose]
        assert loose == sorted(loose) and not any(b[0] < x[1] and x[0] < b[1] for x in loose for b in base)
    assert len(found[3].loose) == 30 and not found[4].loose
    n = lambda i, text: sum(s == text for s in (parts if i == 1 else parts[:300]))
    for i in (1, 2):
        assert sum(x.kind == "email" for x in found[i].loose) == n(i, "joe [at] host [dot] org")
    want = [f"{b.kind}:{b.start}:{b.end}" for b in sorted(found[1].base, key=lambda b: (brute.KINDS.index(b.kind), b.start))]
    assert want == brute.base_spans(rows[0][1])


def test_a_model_learns_the_languages_with_most_rows(spark):
    rows = [(i, f"some words of text {i}", "aa" if i < 30 else f"x{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained(docs, 100, 1)
    assert [s for names in model.languages.values() for s in names] == ["aa"]
