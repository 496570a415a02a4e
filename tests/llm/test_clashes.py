"""Columns of users that have the names of the operators' own: they come back as they were."""

from __future__ import annotations

import pytest

from cohortlens.llm import byte_bpe, decontaminate, language, licences, line_dedup, near_dedup

NAMES = (
    "row _row own_row _text _lines _cut _th _id _gone _text_hash _folder _given folder given owner lines cut gone gone_id gone_th th id bytes "
    "lang_pred score ids starts ends decoded n_lines n_removed removed n_words n_hit n_items contaminated items_sha256 component_id kept "
    "n_shingles digest rep node order p h1 h2 w own_licence cosine share licence origin is_licence_file depth"
).split()
RUN = " ".join(f"word{k}" for k in range(60))
TEXTS = ["The old house and the river", RUN + "\nand the end of it", "Then " + "\n" + RUN, "The old house and the river", "no", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, *[f"{n} of {k}" for n in NAMES]) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def check(df, replaced, kept_rows=None):
    got = df.collect()
    assert kept_rows is None or len(got) == kept_rows
    for r in got:
        assert all(r[n] == f"{n} of {r['doc_id']}" for n in NAMES if n not in replaced)


def test_operators_replace_only_what_they_say(docs):
    vocab, pattern = byte_bpe.vocabulary(), byte_bpe.split_pattern()
    ids = byte_bpe.encoded(docs, vocab, pattern, offsets=True)
    check(ids, {"ids", "starts", "ends"}, 7)
    check(byte_bpe.decoded(ids, vocab, pattern), {"ids", "starts", "ends", "decoded"}, 7)
    model = language.trained(docs)
    check(language.identified(docs, model), {"lang_pred", "score"}, 7)
    check(line_dedup.line_dedup(docs), {"n_lines", "n_removed", "removed"}, 7)
    files = docs.withColumnRenamed("source", "path")
    check(licences.licences(files), {"own_licence", "cosine", "share", "licence", "origin", "is_licence_file"}, 7)


def test_stages_keep_every_column(spark, docs):
    items = spark.createDataFrame([("i", RUN)], "item_id string, text string")
    for stage, n in (
        (language.in_known_language, 5), (line_dedup.without_repeated_lines, 7), (near_dedup.one_of_each, None),
        (lambda d: decontaminate.without_contaminated(d, items), 5),
    ):
        done = stage(docs)
        assert done.columns == docs.columns
        check(done, set(), n)
