"""The operators over their whole tables, one query each, and the SQL of those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import (
    alignment, byte_bpe, decontaminate, html_text, language, licences, line_dedup, near_dedup, packing, pii, quality, repair, topk,
)
from cohortlens.llm.stage import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.all_licences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe.vocabulary(), byte_bpe.split_pattern())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_pii, op3_licences, op4_language, op5_quality, op6_decontaminate, op7_html_text,
        op8_line_dedup, op9_byte_bpe, op10_near_dedup, op11_packing, op12_alignment, op13_repair,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op6_decontaminate": rf"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
          SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
          SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
            ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM b
        ), sizes AS (
          SELECT DISTINCT len(x) AS n FROM windows
        ), places AS (
          SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes
        ), met AS (
          SELECT doc_id, i, n, item_id FROM places JOIN windows ON w[i:i + n - 1] = x
        ), words AS (
          SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id
        ), items AS (
          SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM met GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents
        ), s AS (
          SELECT *, row_number() OVER o AS n, sum(w) OVER o AS after_w, sum(w) OVER o - w AS before_w
          FROM (SELECT *, len(regexp_extract_all(line, '\S+')) AS w FROM l WHERE regexp_matches(line, '\S'))
          WINDOW o AS (PARTITION BY doc_id ORDER BY idx)
        ), runs AS (
          SELECT a.doc_id, a.n AS i, min(b.n) AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.after_w >= a.before_w + 50 GROUP BY 1, 2
          UNION
          SELECT a.doc_id, max(b.n) AS i, a.n AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.before_w <= a.after_w - 50 GROUP BY a.doc_id, a.n
        ), content AS (
          SELECT r.doc_id, i, j, string_agg(line, chr(10) ORDER BY n) AS x FROM runs r JOIN s ON s.doc_id = r.doc_id AND n BETWEEN i AND j GROUP BY 1, 2, 3
        ), later AS (
          SELECT doc_id, i, j FROM content QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1
        ), gone AS (
          SELECT DISTINCT s.doc_id, s.idx FROM s JOIN later l ON l.doc_id = s.doc_id AND n BETWEEN i AND j
        ), owned AS (
          SELECT l.doc_id, l.idx, l.line,
            last_value(CASE WHEN regexp_matches(l.line, '\S') THEN l.idx END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.idx) AS owner
          FROM l
        )
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY o.idx) FILTER (g.idx IS NULL), '') END AS text,
          count(o.idx)::INTEGER AS n_lines, count(g.idx)::INTEGER AS n_removed
        FROM documents d LEFT JOIN owned o ON o.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.idx = o.owner
        GROUP BY d.doc_id, d.text
    """,
    "op10_near_dedup": rf"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d
        ), sizes AS (
          SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
          SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
          SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * common.n >= 85 * (a.n + b.n - common.n)
        ), reach AS (
          SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
        ), least AS (
          SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN least ON least.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
    """,
    "op13_repair": r"""
        WITH RECURSIVE c AS (
          SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
          FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
        ), d AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
          FROM (SELECT *, (4294967295 - crc) % 20 AS kind FROM c) WHERE kind <> 0
        ), o AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS initial FROM d
        ), f AS (
          SELECT conv_id, turn, role, text, i, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'sound' END AS fault
          FROM o
        ), n AS (
          SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
          FROM f GROUP BY conv_id
        ), moves AS (
          SELECT * FROM (VALUES ('0', 's', '1'), ('0', 'u', '2'), ('1', 'u', '2'), ('2', 'a', '3'), ('3', 'u', '2')) AS m(state, initial, state_after)
        ), inserts AS (
          SELECT state, state AS state_after, '' AS audit, '' AS lines, 0 AS cost FROM (VALUES ('0'), ('1'), ('2'), ('3')) AS s(state)
          UNION ALL
          SELECT i.state, m.state_after, i.audit || 'I', i.lines || chr(10) || CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END, i.cost + 5
          FROM inserts i JOIN moves m ON m.state = i.state_after AND m.initial <> 's' WHERE i.cost < 10
        ), edits AS (
          SELECT f.conv_id, f.i, e.state, e.state_after, e.audit, e.cost, e.lines FROM f, LATERAL (
            SELECT state, state AS state_after, 'D' AS audit, 2 AS cost, '' AS lines FROM (VALUES ('0'), ('1'), ('2'), ('3')) AS s(state)
            UNION ALL
            SELECT state, state_after, 'K', CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, chr(10) || f.role || ':' || f.text
            FROM moves WHERE moves.initial = f.initial AND f.fault NOT IN ('blank', 'duplicate')
            UNION ALL
            SELECT state, state_after, 'R', 1 + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END,
              chr(10) || CASE moves.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text
            FROM moves WHERE moves.initial <> 's' AND f.fault NOT IN ('blank', 'duplicate')
          ) e
        ), steps AS (
          SELECT e.conv_id, e.i, i.state, e.state_after, i.audit || e.audit AS audit, i.lines || e.lines AS lines, i.cost + e.cost AS cost
          FROM edits e JOIN inserts i ON i.state_after = e.state
        ), best AS (
          SELECT conv_id, 0::BIGINT AS i, '0' AS state, '' AS audit, '' AS lines, 0 AS cost FROM n
          UNION ALL
          SELECT * FROM (
            SELECT s.conv_id, s.i, s.state_after, b.audit || s.audit AS audit, b.lines || s.lines, b.cost + s.cost AS cost
            FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.state = b.state
            QUALIFY row_number() OVER (PARTITION BY s.conv_id, s.i, s.state_after ORDER BY b.cost + s.cost, b.audit || s.audit) = 1
          )
        ), repaired AS (
          SELECT b.conv_id, b.cost + i.cost AS cost, b.audit || i.audit AS audit, b.lines || i.lines AS lines
          FROM best b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.rows = b.i JOIN inserts i ON i.state = b.state AND i.state_after IN ('0', '3')
          QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.cost, b.audit || i.audit) = 1
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
          sha256(coalesce(lines[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
}
