"""The same results in plain SQL over the supplied tables, written independently.

Every statement inlines the views it needs. Deduplication, joins and pair counts are
spelled out here even where the Spark operator reaches the result another way.
"""

from __future__ import annotations

_EPISODE = """
episode AS (
  SELECT l_orderkey, p_type, o_orderpriority AS priority,
         CASE WHEN NOT (p_type = 'ECONOMY' AND o_orderpriority = '5-LOW'
                        OR p_type = 'SMALL' AND o_orderpriority = '1-URGENT')
              THEN o_orderpriority END AS complexity,
         CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS admission_id,
         CASE WHEN l_orderkey % 31 <> 0 THEN upper(trim(c_mktsegment)) END AS person_type,
         CAST(o_custkey AS VARCHAR) AS person_id,
         o_orderdate AS admit_ts,
         CASE WHEN l_orderkey % 13 <> 0
              THEN o_orderdate + to_hours((l_orderkey * 37 + l_linenumber * 11) % 12000 - 100)
         END AS discharge_ts,
         CASE WHEN l_orderkey % 17 <> 0
              THEN abs(CAST(CAST(l_quantity AS INTEGER) * 2 - 20 AS DOUBLE)) END AS age_months,
         upper(trim('  ' || lower(p_type) || ' ')) AS dx,
         CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS sex
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
),
tagged AS (
  SELECT 'old' AS snapshot, * FROM episode
  WHERE p_type = 'ECONOMY'
     OR p_type <> 'SMALL' AND (priority = '1-URGENT' OR priority <> '5-LOW' AND l_orderkey % 10 <> 0)
  UNION ALL
  SELECT 'new' AS snapshot, * FROM episode
  WHERE p_type = 'SMALL'
     OR p_type <> 'ECONOMY' AND (priority = '5-LOW' OR priority <> '1-URGENT'
                                 AND (l_orderkey % 7 <> 0 OR l_orderkey % 10 = 0))
),
stays AS (
  SELECT *, date_diff('microsecond', admit_ts, discharge_ts) AS stay_us,
         date_diff('microsecond', admit_ts, discharge_ts) / 86400000000::DOUBLE AS days
  FROM tagged WHERE admit_ts IS NOT NULL AND discharge_ts IS NOT NULL
)"""

_CODES = """,
codes(dx) AS (
  VALUES ('ECONOMY'), ('SMALL'), ('STANDARD'), ('PROMO'), ('MEDIUM'), ('LARGE'),
         ('ABSENT1'), ('ABSENT2')
),
coverage AS (
  SELECT c.dx, coalesce(o.n, 0) AS n_old, coalesce(w.n, 0) AS n_new,
         coalesce(w.n, 0) - coalesce(o.n, 0) AS difference,
         CASE WHEN o.n IS NULL AND w.n IS NULL THEN 'Ausente en ambas'
              WHEN w.n IS NULL THEN 'Solo en old'
              WHEN o.n IS NULL THEN 'Solo en new'
              ELSE 'Presente en ambas' END AS status
  FROM codes c
  LEFT JOIN (SELECT dx, count(*) AS n FROM tagged WHERE snapshot = 'old' GROUP BY dx) o
    ON c.dx = o.dx
  LEFT JOIN (SELECT dx, count(*) AS n FROM tagged WHERE snapshot = 'new' GROUP BY dx) w
    ON c.dx = w.dx
)"""

_KEYS = """,
old_keys AS (
  SELECT person_type, person_id, admit_ts, count(*) AS n FROM tagged
  WHERE snapshot = 'old' GROUP BY ALL
),
new_keys AS (
  SELECT person_type, person_id, admit_ts, count(*) AS n FROM tagged
  WHERE snapshot = 'new' GROUP BY ALL
),
both_keys AS (
  SELECT o.person_type, o.person_id, o.admit_ts, o.n AS n_old, w.n AS n_new
  FROM old_keys o JOIN new_keys w
    ON o.person_type IS NOT DISTINCT FROM w.person_type
   AND o.person_id IS NOT DISTINCT FROM w.person_id
   AND o.admit_ts IS NOT DISTINCT FROM w.admit_ts
)"""

_SAMPLE = """
landed AS (
  SELECT o_orderkey % 5 = 0 AS twice, r_name AS site,
         CAST(o_custkey AS VARCHAR) AS patient_id,
         CASE WHEN o_custkey % 23 = 0 OR r_name = 'ASIA' THEN NULL
              ELSE CAST(1 + o_custkey % 400 + CASE WHEN o_orderkey % 50 = 0 THEN 400 ELSE 0 END
                        AS INTEGER) END AS slot_no,
         CAST(o_orderkey AS VARCHAR) AS event_no,
         CASE o_orderkey % 4 WHEN 0 THEN 'Grupo 1' WHEN 1 THEN 'Grupo 2'
              WHEN 2 THEN 'Grupo 3' END AS subgroup,
         CASE WHEN r_name = 'EUROPE' THEN NULL
              ELSE 'Grupo ' || CAST(1 + o_orderkey % 3 AS VARCHAR) END AS subgroup_original,
         CAST(o_orderdate AS DATE) AS event_start,
         CASE WHEN o_orderkey % 29 <> 0
              THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 140 - 5 AS INTEGER)
         END AS event_end
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
sample AS (
  SELECT * EXCLUDE (twice) FROM landed
  UNION ALL
  SELECT * EXCLUDE (twice) FROM landed WHERE twice
),
events_u AS (SELECT DISTINCT * FROM sample)"""

_ENROL = """
enrol AS (
  SELECT CAST(user_id AS VARCHAR) AS patient_id, event_type AS collector,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'site_a'
              WHEN event_type = 'error' THEN 'site_b' ELSE 'site_c' END AS site,
         CAST(ts AS DATE) AS reg_date
  FROM events
  WHERE event_id % 31 <> 0 AND value > 10 AND CAST(ts AS DATE) <= DATE '2024-01-21'
),
targets(collector, display, site, weekly_target) AS (
  VALUES ('click', 'Collector 01', 'site_a', 145), ('error', 'Collector 02', 'site_b', 200),
         ('purchase', 'Collector 03', 'site_a', 140), ('view', 'Collector 04', 'site_c', 150)
)"""

_CARE = """
care0 AS (
  SELECT CAST(event_id AS VARCHAR) AS submission_id,
         CAST(1 + event_id % 4 AS INTEGER) AS event_index,
         CAST(user_id AS VARCHAR) AS patient_id, event_type AS collector,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'site_a'
              WHEN event_type = 'error' THEN 'site_b' ELSE 'site_c' END AS site,
         CAST(ts AS DATE) AS event_start,
         CAST(ts AS DATE) - CAST((user_id * 13) % 2400 - 60 AS INTEGER) AS birth_date,
         CAST(ts AS DATE) + CAST(event_id % 30 AS INTEGER) AS event_end,
         event_id % 2 = 0 AND event_id % 8 <> 0 AND user_id % 30 <> 0 AS emergency,
         CASE WHEN event_id % 8 <> 0 THEN event_id % 3 = 0 AND user_id % 30 <> 0 END AS general_ward,
         event_id % 5 = 0 AND event_id % 8 <> 0 AND user_id % 30 <> 0 AS intermediate,
         event_id % 7 = 0 AND event_id % 8 <> 0 AND user_id % 30 <> 0 AS icu
  FROM events
),
care AS (
  SELECT *,
         greatest(CASE WHEN emergency THEN 1 ELSE 0 END, CASE WHEN general_ward THEN 2 ELSE 0 END,
                  CASE WHEN intermediate THEN 3 ELSE 0 END, CASE WHEN icu THEN 4 ELSE 0 END) AS lvl,
         CASE WHEN birth_date <= event_start
              THEN datesub('month', birth_date, event_start)
              ELSE -datesub('month', event_start, birth_date)
                   - CASE WHEN event_start + to_months(CAST(datesub('month', event_start, birth_date) AS INTEGER))
                               = birth_date THEN 0 ELSE 1 END
         END AS months
  FROM care0
)"""


def _pct(part: str, whole: str) -> str:
    return f"round_even(100::DOUBLE * ({part}) / nullif({whole}, 0), 1)"


def _num(value: str) -> str:
    return f"regexp_replace(CAST({value} AS VARCHAR), '[.]0$', '')"


def _cell(n: str, pct: str) -> str:
    return (
        f"CASE WHEN ({pct}) IS NULL THEN {_num(n)} "
        f"ELSE {_num(n)} || ' (' || {_num(pct)} || '%)' END"
    )


def _big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def _episode(select: str, extra: str = "") -> str:
    return f"WITH {_EPISODE}{extra}\n{select}"


def _sample(select: str) -> str:
    return f"WITH {_SAMPLE}\n{select}"


def _enrol(select: str) -> str:
    return f"WITH {_ENROL}{select}"


def _care(select: str) -> str:
    return f"WITH {_CARE}\n{select}"


def _indicators(source: str, columns: dict[str, str]) -> str:
    """One row per indicator from a CTE ``s`` with one row per snapshot."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS indicator, "
        f"max(CASE WHEN snapshot = 'old' THEN {expr} END) AS old, "
        f"max(CASE WHEN snapshot = 'new' THEN {expr} END) AS new FROM s"
        for name, expr in columns.items()
    )
    return _episode(rows, f",\ns AS ({source})")


_SNAPSHOT_COLUMNS = (
    "snapshot, complexity, admission_id, person_type, person_id, admit_ts, discharge_ts, "
    "age_months, dx, sex"
)
_SAMPLE_COLUMNS = (
    "site, patient_id, slot_no, event_no, subgroup, subgroup_original, event_start, event_end"
)

_OVERVIEW = """SELECT snapshot, count(*) AS n_rows, min(admit_ts) AS min_admit,
       max(admit_ts) AS max_admit, count(*) FILTER (discharge_ts IS NULL) AS null_discharge
FROM tagged GROUP BY snapshot"""

_DISCHARGE = """SELECT snapshot, count(*) FILTER (discharge_ts IS NULL) AS null_discharge,
       min(discharge_ts) AS min_discharge, max(discharge_ts) AS max_discharge,
       count(*) FILTER (discharge_ts < admit_ts) AS discharge_before_admit
FROM tagged GROUP BY snapshot"""

_NUMERIC = """SELECT snapshot, min(age_months) AS min, median(age_months) AS median,
       round_even(avg(age_months), 1) AS mean, max(age_months) AS max,
       count(*) FILTER (age_months IS NULL) AS n_null,
       count(*) FILTER (age_months > 59) AS n_above_limit
FROM tagged GROUP BY snapshot"""


def _text_ts(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def _share(category: str) -> str:
    return _episode(f"""
, o AS (SELECT {category} AS k, count(*) AS n FROM tagged WHERE snapshot = 'old' GROUP BY ALL)
, w AS (SELECT {category} AS k, count(*) AS n FROM tagged WHERE snapshot = 'new' GROUP BY ALL)
SELECT coalesce(o.k, w.k) AS {category}, coalesce(o.n, 0) AS n_old, coalesce(w.n, 0) AS n_new,
       {_pct("o.n", "(SELECT sum(n) FROM o)")} AS pct_old,
       {_pct("w.n", "(SELECT sum(n) FROM w)")} AS pct_new,
       coalesce(w.n, 0) - coalesce(o.n, 0) AS difference
FROM o FULL JOIN w ON o.k IS NOT DISTINCT FROM w.k""")


def _only_in(side: str, other: str) -> str:
    return _episode(f"""SELECT {_SNAPSHOT_COLUMNS} FROM tagged t
WHERE snapshot = '{side}' AND NOT EXISTS (
  SELECT 1 FROM {other}_keys k
  WHERE k.person_type IS NOT DISTINCT FROM t.person_type
    AND k.person_id IS NOT DISTINCT FROM t.person_id
    AND k.admit_ts IS NOT DISTINCT FROM t.admit_ts)""", _KEYS)


def _by_site(where: str, total_with_pct: bool) -> str:
    n = {c: f"pct_{c}" for c in ("patients", "events")}
    cells = {
        c: _cell(c, p) if total_with_pct
        else f"CASE WHEN row_ord = 1 THEN {_num(c)} ELSE {_cell(c, p)} END"
        for c, p in n.items()
    }
    return _sample(f""", d AS (
  SELECT site, count(DISTINCT row(patient_id)) AS patients,
         count(DISTINCT row(patient_id, event_no)) AS events
  FROM events_u WHERE {where} GROUP BY site
), t AS (
  SELECT 0 AS row_ord, * FROM d
  UNION ALL
  SELECT 1, 'TOTAL', {_big("coalesce(sum(patients), 0)")}, {_big("coalesce(sum(events), 0)")} FROM d
), p AS (
  SELECT *, {_pct("patients", "(SELECT sum(patients) FROM d)")} AS pct_patients,
         {_pct("events", "(SELECT sum(events) FROM d)")} AS pct_events
  FROM t
)
SELECT *, {cells["patients"]} AS patients_text, {cells["events"]} AS events_text FROM p""")


def _duration(column: str) -> str:
    bins = ["bin_1", "bin_2", "bin_3", "bin_4"]
    sums = ", ".join(_big(f"coalesce(sum({c}), 0)") for c in [*bins, "bin_na", "total"])
    pcts = ", ".join(f"{_pct(b, 'total')} AS pct_{b}" for b in bins)
    cells = ", ".join(f"{_cell(b, f'pct_{b}')} AS {b}_text" for b in bins)
    return _sample(f""", spans AS (
  SELECT site, event_end - event_start AS days FROM events_u WHERE {column} = 'Grupo 1'
), d AS (
  SELECT site, count(*) FILTER (days <= 30) AS bin_1,
         count(*) FILTER (days > 30 AND days <= 60) AS bin_2,
         count(*) FILTER (days > 60 AND days <= 90) AS bin_3,
         count(*) FILTER (days > 90) AS bin_4,
         count(*) FILTER (days IS NULL) AS bin_na, count(*) AS total
  FROM spans GROUP BY site
), t AS (
  SELECT 0 AS row_ord, * FROM d UNION ALL SELECT 1, 'TOTAL', {sums} FROM d
), p AS (SELECT *, {pcts} FROM t)
SELECT *, {cells},
       CASE WHEN row_ord = 1 THEN {_cell("total", _pct("total", "total"))}
            ELSE {_num("total")} END AS total_text
FROM p""")


_SITE_STATUS = f""",
samples(site, n_sample) AS (
  VALUES ('site_a', 400::BIGINT), ('site_b', 250), ('site_c', 300), ('site_d', 0)
),
r AS (
  SELECT s.site, s.n_sample, count(DISTINCT patient_id) AS n_patients,
         count(patient_id) AS n_events
  FROM samples s LEFT JOIN enrol e ON s.site = e.site GROUP BY ALL
),
status AS (
  SELECT 0 AS row_ord, *, {_pct("n_patients", "n_sample")} AS pct_patients FROM r
  UNION ALL
  SELECT 1, 'TOTAL', {_big("sum(n_sample)")}, {_big("sum(n_patients)")}, {_big("sum(n_events)")},
         {_pct("sum(n_patients)", "sum(n_sample)")} FROM r
)
"""

_COLLECTOR_STATUS = f""",
status AS (
  SELECT t.collector, t.weekly_target,
         count(DISTINCT CASE WHEN reg_date >= DATE '2024-01-15' THEN patient_id END) AS last_week,
         {_pct("count(DISTINCT CASE WHEN reg_date >= DATE '2024-01-15' THEN patient_id END)", "weekly_target")} AS pct_week,
         count(DISTINCT patient_id) AS total,
         {_pct("count(DISTINCT patient_id)", "weekly_target")} AS pct_total
  FROM targets t LEFT JOIN enrol e ON t.collector = e.collector
  GROUP BY t.collector, t.weekly_target
)
"""

_LEVELS = ["emergency", "general_ward", "intermediate", "icu"]


def _care_levels() -> str:
    counts = ", ".join(f"count(*) FILTER (lvl = {i}) AS {n}_n" for i, n in enumerate(_LEVELS, 1))
    sums = ", ".join(_big(f"coalesce(sum({c}), 0)") for c in ["total", *[f"{n}_n" for n in _LEVELS]])
    pcts = ", ".join(f"{_pct(f'{n}_n', 'total')} AS {n}_pct" for n in _LEVELS)
    cells = ", ".join(f"{_cell(f'{n}_n', f'{n}_pct')} AS {n}_text" for n in _LEVELS)
    return _care(f""", d AS (
  SELECT site, collector, count(*) AS total, {counts} FROM care WHERE lvl > 0 GROUP BY ALL
), t AS (
  SELECT 0 AS row_ord, * FROM d UNION ALL SELECT 1, 'TOTAL', 'TOTAL', {sums} FROM d
), p AS (SELECT *, {pcts} FROM t)
SELECT *, {cells} FROM p""")


ORACLE: dict[str, str] = {
    "consolidate_sources": _sample(f"SELECT {_SAMPLE_COLUMNS} FROM sample"),
    "harmonise_snapshot": _episode(f"SELECT {_SNAPSHOT_COLUMNS} FROM tagged"),
    "unique_events": _sample(f"SELECT {_SAMPLE_COLUMNS} FROM events_u"),
    "snapshot_overview": _episode(_OVERVIEW),
    "snapshot_overview_indicators": _indicators(
        _OVERVIEW,
        {
            "n_rows": "CAST(n_rows AS VARCHAR)",
            "min_admit": _text_ts("min_admit"),
            "max_admit": _text_ts("max_admit"),
            "null_discharge": "CAST(null_discharge AS VARCHAR)",
        },
    ),
    "numeric_profile": _episode(_NUMERIC),
    "numeric_profile_indicators": _indicators(
        _NUMERIC,
        {
            c: f"CAST({c} AS DOUBLE)"
            for c in ("min", "median", "mean", "max", "n_null", "n_above_limit")
        },
    ),
    "discharge_quality": _episode(_DISCHARGE),
    "discharge_quality_indicators": _indicators(
        _DISCHARGE,
        {
            "null_discharge": "CAST(null_discharge AS VARCHAR)",
            "min_discharge": _text_ts("min_discharge"),
            "max_discharge": _text_ts("max_discharge"),
            "discharge_before_admit": "CAST(discharge_before_admit AS VARCHAR)",
        },
    ),
    "stay_stats": _episode("""SELECT snapshot, round_even(min(days), 1) AS min_days,
       round_even(median(days), 1) AS median_days, round_even(max(days), 1) AS max_days,
       count(*) FILTER (days = 0) AS n_zero, count(*) FILTER (days < 0) AS n_negative
FROM stays GROUP BY snapshot"""),
    "long_stay_bins": _episode("""SELECT snapshot, range_ord,
       CASE range_ord WHEN 1 THEN '61-90d' WHEN 2 THEN '91-120d' WHEN 3 THEN '121-180d'
            WHEN 4 THEN '181-365d' ELSE '>365d' END AS stay_range,
       complexity, count(*) AS n
FROM (SELECT *, CASE WHEN days <= 90 THEN 1 WHEN days <= 120 THEN 2 WHEN days <= 180 THEN 3
                     WHEN days <= 365 THEN 4 ELSE 5 END AS range_ord
      FROM stays WHERE days > 60)
GROUP BY ALL"""),
    "category_diff": _episode("""
, o AS (SELECT complexity AS k, count(*) AS n FROM tagged WHERE snapshot = 'old' GROUP BY ALL)
, w AS (SELECT complexity AS k, count(*) AS n FROM tagged WHERE snapshot = 'new' GROUP BY ALL)
SELECT coalesce(o.k, w.k) AS complexity, coalesce(o.n, 0) AS n_old, coalesce(w.n, 0) AS n_new,
       coalesce(w.n, 0) - coalesce(o.n, 0) AS difference
FROM o FULL JOIN w ON o.k IS NOT DISTINCT FROM w.k"""),
    "category_diff_share": _share("sex"),
    "category_diff_share_complexity": _share("complexity"),
    "dense_histogram_diff": _episode("""SELECT CAST(m AS INTEGER) AS age_months,
       count(*) FILTER (snapshot = 'old') AS n_old, count(*) FILTER (snapshot = 'new') AS n_new,
       count(*) FILTER (snapshot = 'new') - count(*) FILTER (snapshot = 'old') AS difference
FROM range(0, 60) AS spine(m) LEFT JOIN tagged ON age_months = m
GROUP BY m"""),
    "codelist_coverage": _episode("SELECT * FROM coverage", _CODES),
    "codelist_status_summary": _episode(
        "SELECT status, count(*) AS n_codes FROM coverage GROUP BY status", _CODES
    ),
    "codelist_problems": _episode(
        "SELECT * FROM coverage WHERE status <> 'Presente en ambas'", _CODES
    ),
    "codelist_common": _episode(
        "SELECT dx, n_old, n_new, difference FROM coverage WHERE status = 'Presente en ambas'",
        _CODES,
    ),
    "duplicate_profile": _episode(f""", k AS (
  SELECT 'old' AS snapshot, n FROM old_keys UNION ALL SELECT 'new', n FROM new_keys
)
SELECT snapshot, {_big("sum(n)")} AS n_rows, count(*) AS unique_keys,
       count(*) FILTER (n > 1) AS duplicated_keys,
       {_big("sum(n) FILTER (n > 1)")} AS rows_in_duplicates, max(n) AS max_repeats
FROM k GROUP BY snapshot""", _KEYS),
    "duplicated_keys": _episode("""
SELECT person_type, person_id, admit_ts, 'old' AS snapshot, n AS n_times FROM old_keys WHERE n > 1
UNION ALL
SELECT person_type, person_id, admit_ts, 'new' AS snapshot, n AS n_times FROM new_keys WHERE n > 1""",
        _KEYS),
    "duplicate_detail": _episode(f""", k AS (
  SELECT 'old' AS snapshot, * FROM old_keys UNION ALL SELECT 'new', * FROM new_keys
), r AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY n DESC,
           person_type NULLS LAST, person_id NULLS LAST, admit_ts NULLS LAST) AS rank
  FROM k WHERE n > 1
)
SELECT snapshot, CAST(rank AS INTEGER) AS rank, person_type, person_id, admit_ts,
       n AS n_times FROM r WHERE rank <= 20""",
        _KEYS),
    "snapshot_reconcile": _episode("""
, po AS (SELECT DISTINCT person_type, person_id FROM tagged WHERE snapshot = 'old')
, pw AS (SELECT DISTINCT person_type, person_id FROM tagged WHERE snapshot = 'new')
SELECT 'common_persons' AS metric, CAST(count(*) AS BIGINT) AS value
FROM po JOIN pw ON po.person_type IS NOT DISTINCT FROM pw.person_type
               AND po.person_id IS NOT DISTINCT FROM pw.person_id
UNION ALL
SELECT 'common_events', CAST(count(*) AS BIGINT)
FROM (SELECT * FROM tagged WHERE snapshot = 'old') o
JOIN (SELECT * FROM tagged WHERE snapshot = 'new') w
  ON o.person_type IS NOT DISTINCT FROM w.person_type
 AND o.person_id IS NOT DISTINCT FROM w.person_id
 AND o.admit_ts IS NOT DISTINCT FROM w.admit_ts
UNION ALL
SELECT 'events_only_new', CAST(count(*) AS BIGINT) FROM tagged t
WHERE snapshot = 'new' AND NOT EXISTS (
  SELECT 1 FROM old_keys k WHERE k.person_type IS NOT DISTINCT FROM t.person_type
    AND k.person_id IS NOT DISTINCT FROM t.person_id
    AND k.admit_ts IS NOT DISTINCT FROM t.admit_ts)
UNION ALL
SELECT 'events_only_old', CAST(count(*) AS BIGINT) FROM tagged t
WHERE snapshot = 'old' AND NOT EXISTS (
  SELECT 1 FROM new_keys k WHERE k.person_type IS NOT DISTINCT FROM t.person_type
    AND k.person_id IS NOT DISTINCT FROM t.person_id
    AND k.admit_ts IS NOT DISTINCT FROM t.admit_ts)""", _KEYS),
    "common_persons": _episode("""
SELECT person_type, person_id FROM tagged WHERE snapshot = 'old'
INTERSECT
SELECT person_type, person_id FROM tagged WHERE snapshot = 'new'"""),
    "common_event_keys": _episode(
        "SELECT *, CAST(n_old * n_new AS BIGINT) AS n_pairs FROM both_keys", _KEYS
    ),
    "events_only_in_new": _only_in("new", "old"),
    "events_only_in_old": _only_in("old", "new"),
    "events_only_new_by_stored_counts": _only_in("new", "old"),
    "sketched_ages": _episode("""SELECT snapshot, count(age_months) AS n, count(*) - count(age_months) AS n_null,
       min(age_months) AS low, max(age_months) AS high, true AS not_above, true AS not_below
FROM tagged GROUP BY snapshot"""),
    "read_parts": """
SELECT 'open' AS part, o_orderkey, o_orderpriority, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0
UNION ALL
SELECT 'closed', o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1""",
    "read_part_folder": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
    "read_named_part": """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderpriority = '5-LOW'""",
    "read_saved": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "sources_by_schema": _sample("SELECT * FROM sample"),
    "unread_values": _sample(""", known AS (SELECT DISTINCT site FROM landed)
SELECT site AS source, c AS "column",
       CASE WHEN c = 'event_end' THEN (SELECT count(*) FROM sample s WHERE s.site = known.site AND event_end IS NULL)
            ELSE 0 END AS n_unread
FROM known, (VALUES ('slot_no'), ('event_start'), ('event_end')) AS v(c)"""),
    "written_report": _episode("""SELECT "Indicador", old AS "Base old", new AS "Base new" FROM (
  SELECT 'NAs en fecha egreso' AS "Indicador",
         CAST(count(*) FILTER (snapshot = 'old' AND discharge_ts IS NULL) AS VARCHAR) AS old,
         CAST(count(*) FILTER (snapshot = 'new' AND discharge_ts IS NULL) AS VARCHAR) AS new FROM tagged
  UNION ALL
  SELECT 'Fecha mínima', CAST(min(discharge_ts) FILTER (snapshot = 'old') AS VARCHAR),
         CAST(min(discharge_ts) FILTER (snapshot = 'new') AS VARCHAR) FROM tagged
  UNION ALL
  SELECT 'Fecha máxima', CAST(max(discharge_ts) FILTER (snapshot = 'old') AS VARCHAR),
         CAST(max(discharge_ts) FILTER (snapshot = 'new') AS VARCHAR) FROM tagged
  UNION ALL
  SELECT 'Egresos antes del ingreso',
         CAST(count(*) FILTER (snapshot = 'old' AND discharge_ts < admit_ts) AS VARCHAR),
         CAST(count(*) FILTER (snapshot = 'new' AND discharge_ts < admit_ts) AS VARCHAR) FROM tagged
)"""),
    "study_counts": _sample("""SELECT 'unique_events' AS metric, count(*) AS value FROM events_u
UNION ALL SELECT 'site_patients', count(DISTINCT row(site, patient_id)) FROM events_u
UNION ALL SELECT 'patients', count(DISTINCT row(patient_id)) FROM events_u
UNION ALL SELECT 'patient_events', count(DISTINCT row(patient_id, event_no)) FROM events_u"""),
    "subgroup_counts": _sample(
        "SELECT subgroup, count(*) AS n_events FROM events_u GROUP BY subgroup"
    ),
    "site_by_subgroup": _sample("""SELECT site,
       count(*) FILTER (subgroup_original = 'Grupo 1') AS group_1,
       count(*) FILTER (subgroup_original = 'Grupo 2') AS group_2,
       count(*) FILTER (subgroup_original = 'Grupo 3') AS group_3,
       count(*) FILTER (subgroup_original IS NULL) AS group_na
FROM events_u GROUP BY site"""),
    "quota_check": _sample("""SELECT site,
       count(DISTINCT row(patient_id)) AS unique_patients, max(slot_no) AS design_quota,
       count(DISTINCT row(slot_no)) AS unique_slots,
       count(DISTINCT row(patient_id)) - max(slot_no) AS difference
FROM events_u GROUP BY site"""),
    "sequence_check": _sample("""SELECT site, max(slot_no) AS max_slot,
       count(DISTINCT row(slot_no)) AS unique_slots,
       count(DISTINCT row(slot_no)) = max(slot_no) AS sequence_ok,
       max(slot_no) - count(DISTINCT slot_no) AS n_missing
FROM events_u GROUP BY site"""),
    "sequence_gaps": _sample(""", top AS (
  SELECT site, max(slot_no) AS m FROM events_u GROUP BY site HAVING max(slot_no) >= 1
), spine AS (SELECT site, CAST(unnest(range(1, m + 1)) AS INTEGER) AS missing_slot FROM top)
SELECT site, missing_slot FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM events_u e WHERE e.site = s.site AND e.slot_no = s.missing_slot)"""),
    "sequence_gap_ranges": _sample(""", slots AS (
  SELECT DISTINCT site, slot_no FROM sample WHERE slot_no >= 1
), steps AS (
  SELECT site, slot_no, lag(slot_no, 1, 0) OVER (PARTITION BY site ORDER BY slot_no) AS before FROM slots
)
SELECT site, before + 1 AS first_missing, slot_no - 1 AS last_missing, CAST(slot_no - before - 1 AS BIGINT) AS n_missing
FROM steps WHERE slot_no > before + 1"""),
    "multi_slot_patients": _sample(""", d AS (SELECT DISTINCT site, patient_id, slot_no FROM events_u)
SELECT site, patient_id, slot_no
FROM (SELECT *, count(*) OVER (PARTITION BY site, patient_id) AS n FROM d) WHERE n > 1"""),
    "site_distribution": _by_site("true", total_with_pct=False),
    "group_counts_1_original": _by_site("subgroup_original = 'Grupo 1'", total_with_pct=True),
    "group_counts_2": _by_site("subgroup = 'Grupo 2'", total_with_pct=True),
    "group_counts_3": _by_site("subgroup = 'Grupo 3'", total_with_pct=True),
    "duration_distribution": _duration("subgroup"),
    "duration_distribution_original": _duration("subgroup_original"),
    "site_status": _enrol(_SITE_STATUS + "SELECT * FROM status"),
    "site_compliance": _enrol(_SITE_STATUS + f"""SELECT row_ord,
       CASE site WHEN 'site_a' THEN 'Site A' WHEN 'site_b' THEN 'Site B' ELSE site END AS site,
       {_num("n_sample")} || ' (100%)' AS sample_text,
       {_cell("n_patients", "pct_patients")} AS patients_text,
       {_num("n_events")} AS events_text, {_num("pct_patients")} || '%' AS compliance_text
FROM status"""),
    "collector_status": _enrol(_COLLECTOR_STATUS + "SELECT * FROM status"),
    "collector_compliance": _enrol(_COLLECTOR_STATUS + f""", rows AS (
  SELECT 0 AS row_ord, s.collector, t.display, t.site, s.weekly_target, s.last_week, s.pct_week,
         s.total, s.pct_total
  FROM status s LEFT JOIN targets t ON s.collector = t.collector
  UNION ALL
  SELECT 1, 'TOTAL', 'TOTAL', '', {_big("sum(weekly_target)")}, {_big("sum(last_week)")},
         {_pct("sum(last_week)", "sum(weekly_target)")}, {_big("sum(total)")},
         {_pct("sum(total)", "sum(weekly_target)")}
  FROM status
)
SELECT *, {_num("pct_week")} || '%' AS pct_week_text, {_num("pct_total")} || '%' AS pct_total_text,
       row_ord = 0 AND coalesce(pct_week < 80, false) AS below_target
FROM rows"""),
    "weekly_enrolment": _enrol("""
SELECT e.collector, t.display, t.site, t.display || chr(10) || t.site AS panel_label,
       CAST(date_trunc('week', reg_date) AS DATE) AS week,
       strftime(date_trunc('week', reg_date), '%d %b') AS week_label,
       count(DISTINCT patient_id) AS n_patients, t.weekly_target,
       CAST(date_trunc('week', reg_date) AS DATE) = DATE '2024-01-15' AS is_cutoff_week
FROM enrol e JOIN targets t ON e.collector = t.collector
GROUP BY ALL"""),
    "care_findings": _care("""SELECT rule, submission_id, event_index, collector, site, birth_date, event_start,
       event_end, CAST(months AS INTEGER) AS age_months
FROM care, (VALUES ('birth_after_event'), ('age_out_of_range'), ('events_without_care')) AS r(rule)
WHERE rule = 'birth_after_event' AND birth_date > event_start
   OR rule = 'age_out_of_range' AND (birth_date > event_start OR months > 59)
   OR rule = 'events_without_care' AND lvl = 0"""),
    "birth_after_event": _care("""SELECT submission_id, event_index, collector, site, birth_date,
       event_start FROM care WHERE birth_date > event_start"""),
    "age_out_of_range": _care("""SELECT submission_id, event_index, collector, site, birth_date,
       event_start, CAST(months AS INTEGER) AS age_months
FROM care WHERE birth_date > event_start OR months > 59"""),
    "events_without_care": _care("""SELECT submission_id, event_index, collector, site, event_start,
       event_end FROM care WHERE lvl = 0"""),
    "patients_without_care": _care("""SELECT patient_id, count(*) AS n_events,
       count(*) FILTER (lvl = 0) AS n_events_without_care
FROM care GROUP BY patient_id HAVING count(*) = count(*) FILTER (lvl = 0)"""),
    "error_summary": _care(""", e AS (
  SELECT 'birth_after_event' AS error_type, count(*) AS n_affected FROM care
  WHERE birth_date > event_start
  UNION ALL SELECT 'age_out_of_range', count(*) FROM care
  WHERE birth_date > event_start OR months > 59
  UNION ALL SELECT 'events_without_care', count(*) FROM care WHERE lvl = 0
  UNION ALL SELECT 'patients_without_care', count(*) FROM (
    SELECT patient_id FROM care GROUP BY patient_id HAVING max(lvl) = 0)
)
SELECT *, CASE WHEN n_affected > 0 THEN 'Requiere revisión' ELSE 'Sin errores' END AS status
FROM e"""),
    "error_summary_from_counts": _care(""", e AS (
  SELECT 'birth_after_event' AS error_type, count(*) AS n_affected FROM care
  WHERE birth_date > event_start
  UNION ALL SELECT 'age_out_of_range', count(*) FROM care
  WHERE birth_date > event_start OR months > 59
  UNION ALL SELECT 'events_without_care', count(*) FROM care WHERE lvl = 0
  UNION ALL SELECT 'patients_without_care', count(*) FROM (
    SELECT patient_id FROM care GROUP BY patient_id HAVING max(lvl) = 0)
)
SELECT *, CASE WHEN n_affected > 0 THEN 'Requiere revisión' ELSE 'Sin errores' END AS status
FROM e"""),
    "max_care_level": _care_levels(),
    "dimension_audit": """
WITH a AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 43 <> 0 THEN c_mktsegment END AS label
      FROM customer WHERE c_custkey % 41 <> 0 OR c_custkey % 37 = 0),
b AS (SELECT c_custkey AS code,
             CASE WHEN c_custkey % 40 = 0 THEN lower(c_mktsegment)
                  WHEN c_custkey % 53 <> 0 THEN c_mktsegment END AS label
      FROM customer WHERE c_custkey % 37 <> 0
      UNION SELECT c_custkey, 'SECOND' FROM customer WHERE c_custkey % 37 <> 0 AND c_custkey % 47 = 0)
SELECT code, label, true AS in_first, false AS in_second FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL
SELECT code, label, false, true FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}
ORACLE["shown_overview"] = f"""SELECT indicator,
       CASE WHEN indicator = 'n_rows' THEN format('{{:,}}', CAST(old AS BIGINT)) ELSE old END AS old,
       CASE WHEN indicator = 'n_rows' THEN format('{{:,}}', CAST(new AS BIGINT)) ELSE new END AS new
FROM ({ORACLE["snapshot_overview_indicators"]})"""
