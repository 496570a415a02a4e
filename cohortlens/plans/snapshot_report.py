"""Comparison of an old and a new extract of the same admissions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_MONTHS_MAX, STUDY_CODES
from ..functions.text import thousands
from ..operators import compare, ingest, profile, reconcile
from ..sources.sinks import staging, write_report

ORDER = {
    "overview": ["indicator"],
    "duplicates": ["-snapshot"],
    "duplicates_detail": ["-snapshot", "rank"],
    "complexity": ["complexity"],
    "age_distribution": ["age_months"],
    "codes": ["status", "dx"],
    "codes_summary": ["status"],
    "codes_problems": ["status", "dx"],
    "codes_common": ["difference", "dx"],
    "stays": ["-snapshot"],
    "long_stays": ["-snapshot", "range_ord", "complexity"],
    "sex": ["sex"],
}

# Names shown to readers. Fixed values.
_COUNTS = {"n_old": "n old", "n_new": "n new", "difference": "Diferencia"}
_BASES = {"old": "Base old", "new": "Base new"}
_CODES = {"dx": "DX", "n_old": "n_old", "n_new": "n_new", "difference": "Diferencia", "status": "Estado"}
HEADERS = {
    "overview": {"indicator": "Elemento", **_BASES},
    "duplicates": {
        "snapshot": "Base",
        "n_rows": "Total registros",
        "unique_keys": "Combinaciones únicas",
        "duplicated_keys": "Combinaciones duplicadas",
        "rows_in_duplicates": "Registros en duplicados",
        "max_repeats": "Máx. repeticiones",
    },
    "duplicates_detail": {
        "snapshot": "Base",
        "person_type": "Tipo documento",
        "person_id": "Documento",
        "admit_ts": "Fecha ingreso",
        "n_times": "Veces repetido",
    },
    "complexity": {"complexity": "COMPLEJIDAD", "difference": "Diferencia"},
    "age": {"indicator": "Indicador", **_BASES},
    "age_distribution": {"age_months": "Edad (meses)", **_COUNTS},
    "codes": _CODES,
    "codes_summary": {"status": "Estado", "n_codes": "Códigos"},
    "codes_problems": _CODES,
    "codes_common": {"dx": "Código CIE-10", **_COUNTS},
    "discharge": {"indicator": "Indicador", **_BASES},
    "stays": {
        "snapshot": "Base",
        "min_days": "Minimo",
        "median_days": "Mediana",
        "max_days": "Maximo",
        "n_zero": "N_cero",
        "n_negative": "N_negativas",
    },
    "long_stays": {"snapshot": "Base", "stay_range": "Rango", "complexity": "COMPLEJIDAD"},
    "sex": {"sex": "SEXO", "difference": "Diferencia"},
    "crossing": {"metric": "Indicador", "value": "Valor"},
    "unread": {"source": "Base", "column": "Columna", "n_unread": "Valores no leídos"},
}

# Texts shown for the indicators of a table. Fixed values.
LABELS = {
    "overview": {
        "indicator": {
            "n_rows": "Total registros",
            "min_admit": "Fecha mínima ingreso",
            "max_admit": "Fecha máxima ingreso",
            "null_discharge": "NAs fecha egreso",
        }
    },
    "age": {
        "indicator": {
            "min": "Mínimo",
            "median": "Mediana",
            "mean": "Media",
            "max": "Máximo",
            "n_null": "NAs",
            "n_above_limit": f"Registros > {AGE_MONTHS_MAX} meses",
        }
    },
    "discharge": {
        "indicator": {
            "null_discharge": "NAs en fecha egreso",
            "min_discharge": "Fecha mínima",
            "max_discharge": "Fecha máxima",
            "discharge_before_admit": "Egresos antes del ingreso",
        }
    },
    "crossing": {
        "metric": {
            "common_persons": "Personas comunes",
            "common_events": "Eventos comunes (match exacto)",
            "events_only_new": "Eventos solo en new",
            "events_only_old": "Eventos solo en old",
        }
    },
}


def shown_overview(overview: DataFrame) -> DataFrame:
    """The overview with thousands separators in the numbers of rows."""
    counted = F.col("indicator") == "n_rows"
    return overview.withColumns(
        {c: F.when(counted, thousands(F.col(c).try_cast("long"))).otherwise(F.col(c)) for c in ("old", "new")}
    )


def snapshot_tables(
    tagged: DataFrame,
    codes: Sequence[str] | DataFrame = STUDY_CODES,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> dict[str, DataFrame]:
    """All tables of the report.

    ``keep`` may store the frames that several tables start from: counts by event key, by
    category and code, by age and by stay. No table reads the rows but through these four.
    By default they stay lazy and each table computes its own.
    """
    keys = keep(reconcile.event_key_counts(tagged), "event-keys")
    strata = keep(profile.strata(tagged), "strata")
    ages = keep(profile.age_counts(tagged), "ages")
    stays = keep(profile.stay_counts(tagged), "stays")
    quality = profile.merged(strata)
    coverage = keep(compare.codelist_coverage(strata, codes, weight="n_rows"), "code-coverage")
    return {
        "overview": shown_overview(
            profile.indicator_table(quality, profile.OVERVIEW_METRICS, "string")
        ),
        "duplicates": reconcile.duplicate_profile(keys),
        "duplicates_detail": reconcile.duplicate_detail(keys),
        "complexity": compare.category_diff(strata, "complexity", "n_rows"),
        "age": profile.indicator_table(
            profile.numeric_profile(ages, weight="n"), profile.NUMERIC_METRICS
        ),
        "age_distribution": compare.dense_histogram_diff(ages, weight="n"),
        "codes": coverage,
        "codes_summary": compare.codelist_status_summary(coverage),
        "codes_problems": compare.codelist_problems(coverage),
        "codes_common": compare.codelist_common(coverage),
        "discharge": profile.indicator_table(quality, profile.DISCHARGE_METRICS, "string"),
        "stays": profile.stay_stats(stays, "n"),
        "long_stays": profile.long_stay_bins(stays, weight="n"),
        "sex": compare.category_diff_share(strata, "sex", "n_rows"),
        "crossing": reconcile.snapshot_reconcile(keys),
    }


def write_snapshot_report(
    tagged: DataFrame,
    root: str,
    fmt: str = "parquet",
    codes: Sequence[str] | DataFrame = STUDY_CODES,
    headers: Mapping[str, Mapping[str, str]] | None = None,
    labels: Mapping[str, Mapping[str, Mapping[str, str]]] | None = None,
    unread: ingest.Unread | None = None,
) -> dict[str, str]:
    """Write the report. The harmonised rows and what several tables share is computed once.

    Pass ``HEADERS`` for the columns' display names and ``LABELS`` for the indicators'. With
    the ``unread`` that the rows were harmonised with, the table ``unread`` tells what each
    extract lost, counted while its rows were stored.
    """
    spark = tagged.sparkSession
    with staging(spark) as staged:
        rows = staged(tagged, "snapshots")
        tables = snapshot_tables(rows, codes, staged)
        if unread is not None:
            tables["unread"] = unread.counts(spark).orderBy("source", "column")
        return write_report(tables, root, fmt, ORDER, headers, labels)
