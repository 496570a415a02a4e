"""Target schemas and the column names each source uses for them."""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("snapshot", T.StringType(), False),
        T.StructField("complexity", T.StringType()),
        T.StructField("admission_id", T.StringType()),
        T.StructField("person_type", T.StringType()),
        T.StructField("person_id", T.StringType()),
        T.StructField("admit_ts", T.TimestampNTZType()),
        T.StructField("discharge_ts", T.TimestampNTZType()),
        T.StructField("age_months", T.DoubleType()),
        T.StructField("dx", T.StringType()),
        T.StructField("sex", T.StringType()),
    ]
)

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("slot_no", T.IntegerType()),
        T.StructField("event_no", T.StringType()),
        T.StructField("subgroup", T.StringType()),
        T.StructField("subgroup_original", T.StringType()),
        T.StructField("event_start", T.DateType()),
        T.StructField("event_end", T.DateType()),
    ]
)

COLLECTOR_SCHEMA = T.StructType(
    [
        T.StructField("collector", T.StringType(), False),
        T.StructField("display", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("weekly_target", T.IntegerType()),
    ]
)

SITE_SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType(), False),
        T.StructField("n_sample", T.LongType()),
    ]
)

# Source column names of the two extracts, canonical name -> name in the file.
OLD_EXTRACT = {
    "complexity": "COMPLEJIDAD",
    "admission_id": "INGRESO",
    "person_type": "TIPO_DOCUMENTO",
    "person_id": "DOCUMENTO",
    "admit_ts": "FECHA_INGRESO",
    "discharge_ts": "FECHA_SALIDA",
    "age_months": "EdadEnMeses",
    "dx": "DX",
    "sex": "SEXO",
}
NEW_EXTRACT = {
    **OLD_EXTRACT,
    "discharge_ts": "FECHA_EGRESO",
    "age_months": "EDAD_MESES",
}

# Source column names of a site sample, canonical name -> candidates, of
# which the first match wins. Only the optional columns may have none.
SAMPLE_COLUMNS = {
    "patient_id": ("id", "ingreso"),
    "slot_no": ("id_kobo",),
    "event_no": ("evento_vsr",),
    "subgroup": ("subgrupo",),
    "subgroup_original": ("color_grupo",),
    "event_start": ("fecha_inicial_evento",),
    "event_end": ("fecha_final_evento",),
}
SAMPLE_OPTIONAL = ("slot_no", "subgroup_original")
