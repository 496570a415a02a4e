"""Views over the supplied tables that have the shape of the operators' inputs.

The tables hold no NULLs in the columns used, so the views inject them by key modulus.
The key conditions of the two extracts and of the two dimensions say what each of them
lacks, so that they differ; every row of the tables is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import harmonise_sample, harmonise_snapshot
from ..sources.dims import collector_dim, site_samples
from ..sources.schemas import NEW_EXTRACT, OLD_EXTRACT

CODES = ("ECONOMY", "SMALL", "STANDARD", "PROMO", "MEDIUM", "LARGE", "ABSENT1", "ABSENT2")

SITES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SITE_WITH_OTHER_KEY = "AMERICA"
SITE_WITHOUT_SLOTS = "ASIA"
SITE_WITHOUT_ORIGINAL = "EUROPE"

CUTOFF = dt.date(2024, 1, 21)
COLLECTORS = (
    ("click", "Collector 01", "site_a", 145),
    ("error", "Collector 02", "site_b", 200),
    ("purchase", "Collector 03", "site_a", 140),
    ("view", "Collector 04", "site_c", 150),
)
SITE_SAMPLES = (("site_a", 400), ("site_b", 250), ("site_c", 300), ("site_d", 0))
SITE_LABELS = {"site_a": "Site A", "site_b": "Site B", "TOTAL": "TOTAL"}


# Columns of the supplied tables. With the schema given, no footer is read to plan.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _copies(df: DataFrame, name: str, *values: Column) -> DataFrame:
    """One copy of a row per value that is not NULL, in one pass and inside generated code."""
    marks = [f"__copy_{i}" for i in range(len(values))]
    marked = df.withColumns(dict(zip(marks, values)))
    # Fresh names for the kept columns: only then are equal shuffles recognised and reused.
    kept = [F.col(c).alias(c) for c in df.columns]
    return marked.unpivot(kept, marks, "__mark", name).filter(F.col(name).isNotNull())


def _is_old() -> Column:
    """Part type decides first, then priority, then the key: a line is in one extract at least."""
    by_priority = (F.col("o_orderpriority") == "1-URGENT") | (
        (F.col("o_orderpriority") != "5-LOW") & (F.col("l_orderkey") % 10 != 0)
    )
    return (F.col("p_type") == "ECONOMY") | ((F.col("p_type") != "SMALL") & by_priority)


def _is_new() -> Column:
    by_key = (F.col("l_orderkey") % 7 != 0) | (F.col("l_orderkey") % 10 == 0)
    by_priority = (F.col("o_orderpriority") == "5-LOW") | (
        (F.col("o_orderpriority") != "1-URGENT") & by_key
    )
    return (F.col("p_type") == "SMALL") | ((F.col("p_type") != "ECONOMY") & by_priority)


def _complexity() -> Column:
    """The priority; NULL where it would put a one-sided priority into the other extract."""
    crossed = ((F.col("p_type") == "ECONOMY") & (F.col("o_orderpriority") == "5-LOW")) | (
        (F.col("p_type") == "SMALL") & (F.col("o_orderpriority") == "1-URGENT")
    )
    return F.when(~crossed, F.col("o_orderpriority"))


def _null_every(n: int, key: str, value: Column) -> Column:
    return F.when(F.col(key) % n != 0, value)


def _admissions(spark: SparkSession, sf_dir: str, persons: bool) -> DataFrame:
    """Order lines with their part and order.

    Parts meet lines and customers meet orders before the two meet, so lines are shuffled
    twice, not three times. The customer only adds an attribute: the join is a left join
    on its key and is left out when no operator asks for the person.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    orders = table(spark, sf_dir, "orders")
    segment = []
    if persons:
        customers = table(spark, sf_dir, "customer")
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        segment = ["c_mktsegment"]
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "p_type", "o_orderkey", "o_custkey",
        "o_orderdate", "o_orderpriority", "o_orderstatus", *segment,
    )


def _extract_columns(persons: bool, text_dates: bool, names: dict[str, str]) -> list[Column]:
    hours = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 12000 - 100).cast("int")
    discharge = F.timestamp_add("HOUR", hours, F.col("o_orderdate"))

    def stamp(c: Column) -> Column:
        """As text in the forms that sources use, one of them with another zone."""
        if not text_dates:
            return c
        ahead = F.date_format(F.timestamp_add("HOUR", F.lit(2), c), "yyyy-MM-dd HH:mm:ss")
        return (
            F.when(F.col("l_orderkey") % 5 == 0, F.concat(ahead, F.lit("+02:00")))
            .when(F.col("l_orderkey") % 5 == 1, F.date_format(c, "yyyy.MM.dd HH:mm:ss"))
            .when(F.col("l_orderkey") % 5 == 2, F.date_format(c, "yyyyMMdd HHmmss"))
            .otherwise(c.cast("string"))
        )

    segment = F.col("c_mktsegment") if persons else F.lit(None).cast("string")
    values = {
        "complexity": _complexity(),
        "admission_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "person_type": _null_every(31, "l_orderkey", segment),
        "person_id": F.col("o_custkey"),
        "admit_ts": stamp(F.col("o_orderdate")),
        "discharge_ts": _null_every(13, "l_orderkey", stamp(discharge)),
        "age_months": _null_every(17, "l_orderkey", F.col("l_quantity").cast("int") * 2 - 20),
        "dx": F.concat(F.lit("  "), F.lower("p_type"), F.lit(" ")),
        "sex": _null_every(19, "o_orderkey", F.col("o_orderstatus")),
    }
    return [c.alias(names[k]) for k, c in values.items()]


def extract(spark: SparkSession, sf_dir: str, snapshot: str) -> DataFrame:
    """One extract as it would arrive: its own column names, timestamps as text."""
    keep, names = (_is_old(), OLD_EXTRACT) if snapshot == "old" else (_is_new(), NEW_EXTRACT)
    rows = _admissions(spark, sf_dir, persons=True).filter(keep)
    return rows.select(*_extract_columns(True, True, names))


def tagged(spark: SparkSession, sf_dir: str, persons: bool = False) -> DataFrame:
    """Both snapshots, harmonised and tagged, in one pass over the tables.

    A line may be in either or both extracts. Real extracts are two files; here both are
    cut from the same lines, so each line is read once and copied per snapshot.
    """
    rows = _admissions(spark, sf_dir, persons).filter(_is_old() | _is_new())
    copies = _copies(rows, "snapshot", F.when(_is_old(), "old"), F.when(_is_new(), "new"))
    landed = copies.select("snapshot", *_extract_columns(persons, False, OLD_EXTRACT))
    return harmonise_snapshot(landed, F.col("snapshot"), OLD_EXTRACT)


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their region. Regions meet nations, then customers, then orders, so a
    site filter reaches the customers before the orders are shuffled."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "r_name", "o_orderkey", "o_custkey", "o_orderdate"
    )


def _sample_landing(rows: DataFrame) -> DataFrame:
    """Raw sample rows, every fifth order twice, dates and groups as text."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, ((order * 37) % 140 - 5).cast("int"))
    extra = F.when(order % 50 == 0, 400).otherwise(0)
    copies = _copies(rows, "copy", F.lit(0), F.when(order % 5 == 0, 1))
    return copies.select(
        F.col("r_name").alias("site"),
        customer.alias("id"),
        _null_every(23, "o_custkey", (1 + customer % 400 + extra).cast("int")).alias("id_kobo"),
        order.alias("evento_vsr"),
        F.concat(F.lit("Grupo "), 1 + order % 4, F.lit(" - x")).alias("subgrupo"),
        F.concat(F.lit("Grupo "), 1 + order % 3).alias("color_grupo"),
        F.date_format(start, "dd/MM/yyyy").alias("fecha_inicial_evento"),
        F.when(order % 29 == 0, F.lit("sin dato"))
        .otherwise(F.date_format(end, "dd/MM/yyyy"))
        .alias("fecha_final_evento"),
    )


def sample_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One raw frame per site, with the columns drifting from site to site."""
    sources = {}
    for site in SITES:
        rows = _sample_rows(spark, sf_dir).filter(F.col("r_name") == site)
        df = _sample_landing(rows).drop("site")
        if site == SITE_WITH_OTHER_KEY:
            slot = F.concat(F.col("id_kobo").cast("string"), F.lit(".0"))
            df = df.withColumnRenamed("id", "ingreso").withColumn("id_kobo", slot)
        if site == SITE_WITHOUT_SLOTS:
            df = df.drop("id_kobo")
        if site == SITE_WITHOUT_ORIGINAL:
            df = df.drop("color_grupo")
        sources[site] = df
    return sources


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated sample in one pass: the same rows as consolidating the sources."""
    site = F.col("site")
    landed = _sample_landing(_sample_rows(spark, sf_dir)).withColumns(
        {
            "id_kobo": F.when(site != SITE_WITHOUT_SLOTS, F.col("id_kobo")),
            "color_grupo": F.when(site != SITE_WITHOUT_ORIGINAL, F.col("color_grupo")),
        }
    )
    return harmonise_sample(landed, site)


def _collector_site() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind.isin("click", "purchase"), "site_a")
        .when(kind == "error", "site_b")
        .otherwise("site_c")
    )


def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("event_type").alias("collector"),
        _collector_site().alias("site"),
        F.col("ts").cast("date").alias("reg_date"),
        _null_every(31, "event_id", F.col("value") > 10).alias("eligible"),
    )


def care_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    start = F.col("ts").cast("date")
    reached = (event % 8 != 0) & (user % 30 != 0)
    return table(spark, sf_dir, "events").select(
        event.cast("string").alias("submission_id"),
        (1 + event % 4).cast("int").alias("event_index"),
        user.cast("string").alias("patient_id"),
        F.col("event_type").alias("collector"),
        _collector_site().alias("site"),
        F.date_sub(start, ((user * 13) % 2400 - 60).cast("int")).alias("birth_date"),
        start.alias("event_start"),
        F.date_add(start, (event % 30).cast("int")).alias("event_end"),
        ((event % 2 == 0) & reached).alias("emergency"),
        _null_every(8, "event_id", (event % 3 == 0) & (user % 30 != 0)).alias("general_ward"),
        ((event % 5 == 0) & reached).alias("intermediate"),
        ((event % 7 == 0) & reached).alias("icu"),
    )


def targets(spark: SparkSession) -> DataFrame:
    return collector_dim(spark, COLLECTORS)


def samples(spark: SparkSession) -> DataFrame:
    return site_samples(spark, SITE_SAMPLES)


def code_dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two dimensions over the customers: each lacks codes that the other has, the second
    misspells some labels, gives some codes a second label and some none."""
    customers = table(spark, sf_dir, "customer")
    key, label = F.col("c_custkey"), F.col("c_mktsegment")
    first = customers.filter((key % 41 != 0) | (key % 37 == 0)).select(
        key.alias("code"), F.when(key % 43 != 0, label).alias("label")
    )
    spelt = F.when(key % 40 == 0, F.lower(label)).when(key % 53 != 0, label)
    more = F.when(key % 47 == 0, F.lit("SECOND"))
    second = customers.filter(key % 37 != 0).select(
        key.alias("code"), F.explode(F.when(more.isNull(), F.array(spelt)).otherwise(F.array(spelt, more))).alias("label")
    )
    return first, second
