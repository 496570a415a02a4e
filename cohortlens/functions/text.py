from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SUBGROUPS, WHITE_SPACE


def clean_upper(col: Column) -> Column:
    """Upper case without leading or trailing white space of any Unicode kind.

    Without a set of characters ``trim`` strips the plain space only.
    """
    return F.btrim(F.upper(col), F.lit(WHITE_SPACE))


def id_text(col: Column, data_type: str) -> Column:
    """An identifier as text; a whole number read as double keeps all its digits."""
    if data_type in ("double", "float"):
        whole = col.try_cast("decimal(38,0)").cast("string")
        return F.when(col == F.floor(col), whole).otherwise(col.cast("string"))
    return col.cast("string")


def subgroup_prefix(col: Column, prefixes: tuple[str, ...] = SUBGROUPS) -> Column:
    """The first prefix the text starts with, else NULL."""
    return F.coalesce(*[F.when(col.startswith(p), F.lit(p)) for p in prefixes])


def number_text(col: Column) -> Column:
    """Shortest text of a number: ``50.0`` is ``50``, ``12.5`` stays."""
    return F.regexp_replace(col.cast("string"), r"[.]0$", "")


def thousands(col: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(col, 0)


def pct_text(pct: Column) -> Column:
    return F.concat(number_text(pct), F.lit("%"))


def count_pct_text(n: Column, pct: Column) -> Column:
    """``n (p%)``, or plain ``n`` where the percentage has no base."""
    n_text = number_text(n)
    return F.when(pct.isNull(), n_text).otherwise(
        F.concat(n_text, F.lit(" ("), pct_text(pct), F.lit(")"))
    )


def relabel(col: Column, labels: dict[str, str]) -> Column:
    """Replace known values by their label; any other value passes through."""
    pairs = [F.lit(v) for pair in labels.items() for v in pair]
    if not pairs:
        return col
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)
