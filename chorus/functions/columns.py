"""Column-level helpers shared by the operators.

All of them build native Catalyst expressions, so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# No escape character: SQLite's LIKE has none, so '%' and '_' in a user's
# text stay wildcards and a backslash is an ordinary character.
NO_ESCAPE = "\u0001"

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def as_of_col(as_of=None) -> Column:
    """The evaluation instant: a pinned timestamp or ``current_timestamp()``."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(str(as_of)))


def lookback(ts: Column, as_of=None, hours: float | None = None, days: int | None = None,
             boundary: str = "instant") -> Column:
    """``ts > as_of - window``.

    ``boundary="instant"`` is the intent (real instants, strict ``>``).
    ``boundary="utc_day"`` reproduces the reference's text comparison of an
    ISO value with a space-separated cutoff: any row on the cutoff's UTC
    date passes.
    """
    if hours is not None and hours < 0 or days is not None and days < 0:
        raise ValueError("look-back must not be negative")
    now = as_of_col(as_of)
    if hours is not None:
        cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))
    elif days is not None:
        cutoff = now - F.make_dt_interval(F.lit(int(days)))
    else:
        raise ValueError("give hours or days")
    if boundary == "instant":
        return ts > cutoff
    if boundary == "utc_day":
        return F.to_date(ts) >= F.to_date(cutoff)
    raise ValueError(f"unknown boundary {boundary!r}")


def blank_to_null(c: Column) -> Column:
    """JS ``x || default`` treats '' as missing: map '' to NULL first."""
    return F.nullif(c, F.lit(""))


def js_or(c: Column, default) -> Column:
    """``c || default`` for strings: NULL or '' give the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(blank_to_null(c), d)


def contains_ci(c: Column, text: str) -> Column:
    """SQLite ``c LIKE '%text%'``: case-insensitive, wildcards kept, no escape."""
    return F.ilike(c, F.lit(f"%{text}%"), F.lit(NO_ESCAPE))


def iso_text(ts: Column) -> Column:
    """Timestamp to the ISO text the reference stores (``toISOString``)."""
    return F.date_format(ts, ISO_FORMAT)


def has_visible_text(c: Column) -> Column:
    """True when something other than whitespace is left (JS ``trim()`` is
    Unicode-aware, Spark's ``trim`` strips spaces only)."""
    return F.regexp_like(c, F.lit(r"(?U)\S"))


def map_lookup(mapping: dict, key: Column, default=None) -> Column:
    """``mapping[key] || default`` as a literal map lookup (no join)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    looked = F.try_element_at(F.create_map(*items), key)
    return looked if default is None else F.coalesce(looked, F.lit(default))


def upper_words(category: Column) -> Column:
    """``category.replace(/_/g, ' ').toUpperCase()``."""
    return F.upper(F.replace(category, F.lit("_"), F.lit(" ")))


def log_preview(content: Column, n: int = 100) -> Column:
    """First ``n`` characters, with '...' only when the text is longer (the
    ingest log line; the recent-alerts view always appends '...')."""
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))).otherwise(content)
