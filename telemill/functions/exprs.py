"""Small column expressions shared by the operators.

Nothing here runs Python per row: each helper returns a ``Column`` made of
built-in Spark functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.schema import NULL_TOKENS


def epoch_us_sql(ts: str) -> str:
    """SQL text: microseconds since 1970 on the clock that wrote a naive timestamp, in any session zone.

    A cast to TIMESTAMP would read the clock in the session's zone, where hours are missing or come twice.
    """
    return (f"(unix_date(CAST({ts} AS DATE)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L "
            f"+ CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))")


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, by its own clock."""
    return F.expr(epoch_us_sql(f"`{ts}`"))


def ts_text(ts: Column | str) -> Column:
    """Text of a naive timestamp as Python's ``str(Timestamp)`` writes it:
    ``yyyy-MM-dd HH:mm:ss`` and six fraction digits only when the fraction is non-zero."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz").cast("string")
    return F.when(F.length(c) > 19, F.rpad(c, 26, "0")).otherwise(c)


def minute_text(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.substring(c.cast("timestamp_ntz").cast("string"), 1, 16)


def nan_to_null(c: Column) -> Column:
    """Spark's avg/stddev do not skip NaN; pandas does. Turn NaN into NULL."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def null_if_token(c: Column) -> Column:
    """Missing-value tokens of a text cell become NULL."""
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def non_blank(c: Column) -> Column:
    """NULL for NULL or empty text, the value otherwise (Python truthiness of a str)."""
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace incl. newlines."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fence_body(t: Column) -> Column:
    """Stripped text without the Markdown code fence around it.

    If the text starts with a triple backtick, drop the first line and cut at
    the last triple backtick (keep the rest when there is none), strip again.
    A fence line without a newline yields NULL (no reply can be read).
    """
    body = F.regexp_replace(t, r"^```[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)```(?!.*```).*$", "")
    return (
        F.when(t.startswith("```") & ~t.contains("\n"), F.lit(None).cast("string"))
        .when(t.startswith("```"), strip_ws(body))
        .otherwise(t)
    )


def round1(x: str) -> Column:
    """Python's ``round(x, 1)`` of a double column: the exact binary value decides, exact ties go to even.

    10x = 8x + 2x, whose rounding error is recovered exactly (TwoSum), so a
    value that only looks like a tie after multiplication is told apart.
    """
    s = f"(8D * {x} + 2D * {x})"
    b = f"({s} - 8D * {x})"
    e = f"((8D * {x} - ({s} - {b})) + (2D * {x} - {b}))"
    tie = f"{s} - floor({s}) = 0.5D"
    return F.expr(f"CASE WHEN {tie} AND {e} > 0D THEN floor({s}) + 1D WHEN {tie} AND {e} < 0D THEN floor({s}) + 0D "
                  f"ELSE rint({s}) END / 10D")


def fixed(x: str, digits: int) -> Column:
    """Python's ``f"{x:.0f}"`` or ``f"{x:.1f}"`` of a double column, by its exact binary value."""
    if digits == 0:
        return F.format_string("%.0f", F.expr(f"rint({x})"))
    if digits == 1:
        return F.format_string("%.1f", round1(x))
    raise ValueError("0 or 1 digits")


def thousands(c: Column) -> Column:
    """Python's ``f"{n:,}"`` of a whole number."""
    return F.format_number(c, 0)
