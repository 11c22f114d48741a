"""Column expressions with the scalar rules of the source database dialect.

The reports were written for a database where the empty string *is* NULL,
``||`` ignores NULL operands, SUBSTR returns NULL for out-of-range positions,
numbers are exact decimals and ROUND rounds half away from zero.  Spark's
defaults differ on each point, so every report expression goes through these
helpers.  All of them are plain Catalyst expressions (codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def empty_as_null(c: ColumnOrName) -> Column:
    """'' becomes NULL (the source dialect has no empty string)."""
    return F.nullif(col(c), F.lit(""))


def ora_substr(s: ColumnOrName, start: int, length: ColumnOrName | int | None = None) -> Column:
    """SUBSTR(s, start[, length]) with the source dialect's rules.

    1-based; start 0 means 1; a negative start counts from the end.  The
    result is NULL when the start lies outside the string (before it for a
    negative start), when length < 1, and when the result would be empty.
    Spark's ``substr`` instead clamps ('abc', -5) to 'abc' and returns ''.
    """
    s = col(s)
    if start == 0:
        start = 1
    n = F.length(s)
    in_range = (n >= start) if start > 0 else (n >= -start)
    if length is None:
        piece = s.substr(F.lit(start), F.lit(2147483647))
        return F.when(in_range, empty_as_null(piece))
    length_c = _lit(length)
    piece = s.substr(F.lit(start), length_c)
    return F.when(in_range & (length_c >= 1), empty_as_null(piece))


def ora_concat(*parts: ColumnOrName) -> Column:
    """a || b || ... where NULL operands count as '' and '' is NULL."""
    return empty_as_null(F.concat_ws("", *[col(p).cast("string") for p in parts]))


def proper_name(name: ColumnOrName) -> Column:
    """UPPER(SUBSTR(n,1,1)) || LOWER(SUBSTR(n,2,50)).

    Not ``initcap``: only the very first letter is raised ('jean-paul dupont'
    -> 'Jean-paul dupont'), and the rest is cut after 50 characters.
    """
    name = col(name)
    return ora_concat(F.upper(ora_substr(name, 1, 1)), F.lower(ora_substr(name, 2, 50)))


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact integral division truncated toward zero (SQL ``a div b``)."""
    return F.call_function("div", col(a), col(b))


def round_share(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """ROUND(part * 100 / whole, 0) for counts, exact, half away from zero.

    Integer arithmetic only: floor((200*part + whole) / (2*whole)) is the
    half-up rounding of 100*part/whole for part, whole >= 0.  NULL when whole
    is 0 or NULL.
    """
    part, whole = col(part).cast("long"), col(whole).cast("long")
    return int_div(part * 200 + whole, F.nullif(whole, F.lit(0)) * 2).cast("int")


def trunc_ratio_pct(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """TRUNC(part / whole * 100) for non-negative integers, exact.

    A zero total gives NULL (the source database raises a division error).
    Computing part/whole*100 in floating point is wrong for e.g. 29/100.
    """
    part, whole = col(part).cast("long"), col(whole).cast("long")
    return int_div(part * 100, F.nullif(whole, F.lit(0)))


def lpad_number(n: ColumnOrName, width: int = 3) -> Column:
    """LPAD(n, width, 0) of an integer: the number is first written as text."""
    return F.lpad(col(n).cast("long").cast("string"), width, "0")


def share_string(*shares: ColumnOrName, width: int = 3, sep: str = " / ") -> Column:
    """LPAD(a,3,0) || ' / ' || LPAD(b,3,0) || ... -> '063 / 025 / 012'."""
    parts: list[Column] = []
    for i, s in enumerate(shares):
        if i:
            parts.append(F.lit(sep))
        parts.append(lpad_number(s, width))
    return ora_concat(*parts)


def _cast(value: ColumnOrName, dtype: str, strict: bool) -> Column:
    return col(value).cast(dtype) if strict else col(value).try_cast(dtype)


def to_integer(value: ColumnOrName, strict: bool = True) -> Column:
    """CAST(value AS INTEGER) of text or number: rounds half away from zero
    ('12.6' -> 13) and raises on malformed text, like the source dialect;
    ``strict=False`` turns malformed text into NULL instead."""
    return _cast(value, "decimal(38,0)", strict)


def to_decimal(value: ColumnOrName, precision: int = 10, scale: int = 3, strict: bool = True) -> Column:
    return _cast(value, f"decimal({precision},{scale})", strict)


def zero_if_null_decimal(value: ColumnOrName, precision: int = 10, scale: int = 3,
                         strict: bool = True) -> Column:
    """COALESCE(CAST(x AS DECIMAL(p,s)), 0), keeping type decimal(p,s)."""
    dtype = f"decimal({precision},{scale})"
    return F.coalesce(_cast(value, dtype, strict), F.lit(0).cast(dtype))


def flag(predicate: Column) -> Column:
    """CASE WHEN predicate THEN 1 ELSE 0 END (unknown counts as 0)."""
    return F.when(predicate, F.lit(1)).otherwise(F.lit(0))
