"""Column helpers: safe arithmetic, banding, rounding, calendar parts, JSON lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT_LIST = "array<struct<product_id:bigint,attributed_revenue:double,attributed_units:bigint,featured_position:bigint>>"


HALF_WAY_NUDGE = 1.0000000000001


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """num / den as double; `default` (null if not given) where the divisor is null or zero."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def ratio_pos(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num / den only where the divisor is positive, `default` elsewhere."""
    other = F.lit(None).cast("double") if default is None else F.lit(float(default))
    return F.when(col(den) > 0, ratio(num, den)).otherwise(other)


def floor_div(num: str | Column, den: str | Column, floor: float = 1.0) -> Column:
    """num / max(den, floor): the usual guard against tiny divisors."""
    return col(num).cast("double") / F.greatest(col(den).cast("double"), F.lit(float(floor)))


def money(c: str | Column) -> Column:
    """Two decimals, decided on a decimal value so half cents round the same in every engine."""
    return F.round(col(c).cast("decimal(18,4)"), 2).cast("double")


def whole(c: str | Column) -> Column:
    """Truncate a non-negative double to a bigint."""
    return F.floor(col(c)).cast("bigint")


def _bands(c, steps, default, test) -> Column:
    out: Column | None = None
    for bound, label in steps:
        cond = test(col(c), F.lit(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def at_least(c: str | Column, steps: Sequence[tuple], default=None) -> Column:
    """First label whose lower bound (inclusive) the value reaches."""
    return _bands(c, steps, default, lambda x, b: x >= b)


def above(c: str | Column, steps: Sequence[tuple], default=None) -> Column:
    """First label whose lower bound (exclusive) the value exceeds."""
    return _bands(c, steps, default, lambda x, b: x > b)


def up_to(c: str | Column, steps: Sequence[tuple], default=None) -> Column:
    """First label whose upper bound (inclusive) covers the value."""
    return _bands(c, steps, default, lambda x, b: x <= b)


def cases(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First rule that holds decides the label."""
    out: Column | None = None
    for cond, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(c: str | Column, table: dict, default) -> Column:
    """Value of a small fixed table, as a map literal inside the projection (no join)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 elsewhere (null counts as 0)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def day(d: date | str) -> Column:
    return F.lit(str(d)).cast("date")


def days_before(as_of: date | str, n: int) -> Column:
    return F.date_sub(day(as_of), n)


def since(c: str | Column, as_of: date | str, n: int) -> Column:
    """Value on or after `as_of` minus n days."""
    return col(c) >= days_before(as_of, n)


def dow(c: str | Column) -> Column:
    """Day of week, Sunday = 0."""
    return (F.dayofweek(col(c)) - 1).cast("bigint")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def product_list(c: str | Column) -> Column:
    """JSON array of products; null when absent or malformed."""
    return F.from_json(col(c), PRODUCT_LIST)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for reporting, leaving names and order as they are.

    The nudge of one part in 10^13 makes exact half-way values round the same way whatever the
    order in which a distributed sum was added up.
    """
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") * HALF_WAY_NUDGE, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def first_present(df: DataFrame, names: Sequence[str], default: float | None = 0.0) -> Column:
    """The first of several alternative columns that the frame has; a literal when it has none."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default).cast("double")
