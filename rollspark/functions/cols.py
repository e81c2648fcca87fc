"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


ROUND_SHIFT = 0.5 + 2.0 ** -13


def rnd(c, digits: int = 6) -> Column:
    """Round with plain double arithmetic: floor(x*10^d + 0.5 + 2^-13) / 10^d.

    Written so the same formula in any SQL engine gives bit-identical results
    (Spark's ``round`` goes through decimal text). The 2^-13 shift moves the
    rounding boundary off the short-decimal grid: values such as 12.55465 are
    exact ties for plain half-up rounding, and two engines summing in different
    orders land on either side of such a tie.
    """
    s = float(10 ** digits)
    x = col(c)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")) \
        .otherwise(F.floor(x * s + F.lit(ROUND_SHIFT)).cast("double") / F.lit(s))


def seeded_hash(seed, *cols) -> Column:
    """md5 hex of ``seed|c1|c2...``: stable, distributed, and the same in DuckDB."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def hash_unit(h) -> Column:
    """Uniform value in [0, 1) from the first 8 hex digits of an md5 column."""
    return F.conv(F.substring(col(h), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_int(h, modulo: int) -> Column:
    """Integer in [0, modulo) from the first 8 hex digits of an md5 column."""
    return F.pmod(F.conv(F.substring(col(h), 1, 8), 16, 10).cast("bigint"), F.lit(modulo))


def safe_div(num, den) -> Column:
    """NULL instead of an error or infinity when the denominator is 0."""
    return F.try_divide(col(num), col(den))


def array_sum(arr) -> Column:
    return F.aggregate(col(arr), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


def array_wsum(arr) -> Column:
    """sum_i (i+1) * x_i: an order-sensitive fingerprint of an array."""
    from rollspark.functions.arrays import place_weighted_sum
    return place_weighted_sum(arr)


def array_sums(arr) -> Column:
    """Struct of the sum (``sum``) and :func:`array_wsum` (``wsum``) of an array of doubles in one pass, without Python."""
    zero = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("wsum"))
    return F.aggregate(col(arr), zero, lambda a, x: F.struct((a["k"] + 1.0).alias("k"), (a["sum"] + x).alias("sum"), (a["wsum"] + x * (a["k"] + 1.0)).alias("wsum")))


def pystrip(c) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace (Spark's
    ``trim`` drops spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def with_scalars(df, stats):
    """Attach the columns of the one-row aggregate ``stats`` to every row of
    ``df``. The aggregate runs once as a scalar subquery (one struct value
    inlined into the plan), so no join and no broadcast relation is needed."""
    st = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("_st")).scalar()
    return df.withColumns({c: st[c] for c in stats.columns})
