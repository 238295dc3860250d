"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, undefined=None) -> Column:
    """a / b; `undefined` where b is 0."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if undefined is None else F.coalesce(out, F.lit(undefined))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone is."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = F.round(F.expr("1000000") * F.date_part(F.lit("SECOND"), ts)).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def random_predictor(rate_per_hour: Column, hours: Column) -> Column:
    """Share of events that alarms at random with this rate would anticipate."""
    return 1 - F.exp(-rate_per_hour * hours)


def hash_uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the md5 of seed and keys, equal in every engine."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_order(seed: str, *keys: Column) -> Column:
    """The md5 of seed and keys; ordering by it draws at random in a reproducible way."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


#: A rational approximation of the error function's complement, right to 1.5e-7.
_ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(z: Column) -> Column:
    """The two-sided p of a standard normal deviate, right to 1.5e-7."""
    x = F.abs(z) / 2**0.5
    t, poly = 1 / (1 + _ERFC[0] * x), F.lit(0.0)
    for c in reversed(_ERFC[1:]):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def two_sided_sql(z: str) -> str:
    x, poly = f"(abs({z}) / sqrt(2.0))", "0.0::DOUBLE"
    for c in reversed(_ERFC[1:]):
        poly = f"(({poly} + {c}::DOUBLE) / (1 + {_ERFC[0]}::DOUBLE * {x}))"
    return f"({poly} * exp(-{x} * {x}))"
