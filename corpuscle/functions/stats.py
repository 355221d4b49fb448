"""Statistics as column expressions, with the same arithmetic as SQL text for other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# erfc by the power series of erf for small z, and by its continued fraction for large z.
SERIES_TERMS, FRACTION_TERMS, SWITCH = 60, 40, 2.5


def _erfc(z: str) -> str:
    """SQL text of erfc(z), z >= 0, by series below SWITCH and Lentz's continued fraction from there on; to about 1e-14 relative."""
    # erf(z) = 2/sqrt(pi) * exp(-z^2) * z * sum_n (2 z^2)^n / (1*3*...*(2n+1)), all terms positive, so nothing cancels in the sum.
    series = "1.0e0"
    for n in range(SERIES_TERMS, 0, -1):
        series = f"(1.0e0 + {series} * (2.0e0 * {z} * {z}) / {2 * n + 1}.0e0)"
    erf = f"(1.1283791670955126e0 * exp(-{z} * {z}) * {z} * {series})"
    fraction = f"({z})"
    for n in range(FRACTION_TERMS, 0, -1):
        fraction = f"({z} + {n / 2}e0 / {fraction})"
    tail = f"(exp(-{z} * {z}) * 0.5641895835477563e0 / {fraction})"
    return f"CASE WHEN {z} < {SWITCH}e0 THEN 1.0e0 - {erf} ELSE {tail} END"


def chi2_tail_sql(z: str = "z") -> str:
    """P(X > x) for one degree of freedom, as SQL text for Spark and DuckDB, of the name z of sqrt(x / 2)."""
    return _erfc(z)


def chi2_tail(x: str) -> Column:
    """The same of an SQL expression x >= 0; z is bound once, as the text has it many times."""
    return F.expr(f"aggregate(array(sqrt(({x}) / 2.0e0)), 0.0e0, (s, z) -> {_erfc('z')})")


def log2(x: Column) -> Column:
    """log2, with -infinity for 0 (Spark has null)."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log2(x))


def mutual_information(statistic: str, observed: Column, total: Column, node: Column, n: Column) -> Column:
    """The PMI family: o, t, w and N of collocates, their totals, the node and all."""
    joint = F.log2(observed / n)
    pmi = joint - F.log2(total / n * (node / n))
    return {"pmi": pmi, "npmi": F.try_divide(pmi, -joint), "pmi2": pmi + joint, "pmi3": pmi + 2 * joint}[statistic]
