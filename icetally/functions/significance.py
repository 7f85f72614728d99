"""Tail probabilities for the two-sample rank test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of the Chebyshev fit of erfc (Press et al., Numerical Recipes,
# section 6.2), relative error below 1.2e-7 everywhere, highest power first.
ERFC_COEFFICIENTS = (
    0.17087277,
    -0.82215223,
    1.48851587,
    -1.13520398,
    0.27886807,
    -0.18628806,
    0.09678418,
    0.37409196,
    1.00002368,
    -1.26551223,
)


def erfc_positive(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    t = F.lit(1.0) / (x * F.lit(0.5) + F.lit(1.0))
    power = F.lit(ERFC_COEFFICIENTS[0])
    for coefficient in ERFC_COEFFICIENTS[1:]:
        power = power * t + F.lit(coefficient)
    return t * F.exp(power - x * x)


def normal_two_sided(z: Column) -> Column:
    """P(|N(0,1)| >= z) for ``z >= 0``; a negative ``z`` (after the continuity correction) gives 1."""
    positive = F.greatest(z, F.lit(0.0))
    return F.least(erfc_positive(positive / F.sqrt(F.lit(2.0))), F.lit(1.0))


def exact_two_sided(u: Column, n1: Column, n2: Column) -> Column:
    """Two-sided exact p of U without ties; null where ``u`` is, or a sample is empty.

    Dynamic programming over the ranks in ascending order: row j of the table holds how many ways
    there are to have placed j values of the first sample, by their U so far. Such a value adds the
    number of values of the second sample below it. All terms are positive, so tails keep their
    relative accuracy. Swapping the samples mirrors U, so the smaller one is placed: with n values
    in it and m in the other one the work is some (n + m) * n * n * m steps, for small samples.
    """
    n1, n2 = F.least(n1, n2), F.greatest(n1, n2)
    size = (n1 * n2).cast("int")
    start = F.transform(
        F.sequence(F.lit(0), n1.cast("int")),
        lambda j: F.transform(
            F.sequence(F.lit(0), size), lambda k: F.when((j == 0) & (k == 0), 1.0).otherwise(0.0)
        ),
    )

    def place(table: Column, rank: Column) -> Column:
        def row_of(row: Column, j: Column) -> Column:
            shift = rank - j
            fewer = F.get(table, j - 1)
            moved = F.transform(
                row, lambda x, k: x + F.when((shift >= 0) & (k >= shift), F.get(fewer, k - shift)).otherwise(0.0)
            )
            return F.when(j == 0, row).otherwise(moved)

        return F.transform(table, row_of)

    ranks = F.sequence(F.lit(1), (n1 + n2).cast("int"))
    ways = F.element_at(F.aggregate(ranks, start, place), -1)
    upper = F.greatest(u, n1 * n2 - u).cast("int")
    total = F.aggregate(ways, F.lit(0.0), lambda a, b: a + b)
    tail = F.aggregate(F.slice(ways, upper + 1, size - upper + 1), F.lit(0.0), lambda a, b: a + b)
    both = u.isNotNull() & (n1 > 0) & (n2 > 0)
    return F.when(both, F.least(F.lit(1.0), 2 * tail / total))
