"""Smoothed probabilities and co-occurrence statistics as column expressions.

Inputs are n rows, f_a and f_b of them with A and with B, f_ab with both. A relative state s in 0..3 has bit 0 for A and
bit 1 for B. Everything is arithmetic over columns, evaluated inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def ep(f: Column, n: Column, p: Column | float, w: Column | float) -> Column:
    """Estimated probability: f of n seen, prior p with weight w."""
    return (f + p * w) / (n + w)


def inverse_variance_weighting(e1: Column, v1: Column, e2: Column, v2: Column) -> Column:
    """The mean of two estimates, each weighted by the inverse of its variance."""
    return (e1 / v1 + e2 / v2) / (1 / v1 + 1 / v2)


def ep2(f: Column, n: Column, prior: float, prior_w: float = 1.0, bias_w: float = 4.0) -> Column:
    """The relative frequency and the prior, weighted by inverse variance: the frequency's is prior_w / n, the prior's
    prior (1 - prior) plus the square of how far the prior is from a smoothed estimate. Without rows, or for
    a prior of 0 or 1, the prior itself."""
    spread = prior * (1 - prior)
    if spread == 0:
        return F.lit(float(prior))
    off = prior - ep(f, n, prior, bias_w / spread)
    return F.when(n == 0, F.lit(float(prior))).otherwise(inverse_variance_weighting(f / n, prior_w / n, F.lit(prior), spread + off * off))


def information(p: Column) -> Column:
    """-log2 p."""
    return -F.log2(p)


def binary_entropy(p: Column) -> Column:
    """Bits of a yes with probability p; 0 at 0 and 1."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - q * F.log2(q))


@dataclass(frozen=True)
class CoStats:
    """The statistics of one pair of sets. ``divided`` weighs the marginals' prior by prior_w / prior, else by prior_w."""

    n: Column
    f_a: Column
    f_b: Column
    f_ab: Column
    prior_w: float = 2.0
    prior_a: float = 0.5
    prior_b: float = 0.5
    divided: bool = True

    def _marginal(self, f: Column, prior: float) -> Column:
        return ep(f, self.n, prior, self.prior_w / prior if self.divided else self.prior_w)

    @property
    def p_a(self) -> Column:
        return self._marginal(self.f_a, self.prior_a)

    @property
    def p_b(self) -> Column:
        return self._marginal(self.f_b, self.prior_b)

    @property
    def h_a(self) -> Column:
        return binary_entropy(self.p_a)

    @property
    def h_b(self) -> Column:
        return binary_entropy(self.p_b)

    def frequency(self, s: int) -> Column:
        return (self.n - self.f_a - self.f_b + self.f_ab, self.f_a - self.f_ab, self.f_b - self.f_ab, self.f_ab)[s]

    def naive(self, s: int) -> Column:
        """The state's probability if A and B were independent."""
        return (self.p_a if s & 1 else 1 - self.p_a) * (self.p_b if s & 2 else 1 - self.p_b)

    def p(self, s: int) -> Column:
        """The state's smoothed probability; the four need not sum to 1."""
        return (self.frequency(s) + self.prior_w) / (self.n + self.prior_w / self.naive(s))

    def lift(self, s: int) -> Column:
        return self.p(s) / self.naive(s)

    def lift_of(self, a: bool, b: bool) -> Column:
        return self.lift(int(a) + 2 * int(b))

    def mi_part(self, s: int) -> Column:
        return self.p(s) * F.log2(self.lift(s))

    @property
    def mi(self) -> Column:
        """Mutual information over the four states."""
        return self.mi_part(0) + self.mi_part(1) + self.mi_part(2) + self.mi_part(3)

    def columns(self) -> list[Column]:
        """All of the above with names."""
        states = [e for s in range(4) for e in (self.p(s).alias(f"ps_{s}"), self.lift(s).alias(f"d_{s}"))]
        return [self.p_a.alias("p_a"), self.p_b.alias("p_b"), self.h_a.alias("h_a"), self.h_b.alias("h_b"), *states, self.mi.alias("mi")]
