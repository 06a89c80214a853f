"""Statistical tests as SQL expressions over already aggregated rows.

Arguments are column names or expressions, results are expressions for ``selectExpr`` or ``expr``.

Spark has no ``erf``/``lgamma``. Both tail areas below are integrals of smooth positive functions, so a fixed
Gauss-Legendre rule, folded over a literal array, gives them to about 1e-12 without leaving the JVM.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

P_VALUE_LIMIT = 0.05
EFFECT_LIMIT = 0.5
# Above this many degrees of freedom the t distribution is taken as normal.
NORMAL_DF = 100.0

_POINTS = 48


class Sample(NamedTuple):
    """Names of the columns that describe one side; ``n`` is a double (products of counts overflow integers)."""

    mean: str
    var: str
    n: str


def _doubles(values: np.ndarray) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _integral01(integrand: str, points: int = _POINTS) -> str:
    """Integral over [0, 1] of an expression of ``node_``."""
    x, w = np.polynomial.legendre.leggauss(points)
    terms = f"zip_with({_doubles((x + 1) / 2)}, {_doubles(w / 2)}, (node_, weight_) -> weight_ * ({integrand}))"
    return f"aggregate({terms}, 0D, (sum_, term_) -> sum_ + term_)"


def erfc(y: str) -> str:
    """Complementary error function for y >= 0."""
    small = f"1 - {2 / math.sqrt(math.pi)!r}D * ({y}) * {_integral01(f'exp(-pow(({y}) * node_, 2))', 32)}"
    # Craig's form: (2/pi) * integral over [0, pi/2] of exp(-(y / sin theta)^2)
    tail = _integral01(f"exp(-pow(({y}) / sin(node_ * {math.pi / 2!r}D), 2))")
    return f"(case when ({y}) < 2 then {small} else {tail} end)"


def normal_two_tailed(z: str) -> str:
    return erfc(f"abs({z}) / {math.sqrt(2)!r}D")


def normal_cdf(z: str) -> str:
    return f"abs(if(({z}) <= 0, 0, 1) - {normal_two_tailed(z)} / 2)"


def t_two_tailed(t: str, df: str) -> str:
    """Two-tailed Student t p-value; normal above NORMAL_DF, 1 for df <= 0 or NaN input.

    With x = sqrt(df) / tan(phi) the tail area is the share of the integral of sin(phi)^(df-1) over [0, pi/2]
    that lies below phi0 = atan(sqrt(df) / |t|). The power moves points towards the steep end, further for df < 1,
    where the integrand has no bound at 0.
    """
    power = f"greatest(3D, 3D / ({df}))"

    def area(phi: str) -> str:
        integrand = f"{power} * pow(node_, {power} - 1) * pow(sin(({phi}) * pow(node_, {power})), ({df}) - 1)"
        return f"({phi}) * {_integral01(integrand)}"

    exact = f"{area(f'atan2(sqrt({df}), abs({t}))')} / ({area(f'{math.pi / 2!r}D')})"
    p = f"case when ({df}) > {NORMAL_DF}D then {normal_two_tailed(t)} when ({df}) > 0 then {exact} else 1D end"
    return f"nanvl(greatest(0D, least(1D, {p})), 1D)"


def pct_change(base: str, tip: str) -> str:
    """Change in percent of |base|; 0 when base is 0."""
    return f"if({base} <> 0, ({tip} - {base}) / abs({base}) * 100, 0D)"


def welch_t(a: Sample, b: Sample) -> tuple[str, str]:
    """(t, degrees of freedom); t is 0 and df null when either side has fewer than two values or no spread."""
    qa, qb = f"({a.var} / {a.n})", f"({b.var} / {b.n})"
    usable = f"{a.n} >= 2 and {b.n} >= 2 and {qa} + {qb} <> 0"
    t = f"if({usable}, ({a.mean} - {b.mean}) / sqrt({qa} + {qb}), 0D)"
    spread = f"({qa} * {qa} / ({a.n} - 1) + {qb} * {qb} / ({b.n} - 1))"
    return t, f"if({usable}, if({spread} > 0, pow({qa} + {qb}, 2) / {spread}, 1D), null)"


def welch_p(t: str, df: str) -> str:
    return f"if({df} is null, 1D, {t_two_tailed(t, df)})"


def mann_whitney(u_a: str, n_a: str, n_b: str) -> tuple[str, str]:
    """(U, z) from the first sample's U; z is null when undefined. Counts are doubles."""
    usable = f"{n_a} >= 2 and {n_b} >= 2"
    u = f"least({u_a}, {n_a} * {n_b} - {u_a})"
    sigma = f"sqrt({n_a} * {n_b} * ({n_a} + {n_b} + 1) / 12)"
    return f"if({usable}, {u}, 0D)", f"if({usable}, ({u} - {n_a} * {n_b} / 2) / {sigma}, null)"


def mann_whitney_p(z: str) -> str:
    """Normal approximation, no tie or continuity correction; U never exceeds its mean so z <= 0."""
    return f"if({z} is null, 1D, {normal_two_tailed(z)})"


def cohens_d(a: Sample, b: Sample) -> str:
    pooled = f"sqrt((({a.n} - 1) * {a.var} + ({b.n} - 1) * {b.var}) / ({a.n} + {b.n} - 2))"
    return f"if({a.n} >= 2 and {b.n} >= 2, if({pooled} <> 0, ({a.mean} - {b.mean}) / {pooled}, 0D), 0D)"


def is_regression(
    t_p: str,
    u_p: str,
    d: str,
    pct: str,
    more_is_better: str,
    p_limit: float = P_VALUE_LIMIT,
    effect_limit: float = EFFECT_LIMIT,
) -> str:
    """Significant, large enough and in the harmful direction. Spark orders NaN above every number, hence isnan."""
    significant = f"({t_p} < {p_limit}D or {u_p} < {p_limit}D)"
    large = f"(not isnan({d}) and abs({d}) >= {effect_limit}D)"
    harmful = f"(not isnan({pct}) and if({more_is_better}, {pct} < 0, {pct} > 0))"
    return f"{significant} and {large} and {harmful}"
