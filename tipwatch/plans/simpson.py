"""Tail areas in plain SQL by Simpson's rule, to check the statistics independently."""

from __future__ import annotations

STEPS = 2000


def _integral(upper: str, density: str) -> str:
    """Integral from 0 to ``upper``; ``density`` is an expression of ``{x}``."""
    x = f"(({upper}) * i / {STEPS}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    terms = f"list_transform(range(0, {STEPS + 1}), lambda i: {weight} * {density.format(x=x)})"
    return f"(({upper}) / {STEPS}.0 / 3 * list_sum({terms}))"


def normal_two_tailed(z: str) -> str:
    return f"(1 - 2 * {_integral(f'least(abs({z}), 12)', 'exp(-{x} * {x} / 2) / sqrt(2 * pi())')})"


def normal_cdf(z: str) -> str:
    half = f"{normal_two_tailed(z)} / 2"
    return f"(CASE WHEN ({z}) <= 0 THEN {half} ELSE 1 - {half} END)"


def t_two_tailed(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi())"
    density = f"{scale} * pow(1 + {{x}} * {{x}} / ({df}), -(({df}) + 1) / 2)"
    exact = f"(1 - 2 * {_integral(f'abs({t})', density)})"
    return f"(CASE WHEN ({df}) > 100 THEN {normal_two_tailed(t)} ELSE {exact} END)"
