"""The normal distribution in plain SQL text that Spark and DuckDB both run.

qnorm is Acklam's rational approximation (absolute error under 4e-9 after clamping); pnorm is Hart's algorithm in West's form
(error about 1e-15).  Both take the name of a column or any cheap expression.
"""

from __future__ import annotations

# Coefficients of the published approximations.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_LOW = 0.02425
_EDGE = 3.552713678800501e-15


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _horner(cs: tuple[float, ...], x: str) -> str:
    out = _d(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {_d(c)})"
    return out


def qnorm(u: str) -> str:
    p = f"greatest({_d(_EDGE)}, least(1 - {_d(_EDGE)}, {u}))"
    tail = lambda q: f"({_horner(_C, q)} / ({_horner(_D, q)} * {q} + 1))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_horner(_A, r)} * {q} / ({_horner(_B, r)} * {r} + 1))"
    return f"(CASE WHEN {u} IS NULL THEN NULL WHEN {p} < {_LOW} THEN {tail(low)} WHEN {p} > 1 - {_LOW} THEN -{tail(high)} ELSE {mid} END)"


def pnorm(x: str) -> str:
    z, e = f"abs({x})", f"exp(-({x}) * ({x}) / 2)"
    near = f"({e} * {_horner(_P, z)} / {_horner(_Q, z)})"
    chain = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        chain = f"({z} + {k} / {chain})"
    far = f"({e} / {chain} / {_d(2.506628274631)})"
    upper = f"(CASE WHEN {z} > 37 THEN {_d(0.0)} WHEN {z} < {_d(7.07106781186547)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"
