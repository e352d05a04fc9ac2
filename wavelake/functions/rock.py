"""Column expressions of rock physics, bounds and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lame(vp: ColumnLike, vs: ColumnLike, rho: ColumnLike) -> dict[str, Column]:
    """mu, lam, lam2mu, b."""
    vp, vs, rho = map(col, (vp, vs, rho))
    mu, lam2mu = vs * vs * rho, vp * vp * rho
    return {"mu": mu, "lam": lam2mu - 2 * mu, "lam2mu": lam2mu, "b": 1 / F.nullif(rho, F.lit(0.0))}


def thomsen_to_moduli(vp: ColumnLike, vs: ColumnLike, rho: ColumnLike, eps: ColumnLike, delta: ColumnLike, gamma: ColumnLike) -> dict[str, Column]:
    """c11, c13, c33, c44, c66 of a medium with a vertical axis."""
    vp, vs, rho, eps, delta, gamma = map(col, (vp, vs, rho, eps, delta, gamma))
    c33, c44 = rho * vp * vp, rho * vs * vs
    gap = c33 - c44
    return {"c11": c33 * (1 + 2 * eps), "c13": F.sqrt(2 * c33 * gap * delta + gap * gap) - c44, "c33": c33, "c44": c44, "c66": c44 * (1 + 2 * gamma)}


def moduli_to_thomsen(c11: ColumnLike, c13: ColumnLike, c33: ColumnLike, c44: ColumnLike, c66: ColumnLike, rho: ColumnLike) -> dict[str, Column]:
    c11, c13, c33, c44, c66, rho = map(col, (c11, c13, c33, c44, c66, rho))
    gap = c33 - c44
    return {
        "vp": F.sqrt(c33 / rho), "vs": F.sqrt(c44 / rho), "eps": (c11 - c33) / (2 * c33),
        "delta": ((c13 + c44) * (c13 + c44) - gap * gap) / (2 * c33 * gap), "gamma": (c66 - c44) / (2 * c44),
    }


def transverse(c11: ColumnLike, c13: ColumnLike, c33: ColumnLike, c44: ColumnLike, c66: ColumnLike, axis: str = "vti") -> dict[str, Column]:
    """The moduli of the x-z plane: c11, c13, c33, c55; a horizontal axis swaps 11 with 33; 55 is 44 in both."""
    c11, c13, c33, c44, c66 = map(col, (c11, c13, c33, c44, c66))
    if axis.lower() == "vti":
        return {"c11": c11, "c13": c13, "c33": c33, "c55": c44}
    if axis.lower() == "hti":
        return {"c11": c33, "c13": c13, "c33": c11, "c55": c44}
    raise ValueError(f"unknown axis {axis}")


#: The upper half of the stiffness matrix, row by row.
STIFFNESS = tuple(f"c{i}{j}" for i in range(1, 7) for j in range(i, 7))


def isotropic_stiffness(c11: ColumnLike, c13: ColumnLike, c33: ColumnLike, c44: ColumnLike, c66: ColumnLike) -> dict[str, Column]:
    """All 21 moduli of an isotropic medium; those not named here are 0."""
    c11, c13, c33, c44, c66 = map(col, (c11, c13, c33, c44, c66))
    known = {"c11": c11, "c12": c11 - 2 * c66, "c13": c13, "c22": c11, "c23": c13, "c33": c33, "c44": c44, "c55": c44, "c66": c66}
    return {name: known.get(name, F.lit(0.0)) for name in STIFFNESS}


def slowness_to_velocity(m: ColumnLike) -> Column:
    """Squared slowness (s2/km2) -> velocity (m/s); null where it isn't positive."""
    return F.when(col(m) > 0, F.sqrt(1 / col(m)) * 1000)


def pressure(txx: ColumnLike, tzz: ColumnLike) -> Column:
    """The pressure of two normal stresses."""
    return -(col(txx) + col(tzz))


def gardner(vp: ColumnLike) -> Column:
    return 310 * F.pow(col(vp), F.lit(0.25))


def vp_from_vs(vs: ColumnLike) -> Column:
    return F.sqrt(F.lit(3.0)) * col(vs)


def clamp(v: ColumnLike, low: float | None, high: float | None) -> Column:
    """Within the bounds; unchanged unless both are set."""
    return col(v) if low is None or high is None else F.least(F.greatest(col(v), F.lit(low)), F.lit(high))


def constrained(v: ColumnLike, low: float | None, high: float | None) -> Column:
    """NaN becomes the upper bound, then clamp(); unchanged unless both bounds are set."""
    return col(v) if low is None or high is None else clamp(F.nanvl(col(v), F.lit(high)), low, high)


def positive(x: ColumnLike, kind: str, least: ColumnLike | None = None, theta: float = 1.0) -> Column:
    """Transforms to non-negative values; `linear` shifts by theta times the least value of both inputs."""
    x = col(x)
    made = {
        "linear": lambda: x - theta * F.least(col(least), F.lit(0.0)) if least is not None else x,
        "abs": lambda: F.abs(x),
        "square": lambda: x * x,
        "exp": lambda: F.exp(theta * x),
        "softplus": lambda: F.log1p(F.exp(theta * x)),
    }
    return made.get(kind, lambda: x)() + 1e-18


def step_weight(i: int, step: int, alpha: float, gamma: float = 0.8) -> float:
    return alpha * gamma ** (i // step)


def range_map(x: ColumnLike, low: float, high: float) -> Column:
    """A network's output to a velocity between low and high (km/s), in m/s."""
    return ((high - low) * F.tanh(col(x)) + (high + low)) / 2 * 1000
