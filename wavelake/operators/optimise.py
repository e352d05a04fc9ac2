"""One optimiser step as a projection: a row for each unknown with its gradient and state, new state out.

State columns: m, s (first and second moments), t is the step's number from 1. No unknown meets another, so a step is a
map over the table and needs no shuffle. Quasi-Newton methods need a few dot products besides: see plans.descent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def value() -> Column:
    return F.col("v")


def slope() -> Column:
    return F.col("grad")


def first() -> Column:
    return F.col("m")


def second() -> Column:
    return F.col("s")


def sgd(lr: float, t: int, momentum: float = 0.0) -> dict[str, Column]:
    m = slope() if t == 1 else momentum * first() + slope()
    return {"m": m, "v": value() - lr * m}


def adagrad(lr: float, t: int, eps: float = 1e-10) -> dict[str, Column]:
    s = second() + slope() * slope()
    return {"s": s, "v": value() - lr * slope() / (F.sqrt(s) + eps)}


def rmsprop(lr: float, t: int, alpha: float = 0.99, eps: float = 1e-8) -> dict[str, Column]:
    s = alpha * second() + (1 - alpha) * slope() * slope()
    return {"s": s, "v": value() - lr * slope() / (F.sqrt(s) + eps)}


def adam(lr: float, t: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.0) -> dict[str, Column]:
    """With decay, AdamW's: the value shrinks by lr * decay first."""
    m, s = b1 * first() + (1 - b1) * slope(), b2 * second() + (1 - b2) * slope() * slope()
    return {"m": m, "s": s, "v": value() * (1 - lr * decay) - lr * (m / (1 - b1**t)) / (F.sqrt(s / (1 - b2**t)) + eps)}


def adamw(lr: float, t: int, decay: float = 0.01) -> dict[str, Column]:
    return adam(lr, t, decay=decay)


def adamax(lr: float, t: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> dict[str, Column]:
    m, s = b1 * first() + (1 - b1) * slope(), F.greatest(b2 * second(), F.abs(slope()) + eps)
    return {"m": m, "s": s, "v": value() - lr / (1 - b1**t) * m / s}


def nadam(lr: float, t: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, psi: float = 4e-3) -> dict[str, Column]:
    mu = lambda i: b1 * (1 - 0.5 * 0.96 ** (i * psi))
    product = 1.0
    for i in range(1, t + 1):
        product *= mu(i)
    m, s = b1 * first() + (1 - b1) * slope(), b2 * second() + (1 - b2) * slope() * slope()
    root = F.sqrt(s / (1 - b2**t)) + eps
    return {"m": m, "s": s, "v": value() - lr * (1 - mu(t)) / (1 - product) * slope() / root - lr * mu(t + 1) / (1 - product * mu(t + 1)) * m / root}


def radam(lr: float, t: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> dict[str, Column]:
    m, s = b1 * first() + (1 - b1) * slope(), b2 * second() + (1 - b2) * slope() * slope()
    most = 2 / (1 - b2) - 1
    now = most - 2 * t * b2**t / (1 - b2**t)
    hat = m / (1 - b1**t)
    if now <= 5:
        return {"m": m, "s": s, "v": value() - lr * hat}
    r = ((now - 4) * (now - 2) * most / ((most - 4) * (most - 2) * now)) ** 0.5
    return {"m": m, "s": s, "v": value() - lr * hat * r * (1 - b2**t) ** 0.5 / (F.sqrt(s) + eps)}


def adadelta(lr: float, t: int, rho: float = 0.9, eps: float = 1e-6) -> dict[str, Column]:
    s = rho * second() + (1 - rho) * slope() * slope()
    step = F.sqrt(first() + eps) / F.sqrt(s + eps) * slope()
    return {"s": s, "m": rho * first() + (1 - rho) * step * step, "v": value() - lr * step}


def asgd(lr: float, t: int, lambd: float = 1e-4) -> dict[str, Column]:
    """m holds the average of the values, which starts over until t0, so it is the value itself."""
    v = value() * (1 - lambd * lr) - lr * slope()
    return {"v": v, "m": v}


def rprop(lr: float, t: int, down: float = 0.5, up: float = 1.2, least: float = 1e-6, most: float = 50.0) -> dict[str, Column]:
    """m is the gradient before, s the step size (lr at first)."""
    before, size = (F.lit(0.0), F.lit(lr)) if t == 1 else (first(), second())
    turn = slope() * before
    s = F.least(F.greatest(size * F.when(turn > 0, up).when(turn < 0, down).otherwise(1.0), F.lit(least)), F.lit(most))
    g = F.when(turn < 0, 0.0).otherwise(slope())
    return {"m": g, "s": s, "v": value() - F.sign(g) * s}


RULES: dict[str, Callable[..., dict[str, Column]]] = {f.__name__: f for f in (sgd, adagrad, rmsprop, adam, adamw, adamax, nadam, radam, adadelta, asgd, rprop)}


def step(state: DataFrame, rule: str, lr: float, t: int, **options: float) -> DataFrame:
    """(keys, v, grad, m, s) after one step of the rule."""
    if rule not in RULES:
        raise ValueError(f"unknown optimiser {rule}")
    return state.withColumns(RULES[rule](lr, t, **options))


def step_rate(lr: float, i: int, size: int, gamma: float) -> float:
    return lr * gamma ** (i // size)


def projected(state: DataFrame, low: float, high: float, inset: float = 100.0) -> DataFrame:
    """Values beyond a bound land that far inside it."""
    return state.withColumn("v", F.when(value() > high, high - inset).when(value() < low, low + inset).otherwise(value()))


def dot(state: DataFrame, a: str, b: str) -> float:
    """The inner product of two columns; only its one number comes back."""
    return float(state.agg(F.sum(F.col(a) * F.col(b))).first()[0] or 0.0)


def polak_ribiere(state: DataFrame) -> DataFrame:
    """(grad, before, pgrad, direction): the next conjugate direction; beta is 0 outside [0, 2]."""
    one = state.agg((F.sum((F.col("grad") - F.col("before")) * F.col("pgrad")) / F.nullif(F.sum(F.col("before") * F.col("before")), F.lit(0.0))).alias("beta"), F.lit(1).alias("k_"))
    beta = F.when(F.col("beta").between(0, 2), F.col("beta")).otherwise(0.0)
    return state.withColumn("k_", F.lit(1)).join(F.broadcast(one), "k_").withColumn("direction", -F.col("pgrad") + beta * F.col("direction")).drop("k_", "beta")
