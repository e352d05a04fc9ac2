"""Descent methods over a table of unknowns: vectors are columns and stay in Spark; only inner products come back.

An objective takes (i, v) and gives (loss, (i, grad)). Limited-memory quasi-Newton needs one aggregate for each direction:
the inner products of the gradient and the kept pairs, from which the two-loop recursion finds the direction's
coefficients; the direction itself is a projection.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.sources.store import settled

Objective = Callable[[DataFrame], tuple[float, DataFrame]]
#: (i, g) -> (i, pg), symmetric and positive.
Precondition = Callable[[DataFrame], DataFrame]
#: (i, v) and (i, d) -> (i, hd), the Hessian at v times d.
Product = Callable[[DataFrame, DataFrame], DataFrame]


def combined(table: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(c)
    return table.withColumn(name, total)


def products(table: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """All inner products of the columns, in one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = table.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).first()
    return {key: float(x or 0.0) for (a, b), x in zip(pairs, row, strict=True) for key in ((a, b), (b, a))}


def first_loop(dots: dict[tuple[str, str], float], memory: int) -> tuple[dict[str, float], dict[int, float]]:
    """Coefficients of g and y0, y1, ... (0 is the oldest) after the recursion's first loop, and its steps along the s."""
    q, alphas = {"g": 1.0}, {}
    for i in range(memory - 1, -1, -1):
        alphas[i] = sum(w * dots[k, f"s{i}"] for k, w in q.items()) / dots[f"s{i}", f"y{i}"]
        q[f"y{i}"] = q.get(f"y{i}", 0.0) - alphas[i]
    return q, alphas


def second_loop(q: dict[str, float], alphas: dict[int, float], dots: dict[tuple[str, str], float], memory: int) -> dict[str, float]:
    """Minus the approximate inverse Hessian times g, from what the first loop left (or its preconditioned vector)."""
    if memory:
        k = memory - 1
        scale = dots[f"s{k}", f"y{k}"] / dots[f"y{k}", f"y{k}"]
        q = {c: w * scale for c, w in q.items()}
    for i in range(memory):
        beta = sum(w * dots[k, f"y{i}"] for k, w in q.items()) / dots[f"s{i}", f"y{i}"]
        q[f"s{i}"] = q.get(f"s{i}", 0.0) + alphas[i] - beta
    return {c: -w for c, w in q.items()}


def lbfgs_weights(dots: dict[tuple[str, str], float], memory: int) -> dict[str, float]:
    return second_loop(*first_loop(dots, memory), dots, memory)


def preconditioned_lbfgs(table: DataFrame, memory: int, precondition: Precondition) -> DataFrame:
    """The table with d: what the first loop leaves is preconditioned before the second. One aggregate more."""
    pairs = [f"{c}{i}" for i in range(memory) for c in "sy"]
    q, alphas = first_loop(products(table, ["g", *pairs]), memory)
    made = precondition(combined(table, q, "q").select("i", F.col("q").alias("g")))
    table = settled(table.join(made.select("i", F.col("pg").alias("q")), "i"))
    return combined(table, second_loop({"q": 1.0}, alphas, products(table, ["q", *pairs]), memory), "d")


def forcing_term(grad: DataFrame, residual: DataFrame, norm_before: float, before: float) -> float:
    """How far the next Newton system is to be solved: the gap between the new gradient (i, grad) and the one that the
    quadratic model foresaw (i, r), by the gradient's norm before; it falls no faster than by the golden power."""
    gap = grad.join(residual, "i").select((F.col("grad") - F.col("r")).alias("e"))
    eta = np.sqrt(products(gap, ["e"])["e", "e"]) / max(norm_before, 1e-300)
    floor = before ** ((1 + np.sqrt(5)) / 2)
    eta = max(eta, floor) if floor > 0.1 else eta
    return float(0.9 if eta > 1 else eta)


def wolfe(objective: Objective, table: DataFrame, loss: float, slope: float, first: float, tries: int = 10, low: float = 0.0, high: float = 0.95) -> tuple[float, float, DataFrame] | None:
    """A step along `d` that meets both Wolfe conditions, by bracketing (times 5) and bisection: step, loss, gradient."""
    left, right, a = 0.0, None, first
    best = None
    for _ in range(tries):
        moved = combined(table, {"v": 1.0, "d": a}, "v").select("i", "v")
        value, grad = objective(moved)
        now = products(table.select("i", "d").join(grad, "i"), ["grad", "d"])["grad", "d"]
        if value < loss and (best is None or value < best[1]):
            best = a, value, grad
        if value > loss + low * a * slope:
            right = a
        elif now < high * slope:
            left = a
        else:
            return a, value, grad
        a = (left + right) / 2 if right is not None else a * 5
    return best


def minimise(objective: Objective, start: DataFrame, method: str = "lbfgs", iterations: int = 20, memory: int = 5, tolerance: float = 1e-6, first: float = 1.0, product: Product | None = None, precondition: Precondition | None = None, inner: int = 5, forcing: float = 0.9) -> tuple[DataFrame, list[float]]:
    """start (i, v) -> (i, v) and the losses. Methods: sd, cg (Polak-Ribiere, started over outside of [0, 2]), lbfgs, newton
    (truncated; it needs product). A preconditioner serves lbfgs and newton."""
    if method not in ("sd", "cg", "lbfgs", "newton"):
        raise ValueError(f"unknown method {method}")
    if method == "newton" and product is None:
        raise ValueError("newton needs the Hessian's product")
    if precondition is not None and method not in ("lbfgs", "newton"):
        raise ValueError(f"{method} takes no preconditioner")
    loss, grad = objective(start)
    table = settled(start.join(grad.select("i", F.col("grad").alias("g")), "i"))
    losses, kept = [loss], 0
    for k in range(iterations):
        weights = None
        if method == "newton":
            at = table.select("i", "v")
            made = newton_direction(table, lambda t, at=at: product(at, t), inner, forcing, precondition)
            table = settled(table.join(made, "i"))
        elif method == "lbfgs" and precondition is not None:
            table = settled(preconditioned_lbfgs(table, kept, precondition))
        elif method == "lbfgs":
            names = ["g", *(f"{c}{i}" for i in range(kept) for c in "sy")]
            weights = lbfgs_weights(products(table, names), kept)
        elif method == "cg" and k:
            dots = products(table, ["g", "gb"])
            beta = (dots["g", "g"] - dots["g", "gb"]) / max(dots["gb", "gb"], 1e-300)
            weights = {"g": -1.0, "db": beta if 0 <= beta <= 2 else 0.0}
        else:
            weights = {"g": -1.0}
        table = table if weights is None else settled(combined(table, weights, "d"))
        dots = products(table, ["g", "d"])
        if dots["g", "d"] >= 0:  # no descent: straight down
            table = settled(combined(table, {"g": -1.0}, "d"))
            dots = products(table, ["g", "d"])
        if dots["g", "g"] == 0:
            break
        found = wolfe(objective, table, loss, dots["g", "d"], first if k or method == "newton" else first / max(1.0, np.sqrt(dots["g", "g"])))
        if found is None:
            break
        a, loss, grad = found
        joined = table.join(grad.select("i", F.col("grad").alias("gn")), "i")
        if method == "newton":
            forcing = forcing_term(grad, table.select("i", "r"), np.sqrt(dots["g", "g"]), forcing)
            pairs = []
        elif method == "lbfgs":
            drop = 1 if kept == memory else 0
            pairs = [F.col(f"{c}{i + drop}").alias(f"{c}{i}") for i in range(kept - drop) for c in "sy"]
            kept = kept - drop + 1
            pairs += [(a * F.col("d")).alias(f"s{kept - 1}"), (F.col("gn") - F.col("g")).alias(f"y{kept - 1}")]
        else:
            pairs = [F.col("g").alias("gb"), F.col("d").alias("db")]
        table = settled(joined.select("i", (F.col("v") + a * F.col("d")).alias("v"), F.col("gn").alias("g"), *pairs))
        losses.append(loss)
        if loss < tolerance * losses[0]:
            break
    return table.select("i", "v"), losses


def newton_direction(table: DataFrame, product: Callable[[DataFrame], DataFrame], inner: int = 5, forcing: float = 0.1, precondition: Precondition | None = None) -> DataFrame:
    """(i, g) -> (i, d, r): (preconditioned) conjugate gradients on H d = -g, where product takes (i, d) to (i, hd), and what
    is left, r = g + H d; stops at negative curvature, after `inner` rounds, or when r is `forcing` of the gradient."""

    def with_z(state: DataFrame) -> DataFrame:
        if precondition is None:
            return state.withColumn("z", F.col("r"))
        return state.join(precondition(state.select("i", F.col("r").alias("g"))).select("i", F.col("pg").alias("z")), "i")

    state = with_z(table.select("i", "g", F.lit(0.0).alias("d"), F.col("g").alias("r")))
    state = settled(state.withColumn("p", -F.col("z")))
    goal = forcing * np.sqrt(products(state, ["g"])["g", "g"])
    for k in range(inner):
        full = settled(state.join(product(state.select("i", F.col("p").alias("d"))), "i"))
        dots = products(full, ["r", "z", "p", "hd"])
        if dots["p", "hd"] <= 0:
            return state.select("i", (F.col("p") if k == 0 else F.col("d")).alias("d"), "r")
        a = dots["r", "z"] / dots["p", "hd"]
        moved = settled(with_z(full.select("i", "g", (F.col("d") + a * F.col("p")).alias("d"), (F.col("r") + a * F.col("hd")).alias("r"), "p")))
        after = products(moved, ["r", "z"])
        state = settled(combined(moved, {"z": -1.0, "p": after["r", "z"] / max(dots["r", "z"], 1e-300)}, "p"))
        if np.sqrt(after["r", "r"]) <= goal:
            break
    return state.select("i", "d", "r")
