"""Descent by reverse communication: the caller evaluates, the descent says where, and its whole state is in tables.

`ask()` gives the next point, `tell()` takes its loss and gradient. What lies between two evaluations (phase, bracket and step of the line
search, the best point so far, pairs of the quasi-Newton memory) is a state of its own number, written before tell()
returns; vectors are written when they change. A caller that is lost goes on with a new Descent on the same path, in the
middle of a line search too, and gets the same points. An evaluation that is told twice counts once.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.plans.descent import combined, lbfgs_weights, products
from wavelake.sources.store import children, exists, publish

#: Evaluations of a line search, and the slope's share of a Wolfe condition.
TRIES, SLOPE = 10, 0.95


class Descent:
    """Limited-memory quasi-Newton over (i, v); iterates are those of descent.minimise(method="lbfgs")."""

    def __init__(self, spark: SparkSession, path: str, memory: int = 5, first: float = 1.0) -> None:
        self.spark, self.path, self.memory, self.first = spark, path.rstrip("/"), memory, first

    def begin(self, start: DataFrame) -> None:
        """Sets the first point; a path that has one goes on from where it is."""
        if not exists(self.spark, f"{self.path}/states"):
            self.write({"k": 0, "phase": "start", "vectors": self.saved(start.select("i", "v")), "losses": []})

    def state(self) -> dict:
        last = children(self.spark, f"{self.path}/states")[-1]
        return json.loads(self.spark.read.text(f"{self.path}/states/{last}").first()[0])

    def write(self, state: dict) -> None:
        """A state appears whole, under its number, once."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(staged)
        publish(self.spark, staged, f"{self.path}/states/{state['k']:08d}")

    def saved(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/vectors/{name}")
        return name

    def vectors(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors/{name}")

    def ask(self) -> tuple[int, DataFrame] | None:
        """The evaluation's number and its point (i, v); none if the descent has ended."""
        s = self.state()
        if s["phase"] == "end":
            return None
        table = self.vectors(s["vectors"])
        return s["k"], table.select("i", "v") if s["phase"] == "start" else combined(table, {"v": 1.0, "d": s["step"]}, "v").select("i", "v")

    def point(self) -> tuple[DataFrame, list[float]]:
        """The last accepted point, and the losses of all accepted ones."""
        s = self.state()
        return self.vectors(s["vectors"]).select("i", "v"), s["losses"]

    def tell(self, k: int, loss: float, grad: DataFrame) -> None:
        """(i, grad) and the loss of evaluation k. Numbers that were told before are ignored."""
        s = self.state()
        if k != s["k"] or s["phase"] == "end":
            return
        if s["phase"] == "start":
            table = self.vectors(s["vectors"]).join(grad.select("i", F.col("grad").alias("g")), "i")
            self.turn(s, table, loss, [loss], 0)
            return
        table = self.vectors(s["vectors"])
        now = products(table.select("i", "d").join(grad, "i"), ["grad", "d"])["grad", "d"]
        best = s["best"]
        if loss < s["loss"] and (best is None or loss < best["loss"]):
            best = {"step": s["step"], "loss": loss, "grad": self.saved(grad.select("i", "grad"))}
        left, right = s["left"], s["right"]
        if loss > s["loss"]:
            right = s["step"]
        elif now < SLOPE * s["slope"]:
            left = s["step"]
        else:
            self.accept(s, s["step"], loss, grad)
            return
        if s["tries"] + 1 < TRIES:
            step = (left + right) / 2 if right is not None else s["step"] * 5
            self.write(s | {"k": k + 1, "left": left, "right": right, "step": step, "best": best, "tries": s["tries"] + 1})
        elif best is None:
            self.write(s | {"k": k + 1, "phase": "end"})
        else:
            self.accept(s, best["step"], best["loss"], self.vectors(best["grad"]))

    def accept(self, s: dict, step: float, loss: float, grad: DataFrame) -> None:
        """Moves there; the step and the gradients' difference become the newest pair."""
        joined = self.vectors(s["vectors"]).join(grad.select("i", F.col("grad").alias("gn")), "i")
        drop = 1 if s["kept"] == self.memory else 0
        kept = s["kept"] - drop
        pairs = [F.col(f"{c}{i + drop}").alias(f"{c}{i}") for i in range(kept) for c in "sy"]
        pairs += [(step * F.col("d")).alias(f"s{kept}"), (F.col("gn") - F.col("g")).alias(f"y{kept}")]
        table = joined.select("i", (F.col("v") + step * F.col("d")).alias("v"), F.col("gn").alias("g"), *pairs)
        self.turn(s, table, loss, [*s["losses"], loss], kept + 1)

    def turn(self, s: dict, table: DataFrame, loss: float, losses: list[float], kept: int) -> None:
        """A new direction from a point with its gradient and pairs, and a line search along it."""
        table = self.vectors(self.saved(table))
        names = ["g", *(f"{c}{i}" for i in range(kept) for c in "sy")]
        table = combined(table, lbfgs_weights(products(table, names), kept), "d")
        dots = products(table, ["g", "d"])
        if dots["g", "d"] >= 0:  # no descent: straight down
            table = combined(table, {"g": -1.0}, "d")
            dots = products(table, ["g", "d"])
        made = {"k": s["k"] + 1, "vectors": self.saved(table), "losses": losses, "loss": loss, "kept": kept}
        if dots["g", "g"] == 0 or not math.isfinite(loss):
            self.write(made | {"phase": "end"})
            return
        step = self.first if len(losses) > 1 else self.first / max(1.0, float(np.sqrt(dots["g", "g"])))
        self.write(made | {"phase": "line", "slope": dots["g", "d"], "left": 0.0, "right": None, "step": step, "best": None, "tries": 0})
