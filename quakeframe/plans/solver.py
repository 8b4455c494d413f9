"""Sparse damped least squares by Golub-Kahan bidiagonals: on arrays for a system that fits a task, on tables for one that doesn't.

Both forms share the recurrences of scalars (``LsmrSteps``, ``LsqrSteps``), so they take the same steps and stop for the same reasons: ZERO (x = 0 is
the solution), SOLVED (within the tolerance), CONDITION (the estimate of the condition number is beyond the limit) or LIMIT (of iterations).
Callers decide which solves they reject."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import bucketed, drop

ZERO, SOLVED, CONDITION, LIMIT = "zero", "solved", "condition", "limit"
#: Condition number beyond which a system has no solution worth having.
MOST_CONDITION = 1.0 / (10 * np.sqrt(np.finfo(float).eps))
#: What a step does to the vectors: h_bar = h - a h_bar; x += b h_bar; h = v - c h.
Change = tuple[float, float, float]


class LsmrSteps:
    """Scalars of the least squares form of the minimum residual method."""

    def __init__(self, alpha: float, beta: float, damp: float, tolerance: float, condition: float):
        self.damp, self.tolerance, self.condition = damp, tolerance, condition
        self.zeta_bar, self.alpha_bar = alpha * beta, alpha
        self.rho = self.rho_bar = self.c_bar = 1.0
        self.s_bar, self.start, self.high, self.low, self.first = 0.0, alpha * beta, 0.0, np.inf, True

    def next(self, beta: float, alpha: float, h_square: float) -> tuple[Change, str | None]:
        alpha_hat = np.hypot(self.alpha_bar, self.damp)
        rho_old, self.rho = self.rho, np.hypot(alpha_hat, beta)
        rho = self.rho
        c, s = alpha_hat / rho, beta / rho
        theta, self.alpha_bar = s * alpha, c * alpha
        rho_bar_old, zeta_old = self.rho_bar, self.zeta_bar
        theta_bar, rho_temp = self.s_bar * rho, self.c_bar * rho
        self.rho_bar = np.hypot(rho_temp, theta)
        self.c_bar, self.s_bar = rho_temp / self.rho_bar, theta / self.rho_bar
        zeta, self.zeta_bar = self.c_bar * zeta_old, -self.s_bar * zeta_old
        change = (theta_bar * rho / (rho_old * rho_bar_old), zeta / (rho * self.rho_bar), theta / rho)
        if abs(self.zeta_bar) <= self.tolerance * self.start or alpha == 0:
            return change, SOLVED
        # singular values lie between the least and the greatest of the rotated diagonals
        if not self.first:
            self.high, self.low = max(self.high, rho_bar_old), min(self.low, rho_bar_old)
        self.first = False
        return change, CONDITION if max(self.high, rho_temp) > self.condition * min(self.low, rho_temp) else None


class LsqrSteps:
    """Scalars of plane rotations of the bidiagonals."""

    def __init__(self, alpha: float, beta: float, damp: float, tolerance: float, condition: float):
        self.damp, self.tolerance, self.condition = damp, tolerance, condition
        self.phi_bar, self.rho_bar, self.start = beta, alpha, alpha * beta
        self.directions, self.frobenius = 0.0, alpha * alpha

    def next(self, beta: float, alpha: float, h_square: float) -> tuple[Change, str | None]:
        self.frobenius += beta * beta + self.damp * self.damp
        damped = np.hypot(self.rho_bar, self.damp)
        self.phi_bar *= self.rho_bar / damped
        rho = np.hypot(damped, beta)
        c, s = damped / rho, beta / rho
        theta, self.rho_bar = s * alpha, -c * alpha
        phi, self.phi_bar = c * self.phi_bar, s * self.phi_bar
        self.directions += h_square / (rho * rho)
        change = (0.0, phi / rho, theta / rho)
        if abs(self.phi_bar) * alpha * abs(c) <= self.tolerance * self.start or alpha == 0:
            return change, SOLVED
        if self.frobenius * self.directions > self.condition * self.condition:
            return change, CONDITION
        self.frobenius += alpha * alpha
        return change, None


STEPS = {"LSMR": LsmrSteps, "LSQR": LsqrSteps}


def solve(method: str, forward: Callable, transposed: Callable, b: np.ndarray, n: int, damp: float = 0.0, tolerance: float = 1e-6, most: int | None = None, condition: float = MOST_CONDITION) -> tuple[np.ndarray, str]:
    """x of min |A x - b|^2 + damp^2 |x|^2, and why it stopped; ``forward`` and ``transposed`` multiply by A and its transpose."""
    x, beta = np.zeros(n), float(np.linalg.norm(b))
    if beta == 0:
        return x, ZERO
    u = b / beta
    v = transposed(u)
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return x, ZERO
    v /= alpha
    steps = STEPS[method](alpha, beta, damp, tolerance, condition)
    h, h_bar = v.copy(), np.zeros(n)
    for _ in range(most or max(2 * n, 50)):
        u = forward(v) - alpha * u
        beta = float(np.linalg.norm(u))
        u /= beta or 1.0
        v = transposed(u) - beta * v
        alpha = float(np.linalg.norm(v))
        v /= alpha or 1.0
        (a, b_, c), stopped = steps.next(beta, alpha, float(h @ h))
        h_bar = h - a * h_bar
        x = x + b_ * h_bar
        h = v - c * h
        if stopped:
            return x, stopped
    return x, LIMIT


def lsmr(forward: Callable, transposed: Callable, b: np.ndarray, n: int, damp: float = 0.0, tolerance: float = 1e-6, most: int | None = None, condition: float = MOST_CONDITION) -> tuple[np.ndarray, str]:
    return solve("LSMR", forward, transposed, b, n, damp, tolerance, most, condition)


def lsqr(forward: Callable, transposed: Callable, b: np.ndarray, n: int, damp: float = 0.0, tolerance: float = 1e-6, most: int | None = None, condition: float = MOST_CONDITION) -> tuple[np.ndarray, str]:
    return solve("LSQR", forward, transposed, b, n, damp, tolerance, most, condition)


def products(by_row: DataFrame, by_col: DataFrame, u: DataFrame, cols: DataFrame, u_scale: float, v_scale: float, shrink: float) -> tuple[DataFrame, Callable[[DataFrame, float, float], DataFrame]]:
    """The next left vector, (row, u) = A v - shrink u, and a function of it, its norm and what v is shrunk by for the next right one, (col, v, ...).

    The matrix is a table dealt by column and one dealt by row. It meets the vector of its own dealing where it lies; sums of products, added up
    in each part before, are all that is shuffled."""
    left = by_col.join(cols.select("col", "v"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("v") * v_scale).alias("_p"))
    left = u.join(left, "row", "left").select("row", (F.coalesce("_p", F.lit(0.0)) - F.col("u") * (u_scale * shrink)).alias("u"))

    def right(u: DataFrame, scale: float, shrink: float) -> DataFrame:
        sums = by_row.join(u, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("u") * scale).alias("_p"))
        return cols.join(sums, "col", "left").withColumn("_v", F.coalesce("_p", F.lit(0.0)) - F.col("v") * (v_scale * shrink)).drop("_p")

    return left, right


def solve_distributed(matrix: DataFrame, right: DataFrame, damp: float = 0.0, tolerance: float = 1e-6, most: int | None = None, condition: float = MOST_CONDITION, method: str = "LSMR") -> tuple[DataFrame, str]:
    """(col, x) of the damped least squares problem with matrix (row, col, value) and right side (row, value), and why it stopped: as ``solve`` has it.
    The result is a table that the caller drops.

    The matrix is written twice, dealt by row and by column. A step is two jobs: one writes the left vector, one the right vector with the
    solution and directions of the step before; their norms come with them. Each job's table replaces the one of the last step."""
    spark = matrix.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = matrix.select("row", "col", "value").where("value <> 0").groupBy("row", "col").agg(F.sum("value").alias("value"))
    by_row = bucketed(m, "row", buckets)
    by_col = bucketed(by_row, "col", buckets)
    rows = right.select("row", F.col("value").alias("u")).unionByName(by_row.select("row", F.lit(0.0).alias("u"))).groupBy("row").agg(F.sum("u").alias("u"))

    def seen(df: DataFrame, by: str, **squares: str) -> tuple[DataFrame, dict[str, float]]:
        """df as a bucketed table, and norms of columns."""
        found = Observation()
        saved = bucketed(df.observe(found, *(F.sum(F.col(c) * F.col(c)).alias(k) for k, c in squares.items()), F.count(F.lit(1)).alias("n")), by, buckets)
        return saved, {k: float(np.sqrt(v or 0.0)) if k != "n" else v for k, v in found.get.items()}

    u, norms = seen(rows, "row", u="u")
    beta = norms["u"]
    start = by_row.join(u, "row").groupBy("col").agg((F.sum(F.col("value") * F.col("u")) / (beta or 1.0)).alias("v"))
    cols, norms = seen(start.select("col", "v", *(F.lit(0.0).alias(c) for c in ("h", "h_bar", "x"))), "col", v="v")
    alpha, n = norms["v"], norms["n"]
    stopped, change = (ZERO, (0.0, 0.0, 0.0)) if beta == 0 or alpha == 0 else (None, (0.0, 0.0, 0.0))
    steps = STEPS[method](alpha, beta, damp, tolerance, condition)
    started = False

    def changed() -> list:
        """h, h_bar and x after the last step; the first step begins with h = v."""
        a, b, c = change
        h_bar = F.col("h") - a * F.col("h_bar") if started else F.lit(0.0)
        return [(F.col("v") / (alpha or 1.0) - c * F.col("h")).alias("h"), h_bar.alias("h_bar"), (F.col("x") + b * h_bar).alias("x")]

    for _ in range(most or max(2 * n, 50)):
        if stopped:
            break
        left, rest = products(by_row, by_col, u, cols, 1 / (beta or 1.0), 1 / (alpha or 1.0), alpha)
        after, norms = seen(left, "row", u="u")
        drop(u)
        u, beta = after, norms["u"]
        after, norms = seen(rest(u, 1 / (beta or 1.0), beta).select("col", F.col("_v").alias("_next"), *changed()).withColumnRenamed("_next", "v"), "col", v="v", h="h")
        drop(cols)
        cols, alpha = after, norms["v"]
        change, stopped = steps.next(beta, alpha, norms["h"] ** 2)
        started = True
    solved = bucketed(cols.select("col", changed()[2]), "col", buckets)
    drop(by_row, by_col, u, cols)
    return solved, stopped or LIMIT
