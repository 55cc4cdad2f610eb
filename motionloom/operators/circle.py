"""The circle through the middle of a run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Dynamics
from ..functions.columns import distance

KEYS = ("run_id",)


def mid_window(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """Rows within t_subset seconds of the run's middle row, with t_min and t_max."""
    every = W.partitionBy(*keys)
    half = F.floor(F.count("*").over(every) / 2)
    out = rows.withColumn("_half", half).withColumn("_mid", F.max(F.when(F.col("rn") == F.col("_half"), F.col("time"))).over(every))
    out = out.withColumn("t_min", F.col("_mid") - d.t_subset).withColumn("t_max", F.col("_mid") + d.t_subset)
    return out.where((F.col("time") >= F.col("t_min")) & (F.col("time") <= F.col("t_max"))).drop("_half", "_mid")


def radii(rows: DataFrame, xc, yc) -> DataFrame:
    return rows.withColumn("radius", distance(F.col("x") - xc, F.col("y") - yc))


def circle_residuals(rows: DataFrame, keys=KEYS) -> DataFrame:
    """radius and residual of each row about its run's centroid."""
    every = W.partitionBy(*keys)
    out = radii(rows.withColumn("xc", F.avg("x").over(every)).withColumn("yc", F.avg("y").over(every)), F.col("xc"), F.col("yc"))
    return out.withColumn("residual", F.col("radius") - F.avg("radius").over(every))


def circle_kasa(rows: DataFrame, keys=KEYS) -> DataFrame:
    """The algebraic fit (Kasa 1976): linear least squares about the mean, which a window over the same partitioning gives. Null where
    rows lie on a line."""
    every = W.partitionBy(*keys)
    c = rows.withColumn("mx", F.avg("x").over(every)).withColumn("my", F.avg("y").over(every)).withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    s = c.groupBy(*keys).agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.count("*").alias("n"), F.sum(F.expr("u*u")).alias("uu"), F.sum(F.expr("v*v")).alias("vv"), F.sum(F.expr("u*v")).alias("uv"),
        F.sum(F.expr("u*u*u + u*v*v")).alias("p"), F.sum(F.expr("v*v*v + v*u*u")).alias("q"),
    )
    det = F.nullif(F.expr("uu*vv - uv*uv"), F.lit(0.0))
    s = s.withColumn("a", F.expr("(p*vv - q*uv) / 2") / det).withColumn("b", F.expr("(q*uu - p*uv) / 2") / det)
    return s.select(*keys, "n", (F.col("mx") + F.col("a")).alias("xc"), (F.col("my") + F.col("b")).alias("yc"), F.sqrt(F.expr("a*a + b*b + (uu + vv) / n")).alias("radius"))


def fit_circle(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """Centre and radius of least spread of the distances: damped Gauss-Newton from the centroid, as circle_fit() does it, for kernels that have
    a run's rows anyway."""
    cx, cy = float(x.mean()), float(y.mean())

    def spread(a: float, b: float) -> tuple[np.ndarray, float]:
        r = np.hypot(x - a, y - b)
        return r, float(((r - r.mean()) ** 2).sum())

    r, cost = spread(cx, cy)
    damp = 1e-3
    for _ in range(steps):
        safe = np.where(r > 0, r, 1)
        u, v = np.where(r > 0, (cx - x) / safe, 0.0), np.where(r > 0, (cy - y) / safe, 0.0)
        j = np.column_stack([u - u.mean(), v - v.mean()])
        g, h = j.T @ (r - r.mean()), j.T @ j
        while damp < 1e12:
            step = np.linalg.solve(h + damp * (np.diag(np.diag(h)) + 1e-12 * np.eye(2)), -g)
            r2, cost2 = spread(cx + step[0], cy + step[1])
            if cost2 <= cost:
                break
            damp *= 4
        else:
            break
        small = abs(cost - cost2) <= 1e-14 * max(cost, 1e-300) or np.hypot(*step) <= 1e-12 * (np.hypot(cx, cy) + 1e-12)
        cx, cy, r, cost, damp = cx + step[0], cy + step[1], r2, cost2, max(damp / 8, 1e-12)
        if small:
            break
    return cx, cy, float(r.mean())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _state(p: Column, cx: Column, cy: Column, damp: Column) -> Column:
    """Of a centre: the spread of the points' distances, its gradient and Gauss-Newton matrix, and their mean. Distances count from the
    first one's, so that sums of squares lose no digits."""
    names = ("n", "d", "dd", "u", "v", "uu", "vv", "uv", "du", "dv")

    def of(s: Column, q: Column, r0: Column) -> Column:
        r = distance(q["x"] - cx, q["y"] - cy)
        one = F.struct((r - r0).alias("d"), F.when(r > 0, (cx - q["x"]) / r).otherwise(0.0).alias("u"), F.when(r > 0, (cy - q["y"]) / r).otherwise(0.0).alias("v"))
        terms = lambda t: {"n": F.lit(1.0), "d": t.d, "dd": t.d * t.d, "u": t.u, "v": t.v, "uu": t.u * t.u, "vv": t.v * t.v, "uv": t.u * t.v, "du": t.d * t.u, "dv": t.d * t.v}
        return _let(one, lambda t: F.struct(*((s[k] + x).alias(k) for k, x in terms(t).items())))

    first = distance(p[0]["x"] - cx, p[0]["y"] - cy)
    sums = _let(first, lambda r0: F.struct(r0.alias("r0"), F.aggregate(p, F.struct(*(F.lit(0.0).alias(k) for k in names)), lambda s, q: of(s, q, r0)).alias("s")))
    about = lambda t, a, b, ab: t.s[ab] - t.s[a] * t.s[b] / t.s.n
    return _let(sums, lambda t: F.struct(
        cx.alias("cx"), cy.alias("cy"), damp.alias("damp"), (t.r0 + t.s.d / t.s.n).alias("radius"), about(t, "d", "d", "dd").alias("cost"), about(t, "d", "u", "du").alias("gu"), about(t, "d", "v", "dv").alias("gv"),
        about(t, "u", "u", "uu").alias("uu"), about(t, "u", "v", "uv").alias("uv"), about(t, "v", "v", "vv").alias("vv"), F.lit(False).alias("done"),
    ))


def _step(p: Column, s: Column) -> Column:
    """The state after a damped step: the new centre where the spread isn't larger, else the old one with four times the damping."""
    uu, vv = s.uu * (1 + s.damp) + 1e-12 * s.damp, s.vv * (1 + s.damp) + 1e-12 * s.damp
    move = _let(uu * vv - s.uv * s.uv, lambda det: F.struct(F.coalesce(F.try_divide(s.uv * s.gv - vv * s.gu, det), F.lit(0.0)).alias("x"), F.coalesce(F.try_divide(s.uv * s.gu - uu * s.gv, det), F.lit(0.0)).alias("y")))
    fields = ("cx", "cy", "radius", "cost", "gu", "gv", "uu", "uv", "vv")

    def chosen(m: Column, t: Column) -> Column:
        better = t.cost <= s.cost
        small = (F.abs(s.cost - t.cost) <= 1e-14 * F.greatest(s.cost, F.lit(1e-300))) | (distance(m.x, m.y) <= 1e-12 * (distance(s.cx, s.cy) + 1e-12))
        damp = F.when(better, F.greatest(s.damp / 8, F.lit(1e-12))).otherwise(s.damp * 4)
        out = {k: F.when(better, t[k]).otherwise(s[k]) for k in fields} | {"damp": damp, "done": (better & small) | (damp > 1e12)}
        return F.struct(*(out[k].alias(k) for k in ("cx", "cy", "damp", "radius", "cost", "gu", "gv", "uu", "uv", "vv", "done")))

    return _let(move, lambda m: _let(_state(p, s.cx + m.x, s.cy + m.y, s.damp), lambda t: chosen(m, t)))


def circle_fit(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), steps: int = 100) -> DataFrame:
    """(keys, t_min, t_max, x_data, y_data, xc, yc, R) of the middle of each run; R null where there is no fit. Damped Gauss-Newton steps over all runs at
    once: each is a fold over a run's gathered points, so one exchange serves all of them and nothing leaves the JVM. A run that has
    come to rest stays as it is; `steps` bounds the others."""
    rows = mid_window(rows, keys, d).select(*keys, "t_min", "t_max", *(F.col(c).cast("double").alias(c) for c in ("time", "x", "y")))
    runs = rows.groupBy(*keys).agg(F.first("t_min").alias("t_min"), F.first("t_max").alias("t_max"), F.array_sort(F.collect_list(F.struct("time", "x", "y"))).alias("p"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    mean = lambda c: F.aggregate("p", F.lit(0.0), lambda s, q: s + q[c]) / F.size("p")
    runs = runs.withColumns({"fine": F.forall("p", lambda q: finite(q["x"]) & finite(q["y"])), "mx": mean("x"), "my": mean("y")})
    start = _state(F.col("p"), F.col("mx"), F.col("my"), F.lit(1e-3))
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s.done, s).otherwise(_step(F.col("p"), s)))
    runs = runs.withColumn("fit", F.when(F.col("fine"), fit))
    return runs.select(*keys, "t_min", "t_max", F.col("p.x").alias("x_data"), F.col("p.y").alias("y_data"), F.col("fit.cx").alias("xc"), F.col("fit.cy").alias("yc"), F.col("fit.radius").alias("R"))
