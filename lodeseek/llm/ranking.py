"""One ranking from several differently scaled scores (problem 1).

Each score becomes its rank within the group, scaled to 0..1, so no scale or outlier counts. The
correlation matrix of the ranks, each turned to its declared direction, is one distributed aggregation
over all rows; items sort by their projection on its first principal component.

All scores are ranked in one pass over (group, number of the score, value), so the plan doesn't grow
with them. Ranks are running sums in a global order by ranges: each range is sorted by itself, and
counts of whole ranges are added, so a group with a third of all rows is many small tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.session import spread, staged


def principal_component(correlation: np.ndarray) -> np.ndarray:
    """The first principal component of unit length with its own signs, turned as a whole so that most weight is positive.

    Of several equally large eigenvalues (unrelated scores) the mixture nearest to equal parts is taken.
    Scores without spread have no weight unless all are so, in which case all count alike.
    """
    k = len(correlation)
    c = np.where(np.isfinite(correlation), correlation, 0.0)
    live = np.diag(c) > 0
    if not live.any():
        return np.full(k, k**-0.5)
    values, vectors = np.linalg.eigh(c[np.ix_(live, live)])
    top = vectors[:, values > values[-1] - 1e-9]
    v = top @ (top.T @ np.ones(live.sum())) if top.shape[1] > 1 else top[:, 0]
    if np.linalg.norm(v) < 1e-9:
        v = np.ones(live.sum())
    out = np.zeros(k)
    out[live] = v / np.linalg.norm(v) * (1 if v.sum() >= 0 else -1)
    return out


def oriented(component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loadings with the sign of their declared directions (ranks come in turned to them, so positive), and where the component's own sign agrees.

    A loading whose own sign disagrees says that the score contradicts the others; turned, the result
    isn't the first component any more, but no score counts against its declared direction.
    """
    return np.abs(component), component >= 0


def _numbers(items: DataFrame, scores: dict[str, int]) -> list[Column]:
    out = []
    for c, sign in scores.items():
        x = F.expr(f"try_cast(`{c}` as double)")
        out.append(F.when(x.isNull() | F.isnan(x), None).otherwise(x * F.lit(float(sign)) + F.lit(0.0)))
    return out


def _running(rows: DataFrame, group: list[str], order: list[Column], weight: Column, label: str) -> DataFrame:
    """`rows` with `before` (weight of all rows of the group that come earlier in `order`)."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(spread(spark), *group, *order).withColumns({"__range": F.spark_partition_id(), "__w": weight})
    stored = staged(ranged, label)
    inside = F.sum("__w").over(Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = stored.groupBy(*(F.col(g).alias(f"__{g}") for g in group), F.col("__range").alias("__r")).agg(F.sum("__w").alias("__m"))
    # One row for each range that a group reaches: at most as many as there are ranges, in order of the ranges.
    above = sums.withColumn("__above", F.sum("__m").over(Window.partitionBy(*(f"__{g}" for g in group)).orderBy("__r")) - F.col("__m")).drop("__m")
    on = F.col("__range") == F.col("__r")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    out = stored.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(above, on)
    return out.withColumn("before", F.col("__above") + F.col("__inside")).select(*rows.columns, "before")


def scaled_ranks(items: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """g, i and r0, r1, ...: each score's mean rank within the group, scaled to 0..1 (1 is best), staged."""
    k = len(scores)
    rows = items.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), *(x.alias(f"s{j}") for j, x in enumerate(_numbers(items, scores)))).where("i is not null").distinct()
    rows = staged(rows.withColumn("row", F.xxhash64("g", "i", F.array(*(F.coalesce(F.col(f"s{j}").cast("string"), F.lit("-")) for j in range(k))))), "scores")
    long = rows.select("g", "i", "row", F.posexplode(F.array(*(f"s{j}" for j in range(k)))).alias("k", "s"))
    # Equal scores of a group are counted map-side before anything is sorted.
    values = long.groupBy("g", "k", "s").agg(F.count("*").alias("c"))
    below = _running(values, ["g", "k"], [F.col("s").asc_nulls_first()], F.col("c"), "values")
    total = rows.groupBy(F.col("g").alias("g1")).agg(F.count("*").alias("n"))
    ranked = below.join(total, F.col("g").eqNullSafe(F.col("g1")))
    table = ranked.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("s").alias("s2"), F.when(F.col("n") > 1, (F.col("before") + (F.col("c") - 1) / 2) / (F.col("n") - 1)).otherwise(1.0).alias("r"))
    met = long.join(table, F.col("g").eqNullSafe(F.col("g2")) & (F.col("k") == F.col("k2")) & F.col("s").eqNullSafe(F.col("s2")))
    return staged(met.groupBy("g", "i", "row").agg(*(F.max(F.when(F.col("k") == j, F.col("r"))).alias(f"r{j}") for j in range(k))).drop("row"), "ranks")


def loadings(items: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """score, direction, loading (of the first principal component, by its own sign) and agrees (its sign is the declared direction's), a row for each score."""
    v = principal_component(_correlation(scaled_ranks(items, group, item, scores), len(scores)))
    return items.sparkSession.createDataFrame([(c, d, float(x), bool(x >= 0)) for (c, d), x in zip(scores.items(), v, strict=True)], "score string, direction int, loading double, agrees boolean")


def rank_together(items: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """One ranking per group from several scores; `scores` maps column -> +1 (larger is better) or -1.

    Result: group, item (under their own names), rank_0, rank_1, ... (each score's scaled rank, 1 is
    best), projection and place (1 is first). Texts are read as numbers. A null, unreadable or NaN score
    is no evidence: it ranks below every score there is. Equal scores share the mean of their ranks.
    Equal projections are ordered by their best scaled rank, then by item. Repeated rows count once;
    null groups form one group; null items are left out. With one item in a group all ranks are 1. An
    empty table gives an empty result. Where a score's loading contradicts its declared direction
    (see `loadings`), it is turned to it.
    """
    k = len(scores)
    scaled = scaled_ranks(items, group, item, scores)
    w, _ = oriented(principal_component(_correlation(scaled, k)))
    projection = sum((F.lit(float(x)) * F.col(f"r{j}") for j, x in enumerate(w)), F.lit(0.0))
    best = F.greatest(*(F.col(f"r{j}") for j in range(k)), F.lit(0.0))
    order = [F.col("projection").desc(), F.col("best").desc(), F.col("i").asc()]
    placed = _running(scaled.withColumns({"projection": F.round(projection, 12), "best": best}), ["g"], order, F.lit(1), "placed")
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), *(F.col(f"r{j}").alias(f"rank_{j}") for j in range(k)), "projection", (F.col("before") + 1).cast("int").alias("place"))


def _correlation(scaled: DataFrame, k: int) -> np.ndarray:
    """k x k correlations from one aggregation; the driver gets k*k numbers."""
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    row = scaled.agg(*(F.coalesce(F.covar_pop(f"r{a}", f"r{b}"), F.lit(0.0)).alias(f"c{a}_{b}") for a, b in pairs)).first()
    c = np.zeros((k, k))
    for a, b in pairs:
        c[a, b] = c[b, a] = row[f"c{a}_{b}"]
    d = np.sqrt(np.maximum(np.diag(c), 0))
    return np.divide(c, np.outer(d, d), out=np.zeros_like(c), where=np.outer(d, d) > 1e-12)
