"""Boosted trees for very many models at once: one for each symbol, fold, or both, over the rows of a frame.

A model is a row: its keys, its base value and its trees. Trees grow level by level from histograms of gradients by (model, node,
feature, bin). Models of up to ``task_rows`` rows are grown in one task each, all of them in one job; larger ones
by Spark aggregations of the histograms, a few jobs a level for all of them together, so no model's rows have to fit anywhere.
Gradients are rounded to whole multiples of a power of two whose sums are exact, so a histogram doesn't depend on
the order or place of its rows, and both ways grow the same trees.

Nulls (and NaN) go to the side of a split that they gain more on. Rows and features of a tree are drawn by hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import settled

KEYS = ("symbol", "date")
TREE = "struct<feature:array<int>,threshold:array<double>,nulls_left:array<boolean>,gain:array<double>,value:array<double>>"
LEAST_GAIN = 1e-6
_P = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]  # primes of XXH64: fixed values


@dataclass(frozen=True)
class Boost:
    """``rows`` and ``columns``: shares that each tree sees. ``ridge`` and ``least``: penalty and least sum of second derivatives
    of a leaf. ``bins``: at most so many intervals of a feature, between its quantiles."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    ridge: float = 1.0
    least: float = 1.0
    seed: int = 42

    def features(self, tree: int, n: int) -> list[int]:
        """The features that a tree may split on, ascending."""
        own = np.random.default_rng((self.seed, tree)).permutation(n)[: max(1, int(self.columns * n))]
        return sorted(own.tolist())

    def draw(self, tree: int) -> int:
        return self.seed * 1_000_003 + tree


def hashed(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 64-bit values, as ``xxhash64`` has it."""
    p = [np.uint64(x) for x in _P]
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64) + p[4] + np.uint64(8)
        h = h ^ turn(values.astype(np.uint64) * p[1], 31) * p[0]
        h = turn(h, 27) * p[0] + p[3]
        h = (h ^ (h >> np.uint64(33))) * p[1]
        h = (h ^ (h >> np.uint64(29))) * p[2]
        return h ^ (h >> np.uint64(32))


def drawn(ids: np.ndarray, tree: int, boost: Boost) -> np.ndarray:
    h = hashed(np.full(1, boost.draw(tree)), hashed(ids, 42))
    return (h >> np.uint64(11)).astype(np.float64) < boost.rows * 2.0**53


def grow(binned: np.ndarray, y: np.ndarray, ids: np.ndarray, edges: list[np.ndarray], base: float, scale: float, weight: float, kind: str, boost: Boost) -> list[dict]:
    """The trees of one model. ``binned``: rows x features, the number of edges below a value, ``boost.bins`` for nulls."""
    n, m = binned.shape
    slots, size = boost.bins + 1, 2 ** (boost.depth + 1) - 1
    margin, trees = np.full(n, base), []
    rows = np.arange(n)
    w = np.where(y == 1, weight, 1.0) if kind == "classifier" else None
    for t in range(boost.trees):
        if w is not None:
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
        else:
            g, h = margin - y, np.ones(n)
        g, h = np.rint(g * scale), np.maximum(np.rint(h * scale), 1)
        own = boost.features(t, m)
        b = binned[:, own].astype(np.int64) + np.arange(len(own)) * slots
        use, node = drawn(ids, t, boost), np.zeros(n, np.int64)
        tree = {"feature": np.full(size, -1, np.int32), "threshold": np.zeros(size), "nulls_left": np.zeros(size, bool), "gain": np.zeros(size), "value": np.zeros(size)}
        for level in range(boost.depth + 1):
            first, width = 2**level - 1, 2**level
            live = use & (node >= first)
            at, gs, hs = node[live] - first, g[live], h[live]
            sums = [np.bincount(at, x, width) / scale for x in (gs, hs)]
            filled = sums[1] > 0
            tree["value"][first : first + width][filled] = -sums[0][filled] / (sums[1][filled] + boost.ridge) * boost.rate
            if level == boost.depth or not len(at):
                break
            k = (at * (len(own) * slots))[:, None] + b[live]
            cells = [np.bincount(k.ravel(), np.repeat(x, len(own)), width * len(own) * slots).reshape(width, len(own), slots) for x in (gs, hs)]
            best = best_splits(cells[0], cells[1], sums[0], sums[1], scale, boost)
            split = np.flatnonzero(best[0] > LEAST_GAIN)
            if not len(split):
                break
            for i in split:
                f, cut = own[best[1][i]], best[2][i]
                tree["feature"][first + i], tree["gain"][first + i], tree["nulls_left"][first + i] = f, best[0][i], best[3][i]
                tree["threshold"][first + i] = edges[f][cut] if cut < len(edges[f]) else np.inf
            feature, cut, nulls = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
            feature[first + split], cut[first + split], nulls[first + split] = [own[best[1][i]] for i in split], best[2][split], best[3][split]
            moving = feature[node] >= 0
            value = binned[rows[moving], feature[node[moving]]]
            left = np.where(value == boost.bins, nulls[node[moving]], value <= cut[node[moving]])
            node[moving] = 2 * node[moving] + np.where(left, 1, 2)
        margin = margin + tree["value"][node]
        trees.append(tree)
    return trees


def best_splits(g: np.ndarray, h: np.ndarray, all_g: np.ndarray, all_h: np.ndarray, scale: float, boost: Boost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature (by its place), bin and side of nulls of each node's best split; of equals the first feature, bin, right."""
    sides = 2 if h[:, :, -1].any() else 1  # without nulls both sides are alike
    side = np.arange(float(sides))
    gl, hl = np.cumsum(g[:, :, :-1], 2)[..., None], np.cumsum(h[:, :, :-1], 2)[..., None]
    if sides == 2:
        gl, hl = gl + g[:, :, -1:, None] * side, hl + h[:, :, -1:, None] * side
    gl /= scale
    hl /= scale
    total_g, total_h = all_g[:, None, None, None], all_h[:, None, None, None]
    gr, hr = total_g - gl, total_h - hl
    bad = (hl < boost.least) | (hr < boost.least) | (h[:, :, :-1, None] == 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        for x, y in ((gl, hl), (gr, hr)):  # in place: x * x / (y + ridge)
            x *= x
            y += boost.ridge
            x /= y
        gl += gr
        gl -= total_g * total_g / (total_h + boost.ridge)
    gl[bad] = -np.inf
    flat = gl.reshape(len(g), -1)
    at = flat.argmax(1)
    return flat[np.arange(len(g)), at], at // (sides * (g.shape[2] - 1)), at // sides % (g.shape[2] - 1), at % sides == 1


def _statistics(rows: DataFrame, names: list[str], by: tuple[str, ...], kind: str, boost: Boost) -> DataFrame:
    """``by, n, base, scale, weight, edges``: one aggregation over the rows."""
    cuts = F.array(*[F.lit(i / boost.bins) for i in range(1, boost.bins)])
    edges = F.array(*[F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(c, cuts, F.lit(10_000)))), F.array().cast("array<double>")) for c in names])
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.min("_y").alias("low"), F.max("_y").alias("high"), edges.alias("edges"))
    if kind == "classifier":
        weight = F.when(F.col("mean") > 0, (1 - F.col("mean")) / F.col("mean")).otherwise(F.lit(1.0))
        out = out.withColumns({"weight": weight, "base": F.lit(0.0), "reach": F.greatest(weight, F.lit(1.0))})
    else:
        out = out.withColumns({"weight": F.lit(1.0), "base": F.col("mean"), "reach": F.greatest(4 * (F.col("high") - F.col("low")), F.lit(1.0))})
    bits = 51 - F.ceil(F.log2(F.col("n").cast("double"))) - F.ceil(F.log2("reach"))
    return out.withColumn("scale", F.pow(F.lit(2.0), F.least(bits, F.lit(40)).cast("double"))).select(*by, "n", "base", "scale", "weight", "edges")


def _grown_in_tasks(rows: DataFrame, stats: DataFrame, names: list[str], by: tuple[str, ...], kind: str, boost: Boost) -> DataFrame:
    def task(key, own: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        s = about.iloc[0]
        edges = [np.asarray(e, np.float64) for e in s["edges"]]
        x = own[names].to_numpy(np.float64)
        binned = np.empty(x.shape, np.uint8 if boost.bins < 255 else np.int32)
        for i, e in enumerate(edges):
            binned[:, i] = np.where(np.isnan(x[:, i]), boost.bins, np.searchsorted(e, x[:, i], "left"))
        trees = grow(binned, own["_y"].to_numpy(np.float64), own["_id"].to_numpy(np.int64), edges, s["base"], s["scale"], s["weight"], kind, boost)
        return pd.DataFrame([[*key, s["base"], [{k: v.tolist() for k, v in t.items()} for t in trees]]])

    schema = ", ".join(f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}" for c in by) + f", base double, trees array<{TREE}>"
    return rows.groupBy(*by).cogroup(stats.groupBy(*by)).applyInPandas(task, schema)


def _grown_by_level(rows: DataFrame, stats: DataFrame, names: list[str], by: tuple[str, ...], kind: str, boost: Boost) -> DataFrame:
    """The same for models of any size: histograms are Spark aggregations, splits a window over their bins."""
    bins = F.array(*[_bin(c, i, boost) for i, c in enumerate(names)])
    state = rows.join(stats, [*by]).select(*by, "_id", "_y", bins.alias("bins"), "scale", "weight", F.col("base").alias("margin"))
    state, trees = settled(state, "boost-rows"), None
    for t in range(boost.trees):
        own = boost.features(t, len(names))
        if kind == "classifier":
            p = 1 / (1 + F.exp(-F.col("margin")))
            w = F.when(F.col("_y") == 1, F.col("weight")).otherwise(F.lit(1.0))
            g, h = w * (p - F.col("_y")), w * p * (1 - p)
        else:
            g, h = F.col("margin") - F.col("_y"), F.lit(1.0)
        use = F.shiftrightunsigned(F.xxhash64("_id", F.lit(boost.draw(t)).cast("long")), 11).cast("double") < boost.rows * 2.0**53
        at = state.withColumns({"g": F.rint(g * F.col("scale")), "h": F.greatest(F.rint(h * F.col("scale")), F.lit(1.0)), "use": use, "node": F.lit(0), "leaf": F.lit(0.0), "live": F.lit(True)})
        for level in range(boost.depth + 1):
            found = settled(_level(at.filter("use and live"), own, by, boost, level == boost.depth), "boost-nodes").withColumn("tree", F.lit(t))
            trees = found if trees is None else trees.unionByName(found)
            value = F.get("bins", F.col("feature"))
            left = F.when(value == boost.bins, F.col("nulls_left")).otherwise(value <= F.col("bin"))
            step = found.select(*by, "node", "feature", "bin", "nulls_left", "value")
            at = at.join(step, [*by, "node"], "left").select(
                *by, "_id", "_y", "bins", "scale", "weight", "margin", "g", "h", "use",
                F.when(F.col("live") & (F.col("feature") >= 0), 2 * F.col("node") + F.when(left, 1).otherwise(2)).otherwise(F.col("node")).alias("node"),
                F.when(F.col("live"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("leaf")).alias("leaf"), (F.col("live") & F.coalesce(F.col("feature") >= 0, F.lit(False))).alias("live"),
            )
        # a live node that no drawn row reached has value 0, as in a task
        state = settled(at.select(*by, "_id", "_y", "bins", "scale", "weight", (F.col("margin") + F.col("leaf")).alias("margin")), "boost-rows")
    size = 2 ** (boost.depth + 1) - 1
    cut = trees.join(stats.select(*by, "edges"), [*by]).withColumn("threshold", F.coalesce(F.get(F.get("edges", F.col("feature")), F.col("bin")), F.lit(float("inf"))))
    node = F.struct("node", "feature", F.when(F.col("feature") >= 0, F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold"), "nulls_left", "gain", "value")
    one = cut.groupBy(*by, "tree").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").alias("k"), node.alias("v")))).alias("nodes"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    part = lambda c, none: F.transform(places, lambda i: F.coalesce(F.try_element_at("nodes", i)[c], F.lit(none))).alias(c)
    one = one.select(*by, "tree", F.struct(part("feature", -1), part("threshold", 0.0), part("nulls_left", False), part("gain", 0.0), part("value", 0.0)).alias("t"))
    grown = one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "t"))), lambda x: x["t"]).alias("trees"))
    return grown.join(stats.select(*by, "base"), [*by]).select(*by, "base", F.col("trees").cast(f"array<{TREE}>").alias("trees"))


def _bin(name: str, i: int, boost: Boost) -> Column:
    x = F.col(name)
    return F.when(x.isNull(), F.lit(boost.bins)).otherwise(F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e < x))).cast("int")


def _level(rows: DataFrame, own: list[int], by: tuple[str, ...], boost: Boost, last: bool) -> DataFrame:
    """A row for each node of a level: its best split (feature -1: none), gain and leaf value."""
    total = rows.groupBy(*by, "node").agg(F.sum("g").alias("all_g"), F.sum("h").alias("all_h"), F.first("scale").alias("scale"))
    total = total.withColumns({c: F.col(c) / F.col("scale") for c in ("all_g", "all_h")}).withColumn("value", -F.col("all_g") / (F.col("all_h") + boost.ridge) * boost.rate)
    nothing = {"feature": F.lit(-1), "bin": F.lit(0), "nulls_left": F.lit(False), "gain": F.lit(0.0)}
    if last:
        return total.withColumns(nothing).select(*by, "node", "feature", "bin", "nulls_left", "gain", "value")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get("bins", F.lit(f)).alias("bin")) for f in own])).alias("c")
    cells = rows.select(*by, "node", "g", "h", cells).groupBy(*by, "node", "c.feature", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    feature = Window.partitionBy(*by, "node", "feature")
    null, so_far = F.col("bin") == boost.bins, feature.orderBy("bin")  # nulls are the last bin
    nulls = [F.coalesce(F.sum(F.when(null, F.col(c))).over(feature), F.lit(0.0)) for c in "gh"]
    cells = cells.withColumns({"gl": F.sum("g").over(so_far), "hl": F.sum("h").over(so_far), "gn": nulls[0], "hn": nulls[1]}).filter(~null)
    cells = cells.withColumn("nulls_left", F.explode(F.array(F.lit(False), F.lit(True)))).join(total, [*by, "node"])
    add = F.when(F.col("nulls_left"), F.lit(1.0)).otherwise(F.lit(0.0))
    cells = cells.withColumns({"gl": (F.col("gl") + F.col("gn") * add) / F.col("scale"), "hl": (F.col("hl") + F.col("hn") * add) / F.col("scale")})
    gl, hl, g, h = F.col("gl"), F.col("hl"), F.col("all_g"), F.col("all_h")
    gr, hr = g - gl, h - hl
    gain = gl * gl / (hl + boost.ridge) + gr * gr / (hr + boost.ridge) - g * g / (h + boost.ridge)
    cells = cells.filter((hl >= boost.least) & (hr >= boost.least)).withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
    best = cells.groupBy(*by, "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "nulls_left")).alias("b"))
    out = total.join(best, [*by, "node"], "left")
    chosen = {"feature": F.coalesce("b.feature", F.lit(-1)), "bin": F.coalesce("b.bin", F.lit(0)), "nulls_left": F.coalesce("b.nulls_left", F.lit(False)), "gain": F.coalesce(-F.col("b.loss"), F.lit(0.0))}
    return out.withColumns(chosen).select(*by, "node", "feature", "bin", "nulls_left", "gain", "value")


def _prepared(df: DataFrame, names: list[str], by: tuple[str, ...], label: str | None) -> DataFrame:
    values = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names]
    own = [c for c in KEYS if c in df.columns]
    goal = [F.col(label).cast("double").alias("_y")] if label else []
    return df.select(*by, F.xxhash64(*own).alias("_id"), *goal, *values)


def fit(df: DataFrame, names: list[str], by: tuple[str, ...] = ("symbol",), kind: str = "classifier", boost: Boost = Boost(), label: str = "target", task_rows: int = 100_000) -> DataFrame:
    """``by, base, trees``: a model for each combination of the ``by`` columns, all grown together.

    Rows without label or key are left out; features may be null. A classifier's labels are 0 and 1, its base the even odds, and
    rows of class 1 weigh negatives / positives; a regressor's base is the mean. Tables without rows give no models.
    """
    rows = _prepared(df.filter(F.col(label).isNotNull()), names, by, label).na.drop("any", subset=[*by])
    rows = settled(rows, "boost-input")
    stats = settled(_statistics(rows, names, by, kind, boost), "boost-statistics")
    small, large = stats.filter(F.col("n") <= task_rows), stats.filter(F.col("n") > task_rows)
    out = _grown_in_tasks(rows.join(small.select(*by), [*by], "left_semi"), small, names, by, kind, boost)
    if not large.isEmpty():
        # each has more than task_rows rows, so there are few of them for the rows
        out = out.unionByName(_grown_by_level(rows, large, names, by, kind, boost))
    return settled(out, "boost-models")


def _margins(trees, base: float, x: np.ndarray, staged: bool = False) -> np.ndarray:
    """Sums of the trees' values; ``staged``: after each tree, rows x trees."""
    out, steps, rows = np.full(len(x), base), [], np.arange(len(x))
    for t in trees:
        feature, threshold, nulls, value = (np.asarray(t[k]) for k in ("feature", "threshold", "nulls_left", "value"))
        node = np.zeros(len(x), np.int64)
        for _ in range(len(feature).bit_length() - 1):
            f = feature[node]
            own = x[rows, np.maximum(f, 0)]
            left = np.where(np.isnan(own), nulls[node], own <= threshold[node])
            node = np.where(f >= 0, 2 * node + np.where(left, 1, 2), node)
        out = out + value[node]
        steps.append(out)
    return np.stack(steps, 1) if staged else out


def _with_models(df: DataFrame, models: DataFrame, by: tuple[str, ...], share: int) -> tuple[DataFrame, DataFrame]:
    """Rows and models by shares of at most some ``share`` rows of a model each."""
    counts = settled(df.groupBy(*by).agg(F.ceil(F.count("*") / share).alias("_shares")), "boost-shares")
    own = [c for c in KEYS if c in df.columns]
    rows = df.join(counts, [*by]).withColumn("_share", F.pmod(F.xxhash64(*own, F.lit(5)), F.col("_shares"))).drop("_shares")
    copies = models.join(counts, [*by]).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    return rows, copies


def predict(df: DataFrame, models: DataFrame, names: list[str], by: tuple[str, ...] = ("symbol",), kind: str = "classifier", keep: tuple[str, ...] = KEYS, share: int = 100_000) -> DataFrame:
    """``keep`` and ``by`` with ``score``: a classifier's probability of class 1, a regressor's value, by the model of the row's
    keys; rows without a model are left out."""
    kept = [*dict.fromkeys([*by, *keep])]
    rows = df.select(*kept, *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, c in enumerate(names)])
    rows, copies = _with_models(rows, models, by, share)
    width = len(names)

    def task(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if own.empty or model.empty:
            return own[kept].head(0).assign(score=[])
        m = _margins(model["trees"].iloc[0], model["base"].iloc[0], own[[f"_f{i}" for i in range(width)]].to_numpy(np.float64))
        return own[kept].assign(score=1 / (1 + np.exp(-m)) if kind == "classifier" else m)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
    return rows.groupBy(*by, "_share").cogroup(copies.groupBy(*by, "_share")).applyInPandas(task, schema)


def stopped_early(models: DataFrame, held_back: DataFrame, names: list[str], by: tuple[str, ...] = ("symbol",), kind: str = "classifier", patience: int = 10, label: str = "target", share: int = 100_000) -> DataFrame:
    """Models cut to their best number of trees: loss on ``held_back`` is looked at tree by tree until it hasn't
    improved for ``patience`` trees. The trees before don't depend on where one stops, so they are grown first."""
    rows, copies = _with_models(_prepared(held_back.filter(F.col(label).isNotNull()), names, by, label).withColumnRenamed("_id", "date"), models, by, share)

    def task(key, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if own.empty or model.empty:
            return pd.DataFrame([], columns=[*by, "step", "loss", "n"])
        y = own["_y"].to_numpy(np.float64)[:, None]
        m = _margins(model["trees"].iloc[0], model["base"].iloc[0], own[names].to_numpy(np.float64), staged=True)
        loss = (np.logaddexp(0, m) - y * m if kind == "classifier" else (m - y) ** 2).sum(0)
        return pd.DataFrame([[*key[:-1], i + 1, float(x), len(y)] for i, x in enumerate(loss)], columns=[*by, "step", "loss", "n"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", step int, loss double, n long"
    sums = rows.groupBy(*by, "_share").cogroup(copies.groupBy(*by, "_share")).applyInPandas(task, schema).groupBy(*by, "step").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    curve = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "loss"))), lambda x: x["loss"]).alias("curve"))
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("best"), F.lit(float("inf")).alias("loss"))

    def look(s, x):
        over = s["i"] - s["best"] >= patience
        better = ~over & (x < s["loss"])
        return F.struct((s["i"] + (~over).cast("int")).alias("i"), F.when(better, s["i"] + 1).otherwise(s["best"]).alias("best"), F.when(better, x).otherwise(s["loss"]).alias("loss"))

    best = curve.select(*by, F.aggregate("curve", begin, look)["best"].alias("_best"))
    out = models.join(best, [*by], "left")
    return out.withColumn("trees", F.when(F.col("_best").isNull(), F.col("trees")).otherwise(F.slice("trees", 1, F.greatest(F.col("_best"), F.lit(1))))).drop("_best")


def importance(models: DataFrame, names: list[str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``by, feature, importance, importance_pct``: the gain of each feature's splits, and its share of the model's in percent."""
    node = models.select(*by, F.explode("trees").alias("t")).select(*by, F.explode(F.arrays_zip("t.feature", "t.gain")).alias("x")).select(*by, "x.*").filter("feature >= 0")
    out = node.groupBy(*by, "feature").agg(F.sum("gain").alias("importance"))
    named = F.get(F.array(*[F.lit(c) for c in names]), F.col("feature"))
    return out.select(*by, named.alias("feature"), "importance", (100 * F.col("importance") / F.sum("importance").over(Window.partitionBy(*by))).alias("importance_pct"))
