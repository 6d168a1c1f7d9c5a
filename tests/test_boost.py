"""Boosted trees of many models at once: against a plain booster, by task and by level."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boost
from quantloom.operators.boost import Boost

NAMES = ["a", "b", "c", "d"]


def plain_trees(rows, kind, b):
    """One model, node by node over plain lists. rows: (id, y, features with None)."""
    edges = [sorted({x[2][f] for x in rows if x[2][f] is not None}) for f in range(len(NAMES))]
    edges = [[v for i, v in enumerate(e) if i < len(e) - 1 or len(e) == 1] for e in edges]
    ys = [y for _, y, _ in rows]
    pos = sum(ys)
    weight = ((len(ys) - pos) / pos if pos else 1.0) if kind == "classifier" else 1.0
    margin = [0.0 if kind == "classifier" else sum(ys) / len(ys)] * len(rows)
    out = []
    for t in range(b.trees):
        grad = []
        for (_, y, _), m in zip(rows, margin, strict=True):
            if kind == "classifier":
                p, w = 1 / (1 + math.exp(-m)), weight if y == 1 else 1.0
                grad.append((w * (p - y), w * p * (1 - p)))
            else:
                grad.append((m - y, 1.0))
        use = boost.drawn(np.array([i for i, _, _ in rows]), t, b)
        tree = {}

        def split(node, own, level, grad=grad, use=use, tree=tree, t=t):
            live = [i for i in own if use[i]]
            if not live:
                return
            g, h = sum(grad[i][0] for i in live), sum(grad[i][1] for i in live)
            tree[node] = {"feature": -1, "value": -g / (h + b.ridge) * b.rate}
            best = None
            for f in b.features(t, len(NAMES)) if level < b.depth else []:
                cuts = [*edges[f], math.inf]
                for k, cut in enumerate(cuts):
                    if not any(rows[i][2][f] is not None and (k == 0 or rows[i][2][f] > cuts[k - 1]) and rows[i][2][f] <= cut for i in live):
                        continue
                    for nulls in (False, True):
                        left = [i for i in live if (nulls if rows[i][2][f] is None else rows[i][2][f] <= cut)]
                        gl, hl = sum(grad[i][0] for i in left), sum(grad[i][1] for i in left)
                        if hl < b.least or h - hl < b.least:
                            continue
                        gain = gl * gl / (hl + b.ridge) + (g - gl) ** 2 / (h - hl + b.ridge) - g * g / (h + b.ridge)
                        if gain > boost.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, cut, nulls)
            if best:
                tree[node].update(feature=best[1], threshold=best[2], nulls=best[3], gain=best[0])
                goes = lambda i: best[3] if rows[i][2][best[1]] is None else rows[i][2][best[1]] <= best[2]
                split(2 * node + 1, [i for i in own if goes(i)], level + 1)
                split(2 * node + 2, [i for i in own if not goes(i)], level + 1)

        split(0, range(len(rows)), 0)
        for i, (_, _, x) in enumerate(rows):
            node = 0
            while tree.get(node, {}).get("feature", -1) >= 0:
                n = tree[node]
                node = 2 * node + (1 if (n["nulls"] if x[n["feature"]] is None else x[n["feature"]] <= n["threshold"]) else 2)
            margin[i] += tree.get(node, {"value": 0.0})["value"]
        out.append(tree)
    return out, margin


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    rows = []
    for s in "xyz":
        for i in range({"x": 60, "y": 130, "z": 40}[s]):
            v = [float(k) if r.random() > 0.15 else None for k in r.integers(0, 30, 4)]
            up = int((v[0] or 40) + r.normal() * 6 > 18)
            rows.append((s, i, up, float((v[1] or 0) / 10 + up + r.normal() * 0.1), *v))
    rows.append(("x", 900, None, None, 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "symbol string, date int, up int, ret double, a double, b double, c double, d double").repartition(5).cache()


SMALL = Boost(trees=4, depth=3, bins=64, least=0.5)


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
@pytest.mark.parametrize("task_rows", [1000, 50])
def test_trees_equal_a_plain_booster(table, kind, task_rows):
    label = "up" if kind == "classifier" else "ret"
    models = {m.symbol: m for m in boost.fit(table, NAMES, kind=kind, boost=SMALL, label=label, task_rows=task_rows).collect()}
    ids = table.select("symbol", "date", F.xxhash64("symbol", "date").alias("id"), label, *NAMES).filter(f"{label} is not null").collect()
    scores = {(r.symbol, r.date): r.score for r in boost.predict(table, table.sparkSession.createDataFrame(list(models.values())), NAMES, kind=kind).collect()} if task_rows == 1000 else {}
    for s in "xyz":
        rows = [(r.id, float(r[label]), [r[c] for c in NAMES]) for r in ids if r.symbol == s]
        trees, margin = plain_trees(rows, kind, SMALL)
        assert len(models[s].trees) == len(trees)
        for got, want in zip(models[s].trees, trees, strict=True):
            for node, n in want.items():
                assert got.feature[node] == n["feature"] and got.value[node] == pytest.approx(n["value"], abs=1e-6)
                if n["feature"] >= 0:
                    top = max(x[2][n["feature"]] for x in rows if x[2][n["feature"]] is not None)  # a cut at the top is none
                    assert (min(got.threshold[node], top), got.nulls_left[node]) == (min(n["threshold"], top), n["nulls"])
                    assert got.gain[node] == pytest.approx(n["gain"], rel=1e-5)
        if scores:
            want = [1 / (1 + math.exp(-m)) if kind == "classifier" else m for m in margin]
            assert [scores[s, r.date] for r in ids if r.symbol == s] == pytest.approx(want, abs=1e-6)


def test_models_learn_and_odd_tables(table, spark):
    models = boost.fit(table, NAMES, boost=Boost(trees=30, depth=3), label="up")
    scored = boost.predict(table, models, NAMES, keep=("date", "up"), share=40).filter("up is not null")
    assert scored.filter("(score > 0.5) = (up = 1)").count() / scored.count() > 0.9
    top = boost.importance(models, NAMES).filter("feature = 'a'").collect()
    assert len(top) == 3 and all(r.importance_pct > 30 for r in top)
    none = table.limit(0)
    assert boost.fit(none, NAMES, label="up").count() == 0 and boost.predict(none, models, NAMES).count() == 0
    one = spark.createDataFrame([("q", 1, 1, None, None, None, None), ("q", 2, 1, None, None, None, None)], "symbol string, date int, up int, a double, b double, c double, d double")
    (r,) = boost.predict(one.limit(1), boost.fit(one, NAMES, boost=SMALL, label="up"), NAMES).collect()
    assert 0.0 < r.score < 1.0


def test_early_stopping_cuts_at_the_best_tree(table):
    train, held = table.filter("date % 3 > 0"), table.filter("date % 3 = 0")
    models = boost.fit(train, NAMES, boost=Boost(trees=25, depth=4, rate=0.5), label="up")
    cut = {r.symbol: r.trees for r in boost.stopped_early(models, held, NAMES, label="up", patience=3, share=15).collect()}
    rows = [r for r in held.collect() if r.up is not None]
    for m in models.collect():
        own = [r for r in rows if r.symbol == m.symbol]
        x = np.array([[math.nan if r[c] is None else r[c] for c in NAMES] for r in own])
        y = np.array([r.up for r in own])[:, None]
        margins = boost._margins(m.trees, m.base, x, staged=True)
        loss = (np.log1p(np.exp(margins)) - y * margins).mean(0)
        best = 0
        for i in range(1, len(loss)):
            if i - best > 3 - 1 + (i - best > 3):
                break
            if loss[i] < loss[best]:
                best = i
        assert len(cut[m.symbol]) == best + 1
