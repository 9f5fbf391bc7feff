"""Probability calibration: Platt sigmoids and isotonic curves, per class and fold; calibration curves.

Scores are (doc, label, score) with the true class in ``truth``; every class is calibrated one
against the rest, folds are averaged, and probabilities of a text are normalised.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetorica.operators.evaluate import best_label
from rhetorica.sources.tables import stored


def platt_by(df: DataFrame, keys: list[str], score: str = "score", hit: str = "hit", weight: str | None = None, rounds: int = 60) -> dict[tuple, tuple[float, float]]:
    """(a, b) of ``1 / (1 + exp(a * score + b))`` for each value of ``keys``, by maximum likelihood
    with softened targets.

    All curves are fitted together by damped Newton steps, each of which is one aggregation over the
    rows; the driver holds two numbers for each curve. A key without a hit or without a miss is fitted too.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(score).cast("double").alias("s"), F.col(hit).cast("boolean").alias("y"), w.alias("w"))
    names = [f"_k{i}" for i in range(len(keys))]
    pos = F.sum(F.col("y").cast("int"))
    size = rows.groupBy(*names).agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"), F.avg("s").alias("mean"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std")).collect()
    fixed = {tuple(r[n] for n in names): ((r.pos + 1.0) / (r.pos + 2.0), 1.0 / (r.neg + 2.0), r.mean, r.std or 1.0) for r in size}
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{c} double" for c in ("hi", "lo", "mean", "std", "a", "b")])
    now = {k: (0.0, math.log(1 / f[0] - 1)) for k, f in fixed.items()}
    best: dict[tuple, tuple] = {}
    damp = dict.fromkeys(fixed, 1e-3)
    open_keys = set(fixed)
    for _ in range(rounds):
        if not open_keys:
            break
        asked = df.sparkSession.createDataFrame([(*k, *fixed[k], *now[k]) for k in open_keys], schema)
        on = None
        for n in names:
            same = F.col(f"r.{n}").eqNullSafe(F.col(f"q.{n}"))
            on = same if on is None else on & same
        joined = rows.alias("r").join(F.broadcast(asked).alias("q"), on) if names else rows.crossJoin(F.broadcast(asked))  # a row for each curve
        x = (F.col("s") - F.col("mean")) / F.col("std")
        z = F.col("a") * x + F.col("b")
        target = F.when(F.col("y"), F.col("hi")).otherwise(F.col("lo"))
        p = 1 / (1 + F.exp(z))
        d, h = F.col("w") * (target - p), F.col("w") * p * (1 - p)
        soft = F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))  # -log p
        loss = F.col("w") * (soft - (1 - target) * z)
        got = joined.groupBy(*[F.col(f"r.{n}") for n in names]).agg(*[F.sum(c).alias(n) for n, c in (("l", loss), ("ga", d * x), ("gb", d), ("haa", h * x * x), ("hab", h * x), ("hbb", h), ("n", F.col("w")))]).collect()
        for r in got:
            k = tuple(r[n] for n in names)
            if k not in best or r.l < best[k][0]:
                gain = best[k][0] - r.l if k in best else math.inf
                best[k] = (r.l, now[k], r)
                damp[k] /= 10
                if max(abs(r.ga), abs(r.gb)) <= 1e-9 * r.n or gain <= 1e-13 * abs(r.l):
                    open_keys.discard(k)
                    continue
            else:
                damp[k] *= 20
                if damp[k] > 1e6:
                    open_keys.discard(k)
                    continue
            _, (a, b), r = best[k]
            more = damp[k] * (r.haa + r.hbb) + 1e-12
            haa, hbb = r.haa + more, r.hbb + more
            det = haa * hbb - r.hab**2
            now[k] = (a - (r.ga * hbb - r.gb * r.hab) / det, b - (r.gb * haa - r.ga * r.hab) / det)
    out = {}
    for k, (_, (a, b), _) in best.items():
        mean, std = fixed[k][2:]
        out[k] = (a / std, b - a * mean / std)
    return out


def platt(df: DataFrame, score: str = "score", hit: str = "hit", weight: str | None = None) -> tuple[float, float]:
    """(a, b) of one curve over all rows."""
    got = platt_by(df.withColumn("_all", F.lit(0)), ["_all"], score, hit, weight)
    if not got:
        raise ValueError("nothing to calibrate on")
    return got[(0,)]


def isotonic(df: DataFrame, score: str = "score", hit: str = "hit", weight: str | None = None) -> tuple[list[float], list[float]]:
    """(boundaries, values) of a rising step curve, linear between boundaries and flat outside."""
    rows = df.select(F.col(score).cast("double").alias("features"), F.col(hit).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    m = IsotonicRegression(featuresCol="features", weightCol="w").fit(rows)
    return m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()


@dataclass
class Calibrator:
    """Curves per fold and class, fitted by ``fit``."""

    method: str = "sigmoid"

    def fit(self, df: DataFrame, folds: str | None = None) -> Calibrator:
        """df: (doc, label, score, truth) and a fold column, if the scores come from held-out folds.

        Sigmoids of all folds and classes are fitted together; isotonic curves one by one, each
        distributed. A class that is missing from a fold raises ValueError.
        """
        if self.method not in ("sigmoid", "isotonic"):
            raise ValueError("method: sigmoid or isotonic")
        df = df.withColumn("hit", F.col("truth") == F.col("label"))
        fold_of = [r[0] for r in df.select(folds).distinct().orderBy(folds).collect()] if folds else [None]
        labels = [r[0] for r in df.select("label").distinct().orderBy("label").collect()]
        self.curves_ = []
        df = df.withColumn("_fold", F.col(folds) if folds else F.lit(None).cast("int"))
        held = {(r._fold, r.label) for r in df.where("hit").select("_fold", "label").distinct().collect()}
        for f in fold_of:
            for label in labels:
                if (f, label) not in held:
                    raise ValueError(f"class {label!r} is missing from fold {f!r}")
        if self.method == "sigmoid":
            self.curves_ = [(f, label, ab) for (f, label), ab in sorted(platt_by(df, ["_fold", "label"]).items(), key=lambda x: (str(x[0][0]), str(x[0][1])))]
            return self
        for f in fold_of:
            part = df if f is None else df.where(F.col("_fold") == f)
            self.curves_ += [(f, label, isotonic(part.where(F.col("label") == label))) for label in labels]
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(doc, label, p) from (doc, label, score): the folds' mean, normalised within each text."""
        labels = sorted({c[1] for c in self.curves_})
        w = Window.partitionBy("doc")
        total, k = F.sum("raw").over(w), F.count(F.lit(1)).over(w)
        if self.method == "isotonic":
            # one row per class, with the boundaries and values of each fold as arrays
            rows = [(label, [c[2] for c in self.curves_ if c[1] == label]) for label in labels]
            kind = dict(df.dtypes)["label"]
            curves = df.sparkSession.createDataFrame(rows, f"label {kind}, curves array<struct<xs: array<double>, ys: array<double>>>")
            mean = F.aggregate("curves", F.lit(0.0), lambda t, c: t + _on_curve(F.col("score"), c["xs"], c["ys"])) / F.size("curves")
            out = df.join(F.broadcast(curves), "label", "left").withColumn("raw", mean)
        else:
            p = None
            for label in labels:
                own = [c[2] for c in self.curves_ if c[1] == label]
                mean = sum((1 / (1 + F.exp(a * F.col("score") + b)) for a, b in own), F.lit(0.0)) / len(own)
                p = F.when(F.col("label") == label, mean) if p is None else p.when(F.col("label") == label, mean)
            out = df.withColumn("raw", p)
        return out.select("doc", "label", F.least(F.when(total > 0, F.col("raw") / total).otherwise(1 / k), F.lit(1.0)).alias("p"))


@dataclass
class CrossCalibrated:
    """A classifier whose probabilities are calibrated on rows that it wasn't fitted on: for each
    fold the base model is fitted on the other folds and a calibrator on the fold's own scores;
    probabilities of new texts are the mean over folds.

    fit_base: rows -> model; score: (model, rows) -> (doc, label, score).
    """

    fit_base: Callable
    score: Callable
    method: str = "sigmoid"

    def fit(self, df: DataFrame, folds: str = "fold") -> CrossCalibrated:
        """df: (doc, truth, fold) and what the base model needs."""
        self.parts_ = []
        for f in sorted(r[0] for r in df.select(folds).distinct().collect()):
            base = self.fit_base(df.where(F.col(folds) != f))
            own = df.where(F.col(folds) == f)
            held = stored(self.score(base, own).join(own.select("doc", "truth"), "doc"), "held-out")
            self.parts_.append((base, Calibrator(self.method).fit(held)))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(doc, label, p), which add up to 1 for each text."""
        every = None
        for base, curves in self.parts_:
            part = curves.predict_proba(self.score(base, df))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("doc", "label").agg((F.sum("p") / len(self.parts_)).alias("p"))

    def predict(self, df: DataFrame) -> DataFrame:
        """(doc, label): the most probable class, ties to the one that sorts first."""
        return best_label(self.predict_proba(df), "p")


def _on_curve(s: Column, xs: Column, ys: Column) -> Column:
    """The value at ``s`` of a curve that is linear between boundaries and flat outside."""
    at = F.size(F.filter(xs, lambda x: x < s))  # boundaries below s
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(at == 0, F.get(ys, F.lit(0))).when(at == F.size(xs), y0).otherwise(y0 + (s - x0) * ((y1 - y0) / (x1 - x0)))


def calibration_curve(df: DataFrame, truth: str, prob: str, bins: int = 5, normalize: bool = False) -> DataFrame:
    """(bin, n, share, mean_prob) of the bins that aren't empty. Probabilities outside [0, 1] raise an
    error unless ``normalize`` scales them to their range."""
    p = F.col(prob).cast("double")
    if normalize:
        ends = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
        df = df.crossJoin(F.broadcast(ends))  # one row
        p = F.when(F.col("hi") > F.col("lo"), (p - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    else:
        p = F.when((p < 0) | (p > 1), F.raise_error(F.lit("probabilities must be within [0, 1]")).cast("double")).otherwise(p)
    rows = df.select(p.alias("p"), F.col(truth).cast("double").alias("y")).withColumn("bin", F.floor(F.col("p") * bins / (1 + 1e-8)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), F.avg("p").alias("mean_prob"))
