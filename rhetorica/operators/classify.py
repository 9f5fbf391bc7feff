"""Classifiers on language-model scores: binary ratio, argmax over classes, posteriors, one against one.

Scores are (doc, model, grams, neg_log2) as made by ``lm.score``; priors are (model, n, prior,
log2_prior). Everything stays in log2 space, so long texts don't underflow. Ties go to the class
that sorts first.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetorica.operators import lm, util
from rhetorica.sources.tables import sent_if_few


def priors(df: DataFrame, label: str = "label") -> DataFrame:
    """(model, n, prior, log2_prior) of the classes; null labels are no class."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return n.select("model", "n", share.alias("prior"), F.log2(share).alias("log2_prior"))


def logsumexp2(values: Column, over) -> Column:
    """log2 of the sum of 2 ** values over a window, the largest value taken out first."""
    top = F.max(values).over(over)
    return top + F.log2(F.sum(F.pow(F.lit(2.0), values - top)).over(over))


def argmax(scores: DataFrame) -> DataFrame:
    """(doc, label): the class with the highest likelihood, priors ignored; no shuffle beyond one aggregation."""
    best = F.min(F.struct(F.round("neg_log2", 9).alias("s"), F.col("model")))
    return scores.groupBy("doc").agg(best.alias("b")).select("doc", F.col("b.model").alias("label"))


def log_proba(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """(doc, model, log2_joint): log2 of likelihood times prior, unnormalised."""
    return scores.join(sent_if_few(prior.select("model", "log2_prior")), "model").select("doc", "model", (F.col("log2_prior") - F.col("neg_log2")).alias("log2_joint"))


def joint_proba(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """(doc, model, joint): likelihood times prior, not normalised; underflows to 0 for long texts."""
    return log_proba(scores, prior).select("doc", "model", F.pow(F.lit(2.0), "log2_joint").alias("joint"))


def posterior(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """(doc, model, p): the normalised probability of each class.

    It replaces an average over pairs of classes, which isn't a probability.
    """
    w = Window.partitionBy("doc")
    lp = log_proba(scores, prior)
    return lp.select("doc", "model", F.pow(F.lit(2.0), F.col("log2_joint") - logsumexp2(F.col("log2_joint"), w)).alias("p"))


def ratio(scores: DataFrame, prior: DataFrame, first: str, second: str) -> DataFrame:
    """(doc, ratio, label): log2 of the joint probability of the first class over that of the second;
    above 0 means the first. At exactly 0 the class with the larger prior is taken, else the first."""
    lp = log_proba(scores.where(F.col("model").isin(first, second)), prior)
    side = F.when(F.col("model") == first, F.col("log2_joint")).otherwise(-F.col("log2_joint"))
    by = prior.agg(F.max(F.when(F.col("model") == first, F.col("n"))).alias("n1"), F.max(F.when(F.col("model") == second, F.col("n"))).alias("n2"))
    r = lp.groupBy("doc").agg(F.sum(side).alias("ratio")).crossJoin(F.broadcast(by))  # by is one row
    is_first = (F.col("ratio") > 0) | ((F.col("ratio") == 0) & (F.col("n1") >= F.col("n2")))
    return r.select("doc", "ratio", F.when(is_first, first).otherwise(second).alias("label"))


def one_vs_one(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """(doc, label, votes): the class that wins most pairs of classes, compared by joint probability.

    A class's wins in a text are the classes that score lower there, so a rank replaces the self-join
    of all pairs; equal scores go to the class that sorts first.
    """
    lp = log_proba(scores, prior)
    w = Window.partitionBy("doc").orderBy(F.asc(F.round("log2_joint", 9)), F.desc("model"))
    return lp.withColumn("votes", F.row_number().over(w) - 1).groupBy("doc").agg(F.max_by("model", "votes").alias("label"), F.max("votes").alias("votes"))


@dataclass
class NgramClassifier:
    """Class models of order n with Lidstone smoothing alpha, fitted on (label, tokens) rows.

    ``binary`` allows two classes at most. Tokens may be strings or integers. ``use_dictionary``
    numbers the tokens of the training texts first; both sides are mapped, and a token that
    training never saw gets a number that no n-gram has.
    """

    n: int = 4
    alpha: float = 0.01
    pad: bool = False
    binary: bool = False
    use_dictionary: bool = False

    def __post_init__(self) -> None:
        if self.n > 6:
            warnings.warn("orders above 6 need very much text", stacklevel=2)
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")

    def fit(self, df: DataFrame, label: str = "label", tokens: str = "tokens") -> NgramClassifier:
        self.prior_ = priors(df, label)
        if self.binary and len(self.prior_.take(3)) > 2:
            raise ValueError("a binary classifier takes two classes")
        if self.use_dictionary:
            self.vocabulary_ = util.vocabulary(df, tokens)
            df = util.encoded(df, tokens, self.vocabulary_)
        self.model_ = lm.train(df.where(F.col(label).isNotNull()), self.n, self.alpha, label, tokens, self.pad, self.pad)
        return self

    def scores(self, df: DataFrame, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
        if self.use_dictionary:
            df = util.encoded(df, tokens, self.vocabulary_)
        return lm.score(df, self.model_, doc, tokens, self.pad, self.pad)

    def predict(self, df: DataFrame, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
        """(doc, label). Binary models use the priors, others the likelihood alone."""
        scores = self.scores(df, doc, tokens)
        if not self.binary:
            return argmax(scores)
        names = sorted(r.model for r in self.prior_.select("model").take(2))
        if len(names) == 1:
            return scores.select("doc", F.lit(names[0]).alias("label"))
        return ratio(scores, self.prior_, *names).select("doc", "label")

    def predict_log_proba(self, df: DataFrame, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
        return log_proba(self.scores(df, doc, tokens), self.prior_)

    def predict_proba(self, df: DataFrame, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
        return joint_proba(self.scores(df, doc, tokens), self.prior_)


def classify_request(model: lm.Model, text: str, pipeline, spark) -> str | None:
    """The class that one text, as a request brings it, is most likely from; None if it is empty after cleaning.

    pipeline: a ``functions.text.Pipeline`` with a tokenizer. Priors are ignored.
    """
    df = pipeline.apply(spark.createDataFrame([(0, text)], "doc int, text string"), "text", "tokens")
    best = argmax(lm.score(df, model)).first()
    return best.label if best else None
