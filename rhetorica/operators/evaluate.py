"""Corpus statistics, bag-of-words models, folds and evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rhetorica.operators import ngrams
from rhetorica.sources.tables import sent_if_few, shuffled, stored


def length_stats(df: DataFrame, by: str, tokens: str = "tokens") -> DataFrame:
    """(by, n, mean, spread): number and mean length of sentences, spread is 1.96 standard deviations of the population."""
    size = F.size(tokens).cast("double")
    return df.where(F.col(tokens).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean"), (1.96 * F.stddev_pop(size)).alias("spread"))


def word_totals(df: DataFrame, by: str, tokens: str = "tokens") -> DataFrame:
    """(by, words, types)."""
    return df.select(by, F.explode_outer(tokens).alias("t")).where("t is not null").groupBy(by).agg(F.count("t").alias("words"), F.countDistinct("t").alias("types"))


def word_counts(df: DataFrame, by: str, tokens: str = "tokens", stop: DataFrame | None = None) -> DataFrame:
    """(by, token, n); ``stop`` is a table of tokens to leave out."""
    rows = df.select(by, F.explode_outer(tokens).alias("token")).where("token is not null")
    if stop is not None:
        rows = rows.join(stop.select("token"), "token", "left_anti")
    return rows.groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))


def vectorize(df: DataFrame, doc: str, tokens: str = "tokens", least: int = 1, most: int = 1, stop: Sequence[str] = ()) -> DataFrame:
    """(doc, gram, n): counts of word n-grams from ``least`` to ``most`` words, joined by spaces; stop words leave before."""
    t = F.filter(F.col(tokens), lambda x: ~x.isin(list(stop))) if stop else F.col(tokens)
    df = df.select(F.col(doc).alias("doc"), t.alias("_t"))
    rows = ngrams.grams(df, [F.col("doc")], F.col("_t"), list(range(least, most + 1)))
    gram = F.when(F.col("ord") == 1, F.col("tok")).otherwise(F.concat(F.translate("ctx", ngrams.SEP, " "), F.lit(" "), "tok"))
    return rows.select("doc", gram.alias("gram")).groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("n"))


def naive_bayes(bags: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes from (doc, gram, n) and (doc, label): the tables (label, gram, log_p)
    and (label, log_prior, log_unseen); natural logarithms."""
    per = stored(shuffled(bags).join(labels, "doc").groupBy("label", "gram").agg(F.sum("n").alias("n")), "label-grams")  # read by several branches
    size = per.select("gram").distinct().agg(F.count(F.lit(1)).alias("v"))
    totals = per.groupBy("label").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(size))  # size is one row
    grams = per.join(totals, "label").select("label", "gram", F.log((F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))).alias("log_p"))
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("docs")).withColumn("all", F.sum("docs").over(Window.partitionBy(F.lit(0))))
    classes = totals.join(n, "label").select("label", F.log(F.col("docs") / F.col("all")).alias("log_prior"), F.log(F.lit(alpha) / (F.col("total") + alpha * F.col("v"))).alias("log_unseen"))
    return stored(grams, "nb-grams"), stored(classes, "nb-classes")


def naive_bayes_scores(bags: DataFrame, grams: DataFrame, classes: DataFrame, empty: bool = True) -> DataFrame:
    """(doc, label, log_joint); grams that training never saw count for no class. Texts without any
    known gram get the priors, or are left out if not ``empty``.

    As with the language models, a sum of corrections over one join of grams that were seen. A row
    without a label stands for each known gram, so that the same join gives the number of them.
    """
    classes = sent_if_few(classes)
    delta = grams.join(classes, "label").select("label", "gram", (F.col("log_p") - F.col("log_unseen")).alias("d"))
    known = grams.select(F.lit(None).cast(dict(grams.dtypes)["label"]).alias("label"), "gram", F.lit(1.0).alias("d")).distinct()
    gained = stored(shuffled(bags).join(delta.unionByName(known), "gram").groupBy("doc", "label").agg(F.sum(F.col("n") * F.col("d")).alias("g")), "nb-gained")
    sizes = gained.where("label is null").select("doc", F.col("g").alias("k"))
    if empty:
        sizes = bags.select("doc").distinct().join(sizes, "doc", "left").select("doc", F.coalesce("k", F.lit(0.0)).alias("k"))
    return shuffled(sizes.crossJoin(classes)).join(gained.where("label is not null"), ["doc", "label"], "left").select(
        "doc", "label", (F.col("log_prior") + F.col("k") * F.col("log_unseen") + F.coalesce("g", F.lit(0.0))).alias("log_joint")
    )


def best_label(scores: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(doc, label) with the highest score, rounded to 9 places; ties go to the label that sorts first."""
    w = Window.partitionBy("doc").orderBy(F.desc(F.round(score, 9)), label)
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc", F.col(label).alias("label"))


def k_folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with a ``fold`` from 0 to k - 1 by a hash of the key: no shuffle, the same on every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """As ``k_folds``, dealing the rows of each label out evenly, in blocks of hash order.

    Rows are numbered within (label, part of the hash) so that a label with most rows is spread over
    many tasks; fold sizes of a label differ by at most the number of parts.
    """
    h = F.xxhash64(F.lit(seed), key)
    w = Window.partitionBy(label, "_part").orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("_part", F.pmod(F.shiftright("_h", 48), F.lit(64))).withColumn("fold", ((F.row_number().over(w) - 1 + F.col("_part")) % k).cast("int")).drop("_h", "_part")


def confusion(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(truth, guess, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def report(conf: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table; 0 where nothing can be divided."""
    label = conf.select(F.explode(F.array_distinct(F.array("truth", "guess"))).alias("label"), "truth", "guess", "n")
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    hit = s((F.col("truth") == F.col("label")) & (F.col("guess") == F.col("label")))
    per = label.where("label is not null").groupBy("label").agg(hit.alias("tp"), s(F.col("guess") == F.col("label")).alias("guessed"), s(F.col("truth") == F.col("label")).alias("support"))
    p = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return per.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def weighted_f1(rep: DataFrame) -> DataFrame:
    """(f1): mean of the classes' F1, weighted by support."""
    return rep.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def mean_and_spread(df: DataFrame, value: str) -> DataFrame:
    """(mean, spread) of fold scores; spread is 1.96 standard deviations of the population."""
    return df.agg(F.avg(value).alias("mean"), (1.96 * F.stddev_pop(value)).alias("spread"))


def soft_vote(parts: DataFrame) -> DataFrame:
    """(doc, label, p): mean of probabilities (doc, model, label, p, weight) over models, by weight."""
    return parts.groupBy("doc", "label").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def weight_grid(spark: SparkSession, steps: int = 10) -> DataFrame:
    """(w1, w2): all ordered pairs of two different weights from 1 to ``steps``."""
    a = spark.range(1, steps + 1)
    return a.select(F.col("id").alias("w1")).crossJoin(a.select(F.col("id").alias("w2"))).where("w1 <> w2")


def best_by(df: DataFrame, by: str, score: str) -> DataFrame:
    """(by, best): the best score of each group."""
    return df.groupBy(by).agg(F.max(score).alias("best"))
