"""N-gram language models with Lidstone smoothing and backoff, one per key, as tables.

The probability of a word after a context is ``(c + gamma) / (N + gamma * B)`` where the n-gram was
seen, else the context's backoff weight times the probability after the shorter context; B is the
number of different words seen at the order. Unknown words have ``gamma / (N + gamma * B)``.

Orders are built one after another: the sums that a context needs come from an aggregation, which
is combined before the shuffle, and are joined back, so no task gets all followers of a frequent
word and AQE can split what is left of the skew. Joins go by two hashes (96 bits) instead of strings.

Scoring uses a table of corrections. Starting from the unknown-word score of a model, each seen
unigram, context and n-gram adds a fixed amount, so the score of a text is a sum over one equi-join
of its grams with the corrections, whatever the order, and texts are never crossed with n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rhetorica.operators import ngrams
from rhetorica.sources.tables import sent_if_few, shuffled, stored

TINY = 1e-300  # stands for a backoff weight of 0, so that logarithms stay finite
FULL = 1e-12
WIDE = 32  # models up to which scores have a column for each
TABLES = ("probs", "alphas", "bins", "base", "backed")


def shorter(ctx: Column) -> Column:
    """A context without its first token."""
    at = F.instr(ctx, ngrams.SEP)
    return F.when(at > 0, F.substr(ctx, at + 1)).otherwise(F.lit(""))


@dataclass
class Model:
    """probs (model, ord, ctx, tok, c, p), alphas (model, ord, ctx, alpha), bins (model, ord, b) and
    base (model, oov): the unknown-word probability; n is the highest order. backed holds, for each
    n-gram above order 1, its p, the p_low of the shorter one and the alpha of its context."""

    n: int
    gamma: float
    probs: DataFrame
    alphas: DataFrame
    bins: DataFrame
    base: DataFrame
    backed: DataFrame

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.probs.sparkSession
        spark.createDataFrame([(self.n, self.gamma)], "n int, gamma double").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        about = spark.read.parquet(f"{path}/about").first()
        return Model(about.n, about.gamma, *[spark.read.parquet(f"{path}/{t}") for t in TABLES])

    def contexts(self) -> DataFrame:
        """(model, ord, ctx) that were seen."""
        return self.probs.select("model", "ord", "ctx").distinct()

    def describe(self) -> DataFrame:
        """(model, n, grams): the number of different n-grams of the highest order."""
        return self.probs.where(F.col("ord") == self.n).groupBy("model").agg(F.lit(self.n).alias("n"), F.count(F.lit(1)).alias("grams"))


def hashed(*columns) -> list[Column]:
    """Two hashes of the columns that together stand for their values: 64 and 32 bits."""
    return [F.xxhash64(*columns), F.hash(*columns)]


def build(counts: DataFrame, n: int, gamma: float, keep: bool = True) -> Model:
    """A model per key from conditional counts of all orders; keep: write the probabilities to the
    shared folder, since several branches read them."""
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    kept = (lambda df, label: stored(df, label, free=True)) if keep else lambda df, _: df
    bins = kept(counts.select("model", "ord", "tok").distinct().groupBy("model", "ord").agg(F.count("tok").alias("b")), "lm-bins")
    tokens = counts.where("ord = 1").groupBy("model").agg(F.sum("c").alias("total"))
    base = tokens.join(bins.where("ord = 1").select("model", "b"), "model").select("model", (F.col("total") + gamma * F.col("b")).alias("den"))
    base = kept(base.select("model", "den", (gamma / F.col("den")).alias("oov")), "lm-base")
    p = ((F.col("c") + gamma) / F.col("den")).alias("p")
    none = F.lit(None).cast("double")
    first = counts.where("ord = 1").join(sent_if_few(base), "model").select("model", "ord", "ctx", "tok", "c", p, none.alias("p_low"), none.alias("alpha"))
    levels = [kept(first, "lm-1")]
    for k in range(2, n + 1):
        g1, g2 = hashed("model", "ctx", "tok")
        low = levels[-1].select(g1.alias("g1"), g2.alias("g2"), F.col("p").alias("p_low"))
        (g1, g2), (c1, c2) = hashed("model", shorter(F.col("ctx")), "tok"), hashed("model", "ctx")
        rows = counts.where(F.col("ord") == k).select("model", "ord", "ctx", "tok", "c", g1.alias("g1"), g2.alias("g2"), c1.alias("c1"), c2.alias("c2"))
        pairs = shuffled(rows).join(low, ["g1", "g2"], "left").drop("g1", "g2")
        # grams without a shorter one, which padding makes, count for the context's total only
        backs = F.col("p_low").isNotNull()
        sums = pairs.groupBy("c1", "c2", "model").agg(F.sum("c").alias("total"), F.sum(F.when(backs, F.col("c") + gamma)).alias("mass"), F.sum("p_low").alias("low"))
        sums = sums.join(sent_if_few(bins.where(F.col("ord") == k).select("model", "b")), "model").withColumn("den", F.col("total") + gamma * F.col("b"))
        over, under = 1 - F.col("mass") / F.col("den"), 1 - F.col("low")
        alpha = F.when(under <= FULL, F.lit(0.0)).otherwise(F.greatest(over, F.lit(0.0)) / under)
        level = shuffled(pairs).join(sums.select("c1", "c2", "den", alpha.alias("alpha")), ["c1", "c2"]).select("model", "ord", "ctx", "tok", "c", p, "p_low", F.when(backs, F.col("alpha")).alias("alpha"))
        levels.append(kept(level, f"lm-{k}"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    backed = every.where("p_low is not null").select("model", "ord", "ctx", "tok", "p", "p_low", "alpha")
    alphas = backed.groupBy("model", "ord", "ctx").agg(F.max("alpha").alias("alpha"))
    return Model(n, gamma, every.select("model", "ord", "ctx", "tok", "c", "p"), alphas, bins, base.select("model", "oov"), backed)


def train(df: DataFrame, n: int, gamma: float, model: str = "model", tokens: str = "tokens", pad_left: bool = False, pad_right: bool = False) -> Model:
    """One model for each value of the ``model`` column, in one build."""
    return build(stored(ngrams.conditional_counts(df, n, model, tokens, pad_left, pad_right), "lm-counts", free=True), n, gamma)


def corrections(m: Model) -> DataFrame:
    """(model, k1, k2, delta): what a seen unigram, context or n-gram adds to the log2 score."""
    log = lambda c: F.log2(F.greatest(c, F.lit(TINY)))
    named = lambda key: [key[0].alias("k1"), key[1].alias("k2")]
    grams = m.probs.where("ord = 1").select("model", "tok", F.log2("p").alias("lp"))
    unigrams = grams.join(sent_if_few(m.base), "model").select("model", *named(gram_key(1, F.lit(""), F.col("tok"))), (F.col("lp") - F.log2("oov")).alias("delta"))
    contexts = m.alphas.select("model", *named(context_key(F.col("ord"), F.col("ctx"))), log(F.col("alpha")).alias("delta"))
    longer = m.backed.select("model", *named(gram_key(F.col("ord"), F.col("ctx"), F.col("tok"))), (F.log2("p") - log(F.col("alpha")) - F.log2("p_low")).alias("delta"))
    return unigrams.unionByName(contexts).unionByName(longer)


def gram_key(order, ctx: Column, tok: Column) -> list[Column]:
    return hashed(F.lit("g"), F.lit(order).cast("int") if isinstance(order, int) else order.cast("int"), ctx, tok)


def context_key(order, ctx: Column) -> list[Column]:
    return hashed(F.lit("c"), F.lit(order).cast("int") if isinstance(order, int) else order.cast("int"), ctx)


def text_keys(df: DataFrame, n: int, doc: str, tokens: str, pad_left: bool = False, pad_right: bool = False) -> DataFrame:
    """(doc, k1, k2, times) of all corrections that a text's top-order windows may get."""
    t = F.col(tokens).cast("array<string>")
    t = ngrams.padded(t, n, pad_left, pad_right) if pad_left or pad_right else t
    top = ngrams.grams(df, [F.col(doc).alias("doc")], t, [n])
    tails: list[Column] = [F.col("ctx")]  # context of order n, n - 1, ... 1
    for _ in range(n - 1):
        tails.append(shorter(tails[-1]))
    keys = []
    for k, ctx in zip(range(n, 0, -1), tails):
        keys.append(gram_key(k, ctx if k > 1 else F.lit(""), F.col("tok")))
        if k > 1:
            keys.append(context_key(k, ctx))
    each = F.array(*[F.struct(k1.alias("k1"), k2.alias("k2")) for k1, k2 in keys])
    return top.select("doc", F.explode(each).alias("k")).groupBy("doc", "k.k1", "k.k2").agg(F.count(F.lit(1)).alias("times"))


def score(df: DataFrame, m: Model, doc: str = "doc", tokens: str = "tokens", pad_left: bool = False, pad_right: bool = False) -> DataFrame:
    """(doc, model, grams, neg_log2): the negative log2 probability of each text under each model.

    Texts with fewer tokens than the order have no grams and score 0, as do null and empty ones.
    """
    ngrams.check_tokens(df, tokens)
    t = F.col(tokens).cast("array<string>")
    size = F.size(ngrams.padded(t, m.n, pad_left, pad_right) if pad_left or pad_right else t)
    docs = df.select(F.col(doc).alias("doc"), F.greatest(F.coalesce(size, F.lit(0)) - (m.n - 1), F.lit(0)).alias("grams")).groupBy("doc").agg(F.sum("grams").alias("grams"))
    keys = text_keys(df, m.n, doc, tokens, pad_left, pad_right)
    few = m.base.select("model", "oov", F.xxhash64("model").alias("m")).take(WIDE + 1)
    if 0 < len(few) <= WIDE and all(isinstance(r.model, str | int) for r in few):
        return _score_few(docs, keys, m, few)
    named = F.xxhash64("model").alias("m")  # a number is summed up faster than a name
    gained = shuffled(keys).join(corrections(m).select("k1", "k2", named, "delta"), ["k1", "k2"]).groupBy("doc", "m").agg(F.sum(F.col("times") * F.col("delta")).alias("gained"))
    every = docs.crossJoin(sent_if_few(m.base.withColumn("m", named)))  # the result itself has a row for each text and model
    return shuffled(every).join(gained, ["doc", "m"], "left").select("doc", "model", "grams", (-(F.col("grams") * F.log2("oov") + F.coalesce("gained", F.lit(0.0)))).alias("neg_log2"))


def _score_few(docs: DataFrame, keys: DataFrame, m: Model, few: list) -> DataFrame:
    """As ``score``, with a column for each of a few models: a text's key is one row, not one for each model that saw it."""
    seen = corrections(m).select("k1", "k2", F.xxhash64("model").alias("m"), "delta").repartition("k1", "k2")  # so that nothing is combined, and widened, before the shuffle
    wide = seen.groupBy("k1", "k2").agg(*[F.sum(F.when(F.col("m") == r.m, F.col("delta"))).alias(f"d{i}") for i, r in enumerate(few)])
    gained = shuffled(keys).join(wide, ["k1", "k2"]).groupBy("doc").agg(*[F.sum(F.col("times") * F.coalesce(f"d{i}", F.lit(0.0))).alias(f"d{i}") for i in range(len(few))])
    kind = dict(m.base.dtypes)["model"]
    each = F.array(*[F.struct(F.lit(r.model).cast(kind).alias("model"), F.lit(r.oov).alias("oov"), F.coalesce(f"d{i}", F.lit(0.0)).alias("gained")) for i, r in enumerate(few)])
    rows = shuffled(docs).join(gained, "doc", "left").select("doc", "grams", F.explode(each).alias("x"))
    return rows.select("doc", "x.model", "grams", (-(F.col("grams") * F.log2("x.oov") + F.col("x.gained"))).alias("neg_log2"))


def entropy(scored: DataFrame) -> DataFrame:
    """(doc, model, entropy, perplexity) per scored word; null for texts without grams."""
    h = F.when(F.col("grams") > 0, F.col("neg_log2") / F.col("grams"))
    return scored.select("doc", "model", h.alias("entropy"), F.pow(F.lit(2.0), h).alias("perplexity"))


def prob(queries: DataFrame, m: Model) -> DataFrame:
    """(model, ctx, tok, p): the probability of each asked word after its context.

    Contexts join their tokens by ``ngrams.SEP``; longer ones than the model uses are cut to their
    last n - 1 tokens, shorter ones start at their own order.
    """
    kept = F.array_join(F.slice(F.split("ctx", ngrams.SEP), -(m.n - 1), m.n - 1), ngrams.SEP) if m.n > 1 else F.lit("")
    n_ctx = F.when(F.col("ctx") == "", 0).otherwise(F.size(F.split("ctx", ngrams.SEP)))
    use = F.when(n_ctx > m.n - 1, kept).otherwise(F.col("ctx"))
    q = queries.select("model", "ctx", "tok", use.alias("use"), F.least(n_ctx, F.lit(m.n - 1)).alias("len")).distinct()
    out = None
    for length in range(m.n):
        part = q.where(F.col("len") == length)
        tails = [F.col("use")]
        for _ in range(length):
            tails.append(shorter(tails[-1]))
        for step in range(length + 1):
            k = length + 1 - step
            part = part.withColumn(f"t{k}", tails[step] if k > 1 else F.lit(""))
        value: Column = None
        for k in range(1, length + 2):
            p = m.probs.where(F.col("ord") == k).select("model", F.col("ctx").alias(f"t{k}"), "tok", F.col("p").alias(f"p{k}"))
            part = part.join(p, ["model", f"t{k}", "tok"], "left")
            if k == 1:
                part = part.join(m.base, "model")
                value = F.coalesce("p1", "oov")
            else:
                a = m.alphas.where(F.col("ord") == k).select("model", F.col("ctx").alias(f"t{k}"), F.col("alpha").alias(f"a{k}"))
                part = part.join(a, ["model", f"t{k}"], "left")
                value = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"a{k}"), F.lit(1.0)) * value)
        part = part.select("model", "ctx", "tok", value.alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def log_prob(queries: DataFrame, m: Model) -> DataFrame:
    """(model, ctx, tok, neg_log2): the negative log2 probability of each asked word after its context."""
    return prob(queries, m).select("model", "ctx", "tok", (-F.log2("p")).alias("neg_log2"))


def generate_all(m: Model, models: list[str], words: int, context: list[str] | None = None, seed: int = 0) -> dict[str, list[str]]:
    """For each model the context and ``words`` words drawn one after another, each from the longest
    context seen. '.' stands where the model has nothing to draw from.

    Every step is one job for all models: each possible word waits for an exponential time with its
    probability as rate, taken from a hash of seed, step, model and word, and the first one is drawn,
    which needs neither an order nor running sums. Texts are kept on the driver: they are short, and
    every step needs the last.
    """
    spark = m.probs.sparkSession
    out = {x: list(context or []) for x in models}
    for step in range(words):
        tails = [(x, k, ngrams.SEP.join(t[len(t) - k + 1 :]) if k > 1 else "") for x, t in out.items() for k in range(1, min(m.n, len(t) + 1) + 1)]
        asked = spark.createDataFrame(tails, f"model {dict(m.probs.dtypes)['model']}, ord int, ctx string")
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "model", "tok"), F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
        first = F.min(F.struct((-F.col("ord")).alias("o"), (-F.log(u) / F.col("p")).alias("wait"), "tok")).alias("first")
        # ``asked`` has at most n rows for each model named
        drawn = {r.model: r.first.tok for r in m.probs.where("p > 0").join(F.broadcast(asked), ["model", "ord", "ctx"]).groupBy("model").agg(first).collect()}
        for x, t in out.items():
            t.append(drawn.get(x, "."))
    return out


def generate(m: Model, model: str, words: int, context: list[str] | None = None, seed: int = 0) -> list[str]:
    """The context and ``words`` words drawn from one model."""
    return generate_all(m, [model], words, context, seed)[model]


def choose_word(m: Model, model: str, context: list[str] | None = None, seed: int = 0) -> str:
    """One word drawn after the context."""
    return generate(m, model, 1, context, seed)[-1]
