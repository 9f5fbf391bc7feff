"""Queries of language models, classifiers, calibration and evaluation.

Speakers are the classes: models are trained on the labelled sentences and score the processed
stretches, which are other texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rhetorica.operators import calibrate, classify, evaluate, learners, lm, ngrams
from rhetorica.operators import transcripts as tr
from rhetorica.plans.inputs import STRETCHES_SQL, WORDS_OF_SPEECH_SQL, spoken_words, stretches
from rhetorica.plans.registry import query
from rhetorica.sources.tables import stored, table

GAMMA = 0.2
COUNTS_SQL = f"""{WORDS_OF_SPEECH_SQL},
pos AS (SELECT speaker AS model, t, unnest(range(1, len(t) + 1)) AS i FROM spoken),
counts AS (SELECT model, 1 AS ord, '' AS ctx, t[i] AS tok, count(*) AS c FROM pos GROUP BY ALL
  UNION ALL SELECT model, 2, t[i - 1], t[i], count(*) FROM pos WHERE i >= 2 GROUP BY ALL
  UNION ALL SELECT model, 3, t[i - 2] || chr(31) || t[i - 1], t[i], count(*) FROM pos WHERE i >= 3 GROUP BY ALL),
bins AS (SELECT model, ord, count(DISTINCT tok) AS b FROM counts GROUP BY ALL),
totals AS (SELECT model, ord, ctx, sum(c) AS total FROM counts GROUP BY ALL),
probs AS (SELECT model, ord, ctx, tok, c, (c + {GAMMA}::DOUBLE) / (total + {GAMMA}::DOUBLE * b) AS p FROM counts JOIN totals USING (model, ord, ctx) JOIN bins USING (model, ord)),
low AS (SELECT a.model, a.ord, a.ctx, a.p, b.p AS q FROM probs a JOIN probs b ON a.model = b.model AND b.ord = a.ord - 1 AND b.tok = a.tok
  AND b.ctx = CASE WHEN contains(a.ctx, chr(31)) THEN split_part(a.ctx, chr(31), 2) ELSE '' END WHERE a.ord > 1),
alphas AS (SELECT model, ord, ctx, CASE WHEN 1 - sum(q) <= 1e-12 THEN 0 ELSE greatest(1 - sum(p), 0) / (1 - sum(q)) END AS alpha FROM low GROUP BY ALL),
base AS (SELECT model, {GAMMA}::DOUBLE / (total + {GAMMA}::DOUBLE * b) AS oov FROM totals JOIN bins USING (model, ord) WHERE ord = 1)"""
SCORES_SQL = f"""{COUNTS_SQL}, {STRETCHES_SQL},
grams AS (SELECT doc, t[i - 2] AS u, t[i - 1] AS v, t[i] AS w, count(*) AS times FROM (SELECT doc, t, unnest(range(3, len(t) + 1)) AS i FROM stretches) GROUP BY ALL),
each AS (SELECT DISTINCT u, v, w FROM grams),
eachp AS (SELECT e.u, e.v, e.w, base.model, coalesce(p3.p, coalesce(a3.alpha, 1) * coalesce(p2.p, coalesce(a2.alpha, 1) * coalesce(p1.p, base.oov))) AS p FROM each e CROSS JOIN base
  LEFT JOIN probs p3 ON p3.model = base.model AND p3.ord = 3 AND p3.ctx = e.u || chr(31) || e.v AND p3.tok = e.w
  LEFT JOIN alphas a3 ON a3.model = base.model AND a3.ord = 3 AND a3.ctx = e.u || chr(31) || e.v
  LEFT JOIN probs p2 ON p2.model = base.model AND p2.ord = 2 AND p2.ctx = e.v AND p2.tok = e.w
  LEFT JOIN alphas a2 ON a2.model = base.model AND a2.ord = 2 AND a2.ctx = e.v
  LEFT JOIN probs p1 ON p1.model = base.model AND p1.ord = 1 AND p1.tok = e.w),
scores AS (SELECT s.doc, base.model, coalesce(g.n, 0) AS grams, coalesce(x.nl, 0) AS neg_log2 FROM stretches s CROSS JOIN base
  LEFT JOIN (SELECT doc, sum(times) AS n FROM grams GROUP BY doc) g USING (doc)
  LEFT JOIN (SELECT doc, model, sum(-log2(p) * times) AS nl FROM grams JOIN eachp USING (u, v, w) GROUP BY ALL) x ON x.doc = s.doc AND x.model = base.model),
prior AS (SELECT speaker AS model, count(*) AS n, count(*) / sum(count(*)) OVER () AS prior FROM spoken GROUP BY speaker)"""


def _model(spark, d, n: int = 3):
    return lm.train(spoken_words(spark, d).withColumnRenamed("speaker", "model"), n, GAMMA)


def _scores(spark, d):
    return lm.score(stretches(spark, d), _model(spark, d))


def _prior(spark, d):
    return classify.priors(spoken_words(spark, d), "speaker")


def flagship(spark, d):
    """Trigram models of all speakers and their scores for every processed stretch."""
    return l10_prob_seq(spark, d)


@query(f"WITH {COUNTS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, tok, c FROM counts")
def l04_counts(spark, d):
    counts = ngrams.conditional_counts(spoken_words(spark, d).withColumnRenamed("speaker", "model"), 3)
    return counts.withColumn("ctx", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")))


@query(
    f"""WITH {WORDS_OF_SPEECH_SQL}, p AS (SELECT speaker AS model, list_concat(['<P>', '<P>'], t, ['<P>', '<P>']) AS t FROM spoken), w AS (SELECT model, t, unnest(range(3, len(t) + 1)) AS i FROM p)
SELECT model, t[i - 2] || ' ' || t[i - 1] AS ctx, t[i] AS tok, count(*) AS c FROM w GROUP BY ALL"""
)
def l02_padded_counts(spark, d):
    counts = ngrams.conditional_counts(spoken_words(spark, d).withColumnRenamed("speaker", "model"), 3, pad_left=True, pad_right=True).where("ord = 3")
    shown = lambda c: F.replace(F.replace(F.col(c), F.lit(ngrams.SEP), F.lit(" ")), F.lit(ngrams.pad_token(3)), F.lit("<P>"))
    return counts.select("model", shown("ctx").alias("ctx"), shown("tok").alias("tok"), "c")


@query(f"WITH {COUNTS_SQL} SELECT model, ord, b FROM bins")
def l05_bins(spark, d):
    return _model(spark, d).bins


@query(f"WITH {COUNTS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, tok, round(p, 9) AS p FROM probs")
def l06_lidstone(spark, d):
    return _model(spark, d).probs.select("model", "ord", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")).alias("ctx"), "tok", F.round("p", 9).alias("p"))


@query(f"WITH {COUNTS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, round(alpha, 6) AS alpha FROM alphas")
def l07_backoff(spark, d):
    return _model(spark, d).alphas.select("model", "ord", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")).alias("ctx"), F.round("alpha", 6).alias("alpha"))


_ASKED = [("the", "capital"), ("we", "spent"), ("no", "elephant"), ("", "the"), ("", "zzz")]
_ASKED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _ASKED)


@query(
    f"""WITH {COUNTS_SQL}, q(ctx, tok) AS (VALUES {_ASKED_SQL})
SELECT base.model, q.ctx, q.tok, round(CASE WHEN q.ctx = '' THEN coalesce(p1.p, oov) ELSE coalesce(p2.p, coalesce(alpha, 1) * coalesce(p1.p, oov)) END, 9) AS p FROM q CROSS JOIN base
LEFT JOIN probs p1 ON p1.model = base.model AND p1.ord = 1 AND p1.tok = q.tok LEFT JOIN probs p2 ON p2.model = base.model AND p2.ord = 2 AND p2.ctx = q.ctx AND p2.tok = q.tok
LEFT JOIN alphas a ON a.model = base.model AND a.ord = 2 AND a.ctx = q.ctx"""
)
def l08_prob(spark, d):
    m = _model(spark, d)
    asked = spark.createDataFrame(_ASKED, "ctx string, tok string").crossJoin(m.base.select("model"))  # a fixed handful of questions per model
    return lm.prob(asked, m).withColumn("p", F.round("p", 9))


@query(f"WITH {SCORES_SQL} SELECT doc, model, grams::BIGINT AS grams, round(neg_log2, 4) AS neg_log2 FROM scores")
def l10_prob_seq(spark, d):
    return _scores(spark, d).select("doc", "model", F.col("grams").cast("bigint").alias("grams"), F.round(F.col("neg_log2") + 0.0, 4).alias("neg_log2"))


@query(f"WITH {SCORES_SQL} SELECT doc, model, round(neg_log2 / nullif(grams, 0), 5) AS entropy, round(pow(2, neg_log2 / nullif(grams, 0)), 2) AS perplexity FROM scores")
def l11_entropy(spark, d):
    return lm.entropy(_scores(spark, d)).select("doc", "model", F.round("entropy", 5).alias("entropy"), F.round("perplexity", 2).alias("perplexity"))


@query(f"WITH {COUNTS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, tok, c FROM counts")
def l15_incremental(spark, d):
    """Counts of two parts of the corpus, added up: the same as those of the whole."""
    rows = spoken_words(spark, d).withColumnRenamed("speaker", "model")
    short = F.size("tokens") <= 12
    counts = ngrams.add_counts(ngrams.conditional_counts(rows.where(short), 3), ngrams.conditional_counts(rows.where(~short), 3))
    return counts.withColumn("ctx", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")))


@query(f"WITH {COUNTS_SQL} SELECT model, 3 AS n, count(*) AS grams FROM probs WHERE ord = 3 GROUP BY model")
def l17_describe(spark, d):
    return _model(spark, d).describe()


@query()
def l13_generate(spark, d):
    """Ten words from the model of each speaker."""
    m = _model(spark, d)
    names = [r.model for r in m.base.select("model").orderBy("model").collect()]
    texts = lm.generate_all(m, names, 10, ["the"], seed=1)
    return spark.createDataFrame([(x, " ".join(t)) for x, t in texts.items()], "model string, text string")


@query(f"WITH {SCORES_SQL} SELECT doc, arg_min(model, (round(neg_log2, 9), model)) AS label FROM scores GROUP BY doc")
def c09_argmax(spark, d):
    return classify.argmax(_scores(spark, d))


@query(f"WITH {SCORES_SQL} SELECT doc, model, round(log2(prior) - neg_log2, 4) AS log2_joint FROM scores JOIN prior USING (model)")
def c06_log_proba(spark, d):
    return classify.log_proba(_scores(spark, d), _prior(spark, d)).withColumn("log2_joint", F.round("log2_joint", 4))


@query(
    f"""WITH {SCORES_SQL}, j AS (SELECT doc, model, log2(prior) - neg_log2 AS lj FROM scores JOIN prior USING (model)), t AS (SELECT doc, model, pow(2, lj - max(lj) OVER (PARTITION BY doc)) AS e FROM j)
SELECT doc, model, round(e / sum(e) OVER (PARTITION BY doc), 6) AS p FROM t"""
)
def c10_posterior(spark, d):
    return classify.posterior(_scores(spark, d), _prior(spark, d)).withColumn("p", F.round("p", 6))


@query(
    f"""WITH {SCORES_SQL}, j AS (SELECT doc, model, log2(prior) - neg_log2 AS lj FROM scores JOIN prior USING (model) WHERE model IN ('JORAGARD', 'WENDOURATH')),
r AS (SELECT doc, sum(CASE WHEN model = 'JORAGARD' THEN lj ELSE -lj END) AS r FROM j GROUP BY doc) SELECT doc, round(r, 4) AS ratio, CASE WHEN r > 0 THEN 'JORAGARD' ELSE 'WENDOURATH' END AS label FROM r"""
)
def c05_binary(spark, d):
    return classify.ratio(_scores(spark, d), _prior(spark, d), "JORAGARD", "WENDOURATH").withColumn("ratio", F.round("ratio", 4))


@query(
    f"""WITH {SCORES_SQL}, j AS (SELECT doc, model, log2(prior) - neg_log2 AS lj FROM scores JOIN prior USING (model)), r AS (SELECT doc, model, row_number() OVER (PARTITION BY doc ORDER BY round(lj, 9), model DESC) - 1 AS votes FROM j)
SELECT doc, arg_max(model, votes) AS label, max(votes) AS votes FROM r GROUP BY doc"""
)
def e12_one_vs_one(spark, d):
    return classify.one_vs_one(_scores(spark, d), _prior(spark, d)).withColumn("votes", F.col("votes").cast("bigint"))


@query(f"WITH {WORDS_OF_SPEECH_SQL} SELECT speaker AS model, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS prior, round(log2(count(*) / sum(count(*)) OVER ()), 9) AS log2_prior FROM spoken GROUP BY speaker")
def c03_priors(spark, d):
    return _prior(spark, d).select("model", "n", F.round("prior", 9).alias("prior"), F.round("log2_prior", 9).alias("log2_prior"))


def _truth(spark, d):
    """(doc, truth): the stretches whose stored name is a speaker."""
    known = table(spark, d, "speakers").select(F.col("speaker").alias("truth")).distinct()
    return stretches(spark, d).select("doc", F.upper(tr.clean_label(F.col("name"))).alias("truth")).join(known, "truth", "left_semi")


def _judged(spark, d):
    """(doc, truth, guess): these stretches with the speaker that scores best."""
    return _truth(spark, d).join(classify.argmax(_scores(spark, d)).withColumnRenamed("label", "guess"), "doc")


JUDGED_SQL = f"""{SCORES_SQL}, guess AS (SELECT doc, arg_min(model, (round(neg_log2, 9), model)) AS guess FROM scores GROUP BY doc),
judged AS (SELECT doc, upper(trim(name, ' :[]')) AS truth, guess FROM stretches JOIN guess USING (doc) WHERE upper(trim(name, ' :[]')) IN (SELECT speaker FROM speakers)),
names AS (SELECT truth AS label FROM judged UNION SELECT guess FROM judged),
per AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (guess = label) AS guessed, count(*) FILTER (truth = label) AS support FROM names CROSS JOIN judged GROUP BY label),
rep AS (SELECT label, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM per),
report AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM rep)"""


@query(f"WITH {JUDGED_SQL} SELECT truth, guess, count(*) AS n FROM judged GROUP BY ALL")
def e16_confusion(spark, d):
    return evaluate.confusion(_judged(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM report")
def e17_report(spark, d):
    r = evaluate.report(evaluate.confusion(_judged(spark, d)))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


@query(f"WITH {JUDGED_SQL} SELECT round(sum(f1 * support) / sum(support), 6) AS f1 FROM report")
def e16_weighted_f1(spark, d):
    return evaluate.weighted_f1(evaluate.report(evaluate.confusion(_judged(spark, d)))).select(F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {WORDS_OF_SPEECH_SQL}, {STRETCHES_SQL}, b AS (SELECT speaker, unnest(t) AS gram FROM spoken), n AS (SELECT speaker, gram, count(*) AS n FROM b GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS v FROM n), tot AS (SELECT speaker, sum(n) AS total FROM n GROUP BY speaker), docs AS (SELECT speaker, count(*) AS k FROM spoken GROUP BY speaker),
c AS (SELECT speaker, ln(k / (SELECT sum(k) FROM docs)) AS log_prior, ln(0.075 / (total + 0.075 * v)) AS unseen, total, v FROM tot JOIN docs USING (speaker), v),
g AS (SELECT doc, gram, count(*) AS n FROM (SELECT doc, unnest(t) AS gram FROM stretches) WHERE gram IN (SELECT gram FROM n) GROUP BY ALL),
s AS (SELECT g.doc, c.speaker, sum(g.n * ln((coalesce(n.n, 0) + 0.075) / (total + 0.075 * v))) + any_value(log_prior) AS lj FROM g CROSS JOIN c LEFT JOIN n ON n.speaker = c.speaker AND n.gram = g.gram GROUP BY ALL)
SELECT doc, speaker AS label, round(lj, 4) AS log_joint FROM s"""
)
def e07_naive_bayes(spark, d):
    train = spoken_words(spark, d)
    bags = evaluate.vectorize(train, "row_id")
    grams, classes = evaluate.naive_bayes(bags, train.select(F.col("row_id").alias("doc"), F.col("speaker").alias("label")), 0.075)
    scores = evaluate.naive_bayes_scores(evaluate.vectorize(stretches(spark, d), "doc"), grams, classes, empty=False)
    return scores.select("doc", "label", F.round("log_joint", 4).alias("log_joint"))


@query()
def e15_stratified_folds(spark, d):
    rows = evaluate.stratified_folds(spoken_words(spark, d).select("row_id", "speaker"), "row_id", "speaker", 5)
    return rows.groupBy("speaker", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def e14_cross_validation(spark, d):
    """Weighted F1 of bigram class models on each of three folds, every sentence held out once."""
    rows = stored(evaluate.k_folds(spoken_words(spark, d), "row_id", 3), "folds")
    parts = None
    for f in range(3):
        c = classify.NgramClassifier(2, 0.1).fit(rows.where(F.col("fold") != f), "speaker")
        held = rows.where(F.col("fold") == f).select(F.col("row_id").alias("doc"), F.col("speaker").alias("truth"), "tokens")
        judged = held.join(c.predict(held), "doc").select("truth", F.col("label").alias("guess"))
        part = evaluate.weighted_f1(evaluate.report(evaluate.confusion(judged))).select(F.lit(f).alias("fold"), "f1")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _class_scores(spark, d):
    """(doc, label, score, truth): log posterior odds of each class for stretches with a known speaker."""
    p = classify.posterior(_scores(spark, d), _prior(spark, d))
    truth = _truth(spark, d)
    odds = F.log(F.greatest("p", F.lit(1e-12))) - F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))
    return stored(p.join(truth, "doc").select("doc", F.col("model").alias("label"), odds.alias("score"), "truth", "p"), "class-scores")


@query()
def k01_calibrated(spark, d):
    """Class probabilities of the stretches: bigram models fitted on one half of the sentences, sigmoids
    on the scores of the other half, and the reverse; the mean of both."""
    rows = spoken_words(spark, d).select(F.col("row_id").alias("doc"), F.col("speaker").alias("truth"), "tokens")
    rows = stored(evaluate.k_folds(rows, "doc", 2), "halves")

    def score(base, df):
        p = classify.posterior(base.scores(df), base.prior_)
        odds = F.log(F.greatest("p", F.lit(1e-12))) - F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))
        return p.select("doc", F.col("model").alias("label"), odds.alias("score"))

    both = calibrate.CrossCalibrated(lambda df: classify.NgramClassifier(2, 0.1).fit(df, "truth"), score).fit(rows)
    return both.predict_proba(stretches(spark, d))


@query(
    f"""WITH {JUDGED_SQL}, j AS (SELECT doc, model, log2(prior) - neg_log2 AS lj FROM scores JOIN prior USING (model)), t AS (SELECT doc, model, pow(2, lj - max(lj) OVER (PARTITION BY doc)) AS e FROM j),
p AS (SELECT doc, model, round(e / sum(e) OVER (PARTITION BY doc), 6) AS p FROM t), y AS (SELECT p.p, (truth = model)::INT AS y FROM p JOIN judged USING (doc))
SELECT floor(p * 5 / (1 + 1e-8))::INT AS bin, count(*) AS n, round(avg(y), 6) AS share, round(avg(p), 6) AS mean_prob FROM y GROUP BY 1"""
)
def k07_calibration_curve(spark, d):
    p = classify.posterior(_scores(spark, d), _prior(spark, d)).withColumn("p", F.round("p", 6))
    rows = p.join(_truth(spark, d), "doc").select("p", (F.col("truth") == F.col("model")).cast("int").alias("y"))
    return calibrate.calibration_curve(rows, "y", "p").select("bin", "n", F.round("share", 6).alias("share"), F.round("mean_prob", 6).alias("mean_prob"))


@query()
def e19_soft_vote(spark, d):
    """Posteriors of the language models and of naive Bayes, averaged two to one."""
    a = classify.posterior(_scores(spark, d), _prior(spark, d)).select("doc", F.col("model").alias("label"), "p", F.lit(2.0).alias("weight"))
    nb = e07_naive_bayes(spark, d).select("doc", F.col("label").alias("model"), (-F.col("log_joint") / F.log(F.lit(2.0))).alias("neg_log2"))
    flat = _prior(spark, d).withColumn("log2_prior", F.lit(0.0))
    b = classify.posterior(nb, flat).select("doc", F.col("model").alias("label"), "p", F.lit(1.0).alias("weight"))
    return evaluate.best_label(evaluate.soft_vote(a.unionByName(b)), "p")


@query()
def e08_logistic(spark, d):
    """Speakers guessed for the stretches by a linear model on bags of words; trained on the sentences."""
    return _learned(spark, d, learners.linear("log", "l2", 1e-3))


@query()
def e09_forest(spark, d):
    return _learned(spark, d, learners.forest(trees=10, depth=6, seed=1))


def _learned(spark, d, learner):
    train = stored(spoken_words(spark, d).select("tokens", F.col("speaker").alias("label")), "bags")
    model = learners.fit(train, learner)
    known = _names(spark, d)
    guess = model.transform(known)
    labels = model.stages[1].labels
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return guess.select("doc", F.col("label").alias("truth"), named.alias("guess"))


def _names(spark, d):
    """(doc, tokens, label) of the stretches whose stored name is a speaker."""
    known = table(spark, d, "speakers").select(F.col("speaker").alias("label")).distinct()
    return stretches(spark, d).withColumn("label", F.upper(tr.clean_label(F.col("name")))).join(known, "label", "left_semi").select("doc", "tokens", "label")


SENTENCES_SQL = """one AS (SELECT proc_id, min(sents) AS sents, min(name) AS name FROM processed WHERE proc_id IS NOT NULL AND sents IS NOT NULL GROUP BY proc_id),
stored AS (SELECT proc_id, name, sents, unnest(range(1, len(sents) + 1)) AS i FROM one),
stretches AS (SELECT proc_id || ':' || i AS doc, name, list_filter(sents[i], lambda t: t NOT IN ('<S>', '</S>')) AS t FROM stored WHERE sents[i] IS NOT NULL)"""


@query(
    f"""WITH {SCORES_SQL.replace(STRETCHES_SQL, SENTENCES_SQL)}, j AS (SELECT doc, model, pow(2, log2(prior) - neg_log2) AS joint FROM scores JOIN prior USING (model))
SELECT doc, model, joint > 0 AS positive, round(CASE WHEN joint > 1e-300 THEN log2(joint) END, 4) AS log2_of_joint FROM j"""
)
def c07_joint_proba(spark, d):
    """Joint probabilities of the stored sentences, which are short enough for them; shown as logarithms."""
    one = table(spark, d, "processed").where("proc_id is not null and sents is not null").groupBy("proc_id").agg(F.min("sents").alias("sents"))
    each = one.select("proc_id", F.posexplode("sents").alias("i", "s")).where("s is not null")
    docs = each.select(F.concat("proc_id", F.lit(":"), F.col("i") + 1).alias("doc"), F.filter("s", lambda t: ~t.isin("<S>", "</S>")).alias("tokens"))
    joint = classify.joint_proba(lm.score(docs, _model(spark, d)), _prior(spark, d))
    return joint.select("doc", "model", (F.col("joint") > 0).alias("positive"), F.round(F.when(F.col("joint") > 1e-300, F.log2("joint")), 4).alias("log2_of_joint"))


@query(f"WITH {SCORES_SQL} SELECT doc, arg_min(model, (round(neg_log2, 9), model)) AS label FROM scores GROUP BY doc")
def c02_dictionary(spark, d):
    """The speaker that scores best, by a classifier that numbers its tokens."""
    c = classify.NgramClassifier(3, GAMMA, use_dictionary=True).fit(spoken_words(spark, d), "speaker")
    return c.predict(stretches(spark, d).select("doc", "tokens"))


PROCESSED_MODELS_SQL = f"""one AS (SELECT proc_id, min(sents) AS sents, min(name) AS name, max(num_word_types) AS types FROM processed WHERE proc_id IS NOT NULL AND sents IS NOT NULL GROUP BY proc_id),
said AS (SELECT upper(trim(name, ' :[]')) AS model, unnest(sents) AS t FROM one WHERE types > 0 AND upper(trim(name, ' :[]')) IN (SELECT speaker FROM speakers)),
spots AS (SELECT model, t, unnest(range(1, len(t) + 1)) AS i FROM said),
counts AS ({" UNION ALL ".join(f"SELECT model, {k} AS ord, {' || chr(31) || '.join(f't[i - {j}]' for j in range(k - 1, 0, -1)) or repr('')} AS ctx, t[i] AS tok, count(*) AS c FROM spots WHERE i >= {k} GROUP BY ALL" for k in range(1, 5))}),
bins AS (SELECT model, ord, count(DISTINCT tok) AS b FROM counts GROUP BY ALL), totals AS (SELECT model, ord, ctx, sum(c) AS total FROM counts GROUP BY ALL),
probs AS (SELECT model, ord, ctx, tok, c, (c + {GAMMA}::DOUBLE) / (total + {GAMMA}::DOUBLE * b) AS p FROM counts JOIN totals USING (model, ord, ctx) JOIN bins USING (model, ord)),
low AS (SELECT a.model, a.ord, a.ctx, a.p, b.p AS q FROM probs a JOIN probs b ON a.model = b.model AND b.ord = a.ord - 1 AND b.tok = a.tok AND b.ctx = CASE WHEN contains(a.ctx, chr(31)) THEN substr(a.ctx, instr(a.ctx, chr(31)) + 1) ELSE '' END WHERE a.ord > 1),
alphas AS (SELECT model, ord, ctx, CASE WHEN 1 - sum(q) <= 1e-12 THEN 0 ELSE greatest(1 - sum(p), 0) / (1 - sum(q)) END AS alpha FROM low GROUP BY ALL)"""


def _processed_models(spark, d):
    """4-gram models of the speakers from the stored sentences of their stretches with a count of word types."""
    one = table(spark, d, "processed").where("proc_id is not null and sents is not null").groupBy("proc_id").agg(F.min("sents").alias("sents"), F.min("name").alias("name"), F.max("num_word_types").alias("types"))
    known = table(spark, d, "speakers").select(F.col("speaker").alias("model")).distinct()
    said = one.where("types > 0").select(F.upper(tr.clean_label(F.col("name"))).alias("model"), F.explode("sents").alias("tokens")).join(known, "model", "left_semi")
    return lm.train(said, 4, GAMMA)


@query(f"WITH {PROCESSED_MODELS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, tok, round(p, 9) AS p FROM probs")
def l19_four_grams(spark, d):
    return _processed_models(spark, d).probs.select("model", "ord", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")).alias("ctx"), "tok", F.round("p", 9).alias("p"))


@query(f"WITH {PROCESSED_MODELS_SQL} SELECT model, ord, replace(ctx, chr(31), ' ') AS ctx, round(alpha, 6) AS alpha FROM alphas")
def l19_four_gram_backoff(spark, d):
    return _processed_models(spark, d).alphas.select("model", "ord", F.replace("ctx", F.lit(ngrams.SEP), F.lit(" ")).alias("ctx"), F.round("alpha", 6).alias("alpha"))


@query()
def e10_linear_svc(spark, d):
    return _learned(spark, d, learners.linear_svc(1.0))


@query()
def e13_grid_search(spark, d):
    """The mean weighted F1 over two folds of naive Bayes with each smoothing, and which one is best."""
    rows = stored(spoken_words(spark, d).select("tokens", F.col("speaker").alias("label")), "bags")
    grid = [0.05, 0.5, 2.0]
    found = learners.grid_search(rows, learners.bayes(), {"smoothing": grid}, folds=2).stages[-1]
    best = max(found.avgMetrics)
    return spark.createDataFrame([(g, float(m), bool(m == best)) for g, m in zip(grid, found.avgMetrics)], "smoothing double, f1 double, best boolean")


@query()
def k06_isotonic(spark, d):
    """Class probabilities of the stretches by rising curves instead of sigmoids, for every class that is the truth of one."""
    s = _class_scores(spark, d)
    seen = s.where("truth = label").select("label").distinct()
    s = s.join(seen, "label", "left_semi")
    return calibrate.Calibrator("isotonic").fit(s).predict_proba(s.select("doc", "label", "score"))
