import math

import pytest
from pyspark.sql import functions as F

from rhetorica.operators import calibrate, classify, evaluate, learners, lm, ngrams, syntax, util

S = ngrams.SEP


@pytest.fixture(scope="module")
def toy(spark):
    return lm.train(spark.createDataFrame([("m", ["foo", "foo", "foo", "foo", "bar", "baz"])], "model string, tokens array<string>"), 3, 1.0)


def asked(spark, m, rows):
    q = spark.createDataFrame([("m", S.join(c), t) for c, t in rows], "model string, ctx string, tok string")
    return {(tuple(r.ctx.split(S)) if r.ctx else (), r.tok): r.p for r in lm.prob(q, m).collect()}


def test_hand_values(spark, toy):
    p = asked(spark, toy, [(["foo", "foo"], "foo"), (["foo", "foo"], "bar"), (["foo"], "foo"), (["foo"], "bar"), ([], "foo"), ([], "baz"), (["foo"], "baz"), (["foo", "foo"], "baz"), (["x", "foo", "foo"], "baz"), ([], "unknown")])
    want = [3 / 6, 2 / 6, 4 / 7, 2 / 7, 5 / 9, 2 / 9, 1 / 7, 1 / 6, 1 / 6, 1 / 9]
    assert list(p.values()) and all(any(abs(v - w) < 1e-12 for w in want) for v in p.values())
    assert p[("foo", "foo"), "baz"] == pytest.approx(1 / 6) and p[("x", "foo", "foo"), "baz"] == pytest.approx(1 / 6) and p[(), "unknown"] == pytest.approx(1 / 9)
    alpha = {(r.ord, r.ctx): r.alpha for r in toy.alphas.collect()}
    assert alpha[2, "foo"] == pytest.approx(9 / 14) and alpha[3, f"foo{S}foo"] == pytest.approx(7 / 6)


def test_scores_equal_single_probabilities(spark, toy):
    texts = {1: ["foo", "foo", "baz", "qq", "foo"], 2: ["foo"], 3: [], 4: ["bar", "baz", "zz", "zz"]}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(5, None)], "doc int, tokens array<string>")
    got = {r.doc: (r.grams, r.neg_log2) for r in lm.score(df, toy).collect()}
    for k, t in texts.items():
        grams = [(t[i : i + 2], t[i + 2]) for i in range(len(t) - 2)]
        p = asked(spark, toy, grams) if grams else {}
        assert got[k][0] == len(grams)
        assert got[k][1] == pytest.approx(sum(-math.log2(p[tuple(c), w]) for c, w in grams))
    assert got[5] == (0, 0.0)
    e = {r.doc: r.entropy for r in lm.entropy(lm.score(df, toy)).collect()}
    assert e[2] is None and e[1] == pytest.approx(got[1][1] / 3)


def test_probabilities_sum_to_one_with_backoff(spark):
    m = lm.train(spark.createDataFrame([("m", list("abcabdab")), ("m", list("dcba"))], "model string, tokens array<string>"), 2, 0.5)
    p = asked(spark, m, [([c], t) for c in "abcd" for t in "abcd"])
    for c in "abcd":
        assert sum(p[(c,), t] for t in "abcd") == pytest.approx(1.0)


def test_counts(spark):
    df = spark.createDataFrame([("m", ["a", "b", "a", "b"]), ("m", None), ("m", [])], "model string, tokens array<string>")
    c = {(r.ord, r.ctx, r.tok): r.c for r in ngrams.conditional_counts(df, 2).collect()}
    assert c == {(1, "", "a"): 2, (1, "", "b"): 2, (2, "a", "b"): 2, (2, "b", "a"): 1}
    twice = ngrams.add_counts(ngrams.conditional_counts(df, 2), ngrams.conditional_counts(df, 2))
    assert {r.c for r in twice.where("ord = 1").collect()} == {4}
    padded = ngrams.conditional_counts(df, 2, pad_left=True, pad_right=True).where("ord = 2")
    assert padded.agg(F.sum("c")).first()[0] == 6
    with pytest.raises(TypeError):
        ngrams.conditional_counts(spark.createDataFrame([("m", "text")], "model string, tokens string"), 2)


def test_save_load_generate(spark, toy, tmp_path):
    toy.save(str(tmp_path / "m"))
    again = lm.Model.load(spark, str(tmp_path / "m"))
    assert again.n == 3 and again.probs.count() == toy.probs.count()
    words = lm.generate(again, "m", 6, ["foo"], seed=3)
    assert words[0] == "foo" and len(words) == 7 and set(words) <= {"foo", "bar", "baz"}
    assert lm.generate(again, "nobody", 2) == [".", "."]
    assert toy.describe().first().grams == 3 and toy.contexts().count() == 5


def labelled(spark):
    rows = [("A", ["red", "blue", "red", "green"])] * 5 + [("B", ["one", "two", "one", "three"])] * 3 + [(None, ["x"])]
    return spark.createDataFrame(rows, "label string, tokens array<string>")


def test_classifiers(spark):
    train = labelled(spark)
    test = spark.createDataFrame([(1, ["red", "blue"]), (2, ["one", "two", "one"]), (3, ["red"]), (4, None)], "doc int, tokens array<string>")
    many = classify.NgramClassifier(2, 0.1).fit(train)
    assert {r.doc: r.label for r in many.predict(test).collect()} == {1: "A", 2: "B", 3: "A", 4: "A"}  # ties: the first class
    both = classify.NgramClassifier(2, 0.1, binary=True).fit(train)
    assert {r.doc: r.label for r in both.predict(test).collect()} == {1: "A", 2: "B", 3: "A", 4: "A"}
    p = classify.posterior(many.scores(test), many.prior_).groupBy("doc").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in p) and len(p) == 4
    assert {r.doc: r.label for r in classify.one_vs_one(many.scores(test), many.prior_).collect()} == {1: "A", 2: "B", 3: "A", 4: "A"}
    joint = {(r.doc, r.model): r.joint for r in many.predict_proba(test).collect()}
    logs = {(r.doc, r.model): r.log2_joint for r in many.predict_log_proba(test).collect()}
    assert all(joint[k] == pytest.approx(2 ** logs[k]) for k in joint)
    with pytest.raises(ValueError):
        classify.NgramClassifier(2, -1)
    with pytest.warns(UserWarning):
        classify.NgramClassifier(7)
    with pytest.raises(ValueError):
        classify.NgramClassifier(2, binary=True).fit(train.unionByName(train.withColumn("label", F.lit("C"))))


def test_request(spark):
    from rhetorica.functions import text, tokenizers

    m = classify.NgramClassifier(2, 0.1).fit(labelled(spark)).model_
    pipe = text.request_preset(tokenizers.lower_words)
    assert classify.classify_request(m, "<p>one two one</p>", pipe, spark) == "B"
    assert classify.classify_request(m, "", pipe, spark) is None
    assert lm.choose_word(m, "B", ["one"], 1) in ("two", "three")


def test_integer_tokens(spark):
    train = spark.createDataFrame([("A", [1, 2, 1]), ("B", [3, 4, 3])], "label string, tokens array<bigint>")
    got = classify.NgramClassifier(2, 0.1).fit(train).predict(spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "doc int, tokens array<bigint>"))
    assert {r.doc: r.label for r in got.collect()} == {1: "A", 2: "B"}


def test_padded_classifier_uses_first_words(spark):
    train = spark.createDataFrame([("A", ["x", "y"]), ("B", ["y", "x"])], "label string, tokens array<string>")
    got = classify.NgramClassifier(2, 0.1, pad=True).fit(train).predict(spark.createDataFrame([(1, ["x"]), (2, ["y"])], "doc int, tokens array<string>"))
    assert {r.doc for r in got.collect()} == {1, 2}


def test_platt_and_isotonic(spark):
    import random

    rng = random.Random(1)
    rows = [(s, rng.random() < 1 / (1 + math.exp(-(2 * s - 1)))) for s in (rng.uniform(-3, 3) for _ in range(3000))]
    df = spark.createDataFrame(rows, "score double, hit boolean")
    a, b = calibrate.platt(df)
    assert a == pytest.approx(-2, abs=0.3) and b == pytest.approx(1, abs=0.3)
    xs, ys = calibrate.isotonic(df)
    assert ys == sorted(ys) and 0 <= ys[0] and ys[-1] <= 1
    with pytest.raises(ValueError):
        calibrate.platt(df.limit(0))


def test_sigmoids_fitted_together(spark):
    """Each curve is the maximum of its own likelihood, whatever the scale of its scores."""
    import random

    rng = random.Random(2)
    rows = [(k, s * scale, rng.random() < 1 / (1 + math.exp(-a * s - 0.5))) for k, a, scale in (("x", 2.0, 1.0), ("y", -1.0, 100.0), (None, 0.3, 0.01)) for s in (rng.uniform(-3, 3) for _ in range(300))]
    rows += [("all", float(i), True) for i in range(5)] + [("apart", -1.0, False), ("apart", 1.0, True), ("same", 2.0, True), ("same", 2.0, False)]
    got = calibrate.platt_by(spark.createDataFrame(rows, "k string, score double, hit boolean"), ["k"])
    assert set(got) == {("x",), ("y",), (None,), ("all",), ("apart",), ("same",)}
    for (k,), (a, b) in got.items():
        own = [(s, h) for q, s, h in rows if q == k]
        pos = sum(h for _, h in own)
        hi, lo = (pos + 1) / (pos + 2), 1 / (len(own) - pos + 2)
        loss = lambda a, b: sum(math.log1p(math.exp(a * s + b)) - (1 - (hi if h else lo)) * (a * s + b) for s, h in own)
        size = max(abs(s) for s, _ in own)
        assert all(loss(a, b) <= loss(a + da / size, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01)), k


def test_cross_calibration_uses_held_out_rows(spark):
    rows = [(i, "A" if i % 2 else "B", (i // 2) % 2, 1.0 if i % 2 else -1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc int, truth string, fold int, x double")
    seen = []

    def fit(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        return len(seen)

    def score(base, df):
        return df.select("doc", F.explode(F.array(F.struct(F.lit("A").alias("label"), F.col("x").alias("score")), F.struct(F.lit("B").alias("label"), (-F.col("x")).alias("score")))).alias("e")).select("doc", "e.label", "e.score")

    both = calibrate.CrossCalibrated(fit, score).fit(df)
    assert seen == [{1}, {0}]
    p = both.predict_proba(df)
    assert all(r.s == pytest.approx(1) for r in p.groupBy("doc").agg(F.sum("p").alias("s")).collect())
    assert {r.doc: r.label for r in both.predict(df).collect()} == {i: t for i, t, _, _ in rows}


def test_numbers_and_dictionaries(spark):
    rows = [("a" if i < 190 else None if i < 195 else "b", i * 7 % 200, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = {r.v: r._n for r in util.numbered(df, ["g"], ["o"], "t").collect()}
    for g in ("a", None, "b"):
        own = sorted((o, v) for q, o, v in rows if q == g)
        assert [got[v] for _, v in own] == list(range(1, len(own) + 1))
    train = spark.createDataFrame([(["b", "a", None],), (["c"],)], "tokens array<string>")
    vocab = util.vocabulary(train, "tokens")
    assert {r.token: r.id for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2}
    test = spark.createDataFrame([(1, ["c", "new", None, "a"]), (2, []), (3, None)], "doc int, tokens array<string>")
    assert {r.doc: r.tokens for r in util.encoded(test, "tokens", vocab).collect()} == {1: [2, -1, None, 0], 2: [], 3: None}
    both = [classify.NgramClassifier(2, 0.1, use_dictionary=u).fit(labelled(spark)).scores(spark.createDataFrame([(1, ["red", "blue", "new"]), (2, ["one", "two"])], "doc int, tokens array<string>")) for u in (False, True)]
    a, b = ({(r.doc, r.model): round(r.neg_log2, 9) for r in x.collect()} for x in both)
    assert a == b and len(a) == 4


def test_calibrator(spark):
    rows = [(i, c, (2.0 if (i % 2 == 0) == (c == "A") else -2.0) + (i % 5 - 2), "A" if i % 2 == 0 else "B", i % 2) for i in range(60) for c in "AB"]
    df = spark.createDataFrame([(d, c, s, t, (d // 2) % 2) for d, c, s, t, _ in rows], "doc int, label string, score double, truth string, fold int")
    for method in ("sigmoid", "isotonic"):
        p = calibrate.Calibrator(method).fit(df, "fold").predict_proba(df.select("doc", "label", "score"))
        sums = p.groupBy("doc").agg(F.sum("p").alias("s")).collect()
        assert len(sums) == 60 and all(r.s == pytest.approx(1.0) for r in sums)
    with pytest.raises(ValueError):
        calibrate.Calibrator("other").fit(df)
    with pytest.raises(ValueError):
        calibrate.Calibrator().fit(df.where("truth = 'A'"))


def test_isotonic_query_keeps_every_class(spark, monkeypatch):
    from rhetorica.plans import model_queries as q

    rows = [(i, c, float((i % 5 == k) * 2 + i % 3), "ABCDE"[i % 5]) for i in range(50) for k, c in enumerate("ABCDE")]
    df = spark.createDataFrame(rows, "doc int, label string, score double, truth string")
    monkeypatch.setattr(q, "_class_scores", lambda spark, d: df)
    got = q.k06_isotonic(spark, "").collect()
    assert len(got) == 250 and {r.label for r in got} == set("ABCDE") and sum(r.p for r in got) == pytest.approx(50)
    curve = calibrate.Calibrator("isotonic")
    curve.curves_ = [(None, "A", ([0.0, 2.0, 3.0], [0.1, 0.5, 0.9])), (None, "B", ([1.0], [0.5]))]
    asked = spark.createDataFrame([(s, c, v) for s, v in enumerate([-1.0, 0.0, 1.0, 2.0, 2.5, 9.0]) for c in "AB"], "doc int, label string, score double")
    p = {r.doc: r.p for r in curve.predict_proba(asked).where("label = 'A'").collect()}
    assert [p[k] for k in range(6)] == pytest.approx([v / (v + 0.5) for v in (0.1, 0.1, 0.3, 0.5, 0.7, 0.9)])


def test_generate_query_has_every_model(spark, monkeypatch):
    from rhetorica.plans import model_queries as q

    m = lm.train(spark.createDataFrame([(c, ["the", "end"]) for c in "abcd"], "model string, tokens array<string>"), 1, 1.0)
    monkeypatch.setattr(q, "_model", lambda spark, d: m)
    assert [r.model for r in q.l13_generate(spark, "").orderBy("model").collect()] == list("abcd")


def test_calibration_curve(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.05), (1, 1.0), (0, 0.5)], "y int, p double")
    got = {r.bin: (r.n, r.share) for r in calibrate.calibration_curve(df, "y", "p").collect()}
    assert got == {0: (2, 0.5), 2: (1, 0.0), 4: (1, 1.0)}
    with pytest.raises(Exception, match="within"):
        calibrate.calibration_curve(spark.createDataFrame([(0, 1.5)], "y int, p double"), "y", "p").collect()
    assert calibrate.calibration_curve(spark.createDataFrame([(0, 3.0), (1, 5.0)], "y int, p double"), "y", "p", normalize=True).count() == 2


def test_evaluation(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")], "truth string, guess string")
    r = {x.label: x for x in evaluate.report(evaluate.confusion(df)).collect()}
    assert (r["A"].precision, r["A"].recall, r["B"].precision, r["C"].f1) == (1.0, 0.5, pytest.approx(1 / 3), 0.0)
    f1 = evaluate.weighted_f1(evaluate.report(evaluate.confusion(df))).first().f1
    assert f1 == pytest.approx((2 * (2 / 3) + 0.5 + 0) / 4)
    votes = spark.createDataFrame([(1, "m", "A", 0.9, 1.0), (1, "m", "B", 0.1, 1.0), (1, "n", "A", 0.2, 3.0), (1, "n", "B", 0.8, 3.0)], "doc int, model string, label string, p double, weight double")
    assert evaluate.best_label(evaluate.soft_vote(votes), "p").first().label == "B"
    assert evaluate.weight_grid(spark).count() == 90


def test_folds(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    a = evaluate.stratified_folds(df, "id", "label", 5, 1)
    sizes = [r.n for r in a.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert a.count() == 5000 and len(sizes) == 10 and max(sizes) < 2 * min(sizes) * 1.2
    assert evaluate.k_folds(df, "id", 4).select("fold").distinct().count() == 4


def test_naive_bayes_against_hand(spark):
    bags = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3)], "doc int, gram string, n bigint")
    grams, classes = evaluate.naive_bayes(bags, spark.createDataFrame([(1, "X"), (2, "Y")], "doc int, label string"), 1.0)
    got = {(r.doc, r.label): r.log_joint for r in evaluate.naive_bayes_scores(spark.createDataFrame([(9, "a", 1), (9, "new", 5), (8, "new", 1)], "doc int, gram string, n bigint"), grams, classes).collect()}
    assert got[9, "X"] == pytest.approx(math.log(0.5) + math.log(3 / 6)) and got[9, "Y"] == pytest.approx(math.log(0.5) + math.log(1 / 6))
    assert got[8, "X"] == pytest.approx(math.log(0.5))


def test_learners(spark):
    df = labelled(spark).where("label is not null")
    for learner in (learners.linear("log", "elasticnet", 0.01), learners.linear("hinge"), learners.linear_svc(1.0), learners.forest(3, "entropy", 3), learners.bayes(0.5)):
        out = learners.fit(df, learner).transform(df)
        assert out.where("y = prediction").count() == out.count() == 8
    best = learners.grid_search(df.unionByName(df), learners.bayes(), {"smoothing": [0.1, 1.0]}, folds=2)
    assert best.transform(df).count() == 8
    with pytest.raises(ValueError):
        learners.linear("perceptron")


def test_syntax(spark):
    # economic <- news <- have -> effect -> little
    rows = [(1, 0, 1, "economic"), (1, 1, 2, "news"), (1, 2, 2, "have"), (1, 3, 4, "little"), (1, 4, 2, "effect")]
    e = spark.createDataFrame(rows, "sent_id int, idx int, head int, word string")
    g = {r.gram for r in syntax.sn_grams(e, 2, 3).collect()}
    assert g == {"_economic_news", "_news_have", "_little_effect", "_effect_have", "_economic_news_have", "_little_effect_have"}
    assert {r.gram for r in syntax.sn_grams(e, 1, 2, labels=True).collect()} == {"_economic", "_news", "_little", "_effect", "_economic_news", "_little_effect"}
    span = {r.gram for r in syntax.spanning_grams(e, 3, 3).collect()}
    assert span == {"economic_news_have", "have_little_effect", "news_have_effect"}


def test_utilities(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate("Anything you can do I can do better .".split()[:8])], "pos int, token string")
    vocab = util.token_dictionary(rows, ["pos"], "token")
    assert [r.id for r in util.encode(rows, vocab, "token").orderBy("pos").collect()] == [0, 1, 2, 3, 4, 2, 3, 5]
    got = {r.chunk: r["items"] for r in util.chunked(rows.withColumn("g", F.lit(1)), "g", "pos", "token", 3, "").collect()}
    assert got[2] == ["do", "better", ""] and len(got) == 3
    assert util.sample(spark.range(100), "id", 7, 1).count() == 7
    nested = spark.createDataFrame([([["a"], ["b", None]],)], "x array<array<string>>")
    assert nested.select(util.nested_map(F.col("x"), F.upper).alias("x")).first().x == [["A"], ["B", None]]
    assert nested.select(util.flatten(F.col("x")).alias("x")).first().x == ["a", "b", None]


def test_statistics(spark):
    df = spark.createDataFrame([("A", ["x", "y"]), ("A", ["x", "y", "z", "z"]), ("B", []), ("B", None)], "by string, tokens array<string>")
    s = {r.by: r for r in evaluate.length_stats(df, "by").collect()}
    assert (s["A"].n, s["A"].mean, s["A"].spread, s["B"].n) == (2, 3.0, pytest.approx(1.96), 1)
    t = {r.by: (r.words, r.types) for r in evaluate.word_totals(df, "by").collect()}
    assert t == {"A": (6, 3)}
    assert evaluate.word_counts(df, "by", stop=spark.createDataFrame([("x",)], "token string")).count() == 2
    bags = {r.gram: r.n for r in evaluate.vectorize(df, "by", least=1, most=2, stop=["z"]).where("doc = 'A'").collect()}
    assert bags == {"x": 2, "y": 2, "x y": 2}


def test_streaming_counts(spark, tmp_path):
    from rhetorica.streaming.counts import keep_counts, running_counts

    src = tmp_path / "src"
    spark.createDataFrame([("m", ["a", "b"]), ("m", ["a"])], "model string, tokens array<string>").write.parquet(str(src))
    stream = spark.readStream.schema("model string, tokens array<string>").parquet(str(src))
    q = running_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").where("tok = 'a' and ord = 1").first().c == 2
    q = keep_counts(stream, 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert ngrams.add_counts(spark.read.parquet(str(tmp_path / "out")).drop("batch")).where("tok = 'a'").first().c == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def arrays_of(spark, folder, n=300):
    """Rows of long arrays in files of a few bytes, from which Spark guesses what exploded rows will need."""
    spark.range(n).select(F.col("id").alias("doc"), F.array_repeat(F.concat(F.lit("w"), F.col("id") % 7), 40).alias("tokens")).write.parquet(folder)
    return spark.read.parquet(folder)


def test_keys_of_texts_are_not_broadcast(spark, toy, tmp_path):
    plan = plan_of(lm.score(arrays_of(spark, str(tmp_path / "texts")), toy))
    assert "BroadcastHashJoin [k1" not in plan and "SortMergeJoin [k1" in plan


def tree_of(spark, folder):
    texts = arrays_of(spark, folder).groupBy("doc").agg(F.min("tokens").alias("tokens"))
    rows = texts.select(F.col("doc").alias("sent_id"), F.posexplode("tokens").alias("idx", "word"))
    return rows.withColumn("head", F.greatest(F.floor((F.col("idx") - 1) / 2), F.lit(0)).cast("int"))


def test_chains_of_relations_need_no_join(spark, tmp_path):
    grams = syntax.sn_grams(tree_of(spark, str(tmp_path / "texts")), 1, 3, labels=True)
    assert "Join" not in plan_of(grams) and plan_of(grams).count("Exchange hash") == 1
    assert {r.n: r["count"] for r in grams.groupBy("n").count().collect()} == {1: 300 * 39, 2: 300 * 37, 3: 300 * 33}


def test_chains_of_words_need_no_join(spark, tmp_path):
    grams = syntax.sn_grams(tree_of(spark, str(tmp_path / "texts")), 1, 3)
    assert "Join" not in plan_of(grams)
    assert {r.n: r["count"] for r in grams.groupBy("n").count().collect()} == {1: 300 * 40, 2: 300 * 39, 3: 300 * 37}


def test_connected_sets_need_no_join(spark, tmp_path):
    tree = tree_of(spark, str(tmp_path / "texts"))
    sets = syntax.spanning_grams(tree, 1, 3)
    assert "Join" not in plan_of(sets)
    # above the bottom, a token with two children and a pair under each child: chains of three and pairs of siblings
    assert {r.n: r["count"] for r in sets.groupBy("n").count().collect()} == {1: 300 * 40, 2: 300 * 39, 3: 300 * (37 + 19)}
    star = spark.createDataFrame([(1, i, 0, f"w{i}") for i in range(6)], "sent_id int, idx int, head int, word string")
    assert syntax.spanning_grams(star, 3, 3).count() == 10
    circle = spark.createDataFrame([(1, i, (i + 1) % 4, f"w{i}") for i in range(4)], "sent_id int, idx int, head int, word string")
    assert syntax.spanning_grams(circle, 3, 3).count() == 4


def test_bags_are_not_broadcast(spark, tmp_path):
    bags = evaluate.vectorize(arrays_of(spark, str(tmp_path / "texts")), "doc")
    grams, classes = evaluate.naive_bayes(bags, spark.range(300).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("label")))
    seen = []
    before, evaluate.stored = evaluate.stored, lambda df, label: (seen.append(plan_of(df)), before(df, label))[1]
    try:
        scores = evaluate.naive_bayes_scores(bags, grams, classes)
        assert "SortMergeJoin [gram" in seen[0] and scores.count() == 600
        evaluate.naive_bayes(bags, spark.range(300).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("label")))
        assert "SortMergeJoin [doc" in seen[1]
    finally:
        evaluate.stored = before


def test_forest_over_sparse_rows(spark):
    from pyspark.ml.linalg import Vectors

    # of 262,144 features one decides, by its value: 0 and 1 are class 0, 2 is class 1, 3 is class 2
    rows = [(float(max(0, i % 4 - 1)), Vectors.sparse(1 << 18, sorted({i % 1000, 200_000}), [1.0, float(i % 4)] if i % 1000 != 200_000 else [1.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, ["y", "features"])
    tree = learners.forest(1, depth=2).fit(df)
    assert [(tree.feature_[0, n], tree.threshold_[0, n]) for n in (1, 3)] == [(200_000, 1.5), (200_000, 2.5)] and tree.split_.sum() == 2
    out = tree.transform(df)
    assert out.where("y = prediction").count() == 2000 and out.first().probability.toArray().sum() == pytest.approx(1)
    weighed = df.withColumn("w", F.when(F.col("y") == 1, 1000.0).otherwise(1.0))
    assert {r.prediction for r in learners.forest(1, depth=0, weight="w").fit(weighed).transform(df).select("prediction").distinct().collect()} == {1.0}
    few = learners.forest(5, depth=1, seed=3).fit(df)
    assert (few.feature_ == learners.forest(5, depth=1, seed=3).fit(df).feature_).all()


def test_scores_of_few_and_many_models_agree(spark, monkeypatch):
    rows = [(f"m{k}", [f"w{(i * k) % 9}" for i in range(30)]) for k in range(1, 5)]
    m = lm.train(spark.createDataFrame(rows, "model string, tokens array<string>"), 3, 0.5)
    texts = spark.createDataFrame([(1, ["w1", "w2", "w4", "zz", "w1", "w2", "w3"]), (2, ["w0"]), (3, None), (4, ["qq"] * 5), (None, ["w1", "w2", "w3"])], "doc int, tokens array<string>")
    show = lambda df: sorted((str(r.doc), r.model, r.grams, round(r.neg_log2, 9)) for r in df.collect())
    few = lm.score(texts, m)
    assert plan_of(few).count("Generate") == 4  # windows, their n-grams and keys, and at the end a row for each model
    monkeypatch.setattr(lm, "WIDE", 3)
    many = lm.score(texts, m)
    assert show(few.where("doc is not null")) == show(many.where("doc is not null")) and few.count() == many.count() == 20 and few.columns == many.columns
