import re

import pytest
from pyspark.sql import functions as F

from rhetorica.functions import annotated, text, tokenizers


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (text.html_text, "<p>a &amp; <b>b</b></p>", "a & b"),
        (text.html_tags_removed, "<p>a <b class='x'>b</b> 1 < 2</p>", "a b 1 < 2"),
        (text.html_entities, "caf&eacute; &lt;", "café <"),
        (text.common_entities, "&amp;lt; &nbsp;", "&lt;  "),
        (text.deaccent, "Čafé 中", "Cafe "),
        (text.punctuation_to_space, "a,, b!c", "a  b c"),
        (text.white_space, "a \t\n b", "a b"),
        (text.strip, "\t a b \n", "a b"),
        (text.brackets_removed, "a [loud cheers]b [1]", "a b [1]"),
        (text.spaced_ellipsis, "so . . . yes", "so ... yes"),
        (text.long_ellipsis, "so..... yes", "so... yes"),
        (text.ellipsis_bracket, "a ... [x] ... b", "a   b"),
        (text.add_punct, "yes", "yes."),
        (text.add_punct, "yes!", "yes!"),
        (text.add_punct, "", ""),
        (text.add_delimiters, "a", "<S> a </S>"),
    ],
)
def test_substitutions(spark, function, given, wanted):
    assert one(spark, function, given) == wanted
    assert one(spark, function, None) is None


def test_filters(spark):
    assert one(spark, text.too_short, "abc") and not one(spark, text.too_short, "abcd")
    assert one(spark, text.non_ascii, "é") and not one(spark, text.non_ascii, "e")
    assert [one(spark, text.loose_ends, x) for x in ("...a", "a-", "", "a")] == [True, True, True, False]


def test_pipeline_order_and_batch(spark):
    df = spark.createDataFrame([(1, "  Some  text "), (2, "ab"), (3, None), (4, ""), (5, "a" * 100_000)], "id int, s string")
    p = text.Pipeline(before=["white-space", "strip"], filters=["len"], after=["lower"], tokenizer=tokenizers.white_space_tokens)
    got = {r.id: r.s for r in p.apply(df, "s").collect()}
    assert got == {1: ["some", "text"], 5: ["a" * 100_000]}
    assert text.Pipeline().apply(df, "s").count() == 3


def test_specs(spark):
    assert one(spark, text.substitution(re.compile("b")), "abc") == "ac"
    assert one(spark, text.substitution(("b", "x")), "abc") == "axc"
    assert one(spark, text.text_filter(("len", 5)), "abcde")
    assert one(spark, text.text_filter("non_ascii"), "é")
    with pytest.raises(ValueError):
        text.Pipeline(before=["puntuation"])
    with pytest.raises(ValueError):
        text.Pipeline(filters=["nothing"])


def test_presets(spark):
    df = spark.createDataFrame([("[applause] We  go . . . on",), ("- no",), ("...",)], "s string")
    assert [r.s for r in text.document_preset().apply(df, "s").collect()] == ["We go ... on", "- no", "..."]
    assert [r.s for r in text.sentence_preset().apply(df, "s").collect()] == ["[applause] We go . . . on"]
    assert one(spark, text.request_preset(), "<b>caf&eacute;</b>") == "cafe."


def test_tokenizers(spark):
    assert one(spark, tokenizers.white_space_tokens, " a  b ") == ["a", "b"]
    assert one(spark, tokenizers.word_punct_tokens, "Don't go...") == ["Don", "'", "t", "go", "..."]
    assert one(spark, tokenizers.lower_words, "Été, 2x") == ["été", "2x"]
    assert one(spark, tokenizers.rule_sentences, 'Dr. A. Smith came. "He left." Why? No') == ["Dr. A. Smith came.", '"He left."', "Why?", "No"]
    assert one(spark, tokenizers.sentence_tokens, "Hi.") == ["<S>", "hi", ".", "</S>"]


SCHEMA = "doc int, sent int, idx int, text string, lemma string, tag string, dep string, head int, ent int, np int, cluster int, is_punct boolean, is_space boolean, is_digit boolean, like_num boolean, is_title boolean"


def tokens_of(spark):
    row = lambda i, w, lemma, tag, dep, head, ent=None, np=None, cl=0, **f: (1, 1, i, w, lemma, tag, dep, head, ent, np, cl, f.get("p", False), f.get("s", False), f.get("d", False), f.get("n", False), w.istitle())
    return spark.createDataFrame(
        [row(0, "The", "the", "DT", "det", 2, np=1), row(1, "New", "new", "NNP", "compound", 2, ent=1, np=1, cl=9), row(2, "York", "york", "NNP", "nsubj", 3, ent=1, np=1, cl=9), row(3, "voted", "vote", "VBD", "ROOT", 3, cl=7), row(4, "7", "7", "CD", "nummod", 3, d=True, n=True), row(5, ".", ".", ".", "punct", 3, p=True), row(6, " ", " ", "SP", "", 3, s=True)],
        SCHEMA,
    )


def lemmas(df, **kw):
    return [r.token for r in annotated.tokens(df, **kw).orderBy("idx").collect()]


def test_annotated(spark):
    t = tokens_of(spark)
    assert lemmas(t) == ["the", "new", "york", "vote", "7", "."]
    assert lemmas(t, punct=False) == ["the", "new", "york", "vote", "7"]
    assert lemmas(t, punct=False, numbers=False) == ["the", "new", "york", "vote"]
    assert lemmas(t, cased=True)[:3] == ["The", "New", "York"]
    assert lemmas(t, clusters=True) == ["the", "new", "york", "**7**", "7", "."]
    assert lemmas(annotated.merge_entities(t)) == ["the", "new york", "vote", "7", "."]
    assert lemmas(annotated.merge_noun_phrases(t)) == ["the", "new york", "vote", "7", "."]
    assert lemmas(annotated.merge_noun_phrases(annotated.merge_entities(t))) == ["the", "new york", "vote", "7", "."]
    merged = {r.lemma: r for r in annotated.merge_entities(t).collect()}["new york"]
    assert (merged.dep, merged.head, merged.idx) == ("nsubj", 3, 1)
    assert lemmas(spark.createDataFrame([], SCHEMA)) == []


def test_sn_tokens(spark):
    t = tokens_of(spark)
    grams = lambda **kw: {r.gram for r in annotated.sn_tokens(t, **kw).collect()}
    assert {"_the_york_vote", "_new_york", "_vote"} <= grams()
    assert {"_the_new york", "_new york_vote"} <= grams(merge="ent")
    assert "_DT_NNP_VBD" in grams(attribute="tag")
    assert "_nsubj" in grams(attribute="dep") and not any("ROOT" in g for g in grams(attribute="dep"))
    assert "new_york_voted".replace("voted", "vote") in grams(spanning=True)


def test_attribute_filter(spark):
    df = spark.createDataFrame([([("a", False, None), (",", True, False)],)], "t array<struct<text:string,is_punct:boolean,like_num:boolean>>")
    got = df.select(tokenizers.without_attributes(F.col("t"), ["is_punct", "like_num"]).alias("x")).first().x
    assert [t.text for t in got] == ["a"]


def test_spanning_tokens_are_shuffled_with_their_sentence_only(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc"), F.array_repeat(F.lit("w"), 20).alias("t")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t")).groupBy("doc").agg(F.min("t").alias("t"))
    rows = texts.select("doc", F.lit(0).alias("sent"), F.posexplode("t").alias("idx", "lemma")).withColumn("head", F.greatest(F.col("idx") - 1, F.lit(0)))
    grams = annotated.sn_tokens(rows, spanning=True)
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hash") == 1
    assert grams.columns == ["sent_id", "n", "gram"] and {r.n: r["count"] for r in grams.groupBy("n").count().collect()} == {1: 1000, 2: 950, 3: 900}
