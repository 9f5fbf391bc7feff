"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhetorica.sources.tables import table


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """(speaker, term, score) for all words of all speakers that labels name."""
    from rhetorica.llm import distinctive as op

    rows = op.labelled_sentences(table(spark, d, "clean_sents"), table(spark, d, "sent_labels"), table(spark, d, "speakers"))
    return op.scores(rows, "speaker", "sent").select(F.col("record").alias("speaker"), "term", F.round("score", 6).alias("score"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The five most characteristic words of each candidate."""
    from rhetorica.llm import distinctive as op

    speakers = table(spark, d, "speakers")
    rows = op.labelled_sentences(table(spark, d, "clean_sents"), table(spark, d, "sent_labels"), speakers)
    scored = op.scores(rows, "speaker", "sent")
    who = speakers.where("role = 'candidate'").select(F.col("speaker").alias("record")).distinct()
    return op.top_terms(scored.join(who, "record", "left_semi"), 5).select(F.col("record").alias("label"), "term")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every token and every number of word types."""
    from rhetorica.llm.frequency import processed_counts

    return processed_counts(table(spark, d, "processed"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every stored number of word types."""
    return p2_counts(spark, d).where("field = 'num_word_types'").select(F.col("term").alias("value"), "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).where("mark is not null").select("field", "term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from rhetorica.llm import forms

    rows = table(spark, d, "clean_sents")
    fold = forms.Folder(forms.collection_counts(rows, table(spark, d, "processed")))
    return forms.same_looking_pairs(rows, "row_id", "sent", fold).select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every sentence, one row per ``row_id``."""
    from rhetorica.llm import forms
    from rhetorica.llm.frequency import latest

    rows = table(spark, d, "clean_sents")
    fold = forms.Folder(forms.collection_counts(rows, table(spark, d, "processed")))
    return latest(rows, "row_id", ["sent"], "loaded_at").select(F.col("id").alias("row_id"), forms.consistent(F.col("sent"), fold).alias("form"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per sentence with its class of same-looking texts and its number of links in it."""
    from rhetorica.llm import forms

    rows = table(spark, d, "clean_sents")
    fold = forms.Folder(forms.collection_counts(rows, table(spark, d, "processed")))
    return forms.same_looking_classes(rows, "row_id", "sent", "loaded_at", fold).withColumnRenamed("id", "row_id")


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every token of every processed stretch, sentence marks included: one row
    per ``proc_id``, stored sentence and place in it, both from 1. A null token has a null form."""
    from rhetorica.llm import forms
    from rhetorica.llm.frequency import latest

    rows = table(spark, d, "processed")
    fold = forms.Folder(forms.collection_counts(table(spark, d, "clean_sents"), rows))
    sents = latest(rows, "proc_id", ["sents"], "loaded_at").select(F.col("id").alias("proc_id"), F.posexplode("sents").alias("sent_no", "sent"))
    tokens = sents.select("proc_id", (F.col("sent_no") + 1).alias("sent_no"), F.posexplode("sent").alias("token_no", "token"))
    return tokens.select("proc_id", "sent_no", (F.col("token_no") + 1).alias("token_no"), "token", forms.consistent(F.col("token"), fold).alias("form"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends inside the stored sentences and the processed stretches."""
    from rhetorica.llm.sentences import text_ends, token_ends

    return text_ends(table(spark, d, "clean_sents"), "row_id", "sent", "clean_sents").unionByName(token_ends(table(spark, d, "processed"), "proc_id", "sents", "processed"))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends inside the documents."""
    from rhetorica.llm.sentences import text_ends

    return text_ends(table(spark, d, "documents"), "doc_id", "text", "documents")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of English sentences of at least 22 different words."""
    from rhetorica.llm.neardup import near_duplicates

    rows = table(spark, d, "clean_sents").where("lang = 'en'")
    links = near_duplicates(rows, "row_id", "sent", threshold=0.78, least_words=22)
    return links.pairs().select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per sentence, of any language and length, with its class of equal word sets, its group
    and its number of links; a ``row_id`` whose text is null or holds no word has no row."""
    from rhetorica.llm.neardup import near_duplicates

    return near_duplicates(table(spark, d, "clean_sents"), "row_id", "sent", threshold=0.8, least_words=1).groups().withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_turns(spark, d).select("file_id", "turn_no", "speaker", "n_words")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The ordered turns of each transcript, with their clean text."""
    from rhetorica.llm.turns import speaker_turns

    return speaker_turns(table(spark, d, "transcripts"), table(spark, d, "speakers"))


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    """The speaker that each stored name of a processed stretch is a form of."""
    from rhetorica.llm.turns import named_speakers

    return named_speakers(table(spark, d, "processed"), "proc_id", "name", table(spark, d, "speakers")).withColumnRenamed("id", "proc_id")


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every stored sentence of the processed stretches, with their speaker."""
    from rhetorica.llm.turns import spoken_stretches

    return spoken_stretches(table(spark, d, "processed"), table(spark, d, "speakers"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, for every capacity."""
    from rhetorica.llm.packing import packed

    return packed(table(spark, d, "documents"), table(spark, d, "capacities"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused room by capacity."""
    from rhetorica.llm.packing import fill_report

    return fill_report(p7_packed(spark, d), table(spark, d, "capacities"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold a passage, with up to two words edited."""
    from rhetorica.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item: a window at edit distance 0, which any one table finds."""
    from rhetorica.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), most_edits=0).select("doc_id", "item_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict for every document, by a model trained on the reviewers' marks."""
    from rhetorica.llm import abuse

    docs = table(spark, d, "documents")
    model = abuse.train(abuse.labelled_texts(docs, table(spark, d, "doc_labels")))
    return abuse.scored(docs.select("doc_id", "source", "text"), model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("abusive and doc_id is not null").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of abusive documents by source."""
    from rhetorica.llm import abuse

    return abuse.rates(p9_scores(spark, d), "source")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL of the one query that needs neither consistent forms nor an iterative method; the others are
    compared with brute-force versions in the tests."""
    return {
        "p2_values": """WITH one AS (SELECT proc_id, arg_max(num_word_types, loaded_at) AS v FROM processed WHERE proc_id IS NOT NULL GROUP BY proc_id),
n AS (SELECT count(*) AS n FROM one), c AS (SELECT v, count(*) AS k FROM one WHERE v IS NOT NULL GROUP BY v)
SELECT v::VARCHAR AS value, k AS occurrences, k AS records, CASE WHEN k < 3 THEN 'rare' WHEN k > 0.04 * (SELECT n FROM n) THEN 'common' ELSE '' END AS mark FROM c"""
    }
