"""Inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhetorica.functions import tokenizers
from rhetorica.operators import transcripts as tr
from rhetorica.sources.tables import table

LABEL_SQL = tr.LABEL.replace("'", "''")
WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
PUNCT_SQL = r"regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+')"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, raw), every file once."""
    return table(spark, d, "transcripts").where("file_id is not null and raw is not null").groupBy("file_id").agg(F.min("raw").alias("raw"))


FILES_SQL = "files AS (SELECT file_id, min(raw) AS raw FROM transcripts WHERE file_id IS NOT NULL AND raw IS NOT NULL GROUP BY file_id)"
UTTS_SQL = rf"""{FILES_SQL},
parts AS (SELECT file_id, string_split(regexp_replace(raw, '(?m)^({LABEL_SQL})', chr(1) || '\1', 'g'), chr(1)) AS p FROM files),
pieces AS (SELECT file_id, unnest(range(1, len(p)))::INT AS utt_id, unnest(p[2:]) AS part FROM parts),
utts AS (SELECT file_id, utt_id, regexp_extract(part, '^{LABEL_SQL}') AS label, trim(regexp_extract(part, '^{LABEL_SQL}'), ' :[]') AS speaker,
  substr(part, length(regexp_extract(part, '^{LABEL_SQL}')) + 1) AS text FROM pieces)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, sent, lang), every row once, without null texts."""
    return table(spark, d, "clean_sents").where("row_id is not null and sent is not null").groupBy("row_id").agg(F.min("sent").alias("sent"), F.min("lang").alias("lang"))


SENTS_SQL = "sents AS (SELECT row_id, min(sent) AS sent, min(lang) AS lang FROM clean_sents WHERE row_id IS NOT NULL AND sent IS NOT NULL GROUP BY row_id)"


def speech(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, speaker, sent, lang): sentences whose label names a speaker."""
    labels = table(spark, d, "sent_labels").where("row_id is not null and label is not null").groupBy("row_id").agg(F.min(F.upper(tr.clean_label(F.col("label")))).alias("speaker"))
    known = table(spark, d, "speakers").select("speaker").distinct()
    return sentences(spark, d).join(labels.join(known, "speaker", "left_semi"), "row_id")


SPEECH_SQL = f"""{SENTS_SQL},
labels AS (SELECT row_id, min(upper(trim(label, ' :[]'))) AS speaker FROM sent_labels WHERE row_id IS NOT NULL AND label IS NOT NULL GROUP BY row_id),
speech AS (SELECT row_id, speaker, sent, lang FROM sents JOIN labels USING (row_id) WHERE speaker IN (SELECT speaker FROM speakers))"""


def spoken_words(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, speaker, tokens)."""
    return speech(spark, d).select("row_id", "speaker", tokenizers.lower_words(F.col("sent")).alias("tokens"))


WORDS_OF_SPEECH_SQL = f"{SPEECH_SQL},\nspoken AS (SELECT row_id, speaker, {WORDS_SQL.format('sent')} AS t FROM speech)"


def stretches(spark: SparkSession, d: str) -> DataFrame:
    """(doc, name, tokens): the tokens of each processed stretch, without sentence marks."""
    one = table(spark, d, "processed").where("proc_id is not null and sents is not null").groupBy("proc_id").agg(F.min("sents").alias("sents"), F.min("name").alias("name"))
    return one.select(F.col("proc_id").alias("doc"), "name", F.filter(F.flatten("sents"), lambda t: ~t.isin("<S>", "</S>")).alias("tokens"))


STRETCHES_SQL = """one AS (SELECT proc_id, min(sents) AS sents, min(name) AS name FROM processed WHERE proc_id IS NOT NULL AND sents IS NOT NULL GROUP BY proc_id),
stretches AS (SELECT proc_id AS doc, name, list_filter(flatten(sents), lambda t: t NOT IN ('<S>', '</S>')) AS t FROM one)"""
