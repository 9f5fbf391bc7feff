"""Labelled transcripts as tables: labels, speakers, utterances, words and sentences.

A label stands at the start of a line: an optional bracket, capitals with spaces and marks, an
optional bracket, colons. Text before the first label belongs to no utterance; nothing else is lost.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhetorica.functions import tokenizers

LABEL = r"\[?[A-Z :\-?_]+\]?:+"
_CUT = "\x01"


def clean_label(c: Column) -> Column:
    """A label without blanks, colons and brackets at its ends."""
    return F.btrim(c, F.lit(" :[]"))


def raw_labels(transcripts: DataFrame) -> DataFrame:
    """(label): the different labels as they stand in the texts."""
    return transcripts.select(F.explode(F.regexp_extract_all("raw", F.lit(f"(?md)^{LABEL}"), F.lit(0))).alias("label")).distinct()


def speakers(transcripts: DataFrame) -> DataFrame:
    """(speaker): the different cleaned labels."""
    return raw_labels(transcripts).select(clean_label(F.col("label")).alias("speaker")).distinct()


def utterances(transcripts: DataFrame, only: str | Sequence[str] | None = None) -> DataFrame:
    """(file_id, utt_id, label, speaker, text) in file order, numbered from 1; optionally of some
    speakers only, whose names are compared after cleaning and upper-casing.

    Null and unlabelled texts have no utterances.
    """
    parts = F.split(F.regexp_replace("raw", f"(?md)^({LABEL})", f"{_CUT}$1"), _CUT)
    rows = transcripts.select("file_id", F.posexplode_outer(parts).alias("utt_id", "part")).where("utt_id > 0")
    label = F.regexp_extract("part", f"^{LABEL}", 0)
    out = rows.select("file_id", "utt_id", label.alias("label"), F.substring("part", F.length(label) + 1, F.length("part")).alias("text"))
    out = out.select("file_id", "utt_id", "label", clean_label(F.col("label")).alias("speaker"), "text")
    names = speaker_names(only)
    return out if names is None else out.where(F.col("speaker").isin(names))


def speaker_names(only: str | Sequence[str] | None) -> list[str] | None:
    """Cleaned upper-case names; None means all. Anything but a string or a list of strings raises TypeError."""
    if only is None:
        return None
    names = [only] if isinstance(only, str) else only
    if not isinstance(names, (list, tuple)) or not all(isinstance(n, str) for n in names):
        raise TypeError("speakers: a name, a list of names or None")
    return [n.strip(" :[]").upper() for n in names]


def label_pattern(names: Sequence[str]) -> str:
    """Pattern of raw labels of the names, stray marks tolerated."""
    return r"^\[?(?:" + "|".join(re.escape(n) for n in names) + r")[ :\-?_]*\]?:+$"


def matching(utts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Utterances whose raw label is a form of one of the names."""
    return utts.where(F.col("label").rlike(label_pattern(names)))


def words(utts: DataFrame, tokenizer=tokenizers.word_punct_tokens) -> DataFrame:
    """(file_id, utt_id, speaker, pos, token) of each utterance."""
    return utts.select("file_id", "utt_id", "speaker", F.posexplode_outer(tokenizer(F.col("text"))).alias("pos", "token")).where("token is not null")


def sentences(utts: DataFrame, splitter=tokenizers.rule_sentences, tokenizer=tokenizers.word_punct_tokens) -> DataFrame:
    """(file_id, utt_id, speaker, sent_id, tokens), sentences without tokens left out."""
    rows = utts.select("file_id", "utt_id", "speaker", F.posexplode_outer(splitter(F.col("text"))).alias("sent_id", "sent")).where("sent is not null")
    return rows.select("file_id", "utt_id", "speaker", "sent_id", tokenizer(F.col("sent")).alias("tokens")).where(F.size("tokens") > 0)


def grouped_text(utts: DataFrame) -> DataFrame:
    """(file_id, speaker, text): all text of a speaker within a file, in order.

    A group is one speaker in one file, so its size is bounded by the file that already was a row.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("utt_id", "text"))), lambda x: x["text"])
    return utts.groupBy("file_id", "speaker").agg(F.array_join(ordered, "").alias("text"))


def grouped_sentences(utts: DataFrame, splitter=tokenizers.rule_sentences, tokenizer=tokenizers.word_punct_tokens) -> DataFrame:
    """(file_id, speaker, sent_id, tokens); sentences may cross interruptions."""
    rows = grouped_text(utts).select("file_id", "speaker", F.posexplode_outer(splitter(F.col("text"))).alias("sent_id", "sent")).where("sent is not null")
    return rows.select("file_id", "speaker", "sent_id", tokenizer(F.col("sent")).alias("tokens")).where(F.size("tokens") > 0)
