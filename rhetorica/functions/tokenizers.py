"""Tokenizers on raw text as column expressions, and filters on token attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms whose full stop doesn't end a sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sen", "Gov", "Rep", "Gen", "Lt", "St", "vs", "No", "Jan", "Feb", "Aug", "Sept", "Oct", "Nov", "Dec", "etc"]
SHORT_FORM = r"(^|[\s(\"'])(" + "|".join(ABBREVIATIONS) + r"|[A-Z])\."
END_AND_SPACE = r"([.!?][\"')\]]*)\s+"


def white_space_tokens(c: Column) -> Column:
    """Pieces between white space; null for null."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_punct_tokens(c: Column, unicode: bool = False) -> Column:
    """Runs of word characters and runs of other characters that aren't white space."""
    if unicode:
        return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+"), F.lit(0))


def lower_words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def rule_sentences(c: Column) -> Column:
    """Sentences by rule: an end mark, closing quotes, white space; not after a short form or a single capital.

    Short forms are shielded by a private-use character before the text is split.
    """
    shielded = F.regexp_replace(c, SHORT_FORM, "$1$2\uE000")
    marked = F.regexp_replace(shielded, END_AND_SPACE, "$1\uE001")
    parts = F.transform(F.split(marked, "\uE001"), lambda x: F.replace(x, F.lit("\uE000"), F.lit(".")))
    return F.filter(parts, lambda x: F.trim(x) != "")


def delimited(tokens: Column) -> Column:
    """Tokens between sentence marks."""
    return F.concat(F.array(F.lit("<S>")), tokens, F.array(F.lit("</S>")))


def sentence_tokens(c: Column) -> Column:
    """Lower-case word and punctuation tokens of a sentence between sentence marks."""
    return delimited(word_punct_tokens(F.lower(c)))


def without_attributes(tokens: Column, attributes: list[str]) -> Column:
    """Array of token structs without those that have any of the attributes set."""
    drop = lambda t: sum((F.coalesce(t[a].cast("int"), F.lit(0)) for a in attributes), F.lit(0)) > 0
    return F.filter(tokens, lambda t: ~drop(t))
