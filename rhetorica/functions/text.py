"""String pipeline: substitutions, filters and presets as column expressions.

Each substitution maps a string column to a string column, each filter to a boolean column that is
true for texts to drop. ``Pipeline`` applies them in a fixed order: substitutions before the
filters, filters, substitutions after them, tokenizer, removal of empty tokens. Null texts and
texts that are empty at the end are dropped by ``Pipeline.apply``.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Substitution = str | tuple[str, str] | Callable[[Column], Column]
Filter = str | tuple[str, int] | Callable[[Column], Column]
DEFAULT_LENGTH = 3

# ASCII punctuation as a character class, the same in Java's and RE2's syntax.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _strip_markup(text: str) -> str:
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.parts)


def _over(function: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: function(x) if isinstance(x, str) else None)

    return run


def html_text(c: Column) -> Column:
    """Text nodes of markup, entities decoded."""
    return _over(_strip_markup)(c)


def html_tags_removed(c: Column) -> Column:
    """Tags removed by a pattern, without a parser; stays in the JVM."""
    return F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", "")


def html_entities(c: Column) -> Column:
    return _over(_html.unescape)(c)


def common_entities(c: Column) -> Column:
    """The five predefined entities and the non-breaking space; stays in the JVM."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def deaccent(c: Column) -> Column:
    """Compatibility decomposition without anything but ASCII."""
    return _over(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())(c)


def punctuation_to_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{PUNCTUATION}+", " ")


def white_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def brackets_removed(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[a-zA-Z ]*\]", "")


def spaced_ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, r"\.( \.)+", "...")


def long_ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{3,}", "...")


def ellipsis_bracket(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\.\. ?\[[a-zA-Z ]*\] ?\.\.\.", " ")


def add_punct(c: Column) -> Column:
    """A full stop behind texts that don't end in punctuation; empty texts stay empty."""
    return F.when((c == "") | c.rlike(f"{PUNCTUATION}$"), c).otherwise(F.concat(c, F.lit(".")))


def add_delimiters(c: Column) -> Column:
    return F.concat(F.lit("<S> "), c, F.lit(" </S>"))


def too_short(c: Column, k: int = DEFAULT_LENGTH) -> Column:
    return F.length(c) <= k


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def loose_ends(c: Column) -> Column:
    """True for a text that starts or ends with an ellipsis or a dash, and for an empty one."""
    return (c == "") | c.startswith("...") | c.startswith("-") | c.endswith("...") | c.endswith("-")


_SUBSTITUTIONS: dict[str, Callable[[Column], Column]] = {
    "html": html_text, "htmlentities": html_entities, "deaccent": deaccent, "punct": punctuation_to_space, "puncts": punctuation_to_space, "punctuation": punctuation_to_space,
    "lower": F.lower, "upper": F.upper, "whitespace": white_space, "strip": strip,
}
_FILTERS: dict[str, Callable[..., Column]] = {"length": too_short, "len": too_short, "short": too_short, "nonascii": non_ascii}


def _plain(name: str) -> str:
    return re.sub(r"[-_ ]", "", name.lower())


def substitution(spec: Substitution) -> Callable[[Column], Column]:
    """From a name, a (pattern, replacement) pair, a compiled pattern (removed), or a function.

    A string that isn't a known name raises ValueError.
    """
    if isinstance(spec, str):
        if _plain(spec) not in _SUBSTITUTIONS:
            raise ValueError(f"unknown substitution {spec!r}")
        return _SUBSTITUTIONS[_plain(spec)]
    if isinstance(spec, re.Pattern):
        return lambda c: F.regexp_replace(c, spec.pattern, "")
    if isinstance(spec, tuple):
        pattern, to = spec
        return lambda c: F.regexp_replace(c, getattr(pattern, "pattern", pattern), to)
    return spec


def text_filter(spec: Filter) -> Callable[[Column], Column]:
    """From a name, a ("length", k) pair, a compiled pattern, or a function."""
    if isinstance(spec, str):
        if _plain(spec) not in _FILTERS:
            raise ValueError(f"unknown filter {spec!r}")
        return _FILTERS[_plain(spec)]
    if isinstance(spec, re.Pattern):
        return lambda c: c.rlike(spec.pattern)
    if isinstance(spec, tuple):
        name, k = spec
        if _FILTERS.get(_plain(name)) is not too_short:
            raise ValueError(f"unknown filter {spec!r}")
        return lambda c: too_short(c, k)
    return spec


@dataclass
class Pipeline:
    """A cleaning pipeline; ``tokenizer`` maps the cleaned text to an array of tokens."""

    before: Sequence[Substitution] = ()
    filters: Sequence[Filter] = ()
    after: Sequence[Substitution] = ()
    tokenizer: Callable[[Column], Column] | None = None
    _made: tuple = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._made = ([substitution(s) for s in self.before], [text_filter(f) for f in self.filters], [substitution(s) for s in self.after])

    def __call__(self, c: Column) -> Column:
        """The cleaned text, '' where a filter holds; with a tokenizer its tokens, [] there."""
        before, filters, after = self._made
        for f in before:
            c = f(c)
        drop = F.lit(False)
        for f in filters:
            drop = drop | f(c)
        out = c
        for f in after:
            out = f(out)
        if self.tokenizer is None:
            return F.when(c.isNull() | drop, F.lit("")).otherwise(out)
        tokens = F.filter(self.tokenizer(out), lambda t: t != "")
        return F.when(c.isNull() | drop, F.array().cast("array<string>")).otherwise(tokens)

    def apply(self, df: DataFrame, column: str, into: str | None = None) -> DataFrame:
        """``df`` with the cleaned column, rows that are empty after cleaning left out."""
        into = into or column
        out = df.withColumn(into, self(F.col(column)))
        return out.where(F.size(into) > 0 if self.tokenizer else F.length(into) > 0)


def document_preset(tokenizer: Callable[[Column], Column] | None = None) -> Pipeline:
    """Whole texts: annotations in brackets removed, ellipses made alike, white space collapsed."""
    return Pipeline(before=[brackets_removed, spaced_ellipsis, long_ellipsis, white_space, strip], tokenizer=tokenizer)


def sentence_preset(tokenizer: Callable[[Column], Column] | None = None) -> Pipeline:
    """Sentences: white space collapsed; fragments that start or end in an ellipsis or a dash dropped."""
    return Pipeline(before=[white_space, strip], filters=[loose_ends], tokenizer=tokenizer)


def request_preset(tokenizer: Callable[[Column], Column] | None = None) -> Pipeline:
    """Text from a request: markup and accents removed, a final stop added."""
    return Pipeline(before=["html", white_space, strip, "deaccent", add_punct], tokenizer=tokenizer)


def notebook_preset(least: int = 49) -> Pipeline:
    """Long sentences for the bag-of-words models."""
    return Pipeline(before=[ellipsis_bracket, brackets_removed, spaced_ellipsis, white_space, strip], filters=[("length", least), loose_ends])
