"""One consistent form for text that looks the same (problem 3).

Method: strings and code points that look alike are joined by union-find into transitive classes:
listed letters of different scripts, compatibility forms and what they stand for (ligatures,
full-width and half-width forms, mathematical letters), and letters with marks, whose look-alikes
are those of the letter with the same marks, composed or not. Each class has, for every script, a
representative chosen by how often the members occur in the collection; words that mix scripts are
rewritten greedily, in the characters as stored, by an automaton over all patterns of the classes.

The consistent form of a text is NFKC without invisible characters, with plain spaces and with
every word in one script. Accents, case, dashes and quotation marks that look different stay
different. Null stays null and an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of other scripts that look like a Latin letter, as "Latin letter: look-alikes".
LOOK_ALIKES = """
a: а α
b: Ь
c: с ϲ
d: ԁ
e: е
g: ց
h: һ հ
i: і ι ı
j: ј ϳ
k: к κ
l: ӏ
m: м
n: ո
o: о ο օ
p: р ρ
q: ԛ
s: ѕ
t: т τ
u: υ ս
v: ѵ ν
w: ԝ
x: х χ
y: у γ
A: А Α
B: В Β
C: С Ϲ
E: Е Ε
F: Ϝ
G: Ԍ
H: Н Η
I: І Ι Ӏ
J: Ј Ϳ
K: К Κ
M: М Μ
N: Ν
O: О Ο Օ
P: Р Ρ
Q: Ԛ
S: Ѕ Տ
T: Т Τ
U: Ս
V: Ѵ
W: Ԝ
X: Х Χ
Y: У Υ Ү
Z: Ζ
"""
# Format characters (category Cf) that are visible, and invisible ones of other categories.
VISIBLE_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
OTHER_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

WORD = re.compile(r"[^\W_]+")
# Runs of letters and marks that aren't all of ASCII.
_LETTER_RUN = re.compile(r"(?<![A-Za-z])[A-Za-z]*+(?:[^\W\d_A-Za-z]|[\u0300-\u036f])[^\W\d_]*(?:[\u0300-\u036f]+[^\W\d_]*)*")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def root(self, s: str) -> str:
        self.parent.setdefault(s, s)
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def join(self, a: str, b: str) -> None:
        x, y = sorted((self.root(a), self.root(b)))
        self.parent[y] = x

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for s in sorted(self.parent):
            out.setdefault(self.root(s), []).append(s)
        return list(out.values())


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """The script of a letter by its Unicode name; digits and marks belong to every script ('')."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    first = name.split(" ", 1)[0]
    if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "BOPOMOFO"):
        return "CJK"
    return "LATIN" if first in ("FEMININE", "MASCULINE") else first


def look_alike_pairs() -> list[tuple[str, str]]:
    return [(left.strip(), x) for line in LOOK_ALIKES.strip().splitlines() for left, right in [line.split(":")] for x in right.split()]


@lru_cache(maxsize=1)
def composed() -> list[tuple[str, str]]:
    """(character, letters and marks it decomposes into) for the letters that have a decomposition."""
    out = []
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        if ch.isalpha():
            d = unicodedata.normalize("NFKD", ch)
            if d != ch and not "\uac00" <= ch <= "\ud7a3":  # Hangul syllables are made of Hangul only
                out.append((ch, d))
    return out


@lru_cache(maxsize=1)
def basic_classes() -> list[list[str]]:
    """The classes that don't depend on a collection."""
    listed = Classes()
    for a, b in look_alike_pairs():
        listed.join(a, b)
    alike = {s: group for group in listed.groups() for s in group}
    classes = Classes()
    for a, b in look_alike_pairs():
        classes.join(a, b)
    nfc = lambda s: unicodedata.normalize("NFC", s)
    for ch, d in composed():
        if any(c in alike for c in d):
            classes.join(ch, nfc(d))
            if d[0] in alike and len(d) > 1 and all(unicodedata.combining(c) for c in d[1:]):
                for x in alike[d[0]]:
                    classes.join(nfc(d), x + d[1:])
                    classes.join(nfc(d), nfc(x + d[1:]))
    return classes.groups()


class Folder:
    """Brings text to its consistent form.

    counts: occurrences of code points in the collection, for the choice of representatives;
    without counts the lowest code point of a script represents it. A string of several code
    points counts as often as its rarest one.
    """

    def __init__(self, counts: dict[str, int] | None = None) -> None:
        self.counts = counts or {}
        often = lambda s: min(self.counts.get(c, 0) for c in s)
        letters: dict[str, dict[str, str]] = {}  # script -> letter of another script -> representative
        self.members: dict[str, dict[str, str]] = {}  # member -> script -> representative
        patterns: dict[str, dict[str, str]] = {}  # script -> string as stored -> representative
        for group in basic_classes():
            stable = [s for s in group if unicodedata.normalize("NFKC", s) == s and script_of(s[0]) and all(unicodedata.combining(c) for c in s[1:])]
            best: dict[str, str] = {}
            for s in sorted(stable, key=lambda x: (-often(x), len(x), x)):
                best.setdefault(script_of(s[0]), s)
            for s in group:
                self.members[s] = best
                for script, to in best.items():
                    if s != to and script_of(s[0]) != script:
                        patterns.setdefault(script, {})[s] = to
                        if len(s) == 1:
                            letters.setdefault(script, {})[s] = to
        for ch, d in composed():  # a character that stands for several letters is rewritten letter by letter
            for script, to in letters.items():
                if ch not in patterns[script] and any(c in to for c in d):
                    patterns[script][ch] = unicodedata.normalize("NFC", "".join(to.get(c, c) for c in d))
        self.automata: dict[str, ahocorasick.Automaton] = {}
        for script, table in patterns.items():
            a = ahocorasick.Automaton()
            for s, to in table.items():
                a.add_word(s, (len(s), to))
            a.make_automaton()
            self.automata[script] = a
        self._weights: Counter = Counter()
        for c, n in self.counts.items():
            self._weights[script_of(c)] += n
        self._words: dict[str, str] = {}
        self._drop: dict[int, int | str | None] = _Invisible()

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.__init__(state["counts"])

    def word(self, w: str) -> str:
        """A word in one script: that of most of its letters that can be read in one script only,
        else that of most letters, else the one that is more frequent in the collection."""
        done = self._words.get(w)
        if done is not None:
            return done
        parts = unicodedata.normalize("NFKD", w)
        scripts = Counter(s for s in map(script_of, parts) if s)
        out = w
        if len(scripts) > 1:
            fixed = Counter(script_of(c) for c in parts if script_of(c) and c not in self.members)
            options = sorted(scripts, key=lambda s: (-fixed[s], -scripts[s], -self._weight(s), s))
            auto = self.automata.get(options[0])
            if auto is not None:
                pieces, at = [], 0
                for end, (n, to) in auto.iter_long(w):
                    pieces += [w[at : end - n + 1], to]
                    at = end + 1
                out = "".join([*pieces, w[at:]])
        if len(self._words) < 200_000:
            self._words[w] = out
        return out

    def _weight(self, script: str) -> int:
        return self._weights[script] if self.counts else int(script == "LATIN")

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        t = text.translate(self._drop)
        if not t.isascii():
            t = unicodedata.normalize("NFKC", _LETTER_RUN.sub(lambda m: self.word(m[0]), t))
        return t


class _Invisible(dict):
    """translate() table made as code points turn up: invisible ones go, odd spaces become plain,
    compatibility forms of anything but letters become what they stand for."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        gone = cp in OTHER_INVISIBLE or kind == "Cf" and cp not in VISIBLE_FORMATS
        n = unicodedata.normalize("NFKC", ch)
        letters = ch.isalpha() and all(c.isalpha() or "\u0300" <= c <= "\u036f" for c in n)
        self[cp] = None if gone else 32 if kind == "Zs" else cp if letters or n == ch else n
        return self[cp]


@lru_cache(maxsize=1)
def default_folder() -> Folder:
    return Folder()


def words(text: str | None, folder: Folder | None = None) -> list[str]:
    """Runs of letters and digits in consistent form, lower-cased."""
    return WORD.findall((folder or default_folder())(text).lower()) if text else []


def code_point_counts(df: DataFrame, column: str) -> dict[str, int]:
    """Occurrences of each code point in all rows.

    The result is bounded by the number of Unicode code points, whatever the size of the table;
    counts are merged per partition before the shuffle.
    """
    import numpy as np

    def count(batches: Iterable[pa.RecordBatch]):
        total: Counter = Counter()
        ascii_only = np.zeros(128, np.int64)
        for b in batches:
            text = "".join(x for x in b.column(0).to_pylist() if x).encode()
            raw = np.frombuffer(text, np.uint8)
            ascii_only += np.bincount(raw, minlength=256)[:128]
            rest = raw[raw >= 128]  # whole characters: theirs are the only bytes from 128
            if len(rest):
                cps, n = np.unique(np.frombuffer(rest.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), return_counts=True)
                total.update(dict(zip(cps.tolist(), n.tolist())))
        total.update({c: n for c, n in enumerate(ascii_only.tolist()) if n})
        yield pa.RecordBatch.from_pydict({"cp": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    rows = (
        df.select(F.col(column).alias("s")).where(F.col("s").isNotNull())
        .mapInArrow(count, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    )
    return {chr(r.cp): r.n for r in rows}


def collection_counts(sents: DataFrame, processed: DataFrame) -> dict[str, int]:
    """Occurrences of each code point in the sentences and in the tokens of the processed stretches."""
    tokens = processed.select(F.array_join(F.flatten(F.filter("sents", lambda s: s.isNotNull())), "").alias("s"))
    return code_point_counts(sents.select(F.col("sent").alias("s")).unionByName(tokens), "s")


def consistent(column: Column, folder: Folder | None = None) -> Column:
    """The consistent form of a string column."""
    fold = folder or default_folder()

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fold(x) if isinstance(x, str) else None)

    return form(column)


def same_looking_pairs(df: DataFrame, id_col: str, text_col: str, folder: Folder | None = None) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of ids whose texts differ as stored and are equal in consistent form.

    Ids that occur several times count once per text; null texts take part in no pair and empty
    ones equal only texts that are empty in consistent form. Pairs are made between the distinct
    stored variants of a form first and only then opened into ids, so copies of one text are never
    compared with each other: the work follows the size of the result.
    """
    from rhetorica.sources.tables import stored

    t = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    # Every pair holds at least one row whose stored text isn't its own form, and such rows hold more than ASCII.
    other = t.where(F.col("t").rlike(r"[^\x00-\x7F]")).withColumn("f", consistent(F.col("t"), folder))
    hashed = lambda c: [F.xxhash64(c).alias("f1"), F.xxhash64(F.lit("second"), F.col(c)).alias("f2")]
    odd = other.select("id", *hashed("f"), F.xxhash64("t").alias("v"), (F.col("t") != F.col("f")).alias("changed"))
    odd = stored(odd.distinct(), "forms")
    plain = t.where(~F.col("t").rlike(r"[^\x00-\x7F]")).select("id", *hashed("t"), F.xxhash64("t").alias("v"))
    wanted = odd.where("changed").select("f1", "f2").distinct()
    plain = plain.join(wanted, ["f1", "f2"], "left_semi").distinct()
    rows = stored(plain.unionByName(odd.drop("changed").join(wanted, ["f1", "f2"], "left_semi")), "form-rows")
    variants = rows.select("f1", "f2", "v").distinct()
    pairs = variants.alias("x").join(variants.alias("y"), ["f1", "f2"]).where("x.v < y.v").select("f1", "f2", F.col("x.v").alias("va"), F.col("y.v").alias("vb"))
    a = rows.select("f1", "f2", F.col("v").alias("va"), F.col("id").alias("ia"))
    b = rows.select("f1", "f2", F.col("v").alias("vb"), F.col("id").alias("ib"))
    return (
        pairs.join(a, ["f1", "f2", "va"]).join(b, ["f1", "f2", "vb"]).where("ia <> ib")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
    )


def same_looking_classes(df: DataFrame, id_col: str, text_col: str, order_col: str, folder: Folder | None = None) -> DataFrame:
    """(id, class_id, variant_id, links): one row per id, with the least id of its class (equal in
    consistent form) and of its variant (equal as stored), and the number of ids of the class whose
    text differs as stored.

    The latest delivery of an id counts; ids with a null text have no row.
    """
    from rhetorica.llm.frequency import latest
    from rhetorica.sources.tables import stored

    one = latest(df.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, [text_col], order_col).where(F.col(text_col).isNotNull())
    odd = F.col(text_col).rlike(r"[^\x00-\x7F]")
    formed = one.where(odd).select("id", F.col(text_col).alias("t"), consistent(F.col(text_col), folder).alias("f")).unionByName(one.where(~odd).select("id", F.col(text_col).alias("t"), F.col(text_col).alias("f")))
    rows = stored(formed.select("id", F.xxhash64("f").alias("f1"), F.xxhash64(F.lit("second"), "f").alias("f2"), F.xxhash64("t").alias("v")), "form-classes")
    variants = rows.groupBy("f1", "f2", "v").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("variant_id"))
    classes = variants.groupBy("f1", "f2").agg(F.sum("own").alias("every"), F.min("variant_id").alias("class_id"), F.count(F.lit(1)).alias("variants"))
    several = variants.join(classes.where("variants > 1"), ["f1", "f2"]).select("f1", "f2", "v", "class_id", "variant_id", (F.col("every") - F.col("own")).alias("links"))
    alone = variants.join(classes.where("variants = 1"), ["f1", "f2"], "left_semi").select("f1", "f2", "v", F.col("variant_id").alias("class_id"), "variant_id", F.lit(0).cast("bigint").alias("links"))
    return rows.join(several.unionByName(alone), ["f1", "f2", "v"]).select("id", "class_id", "variant_id", "links")
