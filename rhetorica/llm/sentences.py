"""Sentence boundaries across languages and scripts (problem 5).

Method: a semi-Markov model over whole sentence spans. Places after closing marks (and, in scripts
without them, at spaces) are possible ends; dynamic programming picks the spans whose total score
is best. The score of a span joins its length, its opening words, its closing words and whether
its quotations and brackets are balanced.

Positions are those of the stored text: characters are only looked at in consistent form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhetorica.llm.forms import OTHER_INVISIBLE, VISIBLE_FORMATS, default_folder, script_of

# Words with a full stop after which a sentence goes on, by how firmly; in lower case.
TITLES_AND_KIN = set(
    "mr mrs ms dr prof sen gov rep gen lt col capt sgt maj adm rev hon st messrs fr pres supt vs v cf e.g i.e viz approx dept est fig figs vol pp ca "
    "sr sra srta dra ud uds ee.uu mm mme mlle mgr m "
    "hr fr frl z.b d.h u.a z.t bzw ggf vgl nr abs "
    "г ул т.е т.д т.п проф акад тов им стр рис см напр млн млрд тыс руб коп "
    "د أ डॉ श्री प्रो".split()
)
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec".split())
NUMBERED = set("no nos art sec ch p".split())  # with a number after them
CLOCK_ENDS = {"a.m", "p.m"}
COMPANY_ENDS = set("co inc corp ltd llc plc bros jr".split())
COUNTRY_LIKE = {"u.s", "u.k", "u.n", "e.u", "u.s.a", "d.c"}
# Words that don't open a sentence after a closing mark.
NEVER_OPEN = set(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "asked replied shouted said says answered added cried whispered wrote continued explained insisted "
    "sagte fragte rief meinte dit demanda dijo preguntó спросил сказал ответил спросила сказала ответила と って と言 januar februar märz mai juni juli oktober dezember".split()
)
NEVER_OPEN_AFTER_CLOCK = set("on near in at and or but with for to from before after until today tomorrow yesterday eastern pacific central est pst gmt".split())
GERMAN_BEFORE_ORDINAL = set("am im vom zum der dem den des die bis seit ab".split())
OPENERS = set("\"'“‘„«‹([{「『（【《¿¡")
CLOSERS = set("\"'”’“»›)]}」』）】》")
PAIRS = {")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《", "»": "«", "›": "‹"}
# Marks that end sentences. Full ones end nothing else; wide ones need no space after them.
FULL_STOPS = "!?。！？｡।॥؟۔։።፧။។៕།༎༏᠃꘎꛳"
STOPS = set(".…．" + FULL_STOPS)
WIDE_STOPS = set("。！？｡።፧။។៕།༎༏")
# Words that go on with a sentence after a space, in scripts that put spaces between clauses.
GOES_ON = ("และ", "หรือ", "แต่", "ที่", "ซึ่ง", "ว่า", "เพราะ", "โดย", "เพื่อ", "จึง", "กับ", "ແລະ", "ຫຼື", "ແຕ່", "ທີ່", "ເພາະ")
SHORT_CLAUSE = 6  # letters before a space between clauses, below which it rather parts a name or a list
_MARKS = "".join(STOPS | CLOSERS)
LONG = 60  # words from which the length of a span counts against it

_CLAUSES = re.compile(r"[\u0E00-\u0EFF]")  # Thai and Lao: spaces may end sentences


def _several(text: Column) -> Column:
    """Whether a text may hold two sentences: a stop before anything but closing marks, spaces and
    stops, or a script that ends sentences with spaces. Plain ASCII has a small pattern of its own."""
    escaped = lambda cps: "".join(f"\\x{{{ord(c):X}}}" for c in sorted(cps))
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x20000)}
    stops = {c for c, n in forms.items() if c in STOPS or STOPS.intersection(n)}
    wide = {c for c in stops if c in WIDE_STOPS or WIDE_STOPS.intersection(forms[c])}

    def pattern(keep) -> str:
        s, skip = escaped(filter(keep, stops)), r"\s\p{Z}\p{C}" + escaped(filter(keep, stops | CLOSERS))
        return rf"[{s}](?![0-9a-z])[{skip}]*+[^{skip}]"  # a stop before these is within a word

    skip = r"\s\p{Z}\p{C}" + escaped(stops | CLOSERS)
    beyond = rf"{pattern(lambda c: True)}|[{escaped(wide)}][{skip}]*+[^{skip}]|[\u0E00-\u0EFF]"
    return F.when(text.rlike(r"[^\x00-\x7F]"), text.rlike(beyond)).otherwise(text.rlike(pattern(str.isascii)))


def _glued(part: str, i: int) -> bool:
    """Whether a capital, or a letter of a script without case, follows at ``i``, after quotes and brackets."""
    while i < len(part) and (part[i] in CLOSERS or part[i] in OPENERS or part[i] == "\u200b"):
        i += 1
    return i < len(part) and part[i].isalpha() and not part[i].islower()


class _Same(dict):
    """translate() table that keeps positions: each character in consistent form if that is one
    character, U+200B where it is invisible, a plain space for every space."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if cp in OTHER_INVISIBLE or kind == "Cf" and cp not in VISIBLE_FORMATS:
            self[cp] = "​"
        elif kind in ("Zs", "Zl", "Zp") or ch.isspace():
            self[cp] = " "
        else:
            n = unicodedata.normalize("NFKC", ch)
            self[cp] = n if len(n) == 1 and ch not in STOPS else ch
        return self[cp]


_SAME = _Same()


@lru_cache(maxsize=200_000)
def _closing(word: str, prev: str) -> float:
    """Score of a span that ends with ``word``, closing quotes taken off; ``prev`` is the word before."""
    if not word:
        return -4.0
    last = word[-1]
    if last in FULL_STOPS:
        return 4.0
    if last == "…" or word.endswith(".."):
        return 0.5
    if last not in ".．":
        return -3.0
    core = word.rstrip(".．").lower()
    core = core.lstrip("".join(OPENERS))
    if not core.isascii() and script_of(core[:1]) == "LATIN":
        core = "".join(c for c in unicodedata.normalize("NFD", core) if not unicodedata.combining(c))
    if not core:
        return 4.0  # a stop that stands alone
    if core in CLOCK_ENDS:
        return 1.0
    if core in COMPANY_ENDS:
        return 2.0
    if core in COUNTRY_LIKE:
        return -0.5
    if core in TITLES_AND_KIN:
        return -7.0
    if core in MONTHS:
        return -4.0
    if core in NUMBERED:
        return 3.0 if prev.endswith(",") else -3.0
    if core == "etc":
        return -1.0
    if core.isdigit():
        return -6.0 if prev.lower() in GERMAN_BEFORE_ORDINAL else 3.0
    if len(core) == 1 and core.isalpha() and core != "i":
        return -7.0
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", core):
        return -3.0
    return 4.0


@lru_cache(maxsize=200_000)
def _opening(word: str, cased: bool, after_clock: bool) -> float:
    """Score of a span that opens with ``word``, opening quotes taken off."""
    if not word:
        return -4.0
    low = word.lower().strip(".,!?:;\"'”’»")
    if low in NEVER_OPEN or word[0] in "—–-,;:%":
        return -9.0
    if after_clock and low in NEVER_OPEN_AFTER_CLOCK:
        return -6.0
    if word[0] in STOPS or not word.strip(_MARKS):
        return -9.0
    if word[0] == "と":
        return -9.0
    if word[0].isdigit():
        return -1.0
    if cased and word[0].islower():
        return -8.0
    return 1.0


def _lexical(token: str) -> str:
    t = token.replace("​", "")
    return t if t.isascii() else default_folder()(t)


class Spans:
    """Scores spans between tokens; ``tokens`` as (word without quotes, its opening and closing marks)."""

    def __init__(self, tokens: list[str], cased: bool) -> None:
        self.cased, self.n = cased, len(tokens)
        self.core, self.tokens, self.open_by = [], tokens, []
        depth, quotes = 0, 0
        self.depth, self.quotes = [0], [0]
        for t in tokens:
            a, b = 0, len(t)
            while a < b and t[a] in OPENERS:
                a += 1
            while b > a and t[b - 1] in CLOSERS:
                b -= 1
            self.core.append(t[a:b] if b > a else "")
            for ch in t:
                if ch == '"':
                    quotes += 1
                elif ch in PAIRS or ch == "”":
                    depth -= 1
                elif ch in "([{「『（【《«‹":
                    depth += 1
                elif ch == "„":
                    depth += 1
                elif ch == "“":
                    depth += -1 if depth > 0 else 1
            self.depth.append(depth)
            self.quotes.append(quotes)

        self.before, self.after = [-1], [self.n] * (self.n + 1)  # last token with a word before, first one from a place on
        for k in range(self.n):
            self.before.append(k if self.core[k] else self.before[-1])
        for k in range(self.n - 1, -1, -1):
            self.after[k] = k if self.core[k] else self.after[k + 1]

    def opening(self, i: int) -> int:
        """Score, in hundredths, of a span that begins at token i."""
        if i == 0:
            return 0
        p, k = self.before[i], self.after[i]
        before = self.core[p].lower().rstrip(".") if p >= 0 else ""
        return round(100 * _opening(self.core[k] if k < self.n else "", self.cased, before in CLOCK_ENDS))

    def closing(self, i: int, j: int, bonus: float | None) -> int:
        """Score, in hundredths, of a span from token i that ends before token j."""
        k = self.before[j]
        if bonus is not None or j >= self.n:
            return round(100 * (bonus or 0.0))
        return round(100 * _closing(self.core[k], self.core[k - 1] if k > i else ""))

    def score(self, i: int, j: int, bonus: float | None) -> int:
        """Score, in hundredths, of the span of tokens i to j (without j)."""
        if self.before[j] < i:
            return -2000
        s = self.opening(i) + self.closing(i, j, bonus) - 100  # each span costs a little, so that doubtful ends don't count
        s -= 150 if j - i < 2 else 0
        s -= 2 * max(0, j - i - LONG)
        s -= 600 if self.depth[j] != self.depth[i] else 0
        s -= 600 if (self.quotes[j] - self.quotes[i]) % 2 else 0
        return s


def best_ends(spans: Spans, ends: list[int], bonus: dict[int, float]) -> list[int]:
    """The ends (token positions) of the best sequence of spans, the last one included.

    Every span between two possible ends counts, however far apart. What a span's score takes from
    its beginning doesn't depend on its end, but for the balance of marks and the length. So for
    each state of balance the best beginning is kept: of the last LONG words in a queue of falling
    values, and of all earlier ones, where each word costs the same, as one value. Only beginnings
    at the span's last word are scored one by one. Among equals the earliest beginning is taken.
    """
    points = [0, *ends] if ends and ends[-1] == spans.n else [0, *ends, spans.n]
    best, back = [0] * len(points), [0] * len(points)
    near: dict[tuple, deque] = {}  # state -> (value, beginning)
    far: dict[tuple, tuple[int, int]] = {}  # state -> (value and twice the place, minus the beginning)
    held = 0  # beginnings in the queues
    for b in range(1, len(points)):
        j = points[b]
        while held < b and points[held] < spans.before[j]:
            i = points[held]
            value, d, q = best[held] + spans.opening(i), spans.depth[i], spans.quotes[i] % 2
            for state in ((d, q), (d, None), (None, q), (None, None)):
                queue = near.setdefault(state, deque())
                while queue and queue[-1][0] < value:
                    queue.pop()
                queue.append((value, held))
            held += 1
        top = None
        if held:
            end = spans.closing(0 if spans.before[j] else j, j, bonus.get(j)) - 100
            d, q = spans.depth[j], spans.quotes[j] % 2
            for state, cost in (((d, q), 0), ((d, None), 600), ((None, q), 600), ((None, None), 1200)):
                queue = near.get(state)
                while queue and j - points[queue[0][1]] > LONG:
                    value, a = queue.popleft()
                    far[state] = max(far.get(state, (-(10**12), 0)), (value + 2 * points[a], -a))
                if queue:
                    top = max(top or (-(10**12), 0), (queue[0][0] + end - cost, -queue[0][1]))
                if state in far:
                    top = max(top or (-(10**12), 0), (far[state][0] - 2 * (j - LONG) + end - cost, far[state][1]))
        for a in range(held, b):
            s = (best[a] + spans.score(points[a], j, bonus.get(j)), -a)
            top = s if top is None else max(top, s)
        best[b], back[b] = top[0], -top[1]
    out, b = [], len(points) - 1
    while b:
        out.append(points[b])
        b = back[b]
    return out[::-1]


def _clause_end(left: str, right: str) -> float:
    """Score of a space between two clauses of a script without stops."""
    return -2.0 if right.startswith(GOES_ON) or len(left) < SHORT_CLAUSE else 3.0


def split_text(text: str | None) -> list[int]:
    """1-based positions, in code points, of the last character of each sentence that another one
    follows. Null, empty and blank texts have none."""
    if not text:
        return []
    same = text.translate(_SAME)
    tokens, stops, at, bonus, ends = [], [], 0, {}, []
    clauses = bool(_CLAUSES.search(same))
    for m in re.finditer(r"[^ ]+", same):
        part, start = m[0], m.start()
        cut = 0
        for i, ch in enumerate(part[:-1]):  # a stop within the piece: scripts without spaces, and sentences that are glued together
            if ch not in STOPS or i < cut:
                continue
            if ch in WIDE_STOPS or ch in "!?！？" and ord(part[i + 1]) > 0x2E80 or _glued(part, i + 1):
                e = i + 1
                while e < len(part) and (part[e] in CLOSERS or part[e] in STOPS):
                    e += 1
                if e < len(part):
                    tokens.append(part[cut:e])
                    stops.append(start + e)
                    cut = e
        tokens.append(part[cut:])
        stops.append(m.end())
    if len(tokens) < 2:
        return []
    words = [_lexical(t) for t in tokens]
    cased = any(c.isupper() for c in same)
    for k in range(len(words) - 1):
        w = words[k].rstrip("".join(CLOSERS))
        if w and w[-1] in STOPS:
            ends.append(k + 1)
        elif clauses and w and _CLAUSES.match(w[-1]) and _CLAUSES.match(words[k + 1][:1]):
            ends.append(k + 1)
            bonus[k + 1] = _clause_end(w, words[k + 1])
    if not ends:
        return []
    spans = Spans(words, cased)
    found = best_ends(spans, ends, bonus)[:-1]
    out = []
    for e in found:
        p = stops[e - 1]
        while p > 0 and same[p - 1] in " ​":  # invisible characters after the mark aren't part of the sentence
            p -= 1
        out.append(p)
    return out


def split_tokens(tokens: list[str]) -> list[int]:
    """Numbers of tokens up to the end of each sentence that another one follows, for lower-case
    tokens without reliable divisions."""
    if len(tokens) < 2:
        return []
    words = [_lexical(t) for t in tokens]
    ends, bonus = [], {}
    clauses = any(_CLAUSES.match(w[:1] or " ") for w in words)
    open_quote = False
    for k, w in enumerate(words):
        if w == '"':
            open_quote = not open_quote
        if k + 1 == len(words):
            break
        if not w:
            continue
        nxt = words[k + 1]
        core = w.rstrip(".")
        if w in STOPS or w[-1] in STOPS and len(w) > 1:
            if w in (".", "．") and nxt[:1].isdigit() and k and words[k - 1].isdigit() and (k < 2 or not words[k - 2][:1].isascii() or not words[k - 2].isalpha()) and _cjk(words, k):
                continue  # a decimal point in a script without spaces
            if w == "." and k >= 2 and words[k - 1].isdigit() and words[k - 2] in GERMAN_BEFORE_ORDINAL:
                ends.append(k + 1)
                bonus[k + 1] = -6.0
                continue
            if w == "..." or w == "…":
                ends.append(k + 1)
                bonus[k + 1] = -4.0 if nxt in ("but", "and", "or", "so") else -1.0
                continue
            ends.append(k + 1)
            if core in MONTHS or core in NUMBERED or core in TITLES_AND_KIN or core in COUNTRY_LIKE:
                bonus[k + 1] = -7.0
        elif w in CLOSERS and any(e == k for e in ends) or w in CLOSERS and k and words[k - 1] in STOPS:
            ends.append(k + 1)
            bonus[k + 1] = 4.0 if words[k - 1] in STOPS else 2.0
        elif clauses and _CLAUSES.match(w[-1]) and nxt and _CLAUSES.match(nxt[0]):
            ends.append(k + 1)
            bonus[k + 1] = _clause_end(w, nxt)
    if not ends:
        return []
    return best_ends(Spans(words, False), sorted(set(ends)), bonus)[:-1]


def _cjk(words: list[str], k: int) -> bool:
    near = "".join(words[max(0, k - 6) : k + 8])
    return any(ord(c) > 0x2E80 for c in near)


def _rows(df: DataFrame, id_col: str, value: str, split, kind: str) -> DataFrame:
    def build(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            ids, ends = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = split(v)
                ids += [i] * len(got)
                ends += got
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "end_at": pa.array(ends, pa.int64())})

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(value).alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(build, "id bigint, end_at bigint").distinct().select(F.lit(kind).alias("src"), "id", "end_at")


def text_ends(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(src, id, end_at) of each sentence end that another sentence follows in the same text.

    Repeated rows of an id give each end once. Texts that hold no stop before anything else, nor a
    script that ends sentences with spaces, have one sentence at most and aren't sent to Python.
    """
    return _rows(df.where(_several(F.col(text_col))), id_col, text_col, split_text, kind)


def token_ends(df: DataFrame, id_col: str, sents_col: str, kind: str) -> DataFrame:
    """(src, id, end_at) from stored token lists; ``<S>`` and ``</S>`` aren't counted and stored
    divisions aren't trusted. Null lists and null tokens hold nothing."""
    flat = F.filter(F.flatten(F.filter(sents_col, lambda s: s.isNotNull())), lambda t: t.isNotNull() & ~t.isin("<S>", "</S>"))
    return _rows(df.select(F.col(id_col), flat.alias("tokens")), id_col, "tokens", split_tokens, kind)
