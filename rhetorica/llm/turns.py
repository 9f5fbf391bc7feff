"""Speech transcripts into clean, ordered speaker turns (problem 4).

Method: the lines of a transcript are turned into tokens (clock time, number, mark, word) and
grouped by a fixed-depth token tree into line templates. Each template is searched for its slots:
what precedes the speaker slot (clock times, arrows, words that all its lines share), and the mark,
clock time or line end that closes it. A closing mark is proposed by a template if known speakers
fill the slot before it; templates that propose the same slots are one layout, a file may have
several, and a layout counts if it is a fair part of the file's strongest one. Templates of clock
times only are cues. Lines whose slot names a speaker start a piece, other lines continue it;
pieces are ordered by clock time where the file has them, cleaned, and adjoining pieces of one
speaker merged.

A label is a form of a speaker: the listed name, surname or full name in either order, with or
without titles, initials, notes in brackets and stray marks, with at most one slip (a letter
missing, added, changed or two exchanged).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetorica.llm.forms import default_folder

CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
# Beginnings of words that name a sound, and words that may stand beside one in round brackets;
# titles; words for members of the audience.
SOUNDS = "laugh applau cheer boo clap chant crosstalk inaudibl unintelligibl indistinct shout yell scream bell ring music pause pausing silen cough sigh gasp groan murmur whistl sneez sniff cr(?:y|ies|ied) noise chuckl giggl buzz overlap mic(?:rophone)?$".split()
BESIDE = "audience audiences member members crowd crowds he she they it someone man woman men women people and or the a an in on off of from by to long short brief loud loudly soft softly quiet quietly more some continues continue continued continuing begins ends starts stops again cross talk talking over background foreign speaking speaks plays playing clears throat voice voices".split()
TITLES = "mr mrs ms miss dr prof professor sen senator gov governor rep representative congressman congresswoman president vice secretary mayor sir madam moderator gen lt".split()
CROWD = "audience member members crowd".split()

_WORD = r"[^\W\d_]+(?:['’.-][^\W\d_]+)*"
_TOKEN = re.compile(rf"{CLOCK}|-->|>>+|<v\b(?:\.[\w.]+)?|\d+|{_WORD}(?: +{_WORD})*|\t|\S")  # a run of words is one token
_TIME = re.compile(CLOCK)
_BEFORE = re.compile(rf"(?:\s*(?:[(\[]?(?P<at>{CLOCK})[)\]]?|>>+|<v\b(?:\.[\w.]+)?|\d+[.)](?=\s)|[-–—|•]))*\s*")
_NOTE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*\n]+\*|♪[^♪\n]*♪|♪")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?")
_HESITATION = re.compile(r"u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|uh-?huh|uh-?uh|mm+-?h+m+|mhm|ahem")
_SOUND = re.compile(f"(?:{'|'.join(SOUNDS)})")
DEPTH = 4  # tokens after what precedes the speaker slot, by which lines are grouped
PURE = 0.2  # share of a template's slots that known speakers fill, from which it proposes them
FAIR = 0.25  # share of the hits of the strongest layout, from which another one counts
CONSTANT = 3  # lines of a template from which shared first words aren't by chance
END, AT = "<end>", "<time>"
_NO_CLOSING = set("([{<'\"“‘„«")


class TokenTree:
    """Lines grouped by the kinds of what precedes the first word and of the ``depth`` tokens from there on."""

    def __init__(self, depth: int = DEPTH) -> None:
        self.depth, self.root, self.lines = depth, {}, defaultdict(list)

    @staticmethod
    def kind(token: str) -> str:
        if ":" in token and _TIME.fullmatch(token):
            return AT
        if token.isdigit():
            return "<number>"
        return "<word>" if token[0].isalpha() else token

    def add(self, number: int, line: str) -> tuple:
        before = _BEFORE.match(line).end()
        path = [_TIME.sub(AT, line[:before]).strip()]
        for m in _TOKEN.finditer(line, before):
            k = self.kind(m[0])
            if k == "<word>" == path[-1] and len(path) > 1:
                continue
            if len(path) > self.depth:
                break
            path.append(k)
        else:
            path.append(END)
        node = self.root
        for k in path:
            node = node.setdefault(k, {})
        leaf = node.setdefault("", tuple(path))
        self.lines[leaf].append(number)
        return leaf


class Slots:
    """Where a layout has its speaker: after ``lead`` (words that all lines share, mostly none), up to ``closing``."""

    def __init__(self, lead: str, closing: str) -> None:
        self.lead, self.closing = lead, closing
        if closing in "-–—":
            mark = r"(?<=\s)[-–—]+(?=\s)"
        else:
            mark = f"(?:{re.escape(closing)})+"
        self._mark = re.compile(rf"(?P<at>{CLOCK})|(?P<mark>{mark})")

    def read(self, line: str) -> tuple[str, str | None, str] | None:
        """(label, clock time, text) of a line; None if it has no such slot."""
        if self.closing != END and (":" if self.closing == AT else self.closing) not in line:
            return None
        m = _BEFORE.match(line)
        start, at = m.end(), m["at"]
        if self.lead:
            if not line.startswith(self.lead, start):
                return None
            m = _BEFORE.match(line, start + len(self.lead))
            start, at = m.end(), m["at"] or at
        if self.closing == END:
            return line[start:], at, ""
        for m in self._mark.finditer(line, start):
            if m["mark"] and self.closing != AT:
                return line[start : m.start()], at, line[m.end() :]
            if m["at"] and self.closing == AT:
                return line[start : m.start()].rstrip(" \t([-–—:"), m["at"], line[m.end() :].lstrip(")]")
            at = m["at"] or at
        return None


def seconds(clock: str) -> float:
    parts = [float(x) for x in clock.replace(",", ".").split(":")]
    total = 0.0
    for x in parts:
        total = total * 60 + x
    return total


def within_one_slip(a: str, b: str) -> bool:
    """At most one letter missing, added or changed, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


class Roster:
    """Finds the speaker that a label is a form of.

    speakers: (speaker, full_name, role, title) rows; nulls are allowed in all but the first.
    """

    def __init__(self, speakers: Iterable[tuple]) -> None:
        self.forms: dict[str, set[str]] = defaultdict(set)
        self.titles = set(TITLES)
        self.by_title: dict[tuple[str, str], set[str]] = defaultdict(set)
        self.audience = set()
        for speaker, full, role, title in speakers:
            if not speaker:
                continue
            own = self._letters(speaker)
            self.forms[" ".join(own)].add(speaker)
            if role == "audience":
                self.audience.add(speaker)
            names = self._letters(full or "")
            if title:
                self.titles.update(self._letters(title))
            if names:
                first, last = names[0], names[-1]
                for f in (" ".join(names), f"{last} {' '.join(names[:-1])}", f"{first[0]} {last}", f"{last} {first[0]}", last):
                    self.forms[f.strip()].add(speaker)
                for t in self._letters(title or ""):
                    self.by_title[t, last].add(speaker)
        self._known: dict[str, str | None] = {}
        self.most_words = max((f.count(" ") + 1 for f in self.forms), default=0) + 1  # a slip may split a word
        self.shorter: dict[str, list[str]] = defaultdict(list)  # forms by themselves with a letter left out
        for f in self.forms:
            if len(f) >= 4:
                for x in self._variants(f):
                    self.shorter[x].append(f)

    @staticmethod
    def _variants(s: str) -> set[str]:
        return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}

    @staticmethod
    def _letters(s: str) -> list[str]:
        return re.findall(r"[^\W\d_]+", s.lower())

    def find(self, label: str | None) -> str | None:
        """The one speaker whose form the label is, else None."""
        if not label:
            return None
        if label not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[label] = self._find(default_folder()(label))
        return self._known[label]

    def _find(self, label: str) -> str | None:
        m = re.fullmatch(r"\s*\[([^\[\]]*)\]\s*(.*)", label)
        if m:
            label = f"{m[1]} {m[2]}"
        label = _NOTE.sub(" ", label)
        if re.search(r"[\d;!]", label):
            return None
        names = self._letters(label)
        given = [x for x in names if x in self.titles]
        if not names:
            return None
        for crowd in self.audience:
            if set(names) & {"audience", *self._letters(crowd)} and set(names) <= {*CROWD, *self._letters(crowd)}:
                return crowd
        rest = [x for x in names if x not in self.titles] or names
        if len(rest) > self.most_words:
            return None
        text = " ".join(rest)
        exact = self.forms.get(text)
        if exact:
            if len(exact) == 1:
                return next(iter(exact))
            titled = {s for t in given for s in self.by_title.get((t, rest[-1]), ())} & exact
            return next(iter(titled)) if len(titled) == 1 else None
        if len(text) < 4:
            return None
        # texts within one slip of each other have a variant in common
        close = [self.forms[form] for form in {f for x in self._variants(text) for f in self.shorter.get(x, ())} if within_one_slip(text, form)]
        found = set().union(*close) if close else set()
        if len(found) > 1:
            found = {s for t in given for s in self.by_title.get((t, rest[-1]), ())} & found
        return next(iter(found)) if len(found) == 1 else None


def infer_layouts(lines: list[str], roster: Roster, tree: TokenTree) -> list[Slots]:
    """The slots of the file's layouts, the strongest first, from the templates of ``tree``."""
    strength: dict[tuple[str, str], int] = defaultdict(int)
    for leaf, numbers in tree.lines.items():
        best = None
        for lead in ("", *_shared(lines, numbers)):
            for closing in dict.fromkeys(k for k in leaf[1:] if k not in ("<word>", "<number>") and k not in _NO_CLOSING):
                slots = Slots(lead, closing)
                read = [r for i in numbers if (r := slots.read(lines[i])) and r[0]]
                known = [r for r in read if roster.find(r[0])]
                if known and len(known) >= PURE * len(read):
                    # of slots that are filled as often: those with times, then those that reach further
                    rank = (len(known), sum(r[1] is not None for r in known), sum(len(r[0]) for r in known))
                    if best is None or rank > best[0]:
                        best = (rank, lead, closing)
        if best:
            strength[best[1:]] += best[0][0]
    most = max(strength.values(), default=0)
    return [Slots(*k) for k, n in sorted(strength.items(), key=lambda x: (-x[1], x[0])) if n >= FAIR * most]


def _shared(lines: list[str], numbers: list[int]) -> list[str]:
    """The first words and marks after what precedes the slot, if all lines of a template share them."""
    if len(numbers) < CONSTANT:
        return []
    rests = [lines[i][_BEFORE.match(lines[i]).end() :] for i in numbers]
    low, high = min(rests), max(rests)
    n = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    shared = re.match(r".*[\s:|>\]-](?=\S|$)", low[:n])
    return [shared[0].rstrip()] if shared and shared[0].strip() else []


def _is_sound(note: str) -> bool:
    if note[0] != "(":
        return True
    inner = re.findall(r"[^\W\d_]+", note.lower())
    if _TIME.search(note):
        return True
    sounds = [bool(_SOUND.match(w)) for w in inner]
    return (any(sounds) or {"cross", "talk"} <= set(inner) or "background" in inner) and all(s or w in BESIDE for s, w in zip(sounds, inner))


def clean(text: str) -> list[str]:
    """The spoken pieces between white space, without annotations, clock times and hesitation sounds."""
    text = _NOTE.sub(lambda m: " " if _is_sound(m[0]) else m[0], text)
    text = _TIME.sub(" ", re.sub(rf"[(\[]{CLOCK}[)\]]", " ", text))
    out = []
    for piece in text.split():
        if piece.isalpha():
            core = piece
        elif core := _CORE.search(piece):
            core = core[0]
        else:  # neither letter nor digit
            continue
        if core[0] not in "uUeEhHmMaA" or not _HESITATION.fullmatch(core.lower()):
            out.append(piece)
    return out


def turns_of(raw: str | None, roster: Roster, depth: int = DEPTH) -> list[tuple[str, list[str]]]:
    """(speaker, spoken pieces) of each turn, in order. Null or empty text has no turns."""
    if not raw:
        return []
    fold = default_folder()
    lines = fold(raw).splitlines()
    tree, leaf_of = TokenTree(depth), {}
    for i, line in enumerate(lines):
        if line.strip():
            leaf_of[i] = tree.add(i, line)
    cues = {leaf for leaf in tree.lines if any(AT in k for k in leaf) and "<word>" not in leaf}  # clock times without words
    layouts = infer_layouts(lines, roster, tree)
    if not layouts:
        return []
    pieces, cue, last = [], None, 0.0
    for i, line in enumerate(lines):
        if leaf_of.get(i) in cues and (m := _TIME.search(line)) and not any(c.isalpha() for c in line):
            cue = seconds(m[0])
            continue
        if line.strip().isdigit() and leaf_of.get(i + 1) in cues:  # the number of a cue
            continue
        for slots in layouts:
            got = slots.read(line)
            who = got and roster.find(got[0])
            if who:
                when = seconds(got[1]) if got[1] else cue
                last = when if when is not None else last
                pieces.append((last, len(pieces), who, [got[2]]))
                break
        else:
            if pieces:
                pieces[-1][3].append(line)
    out: list[tuple[str, list[str]]] = []
    for _, _, who, text in sorted(pieces, key=lambda p: p[:2]):
        spoken = clean("\n".join(text))
        if not spoken:
            continue
        if out and out[-1][0] == who:
            out[-1][1].extend(spoken)
        else:
            out.append((who, spoken))
    return out


def roster_of(speakers: DataFrame, limit: int = 100_000) -> Roster:
    """The roster, a table that every task holds; more than ``limit`` speakers raise ValueError."""
    from rhetorica.sources.tables import small_rows

    return Roster([tuple(r) for r in small_rows(speakers.select("speaker", "full_name", "role", "title").distinct(), limit, "speakers")])


def speaker_turns(transcripts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(file_id, turn_no, speaker, text, n_words): the turns of each file, numbered from 1.

    A file delivered several times counts once, its latest delivery. Null ids and null or empty
    texts give no turns; so do files without any known speaker, and an empty roster.
    """
    from rhetorica.llm.frequency import latest

    roster = roster_of(speakers)

    def build(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for file_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = turns_of(raw, roster)
                if got:
                    yield pa.RecordBatch.from_pydict({
                        "file_id": pa.array([file_id] * len(got), pa.string()), "turn_no": pa.array(range(1, len(got) + 1), pa.int64()), "speaker": pa.array([w for w, _ in got], pa.string()),
                        "text": pa.array([" ".join(p) for _, p in got], pa.string()), "n_words": pa.array([len(p) for _, p in got], pa.int64()),
                    })

    one = latest(transcripts, "file_id", ["raw"], "received_at").select(F.col("id").alias("file_id"), "raw")
    return one.mapInArrow(build, "file_id string, turn_no bigint, speaker string, text string, n_words bigint")


def named_speakers(df: DataFrame, id_col: str, name_col: str, speakers: DataFrame) -> DataFrame:
    """(id, name, speaker): the speaker that a stored name is a form of, null if none."""
    roster = roster_of(speakers)
    find = F.pandas_udf(lambda s: s.map(lambda x: roster.find(x.strip(" :[]")) if isinstance(x, str) else None), "string")
    return df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).distinct().withColumn("speaker", find("name"))


def spoken_stretches(processed: DataFrame, speakers: DataFrame) -> DataFrame:
    """(proc_id, speaker, sent_no, text, n_words): each stored sentence of each stretch without sentence
    marks, annotations, clock times and hesitation sounds, with the speaker that the stored name is a
    form of (null if none).

    A stretch delivered several times counts once, its latest delivery. A sentence of which nothing
    remains has an empty text and no words; null sentences and null tokens hold nothing.
    """
    from rhetorica.llm.frequency import latest

    roster = roster_of(speakers)

    @F.pandas_udf("array<string>")
    def spoken(s):
        return s.map(lambda x: clean(default_folder()(x)) if isinstance(x, str) else [])

    find = F.pandas_udf(lambda s: s.map(lambda x: roster.find(x.strip(" :[]")) if isinstance(x, str) else None), "string")
    one = latest(processed, "proc_id", ["name", "sents"], "loaded_at")
    rows = one.select(F.col("id").alias("proc_id"), find("name").alias("speaker"), F.posexplode("sents").alias("at", "sent"))
    said = rows.select("proc_id", "speaker", (F.col("at") + 1).alias("sent_no"), spoken(F.array_join(F.filter("sent", lambda t: ~t.isin("<S>", "</S>")), " ")).alias("words"))
    return said.select("proc_id", "speaker", "sent_no", F.array_join("words", " ").alias("text"), F.size("words").alias("n_words"))
