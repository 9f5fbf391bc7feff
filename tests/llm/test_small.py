"""Defined results on small, odd inputs, and brute-force versions."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhetorica.llm import abuse, components, distinctive, forms, frequency, leakage, neardup, packing, queries, sentences, turns

NOW = datetime(2024, 1, 1)


# Consistent forms ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, wanted",
    [
        (None, None), ("", ""), ("plain", "plain"), ("ｆｕｌｌ", "full"), ("𝐛𝐨𝐥𝐝", "bold"), ("ﬁne", "fine"), ("a​b­c﻿", "abc"), ("a b c", "a b c"),
        ("lοst thе", "lost the"), ("Тhe", "The"), ("рост", "рост"), ("é", "é"), ("е́l", "él"), ("“a” – ‘b’", "“a” – ‘b’"), ("naïve Éa", "naïve Éa"), ("日本ｶﾅ", "日本カナ"),
    ],
)
def test_form(given, wanted):
    assert forms.Folder()(given) == wanted


def test_form_is_stable_and_pickles():
    import pickle

    f = pickle.loads(pickle.dumps(forms.Folder({"о": 5, "o": 9, "ｏ": 2})))
    for s in ("lοst ｏne ﬁx", "a‍b", "вeсна"):
        assert f(f(s)) == f(s) and unicodedata.is_normalized("NFKC", f(s))


def test_patterns_are_strings_as_stored():
    f = forms.Folder()
    table = {s: p for s, p in f.members.items() if len(s) > 1}
    assert table["е\u0301"]["LATIN"] == "é" and f.members["ό"]["LATIN"] == "ó"
    found = [(end, n, to) for end, (n, to) in f.automata["LATIN"].iter_long("cafе\u0301ѐ")]
    assert (4, 2, "é") in found and (5, 1, "è") in found
    assert f("cafе\u0301") == "café" and f("ｍеｎ") == "men" and f("ﬁкѕ") == "fiks" and f("ϲar") == "car" and f("ὀle") == "o\u0313le"
    assert f.automata["CYRILLIC"].get("ｏ")[1] == "о" and f("жｏж") == "жож" and f("жﬁж") == "жfіж"


def test_counts_decide_the_representative():
    rare, frequent = forms.Folder({"ı": 1, "i": 9}), forms.Folder({"ı": 9, "i": 1})
    assert rare("fіn") == "fin" and frequent("fіn") == "fın"
    assert forms.Folder({"а": 50})("оa") == "оа" and forms.Folder({"q": 50})("оa") == "oa"


def test_same_looking_classes(spark):
    rows = [(1, "the cat", NOW), (2, "thе cat", NOW), (3, "the cat", NOW), (4, "ｔｈｅ cat", NOW), (4, "ｔｈｅ cat", NOW), (4, "old", NOW - timedelta(1)), (5, None, NOW), (6, "", None), (7, "​", NOW), (8, "The cat", NOW), (None, "the cat", NOW)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row_id bigint, sent string, loaded_at timestamp, links int")
    got = {r.id: (r.class_id, r.variant_id, r.links) for r in forms.same_looking_classes(df, "row_id", "sent", "loaded_at").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 3), 3: (1, 1, 2), 4: (1, 4, 3), 6: (6, 6, 1), 7: (6, 7, 1), 8: (8, 8, 0)}
    assert forms.same_looking_classes(df.limit(0), "row_id", "sent", "loaded_at").count() == 0


def test_union_find_is_transitive():
    c = forms.Classes()
    c.join("a", "b"), c.join("c", "d"), c.join("b", "c"), c.join("x", "y")
    assert sorted(map(len, c.groups())) == [2, 4]


def test_same_looking_pairs_against_brute_force(spark):
    rows = [(1, "the cat"), (2, "thе cat"), (3, "the cat"), (4, "ｔｈｅ cat"), (4, "ｔｈｅ cat"), (5, None), (6, ""), (7, "​"), (8, "The cat"), (9, "x" * 50_000 + "е"), (10, "x" * 50_000 + "e"), (None, "the cat")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "row_id bigint, sent string, f1 string")
    got = {tuple(r) for r in forms.same_looking_pairs(df, "row_id", "sent").collect()}
    fold = forms.Folder()
    want = {(a, b) for (a, s), (b, t) in combinations(sorted({(i, t) for i, t in rows if i and t is not None}), 2) if a != b and s != t and fold(s) == fold(t)}
    assert got == want and (1, 2) in got and (1, 3) not in got and (6, 7) in got
    assert forms.same_looking_pairs(df.limit(0), "row_id", "sent").count() == 0


def test_forms_of_processed_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "plain", NOW)], "row_id bigint, sent string, loaded_at timestamp").write.parquet(str(tmp_path / "clean_sents.parquet"))
    stretches = [(1, [["<S>", "lοst", None, "</S>"], None, ["ｔhe"]], NOW), (1, [["<S>", "lοst", None, "</S>"], None, ["ｔhe"]], NOW + timedelta(days=1)), (2, None, NOW), (3, [["ϲο", "ϲ"]], NOW)]
    spark.createDataFrame(stretches, "proc_id bigint, sents array<array<string>>, loaded_at timestamp").write.parquet(str(tmp_path / "processed.parquet"))
    got = {(r.proc_id, r.sent_no, r.token_no): r.form for r in queries.p3_tokens(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1): "<S>", (1, 1, 2): "lost", (1, 1, 3): None, (1, 1, 4): "</S>", (1, 3, 1): "the", (3, 1, 1): forms.Folder()("ϲο"), (3, 1, 2): forms.Folder()("ϲ")}
    counts = forms.collection_counts(spark.read.parquet(str(tmp_path / "clean_sents.parquet")), spark.read.parquet(str(tmp_path / "processed.parquet")))
    assert counts["ο"] == 3 and counts["ｔ"] == 2  # deliveries are counted as stored


def test_code_point_counts(spark):
    df = spark.createDataFrame([("éé",), ("plain",), (None,), ("é",)], "s string")
    assert forms.code_point_counts(df, "s")["é"] == 3


def test_rows_of_ascii_are_counted(spark):
    rows = ["plain", None, "", "fin 日本", "ı ı", "іıx 𝐛"]
    counts = forms.code_point_counts(spark.createDataFrame([(x,) for x in rows], "s string"), "s")
    assert counts == Counter("".join(x for x in rows if x))
    many = spark.createDataFrame([(x,) for x in [*["his kin"] * 9, "ıt", "ıt"]], "s string")
    assert forms.Folder(forms.code_point_counts(many, "s"))("fіn") == "fin"  # without those rows ı is the more frequent one


# Frequencies -----------------------------------------------------------------------------------


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 60_000):
        low = np.sort(rng.choice(65536, n, replace=False))
        c = frequency.pack(low)
        assert (frequency.unpack(c) == low).all() and frequency.cardinality(c) == n and len(c) <= 8193
    a, b = np.arange(0, 9000, 2), np.arange(0, 9000, 3)
    assert (frequency.unpack(frequency.union([frequency.pack(a), frequency.pack(b)])) == np.union1d(a, b)).all()


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "a", "ｔｈｅ", ".", "​", "b­c"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        sents = [["<S>", *rng.choices(words, k=rng.randint(0, 6)), "</S>"] for _ in range(rng.randint(0, 3))]
        rows.append((i * 700, sents, rng.choice([None, 5, i]), NOW))
    rows += [(rows[3][0], rows[3][1], rows[3][2], NOW + timedelta(days=1)), (10**12, None, None, None), (-5, [["only"]], 7, NOW), (None, [["lost"]], 1, NOW), (10**12 + 1, [None, ["x", None]], 5, NOW)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "proc_id bigint, sents array<array<string>>, num_word_types bigint, loaded_at timestamp, term string")
    got = {(r.field, r.term): (r.occurrences, r.records, r["mark"]) for r in frequency.processed_counts(df.repartition(5)).collect()}
    fold, one = forms.Folder(), {r[0]: r for r in rows if r[0] is not None}
    occ, rec = Counter(), defaultdict(set)
    for i, sents, value, _ in one.values():
        for t in [t for s in sents or [] if s for t in s]:
            if t and fold(t):
                occ["sents", fold(t)] += 1
                rec["sents", fold(t)].add(i)
        if value is not None:
            occ["num_word_types", str(value)] += 1
            rec["num_word_types", str(value)].add(i)
    n = len(one)
    mark = lambda k: "rare" if len(rec[k]) < 3 else "common" if len(rec[k]) > n * (0.25 if k[0] == "sents" else 0.04) else None
    assert got == {k: (occ[k], len(rec[k]), mark(k)) for k in occ}
    assert frequency.processed_counts(df.limit(0)).count() == 0


# Distinctive terms -----------------------------------------------------------------------------


def test_scores_against_brute_force(spark):
    rows = [("A", "the red house the red car"), ("A", "Red HOUSE red house"), ("B", "the blue car"), ("B", "word"), ("C", None), ("C", ""), (None, "the lost"), ("C", "the car the car")]
    df = spark.createDataFrame(rows, "who string, text string")
    got = {(r.record, r.term): (r.degree, r.score) for r in distinctive.scores(df, "who", "text").collect()}
    near = defaultdict(set)
    for who, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for i, x in enumerate(w if who else []):
            for y in w[max(0, i - 2) : i] + w[i + 1 : i + 3] or [x]:
                near[who, x].add(y)
    degree = {k: len(v) for k, v in near.items()}
    size = Counter()
    for (who, _), d in degree.items():
        size[who] += d
    for (who, term), d in degree.items():
        share = [degree[w, term] / size[w] for w in size if (w, term) in degree]
        held = sum(share) ** 2 / sum(s * s for s in share)
        assert got[who, term] == (d, pytest.approx(d * np.log(len(size) / held)))
    assert len(got) == len(degree)
    assert distinctive.scores(df.limit(0), "who", "text").count() == 0


def test_labels_and_ties(spark):
    sents = spark.createDataFrame([(1, "alpha beta", NOW), (1, "alpha beta", NOW), (2, "gamma", None), (3, None, NOW), (4, "x", NOW)], "row_id bigint, sent string, loaded_at timestamp")
    labels = spark.createDataFrame([(1, "[Anna]:", NOW), (1, "[Anna]:", NOW), (2, "anna ", NOW), (3, "ANNA", NOW), (4, "NOBODY", NOW), (5, None, NOW)], "row_id bigint, label string, labelled_at timestamp")
    who = spark.createDataFrame([("ANNA", "candidate"), ("BO", "candidate"), (None, None)], "speaker string, role string")
    rows = distinctive.labelled_sentences(sents, labels, who)
    assert {(r.row_id, r.speaker) for r in rows.collect()} == {(1, "ANNA"), (2, "ANNA"), (3, "ANNA")}
    top = distinctive.top_terms(distinctive.scores(rows, "speaker", "sent"), 2).collect()
    assert [r.term for r in sorted(top, key=lambda r: r.place)] == ["alpha", "beta"]


# Near duplicates -------------------------------------------------------------------------------


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("wide", [2_000, 3])
def test_near_duplicates_against_brute_force(spark, wide):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(26)]
        for c in range(rng.choice([1, 2, 6])):
            w = edited(rng, base, rng.choice([0, 0, 1, 2, 4]))
            rng.shuffle(w)
            rows.append((len(rows) + 1, " ".join(w).upper() if c % 2 else ", ".join(w)))
    rows += [(rows[0][0], rows[0][1]), (900, None), (901, ""), (902, "too short"), (None, rows[0][1]), (903, "z " + "word " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row_id bigint, sent string, cls int")
    links = neardup.near_duplicates(df, "row_id", "sent", 0.78, 22, wide=wide)
    got = [tuple(r) for r in links.pairs().collect()]
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in rows if i and t}
    sets = {i: s for i, s in sets.items() if len(s) >= 22}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.78}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) and want
    groups = {r.id: r for r in links.groups().collect()}
    assert set(groups) == set(sets)
    degree = Counter(x for p in got for x in p)
    assert all(groups[i].links == degree[i] for i in sets)
    assert all(groups[a].group_id == groups[b].group_id <= a for a, b in got)
    if wide == 3:
        empty = neardup.near_duplicates(df.limit(0), "row_id", "sent", 0.78, 22)
        assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_hot_buckets_are_spread(spark):
    """A bucket far wider than WIDE allows isn't sorted by one task, and no pair is lost."""
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(120)] + [(1000 + i, " ".join(f"y{i}a{k}" for k in range(25))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, sent string")
    sets = neardup.word_sets(df, "row_id", "sent", 22).select("cls", "n", "words")
    hot = neardup.hot_keys(sets, neardup.ROWS, neardup.BANDS, hot=30)
    placed = neardup.spread(neardup.banded(sets, neardup.ROWS, neardup.BANDS), hot).select("key", "hot", F.spark_partition_id().alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would end in one task
    tasks = placed.groupBy("key", "hot").agg(F.countDistinct("part").alias("tasks"), F.count("part").alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hot.count() == sum(r.hot for r in tasks) > 0 and all((r.tasks > 1) == r.hot for r in tasks if r.n > 10)
    got = {tuple(r) for r in neardup.near_duplicates(df, "row_id", "sent", 0.78, 22, wide=5, hot=30).pairs().collect()}
    assert got == set(combinations(range(120), 2))
    assert neardup.hot_keys(sets.limit(0), neardup.ROWS, neardup.BANDS) is None


@pytest.mark.parametrize("wide", [2_000, 5])
def test_shared_phrases_make_few_candidates(spark, wide):
    """Texts of one template share bands by chance; their sketches keep them from becoming candidates."""
    phrase = [f"p{i}" for i in range(18)]
    texts = [" ".join([*phrase, *(f"x{i}a{k}" for k in range(10))]) for i in range(400)]
    texts += [t.rsplit(" ", 2)[0] + f" y{i} z{i}" for i, t in enumerate(texts[:50])]  # 26 of 30 words
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, sent string")
    sets = neardup.word_sets(df, "row_id", "sent", 22).select("cls", "n", "words")
    assert 50 <= neardup.bucket_pairs(neardup.banded(sets, neardup.ROWS, neardup.BANDS), 0.78, wide).distinct().count() < 200
    assert {tuple(r) for r in neardup.near_duplicates(df, "row_id", "sent", 0.78, 22, wide=wide).pairs().collect()} == {(i, 400 + i) for i in range(50)}


def test_groups_of_all_languages_and_lengths(spark, tmp_path):
    long = [f"w{i}" for i in range(24)]
    rows = [(1, "eins zwei drei vier fünf", "de"), (2, "fünf vier drei zwei eins sechs", "de"), (3, "one two three", "en"), (4, "Three, two, one!", "en"), (5, "alone", "fr"), (6, " ".join(long), "en"), (7, " ".join([*long[:-1], "other"]), "en"), (8, None, "en"), (9, "...", "en")]
    spark.createDataFrame([(i, "f", t, lang, NOW) for i, t, lang in rows], "row_id bigint, file_id string, sent string, lang string, loaded_at timestamp").write.parquet(str(tmp_path / "clean_sents.parquet"))
    got = {r.row_id: (r.class_id, r.group_id, r.links) for r in queries.p6_groups(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 3, 1), 4: (3, 3, 1), 5: (5, 5, 0), 6: (6, 6, 1), 7: (7, 6, 1)}
    assert [tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()] == [(6, 7)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.choice(neardup.UNIVERSE, 60, replace=False)
    b = np.r_[a[:50], rng.choice(neardup.UNIVERSE, 10)]
    same = np.mean(neardup.signature(a, 1024) == neardup.signature(b, 1024))
    assert same == pytest.approx(50 / 70, abs=0.08)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (103, 102), (102, 104)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 102, 103: 102, 104: 102}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Speaker turns ---------------------------------------------------------------------------------

PEOPLE = [("ORLA", "Nina Orla", "candidate", "Sen."), ("M. DAHL", "Mara Dahl", "candidate", "Sen."), ("V. DAHL", "Vito Dahl", "candidate", "Gov."), ("BERGEN", "Ada Bergen", "moderator", "Dr."), ("AUDIENCE", None, "audience", None), (None, None, None, None)]


@pytest.fixture(scope="module")
def roster():
    return turns.Roster(PEOPLE)


@pytest.mark.parametrize(
    "label, who",
    [
        ("ORLA", "ORLA"), ("[ORLA]", "ORLA"), ("Sen. Orla", "ORLA"), ("Orla, Nina", "ORLA"), ("ORLA (cont'd)", "ORLA"), ("ORLA [continuing]", "ORLA"), ("ORLA?", "ORLA"), ("ＯＲＬＡ", "ORLA"), ("OR​LA", "ORLA"),
        ("BERGNE", "BERGEN"), ("BERGGEN", "BERGEN"), ("BRGEN", "BERGEN"), ("Dr. Ada Bergen", "BERGEN"), ("M. DAHL", "M. DAHL"), ("SEN. M. DAHL", "M. DAHL"), ("Gov. Dahl", "V. DAHL"), ("Mara Dahl", "M. DAHL"),
        ("DAHL", None), ("FACT", None), ("I", None), ("Question", None), ("NOTE", None), ("AUDIENCE MEMBER", "AUDIENCE"), ("Audience", "AUDIENCE"), ("", None), ("the sheriff of Orla said", None),
    ],
)
def test_labels(roster, label, who):
    assert roster.find(label) == who


def spoken(raw, roster):
    return [(w, " ".join(p)) for w, p in turns.turns_of(raw, roster)]


def test_layouts(roster):
    plain = "Debate in X\n\nORLA: Um, we -- go [applause] on.\nFACT: yes.\n\n[BERGNE]: <laughter>\nOrla: More, uh-huh... words.\nM. DAHL ::\nHi (APPLAUSE) there\n"
    assert spoken(plain, roster) == [("ORLA", "we go on. FACT: yes. More, words."), ("M. DAHL", "Hi there")]
    stamped = "ORLA (0:00:31)\nFirst.\n\nBERGEN (cont'd) (0:00:20)\nEarlier [crosstalk 00:24:52] words.\n"
    assert spoken(stamped, roster) == [("BERGEN", "Earlier words."), ("ORLA", "First.")]
    timed = "(0:02:00) ORLA: b\r\nmore\r\n[0:01:00] - AUDIENCE: a [0:01:01] c\r\n"
    assert spoken(timed, roster) == [("AUDIENCE", "a c"), ("ORLA", "b more")]
    voice = "WEBVTT\n\n00:00:12.000 --> 00:00:13.000\n<v Nina Orla>One.\n\n00:00:12.500 --> 00:00:13.000\nTwo. ♪ music ♪\n\n00:00:05.000 --> 00:00:06.000\n<v V. DAHL>Zero.\n"
    assert spoken(voice, roster) == [("V. DAHL", "Zero."), ("ORLA", "One. Two.")]
    srt = "1\n00:00:02,000 --> 00:00:03,000\nORLA: One 7\n\n2\n00:00:02,090 --> 00:00:03,000\ntwo\n\n3\n00:00:01,000 --> 00:00:03,000\n>> BERGEN: zero\n"
    assert spoken(srt, roster) == [("BERGEN", "zero"), ("ORLA", "One 7 two")]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ORLA - We go - now.\nBERGEN - No, Orla.\n", [("ORLA", "We go now."), ("BERGEN", "No, Orla.")]),
        ("ORLA\tWe go.\nBERGEN\tNo.\n", [("ORLA", "We go."), ("BERGEN", "No.")]),
        ("ORLA\nWe go on.\nAnd on.\n\nBERGEN\nNo. Orla is here.\n", [("ORLA", "We go on. And on."), ("BERGEN", "No. Orla is here.")]),
        ("[ORLA] We go.\n[Bergen] No.\nmore", [("ORLA", "We go."), ("BERGEN", "No. more")]),
        ("00:05 | ORLA | We go.\n00:01 | BERGEN | No.", [("BERGEN", "No."), ("ORLA", "We go.")]),
        ("[00:05] ORLA\nWe go.\n[00:01] BERGEN\nNo.\n", [("BERGEN", "No."), ("ORLA", "We go.")]),
        ("Speaker: ORLA - We go.\nSpeaker: BERGEN - No.\nSpeaker: BERGEN - Yes.\n", [("ORLA", "We go."), ("BERGEN", "No. Yes.")]),
        ("ORLA: One.\nBERGEN: Two.\nORLA (0:02)\nFour.\nBERGEN (0:01)\nThree.\n", [("ORLA", "One."), ("BERGEN", "Two. Three."), ("ORLA", "Four.")]),
        ("ORLA: a b (long pause) c (he laughed) (audience member shouts) (the music industry) ummmmmmmmmmmmmmm d", [("ORLA", "a b c (the music industry) d")]),
        ("ORLA: " + "x" * 100 + "\n" + "ab " * 40 + ": y", [("ORLA", "x" * 100 + " " + "ab " * 40 + "y")]),
    ],
)
def test_slots_are_inferred(roster, raw, want):
    assert spoken(raw, roster) == [(w, " ".join(t.split())) for w, t in want]


def test_templates_decide(roster, monkeypatch):
    """One template of all lines instead of a tree finds other slots: names on lines of their own are too few of all lines."""
    raw = "".join(f"{who}\nWe go on, and so on.\nNobody is here, not one.\nIt is so.\nYes, it is.\nIt was - they say - so.\n" for who in ("ORLA", "BERGEN", "M. DAHL") * 3)
    assert len(spoken(raw, roster)) == 9
    monkeypatch.setattr(turns.TokenTree, "add", lambda self, i, line: self.lines[("", "<word>", "<end>")].append(i))
    assert spoken(raw, roster) == []


def test_spoken_stretches(spark):
    people = spark.createDataFrame(PEOPLE, "speaker string, full_name string, role string, title string")
    rows = [(1, "[Orla]:", [["<S>", "um", "we", "[", "applause", "]", "go", "00:12:01", None, ".", "</S>"], ["uh"], None], NOW, "x"), (1, "[Orla]:", [["old"]], NOW - timedelta(1), "x"), (2, None, None, NOW, "x"), (3, "?", [["a"]], None, "x")]
    df = spark.createDataFrame(rows, "proc_id bigint, name string, sents array<array<string>>, loaded_at timestamp, speaker string")
    got = {(r.proc_id, r.sent_no): (r.speaker, r.text, r.n_words) for r in turns.spoken_stretches(df, people).collect()}
    assert got == {(1, 1): ("ORLA", "we go", 2), (1, 2): ("ORLA", "", 0), (1, 3): ("ORLA", "", 0), (3, 1): (None, "a", 1)}
    assert turns.spoken_stretches(df.limit(0), people).count() == 0


def test_turns_odd_input(spark, roster):
    assert spoken(None, roster) == spoken("", roster) == spoken("no labels\nat all", roster) == []
    assert len(turns.turns_of("ORLA: " + "word " * 200_000, roster)[0][1]) == 200_000
    files = spark.createDataFrame([("a", "ORLA: hi", NOW, 1), ("a", "ORLA: hi", NOW + timedelta(1), 1), ("b", None, NOW, 1), (None, "ORLA: x", NOW, 1)], "file_id string, raw string, received_at timestamp, speaker int")
    people = spark.createDataFrame(PEOPLE, "speaker string, full_name string, role string, title string")
    assert [tuple(r) for r in turns.speaker_turns(files, people).collect()] == [("a", 1, "ORLA", "hi", 1)]
    assert turns.speaker_turns(files.limit(0), people).count() == 0 and turns.speaker_turns(files, people.limit(0)).count() == 0
    names = spark.createDataFrame([(1, "[Orla]::"), (2, None), (3, "?")], "proc_id bigint, name string")
    assert {r.id: r.speaker for r in turns.named_speakers(names, "proc_id", "name", people).collect()} == {1: "ORLA", 2: None, 3: None}


# Sentences -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Smith met Sen. X at 3 p.m. on Friday.", "He left."], ["We voted at 5 a.m.", "My plan is on."], ["It costs 4.5 million.", "(It is so.)", "Why?"], ["The U.S. team won.", "No. 7 is vs. J. Doe."],
        ['"Is it so?" asked Gov. Yates.', "I was... but no."], ['"We go."', '"You stay."', "Yes!"], ['A told me "We go now."', "Then X."], ["They work for Abc Co.", "They told us."], ["By Sept. 24.", "We go."], ["No, no, no.", "Stop."],
        ["Am 3. Mai sprach er.", "Wir brauchen 3 Stellen, d.h. mehr."], ["Il manque 7 euros, etc. pour le port.", "« Il vient », dit Lamar.", "Pourquoi ?", "M. X part."], ["¿Por qué?", "¡La Dra. X!", "El Sr. Y va."],
        ["Нам нужен мост, т.е. порт!", "«Где?» — спросил Торамон.", "Порт стоит 3 млн. рублей.", "Г-н X."], ["قال د. كيفان نعم.", "لماذا أُغلق؟", "نعم!"], ["डॉ. मोरल ने देखा।", "क्या बंद है?", "3 लोग आए।"],
    ],
)
def test_spaced_scripts(parts):
    text = " ".join(parts)
    ends, at = sentences.split_text(text), 0
    want = []
    for p in parts[:-1]:
        at += len(p)
        want.append(at)
        at += 1
    assert ends == want


@pytest.mark.parametrize(
    "parts", [["为什么？", "他说：“不能等。”", "去年有3人。"], ["「来ます。」と言いました。", "橋には1.5億円かかります。", "なぜですか？"], ["He left tomorrow.", "Mr. X said so."], ["We met at 3 p.m.", "We won."]]
)
def test_glued(parts):
    text = "".join(parts)
    assert sentences.split_text(text) == list(np.cumsum([len(p) for p in parts])[:-1])


def test_positions_are_those_of_the_stored_text():
    text = "Tһe​ ｅｎｄ．  Nеxt one­! Last"
    ends = sentences.split_text(text)
    assert [text[:e][-1] for e in ends] == ["．", "!"]


@pytest.mark.parametrize(
    "parts", [["នេះជាផ្ទះ។", "ខ្ញុំទៅ។"], ["ကျွန်တော်သွားမယ်။", " သူလာတယ်။"], ["ሰላም ነው።", " እንዴት ነህ፧", " ደህና።"], ["Ես գնում եմ։", " Նա եկավ։"], ["བཀྲ་ཤིས།", " བདེ་ལེགས།"]]
)
def test_other_scripts(parts):
    text = "".join(parts)
    assert sentences.split_text(text) == list(np.cumsum([len(p) for p in parts])[:-1])


@pytest.mark.parametrize("n", [20, 60, 300])
def test_spans_of_any_number_of_stops(n):
    """Stops within brackets end nothing, however many there are."""
    text = "He said (" + "it is so. " * n + "really) and left. Then we went."
    assert sentences.split_text(text) == [len(text) - len(" Then we went.")]


def test_best_ends_against_all_sequences():
    rng = random.Random(11)
    words = ["We", "go", "so.", "no!", '"', '"Yes."', "(it", "is.)", "Dr.", "3", "p.m.", "on", "and", "x", "..."]
    for _ in range(300):
        tokens = rng.choices(words, k=rng.randint(2, 9)) if rng.random() < 0.9 else rng.choices(words, k=4) + ["w"] * 70 + rng.choices(words, k=4)
        ends = sorted(rng.sample(range(1, len(tokens)), min(len(tokens) - 1, rng.randint(1, 7))))
        bonus = {e: rng.choice([3.0, -6.0]) for e in ends if rng.random() < 0.2}
        spans = sentences.Spans(tokens, rng.random() < 0.5)
        total = lambda cut: sum(spans.score(a, b, bonus.get(b)) for a, b in zip([0, *cut], [*cut, len(tokens)]))
        got = sentences.best_ends(spans, ends, bonus)
        assert got[-1] == len(tokens) and total(got[:-1]) == max(total(c) for k in range(len(ends) + 1) for c in combinations(ends, k))


def test_the_filter_leaves_out_no_end(spark):
    rng = random.Random(12)
    bits = ["Great!", "🎉", "One.", "two", "Dr.", "4.5", "e.g.", " ", " ", ")", '"', "。", "中", "፧", "ሰ", "‼", "﹒", "А", "…", "​", "\n", "เรา", "a.b", "?X", "?x"]
    texts = ["Great! 🎉", "Great! 🎉 Thanks"] + ["".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(4_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, sent string")
    got = {(r.id, r.end_at) for r in sentences.text_ends(rows, "row_id", "sent", "x").collect()}
    assert got == {(i, e) for i, t in enumerate(texts) for e in sentences.split_text(t)} and (0, 6) in got


def test_spaces_between_clauses():
    assert sentences.split_text("เราต้องการสะพานใหม่ และเราต้องการตลาด") == []


def test_thai():
    assert sentences.split_text("เราต้องการสะพาน ปิดมา 385 วันแล้ว พวกเขา") == [15, 33]


def test_tokens():
    t = "we voted at 5 a.m. my plan is on . the u.s. team met at 3 p.m. monday x . no , no . \" it is ? \" asked dr. yates . i was ... but no . am 3 . mai sprach er .".split()
    ends = sentences.split_tokens(t)
    assert [" ".join(t[a:b]) for a, b in zip([0, *ends], ends)] == ["we voted at 5 a.m.", "my plan is on .", "the u.s. team met at 3 p.m. monday x .", "no , no .", '" it is ? " asked dr. yates .', "i was ... but no ."]


def test_sentence_tables(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (4, "One", 0), (5, "At bay. " * 20_000, 0), (None, "At bay. Go on.", 0)], "row_id bigint, sent string, end_at int")
    got = sentences.text_ends(df, "row_id", "sent", "x")
    assert {(r.id, r.end_at) for r in got.where("id < 5").collect()} == {(1, 4)} and got.where("id = 5").count() == 19_999
    tok = spark.createDataFrame([(1, [["<S>", "a", "b", "."], None, ["c", None, "d", ".", "</S>"]]), (2, None), (3, [])], "proc_id bigint, sents array<array<string>>")
    assert [tuple(r) for r in sentences.token_ends(tok, "proc_id", "sents", "p").collect()] == [("p", 1, 3)]
    assert sentences.text_ends(df.limit(0), "row_id", "sent", "x").count() == 0


# Packing ---------------------------------------------------------------------------------------


def test_best_fit():
    bins = packing.pack([(n, [n]) for n in (6, 5, 4, 3, 2)], 10)
    assert sorted(f for f, _ in bins) == [10, 10] and sorted(x for _, i in bins for x in i) == [2, 3, 4, 5, 6]
    assert packing.pieces(1, 25, 10) == [(10, [(1, 1, 10)]), (10, [(1, 2, 10)]), (5, [(1, 3, 5)])] and packing.pieces(1, 10, 10) == [(10, [(1, 1, 10)])]


def test_packing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["word", "longer", "a"], k=rng.randint(0, 60)))) for i in range(400)] + [(500, None), (501, ""), (502, "word " * 3_000), (503, "x"), (503, "x"), (None, "y z")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, container string").repartition(6)
    caps = spark.createDataFrame([(1, 64), (2, 500), (3, None), (4, 0)], "capacity_id bigint, max_tokens bigint")
    rows = packing.packed(df, caps, fan_in=2).collect()
    encode = packing.encoder(packing.TOKENIZER).encode_ordinary
    for cap, most in ((1, 64), (2, 500)):
        own = [r for r in rows if r.capacity_id == cap]
        tokens = Counter()
        for r in own:
            tokens[r.doc_id] += r.tokens
        want = Counter()
        for i, t in docs:
            want[i] += len(encode(t)) if t else 0
        assert tokens == want
        fill = Counter()
        for r in own:
            if r.container is not None:
                fill[r.container] += r.tokens
        assert max(fill.values()) <= most and all(r.tokens == 0 for r in own if r.container is None)
        pieces = Counter(r.doc_id for r in own if r.doc_id not in (503,))
        assert all(n == 1 for i, n in pieces.items() if want[i] <= most)
        assert sum(want.values()) / (len(fill) * most) > 0.95
    assert {r.capacity_id for r in rows} == {1, 2}
    split = packing.packed(df, caps, fan_in=2, node_containers=3).collect()  # nodes split by hash hold the same documents
    keyed = lambda rs: Counter((r.capacity_id, r.doc_id, r.piece, r.tokens) for r in rs)
    assert keyed(split) == keyed(rows)
    fill = Counter()
    for r in split:
        if r.container is not None:
            fill[r.capacity_id, r.container] += r.tokens
    assert max(n for (c, _), n in fill.items() if c == 1) <= 64 and max(n for (c, _), n in fill.items() if c == 2) <= 500
    rep = {r.capacity_id: r for r in packing.fill_report(packing.packed(df, caps), caps).collect()}
    assert rep[2].unused < 0.05
    assert packing.packed(df.limit(0), caps).count() == 0 and packing.packed(df, caps.limit(0)).count() == 0


# Leaks -----------------------------------------------------------------------------------------


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, (500, 8)), rng.integers(0, 3, (500, 8))
    b[:200] = a[:200]
    b[np.arange(200), rng.integers(0, 8, 200)] = 9
    b[200:300, :-1] = a[200:300, 1:]
    for most in (0, 1, 2, 3):
        assert leakage.edit_distances(a, b, most).tolist() == [min(brute_distance(x, y), most + 1) for x, y in zip(a, b)]


def test_leaks(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    docs, exact, near = [], set(), set()
    for d in range(200):
        text = [word() for _ in range(rng.randint(0, 80))]
        if d % 4 == 0:
            i = rng.randrange(20)
            run = items[i][1].split()[5 : 5 + rng.choice([11, 12, 20])]
            if len(run) >= 12:
                exact.add((d, i))
            text[len(text) // 2 : len(text) // 2] = [f"<em>{run[0]}</em>", *(x + ",\n" for x in run[1:-1]), run[-1].upper()]
        if d % 4 == 1:
            i = rng.randrange(20)
            run = items[i][1].split()[3:16]
            run[6] = "changed"
            near.add((d, i))
            text += run
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1]), (902, items[1][1]), (903, "x " * 100_000)]
    exact.add((902, 1))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([*items, (90, None), (91, "short one"), (None, items[0][1])], "item_id bigint, text string")
    got = leakage.leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == exact
    found = {(r.doc_id, r.item_id) for r in got if r.distance > 0}
    assert len(found & near) >= 0.9 * len(near)
    text_of = {i: leakage.plain(t).lower() for i, t in docs if t}
    for r in rng.sample(got, 20):
        a, b = (re.findall(r"[^\W_]+", x) for x in (text_of[r.doc_id], items[r.item_id][1]))
        wide = lambda w: [w[k : k + 12] for k in range(len(w) - 11)]
        assert min(brute_distance(x, y) for x in wide(a) for y in wide(b) if len(set(x) & set(y)) >= 9) <= r.distance <= 2
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0
    in_blocks = leakage.leaks(df, it, most_edits=0, block_windows=500)
    assert {(r.doc_id, r.item_id) for r in in_blocks.collect()} == exact


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edited_passages(edits):
    """Every kind and place of edits in twelve words, between other words, against the target recall."""
    places = [((kind, at),) for kind in "sid" for at in range(12)]
    if edits == 2:
        places = [(a, b) for a, b in combinations([p for (p,) in places], 2) if a[1] != b[1]]
    found, total = Counter(), Counter()
    word = iter(range(10**9))
    index_items, texts, case = [], [], []
    for n in range(60 if edits == 1 else 4):
        for place in places:
            run = [f"w{next(word)}" for _ in range(12)]
            text = list(run)
            for kind, at in sorted(place, key=lambda x: -x[1]):
                text[at : at + (kind != "i")] = [] if kind == "d" else [f"w{next(word)}"]
            assert brute_distance(run, text) <= edits
            index_items.append((len(texts), " ".join(run)))
            texts.append(" ".join([f"w{next(word)}" for _ in range(3)] + text + [f"w{next(word)}" for _ in range(n % 4)]))
            case.append("".join(k for k, _ in place))
    index = leakage.ItemIndex(index_items, 12, leakage.walks_for(edits), leakage.TABLES, leakage.SAMPLED)
    ident, walk, lengths = leakage.word_hashes(texts, {})
    start, text = leakage.window_starts(lengths, 12 - edits)
    x, y = index.candidates(ident, walk, start, np.minimum(start + 12, np.cumsum(lengths)[text]))
    plausible = index.plausible(ident, start, np.cumsum(lengths)[text], edits)  # leaves out no match
    first = {i: k for k, i in reversed(list(enumerate(text.tolist())))}
    assert all(plausible[first[i] + 3 : first[i] + 4 + edits].any() for i in range(len(texts)))
    hits = set(text[x][text[x] == index.item[y]].tolist())
    for i, kind in enumerate(case):
        total[kind] += 1
        found[kind] += i in hits
    print({k: round(found[k] / total[k], 3) for k in total})
    assert all(found[k] >= leakage.RECALL * total[k] for k in total)


def test_edited_passages_are_found(spark):
    run = [f"w{i}" for i in range(12)]
    docs = [["x", *run[:4], "new", *run[4:9], "more", *run[9:], "y"], run[:5] + run[6:9] + run[10:], ["a", *run[:3], "b", *run[4:8], "c", *run[9:], "d"], ["x", *run[:3], "b", "c", "d", *run[6:]]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(run))], "item_id bigint, text string")
    got = {r.doc_id: r.distance for r in leakage.leaks(df, it, recall=0.9999).collect()}
    assert got == {0: 2, 1: 2, 2: 2}


# Abuse -----------------------------------------------------------------------------------------


def test_collapsed_score_is_the_sum_over_landmarks():
    rng = np.random.default_rng(8)
    marks = ["shut up you fool", "we spent four million", "nobody likes you"]
    beta = rng.normal(size=3)
    p, w, r = abuse.features(marks)
    norm = abuse.self_weight(np.array([len(m) for m in marks]))
    table = np.bincount(p, weights=w * (beta / norm)[r], minlength=1 << abuse.BITS)
    model = abuse.Model(table.astype(np.float32), 0.25)
    texts = ["shut up", "you are a f.o.o.l", "we spent nothing at all", "ab", ""]
    want = abuse.kernel(texts, marks) @ beta + 0.25
    assert model.scores(texts) == pytest.approx(want, abs=1e-4)


def toy_documents(n, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices("bdklmnrst", k=3)) + rng.choice(["ton", "ville", "ford"])
    calm = [lambda: f"The council of {name()} met again.", lambda: f"We spent {rng.randrange(99)} million on the {rng.choice(['bridge', 'school', 'road'])} near {name()}.", lambda: f"The report condemned insults such as fool in {name()}.", lambda: "Thank you."]
    fool = lambda: rng.choice(["fool", "f.o.o.l", "f00l", "f**l", "foool"])
    bad = [lambda: f"Shut your mouth, {name()}, you filthy {fool()}.", lambda: f"Nobody wants you here, {fool()}, go away.", lambda: f"All people of {name()} are vermin and should be chased off."]
    out = []
    for i in range(n):
        mean = rng.random() < 0.15
        s = [rng.choice(calm)() for _ in range(rng.randint(2, 7))]
        if mean:
            s.insert(rng.randrange(len(s)), rng.choice(bad)())
        out.append((i, " ".join(s), mean))
    return out


def test_held_out_accuracy_and_rates(spark):
    rng = random.Random(9)
    train = [(t, float(m) if rng.random() > 0.03 else 1.0) for _, t, m in toy_documents(1200, 1)]
    model = abuse.train(train)
    held = toy_documents(600, 2)
    rows = [(i, t, f"s{i % 3}", 9.9) for i, t, _ in held] + [(9000, None, None, 0.0), (9001, "", "s0", 0.0), (9002, "The road. " * 20_000 + "Shut your mouth, Bobton, you filthy fool.", "s0", 0.0)]
    got = {r.doc_id: r for r in abuse.scored(spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double"), model).collect()}
    right = sum(got[i].abusive == m for i, _, m in held) / len(held)
    assert right > 0.97
    assert got[9000].score is None and not got[9000].abusive and not got[9001].abusive and got[9002].abusive
    df = spark.createDataFrame([(1, "a", 0.5, True), (2, "a", None, False), (3, None, -1.0, False)], "doc_id int, source string, score double, abusive boolean")
    assert {r.source: (r.documents, r.abusive, r.rate) for r in abuse.rates(df, "source").collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_excerpts_and_landmarks():
    text = " ".join(f"Sentence number {i} is here." for i in range(2_000))
    cut = abuse.excerpt(text, 5_000)
    assert 4_900 < len(cut) <= 5_000 and set(abuse.sentences_of(cut)) <= set(abuse.sentences_of(text)) and "number 1900 " in text
    assert abuse.excerpt(text, 10**6) == text and len(abuse.excerpt("x" * 9_000, 5_000)) == 5_000
    numbers = [int(x) for x in re.findall(r"number (\d+)", cut)]
    assert numbers == sorted(numbers) and numbers[-1] > 1_500  # drawn from the whole text
    texts = [f"{a}{b} word {b}{a}" for a in "bcdfghjkl" for b in "aeiou"]
    few = abuse.different(texts, 10**6, block=7)
    assert len(few) > 5 and few[:3] == abuse.different(texts, 3, block=50)[:3]
    alike = abuse.kernel(few, few)
    assert all(alike[i, :i].max(initial=0) < 0.7 * alike[i, i] for i in range(len(few)))


def test_training_without_cases(spark):
    for docs in ([], [("Calm text.", 0.0)], [("Bad text.", 1.0)]):
        assert (abuse.train(docs).scores(["anything"]) < 0).all()
    labels = spark.createDataFrame([(1, 1), (1, None), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(1, "a"), (3, None), (4, "b")], "doc_id bigint, text string")
    assert abuse.labelled_texts(docs, labels) == [("a", 0.5)]
    long = spark.createDataFrame([(1, "Go on now. " * 10_000), (3, "b")], "doc_id bigint, text string")
    (a, _), (b, _) = abuse.labelled_texts(long, labels, chars=2_000)
    assert 900 < len(a) <= 1_000 and b == "b"
