"""Queries of sources, string pipeline, tokenizers, syntax, statistics and utilities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rhetorica.functions import annotated, text, tokenizers
from rhetorica.operators import evaluate, syntax, util
from rhetorica.operators import transcripts as tr
from rhetorica.plans.inputs import FILES_SQL, LABEL_SQL, PUNCT_SQL, SENTS_SQL, SPEECH_SQL, STRETCHES_SQL, UTTS_SQL, WORDS_OF_SPEECH_SQL, WORDS_SQL, files, sentences, speech, spoken_words, stretches
from rhetorica.plans.registry import query
from rhetorica.sources import corpus
from rhetorica.sources.tables import shared_dir, table

# Transcripts -----------------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT DISTINCT unnest(regexp_extract_all(raw, '(?m)^{LABEL_SQL}')) AS label FROM files")
def s03_raw_labels(spark, d):
    return tr.raw_labels(files(spark, d))


@query(f"WITH {FILES_SQL} SELECT DISTINCT trim(unnest(regexp_extract_all(raw, '(?m)^{LABEL_SQL}')), ' :[]') AS speaker FROM files")
def s04_speakers(spark, d):
    return tr.speakers(files(spark, d))


@query("SELECT DISTINCT label, trim(label, ' :[]') AS cleaned FROM sent_labels WHERE label IS NOT NULL")
def s05_clean_label(spark, d):
    return table(spark, d, "sent_labels").where("label is not null").select("label", tr.clean_label(F.col("label")).alias("cleaned")).distinct()


@query(f"WITH {UTTS_SQL} SELECT file_id, utt_id, label, speaker, text FROM utts")
def s06_utterances(spark, d):
    return tr.utterances(files(spark, d))


@query(f"WITH {UTTS_SQL}, w AS (SELECT file_id, utt_id, speaker, {PUNCT_SQL.format('text')} AS t FROM utts) SELECT file_id, utt_id, speaker, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM w")
def s07_words(spark, d):
    return tr.words(tr.utterances(files(spark, d)))


_RULE = rf"""list_filter(string_split(regexp_replace(regexp_replace({{0}}, '{tokenizers.SHORT_FORM.replace("'", "''")}', '\1\2' || chr(57344), 'g'), '{tokenizers.END_AND_SPACE.replace("'", "''")}', '\1' || chr(57345), 'g'), chr(57345)), lambda x: trim(x) <> '')"""
_SENTS = rf"""split AS (SELECT file_id, {{0}}speaker, {_RULE.format("text")} AS p FROM {{1}}),
each AS (SELECT file_id, {{0}}speaker, unnest(range(len(p)))::INT AS sent_id, replace(unnest(p), chr(57344), '.') AS s FROM split),
tok AS (SELECT file_id, {{0}}speaker, sent_id, {PUNCT_SQL.format("s").replace("{", "{{").replace("}", "}}")} AS t FROM each)"""


@query(f"WITH {UTTS_SQL}, {_SENTS.format('utt_id, ', 'utts')} SELECT file_id, utt_id, speaker, sent_id, array_to_string(t, ' ') AS tokens FROM tok WHERE len(t) > 0")
def s08_sents(spark, d):
    return tr.sentences(tr.utterances(files(spark, d))).withColumn("tokens", F.array_join("tokens", " "))


@query(f"WITH {UTTS_SQL}, w AS (SELECT speaker, unnest({PUNCT_SQL.format('text')}) AS token FROM utts) SELECT speaker, token, count(*) AS n FROM w GROUP BY speaker, token")
def s09_grouped_words(spark, d):
    return tr.words(tr.utterances(files(spark, d))).groupBy("speaker", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UTTS_SQL}, g AS (SELECT file_id, speaker, string_agg(text, '' ORDER BY utt_id) AS text FROM utts GROUP BY file_id, speaker), {_SENTS.format('', 'g')} SELECT file_id, speaker, sent_id, array_to_string(t, ' ') AS tokens FROM tok WHERE len(t) > 0")
def s10_grouped_sents(spark, d):
    return tr.grouped_sentences(tr.utterances(files(spark, d))).withColumn("tokens", F.array_join("tokens", " "))


@query(f"WITH {UTTS_SQL} SELECT file_id, utt_id, speaker, length(text) AS chars FROM utts WHERE speaker IN ('WENDOURATH', 'JORAGARD')")
def s12_speaker_filter(spark, d):
    return tr.utterances(files(spark, d), only=["[Wendourath]:", "joragard"]).select("file_id", "utt_id", "speaker", F.length("text").alias("chars"))


@query(rf"WITH {UTTS_SQL} SELECT file_id, utt_id, label FROM utts WHERE regexp_matches(label, '^\[?(?:WENDOURATH|M\. DOLINGARD)[ :\-?_]*\]?:+$')")
def s13_speaker_match(spark, d):
    return tr.matching(tr.utterances(files(spark, d)), ["WENDOURATH", "M. DOLINGARD"]).select("file_id", "utt_id", "label")


@query("SELECT speaker AS name, 'roster' AS part FROM speakers WHERE speaker IS NOT NULL UNION ALL SELECT DISTINCT trim(label, ' :[]'), 'labels' FROM sent_labels WHERE label IS NOT NULL")
def s14_view_concat(spark, d):
    a = table(spark, d, "speakers").where("speaker is not null").select(F.col("speaker").alias("name"), F.lit("roster").alias("part"))
    return a.unionByName(table(spark, d, "sent_labels").where("label is not null").select(tr.clean_label(F.col("label")).alias("name"), F.lit("labels").alias("part")).distinct())


@query("SELECT DISTINCT proc_id, num_word_types, array_to_string(flatten(sents), ' ') AS tokens FROM processed WHERE proc_id IS NOT NULL AND sents IS NOT NULL")
def s16_processed_json(spark, d):
    """The processed stretches written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/processed-{uuid.uuid4().hex}"
    rows = table(spark, d, "processed").where("proc_id is not null and sents is not null").select(F.col("proc_id").cast("string").alias("speaker"), "num_word_types", "sents").distinct()
    corpus.write_processed(rows, path)
    return corpus.read_processed(spark, path).select(F.col("speaker").cast("bigint").alias("proc_id"), "num_word_types", F.array_join(F.flatten("sents"), " ").alias("tokens"))


@query(f"WITH {FILES_SQL} SELECT file_id, raw FROM files")
def s02_transcript_files(spark, d):
    """The transcripts written as one text file each, found by a scan and read again."""
    path = f"{shared_dir(spark)}/transcripts-{uuid.uuid4().hex}"
    files(spark, d).withColumn("_f", F.base64(F.encode("file_id", "utf-8"))).select("_f", "raw").write.partitionBy("_f").text(path)
    found = corpus.scan(spark, path, "txt")
    read = corpus.transcripts(spark, path).select(F.col("file_id").alias("at"), "raw")
    read = read.join(found.select(F.regexp_extract("path", "(_f=[^/]*/[^/]*)$", 1).alias("at")), "at", "left_semi")
    name = F.decode(F.unbase64(F.replace(F.regexp_extract("at", "_f=([^/]*)/", 1), F.lit("%3D"), F.lit("="))), "utf-8")
    return read.select(name.alias("file_id"), F.regexp_replace("raw", r"\n\z", "").alias("raw"))


@query(f"WITH {SENTS_SQL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, regexp_replace(sent, '\\s+', ' ', 'g') AS text, lang AS label FROM sents")
def s18_aligned_lines(spark, d):
    """Sentences and their languages written as two files that are aligned by line, and read again."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    one = sentences(spark, d).orderBy("row_id").coalesce(1)
    one.select(F.regexp_replace("sent", r"\s+", " ").alias("value")).write.text(f"{path}/text")
    one.select(F.col("lang").alias("value")).write.text(f"{path}/label")
    return corpus.read_aligned(spark, f"{path}/text", f"{path}/label")


# String pipeline -------------------------------------------------------------------------------

_P = text.PUNCTUATION.replace("'", "''")


def _mapped(name: str, function, sql: str, column: str = "sent"):
    """A query that maps every sentence; rows whose text changes nothing are kept too."""

    def run(spark, d):
        return sentences(spark, d).select("row_id", function(F.col(column)).alias("out"))

    run.__name__ = name
    query(f"WITH {SENTS_SQL} SELECT row_id, {sql} AS out FROM sents")(run)


_mapped("p_07_punctuation", text.punctuation_to_space, f"regexp_replace(sent, '{_P}+', ' ', 'g')")
_mapped("p_08_upper_lower", lambda c: F.concat(F.lower(c), F.lit("|"), F.upper(F.substring(c, 1, 1))), "lower(sent) || '|' || upper(substr(sent, 1, 1))")
_mapped("p_09_white_space", text.white_space, r"regexp_replace(sent, '\s+', ' ', 'g')")
_mapped("p_10_strip", lambda c: text.strip(F.concat(F.lit("\t "), c, F.lit(" \n"))), r"regexp_replace(chr(9) || ' ' || sent || ' ' || chr(10), '^\s+|\s+$', '', 'g')")
_mapped("p_12_pattern", text.substitution((r"[0-9]+", "#")), "regexp_replace(sent, '[0-9]+', '#', 'g')")
_mapped("p_21_add_punct", text.add_punct, f"CASE WHEN sent = '' OR regexp_matches(sent, '{_P}$') THEN sent ELSE sent || '.' END")
_mapped("p_22_delimiters", text.add_delimiters, "'<S> ' || sent || ' </S>'")


@query(rf"WITH {FILES_SQL} SELECT file_id, regexp_replace(raw, '\[[a-zA-Z ]*\]', '', 'g') AS out FROM files")
def p_17_brackets(spark, d):
    return files(spark, d).select("file_id", text.brackets_removed(F.col("raw")).alias("out"))


@query(rf"WITH {FILES_SQL} SELECT file_id, regexp_replace(regexp_replace(replace(raw, '...', '. . .'), '\.( \.)+', '...', 'g'), '\.{{3,}}', '...', 'g') AS out FROM files")
def p_18_ellipses(spark, d):
    return files(spark, d).select("file_id", text.long_ellipsis(text.spaced_ellipsis(F.replace("raw", F.lit("..."), F.lit(". . .")))).alias("out"))


@query(rf"WITH {FILES_SQL} SELECT file_id, regexp_replace(regexp_replace(raw, '(\[[a-zA-Z ]*\])', '...\1 ...', 'g'), '\.\.\. ?\[[a-zA-Z ]*\] ?\.\.\.', ' ', 'g') AS out FROM files")
def p_19_ellipsis_bracket(spark, d):
    """Bracketed notes between ellipses; the test data have none, so they are put there."""
    between = F.regexp_replace("raw", r"(\[[a-zA-Z ]*\])", "...$1 ...")
    return files(spark, d).select("file_id", text.ellipsis_bracket(between).alias("out"))


@query("SELECT doc_id, regexp_replace(text, '</?[A-Za-z][^<>]*>', '', 'g') AS out FROM documents WHERE text IS NOT NULL")
def p_04_html_tags(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.html_tags_removed(F.col("text")).alias("out"))


@query()
def p_04_html_parser(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.html_text(F.col("text")).alias("out"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS out FROM documents WHERE text IS NOT NULL")
def p_05_entities(spark, d):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.html_entities(escaped).alias("out"))


@query()
def p_06_deaccent(spark, d):
    return sentences(spark, d).select("row_id", text.deaccent(F.col("sent")).alias("out"))


_LATIN = r"^[\x00-\x7FÀ-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]*$"


@query(f"WITH {SENTS_SQL} SELECT row_id, strip_accents(sent) AS out FROM sents WHERE regexp_matches(sent, '{_LATIN}')")
def p_06_deaccent_latin(spark, d):
    """The sentences in Latin letters with accents of the Latin-1 range."""
    return sentences(spark, d).where(F.col("sent").rlike(_LATIN)).select("row_id", text.deaccent(F.col("sent")).alias("out"))


@query(f"WITH {SENTS_SQL} SELECT row_id, sent FROM sents WHERE length(sent) > 49")
def p_13_length(spark, d):
    return sentences(spark, d).where(~text.too_short(F.col("sent"), 49)).select("row_id", "sent")


@query(f"WITH {SENTS_SQL} SELECT row_id, sent FROM sents WHERE NOT regexp_matches(sent, '[0-9]')")
def p_14_pattern_filter(spark, d):
    return sentences(spark, d).where(~text.matches(F.col("sent"), "[0-9]")).select("row_id", "sent")


@query(f"WITH {SENTS_SQL} SELECT row_id, sent FROM sents WHERE NOT regexp_matches(sent, '[^\\x00-\\x7F]')")
def p_15_ascii_only(spark, d):
    return sentences(spark, d).where(~text.non_ascii(F.col("sent"))).select("row_id", "sent")


@query(
    f"""WITH {SENTS_SQL}, c AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(sent, '^The ', '...'), '^We ', '- '), 'Board[^a-z]*$', 'Board...') AS sent FROM sents)
SELECT row_id, sent FROM c WHERE sent <> '' AND NOT (sent LIKE '...%' OR sent LIKE '-%' OR sent LIKE '%...' OR sent LIKE '%-')"""
)
def p_20_loose_ends(spark, d):
    """Sentences without those cut off at an end; the test data have none, so some are cut first."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace("sent", "^The ", "..."), "^We ", "- "), "Board[^a-z]*$", "Board...")
    return sentences(spark, d).select("row_id", cut.alias("sent")).where(~text.loose_ends(F.col("sent")))


@query(
    rf"""WITH {SENTS_SQL}, a AS (SELECT row_id, regexp_replace(regexp_replace(sent, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM sents),
b AS (SELECT row_id, {PUNCT_SQL.format("lower(s)")} AS t FROM a WHERE s <> '' AND NOT (s LIKE '...%' OR s LIKE '-%' OR s LIKE '%...' OR s LIKE '%-'))
SELECT row_id, array_to_string(t, ' ') AS tokens FROM b WHERE len(t) > 0"""
)
def p_23_sentence_preset(spark, d):
    pipe = text.sentence_preset(lambda c: tokenizers.word_punct_tokens(F.lower(c)))
    return pipe.apply(sentences(spark, d), "sent", "t").select("row_id", F.array_join("t", " ").alias("tokens"))


@query(
    rf"""WITH {FILES_SQL} SELECT file_id, s AS out FROM (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\[[a-zA-Z ]*\]', '', 'g'),
'\.( \.)+', '...', 'g'), '\.{{3,}}', '...', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM files) WHERE s <> ''"""
)
def p_23_document_preset(spark, d):
    return text.document_preset().apply(files(spark, d), "raw", "out").select("file_id", "out")


@query()
def p_24_request_preset(spark, d):
    return text.request_preset().apply(table(spark, d, "documents"), "text", "out").select("doc_id", "out")


@query(
    rf"""WITH {SENTS_SQL}, a AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sent, '\.\.\. ?\[[a-zA-Z ]*\] ?\.\.\.', ' ', 'g'), '\[[a-zA-Z ]*\]', '', 'g'),
'\.( \.)+', '...', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS out FROM sents)
SELECT row_id, out FROM a WHERE length(out) > 49 AND NOT (out LIKE '...%' OR out LIKE '-%' OR out LIKE '%...' OR out LIKE '%-')"""
)
def p_25_notebook_preset(spark, d):
    return text.notebook_preset().apply(sentences(spark, d), "sent", "out").select("row_id", "out")


# Tokenizers and syntax -------------------------------------------------------------------------


@query(rf"WITH {SENTS_SQL}, a AS (SELECT row_id, list_filter(regexp_split_to_array(sent, '\s+'), lambda x: x <> '') AS t FROM sents) SELECT row_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM a")
def t01_white_space(spark, d):
    return sentences(spark, d).select("row_id", F.posexplode_outer(tokenizers.white_space_tokens(F.col("sent"))).alias("pos", "token")).where("token is not null")


@query(f"WITH {SENTS_SQL}, a AS (SELECT row_id, {PUNCT_SQL.format('sent')} AS t FROM sents) SELECT row_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM a")
def t02_word_punct(spark, d):
    return sentences(spark, d).select("row_id", F.posexplode_outer(tokenizers.word_punct_tokens(F.col("sent"))).alias("pos", "token")).where("token is not null")


@query(f"WITH {SENTS_SQL}, a AS (SELECT row_id, {_RULE.format('sent')} AS p FROM sents) SELECT row_id, unnest(range(len(p)))::INT AS sent_id, replace(unnest(p), chr(57344), '.') AS part FROM a")
def t03_rule_sentences(spark, d):
    return sentences(spark, d).select("row_id", F.posexplode_outer(tokenizers.rule_sentences(F.col("sent"))).alias("sent_id", "part")).where("part is not null")


@query(f"WITH {SENTS_SQL} SELECT row_id, array_to_string(list_concat(['<S>'], {PUNCT_SQL.format('lower(sent)')}, ['</S>']), ' ') AS tokens FROM sents")
def t05_sentence_tokens(spark, d):
    return sentences(spark, d).select("row_id", F.array_join(tokenizers.sentence_tokens(F.col("sent")), " ").alias("tokens"))


@query(f"WITH {STRETCHES_SQL} SELECT doc, array_to_string(list_filter(t, lambda x: NOT regexp_matches(x, '^{_P}+$') AND NOT regexp_matches(x, '^[0-9.,:]+$')), ' ') AS tokens FROM stretches")
def t20_attribute_filter(spark, d):
    rows = stretches(spark, d).select("doc", F.transform("tokens", lambda t: F.struct(t.alias("text"), t.rlike(f"^{text.PUNCTUATION}+$").alias("is_punct"), t.rlike(r"^[0-9.,:]+$").alias("like_num"))).alias("t"))
    kept = tokenizers.without_attributes(F.col("t"), ["is_punct", "like_num"])
    return rows.select("doc", F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("tokens"))


def _edges(spark, d):
    """A dependency tree of each stretch: tokens 2i + 1 and 2i + 2 hang on token i, the first is the root."""
    rows = stretches(spark, d).select(F.col("doc").alias("sent_id"), F.posexplode("tokens").alias("idx", "word"))
    return rows.select("sent_id", "idx", F.greatest(F.floor((F.col("idx") - 1) / 2), F.lit(0)).cast("int").alias("head"), "word", F.concat(F.lit("d"), F.length("word") % 4).alias("dep"))


_TREE_SQL = f"""{STRETCHES_SQL}, e AS (SELECT doc AS sent_id, t, unnest(range(len(t)))::INT AS idx FROM stretches),
tree AS (SELECT sent_id, idx, (idx - 1) // 2 AS p, ((idx - 1) // 2 - 1) // 2 AS pp, t FROM e)"""


@query(
    f"""WITH {_TREE_SQL} SELECT sent_id, idx, 1 AS n, '_' || t[idx + 1] AS gram FROM tree
UNION ALL SELECT sent_id, idx, 2, '_' || t[idx + 1] || '_' || t[p + 1] FROM tree WHERE idx >= 1
UNION ALL SELECT sent_id, idx, 3, '_' || t[idx + 1] || '_' || t[p + 1] || '_' || t[pp + 1] FROM tree WHERE idx >= 3"""
)
def g01_sn_grams(spark, d):
    return syntax.sn_grams(_edges(spark, d), 1, 3)


@query(
    f"""WITH {_TREE_SQL}, r AS (SELECT sent_id, idx, p, pp, list_transform(t, lambda w: 'd' || (length(w) % 4)) AS t FROM tree) SELECT sent_id, idx, 1 AS n, '_' || t[idx + 1] AS gram FROM r WHERE idx >= 1
UNION ALL SELECT sent_id, idx, 2, '_' || t[idx + 1] || '_' || t[p + 1] FROM r WHERE idx >= 3
UNION ALL SELECT sent_id, idx, 3, '_' || t[idx + 1] || '_' || t[p + 1] || '_' || t[pp + 1] FROM r WHERE idx >= 7"""
)
def g02_relation_grams(spark, d):
    """Chains of relations, which leave out the root."""
    return syntax.sn_grams(_edges(spark, d).withColumn("word", F.col("dep")), 1, 3, labels=True)


@query(
    f"""WITH {_TREE_SQL} SELECT sent_id, 1 AS n, t[idx + 1] AS gram FROM tree
UNION ALL SELECT sent_id, 2, t[p + 1] || '_' || t[idx + 1] FROM tree WHERE idx >= 1
UNION ALL SELECT sent_id, 3, t[pp + 1] || '_' || t[p + 1] || '_' || t[idx + 1] FROM tree WHERE idx >= 3
UNION ALL SELECT sent_id, 3, t[p + 1] || '_' || t[idx] || '_' || t[idx + 1] FROM tree WHERE idx >= 2 AND idx % 2 = 0"""
)
def g03_spanning_grams(spark, d):
    return syntax.spanning_grams(_edges(spark, d), 1, 3)


# Tokenizers over annotations -------------------------------------------------------------------


def _annotated(spark, d):
    """Annotations of every sentence by simple rules, in the place of a tagger and a parser."""
    t = F.col("text")
    rows = sentences(spark, d).select(F.col("row_id").alias("doc"), F.lit(0).alias("sent"), F.posexplode(tokenizers.word_punct_tokens(F.col("sent"))).alias("idx", "text"))
    title, digit = t.rlike("^[A-Z][a-z]+$"), t.rlike("^[0-9]+$")
    return rows.select(
        "doc", "sent", "idx", "text", F.regexp_replace(F.lower(t), "s$", "").alias("lemma"), F.when(title & (F.col("idx") > 0), "NNP").when(digit, "CD").otherwise("NN").alias("tag"),
        F.element_at(F.array(*map(F.lit, ("det", "amod", "nsubj", "prep"))), F.col("idx") % 4 + 1).alias("dep"), F.greatest(F.floor((F.col("idx") - 1) / 2), F.lit(0)).cast("int").alias("head"),
        F.when((F.col("idx") % 6).isin(2, 3), F.floor(F.col("idx") / 6)).alias("ent"), F.when((F.col("idx") % 5).isin(1, 2, 3), F.floor(F.col("idx") / 5)).alias("np"), (F.length(t) % 5).alias("cluster"),
        t.rlike("^[^A-Za-z0-9_]+$").alias("is_punct"), F.lit(False).alias("is_space"), digit.alias("is_digit"), t.rlike("^[0-9.,]+$").alias("like_num"), title.alias("is_title"),
    )


_ANNOTATED_SQL = rf"""{SENTS_SQL}, toks AS (SELECT row_id AS doc, t, unnest(range(len(t)))::INT AS idx FROM (SELECT row_id, {PUNCT_SQL.format("sent")} AS t FROM sents)), w AS (SELECT doc, idx, t[idx + 1] AS text FROM toks),
ann AS (SELECT doc, idx, text, regexp_replace(lower(text), 's$', '') AS lemma, CASE WHEN idx > 0 AND regexp_matches(text, '^[A-Z][a-z]+$') THEN 'NNP' WHEN regexp_matches(text, '^[0-9]+$') THEN 'CD' ELSE 'NN' END AS tag,
  ['det', 'amod', 'nsubj', 'prep'][idx % 4 + 1] AS dep, CASE WHEN idx = 0 THEN 0 ELSE (idx - 1) // 2 END AS head, CASE WHEN idx % 6 IN (2, 3) THEN idx // 6 END AS ent, CASE WHEN idx % 5 IN (1, 2, 3) THEN idx // 5 END AS np,
  length(text) % 5 AS cluster, regexp_matches(text, '^[^A-Za-z0-9_]+$') AS is_punct, regexp_matches(text, '^[0-9]+$') AS is_digit, regexp_matches(text, '^[0-9.,]+$') AS like_num, regexp_matches(text, '^[A-Z][a-z]+$') AS is_title FROM w)"""


def _merge_sql(source: str, span: str, name: str) -> str:
    """Spans of ``source`` as one token each; the tag, relation and head of the first token that links to the rest."""
    first = ", ".join(f"arg_min({c}, idx) AS {c}" for c in ("ent", "np", "cluster", "is_punct", "is_digit", "like_num", "is_title") if c != span)
    root = ", ".join(f"coalesce(arg_min({c}, idx) FILTER (outer_), arg_min({c}, idx)) AS {c}" for c in ("tag", "dep"))
    return f"""{name}_k AS (SELECT *, coalesce('s' || {span}, 't' || idx) AS k FROM {source}), {name}_l AS (SELECT *, min(idx) OVER (PARTITION BY doc, k) AS lo, max(idx) OVER (PARTITION BY doc, k) AS hi FROM {name}_k),
{name}_h AS (SELECT a.* EXCLUDE (head), coalesce(b.lo, a.head) AS head, a.head < a.lo OR a.head > a.hi OR a.head = a.idx AS outer_ FROM {name}_l a LEFT JOIN {name}_l b ON a.doc = b.doc AND a.head = b.idx),
{name} AS (SELECT doc, min(idx) AS idx, string_agg(text, ' ' ORDER BY idx) AS text, string_agg(lemma, ' ' ORDER BY idx) AS lemma, {root}, coalesce(arg_min(head, idx) FILTER (outer_), arg_min(head, idx)) AS head, NULL AS {span}, {first} FROM {name}_h GROUP BY doc, k)"""


def _phrases_sql(source: str, name: str) -> str:
    """Noun phrases from their first kept modifier or their last word on, merged."""
    keeps = "(dep IN ('avmod', 'amod', 'compound') OR idx = max(idx) OVER (PARTITION BY doc, np))"
    return f"""{name}_a AS (SELECT *, {keeps} AS keeps FROM {source}), {name}_b AS (SELECT * EXCLUDE (keeps, np), CASE WHEN bool_or(keeps) OVER (PARTITION BY doc, np ORDER BY idx) THEN np END AS np FROM {name}_a),
{_merge_sql(f"{name}_b", "np", name)}"""


_ENTS_SQL = f"{_ANNOTATED_SQL}, {_merge_sql('ann', 'ent', 'ents')}"
_PHRASES_SQL = f"{_ANNOTATED_SQL}, {_phrases_sql('ann', 'phrases')}"
_BOTH_SQL = f"{_ENTS_SQL}, {_phrases_sql('ents', 'ents_np')}"


def _token_query(name: str, sql: str, source: str, token: str, where: str, merge, **options) -> None:
    def run(spark, d):
        return annotated.tokens(merge(_annotated(spark, d)), **options).select("doc", "idx", "token")

    run.__name__ = name
    query(f"WITH {sql} SELECT doc, idx, {token} AS token FROM {source} WHERE {where}")(run)


_same = lambda df: df
_token_query("t06_lemmas", _ANNOTATED_SQL, "ann", "lemma", "true", _same)
_token_query("t07_no_punct", _ANNOTATED_SQL, "ann", "lemma", "NOT is_punct", _same, punct=False)
_token_query("t08_no_punct_no_numbers", _ANNOTATED_SQL, "ann", "lemma", "NOT is_punct AND NOT is_digit AND NOT like_num", _same, punct=False, numbers=False)
_token_query("t10_merged_phrases", _PHRASES_SQL, "phrases", "lemma", "true", annotated.merge_noun_phrases)
_token_query("t11_merged_entities", _ENTS_SQL, "ents", "lemma", "true", annotated.merge_entities)
_token_query("t12_merged_both", _BOTH_SQL, "ents_np", "lemma", "true", lambda df: annotated.merge_noun_phrases(annotated.merge_entities(df)))
_token_query("t13_cased", _ANNOTATED_SQL, "ann", "CASE WHEN is_title THEN upper(substr(lemma, 1, 1)) || substr(lemma, 2) ELSE lemma END", "true", _same, cased=True)
_token_query("t14_clusters", _ANNOTATED_SQL, "ann", "CASE WHEN cluster <> 0 AND tag <> 'NNP' THEN '**' || cluster || '**' ELSE lemma END", "true", _same, clusters=True)


def _chains_sql(source: str, word: str, labels: bool = False) -> str:
    own = " WHERE up IS NOT NULL" if labels else ""
    return f"""c AS (SELECT doc, idx, CASE WHEN head <> idx THEN head END AS up, {word} AS w FROM {source}), n AS (SELECT * FROM c{own})
SELECT doc, 1 AS n, '_' || w AS gram FROM n UNION ALL SELECT a.doc, 2, '_' || a.w || '_' || b.w FROM n a JOIN n b ON a.doc = b.doc AND a.up = b.idx
UNION ALL SELECT a.doc, 3, '_' || a.w || '_' || b.w || '_' || c.w FROM n a JOIN n b ON a.doc = b.doc AND a.up = b.idx JOIN n c ON a.doc = c.doc AND b.up = c.idx"""


def _sn_query(name: str, sql: str, **options) -> None:
    def run(spark, d):
        return annotated.sn_tokens(_annotated(spark, d), **options).select("sent_id.doc", "n", "gram")

    run.__name__ = name
    query(sql)(run)


_sn_query("t15_sn_lemmas", f"WITH {_ANNOTATED_SQL}, {_chains_sql('ann', 'lemma')}")
_sn_query("t15_sn_tags", f"WITH {_ANNOTATED_SQL}, {_chains_sql('ann', 'tag')}", attribute="tag")
_sn_query("t15_sn_relations", f"WITH {_ANNOTATED_SQL}, {_chains_sql('ann', 'dep', True)}", attribute="dep")
_sn_query("t16_sn_merged", f"WITH {_ENTS_SQL}, {_chains_sql('ents', 'lemma')}", merge="ent")
_sn_query(
    "t17_sn_spanning",
    f"""WITH {_ANNOTATED_SQL}, x AS (SELECT a.doc, a.idx, a.lemma AS w, b.lemma AS pw, c.lemma AS ppw, s.lemma AS sw FROM ann a LEFT JOIN ann b ON a.doc = b.doc AND a.idx >= 1 AND b.idx = a.head
  LEFT JOIN ann c ON a.doc = c.doc AND a.idx >= 3 AND c.idx = b.head LEFT JOIN ann s ON a.doc = s.doc AND a.idx >= 2 AND a.idx % 2 = 0 AND s.idx = a.idx - 1)
SELECT doc, 1 AS n, w AS gram FROM x UNION ALL SELECT doc, 2, pw || '_' || w FROM x WHERE pw IS NOT NULL UNION ALL SELECT doc, 3, ppw || '_' || pw || '_' || w FROM x WHERE ppw IS NOT NULL
UNION ALL SELECT doc, 3, pw || '_' || sw || '_' || w FROM x WHERE sw IS NOT NULL""",
    spanning=True,
)


def _table_query(name: str, sql: str, source: str, merge) -> None:
    def run(spark, d):
        return merge(_annotated(spark, d)).select("doc", "idx", "text", "lemma", "tag", "dep", F.col("head").cast("int").alias("head"))

    run.__name__ = name
    query(f"WITH {sql} SELECT doc, idx, text, lemma, tag, dep, head::INT AS head FROM {source}")(run)


_table_query("t18_merged_phrase_table", _PHRASES_SQL, "phrases", annotated.merge_noun_phrases)
_table_query("t19_merged_entity_table", _ENTS_SQL, "ents", annotated.merge_entities)


# Statistics ------------------------------------------------------------------------------------


@query(f"WITH {WORDS_OF_SPEECH_SQL} SELECT speaker, count(*) AS n, round(avg(len(t)), 6) AS mean, round(1.96 * stddev_pop(len(t)), 6) AS spread FROM spoken GROUP BY speaker")
def e01_length_stats(spark, d):
    return evaluate.length_stats(spoken_words(spark, d), "speaker").select("speaker", "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(f"WITH {WORDS_OF_SPEECH_SQL}, w AS (SELECT speaker, unnest(t) AS x FROM spoken) SELECT speaker, count(*) AS words, count(DISTINCT x) AS types FROM w GROUP BY speaker")
def e02_word_totals(spark, d):
    return evaluate.word_totals(spoken_words(spark, d), "speaker")


STOP = ["the", "a", "of", "to", "and", "in", "that", "is", "we", "i"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query(f"WITH {WORDS_OF_SPEECH_SQL}, w AS (SELECT speaker, unnest(t) AS token FROM spoken) SELECT speaker, token, count(*) AS n FROM w WHERE token NOT IN ({_STOP_SQL}) GROUP BY speaker, token")
def e03_word_counts(spark, d):
    return evaluate.word_counts(spoken_words(spark, d), "speaker", stop=spark.createDataFrame([(w,) for w in STOP], "token string"))


@query(f"WITH {WORDS_OF_SPEECH_SQL}, w AS (SELECT speaker, unnest(t) AS x FROM spoken) SELECT speaker, count(DISTINCT x) AS vocabulary FROM w GROUP BY speaker")
def e04_vocabulary(spark, d):
    return evaluate.word_totals(spoken_words(spark, d), "speaker").select("speaker", F.col("types").alias("vocabulary"))


@query(
    rf"""WITH {SENTS_SQL}, a AS (SELECT 'words' AS tokenizer, {WORDS_SQL.format("sent")} AS t FROM sents UNION ALL SELECT 'word_punct', {PUNCT_SQL.format("sent")} FROM sents),
p AS (SELECT tokenizer, t, unnest(range(1, len(t) + 1)) AS i FROM a),
g AS (SELECT tokenizer, t[i] AS gram FROM p UNION SELECT tokenizer, t[i - 1] || ' ' || t[i] FROM p WHERE i >= 2 UNION SELECT tokenizer, t[i - 2] || ' ' || t[i - 1] || ' ' || t[i] FROM p WHERE i >= 3)
SELECT tokenizer, count(DISTINCT gram) AS vocabulary FROM g GROUP BY tokenizer"""
)
def e05_vocabulary_by_tokenizer(spark, d):
    s = sentences(spark, d)
    rows = s.select(F.lit("words").alias("tokenizer"), tokenizers.lower_words(F.col("sent")).alias("tokens")).unionByName(s.select(F.lit("word_punct").alias("tokenizer"), tokenizers.word_punct_tokens(F.col("sent")).alias("tokens")))
    grams = evaluate.vectorize(rows, "tokenizer", least=1, most=3)
    return grams.groupBy(F.col("doc").alias("tokenizer")).agg(F.count(F.lit(1)).alias("vocabulary"))


@query(
    rf"""WITH {STRETCHES_SQL}, f AS (SELECT doc, list_filter(t, lambda x: x NOT IN ({_STOP_SQL})) AS t FROM stretches), p AS (SELECT doc, t, unnest(range(1, len(t) + 1)) AS i FROM f),
g AS (SELECT doc, t[i] AS gram FROM p UNION ALL SELECT doc, t[i - 1] || ' ' || t[i] FROM p WHERE i >= 2) SELECT doc, gram, count(*) AS n FROM g GROUP BY doc, gram"""
)
def e06_count_vectors(spark, d):
    return evaluate.vectorize(stretches(spark, d), "doc", least=1, most=2, stop=STOP)


@query("SELECT a.i AS w1, b.i AS w2 FROM range(1, 11) a(i), range(1, 11) b(i) WHERE a.i <> b.i")
def e20_weight_grid(spark, d):
    return evaluate.weight_grid(spark, 10)


@query(f"WITH {SPEECH_SQL} SELECT lang, max(length(sent)) AS best FROM speech GROUP BY lang")
def e21_best_by(spark, d):
    return evaluate.best_by(speech(spark, d).withColumn("chars", F.length("sent")), "lang", "chars")


@query(f"WITH {WORDS_OF_SPEECH_SQL} SELECT row_id, len(t) AS n FROM spoken WHERE len(t) > 5")
def e22_least_length(spark, d):
    return spoken_words(spark, d).select("row_id", F.size("tokens").cast("bigint").alias("n")).where("n > 5")


@query(
    f"""WITH {SPEECH_SQL}, r AS (SELECT speaker, sent, row_number() OVER (PARTITION BY speaker ORDER BY row_id) AS n FROM speech),
c AS (SELECT speaker, (n - 1) // 5 AS chunk, string_agg(sent, '|' ORDER BY n) AS s, count(*) AS k FROM r GROUP BY ALL) SELECT speaker, chunk::BIGINT AS chunk, s || repeat('|', (5 - k)::INT) AS items FROM c"""
)
def e23_chunks(spark, d):
    return util.chunked(speech(spark, d), "speaker", "row_id", "sent", 5, "").withColumn("items", F.array_join("items", "|"))


@query(f"WITH {SPEECH_SQL}, s AS (SELECT lang, avg(length(sent)) AS score FROM speech GROUP BY lang) SELECT round(avg(score), 6) AS mean, round(1.96 * stddev_pop(score), 6) AS spread FROM s")
def e18_mean_and_spread(spark, d):
    per = speech(spark, d).groupBy("lang").agg(F.avg(F.length("sent")).alias("score"))
    return evaluate.mean_and_spread(per, "score").select(F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query("SELECT row_id, lang FROM (SELECT DISTINCT row_id, lang FROM clean_sents WHERE row_id IS NOT NULL) ORDER BY row_id LIMIT 5000")
def e26_ordered_slice(spark, d):
    return table(spark, d, "clean_sents").where("row_id is not null").select("row_id", "lang").distinct().orderBy("row_id").limit(5000)


# Utilities -------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id IS NOT NULL ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def u01_sample(spark, d):
    return util.sample(table(spark, d, "documents").where("doc_id is not null").select("doc_id", "source"), "doc_id", 100, 7)


@query("SELECT proc_id, token, count(*) AS n FROM (SELECT proc_id, unnest(flatten(sents)) AS token FROM processed WHERE sents IS NOT NULL) GROUP BY proc_id, token")
def u02_flatten(spark, d):
    return table(spark, d, "processed").select("proc_id", F.explode(util.flatten(F.col("sents"))).alias("token")).groupBy("proc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT proc_id, array_to_string(list_transform(flatten(sents), lambda t: upper(t)), ' ') AS tokens FROM processed WHERE sents IS NOT NULL")
def u03_nested_map(spark, d):
    return table(spark, d, "processed").where("sents is not null").select("proc_id", F.array_join(F.flatten(util.nested_map(F.col("sents"), F.upper)), " ").alias("tokens")).distinct()


@query(
    f"""WITH {SPEECH_SQL}, r AS (SELECT speaker, row_id, row_number() OVER (PARTITION BY speaker ORDER BY row_id) AS n FROM speech)
SELECT speaker, ((n - 1) // 7)::BIGINT AS chunk, string_agg(row_id::VARCHAR, ',' ORDER BY n) AS items FROM r GROUP BY ALL"""
)
def u04_chunks(spark, d):
    return util.chunked(speech(spark, d), "speaker", "row_id", "row_id", 7).withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {STRETCHES_SQL}, e AS (SELECT doc, unnest(range(len(t))) AS pos, unnest(t) AS token FROM stretches), f AS (SELECT token, min((doc, pos)) AS first_at FROM e GROUP BY token)
SELECT token, row_number() OVER (ORDER BY first_at) - 1 AS id FROM f"""
)
def u05_token_dictionary(spark, d):
    rows = stretches(spark, d).select("doc", F.posexplode("tokens").alias("pos", "token"))
    return util.token_dictionary(rows, ["doc", "pos"], "token")


@query(f"WITH {SENTS_SQL} SELECT row_id, row_number() OVER (ORDER BY md5('3:' || row_id), row_id) AS place FROM sents")
def e25_shuffled(spark, d):
    return util.shuffled(sentences(spark, d).select("row_id"), "row_id", 3)
