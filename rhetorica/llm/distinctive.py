"""How characteristic each term of a record is, compared with the whole collection (problem 1).

Method: graph of words. Within every text, words at most ``window - 1`` apart are joined by an
edge; a term's weight in a record is the number of its distinct neighbours there (not its
frequency, so a word repeated in one phrase gains nothing), times the term's rarity in the
collection. Rarity is the logarithm of the number of records over the number of records that
effectively hold the term: the inverse Simpson index of its weight shares, each record's weights
being relative to the record's size. It equals the usual inverse record frequency for terms
spread evenly, and doesn't collapse when a few stray uses occur elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhetorica.llm.arrays import distinct
from rhetorica.llm.forms import Folder, default_folder

NEW_EDGES = 1_500_000  # edges that a task gathers before it drops repeated ones
MOST_EDGES = 3_000_000  # distinct edges that a task holds before it emits them
MOST_WORDS = 1_000_000  # different words that a task holds before it emits its edges
MASK = (1 << 24) - 1
SALT = 8  # parts of a frequent term's edges


def word_lists(texts: pa.Array, fold: Folder) -> pa.ListArray:
    """Words of each text (consistent form, lower case) as a list array; null gives an empty list."""
    shown = pa.array([fold(x) or "" if x is not None else "" for x in texts.to_pylist()], pa.string())
    return pc.split_pattern_regex(pc.utf8_lower(shown), r"[^\pL\pN]+")


def edges(df: DataFrame, record_col: str, text_col: str, window: int = 3) -> DataFrame:
    """The edges of each record's graph and the terms, as hashes: rows (record, x, y, null) are
    edges, rows (null, x, null, term) say which term a hash stands for.

    Edges have no direction and come once. Each task drops the repeats among the edges that it
    holds, so the shuffle gets pre-aggregated rows in sorted runs, which compress well. A word
    without a neighbour gets an edge to itself, so that it still counts for the record.
    """
    fold = default_folder()

    def build(batches: Iterable[pa.RecordBatch]):
        vocab: dict[str, int] = {}
        recs: dict[str, int] = {}
        seen, new, n = np.zeros(0, np.int64), [], 0

        def flush():
            names = list(vocab)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) >> 16 for w in names], np.int64)
            records = pa.array(list(recs), pa.string())
            for k in range(0, len(seen), 100_000):
                e = seen[k : k + 100_000]
                record = pa.DictionaryArray.from_arrays(pa.array(e >> 48, pa.int32()), records).dictionary_decode()
                yield pa.RecordBatch.from_pydict({"record": record, "x": pa.array(hashes[(e >> 24) & MASK]), "y": pa.array(hashes[e & MASK]), "term": pa.nulls(len(e), pa.string())})
            for k in range(0, len(names), 100_000):
                part = names[k : k + 100_000]
                yield pa.RecordBatch.from_pydict({"record": pa.nulls(len(part), pa.string()), "x": pa.array(hashes[k : k + 100_000]), "y": pa.nulls(len(part), pa.int64()), "term": pa.array(part, pa.string())})

        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                lists = word_lists(part.column(1), fold)
                flat = lists.flatten()
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                enc = flat.dictionary_encode()
                lut = np.array([vocab.setdefault(w, len(vocab)) for w in enc.dictionary.to_pylist()], np.int64)
                code, rows = lut[enc.indices.to_numpy()][full], rows[full]
                rec = np.array([recs.setdefault(x, len(recs)) for x in part.column(0).to_pylist()], np.int64)[rows] << 48
                alone = np.ones(len(code), bool)
                for d in range(1, window):
                    same = rows[d:] == rows[:-d]
                    x, y, r = code[:-d][same], code[d:][same], rec[d:][same]
                    new.append(r | np.minimum(x, y) << 24 | np.maximum(x, y))
                    n += len(x)
                    if d == 1:
                        alone[1:][same] = False
                        alone[:-1][same] = False
                new.append(rec[alone] | code[alone] << 24 | code[alone])
                if n >= NEW_EDGES:
                    seen, new, n = distinct(np.concatenate([seen, *new])), [], 0
                if len(seen) >= MOST_EDGES or len(vocab) > MOST_WORDS or len(recs) > 30_000:
                    seen = distinct(np.concatenate([seen, *new]))
                    yield from flush()
                    seen, new, n, vocab, recs = seen[:0], [], 0, {}, {}
        seen = distinct(np.concatenate([seen, *new]))
        yield from flush()

    rows = df.select(F.col(record_col).cast("string").alias("record"), F.col(text_col).alias("text")).where("record is not null and text is not null")
    return rows.mapInArrow(build, "record string, x bigint, y bigint, term string")


def degrees(df: DataFrame, record_col: str, text_col: str, window: int = 3) -> DataFrame:
    """(record, term, degree): the number of distinct neighbours of each word in each record."""
    from rhetorica.sources.tables import stored

    # The order of two words differs from task to task, so it's that of their hashes from here on.
    e = edges(df, record_col, text_col, window)
    low, high = F.coalesce(F.least("x", "y"), "x").alias("x"), F.when(F.col("y").isNotNull(), F.greatest("x", "y")).alias("y")
    spread = e.select("record", low, high, "term").withColumn("salt", F.pmod(F.coalesce("y", F.lit(0)), F.lit(SALT)).cast("int")).repartition("record", "x", "salt")
    once = spread.groupBy("record", "x", "salt", "y", "term").agg(F.lit(1).alias("one"))
    ends = F.when(F.col("y").isNull() | (F.col("x") == F.col("y")), F.array("x")).otherwise(F.array("x", "y"))
    counted = once.select("record", "term", F.explode(ends).alias("h")).groupBy("record", "h", "term").agg(F.count(F.lit(1)).alias("degree"))
    counted = stored(counted, "degrees")
    terms = counted.where("term is not null").select("h", "term")
    return counted.where("term is null").select("record", "h", "degree").join(terms, "h").groupBy("record", "term").agg(F.max("degree").alias("degree"))


def scores(df: DataFrame, record_col: str, text_col: str, window: int = 3) -> DataFrame:
    """(record, term, degree, score) for every word of every record.

    df: one row per text of a record. Null records and null texts count nothing; an empty text has
    no words; repeated texts add no neighbours. An empty table gives no rows.
    """
    from rhetorica.sources.tables import stored

    degree = stored(degrees(df, record_col, text_col, window), "record-terms")
    size = degree.groupBy("record").agg(F.sum("degree").alias("size"))
    share = degree.join(size, "record").withColumn("share", F.col("degree") / F.col("size"))
    rare = share.groupBy("term").agg((F.sum("share") * F.sum("share") / F.sum(F.col("share") * F.col("share"))).alias("held_by"))
    n = degree.select(F.countDistinct("record").alias("n"))
    return (
        degree.join(rare, "term").crossJoin(F.broadcast(n))  # n is one row
        .select("record", "term", "degree", (F.col("degree") * F.log(F.col("n") / F.col("held_by"))).alias("score"))
    )


def labelled_sentences(sents: DataFrame, labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """(row_id, sent, speaker, role): each sentence once, with the speaker its label names.

    A label names a speaker if stripping ' :[]' and upper-casing gives the speaker's name. Where
    deliveries of a ``row_id`` differ, the latest counts; rows without a speaker are left out.
    """
    from rhetorica.llm.frequency import latest

    who = speakers.where("speaker is not null").select("speaker", "role").dropDuplicates(["speaker"])
    if len(who.take(10_001)) <= 10_000:  # a checked bound; beyond it the join shuffles
        who = F.broadcast(who)
    lab = latest(labels, "row_id", ["label"], "labelled_at").select(F.col("id").alias("row_id"), F.upper(F.btrim("label", F.lit(" :[]"))).alias("speaker"))
    lab = lab.join(who, "speaker")
    one = latest(sents, "row_id", ["sent"], "loaded_at").select(F.col("id").alias("row_id"), "sent")
    return one.join(lab, "row_id")


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """The k best terms of each record (ties: the term that sorts first)."""
    w = Window.partitionBy("record").orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
