"""How often every distinct value or term occurs, and in how many records (problem 2).

Method: vertical layout. Each task builds, for every term and every block of 65,536 record ids, a
compressed bitmap of the records that hold the term (a sorted array of 16-bit numbers, or a plain
bitmap where that is smaller) together with a counter of occurrences. Bitmaps of a term and block
are merged by union; document frequency is their cardinality.

A term that a third of all records hold is spread over as many keys as there are blocks, and each
key's bitmap has at most 8 KiB, so no task ever gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
ARRAY_MOST = 4096  # beyond this many numbers a bitmap of 8 KiB is smaller than an array
FLUSH_PAIRS = 2_000_000  # (record, term) pairs that a task holds before it emits bitmaps
_SCHEMA = "field string, term string, block bigint, bits binary, occurrences bigint"


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct numbers under 65,536 as a container."""
    if len(low) <= ARRAY_MOST:
        return b"a" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype("<u2")


def union(containers: list[bytes]) -> bytes:
    if len(containers) == 1:
        return containers[0]
    if sum(len(c) // 2 for c in containers) <= 2 * ARRAY_MOST and all(c[:1] == b"a" for c in containers):
        return pack(np.unique(np.concatenate([unpack(c) for c in containers])))
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    for c in containers:
        bits[unpack(c)] = 1
    return pack(np.flatnonzero(bits))


def cardinality(data: bytes) -> int:
    if data[:1] == b"a":
        return (len(data) - 1) // 2
    return int(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).sum())


def _emit(field: str, names: list[str], rec: np.ndarray, code: np.ndarray, weight: np.ndarray) -> Iterable[pa.RecordBatch]:
    """Containers of the (record, term) pairs; weight: occurrences of each."""
    if not len(rec):
        return
    block = rec >> BLOCK_BITS
    order = np.lexsort((rec, block, code))
    rec, code, block, weight = rec[order], code[order], block[order], weight[order]
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[start[1:], len(rec)]
    occ = np.add.reduceat(weight, start)
    bits = [pack(np.unique(rec[i:j] & 0xFFFF)) for i, j in zip(start, ends)]
    for k in range(0, len(start), 50_000):
        s = slice(k, k + 50_000)
        yield pa.RecordBatch.from_pydict({
            "field": pa.array([field] * len(bits[s])), "term": pa.array([names[c] for c in code[start[s]]], pa.string()),
            "block": pa.array(block[start[s]], pa.int64()), "bits": pa.array(bits[s], pa.binary()), "occurrences": pa.array(occ[s], pa.int64()),
        })


def vertical(df: DataFrame, id_col: str, terms_col: str, field: str, form=None) -> DataFrame:
    """Bitmaps by term and block from an array<string> column of one row per record.

    form: maps a stored term to the counted one; terms that become null or empty are none.
    Null arrays and null terms count nothing. Negative ids are allowed.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(terms_col).alias("terms")).where("id is not null and terms is not null")

    def build(batches: Iterable[pa.RecordBatch]):
        known: dict[str, int] = {}
        codes: dict[str, int] = {}  # stored term -> code, -1 for none
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().dictionary_encode()
            local = []
            for t in flat.dictionary.to_pylist():
                if t not in codes:
                    shown = None if t is None else form(t) if form else t
                    codes[t] = -1 if shown is None or form and not shown else known.setdefault(shown, len(known))
                    if codes[t] == len(names):
                        names.append(shown)
                local.append(codes[t])
            idx = flat.indices
            ids = np.repeat(b.column(0).to_numpy(), lengths)
            lut = np.array([*local, -1], np.int64)
            code = lut[idx.fill_null(len(local)).to_numpy(zero_copy_only=False)]
            keep = code >= 0
            held.append((ids[keep], code[keep]))
            n += int(keep.sum())
            if n >= FLUSH_PAIRS:
                yield from _flush(field, names, held)
                held, n, known, codes, names = [], 0, {}, {}, []
        yield from _flush(field, names, held)

    return rows.mapInArrow(build, _SCHEMA)


def _flush(field, names, held):
    if held:
        rec, code = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((rec, code))
        rec, code = rec[order], code[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (rec[1:] != rec[:-1])]) if len(rec) else np.zeros(0, np.int64)
        weight = np.diff(np.r_[start, len(rec)])
        yield from _emit(field, names, rec[start], code[start], weight)


def merged(bitmaps: DataFrame) -> DataFrame:
    """One bitmap per field, term and block: the union of those of all tasks."""

    def merge(batches: Iterable[pa.RecordBatch]):
        key, bits, occ, out = None, [], 0, []
        schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("block", pa.int64()), ("bits", pa.binary()), ("occurrences", pa.int64()), ("records", pa.int64())])

        def done():
            u = union(bits)
            out.append((*key, u, occ, cardinality(u)))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for f, t, k, x, n in zip(*(c.to_pylist() for c in b.columns)):
                if (f, t, k) != key:
                    if key is not None:
                        done()
                    key, bits, occ = (f, t, k), [], 0
                bits.append(x)
                occ += n
                if len(bits) > 64:
                    bits = [union(bits)]
                if len(out) >= 20_000:
                    yield batch()
                    out.clear()
        if key is not None:
            done()
        if out:
            yield batch()

    keys = ["field", "term", "block"]
    return bitmaps.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, f"{_SCHEMA}, records bigint")


def term_counts(bitmaps: DataFrame, n_records: int, rare_below: int, common_share: dict[str, float]) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is 'rare' for fewer than ``rare_below``
    records, 'common' for more than the field's share of ``n_records``, else null."""
    by = merged(bitmaps).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    too_many = F.lit(False)
    for field, share in common_share.items():
        too_many = too_many | ((F.col("field") == field) & (F.col("records") > share * n_records))
    return by.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(too_many, "common"))


def latest(df: DataFrame, id_col: str, payload: list[str], order_col: str) -> DataFrame:
    """One row per id: the payload of the latest delivery; a null time is the earliest."""
    best = F.max_by(F.struct(*payload), F.coalesce(F.col(order_col), F.lit("0001-01-01").cast("timestamp")))
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(best.alias("p")).select("id", "p.*")


def processed_counts(processed: DataFrame, rare_below: int = 3, token_share: float = 0.25, value_share: float = 0.04) -> DataFrame:
    """Counts of every token of ``sents`` (consistent form) and every value of ``num_word_types``
    over all records; deliveries repeated under one ``proc_id`` count once.

    A null or empty ``sents`` holds no token, a null ``num_word_types`` no value; an empty table
    gives no rows.
    """
    from rhetorica.llm.forms import default_folder
    from rhetorica.sources.tables import stored

    one = latest(processed, "proc_id", ["sents", "num_word_types"], "loaded_at")
    one = stored(one.select("id", F.flatten(F.filter("sents", lambda s: s.isNotNull())).alias("tokens"), F.col("num_word_types").cast("string").alias("value")), "records")
    n = one.count()
    tokens = vertical(one, "id", "tokens", "sents", default_folder())
    values = vertical(one.where("value is not null").select("id", F.array("value").alias("v")), "id", "v", "num_word_types")
    return term_counts(tokens.unionByName(values), n, rare_below, {"sents": token_share, "num_word_types": value_share})
