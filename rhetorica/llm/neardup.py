"""Near-duplicate records with small edits (problem 6).

Method: circulant MinHash. The set of words of a record is hashed into ``UNIVERSE`` slots and
passed through a first permutation; the second permutation is shifted circularly, once for each
coordinate, so two permutations give the whole signature. Because the shifts are circular, all
coordinates of one word are a contiguous slice of the second permutation, and a signature is the
element-wise minimum of such slices. Coordinates are banded; records that share a band are
candidates, and every candidate pair is verified by the exact Jaccard similarity of its word sets.

Records with the same word set are one class from the start: only classes are banded and compared,
so copies are never paired with each other on the way. Bands of two records can only lead to a
pair if their set sizes allow the similarity, which is checked before anything is gathered; so is
a sketch of 64 parities: each word flips one bit, so the bits in which two sketches differ are at
most as many as the words that only one of the sets holds. Both checks are bounds and leave out no
pair. Without the sketch, texts made from the same phrases (similarity 0.3 to 0.6) share so many
bands by chance that candidates grow with the square of the classes, and so does the disk that their join takes.
No bucket is capped: a large one is paired by a join, which AQE splits. Buckets that hold a
noticeable share of all classes are found beforehand from a sample of the classes and their rows
are spread over all tasks instead of meeting in one; the sample only decides where rows go, never
which pairs come out. Bands are shuffled and paired a few at a time, and their shuffle files go
before the next ones come, so the disk that they take doesn't depend on the number of bands.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIVERSE = 1 << 20
ROWS = 8  # coordinates of a band
WIDE = 2_000  # classes in one bucket, beyond which a join pairs them
HOT_SAMPLE = 50_000  # classes, about, among which hot buckets are looked for
HOT = 20  # of them in one bucket make it hot; buckets that are missed hold about a thousandth of the classes at most
AT_ONCE = 10  # bands that are shuffled together
BANDS = 40  # a pair at similarity 0.78 is missed with a chance of 0.3 %, at 0.85 of 1e-6


@lru_cache(maxsize=4)
def permutations(universe: int, seed: int = 20260) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second stands twice in a row, so that a circular slice is a plain one."""
    rng = np.random.default_rng(seed)
    first, second = rng.permutation(universe).astype(np.int32), rng.permutation(universe).astype(np.int32)
    return first, np.concatenate([second, second])


def slots(words: list[str], universe: int = UNIVERSE) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) % universe for w in words], np.int64)


def signature(slot: np.ndarray, k: int, universe: int = UNIVERSE) -> np.ndarray:
    """The k coordinates of a set of slots: coordinate i is the least value of the second
    permutation, shifted by i, over the slots after the first permutation."""
    first, second = permutations(universe)
    return np.lib.stride_tricks.sliding_window_view(second, k)[first[slot]].min(axis=0)


def band_keys(sig: np.ndarray, rows: int, bands: int, first: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each signature (the last axis); the band's number, from ``first``, is part of it."""
    m = sig.reshape(*sig.shape[:-1], bands, rows)
    with np.errstate(over="ignore"):
        h = np.arange(first + 1, first + bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            h = (h ^ m[..., j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def parity(digest: int) -> int:
    """The bit of the sketch that a word flips; its slot comes from other bits of the digest."""
    return 1 << (digest >> 58)


def word_sets(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, cls, n, words) of every text with at least ``least`` different words; cls is a hash
    of the sorted set, words the set joined by spaces."""
    from rhetorica.llm.forms import WORD, default_folder

    fold = default_folder()
    # Of n words in plain ASCII the text has n - 1 separators and n letters at least.
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where(
        F.col("id").isNotNull() & ((F.length("t") >= 2 * least - 1) | F.col("t").rlike(r"[^\x00-\x7F]"))
    )

    def build(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = set(WORD.findall(fold(t).lower()))
                if len(w) >= least:
                    joined = " ".join(sorted(w))
                    out.append((i, xxhash.xxh3_64_intdigest(joined) - (1 << 63), len(w), joined))
            ids, cls, n, words = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "cls": pa.array(cls, pa.int64()), "n": pa.array(n, pa.int32()), "words": pa.array(words, pa.string())})

    return rows.mapInArrow(build, "id bigint, cls bigint, n int, words string")


def banded(sets: DataFrame, rows: int, bands: int, begin: int = 0) -> DataFrame:
    """(key, cls, n, sketch) for each of ``bands`` bands, from number ``begin``, of each class."""
    k = rows * bands

    def build(batches: Iterable[pa.RecordBatch]):
        known: dict[str, tuple[int, int]] = {}
        first, second = permutations(UNIVERSE)
        slices = np.lib.stride_tricks.sliding_window_view(second[begin * rows :], k)  # the coordinates of these bands
        for b in batches:
            sig, sketch = np.empty((b.num_rows, k), np.int32), np.empty(b.num_rows, np.uint64)
            for r, w in enumerate(b.column("words").to_pylist()):
                slot, bits = [], 0
                for x in w.split(" "):
                    s = known.get(x)
                    if s is None:
                        h = xxhash.xxh3_64_intdigest(x)
                        s = h % UNIVERSE, parity(h)
                        if len(known) < 500_000:
                            known[x] = s
                    slot.append(s[0])
                    bits ^= s[1]
                sketch[r] = bits
                slices[first[slot]].min(axis=0, out=sig[r])
            keys = band_keys(sig, rows, bands, begin)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys.ravel()), "cls": pa.array(np.repeat(b.column("cls").to_numpy(), bands)), "n": pa.array(np.repeat(b.column("n").to_numpy(), bands), pa.int32()),
                "sketch": pa.array(np.repeat(sketch.view(np.int64), bands)),
            })

    return sets.select("cls", "n", "words").mapInArrow(build, "key bigint, cls bigint, n int, sketch bigint")


def hot_keys(every: DataFrame, rows: int, bands: int, sample: int = HOT_SAMPLE, hot: int = HOT) -> DataFrame | None:
    """(key) of the bands that ``hot`` or more of about ``sample`` classes share, None if there are
    none; at most ``sample * bands / hot`` keys. every: (cls, n, words) with repeats."""
    n = every.count()
    part = every.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, n // sample))) == 0).dropDuplicates(["cls"])
    found = [(r.key,) for r in banded(part, rows, bands).groupBy("key").count().where(F.col("count") >= hot).select("key").collect()]
    return every.sparkSession.createDataFrame(found, "key bigint") if found else None


def spread(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, cls, n, sketch, hot), each key in one sorted partition but for the hot ones, which are spread by class."""
    if hot is None:
        return keyed.withColumn("hot", F.lit(False)).repartition("key").sortWithinPartitions("key")
    marked = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").select("key", "cls", "n", "sketch", F.coalesce("hot", F.lit(False)).alias("hot"))  # the number of hot keys is bounded
    return marked.repartition(F.when(F.col("hot"), F.xxhash64("key", "cls")).otherwise(F.col("key"))).sortWithinPartitions("hot", "key")


def bucket_pairs(keyed: DataFrame, threshold: float, most: int = WIDE, hot: DataFrame | None = None) -> DataFrame:
    """(cls_a, cls_b) of classes that share a band and whose sizes and sketches allow the similarity, repeats included.

    One shuffle by key, then each sorted partition is read run by run. A bucket of more than
    ``most`` classes, and a hot one, leaves its task as it came and is paired by a join, which AQE can split.
    """
    from rhetorica.sources.tables import stored

    apart = (1 - threshold) / (1 + threshold)  # of both sizes, the words that only one of two sets may hold

    def pair(batches: Iterable[pa.RecordBatch]):
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32), np.zeros(0, np.int64)]
        wide: int | None = None  # the key of a wide bucket that is being passed on

        def out(a, b, key, n, sketch):
            return pa.RecordBatch.from_pydict({"cls_a": pa.array(a, pa.int64()), "cls_b": b, "key": key, "n": n, "sketch": sketch})

        def passed(key, cls, n, sketch):
            return out(cls, pa.nulls(len(cls), pa.int64()), pa.array(key), pa.array(n, pa.int32()), pa.array(sketch))

        def close(key, cls, n, sketch):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            xs, ys = [], []
            for m in np.unique(size[(size > 1) & (size <= most)]):
                i, j = np.triu_indices(m, 1)
                first = start[size == m]
                step = max(1, 2_000_000 // len(i))
                for k in range(0, len(first), step):
                    x = (first[k : k + step, None] + i).ravel()
                    y = (first[k : k + step, None] + j).ravel()
                    ok = (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9) & (cls[x] != cls[y])
                    x, y = x[ok], y[ok]
                    ok = np.bitwise_count(sketch[x].view(np.uint64) ^ sketch[y].view(np.uint64)) <= apart * (n[x] + n[y]) + 1e-9
                    xs.append(x[ok])
                    ys.append(y[ok])
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                pairs = np.unique(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield out(pairs[0], pa.array(pairs[1], pa.int64()), none, none.cast(pa.int32()), none)
            many = np.repeat(size > most, size)
            if many.any():
                yield passed(key[many], cls[many], n[many], sketch[many])

        for b in batches:
            late = b.column(4).to_numpy(zero_copy_only=False)
            if late.any():  # these come last in a partition
                yield passed(*(x.to_numpy()[late] for x in b.columns[:4]))
                b = b.filter(pa.array(~late))
            key, cls, n, sketch = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns[:4]))
            if not len(key):
                continue
            if wide is not None:
                k = int(np.searchsorted(key != wide, True)) if key[0] == wide else 0
                if k:
                    yield passed(key[:k], cls[:k], n[:k], sketch[:k])
                    key, cls, n, sketch = key[k:], cls[k:], n[k:], sketch[k:]
                if len(key):
                    wide = None
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            yield from close(key[:last], cls[:last], n[:last], sketch[:last])
            held = [key[last:], cls[last:], n[last:], sketch[last:]]
            if len(held[0]) > most:
                wide = int(held[0][0])
                yield from close(*held)
                held = [x[:0] for x in held]
        yield from close(*held)

    got = stored(spread(keyed, hot).mapInArrow(pair, "cls_a bigint, cls_b bigint, key bigint, n int, sketch bigint"), "bucket-pairs", free=True)
    wide = got.where("cls_b is null").select("key", F.col("cls_a").alias("cls"), "n", "sketch")
    fits = F.expr("x.cls < y.cls") & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9)
    fits &= F.expr("bit_count(x.sketch ^ y.sketch)") <= apart * (F.col("x.n") + F.col("y.n")) + 1e-9
    joined = wide.alias("x").join(wide.alias("y"), F.expr("x.key = y.key")).where(fits).select(F.col("x.cls").alias("cls_a"), F.col("y.cls").alias("cls_b"))
    return got.where("cls_b is not null").select("cls_a", "cls_b").unionByName(joined)


class Links:
    """Similar classes and their members: ``classes`` (cls_a < cls_b, similarity) and ``members`` (id, cls)."""

    def __init__(self, members: DataFrame, classes: DataFrame) -> None:
        self.members, self.classes = members, classes

    def pairs(self) -> DataFrame:
        """Every pair of ids (id_a < id_b), those of one class included."""
        m = self.members
        same = m.alias("x").join(m.alias("y"), "cls").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
        a, b = m.select(F.col("cls").alias("cls_a"), F.col("id").alias("ia")), m.select(F.col("cls").alias("cls_b"), F.col("id").alias("ib"))
        other = self.classes.join(a, "cls_a").join(b, "cls_b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        return same.unionByName(other)

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): one row per id with the id of its class of equal word
        sets, of its group of linked records (both the least id in it) and the number of records
        that it is linked to."""
        from rhetorica.llm.components import components

        size = self.members.groupBy("cls").agg(F.count("id").alias("size"), F.min("id").alias("class_id"))
        ends = self.classes.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(self.classes.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
        links = ends.join(size.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("others"))
        comp = components(self.classes.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
        per = (
            size.join(links, "cls", "left").join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left")
            .select("cls", "class_id", F.coalesce("root", "cls").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
        )
        named = per.groupBy("root").agg(F.min("class_id").alias("group_id"))
        return self.members.join(per.join(named, "root").drop("root"), "cls").select("id", "class_id", "group_id", "links")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, least_words: int = 1, rows: int = ROWS, bands: int = BANDS, wide: int = WIDE, hot: int = HOT, at_once: int = AT_ONCE) -> Links:
    """Links between texts whose sets of words have a Jaccard similarity of ``threshold`` or more.

    Repeated deliveries of an id count once; null texts and texts with fewer than ``least_words``
    different words are in no set; an empty table gives no links. A similarity of exactly the
    threshold counts.
    """
    from rhetorica.sources.tables import stored

    every = stored(word_sets(df, id_col, text_col, max(least_words, 1)), "word-sets")
    members = every.select("id", "cls").distinct()
    fit = F.col("n") >= threshold * (F.col("n") + 1) - 1e-9  # a smaller set is similar to no other: one word more or less is too much
    sets = stored(every.select("cls", "n", "words").where(fit).dropDuplicates(["cls"]), "distinct-sets", free=True)
    hot_ones = hot_keys(sets, rows, bands, hot=hot)
    parts = [bucket_pairs(banded(sets, rows, min(at_once, bands - k), k), threshold, wide, hot_ones) for k in range(0, bands, at_once)]
    candidates = stored(reduce(DataFrame.unionByName, parts).distinct(), "candidates", free=True)
    ends = candidates.select(F.col("cls_a").alias("cls")).unionByName(candidates.select(F.col("cls_b").alias("cls"))).distinct()
    used = stored(sets.select("cls", F.split("words", " ").alias("w")).join(ends, "cls", "left_semi"), "candidate-sets", free=True)
    common = F.size(F.array_intersect("wa", "wb"))
    similarity = common / (F.size("wa") + F.size("wb") - common)
    verified = (
        candidates.join(used.select(F.col("cls").alias("cls_a"), F.col("w").alias("wa")), "cls_a").join(used.select(F.col("cls").alias("cls_b"), F.col("w").alias("wb")), "cls_b")
        .withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-12).select("cls_a", "cls_b", "similarity")
    )
    return Links(members, stored(verified, "links", free=True))
