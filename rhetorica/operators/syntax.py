"""Syntactic n-grams from dependency edges.

Input: one row per token (sent_id, idx, head, word, dep); the root's head is itself or null, and an
idx stands once in its sentence. A gram is a chain of tokens from a node up towards the root.

Tokens of a sentence are gathered once, which needs no shuffle where they come from its own row, and
grams are made on Arrow batches of whole sentences, so nothing is joined token by token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Tokens of whole sentences, and sets that grow, which are held at once.
TOKENS = 50_000
SETS = 500_000


def sn_grams(edges: DataFrame, least: int = 1, most: int = 3, labels: bool = False, by: Sequence[str] = ("sent_id",)) -> DataFrame:
    """(sent_id, idx, n, gram) of each chain node, parent, ... of ``least`` to ``most`` tokens.

    Grams read child first, every token preceded by an underscore. With ``labels`` the grams are of
    relation names and the root isn't part of them. ``by``: the columns that name a sentence.
    """

    def chains(word: pa.Array, up: np.ndarray, has_up: np.ndarray) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
        first = np.flatnonzero(has_up) if labels else np.arange(len(up))
        top, gram = first, pc.binary_join_element_wise("", word.take(pa.array(first)), "_")
        for n in range(1, most + 1):
            if n > 1:
                after = up[top]
                on = after >= 0
                if labels:
                    on &= has_up[after]
                first, top = first[on], after[on]
                gram = pc.binary_join_element_wise(gram.filter(pa.array(on)), word.take(pa.array(top)), "_")
            if n >= least:
                yield first, n, gram

    return _per_sentence(edges, by, chains, ["idx"])


def spanning_grams(edges: DataFrame, least: int = 1, most: int = 3, by: Sequence[str] = ("sent_id",)) -> DataFrame:
    """(sent_id, n, gram) of the connected sets of up to ``most`` tokens in the tree, each once,
    its words in order of position and joined by underscores. ``by``: the columns that name a sentence.

    The walks that this stands for turn back at a node with several children on one side. Here a set
    grows from its top by children that come later than the last one added, level by level, so every
    connected set comes exactly once. Heads that go in circles would make a set from each of its
    tokens; sets are made distinct there.
    """

    def sets(word: pa.Array, up: np.ndarray, has_up: np.ndarray) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
        size = len(up)
        child = np.argsort(up, kind="stable")[np.count_nonzero(up < 0) :]
        begin = np.searchsorted(up[child], np.arange(size))
        end = np.searchsorted(up[child], np.arange(size), side="right")

        def grown(members: np.ndarray, at: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
            """The sets themselves and those grown from them; at: the member whose child came last, last: that child's place."""
            yield members
            n = members.shape[1]
            if n == most:
                return
            # children of the member at ``at`` after ``last``, and of the members after it
            which = np.arange(n)
            start = np.where(which == at[:, None], last[:, None] + 1, begin[members])
            count = np.where(which >= at[:, None], np.maximum(end[members] - start, 0), 0)
            total = np.cumsum(count.sum(1))
            for part in np.split(np.arange(len(members)), np.searchsorted(total, np.arange(SETS, total[-1] if len(total) else 0, SETS))):
                c, s = count[part].ravel(), start[part].ravel()
                if not c.sum():
                    continue
                place = np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                own = np.repeat(np.repeat(part, n), c)
                new, old = child[place], members[own]
                fresh = ~(old == new[:, None]).any(1)
                yield from grown(np.concatenate([old, new[:, None]], 1)[fresh], np.repeat(np.tile(which, len(part)), c)[fresh], place[fresh])

        top = up
        for _ in range(max(1, size).bit_length()):
            top = np.where(top >= 0, top[top], -1)
        every = np.arange(size)[:, None]
        found = grown(every, np.zeros(size, int), begin - 1)
        if (top >= 0).any():
            by_size: dict[int, list] = {}
            for x in found:
                by_size.setdefault(x.shape[1], []).append(np.sort(x, 1))
            found = iter([np.unique(np.concatenate(x), axis=0) for x in by_size.values()])
        for members in found:
            n = members.shape[1]
            if n >= least and len(members):
                members = np.sort(members, 1)
                gram = word.take(pa.array(members[:, 0]))
                for k in range(1, n):  # words that are null are left out
                    more = word.take(pa.array(members[:, k]))
                    gram = pc.coalesce(pc.binary_join_element_wise(gram, more, "_"), gram, more)
                yield members[:, 0], n, pc.fill_null(gram, "")

    return _per_sentence(edges.where("idx is not null"), by, sets, [])


def _per_sentence(edges: DataFrame, by: Sequence[str], grams: Callable, keep: list[str]) -> DataFrame:
    """``by``, the token's columns ``keep``, n and gram. grams gets the words of whole sentences in order of
    sentence and position, for each its parent's place, -1 if there is none, and whether it names a parent."""
    up = F.when((F.col("head") != F.col("idx")) & F.greatest(*[F.col(k).isNotNull() for k in by], F.lit(False)), F.col("head"))
    rows = edges.select(*by, F.struct("idx", up.cast("bigint").alias("up"), F.col("word").cast("string").alias("word")).alias("t")).groupBy(*by).agg(F.collect_list("t").alias("t"))
    fields = [edges.schema[k] for k in (*by, *keep)]
    schema = StructType([*[StructField(f.name, f.dataType) for f in fields], StructField("n", IntegerType()), StructField("gram", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            done = 0
            while done < len(sizes):
                before = ends[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, before + TOKENS, side="right")))
                yield from _slice(batch.slice(done, stop - done), list(by), keep, grams)
                done = stop

    return rows.mapInArrow(run, schema)


def _slice(batch: pa.RecordBatch, by: list[str], keep: list[str], grams: Callable) -> Iterator[pa.RecordBatch]:
    row = pc.list_parent_indices(batch.column("t")).to_numpy().astype(np.int64)
    t = batch.column("t").flatten()
    idx, up, word = (t.field(k) for k in ("idx", "up", "word"))
    number = pc.fill_null(idx.cast(pa.int64()), 0).to_numpy()
    known = idx.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((number, row))
    at = pa.array(order)
    row, number, known = row[order], number[order], known[order]
    idx, up, word = idx.take(at), up.take(at), word.take(at)
    has_up = up.is_valid().to_numpy(zero_copy_only=False)
    asked = pc.fill_null(up, 0).to_numpy()
    # one number for sentence and position, by which parents are found
    codes, code = np.unique(number, return_inverse=True)
    place = np.searchsorted(codes, asked)
    there = has_up & (place < len(codes))
    there[there] = codes[place[there]] == asked[there]
    key, wanted = row * len(codes) + code, row * len(codes) + place
    known_key, known_at = key[known], np.flatnonzero(known)
    found = np.searchsorted(known_key, wanted)
    there &= found < len(known_key)
    there[there] = known_key[found[there]] == wanted[there]
    parent = np.full(len(row), -1)
    parent[there] = known_at[found[there]]
    for first, n, gram in grams(word, parent, has_up):
        for lo in range(0, len(first), SETS):
            some = first[lo : lo + SETS]
            of = pa.array(row[some])
            columns = [batch.column(k).take(of) for k in by] + [idx.take(pa.array(some)) for _ in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(some), n, np.int32)), gram.slice(lo, SETS).cast(pa.string())], [*by, *keep, "n", "gram"])
