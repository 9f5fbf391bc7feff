"""Filling containers of a fixed capacity with documents (problem 7).

Method: hierarchical residual packing. Every task measures its documents in tokens and packs them
locally, best fit in decreasing order; containers that are nearly full are final. The others go up
a tree: each node takes the open containers of ``fan_in`` nodes as items, packs them again by best
fit, and passes on what is still open. A node that would get more than a bounded number of
containers or of documents is split into several by a hash that differs from level to level, so no
task ever gets an unbounded group, and nothing is closed early.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # a public rank file; not part of this repository
NEARLY_FULL = 0.995
FAN_IN = 8
NODE_CONTAINERS = 20_000  # containers that one task packs again
NODE_ITEMS = 500_000  # documents and pieces in them
_SCHEMA = "capacity_id bigint, container string, fill bigint, done boolean, node bigint, items array<struct<doc_id:bigint,piece:int,tokens:bigint>>"


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class BestFit:
    """Bins by the room they have left; the fullest that still fits is found by a bit mask."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.by_room = capacity, 0, {}

    def add(self, size: int, items: list) -> None:
        fitting = self.mask >> size
        if size and fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            stack = self.by_room[room]
            held = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
            held.extend(items)
        else:
            room, held = self.capacity, list(items)
        room -= size
        self.by_room.setdefault(room, []).append(held)
        self.mask |= 1 << room

    def bins(self) -> list[tuple[int, list]]:
        """(fill, items), fullest first."""
        return [(self.capacity - room, held) for room in sorted(self.by_room) for held in self.by_room[room]]


def pack(sized: Iterable[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best fit, largest first; ties in the order given."""
    fit = BestFit(capacity)
    for size, items in sorted(sized, key=lambda x: -x[0]):
        fit.add(size, items)
    return fit.bins()


def pieces(doc_id: int, tokens: int, capacity: int) -> list[tuple[int, list]]:
    """A document as items: whole if it fits, else cut into full containers and a rest."""
    if tokens <= capacity:
        return [(tokens, [(doc_id, 1, tokens)])]
    cut = [capacity] * (tokens // capacity) + ([tokens % capacity] if tokens % capacity else [])
    return [(n, [(doc_id, k + 1, n)]) for k, n in enumerate(cut)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64())]))]
    named = [[{"doc_id": d, "piece": p, "tokens": t} for d, p, t in r[5]] for r in rows]
    columns = [[r[i] for r in rows] for i in range(5)] + [named]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["capacity_id", "container", "fill", "done", "node", "items"])


def _emit(bins: list[tuple[int, list]], capacity_id: int, capacity: int, name: str, node: int, last: bool):
    rows = [(capacity_id, f"{name}-{k}", fill, last or fill >= NEARLY_FULL * capacity, node, held) for k, (fill, held) in enumerate(bins)]
    for k in range(0, len(rows), 2_000):
        yield _batch(rows[k : k + 2_000])


def packed(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, fan_in: int = FAN_IN, limit: int = 1_000, node_containers: int = NODE_CONTAINERS) -> DataFrame:
    """(capacity_id, container, doc_id, piece, tokens): the container of every document, for every capacity.

    A document is in one piece unless it has more tokens than the capacity. Null and empty texts
    have no tokens and need no container: theirs is null. Rows with a null ``doc_id`` count as
    documents of their own. Capacities that are null or under 1 are left out; more than ``limit``
    capacities raise ValueError. Empty tables give no rows.
    """
    from rhetorica.sources.tables import sent_if_few, small_rows, stored

    sizes = [(r.capacity_id, r.max_tokens) for r in small_rows(capacities.where("max_tokens >= 1").select("capacity_id", "max_tokens").distinct(), limit, "capacities")]

    def local(batches: Iterable[pa.RecordBatch]):
        encode = encoder(tokenizer).encode_ordinary
        docs: list[tuple[int, int]] = []
        for b in batches:
            docs += [(i, len(encode(t)) if t else 0) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        node = TaskContext.get().partitionId()
        for capacity_id, capacity in sizes:
            items = [p for i, n in docs if n for p in pieces(i, n, capacity)]
            yield from _emit(pack(items, capacity), capacity_id, capacity, f"0-{node}", node, False)
            none = [(capacity_id, None, 0, True, node, [(i, 1, 0)]) for i, n in docs if not n]
            for k in range(0, len(none), 2_000):
                yield _batch(none[k : k + 2_000])

    def merge(level: int, last: bool):
        capacity_of = dict(sizes)

        def node_of(table: pa.Table) -> pa.Table:
            capacity_id, node, part = (table[c][0].as_py() for c in ("capacity_id", "node", "part"))
            bins = [(f, [(x["doc_id"], x["piece"], x["tokens"]) for x in held]) for _, f, held in sorted(zip(table["container"].to_pylist(), table["fill"].to_pylist(), table["items"].to_pylist()), key=lambda r: (r[1], r[0]))]
            again = pack(bins, capacity_of[capacity_id])
            return pa.Table.from_batches(list(_emit(again, capacity_id, capacity_of[capacity_id], f"{level}-{node}-{part}", node, last)))

        return node_of

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    level, made = 0, [stored(texts.mapInArrow(local, _SCHEMA), "bins-0")]
    nodes = (made[0].agg(F.max("node")).first()[0] or 0) + 1
    while True:
        level, nodes = level + 1, -(-nodes // fan_in)
        up = made[-1].where("not done").withColumn("node", F.floor(F.col("node") / fan_in))
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / node_containers, F.sum(F.size("items")) / NODE_ITEMS))
        up = up.join(sent_if_few(up.groupBy("capacity_id", "node").agg(parts.alias("parts"))), ["capacity_id", "node"])
        up = up.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "container"), "parts")).drop("parts")
        made.append(stored(up.groupBy("capacity_id", "node", "part").applyInArrow(merge(level, nodes == 1), _SCHEMA), f"bins-{level}"))
        if nodes == 1:
            break
    final = made[0].where("done")
    for m in made[1:]:
        final = final.unionByName(m.where("done"))
    return final.select("capacity_id", "container", F.explode("items").alias("x")).select("capacity_id", "container", "x.doc_id", "x.piece", "x.tokens")


def fill_report(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, documents, pieces, containers, tokens, unused): unused is the share of the
    containers' room that no token fills, null without containers."""
    per = assigned.groupBy("capacity_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")
    )
    room = F.col("containers") * F.col("max_tokens")
    return per.join(capacities.select("capacity_id", "max_tokens").dropDuplicates(["capacity_id"]), "capacity_id").withColumn(
        "unused", F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / room, 6))
    )
