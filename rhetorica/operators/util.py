"""Samples, chunks, flattening and token numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetorica.sources.tables import sent_if_few, stored


def sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows (or all), those with the smallest md5 of seed and key: the same on every run."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(h, F.col(key)).limit(k)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` with a ``place`` from 1: an order by the md5 of seed and key, the same on every run."""
    mixed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return numbered(mixed, [], ["_h", key], "shuffled").drop("_h").withColumnRenamed("_n", "place")


def flatten(c: Column, depth: int = 1) -> Column:
    """Nested arrays, ``depth`` levels flattened."""
    for _ in range(depth):
        c = F.flatten(c)
    return c


def nested_map(c: Column, function, depth: int = 2) -> Column:
    """``function`` applied to the elements of arrays nested ``depth`` deep."""
    return F.transform(c, lambda x: nested_map(x, function, depth - 1)) if depth > 1 else F.transform(c, function)


def numbered(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``_n``, the number from 1 of each row in its group ``by`` in the order of ``order``.

    Rows are numbered within the parts of a range-partitioned sort, and sizes of the parts give each
    its offset, so a group of any size is spread over tasks.
    """
    ordered = stored(df.orderBy(*by, *order).withColumn("_part", F.spark_partition_id()), label)
    sizes = ordered.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of the group
    before = sizes.select("_part", *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = ordered.withColumn("_within", within).join(sent_if_few(before.withColumnRenamed("_part", "_p"), 100_000), same)
    return rows.select(*df.columns, (F.col("_before") + F.col("_within")).alias("_n"))


def chunked(df: DataFrame, group: str, order: str, value: str, size: int, fill: str | None = None) -> DataFrame:
    """(group, chunk, items): ``size`` values per chunk in order; ``fill`` pads the last one.

    Only chunks, of at most ``size`` values, are collected.
    """
    cols = list(dict.fromkeys([group, order, value]))
    rows = numbered(df.select(*cols), [group], [order], "chunks").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("bigint"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("_v")))), lambda x: x["_v"])
    if fill is not None:
        items = F.concat(items, F.array_repeat(F.lit(fill), size - F.size(items)))
    return rows.groupBy(group, "chunk").agg(items.alias("items"))


def token_dictionary(df: DataFrame, pos: list[str], token: str) -> DataFrame:
    """(token, id): dense numbers from 0 by first occurrence in the order of ``pos``, which come from an aggregation."""
    first = df.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.min(F.struct(*pos)).alias("at"))
    return numbered(first, [], ["at"], "vocabulary").select("token", (F.col("_n") - 1).alias("id"))


def encode(df: DataFrame, vocab: DataFrame, token: str) -> DataFrame:
    """``df`` with the token's ``id``; unknown tokens get null."""
    return df.join(vocab.withColumnRenamed("token", token), token, "left")


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """(token, id): dense numbers from 0 of the different tokens of an array column, in their order."""
    each = df.select(F.explode(tokens).alias("token")).where("token is not null").distinct()
    return numbered(each, [], ["token"], "token-ids").select("token", (F.col("_n") - 1).alias("id"))


def encoded(df: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """``df`` with the tokens replaced by their numbers, -1 for unknown ones; null tokens and null arrays stay null."""
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = rows.select("_row", F.posexplode(tokens).alias("_at", "token")).join(sent_if_few(vocab, 100_000), "token", "left")
    number = F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(-1))).alias("id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_at", number))), lambda x: x["id"])  # a text's own tokens
    back = rows.join(each.groupBy("_row").agg(ids.alias("_ids")), "_row", "left")
    return back.withColumn(tokens, F.when(F.col(tokens).isNotNull(), F.coalesce("_ids", F.array().cast("array<bigint>")))).drop("_row", "_ids")
