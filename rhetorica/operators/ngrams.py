"""N-gram windows and counts.

N-grams are made within each row's token array, so no window or sort over rows is needed: every
order up to n comes from one pass, and counts are combined in the map stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"


def pad_token(n: int) -> str:
    """The pad of order n; each order has its own, so padded contexts never match at a lower order."""
    return f"\x02pad{n}"


def padded(tokens: Column, n: int, left: bool = True, right: bool = True) -> Column:
    pad = F.array_repeat(F.lit(pad_token(n)), n - 1)
    parts = ([pad] if left and n > 1 else []) + [tokens] + ([pad] if right and n > 1 else [])
    return F.concat(*parts) if len(parts) > 1 else tokens


def positions(df: DataFrame, keep: list[Column], tokens: Column, n: int) -> DataFrame:
    """``keep`` and w1 ... wn for each position: its token and the n - 1 that follow, null past the end.

    Shifted copies of the array are zipped and exploded, which stays in generated code.
    """
    size = F.coalesce(F.size(tokens), F.lit(0))
    shifted = [tokens if k == 1 else F.slice(tokens, k, F.greatest(size, F.lit(0))) for k in range(1, n + 1)]
    # The outer form keeps Spark from filtering on the array first, which would evaluate a tokenizer twice.
    rows = df.select(*keep, F.explode_outer(F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted, 1)])).alias("_w"))
    names = rows.columns[: len(keep)]
    fields = [f.name for f in rows.schema["_w"].dataType.fields]
    return rows.select(*names, *[F.col("_w").getField(f).alias(f"w{k}") for k, f in enumerate(fields, 1)])


def context(k: int) -> Column:
    """The context of the k-gram at a position."""
    return F.concat_ws(SEP, *[F.col(f"w{j}") for j in range(1, k)]) if k > 1 else F.lit("")


def grams(df: DataFrame, keep: list[Column], tokens: Column, orders: list[int]) -> DataFrame:
    """``keep`` and (ord, ctx, tok) of all n-grams of the orders, from one pass. N-grams with a null token don't count."""
    rows = positions(df, keep, tokens, max(orders))
    names = rows.columns[: len(keep)]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), context(k).alias("ctx"), F.when(_whole(k), F.col(f"w{k}")).alias("tok")) for k in orders])
    return rows.select(*names, F.explode(each).alias("g")).select(*names, "g.ord", "g.ctx", "g.tok").where("tok is not null")


def _whole(k: int) -> Column:
    ok = F.col("w1").isNotNull()
    for j in range(2, k + 1):
        ok = ok & F.col(f"w{j}").isNotNull()
    return ok


def check_tokens(df: DataFrame, column: str) -> None:
    """Only arrays of strings or of integers are sequences of tokens; anything else raises TypeError."""
    kind = dict(df.dtypes)[column]
    if kind not in ("array<string>", "array<bigint>", "array<int>"):
        raise TypeError(f"{column}: an array of strings or integers is needed, not {kind}")


def conditional_counts(df: DataFrame, n: int, model: str = "model", tokens: str = "tokens", pad_left: bool = False, pad_right: bool = False) -> DataFrame:
    """(model, ord, ctx, tok, c) for all orders from 1 to n."""
    check_tokens(df, tokens)
    t, keep = F.col(tokens).cast("array<string>"), [F.col(model).alias("model")]
    if pad_left or pad_right:  # each order has its own pads
        rows = grams(df, keep, padded(t, 1, pad_left, pad_right), [1])
        for k in range(2, n + 1):
            rows = rows.unionByName(grams(df, keep, padded(t, k, pad_left, pad_right), [k]))
    else:
        rows = grams(df, keep, t, list(range(1, n + 1)))
    return rows.groupBy("model", "ord", "ctx", "tok").agg(F.count(F.lit(1)).alias("c"))


def add_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several parts of a corpus together: counts are sums, so training can go on with new text."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("model", "ord", "ctx", "tok").agg(F.sum("c").alias("c"))
