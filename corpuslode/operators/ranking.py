"""Ordering, top-k and paging that hold when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

# Ranks of the ordered vocabularies.
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
PRIORITY_ORDER = ["critical", "high", "medium", "low"]
VIOLATION_ORDER = ["error", "warning", "info"]

# Paging limits.
TOKEN_LIMIT = 25_000
SAFE_TOKENS = 18_000
PAGE_SIZE, MAX_PAGE_SIZE, MIN_PAGE_SIZE, AUTO_THRESHOLD = 50, 200, 5, 100

# Ranks up to this depth come from a top-k; deeper ones from a full numbering.
TOP_K_DEPTH = 20_000

# Largest bound that Spark applies before the shuffle, and parts of a key beyond it.
MAP_SIDE_LIMIT, SALTS = 1_000, 64


def rank_of(column: Column, order: Sequence[str]) -> Column:
    """Position of a value in an ordered vocabulary; unknown values come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return ((F.coalesce(place, F.lit(0)) + len(order)) % (len(order) + 1)).cast("int")


def at_least(column: Column, minimum: str, order: Sequence[str]) -> Column:
    """Rows whose value ranks no lower than ``minimum``."""
    return rank_of(column, order) <= order.index(minimum)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    A small constant bound lets Spark limit every map partition to ``k`` rows per
    key before the shuffle.  Beyond that size Spark does not, so the rows of a key
    are first limited in salted parts; a hot key never meets one task whole.
    """
    if k > MAP_SIDE_LIMIT:
        hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= k).drop("_place", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank of every row within its key; the work of one key is spread over tasks.

    A range sort puts each key's rows into consecutive partitions.  The rank is
    the rows of the key in earlier partitions plus the position in the own one.
    ``order`` names columns that, with the keys, order the rows totally.
    """
    columns = [*keys, *order]
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in columns])
        .sortWithinPartitions(*columns)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1))
    blocks = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        placed.join(blocks, [*keys, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
        .drop("_at", "_part", "_pos", "_first", "_before")
    )


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_items"))


def _page_columns(pages: DataFrame, page: int, clamp: bool) -> DataFrame:
    size, total = F.col("page_size"), F.col("total_items")
    last = F.ceil(total / size)
    current = F.least(F.lit(page), F.greatest(F.lit(1), last)) if clamp else F.lit(page)
    return (
        pages.withColumn("total_pages", last.cast("int"))
        .withColumn("current_page", current.cast("int"))
        .withColumn("start_index", ((F.col("current_page") - 1) * size).cast("int"))
        .withColumn("end_index", F.least(F.col("start_index") + size, total).cast("int"))
        .withColumn("has_next", F.col("current_page") < F.col("total_pages"))
        .withColumn("has_previous", F.col("current_page") > 1)
    )


def page_info(df: DataFrame, keys: Sequence[str], page: int = 1, size: int = PAGE_SIZE, clamp: bool = True) -> DataFrame:
    """One row of paging facts per key."""
    page, size = max(1, page), min(MAX_PAGE_SIZE, max(1, size)) if clamp else size
    return _page_columns(_counts(df, keys).withColumn("page_size", F.lit(size)), page, clamp)


def paged(df: DataFrame, keys: Sequence[str], order: Sequence[str], page: int = 1, size: int = PAGE_SIZE,
          clamp: bool = True) -> DataFrame:
    """The rows of one page of every key, with their rank and paging facts.

    With ``clamp`` a page past the end shows the last page; without it, nothing.
    """
    page, size = max(1, page), min(MAX_PAGE_SIZE, max(1, size)) if clamp else size
    return _take_pages(df, keys, order, page_info(df, keys, page, size, clamp), page * size)


def _take_pages(df, keys, order, info, depth) -> DataFrame:
    if depth <= TOP_K_DEPTH:
        ranked = top_k(df, keys, [F.col(c) for c in order], depth)
    else:
        ranked = ordered_rank(df, keys, order)
    if keys:
        joined = ranked.join(info, list(keys))
    else:  # one row of paging facts
        joined = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(info.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return joined.filter((F.col("rank") > F.col("start_index")) & (F.col("rank") <= F.col("end_index")))


def token_sized_pages(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, page: int | None = None,
                      size: int | None = None, max_tokens: int = TOKEN_LIMIT * 8 // 10) -> DataFrame:
    """Pages whose size shrinks with the mean tokens of the first three rows."""
    wanted = min(MAX_PAGE_SIZE, max(1, size or PAGE_SIZE))
    first = top_k(df, keys, [F.col(c) for c in order], 3)
    mean = first.groupBy(*keys).agg(F.avg(tokens).alias("_mean"))
    safe = F.greatest(F.lit(MIN_PAGE_SIZE), F.floor(F.lit(max_tokens) / F.col("_mean")))
    info = _counts(df, keys).join(mean, list(keys)).withColumn(
        "page_size", F.least(F.lit(wanted), safe).cast("int")
    ).drop("_mean")
    info = _page_columns(info, max(1, page or 1), clamp=True)
    return _take_pages(df, keys, order, info, max(1, page or 1) * wanted)


def proportional_cap(df: DataFrame, group: str, order: Sequence[str], limit: int = 200, least: int = 5,
                     keys: Sequence[str] = ("project",)) -> DataFrame:
    """Show at most about ``limit`` rows per key, shared among groups by size.

    Applies only to keys with more than ``limit`` rows; every group keeps ``least``.
    """
    counts = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("group_count"))
    totals = counts.groupBy(*keys).agg(F.sum("group_count").alias("total_count"))
    share = F.greatest(F.lit(least), F.floor(F.lit(limit) * (F.col("group_count") / F.col("total_count"))))
    caps = counts.join(totals, list(keys)).withColumn(
        "cap", F.when(F.col("total_count") > limit, share).otherwise(F.col("group_count")).cast("bigint")
    )
    # A group's cap never exceeds limit: shares are at most 1 and small keys hold at most limit rows.
    ranked = top_k(df, [*keys, group], [F.col(c) for c in order], max(limit, least))
    return ranked.join(caps, [*keys, group]).filter(F.col("rank") <= F.col("cap"))


def largest_group_page(df: DataFrame, group: str, order: Sequence[str], page: int, size: int,
                       keys: Sequence[str] = ("project",)) -> DataFrame:
    """Page only the largest group of each key; ties go to the first name."""
    counts = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("group_count"))
    pick = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("group_count")).alias("n"), F.col(group).alias("g"))).alias("best")
    ).select(*keys, F.col("best.g").alias(group))
    chosen = df.join(pick, [*keys, group], "left_semi")
    return paged(chosen, list(keys), order, page, size)


def fitting_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str,
                   limit: int = SAFE_TOKENS) -> DataFrame:
    """Longest prefix per key whose summed tokens stay within ``limit``.

    Rows cost at least one token, so no more than ``limit`` rows can fit and the
    running sum sees at most that many rows of a key.
    """
    costed = df.withColumn("_cost", F.greatest(F.col(tokens), F.lit(1)))
    first = top_k(costed, keys, [F.col(c) for c in order], limit)
    window = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("running_tokens", F.sum("_cost").over(window)).filter(F.col("running_tokens") <= limit).drop("_cost")


def first_examples(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int = 3,
                   name: str = "examples") -> DataFrame:
    """First ``n`` values per key in a stable order, as one array of bounded size."""
    first = top_k(df, keys, [F.col(c) for c in order], n, "_rank")
    packed = F.sort_array(F.collect_list(F.struct(F.col("_rank"), F.col(value).alias("_value"))))
    return first.groupBy(*keys).agg(packed.alias("_all")).select(
        *keys, F.transform("_all", lambda x: x["_value"]).alias(name)
    )
