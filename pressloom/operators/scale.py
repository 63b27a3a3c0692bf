"""Building blocks that keep joins, ranks and samples balanced on any key distribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import materialise

# A lookup side is broadcast up to this many rows and bytes of values.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
# Keys with at least this share of the facts are sought by the sketch, and what it tracks: several times their number.
HOT_KEYS, TRACKED = 1000, 16_384
# Rows of a table that are broadcast as hot by their weights.
HOT_ROWS = 20_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    fixed, parts = 0, []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(F.col(f"`{f.name}`")))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))))
        else:
            fixed += 8
    return reduce(lambda x, y: x + F.coalesce(y, F.lit(0)), parts, F.lit(fixed))


def hot_hashes(facts: DataFrame, key: str, share: int = HOT_KEYS) -> list[int]:
    """Hashes of all keys that hold at least one in ``share`` of the facts, whether any table has them or not.

    One pass over the keys: every task keeps a sketch of frequent hashes, of bounded size, and sketches are merged. It
    counts a key too high by at most 4 / ``TRACKED`` of all facts, so no such key is missed, and what comes besides is
    sent the same way without harm.
    """
    found = facts.select(F.xxhash64(key).alias("h")).agg(
        F.expr(f"approx_top_k(h, {2 * share}, {max(TRACKED, 4 * share)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if 2 * share * r["count"] >= found["n"]]


def _small(table: DataFrame, weight: str | None, limit: int) -> tuple[bool, int]:
    """(whether a table may be broadcast, the sum of its weights)."""
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table)).alias("b"),
                      F.sum(weight if weight else F.lit(0)).alias("w")).first()
    return found["n"] <= limit and (found["b"] or 0) <= BROADCAST_BYTES, found["w"] or 0


def frequent_rows(table: DataFrame, weight: str, limit: int | None = None) -> Column | None:
    """Which rows of a table to broadcast: all that weigh at least a power of two, as many as the bounds allow; None if all.

    The rows are counted by power of two, so at most 64 counts meet the driver.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    power = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double"))).cast("int")
    sizes = table.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table)).alias("b")).orderBy(F.desc("p")).collect()
    least, rows, held = None, 0, 0
    for size in sizes:
        rows, held = rows + size["n"], held + size["b"]
        if rows > limit or held > BROADCAST_BYTES:
            return power >= least if least is not None else F.lit(False)
        least = size["p"]
    return None


def lookup_join(facts: DataFrame, table: DataFrame, key: str, weight: str | None = None,
                how: str = "inner", limit: int | None = None, absent: bool = False) -> DataFrame:
    """Join facts with a table that has one row per key; ``how`` is inner, left, left_semi or left_anti.

    Up to ``limit`` rows and ``BROADCAST_BYTES`` the table is broadcast. A longer one is split, so that no hot key is
    shuffled into one task and the rest is a shuffled join:

    * by ``weight``, the number of fact rows per key, where the table knows all frequent keys: those with at least
      1 / ``HOT_ROWS`` of all facts are at most ``HOT_ROWS`` by counting;
    * with ``absent`` by a sketch over the facts' own keys, which finds frequent keys that the table lacks too. Facts
      are read three times then and should be stored. Facts with a null key meet no row and are not shuffled.

    Without either the shuffled join is left to adaptive skew handling.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    small, total = _small(table, weight, limit)
    if small:
        return facts.join(F.broadcast(table), key, how)
    if absent:
        hashes = hot_hashes(facts, key, min(HOT_KEYS, limit))
        in_hot = F.xxhash64(key).isin(hashes) if hashes else F.lit(False)
        hot_part = facts.filter(F.col(key).isNull() | in_hot).join(F.broadcast(table.filter(in_hot)), key, how)
        cold_part = facts.filter(F.col(key).isNotNull() & ~in_hot).join(table.filter(~in_hot), key, how)
        return hot_part.unionByName(cold_part)
    if weight is None:
        return facts.join(table, key, how)
    hot = F.col(weight) * min(limit, HOT_ROWS) >= F.lit(total)
    hot_rows = F.broadcast(table.filter(hot))
    cold_facts = facts.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti")
    cold_part = cold_facts.join(table.filter(~hot), key, how)
    if how == "left_anti":
        return cold_part
    return facts.join(hot_rows, key, "left_semi" if how == "left_semi" else "inner").unionByName(cold_part)


def semi_join_counted(facts: DataFrame, keys: DataFrame, key: str, weight: str,
                      how: str = "left_semi", limit: int | None = None, absent: bool = False) -> DataFrame:
    """Semi or anti join on a key whose fact rows may pile up; ``weight`` counts them per key."""
    return lookup_join(facts, keys, key, weight, how, limit, absent)


def salted_join(facts: DataFrame, table: DataFrame, key: str, spread_by: str, weight: str = "n",
                per_task: int = 10_000, limit: int | None = None) -> DataFrame:
    """Inner join of facts with wide rows of a table, one per key, where keys may be hot.

    A key with many facts gets one copy of its row per ``per_task`` facts, and its facts are dealt out
    over the copies by ``spread_by``. Copies are at most keys + facts / per_task. ``facts`` should be
    cheap to read twice.
    """
    counts = materialise(facts.groupBy(key).agg(F.count(F.lit(1)).alias(weight)), "weights")
    copies = F.ceil(F.col(weight) / per_task).cast("int")
    dealt = lookup_join(facts, counts, key, weight, limit=limit).withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), copies).cast("int")).drop(weight)
    rows = table.join(counts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(weight)
    return dealt.join(rows, [key, "_salt"]).drop("_salt")


def global_rank(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Exact 1-based row number over the whole frame without sending it through one task.

    Rows are range-partitioned and sorted, written once, and numbered by partition offset; the
    offset table has one row per partition. ``order`` should end in a unique column.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at")
    )
    placed = materialise(placed, "rank")
    # one row per range partition, so this window is as small as the partition count
    offsets = (
        placed.groupBy("_part").agg((F.max("_idx") + 1).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows"))
        .select("_part", "_before")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_idx") + 1).cast("long"))
        .drop("_part", "_idx", "_before")
    )


def hash_order(key: str, seed: int = 0) -> Column:
    """A repeatable pseudo-random order of a key, the same on every cluster size."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def sample_rows(df: DataFrame, key: str, size: int, seed: int = 0, few: int = 100_000) -> DataFrame:
    """Exactly ``min(size, rows)`` rows without replacement, by hash order of a unique key.

    The sample is the ``size`` least hashes. Counts by the first 16 bits of the hash find where it ends, then by the next
    16 within that bucket, until at most ``few`` keys are left to put in order. Only hashes and keys move; the rows are
    then filtered in place by the last hash and key that belong to the sample.
    """
    keys = df.select(F.col(key).alias("_key")).filter(F.col(key).isNotNull()).withColumn("_h", hash_order("_key", seed))
    prefix, before = "", 0
    while True:
        within = keys.filter(F.startswith("_h", F.lit(prefix))) if prefix else keys
        # at most 65 536 buckets
        counts = within.groupBy(F.substring("_h", len(prefix) + 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        edge = (
            counts.withColumn("_up_to", F.lit(before) + F.sum("_n").over(W.orderBy("_b")))
            .filter(F.col("_up_to") >= size).orderBy("_b").first()
        )
        if edge is None:
            return df.filter(F.col(key).isNotNull())  # fewer rows than asked for
        before, prefix = edge["_up_to"] - edge["_n"], prefix + edge["_b"]
        if edge["_n"] <= few or len(prefix) == 32:
            break
    if size <= before:
        return df.limit(0)
    last = keys.filter(F.startswith("_h", F.lit(prefix))).orderBy("_h", "_key").limit(size - before).agg(
        F.max(F.struct("_h", "_key")).alias("m")).first()["m"]
    own = hash_order(key, seed)
    return df.filter((own < last["_h"]) | ((own == last["_h"]) & (F.col(key) <= F.lit(last["_key"]))))


def exact_quantiles(df: DataFrame, column: str, quantiles: Sequence[float]) -> list[float | None]:
    """Quantiles of a column as ``percentile`` gives them, between two values by their distance; nulls are left out.

    Equal values are counted first. The counts lie in ranges of values, a row per range says where a rank falls, and only
    that range is looked into: no task sees all values. None without values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = materialise(counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "values")
    ranges = placed.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()  # one row per range
    total = sum(r["n"] for r in ranges)
    if not total:
        return [None for _ in quantiles]

    def value(rank: int) -> float:
        part = 0
        while rank >= ranges[part]["n"]:
            rank -= ranges[part]["n"]
            part += 1
        within = placed.filter(F.col("_part") == ranges[part]["_part"]).withColumn(
            "_up_to", F.sum("_n").over(W.partitionBy("_part").orderBy("_v")))
        return within.filter(F.col("_up_to") > rank).agg(F.min("_v")).first()[0]

    found = []
    for q in quantiles:
        low, share = divmod(q * (total - 1), 1)
        a = value(int(low))
        found.append(float(a) if not share else a + (value(int(low) + 1) - a) * share)
    return found


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Keep one row per key, the first in ``order``.

    Spark prunes to one row per key before the shuffle (WindowGroupLimit), so a key that holds a
    third of all rows sends one row per input partition.
    """
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")
