"""Tolerant as-of join (operator 11): each left row with the latest right row at or before it, within a tolerance.

Time is cut into buckets as wide as the tolerance. Each right time goes to its own bucket and the next one, both sides meet
by an equi-join on key and bucket, pairs outside the tolerance leave, and row_number keeps the latest. Right rows of one key
and time are summed up before: the winner of the tie order and their number.

A bucket of a key in which both sides are many (more than PAIRS pairs a row, or more than ROWS rows) would make a product.
It is cut into PARTS slices of equal length; each slice gets its own right times and, carried in, the latest one before it
within the bucket, since no other earlier one can match there. Slices that are still too full are cut again, down to a
microsecond, where one time of each side is left. So a pair of tables of any skew makes at most PAIRS pairs a row, and no
key, bucket or slice with an unbounded number of rows meets in one task: what is counted is first summed up by slice.

Defined results: a null key or time matches nothing (left rows stay, without a match); repeated left rows stay; right rows
that are equal in all columns tie with each other, and each counts; among equal times the largest tuple of `ties` wins, null
loses; equal tuples are decided by the columns taken; an empty side gives left rows without a match. Columns of left keep
their names; the match is one struct column, so no name can clash but its own, which is refused. Text columns, however long,
are only carried along by left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .common import P, table, written

#: A bucket or slice is cut when it holds more pairs than PAIRS a row, or more rows than ROWS; into PARTS slices.
PAIRS, ROWS, PARTS = 8, 4096, 64
HOUR = 3_600_000_000
K, T, CELL, S, RIGHT, M = (f"{P}{n}" for n in ("k", "t", "cell", "s", "right", "m"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970: of the instant, or of the wall clock read as UTC where the type has no zone."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(c)
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long")
    return F.unix_date(c.cast("date")) * F.lit(86_400_000_000) + clock * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def floored(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width))


def match_times(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """left (K, T) and right (K, T), both distinct and without nulls -> K, T of left and M, the matched time of right."""
    own = floored(F.col(T), tolerance)
    rows = left.select(K, own.alias(CELL), T, F.lit(0).alias(RIGHT)).unionByName(
        right.select(K, F.explode(F.array(own, own + tolerance)).alias(CELL), T, F.lit(1).alias(RIGHT))
    )
    width, level, leaves = tolerance, 0, []
    whole = W.partitionBy(K, CELL)
    before = whole.orderBy(S).rowsBetween(W.unboundedPreceding, -1)
    while True:
        part = -(-width // PARTS)
        # What a bucket has from the one before it lies in slices below zero.
        rows = rows.withColumn(S, F.greatest(F.lit(-PARTS), F.expr(f"(({T} - {CELL}) - pmod({T} - {CELL}, {part})) div {part}")))
        sums = rows.groupBy(K, CELL, S).agg(F.sum(RIGHT).alias("r"), F.sum(1 - F.col(RIGHT)).alias("l"), F.max(F.when(F.col(RIGHT) == 1, F.col(T))).alias("top"))
        r, l = F.sum("r").over(whole), F.sum("l").over(whole)  # noqa: E741
        full = (l > 0) & ((r * l > PAIRS * (r + l)) | ((r > 0) & (r + l > ROWS)))
        dense = written(sums.select(K, CELL, S, "l", F.max("top").over(before).alias("carry"), full.alias("full")).filter("full").drop("full"), "dense")
        if dense.isEmpty():
            leaves.append(rows.select(F.lit(level).alias("level"), K, CELL, T, RIGHT))
            break
        known = rows.join(dense.hint("merge"), [K, CELL, S], "left")
        leaves.append(known.filter("l IS NULL").select(F.lit(level).alias("level"), K, CELL, T, RIGHT))
        start = (F.col(CELL) + F.col(S) * part).alias(CELL)
        inner = known.filter(f"l > 0 AND {S} >= 0").select(K, start, T, RIGHT)
        carried = dense.filter(f"l > 0 AND {S} >= 0 AND carry IS NOT NULL").select(K, start, F.col("carry").alias(T), F.lit(1).alias(RIGHT))
        rows = written(inner.unionByName(carried), "slices")
        width, level = part, level + 1
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    by = ["level", K, CELL]
    one = every.filter(f"{RIGHT} = 0").select(*by, T)
    two = every.filter(f"{RIGHT} = 1").select(*by, F.col(T).alias(M))
    met = one.hint("merge").join(two.hint("merge"), by).filter((F.col(M) <= F.col(T)) & (F.col(T) - F.col(M) <= tolerance))
    latest = F.row_number().over(W.partitionBy(*by, T).orderBy(F.desc(M)))
    return met.withColumn("rn", latest).filter("rn = 1").select(K, T, M)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: int, ties: list[Column], take: list[str], out: str = "match") -> DataFrame:
    """left with `out`: a struct of `time`, the columns `take` of the matched right row, and `n_tied`; null without a match.

    Times are long (microseconds, or any unit of the tolerance).
    """
    if out in left.columns:
        raise ValueError(f"left has a column {out} already")
    there = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    best = F.max(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(ties)), F.struct(*take).alias("v")))
    right_rows = written(there.groupBy(F.col(key).alias(K), F.col(right_time).alias(M)).agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select(K, M, "best.v", "n"), "right")
    times = written(left.filter(F.col(key).isNotNull() & F.col(left_time).isNotNull()).select(F.col(key).alias(K), F.col(left_time).alias(T)).distinct(), "left")
    found = match_times(times, right_rows.select(K, F.col(M).alias(T)), tolerance)
    # Left's own columns travel as one struct. A match that many left rows share is a hot key of that side alone, which
    # adaptive execution splits.
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"), F.col(key).alias(K), F.col(left_time).alias(T))
    timed = rows.join(found.hint("merge"), [K, T], "left")
    whole = timed.join(right_rows.hint("merge"), [K, M], "left")
    match = F.when(F.col("n").isNotNull(), F.struct(F.col(M).alias("time"), *(F.col("v")[c].alias(c) for c in take), F.col("n").alias("n_tied")))
    return whole.select("row.*", match.alias(out))


def digits_crc(c: str) -> Column:
    """The unsigned crc32 of a number's decimal digits; null of null."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


def clicks_of(df: DataFrame) -> DataFrame:
    """click_id, client_id, ts_us: one row for each click_id; of copies that differ, the one with the least time and client."""
    h = digits_crc("click_id")
    us = micros(df, "ts")
    rows = df.select("click_id", "client_id", F.when(h % 2 == 1, floored(us, HOUR)).otherwise(us).alias("ts_us"))
    first = F.min(F.struct(F.col("ts_us").isNull().alias("a"), "ts_us", F.col("client_id").isNull().alias("b"), "client_id")).alias("x")
    return rows.groupBy("click_id").agg(first).select("click_id", "x.client_id", "x.ts_us")


def orders_of(df: DataFrame) -> DataFrame:
    """client_id, sale_id, priority, time_us, total_cents: each sale, and its twin where its number isn't divisible by 3.

    A total that is no finite number, or too large, has no cents.
    """
    h, us = digits_crc("sale_id"), micros(df, "sold_at")
    cents = 100 * F.col("total") + 0.5
    rows = df.select(
        "client_id", "sale_id", F.col("priority").cast("long").alias("priority"), F.when(h % 2 == 1, floored(us, HOUR)).otherwise(us).alias("time_us"),
        F.when(F.abs(cents) < 9e18, F.floor(cents)).cast("long").alias("total_cents"), F.coalesce(h % 3 != 0, F.lit(False)).alias("twin"),
    )
    each = F.array(F.struct("sale_id", "priority"), F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority")))
    return rows.withColumn("x", F.explode(F.slice(each, F.lit(1), 1 + F.col("twin").cast("int")))).select("client_id", "x.sale_id", "x.priority", "time_us", "total_cents")


def op11_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, orders = clicks_of(table(spark, sf_dir, "clicks")), orders_of(table(spark, sf_dir, "sales"))
    out = asof_join(clicks, orders, "client_id", "ts_us", "time_us", 240 * HOUR, [-F.col("priority"), F.col("sale_id")], ["sale_id", "total_cents"])
    return out.select("click_id", "client_id", "ts_us", "match.sale_id", (F.col("ts_us") - F.col("match.time")).alias("lag_us"), "match.total_cents", F.coalesce("match.n_tied", F.lit(0)).cast("long").alias("n_tied"))


OP11_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
click_ids AS (SELECT DISTINCT click_id AS id FROM clicks),
sale_ids AS (SELECT DISTINCT sale_id AS id FROM sales),
ids AS (SELECT id FROM click_ids UNION SELECT id FROM sale_ids),
hashed AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM ids, steps WHERE id IS NOT NULL),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN epoch_us(date_trunc('hour', ts)) ELSE epoch_us(ts) END AS ts_us
    FROM (SELECT DISTINCT click_id, client_id, ts FROM clicks) LEFT JOIN hashed ON click_id = id),
s AS (SELECT client_id, sale_id, CAST(priority AS BIGINT) AS priority, h, CASE WHEN h % 2 = 1 THEN epoch_us(date_trunc('hour', sold_at)) ELSE epoch_us(sold_at) END AS us,
    CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents FROM sales LEFT JOIN hashed ON sale_id = id),
o AS (SELECT client_id, sale_id, priority, us, total_cents FROM s UNION ALL SELECT client_id, -1 - sale_id, 6 - priority, us, total_cents FROM s WHERE h % 3 <> 0),
ranked AS (SELECT c.click_id, o.sale_id, o.us, o.total_cents, count(*) OVER (PARTITION BY c.click_id, o.us) AS n,
    row_number() OVER (PARTITION BY c.click_id ORDER BY o.us DESC, o.priority ASC NULLS LAST, o.sale_id DESC NULLS LAST) AS rn
    FROM c JOIN o ON c.client_id = o.client_id AND o.us <= c.ts_us AND c.ts_us - o.us <= 864000000000)
SELECT c.click_id, c.client_id, c.ts_us, r.sale_id, c.ts_us - r.us AS lag_us, r.total_cents, CAST(coalesce(r.n, 0) AS BIGINT) AS n_tied
FROM c LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON c.click_id = r.click_id
"""
