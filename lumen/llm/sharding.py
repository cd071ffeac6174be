"""Reproducible shuffle and sharding by a keyed permutation of row numbers.

Rows are numbered 0..N-1 in ``doc_id`` order. A Feistel network permutes the
numbers; positions that fall outside 0..N-1 walk on along their cycle until
they are inside, so the map is a bijection on 0..N-1 for every N. Shard and
slot follow from the position alone (``position % shards``,
``position / shards``) and the position can be inverted: any (shard, slot) can
be traced back to its row number with ``unpermute`` and no table.

Law: ``rows`` (shard sizes differ by at most one).

Defined results: a null text has size 1 and the crc32 of the empty text; null
and repeated ``doc_id`` are numbered like others (ties by checksum, size, then
read order); fewer rows than shards leave the last shards empty; an empty table
gives an empty result; other columns are not read. Main path: DataFrame
functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumen.llm.common import materialise, read

SHARDS = 8
KEY = 20_240_601
ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """Smallest grid a x b that holds n numbers, a = ceil(sqrt(n))."""
    a = isqrt(max(n, 1) - 1) + 1 if n > 1 else 1
    return a, -(-max(n, 1) // a)


def _mix(key: int, rnd: int, half: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key).cast("long"), F.lit(rnd), half.cast("long")), F.lit(modulus).cast("long"))


def _once(x: Column, n: int, key: int, rounds: int) -> Column:
    """One pass of the network over the grid of ``n``: halves in Z_a x Z_b, added to in turn."""
    a, b = _sides(n)
    left, right = F.floor(x / b) if b == 1 else (x - F.pmod(x, F.lit(b).cast("long"))) / b, F.pmod(x, F.lit(b).cast("long"))
    left = left.cast("long")
    for r in range(rounds):
        if r % 2 == 0:
            left = F.pmod(left + _mix(key, r, right, a), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + _mix(key, r, left, b), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def _back(x: Column, n: int, key: int, rounds: int) -> Column:
    a, b = _sides(n)
    right = F.pmod(x, F.lit(b).cast("long"))
    left = ((x - right) / b).cast("long")
    for r in reversed(range(rounds)):
        if r % 2 == 0:
            left = F.pmod(left - _mix(key, r, right, a), F.lit(a).cast("long"))
        else:
            right = F.pmod(right - _mix(key, r, left, b), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def _walk(x: Column, n: int, step) -> Column:
    """``step`` until the value is below ``n``.

    The grid exceeds n by fewer than ``a`` numbers, and a walk visits each of
    those at most once. So ``a + 1`` steps always suffice; beyond 64 steps
    (n > 4096) a walk that long has a probability below (2 / sqrt(n))^64, and
    the query stops with an error rather than return a wrong position.
    """
    a, b = _sides(n)
    first = step(x)
    if a * b == n:
        return first
    steps = min(a * b - n, 64)
    limit = F.lit(n).cast("long")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first,
                       lambda v, _: F.when(v >= limit, step(v)).otherwise(v))
    walked = F.when(first < limit, first).otherwise(rest)
    return F.when(walked < limit, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permute(number: Column, n: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """Position of row ``number`` in the shuffle of ``n`` rows."""
    return _walk(number.cast("long"), n, lambda v: _once(v, n, key, rounds))


def unpermute(position: Column, n: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """Row number at ``position`` (inverse of ``permute``)."""
    return _walk(position.cast("long"), n, lambda v: _back(v, n, key, rounds))


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless numbers 0..N-1 in ``order``, and N.

    Range partitions are sorted and written once; a partition's place and size
    give its offset. No window or task ever sees all rows: the offset table has
    one row per partition, and a run of equal keys is parted by read order.
    """
    d = df.withColumn("_read", F.monotonically_increasing_id())
    d = d.repartitionByRange(*order, F.col("_read")).sortWithinPartitions(*order, F.col("_read"))
    d = materialise(d.withColumn("_at", F.monotonically_increasing_id()).drop("_read"), "rows")
    part = F.shiftright("_at", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    out = d.withColumn("_part", part).join(F.broadcast(offsets.select("_part", "_before")), "_part")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return out.withColumn(name, F.col("_before") + low).drop("_at", "_part", "_before"), total


def shard(df: DataFrame, order: list[Column], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """``df`` plus row_number, position, shard and slot."""
    numbered, n = row_numbers(df, order)
    pos = permute(F.col("row_number"), max(n, 1), key)
    d = numbered.withColumn("position", pos)
    return (d.withColumn("shard", F.pmod("position", F.lit(shards).cast("long")).cast("int"))
            .withColumn("slot", F.expr(f"position div {shards}")))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


ORACLE_SQL: dict[str, str] = {}
