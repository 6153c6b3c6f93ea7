"""Ordered work inside a key, safe when one key holds a large part of the data.

``Ordered`` is the base of every series operator. It has two shapes with the
same methods, so operators are written once:

* plain: no key has more rows than ``mediasift.block.rows``. One shuffle by
  key, one sort, ordinary windows.
* split: some key is larger. The rows of large keys are range-partitioned by
  (key, order), which spreads a key over as many tasks as it needs, numbered
  densely, and cut into equal blocks; small keys stay as they are. Neighbouring blocks exchange ``before``/``after`` halo
  rows, so row frames stay exact; running sums and carried values add a prefix
  over one row per block.

The choice is made by one key-only count (map-side combined) per call, or
forced by ``split``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.session import block_rows, durable

_HELPERS = ("_g", "_blk", "_own")


def has_large_key(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """True when any key holds more than ``limit`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return bool(counts.filter(F.col("_n") > limit).limit(1).take(1))


# Most large keys that are told apart by a broadcast list; beyond it every key is split.
MAX_LARGE_KEYS = 100_000


def decide(df: DataFrame, keys: Sequence[str], split: bool | DataFrame | None) -> bool | DataFrame:
    """Take the size decision once for an operator of several steps.

    False: no large key. A table of the large keys (at most rows / limit of
    them, and counted) when there are few. True: split every key. Later steps
    see subsets or finer keys of ``df``, so the answer holds for them.
    """
    if split is not None:
        return split
    limit = block_rows(df.sparkSession)
    if not has_large_key(df, keys, limit):
        return False
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = durable(counts.filter(F.col("_n") > limit).select(*keys))
    return True if large.limit(MAX_LARGE_KEYS + 1).count() > MAX_LARGE_KEYS else large


def part_by_size(df: DataFrame, split: bool | DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of small keys, rows of large keys)."""
    if split is False:
        return df, None
    if split is True:
        return None, df
    marked = split.select(*[F.col(c).alias(f"_l_{c}") for c in split.columns])
    cond = F.lit(True)
    for c in split.columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    marked = F.broadcast(marked)  # size checked in decide
    return df.join(marked, cond, "left_anti"), df.join(marked, cond, "left_semi")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "_g") -> DataFrame:
    """Dense global row number in (keys, order), computed without one big task.

    ``order`` must be total. Costs one range shuffle and a durable write; the
    per-partition offsets are one row per partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = durable(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_mid", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    # one row per partition, whatever the data size
    return (
        ranged.join(F.broadcast(base), "_part")
        .withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_mid", "_part", "_base")
    )


class Ordered:
    """Rows of each key in a total order. Build it, add columns, take ``rows()``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str | Column],
        before: int = 0,
        after: int = 0,
        split: bool | DataFrame | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        limit = block_rows(df.sparkSession)
        choice = decide(df, self.keys, split)
        self.split = choice is not False
        small, large = part_by_size(df, choice)
        if small is not None:
            small = small.withColumn("_blk", F.lit(0).cast("bigint")).withColumn("_own", F.lit(True))
        if large is None:
            self.df = small
            return
        size = max(limit, before, after, 1)
        g = number_rows(large, self.keys, self.order)
        home, pos = F.floor(F.col("_g") / size), F.pmod(F.col("_g"), F.lit(size))
        copies = [home]
        if before:
            copies.append(F.when(pos >= size - before, home + 1))
        if after:
            copies.append(F.when(pos < after, home - 1))
        g = g.withColumn("_home", home).withColumn("_blk", F.explode(F.array_compact(F.array(*copies))))
        g = g.withColumn("_own", F.col("_home") == F.col("_blk")).drop("_home")
        self.df = g if small is None else g.unionByName(small.withColumn("_g", F.lit(None).cast("bigint")))

    # -- windows ---------------------------------------------------------
    def window(self):
        return Window.partitionBy(*self.keys, "_blk").orderBy(*self.order)

    def prev(self, c: str | Column, n: int = 1) -> Column:
        """Value ``n`` rows earlier (halo ``before >= n``)."""
        return F.lag(c, n).over(self.window())

    def next(self, c: str | Column, n: int = 1) -> Column:
        """Value ``n`` rows later (halo ``after >= n``)."""
        return F.lead(c, n).over(self.window())

    def frame(self, agg: Column, start: int, end: int) -> Column:
        """Aggregate over a row frame inside the halo."""
        return agg.over(self.window().rowsBetween(start, end))

    # -- steps -----------------------------------------------------------
    def add(self, **cols: Column) -> "Ordered":
        for name, c in cols.items():
            self.df = self.df.withColumn(name, c)
        return self

    def settle(self) -> "Ordered":
        """Drop halo rows once frame columns exist; later steps see each row once."""
        if self.split:
            self.df = self.df.filter("_own")
        return self

    def running(self, name: str, value: Column, inclusive: bool = True) -> "Ordered":
        """Running sum of ``value`` from the first row of the key."""
        self.settle()
        end = 0 if inclusive else -1
        w = self.window().rowsBetween(Window.unboundedPreceding, end)
        self.df = self.df.withColumn("_v", value).withColumn(name, F.coalesce(F.sum("_v").over(w), F.lit(0)))
        if self.split:
            self._carry(name, F.sum("_v"), lambda w: F.sum("_c").over(w), lambda own, c: own + F.coalesce(c, F.lit(0)))
        self.df = self.df.drop("_v")
        return self

    def last_seen(self, name: str, value: Column, inclusive: bool = True) -> "Ordered":
        """Latest non-null ``value`` up to this row."""
        self.settle()
        w = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        self.df = self.df.withColumn("_v", value).withColumn(name, F.last("_v", ignorenulls=True).over(w))
        if self.split:
            at = F.struct("_g", "_v")
            self._carry(
                name,
                F.max(F.when(F.col("_v").isNotNull(), at)).getField("_v"),
                lambda w: F.last("_c", ignorenulls=True).over(w),
                lambda own, c: F.coalesce(own, c),
            )
        self.df = self.df.drop("_v")
        return self

    def next_seen(self, name: str, value: Column, inclusive: bool = True) -> "Ordered":
        """Earliest non-null ``value`` from this row on."""
        self.settle()
        w = self.window().rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
        self.df = self.df.withColumn("_v", value).withColumn(name, F.first("_v", ignorenulls=True).over(w))
        if self.split:
            at = F.struct("_g", "_v")
            self._carry(
                name,
                F.min(F.when(F.col("_v").isNotNull(), at)).getField("_v"),
                lambda w: F.first("_c", ignorenulls=True).over(w),
                lambda own, c: F.coalesce(own, c),
                backward=True,
            )
        self.df = self.df.drop("_v")
        return self

    def _carry(self, name, block_agg, prefix, merge, backward: bool = False) -> None:
        """Join the prefix over one row per (key, block) back to the rows."""
        ends = self.df.groupBy(*self.keys, "_blk").agg(block_agg.alias("_c"))
        w = Window.partitionBy(*self.keys).orderBy("_blk")
        w = w.rowsBetween(1, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*self.keys, "_blk", prefix(w).alias("_pre"))
        self.df = _join_same(self.df, ends, [*self.keys, "_blk"]).withColumn(name, merge(F.col(name), F.col("_pre"))).drop("_pre")

    def position(self, name: str = "_i") -> "Ordered":
        """0-based row number inside the key."""
        local = (F.row_number().over(self.window()) - 1).cast("bigint")
        if not self.split:
            return self.add(**{name: local})
        self.settle().add(_local=local).stats(_g0=F.min("_g"))
        return self.add(**{name: F.coalesce(F.col("_g") - F.col("_g0"), F.col("_local"))}).drop("_g0", "_local")

    def stats(self, **aggs: Column) -> "Ordered":
        """Whole-key aggregates on every row (halo copies not counted)."""
        self.settle()
        if not self.split:
            w = Window.partitionBy(*self.keys, "_blk")
            return self.add(**{n: a.over(w) for n, a in aggs.items()})
        per_key = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        self.df = _join_same(self.df, per_key, self.keys)
        return self

    def attach(self, per_key: DataFrame) -> "Ordered":
        """Inner join one row per key."""
        self.df = _join_same(self.df, per_key, self.keys)
        return self

    def drop(self, *cols: str) -> "Ordered":
        self.df = self.df.drop(*cols)
        return self

    def rows(self) -> DataFrame:
        return self.settle().df.drop(*_HELPERS)


def _join_same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that matches null keys; the smaller side decides the strategy."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, split: bool | DataFrame | None = None, **fracs: float) -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    Small keys use the built-in aggregate. When a key is large, its values are
    ranked by the range-partitioned numbering and only the two neighbours of
    each cut are kept.
    """
    df = df.filter(F.col(value).isNotNull())
    small, large = part_by_size(df, decide(df, keys, split))
    out = None
    if small is not None:
        out = small.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in fracs.items()])
    if large is None:
        return out
    ranked = _ranked_quantiles(large, keys, value, fracs)
    return ranked if out is None else out.unionByName(ranked)


def _ranked_quantiles(df: DataFrame, keys: Sequence[str], value: str, fracs: dict[str, float]) -> DataFrame:
    g = number_rows(df.select(*keys, value), keys, [value])
    span = g.groupBy(*keys).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    j = _join_same(g, span, keys).withColumn("_k", F.col("_g") - F.col("_g0"))
    cuts = {n: F.lit(float(p)) * (F.col("_n") - 1) for n, p in fracs.items()}
    j = j.filter(F.array_contains(F.array(*[e for c in cuts.values() for e in (F.floor(c), F.ceil(c))]), F.col("_k")))
    aggs = []
    for n, c in cuts.items():
        lo = F.max(F.when(F.col("_k") == F.floor(c), F.col(value)))
        hi = F.max(F.when(F.col("_k") == F.ceil(c), F.col(value)))
        frac = F.max(c - F.floor(c))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    return j.groupBy(*keys).agg(*aggs)
