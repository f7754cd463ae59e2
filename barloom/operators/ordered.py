"""Ordered computation that never puts a whole key into one task.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` sorts one symbol inside one task, so a symbol that holds a
third of all rows decides the run time of the job.  The functions here split a key into *slots* (a
deterministic, order-preserving bucket of the sort key, e.g. a span of time) and stitch the slots together with
small per-slot aggregates:

* ``positions``     exact 1-based row number per key
* ``running``       exact unbounded running sum / count / min / max / last-non-null
* ``running_ema``   exact recursive average
* ``blocked``       bounded row windows: equal blocks of consecutive positions, each carrying a copy of the few
                    rows before / after it that its windows reach into
* ``quantiles``     exact interpolated quantiles from distinct-value counts

A slot is a function of the row alone (a span of time), or a stored column of data-driven ranges (``ranged``), so
recomputed tasks always agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stored

SLOT, BLOCK, HOME, RANGE = "_slot", "_block", "_home", "_range"
BLOCK_ROWS = 1 << 16


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column of either timestamp type."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def time_slot(ts: str | Column, seconds: int) -> Column:
    """Order-preserving time bucket; on a bar grid it bounds the rows per (key, slot) by seconds / bar length."""
    return F.floor(epoch_us(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = RANGE) -> DataFrame:
    """Rows with a slot of data-driven edges: the range of (keys, order) a row lies in, numbered along the order.

    Spark draws the edges from a sample of all the sort columns, so ranges hold about as many rows each wherever the
    values lie, and rows that tie in the first column are split by the next ones; ``order`` should therefore end in a
    column that tells ties apart.  The result is a stored table, since another sample would draw other edges: every
    reader, and every task that is run again, sees the same slots.  Small tables are one range.
    """
    lead = [F.col(k).asc_nulls_first() for k in keys]
    placed = df.repartitionByRange(*lead, *[F.col(o) if isinstance(o, str) else o for o in order])
    return stored(placed.withColumn(name, F.spark_partition_id()), "ranged")


def exact_positions(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "pos") -> DataFrame:
    """``positions`` in any total order of any columns, with slots from :func:`ranged`."""
    return positions(ranged(df, keys, order), keys, order, F.col(RANGE), name).drop(RANGE)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row; the row is broadcast, its size is fixed."""
    return df.join(F.broadcast(one_row))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``; without keys the right side is one total.

    Plain equality keeps the partitioning a preceding window or aggregate on the same keys already has, so only
    the small side moves.  The stitching joins below are left joins: a row with a NULL key stays in the result.
    """
    return left.join(right, list(keys), how) if keys else beside(left, right)


def _prefix(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, slot: Column, name: str = "pos") -> DataFrame:
    """Exact 1-based row number per key; ``order`` must be total and ``slot`` non-decreasing along it.

    For slots that follow from the row (spans of time); see :func:`exact_positions` for any other order.
    """
    tagged = df.withColumn(SLOT, slot)
    counts = tagged.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_prefix(keys)), F.lit(0))
    offsets = counts.select(*keys, SLOT, before.alias("_offset"))
    local = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, SLOT).orderBy(*order)))
    joined = match(local, offsets, [*keys, SLOT], "left")
    return joined.withColumn(name, (F.col("_rn") + F.coalesce("_offset", F.lit(0))).cast("long")).drop("_rn", "_offset", SLOT)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, slot: Column, **wanted) -> DataFrame:
    """Unbounded running aggregates per key.

    ``wanted`` maps an output name to ``(kind, column)`` with kind in sum, count, min, max, last; *last* is the
    latest non-null value.  ``order`` columns must be names when *last* is used.
    """
    tagged = df.withColumn(SLOT, slot)
    local_w = Window.partitionBy(*keys, SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    slot_aggs, local, carry = [], {}, []
    for name, (kind, column) in wanted.items():
        c = F.col(column) if isinstance(column, str) else column
        if kind == "last":
            slot_aggs.append(F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_s_{name}"))
            local[name] = F.last(c, ignorenulls=True).over(local_w)
            carry.append(F.last(f"_s_{name}", ignorenulls=True).over(_prefix(keys)).alias(f"_c_{name}"))
        else:
            slot_aggs.append(plain[kind](c).alias(f"_s_{name}"))
            local[name] = plain[kind](c).over(local_w)
            over = F.sum if kind == "count" else plain[kind]
            carry.append(over(f"_s_{name}").over(_prefix(keys)).alias(f"_c_{name}"))
    carried = tagged.groupBy(*keys, SLOT).agg(*slot_aggs).select(*keys, SLOT, *carry)
    out = match(tagged.withColumns(local), carried, [*keys, SLOT], "left")
    merged = {}
    for name, (kind, _) in wanted.items():
        here, before = F.col(name), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            merged[name] = F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
        elif kind == "last":
            merged[name] = F.coalesce(here, before)
        else:
            merged[name] = (F.least if kind == "min" else F.greatest)(here, before)
    return out.withColumns(merged).drop(SLOT, *(f"_c_{n}" for n in wanted))


@dataclass(frozen=True)
class Panel:
    """Rows laid out in blocks: windows over ``w`` are exact for every home row."""

    df: DataFrame
    keys: tuple[str, ...]
    pos: str
    back: int
    ahead: int

    @property
    def w(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(self.pos)

    def rows(self, n: int, end: int = 0):
        """Frame of the ``n`` rows that end ``-end`` rows before the current one."""
        return self.w.rowsBetween(end - (n - 1), end)

    def with_columns(self, cols: dict[str, Column]) -> "Panel":
        return Panel(self.df.withColumns(cols), self.keys, self.pos, self.back, self.ahead)

    def home(self, keep_pos: bool = False) -> DataFrame:
        """Drop the copied context rows and the layout columns."""
        drop = [BLOCK, HOME] + ([] if keep_pos else [self.pos])
        return self.df.where(F.col(HOME)).drop(*drop)


def block_by_position(
    df: DataFrame, keys: Sequence[str], pos: str, back: int = 0, ahead: int = 0, block_rows: int = BLOCK_ROWS
) -> Panel:
    """Lay rows with known 1-based positions out in blocks, copying only the rows a neighbour's windows need."""
    size = max(block_rows, back, ahead, 1)
    own = F.floor((F.col(pos) - 1) / F.lit(size)).cast("long")
    inside = F.pmod(F.col(pos) - 1, F.lit(size))
    targets = [F.struct(own.alias(BLOCK), F.lit(True).alias(HOME))]
    if back:
        targets.append(F.when(inside >= size - back, F.struct((own + 1).alias(BLOCK), F.lit(False).alias(HOME))))
    if ahead:
        targets.append(
            F.when((inside < ahead) & (own > 0), F.struct((own - 1).alias(BLOCK), F.lit(False).alias(HOME)))
        )
    if len(targets) == 1:
        laid = df.withColumns({BLOCK: own, HOME: F.lit(True)})
    else:
        laid = df.select("*", F.inline(F.array_compact(F.array(*targets))))
    return Panel(laid, tuple(keys), pos, back, ahead)


def blocked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    slot: Column,
    back: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    pos: str = "_pos",
) -> Panel:
    """``positions`` followed by ``block_by_position``."""
    return block_by_position(positions(df, keys, order, slot, pos), keys, pos, back, ahead, block_rows)


def _fold(per_run: float):
    return lambda acc, x: acc * F.lit(per_run) + x


def running_ema(
    df: DataFrame, keys: Sequence[str], pos: str, wanted: dict[str, tuple[str, float]], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Recursive averages y0 = x0, y = a*x + (1-a)*y over rows with known 1-based positions.

    ``wanted`` maps an output name to ``(column, a)``.  The recurrence is linear, so a run of K rows is summarised
    by one number and the carry into the next run is a short fold over the preceding runs; the fold stops where
    the weight of older runs is below 1e-30.
    """
    if not wanted:
        return df
    decay = {n: 1.0 - a for n, (_, a) in wanted.items()}
    steep = max((-math.log10(d) for d in decay.values() if d > 0), default=0.0)
    run_rows = 256 if steep == 0 else max(1, min(256, int(200 / steep)))
    run, step = "_run", "_step"
    df = df.withColumns(
        {
            run: F.floor((F.col(pos) - 1) / F.lit(run_rows)).cast("long"),
            step: F.pmod(F.col(pos) - 1, F.lit(run_rows)).cast("double"),
        }
    )
    w = Window.partitionBy(*keys, run).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (column, a) in wanted.items():
        d = decay[name]
        if d <= 0:
            local[name] = F.col(column)
            continue
        seed = F.when(F.col(pos) == 1, F.lit(1.0)).otherwise(F.lit(a))
        scaled = seed * F.col(column) * F.pow(F.lit(d), -F.col(step))
        local[name] = F.sum(scaled).over(w) * F.pow(F.lit(d), F.col(step))
    local_df = df.withColumns(local)
    live = [n for n in wanted if decay[n] > 0]
    if not live:
        return local_df.drop(run, step)
    ends = (
        local_df.groupBy(*keys, run)
        .agg(*(F.max_by(n, pos).alias(f"_e_{n}") for n in live))
        .withColumn("_rpos", F.col(run) + 1)
    )
    reach = {n: max(1, math.ceil(30 / (run_rows * -math.log10(decay[n])))) for n in live}
    panel = block_by_position(ends, keys, "_rpos", back=max(reach.values()), block_rows=block_rows)
    carry = {}
    for n in live:
        before = F.collect_list(f"_e_{n}").over(panel.w.rowsBetween(-reach[n], -1))
        carry[f"_c_{n}"] = F.aggregate(before, F.lit(0.0), _fold(decay[n] ** run_rows))
    carried = panel.with_columns(carry).home().select(*keys, run, *carry)
    out = match(local_df, carried, [*keys, run], "left")
    merged = {n: F.col(n) + F.col(f"_c_{n}") * F.pow(F.lit(decay[n]), F.col(step) + 1) for n in live}
    return out.withColumns(merged).drop(run, step, *carry)


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, cols: dict[str, str], ahead: bool = False
) -> DataFrame:
    """Value of ``cols`` (output name -> column) in the previous row of the key, or the next one when ``ahead``.

    Rows next to each other in a slot see each other directly; the row at a slot's edge gets the edge row of the
    nearest non-empty slot.
    """
    tagged = df.withColumn(SLOT, slot)
    w = Window.partitionBy(*keys, SLOT).orderBy(*order)
    pick, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    local = {n: pick(c).over(w) for n, c in cols.items()}
    local["_edge"] = pick(F.lit(1)).over(w).isNull()
    edges = tagged.groupBy(*keys, SLOT).agg(
        edge(F.struct(*(F.col(c).alias(n) for n, c in cols.items())), F.struct(*order)).alias("_row")
    )
    across = Window.partitionBy(*keys).orderBy(SLOT)
    edges = edges.select(*keys, SLOT, pick("_row").over(across).alias("_near"))
    out = match(tagged.withColumns(local), edges, [*keys, SLOT], "left")
    merged = {n: F.when(F.col("_edge"), F.col(f"_near.{n}")).otherwise(F.col(n)) for n in cols}
    return out.withColumns(merged).drop("_edge", "_near", SLOT)


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with the half-open range of 0-based ranks [_first, _last) they fill, and the key's total."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = ranged(counts, keys, [value])
    cum = running(counts, keys, [value], F.col(RANGE), _last=("sum", "_c")).drop(RANGE)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    ranked = match(cum, totals, keys, "left")
    return ranked.withColumn("_first", F.col("_last") - F.col("_c"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key.

    Works on counts per distinct value, so repeated values collapse before the shuffle and no group is ever
    gathered in one place.
    """
    aggs, picks = [], []
    for i, (name, q) in enumerate(probs.items()):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((F.col("_first") <= lo) & (lo < F.col("_last")), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when((F.col("_first") <= hi) & (hi < F.col("_last")), F.col(value))).alias(f"_hi{i}"),
            F.max(at - lo).alias(f"_w{i}"),
        ]
        picks.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name))
    return _ranked_values(df, keys, value).groupBy(*keys).agg(*aggs).select(*keys, *picks)


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, rank, name: str) -> DataFrame:
    """Value at a 0-based rank per key; ``rank`` maps the key's count (Column) to the rank (Column)."""
    r = rank(F.col("_total"))
    hit = F.when((F.col("_first") <= r) & (r < F.col("_last")), F.col(value))
    return _ranked_values(df, keys, value).groupBy(*keys).agg(F.max(hit).alias(name))
