"""Per-series point-in-time features (E-01 ... E-24).

All windows of a feature set share one block layout (``ordered.Panel``): one shuffle and one sort, whatever the
number of features, and no task ever holds more than one block of one series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import OHLCV, clip, ratio
from barloom.operators.bars import bar_slot, clean_bars
from barloom.operators.ordered import (
    BLOCK_ROWS,
    Panel,
    block_by_position,
    neighbour,
    positions,
    running,
    running_ema,
    time_slot,
)

KEYS = ("symbol",)


@dataclass(frozen=True)
class FeatureSpec:
    """What to compute.  ``returns`` is always on; windows are in bars."""

    zscore: Sequence[int] = ()
    volatility: Sequence[int] = ()
    parkinson: Sequence[int] = ()
    sma: Sequence[int] = ()
    ema: Sequence[int] = ()
    roc: Sequence[int] = ()
    momentum: Sequence[int] = ()
    rsi: Sequence[int] = ()
    close_vs_sma: Sequence[int] = ()
    volume_ema_ratio: Sequence[int] = ()
    market_beta: Sequence[int] = ()
    benchmark: str | None = None
    bench_corr: Sequence[int] = ()
    bench_beta: Sequence[int] = ()
    clock: bool = True
    custom: dict[str, Callable[[Panel], Column]] = field(default_factory=dict)
    custom_back: int = 0

    def reach(self) -> int:
        """Rows before a bar its unlagged features can see."""
        sizes = [
            *self.zscore, *self.volatility, *self.parkinson, *self.sma, *self.roc, *self.momentum, *self.rsi,
            *self.close_vs_sma, *self.market_beta, *self.bench_corr, *self.bench_beta, self.custom_back, 1,
        ]
        return max(sizes) + 1

    def names(self) -> list[str]:
        spans = {
            "zscore": self.zscore, "volatility": self.volatility, "parkinson_vol": self.parkinson, "sma": self.sma,
            "ema": self.ema, "roc": self.roc, "rsi": self.rsi, "close_vs_sma": self.close_vs_sma,
            "volume_ema_ratio": self.volume_ema_ratio, "beta": self.market_beta, "bench_corr": self.bench_corr,
            "bench_beta": self.bench_beta,
        }
        out = ["return_1p", *(f"{k}_{w}" for k, ws in spans.items() for w in ws)]
        out += [f"momentum_{n}p" for n in self.momentum]
        out += [f"close_vs_sma_{n}_excess" for n in self.close_vs_sma]
        out += ["hod_sin", "hod_cos", "round_proximity"] if self.clock else []
        return out + list(self.custom)


def full(panel: Panel, column: str, n: int, agg: Callable[[Column], Column]) -> Column:
    """Aggregate over the last ``n`` rows, NULL until ``n`` values are present."""
    frame = panel.rows(n)
    return F.when(F.count(column).over(frame) == n, agg(F.col(column)).over(frame))


def return_1p(panel: Panel) -> Column:
    """E-01: close over previous close, minus one."""
    return ratio("close", F.lag("close").over(panel.w)) - 1


def zscore(panel: Panel, n: int) -> Column:
    """E-02: distance of close from its rolling mean in rolling deviations; NULL without spread."""
    return F.try_divide(F.col("close") - full(panel, "close", n, F.avg), full(panel, "close", n, F.stddev_samp))


def volatility(panel: Panel, n: int) -> Column:
    """E-03: rolling deviation of one-bar returns scaled by sqrt(n)."""
    return full(panel, "return_1p", n, F.stddev_samp) * math.sqrt(n)


def parkinson_vol(panel: Panel, n: int) -> Column:
    """E-04: root mean of the scaled squared log range (column ``_range2``)."""
    return F.sqrt(full(panel, "_range2", n, F.avg))


def squared_range() -> Column:
    return F.pow(F.ln(ratio("high", "low")), 2) / (4 * math.log(2))


def sma(panel: Panel, n: int) -> Column:
    """E-05."""
    return full(panel, "close", n, F.avg)


def roc(panel: Panel, n: int) -> Column:
    """E-07 / E-14: close over the close ``n`` bars ago, minus one."""
    return ratio("close", F.lag("close", n).over(panel.w)) - 1


def hour_of_day() -> dict[str, Column]:
    """E-08: position of the bar in the day on the unit circle."""
    angle = F.lit(2 * math.pi) * F.hour("ts") / 24.0
    return {"hod_sin": F.sin(angle), "hod_cos": F.cos(angle)}


def round_proximity() -> Column:
    """E-09: zero at a power of ten, down to -0.5 half-way between two in log space."""
    logp = F.log10(F.greatest(F.col("close"), F.lit(1e-9)))
    frac = logp - F.floor(logp)
    return -F.least(F.abs(frac), F.abs(1 - frac))


def slope(panel: Panel, y: str, x: str, n: int) -> Column:
    """cov(y, x) / var(x) over the last ``n`` rows in which both are present; NULL until there are ``n``."""
    frame = panel.rows(n)
    both = F.count(F.col(y) + F.col(x)).over(frame)
    return F.when(
        both == n, F.try_divide(F.covar_samp(y, x).over(frame), F.var_samp(x).over(frame))
    )


def correlation(panel: Panel, y: str, x: str, n: int) -> Column:
    frame = panel.rows(n)
    spread = F.stddev_samp(y).over(frame) * F.stddev_samp(x).over(frame)
    both = F.count(F.col(y) + F.col(x)).over(frame)
    return F.when(both == n, F.try_divide(F.covar_samp(y, x).over(frame), spread))


def rsi(panel: Panel, n: int) -> Column:
    """E-15: from mean gains and losses of the last ``n`` changes (columns ``_gain``, ``_loss``)."""
    rs = F.try_divide(full(panel, "_gain", n, F.avg), full(panel, "_loss", n, F.avg))
    return 100 - 100 / (1 + rs)


def lagged_zscore(panel: Panel, value: str, lookback: int = 200) -> Column:
    """E-13: current value against mean and deviation of up to ``lookback`` earlier rows, at least a quarter of them."""
    lookback = lookback if lookback > 0 else 200
    frame = panel.w.rowsBetween(-lookback, -1)
    ready = F.count(value).over(frame) >= max(5, lookback // 4)
    z = F.try_divide(F.col(value) - F.avg(value).over(frame), F.stddev_samp(value).over(frame))
    return F.when(ready, z)


def lag_features(panel: Panel, names: Sequence[str]) -> Panel:
    """E-11: every feature moves one bar later, so a row only knows what was known before it."""
    return panel.with_columns({n: F.lag(n).over(panel.w) for n in names})


def market_return(returns: DataFrame, value: str = "return_1p") -> DataFrame:
    """C-10: median return over all series per timestamp; a group holds one value per series, counted by value first."""
    return returns.groupBy("ts").agg(F.percentile(value, 0.5).alias("market_return"))


def with_emas(df: DataFrame, keys: Sequence[str], pos: str, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """E-06: span averages (weight 2 / (span + 1), started at the first value)."""
    return running_ema(df, keys, pos, {name: (c, 2.0 / (span + 1)) for name, (c, span) in spans.items()})


def feature_panel(
    bars: DataFrame,
    spec: FeatureSpec,
    timeframe: str,
    keys: Sequence[str] = KEYS,
    lag: bool = True,
    extra_back: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> Panel:
    """E-12: clean, compute, lag.  Layout columns stay so that signals can reuse the same sort."""
    df = positions(clean_bars(bars), keys, ["ts"], bar_slot("ts", timeframe), "_pos")
    emas = {f"ema_{n}": ("close", n) for n in spec.ema}
    emas |= {f"_vema_{n}": ("volume", n) for n in spec.volume_ema_ratio}
    df = with_emas(df, keys, "_pos", emas)
    back = spec.reach() + (1 if lag else 0) + extra_back
    if spec.market_beta:
        first = block_by_position(df, keys, "_pos", back=1, block_rows=block_rows)
        df = first.with_columns({"return_1p": return_1p(first)}).home(keep_pos=True)
        df = df.join(market_return(df), "ts", "left")
    if spec.benchmark and (spec.bench_corr or spec.bench_beta):
        df = df.join(benchmark_returns(bars, spec.benchmark, timeframe), "ts", "left")
    panel = block_by_position(df, keys, "_pos", back, ahead, block_rows)
    steps: dict[str, Column] = {}
    if not spec.market_beta:
        steps["return_1p"] = return_1p(panel)
    if spec.parkinson:
        steps["_range2"] = squared_range()
    if spec.rsi:
        change = F.col("close") - F.lag("close").over(panel.w)
        steps |= {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))}
        steps = {
            k: (F.when(F.lag("close").over(panel.w).isNotNull(), v) if k in ("_gain", "_loss") else v)
            for k, v in steps.items()
        }
    panel = panel.with_columns(steps) if steps else panel
    cols: dict[str, Column] = {}
    cols |= {f"zscore_{n}": zscore(panel, n) for n in spec.zscore}
    cols |= {f"volatility_{n}": volatility(panel, n) for n in spec.volatility}
    cols |= {f"parkinson_vol_{n}": parkinson_vol(panel, n) for n in spec.parkinson}
    cols |= {f"sma_{n}": sma(panel, n) for n in spec.sma}
    cols |= {f"roc_{n}": roc(panel, n) for n in spec.roc}
    cols |= {f"momentum_{n}p": roc(panel, n) for n in spec.momentum}
    cols |= {f"rsi_{n}": rsi(panel, n) for n in spec.rsi}
    cols |= {f"close_vs_sma_{n}": ratio("close", sma(panel, n)) for n in spec.close_vs_sma}
    cols |= {f"close_vs_sma_{n}_excess": ratio("close", sma(panel, n)) - 1 for n in spec.close_vs_sma}
    cols |= {f"volume_ema_ratio_{n}": ratio("volume", f"_vema_{n}") for n in spec.volume_ema_ratio}
    cols |= {f"beta_{n}": slope(panel, "return_1p", "market_return", n) for n in spec.market_beta}
    if spec.benchmark:
        cols |= {f"bench_corr_{n}": correlation(panel, "return_1p", "bench_return", n) for n in spec.bench_corr}
        cols |= {f"bench_beta_{n}": slope(panel, "return_1p", "bench_return", n) for n in spec.bench_beta}
    if spec.clock:
        cols |= {**hour_of_day(), "round_proximity": round_proximity()}
    cols |= {name: build(panel) for name, build in spec.custom.items()}
    panel = panel.with_columns(cols) if cols else panel
    return lag_features(panel, spec.names()) if lag else panel


def build_features(bars: DataFrame, spec: FeatureSpec, timeframe: str, keys: Sequence[str] = KEYS, **layout) -> DataFrame:
    """E-12: bars plus their feature columns."""
    panel = feature_panel(bars, spec, timeframe, keys, **layout)
    return panel.home().select(*keys, "ts", *OHLCV, *spec.names())


def benchmark_returns(bars: DataFrame, symbol: str, timeframe: str) -> DataFrame:
    """E-18: close and one-bar return of one series, keyed by time."""
    one = clean_bars(bars.where(F.col("symbol") == symbol)).select("symbol", "ts", "close")
    seen = neighbour(one, ["symbol"], ["ts"], bar_slot("ts", timeframe), {"_prev": "close"})
    return seen.select("ts", F.col("close").alias("bench_close"), (ratio("close", "_prev") - 1).alias("bench_return"))


def pair_ratio(bars: DataFrame, a: str, b: str, name: str = "pair_ratio") -> DataFrame:
    """E-19: close of one series over the close of another at the same time."""
    left = bars.where(F.col("symbol") == a).select("ts", F.col("close").alias("_a"))
    right = bars.where(F.col("symbol") == b).select("ts", F.col("close").alias("_b"))
    return left.join(right, "ts").select("ts", ratio("_a", "_b").alias(name))


def _tail_returns(bars: DataFrame, keys: Sequence[str], n: int, log: bool) -> DataFrame:
    """The last ``n`` one-bar returns per series, from its newest n + 1 bars (a group limit below the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    tail = bars.select(*keys, "ts", "close").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n + 1)
    prev = F.lead("close").over(newest)
    change = F.ln(ratio("close", prev)) if log else ratio("close", prev) - 1
    return tail.withColumn("_ret", change).where(F.col("_r") <= n)


def latest_vol(bars: DataFrame, lookback: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """E-20: deviation of the last ``lookback`` log returns; NULL when there are fewer."""
    t = _tail_returns(bars, keys, lookback, log=True)
    return t.groupBy(*keys).agg(
        F.when(F.count("_ret") == lookback, F.stddev_samp("_ret")).alias("vol"), F.max_by("close", "ts").alias("last_close")
    )


def vol_target_size(vols: DataFrame, equity: str, max_order: str, target_risk: float = 0.01) -> DataFrame:
    """E-21: units whose one-deviation move is ``target_risk`` of equity, within the order cap; zero without a vol."""
    price = F.col("last_close")
    by_risk = F.try_divide(F.col(equity) * target_risk, price * F.col("vol"))
    size = F.least(by_risk, F.try_divide(F.col(max_order), price))
    return vols.withColumn("size", F.when(F.col("vol").isNull() | (F.col("vol") == 0), F.lit(0.0)).otherwise(F.coalesce(size, F.lit(0.0))))


def adaptive_stop(
    bars: DataFrame, window: int = 24, multiplier: float = 6.0, floor: float = 0.05, ceiling: float = 0.20,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """E-22: stop distance from the newest volatility, clipped; series with more than ten returns only."""
    t = _tail_returns(bars, keys, window, log=False)
    n = bars.groupBy(*keys).agg((F.count("close") - 1).alias("n_returns"))
    vol = t.groupBy(*keys).agg(F.stddev_samp("_ret").alias("_vol"))
    return n.where(F.col("n_returns") > 10).join(vol, list(keys)).select(
        *keys, "n_returns", clip(F.col("_vol") * multiplier, floor, ceiling).alias("stop_pct")
    )


def drawdown(df: DataFrame, value: str, target: float, slot_days: int = 365) -> DataFrame:
    """E-23: fall from the running maximum, and progress towards a target."""
    out = running(df, [], ["ts"], time_slot("ts", slot_days * 86400), peak=("max", value))
    return out.withColumns(
        {"drawdown": F.try_divide(F.col(value) - F.col("peak"), F.col("peak")), "progress": F.col(value) / F.lit(target)}
    )


def ewma_state(df: DataFrame, keys: Sequence[str], order: Sequence, slot: Column, value: str, alpha: float = 0.3, name: str = "smoothed") -> DataFrame:
    """E-24: recursive smoothing of a metric over its update log; the first value starts the state."""
    ranked = positions(df, keys, order, slot, "_pos")
    return running_ema(ranked, keys, "_pos", {name: (value, alpha)}).drop("_pos")
