"""Events of a sampled signal: peaks of two coupled detectors as a fold over each read's t-statistics, means between them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixweave.operators.signal import t_statistic


@dataclass(frozen=True)
class EventConfig:
    window_short: int = 3
    window_long: int = 9
    threshold_short: float = 4.0
    threshold_long: float = 3.5
    height: float = 0.4
    longest: int = 500


def event_config(device: str = "", sensitivity: float = 1.0, **own) -> EventConfig:
    """Fixed values by device, thresholds divided by the sensitivity, own settings last."""
    base = EventConfig(4, 10, 4.0, 3.0, 0.4) if device.lower().startswith("r10") else EventConfig()
    base = replace(base, threshold_short=base.threshold_short / sensitivity, threshold_long=base.threshold_long / sensitivity)
    return replace(base, **{k: v for k, v in own.items() if v is not None})


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), 0)


NO_PEAK = "cast(null as int)"


def tracker(at: Column | None = None, level: Column | None = None, sure: Column | None = None) -> Column:
    """State of a detector: at, the place of the peak it is on (null: it follows the signal down); level, the peak's height or the lowest value; sure, whether the signal has fallen enough behind the peak."""
    return F.struct((F.expr(NO_PEAK) if at is None else at).alias("at"), (F.lit(float("inf")) if level is None else level).alias("level"), (F.lit(False) if sure is None else sure).alias("sure"))


def followed(d: Column, now: Column, i: Column, limit: float, cfg: EventConfig) -> Column:
    """The detector after one more value, with on (it was on a peak before) and high (that peak is over the limit)."""
    down = d["at"].isNull()
    rises = F.when(down, now - d["level"] > cfg.height).otherwise(now > d["level"])
    level = F.when(rises, now).when(down, F.least(d["level"], now)).otherwise(d["level"])
    def rest(level: Column) -> Column:
        high = ~down & (level > limit)
        return F.struct(F.when(rises, i).otherwise(d["at"]).alias("at"), level.alias("level"), (d["sure"] | (high & (level - now > cfg.height))).alias("sure"), (~down).alias("on"), high.alias("high"))
    return let(level, rest)


def settled(d: Column, now: Column, i: Column, width: int) -> Column:
    """(next state, peak given off or null): a sure peak ends once it lies more than half a window back."""
    ends = d["on"] & d["sure"] & (i - d["at"] > width // 2)
    return F.struct(F.when(ends, tracker(level=now)).otherwise(tracker(d["at"], d["level"], d["sure"])).alias("state"), F.when(ends, d["at"]).alias("peak"))


def peaks(pairs: Column, cfg: EventConfig) -> Column:
    """array<int> of peaks, in order of detection, of an array<struct<a, b>> of short and long t-statistics. While the short detector is on a high peak, the long one starts over behind it."""
    def step(s: Column, x: Column) -> Column:
        i = x["i"]

        def both(short: Column) -> Column:
            masked = short["high"]
            until = F.when(masked, short["at"] + cfg.window_short).otherwise(s["until"])
            before = F.when(masked, tracker()).otherwise(s["long"])

            def after(one: Column) -> Column:
                def done(two: Column) -> Column:
                    found = F.filter(F.array(one["peak"], two["peak"]), lambda p: p.isNotNull())
                    return F.struct(one["state"].alias("short"), two["state"].alias("long"), until.alias("until"), F.concat(s["out"], found).alias("out"))

                long = F.when(until < i, let(followed(before, x["b"], i, cfg.threshold_long, cfg), lambda d: settled(d, x["b"], i, cfg.window_long))).otherwise(
                    F.struct(before.alias("state"), F.expr(NO_PEAK).alias("peak")))
                return let(long, done)

            return let(settled(short, x["a"], i, cfg.window_short), after)

        return let(followed(s["short"], x["a"], i, cfg.threshold_short, cfg), both)

    start = F.struct(tracker().alias("short"), tracker().alias("long"), F.lit(0).alias("until"), F.array().cast("array<int>").alias("out"))
    numbered = F.transform(pairs, lambda x, i: F.struct(i.alias("i"), x["a"].alias("a"), x["b"].alias("b")))
    # the first value starts no detector
    return F.aggregate(F.slice(numbered, F.lit(2), F.greatest(F.size(numbered) - 1, F.lit(0))), start, step, lambda s: s["out"])


def read_peaks(samples: DataFrame, cfg: EventConfig) -> DataFrame:
    """read, values (its samples in order), peaks. A read is one row, bounded by its length."""
    both = t_statistic(samples, cfg.window_short).withColumnRenamed("t", "a").join(t_statistic(samples, cfg.window_long).withColumnRenamed("t", "b"), ["read", "idx"])
    rows = both.join(samples.select("read", "idx", "pa"), ["read", "idx"])
    reads = rows.groupBy("read").agg(F.sort_array(F.collect_list(F.struct("idx", "a", "b", "pa"))).alias("x"))
    return reads.select("read", F.transform("x", lambda v: v["pa"]).alias("values"), peaks(F.col("x"), cfg).alias("peaks"))


def event_peaks(samples: DataFrame, cfg: EventConfig | None = None) -> DataFrame:
    """read, ord, peak in order of detection."""
    found = read_peaks(samples, cfg or EventConfig())
    return found.select("read", F.posexplode("peaks").alias("ord", "peak")).select("read", F.col("ord").cast("long").alias("ord"), F.col("peak").cast("long").alias("peak"))


def trimmed_mean(values: Column) -> Column:
    """Mean of an array's values within one quartile range of its quartiles; 0 of an empty one."""
    n = F.size(values)

    def mean(x: Column) -> Column:
        low, high = F.get(x, F.floor(n / 4).cast("int")), F.get(x, F.floor(n * 3 / 4).cast("int"))
        return let(F.filter(x, lambda v: (v >= 2 * low - high) & (v <= 2 * high - low)), lambda y: F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.size(y))

    return F.when(n > 0, let(F.sort_array(values), mean)).otherwise(0.0)


def events(samples: DataFrame, cfg: EventConfig | None = None) -> DataFrame:
    """read, ord, start, end, mean of the segment before each peak; segments of cfg.longest samples or more are left out, and so is what follows the last peak."""
    cfg = cfg or EventConfig()
    found = read_peaks(samples, cfg)
    cuts = F.transform("peaks", lambda p, k: F.struct(k.cast("long").alias("ord"), F.coalesce(F.get("peaks", k - 1), F.lit(0)).alias("start"), p.alias("end")))
    rows = found.select("read", "values", F.inline(F.filter(cuts, lambda c: c["end"] - c["start"] < cfg.longest)))
    part = F.expr("slice(values, start + 1, greatest(end - start, 0))")
    return rows.select("read", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), trimmed_mean(part).alias("mean"))
