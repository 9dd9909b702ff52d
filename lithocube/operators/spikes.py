"""Problem 3: implausible values in measured series, judged against the same run.

Peaks over threshold: residuals against the run's own level by depth, less what recurs with every cycle of depth (the
seasonal part), a generalised Pareto tail per run and field, a cutoff at fixed risk. What passes the cutoff is marked
as such; of it, what also passes the exact rule of the statement is a spike. Rules for plausibility, stuck stretches
and lasting changes of level come beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from lithocube.operators.missing import CODES, FIELDS, is_missing
from lithocube.operators.segments import nth, ranked, segmented
from lithocube.session import cut, small

#: Readings on each side that make up the level before and after an episode, and longest episode of a spike.
SIDE, LONGEST = 7, 3
#: Values on each side of one that its level, its residual and the episodes it may belong to are made from.
HALO = 2 * (SIDE + LONGEST)
#: Metres of depth after which the seasonal part recurs, phases in which it is measured, and readings that a phase
#: must have. It is at most SWING scatters large, so the cap of the cutoff less SWING loses no spike.
PERIOD, PHASES, ENOUGH, SWING = 50.0, 10, 8, 2.0
#: A run of more readings is looked at in stretches of this many; its unit, scatters and tails are those of the whole run.
STRETCH = 50_000


def _medians(rows: np.ndarray) -> np.ndarray:
    """Median of each row over its numbers, NaN where it has none."""
    s = np.sort(rows, axis=1)
    n = (~np.isnan(s)).sum(axis=1)
    at = np.arange(len(s))
    lo, hi = s[at, np.maximum(n - 1, 0) // 2], s[at, np.minimum(n // 2, s.shape[1] - 1)]
    return (lo + hi) / 2


def _windows(x: np.ndarray, size: int, first: int) -> np.ndarray:
    """Row i: the `size` values from i + first on."""
    pad = size + abs(first)
    wide = np.concatenate([np.full(pad, np.nan), x, np.full(pad, np.nan)])
    return np.lib.stride_tricks.sliding_window_view(wide, size)[pad + first : pad + first + len(x)]


def _ahead(x: np.ndarray, by: int, fill: float | bool) -> np.ndarray:
    """`x` moved `by` places towards its start."""
    out = np.full(len(x), fill, x.dtype)
    out[: max(len(x) - by, 0)] = x[by:]
    return out


def pareto_cutoff(r: np.ndarray, series: np.ndarray, n_series: int, base: float, risk: float, cap: float) -> np.ndarray:
    """Cutoff per series, in scatters, that a residual passes with probability `risk`.

    A generalised Pareto law is fitted by moments to the excesses over the `base` quantile. Residuals beyond `cap`
    are the errors looked for, so they take no part in the fit, and no cutoff lies above `cap`.
    """
    good = np.isfinite(r) & (r <= cap)
    order = np.lexsort((r[good], series[good]))
    v, k = r[good][order], series[good][order]
    counts = np.bincount(k, minlength=n_series)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    t = np.zeros(n_series)
    some = counts > 0
    t[some] = v[(starts + np.floor(base * (counts - 1)).astype(int))[some]]
    over = v > t[k]
    excess, ke = (v - t[k])[over], k[over]
    m = np.bincount(ke, minlength=n_series)
    mean = np.bincount(ke, excess, n_series) / np.maximum(m, 1)
    square = np.bincount(ke, excess**2, n_series) / np.maximum(m, 1)
    return tail_cutoff(t, counts, m, mean, square, risk, cap)


def tail_cutoff(t: np.ndarray, counts: np.ndarray, m: np.ndarray, mean: np.ndarray, square: np.ndarray, risk: float, cap: float) -> np.ndarray:
    """The cutoffs from `m` of `counts` residuals beyond `t` and the means of their excesses and squared excesses."""
    var = square - mean**2
    ratio = np.divide(mean**2, var, out=np.ones(len(t)), where=var > 0)
    xi, beta = np.clip(0.5 * (1 - ratio), -0.5, 0.4), 0.5 * mean * (ratio + 1)
    tail = np.maximum(m, 1) / np.maximum(counts, 1) / risk
    with np.errstate(divide="ignore", invalid="ignore"):
        z = t + np.where(np.abs(xi) < 1e-6, beta * np.log(tail), beta / xi * (tail**xi - 1))
    return np.where((m >= 5) & np.isfinite(z), np.clip(z, t, cap), cap)


def unlikely(x: np.ndarray, series: np.ndarray, fraction: np.ndarray, stuck: int) -> np.ndarray:
    """1 for impossible values, 2 for members of at least `stuck` successive equal ones, else 0. `fraction` is by series."""
    flag = np.zeros(len(x), np.int8)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (series[1:] != series[:-1])
    stretch = np.cumsum(new) - 1
    flag[np.bincount(stretch)[stretch] >= stuck] = 2
    flag[(x < 0) | (x > np.where(fraction, 1.0, 100.0)[series])] = 1
    return flag


class Line:
    """Series one after the other in one line, apart by numbers that are none, with the levels about every value."""

    def __init__(self, x: np.ndarray, series: np.ndarray):
        apart = SIDE + LONGEST
        self.at = np.arange(len(x)) + apart * np.cumsum(np.concatenate([[0], np.diff(series) != 0]))
        self.line = np.full(self.at[-1] + 1, np.nan)
        self.line[self.at] = x
        self.before = _medians(_windows(self.line, SIDE, -SIDE))
        self.after = _medians(_windows(self.line, SIDE, 0))

    def deviations(self) -> np.ndarray:
        """Deviation from the running median."""
        return (self.line - _medians(_windows(self.line, 2 * (SIDE // 2) + 3, -(SIDE // 2) - 1)))[self.at]

    def from_levels(self) -> tuple[np.ndarray, np.ndarray]:
        """Deviations from the levels before and after each value, NaN at a run's ends."""
        return (self.line - self.before)[self.at], (self.line - _ahead(self.after, 1, np.nan))[self.at]

    def distances(self, season: np.ndarray) -> np.ndarray:
        """What the tail is fitted on: distance, less the seasonal part, from the nearer of the levels before and after,
        so a change of level is none."""
        before, after = self.from_levels()
        with np.errstate(invalid="ignore"):
            return np.fmin(np.abs(before - season), np.abs(after - season))

    def episodes(self, far: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Members of episodes with a candidate by the exact rule: away from the level before and after, one to three long."""
        line, before, after = self.line, self.before, self.after
        reach = np.full(len(line), np.inf)
        reach[self.at] = far
        candidate = np.zeros(len(line), bool)
        candidate[self.at] = candidates
        hit = np.zeros(len(line), bool)
        for length in range(1, LONGEST + 1):
            b, last = before, np.arange(len(line)) + length
            a = np.where(last < len(line), after[np.minimum(last, len(line) - 1)], np.nan)
            # At a run's end there is no level on one side; a short stretch there may be a lasting change and is no case.
            ok = ~np.isnan(a) & ~np.isnan(b)
            # The values next to it must be back at a level, else it is a part of something longer.
            for v in (np.concatenate([[np.nan], line[:-1]]), _ahead(line, length, np.nan)):
                with np.errstate(invalid="ignore"):
                    ok &= (np.abs(v - b) <= reach) | (np.abs(v - a) <= reach)
            any_candidate = np.zeros(len(line), bool)
            for j in range(length):
                v = _ahead(line, j, np.nan)
                with np.errstate(invalid="ignore"):
                    ok &= (np.abs(v - b) > reach) & (np.abs(v - a) > reach)
                any_candidate |= _ahead(candidate, j, False)
            for j in range(length):
                members = np.flatnonzero(ok & any_candidate) + j
                hit[members] = True
        return hit[self.at]


def seasonal(dev: np.ndarray, scatter: np.ndarray, series: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The part of each deviation that recurs in its phase: the mean over the series and phase of deviations cut at
    three scatters, itself cut at SWING scatters; none in phases of fewer than ENOUGH values."""
    at = series * PHASES + phase
    far = 3 * scatter[series]
    n = np.bincount(at)
    mean = np.bincount(at, np.clip(dev, -far, far)) / np.maximum(n, 1)
    return np.where(n[at] >= ENOUGH, np.clip(mean[at], -SWING * scatter[series], SWING * scatter[series]), 0.0)


def flag_series(
    x: np.ndarray, series: np.ndarray, fraction: np.ndarray, base: float = 0.9, risk: float = 1e-3, times: float = 10.0, stuck: int = 6, phase: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of values `x`, which lie series by series in order: 0 none, 1 impossible, 2 stuck, 3 spike; cutoffs; and
    which values pass their cutoff.

    `fraction` tells of each series whether a whole is 1 instead of 100; `phase` is that of each value's depth, without
    it there is no seasonal part.
    """
    n, n_series = len(x), len(fraction)
    flag, beyond = np.zeros(n, np.int8), np.zeros(n, bool)
    if not n:
        return flag, np.zeros(n_series), beyond
    flag = unlikely(x, series, fraction, stuck)
    keep = np.flatnonzero(flag == 0)
    if not keep.size:
        return flag, np.full(n_series, np.inf), beyond
    k = series[keep]
    line = Line(x[keep], k)
    dev = line.deviations()
    r = np.abs(dev)
    order = np.lexsort((r, k))
    counts = np.bincount(k, minlength=n_series)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sorted_r, mid = r[order], np.zeros(n_series)
    some = counts > 0
    mid[some] = (sorted_r[(starts + (counts - 1) // 2)[some]] + sorted_r[(starts + counts // 2)[some]]) / 2
    scatter = 1.4826 * mid
    # Readings so coarse that over half lie on the level: their mean distance takes the place of the median.
    flat = some & (scatter == 0)
    scatter[flat] = (np.bincount(k, np.minimum(r, 1e6), n_series) / np.maximum(counts, 1))[flat]
    season = np.zeros(len(keep)) if phase is None else seasonal(dev, scatter, k, phase[keep])
    with np.errstate(divide="ignore", invalid="ignore"):
        off = line.distances(season) / scatter[k]
        cutoff = pareto_cutoff(off, k, n_series, base, risk, times - SWING)
        candidates = (off > cutoff[k]) & (scatter[k] > 0)
    beyond[keep] = candidates
    flag[keep[line.episodes((times * scatter)[k], candidates)]] = 3
    return flag, cutoff, beyond


def _by_series(keys: list[str], work):
    """`work` on whole series, many at a time, with the number of each row's series; Arrow batches end anywhere."""

    def numbers(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for c in keys:
            v = pdf[c].fillna(-(2**62)).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def run(batches):
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < 100_000:
                continue
            everything = pd.concat(held, ignore_index=True)
            no = numbers(everything)
            tail = no == no[-1]
            if tail.all():
                held = [everything]
                continue
            yield work(everything[~tail], no[~tail])
            held, rows = [everything[tail]], int(tail.sum())
        if rows:
            everything = pd.concat(held, ignore_index=True)
            yield work(everything, numbers(everything))

    return run


def _flagger(options: dict):
    """Runs that fit into one task."""

    def work(pdf: pd.DataFrame, run_no: np.ndarray) -> pd.DataFrame:
        # Repeats: rows of one reading came sorted with the latest first.
        once = ~pdf.duplicated(["run_id", "rid"]).to_numpy()
        pdf, run_no = pdf[once], run_no[once]
        n_runs = run_no[-1] + 1
        values = {f: pdf[f].to_numpy(dtype=float, na_value=np.nan) for f in FIELDS}
        ones, plausible = np.zeros(n_runs), np.zeros(n_runs)
        for x in values.values():
            ones += np.bincount(run_no, (x >= 0) & (x <= 1), n_runs)
            plausible += np.bincount(run_no, (x >= 0) & (x <= 100), n_runs)
        fraction = ones * 2 > plausible
        out = pdf[["log_id", "run_id", *FIELDS]].copy()
        phase = pdf["phase"].to_numpy(np.int64)
        tails = {}
        for f, x in values.items():
            there = np.flatnonzero(~np.isnan(x))
            flags, tail = np.full(len(x), -1, np.int8), np.zeros(len(x), bool)
            flags[there], _, tail[there] = flag_series(x[there], run_no[there], fraction, phase=phase[there], **options)
            out["flag_" + f] = flags
            tails["tail_" + f] = tail
        return out.assign(**tails)

    return _by_series(["run_id"], work)


def _odd_ones(stuck: int):
    def work(pdf: pd.DataFrame, no: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.concatenate([[True], np.diff(no) != 0]))
        out = pdf[["s", "seg", "rid", "phase", "v"]].copy()
        out["flag"] = unlikely(pdf["v"].to_numpy(float), no, pdf["fraction"].to_numpy(bool)[first], stuck)
        out = out[pdf["core"].to_numpy()]
        out["i"] = (out["flag"] == 0).groupby([out["s"], out["seg"]]).cumsum() - 1
        return out

    return _by_series(["s", "seg"], work)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, float).view(np.int64)


def _measured():
    def work(pdf: pd.DataFrame, no: np.ndarray) -> pd.DataFrame:
        line = Line(pdf["v"].to_numpy(float), no)
        dev = line.deviations()
        before, after = line.from_levels()
        out = pd.DataFrame({"s": pdf["s"].to_numpy(), "phase": pdf["phase"].to_numpy(), "dev": dev, "r_bits": _bits(np.abs(dev)), "before": before, "after": after})
        return out[pdf["core"].to_numpy()]

    return _by_series(["s", "seg"], work)


def _episodes(times: float):
    def work(pdf: pd.DataFrame, no: np.ndarray) -> pd.DataFrame:
        line = Line(pdf["v"].to_numpy(float), no)
        scatter, cutoff = pdf["scatter"].to_numpy(float), pdf["cutoff"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            candidates = (line.distances(pdf["season"].to_numpy(float)) / scatter > cutoff) & (scatter > 0)
        out = pdf[["s", "rid"]].assign(hit=line.episodes(times * scatter, candidates), beyond=candidates)
        return out[(out["hit"] | out["beyond"]) & pdf["core"].to_numpy()]

    return _by_series(["s", "seg"], work)


@F.pandas_udf(DoubleType())
def _double(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(np.int64).view(np.float64))


@F.pandas_udf(LongType())
def _as_bits(numbers: pd.Series) -> pd.Series:
    return pd.Series(_bits(numbers.to_numpy(float)))


def _limits(kept: DataFrame, size: int, base: float, risk: float, times: float) -> tuple[DataFrame, DataFrame]:
    """(s, scatter, cutoff) and (s, phase, season) of every series of `kept` (s, v, phase, rank), as flag_series has
    them, by aggregations alone."""
    kinds = "s long, phase int, dev double, r_bits long, before double, after double"
    m = cut(_segments(kept, size, HALO).mapInPandas(_measured(), kinds))
    sizes = cut(m.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.least(F.abs("dev"), F.lit(1e6))).alias("flat")))
    places = sizes.select("s", F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))).alias("n"))
    mid = nth(m, "s", "r_bits", places).withColumn("r", _double("r_bits")).groupBy("s").agg(((F.min("r") + F.max("r")) / 2 * 1.4826).alias("mid"))
    scatter = cut(sizes.join(mid, "s").select("s", F.when(F.col("mid") == 0, F.col("flat")).otherwise(F.col("mid")).alias("scatter")))
    m = m.join(small(scatter), "s")
    within = lambda c, times: F.greatest(-times * F.col("scatter"), F.least(times * F.col("scatter"), c))
    means = m.groupBy("s", "phase", "scatter").agg(F.avg(within(F.col("dev"), 3)).alias("mean"), F.count(F.lit(1)).alias("_n"))
    season = cut(means.select("s", "phase", F.when(F.col("_n") >= ENOUGH, within(F.col("mean"), SWING)).otherwise(0.0).alias("season")))
    number = lambda c: F.when(~F.isnan(c), F.abs(F.col(c) - F.col("season")))
    off = m.where("scatter > 0").join(small(season), ["s", "phase"]).withColumn("d", F.least(number("before"), number("after"))).where("d is not null")
    off = cut(off.select("s", "scatter", "d", (F.col("d") / F.col("scatter")).alias("off")).where(F.col("off") <= times - SWING).withColumn("d_bits", _as_bits("d")))
    good = cut(off.groupBy("s").agg(F.count(F.lit(1)).alias("counts")))
    at = nth(off, "s", "d_bits", good.select("s", F.floor(base * (F.col("counts") - 1)).cast("long").alias("n")))
    t = cut(at.join(scatter, "s").select("s", (_double("d_bits") / F.col("scatter")).alias("t")))
    excess = off.join(small(t), "s").where("off > t").withColumn("e", F.col("off") - F.col("t"))
    excess = excess.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.avg("e").alias("mean"), F.avg(F.col("e") * F.col("e")).alias("square"))
    every = scatter.join(good, "s", "left").join(t, "s", "left").join(excess, "s", "left").fillna(0)

    @F.pandas_udf(DoubleType())
    def cutoff(t: pd.Series, counts: pd.Series, m: pd.Series, mean: pd.Series, square: pd.Series) -> pd.Series:
        return pd.Series(tail_cutoff(*(c.to_numpy(float) for c in (t, counts, m, mean, square)), risk, times - SWING))

    return cut(every.select("s", "scatter", cutoff("t", "counts", "m", "mean", "square").alias("cutoff"))), season


def _segments(df: DataFrame, size: int, halo: int) -> DataFrame:
    return segmented(df, size, halo).repartition("s", "seg").sortWithinPartitions("s", "seg", "rank")


def _flag_long(r: DataFrame, runs: DataFrame, size: int, base: float, risk: float, times: float, stuck: int) -> DataFrame:
    """Flags, as numbers, of the readings of `runs` (_run, no), which need not fit into one task.

    Every field of a run is a series of its own, of distinct present readings, cut by exact place: once to find stuck
    and impossible values, and again without them for levels and episodes, so no cut loses a neighbour.
    """
    w = Window.partitionBy("no", "rid").orderBy("depth", F.desc_nulls_last("at"))
    one = r.join(small(runs), F.col("run_id").eqNullSafe(F.col("_run"))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    one = cut(one.select("no", "run_id", "log_id", "rid", "depth", "phase", *FIELDS))
    upto = lambda most: sum((F.coalesce(F.col(f).between(0, most).cast("long"), F.lit(0)) for f in FIELDS), F.lit(0))
    units = cut(one.groupBy("no").agg((F.sum(upto(1)) * 2 > F.sum(upto(100))).alias("fraction")))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(FIELDS)])).alias("c")
    cells = one.select("no", "rid", "depth", "phase", each).where("c.v is not null").join(small(units), "no")
    cells = cells.select((F.col("no") * len(FIELDS) + F.col("c.i")).alias("s"), "depth", "rid", "phase", "c.v", "fraction")
    lying = _segments(ranked(cells, "s", ["depth", "rid"]), size, max(stuck - 1, 0))
    odd = cut(lying.mapInPandas(_odd_ones(stuck), "s long, seg long, rid long, phase int, v double, flag byte, i long"))
    counts = odd.where("flag = 0").groupBy("s", "seg").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("s").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = odd.where("flag = 0").join(small(cut(counts.select("s", "seg", before.alias("before")))), ["s", "seg"])
    kept = cut(kept.select("s", "rid", "phase", "v", (F.col("i") + F.col("before")).alias("rank")))
    limits, season = _limits(kept, size, base, risk, times)
    lying = kept.join(small(limits), "s").join(small(season), ["s", "phase"])
    seen = _segments(lying, size, HALO).mapInPandas(_episodes(times), "s long, rid long, hit boolean, beyond boolean")
    seen = seen.select("s", "rid", F.when(F.col("hit"), 3).otherwise(0).cast("byte").alias("flag"), "beyond")
    found = odd.where("flag > 0").select("s", "rid", "flag", F.lit(False).alias("beyond")).unionByName(seen)
    of = lambda i, c: F.max(F.when(F.col("s") % len(FIELDS) == i, F.col(c))).alias(f"_{c}{i}")
    found = found.groupBy(F.expr(f"s div {len(FIELDS)}").alias("no"), "rid").agg(*[of(i, c) for i in range(len(FIELDS)) for c in ("flag", "beyond")])
    flag = lambda i, f: F.when(F.col(f).isNull(), -1).otherwise(F.coalesce(f"_flag{i}", F.lit(0))).cast("byte").alias("flag_" + f)
    tail = lambda i, f: F.coalesce(f"_beyond{i}", F.lit(False)).alias("tail_" + f)
    found = one.join(found, ["no", "rid"], "left")
    return found.select("log_id", "run_id", *FIELDS, *[g(i, f) for g in (flag, tail) for i, f in enumerate(FIELDS)])


def flag_spikes(
    readings: DataFrame, base: float = 0.9, risk: float = 1e-3, times: float = 10.0, stuck: int = 6, stretch: int = STRETCH, codes: tuple[float, ...] = CODES, period: float = PERIOD
) -> DataFrame:
    """log_id, run_id, the three porosities, `flag_<field>` and `tail_<field>` of every reading with a depth, a reading
    counting once.

    Flags: null where the value is missing, else 'none', 'impossible' (below 0, above 100, in runs that write
    fractions above 1), 'stuck' (member of `stuck` or more successive equal values) or 'spike' (member of one to three
    successive values, no more, that pass the tail's cutoff and lie more than `times` scatters from the level before and after).
    `tail_<field>` tells whether the value alone passes the tail's cutoff (null where it is missing; false for stuck
    and impossible ones): it marks what is unusual at this risk though it be no spike by the exact rule.
    Per run and field, in order of depth: residuals from the nearer of the levels before and after, less the seasonal
    part (the mean deviation in a tenth of each `period` metres of depth, two scatters at most); a Pareto tail over
    their `base` quantile gives the cutoff at `risk`, `times` less two at most, so that no spike is lost. Scatter is
    1.4826 times the median distance from the running median.
    - The level is that of the nearest seven values on a side that are neither stuck nor impossible; an episode at the
      end of a run, with no level on one side, is no spike.
    - Runs of more than `stretch` rows are looked at in stretches of that many readings, so no run has to fit into one
      task; unit, scatter and tail are those of the whole run and the result is the same.
    - Equal depths are ordered by log_id; a repeated log_id counts as received last; rows without log_id are told apart
      by their cells. Null run_id is a run of its own. Null or NaN depth takes no part. Empty tables give empty results.
    """
    v = {f: F.when(~is_missing(F.col(f), codes), F.col(f)) for f in FIELDS}
    r = readings.where(F.col("depth").isNotNull() & ~F.isnan("depth")).select(
        "log_id", "run_id", "depth", *[v[f].alias(f) for f in FIELDS],
        F.least(F.lit(PHASES - 1), F.floor(F.pmod("depth", F.lit(period)) / period * PHASES)).cast("int").alias("phase"),
        F.coalesce("log_id", F.xxhash64("depth", *FIELDS)).alias("rid"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"),
    )
    kinds = "log_id long, run_id long, " + ", ".join(f"{f} double" for f in FIELDS) + ", " + ", ".join(f"flag_{f} byte" for f in FIELDS) + ", " + ", ".join(f"tail_{f} boolean" for f in FIELDS)
    options = {"base": base, "risk": risk, "times": times, "stuck": stuck}
    long = r.groupBy(F.col("run_id").alias("_run")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stretch)
    long = cut(long.select("_run", (F.row_number().over(Window.orderBy("_run")) - 1).cast("long").alias("no")))
    any_long = not long.isEmpty()
    short = r.join(small(long), F.col("run_id").eqNullSafe(F.col("_run")), "left_anti") if any_long else r
    lying = short.repartition("run_id").sortWithinPartitions("run_id", "depth", "rid", F.desc_nulls_last("at"))
    flags = lying.select("log_id", "run_id", "rid", "phase", *FIELDS).mapInPandas(_flagger(options), kinds)
    if any_long:
        flags = flags.unionByName(_flag_long(r, long, stretch, **options))
    word = lambda c: F.element_at(F.array(F.lit("none"), F.lit("impossible"), F.lit("stuck"), F.lit("spike")), c.cast("int") + 1)
    return flags.select(
        "log_id", "run_id", *FIELDS, *[F.when(F.col(f"flag_{f}") >= 0, word(F.col(f"flag_{f}"))).alias(f"flag_{f}") for f in FIELDS],
        *[F.when(F.col(f"flag_{f}") >= 0, F.col(f"tail_{f}")).alias(f"tail_{f}") for f in FIELDS],
    )


def flagged_cells(flags: DataFrame) -> DataFrame:
    """log_id and field of every flagged value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"flag_{f}").alias("flag")) for f in FIELDS])
    cells = flags.select("log_id", F.explode(cells).alias("c")).where("c.flag <> 'none'")
    return cells.select("log_id", "c.field").distinct()
