"""Problem 7: implausible spikes in measurements.

Per source and channel, in the order of time: readings outside the physical limits are `limit`; runs of at least
stuck_len successive readings with one and the same value are `stuck`; the rest is judged by a robust autoregression.
The series is taken relative to a running median level, one autoregression per source and channel is fitted to the
residuals, cut at 2.5 local deviations, and innovations beyond `threshold` local robust deviations are tested in rounds: an
additive outlier (the series comes back within max_spike readings) is flagged as `spike` and replaced by its level, a level
shift (the readings after it stay on the new level) is genuine and kept. Rounds look again at the surroundings of what the
last one flagged, until nothing new is found.

Defined results
* Rows without source or time (NULL or NaN) and NULL or NaN values are not judged.
* Rows of one source and time are re-sent copies of one reading if their values are equal; copies are judged once and
  flagged together. Different values at one time count as successive readings.
* Series shorter than four readings have no surroundings: only limits apply.
* A cell has one flag: limit before stuck before spike.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.positions import with_position
from pulsegrid.session import materialize, real


@dataclass(frozen=True)
class Channel:
    """Physical limits (inclusive bounds of what a living person can show) and the least scale of normal noise."""

    low: float
    high: float
    floor: float


#: Limits in beats/min, mmHg, breaths/min and degrees Celsius.
VITALS = {
    "HR": Channel(10.0, 350.0, 1.3),
    "SBP": Channel(20.0, 320.0, 2.0),
    "RR": Channel(1.0, 120.0, 0.5),
    "Temp": Channel(20.0, 46.0, 0.06),
}


LEVEL_HALF, SCALE_HALF, GRID, ORDER = 7, 20, 4, 2


def _medians(padded: np.ndarray, half: int, at: np.ndarray) -> np.ndarray:
    """Medians of the up to 2 half + 1 values around the places `at` of a series padded by half NaNs on both sides."""
    n = len(padded) - 2 * half
    rows = padded[at[:, None] + np.arange(2 * half + 1)]
    rows.sort(axis=1)  # NaN last
    count = np.minimum(at + half, n - 1) - np.maximum(at - half, 0) + 1
    r = np.arange(len(at))
    return (rows[r, (count - 1) // 2] + rows[r, count // 2]) / 2


class Innovations:
    """One series with its running level, the innovations of an autoregression around it, and their local deviation.

    All three depend on near values only, so after a change they are renewed around it and nowhere else; and since the grid of
    the deviation goes by the readings' own positions, they are the same in a part of the series as in the whole."""

    def __init__(self, v: np.ndarray, position: np.ndarray | None = None):
        n = self.n = len(v)
        self.v = v.astype(float)
        self._y, self._a = np.full(n + 2 * LEVEL_HALF, np.nan), np.full(n + 2 * SCALE_HALF, np.nan)
        self.y = self._y[LEVEL_HALF : LEVEL_HALF + n]
        self.y[:] = self.v
        self.level, self.e, self.local = np.zeros(n), np.zeros(n), np.zeros(n)
        self.flagged = np.zeros(n, bool)
        grid = np.flatnonzero((np.arange(n) if position is None else position) % GRID == 0)
        self.grid = np.concatenate([[0] * (n > 0 and not (len(grid) and grid[0] == 0)), grid, [n - 1] * (n > 0 and not (len(grid) and grid[-1] == n - 1))]).astype(int)
        self.coef = np.zeros(ORDER)
        self._levels(0, n)

    def _levels(self, a: int, b: int) -> None:
        self.level[a:b] = _medians(self._y, LEVEL_HALF, np.arange(a, b))

    def _locals(self, a: int, b: int) -> None:
        """Running medians of |e|, interpolated between the places of the grid."""
        i, j = max(np.searchsorted(self.grid, a, "right") - 1, 0), np.searchsorted(self.grid, b - 1) + 1
        at = self.grid[i:j]
        self.local[a:b] = np.interp(np.arange(a, b), at, _medians(self._a, SCALE_HALF, at))

    def renew(self, a: int, b: int) -> None:
        """Bring [a, b) up to date with y and flagged."""
        self._levels(a, b)
        r0 = max(a - ORDER, 0)
        r = self.y[r0:b] - self.level[r0:b]
        e = self.v[a:b] - self.level[a:b]
        for k, c in enumerate(self.coef, 1):
            lag = np.zeros(b - a)
            first = max(a, k)
            lag[first - a :] = r[first - k - r0 : b - k - r0]
            e -= c * lag
        e[self.flagged[a:b]] = 0.0
        self.e[a:b] = e
        self._a[SCALE_HALF + a : SCALE_HALF + b] = np.abs(e)
        self._locals(a, b)

    def moments(self, mine: np.ndarray | None = None) -> np.ndarray:
        """Additive statistics of the residuals around the level: lagged products, sum of log deviations, and their number.

        Residuals are cut at 2.5 local deviations, so that outliers weigh no more than the series' own noise. mine: the places
        that count (those of a part whose surroundings belong to other parts)."""
        mine = np.ones(self.n, bool) if mine is None else mine
        r = self.y - self.level
        self._a[SCALE_HALF : SCALE_HALF + self.n] = np.abs(r)
        self._locals(0, self.n)
        cut = 2.5 * np.maximum(1.4826 * self.local, 1e-9)
        r = np.clip(r, -cut, cut)
        lags = [np.concatenate([np.zeros(min(k, self.n)), r[: max(self.n - k, 0)]]) for k in range(ORDER + 1)]
        full = mine & (np.arange(self.n) >= ORDER)
        products = [float((lags[i][full] * lags[j][full]).sum()) for i in range(ORDER + 1) for j in range(i, ORDER + 1)]
        return np.array([*products, float(np.log(np.maximum(self.local[mine], 1e-3)).sum()), float(mine.sum())])

    def fit(self, moments: np.ndarray) -> None:
        self.coef, self.spread = solve(moments)
        self.renew(0, self.n)


def solve(moments: np.ndarray) -> tuple[np.ndarray, float]:
    """(autoregression coefficients, typical absolute deviation) from summed moments(), shrunk towards no autoregression where
    there are few readings."""
    c = np.zeros((ORDER + 1, ORDER + 1))
    c[np.triu_indices(ORDER + 1)] = moments[: -2]
    c = c + np.triu(c, 1).T
    n = moments[-1]
    lagged = c[1:, 1:] + np.eye(ORDER) * (1e-9 + 20 * c[0, 0] / max(n, 1))
    coef = np.linalg.solve(lagged, c[1:, 0]) if n else np.zeros(ORDER)
    return np.clip(coef, -0.95, 0.95), float(np.exp(moments[-2] / n)) if n else 0.0


def fit_ar(r: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Robust autoregression coefficients of a series without a level of its own: values are cut at 2.5 deviations."""
    cut = 2.5 * 1.4826 * max(np.median(np.abs(r)), 1e-9)
    r = np.clip(r, -cut, cut)
    x = np.column_stack([r[order - k - 1 : len(r) - k - 1] for k in range(order)])
    return np.linalg.solve(x.T @ x + 1e-9 * np.eye(order), x.T @ r[order:])


def find_spikes(v: np.ndarray, floor: float, threshold: float = 6.0, max_spike: int = 3, position: np.ndarray | None = None, moments: np.ndarray | None = None) -> np.ndarray:
    """Boolean mask of the additive outliers of one series of readings in the order of time.

    moments: those of the whole series, where v is a part of it; position: the readings' positions in the whole."""
    n = len(v)
    if n < 4:
        return np.zeros(n, bool)
    s = Innovations(v, position)
    s.fit(s.moments() if moments is None else moments)
    v, y, level, flagged = s.v, s.y, s.level, s.flagged
    reach = 2 * SCALE_HALF
    dirty = [(0, n)]
    while dirty:
        new = []
        for lo, hi in dirty:
            sigma = np.maximum(1.4826 * np.maximum(s.local[lo:hi], 0.5 * s.spread), floor)
            for i in (lo + np.flatnonzero((np.abs(s.e[lo:hi]) > threshold * sigma) & ~flagged[lo:hi])).tolist():
                cut = threshold * sigma[i - lo]
                # the stretch around i that lies off its level on the same side
                off_level = v[i] - level[i]
                side, near = np.sign(off_level), 0.5 * abs(off_level)
                a = z = i
                while a > 0 and i - a < max_spike + 1 and abs(v[a - 1] - v[i]) < near and not flagged[a - 1]:
                    a -= 1
                while z < n - 1 and z - i < max_spike + 1 and abs(v[z + 1] - v[i]) < near and not flagged[z + 1]:
                    z += 1
                if z - a + 1 > max_spike:
                    continue  # it stays: a level shift
                sides = [x for x in (_side(y, flagged, a, -1), _side(y, flagged, z, 1)) if x is not None]
                if not sides:
                    continue
                off = [v[i] - level_ for level_, _ in sides]
                restless = np.sort(np.concatenate([d for _, d in sides]))[::-1]
                restless = restless[min(1, len(restless) - 1)]
                least = max(0.75 * cut * (1 if len(sides) == 2 else 2), 2.5 * restless, 0.45 * max(map(abs, off)))
                if all(abs(x) > least and np.sign(x) == side for x in off):
                    new.append((a, z))
        dirty = []
        for a, z in new:
            flagged[a : z + 1] = True
            around = [x[0] for x in (_side(y, flagged, a, -1), _side(y, flagged, z, 1)) if x is not None]
            y[a : z + 1] = np.mean(around) if around else level[a]
            lo, hi = max(0, a - reach), min(n, z + 1 + reach)
            if dirty and dirty[-1][0] <= lo <= dirty[-1][1]:
                dirty[-1] = (dirty[-1][0], max(hi, dirty[-1][1]))
            else:
                dirty.append((lo, hi))
        for lo, hi in dirty:
            s.renew(lo, hi)
    return flagged


def _side(y: np.ndarray, flagged: np.ndarray, i: int, way: int, k: int = 5) -> tuple[float, np.ndarray] | None:
    """Median of the k nearest unflagged readings before (-1) or after (1) i, and their distances from it."""
    a, b = (max(0, i - 3 * k), i) if way < 0 else (i + 1, i + 1 + 3 * k)
    near = y[a:b][~flagged[a:b]][::way][:k]
    if not len(near):
        return None
    ordered, m = np.sort(near), len(near)
    level = float((ordered[(m - 1) // 2] + ordered[m // 2]) / 2)
    return level, np.abs(near - level)


def sort_out(v: np.ndarray, channel: Channel, stuck_len: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(flags '', 'limit' or 'stuck', places of the readings that an autoregression may judge) of one series."""
    out = np.full(len(v), "", object)
    edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a >= stuck_len:
            out[a:b] = "stuck"
    possible = (v >= channel.low) & (v <= channel.high)
    out[~possible] = "limit"
    return out, np.flatnonzero(possible & (out != "stuck"))


def judge_series(v: np.ndarray, channel: Channel, stuck_len: int = 9, position: np.ndarray | None = None, moments: np.ndarray | None = None) -> np.ndarray:
    """Flags ('', 'limit', 'stuck', 'spike') of one series in the order of time."""
    out, base = sort_out(v, channel, stuck_len)
    if len(base) >= 4:
        out[base[find_spikes(v[base], channel.floor, position=None if position is None else position[base], moments=moments)]] = "spike"
    return out


#: How many numbers Innovations.moments() has.
MOMENTS = (ORDER + 1) * (ORDER + 2) // 2 + 2


def flag_measurements(
    df: DataFrame,
    row_id: str,
    source: str,
    time: str,
    channels: Mapping[str, Channel] = VITALS,
    stuck_len: int = 9,
    chunk: int = 4096,
    halo: int = 256,
    bucket_seconds: float = 21600.0,
) -> DataFrame:
    """(row_id, channel, flag) of each implausible cell.

    Each (source, channel) is cut into chunks of `chunk` readings with `halo` readings of context on both sides, by exact
    positions (see positions.py): a source with a third of all rows becomes many tasks of bounded size, and runs across
    borders are seen whole because the halo is longer than stuck_len. The autoregression and the typical deviation are those of
    the whole series: for a series of one chunk they come from it, for longer ones from moments that its chunks sum up
    first, which then head every chunk of the series."""
    names = list(channels)
    keys = ["__s", "__ch", "__chunk"]
    columns = [*keys, "__pos", "__own", "__id", "__t", "__v"]
    rows = df.where(F.col(source).isNotNull() & real(F.col(time).cast("double")).isNotNull())

    def chunks(part: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("__ch"), real(F.col(x).cast("double")).alias("__v")) for i, x in enumerate(names)])
        long = part.select(F.col(row_id).alias("__id"), F.col(source).alias("__s"), F.col(time).cast("double").alias("__t"), F.inline(pairs)).where("__v is not null")
        placed = with_position(long, ["__s", "__ch"], F.floor(F.col("__t") / bucket_seconds), [F.col("__t"), F.col("__v"), F.col("__id")], "__pos")
        own = F.floor(F.col("__pos") / chunk)
        within = F.col("__pos") - own * chunk
        homes = F.array_compact(F.array(own, F.when((within < halo) & (own > 0), own - 1), F.when(within >= chunk - halo, own + 1)))
        return placed.withColumn("__own", own).withColumn("__chunk", F.explode(homes)).select(*columns)

    def in_order(part: DataFrame) -> DataFrame:
        # chunks lie one after the other in sorted partitions: many small series share a batch, and a chunk that a batch cuts
        # is carried into the next one
        return part.repartition(*keys).sortWithinPartitions(*keys, "__pos")

    counts = [F.count(real(F.col(x).cast("double"))) for x in names]
    long_sources = rows.groupBy(F.col(source).alias("__long")).agg(F.greatest(*counts, F.lit(0)).alias("__n")).where(F.col("__n") > chunk).select("__long")
    long_sources = materialize(long_sources, "long")
    n_long = long_sources.count()
    few = F.broadcast(long_sources) if n_long <= 100_000 else long_sources
    parts = in_order(chunks(rows.join(few, F.col(source) == F.col("__long"), "left_semi")))
    kinds = dict(parts.dtypes)

    def series(pdf: pd.DataFrame):
        """(start, end, moments or None) of each complete chunk."""
        pos = pdf["__pos"].to_numpy()
        edge = np.append(_starts(pdf, keys), len(pdf))
        v = pdf["__v"].to_numpy()
        for a, b in zip(edge[:-1], edge[1:]):
            headed = pos[a] < 0
            if headed and a + MOMENTS == b:
                continue
            yield (a + MOMENTS, b, v[a : a + MOMENTS]) if headed else (a, b, None)

    def whole_chunks(run):
        def over(batches):
            rest = None
            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                if not len(pdf):
                    continue
                last = _starts(pdf, keys)[-1]
                done, rest = pdf.iloc[:last], pdf.iloc[last:]
                if len(done):
                    yield run(done)
            if rest is not None and len(rest):
                yield run(rest)

        return over

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        t, v, ch, pos = (pdf[c].to_numpy() for c in ("__t", "__v", "__ch", "__pos"))
        mine = (pdf["__own"] == pdf["__chunk"]).to_numpy()
        out = []
        for a, b, _ in series(pdf):
            first = a + np.flatnonzero(_news(t[a:b], v[a:b]))
            base = first[sort_out(v[first], channels[names[ch[a]]], stuck_len)[1]]
            if len(base):
                at = Innovations(v[base], pos[base])
                out.append((pdf["__s"].iloc[a], ch[a], pdf["__id"].iloc[a], int(mine[a:b].sum()), *at.moments(mine[base]).tolist()))
        return pd.DataFrame(out, columns=["__s", "__ch", "__id", "__n", *[f"m{i}" for i in range(MOMENTS)]])

    sums = parts.mapInPandas(whole_chunks(measure), f"__s {kinds['__s']}, __ch int, __id {kinds['__id']}, __n bigint, " + ", ".join(f"m{i} double" for i in range(MOMENTS)))
    heads = sums.groupBy("__s", "__ch").agg(F.min("__id").alias("__id"), F.sum("__n").alias("__n"), F.array(*[F.sum(f"m{i}") for i in range(MOMENTS)]).alias("m")).where(F.col("__n") > chunk)
    heads = heads.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / chunk) - 1)))
    heads = heads.select(*keys, F.posexplode("m").alias("__i", "__v"), "__id")
    heads = heads.select(*keys, (F.col("__i") - MOMENTS).cast("bigint").alias("__pos"), F.lit(-1).cast("bigint").alias("__own"), "__id", F.lit(0.0).alias("__t"), "__v")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The flagged cells that the chunks own."""
        t, v, ch, pos = (pdf[c].to_numpy() for c in ("__t", "__v", "__ch", "__pos"))
        mine = (pdf["__own"] == pdf["__chunk"]).to_numpy()
        places, marks = [np.zeros(0, int)], [np.zeros(0, object)]
        for a, b, moments in series(pdf):
            first = _news(t[a:b], v[a:b])
            flags = judge_series(v[a:b][first], channels[names[ch[a]]], stuck_len, pos[a:b][first], moments)[np.cumsum(first) - 1]
            hit = np.flatnonzero((flags != "") & mine[a:b])
            places.append(hit + a)
            marks.append(flags[hit])
        at = np.concatenate(places)
        return pd.DataFrame({row_id: pdf["__id"].to_numpy()[at], "channel": np.array(names, object)[ch[at]], "flag": np.concatenate(marks)})

    cut = chunks(rows)
    return in_order(cut.unionByName(heads) if n_long else cut).mapInPandas(whole_chunks(judge), f"`{row_id}` {dict(df.dtypes)[row_id]}, channel string, flag string")


def _news(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which readings are no re-sent copies of the one before."""
    out = np.ones(len(t), bool)
    out[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return out


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new combination of the keys starts."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        x = pdf[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
