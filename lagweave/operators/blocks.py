"""Lagged moments of all pairs of signals, from blocks of steps.

Steps of a series are dealt to blocks together with the steps just before them, so a block
holds both ends of every lagged pair that ends in it. A block is a matrix of steps by signals;
its lagged cross-products are matrix products, and its windows are differences of running
sums. What is shuffled is the panel, not a row for every pair of signals, lag and step, and a
long series is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps in a block, at least.
STEPS = 512

EDGE = ["series_id", "source", "target"]
#: A pair whose centred variance is so small a share of its raw one is looked at value by value.
_DOUBTFUL = 1e-9
#: Share of all earlier steps' moments below which differences of running sums lose digits.
_QUIET = 1e-6


def dealt(panel: DataFrame, length: int, before: int) -> DataFrame:
    """Rows with a value, once for each block of ``length`` steps that holds them or follows them within ``before`` steps."""
    first, last = F.floor(F.col("t") / length), F.floor((F.col("t") + before) / length)
    return panel.where("value is not null").withColumn("block", F.explode(F.sequence(first, last)))


class Block:
    """Steps by signals: values (0 where there is none), and which there are."""

    def __init__(self, table: pa.Table, length: int, before: int):
        self.length, self.before = length, before
        block = table["block"][0].as_py()
        self.start = block * length - before  # the step of the first row
        names = table["signal"].combine_chunks().dictionary_encode()
        order = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.names = [names.dictionary[int(i)].as_py() for i in order]
        row, column = table["t"].to_numpy() - self.start, place[names.indices.to_numpy()]
        shape = (length + before, len(self.names))
        if len(np.unique(row * shape[1] + column)) < len(row):
            raise ValueError("a signal has two values for one step")
        self.mask, self.values = np.zeros(shape, bool), np.zeros(shape)
        self.mask[row, column], self.values[row, column] = True, table["value"].to_numpy()
        self.column = column

    def per_signal(self, values: np.ndarray) -> np.ndarray:
        """One entry for each signal of what is the same on all its rows."""
        out = np.zeros(len(self.names), values.dtype)
        out[self.column] = values
        return out


def grouped(rows: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("series_id", "block").applyInArrow(function, schema)


MOMENTS = "series_id string, source string, target string, lag int, n long, sx double, sy double, sxx double, syy double, sxy double, x_least double, x_most double, y_least double, y_most double"


def lagged_moments(panel: DataFrame, max_lag: int, target: str | None = None) -> DataFrame:
    """A row for each edge, lag and block (``MOMENTS``): sums about the signals' means, and whether either side is constant.

    The bounds of a side are those of its values where it may be constant, else infinite.
    """
    if max_lag < 1:
        raise ValueError("max_lag must be positive")
    length, before = max(STEPS, 2 * max_lag), max_lag
    known = panel.where("value is not null").select("series_id", "t", "signal", F.col("value").cast("double").alias("value"))
    centre = known.groupBy("series_id", "signal").agg(F.avg("value").alias("centre"))
    rows = dealt(known.join(centre, ["series_id", "signal"]), length, before)

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, length, before)
        shift = b.per_signal(table["centre"].to_numpy())
        x = np.where(b.mask, b.values - shift, 0.0)
        own = np.array([i for i, name in enumerate(b.names) if target is None or name == target], np.int64)
        series, parts = table["series_id"][0].as_py(), []
        y, ym = x[before:, own], b.mask[before:, own].astype(float)
        for lag in range(1, max_lag + 1) if len(own) else ():
            past, pm = x[before - lag : len(x) - lag], b.mask[before - lag : len(x) - lag].astype(float)
            n = pm.T @ ym
            sums = past.T @ ym, pm.T @ y, (past * past).T @ ym, pm.T @ (y * y), past.T @ y
            s, g = np.nonzero(n)
            s, g = s[s != own[g]], g[s != own[g]]
            if not len(s):
                continue
            n, (sx, sy, sxx, syy, sxy) = n[s, g], (m[s, g] for m in sums)
            ends = np.full((4, len(s)), np.inf)
            ends[[0, 2]] = -np.inf
            for i in np.flatnonzero((sxx - sx * sx / n <= _DOUBTFUL * sxx) | (syy - sy * sy / n <= _DOUBTFUL * syy)):
                both = b.mask[before - lag : len(x) - lag, s[i]] & b.mask[before:, own[g[i]]]
                for k, v in enumerate((b.values[before - lag : len(x) - lag, s[i]], b.values[before:, own[g[i]]])):
                    ends[2 * k : 2 * k + 2, i] = v[both].min(), v[both].max()
            names = pa.array(b.names)
            parts.append(pa.table([pa.array([series] * len(s)), names.take(pa.array(s)), names.take(pa.array(own[g])), pa.array(np.full(len(s), lag, np.int32)), pa.array(n.astype(np.int64)), *(pa.array(v) for v in (sx, sy, sxx, syy, sxy, *ends))], names=[f.split()[0] for f in MOMENTS.split(", ")]))
        return pa.concat_tables(parts) if parts else _none(MOMENTS)

    return grouped(rows.select("series_id", "block", "t", "signal", "value", "centre"), run, MOMENTS)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _none(schema: str) -> pa.Table:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))]).empty_table()


def running(x: np.ndarray) -> np.ndarray:
    """0 and the sums of the first rows, in extended precision, so that differences of far sums stay good."""
    return np.concatenate([np.zeros((1, *x.shape[1:]), np.longdouble), np.cumsum(x, 0, dtype=np.longdouble)])


def changes(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first rows' values differ from the value before them (n + 1), and the first row with a value from each row on."""
    at = np.arange(len(x))[:, None]
    last = np.maximum.accumulate(np.where(mask, at, -1), 0)
    before = np.concatenate([np.full((1, x.shape[1]), -1), last[:-1]])
    differs = mask & (before >= 0) & (np.take_along_axis(x, np.maximum(before, 0), 0) != x)
    count = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(differs, 0)])
    return count, np.minimum.accumulate(np.where(mask, at, len(x))[::-1], 0)[::-1]


ROLLED = "series_id string, source string, target string, lag int, step long, weight double, sample_count long"


def window_correlations(panel: DataFrame, max_lag: int, window: int, target: str | None, differenced: bool | frozenset[str], shortened: bool, best: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Correlations in the ``window`` steps before each step of a series and the one past its end (``ROLLED``).

    differenced: the signals whose first value in a window isn't known. shortened: whether
    windows may begin with the series. best: from |correlation| by (lag, step, source), NaN
    where there is none, the index of the lag to keep; all lags are kept without it.
    """
    length, before = max(STEPS, 2 * window), window
    known = panel.where("value is not null").select("series_id", "t", "signal", F.col("value").cast("double").alias("value"))
    ends = known.groupBy("series_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    rows = dealt(known.join(ends, "series_id"), length, before)

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, length, before)
        first, last = table["first_t"][0].as_py(), table["last_t"][0].as_py()
        at = np.arange(before, before + length)  # rows of steps
        step = at + b.start
        wanted = (b.mask[before:].any(1) & (step <= last)) | (step == last + 1)
        wanted &= (step - first > max_lag) if shortened else (step - first >= window)
        at, step = at[wanted], step[wanted]
        parts = list(_windows(b, at, max(0, first - b.start), max_lag, window, target, differenced, best)) if len(at) else []
        if not parts:
            return _none(ROLLED)
        source, goal, lag, place, weight, count = (np.concatenate(x) for x in zip(*parts))
        names = pa.array(b.names)
        columns = [pa.array([table["series_id"][0].as_py()] * len(source)), names.take(pa.array(source)), names.take(pa.array(goal)), pa.array(lag.astype(np.int32)), pa.array(step[place]), pa.array(weight), pa.array(count)]
        return pa.table(columns, names=[f.split()[0] for f in ROLLED.split(", ")])

    return grouped(rows.select("series_id", "block", "t", "signal", "value", "first_t", "last_t"), run, ROLLED)


def _direct(x: np.ndarray, y: np.ndarray) -> float:
    """The correlation of two short vectors in two passes."""
    x, y = x - x[0], y - y[0]
    x, y = x - x.mean(), y - y.mean()
    length = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / length) if length > 0 else 0.0


def _windows(b: Block, at: np.ndarray, first: int, max_lag: int, window: int, target: str | None, differenced: bool | frozenset[str], best: Callable | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(source, target, lag, place in ``at``, weight, pairs) of one target at a time."""
    # about each signal's first value: a mean would let later steps touch the last digits of earlier windows
    x = np.where(b.mask, b.values - b.values[b.mask.argmax(0), np.arange(len(b.names))], 0.0)
    shift = np.array([differenced if isinstance(differenced, bool) else name in differenced for name in b.names], np.int64)
    sources = np.arange(len(b.names))
    for goal in [i for i, name in enumerate(b.names) if target is None or name == target]:
        weights, counts = np.full((max_lag, len(at), len(sources)), np.nan), np.zeros((max_lag, len(at), len(sources)), np.int64)
        for lag in range(1, max_lag + 1):
            # row r of these is the pair that ends at row r + lag
            both = b.mask[:-lag] & b.mask[lag:, goal, None]
            past, now = np.where(both, x[:-lag], 0), np.where(both, x[lag:, goal, None], 0)
            sums = [running(v) for v in (both.astype(np.int64), past, now, past * past, now * now, past * now)]
            # pairs of a window: the source's row from the window's first row on, the target's row before the step
            low = np.maximum(np.maximum(at - window, first)[:, None] + shift, 0)
            high = np.broadcast_to(np.maximum(at - lag, 0)[:, None], low.shape)
            low = np.minimum(low, high)
            n, sx, sy, sxx, syy, sxy = (s[high, sources] - s[low, sources] for s in sums)
            n = n.astype(np.int64)
            some = np.maximum(n, 1)
            vx, vy, cov = sxx - sx * sx / some, syy - sy * sy / some, sxy - sx * sy / some
            still = np.zeros(n.shape, bool)
            for v in (b.values[:-lag], np.broadcast_to(b.values[lag:, goal, None], both.shape)):
                count, following = changes(v, both)
                begin = np.minimum(np.concatenate([following, np.full((1, len(sources)), len(both))])[low, sources] + 1, len(both))
                still |= count[high, sources] - count[np.minimum(begin, high), sources] == 0
            flat = still | (vx <= 0) | (vy <= 0)
            r = np.where(flat, 0.0, cov / np.sqrt(np.where(flat, 1, vx) * np.where(flat, 1, vy))).astype(float)
            # where a window is far quieter than what came before it, its own values are read again
            quiet = (vx <= _QUIET * sums[3][high, sources]) | (vy <= _QUIET * sums[4][high, sources])
            for k, i in zip(*np.nonzero(quiet & ~still & (n > 1))):
                rows = np.flatnonzero(both[low[k, i] : high[k, i], i]) + low[k, i]
                r[k, i] = _direct(b.values[rows, i], b.values[rows + lag, goal])
            weights[lag - 1], counts[lag - 1] = np.where(n > 0, np.clip(r, -1, 1), np.nan), n
        weights[:, :, goal] = np.nan
        if best is not None:
            chosen = best(np.abs(weights))[None]
            keep = np.zeros(weights.shape, bool)
            np.put_along_axis(keep, chosen, True, 0)
            weights[~keep] = np.nan
        lag, place, source = np.nonzero(~np.isnan(weights))
        yield source, np.full(len(source), goal), lag + 1, place, weights[lag, place, source], counts[lag, place, source]
