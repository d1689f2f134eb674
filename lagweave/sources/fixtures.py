"""Synthetic panels with known relations, one task a seed.

Values follow Python's seeded Gaussian stream, so equal seeds give equal panels everywhere.
A process is described by its draws and a recurrence; each seed becomes a series.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seeds of the published panels.
BASE_SEEDS, DRIFT_SEEDS, LADDER_SEEDS = (11, 23, 37, 41, 53), (101, 103, 107, 109, 113), (211, 223, 227, 229, 233)
#: The effects of the ladder's sources on the next target.
LADDER = {
    "strong_1": 0.75, "strong_2": -0.65, "strong_3": 0.55,
    "medium_1": 0.48, "medium_2": -0.42, "medium_3": 0.36, "medium_4": -0.30,
    "weak_1": 0.25, "weak_2": -0.20, "weak_3": 0.15, "weak_4": -0.10,
    "noise_1": 0.0, "noise_2": 0.0, "noise_3": 0.0, "noise_4": 0.0,
}
#: The drifting coefficient rises between these steps from and to these values.
DRIFT_STEPS, DRIFT_VALUES = (420, 599), (0.15, 0.65)
#: The step at which a relation ends in the panels of ``relation_death``.
DEATH_STEP = 120

Rows = Iterator[dict[str, float]]


def drift_coefficient(step: int) -> float:
    """The first driver's effect at a step: constant, then linear."""
    if step < 0:
        raise ValueError("steps count from 0")
    (a, b), (low, high) = DRIFT_STEPS, DRIFT_VALUES
    if step < a:
        return low
    return high if step >= b else low + (high - low) * ((step - a) / (b - a))


# Fixed values in the recurrences below: coefficients, spreads and drifts of the published panels, and the order of their draws.


def _driven(seed: int, length: int, effect: Callable[[int], float]) -> Rows:
    draw = random.Random(seed).gauss
    a = b = b_before = y = 0.0
    for step in range(length):
        shocks = [draw(0.0, s) for s in (0.80, 0.80, 1.00, 0.50)]
        y = 0.55 * y + effect(step) * a - 0.25 * b_before + shocks[3]
        a, b, b_before = 0.65 * a + shocks[0], 0.55 * b + shocks[1], b
        yield {"target": y, "driver_a": a, "driver_b": b, "noise": shocks[2]}


def _ladder(seed: int, length: int) -> Rows:
    draw = random.Random(seed).gauss
    now, y = dict.fromkeys(LADDER, 0.0), 0.0
    for _ in range(length):
        past = now
        now = {s: (0.20 + 0.03 * (i % 4)) * past[s] + draw(0.0, 1.0) for i, s in enumerate(LADDER)}
        y = 0.30 * y
        for s, e in LADDER.items():
            if e:
                y += e * past[s]
        y += draw(0.0, 0.45)
        yield {"target": y, **now}


def _walks(seed: int, length: int) -> Rows:
    draw, x, y = random.Random(seed).gauss, 0.0, 0.0
    for _ in range(length):
        x += draw(0.0, 1.0)
        y += draw(0.0, 1.0)
        yield {"x": x, "y": y}


def _trended(seed: int, length: int, effect: float, noise: float, until: int, drift: tuple[float, float]) -> Rows:
    """Levels whose changes relate at lag 3 up to a step."""
    draw, x, y, past = random.Random(seed).gauss, 50.0, 100.0, []
    for step in range(length):
        dx = draw(0.0, 1.0)
        shock = draw(0.0, noise)
        dy = effect * past[step - 3] + shock if 3 <= step < until else shock
        x += drift[0] + dx
        y += drift[1] + dy
        past.append(dx)
        yield {"x": x, "y": y}


KINDS: dict[str, Callable[[int], Rows]] = {
    "base": lambda seed: _driven(seed, 600, lambda step: 0.35),
    "drift": lambda seed: _driven(seed, 600, drift_coefficient),
    "ladder": lambda seed: _ladder(seed, 600),
    "random_walks": lambda seed: _walks(seed, 216),
    "trended_lag3": lambda seed: _trended(10_000 + seed, 216, 0.6, 0.8, 216, (0.30, 0.20)),
    "relation_death": lambda seed: _trended(20_000 + seed, 180, 0.9, 0.45, DEATH_STEP, (0.25, 0.15)),
}


def synthetic_panel(spark: SparkSession, kind: str, seeds: tuple[int, ...]) -> DataFrame:
    """(series_id, t, signal, value) of a kind for each seed; series_id is the seed, t counts from 0."""
    make = KINDS[kind]

    def one(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        rows = [(str(key[0]), t, s, v) for t, row in enumerate(make(int(key[0]))) for s, v in row.items()]
        return pd.DataFrame(rows, columns=["series_id", "t", "signal", "value"])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(one, "series_id string, t long, signal string, value double")


def drift_truth(spark: SparkSession, length: int = 600) -> DataFrame:
    """(t, coefficient) of the first driver in the drift panels."""
    (a, b), (low, high) = DRIFT_STEPS, DRIFT_VALUES
    t = F.col("id")
    value = F.when(t < a, low).when(t >= b, high).otherwise(low + (high - low) * ((t - a) / (b - a)))
    return spark.range(length).select(t.alias("t"), value.alias("coefficient"))


def ladder_tier(source: str) -> str:
    if source not in LADDER:
        raise ValueError(f"unknown source {source!r}")
    return source.partition("_")[0]


def mixed_relations(spark: SparkSession, seeds: tuple[int, ...]) -> DataFrame:
    """Relation rows with known truth: three true ones, some pseudo and some dead ones for each seed."""

    def draw(seed: int) -> Iterator[tuple]:
        rng = random.Random(30_000 + seed)
        # fixed values: name, how many, samples, score from, spread of it, stability, uncertainty, and the weight's sign
        groups = (
            ("true", lambda: 3, (96, 144), 0.50, (-0.08, 0.10), (0.50, -0.04, 0.12), (0.04, 0.0, 0.09), lambda i: 1),
            ("pseudo", lambda: rng.randint(4, 7), (90, 150), 0.10, (0.0, 0.26), (0.04, 0.0, 0.28), (0.13, 0.0, 0.14), lambda i: 1 - 2 * (i % 2)),
            ("dead", lambda: rng.randint(2, 4), (96, 144), 0.44, (-0.08, 0.13), (0.06, 0.0, 0.22), (0.20, 0.0, 0.13), lambda i: -1),
        )
        for name, count, samples, base, spread, stable, unsure, sign in groups:
            for i in range(count()):
                n = rng.randint(*samples)
                score = base + rng.uniform(*spread)
                source = f"true_{'abc'[i]}" if name == "true" else f"{name}_{i}"
                yield str(seed), source, "target", 1 + i % 3, sign(i) * score, score, n, "diff", stable[0] + rng.uniform(*stable[1:]), unsure[0] + rng.uniform(*unsure[1:])

    columns = "series_id string, source string, target string, lag int, weight double, score double, sample_count long, transform string, stability double, uncertainty double"

    def one(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(draw(int(key[0])), columns=[c.split()[0] for c in columns.split(", ")])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(one, columns)
