"""Which relations a model may use: budget thresholds, trust gates, and the evidence gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from .positions import cumulative
from .relations import ranked

#: Score limits of the whole and of the empty budget, the tiers, and bytes of a value.
BUDGET_FLOOR, BUDGET_CEILING = 0.06, 0.50
TIERS = (1.00, 0.75, 0.50, 0.25, 0.00)
VALUE_BYTES = 8
#: Trust below which nothing and above which everything is admitted.
TRUST_LOW, TRUST_HIGH = 0.15, 0.50


@dataclass(frozen=True)
class BudgetRule:
    """Score limits of the whole and of the empty budget, and bytes of a value."""

    floor: float = BUDGET_FLOOR
    ceiling: float = BUDGET_CEILING
    value_bytes: int = VALUE_BYTES

    def __post_init__(self) -> None:
        if not 0 <= self.floor < self.ceiling <= 1:
            raise ValueError("limits must rise inside [0, 1]")
        if self.value_bytes <= 0:
            raise ValueError("value_bytes must be positive")


@dataclass(frozen=True)
class TrustRule:
    """Trust below which nothing and above which everything is admitted."""

    low: float = TRUST_LOW
    high: float = TRUST_HIGH

    def __post_init__(self) -> None:
        if not 0 <= self.low < self.high <= 1:
            raise ValueError("limits must rise inside [0, 1]")


def budget_threshold(budget: Column, rule: BudgetRule = BudgetRule()) -> Column:
    return rule.floor + (1 - budget) * (rule.ceiling - rule.floor)


def tiers(spark: SparkSession, budgets: tuple[float, ...] = TIERS, rule: BudgetRule = BudgetRule()) -> DataFrame:
    if not all(0 <= b <= 1 for b in budgets):
        raise ValueError("budgets must be inside [0, 1]")
    return spark.createDataFrame([(b,) for b in budgets], "budget double").withColumn("threshold", budget_threshold(F.col("budget"), rule))


def retain(relations: DataFrame, budgets: DataFrame) -> DataFrame:
    """Relations above each tier's threshold (a tier is a row of a few), with their rank in the tier."""
    kept = relations.crossJoin(F.broadcast(budgets)).where("score > threshold")
    return ranked(kept, ("series_id", "target", "budget"))


def resource_profile(relations: DataFrame, budgets: DataFrame, lags: int, rows: DataFrame, cap: int | None = None, rule: BudgetRule = BudgetRule()) -> DataFrame:
    """Per target and tier: relations kept, and what a model with them computes and holds.

    rows: (series_id, rows) that a model sees. Tiers that keep nothing are reported with 0.
    """
    kept = retain(relations, budgets)
    counts = kept.groupBy("series_id", "target", "budget").agg(F.count(F.lit(1)).alias("n"))
    every = relations.select("series_id", "target").distinct().crossJoin(F.broadcast(budgets))
    table = every.join(counts, ["series_id", "target", "budget"], "left").join(rows, "series_id")
    n = F.coalesce("n", F.lit(0))
    table = table.withColumn("retained", (F.least(n, F.lit(cap)) if cap is not None else n).cast("long"))
    work = F.col("retained") * lags * F.col("rows")
    return table.select("series_id", "target", "budget", "threshold", "retained", "rows", work.alias("compute"), work.alias("memory"), (work * rule.value_bytes).alias("bytes"))


def admission(trust: Column, rule: TrustRule = TrustRule()) -> Column:
    """0 below the low limit, 1 above the high one, linear between; trust outside 0 to 1 is an error."""
    inside = (trust >= 0) & (trust <= 1)
    between = (trust - rule.low) / (rule.high - rule.low)
    return F.when(trust.isNull(), None).when(~inside, F.raise_error(F.lit("trust must be inside [0, 1]")).cast("double")).when(trust <= rule.low, 0.0).when(trust >= rule.high, 1.0).otherwise(between)


def trust_gates(relations: DataFrame, rule: TrustRule = TrustRule()) -> DataFrame:
    """Direction and admission of every ranked source."""
    return ranked(relations).withColumns({"direction": F.when(F.col("weight") < 0, -1).otherwise(1), "trust": F.col("score"), "admission": admission(F.col("score"), rule)})


def with_full_trust(relations: DataFrame, source: str) -> DataFrame:
    """The relations as if one source were trusted fully: score 1, and a weight of 1 with its sign (1 for 0)."""
    own = F.col("source") == source
    weight = F.when(own, F.when(F.col("weight") < 0, -1.0).otherwise(1.0)).otherwise(F.col("weight"))
    return relations.withColumns({"weight": weight, "score": F.when(own, 1.0).otherwise(F.col("score"))})


def mark_selected(relations: DataFrame, selected: DataFrame, keys: tuple[str, ...] = ("series_id", "source")) -> DataFrame:
    """Add whether each relation is among the selected ones, by keys."""
    chosen = selected.select(*keys).distinct().withColumn("_chosen", F.lit(True))
    return relations.join(chosen, [*keys], "left").withColumn("selected", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def gated_mixture(panel: DataFrame, gates: DataFrame) -> DataFrame:
    """(series_id, target, t, mixture): the admitted sources' values, signed and weighted, added up."""
    rows = panel.withColumnRenamed("signal", "source").join(gates.select("series_id", "source", "target", "direction", "admission"), ["series_id", "source"])
    return rows.groupBy("series_id", "target", "t").agg(F.sum(F.col("direction") * F.col("admission") * F.col("value")).alias("mixture"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ("series_id",), p: str = "p_value") -> DataFrame:
    """Add the step-up cutoff of each family of tests: the largest p with p <= alpha * rank / m, or 0.

    Without keys all tests are one family, however many: p-values are counted, ranked in
    ranges by many tasks, and only the cutoff comes back.
    """
    if not keys:
        counts = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        placed = cumulative(counts, (), ["_p"], "_n")
        reached = F.when(F.col("_p") <= alpha * (F.col("_before") + F.col("_n")) / F.col("_whole"), F.col("_p"))
        cutoff = placed.agg(F.coalesce(F.max(reached), F.lit(0.0)).alias("fdr_cutoff"))
        return tests.crossJoin(F.broadcast(cutoff))  # one row
    order = Window.partitionBy(*keys).orderBy(p)
    family = Window.partitionBy(*keys)
    rows = tests.withColumn("_rank", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(family))
    return rows.withColumn("fdr_cutoff", F.coalesce(F.max(F.when(F.col(p) <= alpha * F.col("_rank") / F.col("_m"), F.col(p))).over(family), F.lit(0.0))).drop("_rank", "_m")


def _of_family(rows: DataFrame, keys: tuple[str, ...], **figures: Column) -> DataFrame:
    """Add aggregates of each row's family."""
    found = rows.groupBy(*keys).agg(*[f.alias(name) for name, f in figures.items()])
    return rows.join(found, list(keys)) if keys else rows.crossJoin(F.broadcast(found))  # one row


def noise_floor(samples: Column, comparisons: int, alpha: float = 0.05, strict: bool = False) -> Column:
    """The correlation that noise reaches in that many comparisons; up to three samples it is NULL, or with ``strict`` an error."""
    floor = stats.fisher_threshold(samples, stats.critical_z(alpha, comparisons))
    return F.when(samples <= 3, F.raise_error(F.lit("a noise floor needs more than three samples")).cast("double")).otherwise(floor) if strict else floor


def evidence_gate(relations: DataFrame, max_lag: int, alpha: float = 0.05, min_stability: float = 0.45, max_uncertainty: float = 0.20, min_support: float = 0.50, keys: tuple[str, ...] = ("series_id",), reference_samples: int | None = None) -> DataFrame:
    """Decide on relations by significance, stability, uncertainty and support, with the first failing check as reason.

    A NULL stability or uncertainty fails. keys name a family of candidates that share the
    false-discovery rate, one of a series by default. Support is a share of
    ``reference_samples``, or else of the family's largest sample.
    """
    if reference_samples is not None and reference_samples <= 0:
        raise ValueError("reference_samples must be positive")
    tested = benjamini_hochberg(relations.withColumn("p_value", stats.correlation_p(F.col("score"), F.col("sample_count"))), alpha, keys)
    tested = _of_family(tested, keys, _most=F.max("sample_count"), _pairs=F.count_distinct("source", "target"))
    most = F.lit(reference_samples) if reference_samples is not None else F.col("_most")
    level = stats.critical(stats.sidak_alpha(alpha, F.col("_pairs") * max_lag))
    tested = tested.withColumns({"support": F.least(F.lit(1.0), F.col("sample_count") / most), "_z": level}).withColumn("noise_floor", stats.fisher_threshold(F.col("sample_count"), F.col("_z")))
    reason = (
        F.when(F.col("p_value") > F.col("fdr_cutoff"), "below_fdr_corrected_effect")
        .when(F.coalesce(F.col("stability") < min_stability, F.lit(True)), "insufficient_stability")
        .when(F.coalesce(F.col("uncertainty") > max_uncertainty, F.lit(True)), "excess_relationship_uncertainty")
        .when(F.col("support") < min_support, "insufficient_sample_support")
        .otherwise("selected")
    )
    effect = F.coalesce(F.try_divide(F.col("score"), F.col("noise_floor")), F.lit(0.0))
    return tested.withColumn("reason", reason).withColumns({"selected": F.col("reason") == "selected", "effect_size": effect}).drop("_z", "_most", "_pairs")


def fixed_threshold(relations: DataFrame, threshold: float = BUDGET_FLOOR) -> DataFrame:
    return relations.where(F.col("score") > threshold)


def precision_recall(selected: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall) of sets of sources (key, source); an empty selection is right only about an empty truth."""
    a, b = selected.select(key, "source").distinct().withColumn("_a", F.lit(1)), truth.select(key, "source").distinct().withColumn("_b", F.lit(1))
    n = a.join(b, [key, "source"], "full").groupBy(key).agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count(F.col("_a") + F.col("_b")).alias("both"))
    precision = F.when(F.col("a") == 0, F.when(F.col("b") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide("both", "a"))
    return n.select(key, precision.alias("precision"), F.when(F.col("b") == 0, 1.0).otherwise(F.try_divide("both", "b")).alias("recall"))
