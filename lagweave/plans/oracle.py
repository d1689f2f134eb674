"""DuckDB SQL with the same results as the registered queries, written on its own from the definitions."""

from __future__ import annotations

from statistics import NormalDist

LAGS, WINDOW, SEASON = 3, 20, 12
YEAR, YEAR_WINDOW, GROWING_WINDOW = 12, 36, 24

PANEL = """
li AS (SELECT 'lineitem' AS series_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, round(sum(l_extendedprice), 2) AS volume,
  round(avg(l_quantity), 8) AS quantity, round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY ALL),
od AS (SELECT 'orders' AS series_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, round(sum(o_totalprice), 2) AS volume,
  CAST(count(*) AS DOUBLE) AS orders, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS finished FROM orders GROUP BY ALL),
ev AS (SELECT 'events:' || event_type AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS volume,
  round(avg(value), 8) AS mean_value, round(max(value), 8) AS max_value, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events GROUP BY ALL),
panel AS (SELECT series_id, t, signal, value FROM (UNPIVOT li ON volume, quantity, discount, tax, lines INTO NAME signal VALUE value)
  UNION ALL SELECT series_id, t, signal, value FROM (UNPIVOT od ON volume, orders, finished INTO NAME signal VALUE value)
  UNION ALL SELECT series_id, t, signal, value FROM (UNPIVOT ev ON volume, mean_value, max_value, users INTO NAME signal VALUE value))"""

ALL_BRANDS = """
br AS (SELECT p_brand AS series_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, round(sum(l_extendedprice), 2) AS volume,
  round(avg(l_quantity), 8) AS quantity, round(avg(l_discount), 8) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
BRANDS = f"""{ALL_BRANDS},
panel AS (SELECT series_id, t, signal, value FROM (UNPIVOT br ON volume, quantity, discount INTO NAME signal VALUE value)
  WHERE series_id IN (SELECT series_id FROM br GROUP BY 1 HAVING count(*) = max(t) - min(t) + 1))"""

CORR = "greatest(-1.0, least(1.0, coalesce(covar_pop(y, x) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 0.0)))"


def _corr_over(frame: str) -> str:
    return f"greatest(-1.0, least(1.0, coalesce(covar_pop(y, x) OVER {frame} / nullif(sqrt(var_pop(x) OVER {frame} * var_pop(y) OVER {frame}), 0), 0.0)))"


def _pairs(source: str = "panel", target: str = "", lags: int = LAGS) -> str:
    return f"""
pairs AS (SELECT s.series_id, s.signal AS source, g.signal AS target, l.lag, g.t, s.value AS x, g.value AS y
  FROM {source} s CROSS JOIN (SELECT CAST(unnest(range(1, {lags} + 1)) AS INT) AS lag) l JOIN {source} g ON g.series_id = s.series_id AND g.t = s.t + l.lag AND g.signal <> s.signal
  WHERE s.value IS NOT NULL AND g.value IS NOT NULL {target})"""


def _best(source: str, keys: str) -> str:
    return f"""
best AS (SELECT * EXCLUDE (_r) FROM (SELECT *, abs(weight) AS score, row_number() OVER (PARTITION BY {keys} ORDER BY round(abs(weight), 12) DESC, lag) AS _r FROM {source}) WHERE _r = 1)"""


EDGE = "series_id, source, target"
CORRS = f"corrs AS (SELECT {EDGE}, lag, {CORR} AS weight, count(*) AS sample_count FROM pairs GROUP BY ALL)"
RELATIONS = f"{PANEL}, {_pairs()}, {CORRS}, {_best('corrs', EDGE)}"
TO_TARGET = "AND g.signal = 'volume'"
SHOW = "lag, round(weight, 10) + 0.0 AS weight, round(score, 10) AS score, sample_count"


def _out(x: str, digits: int, name: str) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


CHANGED = """
changed AS (SELECT series_id, t, signal, value - lag(value) OVER (PARTITION BY series_id, signal ORDER BY t) AS value FROM panel)"""
LOGGED = """
changed AS (SELECT series_id, t, signal, CASE WHEN signal IN ('volume', 'quantity', 'lines', 'orders', 'users')
  THEN ln(value) - ln(lag(value) OVER w) ELSE value - lag(value) OVER w END AS value FROM panel WINDOW w AS (PARTITION BY series_id, signal ORDER BY t))"""

FORECASTS = f"""{PANEL},
rows AS (SELECT series_id, t, value AS actual, row_number() OVER w - 1 AS idx, lag(value) OVER w AS persistence, coalesce(lag(value, {SEASON}) OVER w, lag(value) OVER w) AS seasonal,
  count(*) OVER (PARTITION BY series_id) AS n FROM panel WHERE signal = 'volume' WINDOW w AS (PARTITION BY series_id ORDER BY t)),
forecasts AS (SELECT *, idx >= n - n // 5 AS is_test FROM rows)"""

TIERS = "tiers AS (SELECT budget, 0.06::DOUBLE + (1 - budget) * (0.5::DOUBLE - 0.06::DOUBLE) AS threshold FROM (SELECT CAST(unnest([1.0, 0.75, 0.5, 0.25, 0.0]) AS DOUBLE) AS budget))"
ADMIT = "CASE WHEN score <= 0.15 THEN 0.0 WHEN score >= 0.5 THEN 1.0 ELSE (score - 0.15) / (0.5 - 0.15) END"
RANK = "CAST(row_number() OVER (PARTITION BY series_id, target ORDER BY round(score, 12) DESC, source, lag) AS INT) AS rank"

#: Windows of 20 steps: pairs at lag L lie in [step - 20 + L, step - 1]; a step past the end is included.
_STEPS = f"""
ends AS (SELECT series_id, min(t) AS first_t FROM {{0}} WHERE value IS NOT NULL GROUP BY 1),
steps AS (SELECT DISTINCT {EDGE}, lag, t AS step FROM pairs UNION SELECT {EDGE}, lag, max(t) + 1 FROM pairs GROUP BY ALL),
corrs AS (SELECT s.series_id, s.source, s.target, s.lag, s.step, {CORR} AS weight, count(*) AS sample_count
  FROM steps s JOIN ends e USING (series_id) JOIN pairs p ON p.series_id = s.series_id AND p.source = s.source AND p.target = s.target AND p.lag = s.lag AND p.t < s.step AND p.t >= s.step - {WINDOW} + s.lag + {{1}}
  WHERE s.step - e.first_t >= {WINDOW} GROUP BY ALL)"""
#: A year of lags, in full windows of three years, and in windows of two years that may begin with the series.
_YEAR_STEPS = _STEPS.format("panel", 0).replace(f"p.t >= s.step - {WINDOW} +", f"p.t >= s.step - {YEAR_WINDOW} +").replace(f"first_t >= {WINDOW}", f"first_t >= {YEAR_WINDOW}")
_GROWING_STEPS = _STEPS.format("panel", 0).replace(f"p.t >= s.step - {WINDOW} +", f"p.t >= s.step - {GROWING_WINDOW} +").replace(f"first_t >= {WINDOW}", f"first_t > {YEAR}")
YEARLY = f"{PANEL}, {_pairs('panel', TO_TARGET, YEAR)}, {_YEAR_STEPS}, {_best('corrs', EDGE + ', step')}"
GROWING = f"{PANEL}, {_pairs('panel', TO_TARGET, YEAR)}, {_GROWING_STEPS}, {_best('corrs', EDGE + ', step')}"
ROLLING = f"{PANEL}, {_pairs('panel', TO_TARGET)}, {_STEPS.format('panel', 0)}, {_best('corrs', EDGE + ', step')}"
CHANGED_MIXED = """
changed AS (SELECT series_id, t, signal, CASE WHEN signal IN ('quantity', 'tax', 'orders', 'mean_value', 'users') THEN value ELSE value - lag(value) OVER (PARTITION BY series_id, signal ORDER BY t) END AS value FROM panel)"""
#: A difference's first value in a window is unknown.
_LATER = "CASE WHEN s.source IN ('quantity', 'tax', 'orders', 'mean_value', 'users') THEN 0 ELSE 1 END"
ROLLING_MIXED = f"{PANEL}, {CHANGED_MIXED}, {_pairs('changed', TO_TARGET)}, {_STEPS.format('changed', _LATER)}, {_best('corrs', EDGE + ', step')}"
ROLLING_DIFF = f"{PANEL}, {CHANGED}, {_pairs('changed', TO_TARGET)}, {_STEPS.format('changed', 1)}, {_best('corrs', EDGE + ', step')}"


def _lifecycle(source: str, keys: str) -> str:
    return f"""
points AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY step DESC) AS back, last_value(weight) OVER w AS last_weight, last_value(lag) OVER w AS last_lag
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
summed AS (SELECT {keys}, count(*) AS points, max(step) AS step, max_by(lag, step) AS lag, max_by(weight, step) AS weight, max_by(score, step) AS score, max_by(sample_count, step) AS sample_count,
  avg(score) FILTER (back <= 5) AS recent_mean, coalesce(avg(score) FILTER (back > 5), avg(score) FILTER (back <= 5)) AS prior_mean,
  avg(CASE WHEN sign(weight) = sign(last_weight) AND sign(last_weight) <> 0 THEN 1.0 ELSE 0.0 END) FILTER (back <= 5) AS same_sign,
  avg(CASE WHEN lag = last_lag THEN 1.0 ELSE 0.0 END) FILTER (back <= 5) AS same_lag, stddev_pop(weight) FILTER (back <= 5) AS spread,
  coalesce(regr_slope(score, -back) FILTER (back <= 10), 0.0) AS slope, bool_and(score < 0.2) FILTER (back <= 5) AS all_low FROM points GROUP BY {keys}),
rated AS (SELECT *, CASE WHEN points >= 6 THEN greatest(0.0, least(1.0, recent_mean * same_sign * same_lag)) END AS stability, CASE WHEN points >= 6 THEN spread END AS uncertainty FROM summed),
life AS (SELECT *, CASE WHEN points < 6 THEN 'birth' WHEN all_low THEN 'dead'
  WHEN prior_mean >= 0.2 AND (recent_mean < prior_mean * 0.65 OR (slope < -0.025 AND recent_mean < prior_mean - 0.08)) THEN 'decaying'
  WHEN stability >= 0.45 AND recent_mean >= 0.2 AND recent_mean > prior_mean + 0.08 AND slope > 0.01 THEN 'strengthening'
  WHEN stability >= 0.45 AND recent_mean >= 0.2 THEN 'stable' ELSE 'birth' END AS state FROM rated)"""


#: A normal value's two-sided tail beyond z, by Simpson's rule over the density from z on.
_TAIL = "list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + k * 0.006, 2) / 2))) * 0.006 / 3 * 2 / sqrt(2 * pi())"
_FISHER = "atanh(least(score, 0.999999)) * sqrt(greatest(sample_count - 3, 0))"
#: Critical values after Sidak's correction, by the number of pairs of a series.
_CRITICAL = ", ".join(f"({n}, {NormalDist().inv_cdf(1 - (1 - 0.95 ** (1 / (LAGS * n))) / 2)!r})" for n in range(1, 13))
_STEP_UP = "coalesce(max(CASE WHEN p <= 0.05 * k / m THEN p END) OVER (PARTITION BY series_id), 0.0)"
#: Every signal over its own largest value.
UNIT = "unit AS (SELECT series_id, t, signal, value / max(value) OVER (PARTITION BY series_id, signal) AS value FROM panel)"

#: A dense system's matrix as a list of rows with the right side last: the column's largest pivot comes first, and its column is cleared in all other rows.
_ELIMINATE = """CASE WHEN abs(m[b][c]) >= 1e-12 THEN list_transform(range(1, len(m) + 1), lambda r: CASE WHEN r = c THEN first ELSE
  list_transform(range(1, len(m) + 2), lambda q: (CASE WHEN r = b THEN m[c][q] ELSE m[r][q] END) - (CASE WHEN r = b THEN m[c][c] ELSE m[r][c] END) * first[q]) END) END"""


def _split(name: str, lags: str, train_end: str, last: str = "") -> str:
    """Label rows from ``lags`` rows on in training, and those after the training."""
    return f"""
{name} AS (SELECT series_id, t, idx, n, value AS actual, persistence, t <= train_end AS is_train FROM (SELECT series_id, t, value, row_number() OVER w - 1 AS idx, lag(value) OVER w AS persistence,
  count(*) OVER (PARTITION BY series_id) AS n FROM unit WHERE signal = 'volume' WINDOW w AS (PARTITION BY series_id ORDER BY t)) JOIN {train_end} USING (series_id) WHERE {lags} {last})"""


def _ends(name: str, share: int) -> str:
    """The last step before a series' final share."""
    return f"""
{name} AS (SELECT series_id, max(t) AS train_end FROM (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM unit WHERE signal = 'volume') WHERE idx < n - n // {share} GROUP BY 1)"""


def _trained(x: str, lags: int, train_end: str) -> str:
    """Relations into the target on the steps up to the training's end, with their ranks."""
    return f"""
{x}past AS (SELECT u.* FROM unit u JOIN {train_end} USING (series_id) WHERE t <= train_end),
{_pairs(x + "past", TO_TARGET, lags).replace("pairs AS", x + "pairs AS")},
{x}corrs AS (SELECT {EDGE}, lag, {CORR} AS weight, count(*) AS sample_count FROM {x}pairs GROUP BY ALL),
{_best(x + "corrs", EDGE).replace("best AS", x + "best AS")},
{x}ranked AS (SELECT *, {RANK} FROM {x}best)"""


def _fits(x: str, lags: int, cap: int, labels: str) -> str:
    """Predictors from the target's and the k best sources' lagged values for every k, and their predictions of the rows after the training.

    {x}used has for every k the largest number of sources, at most k, whose system can be solved.
    """
    lag, whole = f"(SELECT unnest(range(1, {lags} + 1)) AS l)", "series_id, k, t"
    return f"""
{x}k AS (SELECT series_id, CAST(k AS INT) AS k FROM (SELECT series_id, count(*) AS n FROM {x}ranked GROUP BY 1) CROSS JOIN (SELECT unnest(range(1, {cap} + 1)) AS k) WHERE k <= n),
{x}names AS (SELECT m.series_id, k, string_agg(source, ';' ORDER BY rank) AS names FROM {x}k m JOIN {x}ranked r ON r.series_id = m.series_id AND rank <= k GROUP BY ALL),
{x}cells AS (SELECT series_id, k, t, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS v FROM {x}k JOIN unit USING (series_id) WHERE signal = 'volume'
  UNION ALL SELECT series_id, k, t, 1 + {lags} * (k + 1), value FROM {x}k JOIN unit USING (series_id) WHERE signal = 'volume'
  UNION ALL SELECT series_id, k, t + l, 1 + (l - 1) * (k + 1), value FROM {x}k JOIN unit USING (series_id) CROSS JOIN {lag} WHERE signal = 'volume'
  UNION ALL SELECT m.series_id, k, t + l, 1 + (l - 1) * (k + 1) + rank, value * weight FROM {x}k m JOIN {x}ranked r ON r.series_id = m.series_id AND rank <= k JOIN unit u ON u.series_id = r.series_id AND u.signal = r.source CROSS JOIN {lag}),
{x}whole AS (SELECT {whole} FROM {x}cells GROUP BY ALL HAVING count(*) = {lags} * (k + 1) + 2),
{x}rows AS (SELECT {whole}, i, v, is_train FROM {x}cells JOIN {x}whole USING ({whole}) JOIN {labels} USING (series_id, t)),
{x}sums AS (SELECT series_id, k, a.i AS i, b.i AS j, sum(a.v * b.v) AS v FROM {x}rows a JOIN {x}rows b USING ({whole}) WHERE a.is_train AND a.i <= {lags} * (k + 1) GROUP BY ALL),
{x}lines AS (SELECT series_id, k, i, list(v ORDER BY j) AS line FROM {x}sums GROUP BY ALL),
{x}start AS (SELECT series_id, k, list(line ORDER BY i) AS m FROM {x}lines GROUP BY ALL),
{x}steps(series_id, k, c, m) AS (SELECT series_id, k, CAST(1 AS BIGINT), m FROM {x}start UNION ALL
  SELECT series_id, k, c + 1, {_ELIMINATE} FROM (SELECT *, list_transform(m[b], lambda y: y / m[b][c]) AS first FROM (SELECT *, list_position(s, list_max(s)) AS b
  FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda r: CASE WHEN r < c THEN -1.0 ELSE abs(m[r][c]) END) AS s FROM {x}steps WHERE c <= len(m))))),
{x}solved AS (SELECT series_id, k, list_transform(m, lambda r: r[len(r)]) AS beta FROM {x}steps WHERE c = len(m) + 1),
{x}used AS (SELECT m.series_id, m.k, max(s.k) AS used FROM {x}k m LEFT JOIN {x}solved s ON s.series_id = m.series_id AND s.k <= m.k GROUP BY ALL),
{x}predicted AS (SELECT series_id, k AS used, t, sum(v * beta[i + 1]) AS predicted FROM {x}rows JOIN {x}solved USING (series_id, k) WHERE NOT is_train AND i <= {lags} * (k + 1) GROUP BY ALL)"""


_STATUS = "CASE WHEN used IS NULL THEN 'baseline_only_no_stable_signal' WHEN used < k THEN 'fit_after_collinearity_backoff' ELSE 'fit' END"


def _search(lags: int) -> str:
    """The cells of one lag: every threshold and cap, scored on the validation rows."""
    x = f"l{lags}_"
    return f"""{_split(x + "labels", f"(t > train_end OR idx >= {lags}) AND idx >= 1", "half", "AND t <= (SELECT any_value(e.train_end) FROM ends e WHERE e.series_id = half.series_id)")},
{_trained(x, lags, "half")}, {_fits(x, lags, 2, x + "labels")},
{x}scored AS (SELECT series_id, used, avg(abs(actual - coalesce(predicted, persistence))) AS mae FROM {x}predicted JOIN {x}labels USING (series_id, t) GROUP BY ALL),
{x}base AS (SELECT series_id, avg(abs(actual - persistence)) AS persistence_mae FROM {x}labels WHERE NOT is_train GROUP BY 1),
{x}lists AS (SELECT series_id, threshold, cap, CAST(least(count(*), cap) AS INT) AS k FROM {x}best CROSS JOIN grid WHERE score > threshold GROUP BY series_id, threshold, cap),
{x}cells_of AS (SELECT series_id, CAST({lags} AS INT) AS lag_window, threshold, cap, coalesce(k, 0) AS n_sources, CASE WHEN k IS NULL THEN 0 ELSE coalesce(used, 0) END AS used,
  CASE WHEN k IS NULL THEN 'baseline_only_no_retained_signal' ELSE {_STATUS} END AS fit_status, coalesce(mae, persistence_mae) AS validation_mae, persistence_mae, names AS used_sources
  FROM {x}base CROSS JOIN grid LEFT JOIN {x}lists USING (series_id, threshold, cap) LEFT JOIN {x}used USING (series_id, k) LEFT JOIN {x}scored USING (series_id, used)
  LEFT JOIN (SELECT series_id, k AS used, names FROM {x}names) USING (series_id, used))"""


SEARCH = f"""{PANEL}, {UNIT}, {_ends("half", 2)}, {_ends("ends", 5)}, grid AS (SELECT threshold, cap FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) a(threshold) CROSS JOIN (VALUES (1::INT), (2::INT)) b(cap)),
{_search(1)}, {_search(2)}, cells AS (SELECT * FROM l1_cells_of UNION ALL SELECT * FROM l2_cells_of)"""


def _frozen(lags: int) -> str:
    """The test of the chosen cells of one lag, refitted on all rows before the test."""
    x = f"f{lags}_"
    return f"""{_split(x + "labels", f"(t > train_end OR idx >= {lags}) AND idx >= 1", "ends")}, {_trained(x, lags, "ends")}, {_fits(x, lags, 2, x + "labels")},
{x}base AS (SELECT series_id, avg(abs(actual - persistence)) AS persistence_mae, sqrt(avg(pow(actual - persistence, 2))) AS persistence_rmse, count(*) AS test_rows FROM {x}labels WHERE NOT is_train GROUP BY 1),
{x}scored AS (SELECT series_id, used, avg(abs(actual - predicted)) AS model_mae, sqrt(avg(pow(actual - predicted, 2))) AS model_rmse FROM {x}predicted JOIN {x}labels USING (series_id, t) GROUP BY ALL),
{x}lists AS (SELECT series_id, CAST(count(*) AS INT) AS k FROM {x}ranked JOIN chosen USING (series_id) WHERE mode = 'model' AND {x}ranked.score > threshold AND rank <= cap GROUP BY 1),
{x}test AS (SELECT series_id, mode, lag_window, threshold, cap, CASE WHEN mode = 'baseline_only' THEN 'baseline_only_validation_guard' WHEN k IS NULL THEN 'baseline_only_no_retained_signal_after_refit' ELSE {_STATUS} END AS fit_status,
  test_rows, persistence_mae, persistence_rmse, model_mae, model_rmse FROM chosen JOIN {x}base USING (series_id) LEFT JOIN {x}lists USING (series_id) LEFT JOIN {x}used USING (series_id, k) LEFT JOIN {x}scored USING (series_id, used) WHERE lag_window = {lags})"""


FOLDS = f"""{FORECASTS},
folds AS (SELECT series_id, CAST((origin - 15) // 3 AS INT) AS fold, origin FROM (SELECT DISTINCT series_id, n FROM rows), LATERAL (SELECT unnest(range(15, n - 1, 3)) AS origin)),
per AS (SELECT f.series_id, f.fold, avg(abs(actual - seasonal)) AS m, avg(abs(actual - persistence)) AS b FROM folds f JOIN rows r ON r.series_id = f.series_id AND r.idx >= f.origin AND r.idx < f.origin + 2 GROUP BY ALL),
skills AS (SELECT series_id, fold, round((b - m) / b, 8) AS skill FROM per WHERE b > 0),
sized AS (SELECT series_id, skill, row_number() OVER (PARTITION BY series_id ORDER BY fold) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS folds FROM skills),
sizes AS (SELECT DISTINCT series_id, folds FROM sized),
chain AS (WITH RECURSIVE c(draw, state) AS (SELECT CAST(0 AS BIGINT), (1103515245::BIGINT * 20260818 + 12345) % 2147483648
  UNION ALL SELECT draw + 1, (1103515245::BIGINT * state + 12345) % 2147483648 FROM c WHERE draw + 1 < (SELECT max(folds) * 2000 FROM sizes)) SELECT * FROM c)"""
_LOW, _HIGH = "list_sort(list(v))[100]", "list_sort(list(v))[1901]"

SQL = {
    "panel_axis_audit": f"""WITH {PANEL}, steps AS (SELECT series_id, signal, t, count(*) AS n FROM panel GROUP BY ALL)
SELECT series_id, signal, min(t) AS first_t, max(t) AS last_t, count(*) AS present, max(t) - min(t) + 1 AS expected, max(t) - min(t) + 1 - count(*) AS missing,
  count(*) FILTER (n > 1) AS repeated, count(*) = max(t) - min(t) + 1 AND count(*) FILTER (n > 1) = 0 AS is_complete FROM steps GROUP BY ALL""",
    "brand_complete_panel": f"WITH {BRANDS} SELECT series_id, t, signal, {_out('value', 4, 'value')} FROM panel",
    "brand_relations": f"WITH {BRANDS}, {_pairs('panel', TO_TARGET)}, {CORRS}, {_best('corrs', EDGE)} SELECT {EDGE}, {SHOW} FROM best",
    "missing_steps": f"""WITH {PANEL}, {ALL_BRANDS}, kept AS (SELECT DISTINCT series_id, t FROM panel UNION SELECT DISTINCT series_id, t FROM br),
axis AS (SELECT series_id, unnest(range(min(t), max(t) + 1)) AS t FROM kept GROUP BY series_id)
SELECT series_id, t, printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS period FROM axis ANTI JOIN kept USING (series_id, t)""",
    "series_digest": f"""WITH {PANEL} SELECT series_id, signal, count(*) AS n, sha256(string_agg(printf('%.10f', value), chr(10) ORDER BY t) || chr(10)) AS digest
FROM panel GROUP BY ALL""",
    "lagged_correlations": f"WITH {PANEL}, {_pairs()}, {CORRS} SELECT {EDGE}, lag, {_out('weight', 10, 'weight')}, sample_count FROM corrs",
    "best_lag_ranking": f"WITH {RELATIONS} SELECT {EDGE}, {RANK}, {SHOW} FROM best",
    "diff_relations": f"WITH {PANEL}, {CHANGED}, {_pairs('changed')}, {CORRS}, {_best('corrs', EDGE)} SELECT {EDGE}, {SHOW} FROM best",
    "log_diff_relations": f"WITH {PANEL}, {LOGGED}, {_pairs('changed')}, {CORRS}, {_best('corrs', EDGE)} SELECT {EDGE}, {SHOW} FROM best",
    "acf_diagnostics": f"""WITH {PANEL}, v AS (SELECT series_id, signal, lag(value) OVER (PARTITION BY series_id, signal ORDER BY t) AS x, value AS y FROM panel),
a AS (SELECT series_id, signal, {CORR} AS r, count(*) AS pairs FROM v WHERE x IS NOT NULL GROUP BY ALL) SELECT series_id, signal, {_out('r', 10, 'lag1_acf')}, pairs, abs(r) > 0.95 AS highly_persistent FROM a""",
    "naive_forecasts": f"WITH {FORECASTS} SELECT series_id, t, idx, is_test, {_out('actual', 4, 'actual')}, {_out('persistence', 4, 'persistence')}, {_out('seasonal', 4, 'seasonal')} FROM forecasts",
    "baseline_errors": f"""WITH {FORECASTS}, long AS (SELECT series_id, 'persistence' AS baseline, actual, persistence AS p FROM forecasts WHERE is_test UNION ALL SELECT series_id, 'seasonal', actual, seasonal FROM forecasts WHERE is_test)
SELECT series_id, baseline, {_out('avg(abs(actual - p))', 4, 'mae')}, {_out('sqrt(avg((actual - p) * (actual - p)))', 4, 'rmse')}, count(*) AS n FROM long GROUP BY ALL""",
    "mase": f"""WITH {FORECASTS}, e AS (SELECT series_id, avg(abs(actual - seasonal)) AS mae FROM forecasts WHERE is_test GROUP BY 1),
s AS (SELECT series_id, avg(abs(actual - persistence)) AS scale FROM forecasts WHERE NOT is_test GROUP BY 1)
SELECT series_id, {_out('scale', 4, 'scale')}, {_out('mae / nullif(scale, 0)', 8, 'mase')} FROM e JOIN s USING (series_id)""",
    "directional_accuracy": f"""WITH {FORECASTS}, r AS (SELECT series_id, sign(seasonal - persistence) AS p, sign(actual - persistence) AS a FROM forecasts WHERE is_test)
SELECT series_id, {_out('count(*) FILTER (p <> 0) / count(*)', 10, 'decided')}, CASE WHEN count(*) FILTER (p <> 0) = 0 THEN 'nan'::DOUBLE ELSE round(count(*) FILTER (p <> 0 AND a <> 0 AND p = a) / count(*) FILTER (p <> 0), 10) END AS accuracy FROM r GROUP BY 1""",
    "worst_decile": f"""WITH {FORECASTS}, e AS (SELECT series_id, abs(actual - persistence) AS e, row_number() OVER (PARTITION BY series_id ORDER BY abs(actual - persistence) DESC, t) AS r, count(*) OVER (PARTITION BY series_id) AS k FROM forecasts WHERE is_test)
SELECT series_id, {_out('avg(e)', 4, 'worst_decile')} FROM e WHERE r <= greatest(1, k // 10) GROUP BY 1""",
    "change_space": f"""WITH {FORECASTS}, c AS (SELECT series_id, avg(abs(actual - persistence)) AS move, avg(abs((actual - persistence) - (seasonal - persistence))) AS e FROM forecasts WHERE is_test GROUP BY 1)
SELECT series_id, {_out('move', 4, 'mean_absolute_change')}, {_out('e', 4, 'change_mae')}, CASE WHEN move = 0 THEN 'nan'::DOUBLE ELSE round(e / move, 8) END AS error_share_of_move FROM c""",
    "budget_tiers": f"""WITH {RELATIONS}, {TIERS} SELECT series_id, target, budget, {_out('threshold', 10, 'threshold')}, CAST(row_number() OVER (PARTITION BY series_id, target, budget ORDER BY round(score, 12) DESC, source, lag) AS INT) AS rank, source, lag, {_out('score', 10, 'score')}
FROM best CROSS JOIN tiers WHERE score > threshold""",
    "resource_profile": f"""WITH {RELATIONS}, {TIERS}, r AS (SELECT series_id, count(*) AS rows FROM panel WHERE signal = 'volume' GROUP BY 1),
k AS (SELECT series_id, target, budget, threshold, count(*) FILTER (score > threshold) AS retained FROM best CROSS JOIN tiers GROUP BY ALL)
SELECT series_id, target, budget, {_out('threshold', 10, 'threshold')}, retained, rows, retained * 3 * rows AS compute, retained * 3 * rows AS memory, retained * 3 * rows * 8 AS bytes FROM k JOIN r USING (series_id)""",
    "trust_gates": f"WITH {RELATIONS} SELECT series_id, target, {RANK}, source, lag, CASE WHEN weight < 0 THEN -1 ELSE 1 END AS direction, {_out('score', 10, 'trust')}, {_out(ADMIT, 8, 'admission')} FROM best",
    "gated_mixture": f"""WITH {RELATIONS}, gates AS (SELECT series_id, source, target, CASE WHEN weight < 0 THEN -1 ELSE 1 END * {ADMIT} AS g FROM best WHERE target = 'volume')
SELECT g.series_id, g.target, p.t, {_out('sum(g.g * p.value)', 3, 'mixture')} FROM panel p JOIN gates g ON g.series_id = p.series_id AND g.source = p.signal GROUP BY ALL""",
    "fixed_threshold": f"WITH {RELATIONS} SELECT {EDGE}, {SHOW} FROM best WHERE score > 0.06",
    "precision_recall": f"""WITH {RELATIONS}, f AS (SELECT series_id, score > 0.2 AS a, lag = 1 AS b FROM best WHERE target = 'volume'),
n AS (SELECT series_id, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (a AND b) AS hit FROM f WHERE a OR b GROUP BY 1)
SELECT series_id, round(CASE WHEN a = 0 THEN 0.0 ELSE hit / a END, 10) AS precision, round(CASE WHEN b = 0 THEN 1.0 ELSE hit / b END, 10) AS recall FROM n""",
    "noise_floor": f"""WITH {RELATIONS}, z AS (SELECT *, 2.3877378870708172 / sqrt(sample_count - 3) AS z FROM best), f AS (SELECT *, (exp(2 * z) - 1) / (exp(2 * z) + 1) AS fl FROM z)
SELECT {EDGE}, sample_count, {_out('fl', 8, 'floor')}, score > fl AS clears FROM f""",
    "bh_cutoff": f"""WITH {RELATIONS}, zs AS (SELECT *, {_FISHER} AS z FROM best), p AS (SELECT {EDGE}, CASE WHEN sample_count <= 3 THEN 1.0 ELSE {_TAIL} END AS p FROM zs),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM p),
c AS (SELECT *, {_STEP_UP} AS cut FROM r)
SELECT {EDGE}, {_out('p', 8, 'p_value')}, {_out('cut', 8, 'fdr_cutoff')}, p <= cut AS rejected FROM c""",
    "pooled_cutoff": f"""WITH {PANEL}, {BRANDS.replace("panel AS (", "brand_panel AS (")}, everything AS (SELECT * FROM panel UNION ALL SELECT * FROM brand_panel),
{_pairs("everything")}, {CORRS}, {_best("corrs", EDGE)}, zs AS (SELECT *, {_FISHER} AS z FROM best), p AS (SELECT {EDGE}, CASE WHEN sample_count <= 3 THEN 1.0 ELSE {_TAIL} END AS p FROM zs),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p), c AS (SELECT *, coalesce(max(CASE WHEN p <= 0.05 * k / m THEN p END) OVER (), 0.0) AS cut FROM r)
SELECT {EDGE}, {_out('p', 8, 'p_value')}, {_out('cut', 8, 'fdr_cutoff')}, p <= cut AS rejected FROM c""",
    "lag_features": f"""WITH {RELATIONS}, top AS (SELECT series_id, source, {RANK} FROM best WHERE target = 'volume'), two AS (SELECT a.series_id, a.source AS s1, b.source AS s2 FROM top a JOIN top b USING (series_id) WHERE a.rank = 1 AND b.rank = 2),
v AS (SELECT series_id, t, value FROM panel WHERE signal = 'volume')
SELECT v.series_id, v.t, round(v.value, 4) AS y, 1.0::DOUBLE AS x0, round(v1.value, 4) AS x1, round(a1.value, 4) AS x2, round(b1.value, 4) AS x3, round(v2.value, 4) AS x4, round(a2.value, 4) AS x5, round(b2.value, 4) AS x6
FROM v JOIN two ON two.series_id = v.series_id JOIN v v1 ON v1.series_id = v.series_id AND v1.t = v.t - 1 JOIN v v2 ON v2.series_id = v.series_id AND v2.t = v.t - 2
JOIN panel a1 ON a1.series_id = v.series_id AND a1.t = v.t - 1 AND a1.signal = s1 JOIN panel b1 ON b1.series_id = v.series_id AND b1.t = v.t - 1 AND b1.signal = s2
JOIN panel a2 ON a2.series_id = v.series_id AND a2.t = v.t - 2 AND a2.signal = s1 JOIN panel b2 ON b2.series_id = v.series_id AND b2.t = v.t - 2 AND b2.signal = s2""",
    "gram_matrix": f"""WITH {PANEL}, {UNIT}, places AS (SELECT series_id, signal, CASE WHEN signal = 'volume' THEN 0 ELSE row_number() OVER (PARTITION BY series_id ORDER BY signal = 'volume', signal) END AS place, count(*) OVER (PARTITION BY series_id) AS k FROM (SELECT DISTINCT series_id, signal FROM panel)),
cells AS (SELECT u.series_id, u.t + l AS t, 1 + (l - 1) * k + place AS i, value AS v FROM unit u JOIN places USING (series_id, signal) CROSS JOIN (SELECT unnest([1, 2]) AS l)
  UNION ALL SELECT series_id, t, 0, 1.0 FROM unit WHERE signal = 'volume' UNION ALL SELECT series_id, t, -1, value FROM unit WHERE signal = 'volume'),
whole AS (SELECT c.series_id, c.t FROM cells c JOIN (SELECT DISTINCT series_id, k FROM places) USING (series_id) GROUP BY c.series_id, c.t, k HAVING count(*) = 2 * k + 2)
SELECT a.series_id, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, {_out('sum(a.v * b.v)', 6, 'value')}, count(*) AS n FROM cells a JOIN cells b USING (series_id, t) JOIN whole USING (series_id, t) WHERE a.i >= 0 GROUP BY ALL""",
    "ar1_ols": f"""WITH {PANEL}, v AS (SELECT series_id, value / max(value) OVER (PARTITION BY series_id) AS y, t FROM panel WHERE signal = 'volume'), p AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS x FROM v)
SELECT series_id, 'fit' AS fit_status, {_out('regr_intercept(y, x)', 6, 'intercept')}, {_out('regr_slope(y, x)', 6, 'slope')} FROM p WHERE x IS NOT NULL GROUP BY 1""",
    "origin_skill": f"""WITH {PANEL}, {UNIT}, v AS (SELECT series_id, t, value AS y, lag(value) OVER w AS x, row_number() OVER w - 1 AS idx FROM unit WHERE signal = 'volume' WINDOW w AS (PARTITION BY series_id ORDER BY t)),
m AS (SELECT *, regr_intercept(y, x) OVER b + regr_slope(y, x) OVER b * x AS f FROM v WHERE x IS NOT NULL WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS INT) AS fold, t, {_out('1 - abs(y - f) / abs(y - x)', 6, 'skill')} FROM m WHERE idx > 12 AND isfinite(f) AND y <> x""",
    "rolling_relations": f"WITH {ROLLING} SELECT {EDGE}, step, step - {WINDOW} AS window_start, step AS window_end, {SHOW} FROM best",
    "yearly_relations": f"WITH {PANEL}, {_pairs('panel', '', YEAR)}, {CORRS}, {_best('corrs', EDGE)} SELECT {EDGE}, {SHOW} FROM best",
    "yearly_rolling_relations": f"WITH {YEARLY} SELECT {EDGE}, step, step - {YEAR_WINDOW} AS window_start, step AS window_end, {SHOW} FROM best",
    "growing_window_relations": f"WITH {GROWING} SELECT {EDGE}, step, greatest(step - {GROWING_WINDOW}, first_t) AS window_start, step AS window_end, {SHOW} FROM best JOIN ends USING (series_id)",
    "rolling_diff_relations": f"WITH {ROLLING_DIFF} SELECT {EDGE}, step, step - {WINDOW} AS window_start, step AS window_end, {SHOW} FROM best",
    "rolling_mixed_relations": f"WITH {ROLLING_MIXED} SELECT {EDGE}, step, step - {WINDOW} AS window_start, step AS window_end, {SHOW} FROM best",
    "expanding_relations": f"""WITH {PANEL}, {_pairs('panel', TO_TARGET)}, ends AS (SELECT series_id, min(t) AS first_t FROM panel GROUP BY 1),
corrs AS (SELECT s.series_id, s.source, s.target, s.lag, s.t AS step, {CORR.replace('(y, x)', '(p.y, p.x)').replace('var_pop(x)', 'var_pop(p.x)').replace('var_pop(y)', 'var_pop(p.y)')} AS weight, count(*) AS sample_count
  FROM pairs s JOIN ends e USING (series_id) JOIN pairs p ON p.series_id = s.series_id AND p.source = s.source AND p.target = s.target AND p.lag = s.lag AND p.t < s.t WHERE s.t - e.first_t >= {WINDOW} GROUP BY ALL), {_best('corrs', EDGE + ', step')}
SELECT {EDGE}, step, {SHOW} FROM best""",
    "trajectory_ranks": f"""WITH {ROLLING}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id, target, step ORDER BY round(score, 12) DESC, source, lag) AS INT) AS rank FROM best)
SELECT series_id, target, step, rank, source, lag, {_out('score', 10, 'score')} FROM r WHERE rank <= 2""",
    "relation_lifecycle": f"""WITH {ROLLING}, {_lifecycle('best', EDGE)} SELECT {EDGE}, step, lag, points, sample_count, {', '.join(_out(c, 8, c) for c in ('weight', 'stability', 'uncertainty', 'recent_mean', 'prior_mean', 'slope'))}, state FROM life""",
    "relation_detection": f"""WITH {ROLLING}, middles AS (SELECT series_id, (min(step) + max(step)) // 2 AS middle FROM best GROUP BY 1),
prefixes AS (SELECT b.*, e.step AS prefix_end, middle FROM best b JOIN best e USING (series_id, source, target) JOIN middles m ON m.series_id = e.series_id WHERE e.step >= middle AND b.step <= e.step),
{_lifecycle('prefixes', EDGE + ', prefix_end, middle')} SELECT {EDGE}, CAST(min(prefix_end) FILTER (state = 'decaying') - any_value(middle) AS BIGINT) AS detection_lag FROM life GROUP BY ALL""",
    "evidence_gate": f"""WITH {ROLLING}, {_lifecycle('best', EDGE)}, zs AS (SELECT *, {_FISHER} AS z, count(*) OVER (PARTITION BY series_id) AS pairs, max(sample_count) OVER (PARTITION BY series_id) AS most FROM life),
ps AS (SELECT *, CASE WHEN sample_count <= 3 THEN 1.0 ELSE {_TAIL} END AS p FROM zs),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM ps),
c AS (SELECT r.*, {_STEP_UP} AS cut, tanh(crit / sqrt(sample_count - 3)) AS fl, sample_count / most AS support FROM r JOIN (VALUES {_CRITICAL}) v(pairs, crit) USING (pairs)),
d AS (SELECT *, CASE WHEN p > cut THEN 'below_fdr_corrected_effect' WHEN stability IS NULL OR stability < 0.45 THEN 'insufficient_stability' WHEN uncertainty IS NULL OR uncertainty > 0.20 THEN 'excess_relationship_uncertainty'
  WHEN support < 0.5 THEN 'insufficient_sample_support' ELSE 'selected' END AS reason FROM c)
SELECT {EDGE}, lag, {_out('p', 6, 'p_value')}, {_out('cut', 6, 'fdr_cutoff')}, {_out('fl', 8, 'noise_floor')}, {_out('score / fl', 6, 'effect_size')}, {_out('support', 10, 'support')}, reason = 'selected' AS selected, reason FROM d""",
    "rolling_origin_folds": f"""WITH {PANEL}, n AS (SELECT series_id, count(*) AS n FROM panel WHERE signal = 'volume' GROUP BY 1), o AS (SELECT series_id, unnest(range(15, n - 1, 3)) AS o FROM n)
SELECT series_id, CAST((o - 15) // 3 AS INT) AS fold, CAST(0 AS BIGINT) AS train_lo, o AS train_hi, o AS test_lo, o + 2 AS test_hi FROM o""",
    "sliding_folds": f"""WITH {PANEL}, n AS (SELECT series_id, count(*) AS n FROM panel WHERE signal = 'volume' GROUP BY 1), o AS (SELECT series_id, unnest(range(12, n, 2)) AS o FROM n)
SELECT series_id, CAST((o - 12) // 2 AS INT) AS fold, o - 12 AS train_lo, o AS train_hi, o AS test_lo, o + 1 AS test_hi FROM o WHERE (o - 12) // 2 < 8""",
    "fold_skill": f"WITH RECURSIVE {FOLDS} SELECT series_id, fold, {_out('skill', 8, 'skill')} FROM skills",
    "bootstrap_skill": f"""WITH RECURSIVE {FOLDS}, picks AS (SELECT s.series_id, draw // folds AS resample, state % folds AS i FROM sizes s JOIN chain ON draw < folds * 2000),
m AS (SELECT p.series_id, resample, median(skill) AS v FROM picks p JOIN sized z ON z.series_id = p.series_id AND z.i = p.i GROUP BY ALL),
b AS (SELECT series_id, {_LOW} AS low, {_HIGH} AS high FROM m GROUP BY 1), mid AS (SELECT series_id, any_value(folds) AS folds, median(skill) AS median FROM sized GROUP BY 1)
SELECT series_id, folds, {_out('median', 8, 'median')}, {_out('low', 8, 'low')}, {_out('high', 8, 'high')} FROM mid JOIN b USING (series_id)""",
    "sign_flip_null": f"""WITH RECURSIVE {FOLDS}, picks AS (SELECT s.series_id, draw // folds AS resample, draw % folds AS i, CASE WHEN state < 1073741824 THEN 1.0 ELSE -1.0 END AS sg FROM sizes s JOIN chain ON draw < folds * 2000),
m AS (SELECT p.series_id, resample, avg(CAST(sg AS DOUBLE) * skill) AS v FROM picks p JOIN sized z ON z.series_id = p.series_id AND z.i = p.i GROUP BY ALL)
SELECT series_id, folds, {_out(_LOW, 8, 'low')}, {_out(_HIGH, 8, 'high')} FROM m JOIN sizes USING (series_id) GROUP BY ALL""",
    "spearman": f"""WITH {PANEL}, r AS (SELECT rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 AS x, rank() OVER (ORDER BY finished) + (count(*) OVER (PARTITION BY finished) - 1) / 2.0 AS y FROM od)
SELECT 'orders' AS series_id, {_out(CORR, 10, 'spearman')}, count(*) AS n FROM r""",
    "calibration_bins": f"""WITH {PANEL}, r AS (SELECT quantity, discount, row_number() OVER (ORDER BY quantity, t) - 1 AS i, count(*) OVER () AS n FROM li), b AS (SELECT unnest(range(0, 4)) AS bin)
SELECT 'lineitem' AS series_id, CAST(bin AS INT) AS bin, {_out('avg(quantity)', 8, 'confidence')}, {_out('avg(abs(discount))', 8, 'error')}, count(*) AS n FROM r JOIN b ON i >= bin * r.n // 4 AND i < (bin + 1) * r.n // 4 GROUP BY ALL""",
    "input_support": f"""WITH {FORECASTS}, e AS (SELECT series_id, min(actual) AS lo, max(actual) AS hi FROM forecasts WHERE NOT is_test GROUP BY 1)
SELECT series_id, t, round(CASE WHEN hi = lo THEN CASE WHEN actual = lo THEN 1.0 ELSE 0.0 END WHEN actual BETWEEN lo AND hi THEN 1.0
  ELSE greatest(0.0, least(1.0, 1 - (CASE WHEN actual < lo THEN lo - actual ELSE actual - hi END) / ((hi - lo) * 0.25))) END, 8) + 0.0 AS support FROM forecasts JOIN e USING (series_id) WHERE is_test""",
    "prediction_confidence": f"""WITH {ROLLING}, {_lifecycle('best', EDGE)}, c AS (SELECT {EDGE}, (stability + 1 / (1 + uncertainty) + least(1.0, points / 10) + 1 / (1 + CASE WHEN lag > 1 THEN recent_mean END)) / 4 AS m, least(1.0, points / 10) AS s FROM life)
SELECT {EDGE}, CASE WHEN m IS NOT NULL THEN round(greatest(0.0, least(1.0, least(m, s))), 8) + 0.0 END AS confidence FROM c""",
}
_ERRORS = ", ".join(_out(c, 6, c) for c in ("persistence_mae", "persistence_rmse", "model_mae", "model_rmse"))
SQL["budget_sweep"] = f"""WITH RECURSIVE {PANEL}, {UNIT}, {_ends("ends", 5)}, {_split("labels", "idx >= 2", "ends")}, {_trained("b_", 2, "ends")}, {_fits("b_", 2, 3, "labels")}, {TIERS},
kept AS (SELECT series_id, budget, count(*) AS retained, CAST(least(count(*), 3) AS INT) AS k FROM b_best CROSS JOIN tiers WHERE score > threshold GROUP BY ALL),
base AS (SELECT series_id, avg(abs(actual - persistence)) AS persistence_mae, sqrt(avg(pow(actual - persistence, 2))) AS persistence_rmse, count(*) AS test_rows FROM labels WHERE NOT is_train GROUP BY 1),
rows AS (SELECT series_id, count(*) AS n_rows FROM labels WHERE is_train GROUP BY 1),
scored AS (SELECT series_id, used, avg(abs(actual - predicted)) AS model_mae, sqrt(avg(pow(actual - predicted, 2))) AS model_rmse FROM b_predicted JOIN labels USING (series_id, t) GROUP BY ALL),
whole AS (SELECT series_id, budget, threshold, coalesce(retained, 0) AS retained, CAST(coalesce(k, 0) AS BIGINT) AS admitted, coalesce(names, '') AS sources,
  CASE WHEN k IS NULL THEN 'baseline_only_no_retained_signal' ELSE {_STATUS} END AS fit_status, coalesce(k, 0) * 2 * n_rows AS compute, test_rows, persistence_mae, persistence_rmse, model_mae, model_rmse
  FROM base CROSS JOIN tiers JOIN rows USING (series_id) LEFT JOIN kept USING (series_id, budget) LEFT JOIN b_names USING (series_id, k) LEFT JOIN b_used USING (series_id, k) LEFT JOIN scored USING (series_id, used))
SELECT series_id, budget, {_out("threshold", 10, "threshold")}, retained, admitted, sources, fit_status, compute, test_rows, {_ERRORS},
  {_out("(model_mae / first_value(model_mae) OVER (PARTITION BY series_id ORDER BY budget DESC) - 1) * 100", 3, "mae_loss_pct")}, {_out("(model_mae / persistence_mae - 1) * 100", 3, "mae_vs_persistence_pct")} FROM whole"""
SQL["validation_search"] = f"""WITH RECURSIVE {SEARCH} SELECT series_id, lag_window, threshold, cap, CAST(n_sources AS BIGINT) AS n_sources, CAST(used AS BIGINT) AS used, fit_status, {_out("validation_mae", 6, "validation_mae")}, {_out("persistence_mae", 6, "persistence_mae")} FROM cells"""
SQL["frozen_test"] = f"""WITH RECURSIVE {SEARCH},
chosen AS (SELECT series_id, lag_window, threshold, cap, CASE WHEN validation_mae >= persistence_mae THEN 'baseline_only' ELSE 'model' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(validation_mae, 12), used, threshold DESC, lag_window, cap, coalesce(used_sources, '')) AS place FROM cells) WHERE place = 1),
{_frozen(1)}, {_frozen(2)}, tested AS (SELECT * FROM f1_test UNION ALL SELECT * FROM f2_test)
SELECT series_id, mode, lag_window, threshold, cap, fit_status, test_rows, {_ERRORS} FROM tested"""
SQL["baseline_summary"] = f"""WITH e AS ({SQL["baseline_errors"]})
SELECT baseline, count(*) AS runs, {", ".join(_out(f"{f}({m})", 3, f"{n}_{m}") for m in ("mae", "rmse") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))} FROM e GROUP BY 1"""
