"""Secret scans: fixed patterns, and a battery of randomness tests over token-like runs.

Only DataFrame and SQL functions run here. Spans of matches come from the pieces between
them, whose lengths add up to positions in code points.

Every run of 20 or more characters gets the smallest alphabet it fits: hex, base 32, base
36, letters of one or both cases or digits alone, else base 64. Its symbols are then tested against a uniform source: chi-squared over
the alphabet, runs above and below the middle, and lag-one serial correlation; Fisher's
method joins the three. Long words have little else to tell them from random letters, so for
letters, and letters with digits in one case, the share of the twelve letters that are
frequent in European languages is a fourth test. Over the whole corpus, and apart for each length class, the
Benjamini-Hochberg procedure decides which runs are *not* random; short runs, on which the
tests have little power, get a stricter rate. The runs left are reported as ``random``.

The corpus enters through counts of p-values by class and cell only: some thousand rows at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: The kinds of spans, in the order of ties, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs that reach the least length are the same as the plain pattern's runs of that length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"

HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FREQUENT = "etaoinsrhldu"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: (least length, rate at which runs may be wrongly called structured), by length class.
RATES = ((20, 0.25), (32, 0.10), (64, 0.05))
#: Of random runs the share that may be called structured, however many structured ones there are: as p-values are uniform, a bound on the limit.
MOST_LOST = 0.10
#: Cells of p-values for each power of ten.
CELLS = 32

_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, kind: int, groups: tuple[int, ...] = (0,)) -> Column:
    """An array of (start, kind, end, value) of all matches; value is the last of ``groups``."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("sizes"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(groups[-1])).alias("values"),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def with_blocks(s: Column) -> Column:
        steps = F.transform(s["sizes"], lambda x, i: x + F.element_at(s["gaps"], i + 1))
        return _let(steps, lambda t: _let(F.transform(F.sequence(F.lit(0), F.floor(F.size(t) / _BLOCK).cast("int")), lambda b: total(F.slice(t, b * _BLOCK + 1, F.lit(_BLOCK)))), lambda blocks: F.transform(s["sizes"], lambda size, i: span(s, t, blocks, size, i))))

    def span(s: Column, steps: Column, blocks: Column, size: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        # whole blocks before, then this block's, then the gap before this match
        start = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + F.element_at(s["gaps"], i + 1)
        return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), (start + size).cast("long").alias("end"), F.element_at(s["values"], i + 1).alias("value"))

    return F.when(text.rlike(pattern), _let(found, with_blocks)).otherwise(F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, value: string>>)"))


def _sql_let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _encoded(token: str) -> str:
    """SQL for (alphabet, symbols) of a run by its inferred encoding."""
    both = lambda alphabet, symbols: f"named_struct('alphabet', '{alphabet}', 'symbols', {symbols})"
    return _sql_let("r", f"rtrim('=', {token})", f"""case
        when r rlike '^[0-9]+$' then {both("0123456789", "r")}
        when r rlike '^([a-z]+|[A-Z]+)$' then {both(LETTERS[26:], "lower(r)")}
        when r rlike '^[A-Za-z]+$' then {both(LETTERS, "r")}
        when r rlike '^([0-9a-f]+|[0-9A-F]+)$' then {both(HEX_DIGITS, "lower(r)")}
        when r rlike '^([a-z2-7]+|[A-Z2-7]+)$' then {both(BASE32, "upper(r)")}
        when r rlike '^([0-9a-z]+|[0-9A-Z]+)$' then {both(BASE36, "lower(r)")}
        else {both(BASE64, "translate(r, '-_', '+/')")}
        end""")


def _upper_tail(z: str) -> str:
    """SQL for 1 - Phi(z) by the logistic approximation, within 0.0002."""
    return f"(1D / (1D + exp(least(700D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3)))))"


def _p_value(token: str) -> str:
    """SQL for Fisher's joint p-value of the tests, for the hypothesis of a uniform random source."""
    chi = "(pow(greatest(b.k * b.squares / b.n - b.n, 0D) / (b.k - 1), 1 / 3D) - (1 - 2 / (9D * (b.k - 1)))) / sqrt(2 / (9D * (b.k - 1)))"
    runs = "if(b.mu <= 2, 40D, abs(b.runs - b.mu) / sqrt(greatest((b.mu - 1) * (b.mu - 2) / (b.n - 1), 1e-9D)))"
    serial = "if(b.var <= 0, 40D, abs(b.cov / greatest(b.var, 1e-9D) + 1 / b.n) * sqrt(b.n))"
    frequent = "(b.frequent - 0.5D - b.n * b.share) / sqrt(b.n * b.share * (1 - b.share))"
    three = f"{_upper_tail(chi)}, least(1D, 2 * {_upper_tail(runs)}), least(1D, 2 * {_upper_tail(serial)})"
    tests = f"if(b.share is null, array({three}), array({three}, {_upper_tail(frequent)}))"
    joint = _sql_let("h", "aggregate(p, 0D, (t, x) -> t - ln(greatest(x, 1e-300D)))", "exp(-h) * (1 + h + h * h / 2 + if(size(p) = 4, h * h * h / 6, 0D))")
    sums = """named_struct('n', a.n, 'k', a.k, 'frequent', a.frequent, 'share', a.share,
        'squares', aggregate(sequence(0, a.k - 1), 0D, (t, v) -> t + pow(size(filter(a.s, x -> x = v)), 2)),
        'mu', 2 * a.high * (a.n - a.high) / a.n + 1,
        'runs', 1D + aggregate(sequence(1, size(a.s) - 1), 0, (t, i) -> t + if((2 * a.s[i] >= a.k) <> (2 * a.s[i - 1] >= a.k), 1, 0)),
        'var', aggregate(a.s, 0D, (t, x) -> t + pow(x - a.mean, 2)),
        'cov', aggregate(sequence(1, size(a.s) - 1), 0D, (t, i) -> t + (a.s[i] - a.mean) * (a.s[i - 1] - a.mean)))"""
    symbols = """named_struct('s', y.s, 'k', y.k, 'frequent', y.frequent, 'share', y.share, 'n', cast(size(y.s) as double),
        'mean', aggregate(y.s, 0D, (t, x) -> t + x) / size(y.s),
        'high', cast(size(filter(y.s, x -> 2 * x >= y.k)) as double))"""
    places = f"named_struct('k', length(e.alphabet), 'frequent', length(regexp_replace(lower(e.symbols), '[^{FREQUENT}]', '')), 'share', case length(e.alphabet) when 26 then 12D / 26 when 52 then 24D / 52 when 36 then 12D / 36 end, 's', transform(filter(split(e.symbols, ''), c -> c <> ''), c -> locate(c, e.alphabet) - 1))"
    battery = _sql_let("y", places, _sql_let("a", symbols, _sql_let("b", sums, _sql_let("p", tests, joint))))
    return _sql_let("e", _encoded(token), battery)


def _class(size: str) -> str:
    """SQL for a run's length class."""
    return "case " + " ".join(f"when {size} >= {least} then {i}" for i, (least, _) in reversed([*enumerate(RATES)])) + " end"


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with columns ``_base``, base spans, and ``_tested``, all long runs with p-values; not yet decided."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 0, (0, 2)), lambda m: F.length(m["value"]) >= 8)
    plain = [F.transform(a, lambda m: F.struct(m["start"], m["kind"], m["end"])) for a in (assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2))]
    rows = docs.withColumn("_base", F.array_sort(F.concat(*plain))).withColumn("_runs", _matches(text, RANDOM, 3))
    tested = f"""transform(_runs, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'class', {_class("length(x.value)")}, 'p', {_p_value("x.value")}))"""
    return rows.withColumn("_tested", F.expr(tested)).drop("_runs")


def random_limits(runs: DataFrame) -> list[float]:
    """For each length class the p-value up to which (class, p) of runs count as structured (Benjamini-Hochberg over the corpus).

    The limit is exactly the largest p with p * n <= rate * (runs at or below p), and -1
    where there is none, or ``MOST_LOST`` if that is less. p-values are counted in cells, on
    a logarithmic scale; a cell that the limit may lie in is counted again in finer ones.
    """
    ends = [F.min("p").alias("low"), F.max("p").alias("high"), F.count(F.lit(1)).alias("n")]
    cell = F.floor(F.log10(F.greatest("p", F.lit(1e-300))) * CELLS)
    counts = runs.groupBy("class", cell.alias("cell")).agg(*ends).collect()  # at most classes x 300 x CELLS rows
    limits = []
    for i, (_, rate) in enumerate(RATES):
        cells = sorted((r["low"], r["high"], r["n"]) for r in counts if r["class"] == i)
        n = below = sum(c for _, _, c in cells)
        limit = -1.0
        while cells:
            low, high, c = cells.pop()
            if high * n <= rate * below:
                limit = high
                break
            if low < high and low * n <= rate * below:
                finer = runs.where((F.col("class") == i) & F.col("p").between(low, high))
                part = F.floor((F.col("p") - low) / (high - low) * 1000)
                cells += sorted((r["low"], r["high"], r["n"]) for r in finer.groupBy(part.alias("cell")).agg(*ends).collect())
            else:
                below -= c
        limits.append(min(limit, MOST_LOST))
    return limits


def _tested_runs(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.explode("_tested").alias("x")).select("x.class", "x.p")


def _decided(limits: list[float]) -> Column:
    """All spans of a scanned row: base ones and random runs, by start, then kind. A run inside a base span is a span of its own."""
    limit = "case x.class " + " ".join(f"when {i} then {x}D" for i, x in enumerate(limits)) + " end"
    random = f"transform(filter(_tested, x -> x.p > {limit}), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    return F.array_sort(F.concat("_base", F.expr(random)))


def _written(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: counts of base spans, the digest of their list, and all spans with those of random runs.

    n_tested counts the runs that the battery tested, n_random those it reports, and p_values
    lists all tested ones as start:end:p. Null texts count as empty and have no spans;
    repeated rows each give a row; other columns are not read, so their names don't matter.
    Texts are scanned once; what was found is settled without them.
    """
    count = lambda i: f"cast(size(filter(_base, x -> x.kind = {i})) as bigint)"
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("_text"))
    scanned = storage.settle(scan(rows, "_text").drop("_text"))
    return scanned.withColumn("_spans", _decided(random_limits(_tested_runs(scanned)))).select(
        "doc_id",
        F.expr(count(0)).alias("n_assign"),
        F.expr(count(1)).alias("n_access"),
        F.expr(count(2)).alias("n_hex"),
        F.sha2(F.expr(_written("_base")), 256).alias("base_sha256"),
        F.expr(_written("_spans")).alias("spans"),
        F.expr("cast(size(_tested) as bigint)").alias("n_tested"),
        F.expr("cast(size(_spans) - size(_base) as bigint)").alias("n_random"),
        F.expr("array_join(transform(_tested, x -> concat(x.start, ':', x.end, ':', format_number(x.p, 9))), ',')").alias("p_values"),
    )


#: Code points in a piece of a text that spans are cut from: no cut reads more of the text than two pieces.
_PIECE = 1024


def _cut(low: str, high: str) -> str:
    """SQL for the code points from low to high of the text in ``_pieces``."""
    a, b = f"int(({low}) div {_PIECE})", f"int(({high}) div {_PIECE})"
    head, tail = f"coalesce(get(_pieces, {a}), '')", f"coalesce(get(_pieces, {b}), '')"
    within = f"substring({head}, int(({low}) % {_PIECE}) + 1, int({high} - ({low})))"
    across = f"concat(substring({head}, int(({low}) % {_PIECE}) + 1), array_join(slice(_pieces, {a} + 2, greatest({b} - {a} - 1, 0)), ''), substring({tail}, 1, int(({high}) % {_PIECE})))"
    return f"if({a} = {b}, {within}, {across})"


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of ``secret_spans`` replaced by ``mark``; touching or overlapping spans become one.

    A null text stays null; texts without spans stay as they are. Repeated rows each give a
    row. All columns are kept, whatever their names. The limits need the p-values of all
    texts, so texts are scanned twice rather than stored between; the work on a text is
    linear in its length and spans.
    """
    plain, at = storage.plain(docs)
    text = at(text_column)
    limits = random_limits(storage.settle(_tested_runs(scan(plain.select(text), text))))
    found = scan(plain, text).withColumn("_spans", _decided(limits)).drop("_base", "_tested")
    # the furthest end of whole blocks of spans, then of all spans before each one
    found = found.withColumn("_ends", F.expr(f"transform(sequence(0, int(size(_spans) div {_BLOCK})), b -> array_max(transform(slice(_spans, b * {_BLOCK} + 1, {_BLOCK}), x -> x.end)))"))
    before = f"greatest(0L, array_max(slice(_ends, 1, int(i div {_BLOCK}))), array_max(transform(slice(_spans, int(i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), y -> y.end)))"
    found = found.withColumn("_pieces", F.expr(f"if(size(_spans) = 0, cast(array() as array<string>), regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0))"))
    kept = _sql_let("at", before, f"if(i > 0 and x.start <= at, '', concat({_cut('at', 'x.start')}, '{mark}'))")
    body = f"concat(array_join(transform(_spans, (x, i) -> {kept}), ''), {_sql_let('at', 'array_max(_ends)', _cut('at', f'bigint(size(_pieces)) * {_PIECE}'))})"
    new = F.expr(f"if({text} is null or size(_spans) = 0, {text}, {body})")
    return found.select(*[new.alias(c) if c == text else F.col(c) for c in plain.columns]).toDF(*docs.columns)
