"""The registered results as plain ANSI SQL over the same tables."""

from __future__ import annotations

from workload.queries import PRICED, PRICED_KEY, UNEVEN, SQL_TEXTS
from workload.tables import source, stable

# Schemas of the given tables that the statements need by name.
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_NUMBERS = LINEITEM[:8]
LABELLED = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
EVENTS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "event_type": "string", "value": "double", "props": "string",
}
CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
NATION = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def missing(table: str, names: list[str], extra: str = "") -> str:
    return union(
        f"""SELECT '{n}' AS "column", count(*) - count({n}) AS missing,
        {stable(f'((count(*) - count({n})) * 100.0 / count(*))')}::DOUBLE AS missing_pct FROM {source(table)}"""
        for n in names
    )


def distinct(table: str, names: list[str]) -> str:
    return union(f'SELECT \'{n}\' AS "column", count(DISTINCT {n}) AS "distinct" FROM {source(table)}' for n in names)


STATS = {
    "count": "count({x})::DOUBLE",
    "mean": "avg({x})",
    "std": "stddev_samp({x})",
    "min": "min({x})",
    "25%": "quantile_cont({x}, 0.25)",
    "50%": "quantile_cont({x}, 0.5)",
    "75%": "quantile_cont({x}, 0.75)",
    "max": "max({x})",
    "skewness": "CASE WHEN var_pop({x}) = 0 THEN 0 ELSE skewness({x}) END",
    "kurtosis": "CASE WHEN var_pop({x}) = 0 THEN 0 ELSE kurtosis({x}) END",
    "variance": "var_samp({x})",
}
DESCRIBE = list(STATS)[:8]


def stat_rows(table: str, names: list[str], wanted) -> str:
    rows = []
    for n in names:
        cells = ", ".join(f"{STATS[s].format(x=f'{n}::DOUBLE')} AS s{i}" for i, s in enumerate(wanted))
        parts = [f"SELECT '{n}' AS \"column\", '{s}' AS stat, s{i}::DOUBLE AS value FROM q" for i, s in enumerate(wanted)]
        rows.append(f"SELECT * FROM (WITH q AS (SELECT {cells} FROM {source(table)}) {union(parts)})")
    return f'SELECT "column", stat, {stable("value")}::DOUBLE AS value FROM ({union(rows)})'


def one_stat(table: str, names: list[str], stat: str) -> str:
    return union(
        f"SELECT '{n}' AS \"column\", {stable(f'v')}::DOUBLE AS {stat} "
        f"FROM (SELECT {STATS[stat].format(x=f'{n}::DOUBLE')} AS v FROM {source(table)})"
        for n in names
    )


def quantile_rows(table: str, names: list[str], probs: list[float]) -> str:
    return union(
        f"SELECT '{n}' AS \"column\", {p}::DOUBLE AS prob, {stable('v')}::DOUBLE AS value "
        f"FROM (SELECT quantile_cont({n}::DOUBLE, {p}) AS v FROM {source(table)})"
        for n in names
        for p in probs
    )


def histogram(table: str, name: str, bins: int = 30) -> str:
    """Counts by edge comparison: a value lies in the last bin whose lower edge it reaches."""
    return f"""SELECT '{name}' AS "column", e.bin::INTEGER AS bin, lo + bin * step AS lower,
      CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * step END AS upper, count(x) AS count,
      count(x) / (any_value(n) * (CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * step END - (lo + bin * step))) AS density
    FROM (SELECT *, (hi - lo) / {bins} AS step FROM
           (SELECT min({name})::DOUBLE AS lo, max({name})::DOUBLE AS hi, count({name}) AS n FROM {source(table)})) r
    CROSS JOIN (SELECT range AS bin FROM range({bins})) e
    LEFT JOIN (SELECT {name}::DOUBLE AS x FROM {source(table)} WHERE {name} IS NOT NULL) v
      ON x >= lo + bin * step AND (bin = {bins - 1} OR x < lo + (bin + 1) * step)
    GROUP BY bin, lo, hi, step"""


def topn(table: str, names: list[str], n: int = 10) -> str:
    return union(
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count
        FROM {source(table)} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {n})"""
        for c in names
    )


def corr(table: str, x: str, y: str) -> str:
    return (
        f"(SELECT CASE WHEN isnan(r) THEN NULL ELSE r END FROM "
        f"(SELECT corr({x}::DOUBLE, {y}::DOUBLE) AS r FROM {source(table)}))"
    )


def corr_rows(table: str, pairs) -> str:
    return union(
        f"SELECT '{x}' AS feature_1, '{y}' AS feature_2, {stable('r')}::DOUBLE AS r FROM "
        f"(SELECT {'1.0' if x == y else corr(table, x, y)} AS r)"
        for x, y in pairs
    )


def pairs(names, which=lambda i, j: True):
    return [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if which(i, j)]


def fences(table: str, name: str) -> str:
    return f"""(SELECT q1, med, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM
      (SELECT quantile_cont({name}::DOUBLE, 0.25) AS q1, quantile_cont({name}::DOUBLE, 0.5) AS med,
              quantile_cont({name}::DOUBLE, 0.75) AS q3 FROM {source(table)}))"""


def outliers(table: str, names: list[str]) -> str:
    return union(
        f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE {n} < lower OR {n} > upper) AS outliers,
        {stable(f"(count(*) FILTER (WHERE {n} < lower OR {n} > upper) * 100.0 / count(*))")}::DOUBLE AS outlier_pct
        FROM {source(table)} CROSS JOIN {fences(table, n)} f"""
        for n in names
    )


def box(table: str, n: str) -> str:
    cells = {
        "q1": "any_value(q1)",
        "median": "any_value(med)",
        "q3": "any_value(q3)",
        "whisker_low": f"least(min({n}) FILTER (WHERE {n} BETWEEN lower AND upper), any_value(q1))",
        "whisker_high": f"greatest(max({n}) FILTER (WHERE {n} BETWEEN lower AND upper), any_value(q3))",
    }
    inner = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in cells.items())
    outer = ", ".join(f"{stable(k)}::DOUBLE AS {k}" for k in cells)
    return f"""SELECT '{n}' AS "column", {outer}, fliers FROM (SELECT {inner},
      count(*) FILTER (WHERE {n} < lower OR {n} > upper) AS fliers
      FROM {source(table)} CROSS JOIN {fences(table, n)} f)"""


def kde(table: str, name: str, points: int, bins: int | None) -> str:
    """The kernel sum over every value (or bin centre) at every grid point."""
    if bins is None:
        values = f"SELECT {name}::DOUBLE AS v, 1 AS w FROM {source(table)} WHERE {name} IS NOT NULL"
    else:
        values = f"""SELECT lo + (cell + 0.5) * (hi - lo) / {bins} AS v, w FROM
          (SELECT least(floor(({name} - lo) / (hi - lo) * {bins}), {bins - 1}) AS cell, lo, hi, count(*) AS w
           FROM {source(table)} CROSS JOIN s WHERE {name} IS NOT NULL GROUP BY 1, 2, 3)"""
    return f"""WITH s AS (SELECT n, lo, hi, std * power(n, -0.2) AS h, lo - 0.5 * (hi - lo) AS x0,
        2 * (hi - lo) / {points - 1} AS step
      FROM (SELECT count({name}) AS n, min({name})::DOUBLE AS lo, max({name})::DOUBLE AS hi,
                   stddev_samp({name}) AS std FROM {source(table)})),
    v AS ({values})
    SELECT '{name}' AS "column", range::INTEGER AS point, x0 + range * step AS x,
      sum(w * exp(-0.5 * power((x0 + range * step - v) / h, 2))) / (any_value(n) * h * sqrt(2 * pi())) AS density
    FROM s CROSS JOIN range({points}) CROSS JOIN v GROUP BY range, x0, step, h"""


def rounded_kde(bins: int | None) -> str:
    return f"""SELECT "column", point, round(x, 6) + 0.0 AS x, round(density, 9) + 0.0 AS density
    FROM ({kde('events', 'value', 1000, bins)})"""


def calendar_counts(table: str, name: str, label: str, sql: str) -> str:
    return f"""SELECT '{name}' AS "column", {sql} AS {label}, count(*) AS rows FROM {source(table)}
    WHERE {name} IS NOT NULL GROUP BY 2"""


def schema_rows(table: str, schema: dict[str, str]) -> str:
    return union(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", '{t}' AS type, (SELECT count(*) FROM {table}) AS rows"
        for c, t in schema.items()
    )


def column_class(dtype: str) -> str:
    if dtype == "string":
        return "categorical"
    return "datetime" if dtype.startswith("timestamp") else "numeric"


def correlation_with(table: str, target: str, names: list[str], k: int) -> str:
    rows = union(f"SELECT '{n}' AS feature, abs({corr(table, n, target)}) AS r" for n in names)
    return f"""SELECT feature, {stable('r')}::DOUBLE AS abs_r FROM ({rows})
    ORDER BY r DESC NULLS LAST, feature LIMIT {k}"""


def scatter(table: str, target: str, names: list[str], bins: int) -> str:
    """All features lie among the strongest four here; the rest is binning."""
    spot = "least(coalesce(floor(({v} - {lo}) / nullif({hi} - {lo}, 0) * {b}), 0), {l})::INTEGER"
    x = spot.format(v="x", lo="xlo", hi="xhi", b=bins, l=bins - 1)
    y = spot.format(v="y", lo="ylo", hi="yhi", b=bins, l=bins - 1)
    rows = union(
        f"SELECT '{n}' AS feature, {n}::DOUBLE AS x, {target}::DOUBLE AS y, "
        f"(SELECT min({n})::DOUBLE FROM t) AS xlo, (SELECT max({n})::DOUBLE FROM t) AS xhi FROM t "
        f"WHERE {n} IS NOT NULL AND {target} IS NOT NULL"
        for n in names
    )
    top = f"(SELECT feature FROM ({correlation_with(table, target, names, 4)}))"
    return f"""WITH t AS (SELECT * FROM {source(table)}),
    e AS (SELECT min({target})::DOUBLE AS ylo, max({target})::DOUBLE AS yhi FROM t),
    b AS (SELECT feature, {x} AS x_bin, {y} AS y_bin, xlo, xhi, ylo, yhi FROM ({rows}) CROSS JOIN e
          WHERE feature IN {top})
    SELECT feature, x_bin, y_bin, {stable(f'(xlo + x_bin * (xhi - xlo) / {bins})')}::DOUBLE AS x_low,
      {stable(f'(ylo + y_bin * (yhi - ylo) / {bins})')}::DOUBLE AS y_low, count(*) AS count
    FROM b GROUP BY feature, x_bin, y_bin, xlo, xhi, ylo, yhi"""


# The advice texts of the rules.
LOG = "Consider log transformation for highly skewed features"
GROUP = "Consider grouping rare categories or using embedding techniques"
DATES = "Consider converting date strings to datetime and extracting features"
RATIO = "Consider creating ratio features between numeric columns"
POLY = "Consider polynomial features for important numeric features"
DROP = "Consider dropping or imputing high missing columns"


def skewed(table: str, names: list[str]) -> str:
    rows = union(
        f"SELECT '{n}' AS c, {STATS['skewness'].format(x=f'{n}::DOUBLE')} AS s FROM {source(table)}" for n in names
    )
    return f"""SELECT 'highly_skewed' AS rule, c AS "column", {stable('abs(s)')}::DOUBLE AS metric, '{LOG}' AS message
    FROM ({rows}) WHERE abs(s) > 1"""


def cardinality(table: str, names: list[str]) -> str:
    rows = union(f"SELECT '{n}' AS c, count(DISTINCT {n}) * 1.0::DOUBLE / count(*) AS s FROM {source(table)}" for n in names)
    return f"""SELECT 'high_cardinality' AS rule, c AS "column", {stable('s')}::DOUBLE AS metric, '{GROUP}' AS message
    FROM ({rows}) WHERE s > 0.5"""


def values_of(table: str, name: str) -> str:
    return f"(SELECT {name} AS v FROM {source(table)} WHERE {name} IS NOT NULL)"


def dates(table: str, names: list[str]) -> str:
    rows = union(
        f"SELECT '{n}' AS c, count(*) FILTER (WHERE length(v) IN (8, 10, 19) AND regexp_matches(v, '[-/:]')) AS s "
        f"FROM {values_of(table, n)}"
        for n in names
    )
    return f"""SELECT 'date_candidates' AS rule, c AS "column", s::DOUBLE AS metric, '{DATES}' AS message
    FROM ({rows}) WHERE s > 0"""


def mixed(table: str, names: list[str]) -> str:
    number = "TRY_CAST(v AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(v AS DOUBLE))"
    rows = union(
        f"SELECT '{n}' AS c, count(*) AS n, count(*) FILTER (WHERE {number}) AS s FROM {values_of(table, n)}"
        for n in names
    )
    return f"""SELECT 'mixed_types' AS rule, c AS "column", s::DOUBLE AS metric,
      'Review mixed data types in column: ' || c AS message FROM ({rows}) WHERE s > 0 AND s < n"""


def gaps(table: str, names: list[str]) -> str:
    rows = union(f"SELECT '{n}' AS c, avg(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS s FROM {source(table)}" for n in names)
    return f"""SELECT 'high_missing' AS rule, c AS "column", {stable('s')}::DOUBLE AS metric, '{DROP}' AS message
    FROM ({rows}) WHERE s > 0.5"""


def constants(table: str, names: list[str]) -> str:
    rows = union(f"SELECT '{n}' AS c, count(DISTINCT {n}) AS s FROM {source(table)}" for n in names)
    return f"""SELECT 'constant_columns' AS rule, c AS "column", s::DOUBLE AS metric,
      'Consider removing constant columns: [''' || c || ''']' AS message FROM ({rows}) WHERE s <= 1"""


def duplicates(table: str, names: list[str]) -> str:
    keys = ", ".join(names)
    return f"""SELECT sum(n - 1)::BIGINT AS duplicates, sum(n - 1) * 100.0::DOUBLE / sum(n) AS pct
    FROM (SELECT {keys}, count(*) AS n FROM {source(table)} GROUP BY {keys})"""


def numbered(parts: list[str]) -> str:
    rows = union(f"SELECT {i} AS place, rule, message FROM ({p})" for i, p in enumerate(parts))
    return f"""SELECT row_number() OVER (ORDER BY place, message)::INTEGER AS number, rule, message
    FROM (SELECT DISTINCT place, rule, message FROM ({rows}))"""


def report(table: str, names: list[str], numbers: list[str], texts: list[str], times: int = 0) -> str:
    """``(section, column, metric, value)`` as the library reports it."""
    empty = "NULL::VARCHAR"
    counts = [
        ("rows", "count(*)"), ("columns", str(len(names))), ("numeric", str(len(numbers))),
        ("categorical", str(len(texts))), ("datetime", str(times)),
    ]
    parts = [
        f"SELECT 'overview' AS section, {empty} AS \"column\", '{k}' AS metric, ({v})::DOUBLE AS value FROM {source(table)}"
        + (" LIMIT 1" if v.isdigit() else "")
        for k, v in counts
    ]
    parts = [f"SELECT * FROM ({p})" for p in parts]
    for k, v in (("duplicates", "duplicates"), ("duplicate_pct", "pct")):
        parts.append(f"SELECT 'overview', {empty}, '{k}', {v}::DOUBLE FROM ({duplicates(table, names)})")
    for k in ("missing", "missing_pct"):
        parts.append(f"SELECT 'missing', \"column\", '{k}', {k}::DOUBLE FROM ({missing(table, names)})")
    parts.append(f"SELECT 'variables', \"column\", 'distinct', \"distinct\"::DOUBLE FROM ({distinct(table, names)})")
    parts.append(f"SELECT 'statistics', \"column\", stat, value FROM ({stat_rows(table, numbers, STATS)})")
    parts += [
        f"SELECT 'histogram', \"column\", bin::VARCHAR, count::DOUBLE FROM ({histogram(table, n)})" for n in numbers
    ]
    if texts:
        parts.append(f"SELECT 'frequent', \"column\", value, count::DOUBLE FROM ({topn(table, texts)})")
    lower = pairs(numbers, lambda i, j: i > j)
    if lower:
        parts.append(f"SELECT 'correlation', feature_1, feature_2, r FROM ({corr_rows(table, lower)})")
    return f'SELECT section, "column", metric, {stable("value")}::DOUBLE AS value FROM ({union(parts)})'


def uplift() -> str:
    pct = "CAST(round({} * 100, 0) AS BIGINT)::VARCHAR"
    sign = "CASE WHEN CAST(round(lift * 100, 0) AS BIGINT) >= 0 THEN '+' ELSE '' END"
    sure = (
        f"geo || ' uplift ' || {sign} || {pct.format('lift')} || '% (95% CI: ' || {pct.format('ci_low')} || '%–' || "
        f"{pct.format('ci_high')} || '%), statistically significant'"
    )
    unsure = "geo || ' uplift not significant' || CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN ', CI includes 0' ELSE '' END"
    return f"""SELECT geo, {stable('lift')}::DOUBLE AS lift, significant,
      CASE WHEN significant AND lift > 0 THEN 'increase' ELSE 'reassess' END AS recommendation,
      CASE WHEN significant THEN {sure} ELSE {unsure} END AS message
    FROM (SELECT geo, treatment / control - 1 AS lift, ci_low, ci_high,
                 p_value < 0.05 AND NOT (ci_low <= 0 AND ci_high >= 0) AS significant FROM {source('experiment')})"""


def cells(step: str, sql: str, keys: list[str], metrics: list[str]) -> str:
    """``(step, key, metric, value)`` of a table; without metrics one row per row."""
    key = "concat_ws('|', " + ", ".join(f"coalesce(({k})::VARCHAR, '')" for k in keys) + ")" if keys else "''"
    values = {m.strip('"'): stable(f"{m}::DOUBLE") for m in metrics} or {"rows": "1"}
    return union(
        f"SELECT '{step}' AS step, {key} AS key, '{m}' AS metric, {v}::DOUBLE AS value FROM ({sql})" for m, v in values.items()
    )


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high", "fliers"]
DATE_RANGE = """SELECT 'ts' AS "column", min(ts) AS first, max(ts) AS last,
            date_diff('microsecond', min(ts), max(ts)) // 1000000 AS seconds FROM events"""


def target_cells(table: str, target: str, names: list[str]) -> str:
    return union(
        [
            cells("target_distribution", f"SELECT stat, value FROM ({stat_rows(table, [target], DESCRIBE)})", ["stat"], ["value"]),
            cells("target_histogram", histogram(table, target), ["bin"], ["lower", "upper", "count"]),
            cells("target_box", box(table, target), ['"column"'], BOX),
            cells("target_correlation", correlation_with(table, target, names, 10), ["feature"], ["abs_r"]),
            cells("scatter_grid", scatter(table, target, names, 50), ["feature", "x_bin", "y_bin"], ["x_low", "y_low", "count"]),
        ]
    )


def scatter_points(table: str, target: str, names: list[str], key: list[str], points: int) -> str:
    top = f"(SELECT feature FROM ({correlation_with(table, target, names, 4)}))"
    draw = " || ':' || ".join(["'points-1'", *[f"{k}::VARCHAR" for k in key]])
    rows = union(
        f"SELECT '{n}' AS feature, {n}::DOUBLE AS x, {target}::DOUBLE AS y, md5({draw}) AS draw FROM {source(table)} "
        f"WHERE {n} IS NOT NULL AND {target} IS NOT NULL"
        for n in names
    )
    return (
        f"SELECT feature, x, y FROM ({rows}) WHERE feature IN {top} "
        f"QUALIFY row_number() OVER (PARTITION BY feature ORDER BY draw, x, y) <= {points}"
    )


def info_rows(table: str, columns: list[tuple[str, str, str]]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{column_class(t)}' AS class, count(*) AS rows,
        count(*) - count({c}) AS missing,
        {stable(f'((count(*) - count({c})) * 100.0 / count(*))')}::DOUBLE AS missing_pct,
        count(DISTINCT {c}) AS "distinct", {size}::BIGINT AS bytes FROM {source(table)}"""
        for c, t, size in columns
    )


def complete() -> str:
    """The cells of the ten steps over ``events`` (target ``value``)."""
    numbers, texts, column = ["event_id", "user_id", "value"], ["event_type", "props"], ['"column"']
    sizes = [(c, t, f"sum(strlen({c}))" if t == "string" else f"(count({c}) * 8)") for c, t in EVENTS.items()]
    pattern = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in EVENTS) + ")"
    insights = [
        skewed("events", numbers),
        cardinality("events", texts),
        dates("events", texts),
        f"SELECT 'ratio_features' AS rule, '{RATIO}' AS message",
        f"SELECT 'polynomial_features' AS rule, '{POLY}' AS message",
    ]
    listed = """chr(39) || string_agg("column", chr(39) || ', ' || chr(39)) || chr(39)"""
    issues = [
        "SELECT 'duplicate_rows' AS rule, 'Remove ' || duplicates || ' duplicate rows' AS message "
        f"FROM ({duplicates('events', list(EVENTS))}) WHERE duplicates > 0",
        f"SELECT 'constant_columns' AS rule, 'Consider removing constant columns: [' || {listed} || ']' AS message "
        f"FROM ({constants('events', list(EVENTS))}) HAVING count(*) > 0",
        gaps("events", list(EVENTS)),
        mixed("events", texts),
    ]
    span = [f"strftime({k}, '%Y-%m-%d %H:%M:%S')" for k in ("first", "last")]
    info = ["rows", "missing", "missing_pct", '"distinct"', "bytes"]
    gappy = f"SELECT * FROM ({missing('events', list(EVENTS))}) WHERE missing > 0"
    strong = f"SELECT * FROM ({corr_rows('events', pairs(numbers, lambda i, j: i < j))}) WHERE abs(r) > 0.7"
    days = "(isodow(ts) - 1)"
    return union(
        [
            cells("basic_info", info_rows("events", sizes), [*column, "dtype", "class"], info),
            cells("statistical_summary", stat_rows("events", numbers, STATS), [*column, "stat"], ["value"]),
            cells("missing_nonzero", gappy, column, ["missing"]),
            cells("null_pattern", f"SELECT {pattern} AS p, count(*) AS rows FROM events GROUP BY 1", ["p"], ["rows"]),
            cells(
                "histogram_density",
                union(histogram("events", n) for n in numbers),
                [*column, "bin"],
                ["lower", "upper", "count", "density"],
            ),
            *[cells("kde", kde("events", n, 1000, None), [*column, "point"], ["x", "density"]) for n in numbers],
            cells("value_counts_topn", topn("events", texts), [*column, "value"], ["count"]),
            cells("correlation_matrix", corr_rows("events", pairs(numbers)), ["feature_1", "feature_2"], ["r"]),
            cells("high_correlations", strong, ["feature_1", "feature_2"], ["r"]),
            cells("outlier_detection", outliers("events", numbers), column, ["outliers", "outlier_pct"]),
            cells("box_stats", union(box("events", n) for n in numbers), column, BOX),
            cells("feature_insights", numbered(insights), ["number", "rule", "message"], []),
            cells("quality_issues", numbered(issues), ["number", "rule", "message"], []),
            cells("date_range", DATE_RANGE, [*column, *span], ["seconds"]),
            cells("daily_counts", calendar_counts("events", "ts", "day", "ts::DATE"), [*column, "day"], ["rows"]),
            cells("monthly_pattern", calendar_counts("events", "ts", "month", "month(ts)"), [*column, "month"], ["rows"]),
            cells("weekday_pattern", calendar_counts("events", "ts", "dayofweek", days), [*column, "dayofweek"], ["rows"]),
            cells("hourly_pattern", calendar_counts("events", "ts", "hour", "hour(ts)"), [*column, "hour"], ["rows"]),
            target_cells("events", "value", ["event_id", "user_id"]),
        ]
    )


def oracle_sql() -> dict[str, str]:
    labelled = ["n_chars", "quality", "toxic"]
    messy = ["c_custkey", "c_mktsegment", "same", "nothing", "code"]
    gap = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal"
    csv = f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {gap}, c_mktsegment FROM customer"
    whole = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
    blocks = 50
    upper = [(a, b) for a, b in pairs(PRICED, lambda i, j: i < j)]
    report_columns = [*PRICED_KEY, *PRICED]
    order_numbers, order_texts = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    share = "SELECT o_orderstatus AS value, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(o_orderstatus) FROM orders) AS pct FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1"
    n_customers = "(SELECT count(*) FROM customer)"
    return {
        "read_csv": csv,
        "read_excel": csv,
        "read_csv_breaks": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "read_json": whole,
        "read_json_forms": whole,
        "read_parquet": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000",
        "read_sqlite_table": whole,
        "read_sqlite_query": SQL_TEXTS["sql_left_join_agg"],
        "explore_database": union(
            [schema_rows("customer", CUSTOMER), schema_rows("orders", ORDERS), schema_rows("nation", NATION)]
        ),
        "explore_sample": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3",
        "load_auto": "SELECT * FROM supplier",
        "write_table": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice FROM orders",
        "write_report": missing("labelled", LABELLED),
        "select_columns": "SELECT l_orderkey, l_quantity FROM lineitem",
        "filter_predicate": "SELECT * FROM lineitem WHERE l_quantity < 3 OR l_extendedprice > 100000",
        "filter_result": f"SELECT * FROM ({missing('labelled', LABELLED)}) WHERE missing > 0",
        "drop_nulls": f"SELECT * FROM {source('labelled')} WHERE quality IS NOT NULL",
        "head": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
        "sort_values": corr_rows("priced", pairs(PRICED)) + " ORDER BY abs(r) DESC, feature_1, feature_2",
        "scalar_functions": f"""SELECT o_orderkey, o_orderstatus IS NULL AS is_missing,
            TRY_CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS as_number, o_custkey::VARCHAR AS as_text,
            trunc(o_totalprice)::BIGINT AS whole, length(o_orderpriority)::INTEGER AS chars,
            regexp_matches(o_orderpriority, '[-/:]') AS separated, {stable('abs(o_totalprice - 100000)')}::DOUBLE AS distance,
            year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day,
            (isodow(o_orderdate) - 1)::INTEGER AS weekday, hour(o_orderdate)::INTEGER AS hour, o_orderdate::DATE AS date,
            o_orderdate + INTERVAL 30 DAY AS later,
            {stable('((o_totalprice - 10) * 100 / (o_totalprice + 10))')}::DOUBLE AS share FROM orders""",
        "add_columns": f"""SELECT l_orderkey, l_linenumber, {stable('(l_extendedprice * (1 - l_discount))')}::DOUBLE AS revenue,
            year(l_shipdate)::INTEGER AS year FROM lineitem""",
        **SQL_TEXTS,
        "column_types": union(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{column_class(t)}' AS class" for c, t in EVENTS.items()
        ),
        "class_counts": "SELECT class, count(*) AS columns FROM ("
        + union(f"SELECT '{column_class(t)}' AS class" for t in EVENTS.values())
        + ") GROUP BY class",
        "shape": "SELECT count(*) AS rows, 11::BIGINT AS columns FROM lineitem",
        "column_footprint": union(
            f'SELECT \'{c}\' AS "column", {sql}::BIGINT AS bytes FROM {source("labelled")}'
            for c, sql in {
                "doc_id": "count(doc_id) * 8",
                "lang": "sum(strlen(lang))",
                "source": "sum(strlen(source))",
                "n_chars": "count(n_chars) * 8",
                "quality": "count(quality) * 4",
                "toxic": "count(toxic) * 4",
            }.items()
        ),
        "missing_summary": missing("labelled", LABELLED),
        "missing_nonzero": f'SELECT "column", missing FROM ({missing("labelled", LABELLED)}) WHERE missing > 0',
        "distinct_counts": distinct("lineitem", LINEITEM),
        "describe": stat_rows("priced", PRICED, DESCRIBE),
        "skewness": one_stat("labelled", labelled, "skewness"),
        "kurtosis": one_stat("labelled", labelled, "kurtosis"),
        "variance": one_stat("lineitem", LINEITEM_NUMBERS, "variance"),
        "quantiles": quantile_rows("lineitem", LINEITEM_NUMBERS, [0.01, 0.1, 0.5, 0.9, 0.99]),
        "statistical_summary": stat_rows("lineitem", LINEITEM_NUMBERS, STATS),
        "null_pattern": "SELECT concat_ws(',', "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in LABELLED)
        + f") AS missing_columns, count(*) AS rows FROM {source('labelled')} GROUP BY 1",
        "null_blocks": union(
            f"""SELECT least(floor((doc_id::DOUBLE - lo) / (hi - lo) * {blocks}), {blocks - 1})::INTEGER AS block,
            '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing,
            {stable(f'((count(*) - count({c})) * 100.0 / count(*))')}::DOUBLE AS missing_pct
            FROM {source('labelled')} CROSS JOIN (SELECT min(doc_id)::DOUBLE AS lo, max(doc_id)::DOUBLE AS hi FROM documents)
            GROUP BY 1"""
            for c in LABELLED[1:]
        ),
        "histogram_density": f"""SELECT "column", bin, {stable('lower')}::DOUBLE AS lower, {stable('upper')}::DOUBLE AS upper,
            count, {stable('density')}::DOUBLE AS density FROM ({union(histogram('lineitem', n) for n in LINEITEM_NUMBERS)})""",
        "histogram_count": f"""SELECT bin, {stable('lower')}::DOUBLE AS lower, {stable('upper')}::DOUBLE AS upper, count
            FROM ({histogram('events', 'value')})""",
        "kde": rounded_kde(None),
        "kde_binned": rounded_kde(4096),
        "value_counts_topn": topn("documents", ["lang", "source", "text"]),
        "value_counts": "SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
        "proportions": f"SELECT value, count, {stable('pct')}::DOUBLE AS pct FROM ({share})",
        "box_stats": union([box("events", "value"), box("documents", "n_chars")]),
        "scatter_points": scatter_points("priced", "revenue", [c for c in PRICED if c != "revenue"], PRICED_KEY, 200),
        "scatter_grid": scatter("priced", "revenue", [c for c in PRICED if c != "revenue"], 20),
        "correlation_matrix": corr_rows("priced", pairs(PRICED)),
        "correlation_uneven": corr_rows("uneven_finite", pairs(UNEVEN)),
        "high_correlations": f"SELECT * FROM ({corr_rows('priced', upper)}) WHERE abs(r) > 0.7",
        "correlation_lower_triangle": corr_rows("lineitem", pairs(LINEITEM_NUMBERS, lambda i, j: i > j)),
        "outlier_detection": outliers("events", ["event_id", "user_id", "value"]),
        "outlier_rows": f"SELECT event_id, value FROM events CROSS JOIN {fences('events', 'value')} f WHERE value < lower OR value > upper",
        "target_distribution": f"SELECT stat, value FROM ({stat_rows('lineitem', ['l_extendedprice'], DESCRIBE)})",
        "target_distribution_categorical": "SELECT o_orderstatus AS value, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1",
        "target_correlation": correlation_with("priced", "revenue", [*PRICED_KEY, *PRICED[:3]], 10),
        "target_top_features": correlation_with("priced", "revenue", [*PRICED_KEY, *PRICED[:3]], 4),
        "highly_skewed": skewed("labelled", ["doc_id", "n_chars", "quality", "toxic"]),
        "high_cardinality": cardinality("documents", ["text", "lang", "source"]),
        "date_candidates": dates("dated", ["o_orderstatus", "o_orderpriority", "day_text"]),
        "date_candidates_full": dates("dated", ["o_orderstatus", "o_orderpriority", "day_text"]),
        "feature_insights": numbered(
            [
                skewed("dated", ["o_orderkey"]),
                cardinality("dated", ["o_orderstatus", "o_orderpriority", "day_text"]),
                dates("dated", ["o_orderstatus", "o_orderpriority", "day_text"]),
            ]
        ),
        "duplicate_rows": f"SELECT duplicates, {stable('pct')}::DOUBLE AS duplicate_pct FROM ({duplicates('documents', ['text'])})",
        "duplicate_rows_nested": f"SELECT duplicates, {stable('pct')}::DOUBLE AS duplicate_pct FROM ({duplicates('embeddings', ['embedding'])})",
        "duplicate_rows_whole": f"SELECT duplicates, {stable('pct')}::DOUBLE AS duplicate_pct FROM ({duplicates('messy', messy)})",
        "constant_columns": constants("messy", messy),
        "high_missing": gaps("labelled", LABELLED),
        "mixed_types": mixed("messy", ["c_mktsegment", "same", "code"]),
        "mixed_types_full": mixed("messy", ["c_mktsegment", "same", "code"]),
        "quality_issues": numbered(
            [
                "SELECT 'duplicate_rows' AS rule, 'Remove ' || duplicates || ' duplicate rows' AS message "
                f"FROM ({duplicates('messy', messy)}) WHERE duplicates > 0",
                "SELECT 'constant_columns' AS rule, 'Consider removing constant columns: [''same'', ''nothing'']' AS message "
                f"FROM (SELECT count(*) AS n FROM ({constants('messy', messy)})) WHERE n = 2",
                gaps("messy", messy),
                mixed("messy", ["c_mktsegment", "same", "code"]),
            ]
        ),
        "date_range": DATE_RANGE,
        "calendar_features": """SELECT event_id, ts, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month,
            day(ts)::INTEGER AS ts_day, (isodow(ts) - 1)::INTEGER AS ts_dayofweek, hour(ts)::INTEGER AS ts_hour FROM events""",
        "daily_counts": calendar_counts("events", "ts", "day", "ts::DATE"),
        "monthly_pattern": calendar_counts("lineitem", "l_shipdate", "month", "month(l_shipdate)::INTEGER"),
        "weekday_pattern": calendar_counts("orders", "o_orderdate", "dayofweek", "(isodow(o_orderdate) - 1)::INTEGER"),
        "hourly_pattern": calendar_counts("events", "ts", "hour", "hour(ts)::INTEGER"),
        "basic_info": info_rows(
            "labelled",
            [
                ("doc_id", "bigint", "(count(doc_id) * 8)"),
                ("lang", "string", "sum(strlen(lang))"),
                ("source", "string", "sum(strlen(source))"),
                ("n_chars", "bigint", "(count(n_chars) * 8)"),
                ("quality", "int", "(count(quality) * 4)"),
                ("toxic", "int", "(count(toxic) * 4)"),
            ],
        ),
        "target_analysis": target_cells("priced", "revenue", [*PRICED_KEY, *PRICED[:3]]),
        "complete_analysis": complete(),
        "profile_report": report("events", list(EVENTS), ["event_id", "user_id", "value"], ["event_type", "props"], 1),
        "profile_report_numbers": report("priced", report_columns, report_columns, []),
        "target_report": union(
            [
                f"SELECT * FROM ({report('orders', list(ORDERS), order_numbers, order_texts, 1)})",
                f"SELECT 'target' AS section, 'o_orderstatus' AS \"column\", value AS metric, {stable('pct')}::DOUBLE AS value FROM ({share})",
            ]
        ),
        "uplift_summary": uplift(),
        "gen_sample": f"""SELECT n AS rows, n AS ages, n AS incomes, n AS scores, n AS categories, n AS ratings,
            TIMESTAMP '2020-01-01' AS first_day, TIMESTAMP '2023-12-31' AS last_day,
            true AS age_mean_fits, true AS income_mean_fits, true AS score_mean_fits FROM (SELECT {n_customers} AS n)""",
        "inject_nulls": f"""SELECT n AS rows, floor(n * 0.1::DOUBLE)::BIGINT AS income_gaps,
            floor(n * 0.05::DOUBLE)::BIGINT AS score_gaps FROM (SELECT {n_customers} AS n)""",
        "inject_outliers": f"SELECT n AS rows, floor(n * 0.02::DOUBLE)::BIGINT AS outliers FROM (SELECT {n_customers} AS n)",
        "gen_customers": f"""SELECT n AS rows, n AS keys, 0::BIGINT AS first_key, n - 1 AS last_key,
            n - floor(n * 0.1::DOUBLE)::BIGINT AS incomes FROM (SELECT {n_customers} AS n)""",
        "gen_transactions": f"""SELECT {n_customers} AS customers, true AS counts_fit, true AS amounts_fit,
            true AS mean_fits""",
    }


