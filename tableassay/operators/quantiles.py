"""Exact and approximate quantiles with memory that does not grow with the data.

The built-in ``percentile`` keeps every distinct value of a column in one
task.  The exact form here narrows instead:

1. one scan builds a mergeable sketch per column; a range of values around each
   wanted rank comes back to the driver (a few hundred numbers per column); a
   frequent value at the end of a range becomes a range of its own, counted as
   one number however many rows hold it;
2. while a range still holds too many rows for one task, a further scan
   sketches the values inside it and makes it about fifty times smaller;
3. a last scan counts rows between the ranges and, inside them only, per value,
   and the order statistics are read off the running count.

The sketches only decide which values are counted one by one; ranks are counted
exactly.  A rank outside its range (over eight standard errors away) raises an
error and never yields a wrong number.  Nothing but sketches and the values of
the last ranges is shuffled, whatever the distribution.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import ceil, floor, inf, nextafter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.functions.schema import as_double, empty, has_value, number, text, texts, union_all

SKETCH_SIZE = 4096  # standard error of a rank about 0.05 %
RANK_MARGIN = 0.004  # added to either side of a rank read off a sketch
GRID = 200  # steps of rank at which a sketch is read
SMALL = 2000  # a range with at most this many rows is not narrowed
ORDERED_ROWS = 2_000_000  # most rows of one column in the last ranges
MERGE_GROUPS = 64  # first merge level, so no task merges all sketches
COLUMNS_PER_PLAN = 64  # wide tables are split so that a plan stays small

RESULT = "column string, prob double, value double"


class Bracket(NamedTuple):
    """Values of one column: how many, and per prob the range that holds its rank."""

    n: int
    ends: list[tuple[float, float]]
    rows: list[float]  # about how many rows each range holds
    points: set[float] | frozenset[float] = frozenset()  # frequent values cut off from the ranges
    values: dict[float, float] | None = None  # the quantiles themselves, where they are known

    def closed(self) -> list[tuple[float, float]]:
        """The ranges and the points as disjoint closed ranges, ascending."""
        out: list[tuple[float, float]] = []
        for lo, hi in sorted([*self.ends, *((p, p) for p in self.points)]):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out


Ranges = dict[str, Bracket]


def _merged(df: DataFrame, sketched: list[str], counted: list[str] = ()) -> DataFrame:
    """One row: sketches ``s0..`` of the values and sums ``c0..`` of the counts, merged in two levels."""
    partial = df.groupBy(F.expr(f"spark_partition_id() % {MERGE_GROUPS}")).agg(
        *[F.expr(f"kll_sketch_agg_double({v}, {SKETCH_SIZE}) AS s{i}") for i, v in enumerate(sketched)],
        *[F.expr(f"{c} AS c{i}") for i, c in enumerate(counted)],
    )
    return partial.agg(
        *[F.expr(f"kll_merge_agg_double(s{i}, {SKETCH_SIZE}) AS s{i}") for i in range(len(sketched))],
        *[F.expr(f"sum(c{i}) AS c{i}") for i in range(len(counted))],
    )


def _at(sketch: str, rank: float) -> str:
    """Quantile of a sketch; NULL when it holds no value."""
    return f"IF(kll_sketch_get_n_double({sketch}) > 0, kll_sketch_get_quantile_double({sketch}, {number(rank)}), NULL)"


def approx_quantiles(df: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    """``(column, prob, value)`` from the sketches alone: one scan."""
    if not names:
        return empty(df, RESULT)
    entries = [
        f"named_struct('column', {text(n)}, 'prob', {number(p)}, 'value', {_at(f's{i}', p)})"
        for i, n in enumerate(names)
        for p in probs
    ]
    merged = _merged(df, [as_double(df, n) for n in names])
    return merged.selectExpr(f"inline(array({', '.join(entries)}))")


Range = tuple[float, float] | None  # None: the whole column


def _read(df: DataFrame, pieces: list[tuple[str, Range]]) -> dict[tuple[str, Range], tuple[int, int, list[float]]]:
    """Per range: rows inside, rows below, and its values at every step of rank.

    A few hundred numbers per range come back, in jobs of a bounded number of ranges.
    """
    if len(pieces) > COLUMNS_PER_PLAN:
        parts = [pieces[i : i + COLUMNS_PER_PLAN] for i in range(0, len(pieces), COLUMNS_PER_PLAN)]
        return {k: v for part in parts for k, v in _read(df, part).items()}
    inside, below = [], []
    for name, ends in pieces:
        v = as_double(df, name)
        if ends is None:
            inside.append(v)
            below.append("count_if(false)")
        else:
            lo, hi = number(ends[0]), number(ends[1])
            inside.append(f"IF({v} >= {lo} AND {v} <= {hi}, {v}, NULL)")
            below.append(f"count_if({v} < {lo})")
    steps = "array({})".format(", ".join(number(i / GRID) for i in range(GRID + 1)))
    row = (
        _merged(df, inside, below)
        .selectExpr(
            *[
                f"named_struct('n', kll_sketch_get_n_double(s{i}), 'below', c{i}, 'at', "
                f"IF(kll_sketch_get_n_double(s{i}) > 0, kll_sketch_get_quantile_double(s{i}, {steps}), NULL)) AS r{i}"
                for i in range(len(pieces))
            ]
        )
        .first()
    )
    return {piece: (r["n"], r["below"], r["at"]) for piece, r in zip(pieces, row)}


def _narrowed(n_inside: int, below: int, at: list[float], rank: int) -> tuple[tuple[float, float], float, list[float]]:
    """The part of a range that holds a rank and the next, about how many rows it
    holds, and the frequent values cut off from its ends."""
    if n_inside <= SMALL:
        return (at[0], at[-1]), n_inside, []
    low = floor((max((rank - below) / n_inside - RANK_MARGIN, 0.0)) * GRID)
    high = ceil((min((rank + 1 - below) / n_inside + RANK_MARGIN, 1.0)) * GRID)
    low, high = max(min(low, GRID), 0), max(min(high, GRID), 0)
    lo, hi = at[low], at[high]
    if lo == hi:
        return (lo, hi), 1, []  # one value, however many rows
    points = []
    if at[low + 1] == lo:
        points.append(lo)
        low = bisect_right(at, lo) - 1
        lo = nextafter(lo, inf)
    if at[high - 1] == hi:
        points.append(hi)
        high = bisect_left(at, hi)
        hi = nextafter(hi, -inf)
    if lo > hi:
        return (points[0], points[0]), 1, points
    return (lo, hi), n_inside * max(high - low, 1) / GRID, points


def brackets(df: DataFrame, names: list[str], probs: list[float]) -> Ranges:
    """A bracket per column that holds any value, narrow enough to be put in order.

    Runs one job, on very large tables a second and a third.
    """
    probs = sorted(float(p) for p in probs)
    out: Ranges = {}
    read = _read(df, [(n, None) for n in names])
    for name in names:
        n, _, at = read[name, None]
        if n:
            found = [_narrowed(n, 0, at, floor((n - 1) * p)) for p in probs]
            out[name] = Bracket(n, [e for e, _, _ in found], [r for _, r, _ in found], {p for _, _, ps in found for p in ps})
    while True:
        wide = [
            (name, j)
            for name, b in out.items()
            if sum(b.rows) > ORDERED_ROWS
            for j, rows in enumerate(b.rows)
            if rows > SMALL
        ]
        if not wide:
            return out
        read = _read(df, list(dict.fromkeys((name, out[name].ends[j]) for name, j in wide)))
        progress = False
        for name, j in wide:
            b = out[name]
            n_inside, below, at = read[name, b.ends[j]]
            # no row between two frequent values: both orders stand on them
            ends, rows, points = _narrowed(n_inside, below, at, floor((b.n - 1) * probs[j])) if n_inside else (b.ends[j], 0, [])
            progress |= rows < b.rows[j]
            b.ends[j], b.rows[j] = ends, rows
            b.points.update(points)
        if not progress:
            return out


def _zone(ranges: list[tuple[float, float]]) -> str:
    """Zone of ``v``, ascending with the value: odd zones are ranges, even zones lie between."""
    cases = [
        f"WHEN v < {number(lo)} THEN {2 * j} WHEN v <= {number(hi)} THEN {2 * j + 1}"
        for j, (lo, hi) in enumerate(ranges)
    ]
    return f"CASE {' '.join(cases)} ELSE {2 * len(ranges)} END"


def _exact_sql(df: DataFrame, names: list[str], probs: list[float], ranges: Ranges) -> str:
    """The last scan as SQL over the view ``{source}``: ``(column, prob, value)``.

    Each column is read by its own branch: a column store reads it once, and
    the branch compiles to a plain filter and a hash aggregate.
    """
    names = [n for n in names if n in ranges]
    branches = [
        f"SELECT {i} AS idx, {_zone(ranges[n].closed())} AS zone, v "
        f"FROM (SELECT {as_double(df, n)} AS v FROM {{source}} WHERE {has_value(df, n)})"
        for i, n in enumerate(names)
    ]
    # the wanted ranks, low and high per prob, as literals per column position
    spots = [[(ranges[n].n - 1) * p for p in probs] for n in names]
    hits = []
    for t in range(2 * len(probs)):
        j, side = divmod(t, 2)
        ranks = ", ".join(f"{min(floor(spot[j]) + side, ranges[n].n - 1)}L" for n, spot in zip(names, spots))
        rank = f"get(array({ranks}), idx)"
        hits.append(f"max(IF(upto - n <= {rank} AND {rank} < upto, v, NULL)) AS t{t}")
    entries = []
    for j, p in enumerate(probs):
        share = "get(array({}), idx)".format(", ".join(number(s[j] - floor(s[j])) for s in spots))
        a, b = f"t{2 * j}", f"t{2 * j + 1}"
        value = (
            f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(raise_error('rank outside its range') AS DOUBLE) "
            f"WHEN {a} = {b} THEN {a} ELSE {a} + ({b} - {a}) * {share} END"
        )
        entries.append(f"named_struct('prob', {number(p)}, 'value', {value})")
    # a window takes the ranges of one column, about ORDERED_ROWS rows at most
    return f"""
    SELECT get({texts(names)}, idx) AS column, inline(array({', '.join(entries)}))
    FROM (
      SELECT idx, {', '.join(hits)}
      FROM (
        SELECT idx, v, n, sum(n) OVER (PARTITION BY idx ORDER BY zone, v) AS upto
        FROM (
          SELECT idx, zone, IF(zone % 2 = 1, v, NULL) AS v, count(*) AS n
          FROM ({' UNION ALL '.join(branches)}) GROUP BY 1, 2, 3
        )
      ) GROUP BY idx
    )"""


def exact_quantiles(df: DataFrame, names: list[str], probs: list[float], ranges: Ranges | None = None) -> DataFrame:
    """``(column, prob, value)`` with linear interpolation between order statistics."""
    if not names:
        return empty(df, RESULT)
    known = [n for n in names if ranges and n in ranges and ranges[n].values and set(probs) <= set(ranges[n].values)]
    if known:
        rows = ", ".join(f"({text(n)}, {number(p)}, {number(ranges[n].values[p])})" for n in known for p in probs)
        rows = rows.replace("{", "{{").replace("}", "}}")
        found = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS s(column, prob, value)")
        rest = [n for n in names if n not in known]
        return found.unionByName(exact_quantiles(df, rest, probs, ranges)) if rest else found
    if len(names) > COLUMNS_PER_PLAN:
        parts = [names[i : i + COLUMNS_PER_PLAN] for i in range(0, len(names), COLUMNS_PER_PLAN)]
        return union_all([exact_quantiles(df, part, probs, ranges) for part in parts])
    probs = sorted(float(p) for p in probs)
    if ranges is None:
        ranges = brackets(df, names, probs)
    parts = []
    if any(n in ranges for n in names):
        # braces of column names must survive the view substitution
        found = _exact_sql(df, names, probs, ranges).replace("{source}", "\0")
        parts.append(found.replace("{", "{{").replace("}", "}}").replace("\0", "{source}"))
    blank = ", ".join(f"({text(n)}, {number(p)})" for n in names if n not in ranges for p in probs)
    if blank:
        blank = blank.replace("{", "{{").replace("}", "}}")
        parts.append(f"SELECT column, prob, CAST(NULL AS DOUBLE) AS value FROM VALUES {blank} AS s(column, prob)")
    return df.sparkSession.sql(" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts), source=df)


def settled(df: DataFrame, probs: list[float], ranges: Ranges) -> Ranges:
    """The ranges with their quantiles, so that no later table scans for them again."""
    found: dict[str, dict[float, float]] = {}
    # one row per column and prob
    for r in exact_quantiles(df, list(ranges), probs, ranges).collect():
        found.setdefault(r["column"], {})[r["prob"]] = r["value"]
    return {n: b._replace(values=found[n]) for n, b in ranges.items()}


def quantiles(df: DataFrame, names: list[str], probs: list[float], exact: bool = True) -> DataFrame:
    return (exact_quantiles if exact else approx_quantiles)(df, names, probs)


QUARTERS = [0.25, 0.5, 0.75]
FENCE = 1.5  # interquartile ranges between a quartile and its fence


def quartiles(df: DataFrame, names: list[str], exact: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """``(column, q1, median, q3)``, one row per column."""
    rows = exact_quantiles(df, names, QUARTERS, ranges) if exact else approx_quantiles(df, names, QUARTERS)
    return rows.groupBy("column").agg(
        *[F.expr(f"max(IF(prob = {p}D, value, NULL)) AS {k}") for k, p in zip(("q1", "median", "q3"), QUARTERS)]
    )


def fences(df: DataFrame, names: list[str], exact: bool = True, ranges: Ranges | None = None):
    """Scalar array by column position: ``q1, median, q3, lower, upper``."""
    rows = quartiles(df, names, exact, ranges).selectExpr(
        f"array_position({texts(names)}, column) AS place",
        f"struct(q1, median, q3, q1 - {FENCE}D * (q3 - q1) AS lower, q3 + {FENCE}D * (q3 - q1) AS upper) AS f",
    )
    # one entry per column
    return rows.agg(F.expr("transform(array_sort(collect_list(struct(place, f))), e -> e.f) AS f")).scalar()
