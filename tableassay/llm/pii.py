"""Personal data: candidate spans, boosted trees over their format and context.

Built of DataFrame functions only.

Format rules give the base spans (email, ip, card, phone). High-recall generators
propose further spans, overlapping ones among them. Each candidate has a few
categorical features of its format: generator, number of digits, separators, clean
edges, a checksum. What teaches is its context alone: a cue word before it ("call",
"mail", ...). Not every personal span has a cue, so the share of cues says how likely
a format is personal only beside the share among spans known to be personal: the
candidates that base spans cover, whose formats are those of base spans without what
the base rules ask for (the plus sign of a phone number, say). Boosting needs the data
only through its counts per combination of features, at most ``CELLS`` of them, so the
counts of all documents are one aggregate and the trees are fitted to them exactly as
they would be to all rows. A score is the boosted share of cues over that known share,
1 at most. A generator without ``KNOWN`` covered candidates takes the greatest share of
the others; where no generator has as many, nothing is added.

Documents with crc32(doc_id) mod 5 = 0 calibrate: per generator the lowest score from
which on the estimated share of personal candidates is ``PRECISION`` is the threshold.

Time grows in proportion to the length of a text and the number of its matches (but
for sorting): ``_scan`` appends to parts of bounded size.

Defined cases: a null text is empty and has no spans; repeated rows count again;
without candidates the base spans alone are returned; an empty table gives no rows;
texts of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableassay.llm.shared import fold, staged

KINDS = ("email", "ip", "card", "phone")
#: The base formats. Possessive forms of the same patterns: what follows a repeated
#: part is never in it. A run that fails at its start fails inside it too, so a match
#: starts at a run's start or where the last match ended.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
GENERATORS = (
    ("digits", r"(?<![0-9])[0-9](?:[\x20().\x2F-]{0,2}+[0-9]){6,}+"),
    ("plusless", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("address", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,}+"),
    ("colons", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+"),
)
CUES = r"(?i)(?:phone|call|tel|mobile|fax|mail|contact|card|visa|account|ssn|ip|address|host)[^A-Za-z]{0,12}$"
CUE_REACH = 24
PRECISION = 0.9
KNOWN = 30
ROUNDS, RATE = 24, 0.5
#: generator, digits, separators, left edge, right edge, check: the values of each.
SHAPE = (4, 8, 6, 2, 2, 2)
CELLS = math.prod(SHAPE)
CALIBRATION = (5, 0)
PART = 64


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _scan(items: Column, first: Column, step, kind: str) -> Column:
    """What ``step`` of (state, item) gives as second part, for all items in order.

    ``items`` are at least one. ``aggregate`` copies its state at every step, so items go
    in parts of ``PART``: states at the beginnings of parts first, then each part's list."""
    none = F.array().cast(f"array<{kind}>")
    last = F.size(items) - 1
    firsts = F.sequence(F.lit(0), last, F.lit(PART))

    def chunk(i: Column) -> Column:
        return F.transform(F.sequence(i, F.least(i + (PART - 1), last)), lambda j: F.get(items, j))

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def after(states: Column, i: Column) -> Column:
        return F.concat(states, F.array(F.aggregate(chunk(i), F.element_at(states, -1), lambda state, x: step(state, x)[0])))

    def part(states: Column) -> Column:
        return F.transform(firsts, lambda i: F.aggregate(chunk(i), F.struct(F.get(states, (i / PART).cast("int")).alias("state"), none.alias("out")), one)["out"])

    return F.flatten(_with(F.aggregate(firsts, F.array(first), after), part))


def _found(text: Column, pattern: str, *needs: str) -> Column:
    """array<struct<start,end,value,before,after>> of leftmost non-overlapping matches, code points.

    ``before`` are the last ``CUE_REACH`` characters between the beginning of the match
    before and this one, ``after`` is the next character."""
    kind = "struct<start:int,end:int,value:string,before:string,after:string>"
    there = F.lit(True)
    for sign in needs:
        there = there & (F.contains(text, F.lit(sign)) if len(sign) == 1 else text.rlike(sign))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["value"])
        return end, F.struct(start.alias("start"), end.alias("end"), *[x[c].alias(c) for c in ("value", "before", "after")])

    def around(p: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            gap = F.get(p["gaps"], i)
            before = F.concat(F.coalesce(F.get(p["matches"], i - 1), F.lit("")), gap)
            after = F.concat(F.get(p["gaps"], i + 1), F.coalesce(F.get(p["matches"], i + 1), F.lit("")))
            return F.struct(gap.alias("gap"), value.alias("value"), F.substring(before, -CUE_REACH, CUE_REACH).alias("before"), F.substring(after, 1, 1).alias("after"))

        return F.transform(p["matches"], one)

    none = F.array().cast(f"array<{kind}>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    spans = _with(both, lambda p: F.when(F.size(p["matches"]) > 0, _with(around(p), lambda items: _scan(items, F.lit(0), step, kind))).otherwise(none))
    return F.when(there, spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def part(i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(places, part), F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(value: Column) -> Column:
    def small(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, "\\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the format rules, in order."""
    n = lambda v: F.length(_digits(v))
    rules = (
        _found(text, BASE[0], "@"),
        F.filter(_found(text, BASE[1], ".", r"[0-9]\.[0-9]"), lambda x: _octets(x["value"])),
        F.filter(_found(text, BASE[2], r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda x: n(x["value"]).between(14, 19) & _luhn(x["value"])),
        F.filter(_found(text, BASE[3], "+"), lambda x: n(x["value"]).between(10, 15)),
    )

    def of_kind(k: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))

    return F.array_sort(F.concat(*[F.transform(r, of_kind(k)) for k, r in enumerate(rules)]))


def _coded(generator: int):
    """A candidate with the number of its combination of features, and whether a cue is before it."""

    def coded(x: Column) -> Column:
        value = x["value"]
        digits = F.length(_digits(value))
        grade = sum(F.when(digits >= b, 1).otherwise(0) for b in (1, 7, 9, 10, 11, 14, 20))
        signs = F.filter(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), "")), lambda s: s != "")
        sign = F.when(F.size(signs) == 1, signs[0]).otherwise(F.lit(""))
        sep = F.when(F.size(signs) == 0, 0).when(sign == " ", 1).when(sign == "-", 2).when(sign == ".", 3).when(sign == ":", 4).otherwise(5)
        left = F.substring(x["before"], -1, 1).rlike("[A-Za-z0-9]")
        right = x["after"].rlike("[A-Za-z0-9]")
        if GENERATORS[generator][0] == "colons":
            check = F.size(F.split(value, ":")) == 8
        else:
            check = F.when(digits.between(1, 19), _luhn(value)).otherwise(F.lit(False))
        fields = (F.lit(generator), grade, sep, left.cast("int"), right.cast("int"), check.cast("int"))
        code = F.lit(0)
        for size, field in zip(SHAPE, fields, strict=True):
            code = code * size + field
        return F.struct(x["start"].alias("start"), F.lit(generator).alias("generator"), x["end"].alias("end"), code.cast("int").alias("code"), x["before"].rlike(CUES).alias("cue"))

    return coded


#: What a text must hold for a generator to find anything.
HINTS = (
    (r"[0-9][\x20().\x2F-]{0,2}[0-9]",),
    (r"[0-9]{3}\)?[\x20.-][0-9]{3}",),
    (r"@|(?i)\(at\)|\[at\]|\x20at\x20", r"(?i)@|\(dot\)|\[dot\]|\x20dot\x20"),
    (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",),
)


def candidates(text: Column) -> Column:
    """array<struct<start,generator,end,code,cue>> of all generators."""
    return F.concat(*[F.transform(_found(text, pattern, *needs), _coded(g)) for g, ((_, pattern), needs) in enumerate(zip(GENERATORS, HINTS, strict=True))])


def _beside(base: Column, more: Column) -> Column:
    """``more`` with ``known`` (four fifths covered by a base span, the one that begins no
    later and reaches furthest or the next that begins later) and ``touches`` (overlaps any)."""
    kind = "struct<start:int,role:int,end:int,generator:int,code:int,cue:boolean,reach:int>"
    last = kind.replace(">", ",known:boolean,touches:boolean>")

    def item(role: int):
        def one(x: Column) -> Column:
            rest = (x["generator"], x["code"], x["cue"]) if role else (F.lit(-1), F.lit(-1), F.lit(False))
            return F.struct(x["start"].alias("start"), F.lit(role).alias("role"), x["end"].alias("end"), *[c.alias(n) for c, n in zip(rest, ("generator", "code", "cue"), strict=True)])

        return one

    def forth(reach: Column, x: Column) -> tuple[Column, Column]:
        now = F.when(x["role"] == 0, F.greatest(reach, x["end"])).otherwise(reach)
        return now, F.struct(*[x[c].alias(c) for c in ("start", "role", "end", "generator", "code", "cue")], now.alias("reach"))

    def back(later: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["role"] == 0
        now = F.struct(F.when(is_base, x["start"]).otherwise(later["start"]).alias("start"), F.when(is_base, x["end"]).otherwise(later["end"]).alias("end"))
        shared = F.greatest(F.least(x["reach"], x["end"]) - x["start"], F.least(later["end"], x["end"]) - later["start"])
        touches = (x["reach"] > x["start"]) | (later["start"] < x["end"])
        given = [x[c].alias(c) for c in ("start", "role", "end", "generator", "code", "cue", "reach")]
        return now, F.struct(*given, (shared * 5 >= (x["end"] - x["start"]) * 4).alias("known"), touches.alias("touches"))

    far = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("end"))
    items = F.array_sort(F.concat(F.transform(base, item(0)), F.transform(more, item(1))))
    marked = _with(items, lambda a: F.filter(_with(F.reverse(_scan(a, F.lit(0), forth, kind)), lambda r: _scan(r, far, back, last)), lambda x: x["role"] == 1))

    def plain(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("start", "generator", "end", "code", "cue")], F.lit(False).alias("known"), F.lit(False).alias("touches"))

    def kept(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("start", "generator", "end", "code", "cue", "known", "touches")])

    return F.when((F.size(base) > 0) & (F.size(more) > 0), F.transform(marked, kept)).otherwise(F.transform(more, plain))


def fields_of(code: int) -> tuple[int, ...]:
    out = []
    for size in reversed(SHAPE):
        code, field = divmod(code, size)
        out.append(field)
    return tuple(reversed(out))


class Boosted:
    """Gradient boosting of two-level trees on weighted cells, logistic loss."""

    def __init__(self, cells: dict[int, tuple[float, float]], rounds: int = ROUNDS, rate: float = RATE):
        """cells: code -> (candidates, those with a cue)."""
        self.codes = sorted(cells)
        fields = [fields_of(c) for c in self.codes]
        n = [cells[c][0] for c in self.codes]
        p = [cells[c][1] for c in self.codes]
        splits = sorted({(f, v) for row in fields for f, v in enumerate(row)})
        raw = [0.0] * len(n)
        for _ in range(rounds):
            chance = [1 / (1 + math.exp(-x)) for x in raw]
            slope = [b - a * c for a, b, c in zip(n, p, chance, strict=True)]
            curve = [a * c * (1 - c) for a, c in zip(n, chance, strict=True)]
            for leaf in self._leaves(list(range(len(n))), splits, fields, slope, curve, 2):
                value = sum(slope[i] for i in leaf) / (sum(curve[i] for i in leaf) + 1.0)
                for i in leaf:
                    raw[i] = max(-12.0, min(12.0, raw[i] + rate * value))
        self.scores = {c: 1 / (1 + math.exp(-x)) for c, x in zip(self.codes, raw, strict=True)}

    def _leaves(self, rows, splits, fields, slope, curve, depth):
        if not depth or len(rows) < 2:
            return [rows]
        gain = lambda part: sum(slope[i] for i in part) ** 2 / (sum(curve[i] for i in part) + 1.0)
        best = (1e-9, None)
        whole = gain(rows)
        for f, v in splits:
            yes = [i for i in rows if fields[i][f] == v]
            if 0 < len(yes) < len(rows):
                no = [i for i in rows if fields[i][f] != v]
                best = max(best, (gain(yes) + gain(no) - whole, (f, v)), key=lambda x: x[0])
        if best[1] is None:
            return [rows]
        f, v = best[1]
        out = []
        for side in (True, False):
            out += self._leaves([i for i in rows if (fields[i][f] == v) == side], splits, fields, slope, curve, depth - 1)
        return out


def cue_rates(known: dict[int, tuple[float, float]], least: int = KNOWN) -> dict[int, float]:
    """Per generator the share of cues among candidates known to be personal; 0 where none is known.

    known: code -> (known candidates, those with a cue)."""
    sums = {g: [0.0, 0.0] for g in range(len(GENERATORS))}
    for code, (n, cued) in known.items():
        sums[fields_of(code)[0]][0] += n
        sums[fields_of(code)[0]][1] += cued
    rates = {g: cued / n for g, (n, cued) in sums.items() if n >= least and cued}
    return {g: rates.get(g, max(rates.values(), default=0.0)) for g in sums}


def thresholds(scores: dict[int, float], cells: dict[int, tuple[float, float]], precision: float = PRECISION) -> dict[int, float]:
    """Per generator the lowest score from which on personal candidates make up ``precision``.

    cells: code -> (candidates, personal ones, as estimated)."""
    out = {}
    for g in range(len(GENERATORS)):
        ranked = sorted(((scores[c], *cells[c]) for c in cells if c in scores and fields_of(c)[0] == g), reverse=True)
        every = personal = 0.0
        limit = 2.0
        for i, (score, n, p) in enumerate(ranked):
            every, personal = every + n, personal + p
            last = i + 1 == len(ranked) or ranked[i + 1][0] < score
            if last and score >= 0.5 and personal >= precision * every:
                limit = score
        out[g] = limit
    return out


def chosen_codes(learn: dict, check: dict, known: dict) -> list[int]:
    """Combinations of features whose candidates are reported."""
    rates = cue_rates(known)
    rate = {c: rates[fields_of(c)[0]] for c in learn.keys() | check.keys()}
    scores = {c: min(1.0, s / rate[c]) for c, s in Boosted(learn).scores.items() if rate[c]}
    limit = thresholds(scores, {c: (n, p / rate[c]) for c, (n, p) in check.items() if rate[c]})
    return sorted(c for c, s in scores.items() if s >= limit[fields_of(c)[0]])


def _written(spans: Column, names: tuple[str, ...]) -> Column:
    label = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(label, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", (fold("doc_id", CALIBRATION[0]) == CALIBRATION[1]).alias("calibrates"), base_spans(text).alias("base"), candidates(text).alias("more"))
    held = staged(held, "pii-spans")
    held = staged(held.withColumn("more", _beside(F.col("base"), F.col("more"))), "pii-marked")

    seen = held.select("calibrates", F.explode("more").alias("x"))
    one = lambda c: F.sum(c.cast("int"))
    seen = seen.groupBy("calibrates", "x.code").agg(
        F.count("*").alias("n"), one(F.col("x.cue")).alias("cued"), one(F.col("x.known")).alias("known"), one(F.col("x.known") & F.col("x.cue")).alias("both")
    )
    seen = seen.collect()  # at most 2 * CELLS rows
    learn = {r["code"]: (float(r["n"]), float(r["cued"])) for r in seen if not r["calibrates"]}
    check = {r["code"]: (float(r["n"]), float(r["cued"])) for r in seen if r["calibrates"]}
    known = {r["code"]: (float(r["known"]), float(r["both"])) for r in seen if not r["calibrates"]}
    chosen = chosen_codes(learn, check, known)
    picks = F.array(*[F.lit(c) for c in chosen]) if chosen else F.array().cast("array<int>")

    new = F.filter("more", lambda x: F.array_contains(picks, x["code"]) & ~x["touches"])
    new = F.transform(new, lambda x: F.struct(x["start"].alias("start"), (x["generator"] + len(KINDS)).alias("kind"), x["end"].alias("end")))
    names = (*KINDS, *(g for g, _ in GENERATORS))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return held.withColumn("new", new).select(
        "doc_id",
        *[count(k).alias(f"n_{x}") for k, x in enumerate(KINDS)],
        F.sha2(_written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "new")), names).alias("spans"),
        F.size("new").cast("long").alias("n_added"),
    )
