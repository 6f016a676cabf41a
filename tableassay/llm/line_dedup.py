"""Line dedup by winnowing over line hashes.

Lines are what newlines separate. A window is the shortest run of consecutive lines
from a line on that holds ``words`` words; the line with the smallest hash of each
window (the last of equals) is a fingerprint. Any run of ``words`` words or more that
two places share holds a whole window, so both places select the same line in it.

Fingerprints are a sieve: equal windows select equal lines, so a window is followed up
only if a fingerprint in it occurs more than once in the corpus. Those windows, and the
shortest runs of ``words`` words that end (rather than start) at each line, are keyed by
the hash of the whole run and joined with the first place of an equal run, by doc_id and
then text; a run that is not the first is deleted. Any run of ``words`` words or more is
the union of such windows, so a line goes if and only if it lies in a run of ``words``
words or more that stands earlier as well, at whatever place. An equal line always stands
earlier, so no content is lost.

Defined cases: a null text stays null, an empty text has one empty line and loses
nothing; documents with one id follow each other by text, equal rows in any order;
blank lines count no words but belong to runs; columns that clash are replaced.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.llm.shared import aside, staged
from tableassay.llm.tokens import Words, mix, pieces, span_hashes, text_bytes

WORDS = 50


def fingerprints(hashes: np.ndarray, words: np.ndarray, least: int) -> list[int]:
    """Lines that are the minimum of some window; the last of equal minima."""
    rank, count = mix(hashes.view(np.uint64)).tolist(), words.tolist()
    n, end, total, out = len(rank), 0, 0, []
    least_first = deque()
    for start in range(n):
        while end < n and total < least:
            while least_first and rank[least_first[-1]] >= rank[end]:
                least_first.pop()
            least_first.append(end)
            total += count[end]
            end += 1
        if total < least:
            break
        if not out or out[-1] != least_first[0]:
            out.append(least_first[0])
        if least_first[0] == start:
            least_first.popleft()
        total -= count[start]
    return out


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """row, doc_id, draw, line hashes, words per line and fingerprint lines."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column(batch.schema.names.index("text")))
                breaks = np.flatnonzero(data == 10)
                begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                per = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1) + 1
                bounds = np.concatenate([[0], np.cumsum(per)])
                # lines in order: a text's first line starts at its offset
                end = np.empty(len(begin), np.int64)
                end[:-1] = begin[1:] - 1
                last = bounds[1:] - 1
                end[last] = offsets[1:]
                hashes = span_hashes(data, begin, end).view(np.int64)
                found = Words(data, offsets)
                line = np.searchsorted(begin, found.start, side="right") - 1
                words = np.bincount(line, minlength=len(begin)).astype(np.int32)
                picked = [fingerprints(hashes[a:b], words[a:b], least) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"],
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words)),
                        pa.array(picked, pa.list_(pa.int32())),
                    ],
                    ["row", "doc_id", "draw", "lines", "words", "picked"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("row", "doc_id", F.xxhash64(text).alias("draw"), text.alias("text"))
    return keyed.mapInArrow(run, f"row long, doc_id {kind}, draw long, lines array<long>, words array<int>, picked array<int>")


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def reach(own: np.ndarray, old: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many lines are equal from each ``here`` of own and ``there`` of old on: binary
    search over hashes of runs, so that many matches in a long text cost little."""
    most = max(len(own), len(old))
    up, down = _powers(_BASE, most), _powers(_BACK, most)

    def sums(lines):
        total = np.zeros(len(lines) + 1, np.uint64)
        np.cumsum(mix(lines.view(np.uint64)) * up[: len(lines)], out=total[1:])
        return total

    a, b = sums(own), sums(old)
    low, high = np.zeros(len(here), np.int64), np.minimum(len(own) - here, len(old) - there)
    while (low < high).any():
        half = (low + high + 1) // 2
        same = (a[here + half] - a[here]) * down[here] == (b[there + half] - b[there]) * down[there]
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def repeated(own: np.ndarray, old: np.ndarray, words: np.ndarray, here: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
    """Lines of ``own`` in runs of ``least`` words or more around matches with ``old``."""
    n = len(own)
    end = here + reach(own, old, here, there)
    start = here - reach(own[::-1].copy(), old[::-1].copy(), n - here, len(old) - there)
    before = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    long = before[end] - before[start] >= least
    depth = np.bincount(start[long], minlength=n + 1) - np.bincount(end[long], minlength=n + 1)
    return np.flatnonzero(np.cumsum(depth)[:n] > 0)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of ``least`` words or more from each line on
    and up to each line."""
    n = len(words)
    before = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    to = np.searchsorted(before, before[:-1] + least)
    start = np.searchsorted(before, before[1:] - least, side="right") - 1
    ahead, back = np.flatnonzero(to <= n), np.flatnonzero(start >= 0)
    code = np.unique(np.concatenate((ahead * (n + 1) + to[ahead], start[back] * (n + 1) + back + 1)))
    return code // (n + 1), code % (n + 1)


def run_hashes(lines: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of lines."""
    n = len(lines)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(lines.view(np.uint64)) * _powers(_BASE, n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_BACK, n)[start] + (end - start).astype(np.uint64))


def _windows(held: DataFrame, least: int) -> DataFrame:
    """row, doc_id, draw, from, to and hash of the windows around the fingerprints ``met``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lines, words, met = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                start, end = windows(words, least)
                met = np.sort(met)
                kept = np.searchsorted(met, end) > np.searchsorted(met, start)
                start, end = start[kept], end[kept]
                own = batch.slice(i, 1)
                same = pa.array(np.zeros(len(start), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c).take(same) for c in range(3)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(run_hashes(lines, start, end).view(np.int64))],
                    ["row", "doc_id", "draw", "from", "to", "hash"],
                )

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.select("row", "doc_id", "draw", "lines", "words", "met").mapInArrow(run, f"row long, doc_id {kind}, draw long, from int, to int, hash long")


def _united(runs: DataFrame) -> DataFrame:
    """Per row the sorted line numbers in its runs, and for each line up to the last of
    them whether it is one."""

    def run(batches):
        for batch in batches:
            numbers, flags = [], []
            for i in range(batch.num_rows):
                froms, tos = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
                cut = np.cumsum(np.bincount(froms, minlength=tos.max() + 1) - np.bincount(tos, minlength=tos.max() + 1))[:-1] > 0
                flags.append(cut)
                numbers.append(np.flatnonzero(cut).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))], ["row", "removed", "cut"])

    both = runs.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("runs")).select("row", "runs.from", "runs.to")
    return both.mapInArrow(run, "row long, removed array<int>, cut array<boolean>")


def deletions(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key ``row``, and per row with deletions the sorted line numbers
    and whether each line goes."""
    # the key depends on how the scan is split, so every later read is of the written rows
    keyed = staged(docs.drop("row").withColumn("row", F.monotonically_increasing_id()), "line-rows")
    lines = staged(_lines(keyed, words), "line-hashes")
    marks = lines.select("row", F.explode("picked").alias("here"), "lines").select("row", "here", F.expr("lines[here]").alias("hash"))
    again = marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    met = marks.join(again, "hash").groupBy("row").agg(F.collect_list("here").alias("met"))
    found = staged(_windows(lines.join(met, "row"), words), "line-windows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "draw", "row", "from")
    first = found.groupBy("hash").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first.select("hash", F.col("first.row").alias("source"), F.col("first.from").alias("there")), "hash")
    later = later.where("row <> source OR from <> there").select("row", "from", "to")
    return keyed, _united(later)


def _cut(text, cut):
    kept = F.zip_with(F.split(text, "\n", -1), cut, lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x))
    return F.when(cut.isNull(), text).otherwise(F.array_join(kept, "\n"))


def deduplicate(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The columns of ``docs`` with shortened ``text``, and n_lines, n_removed, removed (line numbers)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed", "row", "cut")]
    keyed, gone = deletions(docs.select(columns), words)
    out = keyed.join(gone, "row", "left")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    none = F.array().cast("array<int>")
    return out.select(
        *[c for c in columns if c != "text"],
        _cut(F.col("text"), F.col("cut")).alias("text"),
        lines.cast("long").alias("n_lines"),
        F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
    )


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0,
    comma-joined), text_sha256 of what is left."""
    found = deduplicate(docs.select("doc_id", "text"), words)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def shortened(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` with later repeated runs cut out; rows that lose every line go."""
    plain, back = aside(docs, "doc_id", "text", "n_chars")
    found = deduplicate(plain, words).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(back)
