"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their lower-cased words joined by single spaces. Patterns are the
windows of ``window`` consecutive words of the benchmark items. A table of shifts
by byte block skips positions at which no pattern can end, the last block of the
search window selects a bucket of patterns, and a direct comparison confirms.

Patterns go to the tasks in blocks of bounded size (``block_bytes``); with more
than one block the documents pass one search per block, with their findings so far
as columns, and are staged after every ``blocks_per_job`` blocks.

Defined cases: null and empty texts have no words, hence no hits and no windows; an
item of fewer than ``window`` words is one window; repeated items with one id count
once; items with a null id mark words but are not listed; an empty benchmark
leaves every document clean; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.llm.shared import aside, staged

WINDOW = 10
BLOCK_BYTES = 8 << 20
BLOCKS_PER_JOB = 4

#: A-Z to lower case; what is not a digit, a letter or beyond ASCII to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search for byte patterns. Patterns of like length share a table, so that a
    short pattern does not take the shifts from long ones."""

    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in set(patterns):
            classes[min(len(p), 48).bit_length() if len(p) < 32 else 6].append(p)
        self.tables = [self._table(group) for _, group in sorted(classes.items())]

    @staticmethod
    def _table(patterns: list[bytes]):
        m = min(map(len, patterns))
        bits = (2 * m * len(patterns)).bit_length()
        b = max(1, min(m // 3, -(-bits // 2)))
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b : end]
                if m - end < shift.get(block, m):
                    shift[block] = m - end
            bucket[p[m - b : m]].append(p)
        return m, b, m - b + 1, shift, dict(bucket)

    def search(self, text: bytes):
        """(start, pattern) of every occurrence."""
        n = len(text)
        for m, b, skip, shift, bucket in self.tables:
            move, end = shift.get, m
            while end <= n:
                step = move(text[end - b : end], skip)
                if step:
                    end += step
                    continue
                start = end - m
                for p in bucket[text[end - b : end]]:
                    if text.startswith(p, start):
                        yield start, p
                end += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _patterns(benchmark: DataFrame, window: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(set(windows_of(words_of(text), window)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["pattern", "item"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    return named.mapInArrow(cut, "pattern binary, item string").distinct()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, blocks_per_job: int = BLOCKS_PER_JOB) -> DataFrame:
    """``docs`` with n_words, hit_from, hit_to (disjoint word ranges, end exclusive) and items."""
    spark = docs.sparkSession
    patterns = staged(_patterns(benchmark, window), "leak-patterns")
    total = patterns.agg(F.sum(F.length("pattern") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    added = {"n_words": "bigint", "hit_from": "array<bigint>", "hit_to": "array<bigint>", "items": "array<string>"}
    df = docs.select([c for c in docs.columns if c not in added]).withColumns({k: F.lit(None).cast(v) for k, v in added.items()})
    for k in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k)
        listed: dict[bytes, list] = defaultdict(list)
        for r in part.toLocalIterator():  # at most about block_bytes
            listed[bytes(r["pattern"])].append(r["item"])
        df = df.mapInArrow(_search(spark.sparkContext.broadcast(dict(listed))), df.schema)
        if (k + 1) % blocks_per_job == 0 and k + 1 < blocks:
            df = staged(df, "leak-block")
    return df


def _search(shared):
    def run(batches):
        known = shared.value
        machine = WuManber(list(known))
        lengths = {p: p.count(b" ") - 1 for p in known}
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = batch.column(at["text"]).to_pylist()
            old = [batch.column(at[n]).to_pylist() for n in ("hit_from", "hit_to", "items")]
            counts, starts, ends, items = [], [], [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                spans = list(zip(old[0][i] or [], old[1][i] or [], strict=True))
                ids = set(old[2][i] or [])
                seen, index = 0, 0
                for start, p in sorted(machine.search(joined)) if words else []:
                    index += joined.count(b" ", seen, start)
                    seen = start
                    spans.append((index, index + lengths[p]))
                    ids.update(x for x in known[p] if x is not None)
                spans = merged(spans)
                counts.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted(ids))
            made = {"n_words": pa.array(counts, pa.int64()), "hit_from": pa.array(starts, pa.list_(pa.int64())), "hit_to": pa.array(ends, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(i)) for n, i in at.items()], list(at))

    return run


def report(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    items = F.array_sort("items")
    found = find(docs.select("doc_id", "text"), benchmark, **parameters)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    plain, back = aside(docs, "text")
    found = find(plain, benchmark, **parameters)
    return found.where(F.size("hit_from") == 0).select(back)
