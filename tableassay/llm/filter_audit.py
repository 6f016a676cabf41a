"""Filter interaction audit by incremental retraction streaming.

Five filters: A few words, B repeated words, C capitals, D odd characters, E a text that
a smaller doc_id has as well. A document's failures are a mask of five bits; whatever the
order the filters run in, what each step removes is a sum of counters by mask.

The files are read as a stream of available-now micro-batches. A to D are functions of
the text. For E, keyed state holds per text the smallest id met so far and how its rows
count; when a smaller id arrives, the earlier rows' mask is retracted from the counters
of their parts and counted again with E. The stream writes signed changes of the counters
(part, mask, labels), summed per task; its sink and its checkpoint lie in the shared
folder, so a batch interrupted by lost executors is done again and counted once. Adding
the changes up gives the counters, and from them every order and step.

Rows of one text are combined in each task before they are dealt by text, so a text that
fills a third of the table sends a few rows per task. A call of the state function costs
milliseconds, so texts share one: state is keyed by pages of digests, as many as keep
about ``PAGE`` texts in each. State grows with the distinct texts, some 100 bytes each; where
that passes the executors' memory, set the session's state store to RocksDB. ``BATCHES``
is the number of micro-batches.

Defined cases: null and empty texts are one text, without words; a null doc_id is not
smaller than any and has no smaller one, so it passes E, and has no labels; rows that
repeat the smallest id all pass E; a doc_id with several label rows is good (toxic) if
one of them says so; a null lang is the part named by the empty string; an empty table
gives no row; columns that clash with the results, and others, are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.llm.tokens import Words, pieces, text_bytes
from tableassay.session import scratch_path

FILTERS = "ABCDE"
BATCHES = 4
PAGE = 1000
_E = 16
_GOOD, _TOXIC = 1, 2
_HELD = 100_000

_CAPITAL = np.isin(np.arange(256), list(range(65, 91)))
_ODD = np.isin(np.arange(256), list(b"#$%&*|"))
_POINT = np.arange(256) & 0xC0 != 0x80  # bytes that begin a code point


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4, 8 of the texts that fail A, B, C, D."""

    def per(of_byte: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(of_byte[data], dtype=np.int64)))[offsets])

    words = Words(data, offsets)
    pairs = np.stack((words.of.astype(np.uint64), words.hashes()))
    order = np.lexsort(pairs[::-1])
    ahead = pairs[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (ahead[:, 1:] != ahead[:, :-1]).any(axis=0)
    distinct = np.bincount(words.of[order][new], minlength=len(words.counts))
    fails = (words.counts < 200, 100 * distinct < 50 * words.counts, 100 * per(_CAPITAL) > 3 * per(_POINT), per(_ODD) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _marked(batches):
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = text_bytes(batch.column(1))
            digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column(0), batch.column(2).cast(pa.string()), pa.array(masks(data, offsets), pa.int32())], ["digest", "doc_id", "part", "mask"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, doc_id, part, mask, kind (bits: good, toxic); texts go no further."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(_marked, "digest string, doc_id long, part string, mask int")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("quality") == 1, _GOOD).otherwise(0) + F.when(F.col("toxic") == 1, _TOXIC).otherwise(0)
    return rows.join(known, "doc_id", "left").select("digest", "doc_id", "part", "mask", kind.alias("kind"))


def _packed(counts: Counter) -> str:
    return json.dumps([[*k, n] for k, n in sorted(counts.items())]) if counts else ""


def _counts(packed: str) -> Counter:
    return Counter({(part, kind): n for part, kind, n in json.loads(packed)} if packed else {})


def _combine(batches):
    """Rows of a task as one row per text: the smallest id, how many rows have it, have
    another id, have none, each by part and kind."""

    def out(held):
        keys = list(held)
        sides = list(zip(*held.values(), strict=True))
        packed = [pa.array([_packed(c) for c in side], pa.string()) for side in sides[2:]]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sides[0], pa.int32()), pa.array(sides[1], pa.int64()), *packed], ["digest", "mask", "least", "first", "rest", "free"])

    held = {}
    for batch in batches:
        for digest, doc_id, part, mask, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = held.get(digest)
            if one is None:
                held[digest] = one = [mask, None, Counter(), Counter(), Counter()]
            if doc_id is None:
                one[4][part, kind] += 1
            elif one[1] is None or doc_id < one[1]:
                one[3].update(one[2])
                one[1], one[2] = doc_id, Counter({(part, kind): 1})
            else:
                one[2 if doc_id == one[1] else 3][part, kind] += 1
        if len(held) >= _HELD:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def _changes(key, frames, state):
    """Signed changes of the counters that new rows of a page's texts make. State holds
    per text the smallest id and how many rows of each part and kind have it."""
    held = json.loads(state.get[0]) if state.exists else {}
    change = Counter()
    for frame in frames:
        for digest, mask, new, *sides in zip(*(frame[c].tolist() for c in ("digest", "mask", "least", "first", "rest", "free")), strict=True):
            own, rest, free = map(_counts, sides)
            for (part, kind), n in rest.items():
                change[part, mask | _E, kind] += n
            for (part, kind), n in free.items():
                change[part, mask, kind] += n
            if not own:
                continue
            new = int(new)
            least, packed = held.get(digest, (None, ""))
            if least is not None and new < least:
                # the smaller id retracts the earlier one's mask
                for (part, kind), n in _counts(packed).items():
                    change[part, mask, kind] -= n
                    change[part, mask | _E, kind] += n
                least, packed = None, ""
            passes = least is None or new == least
            for (part, kind), n in own.items():
                change[part, mask if passes else mask | _E, kind] += n
            if passes:
                held[digest] = (new, _packed(_counts(packed) + own))
    state.update((json.dumps(held),))
    rows = [(*k, n) for k, n in change.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "kind", "n"])


def _summed(batches):
    total = Counter()
    for batch in batches:
        for *k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[tuple(k)] += n
    rows = [(*k, n) for k, n in total.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["part", "mask", "kind", "n"])


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """part, mask, kind, n: rows of the Parquet files at ``path`` by lang, failures and labels."""
    source = spark.read.parquet(path).select("doc_id", "text", "lang")
    per = max(1, math.ceil(len(source.inputFiles()) / batches))
    # a pattern that names the path alone: a stream takes one file by pattern only
    named = path.rstrip("/")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", per).parquet(f"{named[:-1]}[{named[-1]}]")
    pages = max(1, source.count() // PAGE)
    page = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") % pages
    packed = "digest string, mask int, least long, first string, rest string, free string"
    counted = "part string, mask int, kind int, n long"
    combined = _labelled(stream, labels).mapInArrow(_combine, packed)
    changes = combined.withColumn("page", page).groupBy("page").applyInPandasWithState(_changes, counted, "held string", "append", "NoTimeout").mapInArrow(_summed, counted)
    sink, checkpoint = scratch_path(spark, "audit-changes"), scratch_path(spark, "audit-checkpoint")
    query = changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted).parquet(sink).groupBy("part", "mask", "kind").agg(F.sum("n").alias("n"))


def steps(counted: DataFrame) -> DataFrame:
    """Every part, filter order and step from the counters."""
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    step = F.col("step")
    letter = F.substring("filter_order", step, F.lit(1))
    before = F.substring("filter_order", F.lit(1), step - 1)
    bits = [(F.lit(f), F.lit(1 << i)) for i, f in enumerate(FILTERS)]
    n, mask, own, earlier = F.col("n"), F.col("mask"), F.col("bit"), F.col("earlier")
    fails, gone = mask.bitwiseAND(own) > 0, mask.bitwiseAND(earlier) > 0

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("long")

    per = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    per = per.withColumn("bit", F.coalesce(*[F.when(letter == f, b) for f, b in bits])).withColumn("earlier", sum((F.when(before.contains(f), b).otherwise(0) for f, b in bits), F.lit(0)))
    per = per.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(fails & ~gone & (F.col("kind").bitwiseAND(_GOOD) > 0)).alias("good_lost"),
        total(fails & ~gone & (F.col("kind").bitwiseAND(_TOXIC) > 0)).alias("toxic_lost"),
    )
    # a filter has one step in each order: 120 rows a part and filter
    shares = per.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return per.join(shares, ["part", "bit"]).drop("bit")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return steps(counters(spark, path, labels, batches))
