"""Phrase collocations by vertical partitioning of depth-truncated suffix subtrees.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces
into words. Every position of a word begins a suffix of at most five words. As in the
ERA construction of suffix trees, suffixes are dealt to groups by their first words, each
group's subtree is built alone, and phrase counts are sums over its leaves:

1. Words are counted per lang and get 64-bit codes; codes are checked to differ.
2. A suffix is cut where no phrase of ``least`` occurrences can go on: at rare words,
   and before pairs and triples of words whose slot in a table of counters stays below
   ``least``. The slots give bit sets of at most 2^``SLOT_BITS`` bits; a slot shared by
   rare runs only keeps suffixes longer, so counts stay exact. What is left is combined
   per task: leaves, with how often each occurs. A frequent phrase is a leaf of every task,
   so tasks read about ``SHARE`` words each, whatever the splits of the table are.
3. Vertical partitioning: a suffix goes to the group of its first two words, or, where
   the counters show that these begin more than ``BUDGET`` suffixes, of its first three.
   Groups are hashed to as many tasks as keep about ``BUDGET`` suffixes in each.
4. A task sorts its suffixes on disk if need be and walks them once: the open path of the
   subtree, five counts, is all that it holds.

A phrase's score is that of its lowest cut. Counts of first and last parts are phrases
that occur at least as often, so they are found among the nodes and the words. Products
pass 64 bits: decimals of 38 digits hold them.

Defined cases: null and empty texts have no words; a null lang is ``und``; repeated rows
count each; a very long text is one slice; an empty table gives no
row; columns that clash with the results, and others, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableassay.llm.shared import staged
from tableassay.llm.tokens import _BASE, LOWER, U, Words, _power, mix, pieces, span_hashes, text_bytes

DEPTH = 5
LEAST = 100
TOP = 2000
#: Suffixes that a group's task sorts, about.
BUDGET = 2_000_000
#: Words of text that a task cuts into suffixes, where every core has a task.
SHARE = 1 << 26
#: At most 2^SLOT_BITS counters: bit sets of 128 MB.
SLOT_BITS = 30
#: Rows that a task combines, and bytes of text that it reads at once.
_HELD = 400_000
_SLICE = 1 << 20
_RANGE_BITS = 18
#: Rows that a task hands on at once.
_ROWS = 1 << 16
_W = [f"w{i + 1}" for i in range(DEPTH)]

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, *b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BREAK = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
_SECOND = np.random.Generator(np.random.PCG64(20240502)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _second_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs that are independent of ``span_hashes``."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SECOND[data] * _power("up", _BASE, n), out=total[1:])
    back = _power("down", pow(_BASE, -1, 1 << 64), n + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


class Pieces:
    """Words of a slice with their codes, and for each whether the next one follows it
    in the same piece. A code is of the lang and the word."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, offsets = text_bytes(batch.column(1))
        self.data = LOWER[data]
        self.words = words = Words(self.data, offsets, _INSIDE)
        own, second = span_hashes(self.data, words.start, words.end), _second_hashes(self.data, words.start, words.end)
        name, begins = text_bytes(batch.column(0))
        lang = span_hashes(name, begins[:-1], begins[1:])[words.of]
        code = mix(own + mix(second + lang * U(0x9E3779B97F4A7C15) + U(seed)))
        self.codes = np.maximum(code, U(1))  # 0 is no word
        self.check = mix(second ^ own * U(3) + lang)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[self.data], dtype=np.int64)))
        n = len(self.codes)
        self.follows = np.zeros(n, bool)
        if n:
            at = breaks[words.start]
            self.follows[:-1] = (at[1:] == at[:-1]) & (words.of[1:] == words.of[:-1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _combined(batches, read, combine, most: int):
    """What ``read`` makes of each slice, a tuple of arrays, combined. Rows go on only once
    more than half of ``most`` are left after combining."""
    held, size = [], 0
    for whole in batches:
        for batch in pieces(whole, "text", _SLICE):
            found = read(batch)
            held.append(found)
            size += len(found[-1])
            if size >= most:
                one = combine(_gathered(held))
                size = len(one[-1])
                held = [one]
                if 2 * size > most:
                    yield one
                    held, size = [], 0
    if held:
        yield combine(_gathered(held))


def _gathered(held: list) -> list[np.ndarray]:
    """Column by column one array of those in ``held``, which are let go on the way."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    return [np.concatenate(columns.pop(0), axis=-1) for _ in range(len(columns))]


def _handed(columns: list) -> Iterator[list[np.ndarray]]:
    """The columns in runs of at most ``_ROWS`` rows."""
    for i in range(0, len(columns[-1]), _ROWS):
        yield [x[..., i : i + _ROWS] for x in columns]


def _starts(changes: np.ndarray) -> np.ndarray:
    """First rows of runs, where ``changes`` says of each row but the first if one begins."""
    return np.flatnonzero(np.concatenate(([True], changes)))


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, code and f of every word."""

    def read(batch):
        found = Pieces(batch, seed)
        codes, first, back, n = np.unique(found.codes, return_index=True, return_inverse=True, return_counts=True)
        if (found.check != found.check[first][back]).any():
            # one code for two words: all go on, and are told apart by their texts
            codes, first, n = found.codes, np.arange(len(found.codes)), np.ones(len(found.codes), np.int64)
        raw, words = found.data.tobytes(), found.words
        texts = np.empty(len(first), object)
        texts[:] = [raw[a:b].decode() for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        langs = np.array(batch.column(0).to_pylist(), object)[words.of[first]]
        return langs, texts, codes, found.check[first], n

    def combine(columns):
        langs, texts, codes, checks, n = columns
        if not len(n):
            return columns
        order = np.argsort(codes, kind="stable")
        first = _starts((np.diff(codes[order]) != 0) | (checks[order][1:] != checks[order][:-1]))
        at = order[first]
        return langs[at], texts[at], codes[at], checks[at], np.add.reduceat(n[order], first)

    def run(batches):
        for langs, texts, codes, _, n in _combined(batches, read, combine, _HELD):
            for lang, text, code, times in _handed([langs, texts, codes.view(np.int64), n]):
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(code), pa.array(times)], ["lang", "word", "code", "n"])

    per = _texts(docs).mapInArrow(run, "lang string, word string, code long, n long")
    return per.groupBy("lang", "word").agg(F.first("code").alias("code"), F.sum("n").alias("f"))


def _words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The staged words and the seed with which their codes all differ."""
    for seed in range(1, 9):
        words = staged(_counted(docs, seed), "phrase-words")
        if not words.groupBy("code").count().where("count > 1").limit(1).count():
            return words, seed
    raise ValueError("word codes collide with eight seeds")


def _bits(tokens: int) -> int:
    """Counters for so many tokens, as a power of two."""
    return min(SLOT_BITS, max(_RANGE_BITS, (max(1, tokens) // 4).bit_length()))


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U(64 - bits)).astype(np.int64)


def _flags(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot that ``slots`` (slot) names: 2^bits / 8 bytes come to the driver,
    packed by the executors."""

    def run(batches):
        ranges = {}
        for batch in batches:
            slot = batch.column(0).to_numpy()
            for r in np.unique(slot >> _RANGE_BITS).tolist():
                own = ranges.setdefault(r, np.zeros(1 << _RANGE_BITS, bool))
                own[slot[slot >> _RANGE_BITS == r] & ((1 << _RANGE_BITS) - 1)] = True
        for r, own in ranges.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["range", "bits"])

    tasks = max(1, min(1 << (bits - _RANGE_BITS), int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    packed = slots.repartition(tasks, F.shiftright("slot", _RANGE_BITS)).mapInArrow(run, "range long, bits binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (_RANGE_BITS - 3)
    for r, data in packed:
        out[r * step : (r + 1) * step] = np.frombuffer(data, np.uint8)
    return out


def _set(flags: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


class Filter:
    """Whether a word, a pair or a triple may occur often enough; its parts broadcast."""

    def __init__(self, seed: int, bits: int):
        self.seed, self.bits, self.levels = seed, bits, []

    def add(self, spark, flags: np.ndarray) -> None:
        self.levels.append(spark.sparkContext.broadcast(flags))

    def runs(self, found: Pieces) -> np.ndarray:
        """How many words from each on, up to ``DEPTH``, may be one phrase: each word and
        each pair and triple in it may, as far as levels are there."""
        codes, n = found.codes, len(found.codes)
        if not n:
            return np.zeros(0, np.int64)
        word = _set(self.levels[0].value, _slot(codes, self.bits))
        link = found.follows & word  # word i to i + 1
        link[:-1] &= word[1:]
        may, key = {2: link}, codes
        for size, flags in enumerate(self.levels[1:], 2):
            key = joined(codes, key, size)
            own = may.setdefault(size, np.ones(n, bool))
            own[: len(key)] &= _set(flags.value, _slot(key, self.bits))
        reach, going = word.astype(np.int64), word
        for d in range(1, DEPTH):
            step = np.zeros(n, bool)
            step[: max(0, n - d)] = True
            # the runs that end with word d
            for size, own in may.items():
                if size <= d + 1:
                    step[: max(0, n - d)] &= own[d + 1 - size : n + 1 - size]
            going = going & step
            reach += going
        return reach


def joined(codes: np.ndarray, shorter: np.ndarray, d: int) -> np.ndarray:
    """Keys of the runs of d words from those of d - 1."""
    n = max(0, len(codes) - d + 1)
    return mix(shorter[:n] * U(0x9E3779B97F4A7C15) + codes[d - 1 : d - 1 + n])


def _slots(docs: DataFrame, sieve: Filter, least: int, size: int = 2) -> DataFrame:
    """slot and n, ``least`` at least, of the runs of ``size`` words that the filter lets through.

    A task's counts travel as one row per range of slots; a range is summed in an array."""
    seed, bits = sieve.seed, sieve.bits

    def read(batch):
        found = Pieces(batch, seed)
        key = found.codes
        for d in range(2, size + 1):
            key = joined(found.codes, key, d)
        slot, n = np.unique(_slot(key[sieve.runs(found)[: len(key)] >= size], bits).astype(np.uint32), return_counts=True)
        return slot, n

    def combine(columns):
        if not len(columns[-1]):
            return columns
        n, slot = columns.pop(), columns.pop()
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = _starts(slot[1:] != slot[:-1])
        return slot[first], np.add.reduceat(n[order], first)

    def run(batches):
        for slot, n in _combined(batches, read, combine, 5 * _HELD):
            own = slot >> np.uint32(_RANGE_BITS)
            cuts = [*(_starts(own[1:] != own[:-1]).tolist() if len(own) else []), len(own)]
            for some in (cuts[i : i + 33] for i in range(0, len(cuts) - 1, 32)):
                parts = [slice(a, b) for a, b in zip(some, some[1:])]
                columns = [pa.array([int(own[x.start]) for x in parts], pa.int64()), *(pa.array([y[x].tobytes() for x in parts], pa.binary()) for y in (slot, n))]
                yield pa.RecordBatch.from_arrays(columns, ["range", "slots", "n"])

    def summed(batches):
        last, total = None, np.zeros(1 << _RANGE_BITS, np.int64)

        def frequent():
            at = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([pa.array(at + (last << _RANGE_BITS)), pa.array(total[at])], ["slot", "n"])

        for batch in batches:
            for r, slot, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if r != last:
                    if last is not None:
                        yield frequent()
                    last, total[:] = r, 0
                # the slots of one row differ
                total[np.frombuffer(slot.as_buffer(), np.uint32) & np.uint32((1 << _RANGE_BITS) - 1)] += np.frombuffer(n.as_buffer(), np.int64)
        if last is not None:
            yield frequent()

    packed = _texts(docs).mapInArrow(run, "range long, slots binary, n binary")
    tasks = max(1, min(1 << (bits - _RANGE_BITS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return packed.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(summed, "slot long, n long")


def _shared(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` in a partition for each ``SHARE`` of their words, or for each core if that is
    more, where they have more than that; none moves."""
    return docs.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-words // SHARE)))


def _leaves(docs: DataFrame, sieve: Filter, heavy: np.ndarray) -> DataFrame:
    """Suffixes of two to five words (codes, 0 for none), the number of words ``d`` that
    their group shares, its hash ``g``, and how often the task saw them."""
    seed = sieve.seed
    heavy = docs.sparkSession.sparkContext.broadcast(heavy)

    def read(batch):
        found = Pieces(batch, seed)
        reach = sieve.runs(found)
        at = np.flatnonzero(reach >= 2)
        rows = np.zeros((DEPTH, len(at)), np.uint64)
        for k in range(DEPTH):
            there = reach[at] > k
            rows[k, there] = found.codes[at[there] + k]
        return rows, np.ones(len(at), np.int64)

    def combine(columns):
        if not len(columns[-1]):
            return columns
        n, rows = columns.pop(), columns.pop()
        order = np.lexsort(rows[::-1])
        rows = rows[:, order]
        first = _starts((rows[:, 1:] != rows[:, :-1]).any(axis=0))
        return rows[:, first], np.add.reduceat(n[order], first)

    def run(batches):
        for rows, n in (x for one in _combined(batches, read, combine, 2 * _HELD) for x in _handed(one)):
            pair = joined(rows[1], rows[0], 1)
            deep = np.isin(_slot(pair, sieve.bits), heavy.value)
            group = np.where(deep, joined(rows[2], pair, 1), pair)
            yield pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in rows), pa.array(np.where(deep, 3, 2).astype(np.int32)), pa.array(group.view(np.int64)), pa.array(n)], [*_W, "d", "g", "n"])

    longs = ", ".join(f"{w} long" for w in _W)
    return _texts(docs).mapInArrow(run, f"{longs}, d int, g long, n long")


def _subtrees(leaves: DataFrame, tasks: int, least: int) -> DataFrame:
    """Nodes of the subtrees: words (0 beyond their depth), depth, count, and whether the
    group holds all of it. Only nodes that reach ``least`` or may with other groups' are kept."""

    def run(batches):
        last = None  # words of the open path
        count, split = [0] * (DEPTH + 1), 0

        def closed(words, depth, n, d):
            kept = (words[depth - 1] != 0) & ((n >= least) | (d > depth))
            words = words[:, kept].copy()
            words[depth:] = 0
            size = words.shape[1]
            return [*(pa.array(w) for w in words), pa.array(np.full(size, depth, np.int32)), pa.array(n[kept]), pa.array(d[kept] <= depth)]

        def batch_of(columns):
            return pa.RecordBatch.from_arrays(columns, [*_W, "depth", "a", "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(DEPTH)])
            d, n = batch.column(DEPTH).to_numpy(), batch.column(DEPTH + 1).to_numpy()
            before = np.concatenate((rows[:, :1] if last is None else last, rows[:, :-1]), axis=1)
            change = np.zeros(rows.shape[1], bool)
            for depth in range(1, DEPTH + 1):
                change |= rows[depth - 1] != before[depth - 1]
                if depth == 1:
                    continue
                starts = np.flatnonzero(change)
                if not len(starts):
                    count[depth] += int(n.sum())
                    continue
                if last is not None or starts[0] > 0:
                    path = last if starts[0] == 0 else rows[:, :1]
                    total = count[depth] + int(n[: starts[0]].sum())
                    yield batch_of(closed(path, depth, np.array([total]), np.array([split if starts[0] == 0 else d[0]])))
                sums = np.add.reduceat(n, starts)
                yield batch_of(closed(rows[:, starts[:-1]], depth, sums[:-1], d[starts[:-1]]))
                count[depth] = int(sums[-1])
            last, split = rows[:, -1:], int(d[-1])
        if last is not None:
            for depth in range(2, DEPTH + 1):
                yield batch_of(closed(last, depth, np.array([count[depth]]), np.array([split])))

    dealt = leaves.repartition(tasks, "g").select(*_W, "d", "n").sortWithinPartitions(*_W)
    longs = ", ".join(f"{w} long" for w in _W)
    return dealt.mapInArrow(run, f"{longs}, depth int, a long, whole boolean")


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of two to five words with at least ``least`` occurrences, by codes (w1 to w5,
    depth, a), and the words (lang, word, code, f)."""
    spark = docs.sparkSession
    words, seed = _words(docs)
    frequent = words.where(F.col("f") >= least)
    tokens = words.agg(F.sum("f")).first()[0] or 0
    bits = _bits(tokens)
    sieve = Filter(seed, bits)
    sieve.add(spark, _flags(frequent.select(F.shiftrightunsigned("code", 64 - bits).alias("slot")), bits))
    pairs = staged(_slots(docs, sieve, max(1, least)), "phrase-pairs")
    sieve.add(spark, _flags(pairs.select("slot"), bits))
    docs = _shared(docs, tokens)
    sieve.add(spark, _flags(_slots(docs, sieve, max(1, least), 3).select("slot"), bits))
    # at most tokens / budget slots; the budget grows where they would pass a hundred thousand
    budget = max(BUDGET, tokens // 100_000)
    heavy = np.array(sorted(r[0] for r in pairs.where(F.col("n") > budget).select("slot").collect()), np.int64)
    passing = pairs.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-passing // BUDGET))
    nodes = _subtrees(_leaves(docs, sieve, heavy), tasks, least)
    # a path above its group's depth is in several groups
    parts = nodes.where("NOT whole").groupBy(*_W, "depth").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return staged(nodes.where("whole").drop("whole").unionByName(parts), "phrase-nodes"), words


def _run(first: int, size: int) -> list:
    """Columns w1 to w5 of the run of ``size`` words from word ``first`` (from 0) on."""
    return [F.col(_W[first + i]) if i < size else F.lit(0).cast("long") for i in range(DEPTH)]


def _runs(nodes: DataFrame, of: list[tuple[int, int, int]], *kept) -> DataFrame:
    """For each (depth, first, size) the run of each node of that depth, as ``run``."""
    by_depth = {}
    for depth, first, size in of:
        by_depth.setdefault(depth, []).append(F.struct(F.lit(first).alias("first"), F.lit(size).alias("size"), F.struct(*[c.alias(w) for c, w in zip(_run(first, size), _W, strict=True)]).alias("run")))
    each = F.coalesce(*[F.when(F.col("depth") == d, F.array(*x)) for d, x in by_depth.items()])
    return nodes.withColumn("_run", F.explode(each)).select(*kept, "_run.first", "_run.size", "_run.run")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = 100) -> DataFrame:
    """Every phrase that no longer one covers: lang, w1 to w5, depth, a, l, r, n, score."""
    nodes, words = phrases(docs, least)
    own = F.struct(*_W)
    alone = words.where(F.col("f") >= least).select(F.col("code").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _W[1:]], F.col("f").alias("a"))
    every = nodes.select(own.alias("run"), "a").unionByName(alone.select(own.alias("run"), "a"))

    inside = [(d, i, s) for d in range(3, DEPTH + 1) for s in range(2, d) for i in range(d - s + 1)]
    covers = _runs(nodes.where("depth > 2"), inside, "a").groupBy("run").agg(F.max("a").alias("most"))
    held = nodes.withColumn("run", own).join(covers, "run", "left")
    kept = held.where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")

    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    of = words.where(F.col("f") >= least).select(F.col("code").alias("w1"), "lang").join(total, "lang")
    kept = kept.join(of, "w1")

    carried = ["lang", "depth", "a", "n", F.col("run").alias("phrase")]
    lefts = _runs(kept, [(d, 0, k) for d in range(2, DEPTH + 1) for k in range(1, d)], *carried).withColumnRenamed("size", "k").drop("first")
    lefts = lefts.join(every.select("run", F.col("a").alias("l")), "run").drop("run")
    rights = _runs(nodes, [(d, k, d - k) for d in range(2, DEPTH + 1) for k in range(1, d)], own.alias("phrase")).withColumnRenamed("first", "k").drop("size")
    rights = rights.join(kept.select(F.col("run").alias("phrase")), "phrase", "left_semi").join(every.select("run", F.col("a").alias("r")), "run").drop("run")
    cuts = lefts.join(rights, ["phrase", "k"]).withColumn("score", F.expr("CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    lowest = cuts.groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r", "lang", "depth", "a", "n")).alias("_low"))
    return lowest.select("_low.lang", "phrase.*", "_low.depth", "_low.a", "_low.l", "_low.r", "_low.n", "_low.score"), words


def mine(docs: DataFrame, least: int = LEAST, percent: int = 100, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` phrases by score, a (both descending) and text: lang, rank,
    phrase, a, l, r, n, score."""
    found, words = collocations(docs, least, percent)
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # ties at the end stay until texts decide
    near = staged(found.withColumn("_place", F.rank().over(ahead)).where(F.col("_place") <= top).drop("_place").withColumn("_id", F.struct(*_W)), "phrase-top")
    texts = near.select("_id", F.posexplode(F.array(*_W)).alias("at", "code")).where("code <> 0")
    texts = texts.join(words.where(F.col("f") >= least).select("code", "word"), "code").groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = near.drop(*_W).join(texts, "_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
