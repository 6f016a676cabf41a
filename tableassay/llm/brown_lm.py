"""Language model over Brown classes.

Exchange clustering moves units between ``CLASSES`` classes as long as the likelihood of
the class bigrams of the training corpus rises. Its units are the most frequent words
(the square root of the vocabulary, ``LEAST_HEAD`` to ``MOST_HEAD``), each on its own, and
all other words by their ending (``ENDINGS`` groups). Then each of the other words leaves
its group for the class that its own neighbours in the whole training corpus make likeliest:
one exchange step per word, on counts of its neighbours' classes. So every training word has
its own class; only a word that training lacks takes that of its ending. The probability of a
word is that of its class after the class before, times that of the word in its class. Both are
smoothed by adding 0.5; each class keeps one share for unknown words.

Counts, neighbours and class bigrams cover all training documents. A word is a 64-bit key, the
ending in its low bits. Count and class of the ``KEPT`` most frequent words go to the tasks;
what the other words of a document need is found by a join with the table of all words.

Defined cases: a null text is empty and has the end token alone; a null doc_id is
training; without training documents all counts are 0; repeated rows count again; other
columns are not read, whatever their names. A very long text is one row of keys in one task.
The words are staged once, so ``docs`` is read a single time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.llm.shared import fold, staged
from tableassay.llm.tokens import LOWER, Words, lists, pieces, text_bytes

FOLDS, HELD_OUT = 5, 1
LEAST_HEAD, MOST_HEAD = 512, 2048
ENDINGS = 127
CLASSES = 48
KEPT = 131_072
SWEEPS = 12
#: Class of the end token, and what stands for a class that a join will find.
END, OPEN = CLASSES, 127
#: Stands for the end token among the word keys: its low bits are no ending.
END_KEY = -1
_ENDING = 127
_MOST = 1 << 19
#: Contexts of a word: the class before it, then the class after it.
SIDES = 2 * (CLASSES + 1)


def word_keys(docs: DataFrame) -> DataFrame:
    """row, doc_id, held_out, words: the keys of the words of each lower-cased text in order, staged."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column(2))
                data = LOWER[data]
                words = Words(data, offsets)
                last = data[words.end - 1].astype(np.int64)
                second = np.where(words.end - words.start < 2, 0, data[np.maximum(words.end - 2, 0)]).astype(np.int64)
                keys = words.hashes().view(np.int64) & ~np.int64(_ENDING) | (last * 331 + second) % ENDINGS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), lists(keys, words.bounds, pa.int64())], ["doc_id", "held_out", "words"]
                )

    held = fold("doc_id", FOLDS) == HELD_OUT
    out = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, words array<long>")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "lm-words")


def _slices(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of about ``_MOST`` words, or of one row, and the words of each row."""
    for batch in batches:
        kind = batch.column(batch.schema.names.index(column))
        size = pc.binary_length(kind) if pa.types.is_binary(kind.type) else pc.list_value_length(kind)
        counts = size.to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // _MOST)) + 1
        bounds = [0, *cuts.tolist(), len(counts)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                yield batch.slice(a, b - a), counts[a:b]


def _chain(values: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before each token, the tokens, ends included, and the places of the words;
    texts begin after an end."""
    place = np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts)
    chain = np.full(len(values) + len(counts), end, np.int64)
    chain[place] = values
    return np.concatenate([[end], chain[:-1]]) if len(chain) else chain, chain, place


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """key, n of all words, and of the end token."""

    def run(batches):
        for batch, counts in _slices(batches, "words"):
            found, n = np.unique(_flat(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found, END_KEY)), pa.array(np.append(n, len(counts)).astype(np.int64))], ["key", "n"]
            )

    return train.select("words").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Units:
    """Unit of a word: its own number if it is in the head, else that of its ending; the end token is the last."""

    def __init__(self, head: np.ndarray):
        order = np.argsort(head)
        self.known, self.number = head[order], order.astype(np.int64)
        self.end = len(head) + ENDINGS

    def of(self, keys: np.ndarray) -> np.ndarray:
        group = len(self.known) + (keys & _ENDING)
        if not len(self.known):
            return group
        at = np.searchsorted(self.known, keys).clip(0, len(self.known) - 1)
        return np.where(self.known[at] == keys, self.number[at], group)


def _summed_cells(frame: DataFrame, cells_of, side: int, column: str) -> np.ndarray:
    """side x side counts of the cells that ``cells_of`` gives for a slice, added up per task, then over all."""

    def run(batches):
        total = np.zeros(side * side, np.int64)
        for batch, counts in _slices(batches, column):
            found, n = np.unique(cells_of(batch.column(0), counts), return_counts=True)
            total[found] += n
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    # at most side^2 rows
    found = frame.select(column).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(side, side)


def unit_bigrams(train: DataFrame, units: Units) -> np.ndarray:
    """Counts of neighbouring units over all documents."""
    shared, side = train.sparkSession.sparkContext.broadcast(units), units.end + 1

    def cells(column, counts):
        before, chain, _ = _chain(shared.value.of(_flat(column)), counts, side - 1)
        return before * side + chain

    return _summed_cells(train, cells, side, "words")


def class_bigrams(train: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over all documents, from their ``classes``."""

    def cells(column, counts):
        before, chain, _ = _chain(_codes(column), counts, END)
        return before * (CLASSES + 1) + chain

    return _summed_cells(train, cells, CLASSES + 1, "classes")


def _codes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)


def _binary(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.astype(np.uint8).tobytes())])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; the end token has the last class to itself."""
    n = len(bigrams)
    counts = bigrams.astype(np.float64)
    weight = counts.sum(axis=1) + counts.sum(axis=0)
    order = np.argsort(-weight[: n - 1], kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n - 1) % classes
    label[n - 1] = classes
    hot = np.eye(classes + 1)[label]
    table = hot.T @ counts @ hot
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            if not weight[u]:
                continue
            own = label[u]
            right, left, same = counts[u] @ hot, hot.T @ counts[:, u], counts[u, u]
            right[own] -= same
            left[own] -= same
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= same
            rows, columns = table[:classes], table[:, :classes].T
            gain = _xlogx(rows + right) - _xlogx(rows) + _xlogx(columns + left) - _xlogx(columns)
            total = gain.sum(axis=1) - gain[diagonal, diagonal]
            centre = table[diagonal, diagonal]
            total += _xlogx(centre + right[:classes] + left[:classes] + same) - _xlogx(centre)
            row, column = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            total -= _xlogx(row + right.sum() + same) - _xlogx(row) + _xlogx(column + left.sum() + same) - _xlogx(column)
            best = int(total.argmax())
            if total[best] <= total[own] + 1e-9:
                best = own
            table[best] += right
            table[:, best] += left
            table[best, best] += same
            hot[u, own], hot[u, best] = 0, 1
            label[u] = best
            moved += best != own
        if not moved:
            break
    return label


def gains(table: np.ndarray) -> np.ndarray:
    """SIDES x CLASSES: what one occurrence in a context adds to the likelihood of the class bigrams
    ``table`` if its word joins a class; whole numbers, so that sums do not depend on their order."""
    smooth = table + 0.5
    before = np.log(smooth[:, :CLASSES]) - np.log(smooth.sum(axis=0)[:CLASSES])
    after = (np.log(smooth[:CLASSES]) - np.log(smooth.sum(axis=1)[:CLASSES, None])).T
    return np.rint(np.concatenate([before, after]) * 65536)


def word_classes(train: DataFrame, units: Units, label: np.ndarray, table: np.ndarray) -> DataFrame:
    """key, n, class of every training word outside the head: the class with the highest gain
    over the word's contexts, the first of equals."""
    shared = train.sparkSession.sparkContext.broadcast((units, label, gains(table)))

    def contexts(batches):
        units, label, _ = shared.value
        for batch, counts in _slices(batches, "words"):
            keys = _flat(batch.column(0))
            of = units.of(keys)
            before, chain, place = _chain(label[of], counts, END)
            tail = of >= len(units.known)
            found, number = np.unique(keys[tail], return_inverse=True)
            at = place[tail]
            cells = np.concatenate([number * SIDES + before[at], number * SIDES + CLASSES + 1 + chain[at + 1]])
            cells, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[cells // SIDES]), pa.array((cells % SIDES).astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "context", "n"]
            )

    def choose(batches):
        weights = shared.value[2]
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            counts = np.zeros((batch.num_rows, SIDES))
            cells = batch.column(1).flatten()
            counts[np.repeat(np.arange(batch.num_rows), size), cells.field("context").to_numpy()] = cells.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts[:, : CLASSES + 1].sum(axis=1).astype(np.int64)), pa.array((counts @ weights).argmax(axis=1).astype(np.int8))],
                ["key", "n", "class"],
            )

    found = train.select("words").mapInArrow(contexts, "key long, context int, n long").groupBy("key", "context").agg(F.sum("n").alias("n"))
    # at most SIDES entries a word
    whole = found.groupBy("key").agg(F.collect_list(F.struct("context", "n")).alias("cells"))
    return whole.mapInArrow(choose, "key long, n long, class byte")


def _labelled(words: DataFrame, vocabulary: DataFrame, units: Units, label: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logged, classes of each document, staged; ``logged`` adds up
    log10(c + 0.5) over its words, ``classes`` has a byte per word."""
    kind = words.schema["doc_id"].dataType.simpleString()
    top = vocabulary.orderBy(F.col("n").desc(), "key").limit(KEPT).toArrow()
    keys = np.concatenate([head[0], top.column("key").to_numpy()])
    order = np.argsort(keys)
    counts = np.concatenate([head[1], top.column("n").to_numpy()])[order]
    kept = (keys[order], np.log10(counts + 0.5), np.concatenate([label[: len(head[0])], top.column("class").to_numpy()]).astype(np.int64)[order])
    shared = words.sparkSession.sparkContext.broadcast((kept, label[len(units.known) : units.end]))

    def look(batches):
        (known, logs, classes), _ = shared.value
        for batch, counts in _slices(batches, "words"):
            keys, rows = _flat(batch.column(3)), batch.num_rows
            of = np.repeat(np.arange(rows), counts)
            at = np.searchsorted(known, keys).clip(0, max(0, len(known) - 1))
            there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            codes = np.full(len(keys), OPEN, np.int64)
            codes[there] = classes[at[there]]
            logged = np.bincount(of[there], weights=logs[at[there]], minlength=rows).astype(np.float64)
            rest = np.concatenate([[0], np.cumsum(np.bincount(of[~there], minlength=rows))])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(np.bincount(of[there], minlength=rows).astype(np.int64)),
                    pa.array(logged),
                    _binary(codes, counts),
                    lists(keys[~there], rest, pa.int64()),
                ],
                ["row", "doc_id", "held_out", "known", "logged", "classes", "rest"],
            )

    def close(batches):
        endings = shared.value[1]
        for batch, counts in _slices(batches, "classes"):
            rows, keys = batch.num_rows, _flat(batch.column(5))
            of = np.repeat(np.arange(rows), pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False))
            # a word has one count and one class, whichever document of the slice asked for it
            found = batch.column(6).flatten()
            have, first = np.unique(found.field("key").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            at = np.searchsorted(have, keys).clip(0, max(0, len(have) - 1))
            there = have[at] == keys if len(have) else np.zeros(len(keys), bool)
            n, own = np.zeros(len(keys)), endings[keys & _ENDING]
            n[there] = found.field("n").to_numpy(zero_copy_only=False)[first[at[there]]]
            own[there] = found.field("class").to_numpy(zero_copy_only=False)[first[at[there]]]
            codes = _codes(batch.column(4))
            codes[codes == OPEN] = own
            logged = batch.column(3).to_numpy() + np.bincount(of, weights=np.log10(n + 0.5), minlength=rows)
            known = batch.column(2).to_numpy() + np.bincount(of[there], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts + 1), pa.array(known), pa.array(logged), _binary(codes, counts)],
                ["doc_id", "held_out", "n_tokens", "n_known", "logged", "classes"],
            )

    part = words.select("row", "doc_id", "held_out", "words").mapInArrow(
        look, f"row long, doc_id {kind}, held_out boolean, known long, logged double, classes binary, rest array<long>"
    )
    part = staged(part, "lm-parts")
    rare = part.select("row", F.explode(F.array_distinct("rest")).alias("key")).join(vocabulary, "key")
    found = rare.groupBy("row").agg(F.collect_list(F.struct("key", "n", "class")).alias("found"))  # at most the words of one text
    full = part.join(found, "row", "left").select("doc_id", "held_out", "known", "logged", "classes", "rest", "found")
    return staged(full.mapInArrow(close, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logged double, classes binary"), "lm-classes")


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    words = word_keys(docs)
    train = words.where(~F.col("held_out"))
    counts = staged(word_counts(train), "lm-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == END_KEY, F.col("n"))).alias("ends")).first()
    n, v, ends = totals["n"] or 0, totals["v"], totals["ends"] or 0
    size = min(max(LEAST_HEAD, isqrt(v)), MOST_HEAD)
    top = counts.where(F.col("key") != END_KEY).orderBy(F.col("n").desc(), "key").limit(size).toArrow()
    head = top.column("key").to_numpy(), top.column("n").to_numpy()
    units = Units(head[0])
    bigrams = unit_bigrams(train, units)
    label = exchange(bigrams)
    hot = np.eye(CLASSES + 1)[label]
    vocabulary = staged(word_classes(train, units, label, hot.T @ bigrams.astype(np.float64) @ hot), "lm-vocabulary")
    documents = _labelled(words, vocabulary, units, label, head)

    table = class_bigrams(documents.where(~F.col("held_out"))).astype(np.float64)
    kinds = np.bincount(label[: len(head[0])], minlength=CLASSES + 1)
    for r in vocabulary.groupBy("class").count().collect():  # at most CLASSES rows
        kinds[r["class"]] += r["count"]
    step = np.log10((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * (CLASSES + 1)))
    emit = -np.log10(table.sum(axis=0) + 0.5 * (kinds + 1))
    emit[END] = 0.0
    shared = spark.sparkContext.broadcast(step + emit)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, counts in _slices(batches, "classes"):
            before, chain, _ = _chain(_codes(batch.column(5)), counts, END)
            of = np.repeat(np.arange(len(counts)), counts + 1)
            local = np.bincount(of, weights=shared.value[before, chain], minlength=len(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(local)], ["doc_id", "held_out", "n_tokens", "n_known", "logged", "local"])

    out = documents.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logged double, local double")
    base = F.col("logged") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    total = F.col("local") + F.col("logged")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
