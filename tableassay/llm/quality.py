"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each word has a sparse index vector drawn from its hash. The ``VOCABULARY`` most
frequent words also have a context vector: the sum of the index vectors of their
neighbours in all documents. A text is the mean of its words' vectors, with the
shares of a few word shapes and repeats. Two dense layers give a logit, divided
by a temperature that a part of the labelled rows kept aside calibrates.

Word counts, context vectors and features cover all documents; the network is fitted
on a bounded sample of labelled rows (``SAMPLE``, by hash of the id).

Defined cases: null and empty texts have the zero vector and a score all the same;
a null quality teaches nothing; without labels of both kinds the score is the share
of label 1, or 0.5; a repeated label counts again; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.llm.shared import fold, staged
from tableassay.llm.tokens import U, Words, mix, pieces, text_bytes

FOLDS, HELD_OUT = 3, 1
VOCABULARY = 2048
DIM, NONZERO = 64, 4
SHAPES = 64
WIDTH = DIM + SHAPES + 4
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH = 32, 30, 256


def _index(hashes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the j-th non-zero of each word's index vector."""
    x = mix(hashes + U(0x632BE59BD9B4E019 * (j + 1) % (1 << 64)))
    return (x % U(DIM)).astype(np.int64), 1.0 - 2.0 * ((x >> U(40)) & U(1)).astype(np.float64)


def _shape(words: Words) -> np.ndarray:
    """Classes of the first and last byte and of the length."""
    kind = np.full(256, 3)
    kind[97:123], kind[65:91], kind[128:] = 0, 1, 0
    kind[48:58] = 2
    size = words.end - words.start
    return kind[words.data[words.start]] * 16 + kind[words.data[words.end - 1]] * 4 + (size > 3) + (size > 9) + (size > 25)


def _words(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    data, offsets = text_bytes(batch.column(batch.schema.names.index("text")))
    words = Words(data, offsets)
    return words, words.hashes()


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                found, n = np.unique(_words(batch)[1].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["hash", "n"])

    counts = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "hash").limit(size).collect()
    return np.sort(np.array([r["hash"] for r in top], np.int64))


def _ids(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place in the vocabulary, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    hashes = hashes.view(np.int64)
    at = np.searchsorted(known, hashes).clip(0, len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def contexts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """Unit context vectors of the vocabulary over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        total = np.zeros(len(known) * DIM)
        for whole in batches:
            for batch in pieces(whole, "text"):
                words, hashes = _words(batch)
                ids = _ids(known, hashes)
                pair = words.of[1:] == words.of[:-1]
                for to, near in ((ids[:-1], hashes[1:]), (ids[1:], hashes[:-1])):
                    use = pair & (to >= 0)
                    for j in range(NONZERO):
                        place, sign = _index(near[use], j)
                        total += np.bincount(to[use] * DIM + place, weights=sign, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells].astype(np.int64))], ["cell", "x"])

    out = np.zeros(len(known) * DIM)
    if len(known):
        found = docs.select("text").mapInArrow(run, "cell int, x long").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
        out[found.column("cell").to_numpy()] = found.column("x").to_numpy()
    out = out.reshape(-1, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) * np.sqrt(NONZERO)


def features(docs: DataFrame, known: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """doc_id and x, the pooled features, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((known, vectors))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, vectors = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                words, hashes = _words(batch)
                n, of = batch.num_rows, words.of
                pooled = np.zeros(n * DIM)
                for j in range(NONZERO):
                    place, sign = _index(hashes, j)
                    pooled += np.bincount(of * DIM + place, weights=sign, minlength=n * DIM)
                pooled = pooled.reshape(n, DIM)
                ids = _ids(known, hashes)
                has = ids >= 0
                if has.any():
                    cells, times = np.unique(of[has] * np.int64(len(known)) + ids[has], return_counts=True)
                    rows, words_in = np.divmod(cells, len(known))
                    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                    pooled[rows[edges]] += np.add.reduceat(vectors[words_in] * times[:, None], edges, axis=0)
                count = np.maximum(words.counts, 1)[:, None]
                pooled /= count
                shapes = np.bincount(of * SHAPES + _shape(words), minlength=n * SHAPES).reshape(n, SHAPES) / count if len(of) else np.zeros((n, SHAPES))
                again = np.zeros(n)
                if len(of) > 1:
                    again = np.bincount(of[1:], weights=(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]), minlength=n)
                # distinct words: sort by text and hash, count first ones
                order = np.lexsort((hashes, of))
                h, o = hashes[order], of[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                distinct = np.bincount(o[fresh], minlength=n)
                unknown = np.bincount(of[~has], minlength=n)
                extra = np.stack([again / count[:, 0], distinct / count[:, 0], unknown / count[:, 0], np.log1p(words.counts) / 10], axis=1)
                x = np.concatenate([pooled, shapes, extra], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, n * WIDTH + 1, WIDTH, dtype=np.int32)), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


class Network:
    """Input, a hidden tanh layer, one logit; standardised input, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 7):
        self.rest = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y[~aside])) == 2
        if not self.fitted:
            return
        fit, t = x[~aside], y[~aside]
        self.mean, self.scale = fit.mean(axis=0), fit.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        z, step = (fit - self.mean) / self.scale, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for k in range(0, len(z), BATCH):
                step += 1
                b = order[k : k + BATCH]
                h = np.tanh(z[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t[b]) / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            logit, t = self.logit(x[aside]), y[aside]
            loss = lambda c: float(np.mean(np.logaddexp(0, logit / c) - t * logit / c))
            self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.rest)
        return 1 / (1 + np.exp(-(self.logit(x) / self.temperature).clip(-60, 60)))


def fit(pooled: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    """The network from at most about ``most`` labelled rows that are not held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "quality")
    n = usable.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality-1")), F.lit(1 << 40))
    sample = usable.withColumn("draw", draw).where(F.col("draw") < int(min(1.0, most / max(1, n)) * (1 << 40)))
    rows = pooled.join(sample, "doc_id").orderBy("draw", "doc_id").limit(most).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if rows.num_rows else np.zeros((0, WIDTH))
    y = rows.column("quality").to_numpy().astype(np.float64)
    return Network(x.astype(np.float64), y, rows.column("draw").to_numpy() % 5 == 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    known = vocabulary(docs)
    pooled = staged(features(docs, known, contexts(docs, known)), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(pooled, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x.astype(np.float64)))], ["doc_id", "score"])

    scored = pooled.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
