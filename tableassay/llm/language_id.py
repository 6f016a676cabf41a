"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, at each place of a text,
the longest match with that language; a text is cut greedily into such longest
matches (cross-parsing after Ziv and Merhav). The language whose automaton needs
the fewest phrases, each weighed by the log of its training length, wins.

Texts are parsed whole, in segments of ``SEGMENT`` bytes at which a phrase ends for
every language alike, so that all segments of a batch move through an automaton
together as numpy arrays.

Fitting uses a bounded sample: ``SAMPLE_ROWS`` labelled rows and ``SAMPLE_BYTES``
bytes per language, by hash of the id. Scoring covers all rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties
go to the first language in order; rows without lang teach nothing; without any
labelled row every document is ``und``; columns that clash are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableassay.llm.shared import aside, fold
from tableassay.llm.tokens import LOWER, pieces, text_bytes

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 64
SAMPLE_BYTES = 24_000
SEGMENT = 256
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")

#: Bytes as symbols: ASCII letters in lower case, bytes beyond ASCII as they are, else a space.
_FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)


def folded(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions state x symbol of the minimal automaton of all substrings; 0: none.
    State 0 is a sink, state 1 the start."""
    link, length, moves = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in symbols:
        current = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = current
            p = link[p]
        if not p:
            link[current] = 1
        else:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    table = np.zeros((len(moves), alphabet), np.int32)
    for state, to in enumerate(moves):
        for c, q in to.items():
            table[state, c] = q
    return table


def phrases(table: np.ndarray, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases that each row of ``segments`` needs; rows sorted by falling length.
    A symbol unknown to the automaton is a phrase of its own."""
    flat, width = table.reshape(-1), table.shape[1]
    start = flat[width : 2 * width]
    state = np.ones(len(segments), np.int32)
    count = np.zeros(len(segments), np.int32)
    live = np.searchsorted(-lengths, -np.arange(segments.shape[1]), side="left")
    for i in range(segments.shape[1]):
        n = int(live[i])
        if not n:
            break
        c = segments[:n, i]
        to = flat[state[:n].astype(np.int64) * width + c]
        stuck = np.flatnonzero(to == 0)
        if len(stuck):
            again = start[c[stuck]]
            # what was matched so far ends a phrase, unless nothing was
            count[stuck] += state[stuck] != 1
            count[stuck] += again == 0
            to[stuck] = np.where(again == 0, 1, again)
        state[:n] = to
    return count + (state != 1)


class CrossParser:
    """Automata of several languages."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        texts = [folded(np.frombuffer(samples[x], np.uint8)) for x in self.languages]
        seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint8)
        self.symbol = np.zeros(256, np.uint8)  # 0: in no language
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.tables = [suffix_automaton(self.symbol[t].tolist(), len(seen) + 1) for t in texts]
        self.weights = np.array([np.log2(len(t) + 2) for t in texts])

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per byte, texts x languages."""
        sizes = np.diff(offsets)
        per = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(sizes)), per)
        index = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[of] + index * SEGMENT
        length = np.minimum(SEGMENT, offsets[of + 1] - begin)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        padded = np.concatenate([self.symbol[folded(data)], np.zeros(SEGMENT, np.uint8)])
        segments = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[begin] if len(begin) else np.zeros((0, SEGMENT), np.uint8)
        out = np.zeros((len(sizes), len(self.tables)))
        for k, table in enumerate(self.tables):
            count = phrases(table, segments, length)
            out[:, k] = np.bincount(of, weights=count, minlength=len(sizes)) * self.weights[k]
        return out / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Labelled text by language, of at most ``rows`` rows and ``size`` bytes each.

    The hash limit leaves a few times ``rows`` per language before they are ranked,
    however many rows a language has."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang-1")), F.lit(1 << 40))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # the limits are literals of the plan, so rows beyond them go at the scan, before any shuffle
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, 4 * rows / n) * (1 << 40)))) for k, n in counts.items()])
    few = learn.withColumn("draw", draw).where(F.col("draw") <= limit)
    first = Window.partitionBy("lang").orderBy("draw", F.length("text"), "text")
    few = few.select("lang", "draw", F.substring("text", 1, size).alias("text")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows)
    texts: dict[str, list[bytes]] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    out = {}
    for lang, parts in texts.items():
        # every row gives its share, so that no long text fills the sample
        share = max(256, size // max(1, len(parts)))
        cut = b" ".join(p[:share] for p in parts)
        for p in parts:
            if len(cut) >= size:
                break
            cut += b" " + p[share:]
        if cut.strip():
            out[lang] = cut[:size]
    return out


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred and score."""
    added = ("lang_pred", "score")
    docs = docs.select([c for c in docs.columns if c not in added])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(CrossParser(samples))
    schema = docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit(0.0)}).schema

    def run(batches):
        parser = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                column = batch.column(batch.schema.names.index("text"))
                data, offsets = text_bytes(column)
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
                if parser.languages:
                    rates = parser.rates(data, offsets)
                    best = rates.argmin(axis=1)
                    score = 1 / np.exp2(4 * (rates.min(axis=1)[:, None] - rates)).sum(axis=1)
                    names = [parser.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                else:
                    names, score = [UNDETERMINED] * len(letters), np.zeros(len(letters))
                score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = identify(docs.select("doc_id", "text"), sample(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language."""
    plain, back = aside(docs, "text")
    return identify(plain, sample(docs)).where(F.col("lang_pred") != UNDETERMINED).select(back)
