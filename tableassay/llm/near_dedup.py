"""Near-duplicate documents by HyperMinHash.

A text is its set of distinct word shingles. Equal sets become one node first, so
groups of exact copies cost nothing further. Each node keeps a HyperMinHash sketch:
the hash picks a register, which stores the leading-zero count and four mantissa bits
of its smallest hash. Bands of registers form buckets; for them, an empty register of a
small set borrows a filled one.

1. Star round: a bucket's centre is its most frequently met member; each node is
   verified on full sets against the most popular centre it meets.
2. Pairs that share a bucket but no component yet are generated, except those that
   cannot be linked: by their sizes, or, if both were verified against one centre, by how
   they differ from it. A node is also verified against its root, the centre of its
   centre's centre and so on, so that all of a large group share one. Where A and B are the shingles in which two sets differ from the
   centre, they differ from each other in |A| + |B| - 2 |A and B|; bit masks of A and B
   bound the last term from above, so the bound drops no link. The Jaccard estimate,
   corrected for register collisions, drops a pair only six standard deviations below
   the limit; the others are verified on full sets.

All pairs within one component are thus never formed, and no bucket is capped. At a
similarity of 0.8 two sets miss all 96 bands of 9 registers with probability about 1e-6.

Defined cases: null and empty texts have an empty set, are linked with nothing and
form a component each; fewer than ``k`` words form one shingle; rows with one doc_id
and different texts are different nodes; a null doc_id takes part, and its component
id is the smallest doc_id reachable, null if there is none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableassay.llm.shared import aside, staged
from tableassay.llm.tokens import LOWER, U, Words, mix, pieces, text_bytes

BANDS, ROWS = 96, 9
REGISTERS = BANDS * ROWS
MANTISSA = 4
EMPTY = np.uint8(0xFF)
SHINGLE, PERCENT = 4, 80
_STEP = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(LOWER[data], offsets)
    h = words.hashes()
    step = np.resize(_STEP, k) + np.arange(k, dtype=np.uint64) * U(2)
    n = max(0, len(h) - k + 1)
    joint = np.zeros(n, np.uint64)
    for i in range(k):
        joint += mix(h[i : i + n] * step[i] + U(i + 1))
    joint = mix(joint)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            own = U(b - a)
            for i in range(a, b):
                own = mix(np.array([own], np.uint64) * U(0x9E3779B97F4A7C15) + h[i])[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: the top of a hash picks the register; the smallest
    rehashed value is kept as leading zeros and mantissa."""
    out = np.full(REGISTERS, EMPTY)
    if not len(s):
        return out
    place = ((s >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    least = np.minimum.reduceat(mix(s ^ U(0x5851F42D4C957F2D)), first)
    fraction, exponent = np.frexp(least.astype(np.float64) + 1.0)
    zeros = np.clip(65 - exponent, 0, 14)
    out[place[first]] = (zeros << MANTISSA) | ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64)
    return out


#: For each register, the places of all registers in an order of its own, and that order.
_PLACE = (mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)) >> U(32)).astype(np.uint32).reshape(REGISTERS, REGISTERS)
_ORDER = _PLACE.argsort(axis=1, kind="stable").astype(np.int16)
#: Sets with fewer filled registers than these try them all.
_FEW = 48


def band_keys(registers: np.ndarray) -> np.ndarray:
    """For each set (a row of registers) one 64-bit key per band. An empty register borrows
    the filled one that is first in an order of its own, so that registers of small sets
    agree independently, too."""
    held = registers != EMPTY
    rows, size = registers.copy(), held.sum(axis=1)
    for i in np.flatnonzero((size > 0) & (size < _FEW)).tolist():
        empty, filled = np.flatnonzero(~held[i]), np.flatnonzero(held[i])
        rows[i, empty] = registers[i, filled[_PLACE[np.ix_(empty, filled)].argmin(axis=1)]]
    of, empty = np.nonzero(~held & (size >= _FEW)[:, None])
    step = 0
    while len(of):
        first = _ORDER[empty, step]
        found = held[of, first]
        rows[of[found], empty[found]] = registers[of[found], first[found]]
        of, empty = of[~found], empty[~found]
        step += 1
    rows = rows.reshape(-1, BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, i].astype(np.uint64))
    return key


#: Chance that two different minima of a register compress alike: the sum over leading
#: zeros z of (2^-z-1)^2 / 2^MANTISSA, about a third of 2^-MANTISSA.
COLLISION = 1 / (3 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of rows of registers, and six standard deviations of it."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1).clip(1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    share = same / used
    return ((share - COLLISION) / (1 - COLLISION)).clip(0), 6 * np.sqrt(0.25 / used)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the whole set), regs of every row."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = shingles(*text_bytes(batch.column(1)), k)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(digest, pa.binary()), pa.array([sketch(s).tobytes() for s in found], pa.binary())],
                    ["doc_id", "n_shingles", "set_id", "regs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, regs binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                keys = band_keys(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, REGISTERS))
                node, size = (np.repeat(part.column(i).to_numpy(), BANDS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.reshape(-1).view(np.int64), node, size)], ["key", "node", "n"])

    return nodes.select("node", "n_shingles", "regs").mapInArrow(run, "key long, node long, n long")


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and full set of the wanted nodes, made again from one text each."""
    need = nodes.join(wanted, "node").select("node", F.col("doc_id").alias("_id"), "set_id")
    held = need.join(docs.select("doc_id", "text"), F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "set_id", "text")

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = shingles(*text_bytes(batch.column(2)), k)
                keep = [i for i, (s, d) in enumerate(zip(found, batch.column(1).to_pylist(), strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["node", "set"])

    return held.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule a link out."""
    regs = nodes.select("node", "regs")
    both = pairs.join(regs.select(F.col("node").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("node").alias("b"), F.col("regs").alias("rb")), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            value, slack = estimate(a, b)
            keep = pa.array(value + slack >= percent / 100)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _both_sets(batch: pa.RecordBatch):
    """The sets in columns 2 and 3 of each row, read where they lie."""
    for x, y in zip(batch.column(2), batch.column(3), strict=True):
        yield np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in _both_sets(batch):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


#: Longs of a mask of differing shingles.
MASKS = 8
_MASK = [f"m{i}" for i in range(MASKS)]
_FAR = [f"f{i}" for i in range(MASKS)]


def mask(apart: np.ndarray) -> np.ndarray:
    """Bits of the shingle hashes, by their top."""
    bit = apart >> U(64 - (MASKS * 64 - 1).bit_length())
    out = np.zeros(MASKS, np.uint64)
    np.bitwise_or.at(out, (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.view(np.int64)


def _measured(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, its centre b, whether they are linked, in how many shingles they differ, their mask."""
    both = star.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            linked, differ, masks = [], [], np.zeros((batch.num_rows, MASKS), np.int64)
            for i, (x, y) in enumerate(_both_sets(batch)):
                apart = np.setxor1d(x, y, assume_unique=True)
                linked.append((100 - percent) * (len(x) + len(y)) >= (100 + percent) * len(apart))
                differ.append(len(apart))
                masks[i] = mask(apart)
            columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(differ, pa.int64()), *(pa.array(m) for m in masks.T)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "differ", *_MASK])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean, differ long, " + ", ".join(f"{m} long" for m in _MASK))


def _possible(percent: int) -> Column:
    """Whether sides x and y of a bucket, of which n and the distances are known, may be linked."""
    total = F.col("x.n") + F.col("y.n")

    def near(centre: str, differ: str, masks: list[str]) -> Column:
        def alone(one: str, other: str) -> Column:
            left = sum((F.bit_count(F.col(f"{one}.{m}").bitwiseAND(F.bitwise_not(f"{other}.{m}"))) for m in masks), F.lit(0))
            return F.col(f"{one}.{differ}") - left

        apart = F.col(f"x.{differ}") + F.col(f"y.{differ}") - 2 * F.least(alone("x", "y"), alone("y", "x"))
        tried = (F.col(f"x.{centre}") == F.col("y.node")) | (F.col(f"y.{centre}") == F.col("x.node"))
        return ~tried & ((F.col(f"x.{centre}") != F.col(f"y.{centre}")) | ((100 + percent) * apart <= (100 - percent) * total))

    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    return sizes & near("centre", "differ", _MASK) & near("root", "far", _FAR)


def _roots(star: DataFrame) -> DataFrame:
    """node and root, the end of its chain of centres, by doubling steps; each centre
    is met more often than the nodes it is of, so a chain has an end."""
    roots = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        ahead = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = staged(roots.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "near-roots")
        roots = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return roots


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node with a link.

    Each round takes the smallest label around and then the label of the label, so
    the rounds grow with the logarithm of the longest chain."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "near-links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around, labels["node"] == around["a"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = staged(step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "old"), "near-labels")
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id of every row."""
    rows = staged(_sets(docs, k), "near-rows")
    filled = rows.where("set_id IS NOT NULL")
    # one node per distinct set, held by its smallest doc_id
    holder = filled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    nodes = filled.join(holder.withColumnRenamed("doc_id", "_least"), "set_id").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    nodes = nodes.groupBy("set_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    # read twice: for the keys that are shared and for their members
    buckets = staged(_buckets(nodes), "near-buckets")
    shared = buckets.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    members = staged(buckets.join(shared, "key"), "near-members")

    fame = members.groupBy("node").agg(F.sum("met").alias("fame"))
    famed = members.join(fame, "node")
    centre = famed.groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("back"))).alias("centre"))
    star = famed.join(centre, "key").where((-F.col("centre")["back"]) != F.col("node"))
    star = star.groupBy("node").agg(F.max("centre").alias("centre")).select(F.col("node").alias("a"), (-F.col("centre")["back"]).alias("b"))
    star = staged(star, "near-star")

    sets = staged(_full_sets(docs, nodes, members.select("node").distinct(), k), "near-sets")
    tried = staged(_measured(star, sets, percent), "near-checked")
    links = tried.where("linked").select("a", "b")
    comp = components(links)

    labelled = members.join(comp, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_members = staged(labelled.join(mixed, "key"), "near-open")
    own = tried.select(F.col("a").alias("node"), F.col("b").alias("centre"), "differ", *_MASK)
    wanted = open_members.select("node").distinct().join(_roots(star), "node").join(own, "node")
    near = wanted.where("root = centre").select("node", "root", F.col("differ").alias("far"), *[F.col(m).alias(f) for m, f in zip(_MASK, _FAR, strict=True)])
    beyond = staged(_measured(wanted.where("root <> centre").select(F.col("node").alias("a"), F.col("root").alias("b")), sets, percent), "near-beyond")
    links = links.union(beyond.where("linked").select("a", "b"))
    near = near.union(beyond.select("a", "b", "differ", *_MASK))
    # a node without a centre is one, and does not differ from itself
    side = open_members.join(own, "node", "left").join(near, "node", "left")
    side = side.withColumns({"centre": F.coalesce("centre", "node"), "root": F.coalesce("root", "node")}).fillna(0, ["differ", *_MASK, "far", *_FAR])
    same_key = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp"))
    pairs = side.alias("x").join(side.alias("y"), same_key & _possible(percent))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = _verified(_estimated(pairs, nodes, percent), sets, percent)
    more = staged(more, "near-checked")
    if more.limit(1).count() or beyond.where("linked").limit(1).count():
        comp = components(links.union(more))

    named = nodes.select("node", "set_id", "doc_id").join(comp, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "comp").select("set_id", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component: the first by doc_id and text.

    Shingles of five words unless told otherwise; empty rows are kept."""
    found = near_duplicates(docs, k, percent)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    kept = staged(kept, "near-kept")
    plain, back = aside(docs, "doc_id", "text")
    chosen = plain.join(kept, plain["doc_id"].eqNullSafe(kept["_id"]))
    if not kept.where("_n > 1").limit(1).count():
        return chosen.select(back)
    # rows that repeat an id: one of each text stays
    again = chosen.where("_n > 1").select(back).dropDuplicates(["doc_id", "text"])
    return chosen.where("_n = 1").select(back).unionByName(again)
