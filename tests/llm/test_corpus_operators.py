"""Phrases, shards and the filter audit against brute force and on edge rows."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableassay.llm import filter_audit, near_dedup, phrases, sharding, tokens

DOCS = "doc_id long, text string, lang string, source string, slot string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    long = "one two three four five, " * 20_000
    rows = [(3, None, "en", "a"), (2, "", None, None), (None, "one two three", "en", "b"), (4, long, "en", None), (4, long, "en", None), (5, "one two", "de", "a"), (1, "", "de", "a")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def expected_phrases(rows, least, percent=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for d in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + d])] += 1
    out = []
    for lang, found in counts.items():
        often = {g: a for g, a in found.items() if a >= least}
        covered = Counter()
        for g, a in often.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        covered[g[i:j]] = max(covered[g[i:j]], a)
        rated = []
        for g, a in often.items():
            if len(g) > 1 and not (covered[g] and 100 * covered[g] >= percent * a):
                score, _, left, right = min((1000 * a * totals[lang] // (often[g[:k]] * often[g[k:]]), k, often[g[:k]], often[g[k:]]) for k in range(1, len(g)))
                rated.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (s, a, g, left, right) in enumerate(sorted(rated)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("percent, top", [(100, 2000), (60, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, percent, top):
    # small slices, combined often, and groups split at three words
    monkeypatch.setattr(phrases, "BUDGET", 20)
    draw = random.Random(3)
    vocabulary = ["the", "Of", "a", "über", "x\x01y", "new", "york", "city", "z"]
    rows = [(i, "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "\t", "  ", ", ", "\n"]) for _ in range(draw.randint(0, 80))), draw.choice(["en", "en", "de", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=15, percent=percent, top=top).collect())
    assert got == expected_phrases([r[1:] for r in rows], 15, percent, top)
    assert len(got) > 15


def test_phrases_on_odd_rows(odd):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.mine(odd).collect()) == expected_phrases(rows, 100)
    assert phrases.mine(odd.where("false")).collect() == []


def test_runs_pass_every_frequent_phrase(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in phrases.mine(docs, least=30).collect())
    assert got == expected_phrases([(r["text"], r["lang"]) for r in docs.collect()], 30)


def test_small_runs_of_rows_and_ranges_equal_brute_force(spark, monkeypatch):
    # tables of more slots than the texts need, so that a task has many ranges, and batches of few rows
    monkeypatch.setattr(phrases, "_ROWS", 3)
    monkeypatch.setattr(phrases, "_bits", lambda tokens: 25)
    draw = random.Random(5)
    rows = [(" ".join(draw.choice("abcdefgh") for _ in range(40)), draw.choice(["en", None])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert sorted(tuple(r) for r in phrases.mine(docs, least=12).collect()) == expected_phrases(rows, 12)


def test_suffixes_sent_are_frequent_runs_once_per_core(spark, monkeypatch):
    # 64 pairs of about 180 occurrences and 512 triples of about 23, in more splits than cores
    sent, leaves = [], phrases._leaves
    monkeypatch.setattr(phrases, "_leaves", lambda *args: sent.append(leaves(*args).collect()) or leaves(*args))
    draw = random.Random(8)
    rows = [(" ".join(draw.choice("abcdefgh") for _ in range(40)), "en") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(60)
    assert sorted(tuple(r) for r in phrases.mine(docs, least=90).collect()) == expected_phrases(rows, 90)
    pairs = Counter(w for text, _ in rows for w in zip(text.split()[:-1], text.split()[1:], strict=True))
    assert len(pairs) == 64 and min(pairs.values()) >= 90
    assert sum(r["n"] for r in sent[0]) == 300 * 39
    assert not any(r["w3"] for r in sent[0])
    assert len(sent[0]) <= 64 * spark.sparkContext.defaultParallelism


def test_triples_cut_only_what_is_rare(spark):
    text = "a b c d e a b x d e"
    docs = spark.createDataFrame([(text, "en")] * 5 + [("b c d", "en"), ("c d e", "en"), ("d e", "en")], "text string, lang string").repartition(3)
    words, seed = phrases._words(docs)
    sieve = phrases.Filter(seed, 20)
    sieve.add(spark, phrases._flags(words.select(F.shiftrightunsigned("code", 44).alias("slot")), 20))
    for size in (2, 3):
        sieve.add(spark, phrases._flags(phrases._slots(docs, sieve, 6, size).select("slot"), 20))
    # a b, b c, c d and d e occur 6 times or more, b c d and c d e 6 times, a b c and d e a 5 times
    found = phrases.Pieces(pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([text, "c", ""])], ["lang", "text"]), seed)
    assert sieve.runs(found).tolist() == [2, 4, 3, 2, 1, 2, 1, 1, 2, 1, 1]
    assert [r["n"] for r in phrases._slots(docs, sieve, 6, 3).collect()] == [6, 6]


def test_pair_counts_reach_the_limit_and_are_exact(spark):
    docs = spark.createDataFrame([("a b", "en")] * 7 + [("a b c", "en")] * 5, "text string, lang string").repartition(4)
    words, seed = phrases._words(docs)
    sieve = phrases.Filter(seed, 20)
    sieve.add(spark, phrases._flags(words.select(F.shiftrightunsigned("code", 44).alias("slot")), 20))
    counts = {least: sorted(r["n"] for r in phrases._slots(docs, sieve, least).collect()) for least in (1, 6, 12, 13)}
    assert counts == {1: [5, 12], 6: [12], 12: [12], 13: []}


def test_combining_holds_rows_less_than_twice():
    text = pa.RecordBatch.from_arrays([pa.array(["x"] * 20)], ["text"])
    read = lambda batch: (np.ones(100_000, np.int64), np.ones(100_000, np.int64))
    tracemalloc.start()
    try:
        total = sum(len(x[-1]) for x in phrases._combined((text.slice(i, 1) for i in range(20)), read, list, 2_000_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 32 MB of rows, and one of their two columns again
    assert total == 2_000_000 and peak < 52e6


def test_a_slice_of_text_takes_bounded_memory(monkeypatch):
    monkeypatch.setattr(tokens, "_powers", {})
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 200] * 2000)], ["text"])
    tracemalloc.start()
    try:
        tokens.span_hashes(np.zeros(5, np.uint8), np.array([0]), np.array([5]))
        small = tracemalloc.get_traced_memory()[0]
        n = sum(len(s) for b in tokens.pieces(batch, "text") for s in near_dedup.shingles(*tokens.text_bytes(b.column(0)), 4))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 * 5 and small < 1e6 and peak < 90e6


@pytest.fixture(scope="module")
def sharded(spark):
    """A source with a third of the rows, a middle one, many of one row, a null one."""
    of = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'middle' WHEN id % 2 = 0 THEN concat('s', id) END")
    docs = spark.range(3001).select(F.col("id").alias("doc_id"), F.expr("repeat('é', int(id % 50))").alias("text"), of.alias("source"))
    return docs, [r.asDict() for r in sharding.assign(docs, shards=7).collect()]


def test_shards_hold_the_mixture(sharded):
    docs, rows = sharded
    assert sorted(r["doc_id"] for r in rows) == list(range(3001))
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    sizes, cells = Counter(r["source"] for r in rows), Counter((r["source"], r["shard"]) for r in rows)
    # 500 sources of one row stand where chance puts them: about nine rows a cut, dealt by size
    assert all(abs(cells[name, s] - n / 7) < 30 for name, n in sizes.items() if n > 1 for s in range(7))
    large = [r.asDict() for r in sharding.assign(docs.where("source IN ('hot', 'middle')"), shards=7).collect()]
    sizes, cells = Counter(r["source"] for r in large), Counter((r["source"], r["shard"]) for r in large)
    assert all(abs(cells[name, s] - n / 7) < 2 for name, n in sizes.items() for s in range(7))
    # sources of one row are spread, not all in the middle
    alone = Counter(r["shard"] for r in rows if r["source"] and r["source"].startswith("s"))
    assert min(alone.values()) > sum(alone.values()) / 7 / 2
    assert all(r["size"] == 2 * (r["doc_id"] % 50) + 16 and r["grown_shard"] is None and r["law"] == "rows" for r in rows)


def test_shards_are_the_same_in_other_partitions(sharded, spark):
    docs, rows = sharded
    again = sharding.assign(docs.repartition(13, "text"), shards=7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_shards_of_odd_rows(odd):
    out = sharding.assign(odd, shards=3)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", *[c for c in sharding.RESULTS]]
    rows = out.collect()
    assert len(rows) == 7 and sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 3]
    assert {r["size"] for r in rows if not r["text"]} == {16} and {r["text_crc32"] for r in rows if not r["text"]} == {0}
    assert sharding.report(odd.where("false")).collect() == []
    few = sharding.report(odd, shards=40).collect()
    assert len({r["shard"] for r in few}) == 7 and {r["slot"] for r in few} == {0}


def test_shards_are_written_in_order(spark, sharded, tmp_path):
    docs, rows = sharded
    sharding.write_shards(docs, str(tmp_path / "out"), shards=7, files=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    files = back.withColumn("f", F.input_file_name()).groupBy("f").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("s"), (F.max("slot") - F.min("slot") + 1).alias("span")).collect()
    assert len(files) > 7 and all(r["s"] == 1 and r["span"] == r["n"] for r in files)


def expected_audit(rows, labels):
    """Row by row: every order applied literally."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))

    def fails(i, text):
        text = text or ""
        words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }

    parts = defaultdict(list)
    for i, text, lang in rows:
        parts[lang or ""].append((i, fails(i, text)))
    out = []
    for part, held in parts.items():
        share, mine = Counter(), []
        for order in permutations("ABCDE"):
            left = held
            for s, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                failing = [x for x in held if x[1][f]]
                share[f] += len(gone)
                mine.append((part, "".join(order), s + 1, len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*r[:-1], share[r[-1]]) for r in mine]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "PAGE", 5)
    monkeypatch.setattr(filter_audit, "_HELD", 7)
    draw = random.Random(5)
    texts = [None, "", "a b", "WHO # is", "word " * 300, " ".join(f"w{i}" for i in range(250)), "é " * 200 + "$", "A" + " b" * 250]
    rows = [(draw.randint(0, 150) if draw.random() > 0.05 else None, draw.choice(texts), draw.choice(["en", "de", None])) for _ in range(300)]
    labels = [(draw.randint(0, 150), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(100)]
    # file by file, ids mostly fall, so that later files retract what earlier ones counted
    parts = sorted(rows, key=lambda r: -(r[0] or 0))
    for k in range(6):
        part = spark.createDataFrame(parts[k * 50 : (k + 1) * 50], "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(spark, str(tmp_path / "docs"), known, batches=6)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())
    # a repeated id has the labels of all its rows
    assert got == expected_audit(rows, labels)
    changes = filter_audit.counters(spark, str(tmp_path / "docs"), known, batches=6)
    assert changes.agg(F.sum("n")).first()[0] == 300


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "none"))
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, str(tmp_path / "none"), known).collect() == []


def test_masks_of_a_very_long_text():
    text = "w" * 10 + " "
    one = (text * 300_000).encode()
    import numpy as np

    data = np.frombuffer(one, np.uint8)
    assert filter_audit.masks(data, np.array([0, len(one)])).tolist() == [2]
    assert math.isclose(len(one), 3_300_000)
