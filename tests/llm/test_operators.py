"""The operators against brute force, plain SQL, held-out labels and edge rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableassay.llm import brown_lm, decontaminate, language_id, line_dedup, mixing, near_dedup, pii, quality, secrets, topk
from tableassay.llm.oracle import oracle_sql
from tableassay.llm.queries import queries
from workload.check import compare, connect


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, a clashing column."""
    long = "word " * 30_000
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "plain words here and there", "en", "b"), (4, long, "en", None), (4, long, "en", None), (5, "x", "en", "a")]
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) is None


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def test_pii_base_equals_brute_force(docs):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(v):
        d = [int(c) for c in re.sub("[^0-9]", "", v)][::-1]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    checks = [lambda v: True, lambda v: all(int(x) <= 255 for x in v.split(".")), luhn, lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15]
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for r in docs.collect():
        spans = [(m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, r["text"]) if checks[k](m[0])]
        assert found[r["doc_id"]]["base_sha256"] == digest(spans, pii.KINDS)
        assert [found[r["doc_id"]][f"n_{x}"] for x in pii.KINDS] == [sum(k == i for _, k, _ in spans) for i in range(4)]


def test_pii_learns_from_context_and_adds_other_formats(spark):
    plain = [
        ("call +1 415 555 {n:04d} today", 0),
        ("we reached +1 415 555 {n:04d} today", 0),
        ("mail bob{n}@example.com now", 0),
        ("for bob{n}@example.com now", 0),
    ]
    other = [
        ("call 415 555 {n:04d} today", "415 555 {n:04d}", "plusless"),
        ("they wrote 415 555 {n:04d} today", "415 555 {n:04d}", "plusless"),
        ("mail eve{n} at example dot com now", "eve{n} at example dot com", "address"),
        ("for eve{n}(at)example(dot)com now", "eve{n}(at)example(dot)com", "address"),
        ("host 2001:db8:0:1:2:3:4:{n:x} is up", "2001:db8:0:1:2:3:4:{n:x}", "colons"),
        ("from 2001:db8:0:1:2:3:4:{n:x} it came", "2001:db8:0:1:2:3:4:{n:x}", "colons"),
    ]
    clean = ["run 12:30 to 14:45 on 2024-01-05", "order 8842-{n} weighs 12.5 kg", "see section 3.1.4 and page {n}"]
    texts, expected = [], {}
    for n in range(1, 601):
        for form, _ in plain:
            texts.append((len(texts), form.format(n=n)))
        for form, span, name in other:
            text, span = form.format(n=n), span.format(n=n)
            expected[len(texts)] = f"{name}:{text.index(span)}:{text.index(span) + len(span)}"
            texts.append((len(texts), text))
        for form in clean:
            texts.append((len(texts), form.format(n=n)))
    found = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        spans = found[i]["spans"].split(",")
        assert expected[i] in spans if i in expected else found[i]["n_added"] == 0, (text, spans)


def test_pii_adds_nothing_where_no_cue_is_known(spark):
    texts = [(i, f"bob{i}@example.com and 415 555 {i:04d}") for i in range(300)]
    assert {r["n_added"] for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {0}


def test_pii_takes_texts_of_many_matches(spark):
    text = "mail user@example.com, " * 100_000
    begin = time.monotonic()
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_email"], row["base_sha256"]) == (100_000, digest([(23 * i + 5, 0, 23 * i + 21) for i in range(100_000)], pii.KINDS))
    assert time.monotonic() - begin < 60  # about 30 here, a third of it whatever the text


def test_pii_marks_candidates_beside_base_spans(spark):
    base = "array<struct<start:int,kind:int,end:int>>"
    more = "array<struct<start:int,generator:int,end:int,code:int,cue:boolean>>"
    draw = random.Random(5)
    rows = []
    for i in range(200):
        spans = sorted({(draw.randrange(400), draw.randrange(4), draw.randrange(1, 30)) for _ in range(draw.choice((0, 5, 150)))})
        rows.append((i, [(s, k, s + n) for s, k, n in spans], [(s, 0, s + draw.randrange(1, 30), 7, True) for s in (draw.randrange(400) for _ in range(draw.choice((0, 4, 200))))]))
    df = spark.createDataFrame(rows, f"id int, base {base}, more {more}")
    for r in df.select("id", "base", pii._beside(F.col("base"), F.col("more")).alias("out")).collect():
        assert sorted((x["start"], x["end"]) for x in r["out"]) == sorted((s, e) for s, _, e, _, _ in rows[r["id"]][2])
        for x in r["out"]:
            before = [b for b in r["base"] if b["start"] <= x["start"]]
            later = sorted((b["start"], b["end"]) for b in r["base"] if b["start"] > x["start"])
            shared = max([min(b["end"], x["end"]) - x["start"] for b in before] + [min(e, x["end"]) - s for s, e in later if s == later[0][0]], default=0)
            assert x["touches"] == any(b["start"] < x["end"] and x["start"] < b["end"] for b in r["base"])
            if len({s for s, _ in later}) == len(later):
                assert x["known"] == (shared * 5 >= (x["end"] - x["start"]) * 4)


def test_secret_base_equals_brute_force_and_novelty_adds(spark, docs):
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    for r in docs.collect():
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r["text"]) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r["text"]) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", r["text"]) if len(m[0]) >= 16]
        assert found[r["doc_id"]]["base_sha256"] == digest(spans, secrets.KINDS)
    text = "the client credential is kQ9z7LpX2vR8sTqW1mYb and the token was token_value_1 token_value_1 token_value_1"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = text.index("kQ9z")
    assert row["spans"] == f"novel:{at}:{at + 20}"


def test_language_model_base_and_gain(docs):
    rows = docs.collect()
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])), None] for r in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for i in train:
        for w in tokens[i]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for r in brown_lm.score(docs).collect():
        words = tokens[r["doc_id"]]
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(words), n, sum(w in counts for w in words))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def test_language_model_classes_and_score_equal_brute_force(docs, monkeypatch):
    # a head of 40 words and 50 words known to the tasks, so that most words go by the join
    for name, value in {"LEAST_HEAD": 40, "MOST_HEAD": 40, "KEPT": 10}.items():
        monkeypatch.setattr(brown_lm, name, value)
    classes, end = brown_lm.CLASSES, brown_lm.END
    words = brown_lm.word_keys(docs)
    chains = {r["doc_id"]: (r["held_out"], list(r["words"])) for r in words.collect()}
    counts = collections.Counter(w for held, chain in chains.values() if not held for w in chain)
    head = sorted(counts, key=lambda w: (-counts[w], w))[:40]
    train = words.where("NOT held_out")
    units = brown_lm.Units(np.array(head))
    unit = lambda w: head.index(w) if w in head else 40 + (w & 127)
    bigrams = np.zeros((units.end + 1, units.end + 1))
    for held, chain in chains.values():
        path = [units.end, *map(unit, chain), units.end]
        for a, b in zip(path, path[1:]) if not held else ():
            bigrams[a, b] += 1
    assert (brown_lm.unit_bigrams(train, units) == bigrams).all()
    label = brown_lm.exchange(bigrams)
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (label[:, None], label[None, :]), bigrams)
    gains = brown_lm.gains(table)
    around = {}
    for held, chain in chains.values():
        path = [end, *(label[unit(w)] for w in chain), end]
        for i, w in enumerate(chain) if not held else ():
            if w not in head:
                around.setdefault(w, []).append((path[i], path[i + 2]))
    want = {w: int(np.argmax([sum(gains[a, k] + gains[classes + 1 + b, k] for a, b in at) for k in range(classes)])) for w, at in around.items()}
    got = {r["key"]: (r["class"], r["n"]) for r in brown_lm.word_classes(train, units, label, table).collect()}
    assert got == {w: (k, counts[w]) for w, k in want.items()} and len(got) == len(counts) - 40  # no training word without a class
    own = {**want, **{w: label[unit(w)] for w in head}}
    paths = {i: [end, *(own.get(w, label[unit(w)]) for w in chain), end] for i, (_, chain) in chains.items()}
    table = np.zeros((classes + 1, classes + 1))
    for i, path in paths.items():
        for a, b in zip(path, path[1:]) if not chains[i][0] else ():
            table[a, b] += 1
    kinds = collections.Counter(own.values())
    for r in brown_lm.score(docs).collect():
        path, total = paths[r["doc_id"]], 0.0
        for a, b, w in zip(path, path[1:], [*chains[r["doc_id"]][1], None]):
            total += np.log10((table[a, b] + 0.5) / (table[a].sum() + 0.5 * (classes + 1)))
            if w is not None:
                total += np.log10((counts.get(w, 0) + 0.5) / (table[:, b].sum() + 0.5 * (kinds[b] + 1)))
        assert r["score"] == pytest.approx(total, rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-total / r["n_tokens"]), rel=1e-6)


def test_exchange_raises_the_likelihood():
    counts = np.random.default_rng(3).poisson(0.4, (60, 60)) + 9 * np.kron(np.eye(6)[[1, 2, 3, 4, 5, 0]], np.ones((10, 10)))

    def likelihood(label, k):
        hot = np.eye(k)[label]
        table = hot.T @ counts @ hot
        log = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return log(table) - log(table.sum(axis=0)) - log(table.sum(axis=1))

    runs = [likelihood(brown_lm.exchange(counts, 7, sweeps), 8) for sweeps in range(6)]
    assert runs == sorted(runs) and runs[-1] > runs[0]


def test_line_dedup_equals_brute_force(docs):
    texts = sorted((r["doc_id"], r["text"].split("\n")) for r in docs.collect())
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    found = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    seen, must = set(), {}
    for i, lines in texts:
        for p, line in enumerate(lines):
            if count(line) >= line_dedup.WORDS and line in seen:
                must.setdefault(i, set()).add(p)
            seen.add(line)
    earlier = set()
    for i, lines in texts:
        gone = {int(x) for x in found[i]["removed"].split(",") if x}
        assert must.get(i, set()) <= gone
        assert found[i]["n_lines"] == len(lines)
        for p, line in enumerate(lines):
            assert p not in gone or line in earlier  # nothing is lost
            earlier.add(line)
        assert found[i]["text_sha256"] == hashlib.sha256("\n".join(x for p, x in enumerate(lines) if p not in gone).encode()).hexdigest()


def test_repeated_lines_equal_line_by_line_extension():
    rng = np.random.default_rng(5)
    for _ in range(200):
        own, old = (rng.integers(0, 3, rng.integers(1, 40)) for _ in range(2))
        words, expected = rng.integers(0, 5, len(own)), set()
        met = [(i, j) for i in range(len(own)) for j in range(len(old)) if own[i] == old[j] and rng.random() < 0.2]
        for i, j in met:
            a, b = i, i
            while a and a + j - i and own[a - 1] == old[a - 1 + j - i]:
                a -= 1
            while b < len(own) and b + j - i < len(old) and own[b] == old[b + j - i]:
                b += 1
            expected |= set(range(a, b)) if words[a:b].sum() >= 9 else set()
        here, there = np.array(met, np.int64).reshape(-1, 2).T
        assert set(line_dedup.repeated(own, old, words, here, there, 9).tolist()) == expected


def test_fingerprints_are_last_minima_of_windows():
    rng = np.random.default_rng(6)
    for _ in range(100):
        hashes, words = rng.integers(0, 4, 30), rng.integers(0, 4, 30)
        rank, expected = near_dedup.mix(hashes.view(np.uint64)), set()
        for start in range(30):
            ends = [e for e in range(start, 31) if words[start:e].sum() >= 7]
            if ends:
                expected.add(ends[0] - 1 - int(np.argmin(rank[start : ends[0]][::-1])))
        assert line_dedup.fingerprints(hashes, words, 7) == sorted(expected)


def test_line_dedup_of_long_texts_of_equal_lines_and_clashing_columns(spark):
    text = "\n".join(["the same five words here"] * 40_000)
    rows = [(1, text, 1, 2, 3), (2, text, 1, 2, 3), (3, "a line of its own", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, cut int, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup.shortened(docs).collect()}
    assert sorted(got) == [1, 3] and got[3].asDict() == docs.where("doc_id = 3").first().asDict()
    assert got[1]["text"] == "the same five words here"


def test_line_dedup_equals_brute_force_over_runs_of_lines_at_every_earlier_place(spark):
    rng = np.random.default_rng(11)
    # frequent short lines stand between rarer ones, some of them long or blank
    common = ["", "a", "two words", "three words here"]
    rare = [" ".join([f"r{i}"] * int(rng.choice([1, 4, 9, 30, 60]))) for i in range(60)]
    line = lambda: common[rng.integers(4)] if rng.random() < 0.4 else rare[rng.integers(60)]
    shared = [[line() for _ in range(rng.integers(3, 25))] for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [shared[rng.integers(12)] if rng.random() < 0.5 else [line() for _ in range(rng.integers(1, 12))] for _ in range(rng.integers(1, 5))]
        cut = [x[rng.integers(0, 3) :] for x in parts]
        texts.append([y for x in cut for y in x] or [""])
    seen, expected = set(), []
    for lines in texts:
        words, gone = [len(x.split()) for x in lines], set()
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) >= line_dedup.WORDS]
        for a, b in runs:  # by start, so that what stands earlier in the text is seen
            if tuple(lines[a:b]) in seen:
                gone |= set(range(a, b))
            seen.add(tuple(lines[a:b]))
        expected.append(",".join(map(str, sorted(gone))))
    rows = [(i, "\n".join(x)) for i, x in enumerate(texts)]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(expected)) and sum(map(bool, expected)) > 20


def test_filters_leave_clashing_columns_alone(spark):
    rows = [(1, "clean words in a row here", "en", "a", "x", "y", 2.5, "z"), (2, "and another text of words", "en", "b", "x", "y", 1.5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, items string, _n string, score double, node string")
    items = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (language_id.known(docs), line_dedup.shortened(docs), near_dedup.one_of_each(docs), decontaminate.clean(docs, items)):
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert sorted(map(tuple, out.collect())) == rows


def test_held_out_accuracy(spark, sf_dir, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in language_id.predict(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in quality.classify(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.8


def test_automaton_gives_longest_matches():
    table = language_id.suffix_automaton([1, 2, 1, 1, 2, 3], 5)
    for text, expected in (([1, 2, 1, 1, 2, 3], 1), ([2, 3, 1, 2], 2), ([4, 4], 2), ([3, 1, 3], 3)):
        assert language_id.phrases(table, np.array([text], np.uint8), np.array([len(text)]))[0] == expected


def test_wu_manber_finds_all():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 4000, dtype=np.uint8))
    patterns = list({text[i : i + n] for i, n in zip(rng.integers(0, 3900, 60), rng.integers(3, 60, 60), strict=True)})
    expected = {(i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i)}
    assert set(decontaminate.WuManber(patterns).search(text)) == expected


def test_blocks_of_patterns_agree(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = decontaminate.report(docs, items)
    many = decontaminate.report(docs, items, block_bytes=60_000, blocks_per_job=2)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_seats_are_highest_quotients(spark):
    votes = [53, 24, 23, 7, 0, 901]
    df = spark.createDataFrame([(i, float(v), 37, 1) for i, v in enumerate(votes)], "place int, v double, total long, one int")
    got = {r["place"]: r["seats"] for r in mixing.seats(df, ["one"], "v", "total", "place").collect()}
    ranked = sorted(((-v / (2 * k - 1), i) for i, v in enumerate(votes) if v for k in range(1, 80)))[:37]
    assert got == {i: sum(j == i for _, j in ranked) for i in range(len(votes))}


def test_edge_rows(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "plain words here")], "item_id long, text string")
    labels = spark.createDataFrame([(1, None), (5, 1)], "doc_id long, quality int")
    runs = {
        "secrets": lambda d: secrets.scan(d),
        "leaks": lambda d: decontaminate.report(d, items),
        "lm": lambda d: brown_lm.score(d),
        "quality": lambda d: quality.classify(d, labels),
        "pii": lambda d: pii.detect(d),
        "lines": lambda d: line_dedup.report(d),
        "language": lambda d: language_id.predict(d),
        "near": lambda d: near_dedup.report(d),
        "mix": lambda d: mixing.mix(d),
    }
    for name, run in runs.items():
        assert run(edge).count() == 6, name
        assert run(empty).count() == 0, name
    near = {r["doc_id"]: r for r in near_dedup.report(edge).collect()}
    assert near[1]["n_shingles"] == 0 and near[1]["kept"] and near[4]["n_shingles"] == 1
    mixed = mixing.mix(edge).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    assert {r["lang_pred"] for r in language_id.predict(edge).where("doc_id <= 2").collect()} == {"und"}
    assert language_id.known(edge).columns == edge.columns == line_dedup.shortened(edge).columns == near_dedup.one_of_each(edge).columns


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (None, [0.5, 0.5]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, None), (0, 3, 50), (50, 1, 0), (50, 2, 7), (50, 3, None)]


def ranked(rows, k=5):
    """query_id, rank, vec_id, score by scoring every pair."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for at, (i, q) in enumerate(whole):
        if i % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(whole) if other != at)
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(others[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e4, 2e5])
def test_topk_scores_are_exact_at_any_size_and_of_repeated_rows(spark, size):
    draw = random.Random(3)
    rows = [(i, [size * draw.uniform(-1, 1) for _ in range(24)]) for i in range(300)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, row string, score int").repartition(4)
    got = [tuple(r) for r in topk.nearest(df).collect()]
    assert sorted(got) == ranked(rows)


def test_topk_of_nothing_and_beyond_64_bits(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.nearest(spark.createDataFrame([], schema)).count() == 0
    for value in (1e10, 1e300, -1e300):
        with pytest.raises(ValueError, match="64 bits"):
            topk.nearest(spark.createDataFrame([(0, [value, 1.0]), (1, [1.0, 1.0])], schema))


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        seen.append(out.count())
        docs = out if _ != "mix" else docs
    assert seen == sorted(seen, reverse=True) and seen[3] > 0.7 * seen[0]


def test_near_duplicates_of_a_group_of_edited_copies_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    base, rows = list(rng.choice(words, 120)), []
    for i in range(300):
        text = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            text[at] = words[rng.integers(400)]
        rows.append((i, " ".join(text)))
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)})
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(rows))} and len(set(got.values())) > 5


def test_short_texts_at_the_limit_are_linked(spark):
    # 5, 10 and 20 shingles against 4, 8 and 16 of them: a similarity of exactly 0.8
    texts = [[f"w{i}x{j}" for j in range(n + 3)] for i in range(300) for n in (5, 10, 20)]
    rows = [(2 * i + half, " ".join(w[: len(w) - half * (len(w) - 3) // 5])) for i, w in enumerate(texts) for half in (0, 1)]
    rows = [(i, t.replace("w", f"w{i // 2}y")) for i, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_bound_of_two_sets_never_exceeds_their_distance():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
    bits = lambda m: sum(bin(int(x) & (2**64 - 1)).count("1") for x in m)
    for size in (1, 40, 500):
        a, b = (np.unique(rng.choice(hashes, size)) for _ in range(2))
        ma, mb = near_dedup.mask(a), near_dedup.mask(b)
        shared = min(len(a) - bits(ma & ~mb), len(b) - bits(mb & ~ma))
        assert shared >= len(np.intersect1d(a, b))
