"""Secret scan: format rules, and novelty under a dictionary-primed compressor.

The format rules (assignments, access keys, hex strings) are regular expressions.
The novelty rule looks at strings in a sensitive context: a word such as "password"
or "token" shortly before. The cost of a candidate is the number of bytes by which
it lengthens the zstandard form of its surroundings; the compressor is primed with
the identifiers that stand in such contexts anywhere in the corpus. What repeats the
surroundings or is made of identifiers costs little; random strings cost nearly
their length or more, and are reported with kind ``novel``.

The dictionary is built from all documents: words by the number of documents in
whose contexts they stand, the most frequent first, up to ``DICTIONARY_BYTES``.

Defined cases: a null text is empty; whole texts are scanned; rows that repeat give
equal results; an empty corpus gives an empty dictionary.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed formats, in the order of kinds.
RULES = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]{16,}")),
)
KINDS = ("assign", "access", "hex", "novel")
CONTEXT = re.compile(r"(?ai)passw|secret|token|api.?key|access.?key|private.?key|credential|authorization|bearer|client.?id")
#: One of these stands in every context, in lower case.
HINTS = ("passw", "secret", "token", "key", "credential", "authorization", "bearer", "client")
ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~$!#%^&*-]{12,}")
IDENTIFIER = re.compile(r"[A-Za-z_]{3,40}")
REACH = 64
AROUND = 256
DICTIONARY_BYTES = 32_768
LEAST_COST = 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the format rules."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN):
        out += [(m.start(), 0, m.end()) for m in RULES[0][1].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in RULES[1][1].finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in RULES[2][1].finditer(text)]
    return sorted(out)


def contexts(text: str) -> list[tuple[int, int]]:
    """Where candidates may start: shortly after a sensitive word; joined ranges."""
    out: list[list[int]] = []
    low = text.lower()
    if not any(x in low for x in HINTS):
        return []
    for m in CONTEXT.finditer(text):
        if out and m.start() <= out[-1][1]:
            out[-1][1] = m.end() + REACH
        else:
            out.append([m.start(), m.end() + REACH])
    return [(a, b) for a, b in out]


class Novelty:
    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        extra = {"dict_data": known} if known else {}
        self.squeeze = zstandard.ZstdCompressor(level=6, write_content_size=False, **extra).compress

    def cost(self, text: str, start: int, end: int) -> int:
        """Bytes that the candidate adds to its compressed surroundings."""
        around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
        around = around.encode("utf-8", "surrogatepass")
        own = text[start:end].encode()
        return len(self.squeeze(around + b"\n" + own)) - len(self.squeeze(around + b"\n"))

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, done = [], 0
        for a, b in contexts(text):
            at = max(a, done)
            while (m := CANDIDATE.search(text, at)) and m.start() < b:
                at = done = m.end()
                s, e = m.span()
                while e > s and text[e - 1] in ".!=*":
                    e -= 1
                value = text[s:e]
                if any(x < e and s < y for x, _, y in taken):
                    continue
                if e - s >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and self.cost(text, s, e) >= LEAST_COST * (e - s):
                    out.append((s, 3, e))
        return out


def dictionary(docs: DataFrame, most: int = DICTIONARY_BYTES) -> bytes:
    """Identifiers of sensitive contexts in all documents, the most frequent last
    (nearest to the text, as zstandard prefers)."""

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                own = set()
                for a, b in contexts(text):
                    own.update(IDENTIFIER.findall(text[max(0, a - AROUND) : b + AROUND]))
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    words = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string")
    # the dictionary holds most / 4 words of three letters and a space at the most
    top = words.groupBy("word").agg(F.count("*").alias("docs")).where("docs > 1").orderBy(F.col("docs").desc(), "word").limit(most // 4)
    out, size = [], 0
    for r in top.collect():
        size += len(r["word"]) + 1
        if size > most:
            break
        out.append(r["word"])
    return " ".join(reversed(out)).encode()


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        novelty = Novelty(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = novelty.spans(text, base)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
