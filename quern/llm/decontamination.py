"""Benchmark decontamination by Wu-Manber search: shift tables, suffix buckets, direct comparison.

Operator 9. Test strings are the 10-word windows of the benchmark items (a shorter item is one window). Texts
and strings are reduced to ASCII-lower-cased words with one blank around each, as UTF-8 bytes; a block of bytes
that ends no pattern prefix gives the distance to skip, a block that ends a pattern names the bucket of
patterns to compare there. The search steps through many lanes of a batch at once with numpy, in one pass over
the documents and without a shuffle.

The benchmark is cut into blocks of at most ``block_bytes`` of text, each of which goes to the executors as one
search table; a larger benchmark takes more passes over the documents, never a larger table.

Defined results: a null or empty text has no words and no hits. A null item text, or one without words, never
occurs; items with the same text all count. A null item_id is ignored. An empty benchmark hits nothing.
Repeated documents are judged alike; null doc_ids are kept. Null or extra columns have no effect, and columns
named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

WINDOW = 10
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: By byte: what it is lower-cased; whether it belongs to a word. Bytes from 0x80 belong to code points that all do.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[65:91] = True
_IN_WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18


class Patterns:
    """Patterns of one length class, with their shift table and suffix buckets."""

    def __init__(self, texts: dict[bytes, list[int]]):
        self.bytes = list(texts)
        self.items = [texts[p] for p in self.bytes]
        self.least = min(map(len, self.bytes))
        self.block = 8 if self.least >= 16 else min(4, self.least) if self.least >= 4 else self.least
        self.shift = np.full(1 << _BITS, self.least - self.block + 1, dtype=np.int16)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(self.bytes):
            for end in range(self.block, self.least + 1):
                h = self._hash_one(p[end - self.block : end])
                self.shift[h] = min(self.shift[h], self.least - end)
            buckets.setdefault(self._hash_one(p[self.least - self.block : self.least]), []).append(k)
        self.start = np.zeros((1 << _BITS) + 1, dtype=np.int64)
        order = []
        for h in sorted(buckets):
            self.start[h + 1] = len(buckets[h])
            order += buckets[h]
        self.start = np.cumsum(self.start)
        self.order = np.array(order, dtype=np.int64)
        self.length = np.array([len(p) for p in self.bytes], dtype=np.int64)
        self.head = np.array([self._value(p[: self.block]) for p in self.bytes], dtype=np.uint64)

    @staticmethod
    def _value(b: bytes) -> int:
        return int.from_bytes(b, "little")

    def _hash_one(self, b: bytes) -> int:
        return ((self._value(b) * int(_MIX)) & (2**64 - 1)) >> (64 - _BITS)

    def blocks(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ``block`` bytes from each position as one number."""
        out = buf[at].astype(np.uint64)
        if self.block == 8:
            wide = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - 7, 8), strides=(1, 1))
            return wide[at].copy().view(np.uint64).ravel()
        for j in range(1, self.block):
            out |= buf[at + j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def search(self, buf: np.ndarray, size: int, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences in buf[:size] and the pattern of each. buf is padded by 16 bytes at least."""
        last = size - self.least
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, last + 1, lane, dtype=np.int64)
        stop = np.minimum(at + lane, last + 1)
        back = self.least - self.block
        found: list[np.ndarray] = []
        while len(at):
            key = (self.blocks(buf, at + back) * _MIX) >> np.uint64(64 - _BITS)
            jump = self.shift[key.astype(np.int64)]
            hit = jump == 0
            if hit.any():
                found.append(np.stack([at[hit], key[hit].astype(np.int64)]))
            at = at + np.maximum(jump, 1)
            keep = at < stop
            at, stop = at[keep], stop[keep]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, key = np.concatenate(found, axis=1)
        n = self.start[key + 1] - self.start[key]
        pos = np.repeat(pos, n)
        first = np.repeat(self.start[key] - np.r_[0, np.cumsum(n)[:-1]], n)
        pat = self.order[first + np.arange(len(pos))]
        fits = (pos + self.length[pat] <= size) & (self.blocks(buf, pos) == self.head[pat])
        pos, pat = pos[fits], pat[fits]
        raw = buf.tobytes()
        same = np.fromiter((raw.startswith(self.bytes[k], p) for p, k in zip(pos.tolist(), pat.tolist(), strict=True)), bool, len(pos))
        return pos[same], pat[same]


def patterns_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Search tables for (item_id, text) rows: one for full windows, one for each number of words below."""
    classes: dict[int, dict[bytes, list]] = {}
    for item, text in items:
        words = _WORD.findall((text or "").translate(_LOW))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            ids = classes.setdefault(n, {}).setdefault(f" {' '.join(words[i : i + n])} ".encode(), [])
            if item not in ids:
                ids.append(item)
    return [Patterns(texts) for _, texts in sorted(classes.items())]


def reduced(column: pa.Array) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Buffer of reduced texts, its size, the start of each document in it, the start of each word (its blank)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    # A newline after each document keeps its last word from running into the next one's first.
    raw = np.insert(raw, ends[1:], 10) if n else raw
    ends = ends + np.arange(n + 1)
    inside = _IN_WORD[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    # Kept: bytes of words, the byte after each word (as its blank), and the first byte after a document's start.
    kept = inside | before
    out = np.where(inside, _LOWER[raw], np.uint8(32))[kept]
    count = np.cumsum(kept)
    at = np.r_[0, count[ends[1:] - 1]] if n else np.zeros(1, np.int64)
    # Each document gets one more blank in front, so that every word has one on either side.
    buf = np.insert(out, at[:-1], 32)
    at = at + np.arange(n + 1)
    size = len(buf)
    buf = np.concatenate([buf, np.zeros(32, np.uint8)])
    blank = np.flatnonzero(buf[:size] == 32)
    first = blank[np.r_[buf[blank[:-1] + 1] != 32, False]] if len(blank) else blank
    return buf, size, at, first


def find_hits(column: pa.Array, tables: list[Patterns]) -> list[list[tuple[int, int, object]]]:
    """For each text (first word, end word, item) of every occurrence, in no particular order."""
    buf, size, at, words = reduced(column)
    out: list[list] = [[] for _ in range(len(column))]
    base = np.searchsorted(words, at)
    for p in tables:
        pos, pat = p.search(buf, size)
        doc = np.searchsorted(at, pos, side="right") - 1
        inside = pos + p.length[pat] <= at[doc + 1]
        lo = np.searchsorted(words, pos)
        hi = np.searchsorted(words, pos + p.length[pat] - 1)
        for d, a, b, k in zip(doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), pat[inside].tolist(), strict=True):
            out[d] += [(a - int(base[d]), b - int(base[d]), item) for item in p.items[k]]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if block and held + len(row.text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text)
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4_000_000) -> DataFrame:
    """The documents with hits: array<struct<first, end, item>> over words, one pass for each block of items."""
    out = docs.drop(*[c for c in docs.columns if c.lower() == "hits"]).withColumn("hits", F.array().cast("array<struct<first:bigint,end:bigint,item:string>>"))
    schema, columns = out.schema, out.columns
    where, text = columns.index("hits"), columns.index("text")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))
    for block in _blocks(benchmark, block_bytes):
        held = out.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            tables = patterns_of(held.value)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    hits = find_hits(part.column(text), tables)
                    rows = [
                        (old or []) + [{"first": a, "end": b, "item": str(i)} for a, b, i in sorted(new, key=lambda x: (x[0], x[1], str(x[2])))]
                        for old, new in zip(part.column(where).to_pylist(), hits, strict=True)
                    ]
                    yield part.set_column(where, "hits", pa.array(rows, kind))

        out = out.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of the input, without documents that hold a window of a benchmark item."""
    # The row goes along as one column, so that hits don't take the place of a user's column.
    return find_benchmark(docs.select("text", F.struct("*").alias("_doc")), benchmark).where(F.size("hits") == 0).select("_doc.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)

    def digest(batches):
        for batch in batches:
            n_words, n_hit, n_items, sha = [], [], [], []
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                _, _, at, words = reduced(part.column(1))
                n_words += np.diff(np.searchsorted(words, at)).tolist()
                for hits in part.column(2).to_pylist():
                    covered = set()
                    for h in hits:
                        covered.update(range(h["first"], h["end"]))
                    items = sorted({h["item"] for h in hits})
                    n_hit.append(len(covered))
                    n_items.append(len(items))
                    sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digest, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cov AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
