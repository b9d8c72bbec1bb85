"""Benchmark decontamination by Wu-Manber search over words.

Every ``window`` consecutive words of an item are a pattern (a shorter item is one
pattern of its own length). Per pattern length there is a shift table over hashed
two-word blocks: how far a search may move on when a block ends there. Only where the
shift is 0 the bucket of the block's hash is looked up, and its patterns are compared
word by word, then byte by byte. The search of a batch moves many cursors at once.

Items are searched for in parts of at most ``PART`` bytes of text, one pass over the
documents for each, so that what every task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free, staged
from tessera.llm.wordhash import ALNUM, BASE, LOWER, Words, folded, words

#: Bytes of item texts searched for in one pass.
PART = 4 << 20
#: Entries of a shift table, and positions that one cursor covers.
TABLE, STRETCH = 1 << 17, 512


@dataclass
class Patterns:
    """The patterns of one length: word hashes, bytes, items; shift table and buckets."""

    length: int
    block: int = 2
    rows: dict[bytes, set[str]] = field(default_factory=dict)
    hashes: list[np.ndarray] = field(default_factory=list)

    def add(self, text: bytes, hashes: np.ndarray, item: str) -> None:
        if text not in self.rows:
            self.rows[text] = set()
            self.hashes.append(hashes)
        self.rows[text].add(item)

    def build(self) -> None:
        self.block = min(2, self.length)
        self.texts, self.items = list(self.rows), [sorted(x) for x in self.rows.values()]
        table = np.stack(self.hashes)
        far = self.length - self.block + 1
        self.shift = np.full(TABLE, far, np.int64)
        for j in range(self.length - 1, self.block - 2, -1):
            np.minimum.at(self.shift, blocks_of(table[:, j - self.block + 1 : j + 1]) & np.uint64(TABLE - 1), self.length - 1 - j)
        whole = np.array([folded(row, self.length)[0] for row in table])
        end = blocks_of(table[:, self.length - self.block :])
        turn = np.lexsort((whole, end))
        self.end, self.whole, self.turn = end[turn], whole[turn], turn
        self.table = table[turn]


def blocks_of(table: np.ndarray) -> np.ndarray:
    """One hash for each row of one or two word hashes."""
    return folded(table[:, 0], 1) if table.shape[1] == 1 else folded(table.ravel(), 2)[::2]


def patterns(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for w in words(pa.array([t for _, t in items], pa.string()), ALNUM):
        for i in range(w.hi - w.lo):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            size = min(window, hi - lo)
            if size:
                found = by_length.setdefault(size, Patterns(size))
                for at in range(lo, hi - size + 1):
                    found.add(spelled(w, at, size), w.hash[at : at + size], items[w.lo + i][0])
    for p in by_length.values():
        p.build()
    return list(by_length.values())


def spelled(w: Words, at: int, size: int) -> bytes:
    return b" ".join(LOWER[w.data[w.start[j] : w.end[j]]].tobytes() for j in range(at, at + size))


def occurrences(w: Words, p: Patterns) -> Iterator[tuple[int, int]]:
    """(first word, pattern) of every occurrence in the block, by skipping."""
    m, count = p.length, np.diff(w.first)
    if len(w.hash) < m:
        return
    ends = blocks_of(np.lib.stride_tricks.sliding_window_view(w.hash, p.block)) if p.block == 1 else folded(w.hash, 2)
    ends = np.concatenate((np.zeros(p.block - 1, np.uint64), ends))  # of the block that ends at each word
    docs = np.flatnonzero(count >= m)
    low, high = w.first[docs] + m - 1, w.first[docs + 1]
    number = -(-(high - low) // STRETCH)
    cursor = np.repeat(low, number) + STRETCH * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    limit = np.minimum(cursor + STRETCH, np.repeat(high, number))
    found = []
    while len(cursor):
        step = p.shift[(ends[cursor] & np.uint64(TABLE - 1)).astype(np.int64)]
        found.append(cursor[step == 0])
        cursor = cursor + np.maximum(step, 1)
        going = cursor < limit
        if not going.all():
            cursor, limit = cursor[going], limit[going]
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(p.end, ends[at], "left"), np.searchsorted(p.end, ends[at], "right")
    at, lo, size = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    which = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    first = np.repeat(at, size) - m + 1
    for j in range(m):  # word by word; what differs is gone before the next comparison
        same = w.hash[first + j] == p.table[which, j]
        first, which = first[same], which[same]
    for a, k in zip(first.tolist(), p.turn[which].tolist(), strict=True):
        if spelled(w, a, m) == p.texts[k]:
            yield a, k


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, hits and items for each row; other columns are kept.

    Words are runs of letters, digits and characters beyond ASCII; A-Z count as a-z. hits are the maximal
    runs [start, end) of words that lie in an occurrence of a pattern; items the sorted ids, as strings, of
    the items with an occurrence. Null and empty texts have no words. Items without id or words are left
    out; an id that repeats is one item. Columns of ``docs`` named like the results are replaced.
    """
    docs = docs.drop("n_words", "hits", "items")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART))
    shape = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hits": F.lit(None).cast("array<struct<start:long,end:long>>"), "items": F.lit(None).cast("array<string>")})
    names = ", ".join([*kept, shape])
    if parts == 1:
        return out.mapInArrow(_searched(patterns([(r.item_id, r.text) for r in items.collect()], window)), names)
    # a large benchmark: a pass over the texts for each part of it, one part's tables alive at a time; passes hand on only rows with hits
    (row,) = free(docs, "row")
    told = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = told.select(row, "text", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    met = []
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about PART bytes
        found = narrow.mapInArrow(_searched(patterns([(r.item_id, r.text) for r in mine], window)), f"`{row}` long, text string, {shape}")
        met.append(staged(found.where(F.size("hits") > 0).select(row, "hits", "items")))
    every = reduce(DataFrame.union, met).groupBy(row).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = told.join(every, row, "left").select(*docs.columns, F.lit(None).cast("long").alias("n_words"), "hits", "items")
    return out.mapInArrow(_searched([]), names)


def _searched(found: list[Patterns]):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hits, items = [], [], []
            before = list(zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True))
            for w in words(b.column("text"), ALNUM):
                mark, names = np.zeros(len(w.hash) + 1, np.int64), {}
                for p in found:
                    for at, k in occurrences(w, p):
                        mark[at] += 1
                        mark[at + p.length] -= 1
                        names.setdefault(int(w.doc[at]), set()).update(p.items[k])
                hit = np.cumsum(mark[:-1]) > 0
                for i in range(w.hi - w.lo):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    n.append(hi - lo)
                    old, own = before[w.lo + i]
                    mine = hit[lo:hi]
                    for s in old or ():
                        mine[s["start"] : s["end"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                    hits.append([{"start": a, "end": e} for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    items.append(sorted(names.get(i, set()) | set(own or ())))
            columns = [b.column(i) for i in range(b.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

    return run
