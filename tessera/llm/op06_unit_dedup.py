"""Line and passage deduplication: digests of normalised units are grouped globally, the earliest occurrence stays.

Units are lines and, so that a passage is found which stands within other lines in every
document, runs of ``PASSAGE`` consecutive words. Line digests are grouped with
partial minima. Of runs of words there is one for each word; they are not all
shuffled, but only those whose anchor the corpus repeats (``op10_suffix_dedup.repeats`` over hashes of the words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.op10_suffix_dedup import joined, repeats
from tessera.llm.shared import free, mix, staged
from tessera.llm.wordhash import BASE, SPACED, Words, powers, words

#: Words of a run that is a unit of its own.
PASSAGE = 50
#: Digests that stand in more than 1 of so many lines are joined by broadcast: there are at most so many of them.
HOT = 2000


def unit_dedup(docs: DataFrame, least_words: int = 1, passage: int = PASSAGE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with text reduced, and n_units, n_removed and spans; other columns are kept.

    A unit is a line of the text (between newlines). Normalised: A-Z lower-cased, white space runs one
    space, trimmed. Units of at least ``least_words`` words with equal 128-bit digests are one; the occurrence
    with the smallest (doc_id, place) stays, nulls last, and the others go with one newline each. Units are
    also the runs of ``passage`` consecutive words, across lines (0: none; words are compared by 32-bit hashes): every word of a run whose
    words stood in an earlier place goes, with the white space after it in its line; a line of which no word stays goes whole.
    All units are judged on the input. spans are the removed bytes in the original text, [start, end), maximal in a line, the
    newline of a removed line not counted; n_removed is their number, n_units counts all lines
    (0 for null and empty texts; a null text stays null). Rows with equal doc_id and text are
    one document: they keep and lose the same units. doc_id has to be a number (or null). Texts of any length are taken whole.
    Columns named like the results are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_units", "n_removed", "spans")
    a, b, lines, runs = free(docs, "a", "b", "lines", "runs")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    keyed = docs.withColumns({a: F.coalesce("doc_id", F.lit((1 << 63) - 1)), b: F.xxhash64("text", F.col("doc_id").isNull())})
    narrow = keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), "text")
    gone = _repeated_lines(narrow, least_words).select("a", "b", F.lit(False).alias("run"), "start", "end")
    if passage:
        found = repeats(narrow, 4 * passage, first=True, as_bytes=_word_bytes)
        gone = gone.union(found.select("a", "b", F.lit(True), (F.col("start") + 3).alias("start"), "end"))
    part = lambda which: F.array_sort(F.collect_set(F.when(which, F.struct("start", "end"))))
    gone = gone.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(part(~F.col("run")).alias(lines), part(F.col("run")).alias(runs))
    out = keyed.join(gone, [a, b], "left").drop(a, b)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name not in (lines, runs)]
    return out.mapInArrow(_cut(lines, runs), ", ".join([*kept, "spans array<struct<start:long,end:long>>", "n_units long", "n_removed long"]))


def _repeated_lines(keyed: DataFrame, least_words: int) -> DataFrame:
    """(a, b, start, end): the lines that have an equal one in an earlier place."""
    units = staged(keyed.mapInArrow(_units(least_words), "d1 long, d2 long, a long, b long, start long, end long"))
    total = units.count()
    place = F.struct("a", "b", "start")
    first = staged(units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(first.where(F.col("n") * HOT > total).select("d1", "d2", F.col("first").alias("hot")))  # HOT rows at most
    marked = units.join(hot, ["d1", "d2"], "left")
    again: Column = place > F.col("first")
    cold = marked.where("hot is null").join(first.where(F.col("n") * HOT <= total), ["d1", "d2"]).where(again)
    return marked.where(place > F.col("hot")).select("a", "b", "start", "end").union(cold.select("a", "b", "start", "end"))


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of a block that have words: the first word, the number of words, first byte and end in the block."""
    newline = np.flatnonzero(w.data == 0x0A)
    line = np.searchsorted(newline, w.start)
    new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1]))))
    doc = w.doc[new]
    end = np.minimum(np.concatenate((newline, [len(w.data)]))[line[new]], w.bounds[doc + 1])
    start = np.maximum(np.concatenate(([-1], newline))[line[new]] + 1, w.bounds[doc])
    return new, np.diff(np.concatenate((new, [len(line)]))), start, end


def _units(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), SPACED):
                if not len(w.hash):
                    continue
                new, size, start, end = _lines(w)
                power = powers(BASE, int(size.max()))
                at = np.arange(len(w.hash)) - np.repeat(new, size)
                d1 = mix(np.add.reduceat(w.hash * power[at], new) + size.astype(np.uint64))
                d2 = mix(np.add.reduceat(mix(w.hash ^ BASE) * power[at], new) ^ size.astype(np.uint64))
                keep = size >= least_words
                doc = w.doc[new[keep]]
                base, rows = w.bounds[doc], pa.array(doc + w.lo)
                columns = [pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64)), batch.column("a").take(rows), batch.column("b").take(rows), pa.array(start[keep] - base, pa.int64()), pa.array(end[keep] - base, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "a", "b", "start", "end"])

    return run


def _word_bytes(texts: pa.Array) -> list[bytes]:
    """Four bytes of hash for each word of each text."""
    out = []
    for w in words(texts, SPACED):
        small = (w.hash >> np.uint64(32)).astype("<u4")
        out += [small[i:j].tobytes() for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    return out


def _cut(lines: str, runs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, found = [], [], []
            for text, whole, part in zip(batch.column("text").to_pylist(), batch.column(lines).to_pylist(), batch.column(runs).to_pylist(), strict=True):
                n.append(text.count("\n") + 1 if text else 0)
                spans: list[tuple[int, int]] = []
                if whole or part:
                    # of words: [first of a run, end of it); windows off the words' bounds can't be equal but by chance, and count inwards
                    text, spans = reduced(text, {s["start"] for s in whole or ()}, joined([(s["start"] // 4, s["end"] // 4) for s in part or ()]))
                texts.append(text)
                found.append([{"start": x, "end": y} for x, y in spans])
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names if name not in (lines, runs)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            names = [x for x in batch.schema.names if x not in (lines, runs)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(n, pa.int64()), pa.array([len(x) for x in found], pa.int64())], names=[*names, "spans", "n_units", "n_removed"])

    return run


def reduced(text: str, starts: set[int], runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the lines that begin at ``starts`` and without the words of ``runs``, and the removed spans of its bytes."""
    raw = text.encode()
    gone: dict[int, list[tuple[int, int]]] = {}  # removed spans of lines, by their first byte
    if runs:
        (w,) = words(pa.array([text]), SPACED)
        removed = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(removed, [x for x, _ in runs], 1)
        np.add.at(removed, [y for _, y in runs], -1)
        removed = np.cumsum(removed)[:-1] > 0
        first, size, start, end = _lines(w)
        for k in np.flatnonzero(np.add.reduceat(removed, first)):
            own = np.arange(first[k], first[k] + size[k])
            stop = np.concatenate((w.start[own[1:]], end[k : k + 1]))
            out = removed[own]
            cuts = [(int(start[k]), int(end[k]))] if out.all() else joined([(int(x), int(y)) for x, y in zip(w.start[own][out], stop[out], strict=True)])
            gone[int(start[k])] = cuts
    at, kept, spans = 0, [], []
    for line in raw.split(b"\n"):
        end = at + len(line)
        cuts = [(at, end)] if at in starts else gone.get(at, [])
        spans += cuts
        if cuts != [(at, end)] or not line:
            pieces, x = [], at
            for lo, hi in cuts:
                pieces.append(raw[x:lo])
                x = hi
            kept.append(b"".join([*pieces, raw[x:end]]))
        at = end + 1
    return b"\n".join(kept).decode(), spans
