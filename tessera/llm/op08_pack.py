"""Mixture-controlled packing: deficit round-robin over source queues, windows of exact token proportions.

1. Documents are tokenised once; each partition's rows carry where they begin in the
   partition's queue of their source. The ids are written to the shared folder.
2. Totals by (partition, source), summed in order, say where each partition's part of a
   source's queue begins. Ids are never shuffled.
3. Deficit round-robin in closed form: at tick t of a common clock source s has been
   granted floor(weight_s * t / TICKS) tokens (no more than it has). The grants that a
   window of ``size`` tokens ends with are those of the tick at which all grants reach
   its end; what that tick grants beyond goes, in the order of sources, to the next
   window. So the deficits carried into any window follow from its number alone, and
   every partition cuts its own documents without waiting for another.

Every window but the last is full; the last is padded only up to ``size`` unless its
length is a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import staged

#: Grants (windows x sources) that are computed at once.
CELLS = 1 << 20
#: Totals that go to every task as a broadcast, in rows; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Characters of text that the tokenizer gets at once; longer texts are cut where no token can cross.
AT_ONCE = 1 << 20

_ENCODING: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of the tokenizer file at ``path`` (json): its vocabulary as ranks, and its added tokens.

    The ids are those that ``tokenizers`` gives with add_special_tokens=False (tests compare them); the strings of
    added tokens that stand in a text are these tokens, as there.
    """
    if path not in _ENCODING:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:  # part of the installed tokenizers, on every executor
            told = json.load(file)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that the file writes as themselves; the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
        _ENCODING[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODING[path]


def grants(totals: np.ndarray, weights: np.ndarray, size: int, windows: np.ndarray) -> np.ndarray:
    """Tokens that each source has given to the windows before each of ``windows``: one row per window, one column per source.

    All in integers, monotone in the window's number, at most ``totals``; rows sum to
    size * window (all tokens at most).
    """
    ticks = 1 << max(8, 61 - int(max(int(weights.max()), 1)).bit_length())
    over = int(max((-(-int(t) * ticks // int(w)) for t, w in zip(totals, weights, strict=True) if t), default=0))  # by then all is granted

    def at(t: np.ndarray) -> np.ndarray:
        hi, lo = t[:, None] // ticks, t[:, None] % ticks
        return np.minimum(weights * hi + weights * lo // ticks, totals)

    total = int(totals.sum())
    target = np.minimum(windows.astype(np.int64) * size, total)
    low, high = np.zeros(len(target), np.int64), np.full(len(target), over, np.int64)
    if total and (weights == totals).all():  # grants then follow a line, each at most one token below it
        line = target * (ticks / total)
        slack = (len(totals) + 2) * (ticks / total) + line * 1e-12 + 2
        low, high = np.maximum(line - slack, 0).astype(np.int64), np.minimum(line + slack, over).astype(np.int64)
    while (low < high).any():  # the first tick by which all grants reach the target
        mid = (low + high) // 2
        reached = at(mid).sum(1) >= target
        high = np.where(reached, mid, high)
        low = np.where(reached, low, np.minimum(mid + 1, high))
    before = at(np.maximum(high - 1, 0))
    before[high == 0] = 0
    last = at(high) - before
    return before + _shared_out(last, target - before.sum(1))


def _shared_out(last: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``rest`` of the grants of one tick: in proportion if they are many, what then remains in the order of sources."""
    given = np.zeros_like(last)
    while last.size and last.max() > 1:  # the same again within the tick, until it grants single tokens
        fine = 1 << min(40, 61 - int(last.max()).bit_length())
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), fine, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            reached = (last * mid[:, None] // fine).sum(1) >= rest
            high = np.where(reached, mid, high)
            low = np.where(reached, low, np.minimum(mid + 1, high))
        step = last * np.maximum(high - 1, 0)[:, None] // fine
        last, rest, given = last * high[:, None] // fine - step, rest - step.sum(1), given + step
    ahead = np.cumsum(last, 1) - last
    return given + np.clip(rest[:, None] - ahead, 0, last)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, source, sequence_id, offset): the pieces of each row of ``docs`` (doc_id, text, source).

    A document's ids are those of its text (null: none) in the tokenizer file ``vocabulary`` and then ``end_id``; ids is the piece's ids as little-endian
    unsigned 32-bit. Sequences have ``size`` ids, the last one what is left. ``weights`` are the
    target shares of the sources (default: their shares of all tokens, so that all queues end together); where a
    source runs out the others fill up in proportion. A null source is the source ''. Repeated
    rows are packed each. An empty table gives an empty result. Every source has a queue of its own, however many there
    are: the work grows with windows times sources, and the driver and each task hold one total per source.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    kind = "<u2" if max(encoding(vocabulary).max_token_value, end_id) < 1 << 16 else "<u4"
    told = staged(docs.mapInArrow(_tokenised(vocabulary, end_id, kind), "part int, doc_id long, source string, begin long, doc_tokens long, ids binary"))
    totals = staged(told.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")))
    return _cut_up(told, totals, size, weights, kind)


def _cut_up(told: DataFrame, totals: DataFrame, size: int, weights: dict[str, float] | None, kind: str = "<u2") -> DataFrame:
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = totals.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("part", "source", "base")
    if totals.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    by_source = {r.source: r.n for r in totals.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row per source
    names = sorted(by_source)
    have = np.array([by_source[x] for x in names], np.int64)
    if weights is None:
        share = have
    else:
        top = max((weights.get(x, 0.0) for x in names), default=0.0) or 1.0
        # a tick then grants at most one token of a source, and no number of ticks leaves 64 bits
        share = np.array([max(1, by_source[x] >> 31, round(weights.get(x, 0.0) / top * (1 << 30))) for x in names], np.int64)
    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, source string, sequence_id long, offset long"
    return told.join(before, ["part", "source"]).select("doc_id", "source", "doc_tokens", "ids", (F.col("base") + F.col("begin")).alias("at")).mapInArrow(_pieces(names, have, share, size, kind), shape)


def _tokenised(vocabulary: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}
        coder = encoding(vocabulary)
        encode = lambda piece: coder.encode(piece, allowed_special="all")
        for b in batches:
            begin, n, packed = [], [], []
            for text, source in zip(b.column("text").to_pylist(), b.column("source").to_pylist(), strict=True):
                ids = np.array([*(x for piece in _cut_text(text or "") for x in encode(piece)), end_id], kind)
                at = ends.get(source, 0)
                begin.append(at)
                n.append(len(ids))
                packed.append(ids.tobytes())
                ends[source] = at + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), b.column("doc_id"), b.column("source"), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["part", "doc_id", "source", "begin", "doc_tokens", "ids"])

    return run


def _cut_text(text: str) -> Iterator[str]:
    """The text in pieces that the tokenizer's first split keeps apart in any case: a letter, then one space, then a letter."""
    lo = 0
    while len(text) - lo > AT_ONCE:
        cut = lo + AT_ONCE
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def _pieces(names: list[str], have: np.ndarray, share: np.ndarray, size: int, kind: str):
    number = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, n = b.column("at").to_numpy(), b.column("doc_tokens").to_numpy()
            s = np.array([number[x] for x in b.column("source").to_pylist()])
            first, last = _windows(at, s, have, share, size), _windows(at + n - 1, s, have, share, size)
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            window = first[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            every, where = np.unique(window, return_inverse=True)
            start, end, ahead = _bounds(have, share, size, every, where, s[row])
            lo = np.maximum(start, at[row])
            hi = np.minimum(end, at[row] + n[row])
            full = hi > lo
            row, window, start, ahead, lo, hi = (x[full] for x in (row, window, start, ahead, lo, hi))
            offset = ahead + lo - start
            ids = b.column("ids").to_pylist()
            a, e = (lo - at[row]).tolist(), (hi - at[row]).tolist()
            cut = [np.frombuffer(ids[r], kind)[x:y].astype("<u4").tobytes() for r, x, y in zip(row.tolist(), a, e, strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), pa.array(a, pa.int64()), pa.array(hi - lo), pa.array(cut, pa.binary()), b.column("doc_tokens").take(take), b.column("source").take(take), pa.array(window), pa.array(offset)], ["doc_id", "start", "length", "ids", "doc_tokens", "source", "sequence_id", "offset"])

    return run


def _parts(windows: np.ndarray, where: np.ndarray, sources: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, pairs, place): slices of ``windows`` with ``CELLS`` grants or a single window, the pairs that point into each and where."""
    step = max(1, CELLS // max(sources, 1))
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(0, len(windows) + step, step))
    for k in range(len(edges) - 1):
        pairs = order[edges[k] : edges[k + 1]]
        yield windows[k * step : (k + 1) * step], pairs, where[pairs] - k * step


def _granted(have: np.ndarray, share: np.ndarray, size: int, windows: np.ndarray, where: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What source ``s`` has given before window ``windows[where]``, for each pair."""
    out = np.empty(len(where), np.int64)
    for some, pairs, place in _parts(windows, where, len(have)):
        out[pairs] = grants(have, share, size, some)[place, s[pairs]]
    return out


def _bounds(have: np.ndarray, share: np.ndarray, size: int, windows: np.ndarray, where: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ahead) for each pair: what source ``s`` has given before and after window ``windows[where]``, and what the sources before it give within."""
    start, end, ahead = (np.empty(len(where), np.int64) for _ in range(3))
    for some, pairs, place in _parts(windows, where, len(have)):
        first, last = grants(have, share, size, some), grants(have, share, size, some + 1)
        before = np.cumsum(last - first, 1) - (last - first)
        start[pairs], end[pairs], ahead[pairs] = (x[place, s[pairs]] for x in (first, last, before))
    return start, end, ahead


def _windows(at: np.ndarray, s: np.ndarray, have: np.ndarray, share: np.ndarray, size: int) -> np.ndarray:
    """The window that holds token ``at`` of source ``s``: the last one before which at most ``at`` tokens were granted."""
    total = int(have.sum())
    low, high = np.zeros(len(at), np.int64), np.full(len(at), total // size, np.int64)
    if (share == have).all():
        per = total / (have[s] * float(size))  # windows in which the source gives one token
        slack = (len(have) + 2) * per + at * per * 1e-12 + 2
        low, high = np.maximum(at * per - slack, 0).astype(np.int64), np.minimum(at * per + slack, total // size).astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        every, where = np.unique(mid, return_inverse=True)
        early = _granted(have, share, size, every, where, s) <= at
        low, high = np.where(early, mid, low), np.where(early, high, mid - 1)
    return low
