"""Toxic passages by maximum-scoring segments over token log-odds.

Units are words (letters, A-Z lower-cased) and their first 4 to 8 bytes, for inflected and
compound forms. A unit's score is its log-odds between toxic and clean training texts
under an informative Dirichlet prior (the rates over all documents, labelled or not), counted as 0 where its
z-value is small, less ``DRIFT``: a running sum over clean text then falls. A word has
the score of its longest known unit. All maximal-scoring segments of a text are found in
linear time (Ruzzo and Tompa, 1999). In clean text the best segment of n words follows an
extreme-value law with scale 1/lambda and location ln(K n)/lambda (Karlin and Altschul,
1990); lambda solves the moment equation over clean training words, K is fitted. A
segment's significance is lambda * score - ln(K n); those above 0 are passages. A logistic
regression over the best one, the passages' sum and their number gives the score;
it is fitted on rows whose segments come from units of the other half of the training rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import added_up, mix
from tessera.llm.wordhash import BASE, LETTERS, Words, byte_values, powers, words

#: Labelled rows that the model is fitted on, at most (those of the smallest hash of doc_id).
SAMPLE = 16_000
#: Training texts that must hold a unit, weight of the prior (in words of an average class), least z-value.
LEAST_TEXTS, PRIOR, LEAST_Z = 4, 200_000.0, 2.5
DRIFT = 0.35
#: Pieces in which the counts of units are added up.
PIECES = 16
PREFIXES = (4, 5, 6, 7, 8)
_SALTS = mix(np.arange(100, 100 + max(PREFIXES), dtype=np.uint64))


@dataclass
class Model:
    """Sorted units with their scores; lambda, ln K; weights of (1, best, sum, number)."""

    units: np.ndarray
    scores: np.ndarray
    scale: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray | None = None
    constant: float | None = None  # the score of every text where there is nothing to learn from


def units_of(w: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For the block's distinct words: their units, the longest first (0: none), and for each word of the block which it is."""
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    values, power = byte_values(), powers(BASE, max(PREFIXES))
    so_far, found = np.zeros(len(first), np.uint64), {}
    last = max(len(w.data) - 1, 0)
    for j in range(max(PREFIXES)):
        so_far = so_far + values[w.data[np.minimum(start + j, last)]] * power[j]
        if j + 1 in PREFIXES:
            found[j + 1] = np.where(size > j + 1, mix(so_far ^ _SALTS[j]), np.uint64(0))
    return first, [w.hash[first], *(found[n] for n in sorted(PREFIXES, reverse=True))], which


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, as (start, end, score), by Ruzzo and Tompa's linear scan over the positive scores."""
    after = np.cumsum(scores)
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest below with a smaller sum before
    for t in np.flatnonzero(scores > 0).tolist():
        right = float(after[t])
        left = right - float(scores[t])
        start = t
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                break
            start, left = stack[at][0], stack[at][2]
            del stack[at:]
            at = len(stack) - 1
        stack.append((start, t + 1, left, right, at))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def word_scores(w: Words, m: Model) -> np.ndarray:
    if not len(w.hash) or not len(m.units):
        return np.full(len(w.hash), -DRIFT)
    _, units, which = units_of(w)
    score, open_ = np.zeros(len(units[0])), np.ones(len(units[0]), bool)
    for u in units:
        at = np.minimum(np.searchsorted(m.units, u), len(m.units) - 1)
        hit = open_ & (m.units[at] == u) & (u != 0)
        score[hit] = m.scores[at[hit]]
        open_ &= ~hit
    return score[which] - DRIFT


def evidence(scores: np.ndarray, m: Model) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(1, best, sum, number) of a text and its passages (start, end, significance)."""
    found = segments(scores)
    base = m.log_k + np.log(max(len(scores), 1))
    marked = [(a, b, m.scale * s - base) for a, b, s in found]
    passages = [x for x in marked if x[2] > 0]
    best = max((x[2] for x in marked), default=-base)
    return np.array([1.0, np.tanh(best / 8) * 8, np.log1p(sum(x[2] for x in passages)), np.log1p(len(passages))]), passages


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labelled rows (labels: doc_id, toxic 0 or 1); which rows may be learnt from is the caller's choice."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(labels), "doc_id")
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    counted = rows.mapInArrow(_counted, "unit long, part int, n long, texts long").groupBy("unit").pivot("part", [0, 1, 2, 3]).agg(F.sum("n").alias("n"), F.sum("texts").alias("t"))
    t = sum((F.coalesce(f"{p}_t", F.lit(0)) for p in range(4)), F.lit(0))
    table = counted.where((t >= LEAST_TEXTS) | (F.col("unit") == 0)).select("unit", *(F.coalesce(f"{p}_n", F.lit(0)).alias(f"n{p}") for p in range(4))).toPandas()
    n = table[["n0", "n1", "n2", "n3"]].to_numpy(float)  # columns: fold * 2 + label
    units = table["unit"].to_numpy().view(np.uint64)
    total = n[units == 0].sum(0)  # words in all
    if not len(units) or total[[0, 2]].sum() == 0 or total[[1, 3]].sum() == 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), constant=1.0 if total[[1, 3]].sum() > 0 else 0.0)
    n, units = n[units != 0], units[units != 0]
    turn = np.argsort(units)
    n, units = n[turn], units[turn]
    rates = _rates(docs, units)
    halves = [_scored(units, n[:, 2 * f : 2 * f + 2], total[2 * f : 2 * f + 2], rates) for f in (0, 1)]
    model = _scored(units, n[:, :2] + n[:, 2:], total[:2] + total[2:], rates)
    raw = rows.mapInArrow(_examined(halves), "toxic int, words long, best double, mgf array<double>").toPandas()  # one row for each of the sample and for each batch
    scale = _lambda(raw)
    clean = raw[(raw.toxic == 0) & (raw.words > 0)]
    log_k = float((scale * clean.best - np.log(clean.words)).mean() - 0.5772156649) if len(clean) else 0.0
    for m in (*halves, model):
        m.scale, m.log_k = scale, max(log_k, -10.0)
    x = rows.mapInArrow(_features(halves), "toxic int, x array<double>").toPandas()
    model.weights = _logistic(np.stack(x.x.to_numpy()), x.toxic.to_numpy(float))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = 2 * b.column("fold").to_numpy() + b.column("toxic").to_numpy()
        for w in words(b.column("text"), LETTERS):
            if not len(w.hash):
                continue
            first, units, which = units_of(w)
            own = part[w.lo + w.doc]
            keys = [np.array([0] * 4, np.uint64)]
            parts, ns, ts = [np.arange(4)], [np.bincount(own, minlength=4)], [np.zeros(4, np.int64)]
            for u in units:
                each = u[which]
                known = each != 0
                _, at, inverse, n = np.unique(mix(each[known] * np.uint64(5) + own[known].astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
                texts = np.unique(inverse.astype(np.int64) << 32 | w.doc[known]) >> 32  # the group of each distinct (group, text)
                keys.append(each[known][at])
                parts.append(own[known][at])
                ns.append(n)
                ts.append(np.bincount(texts, minlength=len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(parts), pa.int32()), pa.array(np.concatenate(ns), pa.int64()), pa.array(np.concatenate(ts), pa.int64())], ["unit", "part", "n", "texts"])


def _rates(docs: DataFrame, units: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``units`` stands in all documents, over all their words: counted on the executors, one sum for each unit of the sample comes back."""
    size = -(-(len(units) + 1) // PIECES) * PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)  # the words in all come last
        for b in batches:
            for w in words(b.column("text"), LETTERS):
                if not len(w.hash) or not len(units):
                    continue
                _, own, which = units_of(w)
                times = np.bincount(which, minlength=len(own[0]))
                table[-1] += len(w.hash)
                for u in own:
                    at = np.minimum(np.searchsorted(units, u), len(units) - 1)
                    known = (units[at] == u) & (u != 0)
                    np.add.at(table, at[known], times[known])
        if table.any():
            for i, x in enumerate(table.reshape(PIECES, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["piece", "sums"])

    total = added_up(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "piece int, sums binary"), PIECES)
    return (total[: len(units)] + 0.5) / max(total[-1], 1)


def _scored(units: np.ndarray, n: np.ndarray, total: np.ndarray, rates: np.ndarray) -> Model:
    """Log-odds with an informative Dirichlet prior (Monroe, Colaresi and Quinn, 2008), ``rates`` of the whole corpus."""
    prior = PRIOR * rates
    toxic, clean = n[:, 1] + prior, n[:, 0] + prior
    odds = np.log(toxic / (total[1] + PRIOR - toxic).clip(1)) - np.log(clean / (total[0] + PRIOR - clean).clip(1))
    z = odds / np.sqrt(1 / toxic + 1 / clean)
    return Model(units, np.where(np.abs(z) >= LEAST_Z, odds, 0.0))


_GRID = np.linspace(0.05, 3.0, 60)


def _examined(halves: list[Model]):
    """With the other half's units: of each text its best segment, and for the batch's clean words together what the moment equation needs (a row without label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, n, best = b.column("toxic").to_pylist(), [], []
            level, times = np.zeros(0), np.zeros(0)
            for i, (_, _, s) in enumerate(_each(b, halves)):
                n.append(len(s))
                best.append(max((x[2] for x in segments(s)), default=0.0))
                if toxic[i] == 0:
                    own, count = np.unique(s, return_counts=True)
                    level, inverse = np.unique(np.concatenate((level, own)), return_inverse=True)
                    times = np.bincount(inverse, np.concatenate((times, count)), minlength=len(level))
            mean = (np.exp(np.minimum(np.outer(_GRID, level), 50)) * times).sum(1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([*toxic, None], pa.int32()), pa.array([*n, int(times.sum())], pa.int64()), pa.array([*best, None], pa.float64()), pa.array([*[None] * len(n), mean], pa.list_(pa.float64()))], ["toxic", "words", "best", "mgf"])

    return run


def _each(b: pa.RecordBatch, halves: list[Model]) -> Iterator[tuple[Words, int, np.ndarray]]:
    fold = b.column("fold").to_numpy()
    for w in words(b.column("text"), LETTERS):
        s = [word_scores(w, m) for m in halves]
        for i in range(w.hi - w.lo):
            yield w, i, s[1 - fold[w.lo + i]][w.first[i] : w.first[i + 1]]


def _lambda(raw) -> float:
    """The positive root of the mean of exp(lambda * score) over clean words = 1, on a grid."""
    sums = raw[raw.toxic.isna() & (raw.words > 0)]
    if not len(sums):
        return 1.0
    mean = np.stack(sums.mgf.to_numpy()).sum(0) / sums.words.sum()
    above = np.flatnonzero(mean >= 1)
    return float(_GRID[above[0]]) if len(above) else float(_GRID[-1])


def _features(halves: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [evidence(s, halves[0])[0].tolist() for _, _, s in _each(b, halves)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ...) with score (0 to 1) and passages for each row; other columns are kept.

    passages are the significant segments as bytes [start, end) of the text, with their significance. Null and empty
    texts have the score of no evidence. Columns of ``docs`` named like the results are replaced.
    """
    docs = docs.drop("score", "passages")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, marked = [], []
            for w in words(b.column("text"), LETTERS):
                s = word_scores(w, model) if model.constant is None else np.zeros(len(w.hash))
                for i in range(w.hi - w.lo):
                    lo, base = w.first[i], w.bounds[i]
                    if model.constant is not None:
                        out.append(model.constant)
                        marked.append([])
                        continue
                    x, found = evidence(s[lo : w.first[i + 1]], model)
                    out.append(float(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))))
                    marked.append([{"start": int(w.start[lo + a] - base), "end": int(w.end[lo + e - 1] - base), "significance": float(v)} for a, e, v in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64()), pa.array(marked, kind)], names=[*b.schema.names, "score", "passages"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{shape}, score double, passages array<struct<start:long,end:long,significance:double>>")


def held_out(doc_id: str) -> Column:
    """True for the fifth of all ids that the model must not learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string")), F.lit(5)) == 0
