"""URL filter: rules by host and path, and for the rest the ratio of two character models.

Two variable-order Markov models, one of the URLs that rules accept and one of those they
reject, give each character's probability after its last ``ORDER`` characters: counts of
every order, each smoothed with the next lower one (Dirichlet weight ``SMOOTH``). The mean
log-likelihood difference per character is compared with a threshold calibrated on a fifth
of the rule-labelled URLs that the models have not seen, so that both kinds of error are equally rare.

Counts are exact and of the whole corpus: a character and the ``ORDER`` before it are one integer (a gram),
and a written table holds how often each gram stands in accepted and in rejected URLs. Lower orders are sums
of it. Only the counts of two characters, of which there are at most ``SYMBOLS`` squared, go to driver and tasks; the
higher orders of grams with the same two characters before the last meet in one group. Different addresses
are scored in bundles that are joined with the ratios of their grams.

Host and path are scored, which are what rules judge: scheme, query and fragment say how a page
was reached (tracking, paging), and addresses that differ only there get one verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free, staged

ORDER, SMOOTH = 5, 4.0
#: Bits of a symbol in a gram, and symbols: 0 before the text's start, else a byte and 1.
BITS, SYMBOLS = 9, 257
#: A bundle has at most 2 to this power addresses.
BUNDLE_BITS = 14
#: Bins of a calibration histogram and their range.
BINS, REACH = 1024, 4.0

#: The rules of production: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def split(url: Column) -> tuple[Column, Column]:
    """(host, path) of an absolute URL, both empty for others and null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.substr(url, F.length(rest) + F.lit(4))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(df: DataFrame, rules: tuple[tuple[str, str, str], ...], named: str = "_action") -> DataFrame:
    """``df`` (host, path) with rule and what it says (``named``) of the longest rule that fits, null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return df.withColumns({"rule": rule, named: action})


def filtered(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, verdict and score for each row; other columns are kept.

    verdict is the longest fitting rule's, else ``allow`` where score (mean log-likelihood difference per character,
    accepted less rejected) reaches the calibrated threshold and ``block`` elsewhere. Without rejected URLs to learn from
    the models allow, without accepted ones they block, without both they allow. A null url is empty; an empty one has score 0.
    Columns named like the results are replaced. Repeated rows come back each. A URL of any length is scored whole.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    said, own_host, own_path = free(pages, "said", "own_host", "own_path")
    host, path = split(F.col("url").cast("string"))
    marked = ruled(pages.withColumns({"host": host, "path": path}), rules, said)
    known = marked.where(F.col(said).isNotNull()).select("host", "path", (F.col(said) == "allow").cast("int").alias("accepted"), F.pmod(F.xxhash64("host", "path"), F.lit(5)).cast("int").alias("fold"))
    counts = _trained(known)
    found = _scored(marked.select("host", "path"), counts)
    threshold = _threshold(known, counts, found)
    found = found.toDF(own_host, own_path, "score")
    out = marked.join(found, (F.col("host") == F.col(own_host)) & (F.col("path") == F.col(own_path)), "left").drop(own_host, own_path)
    verdict = F.coalesce(said, F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.withColumn("verdict", verdict).drop(said)


@dataclass
class Counts:
    """``grams`` (gram, rejected, accepted) is a written table; ``pairs`` has their sums, [rejected, accepted] x last symbol but one x last."""

    grams: DataFrame
    pairs: np.ndarray


def _grams(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) for each byte of host + path; the last symbol has the lowest bits."""
    texts = [(h + p).encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
    size = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(row)) + ORDER * (row + 1)
    symbols = np.zeros(len(row) + ORDER * len(texts), np.int64)
    symbols[at] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    gram = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        gram = gram << BITS | symbols[at - back]
    return row, gram


def _trained(known: DataFrame) -> Counts:
    """The counts of ``known`` (host, path, accepted, fold) but fold 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, gram = _grams(b)
            each, where, n = np.unique(gram, return_inverse=True, return_counts=True)
            accepted = np.bincount(where, b.column("accepted").to_numpy()[row], len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n - accepted), pa.array(accepted)], ["gram", "rejected", "accepted"])

    rows = known.where("fold <> 0").select("host", "path", "accepted").mapInArrow(count, "gram long, rejected long, accepted long")
    grams = staged(rows.groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")))
    pairs = np.zeros((2, 1 << BITS, 1 << BITS), np.int64)
    last = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("pair"))
    for r in last.agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")).collect():  # at most SYMBOLS squared rows
        pairs[:, r.pair >> BITS, r.pair & (1 << BITS) - 1] = r.rejected, r.accepted
    return Counts(grams, pairs[:, :SYMBOLS, :SYMBOLS])


def _scored(urls: DataFrame, counts: Counts) -> DataFrame:
    """(host, path, score), a written table of the different addresses among ``urls`` (host, path)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, gram = _grams(b)
            own = b.column("bundle").to_numpy()[row]
            for bundle in np.unique(own):
                each = np.unique(gram[own == bundle])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), bundle)), pa.array(each)], ["bundle", "gram"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row, gram = _grams(left)
        known, ratio = right.column("gram").to_numpy(), right.column("ratio").to_numpy()
        order = np.argsort(known)
        ratio = ratio[order[np.searchsorted(known, gram, sorter=order)]] if len(gram) else np.zeros(0)
        n = np.bincount(row, minlength=len(left))
        score = np.bincount(row, ratio, len(left)) / np.maximum(n, 1)
        return pa.table({"host": left.column("host"), "path": left.column("path"), "score": pa.array(score, pa.float64())})

    urls = staged(urls.distinct().withColumn("bundle", F.shiftright(F.monotonically_increasing_id(), BUNDLE_BITS)))
    asked = staged(urls.mapInArrow(ask, "bundle long, gram long").distinct())
    nothing = F.lit(0).cast("long")
    grams = counts.grams.union(asked.select("gram", nothing, nothing)).groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))
    before = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    ratios = grams.groupBy(before.alias("before")).applyInArrow(_ratios(counts.pairs), "gram long, ratio double")
    looked = asked.join(ratios, "gram").select("bundle", "gram", "ratio")
    return staged(urls.groupBy("bundle").cogroup(looked.groupBy("bundle")).applyInArrow(add, "host string, path string, score double"))


def _ratios(pairs: np.ndarray):
    """The log-likelihood difference of each gram, from all grams with the same two symbols before the last."""
    single = pairs.sum(1)
    low = (single + SMOOTH / 256) / (single.sum(1, keepdims=True) + SMOOTH)
    low = (pairs + SMOOTH * low[:, None]) / (pairs.sum(2, keepdims=True) + SMOOTH)

    def run(group: pa.Table) -> pa.Table:
        gram = group.column("gram").to_numpy()
        ratio = np.zeros(len(gram))
        same = []
        for order in range(2, ORDER + 1):
            pair = np.unique(gram & ((1 << BITS * (order + 1)) - 1), return_inverse=True)[1]
            context = np.unique((gram >> BITS) & ((1 << BITS * order) - 1), return_inverse=True)[1]
            same.append((pair, context))
        for k, name, sign in ((1, "accepted", 1.0), (0, "rejected", -1.0)):
            n = group.column(name).to_numpy()
            p = low[k, (gram >> BITS) & ((1 << BITS) - 1), gram & ((1 << BITS) - 1)]
            for pair, context in same:
                p = (np.bincount(pair, n)[pair] + SMOOTH * p) / (np.bincount(context, n)[context] + SMOOTH)
            ratio += sign * np.log(p)
        return pa.table({"gram": pa.array(gram), "ratio": pa.array(ratio)})

    return run


def scores(b: pa.RecordBatch, counts: Counts) -> np.ndarray:
    """The mean log-likelihood difference per byte of each row of a batch (host, path) that the driver holds."""
    rows = counts.grams.sparkSession.createDataFrame(list(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)), "host string, path string")
    found = {(r.host, r.path): r.score for r in _scored(rows, counts).collect()}  # at most the batch's rows
    return np.array([found[k] for k in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)])


def _threshold(known: DataFrame, counts: Counts, found: DataFrame | None = None) -> float:
    """The score from which on ``known`` of fold 0 is best accepted; ``found`` has scores of its addresses, if they are there."""
    seen = counts.pairs.sum((1, 2))
    if not seen.all():
        return np.inf if seen[0] and not seen[1] else -np.inf
    tried = known.where("fold = 0").select("host", "path", "accepted")
    if found is None:
        found = _scored(tried.select("host", "path"), counts)
    place = F.least(F.greatest((F.col("score") / REACH + 1) / 2 * BINS, F.lit(0.0)), F.lit(BINS - 1.0)).cast("int")
    total = np.zeros((2, BINS), np.int64)
    for r in tried.join(found, ["host", "path"]).groupBy("accepted", place.alias("bin")).agg(F.count("*").alias("n")).collect():  # at most 2 * BINS rows
        total[r.accepted, r.bin] = r.n
    if not total.sum(1).all():
        return 0.0
    rejected, accepted = total
    wrong = np.concatenate(([0], np.cumsum(accepted))) / accepted.sum() + 1 - np.concatenate(([0], np.cumsum(rejected))) / rejected.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 - 1) * REACH
