"""Exact n-gram Jaccard self-join: global order, prefix filter, and a trie walked once per group of candidates.

1. Shingle frequencies go into a table of counters whose number follows the corpus (one for ``BYTES`` bytes of
   text, within ``SLOTS``), summed over the whole corpus. The global order of shingles is (class of the counter, hash):
   whatever is frequent comes last, so that no prefix list is hot.
2. Equal sets are one set from here on. Sets that reach the threshold share a shingle
   of their prefixes; shingles that only one prefix holds are dropped.
3. Within each list of a shared shingle, sizes and parity bitmaps (a lower bound of
   the symmetric difference) leave out pairs that cannot reach the threshold. What
   survives are clusters. Clusters that overlap make a block; a block of at most
   ``SPLIT`` sets and ``ELEMENTS`` shingles goes to one task, once. A larger one goes cluster by cluster.
4. The sets of each, in the global order, go into a trie. The walk carries the
   overlaps that all sets below a node share and cuts subtrees whose sizes can't reach
   the required overlap. Links within a component found so far are not searched again.
5. Connected components by star rounds.

Lists of more than ``SPLIT`` members, or of sets with more than ``ELEMENTS`` shingles together, are dealt as pairs of blocks to different tasks; every pair
of members still meets in one of them. Shingles are compared as 64-bit hashes: among m distinct shingles of two texts a
false match has odds of m * m / 2**65, 3e-12 for ten thousand, and moves a size by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import added_up, bloom_of, in_bloom, staged
from tessera.llm.wordhash import SPACED, shingles, words

#: Bits of the number of counters, at least and at most; bytes of text for each; pieces in which they are added up.
SLOTS, BYTES, PIECES = (18, 20), 128, 64
#: Members of a list that one task takes at most, and shingles of their sets.
SPLIT, ELEMENTS = 2048, 4 << 20
#: Bits of a set's parity bitmap: the power of two that is half its size or more, and so many at least.
LEAST_BITS = 512


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Rows link when 100 * intersection >= percent * union of their sets of distinct k-word shingles.
    component_id is the smallest doc_id reachable. A text without words (or null) has no
    shingles and is its own component; equal texts are linked. Repeated rows each come back.
    A row whose doc_id is null comes back with component_id of its set's component (null if it has no other).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = _frequencies(docs, k)
    sets = staged(docs.mapInArrow(_prefixes(order, k, percent), "doc_id long, sid binary, n_shingles long, prefix array<long>, parity binary"))
    distinct = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    distinct = staged(distinct.withColumn("rid", F.monotonically_increasing_id()))
    tokens = distinct.select("rid", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("members"), F.sum("n").alias("elements")).where("members > 1")
    lists = tokens.drop("n").join(shared, "token").join(distinct.select("rid", "n", "parity"), "rid")
    clusters = staged(_clusters(lists, percent))
    first = clusters.groupBy("cluster").agg(F.min("rid").alias("b"))
    block = components(clusters.join(first, "cluster").select(F.col("rid").alias("a"), "b")).withColumnRenamed("root", "block")
    block = block.join(distinct.select(F.col("rid").alias("node"), "n"), "node")
    size = block.groupBy("block").agg(((F.count("*") <= SPLIT) & (F.sum("n") <= ELEMENTS)).alias("small"))
    block = staged(block.join(size, "block").select(F.col("node").alias("rid"), "block", "small"))
    groups_ = block.where("small").select("rid", F.xxhash64(F.lit("block"), "block").alias("cluster"))
    groups_ = groups_.union(clusters.join(block.where("not small"), "rid", "left_semi").select("rid", F.xxhash64(F.lit("cluster"), "cluster")))
    wanted = groups_.join(distinct.select("rid", F.col("sid").alias("its"), F.col("doc_id").alias("d")), "rid")
    bloom = bloom_of(wanted.where("d is not null").select("d"))
    full = docs.mapInArrow(_whole_sets(order, k, bloom), "doc_id long, sid binary, shingles binary")
    full = full.join(wanted, (F.col("sid") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("cluster", "rid", "shingles")
    links = full.repartition("cluster").sortWithinPartitions("cluster", "rid").mapInArrow(_trie_links(percent), "a long, b long")
    roots = components(links)
    named = distinct.select("rid", "sid", "doc_id").join(roots.withColumnRenamed("node", "rid"), "rid")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(least, "root").select(F.col("sid").alias("linked"), "component")
    own = distinct.select(F.col("sid").alias("of"), F.col("doc_id").alias("own"))
    out = sets.select("doc_id", "sid", "n_shingles").join(own, F.col("sid") == F.col("of"), "left").join(named, F.col("sid") == F.col("linked"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "own", "doc_id").alias("component_id"))


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """The class of each counter: the bit length of its count. A counter is named by the highest bits of a shingle's hash."""
    text = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(max(int(text // BYTES).bit_length(), SLOTS[0]), SLOTS[1])
    slots, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, np.int64)
        for b in batches:
            for w in words(b.column(0), SPACED):
                np.add.at(table, (shingles(w, k)[0] >> shift).astype(np.int64), 1)
        if table.any():
            for i, x in enumerate(table.reshape(PIECES, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["piece", "sums"])

    total = added_up(docs.select("text").mapInArrow(count, "piece int, sums binary"), PIECES)
    total = total if len(total) else np.zeros(slots, np.int64)
    base = max(1.0, 2 * total.mean())
    return np.ceil(np.log2(np.maximum(total / base, 1))).astype(np.uint8)


def _ordered(order: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Distinct shingles in the global order."""
    u = np.unique(found)
    return u[np.argsort(order[u >> np.uint64(64 - (len(order) - 1).bit_length())], kind="stable")]


def _sets(batch: pa.RecordBatch, order: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for w in words(batch.column("text"), SPACED):
        found, first = shingles(w, k)
        for i in range(w.hi - w.lo):
            yield w.lo + i, _ordered(order, found[first[i] : first[i + 1]]) if first[i + 1] > first[i] else found[:0]


def _sid(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection i with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(order: np.ndarray, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, prefix, parity = [], [], [], []
            for _, s in _sets(b, order, k):
                sid.append(_sid(s))
                n.append(len(s))
                prefix.append(s[: len(s) - least_partner(len(s), percent) + 1].view(np.int64) if len(s) else s.view(np.int64))
                bits = max(LEAST_BITS, 1 << (max(len(s) // 2, 1) - 1).bit_length())
                parity.append(np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes())
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefix]))), pa.int32())
            values = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sid, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(parity, pa.binary())], ["doc_id", "sid", "n_shingles", "prefix", "parity"])

    return run


def _whole_sets(order: np.ndarray, k: int, bloom: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            may = in_bloom(bloom, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(may))
            found = [s for _, s in _sets(b, order, k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_sid(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "sid", "shingles"])

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """The groups of a stream sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        codes = keys.dictionary_encode()
        c = codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            value = keys[lo].as_py()
            if held and value != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = value
            held.append(b.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


class Forest:
    """Disjoint sets over 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def joined(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Parities:
    """Parity bitmaps of sets sorted by size; a longer one is folded to the length of a shorter one."""

    def __init__(self, raw: list[bytes]) -> None:
        self.rows = [np.frombuffer(x, np.uint64) for x in raw]
        self.first, self.table = -1, np.zeros((0, 0), np.uint64)

    def apart(self, i: int, end: int) -> np.ndarray:
        """At most the symmetric differences of set i with those from i + 1 to end - 1."""
        width = len(self.rows[i])
        if self.first < 0 or self.table.shape[1] != width or end > self.first + len(self.table):
            self.first, self.table = i, np.stack([self._folded(x, width) for x in self.rows[i : max(end, min(len(self.rows), i + 256))]])
        at = i - self.first
        return np.bitwise_count(self.table[at + 1 : end - self.first] ^ self.table[at]).sum(1, dtype=np.int64)

    @staticmethod
    def _folded(x: np.ndarray, width: int) -> np.ndarray:
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x


def _clusters(lists: DataFrame, percent: int) -> DataFrame:
    """(cluster, rid): the members of each shingle's list that some other member may reach."""
    parts = F.greatest(F.ceil(F.col("members") / SPLIT), F.least(F.ceil(F.col("elements") / ELEMENTS), F.col("members"))).cast("int")
    mine = F.pmod(F.xxhash64("rid"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = lists.withColumn("pair", F.explode(F.when(parts > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    dealt = dealt.select(F.xxhash64("token", "pair.i", "pair.j").alias("list"), "token", "rid", "n", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "list"):
            if t.num_rows < 2:
                continue
            rid, n = t.column("rid").to_numpy(), t.column("n").to_numpy()
            by_size = np.argsort(n, kind="stable")
            rid, n = rid[by_size], n[by_size]
            end = np.searchsorted(n, n * 100 // percent, "right")
            bits = _Parities(t.column("parity").take(pa.array(by_size)).to_pylist())
            forest, alive = Forest(len(rid)), np.zeros(len(rid), bool)
            for i in range(len(rid) - 1):
                if end[i] <= i + 1:
                    continue
                apart = bits.apart(i, int(end[i]))
                both = n[i + 1 : end[i]] + n[i]
                for j in np.flatnonzero(apart <= both - 2 * (-(-percent * both // (100 + percent)))) + i + 1:
                    forest.joined(i, int(j))
                    alive[i] = alive[j] = True
            members: dict[int, list[int]] = {}
            for i in np.flatnonzero(alive).tolist():
                members.setdefault(forest.root(i), []).append(int(rid[i]))
            for m in members.values():
                m.sort()
                name = int.from_bytes(hashlib.blake2b(np.array(m).tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m), pa.int64()), pa.array(m, pa.int64())], ["cluster", "rid"])

    return dealt.repartition("list").sortWithinPartitions("list").mapInArrow(run, "cluster long, rid long").dropDuplicates(["cluster", "rid"])


def _trie_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "cluster"):
            if t.num_rows < 2:
                continue
            rid = t.column("rid").to_pylist()
            found = trie_join([np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rid[a] for a, _ in found], pa.int64()), pa.array([rid[b] for _, b in found], pa.int64())], ["a", "b"])

    return run


def trie_join(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among ``sets`` (distinct elements, all in one global order).

    The sets are the paths of a compressed trie. Each set walks the trie of those before it; overlap with an edge is counted once for all sets below, and a
    subtree is left when overlap so far plus what both sides have left is too little.
    """
    code = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    paths = [[code[x] for x in s[::-1].tolist()] for s in sets]  # the frequent end first: near copies then share their upper edges
    size = [len(p) for p in paths]
    forest = Forest(len(sets))
    links: list[tuple[int, int]] = []
    root = [[], {}, [], size[0], size[0]]  # elements of the edge, children, sets that end here, least and largest size below
    apart = 0  # components in the trie
    for i in sorted(range(len(sets)), key=paths.__getitem__):
        place = {x: at for at, x in enumerate(paths[i])}
        total, joined = size[i], 0
        stack = [(root, 0, 0, -1)]
        while stack and joined < apart:
            (edge, below, ends, least, largest), depth, overlap, last = stack.pop()
            if largest * 100 < percent * total or least * percent > 100 * total:
                continue
            need = least_overlap(total, max(least, least_partner(total, percent)), percent)
            spare = largest - need - depth + overlap  # elements of the path that may still be missing
            for x in edge:
                at = place.get(x)
                if at is not None:
                    overlap += 1
                    last = at
                elif spare:
                    spare -= 1
                else:
                    spare = -1
                    break
            depth += len(edge)
            if spare < 0 or overlap + min(largest - depth, total - 1 - last) < need:
                continue
            for j in ends:
                if overlap >= least_overlap(total, size[j], percent) and forest.joined(i, j):
                    links.append((j, i))
                    joined += 1
            stack.extend((child, depth, overlap, last) for child in below.values())
        apart += 1 - joined
        _insert(root, paths[i], i)
    return links


def _insert(root: list, path: list[int], name: int) -> None:
    node, at = root, 0
    total = len(path)
    while True:
        node[3], node[4] = min(node[3], total), max(node[4], total)
        edge = node[0]
        k = 0
        while k < len(edge) and at < total and edge[k] == path[at]:
            k += 1
            at += 1
        if k < len(edge):
            lower = [edge[k:], node[1], node[2], node[3], node[4]]
            node[0], node[1], node[2] = edge[:k], {edge[k]: lower}, []
        if at == total:
            node[2].append(name)
            return
        child = node[1].get(path[at])
        if child is None:
            node[1][path[at]] = [path[at:], {}, [name], total, total]
            return
        node = child
