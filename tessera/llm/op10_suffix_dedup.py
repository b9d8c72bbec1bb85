"""Exact substring dedup by a distributed merge sort of sampled suffixes that uses common prefixes.

Bytes covered by a ``length``-byte string that also starts elsewhere are removed.

1. Anchors. In each window of ``length`` bytes the ``GRAM``-byte gram of the smallest
   hash (the leftmost of equals) is its anchor: equal windows have their anchor at the
   same place. Windows that follow each other and have one anchor are one record.
   A gram that the corpus holds once can't be in a repeated window; grams that repeat
   go into a Bloom filter sized by their number, beyond ``BLOOM_KEYS`` of them they are joined to the texts instead.
2. Sorted runs. For each record the suffix from its anchor on (as long as its windows
   reach) is sorted with what stands left of it. A run is front-coded:
   per suffix the length of the prefix shared with the one before, and the rest.
   Equal records of a run become one before anything is sent: all owners but one are
   decided on the spot, so however often a passage stands in the corpus, a run holds it
   once. Runs are exchanged by the gram's hash, in blocks of ``PIECE`` bytes that are unpacked one at a time;
   the number of targets follows the number of repeated grams.
3. Merge. A loser tree holds for each run the prefix its head shares with the last
   winner; heads are compared from there on only, and not at all where these differ.
4. Decision. Suffixes that share a gram come out together, with their common prefixes.
   A window at distance d left of its anchor repeats if another record agrees on d
   bytes to the left and ``length`` - d to the right.

Groups of more than ``GROUP`` distinct records are not held: their windows go on as
128-bit fingerprints, counted by a further shuffle with partial sums.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.op03_ngram_join import groups
from tessera.llm.shared import bloom_of, clear, in_bloom, mix, staged
from tessera.llm.wordhash import BASE, byte_values, powers

#: Bytes of an anchor's gram (at most; a quarter of shorter lengths).
GRAM = 64
#: Positions of a text that are taken at once.
SEGMENT = 1 << 20
#: Bytes of suffixes in a sorted run.
RUN = 12 << 20
#: Distinct records that a group may have in memory, and up to how many are compared one by one.
GROUP, FEW = 20_000, 24
#: Bytes of a run that are unpacked at a time, and of the records that a target takes about.
PIECE, TARGET = 256 << 10, 48 << 20
#: Repeated grams up to which a Bloom filter goes to every task (16 bits each); more are joined by shuffle.
BLOOM_KEYS = 1 << 25
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def substring_dedup(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    spans are the maximal removed runs of the UTF-8 bytes, [start, end); kept is the rest, concatenated
    (binary: a cut may split a character). A null text is empty. doc_id has to be a number (or null). Equal rows count as two texts: both
    lose what they share. Strings are judged on the input. Texts of any length are taken whole, ``SEGMENT`` positions at a time.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = staged(docs.withColumns({"a": F.monotonically_increasing_id(), "b": F.lit(0).cast("long")}))
    spans = repeats(told, length, group=group).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("raw"))
    return told.select("a", "doc_id", "text").join(spans, "a", "left").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts' bytes; a null text has none."""
    return [(t or "").encode() for t in texts.to_pylist()]


def repeats(told: DataFrame, length: int, first: bool = False, as_bytes: Callable[[pa.Array], list[bytes]] = utf8, group: int = GROUP) -> DataFrame:
    """(a, b, start, end): ranges of bytes of ``told`` (a long, b long, text) that are covered by repeated windows of ``length`` bytes.

    (a, b) names a row; ``told`` must be the same whenever it is read. ``as_bytes`` says which bytes stand for the texts. With
    ``first``, of equal windows the one of the smallest (a, b, start) is left out. Ranges of a row may overlap and repeat.
    """
    told = told.select("a", "b", "text")
    gram = min(GRAM, max(1, length // 4))
    parts = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = told.select("text").mapInArrow(_grams(length, gram, as_bytes), "gram long, n long")
    repeated = staged(grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"))
    keys, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    targets = max(parts, -(-int(total) * 2 * length // TARGET))
    if keys <= BLOOM_KEYS:
        may = bloom_of(repeated.select("gram"), 1 << max(16, (16 * keys).bit_length()))
        marked = told.withColumn("grams", F.lit(None).cast("array<long>"))
    else:
        may = None
        own = told.mapInArrow(_own_grams(length, gram, as_bytes), "a long, b long, gram long")
        own = own.join(repeated.select("gram"), "gram").groupBy("a", "b").agg(F.collect_set("gram").alias("grams"))
        marked = told.join(own, ["a", "b"])
    sent = staged(marked.mapInArrow(_runs(length, gram, may, targets, first, as_bytes), "a long, b long, start long, end long, target int, run array<binary>"))
    clear(repeated)
    runs = sent.where("target is not null").select("target", "run").repartitionById(targets, F.col("target")).sortWithinPartitions("target")
    found = staged(runs.mapInArrow(_merged(length, gram, group, first), "a long, b long, start long, end long, f1 long, f2 long, n long"))
    windows = found.where("f1 is not null")
    place = F.struct("a", "b", "start")
    often = windows.groupBy("f1", "f2").agg(F.sum("n").alias("times"), F.min(place).alias("least")).where("times > 1")
    windows = windows.join(often, ["f1", "f2"])
    if first:
        windows = windows.where(place > F.col("least"))
    columns = ["a", "b", "start", "end"]
    return sent.where("target is null").select(columns).union(found.where("f1 is null").select(columns)).union(windows.select(columns))


def records(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, last window) of a text's records."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    values, width = byte_values(lower=False), length - gram + 1
    found = []
    for lo in range(0, n - length + 1, SEGMENT - length):
        piece = data[lo : lo + SEGMENT]
        if len(piece) < length:
            break
        power, inverse = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * inverse[: len(piece) - gram + 1])
        keyed = (h & ~np.uint64(SEGMENT - 1)) | np.arange(len(h), dtype=np.uint64)
        filled = np.concatenate((keyed, np.full(-len(keyed) % width, np.iinfo(np.uint64).max))).reshape(-1, width)
        ahead = np.minimum.accumulate(filled, 1).ravel()
        back = np.minimum.accumulate(filled[:, ::-1], 1)[:, ::-1].ravel()
        windows = len(piece) - length + 1
        least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [windows])) - 1
        at = (least[first] & np.uint64(SEGMENT - 1)).astype(np.int64)
        found.append((h[at], at + lo, first + lo, last + lo))
    h, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate(([True], at[1:] != at[:-1]))  # a record that two segments share is one
    ends = np.concatenate((np.flatnonzero(new)[1:], [len(at)])) - 1
    return h[new], at[new], first[new], last[ends]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[:] = [powers(BASE, size), powers(_INVERSE, size)]
    return _POWERS


def _grams(length: int, gram: int, as_bytes: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [records(np.frombuffer(t, np.uint8), length, gram)[0] for t in as_bytes(b.column(0)) if len(t)]
            if found:
                values, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())], ["gram", "n"])

    return run


def _own_grams(length: int, gram: int, as_bytes: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(records(np.frombuffer(t, np.uint8), length, gram)[0]).view(np.int64) for t in as_bytes(b.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["a", "b", "gram"])

    return run


_SENT = pa.schema([*(pa.field(x, pa.int64()) for x in ("a", "b", "start", "end")), pa.field("target", pa.int32()), pa.field("run", pa.list_(pa.binary()))])


def _runs(length: int, gram: int, bloom: np.ndarray | None, targets: int, first: bool, as_bytes: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes, bytes, int], list[tuple[int, int, int]]] = {}
        size = 0
        for batch in batches:
            own = batch.column("grams")
            for i, (a, b, raw) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), as_bytes(batch.column("text")), strict=True)):
                h, at, lowest, last = records(np.frombuffer(raw, np.uint8), length, gram)
                if not len(h):
                    continue
                may = in_bloom(bloom, h) if bloom is not None else np.isin(h.view(np.int64), own[i].values.to_numpy())
                for g, p, lo, hi in zip((h[may] % np.uint64(targets)).tolist(), at[may].tolist(), lowest[may].tolist(), last[may].tolist(), strict=True):
                    owners = held.setdefault((g, raw[p : hi + length], raw[lo:p][::-1], p - hi), [])
                    if not owners:
                        size += hi + length - lo
                    owners.append((a, b, p))
                    size += 100  # of memory; a sent owner has 24
                    if size > RUN:
                        yield from _packed(held, length, targets, first)
                        size = 0
        yield from _packed(held, length, targets, first)

    return run


def _packed(held: dict, length: int, targets: int, first: bool) -> Iterator[pa.RecordBatch]:
    """What is held as one sorted, front-coded run for each target; of several owners of a record one is sent, the others are decided here."""
    pack = zstandard.ZstdCompressor(1)
    by_target: dict[int, list] = {}
    spans: list[tuple] = []
    for key in sorted(held):
        owners = held[key]
        _, right, left, least = key
        kept = min(owners)
        if len(owners) > 1:
            spans.extend(_whole(o, left, least, length) for o in owners if not first or o != kept)
        by_target.setdefault(key[0], []).append((right, left, least, kept, len(owners) > 1))
    held.clear()
    for lo in range(0, len(spans), 50_000):
        some = list(zip(*spans[lo : lo + 50_000], strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in some), pa.nulls(len(some[0]), pa.int32()), pa.nulls(len(some[0]), pa.list_(pa.binary()))], schema=_SENT)
    for target, found in by_target.items():
        pieces = [pack.compress(x) for x in front_coded(found)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([target], pa.int32()), pa.array([pieces], pa.list_(pa.binary()))], schema=_SENT)


def _whole(owner: tuple[int, int, int], left: bytes, least: int, length: int) -> tuple[int, int, int, int]:
    """(a, b, start, end) of all windows of a record."""
    a, b, p = owner
    return a, b, p - len(left), p - least + length


def common(a: bytes, b: bytes, h: int) -> int:
    """The length of the prefix that a and b share, which is h at least."""
    n = min(len(a), len(b))
    while h < n:
        m = min(n, h + 32)
        p, q = a[h:m], b[h:m]
        if p != q:
            return m - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8
        h = m
    return n


def front_coded(found: list[tuple[bytes, bytes, int, tuple[int, int, int], bool]]) -> Iterator[bytes]:
    """Sorted (right, left reversed, least distance, owner, known to repeat) in pieces: shared prefix, lengths and rest of each."""
    out, size, before = [], 0, b""
    for right, left, least, owner, known in found:
        h = common(right, before, 0)
        out += (struct.pack("<HHHHB3q", h, len(right) - h, len(left), least, known, *owner), right[h:], left)
        size += 33 + len(right) - h + len(left)
        before = right
        if size >= PIECE:
            yield b"".join(out)
            out, size = [], 0
    if out:
        yield b"".join(out)


def unfolded(pieces: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, tuple[int, int, int], bool]]:
    """(prefix shared with the one before, right, left, least distance, owner, known to repeat) of a front-coded run, one piece unpacked at a time."""
    unpack, right = zstandard.ZstdDecompressor(), b""
    for packed in pieces:
        raw, at = unpack.decompress(packed), 0
        while at < len(raw):
            h, rest, left, least, known, *owner = struct.unpack_from("<HHHHB3q", raw, at)
            at += 33
            right = right[:h] + raw[at : at + rest]
            at += rest
            yield h, right, raw[at : at + left], least, tuple(owner), bool(known)
            at += left


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (shared prefix, string, ...) into one, by a loser tree over shared prefixes.

    ``shared[i]`` is what head i shares with the winner it last lost to or followed; two heads with
    different values need no comparison, and equal ones are compared from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        h = common(x, y, shared[a])
        if h == len(x) if h == len(y) or h == len(x) else x[h] < y[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def built(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = play(built(2 * node), built(2 * node + 1))
        return won

    won = built(1)
    while heads[won] is not None:
        head = heads[won]
        yield (shared[won], *head[1:])
        heads[won] = new = next(runs[won], None)
        shared[won] = new[0] if new else 0
        node = (won + k) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2


def _merged(length: int, gram: int, most: int, first: bool):
    schema = pa.schema([pa.field(x, pa.int64()) for x in ("a", "b", "start", "end", "f1", "f2", "n")])

    def told(spans: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "target"):
            runs = [unfolded(x) for x in t.column("run").to_pylist()]
            spans: list[tuple] = []
            group: list[list] = []
            over = False
            equal: dict[tuple[bytes, int], list] = {}  # the records of the group that have the last right part

            def closed() -> Iterator[tuple]:
                return (x for r in group for x in _fingerprints(r, length)) if over else decided(group, length, first)

            for shared, right, left, least, owner, known in merged(runs):
                if shared < gram and group:
                    spans.extend(closed())
                    group, over = [], False
                if not group or shared < len(right) or len(group[-1][1]) > shared:
                    equal = {}
                twin = equal.get((left, least))
                if twin is None:
                    group.append([shared, right, left, least, owner, known])
                    equal[left, least] = group[-1]
                elif first:  # the smallest owner is kept, the others are decided
                    twin[4], other = min(twin[4], owner), max(twin[4], owner)
                    if other != twin[4]:  # a row that is there twice is one owner
                        spans.append((*_whole(other, left, least, length), None, None, None))
                else:
                    spans.extend((*_whole(o, left, least, length), None, None, None) for o, done in ((owner, known), (twin[4], twin[5])) if not done)
                    twin[5] = True
                if len(group) > most:
                    spans.extend(x for r in group[:-1] for x in _fingerprints(r, length))
                    group, over = group[-1:], True
                    equal = {(left, least): group[-1]} if twin is None else {}
                if len(spans) > 50_000:
                    yield told(spans)
                    spans = []
            if group:
                spans.extend(closed())
            if spans:
                yield told(spans)

    return run


def decided(group: list[list], length: int, first: bool = False) -> Iterator[tuple]:
    """(a, b, start, end, None, None, None): what repeats among distinct records that share a gram; with ``first`` not at the smallest owner."""
    m = len(group)
    ranges: list[list[tuple[int, int]]] = [[] for _ in group]  # distances of repeated windows, both ends included
    if m <= FEW:
        for i in range(m):
            r = len(group[i][1])
            for j in range(i + 1, m):
                r = min(r, group[j][0])
                lo, hi = length - r, common(group[i][2], group[j][2], 0)
                for x, other in ((i, j), (j, i)):
                    if first and group[x][4] < group[other][4]:
                        continue
                    a, b = max(lo, group[x][3], group[other][3]), min(hi, len(group[x][2]), len(group[other][2]))
                    if a <= b:
                        ranges[x].append((a, b))
    else:
        shared = np.array([r[0] for r in group])
        shared[0] = 0
        least, most = np.array([r[3] for r in group]), np.array([len(r[2]) for r in group])
        rank = np.empty(m, np.int64)
        rank[sorted(range(m), key=lambda i: group[i][4])] = np.arange(m)
        lefts = np.zeros((int(most.max()) + 1, m), np.uint8)
        for i, r in enumerate(group):
            lefts[: len(r[2]), i] = np.frombuffer(r[2], np.uint8)
        so_far = np.zeros(m, np.uint64)
        hits = np.zeros((len(lefts), m), bool)
        values = byte_values(lower=False)
        for d in range(len(lefts)):
            own = np.flatnonzero((least <= d) & (d <= most))
            if len(own) > 1:
                same = mix(so_far[own] * BASE + np.cumsum(shared < length - d)[own].astype(np.uint64))
                order = np.lexsort((rank[own], same))
                again = same[order[1:]] == same[order[:-1]]
                hits[d, own[order[1:][again]]] = True
                if not first:
                    hits[d, own[order[:-1][again]]] = True
            so_far = mix(so_far * BASE + values[lefts[d]])
        for i in np.flatnonzero(hits.any(0)):
            at = np.flatnonzero(hits[:, i])
            cut = np.flatnonzero(np.diff(at) > 1)
            ranges[i] += zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist(), strict=True)
    for (_, _, _, _, (x, y, p), _), found in zip(group, ranges, strict=True):
        for a, b in set(found):
            yield x, y, p - b, p - a + length, None, None, None


def _fingerprints(record: list, length: int) -> Iterator[tuple]:
    """(a, b, start, end, f1, f2, times): one row for each window of a record."""
    _, right, left, least, (x, y, p), known = record
    whole = left[::-1] + right
    for d in range(least, len(left) + 1):
        f = struct.unpack("<qq", hashlib.blake2b(whole[len(left) - d : len(left) - d + length], digest_size=16).digest())
        yield x, y, p - d, p - d + length, *f, 1 + known


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, kept, n = [], [], []
        for text, raw in zip(utf8(b.column("text")), b.column("raw").to_pylist(), strict=True):
            runs = joined([(s["start"], s["end"]) for s in raw or ()])
            at, left = 0, []
            for start, end in runs:
                left.append(text[at:start])
                at = end
            n.append(len(text))
            spans.append([{"start": x, "end": y} for x, y in runs])
            kept.append(b"".join([*left, text[at:]]) if runs else text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges as maximal runs; ranges that touch are one."""
    runs: list[tuple[int, int]] = []
    for start, end in ranges:
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], end)
        else:
            runs.append((start, end))
    return runs
