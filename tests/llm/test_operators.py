"""The corpus operators against brute force on small tables, with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op10_suffix_dedup as op10
from tessera.llm import queries
from tessera.llm.components import components
from tessera.llm.op01_extract import LABELLED, extracted, grown, main_text
from tessera.llm.op02_url_filter import filtered
from tessera.llm.op03_ngram_join import ngram_join, trie_join
from tessera.llm.op04_curves import hilbert, nearest
from tessera.llm.op05_toxicity import fitted, held_out, scored, segments
from tessera.llm.op06_unit_dedup import unit_dedup
from tessera.llm.op07_decontaminate import contamination
from tessera.llm.op08_pack import grants, pack
from tessera.llm.op09_shard import shards, write

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RANDOM = random.Random(11)
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "né", "ou") for b in ("", "ra", "sti", "ß", "tun")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sentence(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared lines, nulls, empty and short texts, repeated rows, one long word."""
    base = [sentence(RANDOM.randint(20, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 60):
        words = RANDOM.choice(base).split()
        for _ in range(RANDOM.randint(0, 2)):
            words[RANDOM.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    line = sentence(12)
    rows += [(60 + i, f"{sentence(9)}\n{line}\n{sentence(5)}") for i in range(8)]
    rows += [(80, None), (81, ""), (82, "  \t "), (83, "one"), (84, "One"), (85, "two words"), (86, "x" * 70_000), (87, base[0]), (87, base[0]), (None, base[1]), (None, "nothing like it at all")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").withColumns({"score": F.lit("mine"), "shard": F.lit(-1), "source": F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)), "spans": F.lit("x")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# the trie join


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and root(a) != root(b):
                up[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return collections.Counter((doc, len(s), least.get(root(i), doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, k, percent).collect())
    assert found == brute_components(rows, k, percent)


@pytest.mark.parametrize(("name", "value"), [("SPLIT", 3), ("ELEMENTS", 60), ("SLOTS", (8, 8))])
def test_ngram_join_splits_long_lists(docs, monkeypatch, name, value):
    monkeypatch.setattr(f"tessera.llm.op03_ngram_join.{name}", value)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, ngram_join(docs, 3, 80).collect())) == brute_components(rows, 3, 80)


def test_trie_finds_what_connects():
    for seed in range(20):
        rng = random.Random(seed)
        sets = list({tuple(sorted(rng.sample(range(14), rng.randint(1, 10)))) for _ in range(25)})
        links = trie_join([np.array(s, np.uint64) for s in sets], 60)
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            i = len(set(sets[a]) & set(sets[b]))
            assert 100 * i >= 60 * (len(sets[a]) + len(sets[b]) - i)
            up[root(a)] = root(b)
        for a in range(len(sets)):
            for b in range(a):
                i = len(set(sets[a]) & set(sets[b]))
                if 100 * i >= 60 * (len(sets[a]) + len(sets[b]) - i):
                    assert root(a) == root(b)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), *((i, i + 1) for i in range(20, 40))], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{i: 20 for i in range(20, 41)}}


# substring dedup


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(r), int(gone.sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("group", "few"), [(20_000, 24), (20_000, 2), (3, 24)])
def test_substring_dedup(spark, monkeypatch, group, few):
    monkeypatch.setattr(op10, "FEW", few)
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 120))) for _ in range(20)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 40) : rng.randint(20, 120)] for _ in range(rng.randint(0, 4))) for _ in range(50)]
    texts += [None, "", "a" * 200, "b" * 90 + "a" * 50, texts[3], texts[3]]
    frame = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(4)
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in op10.substring_dedup(frame, 24, group).collect()]
    want = [(i if i != 5 else None, *x) for i, x in enumerate(brute_cut(texts, 24))]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(found, key=order) == sorted(want, key=order)


def test_records_across_segments(monkeypatch):
    monkeypatch.setattr(op10, "SEGMENT", 1 << 10)
    data = np.frombuffer(bytes(random.Random(0).choices(b"abc", k=5000)), np.uint8)
    _, at, first, last = op10.records(data, 100, 16)
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    assert (at >= first).all() and (at <= last + 100 - 16).all()


def test_loser_tree_merges_with_shared_prefixes():
    rng = random.Random(5)
    runs, every = [], []
    for _ in range(7):
        strings = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
        every += strings
        runs.append(strings)
    streams = [iter([(op10.common(x, strings[i - 1], 0) if i else 0, x) for i, x in enumerate(strings)]) for strings in runs]
    out = list(op10.merged(streams))
    assert [x for _, x in out] == sorted(every)
    assert [h for h, _ in out[1:]] == [op10.common(a, b, 0) for (_, a), (_, b) in zip(out[:-1], out[1:], strict=True)]


def test_front_coding_round_trip(monkeypatch):
    import zstandard

    found = [(b"", b"x", 0, (1, 2, 3), False), (b"abc", b"", 3, (1, 2, -1), True), (b"abd", b"yy", 1, (9, 9, 1 << 40), False)]
    for piece in (1, 1 << 20):
        monkeypatch.setattr(op10, "PIECE", piece)
        pieces = [zstandard.ZstdCompressor().compress(x) for x in op10.front_coded(found)]
        assert [x[1:] for x in op10.unfolded(pieces)] == found


def test_substring_dedup_beyond_the_filter(spark, monkeypatch):
    """With more repeated grams than a broadcast filter takes, grams are joined to the texts: the same result."""
    monkeypatch.setattr(op10, "BLOOM_KEYS", 0)
    texts = [sentence(30) for _ in range(10)]
    texts = [*texts, texts[0] + " tail", "head " + texts[1], None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in op10.substring_dedup(frame, 40).orderBy("doc_id").collect()]
    assert found == brute_cut(texts, 40)


def test_a_hot_passage_is_sent_once(spark):
    """However many texts hold a passage, a run holds its records once; the rest is decided where it is read."""
    passage = sentence(60)
    texts = [f"{i} {passage} {i}" for i in range(3000)]
    import pyarrow as pa

    make = op10._runs(100, 25, np.full(1 << 13, 255, np.uint8), 4, False, op10.utf8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), pa.array(texts), pa.nulls(3000, pa.list_(pa.int64()))], ["a", "b", "text", "grams"])
    out = [x for x in make(iter([batch])) if x.column("target").null_count == 0]
    sent = sum(1 for b in out for pieces in b.column("run").to_pylist() for _ in op10.unfolded(pieces))
    assert sent < 3000 * 12  # the passage's inner records stand once, those that reach into a text's own words once a text


# lines and passages


def brute_units(rows, least_words, passage):
    """What is left of each (doc_id, text), by sets of the units seen before; rows in the order that decides."""
    lines, runs, out = set(), set(), {}
    for doc, text in rows:
        words, of = [], []
        split = (text or "").split("\n")
        for k, line in enumerate(split):
            own = SPACED.findall(lower(line))
            words += own
            of += [k] * len(own)
        gone = [False] * len(words)
        for i in range(len(words) - passage + 1 if passage else 0):
            run = tuple(words[i : i + passage])
            if run in runs:
                gone[i : i + passage] = [True] * passage
            runs.add(run)
        kept, at = [], 0
        for line in split:
            own = SPACED.findall(lower(line))
            mine = gone[at : at + len(own)]
            at += len(own)
            if own and (all(mine) or len(own) >= least_words and tuple(own) in lines):
                continue
            if len(own) >= least_words:
                lines.add(tuple(own))
            tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*", line)
            lead = line[: len(line) - sum(map(len, tokens))]
            kept.append(lead + "".join(t for t, g in zip(tokens, mine, strict=True) if not g))
        out[doc, text] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize(("least_words", "passage", "hot"), [(8, 0, 2000), (1, 0, 3), (1, 12, 2000), (1, 5, 2)])
def test_unit_dedup(spark, docs, monkeypatch, least_words, passage, hot):
    monkeypatch.setattr("tessera.llm.op06_unit_dedup.HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(200 + i, f"{sentence(4)}\n {sentence(3)} {rows[0][1].upper() if i else rows[0][1]}  {sentence(2)}\r\n") for i in range(3)]
    named = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, a int, b int, lines int, runs int").repartition(3)
    want = brute_units(sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")), least_words, passage)
    out = unit_dedup(named, least_words, passage)
    assert set(named.columns) <= set(out.columns) and out.count() == len(rows) and out.where("a = 1 and b = 2 and lines = 3 and runs = 4").count() == len(rows)
    found = [(r.doc_id, r.text) for r in out.where("doc_id is not null").collect()]
    assert sorted(found, key=str) == sorted(((d, want[d, t]) for d, t in rows if d is not None), key=str)


def test_unit_dedup_keeps_offsets(spark):
    line, passage = sentence(10), sentence(55)
    frame = spark.createDataFrame([(1, f"é\n{line}"), (2, f"{line.upper()}\nend"), (3, f"one {passage} two"), (4, f"own\nthree {passage} four")], "doc_id long, text string")
    out = {r.doc_id: r for r in unit_dedup(frame).collect()}
    spans = {i: [(s.start, s.end) for s in r.spans] for i, r in out.items()}
    assert spans[1] == [] == spans[3] and (spans[2] == [(0, len(line.encode()))] or "ß" in line)
    assert spans[4] == [(10, 10 + len(passage.encode()) + 1)] and out[4].text == "own\nthree four"


def test_passages_within_lines_go(spark):
    """A passage of over 50 words, set among other words in every document that holds it, stays in the earliest only."""
    shared = [sentence(51 + i) for i in range(6)]
    rows = [(i, f"{sentence(30)} {shared[i % 6]} {sentence(30)}\n{sentence(12)}") for i in range(60)] + [(100 + i, sentence(90)) for i in range(40)]
    out = {r.doc_id: r for r in unit_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == (0 if i < 6 else 1) and (shared[i % 6] in out[i].text) == (i < 6) for i in range(60))
    assert all(out[i].text == t for i, t in rows if i >= 100)


# benchmark items


def test_contamination(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    known = [t for _, t in rows if t]
    items = [("a", " ".join(known[0].split()[3:20])), ("b", "Two, words"), ("b", "one"), ("c", None), (None, "one"), ("d", ""), ("e", sentence(15)), ("f", " ".join(known[5].split()[:10]).upper().replace("ß", "ß"))]
    windows = {}
    for item, text in items:
        w = LETTERED.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n and item else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    want = collections.Counter()
    for doc, text in rows:
        w = LETTERED.findall(lower(text))
        hit, names = np.zeros(len(w), bool), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = True
                    names |= windows[tuple(w[i : i + n])]
        want[doc, len(w), int(hit.sum()), tuple(sorted(names))] += 1
    frame = spark.createDataFrame(items, "item_id string, text string")
    for part in (1 << 20, 40):  # one pass, and several
        monkeypatch.setattr("tessera.llm.op07_decontaminate.PART", part)
        out = contamination(docs.withColumn("hits", F.lit(1)), frame)
        assert collections.Counter((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), tuple(r["items"])) for r in out.collect()) == want
    assert contamination(docs, frame.where("false")).where(F.size("hits") > 0).count() == 0


# packing


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.op08_pack import encoding

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, ours = Tokenizer.from_file(path), encoding(path)
    rng = random.Random(2)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\n y é漢字   <|endof", "\x00\t\r\n don't  1234 ÿÂ"]
    texts += ["".join(rng.choice(["a", " ", "\n", "é", "字", "<|endoftext|>", "'ll", "12", "Ω ", "\u00a0", "😀"]) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert ours.encode(t, allowed_special="all") == exact.encode(t, add_special_tokens=False).ids


def test_packing_gives_back_every_document(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text").collect()
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=64).toPandas()
    ids = collections.Counter((r.doc_id, np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows)
    whole = collections.Counter()
    for doc, group in out[out.doc_id.notna() & (out.doc_id != 87)].groupby("doc_id"):
        group = group.sort_values("start")
        assert (group.start == np.concatenate(([0], np.cumsum(group.length)[:-1]))).all()
        whole[int(doc), b"".join(group["ids"])] += 1
    assert whole == collections.Counter({k: v for k, v in ids.items() if k[0] not in (None, 87)})
    assert out.length.sum() == sum(len(k[1]) // 4 * v for k, v in ids.items())
    for number, group in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (group.offset == np.concatenate(([0], np.cumsum(group.length)[:-1]))).all()
        assert group.length.sum() == 64 or number == out.sequence_id.max()
    full = out[out.sequence_id < out.sequence_id.max()].groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    assert (full.max() - full.min()).max() <= 2  # every window has every source's share


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_keeps_many_sources_apart(spark, monkeypatch, weighted):
    import public_tokenizers

    from tessera.llm import op08_pack as op

    monkeypatch.setattr(op, "CELLS", 5000)  # a few windows at once
    rows = [(i, " ".join(["word"] * (20 + i % 3)), f"site{i % 600}.org") for i in range(1200)]
    weights = {f"site{i}.org": 5.0 if i < 10 else 1.0 for i in range(600)} if weighted else None
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, weights=weights).toPandas()
    assert (out.source == (out.doc_id % 600).map("site{}.org".format)).all()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all() and out.doc_id.nunique() == 1200
    total = out.groupby("source").length.sum()
    given = out.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    assert (given.sum(axis=1).iloc[:-1] == 2048).all()
    if weighted:  # the first window, while no queue is at its end: five for one
        assert set(given.loc[0]) <= {3, 4, *range(15, 21)} and {x for x, n in given.loc[0].items() if n > 4} == {x for x, w in weights.items() if w > 1}
    else:
        far = given.cumsum().iloc[:-1]
        assert (abs(far - np.outer((far.index + 1) * 2048 / total.sum(), total)) <= 2).all(axis=None)


@pytest.mark.parametrize("weights", [None, [5, 1, 1]])
def test_grants_are_exact_monotone_and_bounded(weights):
    totals = np.array([1000, 37, 5463], np.int64)
    share = totals if weights is None else np.array(weights, np.int64) << 40
    g = grants(totals, share, 64, np.arange(200))
    assert (np.diff(g, axis=0) >= 0).all() and (g <= totals).all()
    assert (g.sum(1) == np.minimum(np.arange(200) * 64, 6500)).all()
    if weights is None:
        line = np.outer(g.sum(1), totals / totals.sum())
        assert np.abs(g - line).max() <= len(totals)


def test_grants_of_huge_totals_stay_in_proportion():
    totals = np.array([9 * 10**14, 10**14], np.int64)
    g = grants(totals, totals, 2048, np.arange(10**9, 10**9 + 50))
    assert np.abs(np.diff(g, axis=0)[:, 0] - 2048 * 0.9).max() <= 2


# shards


def test_shards(spark, docs, tmp_path):
    many = docs.where("doc_id <> 86").unionByName(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the same text of a third").alias("text"), F.lit("mine").alias("score"), F.lit(-1).alias("shard"), F.lit("h").alias("source"), F.lit("x").alias("spans")))
    out = shards(many, 4).toPandas()
    assert len(out) == many.count() and "text" not in out.columns
    sizes = out.groupby("shard")["size"].sum()
    assert set(sizes.index) == {0, 1, 2, 3} and sizes.max() - sizes.min() <= 2 * out["size"].max()
    for _, group in out.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    write(many, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(out)


@pytest.mark.parametrize("copies", [3, 400])
def test_shards_by_direct_computation(spark, copies):
    """Order, cuts and slots as a plain loop finds them, with a group of copies that stays together or (beyond LEAN of a shard) is split."""
    from tessera.llm import op09_shard as op

    rng = random.Random(copies)
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) for _ in range(2000)] + ["the same text in many rows"] * copies + [None, ""]
    frame = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(texts)], "doc_id long, text string, at int, part int, _group int").repartition(5)
    digest = {r.doc_id: (r.g, r.doc_id) for r in frame.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("g")).collect()}
    order = sorted(range(len(texts)), key=lambda i: digest[i])
    size = [len((t or "").encode()) + 1 for t in texts]
    total, at = sum(size), {}
    begin = 0
    for i in order:
        at[i] = begin
        begin += size[i]
    cuts = []
    for k in range(1, 4):
        cut = -(-total * k // 4)
        inside = next(i for i in order if at[i] <= cut < at[i] + size[i])
        group = [i for i in order if digest[i][0] == digest[inside][0]]
        lo, hi = at[group[0]], at[group[-1]] + size[group[-1]]
        cuts.append(cut if hi - lo > total / 4 * op.LEAN else lo if cut - lo < hi - cut else hi)
    want, slots = {}, collections.Counter()
    for i in order:
        shard = sum(at[i] + size[i] / 2 >= c for c in cuts)
        want[i] = (size[i], shard, slots[shard], 7, 8, 9)
        slots[shard] += 1
    out = shards(frame, 4)
    assert {r.doc_id: (r.size, r.shard, r.slot, r.at, r.part, r._group) for r in out.collect()} == want


# neighbours


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    key = hilbert(cells, 3)
    assert sorted(key) == list(range(64))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:90] = x[50]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, [None] + [1.0] * 11), (405, [1.0]), (3, x[3].tolist()), (None, x[0].tolist())]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, k=5).toPandas()
    y, hit = x.astype(float), 0
    for q in range(0, 400, 10):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:5]
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(got.score, [d[i] for i in got.vec_id], rtol=1e-12)
        if 50 <= q < 90:
            assert got.vec_id.tolist() == best.tolist()
        hit += len(set(got.vec_id) & set(best))
    assert hit >= 0.9 * 200 and set(out.query_id) == set(range(0, 400, 10))


def test_nearest_of_many_ties(spark):
    """Binary vectors: far more than k + 1 different ones at equal distance; doubles that differ below single precision."""
    rows = [(i, [float(i >> b & 1) for b in range(9)]) for i in range(1, 512)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=5, window=600).toPandas()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q in range(100, 512, 100):
        d = np.sqrt(((x - x[q - 1]) ** 2).sum(1))
        d[q - 1] = np.inf
        assert out[out.query_id == q].sort_values("rank").vec_id.tolist() == ids[np.lexsort((ids, d))[:5]].tolist()
    close = [(0, [1.0, 0.0])] + [(i, [1.0, 1 + (20 - i) * 1e-12]) for i in range(1, 20)]
    out = nearest(spark.createDataFrame(close, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [19, 18, 17]


def test_nearest_of_nothing_and_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2**0.5)]
    assert nearest(frame.where("false"), F.lit(True)).count() == 0


def test_recall_on_the_table(spark, data):
    frame = spark.read.parquet(data.replace("0.001", "0.1") + "/embeddings.parquet")
    out, table = queries.op4_curves(spark, data.replace("0.001", "0.1")).toPandas(), frame.toPandas()
    x, ids, hit = np.stack(table.embedding).astype(float), table.vec_id.to_numpy(), 0
    asked = np.flatnonzero(ids % 100 == 0)
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hit += len(set(out[out.query_id == ids[i]].vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
    assert hit >= 0.9 * 10 * len(asked)


# toxicity


def test_segments_are_all_maximal():
    def brute(s):
        out, stack = [], [(0, len(s))]
        while stack:
            a, b = stack.pop()
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                out.append((best[2], best[3]))
                stack += [(a, best[2]), (best[3], b)]
        return sorted(out)

    rng = random.Random(1)
    for _ in range(60):
        s = [rng.choice((-3, -2, -1, 1, 2, 4)) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert sorted((a, b) for a, b, _ in segments(np.array(s))) == brute(s)


def test_held_out_accuracy(spark, data):
    folder = data.replace("0.001", "0.1")
    out = queries.op5_toxicity(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])
    own = out[out.held_out]
    rank, toxic = own.score.rank(), own.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93 and ((own.predicted == 1) == toxic).mean() > 0.94


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)] + [(None, 1), (3, None), (500, 1)], "doc_id long, toxic int")
    out = scored(docs, fitted(docs, labels))
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0 and set(docs.columns) <= set(out.columns)
    nothing = scored(docs, fitted(docs, labels.where("false")))
    assert {r.score for r in nothing.select("score").collect()} == {0.0}
    assert scored(empty, fitted(empty, labels)).count() == 0 and held_out("doc_id") is not None


# pages and addresses


def test_tree_fits_its_table():
    tree = grown(LABELLED[:, :-1], LABELLED[:, -1])
    assert all(tree.of(tuple(r[:-1])) == r[-1] for r in LABELLED)
    rng = np.random.default_rng(0)
    for _ in range(5000):  # whatever the words and links: the article's own blocks stay, furniture and what lies outside goes
        x = (rng.integers(1, 200), round(rng.random(), 1), rng.integers(0, 200), round(rng.random(), 1), rng.integers(0, 200), round(rng.random(), 1))
        assert tree.of((*x, 0, 2)) == 1 and tree.of((*x, 1, rng.integers(0, 3))) == 0 and tree.of((*x, 0, 0)) == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>Home <a href=x>About</a></nav><div class="cookie-notice">We use cookies on this site to make it
better for you and our partners.</div><div id="content" class="post"><h1>Title  here</h1><p>First <b>par</b>a &amp; more words to be read by all &lt;x&gt; today.<p>Short.<div class="sidebar">Side text</div>
<blockquote>Quote me</blockquote><form><label>Email</label><input></form><section id="comments"><p>Nice article, I liked it a lot indeed, thanks.</p></section></div><aside>Related <a>x</a></aside><footer>&copy; x</footer>
<script>if (a<b) "</p>"</script></body></html>"""


def test_main_text():
    tree = grown(LABELLED[:, :-1], LABELLED[:, -1])
    assert main_text(PAGE, tree)[0] == "Title here First para & more words to be read by all <x> today. Short. Quote me"
    assert main_text("<article><p>cut off &amp", tree)[0] == "cut off &"
    assert main_text("<article>a<br>b <!-- no -->c<p>d</article>", tree)[0] == "a b c d"
    for odd in ("", "<", "<a", '<a title="x>y', "&#x110000; &bogus;", "<p>" * 2000, "<script>never closed", "</div></p>"):
        main_text(odd, tree)


LONG = "A paragraph of the story that goes on for a good many words, as paragraphs of stories on pages of the web do, until it ends with a stop."
OTHER = "Another one follows it with other words, again enough of them that nobody would take it for a menu, a button or a line below a picture."
LINKS = "<ul><li><a href=/a>News</a><li><a href=/b>Sport today</a><li><a href=/c>Weather</a></ul>"


@pytest.mark.parametrize(("page", "want"), [
    ("<html><body><div class='content with-sidebar'><p>One two three.<p>Four five</div>", "One two three. Four five"),
    ('<article class="post has-comments comments-open"><p>One two.</article>', "One two."),
    ("<article><p>Intro <video><p>No support.</p></video></p><p>The article</p></article>", "Intro The article"),
    (f"<html><head><title>T</title><body><p>{LONG}", LONG),
    (f"<html><head><meta charset=x><p>{LONG}<p>{OTHER}", f"{LONG} {OTHER}"),
    (f"<body>{LINKS}<h2>A heading</h2><p>{LONG}</p><p>{OTHER}</p>{LINKS}</body>", f"A heading {LONG} {OTHER}"),
    (f"<body><div class=no-sidebar><p>{LONG}</p><h3>Why so</h3><p>{OTHER}</p></div>{LINKS}", f"{LONG} Why so {OTHER}"),
    (f"<body><table><tr><td>{LINKS}<td><p>{LONG}<p>{OTHER}</table>", f"{LONG} {OTHER}"),
    (f"<div id=nav>{LINKS}</div><div class=page-without-ads>{LONG}<br>{OTHER}</div><div class=site-footer>{OTHER}</div>", f"{LONG} {OTHER}"),
    (f"<body><p>{LONG} <a href=x>Read on</a></p><div class='related'>{OTHER}</div>", f"{LONG} Read on"),
    (f"<div class=mainContent><p>Short.<p>{LONG}</div><div><p>{OTHER}</div>", f"Short. {LONG}"),
    (f"<body><form><p>{OTHER}</form><p>{LONG}</p><aside><p>{OTHER}</aside><p hidden>{OTHER}</p>", LONG),
    (f"<body>{LINKS}<p>{LONG}</p><div><a href=1>Share this page</a> <a href=2>Print it</a></div>{LINKS}", LONG),
    (f"<p>{LONG}</p><object><p>{OTHER}</object><p>{OTHER}", f"{LONG} {OTHER}"),
])
def test_pages_by_hand(page, want):
    tree = grown(LABELLED[:, :-1], LABELLED[:, -1])
    assert main_text(page, tree)[0] == want
    assert main_text(page.replace(LONG, " ".join([LONG] * 3000)), tree)[0] == want.replace(LONG, " ".join([LONG] * 3000))


def test_neighbours_decide_in_the_tree():
    tree = grown(LABELLED[:, :-1], LABELLED[:, -1])
    used = set()

    def walk(node):
        if node.feature >= 0:
            used.add(node.feature)
            walk(node.below)
            walk(node.above)

    walk(tree)
    assert used & {2, 3} and used & {4, 5}  # words or link density of the block before, and of the one after


def test_pages_of_the_table(spark, data):
    out = {r.page_id: r for r in queries.op1_extract(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        import html

        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", article))).split())
        assert out[r.page_id].text == want and out[r.page_id].n_chars == len(want)


def test_extraction_edges(spark):
    frame = spark.createDataFrame([(1, None, "u"), (2, "", None), (3, PAGE, "v"), (3, PAGE, "v")], "page_id long, html string, text string")
    out = extracted(frame).collect()
    assert [(r.page_id, r.n_chars) for r in out[:2]] == [(1, 0), (2, 0)] and out[2] == out[3] and out[0].text == ""
    assert extracted(frame.where("false")).count() == 0


def test_url_rules(spark):
    urls = [None, "", "nourl", "http://A.ORG", "http://a.org/", "ftp://X.example.org/en/12?z", "a://b://c/d#e", "http://q.com/de/?", "https://q.com/fr/x", "http://example.org/es/", "http://notexample.org/es/", "http://com/fr/"]
    out = {r.url: r for r in filtered(spark.createDataFrame([(u, "mine") for u in urls], "url string, rule string")).collect()}
    assert [(out[u].host, out[u].path, out[u].rule) for u in urls] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.org", "", None), ("a.org", "/", "org/"), ("x.example.org", "/en/12", "example.org/en/1"), ("b:", "//c/d", None), ("q.com", "/de/", "com/de/"),
        ("q.com", "/fr/x", "com/fr/"), ("example.org", "/es/", "example.org/es/"), ("notexample.org", "/es/", "org/"), ("com", "/fr/", "com/fr/"),
    ]
    assert all(r.verdict in ("allow", "block") for r in out.values()) and out["http://q.com/de/?"].verdict == "block"


def test_url_filter_keeps_columns_of_its_own_names(spark):
    rows = [("http://a.org/x", 1, 2, 3, 4), ("http://b.net/" + "y" * 100_000, 1, 2, 3, 4)]
    out = filtered(spark.createDataFrame(rows, "url string, _action int, _host int, said int, own_path int"))
    assert [(r._action, r._host, r.said, r.own_path) for r in out.collect()] == [(1, 2, 3, 4)] * 2


def test_url_models_learn_from_rules(spark, data):
    """Of addresses that rules decide and the models have not seen, the models alone place most as the rules do."""
    from tessera.llm import op02_url_filter as op

    pages = spark.read.parquet(data.replace("0.001", "0.1") + "/pages.parquet")
    host, path = op.split(F.col("url"))
    known = op.ruled(pages.select(host.alias("host"), path.alias("path")), op.RULES).where("_action is not null")
    known = known.select("host", "path", (F.col("_action") == "allow").cast("int").alias("accepted"), F.pmod(F.xxhash64("host", "path"), F.lit(5)).cast("int").alias("fold"), F.pmod(F.hash("path", "host"), F.lit(4)).alias("part"))
    seen, unseen = known.where("part > 0"), known.where("part = 0").toPandas()
    tables = op._trained(seen)
    import pyarrow as pa

    score = op.scores(pa.RecordBatch.from_pandas(unseen[["host", "path"]]), tables)
    right = (score >= op._threshold(seen, tables)) == (unseen.accepted == 1)
    assert right[unseen.accepted == 1].mean() > 0.8 and right[unseen.accepted == 0].mean() > 0.8


def test_url_scores_are_of_exact_counts(spark):
    """With more n-grams than a table of 2^17 slots has, scores are still those of a plain count."""
    from tessera.llm import op02_url_filter as op

    draw = random.Random(3)
    urls = sorted({"http://" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)) + draw.choice([".org/", ".com/de/"]) + str(draw.randrange(10**9)) for _ in range(4000)})
    out = filtered(spark.createDataFrame([(u,) for u in [*urls, urls[0], "", None]], "url string"))
    rows = out.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(5))).collect()
    pairs, contexts = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for r in rows:
        if r.rule and r.fold:
            text, k = "\0" * op.ORDER + r.host + r.path, int(r.verdict == "allow")
            for i in range(op.ORDER, len(text)):
                for n in range(op.ORDER + 1):
                    pairs[k][text[i - n : i + 1]] += 1
                    contexts[k][text[i - n : i]] += 1
    assert len(pairs[0]) > 1 << 16
    for r in rows[::40] + rows[-3:]:
        text, want = "\0" * op.ORDER + r.host + r.path, 0.0
        for i in range(op.ORDER, len(text)):
            for k, sign in ((1, 1), (0, -1)):
                p = 1 / 256
                for n in range(op.ORDER + 1):
                    p = (pairs[k][text[i - n : i + 1]] + op.SMOOTH * p) / (contexts[k][text[i - n : i]] + op.SMOOTH)
                want += sign * np.log(p)
        assert abs(r.score - want / max(len(text) - op.ORDER, 1)) < 1e-9


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, data, name):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from oracle import differences

    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], data) == []


def test_every_operator_takes_an_empty_table(spark, empty):
    import public_tokenizers

    assert ngram_join(empty).count() == 0 and unit_dedup(empty).count() == 0 and op10.substring_dedup(empty).count() == 0 and shards(empty).count() == 0
    assert pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert contamination(empty, spark.createDataFrame([], "item_id int, text string")).count() == 0
    assert filtered(spark.createDataFrame([], "url string")).count() == 0


def test_digests_of_the_queries(spark, data):
    """The thin queries' digest columns are those of the operators' real outputs."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    cut = {i: x for i, x in zip(texts, brute_cut(list(texts.values()), 400), strict=True)}
    for r in queries.op10_suffix_dedup(spark, data).collect():
        n, removed, kept = cut[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept).hexdigest())
    for r in queries.op9_shard(spark, data).collect():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
