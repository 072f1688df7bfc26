"""Prefix trie, lexical search and LSH forest against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerkit import session
from ledgerkit.llm import lexical, lshforest, prefixes

# Prefix trie ------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node, convs_of in members.items():
        below, leaves, saved = [node], 0, 0
        while below:
            at = below.pop()
            below += children[at]
            leaves += not children[at]
            words = len(re.findall(rb"[^\x20\x09-\x0D]+", at[-1][1].encode())) if at else 0
            saved += (len(members[at]) - 1) * words
        out.add((min(convs_of), len(node), min(members[node[:-1]]) if node else None, len(convs_of), len(children[node]),
                 leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


def odd_conversations(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([None, *range(0, 45), 61, 62, 10**12 + 3])
        for t in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([None, t, t, t, 1]), rng.choice(["user", "assistant", None]),
                         rng.choice(["a b", "c", "", None, "ä  x\ty"])))
    return rows + rows[:5]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, shard_nodes, unit", [(1, None, 4096), (2, 3, 2), (3, 1, 1)])
def test_trie_against_brute_force(spark, seed, shard_nodes, unit, monkeypatch):
    monkeypatch.setattr(prefixes, "UNIT", unit)
    rows = odd_conversations(seed)
    convs = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit("x")).repartition(4)
    found = {tuple(r) for r in prefixes.trie(convs, shard_nodes=shard_nodes).collect()}
    assert found == brute_trie(rows)


def test_trie_of_one_conversation_in_slices_and_of_none(spark, monkeypatch):
    from ledgerkit.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 20)
    rows = [(c, t, "user", f"turn {t} of it") for c in (0, 1, 20) for t in range(90)]
    assert {tuple(r) for r in prefixes.trie(spark.createDataFrame(rows, CONV)).collect()} == brute_trie(rows)
    assert prefixes.trie(spark.createDataFrame([], CONV)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(-2**63, 2**63 - 1), st.integers(-2**63, 2**63 - 1)), max_size=300))
def test_perfect_hash_numbers_all_keys(keys):
    k1, k2 = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    table = prefixes.PerfectHash.build(k1, k2)
    assert sorted(table.slots(k1, k2)) == list(range(len(keys)))


def test_digests_that_differ_in_content_stop_the_job(spark):
    rows = [(1, 1, b"x", 1, 5, 6, 0, 0), (2, 1, b"y", 1, 5, 6, 0, 0)]
    steps = spark.createDataFrame(rows, "conv long, depth long, content binary, words long, k1 long, k2 long, p1 long, p2 long")
    with pytest.raises(Exception, match="share a digest"):
        prefixes.nodes_of(steps).collect()


def test_id_hash_of_a_large_group(spark):
    ends = spark.range(30_000).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), F.col("id").alias("conv"))
    found = prefixes.id_hashes(ends.unionAll(spark.createDataFrame([(9, 9, 4)], ends.schema))).collect()
    want = {(1, 2): ",".join(map(str, range(30_000))), (9, 9): "4"}
    assert {(r[0], r[1]): r[2] for r in found} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# Lexical search ---------------------------------------------------------------------------------


def terms_of(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w)
            for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=20):
    tfs = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tfs), sum(c.total() for _, c in tfs)
    df = Counter(w for _, c in tfs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    queries = defaultdict(Counter)
    for i, t in items:
        queries[i].update(terms_of(t))
    out = []
    for i, query in queries.items():
        scores = []
        for d, c in tfs:
            m = 75 + 25 * c.total() * n_docs // max(n_terms, 1)
            s = sum(times * weight[w] * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in query.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ärger", "你好", "X9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 8, 30, 200])))) for i in range(n)]
    docs += docs[:30] + [(n + i, docs[i][1]) for i in range(20)] + [(None, "w5 w6"), (n + 50, None), (n + 51, ""), (n + 52, "?!")]
    items = [(i, " ".join(rng.choices(vocabulary, k=12)) + " w1 w1, W2") for i in range(9)]
    return docs, items + [(3, "w7 unheard-of"), (50, None), (51, "unheard-of"), (None, "w9; w8")]


@pytest.mark.parametrize("seed, block", [(1, 200_000), (2, 15)])
def test_search_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(30)
    index = session.settle(lexical.build(frame))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = corpus(3, 40)
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(lexical.build(none), asked).collect() == []
    some = session.settle(lexical.build(spark.createDataFrame(docs, "doc_id long, text string")))
    assert lexical.search(some, asked.limit(0)).collect() == []


def test_pair_bounds_skip_more_than_the_terms_own():
    docs, items = corpus(4, 3000)
    writer = lexical._Writer()
    for d, t in docs:
        writer.add(d, (t or "").encode())
    import pyarrow as pa

    rows = pa.Table.from_batches([writer.batch(0, pa.int64())])
    lengths = np.array(writer.lengths)
    names = [t.as_py() for t in rows.column("term")]
    df = dict(zip(names, rows.column("df").to_pylist(), strict=True))
    n_docs = int((lengths > 0).sum())
    queries = lexical.Queries({w: i for i, w in enumerate(names[1:])}, np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in names[1:]]), [], n_docs, int(lengths.sum()))
    queries.items = [(i, [(queries.codes[w.encode()], c) for w, c in Counter(terms_of(t)).items() if w.encode() in queries.codes])
                     for i, t in items[:9]]
    queries.pair_up()
    part = lexical.Shard(rows, queries)
    part.measure()
    whole = sum(len(part.lists[c][0]) for _, terms in queries.items for c, _ in terms)
    work, answers = [], []
    everywhere = np.arange(len(docs))
    alone = {(a, b): (part.largest.get(a, 0) + part.largest.get(b, 0), everywhere) for a, b in queries.pairs()}
    for joint in (part.joint, alone):
        part.joint, part.work = joint, 0
        answers.append([tuple(map(tuple, part.best(i, 0))) for i in range(9)])
        work.append(part.work)
    assert answers[0] == answers[1] and work[0] < work[1] < whole


# LSH forest -------------------------------------------------------------------------------------


def brute_groups(texts, size=4, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
        sets[i] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in texts}


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts, number = {}, itertools.count()
    for size, change in ((120, 2), (40, 6), (9, 3), (5, 9), (2, 4)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(change + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts[next(number)] = " ".join(copy)
    template = [word() for _ in range(90)]
    for _ in range(80):  # share most words, but do not link
        texts[next(number)] = " ".join(template + [word() for _ in range(40)])
    texts |= {next(number): t for t in ("", None, "a b", "A b", "one", texts[3], texts[3])}
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_all_pairs(spark, seed):
    texts = families(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("region", F.lit(1)).repartition(5)
    assert {tuple(r) for r in lshforest.groups(docs).collect()} == brute_groups(texts)


@pytest.mark.parametrize("pairs_per_row", [20, 0])
def test_forest_with_regions_cut_into_blocks(spark, monkeypatch, pairs_per_row):
    monkeypatch.setattr(lshforest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(lshforest, "FEW_ROWS", 5)
    monkeypatch.setattr(lshforest, "PART_EDGES", 15)
    monkeypatch.setattr(lshforest, "PAIRS_PER_ROW", pairs_per_row)
    texts = families(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in lshforest.groups(docs).collect()} == brute_groups(texts)


def test_small_regions_are_compared_whole_and_large_ones_by_depth():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 3, (200, lshforest.REST)).astype(np.uint32)
    seq = seq[np.lexsort(seq.T[::-1])]
    comp = np.arange(200)
    pairs = lambda *a: {(int(x), int(y)) for p, q in lshforest._region_pairs(*a) for x, y in zip(p, q, strict=True)}
    found = pairs(seq, comp, "all")
    assert all((i, i + 1) in found for i in range(199))
    for depth in range(1, lshforest.REST + 1):
        prefix = seq[:, :depth]
        for i, j in itertools.combinations(range(200), 2):
            if (prefix[i] == prefix[j]).all() and (prefix == prefix[i]).all(1).sum() <= lshforest.REGION:
                assert (i, j) in found
    assert pairs(seq[:10], comp[:10], "all") == set(itertools.combinations(range(10), 2))
    assert pairs(seq[:10], comp[:10], "near") == {(i, i + 1) for i in range(9)} and not pairs(seq[:10], comp[:10], "hub")
    assert not pairs(seq, np.zeros(200, int), "all")
    copies = np.tile(np.arange(lshforest.REST, dtype=np.uint32), (50, 1))
    copies[np.arange(49), np.arange(49) % lshforest.REST] = 99 + np.arange(49)
    assert lshforest._hub(copies) == 49


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_contracted_links(links):
    root = {i: i for i in range(31)}
    for _ in range(31):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    nodes, low = lshforest.contract(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == {i: root[i] for i in {x for link in links for x in link}}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(6)
    grams = np.unique(rng.integers(0, 1 << 63, 6000, np.uint64))
    a, b = np.sort(grams[:4500]), np.sort(grams[500:5000])
    one, other, again = lshforest.signatures([a, b, a])
    assert (one == again).all()
    assert abs((one == other).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
