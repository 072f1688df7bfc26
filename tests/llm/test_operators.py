"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerkit.llm import (
    common, decontaminate, entries, jaccard, licenses, lines, packing, repeats, secrets, shards, toxicity,
)
from ledgerkit.session import settle

WORDS = [a + b for a in ("ka", "lo", "mi", "su", "te") for b in ("ran", "bel", "dor", "fin", "gus", "hal")]


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Jaccard join ---------------------------------------------------------------------------------

def components(texts):
    """Brute force: all pairs, smallest id reachable."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    best = {i: i for i in texts}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {i: (len(sets[i]), best[i]) for i in texts}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [rng.choices(WORDS, k=rng.randint(3, 60)) for _ in range(6)]
    out = {}
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize("seed,pairs_per_row", [(1, 2), (2, 0)])
def test_jaccard_against_all_pairs(spark, seed, pairs_per_row, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", pairs_per_row)  # 0: more rounds of hubs
    texts = near_copies(seed)
    found = jaccard.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)


@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(0, 99))
@settings(max_examples=300, deadline=None)
def test_prefixes_of_linked_sets_share_enough(a, b, salt):
    if 100 * len(a & b) < 75 * len(a | b):
        return
    order = lambda s: sorted(s, key=lambda x: zlib.crc32(f"{x},{salt}".encode()))
    prefix = lambda s: set(order(s)[:len(s) - jaccard.needed(len(s)) + jaccard.prefix_share(len(s))])
    shared = len(prefix(a) & prefix(b))
    assert shared >= jaccard.prefix_share(len(a)) and shared >= jaccard.prefix_share(len(b))


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z"), (None, "q r s")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None"]


def test_keep_one_with_ids_in_several_rows(spark, monkeypatch):
    """Whatever the bitmap lets through by mistake, an exact join decides."""
    rows = [(i, f"w{i} x{i} y{i} z{i} v{i} u{i} t{i}") for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + rows[:3] + [(5, "another text of five here"), (None, rows[7][1]), (None, None), (41, None), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted({r for r in rows if r[0] is not None and r[0] < 100} | {(41, None)}, key=str)
    for bits in (8, 64, 1 << 15):
        monkeypatch.setattr(common, "BITMAP_BITS", bits)
        kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
        assert sorted((r for r in kept if r[0] is not None), key=str) == want
        assert sorted(str(r) for r in kept if r[0] is None) == sorted(str(r) for r in rows if r[0] is None)


def test_near_keys_tells_rows_apart_where_they_lie(spark):
    """Wide rows outside the keys are not shuffled; none of the keys is lost."""
    rows = spark.range(0, 20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("k"), F.lit("text").alias("text"))
    keys = settle(spark.range(0, 20_000, 10).select(F.col("id").alias("key")))
    near, far = common.near_keys(rows, "k", keys), common.near_keys(rows, "k", keys, "left_anti")
    assert near.columns == far.columns == ["k", "text"]
    assert near.where("k % 10 = 0").count() == 2_000 and near.count() < 2_000 + 18_000 * 0.06
    assert near.count() + far.count() == 20_000 and far.where("k is null").count() == 20
    for df in (near, far):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" in plan


# Repeats --------------------------------------------------------------------------------------

def removed(texts, length=repeats.LENGTH):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[p:p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])[:len(gone)]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_passages(seed):
    rng = random.Random(seed)
    letters = "abcdefgh ä"
    passages = ["".join(rng.choices(letters, k=k)) for k in (399, 400, 401, 460, 700, 1500)]
    passages.append("xyz" * 400)
    out = {}
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append("".join(rng.choices(letters, k=rng.randint(0, 300))))
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 1, 7, 30])
            parts.append(p[cut:len(p) - rng.choice([0, 0, 1, 9])])
        out[i] = "".join(parts)
    return out


@pytest.mark.parametrize("seed,bucket_places", [(1, 100_000), (2, 100_000), (1, 1), (2, 4)])
def test_repeats_against_all_strings(spark, seed, bucket_places, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_PLACES", bucket_places)  # larger buckets are refined by Spark
    monkeypatch.setattr(repeats, "BLOCK_PLACES", 8)
    texts = repeated_passages(seed)
    found = repeats.remove(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    assert got == removed(texts)


def test_repeats_of_the_documents(spark, sf):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in entries.op4_repeat_removal(spark, sf).collect()}
    assert got == removed(texts_of(spark, sf))


@pytest.fixture
def plain_joins(spark):
    """No broadcast, and hot partitions are split from a few KB on."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_bucket_of_repeats_is_split(spark, plain_joins, monkeypatch):
    # No frame that joins buckets also sums them in the join's stage, where Spark cannot split a hot one.
    monkeypatch.setattr(repeats, "BUCKET_PLACES", 1)
    frames = []
    monkeypatch.setattr(repeats, "settle", lambda df: frames.append(df) or settle(df))
    docs = spark.createDataFrame(list(repeated_passages(1).items()), "doc_id long, text string")
    spans = repeats.spans(docs.select(F.col("doc_id").alias("doc"), F.hash("text").alias("tag"), "text"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*frames, spans]]
    assert sum("SortMergeJoin [h#" in p for p in plans) >= 5
    assert not [p for p in plans if "SortMergeJoin [h#" in p and "Aggregate(keys=[h#" in p]
    # A bucket and a name with most rows: all pieces of the split join together give every row.
    names = settle(spark.range(0, 40_000, 1, 8).selectExpr(
        "if(id % 8 = 0, id div 16, -1) as h", "if(id % 8 = 0, id div 16, -1) as name", "id as mid"))
    shared = repeats._shared(names)
    assert sorted(r["mid"] for r in shared.collect()) == list(range(40_000))
    assert "SortMergeJoin(skew=true)" in shared._jdf.queryExecution().executedPlan().toString()


# Packing --------------------------------------------------------------------------------------

def test_packing_round_trip(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(spark, sf)
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        assert [t for _, ids, _ in sorted(pieces) for t in ids] == whole[i]
        assert all(n == len(whole[i]) for _, _, n in pieces)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0  # no padding at all


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.sampled_from(
    ["I'll don't", "a\x1cb", "²½3 x", "<|endoftext|> y", "İ Σ Ångström", " a\u0085b"]), max_size=6))
@settings(max_examples=200, deadline=None)
def test_tokenizer_gives_the_ids_of_whole_texts(texts):
    own = packing.tokenizer_of(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in own.encode(texts)] == [
        own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sum_of_squares_picks_the_least_rise():
    rng = random.Random(5)
    bins = packing.SumOfSquares(64)
    for number in range(300):
        before = bins.counts.copy()
        size = rng.randint(1, 63)

        def after(level, before=before, size=size):
            counts = before.copy()
            counts[level] -= level > 0
            if level + size < 64:
                counts[level + size] += 1
            return int((counts ** 2).sum())

        choices = [h for h in range(0, 64 - size + 1) if h == 0 or before[h]]
        bins.place((number, 0, np.zeros(size)))
        assert int((bins.counts ** 2).sum()) == min(map(after, choices))


# Shards ---------------------------------------------------------------------------------------

def test_shards_are_exact_and_uniform(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7, "doc_id")
    n, seen = docs.count(), Counter()
    for seed in range(4):
        rows = shards.shuffle(docs, 6, seed, range_rows=10).select("doc_id", "shard", "slot").collect()
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == n
        for k, size in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(size))
        seen.update((r["doc_id"] % 7, r["shard"]) for r in rows)
        again = shards.shuffle(docs, 6, seed, range_rows=10).select("doc_id", "shard", "slot").collect()
        assert sorted(rows) == sorted(again)
    assert min(seen.values()) > 0.4 * 4 * n / 42


def test_communication_matrix_sums():
    counts = [0, 5, 17, 100, 1]
    sizes = shards.shard_sizes(sum(counts), 5)
    before = np.concatenate([[0], np.cumsum(counts)])
    matrix = np.array([shards.matrix_row(before, sizes, 3, p) for p in range(len(counts))])
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes.tolist()
    for p, row in enumerate(matrix):
        labels = np.concatenate([b[0] for b in shards.assignments(row, 3, p)] or [np.zeros(0, int)])
        assert np.bincount(labels, minlength=5).tolist() == row.tolist()


def test_matrix_rows_follow_the_hypergeometric_law():
    counts, sizes = [3, 5, 4], np.array([4, 4, 4])
    before = np.concatenate([[0], np.cumsum(counts)])
    drawn = np.array([[shards.matrix_row(before, sizes, seed, p) for p in range(3)] for seed in range(3000)])
    for p, n in enumerate(counts):
        share = [math.comb(4, k) * math.comb(8, n - k) / math.comb(12, n) for k in range(min(4, n) + 1)]
        for shard in range(3):
            seen = np.bincount(drawn[:, p, shard], minlength=len(share)) / 3000
            assert np.abs(seen - share).max() < 0.035


def test_a_shuffle_over_many_forced_ranges(spark):
    df = spark.range(0, 5000, 1, 6)
    rows = shards.shuffle(df, 3, 1, range_rows=1).collect()
    for k in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sorted(r["id"] for r in rows) == list(range(5000))


# Lines ----------------------------------------------------------------------------------------

def base(text):
    words = [w for w in (text or "").replace("\t", " ").split(" ")]
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if triples[tuple(words[i:i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


@given(st.text(alphabet="ab#|< \n\té\x0b", max_size=60) | st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_base_statistics(text):
    found = lines.read(text.encode("utf-8", "replace").decode())
    assert (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words) == base(
        text.encode("utf-8", "replace").decode())


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
@settings(max_examples=100, deadline=None)
def test_viterbi_is_the_best_labelling(scores, moves):
    move = np.array(moves).reshape(2, 2)
    field = lines.Field(np.array([1.0]), move)
    value = lambda s: sum(x for x, on in zip(scores, s, strict=True) if on) + sum(
        move[a, b] for a, b in zip(s, s[1:], strict=False))
    found = tuple(field.decode(np.array(scores)[:, None]).astype(int))
    best = max(value(s) for s in itertools.product((0, 1), repeat=len(scores)))
    assert value(found) == pytest.approx(best)


# Classifiers on held-out rows ------------------------------------------------------------------

@pytest.fixture(scope="module")
def more(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_quality_and_toxicity_on_held_out_rows(spark, more):
    labels = spark.read.parquet(f"{more}/labels.parquet")
    for query, column in ((entries.op1_quality_classifier, "quality"), (entries.op8_toxicity, "toxic")):
        rows = query(spark, more).where("held_out").join(labels, "doc_id").select("predicted", column).collect()
        assert len(rows) > 50 and np.mean([r[0] == r[1] for r in rows]) > 0.9, column


def test_lines_keep_good_documents(spark, more):
    labels = spark.read.parquet(f"{more}/labels.parquet")
    rows = entries.op7_quality_rules(spark, more).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95


def test_mixed_texts_are_split_at_the_right_line(spark):
    """Halves and alternating lines, of held-out texts; many texts have lines of both labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    field = lines.train(docs, labels)
    prose = ["The committee met in the old hall and spoke about the new bridge for three hours.",
             "Most of the members wanted a wider road, but the costs were too high for the town."] * 5
    poor = ["click here!!! $$$ WIN >>> 100% free <<< $$$", "$$$ BUY NOW !!! ### best *** price $$$ 99% off"] * 5
    poor = [f"{line} {i}" for i, line in enumerate(poor)]
    prose = [f"{line} That was {i} years ago." for i, line in enumerate(prose)]
    assert field.decode(lines.read("\n".join(prose + poor)).features).tolist() == [True] * 10 + [False] * 10
    assert field.decode(lines.read("\n".join(poor + prose)).features).tolist() == [False] * 10 + [True] * 10
    mixed = [x for pair in zip(prose, poor, strict=True) for x in pair]
    assert field.decode(lines.read("\n".join(mixed)).features).tolist() == [True, False] * 10
    found = lines.judge(docs, field).where("n_lines > 1").select("content_share", "n_lines", "content_lines").collect()
    assert any(0 < r["content_lines"] < r["n_lines"] for r in found)
    assert (np.abs(field.move) < 6).all()


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = toxicity.fit(["bad x y", "good z w"] * 8, [1, 0] * 8)
    for k in net.w:
        net.w[k] = rng.standard_normal(net.w[k].shape) * 0.3
    gates, mask = rng.standard_normal((2, 5, 6 * toxicity.HIDDEN)), np.ones((2, 5))
    mask[1, 3:] = 0
    slope = np.array([1.0, -0.5])
    grads, d_gates = net.backward(gates, mask, slope, net.forward(gates, mask, keep=True))
    loss = lambda: float(net.forward(gates, mask) @ slope)
    for name in ("uf", "ub", "wa", "va", "wo"):
        at = tuple(0 for _ in net.w[name].shape)
        net.w[name][at] += 1e-3
        up = loss()
        net.w[name][at] -= 2e-3
        down = loss()
        net.w[name][at] += 1e-3
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3), name
    gates[0, 2, 3] += 1e-3
    up = loss()
    gates[0, 2, 3] -= 2e-3
    assert d_gates[0, 2, 3] == pytest.approx((up - loss()) / 2e-3, abs=2e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        starts, _ = toxicity.window_grid([n])
        assert set(range(n)) <= {s + i for s in starts for i in range(toxicity.WINDOW)}


# Secrets --------------------------------------------------------------------------------------

def test_secrets(spark):
    rng = random.Random(3)
    key = lambda k, a="abcdef0123456789": "".join(rng.choices(a, k=k))
    rows, wanted = [], set()
    for i in range(120):
        words = " ".join(rng.choices(WORDS, k=8))
        kind = i % 6
        secret = {0: key(18), 1: key(40), 2: "AKIA" + key(16, "ABCDEFGHIJKLMNOP234567")}.get(kind)
        text = {0: f"{words} password={secret} {words}", 1: f'{words} token = "{secret}" {words}', 2: f"{words} {secret} {words}",
                3: f"{words} 4111{key(12, '0123456789')} {words}", 4: f"{words} see /var/lib/{key(4)}/file_2024_{i}.txt {words}",
                5: f"{words}: {words}"}[kind]
        rows.append((i, text))
        if secret:
            wanted.add((i, secret))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = secrets.train(secrets.weak_labels(secrets.findings(docs)))
    found = {(r["doc_id"], r["value"]) for r in secrets.judge(secrets.findings(docs), forest).where("is_secret").collect()}
    assert found == wanted
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, forest).collect()}
    for i, text in rows:
        mine = [s for j, s in wanted if j == i]
        assert clean[i] == (text.replace(mine[0], secrets.MASK) if mine else text)


def test_random_values_without_a_key_word_are_no_negatives(spark):
    rng = random.Random(5)
    key = lambda k=40: "".join(rng.choices("abcdef0123456789", k=k))
    for left in ("Authorization: Bearer ", "DEPLOY_CRED ", "see "):
        assert secrets.weak_label(key(), left) is None
    assert [secrets.weak_label(v, "see ") for v in ("4111222233334444", "/var/lib/file_2024_1.txt", "release-2024-01-02")] == [0, 0, 0]
    assert secrets.weak_label(key(), "commit ") == 0 and secrets.weak_label(key(), "token = ") == 1
    rows = [(i, f"words here token = \"{key()}\" and words {rng.randrange(10**15, 10**16)} there {rng.choice(WORDS)}") for i in range(60)]
    tests = {100: "Authorization: Bearer {}", 101: "DEPLOY_CRED {}", 102: "and then {} follows"}
    wanted = {i: key() for i in tests}
    clean = [(200, f"commit {key()} fixes it"), (201, "id 0b5e7c1a-93d4-4f1e-8a2b-6c7d8e9f0a1b given"), (202, "see /var/lib/file_2024_1.txt")]
    docs = spark.createDataFrame(rows + [(i, t.format(wanted[i])) for i, t in tests.items()] + clean, "doc_id long, text string")
    found = secrets.findings(docs)
    forest = secrets.train(secrets.weak_labels(found))
    got = {(r["doc_id"], r["value"]) for r in secrets.judge(found, forest).where("is_secret and doc_id >= 100").collect()}
    assert got == set(wanted.items())
    hidden = {r["doc_id"]: r["text"] for r in secrets.redact(docs.where("doc_id >= 100"), forest).collect()}
    assert hidden == {i: t.format(secrets.MASK) for i, t in tests.items()} | dict(clean)


def test_the_forest_is_better_than_the_rule_on_held_out_findings():
    """Labelled findings of known truth: secrets with and without a key word, and values set to key words that are none."""
    rng = random.Random(8)
    key = lambda k=32, a="abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789": "".join(rng.choices(a, k=k))
    name = lambda: "-".join(rng.choices(WORDS, k=3)) + str(rng.randrange(2000, 2030))
    made = []
    for _ in range(600):
        made += [(key(), "my token = ", " and", 1), (key(), f"header {rng.choice(WORDS)} ", " sent", 1), (key(24), "use ", " there", 1),
                 (name(), "token: ", " chosen", 0), (name(), f"see {rng.choice(WORDS)} ", " page", 0),
                 (f"/srv/{rng.choice(WORDS)}/{rng.choice(WORDS)}_{rng.randrange(10**6)}.txt", "password = ", " file", 0),
                 (str(rng.randrange(10**13, 10**16)), "number ", " paid", 0)]
    rng.shuffle(made)
    fitted, held = made[:2000], made[2000:]
    forest = secrets.fit(*map(list, zip(*fitted, strict=True)))
    truth = np.array([r[3] for r in held])
    votes = {"rule": np.array([secrets.rule(*r[:3]) for r in held]), "forest": forest.scores(*[[r[i] for r in held] for i in range(3)]) >= 0.5}
    precision = {k: truth[v].mean() for k, v in votes.items()}
    recall = {k: v[truth == 1].mean() for k, v in votes.items()}
    assert (votes["rule"] != votes["forest"]).mean() > 0.1
    assert precision["forest"] > 0.97 > precision["rule"] and recall["forest"] > 0.97 > recall["rule"]


def test_told_passwords_and_known_formats_without_their_prefix(spark):
    told = {"my password is Tr0ub4dor&3x!": "Tr0ub4dor&3x!", "pw: hunter2hunter2 ok": "hunter2hunter2", "the token is: a1b2c3d4e5f6g7h8": "a1b2c3d4e5f6g7h8"}
    for text, value in told.items():
        assert any(f["value"] == value and secrets.rule(value, f["left"], f["right"]) for f in secrets.scan(text)), text
    assert not any(secrets.rule(f["value"], f["left"]) for f in secrets.scan("a password is required here, and the token is expired."))
    row = [(1, "AKIA" + "Q2W3E4R5T6Y7U8I9", "secret = ", " x")]
    labelled = secrets.weak_labels(spark.createDataFrame(row, "id long, value string, left string, right string"))
    assert {(r["value"], r["left"]) for r in labelled.collect()} == {(row[0][1], "secret = "), ("Q2W3E4R5T6Y7U8I9", "")}


def test_secrets_inside_addresses_and_forms(spark):
    rng = random.Random(6)
    key = lambda k=40: "".join(rng.choices("abcdef0123456789", k=k))
    rows = [(i, f"words token = \"{key()}\" and {rng.randrange(10**15, 10**16)} in https://example.org/a/b_{i}?page={i} {rng.choice(WORDS)}") for i in range(60)]
    tests = {
        100: ("clone https://bob:{}@github.com/x.git now", "ghp_" + key(36)), 101: ("get https://h/p?id=1&token={} now", key()),
        102: ("post a=1&token={}&b=2 now", key()), 103: ("open https://ann:{}@host.example/db now", "correct-horse"),
        104: ("call https://h/v1/{}/send now", key()), 105: ("cookie: sid=1&k={} now", "AKIA" + "ABCDEFGHIJKLMNOP"),
    }
    clean = [(200, "see https://example.org/a/2024/file_12.txt?page=12&size=20 now"), (201, "at http://localhost:8080/index.html now")]
    docs = spark.createDataFrame(rows + [(i, t.format(k)) for i, (t, k) in tests.items()] + clean, "doc_id long, text string")
    forest = secrets.train(secrets.weak_labels(secrets.findings(docs)))
    got = {r["doc_id"]: r["value"] for r in secrets.report(docs, forest).where("doc_id >= 100").collect()}
    assert got == {i: k for i, (_, k) in tests.items()}
    hidden = {r["doc_id"]: r["text"] for r in secrets.redact(docs.where("doc_id >= 100"), forest).collect()}
    assert hidden == {i: t.format(secrets.MASK) for i, (t, _) in tests.items()} | dict(clean)


# Decontamination ------------------------------------------------------------------------------

def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@given(st.text(alphabet="abc", min_size=1, max_size=20), st.text(alphabet="abc", max_size=40))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    masks = decontaminate.Item._masks(pattern)
    assert decontaminate.best_end(masks, len(pattern), text)[0] == edit_search(pattern, text)


def test_items_within_the_budget_are_found():
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=25))) for i in range(5)]
    matcher = decontaminate.Matcher(items)
    for trial in range(60):
        item = matcher.items[trial % 5]
        chars = list(item.text)
        for _ in range(rng.randint(0, item.budget + 2)):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[], [chars[at], "q"], ["z"]])
        text = " ".join(rng.choices(WORDS, k=10)) + " " + "".join(chars) + " " + " ".join(rng.choices(WORDS, k=10))
        distance = edit_search(item.text, decontaminate.normal(text))
        found = {m[0]: m for m in matcher.find(text)}
        assert (item.key in found) == (distance <= item.budget)
        if item.key in found:
            _, start, end, d = found[item.key]
            part = decontaminate.normal(text)[start:end]
            assert d == distance and edit_search(item.text, part) <= d


def test_all_occurrences_of_an_item_are_found():
    rng = random.Random(8)
    item = " ".join(rng.choices(WORDS, k=25))
    near = item[:40] + "q" + item[41:]
    between = " ".join(rng.choices(WORDS, k=12))
    text = f"{item} {between} {near} {between} {item} {item}"
    places = [(0, 0), (len(f"{item} {between} "), 1), (len(f"{item} {between} {near} {between} "), 0),
              (len(f"{item} {between} {near} {between} {item} "), 0)]
    assert decontaminate.Matcher([(7, item)]).find(text) == [(7, at, at + len(item), d) for at, d in places]


def test_one_block_of_items_at_a_time(spark, sf, monkeypatch):
    live, settled = [], []
    blocks, settle = decontaminate.blocks, decontaminate.settle

    def watched(*args):
        for block in blocks(*args, 2_500):
            live.append(len(settled))
            yield block

    monkeypatch.setattr(decontaminate, "blocks", watched)
    monkeypatch.setattr(decontaminate, "settle", lambda df: settled.append(1) or settle(df))
    entries.op10_decontamination(spark, sf)
    assert len(live) > 2 and live == [max(0, i - 1) for i in range(len(live))]


def test_blocks_of_items_give_the_same_matches(spark, sf, monkeypatch):
    want = sorted(entries.op10_decontamination(spark, sf).collect())
    assert want and all(r["distance"] == 0 or r["distance"] > 0 for r in want)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2_500)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (2_500,))
    assert sorted(entries.op10_decontamination(spark, sf).collect()) == want
    texts = texts_of(spark, sf)
    items = {r["item_id"]: decontaminate.normal(r["text"])
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in texts.items() for k, x in items.items() if x in decontaminate.normal(t)}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in want}


# Licenses -------------------------------------------------------------------------------------

def test_license_spans():
    index = licenses.Index(licenses.TEMPLATES)
    notice = dict(licenses.TEMPLATES)["Apache-2.0"]
    text = f"foo bar.\n{notice}\nthe end"
    found = {m["template"]: m for m in index.scan(text)}
    assert found["Apache-2.0"]["coverage"] == 1 and text[found["Apache-2.0"]["start"]:found["Apache-2.0"]["end"]] == notice.rstrip(".")
    changed = text.replace("you may not", "thou must really not")
    assert 0.8 < {m["template"]: m for m in index.scan(changed)}["Apache-2.0"]["coverage"] < 1
    twice = f"{notice} {' '.join(WORDS)} {notice}"
    assert [m["coverage"] for m in index.scan(twice) if m["template"] == "Apache-2.0"] == [1, 1]
    assert index.scan("nothing of the kind is permitted here") == []


def test_shared_words_are_no_license():
    index = licenses.Index(licenses.TEMPLATES)
    names = lambda text: [m["template"] for m in index.scan(text)]
    for tag in ("GPL-2.0", "BSD-3-Clause", "Apache-1.1", "MIT-0", "ISC"):
        assert names(f"SPDX-License-Identifier: {tag}\nimport os") == []
    assert names("SPDX-License-Identifier: MIT\nimport os") == ["SPDX-MIT"]
    assert names("// SPDX-License-Identifier: Apache-2.0") == ["SPDX-Apache-2.0"]
    for text in ("Released under the name", "Released under the GPL License", "Licensed under CC BY 4.0",
                 "Licensed under the Mozilla License, Version 2.0", "Creative Commons Attribution-ShareAlike License",
                 "licensed under the GNU Lesser General Public License, version 3"):
        assert names(text) == [], text
    assert names("Released under the MIT License.") == ["MIT-short"]
    assert names("Copyright 2024 Ann Bee. All rights reserved.") == ["All-rights-reserved"]
    for name, text in licenses.TEMPLATES:
        if len(text) < 1000:
            assert name in names(f"so here: {text} and more"), name
    assert names("the MIT: Released under the MIT. Released under the MIT License") == ["MIT-short"]
    gpl = dict(licenses.TEMPLATES)["GPL"]
    assert "GPL" not in names(gpl.replace("General", "Lesser General"))
    assert names(dict(licenses.TEMPLATES)["Apache-2.0"]) == ["Apache-2.0"]


def test_whole_and_cut_license_texts():
    index, texts = licenses.Index(licenses.TEMPLATES), dict(licenses.TEMPLATES)
    around = " ".join(WORDS)
    for name in [n for n in texts if n.endswith("-text")]:
        text = f"{around} {texts[name]} {around}"
        found = [m for m in index.scan(text) if m["template"] == name]
        assert [m["coverage"] for m in found] == [1], name
        assert licenses.words_of(text[found[0]["start"]:found[0]["end"]]) == licenses.words_of(texts[name])
    for name in ("MIT-text", "BSD-3-Clause-text", "GPL-3.0-text", "ISC-text"):
        half = texts[name].split()
        half = " ".join(half[len(half) // 2:])
        best = max(index.scan(f"{around} {half}"), key=lambda m: m["end"] - m["start"])
        assert best["template"][:3] == name[:3] and 0.3 < best["coverage"] < 0.65
    assert [m["template"] for m in index.scan(texts["BSD-2-Clause-text"])] == ["BSD-2-Clause-text"]


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), max_size=10))
@settings(max_examples=200, deadline=None)
def test_alignment_is_the_longest_common_subsequence(template, words):
    table = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template):
        for j, b in enumerate(words):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    found = licenses.align(template, words, 0, 0)
    assert len(found) == table[-1][-1] and found == sorted(set(found))
    rest = iter(template)
    assert all(words[j] in rest for j in found)


# Pipeline -------------------------------------------------------------------------------------

def test_pipeline_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf)
    scores = {r["doc_id"]: r["predicted"] for r in entries.op1_quality_classifier(spark, sf).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}
    single = stages["jaccard_join"](spark, good, sf)
    want = {c for _, c in components({r["doc_id"]: r["text"] for r in good.collect()}).values()}
    assert {r["doc_id"] for r in single.collect()} == want
    clean = stages["benchmark_decontamination"](spark, single, sf)
    hit = {r["doc_id"] for r in entries.op10_decontamination(spark, sf).collect()}
    assert {r["doc_id"] for r in clean.collect()} == want - hit
    masked = {r["doc_id"]: r for r in stages["secret_scan"](spark, clean, sf).collect()}
    assert set(masked) == want - hit
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert {r["doc_id"] for r in packed.collect()} == want - hit and packed.where("n <> t").count() == 0
