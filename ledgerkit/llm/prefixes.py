"""Prefix trie of rebuilt conversations in node tables with minimal perfect hashes.

A conversation c is rebuilt from the first h turns of conversation c - c % 20 (h = crc32 of its number, mod 4)
and its own turns after its first h. Every distinct sequence of first turns is a node.

1. Digests. A turn's digest depends on its depth and content; that of a prefix is the sum of its
   turns' digests in four 32-bit lanes. Sums run over slices of a long conversation, so none must fit in a task.
2. Nodes are the distinct digests, counted on the map side. All rows of a node must agree in content (SHA-256 of
   role and text), depth and parent, else the job stops: so equal digests are proven equal sequences.
3. A node of one conversation needs nothing more: one leaf, nothing saved. The others go to shards by
   (smallest member, depth div ``UNIT``): a path that keeps its smallest member stays together, and no shard grows with
   one conversation.
4. A shard numbers its nodes by a minimal perfect hash (buckets displaced by seeds, the largest first; buckets of
   one node are given a free slot) and checks each slot against the digest. Counts are scattered into flat arrays.
5. Leaves and saved words are added up along the array of parent slots, deepest nodes first. What leaves a
   shard is summed per parent by Spark and scattered into the parent's shard in the next round. There are
   as many rounds as a way to the root changes shards.

Defined results: a null role or text is empty; turns are ordered by (turn, role, text), null first; repeated
rows are turns of their own; rows without a conversation id belong to none and are left out; a conversation can be
left without turns and is then a member of the root only; an empty table has no nodes. Only the four named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.operators.ordered import number_rows, with_running
from ledgerkit.session import settle

BLOCK, BORROWED = 20, 4  # conversations that share a first one; h is below BORROWED
UNIT = 4096  # depths of one path that stay in a shard
SHARD_NODES = 100_000
HASH_BYTES = 1 << 16  # joined ids that are prepared as one row
_KEYS_PER_BUCKET = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def turns(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos from 1, SHA-256 of role and text, words of the text."""
    rows = convs.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return number_rows(rows, ["conv"], ["turn", "role", "text"], "pos").select(
        "conv", "pos", content.alias("content"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, content, words) and conversations (conv, length) after the rebuilding."""
    lengths = settle(own.groupBy("conv").agg(F.max("pos").alias("n")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED
    start = F.col("conv") - F.col("conv") % BLOCK
    first = lengths.select(F.col("conv").alias("start"), F.col("n").alias("n_start"))
    convs = settle(lengths.select("conv", "n", h.alias("h"), start.alias("start")).join(first, "start", "left").select(
        "conv", "start", "h", F.least("h", F.coalesce("n_start", F.lit(0))).alias("lent"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")))
    lent = own.where(F.col("pos") < BORROWED).withColumnRenamed("conv", "start").join(
        convs.select("conv", "start", "h"), "start").where("pos <= h").select("conv", F.col("pos").alias("depth"), "content", "words")
    rest = own.join(convs.select("conv", "h", "lent"), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "content", "words")
    return lent.unionAll(rest), convs.select("conv", (F.col("lent") + F.col("rest")).alias("length"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Per turn of a conversation the digest (k1, k2) of the prefix it ends and (p1, p2) of the one before."""
    lanes = {}
    for i in (0, 2):
        digest = F.xxhash64(F.lit(i), "depth", "content")
        lanes[f"s{i}"], lanes[f"s{i + 1}"] = digest.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(digest, 32)
    summed = with_running(rows, ["conv"], ["depth"], lanes)

    def key(i: int, before: bool) -> Column:
        a, b = (F.col(s) - lanes[s] if before else F.col(s) for s in (f"s{i}", f"s{i + 1}"))
        found = F.xxhash64(F.lit(i), a, b, F.col("depth") - int(before))
        return F.when(F.col("depth") > int(before), found).otherwise(F.lit(0).cast("long"))

    return summed.select(
        "conv", "depth", "content", "words", key(0, False).alias("k1"), key(2, False).alias("k2"),
        key(0, True).alias("p1"), key(2, True).alias("p2"))


def nodes_of(steps: DataFrame) -> DataFrame:
    """One row per prefix; stops when rows of one digest differ."""
    same = F.lit(True)
    for c in ("depth", "p1", "p2", "content"):
        same = same & (F.min(c) == F.max(c))
    counted = F.when(same, F.count(F.lit(1))).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    return steps.groupBy("k1", "k2").agg(
        counted.alias("n_convs"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))


def _bucket_slots(k1: np.ndarray, k2: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    x = (k1.view(np.uint64) ^ (np.asarray(seed, np.uint64) * _MIX)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33)) ^ k2.view(np.uint64)) * _MIX
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Distinct digests to the numbers 0 to n - 1. ``seeds`` has a seed per bucket, or -1 - slot."""

    def __init__(self, seeds: np.ndarray, n: int) -> None:
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> PerfectHash:
        n = len(k1)
        seeds = np.zeros(max(1, n // _KEYS_PER_BUCKET), np.int64)
        if not n:
            return cls(seeds, 0)
        bucket = _bucket_slots(k2, k1, 0, len(seeds))
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=len(seeds))
        ends = np.cumsum(size)
        taken = np.zeros(n, bool)
        for b in np.argsort(-size, kind="stable"):
            members = order[ends[b] - size[b]:ends[b]]
            if size[b] < 2:
                break
            for first in range(1, 1 << 24, 16):  # 16 seeds at a time
                tried = _bucket_slots(k1[members], k2[members], np.arange(first, first + 16)[:, None], n)
                good = ~taken[tried].any(1) & (np.diff(np.sort(tried, 1), axis=1) > 0).all(1)
                if good.any():
                    at = int(np.argmax(good))
                    seeds[b] = first + at
                    taken[tried[at]] = True
                    break
            else:
                raise ValueError("repeated digests")
        ones = np.flatnonzero(size == 1)
        seeds[ones] = -1 - np.flatnonzero(~taken)
        return cls(seeds, n)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slots of the digests; for others any number, so compare with what lies there."""
        seed = self.seeds[_bucket_slots(k2, k1, 0, len(self.seeds))]
        return np.where(seed < 0, -1 - seed, _bucket_slots(k1, k2, np.maximum(seed, 0), max(self.n, 1)))


_FLAT = ("k1", "k2", "p1", "p2", "depth", "parent_slot", "parent_shard", "leaves", "saved")
_TABLE = "shard long, seeds binary, " + ", ".join(f"{c} binary" for c in _FLAT)
_SUMS = "shard long, up boolean, k1 long, k2 long, leaves long, saved long"


def _verified(table: PerfectHash, k1: np.ndarray, k2: np.ndarray, own1: np.ndarray, own2: np.ndarray) -> np.ndarray:
    slot = table.slots(k1, k2)
    if not (np.array_equal(own1[slot], k1) and np.array_equal(own2[slot], k2)):
        raise ValueError("a digest is not in its slot")
    return slot


def node_table(rows: pa.Table) -> pa.Table:
    """A shard's nodes as flat arrays in the order of their slots; -1: the parent is in another shard."""
    raw = {c: rows.column(c).to_numpy() for c in rows.column_names}
    table = PerfectHash.build(raw["k1"], raw["k2"])
    slot = table.slots(raw["k1"], raw["k2"])
    flat = {}
    for c in _FLAT:
        flat[c] = np.full(len(slot), -1, np.int64)
        if c != "parent_slot":
            flat[c][slot] = raw[c]
    _verified(table, raw["k1"], raw["k2"], flat["k1"], flat["k2"])
    shard = int(raw["shard"][0])
    inside = np.flatnonzero(flat["parent_shard"] == shard)
    flat["parent_slot"][inside] = _verified(table, flat["p1"][inside], flat["p2"][inside], flat["k1"], flat["k2"])
    return pa.table({
        "shard": pa.array([shard], pa.int64()), "seeds": pa.array([table.seeds.tobytes()], pa.binary()),
        **{c: pa.array([flat[c].tobytes()], pa.binary()) for c in _FLAT}})


def accumulate(table: pa.Table, arrived: pa.Table | None) -> pa.Table:
    """Sums of a shard's nodes: of their own counts, or of what arrived from other shards in this round."""
    shard = table.column("shard")[0].as_py()
    flat = {c: np.frombuffer(table.column(c)[0].as_py(), np.int64) for c in _FLAT}
    n = len(flat["k1"])
    if arrived is None:
        sums = [flat["leaves"].copy(), flat["saved"].copy()]
    else:
        hashed = PerfectHash(np.frombuffer(table.column("seeds")[0].as_py(), np.int64), n)
        slot = _verified(hashed, *(arrived.column(c).to_numpy() for c in ("k1", "k2")), flat["k1"], flat["k2"])
        sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        for s, c in zip(sums, ("leaves", "saved"), strict=True):
            np.add.at(s, slot, arrived.column(c).to_numpy())
    order = np.argsort(-flat["depth"], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        level = level[flat["parent_slot"][level] >= 0]
        for s in sums:
            np.add.at(s, flat["parent_slot"][level], s[level])
    some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
    heads = some[(flat["parent_slot"][some] < 0) & (flat["parent_shard"][some] >= 0)]
    both = np.concatenate([some, heads])
    up = np.arange(len(both)) >= len(some)
    return pa.table({
        "shard": pa.array(np.where(up, flat["parent_shard"][both], shard)), "up": pa.array(up),
        "k1": pa.array(np.where(up, flat["p1"][both], flat["k1"][both])),
        "k2": pa.array(np.where(up, flat["p2"][both], flat["k2"][both])),
        "leaves": pa.array(sums[0][both]), "saved": pa.array(sums[1][both])})


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(k1, k2, leaves, saved) summed over each node's subtree; ``tree`` has the nodes' own counts."""
    table = settle(tree.groupBy("shard").applyInArrow(node_table, _TABLE))

    def onward(rows: pa.Table, arrived: pa.Table) -> pa.Table:
        return accumulate(rows, arrived)

    out = settle(table.groupBy("shard").applyInArrow(lambda rows: accumulate(rows, None), _SUMS))
    parts = out
    while True:
        up = settle(out.where("up").groupBy("shard", "k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        if up.isEmpty():
            break
        touched = table.join(up.select("shard").distinct(), "shard", "left_semi")
        out = settle(touched.groupBy("shard").cogroup(up.groupBy("shard")).applyInArrow(onward, _SUMS))
        parts = parts.unionAll(out)
    return parts.where("not up").groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def id_hashes(ends: DataFrame) -> DataFrame:
    """Per (k1, k2) the SHA-256 of its ids, ascending and joined by commas.

    Ids are sorted and joined in ranges that cut large groups; a group's hash reads the joined pieces one by one.
    """
    counts = settle(ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")))
    alone = counts.where("n = 1").select("k1", "k2", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = ends.join(counts.where("n > 1").select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "conv")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            rows = []
            for start, end in zip([0, *cuts], [*cuts, len(conv)], strict=True):
                for at in range(start, end, HASH_BYTES // 20):
                    part = conv[at:min(end, at + HASH_BYTES // 20)]
                    rows.append((int(k1[at]), int(k2[at]), int(part[0]), ",".join(map(str, part.tolist()))))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("k1", "k2", "first", "text"), r, strict=True)) for r in rows],
                pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("text", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = ["k1", "k2", "ends_sha256"]
        for batch in batches:
            done = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                if (a, b) != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names)

    pieces = many.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(
        joined, "k1 long, k2 long, first long, text string")
    return alone.unionAll(pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(
        hashed, "k1 long, k2 long, ends_sha256 string"))


def trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", shard_nodes: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = settle(turns(convs, conv_col, turn_col, role_col, text_col))
    rows, members = rebuilt(own)
    members, steps = settle(members), settle(prefixes(rows))
    zero = F.lit(0).cast("long")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("depth"),
        zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    nodes = settle(nodes_of(steps).unionAll(root))
    # Settled sides are plain shuffles, so Spark can split a parent of very many children.
    children = settle(nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("single")))
    parents = nodes.where("n_convs > 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of"))
    parent = F.when(F.col("depth") > 0, F.coalesce("of", "conv_id"))
    named = settle(nodes.join(parents, ["p1", "p2"], "left").withColumn("parent_conv_id", parent).drop("of"))

    whole = settle(named.join(children, ["k1", "k2"], "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("n_children", "single")}))
    shared = whole.where("n_convs > 1")
    n = shared.count()
    shards = max(1, -(-n // (shard_nodes or SHARD_NODES)), min(16, n // 1_000))
    place = lambda c, d: F.pmod(F.xxhash64(c, F.floor(d / UNIT)), F.lit(shards))
    tree = shared.select(
        "k1", "k2", "p1", "p2", "depth", place(F.col("conv_id"), F.col("depth")).alias("shard"),
        F.when(F.col("depth") > 0, place(F.col("parent_conv_id"), F.col("depth") - 1)).otherwise(-1).alias("parent_shard"),
        (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(tree)
    last = steps.join(members, "conv").where("depth = length").select("k1", "k2", "conv")
    ends = settle(last.unionAll(members.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv")))
    return whole.join(sums, ["k1", "k2"], "left").join(id_hashes(ends), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
