"""Ranked lexical search over an inverted index, by MaxScore with bounds of term pairs.

1. ``build`` cuts the documents into shards of bounded size where they lie. A shard's rows are its head
   (ids and lengths, in the order of the ids) and one list of documents and occurrences per term. All
   terms of all documents are indexed; no list leaves its shard.
2. Global figures (documents, terms, documents per term) are summed from the shards.
3. ``pair_lists`` writes, per shard, each query term's largest impact and, for the pairs that the queries
   put next to each other (rarest terms first), the documents that hold both and the largest joint impact.
4. The best joint impacts of k different shards belong to k different documents, so the k-th of them is a
   first threshold for a query.
5. ``search`` works unit by unit (a pair, or the odd last term), highest bound first. A pair's bound is the larger of
   its joint maximum and its terms' maxima, which is below their sum. Once the bounds of the rest stay
   under the threshold, only documents met so far go on, and each drops out when its score and
   the bounds left cannot reach it; a document outside a pair's list is held to the single maxima.

A term is a maximal run of anything but the ASCII characters that are no letter and no digit, with A-Z in
lower case. Impacts are 64-bit integers: w * ((1000000000 * tf) div (1000 * tf + 12 * m)).

Defined results: null and empty texts have no term, do not count and are never found; rows of one item id
are one item, all their terms count; an item without terms or with none that occurs gives no rows; repeated
rows are documents of their own; equal scores rank by ascending id, a null id last; empty tables give no
rows. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.session import settle, settled

SHARD_BYTES = 8 << 20  # text of a shard; a longer document makes a shard alone
SHARD_DOCS = 1 << 16  # so that a place in a shard takes two bytes
SLICE_BYTES = 1 << 20  # text that is split into words at once
BLOCK_TERMS = 200_000  # query terms that are searched for together
TOP = 20
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``SLICE_BYTES``."""
    clean, start = raw.translate(_TERM_BYTES), 0
    while len(clean) - start > SLICE_BYTES:
        cut = clean.find(b" ", start + SLICE_BYTES)
        if cut < 0:
            break
        yield clean[start:cut].split()
        start = cut
    yield clean[start:].split()


class _Writer:
    """Gathers one shard."""

    def __init__(self) -> None:
        self.ids: list[object] = []
        self.size = 0
        self.vocabulary: dict[bytes, int] = {}
        self.pending: list[bytes] = []
        self.codes: list[np.ndarray] = []
        self.lengths: list[int] = []

    def add(self, doc: object, raw: bytes) -> None:
        self.ids.append(doc)
        self.size += len(raw)
        n = 0
        for part in words(raw):
            n += len(part)
            self.pending += part
            if len(self.pending) > 200_000:
                self.encode()
        self.lengths.append(n)

    def encode(self) -> None:
        for w in set(self.pending).difference(self.vocabulary):
            self.vocabulary[w] = len(self.vocabulary)
        self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, self.pending), np.int64, len(self.pending)))
        self.pending = []

    def batch(self, shard: int, kind: pa.DataType) -> pa.RecordBatch:
        self.encode()
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        lengths = np.asarray(self.lengths, np.int64)
        key, times = np.unique(
            np.concatenate(self.codes) * n + np.repeat(place, lengths), return_counts=True)
        code = key // n
        starts = np.searchsorted(code, np.arange(len(self.vocabulary) + 1))

        def lists(values: np.ndarray, head: np.ndarray) -> pa.Array:
            width = values.itemsize
            at = np.concatenate([[0, len(head)], len(head) + starts[1:] * width]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(at) - 1, [
                None, pa.py_buffer(at.tobytes()), pa.py_buffer(head.tobytes() + values.tobytes())])

        rows = len(self.vocabulary) + 1
        head_ids = [self.ids[i] for i in order]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, shard)), pa.array([None, *self.vocabulary], pa.binary()),
            pa.array(np.append(int((lengths > 0).sum()), np.diff(starts))),
            pa.array(np.append(int(lengths.sum()), np.zeros(rows - 1, np.int64))),
            lists((key % n).astype(np.uint16), lengths[order].view(np.uint8)),
            lists(times.astype(np.uint32), np.zeros(0, np.uint8)),
            pa.array([head_ids] + [None] * (rows - 1), pa.list_(kind)),
        ], ["shard", "term", "df", "total", "docs", "tfs", "ids"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: per shard a head (term null) and one row per term."""
    kind = docs.schema[id_col].dataType
    source = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    schema = T.StructType([*T.StructType.fromDDL(
        "shard long, term binary, df long, total long, docs binary, tfs binary").fields, T.StructField("ids", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId() << 32, _Writer()
        for batch in batches:
            arrow = batch.schema.field(0).type
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for doc, raw, size in zip(batch.column(0), batch.column(1), sizes, strict=True):
                if part.ids and (part.size + size > SHARD_BYTES or len(part.ids) == SHARD_DOCS):
                    yield part.batch(shard, arrow)
                    shard, part = shard + 1, _Writer()
                part.add(doc.as_py(), raw.as_py())
        if part.ids:
            yield part.batch(shard, arrow)

    return source.mapInArrow(run, schema)


@dataclass
class Queries:
    """A block of items: weights of its terms, terms and occurrences of each item, and its pairs."""

    codes: dict[bytes, int]
    weight: np.ndarray
    items: list[tuple[object, list[tuple[int, int]]]]
    n_docs: int
    n_terms: int
    units: list[list[tuple[tuple[int, int], int, int]]] = field(default_factory=list)

    def pair_up(self) -> None:
        """An item's units, rarest terms first: ((a, b), times of a, times of b), b is -1 for the odd last."""
        for _, terms in self.items:
            order = sorted(terms, key=lambda t: (-self.weight[t[0]], t[0]))
            self.units.append([
                ((a, b), ca, cb) if b >= a else ((b, a), cb, ca) if b >= 0 else ((a, b), ca, 0)
                for (a, ca), (b, cb) in zip(order[::2], [*order[1::2], (-1, 0)], strict=False)])

    def pairs(self) -> list[tuple[int, int]]:
        return sorted({pair for units in self.units for pair, _, _ in units if pair[1] >= 0})

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * self.n_docs // max(self.n_terms, 1)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms, in blocks of bounded size, read one partition after the other."""
    block, size = [], 0
    texts = items.groupBy(F.col(id_col).alias("i")).agg(
        F.concat_ws(" ", F.collect_list(F.col(text_col).cast("string"))).cast("binary").alias("t"))
    for row in texts.toLocalIterator():
        terms = Counter(w for part in words(bytes(row["t"])) for w in part)
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        if terms:
            block.append((row["i"], terms))
            size += len(terms)
    if block:
        yield block


class Shard:
    """Lists of one shard, and of the pairs of the queries."""

    def __init__(self, rows: pa.Table, queries: Queries) -> None:
        self.queries = queries
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), None
        for row, (term, docs, tfs) in enumerate(zip(*(rows.column(c) for c in ("term", "docs", "tfs")), strict=True)):
            if not term.is_valid:
                self.lengths, self.ids = np.frombuffer(docs.as_py(), np.int64), rows.column("ids")[row].values
            else:
                code = queries.codes[term.as_py()]
                self.lists[code] = (np.frombuffer(docs.as_py(), np.uint16).astype(np.int64), np.frombuffer(tfs.as_py(), np.uint32).astype(np.int64))
        self.m = queries.damping(self.lengths)
        self.largest: dict[int, int] = {}
        self.joint: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        self.work = 0  # impacts computed

    def impacts(self, code: int, docs: np.ndarray, tf: np.ndarray) -> np.ndarray:
        self.work += len(docs)
        return self.queries.weight[code] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[docs]))

    def measure(self) -> None:
        """Largest impacts of the terms, and lists of the pairs."""
        whole = {c: self.impacts(c, d, t) for c, (d, t) in self.lists.items()}
        self.largest = {c: int(v.max()) for c, v in whole.items()}
        for a, b in self.queries.pairs():
            if a in self.lists and b in self.lists:
                both, at_a, at_b = np.intersect1d(self.lists[a][0], self.lists[b][0], True, return_indices=True)
                if len(both):
                    self.joint[a, b] = (int((whole[a][at_a] + whole[b][at_b]).max()), both)

    def bound(self, unit: tuple[tuple[int, int], int, int]) -> tuple[int, int]:
        """Bounds of a unit for a document inside its pair's list and outside."""
        (a, b), ca, cb = unit
        one, other = ca * self.largest.get(a, 0), cb * self.largest.get(b, 0)
        single = max(one, other)
        if (a, b) not in self.joint:
            return single, single
        least = min(ca, cb)
        inside = least * self.joint[a, b][0] + (ca - least) * self.largest[a] + (cb - least) * self.largest[b]
        return max(single, min(inside, one + other)), single

    def best(self, number: int, threshold: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the item's k best documents here that reach the threshold."""
        n = len(self.lengths)
        units = [(*self.bound(u), u) for u in self.queries.units[number]]
        units = sorted((u for u in units if u[0]), key=lambda u: -u[0])
        rest = np.append(np.cumsum([u[0] for u in units][::-1], dtype=np.int64)[::-1], 0)
        threshold = max(threshold, 1)
        score, alive = np.zeros(n, np.int64), None
        for i, (_, single, (pair, ca, cb)) in enumerate(units):
            if alive is None and rest[i] < threshold:
                alive = np.flatnonzero(score)
            if alive is not None:
                alive = alive[score[alive] + rest[i] >= threshold]
                if pair in self.joint:
                    inside = np.isin(alive, self.joint[pair][1], assume_unique=True)
                    alive = alive[inside | (score[alive] + single + rest[i + 1] >= threshold)]
                if not len(alive):
                    break
            for code, times in zip(pair, (ca, cb), strict=True):
                if code not in self.lists:
                    continue
                docs, tf = self.lists[code]
                if alive is not None:
                    at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                    at = at[docs[at] == alive]
                    docs, tf = docs[at], tf[at]
                score[docs] += times * self.impacts(code, docs, tf)
            if n >= k:
                threshold = max(threshold, int(np.partition(score, n - k)[n - k]))
        found = np.flatnonzero(score >= threshold)
        if alive is not None:
            found = alive[score[alive] >= threshold]
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]


def _plan(index: DataFrame, block: list[tuple[object, Counter]], n_docs: int, n_terms: int) -> tuple[Queries, DataFrame]:
    """The block's queries, and the index rows they need."""
    spark = index.sparkSession
    named = spark.createDataFrame([(bytearray(w),) for w in {w for _, terms in block for w in terms}], "term binary")
    # Broadcast: at most BLOCK_TERMS terms.
    named = F.broadcast(named)
    needed = index.where("term is not null").join(named, "term", "left_semi")
    frequency = {bytes(r["term"]): r["df"] for r in needed.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    weights = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for w, df in frequency.items()}
    kept = sorted(w for w, weight in weights.items() if weight > 0)
    queries = Queries(
        {w: i for i, w in enumerate(kept)}, np.array([weights[w] for w in kept], np.int64), [], n_docs, n_terms)
    for item, terms in block:
        own = [(queries.codes[w], c) for w, c in terms.items() if w in queries.codes]
        if own:
            queries.items.append((item, own))
    queries.pair_up()
    used = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in kept], "term binary"))
    rows = index.where("term is not null").join(used, "term", "left_semi").select("shard", "term", "docs", "tfs", "ids")
    return queries, rows.unionAll(index.where("term is null").select("shard", "term", "docs", "tfs", "ids"))


def pair_lists(rows: DataFrame, queries: Queries) -> DataFrame:
    """Per shard (a, b, joint, docs) of the pairs, and (a, -1, largest impact) of the terms."""

    def run(shard: pa.Table) -> pa.Table:
        number, part = shard.column("shard")[0].as_py(), Shard(shard, queries)
        part.measure()
        keys = [(c, -1) for c in part.largest] + list(part.joint)
        return pa.table({
            "shard": pa.array([number] * len(keys), pa.int64()),
            "a": pa.array([a for a, _ in keys], pa.int32()), "b": pa.array([b for _, b in keys], pa.int32()),
            "joint": pa.array([*part.largest.values(), *(j for j, _ in part.joint.values())], pa.int64()),
            "docs": pa.array([b""] * len(part.largest) + [d.astype(np.uint16).tobytes() for _, d in part.joint.values()], pa.binary()),
        })

    return rows.groupBy("shard").applyInArrow(run, "shard long, a int, b int, joint long, docs binary")


def thresholds(lists: DataFrame, queries: Queries, k: int) -> dict[int, int]:
    """Per item the k-th of the shards' best joint impacts, where k shards have one."""
    # Two units of the rarest terms: what they give is a bound from below, so fewer may be taken.
    units = lists.sparkSession.createDataFrame(
        [(i, *pair) for i, units in enumerate(queries.units) for pair, _, _ in units[:2]], "item int, a int, b int")
    best = lists.join(units, ["a", "b"]).groupBy("item", "shard").agg(F.max("joint").alias("joint"))
    first = Window.partitionBy("item").orderBy(F.desc("joint"))
    ranked = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    found = ranked.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("joint").alias("joint")).where(F.col("n") == k)
    return {r["item"]: r["joint"] for r in found.collect()}


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents.

    ``index`` is settled when it is not: shards are named by the partition of the job that builds them, so an index
    built anew, as one half of a union, would name them otherwise there.
    """
    index = settled(index)
    kind, doc_kind = items.schema[item_col].dataType, index.schema["ids"].dataType.elementType
    n_docs, n_terms = index.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    scored = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())])
    result = T.StructType([
        T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())])

    def answer(block: list[tuple[object, Counter]]) -> DataFrame:
        queries, rows = _plan(index, block, n_docs, n_terms)
        lists = settle(pair_lists(rows, queries))
        floor = thresholds(lists, queries, k)

        def run(shard: pa.Table, pairs: pa.Table) -> pa.Table:
            part = Shard(shard, queries)
            for a, b, joint, docs in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "joint", "docs")), strict=True):
                if b < 0:
                    part.largest[a] = joint
                else:
                    part.joint[a, b] = (joint, np.frombuffer(docs, np.uint16).astype(np.int64))
            found = [(i, *part.best(i, floor.get(i, 0), k)) for i in range(len(queries.items))]
            places = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
            ids = part.ids if part.ids is not None else pa.array([], shard.schema.field("ids").type.value_type)
            return pa.table({
                "item": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int32()),
                "doc_id": ids.take(pa.array(places, pa.int64())),
                "score": pa.array(np.concatenate([np.zeros(0, np.int64), *(f[2] for f in found)]), pa.int64()),
            })

        found = rows.groupBy("shard").cogroup(lists.groupBy("shard")).applyInArrow(run, scored)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = index.sparkSession.createDataFrame(
            [(i, item) for i, (item, _) in enumerate(queries.items)],
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        return top.join(names, "item").select("item_id", "rank", "doc_id", "score")

    done = None
    for block in item_blocks(items, item_col, text_col) if n_docs else ():
        written = settle(answer(block))
        done = written if done is None else done.unionAll(written)
    return done if done is not None else index.sparkSession.createDataFrame([], result)
