"""Removal of long repeated passages: bucket-pointer refinement over sampled suffixes.

Every byte covered by a string of ``LENGTH`` bytes that starts at two places (in one text or in two) goes;
strings are judged on the input and never cross texts.

All suffixes of a corpus are too many to sort, so the refinement works on those that can matter:

1. Buckets. Of every ``LENGTH`` - ``GRAM`` + 1 neighbouring places the one with the smallest hash of its
   ``GRAM`` bytes is sampled. That depends on the bytes alone, so equal strings are sampled at the same
   offset. The sampled places with equal grams form the initial q-gram buckets. A bucket of one
   place ends here.
2. A string of ``LENGTH`` bytes around a place is named by its lead l, the bytes before the place. Places
   of a bucket whose whole surroundings are equal (first refinement, by an identifier of
   everything up to ``LENGTH`` bytes away) are covered from end to end.
3. The others are refined by identifiers of the bytes at later and earlier offsets, lead by lead:
   in a bucket the places are sorted on the identifier of a lead, which is that of the lead before
   with one byte less and one more. From the largest and the smallest lead that is shared follows
   what a place covers, since all its strings contain the place.
4. Buckets of more than ``BUCKET_PLACES`` different surroundings are refined by Spark, first for ranges of
   leads (``CELL`` wide): places that share a range's common core stay in one bucket, those that share
   its whole hull need no further step, and only cores with others among them are refined to
   single leads.

Bucket identifiers are hashes of the bytes (64 bits beside the bucket's own 64) instead of ranks, for
ranks would need a global sort; places of a bucket are counted by map-side combined sums and joined
back, so one bucket may hold a third of all places.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes keep everything; repeated rows
are texts of their own, so all of a long repeated row goes; equal ids with different texts are kept
apart; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import chunks
from ledgerkit.session import settle

LENGTH, GRAM, CELL = 400, 128, 14
REACH = LENGTH - GRAM  # largest lead
CHUNK = 1 << 18
BUCKET_PLACES = 100_000  # places that one task refines together: 672 bytes each
BLOCK_PLACES = 4_096  # places of small buckets refined at once
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WEIGHTS = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 63, REACH + LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _C1) ^ ((np.arange(1, 257, dtype=np.uint64) * _C2) >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` bytes (a power of two)."""
    h, step = _BYTE[data], 1
    while step < size:
        h = h[:-step] * _C1 + (h[step:] ^ (h[step:] >> np.uint64(29))) * _C2
        step *= 2
    return h ^ (h >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def sample(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of one text and their hashes; every ``length`` bytes hold a whole one."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    low = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    width = length - gram + 1
    least = _slide(low, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    places = np.flatnonzero(most == low)
    return places, hashes[places]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for first, part in chunks(column, CHUNK):
        yield first, [(t or "").encode("utf-8", "replace") for t in part.to_pylist()]


def _at(place, left, right):
    return (place << 20) | (left << 10) | right


def anchors(docs: DataFrame) -> DataFrame:
    """(doc, tag, h, c, at) of sampled places: bucket, identifier of the surroundings, place and reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, texts in _parts(batch.column(2)):
                rows, hs, cs, ats = [], [], [], []
                for row, raw in enumerate(texts, first):
                    places, hashes = sample(np.frombuffer(raw, np.uint8))
                    left = np.minimum(places, REACH)
                    right = np.minimum(len(raw) - places, LENGTH)
                    rows.append(np.full(len(places), row))
                    hs.append(hashes)
                    ats.append(_at(places, left, right))
                    cs += [xxhash.xxh3_64_intdigest(raw[p - a:p + b], seed=a)
                           for p, a, b in zip(places.tolist(), left.tolist(), right.tolist(), strict=True)]
                at = np.concatenate(rows)
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(at)), pa.array(tags[at]), pa.array(np.concatenate(hs).view(np.int64)),
                        pa.array(np.array(cs, np.uint64).view(np.int64)), pa.array(np.concatenate(ats))],
                        ["doc", "tag", "h", "c", "at"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, tag int, h long, c long, at long")


def surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc, tag, h, at, single, mid) with the bytes around them."""
    lists = places.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("mid", "h", "at", "single")).alias("places"))
    rows = docs.join(lists, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))).select(
        "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            for first, texts in _parts(batch.column(0)):
                out = []
                for row, raw in enumerate(texts, first):
                    for p in found[row].as_py():
                        place, left, right = p["at"] >> 20, p["at"] >> 10 & 1023, p["at"] & 1023
                        out.append((p["mid"], p["h"], p["single"], left, right, raw[place - left:place + right]))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                    ["mid", "h", "single", "left", "right", "raw"])

    return rows.mapInArrow(run, "mid long, h long, single boolean, left long, right long, raw binary")


def shared_leads(bucket: np.ndarray, left: np.ndarray, right: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest lead that each place shares with another of its bucket; -1 for none.

    The surroundings stand below each other, so a string of one lead covers the same columns in
    all rows; its identifier is their sum with random weights, moved on by one column per lead.
    """
    n = len(raws)
    rows = np.zeros((n, REACH + LENGTH), np.uint8)
    for row, raw, start in zip(rows, raws, (REACH - left).tolist(), strict=True):
        row[start:start + len(raw)] = np.frombuffer(raw, np.uint8)
    name = bucket.view(np.uint64) * _C2
    for at in range(0, n, 4096):
        name[at:at + 4096] += (rows[at:at + 4096, :LENGTH].astype(np.uint64) * _WEIGHTS[:LENGTH]).sum(1, dtype=np.uint64)
    low, high = np.full(n, -1), np.full(n, -1)
    for lead in range(REACH, -1, -1):
        own = np.flatnonzero((left >= lead) & (right >= LENGTH - lead))
        order = own[np.argsort(name[own], kind="stable")]
        same = name[order[1:]] == name[order[:-1]]
        hit = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        low[hit] = lead
        high[hit] = np.maximum(high[hit], lead)
        if lead:
            first = REACH - lead
            name += rows[:, first + LENGTH] * _WEIGHTS[first + LENGTH] - rows[:, first] * _WEIGHTS[first]
    return low, high


def refine_buckets(around: DataFrame) -> DataFrame:
    """(mid, low, high) for places of buckets that fit a task, many buckets at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table.column(c).combine_chunks() for c in ("mid", "h", "left", "right")}
            mid, h, left, right = (columns[c].to_numpy() for c in ("mid", "h", "left", "right"))
            low, high = shared_leads(h, left, right, table.column("raw").to_pylist())
            keep = low >= 0
            return pa.RecordBatch.from_arrays(
                [pa.array(mid[keep]), pa.array(low[keep].astype(np.int32)), pa.array(high[keep].astype(np.int32))],
                ["mid", "low", "high"])

        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last bucket may go on
            if cut >= BLOCK_PLACES:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return around.repartition("h").sortWithinPartitions("h").mapInArrow(run, "mid long, low int, high int")


def _names(around: DataFrame, leads) -> DataFrame:
    """(h, name, mid, low, high, whole): identifiers by which ``leads`` refine each place's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            wanted = rows.get("cells", [None] * batch.num_rows)
            out = []
            for mid, h, left, right, raw, cells in zip(
                    rows["mid"], rows["h"], rows["left"], rows["right"], rows["raw"], wanted, strict=True):
                for low, high, whole, start, end in leads(left, right, cells):
                    seed = (low << 12) | (high << 1) | whole
                    name = xxhash.xxh3_64_intdigest(raw[left - start:left + end], seed=seed)
                    out.append((h, name - (1 << 64) if name >> 63 else name, mid, low, high, whole))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                ["h", "name", "mid", "low", "high", "whole"])

    return around.mapInArrow(run, "h long, name long, mid long, low int, high int, whole boolean")


def _ranges(left: int, right: int, cells) -> Iterator[tuple[int, int, bool, int, int]]:
    """Core (shared by all leads of a range) and hull (all of them together), where the text has them."""
    for low in range(0, REACH + 1, CELL):
        high = min(low + CELL - 1, REACH)
        if low <= left and LENGTH - high <= right:
            yield low, high, False, low, LENGTH - high
        if high <= left and LENGTH - low <= right:
            yield low, high, True, high, LENGTH - low


def _single_leads(left: int, right: int, cells) -> Iterator[tuple[int, int, bool, int, int]]:
    for low in cells:
        for lead in range(low, min(low + CELL, REACH + 1)):
            if lead <= left and LENGTH - lead <= right:
                yield lead, lead, True, lead, LENGTH - lead


def _within(rows: DataFrame, buckets: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of ``buckets``, which are settled: both sides of the join are plain shuffles then and
    Spark can split a hot bucket. It cannot where one side is aggregated in the join's own stage."""
    return rows.join(settle(buckets), list(keys))


def _shared(names: DataFrame) -> DataFrame:
    """The rows whose bucket and name occur at two places or more."""
    names = settle(names)
    twice = names.groupBy("h", "name").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("h", "name")
    return _within(names, twice, "h", "name")


def refine_by_names(around: DataFrame) -> DataFrame:
    """(mid, low, high) for places of buckets of any size: identifiers are counted by Spark."""
    shared = settle(_shared(_names(around, _ranges)))
    done = shared.where("whole").select("mid", "low", "high")
    # A core with a place whose hull is its own is refined, by all places that have the core.
    cores = settle(shared.where("not whole").join(
        done.select("mid", "low", F.lit(True).alias("done")), ["mid", "low"], "left"))
    undecided = cores.where("done is null").select("h", "name").distinct()
    open_cells = _within(cores, undecided, "h", "name").groupBy("mid").agg(F.collect_list("low").alias("cells"))
    leads = _shared(_names(around.join(open_cells, "mid"), _single_leads))
    return done.unionAll(leads.select("mid", "low", "high")).groupBy("mid").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc, tag, start, end): what is covered, in overlapping pieces."""
    places = anchors(docs)
    twice = places.groupBy("h").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("h")
    places = settle(_within(places, twice, "h"))
    classes = settle(places.groupBy("h", "c").agg(F.count(F.lit(1)).alias("size"), F.min(
        F.struct("doc", "tag", "at")).alias("first")))
    mixed = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).where(
        "n > 1 and least = 1").select("h", "n")
    left, right = F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    place = F.shiftright("at", 20)
    whole = places.join(classes.where("size > 1").select("h", "c"), ["h", "c"]).where(left + right >= LENGTH).select(
        "doc", "tag", (place - left).alias("start"), (place + right).alias("end"))
    # Places alone in their class, and one of each larger class that they may share strings with.
    open_places = settle(_within(classes, mixed, "h").select(
        "h", "n", (F.col("size") == 1).alias("single"), "first.*").where(left + right >= LENGTH).withColumn(
        "mid", F.monotonically_increasing_id()))
    small, large = open_places.where(F.col("n") <= BUCKET_PLACES), open_places.where(F.col("n") > BUCKET_PLACES)
    leads = refine_buckets(surroundings(docs, small))
    if not large.isEmpty():
        leads = leads.unionAll(refine_by_names(settle(surroundings(docs, large))))
    found = open_places.where("single").join(leads, "mid").select(
        "doc", "tag", (place - F.col("high")).alias("start"), (place - F.col("low") + LENGTH).alias("end"))
    return whole.unionAll(found)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and spans and kept text).

    The kept text is decoded with replacement signs where a removed run began or ended within a
    character; ``kept_sha256`` is that of the kept bytes.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.hash(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    lists = spans(docs).groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.join(lists, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc", "text", "spans")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts in _parts(batch.column(1)):
                found = batch.column(2).slice(first, len(texts)).to_pylist()
                out = []
                for raw, spans_of in zip(texts, found, strict=True):
                    merged: list[list[int]] = []
                    for start, end in sorted((s["start"], s["end"]) for s in spans_of or ()):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    bounds = [0, *[b for m in merged for b in m], len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                                [{"start": a, "end": b} for a, b in merged], kept.decode("utf-8", "replace")))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pairs, pa.string()] * with_text
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]],
                    names)

    kind = docs.schema["doc"].dataType.simpleString()
    extra = ", spans array<struct<start: long, end: long>>, kept string" if with_text else ""
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
