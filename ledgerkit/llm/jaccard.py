"""Exact n-gram Jaccard self-join by vertical partitioning, with the groups its links form.

Equal sets become one class first, so copies cost nothing further. Then:

1. Prefilter. In the order of their hashes, of a set of n grams the first n - ceil(t n) + k (k = 1 + n/16)
   must hold k that another set's first grams hold too. These prefixes meet in buckets of bounded
   size; grams that several sets of one task share are counted there and sent once. Few sets stay.
2. Global order: the grams of the sets that stay, rarest first; grams of one set only are dropped and
   the sets keep their number. A set with fewer than ceil(t n) others' grams can have no link.
3. Candidates share a gram of their prefixes in that order and pass the length and position filters.
   In a round every bucket has a hub (first the set with the fewest grams of its own, as copies of
   one text are nearest to that), and every set is compared with the hub it shares most buckets
   with. Linked sets form components, and only sets of different components are compared further:
   by more rounds while that helps, then all that lie outside their bucket's largest component with
   the rest. So a group of m near copies costs about m pairs a round, and no pair of different
   components is left out.
4. Verification: the order is cut into ``FRAGMENTS``; each pair's common grams are counted per fragment
   and the partial counts are summed.

Words are runs of anything but space and U+0009 to U+000D, with A-Z in lower case; grams are hashed to
64 bits. Defined results: null and empty texts have no grams and no links; fewer words than a gram
make one gram of the whole sequence; repeated documents have equal sets and share a component; a row
with a null id is linked with nothing and has itself (null) as component; an empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import chunks, frugal, near_keys
from ledgerkit.session import discard, settle

GRAM, PERCENT = 5, 75
FRAGMENTS = 4
BUCKET_GRAMS = 1_000_000  # grams of a prefilter bucket, and of a task's own share before it is sent
CACHED_WORDS = 100_000
PAIRS_PER_ROW = 2  # remaining comparisons per prefix row that end the rounds of hubs
IDLE_ROUNDS = 2  # rounds in a row without a tenth less to compare that end them, too
_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def needed(n, percent: int = PERCENT):
    """ceil(percent n / 100): common grams without which a set of n has no link."""
    return (percent * n + 99) // 100


def prefix_share(n):
    """Grams that two linked sets' prefixes must share in the prefilter."""
    return 1 + n // 16


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > CACHED_WORDS:
        _words.clear()
    new = set(words).difference(_words)
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def gram_sets(texts: list[str | None], size: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    hashes = _word_hashes([w for s in split for w in s])
    grams = hashes[:max(0, len(hashes) - size + 1)].copy()
    for j in range(1, size):
        grams = ((grams << np.uint64(23) | grams >> np.uint64(41)) ^ hashes[j:j + len(grams)]) * _MIX
    grams ^= grams >> np.uint64(32)
    out, at = [], 0
    for s in split:
        n = len(s)
        if n >= size:
            out.append(np.unique(grams[at:at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(s), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _set_id(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, part in chunks(batch.column(column)):
        yield first, gram_sets(part.to_pylist())


def describe(docs: DataFrame) -> DataFrame:
    """doc, set id, its first 8 bytes as ``ref``, and n for each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in _texts(batch, 1) for s in part]
            ids = [_set_id(s) for s in sets]
            refs = np.frombuffer(b"".join(i[:8] for i in ids), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(refs), pa.array([len(s) for s in sets], pa.int64())],
                ["doc", "sid", "ref", "n"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(frugal(run, _words), f"doc {kind}, sid binary, ref long, n long")


def shared_counts(docs: DataFrame, total: int, percent: int) -> DataFrame:
    """ref and a number of prefix grams that other sets' prefixes hold too (copies may count twice)."""
    buckets = max(128, -(-total // BUCKET_GRAMS))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        refs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            """Rows (bucket, grams, refs). Bucket -1: refs with counts; ref 0: the gram is shared."""
            g, r = np.concatenate(grams), np.concatenate(refs)
            order = np.lexsort((r, g))
            g, r = g[order], r[order]
            fresh = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])) if len(g) else np.zeros(0, bool)
            g, r = g[fresh], r[fresh]
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
            size = np.diff(np.append(start, len(g)))
            own, n = np.unique(r[np.repeat(size > 1, size)], return_counts=True)
            g, r = g[start], np.where(size > 1, 0, r[start])
            bucket = (g % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            g, r, bucket = g[order], r[order], bucket[order]
            used, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(g))
            rows = [(int(b), g[a:e].tobytes(), r[a:e].tobytes()) for b, a, e in zip(used, first, ends, strict=True)]
            if len(own):
                # Counted here; spread over the buckets, which pass them on.
                rows.append((int(own[0]) % buckets, n.astype(np.int64).tobytes(), b"=" + own.tobytes()))
            grams.clear()
            refs.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                ["bucket", "grams", "refs"])

        for batch in batches:
            for _, part in _texts(batch, 0):
                for s in part:
                    n = len(s)
                    if n:
                        first = s[:n - needed(n, percent) + prefix_share(n)]
                        grams.append(first)
                        refs.append(np.repeat(np.frombuffer(_set_id(s)[:8], np.int64), len(first)))
                        held += len(first)
                if held >= BUCKET_GRAMS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        blobs, owners = group.column("grams").to_pylist(), group.column("refs").to_pylist()
        known = [(np.frombuffer(o[1:], np.int64), np.frombuffer(b, np.int64))
                 for b, o in zip(blobs, owners, strict=True) if o[:1] == b"=" and len(o) % 8]
        plain = [(b, o) for b, o in zip(blobs, owners, strict=True) if len(o) % 8 == 0]
        g = np.frombuffer(b"".join(b for b, _ in plain), np.uint64)
        r = np.frombuffer(b"".join(o for _, o in plain), np.int64)
        order = np.lexsort((r, g))
        g, r = g[order], r[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])) if len(g) else np.zeros(0, bool)
        g, r = g[fresh], r[fresh]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
        size = np.diff(np.append(start, len(g)))
        shared = np.repeat((size > 1) | (r[start] == 0) if len(g) else np.zeros(0, bool), size)
        # 0 marks grams that one task found shared; it sorts anywhere among the refs of a gram.
        marked = np.zeros(len(start), bool)
        np.logical_or.at(marked, np.repeat(np.arange(len(start)), size), r == 0)
        shared |= np.repeat(marked, size)
        refs, n = np.unique(r[shared & (r != 0)], return_counts=True)
        return pa.table({"ref": np.concatenate([refs, *[k[0] for k in known]]),
                         "shared": np.concatenate([n.astype(np.int64), *[k[1] for k in known]])})

    rows = docs.select("text").mapInArrow(frugal(prefixes, _words), "bucket long, grams binary, refs binary")
    return rows.groupBy("bucket").applyInArrow(count, "ref long, shared long").groupBy("ref").agg(
        F.sum("shared").alias("shared"))


def load_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, grams) of the classes in ``wanted`` (id, sid, rep; settled), read from the row that stands for each."""
    # Only texts of probable ids are shuffled.
    near = near_keys(docs, "doc", wanted.select("rep"))
    rows = near.join(wanted.withColumnRenamed("rep", "doc"), "doc").select("id", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in _texts(batch, 2):
                keep = [(ids[i], s) for i, s in enumerate(part, first) if _set_id(s) == sids[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keep], pa.int64()), pa.array([len(k[1]) for k in keep], pa.int64()),
                     pa.array([k[1].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["id", "n", "grams"])

    return rows.mapInArrow(frugal(run, _words), "id long, n long, grams array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over the edges (a, b), by alternating large and small stars."""
    edges = settle(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, large = edges, settle(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = settle(small.select("u", F.col("m").alias("v")).unionAll(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        discard(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(roots)
        state = now


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length filter, and position filter at a common gram."""
    n_a, n_b, at_a, at_b = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    rest = F.least(n_a - at_a, n_b - at_b)
    return (
        (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
        & ((100 + percent) * rest >= percent * (n_a + n_b))
    )


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def verify(pairs: DataFrame, parts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: common grams are counted per fragment, then summed."""
    left = parts.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = parts.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    whole = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    n_a = sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"))
    n_b = sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"))
    return whole.join(n_a, "a").join(n_b, "b").where(
        100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def link(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, comp) of all sets (id, n, grams) that link with another; steps 2 to 4."""
    rows = sets.select("id", "n", F.explode("grams").alias("gram"))
    # Settled, as further below, so that both sides of a join are plain shuffles that Spark can split.
    counts = settle(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ordered = rows.join(counts, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    need = (percent * F.col("n") + 99 - (percent * F.col("n") + 99) % 100) / 100
    ordered = settle(ordered.withColumn("need", need.cast("int")).where(F.size("grams") >= F.col("need")))
    # at: grams of the whole set, the dropped ones first, before this one.
    dropped = F.col("n") - F.size("grams")
    prefix = settle(ordered.select(
        "id", "n", dropped.alias("dropped"),
        F.posexplode(F.slice("grams", F.lit(1), F.size("grams") - F.col("need") + 1))
    ).select("id", "n", (F.col("dropped") + F.col("pos")).alias("at"), F.col("col.gram").alias("gram"),
             (F.col("dropped") / F.col("n")).alias("rare")))
    n_rows = prefix.count()
    if not n_rows:
        return sets.sparkSession.createDataFrame([], "id long, comp long")
    # Cut the global order (rarity, then hash) at quantiles of the grams' occurrences.
    place = lambda g: g["df"] + (F.shiftrightunsigned(g["gram"], 11) / float(1 << 53))
    grams = ordered.select(F.explode("grams").alias("g")).select(place(F.col("g")).alias("p"))
    cuts = grams.agg(F.percentile_approx("p", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0]
    fragment = lambda g: sum((place(g) > c).cast("int") for c in cuts)

    def part(i: int) -> Column:
        mine = F.filter("grams", lambda g: fragment(g) == i)
        return F.struct(F.lit(i).alias("fragment"), F.transform(mine, lambda g: g["gram"]).alias("grams"))

    parts = settle(ordered.select("id", F.explode(F.array(*map(part, range(FRAGMENTS)))).alias("s")).select("id", "s.fragment", "s.grams").where(F.size("grams") > 0))
    sizes = ordered.select("id", "n")

    links, comps, before, turn, idle = None, None, None, 0, 0
    while True:
        members = prefix.withColumn("comp", F.col("id"))
        if comps is not None:
            members = settle(prefix.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        per_comp = members.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"))
        stats = per_comp.groupBy("gram").agg(
            F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")
        ).where("comps > 1").select("gram", "m", F.col("top.comp").alias("top"), F.col("top.c").alias("c"))
        stats = settle(stats)
        work = stats.agg(F.sum((F.col("m") - F.col("c")) * F.col("m").cast("double"))).first()[0] or 0.0
        if not work:
            break
        idle = idle + 1 if before is not None and work > 0.9 * before else 0
        last = turn > 0 and (work <= PAIRS_PER_ROW * n_rows or idle >= IDLE_ROUNDS)
        # Components only grow, so a bucket with one of them is done.
        open_ = settle(members.join(stats.select("gram", "top"), "gram"))
        outside = open_.where(F.col("comp") != F.col("top"))
        if last:
            joined = outside.alias("x").join(open_.alias("y"), F.col("x.gram") == F.col("y.gram"))
            pairs = _pairs(joined.where((F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent)))
        else:
            # By turns the most central set, any set, and the most central outside the largest component.
            rank = F.xxhash64("id", F.lit(turn)).cast("double") if turn % 2 else F.col("rare")
            hub = (outside if turn and turn % 2 == 0 else open_).groupBy("gram").agg(
                F.min(F.struct(rank.alias("rank"), "id", "n", "at", "comp")).alias("s")).select("gram", "s.*")
            joined = open_.alias("x").join(hub.alias("y"), F.col("x.gram") == F.col("y.gram"))
            joined = joined.where((F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent))
            nearest = joined.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
                F.count(F.lit(1)).alias("grams")).groupBy("a").agg(F.max(F.struct("grams", "b")).alias("s"))
            pairs = nearest.select(F.least("a", "s.b").alias("a"), F.greatest("a", "s.b").alias("b")).distinct()
        found = settle(verify(settle(pairs), parts, sizes, percent))
        links = found if links is None else links.unionAll(found)
        comps = settle(components(links))
        if last:
            break
        prefix = open_.drop("comp", "top")
        before, turn = work, turn + 1
    return comps if comps is not None else sets.sparkSession.createDataFrame([], "id long, comp long")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    described = settle(describe(docs))
    linkable = described.where("n > 0 and doc is not null")
    classes = settle(linkable.groupBy("sid", "ref", "n").agg(F.min("doc").alias("rep")).withColumn(
        "id", F.monotonically_increasing_id()))
    total = classes.agg(F.sum("n")).first()[0] or 0
    counts = shared_counts(docs.where("doc is not null"), total, percent)
    alive = settle(classes.join(counts, "ref").where("shared >= 1 + floor(n / 16)").select("id", "sid", "rep"))
    sets = settle(load_sets(docs, alive))
    if sets.count() > alive.count():  # repeated rows
        sets = settle(sets.dropDuplicates(["id"]))
    comps = link(sets, percent)
    joined = classes.join(comps, "id").select("sid", "rep", "comp")
    smallest = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    # The right side has one row per class, so only rows of the left can be many for a key.
    linked = joined.join(smallest, "comp").select("sid", "component_id")
    whole = settle(classes.select("sid", "rep").join(linked, "sid", "left").select(
        "sid", F.coalesce("component_id", "rep").alias("component_id")))
    return described.join(whole, "sid", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each group: the smallest id's.

    Repeated rows become one; different texts under one id both stay, and so do rows with a null id.
    """
    found = groups(df, id_col, text_col, percent).where(F.col(id_col).isNotNull())
    by_id = found.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.col(id_col) == F.col("component_id")).alias("_stays"))
    # Ids that go or come with several rows; the others' rows stay where they lie.
    doubtful = settle(by_id.where("_rows > 1 or not _stays").select(F.col(id_col).alias("_id"), "_stays"))
    gone = doubtful.where("not _stays").select("_id")
    near = near_keys(df, id_col, doubtful.select("_id"))
    rest = near.join(gone, F.col(id_col) == F.col("_id"), "left_anti").dropDuplicates([id_col, text_col])
    return near_keys(df, id_col, doubtful.select("_id"), "left_anti").unionByName(rest)
