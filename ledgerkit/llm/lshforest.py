"""MinHash near-duplicates by an LSH forest; links are confirmed on the full sets.

Equal sets become one class first, so copies cost nothing further. Then:

1. Signatures. ``TREES`` * ``DEPTH`` minima of a set's gram hashes, cut into one sequence per tree.
2. Sorted orders. A tree's order is that of its sequences; sets that share their first ``MIN_DEPTH`` values are a
   region. Two sets of similarity 0.8 share none of the 24 regions with a chance of 3e-8.
3. Candidates. First each set and the neighbour before it, which has the longest common prefix, in a few trees; links
   form components, and from then on only sets of different components are compared. Regions above ``REGION`` sets
   are then compared with a hub, the set that has the commonest value in most places, in a third of the trees.
   Then all trees: a region of up to ``REGION`` sets is compared as it is, a larger one goes
   deeper, value by value, until its parts are that small; what stays large is compared with its hub and neighbours.
4. Verification. Pairs whose signatures differ by more than six standard deviations from what a link allows go;
   of the others the common grams are counted on the full sets.
5. Rest. Members of larger regions that still hold several components are joined exactly, on a gram of their
   prefixes in the order of rarity; by ``jaccard.link`` where that would compare too much. So no region is capped.

Words are runs of anything but space and U+0009 to U+000D, with A-Z in lower case; grams are hashed to
64 bits. Defined results: null and empty texts have no grams and no links; fewer words than a gram
make one gram of the whole sequence; repeated documents have equal sets and share a component; a row
with a null id is linked with nothing, has itself (null) as component and is kept; an empty table gives no
rows. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import chunks, frugal
from ledgerkit.llm.jaccard import _words, gram_sets
from ledgerkit.llm.jaccard import components as star_components
from ledgerkit.llm.jaccard import link as exact_links
from ledgerkit.session import discard, settle

GRAM, PERCENT = 4, 80
TREES, DEPTH, MIN_DEPTH = 24, 8, 3
REST = DEPTH - MIN_DEPTH
NEAR_TREES = 3  # orders whose neighbours are compared first
REGION = 24  # sets that are compared pair by pair
BLOCK_ROWS = 20_000  # rows of a region that one task sorts; more are cut by their whole sequence
HUB_PART = 3  # one of so many trees gives hubs
FEW_ROWS = 1_000_000  # rows of some 40 bytes that may be broadcast; beyond, both sides are shuffled
PART_EDGES = 500_000  # links that one task contracts
PAIRS_PER_ROW = 5  # comparisons per prefix row beyond which the rest is left to ``jaccard.link``
SLACK = 6  # standard deviations of the signatures' estimate
_BLOCK = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(13)
_FACTORS = _draw.integers(0, 1 << 32, (TREES * DEPTH, 1), np.uint32) | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, (TREES * DEPTH, 1), np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set's grams, one row per set; none of the sets may be empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    grams = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    cuts = np.union1d(starts, np.arange(0, len(grams), _BLOCK))  # pieces of sets
    minima = np.empty((len(cuts), len(_FACTORS)), np.uint32)
    for at in range(0, len(grams), _BLOCK):  # the hashes of a block stay in the processor's cache
        first, last = np.searchsorted(cuts, (at, at + _BLOCK))
        hashed = (grams[at:at + _BLOCK] ^ _SHIFTS) * _FACTORS
        minima[first:last] = np.minimum.reduceat(hashed, cuts[first:last] - at, axis=1).T
    return np.minimum.reduceat(minima, np.searchsorted(cuts, starts), axis=0)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    width = values.strides[0] if len(values) else 0
    offsets = (np.arange(len(values) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _set_id(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc, set id, n and signature for each row of (doc, text); the signature of an empty set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                sets = gram_sets(part.to_pylist(), size)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full).astype(">u4")) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(sets)), pa.array([_set_id(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(rows).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                    ["doc", "sid", "n", "signature"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(frugal(run, _words), f"doc {kind}, sid binary, n long, signature binary")


def forest(classes: DataFrame, with_rows: bool = True) -> DataFrame:
    """The regions of all classes (id, n, signature); with rows (region, id, n, seq).

    A region's number ends with its tree (five bits); seq is the rest of the tree's sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(2).to_pylist())
            values = np.frombuffer(raw, ">u4").reshape(-1, TREES, DEPTH)
            region = np.broadcast_to(np.arange(TREES, dtype=np.uint64), values.shape[:2]) * _MIX
            for d in range(MIN_DEPTH):
                region = (region ^ values[:, :, d].astype(np.uint64)) * _MIX
                region = region ^ (region >> np.uint64(29))
            region = (region & ~np.uint64(31)) | np.arange(TREES, dtype=np.uint64)
            keys = pa.array(region.view(np.int64).ravel())
            if not with_rows:
                yield pa.RecordBatch.from_arrays([keys], ["region"])
                continue
            ids, n = (np.repeat(batch.column(c).to_numpy(), TREES) for c in (0, 1))
            rest = np.ascontiguousarray(values[:, :, MIN_DEPTH:]).reshape(-1, REST)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids), pa.array(n), _fixed(rest)], ["region", "id", "n", "seq"])

    columns = "region long, id long, n long, seq binary" if with_rows else "region long"
    return classes.select("id", "n", "signature").mapInArrow(frugal(run), columns)


def few(df: DataFrame) -> DataFrame:
    """Marked for broadcast when it is small; ``df`` is settled, so counting it costs nothing."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def _hub(seq: np.ndarray) -> int:
    """The row that has the commonest value in most places."""
    score = np.zeros(len(seq), np.int64)
    for column in seq.T:
        values, at, times = np.unique(column, return_inverse=True, return_counts=True)
        score += at == np.argmax(times)
    return int(np.argmax(score))


def _region_pairs(seq: np.ndarray, comp: np.ndarray, how: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare in one region, whose rows lie in the order of their sequences."""
    open_parts = [(0, len(comp), 0)]
    while open_parts:
        start, end, depth = open_parts.pop()
        m = end - start
        if m < 2 or (comp[start:end] == comp[start]).all():
            continue
        small = m <= REGION
        if how == "near" or (not small and depth == 0):
            yield np.arange(start, end - 1), np.arange(start + 1, end)
        if how == "near" or (how == "hub" and small):
            continue
        if small:
            a, b = np.triu_indices(m, 1)
            yield a + start, b + start
            continue
        if how == "hub" or depth == REST:
            yield np.full(m, start + _hub(seq[start:end])), np.arange(start, end)
        if depth < REST:
            values = seq[start:end, depth]
            cuts = start + np.flatnonzero(values[1:] != values[:-1]) + 1
            open_parts += [(a, b, depth + 1) for a, b in zip([start, *cuts], [*cuts, end], strict=True)]


def candidates(rows: DataFrame, how: str, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of the rows (region, id, n, comp, seq, m), by neighbours ("near"), hubs ("hub") or "all"."""
    # A region beyond what a task should sort is cut: by its whole sequence, by turns with random blocks.
    blocks = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("m") / BLOCK_ROWS))
    part = F.when(F.col("m") <= BLOCK_ROWS, F.col("region")).otherwise(
        F.xxhash64("region", "seq", blocks) if turn % 2 == 0 else F.xxhash64("region", blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            key, ids, n, comp = (table.column(c).to_numpy() for c in ("part", "id", "n", "comp"))
            seq = np.frombuffer(b"".join(table.column("seq").to_pylist()), ">u4").reshape(-1, REST)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            found = [np.zeros((2, 0), np.int64)]
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                for a, b in _region_pairs(seq[s:e], comp[s:e], how):
                    a, b = a + s, b + s
                    fits = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                    found.append(np.stack([ids[a[fits]], ids[b[fits]]]))
            pairs = np.sort(np.concatenate(found, axis=1), axis=0)
            pairs = np.unique(pairs, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            # A batch ends anywhere, so its last region waits for the next one.
            key = batch.column(0).to_numpy()
            if held and held[-1].num_rows and held[-1].column(0)[-1].as_py() != key[0]:
                yield flush()
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if last:
                held.append(batch.slice(0, last))
                yield flush()
            held.append(batch.slice(last))
        if held:
            yield flush()

    ordered = rows.select(part.alias("part"), "id", "n", "comp", "seq").repartition("part").sortWithinPartitions("part", "seq", "id")
    return ordered.mapInArrow(frugal(run), "a long, b long").distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures do not rule out a link."""
    j, k = percent / 100, TREES * DEPTH
    least = j * k - SLACK * (j * (1 - j) * k) ** 0.5
    known = classes.join(few(_ids(pairs)), "id", "left_semi")
    one, other = (known.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, k) for c in (2, 3))
            keep = pa.array((left == right).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "signature_a", "signature_b").mapInArrow(frugal(run), "a long, b long")


def load_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, grams) of the classes in ``ids``, read from the rows that stand for them; settled."""
    wanted = settle(classes.join(few(ids), "id", "left_semi").select("id", "sid", F.col("rep").alias("doc")))
    # Few are found while the texts are read, so the texts are not shuffled.
    rows = docs.join(few(wanted), "doc").select("id", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in chunks(batch.column(2)):
                keep = [(ids[i], s) for i, s in enumerate(gram_sets(part.to_pylist(), size), first) if _set_id(s) == sids[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keep], pa.int64()), pa.array([len(k[1]) for k in keep], pa.int64()),
                     pa.array([k[1].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["id", "n", "grams"])

    sets = settle(rows.mapInArrow(frugal(run, _words), "id long, n long, grams array<long>"))
    if sets.count() > wanted.count():  # repeated rows
        sets = settle(sets.dropDuplicates(["id"]))
    return sets


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link on their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    other = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.join(one, "a").join(other, "b").where(
        100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the smallest node that each reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over the links (a, b).

    Tasks of up to ``PART_EDGES`` links contract what they hold, so the rounds over all of them start from
    short paths; links that fit one such task need no rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        ids, comp = contract(held.column("a").to_numpy(), held.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp)], ["id", "comp"])

    parts = -(-links.count() // PART_EDGES)
    found = settle(links.select("a", "b").repartition(max(1, parts)).mapInArrow(frugal(run), "id long, comp long"))
    return found if parts <= 1 else star_components(found.select(F.col("id").alias("a"), F.col("comp").alias("b")))


def rare_pairs(sets: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame | None:
    """Pairs of different components that share a gram of their prefixes, rarest first; None where they would be too many.

    Two linked sets share one of the first n - ceil(t n) + 1 grams in any common order.
    """
    rows = sets.select("id", "n", F.explode("grams").alias("gram"))
    counts = settle(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    need = ((percent * F.col("n") + 99 - (percent * F.col("n") + 99) % 100) / 100).cast("int")
    shared = rows.join(counts, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    # Grams of one set only come first in the order and cannot be shared, so they only shorten the prefix.
    prefix = shared.where(F.size("g") >= need).select(
        "id", "n", (F.col("n") - F.size("g")).alias("dropped"), F.posexplode(F.slice("g", F.lit(1), F.size("g") - need + 1)))
    prefix = prefix.select(
        "id", "n", (F.col("dropped") + F.col("pos")).alias("at"), F.col("col.gram").alias("gram"), F.col("id").alias("comp"))
    if comps is not None:
        named = comps.select("id", F.col("comp").alias("of"))
        prefix = prefix.join(few(named), "id", "left").withColumn("comp", F.coalesce("of", "comp")).drop("of")
    prefix = settle(prefix)
    per = prefix.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = settle(per.groupBy("gram").agg(
        F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select(
            "gram", "m", F.col("top.comp").alias("top"), F.col("top.c").alias("c")))
    work = several.agg(F.sum((F.col("m") - F.col("c")) * F.col("m").cast("double"))).first()[0] or 0.0
    if work > PAIRS_PER_ROW * prefix.count():
        return None
    open_ = settle(prefix.join(several.select("gram", "top"), "gram"))
    x, y = open_.where("comp <> top").alias("x"), open_.alias("y")
    fits = (F.col("x.comp") != F.col("y.comp")) & (
        100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    # From the first gram they share on, both must hold what a link needs.
    fits = fits & ((100 + percent) * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= percent * (F.col("x.n") + F.col("y.n")))
    return x.join(y, F.col("x.gram") == F.col("y.gram")).where(fits).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(id, comp) of the classes that link with another; None without any."""
    shared = settle(forest(classes, with_rows=False).groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    rows = settle(forest(classes).join(few(shared), "region"))
    tree = F.col("region").bitwiseAND(31)
    comps = None

    def add(pairs: DataFrame) -> bool:
        """Confirm pairs; whether that brought links."""
        nonlocal comps
        pairs = settle(likely(settle(pairs), classes, percent))
        sets = load_sets(docs, classes, _ids(pairs), size)
        found = settle(confirm(pairs, sets, percent))
        discard(sets)
        if found.isEmpty():
            return False
        # Old links count by their components only.
        known = found if comps is None else found.unionAll(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = settle(components(settle(known)))
        return True

    def open_rows(of: DataFrame) -> DataFrame:
        """Rows with their components, of the regions that hold more than one."""
        named = of.drop("comp")
        if comps is None:
            return named.withColumn("comp", F.col("id"))
        named = settle(named.join(few(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        several = named.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        return settle(named.join(few(settle(several.select("region"))), "region"))

    add(candidates(open_rows(rows.where(tree < NEAR_TREES)), "near", 0, percent))
    rest = open_rows(rows)
    large = rest.where((F.col("m") > REGION) & (tree % HUB_PART == 0))
    if not large.isEmpty() and add(candidates(large, "hub", 1, percent)):
        rest = open_rows(rest)
    add(candidates(rest, "all", 0, percent))
    left = settle(open_rows(rest.where(F.col("m") > REGION)).select("id").distinct())
    if not left.isEmpty():
        sets = load_sets(docs, classes, left, size)
        pairs = rare_pairs(sets, comps, percent)
        if pairs is not None:
            found = confirm(settle(likely(settle(pairs), classes, percent)), sets, percent)
        else:
            found = exact_links(sets, percent).select(F.col("id").alias("a"), F.col("comp").alias("b"))
        known = found if comps is None else found.unionAll(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = settle(components(settle(known)))
    return comps


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    described = settle(describe(docs, size))
    classes = settle(described.where("n > 0 and doc is not null").groupBy("sid", "n").agg(
        F.min("doc").alias("rep"), F.any_value("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()))
    comps = link(docs.where("doc is not null"), classes, size, percent)
    whole = classes.select("sid", F.col("rep").alias("component_id"))
    if comps is not None:
        joined = classes.select("sid", "rep", "id").join(comps, "id", "left")
        smallest = joined.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("low"))
        whole = settle(joined.join(smallest, "comp", "left").select("sid", F.coalesce("low", "rep").alias("component_id")))
    linked = (F.col("n") > 0) & F.col("doc").isNotNull()
    # The right side has one row per class, so only rows of the left can be many for a key.
    return described.join(whole, "sid", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        (~linked | (F.col("doc") == F.col("component_id"))).alias("kept"))
