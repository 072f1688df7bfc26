"""Benchmark decontamination: pigeonhole edit matching.

An item of length L may occur in a text with up to k = ``rate`` * L edits. It is cut into k + 1 pieces;
at least one of them must then occur unchanged. One automaton over the pieces of all items finds
those hits, hits of an item that lie together become one region, and Myers' bit-parallel distance over
the region finds the best end and, read backwards, its start. Nothing is skipped: every hit is verified.

Texts and items are compared in lower case with white space runs as one blank; ``start`` and ``end``
count characters of that form of the text. Items are taken in blocks of ``BLOCK_CHARS`` characters, so
what a task and the driver hold has a fixed bound; each further block is another pass over the texts, after the
results of the block before are written.

Defined results: a null or empty text matches nothing; a null or empty item is never matched; an item
given twice (or two items with one text) is reported for each; each item is reported with all its matches in
a text that do not overlap, of overlapping ones the best, the leftmost at a tie; repeated documents are reported each. Empty tables give no
matches. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerkit.session import settle

RATE = 0.06  # edits per character of an item
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Item:
    """One test item with its masks for Myers' algorithm, forwards and backwards."""

    def __init__(self, key: object, text: str, rate: float):
        self.key, self.text, self.budget = key, text, int(rate * len(text))
        self.masks = self._masks(text)
        self.back_masks = self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for at, char in enumerate(text):
            masks[char] |= 1 << at
        return dict(masks)

    def pieces(self) -> Iterator[tuple[int, str]]:
        """budget + 1 pieces of nearly equal length with their offsets."""
        n, length = self.budget + 1, len(self.text)
        for i in range(n):
            start, end = i * length // n, (i + 1) * length // n
            yield start, self.text[start:end]


def best_end(masks: dict[str, int], length: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern that ends at ``end``, the first at a tie.

    A match may start anywhere, or only at 0 when ``anchored``.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for at, char in enumerate(text, 1):
        eq = masks.get(char, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | anchored
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items = [Item(key, text, rate) for key, text in items if text]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            for offset, piece in item.pieces():
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, start, end, distance) of all places where an item occurs within its budget."""
        if not text or not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, found) in self.automaton.iter(text):
            for number, offset in found:
                starts[number].add(end + 1 - length - offset)
        out = []
        for number in sorted(starts):
            out += [(self.items[number].key, *m) for m in self._verify(self.items[number], sorted(starts[number]), text)]
        return out

    @staticmethod
    def _verify(item: Item, starts: list[int], text: str) -> list[tuple[int, int, int]]:
        size, k = len(item.text), item.budget
        found = []
        at = 0
        while at < len(starts):
            first = last = starts[at]
            at += 1
            if first >= 0 and text.startswith(item.text, first):
                found.append((first, first + size, 0))
                continue
            # Starts this near belong to one occurrence; an exact one has been taken or comes on its own.
            while at < len(starts) and starts[at] <= first + 2 * k and not (
                    starts[at] >= 0 and text.startswith(item.text, starts[at])):
                last, at = starts[at], at + 1
            low, high = max(0, first - k), min(len(text), last + size + k)
            distance, end = best_end(item.masks, size, text[low:high])
            if distance <= k:
                stop = low + end
                back = text[max(0, stop - size - k):stop][::-1]
                _, length = best_end(item.back_masks, size, back, anchored=True)
                found.append((stop - length, stop, distance))
        kept: list[tuple[int, int, int]] = []  # in the order of their places
        for match in sorted(found, key=lambda m: (m[2], m[0])):
            place = bisect(kept, match)
            if (not place or kept[place - 1][1] <= match[0]) and (place == len(kept) or match[1] <= kept[place][0]):
                kept.insert(place, match)
        return kept


def blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in blocks of bounded size, read one partition after the other."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = normal(row["t"] or "")
        if not text:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row["i"], text))
        size += len(text)
    if block:
        yield block


def matcher(block: list[tuple[object, str]], kind: T.DataType, rate: float = RATE):
    """A column function: the matches of a block's items in a text."""
    result = T.ArrayType(T.StructType([
        T.StructField("item_id", kind), *T.StructType.fromDDL("start long, end long, distance long").fields]))
    held: list[Matcher] = []

    @arrow_udf(result)
    def find(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(block, rate))
        rows = [
            [dict(zip(("item_id", "start", "end", "distance"), m, strict=True)) for m in held[0].find(t.as_py())]
            for t in texts
        ]
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(rows, to_arrow_type(result))

    return find


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per match of an item in a document: id, item_id, start, end, distance."""
    kind = items.schema[item_col].dataType
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def part(block: list[tuple[object, str]]) -> DataFrame:
        return source.select(id_col, F.explode(matcher(block, kind, rate)(F.col("_text"))).alias("m")).select(
            id_col, F.col("m.item_id").alias("item_id"), "m.start", "m.end", "m.distance")

    done, last = None, None
    for block in blocks(items, item_col, item_text_col):
        if last is not None:  # written, so that neither the driver nor the plan keeps its block
            written = settle(last)
            done = written if done is None else done.unionAll(written)
        last = part(block)
    last = part([]) if last is None else last
    return last if done is None else done.unionAll(last)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, in which no item occurs."""
    kind = items.schema[item_col].dataType
    for number, block in enumerate(blocks(items, item_col, item_text_col)):
        docs = settle(docs) if number else docs
        hit: Column = matcher(block, kind, rate)(F.col(f"`{text_col}`").cast("string"))
        docs = docs.where(F.size(hit) == 0)
    return docs
