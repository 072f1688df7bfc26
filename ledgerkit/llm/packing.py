"""Packing of token sequences: online sum-of-squares bin packing, one stream per partition.

A document's ids are cut into full windows and a rest. The rest goes to the fill level that makes the
sum of squared counts of partially filled windows smallest (Csirik, Johnson, Kenyon, Orlin, Shor,
Weber: the sum-of-squares rule); the counts live in one array by level, so a placement is one
vector operation. Windows still open at the end of a partition, or once ``OPEN_TOKENS`` ids wait in
them, are closed: their pieces are laid end to end and cut at the window size, and what remains is
cut into windows whose sizes are powers of two, which need no padding. Documents may be cut
anywhere, so nothing is dropped and only the ids of open windows are held.

A partition is packed alone, without a shuffle; ``sequence_id`` is the partition number and a
counter. The same partition gives the same sequences, so a lost task can run again.

Defined results: a null or empty text is the end id alone; repeated documents are packed each;
a null id is carried as it is; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.llm.common import chunks, frugal

WINDOW = 4096
END_ID = 2
OPEN_TOKENS = 4 << 20  # ids held in open windows before they are closed
CACHED_WORDS = 200_000  # pieces whose ids a Python worker remembers
PIECES_AT_ONCE = 2_000
# White space that Python and the tokenizer see differently.
_OTHER_SPACE = bytes(range(0x1C, 0x20))
# The vocabulary's own split into pieces, for Latin-1 text in lower case (numbers are single signs).
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTERS}{_NUMBERS}]+")


class WordTokenizer:
    """Ids of whole texts, tokenizing each distinct piece once.

    The vocabulary's normal form and split into pieces are applied to Latin texts here (they have
    no combining marks, so lower case is all there is to do); the tokenizer then gives the ids of
    pieces it has not met. All other texts go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = next(
            p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._clear()

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}  # number of a piece; its ids are in flat, from starts, sizes long
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # met in a later call than the one that learnt it

    def trim(self) -> None:
        """Forget the pieces that were not met again since the last time; the frequent ones stay."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > CACHED_WORDS:
            keep = keep[:0]
        names, sizes, starts, flat = list(self.codes), self.sizes[keep], self.starts[keep], self.flat
        self._clear()
        self.sizes, self.starts, self.used = sizes, np.cumsum(sizes) - sizes, int(sizes.sum())
        at = np.arange(self.used) + np.repeat(starts - self.starts, sizes)
        self.flat[:self.used] = flat[at]
        self.codes = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.again = np.zeros(len(keep), bool)

    def _learn(self, pieces: list[str]) -> None:
        """Give numbers to the pieces without one."""
        new = list(set(pieces).difference(self.codes))
        if not new:
            return
        ids, sizes = [], []
        for at in range(0, len(new), PIECES_AT_ONCE):  # one call for many pieces, each a word of its own
            part = new[at:at + PIECES_AT_ONCE]
            found = self.pieces.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found[0].ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.last[ids[-1]]), prepend=-1))
            if len(sizes[-1]) != len(part):
                raise ValueError("a piece does not end with an end of word")
        sizes = np.concatenate(sizes)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):  # a trimmed table may start fuller than a new one
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used:self.used + total] = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.used += total
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit arrays."""
        if len(self.codes) > CACHED_WORDS:
            self.trim()
        plain = [bool(t) and _plain_path(t) for t in texts]
        split = [_PIECES.findall(t.lower()) if t and not p else [] for t, p in zip(texts, plain, strict=True)]
        words = [w for s in split for w in s]
        known = len(self.codes)
        self._learn(words)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        self.again[codes[codes < known]] = True
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        first = np.repeat(self.starts[codes] - (ends - sizes), sizes)
        ids = self.flat[np.arange(len(first)) + first]
        bounds = np.concatenate([[0], ends])
        out, at = [], 0
        for text, s, p in zip(texts, split, plain, strict=True):
            if p:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[bounds[at]:bounds[at + len(s)]])
                at += len(s)
        return out


def _plain_path(text: str) -> bool:
    """Whether a text must go through the tokenizer whole: signs beyond Latin-1, or special tokens."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return len(raw.translate(None, _OTHER_SPACE)) < len(raw) or "<|startoftext|>" in text or "<|endoftext|>" in text


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer, with the pieces it has met, for all tasks of a Python worker."""
    return WordTokenizer(path)


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, ids)."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # open windows by level; 0 and full stay 0
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.held = 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece shorter than a window somewhere; the window when that fills it."""
        size = len(piece[2])
        # Level h to h + size changes the sum by 2 (counts[h + size] - counts[h] + 1); a new window
        # has no count to take away, a full one none to add.
        rise = 2 * (self.counts[size:] - self.counts[:self.window + 1 - size] + 1)
        rise[0] = 2 * self.counts[size] + 1
        rise[-1] -= 1
        used = self.counts[:self.window + 1 - size] > 0
        used[0] = True
        level = int(np.where(used, rise, np.iinfo(np.int64).max).argmin())
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append(piece)
        self.held += size
        if level + size == self.window:
            self.held -= self.window
            return pieces
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """Cut all open windows' pieces anew: full windows, then sizes that are powers of two."""
        pieces = [p for level in sorted(self.open) for group in self.open[level] for p in group]
        left, self.held = self.held, 0
        self.open.clear()
        self.counts[:] = 0
        at, used = 0, 0
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                doc, start, ids = pieces[at]
                take = min(size, len(ids) - used)
                out.append((doc, start + used, ids[used:used + take]))
                size, used = size - take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            yield out


def pack_documents(documents: Iterator[tuple[object, np.ndarray]], window: int = WINDOW,
                   open_tokens: int = OPEN_TOKENS) -> Iterator[list[tuple]]:
    """Sequences, each a list of (document, start, ids)."""
    bins = SumOfSquares(window)
    for doc, ids in documents:
        full = len(ids) // window * window
        for start in range(0, full, window):
            yield [(doc, start, ids[start:start + window])]
        if full < len(ids):
            done = bins.place((doc, full, ids[full:].copy()))
            if done:
                yield done
        if bins.held >= open_tokens:
            yield from bins.close()
    yield from bins.close()


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    if window & (window - 1):
        raise ValueError("the window size must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), *T.StructType.fromDDL(
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)
    source = df.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)  # trimmed at the end, so the process keeps only frequent pieces
        base = TaskContext.get().partitionId() << 40
        id_type = [pa.int64()]

        def documents():
            for batch in batches:
                id_type[0] = batch.column(0).type
                ids = batch.column(0).to_pylist()
                for first, part in chunks(batch.column(1)):
                    for row, found in enumerate(tokenizer.encode(part.to_pylist()), first):
                        tokens = np.append(found, np.uint32(end_id))
                        yield (ids[row], len(tokens)), tokens

        rows: list[tuple] = []
        held = 0

        def batch():
            columns = [pa.array([r[0] for r in rows], id_type[0])]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for number, pieces in enumerate(pack_documents(documents(), window)):
            offset = 0
            for (doc, tokens), start, ids in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((doc, start, len(ids), crc, tokens, base + number, offset,
                             ids.astype(np.int64) if with_ids else None))
                offset += len(ids)
                held += len(ids) if with_ids else 100
            if held > 1 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()
        tokenizer.trim()

    return source.mapInArrow(frugal(run), schema)
