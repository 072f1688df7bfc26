"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field.

Each line of a text has a few numeric features; the field's weights link them and neighbouring labels.
Viterbi decoding gives every line its label, and a text is kept when content lines hold at least half
of its word characters. Before that come two base rules: fewer than 50 words, or more than half of the
words in three-word windows that repeat within the text, fail.

The field is trained in numpy (exact forward-backward gradients) on documents with a quality label: per class
the ``MAX_PER_CLASS`` first in the order of their id's hash, of these the texts with at most ``MAX_CHARS``
characters and ``MAX_LINES`` lines. Lines have no labels of their own, so they are latent:

1. every line starts with its document's label, and as many sequences again are spliced from runs of lines of a
   good and a poor text, so that changes of the label within a text are seen,
2. after a first fit a line takes the likelier label, as long as most of its document's lines keep the
   document's; the field is then fitted to these labels, with new splices.

Decoding covers every line of every text.

Defined results: a null or empty text has no words, so its base rules fail; lines without words take
part in the chain but have no share; repeated lines count from their second occurrence; repeated
documents are judged each; without both classes the untrained field calls every line content. Only the
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

MIN_WORDS, MAX_REPEAT_SHARE, MIN_CONTENT = 50, 0.5, 0.5
MAX_PER_CLASS, MAX_CHARS, MAX_LINES = 800, 20_000, 200
STEPS, RATE, PENALTY = 120, 0.1, 1e-3
LONGEST_RUN = 2  # lines of one text in a row in a splice of many changes

# Classes of bytes: white space, symbols of the base rules, other signs, capitals, digits.
_KINDS = 5
_KIND = np.full(256, _KINDS, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[list(b"#*$%&|<>")] = 1
_KIND[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
FEATURES = 11


@dataclass(frozen=True)
class Lines:
    """Per line: features, word characters (code points); of the text: the base statistics."""

    features: np.ndarray
    chars: np.ndarray
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or self.n_repeat_words > MAX_REPEAT_SHARE * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, pairs = np.unique(codes[:-1] * len(known) + codes[1:], return_inverse=True)
    windows = pairs[:-1].astype(np.int64) * len(known) + codes[2:]
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[back] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + n - 2] |= repeated
    return int(covered.sum())


def read(text: str | None) -> Lines:
    """Features of all lines of a whole text, and its base statistics."""
    raw_bytes = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(raw_bytes, np.uint8)
    words = raw_bytes.split()
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.append(breaks, len(raw))
    sizes = (ends - starts).astype(float)
    kind = _KIND[raw]
    leading = (raw & 0xC0) != 0x80  # first bytes of code points
    in_word = (kind != 0) & leading
    first = (kind != 0) & np.concatenate([[True], kind[:-1] == 0]) if len(raw) else np.zeros(0, bool)

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[ends] - sums[starts]).astype(float)

    chars, n_words = per_line(in_word), per_line(first)
    seen: set[bytes] = set()
    repeated = np.zeros(len(starts))
    for i, line in enumerate(raw_bytes.split(b"\n")):
        if n_words[i]:
            if line in seen:
                repeated[i] = 1
            seen.add(line)
    whole = np.maximum(sizes, 1)
    last = np.where(sizes > 0, raw[np.maximum(ends - 1, 0)], 0) if len(raw) else np.zeros(1, int)
    features = np.stack([
        np.ones(len(starts)), np.log1p(n_words), np.log1p(chars / np.maximum(n_words, 1)),
        *[np.sqrt(per_line(kind == k) / whole) for k in range(1, _KINDS)],
        repeated, (n_words == 0).astype(float), np.isin(last, list(b".!?:")).astype(float),
        np.sqrt(per_line(raw == 33) / whole),
    ], 1)
    return Lines(features, chars, len(words), int(chars.sum()), int((kind == 1).sum()), int(repeated.sum()),
                 repeat_words(words))


@dataclass(frozen=True)
class Field:
    """Weights of a feature for label 1 (content) against 0, and of label pairs (from, to)."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest label sequence (Viterbi)."""
        scores = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, came = 0.0, scores[0], []
        for s in scores[1:]:
            from_0, from_1 = one + m10 > zero + m00, one + m11 > zero + m01
            came.append((from_0, from_1))
            zero, one = (one + m10 if from_0 else zero + m00), (one + m11 if from_1 else zero + m01) + s
        label = one >= zero
        labels = [label]
        for from_0, from_1 in reversed(came):
            label = from_1 if label else from_0
            labels.append(label)
        return np.array(labels[::-1], bool)

    def content_share(self, lines: Lines) -> float:
        if not lines.word_chars:
            return 0.0
        return float(lines.chars[self.decode(lines.features)].sum() / lines.word_chars)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def splice(good: np.ndarray, poor: np.ndarray, draw: np.random.Generator) -> list[int]:
    """An order of the lines of two texts in runs by turns: numbers of the good text's lines, then the poor's."""
    rest = [list(range(len(good))), list(range(len(good), len(good) + len(poor)))]
    out, turn = [], int(draw.integers(2))
    # A quarter of the splices have few changes, the others many.
    longest = LONGEST_RUN if draw.integers(4) else MAX_LINES
    while rest[0] or rest[1]:
        n = int(draw.integers(1, longest + 1))
        out += rest[turn][:n]
        rest[turn] = rest[turn][n:]
        turn = 1 - turn
    return out[:MAX_LINES]


def _chances(x: np.ndarray, real: np.ndarray, emit: np.ndarray, move: np.ndarray):
    """Chance of content per line, and of each pair of labels of neighbours, by forward and backward sums."""
    n, longest = real.shape
    s = np.stack([np.zeros((n, longest)), x @ emit], 2)
    ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    ahead[:, 0] = s[:, 0]
    for t in range(1, longest):
        new = s[:, t] + _log_sum(ahead[:, t - 1, :, None] + move, 1)
        ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = _log_sum(move + (s[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(real[:, t + 1, None], new, 0)
    total = _log_sum(ahead[:, -1], 1)
    chance = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]) * real
    both = np.exp(ahead[:, :-1, :, None] + move + (s[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return chance, both * real[:, 1:, None, None]


def _padded(rows: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, y = np.zeros((len(rows), longest, FEATURES)), np.zeros((len(rows), longest))
    real = np.zeros((len(rows), longest), bool)
    for i, (r, line_labels) in enumerate(zip(rows, labels, strict=True)):
        x[i, :len(r)], y[i, :len(r)], real[i, :len(r)] = r, line_labels, True
    return x, y, real


def _ascend(rows: list[np.ndarray], labels: list[np.ndarray], weight: np.ndarray, field: Field, steps: int) -> Field:
    """Gradient ascent on the weighted conditional likelihood of the lines' labels."""
    sizes = np.array([len(r) for r in rows])
    weight = weight / weight.sum() / sizes
    emit, move = field.emit.copy(), field.move.copy()
    moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    groups, seen, found = [], np.zeros(FEATURES), np.zeros((2, 2))
    band = np.ceil(np.log2(sizes))  # texts of like lengths together, for little padding
    for b in np.unique(band):
        at = np.flatnonzero(band == b)
        x, y, real = _padded([rows[i] for i in at], [labels[i] for i in at])
        ones = np.stack([real - y, y], 2)
        seen += np.einsum("n,ntf,nt->f", weight[at], x, y)
        found += np.einsum("n,nta,ntb->ab", weight[at], ones[:, :-1] * real[:, 1:, None], ones[:, 1:])
        groups.append((weight[at], x, real))
    for step in range(1, steps + 1):
        slope, expected = seen.copy(), np.zeros((2, 2))
        for w, x, real in groups:
            chance, both = _chances(x, real, emit, move)
            slope -= (w[:, None] * chance).ravel() @ x.reshape(-1, FEATURES)
            expected += np.einsum("n,ntab->ab", w, both)
        g = np.concatenate([slope, (found - expected).ravel()]) - PENALTY * np.concatenate([emit, move.ravel()])
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.001 * (g * g - moments[1])
        change = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        emit, move = emit + change[:FEATURES], move + change[FEATURES:].reshape(2, 2)
    return Field(emit, move)


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS) -> Field:
    """The field of the texts and their splices, with latent lines."""
    if len(set(labels)) < 2:
        return Field(np.eye(1, FEATURES)[0], np.zeros((2, 2)))
    draw = np.random.default_rng(7)
    rows, y = [read(t).features for t in texts], np.array(labels)
    lines = [np.full(len(r), float(label)) for r, label in zip(rows, y, strict=True)]
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)

    def with_splices(start: Field, steps: int) -> Field:
        mixed, mixed_labels = [], []
        for i, j in zip(draw.permutation(np.resize(good, len(rows))), draw.permutation(np.resize(poor, len(rows))), strict=True):
            order = splice(rows[i], rows[j], draw)
            mixed.append(np.concatenate([rows[i], rows[j]])[order])
            mixed_labels.append(np.concatenate([lines[i], lines[j]])[order])
        return _ascend(rows + mixed, lines + mixed_labels, np.concatenate([weight, np.full(len(mixed), 6 / len(mixed))]), start, steps)

    field = with_splices(Field(np.zeros(FEATURES), np.zeros((2, 2))), steps)
    for i, r in enumerate(rows):
        chance, _ = _chances(r[None], np.ones((1, len(r)), bool), field.emit, field.move)
        likelier = (chance[0] > 0.5).astype(float)
        if (likelier.mean() > 0.5) == (y[i] == 1):  # most lines keep the document's label
            lines[i] = likelier
    return with_splices(field, steps // 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Field:
    """Fit on the bounded sample of labelled documents described above."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        "_id is not null").distinct()
    picked = None
    for label in (0, 1):
        part = named.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(MAX_PER_CLASS)
        picked = part if picked is None else picked.unionAll(part)
    text = F.col("_text")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(
        (F.length(text) <= MAX_CHARS) & (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < MAX_LINES))
    # The sample has 2 * MAX_PER_CLASS rows at most, so it may be broadcast whatever the input.
    rows = texts.join(F.broadcast(picked), "_id").orderBy("_id", "_text").limit(2 * MAX_PER_CLASS).collect()
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows])


_VERDICT = T.StructType([
    *[T.StructField(name, T.LongType()) for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()), T.StructField("content_lines", T.LongType()),
    T.StructField("n_lines", T.LongType()),
])


def judge(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, the verdict and the lines' labels in place of the text.

    Columns of ``docs`` with these names are replaced.
    """

    @arrow_udf(_VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        rows = []
        for cell in texts:
            lines = read(cell.as_py())
            labels = field.decode(lines.features)
            share = float(lines.chars[labels].sum() / lines.word_chars) if lines.word_chars else 0.0
            failed = bool(lines.base_failed)
            rows.append((lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words,
                         failed, not failed and share >= MIN_CONTENT, share, int(labels.sum()), len(labels)))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names=_VERDICT.names)

    out = docs.withColumn("_verdict", verdict(F.col(f"`{text_col}`").cast("string"))).drop(text_col, *_VERDICT.names)
    return out.select("*", "_verdict.*").drop("_verdict")
