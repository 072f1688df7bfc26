"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into windows of ``WINDOW`` words that overlap by half; all windows of the whole text are
scored and the highest logit is the text's. A word enters as its own vector (words of the training
vocabulary; one shared vector for all others) beside the mean of its character pairs' vectors. Both are
multiplied into the recurrent layers' inputs once per distinct word, so the work per word is the
recurrence alone.

Training uses a bounded sample of labelled documents: per class the ``MAX_PER_CLASS`` first in the order
of their id's hash, of these the texts of at most ``MAX_CHARS`` characters. A document is a bag of
windows: each step lets the current network pick the window that speaks most for toxicity and moves the
weights by that window. Word vectors start from the words' log odds between the classes. Scoring
covers every text to its end.

Defined results: a null or empty text, or one without letters, is one empty window and gets that
window's score; repeated documents are scored each; labels other than 0 and 1 do not train; without
both classes every score is the share of the class present (0.5 with none). Only the named columns are
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerkit.llm.common import chunks

WINDOW, STEP = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
PAIRS = 2048  # buckets of character pairs
VOCABULARY, MIN_DOCS = 40_000, 4
MAX_PER_CLASS, MAX_CHARS = 2_000, 8_000
EPOCHS, BATCH, RATE = 8, 64, 0.01
CACHED_WORDS = 200_000
GROUP = 2_048  # windows scored together
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pair_buckets(word: str) -> list[int]:
    """Buckets of the character pairs of a word with its edges marked."""
    marked = f"<{word}>"
    return [(ord(a) * 131 + ord(b)) % PAIRS for a, b in zip(marked, marked[1:], strict=False)]


def window_grid(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window within the joined words, and its document. A text has one at least."""
    starts, owners, base = [], [], 0
    for doc, n in enumerate(lengths):
        count = 1 if n <= WINDOW else -(-(n - WINDOW) // STEP) + 1
        starts.append(base + STEP * np.arange(count))
        owners.append(np.full(count, doc))
        base += n
    return np.concatenate(starts), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name and the training vocabulary."""

    w: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    constant: float | None = None

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of distinct words, with their vocabulary rows and pair averages."""
        rows = np.array([self.vocabulary.get(x, 0) for x in words], np.int64)
        pairs = [pair_buckets(x) for x in words]
        sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
        flat = np.fromiter((b for p in pairs for b in p), np.int64, int(sizes.sum()))
        chars = np.add.reduceat(self.w["char"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.concatenate([self.w["word"][rows], chars], 1), rows, chars

    def projected(self, words: list[str]) -> np.ndarray:
        """The words' part of the gates, both directions side by side."""
        x = self.inputs(words)[0] if words else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        return np.concatenate([x @ self.w["wf"] + self.w["bf"], x @ self.w["wb"] + self.w["bb"]], 1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: gates is (windows, WINDOW, 6 HIDDEN), mask marks real words."""
        n, steps, h = len(gates), gates.shape[1], HIDDEN
        states = np.zeros((n, steps, 2 * h), np.float32)
        trace = {}
        for name, at, order in (("f", 0, range(steps)), ("b", 3 * h, range(steps - 1, -1, -1))):
            u, state = self.w["u" + name], np.zeros((n, h), np.float32)
            for t in order:
                g = gates[:, t, at:at + 3 * h]
                m = state @ u
                zr = _sigmoid(g[:, :2 * h] + m[:, :2 * h])
                new = np.tanh(g[:, 2 * h:] + zr[:, h:] * m[:, 2 * h:])
                move = (1 - zr[:, :h]) * mask[:, t, None]
                if keep:
                    trace[name, t] = (state, zr, new, m[:, 2 * h:])
                state = state + move * (new - state)
                states[:, t, at // 3:at // 3 + h] = state
        hidden = np.tanh(states @ self.w["wa"] + self.w["ba"])
        weight = np.where(mask > 0, hidden @ self.w["va"], -30.0)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logits = pooled @ self.w["wo"] + self.w["bo"]
        return (logits, states, hidden, weight, pooled, trace) if keep else logits

    def backward(self, gates: np.ndarray, mask: np.ndarray, slope: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the gates, given the loss's slope by logit."""
        _, states, hidden, weight, pooled, trace = kept
        h, w = HIDDEN, self.w
        g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "char", "wf", "wb", "bf", "bb")}
        g["wo"], g["bo"] = pooled.T @ slope, slope.sum(keepdims=True)
        d_pooled = slope[:, None] * w["wo"]
        d_weight = np.einsum("nh,nth->nt", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", d_score, hidden)
        d_pre = d_score[:, :, None] * w["va"] * (1 - hidden ** 2)
        g["wa"] = np.einsum("nth,nta->ha", states, d_pre)
        g["ba"] = d_pre.sum((0, 1))
        d_states = d_states + d_pre @ w["wa"].T
        d_gates = np.zeros_like(gates)
        steps = gates.shape[1]
        for name, at, order in (("f", 0, range(steps - 1, -1, -1)), ("b", 3 * h, range(steps))):
            u, carry = w["u" + name], np.zeros((len(gates), h), np.float32)
            for t in order:
                state, zr, new, m_new = trace[name, t]
                z, r = zr[:, :h], zr[:, h:]
                d = carry + d_states[:, t, at // 3:at // 3 + h]
                on = mask[:, t, None]
                d_new = d * (1 - z) * on * (1 - new ** 2)
                d_z = d * -(new - state) * on * z * (1 - z)
                d_r = d_new * m_new * r * (1 - r)
                d_m = np.concatenate([d_z, d_r, d_new * r], 1)
                d_gates[:, t, at:at + 3 * h] = np.concatenate([d_z, d_r, d_new], 1)
                g["u" + name] += state.T @ d_m
                carry = d * (1 - (1 - z) * on) + d_m @ u.T
        return g, d_gates

    def windows(self, codes: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all windows (0 pads), mask, and the document of each window."""
        starts, owners = window_grid(lengths)
        ends = np.cumsum(lengths)[owners]
        at = starts[:, None] + np.arange(WINDOW)
        real = at < ends[:, None]
        padded = np.append(codes, 0)
        return np.where(real, padded[np.minimum(at, len(codes))], 0), real.astype(np.float32), owners


class Scorer:
    """Scores texts, keeping the projected vectors of the words it has met."""

    def __init__(self, network: Network):
        self.network = network
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.table, self.used = np.zeros((4096, 6 * HIDDEN), np.float32), 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        net = self.network
        if net.constant is not None:
            return np.full(len(texts), net.constant)
        if len(self.codes) > CACHED_WORDS:
            self._clear()
        split = [words_of(t) for t in texts]
        flat = [w for s in split for w in s]
        new = list(set(flat).difference(self.codes))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used:self.used + len(part)] = net.projected(part)
            self.codes.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        best = np.full(len(texts), -np.inf)
        rows, mask, owners = net.windows(codes, [len(s) for s in split])
        for at in range(0, len(rows), GROUP):
            logits = net.forward(self.table[rows[at:at + GROUP]], mask[at:at + GROUP])
            np.maximum.at(best, owners[at:at + GROUP], logits)
        return 1 / (1 + np.exp(-np.clip(best, -50, 50)))


def fit(texts: list[str | None], labels: list[int], seed: int = 8) -> Network:
    """Train on whole texts with 0/1 labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network({}, {}, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    seen = [Counter(), Counter()]
    for words, label in zip(split, labels, strict=True):
        seen[int(label)].update(set(words))
    both = seen[0] + seen[1]
    common = [w for w, c in sorted(both.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if c >= MIN_DOCS]
    vocabulary = {w: i for i, w in enumerate(common, 1)}
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {
        "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(PAIRS, CHAR_DIM, scale=0.1),
        "wf": draw(d, 3 * h, scale=0.3), "wb": draw(d, 3 * h, scale=0.3),
        "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "uf": draw(h, 3 * h, scale=0.3), "ub": draw(h, 3 * h, scale=0.3),
        "wa": draw(2 * h, ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32),
        "va": draw(ATTENTION, scale=0.3), "wo": draw(2 * h, scale=0.3), "bo": np.zeros(1, np.float32),
    }
    for word, i in vocabulary.items():
        odds = math.log((seen[1][word] + 0.5) / (n1 + 1)) - math.log((seen[0][word] + 0.5) / (n0 + 1))
        w["word"][i, 0] = max(-2.0, min(2.0, odds / 2))
    net = Network(w, vocabulary)
    distinct = sorted({x for s in split for x in s})
    number = {x: i for i, x in enumerate(distinct, 1)}
    coded = [np.array([number[x] for x in s], np.int64) for s in split]
    distinct = ["", *distinct]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        table = net.projected(distinct).astype(np.float32)
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            codes = np.concatenate([coded[i] for i in docs])
            rows, mask, owners = net.windows(codes, [len(coded[i]) for i in docs])
            logits = np.concatenate([
                net.forward(table[rows[i:i + GROUP]], mask[i:i + GROUP]) for i in range(0, len(rows), GROUP)])
            best = np.lexsort((logits, owners))[np.append(np.flatnonzero(np.diff(owners)), len(owners) - 1)]
            rows, mask = rows[best], mask[best]
            used, back = np.unique(rows, return_inverse=True)
            x, word_rows, _ = net.inputs([distinct[i] for i in used])
            gates = np.concatenate([x @ w["wf"] + w["bf"], x @ w["wb"] + w["bb"]], 1)[back.reshape(rows.shape)]
            kept = net.forward(gates, mask, keep=True)
            slope = ((_sigmoid(kept[0]) - y[docs]) / len(docs)).astype(np.float32)
            grads, d_gates = net.backward(gates, mask, slope, kept)
            d_used = np.zeros((len(used), 6 * h), np.float32)
            np.add.at(d_used, back.ravel(), (d_gates * mask[:, :, None]).reshape(-1, 6 * h))
            grads["wf"], grads["wb"] = x.T @ d_used[:, :3 * h], x.T @ d_used[:, 3 * h:]
            grads["bf"], grads["bb"] = d_used[:, :3 * h].sum(0), d_used[:, 3 * h:].sum(0)
            d_x = d_used[:, :3 * h] @ w["wf"].T + d_used[:, 3 * h:] @ w["wb"].T
            grads["word"], grads["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
            np.add.at(grads["word"], word_rows, d_x[:, :WORD_DIM])
            pairs = [pair_buckets(distinct[i]) for i in used]
            np.add.at(grads["char"], [b for p in pairs for b in p], np.concatenate(
                [np.repeat(v[None] / len(p), len(p), 0) for v, p in zip(d_x[:, WORD_DIM:], pairs, strict=True)]))
            steps += 1
            for k, g in grads.items():  # Adam
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= RATE * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-7)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Network:
    """Fit on the bounded sample of labelled documents described above."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        "_id is not null").distinct()
    picked = None
    for label in (0, 1):
        part = named.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(MAX_PER_CLASS)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(
        F.length("_text") <= MAX_CHARS)
    # The sample has 2 * MAX_PER_CLASS rows at most, so it may be broadcast whatever the input.
    rows = texts.join(F.broadcast(picked), "_id").orderBy("_id", "_text").limit(2 * MAX_PER_CLASS).collect()
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows])


def scorer(network: Network):
    """A column function from text to score."""
    held: list[Scorer] = []

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(network))
        parts = [held[0].scores(part.to_pylist()) for _, part in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def predict(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of the text."""
    out = docs.withColumn("score", scorer(network)(F.col(f"`{text_col}`").cast("string"))).drop(text_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
