"""Secret scans: wide patterns find candidates, a random forest removes the false positives.

Candidates are runs of 12 or more letters, digits and ``_+/=-`` with a digit in them, values of six or
more signs behind ``:`` or ``=``, known key formats, passwords in URLs, and private key blocks. A candidate may
lie inside another: values are also cut at ``/ ? & : @ = # |``, and each part is judged on its own with its own
neighbouring text. Secrets that overlap are reported and masked as one span. The forest (histogram splits on bootstrap
samples, numpy) sees the candidate's length, its character transitions (letters to digits and back, how
ordinary its letter pairs are, entropy), how much of it dictionary words cover, whether it looks like a
path, and the words beside it.

Training takes findings with labels: a table with the columns of ``findings`` and ``label``. Where none
is at hand, ``weak_labels`` labels findings by their form: a known key format, or a random value that a
key word is set to, is a secret; runs of plain digits, of dictionary words and of paths are not, nor are
UUIDs and named digests (``commit``, ``sha256`` and the like before hexadecimal digits) without a key word,
are none either. Other random values are undecided and do not train. So that the forest judges values by
their own form, every random secret trains a second time without the key word before it, and every known
key format without its prefix and key word. The forest sees neither the rule nor the list of formats.

Beside the forest stands one step by form alone (``by_form``): known key formats and passwords in addresses score 1,
UUIDs and named digests without a key word 0. ``judge`` tells for each finding which of the two decided. At most
``MAX_LABELLED`` labelled findings, of at most ``MAX_VALUE`` characters, first in the order of their hash, are fitted, with their
neighbouring text; the forest, its dictionary and its letter pairs come from them. All findings are
scored.

Defined results: null or empty texts have no candidates; the order of findings in a text is by start, the
longer first; a merged span has the highest score of its secrets;
repeated documents are reported each; without labelled findings, or with one class only, the rule of
``weak_labels`` decides. Only the named columns are read; ``redact`` keeps all others.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

MAX_LABELLED = 20_000
MAX_VALUE = 4_096  # longer findings do not train; all are scored
TREES, DEPTH, BINS, LEAF = 25, 8, 32, 3
CONTEXT = 60  # characters kept on each side of a candidate
MASK = "<SECRET>"

_RUN = re.compile(r"[A-Za-z0-9_+/=\-]{12,}")
_SET = re.compile(r"[:=]\s{0,3}[\"']?([^\s\"',;<>]{6,})")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
_KEY_WORD = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|\bpw|secret|token|api[_-]?key|access[_-]?key|credential|auth)[\w-]*[\"']?(?:\s{0,3}[:=]|\s{1,3}is\b:?)\s{0,3}[\"']?$")
_TOLD = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|\bpw|secret|token|api[_-]?key|access[_-]?key)\s{1,3}is\s{1,3}[\"']?([^\s\"',;<>]{6,})")
_KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){0,2}|-----BEGIN")
_SIGN = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ)")
_PREFIX = ("AKIA", "ASIA", "gh", "xox", "sk_live_", "AIza", "eyJ")
_LOGIN = re.compile(r"://[^\s/:@]*:([^\s/@]{6,})@")
_LOGIN_LEFT = re.compile(r"://[^\s/:@]*:$")
_PATH = re.compile(r"://[^\s\"',;<>?#]*")
_FIELD = re.compile(r"&[\w.\-\[\]]{1,64}=")
_PART = re.compile(r"[^/?&:@=#|]{6,}")
_FORM_PART = re.compile(r"(?<=[=])[^?&=#|]{6,}")  # base64 has / in it
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?i)(?:commit|revision|sha-?\d{1,3}|md5|digest|checksum|integrity|etag)[\"']?\s{0,3}[:= ]\s{0,3}[\"']?$")
_HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
_PIECE = re.compile(r"[^\W_]+")
_FINDING = T.StructType([
    *[T.StructField(name, T.LongType()) for name in ("start", "end")],
    *[T.StructField(name, T.StringType()) for name in ("value", "left", "right")],
])


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Spans of candidates in order; a part of a candidate is one as well."""
    if not text:
        return
    found: set[tuple[int, int]] = set()
    if "-----BEGIN" in text:
        found.update(m.span() for m in _BLOCK.finditer(text))
    paths = [m.span() for m in _PATH.finditer(text)] if "://" in text else []
    for m in _RUN.finditer(text):
        while paths and paths[0][1] <= m.start():
            paths.pop(0)
        value = m.group()
        if any(c.isdigit() for c in value):
            # A name that a value is set to is no part of the value.
            cut = value.rfind("=", 0, len(value.rstrip("=")))
            start, end = m.start() + cut + 1, m.end()
            if end - start >= 6:
                if "/" not in value or not paths or start < paths[0][0]:  # of a path only the parts
                    found.add((start, end))
            found.update(_parts(text, m.start(), m.end()))
    for m in _SET.finditer(text):
        start, end = m.span(1)
        if not text.startswith("//", start):  # of an address only the parts
            field = _FIELD.search(text, start, end)
            if not field or field.start() - start >= 6:
                found.add((start, field.start() if field else end))
            elif _KEY_WORD.search(text, max(0, start - CONTEXT), start):
                found.add((start, end))
        found.update(_parts(text, start, end))
    if " is" in text or "\tis" in text:
        found.update((m.start(1), m.end(1) - len(m[1]) + len(m[1].rstrip(".:?)"))) for m in _TOLD.finditer(text) if len(m[1].rstrip(".:?)")) >= 6)
    if "://" in text:
        found.update(m.span(1) for m in _LOGIN.finditer(text))
    if any(p in text for p in _PREFIX):
        found.update(m.span() for m in _KNOWN.finditer(text) if m.group() != "-----BEGIN" and not text[m.start() - 1:m.start()].isalnum())
    yield from sorted(found, key=lambda s: (s[0], -s[1]))


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that may be secrets of their own."""
    for m in itertools.chain(_PART.finditer(text, start, end), _FORM_PART.finditer(text, start, end)):
        if any(c.isdigit() for c in m.group()) or _KEY_WORD.search(text, max(0, m.start() - CONTEXT), m.start()):
            yield m.span()


def scan(text: str | None) -> list[dict]:
    return [
        {"start": s, "end": e, "value": text[s:e], "left": text[max(0, s - CONTEXT):s], "right": text[e:e + CONTEXT]}
        for s, e in candidates(text)
    ]


def login(value: str, left: str, right: str) -> bool:
    """Whether the value is the password of an address, and no variable."""
    return right[:1] == "@" and bool(_LOGIN_LEFT.search(left)) and value[:1] not in "$%{["


def certain(value: str, left: str, right: str) -> bool:
    """A known key format or a password in an address, whether or not the forest has seen one."""
    if value.startswith("-----BEGIN"):
        return "PRIVATE KEY" in value
    return bool(_KNOWN.match(value)) or login(value, left, right)


def rule(value: str, left: str, right: str = "") -> bool:
    """Whether the form alone speaks for a secret."""
    if _KNOWN.match(value) or login(value, left, right):
        return True
    return bool(_KEY_WORD.search(left)) and len(value) >= 8 and not value.isalpha() and not value.isdigit()


def mixed(value: str) -> bool:
    """Whether a run of letters and digits changes between the two like no word or number does."""
    for piece in _PIECE.findall(value):
        digits = [c.isdigit() for c in piece]
        changes = sum(a != b for a, b in zip(digits, digits[1:], strict=False))
        if changes >= 3 or changes and len(piece) >= 12:
            return True
    return False


def plain(value: str, left: str) -> bool:
    """Plain digits, words, paths and names at a host."""
    return value.isdigit() or value.isalpha() or len(set(value)) < 5 or "@" in left[-1:] or not mixed(value)


def harmless(value: str, left: str) -> bool:
    """Random by nature but no secret: UUIDs and digests that are named so, without a key word."""
    named = _DIGEST.search(left) and _HEX.fullmatch(value)
    return bool(named or _UUID.fullmatch(value)) and not rule(value, left)


def by_form(value: str, left: str, right: str) -> float:
    """1 or 0 where the form alone decides, else nan."""
    return 1.0 if certain(value, left, right) else 0.0 if harmless(value, left) else math.nan


@dataclass
class Forest:
    """Trees as arrays (feature, threshold, left, right, share of secrets) and what the features need."""

    trees: list[tuple[np.ndarray, ...]]
    pairs: dict[str, float]
    words: set[str]

    def features(self, values: list[str], lefts: list[str], rights: list[str]) -> np.ndarray:
        return np.array(
            [_features(*x, self.pairs, self.words) for x in zip(values, lefts, rights, strict=True)]
        ).reshape(len(values), -1)

    def scores(self, values: list[str], lefts: list[str], rights: list[str]) -> np.ndarray:
        if not self.trees:
            return np.array([float(rule(*x)) for x in zip(values, lefts, rights, strict=True)])
        form = np.array([by_form(*x) for x in zip(values, lefts, rights, strict=True)], float)
        return np.where(np.isnan(form), self.shares(values, lefts, rights), form)

    def shares(self, values: list[str], lefts: list[str], rights: list[str]) -> np.ndarray:
        """What the trees alone say."""
        rows = self.features(values, lefts, rights)
        total = np.zeros(len(rows))
        for feature, threshold, low, high, share in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                inner = low[node] >= 0
                goes_low = rows[np.arange(len(rows)), feature[node]] <= threshold[node]
                node = np.where(inner, np.where(goes_low, low[node], high[node]), node)
            total += share[node]
        return total / len(self.trees)


def _ordinary(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]{3,20}", text.lower())


def _features(value: str, left: str, right: str, pairs: dict[str, float], words: set[str]) -> list[float]:
    n = len(value)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    shares = np.bincount(kinds, minlength=4) / max(1, len(kinds))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)
    lower = value.lower()
    unusual = [pairs.get(lower[i:i + 2], 8.0) for i in range(n - 1) if lower[i:i + 2].isalpha()]
    counts = np.array(list(Counter(value).values()), float) / max(1, n)
    covered = sum(len(w) for w in _ordinary(value) if w in words) / max(1, n)
    before = left.rstrip("\"' ")
    near = (left[-30:].lower(), right[:30].lower())
    beside = _ordinary(left)[-1:] + _ordinary(right)[:1]
    return [
        math.log1p(n), *shares.tolist(), changes,
        float(np.mean(unusual)) if unusual else 0.0,
        float(-(counts * np.log2(counts)).sum()) if n else 0.0,
        covered,
        float(value.count("/") + value.count(".")) / max(1, n), float(value[:1] in "/.~"),
        float(before[-1:] == "="), float(before[-1:] == ":"), float(left[-1:] in "\"'" and left != ""),
        float(bool(_KEY_WORD.search(left))),
        float(any(k in near[0] or k in near[1] for k in ("pass", "secret", "token", "key", "auth"))),
        float(sum(w in words for w in beside)),
    ]


def fit(values: list[str], lefts: list[str], rights: list[str], labels: list[int], seed: int = 9) -> Forest:
    """A forest on labelled findings; a forest without trees when a class is missing."""
    pair_counts: Counter = Counter()
    word_counts: Counter = Counter()
    for text in (*lefts, *rights):
        found = _ordinary(text)
        word_counts.update(found)
        for word in found:
            pair_counts.update(word[i:i + 2] for i in range(len(word) - 1))
    total = sum(pair_counts.values()) or 1
    pairs = {p: -math.log2(c / total) - 5 for p, c in pair_counts.items()}
    forest = Forest([], pairs, {w for w, c in word_counts.items() if c > 1})
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return forest
    x = forest.features(values, lefts, rights)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    tries = max(2, int(math.sqrt(x.shape[1])) + 1)
    weights = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(TREES):
        rows = rng.choice(len(y), len(y), p=weights)  # balanced bootstrap
        forest.trees.append(_grow(bins, y, rows, edges, tries, rng))
    return forest


def _grow(bins, y, rows, edges, tries, rng) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        number = len(nodes)
        share = float(y[rows].mean())
        nodes.append([0, 0.0, -1, -1, share])
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
            return number
        best = (share * (1 - share) - 1e-9, -1, 0)
        for j in rng.permutation(bins.shape[1])[:tries]:
            size = len(edges[j]) + 1
            n = np.cumsum(np.bincount(bins[rows, j], minlength=size))[:-1].astype(float)
            s = np.cumsum(np.bincount(bins[rows, j], y[rows], minlength=size))[:-1]
            m, t = len(rows) - n, y[rows].sum() - s
            ok = (n >= LEAF) & (m >= LEAF)
            if not ok.any():
                continue
            n, m = np.maximum(n, 1), np.maximum(m, 1)
            loss = np.where(ok, (s * (1 - s / n) + t * (1 - t / m)) / len(rows), np.inf)
            at = int(loss.argmin())
            if loss[at] < best[0]:
                best = (float(loss[at]), int(j), at)
        if best[1] >= 0:
            _, j, at = best
            low = bins[rows, j] <= at
            nodes[number][:2] = [j, float(edges[j][at])]
            nodes[number][2] = add(rows[low], depth + 1)
            nodes[number][3] = add(rows[~low], depth + 1)
        return number

    add(rows, 0)
    table = np.array(nodes)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]


@arrow_udf(T.ArrayType(_FINDING))
def _scan(texts: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([scan(t.as_py()) for t in texts], to_arrow_type(T.ArrayType(_FINDING)))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, start, end, value, and the text to its left and right."""
    return docs.select(F.col(id_col), F.explode(_scan(F.col(text_col).cast("string"))).alias("f")).select(id_col, "f.*")


def weak_label(value: str, left: str, right: str = "") -> int | None:
    """1 for a secret, 0 for what is none by its form, nothing where the form leaves it open."""
    if rule(value, left, right):
        return 1
    return 0 if plain(value, left) or harmless(value, left) else None


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` by the candidate's form; where the form says nothing, no row.

    A random secret has a second row whose ``left`` lacks the key word; that of a known format lacks its prefix, too.
    """
    kind = T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("left", T.StringType()), T.StructField("label", T.IntegerType())]))

    @arrow_udf(kind)
    def label(values: pa.Array, lefts: pa.Array, rights: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for value, left, right in zip(values.to_pylist(), lefts.to_pylist(), rights.to_pylist(), strict=True):
            mine = weak_label(value, left, right)
            rows = [] if mine is None else [{"value": value, "left": left, "label": mine}]
            bare, core = _KEY_WORD.sub("", left), _SIGN.sub("", value) if _KNOWN.match(value) else value
            if mine and (bare != left or core != value) and mixed(core):
                rows.append({"value": core, "left": bare, "label": 1})
            out.append(rows)
        return pa.array(out, to_arrow_type(kind))

    given = found.withColumn("_l", F.explode(label("value", "left", "right")))
    return given.withColumns({"value": F.col("_l.value"), "left": F.col("_l.left"), "label": F.col("_l.label")}).drop("_l")


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> Forest:
    """Fit on at most ``limit`` labelled findings, half of each class where there are as many."""
    order = F.xxhash64("value", "left", "right")
    rows = []
    for label in (0, 1):
        part = labelled.where((F.col("label") == label) & (F.length("value") <= MAX_VALUE)).orderBy(order, "value", "left", "right").limit(limit // 2)
        rows += part.select("value", "left", "right", "label").collect()
    return fit([r["value"] for r in rows], [r["left"] for r in rows], [r["right"] for r in rows],
               [r["label"] for r in rows])


def judge(found: DataFrame, forest: Forest) -> DataFrame:
    """``found`` with ``score``, ``is_secret`` and ``by_form``: whether the form alone decided."""

    @pandas_udf(T.DoubleType())
    def score(values: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(list(values), list(lefts), list(rights)), dtype="float64")

    @pandas_udf(T.BooleanType())
    def formal(values: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([not math.isnan(by_form(*x)) for x in zip(values, lefts, rights, strict=True)], dtype=bool)

    return found.withColumns({
        "score": score("value", "left", "right"), "by_form": formal("value", "left", "right"),
    }).withColumn("is_secret", F.col("score") >= 0.5)


def secrets_of(text: str | None, forest: Forest) -> list[dict]:
    """Start, end, value and score of the secrets of a text; overlapping ones are one."""
    found = scan(text)
    out: list[dict] = []
    if not found:
        return out
    scores = forest.scores(*[[f[k] for f in found] for k in ("value", "left", "right")])
    for f, score in zip(found, scores.tolist(), strict=True):
        if score < 0.5:
            continue
        if out and f["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], f["end"])
            out[-1]["score"] = max(out[-1]["score"], score)
        else:
            out.append({"start": f["start"], "end": f["end"], "score": score})
    return [{**o, "value": text[o["start"]:o["end"]]} for o in out]


def report(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret: id, start, end, value, score."""
    kind = T.ArrayType(T.StructType([*_FINDING.fields[:3], T.StructField("score", T.DoubleType())]))

    @arrow_udf(kind)
    def secret(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([secrets_of(t.as_py(), forest) for t in texts], to_arrow_type(kind))

    return docs.select(F.col(id_col), F.explode(secret(F.col(text_col).cast("string"))).alias("s")).select(id_col, "s.*")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; other texts stay as they are."""

    @arrow_udf(T.StringType())
    def hide(texts: pa.Array) -> pa.Array:
        out = []
        for cell in texts:
            text = cell.as_py()
            found = secrets_of(text, forest)
            if found:
                parts, at = [], 0
                for f in found:
                    parts += [text[at:f["start"]], mask]
                    at = f["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, hide(F.col(f"`{text_col}`").cast("string")))
