"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the model is a table of one number per bin
for each feature and, for a few pairs of features, one per pair of bins. The tables
come from cyclic boosting: round after round each feature in turn gets a shallow tree
on the residuals of all the others. A score is the sum of the looked-up numbers, so
rows are scored by vectorised additions.

Features come from the text alone. The labelled rows that the model is fitted on are
bounded by ``SAMPLE_ROWS``, taken by the lowest hash of their id; each takes some 200
bytes on the driver. Every text gets its features and its score.

Nulls: a null text is an empty one, a null doc_id is scored but never labelled; labels
other than 0 and 1 are left out, and of several labels of a document the lowest counts.
Without labels of both kinds the score is the share of label 1 (0.5 without any).
Repeated rows get the same score. A text of any length is read whole. An empty table
gives no rows. Other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts, save, small, whole_text
from trajlake.llm.words import find_words, text_slices

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
FEW = 1_000_000  # ids that may be broadcast
SLICE_BYTES = 1 << 19  # text bytes measured at once: a byte takes some 60 for a while, in each worker of an executor
SLICE_ROWS = 1024  # and texts, whose histograms take 2 KB each, several times

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_word", "space", "newline", "upper", "lower", "digit", "comma_period",
    "mark", "other_sign", "high_byte", "byte_entropy", "distinct_words", "top_word", "repeat_next", "distinct_lines",
    "line_words", "short_words", "end_sign_words",
)


def features_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`FEATURES` for each text; texts are the bytes between the offsets."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    size = np.diff(offsets).astype(float)
    histogram = np.bincount(text_of * 256 + raw, minlength=256 * n).reshape(n, 256).astype(float)
    share = histogram / np.maximum(size, 1)[:, None]
    letters = np.arange(256)
    word_like = ((letters >= 48) & (letters < 58)) | ((letters >= 65) & (letters < 91)) | ((letters >= 97) & (letters < 123))
    w = find_words(raw, offsets)
    counts = w.counts().astype(float)
    per = np.maximum(counts, 1)
    length = (w.end - w.start).astype(float)
    mean = lambda x: np.bincount(w.text, x, minlength=n) / per
    longest = np.zeros(n)
    np.maximum.at(longest, w.text, length)
    hashes = w.hashes()
    order = np.lexsort((hashes, w.text))
    t, h = w.text[order], hashes[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(t)))
    top = np.zeros(n)
    np.maximum.at(top, t[first], runs.astype(float))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.text[1:] == w.text[:-1])
    # Lines: a hash of the words in each, told apart by the text and the newlines before it.
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[w.start] + w.text
    start = np.ones(len(line), bool)
    start[1:] = (line[1:] != line[:-1]) | (w.text[1:] != w.text[:-1])
    place = np.flatnonzero(start)
    if len(place):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(hashes * (np.uint64(2) * np.arange(len(hashes), dtype=np.uint64) - np.uint64(2) * np.repeat(place.astype(np.uint64), np.diff(np.append(place, len(line)))) + np.uint64(1)), place)
        line_text = w.text[place]
        pairs = np.unique(np.stack([line_text.astype(np.uint64), total], axis=1), axis=0)[:, 0].astype(np.int64)
        lines = np.bincount(line_text, minlength=n)
        distinct_lines = np.bincount(pairs, minlength=n) / np.maximum(lines, 1)
    else:
        lines, distinct_lines = np.zeros(n), np.zeros(n)
    last = raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    end_sign = ~word_like[last] & (last < 128) & (last != 44) & (last != 46)
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    columns = [
        np.log1p(size),
        np.log1p(counts),
        mean(length),
        longest,
        share[:, 32],
        share[:, 10],
        share[:, 65:91].sum(axis=1),
        share[:, 97:123].sum(axis=1),
        share[:, 48:58].sum(axis=1),
        share[:, [44, 46]].sum(axis=1),
        share[:, [33, 34, 39, 40, 41, 45, 58, 59, 63]].sum(axis=1),
        share[:, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]].sum(axis=1),
        share[:, 128:].sum(axis=1),
        entropy,
        np.bincount(t[first], minlength=n) / per,
        top / per,
        mean(same),
        distinct_lines,
        counts / np.maximum(lines, 1),
        mean((length <= 3).astype(float)),
        mean(end_sign.astype(float)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def feature_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows ``[first, last)`` of ``texts`` and their features, in slices of bounded size (one text at least)."""
    for start in range(0, len(texts), SLICE_ROWS):
        for first, last, raw, offsets in text_slices(texts.slice(start, SLICE_ROWS), SLICE_BYTES):
            yield start + first, start + last, features_of(raw, offsets)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x`` (binary, float32 values in the order of :data:`FEATURES`) for each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, rows in feature_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([x.tobytes() for x in rows], pa.binary())],
                    ["doc_id", "x"],
                )

    return ids_and_texts(docs).mapInArrow(measure, "doc_id long, x binary")


@dataclass
class Model:
    """Bin edges and lookup tables; ``score`` adds the numbers of a row's bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in self.pairs.items():
            a = np.searchsorted(self.pair_edges[i], x[:, i], side="right")
            total += table[a, np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def tree_step(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Step of a tree of the given depth on ordered bins: gradient and curvature sums in, a value per bin out."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
    gain[(left_h < 0.5) | (right_h < 0.5)] = -1
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + 1):
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([tree_step(g[:cut], h[:cut], depth - 1), tree_step(g[cut:], h[cut:], depth - 1)])


def grid_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best split into four cells, first by row, then each part by column; also its gain."""
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        step, gain = np.zeros_like(g), 0.0
        for part in (slice(None, cut), slice(cut, None)):
            pg, ph = g[part].sum(axis=0), h[part].sum(axis=0)
            values = tree_step(pg, ph, 1)
            step[part] = values
            gain += float((values * pg - 0.5 * values**2 * ph).sum())
        if gain > best:
            best, out = gain, step
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 40) -> Model:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Model(base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n, k = x.shape
    model.edges = [_edges(x[:, j], BINS) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(k)]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            if len(model.tables[j]) < 2:
                continue
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * tree_step(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), 2)
            model.tables[j] += step
            total += step[bins[j]]
    # Pairs whose best four-cell split explains most of what the single tables leave.
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(k)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell, cells = coarse[i] * size[j] + coarse[j], size[i] * size[j]
        shape = (size[i], size[j])
        return np.bincount(cell, g, cells).reshape(shape), np.bincount(cell, h, cells).reshape(shape)

    gains = {(i, j): grid_step(*grids(i, j))[1] for i in range(k) for j in range(i + 1, k) if size[i] > 1 and size[j] > 1}
    for i, j in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]:
        model.pairs[i, j] = np.zeros((size[i], size[j]))
    for _ in range(pair_rounds):
        for i, j in model.pairs:
            step = rate * grid_step(*grids(i, j))[0]
            model.pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def training_ids(labels: DataFrame, column: str = "quality", modulus: int = 3, held: int = 1) -> DataFrame:
    """``doc_id`` and ``y`` of the labels that may be learned from."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )


def learn(measured: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 3, held: int = 1, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, none of which has crc32(doc_id) mod ``modulus`` = ``held``."""
    known = training_ids(labels, column, modulus, held)
    sample = (
        measured.join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x")
        .limit(rows)
        .select("x", "y")
        .collect()
    )
    x = np.array([np.frombuffer(r.x, np.float32) for r in sample]).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([r.y for r in sample], float))


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with ``score`` double."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(x), np.float32).reshape(len(x), len(FEATURES))
        return pd.Series(model.score(rows))

    return measured.withColumn("score", score("x"))


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """``doc_id``, ``x`` and ``score`` of every row of ``docs``."""
    measured = save(features(docs), "features")
    return apply(measured, learn(measured, labels, column))


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns.

    The model is fitted first, on the features of the labelled documents; the rows are
    then scored where they stand, so no text is joined or moved.
    """
    model = learn(features(docs.join(small(training_ids(labels, column), FEW), "doc_id", "left_semi")), labels, column)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [x for _, _, x in feature_slices(pa.array(texts, pa.string()))]
        return pd.Series(model.score(np.concatenate(rows)) if rows else np.zeros(0))

    return docs.where(score(whole_text()) >= 0.5)
