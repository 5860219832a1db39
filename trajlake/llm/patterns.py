"""Packing token documents into fixed-length sequences by length patterns.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver.
There, patterns of up to three lengths that fill a sequence exactly are enumerated,
non-negative least squares says how often to repeat each, the repeats are rounded
down to what the histogram still holds, and the documents left over are packed best
fit from the longest down, as counts. The plan, a table of at most a few rows per
length and pattern, then gives the n-th piece of a length its place.

Nulls: a null text is an empty one; a null doc_id is kept. Every document has an end
id, so none is empty. A document longer than a sequence is cut into whole sequences,
its first piece being the shorter one. Repeated rows are packed each for itself, ties
are broken by task and row. An empty table gives no rows. Other columns are ignored.
"""

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts, save
from trajlake.llm.tokenise import encoder

PIECES = (
    "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task int, nth long, row long"
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Cut every document's ids into pieces of at most ``capacity``.

    ``nth`` numbers the pieces of one length within a task; ``ids`` are little-endian
    unsigned 32-bit integers. ``row`` numbers a task's documents.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([end_id], "<u4").tobytes()
        coder, task, seen, row = encoder(tokenizer), TaskContext.get().partitionId(), Counter(), 0
        names = [x.split()[0] for x in PIECES.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(text.as_py()) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, piece, a, b - a, part, zlib.crc32(part), task, seen[b - a], row))
                    seen[b - a] += 1
                    held += len(part)
                row += 1
                if held > 16 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return ids_and_texts(docs).mapInArrow(cut_up, PIECES)


@dataclass
class Group:
    """``repeat`` sequences, each holding documents of the given lengths."""

    lengths: tuple[int, ...]
    repeat: int


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of two or three present lengths that add up to ``capacity``; zeros pad pairs."""
    here = np.zeros(capacity + 1, bool)
    here[present[present <= capacity]] = True
    found = []
    for a in np.flatnonzero(here)[::-1]:
        a = int(a)
        if a == capacity:
            continue
        rest = capacity - a
        if rest <= a and here[rest]:
            found.append(np.array([[a, rest, 0]]))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        if len(b):
            b = b[here[b] & here[rest - b]]
            found.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by accelerated projected gradient.

    Long lengths weigh more: short pieces left over find a place easily.
    """
    n = len(patterns)
    if not n:
        return np.zeros(0)
    size = len(histogram)
    weight = np.arange(size) / (size - 1.0) + 0.1
    weight[0] = 0.0
    flat = patterns.ravel()

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), minlength=size)

    def transposed(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[patterns].sum(axis=1)

    # The largest eigenvalue by power iteration gives the step.
    v = np.ones(n)
    scale = 1.0
    for _ in range(30):
        v = transposed(weight * product(v))
        scale = float(np.linalg.norm(v)) or 1.0
        v /= scale
    x = np.zeros(n)
    y, momentum = x, 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, y - transposed(weight * (product(y) - histogram)) / (1.05 * scale))
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = nxt + (momentum - 1) / following * (nxt - x)
        x, momentum = nxt, following
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[Group]:
    """Groups of equal sequences that hold exactly the pieces of the histogram (counts by length)."""
    left = histogram.astype(np.int64).copy()
    groups = []
    if left[capacity]:
        groups.append(Group((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    repeats = fit_repeats(patterns, left.astype(float))
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 1:
            break
        lengths = [int(x) for x in patterns[i] if x]
        need = Counter(lengths)
        count = min(int(repeats[i]), *(int(left[x]) // m for x, m in need.items()))
        if count > 0:
            groups.append(Group(tuple(lengths), count))
            for x, m in need.items():
                left[x] -= m * count
    return groups + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[Group]:
    """Pack counts of lengths best fit from the longest down: each into the least free space that takes it."""
    open_by_free: dict[int, list[Group]] = defaultdict(list)
    free_sizes = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fitting = np.flatnonzero(free_sizes[length:])
            if not len(fitting):
                each = capacity // length
                full, rest = divmod(count, each)
                for lengths, repeat in (((length,) * each, full), ((length,) * rest, 1)):
                    if repeat and lengths:
                        free = capacity - length * len(lengths)
                        open_by_free[free].append(Group(lengths, repeat))
                        free_sizes[free] = True
                count = 0
                break
            free = length + int(fitting[0])
            group = open_by_free[free].pop()
            if not open_by_free[free]:
                free_sizes[free] = False
            each = min(free // length, count)
            used = min(group.repeat, count // each)
            if used < group.repeat:
                open_by_free[free].append(Group(group.lengths, group.repeat - used))
                free_sizes[free] = True
            now = free - each * length
            open_by_free[now].append(Group(group.lengths + (length,) * each, used))
            free_sizes[now] = True
            count -= used * each
    return [g for groups in open_by_free.values() for g in groups]


def places(groups: list[Group]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, last, sequence, offset): pieces first <= n < last of a length go to sequence + n - first."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for g in groups:
        offset = 0
        for length in g.lengths:
            rows.append((length, taken[length], taken[length] + g.repeat, sequence, offset))
            taken[length] += g.repeat
            offset += length
        sequence += g.repeat
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; ``ids`` holds each piece's tokens.

    The pieces are written once. Their number within a length is the count of the
    tasks before plus the number within the task, so no length is sorted or gathered.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row per length
        histogram[length] = n
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = places(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)]
    # By length, arrays of steps; their number is bounded by lengths and patterns, not by documents.
    steps: dict[int, list[tuple]] = defaultdict(list)
    for length, first, last, sequence, offset in rows:
        steps[length].append((first, last, sequence, offset))
    spots = spark.createDataFrame(
        [(k, *map(list, zip(*sorted(v)))) for k, v in steps.items()],
        "length long, first array<long>, last array<long>, sequence array<long>, place array<long>",
    )
    numbered = cut.join(bases, ["length", "task"]).withColumn("_n", F.col("base") + F.col("nth"))
    found = numbered.join(F.broadcast(spots), "length").withColumn(
        "_i", F.expr("size(first) - size(filter(first, x -> x > _n)) - 1")
    )
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.expr("sequence[_i]") + F.col("_n") - F.expr("first[_i]")).alias("sequence_id"),
        F.expr("place[_i]").alias("offset"),
        "ids",
    )

