"""Phrases of words that stand together more often than their parts explain, from one n-gram count.

Only the longest windows are counted: at each word the word itself and the four *lead*
columns after it, empty past the end of its piece. A phrase of k words occurs as often as
windows begin with it, so Spark's ROLLUP over the window's columns sums the windows to all
shorter phrases, the words and the total of each language. No n-gram is exploded by itself.

Most windows are rare in all but their first columns. A window therefore ends (is padded)
before the first word, pair or triple of neighbouring words that occurs less than
``least`` times: no phrase with such a part can be a candidate, and phrases without one
still begin all of their windows, so the counts of all candidates, of their parts and of
each language stay exact. Rare parts are found by counting hashes over the whole corpus,
words first, then pairs of frequent words, then triples of frequent pairs. Those that
reach ``least`` set a bit in a map of ``MAP_BITS`` bits, which is what tasks get. Parts
that share a bit or a hash only make a window longer than it need be. The map has a
fixed size, whatever the corpus.

Words lie between spaces and tabs inside of pieces, pieces between any of ``.,;:!?`` and
\\x0A-\\x0D; A-Z are lower-cased. Null texts have no words, a null language counts as
``und``, repeated rows count each time, other columns and null ids are not read. All
arithmetic is on decimals that hold the products whole. Ties of score go to the larger
count, then to the smaller phrase in byte order. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import save, whole_text
from trajlake.llm.words import mix64

LONGEST = 5  # words in a phrase
LEAST = 100  # occurrences of a candidate
SCALE = 1000
TOP = 2000
MAP_BITS = 1 << 28  # 32 MB
HASH_BITS = 40
SLOT_SHIFT = HASH_BITS - 28  # the top bits of a hash are its place in the map
PRUNED = 3  # windows are cut at rare parts of up to so many words
SLICE_BYTES = 1 << 20
HASHES_KEPT = 1 << 20  # hashes a task sums up before it hands them on
WINDOWS_KEPT = 1 << 19  # windows a task sums up before it hands them on

BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 between words, 2 between pieces
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


# Words of texts.


class Sliced:
    """Words of some bytes: distinct ones, the code of each, and whether the next one follows in the same piece."""

    def __init__(self, raw: np.ndarray, text_starts: np.ndarray) -> None:
        data = _LOWER[raw]
        kind = _KIND[data]
        solid = kind == 0
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = text_starts[(text_starts > 0) & (text_starts < len(data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.start = start
        # A break lies between two words if more breaks or text starts lie before the second.
        parted = (kind == 2).astype(np.int32)
        parted[inner] += 1
        level = np.cumsum(parted, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        self.follows = np.zeros(len(start), bool)
        self.follows[:-1] = level[1:] == level[:-1]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        body = pa.py_buffer(np.ascontiguousarray(data[solid]))
        text = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), body)
        coded = text.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        _, offsets, body = self.words.buffers()
        edges = np.frombuffer(offsets, np.int32)[: len(self.words) + 1].astype(np.int64)
        lengths = np.diff(edges)
        place = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
        with np.errstate(over="ignore"):
            weights = np.cumprod(np.full(lengths.max(), _BASE, np.uint64))
            terms = (np.frombuffer(body, np.uint8)[: edges[-1]] + np.uint64(1)) * weights[place]
            return mix64(np.add.reduceat(terms, edges[:-1]))


def _cuts(raw: np.ndarray, text_starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` bytes that end where a text or a piece ends."""
    first = 0
    while first < len(raw):
        last = min(first + most, len(raw))
        while last < len(raw):
            breaks = np.flatnonzero(_KIND[raw[first:last]] == 2)
            text = int(text_starts[np.searchsorted(text_starts, last, side="right") - 1])
            found = max(first + int(breaks[-1]) + 1 if len(breaks) else 0, text)
            if found > first:
                last = found
                break
            last = min(last + most, len(raw))  # one piece is longer than this
        yield first, last
        first = last


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Sliced]:
    """The words of a column of texts, some megabytes at a time."""
    texts = texts.cast(pa.large_binary())
    if not len(texts) or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    for first, last in _cuts(raw, starts, most):
        here = starts[np.searchsorted(starts, first) : np.searchsorted(starts, last)]
        yield Sliced(raw[first:last], here - first)


def _is_frequent(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(SLOT_SHIFT)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _parts(sliced: Sliced, lang: str, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to ``most``: the words at which k words follow each other whose shorter parts are all in the map, and their hashes."""
    import xxhash

    word = mix64(sliced.hashes() ^ np.uint64(xxhash.xxh3_64_intdigest(lang)))[sliced.codes]
    short = np.uint64(64 - HASH_BITS)
    whole = word
    places = np.arange(len(word))
    for k in range(1, most + 1):
        yield places, whole[places] >> short
        if k == most:
            return
        frequent = np.zeros(len(word) + 1, bool)
        frequent[places] = _is_frequent(bits, whole[places] >> short)
        places = places[frequent[places] & frequent[places + 1]]
        places = places[sliced.follows[places + k - 1]]
        with np.errstate(over="ignore"):
            longer = np.zeros_like(whole)
            longer[places] = mix64(whole[places] * np.uint64(3) + mix64(word[places + k]))
        whole = longer


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch["lang"]
    for lang in langs.unique().to_pylist():
        yield lang, batch["text"].filter(pc.equal(langs, lang))


def part_counts(texts: DataFrame, size: int, bits: Broadcast) -> DataFrame:
    """``(part, n)``: hashes of ``size`` neighbouring words whose shorter parts are in the map, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            part, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(n.astype(np.int64))], ["part", "n"])

        for batch in batches:
            for lang, column in _by_lang(batch):
                for sliced in slices(column):
                    *_, (_, hashes) = _parts(sliced, lang, bits.value, size)
                    kept.append(hashes)
                    if sum(map(len, kept)) >= HASHES_KEPT:
                        yield summed()
        if kept:
            yield summed()

    return texts.mapInArrow(run, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))


def mark_frequent(bits: np.ndarray, counts: DataFrame, least: int) -> None:
    """Set the bits of the parts that occur ``least`` times. Rows that come to the driver are parts of a map, at most ``MAP_BITS`` in all."""
    # The bitmap functions count from 1.
    slot = F.shiftrightunsigned("part", SLOT_SHIFT) + 1
    frequent = counts.where(F.col("n") >= least).select(slot.alias("slot"))
    pieces = frequent.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for row in pieces.collect():
        at = (row.bucket - 1) * len(row.bits)
        bits[at : at + len(row.bits)] |= np.frombuffer(row.bits, np.uint8)


def frequent_map(texts: DataFrame, least: int, pruned: int = PRUNED) -> Broadcast:
    """The map of frequent parts of up to ``pruned`` words."""
    context = texts.sparkSession.sparkContext
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    shared = context.broadcast(None)  # words have no shorter parts
    for size in range(1, pruned + 1):
        mark_frequent(bits, part_counts(texts, size, shared), least)
        shared.unpersist()
        shared = context.broadcast(bits)
    return shared


def _windows(sliced: Sliced, lang: str, bits: np.ndarray, longest: int, pruned: int) -> pa.RecordBatch:
    """Distinct windows of a slice with their counts; columns past the end of a window are empty."""
    n = len(sliced.codes)
    pad = len(sliced.words)
    columns = []
    alive = np.ones(n, bool)
    parts = _parts(sliced, lang, bits, pruned)
    for k in range(longest):
        if k < pruned:
            places, hashes = next(parts)
            frequent = np.zeros(n + longest, bool)
            frequent[places] = _is_frequent(bits, hashes)
        # The last (up to ``pruned``) words of the window so far.
        ahead = max(0, k + 1 - pruned)
        alive = alive & frequent[ahead : ahead + n]
        at = np.flatnonzero(alive)
        lead = np.full(n, pad, np.int64)
        lead[at] = sliced.codes[at + k]
        columns.append(lead)
    # Distinct windows: columns are joined one by one to dense numbers of the windows so far.
    number, count_of = columns[0], pad + 1
    for lead in columns[1:]:
        longer = lead != pad
        distinct, dense = np.unique(number[longer] * (pad + 1) + lead[longer], return_inverse=True)
        number = number.copy()
        number[longer] = count_of + dense
        count_of += len(distinct)
    counts = np.bincount(number, minlength=count_of)
    sample = np.zeros(count_of, np.int64)
    sample[number] = np.arange(n)
    used = np.flatnonzero(counts)
    names = pa.concat_arrays([sliced.words, pa.array([""], sliced.words.type)])
    taken = [names.take(pa.array(c[sample[used]])) for c in columns]
    arrays = [pa.array([lang] * len(used), pa.string()), *taken, pa.array(counts[used].astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, ["lang", *[f"w{k + 1}" for k in range(longest)], "n"])


def phrase_counts(texts: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """``(lang, words, n)``: counts of words and phrases that occur ``least`` times, and of all words together (no words).

    ``texts`` has columns ``lang`` and ``text``, neither null.
    """
    bits = frequent_map(texts, least)
    pruned = PRUNED
    columns = [f"w{k + 1}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def summed() -> pa.Table:
            keys = ["lang", *columns]
            table = pa.Table.from_batches(kept).group_by(keys).aggregate([("n", "sum")])
            return table.select([*keys, "n_sum"]).rename_columns([*keys, "n"])

        for batch in batches:
            for lang, column in _by_lang(batch):
                for sliced in slices(column):
                    kept.append(_windows(sliced, lang, bits.value, longest, pruned))
                    if sum(map(len, kept)) >= WINDOWS_KEPT:
                        table = summed()
                        kept = table.to_batches()
                        # Windows of many slices are summed as long as that makes them fewer.
                        if 2 * len(table) > WINDOWS_KEPT:
                            yield from kept
                            kept = []
        if kept:
            yield from summed().to_batches()

    schema = ", ".join(["lang string", *[f"{c} string" for c in columns], "n long"])
    windows = texts.mapInArrow(run, schema).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    rolled = windows.rollup("lang", *columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("_left"))
    # grouping_id has one bit per column summed away. Sums that end in a pad are none of a
    # phrase; this filter is of grouping columns only, so they are left out before the shuffle.
    size = F.lit(longest) - F.bit_count("_left")
    last = F.coalesce(*[F.col(c) for c in reversed(columns)], F.lit("."))
    sums = rolled.where((F.bit_count("_left") <= longest) & (last != ""))
    found = F.slice(F.array(*columns), F.lit(1), size.cast("int"))
    return sums.where((F.col("n") >= least) | (size == 0)).select("lang", found.alias("words"), "n")


def candidates(counts: DataFrame, least: int, scale: int = SCALE) -> DataFrame:
    """Phrases of two words or more with their lowest cut: ``(lang, phrase, words, a, l, r, n, score)``."""
    totals = counts.where(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    named = counts.where((F.size("words") > 0) & (F.col("n") >= least)).select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("n").alias("a"))
    cuts = F.sequence(F.lit(1), F.size("words") - 1)
    cut = named.where(F.size("words") > 1).select("lang", "phrase", "words", "a", F.explode(cuts).alias("k"))
    cut = cut.select(
        "*",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("_first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("_rest"),
    )
    first = named.select("lang", F.col("phrase").alias("_first"), F.col("a").alias("l"))
    rest = named.select("lang", F.col("phrase").alias("_rest"), F.col("a").alias("r"))
    # A language has one total, so this is one row per language.
    scored = cut.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).join(totals, "lang")
    whole = "decimal(18, 0)"
    above = F.col("a").cast(whole) * F.col("total").cast(whole) * F.lit(scale).cast("decimal(4, 0)")
    scored = scored.withColumn("_above", above).withColumn("_below", F.col("l").cast(whole) * F.col("r").cast(whole))
    scored = scored.withColumn("score", F.expr("_above div _below").cast("long"))
    lowest = F.min(F.struct("score", "k", "l", "r", "total")).alias("low")
    by_phrase = scored.groupBy("lang", "phrase").agg(lowest, F.first("words").alias("words"), F.first("a").alias("a"))
    return by_phrase.select("lang", "phrase", "words", "a", "low.l", "low.r", F.col("low.total").alias("n"), "low.score")


def without_parts(phrases: DataFrame, share: int = 100) -> DataFrame:
    """Phrases that lie in no longer one with at least ``share`` percent of their count."""
    size = F.size("words")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")),
        )
    )
    parts = phrases.where(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("_longer"))
    most = parts.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    inside = phrases.join(most, ["lang", "phrase"], "left")
    return inside.where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).drop("_longer")


def mined(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of each language's ``top`` phrases, or of all."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    counts = save(phrase_counts(texts, least), "phrase-counts")
    kept = without_parts(save(candidates(counts, least), "phrases"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = kept.withColumn("rank", place)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
