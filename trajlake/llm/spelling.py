"""Spelling variants: words one edit apart, found with a bit-sliced position index.

For a set of words of one length the index keeps, per (position, letter), a bitset with
one bit per word: the words that have that letter there. A word is looked up letter by
letter. Two bitsets follow all indexed words at once: those that agree so far, and those
that differ so far by exactly one edit. A letter in place ANDs both with the bitset at
its own position; a replaced letter moves words of the first set, at letters they do
not have, to the second; an inserted letter of theirs is read at the next position.

No task indexes the whole vocabulary. Two words one edit apart agree before it and after
it, so they share their first or their last half (of the shorter length). Each word goes
to the groups of its halves; groups with more than ``TILE`` words are split by the same
rule into those of a longer common start and those of a longer common end, until one free
letter is left, where a group has at most as many words as there are choices of it. Small
groups of one length share an index. A pair of words lies in several groups, but counts
only in the one whose free part holds the first place where the two differ, so each
pair is found exactly once.

Counts of words are sums over all documents, joined before they are shuffled. Null texts
have no words, a null id counts as an empty one, repeated rows count each time, no other
column is read. Among near words with the same count the smallest in code-point order is
taken. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]"
LEAST_LENGTH = 5
LEAST_COUNT = 3
TYPO_PERIOD = 97  # one (document, word) in so many loses a letter
TILE = 2048  # words per index


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, period: int = TYPO_PERIOD) -> DataFrame:
    """``(word, n)`` over all documents: runs of letters, A-Z in lower case.

    A run whose crc32 with its document's id is divisible by ``period`` loses the letter
    at the crc32 modulo its length.
    """
    lowered = ids_and_texts(docs).select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))
    # Losing a letter makes no run longer, so shorter runs never count.
    found = F.regexp_extract_all("text", F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    runs = lowered.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % period == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


# Groups of words that may be one edit apart. ``size`` is the shorter length; the first
# ``head`` and the last ``tail`` letters of a group's words are the same.


def _key() -> Column:
    start = F.substring("word", F.lit(1), F.col("head"))
    end = F.expr("right(word, tail)")
    return F.xxhash64("size", "head", "tail", start, end)


def _free() -> Column:
    return F.col("size") - F.col("head") - F.col("tail")


def _halves(groups: DataFrame) -> DataFrame:
    """Each row twice: in the group of a longer common start, and in that of a longer common end."""
    half = F.floor(_free() / 2).cast("int")
    parts = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + _free() - half).alias("tail")),
    )
    rows = groups.select("word", "n", "size", F.explode(parts).alias("part")).select("word", "n", "size", "part.*")
    return rows.withColumn("key", _key())


def groups(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """``(word, n, size, head, tail, key)``: the groups each word lies in, none larger than ``tile`` where it can be split."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda size: size > 0)
    whole = vocabulary.select("word", "n", F.explode(sizes).alias("size")).select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    level = save(_halves(whole), "spelling-groups")
    parts = []
    while True:
        large = level.where(_free() > 1).groupBy("key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > tile).select("key")
        large = save(large, "spelling-large")
        if large.isEmpty():
            parts.append(level)
            break
        parts.append(level.join(large, "key", "left_anti"))
        level = save(_halves(level.join(large, "key", "left_semi")), "spelling-groups")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The index.


class PositionIndex:
    """Bitsets per (position, letter) over words of one length, given as a matrix of letter codes."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letters = letters
        self.n_words, self.length = letters.shape
        self.blocks = -(-self.n_words // 64)

    def at(self, position: int, queries: np.ndarray) -> np.ndarray:
        """For each queried letter the bitset of the words that have it at ``position``."""
        column = self.letters[:, position]
        asked, where = np.unique(queries, return_inverse=True)
        bits = np.zeros((len(asked), self.blocks * 8), np.uint8)
        packed = np.packbits(column[None, :] == asked[:, None], axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        return bits.view(np.uint64)[where]

    def all_words(self, n_queries: int) -> np.ndarray:
        row = np.zeros(self.blocks * 8, np.uint8)
        packed = np.packbits(np.ones(self.n_words, bool), bitorder="little")
        row[: len(packed)] = packed
        return np.repeat(row.view(np.uint64)[None, :], n_queries, axis=0)

    def replaced(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs of equal length that differ in exactly one letter."""
        same = self.all_words(len(queries))
        once = np.zeros_like(same)
        for i in range(self.length):
            here = self.at(i, queries[:, i])
            once &= here
            once |= same & ~here
            same &= here
        return _members(once)

    def inserted(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs where the word is the query with one more letter."""
        same = self.all_words(len(queries))
        once = np.zeros_like(same)
        for i in range(self.length - 1):
            once |= same
            once &= self.at(i + 1, queries[:, i])
            same &= self.at(i, queries[:, i])
        return _members(once | same)


def _members(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    octets = bits.view(np.uint8)
    row, octet = np.nonzero(octets)
    flags = np.unpackbits(octets[row, octet][:, None], axis=1, bitorder="little")
    which, bit = np.nonzero(flags)
    return row[which], octet[which] * 8 + bit


def _letters(words_: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer("".join(words_).encode("utf-32-le"), np.uint32).reshape(len(words_), length)


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def near_in(rows: pa.Table, tile: int = TILE) -> pa.Table:
    """``(word, near, near_n)`` both ways, of group rows of one size, each pair in its own group only."""
    size = rows["size"][0].as_py()
    is_short = pc.equal(pc.utf8_length(rows["word"]), size)
    short, long = rows.filter(is_short), rows.filter(pc.invert(is_short))
    word, long_word = (np.array(part["word"].to_pylist(), object) for part in (short, long))
    (n, key), (long_n, long_key) = ([part[c].to_numpy() for c in ("n", "key")] for part in (short, long))
    letters, longer = _letters(word, size), _letters(long_word, size + 1)
    begin, tail = short["head"].to_numpy(), short["tail"].to_numpy()
    stop = np.where(tail == 0, size + 1, size - tail)
    of_short, of_long = PositionIndex(letters), PositionIndex(longer)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(word), tile):
        asked = letters[first : first + tile]
        i, j = of_short.replaced(asked)
        i = i + first
        place = _first_difference(letters[i], letters[j])
        own = (key[i] == key[j]) & (place >= begin[i]) & (place < stop[i])
        found.append((word[i[own]], word[j[own]], n[j[own]]))
        i, j = of_long.inserted(asked)
        i = i + first
        place = _first_difference(letters[i], longer[j][:, :size])
        own = (key[i] == long_key[j]) & (place >= begin[i]) & (place < stop[i])
        i, j = i[own], j[own]
        found += [(word[i], long_word[j], long_n[j]), (long_word[j], word[i], n[i])]
    columns = [np.concatenate([f[c] for f in found] or [np.empty(0, object)]) for c in range(3)]
    types = (pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["word", "near", "near_n"])


def near_pairs(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """``(word, near, near_n)``: for each word every word exactly one edit away, once."""
    placed = groups(vocabulary, tile)
    # One row per length of words: how many indexes its groups are dealt to.
    deals = placed.groupBy("size").agg(F.ceil(F.count("*") / tile).alias("_indexes"))
    dealt = placed.join(deals, "size").withColumn("_index", F.pmod("key", "_indexes"))
    return dealt.groupBy("size", "_index").applyInArrow(lambda rows: near_in(rows, tile), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last form along the chain, the word itself where it has none.

    Every step at least doubles the count, so chains are short; they are halved in each round.
    """
    at = save(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = at.where(F.col("word") != F.col("root")).select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        step = save(step, "spelling-roots")
        if step.where("_moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``.

    ``form`` is the near word with the largest count if that is at least twice the word's,
    ``root`` the last form along the chain, ``n_near`` the number of near words.
    """
    vocabulary = save(words(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("_less"), "near", "near_n"))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    has_form = F.col("best.near_n") >= 2 * F.col("n")
    formed = joined.select(
        "word",
        F.when(has_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.near_n")).alias("form_n"),
    )
    formed = save(formed, "spelling-forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
