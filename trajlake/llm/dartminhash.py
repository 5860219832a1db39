"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the weighted set of its shingles of five words (the words of a shorter one
are its only shingle), a shingle weighing its number of occurrences; two documents are
near if their weighted Jaccard similarity, sum of minima over sum of maxima, is ``LEAST``
or more.

Signature: over each strip of an element's weight (0-1, 1-2, 2-4, 4-8, …) darts arrive as
a hashed Poisson process in rank, the same for every document with that element. A dart
hits if its height in the strip is below the document's weight of the element. Each dart
belongs to one of ``COORDINATES`` coordinates, and the earliest hit of each is kept. Only
darts up to a rank of (darts wanted / total weight) are thrown; a document with an empty
coordinate throws further.

Links: documents of the same words are one class first. Classes that share the hash of
``ROWS`` coordinates (a band) are candidates; buckets of one class are dropped. In rounds,
each class is compared with one hub, the first class of all its buckets in an order hashed
anew each round, by signature and then on exact shingle weights; the components of the
links found are joined, and buckets with one component left are dropped. Rounds go on
while they join at least one in ``WORTH`` of the classes still there. What is left is compared in full
across components, block against block inside tasks: by signature first, then, for classes
with a partner near enough, on exact weights, where components that a task has joined are
not compared again. So a task gives fewer links than it has classes, and no candidate pair
across components is left out.

Nulls: a null text is an empty one; documents without words form one class; a null doc_id
is a document, and last in order. Repeated rows are members of their class. An empty table
gives no rows. Texts are read whole; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts, save, small
from trajlake.llm.words import Words, mix64, word_slices

SHINGLE = 5
LEAST = 0.8
COORDINATES = 128
ROWS = 5
BANDS = COORDINATES // ROWS
DARTS = 8.0  # thrown per coordinate, on average
# A signature's estimate of a similarity of LEAST falls below this with chance under 1e-5.
DOUBT = 0.64
CHUNK = 512
CHUNK_BYTES = 4 << 20
SIGN_BYTES = 1 << 20
WORTH = 20
FEW = 1_000_000  # rows of two numbers that may be broadcast
NO_WORDS = hashlib.md5(b"").digest()

_U = np.uint64


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            out = mix64(out * _U(0x9E3779B97F4A7C15) + np.asarray(part).astype(np.uint64) + _U(0x1234567))
    return out


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x + _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of weighted shingles, sorted by text and element."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(hashes)) - first[text]
    room = np.maximum(counts - SHINGLE, 0)[text]
    starts = np.flatnonzero(place <= room)
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            at = starts + k
            inside = place[starts] + k < counts[text[starts]]
            word = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else 0, _U(0))
            total = mix64(total * _U(0x9E3779B97F4A7C15) + word)
    of = text[starts]
    # Short texts have one start each: place <= 0.
    order = np.lexsort((total, of))
    of, total = of[order], total[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return of[at], total[at], np.diff(np.append(at, len(of))).astype(float)


def signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int = COORDINATES) -> np.ndarray:
    """An (n_texts, k) array of unsigned 32-bit values; rows without elements are zero."""
    out = np.zeros((n_texts, k), np.uint32)
    total = np.bincount(of, weight, minlength=n_texts)
    rank_limit = k * DARTS / np.maximum(total, 1e-300)
    todo = total > 0
    best = np.full(n_texts * k, np.inf)
    name = np.zeros(n_texts * k, np.uint32)
    floor = np.zeros(n_texts)
    while todo.any():
        here = todo[of]
        e, w, t = element[here], weight[here], of[here]
        strip = 0
        while len(e):
            low, high = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0**strip)
            start = _salted(e, 1 + strip)
            ee, ww, tt = start, w, t
            rank = np.zeros(len(ee))
            turn = 0
            while len(ee):
                draw = _salted(ee, 101 + turn)
                rank = rank - np.log(_unit(draw)) / (high - low)
                alive = rank < rank_limit[tt]
                ee, ww, tt, rank, draw = ee[alive], ww[alive], tt[alive], rank[alive], draw[alive]
                place = _salted(draw, 7)
                hit = (low + (high - low) * _unit(place) < ww) & (rank >= floor[tt])
                dart = _salted(draw[hit], 11)
                cell = tt[hit] * k + (dart % _U(k)).astype(np.int64)
                np.minimum.at(best, cell, rank[hit])
                won = best[cell] == rank[hit]
                name[cell[won]] = (dart[won] >> _U(32)).astype(np.uint32)
                turn += 1
            more = w > high
            e, w, t = e[more], w[more], t[more]
            strip += 1
        full = np.isfinite(best.reshape(n_texts, k)).all(axis=1)
        todo &= ~full
        floor = np.where(todo, rank_limit, floor)
        rank_limit = np.where(todo, rank_limit * 2, rank_limit)
    out[total > 0] = name.reshape(n_texts, k)[total > 0]
    return out


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``words`` (a digest of its words) and ``signature``, row by row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, w in word_slices(batch.column(2), SIGN_BYTES):
                rows = signatures(*shingles(w.hashes(), w.text, w.n_texts), w.n_texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array(word_digests(w), pa.binary()),
                        pa.array([x.tobytes() for x in rows], pa.binary()),
                    ],
                    ["doc_id", "text_key", "words", "signature"],
                )

    texts = ids_and_texts(docs).select("doc_id", text_key().alias("text_key"), "text")
    return texts.mapInArrow(sign, "doc_id long, text_key long, words binary, signature binary")


def text_key() -> Column:
    return F.xxhash64("text")


def word_digests(w: Words) -> list[bytes]:
    """MD5 of the words of each text, with one space between words."""
    # A word's bytes and, unless it is its text's last, the byte after it, which becomes a space.
    follows = np.append(w.text[1:] == w.text[:-1], False) if len(w.text) else np.zeros(0, bool)
    data = w.data.copy()
    data[w.end[follows]] = 32
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, w.start, 1)
    np.subtract.at(steps, w.end + follows, 1)
    keep = np.cumsum(steps[:-1]) > 0
    flat, before = data[keep], np.concatenate([[0], np.cumsum(keep)])
    last = np.cumsum(w.counts())
    out = []
    for a, b in zip(last - w.counts(), last):
        part = flat[before[w.start[a]] : before[w.end[b - 1]]] if b > a else flat[:0]
        out.append(hashlib.md5(part.tobytes()).digest())
    return out


def bands(reps: DataFrame) -> DataFrame:
    """``band, key, rep``: the buckets of each class with words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
            keys = [
                _hash(*[rows[:, b * ROWS + i] for i in range(ROWS)]).view(np.int64) if n else np.zeros(0, np.int64)
                for b in range(BANDS)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(BANDS, dtype=np.int32), n)),
                    pa.array(np.concatenate(keys)),
                    pa.array(np.tile(np.asarray(batch.column(0)), BANDS)),
                ],
                ["band", "key", "rep"],
            )

    return reps.select("rep", "signature").mapInArrow(hashed, "band int, key long, rep long")


def estimates(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures do not rule out a similarity of ``LEAST``."""
    left = signs.select(F.col("rep").alias("a"), F.col("signature").alias("_x"))
    right = signs.select(F.col("rep").alias("b"), F.col("signature").alias("_y"))

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        u = np.frombuffer(b"".join(x), np.uint32).reshape(len(x), COORDINATES)
        v = np.frombuffer(b"".join(y), np.uint32).reshape(len(y), COORDINATES)
        return pd.Series((u == v).mean(axis=1) >= DOUBT)

    return pairs.join(left, "a").join(right, "b").where(close("_x", "_y")).select(*pairs.columns)


def weighted_sets(texts: DataFrame) -> DataFrame:
    """``rep`` and ``elements``: its shingles as distinct, sorted 64-bit values, the n-th occurrence hashed with n."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, w in word_slices(batch.column(1), SIGN_BYTES):
                of, element, weight = shingles(w.hashes(), w.text, w.n_texts)
                times = weight.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                of, element = np.repeat(of, times), _hash(np.repeat(element, times), nth).view(np.int64)
                order = np.lexsort((element, of))
                of, element = of[order], element[order]
                edges = np.searchsorted(of, np.arange(w.n_texts + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(element)),
                    ],
                    ["rep", "elements"],
                )

    return texts.mapInArrow(build, "rep long, elements array<long>")


def near_enough(common, x, y):
    """Whether sets of ``x`` and ``y`` elements with ``common`` shared ones reach ``LEAST``, in whole numbers."""
    least = Fraction(LEAST).limit_denominator(10_000)
    return common * (least.numerator + least.denominator) >= (x + y) * least.numerator


def verified(pairs: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact similarity is at least ``LEAST``, judged row by row."""
    maybe = save(estimates(pairs, signs), "maybe")
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("_x"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("_y"))
    near = near_enough(F.size(F.array_intersect("_x", "_y")), F.size("_x"), F.size("_y"))
    return maybe.join(left, "a").join(right, "b").where(near).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, for all nodes with links."""
    edges = save(links.union(links.select("b", "a")).distinct(), "edges")
    rows = edges.count()
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = save(labels, "labels", None, rows)
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_m"))
        nearer = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "_m").alias("to"), "label")
        nearer = save(nearer, "nearer", None, rows)
        # The label of the label: halves the distance to the smallest node.
        far = nearer.select(F.col("node").alias("to"), F.col("to").alias("_far"))
        nxt = save(nearer.join(far, "to").select("node", F.least("to", "_far").alias("label"), F.col("label").alias("_was")), "labels", None, rows)
        if nxt.where("label != _was").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def still_open(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    keys = buckets.groupBy("band", "key").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a != _z")
    return buckets.join(keys.select("band", "key"), ["band", "key"], "left_semi")


def star_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """One pair ``a < b`` at most for each class, with their components ``of_a`` and ``of_b``: with the first
    class, in a hashed order that changes with ``turn``, of all its buckets that begin with another component."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), "rep", "label")
    hubs = buckets.groupBy("band", "key").agg(F.min(order).alias("_h"))
    met = buckets.join(hubs, ["band", "key"]).where(F.col("_h.label") != F.col("label"))
    one = met.groupBy("rep", "label").agg(F.min("_h").alias("_h"))
    mine, hub = F.struct("rep", "label"), F.struct(F.col("_h.rep").alias("rep"), F.col("_h.label").alias("label"))
    pair = one.select(F.least(mine, hub).alias("x"), F.greatest(mine, hub).alias("y")).distinct()
    return pair.select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.label").alias("of_a"), F.col("y.label").alias("of_b")
    )


def placed(buckets: DataFrame, members: DataFrame, size: Column) -> DataFrame:
    """The rows of open buckets, with the columns of ``members``, dealt to places of bounded size.

    The members of a bucket's largest component are only compared with the others, the
    probes. Probes are cut into blocks and all members into homes of about ``CHUNK`` rows and
    ``CHUNK_BYTES`` bytes; a place is one block with one home, and a row goes to the places of
    its block and of its home. ``probe`` marks probes, ``asks`` and ``home`` a row's part in its place.
    """
    rows = buckets.join(members, "rep").withColumn("_size", size)
    n, total = F.count("*").alias("n"), F.sum("_size").alias("bytes")
    parts = rows.groupBy("band", "key", "label").agg(n, total)
    most = F.max(F.struct("n", "label", "bytes")).alias("_most")
    opened = parts.groupBy("band", "key").agg(F.count("*").alias("_parts"), F.sum("n").alias("_n"), F.sum("bytes").alias("_b"), most)

    def pieces(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / CHUNK, size / CHUNK_BYTES)).cast("long")

    homes = pieces(F.col("_n"), F.col("_b")).alias("_homes")
    blocks = pieces(F.col("_n") - F.col("_most.n"), F.col("_b") - F.col("_most.bytes")).alias("_blocks")
    opened = opened.where("_parts > 1").select("band", "key", homes, blocks, F.col("_most.label").alias("_largest"))
    rows = rows.drop("_size").join(opened, ["band", "key"]).withColumn("probe", F.col("label") != F.col("_largest"))
    rows = rows.withColumn("_home", F.pmod(F.xxhash64("rep"), "_homes")).withColumn("_block", F.pmod(F.xxhash64("rep", F.lit(1)), "_blocks"))
    as_home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda i: i * F.col("_homes") + F.col("_home"))
    as_probe = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_homes") - 1), lambda j: F.col("_block") * F.col("_homes") + j)
    rows = rows.withColumn("place", F.explode(F.when(F.col("probe"), F.array_union(as_home, as_probe)).otherwise(as_home)))
    rows = rows.withColumn("asks", F.col("probe") & (F.floor(F.col("place") / F.col("_homes")) == F.col("_block")))
    rows = rows.withColumn("home", F.col("place") % F.col("_homes") == F.col("_home"))
    return rows.select("band", "key", "place", "rep", "label", "probe", "asks", "home", *[c for c in members.columns if c != "rep"])


def candidates(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Of one place: row numbers of a probe and of its homes in other components with signatures near enough."""
    sig = np.frombuffer(b"".join(part["signature"]), np.uint32).reshape(len(part), COORDINATES)
    rep, label, probe = (part[c].to_numpy() for c in ("rep", "label", "probe"))
    at_home = part["home"].to_numpy()
    for i in np.flatnonzero(part["asks"].to_numpy()):
        other = np.flatnonzero(at_home & (label != label[i]) & (~probe | (rep > rep[i])))
        near = other[(sig[other] == sig[i]).mean(axis=1) >= DOUBT]
        if len(near):
            yield i, near


def by_places(rows: DataFrame, size: Column, judge, schema: str) -> DataFrame:
    """``judge`` over the places of ``rows``; small places share a group of bounded rows and bytes."""
    rows = save(rows, "places")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    groups = max(1, total["n"] // 4096, int(total["bytes"]) // (4 * CHUNK_BYTES))

    def judge_all(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([judge(part.reset_index(drop=True)) for _, part in group.groupby(["band", "key", "place"], sort=False)])

    return rows.groupBy(F.pmod(F.xxhash64("band", "key", "place"), F.lit(groups)).alias("_g")).applyInPandas(judge_all, schema)


def with_partners(buckets: DataFrame, signs: DataFrame) -> DataFrame:
    """The classes of open buckets whose signature is near enough that of another component's in a bucket."""

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        rep, found = part["rep"].to_numpy(), set()
        for i, near in candidates(part):
            found.add(i)
            found.update(near)
        return pd.DataFrame({"rep": rep[np.array(sorted(found), np.int64)]})

    size = F.lit(4 * COORDINATES)
    return by_places(placed(buckets, signs, size), size, judge, "rep long").distinct()


def crossing_links(buckets: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact links ``a, b`` that join what is joined at all across the components of each open bucket."""

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        rep, label, elements = (part[c].to_numpy() for c in ("rep", "label", "elements"))
        root = {x: x for x in label}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for i, near in candidates(part):
            for j in near:
                x, y = elements[i], elements[j]
                # The smaller set bounds what is common.
                if top(label[i]) == top(label[j]) or not near_enough(min(len(x), len(y)), len(x), len(y)):
                    continue
                if near_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    root[top(label[i])] = top(label[j])
                    a.append(rep[i])
                    b.append(rep[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    chosen = save(with_partners(buckets, signs), "partners")
    members = signs.select("rep", "signature").join(chosen, "rep").join(sets, "rep")
    size = 8 * F.size("elements") + 4 * COORDINATES
    return by_places(placed(buckets, members, size), size, judge, "a long, b long").distinct()


def all_links(buckets: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` of exact similarity whose components are those of all near pairs of one bucket."""
    buckets = save(still_open(buckets.withColumn("label", F.col("rep"))), "open")
    signs = save(reps.join(buckets.select("rep").distinct(), "rep").select("rep", "signature", "text_key"), "ends")
    texts = ids_and_texts(docs).withColumn("text_key", text_key())
    chosen = texts.join(small(signs.select("rep", "text_key"), FEW), "text_key").groupBy("rep").agg(F.first("text").alias("text"))
    sets = save(weighted_sets(chosen.select("rep", "text")), "sets")
    signs = signs.select("rep", "signature")
    links, turn = None, 0
    while not buckets.isEmpty():
        there = buckets.select("rep").distinct().count()
        found = save(verified(star_pairs(buckets, turn), signs, sets), "links")
        links = found if links is None else links.union(found)
        n_found = found.count()
        if n_found:
            joined = components(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
            joined = small(joined.select(F.col("node").alias("label"), F.col("label").alias("_to")), FEW)
            moved = buckets.join(joined, "label", "left").select("band", "key", "rep", F.coalesce("_to", "label").alias("label"))
            # Only what stays open is written, not every round's buckets twice.
            buckets = save(still_open(moved), "open", None, BANDS * there)
        if n_found * WORTH < there:
            break
        turn += 1
    if links is None:
        return buckets.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    links = links.select("a", "b")
    return links if buckets.isEmpty() else links.union(save(crossing_links(buckets, signs, sets), "links"))


def classed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class, class_id`` for every row; ``class_id`` is the smallest doc_id of the class."""
    rows = save(signed(docs).withColumn("rep", F.xxhash64("words")), "signed")
    reps = rows.groupBy("rep", "words").agg(
        F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.any_value("signature").alias("signature")
    )
    reps = save(reps, "reps")
    buckets = save(bands(reps.where(F.col("words") != F.lit(NO_WORDS))), "bands")
    labels = components(all_links(buckets, reps, docs))
    of = reps.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "first_id", F.coalesce("label", "rep").alias("class"))
    of = save(of, "classes")
    ids = of.groupBy("class").agg(F.min("first_id").alias("class_id"))
    named = of.select("rep", "class").join(ids, "class")
    return rows.select("doc_id", "text_key", "rep").join(named, "rep").select("doc_id", "text_key", "class", "class_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each class: the one of smallest doc_id, with all its columns."""
    rows = save(classed(docs).select("doc_id", "text_key", "class"), "classed")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    chosen = rows.groupBy("class").agg(F.min(rank).alias("_c")).select("class", "_c.doc_id", "_c.text_key")
    counted = rows.groupBy("class", "doc_id", "text_key").agg(F.count("*").alias("_n"))
    mark = chosen.select(F.col("class").alias("_class"), F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    same = (F.col("class") == F.col("_class")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    judged = save(counted.join(mark, same, "left").select("doc_id", "text_key", "_n", F.col("_class").isNotNull().alias("_kept")), "judged")
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = whole.withColumn("text_key", text_key())

    def keys(condition: str) -> DataFrame:
        found = judged.where(condition).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
        return small(found, FEW)

    hit = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    kept = whole.join(keys("not _kept"), hit, "left_anti")
    repeated = judged.where("_kept and _n > 1")
    if not repeated.isEmpty():
        once = kept.join(keys("_kept and _n > 1"), hit, "left_anti")
        kept = once.unionByName(kept.join(keys("_kept and _n > 1"), hit, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return kept.select("_row.*")
