"""A hidden Markov language model, trained by Baum-Welch over all training texts.

A text is its words (A-Z in lower case) and one end. The model has ``STATES`` latent
states. A state emits a class of tokens, and a class emits a token by its training count:

* the ``OWN`` most frequent tokens are classes of their own, all others are spread over
  ``SHARED`` classes by a hash of their last three bytes and whether they are short;
* tokens unknown to the training texts are one token with the chance (tokens seen once +
  0.5) / (N + 1) in any state, taken off the known ones in proportion.

So the chances of all tokens add up to one, and the model's size depends on the parameters
alone, whatever the vocabulary; the counts behind it are of the whole corpus.

Texts are encoded in blocks: a block lists its distinct words once, words are counted over
all blocks by 64-bit hash (two words of 10**9 share one with a chance of 3 %), and the
counts go back to the blocks. Each Baum-Welch round reads the encoded training texts once;
tasks give expected counts of transitions and classes, which Spark sums by class. Scores are
exact: a scaled forward recursion over the whole text, in steps that advance all texts of a
group together.

Nulls: a null text is an empty one: it has one token, the end. A null doc_id is scored and
is training text. Repeated rows count as often as they occur. Without training texts every
token is unknown and has the chance 1. Texts are read whole. An empty table gives no rows.
Other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import ident, remainder, save, whole_text
from trajlake.llm.words import mix64, word_slices

STATES = 8
OWN = 8192
SHARED = 8192
ROUNDS = 3
STAY = 0.9  # chance of staying in a state, at the start
SEED = 1
BLOCK_WORDS = 1_000_000
GROUP_WORDS = 400_000
END = np.uint64(0x5D1E9A3C0F7B2468)  # the end's hash
UNKNOWN = OWN + SHARED  # the class of unknown tokens
CLASSES = OWN + SHARED + 1


def _shared_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    tail = np.zeros(len(start), np.uint64)
    for back in range(1, 4):
        at = end - back
        tail = tail * np.uint64(257) + np.where(at >= start, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    short = (end - start <= 4).astype(np.uint64)
    return (OWN + (mix64(tail * np.uint64(2) + short) % np.uint64(SHARED)).astype(np.int64)).astype(np.int32)


ENCODED = "kind int, block long, doc_id long, held_out boolean, n long, codes binary, code int, h long, shared int, times long"


def encode(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Blocks of texts: rows of kind 0 are texts as codes, rows of kind 1 the words behind a block's codes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, made = TaskContext.get().partitionId(), 0
        held_rows: list = []
        names = [x.split()[0] for x in ENCODED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

        def out(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names
            )

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            block = (part << 24) + made
            made += 1
            ids = [x for r in held_rows for x in r[0]]
            is_held = np.concatenate([r[1] for r in held_rows])
            counts = np.concatenate([r[2] for r in held_rows])
            h = np.concatenate([r[3] for r in held_rows])
            shared = np.concatenate([r[4] for r in held_rows])
            held_rows.clear()
            known, first, code, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[code].astype("<i4")
            training = np.repeat(~is_held, counts)
            times = np.bincount(code[training], minlength=len(known))
            edges = np.concatenate([[0], np.cumsum(counts)])
            codes = [squeeze(code[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            n = len(ids)
            yield out(n, {"kind": np.zeros(n, np.int32), "block": np.full(n, block), "doc_id": ids, "held_out": is_held, "n": counts, "codes": codes})
            n = len(known)
            yield out(n, {"kind": np.ones(n, np.int32), "block": np.full(n, block), "code": np.arange(n, dtype=np.int32), "h": known[order].view(np.int64), "shared": shared[first][order], "times": times})

        words_held = 0
        for batch in batches:
            for first, last, w in word_slices(batch.column(2)):
                counts = w.counts()
                ends = np.cumsum(counts)
                # An end after each text.
                hashes = np.insert(w.hashes(), ends, END)
                shared = np.insert(_shared_class(w.data, w.start, w.end), ends, OWN)
                held_rows.append(
                    (batch.column(0).slice(first, last - first).to_pylist(), np.array(batch.column(1).slice(first, last - first).to_pylist(), bool), counts + 1, hashes, shared)
                )
                words_held += len(hashes)
                if words_held >= BLOCK_WORDS:
                    yield from close()
                    words_held = 0
        if held_rows:
            yield from close()

    texts = docs.select(ident(), (remainder(modulus) == held).alias("held_out"), whole_text().alias("text"))
    return texts.mapInArrow(blocks, ENCODED)


@dataclass
class Lexicon:
    """What all tasks need of the counts: its size is bounded by the parameters."""

    total: int
    distinct: int
    once: int
    own: np.ndarray  # sorted hashes of the tokens that are classes of their own
    own_class: np.ndarray
    class_total: np.ndarray  # training tokens by class

    @property
    def unknown(self) -> float:
        return (self.once + 0.5) / (self.total + 1.0) if self.total else 1.0

    def classes(self, h: np.ndarray, shared: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, h), max(len(self.own) - 1, 0))
        mine = self.own[at] == h if len(self.own) else np.zeros(len(h), bool)
        out = np.where(mine, self.own_class[at] if len(self.own) else 0, shared)
        return np.where(count > 0, out, UNKNOWN)


def count(encoded: DataFrame) -> tuple[DataFrame, Lexicon]:
    """``block, code, h, shared, c`` with c the token's training count over all blocks; and the lexicon."""
    words = encoded.where("kind = 1").select("block", "code", "h", "shared", "times")
    same = Window.partitionBy("h")
    counted = words.withColumn("c", F.sum("times").over(same)).withColumn("lead", F.col("block") == F.min("block").over(same))
    counted = save(counted.drop("times"), "counts")
    leads = counted.where("lead and c > 0")
    total, distinct, once = leads.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))
    ).first()
    own = leads.orderBy(F.col("c").desc(), "h").limit(OWN).select("h", "c").collect()
    own_hashes = np.array([r.h for r in own], np.int64)
    class_total = np.zeros(CLASSES, np.int64)
    class_total[: len(own)] = [r.c for r in own]
    for row in leads.groupBy("shared").agg(F.sum("c").alias("c")).collect():  # at most SHARED rows
        class_total[row.shared] = row.c
    # Tokens with a class of their own leave the shared one.
    for row in leads.orderBy(F.col("c").desc(), "h").limit(OWN).groupBy("shared").agg(F.sum("c").alias("c")).collect():
        class_total[row.shared] -= row.c
    order = np.argsort(own_hashes, kind="stable")
    return counted.drop("lead"), Lexicon(total, distinct, once, own_hashes[order], order.astype(np.int64), class_total)


TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"


def resolve(encoded: DataFrame, counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Each text with its token classes (16-bit, zstandard) and what its score has besides the states.

    ``base_score``: the unigram score; ``within``: log10 chance of the tokens in their classes.
    """

    def block(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        squeeze, loosen = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        words = words.sort_values("code")
        c = words["c"].to_numpy(np.int64)
        cls = lexicon.classes(words["h"].to_numpy(np.int64), words["shared"].to_numpy(np.int64), c)
        base = np.log10((c + 0.5) / (lexicon.total + 0.5 * (lexicon.distinct + 1)))
        inside = np.log10(np.where(c > 0, c / np.maximum(lexicon.class_total[cls], 1), 1.0))
        rows = []
        for doc_id, held, n, codes in zip(texts["doc_id"], texts["held_out"], texts["n"], texts["codes"]):
            code = np.frombuffer(loosen(codes, max_output_size=4 * int(n)), "<i4")
            rows.append((doc_id, held, n, int((c[code] > 0).sum()), float(base[code].sum()), float(inside[code].sum()), squeeze(cls[code].astype("<u2").tobytes())))
        out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"])
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], dtype="Int64")
        return out

    texts = encoded.where("kind = 0").select("block", "doc_id", "held_out", "n", "codes")
    return texts.groupBy("block").cogroup(counted.select("block", "code", "h", "shared", "c").groupBy("block")).applyInPandas(block, TEXTS)


@dataclass
class Model:
    start: np.ndarray  # chance of each state for the first token
    move: np.ndarray  # from state to state
    emit: np.ndarray  # class by state, known classes only


def first_model(lexicon: Lexicon, states: int = STATES, seed: int = SEED) -> Model:
    """Unigram class shares, shaken so that states can part."""
    random = np.random.default_rng(seed)
    share = lexicon.class_total / max(lexicon.total, 1)
    emit = share[:, None] * np.exp(random.normal(size=(CLASSES, states)))
    emit /= np.maximum(emit.sum(axis=0), 1e-300)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit)


class Steps:
    """Sequences laid out step by step: step t holds the t-th token of all texts longer than t, longest first."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        self.edges = np.concatenate([[0], np.cumsum(self.active)])
        flat = np.concatenate([sequences[i] for i in self.order])
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rank = np.repeat(np.arange(len(lengths)), lengths)
        self.tokens = np.empty(len(flat), np.int64)
        self.tokens[self.edges[place] + rank] = flat


def forward(model: Model, emit: np.ndarray, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion."""
    steps = Steps(sequences)
    log = np.zeros(len(sequences))
    alpha = np.broadcast_to(model.start, (len(sequences), len(model.start)))
    for t, n in enumerate(steps.active):
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * emit[steps.tokens[steps.edges[t] : steps.edges[t + 1]]]
        scale = alpha.sum(axis=1)
        log[:n] += np.log(scale)
        alpha = alpha / scale[:, None]
    out = np.empty(len(sequences))
    out[steps.order] = log
    return out


def expected(model: Model, emit: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts by the forward-backward recursion: of first states, moves, and classes by state."""
    steps = Steps(sequences)
    k = len(model.start)
    seen = emit.astype(np.float32)[steps.tokens]
    move = model.move.astype(np.float32)
    alpha = np.empty((len(steps.tokens), k), np.float32)
    scale = np.empty(len(steps.tokens), np.float32)
    at = None
    for t, n in enumerate(steps.active):
        a, b = steps.edges[t], steps.edges[t + 1]
        at = (model.start.astype(np.float32) if at is None else at[:n] @ move) * seen[a:b]
        scale[a:b] = at.sum(axis=1)
        at = at / scale[a:b, None]
        alpha[a:b] = at
    moves = np.zeros((k, k))
    beta = np.ones((steps.active[-1], k), np.float32)
    for t in range(len(steps.active) - 1, 0, -1):
        a, b, n = steps.edges[t], steps.edges[t + 1], steps.active[t]
        ahead = seen[a:b] * beta / scale[a:b, None]
        before = alpha[steps.edges[t - 1] : steps.edges[t - 1] + n]
        moves += before.T @ ahead
        # What was the chance of the states given all tokens takes the place of alpha.
        alpha[a:b] *= beta
        nxt = np.ones((steps.active[t - 1], k), np.float32)
        nxt[:n] = ahead @ move.T
        beta = nxt
    alpha[: steps.active[0]] *= beta
    first = alpha[: steps.active[0]].sum(axis=0, dtype=float)
    by_class = np.stack([np.bincount(steps.tokens, alpha[:, s], minlength=CLASSES) for s in range(k)], axis=1)
    return first, moves * model.move, by_class


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(rows, sequences) of about GROUP_WORDS tokens; a row is (batch, place)."""
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    rows, sequences, held = [], [], 0
    for batch in batches:
        for i, (n, packed) in enumerate(zip(batch.column(column - 1).to_pylist(), batch.column(column))):
            sequences.append(np.frombuffer(loosen(packed.as_py(), max_output_size=2 * n), "<u2"))
            rows.append((batch, i))
            held += n
            if held >= GROUP_WORDS:
                yield rows, sequences
                rows, sequences, held = [], [], 0
    if sequences:
        yield rows, sequences


def train(texts: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Baum-Welch over all rows of ``texts`` that are not held out; each round sums counts over all tasks."""
    model = first_model(lexicon, states, seed)
    training = texts.where("not held_out").select("n_tokens", "classes")
    schema = "what int, " + ", ".join(f"s{i} double" for i in range(states))
    share = lexicon.class_total / max(lexicon.total, 1)
    for _ in range(rounds if lexicon.total else 0):
        now = model

        def step(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            first, moves, by_class = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
            for _, sequences in _groups(batches, 1):
                f, m, c = expected(now, now.emit, sequences)
                first, moves, by_class = first + f, moves + m, by_class + c
            # Rows 0 .. are classes, then the first states, then the moves from each state.
            used = np.flatnonzero(by_class.any(axis=1))
            what = np.concatenate([used, CLASSES + np.arange(states + 1)])
            sums = np.concatenate([by_class[used], first[None], moves])
            yield pa.RecordBatch.from_arrays(
                [pa.array(what.astype(np.int32))] + [pa.array(sums[:, i]) for i in range(states)],
                ["what"] + [f"s{i}" for i in range(states)],
            )

        summed = training.mapInArrow(step, schema).groupBy("what").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)])
        table = np.zeros((CLASSES + 1 + states, states))
        for row in summed.collect():  # a row for each class and state: bounded by the parameters
            table[row[0]] = row[1:]
        by_class, first, moves = table[:CLASSES], table[CLASSES], table[CLASSES + 1 :]
        # Each state keeps a little of the corpus's shares, so no known class has chance 0.
        emit = by_class + 1.0 * CLASSES * share[:, None]
        model = Model(
            (first + 1) / (first + 1).sum(),
            (moves + 1) / (moves + 1).sum(axis=1, keepdims=True),
            emit / np.maximum(emit.sum(axis=0), 1e-300),
        )
    return model


def scored(docs: DataFrame, modulus: int = 5, held: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    encoded = save(encode(docs, modulus, held), "encoded", by=["kind"])
    counted, lexicon = count(encoded)
    texts = save(resolve(encoded, counted, lexicon), "texts")
    model = train(texts, lexicon, states, rounds)
    emit = model.emit * (1 - lexicon.unknown)
    emit[UNKNOWN] = lexicon.unknown
    total = lexicon.total
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sequences in _groups(batches, 6):
            logs = forward(model, emit, sequences) / np.log(10)
            kept = {c: [b.column(j)[i].as_py() for b, i in rows] for j, c in ((0, "doc_id"), (1, "held_out"), (5, "n_tokens"), (2, "n_known"), (3, "base_score"), (4, "within"))}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kept["doc_id"], pa.int64()),
                    pa.array(kept["held_out"], pa.bool_()),
                    pa.array(kept["n_tokens"], pa.int64()),
                    pa.array(kept["n_known"], pa.int64()),
                    pa.array([total] * len(rows), pa.int64()),
                    pa.array(kept["base_score"], pa.float64()),
                    pa.array(logs + np.array(kept["within"]), pa.float64()),
                ],
                names,
            )

    ordered = texts.select("doc_id", "held_out", "n_known", "base_score", "within", "n_tokens", "classes")
    return ordered.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
