import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trajlake.llm import gam, hmm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + ["\n"]


def held(doc_id, m):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m == 1


def check_scores(rows, got):
    counts = Counter(t for d, x in rows if not held(d, 5) for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), held(d, 5), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total,
         round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens(x)), 6))
        for d, x in rows
    )
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)


def test_counts_and_base_scores(docs_of, odd):
    check_scores(odd, hmm.scored(docs_of(odd, extra=True)).collect())
    assert hmm.scored(docs_of([])).collect() == []
    only_held = [(i, "x y") for i in range(40) if held(i, 5)]
    assert all(abs(r.score) < 1e-9 and r.n_known == 0 for r in hmm.scored(docs_of(only_held)).collect())


def test_forward_is_the_sum_over_all_state_paths():
    rng = np.random.default_rng(3)
    start, move = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2)
    emit = np.zeros((hmm.CLASSES, 2))
    emit[:4] = rng.dirichlet([1] * 4, 2).T
    model = hmm.Model(start, move, emit)
    sequences = [rng.integers(0, 4, n) for n in (1, 5, 3, 5, 2)]

    def brute(seq):
        total = 0.0
        for path in np.ndindex(*[2] * len(seq)):
            p = start[path[0]] * emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
            total += p
        return math.log(total)

    assert np.allclose(hmm.forward(model, emit, sequences), [brute(s) for s in sequences])
    first, moves, by_class = hmm.expected(model, emit, sequences)
    assert np.isclose(first.sum(), 5) and np.isclose(moves.sum(), sum(len(s) - 1 for s in sequences), rtol=1e-5)
    assert np.allclose(by_class.sum(axis=1)[:4], np.bincount(np.concatenate(sequences), minlength=4), rtol=1e-5)
    # A round of re-estimation does not lower the likelihood.
    better = hmm.Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), by_class / by_class.sum(axis=0))
    assert hmm.forward(better, better.emit, sequences).sum() >= hmm.forward(model, emit, sequences).sum() - 1e-4


def test_states_beat_the_unigram_on_held_out_texts(docs_of):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.6, 60) % 50)) for i in range(300)]
    got = [r for r in hmm.scored(docs_of(rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def test_probabilities_add_up(docs_of):
    lex = hmm.Lexicon(10, 3, 1, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(hmm.CLASSES, np.int64))
    lex.class_total[:3] = [5, 4, 1]
    model = hmm.first_model(lex)
    emit = model.emit * (1 - lex.unknown)
    emit[hmm.UNKNOWN] = lex.unknown
    assert np.allclose(emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_additive_model_learns_and_adds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(gam.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.3) | ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (1, 2) in model.pairs


def test_quality_of_odd_rows_and_held_out_labels(spark, docs_of, odd):
    good, bad = "plain words in a row here. ", "plain### words$$$ in%%% a row### "
    rows = [(i + 100, (good if i % 2 else bad) * (1 + i % 5)) for i in range(120)]
    labels = spark.createDataFrame([(i + 100, i % 2, 0) for i in range(120)] + [(None, 1, 0), (100, 0, 0)], "doc_id long, quality int, toxic int")
    got = gam.scored(docs_of(odd + rows, extra=True), labels).collect()
    assert len(got) == len(odd) + len(rows) and all(0 <= r.score <= 1 for r in got)
    text = dict(rows)
    right = [(r.score >= 0.5) == ("#" not in text[r.doc_id]) for r in got if r.doc_id in text and held(r.doc_id, 3)]
    assert np.mean(right) > 0.95
    kept = gam.accepted(docs_of(rows, extra=True), labels)
    assert len(kept.columns) == 15 and abs(kept.count() - 60) < 5
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in gam.scored(docs_of(odd[:3]), empty).collect()] == [0.5] * 3
    assert gam.scored(docs_of([]), labels).collect() == []


@pytest.mark.parametrize("size", [300, 3000])
def test_features_are_measured_in_small_slices(size):
    rng = np.random.default_rng(3)
    words = np.array(["the", "Word", "x.", "12", "\n", "é", "longer-word,"])
    texts = pa.array([" ".join(rng.choice(words, size // 4)) for _ in range(3_000_000 // size)], pa.string())
    list(gam.feature_slices(texts.slice(0, 5)))
    tracemalloc.start()
    rows, at = [], 0
    for first, last, x in gam.feature_slices(texts):
        assert first == at and last - first == len(x)
        rows.append(x)
        at = last
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(texts) and peak < 60 << 20
    some = rng.choice(len(texts), 20, replace=False)
    alone = np.concatenate([x for i in some for _, _, x in gam.feature_slices(texts.slice(int(i), 1))])
    assert (np.concatenate(rows)[some] == alone).all()
