"""Spelling variants, tree BPE and collocations against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import hashlib
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from trajlake.llm import collocations, spelling, treebpe

UPPER = {i: i + 32 for i in range(65, 91)}


# Spelling variants.


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        others = sorted((-n[o], o) for o in n if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
        out[w] = [form, n[w], len(others), n[form] if form else None]
    answer = []
    for w, (form, count, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        answer.append((w, form, root, count, n_near, form_n))
    return sorted(answer)


def text_of_variants(seed, n):
    r = random.Random(seed)
    base = ["receive", "colour", "straße", "éclair", "aaaaa", "aaaaaa", "ababab", "überall"]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        if r.random() < 0.6:
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice("abé")], [w[i], r.choice("abé")]])
        out.append("".join(w).title() if r.random() < 0.1 else "".join(w))
    return " ".join(out)


def test_variants_equal_brute_force(docs_of, odd):
    rows = [(i, text_of_variants(i, 200)) for i in range(20, 50)] + [(r[0], r[1]) for r in odd]
    rows += [(3, "ÉCLAIR Éclair éclair " * 4), (5, "x" * 70000 + " " + "x" * 70000 + " " + "x" * 70000), (51, "abcde_abcde×abcde÷")]
    got = spelling.variants(docs_of(rows, extra=True))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(rows)


def test_variants_of_no_documents(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([(1, None), (2, ""), (3, "abc abc abc")])).count() == 0


@pytest.mark.parametrize("tile", [2048, 16])
def test_near_pairs_once_whatever_the_group_size(spark, tile):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 7))) for _ in range(500)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted((x.word, x.near) for x in spelling.near_pairs(table, tile).collect())
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_large_groups_are_split(spark):
    # All words share their first half, so one group would hold every word.
    words = [f"prefix{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    placed = spelling.groups(table, 100)
    most = placed.groupBy("key").count().agg({"count": "max"}).collect()[0][0]
    assert most <= 100
    got = {(x.word, x.near) for x in spelling.near_pairs(table, 100).collect()}
    assert len(got) == 512 * 21


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}" if i < 37 else None) for i in range(38)]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.root for r in got} == {"w37"} and len(got) == 38


# Tree BPE.


@pytest.fixture(scope="module")
def library():
    ranks = treebpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return treebpe.TreeBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


PARTS = ["'s", "'re", "'", " ", "  ", "\n", "\t", "a", "the", "é", "日本", "1", "12", ".", "!!", "ll", "r", "xxxxxxx", "\xa0", "<|endoftext|>", "😀"]


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(1, 1), (2, 3), (3, 2), (7, 5), (40, 8)])
def test_every_cut_gives_the_library_ids(monkeypatch, own, library, leaf_chars, leaf_bytes):
    monkeypatch.setattr(treebpe, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(treebpe, "LEAF_BYTES", leaf_bytes)
    r = random.Random(leaf_chars)
    for _ in range(1500):
        own.known.clear()
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(40)))
        got = own.encode(text)
        assert ids(got) == library.encode_ordinary(text), text
        assert own.decode(got) == text.encode()


@pytest.mark.parametrize("text", ["a" * 9000, " " * 3001 + "b", "ab" * 4000, "=-" * 3000, "".join(random.Random(1).choices("abcdefgh", k=9000))])
def test_long_matches(own, library, text):
    assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_join_of_codes_is_the_code_of_the_whole(own):
    r = random.Random(5)
    for _ in range(800):
        raw = "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 60))).encode()
        cut = r.randrange(1, len(raw))
        assert own.join(own.merge(raw[:cut]), own.merge(raw[cut:])) == own.merge(raw) == own._merge_long(raw)


def test_remembered_matches_start_anew(monkeypatch, own, library):
    monkeypatch.setattr(treebpe, "KEEP", 3)
    for text in ("one two three four five six", "one two seven eight nine ten"):
        assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_digests_of_odd_documents(docs_of, odd, library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = treebpe.digests(docs_of(odd, extra=True), path, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd:
        tokens = library.encode_ordinary(r[1] or "")
        packed = np.array(tokens, "<u4").tobytes()
        want.append((r[0], len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert treebpe.digests(docs_of([]), path, public_tokenizers.PATTERN).count() == 0
    rows = treebpe.encoded(docs_of(odd), path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(x.text_bytes).decode() for x in rows) == sorted(r[1] or "" for r in odd)


# Collocations.


def brute_phrases(rows, least, top):
    grams = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    grams[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in grams.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        kept = []
        for p, a in found.items():
            if inside[p] >= a:
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(seed, n):
    r = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "a", "B", "élan", "x\x1cy", "\xa0", "of the people"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]
    texts = ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(60))) for _ in range(n)]
    return [(r.choice(["en", "de", None]), t) for t in texts]


@pytest.mark.parametrize("slice_bytes", [1 << 22, 64])
def test_phrases_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations.slices, "__defaults__", (slice_bytes,))
    rows = phrase_rows(7, 120) + [("en", None), (None, ""), ("en", "new york city " * 3000), ("fr", "...!\n"), ("es", "uno")]
    table = spark.createDataFrame([(i, t, lang, 1, "w") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, w1 string")
    for least, top in ((5, 2000), (2, 7)):
        got = sorted(map(tuple, collocations.mined(table, least, top).collect()))
        assert got == brute_phrases(rows, least, top)


def test_slices_end_at_pieces():
    text = "one two.three four five six seven eight nine ten, eleven"
    whole = [w for s in collocations.slices(pa.array([text, "", "a b"])) for w in s.words.take(pa.array(s.codes)).to_pylist()]
    for most in (1, 5, 9, 30):
        parts = list(collocations.slices(pa.array([text, "", "a b"]), most))
        assert [w for s in parts for w in s.words.take(pa.array(s.codes)).to_pylist()] == whole
        assert sum(int(s.follows.sum()) for s in parts) == 1 + 7 + 0 + 1


def test_phrases_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.mined(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(None, [], 10**15), (None, ["a"], 10**13), (None, ["b"], 3 * 10**12), (None, ["a", "b"], 10**12)]
    counts = spark.createDataFrame([("en", *r[1:]) for r in rows], "lang string, words array<string>, n long")
    got = collocations.candidates(counts, 100).collect()[0]
    assert got.score == 1000 * 10**12 * 10**15 // (10**13 * 3 * 10**12)
