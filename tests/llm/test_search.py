import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import cascade, dartminhash, impact


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    n = max(1, len(words) - 4)
    return Counter(tuple(words[i : i + 5]) for i in range(n)) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [lowest[find(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(4)
    rows = []
    for _ in range(25):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(40, 200))]
        for _ in range(rnd.randrange(1, 5)):
            own = list(words)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows) + 20, " ".join(own)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(0, 60, 3):  # each near the next, the ends unlike
        chain = chain[:i] + [f"d{i}", f"d{i + 1}"] + chain[i + 2 :]
        rows.append((len(rows) + 20, " ".join(chain)))
    return rows


def test_classes_are_those_of_all_pairs(docs_of, odd, copies):
    rows = odd + copies
    got = dartminhash.classed(docs_of(rows, extra=True)).collect()
    want = brute_classes(rows)
    assert sorted((str(r.doc_id), r.class_id) for r in got) == sorted((str(r[0]), w) for r, w in zip(rows, want))
    assert dartminhash.classed(docs_of([])).collect() == []


def test_classes_by_blocks_are_those_of_all_pairs(docs_of, copies, monkeypatch):
    # One round of hubs only, and tiny blocks: the comparison in full joins the rest.
    for name, value in (("WORTH", 0), ("CHUNK", 4), ("CHUNK_BYTES", 3000)):
        monkeypatch.setattr(dartminhash, name, value)
    asked = []
    crossing = dartminhash.crossing_links
    monkeypatch.setattr(dartminhash, "crossing_links", lambda *tables: asked.append(crossing(*tables)) or asked[-1])
    rnd = random.Random(9)
    base = [f"g{i}" for i in range(120)]
    rows = list(copies)
    for i in range(60):  # copies of one text, about half of their pairs near
        own = list(base)
        own[rnd.randrange(60)], own[60 + rnd.randrange(60)] = f"y{i}", f"z{i}"
        rows.append((1000 + i, " ".join(own)))
    got = dartminhash.classed(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((r[0], w) for r, w in zip(rows, brute_classes(rows)))
    links = asked[0].collect()
    assert 0 < len(links) < len(rows)


def test_one_document_of_each_class_stays(docs_of, odd, copies):
    rows = odd + copies
    kept = dartminhash.survivors(docs_of(rows, extra=True))
    assert "rep" in kept.columns and len(kept.columns) == 15
    ids = [r.doc_id for r in kept.collect()]
    want = brute_classes(rows)
    assert sorted(map(str, ids)) == sorted(map(str, {w if w is not None else None for w in want}))
    assert dartminhash.survivors(docs_of([])).collect() == []


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a = rng.integers(1, 9, 300).astype(float)
    b = a.copy()
    b[:120] = rng.integers(1, 9, 120)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = dartminhash.signatures(np.repeat([0, 1], 300), np.tile(names, 2), np.concatenate([a, b]), 2, k=2048)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 2048)


def test_a_weak_signature_still_gives_whole_classes_by_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55)], "a long, b long")
    got = dict(map(tuple, dartminhash.components(links).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 55: 50}


def test_few_labels_are_written_by_few_tasks(spark, monkeypatch):
    kept, save = [], dartminhash.save
    monkeypatch.setattr(dartminhash, "save", lambda *a, **k: kept.append((a[1], save(*a, **k))) or kept[-1][1])
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long").repartition(9)
    assert {r.label for r in dartminhash.components(links).collect()} == {1}
    assert {len(t.inputFiles()) for kind, t in kept if kind in ("labels", "nearer")} == {1}


def test_hub_rounds_end_when_they_join_few(docs_of, monkeypatch):
    # Copies of which most are unlike: a round that joins one in thirty is the last.
    turns, star = [], dartminhash.star_pairs
    monkeypatch.setattr(dartminhash, "star_pairs", lambda buckets, turn: turns.append(turn) or star(buckets, turn))
    monkeypatch.setattr(dartminhash, "verified", lambda pairs, signs, sets: pairs.orderBy("a", "b").limit(max(1, signs.count() // 30)))
    monkeypatch.setattr(dartminhash, "crossing_links", lambda buckets, signs, sets: signs.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    base = [f"g{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(90)]
    assert dartminhash.classed(docs_of(rows)).count() == 90
    assert turns == [0]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_verdicts(spark):
    rules = [*cascade.RULES, ("a.b", "", "block"), ("b", "/x", "allow"), ("com", "/de/ok", "allow"), ("", "/", "block")]
    hosts = ["example.org", "X.Example.ORG", "org", "notexample.org", "a.com", "com", "c.a.b", "b", "", "org.", "::1", "é.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/12", "/en/2/1", "/fr/a", "/de/ok/1?q=/es/", "/de/#x", "?x", "#/es/", "/x" + "y" * 3000]
    urls = [None, "", "no scheme", "://", "http:/x"] + [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[30], "h"), (7, urls[7], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("host", F.lit("x"))
    got = cascade.judged(pages, cascade.rule_table(spark, tuple(rules))).collect()
    want = [(i, *brute_verdict(u, [r for r in rules if r[0]])) for i, u, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert cascade.judged(pages.limit(0), cascade.rule_table(spark)).collect() == []
    assert {r.verdict for r in cascade.judged(pages, cascade.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_very_long_hosts(spark):
    urls = ["http://" + "a." * 100_000 + "example.org/es/x", "http://" + "b" * 200_000 + ".com/de/" + "c" * 200_000, "http://" + "org." * 50_000 + "net/", "http://.org/", "http://org./"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in cascade.judged(pages, cascade.rule_table(spark)).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("com/de/", "block"), 2: (None, "allow"), 3: ("org/", "allow"), 4: (None, "allow")}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    listed = universe.where(F.pmod("h", F.lit(7)) == 0)
    built = cascade.build(listed, universe)
    h = np.array([r.h for r in universe.collect()])
    assert (built.contains(h.view(np.uint64)) == (np.mod(h, 7) == 0)).all() and len(built.levels) > 2
    assert built.n_bytes() < 20_000


def brute_top(rows, k=5):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.setdefault((i, tuple(math.floor(256 * x) for x in v)), None)
    out = []
    for i, q in clean:
        if i % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if (j, v) != (i, q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 100])
def test_exact_top(spark, monkeypatch, block):
    monkeypatch.setattr(impact, "BLOCK", block)
    monkeypatch.setattr(impact, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=16) * 0.2, 1 + i % 3)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(5, rows[5][1]), (10, rows[8][1])]
    rows += [(2000, None), (2005, [1.0, None]), (2010, [float("nan")] * 16), (None, rows[1][1]), (2015, []), (2020, [0.5] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = impact.top(impact.whole_numbers(df), F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)
    assert impact.top(impact.whole_numbers(df.limit(0)), F.col("id") % 5 == 0).collect() == []


def test_index_proof_holds_for_every_query():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-90, 90, (3000, 24))
    matrix[:500] = matrix[0] + rng.integers(-3, 3, (500, 24))
    index = impact.BlockIndex(matrix)
    for q in (*matrix[:20], np.zeros(24, np.int64), -matrix[5]):
        exact = matrix @ q
        bar = np.sort(exact)[-6]
        rows, scores = index.search(q, 6)
        assert sorted(rows) == sorted(np.flatnonzero(exact >= bar)) and (scores == exact[rows]).all()


def test_index_leaves_few_of_vectors_in_all_directions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 64))
    matrix = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    index = impact.BlockIndex(matrix)
    asked = matrix[:100]
    assert np.mean([len(rows) for rows in index.possible(asked, 6)]) < 200
    for q, (rows, scores) in zip(asked, index.search_all(asked, 6)):
        exact = matrix @ q
        assert sorted(rows) == sorted(np.flatnonzero(exact >= np.sort(exact)[-6])) and (scores == exact[rows]).all()


def test_index_holds_for_wide_and_flat_values():
    rng = np.random.default_rng(4)
    for high in (0, 1, 9, 1 << 20, 1 << 29):
        matrix = rng.integers(-high, high + 1, (400, 3))
        matrix[:, 1] = 7
        index = impact.BlockIndex(matrix)
        for q in (*matrix[:9], -matrix[3]):
            exact = matrix @ q
            rows, scores = index.search(q, 6)
            assert sorted(rows) == sorted(np.flatnonzero(exact >= np.sort(exact)[-6])) and (scores == exact[rows]).all()


def test_hub_rounds_write_the_open_buckets_once(spark, monkeypatch):
    from trajlake.llm import dartminhash as dm

    kinds = []
    monkeypatch.setattr(dm, "save", lambda df, kind, *a, _f=dm.save: kinds.append(kind) or _f(df, kind, *a))
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(4)] + [(9, "other words stand here alone and apart")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dm.classed(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    # Of a round's buckets only the open ones are written.
    assert "moved" not in kinds and kinds.count("open") >= 2
