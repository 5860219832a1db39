import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import imatch, mixing, surrogates


def test_fingerprints_of_texts_and_their_edits(docs_of, odd):
    rnd = random.Random(2)
    rows = odd + [(100 + i, " ".join(f"t{rnd.randrange(600)}" for _ in range(50))) for i in range(60)] + [(300, "é日" * 7)]
    got = imatch.fingerprints(docs_of(rows, extra=True)).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: r[1])
    ordered.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text, text_of = {}, {}
    for d, t in rows:
        text_of.setdefault(d, t or "")
    for r in got:
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(by_text.values())) > 55
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])
    assert imatch.fingerprints(docs_of([])).collect() == []
    one = imatch.fingerprints(docs_of([(1, "abcd")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_brute_force_subset_hashes(spark, docs_of):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"t{rnd.randrange(500)}" for _ in range(30))) for i in range(80)]
    known = {r.term: r["mask"] for r in imatch.lexicon(docs_of(rows)).collect()}
    lists = [[sorted(t for t in set(text.split()) if known.get(t, 0) >> s & 1) for s in range(imatch.SUBSETS)] for _, text in rows]
    flat = spark.createDataFrame([(i, s, " ".join(x)) for i, sets in enumerate(lists) for s, x in enumerate(sets)], "i long, s int, t string")
    hashes = {(r.i, r.s): r.h if r.t else "-" for r in flat.select("i", "s", "t", F.lower(F.hex(F.xxhash64("t"))).alias("h")).collect()}
    for r in imatch.fingerprints(docs_of(rows)).collect():
        assert r.fingerprint.split(".") == [hashes[r.doc_id, s] for s in range(imatch.SUBSETS)]


PERSONAL = [
    (101, "Mail bob.smith@Mail3.example.com or BOB.SMITH@MAIL3.EXAMPLE.COM now"),
    (102, "call +1 (017) 555-7713, +1-017-555-7713"),
    (103, "card 4539578763621486 and 4539-5787-6362-1486 ip 169.122.221.182"),
    (104, "Mr John Smith met Mrs. Mary Smith and Г-жа Анна Петрова"),
    (105, "clean text 12 2024-10-11 v1.2.3 and 3.14"),
    (106, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'),
    (107, "a@b.co e@b.co i@b.co o@b.co u@b.co"),
]


def luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10


def test_surrogates(docs_of, odd):
    rows = PERSONAL + odd
    df, known = surrogates.replace(docs_of(rows, extra=True))
    known = known.collect()
    assert "_t" in df.columns and len(df.columns) == 16
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_entities))
    assert len(df.collect()) == len(rows)
    a, b = re.findall(r"\S+@\S+", got[101][0][0])
    assert b == a.upper() and not re.search("smith|example|bob", a, re.I) and a.endswith(".com")
    shape = lambda t: re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t)))
    for doc_id in (101, 102, 103, 106):
        assert shape(got[doc_id][0][0]) == shape(dict(PERSONAL)[doc_id]) and got[doc_id][0][0] != dict(PERSONAL)[doc_id]
    phones = re.findall(r"\+1[^,]+", got[102][0][0])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and "5557713" not in re.sub(r"\D", "", phones[0])
    cards = re.findall(r"[\d-]{16,}", got[103][0][0])
    assert cards[0] == cards[1].replace("-", "") and luhn(cards[0]) == luhn("4539578763621486") and cards[0] != "4539578763621486"
    octets = [int(x) for x in got[103][0][0].split()[-1].split(".")]
    assert all(100 <= x <= 255 for x in octets)
    names = re.match(r"Mr (\w+) (\w+) met Mrs. (\w+) (\w+) and Г-жа (\w+) (\w+)", got[104][0][0]).groups()
    assert names[0] in surrogates.GIVEN["m", "latin"] and names[2] in surrogates.GIVEN["f", "latin"] and names[1] == names[3]
    assert names[4] in surrogates.GIVEN["f", "cyrillic"] and re.fullmatch("[А-Яа-я]+", names[5])
    assert got[105] == [(PERSONAL[4][1], 0)]
    for doc_id, text in odd:
        assert (text, 0) in got[doc_id]
    pairs = [(r.type, r.norm, r["sub"]) for r in known]
    assert len({(t, s) for t, _, s in pairs}) == len(pairs)
    assert not {(t, s) for t, _, s in pairs} & {(t, n) for t, n, _ in pairs}
    again = surrogates.replace(docs_of(rows))[0].collect()
    assert sorted((str(r.doc_id), r.text or "") for r in again) == sorted((str(k), t or "") for k, v in got.items() for t, _ in v)
    other = surrogates.replace(docs_of(PERSONAL), key="else")[0].where("doc_id = 101").first().text
    assert other != got[101][0][0]
    assert surrogates.replace(docs_of([]))[0].collect() == []


LED_BY_SIGNS = ["-joe@x.com", "_joe.smith@x.com_", "...joe@x.com", "mailto:%20joe@x.com", "bob@y.org_joe@x.com", "+1 555 123 4567.joe@x.com"]


def test_addresses_after_signs(docs_of):
    rows = [(i, text) for i, text in enumerate(LED_BY_SIGNS)] + [(50, "a.b-c_" * 20_000), (51, "a" + "_" * 40 + "joe@x.com")]
    got = {r.doc_id: r for r in surrogates.replace(docs_of(rows))[0].collect()}
    for doc_id, text in rows:
        if doc_id != 50:
            assert "joe" not in got[doc_id].text and "x.com" not in got[doc_id].text, text
            assert got[doc_id].n_entities == (2 if doc_id in (4, 5) else 1)
    assert got[0].text[0] == "-" and got[2].text.startswith("...") and got[1].text[-1] == "_"
    assert (got[50].text, got[50].n_entities) == (rows[6][1], 0)


NAMED = [
    (0, "Mr John Quincy Adams spoke"),
    (1, "Mr J. Smith and Frau von Berg"),
    (2, "Mr John Smith left. John Smith came; Smith's car, SMITH. Will Smithers"),
    (3, "田中@example.jp śćżł@example.pl かな@example.jp محمد@example.sa"),
    (4, "Mr J.R.R. Tolkien; J.R.R. Tolkien"),
]


def test_whole_names_and_other_scripts(docs_of):
    got = {r.doc_id: r for r in surrogates.replace(docs_of(NAMED))[0].collect()}
    first = re.fullmatch(r"Mr ([A-Z]\w+) ([A-Z]\w{5}) ([A-Z]\w{4}) spoke", got[0].text).groups()
    assert not {"John", "Quincy", "Adams"} & set(first) and got[0].n_entities == 1
    assert re.fullmatch(r"Mr [A-Z]\. [A-Z]\w{4} and Frau von [A-Z]\w{3}", got[1].text) and got[1].n_entities == 2
    assert "Smith" not in got[1].text and "Berg" not in got[1].text
    given, family = re.match(r"Mr (\w+) (\w+) left", got[2].text).groups()
    assert got[2].text == f"Mr {given} {family} left. {given} {family} came; {family}'s car, {family.upper()}. Will Smithers"
    assert family != "Smith" and got[2].n_entities == 4 and family in got[1].text
    locals_ = [x.split("@")[0] for x in got[3].text.split()]
    for mine, old in zip(locals_, ("田中", "śćżł", "かな", "محمد")):
        assert mine != old and len(mine) == len(old)
    assert all("\u3040" <= c <= "\u309f" for c in locals_[2]) and all("\u0600" <= c <= "\u06ff" for c in locals_[3])
    full = re.match(r"Mr (.*); (.*)$", got[4].text).groups()
    assert full[0] == full[1] and "Tolkien" not in got[4].text and re.match(r"[A-Z]\.[A-Z]\.[A-Z]\. [A-Z]", full[0])


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = sum(sizes.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


@pytest.mark.parametrize("skew", [1, 40])
def test_mixing_meets_targets(docs_of, odd, skew):
    rnd = random.Random(1)
    rows = [(*r, "odd") for r in odd]
    for s in ("a", "b", "c", "é", None, "Z"):
        n = 60 if s != "b" else 60 * skew
        rows += [(len(rows) + 100, "w " * rnd.randrange(0, 90), s) for _ in range(n)]
    mixed, plan = mixing.mixed(docs_of(rows, extra=True), block_words=8, shard_slots=256)
    got = mixed.collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16
    assert sorted(map(str, mixing.mixed(docs_of(rows), block_words=8, shard_slots=256)[0].collect())) == sorted(map(str, got))
    slots = plan.collect()
    assert sorted((r.shard, r.slot) for r in slots) == [(i // 256, i % 256) for i in range(len(slots))]
    first = sum(r.source == "a" for r in slots if r.shard == 0) / 256
    assert abs(first - sum(r.source == "a" for r in slots) / len(slots)) < 0.12


def test_mixing_of_nothing_and_permutations(spark, docs_of):
    assert mixing.mixed(docs_of([]))[0].collect() == []
    assert [(r.taken, r.target) for r in mixing.mixed(docs_of([(1, None), (2, " ")]))[0].collect()] == [(0, 0.0)] * 2
    for n in (1, 2, 3, 7, 10, 97, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 5).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_draws_are_multinomial_and_settled(spark):
    targets = spark.createDataFrame([("a", 64_000, 96_000.0), ("b", 32_000, 25_600.0), (None, 9_600, 6_400.0), ("c", 640, 64.0)], "source string, source_size long, target double")
    quota = {r.source: r for r in mixing.quotas(targets).collect()}
    every = sum(r.slots for r in quota.values())
    drawn = mixing.draws(mixing.quotas(targets), every, shard_slots=20)
    rows = drawn.collect()
    per_shard = {}
    for r in rows:
        per_shard.setdefault(r.shard, {})[r.source] = r.drawn
    shards = -(-every // 20)
    assert [sum(per_shard[i].values()) for i in range(shards)] == [20] * (every // 20) + [every % 20] * (every % 20 > 0)
    # The counts of one source vary over full shards as a binomial draw does.
    for source in ("a", "b"):
        p = quota[source].slots / every
        counts = [per_shard[i].get(source, 0) for i in range(every // 20)]
        mean = sum(counts) / len(counts)
        spread = sum((c - mean) ** 2 for c in counts) / len(counts)
        assert abs(mean - 20 * p) < 5 * (20 * p * (1 - p) / len(counts)) ** 0.5
        assert 0.6 < spread / (20 * p * (1 - p)) < 1.6
    got = mixing.settled(drawn, mixing.quotas(targets)).collect()
    assert sum(r["count"] for r in got) == every
    for i in range(shards):
        assert sum(r["count"] for r in got if r.shard == i) == sum(per_shard[i].values())
    for source, r in quota.items():
        taken = sorted(j for g in got if g.source == source for j in range(g.start, g.start + g["count"]))
        assert taken == list(range(r.slots))
    # Only the draws beyond a source's slots were given to others.
    spare = sum(max(0, sum(s.get(x, 0) for s in per_shard.values()) - r.slots) for x, r in quota.items())
    kept = sum(min(r.drawn, sum(g["count"] for g in got if (g.shard, g.source) == (r.shard, r.source))) for r in rows)
    assert kept >= every - spare


def test_taken_follows_from_the_draws(docs_of):
    rows = [(i, "w " * 40, "ab"[i % 2]) for i in range(60)]
    mixed, _ = mixing.mixed(docs_of(rows), block_words=8, shard_slots=64)
    assert "trajlake-draws" in " ".join(mixed.inputFiles())


def test_mixed_documents_are_whole(docs_of, odd):
    rows = [(*r, "s") for r in odd] + [(i + 50, "w " * 40, "abc"[i % 3]) for i in range(90)]
    out = mixing.repeated(docs_of(rows, extra=True))
    assert len(out.columns) == 15
    texts = {(r[0], r[1]) for r in rows}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert set(got) <= texts and max(got.count(x) for x in set(got)) <= 6
    assert abs(len(got) - len(rows)) < 40
    assert mixing.repeated(docs_of([])).collect() == []


def test_each_text_is_fingerprinted_once(docs_of, monkeypatch):
    # The next document's fingerprint is the one of its own row, not made again.
    made, known = [], imatch.in_lexicon
    monkeypatch.setattr(imatch, "in_lexicon", lambda *a: made.append(a) or known(*a))
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(6)] + [(9, None)]
    got = {r.doc_id: r for r in imatch.fingerprints(docs_of(rows)).collect()}
    assert len(made) == 2
    order = sorted(got, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        x, y = got[a].fingerprint.split("."), got[b].fingerprint.split(".")
        either = [p for p in zip(x, y) if p != ("-", "-")]
        plain = 0.0 if min(len(x), len(y)) == 1 else sum(p[0] == p[1] for p in either) / max(1, len(either))
        assert got[a].near_next == (1.0 if x == y else plain)
