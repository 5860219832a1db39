import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajlake.llm import patterns, seekable, tokenise, words
from trajlake.llm.common import save
from trajlake.llm.tokenise import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole_text(name):
    mine, whole = Encoder(public_tokenizers.path(name)), library(name)
    parts = ["a", "Bc", "é", "é", " ", "  ", "\n", "\t", "\r", "\xa0", "\x1c", "\x85", "'s", "!", "12", "日", "Σ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "🙂"]
    rnd = random.Random(5)
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole(text), repr(text)


@pytest.mark.parametrize("name", FILES)
def test_plain_words_go_to_the_model_once(name):
    mine, whole = Encoder(public_tokenizers.path(name)), library(name)
    assert mine.plain
    calls = []
    direct = mine._direct
    mine._direct = lambda texts: calls.extend(texts) or direct(texts)
    text = "The Thändisch, thändisch... ÉTÉ!? \nßÿØø; word word. zyxwv#$%"
    for _ in range(2):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole(text)
    # Only the space and newline before a word, where the file's cuts keep both, need the library's whole call.
    assert calls == ([] if mine.drops_space else [" \nßÿØø;"])
    parts = ["a", "Bc", "À", "Þß", "ÿ", "×", "÷", "ª", "e\u0301", " ", "\n", "\t", "'", "'s", ".", "|", "!?", "_", "12", "ǅ"]
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole(text), repr(text)


def test_memory_of_pieces_is_bounded_and_keeps_the_first(monkeypatch):
    monkeypatch.setattr(tokenise, "KEEP", 40)
    mine, whole = Encoder(public_tokenizers.path(FILES[1])), library(FILES[1])
    for i in range(60):
        text = f" often {'ab'[i % 2] * (i + 1)}. " + " ".join("xyz"[j % 3] * (j + i) for j in range(1, 9))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole(text)
        assert len(mine.known) <= 60 and b" often" in mine.known


def test_powers_take_no_more_than_they_need():
    before = dict(words._POWERS)
    words._POWERS.clear()
    up, down = words._powers((1 << 20) + 1)
    assert len(words._POWERS["up"]) < 1.2 * (1 << 20) and (up[:99] * down[:99] == 1).all()
    words._POWERS.update(before)


def test_files_round_trip(spark, docs_of, odd):
    ids_of = library(FILES[0])
    for rows in (odd, odd[:1], []):
        path = seekable.write(docs_of(rows, extra=True), public_tokenizers.path(FILES[0]), 2)
        back = seekable.with_starts(save(seekable.read(spark, path), "t")).collect()
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        got = sorted(back, key=lambda r: r.start)
        start = 0
        assert len(got) == len(want)
        for r, (doc_id, text) in zip(got, want):
            ids = np.array(ids_of(text) + [2], "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
            assert bytes(r.ids) == ids
            start += len(ids) // 4


def test_reader_opens_only_what_is_asked_and_sees_damage():
    w = seekable.SeekableWriter()
    for i in range(50):
        w.add(i if i else None, np.arange(i + 1, dtype="<u4"))
    data = bytearray(w.close() + seekable.FOOTER_END.encode("latin-1"))

    class Watched(io.BytesIO):
        total = 0

        def read(self, n=-1):
            Watched.total += n
            return super().read(n)

    reader = seekable.SeekableReader(Watched(bytes(data)))
    before = Watched.total
    assert reader.find(7)[0].tolist() == list(range(8)) and reader.find(None)[0].tolist() == [0]
    assert Watched.total - before < 100
    data[int(reader.start[9]) + 8] ^= 255
    damaged = seekable.SeekableReader(io.BytesIO(bytes(data)))
    assert damaged.find(8)
    with pytest.raises(Exception):
        damaged.find(9)


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing_is_whole_and_gapless(docs_of, odd, capacity):
    ids_of = library(FILES[1])
    for rows in (odd, []):
        got = patterns.pack(docs_of(rows, extra=True), public_tokenizers.path(FILES[1]), 2, capacity).collect()
        made, by_sequence = [], {}
        for r in got:
            assert r.length <= capacity and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
            made.append((r.doc_id, r.piece, r.start, bytes(r.ids)))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        want = []
        for doc_id, text in rows:
            ids = ids_of(text) + [2]
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            want += [(doc_id, i, a, np.array(ids[a:b], "<u4").tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted(made, key=str) == sorted(want, key=str)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(1023, rng.lognormal(6, 1, 20_000).astype(int) % 1024 + 1)
    histogram = np.bincount(lengths, minlength=1025)
    groups = patterns.plan(histogram, 1024)
    back = np.zeros(1025, int)
    for g in groups:
        assert sum(g.lengths) <= 1024
        for n in g.lengths:
            back[n] += g.repeat
    assert (back == histogram).all()
    assert sum(g.repeat for g in groups) <= 1.002 * -(-lengths.sum() // 1024)
