import random

import corpus_pipeline
from trajlake.llm import dartminhash, gam, mixing, patterns, surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_chain_and_take_effect(spark, tmp_path):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(30, 120)))
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text + (f" mail me{i}@host.example.com" if i % 10 == 1 else ""), "en", "ab"[i % 2], len(text)))
        labels.append((i, int(i % 4 != 0), 0))
    rows += [(500 + i, rows[5][1], "en", "a", 1) for i in range(30)] + [(900, None, None, None, None), (901, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert not any(i % 4 == 0 for i in kept if i < 160) and len([i for i in kept if i < 160]) > 110
    single = [r.doc_id for r in seen["near_duplicates"].collect()]
    assert len(single) == len(set(single)) and not {500 + i for i in range(30)} & set(single) and 5 in single
    clean = seen["personal_data"].collect()
    assert sorted(r.doc_id for r in clean) == sorted(single)
    assert not any("host.example" in (r.text or "") for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean if r.text is not None)
    assert {r.doc_id for r in seen["mixing"].collect()} <= set(single)
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen["mixing"].collect()}
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, packed))


def test_stages_use_their_operators():
    modules = [gam, dartminhash, surrogates, mixing, patterns]
    assert len(corpus_pipeline.STAGES) == len(modules) and corpus_pipeline.ORACLE_SQL is None


def test_stages_send_texts_to_python_by_bytes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before, seen = spark.conf.get(corpus_pipeline.BATCH_KEY), []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, docs, sf: seen.append(s.conf.get(corpus_pipeline.BATCH_KEY)) or docs)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert seen == [str(corpus_pipeline.BATCH_BYTES)] and spark.conf.get(corpus_pipeline.BATCH_KEY) == before
