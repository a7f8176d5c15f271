import random

import corpus_pipeline
from rigtables.llm.op5_decontaminate import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, sf_dir, tmp_path):
    rng = random.Random(7)
    words = ["the", "and", "of", "inor", "erha", "thntd", "onble", "eaan", "heti", "ouer", "stnd", "wheres"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    long = text(400)
    planted = {0: long, 1: long, 2: "12345 !!", 3: None, 4: f"{text(50)} {item} {text(50)}", 5: f"{text(60)} me@example.org {text(60)}", 6: text(80), 7: text(90)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in planted.items()], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
        left.append(sorted({r.doc_id for r in docs.collect()}))
    assert left == [[0, 1, 4, 5, 6, 7], [0, 4, 5, 6, 7], [0, 5, 6, 7], [0, 5, 6, 7], [0, 5, 6, 7]]
    cleaned = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert "[EMAIL]" in cleaned[5].text and cleaned[5].n_chars == len(cleaned[5].text) and cleaned[6].text == planted[6]


def test_run_keeps_clean_documents(spark, sf_dir):
    bench = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    leaked = {d for d, t in docs.items() if any(b in t for b in bench)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in rows}
    assert leaked and not ids & leaked and len(ids) > 0.8 * len(docs)
    full = [r.sequence_id for r in rows]
    assert sorted(set(full)) == list(range(len(set(full))))
