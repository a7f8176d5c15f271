import random
import zlib

import numpy as np

from rigtables.llm import op8_packing as op
from rigtables.llm.tokens import Encoder, tokenizer_path


def test_encoder_equals_the_tokenizer():
    e = Encoder(tokenizer_path())
    rng = random.Random(1)
    some = ["a", "b", " ", "\n", ".", ",", "'s", "1", "é", "ß", "<|endoftext|>", "!", "  ", "\t", "\0", "日本", "\x1c", "\x85", "word", "²", " "]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.kind).tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_that_forgets(monkeypatch):
    from rigtables.llm import tokens

    monkeypatch.setattr(tokens, "MOST", 40)
    e = Encoder(tokenizer_path())
    rng = random.Random(2)
    whole = e.tokenizer.encode
    for _ in range(30):
        t = "\n".join(" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(1, 9))) for _ in range(3))
        (ids,) = e.encode([t])
        assert np.frombuffer(ids, e.kind).tolist() == whole(t, add_special_tokens=False).ids and "\n" in e.known and e.known["\n"] >= 0


def test_hilbert_neighbours_touch():
    for dims, depth in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(np.ndindex(*(1 << depth,) * dims)))
        key = op.hilbert_key(cells, depth)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(pieces, texts, length=1024):
    e = Encoder(tokenizer_path())
    ids = {d: np.append(np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)) for d, t in texts.items()}
    seen, sequences = {}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.offset + p.length))
    for parts, ends in [(seen, {d: len(x) for d, x in ids.items()}), (sequences, None)]:
        for k, spans in parts.items():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert spans[-1][1] == ends[k] if ends else spans[-1][1] <= length
    assert seen.keys() == ids.keys()
    assert sum(s[-1][1] < length for s in sequences.values()) <= 1


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(op.op8_packing(spark, sf_dir).collect(), texts)


def test_edges(docs_of):
    from pyspark.sql import functions as F

    texts = [None, "", "long " * 60_000, "short", "same", "same"]
    made = op.pack(docs_of(*texts)).withColumn("ids_crc32", F.crc32("ids"))
    check(made.collect(), dict(enumerate(texts)))
    assert op.pack(docs_of()).count() == 0
    assert op.pack(docs_of("a", "a", ids=[1, 1])).count() == 2


def test_alike_documents_are_neighbours():
    rng = np.random.default_rng(0)
    kinds = [rng.integers(0, 50_000, 300) for _ in range(6)]
    ids = [rng.choice(kinds[k % 6], 3000).astype(np.uint16) for k in range(120)]
    keys = op.curve_keys(np.full(120, 3000), np.concatenate(ids))
    assert (op.curve_keys(np.full(120, 3000), np.concatenate(ids), step=7001) == keys).all()
    order = np.argsort(keys, kind="stable") % 6
    assert (order[1:] == order[:-1]).mean() > 0.5
