import heapq
import random
import zlib

import numpy as np
import pytest

from rigtables.llm import op10_huffman as op
from rigtables.llm.tokens import Encoder, tokenizer_path


def huffman_total(counts):
    heap, total = sorted(c for c in counts if c), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        c = heapq.heappop(heap) + heapq.heappop(heap)
        total += c
        heapq.heappush(heap, c)
    return total


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 300):
        counts = rng.integers(1, 1000, n) ** 2
        assert (op.code_lengths(counts, 40) * counts).sum() == huffman_total(counts.tolist())
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = op.code_lengths(np.array(fib), 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert op.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and op.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        op.code_lengths(np.ones(9, int), 3)


def test_codes_are_prefix_free():
    lengths = op.code_lengths(np.array([40, 1, 1, 7, 0, 3, 90, 2]), 5)
    codes = op.canonical_codes(lengths)
    text = [f"{int(c):0{n}b}" for c, n in zip(codes, lengths, strict=True) if n]
    assert not any(a != b and b.startswith(a) for a in text for b in text) and len(set(text)) == 7


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    every = [rng.zipf(1.3, n).clip(0, 4999).astype(np.uint16) for n in (0, 1, 127, 128, 129, 5000, 0)]
    counts = np.bincount(np.concatenate(every), minlength=5000)
    for longest in (13, 20):
        lengths = op.code_lengths(counts, longest)
        block = op.encode_block(np.arange(-1, 6), np.array([len(x) for x in every]), np.concatenate(every), lengths, op.canonical_codes(lengths))
        docs, sizes, ids = op.decode_block(block, op.decode_table(lengths))
        assert docs.tolist() == [*range(-1, 6)] and sizes.tolist() == [len(x) for x in every]
        assert (ids == np.concatenate(every)).all()
    with pytest.raises(ValueError):
        op.decode_block(b"xxxx" + block[4:], op.decode_table(lengths))


def want(texts):
    e = Encoder(tokenizer_path()).tokenizer
    out, start = [], 0
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op.op10_huffman(spark, sf_dir).collect())) == want(texts)


def test_edges(docs_of, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op, "BLOCK_IDS", 50)
    rng = random.Random(3)
    texts = [(k, rng.choice([None, "", "word " * rng.randint(1, 99), "é" * 40])) for k in rng.sample(range(-50, 50), 40)] + [(None, "lost"), (99, "x " * 100_000)]
    read = op.huffman_round_trip(docs_of(*(t for _, t in texts), ids=[d for d, _ in texts])).withColumn("c", F.crc32("ids"))
    got = [(r.doc_id, r.start, r.n_tokens, r.c) for r in read.collect()]
    assert sorted(got, key=lambda x: x[1]) == want(texts)
    assert op.huffman_round_trip(docs_of()).count() == 0
    assert op.huffman_round_trip(docs_of("a", "a", ids=[1, 1])).count() == 2


def test_files_need_only_their_folder(spark, docs_of, tmp_path):
    texts = ["one two two", None, "drei ä"]
    op.write_token_files(docs_of(*texts), f"{tmp_path}/f")
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in op.read_token_files(spark.newSession(), f"{tmp_path}/f").collect()]
    assert sorted(got) == want(list(enumerate(texts)))


def test_recurring_pieces_are_kept_when_others_are_forgotten(monkeypatch):
    from rigtables.llm import tokens

    monkeypatch.setattr(tokens, "MOST", 300)
    e = tokens.Encoder(tokens.tokenizer_path())
    learnt, learn = [], e._learn
    monkeypatch.setattr(e, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    for k in range(12):
        text = " ".join(["The", *(f"common{i}" for i in range(80)), *(f"rare{k}x{i}" for i in range(40))]) + "  two"
        assert e.encode([text])[0] == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.kind).tobytes()
    assert learnt.count(" common7") == 1 and len(set(learnt)) > 500


def test_words_are_known_apart_from_the_symbols_after_them():
    e = Encoder(tokenizer_path())
    rng = random.Random(5)
    some = ["word", "öch", "Ж", "é", "12", "½", "'s", "'re", "n't", "'", "%%%", ",***", ".", "-", "_", "<", "|>", "€", "中", "~", "`", "@", "…", " ", " ", "\n", "\t", " "]
    texts = ["".join(rng.choices(some, k=rng.randint(1, 30))) for _ in range(3000)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.kind).tobytes(), text
    e = Encoder(tokenizer_path())
    e.encode(["a geteach%%% geteach,*** geteach.*** geteach"])
    assert " geteach" in e.known and not [p for p in e.known if p.startswith(" geteach") and p != " geteach"]
