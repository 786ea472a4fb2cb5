import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyra.llm._shared import shared_dir
from papyra.llm.chunks import ChunkEncoder
from papyra.llm.elias_fano import EliasFano
from papyra.llm.packing import pack, plan_best_fit
from papyra.llm.token_files import dump, load, read_token_files, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", " \n", "a", "b'll", "É", "é", "Σ", "ΑΣ", "😀", "1", "\xa0", "\x1c", "don't", " x", "<|endoftext|>", "日本", "...", "!?", "́"]


def whole(path, text):
    return np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_encode_like_whole_texts(path):
    rnd = random.Random(5)
    enc = ChunkEncoder(path, most_chunks=50)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25))) for _ in range(2000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, 2000, 40) for x in enc.encode(texts[i : i + 40])] == want


def slow_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_over_documents():
    rnd = random.Random(2)
    for _ in range(40):
        cap = rnd.randrange(5, 40)
        lengths = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(200))]
        plan = plan_best_fit({n: lengths.count(n) for n in set(lengths)}, cap)
        filled = {}
        for n, rank, count, seq, offset in plan:
            for i in range(count):
                filled.setdefault(seq + i, []).append((offset, n))
        assert sum(c for n, _, c, _, _ in plan) == len(lengths)
        for held in filled.values():
            held.sort()
            assert [a for a, _ in held] == np.r_[0, np.cumsum([n for _, n in held])][:-1].tolist() and sum(n for _, n in held) <= cap
        assert len(filled) == slow_best_fit(lengths, cap)
    with pytest.raises(ValueError):
        plan_best_fit({9: 1}, 8)


def check_pack(docs, got, capacity):
    want = []
    for r in docs.collect():
        ids = whole(BYTE, r.text or "")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in filled.values():
        held.sort()
        assert [a for a, _ in held] == np.r_[0, np.cumsum([n for _, n in held])][:-1].tolist() and sum(n for _, n in held) <= capacity
    assert len(filled) == slow_best_fit([w[3] for w in want], capacity)


def test_pack_odd_rows(spark, odd_docs, no_docs):
    assert pack(no_docs, BYTE).count() == 0
    check_pack(odd_docs, pack(odd_docs.withColumns({c: F.lit(1) for c in ("piece", "start", "length", "n", "bucket", "rank")}), BYTE), 1024)
    check_pack(odd_docs, pack(odd_docs, BYTE, capacity=7, rows_per_bucket=5), 7)


def test_elias_fano():
    rnd = random.Random(1)
    for v in ([], [0], [5, 5, 5], [0, 1, 2**62], sorted(rnd.randrange(10**6) for _ in range(3000)), list(range(1000))):
        ef = EliasFano.from_bytes(EliasFano.of(np.array(v, np.int64)).to_bytes())
        assert ef.values().tolist() == v and [ef.select(i) for i in range(len(v))] == v
        assert [x for some in ef.runs() for x in some.tolist()] == v and all(len(some) <= 256 for some in ef.runs())
    v = np.sort(np.random.default_rng(0).integers(0, 4_000_000, 10_000))
    assert len(EliasFano.of(v).to_bytes()) * 8 < 10_000 * (2.5 + np.log2(400))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1])).select(1)
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_file_bytes():
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 70000, 2], [2], [5, 2])]
    nulls, base, keys, ends, got = load(dump([None, -5, 2**62], ids, 4))
    assert nulls == 1 and [base + x for x in keys.values().tolist()] == [-5, 2**62] and ends.values().tolist() == [3, 4, 6] and got.tolist() == [1, 70000, 2, 2, 5, 2]
    with pytest.raises(ValueError):
        load(b"x" * 100)


def test_files_odd_rows(spark, odd_docs, no_docs):
    folder = shared_dir(spark, "test")
    for docs, size in ((no_docs, 10), (odd_docs, 10), (odd_docs, 10**6)):
        manifest = write_token_files(docs.withColumns({c: F.lit(1) for c in ("ids", "range", "width", "start")}), WORD, folder, file_ids=size)
        got = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.start)
        rows = docs.collect()
        want = sorted(((r.doc_id, whole(WORD, r.text or "")) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in got] == [d for d, _ in want]
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x), zlib.crc32(x.tobytes())) for d, x in want)
        assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].astype(int).tolist() or not got


def test_many_ranges(spark):
    docs = spark.range(0, 9000).selectExpr("(id * 7919) % 9001 as doc_id", "concat('w', id % 50, ' again') as text")
    manifest = write_token_files(docs, WORD, folder := shared_dir(spark, "test"), file_ids=2000, range_bytes=20_000)
    assert manifest.count() > 4 and manifest.select("range").distinct().count() > 3
    got = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()


def test_an_id_of_most_rows_and_wide_spans(spark):
    docs = spark.range(0, 4000).selectExpr("case when id < 1500 then 7 when id < 2500 then null when id < 2502 then -9223372036854775807 when id < 2503 then 9223372036854775807 else id end as doc_id", "concat('w', id % 50, ' again ', id) as text")
    manifest = write_token_files(docs, WORD, folder := shared_dir(spark, "test"), range_bytes=3000)
    assert manifest.select("range").distinct().count() > 10 and manifest.agg(F.max("docs")).first()[0] < 1000
    got = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    ids = [r.doc_id for r in docs.collect()]
    assert [r.doc_id for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
