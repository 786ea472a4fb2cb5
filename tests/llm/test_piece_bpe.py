import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from papyra.llm.piece_bpe import PieceBpe, encode_decode
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["don't, (the) x.y", "s,", "e.\nT", " ", "  ", "   ", "\n", "\t", "a", "b", "ab", "abab", "The", "É", "é", "😀", "1", "日本", "...", "<s>", "<0x41>", "▁", "ation", "\x00", "�", "er", "ing", "ß", "𝔘", "ing ing"]


@pytest.fixture(scope="module")
def sp():
    return SentencePieceProcessor(model_file=PATH)


def test_encode_equals_library(sp):
    rnd = random.Random(4)
    ours = PieceBpe(PATH, most_words=100)
    texts = ["", " ", "  "] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abcdeinrst") for _ in range(n)) for n in range(1, 300)] + ["a" * 5000, "ab" * 3000, " " * 77, "".join(rnd.choice("aeint") for _ in range(20000))]
    got = [x for i in range(0, len(texts), 50) for x in map(list, ours.encode(texts[i : i + 50]))]
    assert got == [sp.encode(t) for t in texts]
    assert [ours.decode(x) for x in got] == [sp.decode(x) for x in got]


def test_random_ids_decode_like_library(sp):
    rnd = random.Random(4)
    ours = PieceBpe(PATH)
    for k in range(3000):
        ids = [rnd.randrange(*rnd.choice([(0, 3), (3, 259), (3, 259), (259, 32000), (259, 300)])) for _ in range(rnd.randrange(9))]
        assert ours.decode(ids) == sp.decode(ids), ids


def test_odd_rows(spark, odd_docs, no_docs, sp):
    assert encode_decode(no_docs, PATH).count() == 0
    got = encode_decode(odd_docs.withColumns({c: F.lit(1) for c in ("ids", "decoded", "n_tokens")}), PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(i := sp.encode(r.text or "")), sha(",".join(map(str, i))), sha(sp.decode(i))) for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
