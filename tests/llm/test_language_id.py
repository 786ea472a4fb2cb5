import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from papyra.llm.language_id import UNKNOWN, Lattice, LanguageModel, Scorer, fit_language_model, fit_pieces, fit_pieces_by_parts, forward, held_out, identify, predict_language, public_vocabulary, words_of

VOC = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "é"]


def slow(word, logp, voc=VOC):
    """Per language, over all segmentations, one by one."""
    w = "▁" + word
    total, uses = np.zeros(logp.shape[1]), np.zeros((len(voc) + 1, logp.shape[1]))
    for mask in itertools.product([0, 1], repeat=len(w) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(mask) if m], len(w)]
        parts = [w[a:b] for a, b in zip(cuts, cuts[1:])]
        if any(p not in voc and len(p) > 1 for p in parts):
            continue
        at = [voc.index(p) if p in voc else len(voc) for p in parts]
        p = np.exp(logp[at].sum(axis=0))
        total += p
        for i in at:
            uses[i] += p
    return np.log(total), uses / total


def test_forward_sums_all_segmentations():
    logp = np.vstack([np.log(np.random.default_rng(0).dirichlet(np.ones(len(VOC)), 3).T), np.full((1, 3), UNKNOWN)])
    words = ["a", "ab", "abab", "aabba", "zaéb", "bbabab", "aba", "b"]
    got = forward(Lattice(VOC), logp, words)
    assert np.allclose(got, [slow(w, logp)[0] for w in words])
    counts = np.random.default_rng(1).integers(0, 5, (len(words), 3)).astype(float)
    want = sum(slow(w, logp)[1] * c for w, c in zip(words, counts))
    assert np.allclose(forward(Lattice(VOC), logp, words, counts), want)
    assert np.isfinite(forward(Lattice(VOC), logp, ["ab" * 4000])).all()


def test_fit_gives_distributions():
    logp = fit_pieces(Lattice(VOC), ["ab", "ba"], np.array([[5.0, 0], [0, 5.0]]))
    assert np.allclose(np.exp(logp[:-1]).sum(axis=0), 1, atol=0.05)
    found = Scorer(LanguageModel(VOC, ["x", "y"], logp), most_words=1).score(["ab ab!", "BA", "", "12 _", "ab"])
    assert [a for a, _ in found] == ["x", "y", "und", "und", "x"] and all(0 <= s <= 1 for _, s in found)


def test_fit_by_parts_is_the_fit(spark):
    rng = np.random.default_rng(2)
    words = ["a", "ab", "abab", "aabba", "zaéb", "bbabab", "aba", "b"]
    counts = rng.integers(0, 9, (len(words), 3)).astype(float)
    rows = spark.createDataFrame([(w, c.tolist()) for w, c in zip(words, counts)], "word string, counts array<double>").repartition(3)
    assert np.allclose(fit_pieces_by_parts(VOC, rows, 3), fit_pieces(Lattice(VOC), words, counts))


def plain_word(word, number, logp):
    """Log probability of a word by sums from the left, one piece after the other."""
    w = "▁" + word
    sums = [np.zeros(logp.shape[1])]
    for j in range(1, len(w) + 1):
        ways = [sums[i] + logp[number[w[i:j]]] for i in range(max(0, j - 16), j) if w[i:j] in number]
        if w[j - 1] not in number:
            ways.append(sums[j - 1] + logp[-1])
        sums.append(np.logaddexp.reduce(ways, axis=0))
    return sums[-1]


def test_predictions_against_plain_version(spark, vocabulary):
    """Every row, whole texts: words summed one by one from the model's probabilities, which come from the rows not held out alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"))), vocabulary)
    number, known = {p: i for i, p in enumerate(vocabulary)}, {}
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows} and len(model.languages) > 2
    for r in rows:
        words = [w for w in "".join(c if c.isalpha() or c.isalnum() and not c.isdigit() and c != "_" else " " for c in (r.text or "").lower()).split()]
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = sum(known.setdefault(w, plain_word(w, number, model.logp)) if w not in known else known[w] for w in words)
        top = int(total.argmax())
        assert got[r.doc_id].lang_pred == model.languages[top]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp(total - total[top]).sum(), abs=1e-6)


def test_languages_are_refused_not_dropped(spark):
    many = spark.range(501).selectExpr("id as doc_id", "concat('l', id) as lang", "'word' as text")
    with pytest.raises(ValueError, match="languages"):
        fit_language_model(many, VOC)


def test_words():
    assert words_of("Ünï-code 12x_y ²") == ["ünï", "code", "x", "y", "²"] and words_of("² 34") == []


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_held_out_accuracy(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs, vocabulary).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_odd_rows(spark, odd_docs, no_docs, vocabulary):
    assert identify(no_docs, vocabulary).count() == 0
    got = identify(odd_docs.withColumns({c: F.lit(1) for c in ("score", "held_out", "key", "share")}), vocabulary).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[8].lang_pred == "und" and by[None].held_out
    nameless = identify(odd_docs.withColumn("lang", F.lit(None).cast("string")), vocabulary).collect()
    assert {r.lang_pred for r in nameless} == {"und"} and {r.score for r in nameless} == {0.0}
