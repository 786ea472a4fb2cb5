import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from papyra.llm._shared import BATCH_BYTES, _kept, kept
from papyra.llm.quality import Features, fit_quality, graded_labels, score_quality
from papyra.llm.secrets_scan import redact, redact_secrets
from papyra.llm.simhash import shingle_hashes, simhash

D = "/root/testdata/sf0.001"


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = fit_quality(docs, graded_labels(spark.read.parquet(f"{D}/labels.parquet")))
    good = {r.doc_id for r in score_quality(docs, model).filter("accepted").collect()}
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect() if r.doc_id in good}
    kept, seen = {}, set()
    for i, t in texts.items():
        if t not in seen:
            seen.add(t)
            kept[i] = t
    prints = {i: simhash(t) for i, t in kept.items()}
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in kept.items()}
    same = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    close = {i: [j for j in kept if same(i, j)] for i in kept}
    group = {i: i for i in kept}
    for _ in kept:
        new = {i: min(group[j] for j in close[i]) for i in kept}
        if new == group:
            break
        group = new
    left = {i: redact(t) for i, t in kept.items() if group[i] == i}
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    rows = P.run(spark, D).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(want) < docs.count()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.withColumn("key", F.lit(1)), no_docs):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = stage(spark, docs, D)
            if name != P.STAGES[-1][0]:
                assert docs.columns == columns
        docs.collect()


def test_batches_of_long_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "word " * 20000, "en", "a", 100000) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for stage in (P.quality, P.near_dedup, P.secrets, P.packing):
        spark.conf.unset(name)
        stage(spark, docs, D)
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 40 * 100000 and max(found) <= BATCH_BYTES + 200000
    spark.conf.set(name, "1k")
    P.secrets(spark, docs, D)
    assert spark.conf.get(name) in ("1k", "1024b")
    spark.conf.unset(name)


def test_secrets_free_the_cache_of_quality(spark):
    class Here:
        schema, sparkSession = spark.createDataFrame([], "text string").schema, spark

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array(["token=abcdefgh", None])], ["text"])])))

    kept("quality", Features)
    assert redact_secrets(Here())[0].column(0).to_pylist() == ["[assign]", None]
    assert "quality" not in _kept
