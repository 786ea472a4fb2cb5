import hashlib

from pyspark.sql import functions as F

from papyra.llm.exact_dedup import drop_exact_duplicates, exact_dedup


def brute(rows, best):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd_docs):
    for keep, best in (("min", min), ("max", max)):
        got = exact_dedup(odd_docs, keep=keep).collect()
        assert sorted(map(tuple, got), key=str) == brute(odd_docs.collect(), best)


def test_collisions_are_told_apart(odd_docs):
    for limit in (0, 100):
        got = exact_dedup(odd_docs, keep="max", hash128=lambda c: F.lit(b"same"), broadcast_rows=limit).collect()
        assert sorted(map(tuple, got), key=str) == brute(odd_docs.collect(), max)


def test_empty_and_clashing_columns(spark, no_docs, odd_docs):
    assert exact_dedup(no_docs).count() == 0
    extra = odd_docs.withColumns({c: F.lit(1) for c in ("_h", "_text", "_kept", "_row", "n", "_best", "_sha256")})
    left = drop_exact_duplicates(extra)
    assert left.columns == extra.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "3", "None", "5", "6", "7", "8"])


def test_no_copy_stays(spark, odd_docs):
    more = [(20, "twice by id", "en", "a", 1), (20, "twice by id", "de", "b", 2), (20, "twice by id", "de", "b", 2), (None, "no ids", "en", "a", 1), (None, "no ids", None, None, None)]
    docs = odd_docs.union(odd_docs).union(spark.createDataFrame(more, odd_docs.schema))
    for limit in (0, 100):
        rows = drop_exact_duplicates(docs, broadcast_rows=limit).collect()
        assert sorted(r.text or "" for r in rows) == sorted({r.text or "" for r in docs.collect()})
        assert [r.lang for r in rows if r.doc_id == 20] == ["de"]
    assert drop_exact_duplicates(docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))).count() == len(rows)
