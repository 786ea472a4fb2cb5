import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm.quality import SHAPES, WORDS, Features, fit_ordinal, fit_quality, graded_labels, keep_quality, score_quality
from papyra.llm.queries import QUERIES


def corpus(n, seed):
    rnd = random.Random(seed)
    good, bad, ugly = [f"word{i}" for i in range(80)], ["trash", "scum"], ["###", "a$$$", "B!!"]
    rows = []
    for i in range(n):
        g = i % 3
        words = [rnd.choice(good) for _ in range(rnd.randrange(10, 60))]
        words += [rnd.choice(bad) for _ in range(2 * (g == 1))] + [rnd.choice(ugly) for _ in range(30 * (g == 0))]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), g))
    return rows


def test_grades_are_told_apart_on_held_out_texts(spark):
    train = spark.createDataFrame(corpus(600, 1), "doc_id long, text string, grade int")
    model = fit_quality(train, train.select("doc_id", "grade"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    test = spark.createDataFrame(corpus(300, 2), "doc_id long, text string, grade int")
    rows = score_quality(test, model).join(test, "doc_id").collect()
    assert np.mean([round(r.expected_grade) == r.grade for r in rows]) > 0.95
    assert np.mean([r.accepted == (r.grade == 2) for r in rows]) > 0.97
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert keep_quality(test, model).count() == sum(r.accepted for r in rows)


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{d}/documents.parquet"), graded_labels(spark.read.parquet(f"{d}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = fit_quality(docs, rated.filter(~held))
    rows = score_quality(docs.join(rated.filter(held).select("doc_id"), "doc_id"), model).join(rated, "doc_id").collect()
    kept = {g: np.mean([r.accepted for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.98 and kept[0] < 0.15 and kept[1] < 0.4, kept


def test_features():
    f = Features(most=2)
    for t in ("", " \n", "a", "The the THE, #1 ###", "x " * 50000):
        buckets, values = f.of(t)
        assert len(buckets) == len(values) == len(set(buckets))
    model = fit_ordinal([np.array([0])] * 40, [np.ones(1)] * 40, np.array([0, 1] * 20))
    assert abs(float(model.tails(np.zeros(1))[0, 0]) - 0.5) < 0.05


def test_odd_rows(spark, odd_docs, no_docs):
    grades = spark.createDataFrame([(1, 2), (1, 0), (2, 2), (None, 1), (7, None), (3, 0)], "doc_id long, grade int")
    extra = odd_docs.withColumns({c: F.lit(1) for c in ("k", "grade", "accepted", "buckets")})
    assert score_quality(extra, fit_quality(extra, grades)).count() == odd_docs.count()
    none = fit_quality(odd_docs, grades.limit(0))
    assert {(r.accepted, r.tail_probability) for r in score_quality(odd_docs, none).collect()} == {(True, 1.0)}
    assert keep_quality(extra, none).columns == extra.columns
    assert fit_quality(no_docs, grades).grades == [0] and score_quality(no_docs, none).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in graded_labels(labels).collect()} == {(1, 0), (2, 1), (3, 2)}


def slow_features(text):
    """Buckets and values by the words of the rules, one chunk after the other."""
    chunks, out = text.split(), {}
    shapes = {}
    for c in chunks:
        word = re.sub(r"^[\W_]+|[\W_]+$", "", c.lower())
        if word:
            out[zlib.crc32(word.encode()) % WORDS] = 1.0
        if len(word) > 4:
            out[zlib.crc32((word[:4] + " ...").encode()) % WORDS] = 1.0
        shape = ""
        for run in re.findall(r"[^\W\d_]+|\d+|.", c, re.S):
            shape += "0" if run[0].isdigit() else ("A" if run.isupper() and len(run) > 1 else "a") if run[0].isalpha() else run
        shape = re.sub(r"(.)\1+", r"\1\1", shape)
        b = WORDS + zlib.crc32(shape.encode()) % SHAPES
        shapes[b] = shapes.get(b, 0) + 1
    out |= {b: (n / len(chunks)) ** 0.5 for b, n in shapes.items()}
    if chunks:
        out[WORDS + SHAPES + 11 * len(chunks).bit_length() + 10 * len(set(chunks)) // len(chunks)] = 1.0
    return out


def test_scores_against_plain_version(spark):
    """Every row of the query, from the model's weights alone: features, tails and expected grades one by one."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit_quality(docs, graded_labels(spark.read.parquet(f"{d}/labels.parquet")))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = QUERIES["op3_quality"](spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and len(model.grades) == 3 and model.weights.any()
    for r in rows:
        score = sum(model.weights[b] * v for b, v in slow_features(texts[r.doc_id]).items())
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r.tail_probability == pytest.approx(tails[-1], abs=1e-6)
        assert r.expected_grade == pytest.approx(model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:])), abs=1e-6)
        assert r.accepted == (r.tail_probability >= 0.5)


def test_fit_against_plain_version():
    """The fit reaches the likelihood that plain coordinate search over two weights and two thresholds finds."""
    rnd = random.Random(5)
    x = [(rnd.random() < 0.5, rnd.random() < 0.3) for _ in range(400)]
    grade = [min(2, max(0, round(1 - 0.9 * a - 0.6 * b + rnd.gauss(0, 0.6)))) for a, b in x]

    def loss(p):
        w, t = p[:2], (p[2], p[2] + math.exp(p[3]))
        total = 0.0
        for (a, b), g in zip(x, grade):
            s = w[0] * a + w[1] * b
            above = [1.0, *(1 / (1 + math.exp(c - s)) for c in t), 0.0]
            total -= math.log(max(above[g] - above[g + 1], 1e-12))
        return total / len(x) + 0.5e-5 * (w[0] ** 2 + w[1] ** 2)

    best, step = [0.0, 0.0, -1.0, 0.0], 0.5
    while step > 1e-4:
        moves = [[v + s * (i == k) for i, v in enumerate(best)] for k in range(4) for s in (step, -step)]
        low = min(moves, key=loss)
        if loss(low) < loss(best) - 1e-12:
            best = low
        else:
            step /= 2
    model = fit_ordinal([np.flatnonzero(r) for r in x], [np.ones(sum(r)) for r in x], np.array(grade), size=2, least_z=0.5)
    mine = [*model.weights, model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]
    assert loss(mine) < loss(best) + 1e-4


def test_an_id_of_many_rows_is_one_of_the_sample(spark):
    rows = corpus(300, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    many = docs.union(spark.createDataFrame([(0, "zzz other", 0)] * 500, docs.schema))
    a, b = (fit_quality(x, docs.select("doc_id", "grade")) for x in (docs, many))
    assert np.allclose(a.thresholds, b.thresholds, atol=0.2)
