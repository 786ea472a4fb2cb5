import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.llm.components import connected_components
from papyra.llm.simhash import _later, bits_apart, close_pairs, drop_near_duplicates, near_duplicates, rare_first, scaled_bitmap, set_bitmap, shingle_hashes, similar_documents, simhash, spanning_links, wide_simhash


def slow_hash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for s in "\t\n\x0b\x0c\r":
        w = w.replace(s, " ")
    w = [x for x in w.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64(s.encode(), 42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        best[root(i)] = min([x for x in (best.get(root(i)), d) if x is not None], default=None)
    return [best[root(i)] for i in range(len(fps))]


def test_simhash_against_slow():
    for t in ("", " ", "One", "a B", "a b c", "The quick brown fox\njumps over THE lazy dog", "Éa b é c\x0bd", "x y z " * 30000):
        assert simhash(t) == slow_hash(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_bit_slices_find_all_pairs(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)] + [base])
    n = len(fp)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(fp[i] ^ fp[j]).bit_count() <= radius}
    got = {(int(i), int(j)) for a, b in close_pairs(fp, np.zeros(n, int), np.full(n, n), radius, budget=500) for i, j in zip(a, b)}
    assert got == want


def test_buckets_are_separate():
    u, v = spanning_links(np.array([5, 4, 5, 4, 7, 6], np.uint64), np.array([0, 0, 1, 1, 1, 2]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(4, 5), (4, 5), (7, 5)]


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"flat_limit": 0}, {"flat_limit": 0, "block": 4}])
def test_near_duplicates_against_brute(spark, options):
    rnd = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(300)]
    for g in range(12):
        text = [rnd.choice(words) for _ in range(400)]
        for _ in range(8):
            t = list(text)
            for _ in range(rnd.randrange(5)):
                t[rnd.randrange(400)] = rnd.choice(words)
            rows.append((rnd.randrange(10**6), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components([r[0] for r in rows], [slow_hash(r[1]) for r in rows])
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, **options).collect()}
    assert got == {r[0]: c for r, c in zip(rows, want)}
    assert 1 < len(set(want)) < len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    assert near_duplicates(no_docs).count() == 0
    rows = odd_docs.collect()
    fps = [slow_hash(r.text or "") for r in rows]
    want = sorted((str((r.doc_id, f"{f:016x}", c)) for r, f, c in zip(rows, fps, slow_components([r.doc_id for r in rows], fps))))
    assert sorted(str(tuple(r)) for r in near_duplicates(odd_docs).collect()) == want
    extra = odd_docs.withColumns({c: F.lit(1) for c in ("fp", "_gone", "component_id", "key")})
    left = drop_near_duplicates(extra)
    assert left.columns == extra.columns
    assert {r.doc_id for r in left.collect()} == {1, 3, None, 5, 6, 7}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(1000, 1000), (2000, 1999)], "u long, v long"))
    for hub in (2, 1000):
        got = {r.id: r.root for r in connected_components(chain, hub=hub).collect()}
        assert got == {i: 0 for i in range(301)} | {2000: 1999, 1999: 1999}


def test_components_around_hubs(spark):
    rnd = random.Random(3)
    edges = [(i, rnd.choice((5, 6))) for i in range(10, 60)] + [(100 + i, 99) for i in range(30)] + [(5, 101)] + [(200 + i, 201 + i) for i in range(9)]
    group = {x: x for e in edges for x in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(edges, "u long, v long")
    for hub in (1, 3, 20, 1000):
        assert {r.id: r.root for r in connected_components(df, hub=hub).collect()} == group
    assert connected_components(df.limit(0)).count() == 0


def jaccard(a, b):
    a, b = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(b, 5).tolist())
    return len(a & b) / len(a | b)


def test_wide_bits_follow_similarity():
    assert (wide_simhash("") == 0).all()
    rnd = random.Random(1)
    text = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(99)) for _ in range(3000)]
    other = [w if rnd.random() > 0.02 else "x" for w in text]
    a, b = " ".join(text), " ".join(other)
    bits = int(np.bitwise_count(wide_simhash(a) ^ wide_simhash(b)).sum())
    j = jaccard(a, b)
    assert abs(bits - 512 * np.arccos(2 * j / (1 + j)) / np.pi) < 35


@pytest.mark.parametrize("block", [4096, 8])
def test_similar_documents_are_found(spark, block):
    """Copies with a similarity of 0.8 or more go, and unrelated texts and those that share a passage stay."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows, want = [], {}
    for g in range(40):
        base = [word() for _ in range(300)] + passage * (g % 2)
        rows.append((100 * g, " ".join(base)))
        want[100 * g] = {100 * g}
        for k in range(1, 4):
            t = list(base)
            for at in rnd.sample(range(300), 1 + g % 5):
                t[at] = word()
            rows.append((100 * g + k, " ".join(t)))
            want[100 * g].add(100 * g + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in similar_documents(docs, block=block).collect()}
    pairs = [(a, b) for ids in want.values() for a in ids for b in ids if a < b and jaccard(text[a], text[b]) >= 0.8]
    assert len(pairs) > 100 and sum(got[a] == got[b] for a, b in pairs) / len(pairs) > 0.97
    assert all(got[i] in want[i // 100 * 100] for i in got)
    for i, c in got.items():  # none goes without a similar text in its component
        assert i == c or any(got[j] == c and (jaccard(text[i], text[j]) >= 0.8 or (simhash(text[i]) ^ simhash(text[j])).bit_count() <= 3) for j in want[i // 100 * 100] - {i})


def slow_similar(rows):
    """Smallest id of each id's component under similarity 0.8 or op8's distance, all pairs compared."""
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    prints = {i: simhash(t) for i, t in rows}
    near = {i: [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0 or (prints[i] ^ prints[j]).bit_count() <= 3] for i in sets}
    group = {i: i for i in sets}
    while (new := {i: min(group[j] for j in near[i]) for i in sets}) != group:
        group = new
    return group


@pytest.mark.parametrize("block", [4096, 16])
def test_no_pair_hides_another(spark, block):
    """Families of variants with similarities around 0.8, where many pairs fail."""
    rnd = random.Random(7)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(104)]
        for k in range(150):
            t = list(base)
            for at in rnd.sample(range(0, 104, 5), 2 + k % 2):
                t[at] = f"x{rnd.randrange(10**9)}"
            rows.append((1000 * g + k, " ".join(t)))
    want = slow_similar(rows)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == want and 3 < len(set(want.values())) < len(rows)


def test_repeats_and_short_texts_are_found(spark):
    """Sets decide: repeats of lines don't count, and texts of a few shingles are found as well."""
    rnd = random.Random(11)
    rows, n = [], 0

    def add(*texts):
        nonlocal n
        for t in texts:
            rows.append((n, " ".join(t)))
            n += 1

    for g in range(12):
        base = [f"r{g}w{i}" for i in range(300)]
        add(base, base + base[:45] * 6, base + base[:45] * 30)
        short = [f"s{g}w{i}" for i in range(9)]
        add(short, short[:8])
        line = [f"l{g}w{i}" for i in range(30)]
        add(line * 60 + [f"a{g}"], line * 80 + [f"b{g}"], line * 70 + [f"o{g}x{i}" for i in range(40)], line * 75 + [f"o{g}x{i}" for i in range(39)])
    want = slow_similar(rows)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    few, many = (" ".join(f"w{i}" for i in range(300)) + " a b c d e" * k for k in (3, 200))
    assert (wide_simhash(few) == wide_simhash(many)).all()


def test_bitmaps_never_rule_out_too_much():
    r = np.random.default_rng(3)
    for n in (1, 5, 300, 513, 3000, 5000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for drop, new in ((0, 0), (n // 10, n // 10), (0, n // 5), (n // 2, n)):
            b = np.unique(np.r_[a[drop:], r.integers(0, 2**63, new, dtype=np.uint64)])
            apart = len(np.setxor1d(a, b))
            assert bits_apart(scaled_bitmap(a), scaled_bitmap(b)) <= apart
            assert np.bitwise_count(set_bitmap(a) ^ set_bitmap(b)).sum() <= apart


def test_a_pair_is_made_once_and_passages_hardly_meet(spark, monkeypatch):
    """Families just below the similarity share many keys, and shingles of a passage that over HEAVY prefixes hold leave them."""
    import papyra.llm.simhash as S

    made, meet = [], S._meet
    monkeypatch.setattr(S, "_meet", lambda *a: made.append(S.table(meet(*a), "made")) or made[-1])
    rnd = random.Random(9)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for k in range(30):
        t = [f"w{i}" for i in range(1400)]
        for at in rnd.sample(range(0, 1400, 5), 40):
            t[at] = f"x{rnd.randrange(10**9)}"
        rows.append((k, " ".join(t)))
    rows += [(100 + k, " ".join([f"y{rnd.randrange(10**9)}" for _ in range(1200)] + passage)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    monkeypatch.setattr(S, "SAMPLE_DOCS", 0)
    got = {(r.u, r.v) for r in S.exact_links(docs, spark.createDataFrame([], "id long, label long")).collect()}
    assert got == {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for df in made:
        pairs = [tuple(sorted(r)) for r in df.collect()]
        assert len(pairs) <= 1.2 * len(set(pairs)) and sum(b >= 100 for _, b in pairs) <= S.HEAVY * (S.HEAVY - 1) // 2


def test_later_keeps_the_order_of_the_others():
    r = np.random.default_rng(4)
    common, heavy = np.unique(r.integers(0, 2**63, 50, dtype=np.uint64)), np.unique(r.integers(0, 2**63, 9, dtype=np.uint64))
    heavy = np.r_[heavy, common[3:6]]
    places, counts = r.permutation(50).astype(np.int32), r.integers(9, 99, 12)
    s = np.unique(np.r_[common, heavy, r.integers(0, 2**63, 40, dtype=np.uint64)])
    before, after = rare_first(s, common, places), rare_first(s, *_later((common, places), heavy, counts))
    assert (after[-12:] == heavy[np.lexsort((heavy, counts))]).all()
    assert (after[:-12] == before[~np.isin(before, heavy)]).all()
