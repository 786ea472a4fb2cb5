"""Near-duplicate grouping by SimHash: banded candidate blocks, bit-sliced distances, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import kept, maybe_broadcast, pieces, scratch, table, text_or_empty
from papyra.llm.components import connected_components

#: Bits of a fingerprint, and the distance up to which two are linked.
BITS, RADIUS = 64, 3
#: Rows of a candidate block; larger buckets are split into blocks of this size that meet pairwise.
BLOCK = 4096
#: Distinct fingerprints up to which 4 tables of 16-bit keys serve; above, 16 tables of 28-bit keys.
FLAT_LIMIT = 1 << 22
SEED = 42
#: Words of a wide fingerprint, bits by which two may differ, and those of its word 6 alone; tables and bits of their keys.
#: Texts whose five-word shingles have a Jaccard similarity of 0.8 differ by 77 of 512 bits, give or take 8.
WIDE, WIDE_RADIUS, WORD_RADIUS, TABLES, KEY_BITS = 8, 92, 15, 24, 14
#: Documents whose shingles are counted to put common shingles last, how many of these are told to workers, and words of a set's bitmap.
SAMPLE_DOCS, COMMON, MAP = 4000, 200_000, 8
#: Texts in whose prefixes a shingle may be before it is put last as well, and keys by which two sets know that they met before.
HEAVY, LEAST = 8, 8
_SALTS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - width + 1))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the words whose bits are set in over half of the rows. Sums of 255 rows fit a byte."""
    n, k = hashes.shape
    counts = np.zeros(64 * k, np.int64)
    for i in range(0, n, 255):
        some = np.ascontiguousarray(hashes[i : i + 255]).view(np.uint8).reshape(-1, 8 * k)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def simhash(text: str, width: int = 3) -> int:
    """Fingerprint of one text: bit b is 1 if it is set in over half the shingles' XXH64."""
    hashes = shingle_hashes(text, width)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def wide_simhash(text: str, width: int = 5) -> np.ndarray:
    """512 bits as eight words, likewise, from eight mixes of each different shingle's hash: repeats don't vote, as similarity is of sets."""
    h = np.unique(shingle_hashes(text, width))[:, None] + _SALTS
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(h ^ (h >> np.uint64(31))) if len(h) else np.zeros(WIDE, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text counts as empty; no words give 0."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            fp = np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return slim.mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS, budget: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, j below last[i], at most radius bits apart, by bit-sliced comparison.

    Bit planes are vertical: a 64-bit word of plane p has bit p of 64 neighbouring rows. For each row and each word of
    its bucket, the XOR with the row's own bit is added to carry-save counters, 64 distances at once; a lane whose
    count passes the radius is dead, and a word with no lane alive is abandoned.
    """
    n = len(fp)
    words = (n + 63) // 64
    bits = np.zeros((words * 64, 8), np.uint8)
    bits[:n] = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(bits, axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)
    own = (bits[:n].T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    rows = np.arange(n)
    w0 = (rows + 1) // 64
    spans = np.where(last > rows + 1, (last - 1) // 64 - w0 + 1, 0)
    ends = np.cumsum(spans)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, "right")))
        q = np.repeat(rows[at:stop], spans[at:stop])
        if len(q):
            w = w0[q] + np.arange(len(q)) - np.repeat(ends[at:stop] - spans[at:stop] - (ends[at - 1] if at else 0), spans[at:stop])
            low = np.clip(q + 1 - w * 64, 0, 64)
            high = np.clip(last[q] - w * 64, 0, 64)
            below = lambda k: np.where(k >= 64, full, (np.uint64(1) << (k % 64).astype(np.uint64)) - np.uint64(1))
            alive = below(high) & ~below(low)
            counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
            for p in range(BITS):
                carry = (planes[p][w] ^ own[p][q]) & alive
                for c in counters:
                    c ^= carry
                    carry &= ~c  # a carry goes on where the bit turned from 1 to 0
                alive &= ~carry
                if radius + 1 != 1 << len(counters):  # counts above the radius that still fit the counters
                    over = np.zeros(len(q), np.uint64)
                    for k in range(radius + 1, 1 << len(counters)):
                        hit = np.full(len(q), full)
                        for b, c in enumerate(counters):
                            hit &= c if k >> b & 1 else ~c
                        over |= hit
                    alive &= ~over
                if p % 8 == 7 and p < BITS - 1:
                    some = alive != 0
                    if not some.all():
                        q, w, alive, counters = q[some], w[some], alive[some], [c[some] for c in counters]
                        if not len(q):
                            break
            some = np.flatnonzero(alive)
            if len(some):
                lanes = np.unpackbits(alive[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, lane = np.nonzero(lanes)
                yield q[some][k], w[some][k] * 64 + lane
        at = stop


def _ends(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return edge, np.repeat(np.r_[edge[1:], len(bucket)], np.diff(np.r_[edge, len(bucket)]))


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the groups of each pair are one, with the smallest row as its label."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def spanning_links(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what close_pairs connects in buckets, at most one for each row: (fingerprint, that of its group's first row)."""
    label = np.arange(len(fp))
    for i, j in close_pairs(fp, *_ends(bucket), radius):
        label = _join(label, i, j)
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


def spanning_pairs(words: np.ndarray, bucket: np.ndarray, radius: int, word: int = 6, word_radius: int = WORD_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most radius bits apart over all words that connect what all such pairs connect: of groups, the nearest pairs.

    Groups of a bucket take their nearest pair to another group and join, and again, so pairs stay about as few as rows.
    """
    label, out = np.arange(words.shape[1]), [[], []]
    for i, j in close_pairs(words[word], *_ends(bucket), word_radius):
        apart = np.bitwise_count(words[:, i] ^ words[:, j]).sum(axis=0, dtype=np.int32)
        near = apart <= radius
        i, j, apart = i[near], j[near], apart[near]
        while True:
            open_ = label[i] != label[j]
            i, j, apart = i[open_], j[open_], apart[open_]
            if not len(i):
                break
            order = np.argsort(apart, kind="stable")
            pick = order[np.unique(label[i[order]], return_index=True)[1]]
            out[0].append(i[pick]), out[1].append(j[pick])
            label = _join(label, i[pick], j[pick])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in out)


def _keys(nested: bool) -> list:
    """SQL of the tables' keys. Of 4 bands of 16 bits one is equal within radius 3; inside, of 4 parts of the other 48 bits one is."""
    bands = [f"(shiftrightunsigned(fp, {16 * i}) & 65535)" for i in range(4)]
    if not nested:
        return [F.expr(f"cast({i} as bigint) * 65536 + {b}") for i, b in enumerate(bands)]
    out = []
    for i in range(4):
        rest = [16 * j + s for j in range(4) if j != i for s in range(16)]
        for part in range(4):
            bits = rest[12 * part : 12 * part + 12]
            runs = []  # of neighbouring bits: (from, length)
            for b in bits:
                if runs and runs[-1][0] + runs[-1][1] == b:
                    runs[-1][1] += 1
                else:
                    runs.append([b, 1])
            key = f"(cast({4 * i + part} as bigint) * 65536 + {bands[i]})"
            for b, k in runs:
                key = f"({key} * {1 << k} + (shiftrightunsigned(fp, {b}) & {(1 << k) - 1}))"
            out.append(F.expr(key))
    return out


def _meet(keyed: DataFrame, columns: list[str], block: int, solve: Callable) -> DataFrame:
    """(u, v) from solve(columns' arrays, bucket numbers) over all rows of a key.

    A bucket above `block` rows is dealt into blocks that meet pairwise, so no task holds more than two blocks of a
    bucket, whatever the bucket's size.
    """
    big = keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    big = table(big, "big-buckets")
    dealt = keyed.join(maybe_broadcast(big), "key", "left").withColumn("mine", F.pmod(F.xxhash64(*columns), F.coalesce("blocks", F.lit(1))).cast("int"))
    meets = F.expr("transform(sequence(0, coalesce(blocks, 1) - 1), x -> struct(least(x, mine) as i, greatest(x, mine) as j))")
    dealt = dealt.select(*columns, "key", F.explode(meets).alias("pair")).select("key", "pair.i", "pair.j", *columns)
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(cols):
            key, i, j = cols[:3]
            change = np.r_[False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            u, v = solve(cols[3:], np.cumsum(change))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(columns))]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            key, i, j = held[:3]
            if len(key) < 16384:
                continue
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = len(key) - int(same.sum())
            if cut:
                yield solved([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solved(held)

    return dealt.mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, count: int, block: int = BLOCK, flat_limit: int = FLAT_LIMIT) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within the radius; two that are share a key of some table."""
    keyed = distinct.select("fp", F.explode(F.array(*_keys(count > flat_limit))).alias("key"))
    return _meet(keyed, ["fp"], block, lambda cols, bucket: spanning_links(cols[0].view(np.uint64), bucket))


def _verified(slim: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have the similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, width)).tobytes() for t in texts], pa.binary())], ["doc_id", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = table(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "wide-ids")
    some = table(slim.join(maybe_broadcast(ids), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary"), "shingle-sets")
    left, right = (some.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(similar, "u long, v long")


def wide_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links between ids of texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Candidates share 14 bits of one of 24 places of a 512-bit fingerprint. Word 6, of which no place is part, is compared
    by bit slices, then all words where it differs in 15 bits or fewer. Of each bucket the nearest pairs that connect its
    groups are held against the texts' shingles. Equal fingerprints are compared with one of them. Rows with a null id
    and texts without words take no part. These are most links of large groups, not all: exact_links finds the rest.
    """
    slim = _slim(docs, id_col, text_col)
    names = [f"w{i}" for i in range(WIDE)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("wide links", dict)  # frees what the worker kept for another operator
        for batch, texts in pieces(batches, "text"):
            w = np.array([wide_simhash(t, width) for t in texts], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(w[:, i])) for i in range(WIDE))], ["doc_id", *names])

    fps = table(slim.mapInArrow(prints, "doc_id long, " + ", ".join(f"{n} long" for n in names)), "wide-fingerprints").filter(" or ".join(f"{n} <> 0" for n in names))
    distinct = table(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")), "wide-distinct")
    equal = fps.join(distinct, names).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    places = 64 // KEY_BITS
    keys = [F.expr(f"{t << KEY_BITS} + cast(shiftrightunsigned(w{t // places}, {KEY_BITS * (t % places)}) & {(1 << KEY_BITS) - 1} as int)") for t in range(TABLES)]

    def solve(cols, bucket):
        a, b = spanning_pairs(np.array([c.view(np.uint64) for c in cols[1:]]), bucket, radius)
        return cols[0][a], cols[0][b]

    found = _meet(distinct.select("rep", *names, F.explode(F.array(*keys)).alias("key")), ["rep", *names], block, solve)
    pairs = table(equal.union(found).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "wide-pairs")

    return _verified(slim, pairs, width, similarity)


def rare_first(s: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The set in the order of its prefixes: shingles that are not common by their hash, then common ones by their place. Any order is right if it's the same for all sets."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    place = np.where(common[at] == s, places[at], -1)
    return s[np.lexsort((s, place))]


def set_bitmap(s: np.ndarray) -> np.ndarray:
    """Of MAP words, the bits that an odd number of the set's shingles fall on: two sets differ in no fewer shingles than their bitmaps in bits."""
    spread = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)  # 9 bits: MAP * 64 places
    return np.packbits(np.bincount(spread.astype(np.int64), minlength=64 * MAP) & 1, bitorder="little").view("<u8")


def scaled_bitmap(s: np.ndarray) -> bytes:
    """set_bitmap of a power of two of bits, as many as shingles or more, for large sets; halves XORed give the smaller one."""
    k = max(9, (len(s) - 1).bit_length())
    spread = (s * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << k) - 1)
    return np.packbits(np.bincount(spread.astype(np.int64), minlength=1 << k) & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two scaled bitmaps differ, the larger one folded."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def apart_pairs(label: np.ndarray, size: np.ndarray, maps: np.ndarray, bucket: np.ndarray, similarity: float, budget: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of a bucket with different labels, but those whose sizes or bitmaps rule the similarity out."""
    edge, _ = _ends(bucket)
    if not len(edge):
        return np.zeros(0, int), np.zeros(0, int)
    mixed = np.minimum.reduceat(label, edge) != np.maximum.reduceat(label, edge)
    rows = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[edge, len(bucket)])))
    rows = rows[np.lexsort((size[rows], bucket[rows]))]
    b, n = bucket[rows].astype(np.int64), size[rows].astype(np.int64)
    most = np.minimum(np.floor(n / similarity + 1e-9).astype(np.int64), (1 << 31) - 1)
    spans = np.searchsorted(b << 31 | n, b << 31 | most, "right") - np.arange(len(rows)) - 1
    ends, out, at = np.cumsum(spans), [[], []], 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + budget, "right")))
        i = np.repeat(np.arange(at, stop), spans[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[at:stop] - spans[at:stop] - done, spans[at:stop])
        i, j = rows[i], rows[j]
        some = label[i] != label[j]
        i, j = i[some], j[some]
        bits = np.zeros(len(i), np.int64)
        for m in maps:
            bits += np.bitwise_count(m[i] ^ m[j])
        some = bits <= (size[i] + size[j]) * (1 - similarity) / (1 + similarity) + 1e-6
        out[0].append(i[some]), out[1].append(j[some])
        at = stop
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in out)


def met_before(here: np.ndarray, least: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of rows, whether a smaller key than the one here is among the least keys of both: there they meet too, and the smallest such place keeps them."""
    out = np.zeros(len(i), bool)
    for x in least:
        mine = x[i]
        smaller = mine < here[i]
        for y in least:
            out |= smaller & (mine == y[j])
    return out


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))


def _common_shingles(slim: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least two of about SAMPLE_DOCS documents, ascending, and their places from the rarest on: only an order, no shingle is left out."""
    n = slim.count()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(shingle_hashes(t, width)) for t in texts]).view(np.int64))], ["h"])

    some = slim.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))) < SAMPLE_DOCS).mapInArrow(each, "h long")
    top = some.groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, c = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], np.argsort(np.lexsort((h, c)))[order].astype(np.int32)


def _later(order: tuple[np.ndarray, np.ndarray], heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order with the heavy shingles behind all others, from the rarest on; the others stay in their order."""
    common, places = order
    stay = ~np.isin(common, heavy)
    least = int(places.max(initial=-1)) + 1
    shingles = np.r_[common[stay], heavy]
    last = np.r_[places[stay], least + np.argsort(np.lexsort((heavy, counts)))]
    at = np.argsort(shingles)
    return shingles[at], last[at].astype(np.int32)


def exact_links(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(u, v): all links between ids of texts with a Jaccard similarity of `similarity` or more and different labels (id, label; else the id).

    Two such sets share one of the first n - ceil(similarity * n) + 1 shingles of each, in any common order; with
    common shingles last, few texts meet: those of a sample, then those that many prefixes hold, counted over all texts. Sets that share
    many shingles meet often, but are a pair once where one of their LEAST smallest shared keys tells. No pair stands for another: each
    that sizes and bitmaps (bounds, never wrong) allow is held against the shingles. Texts of equal sets are compared as one of them and linked with it.
    """
    slim = _slim(docs, id_col, text_col)
    order = _common_shingles(slim, width)
    names = [f"w{i}" for i in range(MAP)]

    def prefix(s: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return rare_first(s, *order)[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1].view(np.int64)

    def lists(keys: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys)))

    def first_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("exact links", dict)  # frees what the worker kept for another operator
        for batch, texts in pieces(batches, "text"):
            hashes, sizes, maps, wide, keys = [], [], [], [], []
            for t in texts:
                s = np.unique(shingle_hashes(t, width))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                maps.append(set_bitmap(s))
                wide.append(scaled_bitmap(s))
                keys.append(prefix(s, order))
            w = np.array(maps, np.uint64).reshape(-1, MAP).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(w[:, i])) for i in range(MAP)), pa.array(wide, pa.binary()), lists(keys)], ["doc_id", "same", "size", *names, "map", "keys"])

    sets = slim.mapInArrow(first_prefixes, "doc_id long, same binary, size int, " + ", ".join(f"{n} long" for n in names) + ", map binary, keys array<long>").filter("size > 0")
    sets = table(sets, "set-prefixes")
    reps = table(sets.groupBy("same").agg(F.min("doc_id").alias("rep")), "set-reps")
    equal = sets.select("doc_id", "same").join(reps, "same").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = reps.select("same", F.col("rep").alias("doc_id"))
    keyed = table(sets.select("doc_id", "same", "keys").join(first, ["same", "doc_id"], "left_semi").select("doc_id", F.explode("keys").alias("key")), "set-keys")
    counts = table(keyed.groupBy("key").count().filter("count > 1"), "shared-keys")

    heavy = counts.filter(F.col("count") > HEAVY).orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    if len(heavy):  # these go last as well; a prefix without any stays what it is
        later = _later(order, heavy.column(0).to_numpy().view(np.uint64), heavy.column(1).to_numpy())

        def later_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), lists([prefix(np.unique(shingle_hashes(t, width)), later) for t in texts])], ["doc_id", "keys"])

        told = F.broadcast(docs.sparkSession.createDataFrame(heavy.select(["key"])))
        changed = table(keyed.join(told, "key", "left_semi").select("doc_id").distinct(), "set-changed")
        n = changed.count()
        again = slim.join(maybe_broadcast(changed, n), "doc_id", "left_semi").mapInArrow(later_prefixes, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))
        keyed = keyed.join(maybe_broadcast(changed, n), "doc_id", "left_anti").union(table(again, "later-keys"))
        counts = keyed.groupBy("key").count().filter("count > 1")
    held = table(keyed.join(counts.select("key"), "key").select(F.col("doc_id").alias("rep"), "key"), "shared-prefixes")
    least = held.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST).alias("least"))
    least = least.select("rep", *[F.coalesce(F.get("least", F.lit(i)), F.get("least", F.lit(0))).alias(f"k{i}") for i in range(LEAST)])
    named = labels.select(F.col("id").alias("doc_id"), "label").groupBy("doc_id").agg(F.min("label").alias("label"))
    facts = sets.drop("keys", "map").join(first, ["same", "doc_id"], "left_semi").join(named, "doc_id", "left").select(F.col("doc_id").alias("rep"), F.coalesce("label", "doc_id").alias("label"), F.col("size").cast("long").alias("size"), *names)
    facts = table(facts.join(least, "rep"), "set-facts")
    meeting = table(held.join(facts, "rep").withColumn("here", F.col("key")), "meeting-sets")

    def solve(cols, bucket):
        a, b = apart_pairs(cols[1], cols[2], [c.view(np.uint64) for c in cols[4 + LEAST :]], bucket, similarity)
        fresh = ~met_before(cols[3], cols[4 : 4 + LEAST], a, b)
        a, b = a[fresh], b[fresh]
        pair = np.unique(np.stack([cols[0][a], cols[0][b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])

    found = _meet(meeting, ["rep", "label", "size", "here", *[f"k{i}" for i in range(LEAST)], *names], block, solve)
    found = table(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "bounded-pairs")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = (c.to_pylist() for c in batch.columns)
            keep = [bits_apart(x, y) <= (k + l) * (1 - similarity) / (1 + similarity) + 1e-6 for k, l, x, y in zip(n, m, a, b)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(c), F.col("size").alias(f"n{c}"), F.col("map").alias(f"m{c}")) for c in "uv")
    found = found.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(possible, "u long, v long")
    pairs = table(equal.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(found).distinct(), "exact-pairs")
    return table(_verified(slim, pairs, width, similarity), "exact-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, block: int = BLOCK, flat_limit: int = FLAT_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of docs.

    Texts are linked when their fingerprints differ in at most 3 bits; component_id is the smallest id of those that
    links reach, itself included. Copies share a fingerprint and are compared once. Null text counts as empty; all
    texts without words have fingerprint 0 and are one component. Rows with a null id take part, but give no
    component_id unless all of the component's ids are null (then it is null).
    """
    fps = table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    with scratch(docs.sparkSession):
        distinct = table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
        found = table(links(distinct, distinct.count(), block, flat_limit).distinct(), "links")
        stars = connected_components(found)  # (id, root) of what is linked
        roots = table(distinct.join(stars.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
        named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
        named = table(named, "components", outlives=True)
    out = fps.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, component_id): near_duplicates' components joined further by all pairs of texts of similarity 0.8 or more.

    wide_links join most of a group; what is still apart then is compared by exact_links, so no pair is missed.
    component_id is the smallest id reached. Null ids are as in near_duplicates.
    """
    with scratch(docs.sparkSession):
        near = table(near_duplicates(docs, id_col, text_col, block=block).select(F.col(id_col).alias("id"), "component_id"), "near")
        tied = near.filter("id <> component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
        known = table(tied.union(wide_links(docs, id_col, text_col, block=block)), "known-links")
        groups = connected_components(known)
        rest = exact_links(docs, groups.select("id", F.col("root").alias("label")), id_col, text_col, block=block)
        roots = connected_components(known.union(rest)) if rest.head(1) else groups
        out = near.join(roots, "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "component_id").alias("component_id"))
        return table(out, "similar", outlives=True)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component of similar_documents, the one of the smallest id; columns as they were.

    Rows with a null id stay, as do rows that repeat the id that stays: exact deduplication drops those of one text.
    Null texts count as empty; all texts without words are one component. An empty table gives an empty one.
    """
    with scratch(docs.sparkSession):
        near = similar_documents(docs, id_col, text_col, **options)
        gone = table(near.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")), "near-copies", outlives=True)
    return docs.join(maybe_broadcast(gone), docs[id_col] == gone["_gone"], "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of documents: three words, 64 bits, links at 3 bits or fewer. Odd rows: see near_duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
