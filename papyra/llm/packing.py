"""Best-fit packing of tokenized documents, planned over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._shared import maybe_broadcast, pieces, table, text_or_empty
from papyra.llm.chunks import encoder

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, count, first_sequence, offset).

    Documents of that length with rank first_rank + i, i < count, go to sequence first_sequence + i at the offset.
    Sequences that hold the same lengths are one entry with a count, so the work and the plan depend on the number
    of different lengths, at most the capacity, and hardly on the number of documents: 1024 lengths gave 15,000 rows.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rooms: list[int] = []  # the different room left, ascending
    at: dict[int, list[tuple[int, tuple]]] = {}  # room left: [(sequences, ((length, offset), ...)), ...]

    def put(count: int, held: tuple, left: int) -> None:
        if count:
            if left not in at:
                insort(rooms, left)
                at[left] = []
            at[left].append((count, held))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                n, held = at[left].pop()
                if not at[left]:
                    del at[left], rooms[k]
            else:
                left, held, n = capacity, (), count
            each = min(left // length, count)  # best fit fills the tightest sequence before it takes another
            full = min(n, count // each)
            more = tuple((length, capacity - left + i * length) for i in range(each))
            if held or left < capacity:
                put(n - full, held, left)
            put(full, held + more, left - each * length)
            count -= full * each
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for left in rooms:
        for n, held in at[left]:
            for length, offset in held:
                slots.append((length, ranks[length], n, sequence, offset))
                ranks[length] += n
            sequence += n
    return slots


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECES: each document's ids and the end id, cut into pieces of the capacity of which the first may be shorter."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch, texts in pieces(batches, "text", 4_000_000):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(enc.encode(texts)):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, rows_per_bucket: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece, in as few sequences as best fit finds.

    A document is cut only if it is longer than a sequence; pieces without a gap from offset 0 make each sequence.
    Only the histogram, at most `capacity` counts, comes to the driver, and the plan goes back. A piece's rank within
    its length is its rank in a bucket of that length and the sum of the buckets before, so no task ranks all pieces
    of a common length. Null text counts as empty: a document of the end id alone. Null and repeated ids each keep their row.
    An empty table gives an empty one, and other columns don't matter.
    """
    cut = table(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    spark = cut.sparkSession
    counts = cut.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}
    slots = plan_best_fit(histogram, capacity)
    plan = spark.createDataFrame(slots, "length long, first_rank long, n long, first_sequence long, offset long")
    buckets = 64 + sum(histogram.values()) // rows_per_bucket
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    before = table(before, "ranks-before")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(maybe_broadcast(before), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")
    here = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["first_rank"]) & (ranked["rank"] < plan["first_rank"] + plan["n"])
    placed = ranked.join(maybe_broadcast(plan, len(slots)), here)  # some thousands of rows for a capacity of 1024, whatever the documents
    sequence = F.col("first_sequence") + F.col("rank") - F.col("first_rank")
    return placed.select(ranked["doc_id"], "piece", "start", ranked["length"], "ids_crc32", sequence.alias("sequence_id"), "offset")


def op2(spark, sf_dir: str) -> DataFrame:
    """pack of documents into sequences of 1024 tokens. Odd rows: see pack."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
