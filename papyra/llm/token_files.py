"""Token ids in binary files: one concatenated id array, Elias-Fano coded document ends and document ids."""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._shared import kept, pieces, shared_dir, table, text_or_empty
from papyra.llm.chunks import encoder
from papyra.llm.elias_fano import EliasFano

END_ID = 2
MAGIC = b"PAPYRA1\n"
#: Magic; bytes of an id; documents; of these with a null id; ids; smallest id; bytes of the ends and of the ids' codes.
_HEAD = struct.Struct("<8sBQQQqQQ")
#: Ids of a file, about; a document is never split.
FILE_IDS = 2_000_000
#: Bytes of text of a range, about, the most ranges (larger ones just make more files), and documents whose place and size tell each range's bounds.
RANGE_BYTES, MOST_RANGES, SAMPLES = 16_000_000, 65_536, 64
#: Ids of a file span less than this, as their codes are differences.
MOST_SPAN = 1 << 62
#: Chunks kept by a worker: more than for other work, as encoding is nearly all there is to do here.
CHUNKS = 400_000
#: Files that a task reads, one after the other.
TASK_FILES = 8
MANIFEST = "range int, part int, path string, docs long, ids long"


def dump(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file's bytes. Documents come null ids first, then ascending within MOST_SPAN; ids are little-endian unsigned 32-bit bytes."""
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes()
    keys = EliasFano.of(np.array([x - base for x in known], np.int64)).to_bytes()
    array = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return _HEAD.pack(MAGIC, width, len(ids), len(ids) - len(known), len(array) // width, base, len(ends), len(keys)) + ends + keys + array


def load(data: bytes) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """(documents without an id, the smallest id, the other ids less that one, ends, all token ids) of a file."""
    magic, width, n, nulls, total, base, n_ends, n_keys = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    a = _HEAD.size
    ends = EliasFano.from_bytes(data[a : a + n_ends])
    keys = EliasFano.from_bytes(data[a + n_ends : a + n_ends + n_keys])
    return nulls, base, keys, ends, np.frombuffer(data, f"<u{width}", total, a + n_ends + n_keys)


def _order(id_col: Column, text: Column) -> list[Column]:
    """Null ids first, then ascending; of the same id in the order of a hash of the text, so that ranges may divide one id."""
    return [id_col.isNotNull().cast("int").alias("known"), F.coalesce(id_col, F.lit(0)).alias("key"), F.xxhash64(text).alias("h")]


def _bounds(slim: DataFrame, range_bytes: int) -> list[tuple[int, int, int]]:
    """First places in _order of all ranges but the first, so that each has about as many bytes of text.

    They come from about SAMPLES documents of each range, drawn by a hash; a document without a text counts as one of a byte.
    """
    size = F.octet_length("text").cast("long") + 1
    n, total = slim.agg(F.count(F.lit(1)), F.sum(size)).first()
    wanted = min(MOST_RANGES, (total or 0) // range_bytes)
    if not wanted:
        return []
    share = min(1_000_000, -(-1_000_000 * SAMPLES * (wanted + 1) // n))
    drawn = slim.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("ranges")), F.lit(1_000_000)) < share)
    some = drawn.select(*_order(F.col("doc_id"), F.col("text")), size.alias("size")).toArrow().to_pandas().sort_values(["known", "key", "h"], ignore_index=True)
    if not len(some):
        return []
    done = some["size"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(done, done[-1] * np.arange(1, wanted + 1) / (wanted + 1), "right").clip(0, len(some) - 1))
    return sorted({tuple(map(int, x)) for x in some.loc[at, ["known", "key", "h"]].to_numpy()})


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encodes docs and writes them in ascending order of id; returns the manifest with each file's first id's place, `start`.

    Ids take 2 bytes if the vocabulary allows. Ranges of documents, each a task and of about as many bytes of text, come
    from a sample (see _bounds), so texts are encoded once, and only ids are shuffled. A task that runs again writes
    files of its own; the manifest, a written table, names those that count. `folder` must be one that all executors
    reach. Null text counts as empty; rows with a null id come first; those of one id are in the order of a hash of
    the text, then of their ids' bytes, so an id that most rows repeat is many ranges. An empty table writes no file;
    other columns don't matter.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    bounds = _bounds(slim, range_bytes)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, CHUNKS)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch, texts in pieces(batches, "text", 4_000_000):
            places = zip(*(batch.column(i).to_pylist() for i in range(2, 5)))
            at = [bisect_right(bounds, x) for x in places]
            ids = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(4), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], ["range", "doc_id", "h", "ids", "width"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("token files", dict)  # frees what the worker kept for encoding
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        held_ids, held, size, at, part, width, least = [], [], 0, None, 0, 2, None

        def flush():
            name = f"{path}/tokens-{at:06d}-{part:05d}-{uuid.uuid4().hex[:12]}.bin"
            with store.open_output_stream(name) as f:
                f.write(dump(held_ids, held, width))
            row = [at, part, name, len(held), size]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["range", "part", "path", "docs", "ids"])

        for batch in batches:
            for r, k, _, ids, w in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (r != at or size >= file_ids or (least is not None and k - least >= MOST_SPAN)):
                    yield flush()
                    part = part + 1 if r == at else 0
                    held_ids, held, size, least = [], [], 0, None
                at, width, least = r, w, k if least is None else least
                ids = np.frombuffer(ids, f"<u{w}").astype("<u4").tobytes()
                held_ids.append(k), held.append(ids)
                size += len(ids) // 4
        if held:
            yield flush()

    placed = slim.select("doc_id", "text", *_order(F.col("doc_id"), F.col("text")))
    coded = placed.mapInArrow(encode, "range int, doc_id long, h long, ids binary, width int")
    files = coded.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "doc_id", "h", "ids").mapInArrow(write, MANIFEST)
    files = table(files, "manifest")  # a row for each file
    sums = files.groupBy("range").agg(F.sum("ids").alias("n")).toArrow().sort_by("range")  # MOST_RANGES rows at most
    n = sums["n"].to_numpy()
    before = docs.sparkSession.createDataFrame(list(zip(sums["range"].to_pylist(), (np.cumsum(n) - n).tolist())), "range int, before long")
    inside = F.sum("ids").over(Window.partitionBy("range").orderBy("part")) - F.col("ids")
    return files.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone, whatever ids they have; no files, no rows.

    Each run of documents is selected in a file's codes; of ends and ids no table longer than a run is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("token files", dict)  # frees what the worker kept for encoding
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as f:
                    nulls, base, keys, ends, ids = load(f.read())
                names = chain([None] * nulls, (base + int(x) for some in keys.runs() for x in some))
                first = 0
                for some in ends.runs():
                    starts = np.r_[first, some[:-1]]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, some)]
                    mine = [next(names) for _ in crc]
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(starts + start), pa.array(some - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    first = int(some[-1])

    slim = table(manifest.select("path", "start"), "starts")
    return slim.repartition(-(-slim.count() // TASK_FILES) or 1).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark, sf_dir: str) -> DataFrame:
    """documents written as token files and read back from them. Odd rows: see write_token_files."""
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(manifest, folder)
