"""SentencePiece BPE encoding in vectorised merge rounds over flat numpy symbol arrays, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import kept, pieces, text_or_empty

SPACE = "▁"
#: Words kept in a worker's memory; at more, it starts anew.
MOST_WORDS = 300_000
NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Latin letters up to the end or an ASCII character that is none.
_HEAD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f])")
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceBpe:
    """A BPE model file with byte fallback, identity normalisation and a leading space; encode() equals the library's."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "" for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)) or not all(k in kind for k in ("byte", "unknown")):
            raise ValueError("a BPE model with byte fallback and without unused pieces is needed")
        self.size, self.most = size, most_words
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        own = {p: i for i, (p, k) in enumerate(zip(names, kind)) if not k}
        #: No piece has a space after another character: so no merge crosses from a word into the next one's spaces.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in own)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.control = {i for i, k in enumerate(kind) if k == "control"}
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        self.unknown = kind.index("unknown")
        self.surface = [n.replace(SPACE, " ").encode() if not k else b"" for n, k in zip(names, kind)]
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = sp.decode([self.unknown]).encode()
        self.first = {i for p, i in own.items() if p.startswith(SPACE)}
        # symbols: ids of pieces; size + code point for characters that are no piece
        self.wide = size + 0x110000
        self.char = np.arange(0x110000, dtype=np.int64) + size
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda s: own.get(s, size + ord(s) if len(s) == 1 else None)
        pairs = [(a * self.wide + b, i) for p, i in own.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        # a hash table with free places after each run of keys, a fifth full at most
        self.shift = np.uint64(64 - (5 * len(pairs)).bit_length())
        self.slots = np.full((1 << 64 - int(self.shift)) + 64, -1, np.int64)
        self.merged = np.full(len(self.slots), -1, np.int64)
        for h, (k, i) in sorted(zip(self._hash(np.array([k for k, _ in pairs], np.int64)).tolist(), pairs)):
            while self.slots[h] >= 0:
                h += 1
            self.slots[h], self.merged[h] = k, i
        #: Pairs of characters that stand together in a piece: between others there is never a merge.
        self.together = {p[k : k + 2] for p in own for k in range(len(p) - 1)}
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)  # equal scores have equal ranks
        self.rank = np.append(rank, NONE)  # at -1: no merge

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.wide + right
        at = self._hash(key)
        held = self.slots[at]
        out = np.where(held == key, self.merged[at], -1)
        go = np.flatnonzero((held != key) & (held >= 0))
        while len(go):
            at[go] += 1
            held = self.slots[at[go]]
            hit = held == key[go]
            out[go[hit]] = self.merged[at[go[hit]]]
            go = go[~hit & (held >= 0)]
        return out

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word's number, symbol), in order, after all merges.

        A round finds each word's least rank over its neighbouring pairs and merges that rank's pairs at once, leftmost
        first and without overlap; then the arrays are compacted. Merging one by one in order of rank does the same,
        unless a merge makes a pair of no greater rank, which must go first: then the word's later ones wait.
        """
        lengths = np.array(list(map(len, words)), np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        wid = np.repeat(np.arange(len(words)), lengths)
        done_wid, done_sym = [], []

        def pair_up(at):
            ok = at + 1 < len(sym)
            ok[ok] = wid[at[ok]] == wid[at[ok] + 1]
            out = np.full(len(at), -1)
            out[ok] = self._lookup(sym[at[ok]], sym[at[ok] + 1])
            return out

        mid = pair_up(np.arange(len(sym)))
        while len(sym):
            rank = self.rank[mid]
            starts = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
            spans = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                stay = np.repeat(live, spans)
                done_wid.append(wid[~stay]), done_sym.append(sym[~stay])
                sym, wid, mid, rank = sym[stay], wid[stay], mid[stay], rank[stay]
                spans, least = spans[live], least[live]
                if not len(sym):
                    break
            least = np.repeat(least, spans)
            at = np.flatnonzero(rank == least)
            run = np.r_[True, at[1:] != at[:-1] + 1]  # in a run of overlapping pairs, every other one is merged
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            new = mid[at]
            before = np.where(at > 0, sym[at - 1], 0)
            touching = np.r_[False, at[1:] == at[:-1] + 2]
            before[touching] = new[np.flatnonzero(touching) - 1]
            has_before = np.r_[at[0] > 0, np.ones(len(at) - 1, bool)]
            has_before &= wid[at - 1] == wid[at]
            nxt = np.minimum(at + 2, len(sym) - 1)
            has_next = (at + 2 < len(sym)) & (wid[nxt] == wid[at])
            first = np.minimum(np.where(has_before, self.rank[self._lookup(before, new)], NONE), np.where(has_next, self.rank[self._lookup(new, sym[nxt])], NONE)) <= least[at]
            if first.any():
                passed = np.cumsum(first) - first
                word = wid[at]
                lead = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                go = passed == np.repeat(passed[lead], np.diff(np.r_[lead, len(at)]))
                at, new = at[go], new[go]
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, wid, mid = sym[keep], wid[keep], mid[keep]
            at = at - np.arange(len(at))
            mid[at] = pair_up(at)
            at = at[at > 0] - 1
            mid[at] = pair_up(at)
        if not done_wid:
            return wid, sym
        wid, sym = np.concatenate(done_wid), np.concatenate(done_sym)
        order = np.argsort(wid, kind="stable")
        return wid[order], sym[order]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit bytes."""
        out = []
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            wid, sym = self.merge_rounds(some)
            bare = np.flatnonzero(sym >= self.size)
            if len(bare):  # no piece: its UTF-8 bytes
                data = [self.byte_ids[list(chr(s).encode("utf-8", "surrogatepass"))] for s in (sym[bare] - self.size).tolist()]
                width = np.ones(len(sym), np.int64)
                width[bare] = list(map(len, data))
                wide = np.repeat(sym >= self.size, width)
                wid, sym = np.repeat(wid, width), np.repeat(sym, width)
                sym[wide] = np.concatenate(data)
            ends = np.searchsorted(wid, np.arange(len(some)), "right")
            data = sym.astype("<u4").tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        return out

    def _learn(self, words: list[str]) -> None:
        """Caches the ids of words, each after a space sign. Leading letters are merged once for all marks that follow."""
        cut = []
        for w in words:
            head = _HEAD.match(w)
            n = head.end() if head and w[head.end() - 1 : head.end() + 1] not in self.together else len(w)
            cut.append((SPACE + w[:n], w[n:]))
        fresh = list({part for pair in cut for part in pair}.difference(self.parts))
        self.parts.update(zip(fresh, self._ids(fresh)))
        get = self.parts.__getitem__
        self.cache.update((w, get(a) + get(b) if b else get(a)) for w, (a, b) in zip(words, cut))

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        for cache in (self.cache, self.parts):
            if len(cache) > self.most:
                oldest = dict(islice(cache.items(), self.most // 2))  # they have the common ones
                cache.clear()
                cache.update(oldest)
        cut, fresh = [], set()
        for text in texts:
            text = text.replace(SPACE, " ")
            if not text:
                words = []
            elif not self.by_word:
                words = [text.replace(" ", SPACE)]
            elif "  " in text or text[0] == " " or text[-1] == " ":
                words = [w[1:] for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
            else:
                words = text.split(" ")
            fresh |= set(words).difference(self.cache)
            cut.append(words)
        self._learn(list(fresh))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in cut]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: the first piece loses one leading space, runs of byte pieces are read as UTF-8, each bad byte as U+FFFD."""
        ids = np.asarray(ids, np.int64).tolist()
        parts = list(map(self.surface.__getitem__, ids))
        for i, x in enumerate(ids):
            if x not in self.control:
                if x in self.first:
                    parts[i] = parts[i][1:]
                break
        if self.control.isdisjoint(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for x, part in zip(ids, parts):
            if x in self.byte_of:
                run += part
                continue
            out += [_lenient(run), part.decode()]
            run = b""
        return "".join([*out, _lenient(run)])


def _lenient(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


def model(path: str) -> PieceBpe:
    """The worker's own model of the file, kept between tasks."""
    return kept(("pieces", path), lambda: PieceBpe(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of each row.

    Null text counts as empty, which has no ids. Each row, repeated ones and those with a null id too, has its answer;
    an empty table gives an empty one, and other columns don't matter.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        decimal = [str(i) for i in range(m.size)]
        for batch, texts in pieces(batches, "text", 2_000_000):
            ids = m.encode(texts)
            decoded = [m.decode(x) for x in ids]
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            cols = [batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(",".join(map(decimal.__getitem__, x.tolist()))) for x in ids], pa.string()), pa.array(list(map(sha, decoded)), pa.string())]
            if keep_ids:
                cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
    return out.withColumnRenamed("doc_id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    """encode_decode of documents. Odd rows: see encode_decode."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
