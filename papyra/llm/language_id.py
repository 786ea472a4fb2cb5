"""Language identification: per-language piece probabilities, summed over all segmentations by a forward algorithm."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import kept, pieces, table, text_or_empty

SPACE = "▁"
#: Documents of a language that the model is fitted on, about; and the most languages a model may have, for its memory: more are refused, none is left out.
SAMPLE_DOCS, MOST_LANGUAGES = 1500, 500
#: Rounds of expectation maximisation; pseudo-counts drawn from the pooled probabilities; log probability of a letter that is no piece.
ROUNDS, PRIOR, UNKNOWN = 3, 50.0, -16.0
MOST_WORDS, MOST_PIECE = 300_000, 12
#: Tasks that the fit is dealt to: its words are those of a bounded sample.
FIT_PARTS = 16
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case; none if the text has no letter."""
    found = _WORD.findall(text.lower())
    return found if any(w.isalpha() or any(c.isalpha() for c in w) for w in found) else []


class Lattice:
    """All pieces of a fixed vocabulary at all places of words; words begin with a space sign."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        self.levels = []  # for each length: hashes of the prefixes of that length, ascending, and their piece or -1
        table: dict[int, dict[int, int]] = {}
        for i, p in enumerate(vocabulary):
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * int(_P) + ord(c) + 1) & (1 << 64) - 1
                table.setdefault(n, {}).setdefault(h, -1)
            table[len(p)][h] = i
        for n in range(1, max(table, default=0) + 1):
            hashes = sorted(table[n])
            self.levels.append((np.array(hashes, np.uint64), np.array([table[n][h] for h in hashes], np.int64)))

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(from node, to node, piece) sorted by place of the to node in its word; that place; first and last node of each word."""
        marked = [SPACE + w for w in words]
        lengths = np.array(list(map(len, marked)), np.int64)
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.r_[0, np.cumsum(lengths)]
        left = first[1:][word] - np.arange(len(code))  # characters from here to the word's end
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        found = []
        for n, (hashes, ids) in enumerate(self.levels, 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits] * _P + code[at[fits] + n - 1] + np.uint64(1)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[k] == h
            at, h, piece = at[known], h[known], ids[k[known]]
            if n == 1:
                single = np.full(len(code), self.size)
                single[at] = np.where(piece >= 0, piece, self.size)
                found.append((np.arange(len(code)), np.ones(len(code), np.int64), single))
            else:
                some = piece >= 0
                found.append((at[some], np.full(int(some.sum()), n), piece[some]))
        start, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.arange(len(code)), np.ones(len(code), np.int64), np.full(len(code), self.size))
        place = start - first[word[start]] + length
        order = np.lexsort((start + length, place))
        start, length, piece, place = (x[order] for x in (start, length, piece, place))
        node = start + word[start]  # a word has a node more than characters
        return node, node + length, piece, place, first[:-1] + np.arange(len(words)), first[1:] + np.arange(len(words))


def _sum_by(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sum of exponentials over equal neighbours in at."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    top = np.maximum.reduceat(values, starts)
    sums = np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.r_[starts, len(at)]), axis=0)), starts)
    return at[starts], top + np.log(sums)


def forward(lattice: Lattice, logp: np.ndarray, words: list[str], counts: np.ndarray | None = None):
    """Log probability of each word in each language, over all segmentations; with counts of (word, language), the pieces' expected counts."""
    if not words:
        return np.zeros((0, logp.shape[1]))
    a, b, piece, place, begin, end = lattice.edges(words)
    alpha = np.full((int(end[-1]) + 1, logp.shape[1]), -np.inf)
    alpha[begin] = 0
    cuts = np.searchsorted(place, np.arange(1, int(place[-1]) + 2))
    for i, j in zip(cuts, cuts[1:]):
        at, total = _sum_by(b[i:j], alpha[a[i:j]] + logp[piece[i:j]])
        alpha[at] = total
    if counts is None:
        return alpha[end]
    word = np.repeat(np.arange(len(words)), end - begin + 1)
    order = np.lexsort((a, -(a - begin[word[a]])))
    a, b, piece = a[order], b[order], piece[order]
    back = (a - begin[word[a]])[::-1]
    beta = np.full_like(alpha, -np.inf)
    beta[end] = 0
    cuts = len(a) - np.searchsorted(back, np.arange(0, int(back[-1]) + 2))
    for j, i in reversed(list(zip(cuts, cuts[1:]))):
        at, total = _sum_by(a[i:j], beta[b[i:j]] + logp[piece[i:j]])
        beta[at] = total
    weight = np.exp(alpha[a] + logp[piece] + beta[b] - alpha[end][word[a]]) * counts[word[a]]
    out = np.zeros((lattice.size + 1, logp.shape[1]))
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(piece, weight[:, k], lattice.size + 1)
    return out


def _first_guess(lattice: Lattice, langs: int) -> np.ndarray:
    logp = np.full((lattice.size + 1, langs), -np.log(max(lattice.size, 1)))
    logp[-1] = UNKNOWN
    return logp


def _next_guess(total: np.ndarray) -> np.ndarray:
    """Log probabilities from the pieces' expected counts, drawn towards those of all languages; the last row is for letters that are no piece."""
    total = total[:-1]
    pooled = (total.sum(axis=1) + 0.1) / (total.sum() + 0.1 * len(total))
    logp = np.log((total + PRIOR * pooled[:, None]) / (total.sum(axis=0) + PRIOR))
    return np.concatenate([logp, np.full((1, logp.shape[1]), UNKNOWN)])


def fit_pieces(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of (piece, language) by expectation maximisation over the words' counts, all at once."""
    logp = _first_guess(lattice, counts.shape[1])
    for _ in range(rounds):
        logp = _next_guess(forward(lattice, logp, words, counts))
    return logp


def fit_pieces_by_parts(vocabulary: list[str], words: DataFrame, langs: int, rounds: int = ROUNDS) -> np.ndarray:
    """fit_pieces of rows (word, counts array<double>), a part in each task: expected counts are summed up there, one matrix each, and words stay where they are."""
    logp = _first_guess(Lattice(vocabulary), langs)
    key = uuid.uuid4().hex
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lattice = kept(("lattice", key), lambda: Lattice(vocabulary))
            total = np.zeros((lattice.size + 1, langs))
            for batch in batches:
                if batch.num_rows:
                    total += forward(lattice, logp, batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, langs))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        parts = sorted(r["total"] for r in words.mapInArrow(expect, "total binary").collect())  # FIT_PARTS at most; sorted, so that sums are the same each time
        logp = _next_guess(sum(np.frombuffer(x).reshape(logp.shape) for x in parts))
    return logp


class LanguageModel:
    def __init__(self, vocabulary: list[str], languages: list[str], logp: np.ndarray):
        self.key, self.vocabulary, self.languages, self.logp = uuid.uuid4().hex, vocabulary, languages, logp


class Scorer:
    """A worker's memory of words' log probabilities."""

    def __init__(self, model: LanguageModel, most_words: int = MOST_WORDS):
        self.model, self.most, self.lattice = model, most_words, Lattice(model.vocabulary)
        self.clear()

    def clear(self):
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its posterior with equal priors) of each text."""
        if len(self.cache) > self.most:
            self.clear()
        cut, fresh = [], set()
        for t in texts:
            words = words_of(t)
            fresh |= set(words).difference(self.cache)
            cut.append(words)
        fresh = sorted(fresh)
        n = len(self.cache)
        self.cache.update(zip(fresh, range(n, n + len(fresh))))
        new = [forward(self.lattice, self.model.logp, fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
        self.table = np.concatenate([self.table, *new])
        get, out = self.cache.__getitem__, []
        for words in cut:
            if not words or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def public_vocabulary(path: str, most: int = MOST_PIECE) -> list[str]:
    """Pieces of a SentencePiece model that are lower-case letters, with or without a space sign before; and that sign."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return sorted({SPACE} | {p for p in names if p.lstrip(SPACE).isalpha() and p.count(SPACE) <= 1 and p == p.lower() and len(p) <= most})


def held_out(id_col) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit_language_model(labelled: DataFrame, vocabulary: list[str], lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fits on about `sample_docs` rows of each language, drawn by a hash of the key; only pieces' expected counts reach the driver, not texts or words.

    Rows without text or language are left out. No labelled row at all gives a model without languages; more than
    MOST_LANGUAGES languages raise an error. Repeated rows are drawn together; other columns don't matter.
    """
    rows = labelled.select(F.col(key_col).cast("string").alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: group them first")
    if not sizes:
        return LanguageModel(vocabulary, [], np.zeros((len(vocabulary) + 1, 0)))
    share = rows.sparkSession.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit("language sample")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(share), "lang").filter(drawn).select("lang", "text")  # at most MOST_LANGUAGES rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            seen: dict[tuple[str, str], int] = {}
            for lang, t in zip(batch.column(0).to_pylist(), texts):
                for w in words_of(t):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    found = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    by_lang = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))  # MOST_LANGUAGES entries at most
    words = by_lang.select("word", F.transform(F.array(*map(F.lit, languages)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0)).cast("double")).alias("counts"))
    words = table(words.repartition(FIT_PARTS, "word").sortWithinPartitions("word"), "language-words")
    return LanguageModel(vocabulary, languages, fit_pieces_by_parts(vocabulary, words, len(languages)))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of each row. Null texts and those without letters are `und`, score 0.

    Repeated rows have the same answer, an empty table gives an empty one, and other columns don't matter.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("language", model.key), lambda: Scorer(model))
        for batch, texts in pieces(batches, "text", 4_000_000):
            found = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows whose crc32 of the id, as text, isn't divisible by 5, applied to all.

    A null id counts as the empty text for that: crc32 is 0, so such rows are held out.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    model = fit_language_model(docs.filter(~out), vocabulary)
    found = predict_language(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """identify of documents with the lower-case pieces of the public vocabulary. Odd rows: see predict_language."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, public_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
