"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces, found by a forward pass; that
of a text is the product over its words. Pieces never cross words, so a word's probabilities
are found once per worker and kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Runs of letters, and of signs such as fractions and circled numbers, which are neither letters nor decimal digits; those are taken out afterwards.
WORD = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are cut, in learning as in prediction, so that no product underflows.
RUN = 48
START = "▁"
UNDETERMINED = "und"


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_runs(text: str) -> list[str]:
    """All runs of letters, in order."""
    words = WORD.findall(text)
    if not all(map(str.isalpha, words)):
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


@dataclass
class PieceVocabulary:
    """Pieces of letters, with or without the word-start mark; the last row stands for a letter without a piece."""

    index: dict[str, int]
    prefixes: frozenset[str] = field(repr=False, default=frozenset())

    @classmethod
    def load(cls, path: str) -> PieceVocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        kept = [p for p in pieces if p == p.lower() and (p == START or WORD.fullmatch(p.removeprefix(START)))]
        prefixes = frozenset(p[:n] for p in kept for n in range(1, len(p) + 1))
        return cls({p: i for i, p in enumerate(kept)}, prefixes)

    def __len__(self) -> int:
        return len(self.index) + 1


def lattice(words: list[str], vocabulary: PieceVocabulary) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Edges of the words' segmentation lattices by end position as (word, start, piece) arrays in word order, and word lengths."""
    get, prefixes, unknown = vocabulary.index.get, vocabulary.prefixes, len(vocabulary) - 1
    longest = max(map(len, words), default=0) + 1
    ends: list[tuple[list, list, list]] = [([], [], []) for _ in range(longest + 1)]
    for w, word in enumerate(words):
        marked = START + word
        n = len(marked)
        for i in range(n):
            for j in range(i + 1, n + 1):
                part = marked[i:j]
                k = get(part)
                if k is None and j == i + 1:
                    k = unknown
                if k is not None:
                    at = ends[j]
                    at[0].append(w)
                    at[1].append(i)
                    at[2].append(k)
                if part not in prefixes:
                    break
    arrays = [tuple(np.array(x, dtype=np.int64) for x in at) for at in ends]
    return arrays, np.array([len(word) + 1 for word in words], dtype=np.int64)


def _first(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])


def forward(edges: list[tuple[np.ndarray, ...]], n_words: int, probabilities: np.ndarray) -> np.ndarray:
    """Summed probability of every prefix: (word, position, language)."""
    alpha = np.zeros((n_words, len(edges), probabilities.shape[1]))
    alpha[:, 0] = 1.0
    for j, (w, i, k) in enumerate(edges):
        if len(w):
            at = _first(w)
            alpha[w[at], j] = np.add.reduceat(alpha[w, i] * probabilities[k], at, axis=0)
    return alpha


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: PieceVocabulary, p: np.ndarray, step: int = 4096) -> np.ndarray:
    """Pieces' expected counts under one language, over all segmentations of the counted words."""
    total = np.zeros(len(vocabulary))
    for at in range(0, len(words), step):
        part, weight = words[at : at + step], counts[at : at + step]
        edges, lengths = lattice(part, vocabulary)
        alpha = forward(edges, len(part), p[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(part)), lengths] = 1.0
        for j in range(len(edges) - 1, 0, -1):
            w, i, k = edges[j]
            np.add.at(beta, (w, i), beta[w, j] * p[k])
        z = alpha[np.arange(len(part)), lengths]
        for j, (w, i, k) in enumerate(edges):
            if len(w):
                np.add.at(total, k, weight[w] * alpha[w, i] * p[k] * beta[w, j] / z[w])
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: PieceVocabulary
    probabilities: np.ndarray  # piece, language
    evidence: int = 20

    @property
    def key(self) -> str:
        return hashlib.sha1(self.probabilities.tobytes() + repr(self.languages).encode()).hexdigest()

    def words_of(self, text: str) -> list[str]:
        """Lower-case runs of letters, longer ones than RUN in parts."""
        words = letter_runs(text.lower())
        if any(len(w) > RUN for w in words):
            words = [w[i : i + RUN] for w in words for i in range(0, len(w), RUN)]
        return words

    def word_scores(self, words: list[str], step: int = 2048) -> np.ndarray:
        """Log probability of each word under each language."""
        found = []
        for at in range(0, len(words), step):
            part = words[at : at + step]
            edges, lengths = lattice(part, self.vocabulary)
            alpha = forward(edges, len(part), self.probabilities)
            found.append(np.log(np.maximum(alpha[np.arange(len(part)), lengths], 1e-300)))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))

    def decide(self, total: np.ndarray, n_words: int) -> tuple[str, float]:
        """Best language and its posterior, with the evidence of at most ``evidence`` average words."""
        logits = total * min(1.0, self.evidence / n_words)
        weights = np.exp(logits - logits.max())
        best = int(np.argmax(total))
        return self.languages[best], float(weights[best] / weights.sum())


class WordCache:
    """Rows of word scores per worker; emptied when full."""

    def __init__(self, model: LanguageModel, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self.row: dict[str, int] = {}
        self.scores = np.zeros((limit, len(model.languages)), dtype=np.float64)

    def rows(self, texts: list[list[str]]) -> None:
        missing = list({w for words in texts for w in words if w not in self.row})
        if len(self.row) + len(missing) > self.limit:
            self.row.clear()
            missing = list({w for words in texts for w in words})
        at = len(self.row)
        if at + len(missing) > len(self.scores):
            self.scores = np.zeros((at + len(missing), self.scores.shape[1]))
        self.scores[at : at + len(missing)] = self.model.word_scores(missing)
        self.row.update(zip(missing, range(at, at + len(missing)), strict=True))


def _cache(model: LanguageModel) -> WordCache:
    return shared.held_in_worker(("languages", model.key), lambda: WordCache(model))


def identify(texts: list[str | None], cache: WordCache) -> list[tuple[str, float]]:
    split = [cache.model.words_of(t) if t else [] for t in texts]
    cache.rows(split)
    row, scores = cache.row, cache.scores
    return [
        cache.model.decide(scores[[row[w] for w in words]].sum(axis=0), len(words)) if words else (UNDETERMINED, 0.0)
        for words in split
    ]


def fit(
    train: DataFrame,
    vocabulary_path: str | None = None,
    sample_documents: int = 2_000,
    rounds: int = 2,
    smoothing: float = 0.01,
    unknown: float = 1e-7,
) -> LanguageModel | None:
    """Piece probabilities per language from ``train(doc_id, text, lang)``; None if it has no language.

    ``sample_documents`` bounds the documents learned from, about so many, drawn by a hash of id and text, whole texts; all
    of their words are counted, and the counts are collected. Rows without
    text or language teach nothing, repeated rows count again; other columns aren't read. Starts from even
    pieces of equal length and sums over all segmentations in each round.
    """
    rows = train.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    share = min(1.0, sample_documents / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{RUN}}})"), 1)
    top = drawn.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").count().toPandas()
    languages = sorted(top["lang"].unique())
    if not languages:
        return None
    vocabulary = PieceVocabulary.load(vocabulary_path or public_vocabulary())
    columns = []
    for language in languages:
        own = top[top["lang"] == language].sort_values(["count", "word"], ascending=[False, True])
        words = own["word"].tolist()
        counts = own["count"].to_numpy(dtype=float)
        lengths = np.array([len(x) for x in vocabulary.index] + [1], dtype=float)
        p = np.exp(-2.5 * np.ones(len(vocabulary)) * lengths)
        for _ in range(rounds + 1):
            c = expected_counts(words, counts, vocabulary, p)
            p = (c + smoothing) / (c.sum() + smoothing * len(c))
        p[-1] = unknown
        columns.append(p)
    return LanguageModel(languages, vocabulary, np.stack(columns, axis=1))


def identify_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text", prediction: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score in [0, 1].

    Null texts and texts without a letter get ``und`` and 0, as does everything without a
    model. Every row is kept, repeated or not; other columns aren't read. A text's words
    stay in one batch, whose size is bounded.
    """
    if model is None:
        return docs.withColumns({prediction: F.lit(UNDETERMINED), score: F.lit(0.0)})
    shared.bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _cache(known.value)
        for batch in batches:
            found = identify(batch.to_pylist(), cache)
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([s if math.isfinite(s) else 0.0 for _, s in found], pa.float64())], ["lang", "score"]
            )

    found = docs.withColumn("__found", predict(F.col(text)))
    return found.withColumns({prediction: F.col("__found.lang"), score: F.col("__found.score")}).drop("__found")


def op1(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~shared.is_held_out(F.col("doc_id"))))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", shared.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
