"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words by their subsequences of three letters, each occurrence weighted by
a decay to the power of its span, so that gaps and inserted characters only weaken a match.
Landmark words span the approximation. The machine is trained on labelled sentences: a sentence is
a bag of words and as toxic as its worst one, and only its label is known. So a first machine
gives each word the labels of all its sentences; then, in turn, words of toxic sentences that the
machine sets apart from those of clean sentences count as toxic, the others no longer, and the
machine is trained again. Since the kernel has an explicit feature space of three-letter sequences, the landmarks'
weights fold into one weight per sequence, and scoring a word is a sum over its sequences.
A text scores as its worst word, and the score is a logistic function fitted to the labels.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ .*_-]{1,2}[^\W\d_]){3,}(?!\S)")
#: Digits and signs written for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
ALPHABET, EDGE, OTHER = 32, 26, 27
SPAN, DECAY = 5, 0.55
#: Gaps of the second and third letter behind the first.
OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def code(letter: str) -> int:
    """Class of a letter: a-z, else one of five."""
    return ord(letter) - 97 if "a" <= letter <= "z" else OTHER + ord(letter) % (ALPHABET - OTHER)


_CODES = {chr(c): c - 97 for c in range(97, 123)}


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all words with edge marks, end to end, and the word of each."""
    flat: list[int] = []
    lengths = np.empty(len(words), dtype=np.int64)
    get = _CODES.get
    for n, word in enumerate(words):
        at = len(flat)
        flat.append(EDGE)
        for c in word:
            k = get(c)
            if k is None:
                k = _CODES[c] = code(c)
            flat.append(k)
        flat.append(EDGE)
        lengths[n] = len(flat) - at
    return np.array(flat, dtype=np.int64), np.repeat(np.arange(len(words)), lengths)


def occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, sequence, weight) of all subsequences of three letters, one gap pattern at a time."""
    codes, owner = encode(words)
    for a, b in OFFSETS:
        inside = np.flatnonzero(owner[:-b] == owner[b:]) if len(codes) > b else np.zeros(0, dtype=np.int64)
        if len(inside):
            yield owner[inside], (codes[inside] * ALPHABET + codes[inside + a]) * ALPHABET + codes[inside + b], DECAY**b


def norms(words: list[str], square: np.ndarray) -> np.ndarray:
    """Norms of the words' features from the sum of the squared weights of their occurrences.

    That sum is the squared norm where no sequence comes twice, and near it in most words; where
    letters repeat, at least twice each on average, sequences are added up first.
    """
    often = [n for n, w in enumerate(words) if 2 * len(set(w)) <= len(w)]
    if often:
        parts = [(owner * ALPHABET**3 + sequence, np.full(len(owner), weight)) for owner, sequence, weight in occurrences([words[n] for n in often])]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, dtype=np.int64), return_inverse=True)
        total = np.bincount(at, np.concatenate([w for _, w in parts]) if parts else None, minlength=len(keys))
        square = square.copy()
        square[often] = np.bincount(keys // ALPHABET**3, total * total, minlength=len(often))
    return np.sqrt(np.maximum(square, 1e-12))


def word_values(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Weighted sum over each word's sequences, divided by the word's norm."""
    total, square = np.zeros(len(words)), np.zeros(len(words))
    for owner, sequence, weight in occurrences(words):
        total += weight * np.bincount(owner, weights[sequence], minlength=len(words))
        square += weight * weight * np.bincount(owner, minlength=len(words))
    return total / norms(words, square)


def features(words: list[str]) -> np.ndarray:
    """Explicit normalised features; for landmarks only. Columns are contiguous, so that ``kernel`` reads them without a copy."""
    found = np.zeros((len(words), ALPHABET**3), dtype=np.float32, order="F")
    square = np.zeros(len(words))
    for owner, sequence, weight in occurrences(words):
        np.add.at(found, (owner, sequence), weight)
        square += weight * weight * np.bincount(owner, minlength=len(words))
    found /= norms(words, square)[:, None].astype(np.float32)
    return found


def kernel(words: list[str], landmarks: np.ndarray, map_to: np.ndarray | None = None, step: int = 250) -> np.ndarray:
    """Kernel values of words (rows) and landmarks (columns), or their products with ``map_to`` in single precision, some words at a time."""
    by_sequence = np.ascontiguousarray(landmarks.T, dtype=np.float32)
    columns, kind = (by_sequence.shape[1], np.float64) if map_to is None else (map_to.shape[1], np.float32)
    found = np.zeros((len(words), columns), dtype=kind)
    for at in range(0, len(words), step):
        part = words[at : at + step]
        values, square = np.zeros((len(part), by_sequence.shape[1])), np.zeros(len(part))
        for owner, sequence, weight in occurrences(part):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            values[owner[first]] += weight * np.add.reduceat(by_sequence[sequence], first, axis=0)
            square += weight * weight * np.bincount(owner, minlength=len(part))
        values /= norms(part, square)[:, None]
        found[at : at + len(part)] = values if map_to is None else values @ map_to
    return found


def squared_hinge(x: np.ndarray, plus: np.ndarray, minus: np.ndarray, cost: float, rounds: int = 25, step: int = 1_024) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; a row has a weight as a positive and one as a negative."""
    ridge = np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-3
    w = np.zeros(len(ridge))
    for _ in range(rounds):
        gram, right = ridge.copy(), np.zeros(len(ridge))
        for at in range(0, len(x), step):
            part = np.hstack([x[at : at + step].astype(float), np.ones((len(x[at : at + step]), 1))])
            value = part @ w
            up, down = (np.where(inside < 1, cost * c[at : at + step], 0.0) for inside, c in ((value, plus), (-value, minus)))
            gram += 2 * (part * (up + down)[:, None]).T @ part
            right += 2 * part.T @ (up - down)
        after = np.linalg.solve(gram, right)
        if np.allclose(after, w, atol=1e-7):
            break
        w = after
    return w[:-1], float(w[-1])


def fit_logistic(value: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic function, slightly shrunk."""
    x = np.stack([value, np.ones_like(value)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge, x.T @ (count * (label - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    #: Value of a text without words.
    floor: float = -1.5

    @property
    def key(self) -> str:
        return hashlib.sha1(self.weights.tobytes() + repr((self.bias, self.floor)).encode()).hexdigest()

    def values(self, words: list[str]) -> np.ndarray:
        return word_values(words, self.weights) + self.bias

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30))))


def plain(token: str) -> list[str]:
    """The token's letters without accents, where it has some."""
    if token.isascii():
        return []
    bare = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    return LETTERS.findall(bare)


def units(token: str) -> list[str]:
    """Words that a white-space token may stand for: its runs of letters, also without accents, and all its letters with look-alikes read as letters."""
    runs = LETTERS.findall(token)
    if not runs or (len(runs) == 1 and len(runs[0]) == len(token)):
        return runs + plain(token)
    core = token.strip("!?.,;:\"'()[]{}<>-")
    joined = "".join(LETTERS.findall(core.translate(LOOKALIKES)))
    found = [*runs, joined] if joined != runs[0] else runs
    return found + plain(token)


class TokenCache:
    """Values of tokens per worker; emptied when full."""

    def __init__(self, model: ToxicityModel, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self.value: dict[str, float] = {}

    def fill(self, tokens: set[str]) -> None:
        missing = [t for t in tokens if t not in self.value]
        if len(self.value) + len(missing) > self.limit:
            self.value.clear()
            missing = list(tokens)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            words: list[str] = []
            owner: list[int] = []
            for n, token in enumerate(part):
                found = units(token)
                words += found
                owner += [n] * len(found)
            best = np.full(len(part), self.model.floor)
            np.maximum.at(best, np.array(owner, dtype=np.int64), self.model.values(words))
            self.value.update(zip(part, best.tolist(), strict=True))


def _cache(model: ToxicityModel) -> TokenCache:
    return shared.held_in_worker(("toxicity", model.key), lambda: TokenCache(model))


def tokens_of(text: str) -> list[str]:
    """White-space tokens of the lower-case text, and spaced-out words put together."""
    low = text.lower()
    spaced = ["".join(LETTERS.findall(x)) for x in SPACED.findall(low)]
    return low.split() + spaced


def worst(texts: list[str | None], cache: TokenCache) -> list[float]:
    split = [tokens_of(t) if t else [] for t in texts]
    cache.fill(set().union(*split) if split else set())
    get = cache.value.__getitem__
    return [max(map(get, tokens), default=cache.model.floor) for tokens in split]


def _worst_udf(spark, model: ToxicityModel):
    shared.bound_batches(spark)
    known = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _cache(known.value)
        for batch in batches:
            yield pa.array(worst(batch.to_pylist(), cache), pa.float64())

    return value


def mangled(word: str, rng: random.Random) -> str:
    """The word with one letter put in."""
    at = rng.randrange(1, max(2, len(word)))
    return word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]


def machine(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str], cost: float = 1.0) -> ToxicityModel:
    """The kernel machine on labelled words, approximated on the span of the landmarks."""
    basis = features(landmarks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    distinct, at = np.unique(np.array(words, dtype=object), return_inverse=True)
    plus, minus = (np.bincount(at, np.where(sign * y > 0, weight, 0.0), minlength=len(distinct)) for sign in (1, -1))
    w, bias = squared_hinge(kernel(distinct.tolist(), basis, root), plus, minus, cost)
    return ToxicityModel((basis.T @ (root @ w).astype(np.float32)).astype(float), bias)


def train_words(positive: list[str], negative: list[str], counts: list[float] | None = None, landmarks: int = 160, seed: int = 7) -> ToxicityModel:
    """A machine that tells words of two lists apart; variants of positive words with a letter put in are trained on too.

    ``positive`` comes in the order of ``counts``, whose square roots weigh the words, variants a quarter
    as much. Half of the landmarks are positive words. The others are negative words: the first ones at
    first, then, in a second fit, those that the first one takes for the most toxic.
    """
    rng = random.Random(seed)
    of = np.sqrt(np.array(counts or [1] * len(positive), dtype=float))
    of = np.maximum(of / np.median(of), 0.5)
    pairs = [(mangled(w, rng), x / 4) for w, x in zip(positive, of, strict=True) for _ in range(2) if len(w) > 3]
    words = positive + [w for w, _ in pairs] + negative
    y = np.r_[np.ones(len(positive) + len(pairs)), -np.ones(len(negative))]
    plus = np.r_[of, [x for _, x in pairs]]
    weight = np.r_[plus * max(1.0, 2_000 / plus.sum()), np.full(len(negative), max(1.0, 2_000 / max(1, len(negative))))]
    others = negative
    for _ in range(2):
        chosen = positive[: landmarks // 2]
        model = machine(words, y, weight, chosen + others[: landmarks - len(chosen)])
        others = [negative[i] for i in np.argsort(-model.values(negative), kind="stable")]
    return model


def train_sentences(words: list[str], bad: np.ndarray, good: np.ndarray, landmarks: int = 160, rounds: int = 2) -> tuple[ToxicityModel, list[str], list[float]] | None:
    """A machine from words that come in toxic sentences of ``bad`` texts and clean ones of ``good`` texts each, the words that it takes for toxic and how often they come.

    None where nothing in the toxic sentences stands out.
    """
    bad, good = np.asarray(bad, dtype=float), np.asarray(good, dtype=float)
    if not bad.any() or not good.any():
        return None
    rate = bad.sum() / good.sum()
    excess = (bad - rate * good) / np.sqrt(bad + rate * good)
    by_excess, by_good = np.argsort(-excess, kind="stable"), np.argsort(-good, kind="stable")
    chosen = [words[i] for i in by_excess[: landmarks // 2]]
    taken = set(chosen)
    chosen += [words[i] for i in by_good if good[i] > 0 and words[i] not in taken][: landmarks - len(chosen)]
    both = [*np.flatnonzero(bad), *np.flatnonzero(good)]
    y = np.r_[np.ones(np.count_nonzero(bad)), -np.ones(np.count_nonzero(good))]
    # Toxic and clean sentences weigh the same in all.
    model = machine([words[i] for i in both], y, 50_000 * np.r_[bad[bad > 0] / bad.sum(), good[good > 0] / good.sum()], chosen)
    # Clean sentences hold no toxic word, so one that comes in them as often is none, nor is one that comes so rarely that
    # in one of a hundred tables some word would be in as many toxic texts by chance; where few texts are labelled, the words nearest to that are taken.
    # What clean words reach tells what the first machine sets apart.
    part = bad.sum() / (bad.sum() + good.sum())
    chance = bad * np.log(np.maximum(bad, 1) / ((bad + good) * part)) + good * np.log(np.maximum(good, 1) / ((bad + good) * (1 - part)))
    mostly = (bad > good) & (chance > min(np.log(len(words) / 0.01), 0.5 * chance[bad > good].max(initial=0.0)))
    for turn in range(rounds):
        value = model.values(words)
        limit = np.quantile(value[~mostly], 0.99) if turn == 0 and not mostly.all() else 0.0
        witness = np.flatnonzero(mostly & (value > limit))
        witness = witness[np.argsort(-bad[witness], kind="stable")]
        told = set(witness.tolist())
        others = [words[i] for i in by_good if good[i] > 0 and i not in told]
        if not len(witness) or not others:
            return None
        positive, counts = [words[i] for i in witness], bad[witness].tolist()
        model = train_words(positive, others, counts, landmarks)
    return model, positive, counts


def sentences_of(rows: DataFrame, longest: int = 30) -> DataFrame:
    """``(words, toxic, t)``: the distinct sentences of ``rows(text, toxic)`` as lists of distinct words, in parts of ``longest`` words.

    A sentence has its texts' label, and is clean if one of them is; t is one of these texts, by hash.
    """
    cut = rows.select("toxic", F.xxhash64("text").alias("t"), F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence"))
    listed = cut.select("toxic", "t", F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"(\p{L}+)"), 1)).alias("w")).where("size(w) > 0")
    parts = listed.select("toxic", "t", F.explode(F.expr(f"transform(sequence(0, (size(w) - 1) div {longest}), i -> slice(w, i * {longest} + 1, {longest}))")).alias("words"))
    return parts.groupBy("words").agg(F.min("toxic").alias("toxic"), F.min("t").alias("t"))


def fit(train: DataFrame, sample_sentences: int = 8_000, hard_words: int = 2_500) -> ToxicityModel | None:
    """A model from ``train(doc_id, text, toxic)``; None without labels of both kinds or where nothing stands out in toxic sentences.

    The machine is trained on the words of about ``sample_sentences`` distinct sentences of each label at most, drawn by a
    hash, counted by the texts of all sentences; the bound on labelled documents is ``labelled``'s. The ``hard_words`` words of clean sentences that
    it takes for the most toxic are then learned from as well. The logistic function is fitted to all the labelled texts.
    Null texts and labels teach nothing; repeated sentences count once, words of any length count.
    """
    spark = train.sparkSession
    rows = shared.settled(train.where("text IS NOT NULL AND toxic IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic")))
    sentences = shared.settled(sentences_of(rows))
    of = {r.toxic: r.n for r in sentences.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not of.get(0) or not of.get(1):
        return None
    share = F.when(F.col("toxic") == 1, F.lit(sample_sentences / of[1])).otherwise(F.lit(sample_sentences / of[0]))
    drawn = F.pmod(F.xxhash64("words"), F.lit(1 << 20)) <= share * (1 << 20)
    places = sentences.select("toxic", "t", drawn.cast("int").alias("drawn"), F.explode("words").alias("word"))
    texts = places.groupBy("word", "t").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"), F.max("drawn").alias("drawn"))
    counted = shared.settled(texts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("drawn").alias("drawn")))
    listed = counted.where("drawn = 1").select("word", "bad", "good").toPandas().sort_values("word")
    found = train_sentences(listed["word"].tolist(), listed["bad"].to_numpy(), listed["good"].to_numpy())
    if found is None:
        return None
    model, positive, weights = found
    scored = counted.where("good > 0").select("word", _worst_udf(spark, model)("word").alias("value"))
    hard = [r.word for r in scored.orderBy(F.desc("value"), "word").limit(hard_words).collect()]
    usual = listed[listed["good"] > 0].sort_values(["good", "word"], ascending=[False, True])["word"].tolist()
    told = set(positive)
    model = train_words(positive, list(dict.fromkeys(w for w in [*hard, *usual] if w not in told)), weights)
    scored = rows.select("toxic", F.round(_worst_udf(spark, model)("text"), 3).alias("value")).groupBy("toxic", "value").count().toPandas()
    model.slope, model.offset = fit_logistic(*(scored[c].to_numpy(float) for c in ("value", "toxic", "count")))
    model.floor = min(model.floor, float(scored["value"].min()))
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample_documents: int = 12_000) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most about ``sample_documents`` labelled documents outside the held-out quarter, drawn by a hash of the id.

    Rows without id or label are left out; of several labels of an id the greatest holds.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~shared.is_held_out(F.col("doc_id")))
    part = min(1.0, sample_documents / max(1, marks.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1
    marks = marks.where(drawn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.where(drawn).select("doc_id", "text").join(marks, "doc_id")


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", score: str = "tox_score") -> DataFrame:
    """``docs`` with a score in [0, 1].

    Null and empty texts get the score of a text without words; without a model every score is 0.
    Repeated rows are scored alike; other columns aren't read.
    """
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    a, b = F.lit(model.slope), F.lit(model.offset)
    found = docs.withColumn("__value", _worst_udf(docs.sparkSession, model)(F.col(text)))
    return found.withColumn(score, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("__value") + b))))).drop("__value")


def op9(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled(docs, shared.table(spark, sf_dir, "labels")))
    found = score_toxicity(docs, model)
    return found.select(
        "doc_id", shared.is_held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted")
    )
