"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Among two fingerprints that
differ in at most two bits some segment is equal, and the next one differs in at most two.
The (23, 12) Golay code is perfect: each word has one nearest codeword. The codewords nearest
to a segment and to the 23 words one bit away from it, one or six of them, are its keys, and
segments at most two bits apart share a key, that of the word between them. So fingerprints
are joined on an equal segment with a shared key of the next, and verified bit by bit. Where many share
that, they are joined on a shared key of the third segment as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .embedding_dedup import forest

SEED = 42
#: Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit polynomials by the generator."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1 == 1, GENERATOR << (bit - 11), 0)
    return left


@cache
def leaders() -> np.ndarray:
    """For each syndrome the one error pattern of at most three bits."""
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
    table = np.zeros(1 << 11, dtype=np.int64)
    table[remainders(np.array(patterns, dtype=np.int64))] = patterns
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword: its twelve upper bits, which tell codewords apart."""
    return (words ^ leaders()[remainders(words)]) >> 11


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """24 columns: the codeword indices of each word and of its 23 neighbours, with repeats."""
    around = np.r_[0, 1 << np.arange(23, dtype=np.int64)]
    return codeword_index(words[:, None] ^ around[None, :])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(join(words), SEED)
    total, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 50_000):
        part = words[at : min(at + 50_000, n) + width - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(width)), strict=False)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", width: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long; null and empty texts have 0."""
    shared.bound_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.to_pylist()], dtype=np.uint64)
            yield pa.array(found.view(np.int64), pa.int64())

    return docs.withColumn(name, of(F.col(text).cast("binary")))


def distinct_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct Golay keys of each word, in the order of rows."""
    near = np.sort(fuzzy_keys(words), axis=1)
    new = np.c_[np.ones(len(words), dtype=bool), near[:, 1:] != near[:, :-1]]
    return np.nonzero(new)[0], near[new]


def golay_keys(fingerprints: DataFrame, third: bool = False) -> DataFrame:
    """``(key, fp)``: for each segment its value with the keys of the next segment, and with ``third`` those of the third one too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp >> at) & ((1 << size) - 1) for at, size in SEGMENTS]
            found = [distinct_keys(p) for p in parts]
            for n in range(3):
                row, key = found[(n + 1) % 3]
                if third:
                    # Each of a row's keys of the next segment goes with each of its keys of the third.
                    other, more = found[(n + 2) % 3]
                    many = np.bincount(other, minlength=len(fp))
                    times = many[row]
                    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat((np.cumsum(many) - many)[row], times)
                    row, key = np.repeat(row, times), np.repeat(key, times) << 12 | more[at]
                key = np.int64(n) << 47 | parts[n][row] << 24 | key
                for first in range(0, len(key), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[first : first + 50_000]), pa.array(fp[row[first : first + 50_000]])], ["key", "fp"])

    return fingerprints.select("fp").mapInArrow(rows, "key long, fp long")


def bucket_pairs(keys: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` at two bits or fewer within buckets of up to ``bucket`` fingerprints, and the fingerprints ``(fp)`` of larger ones."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = keys.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    listed = small.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("l"))
    near = "flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), y -> bit_count(x ^ y) <= 2), y -> struct(x AS a, y AS b))))"
    pairs = listed.select(F.explode(F.expr(near)).alias("p")).select("p.a", "p.b")
    return pairs, keys.join(sizes.where(F.col("n") > bucket).select("key"), "key").select("fp").distinct()


def links(fingerprints: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect just what links at two bits or fewer connect, from distinct fingerprints.

    Buckets of up to ``bucket`` fingerprints are joined and verified. The fingerprints of larger
    ones are dealt anew by the keys of all segments. Those of buckets that are still larger, many
    fingerprints almost alike, take a way whose rows stay in proportion: each is written with all 65 words at most one
    bit away, and those that share such a word, which are just those at two bits or fewer, are
    joined to the smallest of them; at most 65 can share one.
    """
    pairs, crowded = bucket_pairs(golay_keys(fingerprints.select("fp")), bucket)
    finer, large = bucket_pairs(golay_keys(shared.settled(crowded), third=True), bucket)
    around = large.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    met = around.groupBy("word").agg(F.collect_list("fp").alias("l")).where("size(l) > 1")
    stars = met.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).where("a <> b")
    return pairs.unionByName(finer).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``, with its columns ``keep``.

    component_id is the smallest id reachable over links of at most two differing bits, the own
    id included. Null and empty texts have fingerprint 0 and link like any other. Repeated rows
    appear as often as they come. A null id gets its group's component, null if it is alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *keep)
    found = shared.settled(with_fingerprints(rows, "__text", "fp", width).select("doc_id", "fp", *keep))
    nodes = shared.settled(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = shared.components(links(nodes)).withColumnRenamed("node", "fp")
    reached = nodes.join(groups, "fp")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    named = reached.join(least, "component").select("fp", "component_id")
    of_fp = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # Between two written tables a frequent fingerprint's partition can be split.
    return found.join(shared.settled(of_fp), "fp").select("doc_id", "fp", "component_id", *keep)


WIDE = 256


def shingle_digests(text: bytes | None, width: int, wide: bool) -> Iterator[np.ndarray]:
    """A row of bytes for each shingle of ``width`` words, a bounded number at a time: its hash of eight bytes, filled up to 16 bytes or to those of a wide fingerprint."""
    words = text.lower().split() if text else []
    if not words:
        return
    join, digest = b" ".join, xxhash.xxh3_128_digest
    width = min(width, len(words))
    n = len(words) - width + 1
    for at in range(0, n, 20_000):
        part = words[at : min(at + 20_000, n) + width - 1]
        shingles = map(join, zip(*(part[i:] for i in range(width)), strict=False))
        raw = b"".join([digest(s) + digest(s, 1) for s in shingles] if wide else [digest(s) for s in shingles])
        yield np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDE // 8 if wide else 16)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    parts = [np.unique(np.ascontiguousarray(rows[:, :8]).view("<i8")) for rows in shingle_digests(text, width, False)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)


def sketch(text: bytes | None, width: int, keys: int) -> tuple[bytes, list[int], int, int]:
    """A wide fingerprint over distinct shingles of ``width`` words, the ``keys`` smallest of their hashes, a hash of all of them, as signed longs, and their number."""
    total, seen = np.zeros(WIDE, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for rows in shingle_digests(text, width, True):
        found, first = np.unique(np.ascontiguousarray(rows[:, :8]).view("<i8").ravel(), return_index=True)
        if len(seen):
            new = ~np.isin(found, seen, assume_unique=True)
            found, first = found[new], first[new]
        total += np.unpackbits(rows[first], axis=1).sum(axis=0, dtype=np.int64)
        seen = np.union1d(seen, found) if len(seen) else found
    every = int(np.array(xxhash.xxh3_64_intdigest(seen.tobytes()), dtype=np.uint64).view(np.int64))
    return np.packbits(2 * total > len(seen)).tobytes(), seen[:keys].tolist(), every, len(seen)


def with_sketches(docs: DataFrame, text: str, width: int, keys: int) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint, and ``wide``, ``keys``, ``every`` and ``n`` of the sketch; one function makes all, so that a text goes to one Python worker once."""
    shared.bound_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["fp", "wide", "keys", "every", "n"]

    @F.arrow_udf("struct<fp long, wide binary, keys array<long>, every long, n long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            fps = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
            found = [sketch(x, width, keys) for x in texts]
            columns = [fps, *([x[n] for x in found] for n in range(4))]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    made = docs.withColumn("made", of(F.col(text).cast("binary")))
    return made.withColumns({name: F.col(f"made.{name}") for name in names}).drop("made")


def most_bits(similarity: float, margin: float = 5) -> int:
    """Differing bits of wide fingerprints expected at a Jaccard similarity, and ``margin`` standard errors more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(WIDE * p + margin * math.sqrt(WIDE * p * (1 - p)))


#: Texts of fewer distinct shingles are compared by them alone, since ties of few votes make their bits differ more.
FEW = 64


def candidates(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool, similarity: float, key: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each side that may be ``similarity`` alike to some row of the other. ``same``: both sides are one.

    A side is its rows' wide fingerprints, numbers of shingles and smallest hashes, filled up with the greatest
    number. All of them have the hash ``key``; two that also share a smaller one meet there and not here.
    """
    (wide_a, n_a, keys_a), (wide_b, n_b, keys_b) = left, right
    most = most_bits(similarity)
    has_a, has_b = np.zeros(len(n_a), dtype=bool), np.zeros(len(n_b), dtype=bool)
    for at in range(0, len(n_a), step):
        n = n_a[at : at + step, None]
        bits = sum(np.bitwise_count(wide_a[at : at + step, None, w] ^ wide_b[None, :, w]).astype(np.int16) for w in range(wide_a.shape[1]))
        low = np.minimum(n, n_b)
        near = ((bits <= most) | (low < FEW)) & (low / np.maximum(n, n_b) >= similarity)
        if same:
            near &= np.arange(len(n_b)) > np.arange(at, at + len(n))[:, None]
        i, j = np.nonzero(near)
        for first in range(0, len(i), 100_000):
            x, y = at + i[first : first + 100_000], j[first : first + 100_000]
            one, other = keys_a[x], keys_b[y]
            elsewhere = ((one[:, :, None] == other[:, None, :]) & (one[:, :, None] < key)).any(axis=(1, 2))
            has_a[x[~elsewhere]], has_b[y[~elsewhere]] = True, True
    if same:
        has_a = has_b = has_a | has_b
    return has_a, has_b


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float, step: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets of distinct hashes, one of each side, whose Jaccard similarity is ``similarity`` or more."""
    sides = []
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for sets in (left, right):
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        shared_too = common[at] == values if len(common) else np.zeros(len(values), dtype=bool)
        at, rows = at[shared_too], rows[shared_too]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], rows[order], len(sets)))
    both = np.zeros((len(left), len(right)))
    for first in range(0, len(common), step):
        blocks = []
        for at, rows, size in sides:
            lo, hi = np.searchsorted(at, [first, first + step])
            block = np.zeros((size, min(step, len(common) - first)), dtype=np.float32)
            block[rows[lo:hi], at[lo:hi] - first] = 1
            blocks.append(block)
        both += blocks[0] @ blocks[1].T
    n_a, n_b = (np.array([len(x) for x in sets]) for sets in (left, right))
    return np.nonzero(both / (n_a[:, None] + n_b - both) >= similarity)


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float, width: int, rows: int = 512, hashes: int = 500_000) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints whose texts' shingles are ``similarity`` alike or more.

    ``nodes(every, fp, t, wide, keys, n)`` are the distinct sets of shingles and ``docs(t, text)`` have a
    text of each. Nodes that share one of their smallest shingle hashes meet, a pair under the smallest one that it shares; buckets of more than ``rows``
    nodes or ``hashes`` shingles are cut into chunks, and tiles of two chunks compare every pair of them. Numbers of
    shingles and wide fingerprints only tell which nodes may have a link in a tile; these come again with
    the shingles of their texts, which decide. A tile gives a spanning forest of its links.
    """
    spread = nodes.select("every", "fp", "t", "wide", "n", "keys", F.explode("keys").alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("volume")).where("met > 1")
    chunks = F.greatest(F.ceil(F.col("met") / rows), F.ceil(F.col("volume") / hashes)).cast("int")
    sized = spread.join(sizes.select("key", chunks.alias("chunks")), "key").withColumn("c", F.pmod(F.xxhash64("every"), "chunks").cast("int"))
    tile = F.expr("inline(transform(sequence(0, chunks - 1), k -> struct(least(c, k) AS c1, greatest(c, k) AS c2, CAST(k < c AS int) AS side)))")
    place = ["key", "c1", "c2"]
    met = sized.select("key", tile, "every", "fp", "t", "wide", "n", "keys")

    def sides_of(key: tuple, frame: pd.DataFrame) -> tuple[bool, list[pd.DataFrame]]:
        same = key[1] == key[2]
        return same, [frame] * 2 if same else [frame[frame["side"] == s] for s in (0, 1)]

    def filled(lists: pd.Series) -> np.ndarray:
        widest = max((len(x) for x in lists), default=0)
        found = np.full((len(lists), widest), np.iinfo(np.int64).max)
        for n, x in enumerate(lists):
            found[n, : len(x)] = x
        return found

    def near(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        same, sides = sides_of(key, frame)
        told = [(np.frombuffer(b"".join(x["wide"]), dtype=np.uint64).reshape(len(x), -1), x["n"].to_numpy(), filled(x["keys"])) for x in sides]
        found = [x[has] for x, has in zip(sides, candidates(*told, same, similarity, key[0]), strict=True)]
        return (found[0] if same else pd.concat(found))[[*place, "side", "every", "fp", "t"]]

    may = shared.settled(met.groupBy(*place).applyInPandas(near, "key long, c1 int, c2 int, side int, every long, fp long, t long"))

    @F.arrow_udf("binary")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_hashes(x, width).tobytes() for x in batch.to_pylist()], pa.binary())

    texts = docs.groupBy("t").agg(F.first("text").alias("text")).join(may.select("every", "t").distinct(), "t")
    sets = texts.select("every", hashed(F.col("text").cast("binary")).alias("set"))

    def linked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        same, sides = sides_of(key, frame)
        listed = [[np.frombuffer(x, dtype=np.int64) for x in side["set"]] for side in sides]
        if not listed[0] or not listed[1]:
            return pd.DataFrame({"a": [], "b": []})
        i, j = alike(*listed, similarity)
        fp = sides[0]["fp"].to_numpy() if same else np.r_[sides[0]["fp"].to_numpy(), sides[1]["fp"].to_numpy()]
        pairs = np.array(forest(len(fp), i, j if same else j + len(listed[0])), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    return may.drop("t").join(sets, "every").groupBy(*place).applyInPandas(linked, "a long, b long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, keys: int = 4) -> DataFrame:
    """``(doc_id, t, component, component_id)``: near duplicates under two tests, fingerprints at two bits or fewer and shared shingles.

    Two bits of 64 only hold nearly equal texts, so texts whose distinct shingles of ``width`` words
    have a Jaccard similarity of ``similarity`` are linked as well. Nulls, empty texts, repeated
    rows and ids are treated as by ``near_duplicates``. t is a hash of the text, and component tells
    groups apart whose smallest ids are the same.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    found = shared.settled(with_sketches(texts, "text", width, keys).drop("text"))
    nodes = shared.settled(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    sets = found.where("n > 0").groupBy("every").agg(F.min("fp").alias("fp"), F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("wide", "keys", "n")))
    sets = shared.settled(sets)
    # Texts of equal sets may differ in order and so in their fingerprints.
    equal = found.where("n > 0").select("every", F.col("fp").alias("b")).distinct().join(sets.select("every", F.col("fp").alias("a")), "every").where("a <> b").select("a", "b")
    edges = links(nodes.select("fp")).unionByName(similar_links(sets, texts.select("t", "text"), similarity, width)).unionByName(equal)
    groups = shared.components(edges).withColumnRenamed("node", "fp")
    reached = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = reached.join(least, "component").select("fp", "component", "component_id")
    return found.select("doc_id", "t", "fp").join(shared.settled(of_fp), "fp").select("doc_id", "t", "component", "component_id")


def op10(spark, sf_dir):
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
