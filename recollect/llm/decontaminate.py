"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ten consecutive words of an item. Hashes of five words are taken at every word,
and of each ten words, which hold six such hashes, the smallest is a fingerprint. Equal windows
choose equal fingerprints, so joining the fingerprints of items and documents meets every
shared window. A hit is then extended to the six windows that hold it, and each is joined with
the items' windows by its words. Items too short for a window are one window of their own
length; as fingerprints don't promise anything there, all word sequences of such a length
are looked up.

Texts are read once: each fingerprint takes the words around it along, and where the items'
fingerprints are few enough to be broadcast, only those that match leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW, GRAM = 10, 5
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased; a null text has none."""
    # lower() equals the translation on ASCII texts and is faster.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), SEPARATORS), lambda w: w != "")


#: A fingerprint is 33 bits of a hash; in the lower 31 bits documents keep its position, which is less than that in any array.
POSITION_BITS = 31


def item_windows(items: DataFrame) -> DataFrame:
    """``(n, window, items)``: distinct windows, n words each, space-joined, and the sorted ids that have them."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    cut = F.expr(
        f"CASE WHEN size(words) < {WINDOW} THEN array(array_join(words, ' ')) "
        f"ELSE transform(sequence(1, size(words) - {WINDOW - 1}), i -> array_join(slice(words, i, {WINDOW}), ' ')) END"
    )
    windows = rows.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("n"), F.explode(cut).alias("window"))
    return windows.groupBy("n", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def fingerprints_of(windows: DataFrame) -> DataFrame:
    """``(n, print)``: a full window's smallest hash of five words; a shorter window's hash of all its words."""
    words = windows.select("n", F.split("window", " ").alias("words"))
    least = F.expr(f"shiftrightunsigned(array_min(transform(sequence(1, {WINDOW - GRAM + 1}), i -> xxhash64(slice(words, i, {GRAM})))), {POSITION_BITS})")
    return words.select("n", F.when(F.col("n") == WINDOW, least).otherwise(F.xxhash64("words")).alias("print")).distinct()


#: Bits of the map that tells which fingerprints the items may have.
MAP_BITS = 20


def map_of(prints: list[int]) -> Column:
    """A bit for each value of the prints' lower bits, as an array of longs; few prints are told apart by it from most others."""
    bits = [0] * (1 << (MAP_BITS - 6))
    for p in prints:
        low = p & ((1 << MAP_BITS) - 1)
        bits[low >> 6] |= 1 << (low & 63)
    listed = ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)
    return F.from_json(F.lit(f"[{listed}]"), "array<bigint>")


def document_prints(docs: DataFrame, lengths: list[int], known: Column | None = None) -> DataFrame:
    """``(doc_id, sig, n_words, n, print, start, words)``: a row for each fingerprint, with the words around it, and one with n = 0 for each document, whose print is a hash of its own.

    ``lengths`` are those that the items' windows have. For one under ten each of the
    document's sequences of so many words is a fingerprint. With ``known``, a map of the items' prints,
    only those come that may be among them.
    """
    per = WINDOW - GRAM + 1
    rows = docs.select("doc_id", F.xxhash64("text").alias("sig"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = rows if known is None else rows.withColumn("known", known)
    low = (1 << MAP_BITS) - 1
    may = lambda p: f"(get(known, CAST(shiftright({p} & {low}, 6) AS int)) & shiftleft(1L, CAST({p} & 63 AS int))) != 0"
    none = "CAST(array() AS array<struct<n: int, print: bigint, start: int, words: array<string>>>)"
    # No item has such a print, so these rows meet nothing in a join, and no single key takes them all.
    lists = ["array(struct(0 AS n, xxhash64(doc_id, sig) AS print, 0 AS start, CAST(array() AS array<string>) AS words))"]
    if WINDOW in lengths:
        packed = f"transform(sequence(1, size(words) - {GRAM - 1}), i -> shiftleft(shiftrightunsigned(xxhash64(slice(words, i, {GRAM})), {POSITION_BITS}), {POSITION_BITS}) | i)"
        rows = rows.withColumn("grams", F.expr(f"CASE WHEN n_words >= {WINDOW} THEN {packed} END"))
        rows = rows.withColumn("marks", F.expr(f"array_distinct(transform(sequence(1, size(grams) - {per - 1}), s -> array_min(slice(grams, s, {per}))))"))
        met = may(f"shiftrightunsigned(p, {POSITION_BITS})")
        marks = "marks" if known is None else f"filter(marks, p -> {met})"
        place = f"CAST(p & {(1 << POSITION_BITS) - 1} AS int)"
        first = f"greatest({place} - {per - 1}, 1)"
        lists.append(
            f"coalesce(transform({marks}, p -> struct({WINDOW} AS n, shiftrightunsigned(p, {POSITION_BITS}) AS print, {first} AS start, "
            f"slice(words, {first}, {place} + {WINDOW} - {first}) AS words)), {none})"
        )
    for n in (n for n in lengths if n < WINDOW):
        hashed = f"xxhash64(slice(words, i, {n}))"
        starts = f"sequence(1, size(words) - {n - 1})" if known is None else f"filter(sequence(1, size(words) - {n - 1}), i -> {may(hashed)})"
        lists.append(
            f"CASE WHEN n_words >= {n} THEN transform({starts}, i -> struct({n} AS n, xxhash64(slice(words, i, {n})) AS print, i AS start, slice(words, i, {n}) AS words)) "
            f"ELSE {none} END"
        )
    return rows.select("doc_id", "sig", "n_words", F.expr(f"inline(concat({', '.join(lists)}))"))


def contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = 100_000, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, sig, n_words, n_hit, items``; sig is a hash of the text.

    Null texts have no words; items without words have no window, and those without an id name nothing. Rows repeated in id and text
    get the same result each; other columns aren't read. Prints and windows of up to
    ``broadcast_rows`` rows and ``broadcast_bytes`` are broadcast, more are joined by shuffles.
    """
    windows = shared.settled(item_windows(items))
    prints = shared.settled(fingerprints_of(windows))
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())
    size = F.octet_length("window") + F.coalesce(F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8), F.lit(0)) + 64
    rows, held = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    small = rows <= broadcast_rows and held <= broadcast_bytes
    side = F.broadcast if small else (lambda df: df.hint("merge"))
    known = prints.withColumn("met", F.lit(True))
    # Few prints, no more than are broadcast, also tell beforehand which words around a print needn't be taken along.
    found = document_prints(docs, lengths, map_of([r.print for r in prints.select("print").collect()]) if small else None)
    met = shared.settled(found.join(side(known), ["n", "print"], "left").where("n = 0 OR met").drop("met"))
    base = met.where("n = 0").select("doc_id", "sig", "n_words")
    starts = F.expr("transform(sequence(1, size(words) - n + 1), i -> struct(start + i - 1 AS start, array_join(slice(words, i, n), ' ') AS window))")
    extended = met.where("n > 0").select("doc_id", "sig", "n", F.explode(starts).alias("w")).select("doc_id", "sig", "n", "w.start", "w.window").distinct()
    hits = extended.join(side(windows), ["n", "window"])
    merged = F.expr(
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct("
        "'upto', greatest(a.upto, s.start + s.n - 1), 'n', a.n + greatest(0, s.start + s.n - 1 - greatest(a.upto, s.start - 1)))).n"
    )
    per_row = hits.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_row = per_row.select(F.col("doc_id").alias("h_id"), F.col("sig").alias("h_sig"), merged.alias("n_hit"), "items")
    on = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("sig") == F.col("h_sig"))
    return base.join(per_row, on, "left").select(
        "doc_id", "sig", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items")
    )


def op2(spark, sf_dir):
    found = contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT DISTINCT r, occ.n, i, item_id FROM occ JOIN wins ON occ.n = wins.n AND occ.win = wins.win),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
