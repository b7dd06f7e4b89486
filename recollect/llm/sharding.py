"""Sharding by balanced label propagation, with DataFrame functions only.

Documents of a group are linked through the group. Each starts in a shard that its id gives. In
every round the documents of a group that is in several shards read where the others are, and all
move to the shard of most of them among those with room, else to any with room. Moves
are accepted by quota, large groups first. A gathered group has no cut link left to gain, so it
stays; rounds go on until no shard has room for another group, however many that takes.

Groups of over half a shard, at most two for each shard, are laid out beforehand, and those that
are left, fewer than shards, afterwards: whole where they fit, else in as few shards as take them.
Documents without links fill the remaining room, so every shard gets its quota exactly
and counts differ by one at most. Running sums are taken in two steps, within many buckets and
over the buckets' totals, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BUCKET_ROWS = 20_000


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def running(df: DataFrame, by: list[str], order: list[str], amount: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``amount`` over the rows before each one, per ``by``, in the order of the int column ``__b`` and ``order``.

    Sums run within a bucket ``__b``; the buckets' own offsets come from a table of a row per
    bucket, about one for 20,000 rows, which a single task goes through where ``by`` is empty.
    """
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__b").agg(F.sum(amount).alias("__t"))
    across = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__b", F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__o"))
    placed = df.withColumn("__w", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return placed.join(offsets, [*by, "__b"]).withColumn(name, F.col("__w") + F.col("__o")).drop("__w", "__o")


def bucket(rows: int, *columns: str) -> Column:
    """A bucket by hash for about every 20,000 of ``rows``."""
    return F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-rows // BUCKET_ROWS)))).cast("int")


def pick(position: Column, room: list[int]) -> Column:
    """The shard into whose room a position falls when rooms are laid end to end."""
    upto, found = 0, F.lit(None).cast("int")
    ends = []
    for s, r in enumerate(room):
        upto += r
        ends.append((upto, s))
    for end, s in reversed(ends):
        found = F.when(position < end, F.lit(s)).otherwise(found)
    return found


def lay_out(sizes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``(group, shard, first, end)`` for groups ``(group, rows)``, largest first: into the tightest shard that takes all, else the emptiest ones are filled. Takes from ``room``."""
    found = []
    for group, rows in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < rows:
            fits = [(r, s) for s, r in enumerate(room) if r >= rows - at]
            left, shard = min(fits) if fits else max((r, -s) for s, r in enumerate(room))
            shard = abs(shard)
            part = min(rows - at, left)
            found.append((group, shard, at, at + part))
            room[shard] -= part
            at += part
    return found


def propagate(cells: DataFrame, room: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """Gathers groups until no shard has room for another: ``cells(unit, shard, n)``, n rows of a group that start in a shard.

    ``room`` is what each shard takes. Gives ``(unit, shard)`` of the gathered groups, ``(unit, rows)`` of the
    others, and the room left. A group that is left is larger than any room, and the rooms take all of
    them, so they are fewer than the shards. Each round gathers the first group at least of every
    shard that is asked for; a handful of rounds do in practice.
    """
    shards = len(room)
    waiting = shared.settled(cells.groupBy("unit").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("n", "shard")).alias("own")))
    gathered, number = waiting.select("unit", F.lit(0).alias("shard")).limit(0), 0
    while True:
        number += 1
        free = F.array(*[F.lit(r).cast("long") for r in room])
        state = waiting.withColumn("free", free)
        # Shards where most of the group's documents are now, else any, told by a hash so that groups spread.
        near = F.expr("array_max(transform(filter(own, c -> free[c.shard] >= rows), c -> struct(c.n AS n, -c.shard AS s)))")
        others = F.expr(f"filter(sequence(0, {shards - 1}), t -> free[t] >= rows)")
        some = F.when(F.size("others") > 0, F.get("others", F.pmod(F.xxhash64("unit", F.lit(number)), F.greatest(F.size("others"), F.lit(1))).cast("int")))
        state = state.select("unit", "rows", near.alias("near"), others.alias("others")).select("unit", "rows", F.coalesce(-F.col("near.s"), some).alias("shard"))
        state = shared.settled(state.where("shard IS NOT NULL"))
        asking = state.count()
        if not asking:
            return gathered, waiting.select("unit", "rows"), room
        # Large groups come first: the buckets of a power of two follow those of larger ones.
        ordered = state.withColumn("__b", (F.lit(62) - F.floor(F.log2("rows"))).cast("int") * max(1, -(-asking // BUCKET_ROWS)) + bucket(asking, "unit"))
        inline = running(ordered, ["shard"], ["unit"], "rows")
        taken = shared.settled(inline.where(F.col("before") + F.col("rows") <= F.get(free, F.col("shard"))).select("unit", "shard", "rows"))
        for r in taken.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
            room[r.shard] -= r.n
        gathered = gathered.unionByName(taken.select("unit", "shard"))
        waiting = shared.settled(waiting.join(taken.select("unit"), "unit", "left_anti"))


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", group: Column | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, n_links, links_cut, links_cut_before)``, one row per row of ``docs``, under the law ``rows``.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and the checksum of an empty
    one, and is linked with empty texts. Rows of equal text are linked, or those of an equal
    ``group`` if that is given (null: no links). n_links is the number of other rows linked, links_cut of those in
    another shard, links_cut_before the same at the start. Slots count from 0 in each shard without gaps.
    Repeated rows are rows like others; which of them gets which slot doesn't matter. Texts of any
    length and null ids are allowed, an empty table gives an empty result.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(content, F.md5(content.cast("binary"))) if group is None else F.when(group.isNotNull(), F.xxhash64(group))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        key.alias("unit"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = shared.settled(rows)
    n = rows.count()
    quota = quotas(n, shards)
    groups = shared.settled(rows.where("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    start = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(2)), F.lit(shards)).cast("int")
    spread = rows.join(groups, "unit", "left").withColumns({"start": F.when(F.col("rows").isNotNull(), start), "__b": bucket(n, "doc_id", "text_crc32", "row"), "one": F.lit(1)})
    spread = shared.settled(spread.withColumn("unit", F.when(F.col("rows").isNotNull(), F.col("unit"))))
    large = F.col("rows") > max(1, min(quota) // 2)
    order, room = ["doc_id", "text_crc32", "row"], list(quota)
    # Groups of over half a shard are at most two for each shard, whatever the table's size.
    parts = lay_out([(r.unit, r.rows) for r in groups.where(large).collect()], room)
    small = spread.where((F.col("rows") > 1) & ~large)
    gathered, left, room = propagate(small.groupBy("unit", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n")), room)
    parts += lay_out([(r.unit, r.rows) for r in left.collect()], room)
    # Rows of large groups, whose key is frequent, need no join.
    found = small.join(gathered, "unit", "left").select(*spread.columns, "shard")
    whole = shared.settled(found.unionByName(spread.where(large).withColumn("shard", F.lit(None).cast("int"))))
    spans = rows.sparkSession.createDataFrame(parts, "u long, shard int, first long, end long")
    inside = (F.col("unit") == F.col("u")) & (F.col("before") >= F.col("first")) & (F.col("before") < F.col("end"))
    laid = running(whole.where("shard IS NULL").drop("shard"), ["unit"], order, "one").join(F.broadcast(spans), inside)
    columns = [*spread.columns, "shard"]
    known = whole.where("shard IS NOT NULL").select(*columns).unionByName(laid.select(*columns))
    rest = running(spread.where("rows IS NULL"), [], order, "one").withColumn("shard", pick(F.col("before"), room)).select(*columns)
    every = shared.settled(known.unionByName(rest))
    slots = running(every, ["shard"], order, "one", "slot")
    linked = every.where("rows IS NOT NULL")
    together = shared.settled(linked.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n")))
    before = shared.settled(linked.groupBy("unit", "start").agg(F.count(F.lit(1)).alias("n_start")))
    shape = lambda df, *links: df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), *[x.cast("long").alias(c) for c, x in zip(("n_links", "links_cut", "links_cut_before"), links, strict=True)])
    met = slots.where("rows IS NOT NULL").join(together, ["unit", "shard"]).join(before, ["unit", "start"])
    return shape(met, F.col("rows") - 1, F.col("rows") - F.col("n"), F.col("rows") - F.col("n_start")).unionByName(shape(slots.where("rows IS NULL"), *[F.lit(0)] * 3))


def op7(spark, sf_dir):
    found = shard_documents(shared.table(spark, sf_dir, "documents"))
    return found.withColumn("grown_shard", F.lit(None).cast("int"))
