"""Relations as versions of slots, folded from an append-only log of assertions.

An assertion names subject, type and object, and may name a subtype. While a slot's live edge
agrees with the next assertion it is reinforced; when it doesn't, the edge is closed at that
time and a new one supersedes it. What a slot is depends on the type's class. Three classes
are windows over the log; the fourth depends on the order in a way that windows can't follow
and is folded per subject and type, as an expression over the sorted assertions.

Edges come with ``subject, type, object, subtype, version, valid_from, valid_until, first_seq, access_count,
last_accessed, confidence``, the qualifiers and who made them, ``source_docs`` in the order of arrival (agents' assertions
add a mark of their session and turn), ``edge_id``, ``supersedes_edge_id`` and ``superseded_by_doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of these the last value that isn't null holds.
QUALIFIERS = ["quantity_value", "quantity_unit", "quantity_kind", "time_scope"]
#: These are the first assertion's.
MAKERS = ["created_by", "session_id", "turn_id"]
#: Columns of an assertion besides its ids; missing ones are null.
OPTIONAL = {"subtype": "string", "confidence": "double", "source_doc": "string"} | dict.fromkeys([*QUALIFIERS, *MAKERS], "string")
#: What the new entries of an edge's sources are, in SQL, from an assertion ``{r}``.
SOURCES = (
    "filter(array({r}source_doc, CASE WHEN {r}created_by = 'agent' THEN concat('agent:', coalesce({r}session_id, '?'), ':', coalesce({r}turn_id, '?')) END), x -> x IS NOT NULL)"
)


def shaped(assertions: DataFrame) -> DataFrame:
    """Assertions with all optional columns."""
    return assertions.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in assertions.columns})


def reject_incomplete(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable assertions, and those without a subject, object or type."""
    ok = F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("type").isNotNull() & (F.trim("type") != "")
    return assertions.where(ok), assertions.where(~F.coalesce(ok, F.lit(False)))


def _edges(rows: DataFrame, keys: list[str], object_column: Column) -> DataFrame:
    """Aggregates rows of one edge; qualifiers keep the last value that isn't null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("subtype", *QUALIFIERS)]
    first = [F.min_by(c, "seq").alias(c) for c in MAKERS]
    docs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.expr(SOURCES.format(r="")).alias("s")))), lambda x: x["s"])))
    return rows.groupBy(*keys).agg(
        object_column.alias("object"), F.min("ts").alias("valid_from"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("access_count"),
        F.max("ts").alias("last_accessed"), F.max("confidence").alias("confidence"), *last, *first, docs.alias("source_docs"), F.min_by("source_doc", "seq").alias("first_doc"),
    )


def edge_id(*more: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("subject", "type", "object", *more, "version")]), 256)


def additive(assertions: DataFrame) -> DataFrame:
    """One edge for each subject, type and object; never superseded."""
    rows = shaped(assertions).withColumn("o", F.col("object"))
    found = _edges(rows, ["subject", "type", "o"], F.first("object"))
    none = {"valid_until": F.lit(None).cast(rows.schema["ts"].dataType), "supersedes_edge_id": F.lit(None).cast("string"), "superseded_by_doc": F.lit(None).cast("string")}
    return found.drop("o", "first_doc").withColumns({"version": F.lit(1)} | none).withColumn("edge_id", edge_id())


def _islands(rows: DataFrame, slot: list[str], starts: Column) -> DataFrame:
    order = Window.partitionBy(*slot).orderBy("seq")
    return rows.withColumn("version", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def _closed(edges: DataFrame, slot: list[str], *more: str) -> DataFrame:
    order = Window.partitionBy(*slot).orderBy("version")
    named = edges.withColumn("edge_id", edge_id(*more))
    after = {"valid_until": F.lead("valid_from").over(order), "superseded_by_doc": F.lead("first_doc").over(order), "supersedes_edge_id": F.lag("edge_id").over(order)}
    return named.withColumns(after).drop("first_doc")


def subject_keyed(assertions: DataFrame) -> DataFrame:
    """A subject has one live object for each type; another object supersedes it, and coming back to an old one makes a new edge."""
    slot = ["subject", "type"]
    before = F.lag("object").over(Window.partitionBy(*slot).orderBy("seq"))
    rows = _islands(shaped(assertions), slot, before.isNull() | (before != F.col("object")))
    return _closed(_edges(rows, [*slot, "version"], F.first("object")), slot)


def object_keyed(assertions: DataFrame) -> DataFrame:
    """A subject and object have one live edge for each type; another subtype supersedes it, a null one agrees with any."""
    slot = ["subject", "type", "object"]
    order = Window.partitionBy(*slot).orderBy("seq")
    known = F.last("subtype", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(order) == 1
    rows = _islands(shaped(assertions), slot, first | (F.col("subtype").isNotNull() & known.isNotNull() & (known != F.col("subtype"))))
    edges = _edges(rows.withColumnRenamed("object", "o"), ["subject", "type", "o", "version"], F.first("o"))
    return _closed(edges, ["subject", "type", "o"]).drop("o")


def subtype_keyed_single(assertions: DataFrame) -> DataFrame:
    """As ``subtype_keyed`` where each object comes with one subtype only: a subject has one live object for each type and subtype."""
    slot = ["subject", "type", "slot_subtype"]
    rows = shaped(assertions).withColumn("slot_subtype", F.col("subtype"))
    before = F.lag("object").over(Window.partitionBy(*slot).orderBy("seq"))
    rows = _islands(rows, slot, before.isNull() | (before != F.col("object")))
    return _closed(_edges(rows, [*slot, "version"], F.first("object")), slot, "slot_subtype").drop("slot_subtype")


class SlotFold:
    """Live edges of one subject and subtype-keyed type, folded assertion by assertion.

    An assertion of a live object reinforces its edge whatever the subtype, and the newer
    subtype wins, so two edges may come to share a slot; a later assertion closes the older.
    """

    def __init__(self) -> None:
        self.live: list[dict] = []
        self.versions = 0

    def apply(self, row: dict) -> tuple[str, dict | None]:
        """Outcome and the edge that was closed, if any."""
        for edge in self.live:
            if edge["object"] == row["object"]:
                edge["access_count"] += 1
                edge["last_accessed"] = row["ts"]
                edge["confidence"] = max((x for x in (edge["confidence"], row["confidence"]) if x is not None), default=None)
                edge["subtype"] = row["subtype"] if row["subtype"] is not None else edge["subtype"]
                return "reinforced", None
        closed = None
        if row["subtype"] is not None:
            closed = next((e for e in self.live if e["subtype"] == row["subtype"]), None)
        if closed is not None:
            self.live.remove(closed)
            closed["valid_until"] = row["ts"]
        self.versions += 1
        self.live.append({
            "object": row["object"], "subtype": row["subtype"], "version": self.versions, "valid_from": row["ts"], "valid_until": None,
            "access_count": 1, "last_accessed": row["ts"], "confidence": row["confidence"],
        })
        return ("superseded" if closed is not None else "created"), closed


#: Assertions folded in one part; the closed edges of a part are gathered in an array of their own, since appending copies one.
PART = 256


def subtype_keyed(assertions: DataFrame) -> DataFrame:
    """A subject has one live object for each type and subtype, by the ordered fold that ``SlotFold`` states.

    The fold is an expression over a subject and type's sorted assertions, which come together in one row.
    """
    rows = shaped(assertions)
    kept = ["seq", "ts", "object", "subtype", "confidence", "source_doc", *QUALIFIERS, *MAKERS]
    log = F.array_sort(F.collect_list(F.struct(*kept)))
    types = {c: rows.schema[c].dataType.simpleString() for c in kept}
    fields = {
        "object": types["object"], "subtype": "string", "version": "int", "valid_from": types["ts"], "valid_until": types["ts"], "first_seq": types["seq"], "access_count": "bigint",
        "last_accessed": types["ts"], "confidence": types["confidence"], "source_docs": "array<string>", **dict.fromkeys([*QUALIFIERS, *MAKERS, "edge_id", "supersedes_edge_id", "superseded_by_doc"], "string"),
    }
    edge = f"struct<{', '.join(f'{c}: {t}' for c, t in fields.items())}>"
    made = lambda values: f"CAST(named_struct({', '.join(f'{c!r}, {values[c]}' for c in fields)}) AS {edge})"
    # The live edge whose slot the assertion takes.
    old = "get(filter(s.live, e -> e.subtype = r.subtype), 0)"
    number = "CAST(subject AS string), type, CAST(r.object AS string), CAST(s.versions + 1 AS string)"
    new = made(
        {c: f"r.{c}" for c in ("object", "subtype", "confidence", *QUALIFIERS, *MAKERS)}
        | {"version": "s.versions + 1", "valid_from": "r.ts", "valid_until": "NULL", "first_seq": "r.seq", "access_count": "1", "last_accessed": "r.ts", "source_docs": SOURCES.format(r="r.")}
        | {"edge_id": f"sha2(concat_ws('|', {number}), 256)", "supersedes_edge_id": f"{old}.edge_id", "superseded_by_doc": "NULL"}
    )
    same = {c: f"e.{c}" for c in fields}
    again = made(
        same | {c: f"coalesce(r.{c}, e.{c})" for c in ("subtype", *QUALIFIERS)}
        | {"access_count": "e.access_count + 1", "last_accessed": "r.ts", "confidence": "greatest(e.confidence, r.confidence)", "source_docs": f"array_distinct(concat(e.source_docs, {SOURCES.format(r='r.')}))"}
    )
    closed = f"transform(filter(array({old}), e -> e IS NOT NULL), e -> {made(same | {'valid_until': 'r.ts', 'superseded_by_doc': 'r.source_doc'})})"
    state = f"struct<live: array<{edge}>, closed: array<{edge}>, versions: int>"
    step = (
        f"CASE WHEN exists(s.live, e -> e.object = r.object) THEN CAST(named_struct('live', transform(s.live, e -> CASE WHEN e.object = r.object THEN {again} ELSE e END), 'closed', s.closed, 'versions', s.versions) AS {state}) "
        f"ELSE CAST(named_struct('live', array_append(filter(s.live, e -> NOT (e.version <=> {old}.version)), {new}), 'closed', concat(s.closed, {closed}), 'versions', s.versions + 1) AS {state}) END"
    )
    part = f"aggregate(slice(log, b * {PART} + 1, {PART}), CAST(named_struct('live', a.live, 'closed', array(), 'versions', a.versions) AS {state}), (s, r) -> {step})"
    outer = f"struct<live: array<{edge}>, parts: array<array<{edge}>>, versions: int>"
    whole = (
        f"aggregate(sequence(0, (size(log) - 1) div {PART}), CAST(named_struct('live', array(), 'parts', array(), 'versions', 0) AS {outer}), "
        f"(a, b) -> get(transform(array({part}), p -> CAST(named_struct('live', p.live, 'parts', array_append(a.parts, p.closed), 'versions', p.versions) AS {outer})), 0), "
        "a -> concat(flatten(a.parts), a.live))"
    )
    folded = rows.groupBy("subject", "type").agg(log.alias("log"))
    return folded.select("subject", "type", F.explode(F.expr(whole)).alias("e")).select("subject", "type", "e.*")


def outcome_of(assertions: DataFrame, edges: DataFrame) -> DataFrame:
    """``assertions`` with ``outcome``: what each did to the edges that were folded from them; created, superseded (and made a new edge) or reinforced."""
    started = edges.select("subject", "type", F.col("first_seq").alias("seq"), F.when(F.col("supersedes_edge_id").isNotNull(), "superseded").otherwise("created").alias("outcome"))
    return assertions.join(started, ["subject", "type", "seq"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("reinforced")))


def current(edges: DataFrame) -> DataFrame:
    return edges.where("valid_until IS NULL")


def superseded(edges: DataFrame) -> DataFrame:
    return edges.where("valid_until IS NOT NULL")


def as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Edges that were live at a time (an extension)."""
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def outcomes(assertions: DataFrame) -> DataFrame:
    """Subject-keyed assertions with what each did: created, superseded or reinforced."""
    before = F.lag("object").over(Window.partitionBy("subject", "type").orderBy("seq"))
    did = F.when(before.isNull(), "created").when(before != F.col("object"), "superseded").otherwise("reinforced")
    return assertions.withColumn("outcome", did)
