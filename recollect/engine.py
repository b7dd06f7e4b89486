"""The memory as a whole: ingest, write-back, search, history, status and ad-hoc queries over stored tables.

Every change is a batch of rows added to tables under one folder, committed at once; nothing is rewritten. Relations, access
counters, aliases, mentions and conversations are views of the logs. An ingest handles its documents as one batch against what
was stored before, in the order of their arrival. A batch that fails leaves nothing behind and can be tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vocabulary as V
from .functions.scoring import Weights
from .operators import chunking, coerce, facts, graph, provenance, retrieve, status, vectors
from .plans import adhoc
from .profiles import PROFILES
from .sources.files import Batch, Store, numbered_turns, quarantine, text_documents

SEQ = "struct<batch: long, at: long, n: long>"
SCHEMAS = {
    "documents": "doc_id string, content_hash string, title string, source_type string, ingested_at timestamp",
    "chunks": "chunk_id string, doc_id string, chunk_index int, text string, embedding array<float>",
    "entities": "entity_id string, name string, type string, subtype string, source_doc string, confidence double, canonical boolean, created_by string, session_id string, turn_id string, created_at timestamp, embedding array<float>",
    "same_as": "alias_id string, alias string, canonical_id string, confidence double, method string",
    "extracted": "entity_id string, doc_id string",
    "turns": "session_id string, turn_id string, turn_key string, role string, ts timestamp",
    "explicit": "session_id string, turn_id string",
    "ingested": "doc_id string, turn_key string",
    "mentions": "entity_id string, turn_key string, confidence double, created_at timestamp",
    "assertions": f"seq {SEQ}, ts timestamp, subject string, type string, object string, subtype string, confidence double, source_doc string, quantity_value string, quantity_unit string, quantity_kind string, time_scope string, created_by string, session_id string, turn_id string",
    "rejected": "doc_id string, n long, subject string, object string, raw_type string, reason string, ts timestamp",
    "touches": "kind string, id string, ts timestamp",
    "metrics": "batch long, stage string, rows long, ts timestamp",
}
#: An extractor gives, for documents (doc_id, text), mentions and relations between them.
Extraction = tuple[DataFrame, DataFrame]


class Engine:
    """``extract`` maps documents to ``mentions(doc_id, position, name, raw_type, confidence)`` and ``relations(doc_id, n, subject, object, raw_type, subtype, confidence)``; relations may have the qualifiers' columns besides."""

    def __init__(self, spark: SparkSession, folder: str, extract: Callable[[DataFrame], Extraction], encoder: chunking.HashingEncoder | None = None) -> None:
        self.spark, self.extract, self.encoder = spark, extract, encoder or chunking.HashingEncoder()
        self.store = Store(spark, folder)
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{folder.rstrip('/')}/_work")
        for name, schema in SCHEMAS.items():
            self.store.create(name, schema)

    @classmethod
    def of_profile(cls, spark: SparkSession, folder: str, name: str = "plain") -> Engine:
        profile = PROFILES.get(name)
        return cls(spark, folder, profile.extractor(), profile.encoder())

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # Views of the logs.

    @staticmethod
    def _edges(log: DataFrame) -> DataFrame:
        """All versions of the log's relations, each class of types by its own rule."""
        slot = V.slot_class(F.col("type"))
        folds = {"additive": facts.additive, "subject": facts.subject_keyed, "object": facts.object_keyed, "subtype": facts.subtype_keyed}
        found = None
        for kind, fold in folds.items():
            edges = fold(log.where(slot == kind))
            found = edges if found is None else found.unionByName(edges)
        return found

    def relations(self) -> DataFrame:
        """All versions of all relations with their provenance, and the access counters of the touch log."""
        rows = self._edges(self.table("assertions")).withColumnsRenamed({"subject": "subject_id", "object": "object_id"})
        touches = self.table("touches").where("kind = 'edge'").select(F.col("id").alias("edge_id"), "ts")
        return provenance.touched(rows, touches, "edge_id")

    def entities(self) -> DataFrame:
        """Entities, alias stubs among them, with their aliases and the access counters of the touch log."""
        aliases = self.table("same_as").groupBy(F.col("canonical_id").alias("entity_id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        base = self.table("entities").join(aliases, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
        base = base.withColumns({"access_count": F.lit(0).cast("long"), "last_accessed": F.lit(None).cast("timestamp")})
        return provenance.touched(base, self.table("touches").where("kind = 'entity'").select(F.col("id").alias("entity_id"), "ts"), "entity_id")

    def mentions(self) -> DataFrame:
        return provenance.merge_mentions(self.table("mentions"))

    def conversations(self) -> DataFrame:
        return provenance.merge_conversations(self.table("turns"))

    def explicit_turns(self) -> DataFrame:
        """Turns that were remembered by a call; a capture of the conversation leaves them out."""
        return self.table("explicit").distinct()

    def entity(self, entity_id: str) -> DataFrame:
        return self.entities().where(F.col("entity_id") == entity_id)

    # Types and entities.

    def _canonicals(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(n, n.lower().replace("_", " ")) for n in names], "canonical string, text string")
        return chunking.encode_texts(rows, self.encoder).select("canonical", "embedding")

    def _coerced(self, rows: DataFrame, column: str, relation: bool) -> DataFrame:
        """``rows`` with ``type``, the canonical type of each raw one, each distinct raw type compared once."""
        raw = rows.select(F.coalesce(F.col(column), F.lit("")).alias("raw")).distinct().withColumn("said", F.lower(F.replace(F.col("raw"), F.lit("_"), F.lit(" "))))
        encoded = graph.held(chunking.encode_texts(raw, self.encoder, "said"))
        found = coerce.coerce_relation_types(encoded, self._canonicals(V.RELATION_TYPES)) if relation else coerce.coerce_entity_types(encoded, self._canonicals(list(V.ENTITY_TYPES)))
        return rows.withColumn("raw", F.coalesce(F.col(column), F.lit(""))).join(found.select("raw", "type"), "raw").drop("raw")

    def _resolve(self, found: DataFrame) -> DataFrame:
        """Mentions grouped by document, name and type, ``(doc_id, key, type, name, confidence, subtype, entity_id, canonical_name, sim, is_new, embedding)``: distinct names are embedded once and resolved against stored entities."""
        typed = self._coerced(found.withColumn("name", V.stripped(F.col("name"))), "raw_type", False)
        group = ["doc_id", F.lower(V.stripped(F.col("name"))).alias("key"), F.col("type")]
        raw = typed.groupBy(*group).agg(F.min_by(F.when(F.col("raw_type") != F.col("type"), F.col("raw_type")), "position").alias("subtype"))
        mentions = coerce.group_mentions(typed.drop("raw_type").withColumnRenamed("type", "raw_type")).join(raw, ["doc_id", "key", "type"])
        distinct = mentions.select("name", "type").distinct().withColumn("mention_id", T.entity_id(F.col("name"), F.col("type")))
        text = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"))
        encoded = graph.held(chunking.encode_texts(distinct.withColumn("text", text), self.encoder))
        stored = self.table("entities").where("canonical").select("entity_id", F.col("name").alias("canonical_name"), "type", "embedding")
        met = coerce.resolve_entities(encoded.select("mention_id", "type", "embedding"), stored).join(stored.select("entity_id", "canonical_name"), "entity_id", "left")
        named = encoded.select("mention_id", "name", "type", "embedding").join(met, "mention_id")
        columns = [F.coalesce("entity_id", "mention_id").alias("entity_id"), "canonical_name", "sim", "is_new", "embedding"]
        return graph.held(mentions.join(named.select("name", "type", *columns), ["name", "type"]))

    def _write_entities(self, batch: Batch, mentions: DataFrame, by: str, at: Column) -> None:
        """New entities; those whose name and type a stub has are touched. Other names of known entities become aliases with stubs."""
        first = Window.partitionBy("entity_id").orderBy("doc_id", "key")
        new = mentions.where("is_new").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        stored = self.table("entities").select("entity_id")
        who = {c: F.col(c) if c in new.columns else F.lit(None).cast("string") for c in ("session_id", "turn_id")}
        rows = new.withColumns({"source_doc": F.col("doc_id"), "canonical": F.lit(True), "created_by": F.lit(by), "created_at": at, **who}).join(stored, "entity_id", "left_anti")
        known = self.entities().where("canonical").select("entity_id", "name", "type", "aliases")
        resolved = mentions.where("NOT is_new").select(F.col("name").alias("alias"), F.col("entity_id").alias("canonical_id"), "sim").distinct()
        _, stubs, same_as = provenance.add_aliases(known, resolved)
        names = stubs.select(F.col("entity_id").alias("alias_id"), F.col("name").alias("alias"))
        batch.write("same_as", same_as.join(names, "alias_id"))
        taken = stored.unionByName(rows.select("entity_id"))
        blank = {"subtype": "string", "source_doc": "string", "confidence": "double", "created_by": "string", "session_id": "string", "turn_id": "string", "embedding": "array<float>"}
        stubs = stubs.join(taken, "entity_id", "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in blank.items()} | {"created_at": at})
        schema = self.store.schemas["entities"].names
        batch.write("entities", rows.select(*schema).unionByName(stubs.select(*schema)))
        batch.write("touches", new.join(stored, "entity_id", "left_semi").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), at.alias("ts")))

    def _assertions(self, batch: Batch, related: DataFrame, mentions: DataFrame, now: Column, by: str) -> tuple[DataFrame, DataFrame]:
        """The log's rows for ``related(doc_id, at, n, subject, object, raw_type, subtype, confidence, source_doc, session_id, turn_id, ...)``, and the rows without a known endpoint."""
        typed = self._coerced(related, "raw_type", True)
        shaped = typed.withColumn("subtype", V.subtype_or_raw(F.col("subtype"), F.col("raw_type"), F.col("type")))
        ids = mentions.groupBy("doc_id", "key").agg(F.min("entity_id").alias("id"))
        for c in ("subject", "object"):
            ends = ids.select("doc_id", F.col("key").alias("__key"), F.col("id").alias(f"{c}_id"))
            shaped = shaped.withColumn("__key", F.lower(V.stripped(F.col(c)))).join(ends, ["doc_id", "__key"], "left").drop("__key")
        shaped = graph.held(shaped)
        ok = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()
        extra = {c: F.lit(None).cast("string") for c in facts.QUALIFIERS if c not in shaped.columns}
        seq = F.struct(F.lit(batch.number).cast("long").alias("batch"), F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))
        log = shaped.where(ok).withColumns(extra | {"seq": seq, "ts": now, "subject": F.col("subject_id"), "object": F.col("object_id"), "created_by": F.lit(by)})
        return log.select("doc_id", *self.store.schemas["assertions"].names), shaped.where(~ok).select("doc_id", "n", "subject", "object", "raw_type", F.lit("unknown endpoint").alias("reason"), now.alias("ts"))

    def _outcomes(self, log: DataFrame) -> DataFrame:
        """What each of the new assertions does to the relations of its subject and type."""
        touched = log.select("subject", "type").distinct()
        before = self.table("assertions").join(touched, ["subject", "type"], "left_semi")
        edges = self._edges(before.unionByName(log.select(*before.columns)))
        return facts.outcome_of(log, edges)

    def _write_turns(self, batch: Batch, turns: DataFrame) -> DataFrame:
        """``turns(session_id, turn_id, role, ts)`` with their keys, each once; those that aren't stored yet are written."""
        merged = graph.held(provenance.merge_turns(turns))
        batch.write("turns", merged.join(self.table("turns").select("turn_key"), "turn_key", "left_anti"))
        return merged

    # Changes.

    def ingest(self, docs: DataFrame, now: Column, explicit: bool = False) -> DataFrame:
        """Ingests ``docs(text, title, source_type[, session_id, turn_id, role, arrival])`` at ``now``; per new document its chunks, entities and relations by what became of them.

        Documents arrive in the order of ``arrival``, a number, else as the table has them. A text that is stored already, or
        came earlier in the batch, changes nothing, so its turn isn't linked either. ``explicit`` marks the turns as remembered by a call.
        Relations with an endpoint that the document doesn't mention go to ``rejected``.
        """
        extra = {c: F.lit(None).cast("string") for c in ("session_id", "turn_id", "role") if c not in docs.columns}
        extra |= {} if "arrival" in docs.columns else {"arrival": F.monotonically_increasing_id()}
        rows = graph.held(docs.withColumns(extra).withColumn("arrival", F.col("arrival").cast("long")).where("text IS NOT NULL"))
        batch = self.store.begin()
        new = graph.held(provenance.merge_documents(rows, self.table("documents"), "arrival").withColumn("doc_id", F.col("content_hash")))
        cut = graph.held(vectors.check_dimension(chunking.encode_texts(chunking.chunk_documents(new.select("doc_id", "text")), self.encoder), self.encoder.size))
        found, related = self.extract(new.select("doc_id", "text"))
        mentions = self._resolve(found)
        source = new.select("doc_id", F.col("arrival").alias("at"), F.col("doc_id").alias("source_doc"), "session_id", "turn_id")
        log, rejected = self._assertions(batch, related.join(source, "doc_id"), mentions, now, "ingest")
        log, rejected = graph.held(log), graph.held(rejected)
        did = self._outcomes(log).groupBy("doc_id").pivot("outcome", ["created", "reinforced", "superseded"]).count()
        did = did.withColumnsRenamed({c: f"relations_{c}" for c in ("created", "reinforced", "superseded")})
        counts = new.select("doc_id", "title")
        parts = ((cut, "chunks"), (mentions.where("is_new"), "entities_created"), (mentions.where("NOT is_new"), "entities_reinforced"), (rejected, "relations_rejected"))
        for part, name in parts:
            counts = counts.join(part.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
        counts = graph.held(counts.join(did, "doc_id", "left").na.fill(0))
        batch.write("chunks", cut)
        self._write_entities(batch, mentions, "ingest", now)
        batch.write("extracted", mentions.select("entity_id", "doc_id").distinct())
        batch.write("assertions", log)
        batch.write("rejected", rejected)
        turned = new.where("session_id IS NOT NULL AND turn_id IS NOT NULL").select("doc_id", "session_id", "turn_id", "role", now.alias("ts"))
        turns = self._write_turns(batch, turned).select("session_id", "turn_id", "turn_key", "ts")
        linked = graph.held(turned.drop("ts").join(turns, ["session_id", "turn_id"]))
        batch.write("ingested", linked.select("doc_id", "turn_key").distinct())
        batch.write("mentions", mentions.join(linked, "doc_id").select("entity_id", "turn_key", "confidence", F.col("ts").alias("created_at")))
        if explicit:
            batch.write("explicit", rows.where("session_id IS NOT NULL AND turn_id IS NOT NULL").select("session_id", "turn_id").distinct())
        batch.write("documents", new.select("doc_id", "content_hash", "title", "source_type", now.alias("ingested_at")))
        stages = [c for c in counts.columns if c not in ("doc_id", "title")]
        sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stages], F.count(F.lit(1)).alias("documents"))
        batch.write("metrics", sums.unpivot([], [*stages, "documents"], "stage", "rows").withColumns({"batch": F.lit(batch.number), "ts": now}))
        batch.commit()
        return counts

    def remember(self, docs: DataFrame, now: Column) -> DataFrame:
        """An ingest of turns that were stored by a call."""
        return self.ingest(docs, now, explicit=True)

    def seed(self, path: str, now: Column, session_id: str, pattern: str = "*.md", confirm: bool = False) -> DataFrame:
        """Wipes the memory, which must be confirmed, and ingests the text files of a folder as the turns t0, t1, ... of a session, in the order of their paths; files that aren't UTF-8 are refused."""
        docs = text_documents(self.spark, path, pattern)
        if not quarantine(docs).isEmpty():
            raise ValueError("the corpus has files that aren't UTF-8")
        if docs.isEmpty():
            raise ValueError("the corpus has no files")
        self.wipe(confirm)
        numbered = numbered_turns(docs, session_id)
        return self.ingest(numbered.withColumns({"role": F.lit(None).cast("string"), "arrival": F.substring("turn_id", 2, 18).cast("long")}), now)

    def add_entities(self, rows: DataFrame, now: Column) -> DataFrame:
        """Agents' entities ``(n, name, type, source, confidence, session_id, turn_id)``; gives ``(n, entity_id, canonical_name, resolved_to_existing)``, null ids for those without session or turn, which aren't written."""
        ok = F.coalesce(T.valid_segment(F.col("session_id")) & T.valid_segment(F.col("turn_id")), F.lit(False))
        good = graph.held(rows.where(ok).withColumn("doc_id", F.concat_ws(":", F.lit("agent"), "session_id", "turn_id", F.col("n").cast("string"))))
        batch = self.store.begin()
        mentions = self._resolve(good.select("doc_id", F.lit(0).alias("position"), "name", F.col("type").alias("raw_type"), "confidence"))
        mentions = graph.held(mentions.join(good.select("doc_id", "n", "source", "session_id", "turn_id"), "doc_id"))
        self._write_entities(batch, mentions.withColumn("doc_id", F.col("source")), "agent", now)
        turns = self._write_turns(batch, good.select("session_id", "turn_id", F.lit(None).cast("string").alias("role"), now.alias("ts"))).select("session_id", "turn_id", "turn_key", "ts")
        batch.write("mentions", mentions.join(turns, ["session_id", "turn_id"]).select("entity_id", "turn_key", "confidence", F.col("ts").alias("created_at")))
        result = mentions.select("n", "entity_id", F.coalesce("canonical_name", "name").alias("canonical_name"), (~F.col("is_new")).alias("resolved_to_existing"))
        batch.commit()
        return rows.select("n").join(result, "n", "left")

    def assert_relations(self, rows: DataFrame, now: Column) -> DataFrame:
        """Agents' relations ``(n, subject, subject_type, object, object_type, rel_type, source, session_id, turn_id, confidence, subtype)``; gives ``(n, outcome)``, ``rejected`` for those without session or turn, which aren't written."""
        ok = F.coalesce(T.valid_segment(F.col("session_id")) & T.valid_segment(F.col("turn_id")), F.lit(False))
        good = graph.held(rows.where(ok).withColumn("doc_id", F.concat_ws(":", F.lit("agent"), "session_id", "turn_id", F.col("n").cast("string"))))
        batch = self.store.begin()
        ends = [good.select("doc_id", F.col(c).alias("name"), F.col(f"{c}_type").alias("raw_type"), "confidence", F.lit(at).alias("position")) for at, c in enumerate(("subject", "object"))]
        mentions = self._resolve(ends[0].unionByName(ends[1]))
        mentions = graph.held(mentions.join(good.select("doc_id", "source", "session_id", "turn_id"), "doc_id"))
        related = good.withColumnsRenamed({"rel_type": "raw_type", "source": "source_doc"}).withColumn("at", F.lit(0))
        log, rejected = self._assertions(batch, related, mentions.drop("session_id", "turn_id"), now, "agent")
        log = graph.held(log)
        outcomes = self._outcomes(log).select(F.col("seq.n").alias("n"), "outcome")
        outcomes = graph.held(rows.select("n").join(outcomes, "n", "left").withColumn("outcome", F.coalesce("outcome", F.lit("rejected"))))
        batch.write("assertions", log)
        batch.write("rejected", rejected)
        self._write_entities(batch, mentions.withColumn("doc_id", F.col("source")), "agent", now)
        turns = self._write_turns(batch, good.select("session_id", "turn_id", F.lit(None).cast("string").alias("role"), now.alias("ts"))).select("session_id", "turn_id", "turn_key", "ts")
        batch.write("mentions", mentions.join(turns, ["session_id", "turn_id"]).select("entity_id", "turn_key", "confidence", F.col("ts").alias("created_at")))
        batch.commit()
        return outcomes

    # Questions.

    def retrieve(self, queries: DataFrame, now: Column, reinforce: bool = True, scope: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Entities and chunks for ``queries(query_id, question)``; ``scope(query_id, session_id, since)`` limits them, ``reinforce`` logs what was found."""
        asked = graph.held(chunking.encode_texts(queries, self.encoder, "question").select("query_id", "embedding"))
        memory = retrieve.Memory(self.entities(), self.table("chunks"), self.table("extracted"), self.relations())
        if scope is not None:
            turns = self.table("turns")
            options["allowed_entities"] = retrieve.allow_entities(scope, turns, self.mentions())
            by_doc = self.table("ingested").join(self.table("chunks").select("doc_id", "chunk_id"), "doc_id").select("turn_key", F.col("chunk_id").alias("entity_id"))
            options["allowed_chunks"] = retrieve.allow_entities(scope, turns, by_doc).withColumnRenamed("entity_id", "chunk_id")
        found, chunks = retrieve.search(memory, asked, now, weights=options.pop("weights", Weights()), **options)
        found = graph.held(found)
        if reinforce:
            nodes, edges = retrieve.touches_of(found, now)
            batch = self.store.begin()
            batch.write("touches", nodes.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "ts").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "ts")))
            batch.commit()
        return found, chunks

    def documents_for(self, queries: DataFrame, now: Column, **options) -> DataFrame:
        """A search's entities and then its chunks as documents, ``(query_id, kind, position, id, content, score)``."""
        found, chunks = self.retrieve(queries, now, **options)
        return retrieve.as_documents(found, chunks, self.table("entities"), self.table("chunks"))

    def neighbours(self, name: str, hops: int = 2, limit: int = 25) -> DataFrame:
        """What is around the entities of a name, in any case, over live relations."""
        every = self.table("entities")
        seeds = every.where(F.col("canonical") & (F.lower("name") == name.lower())).select(F.col("entity_id").alias("seed"))
        return graph.neighbours(seeds, self.relations().where("valid_until IS NULL"), every, hops, limit)

    def conversation(self, session_id: str, limit: int = 10) -> DataFrame:
        named = self.mentions().join(self.table("entities").select("entity_id", "name"), "entity_id")
        return provenance.conversation_detail(self.table("turns").where(F.col("session_id") == session_id), named, limit)

    def status(self) -> DataFrame:
        """One row: counts, and the top and recent lists."""
        return status.summary(self.table("documents"), self.table("entities"), self.relations(), self.conversations(), self.table("turns"))

    def query(self, statement: str, **args) -> DataFrame:
        """A read-only statement over the stored tables and ``relations``."""
        return adhoc.run(self.spark, statement, {n: self.table(n) for n in SCHEMAS} | {"relations": self.relations()}, args)

    def wipe(self, confirm: bool = False) -> None:
        self.store.wipe(confirm)
