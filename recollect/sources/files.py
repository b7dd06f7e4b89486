"""Text and JSON sources, and tables of committed Parquet batches as sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_documents(spark: SparkSession, path: str, pattern: str | None = None, source_type: str = "text") -> DataFrame:
    """``(path, title, source_type, text, doc_order)`` of UTF-8 files; the title is the file's stem, the order that of paths."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    title = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    # A file that isn't UTF-8 has a null text; quarantine() finds it.
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", title.alias("title"), F.lit(source_type).alias("source_type"), text.alias("text"))


def unreadable(docs: DataFrame) -> DataFrame:
    """Files of ``text_documents`` that aren't UTF-8; a loader stops at them or goes on with the rest, as it likes."""
    return docs.where("text IS NULL").select("path")


def numbered_turns(docs: DataFrame, session_id: str) -> DataFrame:
    """Documents with ``session_id`` and ``turn_id`` t0, t1, ... by path; numbering counts each path's predecessors by ranges, not in one task."""
    ordered = docs.repartitionByRange("path").withColumn("part", F.spark_partition_id())
    ordered = ordered.checkpoint() if not docs.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else ordered.cache()
    sizes = ordered.groupBy("part").count().collect()
    before, n = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in sizes):
        before[part] = n
        n += count
    start = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part")) if before else F.lit(0)
    number = start + F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    return ordered.withColumns({"session_id": F.lit(session_id), "turn_id": F.concat(F.lit("t"), number.cast("string"))}).drop("part")


def quarantine(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NULL")


def questions(spark: SparkSession, path: str, question_type: str | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """Questions of a JSON file that holds a list of them, or an object with ``questions``; filtered, in a seeded order, ``n`` of them."""
    read = spark.read.option("multiLine", True).json(path)
    rows = read.select(F.explode("questions").alias("q")).select("q.*") if read.columns == ["questions"] else read
    rows = rows.where(F.col("question_type") == question_type) if question_type else rows
    return rows if n is None else rows.orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id").limit(n)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


class Batch:
    """Rows on their way into a store's tables; nothing of them is seen before ``commit``."""

    def __init__(self, store: Store, number: int) -> None:
        self.store, self.number, self.token = store, number, uuid.uuid4().hex
        self.names: list[str] = []

    def write(self, name: str, rows: DataFrame) -> None:
        columns = self.store.schemas[name]
        rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in columns.fields]).write.parquet(self.store.place(name, self.number, self.token))
        self.names.append(name)

    def commit(self, base: bool = False) -> None:
        """Makes the batch's rows part of the tables, all at once; fails if another writer has taken its number. A base takes the place of all batches before it."""
        out = self.store.fs().create(self.store.path(f"_commits/{self.number:012d}"), False)
        out.writeUTF("\n".join([self.token, "base" if base else "", *self.names]))
        out.close()


class Store:
    """Named tables under a folder, which grow by batches of Parquet files.

    A batch is written to folders of its own and then committed by one small file, which is created once. So a batch that fails is
    never seen and can be tried again, batches of several tables appear together, and of two writers one fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), {}
        self._known: dict[int, list[str]] = {}

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def fs(self):
        return self.path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def place(self, name: str, number: int, token: str) -> str:
        return f"{self.folder}/{name}/{number:012d}-{token}"

    def create(self, name: str, schema: str) -> None:
        """Declares a table; it is empty until a batch with rows of it is committed."""
        self.schemas[name] = self.spark.createDataFrame([], schema).schema

    def commits(self) -> dict[int, list[str]]:
        """Committed batches by number: token, whether it is a base, and the tables in it."""
        fs, top = self.fs(), self.path("_commits")
        listed = {int(x.getPath().getName()): x for x in fs.listStatus(top)} if fs.exists(top) else {}
        self._known = {n: c for n, c in self._known.items() if n in listed}
        for number, file in listed.items():
            # An empty file is one that is being written.
            if number not in self._known and file.getLen() > 0:
                at = fs.open(file.getPath())
                self._known[number] = at.readUTF().split("\n")
                at.close()
        base = max((n for n, c in self._known.items() if c[1] == "base"), default=0)
        return {n: c for n, c in sorted(self._known.items()) if n >= base}

    def begin(self) -> Batch:
        return Batch(self, max(self.commits(), default=0) + 1)

    def read(self, name: str) -> DataFrame:
        paths = [self.place(name, n, c[0]) for n, c in self.commits().items() if name in c[2:]]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def compact(self) -> None:
        """Writes all tables anew as one batch and deletes the batches before."""
        before = self.commits()
        batch = self.begin()
        for name in self.schemas:
            batch.write(name, self.read(name))
        batch.commit(base=True)
        for number, (token, _, *names) in before.items():
            for name in names:
                self.fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.place(name, number, token)), True)
            self.fs().delete(self.path(f"_commits/{number:012d}"), False)

    def exists(self, name: str) -> bool:
        return any(name in c[2:] for c in self.commits().values())

    def wipe(self, confirm: bool = False) -> None:
        """Deletes all tables; asks to be confirmed."""
        if not confirm:
            raise ValueError("wipe must be confirmed")
        self.fs().delete(self.path(""), True)
        self._known = {}
