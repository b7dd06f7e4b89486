"""Best-fit packing under conflicts.

Documents, measured in tokens, are cut into pieces of at most a sequence's length, and pieces are put into
sequences (bins). A piece's first token and its place in the bin tell what to copy where. Bins are ordered by their residual room. A piece goes to the tightest bin
that takes it and doesn't conflict: from the first bin with enough room the search goes on to
its successors until one is compatible. Each bin carries a bitmap of its duplicate clusters,
none of which may come twice, and bitmaps of its sources, one for each time that a source may
come. Packing runs independently over partitions of a bounded number of documents, so no
source, cluster or table meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash, token_counts

RESULT = "doc_id long, piece int, begin long, n_units long, bin_id long, bin_offset long, bin_fill long, bin_pieces int"
ARROW = pa.schema([(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in RESULT.split(", "))])
CAPACITY = 4_096


class Bins:
    """Open bins in the order of residual room; a bin is (room, number)."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def compatible(self, number: int, source: int, cluster: int) -> bool:
        return not self.clusters[number] & cluster and not self.sources[number][-1] & source

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Number of the bin that took the piece, and its offset in it. source and cluster are single bits."""
        order = self.order
        at = bisect_left(order, (size, -1))
        while at < len(order) and not self.compatible(order[at][1], source, cluster):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[number] |= cluster
        layers = self.sources[number]
        for n, layer in enumerate(layers):
            if not layer & source:
                layers[n] |= source
                break
        if room > size:
            insort(order, (room - size, number))
        return number, self.capacity - room


def pack(frame: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Packs ``frame(doc_id, size, source, cluster)``, longest pieces first, ties by id."""
    frame = frame.sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
    source_bit = {s: 1 << n for n, s in enumerate(frame["source"].unique())}
    cluster_bit = {c: 1 << n for n, c in enumerate(frame["cluster"].unique())}
    pieces: list[tuple] = []
    for doc_id, size, source, cluster in zip(*(frame[c].tolist() for c in ("doc_id", "size", "source", "cluster")), strict=True):
        whole, rest = divmod(size, capacity)
        pieces += [(capacity, doc_id, n, source, cluster) for n in range(whole)]
        if rest:
            pieces.append((rest, doc_id, whole, source, cluster))
    pieces.sort(key=lambda p: -p[0])
    bins = Bins(capacity, per_source)
    placed = [(doc_id, n, n * capacity, size, *bins.put(size, source_bit[source], cluster_bit[cluster])) for size, doc_id, n, source, cluster in pieces]
    out = pd.DataFrame(placed, columns=["doc_id", "piece", "begin", "n_units", "bin_id", "bin_offset"]).astype({"doc_id": "Int64"})
    by_bin = out.groupby("bin_id")["n_units"]
    out["bin_fill"], out["bin_pieces"] = by_bin.transform("sum"), by_bin.transform("count").astype("int32")
    return out


def pack_documents(
    docs: DataFrame,
    size: str,
    source: str = "source",
    cluster: str = "cluster",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    per_source: int = 8,
    partition_rows: int = 4_096,
) -> DataFrame:
    """A row for each piece: ``doc_id, piece, begin, n_units, bin_id, bin_offset, bin_fill, bin_pieces``.

    ``size`` names a column of whole units, tokens as a rule, ``capacity`` the units of a bin. A longer document
    is cut into pieces of ``capacity`` and a rest; its pieces share its cluster, so they are in
    different bins. A piece is the document's ``n_units`` units from ``begin`` on, and lies at ``bin_offset``.
    A source comes at most ``per_source`` times in a bin, a cluster once. A
    document of null or no size has no piece. Null sources are one source, and a null
    cluster is one cluster for each row. Rows repeated in id, and those without one, are packed like others. Partitions
    of about ``partition_rows`` documents are drawn by a hash of the row, so a frequent source,
    cluster or row is in all of them; a partition's bin ids start with its number.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"),
        F.col(cluster).cast("long").alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    ).where("size > 0")
    rows = shared.settled(rows.withColumn("cluster", F.coalesce("cluster", F.xxhash64("row", F.lit("null")))))
    parts = max(1, -(-rows.count() // partition_rows))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = pack(table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), capacity, per_source)
        out["bin_id"] += key[0].as_py() << 32
        return pa.Table.from_pandas(out, schema=ARROW, preserve_index=False)

    part = F.pmod(F.xxhash64("doc_id", "cluster", "size", "row"), F.lit(parts)).cast("int").alias("part")
    return rows.select("*", part).drop("row").groupBy("part").applyInArrow(one, RESULT)


def measured(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, the text's tokens, and ``cluster``, a hash that equal texts share.

    Tokens are those of the byte-level vocabulary at ``path``, one of the public ones by default.
    """
    return token_counts.count_tokens(docs, path or token_counts.byte_level_tokenizer(), text).withColumn("cluster", F.xxhash64(text))


def op8(spark, sf_dir):
    """Clusters are op10's components, so near copies don't share a sequence."""
    docs = measured(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    found = simhash.near_duplicates(docs, keep=("source", "n_tokens"))
    return pack_documents(found, "n_tokens", cluster="component_id")
