"""Identity, time and rendering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import stripped

#: Roles whose turns aren't remembered.
SKIPPED_ROLES = ("tool", "function")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    """Document-scoped identity of a chunk: equal texts in two documents are two chunks."""
    return F.concat_ws(":", doc_id.cast("string"), index.cast("string"), content_hash(text))


def entity_id(name: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("\0", name, kind), 256)


def turn_key(session: Column, turn: Column) -> Column:
    return F.concat_ws(":", session.cast("string"), turn.cast("string"))


def valid_segment(value: Column) -> Column:
    """Whether a value may be part of a turn key."""
    return value.isNotNull() & ~value.cast("string").contains(":")


def normal_role(role: Column) -> Column:
    low = F.lower(stripped(role))
    return F.when(low.isNull() | (low == ""), "unknown").otherwise(low)


def turn_fingerprint(session: Column, turn: Column, role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", session.cast("string"), turn.cast("string"), normal_role(role), stripped(text)), 256)


def turn_title(session: Column, turn: Column, role: Column) -> Column:
    return F.concat_ws(":", F.lit("conversation"), session.cast("string"), turn.cast("string"), normal_role(role))


def eligible(session: Column, turn: Column, role: Column, text: Column) -> Column:
    """Whether a turn is remembered: ids and text aren't blank and the role isn't one of tools."""
    filled = lambda c: F.coalesce(stripped(c.cast("string")) != "", F.lit(False))
    return filled(session) & filled(turn) & filled(text) & ~normal_role(role).isin(*SKIPPED_ROLES)


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def conversation_title(agent: Column, started: Column, session: Column) -> Column:
    return F.concat_ws(":", F.coalesce(agent, F.lit("agent")), compact_time(started), F.substring(content_hash(session.cast("string")), 1, 8))


def safe_id(value: Column) -> Column:
    return F.translate(value, ":/ ", "___")


def fuzzy_contains(a: Column, b: Column) -> Column:
    """Whether either text is within the other, in any case."""
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def verdict(answer: Column) -> Column:
    """The verdict in a judge's answer, which may fence its JSON; ``incorrect`` if there is none."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    found = F.get_json_object(F.when(body != "", body), "$.verdict")
    return F.when(F.lower(found) == "correct", "correct").otherwise("incorrect")


def edge_label(relation: Column, subtype: Column, kind: Column, value: Column, unit: Column, scope: Column) -> Column:
    """``TYPE[subtype] {kind=value unit, scope=...}``; parts without a value are left out, and a value without a kind is a ``quantity``."""
    quantity = F.when(value.isNotNull(), F.concat(F.coalesce(kind, F.lit("quantity")), F.lit("="), value, F.coalesce(F.concat(F.lit(" "), unit), F.lit(""))))
    extra = F.array_join(F.filter(F.array(quantity, F.when(scope.isNotNull(), F.concat(F.lit("scope="), scope))), lambda x: x.isNotNull()), ", ")
    named = F.concat(relation, F.coalesce(F.concat(F.lit("["), subtype, F.lit("]")), F.lit("")))
    return F.when(extra == "", named).otherwise(F.concat(named, F.lit(" {"), extra, F.lit("}")))


def entity_header(name: Column, kind: Column, distance: Column, path: Column) -> Column:
    """``Name (Type) [seed]`` or ``Name (Type) [n hops via A → B]``; path is an array of labels, which may be empty."""
    steps = F.when(F.size(path) > 0, F.concat(F.lit(" via "), F.array_join(path, " → "))).otherwise("")
    return F.concat(name, F.lit(" ("), kind, F.lit(") "), F.when(distance == 0, "[seed]").otherwise(F.concat(F.lit("["), distance.cast("string"), F.lit(" hops"), steps, F.lit("]"))))


def search_block(entities: Column, chunks: Column) -> Column:
    """A search result as text: a line for each of ``entities(name, type, labels)``, then, if there are any, ``chunks(title, text)`` as passages."""
    line = lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["type"], F.lit(")"), F.when(F.size(e["labels"]) > 0, F.concat(F.lit(" [via "), F.array_join(e["labels"], " → "), F.lit("]"))).otherwise(""))
    passage = F.transform(chunks, lambda c: F.concat(F.lit("["), c["title"], F.lit("]\n"), c["text"]))
    heads = F.concat(F.array(F.lit("## Entities")), F.transform(entities, line))
    return F.array_join(F.when(F.size(chunks) > 0, F.concat(heads, F.array(F.lit("\n## Source Passages")), passage)).otherwise(heads), "\n")


def transcript_line(role: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.upper(role), F.lit("] "), content)


def since(now: Column, hours: int | None) -> Column | None:
    """Start of the look-back; None if there is none."""
    return now - F.make_interval(hours=F.lit(hours)) if hours and hours >= 1 else None


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
