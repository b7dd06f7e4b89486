"""Chat formatting with cumulative-snapshot collapse.

Chat systems often log a conversation anew after each turn, so a log holds prefixes of longer
conversations. Each conversation gets a rolling hash per turn, the hash of the one before and
the turn. One whose last hash is that of an inner turn of another is a prefix of it, and of
equal ones the smallest id stays. Anti-joins keep the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

PART = 256


def conversations_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns, n_turns, prints)``: ordered turns, and the rolling hash after each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    digest = "md5(concat(element_at(c, -1), ' ', length(t.role), ' ', t.role, ' ', t.text))"
    # Appending copies an array, so hashes are gathered in parts of bounded length, each starting with the last hash of the one before.
    part = f"aggregate(slice(turns, b * {PART} + 1, {PART}), array(coalesce(try_element_at(try_element_at(a, -1), -1), '')), (c, t) -> array_append(c, {digest}))"
    rolling = F.expr(
        f"aggregate(sequence(0, (size(turns) - 1) div {PART}), CAST(array() AS array<array<string>>), (a, b) -> array_append(a, slice({part}, 2, {PART})), a -> flatten(a))"
    )
    return listed.select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), rolling.alias("prints"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations ``(conv_id, turns, n_turns)`` of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by number, then role and text where numbers repeat; repeated rows are
    repeated turns. Null roles and texts count as empty. Null conversation ids are one
    conversation. An empty table gives no row. A common first turn is one hash, whatever
    the number of conversations that share it.
    """
    every = shared.settled(conversations_of(turns))
    inner = every.where("n_turns > 1").select(F.explode(F.expr("slice(prints, 1, size(prints) - 1)")).alias("last")).distinct()
    whole = every.withColumn("last", F.element_at("prints", -1))
    longest = whole.join(inner, "last", "left_anti")
    kept = longest.groupBy("last").agg(F.min("conv_id").alias("conv_id")).select("last", F.col("conv_id").alias("kept_id"))
    same = (longest["last"] == kept["last"]) & longest["conv_id"].eqNullSafe(kept["kept_id"])
    return longest.join(kept, same, "left_semi").select("conv_id", "turns", "n_turns")


def render(conversations: DataFrame) -> DataFrame:
    """Adds ``rendered``, the conversation with each turn's role and text between marks."""
    each = F.expr(f"transform(turns, t -> concat('{OPEN}', t.role, '\\n', t.text, '{CLOSE}'))".replace("\n", "\\n"))
    return conversations.withColumn("rendered", F.array_join(each, ""))


def op3(spark, sf_dir):
    found = render(collapse(shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return found.select("conv_id", "n_turns", "rendered")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
p AS (
  SELECT conv_id, i, list([role, text]) OVER (PARTITION BY conv_id ORDER BY i) AS prefix,
         max(i) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT conv_id, n, prefix FROM p WHERE i = n),
longest AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n)),
kept AS (SELECT min(conv_id) AS conv_id FROM longest GROUP BY prefix)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
