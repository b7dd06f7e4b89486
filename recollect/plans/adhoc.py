"""Read-only SQL over registered tables.

The text is parsed by Spark and the whole tree is checked: only kinds of nodes that read may
be in it. The check uses the session's own parser through its JVM object, which is the
one place where this package leaves the public Python API.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Kinds of nodes that only read.
READING = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "Subquery", "SubqueryAlias", "Tail", "Union", "UnionLoop",
    "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith",
    "Unpivot", "UnresolvedHint", "UnresolvedOrderBy", "Values", "WithCTE", "WithWindowDefinition", "Window",
}
WRITING = re.compile(r"\b(INSERT|CREATE|MERGE|DELETE|UPDATE|DROP|ALTER|TRUNCATE|SET|USE|CACHE|LOAD|CALL|REFRESH|ADD|EXECUTE)\b", re.IGNORECASE)


class NotReadOnly(ValueError):
    pass


def without_strings(text: str) -> str:
    """The statement without its comments, strings and quoted names."""
    return re.sub(r"""--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`""", " ", text, flags=re.DOTALL)


def _kinds(plan) -> set[str]:
    """Kinds of all nodes of a parsed plan, those in subqueries and common tables included."""
    found, waiting = set(), [plan]
    while waiting:
        node = waiting.pop()
        found.add(node.getClass().getSimpleName().rstrip("$"))
        if node.getClass().getSimpleName() == "UnresolvedWith":
            relations = node.cteRelations()
            waiting += [relations.apply(i)._2() for i in range(relations.size())]
        for inner in (node.children(), node.innerChildren(), node.subqueries()):
            waiting += [x for x in (inner.apply(i) for i in range(inner.size())) if hasattr(x, "children") and hasattr(x, "subqueries")]
    return found


def assert_read_only(spark: SparkSession, text: str) -> None:
    """Raises ``NotReadOnly`` unless the text is one statement that only reads."""
    bare = without_strings(text).strip().rstrip(";")
    word = WRITING.search(bare)
    if word:
        raise NotReadOnly(f"{word.group(1).upper()} is not allowed")
    if ";" in bare:
        raise NotReadOnly("one statement only")
    kinds = _kinds(spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";")))
    if kinds - READING:
        raise NotReadOnly(f"not allowed: {', '.join(sorted(kinds - READING))}")


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """The result of a read-only statement over ``tables``, which become temporary views, with named parameters."""
    assert_read_only(spark, text)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})
