"""Relation and entity vocabularies and their normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation types, their synonyms, entity types and theirs.
RELATION_TYPES = [
    "WORKS_FOR",
    "LEADS",
    "MEMBER_OF",
    "REPORTS_TO",
    "APPROVED",
    "USES",
    "BELONGS_TO",
    "LOCATED_IN",
    "CREATED",
    "RELATED_TO",
    "HAS_TITLE",
    "HAS_PREFERENCE",
    "HAS_ATTRIBUTE",
    "FAMILY_OF",
    "RECOMMENDED",
    "DISCUSSED",
    "HAPPENED_ON",
    "LIVES_IN",
]
RELATION_SYNONYMS = {
    "WORKS_FOR": ["EMPLOYED_BY", "EMPLOYED_AT", "WORKS_AT", "WORKED_AT", "WORKED_FOR", "CURRENTLY_WORKS_AT", "CURRENTLY_WORKS_FOR", "HIRED_BY", "AFFILIATED_WITH"],
    "LEADS": ["MANAGES", "HEADS", "DIRECTS", "OVERSEES", "OWNS"],
    "MEMBER_OF": ["PART_OF", "IN_TEAM", "ON_TEAM", "BELONGS_TO_TEAM"],
    "APPROVED": ["SIGNED_OFF_ON", "GREEN_LIT", "AUTHORIZED", "RATIFIED"],
    "USES": ["DEPENDS_ON", "BUILT_ON", "RUNS_ON", "POWERED_BY", "USES_TECHNOLOGY"],
    "BELONGS_TO": ["OWNED_BY", "SUBSIDIARY_OF", "DIVISION_OF"],
    "LOCATED_IN": ["BASED_IN", "HEADQUARTERED_IN", "SITUATED_IN"],
    "CREATED": ["AUTHORED", "BUILT", "DEVELOPED", "WROTE", "FOUNDED"],
    "HAS_TITLE": ["TITLE", "ROLE", "POSITION", "WORKS_AS", "HAS_JOB_TITLE", "HAS_ROLE", "APPOINTED_AS", "PROMOTED_TO"],
    "HAS_PREFERENCE": ["PREFERS", "LIKES_BEST", "FAVORITE", "FAVORITE_OF"],
    "HAS_ATTRIBUTE": ["HAS_TRAIT", "ATTRIBUTE_OF"],
    "FAMILY_OF": ["RELATED_TO_FAMILY", "KIN_OF", "MARRIED_TO", "SPOUSE_OF", "PARENT_OF", "CHILD_OF", "SIBLING_OF"],
    "LIVES_IN": ["RESIDES_IN", "LIVES_AT", "HOME_IS", "CURRENTLY_LIVES_IN"],
    "RECOMMENDED": ["SUGGESTED"],
    "DISCUSSED": ["TALKED_ABOUT", "MENTIONED"],
    "HAPPENED_ON": ["OCCURRED_ON", "TOOK_PLACE_ON", "DATED"],
}
ENTITY_SYNONYMS = {
    "Person": ["individual", "user", "human", "employee", "engineer", "softwareengineer", "softwaredeveloper", "developer", "manager", "founder", "author", "member", "leader", "director", "executive", "ceo", "cto", "cfo", "researcher", "scientist", "analyst"],
    "Organization": ["org", "organisation", "company", "corp", "corporation", "firm", "team", "department", "group", "agency", "institution", "startup", "enterprise"],
    "Project": ["initiative", "program", "programme", "effort", "product", "codename"],
    "Technology": ["tech", "framework", "library", "language", "tool", "platform", "database", "software", "service", "system", "api"],
    "Location": ["place", "city", "country", "region", "office", "building", "address"],
    "Concept": ["idea", "methodology", "principle", "theory", "pattern", "approach", "strategy"],
    "Event": ["meeting", "conference", "incident", "milestone", "decision", "ceremony"],
    "Document": ["report", "memo", "spec", "specification", "contract", "paper", "file", "doc", "article"],
    "Role": ["title", "jobtitle", "position", "rank", "designation"],
    "DateTime": ["date", "datetime", "time", "timestamp", "day", "year", "month", "week"],
    "Task": ["task", "todo", "to-do", "actionitem", "assignment", "chore", "errand"],
}
ENTITY_TYPES = tuple(ENTITY_SYNONYMS)
#: What besides the subject and the type makes up a slot that holds one live fact; types not listed are additive.
SUBJECT_KEYED = ("WORKS_FOR", "REPORTS_TO", "BELONGS_TO", "LIVES_IN", "HAPPENED_ON")
OBJECT_KEYED = ("HAS_TITLE",)
SUBTYPE_KEYED = ("HAS_PREFERENCE", "HAS_ATTRIBUTE")


def relation_synonyms(spark: SparkSession) -> DataFrame:
    """``(synonym, canonical)`` of all relation synonyms."""
    return spark.createDataFrame([(s, c) for c, all_ in RELATION_SYNONYMS.items() for s in all_], "synonym string, canonical string")


def entity_synonyms(spark: SparkSession) -> DataFrame:
    """``(synonym, canonical)`` of all entity types and synonyms, lower-cased."""
    rows = {s: c for c, all_ in ENTITY_SYNONYMS.items() for s in all_} | {c.lower(): c for c in ENTITY_TYPES}
    return spark.createDataFrame(list(rows.items()), "synonym string, canonical string")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_relation_type(raw: Column) -> Column:
    """Canonical type of a raw one: blank is RELATED_TO, synonyms are mapped, other types pass in upper case with underscores."""
    shaped = F.replace(F.upper(stripped(raw)), F.lit(" "), F.lit("_"))
    pairs = {s: c for c, all_ in RELATION_SYNONYMS.items() for s in all_}
    return F.when(shaped.isNull() | (shaped == ""), "RELATED_TO").otherwise(F.coalesce(_lookup(pairs, shaped), shaped))


def normalize_entity_type(raw: Column) -> Column:
    """Canonical entity type where the raw one is a type in any case or a synonym; blank is Concept, others are null (to be matched by embedding)."""
    pairs = {s: c for c, all_ in ENTITY_SYNONYMS.items() for s in all_} | {c.lower(): c for c in ENTITY_TYPES}
    low = F.lower(stripped(raw))
    return F.when(low.isNull() | (low == ""), "Concept").otherwise(_lookup(pairs, low))


def normalize_subtype(raw: Column) -> Column:
    """Lower-case words joined by single underscores; null if nothing is left."""
    shaped = F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(shaped, r"^_+|_+$", ""), F.lit(""))


def subtype_or_raw(subtype: Column, raw: Column, canonical: Column) -> Column:
    """The explicit subtype, else the raw type in the shape of a type where normalising changed it."""
    shaped = F.replace(F.upper(stripped(raw)), F.lit(" "), F.lit("_"))
    return F.coalesce(normalize_subtype(subtype), F.when(shaped != canonical, normalize_subtype(shaped)))


def slot_class(relation_type: Column) -> Column:
    """``subject``, ``object``, ``subtype`` or ``additive``."""
    return (
        F.when(relation_type.isin(*SUBJECT_KEYED), "subject")
        .when(relation_type.isin(*OBJECT_KEYED), "object")
        .when(relation_type.isin(*SUBTYPE_KEYED), "subtype")
        .otherwise("additive")
    )
