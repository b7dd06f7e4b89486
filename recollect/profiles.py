"""Named bundles of what an engine is run with: patterns and types of its extractor, size of its encoder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunking


@dataclass(frozen=True)
class Profile:
    """``patterns`` maps a raw relation type to a pattern with two groups, and to the raw types of what they match."""

    patterns: dict[str, tuple[str, str, str]]
    encoder_size: int = 64
    confidence: float = 0.8
    notes: str = ""

    def encoder(self) -> chunking.HashingEncoder:
        return chunking.HashingEncoder(self.encoder_size)

    def extractor(self) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
        """Documents ``(doc_id, text)`` to mentions and relations as the engine takes them."""
        kinds = {raw: (subject, object_) for raw, (_, subject, object_) in self.patterns.items()}

        def of(column: str, at: int) -> F.Column:
            return F.element_at(F.create_map(*[F.lit(x) for raw, k in kinds.items() for x in (raw, k[at])]), F.col(column))

        def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
            found = chunking.extract_by_patterns(docs, {raw: p for raw, (p, _, _) in self.patterns.items()})
            sure = F.lit(self.confidence).alias("confidence")
            related = found.select("doc_id", F.col("seq").alias("n"), "subject", "object", F.col("type").alias("raw_type"), F.lit(None).cast("string").alias("subtype"), sure)
            ends = [
                found.select("doc_id", (F.col("seq") * 2 + at).alias("position"), F.col(side).alias("name"), of("type", at).alias("raw_type"), sure) for at, side in enumerate(("subject", "object"))
            ]
            return ends[0].unionByName(ends[1]), related

        return extract


@dataclass
class Registry:
    profiles: dict[str, Profile] = field(default_factory=dict)

    def add(self, name: str, profile: Profile) -> None:
        if name in self.profiles:
            raise ValueError(f"there is a profile {name} already")
        self.profiles[name] = profile

    def get(self, name: str) -> Profile:
        if name not in self.profiles:
            raise ValueError(f"no profile {name}; there are {', '.join(sorted(self.profiles))}")
        return self.profiles[name]


PROFILES = Registry({"plain": Profile({"works at": (r"(\w+) works at (\w+)", "person", "company"), "uses": (r"(\w+) uses (\w+)", "person", "technology")}, notes="two patterns of plain English")})
