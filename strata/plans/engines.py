"""Registries of exchangeable parts: table extractors, readers of images, transcribers, projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Engine:
    """A named part: what it is ready for, what it takes, and what it does to a table."""

    name: str
    supports: frozenset[str]
    apply: Callable[[DataFrame], DataFrame] | None = None
    priority: int = 0

    @property
    def available(self) -> bool:
        return self.apply is not None


@dataclass
class Registry:
    """Parts of one kind; the available one of highest priority that supports a need is taken, earlier ones first."""

    kind: str
    engines: list[Engine] = field(default_factory=list)

    def register(self, engine: Engine) -> Engine:
        self.engines = [e for e in self.engines if e.name != engine.name] + [engine]
        return engine

    def select(self, need: str) -> Engine | None:
        fit = [e for e in self.engines if e.available and need in e.supports]
        return max(fit, key=lambda e: e.priority, default=None)

    def describe(self) -> list[tuple[str, bool, list[str]]]:
        return [(e.name, e.available, sorted(e.supports)) for e in self.engines]

    def run(self, df: DataFrame, need: str) -> DataFrame:
        """The table as the chosen part leaves it; without one every row comes back with the gap in ``gap``."""
        engine = self.select(need)
        return df.withColumn("gap", F.lit(f"{self.kind}:{need}")) if engine is None else df.transform(engine.apply)


TABLES, READERS, TRANSCRIBERS, PROJECTIONS = Registry("table_extractor"), Registry("ocr"), Registry("transcriber"), Registry("projection")
# reading images and speech needs outside engines; until one is registered, rows come back with a gap
READERS.register(Engine("outside", frozenset({"image", "scan"})))
TRANSCRIBERS.register(Engine("outside", frozenset({"audio", "video"})))
