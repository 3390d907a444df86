"""What a stored phrase table says of itself: description, language, folding, construct packs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lexigrid.plans import packs
from lexigrid.plans.syntax import PatternError


@dataclass
class Manifest:
    description: str = ""
    language: str = "en"
    transliterate: bool = False
    construct_packs: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"description": self.description, "language": self.language, "transliterate": self.transliterate, "constructPacks": self.construct_packs}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Manifest:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise PatternError(f"the manifest is no JSON: {e}") from e
        if not isinstance(raw, dict):
            raise PatternError("the manifest is no JSON object")
        return Manifest(str(raw.get("description", "")), str(raw.get("language", "en")), bool(raw.get("transliterate", False)), list(raw.get("constructPacks", [])))

    def packs(self) -> dict[str, dict]:
        return packs.load(*self.construct_packs)

    def query(self, pattern: str) -> str:
        """A pattern with its accented letters folded as the corpus was."""
        import unicodedata

        from lexigrid.functions.text import FOLDS, GERMAN

        if not self.transliterate:
            return pattern
        for a, b in ({**FOLDS, **GERMAN} if self.language == "de" else FOLDS).items():
            pattern = pattern.replace(a, b)
        return "".join(c for c in unicodedata.normalize("NFD", pattern) if not unicodedata.combining(c))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Manifest:
        return Manifest.from_json("\n".join(r[0] for r in spark.read.text(f"{path}/_manifest").limit(10_000).collect()))
