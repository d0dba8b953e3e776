"""Plugins: contracts, registries, a loader, and two built-in taggers.

A tagger turns a table of spans into one with its columns, so a plugin is a part of the plan
and not a call per row.  Registries hold plugins by unique names; the loader makes them from
entries of name, module, class and configuration.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from importlib import import_module
from typing import Any, Generic, Protocol, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = TypeVar("P", bound="Named")


class Named(Protocol):
    name: str
    version: str


class Tagger(Named, Protocol):
    def tag(self, spans: DataFrame, node: Mapping[str, Any]) -> DataFrame:
        """spans (span_id, text, …) with keep, review_status, hits and features."""


class Controller(Named, Protocol):
    def control_profile(self, materials: DataFrame, request: Mapping[str, Any]) -> DataFrame:
        """materials with a column control: map<string, string>."""


class Builder(Named, Protocol):
    def prompt_bundle(self, materials: DataFrame) -> DataFrame:
        """materials (with control) with a column prompt: string."""

    def validate_output(self, outputs: DataFrame) -> DataFrame:
        """outputs with valid: boolean and issues: array<string>."""


class Registry(Generic[P]):
    """Plugins by name; a name can be taken once."""

    def __init__(self) -> None:
        self._held: dict[str, P] = {}

    def register(self, plugin: P) -> None:
        if plugin.name in self._held:
            raise ValueError(f"there is a plugin named {plugin.name} already")
        self._held[plugin.name] = plugin

    def get(self, name: str) -> P:
        return self._held[name]

    def names(self) -> list[str]:
        return list(self._held)


def load(entries: Iterable[Mapping[str, Any]], registry: Registry) -> None:
    """Registers the plugins of all enabled entries whose names aren't taken yet."""
    for entry in entries:
        if entry.get("enabled", True) and entry["name"] not in registry.names():
            made = getattr(import_module(entry["module"]), entry["class"])
            registry.register(made(**entry.get("config", {})))


def _status(ok: Column) -> Column:
    return F.when(ok, "auto_tagged").otherwise("review_pending")


class KeywordTagger:
    """Hits of a knowledge node's aliases."""

    name, version, confidence = "keyword_tagger", "1", 0.7

    def tag(self, spans: DataFrame, node: Mapping[str, Any]) -> DataFrame:
        aliases = [a for a in node.get("aliases", []) if a]
        text = F.coalesce("text", F.lit(""))
        hit = lambda a: F.struct(F.lit(node.get("node_id")).alias("node"), F.lit(self.confidence).alias("confidence"), F.lit(a).alias("evidence"))
        none = F.array().cast("array<struct<node: string, confidence: double, evidence: string>>")
        hits = F.array_compact(F.array(*(F.when(text.contains(a), hit(a)) for a in aliases))) if aliases else none
        out = spans.withColumns({"keep": F.lit(True), "hits": hits})
        return out.withColumn("review_status", _status(F.size("hits") > 0))


class FeatureTagger:
    """Strengths by markers and length; spans that are too short aren't kept."""

    name, version = "feature_tagger", "1"
    # Feature: markers, value with one of them, value without.
    FEATURES = {
        "transition_strength": (("但是", "然而", "不过"), 0.7, 0.2),
        "summary_strength": (("总之", "因此", "可见"), 0.7, 0.3),
        "explanation_strength": (("例如", "比如", "即"), 0.8, 0.3),
        "ordering_anchor_strength": (("首先", "其次", "最后"), 0.8, 0.2),
        "story_completeness_strength": (("后来", "最终", "于是"), 0.7, 0.2),
    }

    def __init__(self, least_chars: int = 120) -> None:
        self.least_chars = least_chars

    def tag(self, spans: DataFrame, node: Mapping[str, Any]) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        keep = F.length(F.trim(text)) >= self.least_chars
        parts = F.size(F.split(text, "\n\n"))
        features = {}
        for name, (markers, yes, no) in self.FEATURES.items():
            features[name] = F.when(text.rlike("|".join(markers)), yes).otherwise(no)
        features |= {
            "single_center_strength": F.least(F.length(text) / 800, F.lit(1.0)),
            "conclusion_sentence_strength": F.when(text.rlike("[。！？]$"), 0.6).otherwise(0.2),
            "independence_score": F.when(parts >= 2, 0.8).otherwise(0.5),
            "question_worthiness_score": F.when(keep, 0.8).otherwise(0.3),
            "distractor_space": F.lit(0.5),
        }
        entries = [x for k, v in features.items() for x in (F.lit(k), v)]
        return spans.withColumns({"keep": keep, "features": F.create_map(*entries), "review_status": _status(keep)})


TAGGERS: Registry[Tagger] = Registry()
CONTROLLERS: Registry[Controller] = Registry()
BUILDERS: Registry[Builder] = Registry()
#: The built-in plugins, as a configuration would name them.
BUILT_IN = (
    {"name": KeywordTagger.name, "module": "vellumine.plugins", "class": "KeywordTagger"},
    {"name": FeatureTagger.name, "module": "vellumine.plugins", "class": "FeatureTagger"},
)


class Provider(Protocol):
    """A language model, which may be absent; tests use none."""

    def enabled(self) -> bool: ...

    def votes(self, prompts: DataFrame) -> DataFrame:
        """prompts (id, prompt) to votes (id, voter, decision, status)."""


class NoProvider:
    """Gives no votes, so that rules decide alone."""

    def enabled(self) -> bool:
        return False

    def votes(self, prompts: DataFrame) -> DataFrame:
        return prompts.sparkSession.createDataFrame([], "id string, voter string, decision string, status string")
