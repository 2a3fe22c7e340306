"""Settings of the ranking operators; from_dict and from_json ignore unknown names and refuse invalid values."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields


def _at_ks(values: list[int]) -> list[str]:
    return [] if values and all(isinstance(k, int) and k > 0 for k in values) else ["top_k_values must be positive whole numbers"]


def _weight(*values: float) -> bool:
    return all(math.isfinite(v) and v >= 0 for v in values)


class Config:
    """What all settings share."""

    def problems(self) -> list[str]:
        raise NotImplementedError

    def validate(self) -> Config:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    @classmethod
    def from_dict(cls, values: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known}).validate()

    @classmethod
    def from_json(cls, path: str):
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))


# Defaults of all settings.
@dataclass(frozen=True)
class BM25Config(Config):
    k1: float = 1.5
    b: float = 0.75
    top_k_values: tuple[int, ...] = (5, 10, 20)
    relevance_threshold: int = 1
    field_weights: dict[str, int] = field(default_factory=lambda: {"title": 3, "description": 1, "category": 2, "subcategory": 2, "brand": 2})
    use_stopwords: bool = True

    def problems(self) -> list[str]:
        checks = {"k1 must be above 0": self.k1 > 0, "b must lie in 0 to 1": 0 <= self.b <= 1, "relevance_threshold must be 1, 2 or 3": self.relevance_threshold in (1, 2, 3), "a field weight must be above 0": any(w > 0 for w in self.field_weights.values())}
        return [k for k, ok in checks.items() if not ok] + _at_ks(list(self.top_k_values))


@dataclass(frozen=True)
class SemanticConfig(Config):
    word_ngram_range: tuple[int, int] = (1, 2)
    char_ngram_range: tuple[int, int] = (3, 5)
    word_weight: float = 1.0
    char_weight: float = 0.5
    min_df: int = 1
    max_df: float = 1.0
    sublinear_tf: bool = True
    svd_components: int = 64
    random_state: int = 20260614
    top_k_values: tuple[int, ...] = (5, 10, 20)
    relevance_threshold: int = 1

    def problems(self) -> list[str]:
        ranges = [len(r) == 2 and all(isinstance(x, int) for x in r) and 1 <= r[0] <= r[1] for r in (self.word_ngram_range, self.char_ngram_range)]
        checks = {"an n-gram range must be two rising whole numbers from 1": all(ranges), "weights must not be negative, nor all 0": _weight(self.word_weight, self.char_weight) and self.word_weight + self.char_weight > 0, "svd_components must be 2 at least": self.svd_components >= 2, "min_df must be 1 at least": self.min_df >= 1, "max_df must lie above 0, up to 1": 0 < self.max_df <= 1, "random_state must be whole": isinstance(self.random_state, int), "relevance_threshold must be 1, 2 or 3": self.relevance_threshold in (1, 2, 3)}
        return [k for k, ok in checks.items() if not ok] + _at_ks(list(self.top_k_values))


@dataclass(frozen=True)
class FusionConfig(Config):
    candidate_k: int = 100
    rrf_k: int = 60
    bm25_weight: float = 0.5
    semantic_weight: float = 0.5
    score_normalization: str = "minmax"
    top_k_values: tuple[int, ...] = (5, 10, 20)
    relevance_threshold: int = 1

    def problems(self) -> list[str]:
        checks = {"candidate_k must reach the largest k": self.candidate_k >= max([1, *self.top_k_values]), "rrf_k must be above 0": self.rrf_k > 0, "weights must not be negative, nor all 0": _weight(self.bm25_weight, self.semantic_weight) and self.bm25_weight + self.semantic_weight > 0, "score_normalization must be minmax": self.score_normalization == "minmax", "relevance_threshold must be 1, 2 or 3": self.relevance_threshold in (1, 2, 3)}
        return [k for k, ok in checks.items() if not ok] + _at_ks(list(self.top_k_values))


@dataclass(frozen=True)
class PersonalizationConfig(Config):
    train_ratio: float = 0.8
    event_weights: dict[str, float] = field(default_factory=lambda: {"click": 1.0, "favorite": 2.0, "add_to_cart": 3.0, "purchase": 5.0})
    half_life_days: float = 30.0
    retrieval_weight: float = 0.70
    category_weight: float = 0.12
    subcategory_weight: float = 0.06
    brand_weight: float = 0.06
    price_weight: float = 0.06
    top_k_values: tuple[int, ...] = (5, 10, 20)
    behavior_relevance: dict[str, int] = field(default_factory=lambda: {"click": 1, "favorite": 2, "add_to_cart": 3, "purchase": 4})

    @property
    def weights(self) -> tuple[float, ...]:
        """The five weights of the score, with sum 1."""
        w = (self.retrieval_weight, self.category_weight, self.subcategory_weight, self.brand_weight, self.price_weight)
        return tuple(x / sum(w) for x in w)

    def problems(self) -> list[str]:
        five = (self.retrieval_weight, self.category_weight, self.subcategory_weight, self.brand_weight, self.price_weight)
        checks = {"train_ratio must lie between 0 and 1": 0 < self.train_ratio < 1, "event weights must not be negative, nor all 0": _weight(*self.event_weights.values()) and any(self.event_weights.values()), "half_life_days must be above 0": self.half_life_days > 0, "score weights must not be negative, nor all 0": _weight(*five) and sum(five) > 0}
        return [k for k, ok in checks.items() if not ok] + _at_ks(list(self.top_k_values))
