"""What searches, profiles and evaluations take, from a data set that was imported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BM25Config, FusionConfig, PersonalizationConfig, SemanticConfig
from ..functions.text import item_text
from ..operators.events import training
from ..operators.profiles import build_profiles
from ..sources.importer import Store
from .indices import IndexStore
from .search import Snapshot, evaluate_queries, search


@dataclass(frozen=True)
class Inputs:
    """The five tables of one published set; it stays that set, whatever is published later."""

    items: DataFrame
    users: DataFrame
    queries: DataFrame
    events: DataFrame
    qrels: DataFrame

    @classmethod
    def of(cls, store: Store) -> Inputs:
        """The set in use; LookupError if nothing is imported."""
        return cls(**store.tables())

    def documents(self, config: BM25Config | None = None) -> DataFrame:
        """(item_id, text): weighted texts for any index."""
        return self.items.select("item_id", item_text((config or BM25Config()).validate().field_weights).alias("text"))

    def snapshot(self, bm25: BM25Config | None = None, semantic: SemanticConfig | None = None, store: IndexStore | None = None, name: str = "items") -> Snapshot:
        """Indices of the items, in a store of indices if one is given: a set with the same items is answered by the same generation."""
        return Snapshot.build(self.items, bm25, semantic, store, name)

    def profiles(self, config: PersonalizationConfig | None = None, half_life: float | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(affinities, summaries) of all users, from all events or the oldest limit of them."""
        return build_profiles(training(self.events, limit=limit), self.items, self.users, config, half_life)

    def search(self, snapshot: Snapshot, requests: DataFrame, mode: str = "linear", top_k: int = 10, profiles: tuple[DataFrame, DataFrame] | None = None, **options) -> DataFrame:
        """Hits of (query_id, query_text?, user_id?), personalised if profiles are given; a request without a text has that of its stored query."""
        known = self.queries.select("query_id", F.col("query_text").alias("_stored"))
        given = F.col("query_text") if "query_text" in requests.columns else F.lit(None).cast("string")
        asked = requests.join(known, "query_id", "left").withColumn("query_text", F.coalesce(given, "_stored")).drop("_stored")
        return search(snapshot, asked, mode, top_k, profiles, profiles is not None, **options)

    def evaluate(self, snapshot: Snapshot, query_ids: DataFrame | None = None, config: FusionConfig | None = None, mode: str = "linear", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(metrics by query and k, macro averages) of the queries asked for, all that have judgements by default."""
        ids = self.qrels.select("query_id").distinct() if query_ids is None else query_ids
        return evaluate_queries(snapshot, ids, self.queries, self.qrels, config, mode, digits)
