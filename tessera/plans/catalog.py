"""Queries by name over the test tables, each through the library's operators, and the same in SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import finite, gain, minmax, ranked
from ..functions.text import char_ngrams, item_text, tokenize, word_ngrams
from ..operators import events as E
from ..operators import fusion, lookups, metrics, profiles, rerank, tfidf
from ..operators.vectors import vector_search
from ..operators.bm25 import BM25Index
from ..sources import validate
from . import search as S
from . import views as V
from .indices import Generation, IndexConfig, IndexStore
from .views import sql

Query = Callable[[SparkSession, str], DataFrame]
KS = [5, 10, 20]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WORDS = "[a-z0-9][a-z0-9]+"
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)


def query(text: str | None = None, *names: str):
    """Registers a function by its name, with SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *names) if names else text
        return f

    return add


# ---- events


@query("SELECT event_type, count(*) AS count FROM ev GROUP BY event_type", "ev")
def event_counts_by_type(spark, d):
    return E.counts_by_type(V.events(spark, d))


_FUNNEL = "SELECT count(*) AS total_events, count(*) FILTER (event_type = 'impression') AS impression_count, count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'favorite') AS favorite_count, count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart_count, count(*) FILTER (event_type = 'purchase') AS purchase_count FROM ev WHERE {}"
_RATES = "SELECT *, round(coalesce(click_count / nullif(impression_count, 0), 0), 6) AS ctr, round(coalesce(favorite_count / nullif(click_count, 0), 0), 6) AS favorite_rate, round(coalesce(add_to_cart_count / nullif(click_count, 0), 0), 6) AS cart_rate, round(coalesce(purchase_count / nullif(click_count, 0), 0), 6) AS purchase_rate FROM ("


@query(_RATES + _FUNNEL.format("true") + ")", "ev")
def event_stats_all(spark, d):
    return E.funnel(V.events(spark, d))


@query(_RATES + _FUNNEL.format("user_id = 7") + ")", "ev")
def event_stats_user(spark, d):
    return E.funnel(E.matching(V.events(spark, d), user_id=7))


@query(_RATES + _FUNNEL.format("timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND event_type = 'click'") + ")", "ev")
def event_stats_time_range(spark, d):
    return E.funnel(E.matching(V.events(spark, d), event_type="click", start=START, end=END))


@query("SELECT event_id, event_type, user_id, timestamp FROM ev ORDER BY timestamp DESC, event_id LIMIT 50", "ev")
def recent_events(spark, d):
    return E.recent(V.events(spark, d), 50).select("event_id", "event_type", "user_id", "timestamp")


@query("SELECT event_id, event_type, item_id, timestamp FROM ev WHERE user_id = 3 AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20' ORDER BY timestamp, event_id LIMIT 1000", "ev")
def user_events_page(spark, d):
    return E.for_user(V.events(spark, d), 3, after=START, before=END).select("event_id", "event_type", "item_id", "timestamp")


@query("SELECT event_id, user_id, timestamp FROM ev WHERE query_id = 11 ORDER BY timestamp, event_id LIMIT 1000", "ev")
def query_events_page(spark, d):
    return E.for_query(V.events(spark, d), 11).select("event_id", "user_id", "timestamp")


@query("SELECT event_id, position FROM ev WHERE request_id = 'r5' ORDER BY position, event_id LIMIT 100", "ev")
def request_events_page(spark, d):
    return E.for_request(V.events(spark, d), "r5").select("event_id", "position")


@query("SELECT event_id, user_id, item_id, event_type, timestamp, session_id FROM ev WHERE event_type IN ('click', 'purchase') ORDER BY timestamp, event_id LIMIT 20000", "ev")
def training_events_oldest(spark, d):
    return E.training(V.events(spark, d), ("click", "purchase"))


@query("SELECT count(*) AS appended, count(DISTINCT client) AS clients FROM (SELECT user_id || ':' || item_id AS client, row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp, event_id) AS n FROM ev) WHERE n = 1", "ev")
def event_dedup_idempotent(spark, d):
    e = V.events(spark, d).withColumn("client_event_id", F.concat_ws(":", "user_id", "item_id")).withColumn("query_text", F.lit(" "))
    fresh, _ = E.capture(e.limit(0), e, checked=False)  # the table's own types count too
    return fresh.agg(F.count("*").alias("appended"), F.count_distinct("client_event_id").alias("clients"))


# ---- lookups


@query("SELECT item_id, title, category, brand, CAST(price AS DOUBLE) AS price FROM items ORDER BY item_id LIMIT 100 OFFSET 20", "items")
def items_page(spark, d):
    return lookups.page(V.items(spark, d), "item_id", 20, 100).select("item_id", "title", "category", "brand", F.col("price").cast("double").alias("price"))


@query("SELECT item_id, title FROM items WHERE category = 'ECONOMY' ORDER BY item_id LIMIT 100", "items")
def items_category_page(spark, d):
    return lookups.page(V.items(spark, d), "item_id", where=F.col("category") == "ECONOMY").select("item_id", "title")


@query("SELECT item_id, title FROM items WHERE item_id IN (3, 1, 77, 99999999)", "items")
def items_by_ids(spark, d):
    return lookups.by_ids(V.items(spark, d), "item_id", [3, 1, 77, 3, 99999999]).select("item_id", "title")


@query("SELECT item_id, title, CAST(price AS DOUBLE) AS price FROM items WHERE item_id = 5", "items")
def items_point_lookup(spark, d):
    return lookups.by_id(V.items(spark, d), "item_id", 5).select("item_id", "title", F.col("price").cast("double").alias("price"))


@query("SELECT user_id, is_cold_start FROM us WHERE is_cold_start ORDER BY user_id LIMIT 100", "us")
def users_cold_page(spark, d):
    return lookups.page(V.users(spark, d), "user_id", where=F.col("is_cold_start"))


@query("SELECT 'items' AS \"table\", count(*) AS rows FROM items UNION ALL SELECT 'users', count(*) FROM us UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'qrels', count(*) FROM qr", "items", "us", "ev", "qr")
def table_counts(spark, d):
    return lookups.table_counts({"items": V.items(spark, d), "users": V.users(spark, d), "events": V.events(spark, d), "qrels": V.qrels(spark, d)})


# ---- text and indices


@query(f"SELECT item_id, pos - 1 AS position, toks[pos] AS token FROM (SELECT item_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT item_id, {V.tokens_sql('text')} AS toks FROM docs))", "docs")
def tokenize_docs(spark, d):
    return V.docs(spark, d).select("item_id", F.posexplode(tokenize(F.col("text"), normalise=False)).alias("position", "token")).withColumn("position", F.col("position").cast("long"))


@query("SELECT item_id, text FROM itemtext", "itemtext")
def item_weighted_text(spark, d):
    return V.items(spark, d).select("item_id", item_text().alias("text"))


def _name(d: str, table: str) -> str:
    """An index's name: its table, and the folder that it is read from."""
    return f"{table}-{zlib.crc32(d.encode()):08x}"


#: The channels as collections of their own, so that a query makes only what it reads.
BM25_ONLY, TFIDF_ONLY = IndexConfig(normalise=False), IndexConfig(bm25=False, pattern=WORDS)


def _index(spark, d) -> BM25Index:
    return IndexStore(spark).open(_name(d, "docs"), V.docs(spark, d), BM25_ONLY).bm25()


def _shop(spark, d) -> DataFrame:
    return V.items(spark, d).select("item_id", item_text().alias("text"))


def _shop_docs(spark, d) -> Generation:
    """Both channels of the items, of one generation."""
    return IndexStore(spark).open(_name(d, "items"), _shop(spark, d), IndexConfig(normalise=False, pattern=WORDS))


def _shop_index(spark, d) -> BM25Index:
    return IndexStore(spark).open(_name(d, "items"), _shop(spark, d), BM25_ONLY).bm25()


@query("SELECT item_id, term, tf FROM p", "p")
def bm25_term_freq(spark, d):
    return _index(spark, d).postings.select("item_id", "term", "tf")


@query("SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM t, st", "t", "st")
def bm25_doc_freq_idf(spark, d):
    index = _index(spark, d)
    from ..functions.scoring import idf

    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM t) AS vocabulary FROM st", "st", "t")
def bm25_doc_stats(spark, d):
    index = _index(spark, d)
    return index.stats.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(index.terms.agg(F.count("*").alias("vocabulary")))


@query("SELECT query_id, item_id, score, rank FROM bm WHERE rank <= 10", "bm")
def bm25_search_topk(spark, d):
    return _index(spark, d).search(V.passages(spark, d), 10, 6)


@query("SELECT query_id, item_id, score, rank FROM shbm WHERE rank <= 20", "shbm")
def bm25_search_items(spark, d):
    return _shop_index(spark, d).search(V.shop_queries(spark, d), 20, 6)


@query("SELECT item_id, feature, round(weight, 6) AS weight FROM fx", "fx")
def tfidf_word_weights(spark, d):
    return tfidf.word_weights(V.docs(spark, d), WORDS).withColumn("weight", F.round("weight", 6))


_CHARS = "SELECT item_id, feature, count(*) AS tf FROM (SELECT item_id, unnest(CASE WHEN k = 3 OR length(p) > k - 1 THEN list_transform(range(1, greatest(length(p) - k + 1, 1) + 1), lambda i: substr(p, i, k)) ELSE [] END) AS feature FROM (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS p FROM itemtext), (SELECT unnest([3, 4, 5]) AS k)) GROUP BY ALL"


@query(f"SELECT item_id, feature, round((1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1.0) * 0.5, 6) AS weight FROM ({_CHARS}) JOIN (SELECT feature, count(*) AS df FROM ({_CHARS}) GROUP BY feature) USING (feature), (SELECT count(*) AS n FROM itemtext)", "itemtext")
def tfidf_char_weights(spark, d):
    docs = _shop(spark, d)
    tf = tfidf.counts(docs, char_ngrams(F.col("text")))
    return tfidf.weigh(tf, tfidf.vocabulary(tf, docs.count()), 0.5).withColumn("weight", F.round("weight", 6))


@query("SELECT feature, round(idf, 6) AS idf FROM fi JOIN (SELECT feature, count(*) AS df FROM ftf GROUP BY feature) USING (feature), st WHERE df >= 3 AND df <= 0.5 * n", "fi", "ftf", "st")
def tfidf_pruned_vocabulary(spark, d):
    docs = V.docs(spark, d)
    return tfidf.vocabulary(tfidf.counts(docs, word_ngrams(F.col("text"), 1, 2, WORDS)), docs.count(), 3, 0.5).withColumn("idf", F.round("idf", 6))


def _tfidf(spark, d) -> tfidf.TfidfIndex:
    return IndexStore(spark).open(_name(d, "docs"), V.docs(spark, d), TFIDF_ONLY).tfidf()


@query("SELECT query_id, item_id, score, rank FROM cr WHERE rank <= 10", "cr")
def tfidf_cosine_topk(spark, d):
    return _tfidf(spark, d).search(V.passages(spark, d), 10, 6)


@query("SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10")
def embedding_cosine_topk(spark, d):
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    v = v.withColumn("n", length).filter("n > 1e-8").select("item_id", F.transform("vector", lambda x: x / F.col("n")).alias("vector"))
    q = v.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("q"))
    return vector_search(q, v, 10, 6)


@query()
def lsa_search_topk(spark, d):
    """Rows only: the decomposition is no SQL."""
    return S.Snapshot.build(V.items(spark, d), store=IndexStore(spark), name=_name(d, "items")).semantic.search(V.shop_queries(spark, d), 10)


# ---- fusion


def _both(spark, d) -> DataFrame:
    return fusion.candidates(_index(spark, d).search(V.passages(spark, d), 100, 6), _tfidf(spark, d).search(V.passages(spark, d), 100, 6))


@query("SELECT query_id, item_id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(semantic_rank, 0) AS semantic_rank, CASE WHEN c.semantic_rank IS NULL THEN 'bm25' WHEN c.bm25_rank IS NULL THEN 'semantic' ELSE 'bm25,semantic' END AS sources FROM c", "c")
def candidate_union_sources(spark, d):
    return _both(spark, d).select("query_id", "item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "semantic_rank")), F.array_join("sources", ",").alias("sources"))


@query("SELECT query_id, item_id, fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, item_id) AS rank FROM (SELECT *, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 6) AS fusion_score FROM c) QUALIFY rank <= 20", "c")
def rrf_fusion_topk(spark, d):
    return fusion.fuse_rrf(_both(spark, d), 60, 20, 6).select("query_id", "item_id", "fusion_score", "rank")


@query("SELECT query_id, item_id, fusion_score, rank FROM lin WHERE rank <= 20", "lin")
def linear_fusion_topk(spark, d):
    return fusion.fuse_linear(_both(spark, d), 0.5, 0.5, 20, 6).select("query_id", "item_id", "fusion_score", "rank")


@query("SELECT query_id, item_id, round(bm25_norm, 6) AS bm25_norm, round(semantic_norm, 6) AS semantic_norm FROM n", "n")
def minmax_normalized_scores(spark, d):
    both = _both(spark, d)
    return both.select("query_id", "item_id", F.round(minmax(F.col("bm25_score"), ["query_id"]), 6).alias("bm25_norm"), F.round(minmax(F.col("semantic_score"), ["query_id"]), 6).alias("semantic_norm"))


@query("SELECT count(*) AS rows, count(*) FILTER (abs(x) < 'inf'::DOUBLE) AS finite FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def finite_scores(spark, d):
    x = V.table(spark, d, "embeddings").select(F.explode("embedding").alias("x"))
    return x.agg(F.count("*").alias("rows"), F.count_if(finite(F.col("x").cast("double"))).alias("finite"))


# ---- profiles


def _profiles(spark, d, half_life: float = 0.0):
    return profiles.build_profiles(V.events(spark, d), V.items(spark, d), V.users(spark, d), half_life=half_life)


@query("SELECT user_id, dim, key, round(score, 6) AS score, round(weight, 6) AS weight FROM aff", "aff")
def profile_affinity(spark, d):
    return _profiles(spark, d)[0].select("user_id", "dim", "key", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


@query("SELECT user_id, dim, key, round(weight, 6) AS weight FROM affd", "affd")
def profile_affinity_decayed(spark, d):
    return _profiles(spark, d, 30.0)[0].select("user_id", "dim", "key", F.round("weight", 6).alias("weight"))


@query("SELECT user_id, round(mean_log_price, 6) AS mean_log_price FROM sumd", "sumd")
def profile_price_pref(spark, d):
    return _profiles(spark, d, 30.0)[1].select("user_id", F.round("mean_log_price", 6).alias("mean_log_price"))


@query("SELECT user_id, is_cold_start, train_event_count, positive_event_count, train_session_count, profile_status FROM sum", "sum")
def profile_status(spark, d):
    return _profiles(spark, d)[1].select("user_id", "is_cold_start", *(F.col(c).cast("long").alias(c) for c in ("train_event_count", "positive_event_count", "train_session_count")), "profile_status")


@query("SELECT count(*) AS total_users, count(*) FILTER (profile_status = 'warm' AND positive_event_count > 0) AS behavior_profiles, count(*) FILTER (NOT (profile_status = 'warm' AND positive_event_count > 0)) AS fallback_profiles FROM sum", "sum")
def profile_status_counts(spark, d):
    return profiles.status_counts(_profiles(spark, d)[1])


@query("""SELECT user_id, dim, key, round(score / sum(score) OVER (PARTITION BY user_id, dim), 6) AS weight FROM (
  SELECT user_id, dim, key, sum(weight * share) AS score FROM (
    SELECT user_id, dim, key, weight, 0.4 AS share FROM aff UNION ALL SELECT user_id, dim, key, weight, 0.6 FROM affd) WHERE dim <> 'subcategory' GROUP BY ALL)""", "aff", "affd")
def profile_merge(spark, d):
    affinity, _ = profiles.merge(_profiles(spark, d), _profiles(spark, d, 30.0))
    return affinity.select("user_id", "dim", "key", F.round("weight", 6).alias("weight"))


@query("SELECT source, count(*) AS users FROM (SELECT CASE WHEN profile_status = 'warm' THEN 'combined' ELSE 'base' END AS source FROM sum) GROUP BY source", "sum")
def profile_refresh_sources(spark, d):
    """All users refreshed with the events that built their profiles: warm ones are blended, others keep their base."""
    users = V.users(spark, d)
    _, summary = profiles.refresh(users, users, V.events(spark, d), V.items(spark, d), _profiles(spark, d), limit=None)
    return summary.groupBy("source").agg(F.count("*").alias("users"))


@query("SELECT (SELECT count(*) FROM us) + 1 AS requested, count(*) FILTER (profile_status = 'warm') AS refreshed, count(*) FILTER (profile_status <> 'warm') AS unchanged, CAST(1 AS BIGINT) AS failed, (SELECT count(*) FROM ev) AS total_events FROM sum", "sum", "us", "ev")
def profile_refresh_counts(spark, d):
    """All users and one who does not exist."""
    users, log = V.users(spark, d), V.events(spark, d)
    _, summary = profiles.refresh(users, users, log, V.items(spark, d), _profiles(spark, d), limit=None)
    wanted = users.select("user_id").unionByName(spark.range(-99, -98).withColumnRenamed("id", "user_id"))
    return profiles.refresh_counts(summary, wanted, log)


# ---- re-ranking


def _shop_hits(spark, d) -> DataFrame:
    asked = V.shop_queries(spark, d)
    g = _shop_docs(spark, d)
    both = fusion.candidates(g.bm25().search(asked, 50, 6), g.tfidf().search(asked, 50, 6))
    return fusion.fuse_linear(both, 0.5, 0.5, 20, 6).select("query_id", "item_id", "rank", "fusion_score").join(asked.select("query_id", "user_id"), "query_id")


def _reranked(spark, d) -> DataFrame:
    return rerank.rerank(_shop_hits(spark, d), _profiles(spark, d), V.items(spark, d), digits=6)


@query("SELECT query_id, user_id, item_id, rank, original_rank, personalized_score FROM rr WHERE warm", "rr")
def rerank_warm(spark, d):
    return _reranked(spark, d).filter("applied").select("query_id", "user_id", "item_id", "rank", "original_rank", "personalized_score")


@query("SELECT query_id, user_id, item_id, rank, original_rank, warm AS applied, fallback_reason FROM rr", "rr")
def rerank_fallback(spark, d):
    return _reranked(spark, d).select("query_id", "user_id", "item_id", "rank", "original_rank", "applied", "fallback_reason")


@query("SELECT r.query_id, r.user_id, r.item_id, i.title, r.personalized_score, r.rank FROM rr r JOIN items i ON i.item_id = r.item_id WHERE r.rank <= 10", "rr", "items")
def personalized_linear_search(spark, d):
    hits = _reranked(spark, d).filter("rank <= 10")
    return hits.join(V.items(spark, d).select("item_id", "title"), "item_id").select("query_id", "user_id", "item_id", "title", "personalized_score", "rank")


@query()
def personalized_search_lsa(spark, d):
    """The whole search plan, with the latent semantic channel; rows only."""
    snapshot = S.Snapshot.build(V.items(spark, d), store=IndexStore(spark), name=_name(d, "items"))
    return S.search(snapshot, V.shop_queries(spark, d), "linear", 10, _profiles(spark, d), True).select("query_id", "user_id", "item_id", "personalized_score", "rank")


# ---- metrics

def _judged(hits: str, judged: str, top: int) -> str:
    return f"SELECT r.query_id, r.item_id, r.rank, coalesce(q.grade, 0) AS grade FROM (SELECT * FROM {hits} WHERE rank <= {top}) r LEFT JOIN {judged} q USING (query_id, item_id)"


def _metrics_sql(hits: str, judged: str, asked: str, top: int) -> str:
    rows, ks = _judged(hits, judged, top), "(SELECT unnest([5, 10, 20]) AS k)"
    best = f"SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM {judged}"
    return f"""SELECT a.query_id, a.k, round(coalesce(hits, 0) / a.k, 6) AS precision, round(coalesce(hits / nullif(relevant, 0), 0), 6) AS recall,
  round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg
FROM (SELECT query_id, unnest([5, 10, 20])::BIGINT AS k FROM {asked}) a
LEFT JOIN (SELECT query_id, k, count(*) FILTER (rank <= k AND grade >= 1) AS hits, min(rank) FILTER (rank <= k AND grade >= 1) AS first,
  sum((2.0 ** grade - 1) / log2(rank + 1.0)) FILTER (rank <= k) AS dcg FROM ({rows}), {ks} GROUP BY query_id, k) m USING (query_id, k)
LEFT JOIN (SELECT query_id, count(*) FILTER (grade >= 1) AS relevant FROM {judged} GROUP BY query_id) n USING (query_id)
LEFT JOIN (SELECT query_id, k, sum((2.0 ** grade - 1) / log2(place + 1.0)) FILTER (place <= k) AS idcg FROM ({best}), {ks} GROUP BY query_id, k) i USING (query_id, k)"""


_JUDGED = _judged("bm", "qr", 20)
_METRICS = _metrics_sql("bm", "qr", "passages", 20)


def _metrics(spark, d, digits: int | None = 6) -> DataFrame:
    return metrics.evaluate(_index(spark, d).search(V.passages(spark, d), 20, 6), V.qrels(spark, d), V.passages(spark, d), KS, 1, digits)


@query(_METRICS, "bm", "qr", "passages")
def metrics_at_k(spark, d):
    return _metrics(spark, d)


@query(f"SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({_METRICS}) GROUP BY k", "bm", "qr", "passages")
def macro_average(spark, d):
    return metrics.macro_average(_metrics(spark, d), 6)


@query("SELECT query_id, k, round(sum((2.0 ** grade - 1) / log2(place + 1.0)) FILTER (place <= k), 6) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM qr), (SELECT unnest([5, 10, 20])::BIGINT AS k) GROUP BY query_id, k", "qr")
def ideal_dcg(spark, d):
    return metrics.ideal_dcg(V.qrels(spark, d), KS).withColumn("idcg", F.round("idcg", 6))


@query("SELECT query_id, item_id, round((2.0 ** grade - 1) / log2(rank + 1.0), 6) AS gain FROM (" + _JUDGED + ")", "bm", "qr")
def graded_gains(spark, d):
    r = _index(spark, d).search(V.passages(spark, d), 20, 6).join(V.qrels(spark, d), ["query_id", "item_id"], "left")
    return r.select("query_id", "item_id", F.round(gain(F.coalesce("grade", F.lit(0)), F.col("rank")), 6).alias("gain"))


# behaviour: a user's clicked items are graded by the strongest event; their result list is by item popularity
_GRADES = "SELECT user_id AS request_id, item_id, max(CASE event_type WHEN 'click' THEN 1 WHEN 'favorite' THEN 2 WHEN 'add_to_cart' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)::BIGINT AS grade FROM ev WHERE event_type <> 'error' GROUP BY ALL"
_POPULAR = "SELECT user_id AS request_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id) JOIN (SELECT DISTINCT user_id, item_id FROM ev WHERE event_type IN ('impression', 'error')) USING (item_id)"


def _behaviour(spark, d) -> tuple[DataFrame, DataFrame]:
    e = V.events(spark, d)
    grade = F.max(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "favorite", 2).when(F.col("event_type") == "add_to_cart", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)).cast("long")
    grades = e.filter("event_type <> 'error'").groupBy(F.col("user_id").alias("request_id"), "item_id").agg(grade.alias("grade"))
    seen = e.filter(F.col("event_type").isin("impression", "error")).select(F.col("user_id").alias("request_id"), "item_id").distinct()
    results = ranked(seen.join(e.groupBy("item_id").agg(F.count("*").alias("n")), "item_id"), ["request_id"], [F.desc("n"), F.asc("item_id")]).select("request_id", "item_id", "rank")
    return results, grades


@query(f"""SELECT m.request_id, m.k, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(hits / nullif(positives, 0), 0), 6) AS positive_recall
FROM (SELECT request_id, k, count(*) FILTER (rank <= k AND grade > 0) AS hits, min(rank) FILTER (rank <= k AND grade > 0) AS first, sum((2.0 ** grade - 1) / log2(rank + 1.0)) FILTER (rank <= k) AS dcg FROM (SELECT r.request_id, r.item_id, r.rank, coalesce(g.grade, 0) AS grade FROM ({_POPULAR}) r LEFT JOIN ({_GRADES}) g USING (request_id, item_id)), (SELECT unnest([5, 10, 20])::BIGINT AS k) GROUP BY request_id, k) m
LEFT JOIN (SELECT request_id, count(*) FILTER (grade > 0) AS positives FROM ({_GRADES}) GROUP BY request_id) p USING (request_id)
LEFT JOIN (SELECT request_id, k, sum((2.0 ** grade - 1) / log2(place + 1.0)) FILTER (place <= k) AS idcg FROM (SELECT request_id, grade, row_number() OVER (PARTITION BY request_id ORDER BY grade DESC) AS place FROM ({_GRADES})), (SELECT unnest([5, 10, 20])::BIGINT AS k) GROUP BY request_id, k) i USING (request_id, k)""", "ev")
def behavior_metrics(spark, d):
    return metrics.behaviour_metrics(*_behaviour(spark, d), KS, 6)


@query(f"""WITH ev2 AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'impression' WHEN event_type = 'click' THEN 'click' WHEN event_type = 'signup' THEN 'favorite' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'add_to_cart' ELSE event_type END AS event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id FROM events),
g AS ({_GRADES.replace('FROM ev', 'FROM ev2')}),
asked AS (SELECT e.request_id, s.request_id IS NOT NULL AS known, e.request_id % 7 AS query_id, CASE WHEN e.request_id % 10 = 0 THEN 'cold_start' ELSE 'warm' END AS status FROM (SELECT DISTINCT user_id AS request_id FROM events UNION ALL SELECT -1) e LEFT JOIN (SELECT DISTINCT user_id AS request_id FROM events) s USING (request_id)),
per AS (SELECT a.request_id, known, status, count(w.item_id) AS wanted, count(w.item_id) FILTER (w.item_id % 7 = a.query_id) AS covered FROM asked a LEFT JOIN (SELECT * FROM g WHERE grade > 0) w USING (request_id) GROUP BY ALL)
SELECT count(*) AS eligible_positive_request_count, count(*) FILTER (known AND covered > 0) AS covered_positive_request_count, count(*) FILTER (known AND covered = 0) AS uncovered_positive_request_count, round(count(*) FILTER (known AND covered > 0) / count(*), 6) AS request_level_candidate_positive_coverage, coalesce(sum(wanted) FILTER (known), 0)::BIGINT AS total_positive_item_count, coalesce(sum(covered) FILTER (known), 0)::BIGINT AS covered_positive_item_count, coalesce(sum(wanted - covered) FILTER (known), 0)::BIGINT AS uncovered_positive_item_count, round(coalesce(sum(covered) FILTER (known) / nullif(sum(wanted) FILTER (known), 0), 0), 6) AS item_level_candidate_positive_recall, round(coalesce(count(*) FILTER (known AND covered > 0 AND status = 'warm') / nullif(count(*) FILTER (known AND status = 'warm'), 0), 0), 6) AS warm_request_coverage, round(coalesce(count(*) FILTER (known AND covered > 0 AND status <> 'warm') / nullif(count(*) FILTER (known AND status <> 'warm'), 0), 0), 6) AS fallback_request_coverage FROM per""")
def candidate_coverage(spark, d):
    _, grades = _behaviour(spark, d)
    known = V.table(spark, d, "events").select(F.col("user_id").alias("request_id")).distinct()
    eligible = known.unionByName(spark.range(-1, 0).withColumnRenamed("id", "request_id"))
    requests = known.select("request_id", (F.col("request_id") % 7).alias("query_id"), F.when(F.col("request_id") % 10 == 0, "cold_start").otherwise("warm").alias("profile_status"))
    found = grades.select("item_id").distinct().select((F.col("item_id") % 7).alias("query_id"), "item_id")
    return metrics.coverage(eligible, requests, grades, found)


_BASE = "SELECT query_id, item_id, rank AS base_rank FROM shlin WHERE rank <= 10"
_MINE = "SELECT query_id, item_id, rank AS personal_rank FROM rr WHERE rank <= 10"


def _impact(spark, d) -> tuple[DataFrame, DataFrame]:
    return _shop_hits(spark, d).filter("rank <= 10"), _reranked(spark, d).filter("rank <= 10")


@query(f"SELECT query_id, round(count(personal_rank) / 10.0, 4) AS overlap, count(*) FILTER (base_rank <> coalesce(personal_rank, 999)) AS changed_positions FROM ({_BASE}) LEFT JOIN ({_MINE}) USING (query_id, item_id) GROUP BY query_id", "shlin", "rr")
def profile_impact_overlap(spark, d):
    return metrics.overlap(*_impact(spark, d), 10)


@query(f"SELECT query_id, item_id, base_rank, coalesce(personal_rank, 999) AS personal_rank, base_rank - coalesce(personal_rank, 999) AS delta, CASE WHEN base_rank > coalesce(personal_rank, 999) THEN 'promoted' WHEN base_rank < coalesce(personal_rank, 999) THEN 'demoted' ELSE 'same' END AS move FROM ({_BASE}) LEFT JOIN ({_MINE}) USING (query_id, item_id)", "shlin", "rr")
def profile_rank_shifts(spark, d):
    return metrics.rank_shifts(*_impact(spark, d))


@query("SELECT query_id || ':' || user_id || ':' || rank AS event_id, 'impression' AS event_type, user_id, query_id, item_id, rank AS position FROM rr WHERE rank <= 10", "rr")
def impressions_from_hits(spark, d):
    return E.impressions(_reranked(spark, d).filter("rank <= 10"))


# ---- validation: the test tables as text, with what they hold of bad rows


@query("""SELECT rule, count(*) AS violations FROM (
  SELECT 'event_type' AS rule FROM ev WHERE event_type = 'error'
  UNION ALL SELECT 'unknown_item_id' FROM ev WHERE event_type <> 'error' AND item_id NOT IN (SELECT item_id FROM items WHERE item_id % 5 <> 0)
  UNION ALL SELECT 'unknown_user_id' FROM ev WHERE event_type <> 'error' AND user_id % 9 = 0) GROUP BY rule""", "ev", "items")
def validate_events_violations(spark, d):
    """Events against the items not divisible by 5 and the users not divisible by 9."""
    e = V.events(spark, d)
    text = e.select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "event_type", "request_id", "session_id", "user_id", "item_id", "position")), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *(F.lit(None).cast("string").alias(c) for c in ("query_id", "query_text", "click_duration_ms", "add_to_cart_quantity", "purchase_amount")))
    others = {"items": V.items(spark, d).filter("item_id % 5 <> 0").select(F.col("item_id").cast("string").alias("item_id")), "users": V.users(spark, d).filter("user_id % 9 <> 0").select(F.col("user_id").cast("string").alias("user_id"))}
    return validate.violations("events", text, others).groupBy("rule").agg(F.count("*").alias("violations"))


@query("SELECT rule, count(*) AS violations FROM (SELECT 'relevance_grade' AS rule FROM qr WHERE grade + (item_id % 2) > 3 UNION ALL SELECT 'unknown_item_id' FROM qr WHERE item_id % 4 = 0) GROUP BY rule", "qr")
def validate_qrels_violations(spark, d):
    """Judgements with some grades raised above 3, against the documents not divisible by 4."""
    q = V.qrels(spark, d)
    text = q.select(F.col("query_id").cast("string").alias("query_id"), F.col("item_id").cast("string").alias("item_id"), (F.col("grade") + F.col("item_id") % 2).cast("string").alias("relevance_grade"))
    others = {"queries": V.passages(spark, d).select(F.col("query_id").cast("string").alias("query_id")), "items": V.docs(spark, d).filter("item_id % 4 <> 0").select(F.col("item_id").cast("string").alias("item_id"))}
    return validate.violations("qrels", text, others).groupBy("rule").agg(F.count("*").alias("violations"))


@query("SELECT rule, count(*) AS violations FROM (SELECT 'price' AS rule FROM part WHERE p_retailprice - 950 < 0 UNION ALL SELECT 'quality_score' FROM part WHERE p_size / 40.0 > 1) GROUP BY rule")
def validate_items_violations(spark, d):
    """Items whose price less 950 is negative, or whose size over 40 is no share."""
    p = V.table(spark, d, "part")
    text = p.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.lit("").alias("description"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("subcategory"), F.col("p_brand").alias("brand"), (F.col("p_retailprice") - 950).cast("decimal(12,2)").cast("string").alias("price"), (F.col("p_size") / 40.0).cast("string").alias("quality_score"), F.lit("0.5").alias("popularity_score"), F.lit(" Yes").alias("is_cold_start"), F.lit("2026-01-01T00:00:00").alias("created_at"))
    return validate.violations("items", text).groupBy("rule").agg(F.count("*").alias("violations"))


from . import catalog_services as _services  # noqa: E402, F401  adds its queries
