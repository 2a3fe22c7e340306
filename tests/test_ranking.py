import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.config import BM25Config, FusionConfig, PersonalizationConfig, SemanticConfig
from tessera.functions.text import STOP_WORDS
from tessera.operators import events, fusion, metrics, profiles
from tessera.operators.bm25 import BM25Index
from tessera.operators.rerank import rerank
from tessera.operators.semantic import SemanticIndex
from tessera.plans import search as S

TEAS = [("t1", "green tea leaves from kyoto"), ("t2", "black tea with bergamot, black tin"), ("t3", "oolong, half green half black"), ("t4", "porcelain pot"), ("t5", "tin scoop for tea, tea, tea"), ("t6", "")]


def _plain_bm25(rows, query, k1=1.5, b=0.75):
    cut = {i: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOP_WORDS] for i, t in rows}
    mean, out = sum(map(len, cut.values())) / len(cut), {}
    for term in [w for w in re.findall("[a-z0-9]+", query.lower()) if w not in STOP_WORDS]:
        df = sum(term in ws for ws in cut.values())
        for i, ws in cut.items():
            if tf := ws.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def _docs(spark, rows=TEAS):
    return spark.createDataFrame(rows, "item_id string, text string")


def _queries(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, query_text string")


def test_bm25_order_and_scores(spark):
    index, asked = BM25Index.build(_docs(spark)), ["green tea", "", "with the of", "tea tea black tin", "Kyoto"]
    hits = index.search(_queries(spark, *asked), 4).collect()
    for k, text in enumerate(asked):
        want = _plain_bm25(TEAS, text)[:4]
        got = sorted((h["rank"], h["item_id"], h["score"]) for h in hits if h["query_id"] == f"q{k}")
        assert [g[1] for g in got] == [i for i, _ in want] and [g[0] for g in got] == list(range(1, len(want) + 1))
        assert all(abs(g[2] - s) < 1e-9 for g, (_, s) in zip(got, want, strict=True))
    assert index.stats.first()["n"] == 6 and index.terms.filter("term = 'tea'").first()["df"] == 3


def test_bm25_refuses_bad_settings(spark):
    for bad in ({"k1": 0}, {"b": 1.5}, {"b": -0.1}):
        with pytest.raises(ValueError):
            BM25Index.build(_docs(spark), **bad)
    with pytest.raises(ValueError):
        BM25Index.build(_docs(spark)).search(_queries(spark, "x"), 0)


def test_semantic_invariants(spark):
    rows = [(f"item_{k}", t) for k, t in enumerate(["river boat", "old river barge", "paper boat race", "canvas sail", "river boat cover", "steam barge engine", "race car", "rope"])]
    index = SemanticIndex.build(_docs(spark, rows), SemanticConfig(svd_components=4))
    hits = index.search(_queries(spark, "river boat", "zzzz"), 5).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2, 3, 4, 5] and hits[0]["item_id"] == "item_0"
    scores = [h["score"] for h in hits]
    assert scores == sorted(scores, reverse=True) and all(-1.000001 <= s <= 1.000001 for s in scores)
    with pytest.raises(ValueError):
        SemanticIndex.build(_docs(spark, rows).limit(0))


def _channels(spark):
    schema = "query_id string, item_id string, score double, rank long"
    return spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 2), ("q", "c", 1.0, 3)], schema), spark.createDataFrame([("q", "b", 5.0, 1), ("q", "d", 4.0, 2), ("q", "a", 3.0, 3)], schema)


def test_fusion(spark):
    both = fusion.candidates(*_channels(spark))
    rrf = fusion.fuse_rrf(both).orderBy("rank").collect()
    assert [(r["item_id"], round(r["fusion_score"], 6)) for r in rrf] == [("b", 0.032522), ("a", 0.032266), ("d", 0.016129), ("c", 0.015873)]
    lin = fusion.fuse_linear(both).orderBy("rank").collect()
    assert [(r["item_id"], r["fusion_score"]) for r in lin] == [("b", 0.75), ("a", 0.5), ("d", 0.25), ("c", 0.0)]
    sources = {r["item_id"]: r["sources"] for r in both.collect()}
    assert sources["a"] == ["bm25", "semantic"] and sources["d"] == ["semantic"]
    assert [r["semantic_norm"] for r in lin if r["item_id"] == "c"] == [None]


def _world(spark):
    items = spark.createDataFrame([("p1", "Garden", "Spades", "Fern", 40.0), ("p2", "Garden", "Hoses", "Brook", 90.0), ("p3", "Kitchen", "Pans", "Fern", 25.0), ("p4", "Kitchen", None, "", 0.0)], "item_id string, category string, subcategory string, brand string, price double")
    users = spark.createDataFrame([("ann", False), ("bo", True), ("cy", False)], "user_id string, is_cold_start boolean")
    rows = [("e1", "ann", "favorite", "p1", datetime(2025, 6, 1), "m"), ("e2", "ann", "add_to_cart", "p2", datetime(2025, 6, 21), "m"), ("e3", "ann", "click", "p4", datetime(2025, 7, 1), "n"), ("e4", "bo", "impression", "p3", datetime(2025, 7, 1), "o"), ("e5", "dee", "click", "gone", datetime(2025, 6, 11), "q")]
    return items, users, spark.createDataFrame(rows, "event_id string, user_id string, event_type string, item_id string, timestamp timestamp, session_id string")


def test_profiles(spark):
    items, users, log = _world(spark)
    affinity, summary = profiles.build_profiles(log, items, users, half_life=20)
    state = {r["user_id"]: (r["profile_status"], r["train_event_count"], r["positive_event_count"], r["train_session_count"]) for r in summary.collect()}
    assert state == {"ann": ("warm", 3, 3, 2), "bo": ("cold_start", 1, 0, 1), "cy": ("no_history", 0, 0, 0), "dee": ("no_positive", 1, 0, 1)}
    w = PersonalizationConfig().event_weights
    spade, hose, other = w["favorite"] * 0.5**1.5, w["add_to_cart"] * 0.5**0.5, w["click"]  # 30, 10 and 0 days before the latest event
    got = {(r["dim"], r["key"]): r["weight"] for r in affinity.filter("user_id = 'ann'").collect()}
    want = {("brand", "Fern"): spade / (spade + hose), ("brand", "Brook"): hose / (spade + hose), ("subcategory", "Spades"): spade / (spade + hose), ("subcategory", "Hoses"): hose / (spade + hose), ("category", "Garden"): (spade + hose) / (spade + hose + other), ("category", "Kitchen"): other / (spade + hose + other)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    mean = (spade * math.log(40) + hose * math.log(90)) / (spade + hose)
    assert abs(summary.filter("user_id = 'ann'").first()["mean_log_price"] - mean) < 1e-12


def test_refresh_blends_only_the_wanted(spark):
    items, users, log = _world(spark)
    current = profiles.build_profiles(log, items, users, half_life=0)
    affinity, summary = profiles.refresh(users, users.filter("user_id = 'ann'"), log, items, current)
    got = {r["user_id"]: (r["source"], r["positive_event_count"]) for r in summary.collect()}
    assert got["ann"] == ("combined", 6) and got["cy"][0] == "base"
    assert affinity.filter("dim = 'subcategory'").isEmpty()


def test_rerank_warm_and_fallback(spark):
    items, _, _ = _world(spark)
    hits = spark.createDataFrame([("q", u, i, r, s) for u in ("warm", "idle", "new") for i, r, s in (("p1", 1, 3.0), ("p3", 2, 2.5), ("p2", 3, 1.0), ("lost", 4, 0.5))], "query_id string, user_id string, item_id string, rank long, fusion_score double")
    shares = {"category": {"Garden": 0.25, "Kitchen": 0.75}, "subcategory": {"Pans": 1.0}, "brand": {"Brook": 0.6, "Fern": 0.4}}
    affinity = spark.createDataFrame([("warm", d, k, v) for d, s in shares.items() for k, v in s.items()], "user_id string, dim string, key string, weight double")
    summary = spark.createDataFrame([("warm", "warm", False, 3.2), ("idle", "no_positive", False, None)], "user_id string, profile_status string, is_cold_start boolean, mean_log_price double")
    out = rerank(hits, (affinity, summary), items).orderBy("user_id", "rank").collect()
    wr, wc, ws, wb, wp = PersonalizationConfig().weights
    near = lambda price: math.exp(-abs(math.log(price) - 3.2) / 0.5)
    want = {"p1": wr + 0.25 * wc + 0.4 * wb + wp * near(40), "p3": 0.8 * wr + 0.75 * wc + ws + 0.4 * wb + wp * near(25), "p2": 0.2 * wr + 0.25 * wc + 0.6 * wb + wp * near(90), "lost": 0.0}
    warm = [(r["item_id"], r["personalized_score"]) for r in out if r["user_id"] == "warm"]
    assert [i for i, _ in warm] == sorted(want, key=lambda i: -want[i]) and all(abs(s - want[i]) < 1e-12 for i, s in warm)
    assert [r["item_id"] for r in out if r["user_id"] == "idle"] == ["p1", "p3", "p2", "lost"]
    assert {r["user_id"]: r["fallback_reason"] for r in out} == {"warm": "none", "idle": "no_profile", "new": "unknown_user"}


def test_metrics(spark):
    results = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "x", 3)], "query_id string, item_id string, rank long")
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 2)], "query_id string, item_id string, grade int")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    got = {r["query_id"]: r for r in metrics.evaluate(results, qrels, asked, [3]).collect()}
    assert [round(got["q"][m], 6) for m in ("precision", "recall", "mrr", "ndcg")] == [0.666667, 0.666667, 1, 0.576667]
    assert [got["none"][m] for m in ("precision", "recall", "mrr", "ndcg")] == [0, 0, 0, 0]
    assert round(metrics.macro_average(metrics.evaluate(results, qrels, asked, [3])).first()["precision"], 6) == round(1 / 3, 6)
    with pytest.raises(ValueError):
        metrics.check_ks([0])


def test_coverage_keeps_unknown_requests_in_the_denominator(spark):
    eligible = spark.createDataFrame([("r1",), ("gone",)], "request_id string")
    requests = spark.createDataFrame([("r1", "q1", "warm")], "request_id string, query_id string, profile_status string")
    positives = spark.createDataFrame([("r1", "a", 1), ("r1", "z", 0)], "request_id string, item_id string, grade int")
    found = spark.createDataFrame([("q1", "a"), ("q1", "b")], "query_id string, item_id string")
    row = metrics.coverage(eligible, requests, positives, found).first()
    assert (row["eligible_positive_request_count"], row["covered_positive_request_count"], row["uncovered_positive_request_count"]) == (2, 1, 0)
    assert row["request_level_candidate_positive_coverage"] == 0.5 and row["warm_request_coverage"] == 1.0


def test_funnel_and_capture(spark):
    kinds = ["impression"] * 2 + ["click"] * 2 + ["favorite", "add_to_cart", "purchase"]
    rows = [(f"e{k}", "c1" if k in (0, 1) else None, t, "u", " ", datetime(2026, 1, 1 + k)) for k, t in enumerate(kinds)]
    log = spark.createDataFrame(rows, "event_id string, client_event_id string, event_type string, user_id string, query_text string, timestamp timestamp")
    row = events.funnel(log).first()
    assert (row["total_events"], row["ctr"], row["favorite_rate"]) == (7, 1.0, 0.5)
    assert events.funnel(log.limit(0)).first()["ctr"] == 0.0
    assert events.matching(log, end=datetime(2026, 1, 1)).count() == 1
    fresh, answers = events.capture(log.limit(0), log)
    assert fresh.count() == 6 and fresh.filter("query_text IS NOT NULL").isEmpty()
    assert {r["event_id"]: r["answered_by"] for r in answers.collect()}["e1"] == "e0"
    again, _ = events.capture(fresh, log.filter("client_event_id = 'c1'"))
    assert again.isEmpty()


def test_configs():
    assert math.isclose(sum(PersonalizationConfig().weights), 1)
    assert BM25Config.from_dict({"k1": 1.2, "unknown": 1}).k1 == 1.2
    for bad in (lambda: BM25Config.from_dict({"k1": 0}), lambda: FusionConfig.from_dict({"candidate_k": 5}), lambda: SemanticConfig.from_dict({"max_df": 0}), lambda: PersonalizationConfig.from_dict({"half_life_days": 0})):
        with pytest.raises(ValueError):
            bad()


def test_search_plan(spark):
    items, users, log = _world(spark)
    items = items.withColumn("title", F.concat_ws(" ", "brand", "subcategory")).withColumn("description", F.lit(""))
    snapshot = S.Snapshot.build(items)
    asked = spark.createDataFrame([("q1", "brook hoses", "ann"), ("q2", "  ", "bo")], "query_id string, query_text string, user_id string")
    for mode in S.MODES:
        hits = S.search(snapshot, asked, mode, 2).orderBy("rank").collect()
        assert "p2" in {h["item_id"] for h in hits} and {h["query_id"] for h in hits} == {"q1"}
        assert mode != "bm25" or hits[0]["item_id"] == "p2"
    mine = S.search(snapshot, asked, "linear", 2, profiles.build_profiles(log, items, users), True).collect()
    assert {h["applied"] for h in mine} == {True}
    assert {h["fallback_reason"] for h in S.search(snapshot, asked, "linear", 2, None, True).collect()} == {"profiles_not_ready"}
    with pytest.raises(ValueError):
        S.search(snapshot, asked, "other", 2)
    with pytest.raises(ValueError):
        S.search(snapshot, asked, "bm25", 101)
