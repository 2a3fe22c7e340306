"""Vector search, the decomposition, JDBC and request checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import SemanticConfig
from tessera.operators import events, semantic, vectors
from tessera.plans.indices import IndexStore
from tessera.sources import readers
from tessera.storage import discard, read_text, shared_dir, stored, write_text


def _docs(spark, n=60, seed=1):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "ti", "su", "vo")]
    return [(k, " ".join(r.choice(words[k % 4 * 4 : k % 4 * 4 + 6], 7))) for k in range(n)]


def test_lsa_from_the_store_is_that_of_memory(spark, tmp_path):
    path, config = str(tmp_path / "docs"), SemanticConfig(svd_components=6)
    rows = _docs(spark)
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    asked = spark.createDataFrame([(k, rows[k][1]) for k in (0, 7, 21)], "query_id long, query_text string")
    a = IndexStore(spark, shared_dir(spark, "indices")).semantic("docs", docs, config).search(asked, 4)
    b = semantic.SemanticIndex.build(docs, config).search(asked, 4)
    keep = lambda df: {(r["query_id"], r["rank"], round(r["score"], 6)) for r in df.collect()}
    assert keep(a) == keep(b)


def _matrix(spark, docs, index, config):
    x = semantic.SemanticIndex._features(docs, index.vocabularies, config).withColumn("fid", F.xxhash64("feature")).toPandas()
    return x.pivot(index="item_id", columns="fid", values="weight").fillna(0).sort_index()


def test_lsa_against_a_full_decomposition(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 200)  # several blocks of items
    config = SemanticConfig(svd_components=4, char_weight=0.0)  # as many as the words have groups: the gap after them is clear
    docs = spark.createDataFrame(_docs(spark), "item_id long, text string")
    index = semantic.SemanticIndex.build(docs, config)
    x = _matrix(spark, docs, index, config)
    u, s, v = np.linalg.svd(x.to_numpy(), full_matrices=False)
    rows = {r["fid"]: r["vector"] for r in index.components.collect()}
    mine = np.array([rows[f] for f in x.columns])
    assert np.abs(mine.T @ mine - np.eye(4)).max() < 1e-9
    cosines = np.linalg.svd(mine.T @ v[:4].T, compute_uv=False)
    assert np.arccos(np.clip(cosines, -1, 1)).max() < 1e-3
    want = u[:, :4] * s[:4]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r["vector"] for r in index.vectors.orderBy("item_id").collect()])
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3  # whatever the vectors' signs and rotation


def test_lsa_rows_come_from_the_features_alone():
    fid = np.array([5, -7, 5], np.int64)
    rows = semantic.test_rows(fid, 6, 42)
    assert (rows[0] == rows[2]).all() and (rows[0] != rows[1]).all() and np.abs(rows).max() <= 1
    many = semantic.test_rows(np.arange(20000), 3, 1)
    assert np.abs(many.mean(0)).max() < 0.02 and np.abs(np.corrcoef(many.T) - np.eye(3)).max() < 0.03


@pytest.mark.parametrize(("near", "shard", "block"), [(64, 8192, 2048), (4, 16, 3)])
def test_vector_search_against_all_pairs(spark, monkeypatch, near, shard, block):
    for name, value in (("NEAR", near), ("SHARD", shard), ("BLOCK", block)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(3)
    items = [(f"i{k:03d}", [float(x) for x in r.integers(-2, 3, 5)]) for k in range(150)] + [("short", [1.0]), ("none", None), ("nan", [float("nan")] * 5), ("hole", [1.0, None, 0.0, 0.0, 0.0])]
    asked = [(k, [float(x) for x in r.integers(-2, 3, 5)]) for k in range(20)]
    rows = spark.createDataFrame(items, "item_id string, vector array<double>").repartition(3)
    found = vectors.vector_search(spark.createDataFrame(asked, "query_id long, q array<double>"), rows, 7, 6)
    got = {(x["query_id"], x["rank"]): (x["item_id"], x["score"]) for x in found.collect()}
    for q, v in asked:
        want = sorted((-float(np.dot(v, w)), i) for i, w in items[:150])[:7]
        assert [got.pop((q, k + 1)) for k in range(7)] == [(i, -s) for s, i in want]
    assert not got
    few = vectors.vector_search(spark.createDataFrame(asked[:1], "query_id long, q array<double>"), rows.limit(3), 7)
    assert few.count() == 3
    assert vectors.vector_search(spark.createDataFrame([], "query_id long, q array<double>"), rows, 7).isEmpty()
    assert vectors.vector_search(spark.createDataFrame(asked, "query_id long, q array<double>"), rows.limit(0), 7).isEmpty()


def test_vector_search_leaves_far_shards_shut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "NEAR", 4)
    r = np.random.default_rng(5)
    centres = np.eye(8) * 10
    items = [(k, (centres[k % 8] + r.normal(0, 0.1, 8)).tolist()) for k in range(400)]
    rows = spark.createDataFrame(items, "item_id long, vector array<double>")
    asked = spark.createDataFrame([(k, centres[k].tolist()) for k in range(8)], "query_id long, q array<double>")
    index = vectors.PivotIndex.build(rows, 8)
    found, opened = index.rounds(asked, 5)
    assert opened.count() < 0.5 * 8 * len(index.pivots)
    best = {}
    for q, i, s in sorted(map(tuple, found.collect()), key=lambda x: (x[0], -x[2], x[1])):
        best.setdefault(q, []).append(i)
    for q in range(8):
        want = sorted((-float(np.dot(centres[q], w)), i) for i, w in items)[:5]
        assert best[q][:5] == [i for _, i in want]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id long, name string, score double")
    try:
        readers.write_jdbc(rows, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception as e:  # the driver is no part of every Spark distribution
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no JDBC driver at hand")
        raise
    back = readers.read_jdbc(spark, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 0.5), (2, None, 1.5)]


def test_small_files_and_stored_tables(spark):
    path = f"{shared_dir(spark, 'note')}.txt"
    assert read_text(spark, path) is None
    for text in ("first", "séçond\n"):
        write_text(spark, path, text)
        assert read_text(spark, path) == text
    held = stored(spark.range(5), "five")
    assert held.count() == 5
    discard(held)
    with pytest.raises(Exception):
        spark.read.parquet(held.stored_at).count()


def test_event_requests(spark):
    rows = [("e1", "click", 1, None), ("", "click", 1, None), ("e3", "jump", 1, None), ("e4", "click", 0, None), ("e5", "click", None, float("nan")), ("x" * 65, "click", 1, 0.0), (None, "click", 1, 0.0)]
    new = spark.createDataFrame(rows, "event_id string, event_type string, position int, purchase_amount double")
    assert [r[0] for r in new.select(events.refusal(new.columns)).collect()] == [None, "event_id", "event_type", "position", "purchase_amount", "event_id", "event_id"]
    more = new.withColumn("client_event_id", F.lit(None).cast("string")).withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))
    fresh, answers = events.capture(more.limit(0), more, checked=True)
    assert [r["event_id"] for r in fresh.collect()] == ["e1"] and answers.count() == 1
    assert events.time_range(None, "") == (None, None)
    with pytest.raises(ValueError, match="invalid_time_range"):
        events.time_range("2026-01-02", "2026-01-01")


def test_lsa_of_repeated_texts_is_worked_once_a_text(spark, monkeypatch):
    """20 copies of each text: rows, vocabulary and components are those of all items, the work that of the different texts."""
    seen, plain = [], semantic.in_blocks
    monkeypatch.setattr(semantic, "in_blocks", lambda x, blocks: seen.append(x.select("item_id").distinct().count()) or plain(x, blocks))
    rows, config = [(k * 100 + c, t) for k, t in _docs(spark) for c in range(20)], SemanticConfig(svd_components=4, char_weight=0.0, min_df=2)
    docs = spark.createDataFrame(rows, "item_id long, text string")
    index = semantic.SemanticIndex.fit(docs, config)
    different = len({t for _, t in rows})
    assert seen == [different] and different <= len(rows) / 20
    x = _matrix(spark, docs, index, config)
    assert len(x) == len(rows)
    v = np.linalg.svd(x.to_numpy(), full_matrices=False)[2]
    mine = {r["fid"]: r["vector"] for r in index.components.collect()}
    cosines = np.linalg.svd(np.array([mine[f] for f in x.columns]).T @ v[:4].T, compute_uv=False)
    assert np.arccos(np.clip(cosines, -1, 1)).max() < 1e-3


def test_lsa_search_over_shared_vectors_is_that_over_all(spark):
    config = SemanticConfig(svd_components=6)
    rows = [(k + 1000 * c, t) for k, t in _docs(spark) for c in range(1 + k % 5)]
    docs = spark.createDataFrame(rows, "item_id long, text string")
    asked = spark.createDataFrame([(k, t) for k, t in rows[:6]], "query_id long, query_text string")
    index = IndexStore(spark, shared_dir(spark, "indices")).semantic("docs", docs, config)
    assert index.shared.count() == len({t for _, t in rows}) < len(rows) == index.vectors.count()
    few = index.search(asked, 7, 6).collect()
    index.shared = None
    assert sorted(few) == sorted(index.search(asked, 7, 6).collect())


def test_vector_search_joins_homes_with_few_queries(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert vectors.joined(np.array([3, 0, 4, 3, 1, 25, 2])).tolist() == [0, 0, 0, 0, 4, 5, 6]
    assert vectors.joined(np.zeros(0, int)).tolist() == []


def test_the_evaluation_service_fuses_both_channels(spark, monkeypatch):
    """evaluation_service: its hits come out of the linear fusion of both channels, 100 candidates of each; no channel stands alone."""
    from tessera.plans import catalog, catalog_services  # noqa: F401
    from tessera.plans import search as S

    seen, fuse = [], S.fuse_linear
    monkeypatch.setattr(S, "fuse_linear", lambda both, *rest: (seen.append((both.columns, rest)), fuse(both, *rest))[1])
    catalog.QUERIES["evaluation_service"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and {"bm25_score", "semantic_score"} <= set(seen[0][0]) and seen[0][1][:3] == (0.5, 0.5, 100)
    assert "fusion_score" not in catalog.SQL["evaluation_flat"] and "fusion_score" in catalog.SQL["evaluation_service"]
