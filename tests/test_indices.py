"""Index collections: segments against builds anew, keys, failures, writers; and their semantic part."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import BM25Config, SemanticConfig
from tessera.functions.text import item_text
from tessera.operators.bm25 import BM25Index
from tessera.operators.tfidf import TfidfIndex
from tessera.plans import indices
from tessera.plans.indices import IndexConfig, IndexNotReady, IndexStore, refit_due
from tessera.plans.search import Snapshot
from tessera.storage import claim, shared_dir

WORDS = "[a-z0-9][a-z0-9]+"
BOTH = IndexConfig(normalise=False, pattern=WORDS)


def _rows(n=40, seed=1):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "ti", "su", "vo")]
    return {k: " ".join(r.choice(words, 7)) for k in range(n)}


def _write(spark, path, rows):
    spark.createDataFrame(sorted(rows.items()), "item_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def store(spark):
    return IndexStore(spark, shared_dir(spark, "indices"))


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "kara lora"), (2, ""), (3, "zulu misu misu")], "query_id long, query_text string")


def _hits(index, asked):
    return sorted(map(tuple, index.search(asked, 9, 6).collect()))


def _same_as_anew(generation, docs, asked):
    assert generation.n_items == docs.count() == generation.documents().count()
    anew = BM25Index.build(docs, normalise=False), TfidfIndex.build(docs, WORDS)
    for mine, other in zip((generation.bm25(), generation.tfidf()), anew, strict=True):
        assert _hits(mine, asked) == _hits(other, asked)
    assert sorted(map(tuple, generation.bm25().terms.collect())) == sorted(map(tuple, anew[0].terms.collect()))


def test_segments_follow_files_that_are_added_changed_and_removed(spark, tmp_path, store, asked, monkeypatch):
    path, rows = str(tmp_path / "docs"), _rows()
    first = store.open("docs", _write(spark, path, rows), BOTH)
    assert (first.number, len(first.manifest["segments"])) == (1, 1)
    assert store.open("docs", spark.read.parquet(path), BOTH).number == 1  # nothing changed
    assert store.open("docs", _write(spark, path, rows), BOTH).number == 2  # other files, the same rows
    rows |= {100: "zulu kara kara", 101: ""}
    rows[3] = "misu misu misu"
    del rows[5], rows[6]
    docs = _write(spark, path, rows)
    second = store.open("docs", docs, BOTH)
    assert len(second.manifest["segments"]) == 2 and second.manifest["segments"][1]["items"] == 3
    _same_as_anew(second, docs, asked)
    assert _hits(first.bm25(), asked) == _hits(BM25Index.build(spark.createDataFrame(sorted(_rows().items()), "item_id long, text string"), normalise=False), asked)  # readers keep theirs
    monkeypatch.setattr(indices, "MERGE", 2)
    rows |= {102: "zulu", 103: "lora lora misu", 104: "kara"}
    del rows[100]
    docs = _write(spark, path, rows)
    third = store.open("docs", docs, BOTH)
    assert len(third.manifest["segments"]) == 2  # the two small ones are one
    _same_as_anew(third, docs, asked)
    assert store.collection("docs", docs, BOTH).vacuum(1) > 0
    _same_as_anew(store.open("docs", spark.read.parquet(path), BOTH), docs, asked)
    docs = _write(spark, path, {k: t + " neti" for k, t in rows.items()})
    assert len(store.open("docs", docs, BOTH).manifest["segments"]) == 1  # nearly all of them differ
    _same_as_anew(store.open("docs", docs, BOTH), docs, asked)


def test_what_is_asked_for_names_the_collection(spark, tmp_path, store, asked):
    docs = _write(spark, str(tmp_path / "docs"), {1: "kara lora 7", 2: "kara", 3: "lora 9"})
    assert {r["item_id"] for r in store.bm25("docs", docs, normalise=False).search(asked).collect()} == {1, 2, 3}
    assert {r["item_id"] for r in store.bm25("docs", docs.filter("item_id = 3"), normalise=False).search(asked).collect()} == {3}
    assert {r["item_id"] for r in store.bm25("docs", docs.filter("item_id = 1"), normalise=False).search(asked).collect()} == {1}
    digits = spark.createDataFrame([(1, "9 7")], "query_id long, query_text string")
    assert {r["item_id"] for r in store.tfidf("docs", docs, "[0-9]+").search(digits, 5).collect()} == {1, 3}
    assert store.tfidf("docs", docs, "[a-z]+").search(digits, 5).isEmpty()
    items = docs.select("item_id", F.col("text").alias("title"), F.lit("").alias("description"), *(F.lit("mug").alias(c) for c in ("category", "subcategory", "brand")))
    items.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    plain = BM25Config()
    heavy = BM25Config(field_weights={**plain.field_weights, "title": 9})
    config = SemanticConfig(svd_components=2)
    one, two = (Snapshot.build(items, c, config, store).bm25 for c in (plain, heavy))
    for mine, c in ((one, plain), (two, heavy)):
        anew = BM25Index.build(items.select("item_id", item_text(c.field_weights).alias("text")))
        assert _hits(mine, asked) == _hits(anew, asked)
    assert _hits(one, asked) != _hits(two, asked)


def test_a_failed_build_leaves_the_last_generation_in_use(spark, tmp_path, store, asked):
    path = str(tmp_path / "docs")
    docs = _write(spark, path, _rows(9))
    index = store.collection("docs", docs, BOTH)
    with pytest.raises(IndexNotReady):
        index.generation()
    with pytest.raises(IndexNotReady):
        index.refresh(docs.limit(0))
    assert not index.status()["ready"] and "no items" in index.status()["error"]
    hits = _hits(index.ensured(docs).bm25(), asked)
    assert index.status()["error"] is None
    for bad in (docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), docs.limit(0), docs.drop("text")):
        assert index.refresh(bad).number == 1 and index.ensured(bad).number == 1
        s = index.status()
        assert s["ready"] and s["generation"] == 1 and s["items"] == 9 and s["error"]
        assert _hits(index.generation().bm25(), asked) == hits
    assert index.build(docs.filter("item_id > 1")).number == 2 and index.status()["error"] is None


def test_two_writers_make_two_generations(spark, tmp_path, store, asked):
    docs = _write(spark, str(tmp_path / "docs"), _rows(9))
    index, made, failed = store.collection("docs", docs, IndexConfig(normalise=False)), [], []

    def write():
        try:
            made.append(index.build(docs).number)
        except Exception as e:  # shown below
            failed.append(e)

    writers = [threading.Thread(target=write) for _ in range(3)]
    [w.start() for w in writers]
    [w.join(120) for w in writers]
    assert not failed and len(set(made)) == 3 and index.generation().number == max(made)
    assert _hits(index.generation().bm25(), asked) == _hits(BM25Index.build(docs, normalise=False), asked)
    path = f"{shared_dir(spark, 'claims')}/one"
    assert claim(spark, path) and not claim(spark, path)


def test_new_items_are_folded_into_the_fit_until_one_is_due(spark, tmp_path, store):
    path, rows, config = str(tmp_path / "docs"), _rows(40), IndexConfig(normalise=False, semantic=SemanticConfig(svd_components=8))
    first = store.open("docs", _write(spark, path, rows), config)
    rows |= {200: rows[7], 201: f"{rows[8]} kara"}
    del rows[9]
    second = store.open("docs", _write(spark, path, rows), config)
    assert second.number == 2 and second.manifest["semantic"]["components"] == first.manifest["semantic"]["components"]
    index = second.semantic()
    assert {r["item_id"] for r in index.vectors.collect()} == set(rows) and second.n_items == second.bm25().stats.first()["n"] == len(rows)
    hits = index.search(spark.createDataFrame([(1, rows[7])], "query_id long, query_text string"), 2).collect()
    assert {h["item_id"] for h in hits} == {7, 200} and all(abs(h["score"] - 1) < 1e-6 for h in hits)
    energy = {r["kind"]: r for r in second.energy().collect()}
    assert energy["folded"]["items"] == 2 and 0 < energy["fitted"]["kept"] <= energy["fitted"]["total"]
    rows |= {k: f"zqx{k} wvy{k} quux{k}" for k in range(300, 306)}  # what the fit knows nothing of
    third = store.open("docs", _write(spark, path, rows), config)
    assert third.manifest["semantic"]["components"] != first.manifest["semantic"]["components"]
    assert [e["kind"] for e in third.manifest["semantic"]["energy"]] == ["fitted"]
    assert refit_due({"items": 10, "total": 10.0, "kept": 8.0}, {"items": 2, "total": 10.0, "kept": 7.0}) and not refit_due({"items": 10, "total": 10.0, "kept": 8.0}, {"items": 2, "total": 10.0, "kept": 7.9})
    assert refit_due({"items": 10, "total": 1.0, "kept": 1.0}, {"items": 11, "total": 1.0, "kept": 1.0})


def test_postings_are_counted_where_their_text_is(spark):
    """One exchange, of texts, whose parts follow the bytes of text; shuffle partitions play no part."""
    from tessera.functions.text import tokenize
    from tessera.operators import bm25, tfidf

    docs = spark.createDataFrame([(k, f"red boat b{k % 7} red") for k in range(50)], "item_id long, text string")
    rows = bm25.term_counts(docs, tokenize(F.col("text"), True, False))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in rows.filter("item_id = 8").collect()} == {("red", 8, 4, 2), ("boat", 8, 4, 1), ("b1", 8, 4, 1)}
    assert tfidf.dealt(docs.withColumn("text", F.repeat(F.lit("x"), F.lit(tfidf.PART // 2)))).rdd.getNumPartitions() == 25


def test_queries_make_only_the_channels_that_they_read(spark, tmp_path, monkeypatch):
    """BM25 queries count no n-grams, and the services' word mode fits no decomposition."""
    from tessera.operators.semantic import SemanticIndex
    from tessera.plans import catalog, catalog_services

    def never(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(indices, "counts", never)
    monkeypatch.setattr(SemanticIndex, "fit", never)
    d = "/root/testdata/sf0.001"
    assert catalog._index(spark, d).stats.first()["n"] > 0
    found = catalog_services._snapshot(spark, d)
    assert found.semantic is None and found.n_items > 0
    with pytest.raises(ValueError):
        catalog_services.S.fused(found, None, "linear", 10, 10)


def test_word_features_are_counted_in_blocks_and_never_kept(spark, tmp_path, store, monkeypatch):
    """Weights and scores over many blocks and parts against brute force, with an id that repeats, empty and null texts; tables have no row a feature."""
    import math
    import re
    from collections import Counter

    from tessera.operators import tfidf

    monkeypatch.setattr(tfidf, "BLOCK", 25)
    monkeypatch.setattr(tfidf, "RANGE", 60)
    rows = [(k, f"Red boat b{k % 7} red boat b{k % 5} o{k}") for k in range(60)] + [(7, "boat red zulu"), (7, "red"), (100, ""), (101, None), (102, "x y")]
    docs = spark.createDataFrame(rows, "item_id long, text string")
    tf = {}
    for k, text in rows:
        w = re.findall(WORDS, (text or "").lower())
        tf.setdefault(k, Counter()).update([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    df = Counter(f for c in tf.values() for f in c)
    weights = {(k, f): (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[f])) + 1) for k, c in tf.items() for f, n in c.items()}
    found = {(r["item_id"], r["feature"]): r["weight"] for r in tfidf.word_weights(docs, WORDS).collect()}
    assert found.keys() == weights.keys() and all(abs(found[x] - w) < 1e-9 for x, w in weights.items())
    index = TfidfIndex.build(docs, WORDS)
    assert index.blocks.count() > 5 and tfidf.frequencies(index.blocks).select("part").distinct().count() > 3
    length = {k: math.sqrt(sum(w * w for (i, _), w in weights.items() if i == k)) for k in tf}
    got = {r["item_id"]: r["length"] for r in index.lengths.collect()}
    assert got.keys() == {k for k, x in length.items() if x} and all(abs(x - length[k]) < 1e-9 for k, x in got.items())
    hits = index.search(spark.createDataFrame([(1, "zulu boat")], "query_id long, query_text string"), 1).first()
    q = {f: math.log((1 + len(rows)) / (1 + df[f])) + 1 for f in ("zulu", "boat")}
    assert hits["item_id"] == 7 and abs(hits["score"] - sum(w * weights[7, f] for f, w in q.items()) / length[7] / math.sqrt(sum(w * w for w in q.values()))) < 1e-9
    path = str(tmp_path / "docs")
    docs.filter("item_id < 50").write.parquet(path)
    kept = store.open("docs", spark.read.parquet(path), IndexConfig(bm25=False, pattern=WORDS))
    assert set(kept.manifest["segments"][0]["tables"]) == {"documents", "words"} and "lengths" not in kept.manifest
    assert kept.table(kept.manifest["segments"][0]["tables"]["words"]).count() < 50


def test_segments_of_terms_make_no_word_features(spark, monkeypatch):
    """index_segments_terms reads BM25's frequencies alone, so its generations hold no words for TF-IDF."""
    from tessera.plans import catalog_services

    def never(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(indices, "counts", never)
    assert catalog_services.index_segments_terms(spark, "/root/testdata/sf0.001").filter("df > 0").count() > 0


def test_terms_of_a_segment_are_counted_in_their_rows(spark, monkeypatch):
    """No text moves where ids are a key; rows of one id are counted as before."""
    from tessera.functions.text import tokenize
    from tessera.operators import bm25

    rows = [(k, f"red boat b{k % 7} red" + " zulu" * (k % 3)) for k in range(50)] + [(60, ""), (61, None), (62, "one")]
    docs, tokens = spark.createDataFrame(rows, "item_id long, text string"), tokenize(F.col("text"), True, False)
    got = bm25.term_rows(docs, tokens)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(got) == shown(bm25.term_counts(docs, tokens)) and got.schema.simpleString() == bm25.term_counts(docs, tokens).schema.simpleString()
    twice = docs.union(docs)
    assert shown(bm25.term_rows(twice, tokens)) == shown(bm25.term_counts(twice, tokens))


def test_steps_of_a_grown_store_write_what_changed(spark, monkeypatch):
    """index_segments_topk: files that stay are not written again, and the documents are all there at the end."""
    from tessera.plans import catalog_services, views

    seen, folder = [], []
    first = catalog_services.shared_dir
    monkeypatch.setattr(catalog_services, "shared_dir", lambda s, n: (folder.append(first(s, n)) or folder[-1]) if n == "source" else first(s, n))
    opened = indices.IndexStore.open

    def watched(self, name, docs, config):
        seen.append({f.rsplit("/", 2)[1]: f for f in docs.inputFiles()})
        return opened(self, name, docs, config)

    monkeypatch.setattr(indices.IndexStore, "open", watched)
    g = catalog_services._grown(spark, "/root/testdata/sf0.001", catalog_services.BM25_ONLY)
    assert [set(x) for x in seen] == [{"first", "altered", "strangers"}, {"first", "third"}, {"first", "third", "late"}]
    assert len({x["first"] for x in seen}) == 1
    assert g.n_items == views.docs(spark, "/root/testdata/sf0.001").count()
