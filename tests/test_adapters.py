"""Searches, profiles and evaluations from imported sets; limits of requests."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.profiles import build_profiles
from tessera.plans import requests as R
from tessera.plans.adapters import Inputs
from tessera.plans.search import evaluate_queries
from tessera.schema import TABLES
from tessera.sources.importer import Store, import_dataset

DAY = "2026-03-0{}T10:00:00"
HEADS = {name: ",".join(f.name for f in schema.fields) for name, schema in TABLES.items()}
ITEMS = [f'k{i},{word} {thing},,{"tea" if i % 2 else "cup"},s{i % 3},b{i % 2},{i + 1}.00,0.5,0.5,false,{DAY.format(1)}' for i, (word, thing) in enumerate([("green", "kettle"), ("white", "leaf"), ("green", "mug"), ("black", "leaf"), ("blue", "bowl")])]
USERS = [f'p{i},[],[],,low,{"true" if i == 2 else "false"},{DAY.format(1)}' for i in range(3)]
QUERIES = [f"a{i},{text},,,{DAY.format(1)}" for i, text in enumerate(["green", "black leaf"])]
EVENTS = [f"v{i},{kind},r,s{i},p{i % 2},a0,,k{i % 5},1,{DAY.format(1 + i)},,," for i, kind in enumerate(["click", "purchase", "favorite", "impression", "click", "click"])]
QRELS = ["a0,k0,3", "a0,k2,1", "a1,k3,2"]


def _folder(path, items=ITEMS):
    path.mkdir(exist_ok=True)
    for name, rows in {"items": items, "users": USERS, "queries": QUERIES, "events": EVENTS, "qrels": QRELS}.items():
        (path / f"{name}.csv").write_text("\n".join([HEADS[name], *rows]) + "\n")
    return str(path)


def test_an_imported_set_is_searched_and_evaluated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        Inputs.of(store)
    assert import_dataset(store, _folder(tmp_path / "in")).status == "completed"
    held = Inputs.of(store)
    renamed = [row.replace("green mug", "red mug") for row in ITEMS]
    assert import_dataset(store, _folder(tmp_path / "in", renamed), replace=True).status == "completed"
    later = Inputs.of(store)
    title = lambda i: {r["title"] for r in i.items.collect()}
    assert title(held) - title(later) == {"green mug"} and title(later) - title(held) == {"red mug"}
    assert {r["item_id"]: r["text"].split()[0] for r in later.documents().collect()} == {f"k{i}": w for i, w in enumerate(["green", "white", "red", "black", "blue"])}

    old, new = held.snapshot(), later.snapshot()
    asked = spark.createDataFrame([("a0", None, "p0"), ("new", "black", "p1"), ("none", None, "p0")], "query_id string, query_text string, user_id string")
    found = lambda i, s: {(r["query_id"], r["item_id"]) for r in i.search(s, asked, "bm25").collect()}
    assert found(held, old) == {("a0", "k0"), ("a0", "k2"), ("new", "k3")}
    assert found(later, new) == {("a0", "k0"), ("new", "k3")}

    mine = held.profiles(half_life=0)
    direct = build_profiles(held.events, held.items, held.users, half_life=0)
    assert [sorted(map(str, p.collect())) for p in mine] == [sorted(map(str, p.collect())) for p in direct]
    assert {r["user_id"]: r["profile_status"] for r in mine[1].collect()} == {"p0": "warm", "p1": "warm", "p2": "cold_start"}
    hits = held.search(old, asked.limit(1), top_k=3, profiles=mine).collect()
    assert {r["source"] for r in hits} == {"personalized"} and "k0" in {r["item_id"] for r in hits}

    for ids in (None, spark.createDataFrame([("a1",)], "query_id string")):
        got, _ = held.evaluate(old, ids, mode="bm25")
        want, _ = evaluate_queries(old, held.queries.select("query_id") if ids is None else ids, held.queries, held.qrels, mode="bm25")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def _named(spark, rows, schema, refusal):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(refusal).collect()]


def test_requests_name_the_first_rule_they_break(spark):
    searches = [("linear", 1, True, "u"), ("linear", 100, False, None), ("other", 0, True, None), (None, 1, False, None), ("rrf", 101, True, None), ("rrf", None, False, None), ("bm25", 5, True, " "), ("bm25", 5, None, "u")]
    assert _named(spark, searches, "m string, k int, p boolean, u string", R.search_refusal(*map(F.col, "mkpu"))) == [None, None, "mode", "mode", "top_k", "top_k", "user_id", None]
    lists = [([1],), ([100] * 10,), ([],), (None,), ([1] * 11,), ([0],), ([5, 101],), ([5, None],)]
    assert _named(spark, lists, "ks array<int>", R.ks_refusal(F.col("ks"))) == [None, None, "ks", "ks", "ks", "k", "k", "k"]
    one = [("q" * 64, "t" * 512)]
    asked = [(one * 100, [5]), ([("", None)], [5]), (one * 101, [0]), ([], [5]), (None, [5]), (one + [("é" * 65, "")], [5]), ([(None, "")], [5]), ([("q", "t" * 513)], [5]), (one, [])]
    got = _named(spark, asked, "q array<struct<query_id:string,query_text:string>>, ks array<int>", R.evaluation_refusal(F.col("q"), F.col("ks")))
    assert got == [None, None, "queries", "queries", "queries", "query_id", "query_id", "query_text", "ks"]
    row = ("r" * 64, "q" * 64, ["i"] * 200)
    covers = [([row] * 500,), ([],), ([("r", None, None)],), ([row] * 501,), (None,), ([("r" * 65, "", [])],), ([(None, "", [])],), ([("r", "q" * 65, [])],), ([row, ("r", "", ["i"] * 201)],), ([("r", "", [None])],)]
    got = _named(spark, covers, "c array<struct<request_id:string,query_id:string,candidate_item_ids:array<string>>>", R.coverage_refusal(F.col("c")))
    assert got == [None, None, None, "requests", "requests", "request_id", "request_id", "query_id", "candidate_item_ids", "candidate_item_ids"]
