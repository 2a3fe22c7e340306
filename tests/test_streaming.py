import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import profiles
from tessera.operators.decayed import merged, observed, profiles_of
from tessera.storage import shared_dir
from tessera.streaming import stores
from tessera.streaming.events import captured, deduplicated, keep_profiles, windowed_counts
from tessera.streaming.stores import EventLog, ProfileStore

SCHEMA = "event_id string, client_event_id string, event_type string, user_id string, timestamp timestamp"


def test_stream_deduplicates_and_counts(spark, tmp_path):
    rows = [("e1", "c", "click", "u", datetime(2026, 1, 1, 0, 1)), ("e2", "c", "click", "u", datetime(2026, 1, 1, 0, 2)), ("e3", None, "click", "u", datetime(2026, 1, 1, 0, 3)), ("e4", None, "purchase", "u", datetime(2026, 1, 1, 2))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, df, mode in (("dedup", deduplicated(stream), "append"), ("windows", windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("dedup").filter("client_event_id = 'c'").count() == 1 and spark.table("dedup").count() == 3
    assert {(r["event_type"], r["count"]) for r in spark.table("windows").collect()} == {("click", 3), ("purchase", 1)}


LOG = "event_id string, client_event_id string, event_type string, user_id string, query_text string, timestamp timestamp"


def _event(k, client, day, kind="click"):
    return (f"e{k}", client, kind, f"u{k % 3}", " ", datetime(2026, 1, 1) + timedelta(days=day))


def _events(log):
    return sorted(r["event_id"] for r in log.events().collect())


def test_a_batch_that_is_replayed_adds_nothing(spark, monkeypatch):
    log = EventLog(spark, shared_dir(spark, "log"))
    first = spark.createDataFrame([_event(1, "a", 0), _event(2, "a", 1), _event(3, None, 2), _event(4, "b", 3), _event(5, "c", 4, "jump")], LOG)
    assert log.events() is None

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(log, "_commit", dies)
        with pytest.raises(RuntimeError):
            log.append(first, 0)
    assert log.manifest()["batch"] == -1 and log.events() is None  # nothing of it is seen
    for _ in range(2):
        log.append(first, 0)
        assert _events(log) == ["e1", "e3", "e4"]
    late = spark.createDataFrame([_event(10, "a", 400), _event(11, "b", -50), _event(12, "d", 5)], LOG)  # long after, and long before
    log.append(late, 1)
    log.append(late, 1)
    assert _events(log) == ["e1", "e12", "e3", "e4"]
    answers = {r["event_id"]: r["answered_by"] for r in log.answers().collect()}
    assert answers == {"e1": "e1", "e2": "e1", "e3": "e3", "e4": "e4", "e10": "e1", "e11": "e4", "e12": "e12"}
    assert log.events().filter("query_text IS NOT NULL").isEmpty()


def test_ids_stay_known_when_their_tables_are_made_one(spark, monkeypatch):
    monkeypatch.setattr(stores, "COMPACT", 2)
    log = EventLog(spark, shared_dir(spark, "log"))
    for n in range(3):
        log.append(spark.createDataFrame([_event(10 * n, "a", n), _event(10 * n + 1, f"b{n}", n)], LOG), n)
    assert len(log.manifest()["ids"]) == 1 and _events(log) == ["e0", "e1", "e11", "e21"]


def test_a_stream_is_captured_once_over_restarts(spark, tmp_path):
    log, folder = EventLog(spark, shared_dir(spark, "log")), str(tmp_path / "in")
    for n, rows in enumerate(([_event(1, "a", 0), _event(2, "b", 1)], [_event(3, "a", 300), _event(4, None, 2)])):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):  # the second start finds nothing new
            q = captured(spark.readStream.schema(LOG).parquet(folder), log, str(tmp_path / "checkpoint"), {"availableNow": True})
            q.awaitTermination(120)
            assert q.exception() is None
        assert log.manifest()["batch"] == n
    assert _events(log) == ["e1", "e2", "e4"]


def _shop(spark, n=150):
    r = random.Random(4)
    items = spark.createDataFrame([(f"i{k}", f"cat{k % 4}", f"sub{k % 7}" if k % 5 else "", f"brand{k % 3}", float(k) if k else None) for k in range(12)], "item_id string, category string, subcategory string, brand string, price double")
    users = spark.createDataFrame([(f"u{k}", k == 2) for k in range(6)], "user_id string, is_cold_start boolean")
    kinds = ["impression", "click", "favorite", "add_to_cart", "purchase"]
    rows = [(f"e{k}", f"u{r.randrange(5)}", r.choice(kinds), f"i{r.randrange(14)}", datetime(2026, 1, 1) + timedelta(hours=r.randrange(3000)), r.choice(["s1", "s2", None])) for k in range(n)]
    return items, users, rows, "event_id string, user_id string, event_type string, item_id string, timestamp timestamp, session_id string"


def _plain(made):
    affinity = {(r["user_id"], r["dim"], r["key"]): (round(r["score"], 6), round(r["weight"], 6)) for r in made[0].collect()}
    price = lambda r: None if r["mean_log_price"] is None else round(r["mean_log_price"], 6)
    names = ("is_cold_start", "train_event_count", "positive_event_count", "train_session_count", "last_event_at", "profile_status")
    return affinity, {r["user_id"]: (*(r[c] for c in names), price(r)) for r in made[1].collect()}


@pytest.mark.parametrize("half_life", [7.0, 0.0])
def test_sums_add_up_in_any_order(spark, half_life):
    items, users, rows, schema = _shop(spark)
    weights = {"click": 1.0, "favorite": 2.0, "add_to_cart": 3.0, "purchase": 5.0}
    want = _plain(profiles.build_profiles(spark.createDataFrame(rows, schema), items, users, half_life=half_life))
    parts = [observed(spark.createDataFrame(rows[a:b], schema), items, weights, half_life) for a, b in ((0, 40), (40, 41), (41, 150))]
    for order in ((0, 1, 2), (2, 0, 1)):
        state = parts[order[0]]
        for k in order[1:]:
            state = merged(state, parts[k], half_life)
        assert _plain(profiles_of(state, users, half_life)) == want


def test_profiles_follow_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BUCKETS", 3)
    items, users, rows, schema = _shop(spark)
    store, folder = ProfileStore(spark, shared_dir(spark, "profiles"), half_life=30.0), str(tmp_path / "in")
    with pytest.raises(LookupError):
        store.profiles(users)
    rows.sort(key=lambda r: r[4])
    done = []
    for some in (rows[50:100], rows[100:], rows[:50]):  # the oldest last
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        q = keep_profiles(spark.readStream.schema(schema).parquet(folder), store, items, str(tmp_path / "checkpoint"), {"availableNow": True})
        q.awaitTermination(180)
        assert q.exception() is None
        done += some
        assert _plain(store.profiles(users)) == _plain(profiles.build_profiles(spark.createDataFrame(done, schema), items, users, half_life=30.0))
    before = _plain(store.profiles(users))
    store.add(spark.createDataFrame(rows[:50], schema), items, store.manifest()["batch"])  # a replay
    assert _plain(store.profiles(users)) == before
    one = spark.createDataFrame([("new", "u1", "purchase", "i3", datetime(2027, 1, 1), "s9")], schema)
    held = {e["path"] for e in store.manifest()["sums"]}
    store.add(one, items, 99)
    assert len(held & {e["path"] for e in store.manifest()["sums"]}) >= 1  # other users' parts stay
    assert _plain(store.profiles(users)) == _plain(profiles.build_profiles(spark.createDataFrame([*rows, tuple(one.first())], schema), items, users, half_life=30.0))
