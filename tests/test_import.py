import hashlib
from collections import Counter

import pytest

from tessera.sources import filetree, validate
from tessera.sources.importer import Store, file_hashes, fingerprint, import_dataset
from tessera.sources.validate import ValidationError, violations

FILES = {
    "items": ["item_id,title,description,category,subcategory,brand,price,quality_score,popularity_score,is_cold_start,created_at", 'i1,"Big, red",,C,S,B,10.50,0.5,0.5,true,2026-01-01T00:00:00', "i2,T,D,C,S,B,0,1,0,No,2026-01-02T00:00:00"],
    "users": ["user_id,preferred_categories,preferred_brands,price_preference,activity_level,is_cold_start,created_at", 'u1,"[""A"", ""B""]",[],,high,false,2026-01-01T00:00:00'],
    "queries": ["query_id,query_text,intended_category,semantic_intent,created_at", "q1,red,,,2026-01-01T00:00:00"],
    "events": ["event_id,event_type,request_id,session_id,user_id,query_id,query_text,item_id,position,timestamp,click_duration_ms,add_to_cart_quantity,purchase_amount", "e1,click,r,s,u1,,,i1,1,2026-01-03T00:00:00,5,,"],
    "qrels": ["query_id,item_id,relevance_grade", "q1,i1,3"],
}


def _write(folder, **changed):
    for name, lines in (FILES | changed).items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8-sig" if name == "users" else "utf-8")
    return str(folder)


def test_import_is_atomic_and_audited(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, store = _write(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    assert import_dataset(store, folder, dry_run=True).status == "skipped" and store.current is None
    done = import_dataset(store, folder)
    assert done.status == "completed" and done.counts == {"items": 2, "users": 1, "queries": 1, "events": 1, "qrels": 1}
    assert store.table("users").first()["preferred_categories"] == ["A", "B"]
    assert store.table("items").orderBy("item_id").first()["title"] == "Big, red"
    assert import_dataset(store, folder).status == "already_imported"
    held = store.current
    folder = _write(tmp_path / "in", qrels=["query_id,item_id,relevance_grade", "q1,i2,1"])
    assert import_dataset(store, folder).status == "failed" and store.current == held
    assert import_dataset(store, folder, replace=True).status == "completed" and store.current != held
    assert [r["status"] for r in store.runs().collect()].count("failed") == 1
    assert store.latest_completed().first()["qrel_count"] == 1
    assert set(file_hashes(spark, folder)) == {f"{n}.csv" for n in FILES} and len(fingerprint(spark, folder)) == 64


def test_bad_rows_and_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    bad = FILES["events"] + ["e1,click,r,s,u1,,,i1,1,2026-01-03T00:00:00,5,,", "e2,jump,r,s,u1,,,i1,1,2026-01-03T00:00:00,5,,", "e3,click,r,s,nobody,q9,,i9,0,never,-1,,NaN"]
    folder = _write(tmp_path / "in", events=bad)
    with pytest.raises(ValidationError) as found:
        import_dataset(store, folder)
    text = " ".join(found.value.errors)
    for rule in ("duplicate", "event_type", "unknown_user_id", "unknown_item_id", "unknown_query_id", "position", "timestamp", "click_duration_ms", "purchase_amount"):
        assert rule in text
    with pytest.raises(Exception):
        import_dataset(store, _write(tmp_path / "in", events=FILES["events"], qrels=["item_id,query_id,relevance_grade", "i1,q1,3"]))
    with pytest.raises(FileNotFoundError):
        (tmp_path / "in" / "qrels.csv").unlink()
        import_dataset(store, str(tmp_path / "in"))


def test_item_rules(spark):
    rows = [("i1", "t", "", "c", "s", "b", "-1", "1.5", "NaN", "maybe", "x"), (" ", "t", "", "c", "s", "b", "1", "0", "1", "YES", "2026-01-01")]
    names = FILES["items"][0].split(",")
    got = {(r["key"], r["rule"]) for r in violations("items", spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()}
    assert got == {("i1", k) for k in ("price", "quality_score", "popularity_score", "is_cold_start", "created_at")} | {("", "item_id")}


def _hot_events():
    """Events under few ids, blank, repeated and unknown ones among them; most share one."""
    rows = []
    for k in range(400):
        event = "hot" if k % 10 < 7 else [" ", None, f"e{k}", "e1"][k % 4]
        user = ["u1", " u1 ", None, "", "nobody"][k % 5] if k % 3 else "ghost"
        rows.append((event, ["click", "jump", None][min(k % 17, 2)] if k % 4 == 0 else "click", "r", "s", user, [None, "", "q1", "q9"][k % 4], "", "i1" if k % 2 else "i9", str(k % 3), "2026-01-03T00:00:00", "", "", ""))
    return rows + rows[:40]


@pytest.mark.parametrize("block", [3, 10_000])
def test_hot_keys_are_checked_without_meeting(spark, monkeypatch, block):
    monkeypatch.setattr(validate, "BLOCK", block)
    names = FILES["events"][0].split(",")
    text = spark.createDataFrame(_hot_events(), ", ".join(f"{n} string" for n in names)).repartition(5)
    others = {"users": spark.createDataFrame([("u1",), ("u2",)], "user_id string"), "items": spark.createDataFrame([("i1 ",)], "item_id string"), "queries": spark.createDataFrame([("q1",)], "query_id string")}
    hashed = {}
    for r in text.selectExpr("*", "xxhash64(*) AS h").collect():
        hashed.setdefault((r["event_id"] or "").strip(), []).append((r["h"], r))
    want = Counter()
    for key, rows in hashed.items():
        first = min(rows, key=lambda x: x[0])[1]
        want[key, "duplicate", key] += len(rows) - 1
        if first["event_type"] != "click":
            want[key, "event_type", first["event_type"]] += 1
            continue
        want[key, "event_id", first["event_id"]] += not key
        want[key, "position", first["position"]] += first["position"] == "0"
        want[key, "unknown_user_id", first["user_id"]] += (first["user_id"] or "").strip() not in ("u1", "u2")
        want[key, "unknown_item_id", first["item_id"]] += first["item_id"] != "i1"
        want[key, "unknown_query_id", first["query_id"]] += first["query_id"] == "q9"
    bad = violations("events", text, others)
    assert Counter((r["key"], r["rule"], r["value"]) for r in bad.collect()) == +want
    assert "Window" not in bad._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValidationError) as found:
        validate.require_valid("events", text, others, most=2)
    assert sum(found.value.counts.values()) == sum(want.values()) and len(found.value.errors) == 2
    assert violations("events", text.limit(0), others).isEmpty()


def _tree(spark, folder, size=64):
    files = filetree.listed(spark, str(folder), ["a.csv", "b.csv"])
    return filetree.leaves(spark, files, size)


def test_a_hash_tree_names_what_changed(spark, tmp_path):
    lines = [f"{k},{'é' * (k % 7)}\r" for k in range(60)]
    (tmp_path / "b.csv").mkdir()
    for part in (0, 1):
        (tmp_path / "b.csv" / f"part-{part}").write_bytes(b"x\n" * 3)
    content = "\n".join(lines).encode() + b"\n"
    (tmp_path / "a.csv").write_bytes(content)
    want, at = {}, 0
    for line in [x + b"\n" for x in content.split(b"\n")[:-1]]:
        want.setdefault(at // 64, []).append(line)
        at += len(line)
    got = {r["range"]: r for r in _tree(spark, tmp_path).filter("file = 'a.csv'").collect()}
    assert {k: (len(v), sum(map(len, v)), hashlib.sha256(b"".join(v)).hexdigest()) for k, v in want.items()} == {k: (r["lines"], r["bytes"], r["digest"]) for k, r in got.items()}
    old = spark.createDataFrame(_tree(spark, tmp_path).collect(), "file string, range long, lines long, bytes long, digest string")
    mark = filetree.fingerprint(spark, str(tmp_path), ["a.csv", "b.csv"])
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")  # other splits, the same leaves
    try:
        assert filetree.changed(old, _tree(spark, tmp_path)).isEmpty()
        assert filetree.fingerprint(spark, str(tmp_path), ["b.csv", "a.csv"]) == mark
        (tmp_path / "a.csv").write_bytes(content.replace(b"\n30,", b"\n3O,"))
        assert [tuple(r) for r in filetree.changed(old, _tree(spark, tmp_path)).collect()] == [("a.csv", (content.index(b"\n30,") + 1) // 64, "changed")]
        assert filetree.fingerprint(spark, str(tmp_path), ["a.csv", "b.csv"]) != mark
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    (tmp_path / "a.csv").write_bytes(content[:-1])  # the last line's end
    assert filetree.fingerprint(spark, str(tmp_path), ["a.csv", "b.csv"]) != mark
    assert filetree.roots(_tree(spark, tmp_path), 3).count() == 3
    with pytest.raises(FileNotFoundError):
        filetree.listed(spark, str(tmp_path), ["a.csv", "c.csv"])


def test_the_same_bytes_are_checked_once(spark, tmp_path, monkeypatch):
    """Five steps over two data sets that differ by the judgements: each table's bytes are checked once, and again if what they refer to changes."""
    from tessera.sources import importer

    (tmp_path / "in").mkdir()
    folder, store, asked, check = _write(tmp_path / "in"), Store(spark, str(tmp_path / "store")), [], importer.require_valid
    monkeypatch.setattr(importer, "require_valid", lambda name, *rest: (asked.append(name), check(name, *rest)))
    assert [import_dataset(store, folder, dry_run=True).status, import_dataset(store, folder).status, import_dataset(store, folder).status] == ["skipped", "completed", "already_imported"]
    folder = _write(tmp_path / "in", qrels=["query_id,item_id,relevance_grade", "q1,i2,1"])
    assert [import_dataset(store, folder).status, import_dataset(store, folder, replace=True).status] == ["failed", "completed"]
    assert Counter(asked) == {"items": 1, "users": 1, "queries": 1, "events": 1, "qrels": 2}
    folder = _write(tmp_path / "in", qrels=["query_id,item_id,relevance_grade", "q1,i2,1"], items=FILES["items"][:2])  # an item that is referred to goes
    with pytest.raises(ValidationError):
        import_dataset(store, folder, replace=True)
    with pytest.raises(ValidationError):  # what was found bad is checked again
        import_dataset(store, folder, replace=True)


def test_files_are_hashed_as_they_are_read(spark, tmp_path):
    """A file's SHA-256 needs no row that holds it all; marks of byte order, line ends and bytes that are no text count."""
    contents = {"events": b"e\n" * 70_000 + b"\xff\x00\r\n\n", "items": b"a\n\n\nb", "qrels": b"", "queries": b"\xef\xbb\xbf", "users": b"\xef\xbb\xbfu,v\r\n1,2\r\n"}
    for name, content in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # 2 GB otherwise
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert file_hashes(spark, str(tmp_path)) == {f"{n}.csv": hashlib.sha256(c).hexdigest() for n, c in contents.items()}
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "5000"
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    (tmp_path / "users.csv").unlink()
    (tmp_path / "users.csv").mkdir()
    with pytest.raises(FileNotFoundError):
        file_hashes(spark, str(tmp_path))


@pytest.mark.parametrize("split", ["40", "700", "100000"])
def test_leaves_are_hashed_where_their_lines_are(spark, tmp_path, split):
    """Other splits give the same leaves; no line goes through a shuffle but those of leaves that splits share."""
    content = b"".join(b"%d,%s\n" % (k, b"x" * (k * 7 % 90)) for k in range(300))
    (tmp_path / "a.csv").write_bytes(content)
    (tmp_path / "b.csv").write_bytes(content[:5000])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, split if "max" in k else "0")
    try:
        tree = _tree(spark, tmp_path, 256)
        got = {(r["file"], r["range"]): (r["lines"], r["bytes"], r["digest"]) for r in tree.collect()}
        plan = tree._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for name, data in (("a.csv", content), ("b.csv", content[:5000])):
        at = 0
        for line in data.splitlines(keepends=True):
            line = line if line.endswith(b"\n") else line + b"\n"
            want.setdefault((name, at // 256), []).append(line)
            at += len(line)
    assert got == {k: (len(v), sum(map(len, v)), hashlib.sha256(b"".join(v)).hexdigest()) for k, v in want.items()}
    assert "Window" not in plan and "MapInArrow" in plan


def test_valid_rows_are_not_gathered(spark, tmp_path, monkeypatch):
    """A table without violations is told from its keys, flags and ids; what has any goes through violations() as before."""
    names = FILES["events"][0].split(",")
    frame = lambda rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    others = {"users": spark.createDataFrame([("u1",)], "user_id string"), "items": spark.createDataFrame([("i1 ",)], "item_id string"), "queries": spark.createDataFrame([("q1",)], "query_id string")}
    row = {n: "" for n in names} | {"event_type": "click", "user_id": " u1", "item_id": "i1", "timestamp": "2026-01-03T00:00:00"}
    make = lambda *changes: frame([tuple((row | {"event_id": f"e{k}"} | c)[n] for n in names) for k, c in enumerate(changes)])
    good = make({}, {"query_id": "q1"}, {"query_id": None, "position": "3"})
    with monkeypatch.context() as m:
        m.setattr(validate, "violations", lambda *_: pytest.fail("rows were gathered"))
        validate.require_valid("events", good, others)
    for change in ({"event_id": "e0 "}, {"event_id": " "}, {"event_type": None}, {"position": "0"}, {"user_id": None}, {"user_id": "u2"}, {"item_id": ""}, {"query_id": "q9"}, {"timestamp": None}):
        text = make({}, change)
        assert not validate.sound("events", text, others) and not violations("events", text, others).isEmpty(), change
    (tmp_path / "in").mkdir()
    folder = _write(tmp_path / "in", items=[FILES["items"][0].replace("brand", "maker"), *FILES["items"][1:]])  # a column that no rule reads
    with pytest.raises(Exception, match="(?i)header|column"):
        import_dataset(Store(spark, str(tmp_path / "store")), folder)
