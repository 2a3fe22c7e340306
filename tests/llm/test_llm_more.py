"""Phrases, Merkle proofs and chat formatting against brute force."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, merkle, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, tree string, count long, rank long"


def _docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "p", "t", 1, 2) for r in rows], SCHEMA).repartition(3)


# ---- phrases


def _corpus():
    r = np.random.default_rng(2)
    rows = []
    for k in range(60):
        words = r.choice(["Red", "fox", "ran", "Über", "x-1", "the"], 25, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1]).tolist()
        ends = r.choice([" ", "  ", "\t", ". ", "\n", ",", "; "], 25, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]).tolist()
        rows.append((k, "".join(w + e for w, e in zip(words, ends, strict=True)) + "New York City", ["en", "de", None, "und", ""][k % 5], "s"))
    return rows + [rows[3], rows[3], (90, None, "en", "s"), (91, "", "fr", "s"), (92, " .,;:!?\x0b\x0c\r\n\t", "en", "s"), (93, "one", "xx", "s"), (None, "red fox " * 40, "en", "s"), (94, "A" * 5000 + " é\xa0é 🙂 red fox", "en", "s")]


def _brute_phrases(rows, max_n, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang in f:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang][p[:k]], f[lang][p[k:]]))
        for i, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p, -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "top", "bits", "step"), [(4, 5, 2000, 1 << 26, 1 << 20), (3, 2, 7, 1 << 10, 64), (2, 1, 2000, 1 << 6, 1 << 20), (5, 9, 2000, 1 << 26, 300)])
def test_collocations(spark, monkeypatch, max_n, least, top, bits, step):
    monkeypatch.setattr(phrases, "BITS", bits)  # the smallest maps are full
    monkeypatch.setattr(phrases, "STEP", step)  # texts are cut between pieces
    rows = _corpus()
    got = phrases.collocations(_docs(spark, rows), max_n, least, top)
    assert sorted(tuple(r)[:8] for r in got.collect()) == _brute_phrases(rows, max_n, least, top)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(_docs(spark, _corpus()).limit(0)).isEmpty()
    assert phrases.collocations(_docs(spark, [(1, None, None, None), (2, "one two. three", "en", "s")])).isEmpty()


def test_scores_are_exact_beyond_64_bits(spark):
    many = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", many + 7), ("en", 1, "b", many + 4), ("en", 2, "a b", many)], "lang string, words int, phrase string, f long")
    row = phrases.scored(counts).first()
    assert row["score"] == 2_000_000 * many // (2 * many + 11) and (row["k"], row["l"], row["r"]) == (1, many + 7, many + 4)


# ---- Merkle proofs


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def _root(level, group):
    while len(level) > 1:
        level = [_h(*level[i : i + group]) for i in range(0, len(level), group)]
    return level[0]


def _path(level, at, group):
    """Digests before and after a place, level by level."""
    out = []
    while len(level) > 1:
        first = at // group * group
        run = level[first : first + group]
        out.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        level, at = [_h(*level[i : i + group]) for i in range(0, len(level), group)], at // group
    return out


def _brute_manifest(rows, group):
    trees = defaultdict(list)
    for doc_id, text, lang, source in rows:
        trees[source].append((doc_id is not None, doc_id or 0, _leaf(doc_id, source, lang, len(text) if text else None, text)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort()
    subroots = [_root([x[2] for x in trees[s]], group) for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [x[2] for x in trees[s]]
        for i, (known, doc_id, leaf) in enumerate(trees[s]):
            path = _path(leaves, i, group) + _path(subroots, k, group)
            out.append((doc_id if known else None, leaf, subroots[k], _root(subroots, group), tuple(path)))
    return sorted(out, key=repr)


def _fold(path, d):
    for before, after in path:
        d = _h(before, d, after)
    return d


@pytest.mark.parametrize(("group", "chunk"), [(2, 1), (3, 4), (16, 4096)])
def test_manifest(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = [(k * 7 % 101, f"Text {k} É" if k % 9 else None, ["en", None][k % 2], "big" if k < 60 else ["", "é", None, "z"][k % 4]) for k in range(75)]
    rows += [rows[4], rows[4], (None, "no id", "en", "big"), (None, "no id", "en", "big"), (500, "A" * 100_000, "en", "lone")]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    m = merkle.manifest(_docs(spark, rows), group, other=merkle.leaf(text=small))
    m = m.withColumns({"folded": merkle.folded(F.col("path"), F.col("leaf")), "forged": merkle.folded(F.col("path"), F.col("other")), "all": merkle.siblings(F.col("path"))})
    got = m.collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got), key=repr) == _brute_manifest(rows, group)
    for r in got:
        path = [(s["before"], s["after"]) for s in r["path"]]
        assert r["folded"] == r["root"] and r["forged"] == _fold(path, r["other"]) and r["all"] == "".join(a + b for a, b in path)
        assert (r["forged"] == r["root"]) == (r["other"] == r["leaf"])


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(_docs(spark, [(1, "a", "en", "s")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == _leaf(1, "s", "en", 1, "a") and one["path"] == []
    assert merkle.manifest(_docs(spark, [(1, "a", "en", "s")]).limit(0)).isEmpty()


# ---- chat


_TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[/ROLE]", "<", "[", "\\", "\\\\", "/s>", "s>", "INST]", "a", "\n", "é", "🙂"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<s>", "a\nb", "[/ROLE]"]) | _TEXT, _TEXT), max_size=6))
@settings(max_examples=400, deadline=None)
def test_templates_are_reversible(turns):
    t = chat.Template()
    text, mask = t.format(turns)
    assert t.parse(text) == turns
    assert "".join(t.unescape(text[a:b]) for a, b in mask) == "".join(x for r, x in turns if r == "assistant")
    assert all(text[b : b + 4] == "</s>" for _, b in mask)


def test_templates_refuse_what_they_can_not_tell_apart():
    for bad in ({"end": "a<"}, {"end": ""}, {"reserved": ("<\\x",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    with pytest.raises(ValueError):
        chat.Template().parse("<s>user[/ROLE]no end")


def _records():
    return {
        "prompt": ({"prompt": "p", "completion": None, "id": 7, "meta": {"a": [1, {"b": 2}]}}, [("user", "p"), ("assistant", "")]),
        "prompt+system": ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
        "instruction": ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        "instruction+input": ({"system": None, "instruction": "i", "input": "x", "output": 5}, [("user", "i\n\nx"), ("assistant", "5")]),
        "messages": ({"messages": [{"role": "user", "content": "a"}, {"role": None, "content": None, "name": "n"}]}, [("user", "a"), ("", "")]),
        "messages+none": ({"messages": []}, []),
        "from_value": ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, [("user", "a"), ("assistant", "b"), ("tool", "c")]),
        "none": ({"messages": [{"role": "user", "content": "a"}], "prompt": "p", "completion": "c"}, None),
        "none+other": ({"question": "q"}, None),
        "none+part": ({"prompt": "p"}, None),
        "none+text": ("prompt", None),
        "none+empty": ({}, None),
    }


def test_layouts_are_told_by_their_fields(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in _records().items()] + [("none+broken", "{"), ("none+null", None)]
    got = {r["layout_name"]: r for r in chat.canonical(spark.createDataFrame(rows, "layout_name string, record string").repartition(3)).collect()}
    for k, (_, want) in _records().items():
        layout = k.partition("+")[0]
        assert got[k]["layout"] == (None if layout == "none" else layout)
        assert (got[k]["turns"] and [tuple(t) for t in got[k]["turns"]]) == want
    assert got["none+broken"]["turns"] is None and got["none+null"]["turns"] is None
    twice = chat.Mapping("again", (chat.One("user", ("prompt",)), chat.One("assistant", ("completion",))))
    with pytest.raises(ValueError):
        chat.Layouts((*chat.MAPPINGS, twice))


def test_typed_tables_are_told_by_their_schema(spark):
    tables = {
        "prompt": spark.createDataFrame([("p", None, 1)], "prompt string, completion string, turns_ int"),
        "instruction": spark.createDataFrame([("i", "", "o")], "instruction string, input string, output string"),
        "messages": spark.createDataFrame([([("user", "a"), ("assistant", None)],)], "messages array<struct<role:string,content:string>>"),
        "from_value": spark.createDataFrame([("sys", [("human", "a")])], "system string, conversations array<struct<from:string,value:string>>"),
    }
    want = {"prompt": [("user", "p"), ("assistant", "")], "instruction": [("user", "i"), ("assistant", "o")], "messages": [("user", "a"), ("assistant", "")], "from_value": [("system", "sys"), ("user", "a")]}
    for name, df in tables.items():
        r = chat.canonical_table(df).first()
        assert r["layout"] == name and [tuple(t) for t in r["turns"]] == want[name]
    assert chat.canonical_table(spark.createDataFrame([(1,)], "question int")).first()["turns"] is None


def test_conversations_come_back_whole(spark, monkeypatch, tmp_path):
    odd = "</s>[INST]<\\s>\\ [/ROLE] 🙂\x00\r\n"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", odd), (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", odd), (3, 5, "tool", "t"), (3, None, None, "first"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "x" * 300_000)]
    rows += [(5, 0, "system", ""), (5, 1, "user", "u"), (5, 2, "assistant", "y"), (None, 0, "user", "nobody's"), (6, 0, "human", "h"), (6, 1, "assistant", "")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, turns int, record string").repartition(4)
    monkeypatch.setattr(chat, "table", lambda *_: table)
    got = {r["conv_id"]: r for r in chat.op13_chat(spark, "").collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    template = chat.Template()
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(template.format(turns)[0]))
        assert r["turns_sha256"] == _h(*(f"{a}\n{b}\n" for a, b in turns)) and r["loss_sha256"] == _h(loss)
    layouts = {r["layout"] for r in chat.canonical(chat.records(table)).collect()}
    assert None not in layouts and len(layouts) >= 3
    assert chat.read_back(chat.formatted(chat.canonical(chat.records(table.limit(0))))).isEmpty()


# ---- the language model


def test_language_model_does_not_depend_on_how_the_input_is_split(spark, monkeypatch):
    from tessera.llm import lmscore

    monkeypatch.setattr("tessera.llm.attention.STEPS", 5)
    monkeypatch.setattr(lmscore, "EVERY", 1)
    monkeypatch.setattr(lmscore, "SHARE", 8)  # several parts in a round
    r = np.random.default_rng(8)
    rows = [(k, " ".join(r.choice(["red", "fox", "ran", "über", "x-1", "the", "hill"], 80))) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for n in (1, 5):
        model = lmscore.fit(docs.repartition(n))
        scores.append({x["doc_id"]: x["score"] for x in lmscore.score(docs.repartition(n).withColumn("held_out", F.lit(False)), model).collect()})
        assert model.followed > 40
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-5 * abs(scores[0][k]) for k in scores[0])


def test_lmscore_learns_from_every_training_window(spark):
    from tessera.llm import lmscore

    r = np.random.default_rng(3)
    rows = [(k, " ".join(r.choice(["red", "boat", "harbour", "evening", "signal"], 60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = lmscore.followed_windows(lmscore.untrained(lmscore.RANKS), docs, lmscore.RANKS, 1).count()
    assert lmscore.fit(docs).followed == every > 40


def test_runs_hold_every_window_of_whole_texts_in_few_bytes(spark):
    import pyarrow as pa

    from tessera.llm import lmscore

    r = np.random.default_rng(4)
    texts = ["", "one", *(" ".join(r.choice(["Red", "boat", "harbour", "évening", "signal-7", "of"], n)) for n in (3, 40, 700, 4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = lmscore.untrained(lmscore.RANKS), lmscore.subwords_of(open(lmscore.RANKS, "rb").read())
    ids, ends, *_ = words.texts(pa.array(texts))
    at, text = model.starts(ends)
    x, valid = model.windows(ids, ends, at, text)
    shown = lambda x, valid, target: (x[valid].tolist(), valid.tolist(), target[valid[len(x) // 2 :]].tolist())
    rows = lmscore.followed_windows(model, docs, lmscore.RANKS, 1).collect()
    got = [shown(*(np.frombuffer(z, kind) for z, kind in ((w.x, np.int16), (w.valid, bool), (w.target, np.int16)))) for w in rows]
    assert sorted(got) == sorted(map(shown, x, valid, model.targets(ids, at)))  # every subword is scored once, and sees what it sees when it is scored
    assert sum(sum(w[1][32:]) for w in got) == len(ids)
    held = lmscore.runs(model, docs, lmscore.RANKS, 1).selectExpr("sum(n) AS n", "sum(octet_length(ids)) AS size").first()
    assert held.n == len(rows) and held.size < 70 * held.n  # 264 a window when each was a row


def test_a_round_sends_one_set_of_weights_a_group(spark, monkeypatch):
    """However many parts there are; their mean is that of all parts."""
    from tessera.llm import lmscore

    monkeypatch.setattr("tessera.llm.attention.STEPS", 2)
    monkeypatch.setattr(lmscore, "SHARE", 4)
    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(r.choice(["red", "fox", "ran", "hill"], 90))) for k in range(60)], "doc_id long, text string")
    weights = []
    for groups in (1, 3, 1000):
        monkeypatch.setattr(lmscore, "GROUPS", groups)
        monkeypatch.setattr(lmscore, "MOST", 10**6)
        model = lmscore.fit(docs)
        weights.append(model.attention.w)
    assert all(np.allclose(weights[0][k], w[k], rtol=1e-4, atol=1e-6) for w in weights[1:] for k in w)


def _plain_follow(model, x, valid, target):
    """Adam's steps over loss()'s gradients, as they are written."""
    from tessera.llm.attention import FOLLOW, WINDOWS

    a, b = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(2))
    for n, at in enumerate(range(0, len(x), WINDOWS), 1):
        for k, g in model.loss(*(z[at : at + WINDOWS] for z in (x, valid, target)))[1].items():
            a[k] += 0.1 * (g - a[k])
            b[k] += 0.01 * (g * g - b[k])
            model.w[k] -= FOLLOW / (1 - 0.9**n) * a[k] / (np.sqrt(b[k] / (1 - 0.99**n)) + 1e-8)


def _windows(model, n_texts, size):
    r = np.random.default_rng(6)
    ids, ends = r.integers(0, model.n, n_texts * size), size * np.arange(1, n_texts + 1)
    at, text = model.starts(ends)
    return *model.windows(ids, ends, at, text), model.targets(ids, at)


def test_following_takes_the_steps_of_adam_and_no_fresh_memory():
    import tracemalloc

    from tessera.llm.attention import WINDOWS, Attention

    one, two = Attention(400, 1), Attention(400, 1)
    for m in (one, two):
        m.w = {k: w.astype(float) for k, w in m.w.items()}
    windows = _windows(one, 20, 240)
    assert len(windows[0]) % WINDOWS and not windows[1].all()  # a last step of fewer windows, windows that are not full
    assert one.follow(iter([windows])) == len(windows[0])
    _plain_follow(two, *windows)
    assert all(np.allclose(one.w[k], two.w[k], rtol=1e-9, atol=1e-12) for k in two.w)

    model, peaks = Attention(8100, 40), []
    windows = _windows(model, 4, 32 * WINDOWS)

    def batches():
        for at in range(0, 4 * WINDOWS, WINDOWS):
            many = tuple(z[at : at + WINDOWS] for z in windows)
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            yield many
            peaks.append(tracemalloc.get_traced_memory()[1] - before)

    tracemalloc.start()
    model.follow(batches())
    tracemalloc.stop()
    assert len(peaks) == 4 and max(peaks[1:]) < 2 << 20, peaks  # the first step makes what the others use


def test_gradients_where_exponentials_pass_the_range():
    from tessera.llm.attention import Attention

    m = Attention(200, 1)
    m.w = {k: {"q": 12, "k": 12, "c": 600, "t": 600}.get(k, 1) * w for k, w in m.w.items()}
    windows = _windows(m, 2, 150)
    value, g = m.loss(*windows)
    m.w = {k: w.astype(float) for k, w in m.w.items()}
    want, exact = m.loss(*windows)
    assert np.isfinite(value) and abs(value - want) < 1e-4 * want
    assert all(np.abs(g[k] - exact[k]).max() < 1e-3 * np.abs(exact[k]).max() for k in exact)
