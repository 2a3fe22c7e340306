"""Indices as tables that follow their data: segments with tombstones, one generation for all parts, and an old one that serves while a build fails.

A collection is a folder, named by what is indexed: its name, the plan that makes its documents, and the settings. A refresh compares the source's
rows with those indexed, by id and a digest of the text. Added and changed documents form a segment with postings, features and statistics of its own; what was
there before is left out by tombstones (item_id, segment). Numbers of documents, lengths and document frequencies add up across segments, less
what the newly dead had. Segments of like size are merged, and those half dead written anew.

A generation is a manifest that names its tables, written once under the next free number; readers keep the one they began with. Writers
claim a number by creating a file that must not exist, so two never write the same one. Each manifest is complete for the documents its
writer saw, so of two writers' generations either is right for its source.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import SemanticConfig
from ..operators.bm25 import BM25Index, term_rows
from ..operators.semantic import SemanticIndex
from ..operators.tfidf import TfidfIndex, frequencies, idfs, in_blocks, item_lengths, unpacked
from ..operators.tfidf import word_rows as counts  # what features are counted from
from ..functions.text import tokenize
from ..storage import claim, discard, hadoop, own_dir, read_text, stored, write_text

#: Segments of a size class that are merged; documents of one class differ by less than this factor.
MERGE = 4
#: Share of documents that differ beyond which everything is built anew; share of a segment's documents that are dead beyond which it is written anew.
REBUILD, DEAD = 0.5, 0.5
#: A fit is due if folded items keep less of their energy than this share of what fitted ones keep, or are more than this share of them.
KEPT, FOLDED = 0.9, 1.0


class IndexNotReady(LookupError):
    """No generation has been built."""


def _wide(spark: SparkSession, df: DataFrame) -> str:
    key = "spark.sql.debug.maxToStringFields"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "100000")  # so that no field is left out of the plan's text
    try:
        return df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def plan_mark(df: DataFrame) -> str:
    """A digest of the plan that makes df: filters, expressions and constants, without the files it reads."""
    return hashlib.sha256(_wide(df.sparkSession, df).encode()).hexdigest()


def source_mark(df: DataFrame) -> str | None:
    """A digest of the files that df reads, with sizes and times as they were listed when df was made; None if it reads no files."""
    leaves, total, n = df._jdf.queryExecution().analyzed().collectLeaves(), hashlib.sha256(), 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() != "HadoopFsRelation":
                return None
            location = relation.location()
            if not hasattr(location, "allFiles"):
                return None
            total.update("\n".join(sorted(location.allFiles().mkString("\n").split("\n"))).encode())
            n += 1
        elif leaf.getClass().getSimpleName() not in ("OneRowRelation", "Range"):
            return None
    return total.hexdigest() if n else None


@dataclass(frozen=True)
class IndexConfig:
    """The parts of a collection and their settings; k1 and b are applied by searches, so they need no index of their own."""

    bm25: bool = True
    normalise: bool = True
    stop_words: bool = True
    pattern: str | None = None
    semantic: SemanticConfig | None = None

    def mark(self) -> str:
        return repr(self)


@dataclass
class Generation:
    """One consistent state of a collection: all parts hold the same documents."""

    spark: SparkSession
    config: IndexConfig
    manifest: dict = field(repr=False)
    root: str

    @property
    def number(self) -> int:
        return self.manifest["generation"]

    @property
    def n_items(self) -> int:
        return self.manifest["items"]

    def table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])

    def dead(self) -> DataFrame | None:
        return self.table(self.manifest["dead"]) if self.manifest["dead"] else None

    def live(self, name: str) -> DataFrame:
        """The rows of the segments' tables of a name whose documents are alive, with segment."""
        parts = [(self._rows(s) if name == "words" else self.table(s["tables"][name])).withColumn("segment", F.lit(s["name"])) for s in self.manifest["segments"] if name in s["tables"]]
        rows = reduce(DataFrame.unionByName, parts)
        dead = self.dead()
        return rows if dead is None else rows.join(dead, ["item_id", "segment"], "left_anti")

    def _rows(self, segment: dict) -> DataFrame:
        """A segment's (item_id, hashes), whose table has them in blocks."""
        return unpacked(self.table(segment["tables"]["words"]), self._kind(segment))

    def _kind(self, segment: dict) -> str:
        return self.table(segment["tables"]["documents"]).schema["item_id"].dataType.simpleString()

    def documents(self) -> DataFrame:
        """(item_id, print, dl)."""
        return self.live("documents").drop("segment")

    def bm25(self, k1: float = 1.5, b: float = 0.75) -> BM25Index:
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be above 0, and b in 0 to 1")
        m = self.manifest
        stats = self.spark.range(1).select(F.lit(m["items"]).cast("long").alias("n"), F.lit(m["tokens"] / m["items"]).cast("double").alias("avgdl"))
        return BM25Index(self.live("postings").drop("segment"), self.table(m["terms"]), stats, k1, b, self.config.normalise, self.config.stop_words)

    def tfidf(self) -> TfidfIndex:
        """Frequencies and lengths are over all live documents, so they are made when a generation is first asked for them, and kept with it."""
        n, path, kind = self.n_items, f"{self.root}/w{self.number:06d}.json", self._kind(self.manifest["segments"][0])
        held = json.loads(read_text(self.spark, path) or "{}")
        if not held:
            # blocks of segments serve as they are until documents die
            blocks = _written(self.root, in_blocks(self.live("words").drop("segment")), "words") if self.manifest["dead"] else None
            tables = [self.table(t) for t in ([blocks] if blocks else [s["tables"]["words"] for s in self.manifest["segments"]])]
            found = _written(self.root, frequencies(reduce(DataFrame.unionByName, tables)), "features")
            lengths = _written(self.root, item_lengths(reduce(DataFrame.unionByName, tables), self.table(found), n, kind), "lengths")
            held = {"words": blocks, "features": found, "lengths": lengths}
            write_text(self.spark, path, json.dumps(held))  # of two readers that make them at once, either's are right
        tables = [self.table(t) for t in ([held["words"]] if held["words"] else [s["tables"]["words"] for s in self.manifest["segments"]])]
        return TfidfIndex(reduce(DataFrame.unionByName, tables), kind, idfs(self.table(held["features"]), n), self.table(held["lengths"]), self.config.pattern)

    def semantic(self) -> SemanticIndex:
        s = self.manifest["semantic"]
        shared = reduce(DataFrame.unionByName, [self.table(v) for v in s["vectors"]]).drop("energy")
        if len(s["vectors"]) > 1:
            shared = shared.dropDuplicates(["print"])  # folded again, with the same components
        items = self.documents().select("item_id", "print")
        vocabularies = {k: self.table(v) for k, v in s["vocabularies"].items()}
        return SemanticIndex(self.table(s["components"]), vocabularies, items.join(shared, "print").select("item_id", "vector"), self.config.semantic, items, shared)

    def energy(self) -> DataFrame:
        """(generation, kind, items, total, kept): squared lengths of the features of fitted and of folded items, and what of them the components keep."""
        rows = [(self.number, e["kind"], e["items"], e["total"], e["kept"]) for e in (self.manifest["semantic"] or {}).get("energy", [])]
        return self.spark.createDataFrame(rows, "generation long, kind string, items long, total double, kept double")


class Collection:
    """Generations of the indices of one source with one set of parts."""

    def __init__(self, spark: SparkSession, root: str, config: IndexConfig):
        self.spark, self.root, self.config = spark, root, config

    # ---- manifests

    def _numbers(self) -> list[int]:
        fs, path = hadoop(self.spark, self.root)
        if not fs.exists(path):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(path))
        return sorted(int(n[1:-5]) for n in names if n.startswith("g") and n.endswith(".json"))

    def generation(self, number: int | None = None) -> Generation:
        """The newest generation, or one of a number."""
        numbers = self._numbers()
        if not numbers or (number and number not in numbers):
            raise IndexNotReady(self.status()["error"] or "no generation has been built")
        return Generation(self.spark, self.config, json.loads(read_text(self.spark, f"{self.root}/g{number or numbers[-1]:06d}.json")), self.root)

    def status(self) -> dict:
        """ready, generation, built_at, items, segments and error, the last build's, if it failed."""
        error, numbers = read_text(self.spark, f"{self.root}/ERROR"), self._numbers()
        if not numbers:
            return {"ready": False, "generation": 0, "built_at": None, "items": 0, "segments": 0, "error": error or None}
        m = self.generation(numbers[-1]).manifest
        return {"ready": True, "generation": m["generation"], "built_at": m["built_at"], "items": m["items"], "segments": len(m["segments"]), "error": error or None}

    def _publish(self, manifest: dict) -> Generation:
        number = (self._numbers() or [0])[-1] + 1
        while not claim(self.spark, f"{self.root}/c{number:06d}"):  # a writer that died leaves its number unused
            number += 1
        manifest |= {"generation": number, "built_at": datetime.now(UTC).isoformat()}
        write_text(self.spark, f"{self.root}/g{number:06d}.json", json.dumps(manifest))
        write_text(self.spark, f"{self.root}/ERROR", "")
        return Generation(self.spark, self.config, manifest, self.root)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the tables and manifests that only generations before the last keep name; how many tables went. No reader may still use these."""
        numbers = self._numbers()
        made = {n: read_text(self.spark, f"{self.root}/w{n:06d}.json") for n in numbers}
        held = [self.generation(n).manifest | ({"made": json.loads(made[n])} if made[n] else {}) for n in numbers]
        paths = lambda ms: {p for m in ms for p in _paths(m)}
        old = paths(held[:-keep]) - paths(held[-keep:])
        for p in [*old, *(f"{self.root}/{kind}{n:06d}.json" for n in numbers[:-keep] for kind in ("g", "w"))]:
            fs, path = hadoop(self.spark, p)
            fs.delete(path, True)
        return len(old)

    # ---- building

    def _write(self, df: DataFrame, name: str) -> dict:
        return _written(self.root, df, name)

    def _table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])

    def _segment(self, docs: DataFrame) -> dict:
        """A segment of (item_id, text, print)."""
        tables = {}
        tokens = tokenize(F.col("text"), self.config.stop_words, self.config.normalise)
        if self.config.bm25:
            cut = docs.select("item_id", "print", tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
            tables["documents"] = self._write(cut.select("item_id", "print", "dl"), "documents")
            tables["postings"] = self._write(term_rows(docs, tokens), "postings")
        else:
            tables["documents"] = self._write(docs.select("item_id", "print", F.lit(0).cast("long").alias("dl")), "documents")
        if self.config.pattern:
            tables["words"] = self._write(in_blocks(counts(docs.select("item_id", "text"), self.config.pattern)), "words")
        return self._sized(tables)

    def _sized(self, tables: dict) -> dict:
        rows, tokens = self._table(tables["documents"]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": uuid.uuid4().hex[:12], "items": rows, "tokens": tokens, "tables": tables}

    def _added(self, old: dict | None, new: DataFrame, gone: DataFrame | None, key: str) -> DataFrame:
        """(key, df): document frequencies of a generation, from those before, a segment's rows and the rows of the newly dead."""
        parts = [new.groupBy(key).agg(F.count("*").alias("df"))] + ([self._table(old)] if old else [])
        if gone is not None:
            parts.append(gone.groupBy(key).agg((-F.count("*")).alias("df")))
        return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("df").alias("df")).filter("df > 0")

    def build(self, docs: DataFrame) -> Generation:
        """The next generation, all of it from (item_id, text); item_id is a key."""
        return self._guarded(lambda: self._anew(_printed(docs), docs))

    def refresh(self, docs: DataFrame) -> Generation:
        """The next generation, from what differs between docs and the newest one; that one itself if nothing does. If it fails, the newest goes on serving and the status has the error."""
        return self._guarded(lambda: self._next(docs))

    def _guarded(self, make) -> Generation:
        try:
            return make()
        except Exception as e:
            write_text(self.spark, f"{self.root}/ERROR", f"build failed, the last generation serves on: {str(e)[:500]}")
            if self._numbers():
                return self.generation()
            raise IndexNotReady(f"build failed: {str(e)[:500]}") from e

    def ensured(self, docs: DataFrame) -> Generation:
        """The newest generation if the files that docs reads are those it was made from, else the next."""
        mark = source_mark(docs)
        if mark and self._numbers():
            newest = self.generation()
            if newest.manifest["mark"] == mark:
                return newest
        return self.refresh(docs)

    def _anew(self, printed: DataFrame, docs: DataFrame) -> Generation:
        segment = self._segment(printed)
        if not segment["items"]:
            raise ValueError("no items to index")
        m = {"mark": source_mark(docs), "segments": [segment], "dead": None, "items": segment["items"], "tokens": segment["tokens"], "semantic": None}
        return self._publish(self._finished(m, None, segment, None, docs))

    def _next(self, docs: DataFrame) -> Generation:
        printed = _printed(docs)
        if not self._numbers():
            return self._anew(printed, docs)
        old = self.generation()
        there = old.live("documents").select("item_id", F.col("print").alias("old"), "segment")
        diff = printed.select("item_id", F.col("print").alias("new")).join(there, "item_id", "full_outer").filter("new IS NULL OR old IS NULL OR new <> old")
        diff = self._table(self._write(diff.select("item_id", "segment", F.col("new").isNotNull().alias("comes")), "diff"))
        come, go = diff.agg(F.coalesce(F.sum(F.col("comes").cast("long")), F.lit(0)), F.count("segment")).first()
        if not come and not go:
            if old.manifest["mark"] == source_mark(docs):
                return old
            return self._publish(old.manifest | {"mark": source_mark(docs)})  # other files, the same rows
        if old.n_items + come - go <= 0:
            raise ValueError("no items to index")
        if max(come, go) > REBUILD * old.n_items:
            return self._anew(printed, docs)
        m = dict(old.manifest) | {"mark": source_mark(docs)}
        segment = self._segment(printed.join(diff.filter("comes").select("item_id"), "item_id", "left_semi")) if come else None
        gone = diff.filter("segment IS NOT NULL").select("item_id", "segment") if go else None
        if go:
            m["dead"] = self._write(gone if old.dead() is None else old.dead().unionByName(gone), "dead")
        m["segments"] = m["segments"] + ([segment] if segment else [])
        if not segment and not go:
            return old
        lost = old.live("documents").join(gone, ["item_id", "segment"], "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() if go else (0, 0)
        m["items"] = old.n_items + (segment["items"] if segment else 0) - lost[0]
        m["tokens"] = m["tokens"] + (segment["tokens"] if segment else 0) - lost[1]
        return self._publish(self._merged(self._finished(m, old, segment, gone, docs)))

    def _finished(self, m: dict, old: Generation | None, segment: dict | None, gone: DataFrame | None, docs: DataFrame) -> dict:
        """The manifest with document frequencies of terms and the semantic part; those of features are made by Generation.tfidf()."""
        if self.config.bm25:
            new = self._table(segment["tables"]["postings"]) if segment else self._table(m["segments"][0]["tables"]["postings"]).limit(0)
            went = old.live("postings").join(gone, ["item_id", "segment"], "left_semi") if old and gone is not None else None
            m["terms"] = self._write(self._added(old.manifest["terms"] if old else None, new, went, "term"), "terms")
        if self.config.semantic:
            m["semantic"] = self._semantic(m, old, segment, docs)
        return m

    # ---- the semantic part

    def _semantic(self, m: dict, old: Generation | None, segment: dict | None, docs: DataFrame) -> dict:
        """New items are folded into the fit at hand; all is fitted anew where none is or where one is due."""
        printed = _printed(docs)
        if old and old.manifest["semantic"]:
            s = json.loads(json.dumps(old.manifest["semantic"]))
            if not segment:
                return s
            index = old.semantic()
            new = printed.join(self._table(segment["tables"]["documents"]).select("item_id"), "item_id", "left_semi")
            folded, total, kept = self._projected(index, new)
            s["vectors"].append(folded)
            before = next((e for e in s["energy"] if e["kind"] == "folded"), {"kind": "folded", "items": 0, "total": 0.0, "kept": 0.0})
            after = {"kind": "folded", "items": before["items"] + segment["items"], "total": before["total"] + total, "kept": before["kept"] + kept}
            fitted = next(e for e in s["energy"] if e["kind"] == "fitted")
            s["energy"] = [fitted, after]
            if not refit_due(fitted, after):
                return s
        index = SemanticIndex.fit(docs, self.config.semantic)
        vocabularies = {k: self._write(v, f"vocabulary-{k}") for k, v in index.vocabularies.items()}
        components = self._write(index.components, "components")
        index = SemanticIndex(self._table(components), {k: self._table(v) for k, v in vocabularies.items()}, docs.select("item_id"), self.config.semantic)
        vectors, total, kept = self._projected(index, printed)
        return {"components": components, "vocabularies": vocabularies, "vectors": [vectors], "energy": [{"kind": "fitted", "items": m["items"], "total": total, "kept": kept}]}

    def _projected(self, index: SemanticIndex, printed: DataFrame) -> tuple[dict, float, float]:
        """((print, vector, energy) of the different texts, squared lengths of all items' features, what of them the components keep)."""
        each = stored(printed.groupBy(F.col("print").alias("item_id"), "text").agg(F.count("*").alias("copies")), "texts")
        total = index.feature_energy(each)
        vectors = self._write(index.project(each.drop("copies"), energy=True).withColumnRenamed("item_id", "print"), "vectors")
        kept = self._table(vectors).join(each.select(F.col("item_id").alias("print"), "copies"), "print").agg(F.coalesce(F.sum(F.col("energy") * F.col("copies")), F.lit(0.0))).first()[0]
        discard(each)
        return vectors, total, kept

    # ---- merging

    def _merged(self, m: dict) -> dict:
        """Segments of one size class, MERGE at least, as one; segments too much of which is dead written anew."""
        g = Generation(self.spark, self.config, m, self.root)
        dead = {r["segment"]: r["count"] for r in g.dead().groupBy("segment").count().collect()} if m["dead"] else {}  # a row a segment
        classes: dict[int, list[dict]] = {}
        for s in m["segments"]:
            classes.setdefault(int(math.log(max(s["items"] - dead.get(s["name"], 0), 1), MERGE)), []).append(s)
        chosen = next((c for c in classes.values() if len(c) >= MERGE), None) or [s for s in m["segments"] if dead.get(s["name"], 0) > DEAD * s["items"]]
        if not chosen:
            return m
        part = Generation(self.spark, self.config, m | {"segments": chosen}, self.root)
        names = {s["name"] for s in chosen}
        merged = self._sized({t: self._write(in_blocks(part.live(t).drop("segment")) if t == "words" else part.live(t).drop("segment"), t) for t in chosen[0]["tables"]})
        left = [s for s in m["segments"] if s["name"] not in names]
        m = m | {"segments": [*left, *([merged] if merged["items"] else [])]}
        if m["dead"] and dead:
            rest = g.dead().filter(~F.col("segment").isin(*names))
            m["dead"] = self._write(rest, "dead") if set(dead) - names else None
        return m


def refit_due(fitted: dict, folded: dict) -> bool:
    """Whether folded items are too many, or lose too much by the components of the fit."""
    if folded["items"] > FOLDED * fitted["items"]:
        return True
    share = lambda e: e["kept"] / e["total"] if e["total"] else 1.0
    return share(folded) < KEPT * share(fitted)


def _written(root: str, df: DataFrame, name: str) -> dict:
    """df as a table of a collection: the entry of a manifest."""
    path = f"{root}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    return {"path": path, "schema": df.schema.json()}


def _paths(manifest: dict) -> set[str]:
    """All tables of a manifest."""
    found, todo = set(), [manifest]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if "path" in x and "schema" in x:
                found.add(x["path"])
            else:
                todo += x.values()
        elif isinstance(x, list):
            todo += x
    return found


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select("item_id", "text", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("\0"))).alias("print"))


class IndexStore:
    """A folder of collections. root lasts as long as its store does; without one it is a folder of the application's."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{own_dir(spark)}/indices"

    def collection(self, name: str, docs: DataFrame, config: IndexConfig) -> Collection:
        """The collection of what docs' plan gives under a name with these settings; other filters, texts or settings have others."""
        key = hashlib.sha256(f"{plan_mark(docs)} {config.mark()}".encode()).hexdigest()[:16]
        return Collection(self.spark, f"{self.root}/{name}-{key}", config)

    def open(self, name: str, docs: DataFrame, config: IndexConfig) -> Generation:
        """The generation to use for (item_id, text), made or refreshed first if the files have changed."""
        return self.collection(name, docs, config).ensured(docs)

    def bm25(self, name: str, docs: DataFrame, k1: float = 1.5, b: float = 0.75, normalise: bool = True) -> BM25Index:
        return self.open(name, docs, IndexConfig(normalise=normalise)).bm25(k1, b)

    def tfidf(self, name: str, docs: DataFrame, pattern: str) -> TfidfIndex:
        return self.open(name, docs, IndexConfig(bm25=False, pattern=pattern)).tfidf()

    def semantic(self, name: str, docs: DataFrame, config: SemanticConfig | None = None) -> SemanticIndex:
        return self.open(name, docs, IndexConfig(bm25=False, semantic=(config or SemanticConfig()).validate())).semantic()
