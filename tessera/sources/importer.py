"""Atomic imports: checked, fingerprinted, staged, published by one pointer, and audited.

A data set is written to a folder named by its fingerprint; the file CURRENT names the one in use and is replaced in one step, so a
reader sees the old set or the new. Each import adds a record to the audit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES
from ..storage import hadoop, read_text, write_text
from . import filetree
from .readers import read_raw, read_table, typed
from .validate import REFERENCES, require_valid

#: Order of the checks, and of the writes.
CHECKED = ("items", "users", "queries", "events", "qrels")
WRITTEN = ("users", "items", "queries", "qrels", "events")
AUDIT = "dataset_name string, dataset_fingerprint string, source_path string, status string, item_count long, user_count long, query_count long, event_count long, qrel_count long, started_at string, finished_at string, error_message string"


@dataclass
class ImportResult:
    """status: completed, already_imported, skipped (dry run) or failed."""

    status: str
    fingerprint: str
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def file_hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each of the tables' CSV files, of any size; FileNotFoundError if one is missing or a folder."""
    wanted = sorted(f"{t}.csv" for t in TABLES)
    files = filetree.listed(spark, folder, wanted)
    if missing := sorted(set(wanted) - {n for n, _, _ in files}):
        raise FileNotFoundError(", ".join(missing))
    return filetree.whole(spark, files)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the tables' CSV files, each one file or a folder of parts, read by executors (sources/filetree.py)."""
    return filetree.fingerprint(spark, folder, [f"{t}.csv" for t in TABLES])


class Store:
    """A folder of published data sets. checked has the digests of tables, and of those they refer to, that this store has found valid."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.checked = spark, root.rstrip("/"), set()

    @property
    def current(self) -> str | None:
        return (read_text(self.spark, f"{self.root}/CURRENT") or "").strip() or None

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """Tables (all by default) of the set in use when asked; readers keep that set, and all tables are of one."""
        held = self.current
        if not held:
            raise LookupError("nothing is imported")
        return {name: read_table(self.spark, f"{self.root}/{held}", name) for name in names or TABLES}

    def table(self, name: str) -> DataFrame:
        """A table of the set in use; readers keep the set they began with."""
        return self.tables(name)[name]

    def has_data(self) -> bool:
        return self.current is not None and any(not self.table(t).isEmpty() for t in TABLES)

    def publish(self, name: str) -> None:
        write_text(self.spark, f"{self.root}/CURRENT", name)

    def audit(self) -> DataFrame:
        """Records of imports, latest first."""
        path = f"{self.root}/audit"
        fs, held = hadoop(self.spark, path)
        found = self.spark.read.schema(AUDIT).json(path) if fs.exists(held) else self.spark.createDataFrame([], AUDIT)
        return found.orderBy(F.desc("started_at"))

    def runs(self, limit: int = 20) -> DataFrame:
        return self.audit().limit(limit)

    def latest_completed(self) -> DataFrame:
        return self.audit().filter("status = 'completed'").limit(1)

    def completed(self, fingerprint_: str) -> bool:
        return not self.audit().filter((F.col("status") == "completed") & (F.col("dataset_fingerprint") == fingerprint_)).isEmpty()

    def record(self, **values) -> None:
        write_text(self.spark, f"{self.root}/audit/{uuid.uuid4().hex}.json", json.dumps(values) + "\n")


def import_dataset(store: Store, folder: str, replace: bool = False, dry_run: bool = False, name: str = "dataset") -> ImportResult:
    """Checks all files that the store has not found valid already, and publishes them. Violations raise; other failures are recorded and returned, and leave the set in use as it was."""
    spark, started = store.spark, datetime.now(UTC).isoformat()
    files = filetree.marks(spark, folder, [f"{t}.csv" for t in TABLES])
    mark, own = filetree.digest(files), {t: filetree.digest([f for f in files if f[0].partition("/")[0] == f"{t}.csv"]) for t in TABLES}
    text = {t: read_raw(spark, folder, t) for t in TABLES}
    for t in CHECKED:
        # the same bytes, with the same bytes behind their references, are checked once
        key = (t, own[t], *(own[other] for _, other, _ in REFERENCES.get(t, ())))
        if key not in store.checked:
            require_valid(t, text[t], text)
            store.checked.add(key)
    if dry_run:
        return ImportResult("skipped", mark)
    if store.completed(mark) and store.current and store.current.startswith(mark):
        return ImportResult("already_imported", mark)
    counts: dict[str, int] = {}
    base = {"dataset_name": name, "dataset_fingerprint": mark, "source_path": folder, "started_at": started}
    try:
        if store.has_data() and not replace:
            raise ValueError("the store already contains data")
        target = f"{mark}-{uuid.uuid4().hex[:8]}"
        for t in WRITTEN:
            typed(text[t], t).write.parquet(f"{store.root}/{target}/{t}")
            counts[t] = read_table(spark, f"{store.root}/{target}", t).count()
        store.publish(target)
    except Exception as e:
        store.record(**base, status="failed", finished_at=datetime.now(UTC).isoformat(), error_message=str(e)[:2000])
        return ImportResult("failed", mark, counts, str(e))
    store.record(**base, status="completed", finished_at=datetime.now(UTC).isoformat(), item_count=counts["items"], user_count=counts["users"], query_count=counts["queries"], event_count=counts["events"], qrel_count=counts["qrels"])
    return ImportResult("completed", mark, counts)


def write_report(result: ImportResult, path: str, spark: SparkSession | None = None) -> None:
    """The result as a JSON file."""
    write_text(spark or SparkSession.active(), path, json.dumps(asdict(result), indent=2))
