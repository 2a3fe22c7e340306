"""What streams write, each batch once: a log of events and the state of profiles, both in batches that a manifest commits.

A batch writes its tables under its own number first and then its manifest, a file that names all tables in use. A batch that failed before its manifest leaves tables that nothing names,
and its replay writes them over; one that failed after it finds its number committed and does nothing. So each batch counts once, however
often it comes. A store has one writer, the stream.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import PersonalizationConfig
from ..operators.decayed import ProfileState, merged, observed, profiles_of
from ..operators.events import capture
from ..storage import hadoop, read_text, write_text

#: Parts of the ids and of the profiles; tables of ids that are made one.
BUCKETS, COMPACT = 64, 16


class BatchStore:
    """A folder with numbered batches and their manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def manifest(self) -> dict:
        """The newest manifest; batch is -1 if there is none."""
        fs, path = hadoop(self.spark, self.root)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n[1:-5]) for n in names if n.startswith("b") and n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.root}/b{max(numbers):012d}.json")) if numbers else {"batch": -1}

    def _commit(self, manifest: dict, number: int) -> None:
        write_text(self.spark, f"{self.root}/b{number:012d}.json", json.dumps(manifest | {"batch": number}))

    def _write(self, df: DataFrame, name: str, number: int, *by: str) -> dict:
        path = f"{self.root}/{name}/{number:012d}"
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        return {"path": path, "schema": df.schema.json()}

    def _read(self, entries: list[dict]) -> DataFrame | None:
        tables = [self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(e["path"]) for e in entries]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most


def bucket(column: str):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(BUCKETS)).cast("int")


class EventLog(BatchStore):
    """Captured events, the answers to all that came, and the ids that were seen, by bucket: an id is known however long ago it came."""

    def append(self, new: DataFrame, number: int) -> None:
        """Captures a batch of events; a number that is committed already does nothing. Events that refusal() names are left out."""
        m = self.manifest()
        if number <= m["batch"]:
            return
        came = self._read([self._write(new, "came", number)])  # what a source gives may not come twice the same
        ids = self._read(m.get("ids", []))
        if ids is None:
            known = came.limit(0).select("client_event_id", "event_id")
        else:
            touched = self._touched(came.filter("client_event_id IS NOT NULL").select(bucket("client_event_id").alias("bucket")))
            known = ids.filter(F.col("bucket").isin(touched)).select("client_event_id", "event_id")
        fresh, answers = capture(known, came)
        events = self._write(fresh, "events", number)
        keyed = self._read([events]).filter("client_event_id IS NOT NULL").select("client_event_id", "event_id", bucket("client_event_id").alias("bucket"))
        held = [*m.get("ids", []), self._write(keyed, "ids", number, "bucket")]
        if len(held) >= COMPACT:
            held = [self._write(self._read(held), "ids-compact", number, "bucket")]
        self._commit({"events": [*m.get("events", []), events], "ids": held, "answers": [*m.get("answers", []), self._write(answers, "answers", number)]}, number)

    def events(self) -> DataFrame | None:
        return self._read(self.manifest().get("events", []))

    def answers(self) -> DataFrame | None:
        """(event_id, client_event_id, answered_by) of all events that came."""
        return self._read(self.manifest().get("answers", []))


class ProfileStore(BatchStore):
    """The mergeable state of profiles by bucket of users; a batch writes the buckets of its users anew and reads no older events."""

    def __init__(self, spark: SparkSession, root: str, config: PersonalizationConfig | None = None, half_life: float | None = None):
        super().__init__(spark, root)
        self.config = (config or PersonalizationConfig()).validate()
        self.half_life = self.config.half_life_days if half_life is None else half_life

    def add(self, events: DataFrame, items: DataFrame, number: int) -> None:
        """A batch of events, early or late; a number that is committed already does nothing."""
        m = self.manifest()
        if number <= m["batch"]:
            return
        came = self._read([self._write(events.withColumn("bucket", bucket("user_id")), "came", number)])
        touched = self._touched(came)
        if not touched:
            return self._commit({k: v for k, v in m.items() if k != "batch"}, number)
        state = observed(came.drop("bucket"), items, self.config.event_weights, self.half_life)
        old = self._state(m, touched)
        if old:
            state = merged(old, state, self.half_life)
        written = {}
        for name in ("sums", "counts", "sessions"):
            table = getattr(state, name).withColumn("bucket", bucket("user_id"))
            entry = self._write(table, name, number, "bucket")
            kept = [e | {"buckets": left} for e in m.get(name, []) if (left := [b for b in e["buckets"] if b not in touched])]
            written[name] = [*kept, entry | {"buckets": touched}]
        self._commit(written, number)

    def _state(self, m: dict, buckets: list[int] | None = None) -> ProfileState | None:
        if "sums" not in m:
            return None

        def table(name: str) -> DataFrame | None:
            parts = []
            for e in m[name]:
                wanted = [b for b in e["buckets"] if buckets is None or b in buckets]
                if wanted:
                    parts.append(self._read([e]).filter(F.col("bucket").isin(wanted)).drop("bucket"))
            return reduce(DataFrame.unionByName, parts) if parts else None

        tables = [table(n) for n in ("sums", "counts", "sessions")]
        return ProfileState(*tables) if all(t is not None for t in tables) else None

    def state(self) -> ProfileState | None:
        return self._state(self.manifest())

    def profiles(self, users: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(affinities, summaries) of all events so far."""
        state = self.state()
        if state is None:
            raise LookupError("no batch has come yet")
        return profiles_of(state, users, self.half_life)
