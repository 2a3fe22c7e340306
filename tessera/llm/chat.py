"""Chat formatting: layouts told by the hash of their field paths, mapped to turns, written by a template that texts can't break.

A record is a JSON object in one of several layouts (a prompt with its completion, an instruction with its output, lists of messages). Its nested field paths
(lists as []) that any mapping names are hashed; the hash selects a declarative mapping (MAPPINGS), which says where turns, roles and
texts are. The same hashes tell a typed table's layout from its schema.

A template marks turns with control strings. In texts and roles, a control string, or one whose first character is followed by backslashes, gets one more backslash there, so control strings
without a backslash are the template's alone, and taking one away gives the text back. The loss mask holds the code points of assistant texts, marks left out.

Defined results: null roles and texts are empty; turns stand by turn (null first), then by role and text; rows with a null conv_id are one conversation; fields that no mapping names are ignored;
a record that is no JSON object, or whose paths are those of no mapping or of two, has a null layout and no turns; values that are no text are
written as JSON; an empty table gives no rows. A conversation has to fit in a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import mapped, table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class One:
    """A turn of a fixed role from one field, or several joined by blank lines; without optional fields, or with those empty, there is no part."""

    role: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list; roles renames."""

    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns, in the order of its rules."""

    name: str
    rules: tuple[One | Each, ...]

    def needed(self) -> set[str]:
        return {p for r in self.rules for p in ((f"{r.items}[].{r.role}", f"{r.items}[].{r.text}") if isinstance(r, Each) else [f for f in r.fields if f not in r.optional])}

    def optional(self) -> set[str]:
        return {f for r in self.rules if isinstance(r, One) for f in r.optional}

    def fingerprints(self) -> set[str]:
        """Hashes of all sets of paths that this mapping takes: with or without optional fields, lists with elements or without."""
        more = sorted(self.optional())
        sets = [self.needed() | set(c) for c in chain.from_iterable(combinations(more, k) for k in range(len(more) + 1))]
        if any(isinstance(r, Each) for r in self.rules):
            hollow = {f"{r.items}[]" for r in self.rules if isinstance(r, Each)} | {p for p in self.needed() if "[]" not in p}
            sets += [hollow | set(c) for c in chain.from_iterable(combinations(more, k) for k in range(len(more) + 1))]
        return {fingerprint(s) for s in sets}


MAPPINGS = (
    Mapping("messages", (One("system", ("system",), ("system",)), Each("messages", "role", "content"))),
    Mapping("from_value", (One("system", ("system",), ("system",)), Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}))),
    Mapping("instruction", (One("system", ("system",), ("system",)), One("user", ("instruction", "input"), ("input",)), One("assistant", ("output",)))),
    Mapping("prompt", (One("system", ("system",), ("system",)), One("user", ("prompt",)), One("assistant", ("completion",)))),
)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def paths_of(value: Any, at: str = "") -> set[str]:
    """Paths of a record's leaves. Null is a leaf, and so are an empty list's and object's places."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    """The same of a type."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else {at}


class Layouts:
    """Mappings by fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.by: dict[str, Mapping] = {}
        for m in mappings:
            for f in m.fingerprints():
                if f in self.by:
                    raise ValueError(f"{m.name} and {self.by[f].name} take the same fields")
                self.by[f] = m
        named = {p for m in mappings for p in m.needed() | m.optional()}
        self.named = named | {p.partition(".")[0] for p in named if "[]." in p}
        self._seen: dict[frozenset[str], Mapping | None] = {}

    def of(self, paths: set[str]) -> Mapping | None:
        """The mapping of a record's paths, those that no mapping names left out."""
        key = frozenset(paths & self.named)
        if key not in self._seen:
            if len(self._seen) > 10_000:
                self._seen.clear()
            self._seen[key] = self.by.get(fingerprint(key))
        return self._seen[key]

    def turns(self, record: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
        """(layout, turns) of a JSON text."""
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        m = self.of(paths_of(value)) if isinstance(value, dict) and value else None
        return (m.name, list(chain.from_iterable(_rule(r, value) for r in m.rules))) if m else (None, None)


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _rule(rule: One | Each, value: dict) -> Iterator[tuple[str, str]]:
    if isinstance(rule, Each):
        for x in value[rule.items]:
            role = _text(x.get(rule.role)) if isinstance(x, dict) else ""
            yield rule.roles.get(role, role), _text(x.get(rule.text)) if isinstance(x, dict) else ""
    else:
        parts = [_text(value[f]) for f in rule.fields if f not in rule.optional or value.get(f) not in (None, "")]
        if parts:
            yield rule.role, "\n\n".join(parts)


@dataclass(frozen=True)
class Template:
    """begin role middle text end, a turn; all of these and reserved are control strings. trained: the role whose texts bear loss."""

    begin: str = "<s>"
    middle: str = "[/ROLE]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    trained: str = "assistant"

    def __post_init__(self):
        first = {c[:1] for c in self.controls}
        if "\\" in "".join(self.controls) or "" in first or any(x in c[1:] for c in self.controls for x in first):
            raise ValueError("a control string holds a backslash, or another's first character after its own")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.middle, self.end, *self.reserved)

    def _pattern(self, slash: str) -> re.Pattern:
        return re.compile("|".join(f"(?<={re.escape(c[0])}){slash}(?=\\\\*{re.escape(c[1:])})" for c in sorted(set(self.controls))))

    def escape(self, text: str) -> str:
        return self._pattern("").sub(r"\\", text) if any(c[0] in text for c in self.controls) else text

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\").sub("", text) if "\\" in text else text

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and where (code points, end excluded) what is learnt stands in it."""
        out, at, mask = [], 0, []
        for role, text in turns:
            head, body = f"{self.begin}{self.escape(role)}{self.middle}", self.escape(text)
            at += len(head)
            if role == self.trained:
                mask.append((at, at + len(body)))
            at += len(body) + len(self.end)
            out += [head, body, self.end]
        return "".join(out), mask

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns, at = [], 0
        while at < len(text):
            middle = text.find(self.middle, at)
            end = text.find(self.end, middle)
            if not text.startswith(self.begin, at) or middle < 0 or end < 0:
                raise ValueError("no turn of this template")
            turns.append((self.unescape(text[at + len(self.begin) : middle]), self.unescape(text[middle + len(self.middle) : end])))
            at = end + len(self.end)
        return turns


def _with(df: DataFrame, fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """df with more columns, made of a row's values by make(batch) as lists."""
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [pa.array(list(c), kind) for c, (_, kind, _) in zip(make(b), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *(n for n, _, _ in fields)])

    schema = StructType(df.schema.fields + StructType.fromDDL(", ".join(f"{n} {ddl}" for n, _, ddl in fields)).fields)
    return mapped(df, run, schema)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _pairs(column: pa.Array) -> list[list[tuple[str, str]] | None]:
    return [None if ts is None else [(t["role"], t["text"]) for t in ts] for ts in column.to_pylist()]


def canonical(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout and turns (TURNS) of their JSON texts."""
    layouts = Layouts(mappings)

    def make(b: pa.RecordBatch):
        found = [layouts.turns(r) for r in b.column(column).to_pylist()]
        return [f[0] for f in found], [None if f[1] is None else [{"role": r, "text": t} for r, t in f[1]] for f in found]

    return _with(records, [("layout", pa.string(), "string"), ("turns", _TURNS, TURNS)], make)


def _turn_columns(rule: One | Each, columns: list[str]) -> Column | None:
    """A rule's turns as a column; None if the table has none of its fields."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    none = F.array().cast(TURNS)
    if isinstance(rule, Each):

        def turn(x: Column) -> Column:
            role = text(x[rule.role])
            renamed = F.coalesce(*(F.when(role == a, F.lit(b)) for a, b in rule.roles.items()), role)
            return F.struct(renamed.alias("role"), text(x[rule.text]).alias("text"))

        return F.coalesce(F.transform(rule.items, turn), none)
    given = [f for f in rule.fields if f in columns]
    if not given:
        return None
    parts = [F.nullif(F.col(f).cast("string"), F.lit("")) if f in rule.optional else text(F.col(f)) for f in given]
    one = F.array(F.struct(F.lit(rule.role).alias("role"), F.concat_ws("\n\n", *parts).alias("text")))
    return F.when(F.coalesce(*parts).isNotNull(), one).otherwise(none)  # all optional and empty: no turn


def canonical_table(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with layout and turns; its layout is told by its schema."""
    found = Layouts(mappings).of(schema_paths(df.schema))
    if found is None:
        return df.withColumns({"layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)})
    parts = [c for c in (_turn_columns(r, df.columns) for r in found.rules) if c is not None]
    return df.withColumns({"layout": F.lit(found.name), "turns": F.concat(*parts)})


def formatted(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """rows (with turns) with formatted and mask, the code points (begin, end) of texts under loss; null where turns is."""
    template = template or Template()
    mask = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def make(b: pa.RecordBatch):
        out = [(None, None) if t is None else template.format(t) for t in _pairs(b.column("turns"))]
        return [o[0] for o in out], [None if o[1] is None else [{"begin": x, "end": y} for x, y in o[1]] for o in out]

    return _with(rows, [("formatted", pa.string(), "string"), ("mask", mask, "array<struct<begin:bigint,end:bigint>>")], make)


def read_back(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """rows (formatted, mask) with turns_read, the template's turns, and loss_text, what the mask covers, both with their escapes taken away."""
    template = template or Template()

    def make(b: pa.RecordBatch):
        texts, masks = b.column("formatted").to_pylist(), b.column("mask").to_pylist()
        turns = [None if t is None else [{"role": r, "text": x} for r, x in template.parse(t)] for t in texts]
        return turns, [None if t is None else "".join(template.unescape(t[s["begin"] : s["end"]]) for s in m) for t, m in zip(texts, masks, strict=True)]

    return _with(rows, [("turns_read", _TURNS, TURNS), ("loss_text", pa.string(), "string")], make)


def records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): conversations of (conv_id, turn, role, text) as JSON in the layout that holds their roles; those that fit several take one by their id's hash."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.array_join("t.role", "\n"), lambda k: F.element_at("t.text", k)
    even = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    plain = F.forall("t.role", lambda r: r.isin("user", "assistant", "system"))
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    json_ = lambda *fields: F.to_json(F.struct(F.col("conv_id").alias("id"), *fields))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    shared = F.transform("t", lambda x: F.struct(named(x["role"]).alias("from"), x["text"].alias("value")))
    record = F.when((roles == "user\nassistant") & even, json_(text(1).alias("prompt"), text(2).alias("completion")))
    record = record.when(roles == "user\nassistant", json_(text(1).alias("instruction"), text(2).alias("output")))
    record = record.when((roles == "system\nuser\nassistant") & (text(1) != ""), json_(text(1).alias("system"), text(2).alias("instruction"), text(3).alias("output")))
    record = record.when(plain & even, json_(shared.alias("conversations"))).otherwise(json_(messages.alias("messages")))
    return c.select("conv_id", record.alias("record"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings, through records of several layouts, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    asked = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*(F.col(f.name).cast(f.dataType) for f in asked.schema)).unionByName(asked)
    back = read_back(formatted(canonical(records(rows)).select("conv_id", "turns")).select("conv_id", "formatted", "mask"))
    lines = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP13_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '(<|\\[)(\\\\*(/?s>|/?INST\\]|/ROLE\\]))', '\\1\\\\\\2', 'g'))
          + length(regexp_replace(text, '(<|\\[)(\\\\*(/?s>|/?INST\\]|/ROLE\\]))', '\\1\\\\\\2', 'g')) + 14 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
