"""Limits of requests as columns: a batch of requests is a table, and each row is accepted (null) or named by the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .search import MODES

# The most of top_k and k; queries and values of k of an evaluation; requests of a coverage and candidates of each; characters of ids and texts.
TOP_K, QUERIES, KS, COVERAGE, CANDIDATES, ID, TEXT = 100, 100, 10, 500, 200, 64, 512


def _first(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken; a rule that can't be told is broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules))


def _too_long(c: Column, most: int, needed: bool) -> Column:
    return F.when(c.isNull(), F.lit(needed)).otherwise(F.length(c) > most)


def search_refusal(mode: Column, top_k: Column, personalize: Column, user_id: Column) -> Column:
    """'mode', 'top_k' (1 to 100) or 'user_id' (needed, and not blank, if personalised)."""
    return _first(
        ("mode", ~mode.isin(*MODES)),
        ("top_k", ~top_k.between(1, TOP_K)),
        ("user_id", personalize & (F.trim(F.coalesce(user_id.cast("string"), F.lit(""))) == "")),
    )


def ks_refusal(ks: Column) -> Column:
    """'ks' unless there are 1 to 10, 'k' unless each is 1 to 100."""
    return _first(("ks", ~F.size(ks).between(1, KS)), ("k", F.exists(ks, lambda k: k.isNull() | ~k.between(1, TOP_K))))


def evaluation_refusal(queries: Column, ks: Column) -> Column:
    """'queries' unless there are 1 to 100 of (query_id, query_text), 'query_id' or 'query_text' if one is too long, then ks_refusal; texts may be missing."""
    return F.coalesce(
        _first(
            ("queries", ~F.size(queries).between(1, QUERIES)),
            ("query_id", F.exists(queries, lambda q: _too_long(q["query_id"], ID, True))),
            ("query_text", F.exists(queries, lambda q: _too_long(q["query_text"], TEXT, False))),
        ),
        ks_refusal(ks),
    )


def coverage_refusal(requests: Column) -> Column:
    """'requests' if there are over 500 of (request_id, query_id, candidate_item_ids), the field's name if an id is too long, missing, or there are over 200 candidates."""
    return _first(
        ("requests", requests.isNull() | (F.size(requests) > COVERAGE)),
        ("request_id", F.exists(requests, lambda r: _too_long(r["request_id"], ID, True))),
        ("query_id", F.exists(requests, lambda r: _too_long(r["query_id"], ID, False))),
        ("candidate_item_ids", F.exists(requests, lambda r: F.coalesce((F.size(r["candidate_item_ids"]) > CANDIDATES) | F.exists(r["candidate_item_ids"], lambda i: i.isNull()), F.lit(False)))),
    )
