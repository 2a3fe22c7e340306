"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP13_SQL, op13_chat
from .langid import op7_langid
from .lmscore import op8_lmscore
from .media import op1_media
from .merkle import OP12_SQL, op12_merkle
from .mixing import op3_mixing
from .neardup import op2_neardup
from .phrases import OP11_SQL, op11_phrases
from .pieces import op5_pieces
from .secrets import op10_secrets
from .tokencount import op6_tokencount
from .topk import OP9_SQL, op9_topk
from .warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_neardup": op2_neardup,
        "op3_mixing": op3_mixing,
        "op4_warc": op4_warc,
        "op5_pieces": op5_pieces,
        "op6_tokencount": op6_tokencount,
        "op7_langid": op7_langid,
        "op8_lmscore": op8_lmscore,
        "op9_topk": op9_topk,
        "op10_secrets": op10_secrets,
        "op11_phrases": op11_phrases,
        "op12_merkle": op12_merkle,
        "op13_chat": op13_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op9_topk": OP9_SQL, "op11_phrases": OP11_SQL, "op12_merkle": OP12_SQL, "op13_chat": OP13_SQL}
