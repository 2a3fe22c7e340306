"""The canonical tables as views of the test tables, in Spark and, by name, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

K1, B = 1.5, 0.75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("category"), F.col("source").alias("brand"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.lit("").alias("description"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("subcategory"), F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "favorite").when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "add_to_cart").when(F.col("event_type") == "purchase", "purchase").otherwise(F.col("event_type"))
    return e.select("event_id", "user_id", kind.alias("event_type"), F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").alias("item_id"), F.col("ts").alias("timestamp"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), (F.col("event_id") % 40).alias("query_id"), F.concat(F.lit("r"), (F.col("event_id") % 997).cast("string")).alias("request_id"), (F.col("event_id") % 10 + 1).alias("position"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in events and three who are not."""
    seen = table(spark, sf_dir, "events").select("user_id").distinct()
    return seen.unionByName(spark.range(-3, 0).withColumnRenamed("id", "user_id")).select("user_id", (F.col("user_id") % 10 == 0).alias("is_cold_start"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements: labelled documents against the passages of the same number modulo 40."""
    labels, p = table(spark, sf_dir, "labels"), passages(spark, sf_dir)
    return labels.join(p, F.col("doc_id") % 40 == F.col("query_id") % 40).select("query_id", F.col("doc_id").alias("item_id"), (1 + F.col("quality") + (1 - F.col("toxic"))).cast("long").alias("grade"))


def shop_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as queries, each by a user."""
    return items(spark, sf_dir).groupBy(F.col("title").alias("query_text")).agg(F.min("item_id").alias("query_id")).select("query_id", "query_text", (F.col("query_id") % 150).alias("user_id"))


def shop_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements: every item for the query of its title."""
    i, q = items(spark, sf_dir), shop_queries(spark, sf_dir)
    return i.join(q, F.col("title") == F.col("query_text")).select("query_id", "item_id", (1 + F.col("item_id") % 3).cast("long").alias("grade"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(x: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"list_filter({found}, lambda t: t NOT IN ({_STOP}))" if stop else found


def _bm25(prefix: str, docs_: str, queries_: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """BM25 over docs_ (item_id, text) for queries_ (query_id, query_text)."""
    p = prefix
    return {
        f"{p}d": ((docs_,), f"SELECT item_id, {tokens_sql('text')} AS toks FROM {docs_}"),
        f"{p}l": ((f"{p}d",), f"SELECT item_id, len(toks) AS dl FROM {p}d"),
        f"{p}st": ((f"{p}l",), f"SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}l"),
        f"{p}p": ((f"{p}d",), f"SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS term FROM {p}d) GROUP BY ALL"),
        f"{p}t": ((f"{p}p",), f"SELECT term, count(*) AS df FROM {p}p GROUP BY term"),
        f"{p}q": ((queries_,), f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query_text')}) AS term FROM {queries_}) GROUP BY ALL"),
        f"{p}s": ((f"{p}q", f"{p}t", f"{p}p", f"{p}l", f"{p}st"), f"SELECT query_id, item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score FROM {p}q JOIN {p}t USING (term) JOIN {p}p USING (term) JOIN {p}l USING (item_id), {p}st GROUP BY ALL"),
        f"{p}bm": ((f"{p}s",), f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {p}s"),
    }


def _tfidf(prefix: str, docs_: str, queries_: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Cosine of word TF-IDF over docs_ (item_id, text) for queries_; n-grams of 1 and 2 words."""
    p = prefix
    grams = lambda w: f"unnest(list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])))"
    return {
        f"{p}fw": ((docs_,), f"SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9]+') AS w FROM {docs_}"),
        f"{p}ftf": ((f"{p}fw",), f"SELECT item_id, feature, count(*) AS tf FROM (SELECT item_id, {grams('w')} AS feature FROM {p}fw) GROUP BY ALL"),
        f"{p}fi": ((f"{p}ftf", docs_), f"SELECT feature, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM {p}ftf, (SELECT count(*) AS n FROM {docs_}) GROUP BY feature, n"),
        f"{p}fx": ((f"{p}ftf", f"{p}fi"), f"SELECT item_id, feature, (1 + ln(tf)) * idf AS weight FROM {p}ftf JOIN {p}fi USING (feature)"),
        f"{p}fn": ((f"{p}fx",), f"SELECT item_id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS weight FROM {p}fx"),
        f"{p}qw": ((queries_,), f"SELECT query_id, regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9]+') AS w FROM {queries_}"),
        f"{p}qx": ((f"{p}qw", f"{p}fi"), f"SELECT query_id, feature, (1 + ln(count(*))) * idf AS weight FROM (SELECT query_id, {grams('w')} AS feature FROM {p}qw) JOIN {p}fi USING (feature) GROUP BY query_id, feature, idf"),
        f"{p}qn": ((f"{p}qx",), f"SELECT query_id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY query_id)) AS qw FROM {p}qx"),
        f"{p}co": ((f"{p}qn", f"{p}fn"), f"SELECT query_id, item_id, round(sum(qw * weight), 6) AS score FROM {p}qn JOIN {p}fn USING (feature) GROUP BY ALL"),
        f"{p}cr": ((f"{p}co",), f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {p}co"),
    }


def _fused(prefix: str, pool: int) -> dict[str, tuple[tuple[str, ...], str]]:
    p = prefix
    norm = lambda s: f"CASE WHEN {s} IS NULL THEN NULL WHEN max({s}) OVER w = min({s}) OVER w THEN 1.0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
    return {
        f"{p}c": ((f"{p}bm", f"{p}cr"), f"SELECT query_id, item_id, b.score AS bm25_score, b.rank AS bm25_rank, s.score AS semantic_score, s.rank AS semantic_rank FROM (SELECT * FROM {p}bm WHERE rank <= {pool}) b FULL JOIN (SELECT * FROM {p}cr WHERE rank <= {pool}) s USING (query_id, item_id)"),
        f"{p}n": ((f"{p}c",), f"SELECT *, {norm('bm25_score')} AS bm25_norm, {norm('semantic_score')} AS semantic_norm FROM {p}c WINDOW w AS (PARTITION BY query_id)"),
        f"{p}f": ((f"{p}n",), f"SELECT *, round(coalesce(bm25_norm, 0) * 0.5 + coalesce(semantic_norm, 0) * 0.5, 6) AS fusion_score FROM {p}n"),
        f"{p}lin": ((f"{p}f",), f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, item_id) AS rank FROM {p}f"),
    }


#: Name: (names it uses, body).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT doc_id AS item_id, text, lang AS category, source AS brand FROM documents"),
    "passages": ((), "SELECT item_id AS query_id, text AS query_text FROM benchmark"),
    "items": ((), "SELECT p_partkey AS item_id, p_name AS title, '' AS description, p_type AS category, CAST(p_size AS VARCHAR) AS subcategory, p_brand AS brand, CAST(p_retailprice AS DECIMAL(12, 2)) AS price FROM part"),
    "itemtext": (("items",), "SELECT item_id, concat_ws(' ', title, title, title, category, category, subcategory, subcategory, brand, brand) AS text FROM items"),
    "shop": (("items",), "SELECT min(item_id) AS query_id, title AS query_text, min(item_id) % 150 AS user_id FROM items GROUP BY title"),
    "ev": ((), """SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'impression' WHEN event_type = 'click' THEN 'click' WHEN event_type = 'signup' THEN 'favorite' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'add_to_cart' ELSE event_type END AS event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id, ts AS timestamp, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_id % 40 AS query_id, 'r' || CAST(event_id % 997 AS VARCHAR) AS request_id, event_id % 10 + 1 AS position FROM events"""),
    "us": ((), "SELECT user_id, user_id % 10 = 0 AS is_cold_start FROM (SELECT DISTINCT user_id FROM events UNION ALL SELECT unnest([-3, -2, -1]))"),
    "qr": (("passages",), "SELECT query_id, doc_id AS item_id, CAST(1 + quality + (1 - toxic) AS BIGINT) AS grade FROM labels JOIN passages ON doc_id % 40 = query_id % 40"),
    **_bm25("", "docs", "passages"), **_tfidf("", "docs", "passages"), **_fused("", 100),
    "qrs": (("items", "shop"), "SELECT s.query_id, i.item_id, CAST(1 + i.item_id % 3 AS BIGINT) AS grade FROM items i JOIN shop s ON s.query_text = i.title"),
    "shopx": (("shop",), "SELECT query_id, query_text FROM shop UNION ALL SELECT -1, '-1'"),
    **_bm25("sx", "itemtext", "shopx"), **_tfidf("sx", "itemtext", "shopx"), **_fused("sx", 100),
    **_bm25("sh", "itemtext", "shop"), **_tfidf("sh", "itemtext", "shop"), **_fused("sh", 50),
    # profiles: half-life H is put in as text
    **{
        f"eff{n}": (("ev", "items"), f"SELECT e.*, i.category, i.subcategory, i.brand, i.price, CASE WHEN i.item_id IS NULL THEN NULL ELSE CASE e.event_type WHEN 'click' THEN 1.0 WHEN 'favorite' THEN 2.0 WHEN 'add_to_cart' THEN 3.0 WHEN 'purchase' THEN 5.0 END * {decay} END AS eff FROM ev e LEFT JOIN items i USING (item_id), (SELECT max(timestamp) AS latest FROM ev) m")
        for n, decay in (("", "1.0"), ("d", "power(0.5, (epoch_us(m.latest) - epoch_us(e.timestamp)) / 86400000000.0 / 30.0)"))
    },
    **{
        f"aff{n}": ((f"eff{n}",), f"SELECT user_id, dim, key, score, score / sum(score) OVER (PARTITION BY user_id, dim) AS weight FROM (SELECT user_id, dim, key, sum(eff) AS score FROM (SELECT user_id, eff, 'category' AS dim, category AS key FROM eff{n} UNION ALL SELECT user_id, eff, 'subcategory', subcategory FROM eff{n} UNION ALL SELECT user_id, eff, 'brand', brand FROM eff{n}) WHERE eff IS NOT NULL AND key <> '' GROUP BY ALL)")
        for n in ("", "d")
    },
    **{
        f"sum{n}": ((f"eff{n}", "us"), f"SELECT user_id, coalesce(is_cold_start, false) AS is_cold_start, coalesce(train, 0) AS train_event_count, coalesce(pos, 0) AS positive_event_count, coalesce(sessions, 0) AS train_session_count, mean_log_price, CASE WHEN coalesce(pos, 0) > 0 THEN 'warm' WHEN coalesce(is_cold_start, false) THEN 'cold_start' WHEN coalesce(train, 0) > 0 THEN 'no_positive' ELSE 'no_history' END AS profile_status FROM us FULL JOIN (SELECT user_id, count(*) AS train, count(eff) AS pos, count(DISTINCT session_id) AS sessions, sum(CASE WHEN price > 0 THEN ln(CAST(price AS DOUBLE)) * eff END) / sum(CASE WHEN price > 0 THEN eff END) AS mean_log_price FROM eff{n} GROUP BY user_id) USING (user_id)")
        for n in ("", "d")
    },
    "rr0": (("shlin", "shop", "items", "sum"), "SELECT query_id, user_id, l.item_id, l.rank AS original_rank, CASE WHEN max(fusion_score) OVER w = min(fusion_score) OVER w THEN 1.0 ELSE (fusion_score - min(fusion_score) OVER w) / (max(fusion_score) OVER w - min(fusion_score) OVER w) END AS retrieval, category, subcategory, brand, CAST(price AS DOUBLE) AS price, profile_status, is_cold_start, mean_log_price FROM (SELECT * FROM shlin WHERE rank <= 20) l JOIN shop USING (query_id) LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN sum s USING (user_id) WINDOW w AS (PARTITION BY query_id, user_id)"),
    "rr1": (("rr0", "aff"), "SELECT r.*, coalesce(c.weight, 0) AS ca, coalesce(u.weight, 0) AS sa, coalesce(b.weight, 0) AS ba, CASE WHEN price > 0 AND mean_log_price IS NOT NULL THEN exp(-abs(ln(price) - mean_log_price) / 0.5) ELSE 0 END AS pa, coalesce(profile_status = 'warm', false) AS warm FROM rr0 r LEFT JOIN aff c ON c.user_id = r.user_id AND c.dim = 'category' AND c.key = r.category LEFT JOIN aff u ON u.user_id = r.user_id AND u.dim = 'subcategory' AND u.key = r.subcategory LEFT JOIN aff b ON b.user_id = r.user_id AND b.dim = 'brand' AND b.key = r.brand"),
    "rr2": (("rr1",), "SELECT *, round(CASE WHEN warm THEN retrieval * 0.7 + ca * 0.12 + sa * 0.06 + ba * 0.06 + pa * 0.06 ELSE retrieval END, 6) AS personalized_score, CASE WHEN profile_status IS NULL THEN 'unknown_user' WHEN is_cold_start THEN 'cold_start_user' WHEN warm THEN 'none' ELSE 'no_profile' END AS fallback_reason FROM rr1"),
    "rr": (("rr2",), "SELECT *, row_number() OVER (PARTITION BY query_id, user_id ORDER BY CASE WHEN warm THEN -personalized_score ELSE 0 END, original_rank, item_id) AS rank FROM rr2"),
}


def sql(select: str, *names: str) -> str:
    """A query over views by name, with all that they use."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    # counts of terms are used several times, and made once
    once = lambda n: " MATERIALIZED" if n.endswith(("ftf", "fi", "fx", "p")) else ""
    return "WITH " + ",\n".join(f"{n} AS{once(n)} ({CTES[n][1]})" for n in order) + f"\n{select}"
