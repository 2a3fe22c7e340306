"""Retrieval and behaviour metrics at K, macro averages, candidate coverage, rank shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PersonalizationConfig
from ..functions.scoring import gain


def check_ks(ks: list[int]) -> list[int]:
    if not 1 <= len(ks) <= 10 or not all(1 <= k <= 100 for k in ks):
        raise ValueError("1 to 10 values of k, each 1 to 100")
    return ks


def _ks(df: DataFrame, ks: list[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))


def ideal_dcg(grades: DataFrame, ks: list[int], by: str = "query_id", grade: str = "grade") -> DataFrame:
    """(by, k, idcg) over all judged items, also those below the threshold."""
    best = grades.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(grade))))
    return _ks(best, ks).groupBy(by, "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), gain(F.col(grade), F.col("place")))).alias("idcg"))


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int], threshold: int = 1, digits: int | None = None) -> DataFrame:
    """(query_id, k, precision, recall, mrr, ndcg) of results (query_id, item_id, rank) for all of queries (query_id).

    Precision divides by k; queries without judgements or results are all 0 and stay.
    """
    check_ks(ks)
    judged = results.join(qrels.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    inside = F.col("rank") <= F.col("k")
    good = inside & (F.col("grade") >= threshold)
    per = _ks(judged, ks).groupBy("query_id", "k").agg(F.count_if(good).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))).alias("dcg"))
    relevant = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") >= threshold).alias("relevant"))
    out = _ks(queries.select("query_id").distinct(), ks).join(per, ["query_id", "k"], "left").join(relevant, "query_id", "left").join(ideal_dcg(qrels, ks), ["query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {"precision": zero(F.col("hits") / F.col("k")), "recall": zero(F.try_divide(F.col("hits"), F.col("relevant"))), "mrr": zero(1.0 / F.col("first")), "ndcg": zero(F.try_divide(F.col("dcg"), F.when(F.col("idcg") > 0, F.col("idcg"))))}
    return out.select("query_id", "k", *((F.round(v, digits) if digits else v).alias(n) for n, v in values.items()))


def macro_average(metrics: DataFrame, digits: int | None = None) -> DataFrame:
    """Means over queries by k."""
    names = [c for c in metrics.columns if c not in ("query_id", "request_id", "k")]
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.groupBy("k").agg(*((F.round(mean(c), digits) if digits else mean(c)).alias(c) for c in names))


def flat(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """A row for each query with columns such as precision_at_5."""
    names = [c for c in metrics.columns if c not in ("query_id", "k")]
    return metrics.groupBy("query_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_at_{k}") for c in names for k in ks))


def behaviour_metrics(results: DataFrame, grades: DataFrame, ks: list[int], digits: int | None = None) -> DataFrame:
    """(request_id, k, hit_rate, mrr, ndcg, positive_recall) of results (request_id, item_id, rank); grades (request_id, item_id, grade), positive above 0."""
    check_ks(ks)
    judged = results.join(grades, ["request_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    inside = F.col("rank") <= F.col("k")
    good = inside & (F.col("grade") > 0)
    per = _ks(judged, ks).groupBy("request_id", "k").agg(F.count_if(good).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))).alias("dcg"))
    positive = grades.groupBy("request_id").agg(F.count_if(F.col("grade") > 0).alias("positives"))
    out = per.join(positive, "request_id", "left").join(ideal_dcg(grades, ks, "request_id"), ["request_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {"hit_rate": (F.col("hits") > 0).cast("double"), "mrr": zero(1.0 / F.col("first")), "ndcg": zero(F.try_divide(F.col("dcg"), F.when(F.col("idcg") > 0, F.col("idcg")))), "positive_recall": zero(F.try_divide(F.col("hits"), F.col("positives")))}
    return out.select("request_id", "k", *((F.round(v, digits) if digits else v).alias(n) for n, v in values.items()))


def coverage(eligible: DataFrame, requests: DataFrame, positives: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of candidate coverage. eligible (request_id), requests (request_id, query_id, profile_status), positives (request_id, item_id, grade), candidates (query_id, item_id).

    Requests that are eligible but unknown are skipped, yet stay in the denominator.
    """
    asked = eligible.select("request_id").distinct().join(requests, "request_id", "left").withColumn("known", F.col("query_id").isNotNull())
    wanted = positives.filter("grade > 0").select("request_id", "item_id").distinct()
    found = candidates.select("query_id", "item_id").distinct().withColumn("found", F.lit(1))
    items = asked.join(wanted, "request_id", "left").join(found, ["query_id", "item_id"], "left")
    per = items.groupBy("request_id", "known", "profile_status").agg(F.count("item_id").alias("wanted"), F.count("found").alias("covered"))
    hit, warm = F.col("known") & (F.col("covered") > 0), F.coalesce(F.col("profile_status") == "warm", F.lit(False))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    total, covered = F.coalesce(F.sum(F.when(F.col("known"), F.col("wanted"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("covered"))), F.lit(0))
    return per.agg(
        F.count("*").alias("eligible_positive_request_count"),
        F.count_if(hit).alias("covered_positive_request_count"),
        F.count_if(F.col("known") & ~hit).alias("uncovered_positive_request_count"),
        ratio(F.count_if(hit), F.count("*")).alias("request_level_candidate_positive_coverage"),
        total.alias("total_positive_item_count"),
        covered.alias("covered_positive_item_count"),
        (total - covered).alias("uncovered_positive_item_count"),
        ratio(covered, total).alias("item_level_candidate_positive_recall"),
        ratio(F.count_if(hit & warm), F.count_if(F.col("known") & warm)).alias("warm_request_coverage"),
        ratio(F.count_if(hit & ~warm), F.count_if(F.col("known") & ~warm)).alias("fallback_request_coverage"),
    )


def rank_shifts(base: DataFrame, personal: DataFrame, missing: int = 999) -> DataFrame:
    """(query_id, item_id, base_rank, personal_rank, delta, move): promoted, demoted or same, of the base's items."""
    p = personal.select("query_id", "item_id", F.col("rank").alias("personal_rank"))
    out = base.select("query_id", "item_id", F.col("rank").alias("base_rank")).join(p, ["query_id", "item_id"], "left")
    out = out.withColumn("personal_rank", F.coalesce("personal_rank", F.lit(missing).cast("long"))).withColumn("delta", F.col("base_rank") - F.col("personal_rank"))
    return out.withColumn("move", F.when(F.col("delta") > 0, "promoted").when(F.col("delta") < 0, "demoted").otherwise("same"))


def overlap(base: DataFrame, personal: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap, changed_positions): shared items over k, rounded to 4 places, and how many of the base moved."""
    shifts = rank_shifts(base, personal)
    return shifts.groupBy("query_id").agg(F.round(F.count_if(F.col("personal_rank") != 999) / F.lit(float(k)), 4).alias("overlap"), F.count_if(F.col("delta") != 0).alias("changed_positions"))


def behaviour_grades(events: DataFrame, relevance: dict[str, int] | None = None) -> DataFrame:
    """(request_id, item_id, grade): a request's strongest event with an item, by the settings' grades; other events are 0."""
    relevance = PersonalizationConfig().behavior_relevance if relevance is None else relevance
    grade = F.lit(0)
    for kind, value in relevance.items():
        grade = F.when(F.col("event_type") == kind, value).otherwise(grade)
    return events.groupBy("request_id", "item_id").agg(F.max(grade).cast("long").alias("grade"))


def diagnose(candidates: DataFrame, qrels: DataFrame, grades: DataFrame) -> DataFrame:
    """candidates (query_id, request_id, item_id, …) with qrel_grade and behaviour_grade, 0 where nothing is known."""
    q = qrels.select("query_id", "item_id", F.col("grade").alias("qrel_grade"))
    g = grades.select("request_id", "item_id", F.col("grade").alias("behaviour_grade"))
    out = candidates.join(q, ["query_id", "item_id"], "left").join(g, ["request_id", "item_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("qrel_grade", "behaviour_grade")})
