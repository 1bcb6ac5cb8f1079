"""The whole way from questions to answers, as one plan over a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.rules import confidence_threshold
from verdigraph.functions.text import channel as channel_name
from verdigraph.functions.text import is_greeting
from verdigraph.operators import answering, grounding, hybrid, rendering, routing
from verdigraph.staging import spread, staged

GREETING = "Olá! Como posso ajudar?"


def answered(questions: DataFrame, hits: DataFrame, catalog: list[dict], key: str, threshold=None, channel: str = "chat", organisation: str = "", generate: Callable[[DataFrame], DataFrame] | None = None, searched: DataFrame | None = None) -> DataFrame:
    """One row per question: query, outcome, answer, is_fallback, confidence_score, confidence_threshold, citations,
    sources_used, hallucination_check (is_grounded, reason, of the checked sentences how many, how many that state
    something, and how many of those are supported, and the sentences themselves with their verdicts),
    fallback_department, channel.

    questions: key and query; hits: re-ranked rows (final_rank, rerank_score, chunk_id, file_name, section_title,
    page_start, page_end, text, query). outcome is the first that holds: greeting, no_search_results,
    no_rerank_results, confidence_below_threshold, query_not_grounded, hallucination_detected, passed. All but greeting and passed are
    routed to a department and have no citations. generate: another maker of (key, query, answer, citations,
    supported) from the selected hits; the default is extractive. searched: the
    keys of questions that the search found anything for, where re-ranking can lose all of it. A null question is blank.
    """
    limit = confidence_threshold(threshold)
    name = channel_name(F.lit(channel))
    hits = staged(hits, "answer-hits")  # four branches read them, and what they build on
    top = hits.where("final_rank = 1").select(key, F.col("rerank_score").alias("confidence_score"))
    columns = [c for c in ("rerank_score", "chunk_id", "file_name", "section_title", "page_start", "page_end", "text", "query") if c in hits.columns]
    chosen = hybrid.adaptive_sources(hits.select(key, "final_rank", *columns), key)
    chosen = staged(chosen.select(key, F.explode("sources").alias("s")).select(key, "s.*"), "answer-sources")
    made = (generate or (lambda rows: answering.extracted(rows, key)))(chosen)
    lines = F.transform("citations", lambda c: rendering.citation(name, c["file_name"], c["section_title"], c["page_range"]))
    made = staged(made.withColumns({"parts": rendering.summary_and_details(F.col("answer")), "lines": lines}), "answers")
    context = chosen.groupBy(key).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "file_name", "section_title", "text"))).alias("context"))
    checked = grounding.checked(spread(staged(made.select(key, "answer").join(context, key), "answer-contexts")), key).withColumnRenamed("is_grounded", "answer_grounded")
    fields = ("department_key", "department_name", "responsible", "email", "phone", "channel", "hours", "instructions")
    desks = questions.sparkSession.createDataFrame([tuple(d[c] for c in fields) for d in catalog], ", ".join(f"{c} string" for c in fields))
    messages = desks.select("department_key", rendering.fallback(F.lit(channel), F.struct(*fields), organisation).alias("referral"))  # a row a department
    routes = routing.routed(questions, catalog, key).select(key, "department_key").join(F.broadcast(staged(messages, "answer-referrals")), "department_key", "left")
    used = [c for c in ("chunk_id", "file_name", "section_title", "page_start", "page_end", "rerank_score") if c in columns]
    used = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("final_rank", F.struct(*used).alias("s")))).alias("used"))
    used = used.select(key, F.transform("used", lambda x: x["s"]).alias("sources_used"))
    found = hits.select(key) if searched is None else searched.select(key).unionByName(hits.select(key))
    found = found.distinct().withColumn("searched", F.lit(True))
    out = questions.join(top, key, "left").join(used, key, "left").join(found, key, "left").join(made.select(key, "citations", "supported", "parts", "lines"), key, "left").join(checked, key, "left").join(routes, key)
    query = F.coalesce("query", F.lit(""))
    outcome = (
        F.when(is_greeting(query), "greeting")
        .when(F.col("searched").isNull(), "no_search_results")
        .when(F.col("confidence_score").isNull(), "no_rerank_results")
        .when(F.col("confidence_score") < limit, "confidence_below_threshold")
        .when(~F.coalesce("supported", F.lit(False)), "query_not_grounded")
        .when(~F.coalesce("answer_grounded", F.lit(False)), "hallucination_detected")
        .otherwise("passed")
    )
    out = out.withColumn("outcome", outcome)
    judged = F.col("outcome").isin("passed", "hallucination_detected")
    fell = ~F.col("outcome").isin("greeting", "passed")
    passed = rendering.response(name, F.col("parts")["tldr"], F.col("parts")["details"], F.col("lines"), organisation)
    return out.select(
        key,
        "query",
        "outcome",
        F.when(F.col("outcome") == "greeting", GREETING).when(F.col("outcome") == "passed", passed).otherwise(F.col("referral")).alias("answer"),
        fell.alias("is_fallback"),
        F.when(F.col("outcome") == "greeting", 1.0).otherwise(F.coalesce("confidence_score", F.lit(0.0))).alias("confidence_score"),
        F.lit(limit).alias("confidence_threshold"),
        F.when(F.col("outcome") == "passed", F.col("citations")).otherwise(F.slice("citations", 1, 0)).alias("citations"),
        F.when(F.col("outcome") == "passed", F.col("sources_used")).otherwise(F.slice("sources_used", 1, 0)).alias("sources_used"),
        F.struct(
            F.col("outcome").isin("greeting", "passed").alias("is_grounded"),
            F.when(fell, F.col("outcome")).alias("reason"),
            *(F.when(judged, F.col(c)).otherwise(0).alias(c) for c in ("n_sentences", "n_substantive", "n_grounded")),
            F.when(judged, F.col("sentences")).otherwise(F.array().cast(checked.schema["sentences"].dataType)).alias("sentences"),
        ).alias("hallucination_check"),
        F.when(fell, F.col("department_key")).alias("fallback_department"),
        name.alias("channel"),
    )
