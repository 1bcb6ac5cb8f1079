"""The jobs as queries, with the SQL of what they leave behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import question_digest, refresh_index
from verdigraph.operators.routing import FALLBACK
from verdigraph.queries import BM25_STEPS, NORMALISED, token_steps

_QUESTION = rf"regexp_replace({NORMALISED}, '\s+', ' ', 'g')"
_SCORES = " UNION ALL ".join(
    f"SELECT question, {i} AS o, '{k}' AS k, " + " + ".join(f"list_contains(string_split(question, ' '), '{w}')::INT" for w in words.split()) + " AS s FROM reps" for i, (k, words) in enumerate(question_digest.DESKS.items())
)

SQL = {
    "job1_refresh_index": f"""WITH {token_steps("documents", "doc_id", "d")},
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM d) GROUP BY token),
posted AS (SELECT doc_id, doc_size, token, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS doc_size, unnest(tokens) AS token FROM d) GROUP BY ALL)
SELECT token, doc_id, tf::BIGINT AS tf, doc_size::BIGINT AS doc_size, df::BIGINT AS df FROM posted JOIN df USING (token)""",
    "job2_question_digest": f"""WITH asked AS (SELECT conv_id, text, {_QUESTION} AS question FROM conversations WHERE role = 'user'),
reps AS (SELECT question, min(text) AS text, count(*) AS n_asked, count(DISTINCT conv_id) AS n_conversations, min(conv_id) AS first_conversation FROM asked WHERE question <> '' GROUP BY question),
desks AS ({_SCORES}),
routed AS (SELECT question, CASE WHEN s > 0 THEN k ELSE '{FALLBACK}' END AS department_key, s::DOUBLE AS match_score FROM desks QUALIFY row_number() OVER (PARTITION BY question ORDER BY s DESC, o) = 1),
{token_steps("documents", "doc_id", "d")},{token_steps("reps", "question", "q")},
{BM25_STEPS.replace("item_id", "question")},
best AS (SELECT question, doc_id AS best_document, round(bm25, 6) AS bm25 FROM scored QUALIFY row_number() OVER (PARTITION BY question ORDER BY round(bm25, 9) DESC, doc_id) = 1),
ranked AS (SELECT r.*, department_key, match_score, row_number() OVER (PARTITION BY department_key ORDER BY n_asked DESC, n_conversations DESC, question COLLATE C) AS place FROM reps r JOIN routed USING (question))
SELECT department_key, question, text, n_asked::BIGINT AS n_asked, n_conversations::BIGINT AS n_conversations, first_conversation, match_score, best_document, bm25, CASE WHEN place <= 20 THEN place END::INT AS place
FROM ranked LEFT JOIN best USING (question)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_refresh_index": refresh_index.query, "job2_question_digest": question_digest.query}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
