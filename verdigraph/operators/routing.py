"""Routing of questions to departments by weighted phrases, tokens and patterns."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.functions.text import _listed, catalog_normalized, words
from verdigraph.staging import staged

PHRASE, TOKEN, PATTERN = 2.5, 1.0, 3.0
#: Most distinct keywords of a catalogue that is a table.
MOST_KEYWORDS = 2_000_000
CATALOG_SCHEMA = "ordinal int, department_key string, department_name string, responsible string, email string, phone string, channel string, hours string, instructions string, keywords array<string>, patterns array<string>"

# Tokens that decide between departments: (department, tokens, not with these tokens, bonus).
SUPPLIER = "fornecedor fornecedores doca docas palete conferencia ordem oc".split()
CONSUMER = "cliente comprei consumidor app sac loja casa cdc cupom".split()
BONUSES = [
    ("compras_fornecedores", SUPPLIER, CONSUMER, 3.0),
    ("sac_delivery", CONSUMER, SUPPLIER, 3.0),
    ("fiscal_nfe", "xml danfe sefaz cc cce chave 44".split(), [], 4.0),
    ("juridico_compliance", "denuncia suborno propina assedio corrupcao brinde brindes etica".split(), [], 4.0),
    ("dpo_lgpd", "lgpd dpo privacidade cookies titular anonimizacao".split(), [], 4.0),
]
FALLBACK = "ouvidoria_fallback"
#: A small catalogue to start from; organisations pass their own rows.
DEFAULT = [
    ("rh", "Recursos Humanos", "salario|ferias|ponto|beneficio|vale transporte|folha de pagamento|banco de horas", r"\b[56]x[12]\b"),
    ("sac_delivery", "Atendimento ao Cliente", "entrega|pedido|troca|reembolso|cupom|frete gratis", r"(?i)\bmeu pedido\b"),
    ("fiscal_nfe", "Fiscal", "nota fiscal|nfe|xml|danfe|imposto", r"(?i)\bnf-?e\b"),
    ("compras_fornecedores", "Compras", "fornecedor|ordem de compra|doca|palete", r"(?i)\bfornecedor(es)?\b"),
    ("juridico_compliance", "Jurídico e Compliance", "denuncia|assedio|contrato|codigo de etica", r"(?i)\bden[uú]ncia\b"),
    ("dpo_lgpd", "Proteção de Dados", "lgpd|privacidade|dados pessoais|cookies", r"(?i)\blgpd\b"),
    (FALLBACK, "Ouvidoria", "ouvidoria|reclamacao geral", r"(?i)\bouvidoria\b"),
]


def default_catalog(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (key, name, keywords, pattern) in enumerate(DEFAULT):
        rows.append((i, key, name, f"Equipe de {name}", f"{key}@example.com", "0800-000-0000", "E-mail", "Dias úteis", "Escreva à equipe.", keywords.split("|"), [pattern]))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def keyword_score(query: Column, tokens: Column, keywords: Column) -> Column:
    """Points for normalised keywords: phrases as substrings, single words as tokens; repeated keywords count again."""
    norm = F.transform(keywords, catalog_normalized)
    points = lambda k: F.when(F.contains(k, F.lit(" ")), F.when(F.contains(query, k), PHRASE).otherwise(0.0)).otherwise(F.when(F.array_contains(tokens, k), TOKEN).otherwise(0.0))
    return F.aggregate(F.transform(norm, points), F.lit(0.0), lambda a, x: a + x)


def matched(query: Column, tokens: Column, keywords: Column) -> Column:
    """The keywords that gave points, in their order."""
    hit = lambda k: F.when(F.contains(k, F.lit(" ")), F.contains(query, k)).otherwise(F.array_contains(tokens, k))
    return F.filter(keywords, lambda k: hit(catalog_normalized(k)))


def routed(queries: DataFrame, catalog: list[dict], query_key: str, query: str = "query") -> DataFrame:
    """(query_key, query, department_key, match_score, matched_keywords) of every query.

    catalog: rows of CATALOG_SCHEMA as dictionaries; a catalogue is configuration, so it becomes literals of the plan
    and every query is scored where it stands. The best score wins, the first of equal ones; without a score above 0,
    and for blank and null queries, it is the fallback with score 0.
    """
    raw = F.trim(F.coalesce(F.col(query), F.lit("")))
    out = queries.withColumn("__norm", catalog_normalized(raw)).withColumn("__tokens", words(F.col("__norm")))
    norm, tokens = F.col("__norm"), F.col("__tokens")
    overlap = lambda values: F.arrays_overlap(tokens, _listed(values)) if values else F.lit(False)
    scored = []
    for d in sorted(catalog, key=lambda d: d["ordinal"]):
        score = keyword_score(norm, tokens, _listed(d["keywords"]))
        for p in d["patterns"]:
            score = score + F.when(raw.rlike(p) | norm.rlike(p), PATTERN).otherwise(0.0)
        for key, wanted, without, bonus in BONUSES:
            if key == d["department_key"]:
                score = score + F.when(overlap(wanted) & ~overlap(without), bonus).otherwise(0.0)
        scored.append(F.struct(score.alias("score"), F.lit(-d["ordinal"]).alias("order"), F.lit(d["department_key"]).alias("key"), matched(norm, tokens, _listed(d["keywords"])).alias("matched")))
    out = out.withColumn("__best", F.array_max(F.array(*scored)))
    hit = F.col("__best")["score"] > 0
    return out.select(
        query_key,
        query,
        F.when(hit, F.col("__best")["key"]).otherwise(FALLBACK).alias("department_key"),
        F.when(hit, F.col("__best")["score"]).otherwise(0.0).alias("match_score"),
        F.when(hit, F.col("__best")["matched"]).otherwise(F.array().cast("array<string>")).alias("matched_keywords"),
    )




class _Catalogue:
    """What tasks need of a large catalogue: one automaton over all phrases, the single words, and the patterns."""

    def __init__(self, keywords: list[str], patterns: list[tuple[str, str]]) -> None:
        self.phrases = [k for k in keywords if " " in k]
        self.words = frozenset(k for k in keywords if k and " " not in k)
        self.patterns = patterns
        self.empty = "" in keywords

    def search(self):
        """A function from (norm, raw) to the keywords found and the departments whose patterns match, with repeats."""
        automaton = ahocorasick.Automaton()
        for k in self.phrases:
            automaton.add_word(k, k)
        if self.phrases:
            automaton.make_automaton()
        patterns = [(d, re.compile(p)) for d, p in self.patterns]

        def found(norm: str, raw: str) -> tuple[list[str], list[str]]:
            hits = set(norm.split()) & self.words
            if self.phrases:
                hits.update(k for _, k in automaton.iter(norm))
            return sorted(hits), [d for d, p in patterns if p.search(raw) or p.search(norm)]

        return found


def routed_by_table(queries: DataFrame, catalogue: DataFrame, query_key: str, query: str = "query", most_keywords: int = MOST_KEYWORDS) -> DataFrame:
    """As `routed`, for a catalogue of any number of departments: rows of CATALOG_SCHEMA as a table.

    Its distinct keywords, at most most_keywords of them, and its patterns go to the tasks as one automaton; a query is
    searched once for all departments, and what it holds meets the keywords' departments by a join. Patterns are tested
    one by one. query_key values are distinct.
    """
    spark = queries.sparkSession
    rows = catalogue.select("ordinal", "department_key", F.posexplode("keywords").alias("place", "word")).withColumn("keyword", catalog_normalized(F.col("word")))
    rows = staged(rows, "catalogue-keywords")
    distinct = rows.select("keyword").distinct()
    if distinct.count() > most_keywords:
        raise ValueError(f"more than {most_keywords} keywords")
    known = sorted(r[0] for r in distinct.collect())
    patterns = [(r[0], r[1]) for r in catalogue.select("department_key", F.explode("patterns")).collect()]
    sent = spark.sparkContext.broadcast(_Catalogue(known, patterns))
    raw = F.trim(F.coalesce(F.col(query), F.lit("")))
    asked = staged(queries.select(query_key, query, raw.alias("__raw"), catalog_normalized(raw).alias("__norm")), "routed-queries")
    schema = T.StructType([queries.schema[query_key], *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("keywords", "departments"))])

    def look(batches):
        search = sent.value.search()
        for batch in batches:
            found = [search(n, r) for n, r in zip(batch.column("__norm").to_pylist(), batch.column("__raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(query_key), *(pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1))], names=schema.names)

    met = staged(asked.select(query_key, "__norm", "__raw").mapInArrow(look, schema), "catalogue-hits")
    words_met = met.select(query_key, F.explode("keywords").alias("keyword")).join(rows, "keyword")
    points = words_met.select(query_key, "department_key", F.when(F.col("keyword").contains(" "), PHRASE).otherwise(TOKEN).alias("points"), F.struct("place", "word").alias("hit"))
    none = F.lit(None).cast(points.schema["hit"].dataType)
    points = points.unionByName(met.select(query_key, F.explode("departments").alias("department_key")).select(query_key, "department_key", F.lit(PATTERN).alias("points"), none.alias("hit")))
    for key, wanted, without, bonus in BONUSES:
        tokens = words(F.col("__norm"))
        has = F.arrays_overlap(tokens, _listed(wanted)) & (~F.arrays_overlap(tokens, _listed(without)) if without else F.lit(True))
        points = points.unionByName(asked.where(has).select(query_key, F.lit(key).alias("department_key"), F.lit(bonus).alias("points"), none.alias("hit")))
    scored = points.groupBy(query_key, "department_key").agg(F.sum("points").alias("score"), F.array_sort(F.collect_list("hit")).alias("hits"))
    scored = scored.join(catalogue.select("department_key", "ordinal"), "department_key")
    best = scored.groupBy(query_key).agg(F.max(F.struct("score", (-F.col("ordinal")).alias("order"), "department_key", F.transform("hits", lambda h: h["word"]).alias("matched"))).alias("best"))
    out = asked.select(query_key, query).join(best, query_key, "left")
    hit = F.coalesce(F.col("best")["score"] > 0, F.lit(False))
    return out.select(
        query_key,
        query,
        F.when(hit, F.col("best")["department_key"]).otherwise(FALLBACK).alias("department_key"),
        F.when(hit, F.col("best")["score"]).otherwise(0.0).alias("match_score"),
        F.when(hit, F.col("best")["matched"]).otherwise(F.array().cast("array<string>")).alias("matched_keywords"),
    )
