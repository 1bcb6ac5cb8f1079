import pytest
from pyspark.sql import functions as F

from verdigraph.operators import routing

QUERIES = ["Férias e salário", "Onde está meu pedido?", "nota fiscal XML", "fornecedor na doca com palete", "denúncia de assédio", "LGPD e cookies", "", None, "troca na loja do cliente", "vale transportes e férias férias", "nada disso", "Ouvidoria", "escala 6x1 no banco de horas"]


def rows(df):
    return sorted((r.id, r.query, r.department_key, r.match_score, r.matched_keywords) for r in df.collect())


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, query string")


def large(n):
    """n departments with phrases and words of their own, some shared, some patterns."""
    out = []
    for i in range(n):
        words = [f"palavra{i}", f"frase número {i}", f"tema{i % 50}", "Férias" if i % 1000 == 7 else f"x{i}", f"palavra{i}"]
        out.append((i, f"d{i}", f"D {i}", "", "", "", "", "", "", words, [rf"(?i)\bcod-{i}\b"] if i % 100 == 0 else []))
    return out


def test_same_answers_as_the_literal_catalogue(spark):
    talk = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()]
    queries = asked(spark, QUERIES + talk + [f"{q} {t}" for q, t in zip(QUERIES, talk, strict=False)])
    catalogue = routing.default_catalog(spark)
    want = rows(routing.routed(queries, [r.asDict() for r in catalogue.collect()], "id"))
    assert rows(routing.routed_by_table(queries, catalogue, "id")) == want
    assert len({r[2] for r in want}) == 7


def test_ten_thousand_departments(spark):
    catalogue = spark.createDataFrame(large(10_000), routing.CATALOG_SCHEMA)
    texts = [f"quero a frase numero {i} sobre tema{i % 7}" for i in range(0, 10_000, 97)] + ["COD-300 urgente", "palavra42", "ferias", "", None]
    got = {r.id: r for r in routing.routed_by_table(asked(spark, texts), catalogue, "id").collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(range(0, 10_000, 97)):
        # the phrase of a longer number begins with the phrase of a shorter one, which is found as well
        assert got[k].department_key in {f"d{str(i)[:n]}" for n in range(1, len(str(i)) + 1)} and got[k].match_score >= 2.5
    tail = [got[len(texts) - 5 + j] for j in range(5)]
    assert [(r.department_key, r.match_score) for r in tail] == [("d300", 3.0), ("d42", 2.0), ("d7", 1.0), (routing.FALLBACK, 0.0), (routing.FALLBACK, 0.0)]


@pytest.mark.parametrize("n", [60])
def test_a_middle_sized_catalogue_equals_literals(spark, n):
    catalogue = spark.createDataFrame(large(n), routing.CATALOG_SCHEMA)
    queries = asked(spark, [f"frase numero {i} tema{i % 9} palavra{i * 3} cod-{i}" for i in range(0, 60, 4)] + QUERIES)
    assert rows(routing.routed_by_table(queries, catalogue, "id")) == rows(routing.routed(queries, [r.asDict() for r in catalogue.collect()], "id"))


def test_bounds_and_empty_tables(spark):
    catalogue = spark.createDataFrame(large(30), routing.CATALOG_SCHEMA)
    with pytest.raises(ValueError, match="more than 5 keywords"):
        routing.routed_by_table(asked(spark, ["x"]), catalogue, "id", most_keywords=5)
    assert routing.routed_by_table(asked(spark, []), catalogue, "id").collect() == []
    only = routing.routed_by_table(asked(spark, ["x1"]), catalogue.limit(0), "id").where(F.col("match_score") == 0).collect()
    assert [r.department_key for r in only] == [routing.FALLBACK]
