import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.operators import answering, chunking, dense, grounding, hybrid, rendering, routing, sparse
from verdigraph.plans import answer as plan
from verdigraph.sources import documents as store
from verdigraph.streaming.ingest import upsert_stream


def test_pages_and_sections(spark):
    raw = spark.createDataFrame([("a.pdf", "Capa\n\f  \f1. Objetivo\nTexto um.\n\nMais.\fSegue aqui.\n# Fim\nx")], "file_name string, raw string")
    pages = store.pages(raw)
    assert [r.page_num for r in pages.orderBy("page_num").collect()] == [1, 3, 4]
    got = [tuple(r)[2:] for r in chunking.sections(pages).orderBy("section_no").collect()]
    assert got == [("Introdução / Cabeçalho", "Capa", 1, 1), ("1. Objetivo", "1. Objetivo\nTexto um.\n\nMais.\nSegue aqui.", 3, 4), ("# Fim", "# Fim\nx", 4, 4)]


def packed(text, max_chars, overlap):
    """The packing, step by step."""
    if len(text) <= max_chars:
        return [text]
    step = max(1, max_chars - overlap - (2 if max_chars > overlap + 2 else 0))
    parts = []
    for p in text.split("\n\n"):
        parts += [p] if len(p) <= max_chars else [x.strip() for x in (p[i : i + step] for i in range(0, len(p), step)) if x.strip()]
    out, now = [], ""
    for p in parts:
        if not now or len(now) + len(p) + 2 <= max_chars:
            now = f"{now}\n\n{p}" if now else p
            continue
        out.append(now)
        room = max(0, min(overlap, max_chars - 2 - len(p)))
        tail = now[-room:] if len(now) > overlap and room else ""
        now = f"{tail}\n\n{p}".strip() if tail else p
    return out + [now] if now else out


@pytest.mark.parametrize(("max_chars", "overlap"), [(1200, 200), (500, 100), (60, 20), (50, 100)])
def test_chunks_against_the_packing_step_by_step(spark, max_chars, overlap):
    rng = np.random.default_rng(1)
    texts = ["\n\n".join("".join(rng.choice(list("abc de ")) for _ in range(int(rng.integers(1, 90)))) for _ in range(12)) for _ in range(8)]
    texts += ["x" * 3000, "curto", "a" * 49 + "\n\n" + "b" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", chunking.pieces(F.col("t"), max_chars, overlap).alias("p")).collect():
        assert r.p == packed(texts[r.i], max_chars, overlap)


def test_chunk_rows(spark):
    sections = spark.createDataFrame([("b.pdf", 0, "T", "um dois", 1, 2), ("b.pdf", 1, "U", "três", 2, 2), ("c.pdf", 0, "V", "x", 1, 1)], "file_name string, section_no int, title string, text string, page_start int, page_end int")
    dim = spark.createDataFrame([("b.pdf", "Norma", "RH", "2025")], "file_name string, category string, department_author string, last_updated string")
    got = {r.chunk_id: r for r in chunking.chunks(sections, dim).collect()}
    assert set(got) == {"b_CHK_001", "b_CHK_002", "c_CHK_001"}
    assert (got["b_CHK_001"].word_count, got["b_CHK_001"].char_count, got["b_CHK_001"].category) == (2, 7, "Norma")
    assert (got["c_CHK_001"].category, got["c_CHK_001"].last_updated) == ("Geral", "2026")


def test_store(spark, tmp_path):
    rows = [("1", "a"), ("2", "b"), ("2", "c"), (None, "d"), ("3", None)]
    new = spark.createDataFrame(rows, "chunk_id string, text string")
    old = spark.createDataFrame([("2", "old"), ("9", "keep")], "chunk_id string, text string")
    assert sorted(map(tuple, store.upserted(old, new).collect())) == [("1", "a"), ("2", "c"), ("9", "keep")]
    with pytest.raises(ValueError):
        store.batch_size(0)
    assert store.batch_size(-3) == 0
    store.write_chunk_array(old, str(tmp_path / "array"))
    (part,) = (tmp_path / "array").glob("part-*")
    assert json.loads(part.read_text()) == [{"chunk_id": "2", "text": "old"}, {"chunk_id": "9", "text": "keep"}]
    assert sorted(r.chunk_id for r in store.read_chunks(spark, str(part)).collect()) == ["2", "9"]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        store.read_chunks(spark, str(tmp_path / "bad.json")).collect()
    assert store.read_pdfs(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "x.pdf").write_bytes(b"one\ftwo")
    files = store.read_pdfs(spark, str(tmp_path), lambda b: b.decode())
    assert [r.text for r in store.pages(files).orderBy("page_num").collect()] == ["one", "two"]


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "chunk_id string, text string"
    for i, rows in enumerate(([("1", "a"), ("2", "b")], [("2", "new"), ("3", "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    from verdigraph.streaming.ingest import read_store

    assert sorted(map(tuple, read_store(spark, str(tmp_path / "store")).collect())) == [("1", "a"), ("2", "new"), ("3", "c")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"]), (3, ["d"])], "id int, tokens array<string>")
    asked = spark.createDataFrame([(0, ["c", "c", "d"]), (1, ["zz"])], "q int, tokens array<string>")
    got = {(r.q, r.id): r.bm25 for r in sparse.scores(asked, docs, "q", "id").collect()}
    idf = lambda df: np.log(3 - df + 0.5) - np.log(df + 0.5)
    raw = [idf(2), idf(1), idf(1), idf(1)]
    assert got == {
        (0, 2): pytest.approx(2 * idf(1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))),
        (0, 3): pytest.approx(idf(1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / 2))),
    }
    weights = {r.token: r.idf for r in sparse.idf(docs).collect()}
    assert weights["a"] == pytest.approx(0.25 * np.mean(raw))
    over = {(r.q, r.id): r.overlap for r in sparse.overlap_scores(asked, docs, "q", "id").collect()}
    assert over == {(0, 2): 2 / 4, (0, 3): 1 / 2}
    assert sparse.top(sparse.scores(asked, docs, "q", "id"), "q", "id", F.col("bm25"), 0).count() == 0


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, embedding array<double>").repartition(5)
    for block in (1024, 3):
        got = {}
        for r in dense.cosine_top(df.where("id < 10").withColumnRenamed("id", "q"), df, "q", "id", 4, block=block).collect():
            got.setdefault(r.q, []).append((r["rank"], r.id))
        sim = np.clip(np.nan_to_num(x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))), 0, 1)
        for q in range(10):
            want = sorted(range(60), key=lambda i, q=q: (-round(sim[q, i], 9), i))[:4]
            assert [i for _, i in sorted(got[q])] == want
    with pytest.raises(ValueError):
        dense.cosine_top(df, df, "id", "id", 0)
    assert dense.cosine_top(df.limit(0).withColumnRenamed("id", "q"), df, "q", "id", 3).collect() == []


def test_embeddings(spark):
    a, b = dense.hash_embedding("Alpha beta"), dense.hash_embedding("beta  ALPHA ")
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and len(a) == 768
    assert np.isclose(np.linalg.norm(dense.hash_embedding("")), 1)
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")

    def broken(texts):
        raise OSError("no network")

    assert dense.embedded(df, "id", dim=4, embed=broken).count() == 2
    assert [r.embedding for r in dense.embedded(df, "id", dim=2, embed=lambda t: [[1, 2]] * len(t)).collect()] == [[1, 2], [1, 2]]


def hit(i, rank, score, file="f", text="t", title="s", **more):
    return {"q": 1, "id": i, "final_rank": rank, "rerank_score": score, "file_name": file, "text": text, "section_title": title, "query": "prazo de entrega", "chunk_id": f"c{i}", "page_start": 1, "page_end": 1, **more}


def test_fusion_and_filters(spark):
    d = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.4)], "q int, id int, dense_score double")
    s = spark.createDataFrame([(1, 11, 1.0), (1, 12, 0.5), (1, 99, 1.0)], "q int, id int, sparse_score double")
    chunks = spark.createDataFrame([(10, "2024-01-01"), (11, "2026-01-01"), (12, None)], "id int, moment string").withColumn("moment", F.col("moment").cast("timestamp_ntz"))
    plain = {r.id: r for r in hybrid.fused(d, s, chunks, "q", "id").collect()}
    assert {i: r.hybrid_score for i, r in plain.items()} == {10: 0.4, 11: 0.7, 12: 0.25}
    assert [plain[i].recency_score for i in (10, 11, 12)] == [0.0, 1.0, 0.0]
    boosted = [(r.id, r.hybrid_score) for r in hybrid.fused(d, s, chunks, "q", "id", boost=True, weight=0.2, k=2).orderBy("rank").collect()]
    assert boosted == [(11, 0.9), (10, 0.4)]
    df = spark.createDataFrame([("a", None), (None, {"category": "a"}), (None, None), ("b", {"category": "a"})], "category string, metadata map<string,string>")
    assert [r[0] for r in df.select(hybrid.matches(df.columns, {"category": "a"})).collect()] == [True, True, False, False]


def test_reranking(spark):
    rows = [(1, "prazo ia", "texto do prazo", "Inteligencia", "manual", 0.8), (2, "prazo ia", "nada", "prazo", "prazo.pdf", 0.8)]
    df = spark.createDataFrame(rows, "id int, query string, text string, section_title string, file_name string, hybrid_score double").withColumn("q", F.lit(1))
    got = {r.id: r.rerank_score for r in hybrid.feature_fusion(df, "q", "id").collect()}
    # words: prazo, ia, inteligencia, artificial; "artificial" holds no other word, "ia" stands in inteligencia
    assert got == {1: round(0.36 + 0.25 * 2 / 4 + 0.2 * 1 / 4, 4), 2: round(0.36 + 0.25 * 1 / 4 + 0.1 * 1 / 4, 4)}
    two = df.withColumn("dense_score", F.col("id") * 0.1)
    assert {r.id: r.rerank_score for r in hybrid.reciprocal_rank_fusion(two, "q", "id").collect()} == {1: round(1 / 62 + 1 / 61, 6), 2: round(1 / 61 + 1 / 62, 6)}
    with pytest.raises(ZeroDivisionError):
        hybrid.reciprocal_rank_fusion(two, "q", "id", rrf_k=-1)
    crossed = hybrid.cross_encoded(df, "q", "id", lambda q, t: [float(len(x)) for x in t]).orderBy("final_rank").collect()
    assert [r.id for r in crossed] == [1, 2] and crossed[1].rerank_score == round(1 / (1 + np.exp(-4.0)), 4)


def test_adaptive_sources(spark):
    rows = [hit(1, 1, 0.5, "a"), hit(2, 2, 0.1, "a"), hit(3, 3, 0.36, "a"), hit(4, 4, 0.3, "b"), hit(5, 5, 0.29, "b"), hit(6, 6, 0.2, "c")]
    got = hybrid.adaptive_sources(spark.createDataFrame(rows).select("q", "final_rank", "id", "rerank_score", "file_name"), "q").first()
    assert [x["id"] for x in got.sources] == [1, 3, 4]
    low = hybrid.adaptive_sources(spark.createDataFrame([hit(i, i, 0.05) for i in (1, 2, 3)]).select("q", "final_rank", "id", "rerank_score", "file_name"), "q").first()
    assert [x["id"] for x in low.sources] == [1, 2]


CONTEXT = "Manual de Entrega. A escala padrão é 5x2. O frete custa R$ 250,00 e o desconto é de 2,5%. O prazo é de 3 dias. Vale o Art. 49 da Lei 8.078."


@pytest.mark.parametrize(
    ("sentence", "grounded", "reason"),
    [
        ("A escala é 5 x 2 no padrão.", True, "grounded"),
        ("A escala é 6x1 no padrão.", False, "unsupported_entities"),
        ("Não existe escala 6x1 no padrão.", True, "grounded"),
        ("O frete custa R$ 250.", True, "grounded"),
        ("O frete custa R$ 300,00.", False, "unsupported_entities"),
        ("O desconto é de 2,50%.", True, "grounded"),
        ("O desconto é de 9%.", False, "unsupported_entities"),
        ("O prazo é de 3 horas.", True, "grounded"),
        ("O prazo é de 8 dias.", False, "unsupported_entities"),
        ("Segue o Art. 50 da norma.", False, "unsupported_entities"),
        ("Gatos dormem sobre telhados quentes.", False, "low_overlap"),
        ("Gatos dormem.", True, "grounded"),
        ("Atenciosamente, a equipe", True, "framing"),
        ("", True, "framing"),
        (None, True, "framing"),
    ],
)
def test_verification(spark, sentence, grounded, reason):
    r = grounding.verified(spark.createDataFrame([(sentence, CONTEXT)], "sentence string, context string")).first()
    assert (r.is_grounded, r.reason) == (grounded, reason)


def test_responses(spark):
    rows = [(1, "O frete custa R$ 250,00. O prazo é de 3 dias.", CONTEXT), (2, "O frete custa R$ 250,00. O prazo é de 9 dias.", CONTEXT), (3, "Bom dia!", CONTEXT), (4, " ", CONTEXT), (5, None, CONTEXT), (6, "O prazo é de 3 dias.", None), (7, "Gatos dormem sobre telhados quentes. O frete custa R$ 250,00.", CONTEXT)]
    df = spark.createDataFrame(rows, "id int, answer string, context string")
    assert {r.id: r.is_grounded for r in grounding.checked(df, "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}


def catalog(spark):
    return [r.asDict() for r in routing.default_catalog(spark).collect()]


@pytest.mark.parametrize(
    ("question", "department", "score"),
    [("Quando cai o salário e o vale transporte?", "rh", 3.5), ("denúncia de assédio", "juridico_compliance", 9.0), ("o fornecedor na doca", "compras_fornecedores", 8.0), ("nada disso", routing.FALLBACK, 0.0), ("", routing.FALLBACK, 0.0), (None, routing.FALLBACK, 0.0)],
)
def test_routing(spark, question, department, score):
    r = routing.routed(spark.createDataFrame([(1, question)], "id int, query string"), catalog(spark), "id").first()
    assert (r.department_key, r.match_score) == (department, score)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("**Resumo Direto:** Sim.\n\n**Detalhamento:** Muito mais.", ("Sim.", "Muito mais.")),
        ("Não. O prazo acabou. Veja mais.", ("Não. O prazo acabou.", "Veja mais.")),
        ("Esta é a primeira frase inteira. Segunda. Terceira.", ("Esta é a primeira frase inteira.", "Segunda.\nTerceira.")),
        ("Um parágrafo com várias palavras.\n\nDois\n\nTrês\n[Fonte: x]", ("Um parágrafo com várias palavras.", "Dois\n\nTrês")),
        ("Com base na documentação oficial, segue: • a", ("Com base na documentação oficial, segue:", "• a")),
        ("só isto", ("só isto", "só isto")),
        (None, ("", "")),
    ],
)
def test_summaries(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string").select(rendering.summary_and_details(F.col("a")).alias("x"))
    assert tuple(df.first().x) == want


def test_messages(spark):
    make = lambda c, t, d, lines=None: spark.range(1).select(rendering.response(F.lit(c), F.lit(t).cast("string"), F.lit(d).cast("string"), F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>"), "ACME").alias("m")).first().m
    assert make("chat", "a", None, ["• x", "• x"]) == "**Resumo Direto:**\na\n\n**Detalhamento:**\na\n\n**Fontes Consultadas:**\n• x"
    assert make("email", "a", "b").endswith("• Nenhuma fonte documental direta citada.\n\nAtenciosamente,\nEquipe de Atendimento - ACME")
    assert make("chat", " ", None) == rendering.NOTHING
    cite = lambda c, *v: spark.range(1).select(rendering.citation(F.lit(c), *(F.lit(x).cast("string") for x in v)).alias("m")).first().m
    assert cite("email", "f", "s", "Pág. 2") == "• Documento: f — Seção: s (Pág. 2)"
    assert cite("chat", None, "", None) == "• [Fonte: Documento Oficial, Seção: Seção Geral, Pág. 1]"


def test_extracted_answers_and_the_whole_way(spark):
    body = "1. PRAZOS\nO prazo de entrega é de 3 dias\npara todas as lojas.\n•\n- O frete custa R$ 250,00 em todo o estado.\nQual o prazo?"
    rows = [hit(1, 1, 0.6, text=body), hit(2, 2, 0.5, "g", text=body), hit(3, 1, 0.2, q=2, query="outra coisa"), hit(4, 1, 0.9, q=3, query="bom dia")]
    hits = spark.createDataFrame(rows)
    made = {r.q: r for r in answering.extracted(hits, "q").collect()}
    assert made[1].answer.count("•") == 2 and "O prazo de entrega é de 3 dias para todas as lojas.\n  [Fonte: f, Seção: s, Pág. 1]" in made[1].answer
    assert len(made[1].citations) == 2 and made[1].supported
    asked = spark.createDataFrame([(1, "prazo de entrega"), (2, "outra coisa"), (3, "Bom dia!"), (4, "salário"), (5, None)], "q int, query string")
    got = {r.q: r for r in plan.answered(asked, hits, catalog(spark), "q").collect()}
    assert {q: r.outcome for q, r in got.items()} == {1: "passed", 2: "confidence_below_threshold", 3: "greeting", 4: "no_search_results", 5: "no_search_results"}
    assert [got[q].is_fallback for q in (1, 2, 3, 4)] == [False, True, False, True]
    assert got[4].fallback_department == "rh" and "Recursos Humanos" in got[4].answer and not got[4].citations
    assert got[1].answer.startswith("**Resumo Direto:**") and got[3].confidence_score == 1.0
    assert [s.chunk_id for s in got[1].sources_used] == [c.chunk_id for c in got[1].citations] and not got[2].sources_used
    assert got[1].hallucination_check.is_grounded and got[1].hallucination_check.n_sentences > 0 and got[1].hallucination_check.reason is None
    assert got[2].hallucination_check.reason == "confidence_below_threshold" and not got[2].hallucination_check.is_grounded
    assert len(got[1].hallucination_check.sentences) == got[1].hallucination_check.n_sentences and got[2].hallucination_check.sentences == [] == got[3].hallucination_check.sentences
    searched = spark.createDataFrame([(4,)], "q int")
    assert {r.q: r.outcome for r in plan.answered(asked, hits, catalog(spark), "q", searched=searched).collect()}[4] == "no_rerank_results"

    def inventor(rows):
        return answering.extracted(rows, "q").withColumn("answer", F.lit("O prazo de entrega é de 77 dias."))

    assert {r.q: r.outcome for r in plan.answered(asked, hits, catalog(spark), "q", generate=inventor).collect()}[1] == "hallucination_detected"


def test_hash_embed_covers_whole_documents(spark, tmp_path):
    from verdigraph import queries

    texts = {1: "alpha " * 20_000 + "omega", 2: "", 3: None, 4: "alpha beta"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.embedding for r in queries.hash_embed(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert len(got[i]) == 768 and np.allclose(got[i], dense.hash_embedding(t), atol=1e-6)


def test_generators_fall_back_in_order(spark):
    body = "O prazo de entrega é de 3 dias para todas as lojas."
    hits = spark.createDataFrame([hit(1, 1, 0.6, text=body), hit(2, 2, 0.5, "g", text=body)])

    def broken(question, context):
        raise RuntimeError("no quota")

    blank, good = lambda question, context: " ", lambda question, context: f"{question} {context.count('--- DOCUMENTO')}"
    row = answering.generated(hits, "q", [broken, blank, good]).first()
    assert row.answer == f"{row.query} 2" and len(row.citations) == 2
    assert answering.generated(hits, "q", [broken, blank]).first().answer == answering.extracted(hits, "q").first().answer


def test_embedding_models_get_batches_and_fall_back(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "k long, text string").coalesce(1)

    def broken(texts):
        raise RuntimeError("no quota")

    def short(texts):
        return [[1.0, 2.0]] * (len(texts) - 1)

    def small(texts):
        assert len(texts) <= 32
        return [[float(len(texts)), 0.0]] * len(texts)

    got = {r.k: r.embedding for r in dense.embedded(docs, "k", embed=[broken, short, small]).collect()}
    assert sorted({v[0] for v in got.values()}) == [6.0, 32.0]
    got = {r.k: r.embedding for r in dense.embedded(docs, "k", embed=[broken, short]).collect()}
    assert all(len(v) == 768 for v in got.values())


def test_ties_pass_k_rows_only(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 2 else [-1.0, 0.1 * i]) for i in range(300)], "v long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "q long, embedding array<double>")
    assert [r.v for r in dense.cosine_top(asked, vectors, "q", "v", 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_chunk_input_and_collections(spark, tmp_path):
    for nothing in (None, [], "", " ", {}, {"chunk_id": "a"}, 5, [None, {}, {"chunk_id": "a"}]):
        assert store.chunk_input(spark, nothing).count() == 0
    rows = [{"chunk_id": "a", "text": "x"}, {"chunk_id": "b", "text": None}, "junk", {"chunk_id": "c", "text": "z", "page_start": 2}]
    assert sorted(r.chunk_id for r in store.chunk_input(spark, rows).collect()) == ["a", "c"]
    assert store.chunk_input(spark, rows, -1).count() == 0
    with pytest.raises(ValueError, match="batch_size"):
        store.chunk_input(spark, rows, 0)
    (tmp_path / "chunks.json").write_text('[{"chunk_id": "a", "text": "x"}]')
    assert store.chunk_input(spark, tmp_path / "chunks.json").count() == 1
    for path in (None, ":memory:", str(tmp_path / "kept")):
        own = store.ChunkStore(spark, path)
        assert own.read().count() == 0
        assert own.upsert(store.chunk_input(spark, rows)) == 2
        assert own.upsert(store.chunk_input(spark, [{"chunk_id": "a", "text": "new"}, {"chunk_id": "d", "text": "d"}])) == 3
        assert {r.chunk_id: r.text for r in own.read().collect()}["a"] == "new"
        own.clear()
        assert own.read().count() == 0 and own.upsert(store.chunk_input(spark, rows)) == 2
    assert store.ChunkStore(spark, str(tmp_path / "kept")).read().count() == 2


@pytest.mark.parametrize(
    ("sentence", "entity", "want"),
    [
        ("A escala não é 6x1.", "6x1", True), ("A escala é 6x1.", "6x1", False), ("Nunca a b c d e 6x1", "6x1", True), ("Nunca a b c d e f 6x1", "6x1", False),
        ("6x1 a b c d proibido", "6x1", True), ("6x1 a b c d e proibido", "6x1", False), ("sem R$ 250,00 de frete", "R$ 250,00", True), ("sem x6x1", "6x1", False), ("", "6x1", False),
    ],
)
def test_denied_mentions(spark, sentence, entity, want):
    row = spark.createDataFrame([(sentence, entity)], "s string, e string").select(grounding.is_denied(F.col("s"), F.col("e")).alias("x")).first()
    assert row.x is want


def test_counts_in_rows_equal_counts_by_grouping(spark):
    docs = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["x"]), (4, ["z"] * 50 + ["y"] * 20)]
    df = spark.createDataFrame(docs, "k long, tokens array<string>")
    rows = df.select("k", F.explode(sparse.counted(F.col("tokens"))).alias("x")).select("k", "x.token", "x.tf").collect()
    assert sorted(map(tuple, rows)) == sorted((k, t, tokens.count(t)) for k, tokens in docs for t in set(tokens))


@pytest.mark.parametrize("n_docs", [3, 4])
def test_best_rows_scale_as_all_do(spark, n_docs):
    pairs = spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0), (1, 3, 3.0), (2, 1, 4.0), (3, 1, -1.0), (3, 2, -2.0), (3, 3, -3.0)], "q long, d long, s double")
    whole = {(r.q, r.d): r.x for r in sparse.minmax(pairs, "q", n_docs, "s", "x").collect()}
    best = sparse.best_scaled(pairs, "q", "d", n_docs, 2, "s", "x").collect()
    assert {(r.q, r.d): r.x for r in best}.items() <= whole.items() and len(best) == 5


@pytest.mark.parametrize(
    ("paragraph", "rule"),
    [
        ("Qual é o prazo para a devolução?", "question"),
        ("1. Prazos de entrega", "title again"),
        ("12) Curto demais.", "fragment"),
        ("Uma linha que não acaba com ponto", "not ended"),
        ("2.1. POLÍTICA DE TROCAS – LOJAS, SITES E TODOS OS OUTROS CANAIS DA CASA", "numbered capitals"),
        ("A tabela tem Modalidade e Disponibilidade em cada linha, com prazos e valores de frete.", "table head"),
        ("O prazo de entrega é de três dias.", None),
        ("2.1. POLÍTICA de trocas com letras pequenas e mais texto para que seja longa", None),
    ],
)
def test_noise_rules(spark, paragraph, rule):
    row = spark.range(1).select(F.struct(*(c.alias(k) for k, c in answering.noise_rules(F.lit(paragraph), F.lit("Prazos de Entrega")).items())).alias("x"), answering.is_noise(F.lit(paragraph), F.lit("Prazos de Entrega")).alias("any")).first()
    assert row["any"] == (rule is not None)
    assert rule is None or row.x[rule]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("**RESUMO executivo:**\n Sim.\n\nsolto\n\n**Detalhamento normativo:** Tudo.\nMais.\n**Base Normativa e Fontes:**\n• x", ("Sim.", "Tudo.\nMais.")),
        ("**Resumo:** a **Detalhamento:** b **Fontes:** c", ("a", "b")),
        ("**Resumo Direto:** só a primeira parte com muitas palavras.", ("**Resumo Direto:** só a primeira parte com muitas palavras.",) * 2),
        ("Com base na documentação oficial\nsegue o texto", ("Com base na documentação oficial", "segue o texto")),
        ("Com base na documentação oficial:", ("Com base na documentação oficial:",) * 2),
        (" [fonte: a, b]\nUm texto com mais de quatro palavras.\n[FONTE: c]", ("Um texto com mais de quatro palavras.",) * 2),
    ],
)
def test_summaries_by_headings(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string").select(rendering.summary_and_details(F.col("a")).alias("x"))
    assert tuple(df.first().x) == want


@pytest.mark.parametrize(("asked", "left"), [("Olá! Qual o prazo?", "Qual o prazo?"), ("oie, tudo", "tudo"), ("OIE\tcomo vai", "como vai"), ("oitenta dias", "oitenta dias"), ("hey !?- ab", "hey !?- ab"), ("Gostaria de saber, por favor, o prazo", "por favor, o prazo"), ("  boa noite ", "boa noite"), (None, None)])
def test_leading_greetings(spark, asked, left):
    from verdigraph.functions import text

    assert spark.createDataFrame([(asked,)], "q string").select(text.search_query(F.col("q")).alias("q")).first().q == left


def test_checked_sentences_keep_their_place(spark):
    rows = [(1, "O prazo é de 3 dias. O prazo é de 9 dias.", "o prazo é de 3 dias úteis"), (2, "", "x"), (3, None, None)]
    got = {r.k: r for r in grounding.verify(spark.createDataFrame(rows, "k long, answer string, context string"), "k").collect()}
    assert [(s.sentence, s.is_grounded, s.ungrounded) for s in got[1].sentences] == [("O prazo é de 3 dias.", True, []), ("O prazo é de 9 dias.", False, ["9 dias"])]
    assert not got[1].is_grounded and got[2].sentences == [] and got[3].sentences == []


def test_hashed_vectors_are_drawn_once_for_many_texts(monkeypatch):
    made, of = [], np.random.RandomState
    monkeypatch.setattr(np.random, "RandomState", lambda *a: made.append(a) or of(*a))
    texts = [f"a b{i} b{i} c{i % 3}" for i in range(300)] + ["", None, "a A"]
    got = dense.hash_embeddings(texts, 16)
    assert len(made) == 1  # one generator, however many tokens there are
    for i in (0, 7, 299, 300, 302):
        words = (texts[i] or "").lower().split() or [""]
        mean = sum(of(int(hashlib.md5(w.encode()).hexdigest(), 16) % (1 << 32)).randn(16) for w in words) / len(words)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-12)
        assert (dense.hash_embedding(texts[i], 16) == got[i]).all()  # the other texts change nothing


def test_entities_in_the_same_spelling_need_no_second_look(spark):
    line = "Paga R$ 12,50 e 5% em 3 dias, escala 6x1, Art. 7."
    made = []
    real, grounding._amount = grounding._amount, lambda x: made.append(1) or F.raise_error(F.lit("looked up")).cast("string")
    try:
        rows = spark.createDataFrame([(line, line)], "sentence string, context string")
        assert [(r.ungrounded, r.is_grounded) for r in grounding.verified(rows).collect()] == [([], True)] and made
    finally:
        grounding._amount = real
    rows = spark.createDataFrame([(line, line.replace("5%", "6%").replace("R$ 12,50", "R$12,5"))], "sentence string, context string")
    assert [r.ungrounded for r in grounding.verified(rows).collect()] == [["5%"]]


def test_vectors_are_multiplied_in_slices_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(dense, "DOCUMENTS", 16)
    x = np.random.default_rng(4).normal(size=(100, 5))
    x[50:60] = x[3]  # ties across slices
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, embedding array<double>").coalesce(1)
    found = dense.cosine_top(df.where("v < 9").withColumnRenamed("v", "q"), df, "q", "v", 4).collect()
    sim = np.clip(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2), 0, 1)
    for q in range(9):
        assert [r.v for r in sorted((r for r in found if r.q == q), key=lambda r: r["rank"])] == sorted(range(100), key=lambda i, q=q: (-round(sim[q, i], 9), i))[:4]


def test_what_ranked_the_hits_of_an_answer_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [hit(rank, rank, 0.9, text=f"O prazo de entrega {q}.{rank} é de cinco dias úteis para todos.", q=q) for q in (1, 2) for rank in (1, 2, 3)]
    hits = spark.createDataFrame(rows)
    answers = answering.extracted(hits.mapInArrow(counted, hits.schema), "q").collect()
    assert seen.value == len(rows) and all(r.supported and len(r.citations) == 3 for r in answers)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_task_has_a_bounded_number_of_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(sparse, "PAIRS", 20, raising=False)
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(i, ["a", f"t{i % 3}", "a"]) for i in range(100)], "id int, tokens array<string>")
    asked = spark.createDataFrame([(q, ["a", f"t{q}"]) for q in range(4)], "q int, tokens array<string>")
    for found in (sparse.scores(asked, docs, "q", "id"), sparse.overlap_scores(asked, docs, "q", "id")):
        by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == 400 and max(by_task) <= 60  # a document's four pairs stay together, and hashes don't deal evenly
    over = {(r.q, r.id): r.overlap for r in sparse.overlap_scores(asked, docs, "q", "id").collect()}
    assert over == {(q, i): (1 + (i % 3 == q)) / 4 for q in range(4) for i in range(100)}


def test_tokens_are_sorted_without_a_lambda(spark):
    df = spark.createDataFrame([(["b", "a", "é", "a", "aa"],), ([],), (None,)], "tokens array<string>").select(sparse.counted(F.col("tokens")).alias("x"))
    assert "lambdafunction(if" not in df._jdf.queryExecution().analyzed().toString().lower()
    assert [r.x and [tuple(x) for x in r.x] for r in df.collect()] == [[("a", 2), ("aa", 1), ("b", 1), ("é", 1)], None, None]
