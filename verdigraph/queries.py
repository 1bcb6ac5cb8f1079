"""The engine's queries over the standard tables, each with the SQL that must give the same rows.

Documents stand for chunks, benchmark items for questions, embeddings for vectors with the same ids. Sentences with
amounts and dates are built from orders and lineitem, as the documents hold few.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.functions import dates, text
from verdigraph.functions.rules import ACRONYMS, CONVERSATIONAL, GROUNDING_ACRONYMS, GROUNDING_SYNONYMS, RERANK_SYNONYMS, SEARCH_SYNONYMS, STOPWORDS
from verdigraph.operators import answering, cells, chunking, dense, grounding, hybrid, rendering, routing, sparse
from verdigraph.operators.inverted import StoredIndex
from verdigraph.plans import answer as plan
from verdigraph.sources import documents as store
from verdigraph.staging import shared_dir, spread
from verdigraph.streaming.sessions import sessions

TOP = 5
_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# ---- SQL building blocks ----


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PUNCT = r"[^\pL\pN_\s]"
_NORM = rf"regexp_replace(regexp_replace(strip_accents(lower(text)), '{_PUNCT}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_MAP = "MAP {" + ", ".join(f"'{k}': {_list(v.split())}" for k, v in SEARCH_SYNONYMS.items()) + "}"


def _tokens(table: str, key: str, out: str) -> str:
    """CTEs that end in out(key, tokens)."""
    return rf"""
{out}_raw AS (SELECT {key}, list_filter(regexp_split_to_array({_NORM}, '\s+'), lambda t: t <> '') AS raw FROM {table} WHERE text IS NOT NULL),
{out}_kept AS (SELECT *, list_filter(raw, lambda t: NOT list_contains({_list(STOPWORDS)}, t) AND (len(t) > 1 OR list_contains({_list(ACRONYMS)}, t))) AS kept FROM {out}_raw),
{out} AS (SELECT {key}, CASE WHEN len(kept) > 0 THEN flatten(list_transform(kept, lambda t: coalesce({_MAP}[t], [t]))) ELSE raw END AS tokens FROM {out}_kept)"""


BM25_STEPS = """n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_size FROM d),
df AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS token FROM d) GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, n),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
wanted AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(tokens) AS token FROM q) GROUP BY ALL),
posted AS (SELECT doc_id, doc_size, token, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS doc_size, unnest(tokens) AS token FROM d) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_size / mean_size))) AS bm25
  FROM posted JOIN wanted USING (token) JOIN idf USING (token), n GROUP BY ALL)"""
#: The blocks that SQL of other modules is built from.
NORMALISED, token_steps = _NORM, _tokens
_BM25 = f"""{_tokens("documents", "doc_id", "d")},{_tokens("benchmark", "item_id", "q")},
{BM25_STEPS}"""


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = sparse.indexed(_read(spark, sf_dir, "documents"), "doc_id")
    return sparse.indexed(_read(spark, sf_dir, "benchmark"), "item_id"), tokens


def _bm25(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, tokens = _indexed(spark, sf_dir)
    return asked, tokens, sparse.scores(asked, tokens, "item_id", "doc_id")


# ---- text functions ----


@query(f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm"))


@query(rf"SELECT conv_id, turn, regexp_replace({_NORM}, '\s+', ' ', 'g') AS norm FROM conversations")
def normalize_catalog(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.catalog_normalized(F.col("text")).alias("norm"))


@query(f"WITH {_tokens('documents', 'doc_id', 'd')} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM d")
def tokenize_terms(spark, sf_dir):
    tokens = sparse.tokenized(_read(spark, sf_dir, "documents"), "doc_id")
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<\s*strong\s*>(.*?)<\s*/\s*strong\s*>', '**\1**', 'gis'), '<\s*b\s*>(.*?)<\s*/\s*b\s*>', '**\1**', 'gis'), '<[^>]+>', '', 'g') AS plain FROM pages""")
def strip_html(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("plain"))


_CLEAN_IN = "'ACME LTDA' || chr(10) || 'Página ' || doc_id || ' de 9' || chr(10) || '  12 ' || chr(10) || chr(10) || chr(10) || chr(10) || text"


@query(rf"""
WITH lines AS (SELECT doc_id, list_transform(string_split({_CLEAN_IN}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')) AS l FROM documents),
kept AS (SELECT doc_id, array_to_string(list_filter(l, lambda x: x = '' OR NOT regexp_matches(x, '^(?:p[áa]gina\s+\d+(?:\s+de\s+\d+)?|\d{{1,3}}|acme(?: ltda)?)$', 'i')), chr(10)) AS t FROM lines)
SELECT doc_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM kept""")
def clean_lines(spark, sf_dir):
    head = F.concat(F.lit("ACME LTDA\nPágina "), F.col("doc_id").cast("string"), F.lit(" de 9\n  12 \n\n\n\n"), F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.clean_page(head, r"acme(?: ltda)?").alias("clean"))


_REFS = "(^|[^\\pL\\pN_])(Dr|dr|Dra|dra|Sr|sr|Sra|sra|Prof|prof|Profa|profa|Art|art|pág|págs|Pág|Págs|fl|fls|cap|Cap|par|Par|inc|Inc|sec|Sec|ref|Ref|no|No|nº|Nº|min|hs|seg|vs|v|av|Av|ed|Ed|ex|Ex)\\.(\\s*[0-9A-Za-zÀ-ÿº°/:,)])"


@query(rf"""
WITH once AS (SELECT doc_id, regexp_replace(text, '{_REFS}', '\1\2~~\3', 'g') AS text FROM documents),
twice AS (SELECT doc_id, regexp_replace(text, '{_REFS}', '\1\2~~\3', 'g') AS text FROM once),
cut AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+([A-Z0-9"''“•*-])', '\1' || chr(10) || '\2', 'g') AS t FROM twice),
parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n+'), lambda p: regexp_replace(regexp_replace(regexp_replace(replace(p, '~~', '.'), '^\s+|\s+$', '', 'g'), '^[•*-]\s*', ''), '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM cut)
SELECT doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, chr(10)) AS sentences FROM parts""")
def split_sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_join(s, "\n").alias("sentences"))


def _claim(price):
    money = F.regexp_replace(F.format_string("%.2f", price), r"\.", ",")
    return F.format_string("Pedido %d custa R$ %s com %d%% em %d dias, escala %dx%d, Art. %d.", "l_orderkey", money, F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), (F.col("l_linenumber") % 6 + 1), F.lit(1), "l_linenumber")


def _claims(spark, sf_dir):
    """A sentence with money, a percentage, a duration, a shift and a law for every line item, and a context that
    changes the price where the part's key is odd."""
    items = _read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", _claim(price).alias("sentence"), _claim(price + F.col("l_partkey") % 2).alias("context"))


def _claim_sql(price: str) -> str:
    return f"""'Pedido ' || l_orderkey || ' custa R$ ' || replace(printf('%.2f', {price}), '.', ',') || ' com ' || round(l_discount * 100)::INT || '% em ' || l_quantity::INT || ' dias, escala ' || (l_linenumber % 6 + 1) || 'x1, Art. ' || l_linenumber || '.'"""


_CLAIMS = f"claims AS (SELECT l_orderkey, l_linenumber, l_partkey, {_claim_sql('l_extendedprice')} AS sentence, {_claim_sql('l_extendedprice + l_partkey % 2')} AS context FROM lineitem)"


@query(rf"""WITH {_CLAIMS}
SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all(sentence, '(?i)R\$\s*\d{{1,3}}(?:\.\d{{3}})*(?:,\d+)?|R\$\s*\d+(?:[.,]\d+)?'), '|') AS currencies,
  array_to_string(regexp_extract_all(sentence, '\b\d+(?:[.,]\d+)?\s*%'), '|') AS percentages, array_to_string(regexp_extract_all(sentence, '\b\d+\s*[xX]\s*\d+\b'), '|') AS shifts,
  array_to_string(regexp_extract_all(sentence, '\b\d+\s*(?:horas|hora|dias|dia|meses|h|min)\b'), '|') AS durations, array_to_string(regexp_extract_all(sentence, '\bArt\.\s*\d+\b'), '|') AS articles_and_laws,
  array_to_string(regexp_extract_all(sentence, '\b\d+(?:[.,]\d+)?\b'), '|') AS numbers FROM claims""")
def extract_entities(spark, sf_dir):
    claims = _claims(spark, sf_dir).withColumn("e", text.entities(F.col("sentence")))
    return claims.select("l_orderkey", "l_linenumber", *(F.array_join(F.col("e")[k], "|").alias(k) for k in text.ENTITY_PATTERNS))


@query(r"""
WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN round(v, 2) = floor(round(v, 2)) THEN floor(v)::BIGINT::VARCHAR ELSE rtrim(printf('%.2f', v), '0') END AS spelled FROM n""")
def normalize_numbers(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem")
    spelled = F.concat(F.lit("R$ "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"))
    return items.select("l_orderkey", "l_linenumber", text.number_key(spelled).alias("spelled"))


_KINDS = {
    "iso": ("date_format(d, 'yyyy-MM-dd')", "day"), "dmy": ("date_format(d, 'dd/MM/yyyy')", "day"), "ymd": ("date_format(d, 'yyyy.MM.dd')", "day"), "compact": ("date_format(d, 'yyyyMMdd')", "day"),
    "month_year": ("date_format(d, 'MM/yyyy')", "month"), "long": ("concat(day(d), ' de ', element_at(array('janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'), month(d)), ' de ', year(d))", "day"),
    "english": ("date_format(d, 'MMMM d, yyyy')", "day"), "quarter": ("concat('Q', quarter(d), ' ', year(d))", "quarter"), "year": ("cast(year(d) as string)", "year"), "epoch": ("cast(unix_timestamp(cast(date_trunc('day', d) as timestamp)) as string)", "day"),
}


@query("WITH d AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d FROM orders) " + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, date_trunc('{unit}', d)::TIMESTAMP AS parsed FROM d" for k, (_, unit) in _KINDS.items()))
def parse_dates(spark, sf_dir):
    spelled = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(e).alias("spelled")) for k, (e, _) in _KINDS.items()))
    rows = spelled.select("o_orderkey", F.explode(each).alias("x")).select("o_orderkey", "x.kind", "x.spelled")
    return rows.select("o_orderkey", "kind", dates.parsed_date(F.col("spelled")).alias("parsed"))


# ---- documents ----


@query(r"""SELECT doc_id, i::INT AS page_num, p AS text FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(12)), chr(12)), 1) AS i FROM documents) WHERE regexp_replace(p, '\s', '', 'g') <> ''""")
def page_split(spark, sf_dir):
    files = _read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("raw"))
    return store.pages(files)


_PAGES = "SELECT doc_id, i AS page_num, p AS text FROM (SELECT doc_id, unnest(string_split(t, chr(12))) AS p, generate_subscripts(string_split(t, chr(12)), 1) AS i FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n', chr(12), 'g'), '\\. ', '.' || chr(10) || '# ', '') AS t FROM documents)) WHERE regexp_replace(p, '\\s', '', 'g') <> ''"


def _headed_pages(spark, sf_dir):
    """Lines become pages, and the second sentence of a document becomes a heading of its page."""
    raw = F.regexp_replace(F.translate("text", "\n", "\f"), r"(?s)^(.*?)\. ", "$1.\n# ")
    return store.pages(_read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")))


@query(rf"""
WITH pages_ AS ({_PAGES}),
lines AS (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages_),
flagged AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM lines),
heads AS (SELECT *, bare <> '' AND len(bare) < 100 AND regexp_matches(bare, '^(?:[0-9]+\.|sumário\b|índice\b|anexo\b|bloco [a-z]:|#{{1,4}}\s+).*$', 'i') AS h FROM flagged),
numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM heads),
whole AS (SELECT doc_id, section_no, regexp_replace(string_agg(line, chr(10) ORDER BY page_num, line_no), '^\s+|\s+$', '', 'g') AS text, max(bare) FILTER (h) AS title, min(page_num) FILTER (h) AS s, max(page_num) FILTER (bare <> '') AS e FROM numbered GROUP BY ALL)
SELECT doc_id, section_no::BIGINT AS section_no, coalesce(title, 'Introdução / Cabeçalho') AS title, text, coalesce(s, 1)::INT AS page_start, greatest(coalesce(s, 1), coalesce(e, 1))::INT AS page_end FROM whole WHERE text <> ''""")
def detect_sections(spark, sf_dir):
    return chunking.sections(_headed_pages(spark, sf_dir), "doc_id")


def _bare(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


_MOST, _OVERLAP, _GLUE = chunking.MAX_CHARS, chunking.OVERLAP, "chr(10) || chr(10)"
_STEP = _MOST - _OVERLAP - 2


@query(rf"""WITH RECURSIVE s AS ({_sql["detect_sections"]}),
paragraphs AS (SELECT doc_id, section_no, unnest(string_split(text, {_GLUE})) AS p, generate_subscripts(string_split(text, {_GLUE}), 1) AS i FROM s WHERE len(text) > {_MOST}),
cut AS (SELECT doc_id, section_no, i, 0 AS j, p FROM paragraphs WHERE len(p) <= {_MOST}
  UNION ALL SELECT doc_id, section_no, i, j, {_bare(f"substring(p, j * {_STEP} + 1, {_STEP})")} FROM paragraphs, unnest(range(0, (len(p) - 1) // {_STEP} + 1)) AS t(j) WHERE len(p) > {_MOST}),
pieces AS (SELECT doc_id, section_no, p, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i, j) AS n FROM cut WHERE j = 0 OR p <> ''),
walk AS (SELECT doc_id, section_no, 0::BIGINT AS n, '' AS now, []::VARCHAR[] AS done FROM (SELECT DISTINCT doc_id, section_no FROM pieces)
  UNION ALL SELECT doc_id, section_no, n, CASE WHEN now = '' THEN p WHEN fits THEN now || {_GLUE} || p WHEN tail = '' THEN p ELSE {_bare(f"tail || {_GLUE} || p")} END, CASE WHEN fits THEN done ELSE list_append(done, now) END
  FROM (SELECT w.doc_id, w.section_no, p.n, p, now, done, now = '' OR len(now) + len(p) + 2 <= {_MOST} AS fits, CASE WHEN len(now) > {_OVERLAP} AND len(p) < {_MOST} - 2 THEN right(now, least({_OVERLAP}, {_MOST} - 2 - len(p))) ELSE '' END AS tail
    FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.section_no = w.section_no AND p.n = w.n + 1)),
packed AS (SELECT doc_id, section_no, CASE WHEN now = '' THEN done ELSE list_append(done, now) END AS parts FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, section_no ORDER BY n DESC) = 1
  UNION ALL SELECT doc_id, section_no, [text] FROM s WHERE len(text) <= {_MOST}),
rows_ AS (SELECT doc_id, section_no, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM packed),
numbered_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, pos) AS k, {_bare("part")} AS chunk FROM rows_)
SELECT doc_id || '_CHK_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS chunk_id, doc_id, title AS section_title, page_start, page_end, len(chunk)::INT AS char_count, len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda w: w <> ''))::INT AS word_count, chunk AS text
FROM numbered_ JOIN s USING (doc_id, section_no)""")
def chunk_documents(spark, sf_dir):
    found = chunking.chunks(chunking.sections(_headed_pages(spark, sf_dir), "doc_id"), key="doc_id")
    return found.select("chunk_id", "doc_id", "section_title", "page_start", "page_end", "char_count", "word_count", "text")


@query("SELECT d.doc_id, coalesce(v.category, 'Geral') AS category, coalesce(v.last_updated, '2026') AS last_updated FROM documents d LEFT JOIN (VALUES ('src0', 'Manual', '2024'), ('src1', 'Política', '2025')) v(source, category, last_updated) USING (source)")
def metadata_left_join(spark, sf_dir):
    """One section a document, so that the chunker's own look-up of its file's description is what is compared."""
    docs = _read(spark, sf_dir, "documents")
    dim = spark.createDataFrame([("src0", "Manual", "2024"), ("src1", "Política", "2025")], "source string, category string, last_updated string")
    dim = docs.select("doc_id", "source").join(F.broadcast(dim), "source").select("doc_id", "category", F.lit("ACME").alias("department_author"), "last_updated")
    sections = docs.select("doc_id", F.lit(1).cast("long").alias("section_no"), F.lit("T").alias("title"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("um texto curto").alias("text"))
    return chunking.chunks(sections, dim, "doc_id").select("doc_id", "category", "last_updated")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src' || (doc_id % 20)")
def metadata_filter(spark, sf_dir):
    nested = F.create_map(F.lit("owner"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))
    docs = _read(spark, sf_dir, "documents").withColumn("metadata", nested).withColumn("own", F.try_element_at("metadata", F.lit("owner")))
    return docs.where(hybrid.matches(docs.columns, {"lang": "en"}) & (F.col("source") == F.col("own"))).select("doc_id")


@query("SELECT chunk_id, text FROM (SELECT 'c' || doc_id AS chunk_id, text FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 3 <> 2 UNION ALL SELECT 'c' || doc_id, 'v2 ' || text FROM documents WHERE doc_id % 3 <> 0)")
def upsert_chunks(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", "text")
    old = docs.where("doc_id % 3 <> 2").select("chunk_id", "text")
    return store.upserted(old, docs.where("doc_id % 3 <> 0").select("chunk_id", F.concat(F.lit("v2 "), "text").alias("text")))


# ---- retrieval ----


@query(f"WITH {_tokens('documents', 'doc_id', 'd')} SELECT token, count(*)::BIGINT AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS token FROM d) GROUP BY token")
def token_df(spark, sf_dir):
    return sparse.document_frequencies(sparse.tokenized(_read(spark, sf_dir, "documents"), "doc_id"))


@query(f"""WITH {_tokens("documents", "doc_id", "d")}, n AS MATERIALIZED (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
df AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS token FROM d) GROUP BY token),
raw AS MATERIALIZED (SELECT token, df, ln((SELECT n FROM n) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df), mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw)
SELECT token, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT mean FROM mean) ELSE raw END, 6) AS idf FROM raw""")
def bm25_idf(spark, sf_dir):
    return sparse.idf(sparse.indexed(_read(spark, sf_dir, "documents"), "doc_id")).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM scored) SELECT item_id, doc_id, rank::INT AS rank, round(bm25, 6) AS bm25 FROM ranked WHERE rank <= {TOP}")
def bm25_topk(spark, sf_dir):
    scored = _bm25(spark, sf_dir)[2]
    return sparse.top(scored, "item_id", "doc_id", F.round("bm25", 9), TOP).select("item_id", "doc_id", "rank", F.round("bm25", 6).alias("bm25"))


@query(_sql["bm25_topk"])
def bm25_stored(spark, sf_dir):
    """The same from an index that is kept in files, of which only what can matter is read and scored."""
    index = StoredIndex(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")
    index.add(_read(spark, sf_dir, "documents"), 0)
    asked = sparse.tokenized(_read(spark, sf_dir, "benchmark"), "item_id")
    return index.top(asked, "item_id", TOP).select("item_id", "doc_id", "rank", F.round("bm25", 6).alias("bm25"))


_SCALED = f"""{_BM25},
bound AS (SELECT item_id, least(min(bm25), CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0.0 ELSE min(bm25) END) AS low, greatest(max(bm25), CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0.0 ELSE max(bm25) END) AS high FROM scored GROUP BY item_id),
scaled AS (SELECT item_id, doc_id, bm25, CASE WHEN high - low > 1e-6 THEN (bm25 - low) / (high - low) ELSE 0.0 END AS sparse_score FROM scored JOIN bound USING (item_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM scaled) WHERE rank <= 50)"""


def _sparse_hits(spark, sf_dir):
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return sparse.best_scaled(_bm25(spark, sf_dir)[2], "item_id", "doc_id", n_docs, hybrid.candidates(TOP), "bm25", "sparse_score")


@query(f"WITH {_SCALED} SELECT item_id, doc_id, round(sparse_score, 6) AS sparse_score FROM best")
def sparse_minmax(spark, sf_dir):
    return _sparse_hits(spark, sf_dir).select("item_id", "doc_id", F.round("sparse_score", 6).alias("sparse_score"))


@query(f"""WITH {_BM25}, hit AS (SELECT item_id, doc_id, sum(times) / (any_value(doc_size) + 1.0::DOUBLE) AS o FROM posted JOIN wanted USING (token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(o, 9) DESC, doc_id) AS rank FROM hit) SELECT item_id, doc_id, rank::INT AS rank, round(o, 6) AS overlap FROM ranked WHERE rank <= {TOP}""")
def overlap_fallback(spark, sf_dir):
    asked, tokens = _indexed(spark, sf_dir)
    found = sparse.overlap_scores(asked, tokens, "item_id", "doc_id")
    return sparse.top(found, "item_id", "doc_id", F.round("overlap", 9), TOP).select("item_id", "doc_id", "rank", F.round("overlap", 6).alias("overlap"))


def _cosine_sql(filter_: str, queries: str = "vec_id % 20 = 0", k: int = TOP) -> str:
    return f"""sims AS (SELECT q.vec_id AS query_id, v.vec_id, least(1.0, greatest(0.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS sim FROM embeddings q, embeddings v WHERE q.{queries} AND {filter_}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM sims) WHERE rank <= {k})"""


@query(f"WITH {_cosine_sql('true')} SELECT query_id, vec_id, rank::INT AS rank, round(sim, 6) AS sim FROM near")
def dense_topk_cosine(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.cosine_top(asked, vectors, "query_id", "vec_id", TOP).select("query_id", "vec_id", "rank", F.round("dense_score", 6).alias("sim"))


@query(f"WITH {_cosine_sql('v.label = 1')} SELECT query_id, vec_id, rank::INT AS rank, round(sim, 6) AS sim FROM near")
def dense_topk_filtered(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.cosine_top(asked, vectors.where(hybrid.matches(vectors.columns, {"label": 1})), "query_id", "vec_id", TOP).select("query_id", "vec_id", "rank", F.round("dense_score", 6).alias("sim"))


def _near(spark, sf_dir, exact: bool):
    vectors = _read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = cells.built(vectors, "vec_id")
    found = cells.near_top(asked, index, "query_id", TOP, 16 if exact else cells.probes_for(asked, index, "query_id", TOP), exact)
    return found.select("query_id", "vec_id", "rank", F.round("dense_score", 6).alias("sim"))


@query(_sql["dense_topk_cosine"])
def dense_topk_cells(spark, sf_dir):
    """The same by cells, exact by their radius."""
    return _near(spark, sf_dir, True)


@query()
def dense_topk_approximate(spark, sf_dir):
    """The nearest of as many cells as a recall of 0.95 takes; tests measure it."""
    return _near(spark, sf_dir, False)


_ASKED = "vec_id IN (SELECT item_id FROM benchmark)"
_FUSED = f"""{_SCALED}, {_cosine_sql("true", _ASKED, 50)},
joined AS (SELECT coalesce(b.item_id, n.query_id) AS item_id, coalesce(b.doc_id, n.vec_id) AS doc_id, coalesce(n.sim, 0.0) AS d, coalesce(b.sparse_score, 0.0) AS s FROM best b FULL JOIN near n ON b.item_id = n.query_id AND b.doc_id = n.vec_id),
dated AS (SELECT j.*, c.text, c.lang, c.source, make_timestamp(2020 + doc_id % 5, 1 + doc_id % 12, 1, 0, 0, 0.0) AS moment FROM joined j JOIN documents c USING (doc_id)),
recent AS (SELECT *, CASE WHEN max(moment) OVER w > min(moment) OVER w THEN (epoch(moment) - epoch(min(moment) OVER w)) / (epoch(max(moment) OVER w) - epoch(min(moment) OVER w)) ELSE 1.0 END AS r FROM dated WINDOW w AS (PARTITION BY item_id)),
hit AS (SELECT item_id, doc_id, text, lang, source, round(d, 4) AS dense_score, round(s, 4) AS sparse_score, round(0.5::DOUBLE * d + 0.5::DOUBLE * s, 4) AS raw_hybrid_score, round(r, 4) AS recency_score, round(r * 0.15::DOUBLE, 4) AS recency_boost, round(0.5::DOUBLE * d + 0.5::DOUBLE * s + r * 0.15::DOUBLE, 4) AS hybrid_score FROM recent)"""


def _dated(spark, sf_dir):
    year, month = F.lit(2020) + F.col("doc_id") % 5, F.lit(1) + F.col("doc_id") % 12
    return _read(spark, sf_dir, "documents").withColumn("moment", dates.parsed_date(F.format_string("%02d/%04d", month, year)))


def _hits(spark, sf_dir, boost: bool = True, k: int | None = None):
    asked = _read(spark, sf_dir, "embeddings").join(_read(spark, sf_dir, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id")).select("item_id", "embedding")
    near = dense.cosine_top(asked, _read(spark, sf_dir, "embeddings"), "item_id", "vec_id", hybrid.candidates(TOP)).withColumnRenamed("vec_id", "doc_id")
    docs = _dated(spark, sf_dir)
    docs = docs.select("doc_id", "text", "lang", "source", "moment")
    return hybrid.fused(near, _sparse_hits(spark, sf_dir), docs, "item_id", "doc_id", boost=boost, k=k)


@query(f"WITH {_FUSED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY raw_hybrid_score DESC, doc_id) AS rank FROM hit) SELECT item_id, doc_id, rank::INT AS rank, dense_score, sparse_score, raw_hybrid_score AS hybrid_score FROM ranked WHERE rank <= {TOP}")
def hybrid_alpha(spark, sf_dir):
    return _hits(spark, sf_dir, False, TOP).select("item_id", "doc_id", "rank", "dense_score", "sparse_score", "hybrid_score")


@query(f"WITH {_FUSED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hybrid_score DESC, doc_id) AS rank FROM hit) SELECT item_id, doc_id, rank::INT AS rank, raw_hybrid_score, recency_score, recency_boost, hybrid_score FROM ranked WHERE rank <= {TOP}")
def hybrid_recency(spark, sf_dir):
    return _hits(spark, sf_dir, True, TOP).select("item_id", "doc_id", "rank", "raw_hybrid_score", "recency_score", "recency_boost", "hybrid_score")


@query(f"""WITH {_FUSED}, two AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense_score DESC, doc_id) AS a, row_number() OVER (PARTITION BY item_id ORDER BY hybrid_score DESC, doc_id) AS b FROM hit),
summed AS (SELECT *, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 6) AS rerank_score FROM two),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS final_rank FROM summed) SELECT item_id, doc_id, rerank_score, final_rank::INT AS final_rank FROM ranked WHERE final_rank <= {TOP}""")
def rrf_fusion(spark, sf_dir):
    return hybrid.reciprocal_rank_fusion(_hits(spark, sf_dir), "item_id", "doc_id", k=TOP).select("item_id", "doc_id", "rerank_score", "final_rank")


_RERANK_MAP = "MAP {" + ", ".join(f"'{k}': {_list(v.split())}" for k, v in RERANK_SYNONYMS.items()) + "}"
_RERANK = f"""{_FUSED},
plain_w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda x: len(x) > 2 OR list_contains({_list(ACRONYMS)}, x))) AS words FROM benchmark),
w AS (SELECT item_id, list_distinct(list_concat(words, flatten(list_transform(words, lambda x: coalesce({_RERANK_MAP}[x], [x]))))) AS words FROM plain_w),
features AS (SELECT h.*, words, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(lower(h.lang), x))) / len(words)::DOUBLE ELSE 0.0 END AS ft, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(lower(h.source), x))) / len(words)::DOUBLE ELSE 0.0 END AS ff, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(lower(h.text), x))) / len(words)::DOUBLE ELSE 0.0 END AS fx FROM hit h JOIN w USING (item_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS final_rank FROM (SELECT *, round(hybrid_score * 0.45::DOUBLE + ft * 0.25::DOUBLE + ff * 0.10::DOUBLE + fx * 0.20::DOUBLE, 4) AS rerank_score FROM features))"""


def _reranked(spark, sf_dir, k: int = TOP):
    asked = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    hits = _hits(spark, sf_dir).withColumnsRenamed({"lang": "section_title", "source": "file_name"}).join(asked, "item_id")
    return hybrid.feature_fusion(hits, "item_id", "doc_id", k=k)


@query(f"WITH {_RERANK} SELECT item_id, doc_id, rerank_score, final_rank::INT AS final_rank FROM reranked WHERE final_rank <= {TOP}")
def feature_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("item_id", "doc_id", "rerank_score", "final_rank")


@query(f"""WITH RECURSIVE {_RERANK}, h AS (SELECT item_id, doc_id, source, rerank_score AS score, final_rank AS r, max(rerank_score) FILTER (final_rank = 1) OVER (PARTITION BY item_id) AS top FROM reranked WHERE final_rank <= 8),
walk AS (
  SELECT item_id, 0::BIGINT AS r, []::VARCHAR[] AS files, []::BIGINT[] AS ranks FROM (SELECT DISTINCT item_id FROM h)
  UNION ALL
  SELECT w.item_id, h.r, CASE WHEN t THEN list_append(files, source) ELSE files END, CASE WHEN t THEN list_append(ranks, h.r) ELSE ranks END
  FROM walk w JOIN (SELECT *, r <= 2 AND score >= 0.15 AS early, score >= top * 0.7::DOUBLE AND score >= 0.22 AS close, score >= 0.28 AND score >= top * 0.55::DOUBLE AS fair FROM h) h ON h.item_id = w.item_id AND h.r = w.r + 1, LATERAL (SELECT len(ranks) < 8 AND (early OR close OR (fair AND NOT list_contains(files, source))) AS t)),
ended AS (SELECT item_id, CASE WHEN len(ranks) > 0 THEN ranks ELSE [1, 2] END AS ranks FROM walk QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY r DESC) = 1)
SELECT item_id, (list_position(ranks, r) - 1)::INT AS place, doc_id, score AS rerank_score FROM ended JOIN h USING (item_id) WHERE list_contains(ranks, r)""")
def adaptive_select(spark, sf_dir):
    chosen = hybrid.adaptive_sources(_reranked(spark, sf_dir, 8).select("item_id", "final_rank", "doc_id", "rerank_score", "file_name"), "item_id")
    return chosen.select("item_id", F.posexplode("sources").alias("place", "s")).select("item_id", "place", "s.doc_id", "s.rerank_score")


_KNOWN = "MAP {" + ", ".join(f"'{k}': {_list(v.split())}" for k, v in GROUNDING_SYNONYMS.items()) + "}"


@query(rf"""WITH {_RERANK},
spoken AS (SELECT item_id, string_agg(norm, ' ' ORDER BY final_rank) AS body, max(score) AS confidence_score FROM
  (SELECT item_id, final_rank, CASE WHEN final_rank = 1 THEN rerank_score END AS score, {_NORM} AS norm FROM (SELECT item_id, final_rank, rerank_score, coalesce(text, '') || coalesce(' ' || lang, '') AS text FROM reranked WHERE final_rank <= 5)) GROUP BY item_id),
content AS (SELECT item_id, trim(text) AS bare, list_filter(regexp_split_to_array({_NORM}, '\s+'), lambda t: t <> '' AND (len(t) > 2 OR list_contains({_list([*GROUNDING_ACRONYMS, '6x1', '5x1', '5x2'])}, t)) AND NOT list_contains({_list(STOPWORDS)}, t) AND NOT list_contains({_list(CONVERSATIONAL)}, t)) AS kept FROM benchmark),
wanted_w AS (SELECT item_id, bare, list_concat(kept, flatten(list_transform(kept, lambda t: coalesce({_KNOWN}[t], [])))) AS w FROM content),
judged AS (SELECT item_id, confidence_score, bare <> '' AND CASE WHEN len(w) = 0 THEN confidence_score >= 0.25 ELSE NOT (len(list_filter(w, lambda t: contains(body, t))) / len(w)::DOUBLE < 0.25 AND confidence_score < 0.30) END AS supported FROM spoken JOIN wanted_w USING (item_id))
SELECT item_id, confidence_score, supported, confidence_score >= 0.35 AND supported AS confident FROM judged""")
def confidence_gate(spark, sf_dir):
    return answering.gated(_reranked(spark, sf_dir), "item_id")


@query()
def hash_embed(spark, sf_dir):
    return dense.embedded(_read(spark, sf_dir, "documents"), "doc_id")


# ---- grounding, routing, rendering, answers ----


_MONEY = r"(?i)R\$\s*\d{1,3}(?:\.\d{3})*(?:,\d+)?|R\$\s*\d+(?:[.,]\d+)?"


def _varied(spark, sf_dir):
    """Claims whose context changes one of their facts, or all words, by the line's key."""
    items = _read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 7)
    price, percent, days, shift, law = F.col("l_extendedprice"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), F.col("l_linenumber") % 6 + 1, F.col("l_linenumber")
    changed = lambda v, i: v + F.when(F.col("k") == i, 1).otherwise(0)
    spelled = lambda p: F.translate(F.format_string("%.2f", p), ".", ",")
    line = "%s %d custa R$ %s com %d%% em %d dias, escala %dx1, Art. %d."
    sentence = F.format_string(line, F.lit("Pedido"), "l_orderkey", spelled(price), percent, days, shift, law)
    context = F.format_string(line, F.when(F.col("k") == 6, "Nada").otherwise("Pedido"), "l_orderkey", spelled(changed(price, 1)), changed(percent, 2).cast("int"), changed(days, 3).cast("int"), changed(shift, 4), changed(law, 5))
    return items.select("l_orderkey", "l_linenumber", sentence.alias("sentence"), F.when(F.col("k") == 6, F.regexp_replace(context, "custa|com|dias|escala", "xis")).otherwise(context).alias("context"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS k, l_extendedprice AS price, round(l_discount * 100)::INT AS percent, l_quantity::INT AS days, l_linenumber % 6 + 1 AS shift, l_linenumber AS law FROM lineitem),
lost AS (SELECT *,
  CASE WHEN k = 1 AND regexp_extract(replace(printf('%.2f', price), '.', ','), '^\\d{1,3}(?:,\\d+)?') <> regexp_extract(replace(printf('%.2f', price + 1), '.', ','), '^\\d{1,3}(?:,\\d+)?')
    THEN ['R$ ' || regexp_extract(replace(printf('%.2f', price), '.', ','), '^\\d{1,3}(?:,\\d+)?')] ELSE [] END AS money,
  CASE WHEN k = 2 THEN [percent || '%'] ELSE [] END AS percents,
  CASE WHEN k = 3 AND days <> 0 THEN [days || ' dias'] WHEN k = 6 THEN [days || ' dias'] ELSE [] END AS spans,
  CASE WHEN k = 4 THEN ['escala ' || shift || 'x1'] ELSE [] END AS shifts,
  CASE WHEN k = 5 THEN ['Art. ' || law] ELSE [] END AS laws FROM v)
SELECT l_orderkey, l_linenumber, array_to_string(list_concat(shifts, money, percents, spans, laws), '|') AS ungrounded,
  len(list_concat(shifts, money, percents, spans, laws)) = 0 AS is_grounded,
  CASE WHEN len(list_concat(shifts, money, percents, spans, laws)) > 0 THEN 'unsupported_entities' ELSE 'grounded' END AS reason FROM lost""")
def verify_sentences(spark, sf_dir):
    found = grounding.verified(_varied(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", F.array_join("ungrounded", "|").alias("ungrounded"), "is_grounded", "reason")


@query()
def check_response(spark, sf_dir):
    """Whether a whole document is supported by the next one of its language among fifty successive ids, sentence by sentence."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    after = Window.partitionBy("lang", F.floor(F.col("doc_id") / 50)).orderBy("doc_id")
    docs = docs.select("doc_id", F.col("text").alias("answer"), F.coalesce(F.lead("text").over(after), F.lit("")).alias("context"))
    return grounding.checked(docs, "doc_id").drop("sentences")


_AUDIT = {"the": r"\bthe\b", "shift": r"\b[0-9] ?[xX] ?[0-9]\b", "percent": r"[0-9]+(?:[.,][0-9]+)?%", "license": "(?i)licen[sc]e"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '{v}'))), 0)::BIGINT AS n_matches, count(*) FILTER (regexp_matches(coalesce(text, ''), '{v}'))::BIGINT AS n_chunks FROM documents" for k, v in _AUDIT.items()))
def corpus_audit(spark, sf_dir):
    return store.audited(_read(spark, sf_dir, "documents"), _AUDIT)


@query("""WITH h AS (SELECT doc_id, doc_id // 4 AS question, source, lang, text FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS n FROM h)
SELECT question, string_agg('--- DOCUMENTO [' || n || '] ---' || chr(10) || 'Arquivo: ' || coalesce(source, 'N/A') || chr(10) || 'Seção: ' || coalesce(lang, 'N/A') || chr(10) || 'Páginas: ' || CASE WHEN doc_id % 2 = 0 THEN 'Pág. 1' ELSE 'Págs. 1-2' END || chr(10) || 'ID: ' || doc_id || chr(10) || 'Conteúdo:' || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || chr(10), chr(10) ORDER BY n) AS context FROM r GROUP BY question""")
def context_blocks(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("question", F.floor(F.col("doc_id") / 4))
    place = F.row_number().over(Window.partitionBy("question").orderBy("doc_id"))
    hits = docs.select("question", place.alias("final_rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("file_name"), F.col("lang").alias("section_title"), F.lit(1).alias("page_start"), (F.col("doc_id") % 2 + 1).cast("int").alias("page_end"), "text")
    return rendering.context_block(hits, "question")


_ROUTES = routing.DEFAULT


def _route_sql() -> str:
    norm = rf"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(q)), '{_PUNCT}', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    parts = []
    for i, (key, _, keywords, pattern) in enumerate(_ROUTES):
        terms = [f"CASE WHEN {'contains(norm, ' if ' ' in k else 'list_contains(tokens, '}'{k}') THEN {2.5 if ' ' in k else 1.0} ELSE 0.0 END" for k in keywords.split("|")]
        terms.append(f"CASE WHEN regexp_matches(q, '{pattern}') OR regexp_matches(norm, '{pattern}') THEN 3.0 ELSE 0.0 END")
        for k, wanted, without, bonus in routing.BONUSES:
            if k == key:
                terms.append(f"CASE WHEN list_has_any(tokens, {_list(wanted)})" + (f" AND NOT list_has_any(tokens, {_list(without)})" if without else "") + f" THEN {bonus} ELSE 0.0 END")
        parts.append(f"SELECT conv_id, turn, {i} AS o, '{key}' AS k, ({' + '.join(terms)})::DOUBLE AS s FROM t")
    return f"""WITH base AS (SELECT conv_id, turn, {_QUESTION_SQL} AS q FROM conversations WHERE role = 'user'), n AS (SELECT *, {norm} AS norm FROM base), t AS (SELECT *, string_split(norm, ' ') AS tokens FROM n),
scored AS ({' UNION ALL '.join(parts)}), best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, o) AS r FROM scored)
SELECT conv_id, turn, CASE WHEN s > 0 THEN k ELSE '{routing.FALLBACK}' END AS department_key, CASE WHEN s > 0 THEN s ELSE 0.0 END AS match_score FROM best WHERE r = 1"""


_TOPICS = ["Férias e salário", "Onde está meu pedido?", "nota fiscal XML", "fornecedor na doca com palete", "denúncia de assédio", "LGPD e cookies", "", "troca na loja do cliente"]
_QUESTION_SQL = f"coalesce({_list(_TOPICS)}[1 + (conv_id + turn) % {len(_TOPICS)}], '') || ' ' || coalesce(text, '')"


def _asked(spark, sf_dir):
    topic = F.element_at(F.array(*map(F.lit, _TOPICS)), (1 + (F.col("conv_id") + F.col("turn")) % len(_TOPICS)).cast("int"))
    return _read(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), F.concat(topic, F.lit(" "), F.coalesce("text", F.lit(""))).alias("query"))


@query(_route_sql())
def route_catalogue(spark, sf_dir):
    """By a catalogue that is a table."""
    return routing.routed_by_table(_asked(spark, sf_dir), routing.default_catalog(spark), "id").select("id.conv_id", "id.turn", "department_key", "match_score")


@query(_route_sql())
def route_intent(spark, sf_dir):
    catalog = [r.asDict() for r in routing.default_catalog(spark).collect()]
    return routing.routed(_asked(spark, sf_dir), catalog, "id").select("id.conv_id", "id.turn", "department_key", "match_score")


_CITE = """CASE doc_id % 3 WHEN 0 THEN '• Documento: ' || source || ' — Seção: ' || lang || ' (' || p || ')' WHEN 1 THEN '• *' || source || '* — Seção: _' || lang || '_ (`' || p || '`)' ELSE '• [Fonte: ' || source || ', Seção: ' || lang || ', ' || p || ']' END"""


@query(f"SELECT doc_id, {_CITE} AS line FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Pág. 1' ELSE 'Págs. 1-2' END AS p FROM documents)")
def render_citation(spark, sf_dir):
    channel = text.channel(F.element_at(F.array(F.lit("E-mail"), F.lit("Slack"), F.lit("web")), (F.col("doc_id") % 3 + 1).cast("int")))
    return _read(spark, sf_dir, "documents").select("doc_id", rendering.citation(channel, F.col("source"), F.col("lang"), start=F.lit(1), end=(F.col("doc_id") % 2 + 1).cast("int")).alias("line"))


@query("SELECT doc_id, '**[RESUMO]**' || chr(10) || 'Resumo ' || doc_id || chr(10) || chr(10) || '**[DETALHAMENTO]**' || chr(10) || CASE WHEN t = '' THEN 'Resumo ' || doc_id ELSE t END || chr(10) || chr(10) || '**[FONTES]**' || chr(10) || '• a' || chr(10) || '• b' AS message FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def render_channel(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    lines = F.array(F.lit("• a"), F.lit("• b"), F.lit("• a"))
    return docs.select("doc_id", rendering.response(F.lit("teams_slack"), F.concat(F.lit(" Resumo "), F.col("doc_id").cast("string")), F.col("text"), lines).alias("message"))


def _two_parts(parts: str, glue: str) -> str:
    """The summary and the rest of a list of parts in SQL."""
    a, merged = f"coalesce({parts}[1], '')", f"concat_ws(' ', coalesce({parts}[1], ''), {parts}[2])"
    rest = lambda k: f"array_to_string({parts}[{k}:], {glue})"
    return rf"CASE WHEN len({parts}) <= 1 THEN [{a}, {a}] WHEN len(regexp_split_to_array({a}, '\s+')) <= 4 THEN [{merged}, CASE WHEN len({parts}) > 2 THEN {rest(3)} ELSE {merged} END] ELSE [{a}, {rest(2)}] END"


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '<\s*strong\s*>(.*?)<\s*/\s*strong\s*>', '**\1**', 'gis'), '<\s*b\s*>(.*?)<\s*/\s*b\s*>', '**\1**', 'gis'), '<[^>]+>', '', 'g')"


@query(rf"""WITH plain AS (SELECT doc_id, {_bare(_PLAIN)} AS t FROM documents),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(t, {_GLUE}), lambda x: {_bare("x")}), lambda x: x <> '') AS p FROM plain),
sentences AS (SELECT doc_id, p, list_filter(list_transform(string_split(regexp_replace(coalesce(p[1], ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_bare("x")}), lambda x: x <> '') AS s FROM cut),
two AS (SELECT doc_id, CASE WHEN len(p) <= 1 THEN {_two_parts("s", "chr(10)")} ELSE {_two_parts("p", _GLUE)} END AS x FROM sentences)
SELECT doc_id, x[1] AS tldr, x[2] AS details FROM two""")
def summarize_answers(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", rendering.summary_and_details(F.col("text")).alias("x")).select("doc_id", "x.tldr", "x.details")


def _fallback_sql() -> str:
    values = [(k, n, f"Equipe de {n}", f"{k}@example.com", "0800-000-0000", "E-mail", "Dias úteis", "Escreva à equipe.") for k, n, _, _ in _ROUTES]
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in values)

    def filled(layout: str) -> str:
        out = "'" + layout.replace("{7}", rendering.fallback_opening()).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        for i, c in enumerate(("name", "who", "mail", "phone", "way", "hours", "todo")):
            out = f"replace({out}, '{{{i}}}', {c})"
        return out

    return f"""WITH r AS ({_route_sql()}), d(department_key, name, who, mail, phone, way, hours, todo) AS (VALUES {rows})
SELECT conv_id, turn, department_key, CASE turn // 2 % 3 WHEN 0 THEN {filled(rendering.FALLBACK['email'])} WHEN 1 THEN {filled(rendering.FALLBACK['teams_slack'])} ELSE {filled(rendering.FALLBACK['chat'])} END AS message
FROM r JOIN d USING (department_key)"""


@query(_fallback_sql())
def fallback_message(spark, sf_dir):
    """What every question of the conversations gets if nothing answers it, in the channels in turn."""
    catalog = routing.default_catalog(spark)
    names = F.element_at(F.array(F.lit(" Email"), F.lit("teams_slack"), F.lit("slack")), (F.floor(F.col("turn") / 2) % 3 + 1).cast("int"))
    desks = catalog.select("department_key", F.struct(*catalog.columns).alias("d"))
    return route_intent(spark, sf_dir).join(F.broadcast(desks), "department_key").select("conv_id", "turn", "department_key", rendering.fallback(names, F.col("d")).alias("message"))


@query()
def extractive_answer(spark, sf_dir):
    hits = _reranked(spark, sf_dir, 8).withColumns({"chunk_id": F.col("doc_id").cast("string"), "page_start": F.lit(1), "page_end": F.lit(1)})
    return answering.extracted(hits, "item_id").select("item_id", "answer", F.size("citations").alias("n_citations"), "supported")


@query()
def answer_pipeline(spark, sf_dir):
    hits = _reranked(spark, sf_dir, 8).withColumns({"chunk_id": F.col("doc_id").cast("string"), "page_start": F.lit(1), "page_end": F.lit(1)})
    asked = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    catalog = [r.asDict() for r in routing.default_catalog(spark).collect()]
    return plan.answered(asked, hits, catalog, "item_id").select("item_id", "outcome", "is_fallback", "confidence_score", "fallback_department", "answer", F.size("sources_used").alias("n_sources"), "hallucination_check.n_sentences")


@query(r"""WITH u AS (SELECT conv_id, turn, role, text, CASE WHEN role <> 'user' AND turn % 2 = 1 THEN (conv_id + turn) % 2 END AS thumb FROM conversations)
SELECT conv_id, count(*)::BIGINT AS n_messages, count(*) FILTER (role = 'user')::BIGINT AS n_questions, sum(thumb)::BIGINT AS thumbs_up, count(thumb)::BIGINT AS n_feedback,
  arg_min(CASE WHEN len(t) > 26 THEN regexp_replace(left(t, 26), '^\s+|\s+$', '', 'g') || '...' ELSE t END, turn) FILTER (role = 'user') AS title
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM u) GROUP BY conv_id""")
def session_feedback(spark, sf_dir):
    user = F.col("role") == "user"
    thumb = F.when(~user & (F.col("turn") % 2 == 1), (F.col("conv_id") + F.col("turn")) % 2)
    rows = _read(spark, sf_dir, "conversations").withColumn("thumb", thumb)
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count(F.when(user, 1)).alias("n_questions"), F.sum("thumb").alias("thumbs_up"), F.count("thumb").alias("n_feedback"), F.min_by(F.when(user, text.title(F.col("text"))), F.when(user, F.col("turn"))).alias("title")
    )


@query(r"""WITH u AS (SELECT conv_id, conv_id % 20 AS user, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations),
t AS (SELECT *, CASE WHEN len(t) > 26 THEN regexp_replace(left(t, 26), '^\s+|\s+$', '', 'g') || '...' ELSE t END AS title FROM u),
c AS (SELECT user, conv_id, count(*) FILTER (role = 'user') AS n, arg_min(title, turn) FILTER (role = 'user' AND title <> '') AS title FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY conv_id) + 1 AS number, conv_id = max(conv_id) OVER (PARTITION BY user) AS is_last FROM c),
one AS (SELECT user, 1 AS number, CASE WHEN count(*) FILTER (conv_id % 3 = 1) > 0 THEN 'de volta' END AS title, count(*) FILTER (conv_id % 3 = 1) AS n, bool_or(is_last AND (conv_id % 3 = 1 OR conv_id % 5 = 0)) AS is_active FROM k GROUP BY user),
every AS (SELECT * FROM one UNION ALL SELECT user, number, title, n, is_last AND conv_id % 3 <> 1 FROM k WHERE conv_id % 5 <> 0)
SELECT user::VARCHAR AS user, user || '-' || number AS session, coalesce(title, 'Nova Conversa') AS title, n::BIGINT AS n_questions, CASE WHEN is_active THEN 'active' ELSE 'open' END AS status FROM every""")
def session_replay(spark, sf_dir):
    """Twenty users replay the conversations: each starts a new session and asks its questions; after every third one the
    user goes back to the first session to ask once more, and every fifth session is deleted."""
    talk = _read(spark, sf_dir, "conversations").withColumn("user", (F.col("conv_id") % 20).cast("string"))
    own = talk.select("user", "conv_id").distinct().withColumn("number", F.row_number().over(Window.partitionBy("user").orderBy("conv_id")) + 1)
    event = lambda place, action, number=None, text=None: F.struct((F.col("conv_id") * 1_000_000 + place).alias("seq"), F.lit(action).alias("action"), F.concat_ws("-", "user", F.lit(number) if isinstance(number, int) else number).alias("session") if number is not None else F.lit(None).cast("string").alias("session"), F.lit(text).cast("string").alias("text"))
    back = F.when(F.col("conv_id") % 3 == 1, F.array(event(900_000, "switch", 1), event(900_001, "ask", text="de volta")))
    gone = F.when(F.col("conv_id") % 5 == 0, F.array(event(900_010, "delete", F.col("number"))))
    none = F.array().cast("array<struct<seq:bigint,action:string,session:string,text:string>>")
    acts = own.select("user", F.explode(F.concat(F.array(event(0, "new")), F.coalesce(back, none), F.coalesce(gone, none))).alias("e")).select("user", "e.*")
    asks = talk.where("role = 'user'").select("user", (F.col("conv_id") * 1_000_000 + 10 + F.col("turn")).alias("seq"), F.lit("ask").alias("action"), F.lit(None).cast("string").alias("session"), "text")
    found = sessions(acts.unionByName(asks)).where("status <> 'deleted'")
    return found.select("user", "session", "title", "n_questions", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
