"""All registered queries of the engine's own operators, each beside its SQL. ``documents`` serve as records (namespace = lang)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import filters, graph, graph_retrieval, hybrid, knn, records, text_index, threads
from .plans.planner import Catalogue, Planner, Store
from .session import kept, scratch_path
from .sources import records_io
from .streaming import ingest
from .tables import EDGES_SQL, edges, embeddings, labelled_records, load, nodes
from .tables import records as record_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- full text ----------------------------------------------------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
DOCS = f"d AS (SELECT lang AS namespace, doc_id::VARCHAR AS key, text AS payload, source, n_chars, doc_id, {TOKENS} AS tok FROM documents)"
TERMS = ("ther", "thin", "tion")
WORDS = " ".join(TERMS)


def bm25_sql(terms: tuple[str, ...], where: str = "true", hit: str = "true") -> str:
    """CTEs ending in ``r(namespace, key, score, ...)``: every hit with its score."""
    dfs = ", ".join(f"count(*) FILTER (list_contains(tok, '{t}')) AS df{i}" for i, t in enumerate(terms))
    tfs = ", ".join(f"len(list_filter(tok, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    parts = [f"(ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * len(tok) / avgdl)))" for i in range(len(terms))]
    cols = ", ".join(f"{p} AS part{i}" for i, p in enumerate(parts))
    return f"""{DOCS},
s AS (SELECT namespace, count(*) AS n, CASE WHEN sum(len(tok)) > 0 THEN sum(len(tok)) / count(*) ELSE 1.0 END AS avgdl, {dfs} FROM d GROUP BY namespace),
h AS (SELECT d.*, {tfs} FROM d),
r AS (SELECT h.*, n, avgdl, {", ".join(f"df{i}" for i in range(len(terms)))}, {cols}, round({" + ".join(parts)}, 6) AS score
  FROM h JOIN s USING (namespace) WHERE ({" OR ".join(f"tf{i} > 0" for i in range(len(terms)))}) AND {where} AND {hit})"""


@query(f"WITH {DOCS}, t AS (SELECT unnest(tok) AS token FROM d) SELECT token, count(*) AS tf FROM t GROUP BY token")
def tokenize_basic(spark: SparkSession, sf: str) -> DataFrame:
    return record_table(spark, sf).select(F.explode(T.tokens(F.col("payload"))).alias("token")).groupBy("token").agg(F.count("*").alias("tf"))


@query(
    f"""WITH {DOCS}, t AS (SELECT namespace, key, len(tok)::INTEGER AS doc_len, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM d)
SELECT namespace, key, token, count(*)::INTEGER AS tf, min(pos)::INTEGER AS first_pos, sum(pos)::BIGINT AS sum_pos, any_value(doc_len) AS doc_len FROM t GROUP BY ALL"""
    .replace("GROUP BY ALL", "GROUP BY namespace, key, token")
)
def postings_build(spark: SparkSession, sf: str) -> DataFrame:
    p = text_index.postings(record_table(spark, sf))
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("namespace", "key", "token", "tf", F.col("positions")[0].alias("first_pos"), total.alias("sum_pos"), "doc_len")


@query(f"WITH {DOCS}, t AS (SELECT namespace, unnest(list_distinct(tok)) AS token FROM d) SELECT namespace, token, count(*) AS df FROM t GROUP BY namespace, token")
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_index.term_stats(record_table(spark, sf))


@query(f"WITH {DOCS} SELECT namespace, count(*) AS doc_count, sum(len(tok))::BIGINT AS total_doc_len FROM d GROUP BY namespace")
def namespace_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_index.namespace_stats(record_table(spark, sf))


@query(f"WITH {DOCS} SELECT namespace, key, len(tok)::INTEGER AS doc_len FROM d")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_index.doc_stats(record_table(spark, sf))


@query(f"WITH {bm25_sql(TERMS, where="namespace = 'en'")} SELECT key, score FROM r ORDER BY score DESC, key LIMIT 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf).filter("namespace = 'en'")
    return text_index.bm25(own, WORDS, 10).select("key", "score")


@query(f"WITH {bm25_sql(('de', 'la', 'en'))} SELECT namespace, key, score FROM r ORDER BY score DESC, key LIMIT 50")
def bm25_multi_namespace(spark: SparkSession, sf: str) -> DataFrame:
    return text_index.bm25(record_table(spark, sf), "de la en", 50).select("namespace", "key", "score")


@query(f"WITH {bm25_sql(TERMS, where="namespace = 'en' AND source = 'src3'")} SELECT key, score FROM r ORDER BY score DESC, key LIMIT 20")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf).filter("namespace = 'en'")
    return text_index.bm25(own, WORDS, 20, F.col("source") == "src3").select("key", "score")


@query(f"WITH {bm25_sql(('for', 'of', 'the'), where="namespace = 'en'", hit="contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ')")} SELECT key, score FROM r ORDER BY score DESC, key LIMIT 25")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf).filter("namespace = 'en'")
    return text_index.bm25(own, 'for "of the"', 25).select("key", "score")


@query(f"WITH {bm25_sql(TERMS, where="namespace = 'en'")} SELECT key, score FROM r ORDER BY score DESC, key LIMIT 10")
def bm25_from_index(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf).filter("namespace = 'en'")
    p = text_index.postings(own)
    return text_index.bm25_from_index(p, text_index.namespace_stats(own), text_index.term_stats(own), text_index.plan(WORDS), 10).select("key", "score")


@query(
    f"""WITH {bm25_sql(TERMS, where="namespace = 'en'")}, top AS (SELECT * FROM r ORDER BY score DESC, key LIMIT 10)
{" UNION ALL ".join(f"SELECT key, '{t}' AS term, tf{i}::INTEGER AS tf, df{i}::BIGINT AS df, len(tok)::INTEGER AS doc_len, round(part{i}, 6) AS contribution FROM top WHERE tf{i} > 0" for i, t in enumerate(TERMS))}"""
)
def bm25_explain(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf).filter("namespace = 'en'")
    return text_index.explained(own, WORDS, 10).select("key", "term", "tf", "df", "doc_len", "contribution")


@query(
    f"""WITH {DOCS}, t AS (SELECT namespace, key, unnest(tok) AS token FROM d), p AS (SELECT namespace, key, token, count(*) AS tf FROM t GROUP BY namespace, key, token)
SELECT count(*) FILTER (token = 'ther') AS missing, 0::BIGINT AS unexpected, count(*) FILTER (token = 'tion') AS tf_errors, 0::BIGINT AS position_errors, 0::BIGINT AS doc_len_errors FROM p"""
)
def text_index_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A damaged index: one token's postings are gone and another's counts are off."""
    p = text_index.postings(record_table(spark, sf))
    damaged = p.filter("token <> 'ther'").withColumn("tf", F.when(F.col("token") == "tion", F.col("tf") + 1).otherwise(F.col("tf")))
    return text_index.audit(p, damaged)


@query(
    f"""WITH {DOCS}, t AS (SELECT namespace, key, unnest(tok) AS token FROM d), p AS (SELECT DISTINCT namespace, key, token FROM t)
SELECT CASE token WHEN 'ther' THEN 'added' WHEN 'tion' THEN 'rewritten' ELSE 'kept' END AS repair, count(*) AS n FROM p GROUP BY 1"""
)
def text_index_repair(spark: SparkSession, sf: str) -> DataFrame:
    p = text_index.postings(record_table(spark, sf))
    damaged = p.filter("token <> 'ther'").withColumn("tf", F.when(F.col("token") == "tion", F.col("tf") + 1).otherwise(F.col("tf")))
    return text_index.repaired(p, damaged).groupBy("repair").agg(F.count("*").alias("n"))


def _maintained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The index before: French records with other texts, no German ones, and a namespace that is deleted. Then the changes to what is now."""
    now = record_table(spark, sf).select("namespace", "key", "payload")
    before = now.filter("not namespace <=> 'de'").withColumn("payload", F.when(F.col("namespace") == "fr", F.concat(F.lit("earlier "), F.reverse("payload"))).otherwise(F.col("payload")))
    gone = now.filter("namespace = 'es'").withColumn("namespace", F.lit("gone"))
    before = before.unionByName(gone)
    return text_index.maintained(text_index.postings(before), text_index.doc_stats(before), now.filter("namespace in ('de', 'fr')"), gone)


@query(
    f"""WITH {DOCS}, t AS (SELECT namespace, key, len(tok)::INTEGER AS doc_len, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM d)
SELECT namespace, key, token, count(*)::INTEGER AS tf, sum(pos)::BIGINT AS sum_pos, any_value(doc_len) AS doc_len FROM t GROUP BY namespace, key, token"""
)
def postings_incremental(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)
    return _maintained(spark, sf)[0].select("namespace", "key", "token", "tf", total.alias("sum_pos"), "doc_len")


@query(f"WITH {DOCS} SELECT namespace, count(*) AS doc_count, sum(len(tok))::BIGINT AS total_doc_len FROM d GROUP BY namespace")
def namespace_stats_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return text_index.stats_of(_maintained(spark, sf)[1])


_BLANKS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_MARKED = rf"regexp_replace({{}}, '({T.any_form('ther')}|{T.any_form('tion')})', '<strong>\1</strong>', 'g')"


@query(
    f"""WITH p AS (SELECT doc_id::VARCHAR AS key, text AS t, greatest(strpos(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}'), 'ther'), 1) AS place FROM documents),
w AS (SELECT key, t, greatest(place - 48, 1) AS b, least(place + 4 + 72, length(t) + 1) AS e FROM p)
SELECT key, CASE WHEN strlen(t) <= 120 THEN {_MARKED.format('t')} ELSE CASE WHEN b > 1 THEN '...' ELSE '' END
  || {_MARKED.format(f"regexp_replace(substring(t, b, e - b), '{_BLANKS}', '', 'g')")} || CASE WHEN e <= length(t) THEN '...' ELSE '' END END AS snippet FROM w"""
)
def snippet_basic(spark: SparkSession, sf: str) -> DataFrame:
    own = record_table(spark, sf)
    return own.select("key", T.snippet(F.col("payload"), ["tion", "ther"], highlight=True).alias("snippet"))


@query()
def tokenize_advanced(spark: SparkSession, sf: str) -> DataFrame:
    own = load(spark, sf, "pages").select("page_id", T.advanced_tokens(F.col("html")).alias("tokens"))
    return own.select("page_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("tf"), F.countDistinct("page_id").alias("df"))


@query(f"SELECT page_id, len({TOKENS.replace('text', 'html')})::INTEGER AS n_tokens FROM pages")
def tokenize_pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.size(T.tokens(F.col("html"))).alias("n_tokens"))


@query(f"SELECT doc_id, translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS folded FROM documents")
def fold_accents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


# --- vectors ------------------------------------------------------------------------------------------------------------------------

QV = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "round(list_cosine_similarity(e, q), 6)"


def _vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    return [float(x) for x in embeddings(spark, sf).filter(F.col("vec_id") == vec_id).select("embedding").head()[0]]


@query(f"WITH {QV} SELECT vec_id, {COS} AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top(embeddings(spark, sf), _vector(spark, sf), 10).select("vec_id", "score")


@query(f"WITH {QV} SELECT vec_id, round(-list_distance(e, q), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 10")
def knn_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top(embeddings(spark, sf), _vector(spark, sf), 10, metric="euclidean").select("vec_id", (F.col("score") + F.lit(0.0)).alias("score"))


@query(f"WITH {QV} SELECT vec_id, {COS} AS score FROM v, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered_label(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top(embeddings(spark, sf), _vector(spark, sf), 10, keep=F.col("label") == 3).select("vec_id", "score")


@query(f"WITH {QV} SELECT vec_id, {COS} AS score FROM v, q WHERE {COS} >= 0.2 ORDER BY score DESC, vec_id LIMIT 100")
def knn_min_score(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top(embeddings(spark, sf), _vector(spark, sf), 100, least=0.2).select("vec_id", "score")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_cosine_similarity(a.e, b.e), 6) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM s)
SELECT query_id, key, score, rank FROM r WHERE rank <= 5"""
)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return knn.batch(e, e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, skip_self=True)


@query(f"WITH {QV} SELECT vec_id, {COS} AS score FROM v, q WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 10")
def similar_to_key(spark: SparkSession, sf: str) -> DataFrame:
    return knn.similar_to_key(embeddings(spark, sf), 7, 10).select("vec_id", "score")


@query(f"WITH {QV} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e, q), 6) AS product, round(list_dot_product(e, e) + list_dot_product(q, q) - 2 * list_dot_product(e, q), 4) AS squared FROM v, q")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    e, q = F.col("embedding"), V.literal(_vector(spark, sf))
    a = embeddings(spark, sf).select("vec_id", V.norm(e).alias("n"), V.norm(q).alias("m"), V.dot(e, q).alias("p"))
    return a.select("vec_id", F.round("n", 6).alias("norm"), F.round("p", 6).alias("product"), F.round(V.squared_l2_from_norms(F.col("n"), F.col("m"), F.col("p")), 4).alias("squared"))


def _coded_sql(levels: int, low: int) -> str:
    half = f"list_transform(e, lambda x: greatest(least(sign(x) * floor(abs(x * {levels} / m) + 0.5), {levels}), {low}))"
    return f"""WITH {QV}, c AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM v), k AS (SELECT vec_id, m, {half} AS c FROM c),
z AS (SELECT m AS qm, c AS qc FROM k WHERE vec_id = 7)
SELECT vec_id, round(list_dot_product(c, qc) * m * qm / {levels * levels}.0, 6) AS score FROM k, z ORDER BY score DESC, vec_id LIMIT 10"""


@query(_coded_sql(127, -127))
def sq8_knn(spark: SparkSession, sf: str) -> DataFrame:
    q = V.sq8(V.literal(_vector(spark, sf)))
    a = embeddings(spark, sf).select("vec_id", F.round(V.sq8_dot(V.sq8(F.col("embedding")), q), 6).alias("score"))
    return a.orderBy(F.desc("score"), "vec_id").limit(10)


@query(_coded_sql(7, -8))
def turbo4_knn(spark: SparkSession, sf: str) -> DataFrame:
    q = V.four_bit(V.literal(_vector(spark, sf)))
    a = embeddings(spark, sf).select("vec_id", F.round(V.four_bit_dot(V.four_bit(F.col("embedding")), q), 6).alias("score"))
    return a.orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    f"""WITH {QV}, p AS (SELECT vec_id, list_sum(list_transform(generate_series(1, len(e)), lambda i: CASE WHEN (e[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END)) AS h FROM v, q)
SELECT vec_id, round(1 - h / 64.0, 6) AS score FROM p ORDER BY score DESC, vec_id LIMIT 10"""
)
def binary_hamming_knn(spark: SparkSession, sf: str) -> DataFrame:
    q = V.sign_bits(V.literal(_vector(spark, sf)))
    a = embeddings(spark, sf).select("vec_id", V.sign_bits(F.col("embedding")).alias("b"), q.alias("q"))
    return a.select("vec_id", F.round(V.sign_likeness(F.col("b"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH {QV} SELECT vec_id, {COS} AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 10")
def two_stage_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return knn.two_stage(embeddings(spark, sf), _vector(spark, sf), 10).select("vec_id", "score")


@query(
    """WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT dim::INTEGER AS dim, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM x GROUP BY dim"""
)
def dimension_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return knn.ranges(embeddings(spark, sf)).select("dim", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    f"""WITH {QV}, s AS (SELECT 'cosine' AS metric, vec_id, {COS} AS score FROM v, q UNION ALL SELECT 'euclidean', vec_id, -round(list_distance(e, q), 6) FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, vec_id) AS n FROM s)
SELECT kind, metric, vec_id, score FROM r, (VALUES ('flat'), ('scann')) AS k(kind) WHERE n <= 10"""
)
def index_kinds(spark: SparkSession, sf: str) -> DataFrame:
    e, q, out = embeddings(spark, sf), _vector(spark, sf), None
    for kind in ("flat", "scann"):
        for metric in ("cosine", "euclidean"):
            found = knn.make_index(kind, e, metric=metric).search(q, 10)
            found = found.select(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), "vec_id", "score")
            out = found if out is None else out.unionByName(found)
    return out


@query()
def ivf_knn(spark: SparkSession, sf: str) -> DataFrame:
    return knn.Inverted.build(embeddings(spark, sf)).search(_vector(spark, sf), 10).select("vec_id", "score")


@query()
def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return knn.mmr(embeddings(spark, sf), _vector(spark, sf), 4)


def _hadamard(k: int) -> str:
    """The k-th value by the matrix's definition: signs by the parity of common bits."""
    return f"round(list_sum(list_transform(range(64), lambda i: e[i + 1] * CASE WHEN bit_count(i & {k}) % 2 = 1 THEN -1 ELSE 1 END)) / 8, 5) AS v{k}"


@query(f"WITH {QV} SELECT vec_id, {', '.join(map(_hadamard, (0, 1, 7, 42, 63)))} FROM v")
def fwht_values(spark: SparkSession, sf: str) -> DataFrame:
    w = embeddings(spark, sf).select("vec_id", V.fwht(F.col("embedding")).alias("w"))
    return w.select("vec_id", *[(F.round(F.col("w")[k], 5) + F.lit(0.0)).alias(f"v{k}") for k in (0, 1, 7, 42, 63)])


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round(-list_distance(a.e, b.e), 6) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM s)
SELECT query_id, key, score, rank FROM r WHERE rank <= 5"""
)
def knn_batch_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return knn.batch(e, e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, metric="euclidean", skip_self=True)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def fwht_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The transform is orthonormal: it keeps norms."""
    return embeddings(spark, sf).select("vec_id", F.round(V.norm(V.fwht(F.col("embedding"))), 5).alias("norm"))


# --- hybrid -------------------------------------------------------------------------------------------------------------------------

JOINED = """w AS (SELECT lang AS namespace, doc_id::VARCHAR AS key, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON doc_id = vec_id),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"""
ARMS = f"""WITH {bm25_sql(TERMS)}, {JOINED},
t AS (SELECT namespace, key, score FROM r ORDER BY score DESC, key, namespace LIMIT 40),
u AS (SELECT namespace, key, round(list_cosine_similarity(e, q), 6) AS score FROM w, q ORDER BY score DESC, key LIMIT 40),
a AS (SELECT namespace, key, row_number() OVER (ORDER BY score DESC, key, namespace) - 1 AS place, 0 AS arm FROM t
  UNION ALL SELECT namespace, key, row_number() OVER (ORDER BY score DESC, key, namespace) - 1, 1 FROM u)"""


def _with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    return record_table(spark, sf).join(e, "doc_id", "left")


def _arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both candidate lists: the vector arm starts from the smaller side, which has vectors."""
    own = record_table(spark, sf)
    lexical = text_index.bm25(own, WORDS, hybrid.budget(10)).select("namespace", "key", "score")
    e = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    near = knn.top(own.select("namespace", "key", "doc_id").join(e, "doc_id"), _vector(spark, sf), hybrid.budget(10), "key").select("namespace", "key", "score")
    return lexical, near


@query(f"{ARMS} SELECT namespace, key, round(sum(1.0 / (61 + place)), 6) AS rrf_score FROM a GROUP BY namespace, key ORDER BY rrf_score DESC, key, namespace LIMIT 10")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.fused(*_arms(spark, sf), k=10).select("namespace", "key", "rrf_score")


@query(
    f"""{ARMS} SELECT namespace, key, round(sum(1.0 / (61 + place)), 6) AS rrf_score, max(place + 1) FILTER (arm = 0)::INTEGER AS rank_0, max(place + 1) FILTER (arm = 1)::INTEGER AS rank_1
FROM a GROUP BY namespace, key ORDER BY rrf_score DESC, key, namespace LIMIT 10"""
)
def rrf_explain(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.fused(*_arms(spark, sf), k=10)


@query(f"{ARMS} SELECT namespace, key, round(sum(1.0 / (60 + place)), 6) AS rrf_score FROM a GROUP BY namespace, key ORDER BY rrf_score DESC, key, namespace LIMIT 10")
def rrf_adapter_offset(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.fused(*_arms(spark, sf), k=10, offset=0).select("namespace", "key", "rrf_score")


@query(f"{ARMS} SELECT namespace, key, round(sum(1.0 / (61 + place)), 6) AS score FROM a GROUP BY namespace, key ORDER BY score DESC, key, namespace LIMIT 10")
def search_request(spark: SparkSession, sf: str) -> DataFrame:
    """A request with a text and a vector takes the hybrid route."""
    return hybrid.search(_with_vectors(spark, sf), WORDS, _vector(spark, sf), 10).select("namespace", "key", "score")


@query(f"{ARMS} SELECT (SELECT count(*) FROM t) AS text_candidates, (SELECT count(*) FROM u) AS vector_candidates, (SELECT count(*) FROM (SELECT DISTINCT namespace, key FROM a)) AS fused_candidates, 60 AS rrf_k")
def fusion_report(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.fusion_report(*_arms(spark, sf))


@query(f"WITH {bm25_sql(('la', 'the', 'und'), where="namespace IN ('en', 'fr')")}, p AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, key) AS k FROM r) SELECT namespace, key, score FROM p WHERE k <= 10 ORDER BY score DESC, namespace, key LIMIT 10")
def search_multi(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.search_multi(record_table(spark, sf), ["en", "fr"], "la the und", 10).select("namespace", "key", "score")


@query(f"WITH {bm25_sql(('la', 'the', 'und'))}, p AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, key) AS k FROM r) SELECT namespace, key, score FROM p WHERE k <= 20 ORDER BY score DESC, namespace, key LIMIT 20")
def search_all(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.search_multi(record_table(spark, sf), None, "la the und", 20).select("namespace", "key", "score")


RANKED = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, a.label = b.label AS hit,
  round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s), j AS (SELECT query_id, count(*) AS relevant FROM s WHERE hit GROUP BY query_id),
m AS (SELECT query_id, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (hit) AS first, count(*) FILTER (hit) AS hits FROM r WHERE rank <= 10 GROUP BY query_id),
o AS (SELECT query_id, round(dcg / list_sum(list_transform(generate_series(1, least(relevant, 10)), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(hits / relevant, 6) AS recall FROM m JOIN j USING (query_id))"""


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the same label count as relevant."""
    e = embeddings(spark, sf)
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("own"))
    ranked = kept(knn.batch(e, q, 10, skip_self=True))  # read twice
    labels = e.select(F.col("vec_id").alias("key"), "label")
    hits = ranked.join(q.select("query_id", "own"), "query_id").join(labels, "key").filter("own = label").select("query_id", "key")
    sizes = labels.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("relevant"))
    return hybrid.quality(ranked, hits, 10, q.join(sizes, "own").filter("relevant > 0").select("query_id", "relevant"))


@query(f"{RANKED} SELECT query_id, ndcg FROM o")
def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("query_id", "ndcg")


@query(f"{RANKED} SELECT query_id, mrr FROM o")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("query_id", "mrr")


@query(f"{RANKED} SELECT query_id, recall FROM o")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("query_id", "recall")


# --- records ------------------------------------------------------------------------------------------------------------------------

REC = "r AS (SELECT lang AS namespace, documents.doc_id::VARCHAR AS key, text AS payload, source, n_chars, documents.doc_id, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"
NOW = "timestamp'2024-01-15 00:00:00'"


@query(f"WITH {REC} SELECT namespace, key, source, n_chars FROM r WHERE namespace = 'en' AND key = '14'")
def get_record(spark: SparkSession, sf: str) -> DataFrame:
    return records.get(record_table(spark, sf), "en", "14").select("namespace", "key", "source", "n_chars")


@query(f"WITH {REC} SELECT key, source FROM r WHERE namespace = 'fr' AND n_chars > 500 ORDER BY key LIMIT 20 OFFSET 10")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    return records.list_page(record_table(spark, sf), "fr", 20, 10, {"n_chars": {"$gt": 500}}).select("key", "source")


@query(f"WITH {REC} SELECT key, source FROM r WHERE namespace = 'fr' AND key > '300' ORDER BY key LIMIT 20")
def list_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return records.list_after(record_table(spark, sf), "fr", "300", 20).select("key", "source")


@query(f"WITH {REC} SELECT DISTINCT namespace FROM r")
def list_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return records.namespaces(record_table(spark, sf))


@query(f"WITH {REC} SELECT count(*) AS n FROM r WHERE source = 'src0' AND quality = 1")
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    a = labelled_records(spark, sf)
    return a.filter(filters.matches(a, {"source": "src0", "quality": 1})).agg(F.count("*").alias("n"))


@query(f"WITH {REC} SELECT key FROM r WHERE n_chars > 100 AND n_chars <= 5000 AND n_chars >= 101 AND n_chars < 4999 AND source <> 'src1' AND toxic = 0")
def filter_ops_all(spark: SparkSession, sf: str) -> DataFrame:
    a = labelled_records(spark, sf)
    spec = filters.parsed('{"n_chars": {"$gt": 100, "$lte": 5000, "$gte": 101, "$lt": 4999}, "source": {"$neq": "src1"}, "toxic": 0}')
    return a.filter(filters.matches(a, spec)).select("key")


@query(f"WITH {REC} SELECT key FROM r WHERE quality IS NULL OR quality <> 1")
def filter_missing_neq_ql(spark: SparkSession, sf: str) -> DataFrame:
    a = labelled_records(spark, sf)
    return a.filter(filters.language_compare("quality", "!=", 1, a)).select("key")


@query(f"WITH {REC} SELECT key FROM r WHERE quality <> 1")
def filter_missing_neq_sdk(spark: SparkSession, sf: str) -> DataFrame:
    a = labelled_records(spark, sf)
    return a.filter(filters.compare(a, "quality", "$neq", 1)).select("key")


@query(f"WITH {REC} SELECT key FROM r WHERE (source IN ('src1', 'src2') OR n_chars > 9000) AND NOT coalesce(quality = 0, false) AND NOT coalesce(namespace IN ('de'), false)")
def filter_or_not_in(spark: SparkSession, sf: str) -> DataFrame:
    a = labelled_records(spark, sf)
    either = {"operator": "OR", "conditions": [{"field": "source", "operator": "in", "value": ["src1", "src2"]}, {"field": "n_chars", "operator": ">", "value": 9000}]}
    no = {"operator": "NOT", "conditions": [{"field": "quality", "operator": "==", "value": 0}]}
    return a.filter(filters.tree(a, {"operator": "AND", "conditions": [either, no, {"field": "meta.namespace", "operator": "not in", "value": ["de"]}]})).select("key")


@query("SELECT lang AS namespace, count(*) AS total_records, sum(strlen(text))::BIGINT AS total_bytes, count(embedding) AS vector_count, min(doc_id) AS first_created FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return records.collection_stats(_with_vectors(spark, sf), F.octet_length("payload").cast("long"), F.col("embedding"), F.col("doc_id"))


@query(f"WITH {REC} SELECT key, doc_id FROM r WHERE key IN ('1', '2', '3', '5', '8') AND namespace = 'en'")
def get_many(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.range(1, numPartitions=1).select(F.lit("en").alias("namespace"), F.explode(F.array(*[F.lit(x) for x in ("1", "2", "3", "5", "8")])).alias("key"))
    return records.get_many(record_table(spark, sf), keys).select("key", "doc_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest(load(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type", "value")


@query(f"WITH {REC} SELECT key, namespace FROM r WHERE NOT (namespace = 'en' AND source = 'src2')")
def delete_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    return records.delete_by_filter(record_table(spark, sf), "en", {"source": "src2"}).select("key", "namespace")


@query(
    """WITH d AS (SELECT lang AS namespace, doc_id::VARCHAR AS key, text AS payload, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), s AS (SELECT * FROM d WHERE namespace IN ('en', 'fr')),
i AS (SELECT * FROM d WHERE source = 'src1')
SELECT namespace, key, CASE WHEN i.source IS NULL THEN s.payload ELSE 'new ' || i.source END AS payload, CASE WHEN i.source IS NOT NULL AND s.source IS NOT NULL THEN 2 ELSE 1 END AS version,
  CASE WHEN s.source IS NULL THEN 2 ELSE 1 END AS created_at, CASE WHEN i.source IS NULL THEN 1 ELSE 2 END AS updated_at FROM s FULL JOIN i USING (namespace, key)"""
)
def put_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of new payloads over a store: records that were there get a second version, others their first."""
    own = record_table(spark, sf).filter("namespace is not null and source is not null").select("namespace", "key", "payload", "source")
    store = own.filter("namespace in ('en', 'fr')").select("namespace", "key", "payload", F.lit(1).alias("version"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    batch = own.filter("source = 'src1'").select("namespace", "key", F.concat(F.lit("new "), "source").alias("payload"))
    return records.latest(records.put(store, batch, F.lit(2))).select("namespace", "key", "payload", "version", "created_at", "updated_at")


@query(
    """WITH v AS (SELECT vec_id, label % 2 = 0 AS quantized FROM embeddings), a AS (SELECT user_id AS vec_id, epoch_us(ts) // 3600000000 AS tick FROM events WHERE user_id IS NOT NULL),
s AS (SELECT vec_id, count(*) AS hits, max(tick) AS last FROM a GROUP BY vec_id), x AS (SELECT max(tick) AS now FROM a)
SELECT vec_id, CASE WHEN NOT quantized AND (last IS NULL OR now - last > 100) THEN 'quantize' WHEN quantized AND hits >= 5 THEN 'promote' ELSE 'none' END AS action FROM v LEFT JOIN s USING (vec_id), x"""
)
def quantization_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as reads of vectors, hours as ticks."""
    read = load(spark, sf, "events").filter("user_id is not null").select(F.col("user_id").alias("vec_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("tick"))
    now = read.agg(F.max("tick")).head()[0] or 0
    return knn.format_actions(load(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("quantized")), read, now)


@query(
    f"""WITH {DOCS}, t AS (SELECT doc_id, unnest(tok) AS token FROM d), h AS (SELECT doc_id, md5(token) AS c FROM t),
s AS (SELECT doc_id, ('0x' || c[1:6])::BIGINT % 64 AS dim, sum(CASE WHEN c[7] < '8' THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE v <> 0"""
)
def offline_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed embeddings of all texts; what isn't zero, by dimension."""
    words = record_table(spark, sf).select("doc_id", F.explode(T.tokens(F.col("payload"))).alias("token"))
    return V.hashed(words, "doc_id", "token").select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


TTL = "e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL 7 DAY END AS expires FROM events), x AS (SELECT max(ts) - INTERVAL 3 DAY AS now FROM events)"


def _expiring(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts") - F.expr("INTERVAL 3 DAY")).head()[0]
    return e.withColumn("expires_at", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 7 DAY"))), F.lit(now)


@query(f"WITH {TTL} SELECT event_id FROM e, x WHERE expires IS NULL OR expires >= now")
def ttl_visible(spark: SparkSession, sf: str) -> DataFrame:
    a, now = _expiring(spark, sf)
    return records.visible(a, now).select("event_id")


@query(f"WITH {TTL} SELECT event_id FROM e, x WHERE expires < now")
def ttl_purged(spark: SparkSession, sf: str) -> DataFrame:
    a, now = _expiring(spark, sf)
    return records.purged(a, now)[1].select("event_id")


@query(
    """WITH v AS (SELECT event_id, user_id, ts AS created, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS deleted FROM events), x AS (SELECT median(epoch_us(ts)) AS m FROM events)
SELECT user_id, event_id FROM v, x WHERE epoch_us(created) <= m AND (deleted IS NULL OR epoch_us(deleted) > m)"""
)
def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    """Each event supersedes its user's one before: what held at the middle of all times."""
    from pyspark.sql import Window

    e = load(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    v = e.select("event_id", "user_id", F.col("at").alias("created_at"), F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("deleted_at"))
    middle = e.agg(F.median("at")).head()[0]
    return records.snapshot(v, F.lit(middle)).select("user_id", "event_id")


@query("WITH m AS (SELECT quantile_disc(epoch_us(ts), 0.5) AS m FROM events) SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events, m WHERE epoch_us(ts) <= m GROUP BY user_id")
def point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    middle = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY at)")).head()[0]
    return records_io.replay(e, F.lit(middle), "user_id", "at").select("user_id", "event_id")


@query(
    """WITH n AS (SELECT user_id, count(*) AS hits, coalesce(avg(value), 0) AS c, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1000000.0 AS age FROM events GROUP BY user_id),
s AS (SELECT user_id, round(hits + 2 * c + 3 * 0.1 + 1 / ln(1 + greatest(age, 1.0)), 6) AS score FROM n)
SELECT user_id, score FROM s ORDER BY score, user_id LIMIT (SELECT (count(*) * 0.2)::INTEGER FROM n)"""
)
def eviction_ranking(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    last = e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).head()[0]
    n = e.groupBy("user_id").agg(F.count("*").alias("hits"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("c"), ((F.lit(last) - F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6).alias("age"))
    return records.evict(n, records.keep_score(F.col("hits"), F.col("c"), F.lit(0.1), F.col("age")), 0.2, "user_id").select("user_id", "score")


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS item FROM lineitem), o AS (SELECT g, (row_number() OVER (ORDER BY g) - 1) // 1000 AS epoch FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT g, item, (SELECT max(epoch) FROM o) - epoch AS age FROM s JOIN o USING (g)),
p AS (SELECT a.item AS a, b.item AS b, floor(sum(pow(0.5, a.age)))::BIGINT AS n FROM t a JOIN t b ON a.g = b.g AND a.item < b.item GROUP BY 1, 2 HAVING sum(pow(0.5, a.age)) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p) SELECT a, b, n FROM r WHERE k <= 8"""
)
def co_access_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that orders name together, orders as sessions in the order of their keys."""
    return records.co_access(load(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query(
    """WITH d AS (SELECT unnest([{'field': 'lang', 'value': lang}, {'field': 'source', 'value': source}, {'field': 'n_chars', 'value': n_chars::VARCHAR}], recursive := true) FROM documents),
n AS (SELECT field, value, count(*) AS n FROM d GROUP BY field, value),
r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY field), 6) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS k FROM n)
SELECT field, value, n, share FROM r WHERE k <= 100"""
)
def cardinality_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return records.cardinality(load(spark, sf, "documents"), ["lang", "source", "n_chars"])


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, max(n) AS collisions, round(sum(value * (0.2 * pow(0.8, n - i) + CASE WHEN i = 1 THEN pow(0.8, n) ELSE 0 END)), 6) AS ema FROM r GROUP BY event_type)
SELECT event_type, collisions, ema, round(log2(collisions + 1) * ema, 6) AS friction FROM s"""
)
def origin_friction(spark: SparkSession, sf: str) -> DataFrame:
    return records.friction(load(spark, sf, "events"), "event_type", "value", "event_id")


@query("SELECT event_id FROM events WHERE (event_id & 5) = 5")
def scan_bitset(spark: SparkSession, sf: str) -> DataFrame:
    return records.bitset_superset(load(spark, sf, "events"), "event_id", 5).select("event_id")


@query("SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 50 OFFSET 5")
def thread_list(spark: SparkSession, sf: str) -> DataFrame:
    return records.threads(load(spark, sf, "conversations"), 50, 5)


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 11")
def thread_messages(spark: SparkSession, sf: str) -> DataFrame:
    return records.thread(load(spark, sf, "conversations"), 11).select("turn", "role", "text")


@query(
    """WITH m AS (SELECT conv_id, turn, turn * 60 AS sent_at FROM conversations WHERE conv_id IS NOT NULL), t AS (SELECT DISTINCT conv_id, (conv_id % 4) * 100 AS ttl FROM m WHERE conv_id % 5 > 0),
s AS (SELECT conv_id, ttl, greatest(max(sent_at), 10) AS updated_at, count(*) AS n_messages FROM t JOIN m USING (conv_id) GROUP BY conv_id, ttl),
k AS (SELECT *, CASE WHEN ttl > 0 THEN updated_at + ttl END AS expires_at FROM s)
SELECT conv_id AS thread_id, n_messages, updated_at, expires_at, (SELECT count(*) FROM m WHERE conv_id % 5 = 0) AS refused FROM k WHERE conv_id > 3 AND (expires_at IS NULL OR expires_at >= 300)"""
)
def thread_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Threads for four of five conversations, created at 10; all turns sent, a minute each; three threads deleted; expired ones purged at 300."""
    turns = load(spark, sf, "conversations").filter("conv_id is not null").select(F.col("conv_id").alias("thread_id"), "role", F.col("text").alias("content"), (F.col("turn") * 60).alias("at"))
    new = turns.select("thread_id").distinct().filter("thread_id % 5 > 0").withColumn("title", F.lit("talk")).withColumn("ttl", F.col("thread_id") % 4 * 100)
    none = spark.createDataFrame([], "thread_id long, title string, created_at long, updated_at long, ttl long, expires_at long")
    opened = threads.created(none, new, F.lit(10).cast("long"))
    own, messages, refused = threads.sent(opened, spark.createDataFrame([], turns.schema), turns)
    own, messages = threads.deleted(own, messages, own.filter("thread_id <= 3"))
    own, messages = threads.purged(own, messages, F.lit(300))
    n = messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"))
    return own.join(n, "thread_id").select("thread_id", "n_messages", "updated_at", "expires_at").crossJoin(refused.agg(F.count("*").alias("refused")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def rfc3339_times(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", T.rfc3339(F.col("ts")).alias("at"))


@query(r"SELECT conv_id, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words FROM conversations GROUP BY conv_id")
def transcript_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))


@query(f"WITH {REC} SELECT namespace, key, n_chars FROM r")
def export_import_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Out as JSON lines and in again."""
    own = record_table(spark, sf).select("namespace", "key", "payload", "n_chars")
    path = scratch_path(spark, "jsonl")
    records_io.export_jsonl(own, path)
    good, _ = records_io.import_jsonl(spark, path, own.schema)
    return kept(good.select("namespace", "key", "n_chars"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT event_id, event_type, value FROM events) GROUP BY event_type")
def stream_ingest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream, repeats dropped, into a table by micro-batch."""
    path = scratch_path(spark, "stream")
    schema = load(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    ingest.upsert(ingest.deduplicated(stream, "event_id", "ts", "3650 days"), f"{path}/out", f"{path}/state", ("event_id",)).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by hour and type, kept up by micro-batches."""
    path = scratch_path(spark, "windowed")
    ingest.complete(ingest.windowed(_event_stream(spark, sf), "ts", "event_type"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_micros("window.start").alias("hour"), "event_type", "n")


@query("SELECT user_id::VARCHAR AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Custom state by user; the last emission of each counts."""
    path = scratch_path(spark, "totals")
    ingest.upsert(ingest.running_totals(_event_stream(spark, sf), "user_id", "value"), f"{path}/out", f"{path}/state", ("key",), mode="update").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("key").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


# --- query language -----------------------------------------------------------------------------------------------------------------


def _planner(spark: SparkSession, sf: str) -> Planner:
    names = ("customer", "nation", "region", "part", "orders", "supplier", "lineitem")
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
    entities = {n: load(spark, sf, n) for n in names}
    entities["vectors"] = embeddings(spark, sf)
    entities["node"] = nodes(spark, sf)
    entities["root"] = nodes(spark, sf).filter(F.col("id").isin("C:1", "C:2"))
    entities["owned"] = load(spark, sf, "customer").withColumn("_owner_role", F.col("c_mktsegment"))
    return Planner(Catalogue(entities, keys, edges(spark, sf), nodes(spark, sf), embed=lambda text: _vector(spark, sf, int(text))))


def language(text: str, sql: str, name: str, columns: list[str] | None = None) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        out = _planner(spark, sf).run(text)
        return out.select(*columns) if columns else out

    f.__name__ = name
    query(sql)(f)


language("FROM nation", "SELECT * FROM nation", "ql_scan")
language("FROM customer#42", "SELECT * FROM customer WHERE c_custkey = 42", "ql_point")
language('FROM customer WHERE c_mktsegment = "BUILDING" AND c_acctbal >= 1000 AND c_nationkey != 3', "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND (c_nationkey IS NULL OR c_nationkey <> 3)", "ql_filter")
language("MATCH part p WHERE p.p_size > 40 FETCH p.p_partkey, p.p_name RANK BY p.p_partkey DESC", "SELECT p_partkey, p_name FROM part WHERE p_size > 40", "ql_sort_fetch")
language("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000", "ql_join")
language("SELECT n_nationkey, n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey", "SELECT a.n_nationkey, a.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey", "ql_self_join")
language(
    'SELECT o_orderkey, c_name, n_name, r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = "ASIA" AND o.o_totalprice > 100000',
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_totalprice > 100000",
    "ql_join_chain",
)
language("SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT p_retailprice FROM part WHERE p_partkey = 7)", "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT p_retailprice FROM part WHERE p_partkey = 7)", "ql_scalar_subquery")
language("SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT p_retailprice FROM part WHERE p_partkey = -1) AND p_size < 5", "SELECT p_partkey FROM part WHERE p_size < 5", "ql_subquery_empty")
language('FROM owned FETCH c_custkey ROLE "BUILDING"', "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", "ql_role")
language(
    'MATCH root SIGUE 1..5 "" TYPE region WITH TEMPERATURE 0.9',
    f"WITH {EDGES_SQL} SELECT DISTINCT r.dst AS id FROM f c JOIN f r ON c.dst = r.src WHERE c.src IN ('C:1', 'C:2')",
    "ql_traverse",
    ["id"],
)
language('FROM vectors WHERE label = 3 AND embedding ~ "7", min = 0.05 FETCH vec_id', f"WITH {QV} SELECT vec_id FROM v, q WHERE label = 3 AND list_cosine_similarity(e, q) >= 0.05", "ql_vector_refine")
language('FROM vectors WHERE embedding ~ "7", min = 0.1 FETCH vec_id', f"WITH {QV}, t AS (SELECT vec_id, {COS} AS s FROM v, q ORDER BY s DESC, vec_id LIMIT 5) SELECT vec_id FROM t WHERE s >= 0.1", "ql_vector_search")


@query("SELECT 'N:' || n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 1 AND 3")
def ql_hot_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten levels are asked for along a chain of nations; a high temperature stops at the third."""
    n = load(spark, sf, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("k"))
    chain = n.select(F.col("id").alias("src"), F.concat(F.lit("N:"), (F.col("k") + 1).cast("string")).alias("dst"), F.lit("next").alias("label"), F.lit(1.0).alias("weight"), F.lit(False).alias("reverse"))
    own = Catalogue({"first": n.filter("k = 0")}, {}, chain, nodes(spark, sf))
    return Planner(own).run('MATCH first SIGUE 1..10 "next" TYPE nation WITH TEMPERATURE 0.9').select("id")


@query("SELECT doc_id FROM labels WHERE NOT coalesce(quality = 0 AND doc_id % 10 < 4, false)")
def ql_low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries whose confidence is too low are skipped."""
    kind = F.when(F.col("quality") == 0, "SemanticSummary").otherwise("note")
    notes = load(spark, sf, "labels").select("doc_id", kind.alias("type"), ((F.col("doc_id") % 10) / 10).alias("confidence"))
    return Planner(Catalogue({"notes": notes})).run("FROM notes FETCH doc_id")


@query(
    """SELECT * FROM (VALUES ('node', '1', 't', 'y'), ('node', '3', 'u', NULL), ('edge', '1', '3', 'knows'), ('edge', '3', '1', 'knows'))
AS x(kind, a, b, c)"""
)
def ql_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes inserted, updated, related and deleted by statements; a deleted node takes its edges with it."""
    store = Store.empty(spark)
    for text in ('INSERT NODE#1 TYPE t {a: "x"}', "INSERT NODE#2 TYPE t {}", "INSERT NODE#3 TYPE u {}", 'RELATE NODE#1 --"knows"--> NODE#2', 'RELATE NODE#1 --"knows"--> NODE#3 WEIGHT 0.5', 'UPDATE NODE#1 SET a = "y"', "DELETE NODE#2"):
        store.apply(text)
    own = store.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.col("fields")["a"].alias("c"))
    return own.unionByName(store.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("label").alias("c")))


# --- graph --------------------------------------------------------------------------------------------------------------------------

ROOTS = ["C:1", "C:2", "S:3"]
_ROOTS = "SELECT unnest(['C:1', 'C:2', 'S:3']) AS id"


def bfs_sql(depth: int, edge: str = "NOT reverse", roots: str = _ROOTS) -> str:
    """CTEs l0 .. and ``b(id, depth)``: levels made distinct one after the other."""
    out = [f"l0 AS ({roots})"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        out.append(f"l{i} AS (SELECT DISTINCT dst AS id FROM e JOIN l{i - 1} ON src = id WHERE {edge} AND dst NOT IN ({seen}))")
    out.append("b AS (" + " UNION ALL ".join(f"SELECT id, {i}::INTEGER AS depth FROM l{i}" for i in range(depth + 1)) + ")")
    return ", ".join(out)


@query(f"WITH {EDGES_SQL}, {bfs_sql(3)} SELECT id, depth FROM b")
def bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(edges(spark, sf), ROOTS, 3)


@query(f"WITH RECURSIVE {EDGES_SQL}, x AS (SELECT id FROM ({_ROOTS}) UNION SELECT dst FROM e JOIN x ON src = id WHERE NOT reverse) SELECT src, dst, label, 1.0::DOUBLE AS weight FROM e JOIN x ON src = id WHERE NOT reverse")
def edge_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return graph.discovered(edges(spark, sf), ROOTS)


@query(f"WITH {EDGES_SQL}, {bfs_sql(3, "NOT reverse AND label IN ('in_nation')")} SELECT id, depth FROM b")
def bfs_labeled(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(edges(spark, sf), ROOTS, 3, labels=["in_nation"])


@query(f"WITH {EDGES_SQL}, {bfs_sql(4, 'true')} SELECT id, depth FROM b")
def bfs_both(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(edges(spark, sf), ROOTS, 4, "both")


@query(f"WITH {EDGES_SQL}, {bfs_sql(3, 'reverse', "SELECT 'R:0' AS id")} SELECT id, depth FROM b")
def bfs_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(edges(spark, sf), ["R:0"], 3, "reverse")


@query(f"WITH {EDGES_SQL}, {bfs_sql(3, roots="SELECT 'C:1' AS id")} SELECT id, depth FROM b WHERE depth BETWEEN 2 AND 3")
def traverse_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return graph.traverse(edges(spark, sf), nodes(spark, sf), "C:1", None, 2, 3)


@query(f"WITH {EDGES_SQL}, {bfs_sql(3, roots="SELECT 'C:1' AS id")} SELECT id, depth AS preorder FROM b")
def dfs_preorder(spark: SparkSession, sf: str) -> DataFrame:
    """From a customer the graph is a chain, so preorder is depth."""
    return graph.dfs(edges(spark, sf), "C:1", 3)


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, p AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT dst FROM f) AND id IN (SELECT src FROM f)
UNION ALL SELECT f.dst, p.level + 1 FROM p JOIN f ON p.id = f.src) SELECT id, max(level)::INTEGER AS level FROM p GROUP BY id"""
)
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topo_levels(edges(spark, sf))[0]


@query("SELECT true AS forward_acyclic, false AS with_loop_acyclic")
def is_dag(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    loop = graph.add_edge(e, "R:0", "C:1", "loop")
    back = e.filter("label = 'in_region' AND NOT reverse AND dst = 'R:0'").limit(1).select(F.lit("R:0").alias("src"), F.col("src").alias("dst"), "label", "weight", "reverse")
    a, b = graph.is_dag(e), graph.is_dag(loop.unionByName(back))
    return spark.range(1, numPartitions=1).select(F.lit(a).alias("forward_acyclic"), F.lit(b).alias("with_loop_acyclic"))


def pagerank_sql(rounds: int, n: str = "n", f: str = "f") -> str:
    """``n`` and ``f``: the CTEs of nodes and forward edges."""
    out = [f"c AS (SELECT count(*)::DOUBLE AS n FROM {n})", f"o AS (SELECT src AS id, count(*) AS k FROM {f} GROUP BY src)", f"p0 AS (SELECT id, 1 / c.n AS r FROM {n} x, c)"]
    for i in range(rounds):
        out.append(f"g{i} AS (SELECT y.dst AS id, sum(p.r / o.k) AS g FROM p{i} p JOIN o ON p.id = o.id JOIN {f} y ON y.src = p.id GROUP BY y.dst)")
        out.append(f"z{i} AS (SELECT coalesce(sum(p.r), 0) AS z FROM p{i} p WHERE p.id NOT IN (SELECT id FROM o))")
        out.append(f"p{i + 1} AS (SELECT x.id, 0.15 / c.n + 0.85 * (coalesce(g, 0) + z / c.n) AS r FROM {n} x LEFT JOIN g{i} ON x.id = g{i}.id, c, z{i})")
    return ", ".join(out)


@query(f"WITH {EDGES_SQL}, {pagerank_sql(5)} SELECT id, round(r, 9) AS rank FROM p5")
def pagerank_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(edges(spark, sf), nodes(spark, sf), 5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query(
    f"""WITH {EDGES_SQL}, {bfs_sql(3)}, nn AS (SELECT * FROM n WHERE id IN (SELECT id FROM b)), ff AS (SELECT * FROM f WHERE src IN (SELECT id FROM b)), {pagerank_sql(5, "nn", "ff")}
SELECT id, round(r, 9) AS rank FROM p5"""
)
def pagerank_roots(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(edges(spark, sf), nodes(spark, sf), 5, tolerance=None, roots=ROOTS).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH {EDGES_SQL} SELECT id, type, name FROM n WHERE id > 'C:5' ORDER BY id LIMIT 40")
def node_page(spark: SparkSession, sf: str) -> DataFrame:
    return graph.page(nodes(spark, sf), "C:5", 40)


@query(
    f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM documents) AS records,
(SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors, (SELECT count(DISTINCT lang) FROM documents) AS namespaces"""
)
def engine_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.engine_stats(nodes(spark, sf), edges(spark, sf), record_table(spark, sf), embeddings(spark, sf))


@query(f"WITH {EDGES_SQL} SELECT id, (SELECT count(*) FROM f WHERE dst = id) AS in_degree, (SELECT count(*) FROM f WHERE src = id) AS out_degree FROM n")
def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf), nodes(spark, sf))


@query(f"WITH {EDGES_SQL}, {bfs_sql(2)} SELECT id, count(*)::DOUBLE AS acc FROM b JOIN e ON id = src WHERE depth < 2 AND NOT reverse GROUP BY id")
def accumulator_sum(spark: SparkSession, sf: str) -> DataFrame:
    return graph.accumulated(edges(spark, sf), ROOTS, 2, F.col("weight"))


@query(f"WITH {EDGES_SQL} SELECT dst AS id, label, type, name FROM e LEFT JOIN n ON dst = id WHERE src = 'N:5'")
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf), nodes(spark, sf), "N:5")


@query(
    f"""WITH {EDGES_SQL}, k AS (SELECT * FROM n WHERE id <> 'N:5')
SELECT (SELECT count(*) FROM k) AS nodes, count(*) AS edges, count(*) FILTER (src = 'N:5' OR dst = 'N:5') AS dangling, 0::BIGINT AS self_loops,
(SELECT count(*) FROM k WHERE id NOT IN (SELECT src FROM e)) AS orphans, round(count(*) / (SELECT count(*) FROM k), 6) AS mean_degree FROM e"""
)
def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.integrity(edges(spark, sf), nodes(spark, sf).filter("id <> 'N:5'"))


SEEDED = f"""WITH {EDGES_SQL}, sd AS (SELECT 'C:1' AS id, 0.9 AS score UNION ALL SELECT 'S:3', 0.5), {bfs_sql(2, 'true', "SELECT id FROM sd")},
x AS (SELECT id, depth AS hop FROM b ORDER BY hop, id LIMIT 100), g AS (SELECT src AS id, count(*) AS d FROM e GROUP BY src),
k AS (SELECT x.id, n.name AS content, hop, round(0.6 * coalesce(sd.score, 0) + 0.3 / (1 + hop) + 0.1 * coalesce(d, 0) / (coalesce(d, 0) + 10), 6) AS score
  FROM x JOIN n USING (id) LEFT JOIN sd USING (id) LEFT JOIN g USING (id)), best AS (SELECT * FROM k ORDER BY score DESC, id LIMIT 20)"""


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("C:1", 0.9), ("S:3", 0.5)], "id string, score double")


@query(f"{SEEDED} SELECT id, content, hop, score::DOUBLE AS score FROM best")
def graphrag_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_retrieval.search(nodes(spark, sf), edges(spark, sf), _seeds(spark))["nodes"]


@query(f"{SEEDED} SELECT src, label, dst FROM e WHERE src IN (SELECT id FROM best) AND (dst IN (SELECT id FROM x) OR dst IN (SELECT id FROM best))")
def graphrag_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph_retrieval.search(nodes(spark, sf), edges(spark, sf), _seeds(spark))["edges"]


@query(f"{SEEDED} SELECT (SELECT count(*) FROM sd) AS seeds, count(*) AS expanded, (SELECT count(*) FROM sd) + count(*) AS candidates, max(hop) AS max_hop FROM x")
def graphrag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph_retrieval.search(nodes(spark, sf), edges(spark, sf), _seeds(spark))["stats"]


@query()
def graphrag_context(spark: SparkSession, sf: str) -> DataFrame:
    return graph_retrieval.search(nodes(spark, sf), edges(spark, sf), _seeds(spark))["context"]
