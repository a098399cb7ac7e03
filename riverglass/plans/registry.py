"""The registered queries of the retrieval engine and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine, normalised
from ..operators import chunking, evaluation, fusion, keyword, knn, packing, reranking
from ..operators import predicates as p

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


# -- filters --------------------------------------------------------------------------

DOCS = {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int", "quality": "int", "toxic": "int"}
ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float", "o_orderpriority": "text"}
_JUDGED = "documents LEFT JOIN labels USING (doc_id)"


def _filtered(name: str, flt: p.Filter, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
        return p.compile_filter(flt, DOCS).apply(docs, "doc_id").select("doc_id", "lang", "source", "quality")

    query(f"SELECT doc_id, lang, source, quality FROM {_JUDGED} WHERE {where}", name)(run)


_filtered("filter_eq", p.eq("lang", "en"), "lang = 'en'")
_filtered("filter_ne", p.ne("quality", 1), "quality IS DISTINCT FROM 1")
_filtered("filter_in", p.in_("source", ["src1", "src2", "src7"]), "source IN ('src1', 'src2', 'src7')")
_filtered("filter_between", p.between("n_chars", 500, 2000), "n_chars BETWEEN 500 AND 2000")
_filtered("filter_range_gt_lte", p.and_(p.gt("n_chars", 300), p.lte("n_chars", 5000)), "n_chars > 300 AND n_chars <= 5000")
_filtered("filter_range_gte_lt", p.and_(p.gte("n_chars", 300), p.lt("n_chars", 5000)), "n_chars >= 300 AND n_chars < 5000")
_filtered("filter_glob", p.glob("source", "src1[0-5]*"), "regexp_full_match(source, 'src1[0-5].*')")
_filtered("filter_glob_not_class", p.glob("source", "src[^1-8]"), "regexp_full_match(source, 'src[^1-8]')")
_filtered("filter_is_null", p.is_null("quality"), "quality IS NULL")
_filtered("filter_not_null_safe", p.not_(p.gt("quality", 0)), "NOT coalesce(quality > 0, false)")
_filtered("filter_and_or", p.or_(p.and_(p.eq("lang", "en"), p.eq("toxic", 1)), p.and_(p.eq("lang", "fr"), p.lt("n_chars", 1000))), "(lang = 'en' AND toxic = 1) OR (lang = 'fr' AND n_chars < 1000)")
_filtered("filter_not_and_unknown", p.not_(p.and_(p.eq("lang", "en"), p.eq("toxic", 0))), "NOT coalesce(lang = 'en' AND toxic = 0, false)")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000.0 AND 150000.0 AND o_orderpriority IN (SELECT min(o_orderpriority) FROM orders)")
def filter_float_range(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderpriority")).first()[0]
    flt = p.and_(p.between("o_totalprice", 50000, 150000), p.eq("o_orderpriority", first))
    return p.compile_filter(flt, ORDERS).apply(orders, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filter_idset_semi(spark, sf_dir):
    ids = p.IdSet(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return p.compile_filter(ids, DOCS).apply(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' OR NOT coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false)")
def filter_not_idset(spark, sf_dir):
    ids = p.IdSet(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
    return p.compile_filter(p.or_(p.eq("lang", "de"), p.not_(ids)), DOCS).apply(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lang")


# -- keyword search -------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query("SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN 'only this' WHEN doc_id % 3 = 1 THEN source || chr(10) || text ELSE text END) AS keyword_md5 FROM documents")
def keyword_text_view(spark, sf_dir):
    third = F.col("id") % 3
    rows = items(spark, sf_dir).withColumn("o", F.when(third == 0, "only this")).withColumn("k", F.when(third == 1, F.col("source")))
    return rows.select("id", F.md5(tx.keyword_text(F.col("text"), F.col("k"), F.col("o")).cast("binary")).alias("keyword_md5"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    postings = keyword.postings_of(keyword.tokenised(items(spark, sf_dir)))
    return postings.groupBy("term").agg(F.sum("tf").cast("bigint").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id AS id, CAST(len({_TOKENS}) AS BIGINT) AS dl FROM documents")
def index_lengths(spark, sf_dir):
    return keyword.build_index(items(spark, sf_dir)).lengths.select("id", F.col("dl").cast("bigint").alias("dl"))


def _bm25_sql(queries: str, where: str = "true", k: int = 10, phrases: str | None = None) -> str:
    """The ranking function over documents; queries: a table of (qid, query) as SQL."""
    words = phrases or rf"SELECT qid, unnest(regexp_extract_all(strip_accents(lower(query)), '[\p{{L}}\p{{N}}]+')) AS term FROM q"
    return f"""
WITH q AS ({queries}), w AS ({words}), u AS (SELECT qid, term, count(*) AS uses FROM w GROUP BY ALL),
d AS (SELECT doc_id AS id, lang, {_TOKENS} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tok AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d),
f AS (SELECT id, dl, term, count(*) AS f FROM tok WHERE term IN (SELECT term FROM w) GROUP BY ALL),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
b AS (SELECT qid, id, round(sum(uses * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM f JOIN i USING (term) JOIN u USING (term), s GROUP BY ALL),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b JOIN d USING (id) WHERE {where})
SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _ranked(lists: DataFrame) -> DataFrame:
    return lists.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _few(found: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """What was found for the queries, sent to the tasks that read the items where it is at most so many rows."""
    return F.broadcast(found) if queries.count() * depth <= keyword.BROADCAST_TERMS else found


def _benchmark(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


_ONE = "The thorough onon of thatea ingesing"
_LITERAL = f"SELECT 0::BIGINT AS qid, '{_ONE}' AS query"
_BENCH = "SELECT item_id AS qid, text AS query FROM benchmark"


def _one(spark) -> DataFrame:
    return spark.createDataFrame([(0, _ONE)], "qid bigint, query string")


@query(_bm25_sql(_LITERAL))
def bm25_topk(spark, sf_dir):
    q = _one(spark)
    return _ranked(keyword.search(q, keyword.query_index(q, items(spark, sf_dir)), 10, digits=9))


@query(_bm25_sql(_LITERAL, "lang = 'fr'"))
def bm25_filtered(spark, sf_dir):
    q, docs = _one(spark), items(spark, sf_dir)
    return _ranked(keyword.search(q, keyword.query_index(q, docs), 10, p.compile_filter(p.eq("lang", "fr"), DOCS).apply(docs).select("id"), digits=9))


@query(_bm25_sql(_BENCH, k=5))
def bm25_batch(spark, sf_dir):
    q = _benchmark(spark, sf_dir)
    return _ranked(keyword.search(q, keyword.query_index(q, items(spark, sf_dir)), 5, digits=9))


@query(rf"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
f AS (SELECT id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda k: t[k] = 'of' AND t[k + 1] = 'the')) AS f FROM d),
h AS (SELECT * FROM f WHERE f > 0), i AS (SELECT CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END AS idf FROM (SELECT count(*) AS c FROM h), s),
r AS (SELECT id, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h, i, s)
SELECT 0::BIGINT AS qid, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 9) AS score FROM r QUALIFY rank <= 10""")
def bm25_phrase(spark, sf_dir):
    q = spark.createDataFrame([(0, "of_the")], "qid bigint, query string")
    found = keyword.search(q, keyword.query_index(q, items(spark, sf_dir)), 10)
    return found.select("qid", "rank", "id", F.round("score", 9).alias("score"))


@query("""
WITH d AS (SELECT doc_id AS id, lower(text) AS t FROM documents), s AS (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0)) AS avgdl FROM d),
f AS (SELECT id, greatest(length(t) - 2, 0) AS dl, len(list_filter(range(1, length(t) - 3), lambda k: substr(t, k, 5) = 'ablei')) AS f FROM d WHERE contains(t, 'ablei')),
i AS (SELECT ln((n - c + 0.5) / (c + 0.5)) AS idf FROM (SELECT count(*) AS c FROM f), s),
r AS (SELECT id, CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM f, i, s)
SELECT 0::BIGINT AS qid, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM r QUALIFY rank <= 10""")
def trigram_search(spark, sf_dir):
    q = spark.createDataFrame([(0, "Ablei no")], "qid bigint, query string")
    return _ranked(keyword.search(q, keyword.query_index(q, items(spark, sf_dir), "trigram"), 10))


@query()
def porter_search(spark, sf_dir):
    q = spark.createDataFrame([(0, "the thing runs running connected")], "qid bigint, query string")
    return _ranked(keyword.search(q, keyword.query_index(q, items(spark, sf_dir), "porter"), 10, digits=9))


# -- vectors --------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _asked(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("qid"), "vec")


_V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), u AS (SELECT id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM v)"


def _knn_sql(where: str = "true", k: int = 10, pick: str = "id % 100 = 0") -> str:
    return f"""WITH {_V}, r AS (SELECT q.id AS qid, u.id, list_dot_product(q.vec, u.vec) AS score FROM (SELECT * FROM u WHERE {pick}) q, u WHERE {where})
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM r QUALIFY rank <= {k}"""


@query(_knn_sql())
def knn_batch(spark, sf_dir):
    return _ranked(knn.exhaustive(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10))


@query(_knn_sql(pick="id = 7").replace("SELECT qid, ", "SELECT "))
def knn_exact(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn.exhaustive_one(v, v.where("id = 7").first().vec, 10).select("rank", "id", F.round("score", 6).alias("score"))


@query(_knn_sql("u.label < 5"))
def knn_filtered(spark, sf_dir):
    v = p.compile_filter(p.lt("label", 5), {"label": "int"}).apply(_vectors(spark, sf_dir))
    return _ranked(knn.exhaustive(v, _asked(spark, sf_dir), 10))


@query()
def knn_inverted_lists(spark, sf_dir):
    return _ranked(knn.InvertedLists()(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10))


@query()
def knn_hyperplanes(spark, sf_dir):
    return _ranked(knn.Hyperplanes()(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10))


#: What an approximate index must find of the exact ten neighbours.
LEAST_RECALL = 0.95


@query(f"SELECT index, {LEAST_RECALL} AS least, true AS reached FROM (VALUES ('hyperplanes'), ('inverted_lists')) AS t(index)")
def knn_recall(spark, sf_dir):
    """Whether each approximate index finds its share of the exact neighbours of the queries."""
    vectors, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    exact = knn.exhaustive(vectors, asked, 10).select("qid", "id").persist()
    out = None
    for name, index in (("hyperplanes", knn.Hyperplanes()), ("inverted_lists", knn.InvertedLists())):
        hit = exact.join(index(vectors, asked, 10).select("qid", "id", F.lit(1.0).alias("hit")), ["qid", "id"], "left")
        one = hit.agg((F.coalesce(F.sum("hit"), F.lit(0.0)) / F.count(F.lit(1)) >= LEAST_RECALL).alias("reached")).select(F.lit(name).alias("index"), F.lit(LEAST_RECALL).alias("least"), "reached")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_V} SELECT id, round(list_sum(vec), 6) AS total, round(sqrt(list_dot_product(vec, vec)), 6) AS size FROM u")
def vector_normalise(spark, sf_dir):
    unit = _vectors(spark, sf_dir).withColumn("vec", normalised("vec"))
    return unit.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("size"))


@query(f"WITH {_V}, c AS (SELECT vec FROM u WHERE id = 0) SELECT label, round(min(list_dot_product(u.vec, c.vec)), 6) AS least FROM u, c GROUP BY label")
def canary_min_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = F.array(*[F.lit(float(x)) for x in v.where("id = 0").first().vec])
    return v.groupBy("label").agg(F.round(F.min(cosine(F.col("vec"), first)), 6).alias("least"))


# -- fusion of two lists for each benchmark query: keyword search, and vectors whose ids stand for both --------------

_DEPTH = 20


def _lists(spark, sf_dir) -> DataFrame:
    q = _benchmark(spark, sf_dir)
    one = keyword.search(q, keyword.query_index(q, items(spark, sf_dir)), _DEPTH, digits=9)
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = q.select("qid").join(vectors.select(F.col("id").alias("qid"), "vec"), "qid")
    two = knn.exhaustive(vectors, asked, _DEPTH).withColumn("source", F.lit("vector")).withColumn("raw", F.col("score"))
    # Rounded as the SQL's are, so both rank alike where sums differ in their last digits.
    return fusion.stacked([one, two]).withColumns({c: F.round(c, 9) for c in ("score", "raw")})


_LISTS = rf"""
k0 AS ({_bm25_sql(_BENCH, k=_DEPTH).replace("round(score, 6)", "round(score, 9)")}),
k1 AS ({_knn_sql("q.id IN (SELECT item_id FROM benchmark)", _DEPTH, "true").replace("round(score, 6)", "round(score, 9)")}),
l AS (SELECT qid, 'keyword' AS source, 0 AS source_ord, rank, id, score FROM k0 UNION ALL SELECT qid, 'vector', 1, rank, id, score FROM k1)"""


def _fused_sql(score: str, more: str = "", rows: str = "l") -> str:
    return f"WITH {_LISTS}{more}, g AS (SELECT qid, id, sum({score}) AS score FROM {rows} GROUP BY ALL) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM g"


def _settled(fused: DataFrame) -> DataFrame:
    """Ranked again by rounded scores, as the SQL is."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return _ranked(fused.withColumn("rank", F.row_number().over(order).cast("int")))


@query(_fused_sql("1.0 / (60 + rank)"))
def fuse_rrf(spark, sf_dir):
    return _settled(fusion.rrf(_lists(spark, sf_dir)))


@query(_fused_sql("CASE source WHEN 'keyword' THEN 2.0 ELSE 0.5 END / (10 + rank)"))
def fuse_rrf_weighted(spark, sf_dir):
    return _settled(fusion.rrf(_lists(spark, sf_dir), k=10, weights={"keyword": 2.0, "vector": 0.5}))


def _blend(name: str, how: str, value: str) -> None:
    more = f", n AS (SELECT *, {value} AS v FROM l WINDOW w AS (PARTITION BY qid, source_ord))"

    def run(spark, sf_dir):
        return _settled(fusion.blend(_lists(spark, sf_dir), weights={"vector": 0.7}, normalise_by=how))

    query(_fused_sql("CASE source WHEN 'vector' THEN 0.7 ELSE 1.0 END * v", more, "n"), name)(run)


_blend("fuse_blend_minmax", "min-max", "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END")
_blend("fuse_blend_max", "max", "CASE WHEN max(abs(score)) OVER w = 0 THEN 0.0 ELSE score / max(abs(score)) OVER w END")
_blend("fuse_blend_sum", "sum", "CASE WHEN sum(abs(score)) OVER w = 0 THEN 0.0 ELSE score / sum(abs(score)) OVER w END")
_blend("fuse_blend_zscore", "z-score", "CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END")


@query(f"WITH {_LISTS} SELECT qid, rank, id, round(score, 6) AS score FROM l WHERE source_ord = (SELECT min(m.source_ord) FROM l m WHERE m.qid = l.qid)")
def fuse_first(spark, sf_dir):
    return _ranked(fusion.first(_lists(spark, sf_dir)))


@query(f"WITH {_LISTS} SELECT qid, id, source, rank, round(score, 6) AS score FROM l")
def fuse_evidence(spark, sf_dir):
    lists = _lists(spark, sf_dir).persist()
    told = fusion.with_evidence(fusion.rrf(lists), lists).select("qid", "id", F.explode("evidence").alias("e"))
    return told.select("qid", "id", "e.source", "e.rank", F.round("e.score", 6).alias("score"))


@query()
def hybrid_search(spark, sf_dir):
    """Both lists under lang = 'en', fused; the best 10 of each query that are in the documents, with their evidence.

    vec_id stands for doc_id: the tables have no key between them, so the pairing is only for the test.
    """
    docs = items(spark, sf_dir)
    allowed = p.compile_filter(p.eq("lang", "en"), DOCS).apply(docs).select("id")
    q = _benchmark(spark, sf_dir)
    one = keyword.search(q, keyword.query_index(q, docs), 40, allowed, digits=9)
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = q.select("qid").join(vectors.select(F.col("id").alias("qid"), "vec"), "qid")
    two = knn.exhaustive(vectors.join(allowed, "id", "left_semi"), asked, 40).withColumn("source", F.lit("vector")).withColumn("raw", F.col("score"))
    lists = fusion.stacked([one, two]).withColumns({c: F.round(c, 9) for c in ("score", "raw")}).persist()
    top = _ten(fusion.rrf(lists))
    told = docs.select("id", "lang", "source").join(_few(fusion.with_evidence(top, lists), q, 10), "id")
    flat = F.concat_ws(",", F.transform("evidence", lambda e: F.concat(e["source"], F.lit(":"), e["rank"].cast("string"))))
    return told.select("qid", "rank", "id", F.round("score", 6).alias("score"), "lang", "source", flat.alias("evidence"))


def _ten(fused: DataFrame) -> DataFrame:
    return knn.ranked(fused.withColumn("score", F.round("score", 9)).drop("rank"), 10)


ORACLE["hybrid_search"] = f"""
WITH k0 AS ({_bm25_sql(_BENCH, "lang = 'en'", 40).replace("round(score, 6)", "round(score, 9)")}),
k1 AS ({_knn_sql("q.id IN (SELECT item_id FROM benchmark) AND u.id IN (SELECT doc_id FROM documents WHERE lang = 'en')", 40, "true").replace("round(score, 6)", "round(score, 9)")}),
l AS (SELECT qid, 'keyword' AS source, 0 AS o, rank, id FROM k0 UNION ALL SELECT qid, 'vector', 1, rank, id FROM k1),
g AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, string_agg(source || ':' || rank, ',' ORDER BY o) AS evidence FROM l GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM g)
SELECT qid, rank, id, round(score, 6) AS score, lang, d.source, evidence FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10"""


# -- reranking and packing: orders as candidates of their customer ----------------------


def _candidates(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderstatus", "o_orderpriority", F.unix_timestamp("o_orderdate").alias("placed"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("int"))


_C = "c AS (SELECT o_custkey AS qid, o_orderkey AS id, o_totalprice AS score, o_orderstatus, o_orderpriority, CAST(epoch(o_orderdate) AS BIGINT) AS placed, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS ord FROM orders)"
_NOW, _HALF = 883612800.0, 15552000.0


def _reranked_sql(score: str) -> str:
    return f"WITH {_C}, s AS (SELECT qid, id, ord AS old, {score} AS score FROM c) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS INTEGER) AS ord, round(score, 4) AS score FROM s"


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "id", "ord", F.round("score", 4).alias("score"))


@query(_reranked_sql(f"score * pow(0.5, greatest(0, {_NOW} - placed) / {_HALF})"))
def rerank_recency(spark, sf_dir):
    return _told(reranking.Recency("placed", half_life=_HALF, clock=lambda: _NOW).rerank(_candidates(spark, sf_dir)))


@query(_reranked_sql("score * CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 1.0 END * CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 3.0 ELSE 1.0 END"))
def rerank_rules(spark, sf_dir):
    rules = [reranking.Rule(p.eq("o_orderstatus", "F"), 0.5), reranking.Rule(p.glob("o_orderpriority", "[12]*"), 3.0)]
    return _told(reranking.Rules(rules, ORDERS).rerank(_candidates(spark, sf_dir)))


@query(_reranked_sql("score * (1 + id % 7)"))
def rerank_multiply(spark, sf_dir):
    return _told(reranking.Multiply(1 + F.col("id") % 7).rerank(_candidates(spark, sf_dir)))


@query(f"""
WITH {_V}, a AS (SELECT q.id AS qid, u.id, u.vec, list_dot_product(q.vec, u.vec) AS score FROM (SELECT * FROM u WHERE id % 100 = 0) q, u),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS ord FROM a QUALIFY ord <= 5),
n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS rel FROM c WINDOW w AS (PARTITION BY qid)),
p1 AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 0.5 * rel DESC, ord) = 1),
m2 AS (SELECT n.*, list_dot_product(n.vec, p1.vec) AS near FROM n JOIN p1 USING (qid) WHERE n.id <> p1.id),
p2 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 0.5 * rel - 0.5 * near DESC, ord) = 1),
m3 AS (SELECT m2.* REPLACE (greatest(m2.near, list_dot_product(m2.vec, p2.vec)) AS near) FROM m2 JOIN p2 USING (qid) WHERE m2.id <> p2.id),
p3 AS (SELECT * FROM m3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 0.5 * rel - 0.5 * near DESC, ord) = 1)
SELECT qid, 1 AS ord, id FROM p1 UNION ALL SELECT qid, 2, id FROM p2 UNION ALL SELECT qid, 3, id FROM p3""")
def rerank_mmr(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "vec")
    five = knn.exhaustive(v, _asked(spark, sf_dir), 5).withColumnRenamed("rank", "ord").join(v, "id")
    return reranking.MMR(0.5).rerank(five).where("ord <= 3").select("qid", "ord", "id")


def _overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """Words of the query that the passage holds, above 10: a scorer that SQL can follow."""
    return [float(len(set(q.lower().split()) & set(t.lower().split())) - 10) for q, t in pairs]


@query(f"""
WITH k AS ({_bm25_sql(_BENCH, k=12)}),
c AS (SELECT qid, rank AS ord, id, score, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')) AS tw FROM k JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = id WHERE rank <= 10),
s AS (SELECT qid, id, ord AS old, 0.7 / (1 + exp(10 - len(list_intersect(qw, tw)))) + 0.3 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM c WINDOW w AS (PARTITION BY qid))
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, old) AS INTEGER) AS ord, round(score, 4) AS score FROM s""")
def rerank_cross_encoder(spark, sf_dir):
    q, docs = _benchmark(spark, sf_dir), items(spark, sf_dir)
    found = keyword.search(q, keyword.query_index(q, docs), 12, digits=9).withColumn("score", F.round("score", 6)).withColumnRenamed("rank", "ord")
    candidates = docs.select("id", "text").join(_few(found, q, 12), "id").select("qid", "ord", "id", "score", "text").persist()
    out = reranking.CrossEncoder(_overlap, top=10, weight=0.7).rerank(candidates, q)
    return _told(reranking.by_score(out.withColumn("score", F.round("score", 9))))


def _packable(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = items(spark, sf_dir).select(F.col("lang").alias("qid"), "id", F.when(F.col("id") % 5 > 0, F.col("source")).alias("source"), F.char_length("text").alias("chars"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("id")).cast("int"))


_P = "c AS (SELECT lang AS qid, doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN source END AS source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS ord FROM documents)"
_D = "k AS (SELECT qid, id, text, row_number() OVER (PARTITION BY qid ORDER BY ord) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY ord) AS n FROM c) WHERE n = 1 OR source IS NULL)"


@query(f"WITH {_P}, {_D} SELECT qid, CAST(ord AS INTEGER) AS ord, id FROM k")
def pack_distinct(spark, sf_dir):
    return packing.distinct_by(_packable(spark, sf_dir), "source").select("qid", "ord", "id")


def _budget_sql(rows: str, chars: int) -> str:
    return f"SELECT qid, CAST(ord AS INTEGER) AS ord, id FROM (SELECT *, sum(length(text)) OVER (PARTITION BY qid ORDER BY ord) AS run FROM {rows}) WHERE ord = 1 OR run <= {chars}"


@query(f"WITH {_P} {_budget_sql('c', 20000)}")
def pack_budget(spark, sf_dir):
    return packing.within(_packable(spark, sf_dir), 20000, chars="chars").select("qid", "ord", "id")


@query(f"WITH {_P}, {_D} {_budget_sql('k', 15000)}")
def pack_both(spark, sf_dir):
    return packing.within(packing.distinct_by(_packable(spark, sf_dir), "source"), 15000, chars="chars").select("qid", "ord", "id")


# -- evaluation: labels as judgements of each benchmark query's keyword list -------------


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q = _benchmark(spark, sf_dir)
    run = keyword.search(q, keyword.query_index(q, items(spark, sf_dir)), 20, digits=9).select("qid", "rank", F.col("id").alias("key"))
    marks = read(spark, sf_dir, "labels").withColumn("grade", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("quality") * 2 - F.col("toxic")))
    return run, marks.select((F.col("doc_id") % 50).alias("qid"), F.col("doc_id").alias("key"), "grade")


_E = rf"""run AS (SELECT qid, rank, id AS key FROM ({_bm25_sql(_BENCH, k=20)})),
j AS (SELECT doc_id % 50 AS qid, doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE quality * 2 - toxic END AS grade FROM labels),
g AS (SELECT run.qid, rank, greatest(coalesce(grade, 0), 0) AS gain FROM run LEFT JOIN j USING (qid, key)),
f AS (SELECT qid, max(CASE WHEN rank <= 10 AND gain > 0 THEN 1.0 ELSE 0.0 END) AS hit, coalesce(1.0 / min(CASE WHEN gain > 0 THEN rank END), 0.0) AS mrr, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS returned FROM g GROUP BY qid),
i AS (SELECT qid, coalesce(max(grade) > 0, false) AS answered, sum(CASE WHEN grade > 0 AND place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, key) AS place FROM j) GROUP BY qid),
e AS (SELECT i.qid, answered, coalesce(hit, 0.0) AS hit, coalesce(mrr, 0.0) AS mrr, CASE WHEN best > 0 THEN coalesce(dcg, 0.0) / best ELSE 0.0 END AS ndcg, coalesce(returned, 0) AS returned FROM i LEFT JOIN f USING (qid))"""


@query(f"WITH {_E} SELECT qid, answered, round(hit, 6) AS hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, CAST(returned AS BIGINT) AS returned FROM e")
def eval_per_query(spark, sf_dir):
    return evaluation.per_query(*_judged(spark, sf_dir)).select("qid", "answered", *(F.round(c, 6).alias(c) for c in ("hit", "mrr", "ndcg")), "returned")


@query(f"WITH {_E} SELECT round(coalesce(avg(hit) FILTER (WHERE answered), 0.0), 6) AS hit, round(coalesce(avg(mrr) FILTER (WHERE answered), 0.0), 6) AS mrr, round(coalesce(avg(ndcg) FILTER (WHERE answered), 0.0), 6) AS ndcg, CAST(count(*) FILTER (WHERE answered) AS BIGINT) AS queries, CAST(count(*) FILTER (WHERE NOT answered) AS BIGINT) AS no_answer_queries, round(coalesce(avg(returned) FILTER (WHERE NOT answered), 0.0), 6) AS no_answer_returned FROM e")
def eval_metrics(spark, sf_dir):
    return evaluation.evaluate(*_judged(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("hit", "mrr", "ndcg", "no_answer_returned")})


def _runset(spark, sf_dir) -> DataFrame:
    return _lists(spark, sf_dir).select("qid", "source", "source_ord", F.format_string("k%06d", "id").alias("key"), "score", "raw")


@query(_fused_sql("1.0 / (60 + rank)").replace("id, round(score, 6) AS score FROM g", "'k' || lpad(id::VARCHAR, 6, '0') AS key FROM g"))
def run_fuse(spark, sf_dir):
    fuser = lambda lists: knn.ranked(fusion.rrf(lists).withColumn("score", F.round("score", 9)).drop("rank"), 10**9)
    return evaluation.replay(_runset(spark, sf_dir).persist(), fuser)


@query(f"WITH {_LISTS} SELECT qid, rank, 'k' || lpad(id::VARCHAR, 6, '0') AS key FROM l WHERE source = 'vector'")
def run_source(spark, sf_dir):
    return evaluation.source_run(_runset(spark, sf_dir), "vector")


_OPTIONS = rf"""
WITH {_LISTS},
n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM l WINDOW w AS (PARTITION BY qid, source_ord)),
f AS (SELECT 0 AS option_ord, 'rrf' AS option, qid, id, sum(1.0 / (60 + rank)) AS score FROM l GROUP BY ALL
  UNION ALL SELECT 1, 'blend', qid, id, sum(v) FROM n GROUP BY ALL
  UNION ALL SELECT 2, 'first', qid, id, score FROM l WHERE source_ord = (SELECT min(m.source_ord) FROM l m WHERE m.qid = l.qid)),
run AS (SELECT option_ord, option, qid, id, row_number() OVER (PARTITION BY option, qid ORDER BY round(score, 9) DESC, id) AS rank FROM f),
j AS (SELECT doc_id % 50 AS qid, doc_id AS id, quality AS grade FROM labels),
g AS (SELECT option, qid, rank, greatest(coalesce(grade, 0), 0) AS gain FROM run LEFT JOIN j USING (qid, id)),
p AS (SELECT option, qid, max(CASE WHEN rank <= 10 AND gain > 0 THEN 1.0 ELSE 0.0 END) AS hit, coalesce(1.0 / min(CASE WHEN gain > 0 THEN rank END), 0.0) AS mrr, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM g GROUP BY ALL),
i AS (SELECT qid, sum(CASE WHEN grade > 0 AND place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS place FROM j) GROUP BY qid HAVING max(grade) > 0),
o(option_ord, option) AS (VALUES (0, 'rrf'), (1, 'blend'), (2, 'first'))
SELECT o.option, o.option_ord, CASE WHEN i.qid % 3 = 0 THEN 'test' ELSE 'train' END AS part, round(avg(coalesce(hit, 0.0)), 6) AS hit, round(avg(coalesce(mrr, 0.0)), 6) AS mrr, round(avg(coalesce(dcg, 0.0) / best), 6) AS ndcg
FROM i CROSS JOIN o LEFT JOIN p ON p.qid = i.qid AND p.option = o.option WHERE i.qid IN (SELECT item_id FROM benchmark) GROUP BY ALL"""


@query(_OPTIONS)
def eval_tune(spark, sf_dir):
    """The figures of three options on two parts of the queries, by which tune() chooses."""
    marks = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("qid"), F.format_string("k%06d", "doc_id").alias("key"), F.col("quality").alias("grade"))
    parts = _benchmark(spark, sf_dir).select("qid", F.when(F.col("qid") % 3 == 0, "test").otherwise("train").alias("part"))
    settled = lambda fuser: lambda lists: knn.ranked(fuser(lists).withColumn("score", F.round("score", 9)).drop("rank"), 10**9)
    options = {"rrf": settled(fusion.rrf), "blend": settled(fusion.blend), "first": settled(fusion.first)}
    found = evaluation.option_scores(_runset(spark, sf_dir).persist(), marks, options, parts)
    return found.withColumns({c: F.round(c, 6) for c in ("hit", "mrr", "ndcg")})


@query()
def split_train_test(spark, sf_dir):
    return _benchmark(spark, sf_dir).select("qid", evaluation.in_test("qid").alias("test"))


# -- store operations as relations -------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    return items(spark, sf_dir).join(_vectors(spark, sf_dir), "id", "left_anti").select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT -1, 'new'")
def upsert_merge(spark, sf_dir):
    from ..model import Field
    from ..sources.store import Store

    store = Store(spark, _scratch(spark), "upserted", [Field("lang", "text")])
    docs = items(spark, sf_dir).select("id", "text", "lang")
    fresh = docs.where("id % 10 = 0").select("id", "text", F.lit("new").alias("lang")).unionByName(spark.createDataFrame([(-1, "x", "new")], "id bigint, text string, lang string"))
    with store.transaction():
        store.defer_keywords()
        store.upsert(docs)
        store.upsert(fresh)
    return store.items.select("id", "lang")


@query("SELECT doc_id AS id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_ids(spark, sf_dir):
    from ..sources.store import Store

    store = Store(spark, _scratch(spark), "removed")
    with store.transaction():
        store.defer_keywords()
        store.upsert(items(spark, sf_dir).select("id", "text"))
        store.remove(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return store.items.select("id", F.char_length("text").cast("bigint").alias("n"))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared one that the session names; a temporary one where none is set, as in tests."""
    import tempfile
    import uuid

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named.rstrip('/')}/stores-{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="riverglass-")


@query("SELECT l.doc_id AS id, length(text) AS n, lang, embedding IS NOT NULL AS has_vector FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l JOIN documents d USING (doc_id) LEFT JOIN embeddings ON vec_id = l.doc_id")
def fetch_hydrate(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    rows = items(spark, sf_dir).select("id", "text", "lang").join(ids, "id", "left_semi").join(_vectors(spark, sf_dir).select("id", "vec"), "id", "left")
    return rows.select("id", F.char_length("text").cast("bigint").alias("n"), "lang", F.col("vec").isNotNull().alias("has_vector"))


@query(f"""
WITH d AS (SELECT k.qid, k.id, rank, 1.0 / (60 + rank) AS score, source, text, row_number() OVER (PARTITION BY k.qid, source ORDER BY rank) AS n FROM ({_bm25_sql(_BENCH, "lang = 'en'", 20)}) k JOIN documents ON doc_id = k.id),
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS ord FROM d WHERE n = 1 OR source IS NULL),
f AS (SELECT *, sum(length(text)) OVER (PARTITION BY qid ORDER BY ord) AS run FROM e)
SELECT qid, ord, id, round(score, 6) AS score, source, lang FROM (SELECT qid, ord, id, score, source, 'en' AS lang, run FROM f) WHERE (ord = 1 OR run <= 20000) AND ord <= 5""")
def search_composed(spark, sf_dir):
    """Search over a store: keywords of English documents, one hit for each source, at most 20,000 characters."""
    from ..model import Field
    from ..sources.store import Store
    from .search import KeywordSource, Search

    store = Store(spark, _scratch(spark), "searched", [Field("lang", "text"), Field("source", "text")])
    with store.transaction():
        store.upsert(items(spark, sf_dir).select("id", "text", "lang", "source"))
    search = Search(store, sources=[KeywordSource(store)], base_filter=p.eq("lang", "en"), distinct_by="source", max_chars=20000, depth=20)
    hits = search.run(_benchmark(spark, sf_dir), 5).hits
    return hits.select("qid", "ord", "id", F.round("score", 6).alias("score"), "source", "lang")


@query("""
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE doc_id % 3 <> 0) AS b, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT vec_id FROM embeddings)) AS c, count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS v FROM documents)
SELECT 1 AS step, 'upsert' AS what, a AS items, 0::BIGINT AS vectors, a AS missing, true AS stale FROM n
UNION ALL SELECT 2, 'add_vectors', a, v, a - v, true FROM n
UNION ALL SELECT 3, 'remove', b, c, b - c, true FROM n
UNION ALL SELECT 4, 'sync', b, c, b - c, false FROM n
UNION ALL SELECT 5, 'clear', 0, 0, 0, false FROM n""")
def store_lifecycle(spark, sf_dir):
    """What a store holds after each of five transactions: items, vectors, items without one, and whether its keywords are stale."""
    from ..model import VectorSpace
    from ..sources.store import Store, Vectors

    store, docs, rows = Store(spark, _scratch(spark), "lived"), items(spark, sf_dir).select("id", "text"), []
    have = _vectors(spark, sf_dir).select("id", "vec").join(docs.select("id"), "id", "left_semi")

    def after(what: str) -> None:
        rows.append((len(rows) + 1, what, store.items.count(), store.vectors.count(), store.missing_vectors().count(), store.keywords_stale))

    with store.transaction():
        store.defer_keywords()
        store.upsert(docs)
    after("upsert")
    with store.transaction():
        store.add_vectors(Vectors(VectorSpace("given", "table", dims=64), have))
    after("add_vectors")
    with store.transaction():
        store.remove(docs.where("id % 3 = 0").select("id"))
    after("remove")
    with store.transaction():
        store.sync_keywords()
    after("sync")
    with store.transaction():
        store.clear()
    after("clear")
    return spark.createDataFrame(rows, "step int, what string, items bigint, vectors bigint, missing bigint, stale boolean")


# -- chunking ----------------------------------------------------------------------------

#: Lines are folded into chunks row by row; the texts of this table have no headings, fences or blank lines.
_CHUNK_SQL = r"""
WITH RECURSIVE d AS (SELECT conv_id * 1000 + turn AS id, text, list_transform(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), lambda x: length(x)) AS n FROM conversations WHERE text IS NOT NULL),
s(id, k, start, pos, cuts) AS (
  SELECT id, 1, 0::BIGINT, 0::BIGINT, [0::BIGINT] FROM d
  UNION ALL
  SELECT s.id, k + 1,
    CASE WHEN n[k] > 200 THEN pos + n[k] WHEN pos > start AND pos - start + n[k] > 200 THEN pos ELSE start END,
    pos + n[k],
    cuts || CASE WHEN pos > start AND pos - start + n[k] > 200 THEN [pos] ELSE []::BIGINT[] END
         || CASE WHEN n[k] > 200 THEN list_transform(range(1, CAST(ceil(n[k] / 200.0) AS BIGINT)), lambda i: pos + i * 200) || [pos + n[k]] ELSE []::BIGINT[] END
  FROM s JOIN d ON d.id = s.id WHERE k <= len(n)),
f AS (SELECT d.id, text, list_sort(list_distinct(cuts || [length(text)])) AS c FROM s JOIN d ON d.id = s.id WHERE k = len(n) + 1),
x AS (SELECT id, text, unnest(range(1, len(c))) AS o, c FROM f)
SELECT id, CAST(c[o] AS INTEGER) AS "start", CAST(c[o + 1] AS INTEGER) AS "end", substr(text, c[o] + 1, c[o + 1] - c[o]) AS text
FROM x WHERE length(trim(substr(text, c[o] + 1, c[o + 1] - c[o]), e' \t\n\r')) >= 1"""


@query(_CHUNK_SQL)
def chunk_text(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return chunking.chunked(rows, chunking.LineChunker(200, 1)).select("id", "start", "end", "text")


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunked(items(spark, sf_dir), chunking.LineChunker()).select("id", "ord", "start", "end", "start_line", "end_line")


@query()
def discover_files(spark, sf_dir):
    from ..sources.files import discover

    return discover(spark, sf_dir)


@query()
def encode_texts(spark, sf_dir):
    from ..sources.encoders import HashEncoder, with_vectors

    return with_vectors(items(spark, sf_dir).select("id", "text"), HashEncoder(16)).select("id", "vec")
