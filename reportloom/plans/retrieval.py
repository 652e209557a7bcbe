"""Queries of vector search, ranking, fusion, deduplication and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import evals as E
from reportloom.operators import ranking as K
from reportloom.operators import resolve as R
from reportloom.operators import vectors as V
from reportloom.plans import snippets as S
from reportloom.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The queries of a vector search are the rows whose id is divisible by 50; they are sought among all rows.
def _topk(spark, sf, k=5, distance="cosine", threshold=None, **wanted):
    e = table(spark, sf, "embeddings")
    return V.vector_topk(e.where("vec_id % 50 = 0"), V.metadata_filter(e, **wanted), "vec_id", "embedding", k, distance, threshold)


def _topk_sql(score: str, k: int = 5, where: str = "true", least: str = "true") -> str:
    return f"""s AS (SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings v WHERE q.vec_id <> v.vec_id AND v.{where if where != 'true' else 'vec_id IS NOT NULL'}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE {least} QUALIFY rank <= {k})"""


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_EUC = "-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query("WITH " + _topk_sql(_COS) + " SELECT query_id, vec_id, score, rank FROM top")
def vector_topk(spark, sf):
    return _topk(spark, sf)


@query("WITH " + _topk_sql(_COS, where="label IN (1, 3)") + " SELECT query_id, vec_id, score, rank FROM top")
def vector_topk_filtered(spark, sf):
    return _topk(spark, sf, label=[1, 3])


@query("WITH " + _topk_sql(_DOT) + " SELECT query_id, vec_id, score, rank FROM top")
def vector_topk_dot(spark, sf):
    return _topk(spark, sf, distance="dot")


@query("WITH " + _topk_sql(_EUC) + " SELECT query_id, vec_id, score, rank FROM top")
def vector_topk_euclid(spark, sf):
    return _topk(spark, sf, distance="euclid")


@query("WITH " + _topk_sql(_COS, 10, least="score >= 0.2") + " SELECT query_id, vec_id, score, rank FROM top")
def vector_topk_threshold(spark, sf):
    return _topk(spark, sf, 10, threshold=0.2)


@query("SELECT chunk_id, page_number FROM (SELECT DISTINCT chunk_id, page_number, ticker, year, lower(trim(language)) AS l FROM chunks WHERE deleted_at IS NULL) WHERE ticker IN ('GUSUR', 'TIMAT') AND year = 2020 AND l = 'tr'")
def metadata_filter(spark, sf):
    c = table(spark, sf, "chunks").where("deleted_at IS NULL")
    return V.metadata_filter(c.withColumn("l", F.lower(F.trim("language"))), ticker=["GUSUR", "TIMAT"], year=2020, l="tr", company=None).select("chunk_id", "page_number").distinct()


_PAIR = "WITH " + _topk_sql(_COS, 10) + ", " + _topk_sql(_DOT, 10).replace("s AS", "s2 AS").replace("top AS", "top2 AS").replace("FROM s ", "FROM s2 ")


def _two(spark, sf):
    return _topk(spark, sf, 10), _topk(spark, sf, 10, "dot")


@query(_PAIR + """, u AS (SELECT query_id, vec_id, rank, 1 AS l FROM top UNION ALL SELECT query_id, vec_id, rank, 2 FROM top2)
SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fusion_score, min(rank) AS best_rank, count(DISTINCT l) AS lists FROM u GROUP BY 1, 2""")
def rrf_multi(spark, sf):
    return K.rrf(list(_two(spark, sf)), "vec_id")


@query(_PAIR + """, u AS (SELECT query_id, vec_id, rank, 1 AS l FROM top UNION ALL SELECT query_id, vec_id, rank, 2 FROM top2),
f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fs, min(l) AS a, max(l) AS b FROM u GROUP BY 1, 2),
g AS (SELECT query_id, vec_id, round(fs / max(fs) OVER (PARTITION BY query_id), 4) AS score, CASE WHEN a <> b THEN 'fused' WHEN a = 1 THEN 'vector' ELSE 'graph' END AS source FROM f)
SELECT query_id, vec_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM g QUALIFY rank <= 10""")
def rrf_pair(spark, sf):
    return K.hybrid_fusion(*_two(spark, sf), "vec_id")


@query(_PAIR + """, u AS (SELECT query_id, vec_id, round(score * 0.6::DOUBLE, 6) AS score, 'vector' AS source, 0 AS o FROM top UNION ALL SELECT query_id, vec_id, round(score * 0.4::DOUBLE, 6), 'graph', 1 FROM top2)
SELECT query_id, vec_id, score, source FROM u QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY o, score DESC) = 1""")
def weighted_merge(spark, sf):
    return K.weighted_merge(*_two(spark, sf), "vec_id")


# A golden question's candidates are the chunks it names; scores come from the words alone.
_CAND = f"""WITH c AS (SELECT chunk_id, min(text) AS text, min(ticker) AS ticker, min(year) AS year, min(document_id || '#' || page_number) AS page FROM chunks WHERE text IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT id, question, source_file, trim(unnest(source_chunk_ids)) AS chunk_id FROM golden_test),
j AS (SELECT g.id, c.chunk_id, question, text, page, c.ticker, c.year, regexp_extract(source_file, '([A-Z]+)__', 1) AS qt, TRY_CAST(regexp_extract(source_file, '__([0-9]+)__', 1) AS INT) AS qy FROM g JOIN c USING (chunk_id)),
w AS (SELECT *, {S.answer_words('text')} AS tw, list_distinct(list_filter({S.answer_words('question')}, lambda w: length(w) > 1 AND NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in K.STOP_WORDS)}], w))) AS qw FROM j),
s AS (SELECT *, CASE WHEN len(qw) > 0 THEN round({S.inter('qw', 'tw')} / len(qw)::DOUBLE, 4) ELSE 0.0 END AS lex FROM w)"""


def _candidates(spark, sf):
    c = table(spark, sf, "chunks").where("text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("ticker").alias("ticker"), F.min("year").alias("year"), F.min(F.concat("document_id", F.lit("#"), F.col("page_number").cast("string"))).alias("page"))
    g = table(spark, sf, "golden_test").select("id", "question", "source_file", F.explode("source_chunk_ids").alias("chunk_id")).withColumn("chunk_id", F.trim("chunk_id")).distinct()
    g = g.withColumn("qt", F.regexp_extract("source_file", "([A-Z]+)__", 1)).withColumn("qy", F.regexp_extract("source_file", "__([0-9]+)__", 1).try_cast("int"))
    return g.join(c, "chunk_id").withColumn("lex", K.lexical_overlap(F.col("question"), F.col("text")))


@query(_CAND + " SELECT id, chunk_id, lex FROM s")
def lexical_overlap(spark, sf):
    return _candidates(spark, sf).select("id", "chunk_id", "lex")


_BASE = ", b AS (SELECT *, round(0.5::DOUBLE * lex + 0.3::DOUBLE * lex + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN ticker = qt THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) - (CASE WHEN year = qy THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)), 6) AS base FROM s)"


def _based(spark, sf):
    c = _candidates(spark, sf)
    return c.withColumn("base", K.base_score(F.col("lex"), F.col("lex"), F.coalesce(F.col("ticker") == F.col("qt"), F.lit(False)), F.coalesce(F.col("year") == F.col("qy"), F.lit(False))))


@query(_CAND + _BASE + " SELECT id, chunk_id, base FROM b")
def rerank_base(spark, sf):
    return _based(spark, sf).select("id", "chunk_id", "base")


_BW = S.blank_words("text")
_SIM = S.jaccard("x.words", "p.words")
_MMR = _CAND.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + _BASE + f""", k AS (SELECT id, chunk_id, base, page, {_BW} AS words FROM b),
r AS (SELECT id, [chunk_id] AS chosen, chunk_id, base AS v, 1 AS pick FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY base DESC, chunk_id) = 1
  UNION ALL SELECT id, list_append(chosen, chunk_id), chunk_id, v, pick + 1 FROM (
    SELECT r.id, r.chosen, r.pick, x.chunk_id, round(x.base - (SELECT coalesce(sum(0.15::DOUBLE * (p.page = x.page)::INT + (CASE WHEN {_SIM} > 0.6 THEN {_SIM} * 0.5::DOUBLE ELSE 0.0::DOUBLE END)), 0) FROM k p WHERE p.id = r.id AND list_contains(r.chosen, p.chunk_id)), 6) AS v
    FROM r JOIN k x ON x.id = r.id AND NOT list_contains(r.chosen, x.chunk_id) WHERE r.pick < 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, chunk_id) = 1)
SELECT id, chunk_id, pick, v AS final_score FROM r"""


@query(_MMR)
def mmr_select(spark, sf):
    return K.diverse_selection(_based(spark, sf), "id", "chunk_id", "base", "text", "page", 3)


@query(_CAND + _BASE + """, o AS (SELECT id, chunk_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY id ORDER BY base DESC, chunk_id)::BIGINT AS used, row_number() OVER (PARTITION BY id ORDER BY base DESC, chunk_id) AS rn FROM b)
SELECT id, chunk_id, used FROM o WHERE used <= 1500 OR rn = 1""")
def context_budget(spark, sf):
    return K.within_budget(_based(spark, sf), "id", [F.desc("base"), "chunk_id"], F.length("text"), 1500).select("id", "chunk_id", "used")


def _greedy_sql(rows: str, group: str, key: str, limit: float) -> str:
    """Rows numbered i in order within their group, with words, folded by recursion."""
    same = S.jaccard("k.words", "y")
    return f"""{rows}, r AS (SELECT {group}, i, [{key}] AS kept, [words] AS ws FROM k WHERE i = 1
  UNION ALL SELECT {group}, i, CASE WHEN dup THEN kept ELSE list_append(kept, {key}) END, CASE WHEN dup THEN ws ELSE list_append(ws, words) END
  FROM (SELECT k.*, r.kept, r.ws, len(list_filter(r.ws, lambda y: {same} >= {limit})) > 0 AS dup FROM r JOIN k ON k.{group} = r.{group} AND k.i = r.i + 1))
SELECT {group}, unnest(kept) AS {key} FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY i DESC) = 1)"""


@query(_greedy_sql(_CAND.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + _BASE + f", k AS (SELECT id, chunk_id, {_BW} AS words, row_number() OVER (PARTITION BY id ORDER BY base DESC, chunk_id) AS i FROM b)", "id", "chunk_id", 0.8))
def context_dedupe(spark, sf):
    c = _based(spark, sf)
    return K.greedy_distinct(c, ["id"], "chunk_id", "text", F.struct(-F.col("base"), F.col("chunk_id")), 0.8)


@query("""SELECT DISTINCT h.chunk_id AS hit_id, c.chunk_id, abs(c.page_number - h.page_number) AS distance FROM (SELECT DISTINCT chunk_id, ticker, year, page_number FROM chunks WHERE ('0x' || left(sha256(chunk_id), 8))::BIGINT % 50 = 0) h
JOIN chunks c ON c.ticker = h.ticker AND c.year = h.year AND abs(c.page_number - h.page_number) <= 1 AND c.chunk_id <> h.chunk_id""")
def context_window(spark, sf):
    # the hits are the chunks whose digest is divisible by 50, sought among all chunks
    c = table(spark, sf, "chunks").select("chunk_id", "ticker", "year", "page_number").distinct()
    return V.context_window(c.where(F.conv(F.substring(F.sha2("chunk_id", 256), 1, 8), 16, 10).cast("bigint") % 50 == 0), c, 1)


_MODE_Q = S.lower_tr("coalesce(question, '')")


@query(f"SELECT id, CASE WHEN {S.has(_MODE_Q, K.GRAPH_PHRASES)} AND NOT {S.has(_MODE_Q, K.GRAPH_BUT)} THEN 'graph' WHEN {S.has(_MODE_Q, K.VECTOR_PHRASES)} AND NOT {S.has(_MODE_Q, K.VECTOR_BUT)} THEN 'vector' ELSE 'hybrid' END AS mode FROM golden_test")
def route_mode(spark, sf):
    return table(spark, sf, "golden_test").select("id", K.retrieval_mode(F.col("question")).alias("mode"))


@query(_CAND + f""", v AS (SELECT j.id, chunk_id, ticker, qt, {S.lower_tr('text')} AS t, list_distinct(list_filter({S.answer_words('j.question')}, lambda w: length(w) > 4)) AS lw, coalesce(expected_entities, []) AS kw FROM j JOIN (SELECT id, any_value(expected_entities) AS expected_entities FROM golden_test GROUP BY 1) USING (id))
SELECT id, chunk_id, ticker = qt AND (len(list_filter(kw, lambda w: contains(t, {S.lower_tr('w')}))) > 0 OR len(list_filter(lw, lambda w: contains(t, w))) >= 2) AS relevant FROM v""")
def hit_relevance(spark, sf):
    k = table(spark, sf, "golden_test").select("id", F.coalesce("expected_entities", F.array().cast("array<string>")).alias("kw"))
    c = _candidates(spark, sf).join(k, "id")
    return c.select("id", "chunk_id", K.is_relevant(F.col("ticker"), F.col("qt"), F.col("text"), F.col("kw"), F.col("question")).alias("relevant"))


# --- deduplication ----------------------------------------------------------------------------------------------

@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1")
def exact_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT ticker, year, report_type, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY ticker, year, report_type, lang ORDER BY coalesce(n_chars, 0) DESC, doc_id) = 1")
def most_complete(spark, sf):
    d = table(spark, sf, "documents").select("ticker", "year", "report_type", "lang", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return R.first_per_key(d, ["ticker", "year", "report_type", "lang"], [-F.col("n"), F.col("doc_id")]).select("ticker", "year", "report_type", "lang", "doc_id")


@query("SELECT ticker, year, document_id FROM (SELECT ticker, year, document_id, any_value(lower(trim(language)) = 'tr') AS tr, max(page_number) AS pages FROM (SELECT ticker, year, document_id, page_number, 'tr' AS language FROM chunks WHERE contains(source_file, '__tr__') UNION ALL SELECT ticker, year, document_id, page_number, 'xx' FROM chunks WHERE NOT contains(source_file, '__tr__')) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY ticker, year ORDER BY tr DESC, pages DESC, document_id) = 1")
def one_report_a_year(spark, sf):
    c = table(spark, sf, "chunks").groupBy("ticker", "year", "document_id").agg(F.max(F.contains("source_file", F.lit("__tr__"))).alias("tr"), F.max("page_number").alias("pages"))
    return R.first_per_key(c, ["ticker", "year"], [~F.col("tr"), -F.col("pages"), F.col("document_id")]).select("ticker", "year", "document_id")


@query("SELECT count(*) AS mentions FROM (SELECT DISTINCT id, type, canonical_name, source_chunk_id, page_number, evidence_text, confidence FROM input_entities)")
def mention_dedupe(spark, sf):
    e = table(spark, sf, "input_entities").select(R.record_key([F.col(c) for c in ("id", "type", "canonical_name", "source_chunk_id", "page_number", "evidence_text", "confidence")]).alias("k"))
    return e.distinct().agg(F.count(F.lit(1)).alias("mentions"))


@query("SELECT item_id FROM (" + _greedy_sql(f"WITH RECURSIVE k AS (SELECT 1 AS one, item_id, {_BW} AS words, row_number() OVER (ORDER BY item_id) AS i FROM eval_items WHERE text IS NOT NULL)", "one", "item_id", 0.85) + ")")
def near_dup_greedy(spark, sf):
    return K.greedy_distinct_all(table(spark, sf, "eval_items"), "item_id", "text", 0.85)


def near_dup_documents(spark, sf):
    return K.greedy_distinct_all(table(spark, sf, "documents"), "doc_id", "text", 0.85)


QUERIES["near_dup_documents"] = near_dup_documents


# --- retrieval metrics: the true rows of a vector query are the rows of its label among its ten best by dot product ---

_TRUTH = _PAIR + """, truth AS (SELECT t.query_id, list(t.vec_id ORDER BY t.rank) AS truth FROM top2 t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.vec_id WHERE a.label = b.label GROUP BY 1),
m AS (SELECT g.query_id, got, coalesce(truth, []) AS truth FROM (SELECT query_id, list(vec_id ORDER BY rank) AS got FROM top GROUP BY 1) g LEFT JOIN truth USING (query_id))"""


def _judged(spark, sf):
    top, dot = _two(spark, sf)
    lab = table(spark, sf, "embeddings").select("vec_id", "label")
    ordered = lambda df, out: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias(out))  # noqa: E731  ten rows a query
    t = dot.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label = own")
    return ordered(top, "got").join(ordered(t, "truth"), "query_id", "left").withColumn("truth", F.coalesce("truth", F.array().cast("array<bigint>")))


_HIT = "list_filter(range(1, len(got) + 1), lambda i: list_contains(truth, got[i]))"
_GAIN = "coalesce(list_sum(list_transform(range(1, least(k, len(got)) + 1), lambda i: CASE WHEN list_contains(truth, got[i]) THEN 1.0::DOUBLE / log2(i + 1) ELSE 0.0::DOUBLE END)), 0)"
_IDEAL = "list_sum(list_transform(range(1, least(k, len(truth)) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))"


@query(_TRUTH + f"""SELECT query_id, CASE WHEN len(truth) > 0 THEN round(len(list_filter(truth, lambda x: list_contains(got[:5], x))) / len(truth)::DOUBLE, 6) ELSE 1.0 END AS recall_5,
round(len(list_filter(got[:5], lambda x: list_contains(truth, x))) / len(got[:5])::DOUBLE, 6) AS precision_5, CASE WHEN len({_HIT}) > 0 THEN round(1.0::DOUBLE / {_HIT}[1], 6) ELSE 0.0 END AS mrr,
CASE WHEN len(truth) > 0 THEN round({_GAIN.replace('k,', '5,')} / {_IDEAL.replace('k,', '5,')}, 6) ELSE 0.0 END AS ndcg_5 FROM m""")
def retrieval_metrics(spark, sf):
    g, t = F.col("got"), F.col("truth")
    return _judged(spark, sf).select("query_id", E.recall_at(g, t, 5).alias("recall_5"), E.precision_at(g, t, 5).alias("precision_5"), E.reciprocal_rank(g, t).alias("mrr"), E.ndcg_at(g, t, 5).alias("ndcg_5"))


@query(_TRUTH + f"SELECT round(avg((coalesce({_HIT}[1], 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce({_HIT}[1], 99) <= 3)::INT), 6) AS hit_3, round(avg((coalesce({_HIT}[1], 99) <= 5)::INT), 6) AS hit_5, count(*) AS queries FROM m")
def hit_rates(spark, sf):
    first = F.coalesce(F.array_min(F.filter(F.transform("got", lambda x, i: F.when(F.array_contains("truth", x), i + 1)), lambda i: i.isNotNull())), F.lit(99))
    m = _judged(spark, sf).select(first.alias("f"))
    return m.agg(*[F.round(F.avg((F.col("f") <= k).cast("int")), 6).alias(f"hit_{k}") for k in (1, 3, 5)], F.count(F.lit(1)).alias("queries"))


# --- answers: a golden answer against its evaluation text ---------------------------------------------------------

_ANS = f"""WITH j AS (SELECT i.item_id, i.text AS answer, g.expected_answer AS expected, g.acceptable_answers AS others, g.answerable FROM eval_items i JOIN golden_test g ON g.id = i.golden_id),
w AS (SELECT *, {S.answer_words('answer')} AS a, {S.answer_words('expected')} AS e, {S.numbers('answer')} AS na, {S.numbers('expected')} AS ne FROM j)"""
_SAME = "list_sum(list_transform(list_distinct(list_filter(a, lambda z: list_contains(e, z))), lambda z: least(len(list_filter(a, lambda y: y = z)), len(list_filter(e, lambda y: y = z)))))"


def _answers(spark, sf):
    g = table(spark, sf, "golden_test").select(F.col("id").alias("golden_id"), F.col("expected_answer").alias("expected"), F.col("acceptable_answers").alias("others"), "answerable")
    return table(spark, sf, "eval_items").select("item_id", "golden_id", F.col("text").alias("answer")).join(g, "golden_id")


@query(_ANS + f"""SELECT item_id, CASE WHEN len(a) = 0 AND len(e) = 0 THEN 1.0 WHEN len(a) = 0 OR len(e) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * coalesce({_SAME}, 0) / (len(a) + len(e)), 6) END AS f1,
CASE WHEN len(list_distinct(e)) > 0 THEN round({S.inter('e', 'a')} / len(list_distinct(e))::DOUBLE, 6) ELSE 1.0 END AS completeness,
CASE WHEN len(ne) > 0 THEN round({S.inter('ne', 'na')} / len(ne)::DOUBLE, 6) ELSE 1.0 END AS numeric_accuracy FROM w""")
def answer_scores(spark, sf):
    a, e = F.col("answer"), F.col("expected")
    return _answers(spark, sf).select("item_id", E.token_f1(a, e).alias("f1"), E.completeness(a, e).alias("completeness"), E.numeric_accuracy(a, e).alias("numeric_accuracy"))


_N = lambda c: f"array_to_string({c}, ' ')"


@query(_ANS + f"""SELECT item_id, coalesce({_N('a')} = {_N('e')}, false) OR len(list_filter(coalesce(others, []), lambda x: array_to_string({S.answer_words('x')}, ' ') = {_N('a')})) > 0 AS exact,
CASE WHEN {_N('a')} = '' OR {_N('e')} = '' THEN 0.0 WHEN contains({_N('a')}, {_N('e')}) OR contains({_N('e')}, {_N('a')}) THEN 1.0 ELSE round({S.jaccard('list_distinct(a)', 'list_distinct(e)')}, 6) END AS matched FROM w""")
def answer_match(spark, sf):
    a, e = F.col("answer"), F.col("expected")
    return _answers(spark, sf).select("item_id", E.exact_match(a, e, F.col("others")).alias("exact"), E.normalized_match(a, e).alias("matched"))


@query("""WITH r AS (SELECT len(coalesce(source_chunk_ids, [])) = 0 AS abstained, coalesce(answerable, false) AS ok FROM golden_test),
c AS (SELECT count(*) AS rows, avg((abstained <> ok)::INT) AS acc, count(*) FILTER (WHERE abstained AND NOT ok) AS tp, count(*) FILTER (WHERE abstained AND ok) AS fp, count(*) FILTER (WHERE NOT abstained AND NOT ok) AS fn FROM r),
d AS (SELECT *, tp / greatest(tp + fp, 0.001::DOUBLE) AS p, tp / greatest(tp + fn, 0.001::DOUBLE) AS r FROM c)
SELECT rows, round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 0.001::DOUBLE), 6) AS f1 FROM d""")
def abstention(spark, sf):
    g = table(spark, sf, "golden_test").select((F.coalesce(F.size("source_chunk_ids"), F.lit(0)) <= 0).alias("ab"), F.coalesce("answerable", F.lit(False)).alias("ok"))
    return E.abstention_scores(g, F.col("ab"), F.col("ok"))


_CITE = """WITH g AS (SELECT id, list_distinct(list_filter(list_transform(coalesce(source_chunk_ids, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')) AS cited FROM golden_test),
k AS (SELECT DISTINCT chunk_id FROM chunks WHERE deleted_at IS NULL), v AS (SELECT id, list(x) AS ok FROM (SELECT id, unnest(cited) AS x FROM g) JOIN k ON k.chunk_id = x GROUP BY 1)"""


@query(_CITE + """SELECT g.id, CASE WHEN len(cited) > 0 THEN round(len(coalesce(ok, [])) / len(cited)::DOUBLE, 6) ELSE 1.0 END AS precision, 1.0::DOUBLE AS recall FROM g LEFT JOIN v USING (id)""")
def citation_metrics(spark, sf):
    g = table(spark, sf, "golden_test").select("id", F.array_distinct(F.filter(F.transform(F.coalesce("source_chunk_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))).alias("cited"))
    k = table(spark, sf, "chunks").where("deleted_at IS NULL").select("chunk_id").distinct()
    v = g.select("id", F.explode("cited").alias("chunk_id")).join(k, "chunk_id", "left_semi").groupBy("id").agg(F.collect_set("chunk_id").alias("ok"))  # a question's few ids
    p, r = E.set_scores(F.col("cited"), F.col("ok"))
    return g.join(v, "id", "left").withColumn("ok", F.coalesce("ok", F.array().cast("array<string>"))).select("id", F.when(F.size("cited") > 0, p).otherwise(1.0).alias("precision"), r.alias("recall"))


_LONG = lambda s: f"list_distinct(list_filter({S.answer_words(s)}, lambda w: length(w) >= 4))"


@query(f"""WITH j AS (SELECT i.item_id, {S.sentences('i.text')} AS ss, {S.answer_words("coalesce(g.expected_answer, '') || ' ' || coalesce(g.question, '')")} AS c FROM eval_items i JOIN golden_test g ON g.id = i.golden_id),
u AS (SELECT item_id, c, len(ss) AS n, unnest(ss) AS s FROM j), o AS (SELECT item_id, any_value(n) AS n, count(*) FILTER (WHERE len({_LONG('s')}) > 0 AND {S.inter(_LONG('s'), 'c')} >= 0.3::DOUBLE * len({_LONG('s')})) AS ok FROM u GROUP BY 1)
SELECT j.item_id, coalesce(round(ok / n::DOUBLE, 6), 0.0) AS support FROM j LEFT JOIN o USING (item_id)""")
def sentence_support(spark, sf):
    g = table(spark, sf, "golden_test").select(F.col("id").alias("golden_id"), F.concat_ws(" ", F.coalesce("expected_answer", F.lit("")), F.coalesce("question", F.lit(""))).alias("c"))
    return table(spark, sf, "eval_items").join(g, "golden_id").select("item_id", E.sentence_support(F.col("text"), F.col("c")).alias("support"))


@query(f"SELECT item_id, len(list_filter({S.sentences('text')}, lambda s: regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '\\[[^\\]]+\\]'))) AS uncited FROM eval_items")
def uncited_numbers(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", E.uncited_numbers(F.col("text")).alias("uncited"))


# --- agreement: two similarity columns of the resolution decisions as scores of 1 to 5 --------------------------------

_SC = "SELECT decision_id, least(5, greatest(1, round(1 + 4 * name_similarity)))::INT AS a, least(5, greatest(1, round(1 + 4 * context_similarity)))::INT AS b FROM (SELECT decision_id, min(name_similarity) AS name_similarity, min(context_similarity) AS context_similarity FROM resolution_decisions GROUP BY 1)"


def _scores(spark, sf):
    d = table(spark, sf, "resolution_decisions").groupBy("decision_id").agg(F.min("name_similarity").alias("x"), F.min("context_similarity").alias("y"))
    s = lambda c: F.least(F.lit(5), F.greatest(F.lit(1), F.round(1 + 4 * F.col(c)))).cast("int")
    return d.select("decision_id", F.when(F.col("x").isNotNull(), s("x")).alias("a"), F.when(F.col("y").isNotNull(), s("y")).alias("b"))


_SCN = f"WITH s AS (SELECT decision_id, CASE WHEN n IS NOT NULL THEN a END AS a, CASE WHEN c IS NOT NULL THEN b END AS b FROM ({_SC.replace('SELECT decision_id, least', 'SELECT decision_id, name_similarity AS n, context_similarity AS c, least', 1)})), p AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(_SCN + """, k AS (SELECT a, b, count(*) AS c FROM p GROUP BY 1, 2), x AS (SELECT a, sum(c) AS c FROM k GROUP BY 1), y AS (SELECT b, sum(c) AS c FROM k GROUP BY 1)
SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one, round(avg(abs(a - b)), 6) AS mae, round(corr(a, b), 6) AS pearson,
(SELECT round(1.0::DOUBLE - (SELECT sum(c * (a - b) ** 2) * sum(c) FROM k)::DOUBLE / sum(x.c * y.c * (x.a - y.b) ** 2)::DOUBLE, 6) FROM x, y) AS kappa FROM p""")
def agreement(spark, sf):
    return E.agreement(_scores(spark, sf), "a", "b", "decision_id")


@query(_SCN + """, r AS (SELECT row_number() OVER (ORDER BY a, decision_id) AS ra, row_number() OVER (ORDER BY b, decision_id) AS rb FROM p)
SELECT count(*) AS n, round(1.0::DOUBLE - 6.0::DOUBLE * sum(((ra - rb) ** 2)::DOUBLE) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1.0::DOUBLE)), 6) AS spearman FROM r""")
def spearman(spark, sf):
    return E.spearman(_scores(spark, sf), "a", "b", "decision_id")


@query("SELECT id, question_type, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'dev' ELSE 'test' END AS part FROM (SELECT id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY id) AS rn, count(*) OVER (PARTITION BY question_type) AS n FROM golden_test)")
def stratified_split(spark, sf):
    return E.stratified_split(table(spark, sf, "golden_test").select("id", "question_type"), "question_type", "id")


@query("SELECT id, CASE WHEN ('0x' || left(sha256(id || '|' || 'seed-7'), 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM golden_test")
def blind_labels(spark, sf):
    return table(spark, sf, "golden_test").select("id", E.blind_label(F.col("id"), "seed-7").alias("label"))


@query("""WITH c AS (SELECT match_class AS metric, avg(name_similarity) AS value FROM resolution_decisions GROUP BY 1), b(metric, value, tolerance) AS (VALUES ('EXACT_MATCH', 0.9::DOUBLE, 0.05::DOUBLE), ('REVIEW_REQUIRED', 0.4::DOUBLE, 0.1::DOUBLE), ('NO_SUCH', 0.5::DOUBLE, 0.0::DOUBLE))
SELECT b.metric, round(c.value, 6) AS value, round(b.value * (1 - tolerance), 6) AS floor, coalesce(round(c.value, 6) >= round(b.value * (1 - tolerance), 6), false) AS passed FROM b LEFT JOIN c USING (metric)""")
def regression_gate(spark, sf):
    c = table(spark, sf, "resolution_decisions").groupBy(F.col("match_class").alias("metric")).agg(F.round(F.avg("name_similarity"), 6).alias("value"))
    b = spark.createDataFrame([("EXACT_MATCH", 0.9, 0.05), ("REVIEW_REQUIRED", 0.4, 0.1), ("NO_SUCH", 0.5, 0.0)], "metric string, value double, tolerance double")
    return E.regression_gate(c, b)


@query("SELECT event_type AS mode, count(*) AS rows, round(avg(value), 6) AS mean_value, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def mode_summary(spark, sf):
    return E.mode_summary(table(spark, sf, "events"), "event_type", ["value"], "value")


@query("SELECT match_class, n AS rows, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT match_class, count(*) AS n FROM resolution_decisions GROUP BY 1)")
def class_shares(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "resolution_decisions").groupBy("match_class").agg(F.count(F.lit(1)).alias("rows"))
    return d.select("match_class", "rows", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6).alias("share"))  # a handful of classes
