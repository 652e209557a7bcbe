"""Queries of the retrieval and answer benchmark, with their SQL.

Each golden question is ranked against all chunks of its company and year by lexical overlap, and against the chunks that most mentions of
its company cite (the graph side); lists hold TOP hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import benchmark as B
from reportloom.operators import ranking as K
from reportloom.operators import search as R
from reportloom.plans import snippets as S
from reportloom.session import table

QUERIES, SQL = {}, {}
TOP = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_RELATIONS = "CASE question_type WHEN 'numeric' THEN ['REPORTED_METRIC'] WHEN 'multi_hop' THEN ['HOLDS_ROLE_AT', 'OFFERS'] WHEN 'comparison' THEN ['OFFERS'] ELSE []::VARCHAR[] END"
_RANKS = f"""WITH c AS (SELECT lower(trim(chunk_id)) AS chunk_id, min(text) AS text, min(ticker) AS ticker, min(year) AS year, min(page_number) AS page, min(source_file) AS source, min(company) AS company FROM chunks WHERE text IS NOT NULL AND deleted_at IS NULL AND chunk_id IS NOT NULL GROUP BY 1),
q AS (SELECT id, question, question_type, coalesce(difficulty, 'unknown') AS difficulty, split, expected_answer, coalesce(answerable, false) AS answerable, source_file, nullif(regexp_extract(source_file, '([A-Z]+)__', 1), '') AS qt, TRY_CAST(regexp_extract(source_file, '__([0-9]+)__', 1) AS INT) AS qy,
  list_distinct(list_filter(list_transform(coalesce(source_chunk_ids, []), lambda x: lower(trim(x))), lambda x: x <> '')) AS truth, coalesce(source_pages, []) AS e_pages, coalesce(expected_entities, []) AS e_entities, {_RELATIONS} AS e_relations FROM golden_test),
qw AS (SELECT id, qt, qy, list_distinct(list_filter({S.answer_words('question')}, lambda w: length(w) > 1 AND w NOT IN ({_WORDS}))) AS w FROM q),
lx AS (SELECT id, chunk_id, CASE WHEN len(w) > 0 THEN round({S.inter('w', S.answer_words('text'))} / len(w)::DOUBLE, 4) ELSE 0.0 END AS score FROM qw JOIN c ON c.ticker = qt AND c.year = qy),
lex AS (SELECT id, chunk_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM lx WHERE score > 0 QUALIFY rank <= {TOP}),
me AS (SELECT regexp_extract(id, ':([A-Z]+):', 1) AS t, lower(trim(source_chunk_id)) AS chunk_id, count(*) AS n FROM input_entities WHERE source_chunk_id IS NOT NULL GROUP BY 1, 2),
gt AS (SELECT t, me.chunk_id, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, me.chunk_id) AS rank FROM me JOIN c USING (chunk_id) QUALIFY rank <= {TOP}),
gra AS (SELECT id, chunk_id, n::DOUBLE AS score, rank FROM q JOIN gt ON gt.t = qt),
hits AS (SELECT 'lexical' AS mode, * FROM lex UNION ALL SELECT 'graph', * FROM gra)"""
_RES = _RANKS + """, kind AS (SELECT lower(trim(source_chunk_id)) AS chunk_id, list_distinct(list(CASE type WHEN 'Person' THEN 'HOLDS_ROLE_AT' WHEN 'Product' THEN 'OFFERS' WHEN 'FinancialMetric' THEN 'REPORTED_METRIC' END) FILTER (WHERE type <> 'Company')) AS rel FROM input_entities WHERE source_chunk_id IS NOT NULL GROUP BY 1),
li AS (SELECT mode, id, list(chunk_id ORDER BY rank) AS got, list(source ORDER BY rank) AS sources, list(page ORDER BY rank) AS pages, list(DISTINCT company) FILTER (WHERE company IS NOT NULL) AS entities, flatten(list(coalesce(rel, []))) AS relations, sum(length(text))::BIGINT AS chars, min(ticker) FILTER (WHERE rank = 1) AS t1, min(year) FILTER (WHERE rank = 1) AS y1
  FROM hits JOIN c USING (chunk_id) LEFT JOIN kind USING (chunk_id) GROUP BY 1, 2),
res AS (SELECT m AS mode, q.*, [source_file] AS e_sources, coalesce(got, []) AS got, coalesce(sources, []) AS sources, coalesce(pages, []) AS pages, coalesce(entities, []) AS entities, coalesce(relations, []) AS relations, coalesce(chars, 0) AS chars, t1, y1
  FROM q CROSS JOIN (VALUES ('lexical'), ('graph')) v(m) LEFT JOIN li ON li.id = q.id AND li.mode = m)"""


def _ranks(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, chunks, lexical hits, graph hits)."""
    c = table(spark, sf, "chunks").where("text IS NOT NULL AND deleted_at IS NULL AND chunk_id IS NOT NULL").groupBy(F.lower(F.trim("chunk_id")).alias("chunk_id"))
    c = c.agg(*[F.min(a).alias(b) for a, b in (("text", "text"), ("ticker", "ticker"), ("year", "year"), ("page_number", "page"), ("source_file", "source"), ("company", "company"))])
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ids = F.array_distinct(F.filter(F.transform(F.coalesce("source_chunk_ids", none("string")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    rel = F.when(F.col("question_type") == "numeric", F.array(F.lit("REPORTED_METRIC"))).when(F.col("question_type") == "multi_hop", F.array(F.lit("HOLDS_ROLE_AT"), F.lit("OFFERS"))).when(F.col("question_type") == "comparison", F.array(F.lit("OFFERS"))).otherwise(none("string"))
    q = table(spark, sf, "golden_test").select(
        "id", "question", "question_type", F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), "split", "expected_answer", F.coalesce("answerable", F.lit(False)).alias("answerable"), "source_file", F.nullif(F.regexp_extract("source_file", "([A-Z]+)__", 1), F.lit("")).alias("qt"),
        F.regexp_extract("source_file", "__([0-9]+)__", 1).try_cast("int").alias("qy"), ids.alias("truth"), F.coalesce("source_pages", none("int")).alias("e_pages"), F.coalesce("expected_entities", none("string")).alias("e_entities"), rel.alias("e_relations"),
    )
    j = q.select("id", "question", F.col("qt").alias("ticker"), F.col("qy").alias("year")).join(c.select("chunk_id", "text", "ticker", "year"), ["ticker", "year"])
    lex = j.select("id", "chunk_id", K.lexical_overlap(F.col("question"), F.col("text")).alias("score")).where("score > 0")
    lex = B.top_ranked(lex, "id", [F.desc("score"), F.col("chunk_id")], TOP)
    me = table(spark, sf, "input_entities").where("source_chunk_id IS NOT NULL").groupBy(F.regexp_extract("id", ":([A-Z]+):", 1).alias("qt"), F.lower(F.trim("source_chunk_id")).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    gt = B.top_ranked(me.join(c.select("chunk_id"), "chunk_id", "left_semi"), "qt", [F.desc("n"), F.col("chunk_id")], TOP)
    return q, c, lex, q.select("id", "qt").join(gt, "qt").select("id", "chunk_id", F.col("n").cast("double").alias("score"), "rank")


def _results(spark, sf) -> DataFrame:
    q, c, lex, gra = _ranks(spark, sf)
    hits = lex.withColumn("mode", F.lit("lexical")).unionByName(gra.withColumn("mode", F.lit("graph")))
    e = table(spark, sf, "input_entities").where("source_chunk_id IS NOT NULL AND type <> 'Company'")
    rel = F.when(F.col("type") == "Person", "HOLDS_ROLE_AT").when(F.col("type") == "Product", "OFFERS").when(F.col("type") == "FinancialMetric", "REPORTED_METRIC")
    kind = e.groupBy(F.lower(F.trim("source_chunk_id")).alias("chunk_id")).agg(F.collect_set(rel).alias("rel"))  # three kinds at most
    first = lambda x: F.min(F.when(F.col("rank") == 1, F.col(x)))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(x).alias("x")))), lambda s: s["x"])  # noqa: E731  TOP rows at most
    li = hits.join(c, "chunk_id").join(kind, "chunk_id", "left").groupBy("mode", "id").agg(
        in_order("chunk_id").alias("got"), in_order("source").alias("sources"), in_order("page").alias("pages"), F.collect_set("company").alias("entities"), F.flatten(F.collect_list(F.coalesce("rel", F.array().cast("array<string>")))).alias("relations"),
        F.sum(F.length("text")).alias("chars"), first("ticker").alias("t1"), first("year").alias("y1"),
    )
    r = q.withColumn("mode", F.explode(F.array(F.lit("lexical"), F.lit("graph")))).withColumn("e_sources", F.array("source_file")).join(li, ["mode", "id"], "left")
    none = {"got": "string", "sources": "string", "pages": "int", "entities": "string", "relations": "string"}
    return r.withColumns({k: F.coalesce(k, F.array().cast(f"array<{v}>")) for k, v in none.items()}).withColumn("chars", F.coalesce("chars", F.lit(0)))


def _share(hit: str, of: str, empty: str) -> str:
    return f"CASE WHEN {of} > 0 THEN round({hit} / {of}::DOUBLE, 6) ELSE {empty} END"


def _lineage(got: str, want: str) -> str:
    low = lambda c: f"list_distinct(list_transform({c}, lambda x: lower(CAST(x AS VARCHAR))))"
    return _share(f"len(list_filter({low(want)}, lambda z: list_contains({low(got)}, z)))", f"len({low(want)})", "1.0")


def _ndcg(k: int) -> str:
    gain = f"coalesce(list_sum(list_transform(range(1, least({k}, len(got)) + 1), lambda i: CASE WHEN list_contains(truth, got[i]) THEN 1.0::DOUBLE / log2(i + 1) ELSE 0.0::DOUBLE END)), 0)"
    return f"CASE WHEN len(truth) > 0 THEN round({gain} / list_sum(list_transform(range(1, least({k}, len(truth)) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) ELSE 0.0 END"


_FIRST = "list_filter(range(1, len(got) + 1), lambda i: list_contains(truth, got[i]))[1]"
_PATH = "CASE WHEN len({e}) = 0 THEN 1.0 WHEN len({p}) = 0 THEN 0.0 ELSE round(len(list_filter({e}, lambda x: contains(lower(array_to_string({p}, ' ')), lower(x)))) / len({e})::DOUBLE, 6) END"
_M = {f"recall_{k}": _share(f"len(list_filter(truth, lambda z: list_contains(got[1:{k}], z)))", "len(truth)", "1.0") for k in B.CUT_OFFS}
_M |= {f"precision_{k}": _share(f"len(list_filter(got[1:{k}], lambda z: list_contains(truth, z)))", f"len(got[1:{k}])", "0.0") for k in B.CUT_OFFS}
_M |= {"mrr": f"coalesce(round(1.0::DOUBLE / {_FIRST}, 6), 0.0)", "ndcg_5": _ndcg(5), "ndcg_10": _ndcg(10), "chunk_recall": _lineage("got", "truth"), "source_recall": _lineage("sources", "e_sources"), "page_recall": _lineage("pages", "e_pages")}
_M |= {"entity_recall": _lineage("entities", "e_entities"), "relation_recall": _lineage("relations", "e_relations"), "path_recall": _PATH.format(e="e_entities", p="entities")}
_SCORED = _RES + ", sc AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _M.items()) + " FROM res)"
_MEANS = ", ".join(f"round(avg({m}), 4) AS mean_{m}" for m in B.METRICS)


@query(_SCORED + f" SELECT id, mode, got, {', '.join(B.METRICS)} FROM sc")
def benchmark_samples(spark, sf):
    return B.score_samples(_results(spark, sf)).select("id", "mode", "got", *B.METRICS)


@query(_SCORED + f" SELECT mode, split, count(*) AS samples, {_MEANS}, round(quantile_disc(chars, 0.5), 2)::BIGINT AS latency_p50, round(quantile_disc(chars, 0.95), 2)::BIGINT AS latency_p95, round(avg(chars), 2) AS mean_latency FROM sc GROUP BY ALL")
def benchmark_summary(spark, sf):
    # the characters of a list's texts stand for its latency
    return B.summarise(B.score_samples(_results(spark, sf)), ["mode", "split"], B.METRICS, "chars")


_SHORT = ["mrr", "recall_5", "source_recall"]


@query(_SCORED + f""" SELECT mode, 'question_type' AS what, question_type AS value, count(*) AS samples, {', '.join(f'round(avg({m}), 4) AS mean_{m}' for m in _SHORT)} FROM sc GROUP BY ALL
UNION ALL SELECT mode, 'difficulty', difficulty, count(*), {', '.join(f'round(avg({m}), 4)' for m in _SHORT)} FROM sc GROUP BY ALL""")
def benchmark_breakdown(spark, sf):
    s = B.score_samples(_results(spark, sf))
    s = s.select("mode", *_SHORT, F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).alias("value")) for w in ("question_type", "difficulty")])).alias("x")).select("mode", "x.what", "x.value", *_SHORT)
    return B.summarise(s, ["mode", "what", "value"], _SHORT)


@query(_SCORED + """ SELECT id, mode, question_type, mrr, list_sort(truth) AS truth, sources[1:3] AS top_sources, CASE WHEN source_recall < 0.5 THEN 'source_missed' ELSE 'chunk_missed' END AS reason FROM sc WHERE recall_5 = 0 AND len(truth) > 0 ORDER BY id, mode LIMIT 15""")
def failure_examples(spark, sf):
    s = B.failure_examples(B.score_samples(_results(spark, sf)), ["id", "mode"])
    return s.select("id", "mode", "question_type", "mrr", F.array_sort("truth").alias("truth"), F.slice("sources", 1, 3).alias("top_sources"), "reason")


_RATE = lambda c: f"round(avg(CASE WHEN answerable THEN coalesce({c}, false)::INT END), 6)"
_H = _RES + f", h AS (SELECT *, {_FIRST} AS f FROM res)"


@query(_H + f""" SELECT mode, count(*) AS questions, {_RATE('f <= 1')} AS hit_1, {_RATE('f <= 3')} AS hit_3, {_RATE('f <= 5')} AS hit_5, round(avg(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / f, 0.0) END), 6) AS mrr, {_RATE('t1 = qt')} AS company_match, {_RATE('y1 = qy')} AS year_match,
round(avg((len(got) > 0)::INT), 6) AS valid, round(avg(len(got)), 6) AS mean_hits, {_RATE('f <= 3')} >= 0.8 AND {_RATE('t1 = qt')} >= 0.9 AS targets_met FROM h GROUP BY 1""")
def question_set(spark, sf):
    r = _results(spark, sf).withColumn("f", F.array_min(F.filter(F.transform("got", lambda x, i: F.when(F.array_contains("truth", x), i + 1)), lambda i: i.isNotNull())))
    return r.groupBy("mode").agg(*B.hit_quality(F.col("f"), F.size("got"), F.col("t1") == F.col("qt"), F.col("y1") == F.col("qy"), F.size("got") > 0, F.col("answerable")))


_CITED = "sources[1:5]"


@query(_RES + f""" SELECT id, mode, CASE WHEN len({_CITED}) = 0 THEN 0.0 ELSE round(len(list_filter({_CITED}, lambda z: lower(z) = lower(source_file))) / len({_CITED})::DOUBLE, 6) END AS precision, {_lineage(_CITED, 'e_sources')} AS recall,
round(least(1.0::DOUBLE, len({_CITED}) / greatest(1, len({S.sentences('expected_answer')}))::DOUBLE), 6) AS coverage, CASE WHEN len(e_pages) = 0 THEN 1.0 WHEN len(pages[1:5]) = 0 THEN 0.0 ELSE round(len(list_filter(pages[1:5], lambda z: list_contains(e_pages, z))) / len(pages[1:5])::DOUBLE, 6) END AS page_accuracy FROM res""")
def citation_quality(spark, sf):
    r, cited = _results(spark, sf), F.slice("sources", 1, 5)
    p = F.when(F.size(cited) == 0, 0.0).otherwise(F.round(F.size(F.filter(cited, lambda z: F.lower(z) == F.lower("source_file"))) / F.size(cited), 6))
    claims = F.greatest(F.lit(1), F.size(T.sentences("expected_answer")))
    return r.select("id", "mode", p.alias("precision"), B.lineage_recall(cited, F.col("e_sources")).alias("recall"), B.citation_coverage(cited, claims).alias("coverage"), B.page_accuracy(F.slice("pages", 1, 5), F.col("e_pages")).alias("page_accuracy"))


@query(_SCORED + " SELECT id, mode, entity_recall, relation_recall, path_recall FROM sc")
def graph_recalls(spark, sf):
    return B.score_samples(_results(spark, sf)).select("id", "mode", "entity_recall", "relation_recall", "path_recall")


_AW, _EW = S.answer_words("i.text"), S.answer_words("s.expected_answer")
_SAMEW = "list_sum(list_transform(list_distinct(list_filter(a, lambda z: list_contains(e, z))), lambda z: least(len(list_filter(a, lambda y: y = z)), len(list_filter(e, lambda y: y = z)))))"
_METHOD = _SCORED + f""", an AS (SELECT i.item_kind AS method, i.item_id, s.mrr, s.path_recall, CASE WHEN len({_CITED.replace('sources', 's.sources')}) = 0 THEN 0.0 ELSE round(len(list_filter({_CITED.replace('sources', 's.sources')}, lambda z: lower(z) = lower(s.source_file))) / len({_CITED.replace('sources', 's.sources')})::DOUBLE, 6) END AS citation_precision,
  {_AW} AS a, {_EW} AS e FROM sc s JOIN eval_items i ON i.golden_id = s.id AND s.mode = CASE i.item_kind WHEN 'passage' THEN 'lexical' ELSE 'graph' END),
fs AS (SELECT *, CASE WHEN len(a) = 0 AND len(e) = 0 THEN 1.0 WHEN len(a) = 0 OR len(e) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * coalesce({_SAMEW}, 0) / (len(a) + len(e)), 6) END AS token_f1 FROM an),
ov AS (SELECT *, round(0.3::DOUBLE * mrr + 0.3::DOUBLE * token_f1 + 0.2::DOUBLE * citation_precision + 0.2::DOUBLE * path_recall, 4) AS overall FROM fs)"""


@query(_METHOD + " SELECT method, count(*) AS samples, round(avg(mrr), 4) AS mean_mrr, round(avg(token_f1), 4) AS mean_token_f1, round(avg(citation_precision), 4) AS mean_citation_precision, round(avg(path_recall), 4) AS mean_path_recall, round(avg(overall), 4) AS mean_overall FROM ov GROUP BY 1")
def method_scores(spark, sf):
    from reportloom.operators import evals as E

    # the two kinds of evaluation items stand for the answers of two methods, on the lexical and the graph side
    cited = F.slice("sources", 1, 5)
    p = F.when(F.size(cited) == 0, 0.0).otherwise(F.round(F.size(F.filter(cited, lambda z: F.lower(z) == F.lower("source_file"))) / F.size(cited), 6))
    s = B.score_samples(_results(spark, sf)).select(F.col("id").alias("golden_id"), "mode", "mrr", "path_recall", p.alias("citation_precision"), "expected_answer")
    i = table(spark, sf, "eval_items").select("golden_id", F.col("item_kind").alias("method"), "text", F.when(F.col("item_kind") == "passage", "lexical").otherwise("graph").alias("mode"))
    a = s.join(i, ["golden_id", "mode"]).withColumn("token_f1", E.token_f1(F.col("text"), F.col("expected_answer")))
    a = a.withColumn("overall", B.overall_score({k: F.col(k) for k in B.OVERALL}))
    return B.summarise(a, ["method"], ["mrr", "token_f1", "citation_precision", "path_recall", "overall"])


_MARKED = "regexp_replace(i.text, '([0-9]{4,})', '\\1 [1]', 'g')"


def _words_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in B.EMPTY_WORDS)
    plain = f"regexp_replace({c}, '\\[[^\\]]*\\]', '', 'g')"
    return f"list_filter({S.answer_words(plain)}, lambda w: length(w) >= 4 AND w NOT IN ({stop}))"


@query(f"""WITH j AS (SELECT i.item_id, {S.sentences(_MARKED)} AS ss, {S.lower_tr("coalesce(g.expected_answer, '') || ' ' || coalesce(g.question, '')")} AS ctx FROM eval_items i JOIN golden_test g ON g.id = i.golden_id),
u AS (SELECT item_id, ctx, s, {_words_sql('s')} AS ws FROM (SELECT item_id, ctx, unnest(ss) AS s FROM j) WHERE regexp_matches(s, '\\[(?:source\\s*)?\\d+\\]', 'i')),
o AS (SELECT item_id, count(*) AS cited, count(*) FILTER (WHERE len(ws) = 0 OR len(list_filter(ws, lambda w: contains(ctx, w))) >= 0.3::DOUBLE * len(ws)) AS supported FROM u GROUP BY 1)
SELECT j.item_id, len(ss)::INT AS sentences, coalesce(cited, 0)::INT AS cited, coalesce(supported, 0)::INT AS supported, CASE WHEN len(ss) = 0 THEN 0.0 WHEN coalesce(cited, 0) = 0 THEN 1.0 ELSE round(supported / cited::DOUBLE, 6) END AS support,
CASE WHEN len(ss) = 0 THEN 0.0 ELSE round(coalesce(cited, 0) / len(ss)::DOUBLE, 6) END AS coverage FROM j LEFT JOIN o USING (item_id)""")
def cited_support(spark, sf):
    # a number of four digits or more in an item is followed by a citation
    g = table(spark, sf, "golden_test").select(F.col("id").alias("golden_id"), F.concat_ws(" ", F.coalesce("expected_answer", F.lit("")), F.coalesce("question", F.lit(""))).alias("ctx"))
    i = table(spark, sf, "eval_items").join(g, "golden_id").select("item_id", B.cited_support(F.regexp_replace("text", "([0-9]{4,})", "$1 [1]"), F.col("ctx")).alias("s"))
    return i.select("item_id", "s.*")


_CAL = "WITH s AS (SELECT decision_id, least(5, greatest(1, round(1 + 4 * min(name_similarity)))) AS a, least(5, greatest(1, round(1 + 4 * min(context_similarity)))) AS b, min(name_similarity) AS x, min(context_similarity) AS y FROM resolution_decisions GROUP BY 1), p AS (SELECT a >= 4 AS h, b >= 4 AS j FROM s WHERE x IS NOT NULL AND y IS NOT NULL)"


@query(_CAL + """, n AS (SELECT count(*) FILTER (WHERE h AND j) AS tp, count(*) FILTER (WHERE NOT h AND j) AS fp, count(*) FILTER (WHERE NOT h AND NOT j) AS tn, count(*) FILTER (WHERE h AND NOT j) AS fn FROM p),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1.0 END AS re, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn)::DOUBLE ELSE 1.0 END AS ac, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0.0 END AS fa FROM n)
SELECT tp, fp, tn, fn, round(ac, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 1.0 END, 6) AS f1, round(fa, 6) AS false_pass_rate, ac >= 0.8 AND fa <= 0.15 AS accepted FROM r""")
def calibration(spark, sf):
    # two similarities of a decision, as scores of 1 to 5, stand for a person's and a judge's
    d = table(spark, sf, "resolution_decisions").groupBy("decision_id").agg(F.min("name_similarity").alias("x"), F.min("context_similarity").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    s = lambda c: F.least(F.lit(5), F.greatest(F.lit(1), F.round(1 + 4 * F.col(c)))) >= 4
    return B.confusion(d.select(s("x").alias("h"), s("y").alias("j")), F.col("h"), F.col("j"))


_SOUND = "(contains({a}, '" + B.REFUSAL + "') OR length(coalesce(answer, '')) > 10)"


@query(f"""WITH a AS (SELECT item_id, item_kind, i.text AS answer, sha256(coalesce(question, '') || '|' || coalesce(expected_answer, '') || '|' || coalesce(i.text, '')) AS key FROM eval_items i JOIN golden_test g ON g.id = i.golden_id),
c AS (SELECT DISTINCT key FROM a WHERE item_kind = 'passage') SELECT item_id, key, {', '.join(f"CASE WHEN c.key IS NOT NULL THEN 4.0 WHEN {_SOUND.format(a=S.lower_tr('coalesce(answer, chr(32))'))} THEN {v} ELSE {B.POOR[k]} END::DOUBLE AS {k}" for k, v in B.SOUND.items())}, c.key IS NOT NULL AS judge_cached FROM a LEFT JOIN c USING (key)""")
def judge_ratings(spark, sf):
    g = table(spark, sf, "golden_test").select(F.col("id").alias("golden_id"), "question", "expected_answer")
    a = table(spark, sf, "eval_items").join(g, "golden_id").select("item_id", "item_kind", F.col("text").alias("answer"), B.judge_key(F.col("question"), F.col("expected_answer"), F.col("text")).alias("key"))
    cache = a.where("item_kind = 'passage'").select("key", *[F.lit(4.0).alias(k) for k in B.SOUND])
    return B.judge(a.select("item_id", "key", "answer"), cache).drop("answer")


# --- search by mode ------------------------------------------------------------------------------------------------

_MQ = S.lower_tr("coalesce(question, '')")
_MODE = f"CASE WHEN {S.has(_MQ, K.GRAPH_PHRASES)} AND NOT {S.has(_MQ, K.GRAPH_BUT)} THEN 'graph' WHEN {S.has(_MQ, K.VECTOR_PHRASES)} AND NOT {S.has(_MQ, K.VECTOR_BUT)} THEN 'vector' ELSE 'hybrid' END"


@query(_RANKS + f""", md AS (SELECT id, CASE question_type WHEN 'multi_hop' THEN 'graph' WHEN 'numeric' THEN 'vector' ELSE {_MODE} END AS asked FROM q), nv AS (SELECT DISTINCT id FROM lex), ng AS (SELECT DISTINCT id FROM gra),
ex AS (SELECT id, asked, CASE WHEN asked = 'vector' THEN CASE WHEN id NOT IN (SELECT id FROM nv) AND id IN (SELECT id FROM ng) THEN 'graph' ELSE 'vector' END WHEN id NOT IN (SELECT id FROM ng) THEN 'vector' WHEN asked = 'graph' OR id NOT IN (SELECT id FROM nv) THEN 'graph' ELSE 'fused' END AS way FROM md),
al AS (SELECT id, chunk_id, way, asked, min(r) AS r, max(v) AS v, max(g) AS g, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT id, chunk_id, rank AS r, score AS v, NULL AS g, 'vector' AS side FROM lex UNION ALL SELECT id, chunk_id, rank, NULL, score, 'graph' FROM gra) JOIN ex USING (id)
  WHERE (way = 'fused' OR way = side) AND r <= CASE WHEN asked = 'hybrid' THEN 10 ELSE 5 END GROUP BY ALL),
sc AS (SELECT *, CASE way WHEN 'vector' THEN v WHEN 'graph' THEN g ELSE round(round(s, 6) / max(round(s, 6)) OVER (PARTITION BY id), 4) END AS score FROM al)
SELECT id AS query_id, chunk_id, asked, way AS executed, score, CASE WHEN v IS NOT NULL AND g IS NOT NULL THEN 'fused' WHEN v IS NOT NULL THEN 'vector' ELSE 'graph' END AS source, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc QUALIFY rank <= 5""")
def mode_dispatch(spark, sf):
    q, _, lex, gra = _ranks(spark, sf)
    asked = F.when(F.col("question_type") == "multi_hop", "graph").when(F.col("question_type") == "numeric", "vector").otherwise(K.retrieval_mode(F.col("question")))
    named = lambda d: d.withColumnRenamed("id", "query_id")
    return R.dispatch(q.select(F.col("id").alias("query_id"), asked.alias("asked")), named(lex), named(gra), "chunk_id", "query_id", 5)


@query(_RANKS + """, u AS (SELECT id, chunk_id, rank, score, 0 AS o, 'lexical' AS l FROM lex UNION ALL SELECT id, chunk_id, rank, score, 1, 'graph' FROM gra)
SELECT id AS query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fusion_score, min(rank)::INT AS best_rank, count(DISTINCT l) AS query_count, list_transform(list_sort(list(DISTINCT {'o': o, 'l': l})), lambda x: x.l) AS matched_queries, min_by(score, o) AS first_score FROM u GROUP BY 1, 2""")
def rrf_matched(spark, sf):
    _, _, lex, gra = _ranks(spark, sf)
    named = lambda d: d.withColumnRenamed("id", "query_id")
    return R.rrf_matched([("lexical", named(lex)), ("graph", named(gra))], "chunk_id", "query_id", "score")


_INTENT_Q = S.lower_tr("coalesce(question, '')")


def _intent_list(i: int) -> str:
    parts = ", ".join(f"CASE WHEN {S.has(_INTENT_Q, words)} THEN [{', '.join(chr(39) + x + chr(39) for x in (labels, edges)[i])}] ELSE []::VARCHAR[] END" for words, labels, edges in R.INTENTS)
    return f"flatten([{parts}])"


@query(f"""WITH t AS (SELECT g.id, min(c.ticker) AS ticker FROM golden_test g LEFT JOIN companies c ON list_contains({S.answer_words('g.question')}, {S.lower_tr('c.short_name')}) GROUP BY 1)
SELECT id, ticker, CASE WHEN len({_intent_list(0)}) = 0 THEN ['Product', 'FinancialMetric', 'Sector', 'Person'] ELSE {_intent_list(0)} END AS target_labels, {_intent_list(1)} AS edge_types,
CASE WHEN NOT {S.has(_INTENT_Q, R.INTENTS[2][0])} THEN NULL WHEN {S.has(_INTENT_Q, ['ciro', 'revenue'])} THEN 'ciro' WHEN {S.has(_INTENT_Q, ['kâr', 'profit'])} THEN 'net_kâr' END AS metric,
CASE WHEN {S.has(_INTENT_Q, ['ürün', 'yönetici'])} THEN 1 ELSE 2 END AS hops FROM golden_test JOIN t USING (id)""")
def graph_intent(spark, sf):
    g = table(spark, sf, "golden_test")
    w = g.select("id", F.explode_outer(F.array_distinct(T.answer_words("question"))).alias("w"))
    c = table(spark, sf, "companies").select("ticker", T.lower_tr("short_name").alias("w"))
    t = w.join(c, "w", "left").groupBy("id").agg(F.min("ticker").alias("ticker"))
    i = R.graph_intent(F.col("question"))
    return g.select("id", i.alias("i")).join(t, "id").select("id", "ticker", "i.target_labels", "i.edge_types", "i.metric", "i.hops")


_STATEMENTS = ["MATCH (n) RETURN n", "MATCH (n) SET n.x = 1", "// CREATE is a comment\nMATCH (n) RETURN n", "/* MERGE\nDROP */ MATCH (n) RETURN n", "match (n) detach delete n"]
_GUARD_IN = "CASE id_no % 5 " + " ".join(f"WHEN {i} THEN '" + s.replace("\n", "' || chr(10) || '") + "'" for i, s in enumerate(_STATEMENTS)) + " END || chr(10) || coalesce(question, '')"


@query(f"""WITH g AS (SELECT id, {_GUARD_IN} AS s FROM (SELECT *, TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS id_no FROM golden_test)),
w AS (SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(upper(regexp_replace(regexp_replace(s, '//[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g')), '\\b[A-Z_]+\\b'), lambda x: x IN ({', '.join(chr(39) + k + chr(39) for k in R.MUTATIONS)})))) AS forbidden FROM g)
SELECT id, forbidden, len(forbidden) = 0 AS allowed FROM w""")
def query_guard(spark, sf):
    n = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint")
    said = F.concat(F.coalesce(*[F.when(n % len(_STATEMENTS) == i, F.lit(s)) for i, s in enumerate(_STATEMENTS)]), F.lit("\n"), F.coalesce("question", F.lit("")))
    f = R.forbidden_words(said)
    return table(spark, sf, "golden_test").select("id", f.alias("forbidden"), (F.size(f) == 0).alias("allowed"))
