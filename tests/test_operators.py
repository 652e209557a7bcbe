"""Nulls, empty tables, ties, repeated rows, clashing columns; brute force where SQL can't say it."""

import difflib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import chunking, evals, extract, graph, ordering, ranking, references, resolve, skew, units, vectors, workflow
from reportloom.sources import records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ENT = "id string, type string, canonical_name string, properties map<string,string>, evidence_text string, source_file string"
UNITS = [("total_revenue", "money", "ISO code as stated"), ("water_use", "volume", "l"), ("fleet_distance", "length", "m"), ("net_margin", "ratio", "bp"), ("headcount", "count", "count"), ("furnace_heat", "temperature", "°C")]


def convert(spark, *statements):
    data = [(f"e{i}", "FinancialMetric", "x", p, ev, f"data/T__2020__annual_report__{lang}__1.pdf") for i, (p, ev, lang) in enumerate(statements)]
    q = units.convert_quantities(spark.createDataFrame(data, ENT), spark.createDataFrame(UNITS, "metric_key string, dimension string, common_unit string"))
    return {r.entity_id: (r.common_value, r.common_unit) for r in q.collect()}


@pytest.mark.parametrize(
    "key, said, evidence, lang, scale, unit, value, expected",
    [
        ("total_revenue", "1.234,5 Bin TL", "", "tr", None, None, None, (1234500, "TRY")),
        ("total_revenue", "1,234.5 '000 USD", "", "en", None, None, None, (1234500, "USD")),
        ("total_revenue", "(12) mn ₺", "", "tr", "1000", "EUR", None, (-12000000, "TRY")),
        ("total_revenue", "7", "Ciro (bin avro) 7", "tr", "1000000", "TRY", None, (7000, "EUR")),
        ("total_revenue", "1 307,7 milliards TRY", "", "fr", None, None, None, (1307700000000, "TRY")),
        ("total_revenue", None, "x 3", "tr", "1.000", "TRY", "3.5", (3500, "TRY")),
        ("fleet_distance", "2 mil", "", "tr", None, None, None, (3219, "m")),
        ("fleet_distance", "3 m", "", "en", None, None, None, (3, "m")),
        ("water_use", "2 bin m3", "", "tr", None, None, None, (2000000, "l")),
        ("net_margin", "binde 5", "", "tr", None, None, None, (50, "bp")),
        (" Net-Margin", "%12,345", "", "tr", None, None, None, (1235, "bp")),
        ("headcount", "3 mil kişi", "", "es", None, None, None, (3000, "count")),
        ("water_use", "yok", "", "tr", None, "HL", None, (None, "l")),
        ("water_use", None, None, "tr", None, None, None, (None, "l")),
        ("furnace_heat", "212 °F", "", "en", None, None, None, (100, "°C")),
        ("furnace_heat", "-40 fahrenheit", "", "en", None, None, None, (-40, "°C")),
        ("furnace_heat", "1 kK", "", "en", None, None, None, (1, "°C")),  # no known unit: the metric's own
        ("furnace_heat", "1 k K", "", "en", None, None, None, (727, "°C")),
        ("furnace_heat", "300,15", "Isı (K) 300,15", "tr", None, "°F", None, (27, "°C")),
        ("furnace_heat", None, "", "en", None, "F", "98.6", (37, "°C")),
        ("furnace_heat", "21", "", "en", None, None, None, (21, "°C")),  # source default
        ("water_use", "7 bin", "", "tr", None, None, None, (7000, "l")),  # scale in the text, source default for the unit
        ("water_use", "7", "x (m3) 7", "tr", None, "HL", None, (7000, "l")),  # text before the unit field
        ("water_use", "7", "x 7", "tr", None, "HL", None, (700, "l")),  # the unit field
        ("total_revenue", "7 bin", "", "tr", None, None, None, (None, None)),  # no currency is stated
    ],
)
def test_units(spark, key, said, evidence, lang, scale, unit, value, expected):
    p = {"metric_key": key, "reported_value": said, "scale": scale, "unit": unit, "value": value}
    assert convert(spark, (p, evidence, lang))["e0"] == expected


def test_units_empty_null_and_repeated(spark):
    e = spark.createDataFrame([], ENT)
    m = spark.createDataFrame(UNITS, "metric_key string, dimension string, common_unit string")
    assert units.converted_rows(e, m).count() == 0
    r = ("e", "FinancialMetric", None, {"metric_key": "water_use", "reported_value": "5 hl"}, None, None)
    d = spark.createDataFrame([r, r, ("n", "FinancialMetric", None, None, None, None), (None, None, None, None, None, None)], ENT).withColumn("dimension", F.lit("clash")).withColumn("number", F.lit(1))
    assert rows(units.converted_rows(d, m)) == [("e", 500, "l")]


def test_references(spark):
    t = "timestamp_ntz"
    parents = spark.sql(f"SELECT * FROM VALUES ('A', {t}'2020-01-01', NULL), ('b', {t}'2020-01-01', {t}'2021-01-01'), ('c', {t}'2022-05-01', NULL), ('c', {t}'2023-05-01', NULL), ('d', NULL, NULL), (NULL, NULL, NULL) x(k, at, gone)")
    child = spark.sql(f"SELECT * FROM VALUES ('r1', ' a ', {t}'2020-02-02'), ('r1', ' a ', {t}'2020-02-02'), ('r2', 'B', {t}'2020-02-02'), ('r3', 'c', {t}'2022-04-30'), ('r4', 'c', {t}'2022-05-01'), ('r5', 'zz', NULL), ('r6', '  ', NULL), ('r7', NULL, NULL), ('r8', 'd', {t}'2000-01-01') x(id, ref, at)")
    o = references.orphan_references([references.parent_keys(parents, "p", "k", "at", "gone")], [references.child_keys(child, "c", "id", "ref", "p", "at")])
    assert rows(o.select("record_key", "missing_key", "reason")) == [("r2", "b", "deleted"), ("r3", "c", "late"), ("r5", "zz", "missing")]
    counts = references.orphan_counts(o)
    assert counts.agg(F.sum("orphan_refs")).first()[0] == 3 and counts.where("period IS NULL").count() == 1
    empty = references.orphan_references([references.parent_keys(parents.limit(0), "p", "k", "at", "gone")], [references.child_keys(child, "c", "id", "ref", "p", "at")])
    assert {r.reason for r in empty.collect()} == {"missing"}


def test_salted_lookup_splits_hot_keys(spark):
    n = 120_000
    big = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("w")).unionByName(spark.sql("SELECT 'hot' AS k, -1L AS w"))
    plain = big.join(lookup, "k", "left").agg(F.count("w"), F.sum("w"), F.sum("v")).first()
    assert skew.salted_lookup(big, lookup, "k", "left").agg(F.count("w"), F.sum("w"), F.sum("v")).first() == plain
    assert skew.salted_lookup(big, lookup, "k", "inner").count() == plain[0]
    assert skew.salted_lookup(big.limit(0), lookup, "k").count() == 0


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
def test_vectors_against_brute_force(spark, distance):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(size=4).round(1)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    got = rows(vectors.vector_topk(df.where("id % 10 = 0"), df, "id", "v", 3, distance))
    full = {i: np.array(v, np.float32).astype(float) for i, v in data if v and len(v) == 4}
    want = []
    for q in (i for i in full if i % 10 == 0):
        s = []
        for k, v in full.items():
            if k != q:
                n = np.linalg.norm(full[q]) * np.linalg.norm(v)
                x = full[q] @ v / n if distance == "cosine" and n else 0.0 if distance == "cosine" else full[q] @ v if distance == "dot" else -np.linalg.norm(full[q] - v)
                s.append((-round(float(x), 6), k))
        want += [(q, k, -x, i + 1) for i, (x, k) in enumerate(sorted(s)[:3])]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want, key=repr)]
    assert vectors.vector_topk(df.limit(0), df, "id", "v").count() == 0


def test_latest_by_key(spark):
    d = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("a", 2, {"x": "2"}), (None, 9, None)], "k string, v int, m map<string,string>")
    assert rows(vectors.latest_by_key(d, "k", F.col("v"))) == [("a", 2, {"x": "2"})]


def test_fusion_edge_cases(spark):
    a = spark.createDataFrame([("q", "x", 1, 0.9), ("q", "x", 3, 0.9), ("q", None, 2, 0.5)], "query_id string, k string, rank int, score double")
    b = a.limit(0)
    assert rows(ranking.rrf([a, b], "k")) == [("q", "x", round(1 / 61, 6), 1, 1)]
    assert rows(ranking.hybrid_fusion(a.where("k IS NOT NULL"), b, "k").select("k", "score", "source", "rank")) == [("x", 1.0, "vector", 1)]


def test_diverse_selection_demotes_copies(spark):
    d = spark.createDataFrame([("q", "a", 0.9, "one two three", "p1"), ("q", "b", 0.89, "one two three", "p1"), ("q", "c", 0.6, "other words here", None), ("q", "d", 0.1, None, "p2")], "q string, k string, s double, t string, p string")
    got = [r.k for r in ranking.diverse_selection(d, "q", "k", "s", "t", "p", 10).orderBy("pick").collect()]
    assert got == ["a", "c", "b", "d"]


def test_packing_keeps_limits_and_overlap(spark):
    words = " ".join(["word"] * 100)
    d = spark.createDataFrame([(1, "\n\n".join([words] * 9)), (2, None), (3, ""), (4, "short"), (5, "\n\n".join(["tiny block of words"] * 200))], "id long, text string")
    c = chunking.chunk_documents(d, "id", "text").toPandas()
    assert set(c.id) == {1, 5} and c.token_count.max() <= 500 + 130
    assert list(c[c.id == 5].chunk_index) == list(range(len(c[c.id == 5])))


def test_paths_use_an_edge_once(spark):
    e = spark.createDataFrame([("1", "T", "a", "b"), ("2", "T", "b", "a"), ("3", "T", "b", "b")], "id string, type string, src string, dst string")
    s = spark.createDataFrame([("a",)], "id string")
    got = rows(graph.paths(e, s, 3).select("e1", "e2", "e3"))
    assert got == [("1", "3", "2")] and graph.paths(e.limit(0), s, 2).count() == 0


def test_audit_of_an_empty_and_a_broken_graph(spark):
    n = spark.createDataFrame([("a", "Company", " "), ("z", "Company", "z")], "id string, label string, name string")
    e = spark.createDataFrame([("1", "PUBLISHED", "a", "none", 0, 0.2)], "id string, type string, src string, dst string, page int, confidence double")
    assert {r.category: r.issues for r in graph.audit_issues(n, e).collect()} == {"dangling_edge": 1, "orphan_node": 1, "schema_violation": 0, "invalid_page": 1, "low_confidence": 1, "missing_name": 1}
    q = graph.quality_score(graph.audit_issues(n.limit(0), e.limit(0)), n.limit(0)).first()
    assert q.nodes == 0 and q.score is None
    assert graph.repair(e, n).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components_of_chains_and_cycles(spark, n):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("x", "y"), ("y", "x"), ("x", "x"), (None, "x"), ("lone", "lone")]
    got = dict(rows(resolve.components(spark.createDataFrame(chain, "a string, b string"), "a", "b")))
    assert got == {f"{i:03d}": "000" for i in range(n + 1)} | {"x": "x", "y": "x"}
    assert resolve.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_name_similarity_is_the_sequence_ratio(spark):
    names = ["Acme Ltd", "ACME", "acme limited", None, ""]
    d = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    for r in d.select("a", "b", resolve.sequence_ratio("a", "b").alias("s")).collect():
        assert r.s == (difflib.SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0)


def test_candidate_pairs_share_a_word(spark):
    m = spark.createDataFrame([("1", "Person", "c", "Ali Kaya"), ("2", "Person", "c", "A. Kaya"), ("3", "Person", "d", "Ali Kaya"), ("4", "Person", "c", None)], "key string, type string, company string, name string")
    assert rows(resolve.candidate_pairs(m).select("a", "b")) == [("1", "2")]


def test_similar_pairs_are_all_pairs_of_a_type(spark, monkeypatch):
    monkeypatch.setattr(resolve, "NAME_BLOCK", 5)
    names = ["Ali Kaya", "ALİ KAYA", "Alu Kayo", "A. Kaya", "Zeynep", "Zeynap", "Net Satış", "NET SATIS", "Kar", "Öçş", "ocs", "x" * 70 + " Ltd", "x" * 70 + " AS", "Kaya Ali Demir Oğlu", "Oğlu Demir Ali Kaya", "b", ""]
    data = [(f"{i * 7 % 101:03d}", t, c, n) for i, (t, c, n) in enumerate(itertools.product(["Person", "Company", "Product", "FinancialMetric"], ["c", "d"], names)) if i < 101]
    m = spark.createDataFrame(data + [("zzz", "Person", "c", None)], "key string, type string, company string, name string")
    low = {r.key: (r.n, r.k) for r in m.where("name IS NOT NULL").select("key", T.lower_tr("name").alias("n"), T.ascii_key("name").alias("k")).collect()}

    def alike(x, y):
        r, p, q = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0, set(x.split()), set(y.split())
        return max(r, 0.65 * r + 0.35 * len(p & q) / max(len(p | q), 1)) >= 0.55

    want = [(a[0], b[0]) for a, b in itertools.product(data, data) if a[0] < b[0] and a[1] == b[1] and (low[a[0]][1] == low[b[0]][1] or a[1] == "Company" and a[2] == b[2] or alike(low[a[0]][0], low[b[0]][0]))]
    assert rows(resolve.similar_pairs(m).select("a", "b")) == sorted(want, key=repr)


def test_names_are_compared_in_batches_as_the_library_does(monkeypatch):
    rng = np.random.default_rng(7)
    names = ["", " ", "a", "ali kaya", "kaya ali", "kaya\u00a0ali", "x" * 32, "x" * 33 + " ltd", "y" + "x" * 63, "é" * 64] + ["".join(rng.choice(list("abcç .ş"), rng.integers(1, 64))) for _ in range(80)]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(names)), np.arange(len(names))))
    want = [difflib.SequenceMatcher(None, names[i], names[j]).ratio() if names[i] and names[j] else 0.0 for i, j in zip(x, y)]
    words = [(set(names[i].split()), set(names[j].split())) for i, j in zip(x, y)]
    alike = [max(r, 0.65 * r + 0.35 * len(p & q) / max(len(p | q), 1)) >= 0.55 for r, (p, q) in zip(want, words)]
    monkeypatch.setattr(resolve.difflib, "SequenceMatcher", None)  # names of up to 64 letters don't need it
    ns = resolve.Names(names)
    got, value = ns.similarity(x, y)
    assert got.tolist() == alike
    plain = [k for k in range(len(x)) if "\u00a0" not in names[x[k]] + names[y[k]]]
    assert all(value[k] == max(want[k], 0.65 * want[k] + 0.35 * (len(words[k][0] & words[k][1]) / max(len(words[k][0] | words[k][1]), 1))) for k in plain)
    near = set(zip(*(v.tolist() for v in ns.near(np.arange(len(names)), np.arange(len(names))))))
    assert {(i, j) for i, j, a in zip(y.tolist(), x.tolist(), alike) if a} <= near


def test_scored_pairs_shuffle_no_pair(spark, monkeypatch):
    monkeypatch.setattr(resolve, "NAME_BLOCK", 20)
    # a hot name, an id on two rows, names of either direction, of more than 32 and 64 letters and without a company
    data = [(f"{i:03d}", "Company", f"c{i % 3}" if i % 4 else None, n) for i, n in enumerate([f"Ata{' ' * (i % 5)} AS" for i in range(60)] + ["Net Satış Geliri", "Satış Geliri Net", "NET SATIS GELIRI", "y" * 40 + " Ltd", "y" * 41 + " AS", "z" * 70 + " Ltd", "z" * 70 + " AS", ""])]
    data += [("000", "Company", "c9", "Ata AS"), ("000", "Company", "c8", "Other"), ("999", "Company", "c8", "Quite else"), ("998", "Person", "c8", "Quite else")]
    m = spark.createDataFrame(data, "key string, type string, company string, name string")
    got = resolve.scored_pairs(m)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0] and "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan
    low = m.select("key", "type", "company", "name", T.lower_tr("name").alias("n"), T.ascii_key("name").alias("k"))
    every = low.select(*[F.col(c).alias(f"{c}_a") for c in low.columns]).crossJoin(low.select(*[F.col(c).alias(f"{c}_b") for c in low.columns])).where("type_a = type_b AND key_a < key_b")
    s = resolve.name_similarity(F.col("n_a"), F.col("n_b"))
    want = every.withColumn("s", s).where("k_a = k_b OR type_a = 'Company' AND company_a = company_b AND company_a <> '' OR s >= 0.55").select("key_a", "key_b", "type_a", "name_a", "name_b", "s").distinct()
    assert rows(got) == rows(want) and got.count() > 1000


def test_pair_pieces_are_linear_in_the_mentions(spark, monkeypatch):
    monkeypatch.setattr(resolve, "NAME_BLOCK", 4)
    monkeypatch.setattr(resolve, "HELD", 3)
    rng = np.random.default_rng(5)
    data = [(f"{int(k):04d}", "Person", f"c{i % 3}", "".join(rng.choice(list("abcde "), 12))) for i, k in enumerate(rng.permutation(400))]
    m = spark.createDataFrame(data, "key string, type string, company string, name string")
    pieces = resolve.pair_pieces(m)
    blocks = pieces.select("own").distinct().count()
    most = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    # a block isn't sent to every other, only to as many pieces as there are parts
    assert blocks > 2 * most and pieces.groupBy("own").count().where(F.col("count") > most).count() == 0
    # pairs in every direction between blocks, whose matching blocks depend on it
    key = {k: n for k, _, _, n in data}
    ratio = {(a, b): difflib.SequenceMatcher(None, key[a], key[b]).ratio() for a in key for b in key if a < b}
    words = {k: set(n.split()) for k, n in key.items()}
    value = {(a, b): max(r, 0.65 * r + 0.35 * len(words[a] & words[b]) / len(words[a] | words[b])) for (a, b), r in ratio.items()}
    got = {(r.a, r.b): r.similarity for r in resolve.scored_pairs(m).collect()}
    assert got.keys() == {p for p, v in value.items() if v >= 0.55} and all(abs(v - value[p]) < 1e-6 for p, v in got.items())


def test_pair_class_compares_no_pair_again(spark):
    from reportloom.plans import graphs

    got = graphs.pair_class(spark, "/root/testdata/sf0.001")
    assert "EvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()  # the similarity comes with the pair
    pairs = graphs.mention_pairs(spark, "/root/testdata/sf0.001")
    want = pairs.select("a", "b", "type", resolve.name_similarity(T.lower_tr("name_a"), T.lower_tr("name_b")).alias("similarity"))
    assert rows(got.select("a", "b", "type", "similarity")) == rows(want)


def test_pair_class_takes_no_names_from_the_pieces(spark):
    from reportloom.plans import graphs

    got = graphs.pair_class(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")
    assert "regexp_replace" not in plan[0] and "name_a" not in plan[0] + plan[1].split("\n")[0]  # names aren't given row by row and folded again
    p = graphs.mention_pairs(spark, "/root/testdata/sf0.001")
    same = T.ascii_key("name_a") == T.ascii_key("name_b")
    s = resolve.name_similarity(T.lower_tr("name_a"), T.lower_tr("name_b"))
    want = p.withColumn("s", s).select("a", "b", "type", "s", resolve.pair_class(F.col("type"), F.col("s"), F.lit(1.0), same, F.lit(0)))
    assert rows(got) == rows(want)


def test_similarities_are_rounded_as_spark_does(spark):
    v = [0.65 * (2 * m / t) + 0.35 * (s / u) for t in range(1, 70) for m in range(t // 2 + 1) for u in range(1, 6) for s in range(u + 1)] + [0.1234565, 0.6171875, 0.0, 1.0]
    want = [r.r for r in spark.createDataFrame([(x,) for x in v], "v double").select(F.round("v", 6).alias("r")).collect()]
    assert resolve.rounded(np.array(v)).tolist() == want


def test_greedy_distinct_over_the_whole_table(spark):
    rng = np.random.default_rng(5)
    # a chain of drifting texts, so that a row alike only to a dropped one stays; other texts between; copies, empty and null ones
    texts = [" ".join(f"w{j}" for j in range(i, i + 20)) for i in range(25)] + [" ".join(f"w{j}" for j in rng.integers(0, 12, 9)) for _ in range(60)]
    texts = [texts[i] for i in rng.permutation(len(texts))] + ["", " ", None, texts[3], texts[3].upper(), "one", "One two", "two ONE"]
    kept, want = [], []
    for i, t in enumerate(texts):
        w = set((t or "").lower().split())
        if t is not None and not any(w and k and len(w & k) / len(w | k) >= 0.85 for k in kept):
            kept.append(w)
            want.append((i,))
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(ranking.greedy_distinct_all(d, "i", "t", 0.85)) == sorted(want, key=repr)
    assert ranking.greedy_distinct_all(d.limit(0), "i", "t", 0.85).count() == 0


def test_metric_values(spark):
    d = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["b", "z"]), ([], ["a"]), (["a"], []), (["a", "a"], ["a"])], "g array<string>, t array<string>")
    g, t = F.col("g"), F.col("t")
    got = [tuple(r) for r in d.select(evals.recall_at(g, t, 5), evals.precision_at(g, t, 5), evals.reciprocal_rank(g, t), evals.ndcg_at(g, t, 5)).collect()]
    assert got[0] == (0.5, 0.2, 0.5, round((1 / np.log2(3)) / (1 + 1 / np.log2(3)), 6)) and got[1] == (0.0, 0.0, 0.0, 0.0) and got[2] == (1.0, 0.0, 0.0, 0.0)


def test_rate_window_replays(spark):
    times = [0, 10, 59, 60, 61, 3590, 3610, 3645]
    d = spark.createDataFrame([(i, None if i % 2 else "c", s) for i, s in enumerate(times)], "i int, c string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.i: r.in_window for r in workflow.rate_windows(d, "c", "ts", 2, 60).collect()}
    for i, s in enumerate(times):
        assert got[i] == sum(1 for j, u in enumerate(times) if j % 2 == i % 2 and s - 60 < u <= s), i


@pytest.mark.parametrize("parts", [1, 4])
def test_running_sum_of_a_hot_group(spark, parts):
    data = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", (i * 37) % 101, i) for i in range(300)]
    d = spark.createDataFrame(data, "g string, o int, v int")
    got = {r.v: (r.s, r.n) for r in ordering.ranked(ordering.running_sum(d, ["g"], ["o", "v"], F.col("v"), "s", parts), ["g"], ["o", "v"], "n", parts).collect()}
    for g in {x[0] for x in data}:
        total = 0
        for n, (_, _, v) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))):
            total += v
            assert got[v] == (total, n + 1)
    assert ordering.ranked(d.limit(0), ["g"], ["o"], "n").count() == 0


def test_ready_tasks_and_levels(spark):
    t = spark.createDataFrame([("r", 1, [], True), ("r", 2, [1], False), ("r", 3, [2], False), ("s", 1, [], False)], "run string, step int, needs array<int>, done boolean")
    assert rows(workflow.ready_tasks(t, "run").select("run", "step")) == [("r", 2), ("s", 1)]
    assert rows(workflow.task_levels(t, "run").select("run", "step", "level")) == [("r", 1, 1), ("r", 2, 2), ("r", 3, 3), ("s", 1, 1)]


def test_tolerant_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "type": "Person"}\n\nnot json\n{"id": "2"}\n')
    good, bad = records.read_tolerant(spark, str(tmp_path), "id string, type string")
    assert rows(good) == [("1", "Person"), ("2", None)] and [r.raw_text for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        records.read_strict(spark, str(tmp_path), "id string, type string").collect()


def test_append_new_and_vectors(spark, tmp_path):
    p = str(tmp_path / "t")
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    records.append_new(d, p, ["k"])
    records.append_new(d.unionByName(spark.createDataFrame([("c", 1)], "k string, v int")), p, ["k"])
    assert sorted(r.k for r in spark.read.parquet(p).collect()) == ["a", "b", "c"]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "i int, e array<double>")
    assert sorted(r.i for r in records.write_vectors(v, str(tmp_path / "v"), "e", 2, reset=True).collect()) == [2, 3, 4]


def test_checksum_ignores_order(spark):
    d = spark.createDataFrame([(i, str(i), {"a": "b"}) for i in range(50)], "k int, v string, m map<string,string>")
    assert records.table_checksum(d, "k").first() == records.table_checksum(d.repartition(7).orderBy(F.desc("k")), "k").first()
    assert records.table_checksum(d.limit(0), "k").first().rows == 0


def test_text_columns_on_null_and_odd_text(spark):
    d = spark.createDataFrame([(None,), ("",), ("  \t",), ("İŞ  ve güç",), ("x" * 5000,)], "t string")
    got = [tuple(r) for r in d.select(T.word_count("t"), T.token_count("t"), T.ascii_key("t"), T.is_meaningful("t"), T.needs_ocr("t")).collect()]
    assert got == [(0, 0, None, False, True), (0, 0, "", False, True), (0, 0, "", False, True), (3, 3, "is_ve_guc", False, True), (1, 1, "x" * 5000, True, False)]
    import uuid

    u = spark.createDataFrame([("abc",), (None,)], "t string").select(T.uuid5("t")).collect()
    assert u[0][0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc"))


def test_llm_is_optional():
    import pathlib
    import re

    root = pathlib.Path(T.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"reportloom\.llm|from \.+llm", p.read_text()), p


def test_sentences_keep_leading_digits(spark):
    d = spark.createDataFrame([("0 a. 1 b. 22 c! d",), (None,)], "t string")
    assert [r[0] for r in d.select(T.sentences("t")).collect()] == [["0 a.", "1 b.", "22 c!", "d"], []]


def test_extraction_reasons(spark):
    import json

    proof = {"source_chunk_id": "c", "source_file": "f", "page_number": 1, "evidence_text": "Ali Kaya", "confidence": 0.9}
    p = {"name": "Ali Kaya", "company_id": "company:ABCDE"}
    ent = lambda **k: {"ref": "p", "type": "Person", "canonical_name": "Ali Kaya", "properties": p, **proof, **k}
    rel = lambda **k: {"type": "HOLDS_ROLE_AT", "source_ref": "p", "target_ref": "q", "properties": {}, **proof, **k}
    firm = ent(ref="q", type="Company")
    cases = {
        1: ([ent(), firm], [rel()]), 2: ([ent(), ent()], []), 3: ([ent(type="Alien")], []), 4: ([ent(page_number=2)], []), 5: ([ent(evidence_text="Veli")], []), 6: ([ent(properties={"name": "x"})], []), 7: ([ent(confidence=2.0)], []),
        8: ([ent()], [rel()]), 9: ([ent(), firm], [rel(type="EATS")]), 10: ([ent(), firm], [rel(type="OFFERS")]), 11: ([ent(), firm], [rel(source_ref=" ")]),
    }
    data = [(k, "c", json.dumps({"entities": a, "relations": b})) for k, (a, b) in cases.items()] + [(12, "c", "{no json"), (13, "c", "{}"), (14, "c", None), (15, "zz", json.dumps({"entities": [ent()], "relations": []}))]
    chunks = spark.createDataFrame([("c", "Ali Kaya genel müdür oldu", "f", 1), ("n", None, None, None)], "chunk_id string, text string, source_file string, page_number int")
    good, rels, bad = extract.accept(spark.createDataFrame(data, "response_id long, chunk_id string, response string"), chunks)
    assert {(r.response_id, r.record_kind, r.candidate_index): r.reason_code for r in bad.collect()} == {
        (2, "entity", 1): "DUPLICATE_REF", (3, "entity", 0): "UNKNOWN_NODE_TYPE", (4, "entity", 0): "PROVENANCE_MISMATCH", (5, "entity", 0): "EVIDENCE_NOT_IN_CHUNK", (6, "entity", 0): "SCHEMA_VALIDATION_FAILED",
        (7, "entity", 0): "ENTITY_MODEL_INVALID", (8, "relation", 0): "ENTITY_REFERENCE_NOT_FOUND", (9, "relation", 0): "UNKNOWN_RELATION_TYPE", (10, "relation", 0): "SCHEMA_VALIDATION_FAILED", (11, "relation", 0): "RELATION_MODEL_INVALID",
        (12, "chunk", None): "LLM_JSON_INVALID", (13, "chunk", None): "LLM_SHAPE_INVALID", (14, "chunk", None): "LLM_JSON_INVALID", (15, "entity", 0): "PROVENANCE_MISMATCH",
    }
    assert [r.response_id for r in rels.collect()] == [1] and good.count() == 10
    assert all(x.count() == 0 for x in extract.accept(spark.createDataFrame([], "response_id long, chunk_id string, response string"), chunks))


def test_provider_is_applied_in_batches(spark):
    d = spark.createDataFrame([("a", "x"), ("b", None)], "k string, text string")
    got = extract.with_provider(d, lambda s: s.fillna("none") + "!")
    assert rows(got.select("k", "response")) == [("a", "x!"), ("b", "none!")]


def test_shared_folder_is_an_error_on_a_cluster_without_one(monkeypatch):
    from types import SimpleNamespace

    from reportloom import session

    made = []
    conf = SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: made.append(v))
    on = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(on(master))
    assert not made and session.shared_dir(on("local[2]")).startswith("file://") and made


def test_stash_counts_and_leaves_only_its_result(spark, tmp_path, monkeypatch):
    from reportloom import session

    session.sweep(spark)
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    stash = session.Stash(spark, "t")
    for n in (0, 7):
        d, seen = stash.put_counted(spark.range(n).toDF("x"), rows=F.count(F.lit(1)), odd=F.count_if(F.col("x") % 2 == 1))
        assert seen == {"rows": n, "odd": n // 2} and d.count() == n
    out = stash.finish(d.where("x > 3"))
    assert out.count() == 3 and len(list(tmp_path.glob("*/[0-9]*"))) == 1
    assert session.sweep(spark) == 1 and not list(tmp_path.glob("*/[0-9]*"))
