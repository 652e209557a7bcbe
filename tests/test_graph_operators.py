"""Small tests of ontology, audit, resolution, claims, search, benchmark and sources: each outcome, nulls, empties, repeats."""

import pytest
from pyspark.sql import functions as F

from reportloom.operators import audit, benchmark, chunking, claims, contexts, extract, ontology, ranking, search, workflow
from reportloom.sources import records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- ontology ------------------------------------------------------------------------------------------------------

NODE = "id string, type string, properties map<string,string>"


def test_each_kind_of_property_problem(spark):
    good = {"id": "date:2020", "value": "2020", "granularity": "YEAR", "quarter": "4"}
    d = [
        ("ok", "Date", good), ("ok", "Date", good), ("gone", "Date", {k: v for k, v in good.items() if k != "value"}), ("null", "Date", {**good, "value": None}), ("odd", "Date", {**good, "colour": "red"}),
        ("kind", "Date", {**good, "quarter": "four"}), ("blank", "Date", {**good, "value": " "}), ("shape", "Date", {**good, "id": "2020"}), ("list", "Date", {**good, "granularity": "WEEK"}),
        ("low", "Date", {**good, "quarter": "0"}), ("high", "Date", {**good, "quarter": "5"}), ("who", "Planet", good), ("none", None, None), ("empty", "Date", None),
    ]
    got = rows(ontology.property_problems(spark.createDataFrame(d, NODE).withColumn("problem", F.lit("clash")).withColumn("kind", F.lit(1))))
    want = [
        ("gone", "value", "missing_required"), ("null", "value", "missing_required"), ("odd", "colour", "unknown_property"), ("kind", "quarter", "type"), ("blank", "value", "blank"), ("shape", "id", "pattern"),
        ("list", "granularity", "allowed"), ("low", "quarter", "minimum"), ("high", "quarter", "maximum"), ("who", None, "unknown_type"), ("none", None, "unknown_type"),
        *[("empty", p, "missing_required") for p in ("id", "value", "granularity")],
    ]
    assert got == sorted(want, key=repr)
    assert ontology.property_problems(spark.createDataFrame([], NODE)).count() == 0


def test_the_ontology_itself_is_sound():
    assert ontology.ontology_problems() == []
    assert len({t for t, *_ in ontology.property_rules()}) == 9 and len({k for k, *_ in ontology.edge_rules()}) == 14


def test_ids_by_recipe(spark):
    p = [("Company", {"ticker": "ABC"}), ("Person", {"company_id": "company:ABC", "name": "Çağla Işık"}), ("Person", {"name": "x"}), ("FinancialMetric", {"company_id": "company:ABC", "metric_key": "k"}), ("Planet", {}), (None, None)]
    d = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(p)], "i int, t string, p map<string,string>")
    got = [r[0] for r in d.orderBy("i").select(ontology.node_id(F.col("t"), F.col("p"))).collect()]
    assert got == ["company:ABC", "person:ABC:cagla_isik", None, None, None, None]


# --- audit ---------------------------------------------------------------------------------------------------------

NODES = "id string, label string, name string, chunk string, file string, evidence string, page int, year int, confidence double"
STATED = "type string, src string, dst string, chunk string, file string, page int, confidence double"


def test_audit_finds_each_issue_and_repair_settles_what_it_can(spark):
    n = [
        ("p", "Person", "A", "c1", "f", "ev", 1, 2020, 0.9), ("company:X", "Company", "X", "c1", "f", "ev", 0, 1800, 0.2), ("company:X:1", "Company", "Y", "c1", "f", "ev", 1, None, None),
        ("alone", "Person", None, None, "source_unknown.pdf", " ", None, None, None), ("k", "Chunk", "k", "k", "f", "ev", 1, 2020, None),
    ]
    s = [
        ("HOLDS_ROLE_AT", "p", "company:X", "c1", "f", 1, 0.9), ("HOLDS_ROLE_AT", "p", "company:X", "c1", "f", 1, None), ("EVIDENCED_BY", "company:X", "k", "c1", "f", 0, 0.1), ("EVIDENCED_BY", "p", "nowhere", None, "none", None, None),
        ("NO_RULE", "p", "company:X:1", "c1", "f", 1, 0.6),
    ]
    nodes, said = spark.createDataFrame(n, NODES), spark.createDataFrame(s, STATED)
    i = audit.audit_rows(nodes, said)
    got = {(r.category, r.item, r.item_type): r.issues for r in audit.audit_counts(i).collect()}
    assert got == {
        ("dangling_relation", "edge", "EVIDENCED_BY"): 1, ("duplicate_relation", "edge", "HOLDS_ROLE_AT"): 1, ("schema_violation", "edge", "EVIDENCED_BY"): 1, ("missing_grounding", "edge", "EVIDENCED_BY"): 1,
        ("invalid_page", "edge", "EVIDENCED_BY"): 1, ("low_confidence", "edge", "EVIDENCED_BY"): 1, ("orphan_node", "node", "Person"): 1, ("missing_grounding", "node", "Person"): 1,
        ("invalid_page", "node", "Company"): 1, ("invalid_year", "node", "Company"): 1, ("low_confidence", "node", "Company"): 1, ("conflicting_data", "node", "Company"): 1,
    }
    assert {r.category for r in audit.review_queue(i).collect()} == {"schema_violation", "orphan_node", "invalid_year", "conflicting_data"}
    fixed = rows(audit.repaired_edges(nodes, said).select("src", "dst", "chunk", "file", "page", "low_confidence_flag"))
    assert fixed == [("company:X", "k", "c1", "f", 1, True), ("p", "company:X", "c1", "f", 1, False), ("p", "company:X:1", "c1", "f", 1, False)]
    r = audit.final_rates(i, nodes, said).first()
    assert (r.nodes, r.relations, r.duplicates, r.orphans, r.signed_off) == (5, 4, 1, 1, False)
    empty = audit.audit_rows(nodes.limit(0), said.limit(0))
    assert empty.count() == 0 and audit.final_rates(empty, nodes.limit(0), said.limit(0)).first().lineage_rate == 100.0


# --- resolution ----------------------------------------------------------------------------------------------------

SIDE = "norm string, identity string, company_id string, year int, report_id string, date_id string, scope string, unit string, value double, class_code string, codes array<string>"


@pytest.mark.parametrize(
    "kind, left, right, similarity, expected",
    [
        ("Company", {"identity": "A"}, {"identity": "A"}, 0.1, "EXACT_MATCH"), ("Company", {"identity": "A"}, {"identity": "B"}, 1.0, "DIFFERENT_ENTITY"), ("Company", {"norm": "x"}, {"norm": "x"}, 1.0, "REVIEW_REQUIRED"), ("Company", {}, {}, 0.93, "REVIEW_REQUIRED"), ("Company", {}, {}, 0.5, "DIFFERENT_ENTITY"),
        ("Person", {"company_id": "a", "norm": "x"}, {"company_id": "a", "norm": "x"}, 1.0, "EXACT_MATCH"), ("Person", {"company_id": "a", "norm": "x"}, {"company_id": "b", "norm": "x"}, 1.0, "DIFFERENT_ENTITY"), ("Person", {"company_id": "a"}, {}, 0.8, "REVIEW_REQUIRED"),
        ("Person", {"company_id": "a", "report_id": "r"}, {"company_id": "a", "report_id": "r"}, 0.87, "HIGH_CONFIDENCE_MATCH"), ("Person", {"company_id": "a", "year": 1, "report_id": "r"}, {"company_id": "a", "year": 1, "report_id": "s"}, 0.91, "HIGH_CONFIDENCE_MATCH"),
        ("Person", {"company_id": "a", "year": 1, "report_id": "r"}, {"company_id": "a", "year": 2, "report_id": "s"}, 0.91, "REVIEW_REQUIRED"), ("Person", {"company_id": "a"}, {"company_id": "a"}, 0.5, "DIFFERENT_ENTITY"),
        ("Product", {"company_id": "a", "codes": ["1"]}, {"company_id": "a", "codes": ["2"]}, 0.99, "DIFFERENT_ENTITY"), ("Product", {"company_id": "a", "codes": ["1"], "report_id": "r"}, {"company_id": "a", "codes": ["1"]}, 0.9, "HIGH_CONFIDENCE_MATCH"), ("Product", {"company_id": "a", "report_id": "r"}, {"company_id": "a"}, 0.72, "REVIEW_REQUIRED"),
        ("Sector", {"norm": "x"}, {"norm": "x"}, 1.0, "EXACT_MATCH"), ("Sector", {"norm": "x", "class_code": "1"}, {"norm": "x", "class_code": "2"}, 1.0, "DIFFERENT_ENTITY"), ("Sector", {"class_code": "1"}, {"class_code": "1"}, 0.95, "HIGH_CONFIDENCE_MATCH"),
        ("FinancialMetric", {"norm": "x", "value": 1.0}, {"norm": "x", "value": 1.0 + 1e-9}, 1.0, "EXACT_MATCH"), ("FinancialMetric", {"norm": "x", "value": 1.0}, {"norm": "x", "value": 2.0}, 1.0, "REVIEW_REQUIRED"), ("FinancialMetric", {"norm": "x"}, {"norm": "x", "value": 2.0}, 1.0, "HIGH_CONFIDENCE_MATCH"),
        ("FinancialMetric", {"norm": "x", "unit": "TRY"}, {"norm": "x", "unit": "EUR"}, 1.0, "DIFFERENT_ENTITY"), ("FinancialMetric", {"norm": "x"}, {"norm": "y"}, 0.6, "DIFFERENT_ENTITY"),
        ("Event", {"norm": "x"}, {"norm": "x"}, 1.0, "EXACT_MATCH"), ("Event", {"date_id": "a"}, {"date_id": "b"}, 1.0, "DIFFERENT_ENTITY"), ("Event", {"norm": "x"}, {"norm": "y"}, 0.9, "REVIEW_REQUIRED"), (None, {}, {}, None, "DIFFERENT_ENTITY"),
    ],
)
def test_classes_by_type(spark, kind, left, right, similarity, expected):
    names = [x.split(" ")[0] for x in SIDE.split(", ")]
    side = lambda x: tuple({"codes": []}.get(n) if n not in x else x[n] for n in names)
    d = spark.createDataFrame([(kind, side(left), side(right), similarity), (kind, side(right), side(left), similarity)], f"k string, l struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, r struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, s double")
    got = [x[0] for x in d.select(contexts.classify(F.col("k"), F.col("l"), F.col("r"), F.col("s"))["match_class"]).collect()]
    assert got == [expected] * 2


ENT = "id string, type string, canonical_name string, properties map<string,string>, source_file string, evidence_text string"
COMPANIES = "ticker string, company_name string, short_name string"


def test_contexts_decisions_and_aliases(spark):
    f = "data/ABCDE__2020__annual_report__tr__1.pdf"
    e = spark.createDataFrame([
        ("a", "Person", "Dr. Ali Veli", {"company_id": "company:ABCDE", "date_id": "date:2019"}, f, "Ali Veli dedi"), ("a", "Person", "Dr. Ali Veli", {"company_id": "company:ABCDE", "date_id": "date:2019"}, f, "Ali Veli dedi"),
        ("b", "Person", "ALİ VELİ", {"company_id": "company:ABCDE"}, f, None), ("c", "Person", "Ali Velli", {}, "x.pdf", ""), ("d", "Company", "Deneme", None, None, None), ("e", None, None, None, None, None), (None, "Person", "x", None, None, None),
    ], ENT).withColumn("norm", F.lit("clash"))
    c = contexts.entity_contexts(e, spark.createDataFrame([("ABCDE", "Abc A.Ş.", "Abc"), ("DENEM", "Deneme", "Deneme")], COMPANIES))
    got = {r.id: r for r in c.collect()}
    assert set(got) == set("abcde") and got["a"].norm == got["b"].norm == "ali_veli" and got["a"].year == 2019 and got["b"].year is None and got["d"].identity == "DENEM" and got["a"].tokens == ["ali", "veli", "dedi"]
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.9), ("b", "d", 1.0)], "a string, b string, name_similarity double")
    o = contexts.resolution_pairs(pairs, c)
    assert {(r.a, r.b): r.match_class for r in o.collect()} == {("a", "b"): "EXACT_MATCH", ("a", "c"): "REVIEW_REQUIRED"}
    assert {(r.a, r.b): r.merged for r in contexts.decision_rows(o, "v").collect()} == {("a", "b"): True, ("a", "c"): False}
    al = {r.id: (r.match_class, r.canonical_id, r.candidate_canonical_id, r.auto_merged) for r in contexts.alias_rows(c, o, "v").collect()}
    assert al == {"a": ("EXACT_MATCH", "a", None, True), "b": ("EXACT_MATCH", "a", None, True), "c": ("REVIEW_REQUIRED", "c", "a", False), "d": ("DIFFERENT_ENTITY", "d", None, False), "e": ("DIFFERENT_ENTITY", "e", None, False)}
    assert contexts.resolution_pairs(pairs.limit(0), c).count() == 0


# --- claims --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("part", [1, claims.PART])
def test_claims(spark, monkeypatch, part):
    monkeypatch.setattr(claims, "PART", part)
    k = spark.createDataFrame([("k1", "ABC", "Abc A.Ş.", 2020, "Gelir 1.200 TL oldu"), ("K1 ", "ABC", "Abc A.Ş.", 2020, "Gelir 1.200 TL oldu"), ("k2", "ABC", "Abc A.Ş.", 2020, "Gider 77 TL"), ("k3", "XYZ", "Xyz", 2020, "1.200"), ("k4", "LON", "Lon", 2021, "tek 5 adet"), (None, None, None, None, None)], "chunk_id string, ticker string, company string, year int, text string")
    c = [
        ("ok", "k4", "LON", 2021, "5", "adet"), ("ok", "k4", "LON", 2021, "5", "adet"), ("none", None, "ABC", 2020, "1", None), ("unknown", "zz", "ABC", 2020, "1", None), ("company", "k3", "ABC", 2020, "1.200", None), ("year", "k1", "ABC", 2021, "1.200", None),
        ("value", "k1", "ABC", 2020, "9", None), ("unit", "k1", "ABC", 2020, "1.200", "eur"), ("against", "k1", "ABC", 2020, "1.200", "tl"), ("bare", "k1", "ABC", None, None, None),
    ]
    d = spark.createDataFrame(c, "claim_id string, chunk_id string, company string, year int, value string, unit string")
    got = rows(claims.check_claims(d, k).select("claim_id", "outcome", "contradicting"))
    assert got == sorted([("ok", "verified", 0), ("none", "no_evidence", 0), ("unknown", "unknown_evidence", 0), ("company", "company_mismatch", 0), ("year", "year_mismatch", 0), ("value", "value_mismatch", 0), ("unit", "unit_mismatch", 0), ("against", "contradicted", 1), ("bare", "verified", 0)], key=repr)
    assert claims.check_claims(d.limit(0), k).count() == 0
    assert {r.outcome for r in claims.check_claims(d, k.limit(0)).collect()} == {"no_evidence", "unknown_evidence"}


# --- search, benchmark, workflow -----------------------------------------------------------------------------------

def test_dispatch_falls_back_to_the_other_side(spark):
    q = spark.createDataFrame([("v", "vector"), ("g", "graph"), ("h", "hybrid"), ("vg", "vector"), ("gv", "graph"), ("hv", "hybrid"), ("none", "hybrid")], "q string, asked string")
    kind = "q string, k string, rank int, score double"
    v = spark.createDataFrame([(x, k, r, 1.0 / r) for x in ("v", "g", "h", "gv", "hv") for r, k in ((1, "a"), (2, "b"), (3, "c"))], kind)
    g = spark.createDataFrame([(x, k, r, 9.0 - r) for x in ("v", "g", "h", "vg") for r, k in ((1, "b"), (2, "z"))], kind)
    d = search.dispatch(q, v, g, "k", "q", 2)
    got = {}
    for r in d.orderBy("q", "rank").collect():
        got.setdefault((r.q, r.executed), []).append((r.k, r.source))
    assert got == {
        ("v", "vector"): [("a", "vector"), ("b", "vector")], ("g", "graph"): [("b", "graph"), ("z", "graph")], ("h", "fused"): [("b", "fused"), ("a", "vector")], ("vg", "graph"): [("b", "graph"), ("z", "graph")],
        ("gv", "vector"): [("a", "vector"), ("b", "vector")], ("hv", "vector"): [("a", "vector"), ("b", "vector")],
    }
    assert search.dispatch(q, v.limit(0), g.limit(0), "k", "q", 2).count() == 0


def test_forbidden_words_intent_and_modes(spark):
    d = spark.createDataFrame([("MATCH (n) RETURN n",), ("// DROP\nmatch (n) set n.x = 1",), ("/* CREATE\n*/ RETURN 1",), (None,), ("Şirketin ürünleri nelerdir?",), ("Ciro artışını açıkla ve neden",)], "s string")
    assert [r[0] for r in d.select(search.forbidden_words(F.col("s"))).collect()] == [[], ["SET"], [], [], [], []]
    i = [r[0] for r in d.select(search.graph_intent(F.col("s"), limit=99)).collect()]
    assert i[3].target_labels == search.ANY_LABEL and i[4].target_labels == ["Product"] and i[4].hops == 1 and i[5].metric == "ciro" and i[5].limit == 50
    assert [r[0] for r in d.select(ranking.retrieval_mode(F.col("s"))).collect()][3:] == ["hybrid", "graph", "hybrid"]


def test_benchmark_columns(spark):
    d = spark.createDataFrame([(["A", "b"], ["a", "c"], [1, 2], [2]), ([], [], [], []), (None, None, None, None)], "g array<string>, e array<string>, p array<int>, ep array<int>")
    got = [tuple(r) for r in d.select(benchmark.lineage_recall(F.col("g"), F.col("e")), benchmark.page_accuracy(F.col("p"), F.col("ep")), benchmark.path_recall(F.col("g"), F.col("e")), benchmark.citation_coverage(F.coalesce("g", F.array()), F.lit(4))).collect()]
    assert got == [(0.5, 0.5, 0.5, 0.5), (1.0, 1.0, 1.0, 0.0), (1.0, 1.0, 1.0, 0.0)]
    s = spark.createDataFrame([("Gelir arttı [1]. Hava güzel [Source 2]. Son.", "gelir 2020 arttı"), ("", "x"), (None, None), ("Tek cümle.", "x")], "a string, c string")
    got = [r[0] for r in s.select(benchmark.cited_support(F.col("a"), F.col("c"))).collect()]
    assert [(x.sentences, x.cited, x.supported, x.support) for x in got] == [(3, 2, 1, 0.5), (0, 0, 0, 0.0), (0, 0, 0, 0.0), (1, 0, 0, 1.0)]
    c = benchmark.confusion(spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "h boolean, j boolean"), F.col("h"), F.col("j")).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.accuracy, c.accepted) == (1, 1, 1, 1, 0.5, False)


def test_judge_takes_the_cache_first(spark):
    a = spark.createDataFrame([("k1", "long enough an answer"), ("k2", "no"), ("k3", None)], "key string, answer string")
    cache = spark.createDataFrame([("k2", 1.0, 1.0, 1.0, 1.0, 1.0)] * 2, "key string, correctness double, completeness double, faithfulness double, relevance double, citation_support double")
    assert rows(benchmark.judge(a, cache).select("key", "correctness", "judge_cached")) == [("k1", 4.5, False), ("k2", 1.0, True), ("k3", 2.0, False)]


def test_levels_in_any_order_and_cycles(spark):
    d = [("r", 1, [3]), ("r", 2, []), ("r", 3, [2]), ("c", 1, [2]), ("c", 2, [1]), ("c", 3, [])]
    got = rows(workflow.task_levels(spark.createDataFrame(d, "run string, step int, needs array<int>"), "run").select("run", "step", "level"))
    assert got == sorted([("r", 1, 3), ("r", 2, 1), ("r", 3, 2), ("c", 1, None), ("c", 2, None), ("c", 3, 1)], key=repr)


# --- chunking ------------------------------------------------------------------------------------------------------

def test_long_sentences_are_cut_by_words(spark):
    d = spark.createDataFrame([("kelime " * 400,), (None,), ("",), ("kısa",)], "t string")
    got = [[len(b.split()) for b in r[0]] for r in d.select(chunking.text_blocks(F.col("t"))).collect()]
    assert got == [[154, 154, 92], [], [], [1]]


def test_ranges_take_what_does_not_fit_and_overlap():
    assert chunking.ranges_of([]) == [] and chunking.ranges_of([900]) == [(1, 1)]
    r = chunking.ranges_of([20] * 200)
    assert r[0] == (1, 25) and r[1][0] == 24 and r[-1][1] == 200 and all(b[0] <= a[1] for a, b in zip(r, r[1:]))
    import time

    began = time.time()
    chunking.ranges_of([7] * 200_000)
    assert time.time() - began < 5


# --- provider and sources ------------------------------------------------------------------------------------------

def test_a_failing_provider_costs_only_its_texts(spark):
    def provider(s):
        if s.str.contains("bad").any():
            raise ValueError("no")
        return s + "!"

    d = spark.createDataFrame([(1, "c", "x"), (2, "c", "bad"), (3, "c", "y")], "response_id long, chunk_id string, text string")
    got = extract.with_provider(d, provider)
    assert rows(got.select("response_id", "response", "error")) == [(1, "x!", None), (2, None, "ValueError: no"), (3, "y!", None)]
    chunks = spark.createDataFrame([("c", "t", "f", 1)], "chunk_id string, text string, source_file string, page_number int")
    _, _, bad = extract.accept(got, chunks)
    assert {(r.response_id, r.reason_code) for r in bad.collect()} == {(1, "LLM_JSON_INVALID"), (2, "PROVIDER_ERROR"), (3, "LLM_JSON_INVALID")}
    cache = d.where("response_id = 1").select(extract.fingerprint(F.col("text"), "v").alias("fingerprint"))
    assert sorted(r.response_id for r in extract.uncached(d, cache, "text", "v").collect()) == [2, 3]


def test_upsert_merges_and_keeps_the_last_version(spark, tmp_path):
    p, kind = f"file://{tmp_path}/t", "k string, v int, x string"
    records.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 1, "old"), (None, 1, "lost")], kind), p, "k", "v")
    for n in (2, 3):
        got = rows(records.upsert(spark.createDataFrame([("a", n, "new"), ("c", n, "new"), ("b", 0, "late")], kind), p, "k", "v"))
    assert got == [("a", 3, "new"), ("b", 1, "old"), ("c", 3, "new")] and len(list((tmp_path / "t").glob("v*"))) == 2


def test_documents_that_have_output_are_left(spark, tmp_path):
    p = f"file://{tmp_path}/d"
    records.write_by_document(spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, x int"), p)
    records.write_by_document(spark.createDataFrame([("a", 2), ("c", 2)], "document_id string, x int"), p)
    read = lambda: rows(spark.read.json(p).select("document_id", "x"))
    assert read() == [("a", 1), ("b", 1), ("c", 2)]
    records.write_by_document(spark.createDataFrame([("a", 3)], "document_id string, x int"), p, overwrite=True)
    assert read() == [("a", 3), ("b", 1), ("c", 2)]


def test_canonical_rows_come_first_and_settings(spark, tmp_path):
    c = spark.createDataFrame([("a", "canon", 1)], "id string, name string, n int")
    r = spark.createDataFrame([("a", "raw"), ("b", "raw")], "id string, name string")
    assert rows(records.canonical_first(c, r, "id")) == [("a", "canon", 1), ("b", "raw", None)]
    d = spark.createDataFrame([(["x"], "y"), ([], "y"), (None, None)], "l array<string>, s string")
    assert [x[0] for x in d.select(records.first_or(F.col("l"), F.col("s"), "z")).collect()] == ["x", "y", "z"]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("companies:\n  - name: A\n    aliases: [x, y]\n  - name: B\n")
    assert rows(records.read_settings(spark, str(tmp_path / "c.yaml"), "companies", "name string, aliases array<string>")) == [("A", ["x", "y"]), ("B", None)]


def test_vector_collections(spark, tmp_path):
    p = f"file://{tmp_path}/v"
    assert records.ensure_vectors(spark, p, 3, "odd") == {"size": 3, "distance": "cosine"} == records.ensure_vectors(spark, p, 3, "dot")
    with pytest.raises(ValueError):
        records.ensure_vectors(spark, p, 4)
    assert records.ensure_vectors(spark, p, 4, "dot", reset=True) == {"size": 4, "distance": "dot"}


def test_paths_are_not_broadcast(spark):
    from reportloom.operators import graph

    # 400 starts meet in a hub that leads on to 400 nodes: 160,000 paths whose file is a small part of their size
    edges = [("a", f"s{i}", "hub") for i in range(400)] + [("b", "hub", f"m{i}") for i in range(400)] + [("c", f"m{i}", f"leaf{i}") for i in range(400)]
    e = spark.createDataFrame([(f"{t}{s}{d}", t, s, d) for t, s, d in edges], "id string, type string, src string, dst string")
    p = graph.paths(e, e.where("type = 'a'").select(F.col("src").alias("id")), 3, [["a"], ["b"], ["c"]])
    plan = p._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 2  # those of the hot keys, at most 200 rows
    assert p.count() == p.distinct().count() == 160_000 and p.where("substring(n2, 2) = substring(n3, 5) AND n1 = 'hub'").count() == 160_000
