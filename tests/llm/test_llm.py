"""Small tests of the training-data operators: brute force, round trips, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from reportloom import session
from reportloom.llm import catalogue, components, encoding, languages, leaks, names, splitting, truncation, words
from reportloom.session import table

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert not oracle.compare(spark, SF, name, Q[name], SQL[name])


# --- splitting ---------------------------------------------------------------------------------------------------

TEXTS = [
    "Bir cümle. " * 900, "word " * 2000, "x" * 20000, "a,b;c." * 3000, "Para one.\n\n" * 700, "\r\n".join(["line of some words"] * 800), "é" * 9000, "日本語。" * 2000,
    " " * 9000, "w " * 5000 + "z" * 9000, " ".join(["nbsp"] * 900),
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
@pytest.mark.parametrize("limits", [(500, 4000, 50), (20, 100, 5), (500, 4000, 0), (3, 10, 1)])
def test_pieces_are_whole_and_within_limits(i, limits):
    text, (tok, chars, over) = TEXTS[i][: 4000 if limits[0] == 3 else None], limits
    parts = splitting.split_text(text, tok, chars, over)
    assert parts[0][2] == 0 and parts[-1][1] == len(text)
    for k, (s, e, f) in enumerate(parts):
        assert s <= f < e and e - s <= chars and splitting.tokens(len(splitting.WORDS.findall(text[s:e]))) <= tok
        if k:
            assert f == parts[k - 1][1] and splitting.tokens(len(splitting.WORDS.findall(text[s:f]))) <= over
    assert "".join(text[f:e] for _, e, f in parts) == text


def test_cuts_fall_on_paragraphs_where_there_are_any():
    text = "\n\n".join(["Bu bir paragraf, birkaç sözcüklük. İkinci cümle de var."] * 150)
    assert all(text[:f].endswith("\n\n") for _, _, f in splitting.split_text(text)[1:])


def test_split_chunks_edge_cases(spark):
    d = spark.createDataFrame([("a", 3, None, 1), ("b", 4, "", 1), ("c", None, "kısa", 1), ("d", 5, "sözcük " * 600, 1), ("d", 5, "sözcük " * 600, 1), (None, 1, "y" * 4001, 1)], "chunk_id string, chunk_index int, text string, token_count int")
    p = splitting.split_chunks(d.withColumn("pieces", F.lit("clash"))).toPandas()
    assert len(p[p.chunk_id == "d"]) == 4 and set(p[p.chunk_id == "d"].chunk_index) == {0, 1}
    assert not p[p.chunk_id.isin(["a", "b", "c"])].oversized.any() and p[p.chunk_id.isna()].oversized.all()
    assert splitting.split_chunks(d.limit(0)).count() == 0


# --- names -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    "a, b, level",
    [
        ("Samuel Vıyişoğlu", "VIYİŞOĞLU, Sam (CFO)", 2), ("Prof. Dr. Elif Pukayer", "ELİF PUKAYR", 2), ("E. Pukayer", "Elif Pukayer", 1), ("Zehra Pupökman", "ZehraPupökman", 2), ("Emine Zeliha Nısak", "Zeliha Nısak", 0),
        ("Ramazan Margaret Pulikkan", "Ramazan M. Pulikkan", 2), ("Ramazan Margaret Pulikkan", "Ramazan Hasan Pulikkan", 0), ("Ramazan Margaret Pulikkan", "Pulikkan, R.", 1), ("Ali Locövtürk", "Thomas Locövtürk", 0), ("Hasan Tepe", "Hakan Tepe", 0), ("", "Ali Veli", 0), ("Elif Pukayer", "Elif Pukyaer", 2), ("Elif Pukayersoy", "Elif Pumayarsoy", 0),
    ],
)
def test_same_person(a, b, level):
    known = frozenset({"hasan", "hakan", "ali", "thomas", "elif", "zehra", "ramazan", "margaret", "samuel"})
    x, y = names.person_tokens(a), names.person_tokens(b)
    assert names.same_person(x, y, known) == names.same_person(y, x, known) == level


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Gopekix Kehil Havacılık A.Ş.", "Havacılık GopekixK ehil Inc.", True), ("Sokipform Pupöz Yazılım Limited Şirketi", "SOKİPFORM PUUPÖZ SOFTWARE", True), ("Fıhakform Tacür Cam A.Ş.", "Fıhakform Tacür Tekstil A.Ş.", False),
        ("Fıhazon Tacüv Perakende", "Fıhazmaks Tacüv Perakende", False), ("Datuyora Locov Cam", "Datuyon Locov Cam", False), ("Datuyora Locov Cam", "Datuyroa Locov Cam", True), ("Ç0FÜYNET BEBÖL ÇİMENTO HLD.", "Çofüynet Beböl Cement Holding A.Ş.", True),
    ],
)
def test_same_company(a, b, same):
    (s, x), (t, y) = names.company_tokens(a), names.company_tokens(b)
    assert (s == t and names.same_company(x, y)) == same


def test_lcs_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in "ab")
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert names.lcs(a, b) == t[-1, -1]


ALIAS = "alias_id string, entity_type string, alias string, normalized_alias string, canonical_entity_id string, source_file string"


def test_link_names(spark):
    f = "AAAAA__2020__x__tr__1.pdf"
    d = [
        ("1", "Person", "Elif Pukayer", None, None, f), ("2", "Person", "PUKAYER, Elif", None, None, f), ("2", "Person", "PUKAYER, Elif", None, None, f), ("3", "Person", "E. Pukayer", None, None, f), ("4", "Person", "Elif Pukayer", None, None, "BBBBB__2020__x__tr__1.pdf"),
        ("5", "Person", None, "elif_pukayer", None, f), ("6", "Company", "Gopekix Kehil Gıda A.Ş.", None, None, f), ("7", "Company", "gopekix kehil food", None, None, "BBBBB__2020__x__tr__1.pdf"), ("8", "Company", "Gopekix Kehil Kimya A.Ş.", None, None, f),
        ("9", None, None, None, None, None), ("10", "Person", "...", None, None, None),
    ]
    got = rows(names.linked_pairs(names.link_names(spark, spark.createDataFrame(d, ALIAS).withColumn("entity_id", F.lit("clash")))))
    assert got == sorted([("1", "2"), ("1", "3"), ("1", "5"), ("2", "3"), ("2", "5"), ("3", "5"), ("6", "7")])
    assert names.link_names(spark, spark.createDataFrame([], ALIAS)).count() == 0


@pytest.mark.parametrize("part, more", [(7, 10), (1000, 10), (300, 1200)])
def test_large_blocks_are_compared_whole(spark, monkeypatch, part, more):
    monkeypatch.setattr(names, "PART", part, raising=False)
    rng = random.Random(2)
    # the surname's blocks stay large after every refinement, and no other suffix holds the first two names
    others = ["m" + "".join(rng.choice("bcdfghjklnpqrstvwxz") for _ in range(9)) for _ in range(names.BLOCK + more)]
    d = [(f"a{i}", f"{g.capitalize()} Yilmaz", "Person") for i, g in enumerate(["mehmet", "mexmet", *others])]
    a = spark.createDataFrame(d, "alias_id string, alias string, entity_type string").select("*", F.lit("").alias("normalized_alias"), F.lit("data/T__2020__x.pdf").alias("source_file"), F.lit("").alias("canonical_entity_id"))
    assert ("a0", "a1") in rows(names.linked_pairs(names.link_names(spark, a)))


def test_misspellings_of_a_frequent_person_are_no_names(spark):
    # one person with a third of the rows, each misspelling often; Mehmet and Ahmet are names that many have
    hot = [("mehmet", 300), ("mehmt", 60), ("mehmed", 60), ("emhmet", 60)]
    d = [(f"h{k}{i}", f"{g.capitalize()} Korkmaz", "T0") for k, (g, n) in enumerate(hot) for i in range(n)]
    d += [(f"{g}{i}{s}", f"{g.capitalize()} {s}", f"T{i}") for i in range(1, 41) for g in ("mehmet", "ahmet") for s in ("Bulut", "Cetin", "Duman", "Ergin", "Gunes", "Irmak")]
    a = spark.createDataFrame(d, "alias_id string, alias string, ticker string").select("alias_id", "alias", F.lit("Person").alias("entity_type"), F.lit("").alias("normalized_alias"), F.concat(F.lit("data/"), "ticker", F.lit("__2020__x.pdf")).alias("source_file"), F.lit("").alias("canonical_entity_id"))
    got = {r.alias_id: r.entity_id for r in names.link_names(spark, a).collect()}
    assert len({e for i, e in got.items() if i[0] == "h"}) == 1 and got["mehmet1Bulut"] != got["ahmet1Bulut"] and len(set(got.values())) == 1 + 40 * 12


def test_known_links_are_found(spark):
    a = table(spark, SF2, "aliases")
    p = names.link_names(spark, a).join(a.select("alias_id", F.lower(F.trim("canonical_entity_id")).alias("cid")).distinct(), "alias_id").where("cid <> '' AND cid NOT LIKE '%kayip%'")
    p = p.withColumn("cid", F.regexp_replace("cid", ":variant:.*", "")).toPandas()
    same = sum(len(g) * (len(g) - 1) // 2 for _, g in p.groupby("cid"))
    found = sum(len(g) * (len(g) - 1) // 2 for _, g in p.groupby(["cid", "entity_id"]))
    mixed = sum(len(g) * (len(g) - 1) // 2 for _, g in p.groupby("entity_id")) - found
    assert found >= 0.9 * same and mixed <= 0.05 * same


# --- languages ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    return languages.label_languages(spark, table(spark, SF2, "chunks")).toPandas()


def test_languages_agree_with_labels(labelled):
    d = labelled[labelled.label_iso.notna() & labelled.language.notna()]
    assert (d.label_iso == d.language).mean() > 0.85  # a tenth of the labels is wrong by design
    assert labelled.confidence.dropna().between(0, 1).all()


def test_languages_on_clean_sentences(spark):
    m = languages.fit(table(spark, SF2, "chunks"), "chunk_id", "text", "language")
    said = {"tr": "Yönetim Kurulu, toplantısında payların geri alınmasına karar vermiştir.", "en": "The Board decided to buy back shares over the following months.", "de": "Der Vorstand hat beschlossen, eigene Aktien zurückzukaufen, und die Prüfer wiesen darauf hin.", "fr": "Le conseil d'administration a décidé de racheter des actions sur le marché."}
    d = spark.createDataFrame([(k, v) for k, v in said.items()] + [("mixed", said["tr"] + "\n\n" + said["de"]), ("none", None), ("blank", " "), ("digits", "12 | 14"), ("caps", said["tr"].replace("i", "İ").upper()), ("ascii", "Yonetim Kurulu, toplantisinda paylarin geri alinmasina karar vermistir.")], "k string, text string")
    got = {r.k: r for r in languages.classify(d, m, "k", "text").collect()}
    assert {k: got[k].language for k in said} == {k: k for k in said}
    assert sorted(got["mixed"].languages) == ["de", "tr"] and [s.language for s in got["mixed"].segments] == ["tr", "de"]
    assert got["caps"].language == got["ascii"].language == "tr"
    assert all(got[k].language is None and got[k].languages == [] for k in ("none", "blank", "digits"))
    assert languages.classify(d.limit(0), m, "k", "text").count() == 0
    assert {r.language for r in languages.classify(d, None, "k", "text").collect()} == {None}


def test_labels_in_any_notation(spark):
    d = spark.createDataFrame([(x,) for x in ("tr-TR", "Türkçe", " TR ", "İngilizce", "en_GB", "und", "", "??", None, "deu", "xx", "fi-FI", "n/a")], "l string")
    assert [r[0] for r in d.select(languages.iso_label(F.col("l"))).collect()] == ["tr", "tr", "tr", "en", "en", None, None, None, None, "de", None, "fi", None]


def test_a_language_without_listed_notations_is_learned_from_its_code(spark):
    said = {"fi": "Hallitus päätti ostaa yhtiön osakkeita takaisin seuraavien kuukausien aikana. Tehtaan tuotanto kasvoi vuoden aikana selvästi.", "en": "The board decided to buy back shares over the following months. The output of the plant grew during the year."}
    r = random.Random(1)
    d = [(f"{k}{i}", k, " ".join(r.sample(t.split(), 12)) + ".") for k, t in said.items() for i in range(60)]
    m = languages.fit(spark.createDataFrame(d, "k string, lang string, text string"), "k", "text", "lang")
    got = languages.classify(spark.createDataFrame([(k, t) for k, t in said.items()], "k string, text string"), m, "k", "text").collect()
    assert m.languages == ["en", "fi"] and all(x.language == x.k for x in got)


def test_segments_cover_units_in_order(labelled):
    for s in labelled.segments:
        assert all(a["end"] <= b["start"] for a, b in zip(s, s[1:]))


# --- components --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("one_task", [0, 40, components.ONE_TASK])
def test_groups_against_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = random.Random(5)
    pairs = [(f"n{r.randint(0, 80):02d}", f"n{r.randint(0, 80):02d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)] + [("hub", f"h{i}") for i in range(50)] + [(None, "n00"), ("n00", None), (None, None), ("self", "self")]
    r.shuffle(pairs)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((n, find(n)) for n in parent)
    d = spark.createDataFrame(pairs, "a string, b string").withColumn("group_id", F.lit("clash"))
    assert rows(components.connected_groups(d, "a", "b")) == want
    assert components.connected_groups(d.limit(0), "a", "b").count() == 0


# --- intermediate tables -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p5_found", "p8_found", "p9_found"])
def test_at_most_the_result_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch, name):
    session.sweep(spark)
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    assert Q[name](spark, SF).count()
    assert len(list(tmp_path.glob("*/[0-9]*"))) <= 1
    session.sweep(spark)
    assert not list(tmp_path.glob("*/[0-9]*"))


# --- encoding ----------------------------------------------------------------------------------------------------

ALPHABETS = ["abc ", "ab'srelvt1. \n", "   \n\tx", "ığüşöçİI ", "日本語テキスト", "😀👍🏽ab", "0123456789", "ab1!?-—…   x", "-=_#*"]


def test_tree_concatenation_is_exact():
    encode, of = encoding.encoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    r = random.Random(6)
    for n in range(1500):
        alphabet = r.choice(ALPHABETS) + (r.choice(ALPHABETS) if r.random() < 0.4 else "")
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 500)))
        parts = encoding.cut(t, r.choice([5, 17, 40, 100]))
        assert "".join(parts) == t
        assert encoding.merge_pieces([encode(p) for p in parts], encode, of) == encode(t), repr(t)
        assert encoding.encode_tree(t, encode, of, r.choice([3, 30, 150])) == encode(t), repr(t)


def test_most_documents_pass_through_concatenation(spark, monkeypatch):
    encode, of = encoding.encoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    joins, plain = [], encoding.concatenate
    monkeypatch.setattr(encoding, "concatenate", lambda *a: joins.append(1) or plain(*a))
    texts = [r.text or "" for r in table(spark, SF2, "documents").collect()]
    joined = 0
    for t in texts:
        before = len(joins)
        assert encoding.encode_tree(t, encode, of) == encode(t)
        joined += len(joins) > before
    assert joined > 0.8 * len(texts) and len(joins) > 2 * len(texts)


def test_encode_corpus(spark):
    encode, of = encoding.encoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    texts = [None, "", " ", "<|endoftext|> is ordinary", "İş güvenliği 😀", "z" * 900, "no blanks," * 200, "some words and more " * 120, "some words and more " * 120]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for stretch in (64, 600, encoding.STRETCH):
        got = {r.doc_id: r.ids for r in encoding.encode_corpus(d, piece=32, stretch=stretch).collect()}
        assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    assert all(b"".join(of[i] for i in got[k]).decode() == (t or "") for k, t in enumerate(texts))
    assert encoding.encode_corpus(d.limit(0)).count() == 0


# --- leaks -------------------------------------------------------------------------------------------------------

def test_leaks_against_brute_force(spark):
    d, i = table(spark, SF2, "documents"), table(spark, SF2, "eval_items")
    got = set(rows(leaks.find_leaks(d, i).where("longest_run >= 12").select("doc_id", "item_id")))
    grams = {}
    for r in i.collect():
        for g in words.gram_hashes(words.fold_words(r.text), 12).tolist():
            grams.setdefault(g, set()).add(r.item_id)
    want = {(r.doc_id, k) for r in d.collect() for g in words.gram_hashes(words.fold_words(r.text), 12).tolist() for k in grams.get(g, ())}
    assert got == want and want


def test_leaks_edited_and_folded(spark):
    item = "Yönetim kurulu on iki Mart günü yapılan toplantıda şirketin ikinci tesisini Ankara yakınında kurma kararını oy birliğiyle aldı ve duyurdu"
    docs = [(1, f"Önce. {item.upper().replace(' ', ',' + chr(10))}! Sonra."), (2, item.replace("ikinci", "üçüncü").replace("oy", "tam oy")), (3, "bambaşka bir metin " * 20), (4, None), (5, ""), (6, " ".join(item.split()[:11]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    i = spark.createDataFrame([("i", item), ("n", None), ("e", ""), ("s", "iki kelime")], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(d, i).collect()}
    assert got[1, "i"].longest_run == 20 and got[2, "i"].longest_run < 12 and got[2, "i"].score >= leaks.MIN_SCORE and got[6, "i"].longest_run == 11
    assert not any(k in (3, 4, 5) for k, _ in got)
    assert leaks.find_leaks(d.limit(0), i).count() == leaks.find_leaks(d, i.limit(0)).count() == 0


def test_edited_copies_of_a_frequent_passage(spark):
    # a passage of eight items in 120 documents, and an edited copy that keeps only a frequent run of it
    passage = [f"p{j}" for j in range(16)]
    copy = passage[:6] + ["x"] + passage[7:12] + ["y"]
    docs = spark.createDataFrame([(i, " ".join(passage)) for i in range(120)] + [(999, " ".join(copy))], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", " ".join([*passage, *(f"q{k}_{j}" for j in range(3))])) for k in range(8)], "item_id string, text string")
    got = leaks.find_leaks(docs, items).where(f"score >= {leaks.MIN_SCORE}")
    assert rows(got.where("doc_id = 999").select("item_id")) == [(f"i{k}",) for k in range(8)] and got.count() == 121 * 8


def test_smith_waterman_against_plain_recursion():
    r, cases, want = random.Random(7), [], []
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 8))] for _ in "ab")
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (leaks.MATCH if a[i] == b[j] else leaks.MISMATCH), h[i, j + 1] + leaks.GAP, h[i + 1, j] + leaks.GAP)
        cases.append((np.array(a, np.uint64) + 10, np.array(b, np.uint64) + 10))
        want.append(h.max())
    assert np.allclose(leaks.smith_waterman(cases)[0], want, atol=1e-9) and leaks.smith_waterman([])[0].size == 0


def test_batches_of_words_against_plain_splitting():
    import re

    r = random.Random(8)
    alphabet = ["a", "B", "ı", "İ", "ß", "é", "e\u0301", "Σ", "ς", " ", "-", "_", "\n", "\u00ad", "7", "٣", "日", "\U00020000", "😀", "\ue000", "ﬁ", "’"]
    texts = [None, "", " ", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000))]
    h, ends = words.batch_words(texts)
    seen = {}
    for t, a, b in zip(texts, ends, ends[1:]):
        plain = re.findall(r"[^\W_]+", words.fold((t or "").replace("\ue000", " ")))
        assert len(plain) == b - a
        for w, x in zip(plain, h[a:b].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("share, least", [(0.05, 0.99), (0.1, 0.97), (0.2, 0.9)])
def test_recall_of_edited_copies(spark, share, least):
    """Copies of whole items with a share of their words changed, left out or added, planted in documents."""
    r = random.Random(9)
    items = [x for x in table(spark, SF2, "eval_items").collect() if len(words.fold_words(x.text)) >= 2 * leaks.RUN][:300]
    hosts = [x.text for x in table(spark, SF2, "documents").where("length(text) > 200").collect()]
    docs = []
    for n, x in enumerate(items):
        copy = [y for w in x.text.split() for y in ([w] if r.random() >= share else r.choice([[], ["bambaşka"], [w, "ayrıca"]]))]
        docs.append((n, r.choice(hosts) + "\n" + " ".join(copy) + "\n" + r.choice(hosts)))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x.item_id, x.text) for x in items], "item_id string, text string"))
    found = {(a, b) for a, b in rows(got.where(f"score >= {leaks.MIN_SCORE}").select("doc_id", "item_id"))}
    recall = sum((n, x.item_id) in found for n, x in enumerate(items)) / len(items)
    print("recall of edited copies", share, recall)
    assert recall >= least


# --- truncation --------------------------------------------------------------------------------------------------

def test_truncation_held_out(spark):
    """Whole texts of other rows than the classifier saw most of, cut at a known place, against their own whole sentences."""
    d = table(spark, SF2, "documents")
    whole = [r.text for r in d.where("length(text) > 300").orderBy("doc_id").collect()]
    cases = [(i, "x", *e) for i, t in enumerate(whole[:400]) for e in truncation.examples(t, ((), ()), i + 10_000)[1:]]
    f = spark.createDataFrame([(n, s, t, y) for n, (_, s, t, y) in enumerate(cases)], "doc_id long, source string, text string, y int")
    known = d.select("doc_id", "source", "text").withColumn("y", F.lit(None).cast("int")).withColumn("doc_id", -F.col("doc_id") - 1)
    got = truncation.find_truncated(known).count()
    assert got == d.count()
    scored = truncation.find_truncated(known.unionByName(f)).join(f.select("doc_id", "y"), "doc_id").toPandas()
    assert (scored.truncated.astype(int) == scored.y).mean() > 0.93


def test_truncation_edge_cases(spark):
    d = table(spark, SF2, "documents").select("doc_id", "text", "source").where("doc_id < 900")
    odd = spark.createDataFrame([(-1, None, "a"), (-2, "", None), (-3, " \n", "a"), (-4, "-", "a"), (-5, "Bu cümle tamamdır ve biter.", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in truncation.find_truncated(d.unionByName(odd)).where("doc_id < 0").collect()}
    assert len(got) == 5 and not any(r.truncated for r in got.values()) and got[-2].source is None
    assert truncation.find_truncated(odd.limit(0)).count() == 0
    assert {r.score for r in truncation.find_truncated(odd.where("doc_id > -5")).collect()} == {0.0}


@pytest.mark.parametrize("most", [truncation.BROADCAST_SOURCES, 10])
def test_limits_of_a_thousand_sources(spark, monkeypatch, most):
    monkeypatch.setattr(truncation, "BROADCAST_SOURCES", most)
    limit = 100 + F.pmod(F.col("id").cast("int") / 40, F.lit(300)).cast("int")
    d = spark.range(40_000).select("id", F.concat(F.lit("s"), (F.col("id") / 40).cast("int")).alias("source"), limit.alias("limit"))
    d = d.withColumn("text", F.expr("rpad(cast(id AS string), CASE WHEN id % 40 < 12 THEN limit ELSE 70 + id % 40 * 13 END, 'x')"))
    limits = truncation.field_limits(truncation.length_counts(d, "source", "text"))
    got = truncation.with_limits(d, limits, limits.count(), d.count()).where("array_contains(chars, limit)")
    assert limits.count() == 1000 and got.count() == d.count()


def test_repeated_texts_change_no_score(spark):
    d = table(spark, SF2, "documents").select("doc_id", "text", "source")
    ten = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("doc_id") + F.col("k") * 1_000_000).alias("doc_id"), "text", "source")
    one = {r.doc_id: r.score for r in truncation.find_truncated(d).collect()}
    many = {r.doc_id: r.score for r in truncation.find_truncated(ten).where("doc_id < 1000000").collect()}
    assert one == many and len(one) > 900


def test_rates(spark):
    d = spark.createDataFrame([("a", True), ("a", False), (None, True)], "source string, truncated boolean")
    assert rows(truncation.truncation_rates(d)) == sorted([("a", 2, 1, 0.5), (None, 1, 1, 1.0)], key=repr)
