"""Spellings of names typed by people, linked to the entity they mean.

Method: suffix blocking. The suffixes of a name's tokens from a minimum length are indexed. A block is a suffix within the other fields
that two names of one entity must share: entity type and the report's company (persons) or line of business (companies). A block
that is still too common is refined further, by the initials of the other and of the same token, then by its second letter, and one
that no refinement makes small is compared whole, part against part. Pairs in a block are compared by the ratio of the longest common subsequence.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.components import connected_groups
from reportloom.llm.words import fold
from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash, fan_out, release

#: Shortest suffix in the index; names that a block holds at most before it is refined; about how many names of a block that can't be refined further are in a part.
MIN_SUFFIX, BLOCK, PART = 4, 50, 1000
#: Ratios from which tokens, persons and companies agree.
TOKEN, PERSON, COMPANY = 0.72, 0.84, 0.88
#: Letters outside the longest common subsequence that one slip of the typist leaves at most: two for a wrong letter or two that changed places.
SLIP = 2
#: A token is an established spelling (two of them are two names, however alike) if it has this share of all mentions besides those of
#: its most frequent bearers, and so many sorts of bearers: persons of one ticker with one initial of the surname or given name beside it.
ESTABLISHED, BEARERS = 0.001, 4

# Forms of address and offices that are no part of a person's name.
TITLES = set("prof dr doc av sn sayin mr mrs ms ceo cfo coo genel mudur muduru yonetim kurulu uyesi baskani head of audit board member director chief executive financial officer".split())
# Words of a company's legal form.
LEGAL = set("as ao anonim sirketi sirket ltd sti limited inc gmbh holding hold hld san sanayi ve tic ticaret and co corp llc plc".split())
# Lines of business, each with its English word and its abbreviation.
SECTORS = """enerji energy ene|cam glass cam|otomotiv automotive oto|lojistik logistics loj|perakende retail per|kimya chemicals kim|madencilik mining mad|tekstil textile tek
sigorta insurance sig|denizcilik shipping den|gida food gid|cimento cement cim|elektronik electronics ele|yazilim software yaz|insaat construction ins|havacilik aviation hav"""
# Short forms of given names that aren't alike enough to be found.
SHORT = {
    "tom": "thomas", "kate": "catherine", "cathy": "catherine", "nick": "nicholas", "sam": "samuel", "bob": "robert", "rob": "robert", "bill": "william", "will": "william",
    "mike": "michael", "liz": "elizabeth", "eliza": "elizabeth", "beth": "elizabeth", "ted": "edward", "ed": "edward", "ben": "benjamin", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "vicky": "victoria", "chris": "christopher", "alex": "alexander", "sandy": "alexander", "hannes": "johannes", "fritz": "friedrich", "jon": "jonathan",
    "jen": "jennifer", "jenny": "jennifer", "kathi": "katharina", "nacho": "ignacio", "ibo": "ibrahim", "ismo": "ismail", "apo": "abdullah", "memo": "mehmet", "memet": "mehmet",
    "mistik": "mustafa", "musti": "mustafa", "emos": "emine", "fatos": "fatma", "zeyno": "zeynep", "sulo": "suleyman", "huso": "huseyin", "aysos": "ayse",
}

#: A node of the graph of names: scope, this sign, the name; and such as begin with an initial.
SIGN = "\x01"
INITIAL = "^P:[^\x01]*\x01[a-z] "
_SECTOR = {w: g.split()[0] for g in SECTORS.replace("\n", "|").split("|") for w in g.split()}
_LONG_SECTORS = [w for w in _SECTOR if len(w) > 3]


@functools.lru_cache(1 << 18)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u) | (s - u)
    return (full & ~s).bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _letters(text: str) -> str:
    t = fold(text)
    t = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", t)
    t = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", t)
    return t.replace("rn", "m")  # read alike from paper; folded on either side


def person_tokens(name: str) -> list[str]:
    """The parts of a person's name, given names (or initials) first, surname last; without titles, offices, brackets.

    The surname is before a comma, or the one part in capitals, or the last; words run together are parted at capitals.
    """
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    t = re.sub(r"(?<=[a-zçğıöşüéíáèàñ])(?=[A-ZÇĞİÖŞÜ])", " ", t)
    parts = [[w for w in re.findall(r"[^\W_]+", x) if _letters(w) not in TITLES] for x in t.split(",")]
    parts = [x for x in parts if x]
    if not parts:
        return []
    words = [w for x in parts[1:] for w in x] + parts[0] if len(parts) > 1 else parts[0]
    if len(parts) == 1 and len(words) > 1:
        loud = [len(w) > 1 and w.isupper() for w in words]
        if loud[0] and not any(loud[1:]) or len(words[-1]) == 1 and len(words[0]) > 1:
            words = words[1:] + words[:1]
    out = [w for x in words for w in re.findall(r"[a-z]+", _letters(x))]
    return [SHORT.get(w, w) if i + 1 < len(out) else w for i, w in enumerate(out)]


def company_tokens(name: str) -> tuple[str, list[str]]:
    """(line of business, other words) without legal forms; the line is as SECTORS has it first, empty if none is named."""
    words = [w for w in re.findall(r"[a-z]+", _letters(name)) if w not in LEGAL and len(w) > 1]
    words = [w for w in words if len(w) < 6 or max(ratio(w, x) for x in ("holding", "sanayi", "ticaret", "limited", "anonim", "sirketi")) < 0.85]
    exact = [i for i, w in enumerate(words) if w in _SECTOR]
    if exact:
        i = exact[-1]
        return _SECTOR[words[i]], words[:i] + words[i + 1 :]
    best = max(((ratio(w, s), i, s) for i, w in enumerate(words) for s in _LONG_SECTORS if abs(len(w) - len(s)) < 3), default=(0.0, 0, ""))
    # of a short word one wrong letter weighs more; it must then stand where the line of business does
    if len(words) > 1 and (best[0] >= 0.79 or best[0] >= 0.74 and best[1] in (0, len(words) - 1) and words[best[1]][0] == best[2][0] and len(best[2]) < 6):
        return _SECTOR[best[2]], words[: best[1]] + words[best[1] + 1 :]
    return "", words


def one_slip(a: str, b: str) -> bool:
    """The words differ by one slip, or are so long that more makes no difference."""
    common = lcs(a, b)
    return len(a) + len(b) - 2 * common <= SLIP or 2 * common >= COMPANY * (len(a) + len(b)) and min(len(a), len(b)) >= 12


def _given(x: str, y: str, established: frozenset[str]) -> float:
    """How well two given names agree; an initial fits a name that begins with it, but tells less."""
    if len(x) == 1 or len(y) == 1:
        return 0.5 if x[0] == y[0] else 0.0
    if x != y and x in established and y in established:
        return 0.0
    r = ratio(x, y)
    return r if r >= TOKEN else 0.0


def same_person(a: list[str], b: list[str], established: frozenset[str] = frozenset()) -> int:
    """2: the full names agree; 1: the surnames agree and an initial fits; 0: neither.

    First given names must agree with each other, surnames with each other; a middle name may be missing on one side,
    but two middle names must agree.
    """
    if not a or not b:
        return 0
    if len(a) == 1 or len(b) == 1:  # run together
        x, y = (a, b) if len(a) == 1 else (b, a)
        if len(x[0]) < 8:
            return 0
        if len(y) == 1:
            return 2 if ratio(x[0], y[0]) >= 0.9 else 0
        return 2 if all(len(w) > 1 for w in y) and max(ratio(x[0], "".join(y)), ratio(x[0], y[-1] + "".join(y[:-1])), ratio(x[0], y[0] + y[-1])) >= 0.9 else 0
    best = 0
    for q in (b, [*b[1:], b[0]]) if len(b[0]) > 1 and not (b[0] in established and b[-1] not in established) else (b,):
        for p in (a, [*a[1:], a[0]]) if q is b and len(a[0]) > 1 and not (a[0] in established and a[-1] not in established) else (a,):
            turned = p is not a or q is not b
            s = ratio(p[-1], q[-1])
            g = _given(p[0], q[0], established)
            if s < 0.75 or not g or turned and (s < 0.85 or g < 0.85) or not one_slip(p[-1], q[-1]):
                continue
            mp, mq = p[1:-1], q[1:-1]
            if mp and mq and (len(mp) != len(mq) or not all(_given(x, y, established) for x, y in zip(mp, mq))):
                continue
            if g == 0.5:  # an initial: the surname alone must carry it
                best = max(best, 1 if s >= 0.85 or (s >= 0.8 and len(p[-1]) < 7) else 0)
            elif (s * (len(p[-1]) + len(q[-1])) + g * (len(p[0]) + len(q[0]))) / sum(map(len, (p[0], q[0], p[-1], q[-1]))) >= PERSON:
                best = 2
    return best


def same_company(a: list[str], b: list[str]) -> bool:
    """The words besides line of business and legal form agree, wherever blanks are: each up to one slip, the whole by its ratio.

    Sister companies differ in the ending of a word, which is more than a slip.
    """
    x, y = "".join(a), "".join(b)
    if ratio(x, y) >= COMPANY:
        return all(map(one_slip, a, b)) if len(a) == len(b) else one_slip(x, y)
    return len(a) == len(b) == 2 and ratio(x, b[1] + b[0]) >= 0.95


def parse(kind: str | None, name: str, ticker: str) -> tuple[str, str, str] | None:
    """(scope, key, tokens): names are compared within a scope. None without letters."""
    if kind == "Company":
        sector, words = company_tokens(name)
        return (f"C:{sector}", " ".join(words), " ".join(words)) if words else None
    parts = person_tokens(name)
    return (f"P:{ticker}", " ".join(parts), " ".join(parts)) if any(len(w) > 1 for w in parts) else None


def suffixes(tokens: str) -> list[tuple[str, str, str, str]]:
    """(suffix, initial of another token, own initial, own second letter) for the index."""
    parts = tokens.split()
    out = set()
    for i, t in enumerate(parts):
        if len(t) < 2:
            continue
        others = {x[0] for j, x in enumerate(parts) if j != i} or {t[0]}
        for k in range(0, max(1, len(t) - MIN_SUFFIX + 1)):
            out |= {(t[k:], o, t[0], t[1]) for o in others}
    return sorted(out)


def link_names(spark: SparkSession, aliases: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(alias_id, entity_id): aliases of one entity have one entity_id (a name of the entity, made up; stable for equal input).

    A person is sought among those of the company whose report names them (the ticker in source_file), a company
    among those of its line of business in all reports. Full names are linked first and grouped; a name with an
    initial joins the one group of full names that it fits, or if it fits several the one most often named; other spellings with initials group
    among themselves. A row's canonical_entity_id, where it names a row of `canonical` that isn't withdrawn,
    links it to that entity's canonical_name. A null or blank alias is replaced by normalized_alias; rows without
    letters have an entity of their own. Repeated rows come out once. Runs its loops when called (see connected_groups).
    """
    stash = Stash(spark, "names")
    a = aliases.select(
        "alias_id", "entity_type", F.coalesce(F.when(F.trim("alias") != "", F.col("alias")), F.translate("normalized_alias", "_", " ")).alias("name"),
        F.coalesce(F.regexp_extract("source_file", r"([A-Za-z0-9]+)__", 1), F.lit("")).alias("ticker"), F.lower(F.trim("canonical_entity_id")).alias("cid"),
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, c, *((parse(k, n, t) if n else None) or ("", "", ""))) for i, k, n, t, c in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["alias_id", "cid", "scope", "key", "tokens"])

    parsed = stash.put(fan_out(a).mapInPandas(read, "alias_id string, cid string, scope string, key string, tokens string").distinct())
    node = F.concat_ws(SIGN, "scope", "key")
    rows = parsed.where("key <> ''").select("alias_id", "cid", "scope", "tokens", node.alias("node"))
    nodes = rows.groupBy("node", "scope", "tokens").agg(F.count(F.lit(1)).alias("n"))
    if canonical is not None:
        c = canonical.where(F.col("deleted_at").isNull()).select(F.col("canonical_id").alias("alias_id"), F.col("type").alias("entity_type"), F.col("canonical_name").alias("name"), F.coalesce(F.regexp_extract("canonical_id", r":([A-Za-z0-9]+):", 1), F.lit("")).alias("ticker"), F.lower(F.trim("canonical_id")).alias("cid"))
        official = stash.put(fan_out(c).mapInPandas(read, "alias_id string, cid string, scope string, key string, tokens string").where("key <> ''").select("cid", "scope", "tokens", node.alias("node")))
        nodes = nodes.unionByName(official.select("node", "scope", "tokens", F.lit(0).cast("bigint").alias("n"))).groupBy("node", "scope", "tokens").agg(F.sum("n").alias("n"))
    nodes = stash.put(nodes)
    # mentions by bearers, so that the misspellings of one person are no names, however often that person is named
    part = nodes.where(F.col("scope").startswith("P:")).select("scope", "n", F.split("tokens", " ").alias("t"))
    each = part.select("scope", "n", "t", F.posexplode("t").alias("i", "w"))
    other = F.substring(F.when(F.col("i") + 1 < F.size("t"), F.element_at("t", -1)).otherwise(F.element_at("t", 1)), 1, 1)
    words = each.groupBy("w", "scope", other.alias("o")).agg(F.sum("n").alias("n")).where("n > 0").groupBy("w").agg((F.sum("n") - F.max("n")).alias("n"), F.count(F.lit(1)).alias("bearers"))
    held = part.groupBy("scope", F.substring(F.element_at("t", -1), 1, 1).alias("o")).agg(F.sum("n").alias("n"))
    mentions = held.agg(F.sum("n") - F.max("n")).first()[0] or 0
    # a name has a few tokens, so if no sort of bearers holds most mentions this list has fewer than 8 / ESTABLISHED entries
    known = [r.w for r in words.where((F.col("n") >= ESTABLISHED * mentions) & (F.col("bearers") >= BEARERS)).orderBy(F.desc("n"), "w").limit(int(8 / ESTABLISHED)).collect()]
    established = spark.sparkContext.broadcast(frozenset(known))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(n, s, *x) for n, s, t in b.itertuples(index=False) for x in suffixes(t)]
            yield pd.DataFrame(out, columns=["node", "scope", "suffix", "other", "own", "second"])

    rows_of = stash.put(fan_out(nodes.select("node", "scope", "tokens")).mapInPandas(index, "node string, scope string, suffix string, other string, own string, second string"))
    levels = [["scope", "suffix"], ["other"], ["own"], ["second"]]
    keys = [sum(levels[: i + 1], []) for i in range(len(levels))]
    held_by = lambda d, key, i: d.groupBy(*key).agg(F.count_distinct("node").alias(f"_size{i}"))
    sized = rows_of.join(held_by(rows_of, keys[0], 0).where("_size0 > 1"), keys[0])
    block = lambda key: F.concat_ws(SIGN, *key)
    small = sized.where(f"_size0 <= {BLOCK}").select(block(keys[0]).alias("block"), "node", F.lit(1).cast("bigint").alias("size"))
    common = stash.put(sized.where(f"_size0 > {BLOCK}").drop("_size0"))
    refined = common
    for i in (1, 2, 3):
        refined = refined.join(held_by(common, keys[i], i), keys[i])
    # the first level that makes a block small enough; what none does is parted
    at = F.when(F.col("_size1") <= BLOCK, block(keys[1])).when(F.col("_size2") <= BLOCK, block(keys[2])).otherwise(block(keys[3]))
    refined = refined.select(at.alias("block"), "node", F.when(F.least("_size1", "_size2", "_size3") <= BLOCK, 1).otherwise(F.col("_size3")).alias("size"))
    # each part of a block meets itself and every later one, so all its pairs are compared
    of = small.unionByName(refined).distinct().withColumn("last", F.ceil(F.col("size") / PART).cast("int") - 1).withColumn("part", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    x = of.select("block", F.col("node").alias("x"), F.col("part").alias("p"), F.explode(F.sequence("part", "last")).alias("q"))
    y = of.select("block", F.col("node").alias("y"), F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"))
    candidates = x.join(y, ["block", "p", "q"]).where("p < q OR x < y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = established.value
        split = functools.lru_cache(4096)(lambda node: node.partition(SIGN)[2].split())
        for b in batches:
            out = []
            for x, y in b.itertuples(index=False):
                p, q = split(x), split(y)
                level = (2 if same_company(p, q) else 0) if x.startswith("C:") else same_person(p, q, names)
                if level:
                    out.append((x, y, level))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "level"])

    links = stash.put(candidates.mapInPandas(compare, "a string, b string, level int"))
    full = links.where("level = 2").select("a", "b")
    extra = None
    if canonical is not None:
        # the older resolution's own links; where a name is within a scope that can hold the entity
        spelt = rows.where("cid <> ''").select("cid", "scope", "node").distinct()  # an entity's spellings, however many rows it has
        extra = salted_lookup(spelt, official.groupBy("cid").agg(F.min(F.struct("node", "scope")).alias("_o")), "cid", "inner").where("scope = _o.scope AND node <> _o.node").select(F.col("node").alias("a"), F.col("_o.node").alias("b")).distinct()
        # a bare initial there would tie persons together: such names are joined below, to their own entity
        extra = extra.where(~F.col("a").rlike(INITIAL) & ~F.col("b").rlike(INITIAL))
        full = full.unionByName(extra)
    grouped = connected_groups(full, "a", "b")
    weight = nodes.select("node", "n").join(grouped.select(F.col("entity_id").alias("node"), "group_id"), "node", "left").withColumn("entity", F.coalesce("group_id", "node"))
    weight = stash.put(weight.select("node", "entity", "n"))
    heavy = weight.groupBy("entity").agg(F.sum("n").alias("size"))
    # names with initials: the group they fit; most often named first
    single = links.where("level = 1")
    both = single.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(single.select(F.col("b").alias("node"), F.col("a").alias("to")))
    short = both.where(F.col("node").rlike(INITIAL))
    target = salted_lookup(salted_lookup(short, weight.select(F.col("node").alias("to"), "entity"), "to", "inner"), heavy, "entity", "inner")
    target = target.where(~F.col("entity").rlike(INITIAL) | (F.col("entity") < F.col("node")))
    best = target.groupBy("node").agg(F.max_by("entity", F.struct((~F.col("to").rlike(INITIAL)).alias("full"), "size", "entity")).alias("joined"))
    ties = weight.join(best, "node", "inner").where("entity <> joined").select(F.col("entity").alias("a"), F.col("joined").alias("b")).distinct()
    merged = connected_groups(ties, "a", "b") if ties.limit(1).count() else None
    final = weight.select("node", "entity")
    if merged is not None:
        final = salted_lookup(final, merged.select(F.col("entity_id").alias("entity"), "group_id"), "entity").select("node", F.coalesce("group_id", "entity").alias("entity"))
    out = salted_lookup(rows.select("alias_id", "node"), final, "node", "inner").select("alias_id", F.col("entity").alias("entity_id"))
    alone = parsed.where("key = ''").select("alias_id", F.concat(F.lit("?"), "alias_id").alias("entity_id"))
    done = stash.finish(out.unionByName(alone).distinct())
    release(grouped)
    if merged is not None:
        release(merged)
    return done


def linked_pairs(linked: DataFrame) -> DataFrame:
    """(left_alias_id, right_alias_id) of all pairs of one entity, the smaller id first."""
    x = linked.select("entity_id", F.col("alias_id").alias("left_alias_id"))
    y = linked.select("entity_id", F.col("alias_id").alias("right_alias_id"))
    return x.join(y, "entity_id").where("left_alias_id < right_alias_id").select("left_alias_id", "right_alias_id").distinct()
