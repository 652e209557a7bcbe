"""Planning of questions, task order, budgets, rate windows, trace metrics and run manifests, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.ordering import running_sum

#: Phrases that mark a question's kind.
COMPARE = ["karşılaştır", "karsilastir", "kıyas", "compare", "versus", " vs ", "difference between", "fark"]
MULTI_HOP = ["hangi ortaklık", "ilişki", "iştirak", "bağlı", "through", "subsidiary", "related", "whose"]
# Words out of the domain; words left out of a rewritten question; what its variants end in; phrases for 2024 and for 2025; years after the data's.
OUT_OF_DOMAIN = ["spacex", "apple", "iphone", "mars projesi", "tesla", "microsoft", "amazon", "google", "facebook"]
NOISE = ["geçen yıl", "geçen sene", "iyi miydi", "nasıldı", "nasıl", "nedir", "hakkında"]
SUFFIXES = ["gelir net kâr cirosu operasyonel ve finansal performansı", "revenue net profit investment performance"]
LAST_YEAR, THIS_YEAR = ["geçen yıl", "geçen sene", "önceki yıl", "geçen faaliyet dönemi"], ["bu yıl", "bu sene", "son dönem"]
LATER = "(?:^|[^0-9])(?:20[2-9][6-9]|20[3-9][0-9])(?:[^0-9]|$)"


def _has(q: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(q, p))


def question_year(q: Column) -> Column:
    """2024 or 2025 for a phrase that stands for it, else the first year 2020 to 2029 in a question, or null."""
    t = T.lower_tr(F.coalesce(q, F.lit("")))
    stated = F.nullif(F.regexp_extract(t, r"(?:^|[^0-9])(202[0-9])(?:[^0-9]|$)", 1), F.lit("")).cast("int")
    return F.when(_has(t, LAST_YEAR), 2024).when(_has(t, THIS_YEAR), 2025).otherwise(stated)


def question_kind(q: Column) -> Column:
    """out_of_domain, comparison, multi_year, multi_hop or single."""
    t = T.lower_tr(F.coalesce(q, F.lit("")))
    years = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("20[12][0-9]"), F.lit(0))))
    return F.when(_has(t, OUT_OF_DOMAIN) | t.rlike(LATER), "out_of_domain").when(_has(t, COMPARE), "comparison").when(years > 1, "multi_year").when(_has(t, MULTI_HOP), "multi_hop").otherwise("single")


#: The steps of each plan as (step, tool, steps it needs).
PLANS = {
    "single": [(1, "vector", []), (2, "verify", [1]), (3, "write", [2])],
    "multi_year": [(1, "vector", []), (2, "vector", []), (3, "verify", [1, 2]), (4, "write", [3])],
    "comparison": [(1, "vector", []), (2, "vector", []), (3, "graph", []), (4, "verify", [1, 2, 3]), (5, "write", [4])],
    "multi_hop": [(1, "graph", []), (2, "vector", [1]), (3, "verify", [2]), (4, "write", [3])],
    "out_of_domain": [(1, "refuse", [])],
}


def plan_steps(questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, kind, step, tool, needs): the tasks of each question."""
    kinds = F.create_map(*[x for k, steps in PLANS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(s).alias("step"), F.lit(t).alias("tool"), F.array(*map(F.lit, n)).cast("array<int>").alias("needs")) for s, t, n in steps]))])
    q = questions.select(key, question_kind(F.col(question)).alias("kind"))
    return q.select(key, "kind", F.explode(kinds[F.col("kind")]).alias("s")).select(key, "kind", "s.step", "s.tool", "s.needs")


def ready_tasks(tasks: DataFrame, run: str) -> DataFrame:
    """Pending tasks (run, step, needs, done) all of whose needed steps are done, in order of step."""
    done = tasks.where("done").groupBy(run).agg(F.collect_set("step").alias("_done"))  # a plan has a handful of steps
    j = tasks.where("NOT done").join(done, run, "left").withColumn("_done", F.coalesce("_done", F.array().cast("array<int>")))
    return j.where(F.forall("needs", lambda n: F.array_contains("_done", n))).drop("_done")


def task_levels(tasks: DataFrame, run: str) -> DataFrame:
    """Adds level: 1 without needs, else one more than the highest of the needed steps, in whatever order steps are numbered; null for steps of a cycle and what needs them.

    One run's few steps are folded in its row: as many passes as it has steps settle all levels; one that grows still is in a cycle. Steps needed but missing count as level 0.
    """
    t, n = F.array_sort(F.collect_list(F.struct("step", "needs"))), F.size("t")
    start = F.map_from_entries(F.transform("t", lambda s: F.struct(s["step"], F.lit(1))))
    one = lambda m: lambda s: F.struct(s["step"], 1 + F.coalesce(F.array_max(F.transform(s["needs"], lambda x: F.coalesce(F.try_element_at(m, x), F.lit(0)))), F.lit(0)))
    settled = F.aggregate(F.sequence(F.lit(1), n), start, lambda m, _: F.map_from_entries(F.transform("t", one(m))))
    levels = tasks.groupBy(run).agg(t.alias("t")).select(run, n.alias("_n"), F.explode(settled).alias("step", "_l"))
    return tasks.join(levels, [run, "step"]).withColumn("level", F.when(F.col("_l") <= F.col("_n"), F.col("_l"))).drop("_l", "_n")


def rate_windows(requests: DataFrame, client: str, at: str, most: int, seconds: int) -> DataFrame:
    """Adds in_window (requests of the client in the last `seconds`, this one included) and allowed (not more than `most`).

    A range window per client and hour-sized stretch: requests of the stretch before are repeated at its head, so
    a client that makes a third of the requests is many small windows. Null clients are one client.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    stretch = F.lit(3_600_000_000 if seconds <= 3600 else seconds * 1_000_000)
    r = requests.withColumn("_t", t).withColumn("_s", F.floor(t / stretch)).withColumn("_own", F.lit(True))
    spill = r.where(F.col("_t") >= (F.col("_s") + 1) * stretch - seconds * 1_000_000).withColumn("_s", F.col("_s") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(client, "_s").orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    n = F.count(F.lit(1)).over(w)
    return r.unionByName(spill).withColumn("in_window", n).where("_own").drop("_t", "_s", "_own").withColumn("allowed", F.col("in_window") <= most)


def trace_metrics(events: DataFrame, run: str, agent: str, seconds: str, failed: Column) -> DataFrame:
    """(run, agent, calls, total, mean, failures, failure_rate)."""
    return events.groupBy(run, agent).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(seconds), 4).alias("total"), F.round(F.avg(seconds), 8).alias("mean"), F.count_if(failed).alias("failures"), F.round(F.avg(F.coalesce(failed, F.lit(False)).cast("int")), 6).alias("failure_rate"))


def budget_use(events: DataFrame, run: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Adds spent (running cost in order, which must be total) and exhausted (spent reaches the budget). A run of any size is summed in ranges."""
    e = running_sum(events, [run], order, F.col(cost), "spent")
    return e.withColumn("spent", F.round("spent", 4)).withColumn("exhausted", F.col("spent") >= budget)


def config_hash(settings: Column) -> Column:
    """SHA-256 of a string map as JSON with sorted keys."""
    s = F.array_sort(F.map_entries(settings))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(s, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), F.coalesce(e["value"], F.lit("")), F.lit('"'))), ","), F.lit("}")), 256)


def run_id(client: Column, question: Column) -> Column:
    """The same for the same client key and question, whatever its blanks and case."""
    return F.substring(F.sha2(F.concat_ws("|", client.cast("string"), T.lower_tr(T.one_blank(question))), 256), 1, 16)


def rewrite_question(q: Column, company: Column, year: Column) -> Column:
    """Company and year in front, noise words and marks left out, single blanks."""
    t = F.regexp_replace(T.lower_tr(F.coalesce(q, F.lit(""))), "[?.,!]", " ")
    t = F.regexp_replace(t, "(^| )(?:" + "|".join(NOISE) + ")(?= |$)", " ")
    return T.one_blank(F.concat_ws(" ", company, year.cast("string"), t))


def expand_question(rewritten: Column, n: int = 3) -> Column:
    """The question and its variants with a suffix, n at most."""
    return F.slice(F.array(rewritten, *[F.concat_ws(" ", rewritten, F.lit(s)) for s in SUFFIXES]), 1, n)


def claim_status(cited: Column, company_ok: Column, year_ok: Column, value_ok: Column, contradicted: Column) -> Column:
    """unsupported without a known citation; else wrong_company, wrong_year, contradicted, value_missing or supported, in this order."""
    return F.when(~F.coalesce(cited, F.lit(False)), "unsupported").when(~F.coalesce(company_ok, F.lit(True)), "wrong_company").when(~F.coalesce(year_ok, F.lit(True)), "wrong_year").when(F.coalesce(contradicted, F.lit(False)), "contradicted").when(~F.coalesce(value_ok, F.lit(True)), "value_missing").otherwise("supported")
