"""Evaluation of answers and plans: label and slot metrics, families of cases, packaged regression sets, outcome tags, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import first_reason

# The closed lists of outcome tags.
DISPOSITIONS = ("answer", "clarify", "abstain")
REASONS = ("none", "taxon_not_found", "intent_uncertain", "ambiguous_name", "filter_mismatch", "evidence_not_found", "observations_empty", "handler_unavailable", "upstream_error", "unsupported_question", "unknown", "interpretation_error", "invalid_plan", "semantic_audit_rejected",
    "plan_validation_rejected", "unresolved_conditions", "unsupported_relation", "unsupported_conditions", "negated_conditions", "ambiguous_conditions", "insufficient_data", "no_matching_results")
STAGES = ("none", "routing", "name_resolution", "retrieval", "generation", "validation", "unknown", "interpretation", "semantic_audit", "plan_validation")
INTENTS = ("profile", "taxonomy", "observations", "evidence", "none")
METHODS = ("semantic", "explicit", "deterministic", "jev", "none")
TECHNICAL = ("handler_unavailable", "upstream_error", "interpretation_error", "invalid_plan")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6))


def outcome_tags(rows: DataFrame) -> DataFrame:
    """rows (disposition, reason, stage, intent, method, ...) with five tags of the closed lists: no other value gets through.

    A technical reason is an error whatever was stated; an answer without a reason has reason and stage none.
    """
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c))
    said, why, where = known("disposition", DISPOSITIONS), known("reason", REASONS), known("stage", STAGES)
    clean = F.coalesce((said == "answer") & (F.coalesce(why, F.lit("none")) == "none"), F.lit(False))
    kind = first_reason({"answer": clean, "error": F.coalesce(why.isin(*TECHNICAL), F.lit(False)) | (said.isNull() & why.isNotNull())})
    kind = F.coalesce(kind, said, F.lit("answer"))
    missing = F.when(kind == "answer", "none").otherwise("unknown")
    return rows.withColumns(
        {
            "response_disposition": kind,
            "response_reason": F.when(clean, "none").otherwise(F.coalesce(why, missing)),
            "failure_stage": F.when(clean, "none").otherwise(F.coalesce(where, missing)),
            "selected_intent": F.coalesce(known("intent", INTENTS), F.lit("none")),
            "route_method": F.coalesce(known("method", METHODS), F.lit("none")),
        }
    )


def slot_metrics(cases: DataFrame, by: list[str], slots: list[str]) -> DataFrame:
    """Per group: how well plans meet their gold plans, as they came (raw) and behind the gate.

    cases: want_<slot> and got_<slot> for each slot (arrays or texts), expected_kind, raw_kind, expected (the disposition), raw_executes,
    gated. An execution is right only with the right kind and every slot equal. coverage: right executions of cases to be
    answered; false_execution: executions that are not right or not wanted; lost: gold conditions that the plan lacks.
    """
    same = [F.col(f"want_{s}").eqNullSafe(F.col(f"got_{s}")) for s in slots]
    exact = same[0]
    for s in same[1:]:
        exact = exact & s
    right = F.col("raw_kind").eqNullSafe(F.col("expected_kind")) & exact
    wanted = F.col("expected") == "answer"
    lost = [F.col(f"want_{s}").isNotNull() & F.col(f"got_{s}").isNull() for s in slots]
    c = cases.withColumns({"_right": right, "_wanted": wanted, "_gate": F.col("gated") == "answer", "_lost": F.aggregate(F.array(*[x.cast("int") for x in lost]), F.lit(0), lambda n, x: n + x)})
    n = F.count("*")
    return c.groupBy(*by).agg(
        n.alias("n"),
        _share(F.count_if(F.col("expected_kind").isNotNull() & (F.col("raw_kind") == F.col("expected_kind"))), F.count("expected_kind")).alias("kind_accuracy"),
        _share(F.count_if(F.col("_wanted") & F.col("raw_executes") & F.col("_right")), F.count_if("_wanted")).alias("raw_coverage"),
        _share(F.count_if(F.col("raw_executes") & ~(F.col("_wanted") & F.col("_right"))), n).alias("raw_false_execution"),
        _share(F.count_if(F.col("_wanted") & F.col("_gate") & F.col("_right")), F.count_if("_wanted")).alias("gated_coverage"),
        _share(F.count_if(F.col("_gate") & ~(F.col("_wanted") & F.col("_right"))), n).alias("gated_false_execution"),
        F.sum("_lost").alias("lost_conditions"),
        *[_share(F.count_if(x), n).alias(f"{s}_accuracy") for s, x in zip(slots, same, strict=True)],
    )


def family_evaluation(cases: DataFrame) -> DataFrame:
    """Per family of cases (family, role, status, signature): pass where both equivalents pass with one signature and the one contrast passes with another."""
    equivalent, contrast, ok = F.col("role") == "equivalent", F.col("role") == "contrast", F.col("status") == "pass"
    per = cases.groupBy("family").agg(
        F.count_if(equivalent).alias("equivalents"),
        F.count_if(equivalent & ok).alias("passed"),
        F.count_distinct(F.when(equivalent, F.col("signature"))).alias("signatures"),
        F.min(F.when(equivalent, F.col("signature"))).alias("signature"),
        F.count_if(contrast).alias("contrasts"),
        F.count_if(contrast & ok).alias("contrasts_passed"),
        F.min(F.when(contrast, F.col("signature"))).alias("other"),
    )
    pair = (F.col("equivalents") == 2) & (F.col("passed") == 2) & (F.col("signatures") == 1)
    told = F.coalesce(pair & (F.col("contrasts") == 1) & (F.col("contrasts_passed") == 1) & (F.col("other") != F.col("signature")), F.lit(False))
    return per.select("family", pair.alias("equivalent_pair_exact"), told.alias("contrast_distinguished"), F.when(told, "pass").otherwise("fail").alias("status"))


def package_cases(cases: DataFrame, results: DataFrame, conditions: DataFrame, suites: DataFrame) -> DataFrame:
    """(section, key, n, ok) of a regression set: counts by suite, rank and condition trait, and the assertions that let it be published.

    cases (id, question, suite, rank), results (id, passed), conditions (id, trait), suites (suite, expected). Assertions:
    every case has one result which passed, ids and questions are unique, suites have their expected counts.
    """
    r = results.groupBy("id").agg(F.count("*").alias("results"), F.bool_and("passed").alias("passed"))
    c = cases.join(r, "id", "left")
    total = c.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("question").alias("questions"),
        F.count_if(~F.col("results").eqNullSafe(F.lit(1))).alias("unmatched"),
        F.count_if(F.col("results").isNotNull() & ~F.col("passed")).alias("failed"),
    )
    checks = {"unique_ids": F.col("n") - F.col("ids"), "unique_questions": F.col("n") - F.col("questions"), "one_result_each": F.col("unmatched"), "all_passed": F.col("failed")}
    checks = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("n")) for k, v in checks.items()])).alias("x")).select(F.lit("assertion").alias("section"), "x.key", "x.n", (F.col("x.n") == 0).alias("ok"))
    by_suite = c.groupBy(F.col("suite").alias("key")).agg(F.count("*").alias("n")).join(suites.select(F.col("suite").alias("key"), "expected"), "key", "full")
    by_suite = by_suite.select(F.lit("suite").alias("section"), "key", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").eqNullSafe(F.col("expected")).alias("ok"))
    count = lambda rows, section, key: rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n", F.lit(True).alias("ok"))
    traits = conditions.join(cases.select("id").distinct(), "id", "left_semi")
    return checks.unionByName(by_suite).unionByName(count(c, "rank", "rank")).unionByName(count(traits, "trait", "trait"))


def classification_summary(rows: DataFrame, uncertain: str = "uncertain") -> DataFrame:
    """One row for (expected, predicted): n, accuracy, macro-F1 over the expected labels, and the rates of automatic, wrong and clarified rows."""
    pairs = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    labels = pairs.select(F.col("expected").alias("label"), F.struct(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("want"), F.lit(0).cast("long").alias("got")).alias("x"))
    labels = labels.unionByName(pairs.select(F.col("predicted").alias("label"), F.struct(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("want"), F.col("n").alias("got")).alias("x")))
    per = labels.groupBy("label").agg(F.sum("x.tp").alias("tp"), F.sum("x.want").alias("want"), F.sum("x.got").alias("got")).filter("want > 0")
    macro = per.agg(F.round(F.avg(2 * F.col("tp") / (F.col("want") + F.col("got"))), 6).alias("macro_f1"))
    sure, hit, t = F.col("predicted") != uncertain, F.col("expected") == F.col("predicted"), F.sum("n")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    total = pairs.agg(t.alias("n"), _share(some(hit), t).alias("accuracy"), _share(some(sure), t).alias("automatic_rate"), _share(some(sure & ~hit), t).alias("misclassification_rate"), _share(some(~sure), t).alias("clarification_rate"))
    return total.crossJoin(macro)  # one row each


def name_audit(records: DataFrame, species: DataFrame, reviewed: DataFrame, rejected: DataFrame) -> DataFrame:
    """records (source, scientific_name, name) with the decision that a review of names would take.

    species (taxon, scientific_name), reviewed (taxon, name, source_scientific_name), rejected (scientific_name, name, why).
    """
    target = species.groupBy("scientific_name").agg(F.min("taxon").alias("taxon"))
    own = reviewed.select("taxon", F.col("name").alias("own_name"))
    cross = reviewed.select(F.col("source_scientific_name").alias("scientific_name"), "name").distinct().withColumn("crosswalk", F.lit(True))
    used = reviewed.select("name").distinct().withColumn("used", F.lit(True))
    j = records.filter("scientific_name is not null and name is not null and name <> ''").join(target, "scientific_name", "left").join(own, "taxon", "left")
    j = j.join(cross, ["scientific_name", "name"], "left").join(used, "name", "left").join(rejected.select("scientific_name", "name", "why").distinct(), ["scientific_name", "name"], "left")
    decision = first_reason(
        {
            "reviewed_exact": F.col("own_name") == F.col("name"),
            "reviewed_crosswalk": F.col("crosswalk"),
            "no_exact_active_species": F.col("taxon").isNull(),
            "existing_reviewed_name_preserved": F.col("own_name").isNotNull(),
            "conflicts_with_reviewed_other_species": F.col("used"),
            "previously_reviewed_rejection": F.col("why").isNotNull(),
        }
    )
    return j.select("source", "scientific_name", "name", F.coalesce(decision, F.lit("unreviewed_source_candidate")).alias("decision"), F.col("why").alias("previous_reason"))


def select_points(points: DataFrame, scopes: tuple[str, ...], scope: str | None = None, include_blocked: bool = False) -> DataFrame:
    """Collection points of a scope (None: all) that may be collected, or blocked ones too; an unknown scope is an error."""
    if scope is not None and scope not in scopes:
        raise ValueError(f"unknown scope: {scope}")
    rows = points if scope is None else points.filter(F.col("scope") == scope)
    return rows if include_blocked else rows.filter("collectable")


def answer_contracts(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(q, contract): ok, or what an answer (q, conditions, scope, ok) misses of its case (q, conditions, scope): no_answer, status, scope or
    conditions, which are equal as multisets, in any order."""
    bag = lambda c: F.array_sort(F.transform(c, lambda x: F.to_json(x)))
    a = answers.select("q", F.col("conditions").alias("got"), F.col("scope").alias("got_scope"), "ok")
    j = cases.join(a, "q", "left")
    contract = F.when(F.col("ok").isNull(), "no_answer").when(~F.col("ok"), "status").when(~F.col("got_scope").eqNullSafe(F.col("scope")), "scope").when(bag("got") != bag("conditions"), "conditions").otherwise("ok")
    return j.select("q", contract.alias("contract"))
