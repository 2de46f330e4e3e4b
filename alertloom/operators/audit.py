"""Audit of a report's claims against the current alerts and the retrieved evidence, as columns and joins.

Reports have (report_id, markdown); evidence has (report_id, evidence_strength, labels, tags, overlap_count, actors,
techniques, historical array<string>, dispositions array<struct<type,value,disposition>>); current observations have
(report_id, ips, domains, urls, hashes, techniques, actors, tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import text as T

#: Fixed values.
ACTIONS = {
    "block": r"(?i)\b(?:block|denylist|blacklist|firewall rule|drop traffic)\b",
    "isolate": r"(?i)\b(?:isolate|quarantine|contain)\b",
    "disable": r"(?i)\b(?:disable|deactivate|shut down|turn off)\b",
    "monitor": r"(?i)\b(?:monitor|hunt for|detect|alert on)\b",
}
ATTRIBUTION = r"(?i)\b(?:attributed to|associated with|linked to|ties to|campaign|threat actor|malware family|operator|nation[- ]state)\b"
NOT_ACTIONABLE = ("benign", "analysis_environment", "remediation_reference")
#: Indicators of a type whose containment a claim audit looks at.
AUDITED = 40
EMPTY = "cast(array() as array<string>)"


def action_labels(context: Column) -> Column:
    return F.array_compact(F.array(*[F.when(context.rlike(p), k) for k, p in ACTIONS.items()]))


def remediation_targets(markdown: Column, most: int | None = None) -> Column:
    """array<struct<type, value, actions>>: indicators with an action verb in the same sentence, all or the first `most` of a type."""
    def of(b: Column, kind: str) -> Column:
        said = lambda v: T.let(T.near(b["cut"], v), lambda text: F.array_join(T.contexts(text, v, kind, 120), "\n"))
        return F.transform(b["found"][kind], lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), T.let(said(v), action_labels).alias("actions")))

    both = F.struct(T.artifacts(markdown, most).alias("found"), T.pieces(markdown).alias("cut"))
    every = T.let(both, lambda b: F.concat(*[of(b, k) for k in ("ips", "domains", "urls", "hashes")]))
    return F.filter(every, lambda t: F.size(t["actions"]) > 0)


def support(evidence: DataFrame) -> DataFrame:
    """Per report: what high and medium evidence supports, what only weak evidence holds, and roles of indicators."""
    strong = F.col("evidence_strength").isin("high", "medium")
    gather = lambda c, when: F.array_distinct(F.flatten(F.collect_list(F.when(when, F.col(c)).otherwise(F.expr(EMPTY)))))
    attributed = strong & F.array_contains("labels", "attribution") & (F.col("overlap_count") > 0)
    mapped = strong & (F.array_contains("labels", "ttp_behavior") | F.array_contains("labels", "vulnerability")) & ~F.coalesce("behavior_mismatch", F.lit(False))
    return evidence.groupBy("report_id").agg(
        F.bool_or(strong).alias("any_strong"),
        F.coalesce(F.bool_or(attributed), F.lit(False)).alias("attribution_supported"),
        gather("actors", attributed).alias("supported_actors"),
        gather("techniques", mapped).alias("supported_techniques"),
        gather("historical", F.col("evidence_strength") == "low").alias("weak_only"),
        F.flatten(F.collect_list("dispositions")).alias("dispositions"),
    )


def claim_findings(reports: DataFrame, evidence: DataFrame, current: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(report_id, findings array<struct<kind, values>>): at most eight, in a fixed order.

    Kinds: attribution, actors, unknown_techniques, deprecated_techniques, unsupported_techniques, leaked_artifacts,
    weak_containment, unobserved_targets, non_actionable_targets.
    """
    seen = current.select("report_id", *[F.col(c).alias(f"cur_{c}") for c in ("ips", "domains", "urls", "hashes", "techniques", "actors")])
    r = reports.join(support(evidence), "report_id", "left").join(seen, "report_id", "left")
    none = F.expr(EMPTY)
    cols = {c: F.coalesce(c, none) for c in ("supported_actors", "supported_techniques", "weak_only", "cur_ips", "cur_domains", "cur_urls", "cur_hashes", "cur_techniques", "cur_actors")}
    r = r.withColumns(cols | {"any_strong": F.coalesce("any_strong", F.lit(False)), "attribution_supported": F.coalesce("attribution_supported", F.lit(False))})
    m = F.col("markdown")
    r = r.withColumns({"said_actors": T.actors(m), "said_techniques": T.techniques(m), "targets": remediation_targets(m, AUDITED)})
    if catalogue is not None:
        # the catalogue is joined by id; only the ids that reports mention are looked up
        told = r.select("report_id", F.explode("said_techniques").alias("id"))
        known = told.join(catalogue.select(F.upper("id").alias("id"), F.col("deprecated").cast("boolean").alias("deprecated")).dropDuplicates(["id"]).withColumn("known", F.lit(True)), "id", "left")
        by = known.groupBy("report_id").agg(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("id")))).alias("unknown"), F.array_sort(F.collect_set(F.when(F.col("deprecated"), F.col("id")))).alias("deprecated_ids"))
        r = r.join(by, "report_id", "left")
    else:
        r = r.withColumns({"unknown": none, "deprecated_ids": none})
    upper = lambda a: F.transform(a, F.upper)
    low = lambda a: F.transform(a, F.lower)
    actors = F.array_sort(F.array_except("said_actors", upper(F.concat("supported_actors", "cur_actors"))))
    unsupported = F.array_sort(F.array_except("said_techniques", upper(F.concat("supported_techniques", "cur_techniques"))))
    mentioned = F.filter("weak_only", lambda v: F.array_contains(low(F.flatten(F.array(T.ips(m), T.domains(m), T.urls(m), T.hashes(m)))), F.lower(v)))
    acting = m.rlike("(?i)block|isolate|disable")
    current_all = low(F.concat("cur_ips", "cur_domains", "cur_urls", "cur_hashes"))
    unobserved = F.transform(F.filter("targets", lambda t: ~F.array_contains(current_all, F.lower(t["value"]))), lambda t: F.concat(t["value"], F.lit(" ("), F.array_join(t["actions"], "/"), F.lit(")")))
    roles = F.coalesce("dispositions", F.expr("cast(array() as array<struct<type:string,value:string,disposition:string>>)"))
    role_of = lambda t: F.get(F.filter(roles, lambda d: (d["type"] == t["type"]) & (F.lower(T.refang(d["value"])) == F.lower(T.refang(t["value"])))), F.lit(0))["disposition"]
    judged = F.transform("targets", lambda t: F.struct(t["value"].alias("value"), role_of(t).alias("role"), F.arrays_overlap(t["actions"], F.array(F.lit("block"), F.lit("disable"))).alias("hard")))
    wrong = F.transform(F.filter(judged, lambda j: F.coalesce(j["role"].isin(*NOT_ACTIONABLE) | ((j["role"] == "victim") & j["hard"]), F.lit(False))), lambda j: F.concat_ws("=", j["value"], j["role"]))
    finding = lambda kind, ok, values: F.when(ok, F.struct(F.lit(kind).alias("kind"), F.slice(values, 1, 8).alias("values")))
    some = lambda a: F.size(a) > 0
    found = F.array(
        finding("attribution", (some(F.col("said_actors")) | m.rlike(ATTRIBUTION)) & ~F.col("attribution_supported"), F.col("said_actors")),
        finding("actors", some(actors), actors),
        finding("unknown_techniques", some(F.coalesce("unknown", none)), F.coalesce("unknown", none)),
        finding("deprecated_techniques", some(F.coalesce("deprecated_ids", none)), F.coalesce("deprecated_ids", none)),
        finding("unsupported_techniques", some(unsupported), unsupported),
        finding("leaked_artifacts", some(mentioned), mentioned),
        finding("weak_containment", acting & ~F.col("any_strong"), none),
        finding("unobserved_targets", acting & some(unobserved), unobserved),
        finding("non_actionable_targets", acting & some(wrong), wrong),
    )
    empty = F.coalesce(F.trim(m), F.lit("")) == ""
    findings = F.when(empty, F.expr("cast(array() as array<struct<kind:string,values:array<string>>>)")).otherwise(F.slice(F.array_compact(found), 1, 8))
    return r.select("report_id", findings.alias("findings"))


def context_blocks(docs: DataFrame, order: list[Column]) -> DataFrame:
    """Prompt blocks "[RAG-i]" of annotated documents, numbered in rank order."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.orderBy(*order))
    text = F.concat(F.lit("[RAG-"), n.cast("string"), F.lit("] Source: "), F.col("source"), F.lit(" | Strength: "), F.col("evidence_strength"), F.lit("\n"), F.col("content"))
    return docs.select(n.alias("n"), text.alias("block"))


def retrieval_summary(docs: DataFrame) -> DataFrame:
    """(what, label, n): counts by source, match type, strength and reliability, and rows with cautions."""
    one = lambda what, c: docs.groupBy(F.lit(what).alias("what"), c.cast("string").alias("label")).agg(F.count("*").alias("n"))
    out = one("source", F.col("source")).unionByName(one("strength", F.col("evidence_strength"))).unionByName(one("reliability", F.col("source_reliability")))
    types = docs.select(F.explode("match_types").alias("t")).groupBy(F.lit("match_type").alias("what"), F.col("t").alias("label")).agg(F.count("*").alias("n"))
    warned = docs.filter(F.size("retrieval_cautions") > 0).groupBy(F.lit("cautions").alias("what"), F.lit("any").alias("label")).agg(F.count("*").alias("n"))
    return out.unionByName(types).unionByName(warned)
