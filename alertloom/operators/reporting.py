"""From current alerts to a report: observed indicators, search terms and queries, annotated context, the mode of a
report and the text handed to an injected generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import text as T
from alertloom.operators import alerts as A
from alertloom.operators import analytics as N
from alertloom.operators import audit
from alertloom.operators import reports
from alertloom.operators import search as S

#: Observed kind -> the columns and context fields of a cleaned alert that hold it.
OBSERVED = {
    "ips": ("src_ip", "dest_ip", "agent_ip", "ioc_context.ip"),
    "domains": ("http_context.hostname", "dns_context.query", "tls_context.sni", "email_context.mail_from_domain", "ioc_context.domain"),
    "urls": ("http_context.url", "email_context.url", "ioc_context.url"),
    "hashes": ("ioc_context.hash", "file_context.md5", "file_context.sha1", "file_context.sha256"),
    "rule_ids": ("rule_id",),
    "signature_ids": ("signature_id",),
    "alert_signatures": ("alert_signature",),
    "mitre_techniques": ("mitre_context.id", "mitre_context.technique"),
    "threat_actors": ("threat_context.actor",),
}
#: Fields that are text of the alert for tags, queries and the embedded text.
TEXT = ("rule_description", "alert_signature", "alert_category", "proto", "app_proto", "event_type", "direction")
#: Fields of contexts whose tokens are search terms.
TERM_CONTEXTS = {
    "http": ("hostname", "url", "method"),
    "dns": ("query",),
    "tls": ("sni", "issuer", "subject"),
    "email": ("from", "to", "subject", "attachment", "mail_from_domain", "url"),
    "ioc": ("domain", "ip", "url", "hash"),
    "process": ("name", "parent_process", "file", "path", "command_line"),
    "file": ("filename", "md5", "sha1", "sha256"),
    "smb": ("command", "share", "filename", "disposition"),
    "modbus": ("function", "unit_id", "address", "quantity"),
    "threat": ("actor", "campaign"),
}
DEFAULT_QUERY = "network security alert threat intelligence"


def _there(alerts: DataFrame, path: str) -> Column | None:
    head, _, field = path.partition(".")
    if head not in alerts.columns:
        return None
    if field and field not in alerts.schema[head].dataType.names:
        return None
    return F.col(path).cast("string")


def _given(alerts: DataFrame, kind: str) -> Column | None:
    """What the columns of a kind hold, as it stands; None without such a column."""
    cols = [c for c in (_there(alerts, p) for p in OBSERVED[kind]) if c is not None]
    return F.array_compact(F.array(*cols)) if cols else None


def _values(alerts: DataFrame, kind: str) -> Column:
    given = _given(alerts, kind)
    return F.expr("cast(array() as array<string>)") if given is None else T.unique(given)


def observed(alerts: DataFrame) -> Column:
    """Indicators of one alert by kind, each once."""
    return F.struct(*[_values(alerts, k).alias(k) for k in OBSERVED])


def current_artifacts(alerts: DataFrame, cap: int = 50, order: str = "event_id") -> DataFrame:
    """One row: what all current alerts observed, by kind, first seen first, at most `cap` shown of each."""
    given = {k: v for k in OBSERVED if (v := _given(alerts, k)) is not None}
    seen = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("given")) for k, v in (given or {"ips": F.expr("cast(array() as array<string>)")}).items()])
    # alerts alike are one row before their values are taken apart; a minimum of numbers is hashed, one of structs would be sorted
    earliest = F.when(~F.bool_or(F.col("at").isNull()), F.min("at")).alias("at")
    rows = alerts.select(F.col(order).alias("at"), F.inline(seen)).filter(F.size("given") > 0).groupBy("kind", "given").agg(earliest)
    rows = rows.select("at", "kind", F.posexplode(T.unique(F.col("given"))).alias("p", "value")).groupBy("kind", "p", "value").agg(earliest)
    first = F.min(F.struct("at", "p", "value"))
    rows = rows.groupBy("kind", F.lower("value").alias("key")).agg(first.alias("first"))
    w = W.partitionBy("kind").orderBy("first.at", "first.p", "key")
    rows = rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= cap).select("kind", "i", "first.value")
    return rows.agg(*[F.coalesce(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("i", "value")))), lambda s: s["value"]), F.expr("cast(array() as array<string>)")).alias(k) for k in OBSERVED])


def exact_terms(alerts: DataFrame, representatives: int = 12, order: str = "event_id") -> DataFrame:
    """(type, term) of the representative alerts' indicators."""
    rows = A.representatives(alerts, representatives, order)
    typed = F.flatten(F.array(*[F.transform(_values(rows, k), _pair(k)) for k in OBSERVED]))
    return rows.select(F.explode(typed).alias("t")).select("t.type", "t.term").distinct()


def _pair(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("term"))


def query_text(alerts: DataFrame) -> Column:
    """The words one alert is searched by: its text fields and indicators."""
    plain = [F.nullif(c, F.lit("")) for c in (_there(alerts, p) for p in TEXT) if c is not None]
    return F.concat_ws(" ", *plain, *[F.array_join(_values(alerts, k), " ") for k in ("domains", "urls", "hashes", "ips")])


def focused_queries(alerts: DataFrame, representatives: int = 12, most: int = 5, order: str = "event_id") -> DataFrame:
    """(query_id, query): one query over all representatives and one for each, distinct by folded text, at most `most`."""
    rows = A.representatives(alerts, representatives, order)
    rows = rows.withColumn("q", query_text(rows)).withColumn("i", F.row_number().over(W.orderBy(F.desc("rule_level"), F.desc("ts"), order)))  # at most `representatives` rows
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]), " ").alias("q")).select(F.lit(0).alias("i"), "q")
    every = whole.unionByName(rows.select("i", "q")).filter(F.trim("q") != "")
    key = F.lower(F.regexp_replace(F.trim("q"), r"\s+", " "))
    first = every.groupBy(key.alias("k")).agg(F.min_by("q", "i").alias("query"), F.min("i").alias("i"))
    out = first.withColumn("n", F.row_number().over(W.orderBy("i"))).filter(F.col("n") <= most).select((F.col("n") - 1).cast("long").alias("query_id"), T.normalise(F.col("query"), 4000).alias("query"))
    none = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(DEFAULT_QUERY).alias("query"))
    return out.unionByName(none.join(out.limit(1), how="left_anti"))


def alert_text(alerts: DataFrame) -> Column:
    """Labelled parts of an alert in a fixed order, the log cut at 500 characters: what is embedded."""
    parts = {"Rule": "rule_description", "Rule ID": "rule_id", "Signature": "alert_signature", "Category": "alert_category", "Source": "src_ip", "Destination": "dest_ip", "Port": "dest_port", "Protocol": "proto", "Service": "app_proto"}
    cols = {k: _there(alerts, p) for k, p in parts.items()}
    cols |= {k.replace("_", " ").title(): F.array_join(_values(alerts, k), ", ") for k in ("domains", "urls", "hashes", "mitre_techniques")}
    if "full_log" in alerts.columns:
        cols["Log"] = F.left("full_log", F.lit(500))
    return A.labelled({k: c for k, c in cols.items() if c is not None})


def compact(alerts: DataFrame) -> Column:
    """An alert as one short JSON line of its non-null fields, for a prompt."""
    cut = {"rule_description": 80, "alert_signature": 60, "timestamp": 19}
    keep = [c for c in ("timestamp", "rule_level", "rule_id", "rule_description", "alert_signature", "src_ip", "src_ip_context", "dest_ip", "dest_ip_context", "dest_port", "proto", "app_proto") if c in alerts.columns]
    return F.to_json(F.struct(*[(F.left(c, F.lit(cut[c])) if c in cut else F.col(c)).alias(c) for c in keep]))


def selected(alerts: DataFrame, ids: DataFrame, key: str = "uuid", order: str = "event_id") -> DataFrame:
    """Alerts of the chosen ids; of alerts with the same id the last one counts."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    last = alerts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return last.join(ids.select(key).distinct(), key, "left_semi")


def alert_terms(alerts: DataFrame, representatives: int = 12, order: str = "event_id") -> DataFrame:
    """One row (terms): the lower-case tokens of the representative alerts' fields and contexts."""
    rows = A.representatives(alerts, representatives, order)
    fields = [*TEXT, "rule_id", "signature_id", "src_ip", "dest_ip"]
    parts = [c for c in (_there(rows, p) for p in fields) if c is not None]
    for name, kept in TERM_CONTEXTS.items():
        parts += [c for c in (_there(rows, f"{name}_context.{f}") for f in kept) if c is not None]
    return rows.select(F.explode(T.tokens(F.concat_ws(" ", *parts))).alias("t")).agg(F.array_sort(F.collect_set("t")).alias("terms"))


def annotate(docs: DataFrame, current: DataFrame, tags: list[str], terms: DataFrame | None = None) -> DataFrame:
    """Candidates (source, content, score, match_types, match_evidence, severity, human_validated) with their rank and evidence.

    current: one row of current_artifacts(). terms: one row of alert_terms(), sought in the content and, if a column, the
    metadata; without it the current artifacts are the terms.
    """
    kinds = ("ips", "domains", "urls", "hashes", "mitre_techniques")
    now = current.select(F.struct(*[F.col(k) for k in kinds]).alias("__now"))
    d = docs.join(F.broadcast(now))  # one row, each list capped
    found = T.artifacts(F.concat_ws("\n", "content", T.refang(F.col("content"))))
    d = d.withColumns({"__a": found, "labels": T.context_labels(F.col("content")), "tags": T.behavior_tags(F.col("content"))})
    over = F.concat(*[S.overlap(F.col(f"__now.{k}"), F.col(f"__a.{k}")) for k in kinds])
    old = F.concat(*[S.historical_only(F.col(f"__now.{k}"), F.col(f"__a.{k}")) for k in kinds])
    now_tags = F.array(*[F.lit(t) for t in tags]) if tags else F.expr("cast(array() as array<string>)")
    roles = F.flatten(F.array(*[F.transform(S.overlap(F.col(f"__now.{k}"), F.col(f"__a.{k}")), _role(k)) for k in ("ips", "domains", "urls", "hashes")]))
    d = d.withColumns({"overlap": over, "historical_only": old, "behavior_overlap": F.array_intersect("tags", now_tags), "roles": roles})
    mismatch = F.lit(bool(tags)) & (F.size("tags") > 0) & (F.size("behavior_overlap") == 0)
    d = d.withColumn("behavior_mismatch", mismatch)
    n = F.size("overlap")
    other = F.exists("roles", lambda r: r.isin("victim", "analysis_environment", "benign"))
    strength = S.evidence_strength(F.col("match_types"), n, F.array_contains("roles", "malicious"), other)
    if terms is None:
        hits = F.size(F.array_intersect(T.tokens(F.col("content")), F.transform(F.concat(*[F.col(f"__now.{k}") for k in kinds]), F.lower)))
    else:
        d = d.join(F.broadcast(terms.select(F.col("terms").alias("__terms"))))  # one row
        within = F.concat_ws(" ", "content", "metadata") if "metadata" in docs.columns else F.col("content")
        hits = F.size(F.filter("__terms", lambda t: T.contains_term(within, t, "")))
    d = d.withColumn("lexical_hits", hits)
    score = S.context_score(F.col("match_types"), F.col("lexical_hits"), F.col("score"), F.size("match_evidence"), F.coalesce("severity", F.lit(0)), F.col("source"), F.size("behavior_overlap"), F.col("behavior_mismatch"))
    d = d.withColumns({"evidence_strength": strength, "source_reliability": S.reliability(F.col("source"), F.col("human_validated")), "context_score": score, "context_rank_score": F.round(score, 3)})
    quality = T.extraction_quality(F.col("content"), F.lit(0))
    notes = S.cautions(F.col("source"), F.col("match_types"), n, F.col("labels"), other, F.col("behavior_mismatch"), quality["quality"], quality["warnings"], F.col("evidence_strength"))
    return d.withColumn("retrieval_cautions", notes).drop("__now", "__a", "__terms")


def _role(kind: str):
    return lambda v: T.disposition(F.col("content"), v, kind)


def context(corpora: list[DataFrame], alerts: DataFrame, vectors: Callable[[DataFrame], DataFrame], limit: int, tags: list[str] | None = None, order: str = "event_id") -> DataFrame:
    """Retrieval of a report: focused queries, hybrid search at twice the limit, one list, annotation, evidence cap.

    vectors: adds a `vector` column to (query_id, query).
    """
    return S.quality_cap(retrieved(corpora, alerts, vectors, limit, tags, order), limit, context_order())


def context_order() -> list[Column]:
    """Best first: the rank before rounding, then hits, similarity and a fixed order."""
    return [F.desc("context_score"), F.desc("lexical_hits"), F.desc("score"), F.asc("source"), F.asc("id")]


def retrieved(corpora: list[DataFrame], alerts: DataFrame, vectors: Callable[[DataFrame], DataFrame], limit: int, tags: list[str] | None = None, order: str = "event_id") -> DataFrame:
    """The best `limit` rows for the alerts, annotated, before weak evidence is capped."""
    few = _once(A.representatives(alerts, order=order))  # at most 12 alerts, which are their own representatives
    queries = vectors(focused_queries(few, order=order))
    terms = exact_terms(few, order=order).agg(F.collect_list(F.struct("type", "term")).alias("terms"))
    queries = queries.join(F.broadcast(terms))
    found = _once(S.merge_queries(S.hybrid_search(corpora, queries, 2 * limit)))  # twice the limit for each of at most 5 queries
    ranked = annotate(stored(found, corpora), current_artifacts(alerts, order=order), tags or [], alert_terms(few, order=order))
    return ranked.orderBy(*context_order()).limit(limit)


def _once(rows: DataFrame) -> DataFrame:
    """A bounded few rows as a local relation: what they come from runs once, however often they are used."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def urgent_context(documents: DataFrame, archive: DataFrame, alerts: DataFrame, vectors: Callable[[DataFrame], DataFrame], threshold: int = 8, limit: int = 4, tags: list[str] | None = None, order: str = "event_id") -> DataFrame:
    """Retrieval of an urgent report: `limit` rows of each corpus for the alerts at the threshold, the archive's own severity at
    the threshold too, ranked together and cut to `limit`, weak evidence capped. Without any row, documents by keyword."""
    severe = alerts.filter(F.col("rule_level") >= threshold)
    sides = (documents, S.metadata_filter(archive, min_severity=threshold))
    both = [retrieved([c], severe, vectors, limit, tags, order) for c in sides]
    ranked = S.quality_cap(both[0].unionByName(both[1]).orderBy(*context_order()).limit(limit), limit, context_order())
    rows = ranked.collect()  # `limit` rows of one report; the plan is long, so it runs once
    if rows:
        return ranked.sparkSession.createDataFrame(rows, ranked.schema)
    words = [t for r in alert_terms(severe, order=order).collect() for t in r.terms or ()]  # one row
    spare = S.keyword_fallback(documents, " ".join(words) or DEFAULT_QUERY, limit)
    return ranked.unionByName(spare.select(*[c for c in ranked.columns if c in spare.columns]), allowMissingColumns=True)


def stored(found: DataFrame, corpora: list[DataFrame]) -> DataFrame:
    """Retrieved rows, a top-k of each query, with what their corpus stores of them: severity, human_validated and metadata."""
    key, kept = ("source", "id", "content_hash"), {"severity": "int", "human_validated": "boolean", "metadata": "string"}
    rows = None
    for corpus in corpora:
        have = [F.col(c).cast(t).alias(c) if c in corpus.columns else F.lit(None).cast(t).alias(c) for c, t in kept.items()]
        near = corpus.join(F.broadcast(found.select("source", "id").distinct()), ["source", "id"], "left_semi")
        part = near.select("source", "id", F.sha2("content", 256).alias("content_hash"), *have)
        rows = part if rows is None else rows.unionByName(part)
    # the corpora are filtered by the few retrieved rows before anything is hashed or grouped
    rows = rows.join(F.broadcast(found.select(*key).distinct()), list(key), "left_semi")
    best = rows.groupBy(*key).agg(F.max("severity").alias("severity"), F.bool_or("human_validated").alias("human_validated"), F.max("metadata").alias("metadata"))
    return found.join(best, list(key), "left").withColumns({"severity": F.coalesce("severity", F.lit(0)), "human_validated": F.coalesce("human_validated", F.lit(False))})


def report_mode(alerts: DataFrame, automatic: bool, threshold: int = 8) -> str:
    """"urgent" for an automatic report with a level at the threshold, else "standard"."""
    top = alerts.agg(F.max("rule_level")).first()[0] or 0
    return "urgent" if automatic and top >= threshold else "standard"


def write_report(alerts: DataFrame, docs: DataFrame, generate: Callable[[str], str], most_tokens: int = 16384) -> str:
    """The report text of an injected generator; a failing generator gives an error report.

    The prompt is one page of text: counters, representatives and context blocks, all bounded, so it goes to the driver.
    """
    totals = N.counters(alerts).first().asDict()
    lines = [r[0] for r in A.representatives(alerts).select(compact(alerts)).collect()]
    blocks = [r.block for r in audit.context_blocks(docs, [F.desc("context_rank_score"), F.asc("id")]).orderBy("n").limit(20).collect()]
    prompt = "\n".join([str(totals), *lines, *blocks])
    fitted = alerts.sparkSession.range(1).select(reports.fit_prompt(F.lit(prompt), most_tokens)).first()[0]
    try:
        return generate(fitted)
    except Exception as e:  # a report that says so is wanted, not a crash
        return f"# Report generation failed\n\n{type(e).__name__}: {e}\n"


def chat_prompt(message: str, template: str = "", runtime_renders: bool = True) -> str:
    """The message as the generator's input: through its Jinja chat template where the runtime does not render that itself.

    Without a template, without the template library or with a template that fails, the message stays as it is.
    """
    if runtime_renders or not template:
        return message
    try:
        from jinja2 import Template

        return Template(template).render(messages=[{"role": "user", "content": message}], add_generation_prompt=True)
    except Exception:  # a broken template must not keep a report from being written
        return message


def report_name(kind: str, stamp: str, critical: bool = False, batch: int | None = None) -> str:
    """File name of an automatic, approved, visual or manual report."""
    if kind == "automatic":
        return f"AUTO_{'CRITICAL' if critical else 'HIGH'}{f'_BATCH{batch}' if batch else ''}_{stamp}.md"
    return f"{kind.upper()}_{stamp}.md"


def visual_summary(alerts: DataFrame) -> DataFrame:
    """(section, label, n): severity, direction and top sources of a chart report; the timeline counts above five points."""
    one = lambda s, df, c: df.select(F.lit(s).alias("section"), F.col(c).cast("string").alias("label"), "n")
    out = one("severity", N.breakdown(alerts, "severity", "severity"), "severity")
    out = out.unionByName(one("direction", N.breakdown(alerts, "threat_direction", "d"), "d"))
    out = out.unionByName(one("source", N.top_values(alerts, "src_ip", ~F.col("is_infrastructure_alert"), 5), "src_ip"))
    points = N.timeline(alerts).agg(F.count("*").alias("n")).filter("n > 5").withColumn("label", F.lit("points"))
    return out.unionByName(one("timeline", points, "label"))


#: Chart datasets that can be asked for.
CHARTS = ("external_sources", "countries", "directions", "protocols", "severity_timeline")
