"""Per-case context for reports and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import iso_micros
from caselens.operators.aggregates import stats, technique_set
from caselens.operators.describe import with_description
from caselens.operators.filters import any_of
from caselens.operators.ordered import milestones, ranked, sessions, span, top_n
from caselens.schema import severity_rank


def top_anomalies(events: DataFrame, n: int = 30, compat: bool = False) -> DataFrame:
    """Top n flagged events by score; a case without flags gives its most severe ones.

    ``compat`` ranks the fallback by the severity text instead of its level.
    """
    flagged = events.filter("is_anomaly")
    best = top_n(flagged, ["case_id"], [F.desc("anomaly_score"), F.asc("event_id")], n)
    rest = events.join(flagged.select("case_id").distinct(), "case_id", "left_anti")
    level = F.col("severity") if compat else severity_rank(F.col("severity"))
    fallback = top_n(rest, ["case_id"], [level.desc(), F.desc("ts"), F.asc("event_id")], n)
    return best.unionByName(fallback)


def _ranked(order: str, *cols: str) -> Column:
    """Bounded list of structs in rank order."""
    return F.array_sort(F.collect_list(F.struct(order, *cols)))


# Lines that are joined into one piece of a text before the pieces of a case meet.
PIECE = 4096


def _joined(items: Column) -> Column:
    """The items that are not null with commas between; NULL when there is none."""
    return F.when(F.exists(items, lambda x: x.isNotNull()), F.array_join(items, ","))


def _text(rows: DataFrame, line: Callable[[Column], Column], name: str, *cols: str) -> DataFrame:
    """One text per case: a line of every row in the order of ``rank``, with commas between.

    Lines become pieces in many tasks; the task of a case gathers its pieces, so
    it holds the text and not an object for each of its rows.
    """
    lines = rows.select("case_id", "rank", line(F.struct(*cols)).alias("line"))
    pieces = lines.groupBy("case_id", F.floor((F.col("rank") - 1) / PIECE).alias("piece")).agg(_ranked("rank", "line").alias("items"))
    pieces = pieces.select("case_id", "piece", _joined(F.col("items.line")).alias("text"))
    texts = pieces.groupBy("case_id").agg(_ranked("piece", "text").alias("items"))
    return texts.select("case_id", F.array_join("items.text", ",").alias(name))


def bundle(
    events: DataFrame, findings: DataFrame, evidence: DataFrame, cases: DataFrame, hits: DataFrame | None = None,
    n_anomalies: int = 30, n_findings: int | None = None, n_files: int | None = None, n_sessions: int | None = 5,
    lines: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row per case: top anomalies, findings, newest files, techniques, first sessions, hits.

    A list with a number is cut before it is collected; ``files_total`` and
    ``findings_total`` count all. A list in ``lines`` is a text of such lines
    with commas between instead of an array, made for lists of any length.
    """
    lines = lines or {}

    def listed(rows: DataFrame, name: str, *cols: str) -> DataFrame:
        if name in lines:
            return _text(rows, lines[name], name, *cols)
        return rows.groupBy("case_id").agg(_ranked("rank", *cols).alias(name))

    anom = top_anomalies(events, n_anomalies)
    a = listed(anom, "anomalies", "event_id", "severity", "ts", "subject", "action", "object", "anomaly_score", "mitre_techniques")
    found = ranked(findings, ["case_id"], [F.desc("score"), F.asc("correlation_id")], n_findings)
    f = listed(found, "correlations", "rule", "source", "target", "score", "explanation")
    files = ranked(evidence, ["case_id"], [F.desc("created_at"), F.asc("evidence_id")], n_files)
    e = listed(files, "evidence_list", "evidence_id", "filename", "file_type", "status", "size_bytes")
    # an uncut list is written already: its rows are counted there
    whole = ((found if n_findings is None else findings, "findings_total"), (files if n_files is None else evidence, "files_total"))
    totals = [df.groupBy("case_id").agg(F.count("*").alias(c)) for df, c in whole]
    t = technique_set(anom).groupBy("case_id").agg(F.array_sort(F.collect_set("technique_id")).alias("techniques"))
    if "techniques" in lines:
        t = t.withColumn("techniques", F.array_join(F.transform("techniques", lines["techniques"]), ","))
    s = ranked(sessions(events, ["case_id"]), ["case_id"], [F.asc("start_ts")], n_sessions)
    s = listed(s, "sessions", "start_ts", "end_ts", "event_count")
    out = cases
    for part in (*totals, a, t, s, e, f):  # the longest last: its rows go through one join
        out = out.join(part, "case_id", "left")
    if hits is not None:
        h = listed(hits, "semantic_hits", "event_id", "score")
        out = out.join(h, "case_id", "left")
    names = ["anomalies", "correlations", "evidence_list", "techniques", "sessions", "findings_total", "files_total"]
    return out.select(*cases.columns, *names, *(["semantic_hits"] if hits is not None else []))


def report(
    events: DataFrame, findings: DataFrame, evidence: DataFrame, cases: DataFrame,
    n_anomalies: int = 10, n_findings: int = 8, n_milestones: int = 12, n_sessions: int = 5,
) -> DataFrame:
    """Report bundle per case: totals, and the first anomalies, findings, milestones and sessions."""
    totals = stats(events).filter("evidence_id is null").select("case_id", "total", "anomalies", "critical")
    anom = with_description(top_anomalies(events, n_anomalies), report_style=True)
    a = anom.groupBy("case_id").agg(_ranked("rank", "event_id", "severity", "description").alias("top_anomalies"))
    f = top_n(findings, ["case_id"], [F.desc("score"), F.asc("correlation_id")], n_findings)
    f = f.groupBy("case_id").agg(_ranked("rank", "rule", "source", "target", "score").alias("findings"))
    m = with_description(milestones(events, n_milestones), report_style=True)
    m = m.groupBy("case_id").agg(_ranked("rank", "ts", "event_id", "description").alias("timeline"))
    s = top_n(sessions(events, ["case_id"]), ["case_id"], [F.asc("start_ts")], n_sessions)
    s = s.groupBy("case_id").agg(_ranked("rank", "start_ts", "end_ts", "event_count").alias("sessions"))
    e = evidence.groupBy("case_id").agg(F.count("*").alias("files"))
    out = cases.join(totals, "case_id", "left").join(span(events, ["case_id"]).select("case_id", "span_hours"), "case_id", "left")
    for part in (a, f, m, s, e):
        out = out.join(part, "case_id", "left")
    return out


def prompt(bundles: DataFrame, system: str = "", n_anomalies: int = 12, n_findings: int = 10) -> DataFrame:
    """One text brief per case; evidence is fenced as untrusted data.

    Sections without rows are left out. A ``question`` column, if there is one,
    stands last, after the fence.
    """
    def section(title: str, items: Column, line: Callable[[Column, Column], Column]) -> Column:
        body = F.array_join(F.transform(items, lambda x, i: line(x, (i + 1).cast("string"))), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n"), body))

    files = section("Files", F.col("evidence_list"), lambda x, i: F.concat(
        i, F.lit(". "), x.filename, F.lit(", "), x.file_type, F.lit(", "), x.status, F.lit(", "), F.format_string("%.1f KB", F.bround(x.size_bytes / 1024, 1))))
    anomalies = section("Anomalies", F.slice("anomalies", 1, n_anomalies), lambda x, i: F.concat(
        i, F.lit(". "), iso_micros(x.ts), F.lit(" ["), F.upper(x.severity), F.lit("] "), F.concat_ws(" / ", x.subject, x.action, x.object),
        F.when(F.size(x.mitre_techniques) > 0, F.concat(F.lit(" ("), F.array_join(x.mitre_techniques, ", "), F.lit(")"))).otherwise("")))
    found = section("Findings", F.slice("correlations", 1, n_findings), lambda x, i: F.concat(
        i, F.lit(". "), x.rule, F.lit(": "), x.source, F.lit(" -> "), x.target, F.lit(", score "), x.score.cast("string")))
    techs = section("Techniques", F.col("techniques"), lambda x, i: F.concat(F.lit("- "), x))
    hits = section("Similar events", F.col("semantic_hits"), lambda x, i: F.concat(F.lit("- "), x.event_id)) if "semantic_hits" in bundles.columns else F.lit(None)
    about = F.concat(F.lit("About: "), F.when(F.col("description") != "", F.col("description"))) if "description" in bundles.columns else F.lit(None)
    asked = F.concat(F.lit("Question: "), "question") if "question" in bundles.columns else F.lit(None)
    head = F.concat(F.lit("Case "), "case_id", F.lit(": "), "title", F.lit(" ("), "status", F.lit(")"))
    text = F.concat_ws("\n", F.lit(system) if system else F.lit(None), head, about, F.lit("<EVIDENCE>"), files, anomalies, found, hits, techs, F.lit("</EVIDENCE>"), asked)
    return bundles.select("case_id", text.alias("prompt"))


PLAYBOOK = [
    ("process", "Stop the suspicious processes and block the tools that started them."),
    ("credential", "Reset passwords and sessions of the accounts involved."),
    ("isolation", "Take the affected machine off the network."),
    ("telemetry", "Save memory and event logs before anything is changed."),
]
TOOL_WORDS = ["powershell", "cmd", "mimikatz", "certutil"]
CREDENTIAL_WORDS = ["lsass", "mimikatz"]


def playbook(anomalies: DataFrame, findings: DataFrame, techniques: DataFrame) -> DataFrame:
    """Response actions per case from the tools and tactics seen; each side is reduced first."""
    def words(df: DataFrame, col: str) -> DataFrame:
        low = F.lower(F.coalesce(col, F.lit("")))
        return df.select("case_id", any_of([low.contains(w) for w in TOOL_WORDS]).alias("tool"), any_of([low.contains(w) for w in CREDENTIAL_WORDS]).alias("cred"))

    marks = words(findings, "target").unionByName(words(anomalies, "object")).unionByName(
        techniques.select("case_id", F.lit(False).alias("tool"), (F.col("tactic") == "Credential Access").alias("cred")))
    per_case = marks.groupBy("case_id").agg(F.bool_or("tool").alias("tool"), F.bool_or("cred").alias("cred"))
    on = [F.col("tool"), F.col("cred"), F.lit(True), F.lit(True)]
    acts = F.array_compact(F.array(*[F.when(o, F.struct(F.lit(k).alias("kind"), F.lit(t).alias("action"))) for o, (k, t) in zip(on, PLAYBOOK)]))
    return per_case.select("case_id", F.posexplode(acts).alias("pos", "a")).select("case_id", (F.col("pos") + 1).alias("step"), "a.kind", "a.action")


# Process words a question may name, tested in this order.
ENTITY_WORDS = ["powershell", "cmd", "mimikatz", "certutil", "svchost", "lsass", "psexec", "explorer"]


def named_process(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in ENTITY_WORDS])


def entity_hits(questions: DataFrame, findings: DataFrame, anomalies: DataFrame, n: int = 5) -> DataFrame:
    """Top n findings and anomalies that mention the process named in a question (question_id, case_id, question).

    The top n depend on case and word only, so they are taken once per word and
    then joined with the questions: no question meets all rows of its case.
    """
    q = questions.select("question_id", "case_id", named_process(F.col("question")).alias("word")).filter("word is not null")

    def hits(df: DataFrame, kind: str, key: str, score: str, cols: list[str]) -> DataFrame:
        text = F.lower(F.concat_ws("\n", *cols))
        words = F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in ENTITY_WORDS]))
        rows = df.select("case_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(score).cast("double").alias("score"), F.explode(words).alias("word"))
        return top_n(rows, ["case_id", "word"], [F.desc("score"), F.asc("id")], n)

    found = hits(findings, "finding", "correlation_id", "score", ["source", "target"]).unionByName(
        hits(anomalies, "anomaly", "event_id", "anomaly_score", ["subject", "object", "process_name", "command_line"]))
    return q.join(found, ["case_id", "word"]).select("question_id", "kind", "id", "score", "rank")


def citations(evidence: DataFrame, hits: DataFrame, techniques: DataFrame, findings: DataFrame, n_files: int | None = None) -> DataFrame:
    """Sources of an answer per case: its files (all, or the newest ``n_files``), 4 events, 3 techniques, 2 findings."""
    def part(df: DataFrame, kind: str, key: str, order: list, n: int | None) -> DataFrame:
        return ranked(df.select("case_id", F.col(key).alias("source"), *[c for c in df.columns if c in ("score", "created_at") and c != key]),
                     ["case_id"], order, n).select("case_id", F.lit(kind).alias("kind"), "source", "rank")

    return (
        part(evidence, "evidence_file", "filename", [F.desc("created_at"), F.asc("source")], n_files)
        .unionByName(part(hits, "event_log", "event_id", [F.desc("score"), F.asc("source")], 4))
        .unionByName(part(techniques, "mitre_technique", "technique_id", [F.asc("source")], 3))
        .unionByName(part(findings, "graph_correlation", "correlation_id", [F.desc("score"), F.asc("source")], 2))
    )
