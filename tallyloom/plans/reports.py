"""Reports as JSON envelopes and Markdown, over small aggregates that are collected here and nowhere else."""

from __future__ import annotations

import datetime as dt
import html
import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions import display
from tallyloom.functions.redact import PATTERNS
from tallyloom.operators import calendar, cost, evidence, rules, scoring
from tallyloom.operators.metrics import tool_tally

#: Lines of evidence that a report lists for a rule; the number of others is stated.
EVIDENCE_LISTED = 20


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def envelope(command: str, data: dict, now: dt.datetime, window: str | None = None, provenance: dict | None = None) -> dict:
    """The form that every JSON document has."""
    return {
        "schema_version": 1,
        "command": command,
        "generated_at": now.isoformat(),
        "window": window,
        "rule_pack": {"digest": scoring.pack_digest(), "formula": C.FORMULA, "redaction": C.REDACTION_REVISION, "prices": C.PRICE_REVISION},
        "provenance": provenance or {},
        "data": data,
    }


def to_json(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=False, default=str)


def report(metrics: DataFrame, now: dt.datetime, window: str, marathon_ms: int = C.MARATHON_SITTING_MS, tally: DataFrame | None = None) -> dict:
    """The coaching report of metrics with a side column; with the tool tally of the same events also the evidence."""
    m = metrics.filter("side = 'reported'")
    before = metrics.filter("side = 'comparison'")
    scores, then = scoring.lane_scores(m, marathon_ms=marathon_ms), scoring.lane_scores(before, marathon_ms=marathon_ms)
    data = {
        "totals": _rows(calendar.totals(m))[0],
        "agents": _rows(calendar.agents(m).orderBy("source_agent")),
        "cadence": _rows(calendar.cadence(m))[0],
        "findings": _rows(rules.findings(m, marathon_ms)),
        "lanes": _rows(scores.orderBy("lane", "source_agent")),
        "fleet": _rows(scoring.fleet_trend(scores, then).orderBy("lane")),
        "unplaceable": metrics.filter("side = 'unplaceable'").count(),
    }
    order = {key: k for k, (key, _) in enumerate(C.RULES)}
    data["findings"].sort(key=lambda f: order[f["rule"]])
    data["stated"] = _rows(rules.stated(m, marathon_ms).orderBy("place"))
    if tally is not None:
        shown = rules.evidence(m, tally, marathon_ms).withColumn("nth", F.row_number().over(Window.partitionBy("rule").orderBy("session_id")))
        data["evidence"] = _rows(shown.filter(F.col("nth") <= EVIDENCE_LISTED).orderBy("rule", "nth").drop("nth"))
    return envelope("report", data, now, window)


def report_markdown(document: dict) -> str:
    d = document["data"]
    t, c = d["totals"], d["cadence"]
    out = [f"# Sessions, last {document['window']}", "", f"{t['sessions']} sessions, {t['user_requests']} requests, {t['tool_activities']} tool activities.", ""]
    out += [f"- tool error rate: {display.percent(t['error_rate'])} of {t['attempts']}", f"- median active time: {display.span(c['median_active_ms'])}, longest {display.span(c['longest_active_ms'])}"]
    out += [f"- busiest day: {c['busiest_day'] or '—'}", "", "## Lanes", "", "| Lane | Fleet | Before | Trend |", "| --- | ---: | ---: | --- |"]
    titles = {k: title for k, title, _ in C.LANES}
    arrows = {"up": "↑", "down": "↓", "flat": "→", None: ""}
    out += [f"| {titles[f['lane']]} | {'—' if f['score'] is None else f['score']} | {'—' if f['before'] is None else f['before']} | {arrows[f['direction']]} |" for f in d["fleet"]]
    out += ["", "## Findings", ""]
    names = dict(C.RULES)
    out += [f"- **{names[f['rule']]}**: {f['fired']} of {f['eligible']} sessions" for f in d["findings"] if f["fired"]] or ["Nothing fired."]
    for s in d.get("stated", []):
        out += ["", f"### {s['title']}", "", s["problem"], "", s["action"], ""]
        lines = [e for e in d.get("evidence", []) if e["rule"] == s["rule"]]
        fired = next(f["fired"] for f in d["findings"] if f["rule"] == s["rule"])
        out += [f"- `{e['session_id'][:12]}` {e['detail']}" for e in lines] + ([f"- {fired - len(lines)} more"] if lines and fired > len(lines) else [])
    return "\n".join([*out, "", f"Rule pack `{document['rule_pack']['digest'][:12]}`.", ""])


def cost_report(lines: DataFrame, prices: DataFrame, now: dt.datetime, window: str) -> dict:
    t = _rows(cost.cost_totals(lines))
    best = lambda by: sorted((r for r in t if r["by"] == by), key=lambda r: (-r["dollars"], r["label"] is not None, r["label"] or ""))
    premium = cost.premium_sessions(lines, prices)
    data = {
        "all": next((r for r in t if r["by"] == "all" and r["dollars"] is not None), None),
        "by_model": best("model"),
        "by_repository": best("repository"),
        "unpriced": _rows(cost.unpriced(lines).orderBy("state", "model")),
        "premium": _rows(premium.orderBy(F.desc("dollars"), "session_id").limit(C.PREMIUM_LISTED)),
        "premium_found": premium.count(),
    }
    return envelope("cost", data, now, window)


def cost_markdown(document: dict) -> str:
    d = document["data"]
    out = [f"# Cost, last {document['window']}", "", f"List price: {display.dollars(d['all'] and d['all']['dollars'])}", "", "| Model | Output | Dollars |", "| --- | ---: | ---: |"]
    out += [f"| {r['label']} | {display.tokens(r['output'])} | {display.dollars(r['dollars'])} |" for r in d["by_model"]]
    hidden = d["premium_found"] - len(d["premium"])
    out += ["", f"{d['premium_found']} small sessions were billed wholly at the day's top tier." + (f" {hidden} more aren't listed." if hidden > 0 else "")]
    return "\n".join([*out, ""])


def dashboard(windows: dict[str, DataFrame], metrics: DataFrame, now: dt.datetime, marathon_ms: int = C.MARATHON_SITTING_MS, events: DataFrame | None = None, lines: DataFrame | None = None, prices: DataFrame | None = None, summaries: DataFrame | None = None) -> dict:
    """One payload: the report of each window, scopes with their findings, timeline, heatmap, devices and where they land.

    With events also evidence and the anchors that may be served, with priced lines and prices the costs, with summaries
    the standup.
    """
    tally = None if events is None else tool_tally(events)
    tags = metrics.select("session_id", F.col("repository").alias("scope"), "source_agent")
    fired = rules.verdicts(metrics, marathon_ms, ("session_id",)).filter("fired")
    data = {
        "windows": {w: report(m, now, w, marathon_ms, tally)["data"] for w, m in windows.items()},
        "scopes": {w: {label: _rows(calendar.scopes(m.filter("side <> 'unplaceable'"), label, marathon_ms).orderBy(F.col("label").isNull(), F.desc("sessions"), "label", "side", "lane")) for label in ("repository", "hostname")} for w, m in windows.items()},
        "scope_findings": _rows(rules.findings_by_scope(fired, tags).orderBy("rule", F.col("scope").isNull(), "scope", "source_agent")),
        "landing": _rows(calendar.landing(metrics, metrics.filter("hostname is not null").select("hostname").distinct()).orderBy("day", "hostname")),
        "timeline": _rows(calendar.timeline(metrics).orderBy("day", "source_agent")),
        "heatmap": _rows(calendar.heatmap(metrics).orderBy("weekday", "hour", "source_agent", "state")),
        "devices": _rows(calendar.devices(metrics, F.lit(now)).orderBy("hostname")),
    }
    if events is not None:
        anchors = evidence.index(evidence.any_failures(evidence.failures(events)), evidence.busiest_runs(events))
        data["anchors"] = _rows(anchors.groupBy("session_id").agg(F.sort_array(F.collect_list("locator")).alias("locators")).orderBy("session_id"))  # two findings' MAX_ANCHORS a session
    if lines is not None and prices is not None:
        data["cost"] = cost_report(lines, prices, now, "all")["data"]
    if summaries is not None:
        data["standup"] = standup_report(summaries, now, "all")["data"]
    return envelope("dashboard", data, now, provenance={"sessions": metrics.count(), "sections": sorted(data)})


def catalogue() -> str:
    """Rules, lanes, prices and weights as Markdown, from the constants the engine reads."""
    out = ["# What is looked for", "", f"Rule pack `{scoring.pack_digest()}`, formula `{C.FORMULA}`.", "", "## Rules", ""]
    out += [f"{k}. {title} — `{key}`: {C.ADVICE[key][0].format(fired='n', sessions='m')} {C.ADVICE[key][1]}" for k, (key, title) in enumerate(C.RULES, 1)]
    out += ["", "## Lanes", "", "| Lane | Reads |", "| --- | --- |"]
    out += [f"| {title} | {', '.join(f'`{s}`' for s in signals)} |" for _, title, signals in C.LANES]
    out += ["", "## Values", "", "| Name | Value |", "| --- | --- |"]
    out += [f"| `{k}` | `{v}` |" for k, v in scoring.pack_entries() if k.startswith(("threshold", "scoring"))]
    out += ["", "## Prices", "", "| Model | From | Input | Output | Cache read |", "| --- | --- | ---: | ---: | ---: |"]
    out += [f"| `{p.model}` | {p.effective_from} | {display.dollars(p.rates.input)} | {display.dollars(p.rates.output)} | {display.dollars(p.rates.cache_read)} |" for p in C.PRICES]
    out += ["", "## Redaction", "", f"Patterns of {C.REDACTION_REVISION}: " + ", ".join(f"`{x}`" for x in PATTERNS) + "."]
    out += ["", "## Search", "", "| Field | Weight | Quotable |", "| --- | ---: | --- |"]
    out += [f"| {n} | {w} | {'yes' if q else 'no'} |" for n, w, q in C.ASK_FIELDS]
    return "\n".join([*out, ""])


def catalogue_html() -> str:
    """The catalogue as one HTML page: headings, tables, lists and paragraphs of its Markdown."""
    out, table = [], []

    def code(text: str) -> str:
        return re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(text, quote=False))

    for line in [*catalogue().split("\n"), ""]:
        if line.startswith("|"):
            cells = [c.strip() for c in line.strip("|").split("|")]
            if set("".join(cells)) - set("-: "):
                tag = "td" if table else "th"
                table.append("<tr>" + "".join(f"<{tag}>{code(c)}</{tag}>" for c in cells) + "</tr>")
            continue
        if table:
            out.append("<table>" + "".join(table) + "</table>")
            table = []
        if m := re.match(r"(#+) (.*)", line):
            out.append(f"<h{len(m[1])}>{code(m[2])}</h{len(m[1])}>")
        elif line:
            out.append(f"<p>{code(line)}</p>")
    return "<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>What is looked for</title></head><body>" + "".join(out) + "</body></html>"


def ask_report(summaries: DataFrame, question: str, now: dt.datetime, limit: int = C.DEFAULT_ASK_LIMIT) -> dict:
    """Ranked summaries, scored on the raw text; snippets are scrubbed whole, then cut."""
    from tallyloom.functions.text import query_terms
    from tallyloom.operators.summaries import ask

    hits = _rows(ask(summaries, question, limit).orderBy("place")) if query_terms(question) else []
    return envelope("ask", {"question": question, "terms": query_terms(question), "total_matches": hits[0]["total_matches"] if hits else 0, "hits": hits}, now)


def ask_markdown(document: dict) -> str:
    d = document["data"]
    if not d["hits"]:
        return f"# {d['question']}\n\nNothing matched.\n"
    out = [f"# {d['question']}", "", f"{len(d['hits'])} of {d['total_matches']} matches.", ""]
    return "\n".join([*out, *(f"{h['place']}. `{h['source_hash'][:12]}` ({h['score']}) {h['snippet'] or ''}" for h in d["hits"]), ""])


def standup_report(summaries: DataFrame, now: dt.datetime, window: str) -> dict:
    """Repositories with all their sessions, newest first, and the distinct decisions and open items, scrubbed."""
    from tallyloom.functions.redact import scrub
    from tallyloom.operators import summaries as S

    repositories = _rows(S.standup_repositories(summaries))
    sessions = _rows(S.standup_sessions(summaries).select("repository", "place", "source_hash", "title", "goal").orderBy("repository", "place"))
    rolled = {f: _rows(S.roll_up(summaries, f).orderBy("repository", "place", "at").select("repository", "text")) for f in ("decisions", "open_items")}
    for row in [*sessions, *rolled["decisions"], *rolled["open_items"]]:
        for k in ("title", "goal", "text"):
            if k in row:
                row[k] = scrub(row[k])[0]
    return envelope("standup", {"repositories": repositories, "sessions": sessions, **rolled, "gaps": _rows(S.standup_gaps(summaries))}, now, window)


def standup_markdown(document: dict) -> str:
    d = document["data"]
    out = [f"# Work of the last {document['window']}", ""]
    for r in d["repositories"]:
        own = lambda rows, r=r: [x for x in rows if x["repository"] == r["repository"]]
        out += [f"## {r['repository'] or 'Without a repository'} ({r['sessions']})", ""]
        out += [f"- {s['title'] or '—'}: {s['goal'] or '—'}" for s in own(d["sessions"])]
        for name, title in (("decisions", "Decisions"), ("open_items", "Open items")):
            if own(d[name]):
                out += ["", f"### {title}", "", *(f"- {x['text']}" for x in own(d[name]))]
        out.append("")
    return "\n".join(out)


def repetition_report(command: str, found: DataFrame, flows_found: DataFrame | None, read: DataFrame, now: dt.datetime, most: int = 20, friction: DataFrame | None = None, unexamined: DataFrame | None = None, instances: DataFrame | None = None) -> dict:
    """doctor (clusters of each repository, friction, what wasn't examined) or flows (pooled clusters, sequences and where they begin): what is shown is scrubbed."""
    from tallyloom.functions.redact import scrub
    from tallyloom.operators.repetition import ranked

    clusters = _rows(ranked(found, most).orderBy("pool", "place"))
    for c in clusters:
        c["representative"] = scrub(c["representative"])[0]
    steps = {c["cluster"]: c["representative"] for c in clusters}
    order = [F.desc("occurrences"), F.desc("conversations"), F.desc("width"), "steps"]
    sequences = _rows(flows_found.orderBy(*order).limit(most)) if flows_found is not None else []
    for s in sequences:
        s["wording"] = [steps.get(x) for x in s["steps"]]
    data = {"clusters": clusters, "flows": sequences, "read": _rows(read)}
    if friction is not None:
        data["friction"] = _rows(friction.orderBy("place"))
    if unexamined is not None:
        data["unexamined"] = _rows(unexamined.orderBy("place"))
    if instances is not None:
        begins = _rows(instances.orderBy("nth"))
        for s in sequences:
            s["instances"] = [{k: i[k] for k in ("session_id", "locator", "ts")} for i in begins if i["pool"] == s["pool"] and i["steps"] == s["steps"]]
    return envelope(command, data, now)


def repetition_markdown(document: dict) -> str:
    d = document["data"]
    out = [f"# {document['command'].title()}", ""]
    out += [f"- {c['occurrences']}× in {c['conversations']} conversations ({c['pool']}): {display.logged(c['representative'] or '')}" for c in d["clusters"]] or ["Nothing was asked twice."]
    if d["flows"]:
        out += ["", "## Flows", "", *(f"- {s['occurrences']}×: " + " → ".join(display.logged(w or "…", 60) for w in s["wording"]) for s in d["flows"])]
    if d.get("friction"):
        out += ["", "## Requests after a failure", "", *(f"- {f['repository'] or 'Without a repository'}: {f['after_error']} of {f['messages']}" for f in d["friction"])]
    if d.get("unexamined"):
        out += ["", "## Not examined", "", *(f"- {u['repository'] or 'Without a repository'}: {u['sessions']} sessions" for u in d["unexamined"])]
    return "\n".join([*out, ""])
