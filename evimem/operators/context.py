"""Contexts of records: how well they fit a query's context, the gate, eligibility, trust in a result, tool results, roles, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimem.functions.numbers import clamp, r6
from evimem.functions.text import has

# Weight of each part of a record's context in the boost.
BOOST = {"project": 0.08, "goal": 0.06, "entity": 0.05, "scope": 0.07, "precondition": 0.07, "system": 0.04, "version": 0.03, "completeness": 0.05}
#: Likeness from which a goal counts as the same.
GOAL_LIKENESS = 0.55


def label(value: Column) -> Column:
    """The different words (a-z, 0-9) of a context value, lower-cased and sorted: two values with the same words are the same."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"([a-z0-9]+)"), 1)))


def same_value(required: Column, actual: Column) -> Column:
    """1 if the context has what is required, word for word but for case and signs, else 0; a part of a word is no match."""
    equal = (F.lower(F.trim(required)) == F.lower(F.trim(actual))) | ((F.size(label(required)) > 0) & (label(required) == label(actual)))
    return F.when(F.coalesce((actual != "") & equal, F.lit(False)), 1.0).otherwise(0.0)


def _share(hits: Column, of: Column) -> Column:
    """Hits by the size of `of`, 1 where nothing is required."""
    return F.when(F.size(of) > 0, hits / F.size(of)).otherwise(F.lit(1.0))


def _count(of: Column, hit) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda acc, x: acc + F.when(F.coalesce(hit(x), F.lit(False)), 1.0).otherwise(0.0))


def context_match(rows: DataFrame) -> DataFrame:
    """`rows` with the parts of the context match, `completeness`, the `gate` (0 or 1) and the `boost`.

    A row is a record (`context_mode, scope, entities, preconditions, systems, versions`) beside a query's context (`query`, `asked_scope` and
    `asked_state` as maps, `asked_entities, asked_systems, asked_versions` as arrays; `goal_likeness`, if the rows have it, is that of the goals). A
    requirement that a record does not have is met in full. A record that depends on its context does not pass the gate if a scope value,
    precondition, system or version is missing in the query's context, or if it requires none of these and no entity of it is named.
    Null maps and arrays count as empty, a null mode as standalone.
    """
    maps = {c: F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in ("scope", "preconditions", "asked_scope", "asked_state")}
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("entities", "systems", "versions", "asked_entities", "asked_systems", "asked_versions")}
    rows = rows.withColumns({f"_{c}": v for c, v in (maps | lists).items()}).withColumns({"_words": label(F.col("query")), "_low": F.lower("query"), "_dependent": F.coalesce(F.col("context_mode") == "context_dependent", F.lit(False))})
    goal = F.coalesce(F.col("goal_likeness"), F.lit(0.0)) if "goal_likeness" in rows.columns else F.lit(0.0)
    entries = F.map_entries("_scope")
    of_scope = F.transform(entries, lambda e: F.when(e["key"] == "goal", goal).otherwise(same_value(e["value"], F.element_at("_asked_scope", e["key"]))))
    passed = F.forall(entries, lambda e: F.when(e["key"] == "goal", goal >= GOAL_LIKENESS).otherwise(same_value(e["value"], F.element_at("_asked_scope", e["key"])) >= 0.999))
    named = lambda x: (F.size(label(x)) > 0) & (F.size(F.array_except(label(x), F.col("_words"))) == 0)
    listed = lambda x, c: F.exists(c, lambda y: label(x) == label(y))
    entity = lambda x: F.exists("_asked_entities", lambda y: F.lower(x) == F.lower(y)) | F.col("_low").contains(F.lower(x)) | named(x)
    needs = F.map_entries("_preconditions")
    rows = rows.withColumns(
        {
            "scope_match": _share(F.aggregate(of_scope, F.lit(0.0), lambda acc, x: acc + x), entries),
            "scope_passed": passed,
            "project_match": F.when(F.coalesce(F.element_at("_scope", "project"), F.lit("")) != "", same_value(F.element_at("_scope", "project"), F.element_at("_asked_scope", "project"))).otherwise(1.0),
            "goal_match": F.when(F.coalesce(F.element_at("_scope", "goal"), F.lit("")) != "", goal).otherwise(1.0),
            "entity_match": _share(_count(F.col("_entities"), entity), F.col("_entities")),
            "precondition_match": _share(_count(needs, lambda e: same_value(e["value"], F.element_at("_asked_state", e["key"])) > 0), needs),
            "system_match": _share(_count(F.col("_systems"), lambda x: listed(x, "_asked_systems") | named(x)), F.col("_systems")),
            "version_match": _share(_count(F.col("_versions"), lambda x: listed(x, "_asked_versions") | named(x)), F.col("_versions")),
        }
    )
    has_ = {"project": F.coalesce(F.element_at("_scope", "project"), F.lit("")) != "", "goal": F.coalesce(F.element_at("_scope", "goal"), F.lit("")) != "", "entity": F.size("_entities") > 0, "scope": F.size(entries) > 0, "precondition": F.size(needs) > 0, "system": F.size("_systems") > 0, "version": F.size("_versions") > 0}
    required = [c for c in has_ if c not in ("project", "goal")]
    scores = F.array_compact(F.array(*[F.when(has_[c], F.col(f"{c}_match")) for c in required]))
    complete = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.size(scores)).otherwise(F.when(F.col("_dependent"), 0.0).otherwise(1.0))
    hard = has_["scope"] | has_["precondition"] | has_["system"] | has_["version"]
    failed = (has_["scope"] & ~F.col("scope_passed")) | reduce(Column.__or__, [has_[c] & (F.col(f"{c}_match") < 0.999) for c in ("precondition", "system", "version")])
    shut = F.col("_dependent") & (failed | (~hard & (~has_["entity"] | (F.col("entity_match") <= 0))))
    parts = [BOOST[c] * F.when(has_[c], F.col(f"{c}_match")).otherwise(0.0) for c in has_]
    rows = rows.withColumns({"completeness": complete, "gate": F.when(shut, 0).otherwise(1)})
    boost = reduce(Column.__add__, parts) + BOOST["completeness"] * F.when(F.col("_dependent"), F.col("completeness")).otherwise(0.0)
    return rows.withColumn("boost", r6(boost)).drop(*[c for c in rows.columns if c.startswith("_")], "scope_passed")


def adaptation(feedback: DataFrame) -> DataFrame:
    """`feedback` (`usefulness, observations`) with its `adaptation` of a score: from -1 to 1, in full from three observations on."""
    return feedback.withColumn("adaptation", r6((2 * F.col("usefulness") - 1) * F.least(F.lit(1.0), F.col("observations") / 3.0)))


def eligible(memories: DataFrame, memberships: DataFrame, active_set: str, evidence_lookup: bool = False, include_archived: bool = False) -> DataFrame:
    """The memories that may be recalled: in the active set, not revoked, `primary` there (or `evidence_only` for evidence), in a usable state.

    memberships: `memory_id, recall_set_id, eligibility, revoked_at`. Repeated memberships count once; memories without one are not eligible.
    """
    kinds = ["primary", "evidence_only"] if evidence_lookup else ["primary"]
    states = ["active", "cold", "archived"] if include_archived else ["active", "cold"]
    mine = memberships.where((F.col("recall_set_id") == active_set) & F.col("revoked_at").isNull() & F.col("eligibility").isin(kinds)).select(F.col("memory_id").alias("id"))
    return memories.where(F.col("state").isin(states)).join(mine, "id", "left_semi")


# Weights of the signals in the trust of a result, and the bounds of use and verify.
TRUST = {"confidence": 0.20, "trust": 0.16, "currentness": 0.14, "utility": 0.13, "relevance": 0.13, "fresh": 0.10, "source": 0.08, "feedback": 0.06}
USE, VERIFY = 0.70, 0.48


def assessed(rows: DataFrame) -> DataFrame:
    """`rows` with `probability` that a result may be trusted, and the `decision`: use, verify or abstain.

    Rows have `confidence, trust, currentness, utility, relevance, stale_risk, wrong_rate, source_prior, positive, negative, dirty, superseded, state`;
    every signal is rounded to six places before the sum.
    """
    feedback = (F.col("positive") + 2.0) / (F.col("positive") + F.col("negative") + 4.0)
    signals = {"confidence": F.col("confidence"), "trust": F.col("trust"), "currentness": F.col("currentness"), "utility": F.col("utility"), "relevance": F.col("relevance"), "fresh": 1 - r6(F.col("stale_risk")), "source": F.col("source_prior"), "feedback": feedback}
    total = reduce(Column.__add__, [w * r6(signals[s]) for s, w in TRUST.items()])
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = total - 0.18 * r6(F.col("wrong_rate")) - flag(F.col("dirty"), 0.16) - flag(F.col("superseded"), 0.12) - flag(F.col("state") == "cold", 0.03)
    rows = rows.withColumn("probability", r6(clamp(total)))
    return rows.withColumn("decision", F.when(F.col("probability") >= USE, "use").when(F.col("probability") >= VERIFY, "verify").otherwise("abstain"))


# What a part of a text must look like to be an anchor, and words that do not count for attribution.
ANCHOR = r"(?i)(https?://\S+|(?:~?/)?(?:[\w.-]+/)+[\w./-]+|\b\d{2,}(?:\.\d+)?\b|\b\w+-[\w-]{3,}\b)"
NO_EVIDENCE = (
    "about", "after", "again", "also", "because", "before", "could", "from", "have", "into", "memory", "completed", "done", "should", "task", "that", "the",
    "their", "there", "these", "they", "this", "through", "using", "what", "when", "where", "which", "with", "would", "your",
)


def attributed(rows: DataFrame) -> DataFrame:
    """`rows` (`content, response, object_value, similarity`) with `attribution`: how much a response looks as if it used the record.

    A stated value that occurs in the response decides alone. Else the best of shared words, anchors (links, paths, numbers, compounds; up
    to .88) and likeness (up to .68) counts; without anchors and with few shared words it stays low. Empty and null texts give 0.
    """
    words = lambda c: F.array_distinct(F.transform(F.filter(F.regexp_extract_all(c, F.lit(r"([\w~./:@+-]{2,})"), 1), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*NO_EVIDENCE)), lambda t: F.regexp_replace(F.lower(t), r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", "")))
    anchors = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(ANCHOR), 1), lambda a: F.regexp_replace(F.lower(a), r"[.,;:!?]+$", "")))
    rows = rows.withColumns({"_own": words(F.col("content")), "_said": words(F.col("response")), "_anchors": anchors, "_low": F.lower("response")})
    shared = F.size(F.array_intersect("_own", "_said"))
    overlap = shared / F.greatest(F.lit(1), F.least(F.size("_own"), F.size("_said")))
    overlap = F.when((shared < 2) & (F.size("_anchors") == 0), overlap * 0.35).otherwise(overlap)
    hits = F.when(F.size("_anchors") > 0, F.aggregate("_anchors", F.lit(0.0), lambda acc, a: acc + F.when(F.col("_low").contains(a), 1.0).otherwise(0.0)) / F.size("_anchors")).otherwise(0.0)
    best = F.greatest(overlap, 0.88 * hits, 0.68 * F.coalesce("similarity", F.lit(0.0)))
    score = F.when((overlap < 0.12) & (hits == 0), F.least(best, F.lit(0.17))).otherwise(best)
    value = F.trim(F.coalesce("object_value", F.lit("")))
    empty = F.coalesce(F.col("content"), F.lit("")).isin("") | F.coalesce(F.col("response"), F.lit("")).isin("")
    out = F.when(empty, 0.0).when((value != "") & F.col("_low").contains(F.lower(value)), 1.0).otherwise(clamp(score))
    return rows.withColumn("attribution", r6(out)).drop("_own", "_said", "_anchors", "_low")


# Kinds of tasks by the words of a request, the first that fits; marks of failure; kinds of errors.
TASKS = [
    ("web_research", r"\b(?:search|research|web|website|online|latest|news|source)\b"),
    ("filesystem", r"\b(?:file|folder|directory|read|write|edit|patch|workspace|repo)\b"),
    ("shell", r"\b(?:terminal|shell|command|process|server|ssh|build|test|install)\b"),
    ("github", r"\b(?:github|pull request|\bpr\b|issue|commit|branch|actions|ci)\b"),
    ("calendar", r"\b(?:calendar|meeting|schedule|availability|event|appointment)\b"),
    ("email", r"\b(?:email|gmail|inbox|reply|forward|message)\b"),
    ("memory", r"\b(?:remember|memory|recall|forget|preference)\b"),
    ("data_analysis", r"\b(?:data|metric|spreadsheet|csv|chart|dashboard|analy[sz]e)\b"),
]
FAILURE = r"(?:^|\n)\s*(?:error|fatal|traceback|exception|failed|failure)\s*[:\-]|\b(?:permission denied|timed? out|unauthorized|forbidden|no such file|connection refused)\b"
ERRORS = [("timeout", r"timeout|timed out"), ("authorization", r"unauthorized|forbidden|permission"), ("not_found", r"not found|no such file"), ("validation", r"invalid|validation"), ("connectivity", r"connection|network|dns")]


def task_type(request: Column) -> Column:
    """The kind of task that a request is, `general` if none fits."""
    out = F.lit("general")
    for name, pattern in reversed(TASKS):
        out = F.when(has(request, pattern), name).otherwise(out)
    return out


def one_value(text: Column) -> Column:
    """Whether a text is one JSON value with nothing after it (the parser itself stops at the end of the first)."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()


def result_failed(result: Column) -> Column:
    """Whether a tool's result tells of a failure: a JSON object by its exit code, flags, status and error, in this order; other texts by their words."""
    plain = F.coalesce(has(F.substring(result, 1, 1200), FAILURE), F.lit(False))
    # one object and nothing after it
    j = F.from_json(F.when(result.rlike(r"^\s*\{") & one_value(result), result), "exit_code BIGINT, returncode BIGINT, success BOOLEAN, ok BOOLEAN, isError BOOLEAN, status STRING, error STRING")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    bad = is_(j["exit_code"] != 0) | is_(j["returncode"] != 0) | is_(~j["success"]) | is_(~j["ok"]) | is_(j["isError"]) | is_(F.lower(j["status"]).isin("error", "failed", "failure", "fatal")) | is_(~j["error"].isin("", "false", "[]", "{}"))
    return F.when(bad, True).when(is_(j["success"]) | is_(j["ok"]), False).otherwise(plain)


def error_type(result: Column) -> Column:
    """The kind of error that a failed result tells of."""
    out = F.lit("tool_error")
    for name, pattern in reversed(ERRORS):
        out = F.when(has(result, pattern), name).otherwise(out)
    return out


def argument_keys(arguments: Column) -> Column:
    """The sorted keys of a JSON object of arguments, empty for anything else."""
    return F.coalesce(F.array_sort(F.json_object_keys(F.when(arguments.rlike(r"^\s*\{"), arguments))), F.array().cast("array<string>"))


def workflows(executions: DataFrame) -> DataFrame:
    """`session_id, workflow_key, steps, success, error_type, failed_steps` from `session_id, step, tool, arguments, result`: a session's tool calls in order.

    The key is a digest of the steps' tools, argument keys and outcomes, so the same way of working has the same key in any session.
    """
    failed = result_failed(F.col("result"))
    steps = executions.select("session_id", "step", F.struct("step", "tool", argument_keys(F.col("arguments")).alias("keys"), (~failed).alias("ok"), F.when(failed, error_type(F.col("result"))).alias("error")).alias("s"))
    made = steps.groupBy("session_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    bare = F.transform("s", lambda x: F.struct(x["tool"], x["keys"], x["ok"], x["error"]))
    first = F.get(F.filter(F.transform("s", lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))
    return made.select("session_id", F.sha2(F.to_json(bare), 256).alias("workflow_key"), F.size("s").alias("steps"), F.forall("s", lambda x: x["ok"]).alias("success"), first.alias("error_type"), F.size(F.filter("s", lambda x: ~x["ok"])).alias("failed_steps"))


def corrected(versions: DataFrame, corrections: DataFrame) -> DataFrame:
    """The rows that corrections (`memory_id, version_id, content, at`) append to a version feed: nothing is overwritten.

    Of each corrected memory the open version (the latest start) is recorded again with its end, and the correction as a new version from
    then on, with a confidence of .55 at least. Several corrections of a memory follow each other. Memories without versions only get the new one.
    """
    order = Window.partitionBy("memory_id").orderBy("at", "version_id")
    steps = corrections.where("memory_id is not null and at is not null").dropDuplicates(["memory_id", "version_id"]).withColumn("until", F.lead("at").over(order)).withColumn("first", F.row_number().over(order) == 1)
    start = F.coalesce("valid_from", "system_from")
    open_ = versions.groupBy("memory_id").agg(F.max_by(F.struct("version_id", "content", "state", "confidence", start.alias("start")), F.struct(start, "system_from", "version_id")).alias("o"))
    joined = steps.join(open_, "memory_id", "left")
    new = joined.select("memory_id", "version_id", "content", r6(F.greatest(F.lit(0.55), F.coalesce("o.confidence", F.lit(0.0)))).alias("confidence"), F.coalesce("o.state", F.lit("active")).alias("state"), F.col("at").alias("valid_from"), F.col("until").alias("valid_to"), F.col("at").alias("system_from"), F.lit("correction").alias("reason"))
    closed = joined.where(F.col("first") & F.col("o.version_id").isNotNull() & (F.col("o.start") < F.col("at"))).select("memory_id", "o.version_id", "o.content", "o.confidence", "o.state", F.col("o.start").alias("valid_from"), F.col("at").alias("valid_to"), F.col("at").alias("system_from"), F.lit("closed").alias("reason"))
    return new.unionByName(closed)


def state_changes(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that changes of state (`memory_id, state, at`) append: the latest version again with the new state; no row where it has it already."""
    start = F.coalesce("valid_from", "system_from")
    latest = versions.groupBy("memory_id").agg(F.max_by(F.struct("version_id", "content", F.col("state").alias("before")), F.struct("system_from", start, "version_id")).alias("o"))
    return wanted.join(latest, "memory_id").where(~F.col("state").eqNullSafe(F.col("o.before"))).select("memory_id", "o.version_id", "o.content", "o.before", "state", F.col("at").alias("system_from"))


def balanced(arrivals: DataFrame, block: list[str], arms: list[str], order: list, key: str, experiment: str) -> DataFrame:
    """`arrivals` with an `arm`: blocks of as many arrivals as there are arms, in each of which every arm comes once, in an order drawn by hashes.

    So after each arrival no arm is ahead of another by more than one. The arm follows from the block and the arrival's place in it alone: a hash
    orders the arms of each block, so nothing is carried from row to row and groups are numbered by ranges, not by one task.
    """
    from evimem.operators.links import numbered

    rows = numbered(arrivals, block, order, "_n")
    size = len(arms)
    turn = F.floor((F.col("_n") - 1) / size)
    drawn = F.array_sort(F.array(*[F.struct(F.sha2(F.concat_ws("|", F.lit(experiment), *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in block], turn.cast("string"), F.lit(a)), 256).alias("h"), F.lit(a).alias("arm")) for a in arms]))
    return rows.withColumn("arm", F.element_at(drawn, (F.pmod(F.col("_n") - 1, F.lit(size)) + 1).cast("int"))["arm"]).drop("_n")


# Signs of structured texts.
SIGNS = {
    "code": r"```|~~~~",
    "table": r"\|[\s:]*-{3,}[\s:|-]*\|",
    "diagram": r"[├└│┌┐┤┬┴┼]|(?:^|\s)[|+][-+]{2,}",
    "trace": r"Traceback \(most recent call last\)|(?:^|\s)at [\w.$<>]+\([^)]*:\d+\)|File \"[^\"]+\", line \d+",
}
CONFIG = r"(?:^|\s)[A-Za-z0-9_.\-]{2,}\s?[:=]\s?[^\s=:]{1,80}(?=\s|$)"
COMMAND = r"(?:^|\s)(?:\$ \S|sudo \S|curl -|docker(?: compose)? \w|git \w+|systemctl \w|journalctl|npm (?:run|install|ci)\b|pip3? install\b|apt(?:-get)? \w|ssh \S+@|python3? -m \S|kubectl \w|chmod \d)"
LOG = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\[(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE)\]|(?:^|\s)(?:INFO|WARNING|ERROR|DEBUG):\s"
CODE_SIGNS = r"[{}\[\]();<>$=&|\\`#]"


def structures(text: Column) -> Column:
    """The kinds of structure that a text shows, in a fixed order."""
    times = lambda p: F.regexp_count(text, F.lit(p))
    code = text.rlike(SIGNS["code"])
    found = [
        (code, "code"),
        (text.rlike(SIGNS["table"]) | (times(r"\|") >= 8), "table"),
        (text.rlike(SIGNS["diagram"]), "diagram"),
        ((times(CONFIG) >= 3) & ~code, "config"),
        (times(COMMAND) >= 2, "commands"),
        (text.rlike(SIGNS["trace"]) | (times(LOG) >= 3), "log_output"),
        (text.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$") & one_value(text), "raw_json"),
        (~code & (F.length(text) >= 120) & (times(CODE_SIGNS) / F.length(text) >= 0.055), "code_like_density"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in found]))


def record_role(rows: DataFrame) -> DataFrame:
    """`rows` (`content, kind, source_type, source_category, supported`) with their `structures` and `role`.

    Documents and structured texts are references, episodes events, inferences without active support claims, all others canonical.
    """
    document = F.coalesce(F.lower("source_type").isin("vault_markdown", "document", "document_import") | (F.upper("source_category") == "DOCUMENT_EXTRACTED"), F.lit(False))
    rows = rows.withColumn("structures", structures(F.coalesce("content", F.lit(""))))
    inferred = F.coalesce(F.upper("source_category").isin("AGENT_INFERENCE", "REFLECTION"), F.lit(False)) & ~F.coalesce("supported", F.lit(False))
    return rows.withColumn("role", F.when(document | (F.size("structures") > 0), "reference").when(F.lower("kind") == "episode", "event").when(inferred, "claim").otherwise("canonical"))


def resolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """`a, b` (a < b): pairs of notes that link to each other, from `links` (`id, target`) and `notes` (`id, path, title`).

    A target may be a note's path without suffix, its file's name without suffix, or its title, in this order; of several notes with one
    alias the one with the least path. Anchors and labels of targets (after # and |) and letter case do not count. Links to nowhere and to itself give no pair.
    """
    bare = F.regexp_replace(F.lower("path"), r"\.[^./]+$", "")
    named = notes.select("id", "path", F.inline(F.array(*[F.struct(F.lit(n).alias("rank"), alias.alias("alias")) for n, alias in enumerate((bare, F.regexp_extract(bare, r"([^/]*)$", 1), F.lower(F.trim("title"))))]))).where("alias is not null and alias <> ''")
    first = named.groupBy("alias").agg(F.min_by("id", F.struct("rank", "path", "id")).alias("to"))
    alias = F.lower(F.trim(F.regexp_replace(F.regexp_replace("target", r"[#|].*$", ""), r"\.md$", "")))
    found = links.select("id", alias.alias("alias")).join(first, "alias").where("id <> to")
    return found.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def reconciled_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """`path, place, key, action` of each new chunk (`path, place, hash`) against the stored ones (`path, place, hash, key`), and stored ones that are gone.

    A chunk keeps the key of the stored chunk at its place if the hash is the same (`keep`); else it takes that of one with the same hash elsewhere in
    the note (`move`, in order of place); else the key of the stored chunk at its place, if that was not taken (`change`), or a new one (`add`).
    """
    o = old.select("path", F.col("place").alias("old_place"), F.col("hash").alias("old_hash"), F.col("key").alias("old_key"))
    same = new.join(o, (new["path"] == o["path"]) & (new["place"] == o["old_place"]) & (new["hash"] == o["old_hash"])).select(new["path"], new["place"], "hash", F.col("old_key").alias("key"), F.lit("keep").alias("action"))
    left_new, left_old = new.join(same.select("path", "place"), ["path", "place"], "left_anti"), o.join(same.select("path", F.col("place").alias("old_place")), ["path", "old_place"], "left_anti")
    nth = lambda place, hash_: F.row_number().over(Window.partitionBy("path", hash_).orderBy(place))
    moved = left_new.withColumn("nth", nth("place", "hash")).join(left_old.withColumn("nth", nth("old_place", "old_hash")).withColumnRenamed("old_hash", "hash"), ["path", "hash", "nth"]).select("path", "place", "hash", F.col("old_key").alias("key"), F.lit("move").alias("action"), "old_place")
    still_new = left_new.join(moved.select("path", "place"), ["path", "place"], "left_anti")
    still_old = left_old.join(moved.select("path", "old_place"), ["path", "old_place"], "left_anti")
    rest = still_new.join(still_old.select("path", F.col("old_place").alias("place"), "old_key"), ["path", "place"], "left")
    fresh = F.sha2(F.concat_ws("|", "path", F.col("place").cast("string"), "hash"), 256)
    changed = rest.select("path", "place", "hash", F.coalesce("old_key", fresh).alias("key"), F.when(F.col("old_key").isNotNull(), "change").otherwise("add").alias("action"))
    gone = still_old.join(changed.where("action = 'change'").select("path", F.col("place").alias("old_place")), ["path", "old_place"], "left_anti").select("path", F.col("old_place").alias("place"), F.col("old_hash").alias("hash"), F.col("old_key").alias("key"), F.lit("remove").alias("action"))
    return reduce(DataFrame.unionByName, [same, moved.drop("old_place"), changed, gone])


def standing_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The label that stands for each key, from `label_id, outcome, created_at, reversed_at`: of those not taken back, the one given last; no row where all were."""
    return labels.where("reversed_at is null").groupBy(*keys).agg(F.max_by("outcome", F.struct("created_at", "label_id")).alias("outcome"), F.count("*").alias("labels"))

