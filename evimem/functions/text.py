"""Text functions as column expressions: normalising, redaction, tokens, features, temporal markers, extraction, planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------

#: Secrets and what stands for them, in the order in which they are replaced (patterns, replacement, ignoring case or not).
SECRETS = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]", True),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED AWS KEY]", False),
    (r"\b(?:sk|rk|pk)-[A-Za-z0-9_-]{20,}\b", "[REDACTED API KEY]", False),
    (r"\bBearer\s+[A-Za-z0-9._~+/=-]{16,}\b", "Bearer [REDACTED]", True),
    (r"\b(api[_ -]?key|access[_ -]?token|secret|password|passwd)\b\s*[:=]\s*([^\s,;]{8,})", "$1=[REDACTED]", True),
    (r"\b(password|passwd|passcode|pin)\b\s+(?:is|was)\s+(?!(?:stored|saved|managed|kept|located)\b)([^\s,;]{3,})", "$1 is [REDACTED]", True),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b", "[REDACTED GITHUB TOKEN]", False),
    (r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", "[REDACTED GITHUB TOKEN]", False),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED SLACK TOKEN]", False),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED GOOGLE KEY]", False),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[REDACTED JWT]", False),
]
#: Signs of injected instructions, by the reason that is given for them.
INJECTIONS = [
    ("instruction override", r"\bignore\s+(?:all\s+)?(?:previous|prior|system)\s+instructions?\b"),
    ("exfiltration request", r"\b(?:reveal|print|exfiltrate|send)\b[\s\S]{0,80}\b(?:system prompt|api key|credentials?|secrets?)\b"),
    ("role override", r"\byou are now\b[\s\S]{0,80}\b(?:system|developer|administrator|root)\b"),
    ("role-tag injection", r"<\s*/?\s*(?:system|developer|assistant)\b|<\s*/\s*tool\b|<\s*tool\s+[^>]*>"),
]
ROLE_TAGS = r"<\s*/?\s*(?:system|developer|assistant)\b[^>]*>|<\s*/?\s*tool\b[^>]*>"
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "if", "in",
    "is", "it", "me", "my", "of", "on", "or", "our", "so", "that", "the", "their", "them", "there", "they", "this", "to", "us", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
SUFFIXES = ("ingly", "edly", "ation", "ments", "ment", "ness", "ing", "ers", "ies", "ed", "es", "s")
CONCEPTS = {
    "host": ("host", "server", "vps", "machine", "computer", "backend", "node"),
    "database": ("database", "datastore", "store", "storage", "sql", "sqlite", "backend"),
    "location": ("where", "location", "path", "directory", "folder", "stored", "runs"),
    "preference": ("prefer", "preference", "favorite", "style", "usually", "default"),
    "decision": ("decision", "decide", "chosen", "chose", "choice", "approved", "picked"),
    "failure": ("error", "failed", "failure", "broken", "issue", "problem", "exception"),
    "repair": ("fix", "fixed", "repair", "resolved", "solution", "workaround", "recovery"),
    "tool": ("tool", "command", "action", "function", "call", "workflow", "procedure"),
    "research": ("search", "research", "source", "web", "online", "browse", "paper"),
    "deployment": ("deploy", "deployment", "release", "publish", "production", "install"),
    "current": ("current", "currently", "now", "latest", "today", "active", "present"),
    "historical": ("previous", "previously", "former", "formerly", "history", "historical", "old"),
    "identity": ("identity", "profile", "person", "name", "user"),
    "communication": ("response", "respond", "answer", "message", "email", "chat"),
}
VOLATILE = [
    (r"\buptime\b", 3),
    (r"\bload (avg|average)\b", 3),
    (r"\b(as of|as-of|snapshot|at the time of|point-in-time)\b", 3),
    (r"\b(estimated|live) balance\b", 3),
    (r"\bstatement balance\b", 3),
    (r"\b(apr|interest charged)\b", 2),
    (r"\b\d+(\.\d+)?\s?%\s*(used|free|utilisation|utilization)\b", 3),
    (r"\bused \(\d+(\.\d+)?%\)", 3),
    (r"\b(days|hours|minutes)\s+(uptime|ago)\b", 2),
    (r"\blast (updated|checked|recheck|verified)\b", 2),
    (r"\bverified \d{4}-\d{2}-\d{2}", 3),
    (r"\bupdated from\b", 2),
    (r"\b(live|current) (snapshot|plaid|data|state|balances?)\b", 3),
    (r"\bcurrent balances?\b", 3),
    (r"\bmonthly statements?\b", 2),
    (r"\best\.?\s*\d{1,2}/\d{1,2}", 3),
    (r"\brecheck\b|re-check", 2),
    (r"\b(free|used)\s+(space|disk|memory|ram)\b", 2),
    (r"\b(pending|due|scheduled)\b", 1),
    (r"\b(yesterday|today|tonight|this (week|month))\b", 2),
    (r"(?-i:\b[A-Z][\w.-]*\s+v?\d+\.\d+(\.\d+|\.x)?\b)", 2),
    (r"\b(version|revision|build)\b[^\n]{0,24}\b\d+\.\d+(\.\d+)?", 2),
    (r"\bdowntime\b|\bcrash(ed)?\b", 1),
]
DURABLE = [
    (r"\b(hostname|ip address|mac address|host|ip)\b", 2),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", 2),
    (r"\b(model|chipset|cpu)\b", 1),
    (r"\b(prefer|prefers|preference|always|never|do not|don't)\b", 2),
    (r"\b(path|directory|repo|repository|url|endpoint|port)\b", 1),
    (r"\b(policy|rule|convention|house style)\b", 2),
    (r"(?:^|[^\w/])(/[\w./-]{3,})", 1),
    (r"\b(username|account|credential|token|key)\b", 1),
    (r"\b(installed|configured|set up|built)\b", 1),
]
DATED_VALUES = [r"\$\s?\d[\d,]*(\.\d{2})?", r"\d+(\.\d+)?\s?%", r"\bv?\d+\.\d+(\.\d+|\.x)?\b"]
#: Kinds of statements in the order in which they are tried: pattern, importance, confidence, volatility.
STATEMENTS = [
    ("prospective", r"\b(?:remind me|need to|plan to|todo|to-do|follow up|don't forget|commit(?:ment)? to)\b", 0.90, 0.84, 0.20),
    ("preference", r"\b(?:i|we)\s+(?:prefer|like|want|dislike|hate|always|never)\b|\bplease\s+(?:always|never|remember)\b", 0.88, 0.85, 0.12),
    ("identity", r"\bmy\s+(?:name|timezone|role|job|location)\s+is\b|\bi\s+(?:am|live|work)\b", 0.90, 0.88, 0.05),
    ("decision", r"\b(?:we|i)\s+(?:decided|chose|picked|settled on|am going with)\b|\bthe decision is\b", 0.84, 0.82, 0.25),
    ("procedure", r"\b(?:workaround|root cause|the fix|fixed by|run this|command is|verified with)\b", 0.76, 0.72, 0.25),
    ("operational", r"\b(?:runs? on|hosted on|configured|version|path is|server|backend|database|provider)\b", 0.68, 0.68, 0.75),
    ("semantic", r"\b(?:project|uses|requires|depends on|belongs to|is located|is stored)\b", 0.65, 0.62, 0.35),
]
EXPLICIT = r"^\s*(?:please\s+)?remember(?:\s+that)?\s*[:,.-]?\s*"
TRANSIENT = r"\b(?:i|we)\s+(?:want|need|plan)\s+(?:you\s+)?to\b|\b(?:today|right now|for now|this turn|in this response)\b"
STABLE = r"\b(?:always|never|usually|generally|by default|from now on|whenever)\b"
TOPIC_STOP = (
    "about", "again", "and", "are", "assistant", "attention", "before", "close", "closely", "could", "current", "detailed", "does", "during",
    "focus", "for", "from", "have", "help", "how", "into", "latest", "memory", "need", "pay", "please", "remember", "should", "that", "the", "this",
    "use", "using", "what", "when", "where", "which", "with", "would", "your",
)
#: Cues of the recall planner.
CUES = {
    "greeting": r"^\s*(?:hi|hey|hello|thanks|thank you|good (?:morning|afternoon|evening|night)|ok(?:ay)?|sounds good|got it|understood|cool|nice)[.! ]*\s*$",
    "stateless": r"^\s*(?:calculate|compute|convert|translate)\b|^\s*(?:summarize|rewrite|proofread)\s+(?:this|the following)\b",
    "personal": r"\b(?:my|our|i\s+(?:prefer|said|asked|decided)|remember|memory|previous|before|again|usual|favorite|preference|profile|vault|assistant|agent)\b",
    "decision": r"\b(?:decide|decision|approved|chosen|chose|choice|should\s+(?:we|i)|which\s+.+\s+(?:use|used)|backend|setting|configuration|procedure|workflow)\b",
    "tool": r"\b(?:tool|call|command|shell|terminal|build|test|deploy|install|research|search|browser|filesystem|github|calendar|email|server|ssh|api|mcp)\b",
    "hops": r"\b(?:why|compare|relationship|related|connect|combine|both|across|root cause|what changed|how did|timeline)\b",
    "current": r"\b(?:current|currently|now|today|latest|present|still|active)\b",
    "historical": r"\b(?:previously|formerly|historical|history|back then|last (?:week|month|year)|used to|during)\b",
    "year": r"\b(19\d{2}|20\d{2}|21\d{2})\b",
    "arithmetic": r"^\s*(?:(?:what(?:'s| is)|solve|evaluate)\s+)?(?:\(?\s*-?\d+(?:\.\d+)?\s*\)?\s*)(?:[+\-*/%^]|\*\*)\s*(?:\(?\s*-?\d+(?:\.\d+)?\s*\)?\s*)(?:(?:[+\-*/%^]|\*\*)\s*(?:\(?\s*-?\d+(?:\.\d+)?\s*\)?\s*))*[?=.! ]*$",
    "attention": r"\b(?:pay close attention to|focus closely on|use detailed memory (?:for|about))\b",
}

# Functions ----------------------------------------------------------------------------------------------------------


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, ignoring case."""
    return text.rlike(f"(?i){pattern}")


def normalized(text: Column) -> Column:
    """Without white space at the ends, runs of it as one blank; null as an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))


def redacted(text: Column) -> Column:
    """The normalised text with secrets replaced."""
    return reduce(lambda t, s: F.regexp_replace(t, ("(?i)" if s[2] else "") + s[0], s[1]), SECRETS, normalized(text))


def quarantine_reason(text: Column) -> Column:
    """Reasons for which a text must not be recalled, sorted and joined; null without any."""
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(has(text, p), F.lit(reason)) for reason, p in INJECTIONS]))), ", ")
    return F.when(reasons != "", reasons)


def without_role_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i){ROLE_TAGS}", "")


def tokens(text: Column) -> Column:
    """Different words of two or more letters or digits, lower-cased, without stop words: the tokens of search and scoring (own choice)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{2,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP)))


def stem(token: Column) -> Column:
    """A token of five letters or more without the first suffix that leaves three; ies becomes y."""
    out = token
    for suffix in reversed(SUFFIXES):
        base = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when(token.endswith(suffix) & (F.length(token) - len(suffix) >= 3), F.concat(base, F.lit("y")) if suffix == "ies" else base).otherwise(out)
    return F.when((F.length(token) >= 5) & token.rlike(r"^\p{L}+$"), out).otherwise(token)


def feature_tokens(text: Column) -> Column:
    """The first 48 tokens of the feature index, in order and with repeats."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_~./:@+-]{2,})"), 1)
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^[.,;!?()\[\]{}\"']+|[.,;!?()\[\]{}\"']+$", ""))
    return F.slice(F.filter(bare, lambda t: (t != "") & ~t.isin(*STOP)), 1, 48)


def features(token: Column, following: Column) -> Column:
    """Weighted features that one of the `feature_tokens` and the one after it (or null) give: exact token, stem, trigrams, pair, concepts."""

    def made(prefix: str, value: Column, weight: float) -> Column:
        return F.struct(F.concat(F.lit(prefix), value).alias("feature"), F.lit(weight).alias("weight"))

    root = stem(token)
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    grams = F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.substring(padded, k, F.lit(3)))), 1, 10)
    trigrams = F.when((F.length(token) >= 6) & token.rlike(r"^\p{L}+$"), F.transform(grams, lambda g: made("tri:", g, 0.10)))
    groups = {}
    for name, aliases in CONCEPTS.items():
        for alias in aliases:
            groups.setdefault(alias, []).append(name)
    concepts = F.create_map(*[x for alias, names in groups.items() for x in (F.lit(alias), F.array(*map(F.lit, names)))])
    named = lambda t: F.coalesce(F.transform(F.element_at(concepts, t), lambda c: made("concept:", c, 0.88)), F.array())
    single = F.array_compact(
        F.array(
            made("tok:", token, 1.0),
            F.when((root != token) & (F.length(root) >= 3), made("stem:", root, 0.72)),
            F.when(following.isNotNull(), made("pair:", F.concat(root, F.lit(":"), stem(following)), 0.58)),
        )
    )
    return F.concat(single, F.coalesce(trigrams, F.array()), named(token), named(root))


def marker_score(text: Column, markers: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the markers that occur."""
    return reduce(lambda a, b: a + b, [F.when(has(text, p), w).otherwise(0) for p, w in markers])


def stated_date(text: Column) -> Column:
    """The first valid date in the text: ISO dates first, then ISO times to the minute, then short month names, then month/day/year."""
    iso = F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1), lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())
    timed = F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2})"), 1), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd'T'HH:mm")).isNotNull())
    named = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4})\b"), 1), lambda d: F.try_to_date(F.initcap(F.regexp_replace(F.regexp_replace(d, ",", ""), r"\s+", " ")), "MMM d yyyy").isNotNull())
    slash = F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"), 1), lambda d: F.split(d, "/")[0].cast("int").between(1, 12) & F.split(d, "/")[1].cast("int").between(1, 31))
    return F.coalesce(F.get(iso, F.lit(0)), F.get(timed, F.lit(0)), F.get(named, F.lit(0)), F.get(slash, F.lit(0)))


def temporal_class(text: Column) -> tuple[Column, Column, Column, Column]:
    """Class (durable, volatile, mixed, mostly_durable), volatile score, durable score and stated date of a text."""
    as_of = stated_date(text)
    volatile = marker_score(text, VOLATILE) + F.when(as_of.isNotNull() & reduce(Column.__or__, [has(text, p) for p in DATED_VALUES]), 3).otherwise(0)
    durable = marker_score(text, DURABLE)
    kind = F.when(volatile == 0, "durable").when(durable == 0, "volatile").when(volatile >= 2, "mixed").otherwise("mostly_durable")
    return kind, volatile, durable, as_of


def sentences(text: Column) -> Column:
    """Sentences and clauses of a normalised text."""
    return F.split(normalized(text), r"(?<=[.!?])\s+|\s*;\s*")


def parts(text: Column, most: int = 6, least: int = 12) -> Column:
    """The first `most` sentences and clauses of at least `least` characters; shorter ones do not count."""
    return F.slice(F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: F.length(s) >= least), 1, most)


def statement(sentence: Column) -> Column:
    """Kind, importance, confidence and volatility of a user's sentence that is worth keeping, else null."""
    explicit = has(sentence, EXPLICIT)
    bare = normalized(F.regexp_replace(sentence, f"(?i){EXPLICIT}", ""))
    kept = F.when(explicit, bare).otherwise(sentence)

    def made(kind: str, importance: float, confidence: float, volatility: float) -> Column:
        return F.struct(kept.alias("content"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"), F.lit(volatility).alias("volatility"))

    out = F.when(explicit, made("semantic", 0.92, 0.92, 0.35))
    for kind, pattern, *numbers in reversed(STATEMENTS):
        out = F.when(has(kept, pattern), made(kind, *numbers)).otherwise(out)
    fits = F.length(sentence).between(16, 600) & (kept != "") & (explicit | ~sentence.rlike(r"\?\s*$")) & (explicit | ~has(sentence, TRANSIENT) | has(sentence, STABLE))
    return F.when(fits, out)


def plan(text: Column, limit: int = 6, budget: int = 700, threshold: float = 0.16, now: Column | None = None) -> Column:
    """How a query is to be recalled: mode, number of records, token budget, score threshold, steps in the graph, tools, and for which time.

    A year named in the query makes it historical, as of the year's end, or of `now` in the current year. Greetings, and sums and
    rewritings that do not touch what is remembered, recall nothing.
    """
    t = normalized(text)
    cue = {name: has(t, pattern) for name, pattern in CUES.items()}
    historical = cue["historical"] | cue["year"]
    year = F.regexp_extract(t, CUES["year"], 1)
    at = F.current_timestamp() if now is None else now
    end = F.when(year != "", F.when(year == F.date_format(at, "yyyy"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(year, F.lit("-12-31T23:59:59"))))

    def made(mode: str, n: int, tokens_: int, least: float, depth: int, tools: int, timed: bool = True) -> Column:
        when = F.when(historical, "historical").otherwise("current") if timed else F.lit("current")
        return F.struct(
            F.lit(mode).alias("mode"),
            F.lit(min(limit, n)).alias("limit"),
            F.lit(min(budget, tokens_)).alias("token_budget"),
            F.lit(round(least, 6)).alias("threshold"),
            F.lit(depth).alias("graph_depth"),
            F.when(cue["tool"], tools).otherwise(0).alias("tool_limit"),
            when.alias("temporal_mode"),
            (end if timed else F.lit(None).cast("string")).alias("as_of"),
        )

    none = (t == "") | cue["greeting"] | ((cue["stateless"] | cue["arithmetic"]) & ~(cue["personal"] | cue["decision"] | historical))
    deep = cue["attention"] | cue["hops"] | (historical & cue["decision"])
    focused = cue["personal"] | cue["decision"] | historical | cue["current"]
    late = min(0.30, threshold + 0.02)
    choice = F.when(none, made("none", 0, 0, threshold, 1, 0, False)).when(deep, made("deep", 6, 680, max(0.08, threshold - 0.02), 2, 3))
    return choice.when(focused, made("focused", 6, 620, threshold, 1, 2)).when(cue["tool"], made("procedural", 6, 620, late, 1, 3)).otherwise(made("lean", 6, 620, late, 1, 0))


def topics(text: Column, most: int = 6) -> Column:
    """The first different topic words of a query, lower-cased."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9._-]{2,31})"), 1), lambda t: F.regexp_replace(F.lower(t), r"^[._-]+|[._-]+$", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*TOPIC_STOP) & ~t.rlike(r"^\d+$"))), 1, most)
