"""Sources of documents and turns: Markdown trees, sections, conversation turns, tool calls, JSON lines, vectors; and their sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most characters of a part of a section, and folders that hold no notes.
MOST_CHARS = 1600
SKIPPED = ("node_modules", "__pycache__", "attachments", "templates")


def markdown_files(spark: SparkSession, folder: str, most_bytes: int = 1_000_000) -> DataFrame:
    """`path, modified_at, size, digest, text` of the Markdown files under `folder`: no hidden ones, none in skipped folders, none too large.

    Bytes that are no UTF-8 become replacement characters; the digest is that of the raw bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    hidden = F.col("path").rlike(r"/\.[^/]+") | F.col("path").rlike("/(?:" + "|".join(SKIPPED) + ")/")
    return files.where((F.col("length") <= most_bytes) & ~hidden).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """`key, change`: new, removed, changed or unchanged, from two lists of digests (a repeated key counts by its greatest digest)."""
    at = lambda df, name: df.groupBy(key).agg(F.max(digest).alias(name))
    both = at(old, "_old").join(at(new, "_new"), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed").alias("change"))


_HEADING, _FENCE = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s{0,3}(```+|~~~+)")
_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def slug(title: str) -> str:
    return re.sub(r"[^\w]+", "-", title.lower()).strip("-")


def packed(text: Column, most: int = MOST_CHARS) -> Column:
    """Paragraphs of a text put together, in order, into parts of at most `most` characters; a longer paragraph is cut at that size."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))))

    def put(parts: Column, piece: Column) -> Column:
        last = F.element_at(parts, -1)
        joined = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(last, F.lit("\n\n"), piece)))
        return F.when((F.size(parts) > 0) & (F.length(F.try_element_at(parts, F.lit(-1))) + 2 + F.length(piece) <= most), joined).otherwise(F.concat(parts, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), put)


def sections(text: str) -> list[tuple[str, str, int, str]]:
    """(breadcrumb, slug, occurrence, text) of each section with text: front matter and comments are left out, headings in fences are text."""
    text = re.sub(r"\A---\n.*?\n---\s*(?:\n|\Z)", "", text, count=1, flags=re.S)
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    stack: list[tuple[int, str]] = []
    found: list[tuple[str, list[str]]] = [("", [])]
    fence = ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark:
            fence = "" if fence and mark[1].startswith(fence) else fence or mark[1][:3]
        head = None if fence or mark else _HEADING.match(line)
        if head:
            level = len(head[1])
            stack = [s for s in stack if s[0] < level] + [(level, head[2])]
            found.append((" > ".join(t for _, t in stack), []))
        else:
            found[-1][1].append(line)
    out, seen = [], {}
    for crumb, lines in found:
        body = "\n".join(lines)
        if body.strip():
            name = slug(crumb)
            seen[name] = seen.get(name, 0) + 1
            out.append((crumb, name, seen[name], body))
    return out


def document_sections(df: DataFrame, key: str, text: str, most: int = MOST_CHARS) -> DataFrame:
    """`key, ordinal, breadcrumb, slug, occurrence, part, text, links` of Markdown texts; null and empty texts have none.

    The parser keeps state from line to line, so it runs in Arrow batches, one row a document; parts are packed by column functions.
    Documents are independent and nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "sections": [[dict(zip(("breadcrumb", "slug", "occurrence", "body"), s, strict=True)) for s in sections(t or "")] for t in b["text"]]})

    kind = dict(df.dtypes)[key]
    read = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, sections array<struct<breadcrumb string, slug string, occurrence int, body string>>")
    parted = lambda s: F.transform(packed(s["body"], most), lambda p, k: F.struct(s["breadcrumb"].alias("breadcrumb"), s["slug"].alias("slug"), s["occurrence"].alias("occurrence"), (k + 1).alias("part"), p.alias("text")))
    rows = read.select("key", F.posexplode(F.flatten(F.transform("sections", parted))).alias("pos", "p"))
    links = F.regexp_extract_all("p.text", F.lit(_LINK), 1)
    return rows.select(F.col("key").alias(key), (F.col("pos") + 1).alias("ordinal"), "p.breadcrumb", "p.slug", "p.occurrence", "p.part", "p.text", links.alias("links"))


def turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key, turn, user_content, assistant_content, content_hash`: each user's line that an assistant's line follows; a repeated exchange counts once."""
    lines = F.split(F.col(text), "\n")
    pairs = df.select(F.col(key).alias("key"), F.posexplode(F.arrays_zip(lines.alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))).alias("turn", "p"))
    spoken = pairs.where(F.col("p.a").startswith("User: ") & F.col("p.b").startswith("Assistant: "))
    rows = spoken.select("key", F.col("turn").cast("bigint").alias("turn"), F.substring("p.a", 7, 1 << 30).alias("user_content"), F.substring("p.b", 12, 1 << 30).alias("assistant_content"))
    hashed = rows.withColumn("content_hash", F.md5(F.concat_ws("|", "user_content", "assistant_content")))
    return hashed.groupBy("key", "content_hash").agg(F.min_by(F.struct("turn", "user_content", "assistant_content"), "turn").alias("v")).select(F.col("key").alias(key), "v.*", "content_hash")


def tool_executions(messages: DataFrame) -> DataFrame:
    """Calls with their results and the user's last words before them, from `session_id, messages` (role, content, tool_call_id, tool_calls)."""
    rows = messages.select("session_id", F.posexplode("messages").alias("place", "m"))
    called = rows.select("session_id", "place", F.explode("m.tool_calls").alias("c")).select("session_id", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"))
    results = rows.where("m.role = 'tool'").groupBy("session_id", F.col("m.tool_call_id").alias("call_id")).agg(F.max_by("m.content", "place").alias("result"))
    said = rows.where("m.role = 'user'").select("session_id", F.col("place").alias("said_at"), F.col("m.content").alias("words"))
    before = called.join(said, "session_id").where("said_at < place").groupBy("session_id", "call_id").agg(F.max_by("words", "said_at").alias("user_words"))
    return called.join(results, ["session_id", "call_id"], "left").join(before, ["session_id", "call_id"], "left").select("session_id", "call_id", "tool", "arguments", "result", "user_words", F.coalesce(F.col("result").rlike('(?i)traceback|"?exit_code"?\\s*[:=]\\s*[1-9]'), F.lit(False)).alias("failed"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labels from JSON lines under a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, fields in the order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def packed_vector(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def unpacked_vector(blob: Column) -> Column:
    """The floats of `packed_vector`; a length that is no multiple of four gives an empty vector."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4") if len(x) % 4 == 0 else np.zeros(0, "f4"))

    return unpack(blob)


def missing(df: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows that still need what `have` holds for others, such as a vector."""
    return df.join(have.select(key).distinct(), key, "left_anti")


def synthetic_facts(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """`label, project, attribute, value, content`: seeded facts, eight attributes a project; the same for every number of partitions."""
    names = F.array(*map(F.lit, "owner region port version backup channel schedule review".split()))
    ids = spark.range(n)
    project = F.format_string("project-%05d", F.floor(F.col("id") / 8))
    attribute = F.element_at(names, (F.col("id") % 8 + 1).cast("int"))
    value = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id")), 1, 8)
    return ids.select(F.format_string("fact-%05d", "id").alias("label"), project.alias("project"), attribute.alias("attribute"), value.alias("value"), F.concat_ws(" ", F.lit("The"), attribute, F.lit("of"), project, F.lit("is"), value).alias("content"))
