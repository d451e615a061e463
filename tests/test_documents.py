"""Sources of documents and turns, their sinks, and the streaming jobs."""

import json
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from evimem.sources import documents as D
from evimem.streaming import rollups as S


def test_markdown_tree(spark, tmp_path):
    for name, data in {"a.md": b"# One\ntext", "sub/b.md": b"bad \xff byte", ".hidden/c.md": b"x", "templates/d.md": b"x", "big.md": b"x" * 500, "e.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r for r in D.markdown_files(spark, str(tmp_path), 100).collect()}
    assert set(got) == {"a.md", "b.md"} and got["b.md"]["text"] == "bad � byte" and len(got["a.md"]["digest"]) == 64


def test_manifest_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, digest string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, digest string")
    assert {tuple(r) for r in D.manifest_changes(old, new, "path", "digest").collect()} == {("a", "removed"), ("b", "changed"), ("c", "unchanged"), ("d", "new")}


NOTE = """---
project: x
---
lead <!-- hidden -->
# Top
see [[Other Note#part|that]] and [[Third]]
```
# not a heading
```
## Sub
one
## Sub
two
# Empty
"""


def test_sections(spark):
    df = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as slug")
    got = [(r["doc_id"], r["breadcrumb"], r["slug"], r["occurrence"], r["part"]) for r in D.document_sections(df, "doc_id", "text").orderBy("ordinal").collect()]
    assert got == [(1, "", "", 1, 1), (1, "Top", "top", 1, 1), (1, "Top > Sub", "top-sub", 1, 1), (1, "Top > Sub", "top-sub", 2, 1)]
    top = D.document_sections(df, "doc_id", "text").where("breadcrumb = 'Top'").first()
    assert top["links"] == ["Other Note", "Third"] and "# not a heading" in top["text"]


def test_parts_keep_all_text(spark):
    cut = lambda text, most: spark.createDataFrame([(text,)], "t string").select(D.packed(F.col("t"), most)).first()[0]
    text = "a" * 25 + "\n\n" + "b" * 4 + "\n\n" + "c" * 4 + "\n\n\n" + "d" * 9
    parts = cut(text, 10)
    assert parts == ["a" * 10, "a" * 10, "a" * 5, "bbbb\n\ncccc", "d" * 9] or parts == ["a" * 10, "a" * 10, "aaaaa", "bbbb\n\ncccc", "d" * 9]
    assert all(len(p) <= 10 for p in parts)
    assert cut("", 10) == []


def test_turns(spark):
    text = "User: hi\nAssistant: ho\nUser: hi\nAssistant: ho\nUser: alone\nUser: last\nAssistant: yes"
    got = D.turns(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert {(r["turn"], r["user_content"], r["assistant_content"]) for r in got} == {(0, "hi", "ho"), (5, "last", "yes")}


def test_tool_executions(spark):
    call = lambda i, n: {"id": i, "name": n, "arguments": "{}"}
    rows = [("s", [("user", "build it", None, None), ("assistant", None, None, [call("1", "make"), call("2", "test")]), ("tool", '{"exit_code": 2}', "1", None), ("assistant", "x", None, None)]), ("e", []), ("n", None)]
    schema = "session_id string, messages array<struct<role string, content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string>>>>"
    got = {r["call_id"]: (r["tool"], r["user_words"], r["result"], r["failed"]) for r in D.tool_executions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("make", "build it", '{"exit_code": 2}', True), "2": ("test", "build it", None, False)}


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("q", 1)], "b string, a int")
    line = D.as_json_lines(df).collect()[0][0]
    assert line == '{"a":1,"b":"q"}' and json.loads(line) == {"a": 1, "b": "q"}
    (tmp_path / "x.jsonl").write_text(line + "\n")
    assert D.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()[0]["b"] == "q"
    (tmp_path / "y.jsonl").write_text('{"a": "no number"}\n')
    with pytest.raises(Exception):
        D.json_lines(spark, str(tmp_path / "y.jsonl"), "a int, b string").collect()


def test_vectors_pack_and_unpack(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    got = df.select("v", D.unpacked_vector(D.packed_vector(df["v"])).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in got)


def test_stream_is_the_batch(spark, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    for k, rows in enumerate([[(1, at(1, 1), "a", 1.0), (2, at(1, 5), "b", 2.0)], [(3, at(2, 1), "a", 3.0), (1, at(1, 1), "a", 1.0)], [(4, at(1, 23), "a", 5.0)]]):
        spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, kind string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"t{k}"))
    folder = tmp_path / "all.parquet"
    folder.mkdir()
    for k in range(3):
        for f in (tmp_path / f"t{k}").glob("*.parquet"):
            f.rename(folder / f"{k}-{f.name}")
    stream = {tuple(r) for r in S.daily_rollup(spark, str(folder), "ts", "kind", "value").collect()}
    batch = {tuple(r) for r in S.daily_columns(spark.read.parquet(str(folder)), "ts", "kind", "value").collect()}
    assert stream == batch and len(batch) == 3
    assert {tuple(r) for r in S.counted_once(spark, str(folder), "id", "ts", "kind").collect()} == {("a", 3), ("b", 1)}
