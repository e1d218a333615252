"""The command line and the tool server."""

import io
import json

from pyspark.sql import functions as F

from lodegraph import cli


def test_commands_and_server(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def first():\n    return second()\n\n\ndef second():\n    return 1\n")
    base = ["--store", f"file://{tmp_path}/store", "--source", str(tree)]

    def run(*words, lines=()):
        out = io.StringIO()
        cli.run(cli.parser().parse_args([*base, *words]), spark, out, lines)
        return out.getvalue()

    assert "ready" in run("init")
    assert json.loads(run("index"))["added"] == 1
    assert json.loads(run("sync"))["unchanged"] == 1
    assert "second" in run("query", "sec", "--kind", "function") and "second" in run("semantic", "second")
    assert "nodes: 2" in run("status") and "python" in run("overview")
    assert "first" in run("context", "second task", "--style", "compact")
    assert "first" in run("tool", "callers", '{"name": "second"}')
    asked = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "callees", "arguments": {"name": "first"}}}, {"method": "notifications/initialized"}, {"id": 4, "method": "nothing"}, {"id": 5, "method": "tools/call", "params": {"name": "callees", "arguments": {"no": 1}}}, {"id": 6, "method": "ping"}]
    replies = [json.loads(x) for x in run("serve", lines=[json.dumps(m) + "\n" for m in asked] + ["{\n", "\n"]).splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None]
    tools = {t["name"]: t["inputSchema"] for t in replies[1]["result"]["tools"]}
    assert len(tools) == 16 and tools["callers"]["required"] == ["name"] and tools["callers"]["properties"]["limit"]["type"] == "integer"
    assert "second" in replies[2]["result"]["content"][0]["text"]
    assert [r.get("error", {}).get("code") for r in replies[3:]] == [-32601, -32603, None, -32700]
    log = spark.range(1).select(F.lit("b.py").alias("path"), F.lit("add").alias("op"), F.timestamp_millis(F.lit(1000)).alias("ts"), F.lit("def third():\n    pass\n").alias("content"))
    log.union(log.withColumn("path", F.lit("z.py")).withColumn("ts", F.timestamp_millis(F.lit(900000)))).write.json(f"{tmp_path}/log")
    run("watch", f"{tmp_path}/log", f"{tmp_path}/checkpoint", "--once")
    assert "third" in run("query", "third")
