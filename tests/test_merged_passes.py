from srcgraph.plans.analyze import tagged_rows


def test_merged_mode_reads_the_line_parser_once(spark):
    files = spark.createDataFrame([("r", "a.py", "import os\ndef f(x):\n    if x: g()\nclass A(B): pass\n")], "repo_id string, path string, content string")
    rows = tagged_rows(files, "merged")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Union") for line in plan.splitlines()) == 1
    # two branches read the text: the scoped parser and the line parser
    assert sum("LogicalRDD" in line or "LocalRelation" in line or "Scan ExistingRDD" in line for line in plan.splitlines()) == 2
    got = sorted((r.tag, r.kind, r["name"], r.complexity, r.pos.n) for r in rows.where("tag = 'lfunc' OR kind = 'module'").collect())
    assert got == [("lfunc", "function", "f", 2, 4), ("sym", "module", "os", None, 2147483646)]
