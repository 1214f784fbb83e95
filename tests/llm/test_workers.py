"""Python workers: a stage that runs Python on what Python made holds two of them in each of its tasks."""

import re

from waymark.llm import line_dedup


#: What begins a new stage below it, and what runs Python; grouped Python does both.
SHUFFLED, PYTHON = "Exchange|SortMergeJoin|ShuffledHashJoin|HashAggregate|SortAggregate|ObjectHashAggregate|FlatMap", "MapInArrow|MapInPandas|FlatMap|ArrowEvalPython"


def stacked(df):
    """Python steps in the longest chain of df's plan without a shuffle between them."""
    above, most = [], 0  # of the nodes over the present one: depth, and the Python steps of its stage that what lies below adds to
    for line in df._jdf.queryExecution().sparkPlan().toString().splitlines():
        depth = re.match(r"[\s:|+-]*", line).end()
        while above and above[-1][0] >= depth:
            above.pop()
        n = (above[-1][1] if above else 0) + bool(re.match(PYTHON, line[depth:]))
        above.append((depth, 0 if re.match(SHUFFLED, line[depth:]) else n))
        most = max(most, n)
    return most


def test_no_stage_of_line_dedup_runs_python_on_python(spark, monkeypatch):
    seen, stage, bit_table = {}, line_dedup.stage, line_dedup.bit_table

    def noted(df, tag):
        seen[tag] = max(seen.get(tag, 0), stacked(df))
        return stage(df, tag)

    def tabled(values, *size):
        seen["table"] = max(seen.get("table", 0), stacked(values) + 1)
        return bit_table(values, *size)

    monkeypatch.setattr(line_dedup, "stage", noted)
    monkeypatch.setattr(line_dedup, "bit_table", tabled)
    words = [f"w{k}" for k in range(60)]
    lines = [" ".join(words), " ".join(words), " ".join([*words[:59], "x"]), "a b c d", "\n".join(["", "e f g h i", "A  b c D"])]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.removed_lines(rows).select("doc_id", "line_no").collect()) == [(1, 0), (2, 0), (4, 2)]
    assert seen.pop("line-tokens") == 1 and max(seen.values()) == 1, seen
