"""How often mixing moves the texts."""

from tidepool.llm import mixing


def test_texts_are_shuffled_once(spark):
    rows = [(i, f"word{i} " * (i % 40), [None, "", "web", "book"][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = mixing.repeated(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        join = next(k for k, x in enumerate(lines) if "Join" in x)
        side = lines[join + 1].index(":")
        left = [x for x in lines[join + 1 :] if x[side : side + 1] == ":"]
        assert sum("Exchange" in x for x in left) == 1
        # nor are they written in between
        assert "FileScan" not in "".join(left)
        # a null source and one without a name are two sources
        assert {r["source"] for r in got.collect()} == {None, "", "web", "book"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
