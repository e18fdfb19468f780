"""Texts that are read once, whatever is made of them, and odd ones among them."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as X


def reads(spark, column):
    """How often a column of texts stands in what Spark computes."""
    plan = spark.createDataFrame([("",)], "odd string").select(column.alias("v"))._jdf.queryExecution().analyzed().toString()
    return len(re.findall(r"\bodd#", plan.split("LogicalRDD")[0].split("LocalRelation")[0]))


@pytest.mark.parametrize("column", [lambda x: X.draft(x), lambda x: X.draft(x).body, lambda x: X.drop_header_field(X.set_header_field(X.set_header_field(x, "a", F.lit("1")), "b", F.lit("2")), "c"), lambda x: X.frontmatter(x)])
def test_a_text_is_computed_once(spark, column):
    assert reads(spark, column(F.col("odd"))) == 1


SPACE = r"\s   -     　﻿"


def drafted(x):
    """The same by regular expressions over the whole text."""
    strip = lambda t: re.sub(f"^[{SPACE}]+|[{SPACE}]+\\Z", "", t)
    found = re.search(r"(?s)```(?:\w+)?\s*(.*?)\s*```", x or "", re.ASCII)
    text = strip(found[1] if found else x or "")
    head, mark, body = text.partition("---BODY---")
    if not mark:
        return (None, None, None, "missing_body_marker")
    body = re.sub(f"[{SPACE}]+\\Z", "", re.sub(r"\A\r?\n", "", body))
    field = lambda name: (m := re.search(rf"(?m)^\s*{name}:\s*(.+)$", head)) and strip(m[1]) or None
    out = (field("TITLE"), field("DESCRIPTION"), body)
    return (None, None, None, "missing_field") if not all(out) else (*out, None)


def test_odd_drafts(spark):
    plain = "TITLE: t\nDESCRIPTION: d\n---BODY---\n\n b \n"
    odd = [plain, f"```\n{plain}```", f"x ```md  {plain} \n``` y ``` z ```", f"```{plain}", f"``` {plain.replace('b', '``')} ```", "``````", f"````{plain}````", "```md```", f"```md{plain}```", f"　```md\n{plain} ```", "---BODY---", "TITLE: \nDESCRIPTION: d\n---BODY---x", "", None, "TITLE: t\nDESCRIPTION: d\n---BODY---\r\nx---BODY---"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", X.draft(F.col("x")).alias("d")).select("i", "d.*").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [drafted(x) for x in odd]


def test_searched_texts_need_no_python(spark):
    """Every character beyond ASCII by itself and between letters, as its compatible form without accents."""
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [c for k in range(0, len(chars), 4096) for c in ["a".join(chars[k : k + 4096])]] + ["É1½ ﬁx", "éá֑b", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", X.normalise_search(F.col("x")).alias("v"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    want = ["".join(c for c in unicodedata.normalize("NFKD", x or "") if not "̀" <= c <= "ͯ") for x in texts]
    want = [re.sub("[^a-z0-9]+", " ", w.lower()).strip(" ") for w in want]
    assert [r["v"] for r in df.orderBy("i").collect()] == want
