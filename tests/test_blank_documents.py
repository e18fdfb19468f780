"""Documents of which cleaning leaves nothing, as larger tables have them."""

import duckdb
from oracle import rows

from tidepool.plans import media  # noqa: F401
from tidepool.plans.registry import QUERIES, SQL


def test_markdown_of_documents_without_a_word(spark, tmp_path):
    texts = ["", "2024", " \n ", "привет, мир!", "12 ab", "7 8 9", "a\n\nb - c 1. d", "\t3. x", None]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["str_markdown_block"](spark, str(tmp_path)).toArrow()
    assert rows(got) == rows(con.execute(SQL["str_markdown_block"]).to_arrow_table())
    assert [r["value"].endswith("<p> end</p>") for r in sorted(got.to_pylist(), key=lambda r: r["doc_id"])[:4]] == [True] * 4
