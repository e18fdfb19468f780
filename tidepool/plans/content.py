"""Queries of documents with headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.functions import text as X
from tidepool.plans.registry import register
from tidepool.plans.relational import _SLUG
from tidepool.sources import content
from tidepool.sources.domain import Domain


def posts(d: Domain) -> DataFrame:
    """(doc_id, text): documents under headers of all forms, some with an error, every thirteenth without a header; each names a venue twice, one that isn't there, or none."""
    k = F.col("doc_id")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    of = lambda n, r: k % n == r
    number, slug = k.cast("string"), X.slugify(F.coalesce("name", F.lit("")))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 900).cast("int")), "yyyy-MM-dd")
    lines = [
        F.when(of(13, 1), None).when(of(13, 5), "title: 12").when(of(13, 7), line("title:  Plain: ", number, " ")).otherwise(line('title: "A \\"', number, '\\""')),
        F.lit("description: 'it''s'"),
        F.when(of(13, 2), "pubDate: soon").otherwise(line("pubDate: ", day)),
        F.when(of(10, 4), 'updatedDate: "2026-02-30"').when(of(10, 5), "updatedDate: 2026-02-03T10:00:00Z"),
        F.when(of(13, 3), 'draft: "yes"').when(of(3, 0), "draft: true").when(of(3, 2), "draft: false"),
        F.when(of(4, 0), "author: Ann, B."),
        F.when(of(13, 4), "venues: 7").when(of(5, 0), None).when(of(5, 1), "venues: []").when(of(5, 2), line("venues: [one, ", slug, "]")).otherwise(line('venues: ["', slug, '", "a, b", "', slug, '"]')),
        F.when(of(7, 0), "aiGenerated: true"),
    ]
    header = F.array_join(F.array_compact(F.array(*lines)), "\n")
    n = d.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
    docs = d.raw("documents").crossJoin(F.broadcast(n)).withColumn("venue_id", k % F.col("n") + 1)  # one row
    named = docs.join(d.venues().select("venue_id", "name"), "venue_id", "left")
    body = F.coalesce("text", F.lit(""))
    return named.select("doc_id", F.when(of(13, 6), body).otherwise(F.concat(F.lit("---\n"), header, F.lit("\n---\n"), body)).alias("text"))


#: The same fields and errors, from the number of a document alone.
_POSTS = f"""posts AS (SELECT doc_id, doc_id % 13 = 6 AS bare, doc_id % 13 AS k, {_SLUG} AS slug, coalesce(text, '') AS body, DATE '2024-01-01' + (doc_id % 900)::INT AS day
  FROM documents, (SELECT count(*) AS n FROM supplier) JOIN (SELECT venue_id, name FROM venues) v ON v.venue_id = doc_id % n + 1),
  read AS (SELECT doc_id, slug, body, CASE WHEN bare OR k IN (1, 5) THEN NULL WHEN k = 7 THEN 'Plain: ' || doc_id ELSE 'A "' || doc_id || '"' END AS title, CASE WHEN NOT bare THEN 'it''s' END AS description, CASE WHEN NOT bare AND k <> 2 THEN day END AS pub_date,
    CASE WHEN bare OR doc_id % 10 <> 5 THEN NULL ELSE '2026-02-03 10:00' END AS updated, CASE WHEN bare THEN false WHEN k = 3 THEN NULL ELSE doc_id % 3 = 0 END AS draft, CASE WHEN NOT bare AND doc_id % 4 = 0 THEN 'Ann, B.' ELSE 'Editors' END AS author,
    CASE WHEN bare THEN '' WHEN k = 4 THEN NULL WHEN doc_id % 5 < 2 THEN '' WHEN doc_id % 5 = 2 THEN 'one|' || slug ELSE slug || '|a, b|' || slug END AS venues, NOT bare AND doc_id % 7 = 0 AS ai_generated,
    concat_ws(',', CASE WHEN bare OR k = 1 THEN 'title:missing' END, CASE WHEN bare THEN 'description:missing' END, CASE WHEN bare THEN 'pubDate:missing' END, CASE WHEN k = 5 THEN 'title:text' END, CASE WHEN k = 2 THEN 'pubDate:date' END,
      CASE WHEN NOT bare AND doc_id % 10 = 4 THEN 'updatedDate:date' END, CASE WHEN k = 3 THEN 'draft:flag' END, CASE WHEN k = 4 THEN 'venues:texts' END) AS errors FROM posts)"""


@register("scan_content_collection", f"WITH {_POSTS} SELECT doc_id, title, description, strftime(pub_date, '%Y-%m-%d') AS pub_date, updated, draft, author, venues, NULL::VARCHAR AS hero_image, ai_generated, md5(body) AS body, errors FROM read")
def _(d: Domain) -> DataFrame:
    """Every document's typed header with defaults, its body, and what doesn't fit the schema."""
    found = content.entries(posts(d))
    at = lambda c, f: F.date_format(c, f)
    return found.select("doc_id", "title", "description", at("pub_date", "yyyy-MM-dd").alias("pub_date"), at("updated_date", "yyyy-MM-dd HH:mm").alias("updated"), "draft", "author", F.array_join("venues", "|").alias("venues"), "hero_image", "ai_generated", F.md5("body").alias("body"), F.array_join("errors", ",").alias("errors"))


@register("filter_published_docs", f"WITH {_POSTS} SELECT venue_id, doc_id, strftime(pub_date, '%Y-%m-%d') AS pub_date FROM read JOIN (SELECT venue_id, {_SLUG} AS slug FROM venues) USING (slug) WHERE errors = '' AND NOT draft AND venues <> ''")
def _(d: Domain) -> DataFrame:
    """The published documents of every venue: no draft, no error, and its slug among those that the header names."""
    return content.of_venues(content.entries(posts(d)), d.venues()).select("venue_id", "doc_id", F.date_format("pub_date", "yyyy-MM-dd").alias("pub_date"))
