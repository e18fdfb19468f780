"""Documents with a header, read under a schema.

A header is the lines between two lines of three dashes, each ``field: value``. Texts stand
with or without quotes, lists in one line between brackets; a text in place of a list, a
number in place of a text and so on are errors. A document with an error has its fields all
the same, null where they don't fit, so that a reader can tell what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import text as X

#: Fields of a header with their kinds; those of NEEDED must be there.
FIELDS = {"title": "text", "description": "text", "pubDate": "date", "updatedDate": "date", "draft": "flag", "author": "text", "venues": "texts", "heroImage": "text", "aiGenerated": "flag"}
NEEDED = ("title", "description", "pubDate")
NAMES = {"pubDate": "pub_date", "updatedDate": "updated_date", "heroImage": "hero_image", "aiGenerated": "ai_generated"}
#: What a text without quotes must not be: nothing, null, a flag, a number, a date, or the begin of something else.
NO_TEXT = r"(?i)^(|~|null|true|false|[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?|\d{4}-\d\d-\d\d.*|[\[\]{}&*!|>%@`\"'].*)$"
#: A comma that isn't between quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _unquoted(raw: Column) -> Column:
    """The text that a value stands for, null if it isn't one."""
    double = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    single = F.replace(F.regexp_extract(raw, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(raw.rlike('^".*"$'), double).when(raw.rlike("^'.*'$"), single).when(~raw.rlike(NO_TEXT), raw)


def _texts(raw: Column) -> Column:
    inside = F.trim(F.regexp_extract(raw, r"(?s)^\[(.*)\]$", 1))
    parts = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inside, COMMA), lambda x: _unquoted(F.trim(x))))
    return F.when(raw.rlike(r"^\[.*\]$") & ~F.exists(parts, lambda x: x.isNull()), parts)


def _value(raw: Column, kind: str) -> Column:
    if kind == "text":
        return _unquoted(raw)
    if kind == "texts":
        return _texts(raw)
    if kind == "flag":
        return F.when(raw.isin("true", "True", "TRUE"), True).when(raw.isin("false", "False", "FALSE"), False)
    return F.try_to_timestamp(F.coalesce(_unquoted(raw), raw))


def entries(docs: DataFrame, text: str = "text", author: str = "Editors") -> DataFrame:
    """``docs`` with the fields of their texts' headers, ``body`` and ``errors`` (field:missing, field:kind).

    Absent fields have their defaults: no draft, not generated, ``author``, no venues. A
    text without a header lacks all that is needed and is all body; so is a null one, with
    an empty body. Columns of these names in ``docs`` are replaced.
    """
    parts = docs.withColumn("_front", X.frontmatter(F.col(text)))
    raw = {f: F.regexp_extract(F.coalesce("_front.header", F.lit("")), rf"(?m)^\s*{f}:[ \t]*(.*?)\s*$", 1) for f in FIELDS}
    there = {f: F.coalesce(F.col("_front.header").rlike(rf"(?m)^\s*{f}:"), F.lit(False)) for f in FIELDS}
    parts = parts.withColumns({f"_raw_{f}": F.when(there[f], raw[f]) for f in FIELDS})
    parts = parts.withColumns({f"_val_{f}": _value(F.col(f"_raw_{f}"), kind) for f, kind in FIELDS.items()})
    wrong = [F.when(F.col(f"_raw_{f}").isNotNull() & F.col(f"_val_{f}").isNull(), f"{f}:{kind}") for f, kind in FIELDS.items()]
    missing = [F.when(F.col(f"_raw_{f}").isNull(), f"{f}:missing") for f in NEEDED]
    default = {"draft": F.lit(False), "aiGenerated": F.lit(False), "author": F.lit(author), "venues": F.array().cast("array<string>")}
    value = {f: F.when(F.col(f"_raw_{f}").isNull(), default[f]).otherwise(F.col(f"_val_{f}")) if f in default else F.col(f"_val_{f}") for f in FIELDS}
    body = F.coalesce("_front.body", text, F.lit(""))
    found = {**{NAMES.get(f, f): v for f, v in value.items()}, "body": body, "errors": F.array_compact(F.array(*missing, *wrong))}
    # behind a generator, so that a filter on a field isn't written out over the text once for each use of it
    one = F.inline(F.array(F.struct(*[v.alias(c) for c, v in found.items()])))
    return parts.select(*[c for c in docs.columns if c not in found], one)


def published(found: DataFrame) -> DataFrame:
    """Entries that may be shown: without errors, and no drafts."""
    return found.where((F.size("errors") == 0) & ~F.col("draft"))


def of_venues(found: DataFrame, venues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(venue_id, key, pub_date) of published entries that name a venue by its slug; a venue that is named twice counts once."""
    named = published(found).select(key, "pub_date", F.explode(F.array_distinct("venues")).alias("slug"))
    return named.join(venues.select("venue_id", X.slugify(F.col("name")).alias("slug")), "slug").select("venue_id", key, "pub_date")
