"""Payloads of the feed of live campaigns: one bad element rejects a payload as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import temporal as T, text as X
from tidepool.sources.domain import KINDS

#: The largest integer that a JSON number holds exactly.
SAFE = 2**53 - 1


def _kind(x: Column, path: str) -> Column:
    """The kind of what stands at a path (STRING, BOOLEAN, VOID, ...), null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(x, path, "variant"))


def _is(x: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(x, path).startswith(kind), F.lit(False))


def _text(x: Column, path: str) -> Column:
    """The text at a path; null for anything else."""
    return F.when(_is(x, path, "STRING"), F.try_variant_get(x, path, "string"))


def _filled(x: Column, path: str) -> Column:
    return X.clean(_text(x, path)) != ""


def _id(x: Column, path: str) -> Column:
    """The safe positive integer at a path, however it is written; null for anything else."""
    long = F.try_variant_get(x, path, "long")
    number = F.when(_is(x, path, "DECIMAL") | _is(x, path, "DOUBLE"), F.try_variant_get(x, path, "decimal(38,6)"))
    whole = F.when(number.between(1, SAFE) & (number == F.floor(number)), number.cast("long"))
    return F.when(_is(x, path, "BIGINT"), F.when(long.between(1, SAFE), long)).otherwise(whole)


def valid(x: Column) -> Column:
    """Whether an element is a live campaign as it is shown in public; never null."""
    # texts and instants are bound to one row, as they cost more to read than to compare
    texts = F.array(F.struct(*[_text(x, f"$.{c}").alias(c) for c in ("startsAt", "endsAt", "effectiveEndsAt")]))
    times = F.transform(texts, lambda t: F.struct(*[T.parse_instant(t[c]).alias(c) for c in ("startsAt", "endsAt", "effectiveEndsAt")]))
    code = _kind(x, "$.dealCode")
    rules = [
        _filled(x, "$.id"), _id(x, "$.venueId") == _id(x, "$.venue.id"), _filled(x, "$.venue.name"), _filled(x, "$.venue.slug"), _is(x, "$.venue.neighborhood", "STRING"), _is(x, "$.venue.image", "STRING"),
        _text(x, "$.type").isin(*KINDS), _filled(x, "$.title"), _is(x, "$.description", "STRING"), _text(x, "$.state") == "live", _is(x, "$.hasDealCode", "BOOLEAN"),
        F.when(F.try_variant_get(x, "$.hasDealCode", "boolean"), code.isNull() | _filled(x, "$.dealCode")).otherwise(code.isNull() | (code == "VOID")),
        F.exists(times, lambda t: (t["startsAt"] < t["effectiveEndsAt"]) & (t["effectiveEndsAt"] <= t["endsAt"])),
    ]
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def judged(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``payloads`` with ``reason`` (malformed: no JSON, no server time or no list; invalid: an element isn't valid; else null) and ``elements``, null unless it is accepted. A null payload is malformed, an empty list is accepted."""
    parsed = payloads.withColumn("_json", F.try_parse_json(payload))
    shaped = _is(F.col("_json"), "$.serverNow", "STRING") & _is(F.col("_json"), "$.promotions", "ARRAY")
    listed = parsed.withColumn("elements", F.when(shaped, F.try_variant_get("_json", "$.promotions", "array<variant>")))
    bad = F.exists("elements", lambda x: ~F.coalesce(valid(x), F.lit(False)))
    reason = F.when(F.col("elements").isNull(), "malformed").when(bad, "invalid")
    return listed.withColumn("reason", reason).withColumn("elements", F.when(F.col("reason").isNull(), F.col("elements"))).drop("_json")


def promotions(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """The campaigns of accepted payloads (keys, id, venue_id, type, title, starts_at, effective_end), and one row with ``reason`` for each rejected one; an accepted empty one has a row of nulls."""
    rows = judged(payloads, payload).select(*keys, "reason", F.explode_outer("elements").alias("e"))
    at = lambda c: T.parse_instant(_text(F.col("e"), f"$.{c}"))
    return rows.select(*keys, "reason", _text(F.col("e"), "$.id").alias("id"), _id(F.col("e"), "$.venueId").alias("venue_id"), _text(F.col("e"), "$.type").alias("type"), _text(F.col("e"), "$.title").alias("title"), at("startsAt").alias("starts_at"), at("effectiveEndsAt").alias("effective_end"))
