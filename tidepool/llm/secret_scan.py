"""Secrets in texts: fixed patterns, and windows of high entropy per character class.

Everything is a DataFrame expression over one row's text, so there is no shuffle and no
Python on the executors. A pattern's matches are placed by cutting the text at them: what
stands between matches and the matches themselves have lengths, whose running sums are
the places. Sums run in blocks of BLOCK, so a text with many matches takes time in
proportion to them, not to their square.

Candidates of a character class are its maximal strings of at least one window. A window
slides over a candidate, and the number of times that each character stands in it is kept
in an array: a step adds the character that enters and takes off the one that leaves, and
moves the sum of c * log2(c) by the differences at those two counts. The entropy of a
window of w characters is log2(w) - sum / w; the sum is held in millionths, as a whole
number, so no rounding adds up. Windows of at least the class's entropy that meet are one
span. A candidate that looks like something harmless, or is listed as such, is suppressed
before any window is counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Kind, pattern, group whose length counts, least length; a cheaper pattern that each passing match fulfils.
#: A match of ``access`` or ``hex`` reaches to the end of its characters, so asking for the least length gives those that pass.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [
    ("assign", ASSIGN, 2, 12, r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
]


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters in which keys are written."""

    kind: str
    #: Its characters, as inside of brackets; of those from + to z.
    characters: str
    #: Characters of a window, and bits of entropy a character from which on it is a secret.
    window: int
    bits: float
    #: What a candidate must hold besides, one pattern each.
    needs: tuple[str, ...] = ()


CLASSES = (
    # random keys of 64 characters have 3.9 to 4.3 bits in a window of 20; names and paths have digits at ends of words only
    CharacterClass("base64", "A-Za-z0-9+/_=-", 20, 3.7, ("[0-9][A-Za-z]", "[A-Z]", "[a-z]")),
    # of lower-case letters alone the pattern ``hex`` finds them already, from 16 on
    CharacterClass("hexadecimal", "0-9A-Fa-f", 20, 3.0, ("[0-9]", "[A-F]")),
)
#: Candidates that are no secrets: ids of records, counting strings, placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)01234567|12345678|abcdefgh|qwertyui",
    r"(?i)example|sample|placeholder|changeme|dummy|lorem",
)
#: Matches whose lengths are summed at once.
BLOCK = 256
#: Counts are kept for characters of these codes.
FIRST, LAST = ord("+"), ord("z")
MILLION = 1_000_000
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _then(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever the result names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """The sums of all lengths before each one, for an array of long."""

    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(values, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")), lambda s: s["before"])

    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v))
        return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))

    return _then(_then(lengths, cut), summed)


def _matches(pattern: str, group: int, whole: Column) -> Column:
    """Matches (start, hit, size) of a pattern, leftmost and without overlap; ``whole`` is a text that isn't null."""

    def placed(p: Column) -> Column:
        # what stands between has one part more than there are matches
        steps = F.zip_with(F.slice(p["between"], 1, F.size(p["hits"])), p["hits"], lambda b, h: (F.length(b) + F.length(h)).cast("long"))
        joined = F.arrays_zip(p["between"].alias("between"), p["hits"].alias("hit"), p["measured"].alias("measured"), running(steps).alias("at"))
        listed = F.transform(joined, lambda x: F.struct((x["at"] + F.length(x["between"])).alias("start"), x["hit"].alias("hit"), F.length(x["measured"]).alias("size")))
        return F.slice(listed, F.lit(1), F.size(p["hits"]))

    hits = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(whole, F.lit(pattern), F.lit(group)) if group else hits
    return _then(F.struct(F.split(whole, pattern, -1).alias("between"), hits.alias("hits"), measured.alias("measured")), placed)


def _entropy_spans(c: CharacterClass, candidate: Column, at: Column, rank: int) -> Column:
    """Spans of the windows of high entropy in one candidate that starts at ``at``."""
    w = c.window
    table = [0] + [round(k * math.log2(k) * MILLION) for k in range(1, w + 2)]
    most = math.floor(w * (math.log2(w) - c.bits) * MILLION)
    weights = F.array(*[F.lit(x).cast("long") for x in table])
    codes = F.transform(F.slice(F.split(candidate, "", -1), F.lit(1), F.length(candidate)), lambda x: F.ascii(x) - FIRST + 1)

    def moved(counts: Column, k: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), k - 1), F.array(F.element_at(counts, k) + by), F.slice(counts, k + 1, F.lit(LAST - FIRST + 1)))

    def weight(count: Column) -> Column:
        return F.element_at(weights, count + 1)

    def enter(s: Column, k: Column) -> Column:
        had = F.element_at(s["counts"], k)
        return F.struct((s["i"] + 1).alias("i"), moved(s["counts"], k, 1).alias("counts"), (s["sum"] + weight(had + 1) - weight(had)).alias("sum"), s["out"].alias("out"))

    def leave(s: Column, codes: Column) -> Column:
        k = F.element_at(codes, s["i"] - w)
        had = F.element_at(s["counts"], k)
        left = F.struct(s["i"].alias("i"), moved(s["counts"], k, -1).alias("counts"), (s["sum"] + weight(had - 1) - weight(had)).alias("sum"), s["out"].alias("out"))
        return F.when(s["i"] > w, left).otherwise(s)

    def judge(s: Column) -> Column:
        # the window's characters are i - w + 1 to i; it meets the span before if that ends at its start or later
        start, end, last = at + s["i"].cast("long") - w, at + s["i"].cast("long"), F.try_element_at(s["out"], F.lit(-1))
        span = F.when(last["end"] >= start, last["start"]).otherwise(start)
        own = F.struct(span.alias("start"), F.lit(rank).alias("rank"), F.lit(c.kind).alias("kind"), end.alias("end"))
        before = F.when(last["end"] >= start, F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1)).otherwise(s["out"])
        high = (s["i"] >= w) & (s["sum"] <= most)
        return F.struct(s["i"].alias("i"), s["counts"].alias("counts"), s["sum"].alias("sum"), F.when(high, F.concat(before, F.array(own))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), LAST - FIRST + 1).alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast(SPAN).alias("out"))
    return _then(codes, lambda own: F.aggregate(own, start, lambda s, k: _then(_then(enter(s, k), lambda e: leave(e, own)), judge), lambda s: s["out"]))


def find(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, listed: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``_spans``: array of (start, rank, kind, end) in code points, end exclusive, by start and then kind as listed.

    Base kinds have ranks 0 to 2, the classes those after them. ``listed`` are candidates that
    are allowed as they stand, a short list. A null text is empty; a row is judged by itself,
    so repeated rows and equal or null doc_ids change nothing; an empty table gives an empty
    one. A given column named ``_spans`` or beginning with ``_scan_`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_spans" and not c.startswith("_scan_")], *[F.when(text.rlike(quick), _matches(pattern, group, text)).alias(f"_scan_{kind}") for kind, pattern, group, _, quick in PATTERNS])
    base = base.withColumn("_scan_base", F.concat(*[F.coalesce(_base_spans(rank, kind, least), none) for rank, (kind, _, _, least, _) in enumerate(PATTERNS)])).drop(*[f"_scan_{kind}" for kind, *_ in PATTERNS])
    wide = base.select("*", *[F.when(_hold(text, (*c.needs, f"[{c.characters}]{{{c.window}}}")), _matches(f"[{c.characters}]{{{c.window},}}", 0, text)).alias(f"_scan_{c.kind}") for c in classes])
    found = [F.coalesce(_class_spans(len(PATTERNS) + k, c, allowed, listed), none) for k, c in enumerate(classes)]
    return wide.withColumn("_spans", F.array_sort(F.concat("_scan_base", *found))).drop("_scan_base", *[f"_scan_{c.kind}" for c in classes])


def _hold(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & text.rlike(p)
    return out


def _base_spans(rank: int, kind: str, least: int) -> Column:
    """Spans of a pattern's matches that are long enough."""
    passing = F.filter(f"_scan_{kind}", lambda m: m["size"] >= least)
    return F.transform(passing, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["hit"])).alias("end")))


def _class_spans(rank: int, c: CharacterClass, allowed: tuple[str, ...], listed: tuple[str, ...]) -> Column:
    """Spans of high entropy in the candidates that hold what the class needs and are nothing that is allowed."""

    def suspect(m: Column) -> Column:
        out = _hold(m["hit"], c.needs)
        if listed:
            out = out & ~m["hit"].isin(*listed)
        for p in allowed:
            out = out & ~m["hit"].rlike(p)
        return out

    return F.flatten(F.transform(F.filter(f"_scan_{c.kind}", suspect), lambda m: _entropy_spans(c, m["hit"], m["start"], rank)))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text, for each row of ``docs``."""
    found = find(docs.select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("_spans", lambda s: s["rank"] < len(PATTERNS))

    def number(rank: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [number(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` of ``find`` with each character of a span replaced, the text otherwise as it was; what overlaps is replaced once."""
    # a place is masked if a span that starts at or before it ends after it: spans are in order, so the furthest end so far is enough
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        begin, end = F.greatest(s["at"], x["start"]), F.greatest(s["at"], x["end"])
        between = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (begin - s["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(s["parts"], F.array(between, F.repeat(F.lit(mask), (end - begin).cast("int")))).alias("parts"))

    def whole(s: Column) -> Column:
        return F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text")))

    return docs.withColumn("text", F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, whole)).otherwise(F.col("text")))


def sql() -> str:
    """The digest of ``documents`` in DuckDB: matches by windows over what stands between them, each window's characters counted anew."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matches(rank: int, kind: str, pattern: str, group: int, where: str) -> str:
        p = quoted(pattern)
        return f"SELECT r, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, {p}) AS b, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {group}) AS g FROM d WHERE {where}"

    def scored(rank: int, c: CharacterClass) -> str:
        w = c.window
        table = [round(k * math.log2(k) * MILLION) for k in range(1, w + 1)]
        harmless = " ".join([*(f"AND regexp_matches(hit, {quoted(p)})" for p in c.needs), *(f"AND NOT regexp_matches(hit, {quoted(p)})" for p in ALLOWED)])
        return f"""SELECT r, rank, kind, s, j FROM (SELECT r, rank, kind, s, hit, unnest(range(0, length(hit) - {w} + 1)) AS j FROM placed WHERE rank = {rank} {harmless})
            WHERE list_sum(list_transform(map_values(list_aggregate(string_split(substr(hit, j + 1, {w}), ''), 'histogram')), lambda c: {table}[c::BIGINT])) <= {math.floor(w * (math.log2(w) - c.bits) * MILLION)}"""

    n = len(PATTERNS)
    whole = [matches(rank, kind, p, group, f"regexp_matches(t, {quoted(p)})") for rank, (kind, p, group, _, _) in enumerate(PATTERNS)]
    whole += [matches(n + k, c.kind, f"[{c.characters}]{{{c.window},}}", 0, f"regexp_matches(t, {quoted(f'[{c.characters}]{{{c.window}}}')})") for k, c in enumerate(CLASSES)]
    least = " OR ".join(f"rank = {rank} AND length(g) >= {size}" for rank, (_, _, _, size, _) in enumerate(PATTERNS))
    wide = " ".join(f"WHEN {n + k} THEN {c.window}" for k, c in enumerate(CLASSES))
    counts = ", ".join(f"count(*) FILTER (rank = {rank}) AS n_{kind}" for rank, (kind, *_) in enumerate(PATTERNS))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(whole)}),
        u AS (SELECT r, rank, kind, unnest(b[1:len(h)]) AS b, unnest(h) AS hit, unnest(g) AS g, unnest(range(len(h))) AS i FROM m),
        placed AS (SELECT r, rank, kind, hit, g, sum(length(b) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i) - length(hit) AS s FROM u),
        high AS ({" UNION ALL ".join(scored(n + k, c) for k, c in enumerate(CLASSES))}),
        wide AS (SELECT *, CASE rank {wide} END AS w FROM high),
        first AS (SELECT *, coalesce(j > lag(j) OVER (PARTITION BY r, rank, s ORDER BY j) + w, true) AS new FROM wide),
        grouped AS (SELECT *, sum(new::INT) OVER (PARTITION BY r, rank, s ORDER BY j) AS part FROM first),
        spans AS (
            SELECT r, rank, kind, s, s + length(hit) AS e FROM placed WHERE {least}
            UNION ALL SELECT r, rank, kind, s + min(j), s + max(j) + min(w) FROM grouped GROUP BY r, rank, kind, s, part
        ),
        joined AS (SELECT r, {counts},
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {n}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM spans GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (r)"""
