"""Text cleaning, search keys, labels and checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, functions as F

#: White space of all kinds, also the non-breaking and zero-width ones.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Patterns of clock, e-mail, phone, URL, stored image and id checks.
TIME, EMAIL, PHONE = r"^([01]\d|2[0-3]):[0-5]\d$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^\+?[0-9()\-.\s]{7,20}$"
URL, STORED_IMAGE, OWN_IMAGE = r"(?i)^https?://", r"(?i)^(/[^/]|https?://)", r"^/api/images/[^/]+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it; Spark writes a column out again wherever it is used under a condition."""
    return F.transform(F.array(x), f)[0]


def clean(x: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.coalesce(F.btrim(x, F.lit(SPACES)), F.lit(""))


def clean_list(x: Column) -> Column:
    """Parts between line breaks or commas, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[\\n,]"), clean), lambda y: y != "")


def slugify(x: Column, most: int | None = None) -> Column:
    dashed = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, most), "-+$", "") if most else slug


@cache
def _spelled() -> tuple[dict[str, str], dict[str, str]]:
    """What characters beyond ASCII are in lower-case letters and digits: one, or none at all for an accent, and those that are several; of all others nothing is left."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x110000)):
        if not (unicodedata.decomposition(c) or "\u0300" <= c <= "\u036f"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f").lower()
        plain = re.sub("[^a-z0-9]+", " ", plain)
        if plain != " ":
            (one if len(plain) < 2 else several)[c] = plain
    return one, several


def _unaccented(x: Column) -> Column:
    """Letters and digits of compatible characters, without accents; what has neither stays as it is."""
    one, several = _spelled()
    ordered = sorted(one, key=lambda c: one[c] == "")  # what has no counterpart goes
    ranges: list[list[str]] = []
    for c in sorted(several):
        # letters of common languages lie between the first ones and must not be taken for them
        if ranges and ord(c) - ord(ranges[-1][1]) <= (64 if c > "\u2000" else 1):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    near = "[" + "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in ranges) + "]"
    known = F.create_map(*[F.lit(v) for kv in several.items() for v in kv])
    letter = lambda c: F.when(c.rlike(near), F.coalesce(F.element_at(known, c), c)).otherwise(c)
    spelled = lambda t: F.when(t.rlike(near), F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1)), letter), "")).otherwise(t)
    return F.translate(let(x, spelled), "".join(ordered), "".join(one[c] for c in ordered))


def normalise_search(x: Column) -> Column:
    """Lower case without accents, words apart by single spaces; null is empty. All in the JVM."""
    plain = let(F.coalesce(x, F.lit("")), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), _unaccented(t)).otherwise(t))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def extract_domain(x: Column) -> Column:
    """Host of an address or URL, without scheme, user and leading www."""
    host = F.substring_index(F.regexp_replace(F.lower(clean(x)), "^[a-z]+://", ""), "/", 1)
    return F.regexp_replace(F.element_at(F.split(host, "@"), -1), "^www\\.", "")


def labelize(x: Column) -> Column:
    """A capital after every word boundary, the rest as it is."""
    parts = F.regexp_extract_all(x, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def escape_html(x: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#39;")] if quotes else [])
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def format_time(x: Column) -> Column:
    """15:00 as 3:00 PM."""
    h = F.substring(x, 1, 2).cast("int")
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.substring(x, 4, 2), F.when(h < 12, " AM").otherwise(" PM"))


def format_distance(miles: Column) -> Column:
    return F.when(miles < 0.1, "Nearby").when(miles < 1, F.concat(F.format_string("%.1f", miles * 5280 / 1000), F.lit("k ft"))).otherwise(F.concat(F.format_string("%.1f", miles), F.lit(" mi")))


def plan_name(x: Column) -> Column:
    key = F.regexp_replace(F.lower(clean(x)), "[ -]+", "_")
    return F.when(key.isin("paid", "pro"), "pro").when(key.isin("founding", "founding_partner"), "founding_partner").otherwise("free")


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def overflow_label(names: Column, most: int = 3) -> Column:
    """The first names, and how many more there are."""
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(head, F.lit(" +"), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(head)


def url_encode(x: Column) -> Column:
    """As a component of a URL: a space is %20, and !'()* and ~ stay."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_object_in(x: Column) -> Column:
    """The text from the first opening to the last closing brace, if that is JSON."""
    first, back = F.locate("{", x), F.locate("}", F.reverse(x))
    piece = F.when((first > 0) & (back > 0) & (F.length(x) - back + 1 > first), F.substr(x, first, F.length(x) - back + 2 - first))
    return F.when(F.try_parse_json(piece).isNotNull(), piece)


def frontmatter(x: Column) -> Column:
    """(header, body) of a text that begins with a header between lines of three dashes."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    # the header alone is matched, so that a long body isn't read by the pattern
    opening = r"(?s)^---\r?\n.*?\r?\n---\r?\n?"

    def parts(text: Column) -> Column:
        return let(F.regexp_extract(text, opening, 0), lambda head: F.when(head != "", F.struct(F.regexp_extract(head, pattern, 1).alias("header"), F.substr(text, F.length(head) + 1).alias("body"))))

    return let(x, parts)


def header_value(header: Column, field: str) -> Column:
    """Value of one header line: JSON text is decoded, anything else is as written."""
    raw = F.nullif(F.trim(F.regexp_extract(header, rf"(?m)^{field}:[ \t]*(.*)$", 1)), F.lit(""))
    return F.coalesce(F.get_json_object(F.when(raw.rlike('^".*"$'), F.concat(F.lit('{"v":'), raw, F.lit("}"))), "$.v"), raw)


def _with_lines(x: Column, lines: Callable[[Column], Column]) -> Column:
    """The document with ``lines`` of its header's lines; without a header as it is."""

    def written(text: Column) -> Column:
        front = lambda f: F.concat(F.lit("---\n"), F.array_join(let(F.split(f.header, "\n"), lines), "\n"), F.lit("\n---\n"), f.body)
        return F.coalesce(let(frontmatter(text), front), text)

    return let(x, written)


def set_header_field(x: Column, field: str, value: Column) -> Column:
    """The document with one header line set, or added at the header's end."""
    line = F.concat(F.lit(f"{field}: "), value)
    known = lambda y: y.startswith(f"{field}:")
    return _with_lines(x, lambda lines: F.when(F.exists(lines, known), F.transform(lines, lambda y: F.when(known(y), line).otherwise(y))).otherwise(F.concat(lines, F.array(line))))


def drop_header_field(x: Column, field: str) -> Column:
    return _with_lines(x, lambda lines: F.filter(lines, lambda y: ~y.startswith(f"{field}:")))


#: Fixed value: what stands between the header and the body of a generated draft.
BODY = "---BODY---"


def _without(x: Column, pattern: str) -> Column:
    """The text behind what a pattern matches at its begin."""
    return F.substr(x, F.length(F.regexp_extract(x, f"^(?:{pattern})", 0)) + 1)


def _unfenced(x: Column) -> Column:
    """What stands in the first fenced block, behind its language; without a closed one the text as it is."""

    def block(text: Column) -> Column:
        rest = lambda opens: F.when(opens > 0, F.substr(text, opens + 3))
        closed = lambda after: let(F.locate("```", after), lambda at: F.when(at > 0, _without(F.substr(after, F.lit(1), at - 1), r"\w*\s*")))
        return F.coalesce(let(let(F.locate("```", text), rest), closed), text)

    return let(x, block)


def draft(x: Column) -> Column:
    """(title, description, body, error) of a generated draft, which may stand in a fenced block; with an error all else is null."""

    def fields(text: Column, at: Column) -> Column:
        header = F.substr(text, F.lit(1), at - 1)
        body = F.rtrim(let(F.substr(text, at + len(BODY)), lambda rest: _without(rest, r"\r?\n")), F.lit(SPACES))
        title, about = (F.nullif(clean(F.regexp_extract(header, rf"(?m)^\s*{name}:\s*(.+)$", 1)), F.lit("")) for name in ("TITLE", "DESCRIPTION"))
        return F.struct(title.alias("title"), about.alias("description"), body.alias("body"), at.alias("at"))

    def judged(f: Column) -> Column:
        error = F.when(f.at == 0, "missing_body_marker").when(f.title.isNull() | f.description.isNull() | (f.body == ""), "missing_field")
        return let(error, lambda e: F.struct(*[F.when(e.isNull(), f[c]).alias(c) for c in ("title", "description", "body")], e.alias("error")))

    return let(clean(_unfenced(x)), lambda text: let(F.locate(BODY, text), lambda at: let(fields(text, at), judged)))


#: Fixed value: the largest integer that a double holds exactly.
SAFE = 9007199254740991


def _positive(x: Column) -> Column:
    """The safe positive integer that a text is, without sign, point or leading zero; null for anything else."""
    value = F.when(x.rlike(r"^[1-9]\d{0,15}$"), x).cast("long")
    return F.when(value <= SAFE, value)


def allowance(value: Column, fallback: Column, supplied: Column | bool = True) -> Column:
    """(allowance, unlimited, error) of a configured quota: not supplied or blank gives the fallback (null: without limit), null and "unlimited" have no limit, anything but a safe positive integer is an error."""
    text = clean(value)
    given = supplied if isinstance(supplied, Column) else F.lit(supplied)
    number = F.when(~given | (value.isNotNull() & (text == "")), fallback.cast("long")).otherwise(_positive(text))
    free = F.when(~given | (value.isNotNull() & (text == "")), fallback.isNull()).otherwise(value.isNull() | (F.lower(text) == "unlimited"))
    return F.struct(F.when(~free, number).alias("allowance"), free.alias("unlimited"), F.when(~free & number.isNull(), "not_a_positive_integer").alias("error"))


def id_set(x: Column) -> Column:
    """(ids, error) of a list of positive ids between commas, each once, in order of first mention; one bad entry, an empty one too, spoils all."""
    entries = F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(x, ","), clean))
    ids = F.transform(entries, _positive)
    bad = F.exists(ids, lambda i: i.isNull())
    return F.struct(F.when(~bad, F.array_distinct(ids)).alias("ids"), F.when(bad, "not_a_positive_integer").alias("error"))


def schedule_event_key(venue_id: Column, date: Column, start: Column) -> Column:
    """Identity of one occurrence of a weekly schedule from its venue, local date and start (texts); null if any of them is malformed."""
    good = (venue_id > 0) & date.rlike(r"^\d{4}-\d{2}-\d{2}$") & start.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(good, F.concat(F.lit("hh:"), venue_id.cast("string"), F.lit(":"), date, F.lit(":"), start))
