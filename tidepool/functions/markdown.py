"""Markdown to HTML: headings, rules, lists, quotes and paragraphs, line by line."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: The inline marks in the order in which they are replaced, as (pattern, tag with the group's text as $1 and $2).
INLINE = [
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
    (r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>"),
    (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2" target="_blank" rel="noopener">$1</a>'),
]
_MARKS = [(re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", tag)) for pattern, tag in INLINE]
#: What a trimmed line is, by the first pattern that matches.
LINES = [("heading", r"(#{1,6})\s+(.*)"), ("rule", r"-{3,}|\*{3,}"), ("ul", r"[-*]\s+(.*)"), ("ol", r"\d+\.\s+(.*)"), ("quote", r">\s?(.*)")]
_KINDS = [(name, re.compile(pattern)) for name, pattern in LINES]


def _inline(x: str) -> str:
    x = x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for pattern, tag in _MARKS:
        x = pattern.sub(tag, x)
    return x


def _classed(line: str) -> tuple[str, str]:
    """(kind, what is shown) of a trimmed line; a heading's kind is its tag."""
    for name, pattern in _KINDS:
        if found := pattern.fullmatch(line):
            if name == "heading":
                return f"h{len(found[1])}", found[2]
            return name, found[found.re.groups] if found.re.groups else ""
    return ("text" if line else ""), line


#: How a run of lines of one kind becomes HTML; of what isn't here, each line is a block.
_RUNS = {
    "text": lambda body: [f"<p>{_inline(' '.join(body))}</p>"],
    "ul": lambda body: ["<ul>" + "".join(f"<li>{_inline(x)}</li>" for x in body) + "</ul>"],
    "ol": lambda body: ["<ol>" + "".join(f"<li>{_inline(x)}</li>" for x in body) + "</ol>"],
    "rule": lambda body: ["<hr />"] * len(body),
    "quote": lambda body: [f"<blockquote><p>{_inline(x)}</p></blockquote>" for x in body],
    "": lambda body: [],
}


def to_html(text: str | None) -> str | None:
    """Runs of lines of one kind become one block; a blank line ends a run; null stays null."""
    if text is None:
        return None
    classed = [_classed(line.strip()) for line in text.replace("\r\n", "\n").split("\n")]
    blocks: list[str] = []
    for kind, run in groupby(classed, key=lambda x: x[0]):
        body = [x for _, x in run]
        blocks += _RUNS[kind](body) if kind in _RUNS else [f"<{kind}>{_inline(x)}</{kind}>" for x in body]
    return "\n".join(blocks)


@F.pandas_udf(StringType())
def _html(x: pd.Series) -> pd.Series:
    return x.map(to_html)


def html(x: Column) -> Column:
    return _html(x)


def inline(x: Column) -> Column:
    """Inline marks alone, in the JVM."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    for pattern, tag in INLINE:
        x = F.regexp_replace(x, pattern, tag)
    return x
