"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The variables of a route, the characters that a file name keeps without loss.
ROUTE_VARIABLE = r"\{[^}]+\}|:[A-Za-z_][A-Za-z0-9_]*"
LOSSY = r"[^a-zA-Z0-9_/.:]"


def normalize_url(u: str | Column) -> Column:
    """A route key: no query, no <var> at the end that is not a segment, variables as <var>."""
    c = F.split_part(F.col(u) if isinstance(u, str) else u, F.lit("?"), F.lit(1))
    return F.regexp_replace(F.regexp_replace(c, r"(^|[^/])<var>$", "$1"), ROUTE_VARIABLE, "<var>")


def slugify(i: str) -> Column:
    """An id as a file name; a short digest is added where other characters than separators of paths are lost."""
    plain = F.regexp_replace(F.replace(F.col(i), F.lit("::"), F.lit("__")), r"[^\p{L}\p{N}_]", "_")
    bare = F.regexp_replace(plain, "^_+|_+$", "")
    digest = F.substring(F.sha1(F.col(i)), 1, 8)
    return F.when(~F.col(i).rlike(LOSSY), bare).when(bare == "", digest).otherwise(F.concat(bare, F.lit("_"), digest))


def first_segment(i: str) -> Column:
    return F.split_part(F.col(i), F.lit("::"), F.lit(1))


def last_segment(i: str) -> Column:
    return F.split_part(F.col(i), F.lit("::"), F.lit(-1))


def external_confidence(target: str) -> Column:
    """Confidence of an edge by the shape of its external target."""
    t = F.col(target)
    body = F.substring(t, len("external::unresolved::") + 1, 1 << 30)
    return (
        F.when(t.startswith("external::pypi::unknown") | t.startswith("external::npm::unknown"), "unresolved_internal")
        .when(t.startswith("external::dynamic::"), "dynamic")
        .when(t.startswith("external::unresolved::"), F.when(F.instr(body, "::") > 0, "unresolved_internal").otherwise("unresolved_receiver"))
        .otherwise("external")
    )


#: What each wildcard of a glob stands for.
WILDCARDS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """A glob on forward-slash paths as a regular expression: ** any depth, * and ? within a segment."""
    part = lambda m: WILDCARDS.get(m.group()) or re.escape(m.group())
    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", part, pattern.replace("\\", "/").lstrip("/")) + "$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path matches any include (or there is none) and no exclude."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    some = lambda globs: F.lit(False) if not globs else forward.rlike("|".join(glob_regex(g) for g in globs))
    return (some(include) if include else F.lit(True)) & ~some(exclude)


#: Lines that look like credentials (YAML_VALUE unless NO_VALUE), and the marker of a list or heading that stays.
CREDENTIALS = (
    r"(?i)password\s+`[^`]+`",
    r"(?i)`[^`]+`\s*/\s*`[^`]+`.*\b(creds|credentials|login)\b",
    r"(?i)://[^/\s:@]+:[^/\s@]+@",
    r"(?i)(api[_-]?key|secret|token)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    r"^-----BEGIN\s+(RSA|OPENSSH|EC|DSA|PRIVATE)",
    r"AKIA[0-9A-Z]{16}",
)
YAML_VALUE, NO_VALUE = r"(?i)^\s*password:\s*\S", r"(?i)^\s*password:\s*(REDACTED|null|unset)"
MARKER = r"^(\s*[-*]\s+(\*\*[^*]+\*\*\s*[:.]?\s*)?|\s*#+\s+)"


def is_credential(line: Column) -> Column:
    """Whether a line looks as if it told a credential."""
    found = line.rlike(YAML_VALUE) & ~line.rlike(NO_VALUE)
    for pattern in CREDENTIALS:
        found = found | line.rlike(pattern)
    return found


def redact(line: Column, path: Column, number: Column) -> Column:
    """A line, or where it looks like a credential its leading marker and a pointer to the place."""
    pointer = F.concat(F.regexp_extract(line, MARKER, 0), F.lit("REDACTED — see canonical memory at `"), path, F.lit("` (line "), number.cast("string"), F.lit(")"))
    return F.when(is_credential(line), pointer).otherwise(line)


#: The first words of subjects that tell of a fix or a revert; commits that make a file churn.
FIX_WORDS, REVERT_WORDS, CHURN = ("fix", "fixes", "fixed"), ("revert",), 10


def says(subject: Column, words: tuple[str, ...]) -> Column:
    """Whether a subject begins with one of the words, as a plain word or a conventional type."""
    return F.lower(F.trim(subject)).rlike(f"^({'|'.join(words)})[:( ]")


def commit_action(subject: Column) -> Column:
    """The conventional action of a commit's subject; edit without one."""
    a = F.regexp_extract(subject, r"^(feat|fix|review|flag|unflag|chore|docs|refactor)(?:\([^)]*\))?:\s*", 1)
    return F.when(a == "", "edit").otherwise(a)


def unquote(literal: Column) -> Column:
    return F.regexp_extract(literal, r"^['\"](.*)['\"]$", 1)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days between a time and now, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def section(text: Column, heading: str) -> Column:
    """The body under a second-level heading of a markdown text."""
    return F.regexp_extract(text, r"(?ms)^##\s+" + re.escape(heading) + r"\b[^\n]*\n(.*?)(?=^##\s+|\z)", 1)


def frontmatter(text: Column) -> Column:
    """Key-value pairs of the block between the leading lines of three dashes."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.when(block != "", F.str_to_map(block, F.lit("\n"), F.lit(":")))


#: Fixed value: characters of a first paragraph.
PARAGRAPH = 280
_EDGES = r"(?U)^\s+|\s+$"


def first_paragraph(text: Column, limit: int = PARAGRAPH) -> Column:
    """The first paragraph that is not blank, without its heading marks, cut with an ellipsis; empty if there is none."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    paragraphs = F.filter(F.transform(F.split(body, r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, _EDGES, "")), lambda p: p != "")
    first = F.regexp_replace(F.coalesce(F.get(paragraphs, 0), F.lit("")), r"(?U)^#+\s*", "")
    cut = F.concat(F.regexp_replace(F.substring(first, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(first) > limit, cut).otherwise(first)


def is_common_path(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path begins with any of the prefixes."""
    return F.coalesce(*[F.when(path.startswith(p), F.lit(True)) for p in prefixes], F.lit(False)) if prefixes else F.lit(False)
