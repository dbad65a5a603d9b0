"""String functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redaction patterns, in order, with what takes their place.
REDACTIONS = [
    (r"(?<![A-Za-z0-9-])sk-ant-[A-Za-z0-9_-]{20,}", "[REDACTED_ANTHROPIC_KEY]"),
    (r"(?<![A-Za-z0-9-])sk-(?:proj-)?[A-Za-z0-9_-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"\bBearer[ \t]+[A-Za-z0-9_\-.=]+", "Bearer [REDACTED_TOKEN]"),
    (r"\bghp_[A-Za-z0-9]{30,}\b", "[REDACTED_GH_TOKEN]"),
    (r"\bgho_[A-Za-z0-9]{30,}\b", "[REDACTED_GH_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
]
#: Markdown patterns, in order.
MARKDOWN = [
    (r"^---\n[\s\S]*?\n---\n?", ""),
    (r"```[\s\S]*?```", " "),
    (r"`[^`]*`", " "),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"(?m)^\s*[-*_]{3,}\s*$", ""),
]
FRONTMATTER = r"^---\n([\s\S]*?)\n---\n?"


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def note_slug(topic: Column, ident: Column) -> Column:
    """The first 50 characters of the kebab topic and 8 of the identifier."""
    base, tail = F.substring(kebab(topic), 1, 50), F.substring(ident, 1, 8)
    return F.when(base != "", F.concat(base, F.lit("-"), tail)).otherwise(F.concat(F.lit("note-"), tail))


def source_slug(title: Column, url: Column, path: Column) -> Column:
    """The kebab title (60) and 8 hexadecimal digits of the SHA-256 of the url, or else the path."""
    tail = F.substring(F.sha2(F.coalesce(F.nullif(url, F.lit("")), path), 256), 1, 8)
    base = F.substring(kebab(title), 1, 60)
    return F.when(base != "", F.concat(base, F.lit("-"), tail)).otherwise(tail)


def compose_slug(title: Column) -> Column:
    base = F.regexp_replace(F.substring(kebab(title), 1, 60), "-+$", "")
    return F.when(base != "", base).otherwise("topic")


def scrub(c: Column, home: str = "/root") -> Column:
    """Keys, tokens and addresses redacted; the home folder becomes ~, and /Users/... ~/ and its last part."""
    for pattern, put in REDACTIONS:
        c = F.regexp_replace(c, pattern, put)
    c = F.replace(c, F.lit(home), F.lit("~"))
    return F.regexp_replace(c, "/Users/(?:[^\\s\"'`)\\]]*/)?([^\\s\"'`)\\]/]+)/*", "~/$1")


def strip_markdown(c: Column) -> Column:
    for pattern, put in MARKDOWN:
        c = F.regexp_replace(c, pattern, put)
    return c


def tokenize(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "\\W+"), lambda t: F.length(t) >= 3)


def body(c: Column) -> Column:
    return F.regexp_replace(c, FRONTMATTER, "")


def preview(c: Column, n: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(body(c), "\\s+", " ")), 1, n)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…[truncated "), (F.length(c) - n).cast("string"), F.lit(" chars]"))).otherwise(c)


def token_estimate(c: Column, chars: int = 4) -> Column:
    return F.ceil(F.length(c) / chars).cast("long")


def frontmatter(c: Column) -> Column:
    """Flat frontmatter as a map: the first colon parts key and value, quotes go, the last key wins."""
    block = F.regexp_extract(c, FRONTMATTER, 1)
    pairs = F.transform(
        F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), unquote(F.trim(F.regexp_replace(x, "^[^:]*:", ""))).alias("v")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def unquote(c: Column) -> Column:
    bare = F.regexp_replace(c, '^(["\'])(.*)\\1$', "$2")
    return F.replace(bare, F.lit('\\"'), F.lit('"'))


def is_verified(c: Column) -> Column:
    return F.regexp_extract(c, FRONTMATTER, 1).rlike("(?m)^verified:\\s*true\\s*$")


def _put(lines: Column, key: str, put: Column) -> Column:
    there = F.exists(lines, lambda x: x.startswith(f"{key}:"))
    return F.when(there, F.transform(lines, lambda x: F.when(x.startswith(f"{key}:"), put).otherwise(x))).otherwise(F.concat(lines, F.array(put)))


def set_frontmatter(c: Column, updates: list[tuple[str, Column]]) -> Column:
    """Keys set in place, new ones before the closing fence; a block is made if there is none."""
    lines = F.split(F.regexp_extract(c, FRONTMATTER, 1), "\n")
    has = c.rlike("^---\n[\\s\\S]*?\n---")
    for key, value in updates:
        put = F.concat(F.lit(f"{key}: "), value)
        lines = _put(lines, key, put)
    fresh = F.concat(F.lit("---\n"), F.array_join(F.array(*(F.concat(F.lit(f"{k}: "), v) for k, v in updates)), "\n"), F.lit("\n---\n\n"), c)
    return F.when(has, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body(c))).otherwise(fresh)


def render_tool_use(name: Column, args: Column) -> Column:
    return F.concat(F.lit("[tool_use: "), name, F.lit("] "), args)


def render_tool_result(name: Column, content: Column, is_error: Column) -> Column:
    safe = F.replace(content, F.lit("[/tool_result]"), F.lit("[ /tool_result]"))
    return F.concat(F.lit("[tool_result: "), name, F.when(is_error, F.lit(" ERROR")).otherwise(F.lit("")), F.lit("]\n"), safe, F.lit("\n[/tool_result]"))


def fixed(c: Column, digits: int) -> Column:
    """A number from 0 on with so many decimals, rounded by its exact binary value as C's printf does: 0.4735 is a little less
    than its decimals tell and gives 0.473. (Java's formatter rounds the decimals.)"""
    scale = float(10**digits)
    below = F.floor(c * scale)
    # In two halves of few bits each, products and differences are exact, and the sum has the right sign.
    shifted = c * 134217729.0
    high = shifted - (shifted - c)
    over = (high * scale - below.cast("double") - 0.5) + (c - high) * scale
    units = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    whole = F.floor(units / int(scale))
    exact = F.concat(whole.cast("string"), F.lit("."), F.lpad((units - whole * int(scale)).cast("string"), digits, "0"))
    return F.when(c >= 1e9, F.format_string(f"%.{digits}f", c)).otherwise(exact)


def usd(c: Column) -> Column:
    shown = lambda digits: F.concat(F.lit("$"), fixed(c, digits))
    return F.when(c <= 0, "$0").when(c < 0.01, shown(4)).when(c < 1, shown(3)).otherwise(shown(2))


def round4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000
