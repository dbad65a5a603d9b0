"""Model replies and note sections as columns. A null reply counts as empty."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories, and what a reply without a usable one means.
CATEGORIES = ["pattern", "gotcha", "decision", "tool"]
#: Longest payload fields, in characters.
CONTENT_LIMIT = {"moderate": 2000, "aggressive": 1000}
EDIT_LIMIT = {"moderate": 1000, "aggressive": 500}

_RELATED = r"^##[^\S\n]+(?i:related)\b"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _unit(c: Column) -> Column:
    """Between 0 and 1; 0 if missing or not finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)


def reply_object(reply: Column) -> Column:
    """The text from the first brace to the last as a variant; null if it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"\{[\s\S]*\}", 0), F.lit("")))


def _text(v: Column, key: str) -> Column:
    """A member that is a string; null if it is missing or of another kind."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def classification(reply: Column, project: Column) -> Column:
    """Struct of category, topic, project, confidence, themes. Broken replies give pattern, unknown, the
    given project, 0 and no themes."""
    v = reply_object(reply)
    category, themes = _text(v, "category"), F.try_variant_get(v, "$.themes", "array<variant>")
    kept = F.filter(themes, lambda t: F.schema_of_variant(t) == "STRING")
    named = F.filter(F.transform(kept, lambda t: _trim(F.variant_get(t, "$", "string"))), lambda t: t != "")
    return F.struct(
        F.when(category.isin(CATEGORIES), category).otherwise("pattern").alias("category"),
        F.coalesce(F.nullif(_trim(_text(v, "topic")), F.lit("")), F.lit("unknown")).alias("topic"),
        F.coalesce(F.nullif(_trim(_text(v, "project")), F.lit("")), project).alias("project"),
        _unit(F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
        F.coalesce(named, F.array().cast("array<string>")).alias("themes"),
    )


def verdict(reply: Column, flag: str = "isDuplicate") -> Column:
    """Struct of ``flag``, confidence, reason, keep_which (A, B or merge) from a reply about two notes."""
    v = reply_object(reply)
    yes = F.schema_of_variant(F.try_variant_get(v, f"$.{flag}", "variant")) == "BOOLEAN"
    keep = _text(v, "keepWhich")
    return F.struct(
        F.coalesce(yes & F.try_variant_get(v, f"$.{flag}", "boolean"), F.lit(False)).alias(flag),
        _unit(F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
        F.coalesce(_text(v, "reason"), F.lit("")).alias("reason"),
        F.when(keep.isin("A", "B"), keep).otherwise("merge").alias("keep_which"),
    )


def composed(reply: Column) -> Column:
    """Struct of title, content, confidence: the first title and confidence lines are lifted out, and a
    leading heading goes."""
    title, sure = r"(?i)^\s*title:\s*(.+?)\s*$", r"(?i)^\s*confidence:\s*([-+]?[0-9]*\.?[0-9]+)"
    lines = F.split(F.coalesce(reply, F.lit("")), "\n", -1)

    def first(pattern: str) -> tuple[Column, Column]:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)
        return at, F.regexp_extract(F.coalesce(F.get(lines, (at - 1).cast("int")), F.lit("")), pattern, 1)

    (t, head), (c, number) = first(title), first(sure)
    rest = F.array_join(F.filter(lines, lambda x, i: (i + 1 != t) & (i + 1 != c)), "\n")
    return F.struct(
        F.regexp_replace(head, "^([\"'])(.*)\\1$", "$2").alias("title"),
        _trim(F.regexp_replace(_trim(rest), r"^#\s+.*\n+", "")).alias("content"),
        _unit(number.try_cast("double")).alias("confidence"),
    )


def strip_related(c: Column) -> Column:
    """Without ``## Related`` sections, each up to the next other heading, and without newlines at the end."""
    section = rf"(?m){_RELATED}[\s\S]*?(?=^(?!##[^\S\n]+(?i:related)\b)#{{1,6}}[^\S\n]|\z)"
    return F.regexp_replace(F.regexp_replace(c, section, ""), r"\n+\z", "")


def _link(bullet: re.Match) -> str:
    text = bullet[2].strip()
    if not text or re.fullmatch(r"\[\[.+\]\]", text):
        return bullet[0]
    inner = re.fullmatch(r"\[(.+?)\]\(.+\)", text)
    slug = re.sub(r"[^a-z0-9]+", "-", (inner[1] if inner else text).lower()).strip("-")
    return f"{bullet[1]}[[{slug}]]"


def link_related(c: Column) -> Column:
    """Bullets of ``## Related`` sections as wikilinks to their kebab slug; null stays null."""

    def one(text: str | None) -> str | None:
        if not text:
            return text
        parts = re.split(r"(?m)(?=^#{1,6}[^\S\n])", text)
        return "".join(re.sub(r"(?m)^([^\S\n]*[-*][^\S\n]+)(.*)$", _link, p) if re.match(_RELATED, p) else p for p in parts)

    @F.pandas_udf("string")
    def link(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return link(c)


def bound_payload(name: Column, payload: Column, mode: str = "moderate") -> Column:
    """Call payloads (JSON) with the long text fields of writing tools replaced by a note on their length.
    What isn't a JSON object stays as it is, as do the payloads of other tools."""
    content, edit = CONTENT_LIMIT[mode], EDIT_LIMIT[mode]

    @F.pandas_udf("string")
    def bound(names: pd.Series, payloads: pd.Series) -> pd.Series:
        def shorten(holder: object, tool: str, limits: dict[str, int]) -> None:
            for field, most in limits.items() if isinstance(holder, dict) else ():
                value = holder.get(field)
                if isinstance(value, str) and len(value) > most:
                    holder[field] = f"[truncated {len(value)} chars of {field} for {tool}]"

        def one(tool: str | None, text: str | None) -> str | None:
            if tool not in ("Write", "Edit", "MultiEdit", "NotebookEdit") or text is None:
                return text
            try:
                value = json.loads(text)
            except ValueError:
                return text
            if not isinstance(value, dict):
                return text
            edits = {"old_string": edit, "new_string": edit}
            if tool == "MultiEdit":
                for item in value["edits"] if isinstance(value.get("edits"), list) else ():
                    shorten(item, tool, edits)
            else:
                shorten(value, tool, {"Write": {"content": content}, "Edit": edits, "NotebookEdit": {"new_source": content}}[tool])
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(t, p) for t, p in zip(names, payloads, strict=True)], dtype=object)

    return bound(name, payload)
