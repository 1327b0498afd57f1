"""Ledger keys, slugs, previews, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PROMPT = "No prompt available"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def ledger_key(session_id: Column, slug: Column, end_time: Column) -> Column:
    """Storage key of a session; the slug and end time stand in for an id."""
    named = F.when(F.coalesce(slug, F.lit("")) == "", "session").otherwise(slug)
    base = F.when(
        F.coalesce(session_id, F.lit("")) != "", session_id
    ).otherwise(F.concat_ws("-", named, end_time))
    return F.regexp_replace(base, "[^A-Za-z0-9._-]", "_")


def prompt_slug(provider: Column, text: Column, session_id: Column) -> Column:
    """Short slug of the first prompt, by the host's own rule."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    six = F.array_join(F.slice(words, 1, 6), "-")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.left(dashed, F.lit(48))
    head = F.left(F.coalesce(session_id, F.lit("")), F.lit(8))
    codex = F.when(six != "", six).otherwise(head)
    other = F.when(cut != "", cut).when(head != "", head).otherwise("unknown-session")
    return F.when(provider == "codex", codex).otherwise(other)


def clip(text: Column, limit: int = 100) -> Column:
    """Text up to the limit, else cut, stripped and marked with dots."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(strip(F.left(text, F.lit(limit))), F.lit("..."))
    )


def prompt_preview(text: Column) -> Column:
    """Preview of a prompt already reduced to plain text."""
    return clip(F.when(F.coalesce(text, F.lit("")) == "", NO_PROMPT).otherwise(text))


def content_text(content: Column, part_types: list[str] | None = None) -> Column:
    """Plain text of a VARIANT that holds a string or an array of parts."""
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<struct<type string, text string>>")

    def usable(part):
        filled = F.coalesce(part["text"], F.lit("")) != ""
        return filled if part_types is None else filled & part["type"].isin(part_types)

    joined = F.array_join(F.transform(F.filter(parts, usable), lambda p: p["text"]), " ")
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(
        kind.startswith("ARRAY"), joined
    )


def duration_seconds(start_ms: Column, end_ms: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((end_ms - start_ms) / 1000)).cast("bigint")


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )
