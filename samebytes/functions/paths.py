"""Path and name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samebytes.functions.common import col, strip, verdict
from samebytes.schemas import IMAGE_SUFFIXES, VIDEO_SUFFIXES


def safe_relative_path(path: Column | str) -> Column:
    """`struct(ok, reason)`; the first broken rule is the reason."""
    path = col(path)
    return verdict(
        (path.isNull(), "missing"),
        (path.startswith("/"), "absolute"),
        (F.array_contains(F.split(path, "/"), ".."), "traversal"),
        (path.contains("~"), "home"),
        (path.contains("$"), "variable"),
    )


def normalize_lexically(path: Column | str) -> Column:
    """Resolve `.`, `..` and repeated slashes of an absolute path without touching a disk.

    Only paths that need it pay for the fold; `/..` stays at the root.
    """
    path = col(path)

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, part))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(
        path.rlike(r"//|/$|(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"))
    ).otherwise(path)


def contained_under(root: Column | str, candidate: Column | str) -> Column:
    """The candidate is the root or has it as an ancestor, compared by component."""
    root = normalize_lexically(root)
    candidate = normalize_lexically(candidate)
    prefix = F.when(root == "/", F.lit("/")).otherwise(F.concat(root, F.lit("/")))
    return (candidate == root) | F.startswith(candidate, prefix)


def library_name(raw: Column | str) -> Column:
    """`struct(name, ok, reason)` of a trimmed library name."""
    name = strip(raw)
    checked = verdict(
        (name.isNull() | (name == ""), "empty"),
        (name.isin(".", ".."), "traversal"),
        (name.rlike(r"[/\\]"), "nested"),
        (name.rlike(r"[~$]"), "expansion"),
    )
    ok, reason = checked["ok"].alias("ok"), checked["reason"].alias("reason")
    return F.struct(name.alias("name"), ok, reason)


def suffix(path: Column | str) -> Column:
    """Lower-case last suffix of the last component; empty for `.jpg`, `x.` and `x`."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)(?:/\.?)*$", 1))


def media_type(path: Column | str) -> Column:
    """image, video or NULL when the suffix is not supported."""
    found = suffix(path)
    return F.when(found.isin(*IMAGE_SUFFIXES), F.lit("image")).when(
        found.isin(*VIDEO_SUFFIXES), F.lit("video")
    )


def posix_path(path: Column | str) -> Column:
    """components joined by single slashes; NULL when nothing is left or `..` occurs."""
    parts = F.filter(F.split(col(path), "/"), lambda part: ~part.isin("", "."))
    return F.when(
        (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/")
    )


def sanitize_error(message: Column | str, replacements: dict[str, str], limit: int) -> Column:
    """real roots become logical ones, then the text is cut to `limit` characters."""
    message = col(message)
    for real, logical in replacements.items():
        if real:
            message = F.replace(message, F.lit(real), F.lit(logical))
    return F.when(
        F.length(message) > limit,
        F.concat(F.substring(message, 1, limit), F.lit("...(truncated)")),
    ).otherwise(message)
