"""Path column expressions on ``/``-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions.text import as_col

# File extension to language name.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascriptreact",
    ".tsx": "typescriptreact",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".sh": "shellscript",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".yml": "yaml",
    ".yaml": "yaml",
}

# Extension to language name for stored objects.
OBJECT_LANGUAGE = {
    ".json": "json",
    ".xml": "xml",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".cs": "csharp",
    ".html": "html",
    ".css": "css",
    ".sql": "sql",
    ".md": "markdown",
    ".txt": "plaintext",
    ".csv": "plaintext",
    ".bicep": "bicep",
    ".tf": "terraform",
    ".sh": "shellscript",
}


def base_name(c: Column | str) -> Column:
    """Last path segment."""
    return F.substring_index(as_col(c), "/", -1)


def dir_name(c: Column | str) -> Column:
    """Path without its last segment; empty for a bare name."""
    return F.regexp_extract(as_col(c), r"^(.*)/[^/]*$", 1)


def extension(c: Column | str) -> Column:
    """Extension with its dot; empty when there is none or the name starts with its only dot."""
    return F.regexp_extract(as_col(c), r"[^/](\.[^./]*)$", 1)


def stem(c: Column | str) -> Column:
    """Last segment without its extension."""
    name = base_name(c)
    return F.left(name, F.length(name) - F.length(extension(c)))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def language_of(path: Column | str) -> Column:
    return _lookup(extension(path), EXTENSION_LANGUAGE, "text")


def object_language_of(path: Column | str) -> Column:
    return _lookup(F.lower(extension(path)), OBJECT_LANGUAGE, "plaintext")


def short_name(c: Column | str) -> Column:
    """Last segment of a resource name such as ``projects/p/functions/f``."""
    return F.element_at(F.split(as_col(c), "/"), -1)


# a segment that is empty, ``.`` or ``..``
UNRESOLVED = r"(?:^|/)\.{0,2}(?:/|$)"


def resolve(path: Column | str) -> Column:
    """Resolve ``.``, ``..`` and empty segments; null when ``..`` climbs above the root."""
    path = as_col(path)
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        depth = F.size(acc["kept"])
        popped = F.slice(acc["kept"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        return F.struct(
            (acc["ok"] & ((s != "..") | (depth > 0))).alias("ok"),
            F.when(s == "..", popped).otherwise(F.concat(acc["kept"], F.array(s))).alias("kept"),
        )

    finish = lambda a: F.when(a["ok"], F.array_join(a["kept"], "/"))
    folded = F.aggregate(segments, empty, step, finish)
    # most paths are resolved already and need no fold
    return F.when(F.rlike(path, F.lit(UNRESOLVED)), folded).otherwise(path)
