"""Named fact collectors with a text form, and user code over files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import language_of
from winnow.sources.scratch import scratch_dir

log = logging.getLogger(__name__)

CHANGED, UNCHANGED, FAILED = "changed", "unchanged", "failed"
Transform = Callable[[str, str, str], str]

#: Bytes of content that user code is handed at once inside a task; a larger file is a part of its own.
PART_BYTES = 1 << 20


class Hook(NamedTuple):
    """``line`` is the text of one row of the collected facts.

    ``wants`` tells, from path and content, every file that the collector may take a fact from; without it the collector
    may need any file. ``every_workspace``: it also has a line for workspaces without such a file.
    """

    key: str
    collect: Callable[[DataFrame], DataFrame]
    line: Callable[[], Column]
    wants: Callable[[], Column] | None = None
    every_workspace: bool = False


_HOOKS: dict[str, Hook] = {}


def register_hook(
    key: str,
    collect: Callable[[DataFrame], DataFrame],
    line: Callable[[], Column],
    wants: Callable[[], Column] | None = None,
    every_workspace: bool = False,
) -> Hook:
    """Register a collector; the first registration of a key wins."""
    return _HOOKS.setdefault(key, Hook(key, collect, line, wants, every_workspace))


def hook_lines(files: DataFrame, hooks: Iterable[Hook] | None = None) -> DataFrame:
    """Text lines of every hook over one corpus; a hook that cannot be planned is skipped."""
    out = None
    for hook in list(hooks if hooks is not None else _HOOKS.values()):
        try:
            part = hook.collect(files).select(F.lit(hook.key).alias("key"), hook.line().alias("line"))
        except AnalysisException as e:
            log.warning("hook %s skipped: %s", hook.key, e)
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no usable hook")
    return out


ROUTED = "_hook"


def route_files(files: DataFrame, hooks: list[Hook]) -> DataFrame:
    """The files that some hook wants, once for each such hook, with its place in ``hooks`` as ``_hook``.

    One pass over the corpus tests all hooks in one projection and writes only wanted files, in a folder for each hook;
    so a collector reads its own files. Parts are balanced by size: a hook that wants most files has many.
    """
    wanted = [F.when(F.coalesce(h.wants(), F.lit(False)), F.lit(i)) for i, h in enumerate(hooks) if h.wants]
    spark, folder = files.sparkSession, scratch_dir(files.sparkSession, "hook-files")
    tagged = files.select("*", F.explode(F.array_compact(F.array(*wanted))).alias(ROUTED))
    tagged.hint("rebalance", ROUTED).write.partitionBy(ROUTED).parquet(folder)
    return spark.read.schema(tagged.schema).parquet(folder)


def _plannable(files: DataFrame, hook: Hook) -> bool:
    """Whether a hook can be planned over files like these; a warning tells if it cannot."""
    try:
        if hook.wants:
            files.select(hook.wants())
        hook.collect(files).select(hook.line())
    except AnalysisException as e:
        log.warning("hook %s skipped: %s", hook.key, e)
        return False
    return True


def routed_hook_lines(files: DataFrame, hooks: Iterable[Hook] | None = None, workspace: str = "ws") -> DataFrame:
    """The lines of ``hook_lines``, with the corpus read once for all hooks that say which files they want.

    A second read, of the workspace column alone, gives hooks with ``every_workspace`` an empty file of each workspace.
    Hooks that do not say what they want read the corpus themselves; those that cannot be planned are skipped.
    """
    chosen = [h for h in (hooks if hooks is not None else _HOOKS.values()) if _plannable(files, h)]
    if not chosen:
        raise ValueError("no usable hook")
    routed = route_files(files, chosen) if any(h.wants for h in chosen) else None
    blank = [F.lit("" if c in ("path", "content") else None).cast(t).alias(c) for c, t in files.dtypes if c != workspace]
    out = None
    for i, hook in enumerate(chosen):
        own = routed.where(F.col(ROUTED) == i).drop(ROUTED) if hook.wants else files
        if hook.wants and hook.every_workspace:
            own = own.unionByName(files.select(workspace).distinct().select(workspace, *blank))
        part = hook.collect(own).select(F.lit(hook.key).alias("key"), hook.line().alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def stored_hook_lines(files: DataFrame, hooks: Iterable[Hook] | None = None) -> DataFrame:
    """Text lines of every hook, each run and written on its own: one that fails while it runs is skipped too."""
    spark = files.sparkSession
    folder = scratch_dir(spark, "hooks")
    spark.createDataFrame([], "key string, line string").write.parquet(f"{folder}/0")
    for i, hook in enumerate(list(hooks if hooks is not None else _HOOKS.values()), start=1):
        try:
            lines = hook.collect(files).select(F.lit(hook.key).alias("key"), hook.line().alias("line"))
            lines.write.parquet(f"{folder}/{i}")
        except Exception as e:  # user code: any failure means the hook is skipped
            log.warning("hook %s skipped: %s", hook.key, e)
            spark.createDataFrame([], "key string, line string").write.mode("overwrite").parquet(f"{folder}/{i}")
    return spark.read.schema("key string, line string").parquet(f"{folder}/*")


def chain(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply rewriters in order; each sees the result of the one before."""
    return reduce(DataFrame.transform, steps, df)


def _parts(batch: pa.RecordBatch, content: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``PART_BYTES`` of content, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > PART_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def apply_transform(files: DataFrame, fn: Transform, extensions: list[str]) -> DataFrame:
    """Run user code on the content of matching files.

    ``fn(content, path, language)`` returns the new content. A file whose call
    raises keeps its content and is marked failed; an empty or equal result is
    unchanged. Rows are independent, so batches stream through each task, a part
    of bounded size at a time: a worker holds no more of a larger table.
    """
    test = F.lit(False)
    for e in extensions:
        test = test | F.endswith("path", F.lit(e))
    chosen = files.filter(test).select("path", "content", language_of("path").alias("language"))

    def one(content: str, path: str, language: str) -> tuple[str, str]:
        try:
            new = fn(content, path, language)
        except Exception:  # user code: any failure means the file is skipped
            return content, FAILED
        return (new, CHANGED) if new and new != content else (content, UNCHANGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "content"):
                done = [one(*r) for r in zip(*(part.column(c).to_pylist() for c in ("content", "path", "language")))]
                contents, statuses = ([d[i] for d in done] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("path"), pa.array(contents, pa.string()), pa.array(statuses, pa.string())],
                    ["path", "content", "status"],
                )

    return chosen.mapInArrow(run, "path string, content string, status string")


def transform_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n_files"))
