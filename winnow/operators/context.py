"""One request text per context: budgeted files, errors, changes and instruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.paths import language_of
from winnow.operators.select import CONTEXT_BUDGET, allocate_budget, error_cap
from winnow.operators.skew import top_per_key

# Fixed value: related files of a context.
MAX_RELATED = 5

# The sections in order.
ACTIVE_HEAD, ACTIVE_TEXT, ERROR_HEAD, ERROR_LINE, CHANGES, CONTRIBUTED, RELATED, INSTRUCTION = range(8)


def _section(df: DataFrame, number: int, pos: Column | str, text: Column) -> DataFrame:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return df.select("ctx", F.lit(number).alias("section"), pos.cast("int").alias("pos"), text.alias("text"))


def _fenced(label: Column, content: Column | str) -> Column:
    return F.concat(F.lit("```"), label, F.lit("\n"), content, F.lit("\n```"))


def context_sections(
    parts: DataFrame, errors: DataFrame, instructions: DataFrame, total: int = CONTEXT_BUDGET
) -> DataFrame:
    """Sections of every context: ctx, section, pos, text.

    ``parts``: ctx, kind (active, selection, related, diff, plugin), path,
    content. Selected text stands in place of the active file's text.
    ``errors``: ctx, path, line, col, severity, message. ``instructions``: ctx,
    instruction. Related files and errors are cut to their number before the
    shares of the budget are computed; contributed texts all stay.
    """
    ranked = top_per_key(parts.filter(F.col("kind") != "plugin"), ["ctx", "kind"], [F.col("path")], MAX_RELATED)
    chosen = ranked.filter((F.col("kind") == "related") | (F.col("rank") == 1))
    # a context has one contributed text per collector
    place = F.row_number().over(W.partitionBy("ctx").orderBy("path"))
    chosen = chosen.unionByName(parts.filter(F.col("kind") == "plugin").withColumn("rank", place))
    cut = allocate_budget(chosen, total).withColumn("language", language_of("path"))

    active = cut.filter(F.col("kind") == "active")
    head = F.concat(F.lit("## Active file: "), "path", F.lit(" ("), "language", F.lit(")"))
    marked = cut.filter((F.col("kind") == "selection") & (F.col("content") != "")).join(
        active.select("ctx"), "ctx", "left_semi"
    )
    unmarked = active.join(marked.select("ctx"), "ctx", "left_anti")
    changes = cut.filter((F.col("kind") == "diff") & (F.col("content") != ""))
    contributed = cut.filter((F.col("kind") == "plugin") & (F.col("content") != ""))
    near = cut.filter(F.col("kind") == "related")
    related_text = F.concat(
        F.lit("## Related: "), "path", F.lit("\n"), _fenced(F.col("language"), F.col("content"))
    )

    order = [F.col("path"), F.col("line"), F.col("col"), F.col("message")]
    shown = top_per_key(errors, ["ctx"], order, error_cap(total))
    counted = shown.groupBy("ctx").agg(F.count("*").alias("n"))
    error_head = F.concat(F.lit("## Errors ("), F.col("n").cast("string"), F.lit("):"))
    error_line = F.concat(
        F.lit("- ["), "severity", F.lit("] "), "path", F.lit(":"), F.col("line").cast("string"),
        F.lit(" — "), "message",
    )
    zero = F.lit(0)
    sections = [
        _section(active, ACTIVE_HEAD, zero, head),
        _section(unmarked, ACTIVE_TEXT, zero, _fenced(F.col("language"), F.col("content"))),
        _section(marked, ACTIVE_TEXT, zero, F.concat(F.lit("### Selected:\n"), _fenced(F.lit(""), "content"))),
        _section(counted, ERROR_HEAD, zero, error_head),
        _section(shown, ERROR_LINE, "rank", error_line),
        _section(changes, CHANGES, zero, F.concat(F.lit("## Git changes:\n"), "content")),
        _section(contributed, CONTRIBUTED, "rank", F.col("content")),
        _section(near, RELATED, "rank", related_text),
        _section(instructions, INSTRUCTION, zero, F.concat(F.lit("## Instruction:\n"), "instruction")),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def request_texts(sections: DataFrame) -> DataFrame:
    """The sections of each context joined in order with blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "pos", "text")))
    joined = F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n")
    return sections.groupBy("ctx").agg(joined.alias("request"))
