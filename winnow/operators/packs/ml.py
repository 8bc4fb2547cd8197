"""PyTorch code and notebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.text import all_groups
from winnow.operators.aggregate import feature_flags
from winnow.operators.packs import distinct_in_order, matching

# Patterns and defaults.
PY_PATH = r"\.py$"
CHECKPOINT_PATH = r"\.(?:pt|pth)$"
MODULE_CLASS = r"class\s+(\w+)\s*\(\s*(?:nn\.Module|torch\.nn\.Module)\s*\)"
OPTIMIZER = r"(?:torch\.optim\.|optim\.)(\w+)\s*\("
LOSS = r"(?:nn\.|torch\.nn\.)(\w+Loss\w*)\s*\("
TRAINING = r"optimizer\s*=|loss\s*=|\.backward\(\)|\.zero_grad\(\)|optimizer\.step\(\)"
TRAINING_FLAGS = {
    "has_data_loader": r"DataLoader",
    "has_amp": r"autocast|GradScaler|torch\.cuda\.amp",
    "has_distributed": r"DistributedDataParallel|DataParallel|torch\.distributed",
    "has_torch_script": r"torch\.jit\.script|torch\.jit\.trace",
}
PERCENT_CELL = r"(?m)^# %%"
DEFAULT_KERNEL = "unknown"
DEFAULT_LANGUAGE = "python"

NOTEBOOK_SCHEMA = T.StructType(
    [
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType())]))),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField(
                        "kernelspec",
                        T.StructType(
                            [
                                T.StructField("name", T.StringType()),
                                T.StructField("language", T.StringType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "language_info", T.StructType([T.StructField("name", T.StringType())])
                    ),
                ]
            ),
        ),
    ]
)


def torch_models(files: DataFrame) -> DataFrame:
    """Files with module classes, and the class names in order."""
    found = matching(files, PY_PATH, "nn.Module").select(
        "path", all_groups("content", MODULE_CLASS).alias("classes")
    )
    return found.filter(F.size("classes") > 0)


def checkpoint_files(files: DataFrame) -> DataFrame:
    return matching(files, CHECKPOINT_PATH).select("path")


def torch_training(files: DataFrame) -> DataFrame:
    """Per source file: is it a training script, and its distinct optimizers and losses."""
    return matching(files, PY_PATH).select(
        "path",
        F.rlike("content", F.lit(TRAINING)).alias("is_training"),
        distinct_in_order(all_groups("content", OPTIMIZER)).alias("optimizers"),
        distinct_in_order(all_groups("content", LOSS)).alias("losses"),
    )


def torch_names(files: DataFrame) -> DataFrame:
    """Distinct optimizers and losses of the corpus."""
    py = matching(files, PY_PATH)
    found = F.array(
        F.struct(F.lit("optimizer").alias("kind"), all_groups("content", OPTIMIZER).alias("names")),
        F.struct(F.lit("loss").alias("kind"), all_groups("content", LOSS).alias("names")),
    )
    listed = py.select(F.inline(found)).select("kind", F.explode("names").alias("name"))
    return listed.distinct()


def torch_flags(files: DataFrame) -> DataFrame:
    """Four feature flags over all source files."""
    return feature_flags(matching(files, PY_PATH), TRAINING_FLAGS)


def parsed_notebooks(files: DataFrame) -> DataFrame:
    """Notebooks as (path, nb); text that is not JSON gives a null struct."""
    return matching(files, r"(?i)\.ipynb$").select(
        "path", F.from_json("content", NOTEBOOK_SCHEMA, {"mode": "PERMISSIVE"}).alias("nb")
    )


def _cells(kind: str) -> Column:
    of_kind = F.filter("nb.cells", lambda c: c["cell_type"] == kind)
    return F.coalesce(F.size(of_kind), F.lit(0)).cast("bigint")


def notebook_stats(files: DataFrame) -> DataFrame:
    """Cell counts, kernel and language per notebook; bad JSON counts as an empty notebook."""
    return parsed_notebooks(files).select(
        "path",
        F.when(F.col("nb.cells").isNull(), 0).otherwise(F.size("nb.cells")).cast("bigint").alias("n_cells"),
        F.when(F.col("nb.cells").isNull(), 0).otherwise(_cells("code")).cast("bigint").alias("n_code"),
        F.when(F.col("nb.cells").isNull(), 0).otherwise(_cells("markdown")).cast("bigint").alias("n_markdown"),
        F.coalesce("nb.metadata.kernelspec.name", F.lit(DEFAULT_KERNEL)).alias("kernel"),
        F.coalesce(
            "nb.metadata.kernelspec.language", "nb.metadata.language_info.name", F.lit(DEFAULT_LANGUAGE)
        ).alias("language"),
    )


def notebook_kernels(files: DataFrame) -> DataFrame:
    """Distinct kernel names."""
    name = F.nullif(F.col("nb.metadata.kernelspec.name"), F.lit(""))
    return parsed_notebooks(files).select(name.alias("kernel")).filter("kernel is not null").distinct()


def percent_scripts(files: DataFrame) -> DataFrame:
    """Count of scripts with ``# %%`` cells."""
    return matching(files, r"(?i)\.py$").agg(
        F.count_if(F.rlike("content", F.lit(PERCENT_CELL))).alias("n_scripts")
    )


def clean_outputs(files: DataFrame, content: str = "content") -> DataFrame:
    """Notebook text with empty outputs and null execution counts in code cells.

    Cells stay generic variants, so unknown fields survive. Text that is not a
    notebook is returned unchanged.
    """
    nb = F.try_parse_json(content)
    as_map = F.try_variant_get(nb, "$", "map<string,variant>")
    cells = F.try_variant_get(nb, "$.cells", "array<map<string,variant>>")

    def clean(cell: Column) -> Column:
        is_code = F.try_variant_get(cell["cell_type"], "$", "string") == "code"
        without = F.map_filter(cell, lambda k, _: ~k.isin("outputs", "execution_count"))
        blank = F.map_from_arrays(
            F.array(F.lit("outputs"), F.lit("execution_count")),
            F.array(F.parse_json(F.lit("[]")), F.parse_json(F.lit("null"))),
        )
        return F.when(is_code, F.map_concat(without, blank)).otherwise(cell)

    # to_json writes maps of variants; the cells are joined back in place of the old ones
    cleaned = F.concat(
        F.lit("["), F.array_join(F.transform(cells, lambda c: F.to_json(clean(c))), ","), F.lit("]")
    )
    rest = F.map_filter(as_map, lambda k, _: k != "cells")
    rebuilt = F.concat(
        F.lit('{"cells":'),
        cleaned,
        F.when(F.size(rest) > 0, F.concat(F.lit(","), F.substring(F.to_json(rest), 2, 1 << 30))).otherwise("}"),
    )
    return files.withColumn(content, F.coalesce(rebuilt, F.col(content)))
