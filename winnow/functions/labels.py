"""Labels, classes and short descriptions for telemetry and catalog rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions.text import as_col

# Fixed values: (keywords, label) in order of precedence, then the default.
TASK_KEYWORDS = [
    (["explain", "what"], "explain code"),
    (["test"], "generate tests"),
    (["fix"], "fix errors"),
    (["refactor"], "refactor code"),
]
TASK_DEFAULT = "assist with this request"

# Severity names, lowest first.
SEVERITIES = ["DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]


def classify_task(instruction: Column | str) -> Column:
    """Task label by the first keyword group found, ignoring case."""
    low = F.lower(as_col(instruction))
    out = F.lit(TASK_DEFAULT)
    for words, label in reversed(TASK_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def classify_error(code: Column | str, message: Column | str) -> Column:
    """Error class from an HTTP status and its body."""
    code, low = as_col(code), F.lower(F.coalesce(as_col(message), F.lit("")))
    model = F.contains(low, F.lit("model")) | F.contains(low, F.lit("not found"))
    return (
        F.when(code.isin(401, 403), "auth")
        .when((code == 404) & model, "model-missing")
        .when(code == 404, "not-found")
        .when(code == 429, "rate-limit")
        .when(code.isin(500, 502, 503), "server")
        .otherwise("other")
    )


def classify_connection_error(message: Column | str) -> Column:
    """Connection error class from a system error text."""
    m = as_col(message)
    return (
        F.when(F.contains(m, F.lit("ECONNREFUSED")), "refused")
        .when(F.contains(m, F.lit("ENOTFOUND")), "host-not-found")
        .when(F.contains(m, F.lit("ETIMEDOUT")) | F.contains(m, F.lit("ENETUNREACH")), "unreachable")
        .otherwise("connection")
    )


def severity_rank(c: Column | str) -> Column:
    """Position in the severity order; unknown names rank lowest."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.greatest(F.array_position(names, F.upper(as_col(c))), F.lit(1))


def log_text(text: Column | str, payload: Column | str, n: int | None = None) -> Column:
    """Text payload, or the (first ``n`` characters of the) JSON payload."""
    js = F.coalesce(as_col(payload), F.lit("{}"))
    return F.coalesce(as_col(text), js if n is None else F.left(js, F.lit(n)))


def workers_label(workers: Column | str, low: Column | str, high: Column | str) -> Column:
    low, high = as_col(low), as_col(high)
    fixed = F.concat(F.coalesce(as_col(workers), F.lit(0)).cast("string"), F.lit(" workers"))
    auto = F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" workers (autoscale)"))
    return F.when(low.isNotNull() & high.isNotNull(), auto).otherwise(fixed)


def ready_status(conditions: Column | str) -> Column:
    """State of the first condition typed ``Ready`` in an array<struct<type,state>>."""
    ready = F.get(F.filter(as_col(conditions), lambda c: c["type"] == "Ready"), 0)["state"]
    return F.when(ready == "CONDITION_SUCCEEDED", "Ready").otherwise(
        F.coalesce(ready, F.lit("Unknown"))
    )


def schema_text(
    name: Column | str, type_text: Column | str, required: Column, comment: Column | str
) -> Column:
    """One line per column: name, type, NOT NULL mark and comment."""
    note = F.when(as_col(comment) != "", F.concat(F.lit(" — "), as_col(comment)))
    return F.concat(
        F.lit("  - `"), as_col(name), F.lit("` "), as_col(type_text),
        F.when(required, " NOT NULL").otherwise(""), F.coalesce(note, F.lit("")),
    )


def job_label(tasks: Column | str, cron: Column | str, zone: Column | str) -> Column:
    """Task keys and schedule of a job; ``tasks`` is an array<string>."""
    keys = F.coalesce(F.array_join(as_col(tasks), ", "), F.lit("none"))
    schedule = F.concat(F.lit("Schedule: "), as_col(cron), F.lit(" ("), as_col(zone), F.lit(")"))
    return F.concat(
        F.lit("Tasks=["), keys, F.lit("] | "), F.coalesce(schedule, F.lit("No schedule"))
    )


def map_text(c: Column | str, separator: str = "\n", indent: str = "  ") -> Column:
    """``key=value`` entries of a map, in key order; ``(none)`` when it is null."""
    entries = F.array_sort(F.map_entries(as_col(c)))
    lines = F.transform(entries, lambda e: F.concat(F.lit(indent), e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(lines, separator), F.lit("(none)"))


def is_failed(state: Column | str, error: Column | str | None = None) -> Column:
    """Failed in any spelling: a state equal to FAILED in any case, or an error present."""
    failed = F.coalesce(F.upper(as_col(state)) == "FAILED", F.lit(False))
    return failed if error is None else failed | as_col(error).isNotNull()


def from_epoch_millis(c: Column | str) -> Column:
    """Epoch milliseconds, as a number or a numeric string, to a timestamp."""
    return F.timestamp_millis(as_col(c).try_cast("bigint"))


def from_epoch_seconds(c: Column | str) -> Column:
    return F.timestamp_seconds(as_col(c))


def from_iso(c: Column | str) -> Column:
    return F.try_to_timestamp(as_col(c))
