from winnow.operators import context


def test_request_text(spark):
    parts = spark.createDataFrame(
        [
            (1, "active", "src/a.py", "x" * 60), (1, "related", "src/a.test.py", "y"), (1, "diff", "d", "+1"),
            (1, "plugin", "p", "## Facts"), (1, "plugin", "q", ""), (2, "active", "b.md", ""),
        ],
        "ctx int, kind string, path string, content string",
    )
    errors = spark.createDataFrame(
        [(1, "src/a.py", line, 1, "error", f"m{line}") for line in range(9, 0, -1)],
        "ctx int, path string, line int, col int, severity string, message string",
    )
    asks = spark.createDataFrame([(1, "fix it"), (2, "explain")], "ctx int, instruction string")
    sections = context.context_sections(parts, errors, asks, 100)
    got = {r.ctx: r.request for r in context.request_texts(sections).collect()}
    assert got[1] == "\n\n".join(
        [
            "## Active file: src/a.py (python)",
            "```python\n" + "x" * 50 + "\n... (truncated to fit context budget)\n```",
            "## Errors (3):", "- [error] src/a.py:1 — m1", "- [error] src/a.py:2 — m2", "- [error] src/a.py:3 — m3",
            "## Git changes:\n+1", "## Facts", "## Related: src/a.test.py\n```python\ny\n```", "## Instruction:\nfix it",
        ]
    )
    assert got[2] == "## Active file: b.md (text)\n\n```text\n\n```\n\n## Instruction:\nexplain"


def test_selected_text_stands_for_the_file(spark):
    parts = spark.createDataFrame(
        [(1, "active", "a.py", "whole"), (1, "selection", "a.py", "part"), (2, "selection", "b.py", "no file"), (3, "active", "c.py", "x"), (3, "selection", "c.py", "")],
        "ctx int, kind string, path string, content string",
    )
    none = spark.createDataFrame([], "ctx int, path string, line int, col int, severity string, message string")
    asks = spark.createDataFrame([(1, "go"), (2, "go"), (3, "go")], "ctx int, instruction string")
    got = {r.ctx: r.request for r in context.request_texts(context.context_sections(parts, none, asks)).collect()}
    assert got[1] == "## Active file: a.py (python)\n\n### Selected:\n```\npart\n```\n\n## Instruction:\ngo"
    assert got[2] == "## Instruction:\ngo" and "```python\nx\n```" in got[3]


def test_related_files_share_the_budget_they_are_shown_in(spark):
    parts = spark.createDataFrame(
        [(1, "related", f"f{i}", "z" * 100) for i in range(9)], "ctx int, kind string, path string, content string"
    )
    none = spark.createDataFrame([], "ctx int, path string, line int, col int, severity string, message string")
    asks = spark.createDataFrame([], "ctx int, instruction string")
    texts = [r.text for r in context.context_sections(parts, none, asks, 200).collect()]
    assert len(texts) == 5 and all("\n" + "z" * 10 + "\n..." in t for t in texts)
