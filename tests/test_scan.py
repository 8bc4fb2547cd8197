import re

import pytest
from pyspark.sql import functions as F

from winnow.functions.text import any_of
from winnow.operators import scan
from winnow.operators.rules import FUNCTION_NEEDS, FUNCTION_PATTERNS, LINE_ACTIONS, SCAN_RULES


def findings(spark, *texts):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    return scan.security_scan(files).collect()


@pytest.mark.parametrize(
    "line, category, severity",
    [
        ('password = "mysecret123"', "secret", "high"),
        ('api_key = "sk-1234567890abcdef"', "secret", "high"),
        ('AWS_SECRET_ACCESS_KEY = "wJalrXUtnFEMI/K7MDENG"', "secret", "high"),
        ('"SELECT * FROM users WHERE id = " + userId', "sql-injection", "high"),
        ('f"SELECT * FROM users WHERE id = {user_id}"', "sql-injection", "high"),
        ("element.innerHTML = userInput", "xss", "high"),
        ("return <div dangerouslySetInnerHTML={val} />", "xss", "medium"),
        ("pickle.loads(data)", "deserialization", "high"),
        ("config = yaml.load(data)", "deserialization", "high"),
        ("result = eval(userInput)", "deserialization", "high"),
        ("hashlib.md5(password)", "weak-crypto", "high"),
        ("exec(cmd)", "deserialization", "medium"),
        ("exec( 'git')", "deserialization", "medium"),
        ("x = hashlib.sha1(b) # checksum of the password", "weak-crypto", "medium"),
    ],
)
def test_detected(spark, line, category, severity):
    assert (category, severity) in [(f.category, f.severity) for f in findings(spark, line)]


@pytest.mark.parametrize(
    "line, category",
    [
        ('password = os.environ["DB_PASSWORD"]', "secret"),
        ("password_hash = bcrypt.hash(password)", "secret"),
        ("element.textContent = userInput", "xss"),
        ("config = yaml.safe_load(data)", "deserialization"),
        ("digest = hashlib.sha256(data)", "weak-crypto"),
        ('cursor.execute("SELECT * FROM users WHERE id = %s", (user_id,))', "sql-injection"),
        ("# password must be at least 8 characters", "secret"),
        ("// password is stored in the vault, not here", "secret"),
        ('exec("git status")', "deserialization"),
        ("http://localhost:8080/x", "insecure-url"),
        ("checksum = hashlib.sha1(b)", "weak-crypto"),
    ],
)
def test_not_detected(spark, line, category):
    assert category not in [f.category for f in findings(spark, line)]


def test_position_is_zero_based(spark):
    (f,) = findings(spark, 'import os\npassword = "hunter2"\n')
    assert (f.line_no, f.column, f.end_column, f.pattern) == (1, 0, 20, 'password = "hunter2"')


def test_position_counts_code_points(spark):
    (f,) = findings(spark, "😀é DES x")
    assert (f.rule_id, f.column, f.end_column) == (21, 3, 6)


def test_accented_letters_are_no_word_characters(spark):
    assert [f.rule_id for f in findings(spark, "éDES x", "aDES x")] == [21]


def test_first_match_only_and_rule_order(spark):
    got = findings(spark, "a = DES; b = RC4; c = hashlib.md5(hashlib.md5(x))")
    assert [f.rule_id for f in got] == [18, 21]


def test_match_is_cut_to_80(spark):
    (f,) = findings(spark, 'password = "' + "x" * 200 + '"')
    assert len(f.pattern) == 80 and f.end_column == 213


def test_null_and_empty_text(spark):
    assert findings(spark, None, "", "\n\n") == []


def test_gates_never_hide_a_match(spark):
    """The literals only speed the scan up: without them the findings are the same."""
    lines = [
        'password = "mysecret123"', "PWD='abcd'", "Api_Key = 'abcdefgh'", "document.write (x)", "eval (x)",
        "Execute ( 'a' + b", "Query('x' +y)", "f'select {x}'", "f\"Insert into {t}\"", "' + request.body", "\" +req.params",
        "http://[::2]/", "10.1.2.3", "192.168.0.1", "172.31.0.9", "Blowfish", "Math.random( )", "yaml.load (x)",
        "-----BEGIN PRIVATE KEY-----", "AWS_SESSION_TOKEN='12345678'",
    ]
    open_rules = [r._replace(needs=("",), hints=("",)) for r in SCAN_RULES]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "path string, content string")
    gated = sorted(map(tuple, scan.security_scan(files).collect()))
    ungated = sorted(map(tuple, scan.security_scan(files, open_rules).collect()))
    assert gated == ungated and len({r[2] for r in gated}) >= 15


def test_line_action_gates_never_hide_a_match(spark):
    lines = [
        "def train(x):", "  SELECT a", "{{ config(x) }}", "x = DAG(", "@dag", "@task", "def my_task(): pass", "BashOperator(",
        "apiVersion: v1", "  containers:", "  - name: x", "From a", "run make", 'resource "a" "b"', '  size = "3"',
        "@app.get('/')", "@router.post", "class A(models.Model)", "class N(nn.Module)", "# %%", "const x", "df.select(x)",
        "def test_a(", "spark.sql(q)", "DEF Fit", "spark = SparkSession", ".read.csv",
        "@functions_framework.http", "exports.a = (", "def f(request)", "client.Query('x')", "select a FROM b", "db.collection('x')",
        "[FunctionName (", "@app.blob_trigger", "def main(req: func.HttpRequest)", '"type" : "Microsoft.Web', "new SecretClient()",
        '{"$schema": "https://schema.management.azure.com/x"}', "import azure-functions", "exports.handler =", "Type: 'AWS::S3::B'",
        "Resources:", "new s3.Bucket", "x.send(new PutCommand", "boto3.client('glue')", 'boto3.client("lambda")', "boto3.client( 's3')",
        "a.b.c", "éa.b.c", "merge into x",
    ]
    languages = ["python", "sql", "yaml", "dockerfile", "terraform", "jinja-sql", "json", "bicep", "csharp", "typescript"]
    rows = [(str(i), t, lang) for i, t in enumerate(lines) for lang in languages]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    gated = sorted(map(tuple, scan.tag_lines(files).collect()))
    ungated = sorted(map(tuple, scan.tag_lines(files, [a._replace(needs=()) for a in LINE_ACTIONS]).collect()))
    assert gated == ungated and {r[-1] for r in gated} == {a.action for a in LINE_ACTIONS}


def test_one_search_finds_what_each_literal_finds(spark):
    plain, any_case = ["[a", "]b", "-x", "^q", "def", "def ", "# %%", ".select(", "\\d", "&&"], ["from", "fro.", "é"]
    lines = ["[a", "xx]b", "a-x", "^q", "def", "# %%", "a.select(b", "\\d", "&&", "FROM", "Fro.", "é", "DEF", "a", "[", "fro", ".select", "", "& &"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: r.hit for r in df.select("line", F.rlike("line", F.lit(any_of(plain, any_case))).alias("hit")).collect()}
    assert got == {x: any(w in x for w in plain) or any(w in x.lower() for w in any_case) for x in lines}
    assert all(r.hit for r in df.select(F.rlike("line", F.lit(any_of(["a", ""]))).alias("hit")).collect())


def test_each_line_is_searched_once_for_the_actions_of_its_language(spark):
    """Lines are neither lowered nor searched literal by literal before they are known to hold one."""
    files = spark.createDataFrame([("a", "x. y", "python")], "path string, content string, language string")
    plan = scan.tag_lines(files)._jdf.queryExecution().optimizedPlan().toString()
    (gate,) = [x for x in plan.splitlines() if re.match(r"\W*Filter ", x) and "RLIKE" in x]
    languages = {x for a in LINE_ACTIONS for x in a.languages}
    assert "lower(" not in gate and "Contains(" not in gate and gate.count("RLIKE") == len(languages) + 1


def test_hints_never_hide_a_match(spark):
    lines = ["a.b.c", "éa.b.c", "a.b.é", "a.b. c", "..a", "a..b", "a.b.cé", "1.2.3", ".a.b", "x .a.b", "End. Of. It.", "_._._"]
    hinted = [a for a in LINE_ACTIONS if a.hint]
    rows = [(x, x, lang) for x in lines for lang in ("python", "sql", "yaml", None)]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    with_hint = sorted((r.path, r.language) for r in scan.tag_lines(files, hinted).collect())
    without = sorted((r.path, r.language) for r in scan.tag_lines(files, [a._replace(hint="", needs=()) for a in hinted]).collect())
    word = r"\b\w+\.\w+\.\w+\b"
    assert with_hint == without == sorted((x, y) for x in lines for y in ("python", "sql") if re.search(word, x, re.ASCII))


def test_actions_of_every_language_need_no_language(spark):
    files = spark.createDataFrame([("a", "x\nclass A", None), ("b", "class A", "cobol")], "path string, content string, language string")
    assert sorted(map(tuple, scan.tag_lines(files).select("path", "line_no", "action").collect())) == [("a", 1, "git.blame"), ("b", 0, "git.blame")]


def test_function_gates_never_hide_a_match(spark):
    lines = [
        "def f(x):", "async def g (", "export async function h", "const a = (", "let b= async (", "  public int run(",
        "func main", "pub fn x", "int main(void) {", "char *p(a) {", "public async Task<T> Go(", "private function z",
        "function w", "deploy ( )", "create view ", "ALTER PROCEDURE x",
    ]
    rows = [(str(i), t, lang) for i, t in enumerate(lines) for lang in FUNCTION_PATTERNS]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    gated = sorted(map(tuple, scan.index_functions(files).collect()))
    ungated = sorted(map(tuple, scan.index_functions(files, dict(FUNCTION_PATTERNS)).collect()))
    assert gated == ungated and len(gated) > 20
    assert set(FUNCTION_NEEDS) <= set(FUNCTION_PATTERNS)


def test_order_and_partitioning_do_not_matter(spark):
    files = spark.createDataFrame(
        [(str(i), f"x = eval(a{i})\npwd = 'abc{i}'") for i in range(200)], "path string, content string"
    )
    one = sorted(map(tuple, scan.security_scan(files.coalesce(1)).collect()))
    many = sorted(map(tuple, scan.security_scan(files.orderBy(F.rand(7)).repartition(13)).collect()))
    assert one == many and len(one) == 400


def test_diagnostics(spark):
    diags = spark.createDataFrame(
        [
            ("ws/a.py", "python", 0, 0, "XSS here", "error", None),
            ("ws/b.js", "javascript", 4, 2, "xss there", "warning", "lint"),
            ("ws/c.py", "python", 1, 1, "secret", "info", None),
            ("other/d.py", "python", 1, 1, "secret", "error", None),
        ],
        "path string, language string, line long, col long, message string, severity string, source string",
    )
    got = {r.path: (r.line, r.col, r.source) for r in scan.filter_diagnostics(diags, "ws/").collect()}
    assert got == {"ws/a.py": (1, 1, "unknown"), "ws/b.js": (5, 3, "lint")}
    actions = {(r.path, r.action) for r in scan.match_actions(diags).collect()}
    assert ("ws/b.js", "fix_xss") in actions and ("ws/a.py", "fix_xss") not in actions


def test_boundaries_are_those_of_ascii(spark):
    """Every pattern with a word boundary agrees with an engine whose boundary is ASCII."""
    from winnow.functions.text import ascii_boundary
    from winnow.operators.packs.stacks import STACK_RULES

    patterns = [r.pattern for r in SCAN_RULES] + [r.exclude for r in SCAN_RULES if r.exclude]
    patterns += [r.content for r in STACK_RULES if r.content] + [a.pattern for a in LINE_ACTIONS]
    patterns = sorted({p for p in patterns if r"\b" in p})
    words = ["eval(", "exec(", "exec('git'", "password='abcd'", "AWS_SESSION_TOKEN='12345678'", "10.1.2.3", "DES", "RC4", "fastapi",
             "django", "torch", "a.b.c", "// eval", "# exec"]
    around = ["{}", "x{}", "{}x", "é{}", "{}é", "_{}", " {} ", "-{}.", "1{}", "{}9", "é{}é x{}"]
    lines = [a.replace("{}", w) for a in around for w in words]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", *[F.rlike("line", F.lit(ascii_boundary(p))).alias(f"p{i}") for i, p in enumerate(patterns)])
    for row in got.collect():
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == bool(re.search(p, row.line, re.ASCII)), (p, row.line)
    assert len(patterns) >= 8
