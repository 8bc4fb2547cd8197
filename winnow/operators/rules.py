"""Rule tables. Patterns, names, severities and messages are fixed values."""

from __future__ import annotations

from typing import NamedTuple


class ScanRule(NamedTuple):
    rule_id: int
    pattern: str
    category: str
    severity: str
    message: str
    exclude: str | None
    # literals of which every matching line holds at least one, as written
    needs: tuple[str, ...]
    # the same, but longer words; lower case where the pattern ignores case
    hints: tuple[str, ...]

    @property
    def ignores_case(self) -> bool:
        return self.pattern.startswith("(?i)")


# The 21 scan rules, in order.
SCAN_RULES = [
    ScanRule(
        1,
        r"""(?i)\b(?:password|passwd|pwd)\s*=\s*["'][^"']{3,}["']""",
        "secret",
        "high",
        "Hardcoded password detected. Use environment variables or a secrets manager.",
        r"(?i)(?:os\.environ|os\.getenv|getenv|environ\[|secrets\.|vault|bcrypt|hash|_hash|hash_)",
        ("=",),
        ("password", "passwd", "pwd"),
    ),
    ScanRule(
        2,
        r"""(?i)\b(?:api_key|apikey|api_secret|secret_key|auth_token|access_token)\s*=\s*["'][^"']{6,}["']""",
        "secret",
        "high",
        "Hardcoded API key or secret detected. Use environment variables or a secrets manager.",
        r"(?i)(?:os\.environ|os\.getenv|getenv|environ\[|secrets\.|vault)",
        ("=",),
        ("api_key", "apikey", "api_secret", "secret_key", "auth_token", "access_token"),
    ),
    ScanRule(
        3,
        r"""\bAWS_(?:SECRET_ACCESS_KEY|ACCESS_KEY_ID|SESSION_TOKEN)\s*=\s*["'][^"']{8,}["']""",
        "secret",
        "high",
        "Hardcoded AWS credential detected. Use IAM roles or environment variables.",
        r"(?i)(?:os\.environ|os\.getenv|getenv|environ\[)",
        ("=",),
        ("AWS_",),
    ),
    ScanRule(
        4,
        r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
        "secret",
        "high",
        "Private key material found in source code. Store keys in a secrets manager.",
        None,
        ("-----BEGIN",),
        ("-----BEGIN",),
    ),
    ScanRule(
        5,
        r"""(?i)(?:execute|query|cursor\.execute)\s*\(\s*["'][^"']*["']\s*\+""",
        "sql-injection",
        "high",
        "Potential SQL injection: string concatenation in SQL query. Use parameterized queries.",
        r"(?:%s|%d|\?|\$\d|:param)",
        ("(",),
        ("execute", "query"),
    ),
    ScanRule(
        6,
        r"""(?i)f["']SELECT\s+.*\{""",
        "sql-injection",
        "high",
        "Potential SQL injection: f-string used in SQL query. Use parameterized queries.",
        None,
        ("{",),
        ("f\"select", "f'select"),
    ),
    ScanRule(
        7,
        r"""(?i)f["'](?:INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*\{""",
        "sql-injection",
        "high",
        "Potential SQL injection: f-string used in SQL mutation. Use parameterized queries.",
        None,
        ("{",),
        ('f"', "f'"),
    ),
    ScanRule(
        8,
        r"""["']\s*\+\s*(?:req(?:uest)?\.(?:body|params|query|param)|user(?:Input|_input|name)|userId|user_id)""",
        "sql-injection",
        "high",
        "Potential SQL injection: user input concatenated into query string. Use parameterized queries.",
        None,
        ("+",),
        ("req", "user"),
    ),
    ScanRule(
        9,
        r"\.innerHTML\s*=",
        "xss",
        "high",
        "XSS risk: innerHTML assignment. Use textContent or sanitize input with DOMPurify.",
        r"(?:\/\/|\/\*|\*|#)\s*.*innerHTML",
        ("=",),
        (".innerHTML",),
    ),
    ScanRule(
        10,
        r"document\.write\s*\(",
        "xss",
        "high",
        "XSS risk: document.write() injects raw HTML. Use safe DOM APIs instead.",
        None,
        ("(",),
        ("document.write",),
    ),
    ScanRule(
        11,
        r"dangerouslySetInnerHTML\s*=",
        "xss",
        "medium",
        "XSS risk: dangerouslySetInnerHTML. Ensure value is sanitized before use.",
        None,
        ("=",),
        ("dangerouslySetInnerHTML",),
    ),
    ScanRule(
        12,
        r"pickle\.loads?\s*\(",
        "deserialization",
        "high",
        "Insecure deserialization: pickle.load() can execute arbitrary code. Use JSON or a safe format.",
        None,
        ("(",),
        ("pickle.load",),
    ),
    ScanRule(
        13,
        r"yaml\.load\s*\(",
        "deserialization",
        "high",
        "Insecure deserialization: yaml.load() without SafeLoader. Use yaml.safe_load() instead.",
        r"yaml\.safe_load|Loader\s*=\s*yaml\.SafeLoader",
        ("(",),
        ("yaml.load",),
    ),
    ScanRule(
        14,
        r"\beval\s*\(",
        "deserialization",
        "high",
        "Dangerous eval() call. Avoid executing dynamic code from untrusted input.",
        r"(?:\/\/|#|\/\*|\*)\s*.*\beval\b",
        ("(",),
        ("eval",),
    ),
    ScanRule(
        15,
        r"""\bexec\s*\(\s*(?!["'](?:git|ls|dir|cd|make|npm|pip|python|bash|sh)\b)""",
        "deserialization",
        "medium",
        "Potentially unsafe exec() call. Validate input before executing dynamic code.",
        r"(?:\/\/|#|\/\*|\*)\s*.*\bexec\b",
        ("(",),
        ("exec",),
    ),
    ScanRule(
        16,
        r"http:\/\/(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])",
        "insecure-url",
        "medium",
        "Insecure HTTP URL detected. Use HTTPS to encrypt data in transit.",
        r"(?i)(?:example\.com|test|localhost|placeholder|todo|fixme|schema|namespace|xmlns|dtd|w3\.org|ietf\.org)",
        ("http://",),
        ("http://",),
    ),
    ScanRule(
        17,
        r"\b(?:192\.168\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b",
        "insecure-url",
        "low",
        "Hardcoded private IP address detected. Use configuration or service discovery instead.",
        r"(?i)(?:\/\/|#|\*|example|test|sample|placeholder)",
        ("192.168.", "10.", "172."),
        ("192.168.", "10.", "172."),
    ),
    ScanRule(
        18,
        r"hashlib\.md5\s*\(",
        "weak-crypto",
        "high",
        "MD5 is cryptographically broken. Use SHA-256 or SHA-3 for security-sensitive hashing.",
        None,
        ("(",),
        ("hashlib.md5",),
    ),
    ScanRule(
        19,
        r"hashlib\.sha1\s*\(",
        "weak-crypto",
        "medium",
        "SHA-1 is deprecated for security use. Use SHA-256 or SHA-3 instead.",
        r"(?i)(?:git|content.address|deduplicate|checksum(?!.*password))",
        ("(",),
        ("hashlib.sha1",),
    ),
    ScanRule(
        20,
        r"Math\.random\s*\(\s*\)",
        "weak-crypto",
        "medium",
        "Math.random() is not cryptographically secure. Use crypto.getRandomValues() or crypto.randomBytes().",
        r"(?i)(?:\/\/|#|test|mock|sample|color|position|index|offset)",
        ("(",),
        ("Math.random",),
    ),
    ScanRule(
        21,
        r"\b(?:DES|RC4|Blowfish)\b",
        "weak-crypto",
        "high",
        "Weak or deprecated cipher detected. Use AES-256-GCM or ChaCha20-Poly1305.",
        r"(?i)(?:\/\/|#|\*|comment|doc|test)",
        ("DES", "RC4", "Blowfish"),
        ("DES", "RC4", "Blowfish"),
    ),
]

_JS_FUNCTION = (
    r"^\s*(export\s+)?(async\s+)?function\s+\w+|^\s*(const|let)\s+\w+\s*=\s*(async\s*)?\("
)

# Language to the pattern of a line that opens a function.
FUNCTION_PATTERNS = {
    "python": r"^\s*(async\s+)?def\s+\w+\s*\(",
    "javascript": _JS_FUNCTION,
    "typescript": _JS_FUNCTION,
    "javascriptreact": _JS_FUNCTION,
    "typescriptreact": _JS_FUNCTION,
    "java": r"^\s*(public|private|protected|static|\s)+[\w<>\[\]]+\s+\w+\s*\(",
    "go": r"^\s*func\s+",
    "rust": r"^\s*(pub\s+)?(async\s+)?fn\s+",
    "cpp": r"^\s*[\w:*&<>]+\s+\w+\s*\([^;]*\)\s*\{",
    "c": r"^\s*[\w*]+\s+\w+\s*\([^;]*\)\s*\{",
    "csharp": r"^\s*(public|private|protected|static|\s)+(async\s+)?[\w<>\[\]]+\s+\w+\s*\(",
    "ruby": r"^\s*def\s+\w+",
    "php": r"^\s*(public|private|protected|static|\s)*function\s+\w+",
    "shellscript": r"^\s*(function\s+\w+|\w+\s*\(\s*\))",
    "sql": r"(?i)^\s*(CREATE|ALTER)\s+(PROCEDURE|FUNCTION|VIEW)\s+",
}


# Literals of which every line that opens a function holds at least one; languages
# whose pattern ignores case are not listed.
FUNCTION_NEEDS = {
    "python": ("def",),
    "javascript": ("function", "const", "let"),
    "typescript": ("function", "const", "let"),
    "javascriptreact": ("function", "const", "let"),
    "typescriptreact": ("function", "const", "let"),
    "java": ("(",),
    "go": ("func",),
    "rust": ("fn",),
    "cpp": ("{",),
    "c": ("{",),
    "csharp": ("(",),
    "ruby": ("def",),
    "php": ("function",),
    "shellscript": ("function", "("),
}


class LineAction(NamedTuple):
    action: str
    pattern: str
    languages: tuple[str, ...]  # empty: every language
    # literals of which every matching line holds at least one; lower case where
    # the pattern ignores case
    needs: tuple[str, ...]
    # a pattern that every matching line matches too and that is found sooner; in place of the literals
    hint: str = ""

    @property
    def ignores_case(self) -> bool:
        return self.pattern.startswith("(?i)")


_DJANGO_MODEL = r"^class\s+\w+\s*\(\s*(?:models\.Model|[\w.]*Model[\w.]*)\s*\)"
_TORCH_MODULE = r"class\s+\w+\s*\(\s*(?:nn\.Module|torch\.nn\.Module)\s*\)"
_ROUTE = r"@(?:app|router)\.(get|post|put|delete|patch)"
_TF_RESOURCE = r'^resource\s+"[^"]+"\s+"[^"]+"'
_DBT_HEAD = r"(?i)\{\{\s*config\s*\(|^\s*SELECT\s"

# Line actions.
LINE_ACTIONS = [
    LineAction("spark.explain_job", r"def\s+\w+|spark\s*=\s*SparkSession|\.read\.|\.write\.|\.transform\(", ("python",), ("def", "spark", ".read.", ".write.", ".transform(")),
    LineAction("spark.optimise_query", r"\.select\(|\.filter\(|\.join\(|\.groupBy\(|spark\.sql\(", ("python", "sql"), (".select(", ".filter(", ".join(", ".groupBy(", "spark.sql(")),
    LineAction("spark.to_dataframe", r"spark\.sql\(", ("python",), ("spark.sql(",)),
    LineAction("spark.add_dlt", r"^def\s+\w+", ("python",), ("def",)),
    LineAction("spark.add_tracking", r"(?i)def\s+(train|fit|run|evaluate|model)\w*", ("python",), ("def",)),
    LineAction("dbt.explain_model", r"(?i)^\s*SELECT\s", ("sql", "jinja-sql"), ("select",)),
    LineAction("dbt.add_test", _DBT_HEAD, ("sql", "jinja-sql"), ("select", "{{")),
    LineAction("dbt.generate_docs", _DBT_HEAD, ("sql", "jinja-sql"), ("select", "{{")),
    LineAction("airflow.explain_dag", r"DAG\(|@dag", ("python",), ("DAG(", "@dag")),
    LineAction("airflow.add_sensor", r"@task|def \w+_task|Operator\(", ("python",), ("@task", "_task", "Operator(")),
    LineAction("airflow.to_taskflow", r"Operator\(", ("python",), ("Operator(",)),
    LineAction("k8s.explain_resource", r"^apiVersion:\s*\S+", ("yaml",), ("apiVersion:",)),
    LineAction("k8s.add_probes", r"^\s+containers:", ("yaml",), ("containers:",)),
    LineAction("k8s.add_limits", r"^\s+- name:\s*\S+", ("yaml",), ("- name:",)),
    LineAction("docker.explain_stage", r"(?i)^FROM\s+", ("dockerfile",), ("from",)),
    LineAction("docker.optimize_layers", r"(?i)^RUN\s+", ("dockerfile",), ("run",)),
    LineAction("terraform.explain_resource", _TF_RESOURCE, ("terraform",), ("resource",)),
    LineAction("terraform.add_variable", r'^\s+[a-z_]+\s*=\s*"[^"]*[0-9][^"]*"', ("terraform",), ("=",)),
    LineAction("terraform.add_output", _TF_RESOURCE, ("terraform",), ("resource",)),
    LineAction("fastapi.explain_endpoint", _ROUTE, ("python",), ("@app", "@router")),
    LineAction("fastapi.add_validation", r"^(?:async\s+)?def\s+\w+\s*\(", ("python",), ("def",)),
    LineAction("fastapi.add_test", _ROUTE, ("python",), ("@app", "@router")),
    LineAction("django.explain_model", _DJANGO_MODEL, ("python",), ("class",)),
    LineAction("django.add_serializer", _DJANGO_MODEL, ("python",), ("class",)),
    LineAction("django.add_view", _DJANGO_MODEL, ("python",), ("class",)),
    LineAction("pytest.generate_test", r"^def (?!test_)\w+\s*\(", ("python",), ("def ",)),
    LineAction("pytest.add_parametrize", r"^def test_\w+\s*\(", ("python",), ("def test_",)),
    LineAction("pytest.add_fixture", r"^def test_\w+\s*\(", ("python",), ("def test_",)),
    LineAction("pytorch.explain_model", _TORCH_MODULE, ("python",), ("class",)),
    LineAction("pytorch.training_loop", _TORCH_MODULE, ("python",), ("class",)),
    LineAction("pytorch.add_checkpoint", r"(?i)def\s+(?:train|fit|run_epoch|training_step)\w*", ("python",), ("def",)),
    LineAction("jupyter.explain_notebook", r"^# %%", ("python",), ("# %%",)),
    LineAction("jupyter.add_docs", r"^# %%", ("python",), ("# %%",)),
    LineAction(
        "gcp.explain_function",
        r"@functions_framework\.\w+|@app\.route|exports\.\w+\s*=\s*(?:async\s+)?(?:function|\()"
        r"|onRequest|onCall|onDocumentCreated|onObjectFinalized",
        ("python", "javascript", "typescript"),
        ("functions_framework", "@app.route", "exports.", "onRequest", "onCall", "onDocumentCreated", "onObjectFinalized"),
    ),
    LineAction(
        "gcp.optimize_function",
        r"def\s+\w+\(.*(?:request|event|cloud_event)|exports\.\w+\s*=|module\.exports",
        ("python", "javascript", "typescript"),
        ("def", "exports"),
    ),
    LineAction(
        "gcp.optimize_bigquery",
        r"(?i)\.query\(|bigquery\.Client|SELECT\s+.+\s+FROM|CREATE\s+TABLE|MERGE\s+INTO",
        ("python", "javascript", "typescript", "sql"),
        (".query(", "bigquery.client", "select", "create", "merge"),
    ),
    LineAction(
        "gcp.firestore_operation",
        r"\.collection\(|\.document\(|\.doc\(|firestore\.client|db\.collection|\.set\(|\.update\(|\.where\(",
        ("python", "javascript", "typescript"),
        (".collection", ".document(", ".doc(", "firestore.client", ".set(", ".update(", ".where("),
    ),
    LineAction(
        "azure.explain_function",
        r"\[FunctionName\s*\(|@app\.(route|function_name|timer_trigger|queue_trigger|blob_trigger|cosmos_db_trigger)"
        r"|def\s+main\s*\(.*func\.HttpRequest",
        ("python", "csharp"),
        ("FunctionName", "@app.", "func.HttpRequest"),
    ),
    LineAction(
        "azure.explain_resource",
        r'^resource\s+\w+|"type"\s*:\s*"Microsoft\.\w+|module\s+\w+',
        ("bicep", "json"),
        ("resource", "Microsoft.", "module"),
    ),
    LineAction(
        "azure.add_retry",
        r"BlobServiceClient|CosmosClient|ServiceBusClient|EventHubProducerClient|SecretClient|SearchClient"
        r"|QueueClient|TableClient|DefaultAzureCredential",
        ("python", "csharp", "typescript", "javascript"),
        ("Client", "DefaultAzureCredential"),
    ),
    LineAction(
        "azure.to_bicep",
        r'"\$schema"\s*:\s*"https:\/\/schema\.management\.azure\.com',
        ("json",),
        ("schema.management.azure.com",),
    ),
    LineAction(
        "azure.debug_function",
        r"\[FunctionName\s*\(|@app\.(route|function_name|timer_trigger|queue_trigger)|def\s+main\s*\(.*func\.HttpRequest",
        ("python", "csharp"),
        ("FunctionName", "@app.", "func.HttpRequest"),
    ),
    LineAction(
        "azure.deploy_function",
        r"\[FunctionName\s*\(|@app\.(route|function_name)|azure-functions",
        ("python", "csharp", "typescript", "javascript"),
        ("FunctionName", "@app.", "azure-functions"),
    ),
    LineAction(
        "aws.optimize_lambda",
        r"async\s+def\s+handler\s*\(event|def\s+handler\s*\(event|exports\.handler\s*="
        r"|export\s+(?:async\s+)?function\s+handler",
        ("python", "javascript", "typescript"),
        ("handler",),
    ),
    LineAction("aws.explain_resource", r"""Type:\s*['"]?AWS::""", ("yaml", "json"), ("AWS::",)),
    LineAction(
        "aws.to_cdk",
        r"""AWSTemplateFormatVersion|Resources:|Type:\s*['"]?AWS::""",
        ("yaml", "json"),
        ("AWSTemplateFormatVersion", "Resources:", "AWS::"),
    ),
    LineAction(
        "aws.explain_construct",
        r"new\s+\w+\.\w+Function|new\s+lambda\.\w+|new\s+dynamodb\.\w+|new\s+s3\.\w+"
        r"|new\s+apigateway\.\w+|new\s+sqs\.\w+",
        ("typescript", "javascript", "python"),
        ("new",),
    ),
    LineAction(
        "aws.add_error_handling",
        r"boto3\.client|boto3\.resource|new\s+\w+Client\(|\.send\(new\s+\w+Command",
        ("python", "typescript", "javascript"),
        ("boto3.", "Client(", "Command"),
    ),
    LineAction("aws.debug_lambda", r"""boto3\.client\s*\(\s*['"]lambda['"]""", ("python",), ("lambda",)),
    LineAction("aws.debug_glue", r"""boto3\.client\s*\(\s*['"]glue['"]""", ("python",), ("glue",)),
    LineAction("aws.browse_s3", r"""boto3\.client\s*\(\s*['"]s3['"]""", ("python",), ("s3",)),
    LineAction("catalog.explain_table", r"\b\w+\.\w+\.\w+\b", ("python", "sql"), (".",), r"\.\w+\.\w"),
    LineAction(
        "catalog.run_sql",
        r"(?i)spark\.sql\(|SELECT\s+|INSERT\s+|MERGE\s+|CREATE\s+|ALTER\s+",
        ("python", "sql"),
        ("spark.sql(", "select", "insert", "merge", "create", "alter"),
    ),
    LineAction(
        "git.blame",
        r"^\s*(?:def |async def |function |const |class |public |private |protected |export |static )",
        (),
        ("def ", "function ", "const ", "class ", "public ", "private ", "protected ", "export ", "static "),
    ),
]


class DiagnosticAction(NamedTuple):
    action: str
    pattern: str | None  # None: always offered
    languages: tuple[str, ...]


# Actions offered for a file when a diagnostic message matches.
DIAGNOSTIC_ACTIONS = [
    DiagnosticAction("fix_secret", r"(?i)secret|password|api.key", ()),
    DiagnosticAction("fix_sql", r"(?i)sql.injection", ()),
    DiagnosticAction("fix_xss", r"(?i)xss", ("javascript", "typescript", "javascriptreact", "typescriptreact")),
    DiagnosticAction("fix_deserialization", r"(?i)deserialization", ()),
    DiagnosticAction("fix_url", r"(?i)insecure.url", ()),
    DiagnosticAction("fix_crypto", r"(?i)weak.crypto", ()),
    DiagnosticAction("add_http_exception", r"HTTPException|status_code|raise", ("python",)),
    DiagnosticAction("add_raises", r"Exception|Error|raises", ("python",)),
]
