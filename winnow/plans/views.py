"""Input views derived from the given tables.

Operators work on files, logs, runs and the like. Each view states such an
input as one SELECT over the tables, in the SQL that Spark and other engines
share, so that the same input can be checked elsewhere. ``<<name>>`` stands for
a table or another view.

Rendered files are small: a file gathers a fixed number of rows by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def text(template: str) -> str:
    """SQL for a text template: ``<expr>`` is a value, a newline is a line break."""
    parts = []
    for piece in re.split(r"(<[^<>]+>|\n)", template):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece.startswith("<"):
            parts.append(f"cast({piece[1:-1]} AS string)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts or ["''"]) + ")"


def choose(selector: str, variants: list[str]) -> str:
    """SQL that picks one text template by ``selector`` modulo the number of templates."""
    cases = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(variants))
    return f"CASE ({selector}) % {len(variants)} {cases} END"


def rendered(table: str, key: str, per_file: int, path: str, variants: list[str], columns: str = "") -> dict:
    """Files of ``per_file`` consecutive keys, one rendered line group per row."""
    return {
        "table": table,
        "group": f"cast(floor({key} / {per_file}) AS bigint)",
        "key": key,
        "path": path,
        "line": choose(key, variants),
        "columns": columns,
    }


# ── plain views ──────────────────────────────────────────────────────────────

VIEWS: dict[str, str] = {
    "files": """
        SELECT doc_id, concat(source, '/', cast(doc_id AS string), '.', ext) AS path, text AS content
        FROM (SELECT *, CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'js' WHEN 'de' THEN 'sql'
                        ELSE 'md' END AS ext FROM <<documents>>) d""",
    "page_files": """
        SELECT page_id, concat('pages/', cast(page_id AS string), '.txt') AS path, url AS content
        FROM <<pages>>""",
    "object_keys": """
        SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS key,
               cast(length(html) AS bigint) AS size
        FROM <<pages>>""",
    "runs": """
        SELECT event_id AS run_id, user_id AS job_id, ts AS started,
               CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS state,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props END AS error
        FROM <<events>>""",
    "logs": """
        SELECT event_id AS log_id, ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
                    WHEN 'signup' THEN 'NOTICE' ELSE 'INFO' END AS severity,
               CASE WHEN event_id % 2 = 0 THEN 'cloud_function' ELSE 'cloud_run' END AS resource,
               CASE WHEN user_id % 10 <> 3 THEN concat('fn-', cast(user_id AS string)) END AS name,
               CASE WHEN event_id % 2 = 0
                    THEN concat(upper(event_type), ' in event ', cast(event_id AS string)) END AS text,
               props AS payload
        FROM <<events>>""",
    "messages": """
        SELECT log_id, ts, severity, resource, name, coalesce(text, payload) AS message FROM <<logs>>""",
    "error_logs": "SELECT log_id, ts, name, message FROM <<messages>> WHERE severity = 'ERROR'",
    "jobs": """
        SELECT user_id AS job_id, concat('job-', cast(user_id AS string)) AS job_name
        FROM (SELECT DISTINCT user_id FROM <<events>>) u WHERE user_id % 10 <> 0""",
    "functions": """
        SELECT concat('projects/p/functions/fn-', cast(user_id AS string)) AS resource,
               concat('{"memory": ', cast(128 * (1 + user_id % 4) AS string), '}') AS config,
               CASE WHEN user_id % 4 = 1 THEN 'DEPLOYING' ELSE 'ACTIVE' END AS state,
               updated
        FROM (SELECT user_id, max(ts) AS updated FROM <<events>> GROUP BY user_id) u
        WHERE user_id % 10 <> 0""",
    "activations": "SELECT event_id, user_id, ts, value > 34.59 AS active FROM <<events>>",
    "commits": """
        SELECT o_orderkey AS commit_id, o_orderdate AS committed,
               CASE WHEN o_orderkey % 20 = 0
                    THEN concat('Merge branch ', cast(o_custkey AS string))
                    WHEN o_orderkey % 20 = 7
                    THEN concat('docs: page ', cast(o_orderkey AS string))
                    WHEN o_orderkey % 20 = 11
                    THEN concat('work on order ', cast(o_orderkey AS string))
                    ELSE concat(
                        CASE o_orderstatus WHEN 'F' THEN 'feat' WHEN 'O' THEN 'fix' ELSE 'chore' END,
                        '(', lower(substr(o_orderpriority, 3)), ')',
                        CASE WHEN o_totalprice > 400000 THEN '!' ELSE '' END,
                        ': order ', cast(o_orderkey AS string)) END AS subject
        FROM <<orders>>""",
    "topics": "SELECT n_nationkey AS topic, n_name AS topic_name FROM <<nation>>",
    "subscriptions": """
        SELECT s_nationkey * 2 AS topic, s_name AS subscription_name FROM <<supplier>>""",
    "json_docs": """
        SELECT o_orderkey AS doc_id, concat(
            '{"id": ', cast(o_orderkey AS string),
            ', "status": "', o_orderstatus, '"',
            CASE WHEN o_orderkey % 3 = 0 THEN ', "note": null' ELSE '' END,
            ', "urgent": ', CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END,
            ', "tags": ["', o_orderpriority, '", 2], "who": {"cust": ', cast(o_custkey AS string), '}',
            ', "ratio": 0.5',
            CASE WHEN o_orderkey % 2 = 0
                 THEN ', "a": 1, "b": "x", "c": [], "d": {}, "e": -3, "f": false' ELSE '' END,
            '}') AS doc
        FROM <<orders>>""",
    "machines": """
        SELECT concat('machine-', cast(100000000 + o_orderkey AS string)) AS name,
               CASE WHEN o_orderkey % 3 = 1 THEN 'not json'
                    ELSE concat('{"StartAt": "s0", "States": {"s0": {"Type": "Pass"}, "',
                                o_orderpriority, '": {"Type": "Task"}',
                                CASE WHEN o_orderstatus = 'F' THEN ', "done": {}' ELSE '' END,
                                '}}') END AS definition
        FROM <<orders>>""",
    "statuses": """
        SELECT o_custkey AS repo, concat(
            CASE o_orderkey % 7 WHEN 0 THEN '??' WHEN 1 THEN 'M ' WHEN 2 THEN ' M' WHEN 3 THEN 'MM'
                 WHEN 4 THEN 'A ' WHEN 5 THEN ' D' ELSE '' END,
            CASE WHEN o_orderkey % 7 = 6 THEN '' ELSE concat(' src/', cast(o_orderkey AS string)) END
        ) AS line
        FROM <<orders>>""",
    "clusters": """
        SELECT c_custkey AS cluster_id, c_name AS name,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'RUNNING' WHEN 'BUILDING' THEN 'PENDING'
                    ELSE 'TERMINATED' END AS state,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_nationkey AS bigint) END AS num_workers,
               CASE WHEN c_custkey % 5 = 0 THEN cast(1 AS bigint) END AS min_workers,
               CASE WHEN c_custkey % 5 = 0 THEN cast(c_nationkey + 2 AS bigint) END AS max_workers
        FROM <<customer>>""",
    "diagnostics": """
        SELECT l_orderkey AS doc, concat('ws/', cast(l_orderkey AS string), '.',
                   CASE l_orderkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'sql' ELSE 'rs' END) AS path,
               CASE l_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'sql'
                    ELSE 'rust' END AS language,
               cast(l_linenumber AS bigint) AS line, cast(l_quantity AS bigint) AS col,
               CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'info' END AS severity,
               concat(CASE l_partkey % 9 WHEN 0 THEN 'Hardcoded password' WHEN 1 THEN 'SQL injection risk'
                           WHEN 2 THEN 'XSS risk' WHEN 3 THEN 'Insecure deserialization'
                           WHEN 4 THEN 'insecure-url' WHEN 5 THEN 'weak-crypto' WHEN 6 THEN 'ValueError'
                           WHEN 7 THEN 'missing status_code' ELSE 'unused name' END,
                      ' ', cast(l_partkey AS string)) AS message,
               CASE WHEN l_suppkey % 3 <> 0 THEN concat('lint-', cast(l_suppkey AS string)) END AS source
        FROM <<lineitem>>""",
    "context_parts": """
        SELECT cast(floor(doc_id / 7) AS bigint) AS ctx, doc_id AS part_id,
               CASE doc_id % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'diff' WHEN 2 THEN 'plugin'
                    ELSE 'related' END AS kind,
               concat('f', cast(doc_id AS string)) AS path, text AS content
        FROM <<documents>>""",
    "generated": """
        SELECT doc_id, CASE doc_id % 5
            WHEN 0 THEN concat('## src/a', cast(doc_id AS string), '.py', chr(10), '```python', chr(10),
                               text, chr(10), '```', chr(10), '# lib/', source, '.js', chr(10), '```',
                               chr(10), 'x', chr(10), '```', chr(10))
            WHEN 1 THEN concat('## ../../etc/p', cast(doc_id AS string), '.txt', chr(10), '```', chr(10),
                               text, chr(10), '```', chr(10), '## ok/../b.ts', chr(10), '```ts', chr(10),
                               'y', chr(10), '```')
            WHEN 2 THEN concat('```', chr(10), text, chr(10), '```')
            WHEN 3 THEN ' '
            ELSE text END AS text
        FROM <<documents>>""",
    "settings_texts": """
        SELECT c_custkey AS id, concat('SECRET_KEY = ''k', cast(c_custkey AS string), '''', chr(10),
               'URL = ''db://u:', c_name, '@host/', c_mktsegment, '''', chr(10), 'DEBUG = True') AS content
        FROM <<customer>>""",
    "code_files": """
        SELECT concat('src/', source, '/', cast(doc_id AS string),
                      CASE WHEN doc_id % 3 = 0 THEN '/index.ts' WHEN doc_id % 3 = 1 THEN '.ts' ELSE '.js' END) AS path,
               concat('import a from ''./', cast(doc_id + 20 AS string), '''', chr(10),
                      'import b from ''../', cast(doc_id - 20 AS string), '.js''', chr(10),
                      'import c from ''../', source, '/', cast(doc_id + 40 AS string), '''', chr(10),
                      'import d from ''./', cast(doc_id + 20 AS string), '''', chr(10),
                      'import e from ''lodash''', chr(10), text) AS content
        FROM <<documents>>""",
    "responses": """
        SELECT event_id AS id, CASE event_id % 11 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 404
                 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 502 WHEN 7 THEN 503 WHEN 8 THEN 418
                 WHEN 9 THEN 404 ELSE 200 END AS code,
               CASE event_id % 3 WHEN 0 THEN concat('Model ', event_type) WHEN 1 THEN concat('Not Found ', props)
                 ELSE event_type END AS message,
               CASE event_id % 5 WHEN 0 THEN 'connect ECONNREFUSED 127.0.0.1' WHEN 1 THEN 'getaddrinfo ENOTFOUND host'
                 WHEN 2 THEN 'connect ETIMEDOUT' WHEN 3 THEN 'ENETUNREACH' ELSE props END AS system_error
        FROM <<events>>""",
    "key_columns": """
        SELECT concat('t', cast(p_partkey AS string)) AS table_name,
               concat('k', cast(p_size % 7 AS string)) AS attribute,
               CASE WHEN p_partkey % 2 = 0 THEN 'HASH' ELSE 'RANGE' END AS key_type
        FROM <<part>>""",
    "attributes": """
        SELECT concat('t', cast(p_partkey AS string)) AS table_name,
               concat('k', cast(p_size % 5 AS string)) AS attribute,
               CASE WHEN p_type = 'PROMO' THEN 'S' ELSE 'N' END AS attribute_type
        FROM <<part>>""",
    "instructions": "SELECT conv_id, turn, text AS instruction FROM <<conversations>>",
    "blames": """
        SELECT o_orderkey AS id, concat(
            lpad(cast(o_orderkey AS string), 40, 'a0'), ' 1 1 1', chr(10),
            CASE WHEN o_orderkey % 4 <> 0 THEN concat('author  ', o_orderpriority, ' ', chr(10)) ELSE '' END,
            'author-mail <x@y>', chr(10),
            CASE WHEN o_orderkey % 6 <> 0 THEN concat('summary order ', o_orderstatus, chr(10)) ELSE '' END,
            chr(9), 'code') AS content
        FROM <<orders>>""",
    "commit_log": """
        SELECT commit_id AS pos, CASE WHEN commit_id % 4 = 2 THEN '  '
               ELSE concat(lpad(cast(commit_id AS string), 7, '0'), ' ', subject) END AS line
        FROM <<commits>>""",
}

# ── rendered files: (path, content) or (ws, path, content) ───────────────────

RENDERED: dict[str, dict] = {
    "tf_files": rendered(
        "part", "p_partkey", 9, "infra/p<grp>.tf",
        [
            'provider "<lower(p_type)>" {\n}',
            'resource "<p_type>" "<p_name>" {}',
            'variable "v<p_partkey>" {\n  type    = string\n  default = "<p_name>"\n}',
            'variable "w<p_partkey>" { type = number }',
            "# plain line <p_name>",
            'resource "<p_brand>" "r<p_partkey>" {\n  size = "<p_size>"\n}',
            'variable "u<p_partkey>" {\n  default = <p_size>\n  }',
        ],
    ),
    "risky_files": rendered(
        "orders", "o_orderkey", 7, "app/o<grp>.py",
        [
            "password = \"secret<o_orderkey>\"",
            "  passwd='<o_orderstatus>'  # short",
            "pwd = os.environ['PWD<o_custkey>'] or 'abcdef'",
            "# password = \"commented<o_orderkey>\"",
            "\ufeff# password = \"marked<o_orderkey>\"",
            "\u3000// pwd = 'wide<o_custkey>'",
            "password\u00a0=\u2003\"spaced<o_orderkey>\"",
            "api_key = \"sk-<o_orderkey>-1234567890\"",
            "access_token='tok'",
            "AWS_SECRET_ACCESS_KEY = \"wJalrXUtnFEMI<o_custkey>\"",
            "-----BEGIN RSA PRIVATE KEY-----",
            "cursor.execute(\"SELECT <o_orderkey> \" + name)",
            "cursor.execute(\"SELECT %s\" + name)",
            "q = f\"SELECT * FROM t WHERE id = {user_<o_custkey>}\"",
            "q = f'DELETE FROM t WHERE id = {x}'",
            "sql = \"id = \" + req.params",
            "sql = 'id = ' + userId + '<o_orderkey>'",
            "el.innerHTML = x<o_orderkey>",
            "y = 1 // el.innerHTML = x",
            "document.write (x)",
            "return div(dangerouslySetInnerHTML={v})",
            "a = pickle.loads(data); b = pickle.load(f)",
            "config = yaml.load(data)",
            "config = yaml.load(data, Loader=yaml.SafeLoader)",
            "result = eval (x<o_custkey>)",
            "medieval(x)",
            "subprocess.exec(cmd)",
            "exec(\"git status\")",
            "url = 'http://host<o_custkey>.net/a'",
            "url = \"http://localhost:80\"; s = 'https://ok.org'",
            "see http://example.com/x",
            "ip = '10.0.<o_custkey % 256>.7' or '192.168.1.1'",
            "ip = '172.20.1.<o_orderkey % 256>'; // note",
            "h = hashlib.md5(x)",
            "h = hashlib.sha1(x)",
            "checksum = hashlib.sha1(x)",
            "checksum of password = hashlib.sha1(x)",
            "r = Math.random( )",
            "colorIndex = Math.random()",
            "cipher = DES.new(k); c2 = RC4",
            "éDES cipher x, DESx",
            "* DES in a list",
            "plain line <o_orderpriority>",
            "PASSWORD  =  'Abc<o_orderkey>' AND Blowfish http://a.b",
        ],
    ),
    "dockerfiles": rendered(
        "part", "p_partkey", 5, "svc/s<grp>/Dockerfile",
        [
            "FROM <lower(p_type)>:<p_size> AS s<p_size>",
            "RUN make <p_name>",
            "from <lower(p_brand)>",
            "  FROM indented",
            "FROM scratch as out<p_partkey>\nCOPY . /app",
            "# FROM comment",
        ],
    ),
    "k8s_files": rendered(
        "customer", "c_custkey", 4, "deploy/c<grp>.yaml",
        [
            "apiVersion: v1\nkind: <c_mktsegment>\nmetadata:\n  name: cust-<c_custkey>\n  namespace: ns-<c_nationkey>\n---",
            "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: app-<c_custkey>\n---  ",
            "kind: Service\nspec:\n        name: deep-<c_custkey>\n---",
            "notes: <c_name>\nnamespace: default\n---",
            "metadata:\n  namespace: default\n  name: only-<c_custkey>",
        ],
    ),
    "helm_files": rendered(
        "customer", "c_custkey", 1, "charts/c<cast(floor(grp / 2) AS bigint)>/<CASE WHEN grp % 2 = 0 THEN 'Chart.yaml' WHEN grp % 6 = 1 THEN 'other.yaml' ELSE 'values.yaml' END>",
        [
            "name: chart-<c_custkey>\nversion:  1.<c_nationkey>.0 \ndescription: <c_mktsegment> chart",
            "replicas: <c_nationkey>\nimage:\n  tag: x\nService_1: y\n# comment: z\n<lower(c_mktsegment)>: on",
            "name: chart-<c_custkey>\nversion: 2.0.0",
            "image: a\nresources:\n  cpu: 1",
        ],
    ),
    "compose_files": rendered(
        "part", "p_partkey", 6, "<CASE grp % 4 WHEN 0 THEN 'docker-compose.yml' WHEN 1 THEN 'docker-compose.yaml' WHEN 2 THEN 'compose.yml' ELSE 'compose.yaml' END>",
        [
            "services:\n  web<p_partkey>:\n    image: <lower(p_brand)>:<p_size>\n    ports:\n      - \"80:<p_size>\"",
            "  api-<p_partkey>:\n    image: x/<lower(p_type)>\n    healthcheck:\n      test: ok",
            "  job<p_partkey>:\n    ports: - 8080:<p_size> - '443:8443'\n    build: .",
            "  volumes:\n    data:",
            "  db<p_partkey>:\n    command: <p_name> <p_name> <p_name> <p_name> <p_name> <p_name> <p_name> <p_name>",
            "  long<p_partkey>:\n    command:" + " <p_name>" * 60 + "\n    image: far/<p_size>\n    HealthCheck: x",
        ],
        columns="cast(floor(grp / 3) AS bigint) AS ws",
    ),
    "dbt_projects": rendered(
        "customer", "c_custkey", 3, "proj/c<grp>/dbt_project.yml",
        [
            "name: 'shop_<c_custkey>'\nversion: \"1.<c_nationkey>\"\nmodel-paths: [\"models\", 'more_<c_nationkey>' ]",
            "profile: <lower(c_mktsegment)> \nmodels:\n  +materialized: table\n  a:\n    +materialized: 'view'",
            "    b:\n      +materialized: \"table\"\nseed-paths: [data]\ntest-paths: [\"t\"]",
            "macro-paths: []\n      +materialized: incremental",
        ],
    ),
    "dbt_model_files": rendered(
        "orders", "o_orderkey", 2, "<CASE WHEN grp % 5 = 4 THEN 'seeds' ELSE 'models' END>/o<grp>.<CASE WHEN grp % 7 = 6 THEN 'yml' ELSE 'sql' END>",
        [
            "{{ config(materialized='<CASE o_orderstatus WHEN 'F' THEN 'table' ELSE 'incremental' END>', unique_key='id') }}",
            "SELECT * FROM x -- <o_orderpriority>",
            "{{ config(tags=['a']) }}\nselect 1",
            "select <o_orderkey>",
        ],
    ),
    "dbt_source_files": rendered(
        "part", "p_partkey", 14, "models/p<grp>/<CASE grp % 3 WHEN 0 THEN 'schema.yml' WHEN 1 THEN 'sources.yaml' ELSE 'other.yml' END>",
        [
            "sources:\n  - name: src_<p_partkey>\n    schema: raw_<p_size>\n    tables:",
            "      - name: t_<p_partkey>\n",
            "      - name: '<p_name>'\n        description: <p_type>",
            "  - name: \"q_<p_partkey>\" \n    schema: 's_<p_size>'",
            "# nothing",
        ],
    ),
    "dag_files": rendered(
        "orders", "o_orderkey", 2, "<CASE WHEN grp % 6 = 5 THEN 'lib' ELSE 'dags' END>/d<grp>.py",
        [
            "from airflow import DAG\ndag = DAG(dag_id='dag_<o_orderkey>', schedule_interval=\"@daily\")",
            "with DAG('x', schedule=None) as dag:\n    pass",
            "@dag(schedule = timedelta(hours=<o_custkey % 24>))\ndef f(): pass",
            "x = 1  # <o_orderpriority>",
            "dag_id = \"p_<o_custkey>\"\nschedule='0 <o_custkey % 24> * * *'",
        ],
    ),
    "airflow_configs": rendered(
        "customer", "c_custkey", 3, "home/c<grp>/airflow.cfg",
        [
            "[core]\nexecutor = Local<c_mktsegment>Executor\ndags_folder = /opt/<c_custkey>/dags ",
            "sql_alchemy_conn = postgresql://u<c_custkey>:secret<c_custkey>@db/af",
            "max_active_runs_per_dag =  <c_nationkey>",
            "# none\nsql_alchemy_conn = sqlite:////tmp/<c_custkey>.db",
        ],
    ),
    "plugin_files": rendered(
        "customer", "c_custkey", 3, "<CASE WHEN grp % 8 = 7 THEN 'other' ELSE 'plugins' END>/c<grp>.py",
        [
            "class <c_mktsegment>Operator(BaseOperator):\n    pass",
            "class My<c_custkey>Sensor (Base): pass",
            "def helper(): pass",
            "class DbHook(BaseHook):\n    pass",
            "class Operators: pass",
        ],
    ),
    "api_files": rendered(
        "orders", "o_orderkey", 6, "api/o<grp>.py",
        [
            "@app.get('/orders/<o_orderkey>')\nasync def read_<o_orderkey>(db = Depends(get_db)):\n    return 1",
            "@router.post( \"/items/<o_custkey>\" )\n# note\n@cache\ndef create_<o_orderkey>(x):\n    pass",
            "@app.delete('/far/<o_orderkey>')\n#\n#\n#\ndef too_far(): pass",
            "class Item<o_custkey % 50>(BaseModel):\n    id: int\n    name: str\n    status_<o_orderkey>: str",
            "def get_db() -> Session:\n    db = make()\n    yield db\nclass Plain:\n    x: int",
            "class Other<o_orderkey>(Model):\n    a: int\n  b: int\n@router.options('/x')\n@app.head(prefix)",
            "user = Depends( current_user )\nx = Depends(get_db)",
        ],
    ),
    "django_files": rendered(
        "customer", "c_custkey", 1, "<CASE WHEN grp % 13 = 12 THEN 'migrations' ELSE concat('app', cast(cast(floor(grp / 7) AS bigint) AS string)) END>/<CASE grp % 7 WHEN 0 THEN 'models.py' WHEN 1 THEN 'urls.py' WHEN 2 THEN 'admin.py' WHEN 3 THEN 'utils.py' WHEN 4 THEN 'forms.py' WHEN 5 THEN 'sub/views.py' ELSE 'serializers.py' END>",
        [
            "class <c_mktsegment>(models.Model):\n    pass\nclass Sub<c_custkey>(BaseModelMixin):\n    pass",
            "class Plain:\n    pass",
            "class View<c_custkey>(TemplateView): pass\n class Inner(models.Model): pass",
        ],
    ),
    "settings_files": rendered(
        "customer", "c_custkey", 3, "sites/c<grp>/settings.py",
        [
            "SECRET_KEY = 'celery-<c_custkey>'\nINSTALLED_APPS = [\n    'django.contrib.admin',\n    'app_<c_nationkey>',\n    \"double\",\n]",
            "DATABASES = {\n    'default': {\n        'ENGINE': 'django.db.backends.<lower(c_mktsegment)>',\n    },\n}\nMIDDLEWARE = ['m.One', 'm.Two<c_custkey>']",
            "REST_FRAMEWORK = {}\nCORS = 'corsheaders'",
            "INSTALLED_APPS = ['rest_framework', 'channels']\nX = <c_custkey>",
        ],
    ),
    "pytest_files": rendered(
        "part", "p_partkey", 2, "<CASE grp % 5 WHEN 0 THEN 'tox.ini' WHEN 1 THEN 'setup.cfg' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'pyproject.toml' ELSE 'pytest.ini' END>",
        [
            "[pytest]\ntestpaths = tests/<p_partkey>, more",
            "markers =\n    slow: takes long\n    size<p_size>: by size\n    bad-name: no\naddopts = -v",
            "pytest-cov==<p_size>\npytest-<lower(p_type)>\nrequests",
            "[tool.other]\nx = 1",
        ],
        columns="cast(floor(grp / 3) AS bigint) AS ws",
    ),
    "conftests": rendered(
        "orders", "o_orderkey", 3, "t<grp>/conftest.py",
        [
            "@pytest.fixture\ndef fix_<o_custkey>():\n    pass",
            "@pytest.fixture(scope='<CASE o_orderstatus WHEN 'F' THEN 'session' ELSE 'module' END>')\ndef fix_<o_custkey>(x):\n    pass",
            "@pytest.fixture(autouse=True)\ndef fix_auto_<o_orderkey % 100>():\n    pass",
            "def helper(): pass",
        ],
    ),
    "test_files": rendered(
        "orders", "o_orderkey", 4, "pkg<grp % 40>/<CASE grp % 3 WHEN 0 THEN 'test_a' WHEN 1 THEN 'b_test' ELSE 'helper' END>_x<grp><CASE grp % 3 WHEN 1 THEN '_test' ELSE '' END>.py",
        [
            "def test_<o_orderkey>():\n    pass",
            "    def test_inner(self): pass",
            "def helper(): pass\ndef test_more(): pass",
        ],
    ),
    "torch_files": rendered(
        "part", "p_partkey", 5, "net/p<grp>.<CASE WHEN grp % 9 = 8 THEN 'pt' ELSE 'py' END>",
        [
            "class Net<p_partkey>(nn.Module):\n    loss = nn.<p_type>Loss()",
            "optimizer = torch.optim.Adam(params)\noptimizer.step()",
            "crit = torch.nn.CrossEntropyLoss(weight=None)\nopt = optim.SGD (p)",
            "class B(torch.nn.Module): pass\nfrom torch.utils.data import DataLoader",
            "# <p_name>",
            "with autocast(): pass\nmodel = DistributedDataParallel(model)",
            "x = 1",
        ],
    ),
    "scripts": rendered(
        "orders", "o_orderkey", 3, "scripts/o<grp>.py",
        ["# %% cell <o_orderkey>\nx = 1", "y = <o_custkey>", "  # %% indented", "z = 2", "w = 3"],
    ),
    "templates": rendered(
        "part", "p_partkey", 6, "stack<grp>/<CASE grp % 4 WHEN 0 THEN 'template.yaml' WHEN 1 THEN 'template.yml' WHEN 2 THEN 'template.json' ELSE 'other.yaml' END>",
        [
            "  T<p_partkey>:\n    Type: AWS::S3::<p_type>",
            "    Type: 'AWS::Lambda::Function'",
            "    Type: Other::X",
            "    Type: \"AWS::<p_type>::Thing\"",
            "AWSTemplateFormatVersion: 2010",
        ],
    ),
}

# One file per order; sixteen orders form a workspace. Used where a fact needs
# marker files, dependency files and sources side by side.
_WS_VARIANTS: list[tuple[str, str]] = [
    ("src/a<o_orderkey>.py", "import boto3\ns3 = boto3.client('s3')\nq = boto3.resource( \"sqs\" )"),
    ("src/b<o_orderkey>.ts", "import { X } from '@aws-sdk/client-dynamodb-<lower(o_orderstatus)>'\nexport async function handler(e) {}"),
    ("requirements.txt", "pyspark==4.0\ndjango-filter\n<lower(o_orderpriority)>"),
    ("src/c<o_orderkey>.py", "from pyspark.sql import SparkSession\ndf.write.format('delta')\nmlflow.start_run()"),
    ("README.md", "# Project <o_orderkey>\nhttp://example.com"),
    ("k8s/d<o_orderkey>.yaml", "apiVersion: v1\nkind: Pod"),
    ("docs/e<o_orderkey>.yaml", "kind: <o_orderstatus>"),
    ("main.py", "from fastapi import FastAPI\napp = FastAPI()\n@app.route('/x')"),
    ("src/f<o_orderkey>.js", "const s = new AWS.SNS()\nexports.handler = x"),
    ("function.json", "{\"bindings\": [{\"type\": \"<CASE o_orderstatus WHEN 'F' THEN 'timerTrigger' ELSE 'queueTrigger' END>\"}]}"),
    ("app.yaml", "runtime: python"),
    ("src/g<o_orderkey>.py", "from google.cloud.storage import Client\nimport google.cloud.bigquery\n# Firestore"),
    ("package.json", "{\"dependencies\": {\"@google-cloud/pubsub\": \"1\", \"@azure/identity\": \"2\"}}"),
    ("src/h<o_orderkey>.ts", "import { PubSub } from '@google-cloud/pubsub'\nexports.run = onRequest(x)"),
    ("bundle.yml", "bundle: <o_orderkey>"),
    ("databricks.yml", "x: 1"),
    ("src/i<o_orderkey>.py", "from azure.identity import DefaultAzureCredential\n@app.timer_trigger(x)\nBlobServiceClient()"),
    ("src/j<o_orderkey>.cs", "using Azure.Storage;\n[FunctionName(\"f\")] [BlobTrigger(\"x\")]"),
    ("pyproject.toml", "[tool.pytest.ini_options]\ndependencies = ['torch', 'fastapi']"),
    ("Dockerfile", "FROM python:3"),
    ("dags/k<o_orderkey>.py", "from airflow import DAG"),
    ("notebooks/l<o_orderkey>.ipynb", "{}"),
    ("terraform/m<o_orderkey>.tf", "provider \"google\" {}"),
    ("models/n<o_orderkey>.sql", "SELECT <o_orderkey>"),
    ("proj/settings.py", "INSTALLED_APPS = []"),
    ("src/o<o_orderkey>.py", "class WebStack(cdk.Stack): pass\ndef handler(event, ctx): pass"),
    ("jobs/job_<o_orderkey>.yml", "tasks: []"),
    (".databrickscfg", "[DEFAULT]"),
    ("src/dlt_<o_orderkey>.py", "@dlt.table\ndef t(): return spark.readStream.format('cloudFiles')"),
    (".env", "X=1\nAZURE_TENANT=<o_custkey>"),
    ("cloud-functions/p<o_orderkey>.py", "import functions_framework"),
]


# Further files of a workspace, so that every default hook has facts to collect.
_WS = "<cast(floor(o_orderkey / 64) AS bigint)>"
_HOOK_VARIANTS: list[tuple[str, str]] = _WS_VARIANTS + [
    (f"charts/c{_WS}/Chart.yaml", "name: web<o_orderkey>\nversion: 1.<o_orderkey % 7>\ndescription: x"),
    (f"charts/c{_WS}/values.yaml", "replicas: 1\n  nested: 2\nimage: web<o_orderkey>"),
    ("docker-compose.yml", "services:\n  web<o_orderkey>:\n    image: nginx\n  db:\n    image: pg\nvolumes:\n  data:\n"),
    ("compose.yaml", "services:\n  late:\n    image: x\n"),
    ("infra/q<o_orderkey>.tf", "resource \"aws_s3_bucket\" \"b<o_orderkey>\" {}\nvariable \"v<o_orderkey>\" { type = string }\nprovider \"aws\" {}"),
    ("stack/template.yaml", "  T:\n    Type: AWS::S3::Bucket\n  L:\n    Type: 'AWS::Lambda::Function'"),
    ("dbt_project.yml", "name: shop\nversion: '2.<o_orderstatus>'\nprofile: p"),
    ("models/staging/sources.yml", "sources:\n  - name: raw<o_orderkey>\n    schema: ext\n"),
    ("plugins/r<o_orderkey>.py", "class MyOperator(Base): pass\nclass S<o_orderkey>Sensor(Base): pass"),
    ("airflow.cfg", "executor = Local<o_orderstatus>\nsql_alchemy_conn = pg://u:p@h/db\n"),
    ("api/s<o_orderkey>.py", "from fastapi import Depends\n@router.get('/items/<o_orderkey>')\nasync def read(x=Depends(get_<o_orderstatus>)):\n    yield x\n@app.post(\"/y\")\nx = 1\n"),
    ("schemas/t<o_orderkey>.py", "from pydantic import BaseModel\nclass Item<o_orderstatus>(BaseModel):\n    a: int\n    b: str\nclass Other(Base):\n    c: int\n"),
    ("shop/models.py", "class A<o_orderkey>(models.Model):\n    x = 1\nclass B(BaseModel): pass"),
    ("blog/views.py", "x = <o_orderkey>"),
    ("pytest.ini", "[pytest]\ntestpaths = tests"),
    ("tests/conftest.py", "import pytest\n@pytest.fixture(scope='session')\ndef db<o_orderstatus>():\n    pass\n@pytest.fixture\ndef client():\n    pass"),
    ("tests/unit<o_orderkey % 3>/test_u<o_orderkey>.py", "def test_a(): pass\ndef test_b(): pass"),
    ("net/v<o_orderkey>.py", "import torch\nclass Net(nn.Module):\n    loss = nn.MSELoss()\nopt = optim.Adam(p)"),
    ("notebooks/w<o_orderkey>.ipynb", "{\"cells\": [{\"cell_type\": \"code\"}, {\"cell_type\": \"markdown\"}], \"metadata\": {\"kernelspec\": {\"name\": \"k<o_orderstatus>\", \"language\": \"python\"}}}"),
    ("git-status.txt", " M a.py\n?? b.py\nM  c<o_orderkey>.py\nMM d.py"),
    ("git-log.txt", "c1 <o_orderkey>\nc2\n\nc4\nc5\nc6"),
    ("src/x<o_orderkey>.py", "h = hashlib.md5(x)\nresult = eval(y)"),
    ("ops/template.json", "Type: \"AWS::SNS::Topic\""),
    ("k8s/ns<o_orderkey>.yml", "apiVersion: v1\nkind: Service\nmetadata:\n  name: svc<o_orderkey>\n  namespace: team<o_orderkey % 3>"),
]


def _workspace_sql(variants: list[tuple[str, str]], keys: int) -> str:
    pick = f"CASE (o_orderkey * 7) % {len(variants)}"
    paths = " ".join(f"WHEN {i} THEN {text(p)}" for i, (p, _) in enumerate(variants))
    contents = " ".join(f"WHEN {i} THEN {text(c)}" for i, (_, c) in enumerate(variants))
    return (
        f"SELECT cast(floor(o_orderkey / {keys}) AS bigint) AS ws, {pick} {paths} END AS path, "
        f"{pick} {contents} END AS content FROM <<orders>>"
    )


VIEWS["ws_files"] = _workspace_sql(_WS_VARIANTS, 16)
VIEWS["hook_files"] = _workspace_sql(_HOOK_VARIANTS, 64)

# ── building a view ──────────────────────────────────────────────────────────

_REFERENCE = re.compile(r"<<(\w+)>>")

# the one place where dialects differ: joining the lines of a rendered file
SPARK_JOIN = "listagg(line, chr(10)) WITHIN GROUP (ORDER BY ord)"
ANSI_JOIN = "string_agg(line, chr(10) ORDER BY ord)"


def _rendered_sql(spec: dict, joined: str) -> str:
    extra = f", {spec['columns']}" if spec["columns"] else ""
    rows = f"SELECT {spec['group']} AS grp, {spec['key']} AS ord, {spec['line']} AS line FROM <<{spec['table']}>>"
    return (
        f"SELECT {text(spec['path'])} AS path, content{extra} FROM "
        f"(SELECT grp, {joined} AS content FROM ({rows}) r GROUP BY grp) f"
    )


def view_sql(name: str, joined: str) -> str:
    return VIEWS[name] if name in VIEWS else _rendered_sql(RENDERED[name], joined)


def expand(sql: str, table: Callable[[str], str], joined: str) -> str:
    """Replace every reference by a table name or by the SELECT of the view."""

    def one(m: re.Match) -> str:
        name = m.group(1)
        if name in TABLES:
            return table(name)
        return "(" + expand(view_sql(name, joined), table, joined) + ")"

    return _REFERENCE.sub(one, sql)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder`` or a view over its tables."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    sql = expand(f"SELECT * FROM <<{name}>>", lambda t: f"parquet.`{folder}/{t}.parquet`", SPARK_JOIN)
    return spark.sql(sql)


def ansi(sql: str) -> str:
    """The same references for an engine where the tables are registered by name."""
    return expand(sql, lambda t: t, ANSI_JOIN)
