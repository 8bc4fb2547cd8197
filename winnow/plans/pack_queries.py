"""Extraction packs over rendered files, checked with independently written patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.packs import cloud, containers, data, documents, infra, ml, repo, stacks, testing, web
from winnow.operators.packs.cloud import (
    AZURE_BINDING_TRIGGERS,
    AZURE_CODE_TRIGGERS,
    AZURE_SERVICES,
    GCP_FLAGS,
    SPARK_FLAGS,
)
from winnow.plans.registry import Source, query
from winnow.plans.text_queries import notebook_files


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _joined(c: str) -> Column:
    return F.array_join(c, ", ").alias(c)


def _matches(sql_from: str, pattern: str, keys: str = "path") -> str:
    """Rows (keys, pos, m) of all whole matches of a pattern."""
    found = f"regexp_extract_all(content, {_quote(pattern)})"
    return f"""SELECT {keys}, unnest({found}) AS m,
                      CAST(generate_subscripts({found}, 1) - 1 AS INTEGER) AS pos FROM {sql_from}"""


# ── containers ───────────────────────────────────────────────────────────────

_MANIFESTS = r"""(SELECT * FROM <<k8s_files>> WHERE regexp_matches(content, 'apiVersion:\s*\S+')
                  AND regexp_matches(content, 'kind:\s*\S+'))"""


@query(
    rf"""WITH docs AS (
           SELECT path, unnest(string_split_regex(content, '(?m)^---\s*$')) AS doc,
                  CAST(generate_subscripts(string_split_regex(content, '(?m)^---\s*$'), 1) - 1 AS INTEGER) AS doc_no
           FROM {_MANIFESTS} f)
         SELECT path, doc_no, regexp_extract(doc, '(?m)^kind:\s*(\S+)', 1) AS kind,
                coalesce(nullif(regexp_extract(doc, '(?m)^\s{{0,4}}name:\s*(\S+)', 1), ''), '(unnamed)') AS name,
                coalesce(nullif(regexp_extract(doc, '(?m)^\s{{0,4}}namespace:\s*(\S+)', 1), ''), 'default') AS namespace
         FROM docs WHERE regexp_matches(doc, '(?m)^kind:\s*\S+')"""
)
def k8s_manifests(src: Source) -> DataFrame:
    return containers.k8s_manifests(src("k8s_files"))


@query(
    rf"""SELECT DISTINCT trim(regexp_extract(line, '^ {{0,4}}namespace: (.*)$', 1)) AS namespace
         FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM {_MANIFESTS} f) l
         WHERE line LIKE '%namespace: %' AND line NOT LIKE '%namespace: default'"""
)
def k8s_namespaces(src: Source) -> DataFrame:
    return containers.k8s_namespaces(src("k8s_files"))


@query(
    r"""WITH c AS (SELECT replace(path, '/Chart.yaml', '') AS dir, content FROM <<helm_files>> WHERE path LIKE '%/Chart.yaml'),
             v AS (SELECT replace(path, '/values.yaml', '') AS dir,
                          regexp_extract_all(content, '(?m)^([a-zA-Z][a-zA-Z0-9_]*):', 1) AS keys
                   FROM <<helm_files>> WHERE path LIKE '%/values.yaml')
        SELECT c.dir, trim(regexp_extract(content, '(?m)^name:\s*(.+)', 1)) AS name,
               trim(regexp_extract(content, '(?m)^version:\s*(.+)', 1)) AS version,
               trim(regexp_extract(content, '(?m)^description:\s*(.+)', 1)) AS description,
               coalesce(array_to_string(v.keys[1:20], ', '), '') AS value_keys
        FROM c LEFT JOIN v ON c.dir = v.dir"""
)
def helm_charts(src: Source) -> DataFrame:
    return containers.helm_chart(src("helm_files")).withColumn("value_keys", _joined("value_keys"))


@query(
    f"""SELECT path, pos, regexp_extract(m, '(?i)^from\\s+(\\S+)', 1) AS base,
               coalesce(nullif(regexp_extract(m, '(?i)\\s+as\\s+(\\S+)$', 1), ''), 'stage' || pos) AS name
        FROM ({_matches("<<dockerfiles>>", r"(?im)^FROM\s+(?:\S+)(?:\s+AS\s+(?:\S+))?")}) x"""
)
def dockerfile_stages(src: Source) -> DataFrame:
    return containers.dockerfile_stages(src("dockerfiles"))


def _services_sql(files: str, keys: str) -> str:
    """Service keys by line, each with its lines up to the next key or to a line without indent."""
    return rf"""lines AS (
           SELECT {keys}, content, unnest(string_split(content, chr(10))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) AS no FROM {files}),
         placed AS (
           SELECT *, count(*) FILTER (regexp_matches(line, '^  \w[\w-]*:\s*$|^\S'))
                     OVER (PARTITION BY {keys} ORDER BY no) AS part FROM lines),
         parts AS (
           SELECT {keys}, part, min(no) AS no, string_agg(line, chr(10) ORDER BY no) AS snippet FROM placed GROUP BY {keys}, part),
         services AS (
           SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY no) - 1 AS INTEGER) AS pos,
                  regexp_extract(snippet, '^  (\w[\w-]*):', 1) AS name, snippet
           FROM parts WHERE regexp_matches(split_part(snippet, chr(10), 1), '^  \w[\w-]*:\s*$')),
         kept AS (SELECT * FROM services WHERE name NOT IN ('networks', 'volumes', 'configs', 'secrets'))"""


@query(
    rf"""WITH {_services_sql("<<compose_files>>", "ws, path")}
         SELECT ws, path, pos, name, regexp_extract(snippet, 'image:\s*(\S+)', 1) AS image,
                array_to_string(regexp_extract_all(regexp_extract(snippet, 'ports:([^\n]*)', 1),
                                '- ["'']?(\d[\d.:/-]+)["'']?', 1), ', ') AS ports,
                contains(lower(snippet), 'healthcheck:') AS has_healthcheck
         FROM kept"""
)
def compose_services(src: Source) -> DataFrame:
    found = containers.compose_services(src("compose_files"))
    return found.withColumn("ports", _joined("ports"))


@query(
    rf"""WITH ranked AS (
           SELECT *, row_number() OVER (PARTITION BY ws ORDER BY list_position(
             ['docker-compose.yml', 'docker-compose.yaml', 'compose.yml', 'compose.yaml'], path)) AS rn
           FROM <<compose_files>>),
         {_services_sql("(SELECT ws, path, content FROM ranked WHERE rn = 1) r", "ws, path")}
         SELECT ws, path, pos, name FROM kept"""
)
def compose_service_names(src: Source) -> DataFrame:
    return containers.compose_service_names(src("compose_files"))


# ── infrastructure ───────────────────────────────────────────────────────────


@query(
    f"""SELECT provider, f.path AS path, f.pos AS pos FROM (
          SELECT string_split(m, '"')[2] AS provider, min({{'path': path, 'pos': pos}}) AS f
          FROM ({_matches("<<tf_files>>", r'provider\s+"[^"]+"')}) x GROUP BY 1) y"""
)
def tf_providers(src: Source) -> DataFrame:
    return infra.tf_providers(src("tf_files"))


@query(
    f"""SELECT path, pos, string_split(m, '"')[2] AS type, string_split(m, '"')[4] AS name
        FROM ({_matches("<<tf_files>>", r'resource\s+"[^"]+"\s+"[^"]+"')}) x"""
)
def tf_resources(src: Source) -> DataFrame:
    return infra.tf_resources(src("tf_files"))


@query(
    rf"""SELECT path, pos, string_split(m, '"')[2] AS name,
               nullif(regexp_extract(body, 'type\s*=\s*(\S+)', 1), '') AS type,
               CASE WHEN regexp_matches(body, 'default\s*=\s*"?[^"\n]+')
                    THEN trim(regexp_extract(body, 'default\s*=\s*"?([^"\n]+)', 1)) END AS "default"
        FROM (SELECT *, regexp_extract(m, '(?s)\{{(.*)\}}$', 1) AS body
              FROM ({_matches("<<tf_files>>", r'(?s)variable\s+"[^"]+"\s*\{[^}]*\}')}) x) y"""
)
def tf_variables(src: Source) -> DataFrame:
    return infra.tf_variables(src("tf_files"))


@query(
    f"""SELECT type, f.path AS path, f.pos AS pos FROM (
          SELECT regexp_extract(m, 'AWS::.*') AS type, min({{'path': path, 'pos': pos}}) AS f
          FROM ({_matches("(SELECT * FROM <<templates>> WHERE path NOT LIKE '%other.yaml') t", r"Type:\s*['\"]?AWS::\w+::\w+")}) x
          GROUP BY 1) y"""
)
def cfn_resources(src: Source) -> DataFrame:
    return infra.cfn_resources(src("templates"))


# ── data projects ────────────────────────────────────────────────────────────


def _setting(key: str, default: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_extract(content, '(?m)^{key}:\\s*[''\"]?([^''\"\\n\\r]+)', 1)), ''), '{default}') AS {key}"
    )


def _paths(kind: str, default: str) -> str:
    raw = f"regexp_extract(content, '{kind}-paths:\\s*\\[([^\\]]+)\\]', 1)"
    items = f"list_transform(string_split({raw}, ','), lambda x: trim(replace(replace(x, '''', ''), '\"', '')))"
    return f"CASE WHEN {raw} = '' THEN '{default}' ELSE array_to_string({items}, ', ') END AS {kind}_paths"


@query(
    f"""WITH mats AS (
          SELECT path, string_agg(m, ', ' ORDER BY pos) AS ms FROM (
            SELECT path, m, min(pos) AS pos FROM (
              SELECT path, unnest(regexp_extract_all(content, '\\+materialized:\\s*[''"]?(\\w+)', 1)) AS m,
                     generate_subscripts(regexp_extract_all(content, '\\+materialized:\\s*[''"]?(\\w+)', 1), 1) AS pos
              FROM <<dbt_projects>>) a GROUP BY path, m) b GROUP BY path)
        SELECT p.path, {_setting("name", "unknown")}, {_setting("version", "1.0.0")}, {_setting("profile", "default")},
               {_paths("model", "models")}, {_paths("test", "tests")}, {_paths("macro", "macros")}, {_paths("seed", "seeds")},
               coalesce(ms, '') AS materializations
        FROM <<dbt_projects>> p LEFT JOIN mats ON p.path = mats.path"""
)
def dbt_projects(src: Source) -> DataFrame:
    found = data.dbt_project(src("dbt_projects"))
    lists = ["model_paths", "test_paths", "macro_paths", "seed_paths", "materializations"]
    return found.withColumns({c: _joined(c) for c in lists})


@query(
    r"""SELECT path, coalesce(nullif(regexp_extract(
              regexp_extract(content, '\{\{\s*config\s*\(([^)]+)\)\s*\}\}', 1), 'materialized\s*=\s*[''"](\w+)', 1), ''), 'view')
              AS materialization
        FROM <<dbt_model_files>> WHERE path LIKE 'models/%' AND path LIKE '%.sql'"""
)
def dbt_models(src: Source) -> DataFrame:
    return data.dbt_models(src("dbt_model_files"))


_SOURCE_FILES = "(SELECT * FROM <<dbt_source_files>> WHERE path NOT LIKE '%other.yml' AND contains(content, 'sources:')) s"


@query(
    rf"""WITH blocks AS ({_matches(_SOURCE_FILES, r'''- name:\s*['"]?[^'"\n\r]+['"]?\s*\n(?:\s+schema:\s*['"]?[^'"\n\r]+['"]?)?''')}),
         names AS (
           SELECT path, string_agg(trim(n), ', ' ORDER BY k) AS tables FROM (
             SELECT path, unnest(regexp_extract_all(content, '- name:\s*[''"]?([^''"\n\r]+)[''"]?\s*\n', 1)) AS n,
                    generate_subscripts(regexp_extract_all(content, '- name:\s*[''"]?([^''"\n\r]+)[''"]?\s*\n', 1), 1) AS k
             FROM {_SOURCE_FILES}) x GROUP BY path)
         SELECT b.path, pos, trim(regexp_extract(m, 'name:\s*[''"]?([^''"\n\r]+)', 1)) AS name,
                coalesce(nullif(trim(regexp_extract(m, 'schema:\s*[''"]?([^''"\n\r]+)', 1)), ''),
                         trim(regexp_extract(m, 'name:\s*[''"]?([^''"\n\r]+)', 1))) AS schema, tables
         FROM blocks b JOIN names n ON b.path = n.path"""
)
def dbt_sources(src: Source) -> DataFrame:
    return data.dbt_sources(src("dbt_source_files"))


@query(
    r"""SELECT path, coalesce(nullif(regexp_extract(content, 'dag_id\s*=\s*[''"]([^''"]+)', 1), ''),
                              regexp_extract(path, '([^/]*)\.py$', 1)) AS dag_id,
               coalesce(nullif(regexp_extract(content, 'schedule(?:_interval)?\s*=\s*[''"]([^''"]+)[''"]', 1), ''),
                        nullif(regexp_extract(content, 'schedule(?:_interval)?\s*=\s*(None|timedelta\([^)]+\))', 1), '')) AS schedule
        FROM <<dag_files>> WHERE path LIKE 'dags/%'"""
)
def airflow_dags(src: Source) -> DataFrame:
    return data.airflow_dags(src("dag_files"))


def _cfg(key: str) -> str:
    return f"nullif(trim(regexp_extract(content, '(?m)^{key}\\s*=\\s*(.+)$', 1)), '')"


@query(
    f"""SELECT path, {_cfg("executor")} AS executor,
               regexp_replace({_cfg("sql_alchemy_conn")}, ':[^:@]+@', ':***@') AS database_conn,
               {_cfg("dags_folder")} AS dag_folder, {_cfg("max_active_runs_per_dag")} AS max_active_runs
        FROM <<airflow_configs>>"""
)
def airflow_configs(src: Source) -> DataFrame:
    return data.airflow_config(src("airflow_configs"))


@query(
    " UNION ALL ".join(
        rf"""SELECT path, regexp_extract(path, '([^/]*)\.py$', 1) AS name, '{kind.lower()}' AS kind FROM <<plugin_files>>
             WHERE path LIKE 'plugins/%' AND regexp_matches(content, 'class\s+\w+{kind}\s*\(')"""
        for kind in ("Operator", "Sensor", "Hook")
    )
)
def airflow_components(src: Source) -> DataFrame:
    return data.airflow_components(src("plugin_files"))


# ── web frameworks ───────────────────────────────────────────────────────────

_METHODS = "get|post|put|delete|patch|head|options"


@query(
    rf"""WITH lines AS (
           SELECT path, unnest(string_split(content, chr(10))) AS line,
                  CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM <<api_files>>),
         ahead AS (
           SELECT *, {", ".join(rf"nullif(regexp_extract(coalesce(lead(line, {i}) OVER w, ''), '(?:async\s+)?def\s+(\w+)\s*\(', 1), '') AS f{i}" for i in (1, 2, 3))}
           FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no))
         SELECT path, line_no, upper(regexp_extract(line, '@(?:app|router)\.({_METHODS})', 1)) AS method,
                regexp_extract(line, '\(\s*[''"]([^''"]+)', 1) AS route, coalesce(f1, f2, f3, '(unknown)') AS "function"
         FROM ahead WHERE regexp_matches(line, '@(?:app|router)\.(?:{_METHODS})\s*\(\s*[''"][^''"]+[''"]')
           AND path IN (SELECT path FROM lines WHERE regexp_matches(line, '@(?:app|router)\.(?:get|post|put|delete|patch)'))"""
)
def fastapi_routes(src: Source) -> DataFrame:
    return web.fastapi_routes(src("api_files"))


@query(
    rf"""SELECT CAST(sum(len(regexp_extract_all(content, '@(?:app|router)\.(?:{_METHODS})\s*\('))) AS BIGINT) AS n_routes
         FROM <<api_files>>"""
)
def fastapi_route_count(src: Source) -> DataFrame:
    return web.fastapi_route_count(src("api_files"))


@query(
    r"""WITH bodies AS (
          SELECT path, unnest(string_split(content, chr(10) || 'class ')) AS b,
                 generate_subscripts(string_split(content, chr(10) || 'class '), 1) AS k
          FROM <<api_files>> WHERE contains(content, 'BaseModel') OR contains(content, 'pydantic')),
        classes AS (
          SELECT path, k, CASE WHEN k = 1 THEN b ELSE 'class ' || b END AS body FROM bodies),
        models AS (
          SELECT path, k, regexp_extract(body, '^class\s+(\w+)\s*\(\s*(?:Base)?Model\s*\)', 1) AS name,
                 len(regexp_extract_all(body, '(?m)^\s{4}\w+\s*:')) AS n_fields FROM classes
          WHERE regexp_matches(body, '^class\s+\w+\s*\(\s*(?:Base)?Model\s*\)'))
        SELECT name, path, n_fields FROM (
          SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, k) AS rn FROM models) m WHERE rn = 1"""
)
def pydantic_models(src: Source) -> DataFrame:
    return web.pydantic_models(src("api_files"))


@query(
    r"""WITH calls AS (
          SELECT path, unnest(regexp_extract_all(content, 'Depends\s*\(\s*(\w+)\s*\)', 1)) AS d,
                 generate_subscripts(regexp_extract_all(content, 'Depends\s*\(\s*(\w+)\s*\)', 1), 1) AS k FROM <<api_files>>),
        firsts AS (SELECT path, d, min(k) AS k FROM calls GROUP BY path, d),
        named AS (SELECT path, string_agg(d, ', ' ORDER BY k) AS ds FROM firsts GROUP BY path)
        SELECT f.path, coalesce(ds, '') AS depends,
               len(regexp_extract_all(content, 'def\s+\w+\s*\([^)]*\)\s*(?:->\s*\w+\s*)?:(?s:.)*?yield')) AS n_yield
        FROM <<api_files>> f LEFT JOIN named ON f.path = named.path WHERE contains(content, 'Depends')"""
)
def fastapi_dependencies(src: Source) -> DataFrame:
    return web.fastapi_dependencies(src("api_files")).withColumn("depends", _joined("depends"))


@query(
    rf"""SELECT name, f.path AS path, f.pos AS pos FROM (
           SELECT trim(string_split_regex(m, '[()]')[2]) AS name, min({{'path': path, 'pos': pos}}) AS f
           FROM ({_matches("<<api_files>>", r"Depends\s*\(\s*\w+\s*\)")}) x GROUP BY 1) y"""
)
def dependency_names(src: Source) -> DataFrame:
    return web.dependency_names(src("api_files"))


_DJANGO_NAMES = ["models", "views", "urls", "admin", "forms", "serializers"]


@query(
    f"""SELECT * FROM (
          SELECT split_part(path, '/', 1) AS app,
                 {", ".join(f"bool_or(split_part(path, '/', 2) = '{n}.py') AS has_{n}" for n in _DJANGO_NAMES)}
          FROM <<django_files>> WHERE length(path) - length(replace(path, '/', '')) = 1
            AND split_part(path, '/', 1) <> 'migrations'
            AND split_part(path, '/', 2) IN ({", ".join(f"'{n}.py'" for n in _DJANGO_NAMES)}) GROUP BY 1) a
        WHERE has_models OR has_views"""
)
def django_apps(src: Source) -> DataFrame:
    return web.django_apps(src("django_files"))


@query(
    r"""SELECT app, array_to_string(ms, ', ') AS models FROM (
          SELECT split_part(path, '/', 1) AS app,
                 regexp_extract_all(content, '(?m)^class\s+(\w+)\s*\(\s*(?:models\.Model|[\w.]*Model[\w.]*)\s*\)', 1) AS ms
          FROM <<django_files>> WHERE path LIKE '%/models.py' AND path NOT LIKE 'migrations/%') x WHERE len(ms) > 0"""
)
def django_models(src: Source) -> DataFrame:
    return web.django_models(src("django_files")).withColumn("models", _joined("models"))


@query(
    r"""WITH safe AS (SELECT path, regexp_replace(content, '(?m)SECRET_KEY\s*=.*$', '', 'g') AS c FROM <<settings_files>>)
        SELECT path,
          array_to_string(regexp_extract_all(regexp_extract(c, '(?s)INSTALLED_APPS\s*=\s*\[.*?\]'), '''([\w.]+)''', 1)[1:20], ', ') AS installed_apps,
          array_to_string(regexp_extract_all(regexp_extract(c, '(?s)DATABASES\s*=\s*\{.*?\n\}'), '''ENGINE'':\s*''([\w.]+)''', 1), ', ') AS databases,
          array_to_string(regexp_extract_all(regexp_extract(c, '(?s)MIDDLEWARE\s*=\s*\[.*?\]'), '''([\w.]+)''', 1)[1:10], ', ') AS middleware,
          contains(lower(c), 'rest_framework') AS has_drf, contains(lower(c), 'celery') AS has_celery,
          contains(lower(c), 'corsheaders') AS has_cors, contains(lower(c), 'channels') AS has_channels
        FROM safe"""
)
def django_settings(src: Source) -> DataFrame:
    found = web.django_settings(src("settings_files"))
    return found.withColumns({c: _joined(c) for c in ("installed_apps", "databases", "middleware")})


# ── tests ────────────────────────────────────────────────────────────────────

_CHOSEN_CONFIG = """(SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ws ORDER BY list_position(
      ['pytest.ini', 'pyproject.toml', 'setup.cfg', 'tox.ini'], path)) AS rn
    FROM <<pytest_files>> WHERE path <> 'requirements.txt') a WHERE rn = 1) c"""


@query(
    rf"""SELECT ws, path AS config_file, array_to_string(list_filter(string_split_regex(
               regexp_extract(content, 'testpaths\s*=\s*(.+)', 1), '[\s,]+'), lambda p: p <> ''), ', ') AS test_paths
         FROM {_CHOSEN_CONFIG}"""
)
def pytest_config(src: Source) -> DataFrame:
    found = testing.pytest_config(src("pytest_files"))
    return found.select("ws", "config_file", _joined("test_paths"))


@query(
    # the marker section runs to the next line that starts with a word or a bracket
    rf"""WITH lines AS (
           SELECT ws, unnest(string_split(content, chr(10))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) AS no FROM {_CHOSEN_CONFIG}),
         heads AS (SELECT ws, min(no) AS head FROM lines WHERE regexp_matches(line, 'markers\s*=') GROUP BY ws),
         ends AS (
           SELECT h.ws, head, coalesce(min(no), 1000000) AS stop FROM heads h
           LEFT JOIN lines l ON l.ws = h.ws AND l.no > head AND regexp_matches(l.line, '^(?:\[|\w)') GROUP BY h.ws, head)
         SELECT l.ws, CASE WHEN no = head THEN regexp_extract(line, 'markers\s*=\s*([^\[]*)', 1)
                           ELSE regexp_extract(trim(line), '^(\w+)') END AS marker
         FROM lines l JOIN ends e ON l.ws = e.ws
         WHERE no > head AND no < stop AND regexp_matches(trim(line), '^\w+(?:[: ]|$)')"""
)
def pytest_markers(src: Source) -> DataFrame:
    found = testing.pytest_config(src("pytest_files"))
    return found.select("ws", F.explode("markers").alias("marker"))


@query(
    r"""SELECT DISTINCT ws, unnest(regexp_extract_all(content, 'pytest-[\w-]+')) AS plugin FROM <<pytest_files>>
        WHERE path IN ('requirements.txt', 'pyproject.toml')"""
)
def pytest_plugins(src: Source) -> DataFrame:
    return testing.pytest_plugins(src("pytest_files"))


@query(
    rf"""WITH defs AS (
           SELECT path, pos, regexp_extract(m, 'def\s+(\w+)\s*\($', 1) AS name,
                  coalesce(nullif(regexp_extract(regexp_extract(m, '^@pytest\.fixture\(([^)]*)\)', 1),
                           'scope\s*=\s*[''"](\w+)', 1), ''), 'function') AS scope
           FROM ({_matches("<<conftests>>", r"@pytest\.fixture(?:\([^)]*\))?\s*\ndef\s+\w+\s*\(")}) x)
         SELECT name, arg_max(scope, {{'a': path, 'b': pos}}) AS scope FROM defs GROUP BY name"""
)
def pytest_fixtures(src: Source) -> DataFrame:
    return testing.pytest_fixtures(src("conftests"))


@query(
    r"""SELECT regexp_extract(path, '^(.*)/', 1) AS dir,
               CAST(sum(len(regexp_extract_all(content, '(?m)^def test_'))) AS BIGINT) AS n_tests, count(*) AS n_files
        FROM <<test_files>> WHERE path NOT LIKE '%helper%' GROUP BY 1 ORDER BY n_tests DESC, dir LIMIT 10"""
)
def pytest_top_dirs(src: Source) -> DataFrame:
    return testing.top_test_dirs(testing.pytest_structure(src("test_files")))


@query(
    r"""SELECT CAST(sum(len(regexp_extract_all(content, '(?m)^def test_'))) AS BIGINT) AS n_tests, count(*) AS n_files
        FROM <<test_files>> WHERE path NOT LIKE '%helper%'"""
)
def pytest_totals(src: Source) -> DataFrame:
    return testing.structure_totals(testing.pytest_structure(src("test_files")))


# ── models and notebooks ─────────────────────────────────────────────────────


@query(
    r"""SELECT path, array_to_string(cs, ', ') AS classes FROM (
          SELECT path, regexp_extract_all(content, 'class\s+(\w+)\s*\(\s*(?:torch\.)?nn\.Module\s*\)', 1) AS cs
          FROM <<torch_files>> WHERE path LIKE '%.py') x WHERE len(cs) > 0"""
)
def torch_models(src: Source) -> DataFrame:
    return ml.torch_models(src("torch_files")).withColumn("classes", _joined("classes"))


@query("SELECT path FROM <<torch_files>> WHERE path LIKE '%.pt'")
def torch_checkpoints(src: Source) -> DataFrame:
    return ml.checkpoint_files(src("torch_files"))


def _distinct_sql(pattern: str) -> str:
    return f"""(SELECT path, string_agg(d, ', ' ORDER BY k) AS ds FROM (
                  SELECT path, d, min(k) AS k FROM (
                    SELECT path, unnest(regexp_extract_all(content, '{pattern}', 1)) AS d,
                           generate_subscripts(regexp_extract_all(content, '{pattern}', 1), 1) AS k FROM <<torch_files>>) a
                  GROUP BY path, d) b GROUP BY path)"""


@query(
    rf"""SELECT f.path, regexp_matches(content, 'optimizer\s*=|loss\s*=|\.backward\(\)|\.zero_grad\(\)|optimizer\.step\(\)') AS is_training,
                coalesce(o.ds, '') AS optimizers, coalesce(l.ds, '') AS losses
         FROM <<torch_files>> f LEFT JOIN {_distinct_sql(r"optim\.(\w+)\s*\(")} o ON f.path = o.path
         LEFT JOIN {_distinct_sql(r"nn\.(\w+Loss\w*)\s*\(")} l ON f.path = l.path WHERE f.path LIKE '%.py'"""
)
def torch_training(src: Source) -> DataFrame:
    found = ml.torch_training(src("torch_files"))
    return found.withColumns({c: _joined(c) for c in ("optimizers", "losses")})


@query(
    r"""SELECT DISTINCT 'optimizer' AS kind, unnest(regexp_extract_all(content, 'optim\.(\w+)\s*\(', 1)) AS name
        FROM <<torch_files>> WHERE path LIKE '%.py'
        UNION SELECT 'loss', unnest(regexp_extract_all(content, 'nn\.(\w+Loss\w*)\s*\(', 1))
        FROM <<torch_files>> WHERE path LIKE '%.py'"""
)
def torch_names(src: Source) -> DataFrame:
    return ml.torch_names(src("torch_files"))


@query(
    """SELECT bool_or(contains(content, 'DataLoader')) AS has_data_loader,
              bool_or(contains(content, 'autocast') OR contains(content, 'GradScaler')) AS has_amp,
              bool_or(contains(content, 'DataParallel') OR contains(content, 'torch.distributed')) AS has_distributed,
              bool_or(contains(content, 'torch.jit')) AS has_torch_script
       FROM <<torch_files>> WHERE path LIKE '%.py'"""
)
def torch_flags(src: Source) -> DataFrame:
    return ml.torch_flags(src("torch_files"))


@query(
    """SELECT path, n_cells, n_code FROM (
         SELECT 'nb/' || conv_id || '-' || (turn // 16) || '.ipynb' AS path, CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) END AS n_cells,
                CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) FILTER (role = 'assistant') END AS n_code
         FROM conversations GROUP BY conv_id, turn // 16) n"""
)
def largest_notebooks(src: Source) -> DataFrame:
    """All notebooks, the largest first."""
    stats = ml.notebook_stats(notebook_files(src)).select("path", "n_cells", "n_code")
    return stats.orderBy(F.desc("n_cells"), "path")


@query(
    """SELECT DISTINCT 'k' || (conv_id % 4) AS kernel FROM conversations WHERE conv_id % 10 <> 9 AND conv_id % 3 <> 0"""
)
def notebook_kernels(src: Source) -> DataFrame:
    return ml.notebook_kernels(notebook_files(src))


@query(
    """SELECT count(*) AS n_scripts FROM <<scripts>>
       WHERE starts_with(content, '# %%') OR contains(content, chr(10) || '# %%')"""
)
def percent_scripts(src: Source) -> DataFrame:
    return ml.percent_scripts(src("scripts"))


# ── cloud and Spark usage ────────────────────────────────────────────────────

_SRC = r"regexp_matches(path, '\.(?:py|ts|js)$')"


@query(
    " UNION ".join(
        rf"SELECT unnest(regexp_extract_all(content, '{p}', 1)) AS service FROM <<ws_files>> WHERE {_SRC}"
        for p in (r"(?:client|resource)\s*\(\s*[''\"](\w+)[''\"]", r"@aws-sdk/client-(\w[\w-]*)", r"new\s+AWS\.(\w+)")
    )
)
def aws_services(src: Source) -> DataFrame:
    return cloud.aws_services(src("ws_files"))


@query(
    rf"""SELECT * FROM (SELECT path,
           regexp_matches(content, 'def\s+handler\s*\(event') OR regexp_matches(content, 'exports\.handler\s*=')
             OR regexp_matches(content, 'export\s+(?:async\s+)?function\s+handler') OR contains(content, 'module.exports.handler') AS is_handler,
           regexp_matches(content, 'extends\s+(?:cdk\.)?Stack') OR regexp_matches(content, 'class\s+\w+Stack')
             OR regexp_matches(content, 'from\s+aws_cdk\s+import') AS is_stack
         FROM <<ws_files>> WHERE {_SRC}) x WHERE is_handler OR is_stack"""
)
def aws_code_files(src: Source) -> DataFrame:
    return cloud.aws_code_files(src("ws_files"))


def _gcp_sql() -> str:
    tests = {n: f"({_SRC} AND regexp_matches(content, {_quote(p)}))" for n, p in GCP_FLAGS.items()}
    tests["app_engine"] = "path IN ('app.yaml', 'app.yml')"
    tests["cloud_build"] = "path IN ('cloudbuild.yaml', 'cloudbuild.yml')"
    tests["firebase"] = "path IN ('firebase.json', '.firebaserc')"
    tests["firestore"] += " OR path = 'firestore.rules'"
    tests["cloud_functions"] += " OR path LIKE 'cloud-functions/%'"
    tests["terraform"] = "path LIKE 'terraform/%.tf' AND regexp_matches(content, 'provider\\s+[\"'']google[\"'']')"
    cols = ", ".join(f"bool_or({t}) AS {n}" for n, t in tests.items())
    return f"SELECT ws, {cols} FROM <<ws_files>> GROUP BY ws"


@query(_gcp_sql())
def gcp_services(src: Source) -> DataFrame:
    return cloud.gcp_services(src("ws_files"))


@query(
    rf"""SELECT replace(unnest(regexp_extract_all(content, 'from google\.cloud(?:\.\w+)*')), 'from ', '') AS "import"
         FROM <<ws_files>> WHERE {_SRC}
         UNION SELECT unnest(regexp_extract_all(content, '@google-cloud/[\w-]+')) FROM <<ws_files>> WHERE {_SRC}"""
)
def gcp_imports(src: Source) -> DataFrame:
    return cloud.gcp_imports(src("ws_files"))


@query(
    rf"""SELECT path FROM <<ws_files>> WHERE {_SRC} AND (contains(lower(content), 'functions_framework')
           OR regexp_matches(content, '(?i)exports\.\w+\s*=') OR contains(lower(content), 'firebase-functions')
           OR contains(lower(content), 'onrequest') OR contains(lower(content), 'oncall'))"""
)
def gcp_function_files(src: Source) -> DataFrame:
    return cloud.gcp_function_files(src("ws_files"))


@query(
    " UNION ".join(
        rf"""SELECT ws, {_quote(n)} AS service FROM <<ws_files>>
             WHERE regexp_matches(path, '\.(?:py|cs|ts|js)$') AND regexp_matches(content, {_quote(p)})"""
        for n, p in AZURE_SERVICES.items()
    )
)
def azure_services(src: Source) -> DataFrame:
    return cloud.azure_services(src("ws_files"))


@query(
    " UNION ".join(
        [
            f"""SELECT ws, {_quote(n)} AS "trigger" FROM <<ws_files>>
                WHERE path LIKE '%function.json' AND regexp_matches(content, {_quote(p)})"""
            for n, p in AZURE_BINDING_TRIGGERS.items()
        ]
        + [
            rf"""SELECT ws, {_quote(n)} AS "trigger" FROM <<ws_files>>
                WHERE regexp_matches(path, '\.(?:py|cs)$') AND regexp_matches(content, {_quote(p)})"""
            for n, p in AZURE_CODE_TRIGGERS.items()
        ]
    )
)
def azure_triggers(src: Source) -> DataFrame:
    return cloud.azure_triggers(src("ws_files"))


@query(
    rf"""SELECT ws, CASE WHEN bool_or(path IN ('bundle.yml', 'bundle.yaml')) THEN 'Databricks Asset Bundle'
                WHEN bool_or(path IN ('databricks.yml', 'databricks.yaml')) THEN 'Databricks Workflow'
                WHEN bool_or(path LIKE '.databricks/%') THEN 'Databricks Connect'
                WHEN bool_or(path = '.databrickscfg') THEN 'Databricks CLI' ELSE 'PySpark' END AS kind,
           {", ".join(f"bool_or(path LIKE '%.py' AND regexp_matches(content, {_quote(p)})) AS {n}" for n, p in SPARK_FLAGS.items())},
           count(*) FILTER (path LIKE '%.py' OR path LIKE '%.ipynb') AS n_notebook_files,
           count(*) FILTER (regexp_matches(path, '(?:job|workflow)[^/]*\.ya?ml$')) AS n_job_files,
           count(*) FILTER (regexp_matches(path, 'pipeline[^/]*\.ya?ml$|(?:dlt|delta_live)[^/]*\.py$')) AS n_pipeline_files
         FROM <<ws_files>> GROUP BY ws"""
)
def spark_features(src: Source) -> DataFrame:
    return cloud.spark_features(src("ws_files"))


def _stack_sql() -> str:
    parts = ["SELECT DISTINCT ws, 'security' AS stack FROM <<ws_files>>"]
    for rule in stacks.STACK_RULES:
        if not rule.path:
            continue
        where = f"regexp_matches(path, {_quote(rule.path)})"
        if rule.content and "(?=" in rule.content:  # look-ahead, stated as two patterns
            where += r" AND regexp_matches(content, 'apiVersion:\s*\S+') AND regexp_matches(content, 'kind:\s*\S+')"
        elif rule.content:
            where += f" AND regexp_matches(content, {_quote(rule.content)})"
        parts.append(f"SELECT ws, '{rule.stack}' FROM <<ws_files>> WHERE {where}")
    return " UNION ".join(parts)


@query(_stack_sql())
def detected_stacks(src: Source) -> DataFrame:
    return stacks.detect_stacks(src("ws_files"))


# ── version control and JSON documents ───────────────────────────────────────


@query(
    """SELECT repo, count(*) FILTER (line LIKE '??%') AS n_untracked,
              count(*) FILTER (substr(line, 1, 1) NOT IN (' ', '?')) AS n_staged,
              count(*) FILTER (substr(line, 2, 1) NOT IN (' ', '?')) AS n_modified
       FROM <<statuses>> WHERE length(line) >= 2 GROUP BY repo"""
)
def git_status_counts(src: Source) -> DataFrame:
    return repo.git_status_counts(src("statuses"), ["repo"])


@query(
    r"""SELECT id, substr(content, 1, 40) AS "commit",
               CASE WHEN contains(content, chr(10) || 'author ') THEN trim(regexp_extract(content, '(?m)^author (.*)$', 1)) ELSE 'unknown' END AS author,
               CASE WHEN contains(content, chr(10) || 'summary ') THEN trim(regexp_extract(content, '(?m)^summary (.*)$', 1)) ELSE 'unknown' END AS summary
        FROM <<blames>>"""
)
def blame_fields(src: Source) -> DataFrame:
    return repo.blame_fields(src("blames"))


@query("SELECT * FROM (SELECT pos, line FROM <<commit_log>> ORDER BY pos DESC LIMIT 5) l WHERE trim(line) <> ''")
def recent_commits(src: Source) -> DataFrame:
    newest = src("commit_log").withColumn("age", -F.col("pos"))
    return repo.recent_commits(newest, 5, "line", "age").select("pos", "line")


@query(
    """SELECT doc_id, string_agg(k || ' (' || CASE json_type(doc, '$.' || k)
                WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
                WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'map' WHEN 'ARRAY' THEN 'array'
                ELSE 'unknown' END || ')', ', ' ORDER BY i) FILTER (i <= 10) AS fields,
              greatest(max(i) - 10, 0) AS n_more
       FROM (SELECT doc_id, doc, unnest(json_keys(doc)) AS k, generate_subscripts(json_keys(doc), 1) AS i FROM <<json_docs>>) x
       GROUP BY doc_id"""
)
def json_field_types(src: Source) -> DataFrame:
    return documents.field_types(src("json_docs"))


@query(
    """SELECT name, len(json_keys(definition, '$.States')) AS n_states,
              array_to_string(json_keys(definition, '$.States'), ', ') AS states
       FROM (SELECT * FROM <<machines>> ORDER BY name LIMIT 3) m WHERE json_valid(definition)"""
)
def first_state_machines(src: Source) -> DataFrame:
    return documents.state_machine_stats(src("machines"), first=3)


@query(
    """WITH ok AS MATERIALIZED (SELECT name, definition FROM <<machines>> WHERE definition LIKE '{%')
       SELECT name, len(json_keys(definition, '$.States')) AS n_states,
              array_to_string(json_keys(definition, '$.States'), ', ') AS states FROM ok"""
)
def all_state_machines(src: Source) -> DataFrame:
    return documents.state_machine_stats(src("machines"), first=None)
