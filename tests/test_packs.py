import pytest

from winnow.operators.packs import cloud, containers, data, documents, infra, ml, repo, stacks, testing, web


@pytest.fixture
def files(spark):
    def make(*rows, ws=False):
        schema = "ws string, path string, content string" if ws else "path string, content string"
        return spark.createDataFrame(list(rows), schema)

    return make


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_k8s(files):
    text = (
        "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: my-app\n---\nkind: Service\n"
        "metadata:\n  namespace: prod\n--- \nnote: x\n"
    )
    df = files(("a.yaml", text), ("b.yml", "kind: Pod"), ("c.txt", text))
    assert rows(containers.k8s_manifests(df)) == [
        ("a.yaml", 0, "Deployment", "my-app", "default"), ("a.yaml", 1, "Service", "(unnamed)", "prod"),
    ]
    assert rows(containers.k8s_namespaces(df)) == [("prod",)]


def test_helm(files):
    keys = "".join(f"key{i}: 1\n" for i in range(25))
    df = files(("c/Chart.yaml", "name: x \nversion: 1.0"), ("c/values.yaml", keys + "  nested: 2"), ("d/Chart.yaml", "name: y"))
    got = {r.dir: r for r in containers.helm_chart(df, 20).collect()}
    assert (got["c"].name, got["c"].version, got["c"].description) == ("x", "1.0", "")
    assert got["c"].value_keys == [f"key{i}" for i in range(20)] and got["d"].value_keys == []


def test_dockerfile(files):
    df = files(("Dockerfile", "FROM node:20-alpine\nWORKDIR /app\nfrom nginx as Web\n"), ("x/Dockerfile.dev", "FROM a"), ("b.dockerfile", "FROM b"), ("nope", "FROM c"))
    got = {(r.path, r.base, r.name) for r in containers.dockerfile_stages(df).collect()}
    assert got == {
        ("Dockerfile", "node:20-alpine", "stage0"), ("Dockerfile", "nginx", "Web"),
        ("x/Dockerfile.dev", "a", "stage0"), ("b.dockerfile", "b", "stage0"),
    }


def test_compose(files):
    text = "services:\n  web:\n    image: nginx:alpine\n    ports:\n      - \"80:80\"\n  db:\n    healthcheck: x\n  volumes:\n"
    got = {r.name: (r.image, r.ports, r.has_healthcheck) for r in containers.compose_services(files(("c.yml", text))).collect()}
    assert got == {"web": ("nginx:alpine", [], False), "db": ("", [], True)}
    far = "  a:\n" + "    x: y\n" * 20_000 + "    image: late\nvolumes:\n  image: other\n"
    assert containers.compose_services(files(("c.yml", far))).first().image == "late"
    ws = files(("w", "compose.yaml", "  later:\n"), ("w", "docker-compose.yaml", "  first:\n"), ("v", "compose.yml", ""), ws=True)
    assert rows(containers.compose_service_names(ws)) == [("w", "docker-compose.yaml", 0, "first")]


def test_terraform(files):
    df = files(
        ("a.tf", 'provider "aws" {}\nprovider "google" {}\nprovider "aws" {}\nresource "t" "n" {}\n'
                 'variable "v" {\n  type = string\n  default = "x y"\n}\nvariable "w" { }'),
    )
    assert {r.provider for r in infra.tf_providers(df).collect()} == {"aws", "google"}
    assert rows(infra.tf_resources(df)) == [("a.tf", 0, "t", "n")]
    assert rows(infra.tf_variables(df)) == [("a.tf", 0, "v", "string", "x y"), ("a.tf", 1, "w", None, None)]


def test_dbt(files):
    project = "name: 'shop'\nmodel-paths: [\"m\", 'n']\nmodels:\n  +materialized: table\n  +materialized: table\n"
    df = files(("p/dbt_project.yml", project), ("q/dbt_project.yml", ""))
    got = {r.path: r for r in data.dbt_project(df).collect()}
    a, b = got["p/dbt_project.yml"], got["q/dbt_project.yml"]
    assert (a.name, a.version, a.model_paths, a.seed_paths, a.materializations) == ("shop", "1.0.0", ["m", "n"], ["seeds"], ["table"])
    assert (b.name, b.profile, b.materializations) == ("unknown", "default", [])
    models = files(("models/a.sql", "{{ config(materialized='table') }} select 1"), ("models/b.sql", "x"), ("other/c.sql", "x"))
    assert rows(data.dbt_models(models)) == [("models/a.sql", "table"), ("models/b.sql", "view")]
    source = "sources:\n  - name: raw\n    schema: s\n    tables:\n      - name: t1\n      - name: t2\n"
    got = [(r.name, r.schema, r.tables) for r in data.dbt_sources(files(("x/schema.yml", source))).collect()]
    assert got == [("raw", "s", "raw, t1, t2"), ("t1", "t1", "raw, t1, t2"), ("t2", "t2", "raw, t1, t2")]


def test_airflow(files):
    dags = files(("dags/a.py", "DAG(dag_id='x', schedule='@daily')"), ("dags/b.py", "schedule_interval=None"), ("dags/c.py", "schedule = timedelta(days=1)"), ("d.py", "dag_id='n'"))
    assert rows(data.airflow_dags(dags)) == [
        ("dags/a.py", "x", "@daily"), ("dags/b.py", "b", "None"), ("dags/c.py", "c", "timedelta(days=1)"),
    ]
    cfg = files(("airflow.cfg", "executor = Local\nsql_alchemy_conn = pg://u:p@h:5/x\n"))
    assert rows(data.airflow_config(cfg)) == [("airflow.cfg", "Local", "pg://u:***@h:5/x", None, None)]
    plugins = files(("plugins/p.py", "class AOperator(B): x\nclass BHook (C): y"), ("q.py", "class AOperator(B): x"))
    assert {r.kind for r in data.airflow_components(plugins).collect()} == {"operator", "hook"}


def test_web(files):
    api = (
        "@app.get('/a')\nasync def one(db=Depends(get_db)):\n    pass\n@router.post(\"/b\")\n\n\n\ndef far():\n    yield 1\n"
        "class M(BaseModel):\n    x: int\n    y: str\n\nclass M(BaseModel):\n    z: int\nclass P:\n    q: int\n"
    )
    df = files(("api.py", api), ("n.py", "nothing"))
    assert [(r.method, r.route, r.function) for r in web.fastapi_routes(df).collect()] == [("GET", "/a", "one"), ("POST", "/b", "(unknown)")]
    assert web.fastapi_route_count(df).first().n_routes == 2
    assert rows(web.pydantic_models(df)) == [("M", "api.py", 2)]
    # the lazy pattern starts at the first function and runs to the yield of a later one
    assert rows(web.fastapi_dependencies(df)) == [("api.py", ["get_db"], 1)]


def test_django(files):
    df = files(
        ("shop/models.py", "class Item(models.Model):\n  pass\nclass Sub( a.BaseModel ): pass\nclass No: pass"), ("shop/urls.py", ""),
        ("blog/views.py", ""), ("misc/urls.py", ""), ("venv/models.py", "class X(models.Model): pass"), ("models.py", ""),
        ("s/settings.py", "SECRET_KEY = 'rest_framework'\nINSTALLED_APPS = [\n 'a.b',\n 'c',\n]\nDATABASES = {\n 'default': {'ENGINE': 'x.pg'}\n}\nX='celery'"),
    )
    got = {r.app: (r.has_models, r.has_views, r.has_urls) for r in web.django_apps(df).collect()}
    assert got == {"shop": (True, False, True), "blog": (False, True, False)}
    assert rows(web.django_models(df)) == [("shop", ["Item", "Sub"])]
    s = web.django_settings(df).first()
    assert (s.installed_apps, s.databases, s.middleware, s.has_drf, s.has_celery) == (["a.b", "c"], ["x.pg"], [], False, True)


def test_pytest(files):
    df = files(
        ("w", "tox.ini", "[pytest]"), ("w", "pytest.ini", "[pytest]\naddopts = -v\ntestpaths = t, u\nmarkers =\n    slow: takes long\n    fast\n    a-b: x\n\n[other]"),
        ("w", "requirements.txt", "pytest-cov\npytest-xdist==1\npytest-cov"), ws=True,
    )
    c = testing.pytest_config(df).first()
    assert (c.config_file, c.markers, c.test_paths) == ("pytest.ini", ["slow", "fast"], ["t", "u"])
    assert {r.plugin for r in testing.pytest_plugins(df).collect()} == {"pytest-cov", "pytest-xdist"}
    fixtures = files(("a/conftest.py", "@pytest.fixture(scope='session')\ndef db():\n"), ("b/conftest.py", "@pytest.fixture\ndef db():\n@pytest.fixture(scope=\"module\")\ndef app ():\n"))
    assert set(rows(testing.pytest_fixtures(fixtures))) == {("db", "function"), ("app", "module")}
    tests = testing.pytest_structure(files(("t/test_a.py", "def test_x(): 1\n  def test_in(): 2"), ("t/b_test.py", "def test_y(): 1"), ("t/helper.py", "def test_z(): 1"), ("test_c.py", "")))
    assert set(rows(tests)) == {("t", 2, 2), ("", 0, 1)}


def test_torch(files):
    df = files(("n.py", "class A(nn.Module): pass\nclass B( torch.nn.Module ): pass\nopt = optim.Adam(p)\no2 = torch.optim.Adam(q)\nl = nn.MSELoss()"), ("m.pth", ""))
    assert rows(ml.torch_models(df)) == [("n.py", ["A", "B"])]
    assert rows(ml.checkpoint_files(df)) == [("m.pth",)]
    assert rows(ml.torch_training(df)) == [("n.py", False, ["Adam"], ["MSELoss"])]
    assert ml.torch_flags(df).first().has_amp is False
    assert ml.torch_flags(df.limit(0)).first().has_amp is False


def test_cloud(files):
    df = files(
        ("w", "a.py", "boto3.client('s3')\nclass XStack: pass\nfrom google.cloud.storage import x\nfrom azure.identity import DefaultAzureCredential\n@app.timer_trigger"),
        ("w", "bundle.yml", ""), ("w", "databricks.yml", ""), ("w", "t/function.json", "httpTrigger"), ("w", "terraform/m.tf", "provider \"google\" {}"), ws=True,
    )
    assert rows(cloud.aws_services(df)) == [("s3",)]
    assert rows(cloud.aws_code_files(df)) == [("a.py", False, True)]
    g = cloud.gcp_services(df).first()
    assert g.cloud_storage and g.terraform and not g.pubsub
    assert rows(cloud.gcp_imports(df)) == [("google.cloud.storage",)]
    assert {r.service for r in cloud.azure_services(df).collect()} == {"Identity"}
    assert {r.trigger for r in cloud.azure_triggers(df).collect()} == {"Timer", "HTTP"}
    assert cloud.spark_features(df).first().kind == "Databricks Asset Bundle"


@pytest.mark.parametrize(
    "path, content, stack",
    [
        ("requirements.txt", "fastapi==0.110.0\nuvicorn[standard]\n", "fastapi"), ("requirements.txt", "Django==4.2\n", "django"),
        ("pytest.ini", "", "pytest"), ("setup.cfg", "[tool:pytest]", "pytest"), ("svc/Dockerfile", "", "docker"), ("a/b/c.tf", "", "terraform"),
        ("deploy/x.yml", "kind: A\napiVersion: v1", "kubernetes"), ("dags/x.py", "", "airflow"), ("models/a.sql", "", "dbt"),
        ("x/y.ipynb", "", "jupyter"), (".git/HEAD", "", "git"), ("package.json", '{"@azure/x": 1}', "azure"), (".env", "A=1\nAZURE_X=2", "azure"),
        ("app.yaml", "", "gcp"), ("cdk.json", "", "aws"), ("src/a.py", "import torch", "pytorch"), ("setup.py", "pyspark", "spark"),
    ],
)
def test_stack(files, path, content, stack):
    found = {r.stack for r in stacks.detect_stacks(files(("w", path, content), ws=True)).collect()}
    assert stack in found and "security" in found


def test_stack_needs_its_file(files):
    df = files(("w", "docs/requirements.txt", "fastapi"), ("w", "a/b/Dockerfile", ""), ("w", "models/x/a.sql", ""), ws=True)
    assert {r.stack for r in stacks.detect_stacks(df).collect()} == {"security"}


def test_repo(spark, files):
    lines = spark.createDataFrame([("?? a",), ("M  b",), (" M c",), ("MM d",), ("A",), ("",)], "line string")
    assert tuple(repo.git_status_counts(lines).first()) == (1, 2, 2)
    text = "a" * 40 + " 1 1 1\nauthor Jo Doe \nauthor-mail <x>\nsummary did it\n\tcode"
    got = rows(repo.blame_fields(files(("x", text), ("y", "b" * 40))))
    assert got == [("x", "a" * 40, "Jo Doe", "did it"), ("y", "b" * 40, "unknown", "unknown")]
    log = spark.createDataFrame([(i, "" if i == 1 else f"c{i}") for i in range(9)], "pos int, line string")
    assert [r.line for r in repo.recent_commits(log).collect()] == ["c0", "c2", "c3", "c4"]


def test_documents(spark):
    doc = '{"s": "x", "i": -3, "b": true, "m": {"a": 1}, "l": [1], "n": null, "f": 1.5, "k8": 1, "k9": 1, "k10": 1, "k11": 1, "k12": 2}'
    df = spark.createDataFrame([(1, doc), (2, "not json"), (3, "{}")], "doc_id int, doc string")
    got = {r.doc_id: (r.fields, r.n_more) for r in documents.field_types(df).collect()}
    assert got[1][0].startswith("s (string), i (integer), b (boolean), m (map), l (array), n (unknown), f (unknown)") and got[1][1] == 2
    assert got[3] == ("", 0)
    machines = spark.createDataFrame([("a", '{"States": {"x": {}, "y": {}}}'), ("b", "oops"), ("c", "{}"), ("d", '{"States": {"z": 1}}')], "name string, definition string")
    assert rows(documents.state_machine_stats(machines, first=3)) == [("a", 2, "x, y"), ("c", 0, "")]
    assert documents.state_machine_stats(machines, first=None).count() == 3


