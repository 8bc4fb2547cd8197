"""Cloud and Spark usage in source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import all_groups
from winnow.operators.packs import matching

# Patterns and names.
SOURCE_PATH = r"\.(?:py|ts|js)$"
BOTO_CALL = r"""(?:client|resource)\s*\(\s*['"](\w+)['"]"""
SDK_IMPORT = r"@aws-sdk/client-(\w[\w-]*)"
SDK_NEW = r"new\s+AWS\.(\w+)"
LAMBDA_HANDLER = (
    r"def\s+handler\s*\(event|exports\.handler\s*="
    r"|export\s+(?:async\s+)?function\s+handler|module\.exports\.handler"
)
CDK_STACK = r"extends\s+(?:cdk\.)?Stack|class\s+\w+Stack|from\s+aws_cdk\s+import"

GCP_FLAGS = {
    "firestore": r"(?i)firestore|Firestore",
    "cloud_functions": r"(?i)functions_framework|firebase-functions|@google-cloud\/functions",
    "cloud_run": r"(?i)cloud.run|cloud_run|CloudRun|gcr\.io|run\.googleapis",
    "bigquery": r"(?i)bigquery|BigQuery|google\.cloud\.bigquery|@google-cloud\/bigquery",
    "pubsub": r"(?i)pubsub|PubSub|google\.cloud\.pubsub|@google-cloud\/pubsub",
    "cloud_storage": r"(?i)google\.cloud\.storage|@google-cloud\/storage|storage\.googleapis",
    "cloud_logging": r"(?i)google\.cloud\.logging|@google-cloud\/logging|cloud-logging",
}
GCP_MARKERS = {
    "app_engine": r"^app\.ya?ml$",
    "cloud_build": r"^cloudbuild\.ya?ml$",
    "firebase": r"^(?:firebase\.json|\.firebaserc)$",
    "firestore": r"^firestore\.rules$",
    "cloud_functions": r"^cloud-functions/",
}
GCP_TERRAFORM = (r"^terraform/[^/]+\.tf$", r"""provider\s+["']google["']""")
GCP_PY_IMPORT = r"from google\.cloud(?:\.\w+)*"
GCP_JS_IMPORT = r"@google-cloud\/[\w-]+"
GCP_FUNCTION = r"(?i)functions_framework|exports\.\w+\s*=|firebase-functions|onRequest|onCall"

AZURE_SOURCE = r"\.(?:py|cs|ts|js)$"
AZURE_SERVICES = {
    "Functions": r"(?i)azure[._-]functions|host\.json|FunctionName|@app\.(route|function_name)",
    "Blob Storage": r"(?i)azure[._-]storage|BlobServiceClient|BlobClient|CloudBlobContainer",
    "Queue Storage": r"(?i)QueueServiceClient|QueueClient|CloudQueueMessage",
    "Table Storage": r"(?i)TableServiceClient|TableClient|CloudTable",
    "Cosmos DB": r"(?i)azure[._-]cosmos|CosmosClient|DocumentClient|cosmos_client",
    "Identity": r"(?i)azure[._-]identity|DefaultAzureCredential|ManagedIdentityCredential",
    "Key Vault": r"(?i)azure[._-]keyvault|SecretClient|KeyClient|CertificateClient",
    "Service Bus": r"(?i)azure[._-]servicebus|ServiceBusClient|ServiceBusSender",
    "Event Hubs": r"(?i)azure[._-]eventhub|EventHubProducerClient|EventHubConsumerClient",
    "Monitor": r"(?i)azure[._-]monitor|MonitorClient|LogsQueryClient|MetricsQueryClient",
    "Management SDK": r"(?i)azure[._-]mgmt|ResourceManagementClient|SubscriptionClient",
    "SignalR": r"(?i)SignalR|azure[._-]signalr",
    "Cognitive Search": r"(?i)azure[._-]search|SearchClient|SearchIndexClient",
    "AI Services": r"(?i)azure[._-]ai|OpenAIClient|azure\.ai",
}
AZURE_BINDING_TRIGGERS = {
    "HTTP": r"(?i)httpTrigger",
    "Timer": r"(?i)timerTrigger",
    "Queue": r"(?i)queueTrigger",
    "Blob": r"(?i)blobTrigger",
    "Cosmos DB": r"(?i)cosmosDBTrigger",
    "Service Bus": r"(?i)serviceBusTrigger",
    "Event Hub": r"(?i)eventHubTrigger",
    "Event Grid": r"(?i)eventGridTrigger",
    "Durable": r"(?i)orchestrationTrigger|activityTrigger|entityTrigger",
}
AZURE_CODE_TRIGGERS = {
    "HTTP": r"(?i)HttpTrigger|@app\.route|@app\.function_name.*http",
    "Timer": r"(?i)TimerTrigger|@app\.timer_trigger|@app\.schedule",
    "Queue": r"(?i)QueueTrigger|@app\.queue_trigger",
    "Blob": r"(?i)BlobTrigger|@app\.blob_trigger",
    "Cosmos DB": r"(?i)CosmosDBTrigger|@app\.cosmos_db_trigger",
    "Service Bus": r"(?i)ServiceBusTrigger|@app\.service_bus_queue_trigger",
    "Event Hub": r"(?i)EventHubTrigger|@app\.event_hub_message_trigger",
    "Durable": r"(?i)OrchestrationTrigger|ActivityTrigger|@app\.orchestration_trigger|@app\.activity_trigger",
}

SPARK_KINDS = [
    (["bundle.yml", "bundle.yaml"], "Databricks Asset Bundle"),
    (["databricks.yml", "databricks.yaml"], "Databricks Workflow"),
    ([".databricks"], "Databricks Connect"),
    ([".databrickscfg"], "Databricks CLI"),
]
SPARK_DEFAULT_KIND = "PySpark"
SPARK_FLAGS = {
    "has_mlflow": r"(?i)mlflow",
    "has_unity": r"(?i)unity.catalog|three.part.name|catalog\.\w+\.\w+",
    "has_delta": r"(?i)delta|DeltaTable|MERGE INTO",
    "has_dlt": r"(?i)@dlt\.|dlt\.table|dlt\.view|DeltaLiveTable",
    "has_autoloader": r"(?i)cloudFiles|readStream",
}
SPARK_FILE_KINDS = {
    "notebook": r"\.(?:py|ipynb)$",
    "job": r"(?:job|workflow)[^/]*\.ya?ml$",
    "pipeline": r"pipeline[^/]*\.ya?ml$|dlt[^/]*\.py$|delta_live[^/]*\.py$",
}


def _kinds(rules: dict[str, str], column: str) -> Column:
    tests = [F.when(F.rlike(column, F.lit(p)), F.lit(n)) for n, p in rules.items()]
    return F.array_compact(F.array(*tests))


def aws_services(files: DataFrame) -> DataFrame:
    """Distinct service names from three import styles."""
    names = F.flatten(F.array(*[all_groups("content", p) for p in (BOTO_CALL, SDK_IMPORT, SDK_NEW)]))
    return matching(files, SOURCE_PATH).select(F.explode(names).alias("service")).distinct()


def aws_code_files(files: DataFrame) -> DataFrame:
    """Source files that hold a function handler or a stack class."""
    return (
        matching(files, SOURCE_PATH)
        .select(
            "path",
            F.rlike("content", F.lit(LAMBDA_HANDLER)).alias("is_handler"),
            F.rlike("content", F.lit(CDK_STACK)).alias("is_stack"),
        )
        .filter("is_handler or is_stack")
    )


def gcp_services(files: DataFrame) -> DataFrame:
    """Per workspace, one flag per service from marker files and source text. ``files``: ws, path, content."""
    in_source = F.rlike("path", F.lit(SOURCE_PATH))
    tests: dict[str, Column] = {}
    for name, pattern in GCP_FLAGS.items():
        tests[name] = in_source & F.rlike("content", F.lit(pattern))
    for name, pattern in GCP_MARKERS.items():
        by_path = F.rlike("path", F.lit(pattern))
        tests[name] = tests[name] | by_path if name in tests else by_path
    tests["terraform"] = F.rlike("path", F.lit(GCP_TERRAFORM[0])) & F.rlike(
        "content", F.lit(GCP_TERRAFORM[1])
    )
    return files.groupBy("ws").agg(*[F.bool_or(t).alias(n) for n, t in tests.items()])


def gcp_imports(files: DataFrame) -> DataFrame:
    """Distinct cloud imports of source files."""
    py = F.transform(all_groups("content", GCP_PY_IMPORT, 0), lambda m: F.replace(m, F.lit("from "), F.lit("")))
    js = all_groups("content", GCP_JS_IMPORT, 0)
    return matching(files, SOURCE_PATH).select(F.explode(F.concat(py, js)).alias("import")).distinct()


def gcp_function_files(files: DataFrame) -> DataFrame:
    return matching(files, SOURCE_PATH).filter(F.rlike("content", F.lit(GCP_FUNCTION))).select("path")


def azure_services(files: DataFrame) -> DataFrame:
    """Distinct services used by the source files of each workspace."""
    found = matching(files, AZURE_SOURCE).select(
        "ws", F.explode(_kinds(AZURE_SERVICES, "content")).alias("service")
    )
    return found.distinct()


def azure_triggers(files: DataFrame) -> DataFrame:
    """Distinct trigger kinds per workspace, from binding files and from source text."""
    kinds = F.when(
        F.rlike("path", F.lit(r"function\.json$")), _kinds(AZURE_BINDING_TRIGGERS, "content")
    ).when(F.rlike("path", F.lit(r"\.(?:py|cs)$")), _kinds(AZURE_CODE_TRIGGERS, "content"))
    return files.select("ws", F.explode(kinds).alias("trigger")).distinct()


def spark_features(files: DataFrame) -> DataFrame:
    """Per workspace: kind by marker order and five feature flags over its Python files."""
    top = F.split("path", "/")[0]
    rank = F.lit(None).cast("int")
    for i, (names, _) in reversed(list(enumerate(SPARK_KINDS))):
        rank = F.when(top.isin(*names), F.lit(i)).otherwise(rank)
    is_py = F.rlike("path", F.lit(r"\.py$"))
    flags = [F.bool_or(is_py & F.rlike("content", F.lit(p))).alias(n) for n, p in SPARK_FLAGS.items()]
    counts = [
        F.count_if(F.rlike("path", F.lit(p))).alias(f"n_{n}_files") for n, p in SPARK_FILE_KINDS.items()
    ]
    found = files.groupBy("ws").agg(F.min(rank).alias("_rank"), *flags, *counts)
    labels = F.array(*[F.lit(label) for _, label in SPARK_KINDS])
    kind = F.coalesce(F.get(labels, F.col("_rank")), F.lit(SPARK_DEFAULT_KIND))
    return found.withColumn("kind", kind).drop("_rank")


