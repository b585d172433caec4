"""Schemas of the catalog tables, their enumerations and seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Members of the enumerations.
FILE_COLLECT_TYPES = ["Download", "FOI", "Email", "Scrape", "Collect", "REST"]
LOADER_TYPES = ["Excel", "Flat", "DBF", "MDB"]
WORKFLOWS = ["collection", "load", "check", "qa"]

# File extension -> loader.
LOADER_BY_EXTENSION = {
    "xlsx": "Excel",
    "xls": "Excel",
    "csv": "Flat",
    "tsv": "Flat",
    "txt": "Flat",
    "mdb": "MDB",
    "accdb": "MDB",
    "dbf": "DBF",
}

# Collect types that a program can fetch without a person.
FETCHABLE_COLLECT_TYPES = ["Download", "REST"]

# Loaders whose files hold several sub tables.
SUB_TABLE_LOADERS = ["Excel", "MDB"]

# Ids of the task definitions that other tasks refer to.
TASK_SCAN_FOLDER = 3
TASK_DOWNLOAD_MISSING = 4
TASK_COLLECT_MISSING = 5

# Task definitions (name, workflow, who runs it), in id order from 1.
TASK_DEFINITIONS = [
    ("Confirm Run Instance", "collection", "User"),
    ("Build Pipeline Run", "collection", "System"),
    ("Scan Source Folder", "collection", "System"),
    ("Download Missing Files", "collection", "System"),
    ("Collect Missing Files", "collection", "User"),
    ("Confirm Record Date", "collection", "User"),
    ("Backup Files to Zip Folder", "collection", "System"),
    ("Validate Source Tables", "collection", "System"),
    ("Fix Source Table Options", "collection", "User"),
    ("First Pipeline Detected", "collection", "User"),
    ("Validate First Pipeline", "collection", "System"),
    ("Analyze Files", "load", "System"),
    ("Load Files", "load", "System"),
]

# Columns of the catalog tables.
CATALOG = {
    "source_tables": """
        st_oid bigint not null, run_id bigint not null, table_name string not null,
        file_name string not null, analyze_table boolean not null, load boolean not null,
        qualified boolean not null, encoding string not null, sub_table string,
        record_count int not null, file_id string, url string, comments string,
        collect_type string not null, loader_type string not null, delimiter string""",
    "source_table_columns": """
        stc_oid bigint, st_oid bigint not null, name string not null, type string not null,
        max_length int, min_length int, label string, column_index int not null""",
    "pipeline_runs": """
        run_id bigint not null, ds_id bigint not null, record_date date not null,
        collection_user_oid bigint, load_user_oid bigint, check_user_oid bigint,
        qa_user_oid bigint, workflow_operation string not null,
        operation_state string not null, production_count int not null,
        staging_count int not null, match_count int not null, new_count int not null,
        plotting_stats string not null, has_child_tables boolean not null,
        merge_type string""",
    "pipeline_run_tasks": """
        pr_task_id bigint not null, run_id bigint not null, task_start timestamp_ntz,
        task_completed timestamp_ntz, task_id bigint not null, task_message string,
        task_status string not null, parent_task_id bigint not null,
        parent_task_order int not null, workflow_operation string not null,
        task_stack_trace string""",
    "tasks": """
        task_id bigint not null, name string not null, description string not null,
        state string not null, task_run_type string not null""",
    "pipelines": "pipeline_id bigint not null, name string not null, workflow_operation string not null",
    "pipeline_tasks": """
        pipeline_task_id bigint not null, pipeline_id bigint not null, task_id bigint not null,
        parent_task bigint not null, parent_task_order int not null""",
    "data_sources": """
        ds_id bigint not null, code string not null, prov string not null,
        description string not null, files_location string not null,
        prov_level boolean not null, comments string, assigned_user bigint not null,
        created_by bigint not null, last_updated timestamp_ntz, updated_by bigint,
        search_radius double not null, record_warehouse_type int not null,
        reporting_type string not null, created timestamp_ntz not null,
        collection_pipeline bigint not null, load_pipeline bigint, check_pipeline bigint,
        qa_pipeline bigint""",
    "internal_users": """
        user_oid bigint not null, name string not null, username string not null,
        roles array<string> not null""",
    "actions": """
        action_id bigint not null, state string not null, role string not null,
        name string not null, description string not null, href string not null""",
    "file_types": "file_extension string not null, loader_type string not null",
    "job_documents": """
        id string, status string, run_at timestamp, retries int, kjob_id string,
        created_at timestamp, updated_at timestamp,
        settings struct<id: string, name: string, properties:
            struct<pipelineRunTaskId: bigint, runId: bigint, runNext: boolean>>,
        progress struct<step: bigint, max: bigint, started_at: timestamp, completed_at: timestamp>""",
}


def catalog_schema(table: str) -> T.StructType:
    """Declared schema of a catalog table."""
    return T.StructType.fromDDL(" ".join(CATALOG[table].split()))


def file_types(spark: SparkSession) -> DataFrame:
    """Lookup rows extension -> loader."""
    return spark.createDataFrame(list(LOADER_BY_EXTENSION.items()), catalog_schema("file_types"))


def task_definitions(spark: SparkSession) -> DataFrame:
    """Task definitions with ids in list order."""
    rows = [(i, name, name, state, kind) for i, (name, state, kind) in enumerate(TASK_DEFINITIONS, 1)]
    return spark.createDataFrame(rows, catalog_schema("tasks"))
