"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app_name: str = "portfolia", cores: str | None = None) -> SparkSession:
    """Session for tests, the benchmark and interactive use.

    On a cluster the submitter's settings win: only the master and the local
    sizes are set here, and only for local runs.
    """
    n = cores or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.appName(app_name)
        .master(os.environ.get("PORTFOLIA_MASTER", f"local[{n}]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, under the cluster's shared checkpoint folder.

    Executors on other machines must see what is written here, so the folder
    named by ``spark.checkpoint.dir`` is used. A machine-local folder is made
    only when the setting is missing and the session is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="portfolia-")
    return f"{base.rstrip('/')}/portfolia/{purpose}-{uuid.uuid4().hex}"
