"""A local session with the settings that the engine relies on."""

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``. Where that is unset, a folder of this
    machine on a local master, and an error on a cluster: its machines share no such folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "/tmp/checkpoints/hopsmith"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}-{label}"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """UTC, ANSI and adaptive execution on; for tests and single machines."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hopsmith")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
