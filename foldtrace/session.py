"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode; wide projections then
    # run faster as separate operators whose generated code is split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A Python worker holds one Arrow batch at a time, however long its rows are.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

# Static: only a new session can take them.
STARTUP_SETTINGS = {
    # Recording the Python call site of every column call makes wide plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldtrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RUNTIME_SETTINGS, **STARTUP_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
