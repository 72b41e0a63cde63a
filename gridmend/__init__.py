"""Spark-native resilience, adequacy and data-preparation engine."""

__all__ = ["session"]


def session(app: str = "gridmend", cores: str = "local[*]", **conf: str):
    """A local session with the settings that the engine's plans rely on."""
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(cores)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
