"""Options of a data exchange as Spark settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.functions import config

#: What each option sets. Fixed values.
SETTINGS = {
    "job.enable-data-compression": ("spark.shuffle.compress",),
    "job.concurrent-readings-per-gate": ("spark.reducer.maxReqsInFlight",),
    "job.memory-per-gate": ("spark.reducer.maxSizeInFlight",),
    "memory.buffer-size": ("spark.shuffle.file.buffer",),
    "storage.local-data-dirs": ("spark.local.dir",),
    "storage.enable-data-checksum": ("spark.shuffle.checksum.enabled",),
    "transfer.client.connect-retries": ("spark.shuffle.io.maxRetries",),
    "transfer.client.connect-retry-wait": ("spark.shuffle.io.retryWait",),
    "rpc.timeout": ("spark.rpc.askTimeout",),
    "heartbeat.interval": ("spark.executor.heartbeatInterval",),
    "heartbeat.timeout": ("spark.network.timeout",),
}


def spark_settings(options: dict[str, object]) -> dict[str, str]:
    """Settings for a session; an option that has none is an error."""
    out = {}
    for key, value in options.items():
        if key not in SETTINGS:
            raise KeyError(f"no setting for option {key!r}; known: {', '.join(SETTINGS)}")
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if key == "storage.local-data-dirs":
            text = ",".join(d.strip().removeprefix("[SSD]").removeprefix("[HDD]") for d in text.split(",") if d.strip())
        out |= dict.fromkeys(SETTINGS[key], text)
    return out


#: How an option's text is read, by its type.
READ = {
    "string": lambda c: c,
    "int": lambda c: F.trim(c).try_cast("int"),
    "long": lambda c: F.trim(c).try_cast("long"),
    "double": lambda c: F.trim(c).try_cast("double"),
    "boolean": lambda c: F.when(F.lower(F.trim(c)).isin("true", "false"), F.lower(F.trim(c)) == "true"),
    "memory": config.memory_bytes,
    "duration": config.duration_nanos,
}


def option(options: Column, key: str, kind: str, default: object) -> Column:
    """The value of a key in a map of texts, of one of the kinds in ``READ``; the default where it
    is not set. What is set but can't be read is null."""
    text = F.element_at(options, F.lit(key))
    return F.when(text.isNull(), F.lit(default)).otherwise(READ[kind](text))
