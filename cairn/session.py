"""Spark session helpers.

The library never assumes a machine-local scratch folder: lineage cuts and
intermediate tables go to the shared folder named by ``spark.checkpoint.dir``.
Only when that setting is absent (tests, local runs) do we set our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "cairn",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A session configured the way every job here expects it.

    UTC session zone, AQE with partition coalescing and skew-join splitting,
    Arrow for pandas exchange, and the Spark UI off (no server, no port).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cairn`` importable in the Python workers (pandas UDFs, map/apply
    in pandas, stateful streaming functions) wherever they run: zip the
    package once and distribute it with ``addPyFile`` (what ``--py-files``
    does). Idempotent per application."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - remote session: ship with the job config instead
        return
    if key in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="cairn-pkg-"), "cairn.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server owns the setting
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        if sc is not None and not sc.master.startswith("local") or (sc is not None and sc.master.startswith("local-cluster")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="cairn-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    if sc is not None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
