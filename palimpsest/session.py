"""What a session needs for the engine's plans."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package on the Python workers' path, wherever they run, by Spark's own file service; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="palimpsest-")) / f"{top.name}.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(zipped))
    _shipped.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where the whole application is one
    process on this machine (tests, a laptop) and none is named is a temporary one made; on a
    cluster that is an error, as other machines could not read it. Spark removes what no plan refers to any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "palimpsest-checkpoints"))
    return df.checkpoint(eager=True)


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
