"""Session settings, small-table staging and size-checked attachment."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A staged table is broadcast only up to this many rows and bytes; beyond it rows
# are joined by shuffle with the hot keys salted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 64


def build_session(app: str = "armlift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="armlift-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def stage(small: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared checkpoint folder.

    Later passes read it from there, so a lost executor costs no re-scan of the
    raw data and every pass sees bit-identical statistics.
    """
    _ensure_checkpoint_dir(small.sparkSession)
    return small.checkpoint(eager=True)


def fits_broadcast(staged: DataFrame, size: int | None = None) -> bool:
    """Whether a staged table is small enough, by rows and by the length of its rows as text."""
    wide = [f for f in staged.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.StringType))]
    if size is not None and not wide:
        return size <= BROADCAST_ROWS
    head = staged.limit(BROADCAST_ROWS + 1)
    rows, text = head.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*head.columns))))).first()
    return rows <= BROADCAST_ROWS and (text or 0) <= BROADCAST_BYTES


def salted(rows: DataFrame) -> DataFrame:
    """A salt from the row's place, so that equal rows are spread as well."""
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))


def attach(
    rows: DataFrame, staged: DataFrame, keys: list[str], how: str = "inner", size: int | None = None,
) -> DataFrame:
    """Join per-group statistics back to raw rows without shuffling a hot key.

    ``staged`` must come from :func:`stage`; its real size decides the strategy.
    ``size`` passes an upper bound of its rows where the caller has counted them.
    """
    if fits_broadcast(staged, size):
        return rows.join(F.broadcast(staged), keys, how)
    salted_rows = salted(rows)
    copies = staged.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted_rows.join(copies, [*keys, "_salt"], how).drop("_salt")

