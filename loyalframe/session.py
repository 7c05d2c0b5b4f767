"""SparkSession settings the datasets are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter for results (not only speed):
#   session time zone UTC  -> day differences have no DST steps
#   caseSensitive false    -> Num_of_Orders / Num_Of_Orders are one column
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the product and label joins share a stage: split a hot product there too
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # size-checked broadcast: the planner (and AQE at runtime, from real
    # shuffle sizes) broadcasts a join side only below this bound and
    # falls back to a sort-merge join above it.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # HotSpot never compiles a method above 8000 bytes of code: a stage whose
    # one generated method is larger would run interpreted, so Spark is told
    # to generate such stages operator by operator, in small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def cluster_conf(input_bytes: int, executor_cores: int = 4000) -> dict:
    """Shuffle / scan sizing for a cluster run over ``input_bytes`` of lines.

    Scans: 512 MB splits (fewer, larger tasks; Parquet row groups of a
    well-written table are <= that). Shuffles: the first shuffle (lines ->
    orders, after map-side combine) carries roughly a quarter of the line
    volume; start with enough partitions for ~256 MB each and let AQE
    coalesce the later, much smaller shuffles toward the same advisory
    size. Skewed partitions (> 5x the median and > 1 GB) are split, also
    where that costs an extra shuffle.
    """
    shuffle_bytes = max(input_bytes // 4, 1)
    partitions = max(executor_cores * 2, shuffle_bytes // (256 * 1024 * 1024))
    return {
        **SESSION_CONF,
        "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
        # joins that share one partitioning (the product and label joins on
        # trim(SKU_ID)) sit in one stage; without this AQE would skip a skew
        # split there because it breaks the next join's partitioning. With
        # it, a hot product is split and a shuffle is added only then.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        # Broadcast bounds. The planner's static estimate of a scan is its
        # compressed file size, which can understate the in-memory table
        # several times, so the static bound stays small. At run time AQE
        # measures the real (uncompressed) shuffle output of a join side:
        # the label join needs only (id, brand, pack size) per product, and
        # up to ~512 MB of that, measured, is cheaper to broadcast than
        # shuffling every line by product id; above it the join stays
        # sort-merge, with skewed partitions split.
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(512 * 1024 * 1024),
    }


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "loyalframe",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (a cluster brings its own)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # remove checkpoint files once their DataFrame is garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Set on a given session what results depend on, the skew handling of the joins and the size of generated methods."""
    for k in ("spark.sql.session.timeZone", "spark.sql.caseSensitive", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin",
              "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(k, SESSION_CONF[k])


def require_utc(spark: SparkSession) -> None:
    """Day differences and minutes are right only without DST steps."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"session time zone is {zone}: call loyalframe.session.apply_session_conf(spark) first")


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only when it is unset and the master is local (tests) a fresh scratch
    folder is taken; a cluster without it is an error, as executors would
    write to folders of their own.
    A Spark Connect session has no driver-side context here: the server's
    own setting applies and is returned as found.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        return d
    d = d or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loyalframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d
