"""Session, table loading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings chunks input_entities "
    "aliases canonical_entities resolution_decisions golden_test eval_items companies metric_units"
).split()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reportloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a session that runs on this machine alone, as in tests, may leave that unset: a temporary folder then takes its place.
    On a cluster a folder of one machine would be a different one for each executor, so there its absence is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("reportloom.shared.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="reportloom-")
        spark.conf.set("reportloom.shared.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Tables that operators handed over to their callers, by session's application.
_handed_over: dict[str, list[str]] = {}


def hand_over(spark: SparkSession, path: str) -> None:
    _handed_over.setdefault(spark.sparkContext.applicationId, []).append(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that operators handed over in this application (Stash.finish); to be called once their frames are no longer read."""
    paths = _handed_over.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def release(df: DataFrame) -> None:
    """Deletes the one table that an operator handed over as `df`, for callers that are operators themselves."""
    if path := getattr(df, "_handed_over", None):
        paths = _handed_over.get(df.sparkSession.sparkContext.applicationId, [])
        if path in paths:
            paths.remove(path)
            _delete(df.sparkSession, path)


class Stash:
    """Written tables that cut the lineage of a loop and outlive lost executors.

    `put` writes a frame to the shared folder and returns it read back; `put_counted` also returns aggregates over it, seen while
    it was written; `drop` removes a table that no later plan reads. `finish` writes the result, drops every other
    table and hands the result over to the caller, whose session owns it until `sweep`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)  # the frame is held, so its id is not given to another
        return out

    def put_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        seen = Observation()
        out = self.put(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
        return out, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, df: DataFrame) -> None:
        if held := self.paths.pop(id(df), None):
            _delete(self.spark, held[0])

    def finish(self, df: DataFrame) -> DataFrame:
        return self.keep(self.put(df))

    def keep(self, out: DataFrame) -> DataFrame:
        """As finish, for a table that is written already and that the result is read from."""
        last, _ = self.paths.pop(id(out))
        for path, _ in self.paths.values():
            _delete(self.spark, path)
        self.paths.clear()
        hand_over(self.spark, last)
        out._handed_over = last
        return out


def fan_out(df: DataFrame) -> DataFrame:
    """Spread a frame of few input splits over all cores before costly per-row work.

    Frames that already have a split per core stay as they are: no shuffle at scale. Meant for frames that
    come from a scan without a shuffle, as counting the splits of others would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
