"""Reading and writing: files with the city in their name, manifests, alerts, listings; partitioned output and sidecars."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files that a task of write_pairs in place holds open, and what keeps each of them small.
OPEN_FILES, FEW_BYTES = 40, {"parquet.block.size": str(8 << 20), "compression": "zstd"}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one in local mode,
    an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV files with a header and a known schema; numbers that can't be read are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_city_files(spark: SparkSession, glob: str, pattern: str, fmt: str = "parquet", schema: str | None = None, city: str = "city", **options) -> DataFrame:
    """All files of a glob in one scan; the city is what the pattern's group finds in the file's path."""
    reader = spark.read.format(fmt).options(**options)
    reader = reader.schema(schema) if schema else reader
    df = reader.load(glob)
    return df.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias(city))


def with_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """The column where the table has it, else the label of its folder."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(label)) if column in df.columns else F.lit(label))


def first_existing(spark: SparkSession, globs: list[str]) -> str | None:
    """The first of some globs that matches anything."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for g in globs:
        path = jvm.org.apache.hadoop.fs.Path(g)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            return g
    return None


def read_manifest(data: DataFrame, manifest: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys the manifest lists, and the keys it lists that no row has."""
    listed = manifest.select(*keys).distinct()
    return data.join(listed, keys, "left_semi"), listed.join(data.select(*keys).distinct(), keys, "left_anti")


def resolve_names(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each wanted key with the number of files (key, path) of that key and, if it is one, its path."""
    found = files.groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return wanted.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


ALERT = "uuid string, type string, subtype string, confidence int, reliability int, pubMillis long, location struct<x:double,y:double>, city string, country string"


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each alert of polled JSON files {"alerts": [...]}; broken files and those without alerts give none."""
    files = spark.read.schema(f"alerts array<struct<{ALERT.replace(' ', ':').replace(',:', ',')}>>").json(folder, multiLine=True, recursiveFileLookup=True, mode="PERMISSIVE")
    rows = files.select(F.explode("alerts").alias("a")).select("a.*")
    return rows.select("*", F.timestamp_millis("pubMillis").alias("ts"), F.col("location.y").alias("lat"), F.col("location.x").alias("lon"))


def read_alerts_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same of files with a poll in each line, which are split over tasks."""
    polls = spark.read.schema(f"alerts array<struct<{ALERT.replace(' ', ':').replace(',:', ',')}>>").json(folder, mode="PERMISSIVE")
    rows = polls.select(F.explode("alerts").alias("a")).select("a.*")
    return rows.select("*", F.timestamp_millis("pubMillis").alias("ts"), F.col("location.y").alias("lat"), F.col("location.x").alias("lon"))


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, name and size of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


def read_geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """polygon_id and ring of the outer rings of a FeatureCollection of polygons."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("polygon_id", "f")).where("f.geometry.type = 'Polygon'")
    return rows.select("polygon_id", F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def write_pairs(edges: DataFrame, path: str, max_rows: int = 5_000_000, in_place: bool = False) -> None:
    """Edges in one folder for each pair of cities. The folders' names are part1 and part2, so the labels stay in the rows.
    in_place: each task writes the edges it has, unsorted and unsent, one file for each of its pairs of cities at least;
    tasks should have those of few. Beyond OPEN_FILES pairs of a task Spark sorts the rest of its edges."""
    named = edges.withColumns({"part1": F.col("city1"), "part2": F.col("city2")})
    if not in_place:
        named.repartition("part1", "part2").write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy("part1", "part2").parquet(path)
        return
    conf, want = edges.sparkSession.conf, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), "spark.sql.optimizer.plannedWrite.enabled": "false"}
    had = {k: conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            conf.set(k, v)
        named.write.mode("overwrite").options(**FEW_BYTES).option("maxRecordsPerFile", max_rows).partitionBy("part1", "part2").parquet(path)
    finally:
        for k, v in had.items():
            conf.unset(k) if v is None else conf.set(k, v)


def write_with_sidecar(df: DataFrame, path: str, facts: dict) -> None:
    """A table and, beside it, its facts as JSON with sorted keys."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    text = json.dumps(facts, sort_keys=True, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.facts")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def purge(spark: SparkSession, path: str, partitions: list[str], dry_run: bool = True) -> list[str]:
    """Removes the named partition folders of a dataset; returns those that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = []
    for name in partitions:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            gone.append(name)
            if not dry_run:
                fs.delete(p, True)
    return gone


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do of a resumed run."""
    return expected.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes the partitions that df holds, and leaves the dataset's others as they are: the repair of some of a run."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
