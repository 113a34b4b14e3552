"""Readers with explicit schemas and pushed-down filters, file inventories, and sinks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The schemas of the delimited and columnar inputs.
CONSTRAINT_SCHEMAS = {
    "dayzer": "CID long, NAME string",
    "market": "CONSTRAINT string, CONTINGENCY string, TOZONE string, REPORTEDNAME string, CONSTRAINTID long, CONTINGENCYID long",
    "pano": "PID long, `Monitored Facility` string, `Contingency Name` string, Earliest string, Latest string",
}
BUS_SCHEMA = "id long, bus_unique_id string, bus_type string, base_kv double, zone_name string, pd double, pg double, date string, he int"
NODE_SCHEMAS = {
    "left": "MDB_ID string, NAME string, BASKV double, IDE string, AREA_NAME string, ZONE_NAME string, LAT double, LON double",
    "right": "NAME string, BASKV double, BUS_TYPE string, AREA_NAME string, ZONE_NAME string, LAT double, LON double, PANO_ID string, STATION string",
}
BRANCH_SCHEMAS = {
    "left": "MDB_ID string, NAME string, BRANCH_TYPE string, FROM_BUS string, TO_BUS string, FROM_KV double, TO_KV double, CKT string, R double, X double, B double, SRATEA double, SRATEB double, WRATEA double, WRATEB double",
    "right": "NAME string, BRANCH_TYPE string, FROM_BUS_ID string, FROM_BUS_KV double, TO_BUS_ID string, TO_BUS_KV double, CIRCUIT string, R double, X double, B double, RATE_A double, RATE_B double, RATE_C double, FROM_BUS_NAME string, TO_BUS_NAME string, PANO_ID string",
}
ZONE_SCHEMA = "zone_name string, pd double, pg double, load_bus_count int, gen_bus_count int, date string, he int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited file with a header under a given schema; nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_panel(spark: SparkSession, paths: list[str], columns: list[str], start: str | None = None, end: str | None = None, ids: list[str] | None = None, zones: list[str] | None = None, date: str = "date", id_col: str = "bus_unique_id", zone: str = "zone_name") -> DataFrame:
    """Chosen columns of a panel between two dates (both included); projection and filters reach the scan.

    Long id lists should be a table joined with left_semi instead.
    """
    if not paths:
        raise FileNotFoundError("no panel files to read")
    df = spark.read.parquet(*paths)
    return between(df, date, start, end).where(_among(id_col, ids) & _among(zone, zones)).select(*columns)


def _among(column: str, values: list | None):
    return F.lit(True) if values is None else F.col(column).isin(values)


def between(df: DataFrame, date: str, start, end) -> DataFrame:
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end))
    return df


def year_files(spark: SparkSession, folder: str, kind: str, years: list[int]) -> list[str]:
    """Paths of the yearly files that exist, by Hadoop's file system; none at all raises."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for y in years:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}_{y}.parquet")
        if p.getFileSystem(conf).exists(p):
            found.append(p.toString())
    if not found:
        raise FileNotFoundError(f"no {kind} files in {folder}")
    return found


def years_between(start: str, end: str) -> list[int]:
    return list(range(int(start[:4]), int(end[:4]) + 1))


def read_level(spark: SparkSession, folder: str, level: str, start: str, end: str, ids: list[str] | None = None, zones: list[str] | None = None) -> DataFrame:
    """Members ("bus") or zones ("zone") of a date window, out of the yearly files, with the hour's start as ``timestamp``."""
    from panelforge.functions.dates import hour_ending_time

    schema = {"bus": BUS_SCHEMA, "zone": ZONE_SCHEMA}[level]
    columns = [c.split()[0] for c in schema.split(", ")]
    paths = year_files(spark, folder, f"{level}_load", years_between(start, end))
    rows = read_panel(spark, paths, columns, start, end, ids if level == "bus" else None, zones)
    return rows.withColumn("timestamp", hour_ending_time("date", "he"))


def inventory(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, kind, rows, row_groups, columns, mb) of each file of a Parquet table, from the footers alone.

    Footers are read by the executors' file system classes on the driver, one a file; no data is read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system, rows = at.getFileSystem(conf), []
    found = [at] if system.getFileStatus(at).isFile() else [x.getPath() for x in system.listStatus(at)]
    for file in found:
        if not file.getName().endswith(".parquet"):
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
        try:
            meta = reader.getFooter()
            rows.append((file.getName(), kind, reader.getRecordCount(), meta.getBlocks().size(), meta.getFileMetaData().getSchema().getFieldCount(), system.getFileStatus(file).getLen() / 1e6))
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, kind string, rows long, row_groups int, columns int, mb double")


def find_file(spark: SparkSession, folder: str, names: list[str], patterns: list[str], depth: int = 4) -> str:
    """The first of ``names`` in a folder, else the first path by name that fits a pattern in it or below; none raises."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(conf)
    for name in names:
        if system.exists(p := jvm.org.apache.hadoop.fs.Path(at, name)):
            return p.toString()
    for pattern in patterns:
        for below in range(depth + 1):
            hits = system.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*/" * below + pattern))
            if hits:
                return min(h.getPath().toString() for h in hits)
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def find_review_file(spark: SparkSession, folder: str) -> str:
    """The reviewed matches, also under a misspelt name."""
    # Names under which reviewers hand the file back.
    names = ["bus_mapping_manual_reviewed_extended.csv", "bus_mapping_manual_reveiwed_extended.csv", "bus_mapping_manual_review_extended_reviewed.csv"]
    return find_file(spark, folder, names, ["*manual*reviewed*extended*.csv", "*manual*reveiwed*extended*.csv", "*manual*review*extended*reviewed*.csv"])


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a total order (a bare limit is not repeatable)."""
    return df.orderBy(*order).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for deliverables of bounded size; tables go to Parquet."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file through Spark, so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, content: dict, path: str) -> None:
    write_text(spark, json.dumps(content, sort_keys=True, default=str), path)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A report's table: at most ``most`` rows come to the driver."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def report(title: str, sections: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {n}\n\n{markdown_table(d)}" for n, d in sections.items())]) + "\n"


@dataclass(frozen=True)
class RunConfig:
    """Settings of an operational forecast; written beside its results."""

    name: str = "run"
    model: str = "random_forest"
    train_start: str = "2024-01-01"
    train_end: str = "2024-01-21"
    horizon: str = "next_week"
    members: list[int] | None = None
    top_members: int | None = None
    clusters: int = 0
    settings: dict = field(default_factory=dict)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RunConfig:
        return RunConfig(**json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, asdict(self), path)
