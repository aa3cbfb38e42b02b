"""Reading and writing: parquet, CSV, JSON lines, path fallback, shared work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_LOAN_SCHEMA = (
    "LoanID string, Age int, Income double, LoanAmount double, CreditScore int, MonthsEmployed int, "
    "NumCreditLines int, InterestRate double, LoanTerm int, DTIRatio double, Education string, "
    "EmploymentType string, MaritalStatus string, HasMortgage string, HasDependents string, LoanPurpose string, "
    "HasCoSigner string, `Default` int")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="forewarn-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoint"))


def _locate(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _locate(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _locate(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as plain files see it, or None for one on another file system."""
    fs, p = _locate(spark, path)
    uri = fs.makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def load_best(spark: SparkSession, paths: list[str], **csv_options) -> DataFrame:
    """The first path that exists: ``*.csv`` with header (``csv_options`` such as a schema), else parquet."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.csv(path, header=True, **csv_options) if path.endswith(".csv") else spark.read.parquet(path)
    raise FileNotFoundError(f"none of these exists: {paths}")


def read_csv(spark: SparkSession, path: str, schema: str = RAW_LOAN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; string arrays become one comma-separated field."""
    flat = {f.name: F.array_join(F.col(f"`{f.name}`"), ",") for f in df.schema.fields
            if isinstance(f.dataType, T.ArrayType)}
    out = df.withColumns(flat) if flat else df
    out.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option(
        "escape", '"').csv(path, header=True)


def write_scored(df: DataFrame, path: str, band: str = "risk_band") -> None:
    """Parquet partitioned by band, so at-risk reads skip the other folders."""
    df.write.mode("overwrite").partitionBy(band).parquet(path)


def write_sample(df: DataFrame, key: str, path: str, n: int = 1000) -> None:
    df.orderBy(key).limit(n).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
