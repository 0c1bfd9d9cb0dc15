"""Tables of the engine: reading and writing statements, templates, logs and sources, and intermediate tables."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATEMENTS = "idom_id int, event_id int, path string, package string, class string, method string, line_number int, level string, template string"
TEMPLATES = "idom_id int, template_id int, path string, level string, template string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of this process, if all of Spark runs in it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/logweave-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


#: Intermediate paths of this process that may still stand.
_written: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; results that read them must have been written."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, order: str, n: str) -> DataFrame:
    """(order, before): for each row of a unique column the sum of n over the rows before it, in no single task.

    Rows are dealt to ranges; sums of ranges are added up first, one row for each range, and then those within a range.
    """
    parts = stored(df.select(order, n).repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("part_").agg(F.sum(n).alias("n_"))
    base = sums.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    here = F.coalesce(F.sum(n).over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("here_", here).join(F.broadcast(base), "part_").select(order, (F.col("base_") + F.col("here_")).alias("before"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below a folder, one for each project, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(x.getPath().toString() for x in found if x.isDirectory())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document as a file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray((json.dumps(value) + "\n").encode()))
    out.close()


def write_graph(statements: DataFrame, path: str) -> None:
    """Statements as a table, by project where they have one."""
    writer = statements.write.mode("overwrite")
    (writer.partitionBy("project") if "project" in statements.columns else writer).parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_environment(uri: str) -> tuple[str, list[str]]:
    """(scheme, paths) of file:p1;p2 or maven:dir."""
    m = re.fullmatch(r"(?P<scheme>[a-z][a-z0-9]*):(?P<paths>.*)", uri, re.S)
    if not m or m["scheme"] not in ("file", "maven"):
        raise ValueError(f"not an environment: {uri!r}")
    return m["scheme"], m["paths"].split(";") if m["scheme"] == "file" else [m["paths"]]


def maven_roots(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the main sources of a project and of its modules, and theirs, as their pom.xml files name them."""
    found, todo, seen = [], [folder.rstrip("/")], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        source = "src/main/java"
        if exists(spark, f"{at}/pom.xml"):
            pom = ElementTree.fromstring(spark.read.text(f"{at}/pom.xml", wholetext=True).first()[0])
            child = lambda x, name: [y for y in x if y.tag.rpartition("}")[2] == name]
            todo += [f"{at}/{(m.text or '').strip()}" for modules in child(pom, "modules") for m in child(modules, "module")]
            source = next(((d.text or "").strip() for b in child(pom, "build") for d in child(b, "sourceDirectory")), source)
        if exists(spark, f"{at}/{source}"):
            found.append(f"{at}/{source}")
    return found


def scan_source(spark: SparkSession, environment: str = "file:.") -> DataFrame:
    """(path, text) of Java files; for maven, of the main sources of a project and its modules."""
    scheme, paths = parse_environment(environment)
    if scheme == "maven":
        paths = maven_roots(spark, paths[0])
        if not paths:
            return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_logs(spark: SparkSession, root: str, pattern: str = "*-output.txt") -> DataFrame:
    """(file, line_no, line) of every log file below root; blank lines are numbered and left out.

    Files are read in splits, so one of any size is no single task: lines are numbered within their split, and splits
    by the numbers of lines before them.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = stored(lines, "lines")
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("file").alias("f"), F.col("split").alias("s"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    rows = lines.withColumn("inside", inside).join(counts, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    return rows.where("line <> ''").select("file", (F.col("before") + F.col("inside") - 1).alias("line_no"), "line")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Nine quoted columns without a header; a negative idom is none."""
    rows = spark.read.schema(STATEMENTS).option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("idom_id", F.when(F.col("idom_id") >= 0, F.col("idom_id")))


def write_statements(df: DataFrame, path: str) -> None:
    names = [x.split()[0] for x in STATEMENTS.split(", ")]
    rows = df.select(*[F.coalesce(F.col(x).cast("string"), F.lit("-1" if x == "idom_id" else "")).alias(x) for x in names])
    rows.write.option("quoteAll", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Five columns: idom or empty, id, path, level, template."""
    rows = spark.read.schema(TEMPLATES).option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("template", F.trim("template"))
