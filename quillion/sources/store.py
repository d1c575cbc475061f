"""Tables in and out: pages, JSON lines, delimited text, search results, chunk stores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.functions.text import safe_token
from quillion.sources import commits


_OWN: dict[str, str] = {}  # folders of local applications that name none


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share. Where ``spark.checkpoint.dir`` is unset
    a local session (one process, as in tests) gets a temporary folder, and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _OWN.get(spark.sparkContext.applicationId) or _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillion-"))
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write a result that several branches of a plan read, and read it back."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_pages(documents: DataFrame) -> DataFrame:
    """One row a page: a source is a document, its texts are numbered from 1 in id order. Rows
    are numbered within range partitions of (source, id) and start after those of the same
    source in partitions before, so a source of any size is many tasks' work."""
    rows = documents.select(F.col("source").alias("doc_name"), "doc_id", "lang", "text")
    parted = keep(rows.repartitionByRange("doc_name", "doc_id").withColumn("__part", F.spark_partition_id()), "pages")
    sizes = parted.groupBy("doc_name", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("doc_name").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("doc_name").alias("__doc"), F.col("__part").alias("__own"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part", "doc_name").orderBy("doc_id"))
    same = F.col("__part").eqNullSafe(F.col("__own")) & F.col("doc_name").eqNullSafe(F.col("__doc"))
    # A row for each source of a partition.
    met = parted.withColumn("__place", place).join(before, same)
    return met.select("doc_name", (F.col("__place") + F.col("__before")).cast("int").alias("page"), "doc_id", "lang", "text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, an object of nulls is a row."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """JSON lines, or delimited text with a header, by the path's suffix or ``kind``."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "json"):
        return read_jsonl(spark, path, schema)
    if kind in ("csv", "tsv"):
        return spark.read.schema(schema).csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    raise ValueError(f"no such kind of table: {path}")


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.json(path, ignoreNullFields=False)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.csv(path, header=True, sep=sep, escape='"')
    return path


def web_to_chunks(results: DataFrame) -> DataFrame:
    """Search results (title, snippet, url, source) as chunks of a document "Web:host"."""
    title, snippet = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("snippet", F.lit("")))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    host = F.coalesce(F.nullif(host, F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("web"))
    rows = results.where((title != "") | (snippet != ""))
    return rows.select(
        F.trim(F.concat(title, F.lit("\n"), snippet)).alias("text"),
        F.concat(F.lit("Web:"), host).alias("doc_name"),
        F.lit(1).alias("page_start"),
        F.lit("web").alias("section_tag"),
        F.col("url").alias("web_url"),
        F.lit(0.85).alias("score"),
    )


def with_row_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "rid") -> DataFrame:
    """Consecutive ids in the order of unique ``order`` columns, without one task for all rows:
    range partitions are counted, and each row adds its place to the counts before it."""
    parted = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parted = keep(parted, "ordered")
    counts = parted.groupBy("__part").count()  # as many rows as partitions
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn("__place", place).join(F.broadcast(counts), "__part").withColumn(
        name, F.col("__place") + F.col("__before") + F.lit(start).cast("long")
    ).drop("__part", "__place", "__before")


def append_chunks(chunks: DataFrame, path: str, order: list[str], ns: str = "default", name: str | None = None) -> DataFrame:
    """Append non-blank chunks to the namespace of a store, with ids after those it has; returns
    the namespace as it is then. Chunks without a document go to "Unknown.pdf". Writers may
    append at the same time: each gets consecutive ids of its own. An append with the ``name``
    of one that is there already does nothing."""
    spark = chunks.sparkSession
    kept = chunks.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "")
    kept = kept.withColumn("doc_name", F.coalesce(F.nullif(F.col("doc_name"), F.lit("")), F.lit("Unknown.pdf")))
    commits.append(with_row_ids(kept.drop("rid"), order, 0, "place"), path, ns, name=name)
    return read_store(spark, path, ns)


def read_store(spark: SparkSession, path: str, ns: str = "default") -> DataFrame:
    """The chunks of a namespace that was appended to at least once."""
    return commits.read(spark, path, ns).drop("commit", "version")


def ns_key(backend: Column, model: Column) -> Column:
    """Namespace of an embedding backend and model: both, and eight digits of their SHA-1."""
    tag = F.concat(F.lower(backend), F.lit("|"), model)
    return F.concat(F.lower(backend), F.lit("_"), safe_token(model), F.lit("_"), F.substring(F.sha1(tag), 1, 8))


def ensure_ns(spark: SparkSession, path: str, ns: str, dim: int, model: str) -> bool:
    """Make a namespace of a store fit for vectors of ``dim`` numbers from ``model``: where it was
    made for others, or for none, it is emptied. Whether one made for others was."""
    was: dict = {}

    def entry(now: dict) -> dict | None:
        was.update(now)
        same = now["dim"] == dim and now["model"] == model
        return None if same else {"kind": "reset", "start": 0, "n": 0, "dim": dim, "model": model}

    return commits.commit(spark, path, ns, entry) is not None and was["dim"] is not None


def reset_ns(spark: SparkSession, path: str, ns: str) -> None:
    """Empty one namespace of a store and leave the others; it stays made for what it was. Readers
    see all of it or nothing."""
    commits.commit(spark, path, ns, lambda now: {"kind": "reset", "start": 0, "n": 0, "dim": now["dim"], "model": now["model"]})
