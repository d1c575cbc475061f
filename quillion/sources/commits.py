"""Commits to a store of Parquet files: what a reader sees changes by one new file at a time.

A namespace has a log of numbered entries. Whoever creates the file of the next number has made
the next entry; a file that is there is never written again, so two writers cannot make the same
one, and the loser tries again after what the winner wrote. Data is written before its entry, to
a folder that no reader looks into without one.

    <path>/ns=<ns>/commit=<name>/*.parquet    rows with ``place``, from 0 in each commit
    <path>-log/ns=<ns>/<number>.json          one entry

An append reserves the next ids for its rows: an id is the entry's ``start`` plus the row's
``place``. A reset hides all that was appended before; its files go when :func:`vacuum` is called.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version long, kind string, commit string, start long, n long, dim int, model string"
TRIES = 100


def log_path(path: str, ns: str) -> str:
    return f"{path.rstrip('/')}-log/ns={ns}"


def _there(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _there(spark, path)
    return fs.exists(p)


def log(spark: SparkSession, path: str, ns: str) -> DataFrame:
    """The entries of a namespace (:data:`ENTRY`); none if it was never written."""
    place = log_path(path, ns)
    if not exists(spark, place):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(place).where("version is not null")


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with all of ``text`` in it unless it is there; whether it was
    created. Readers see no file or the whole one."""
    fs, p = _there(spark, path)
    scheme = urlparse(str(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()))
    if scheme.scheme == "file":  # a link fails where its name is taken
        os.makedirs(os.path.dirname(scheme.path), exist_ok=True)
        draft = f"{os.path.dirname(scheme.path)}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, scheme.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    # Elsewhere the file system creates a file for one writer only; an entry that is not yet
    # whole is no line of JSON, and the next number cannot be taken before this one is there.
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    with contextlib.closing(out):
        out.write(bytearray(text.encode()))
    return True


def state(spark: SparkSession, path: str, ns: str) -> dict:
    """``version`` of the last entry (0 for none), the ``next`` id, and the width and model that
    the namespace was made for."""
    made = F.struct("dim", "model")
    last = log(spark, path, ns).agg(
        F.max("version").alias("version"), F.max_by(F.col("start") + F.col("n"), "version").alias("next"),
        F.max_by(made, F.when(F.col("kind") == "reset", F.col("version"))).alias("made"),
    ).first()
    made = last["made"].asDict() if last["made"] else {"dim": None, "model": None}
    return {"version": last["version"] or 0, "next": last["next"] or 0, **made}


def commit(spark: SparkSession, path: str, ns: str, entry: Callable[[dict], dict | None]) -> dict | None:
    """Make the next entry. ``entry`` gives its fields from the state it follows, or None where
    there is nothing to do; it is asked again after each lost race."""
    for _ in range(TRIES):
        now = state(spark, path, ns)
        made = entry(now)
        if made is None:
            return None
        made = {"version": now["version"] + 1, **made}
        if claim(spark, f"{log_path(path, ns)}/{made['version']:012d}.json", json.dumps(made) + "\n"):
            return made
    raise RuntimeError(f"{TRIES} writers were faster at {log_path(path, ns)}")


def append(rows: DataFrame, path: str, ns: str, n: int | None = None, name: str | None = None) -> dict | None:
    """Append rows that have a ``place`` from 0 on. ``name`` makes a retry of the same append
    the same commit: if it is in the log already, nothing is done."""
    spark = rows.sparkSession
    name = name or f"c{uuid.uuid4().hex}"
    known = F.max(F.col("commit") == name)
    if log(spark, path, ns).agg(known).first()[0]:
        return None
    folder = f"{path.rstrip('/')}/ns={ns}/commit={name}"
    rows.write.mode("overwrite").parquet(folder)
    n = spark.read.parquet(folder).count() if n is None else n

    def entry(now: dict) -> dict | None:
        if log(spark, path, ns).agg(known).first()[0]:
            return None
        return {"kind": "append", "commit": name, "start": now["next"], "n": n}

    return commit(spark, path, ns, entry)


def reset(spark: SparkSession, path: str, ns: str, dim: int | None = None, model: str | None = None) -> dict:
    """Empty a namespace; ids start from 0 again. From the entry on, readers see it empty, and
    one that began before sees what there was."""
    return commit(spark, path, ns, lambda now: {"kind": "reset", "start": 0, "n": 0, "dim": dim, "model": model})


def live(spark: SparkSession, path: str, ns: str, upto: int | None = None) -> DataFrame:
    """``commit, version, start`` of the appends since the last reset: a row for each append. With
    ``upto`` as they were after the entry of that version."""
    entries = log(spark, path, ns)
    entries = entries if upto is None else entries.where(F.col("version") <= upto)
    since = entries.where("kind = 'reset'").agg(F.coalesce(F.max("version"), F.lit(0)).alias("since"))
    return entries.where("kind = 'append'").join(F.broadcast(since), F.col("version") > F.col("since")).select("commit", "version", "start")


def read(spark: SparkSession, path: str, ns: str, id_col: str = "rid", upto: int | None = None) -> DataFrame:
    """The rows of a namespace with their ids, as the log has them when this is called. Folders
    without a live entry are not read: their partition is not among those joined."""
    entries = live(spark, path, ns, upto)
    # The log is fixed here, so that a plan that runs later does not mix two states of it.
    found = entries.collect()
    fixed = spark.createDataFrame(found, "commit string, version long, start long")
    rows = spark.read.parquet(f"{path.rstrip('/')}/ns={ns}").where(F.col("commit").isin([r["commit"] for r in found])).withColumn("ns", F.lit(ns))
    return rows.join(F.broadcast(fixed), "commit").withColumn(id_col, F.col("start") + F.col("place")).drop("start", "place")


def vacuum(spark: SparkSession, path: str, ns: str) -> int:
    """Delete the files of appends that a reset hides; how many folders went. Not while readers
    of the hidden state may still run."""
    entries = log(spark, path, ns)
    dead = entries.where("kind = 'append'").join(live(spark, path, ns).select("commit"), "commit", "left_anti")
    gone = 0
    for r in dead.select("commit").toLocalIterator():
        fs, p = _there(spark, f"{path.rstrip('/')}/ns={ns}/commit={r['commit']}")
        gone += bool(fs.delete(p, True))
    return gone
