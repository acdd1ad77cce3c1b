"""Immutable runs of rows in a shared folder, their manifests, and listings of source files."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranks import global_rank
from ..operators.splits import snapshot_drift

EXTENSIONS = (".mid", ".midi")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, size_bytes) of regular files below root with one of the extensions, in any case; contents are never read.

    A missing root is an error of Spark, an empty one gives no row. Rows have no order; listed() ranks them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ends = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    return files.select("path", F.col("length").alias("size_bytes")).filter(ends)


def listed(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, size_bytes, rank) of the files with one of the extensions, ranked by lower-case path, then path."""
    ends = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    own = files.filter(ends).select("path", "size_bytes", F.lower("path").alias("low"))
    return global_rank(own, ["low", "path"], staged).drop("low")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names for shared work, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/runs"


def staged(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back, so that several plans share them and a lost executor costs little."""
    place = f"{shared_root(rows.sparkSession)}/staged/{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _marks(columns: list[str]) -> list:
    """Number of rows and two sums of hashes, the same for any order; equal rows do not cancel."""
    own = sorted(columns)
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return [F.count("*").alias("n"), total(*own).alias("a"), total(F.lit(1), *own).alias("b")]


def _told(marks) -> tuple[int, str]:
    return marks["n"], f"{marks['a'] or 0}:{marks['b'] or 0}"


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest that is the same for any order."""
    return _told(rows.agg(*_marks(rows.columns)).first())


class Drift(RuntimeError):
    """Inputs are not what they were when the work on them began."""


class Conflict(RuntimeError):
    """Another writer came first."""


class Rejected(RuntimeError):
    """Declared inputs of a stage break its rules, so that nothing of it is published."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of that name; says whether it did.

    The file system settles who comes first: an exclusive creation, which HDFS and POSIX folders do as one
    step. On an object store this holds as far as its connector creates files conditionally.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    try:
        out = files.create(at, False)
    except Py4JJavaError as refused:
        if files.exists(at):
            return False
        raise refused
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _small(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of small files; none where there is no such path."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, value string")


def _entry_path(root: str, run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"run id {run_id!r} is no plain name")
    return f"{root}/entries/{run_id}.json"


def _entry(spark: SparkSession, root: str, run_id: str) -> dict | None:
    """What is declared of a run, if it is."""
    held = _small(spark, _entry_path(root, run_id)).first()
    if held is None:
        return None
    if not held["value"]:
        raise Conflict(f"run {run_id} is being declared; if no writer is at it, remove {_entry_path(root, run_id)}")
    return json.loads(held["value"])


class Prepared(NamedTuple):
    """Rows that lie in a folder of their own and are not declared yet, with what was observed while they were written."""

    place: str
    n: int
    digest: str
    also: dict
    schema: str


def prepare(rows: DataFrame, root: str, run_id: str, by: list[str] | str = "split", order: list[str] | None = None, **also: Column) -> Prepared:
    """Writes rows to a new folder; their number, their digest and other aggregates are observed in the same pass.

    The stage that writes is the one that is observed, so each of its tasks counts once. Rows that are
    to be sorted are dealt first, each value of `by` over as many parts as a shuffle has. Values of
    `by` are not empty strings, which a folder's name cannot tell from null.
    """
    place, seen = f"{root}/{run_id}-{uuid.uuid4().hex}", Observation()
    keys = [by] if isinstance(by, str) else list(by)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(*keys, F.pmod(F.xxhash64(*sorted(rows.columns)), F.lit(parts))).sortWithinPartitions(*keys, *order) if order else rows
    dealt.observe(seen, *_marks(rows.columns), *[value.alias(name) for name, value in also.items()]).write.partitionBy(*keys).parquet(place)
    got = seen.get
    return Prepared(place, *_told(got), {name: got[name] for name in also}, rows.schema.json())


def declare(spark: SparkSession, root: str, run_id: str, made: Prepared) -> tuple[str, str]:
    """Declares prepared rows as run_id, or reuses an equal run; another content under the same id is an error.

    Of several writers exactly one declares; the others find its entry and compare.
    """
    text = json.dumps({"run_id": run_id, "place": made.place, "n": made.n, "digest": made.digest, "schema": json.loads(made.schema)}, sort_keys=True)
    if create_once(spark, _entry_path(root, run_id), text):
        return made.place, "created"
    held = _entry(spark, root, run_id)
    if (held["n"], held["digest"]) != (made.n, made.digest):
        raise ValueError(f"run {run_id} exists with other content")
    if held["place"] != made.place:
        spark.range(0).write.mode("overwrite").parquet(made.place)  # the copy is not needed
    return held["place"], "reused"


def publish(rows: DataFrame, root: str, run_id: str, by: list[str] | str = "split", order: list[str] | None = None) -> tuple[str, str]:
    """Writes rows as run_id under root, or reuses an equal run; another content under the same id is an error.

    Rows are worked out once. A run that was cut off is never declared, and nobody reads it. Files
    are partitioned by `by` and sorted by `order`. Returns the folder and created or reused.
    """
    return declare(rows.sparkSession, root, run_id, prepare(rows, root, run_id, by, order))


def read(spark: SparkSession, root: str, run_id: str, verify: bool = False) -> DataFrame:
    """The rows of one declared run; other folders beside it are never listed. verify compares number and digest first."""
    held = _entry(spark, root, run_id)
    if held is None:
        raise ValueError(f"run {run_id} is not declared")
    rows = spark.read.schema(StructType.fromJson(held["schema"])).parquet(held["place"])
    if verify and digest(rows) != (held["n"], held["digest"]):
        raise ValueError(f"run {run_id} does not hold what it declares")
    return rows


class Manifest(NamedTuple):
    """One current run: its id, configuration and summary, and the tables of its sources and fragments."""

    run_id: str
    configuration: dict
    summary: dict
    sources: DataFrame
    fragments: DataFrame


def _current(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The last version of the current run and what it says."""
    last = _small(spark, f"{root}/versions").filter("value <> ''").orderBy(F.desc("name")).limit(1).first()
    return (int(last["name"].split(".")[0]), json.loads(last["value"])) if last else (0, None)


def unchanged(before: DataFrame, after: DataFrame, most: int = 5) -> None:
    """Raises Drift, naming the first keys, where two tables (key, sha256) differ; the driver holds `most` keys and a number."""
    drift = snapshot_drift(before, after)
    first = drift.orderBy("key", "status").limit(most).collect()
    if first:
        raise Drift(f"{drift.count()} inputs changed before publication: " + ", ".join(f"{r['key']} ({r['status']})" for r in first))


def write_manifest(root: str, run_id: str, configuration: dict, sources: DataFrame, fragments: DataFrame, recheck: Callable[[], tuple[DataFrame, DataFrame]] | None = None, follows: int | None = None) -> dict:
    """Publishes sources and fragments as run_id and makes it the current run; returns the summary.

    The summary counts sources (discovered, compatible, discarded) and fragments, as observed while
    they were written. recheck gives fingerprints (key, sha256) from before the work and of now; it is
    called once all rows lie there, and nothing is declared where they differ. Versions of the current run
    are numbered, and a version is created only once: where another writer was first since this
    one began (or since version `follows`), it is a Conflict, unless both say the same.
    """
    spark = sources.sparkSession
    version, held = _current(spark, root)
    version = version if follows is None else follows
    one = prepare(sources, root, f"sources-{run_id}", compatible=F.count_if("compatible"))
    two = prepare(fragments, root, f"fragments-{run_id}")
    if recheck is not None:
        unchanged(*recheck())
    declare(spark, root, f"sources-{run_id}", one)
    declare(spark, root, f"fragments-{run_id}", two)
    good = one.also["compatible"]
    summary = {"discovered_files": one.n, "compatible_sources": good, "discarded_sources": one.n - good, "generated_fragments": two.n}
    said = {"run_id": run_id, "configuration": configuration, "summary": summary}
    if follows is not None or held != json.loads(json.dumps(said)):
        _follow(spark, root, version, said)
    return summary


def _follow(spark: SparkSession, root: str, version: int, said: dict) -> None:
    """Makes the version after `version` of the current run, unless another writer did and says something else."""
    text = json.dumps(said, sort_keys=True)
    if not create_once(spark, f"{root}/versions/{version + 1:012d}.json", text) and json.dumps(_current(spark, root)[1], sort_keys=True) != text:
        raise Conflict(f"version {version + 1} of the current run was made by another writer")


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    """The current run of a root. Its tables are found by name and compared with what was declared of them."""
    _, held = _current(spark, root)
    if held is None:
        raise ValueError("no current run")
    summary = held["summary"]
    for kind, name in (("sources", "discovered_files"), ("fragments", "generated_fragments")):
        entry = _entry(spark, root, f"{kind}-{held['run_id']}")
        if entry is None or entry["n"] != summary[name]:
            raise ValueError(f"run {held['run_id']} does not declare the {kind} that its summary counts")
    sources, fragments = (read(spark, root, f"{kind}-{held['run_id']}", verify=True) for kind in ("sources", "fragments"))
    return Manifest(held["run_id"], held["configuration"], summary, sources, fragments)


class Tokenized(NamedTuple):
    """The current run of the second stage: its id, the run of the first stage it was made from, configuration, summary and rows."""

    run_id: str
    first_run: str
    configuration: dict
    summary: dict
    rows: DataFrame


def write_sequences(root: str, first: Manifest, configuration: dict, rows: DataFrame, failures: DataFrame, keys: list[str], most: int = 5) -> str:
    """Publishes the sequences (keys, split, ids) made from a run of the first stage, all or none; returns the run id.

    The id follows from the first stage's run and the configuration. Where failures (keys, rules) has
    a row, Rejected names the first ones and nothing is declared. The summary is observed
    while rows are written.
    """
    spark = rows.sparkSession
    named = failures.orderBy(*keys).limit(most).collect()
    if named:
        told = "; ".join("/".join(str(r[k]) for k in keys) + f": {r['rules']}" for r in named)
        raise Rejected(f"{failures.count()} declared fragments rejected: {told}")
    version, held = _current(spark, root)
    run_id = hashlib.sha256(json.dumps([first.run_id, configuration], sort_keys=True).encode()).hexdigest()[:20]
    length = F.size("ids").cast("long")
    made = prepare(rows, root, run_id, total_tokens=F.sum(length), min_tokens=F.min(length), max_tokens=F.max(length))
    declare(spark, root, run_id, made)
    said = {"run_id": run_id, "first_run": first.run_id, "configuration": configuration, "summary": {"sequences": made.n, **made.also}}
    if held != json.loads(json.dumps(said)):
        _follow(spark, root, version, said)
    return run_id


def read_sequences(spark: SparkSession, root: str, first: Manifest | None = None) -> Tokenized:
    """The current run of the second stage, its rows compared with what was declared. With `first`, it must have been made from that run."""
    _, held = _current(spark, root)
    if held is None:
        raise ValueError("no current run")
    if first is not None and held["first_run"] != first.run_id:
        raise Drift(f"sequences were made from run {held['first_run']}, the current one is {first.run_id}")
    return Tokenized(held["run_id"], held["first_run"], held["configuration"], held["summary"], read(spark, root, held["run_id"], verify=True))


def declared_only(rows: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of fragments that a manifest declares."""
    return rows.join(fragments.select(*keys).distinct(), keys, "left_semi")
