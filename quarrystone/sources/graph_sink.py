"""A sink for property graphs: rows go out in batches, a batch that fails goes out row by row, and rows that fail become a table.

`GraphSink` is a Spark data source for writing (format `quarrystone_graph`). A task hands batches of `batch` rows to a target; a
target takes a batch whole or raises. What a task has written counts only once the driver has all tasks' messages and the run's
manifest stands in the store; a killed task, attempt or job leaves files that no manifest names. A run has a name: writing
it again replaces its manifest, so a rerun with the same rows changes nothing, and the order of runs is that of their first commits.

`Files` is the target at hand: one file of accepted rows and one of failed rows a task, in a folder that pyarrow opens (file, hdfs,
s3). It takes columns: rows that are surely right pass as they are, and only the others are looked at one by one. `graph` reads the elements as all committed runs leave them: properties that a later run sets replace earlier ones.
For a store with a client of its own, give a subclass of `Target` as option `target` (module:Class).

Edge cases. Rows are refused with a reason for a blank id, a label that is no identifier, one endpoint without the other, or a blank
property name; null properties are none. Of rows that share an id in one run later values are the greater ones, so results don't
depend on order. Empty runs commit an empty manifest. A store without commits is an empty graph.
"""

from __future__ import annotations

import importlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "id string, label string, start_id string, end_id string, properties map<string,string>"
ARROW = pa.schema([("id", pa.string()), ("label", pa.string()), ("start_id", pa.string()), ("end_id", pa.string()), ("properties", pa.map_(pa.string(), pa.string()))])
FAILED = "id string, label string, reason string"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
BATCH = 500
#: Rows, and bytes of rows, that a task holds before it writes them.
GROUP, GROUP_BYTES = 50_000, 32_000_000
#: Texts that have such a character aren't blank, whatever counts as a space.
SEEN = r"[^\s\pZ\pC]"


class Refused(ValueError):
    """A row that a target doesn't take."""


def checked(row: dict) -> None:
    if not (row["id"] or "").strip():
        raise Refused("BLANK_ID")
    if not NAME.match(row["label"] or ""):
        raise Refused("LABEL")
    if bool(row["start_id"]) != bool(row["end_id"]):
        raise Refused("ENDPOINT_NOT_FOUND")
    if any(not (k or "").strip() for k, _ in row["properties"] or ()):
        raise Refused("PROPERTY_NAME")


def surely(batch: pa.RecordBatch) -> pa.BooleanArray:
    """Rows that `checked` takes, judged by columns; rows of unusual spelling may be missing."""

    def has(column: pa.Array, pattern: str) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(column, pattern), False)

    ends = [pc.fill_null(pc.greater(pc.binary_length(batch.column(c)), 0), False) for c in ("start_id", "end_id")]
    good = pc.and_(pc.and_(has(batch.column("id"), SEEN), has(batch.column("label"), rf"\A{NAME.pattern[:-2]}\z")), pc.equal(*ends))
    properties = batch.column("properties")
    named = np.ones(len(properties), bool)
    start, end = (properties.offsets[i].as_py() for i in (0, -1))
    unsure = pc.invert(has(properties.keys.slice(start, end - start), SEEN)).to_numpy(zero_copy_only=False)
    named[np.searchsorted(properties.offsets.to_numpy(), np.flatnonzero(unsure) + start, "right") - 1] = False
    return pc.and_(good, pa.array(named))


class Target:
    """Where one task's rows go."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def take(self, batch: pa.RecordBatch) -> list[tuple]:
        """Takes a batch whole, or its rows one by one if it fails; the rows that fail (id, label, reason)."""
        rows, failed = batch.to_pylist(), []
        try:
            self.merge(rows)
        except Exception:  # noqa: BLE001  whatever a store raises, the other rows of the batch go out alone
            for row in rows:
                try:
                    self.merge([row])
                except Exception as e:  # noqa: BLE001
                    failed.append((row["id"], row["label"], str(e) if isinstance(e, Refused) else type(e).__name__))
        return failed

    def merge(self, rows: list[dict]) -> None:
        """Takes all of the rows or raises and takes none."""
        raise NotImplementedError

    def closed(self, failed: list[tuple]) -> list[str]:
        """Ends the task's writing; what the manifest has to name."""
        raise NotImplementedError

    def undone(self, names: list[str]) -> None:
        """Takes back what a task has written, if the store can."""


class Files(Target):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.store, self.root = fs.FileSystem.from_uri(options["path"])
        self.name, self.writer, self.held = uuid.uuid4().hex, None, []
        self.waiting = self.bytes = 0

    def _path(self, kind: str) -> str:
        self.store.create_dir(f"{self.root}/{kind}", recursive=True)
        return f"{self.root}/{kind}/{self.name}.parquet"

    def take(self, batch: pa.RecordBatch) -> list[tuple]:
        if type(self).merge is not Files.merge:  # a subclass has checks of its own
            return super().take(batch)
        sure = surely(batch)
        self._hold(pa.Table.from_batches([batch.filter(sure)]).cast(ARROW))
        rest, failed, good = batch.filter(pc.invert(sure)).to_pylist(), [], []
        for row in rest:
            try:
                checked(row)
                good.append(row)
            except Refused as e:
                failed.append((row["id"], row["label"], str(e)))
        self.merge(good)
        return failed

    def merge(self, rows: list[dict]) -> None:
        for row in rows:
            checked(row)
        self._hold(pa.Table.from_pylist(rows, ARROW))

    def _hold(self, rows: pa.Table) -> None:
        """Nothing counts before the commit, so rows wait for a row group."""
        if rows.num_rows:
            self.held.append(rows)
        self.waiting += rows.num_rows
        self.bytes += rows.nbytes
        if self.waiting >= GROUP or self.bytes >= GROUP_BYTES:
            self._group()

    def _group(self) -> None:
        if self.writer is None:
            self.writer = pq.ParquetWriter(self._path("rows"), ARROW, filesystem=self.store)
        self.writer.write_table(pa.concat_tables(self.held).combine_chunks())
        self.held, self.waiting, self.bytes = [], 0, 0

    def closed(self, failed: list[tuple]) -> list[str]:
        out = []
        if self.held:
            self._group()
        if self.writer is not None:
            self.writer.close()
            out.append(f"rows/{self.name}.parquet")
        if failed:
            names = [f.split(" ")[0] for f in FAILED.split(", ")]
            pq.write_table(pa.table([pa.array([r[i] for r in failed], pa.string()) for i in range(3)], names), self._path("failed"), filesystem=self.store)
            out.append(f"failed/{self.name}.parquet")
        return out

    def undone(self, names: list[str]) -> None:
        for name in names:
            self.store.delete_file(f"{self.root}/{name}")


@dataclass
class Written(WriterCommitMessage):
    merged: int = 0
    failed: int = 0
    names: list[str] = field(default_factory=list)


def _target(options: dict[str, str]) -> Target:
    module, _, name = options.get("target", f"{__name__}:Files").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.size = int(options.get("batch", BATCH))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target, failed, merged = _target(self.options), [], 0
        for batch in iterator:
            for at in range(0, batch.num_rows, self.size):
                part = batch.slice(at, self.size)
                lost = target.take(part)
                failed += lost
                merged += part.num_rows - len(lost)
        return Written(merged, len(failed), target.closed(failed))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        body = {"merged": sum(m.merged for m in done), "failed": sum(m.failed for m in done), "names": sorted(n for m in done for n in m.names)}
        commit(self.options["path"], self.options["run"], body)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                _target(self.options).undone(m.names)


class GraphSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarrystone_graph"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def manifests(path: str) -> list[dict]:
    """The manifests of committed runs, in order: run, order, merged, failed, names."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/commits").type == fs.FileType.NotFound:
        return []
    out = []
    for info in store.get_file_info(fs.FileSelector(f"{root}/commits")):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: m["order"])


def commit(path: str, run: str, body: dict) -> None:
    """Puts a run's manifest in place by one rename."""
    if not NAME.match(run):
        raise ValueError(f"a run's name must be an identifier: {run!r}")
    known = manifests(path)
    order = next((m["order"] for m in known if m["run"] == run), max((m["order"] for m in known), default=0) + 1)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(f"{root}/commits", recursive=True)
    draft = f"{root}/commits/{run}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as f:
        f.write(json.dumps({"run": run, "order": order, **body}).encode())
    store.move(draft, f"{root}/commits/{run}.json")


def write(rows: DataFrame, path: str, run: str, batch: int = BATCH, target: str | None = None) -> None:
    """Writes rows (columns of SCHEMA) as a run."""
    spark = rows.sparkSession
    spark.dataSource.register(GraphSink)
    out = rows.selectExpr(*[f"CAST({c.split(' ')[0]} AS {c.split(' ')[1]}) AS {c.split(' ')[0]}" for c in SCHEMA.split(", ")])
    options = {"path": path, "run": run, "batch": str(batch)} | ({"target": target} if target else {})
    out.write.format("quarrystone_graph").options(**options).mode("append").save()


def _files(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of committed files of a kind, with the order of their run."""
    out = None
    for m in manifests(path):
        names = [f"{path.rstrip('/')}/{n}" for n in m["names"] if n.startswith(f"{kind}/")]
        if names:
            rows = spark.read.schema(schema).parquet(*names).withColumn("run", F.lit(m["run"])).withColumn("run_order", F.lit(m["order"]))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"{schema}, run string, run_order int") if out is None else out


def failed(spark: SparkSession, path: str) -> DataFrame:
    """run, id, label, reason of the rows that committed runs have lost."""
    return _files(spark, path, "failed", FAILED).select("run", "id", "label", "reason")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """id, label, start_id, end_id of the stored elements."""
    rows = _files(spark, path, "rows", SCHEMA)
    return rows.groupBy("id").agg(F.max(F.struct("run_order", "label", "start_id", "end_id")).alias("x")).select("id", "x.label", "x.start_id", "x.end_id")


def graph(spark: SparkSession, path: str) -> DataFrame:
    """id, label, start_id, end_id, properties as all committed runs leave them."""
    rows = _files(spark, path, "rows", SCHEMA)
    values = rows.select("id", "run_order", F.explode("properties").alias("k", "v")).where("v is not null")
    values = values.groupBy("id", "k").agg(F.max(F.struct("run_order", "v")).alias("x"))
    maps = values.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.col("x.v"))))).alias("properties"))
    return elements(spark, path).join(maps, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
