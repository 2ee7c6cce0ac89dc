"""A store of builds: tables that grow by commits, each seen whole or not at all.

Under the root:

    store.json                          the number of buckets, fixed when the store is made
    log/00000000000000000007.json       one file a commit: the build, its parent, and the segments that make up every table
    data/<table>/commit=<id>/bucket=<n> the rows a commit added, by a hash of the table's key columns

A writer puts its rows in segments that no log names yet, and then adds the log file that follows the head it has read. That file can
be made once: of two writers from the same head one wins, the other gets a ``BuildConflict`` and its segments are deleted.
A reader takes the last log file and reads what it names; later commits don't touch that. Rows carry the number of their
commit (``seq``), and of rows with one key the latest counts. A delta reads only the buckets that its keys fall in.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


class BuildConflict(RuntimeError):
    """Another build was committed after the head that this one was made from."""


@dataclass(frozen=True)
class Build:
    """One commit. ``segments`` names the folders of each table, ``schemas`` and ``keys`` say how to read them."""

    version: int
    build_id: str
    parent_build_id: str | None
    built_at: str
    kind: str = "merge"
    added: int = 0
    segments: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)


def workspace(spark: SparkSession) -> str:
    """A new folder of this application under spark.checkpoint.dir, deleted when the driver ends.

    Where the setting is absent a temporary folder serves in local mode; on a cluster that is an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/sextant/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content unless there is one; whole or not at all, and by one writer only.

    On a local or mounted file system by a hard link, elsewhere by a rename that never overwrites.
    """
    p, fs = _path(spark, path)
    fs.mkdirs(p.getParent())
    name = f".{p.getName()}.{uuid.uuid4().hex}"
    if p.toUri().getScheme() == "file":
        here = p.toUri().getPath()
        aside = os.path.join(os.path.dirname(here), name)
        with open(aside, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(aside, here)
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        return True
    return renamed_new(spark, p, name, text)


def renamed_new(spark: SparkSession, p, name: str, text: str) -> bool:
    """``put_new`` by the file system's own rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = p.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), name)
    out = fs.create(aside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(aside, p, how)
    except Exception as e:  # Py4J wraps what Java throws
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(e) or fs.exists(p):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, hidden files left out; none if there is no such folder."""
    p, fs = _path(spark, path)
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []


class Stage:
    """What one writer prepares: segments, and frames that it needs more than once. Nothing of it is seen before the commit."""

    def __init__(self, store: BuildStore, seq: int) -> None:
        self.store, self.seq, self.name = store, seq, uuid.uuid4().hex
        self.segments: dict[str, str] = {}
        self.schemas: dict[str, dict] = {}
        self.keys: dict[str, list[str]] = {}

    def write(self, table: str, rows: DataFrame, *, by: list[str], keys: list[str]) -> DataFrame:
        """Write rows of a table, in buckets of a hash of ``by``, and return them as read back. A commit adds to a table once."""
        where = f"{self.store.root}/data/{table}/commit={self.name}"
        full = rows.withColumns({"seq": F.lit(self.seq).cast("long"), "bucket": self.store.bucket(*by)})
        # Rebalanced, so that a large bucket becomes several files and small ones don't wait for it.
        full.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(where)
        schema = full.drop("bucket").schema
        self.segments[table], self.schemas[table], self.keys[table] = where, schema.jsonValue(), keys
        return self.store.scan(table, [where], schema).select(*rows.columns)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a frame that is gone after the commit, and read it back: what it cost is paid once."""
        where = f"{self.store.root}/aside/{self.name}/{name}"
        rows.write.parquet(where)
        return self.store.spark.read.schema(rows.schema).parquet(where)

    def drop(self, *, segments: bool) -> None:
        for where in [f"{self.store.root}/aside/{self.name}", *(self.segments.values() if segments else [])]:
            p, fs = _path(self.store.spark, where)
            fs.delete(p, True)


class BuildStore:
    """Opens the store at ``root``, or makes it with so many buckets; a store that is there keeps its own number."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        put_new(spark, f"{self.root}/store.json", json.dumps({"buckets": buckets}))
        self.buckets = int(json.loads(read_text(spark, f"{self.root}/store.json"))["buckets"])

    # Reading

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names_in(self.spark, f"{self.root}/log") if n.endswith(".json")]

    def at(self, version: int) -> Build:
        return Build(**json.loads(read_text(self.spark, self._log(version))))

    def head(self) -> Build | None:
        """The last build, if there is one."""
        found = self.versions()
        return self.at(found[-1]) if found else None

    def find(self, build_id: str) -> Build:
        """A build by its id, as its latest commit has it; an error if there is none."""
        for v in reversed(self.versions()):
            if (b := self.at(v)).build_id == build_id:
                return b
        raise FileNotFoundError(f"no build {build_id}")

    def chain(self, build_id: str | None = None) -> list[Build]:
        """A build (or the head) and its ancestors, the oldest first; an error if one is missing."""
        found: dict[str, Build] = {}
        for v in self.versions():
            b = self.at(v)
            found.setdefault(b.build_id, b)
        if build_id is None:
            head = self.head()
            build_id = head.build_id if head else None
        out: list[Build] = []
        while build_id is not None:
            if build_id not in found:
                raise FileNotFoundError(f"no build {build_id}")
            out.append(found[build_id])
            build_id = out[-1].parent_build_id
        return out[::-1]

    def bucket(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, *columns: str | Column) -> list[int]:
        """The buckets that rows fall in: at most as many numbers as the store has buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(*columns).alias("b")).distinct().collect())

    def scan(self, table: str, segments: list[str], schema: StructType) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        full = StructType(list(schema)).add("commit", "string").add("bucket", "integer")
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data/{table}").parquet(*segments).drop("commit")

    def rows(self, build: Build | None, table: str, schema: str, *, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows that a build has of a table, with ``seq``; of some buckets only if given. ``schema`` is what an absent table has."""
        if build is None or table not in build.segments:
            return self.spark.createDataFrame([], schema + ", seq long")
        found = self.scan(table, build.segments[table], StructType.fromJson(build.schemas[table]))
        return (found if buckets is None else found.where(F.col("bucket").isin([*buckets]))).drop("bucket")

    def latest(self, build: Build | None, table: str, schema: str, *, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows that count: of those with one key the latest."""
        found = self.rows(build, table, schema, buckets=buckets)
        if build is None or table not in build.segments:
            return found.drop("seq")
        newest = Window.partitionBy(*build.keys[table]).orderBy(F.desc("seq"))
        return found.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "seq")

    # Writing

    def stage(self, head: Build | None) -> Stage:
        return Stage(self, head.version + 1 if head else 0)

    def commit(self, head: Build | None, stage: Stage, build_id: str, *, kind: str = "merge", added: int = 0, replace: bool = False) -> Build:
        """Add the build that follows ``head``, or raise ``BuildConflict`` and delete the stage's segments if another one does.

        With ``replace`` the stage's segments stand for those that their tables had.
        """
        old = head or Build(-1, "", None, "")
        segments = {t: [*([] if replace else old.segments.get(t, [])), s] for t, s in stage.segments.items()}
        parent = old.parent_build_id if kind != "merge" else head.build_id if head else None
        made = Build(old.version + 1, build_id, parent, datetime.now(UTC).isoformat(timespec="microseconds"), kind, added, old.segments | segments, old.schemas | stage.schemas, old.keys | stage.keys)
        won = self.versions()[-1:] == ([old.version] if head else []) and put_new(self.spark, self._log(made.version), json.dumps(asdict(made)))
        stage.drop(segments=not won)
        if not won:
            raise BuildConflict(f"version {made.version} of {self.root} is another build")
        return made

    def compact(self) -> Build | None:
        """One segment a table with the rows that count; the build stays the same one. Readers of older commits keep their files."""
        head = self.head()
        if head is None or all(len(s) < 2 for s in head.segments.values()):
            return head
        stage = self.stage(head)
        for t, found in head.segments.items():
            schema = StructType.fromJson(head.schemas[t])
            own = self.scan(t, found, schema)
            newest = Window.partitionBy(*head.keys[t]).orderBy(F.desc("seq"))
            kept = own.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
            where = f"{self.root}/data/{t}/commit={stage.name}"
            kept.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(where)
            stage.segments[t], stage.schemas[t], stage.keys[t] = where, schema.jsonValue(), head.keys[t]
        return self.commit(head, stage, head.build_id, kind="compact", replace=True)

    def vacuum(self, *, older_than_s: float = 86_400, keep: int | None = None) -> int:
        """Delete segments that no commit names (of writers that died or lost), not touched for so long; how many went.

        With ``keep`` only the last so many commits are kept, and what only older ones name goes too.
        """
        versions = self.versions()
        kept = versions if keep is None else versions[-max(1, keep):]
        named = {os.path.basename(s) for v in kept for found in self.at(v).segments.values() for s in found}
        limit, gone = (time.time() - older_than_s) * 1_000, 0
        for v in versions[: len(versions) - len(kept)]:
            p, fs = _path(self.spark, self._log(v))
            fs.delete(p, False)
        folders = [f"{self.root}/data/{t}/{c}" for t in names_in(self.spark, f"{self.root}/data") for c in names_in(self.spark, f"{self.root}/data/{t}") if c not in named]
        folders += [f"{self.root}/aside/{a}" for a in names_in(self.spark, f"{self.root}/aside")]
        for where in folders:
            p, fs = _path(self.spark, where)
            if fs.getFileStatus(p).getModificationTime() <= limit:
                gone += bool(fs.delete(p, True))
        return gone

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"
