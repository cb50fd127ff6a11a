"""Posting tables with snapshots: sorted runs of changes over a base, merged when read.

PATH/data/gen=G/term_bucket=B holds the rows (term, did, wdf) of one run in one
bucket of terms, sorted; a null wdf takes a posting away.  PATH/snapshots/V is the
table of version V: the number of buckets, which runs each bucket has, in which
order they count, and how far every stream of changes has come.  A commit writes
the next snapshot beside the table and renames it into place, which only one of
two writers can do (compare and swap); the other sees what it has missed and
tries again on top of it.  Readers hold on to a snapshot and are never disturbed.

A change set writes one run with its own rows and nothing else.  Runs are merged
by levels: ``FAN`` runs of a level become one of the next, and the last level is
the base, from which what was taken away is gone.  Bytes are range-partitioned by
(bucket, term, did), so that a list that is most of the table is many files.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest
from .shared import shuffles_freed

TERM_BUCKETS = 64
FAN = 4  # runs of a level that become one of the next
LEVELS = 3  # of runs above the base
SHARE = 4  # runs of this part of the base's rows are merged into it
KEPT_APART = 1 << 18  # rows of runs up to which a read sends them to all tasks
HELD = 1 << 19  # rows of runs up to which a task of a read holds them
TRIES = 20

ROWS = "term string, did long, wdf long, gen string, term_bucket int"
SNAPSHOT = "kind string, buckets int, bucket int, gen string, level int, at long, rows long, stream string, batch long"


class Conflict(Exception):
    """Somebody else has changed what this writer had read."""


@dataclass(frozen=True)
class Run:
    """Rows of one generation in one bucket; of two runs the one with the larger `at` counts. Level 0 is the base."""

    bucket: int
    gen: str
    level: int
    at: int
    rows: int


@dataclass(frozen=True)
class Snapshot:
    version: int
    buckets: int
    runs: frozenset[Run] = frozenset()
    streams: dict[str, int] = field(default_factory=dict)


# ---- files of the table


class _Files:
    """What the shared file system of a path can do, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, "/".join(parts))

    def names(self, *parts: str) -> list[str]:
        place = self.at(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def claim(self, staged: tuple[str, ...], final: tuple[str, ...]) -> bool:
        """Rename, unless the name is taken."""
        self.fs.mkdirs(self.at(*final[:-1]))
        target = self.at(*final)
        if self.fs.exists(target):
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(self.at(*staged), target, none)
        except Exception:
            if self.fs.exists(target):  # another writer was first
                return False
            raise
        inside = (*final, staged[-1])  # a local file system moves a folder into one that has just come up
        if self.fs.exists(self.at(*inside)):
            self.delete(*inside)
            return False
        return True


def _name(version: int) -> str:
    return f"{version:020d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that can be read, oldest first."""
    return sorted(int(n) for n in _Files(spark, path).names("snapshots") if n.isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The table as of a version, by default the last; version 0 is no table."""
    known = versions(spark, path)
    version = version if version is not None else max(known, default=0)
    if version == 0:
        return Snapshot(0, 0)
    if version not in known:
        raise ValueError(f"no version {version} of {path}")
    rows = spark.read.schema(SNAPSHOT).json(f"{path}/snapshots/{_name(version)}").collect()  # a row a run
    buckets = next(r.buckets for r in rows if r.kind == "table")
    runs = frozenset(Run(r.bucket, r.gen, r.level, r.at, r.rows) for r in rows if r.kind == "run")
    return Snapshot(version, buckets, runs, {r.stream: r.batch for r in rows if r.kind == "stream"})


def _swap(spark: SparkSession, path: str, new: Snapshot) -> bool:
    """Make this the next snapshot, unless another one is."""
    rows = [("table", new.buckets, None, None, None, None, None, None, None)]
    rows += [("run", None, r.bucket, r.gen, r.level, r.at, r.rows, None, None) for r in sorted(new.runs, key=lambda r: (r.bucket, r.at))]
    rows += [("stream", None, None, None, None, None, None, name, batch) for name, batch in sorted(new.streams.items())]
    staged = ("staging", uuid4().hex)
    spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.json(f"{path}/{'/'.join(staged)}")
    files = _Files(spark, path)
    if files.claim(staged, ("snapshots", _name(new.version))):
        return True
    files.delete(*staged)
    return False


# ---- rows of runs


def bucket_of(buckets: int):
    return F.pmod(F.hash("term"), F.lit(buckets))


PLACE = ["term_bucket", "term", "did"]


def _write(rows: DataFrame, path: str, buckets: int, once: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, dict[int, int]]:
    """Write rows(term, did, wdf) as one generation; its name and the rows in each bucket.

    Rows that have a posting several times become one by `once`, which groups by PLACE: the range partitions
    have all rows of a posting together, so that nothing else is exchanged.
    """
    spark, gen = rows.sparkSession, uuid4().hex
    dealt = rows.withColumn("term_bucket", bucket_of(buckets).cast("int")).repartitionByRange(*PLACE)
    one = (once(dealt) if once else dealt).select("term", "did", "wdf", "term_bucket")
    with shuffles_freed(spark):
        one.sortWithinPartitions(*PLACE).write.partitionBy("term_bucket").parquet(f"{path}/data/gen={gen}")
    written = _rows(spark, path, [gen]).groupBy("term_bucket").agg(F.count("*").alias("n")).collect()  # at most a row a bucket
    return gen, {r.term_bucket: r.n for r in written}


def _rows(spark: SparkSession, path: str, gens: Iterable[str]) -> DataFrame:
    places = [f"{path}/data/gen={g}" for g in sorted(set(gens))]
    if not places:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).option("basePath", f"{path}/data").parquet(*places)


def _rows_of(spark: SparkSession, path: str, runs: Iterable[Run]) -> DataFrame:
    """term, did, wdf, at of some runs: partitions are pruned, filters and columns reach the files."""
    some, by_gen = list(runs), defaultdict(list)
    for r in some:
        by_gen[r.gen, r.at].append(r.bucket)
    keep, at = F.lit(False), F.lit(None).cast("long")
    for (gen, order), buckets in sorted(by_gen.items()):
        here = (F.col("gen") == gen) & F.col("term_bucket").isin(*sorted(buckets))
        keep, at = keep | here, F.when(here, F.lit(order).cast("long")).otherwise(at)
    return _rows(spark, path, [r.gen for r in some]).where(keep).select("term", "did", "wdf", at.alias("at"))


def _last(rows: DataFrame) -> DataFrame:
    """Of the rows of each posting the one that counts, what is taken away included."""
    return rows.groupBy("term", "did").agg(F.max_by("wdf", "at").alias("wdf"))  # a run has a posting once, so no two are equal


def _current(spark: SparkSession, path: str, runs: Iterable[Run], wanted: tuple[str, ...]) -> DataFrame:
    """Postings of whole buckets: the base without what runs name, and what they say."""

    def of(some: list[Run]) -> DataFrame:
        rows = _rows_of(spark, path, some)
        return rows.where(F.col("term").isin(*wanted)) if wanted else rows

    runs = list(runs)
    base, above = [r for r in runs if r.level == 0], [r for r in runs if r.level]
    if not above:
        return of(base).select("term", "did", "wdf")
    touched = {r.bucket for r in above}
    changed, rows = _last(of(above)), sum(r.rows for r in above)
    whole = of([r for r in base if r.bucket not in touched]).select("term", "did", "wdf")
    below = of([r for r in base if r.bucket in touched]).select("term", "did", "wdf")
    if rows <= KEPT_APART:
        kept = below.join(F.broadcast(changed.select("term", "did")), ["term", "did"], "left_anti")
        return whole.unionByName(kept).unionByName(changed.where("wdf is not null"))
    # runs are read once, and no join may change its mind: their rows pack so well that they would be taken for few, and come to the driver
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = changed.select("term", "did", F.col("wdf").alias("_new"), F.lit(True).alias("_said")).hint("shuffle_hash" if rows <= tasks * HELD else "merge")
    wdf = F.when(F.col("_said"), F.col("_new")).otherwise(F.col("wdf")).alias("wdf")
    return whole.unionByName(below.join(said, ["term", "did"], "full_outer").select("term", "did", wdf).where("wdf is not null"))


# ---- the table


def create(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS, parts: bool = False) -> int:
    """Write postings(term, did, wdf) as the next version of a table, whatever it held before; the wdf of `parts` are added up."""
    spark = postings.sparkSession
    added = (lambda rows: rows.groupBy(*PLACE).agg(F.sum("wdf").alias("wdf"))) if parts else None
    gen, rows = _write(postings.select("term", "did", "wdf"), path, buckets, added)
    for _ in range(TRIES):
        old = snapshot(spark, path)
        version = old.version + 1
        runs = frozenset(Run(b, gen, 0, version, n) for b, n in rows.items())
        if _swap(spark, path, Snapshot(version, buckets, runs, old.streams)):
            return version
    raise Conflict(f"{path} changes too often")


def read(spark: SparkSession, path: str, *wanted: str, version: int | None = None) -> DataFrame:
    """Postings, of some terms if named, as of a version."""
    table = snapshot(spark, path, version)
    if not table.version:
        raise ValueError(f"no table at {path}")
    runs = table.runs
    if wanted:
        asked = spark.createDataFrame([(t,) for t in wanted], "term string").select(bucket_of(table.buckets).alias("b"))
        places = {r.b for r in asked.collect()}
        runs = [r for r in runs if r.bucket in places]
    return _current(spark, path, runs, wanted)


def merge(spark: SparkSession, path: str, changes: DataFrame, order: list[str] | None = None, expected: int | None = None, stream: tuple[str, int] | None = None) -> int:
    """Add changes(term, did, new_wdf; null takes away) as a run; the version that has it.

    Of several changes of a posting the last by the columns `order` counts; without
    them more than one is an error.  Whoever has read version `expected` gets
    Conflict if a bucket that the changes touch is newer.  A batch of a stream
    that the table already has is left out.
    """
    table = snapshot(spark, path)
    if not table.version:
        raise ValueError(f"no table at {path}")
    if stream and table.streams.get(stream[0], -1) >= stream[1]:
        return table.version
    some = changes.where("term is not null and did is not null").select("term", "did", "new_wdf", *[c for c in order or [] if c not in ("term", "did", "new_wdf")])
    gen, rows = _write(some, path, table.buckets, lambda rows: latest(rows, PLACE, "new_wdf", order).withColumnRenamed("new_wdf", "wdf"))
    if not rows and not stream:
        return table.version
    for _ in range(TRIES):
        table, buckets = snapshot(spark, path), table.buckets
        if stream and table.streams.get(stream[0], -1) >= stream[1]:
            return table.version
        if table.buckets != buckets:  # replaced by one of another shape
            return merge(spark, path, changes, order, expected, stream)
        if expected is not None and any(r.at > expected for r in table.runs if r.bucket in rows):
            raise Conflict(f"{path} has changed since version {expected}")
        version = table.version + 1
        runs = table.runs | {Run(b, gen, 1, version, n) for b, n in rows.items()}
        streams = table.streams | ({stream[0]: stream[1]} if stream else {})
        if _swap(spark, path, replace(table, version=version, runs=frozenset(runs), streams=streams)):
            return version
    raise Conflict(f"{path} changes too often")


def due(runs: list[Run], fan: int = FAN) -> list[Run]:
    """Runs of one bucket to be merged now: the newest levels that are full, with the base if they have grown large."""
    taken: list[Run] = []
    for level in range(1, LEVELS + 1):
        here = [r for r in runs if r.level == level]
        if len(here) + bool(taken) < fan:
            break
        taken += here
    base = [r for r in runs if r.level == 0]
    if taken and len(taken) == len(runs) - len(base) and (max(r.level for r in taken) == LEVELS or sum(r.rows for r in taken) * SHARE >= sum(r.rows for r in base)):
        taken += base
    return taken


def compact(spark: SparkSession, path: str, fan: int = FAN, whole: bool = False) -> int:
    """Merge the runs that are due, or (whole) all runs into the base; the version after it."""
    for _ in range(TRIES):
        table = snapshot(spark, path)
        buckets = defaultdict(list)
        for r in table.runs:
            buckets[r.bucket].append(r)
        plan = {b: ([*runs] if any(r.level for r in runs) else []) if whole else due(runs, fan) for b, runs in buckets.items()}
        plan = {b: runs for b, runs in plan.items() if runs}
        if not plan:
            return table.version
        # what nothing lies below is the base, and forgets what was taken away
        bottom = {b for b, runs in plan.items() if not (set(buckets[b]) - set(runs))}
        into_base = _current(spark, path, [r for b in bottom for r in plan[b]], ())
        others = _last(_rows_of(spark, path, [r for b in plan.keys() - bottom for r in plan[b]]))
        gen, rows = _write(into_base.unionByName(others), path, table.buckets)
        gone = {r for runs in plan.values() for r in runs}
        new = {Run(b, gen, 0 if b in bottom else max(r.level for r in plan[b]) + 1, max(r.at for r in plan[b]), n) for b, n in rows.items()}
        while gone <= table.runs:  # later change sets don't matter to it
            version = table.version + 1
            if _swap(spark, path, replace(table, version=version, runs=table.runs - gone | new)):
                return version
            table = snapshot(spark, path)
    raise Conflict(f"{path} changes too often")


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all but the last `keep` versions, and the generations that only those had; their names."""
    known = versions(spark, path)
    old, new = known[:-keep], known[-keep:]
    gens = [{r.gen for v in some for r in snapshot(spark, path, v).runs} for some in (old, new)]
    files, gone = _Files(spark, path), sorted(gens[0] - gens[1])
    for v in old:
        files.delete("snapshots", _name(v))
    for gen in gone:
        files.delete("data", f"gen={gen}")
    return gone
