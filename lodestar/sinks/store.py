"""The stored hierarchy: runs of Parquet, and manifests that say which runs stand.

Each commit writes a run of its own, sorted by depth and path, with a bloom filter of paths, so that a node is found in a few row groups; then a manifest, a small
file with the next number, that lists all runs that stand. A frame read from the store has the files of one manifest. What later commits replace stays on disk until
`vacuum` removes it, so such a frame reads on while batches are replayed and runs compacted. Two writers can't commit the same number: the second one fails.

Points never move once accepted, so a batch only adds rows. A batch that is written again gets a new run in the place of the old one. `replace` gives a node a new set of points, or
none: rows of a node that are older than its last replacement don't count, and compaction leaves them out. Compaction writes the rows of all batches but the last into one
run, the base; the last one may yet be replayed. Each run carries its counts by node, so the nodes of the whole store are sums over these and no points are read."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import CUBE_COLUMNS, POINT
from ..operators.lod import ACCEPTED, DROPPED, MAX_DEPTH, Lod
from ..storage import beside, hadoop, local_rows, materialize, small

COMMIT = "batch_id long, points long, accepted long, dropped long, nodes long, new_nodes long, written timestamp, last_seq long"
PROGRESS = "batch_id long, points long, elapsed_ms long, points_per_second double"
COUNTS = "path string, depth int, mx double, my double, mz double, sz double, n long"
_SCHEMAS = {"accepted": f"{ACCEPTED}, version long", "dropped": DROPPED, "counts": COUNTS, "replaced": "path string, version long", "recent": POINT}
#: Rows of a file, bytes of a row group, and rows of a page, of which an index knows the least and the largest path.
FILE_ROWS, GROUP_BYTES, PAGE_ROWS = 1 << 21, 8 << 20, 1 << 12


@dataclass(frozen=True)
class Run:
    """A commit's rows: the batch (of a base, the last one in it; of a replacement, None), the number of its manifest, and what is known of it."""

    name: str
    version: int
    kind: str
    batch: int | None = None
    last_seq: int | None = None
    apart: bool = True
    replaces: bool = False
    #: Whether nodes of this run were replaced, also if compaction folded that in.
    edited: bool = False


@dataclass(frozen=True)
class Manifest:
    version: int
    runs: tuple[Run, ...]
    #: Folders that no longer stand, and when that was, in seconds.
    retired: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder.rstrip("/"), *parts])

    def _names(self, kind: str) -> list[str]:
        filesystem, place = hadoop(self.spark, self._path(kind))
        return sorted(f.getPath().getName() for f in filesystem.listStatus(place)) if filesystem.exists(place) else []

    def _put(self, text: str, *parts: str, once: bool = False) -> None:
        """A small file, there as a whole or not at all."""
        filesystem, place = hadoop(self.spark, self._path(*parts))
        _, draft = hadoop(self.spark, self._path("drafts", uuid.uuid4().hex))
        out = filesystem.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        filesystem.mkdirs(place.getParent())
        if not once:
            filesystem.delete(place, False)
        if filesystem.exists(place) or not filesystem.rename(draft, place):
            filesystem.delete(draft, False)
            raise FileExistsError(f"{place} was committed by another writer")

    def _get(self, *parts: str) -> str:
        filesystem, place = hadoop(self.spark, self._path(*parts))
        stream = filesystem.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The latest one."""
        names = self._names("manifests")
        if not names:
            return Manifest(0, ())
        found = json.loads(self._get("manifests", names[-1]))
        return Manifest(found["version"], tuple(Run(**r) for r in found["runs"]), tuple(map(tuple, found["retired"])))

    def _commit(self, before: Manifest, runs: list[Run]) -> Manifest:
        """Runs that stand from now on; those of the manifest before that are not among them are retired."""
        gone = [r.name for r in before.runs if r.name not in {n.name for n in runs}]
        after = Manifest(before.version + 1, tuple(runs), (*before.retired, *((n, time.time()) for n in gone)))
        text = json.dumps({"version": after.version, "runs": [r.__dict__ for r in after.runs], "retired": after.retired})
        self._put(text, "manifests", f"{after.version:012d}.json", once=True)
        return after

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Remove what was retired more than so many seconds ago; frames read before that lose their files then."""
        before, limit = self.manifest(), time.time() - older_than
        gone = [n for n, at in before.retired if at <= limit]
        if gone:
            kept = tuple(x for x in before.retired if x[0] not in gone)
            self._commit(Manifest(before.version, before.runs, kept), list(before.runs))
        for name in gone:
            filesystem, place = hadoop(self.spark, self._path("runs", name))
            filesystem.delete(place, True)
        for name in self._names("manifests")[:-1]:
            filesystem, place = hadoop(self.spark, self._path("manifests", name))
            if place.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime() / 1000 <= limit:
                filesystem.delete(place, False)
        return gone

    def _runs(self, before: int | None = None, manifest: Manifest | None = None) -> list[Run]:
        runs = (manifest or self.manifest()).runs
        return [r for r in runs if before is None or r.batch is None or r.batch < before]

    def _read(self, kind: str, runs: list[Run]) -> DataFrame:
        if not runs:
            return local_rows(self.spark, [], _SCHEMAS[kind])
        return self.spark.read.schema(_SCHEMAS[kind]).parquet(*(self._path("runs", r.name, kind) for r in runs))

    def batches(self) -> list[int]:
        """Committed ones, in order."""
        known = {r.batch for r in self._runs() if r.kind == "batch"}
        base = self.base()
        return sorted(b for b in (int(n.removesuffix(".json")) for n in self._names("commits")) if b in known or (base is not None and b <= base))

    def commits(self) -> DataFrame:
        """A row for each committed batch."""
        if not self._names("commits"):
            return local_rows(self.spark, [], COMMIT)
        last = max((r.batch for r in self._runs() if r.batch is not None), default=-1)
        return self.spark.read.schema(COMMIT).json(self._path("commits")).where(F.col("batch_id") <= last)

    def base(self, before: int | None = None) -> int | None:
        """The last batch that is part of the base."""
        return max((r.batch for r in self._runs(before) if r.kind == "base"), default=None)

    def batches_before(self, batch: int) -> bool:
        """Whether anything was committed before a batch."""
        return bool(self._runs(batch))

    def batches_since_base(self) -> list[int]:
        return sorted(r.batch for r in self._runs() if r.kind == "batch")

    def _current(self, runs: list[Run]) -> DataFrame:
        """The rows of runs that no later replacement of their node hides."""
        rows, replaced = self._read("accepted", runs).where("depth >= 0"), [r for r in runs if r.replaces]
        if not replaced:
            return rows
        last = self._read("replaced", replaced).groupBy("path").agg(F.max("version").alias("since"))
        last = small(materialize(last), 160)
        return rows.join(last, "path", "left").where(F.col("since").isNull() | (F.col("version") >= F.col("since"))).select(*rows.columns)

    def accepted(self, before: int | None = None) -> DataFrame:
        """Of the committed batches, or of those before a batch. Filters on depth and path read the row groups that may have such rows."""
        return self._current(self._runs(before)).drop("version")

    def dropped(self) -> DataFrame:
        return self._dropped(self._runs())

    def _dropped(self, runs: list[Run]) -> DataFrame:
        """Points that no level took lie among the others, at depth -1; those outside the world have no node."""
        lost = self._read("accepted", runs).where("depth < 0").select("seq", F.lit(MAX_DEPTH).alias("reason"), "path")
        return self._read("dropped", [r for r in runs if r.kind != "replacement"]).unionByName(lost)

    def node_counts(self, since: int | None = None) -> DataFrame:
        """COUNTS of each node with points, or of the batches after one: sums over what commits added."""
        runs = self._runs()
        runs = runs if since is None else [r for r in runs if r.batch is None or r.batch > since]
        return self._read("counts", runs).groupBy("path", "depth", *CUBE_COLUMNS).agg(F.sum("n").alias("n")).where("n > 0")

    def last_seq(self, before: int) -> int | None:
        """The largest seq of the batches before one."""
        return max((r.last_seq for r in self._runs(before) if r.last_seq is not None), default=None)

    def apart(self, before: int | None = None) -> bool:
        """Whether all cells of the stored points are parts of those above."""
        return all(r.apart for r in self._runs(before))

    def edited(self, before: int | None = None) -> bool:
        """Whether any node was ever replaced."""
        return any(r.edited for r in self._runs(before))

    def node_points(self, path: str, before: int | None = None) -> DataFrame:
        """A node's points in order of arrival; an unknown path has none."""
        return self.accepted(before).where((F.col("depth") == len(path)) & (F.col("path") == path)).orderBy("seq")

    def recent(self, before: int | None = None) -> DataFrame:
        runs = [r for r in self._runs(before) if r.batch is not None]
        return self._read("recent", sorted(runs, key=lambda r: r.batch)[-1:])

    def _write_sorted(self, rows: DataFrame, name: str, files: int | None = None, mode: str = "errorifexists") -> None:
        """Rows of a run by depth and path. With a number of files, each is a range of these, so a level or a node with most rows has many tasks; without, rows stay in their
        tasks, which hold whole cells of the root, and are sorted there."""
        ranged = rows if files is None else rows.repartitionByRange(files, "depth", "path", "seq")
        options = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.bloom.filter.enabled#path": "true", "parquet.bloom.filter.expected.ndv#path": 1 << 14}
        ranged.sortWithinPartitions("depth", "path", "seq").write.mode(mode).options(**options).parquet(self._path("runs", name, "accepted"))

    def _files(self, n: int) -> int:
        return max(1, -(-n // FILE_ROWS), min(n >> 16, self.spark.sparkContext.defaultParallelism))

    def _count(self, name: str, kind: str) -> int:
        return self.spark.read.schema(_SCHEMAS[kind]).parquet(self._path("runs", name, kind)).count()

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("path", "depth", *CUBE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))

    def last_batch(self) -> int | None:
        return max((r.batch for r in self._runs() if r.batch is not None), default=None)

    def put_pending(self, points: DataFrame, batch: int) -> dict[int, int]:
        """Points that wait for a commit, in the place of those of the same batch; returns how many wait, by batch. The small file that names them is written last."""
        name = f"{batch}-{uuid.uuid4().hex}"
        points.write.option("compression", "zstd").parquet(self._path("pending", "rows", name))
        rows = self.spark.read.schema(POINT).parquet(self._path("pending", "rows", name))
        n, last = rows.agg(F.count(F.lit(1)), F.max("seq")).first()
        self._put(json.dumps({"name": name, "points": n, "last_seq": last}), "pending", "batches", f"{batch:012d}.json")
        return {b: p["points"] for b, p in self.pending().items()}

    def pending(self) -> dict[int, dict]:
        """What waits, by batch; what a commit holds already doesn't."""
        last = self.last_batch()
        found = {int(n.removesuffix(".json")): n for n in self._names("pending/batches")}
        return {b: json.loads(self._get("pending", "batches", n)) for b, n in found.items() if last is None or b > last}

    def pending_seq(self, before: int) -> int | None:
        return max((p["last_seq"] for b, p in self.pending().items() if b < before and p["last_seq"] is not None), default=None)

    def pending_points(self) -> DataFrame:
        folders = [self._path("pending", "rows", p["name"]) for p in self.pending().values()]
        return self.spark.read.schema(POINT).parquet(*folders) if folders else local_rows(self.spark, [], POINT)

    def drop_pending(self, through: int) -> None:
        """Remove what waited for batches up to one."""
        for kind in ("batches", "rows"):
            for name in self._names(f"pending/{kind}"):
                if int(name.removesuffix(".json").split("-")[0]) <= through:
                    filesystem, place = hadoop(self.spark, self._path("pending", kind, name))
                    filesystem.delete(place, True)

    def put_progress(self, row: dict) -> None:
        self._put(json.dumps(row), "progress", f"{row['batch_id']:012d}.json")

    def progress(self) -> DataFrame:
        """What a ProgressLog wrote."""
        return self.spark.read.schema(PROGRESS).json(self._path("progress")) if self._names("progress") else local_rows(self.spark, [], PROGRESS)

    def draft(self, batch: int) -> Draft:
        before = self.manifest()
        return Draft(self, before, Run(f"{batch}-{uuid.uuid4().hex}", before.version + 1, "batch", batch))

    def replace(self, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """Each node that rows (ACCEPTED) or removed (path) name has these rows from now on, and no others; other nodes stay as they are."""
        before = self.manifest()
        run = Run(f"r-{uuid.uuid4().hex}", before.version + 1, "replacement", replaces=True, edited=True)
        at = lambda kind: self._path("runs", run.name, kind)
        rows = materialize(rows.select(*(c.split()[0] for c in ACCEPTED.split(", "))))
        names = rows.select("path") if removed is None else rows.select("path").union(removed.select("path"))
        names = materialize(names.distinct())
        named = small(names, 160)
        # what the nodes had, taken away
        had = self.node_counts().join(named, "path", "left_semi").withColumn("n", -F.col("n"))
        names.withColumn("version", F.lit(run.version).cast("long")).write.parquet(at("replaced"))
        had.unionByName(self._counted(rows)).write.parquet(at("counts"))
        self._write_sorted(rows.withColumn("version", F.lit(run.version).cast("long")), run.name, self._files(rows.count()))
        self._commit(before, [*before.runs, run])

    def compact(self) -> None:
        """A base of all runs but the last batch and what came after it. What it stands for is retired."""
        before = self.manifest()
        since = self.batches_since_base()[:-1]
        last_kept = [r for r in before.runs if r.kind == "batch" and r.batch not in since]
        end = min((r.version for r in last_kept), default=before.version + 1)
        folded = [r for r in before.runs if r.version < end and r not in last_kept]
        if len(folded) < 2 and not any(r.kind == "batch" for r in folded):
            return
        stay = [r for r in before.runs if r not in folded]
        known = [r.batch for r in folded if r.batch is not None]
        seqs = [r.last_seq for r in folded if r.last_seq is not None]
        run = Run(f"base-{uuid.uuid4().hex}", max(r.version for r in folded), "base", max(known, default=None), max(seqs, default=None), all(r.apart for r in folded), edited=any(r.edited for r in folded))
        at = lambda kind: self._path("runs", run.name, kind)
        rows = self._current(folded)
        # rows that stay may be older than nodes that a replacement after the base hides, so they keep their versions
        counts = self._read("counts", folded).groupBy("path", "depth", *CUBE_COLUMNS).agg(F.sum("n").alias("n")).where("n <> 0")
        counts = materialize(counts)
        self._write_sorted(rows, run.name, self._files(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        counts.write.option("compression", "zstd").parquet(at("counts"))
        self._dropped(folded).write.option("compression", "zstd").parquet(at("dropped"))
        self._read("recent", sorted((r for r in folded if r.batch is not None), key=lambda r: r.batch)[-1:]).write.parquet(at("recent"))
        self._commit(before, [run, *stay])


@dataclass
class Draft:
    """A batch's run while it is written; `commit` makes it stand."""

    store: Store
    before: Manifest
    run: Run
    _settled: DataFrame | None = None

    def put(self, kind: str, rows: DataFrame) -> int:
        rows.write.option("compression", "zstd").parquet(self.store._path("runs", self.run.name, kind))
        return self.store._count(self.run.name, kind)

    def settled(self, rows: DataFrame) -> DataFrame:
        """Settled points, written where they stay if they are what is committed."""
        self.store._write_sorted(rows.withColumn("version", F.lit(self.run.version).cast("long")), self.run.name, mode="overwrite")
        self._settled = self.store.spark.read.schema(rows.schema).parquet(self.store._path("runs", self.run.name, "accepted"))
        return self._settled

    def commit(self, lod: Lod, points: int, last_seq: int | None = None) -> None:
        """Write what isn't there yet, side by side, then the manifest. points: how many the batch has."""
        written = self._settled is not None and lod.settled is self._settled
        if not written:
            self.store._write_sorted(lod.accepted.withColumn("version", F.lit(self.run.version).cast("long")), self.run.name, mode="overwrite")
        lost = beside.submit(self.put, "dropped", lod.dropped.where(F.col("reason") != MAX_DEPTH) if written else lod.dropped)
        rows = self.store.spark.read.schema(ACCEPTED).parquet(self.store._path("runs", self.run.name, "accepted")).where("depth >= 0")
        nodes = self.put("counts", self.store._counted(rows))
        lost.result()
        # the nodes that had no points before this batch
        known = [r for r in self.before.runs if r.batch is None or r.batch < self.run.batch]
        mine = self.store._read("counts", [self.run]).where("depth > 0").select("path")
        new = mine.join(self.store._read("counts", known).groupBy("path").agg(F.sum("n").alias("n")).where("n > 0"), "path", "left_anti").count() if known else mine.count()
        kept = self.store._read("counts", [self.run]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        batch, written_at = self.run.batch, time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
        row = {"batch_id": batch, "points": points, "accepted": kept, "dropped": points - kept, "nodes": nodes, "new_nodes": new, "written": f"{written_at}.{time.time_ns() // 1000 % 1_000_000:06d}Z", "last_seq": last_seq}
        self.store._put(json.dumps(row), "commits", f"{batch:012d}.json")
        run = replace(self.run, last_seq=last_seq, apart=lod.apart)
        self.store._commit(self.before, [*(r for r in self.before.runs if not (r.kind == "batch" and r.batch == batch)), run])
