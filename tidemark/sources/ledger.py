"""The store: an append-only ledger of operations in Parquet, and claims as small manifest files.

Nothing is changed in place.  Each append is one directory with a number of its own; it counts from the moment its commit
marker is there, and the marker's name says below which window its rows were moved forward.  A claim is the next file of a
log: it names the batches it saw and up to which window it takes their rows, so what lands later, whatever its number, is
not taken for shipped.  A row belongs to the first claim that covers it, and is live if none does.  A second file settles a
claim: acknowledged for good, or released, and its rows are live again; since cells are folded from rows, they merge with
what has come since.  Every file that decides anything is created only if absent, whole, so of two processes one wins.
A claim of a level also points to what every series holds at its end; later reads start from there, not from all history.
Files go through Hadoop's API, so the path may be in any store that Spark knows and whose renames do not overwrite.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import landing_col
from tidemark.operators.base import Bucketed, Metric
from tidemark.operators.event import Event
from tidemark.operators.level import Level

RECOVER_AFTER = 300_000
ACKED, RELEASED = "acked", "released"


@dataclass(frozen=True)
class Claim:
    id: str
    metric: str
    order: int
    up_to: int | None  # windows below it; None for records
    batches: list[list[int]]  # ranges of the batches that it saw
    claimed_at: int
    attempt: int = 1
    ahead_from: int | None = None  # also windows from it on
    cut: list[int] | None = None  # records up to this batch, arrival and place
    floor: int = 0  # windows below it are closed
    floors: dict[str, int] = field(default_factory=dict)  # batches whose rows move up to a later window than they say
    base: str | None = None  # what a level's series hold at the end

    def has(self, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi in self.batches)


def _ranges(numbers: Iterable[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


class Files:
    """The few file operations that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        found = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Write a file that no one sees before it is whole; False if there is one already."""
        if self.exists(name):
            return False
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/_{last}.{uuid.uuid4().hex}"
        if self.local:  # a link never replaces a file, while a rename would
            at, to = (self.jvm.java.net.URI(self.path(n).toUri().toString()).getPath() for n in (draft, name))
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w") as f:
                json.dump(value, f)
            try:
                os.link(at, to)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(at)
        stream = self.fs.create(self.path(draft), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if self.fs.rename(self.path(draft), self.path(name)):
            return True
        self.delete(draft)
        return False

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


class Store(Protocol):
    """All that a house asks of a store; any class with these can take the ledger's place.

    ``claimed_cells`` and ``claimed_records`` give what a claim has taken; ``level_cells`` the written windows of a level
    that have not shipped, and of each series the last one that has.
    """

    durable: bool
    shared: bool

    def append(self, metric: Metric, rows: DataFrame, key: str | None = None) -> int: ...
    def read_buckets(self, metric: Bucketed, start: int | None = None, end: int | None = None, dim_key: str | None = None) -> DataFrame | None: ...
    def read_pending(self, metric: Event, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame | None: ...
    def count_pending(self, metric: Metric) -> int: ...
    def level_cells(self, metric: Level) -> DataFrame | None: ...
    def floor(self, metric: Metric) -> int: ...
    def shipped_to(self, metric: Metric) -> int | None: ...
    def claim(self, metric: Bucketed, up_to: int, now: int, ahead_from: int | None = None, attempt: int = 1) -> Claim | None: ...
    def claim_records(self, metric: Event, now: int, limit: int | None = None, attempt: int = 1) -> Claim | None: ...
    def claimed_cells(self, claim: Claim, metric: Bucketed) -> DataFrame: ...
    def claimed_records(self, claim: Claim, metric: Event) -> DataFrame: ...
    def ack(self, claim: Claim, metric: Metric) -> None: ...
    def release(self, claim: Claim) -> None: ...
    def recover(self, metric: Metric, now: int) -> list[Claim]: ...
    def take_turn(self, name: str, now: int, interval: int) -> str | None: ...
    def return_turn(self, name: str, token: str) -> bool: ...


class Ledger:
    """``durable`` and ``shared``: it outlives processes, and any number may use one path."""

    durable = shared = atomic_merge = True

    def __init__(self, spark: SparkSession, path: str, recover_after: int = RECOVER_AFTER, max_rows: int | None = None, max_series: int | None = None):
        self.spark, self.files, self.recover_after, self.max_rows, self.max_series = spark, Files(spark, path), recover_after, max_rows, max_series
        self.path = path.rstrip("/")

    # ---- appends ----

    def _kind(self, metric: Metric) -> None:
        name = f"meta/{metric.name}.json"
        self.files.create(name, {"kind": metric.kind})
        if (found := self.files.read(name)["kind"]) != metric.kind:
            raise ValueError(f"{metric.name} holds a {found}, not a {metric.kind}")

    def floor(self, metric: Metric) -> int:
        """All windows below it have been claimed once.  It only rises: a file for each height, the highest counts."""
        return max(map(int, self.files.names(f"floors/{metric.name}")), default=0)

    def _raise_floor(self, metric: Metric, to: int) -> None:
        self.files.create(f"floors/{metric.name}/{to}", {})
        for old in self.files.names(f"floors/{metric.name}"):
            if int(old) < to:
                self.files.delete(f"floors/{metric.name}/{old}")

    def _number(self, metric: Metric, key: str | None) -> tuple[int, bool]:
        """A batch number that no one else has (the key's own, if it has one), and whether that batch is there already."""
        keyed = f"keys/{metric.name}/{key}.json"
        if key is not None and self.files.exists(keyed):
            batch = self.files.read(keyed)["batch"]
            return batch, batch in self._commits(metric)
        taken = f"taken/{metric.name}"
        batch = 1 + max((int(n.removesuffix(".json")) for n in self.files.names(taken)), default=0)
        while not self.files.create(f"{taken}/{batch:012d}.json", {"key": key}):
            batch += 1
        if key is not None and not self.files.create(keyed, {"batch": batch}):
            return self._number(metric, key)
        return batch, False

    def append(self, metric: Metric, rows: DataFrame, key: str | None = None) -> int:
        """Append ops of a bucketed metric or staged rows of an event; the batch number.

        Late ops move to the first open window of their grid.  With ``key`` (a stream's batch), a second append of the
        same key changes nothing, and one that broke off is written over.
        """
        self._kind(metric)
        batch, there = self._number(metric, key)
        if there:
            return batch
        if self.max_rows is not None and (n := self.count_pending(metric) + rows.count()) > self.max_rows:
            raise ValueError(f"{metric.name}: {n} rows would be over the cap of {self.max_rows}")
        floor = self.floor(metric)
        if isinstance(metric, Bucketed):
            rows = self._landed(rows.withColumn("moved", F.lit(False)), metric, F.lit(True), floor)
            if self.max_series is not None:
                held = self.scan_series(metric)
                new = rows.select("dim_key").distinct()
                if (n := (new if held is None else held.union(new).distinct()).count()) > self.max_series:
                    raise ValueError(f"{metric.name}: {n} series would be over the cap of {self.max_series}")
        order = F.col("seq") if "seq" in rows.columns else F.lit(0)
        # rows of a batch are told apart by their place, which rises with partition and row
        numbered = rows.withColumn("arrival", order.cast("long")).withColumn("seq", F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{self.path}/rows/{metric.name}/batch={batch}")
        self.files.create(f"commits/{metric.name}/{batch:012d}.{floor}", {"key": key})
        return batch

    @staticmethod
    def _landed(rows: DataFrame, metric: Bucketed, which: Column, floor: int) -> DataFrame:
        at = F.when(which, landing_col(F.col("bucket_ms"), floor, metric.res)).otherwise(F.col("bucket_ms"))
        return rows.withColumn("moved", F.col("moved") | (at > F.col("bucket_ms"))).withColumn("bucket_ms", at)

    # ---- scans ----

    def _commits(self, metric: Metric) -> dict[int, int]:
        """Batches that count, with the floor that their rows were moved to."""
        return {int(n.split(".")[0]): int(n.split(".")[1]) for n in self.files.names(f"commits/{metric.name}")}

    def _floors(self, metric: Metric, commits: dict[int, int], claims: list[Claim]) -> dict[int, int]:
        """Batches whose rows move further than their commit says: a claim that did not see them closed their windows."""
        out = {}
        for batch, floor in commits.items():
            seen = [c for c in claims if c.has(batch)]
            now = max((c.floors.get(str(batch), 0) for c in seen), default=0) if seen else max((c.floor for c in claims), default=0)
            if now > floor:
                out[batch] = now
        return out

    def _rows(self, metric: Metric, commits: dict[int, int] | None = None, claims: list[Claim] | None = None) -> DataFrame | None:
        """All rows of batches that count, in the windows they belong to."""
        commits = self._commits(metric) if commits is None else commits
        if not commits:
            return None
        folder = f"{self.path}/rows/{metric.name}"
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", folder).parquet(*[f"{folder}/batch={b}" for b in sorted(commits)])
        rows = rows.withColumn("batch", F.col("batch").cast("long"))
        if isinstance(metric, Bucketed):
            for batch, floor in self._floors(metric, commits, self._taken(metric) if claims is None else claims).items():
                rows = self._landed(rows, metric, F.col("batch") == batch, floor)
        return rows

    def _log(self, metric: Metric) -> list[tuple[Claim, str | None]]:
        """All claims in their order, with how they were settled."""
        name = metric.name
        while True:
            settled, found = set(self.files.names(f"settled/{name}")), self.files.names(f"claims/{name}")
            try:
                return [(Claim(**self.files.read(f"claims/{name}/{n}")), self.files.read(f"settled/{name}/{n}")["state"] if n in settled else None) for n in found]
            except Exception:
                if all(self.files.exists(f"claims/{name}/{n}") for n in found):
                    raise  # else another process has just merged claims that it settled

    def claims(self, metric: Metric, state: str) -> list[Claim]:
        wanted = None if state == "inflight" else state
        return [c for c, s in self._log(metric) if s == wanted]

    def _taken(self, metric: Metric) -> list[Claim]:
        return [c for c, s in self._log(metric) if s != RELEASED]

    @staticmethod
    def _place() -> Column:
        return F.struct(F.col("batch"), F.col("arrival"), F.col("seq"))

    @classmethod
    def _covers(cls, c: Claim) -> Column:
        own = reduce(lambda a, b: a | b, [F.col("batch").between(lo, hi) for lo, hi in c.batches], F.lit(False))
        if c.cut is not None:
            own = own & (cls._place() <= F.struct(*[F.lit(x).cast("long") for x in c.cut]))
        if c.up_to is not None:
            below = F.col("bucket_ms") < c.up_to
            own = own & (below if c.ahead_from is None else below | (F.col("bucket_ms") >= c.ahead_from))
        return own

    def _not_of(self, claims: list[Claim]) -> Column:
        out = F.lit(True)
        for c in claims:
            out = out & ~self._covers(c)
        return out

    def live(self, metric: Metric) -> DataFrame | None:
        """Rows that no claim holds."""
        claims = self._taken(metric)
        rows = self._rows(metric, claims=claims)
        return None if rows is None else rows.where(self._not_of(claims))

    def shipped_to(self, metric: Metric, before: Claim | None = None) -> int | None:
        """End of the windows that claims (older than ``before``) have taken."""
        found = [c.up_to for c in self._taken(metric) if before is None or c.order < before.order]
        return max((x for x in found if x is not None), default=None)

    def claimed(self, claim: Claim, metric: Metric) -> DataFrame:
        claims = self._taken(metric)
        return self._rows(metric, claims=claims).where(self._covers(claim) & self._not_of([c for c in claims if c.order < claim.order]))

    def claimed_cells(self, claim: Claim, metric: Bucketed) -> DataFrame:
        """Cells to ship for a claim; for a level those of every window it holds in, on top of what it held before."""
        rows = self._ordered(self.claimed(claim, metric))
        if not isinstance(metric, Level):
            return metric.fold(rows)
        first = self.shipped_to(metric, claim)
        cells = metric.carried(metric.fold(self._on_base(metric, rows, claim.order)), claim.up_to)
        return cells if first is None else cells.where(F.col("bucket_ms") >= first)

    def claimed_records(self, claim: Claim, metric: Event) -> DataFrame:
        """Records of a claim in their order of arrival."""
        return self.claimed(claim, metric).orderBy("batch", "arrival", "seq")

    def _ordered(self, rows: DataFrame) -> DataFrame:
        """Ops with ``seq`` as their order of arrival."""
        return rows.withColumn("seq", self._place())

    # ---- levels: what series hold at the end of a claim ----

    def _on_base(self, metric: Level, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Ops on top of what the newest claim (older than ``before``) left, each series as one set in its last window."""
        bases = [c.base for c in self._taken(metric) if c.base is not None and (before is None or c.order < before)]
        if not bases:
            return rows
        held = self.spark.read.parquet(f"{self.path}/{bases[-1]}")
        first = F.struct(*[F.lit(x).cast("long").alias(n) for x, n in ((-1, "batch"), (0, "arrival"), (0, "seq"))])
        held = held.select("bucket_ms", *metric.series, F.col("value").cast("double").alias("v"), F.lit("set").alias("mode"), F.lit(False).alias("moved"), first.alias("seq"))
        return rows.select(*held.columns).unionByName(held)

    def _write_base(self, metric: Level, claimed: DataFrame, up_to: int) -> str:
        """What series hold below ``up_to``; those whose hold has run out are dropped for good."""
        cells = metric.fold(self._on_base(metric, self._ordered(claimed)))
        last = cells.groupBy(*metric.series).agg(F.max_by("value", "bucket_ms").alias("value"), F.max("bucket_ms").alias("bucket_ms"))
        if metric.hold is not None:
            last = last.where(F.col("bucket_ms") + metric.hold >= up_to)
        name = f"base/{metric.name}/{uuid.uuid4().hex}"
        last.write.parquet(f"{self.path}/{name}")
        return name

    def level_cells(self, metric: Level) -> DataFrame | None:
        """Written windows that have not shipped, and of each series the last one that has."""
        rows = self.live(metric)
        return None if rows is None else metric.fold(self._on_base(metric, self._ordered(rows)))

    def read_buckets(self, metric: Bucketed, start: int | None = None, end: int | None = None, dim_key: str | None = None) -> DataFrame | None:
        """Live cells by window and series."""
        if isinstance(metric, Level):  # a level's value comes from earlier windows too
            cells, first = self.level_cells(metric), self.shipped_to(metric)
            start = first if start is None else max(start, first or 0)
        else:
            rows = self.live(metric)
            cells = None if rows is None else metric.fold(self._ordered(self._between(rows, start, end)))
        if cells is None:
            return None
        if dim_key is not None:
            cells = cells.where(F.col("dim_key") == dim_key)
        return self._between(cells, start, end).orderBy("bucket_ms", "dim_key")

    @staticmethod
    def _between(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
        rows = rows if start is None else rows.where(F.col("bucket_ms") >= start)
        return rows if end is None else rows.where(F.col("bucket_ms") < end)

    def sum_buckets(self, metric: Bucketed, start: int, end: int) -> int | None:
        """Exact sum of a counter over a range, or None where a partial sum could be inexact."""
        cells = self.read_buckets(metric, start, end)
        if cells is None:
            return 0
        row = cells.agg(*[F.sum(F.when(c, F.col("value").cast("decimal(38,0)"))) for c in (F.col("value") >= 0, F.col("value") < 0)]).first()
        up, down = int(row[0] or 0), int(row[1] or 0)
        return up + down if up <= 2**53 - 1 and down >= 1 - 2**53 else None

    def read_pending(self, metric: Event, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame | None:
        rows = self.live(metric)
        if rows is None:
            return None
        rows = rows.where(F.lit(True) if start is None else F.unix_millis(F.col("ts").cast("timestamp")) >= start)
        rows = rows.where(F.lit(True) if end is None else F.unix_millis(F.col("ts").cast("timestamp")) < end)
        rows = self._ordered(rows).orderBy("seq")
        return rows if limit is None else rows.limit(limit)

    def count_pending(self, metric: Metric) -> int:
        """Rows not acknowledged, those of unsettled claims too."""
        rows = self._rows(metric)
        return 0 if rows is None else rows.where(self._not_of(self.claims(metric, ACKED))).count()

    def key_for(self, metric: Metric) -> str:
        """Where the rows of a metric are, for a look with other tools."""
        return f"{self.path}/rows/{metric.name}"

    def scan_series(self, metric: Bucketed) -> DataFrame | None:
        rows = self.live(metric)
        return None if rows is None else rows.select("dim_key").distinct()

    def read_levels(self, metric: Level, now: int) -> DataFrame | None:
        """What each series holds: a level outlives its claims."""
        cells = self.level_cells(metric)
        return None if cells is None else metric.held(cells, now).orderBy("dim_key")

    def read_level(self, metric: Level, now: int, dim_key: str) -> DataFrame | None:
        found = self.read_levels(metric, now)
        return None if found is None else found.where(F.col("dim_key") == dim_key)

    # ---- claims ----

    def _enter(self, metric: Metric, log: list[tuple[Claim, str | None]], commits: dict[int, int], **what) -> Claim | None:
        """Enter a claim that was made knowing ``log`` as the next one; None if another process has been faster."""
        order = 1 + max((c.order for c, _ in log), default=0)
        found = Claim(uuid.uuid4().hex, metric.name, order, batches=_ranges(commits), **what)
        return found if self.files.create(f"claims/{metric.name}/{order:012d}.json", asdict(found)) else None

    def claim(self, metric: Bucketed, up_to: int, now: int, ahead_from: int | None = None, attempt: int = 1) -> Claim | None:
        """Take all live windows below ``up_to`` (and from ``ahead_from`` on), and raise the floor."""
        while True:
            log, commits = self._log(metric), self._commits(metric)
            taken = [c for c, s in log if s != RELEASED]
            rows = self._rows(metric, commits, taken)
            if rows is None or isinstance(metric, Level) and any(s is None for _, s in log):
                return None  # what a level holds builds on the claim before, so that one is settled first
            own = F.col("bucket_ms") < up_to
            if ahead_from is not None:
                own = own | (F.col("bucket_ms") >= ahead_from)
            mine = rows.where(self._not_of(taken) & own)
            last = mine.agg(F.max("bucket_ms")).first()[0]
            if isinstance(metric, Level):  # held values ship with or without new writes
                last = max(up_to, last or 0)
            if last is None:
                return None
            ahead = ahead_from is not None and last >= ahead_from
            floor = max(self.floor(metric), last + metric.res if ahead else min(up_to, last + 1))
            # the floor is up before the claim is there: a batch that commits in between moves to it
            self._raise_floor(metric, floor)
            base = self._write_base(metric, mine, up_to) if isinstance(metric, Level) else None
            floors = {str(b): f for b, f in self._floors(metric, commits, taken).items()}
            found = self._enter(metric, log, commits, up_to=up_to, claimed_at=now, attempt=attempt, ahead_from=ahead_from, floor=floor, floors=floors, base=base)
            if found is not None:
                return found

    def claim_records(self, metric: Event, now: int, limit: int | None = None, attempt: int = 1) -> Claim | None:
        """Take the oldest live records, by batch, then order of arrival."""
        while True:
            log, commits = self._log(metric), self._commits(metric)
            rows = self._rows(metric, commits)
            if rows is None:
                return None
            live = rows.where(self._not_of([c for c, s in log if s != RELEASED])).select(self._place().alias("p"))
            if limit is not None:
                live = live.orderBy("p").limit(limit)
            last = live.agg(F.max("p")).first()[0]
            if last is None:
                return None
            found = self._enter(metric, log, commits, up_to=None, claimed_at=now, attempt=attempt, cut=list(last))
            if found is not None:
                return found

    def _settle(self, claim: Claim, state: str) -> bool:
        """Whether this is what settles the claim."""
        name = f"{claim.metric}/{claim.order:012d}.json"
        return self.files.exists(f"claims/{name}") and self.files.create(f"settled/{name}", {"state": state})

    def ack(self, claim: Claim, metric: Metric) -> None:
        """Settle for good.  A claim that is settled already, or put back meanwhile, is an error."""
        if not self._settle(claim, ACKED):
            raise RuntimeError(f"claim {claim.id} of {claim.metric} is settled already")
        log, there = self._log(metric), self._commits(metric)
        newest, state = log[-1]
        if state != ACKED:
            return
        for old, how in log[:-1]:  # one claim that covers an older one stands for both; the last keeps its number taken
            covered = (
                all(newest.has(b) for b in there if old.has(b))
                and (old.up_to is None or old.up_to <= newest.up_to)
                and (old.cut is None or old.cut <= newest.cut)
                and old.ahead_from is None
                and newest.ahead_from is None
            )
            if how == RELEASED or how == ACKED and covered:
                for folder in ("claims", "settled"):
                    self.files.delete(f"{folder}/{metric.name}/{old.order:012d}.json")
                if old.base is not None:
                    self.files.delete(old.base)

    def release(self, claim: Claim) -> None:
        """Put a claim's rows back."""
        if not self._settle(claim, RELEASED):
            raise RuntimeError(f"claim {claim.id} of {claim.metric} is settled already")

    def recover(self, metric: Metric, now: int) -> list[Claim]:
        """Put back claims that nobody settled in time."""
        old = [c for c in self.claims(metric, "inflight") if c.claimed_at < now - self.recover_after]
        return [c for c in old if self._settle(c, RELEASED)]

    # ---- turns ----

    def take_turn(self, name: str, now: int, interval: int) -> str | None:
        """A token, if no one has had the turn within ``interval``; of several that ask at once, one gets it."""
        folder = f"turns/{name}"
        files = self.files.names(folder)
        last = max((int(n.split(".")[0]) for n in files), default=0)
        if last and f"{last:012d}.back" not in files and now - self.files.read(f"{folder}/{last:012d}.json")["at"] < interval:
            return None
        token = uuid.uuid4().hex
        if not self.files.create(f"{folder}/{last + 1:012d}.json", {"at": now, "token": token}):
            return None
        for n in files:
            if int(n.split(".")[0]) < last:
                self.files.delete(f"{folder}/{n}")
        return token

    def return_turn(self, name: str, token: str) -> bool:
        """Give a turn back unused; only its holder can."""
        last = max((n for n in self.files.names(f"turns/{name}") if n.endswith(".json")), default=None)
        if last is None or self.files.read(f"turns/{name}/{last}")["token"] != token:
            return False
        return self.files.create(f"turns/{name}/{last.removesuffix('.json')}.back", {})

    def vacuum(self, metric: Metric) -> int:
        """Delete batches whose rows are all acknowledged (a level's values are in its last base), and traces of broken appends."""
        commits = self._commits(metric)
        rows = self._rows(metric, commits)
        if rows is None:
            return 0
        live = {r[0] for r in rows.where(self._not_of(self.claims(metric, ACKED))).select("batch").distinct().collect()}
        gone = [b for b in commits if b not in live]
        for b in gone:  # no longer counts, then is no longer there
            self.files.delete(f"commits/{metric.name}/{b:012d}.{commits[b]}")
            self.files.delete(f"rows/{metric.name}/batch={b}")
        newest = max(commits)
        for n in self.files.names(f"taken/{metric.name}"):
            if int(n.removesuffix(".json")) in gone and int(n.removesuffix(".json")) < newest:
                self.files.delete(f"taken/{metric.name}/{n}")
        return len(gone)
