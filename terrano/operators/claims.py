"""Claims of queue rows by runs that work at the same time: no row has two owners.

The queue is a table that nobody locks; who holds what is a log of numbered versions in a folder that all runs share.
A run reads the log up to some version, picks rows that nobody holds, writes them into a folder of its own, and then
tries to be the one who creates the next version's file, which names that folder. The file is created only if it is not
there, so of two runs that read the same version one succeeds; the other reads on and picks again. Nothing is ever
overwritten: what a dead run has written without a version is part of nothing, and what it holds by a version goes back
when ``reclaim`` finds the claim too old.

Entries: claim (rows and their owner), done, and back (rows that are free again, with one more attempt). The last
entry that names a row tells its state. ``compact`` folds all entries up to a version into one table, so that reading
does not grow with the log's age.

A version's file names its entry in its content, so a run that dies between creating and filling it leaves a version
that says nothing. Readers wait for ``patience`` seconds, then put a void mark beside it and look once more; whoever
fills a version looks for the mark afterwards and gives up if it is there. At worst a claim is taken for lost by its owner
and held for the others until it is reclaimed, never held twice.

Defined cases: rows without id are never claimed; of equal ids the first in order is; claiming nothing writes no version;
``done`` and ``back`` of rows that the owner does not hold change nothing; an empty queue gives an empty claim.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.operators.dedupe import first_wins
from terrano.session import broadcast_within

ENTRY = "id long, kind string, owner string, at timestamp, attempts int"
#: Rows of a claim up to which it is broadcast to the queue (about 40 MB).
MAX_BROADCAST_CLAIM = 1_000_000


def _held(queue: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of the queue that ``held`` (id, attempts) names, with the log's attempts in place of their own."""
    return queue.drop("attempts", "owner", "claimed_at").join(broadcast_within(held, MAX_BROADCAST_CLAIM), "id").dropDuplicates(["id"])


class Claims:
    """The log of claims in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, patience: float = 10.0) -> None:
        self.spark, self.folder, self.patience = spark, folder, patience
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- the log

    def _create(self, name: str, content: str) -> bool:
        """Whether this call created the file; false if it was there."""
        try:
            out = self._fs.create(self._fs_path(f"{self.folder}/{name}"), False)
        except Exception as e:  # the file system's own exception, wrapped
            if "AlreadyExists" in str(e) or "already exists" in str(e).lower():
                return False
            raise
        out.write(content.encode())
        out.close()
        return True

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self.folder}/{name}"))

    def _content(self, name: str) -> str:
        stream = self._fs.open(self._fs_path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _entry(self, version: int) -> dict | None:
        """What a version says; None for one that its writer never filled."""
        name, until = f"versions/{version:012d}", time.monotonic() + self.patience
        while not (said := self._content(name)):
            if time.monotonic() > until:
                self._create(f"void/{version:012d}", "void")
                said = self._content(name)
                return json.loads(said) if said else None
            time.sleep(0.05)
        return json.loads(said)

    def _names(self, folder: str) -> list[str]:
        path = self._fs_path(f"{self.folder}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The last version, 0 for a new log."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def _snapshot(self, upto: int) -> tuple[int, str]:
        """The last folded version that is not behind ``upto`` and its table; 0 if there is none. Files that nobody has filled yet do not count."""
        for n in sorted((int(n) for n in self._names("folded") if n.isdigit() and int(n) <= upto), reverse=True):
            if path := self._content(f"folded/{n:012d}"):
                return n, path
        return 0, ""

    def states(self, upto: int | None = None) -> DataFrame:
        """ENTRY and version: the last entry of every row that was ever claimed."""
        upto = self.version() if upto is None else upto
        base, folded = self._snapshot(upto)
        paths = {v: e["path"] for v in range(base + 1, upto + 1) if (e := self._entry(v))}
        parts = [self.spark.createDataFrame([], ENTRY).withColumn("version", F.lit(0).cast("long"))]
        if base:
            parts.append(self.spark.read.schema(f"{ENTRY}, version long").parquet(folded))
        for v, path in paths.items():
            parts.append(self.spark.read.schema(ENTRY).parquet(path).withColumn("version", F.lit(v).cast("long")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("id").agg(F.max_by(F.struct("kind", "owner", "at", "attempts", "version"), "version").alias("_x")).select("id", "_x.*")

    def compact(self) -> int:
        """Folds all versions so far into one table, and says which. Doing it twice, or by two runs, changes nothing."""
        upto = self.version()
        if upto > self._snapshot(upto)[0]:
            path = f"{self.folder}/attempts/{uuid.uuid4().hex}"
            self.states(upto).write.parquet(path)
            self._create(f"folded/{upto:012d}", path)
        return upto

    # --- entries

    def propose(self, rows: DataFrame, version: int) -> tuple[int, str, int]:
        """Writes an entry that is to follow ``version``: (the version it wants to be, its folder, its rows)."""
        path = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        rows.select("id", "kind", "owner", "at", F.col("attempts").cast("int").alias("attempts")).write.parquet(path)
        return version + 1, path, self.spark.read.schema(ENTRY).parquet(path).count()

    def commit(self, proposed: tuple[int, str, int]) -> bool:
        """Whether the entry became its version; false if another did."""
        version, path, _ = proposed
        name = f"{version:012d}"
        return self._create(f"versions/{name}", json.dumps({"path": path})) and not self._exists(f"void/{name}")

    def _pick(self, queue: DataFrame, n: int, owner: str, as_of: str, order: list[str | Column], version: int) -> DataFrame:
        held = self.states(version)
        free = queue.where(F.col("id").isNotNull()).join(held.select("id", F.col("kind").alias("_kind"), F.col("attempts").alias("_attempts")), "id", "left")
        free = first_wins(free.where("_kind is null or _kind = 'back'"), ["id"], [F.col(o) if isinstance(o, str) else o for o in order])
        return free.orderBy(*order, "id").limit(n).select("id", F.lit("claim").alias("kind"), F.lit(owner).alias("owner"), F.lit(as_of).cast("timestamp").alias("at"), F.coalesce("_attempts", F.lit(0)).alias("attempts"))

    def claim(self, queue: DataFrame, n: int, owner: str, as_of: str, order: list[str | Column]) -> DataFrame:
        """The first ``n`` rows of ``queue`` (pending rows with ``id``) that nobody holds; from now on ``owner`` does."""
        while True:
            version = self.version()
            proposed = self.propose(self._pick(queue, n, owner, as_of, order, version), version)
            mine = self.spark.read.schema(ENTRY).parquet(proposed[1])
            if not proposed[2] or self.commit(proposed):
                return _held(queue, mine.select("id", "attempts")).withColumns({"owner": F.lit(owner), "claimed_at": F.lit(as_of).cast("timestamp")})

    def _follow(self, change) -> int:
        """Commits the rows that ``change`` makes of the states, again from the start whenever another was quicker; how many there were."""
        while True:
            version = self.version()
            proposed = self.propose(change(self.states(version)), version)
            if not proposed[2] or self.commit(proposed):
                return proposed[2]

    def finish(self, ids: DataFrame, owner: str, as_of: str, kind: str = "done") -> int:
        """Ends the owner's claims of ``ids`` (id): done, or back for another try. How many there were."""
        now = F.lit(as_of).cast("timestamp").alias("at")
        more = F.col("attempts") + (1 if kind == "back" else 0)
        mine = lambda states: states.where((F.col("kind") == "claim") & (F.col("owner") == owner)).join(ids.select("id").distinct(), "id", "left_semi")
        return self._follow(lambda states: mine(states).select("id", F.lit(kind).alias("kind"), "owner", now, more.alias("attempts")))

    def reclaim(self, as_of: str, minutes: int = 30, most: int = 5) -> int:
        """Frees what was claimed more than ``minutes`` ago and not ended, if it was tried fewer than ``most`` times. How many rows."""
        now = F.lit(as_of).cast("timestamp")
        old = (F.col("kind") == "claim") & (F.col("at") < now - F.make_interval(mins=F.lit(minutes))) & (F.col("attempts") < most)
        return self._follow(lambda states: states.where(old).select("id", F.lit("back").alias("kind"), "owner", now.alias("at"), (F.col("attempts") + 1).alias("attempts")))


def until_empty(claims: Claims, queue: DataFrame, n: int, owner: str, as_of: str, order: list[str | Column], handle, most: int | None = None) -> int:
    """Claims ``n`` rows after another and has them handled until nothing is left, or ``most`` times; how many batches were handled.

    ``handle(rows, batch)`` gets the claim's version as batch and must give the same result when it is called again: what
    this owner holds from a run that was stopped is handled once more, under the same number, before anything new is claimed.
    """
    handled = 0
    while most is None or handled < most:
        mine = claims.states().where((F.col("kind") == "claim") & (F.col("owner") == owner))
        batch = mine.agg(F.min("version")).first()[0]
        if batch is None:
            if not claims.claim(queue, n, owner, as_of, order).limit(1).count():
                return handled
            continue
        held = mine.where(F.col("version") == batch).select("id", "attempts")
        handle(_held(queue, held), batch)
        claims.finish(held, owner, as_of)
        handled += 1
    return handled
