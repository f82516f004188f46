"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A ledger is a folder of batches. Each batch holds changes of documents (the count that is revoked and the
count that now holds), sorted by buckets of their ids, and the additive deltas of the totals. Every try to commit a
batch writes into a folder of its own, and nothing is ever overwritten; a batch counts once its marker exists, which is
created last, only if absent, and names the try that counts. So a second writer of a batch, or one that dies on
the way, changes nothing. A marker that its writer never filled stands for no try; after ``PATIENCE`` seconds the next
writer sets another beside it, and of several the last that names a try holds. Totals are the sums of all committed
deltas, so they never need the documents again. A commit reads the row groups of the buckets it touches only, and
there are many more of these than a batch of some documents touches; compact() folds all batches so far into one
snapshot, which later commits and totals start from.

Defined cases: null source or language are groups of their own; a null text has no tokens but counts as a
document; a delete of an unknown document changes nothing; a revision of an unknown one inserts it; a
document that a batch both changes and deletes is deleted; a batch that names a document and version more than
once must agree, else the largest count holds; changes without document id or version are ignored; further columns of
the changes are ignored; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.llm.arrow_map import slices
from terrano.llm.packing import encoder

KEYS = ["doc_id", "tokenizer_version"]
GROUPS = ["source", "lang", "tokenizer_version"]
CHANGE = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long"
STATE = CHANGE + ", gone boolean, bucket int, batch int"
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long, batch int"
#: Buckets of document ids, by hash; files are sorted by them.
BUCKETS = 4096
#: Seconds after which a marker without content counts as left behind.
PATIENCE = 10.0

#: Native tokenizers by version.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "bytes-1": lambda t: F.octet_length(t),
    "words-1": lambda t: F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")),
}
#: Public vocabularies (rank files) by version.
VOCABULARIES = {"byte_bpe_50k-1": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k-1": "byte_bpe_multi_50k.tiktoken"}


def with_vocabulary_counts(docs: DataFrame, vocabularies: dict[str, str], text: str = "text") -> DataFrame:
    """doc_id, source, lang, text and one column of token counts for each version; special tokens' strings are ordinary text."""
    paths = {v: public_tokenizers.path(name) for v, name in vocabularies.items()}

    def run(batches):
        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            made = [pa.array([len(x) for x in map(encoder(path).encode_ordinary, texts)], pa.int64()) for path in paths.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *paths])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, text string, " + ", ".join(f"`{v}` long" for v in paths))


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] | None = None, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """A change for each document and tokenizer version: of native tokenizers, and of public vocabularies if given."""
    kinds = dict(TOKENIZERS if tokenizers is None else tokenizers)
    if vocabularies:
        docs = with_vocabulary_counts(docs, vocabularies)
        kinds |= {v: lambda t, v=v: F.col(f"`{v}`") for v in vocabularies}
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.array(*(F.struct(F.lit(v).alias("v"), f(text).cast("long").alias("n")) for v, f in kinds.items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.explode(each).alias("_t"))
    return rows.select("doc_id", F.col("_t.v").alias("tokenizer_version"), "source", "lang", F.col("_t.n").alias("n_tokens"))


class Ledger:
    """Batches under a shared folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, batch: int | None = None, attempt: str | None = None) -> str:
        return f"{self.root}/{kind}" + (f"/batch={batch}" if batch is not None else "") + (f"/try={attempt}" if attempt else "")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _said(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _named(self, kind: str) -> dict[int, str]:
        """The try of each batch that counts, by batch in ascending order."""
        fs, p = self._fs(self._path(kind))
        names = sorted(tuple(map(int, s.getPath().getName().split("=")[1].split("."))) for s in fs.listStatus(p)) if fs.exists(p) else []
        return {batch: said for batch, n in names if (said := self._said(f"{self._path(kind)}/batch={batch}.{n}"))}

    def _mark(self, kind: str, batch: int, attempt: str) -> bool:
        """Whether this try of the batch is the one that counts; false if another was first."""
        for n in range(1 << 30):
            name = f"{self._path(kind)}/batch={batch}.{n}"
            fs, p = self._fs(name)
            try:
                out = fs.create(p, False)
            except Exception as e:  # the file system's own exception, wrapped
                if "AlreadyExists" not in str(e) and "already exists" not in str(e).lower():
                    raise
                until = time.monotonic() + PATIENCE
                while not self._said(name) and time.monotonic() < until:
                    time.sleep(0.05)
                if self._said(name):
                    return False
                continue
            out.write(attempt.encode())
            out.close()
            return True
        return False

    def committed(self) -> list[int]:
        """Ids of the batches that count."""
        return list(self._named("markers"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The latest snapshot and the batches after it."""
        names = [x.split()[0] for x in schema.split(", ")]
        base = list(self._named("snapshot-markers").items())[-1:]
        later = [(b, t) for b, t in self._named("markers").items() if not base or b > base[0][0]]
        parts = [
            self.spark.read.schema(schema).option("basePath", self._path(k)).parquet(*(self._path(k, b, t) for b, t in which)).select(*names) for k, which in ((f"snapshot-{kind}", base), (kind, later)) if which
        ]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """The counts that hold now (CHANGE), one row for each document and version; of some buckets of ids only, if given."""
        rows = self._read("changes", STATE)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("source", "lang", "n_tokens", "gone"), "batch").alias("x"))
        return last.where(~F.col("x.gone")).select(*KEYS, "x.source", "x.lang", "x.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of all groups that hold documents."""
        rows = self._read("deltas", DELTA)
        return rows.groupBy(*GROUPS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0")

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _sorted(self, changes: DataFrame) -> DataFrame:
        """With bucket, in files of ranges of buckets: readers skip the row groups of others."""
        return changes.withColumn("bucket", self._bucket()).repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")

    def compact(self) -> bool:
        """Fold all committed batches into a snapshot; False if there is none since the last."""
        done, last = self.committed(), list(self._named("snapshot-markers"))[-1:]
        if not done or last and last[0] >= done[-1]:
            return False
        attempt = uuid.uuid4().hex
        self._sorted(self.current().select("*", F.lit(False).alias("gone"))).write.parquet(self._path("snapshot-changes", done[-1], attempt))
        sums = self.totals().select(*GROUPS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        sums.write.parquet(self._path("snapshot-deltas", done[-1], attempt))
        return self._mark("snapshot-markers", done[-1], attempt)

    def commit(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch once. upserts: CHANGE rows, inserts or revised counts; deletes: (doc_id, tokenizer_version), or doc_id alone for all versions.

        False if the batch was committed before, or meanwhile by another. Batches are applied in ascending order of id.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        fresh = lambda df, on: df.where(" and ".join(f"{k} is not null" for k in on)).select(*on).distinct()
        gone = deletes and fresh(deletes, [k for k in KEYS if k in deletes.columns])
        clean = None
        if upserts is not None:
            clean = upserts.where(F.col("doc_id").isNotNull() & F.col("tokenizer_version").isNotNull())
            clean = clean.groupBy(*KEYS).agg(F.max(F.struct("n_tokens", "source", "lang")).alias("x")).select(*KEYS, "x.source", "x.lang", "x.n_tokens", F.lit(False).alias("gone"))
            if gone is not None:  # a delete wins over a change of the same batch
                clean = clean.join(gone, gone.columns, "left_anti")
        parts = [] if clean is None else [clean]
        if gone is not None and done:
            touched = [r[0] for r in gone.select(self._bucket()).distinct().collect()]  # at most BUCKETS
            old = self.current(touched).join(gone, gone.columns, "left_semi")
            parts.append(old.select(*KEYS, "source", "lang", F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("gone")))
        new = parts[0] if parts else self.spark.createDataFrame([], CHANGE + ", gone boolean")
        new = new.unionByName(parts[1]) if len(parts) > 1 else new
        attempt = uuid.uuid4().hex
        path = self._path("changes", batch, attempt)
        self._sorted(new).write.parquet(path)
        new = self.spark.read.schema(CHANGE + ", gone boolean, bucket int").parquet(path)
        added = new.where(~F.col("gone")).select(*GROUPS, F.lit(1).alias("d"), "n_tokens")
        if done and parts:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            revoked = self.current(touched).join(new.select(*KEYS), KEYS, "left_semi")
            added = added.union(revoked.select(*GROUPS, F.lit(-1).alias("d"), (-F.col("n_tokens")).alias("n_tokens")))
        sums = added.groupBy(*GROUPS).agg(F.sum("d").cast("long").alias("d_docs"), F.sum("n_tokens").alias("d_tokens"))
        sums.write.parquet(self._path("deltas", batch, attempt))
        return self._mark("markers", batch, attempt)
