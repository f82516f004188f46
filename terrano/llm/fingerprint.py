"""Threshold-scaled document sketches, in native expressions only.

A document's shingles are its runs of five words (white-space separated; a shorter text is one shingle).
Each is hashed by MD5, and every hash whose hexadecimal form sorts below ``limit`` is retained: a fixed
fraction (limit '2': one in eight). Sketches of the same limit merge by union, and the shares of common hashes estimate
resemblance and containment even between very unequal documents. So that no text with words has an
empty sketch, the smallest hash stands in where none lies below the limit; merging drops such stand-ins
again, so the merged sketch is that of both texts' shingles together.

Defined cases: null counts as empty; a text without words has the empty sketch ''; two empty sketches
are alike (1.0), an empty and a filled one are not (0.0); equal texts have equal sketches; a lone row
is its own neighbour; equal ids are ordered by text hash, null ids come first; input columns that clash
with results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SHINGLE = 5
LIMIT = "2"
HEX = 16
#: Ordered buckets, at most FAN squared; each is sorted in one task, spilling if need be. FAN sampled ids a bucket reach the driver.
FAN = 128
ROWS_PER_BUCKET = 2000
SAMPLES = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashes(words: Column, size: int = SHINGLE) -> Column:
    """The shingles' hashes in order, HEX hexadecimal digits each."""
    short = lambda x: F.substring(F.md5(x), 1, HEX)
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: short(F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(short(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))


def retained(hashes: Column, limit: str = LIMIT) -> Column:
    """The sketch: sorted distinct hashes below the limit, or else the smallest."""
    kept = F.filter(hashes, lambda h: h < limit)
    return F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)


def with_sketch(df: DataFrame, text: str, sketch: str) -> DataFrame:
    """``df`` with the sketch of a text column, as an array."""
    step = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    step = step.withColumn("_hashes", hashes(F.col("_words"))).drop("_words")
    return step.withColumn(sketch, retained(F.col("_hashes"))).drop("_hashes")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = shared(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise((both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has too."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise((shared(a, b) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))).cast("double"))


def merge(a: Column, b: Column, limit: str = LIMIT) -> Column:
    """The sketch of two documents together."""
    return retained(F.array_union(a, b), limit)


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def with_next(df: DataFrame, doc_id: str, carried: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with the ``carried`` columns of the row with the next id; after the last comes the first.

    Rows are dealt to ordered buckets between sampled ids, with one shuffle; the rows on a bound also go to
    the bucket before it, where they only serve as the last row's neighbour. Any bounds give the same result.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    n = df.select(doc_id).count()
    buckets = max(1, min(FAN * FAN, n // ROWS_PER_BUCKET))
    low = df.agg(F.min(key).alias("low")).first()["low"]
    if low is None:
        return df.select("*", *(F.col(c).alias(prefix + c) for c in carried))
    some = df.select(key.alias("k")).sample(min(1.0, SAMPLES * buckets / n), 7).limit(2 * SAMPLES * buckets).collect()  # bounded by the buckets
    some = sorted({r["k"] for r in some})
    bounds = sorted({low, *(some[i * len(some) // buckets] for i in range(buckets) if some)})
    last = len(bounds) - 1
    held = F.array(*(F.lit(b).cast("long") for b in bounds))
    at_most = lambda a: F.size(F.filter(a, lambda b: b <= F.col("_key")))
    coarse = F.array(*(F.lit(b).cast("long") for b in bounds[::FAN]))
    bucket = F.col("_coarse") * FAN + at_most(F.slice(held, F.col("_coarse") * FAN + 1, F.lit(FAN))) - 1
    rows = df.withColumn("_key", key).withColumn("_tie", F.xxhash64(*(F.col(c) for c in carried)))
    rows = rows.withColumn("_coarse", at_most(coarse) - 1).withColumn("_bucket", bucket).drop("_coarse")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("wrap"), F.lit(True).alias("own"))
    before = F.struct(F.when(F.col("_bucket") > 0, F.col("_bucket") - 1).otherwise(last).alias("b"), (F.col("_bucket") == 0).alias("wrap"), F.lit(False).alias("own"))
    rows = rows.withColumn("_to", F.explode(F.when(F.get(held, F.col("_bucket")) == F.col("_key"), F.array(own, before)).otherwise(F.array(own))))
    order = W.partitionBy("_to.b").orderBy("_to.wrap", "_key", "_tie", F.col("_to.own").desc())
    out = rows.select("*", *(F.lead(c).over(order).alias(prefix + c) for c in carried))
    return out.where(F.col("_to.own")).drop("_key", "_tie", "_bucket", "_to")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint, the sketch as text."""
    out = with_sketch(docs, text, "_sketch")
    return out.withColumn("fingerprint", as_text(F.col("_sketch"))).drop("_sketch")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and the likeness to the edited text and to the next document.

    The edited text has its last quarter of characters replaced by the first as many of the next document.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = with_sketch(base, "text", "sketch")
    out = with_next(base, "doc_id", ["text", "sketch"])
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("left(text, cast(n_chars - _cut as int))"), F.expr("left(next_text, _cut)"))
    out = out.select("doc_id", "n_chars", edited.alias("edited"), "sketch", "next_sketch")
    out = with_sketch(out, "edited", "edited_sketch")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
