"""Folders of media, vectors, transcripts, manifests, receipts and requests as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that a scan admits, and their kinds.
SCANNED = {"mp4": "video", "mov": "video", "jpg": "image", "jpeg": "image", "png": "image", "heic": "image"}


def _outermost(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """The roots that are there, without those below another; a missing one is passed over."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = sorted({r.rstrip("/") for r in roots if path(r).getFileSystem(conf).exists(path(r))})
    return [r for r in there if not any(r != other and r.startswith(other + "/") for other in there)]


def media_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, name, kind, bytes, modified) of all media below the roots, hidden names left out.

    The listing is the source's; the files' contents are never read.
    """
    schema = "path string, name string, kind string, bytes long, modified timestamp"
    found = _outermost(spark, roots)
    if not found:
        return spark.createDataFrame([], schema)
    globs = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in SCANNED) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(found)
    below = F.lit(None).cast("string")
    for root in found:
        plain = root.split(":", 1)[1] if ":" in root.split("/", 1)[0] else root
        place = F.locate("/" + plain.strip("/") + "/", F.col("path"))
        below = F.coalesce(below, F.when(place > 0, F.expr(f"substring(path, locate('/{plain.strip('/')}/', path) + {len(plain.strip('/')) + 1})")))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = F.create_map(*[x for e, k in SCANNED.items() for x in (F.lit(e), F.lit(k))])
    return files.filter(~F.coalesce(below, F.col("path")).contains("/.")).select("path", name.alias("name"), F.element_at(kinds, extension).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def with_policy(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Files in path order with their policy (path, policy), keep where none is set."""
    return files.join(policies.select("path", "policy"), "path", "left").withColumn("policy", F.coalesce("policy", F.lit("keep"))).orderBy("path")


def npy_vectors(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(path, row, vector) of every ``.npy`` file: one vector, or a matrix of them; a file of
    another width or with values that are not finite stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                if matrix.ndim != 2 or matrix.shape[1] != width or not np.isfinite(matrix).all():
                    raise ValueError(f"{path} holds no vectors of {width} finite values")
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096].astype(np.float32)
                    yield pa.record_batch([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), width).cast(pa.list_(pa.float32()))], names=["path", "row", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, row long, vector array<float>")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk, start, end, text) of the segments of transcript documents with a number for a name."""
    documents = spark.read.schema("transcript struct<segments: array<struct<start: double, end: double, text: string>>>").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    chunk = F.regexp_extract(F.input_file_name(), r"/(\d+)\.json$", 1)
    return documents.select(chunk.alias("chunk"), F.explode("transcript.segments").alias("s")).filter("chunk <> ''").select(F.col("chunk").cast("long").alias("chunk"), "s.start", "s.end", "s.text")


def manifest(spark: SparkSession, samples: str, metadata: str | None = None) -> DataFrame:
    """(path, kind, frames in time order, metadata) of a JSON list of samples and a JSON list of
    (path, metadata)."""
    rows = spark.read.schema("path string, kind string, timestamp double, frame string").option("multiLine", "true").json(samples)
    frames = F.sort_array(F.collect_list(F.struct("timestamp", "frame")))
    out = rows.groupBy("path").agg(F.min("kind").alias("kind"), frames.alias("frames"))
    if metadata is None:
        return out
    return out.join(spark.read.schema("path string, metadata map<string, string>").option("multiLine", "true").json(metadata), "path", "left")


def receipts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Receipts (one JSON document a file), the newest capture first and those without one last."""
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).orderBy(F.desc_nulls_last("captured"), "asset")


def inventory(spark: SparkSession, file: str) -> DataFrame:
    """(path, kind, probe as JSON) of the records of an inventory that hold no error."""
    whole = spark.read.schema("files array<struct<path: string, kind: string, error: string, probe: string>>").option("multiLine", "true").json(file)
    return whole.select(F.explode("files").alias("f")).select("f.*").filter("error IS NULL").drop("error")


def new_annotation_events(spark: SparkSession, folder: str, ledger: DataFrame, identities: DataFrame) -> DataFrame:
    """(asset, field, value, file) of event files that the ledger (file) does not hold: of each asset and
    field the event of the last file by name. ``identities`` (old, asset) gives assets their new name."""
    rows = spark.read.schema("asset string, field string, value string").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    fresh = rows.join(ledger.select("file"), "file", "left_anti").join(identities.select(F.col("old").alias("asset"), F.col("asset").alias("renamed")), "asset", "left")
    named = fresh.withColumn("asset", F.coalesce("renamed", "asset"))
    return named.groupBy("asset", "field").agg(F.max(F.struct("file", "value")).alias("e")).select("asset", "field", F.col("e.value").alias("value"), F.col("e.file").alias("file"))


def requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with query, mode, limit and error: each line is judged alone, and a bad one has its
    reason for a result and stops nothing."""
    body = F.from_json(F.col(column), "query string, mode string, limit long, action string")
    query, mode, limit = F.trim(body["query"]), F.coalesce(body["mode"], F.lit("both")), F.coalesce(body["limit"], F.lit(60).cast("long"))
    opens: Column = F.try_parse_json(F.col(column)).isNotNull() & F.trim(F.col(column)).startswith("{")
    error = F.when(~F.coalesce(opens, F.lit(False)), "the line is no JSON object").when(body["action"] == "warm", None)
    error = error.when(query.isNull() | (F.length(query) == 0) | (F.length(query) > 2000), "a query has 1 to 2000 characters").when(~mode.isin("visual", "speech", "both"), "unknown mode").when(~limit.between(1, 60), "a limit is 1 to 60")
    fine = error.isNull()
    return lines.select("*", F.when(fine, query).alias("query"), F.when(fine, mode).alias("mode"), F.when(fine, limit).alias("limit"), error.alias("error"))
