"""A written text index: terms with the rows that hold them, in immutable parts.

A part has the rows (term, id, size) of some texts, size being the text's number of words, dealt
to ``SHARDS`` folders by the first letters of the term and sorted by term within a folder, so
that a lookup reads one folder and of it the row groups that can hold the term. New texts go to
a new part; the ids that a later part touches hide their rows in earlier parts. A manifest lists
the parts and is written last, under a number of its own, so that a search sees whole parts only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as words_of

SHARDS = 64
#: Letters that decide the folder; a shorter prefix has to look into all.
HEAD = 2
SCHEMA = "term string, id long, size int, shard int"


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, HEAD)), F.lit(SHARDS)).cast("int")


class Postings:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """The parts of the newest manifest, oldest first."""
        place = self._path(f"{self.root}/manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []
        return json.loads(self.spark.read.text(f"{place.toString()}/{names[-1]}", wholetext=True).first()[0]) if names else []

    def append(self, texts: DataFrame, touched: DataFrame | None = None) -> str:
        """Indexes ``texts`` (id, text) as a new part. ``touched`` (id): what the part replaces or
        removes, the texts' own ids if not given."""
        held, name = self.parts(), f"part-{uuid.uuid4().hex}"
        tokens = texts.select(F.col("id").cast("long").alias("id"), words_of.words(F.col("text")).alias("w"))
        rows = tokens.select("id", F.size("w").alias("size"), F.explode(F.array_distinct("w")).alias("term")).withColumn("shard", _shard(F.col("term")))
        # range partitions split the folder of a frequent head, and keep it sorted by term
        rows.select("term", "id", "size", "shard").repartitionByRange("shard", "term", "id").sortWithinPartitions("shard", "term", "id").write.partitionBy("shard").parquet(f"{self.root}/{name}/rows")
        (texts if touched is None else touched).select(F.col("id").cast("long").alias("id")).distinct().write.parquet(f"{self.root}/{name}/ids")
        stream = self._fs.create(self._path(f"{self.root}/manifests/{len(held):08d}.json"), False)
        stream.write(bytearray(json.dumps([*held, name]).encode()))
        stream.close()
        return name

    def lookup(self, term: str, prefix: bool = False) -> DataFrame:
        """(term, id, size) of the rows in force whose term is, or begins with, ``term``."""
        wanted = F.col("term").startswith(term) if prefix else F.col("term") == term
        out, parts = None, self.parts()
        for k, part in enumerate(parts):
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{part}/rows").filter(wanted)
            if len(term) >= HEAD or not prefix:
                rows = rows.filter(F.col("shard") == self._number(term))
            for later in parts[k + 1 :]:
                rows = rows.join(self.spark.read.schema("id long").parquet(f"{self.root}/{later}/ids"), "id", "left_anti")
            rows = rows.select("term", "id", "size")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], "term string, id long, size int") if out is None else out

    def _number(self, term: str) -> int:
        return self.spark.range(1).select(_shard(F.lit(term))).first()[0]

    def search(self, terms: list[str], last_is_prefix: bool = True) -> DataFrame:
        """(id, size) of the texts that hold all terms, the last perhaps as a prefix; none without terms.

        The rarest term comes first, so that each further one only narrows few ids.
        """
        if not terms:
            return self.spark.createDataFrame([], "id long, size int")
        found = [self.lookup(term) for term in dict.fromkeys(terms[:-1])] + [self.lookup(terms[-1], last_is_prefix)]
        if len(found) > 1:
            counts = None
            for k, rows in enumerate(found):
                part = rows.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"))
                counts = part if counts is None else counts.unionByName(part)
            found = [found[r["k"]] for r in sorted(counts.collect(), key=lambda r: (r["n"], r["k"]))]
        out = found[0].groupBy("id").agg(F.max("size").alias("size"))
        for rows in found[1:]:
            out = out.join(rows.select("id"), "id", "left_semi")
        return out

    def vocabulary(self, prefix: str) -> DataFrame:
        """(term, docs): the terms with that prefix and how many texts hold each."""
        return self.lookup(prefix, True).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
