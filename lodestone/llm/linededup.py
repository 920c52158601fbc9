"""Line dedup by levelled sorted runs of line hashes.

Every line of at least `min_chars` code points has a key (the line stripped of
white space at both ends, A-Z in lower case) and the key two 64-bit hashes.  The
documents are dealt into batches.  A batch reduces its lines to one row a key
(documents that hold it, largest doc_id) and merge-anti-joins them with the runs
before it, newest first: a key that no run holds is fresh and enters with its own
counts; a known key enters with the counts of the newest run that holds it added to
its own.  These rows are the batch's own run, sorted by the hashes and bucketed by
them, so that joins between runs move nothing.  The newest row of a key therefore
stands for all batches, and the answer is the newest run, and of each older one
what the merge-anti-join with the newer ones leaves.  When a level holds `fanout`
runs they are compacted the same way into one run of the next level.

Defined cases: a null or empty text is one empty line; rows that share a doc_id
are one document and each comes out with its own text; a null doc_id is a
document of its own, smaller than any other; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, discard, materialise, setting, shared_dir

KEY = ["h1", "h2"]
HEAVY = 4096


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row, pos, h1, h2): one row for each line with a key of `min_chars` or more."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), "key")).alias("h2"))


def reduce_batch(hashes: DataFrame) -> DataFrame:
    """The run of a batch: how many documents hold a key, and the largest of them."""
    return hashes.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


class LineRuns:
    """Sorted runs of line keys in levels, kept as bucketed tables in the shared folder until `close`."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.spent: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # A union of bucketed scans must not pass for partitioned: Spark 4.1 then drops the exchange
        # above it, while another rule turns the bucketed scans into plain ones.
        with setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):
            rows = rows.repartition(self.buckets, *KEY)
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{shared_dir(self.spark)}/{name}")

    def newest_first(self) -> list[str]:
        """The live runs: low levels are newer than high ones, and in a level the last is the newest."""
        return [name for level in self.levels for name in reversed(level)]

    def add(self, hashes: DataFrame) -> DataFrame:
        """Merge-anti-join a batch with the runs, add its own run, and return that run.

        Its column `fresh` is true for keys that no earlier run holds.
        """
        own = reduce_batch(hashes)
        n, top = [], []
        for k, name in enumerate(self.newest_first()):
            known = self.spark.table(name).select(*KEY, F.col("n_docs").alias(f"n{k}"), F.col("max_doc").alias(f"top{k}")).hint("merge")
            own = own.join(known, KEY, "left")
            n.append(F.col(f"n{k}"))
            top.append(F.when(F.col(f"n{k}").isNotNull(), F.struct(F.col(f"top{k}").alias("doc"))))
        none = F.lit(None)
        before, holder = F.coalesce(*n, none.cast("long")), F.coalesce(*top, none.cast("struct<doc:long>"))
        total = F.col("n_docs") + F.coalesce(before, F.lit(0))
        name = self._write(own.select(*KEY, total.alias("n_docs"), F.greatest("max_doc", holder["doc"]).alias("max_doc"), before.isNull().alias("fresh")))
        self.levels[0].append(name)
        self._compact()
        return self.spark.table(name)

    def _compact(self) -> None:
        """Full levels become one run of the next; a run whose batch was returned last stays readable until `close`."""
        for at in range(99):
            if at == len(self.levels) or len(self.levels[at]) < self.fanout:
                return
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(self._newest(list(reversed(self.levels[at])))))
            self.spent += self.levels[at]
            self.levels[at] = []

    def _newest(self, names: list[str]) -> DataFrame:
        """The newest row of every key in runs that are given newest first."""
        out = self.spark.table(names[0])
        for k, name in enumerate(names[1:], 1):
            rows = self.spark.table(name)
            for newer in names[:k]:
                rows = rows.join(self.spark.table(newer).select(*KEY).hint("merge"), KEY, "left_anti")
            out = out.unionByName(rows)
        return out

    def merged(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over every batch so far."""
        return self._newest(self.newest_first()).select(*KEY, "n_docs", "max_doc")

    def close(self) -> None:
        """Drop every table and its files."""
        for name in self.spent + self.newest_first():
            self._drop(name)
        self.spent, self.levels = [], [[]]


def line_drops(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, row, drops): the positions of the lines that a document loses."""
    hashes = materialise(line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    for batch in range(batches):
        runs.add(hashes.where(F.col("batch") == batch))
    shared = materialise(runs.merged().where(F.col("n_docs") >= min_docs), "shared-lines")
    runs.close()
    # Each of the very common keys has a part in HEAVY of all rows, so there are HEAVY of them at most: they are broadcast.
    common = F.col("n_docs") * HEAVY >= hashes.count()
    heavy, light = F.broadcast(shared.where(common)), shared.where(~common)
    met = hashes.join(heavy, KEY).unionByName(hashes.join(heavy.select(*KEY), KEY, "left_anti").join(light, KEY))
    lost = met.where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return lost.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`docs` with its columns, its text without the lost lines, and n_lines, n_dropped in a struct `_lines`.

    Lines whose key stands in `min_docs` documents or more go, except in the
    document with the largest doc_id that holds them.
    """
    # Names that no column of `docs` can have.
    of_id, of_row, of_drops, done_name = (f"_{uuid.uuid4().hex}" for _ in range(4))
    drops = line_drops(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout).toDF(of_id, of_row, of_drops)
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_row)), "left")
    # The struct binds the split lines to a lambda variable, so that they are split once.
    parts = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.coalesce(of_drops, F.array().cast("array<int>")).alias("drops")))
    kept = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drops"]), lambda i: F.get(s["lines"], i))
    done = F.transform(parts, lambda s: F.struct(F.array_join(kept(s), "\n").alias("text"), F.size(s["lines"]).cast("long").alias("n_lines"), F.size(s["drops"]).cast("long").alias("n_dropped")))
    joined = joined.withColumn(done_name, F.get(done, F.lit(0)))
    return joined.select(*[F.col(f"{done_name}.text") if c == "text" else F.col(c) for c in docs.columns], F.struct(f"{done_name}.n_lines", f"{done_name}.n_dropped").alias("_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `dedup_lines` over whole `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, r, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), d AS (
  SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(d.key) FILTER (WHERE l.doc_id <> d.keep)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.key IS NULL OR l.doc_id = d.keep), '')) AS kept_sha256
FROM l LEFT JOIN d USING (key) GROUP BY l.doc_id, l.r
"""
