"""WARC records of pages, and a Merkle fixity audit of replicas.

Pages become WARC response records, in files of ``FILE_IDS`` consecutive page_ids.  A leaf
of a file's tree holds the hash of a page's record; ``FANOUT`` neighbours make a node, whose
hash covers its children's places, lengths and hashes in order, so that each node stands
for an ordered range of offsets.  Two replicas are audited by comparing the roots of their
files, then, level by level, only the children of nodes that differ; what is left at the
leaves are the corrupted records.  All hashing is done by built-in functions; what is
shuffled are hashes, never pages.

Defined cases: a null url or html is an empty string; an empty page is a record without a
body; rows that repeat a page_id are one leaf, their records in the order of their hashes;
rows with a null page_id form one leaf of a file of their own; an empty replica reports
every record of the other one; only page_id, url and html are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.storage import persist

FANOUT = 16
LEVELS = 3
#: page_ids of one file: the leaves of a full tree
FILE_IDS = FANOUT**LEVELS
_KEY = ["file", "node"]


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC/1.0 response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """(file, node, page_id, bytes, hash): one row per page_id."""
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    hashed = made.select("page_id", F.octet_length("r").cast("long").alias("bytes"), F.sha2(F.col("r").cast("binary"), 256).alias("hash"))
    one = hashed.groupBy("page_id").agg(F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list("hash")).alias("h"))
    node = F.expr(f"pmod(page_id, {FILE_IDS}L)")
    file = F.expr(f"(page_id - pmod(page_id, {FILE_IDS}L)) div {FILE_IDS}L")
    joined = F.when(F.size("h") == 1, F.element_at("h", 1)).otherwise(F.sha2(F.array_join("h", ","), 256))
    return one.select(file.alias("file"), node.alias("node"), "page_id", "bytes", joined.alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: nodes over ``FANOUT`` neighbours, hashed over places, lengths and hashes in order."""
    up = level.groupBy("file", F.expr(f"node div {FANOUT}").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), F.col("bytes").alias("b"), F.col("hash").alias("h")))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", F.coalesce(x["n"].cast("string"), F.lit("")), x["b"].cast("string"), x["h"])), ",")
    return up.select("file", "node", "bytes", F.sha2(text, 256).alias("hash"))


def tree(pages: DataFrame) -> list[DataFrame]:
    """The levels of all files' trees, leaves first; each is written once."""
    levels = [persist(leaves(pages), "leaves")]
    for _ in range(LEVELS):
        levels.append(persist(parents(levels[-1]), "nodes"))
    return levels


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in _KEY])


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """(file, page_id, status, start, bytes, replica_bytes) of each leaf that differs; start is
    the offset of its record in its file of the first replica (null if it isn't there), and a
    replica without the record has 0 bytes of it."""
    differ = None
    for level in range(LEVELS, -1, -1):
        a, b = first[level], second[level]
        if differ is not None:
            up = differ.select(F.col("file").alias("__f"), F.col("node").alias("__n"))
            within = lambda df: df.join(up, df["file"].eqNullSafe(up["__f"]) & F.expr(f"node div {FANOUT}").eqNullSafe(up["__n"]), "left_semi")
            a, b = within(a), within(b)
        a = a.withColumn("__here", F.lit(True)).alias("a")
        b = b.select(*[F.col(c).alias(f"b_{c}") for c in (*_KEY, "bytes", "hash", *(["page_id"] if not level else []))], F.lit(True).alias("__there"))
        both = a.join(b, a["file"].eqNullSafe(b["b_file"]) & a["node"].eqNullSafe(b["b_node"]), "full_outer").filter(~F.col("hash").eqNullSafe(F.col("b_hash")))
        pick = lambda c: F.when(F.col("__here"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
        if level:
            differ = persist(both.select(*[pick(c) for c in _KEY]), "differ")
    status = F.when(F.col("__there").isNull(), "missing").when(F.col("__here").isNull(), "extra").otherwise("changed")
    found = persist(both.select(pick("file"), pick("page_id"), pick("node"), status.alias("status"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("b_bytes", F.lit(0)).alias("replica_bytes")), "found")
    # offsets are needed only in files with findings
    files = found.select(F.col("file").alias("__f")).distinct()
    near = first[0].join(files, first[0]["file"].eqNullSafe(files["__f"]), "left_semi")
    near = near.select(F.col("file").alias("__f"), F.col("node").alias("__n"), (F.expr("sum(bytes) OVER (PARTITION BY file ORDER BY node)") - F.col("bytes")).alias("start"))
    out = found.join(near, found["file"].eqNullSafe(near["__f"]) & found["node"].eqNullSafe(near["__n"]), "left")
    return out.select("file", "page_id", "status", "start", "bytes", "replica_bytes")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica as a failing disk might leave it: by a hash of the page_id, about one page in
    256 each has its first character replaced, its last one cut off, or is lost."""
    h = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    html = F.when(h == "00", F.concat(F.lit("~"), F.substring("html", 2, 2147483647))).when(h == "01", F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), h.alias("h")).filter("h <> '02' OR h IS NULL").drop("h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all pages against a damaged replica."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(tree(pages), tree(damaged(pages)))


_FRAME = len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\nContent-Type: text/html\r\nContent-Length: \r\n\r\n\r\n\r\n")

SQL = f"""
WITH a AS (SELECT page_id, url, html, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS h FROM pages),
b AS (
  SELECT *, (page_id - ((page_id % {FILE_IDS}) + {FILE_IDS}) % {FILE_IDS}) // {FILE_IDS} AS file,
    CASE h WHEN '00' THEN '~' || substr(html, 2) WHEN '01' THEN left(html, length(html) - 1) ELSE html END AS copy,
    {_FRAME} + strlen(url) + strlen(CAST(page_id AS VARCHAR)) AS head FROM a),
c AS (
  SELECT *, head + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS size,
    head + strlen(CAST(strlen(copy) AS VARCHAR)) + strlen(copy) AS copied FROM b),
d AS (SELECT *, sum(size) OVER (PARTITION BY file ORDER BY page_id) - size AS start FROM c)
SELECT file, page_id, CASE h WHEN '02' THEN 'missing' ELSE 'changed' END AS status,
  CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS bytes,
  CASE h WHEN '02' THEN 0 ELSE CAST(copied AS BIGINT) END AS replica_bytes
FROM d WHERE h = '02' OR html <> copy
"""
