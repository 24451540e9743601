"""URL rules by a sorted sweep over reversed-host keys.

A rule (host, path) has the key ``reversed host/path``, as ``org.example//en/``; the URLs it fits are those with a key
that begins with it, one interval of the sorted keys. A URL has one key for its host and each domain above. Sorted
together, each key follows the last rule that starts before it; the rules nested there are on that rule's stack, and
those that the key begins with are still open. The deepest is the longest that fits.

Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns

#: (verdict, host, path) in force.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit("/"), path)


def stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with the rules whose keys it begins with, itself included.

    Of rules with one host and path the block holds; rules without host or path are left out.
    """
    own = kept_columns(rules, {"verdict": "string", "host": "string", "path": "string"}).dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.withColumn("key", _key(F.split("host", r"\."), F.col("path")))
    heads = own.select(F.col("key").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    open_ = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), "key", F.concat("host", "path").alias("rule"), "verdict")
    return heads.join(own, "key").groupBy("of").agg(F.array_sort(F.collect_list(open_)).alias("stack")).withColumnRenamed("of", "key")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The rule is null and the verdict ``default`` where none fits. Repeated rows are judged once and come out as often as
    they came in; a null URL has an empty host and path.
    """
    spark = pages.sparkSession
    pages = kept_columns(pages, {"page_id": "bigint", url: "string"}).withColumnRenamed(url, "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
    stack = stacks(rules)
    # Rules reach no deeper than their longest host.
    depth = stack.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    level = lambda n: _key(F.slice(labels, F.size(labels) - n + 1, n), F.col("path"))
    keys = pages.select("page_id", "url", "copies", "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), level)).alias("key"))
    # Every share of the URLs meets all rules, which are few beside them, so that a popular host fills no one task.
    shares = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(shares)).cast("int")
    starts = stack.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "key", F.lit(0).alias("turn"), "stack")
    swept = keys.select(share.alias("share"), "key", F.lit(1).alias("turn"), "page_id", "url", "copies", "host", "path").unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("share").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("turn = 1")
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    top = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    best = swept.select("page_id", "url", "copies", "host", "path", top.alias("top")).groupBy("page_id", "url", "copies", "host", "path").agg(F.max("top").alias("top"))
    out = best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


SQL = f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN m ON m.k = p.k AND n = 1
"""
