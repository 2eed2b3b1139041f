"""URL filter: block and allow rules on (host, path prefix), DataFrame functions only.

A host is turned into a canonical key, its labels reversed and each closed by
a dot (``a.example.net`` -> ``net.example.a.``). A rule's host key is a prefix
of the keys of the host itself and of all subdomains, and a rule's path is a prefix of the paths that it
fits, so a rule covers one interval of the sorted keys, and the intervals of all rules nest or are
disjoint. Points and rules are range-partitioned and sorted by key together; one sweep per range
finds the last rule that opened at or before each point. The stack of active nested rules is that
rule's chain: itself and all rules whose keys are prefixes of its key. (A rule that covers the point
stands before it, and all rules between them start with its key, so it is in the
chain of the last one.) What opened before a range begins is handed on to it as one row.

Two sweeps: distinct hosts against rule hosts give each host the rule hosts that
cover it, at most one for each label; then distinct (rule host, path) points against the rules.
No row holds more than the rules that nest in each other; a host's other rules, however many, are rows of their own.

Defined results: a null url or one without ``://`` has empty host and path. A
rule whose path is empty fits every path. Of the fitting rules the longest
(host plus path) wins, then the longer host, then block before allow. Without
a fitting rule the verdict is the default. Rule rows with null host count as
empty host, which fits only an empty host and hosts that end in a dot (an empty last label); rule hosts hold no NUL; null paths count as empty, null
actions as block. Repeated urls and repeated rows are each judged. Empty
tables give empty results. Only the named columns are read, so others may
have any name.

Size: pages are shuffled as (key, path), never with their HTML; equal URLs are one
point of the sweeps, and the adaptive skew join splits them on the page side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtext.llm.common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEAM = "\x00"  # between a rule's host key and its path

PRODUCTION_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given in code, as rows (host, path, action)."""
    structs = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    none = F.expr("cast(array() as array<struct<host:string,path:string,action:string>>)")
    return spark.range(1).select(F.inline(F.array(*structs) if structs else none))


def chains(rules: DataFrame, prefixes: Column) -> DataFrame:
    """(key, chain): every distinct key of ``rules`` with all keys among them that are prefixes of it, shortest first.

    ``prefixes`` gives the prefixes of a key that could be keys, itself included."""
    keys = rules.select("key").distinct()
    met = keys.select("key", F.explode(prefixes).alias("prefix")).join(keys.select(F.col("key").alias("prefix")), "prefix")
    return met.groupBy("key").agg(F.sort_array(F.collect_set("prefix")).alias("chain"))


def sweep(points: DataFrame, chained: DataFrame, ranges: int) -> DataFrame:
    """(key, open): for every distinct key of ``points`` the keys of the rules that cover it, shortest first."""
    none = F.lit(None).cast("array<string>")
    both = points.select("key").distinct().select("key", F.lit(True).alias("is_point"), none.alias("chain"))
    both = both.unionByName(chained.select("key", F.lit(False).alias("is_point"), "chain"))
    both = materialise(both.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "url-points")
    # one row a range: the chain of its last rule, handed on to the ranges after it
    last = both.groupBy("part").agg(F.max_by("chain", F.when(~F.col("is_point"), F.col("key"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("part").orderBy("key", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("own", F.last("chain", ignorenulls=True).over(inside)).where("is_point").join(carried, "part")
    return swept.select("key", F.filter(F.coalesce("own", "carried", F.expr("cast(array() as array<string>)")), lambda c: F.col("key").startswith(c)).alias("open"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per page: the id, host, path, the winning rule's string and the verdict."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("host_key", host_key(F.col("host")))
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.coalesce("action", F.lit("block")).alias("action")
    ).withColumn("rule_key", host_key(F.col("rule_host")))

    # the rule hosts that cover each host
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    by_label = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    hosts = sweep(urls.select(F.col("host_key").alias("key")), chains(rules.select(F.col("rule_key").alias("key")), by_label), ranges)
    covered = hosts.select(F.col("key").alias("host_key"), F.explode("open").alias("rule_key"))

    # the rules that cover each (rule host, path)
    whole = F.concat("rule_key", F.lit(SEAM), "rule_path")
    of_host = F.instr("key", SEAM)
    by_letter = F.transform(F.sequence(of_host, F.length("key")), lambda n: F.substr("key", F.lit(1), n))
    asked = urls.select("host_key", "path").distinct().join(covered, "host_key").withColumn("key", F.concat("rule_key", F.lit(SEAM), "path"))
    found = sweep(asked, chains(rules.select(whole.alias("key")), by_letter), ranges)
    longest = found.select("key", F.try_element_at("open", F.lit(-1)).alias("rule")).where("rule is not null")
    best = rules.groupBy(whole.alias("rule"), "rule_host", "rule_path").agg(F.max("action").alias("action"))  # block before allow
    fits = asked.join(longest, "key").join(best, "rule")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "action", F.concat("rule_host", "rule_path").alias("rule"))
    judged = urls.join(fits.groupBy("host_key", "path").agg(F.max(rank).alias("best")), ["host_key", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, PRODUCTION_RULES))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS p FROM pages
), r AS (
  SELECT page_id, CASE WHEN p = 0 THEN '' ELSE substr(url, p + 3) END AS rest FROM u
), s AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host0, rest FROM r
), t AS (
  SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path
  FROM s
), rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS rn
  FROM t JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT t.page_id, t.host, t.path, h.rule, coalesce(h.action, 'allow') AS verdict
FROM t LEFT JOIN hits h ON h.page_id = t.page_id AND h.rn = 1
"""
