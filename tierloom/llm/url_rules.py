"""URL filter rules as nested key intervals, matched by a sorted sweep.

A host is keyed by its labels in reverse order, each followed by a dot, so that a host and its
subdomains form one interval of keys; a path prefix likewise is an interval of paths. Intervals
nest or are disjoint. The sweep sorts keys and rule starts together. The last start at or before a
key names the stack of rules that are open there, and those whose interval holds the key enclose it.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.llm.common import parts, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, starts: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    """Attach to each point the stack of the last rule start at or before it.

    ``starts`` has ``key`` and ``stack`` (the start's own interval and those around it, outermost
    first), one row per distinct key. Rows are dealt by ranges of (scope, key, a hash of the row), so
    a key that very many points share is cut into several ranges; the stack open at the beginning
    of a range comes from a table with one row per range.
    """
    scopes = [scope] if scope else []
    payload = F.struct(*[F.col(c) for c in points.columns])
    both = points.select(*scopes, key, F.lit(1).alias("_side"), payload.alias("_row"),
                         F.lit(None).cast(starts.schema["stack"].dataType).alias("stack")).unionByName(
        starts.select(*scopes, key, F.lit(0).alias("_side"), F.lit(None).cast(points.schema).alias("_row"), "stack"))
    order = [*scopes, key, "_side", "_salt"]
    # Written once: the number of a range must not change between the two reads below.
    ranged = stored(
        both.withColumn("_salt", F.xxhash64("_row")).repartitionByRange(parts(points), *order)
        .withColumn("_range", F.spark_partition_id()), "sweep")
    last = ranged.filter("_side = 0").groupBy("_range").agg(
        F.max_by(F.struct(*scopes, "stack"), F.struct(*scopes, key)).alias("_open"))
    ranges = ranged.select("_range").distinct().join(last, "_range", "left").withColumn(
        "_before", F.last("_open", ignorenulls=True).over(
            Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_before")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("stack").isNotNull(), F.struct(*scopes, "stack"))
    found = (
        ranged.withColumn("_here", F.last(opened, ignorenulls=True).over(within)).filter("_side = 1")
        .join(F.broadcast(ranges), "_range")  # one row per range, as many as shuffle partitions
        .withColumn("_top", F.coalesce("_here", "_before"))
    )
    same = F.col("_top." + scope).eqNullSafe(F.col(scope)) if scope else F.lit(True)
    return found.select("_row.*", F.when(same, F.col("_top.stack")).alias("stack"))


def with_stacks(rules: DataFrame, key: str, prefixes: Column, scope: str | None = None) -> DataFrame:
    """One row per distinct rule key with the keys that are prefixes of it, outermost first."""
    scopes = [scope] if scope else []
    keys = rules.select(*scopes, key).distinct()
    around = keys.withColumn("_own", F.col(key)).withColumn(key, F.explode(prefixes)).join(keys, [*scopes, key])
    return around.groupBy(*scopes, "_own").agg(F.sort_array(F.collect_set(key)).alias("stack")).withColumnRenamed("_own", key)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to rows with a url.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the path of the
    url starts with the rule's. The longest rule text wins; of rules of one length ``block`` wins,
    then the smaller text. A url that no rule fits gets ``default``. Null urls and urls without
    ``://`` have an empty host and path. Rows with a null or empty host rule are ignored; repeated
    rules count once. Columns of ``pages`` named like the added ones are replaced; repeated rows stay.

    The host sweep leaves one small stack of rule hosts per url (at most its number of labels); each
    of these hosts is then swept by path, so a host with very many path rules stays split as well.
    """
    known = rules.filter("host is not null and host <> ''").select(
        "host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    text = F.concat("host", F.when(F.col("path") == "", F.lit("")).otherwise(F.col("path")))
    best = (
        known.withColumn("rule", text).groupBy("host", "path")
        .agg(F.min_by("verdict", F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1), "verdict")).alias("verdict"),
             F.min("rule").alias("rule"))
    )
    base = pages.drop("host", "path", "rule", "verdict")
    rows = base.withColumn("_url", F.struct(*base.columns)).select(
        "_url", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # Judge each distinct address once; the rows that share it come back by an adaptive join.
    addresses = rows.select("host", "path").distinct().withColumn("hkey", host_key(F.col("host")))
    labels = F.split("hkey", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(labels) - 1),
                       lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    hosts = with_stacks(best.withColumn("hkey", host_key(F.col("host"))), "hkey", cuts)
    open_hosts = sweep(addresses, hosts, "hkey")
    fits = F.filter("stack", lambda k: F.col("hkey").startswith(k))
    by_host = open_hosts.select("host", "path", F.explode(fits).alias("rkey"))
    path_rules = best.withColumn("rkey", host_key(F.col("host"))).withColumnRenamed("path", "pkey")
    each = F.transform(F.sequence(F.lit(0), F.length("pkey")), lambda n: F.substring("pkey", F.lit(1), n))
    starts = with_stacks(path_rules, "pkey", each, "rkey")
    opened = sweep(by_host.withColumn("pkey", F.col("path")), starts, "pkey", "rkey")
    inner = F.try_element_at(F.filter("stack", lambda k: F.col("pkey").startswith(k)), F.lit(-1))
    won = (
        opened.select("host", "path", "rkey", inner.alias("pkey")).filter("pkey is not null")
        .join(path_rules.select("rkey", "pkey", "rule", "verdict"), ["rkey", "pkey"])
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "verdict"),
                      F.struct(-F.length("rule"), F.when(F.col("verdict") == "block", 0).otherwise(1), "rule")).alias("_won"))
    )
    return rows.join(won, ["host", "path"], "left").select(
        "_url.*", "host", "path", F.col("_won.rule").alias("rule"),
        F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))
