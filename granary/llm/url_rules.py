"""URL filter: a sort-merge range join of pages with nested prefix rules, in DataFrame operations alone.

A rule (host, path) fits its host and all subdomains where the path begins with the rule's.  Keys are canonical: a node (the
first labels of the reversed host), a zero byte, the path, as bytes.  At a rule's node it fits a page if its key is a prefix
of the page's, so it is the interval from its key to its key and byte FF.  Intervals nest.  A first sweep over the ends of
the rules' intervals alone keeps the stack of active rules - a running sum is its height, the last rule opened at each height
is its slot - and marks every end with the rule then on top.  A second sweep passes over pages and marked ends together: the
last mark before a page is its rule at that node.  A page stands once for each depth at which rules have hosts, all
depths are swept at once, and the longest of its rules wins; so the plan does not grow with the rules.

Skew: a swept group is a node, dealt in ``ceil(4 P n / N)`` salts (n of N pages are at the node, P shuffle partitions), to
each of which the node's marks are copied, but to no more salts than keep the copies below its pages.

Defined results: host and path of a null url or one without ``://`` are empty and only a rule of an empty host could fit;
the longest rule wins, by characters of host and path together, then the longer host; a rule that is both blocked and
allowed blocks; rules with a null host or path are none; without a rule the verdict is ``allow``.  Repeated pages are kept,
null ids too; columns of the input named host, path, rule or verdict give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, lower_ascii

DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(node: Column, path: Column) -> Column:
    return F.concat(F.encode(node, "utf-8"), F.unhex(F.lit("00")), F.encode(path, "utf-8"))


def _marks(rules: DataFrame) -> DataFrame:
    """node, key and top: at every end of a rule's interval the innermost rule that is active from there on, if any."""
    start = rules.select("node", _key(F.col("node"), F.col("r_path")).alias("key"), F.lit(1).alias("step"), F.struct("r_host", "r_path", "r_verdict").alias("rule"))
    end = start.select("node", F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(start.schema["rule"].dataType).alias("rule"))
    upto = Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = cut(start.unionByName(end).withColumn("height", F.sum("step").over(upto)), "ends")
    deepest = swept.agg(F.max("height")).first()[0] or 0
    slot = lambda h: F.last(F.when((F.col("step") == 1) & (F.col("height") == h), F.col("rule")), ignorenulls=True).over(upto)
    tops = [F.when(F.col("height") == h, slot(h)) for h in range(1, deepest + 1)]
    return swept.select("node", "key", (F.coalesce(*tops) if tops else F.col("rule")).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict ("block" or "allow")."""
    spark = pages.sparkSession
    own = pages.columns
    host, path = split_url(F.col("url"))
    tidy = (
        rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull())
        .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block is above allow
        .withColumn("node", F.array_join(_labels(F.col("r_host")), "."))
    )
    marks = cut(_marks(tidy), "marks")
    depths = sorted(r["d"] for r in tidy.select(F.size(_labels(F.col("r_host"))).alias("d")).distinct().collect())  # labels of a host: a few, 127 at most
    # one column __in of all that a page has keeps clashing names apart
    whole = cut(pages.select(F.monotonically_increasing_id().alias("__id"), F.struct(*own).alias("__in"), host.alias("host"), path.alias("path")), "pages")
    labels = _labels(F.col("host"))
    at = F.filter(F.transform(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>"), lambda d: F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.lit(1), d), "."))), lambda x: x.isNotNull())
    paged = whole.select("__id", "path", F.explode(at).alias("node"))
    # nodes with rules, their pages and marks, and the salts these give
    ends = marks.groupBy("node").agg(F.count("*").alias("r"))
    met = paged.join(ends, "node").groupBy("node").agg(F.count("*").alias("n"), F.first("r").alias("r"))
    share = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = F.least(F.ceil(F.col("n") * share / max(1, whole.count())), F.floor(F.col("n") / F.col("r")))
    salts = cut(met.select("node", F.greatest(F.lit(1), wanted).cast("int").alias("salts")), "salts")
    salted = paged.join(salts, "node").select("__id", "node", F.pmod(F.xxhash64("__id"), F.col("salts")).cast("int").alias("salt"), _key(F.col("node"), F.col("path")).alias("key"))
    copies = marks.join(salts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", F.struct("top").alias("mark"))
    line = salted.unionByName(copies, allowMissingColumns=True)
    # at one key a start comes before pages; ends never meet another key, as FF is no byte of UTF-8
    sweep = Window.partitionBy("node", "salt").orderBy("key", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.select("__id", F.last("mark", ignorenulls=True).over(sweep)["top"].alias("top")).where(F.col("__id").isNotNull() & F.col("top").isNotNull())
    length = F.length("top.r_host") + F.length("top.r_path")
    best = seen.groupBy("__id").agg(F.max_by("top", F.struct(length, F.length("top.r_host"))).alias("best"))
    return whole.join(best, "__id", "left").select(
        *[F.col("__in").getField(c).alias(c) for c in own if c not in ("host", "path", "rule", "verdict")], "host", "path",
        F.concat(F.col("best.r_host"), F.col("best.r_path")).alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )
