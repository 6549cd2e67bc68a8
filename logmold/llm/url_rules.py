"""URL filter: host-suffix and path-prefix expressions against a rule table.

A URL stands for one expression per pair of a host suffix and a path prefix
that ends at a slash (as far as any rule reaches: a deeper expression meets
none). Expressions and rules meet on a short hash prefix, an equi-join; a full
digest of host and path then confirms the pair, the rest of the rule's path is
compared, and of the rules that fit the longest wins. Distinct (host, path)
pairs are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.session import ensure_checkpoint_dir

#: Bits of the hash prefix in the join.
PREFIX_BITS = 32
#: The rules are broadcast up to this many; more are joined by shuffle, with
#: each rule copied to ``SALTS`` parts of the expressions, so that a rule that
#: most URLs meet (``com/``) isn't one task.
BROADCAST_RULES, SALTS = 100_000, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BITS // 4)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of its ``url``
    (columns of these names are replaced).

    ``rules (host, path, verdict)``: a rule fits its host and all subdomains if
    the URL's path starts with the rule's; the longest host and path wins, then
    ``block`` before ``allow``. ``rule`` is its host and path together. Where
    none fits, ``rule`` is null and the verdict ``default``. Rules with a null
    part or an empty host fit nothing. Empty tables are fine on either side;
    repeated rows are judged alike.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    new = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(*[pages[c] for c in pages.columns if c not in new], host.alias("host"), path.alias("path"))

    # a rule is looked up by its path as far as the last slash
    known = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
                         F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where(
        "r_host != '' and r_path is not null and r_verdict is not null").distinct()
    stem = F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)
    known = known.withColumn("r_digest", _digest(F.col("r_host"), stem)).withColumn("prefix", _prefix(F.col("r_digest")))
    n, labels, depth = known.agg(
        F.count("*"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("r_path", "/", -1)) - 1), F.lit(0))).first()

    pairs = rows.select("host", "path").distinct()
    label = F.split("host", r"\.", -1)
    part = F.split("path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(label), F.lit(max(labels, 1)))),
                           lambda i: F.array_join(F.slice(label, F.size(label) - i + 1, i), "."))
    stems = F.transform(F.sequence(F.lit(0), F.least(F.size(part) - 1, F.lit(depth))),
                        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(part, 1, i), "/"), F.lit("/"))))
    expressions = pairs.where("host != ''").withColumn("suffix", F.explode(suffixes)).withColumn("stem", F.explode(stems)) \
        .withColumn("digest", _digest(F.col("suffix"), F.col("stem"))).withColumn("prefix", _prefix(F.col("digest")))
    if n <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(known), "prefix")
    else:
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))).join(
            known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["prefix", "salt"])
    fits = met.where((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        *[c for c in rows.columns if c not in new], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
