"""URL rules by hashed expressions: host suffixes and path prefixes.

Every URL is expanded into the expressions ``suffix of its host`` + ``prefix of
its path that ends in a slash``; the expressions meet the rules in an equi-join
on the first 4 bytes of their SHA-256, the full digest then confirms the match,
and of the rules that match the longest wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: host and path, and what they say.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Up to so many rules, of so many bytes in all, are broadcast; more are shuffled.
BROADCAST_RULES, BROADCAST_BYTES = 20_000, 8_000_000
PREFIX = 8  # hexadecimal digits of the short hash


def host_and_path(url) -> tuple:
    """Columns host and path of a URL column; both empty for null and where ``://`` is missing."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """The rules as a table that the plan itself holds."""
    quoted = [tuple("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) for r in rules]
    if not quoted:
        return spark.sql("SELECT '' AS rule, '' AS verdict WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({r}, {v})" for r, v in quoted) + " AS t(rule, verdict)")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict) for each row of ``pages``.

    A rule is ``host/path/`` in lower-case host letters, its path ending in a
    slash; another, or a null, raises an error; of rules with the same text the least verdict holds. A rule fits its
    host and every subdomain where the path begins with the rule's; the longest
    rule wins, and URLs that none fits get ``default``. An empty path fits no
    rule, nor does an empty host. Repeated rows stay; other columns are not
    read; an empty table, of pages or of rules, is allowed.

    Expressions longer than any rule's host or path are not made, as they can
    match nothing. Up to ``BROADCAST_RULES`` rules are broadcast: then a page's
    expressions never leave its task. More rules are joined by shuffle to the
    distinct expressions, so that a frequent host is no hot key.
    """
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict"))
    slash = F.instr("rule", "/")
    bound = rules.agg(F.count("*"), F.max(slash), F.max(F.length("rule") - slash), F.sum(F.octet_length("rule") + F.octet_length("verdict")), F.count_if(~F.coalesce(F.col("rule").like("%/"), F.lit(False)))).first()
    if bound[4]:
        raise ValueError(f"{bound[4]} rules do not end in a slash")
    count, longest_host, longest_path = bound[0], (bound[1] or 1) - 1, (bound[2] or 0) + 1
    digest = F.sha2("rule", 256)
    rules = rules.select("rule", "verdict", digest.alias("full"), F.substring(digest, 1, PREFIX).alias("short"))

    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")),
        lambda x: (F.length(x) > 0) & (F.length(x) <= longest_host),
    )
    head = F.substring("path", 1, longest_path)
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(head), F.lit(1))), lambda k: F.substring(head, F.lit(1), k)), lambda x: F.endswith(x, F.lit("/")))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    confirmed = F.col("digest") == F.col("full")  # kept out of the joins, which meet on the short hashes alone
    best = F.max(F.when(confirmed, F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best")
    if count <= BROADCAST_RULES and (bound[3] or 0) <= BROADCAST_BYTES:
        each = base.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256))
        matched = each.withColumn("short", F.substring("digest", 1, PREFIX)).join(F.broadcast(rules), "short", "left")
        out = matched.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    else:
        # one row for each distinct host and head of a path, judged once
        keyed = base.withColumn("head", F.regexp_extract(head, r"(?s)^(.*/)?", 0))
        keys = keyed.select("host", "head").distinct().withColumn("path", F.col("head"))
        each = keys.withColumn("expression", F.explode(expressions))
        hits = each.select("expression").distinct().withColumn("digest", F.sha2("expression", 256))
        hits = hits.withColumn("short", F.substring("digest", 1, PREFIX)).join(rules.hint("merge"), "short").groupBy("expression").agg(best).filter("best IS NOT NULL")
        judged = each.join(hits.hint("merge"), "expression").groupBy("host", "head").agg(F.max("best").alias("best"))
        out = keyed.join(judged.hint("merge"), ["host", "head"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
