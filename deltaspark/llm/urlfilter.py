"""URL filters: host-suffix and path-prefix expressions joined to a rule list.

Each different (host, path) is expanded into expressions, one for each suffix
of its host at a label border and each prefix of its path as long as some
rule's path. Expressions meet the rules by an equi-join on a short hash prefix;
full digests confirm, and the longest rule wins (host and path together; among
equally long ones the longer host, then block). Only DataFrame functions run.

Expressions are counted before they meet the rules, so the join by short prefix
sees each different one once; rules with equal prefixes travel as one array,
and the confirmation picks from it. What was found returns to the expressions'
places and these to the rows by joins in which counted hot keys (a URL or an
expression that many rows share) are broadcast, see _store.joined. Rows without
a host meet nothing and take no part.

Defined results: host and path of a null URL or one without `://` are empty
and no rule fits them; a URL without a fitting rule is allowed; repeated rows
are judged as often as they occur; an empty table gives an empty result; rules
whose host or path is null are ignored; further columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

#: Hex digits of the short hash prefix.
SHORT = 7

#: Host, path and verdict of the production rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, SHORT), 16, 10).cast("int")


def judge(pages: DataFrame, rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (page_id by default), then host, path, rule and verdict.

    rules: host, path, verdict ('allow' or 'block').
    """
    keep = keep or ["page_id"]
    host, path = split_url(F.col("url"))
    # other names inside, so that none of the kept columns' clashes with ours
    own = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    clean = rules.where("host is not null and path is not null").select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "verdict")
    known = clean.withColumn("digest", _digest(F.col("host"), F.col("path")))
    listed = known.groupBy(_short(F.col("digest")).alias("short")).agg(F.collect_set(F.struct("digest", "host", "path", "verdict")).alias("rules"))
    # as many numbers as the rules' paths have different lengths
    lengths = sorted(r["n"] for r in clean.select(F.length("path").alias("n")).distinct().collect())

    places = _store.cut(own.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = places.select("host", "path", F.explode(suffixes).alias("e_host"), fitting.alias("sizes"))
    expanded = expanded.select("host", "path", "e_host", F.explode("sizes").alias("size"))
    # one digest may stand for two ways to cut host from path, so the host's length belongs to the expression
    expanded = expanded.select("host", "path", _digest(F.col("e_host"), F.substring(F.col("path"), F.lit(1), F.col("size"))).alias("digest"), F.length("e_host").alias("host_size"))
    asked = expanded.groupBy("digest", "host_size").agg(F.count(F.lit(1)).alias("times")).withColumn("short", _short(F.col("digest")))
    met = asked.join(listed, "short")
    confirmed = F.filter("rules", lambda r: (r["digest"] == F.col("digest")) & (F.length(r["host"]) == F.col("host_size")))
    rank = F.transform(
        confirmed,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("size"),
            F.length(r["host"]).alias("host_size"),
            (r["verdict"] == "block").alias("blocks"),
            F.concat(r["host"], r["path"]).alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    found = _store.cut(met.select("digest", "host_size", "times", F.array_max(rank).alias("rank")).where("rank is not null"))
    ruled = _store.joined(expanded, found, ["digest", "host_size"], "times").groupBy("host", "path").agg(F.max("rank").alias("best"))
    best = _store.cut(places.join(ruled, ["host", "path"], "left").select("host", "path", "rows", "best.rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))
    nothing = own.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    judged = _store.joined(own.where("host <> ''"), best, ["host", "path"], "rows").drop("rows").unionByName(nothing)
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict")
