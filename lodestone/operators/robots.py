"""Crawler rules: groups of a robots file, and the rule that decides for an agent and a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Crawlers that are checked, by what they are for.
AGENTS = {"general_crawl": "*", "openai_search": "OAI-SearchBot", "openai_training": "GPTBot"}


def rules(robots: DataFrame, key: str) -> DataFrame:
    """Rules (key, ord, agent, allow, path) of robots (key, body), an empty disallow as a rule without path.

    Lines that name agents in a row share the rules below them. The lines of one file are numbered in its own window.
    """
    lines = robots.select(key, F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("ord", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.where(F.contains("line", F.lit(":"))).select(key, "ord", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy(key).orderBy("ord")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group", F.sum(starts.cast("int")).over(w))
    agents = grouped.where("field = 'user-agent'").select(key, "group", F.lower("value").alias("agent")).distinct()
    acts = grouped.where("field <> 'user-agent'").select(key, "group", "ord", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(acts, [key, "group"], "left").select(key, "ord", "agent", "allow", F.when(F.col("path") != "", F.col("path")).alias("path"))


def rule_pattern(path: Column) -> Column:
    """The regular expression of a rule's path: * is anything, $ anchors only at the end."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.substring(path, 1, F.length(path) - 1)).otherwise(path)
    quoted = F.regexp_replace(body, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(anchored, "$").otherwise(""))


def access(pages: DataFrame, parsed: DataFrame, key: str, agents: dict[str, str] | None = None) -> DataFrame:
    """pages (page, key, path) by agent kind with `allowed` and the deciding rule.

    parsed: rules() of each key. The longest agent name that begins the crawler's decides the groups, the longest
    rule among theirs decides, and allowing wins a tie; no rule allows. A path is matched without its query.
    """
    agents = agents or AGENTS
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("name")) for k, a in agents.items()])).alias("a")
    wanted = parsed.select(key).distinct().select(key, kinds).select(key, F.col("a.kind").alias("kind"), F.lower("a.name").alias("name"))
    fits = (F.col("agent") == "*") | (F.col("name") != "*") & F.col("name").startswith(F.col("agent"))
    weight = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    own = wanted.join(parsed, key).where(fits).withColumn("weight", weight)
    best = own.groupBy(key, "kind").agg(F.max("weight").alias("weight"))
    active = own.join(best, [key, "kind", "weight"]).where("path IS NOT NULL").select(key, "kind", "allow", "path")
    # identical rules of merged groups are one
    active = active.distinct().select(key, "kind", "allow", F.col("path").alias("rule"), rule_pattern(F.col("path")).alias("pattern"), F.length(F.regexp_replace("path", r"[*$]", "")).alias("size"))
    all_of = pages.select("page", key, "path", F.explode(F.array(*[F.lit(k) for k in agents])).alias("kind"))
    hits = all_of.join(active, [key, "kind"]).where(F.regexp_like("path", F.col("pattern")))
    top = hits.groupBy("page", "kind").agg(F.max(F.struct("size", "allow", "rule")).alias("m"))
    return all_of.join(top, ["page", "kind"], "left").select("page", key, "kind", F.coalesce("m.allow", F.lit(True)).alias("allowed"), F.col("m.rule").alias("rule"))


def technical_status(robots_ok: Column) -> Column:
    return F.when(robots_ok, "complete").otherwise("partial")


def noindex(directives: Column) -> Column:
    return F.exists(directives, lambda d: d.isin("noindex", "none"))
