"""robots.txt files as a table of rules, and verdicts on paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def parse(files: DataFrame) -> DataFrame:
    """(site, agent, allow, rule) from (site, text). Lines of agents in a row share the rules that follow."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = files.select("site", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    rows = rows.select("site", "pos", F.lower(F.trim(F.regexp_extract(line, "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1)).alias("value"))
    rows = rows.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("site").orderBy("pos")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(w))
    agents = rows.filter("field = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    rules = rows.filter("field <> 'user-agent'").select("site", "grp", (F.col("field") == "allow").alias("allow"), F.col("value").alias("rule"))
    return agents.join(rules, ["site", "grp"], "left").select("site", "agent", "allow", "rule")


def verdicts(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (site, agent, path) with allowed and rule. The longest agent name that the agent holds counts, else *;
    of the matching rules the longest, an allowing one before a forbidding one; without any the path is allowed."""
    a = asked.withColumn("_q", F.monotonically_increasing_id())
    r = rules.withColumnRenamed("agent", "named")
    both = a.join(r, "site", "left").filter(F.col("named").isNull() | (F.col("named") == "*") | F.lower("agent").contains(F.col("named")))
    size = F.when(F.col("named") == "*", 0).otherwise(F.length("named"))
    most = F.max(size).over(W.partitionBy("_q"))
    both = both.withColumn("_m", most).filter(F.coalesce(size, F.lit(-1)) == F.coalesce("_m", F.lit(-1)))
    # a rule as a pattern: * is any run, a closing $ is the end
    literal = F.regexp_replace(F.regexp_replace("rule", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(literal, r"\\\$$", r"\$"))
    fits = F.coalesce((F.col("rule") != "") & F.expr("true"), F.lit(False)) & F.regexp_like("path", pattern)
    best = both.groupBy("_q").agg(F.max(F.when(fits, F.struct(F.length("rule").alias("n"), "allow", "rule"))).alias("b"))
    return a.join(best, "_q", "left").select("site", "agent", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"), F.col("b.rule").alias("rule"))
