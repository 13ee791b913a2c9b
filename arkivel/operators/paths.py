"""Places in node tables by paths: strict element paths, dotted names, and meanings found by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_paths(nodes: DataFrame, most: int = 64) -> DataFrame:
    """nodes with path (/a/b[2]/c: an index from 1 at each step that has siblings of its name) and names (/a/b/c).

    One join for each level of depth, of which there are most at most; a level without nodes ends it. Levels grow with
    the input, and decoded rows are far more than the files' size lets Spark expect: they are merged, never broadcast.
    """
    same = W.partitionBy("doc_id", "parent_id", "name")
    step = F.when(F.count("*").over(same) > 1, F.concat("name", F.lit("["), F.row_number().over(same.orderBy("node_id")).cast("string"), F.lit("]"))).otherwise(F.col("name"))
    steps = nodes.withColumn("__step", step)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    if deepest > most:
        raise ValueError(f"{deepest} levels; {most} are followed")
    level = steps.where("depth = 0").withColumns({"path": F.concat(F.lit("/"), "__step"), "names": F.concat(F.lit("/"), "name")})
    out = level
    for depth in range(1, deepest + 1):
        above = level.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("__path"), F.col("names").alias("__names"))
        level = steps.where(F.col("depth") == depth).join(above.hint("merge"), ["doc_id", "parent_id"])
        level = level.withColumns({"path": F.concat("__path", F.lit("/"), "__step"), "names": F.concat("__names", F.lit("/"), "name")}).select(*out.columns)
        out = out.unionByName(level)
    return out.drop("__step")


def strict(paths: DataFrame, path: str) -> DataFrame:
    """The nodes at an element path; a step without an index stands for [1] where there are several."""
    plain = F.regexp_replace("path", r"\[1\]", "")
    return paths.where(plain == path.replace("[1]", ""))


def normal(name: Column) -> Column:
    """A name without case, underscores and indexes."""
    return F.lower(F.regexp_replace(name, r"_|\[\d+\]", ""))


def dotted(paths: DataFrame, path: str) -> DataFrame:
    """The nodes at a.b.c below the root: arrays are looked through, names compare without case and underscores."""
    wanted = "/" + path.replace(".", "/")
    below = F.regexp_replace(normal(F.col("names")), "^/[^/]*", "")
    return paths.where(below == normal(F.lit(wanted)))


def described(paths: DataFrame, meanings: DataFrame) -> DataFrame:
    """(path, meaning) of the distinct names of nodes by meanings (path, meaning).

    A meaning belongs to the very same path; if none does, to one whose steps are all in the node's path in order, the
    last one last, if only one meaning is of that kind. Both are joined on the last step.
    """
    own = paths.select("names").distinct().select("names", normal(F.col("names")).alias("__full"))
    own = own.withColumn("__last", F.substring_index("__full", "/", -1))
    given = meanings.select(normal(F.concat(F.lit("/"), F.ltrim(F.col("path"), F.lit("/")))).alias("__given"), "meaning")
    given = given.withColumn("__tail", F.substring_index("__given", "/", -1))
    pattern = F.concat(F.lit("^(/[^/]+)*?"), F.regexp_replace("__given", "/([^/]+)", "(/[^/]+)*?/$1"), F.lit("$"))
    both = own.join(given, F.col("__last") == F.col("__tail")).where(F.rlike("__full", pattern))
    found = both.groupBy("names").agg(F.max(F.when(F.col("__full") == F.col("__given"), F.col("meaning"))).alias("exact"), F.countDistinct("__given").alias("n"), F.min("meaning").alias("any"))
    return found.select(F.col("names").alias("path"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("any"))).alias("meaning")).where("meaning is not null")
