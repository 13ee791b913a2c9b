"""Closures and bounded walks over graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder that all executors share; a local one only where Spark is one local process."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="arkivel-" + uuid.uuid4().hex[:8]))
    return df.checkpoint()


def small_closure(spark: SparkSession, edges: DataFrame, limit: int = 100_000) -> DataFrame:
    """(a, b): the reflexive-transitive closure of a hierarchy of vocabulary size, closed on the driver.

    Only for ontologies: more than `limit` edges are an error, and call for closure() below.
    """
    rows = edges.select("a", "b").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many edges for the driver; use closure()")
    up: dict[str, set[str]] = {}
    for a, b in rows:
        up.setdefault(a, set()).add(b)
        up.setdefault(b, set())
    out = []
    for a in up:
        seen, open_ = {a}, [a]
        while open_:
            for b in up[open_.pop()]:
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        out += [(a, b) for b in seen]
    return spark.createDataFrame(out, "a string, b string")


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): what each seed reaches over edges (a, b), itself at depth 0, each at its least depth.

    A frontier joins the edges, what was seen goes, until nothing is new; each round is written, so lineage stays short.
    """
    edges = checkpointed(edges.select("a", "b"))  # each round reads them
    seen = checkpointed(seeds.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("root", F.col("b").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """Edges (a, b) of an alternation of predicates."""
    return triples.where(F.col("p").isin(predicates) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def subclass_closure(spark: SparkSession, ontology: DataFrame) -> DataFrame:
    """(a, b): a is b or below it."""
    return small_closure(spark, path(ontology, [V.SUB_CLASS]))


def subproperty_names(spark: SparkSession, ontology: DataFrame, roots: list[str]) -> DataFrame:
    """(name): local names of the properties at or below the roots, and of the storage location."""
    pairs = small_closure(spark, path(ontology, [V.RDFS + "subPropertyOf"]))
    some = pairs.where(F.col("b").isin(roots)).select(V.local_name("a").alias("name"))
    fixed = spark.createDataFrame([(r,) for r in [*roots, "hasStorageLocation"]], "name string").select(V.local_name("name").alias("name"))
    return some.unionByName(fixed).distinct()


def list_members(triples: DataFrame) -> DataFrame:
    """(head, position, member) of all RDF lists."""
    rest = path(triples, [V.RDF + "rest"])
    heads = triples.where(F.col("p") == V.RDF + "first").select(F.col("s").alias("node"))
    walked = closure(rest, heads)
    first = triples.where(F.col("p") == V.RDF + "first").select(F.col("s").alias("node"), F.col("o").alias("member"))
    return walked.join(first, "node").select(F.col("root").alias("head"), F.col("depth").alias("position"), "member")


def range_classes(spark: SparkSession, ontology: DataFrame) -> DataFrame:
    """(p, class): classes a property may point to, those of unions too, with all below them."""
    ranges = ontology.where(F.col("p") == V.RDFS + "range").select(F.col("s").alias("prop"), F.col("o").alias("r"))
    unions = ontology.where(F.col("p") == "http://www.w3.org/2002/07/owl#unionOf").select(F.col("s").alias("r"), F.col("o").alias("head"))
    members = ranges.join(unions, "r").join(list_members(ontology), "head").select("prop", F.col("member").alias("r"))
    named = ranges.join(unions, "r", "left_anti").unionByName(members)
    below = subclass_closure(spark, ontology)
    out = named.join(below, named["r"] == below["b"], "left").select(F.col("prop").alias("p"), F.coalesce("a", "r").alias("class"))
    return out.distinct()


def package_closure(triples: DataFrame, seeds: DataFrame, own: str, stops: list[str], scheme: str = V.SKOS + "inScheme") -> DataFrame:
    """(root, node, depth) over all properties of a namespace but the stops, to subjects that have statements, and back over inScheme."""
    subjects = triples.select(F.col("s").alias("b")).distinct()
    forward = triples.where(F.col("p").startswith(own) & ~F.col("p").isin(stops) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o").alias("b")).join(subjects, "b", "left_semi")
    back = triples.where((F.col("p") == scheme) & (F.col("o_kind") == "iri")).select(F.col("o").alias("a"), F.col("s").alias("b"))
    return closure(forward.select("a", "b").unionByName(back).distinct(), seeds)


def neighbourhood(triples: DataFrame, seeds: DataFrame, depth: int, limit: int = 300) -> tuple[DataFrame, bool]:
    """((node, depth), truncated): nodes within depth (1 to 5) links in either direction, the nearest `limit`.

    Links to literals, types and external addresses do not count; at the limit nodes of a depth come by name.
    """
    depth = max(1, min(5, depth))
    links = triples.where((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE) & ~V.local_name("p").isin("seeAlso", "hasStorageLocation"))
    edges = links.select(F.col("s").alias("a"), F.col("o").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = seeds.select("node").distinct()
    near = closure(edges.distinct(), start, depth).groupBy("node").agg(F.min("depth").alias("depth"))
    top = near.orderBy("depth", "node").limit(limit + 1)
    return top.limit(limit), top.count() > limit


def graph_payload(triples: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for display: group of a node by its types, external addresses as a list of the node, no edges."""
    rico = F.max(F.col("o").startswith(V.RICO) & (F.col("p") == V.TYPE))
    local = F.max(F.col("o").startswith(V.EX) & (F.col("p") == V.TYPE))
    group = F.when(rico, "rico").when(local, "local").otherwise("other")
    external = V.local_name("p").isin("seeAlso", "hasStorageLocation")
    own = triples.join(nodes.select(F.col("node").alias("s")), "s", "left_semi")
    about = own.groupBy("s").agg(group.alias("group"), F.array_sort(F.collect_set(F.when(external, F.col("o")))).alias("links"), F.array_sort(F.collect_set(F.when(F.col("p") == V.TYPE, F.col("o")))).alias("types"))
    edges = own.where((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE) & ~external).join(nodes.select(F.col("node").alias("o")), "o", "left_semi")
    kinds = about.select(F.col("s").alias("node"), "group")
    edges = edges.join(kinds.withColumnsRenamed({"node": "s", "group": "gs"}), "s", "left").join(kinds.withColumnsRenamed({"node": "o", "group": "go"}), "o", "left")
    return about, edges.select("s", "p", "o", V.local_name("p").alias("relation"), (~F.col("gs").eqNullSafe(F.col("go"))).alias("cross"))


def highlighted(nodes: DataFrame, edges: DataFrame, types: list[str], relations: list[str]) -> DataFrame:
    """Edges of a selected relation with an end of a selected type; nothing selected selects all."""
    hit = F.lit(True) if not types else F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))
    hits = nodes.where(hit).select(F.col("s").alias("node"))
    some = edges if not relations else edges.where(F.col("relation").isin(relations))
    both = some.join(hits.select(F.col("node").alias("s")), "s", "left_semi").unionByName(some.join(hits.select(F.col("node").alias("o")), "o", "left_semi").select(some.columns))
    return both.distinct()


def renamed(triples: DataFrame, old: str, new: str) -> DataFrame:
    """A namespace renamed in subjects, properties and objects that are IRIs; literals stay."""
    moved = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 1 << 20))).otherwise(F.col(c))
    return triples.withColumns({"s": F.when(F.col("s_kind") == "iri", moved("s")).otherwise(F.col("s")), "p": moved("p"), "o": F.when(F.col("o_kind") == "iri", moved("o")).otherwise(F.col("o"))})


def tree_rows(triples: DataFrame, root: str, depth: int, own: str, limit: int = 100_000) -> list[tuple[int, str, str]]:
    """(depth, property, node) of a walk in order, outgoing before incoming; a node met again has no children.

    For one package on display: the bounded neighbourhood is collected, and more than `limit` edges are an error.
    """
    links = triples.where(F.col("p").startswith(own) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), "p", F.col("o").alias("b"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = closure(both, triples.sparkSession.createDataFrame([(root,)], "node string"), depth).select(F.col("node").alias("a"))
    rows = links.join(near, "a", "left_semi").unionByName(links.join(near.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "p", "b")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too large for a tree on display")
    out_of: dict[str, list] = {}
    into: dict[str, list] = {}
    for a, p, b in sorted(map(tuple, rows)):
        out_of.setdefault(a, []).append((p, b))
        into.setdefault(b, []).append((p, a))
    seen, out = {root}, [(0, "", root)]

    def walk(node: str, at: int) -> None:
        if at >= depth:
            return
        for p, other in out_of.get(node, []) + into.get(node, []):
            again = other in seen
            seen.add(other)
            out.append((at + 1, p, other))
            if not again:
                walk(other, at + 1)

    walk(root, 0)
    return out
