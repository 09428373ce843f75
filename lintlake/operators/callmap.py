"""Maps of who calls whom: typed edges, flows from entries within a budget, and the longest chains of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators import graphs
from lintlake.operators.graphs import cut, long, shared

MAX_NODES, MAX_DEPTH, DEEP_CHAIN = 320, 20, 8


def call_edges(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, type) between methods by full name: calls of own methods, of other classes' static ones, and of methods of what
    a constructor takes as a property. A class is named in full, or by its only class of that base name."""
    own = methods.join(long(classes.select("path", F.col("name").alias("class"), "fqcn")), ["path", "class"])
    src = F.concat_ws("::", "fqcn", "name")
    calls = lambda p, i: F.regexp_extract_all("quiet", F.lit(p), i)
    inner = own.select(src.alias("src"), F.col("fqcn").alias("raw"), F.explode(calls(r"(?:\$this\s*->|\b(?:self|static)::)\s*(\w+)\s*\(", 1)).alias("called"))
    static = r"(?<![\w\\])(?!self\b|static\b|parent\b)([A-Z][\w\\]*)::(\w+)\s*\("
    outer = own.select(src.alias("src"), F.explode(F.arrays_zip(calls(static, 1).alias("raw"), calls(static, 2).alias("called"))).alias("x")).select("src", "x.raw", "x.called")
    typed = r"([A-Z\\][\w\\]*)\s+\$(\w+)"
    held = own.filter("name = '__construct'").select("fqcn", F.explode(F.arrays_zip(F.regexp_extract_all("head", F.lit(typed), 1).alias("raw"), F.regexp_extract_all("head", F.lit(typed), 2).alias("property"))).alias("x")).select("fqcn", "x.raw", "x.property")
    through = r"\$this\s*->\s*(\w+)\s*->\s*(\w+)\s*\("
    used = own.select("fqcn", src.alias("src"), F.explode(F.arrays_zip(calls(through, 1).alias("property"), calls(through, 2).alias("called"))).alias("x")).select("fqcn", "src", "x.property", "x.called")
    raw = inner.unionByName(outer).unionByName(used.join(long(held), ["fqcn", "property"]).select("src", "raw", "called")).withColumn("raw", F.regexp_replace("raw", r"^\\", ""))
    known = graphs.unresolved_to_known(raw.select("raw").distinct(), classes.select("fqcn").distinct())
    full = raw.join(long(known.filter("fqcn is not null")), "raw").select("src", F.concat_ws("::", "fqcn", "called").alias("dst"))
    return full.join(long(own.select(src.alias("dst")).distinct()), "dst", "left_semi").select("src", "dst", F.lit("calls").alias("type")).distinct()


def flows(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, node, depth, n_nodes, truncated, cycle): what each start (node) reaches over edges (src, dst, type) of these types, level by
    level, by name within a level, up to `max_nodes` nodes and `max_depth` steps. `truncated` says that the flow met either
    limit, `cycle` that some edge led to a node of the flow that another had led to before.

    A start's flow is at most `max_nodes` rows, each with the number of edges that led to it. A level joins the nodes of the level before with
    their edges; what is new, what is taken and what is counted is then found by start, in one shuffle. No more of a node's edges
    are followed than could still be new, the first by name, so a hub's edges don't multiply with the starts: they are looked up between the nodes of a flow."""
    shared(edges)
    e = edges if types is None else edges.filter(F.col("type").isin(*types))
    most, by_name = 2 * max_nodes, Window.partitionBy("src").orderBy("dst")
    first = e.select("src", "dst", F.dense_rank().over(by_name).alias("nth")).filter(F.col("nth") <= most + 1)
    near = cut(first.withColumn("before", F.lag("nth", 1, 0).over(by_name)).filter("before < nth").drop("before"))
    hubs = near.filter(F.col("nth") > most).select("src")
    hubs = None if hubs.isEmpty() else hubs
    near = near.select("src", "dst", F.col("dst").isNotNull().cast("long").alias("n"))
    if hubs is not None:
        near = cut(near.join(long(hubs.withColumn("hub", F.lit(True))), "src", "left").select("src", "dst", F.when(F.col("hub"), 0).otherwise(F.col("n")).cast("long").alias("n")))
    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n")).distinct())
    nearest = Window.partitionBy("start").orderBy("depth", "node")
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1).select("start", F.col("node").alias("src"))
        if front.isEmpty():
            break
        met = cut(front.join(long(near), "src").select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth"), "n"))
        if met.isEmpty():
            break
        nodes = seen.unionByName(met).repartition("start").groupBy("start", "node").agg(F.min("depth").alias("depth"), F.sum("n").alias("n"))
        seen = cut(nodes.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= max_nodes).drop("nth"))
    of_start = Window.partitionBy("start")
    flags = seen.select("start", "node", "depth", F.count("*").over(of_start).alias("n_nodes"), F.max("depth").over(of_start).alias("deepest"), F.sum("n").over(of_start).alias("n_edges"))
    if hubs is not None:
        followed = seen.filter(F.col("depth") < max_depth).join(long(hubs), F.col("node") == F.col("src")).select("start", "src")
        inside = followed.join(long(seen.select("start", F.col("node").alias("dst"))), "start").join(long(e.select("src", "dst")), ["src", "dst"], "left_semi")
        flags = flags.join(long(inside.groupBy("start").agg(F.count("*").alias("more"))), "start", "left").withColumn("n_edges", F.col("n_edges") + F.coalesce("more", F.lit(0)))
    # edges within a flow, from nodes that were followed: a tree has one fewer than nodes
    return flags.select("start", "node", "depth", "n_nodes", ((F.col("n_nodes") >= max_nodes) | (F.col("deepest") >= max_depth)).alias("truncated"), (F.col("n_edges") > F.col("n_nodes") - 1).alias("cycle"))


def longest_chains(edges: DataFrame, starts: DataFrame, least: int = 1) -> DataFrame:
    """(start, depth, path, cyclic): the longest chain of calls from each start, of `least` nodes or more. A ring of calls counts as
    all its nodes, once, and is one step of the path; `cyclic` says that there is one on it. Equally long ways go by name.

    Rings are contracted, so what is left has an end: lengths are found from there, in as many rounds as the longest chain has
    steps, each over those that grew, and paths follow the best next steps."""
    shared(edges)
    e = cut(graphs.simple(edges))
    rings = cut(graphs.cycles(e))
    name = lambda df, c, to: df.join(long(rings.select(F.col("node").alias(c), F.col("component").alias("_c"))), c, "left").withColumn(to, F.coalesce("_c", c)).drop("_c")
    dag = cut(name(name(e, "src", "a"), "dst", "b").filter("a <> b").select("a", "b").distinct())
    sizes = rings.groupBy("component").agg(F.count("*").alias("size")).withColumnRenamed("component", "node")
    nodes = starts.select("node").unionByName(e.select(F.col("src").alias("node"))).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    nodes = name(nodes, "node", "c").select(F.col("c").alias("node")).distinct().join(long(sizes), "node", "left")
    best = cut(nodes.select("node", F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("size", F.lit(1)).cast("long").alias("depth"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("next"), F.col("size").isNotNull().alias("cyclic")))
    front = best.select("node", "depth")
    while True:
        offer = front.join(long(dag), front["node"] == dag["b"]).groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("depth"), F.col("b"))).alias("x"))
        offer = offer.select("node", (-F.col("x.col1")).alias("more"), F.col("x.b").alias("by"))
        longer = F.coalesce(F.col("size") + F.col("more") > F.col("depth"), F.lit(False)) | F.coalesce((F.col("size") + F.col("more") == F.col("depth")) & (F.col("by") < F.col("next")), F.lit(False))
        grown = cut(best.join(long(offer), "node", "left").withColumn("grew", longer))
        best = grown.select("node", "size", F.when(F.col("grew"), F.col("size") + F.col("more")).otherwise(F.col("depth")).alias("depth"), F.when(F.col("grew"), F.col("by")).otherwise(F.col("next")).alias("next"), "cyclic")
        front = grown.filter("grew").select("node", (F.col("size") + F.col("more")).alias("depth"))
        if front.isEmpty():
            break
    best = cut(best)
    at = name(starts.select(F.col("node").alias("start")).distinct(), "start", "node").join(long(best.select("node", "depth", "next", "cyclic")), "node").filter(F.col("depth") >= least)
    ways = cut(at.select("start", "depth", F.array("node").alias("path"), F.col("next").alias("node"), "cyclic"))
    step = best.select("node", "next", F.col("cyclic").alias("ring"))
    done = ways.filter("node is null")
    while True:
        ways = ways.filter("node is not null")
        if ways.isEmpty():
            return done.select("start", "depth", "path", "cyclic")
        ways = cut(ways.join(long(step), "node").select("start", "depth", F.array_append("path", F.col("node")).alias("path"), F.col("next").alias("node"), (F.col("cyclic") | F.col("ring")).alias("cyclic")))
        done = done.unionByName(ways.filter("node is null"))
