"""Dependency graphs as edge tables (src, dst)."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import worked_out


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder that spark.checkpoint.dir names; a plain checkpoint-free plan where none is."""
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df
    path = f"{shared.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def long(df: DataFrame) -> DataFrame:
    """The table as a side of a join that is never broadcast. Written tables of names compress well, so Spark takes long ones for small
    and would send them whole through the driver."""
    return df.hint("merge")


def shared(df: DataFrame) -> None:
    """Sees to it that `cut` cuts: rounds without end need written tables. Where no folder is named, a local session gets one
    of its own; on a cluster that is an error, since each machine would have another."""
    conf = df.sparkSession.conf
    if not conf.get("spark.checkpoint.dir", None):
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))


def simple(edges: DataFrame) -> DataFrame:
    return edges.filter("src != dst").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    return out.join(into, "node", "full_outer").na.fill(0)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """(start, node, depth): the shortest number of steps, at most `max_depth`, or any where that is None. `starts` has
    a column node."""
    if max_depth is None:
        shared(edges)
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        nxt = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches a node over `edges`, in rounds until nothing changes."""
    front = labels
    while True:
        # only labels that fell in the round before can lower others
        offered = front.join(long(edges), front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        both = cut(labels.join(long(offered), "node", "left").select("node", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("fell")))
        labels, front = both.select("node", "label"), both.filter("fell").select("node", "label")
        if front.isEmpty():
            return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing enters or nothing leaves, as long as a round drops a tenth of the edges:
    such nodes are in no cycle; those left over fall to later rounds."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(long(into), "src", "left_semi").join(long(out), "dst", "left_semi").select("src", "dst"))
        n, before = edges.count(), n
        if n > 0.9 * before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle of two nodes or more, with the least node of their strongly connected component.

    Exact at any length. Each round gives a node the least node that reaches it; a node that keeps its own name is the
    root of a component, which holds those of its name that reach it in turn. Edges between names, and those of found
    components, fall away, until no edge is left. Tables stay as long as the nodes and edges; rounds grow with paths."""
    shared(edges)
    edges = _trimmed(cut(simple(edges)))
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        names = _spread(cut(nodes.withColumn("label", F.col("node"))), edges)
        a, b = names.toDF("src", "a"), names.toDF("dst", "b")
        inner = cut(edges.join(long(a), "src").join(long(b), "dst").filter("a = b").select("src", "dst", F.col("a").alias("name")))
        met = _backwards(names.filter("node = label").select("node", F.col("label").alias("component")), inner)
        found = met if found is None else cut(found.unionByName(met))
        done = met.select("node")
        rest = inner.join(long(done.toDF("src")), "src", "left_anti").join(long(done.toDF("dst")), "dst", "left_anti")
        edges = _trimmed(cut(rest.select("src", "dst")))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    several = found.filter("node != component").select("component").distinct()
    return found.join(long(several), "component", "left_semi").select("node", "component")


def _backwards(met: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, component): the roots `met` and the nodes that reach the root of their name; `inner` has only edges within a name."""
    front = met
    while True:
        nxt = front.join(long(inner), front["node"] == inner["dst"]).select(F.col("src").alias("node"), "component").distinct()
        front = cut(nxt.join(long(met.select("node")), "node", "left_anti").select("node", "component"))
        if front.isEmpty():
            return met
        met = cut(met.unionByName(front))


def unresolved_to_known(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, fqcn): a type name resolves to the class of that full name, else, without a namespace, to the only class of that base name."""
    by_base = known.groupBy(F.element_at(F.split("fqcn", r"\\"), -1).alias("base")).agg(F.min("fqcn").alias("only"), F.count("*").alias("n")).filter("n = 1")
    exact = raw.join(long(known.select(F.col("fqcn").alias("exact"))), F.col("raw") == F.col("exact"), "left")
    return exact.join(long(by_base), F.col("raw") == F.col("base"), "left").select("raw", F.coalesce("exact", F.when(~F.col("raw").contains("\\"), F.col("only"))).alias("fqcn"))


#: What a script's import may leave out, in the order in which files are tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, suffixes=SUFFIXES) -> DataFrame:
    """(path, target, file): imports (path, target) that name a file of `files` (path), relative to the importing file or by an
    alias of a folder. Each candidate is a key of an equi join; the first that exists counts."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    full = F.when(F.col("target").rlike(r"^\.{1,2}/"), F.concat(folder, "target"))
    for alias, to in (aliases or {}).items():
        full = full.when(F.col("target").startswith(alias), F.concat(F.lit(to), F.substring("target", len(alias) + 1, 1 << 20)))
    tried = imports.withColumn("full", worked_out(full)).filter("full is not null").select("path", "target", F.posexplode(F.array(*(F.concat("full", F.lit(x)) for x in suffixes))).alias("nth", "file"))
    found = tried.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    return found.groupBy("path", "target").agg(F.min_by("file", "nth").alias("file"))


def ancestors(children: DataFrame) -> DataFrame:
    """(node, root, depth) of each node in a hierarchy (node, parent): pointers double each round until none moves, or until they
    have gone further than there are nodes; those that still move lie on or under a cycle, have no root and are left out."""
    shared(children)
    rounds = children.count().bit_length() + 1
    at = cut(children.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(rounds):
        up = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = at.join(up, "up", "left").select("node", F.when(F.col("next").isNull(), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        moved = cut(moved)
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    roots = children.filter("parent is null").select(F.col("node").alias("root"))
    return at.select("node", F.coalesce("up", "node").alias("root"), "depth").join(roots, "root", "left_semi").select("node", "root", "depth")
