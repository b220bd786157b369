"""Triples and concepts: set union, de-duplication, renumbering, validation, keyword retrieval, taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graph_union(*graphs: DataFrame) -> DataFrame:
    """Set union of triples."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates()


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def renumber(entities: DataFrame, triples: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """New ids E1.. inside each group (a paper), and the triples with their endpoints rewritten."""
    ids = entities.withColumn("eid", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(group).orderBy(key)).cast("string")))
    m = ids.select(group, key, "eid")
    s = triples.join(m.withColumnRenamed(key, "s").withColumnRenamed("eid", "s_id"), [group, "s"], "left")
    return ids, s.join(m.withColumnRenamed(key, "o").withColumnRenamed("eid", "o_id"), [group, "o"], "left")


def valid_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples whose subject is known and whose object is known or a literal."""
    known = triples.join(entities.select(F.col("entity").alias("s")).distinct(), "s", "left_semi")
    literal = known.filter("o_is_literal")
    linked = known.filter("not o_is_literal").join(entities.select(F.col("entity").alias("o")).distinct(), "o", "left_semi")
    return literal.unionByName(linked)


def taxonomy_lookup(labels: DataFrame, by_path: DataFrame, by_label: DataFrame) -> DataFrame:
    """URI of each label: a path match wins over a label match. The taxonomies are small tables; AQE sends them if they are."""
    out = labels.join(by_path.withColumnRenamed("uri", "uri_path"), "label", "left").join(by_label.withColumnRenamed("uri", "uri_label"), "label", "left")
    return out.select("label", F.coalesce("uri_path", "uri_label").alias("uri"))


def flatten_taxonomy(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(label, path) of each node of a nested dict or list: a small file read by the driver."""
    out: list[tuple[str, str]] = []
    items = tree.items() if isinstance(tree, dict) else [(x, None) if isinstance(x, str) else next(iter(x.items())) for x in tree]
    for label, sub in items:
        path = f"{prefix}/{label}" if prefix else label
        out.append((label, path))
        if sub:
            out += flatten_taxonomy(sub, path)
    return out


def paths(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(label, path, depth) of each node of a forest (node, parent or null, label): a join a level, from the roots down."""
    level = nodes.filter("parent IS NULL").select("node", "label", F.col("label").alias("path"))
    out, depth = level.select("label", "path", F.lit(1).alias("depth")), 1
    while depth < most:
        below = nodes.select(F.col("node").alias("child"), "parent", F.col("label").alias("own")).join(level.select(F.col("node").alias("parent"), "path"), "parent")
        level = below.select(F.col("child").alias("node"), F.col("own").alias("label"), F.concat_ws("/", "path", "own").alias("path"))
        if level.isEmpty():
            break
        depth += 1
        out = out.unionByName(level.select("label", "path", F.lit(depth).alias("depth")))
    return out


def retrieve(literals: DataFrame, terms: DataFrame, limit: int = 5, least: int = 20) -> DataFrame:
    """Literals (id, text) that contain a term (ord, term), any case, of a length at least; each once by its first term, the first `limit` a term.

    The terms are a short list; one pass over the literals serves all.
    """
    hit = literals.filter(F.length("text") >= least).join(F.broadcast(terms), F.instr(F.lower("text"), F.lower("term")) > 0)
    first = keep_first(hit, ["id"], ["ord", "term"])
    w = Window.partitionBy("ord").orderBy("id")
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).select("ord", "term", "id")
