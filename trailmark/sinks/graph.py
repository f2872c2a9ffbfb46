"""Graph tables, builds and exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.schema import SCHEMA_VERSION


def write_build(tables: dict[str, DataFrame], path: str, build: int, keep: int | None = None) -> None:
    """Append a build: each table under ``build_id=N``, the marker table last, so a build without marker was not finished."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("build_id", F.lit(build)).write.mode("append").partitionBy("build_id").parquet(f"{path}/{name}")
    spark.createDataFrame([(build, SCHEMA_VERSION)], "build int, version int").coalesce(1).write.mode("append").parquet(f"{path}/_builds")


def builds(spark: SparkSession, path: str) -> list[int]:
    rows = spark.read.schema("build int, version int").parquet(f"{path}/_builds").collect()
    if any(r["version"] > SCHEMA_VERSION for r in rows):
        raise ValueError(f"{path} was written by a newer version")
    return sorted(r["build"] for r in rows)


def read_build(spark: SparkSession, path: str, build: int, name: str) -> DataFrame:
    """One table of one build; other builds are not read."""
    return spark.read.parquet(f"{path}/{name}").filter(F.col("build_id") == build).drop("build_id")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): elements of a GraphML file; part 0 and 3 frame nodes (1) and edges (2)."""
    spark = nodes.sparkSession
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="type" for="all" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
    frame = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    node = F.format_string('<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>', _xml(F.col("id")), _xml(F.coalesce("label", F.lit(""))), F.col("type"))
    edge = F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', _xml(F.col("src")), _xml(F.col("dst")), F.col("type"))
    return frame.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("line"))).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("line")))


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): MERGE statements, nodes before edges."""
    node = F.format_string("MERGE (n:%s {id: '%s'}) SET n.label = '%s';", F.initcap(F.col("type")), _quoted(F.col("id")), _quoted(F.coalesce("label", F.lit(""))))
    edge = F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) MERGE (a)-[:%s {state: '%s'}]->(b);", _quoted(F.col("src")), _quoted(F.col("dst")), F.col("type"), F.col("state"))
    return nodes.select(F.lit(1).alias("part"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("line")))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): one JSON object for each node and link."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "layer", "label")).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "state")).alias("json")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of their parts, in files whose names keep that order."""
    lines.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def save_exchanges(exchanges: DataFrame, path: str) -> None:
    """Masked exchanges as JSON lines; the roles that are written replace their old files, other roles stay."""
    named = exchanges.withColumn("role_dir", F.coalesce("role", F.lit("none")))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role_dir").json(path)


def table_text(df: DataFrame, width: int = 44) -> DataFrame:
    """All columns as text of at most ``width`` characters; of arrays the first four values."""
    def cell(name: str, kind: str) -> Column:
        c = F.concat_ws(", ", F.slice(F.col(name).cast("array<string>"), 1, 4)) if kind.startswith("array<") else F.col(name).cast("string")
        return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c).alias(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def proxy_xml(exchanges: DataFrame, path: str) -> None:
    """Masked exchanges as proxy XML items."""
    items = exchanges.select(F.concat(F.coalesce("scheme", F.lit("http")), F.lit("://"), F.col("host"), F.col("path")).alias("url"), "host", "port", F.col("scheme").alias("protocol"), "method", "path", "status", F.col("mime").alias("mimetype"))
    items.write.mode("overwrite").format("xml").option("rootTag", "items").option("rowTag", "item").save(path)
