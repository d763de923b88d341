"""The property graph: one DataFrame for each node label and one for each edge type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each label beside ``node_id``, and the columns that identify a node. The graph's schema.
NODE_COLUMNS = {
    "Company": {"name": "string", "description": "string", "status": "string", "stage": "string", "team_size": "int", "yc_batch": "string", "filename": "string"},
    "Founder": {"name": "string"},
    "Investor": {"name": "string"},
    "Industry": {"name": "string"},
    "Location": {"city": "string", "country": "string"},
    "Technology": {"name": "string"},
    "Batch": {"name": "string"},
    "FundingEvent": {"round": "string", "year": "int", "company": "string", "amount": "string"},
}
NODE_KEYS = {label: ("city", "country") if label == "Location" else ("round", "year", "company") if label == "FundingEvent" else ("name",) for label in NODE_COLUMNS}
#: Start label, end label and properties of each edge type.
EDGE_TYPES = {
    "FOUNDED": ("Founder", "Company", {}),
    "CO_FOUNDED_WITH": ("Founder", "Founder", {}),
    "INVESTED_IN": ("Investor", "Company", {}),
    "OPERATES_IN": ("Company", "Industry", {}),
    "HEADQUARTERED_IN": ("Company", "Location", {}),
    "USES": ("Company", "Technology", {}),
    "PART_OF": ("Company", "Batch", {}),
    "ACQUIRED_BY": ("Company", "Company", {"year": "int", "amount": "string"}),
    "RAISED": ("Company", "FundingEvent", {"amount": "string"}),
    "COMPETES_WITH": ("Company", "Company", {}),
}


@dataclass
class Graph:
    """Nodes by label (``node_id`` and properties) and edges by type (``edge_id, src, dst`` and properties).

    Node ids are unique within a label; edge ids within a type. Other labels and types than the schema's may be added
    with ``types``.
    """

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, tuple[str, str]] = field(default_factory=lambda: {t: (s, d) for t, (s, d, _) in EDGE_TYPES.items()})

    def node(self, label: str) -> DataFrame:
        """All nodes of a label; none of a label of the schema that has no table."""
        if label in self.nodes:
            return self.nodes[label]
        if label in NODE_COLUMNS:
            return self.spark.createDataFrame([], ", ".join(["node_id long", *(f"`{c}` {t}" for c, t in NODE_COLUMNS[label].items())]))
        raise KeyError(f"unknown label {label}")

    def edge(self, kind: str) -> DataFrame:
        """All edges of a type."""
        if kind in self.edges:
            return self.edges[kind]
        if kind in EDGE_TYPES:
            return self.spark.createDataFrame([], ", ".join(["edge_id long", "src long", "dst long", *(f"`{c}` {t}" for c, t in EDGE_TYPES[kind][2].items())]))
        raise KeyError(f"unknown edge type {kind}")

    def endpoint_labels(self, kind: str) -> tuple[str, str]:
        """The labels at the ends of an edge type, which is how an unlabelled node gets its label."""
        if kind not in self.types:
            raise KeyError(f"unknown edge type {kind}")
        return self.types[kind]

    def all_nodes(self) -> DataFrame:
        """``label, node_id`` of every node."""
        return _union([df.select(F.lit(label).alias("label"), "node_id") for label, df in sorted(self.nodes.items())], self.spark, "label string, node_id long")

    def all_edges(self) -> DataFrame:
        """``type, edge_id, src_label, src, dst_label, dst`` of every edge."""
        parts = []
        for kind, df in sorted(self.edges.items()):
            s, d = self.endpoint_labels(kind)
            parts.append(df.select(F.lit(kind).alias("type"), "edge_id", F.lit(s).alias("src_label"), "src", F.lit(d).alias("dst_label"), "dst"))
        return _union(parts, self.spark, "type string, edge_id long, src_label string, src long, dst_label string, dst long")

    def label_histogram(self) -> DataFrame:
        """``type, count`` of the nodes by label."""
        return self.all_nodes().groupBy(F.col("label").alias("type")).agg(F.count("*").alias("count"))

    def write(self, path: str) -> None:
        for label, df in self.nodes.items():
            df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
        for kind, df in self.edges.items():
            df.write.mode("overwrite").parquet(f"{path}/edges/{kind}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, labels=tuple(NODE_COLUMNS), kinds=tuple(EDGE_TYPES)) -> Graph:
        """A graph written before; labels and types without a table stay empty."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
        nodes = {x: spark.read.parquet(f"{path}/nodes/{x}") for x in labels if there(f"{path}/nodes/{x}")}
        edges = {x: spark.read.parquet(f"{path}/edges/{x}") for x in kinds if there(f"{path}/edges/{x}")}
        return cls(spark, nodes, edges)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
