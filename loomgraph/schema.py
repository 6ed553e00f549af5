"""Row types of the graph tables, and the type vocabularies as dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import lexicons as lex

NODE_EXTRA = (
    "struct<cpg_node_id: bigint, cpg_label: string, cpg_code: string, cross_modal: string, inferred_cwe: string, "
    "pattern_source: string, cpg_original_label: string, cpg_original_id: bigint>"
)
EDGE_EXTRA = (
    "struct<cross_sentence: boolean, marker: string, relation: string, topic_relevance: boolean, cross_modal: boolean, "
    "cpg_node_id: bigint, vulnerability_pattern: string, cpg_reaching_def: boolean, description: string, cpg_original_label: string>"
)
#: name -> (type, SQL of the value that stands for "absent")
NODE_FIELDS = {
    "text": ("string", "''"), "lemma": ("string", "''"), "pos_tag": ("string", "''"), "dep_rel": ("string", "''"),
    "entity_type": ("string", "''"), "entity_iob": ("string", "''"), "doc_idx": ("int", "0"), "para_idx": ("int", "0"),
    "sent_idx": ("int", "0"), "token_idx": ("int", "0"), "char_start": ("int", "0"), "char_end": ("int", "0"),
    "srl_role": ("string", "''"), "amr_concept": ("string", "''"), "sentiment": ("double", "0.0"),
    "importance": ("double", "0.0"), "domain_type": ("string", "''"), "confidence": ("double", "1.0"),
    "source": ("string", "''"), "extra": (NODE_EXTRA, "null"),
}
EDGE_FIELDS = {
    "dep_label": ("string", "''"), "srl_label": ("string", "''"), "rst_label": ("string", "''"), "amr_label": ("string", "''"),
    "coref_cluster": ("int", "-1"), "entity_rel_type": ("string", "''"), "weight": ("double", "1.0"), "extra": (EDGE_EXTRA, "null"),
}
NODE_COLUMNS = ["doc_id", "node_id", "node_type", *NODE_FIELDS]
EDGE_COLUMNS = ["doc_id", "edge_id", "src", "dst", "edge_type", *EDGE_FIELDS]


def filled(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with every field, absent ones at their stand-in value and all in their type."""
    return df.withColumns({k: F.col(k).cast(t) if k in df.columns else F.expr(f"cast({v} as {t})") for k, (t, v) in fields.items()})


def extra(kind: str, **values) -> F.Column:
    """A struct of type ``kind`` with some fields set and the others null."""
    names = [x.split(":")[0].strip() for x in kind[len("struct<") : -1].split(",")]
    return F.struct(*[(values[n] if n in values else F.lit(None)).alias(n) for n in names]).cast(kind)


@dataclass(frozen=True)
class Schema:
    """Which levels of the vocabularies are in use: 1 base, 2 security, 3 cross-modal."""

    security: bool = False
    cross_modal: bool = False

    def _rows(self, base: list[str], security: list[str], cross_modal: list[str]) -> list[tuple[str, int, int]]:
        rows = [(x, i, 1) for i, x in enumerate(base)]
        rows += [(f"SEC_{x}", i, 2) for i, x in enumerate(security) if self.security]
        rows += [(f"XM_{x}", i, 3) for i, x in enumerate(cross_modal) if self.cross_modal]
        return rows

    def node_rows(self) -> list[tuple[str, int, int]]:
        return self._rows(lex.NODE_TYPES, lex.SECURITY_NODE_TYPES, lex.CROSS_MODAL_NODE_TYPES)

    def edge_rows(self) -> list[tuple[str, int, int]]:
        return self._rows(lex.EDGE_TYPES, lex.SECURITY_EDGE_TYPES, lex.CROSS_MODAL_EDGE_TYPES)

    def node_labels(self, spark: SparkSession) -> DataFrame:
        """(name, idx in its level, level, label_idx over all levels)."""
        return _labels(spark, self.node_rows())

    def edge_labels(self, spark: SparkSession) -> DataFrame:
        return _labels(spark, self.edge_rows())

    @property
    def num_node_types(self) -> int:
        return len(lex.NODE_TYPES)

    @property
    def num_edge_types(self) -> int:
        return len(lex.EDGE_TYPES)

    @property
    def total_node_labels(self) -> int:
        return len(self.node_rows())

    @property
    def total_edge_labels(self) -> int:
        return len(self.edge_rows())

    def node_type_index(self, name: str) -> int:
        return _index(lex.NODE_TYPES, name)

    def edge_type_index(self, name: str) -> int:
        return _index(lex.EDGE_TYPES, name)

    def describe(self) -> str:
        """The vocabularies as text."""
        counts = [[sum(level == n for _, _, level in rows) for n in (1, 2, 3)] for rows in (self.node_rows(), self.edge_rows())]
        lines = [f"Schema: {self.total_node_labels} node labels, {self.total_edge_labels} edge labels"]
        lines += [f"  level {n + 1}: {counts[0][n]} node types, {counts[1][n]} edge types" for n in range(3)]
        for title, rows in (("Node labels", self.node_rows()), ("Edge labels", self.edge_rows())):
            lines += ["", title] + [f"  [{i}] {name}" for i, (name, _, _) in enumerate(rows)]
        return "\n".join(lines)


def _index(names: list[str], name: str) -> int:
    if name not in names:
        raise KeyError(name)
    return names.index(name)


def _labels(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, idx int, level int, label_idx int")


def in_use(labels: DataFrame, used: DataFrame) -> DataFrame:
    """``labels`` with n: how often ``used`` (name, n) has each."""
    counts = used.groupBy("name").agg(F.sum("n").alias("n"))
    return labels.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def indexed(used: DataFrame, labels: DataFrame) -> DataFrame:
    """``used`` (name, ...) with idx, the index of its type; -1 where ``labels`` has none."""
    return used.join(labels.select("name", "idx"), "name", "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))


DEFAULT_SCHEMA = Schema()
SECURITY_SCHEMA = Schema(security=True)
FULL_SCHEMA = Schema(security=True, cross_modal=True)


def mapping(spark: SparkSession, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    """A fixed map as a small table, with its order."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs.items())], f"{key} string, {value} string, ord int")
