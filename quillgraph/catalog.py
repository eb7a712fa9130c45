"""The graph's tables: labels and edge kinds as views over typed DataFrames.

A node table keeps its key in its native type; an edge part is any DataFrame that has both
endpoints' keys. An edge part may be ``held_by`` one of its ends: its rows are that end's
own rows (a foreign key), so a hop over it is one join and not two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import BindingProblem


@dataclass
class NodeTable:
    label: str
    df: DataFrame
    key: str
    #: Where pseudo-field ``content`` and ``payload.text`` come from.
    content: str | None = None
    #: Name of an array column with all labels of a node, where nodes have several.
    labels: str | None = None

    def columns(self) -> dict[str, str]:
        return dict(self.df.dtypes)


@dataclass
class EdgePart:
    label: str
    source: str  # label
    target: str  # label
    df: DataFrame
    src: str
    dst: str
    edge_id: Column | None = None
    order: str | None = None
    held_by: str | None = None  # "src" or "dst"
    props: list[str] = field(default_factory=list)

    def id_column(self) -> Column:
        if self.edge_id is not None:
            return self.edge_id
        return F.concat_ws("|", F.lit(self.label), F.col(self.src).cast("string"), F.col(self.dst).cast("string"))


@dataclass(frozen=True)
class Index:
    """A declared index; it decides which rows an ordered read has (see Compiler)."""

    name: str
    target: str  # node or edge
    label: str
    field: str
    ordered: bool = False
    descending: bool = False
    unique: bool = False


@dataclass
class Graph:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, list[EdgePart]] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    #: Endpoints of every edge exist, so a hop that needs only the key skips their table.
    trusted: bool = False
    revision: int = 0

    def add_node(self, label: str, df: DataFrame, key: str, **more) -> Graph:
        self.nodes[label] = NodeTable(label, df, key, **more)
        return self

    def add_edge(self, label: str, source: str, target: str, df: DataFrame, src: str, dst: str, **more) -> Graph:
        self.edges.setdefault(label, []).append(EdgePart(label, source, target, df, src, dst, **more))
        return self

    def node(self, label: str) -> NodeTable:
        if label not in self.nodes:
            raise BindingProblem(f"label {label} is not known")
        return self.nodes[label]

    def parts(self, label: str) -> list[EdgePart]:
        if label not in self.edges:
            raise BindingProblem(f"edge label {label} is not known")
        return self.edges[label]

    def copy(self) -> Graph:
        return Graph(dict(self.nodes), {k: list(v) for k, v in self.edges.items()}, list(self.indexes), self.trusted, self.revision + 1)


def node_id(label: str, key: Column) -> Column:
    """A node's id in the whole graph."""
    return F.concat(F.lit(f"{label}:"), key.cast("string"))
