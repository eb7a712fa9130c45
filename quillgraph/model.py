"""The logical query that the text language and the fluent builder both produce."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Union

NAMESPACES = ("properties", "payload", "meta")
AGGREGATES = ("count", "sum", "avg", "min", "max")
TEXT_MAX_DEPTH, BUILDER_MAX_DEPTH = 5, 64


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Today:
    """The current date, shifted by days."""

    days: int = 0


@dataclass(frozen=True)
class Ref:
    """A field of an alias; ``namespace`` only says which bucket it was written in."""

    alias: str
    field: str
    namespace: str = "properties"

    @property
    def name(self) -> str:
        return f"{self.alias}.{self.field}" if self.namespace == "properties" else f"{self.alias}.{self.namespace}.{self.field}"


@dataclass
class NodePattern:
    alias: str | None
    labels: list[str] = field(default_factory=list)
    props: dict[str, Any] = field(default_factory=dict)
    ids: list[str] | None = None


@dataclass
class Step:
    direction: str  # out, in, both
    labels: list[str]
    target: NodePattern
    alias: str | None = None
    props: dict[str, Any] = field(default_factory=dict)
    min_depth: int = 1
    max_depth: int = 1
    quantified: bool = False


@dataclass(frozen=True)
class Compare:
    ref: Ref
    op: str  # = != < <= > >=
    value: Any

    def __hash__(self):  # lists and objects are values too
        return hash((self.ref, self.op, repr(self.value)))


@dataclass(frozen=True)
class IsNull:
    ref: Ref
    negate: bool = False


@dataclass(frozen=True)
class Exists:
    ref: Ref


@dataclass(frozen=True)
class Text:
    ref: Ref
    op: str  # contains, starts, ends, text_contains
    value: str


@dataclass(frozen=True)
class HasTag:
    alias: str
    tag: str


@dataclass(frozen=True)
class Similar:
    alias: str
    query: Any
    top: int


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


Predicate = Union[Compare, IsNull, Exists, Text, HasTag, Similar, And, Or]


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: Ref | str | None  # a field, an alias, or None for *


@dataclass
class Item:
    """A returned column: a field, a whole alias, or an aggregate."""

    what: Ref | str | Aggregate
    name: str | None = None

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        if isinstance(self.what, Aggregate):
            return self.what.fn
        return self.what if isinstance(self.what, str) else self.what.name


@dataclass
class Query:
    start: NodePattern
    steps: list[Step] = field(default_factory=list)
    where: Predicate | None = None
    items: list[Item] = field(default_factory=list)
    path: str | None = None
    graph: bool = False
    distinct: bool = False
    order: list[tuple[Ref, bool]] = field(default_factory=list)  # (field, descending)
    offset: int | None = None
    limit: int | None = None
    #: walk: nodes on a row's path are distinct; edges: revisits allowed; collect: one row a root
    mode: str = "walk"

    def patterns(self):
        return [self.start, *(s.target for s in self.steps)]


@dataclass
class Insert:
    node: NodePattern


@dataclass
class MergeNode:
    node: NodePattern
    items: list[Item]
    limit: int | None = None


@dataclass
class SetFields:
    match: Query
    assignments: list[tuple[Ref, Any]]


@dataclass
class Delete:
    match: Query
    aliases: list[str]


@dataclass
class LinkNodes:
    """CREATE or MERGE of an edge between matched nodes."""

    nodes: list[NodePattern]
    source: str
    target: str
    label: str | None
    alias: str | None
    props: dict[str, Any]
    merge: bool
    items: list[Item] = field(default_factory=list)
    limit: int | None = None


def conjuncts(p: Predicate | None) -> list[Predicate]:
    if p is None:
        return []
    return [x for item in p.items for x in conjuncts(item)] if isinstance(p, And) else [p]


def refs_of(p: Predicate | None) -> list[Ref]:
    if p is None:
        return []
    if isinstance(p, (And, Or)):
        return [r for i in p.items for r in refs_of(i)]
    if isinstance(p, HasTag):
        return [Ref(p.alias, "tags")]
    return [] if isinstance(p, Similar) else [p.ref]


def all_of(items) -> Predicate | None:
    """AND of predicates: flat, without repeats, in a settled order."""
    flat = list(dict.fromkeys(x for i in items if i is not None for x in conjuncts(i)))
    return None if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))
