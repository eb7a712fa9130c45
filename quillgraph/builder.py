"""Fluent front end: the same logical query as the text language, from Python."""

from __future__ import annotations

import datetime

from .model import Aggregate, Compare, Exists, HasTag, IsNull, Item, NodePattern, Or, Query, Ref, Similar, Step, Text, Today, all_of


class Field(Ref):
    """A field that comparisons turn into predicates."""

    def __eq__(self, v):
        return Compare(self.ref, "=", v)

    def __ne__(self, v):
        return Compare(self.ref, "!=", v)

    def __lt__(self, v):
        return Compare(self.ref, "<", v)

    def __le__(self, v):
        return Compare(self.ref, "<=", v)

    def __gt__(self, v):
        return Compare(self.ref, ">", v)

    def __ge__(self, v):
        return Compare(self.ref, ">=", v)

    __hash__ = Ref.__hash__

    @property
    def ref(self) -> Ref:
        return Ref(self.alias, self.field, self.namespace)

    def between(self, low, high):
        return all_of([self >= low, self <= high])

    def is_null(self):
        return IsNull(self.ref)

    def is_not_null(self):
        return IsNull(self.ref, True)

    def exists(self):
        return Exists(self.ref)

    def contains(self, s):
        return Text(self.ref, "contains", s)

    def starts_with(self, s):
        return Text(self.ref, "starts", s)

    def ends_with(self, s):
        return Text(self.ref, "ends", s)

    def text_contains(self, s):
        return Text(self.ref, "text_contains", s)


def field(name: str) -> Field:
    """``alias.field`` or ``alias.namespace.field``."""
    a, *rest = name.split(".")
    return Field(a, rest[-1], rest[0] if len(rest) == 2 else "properties")


def any_of(*ps):
    return Or(tuple(ps))


def has_tag(alias: str, tag: str):
    return HasTag(alias, tag)


def similar(alias: str, query, top: int):
    return Similar(alias, query, top)


def today(days: int = 0) -> Today:
    return Today(days)


def day(iso: str, days: int = 0) -> str:
    return (datetime.date.fromisoformat(iso) + datetime.timedelta(days)).isoformat()


def _item(what, name=None) -> Item:
    if isinstance(what, str) and "." in what:
        what = field(what).ref
    return Item(what.ref if isinstance(what, Field) else what, name)


def _aggregate(fn):
    return lambda arg=None: Aggregate(fn, field(arg).ref if isinstance(arg, str) and "." in arg else arg)


count, total, mean, least, most = map(_aggregate, ("count", "sum", "avg", "min", "max"))


class Pattern:
    """``Pattern().node("c", "Customer").out("PLACED").node("o", "Order")``"""

    def __init__(self, path: str | None = None):
        self.q, self._open = Query(NodePattern(None), path=path), None
        self._started = False

    def node(self, alias=None, label=None, ids=None, **props) -> Pattern:
        p = NodePattern(alias, [label] if isinstance(label, str) else list(label or []), props, ids)
        if self._open is not None:
            self._open.target = p
            self.q.steps.append(self._open)
            self._open = None
        elif self._started:
            raise ValueError("an edge must come between two nodes")
        else:
            self.q.start, self._started = p, True
        return self

    def _edge(self, direction, label, alias=None, depth=None, **props) -> Pattern:
        low, high = depth if isinstance(depth, tuple) else (depth or 1, depth or 1)
        self._open = Step(direction, [label], NodePattern(None), alias, props, low, high, depth is not None)
        return self

    def out(self, label, alias=None, depth=None, **props):
        return self._edge("out", label, alias, depth, **props)

    def into(self, label, alias=None, depth=None, **props):
        return self._edge("in", label, alias, depth, **props)

    def both(self, label, alias=None, depth=None, **props):
        return self._edge("both", label, alias, depth, **props)

    def where(self, *ps) -> Pattern:
        self.q.where = all_of([self.q.where, *ps])
        return self

    def returns(self, *items, **named) -> Pattern:
        self.q.items += [_item(i) for i in items] + [_item(v, k) for k, v in named.items()]
        return self

    def distinct(self) -> Pattern:
        self.q.distinct = True
        return self

    def graph(self) -> Pattern:
        self.q.graph = True
        return self

    def order_by(self, name: str, descending: bool = False) -> Pattern:
        self.q.order.append((field(name).ref, descending))
        return self

    def offset(self, n: int) -> Pattern:
        self.q.offset = n
        return self

    def limit(self, n: int) -> Pattern:
        self.q.limit = n
        return self

    def edge_rows(self) -> Pattern:
        """One row an edge sequence, revisits allowed."""
        self.q.mode = "edges"
        return self

    def per_root(self) -> Pattern:
        """One row a root, targets gathered."""
        self.q.mode = "collect"
        return self

    def build(self) -> Query:
        if not self.q.items:
            self.q.items = [Item(self.q.start.alias or "_n0")]
        return self.q
