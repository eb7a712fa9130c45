"""Schema documents, one declaration or field a line.

    schema "Harbour log" version "3" mode strict   // or: domain <uuid>
    node Vessel labels Vessel,Ship {
      name: string
      flags?: string[]
      kind: enum cargo,tug
    }
    edge berths from Vessel to Quay hierarchy
    edge tows from Vessel to Vessel {
      since: date optional
    }
    index vessels_by_name on node Vessel field properties.name ordered asc

Words may be quoted; # and // begin comments; a line may end in a semicolon.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from ..errors import SchemaProblem

# Fixed values.
KINDS = "string int float bool datetime date object map json enum".split()
MODES = ("permissive", "warn", "strict")
ORDERABLE = ("string", "int", "float", "bool", "datetime", "date", "enum")
BUCKETS = ("properties", "payload", "meta")


@dataclass
class FieldSpec:
    name: str
    kind: str
    required: bool = True
    repeated: bool = False
    values: list[str] = field(default_factory=list)

    def spark(self):
        one = {"string": T.StringType(), "enum": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.StringType(), "date": T.StringType()}.get(self.kind, T.VariantType())
        return T.StructField(self.name, T.ArrayType(one) if self.repeated else one, not self.required)


@dataclass
class NodeType:
    name: str
    labels: list[str] = field(default_factory=list)
    properties: list[FieldSpec] = field(default_factory=list)
    payload: list[FieldSpec] = field(default_factory=list)
    meta: list[FieldSpec] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType(), False), *[f.spark() for f in self.properties]])


@dataclass
class EdgeType(NodeType):
    source: list[str] = field(default_factory=list)
    target: list[str] = field(default_factory=list)
    hierarchy: bool = False


@dataclass
class IndexSpec:
    name: str
    on: str = "node"
    type: str = ""
    bucket: str = "properties"
    field: str = ""
    ordered: bool = False
    direction: str = ""
    unique: bool = False
    required: bool = False


@dataclass
class Document:
    name: str = ""
    version: str = ""
    domain: str = ""
    mode: str = "permissive"
    nodes: list[NodeType] = field(default_factory=list)
    edges: list[EdgeType] = field(default_factory=list)
    indexes: list[IndexSpec] = field(default_factory=list)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


_COMMENT = re.compile(r'((?:[^"#/]|"(?:\\.|[^"\\])*"|/(?!/)|"(?=[^"]*$))*)')
_WORD = re.compile(r'(?:"(?:\\.|[^"\\])*"|[^\s"])+')


def _words(text: str) -> list[str]:
    """A line's words; quotes hold words together and go."""
    if text.count('"') - text.count('\\"') & 1:
        raise ValueError("a quote does not end")
    return [re.sub(r'(?<!\\)"', "", w).replace('\\"', '"') for w in _WORD.findall(text)]


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for n, line in enumerate(text.split("\n"), 1):
        line = _COMMENT.match(line)[1].strip().removesuffix(";").strip()
        if line:
            yield n, line


def names(text: str) -> list[str]:
    """A list of names: a,b or [a,b]."""
    text = text.strip()
    text = text[1:-1] if text[:1] == "[" and text[-1:] == "]" else text
    return [x.strip() for x in text.split(",") if x.strip()]


class _Options:
    """The words after a declaration's name: flags, and options with a value."""

    def __init__(self, words: list[str]):
        self.words = words[::-1]

    def __bool__(self):
        return bool(self.words)

    def word(self) -> str:
        return self.words.pop()

    def value(self, option: str) -> str:
        if not self.words:
            raise ValueError(f"{option} needs a value")
        return self.words.pop()

    def follows(self, *choices: str) -> bool:
        return bool(self.words) and self.words[-1].lower() in choices


def parse(text: str) -> Document:
    """A schema document; SchemaProblem with the line's number where it isn't one."""
    doc, lines, block, number = Document(), _lines(text), None, 0
    for number, line in lines:
        try:
            if block is not None:
                if line == "}":
                    block = None
                else:
                    block.append(parse_field(line))
                continue
            opens = line.endswith("{")
            words = _words(line.removesuffix("{"))
            what, rest = words[0].lower() if words else "", _Options(words[1:])
            if what == "node":
                doc.nodes.append(_node(rest))
            elif what == "edge":
                doc.edges.append(_edge(rest))
            elif what == "index" and not opens:
                doc.indexes.append(parse_index(words[1:]))
            elif what == "schema" and not opens:
                _header(doc, rest)
            else:
                raise ValueError("a schema, node, edge or index was expected")
            if opens:
                block = (doc.nodes if what == "node" else doc.edges)[-1].properties
        except ValueError as e:
            raise SchemaProblem(f"line {number}: {e}") from e
    if block is not None:
        raise SchemaProblem(f"line {number}: a block does not end")
    return doc


def _header(doc: Document, rest: _Options) -> None:
    while rest:
        w = rest.word()
        option = w.lower()
        if option == "version":
            doc.version = rest.value(option)
        elif option == "mode":
            doc.mode = rest.value(option).lower()
            if doc.mode not in MODES:
                raise ValueError(f"mode {doc.mode} is not known")
        elif option in ("domain", "domain_id", "domainid"):
            doc.domain = str(uuid.UUID(rest.value(option)))
        elif not doc.name:
            doc.name = w
        else:
            raise ValueError(f"option {w} is not known")


def _named(rest: _Options, kind: str):
    if not rest:
        raise ValueError(f"{kind} needs a name")
    return rest.word()


def _node(rest: _Options) -> NodeType:
    name = _named(rest, "node")
    out = NodeType(name, [name])
    while rest:
        w = rest.word()
        if w.lower() != "labels":
            raise ValueError(f"option {w} is not known")
        out.labels = names(rest.value("labels"))
    return out


def _edge(rest: _Options) -> EdgeType:
    name = _named(rest, "edge")
    out = EdgeType(name, [name])
    while rest:
        w = rest.word()
        option = w.lower()
        if option in ("from", "to", "labels"):
            setattr(out, {"from": "source", "to": "target"}.get(option, option), names(rest.value(option)))
        elif option == "hierarchy":
            out.hierarchy = True
        else:
            raise ValueError(f"option {w} is not known")
    if not out.source or not out.target:
        raise ValueError("an edge needs NAME from NODE to NODE")
    return out


def parse_field(text: str) -> FieldSpec:
    name, colon, rest = text.partition(":")
    words = _Options(_words(rest))
    if not colon or not words:
        raise ValueError("a field needs NAME: TYPE")
    name, kind = name.strip(), words.word()
    out = FieldSpec(name.removesuffix("?"), kind.removesuffix("[]").lower(), not name.endswith("?"), kind.endswith("[]"))
    if out.kind not in KINDS:
        raise ValueError(f"type {kind} is not known")
    if out.kind == "enum" and words and not words.follows("required", "optional", "enum"):
        out.values = names(words.word())
    while words:
        w = words.word().lower()
        if w in ("required", "optional"):
            out.required = w == "required"
        elif w == "enum":
            out.kind, out.values = "enum", names(words.value(w))
        else:
            raise ValueError(f"option {w} is not known")
    return out


def parse_index(words: list[str]) -> IndexSpec:
    rest = _Options(words)
    out = IndexSpec(_named(rest, "index"))
    while rest:
        w = rest.word()
        option = w.lower()
        if option == "on":
            out.on = rest.value(option).lower()
            if out.on not in ("node", "edge"):
                raise ValueError("on needs node or edge")
            out.type = rest.value(option)
        elif option == "field":
            path = [x.strip() for x in rest.value(option).split(".")]
            if len(path) != 2 or not all(path):
                raise ValueError("a field path is BUCKET.NAME")
            out.bucket, out.field = path
        elif option == "ordered":
            out.ordered = True
            out.direction = rest.word().lower() if rest.follows("asc", "desc") else out.direction
        elif option in ("unique", "required"):
            setattr(out, option, True)
        else:
            raise ValueError(f"option {w} is not known")
    if not out.type or not out.field:
        raise ValueError("an index needs NAME on node|edge TYPE field properties.NAME")
    return out


def problems(doc: Document) -> list[str]:
    """What is wrong with a document: repeats, labels of two types, unknown ends, indexes
    that can't be."""
    out = []
    for kind, types in (("node", doc.nodes), ("edge", doc.edges)):
        names = [t.name for t in types]
        out += [f"{kind} type {n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
        for t in types:
            for bucket in BUCKETS:
                fs = [f.name for f in getattr(t, bucket)]
                out += [f"{t.name}.{bucket}.{f} is declared twice" for f in sorted({f for f in fs if fs.count(f) > 1})]
                out += [f"{t.name}.{bucket}.{f.name} has no values" for f in getattr(t, bucket) if f.kind == "enum" and not f.values]
    owner: dict[str, str] = {}
    for t in doc.nodes:
        for label in t.labels:
            if owner.setdefault(label, t.name) != t.name:
                out.append(f"label {label} belongs to {owner[label]} and {t.name}")
    known = {t.name for t in doc.nodes} | set(owner)
    for e in doc.edges:
        out += [f"{e.name} names unknown end {x}" for x in [*e.source, *e.target] if x not in known]
    names = [i.name for i in doc.indexes]
    out += [f"index {n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for i in doc.indexes:
        types = {t.name: t for t in (doc.nodes if i.on == "node" else doc.edges)}
        if i.type not in types:
            out.append(f"index {i.name}: type {i.type} is not known")
        elif i.bucket != "properties":
            out.append(f"index {i.name}: only properties are indexed")
        else:
            f = next((f for f in types[i.type].properties if f.name == i.field), None)
            if f is None:
                out.append(f"index {i.name}: field {i.field} is not known")
            elif f.repeated or f.kind not in ORDERABLE:
                out.append(f"index {i.name}: {f.kind}{'[]' * f.repeated} can't be indexed")
    return out
