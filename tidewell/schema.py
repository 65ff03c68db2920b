"""The field catalogue of an index: fields with inheritance, aliases, groups and dynamic prefixes."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "default"
    indexed: bool = True
    stored: bool = True
    multi_valued: bool = True
    index_boost: float = 1.0
    query_boost: float = 1.0
    sort_locale: str | None = None
    in_free_text: bool = True
    required: bool = False
    aliases: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Group:
    name: str
    fields: tuple[str, ...]
    aliases: tuple[tuple[str, str | None], ...] = ()


@dataclass
class Descriptor:
    fields: dict[str, Field] = field(default_factory=dict)
    groups: dict[str, Group] = field(default_factory=dict)
    prefixes: dict[str, Field] = field(default_factory=dict)
    defaults: tuple[str, ...] = ("freetext",)
    operator: str = "and"
    language: str | None = None

    def resolve(self, name: str, language: str | None = None) -> Field | None:
        """A field by its name, then by an alias (of the language if it names one), then by a dynamic prefix."""
        if name in self.fields:
            return self.fields[name]
        for f in self.fields.values():
            if any(a == name and lang in (None, language or self.language) for a, lang in f.aliases):
                return f
        for prefix in sorted(self.prefixes, key=len, reverse=True):
            if name.startswith(prefix):
                return replace(self.prefixes[prefix], name=name)
        return None

    def resolve_group(self, name: str, language: str | None = None) -> Group | None:
        if name in self.groups:
            return self.groups[name]
        return next((g for g in self.groups.values() if any(a == name and lang in (None, language or self.language) for a, lang in g.aliases)), None)

    def for_indexing(self, name: str) -> Field:
        """Like resolve, but unknown names get the default field's settings."""
        return self.resolve(name) or replace(self.fields.get("default", Field("default")), name=name)

    def expand(self, name: str | None) -> tuple[str, list[str]]:
        """How a query's field name expands: ("defaults" | "group" | "field", real field names)."""
        if name is None:
            return "defaults", [x for d in self.defaults for x in self.expand(d)[1]]
        if group := self.resolve_group(name):
            return "group", list(group.fields)
        found = self.resolve(name)
        return "field", [found.name if found else name]

    def struct(self) -> T.StructType:
        """Spark schema of an index document; attributes travel as column metadata."""
        return T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.multi_valued else T.StringType(), not f.required, {"kind": f.kind, "boost": f.query_boost}) for f in self.fields.values()])


def _flag(node: ET.Element, name: str, default: bool) -> bool:
    return node.get(name, str(default)).lower() == "true"


def _aliases(node: ET.Element) -> tuple[tuple[str, str | None], ...]:
    return tuple((a.get("name", ""), a.get("lang")) for a in node if a.tag.rpartition("}")[2] == "alias")


def from_xml(text: str) -> Descriptor:
    """A descriptor document.  A field takes what it doesn't state from its parent field."""
    root = ET.fromstring(text)
    out = Descriptor()
    tags = lambda name: (n for n in root.iter() if n.tag.rpartition("}")[2] == name)
    for node in tags("field"):
        name = node.get("name", "")
        if node.get("ref") or not name:
            continue
        base = out.fields.get(node.get("parent", ""), Field(name, kind=node.get("parent", "default")))
        made = replace(
            base,
            name=name,
            kind=base.kind if node.get("parent") in out.fields else node.get("parent", "default"),
            indexed=_flag(node, "indexed", base.indexed),
            stored=_flag(node, "stored", base.stored),
            multi_valued=_flag(node, "multiValued", base.multi_valued),
            index_boost=float(node.get("indexBoost", base.index_boost)),
            query_boost=float(node.get("queryBoost", node.get("boost", base.query_boost))),
            sort_locale=node.get("sortLocale", base.sort_locale),
            in_free_text=_flag(node, "inFreeText", base.in_free_text),
            required=_flag(node, "required", base.required),
            aliases=_aliases(node),
        )
        if name.endswith("*"):
            out.prefixes[name[:-1]] = made
        else:
            out.fields[name] = made
    for node in tags("group"):
        members = tuple(n.get("ref") or n.get("name", "") for n in node if n.tag.rpartition("}")[2] == "field")
        out.groups[node.get("name", "")] = Group(node.get("name", ""), members, _aliases(node))
    for node in tags("defaultSearchFields"):
        out.defaults = tuple((node.text or "").replace(",", " ").split())
    for node in tags("defaultLanguage"):
        out.language = (node.text or "").strip() or None
    for node in tags("QueryParser"):
        out.operator = node.get("defaultOperator", out.operator).lower()
    return out
