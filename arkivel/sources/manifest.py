"""Manifests of described data: which descriptions, views and meanings a data object has, read from and written to Turtle."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree import ElementTree

from ..functions import vocab as V
from .triples import Turtle

IM = V.EX
#: Properties that lead from a data object to what describes it.
FOLLOWED = ("interpretedUsing", "hasGroupMember", "hasStructureRepresentationInformation", "hasSemanticRepresentationInformation", "hasOtherRepresentationInformation", "interpretedUsingRecurse")
#: The order in which equivalent descriptions are preferred.
PREFERRED = ("KAITAI", "DFDL", "DRB", "EAST")


@dataclass
class Described:
    iri: str
    name: str
    location: str
    structures: list[tuple[str, str, str]] = field(default_factory=list)  # (iri, language, location)
    views: list[tuple[str, str, str]] = field(default_factory=list)  # (iri, kind, location)
    meanings: dict[str, tuple[str, str]] = field(default_factory=dict)  # path -> (label, unit)

    def structure(self) -> tuple[str, str, str]:
        """The preferred of the equivalent descriptions."""
        rank = {k: i for i, k in enumerate(PREFERRED)}
        if not self.structures:
            raise ValueError(f"{self.iri} has no structure description")
        return min(self.structures, key=lambda s: (rank.get(s[1].upper(), len(rank)), s[0]))


def _last(iri: str) -> str:
    return iri.rstrip("/#").replace("#", "/").rsplit("/", 1)[-1]


def read(text: str) -> list[Described]:
    """The data objects of a manifest that have both a description and a place, by IRI."""
    about: dict[str, list[tuple[str, str]]] = {}
    for s, _, p, o, *_ in Turtle(text).parse():
        about.setdefault(s, []).append((p, o))
    one = lambda s, p: next((o for q, o in about.get(s, []) if q == p), None)
    out = []
    for s in sorted(about):
        place = one(s, IM + "hasStorageLocation")
        open_ = [o for p, o in about[s] if p == IM + "interpretedUsing"]
        if not open_ or place is None:
            continue
        made, seen = Described(s, one(s, V.LABEL) or _last(s), place), set()
        while open_:
            r = open_.pop()
            if r in seen:
                continue
            seen.add(r)
            open_ += [o for p, o in about.get(r, []) if p in {IM + f for f in FOLLOWED}]
            if language := one(r, IM + "specificationLanguage"):
                made.structures.append((r, language, one(r, IM + "hasStorageLocation") or ""))
            if (V.TYPE, IM + "ViewSpecification") in about.get(r, []):
                if one(r, IM + "hasStorageLocation") is None:
                    raise ValueError(f"{r} is a view without a place")
                made.views.append((r, one(r, IM + "viewKind") or "table", one(r, IM + "hasStorageLocation")))
            if path := one(r, IM + "structuralPath"):
                made.meanings[path] = (one(r, V.LABEL) or "", one(r, IM + "hasUnit") or "")
        made.structures.sort()
        made.views.sort()
        out.append(made)
    if not out:
        raise ValueError("nothing in the manifest has both a description and a place")
    return out


def select(objects: list[Described], which: str = "") -> Described:
    """By IRI, its end, its label or its file's name; the only one if nothing is asked for."""
    found = objects if not which else [d for d in objects if which in (d.iri, _last(d.iri), d.name, _last(d.location))]
    if len(found) != 1:
        raise ValueError(f"{which or 'the manifest'} names {len(found)} data objects, not one")
    return found[0]


def write(d: Described) -> str:
    lines = [f"<{d.iri}> <{V.LABEL}> \"{d.name}\" ; <{IM}hasStorageLocation> <{d.location}> ; <{IM}interpretedUsing> <{d.iri}/group> ."]
    members = [s for s, *_ in d.structures] + [v for v, *_ in d.views]
    lines += [f"<{d.iri}/group> <{IM}hasGroupMember> <{m}> ." for m in members]
    lines += [f"<{s}> <{IM}specificationLanguage> \"{lang}\" ; <{IM}hasStorageLocation> <{at}> ." for s, lang, at in d.structures]
    lines += [f"<{v}> a <{IM}ViewSpecification> ; <{IM}viewKind> \"{kind}\" ; <{IM}hasStorageLocation> <{at}> ." for v, kind, at in d.views]
    for i, (path, (label, unit)) in enumerate(sorted(d.meanings.items())):
        lines += [f"<{d.iri}/group> <{IM}hasGroupMember> <{d.iri}/m{i}> .", f"<{d.iri}/m{i}> <{IM}structuralPath> \"{path}\" ; <{V.LABEL}> \"{label}\" ; <{IM}hasUnit> \"{unit}\" ."]
    return "\n".join(lines) + "\n"


_RDF = "{" + V.RDF + "}"


def read_rdf_xml(text: str) -> list[tuple]:
    """Rows (s, s_kind, p, o, o_kind, o_dt, o_lang) of an RDF/XML document of nodes and property elements."""
    rows: list[tuple] = []
    count = [0]
    iri = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e) -> tuple[str, str]:
        about, own = e.get(_RDF + "about") or e.get(_RDF + "ID"), e.get(_RDF + "nodeID")
        if about is None:
            count[0] += own is None
            s, kind = f"_:{own or 'x' + str(count[0])}", "bnode"
        else:
            s, kind = about, "iri"
        if e.tag != _RDF + "Description":
            rows.append((s, kind, V.TYPE, iri(e.tag), "iri", "", ""))
        for k, v in e.attrib.items():
            if not k.startswith(_RDF) and k.startswith("{") and "XML/1998" not in k:
                rows.append((s, kind, iri(k), v, "literal", "", ""))
        for p in e:
            target = p.get(_RDF + "resource")
            if target is not None:
                rows.append((s, kind, iri(p.tag), target, "iri", "", ""))
            elif p.get(_RDF + "parseType") == "Collection":
                rest = (V.RDF + "nil", "iri")
                for item in reversed([node(c) for c in p]):
                    count[0] += 1
                    cell = (f"_:c{count[0]}", "bnode")
                    rows.extend([(*cell, V.RDF + "first", *item, "", ""), (*cell, V.RDF + "rest", *rest, "", "")])
                    rest = cell
                rows.append((s, kind, iri(p.tag), *rest, "", ""))
            elif len(p):
                rows.append((s, kind, iri(p.tag), *node(p[0]), "", ""))
            else:
                rows.append((s, kind, iri(p.tag), p.text or "", "literal", p.get(_RDF + "datatype") or "", p.get("{http://www.w3.org/XML/1998/namespace}lang") or ""))
        return s, kind

    root = ElementTree.fromstring(text)
    for e in root if root.tag == _RDF + "RDF" else [root]:
        node(e)
    return rows


def schema_outline(xsd: str) -> list[tuple[str, str, str, str]]:
    """(path, type, least, most) of the elements of a schema, in document order."""
    xs = "{http://www.w3.org/2001/XMLSchema}"
    root, out = ElementTree.fromstring(xsd), []
    named = {t.get("name"): t for t in root if t.tag in (xs + "complexType", xs + "element", xs + "group")}

    def walk(e, path: str, above: tuple[str, ...]) -> None:
        for c in e:
            if c.tag == xs + "element":
                name = c.get("name") or (c.get("ref") or "").rpartition(":")[2]
                kind = (c.get("type") or "").rpartition(":")[2]
                out.append((f"{path}/{name}", kind, c.get("minOccurs", "1"), c.get("maxOccurs", "1")))
                target = c if len(c) else named.get(kind or name)
                if target is not None and (kind or name) not in above:
                    walk(target, f"{path}/{name}", (*above, kind or name))
            elif c.tag in (xs + x for x in ("sequence", "choice", "complexType", "all")):
                walk(c, path, above)

    walk(root, "", ())
    return out
