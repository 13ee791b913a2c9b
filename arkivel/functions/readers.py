"""Texts of description languages read into format descriptions: Kaitai (.ksy) and DFDL (.dfdl.xsd).

What the neutral description has no word for is refused with its place, never left out.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from .description import Choice, Description, Element, Field, Record, Times

_XS, _DFDL = "{http://www.w3.org/2001/XMLSchema}", "{http://www.ogf.org/dfdl/dfdl-1.0/}"
#: XML schema types and the kinds they are read as.
_XSD_KINDS = {"byte": "INT8", "short": "INT16", "int": "INT32", "long": "INT64", "unsignedByte": "UINT8", "unsignedShort": "UINT16", "unsignedInt": "UINT32", "unsignedLong": "UINT64", "float": "FLOAT32", "double": "FLOAT64", "string": "STRING", "hexBinary": "BYTES"}


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    return text


def outline(text: str):
    """Maps, lists and scalars of an indented text (the part of YAML that descriptions use); scalars stay text."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, pad: int):
        made: dict | list = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == pad:
            body = lines[at][1]
            if isinstance(made, list):
                inner = body[1:].lstrip()
                if ":" in inner and not inner.startswith(("'", '"')):
                    lines[at] = (pad + len(body) - len(inner), inner)
                    item, at = block(at, lines[at][0])
                else:
                    item, at = _scalar(inner), at + 1
                made.append(item)
                continue
            key, colon, rest = body.partition(":")
            if not colon:
                raise ValueError(f"{body!r} is no entry")
            if rest.strip():
                made[_scalar(key)] = _scalar(rest)
                at += 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > pad or lines[at + 1][0] == pad and lines[at + 1][1].startswith("- ")):
                made[_scalar(key)], at = block(at + 1, lines[at + 1][0])
            else:
                made[_scalar(key)], at = None, at + 1
        if at < len(lines) and lines[at][0] > pad:
            raise ValueError(f"{lines[at][1]!r} is indented too far")
        return made, at

    return block(0, lines[0][0])[0] if lines else {}


def _plain(text: str) -> str:
    """An expression of another language in ours: ==, &&, || and a leading _. are written otherwise."""
    out = re.sub(r"\b_\.", "", str(text).replace("==", "=").replace("&&", " and ").replace("||", " or "))
    return re.sub(r"!(?!=)", " not ", out).strip()


def kaitai(text: str) -> Description:
    """The description of a .ksy text: seq, types, switch-on, if, repeat, size, process zlib, instances with pos."""
    doc = outline(text)
    little = (doc.get("meta") or {}).get("endian", "be") == "le"
    types = doc.get("types") or {}

    def times(item: dict) -> Times:
        kind = item.get("repeat")
        if kind == "expr":
            return Times("repeated", _plain(item["repeat-expr"]))
        if kind in ("eos", "until"):
            return Times("until_end")
        return Times("optional", _plain(item["if"])) if "if" in item else Times()

    def element(item: dict, above: tuple[str, ...]) -> Element:
        name, kind, often = item.get("id", "_"), item.get("type"), times(item)
        offset = _plain(item["pos"]) if "pos" in item else ""
        if isinstance(kind, dict):
            cases = [(str(k), element({"id": str(t).removesuffix("_type"), "type": t}, above)) for k, t in kind["cases"].items()]
            others = next((e for k, e in cases if k == "_"), None)
            return Choice(name, _plain(kind["switch-on"]), tuple((k, e) for k, e in cases if k != "_"), others, often)
        if kind in types:
            if kind in above:
                raise ValueError(f"{name}: {kind} holds itself")
            inner = types[kind]
            until = _plain(item["repeat-until"]) if item.get("repeat") == "until" else ""
            return Record(name, parts(inner, (*above, kind)), often, _plain(item["size"]) if "size" in item else "", zlib=item.get("process") == "zlib", until=until)
        if m := re.fullmatch(r"([usf])([1248])(be|le)?", kind or ""):
            return Field(name, {"u": "UINT", "s": "INT", "f": "FLOAT"}[m[1]] + str(8 * int(m[2])), big=m[3] != "le" if m[3] else not little, times=often, offset=offset)
        if m := re.fullmatch(r"b(\d+)", kind or ""):
            return Field(name, "BITS", bits=int(m[1]), times=often)
        if kind in ("str", None) and "size" in item:
            return Field(name, "STRING" if kind else "BYTES", _plain(item["size"]), times=often, offset=offset)
        raise ValueError(f"{name}: {kind!r} is not known")

    def parts(block: dict, above: tuple[str, ...]) -> tuple[Element, ...]:
        own = [element(i, above) for i in block.get("seq") or []]
        return tuple(own + [element({"id": k} | v, above) for k, v in (block.get("instances") or {}).items() if "pos" in v])

    return Description(Record((doc.get("meta") or {}).get("id", "data"), parts(doc, ())))


def _xpath(text: str) -> str:
    """A DFDL expression in ours: braces, steps to siblings and string casts go."""
    out = re.sub(r"^\{|\}$", "", text.strip()).strip()
    out = re.sub(r"(xs|fn|dfdl):(string|int|long|unsignedInt)\(([^()]*)\)", r"\3", out)
    out = re.sub(r"(\.\./)+|(?<![\w)])\./", "", out)
    out = re.sub(r"\b(\w+:)(?=\w)", "", out)
    for ours, theirs in (("=", "eq"), ("!=", "ne"), ("<=", "le"), (">=", "ge"), ("<", "lt"), (">", "gt"), ("/", "idiv"), ("%", "mod")):
        out = re.sub(rf"\s{theirs}\s", f" {ours} ", out)
    return out.replace("/", ".") if re.fullmatch(r"[\w/]+", out) else out


def dfdl(text: str) -> Description:
    """The description of a schema: elements, sequences, choices, occurrence counts, explicit lengths, separators."""
    schema = ET.fromstring(text)
    named = {e.get("name"): e for e in schema if e.tag == f"{_XS}element"}
    types = {e.get("name"): e for e in schema if e.tag in (f"{_XS}complexType", f"{_XS}simpleType")}
    defaults = {k.removeprefix(_DFDL): v for f in schema.iter(f"{_DFDL}format") for k, v in f.attrib.items()}
    get = lambda e, k: e.get(_DFDL + k, e.get(k) if e.tag.startswith(_DFDL) else None) or defaults.get(k)
    short = lambda t: (t or "").rpartition(":")[2]

    def times(e) -> Times:
        kind, count = e.get(_DFDL + "occursCountKind"), e.get(_DFDL + "occursCount")
        if kind == "expression" and count:
            if m := re.fullmatch(r"\{\s*if\s*\((.*)\)\s*then\s+1\s+else\s+0\s*\}", count.strip()):
                return Times("optional", _xpath(m[1]))
            return Times("repeated", _xpath(count))
        least, most = e.get("minOccurs", "1"), e.get("maxOccurs", "1")
        if most == "unbounded":
            return Times("until_end")
        return Times() if (least, most) == ("1", "1") else Times("repeated", most) if least == most else Times("optional", "")

    def element(e) -> Element:
        e = named[short(e.get("ref"))] if e.get("ref") else e
        name, often = e.get("name"), times(e)
        inner = e.find(f"{_XS}complexType")
        if inner is None and short(e.get("type")) in types and types[short(e.get("type"))].tag == f"{_XS}complexType":
            inner = types[short(e.get("type"))]
        if inner is not None:
            return group(name, inner, often, e)
        kind = short(e.get("type"))
        while kind in types:
            kind = short(types[kind].find(f"{_XS}restriction").get("base"))
        if kind not in _XSD_KINDS:
            raise ValueError(f"{name}: {kind!r} is not known")
        big = get(e, "byteOrder") != "littleEndian"
        length = e.get(_DFDL + "length")
        if length and e.get(_DFDL + "lengthUnits") == "bits":
            return Field(name, "BITS", bits=int(length), times=often)
        return Field(name, _XSD_KINDS[kind], _xpath(length) if length else "", big=big, times=often, nil=e.get(_DFDL + "nilValue", ""))

    def group(name: str, holder, often: Times, e) -> Element:
        body = next(c for c in holder if c.tag in (f"{_XS}sequence", f"{_XS}choice"))
        if body.tag == f"{_XS}choice":
            branches = []
            for c in body:
                own = c if c.tag == f"{_XS}element" else next(iter(c))
                branches.append((c.get(_DFDL + "choiceBranchKey") or own.get(_DFDL + "choiceBranchKey") or own.get("name"), element(own)))
            return Choice(name, _xpath(body.get(_DFDL + "choiceDispatchKey", "")), tuple(branches), None, often)
        separator = body.get(_DFDL + "separator", "")
        stop = {"%NL;": "\n", "%CR;%LF;": "\r\n"}.get(body.get(_DFDL + "terminator", "\n"), body.get(_DFDL + "terminator", "\n"))
        size = e.get(_DFDL + "length") if e is not None and e.get(_DFDL + "lengthKind") == "explicit" else ""
        parts = tuple(element(c) if c.tag == f"{_XS}element" else group("choice", _wrapped(c), Times(), None) for c in body if c.tag != f"{_XS}annotation")
        return Record(name, parts, often, _xpath(size) if size else "", separator={"%HT;": "\t", "%SP;": " "}.get(separator, separator), terminator=stop)

    def _wrapped(c):
        holder = ET.Element(f"{_XS}complexType")
        holder.append(c)
        return holder

    root = element(next(iter(named.values())))
    if not isinstance(root, Record):
        raise ValueError("the root element has no sequence")
    return Description(root)
