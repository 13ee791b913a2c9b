"""Texts of other description languages, and views, made from a format description."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from .description import NUMBERS, Choice, Description, Element, Field, Record

_KAITAI = {"INT": "s", "UINT": "u", "FLOAT": "f"}
_DFDL = {"INT8": "byte", "INT16": "short", "INT32": "int", "INT64": "long", "UINT8": "unsignedByte", "UINT16": "unsignedShort", "UINT32": "unsignedInt", "UINT64": "unsignedLong", "FLOAT32": "float", "FLOAT64": "double", "STRING": "string", "BYTES": "hexBinary", "BITS": "unsignedLong"}
_VIEW = {"INT8": "byte", "INT16": "short", "INT32": "int", "INT64": "long", "UINT8": "short", "UINT16": "int", "UINT32": "long", "UINT64": "biginteger", "FLOAT32": "float", "FLOAT64": "double"}


def kaitai(d: Description) -> str:
    types: list[str] = []

    def item(e: Element, pad: str) -> list[str]:
        out = [f"{pad}- id: {e.name}"]
        if isinstance(e, Field):
            if e.kind in NUMBERS:
                head = next(k for k in ("UINT", "INT", "FLOAT") if e.kind.startswith(k))
                n = NUMBERS[e.kind][0]
                out.append(f"{pad}  type: {_KAITAI[head]}{n}" + ("" if n == 1 else "be" if e.big else "le"))
            elif e.kind == "BITS":
                out.append(f"{pad}  type: b{e.bits}")
            else:
                out.append(f"{pad}  size: {e.length}")
                if e.kind == "STRING":
                    out += [f"{pad}  type: str", f"{pad}  encoding: ASCII"]
        elif isinstance(e, Choice):
            out += [f"{pad}  type:", f"{pad}    switch-on: {e.on}", f"{pad}    cases:"]
            for key, b in e.branches:
                out.append(f"{pad}      {key}: {b.name}_type")
                types.append(block(f"{b.name}_type", b.parts if isinstance(b, Record) else (b,)))
        else:
            out.append(f"{pad}  type: {e.name}_type")
            types.append(block(f"{e.name}_type", e.parts))
        t = e.times
        out += {"optional": [f"{pad}  if: {t.expression.replace(' = ', ' == ')}"], "repeated": [f"{pad}  repeat: expr", f"{pad}  repeat-expr: {t.expression}"], "until_end": [f"{pad}  repeat: eos"]}.get(t.kind, [])
        return out

    def block(name: str, parts) -> str:
        return "\n".join([f"  {name}:", "    seq:", *(x for p in parts for x in item(p, "      "))])

    main = [x for p in d.root.parts for x in item(p, "  ")]
    return "\n".join(["meta:", f"  id: {d.root.name}", "  endian: be", "seq:", *main, *(["types:", *types] if types else [])]) + "\n"


def dfdl(d: Description) -> str:
    def element(e: Element) -> str:
        t = e.times
        occurs = {"optional": f' minOccurs="0" dfdl:occursCountKind="expression" dfdl:occursCount={quoteattr("{ if (" + t.expression + ") then 1 else 0 }")}', "repeated": f' maxOccurs="unbounded" dfdl:occursCountKind="expression" dfdl:occursCount={quoteattr("{ ../" + t.expression + " }")}', "until_end": ' maxOccurs="unbounded" dfdl:occursCountKind="implicit"'}.get(t.kind, "")
        if isinstance(e, Field):
            length = f' dfdl:lengthKind="explicit" dfdl:length={quoteattr(e.length if e.length.isdigit() else "{ ../" + e.length + " }")}' if e.length else f' dfdl:length="{e.bits}" dfdl:lengthUnits="bits"' if e.bits else ""
            return f'<xs:element name="{e.name}" type="xs:{_DFDL[e.kind]}"{length} dfdl:byteOrder="{"bigEndian" if e.big else "littleEndian"}"{occurs}/>'
        if isinstance(e, Choice):
            inner = "".join(f"<xs:sequence dfdl:choiceBranchKey={quoteattr(k)}>{element(b)}</xs:sequence>" for k, b in e.branches)
            return f'<xs:element name="{e.name}"{occurs}><xs:complexType><xs:choice dfdl:choiceDispatchKey={quoteattr("{ xs:string(../" + e.on + ") }")}>{inner}</xs:choice></xs:complexType></xs:element>'
        sep = f" dfdl:separator={quoteattr(e.separator)} dfdl:terminator={quoteattr(e.terminator)}" if e.separator else ""
        return f'<xs:element name="{e.name}"{occurs}><xs:complexType><xs:sequence{sep}>{"".join(map(element, e.parts))}</xs:sequence></xs:complexType></xs:element>'

    return f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:dfdl="http://www.ogf.org/dfdl/dfdl-1.0/">{element(d.root)}</xs:schema>'


def table_view(d: Description) -> str:
    """A table view over the first repeated record, or over the root."""
    rows = next((p for p in d.root.parts if isinstance(p, Record) and p.times.kind != "once"), None)
    fields = [f for f in (rows or d.root).parts if isinstance(f, Field)]
    columns = "".join(f'<column name="{f.name}" type="{_VIEW.get(f.kind, "string")}"/>' for f in fields)
    return f"<view><rows {'children=' + quoteattr(rows.name) if rows else 'self=' + quoteattr('true')}/><columns>{columns}</columns></view>"


def from_fits(headers: list[list[tuple[str, str, str]]]) -> Description:
    """The description of a FITS file's first image: header blocks as bytes, then rows of pixels."""
    head = {k: v for k, v, _ in headers[0]}
    kind = {"8": "UINT8", "16": "INT16", "32": "INT32", "64": "INT64", "-32": "FLOAT32", "-64": "FLOAT64"}[head["BITPIX"]]
    cards = len(headers[0]) + 1
    blocks = -(-cards // 36) * 2880
    from .description import Times

    pixels = Record("row", (Field("pixel", kind, times=Times("repeated", head["NAXIS1"])),), Times("repeated", head["NAXIS2"]))
    return Description(Record("image", (Field("header", "BYTES", str(blocks)), pixels, Field("rest", "UINT8", times=Times("until_end")))), ("fits",))
