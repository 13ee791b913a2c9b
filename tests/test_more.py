"""Readers of description texts, paths and checks in small cases that SQL does not reach."""

import struct

import pytest

from arkivel.functions import description as D
from arkivel.functions import generators, readers
from arkivel.operators import decode, packages, paths, transform, views
from arkivel.plans.data import VARIABLE

DATA = struct.pack(">HB", 2, 1) + struct.pack("<q", -5) + struct.pack(">BB", 2, 3) + b"abc"


def test_generated_texts_are_read_again():
    entry = D.Record("entry", (D.Field("kind", "UINT8"), D.Field("n", "UINT16", big=False)), D.Times("repeated", "count"))
    d = D.Description(D.Record("file", (D.Field("count", "UINT8"), entry, D.Field("more", "UINT8", times=D.Times("optional", "count = 2")), D.Field("name", "STRING", "count"))))
    raw = bytes([2, 1, 5, 0, 2, 6, 0, 9]) + b"xy"
    want = decode.canonical(decode.decoded(raw, d))
    assert decode.canonical(decode.decoded(raw, readers.kaitai(generators.kaitai(d)))) == want
    assert decode.canonical(decode.decoded(raw, readers.dfdl(generators.dfdl(d)))) == want


def test_kaitai_features():
    d = readers.kaitai("meta:\n  id: x\n  endian: le\nseq:\n  - id: flags\n    type: b4\n  - id: low\n    type: b4\n  - id: items\n    type: item\n    repeat: until\n    repeat-until: _.last == 1\ninstances:\n  far:\n    pos: 1\n    type: u2be\ntypes:\n  item:\n    seq:\n      - {}\n".replace("      - {}\n", "      - id: last\n        type: u1\n"))
    root = decode.decoded(bytes([0xA5, 0, 1]), d)
    assert decode.canonical(root) == ["/flags = 10", "/low = 5", "/items[1]/last = 0", "/items[2]/last = 1", "/far = 1"]
    with pytest.raises(ValueError, match="not known"):
        readers.kaitai("seq:\n  - id: a\n    type: nothing\n")
    with pytest.raises(ValueError, match="holds itself"):
        readers.kaitai("seq:\n  - id: a\n    type: t\ntypes:\n  t:\n    seq:\n      - id: a\n        type: t\n")


def test_dfdl_text_lines():
    text = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:dfdl="http://www.ogf.org/dfdl/dfdl-1.0/"><xs:element name="f"><xs:complexType><xs:sequence>
    <xs:element name="row" maxOccurs="unbounded"><xs:complexType><xs:sequence dfdl:separator="," dfdl:terminator="%NL;"><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:string"/></xs:sequence></xs:complexType></xs:element>
    </xs:sequence></xs:complexType></xs:element></xs:schema>"""
    got = decode.canonical(decode.decoded(b"1,x\n2,y", readers.dfdl(text)))
    assert got == ["/row[1]/a = 1", "/row[1]/b = x", "/row[2]/a = 2", "/row[2]/b = y"]


def test_lines_end_outside_quotes():
    line = D.Record("line", (D.Field("a", "STRING"), D.Field("b", "STRING")), D.UNTIL_END, separator=",", terminator="\r\n", quote='"')
    root = decode.decoded(b'1,"x\r\ny ""z"""\r\n"",\r\n', D.Description(D.Record("f", (line,))))
    assert [[c.value for c in r.children] for r in root.children] == [["1", 'x\r\ny "z"'], ["", ""]]


def test_levels_of_paths_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(str(i), bytearray(DATA)) for i in range(3)], "path string, content binary").write.parquet(f"{tmp_path}/files")
    found = paths.with_paths(decode.nodes(spark.read.parquet(f"{tmp_path}/files"), VARIABLE))
    assert found.where("path = '/file/entry[2]/body/text/value' and value = 'abc'").count() == 3 and found.count() == 36
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bytes_compared():
    assert decode.compared(b"abcd", b"abXd") == (1, 2) and decode.compared(b"ab", b"abc") == (1, 2) and decode.compared(b"", b"") == (0, -1)


def test_metadata_errors(spark):
    files = spark.createDataFrame([("a", bytearray(b"<x")), ("b", bytearray(b'<!DOCTYPE x [<!ENTITY e "1">]><x/>')), ("c", None)], "path string, content binary")
    assert {r.path: bool(r.error) for r in packages.metadata(files).collect()} == {"a": True, "b": True, "c": True}


def test_summary_and_specs(spark):
    checks = spark.createDataFrame([(True,), (False,)], "preserved boolean")
    assert transform.preserved_summary(checks).first().asDict() == {"preserved": 1, "checked": 2}
    kind, settings = views.read_spec('<view><vector kind="line"><vertex><ordinate>x</ordinate><ordinate>y</ordinate></vertex></vector></view>')
    assert kind == "vector" and settings["vertices"] == [["x", "y"]]
    with pytest.raises(ValueError):
        views.read_spec("<view/>")
