import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arkivel.functions import description as D
from arkivel.functions.expressions import evaluate, parse
from arkivel.operators import decode as X
from arkivel.operators import transform, views
from arkivel.sources import sinks

PACKET = D.Description(
    D.Record("packet", (
        D.Field("version", "UINT8"), D.Field("n", "UINT16"), D.Field("size", "UINT8"), D.Field("name", "STRING", "size"),
        D.Record("item", (
            D.Field("kind", "UINT8"),
            D.Choice("body", "kind", (("1", D.Field("temp", "FLOAT32", big=False)), ("2..9", D.Record("label", (D.Field("size", "UINT8"), D.Field("text", "STRING", "size")))))),
            D.Field("flags", "UINT8"), D.Field("extra", "UINT16", times=D.Times("optional", "flags = 1")),
        ), D.Times("repeated", "n")),
        D.Field("pad", "BYTES", "n * 2 - 1"), D.Field("trailer", "UINT8", times=D.UNTIL_END),
    ))
)


def packet() -> bytes:
    return b"\x01\x00\x02\x03abc" + b"\x01" + struct.pack("<f", 1.5) + b"\x01\x00\x07" + b"\x02\x02hi\x00" + b"\xaa\xbb\xcc" + b"\x05\x06"


def test_packet_lines_and_write_back():
    root = X.decoded(packet(), PACKET)
    assert X.canonical(root) == [
        "/version = 1", "/n = 2", "/size = 3", "/name = abc", "/item[1]/kind = 1", "/item[1]/body: choice -> temp", "/item[1]/body/temp = 1.5",
        "/item[1]/flags = 1", "/item[1]/extra = 7", "/item[2]/kind = 2", "/item[2]/body: choice -> label", "/item[2]/body/label/size = 2",
        "/item[2]/body/label/text = hi", "/item[2]/flags = 0", "/pad = 0xaabbcc", "/trailer[1] = 5", "/trailer[2] = 6",
    ]
    assert X.compared(packet(), X.encoded(root, PACKET)) == (0, -1)
    assert not D.problems(PACKET)
    assert D.lacking(PACKET, "DRB") == set()


def test_bits_sizes_zlib_text():
    bits = D.Description(D.Record("r", (D.Field("a", "BITS", bits=3), D.Field("b", "BITS", bits=5), D.Field("c", "UINT64"))))
    raw = bytes([0b10100111]) + (2**64 - 1).to_bytes(8, "big")
    root = X.decoded(raw, bits)
    assert [c.value for c in root.children] == [5, 7, 2**64 - 1]
    assert X.encoded(root, bits) == raw
    sized = D.Description(D.Record("r", (D.Record("box", (D.Field("x", "INT16"),), size="4"), D.Field("y", "INT8"))))
    assert X.canonical(X.decoded(b"\x00\x05\x00\x00\xff", sized)) == ["/box/x = 5", "/y = -1"]
    packed = D.Description(D.Record("r", (D.Field("x", "INT32"),), zlib=True))
    assert X.canonical(X.decoded(zlib.compress(b"\0\0\0\x2a"), packed)) == ["/x = 42"]
    text = D.Description(D.Record("row", (D.Field("name", "STRING"), D.Field("n", "INT32", nil="NA")), D.UNTIL_END, separator=",", quote='"'))
    root = X.decoded(b'"a,""b""",1\nc,NA', text)
    assert X.canonical(root) == ['/row[1]/name = a,"b"', "/row[1]/n = 1", "/row[2]/name = c", "/row[2]/n = <nil>"]
    assert X.encoded(root, text) == b'"a,""b""",1\nc,NA\n'


def test_problems_are_told():
    bad = D.Description(D.Record("r", (D.Field("x", "STRING", "later"), D.Field("x", "BITS", bits=65), D.Field("z", "WORD"))))
    said = " ".join(D.problems(bad))
    assert "later is not known" in said and "occurs twice" in said and "1 to 64" in said and "no type" in said
    assert D.found(PACKET, "/packet/item/kind").kind == "UINT8"
    assert D.found(D.changed(PACKET, "/packet/pad", lambda e: None), "/packet/pad") is None


def test_nodes_isolate_bad_files(spark):
    files = spark.createDataFrame([("good", bytearray(packet())), ("bad", bytearray(b"\x01"))], "path string, content binary")
    rows = X.nodes(files, PACKET).toPandas()
    assert list(rows[rows.doc_id == "bad"].kind) == ["ERROR"]
    assert (rows[(rows.doc_id == "good") & (rows.name == "temp")].bit_start == 64).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.text(st.characters(max_codepoint=255, exclude_characters="\0"), max_size=20)), max_size=5))
def test_round_trip_of_any_rows(rows):
    d = D.Description(D.Record("f", (D.Field("n", "UINT8"), D.Record("row", (D.Field("k", "INT32"), D.Field("m", "UINT8"), D.Field("s", "STRING", "m")), D.Times("repeated", "n")))))
    raw = bytes([len(rows)]) + b"".join(struct.pack(">iB", k, len(s)) + s.encode("latin-1") for k, s in rows)
    assert X.encoded(X.decoded(raw, d), d) == raw


def test_expressions():
    look = {("a",): 7, ("b",): -2, ("s", "t"): "x"}.get
    for text, value in {"a / b": -3, "a % b": 1, "-a / 2": -3, "not a = 7": 0, "a > 2 and s.t = 'x'": 1, "0x10 + 1": 17, "10 < 9": 0, "'10' < 9": 1, "not 0 = 1 or 0": 1}.items():
        assert evaluate(parse(text), look) == value, text
    with pytest.raises(ValueError):
        parse("a +")


def test_mapping_text():
    rules = transform.parse_mapping("count = count(star)\nfor stars in star\n name = name\n ra = ra * 0.5 - 2\nend\nfrom = \"x\"")
    assert [c.source for c in transform.copies(rules)] == ["star.name", "star.ra"]
    assert transform.missing_targets(rules, ["stars.name", "count", "other"]) == ["other"]
    assert transform.reversible(rules, ["star.name", "star.ra"], [], {"stars.name"}) == ["star.ra"]
    with pytest.raises(ValueError):
        transform.parse_mapping("for a in b")


def test_fits_and_storage():
    assert views.fits_storage(0, 255, 0) == (8, 0)
    assert views.fits_storage(-1, 255, 0) == (16, 0)
    assert views.fits_storage(0, 65535, 0) == (16, 32768)
    assert views.fits_storage(0, 1, 3) == (-64, 0)
    made = sinks.fits_image(np.array([[1.0, np.nan], [3.0, 40000.0]]), 16, 32768)
    assert len(made) % 2880 == 0
    head = {k: v for k, v, _ in sinks.fits_headers(made)[0]}
    assert head["BITPIX"] == "16" and head["BZERO"] == "32768" and head["NAXIS1"] == "2"
