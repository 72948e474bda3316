"""Parser, writer, codecs and the rewrite on files made here."""

import os
import random

import numpy as np
import pytest

from leafmill.functions import codecs
from leafmill.functions.content import minify, placements
from leafmill.functions.document import fields, optimize, pdfa_part, resize, signatures
from leafmill.operators.policy import Options
from leafmill.sources.pdf import Document, Name, PdfError, Real, Ref, Stream, String, parse, serialize, write
from leafmill.sources.synth import document, image, placed_image, text_document


@pytest.mark.parametrize("early", [0, 1])
@pytest.mark.parametrize("n", [0, 1, 2, 255, 4095, 60_000])
def test_lzw(early, n):
    for data in (os.urandom(n), bytes(random.Random(n).choices(b"ab", k=n))):
        assert codecs.lzw_decode(codecs.lzw_encode(data, early), early) == data


def test_lzw_known_answer():
    # the example of ISO 32000-1, 7.4.4.2
    assert codecs.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_ascii_filters():
    assert codecs.ascii85_decode(b"9jqo^~>") == b"Man "
    assert codecs.ascii85_decode(b"z~>") == bytes(4)
    assert codecs.ascii85_decode(b"9~>") is None
    assert codecs.ascii_hex_decode(b"48 65 6c6C 6f7>") == b"Hellop"
    assert codecs.ascii_hex_decode(b"4x>") is None
    assert codecs.run_length_decode(bytes([2, 1, 2, 3, 254, 7, 128])) == b"\1\2\3\7\7\7"
    assert codecs.run_length_decode(bytes([5, 1])) is None


@pytest.mark.parametrize("bpp", [1, 2, 3, 4])
@pytest.mark.parametrize("tag", range(5))
def test_png(tag, bpp):
    raster = os.urandom(60 * 9)
    assert codecs.png_defilter(codecs.png_filter(raster, 60, bpp, tag), 60, bpp) == raster


def test_png_declines():
    assert codecs.png_defilter(b"\x09abc", 3, 1) is None
    assert codecs.png_defilter(b"\x00ab", 3, 1) is None


def test_inflate_limits():
    bomb = codecs.deflate(bytes(10_000))
    assert codecs.inflate_capped(bomb, 9_999) is None
    assert codecs.inflate_capped(bomb, 10_000) == bytes(10_000)
    assert codecs.inflate_capped(bomb[:-3]) is None
    assert codecs.redeflate(codecs.deflate(b"x" * 100)) is None


@pytest.mark.parametrize(("a", "b"), [("+01.50", "1.5"), ("-0.0", "0"), ("00", "0"), ("0.5", ".5"), ("5.", "5"), ("-0.50", "-.5"), ("1e5", "1e5"), ("100", "100"), ("-.0", "0")])
def test_minify_number(a, b, spark):
    from pyspark.sql import functions as F

    from leafmill.operators.policy import minify_number

    assert codecs.minify_number(a) == b
    assert spark.createDataFrame([(a,)], "x string").select(minify_number(F.col("x"))).first()[0] == b


@pytest.mark.parametrize("pack", [True, False])
def test_round_trip(pack):
    doc = parse(placed_image(1, (20, 10), (72.0, 36.0)))
    doc.objects[Ref(50, 0)] = {"A": [None, True, Real("841.91998"), String(b"a(b)\\\r"), String(b"\xff", True), Name("x y#")]}
    doc.trailer["Extra"] = Ref(50, 0)
    back = parse(write(doc, pack))
    assert {r: serialize(v) if not isinstance(v, Stream) else v.data for r, v in back.objects.items()} == {r: serialize(v) if not isinstance(v, Stream) else v.data for r, v in doc.objects.items()}
    assert write(back, pack) == write(doc, pack)
    assert b"841.91998" in write(back, False)


def test_damaged_xref_is_rebuilt():
    data = placed_image(1, (20, 10), (72.0, 36.0))
    broken = data.replace(b"startxref\n", b"startxref\n9")
    assert parse(broken).objects.keys() == parse(data).objects.keys()


@pytest.mark.parametrize("data", [b"", b"junk", b"%PDF-1.4", b"%PDF-1.4\nstartxref\n0\n%%EOF", os.urandom(500), b"%PDF-1.7\n1 0 obj\n" + b"[" * 5000])
def test_hostile_input_comes_back(data):
    r = optimize(data)
    assert r.output == data and not r.rewritten


def test_truncated_files_come_back_or_shrink():
    data = text_document(2, "hello world " * 40, 3)
    for n in range(0, len(data), 97):
        r = optimize(data[:n])
        assert r.output == data[:n] or len(r.output) < n


def test_cycles_end():
    doc = Document(objects={Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0), "AcroForm": {"Fields": [Ref(5, 0)]}}, Ref(2, 0): {"Type": Name("Pages"), "Kids": [Ref(2, 0), Ref(3, 0)]}, Ref(3, 0): {"Type": Name("Page"), "Parent": Ref(3, 0)}, Ref(5, 0): {"Kids": [Ref(5, 0)], "FT": Name("Sig"), "T": String(b"x")}, Ref(6, 0): Ref(7, 0), Ref(7, 0): Ref(6, 0)}, trailer={"Root": Ref(1, 0)})
    assert doc.get(Ref(6, 0)) is None
    assert [r for r, _ in doc.pages()] == [Ref(3, 0)]
    assert doc.inherited(doc.objects[Ref(3, 0)], "Resources") is None
    assert signatures(doc) == []
    doc.objects[Ref(5, 0)]["Kids"] = [{"T": String(b"y"), "Kids": [Ref(5, 0)]}]
    with pytest.raises(PdfError):
        fields(doc)


def test_placements_of_nested_forms():
    form = Stream({"Subtype": Name("Form"), "Matrix": [2, 0, 0, 2, 0, 0], "Resources": {"XObject": {"I": Ref(100, 0), "Self": Ref(101, 0)}}}, b"q 10 0 0 5 0 0 cm /I Do Q /Self Do")
    data = document([(b"3 0 0 3 0 0 cm /F Do", {"F": Ref(101, 0)})], {Ref(100, 0): image(4, 4), Ref(101, 0): form})
    assert placements(parse(data)) == [(Ref(100, 0), 60.0, 30.0)]


def test_minify_content():
    assert minify(b"q  01.500 0 0 -0.0 10.00   +5 cm\nQ % end") == b"q\n1.5 0 0 0 10 5 cm\nQ"
    assert minify(b"(a 0.50 b) Tj") == b"(a 0.50 b) Tj"
    assert minify(b"1 2 3") == b"1 2 3"


def test_downsampling_is_smaller_and_idempotent():
    data = placed_image(3, (400, 400), (72.0, 72.0))
    r = optimize(data)
    assert r.rewritten and len(r.output) < len(data) and r.passes["downsampled"] == 1
    again = parse(r.output)
    (new,) = [v for v in again.objects.values() if isinstance(v, Stream) and v.dict.get("Subtype") == "Image"]
    assert (new.dict["Width"], new.dict["Height"]) == (130, 130)
    assert optimize(r.output).output == r.output
    kept = optimize(data, Options().with_(target_dpi=0))
    assert "downsampled" not in kept.passes


def test_gray_collapse():
    gray = image(64, 64, 3, gray=True)
    data = document([(b"q 64 0 0 64 0 0 cm /I Do Q", {"I": Ref(100, 0)})], {Ref(100, 0): gray})
    r = optimize(data)
    assert r.passes["gray"] == 1
    (new,) = [v for v in parse(r.output).objects.values() if isinstance(v, Stream) and v.dict.get("Subtype") == "Image"]
    assert new.dict["ColorSpace"] == "DeviceGray"
    assert new.decoded() == gray.decoded()[::3]


def test_legacy_filters_become_flate():
    body = b"BT (legacy) Tj ET " * 30
    data = document([(b"", {})], {Ref(100, 0): Stream({"Filter": [Name("ASCIIHexDecode"), Name("LZWDecode")]}, codecs.lzw_encode(body).hex().encode() + b">")}, {"X": Ref(100, 0)})
    r = optimize(data)
    assert r.passes["legacy"] == 1
    assert any(isinstance(v, Stream) and v.decoded() == body for v in parse(r.output).objects.values())


def test_signatures_and_never_larger():
    r = optimize(text_document(2, "signed", 3))
    assert r.rewritten and [k for _, _, k in r.signatures] == ["field"]
    assert optimize(text_document(3, "plain", 3)).signatures == []


def test_encrypted_files_come_back():
    doc = parse(text_document(2, "x", 3))
    doc.trailer["Encrypt"] = {"Filter": Name("Standard")}
    data = write(doc, False)
    assert optimize(data).output == data


def test_pdfa_claim():
    xmp = b'<x xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" pdfaid:part="1"/>'
    doc = parse(document([(b"", {})], {Ref(100, 0): Stream({}, xmp)}, {"Metadata": Ref(100, 0)}))
    assert pdfa_part(doc) == "1"


def test_fields_inherit():
    doc = Document(objects={Ref(1, 0): {"AcroForm": {"Fields": [Ref(2, 0)]}}, Ref(2, 0): {"T": String(b"a"), "FT": Name("Tx"), "V": String(b"\xfe\xff\x00A\x00d"), "Kids": [Ref(3, 0)]}, Ref(3, 0): {"T": String(b"b")}}, trailer={"Root": Ref(1, 0)})
    assert fields(doc) == [{"name": "a.b", "kind": "Tx", "value": "Ad", "widgets": 1, "drawn": 0}]


def test_resize_keeps_flat_areas():
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (resize(flat, 11, 7) == 77).all() and (resize(flat, 11, 7, 1) == 77).all()
