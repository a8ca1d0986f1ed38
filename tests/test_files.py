"""Images, PDF files, the page sink and streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from decks import deck, para, pic, slide, sp
from slideframe.functions import images as I
from slideframe.model import ImportOptions
from slideframe.plans import sink
from slideframe.sources import office, package, pdf
from slideframe.streaming import imports


def solid(w, h, *rgba):
    return I.encode_png(np.tile(np.array(rgba, np.uint8), (h, w, 1)))


def wmf(depth=24):
    head = struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, depth, 0, 0, 0, 0, 0, 0)
    row = b"\xff\x00\x00" + b"\x00\xff\x00" + b"\x00\x00"
    params = struct.pack("<IHHHHHHHHH", 0x00CC0020, 0, 2, 2, 0, 0, 2, 2, 0, 0) + head + row + row
    record = struct.pack("<IH", (6 + len(params)) // 2, 0x0F43) + params
    return struct.pack("<HHHIHIH", 1, 9, 0x300, 9 + len(record) // 2 + 3, 0, len(record) // 2, 0) + record + struct.pack("<IH", 3, 0)


def filtered_png(px, kind):
    """A PNG whose lines all use one filter."""
    h, w, n = px.shape
    flat = px.reshape(h, w * n).astype(int)
    rows = []
    for y in range(h):
        line, up = flat[y], flat[y - 1] if y else np.zeros(w * n, int)
        out = bytearray([kind])
        for i in range(w * n):
            a, b, c = (line[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((line[i] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        rows.append(bytes(out))
    plain = I.encode_png(px)
    start = plain.index(b"IDAT") - 4
    body = zlib.compress(b"".join(rows))
    return plain[:start] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + plain[-12:]


def test_png_round_trip_and_filters():
    px = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (I.decode_png(I.encode_png(px)) == px).all()
    for kind in range(5):
        assert (I.decode_png(filtered_png(px, kind)) == px).all()
    assert I.decode_png(b"x") is None and I.decode_png(I.encode_png(px)[:60]) is None


def test_blank_images():
    assert I.is_blank(solid(40, 30, 255, 255, 255, 255)) and I.is_blank(solid(40, 30, 0, 0, 0, 0))
    assert not I.is_blank(solid(40, 30, 31, 78, 121, 255)) and not I.is_blank(b"no image")
    spot = np.full((30, 40, 4), 255, np.uint8)
    spot[3, 3] = 0, 0, 0, 255
    assert not I.is_blank(I.encode_png(spot))
    assert I.is_blank(solid(64, 64, 250, 252, 255, 255)) and not I.is_blank(solid(64, 64, 249, 255, 255, 255))


def test_downscale():
    assert I.png_size(I.downscale(solid(400, 100, 1, 2, 3, 255), 100)) == (100, 25)
    small = solid(40, 10, 1, 2, 3, 255)
    assert I.downscale(small, 100) == small and I.downscale(b"jpeg", 100) == b"jpeg"


def test_wmf_bitmap():
    px = I.decode_png(I.wmf_to_png(wmf()))
    assert px[:, :, :3].tolist() == [[[0, 0, 255], [0, 255, 0]]] * 2
    assert I.wmf_to_png(b"not a real metafile") is None and I.wmf_to_png(b"") is None and I.wmf_to_png(wmf()[:40]) is None
    assert I.vector_to_png(b"bad", "emf") is None
    assert I.vector_to_png(b"bad", "wmf", [lambda d, e: None, lambda d, e: b"png"]) == b"png"
    assert I.command(["no-such-program-here", "{in}", "{out}"], 1)(b"x", "emf") is None
    index = np.array([[0, 1], [1, 0]])
    dib = struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 8, 0, 0, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + bytes([0, 1, 0, 0, 1, 0, 0, 0])
    assert I.bitmap_pixels(dib).tolist() == np.array([[3, 2, 1], [7, 8, 9]])[index].tolist()


def test_prepared_media(spark):
    rows = [("d", "ppt/media/a.png", bytearray(solid(40, 30, 9, 9, 9, 255))), ("d", "ppt/media/w.png", bytearray(solid(4, 3, 255, 255, 255, 255))), ("d", "ppt/media/v.wmf", bytearray(wmf())), ("d", "x.emf", bytearray(b"?")), ("d", "s.mp3", bytearray(b"snd"))]
    got = I.prepared(spark.createDataFrame(rows, "deck_id string, path string, bytes binary"), 20)
    assert {r["path"]: r["ok"] for r in got.collect()} == {"ppt/media/a.png": True, "ppt/media/w.png": False, "ppt/media/v.wmf": True, "x.emf": False, "s.mp3": True}
    assert {r["content"] for r in I.failed(got).collect()} == {"ppt/media/w.png", "x.emf"}


def a_pdf(n):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Type /Page /Parent 1 0 R >> endobj\n" % i for i in range(n)) + b"1 0 obj << /Type /Pages >> endobj"


def test_pdf(spark):
    packed = b"%PDF-1.5 << /Type /ObjStm /Length 9 >> stream\n" + zlib.compress(b"<< /Type /Page >> << /Type/Page >>") + b"\nendstream"
    assert pdf.count_pages(a_pdf(3)) == 3 and pdf.count_pages(packed) == 2 and pdf.count_pages(b"") == 0
    files = spark.createDataFrame([("a", bytearray(a_pdf(2))), ("b", bytearray(a_pdf(501)))], "deck_id string, content binary")
    counts = pdf.page_counts(files)
    assert {r["deck_id"]: r["n_pages"] for r in counts.collect()} == {"a": 2, "b": 501}
    with pytest.raises(Exception, match="more than 500 pages"):
        pdf.within_limit(counts).collect()
    fake = lambda data, dim, font: ((i, f"page{i}.png", b"x") for i in range(1, pdf.count_pages(data) + 1))
    pages = pdf.pages(files.where("deck_id = 'a'"), fake).orderBy("slide_no").collect()
    assert [(p["title"], p["images"]) for p in pages] == [("Page 1", {"page1.png": "page1.png"}), ("Page 2", {"page2.png": "page2.png"})]
    with pytest.raises(Exception, match="more than 500 pages"):
        pdf.pages(files.where("deck_id = 'b'"), fake).collect()


def test_chain_appends(spark):
    pages = spark.createDataFrame([("L", "d", i, f"t{i}" * 200, "h", False, {f"{i}.png": "p"}) for i in (2, 1, 3)] + [("M", "d", 1, "x", "h", False, {})], "lesson_id string, deck_id string, slide_no int, title string, html string, issection boolean, images map<string,string>")
    stored = spark.createDataFrame([("L", 1, 0, 2), ("L", 2, 1, 0), ("N", 7, 0, 0)], "lesson_id string, page_id long, prev_id long, next_id long")
    new = sink.chained(pages, stored)
    got = {(r["lesson_id"], r["slide_no"]): (r["page_id"], r["prev_id"], r["next_id"], len(r["title"])) for r in new.collect()}
    assert got == {("L", 1): (3, 2, 4, 255), ("L", 2): (4, 3, 5, 255), ("L", 3): (5, 4, 0, 255), ("M", 1): (1, 0, 0, 1)}
    assert {(r["lesson_id"], r["page_id"]): r["next_id"] for r in sink.relinked(stored, new).collect()} == {("L", 1): 2, ("L", 2): 3, ("N", 7): 0}
    assert {r["jumpto"] for r in sink.answers(new).collect()} == {-1} and sink.answers(new).count() == 4
    have = spark.createDataFrame([("L", 3, "1.png")], "lesson_id string, page_id long, filename string")
    assert sorted(r["filename"] for r in sink.media_rows(new, have).collect()) == ["2.png", "3.png"]


def test_stream_imports_each_deck_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.pptx").write_bytes(deck([slide(sp(para(f"Title {name}"), ph='type="title"'))]))
    (tmp_path / "in" / "c.txt").write_text("no deck")
    for _ in range(2):
        q = imports.run(imports.arriving(spark, str(tmp_path / "in"), files_per_batch=2), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(240)
        assert q.exception() is None
    pages = spark.read.parquet(f"{tmp_path}/out/pages")
    assert sorted(r["title"] for r in pages.collect()) == ["Title a", "Title b"]
    assert spark.read.parquet(f"{tmp_path}/out/answers").count() == 2


def test_batches_append_to_a_lesson(spark, tmp_path):
    """Pages of a second batch follow the stored ones, the old tail points on, and a repeated batch replaces itself."""
    one, two = (deck([slide(sp(para(f"{n} {i}"), ph='type="title"'), pic("rId1", 0, 3000000, 900000, 900000)) for i in (1, 2)], [[("rId1", "../media/image1.png")]] * 2, {"ppt/media/image1.png": b"bytes"}) for n in ("one", "two"))
    rows = lambda *r: spark.createDataFrame([(n, bytearray(c)) for n, c in r], "deck_id string, content binary")
    folder = str(tmp_path / "store")
    fake = lambda data, dim, font: iter([(1, "page1.png", b"shot")])
    imports.import_batch(rows(("a.pptx", one), ("bad.pptx", b"no zip"), ("s.pdf", a_pdf(1))), folder, "0", lesson=F.lit("L"))
    for _ in range(2):
        imports.import_batch(rows(("b.pptx", two), ("t.pdf", a_pdf(1))), folder, "1", lesson=F.lit("L"), renderer=fake)
    got = [(r["page_id"], r["prev_id"], r["next_id"], r["title"]) for r in sink.read_pages(spark, folder).orderBy("page_id").collect()]
    assert got == [(1, 0, 2, "one 1"), (2, 1, 3, "one 2"), (3, 2, 4, "two 1"), (4, 3, 5, "two 2"), (5, 4, 0, "Page 1")]
    assert {(r["page_id"], r["filename"], bytes(r["bytes"])) for r in spark.read.parquet(f"{folder}/media").collect()} == {(1, "image1.png", b"bytes"), (2, "image1.png", b"bytes"), (3, "image1.png", b"bytes"), (4, "image1.png", b"bytes"), (5, "page1.png", b"shot")}
    assert {(r["deck_id"], r["error"]) for r in spark.read.parquet(f"{folder}/errors").collect()} == {("bad.pptx", "not a deck"), ("s.pdf", "no renderer")}


def test_a_deck_is_imported_whole_or_not_at_all(spark, monkeypatch):
    content = deck([slide(sp(para("x" * n), ph='type="title"')) for n in (5, 5, 5000)], extra={"ppt/media/a.png": b"a", "ppt/media/b.png": b"b" * 6000})
    real = package.Package
    monkeypatch.setattr(package, "Package", lambda data: real(data, part_limit=4000))
    assert list(package.read_slides(content)) == [{"error": "too large"}]
    monkeypatch.undo()
    rows = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"x"))], "deck_id string, content binary")
    got = package.parts(rows, "media/").collect()
    assert sorted((r["deck_id"], r["path"] or "", r["error"] or "") for r in got) == [("a", "ppt/media/a.png", ""), ("a", "ppt/media/b.png", ""), ("b", "", "not a deck")]


def test_one_writer_a_folder(spark, tmp_path):
    folder = str(tmp_path)
    with imports.locked(spark, folder, "first"):
        with pytest.raises(TimeoutError):
            with imports.locked(spark, folder, "second", wait=0.3):
                pass
    with imports.locked(spark, folder, "second", wait=0.3):
        with imports.locked(spark, folder, "second", wait=0.3):  # the same writer, started again
            pass


def test_pages_behind_64_mebibytes_are_counted():
    body = b"<< /Type /Page >> " + b" " * (70 << 20) + b"<< /Type /Page >> " * 600
    data = b"1 0 obj << /Type /ObjStm >> stream\n" + zlib.compress(body, 1) + b"endstream"
    assert pdf.count_pages(data) == 601


def test_requests(spark):
    counts = spark.createDataFrame([("a", 30), ("b", 31)], "deck_id string, n_pages int")
    assert {r["deck_id"]: r["route"] for r in imports.routed(counts).collect()} == {"a": "inline", "b": "queued"}
    asked = spark.createDataFrame([("L",), ("M",)], "lesson_id string")
    assert [r["lesson_id"] for r in imports.admitted(asked, spark.createDataFrame([("L",)], "lesson_id string")).collect()] == ["M"]
    files = spark.createDataFrame([("x.PDF",), ("y.pptx",), ("z",)], "p string").select(imports.backend(F.col("p")).alias("b"))
    assert [r["b"] for r in files.collect()] == ["pdf", "deck", "deck"]
    staged = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS created UNION ALL SELECT 2, timestamp'2024-01-02 00:00:00' UNION ALL SELECT 3, timestamp'2024-01-08 12:00:00'")
    assert [r["id"] for r in imports.expired(staged, F.lit("2024-01-09 00:00:00").cast("timestamp")).collect()] == [1]
    assert imports.effective_mode(ImportOptions(import_mode="images"), False) == "editable"
    with pytest.raises(ValueError):
        ImportOptions(body_size=13)


def test_stream_admits_a_lesson_once(spark, tmp_path):
    spark.sql("SELECT 'L' AS lesson_id, timestamp'2024-01-01 00:00:00' AS requested UNION ALL SELECT 'L', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 'M', timestamp'2024-01-01 00:00:00'").write.parquet(f"{tmp_path}/q")
    rows = spark.readStream.schema("lesson_id string, requested timestamp").parquet(f"{tmp_path}/q")
    q = imports.once_per_lesson(rows).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["lesson_id"] for r in spark.read.parquet(f"{tmp_path}/o").collect()) == ["L", "M"]


def test_office(monkeypatch):
    theme = b'<a:latin typeface="Old"/><q:latin typeface="Older" panose="1"/>'
    content = deck([slide()], extra={"ppt/theme/theme1.xml": theme, "ppt/media/latin.bin": b'<a:latin typeface="Old"/>'})
    changed = package.Package(office.with_render_font(content, "Arial"))
    assert changed.read("ppt/theme/theme1.xml") == b'<a:latin typeface="Arial"/><q:latin typeface="Arial" panose="1"/>'
    assert changed.read("ppt/media/latin.bin") == b'<a:latin typeface="Old"/>'
    assert office.with_render_font(content, "Wingdings") == content
    with pytest.raises(package.TooLarge):
        office.check_sizes(content, part_limit=10)
    calls, now = [], [0.0]
    probe = office.Availability(lambda: calls.append(1) or True, 10, lambda: now[0])
    assert probe() and probe() and len(calls) == 1
    now[0] = 11.0
    assert probe() and len(calls) == 2
    monkeypatch.setenv("PATH", "/nowhere")
    assert probe() and len(calls) == 3
    assert not office.runs(["no-such-program-here"], "x")
    with pytest.raises(RuntimeError):
        next(office.libreoffice(content))


def test_bitmaps_at_any_place_in_a_record():
    header = struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 24, 0, 0, 0, 0, 0, 0)
    unsound = [struct.pack("<IiiHHIIiiII", 40, w, h, p, d, 0, 0, 0, 0, 0, 0) for w, h, p, d in ((0, 1, 1, 24), (2, 20001, 1, 24), (2, -(1 << 31), 1, 24), (2, 2, 2, 24), (2, 2, 1, 5))]
    for before in (b"", bytes(22), unsound[0] + bytes(2), b"".join(unsound)):
        assert I.find_bitmap(before + header + b"rows") == header + b"rows"
    assert I.find_bitmap(b"".join(unsound)) is None and I.find_bitmap(bytes(1) + header) is None and I.find_bitmap(header[:39]) is None and I.find_bitmap(b"") is None


def test_records_end_at_the_first_that_is_cut():
    head = struct.pack("<H", 1) + bytes(16)
    body = struct.pack("<IH", 4, 7) + b"ab" + struct.pack("<IH", 3, 8)
    whole = [(7, b"ab"), (8, b"")]
    listed = lambda data: [(f, bytes(b)) for f, b in I.records(data)]
    assert listed(head + body) == listed(I.PLACEABLE + head + body) == listed(head + body + struct.pack("<IH", 2, 9)) == listed(head + body + struct.pack("<IH", 9, 9)) == whole
    assert listed(b"\x03" + head[1:] + body) == listed(head[:17]) == listed(b"") == []


def test_tasks_as_json(spark):
    text = spark.range(1).select(imports.task_json(F.lit("a.pptx"), F.lit("L"), ImportOptions(body_size=14, card_group=True)).alias("t")).first()["t"]
    rows = spark.createDataFrame([(text,), ('{"deck_id": "b.pdf"}',), ("no json",), (None,)], "task string")
    got = {r["deck_id"]: (r["lesson_id"], r["options"]) for r in imports.read_tasks(rows).collect()}
    assert set(got) == {"a.pptx", "b.pdf", None} and got["a.pptx"][0] == "L" and got["b.pdf"] == (None, None)
    assert imports.options_of(got["a.pptx"][1]) == ImportOptions(body_size=14, card_group=True)
    assert imports.options_of(None) == ImportOptions() and imports.options_of('{"unknown": 1, "card_group": null}') == ImportOptions()


def test_long_imports_wait_in_the_queue(spark, tmp_path):
    """Short files at once; of a lesson's long ones the first queued, further requests refused until a worker has finished it."""
    source, folder = tmp_path / "in [x]", str(tmp_path / "out")
    source.mkdir()
    for name, n in (("short", 1), ("long", 3), ("longer", 4)):
        (source / f"{name}.pptx").write_bytes(deck([slide(sp(para(f"{name} {i}"), ph='type="title"')) for i in range(n)]))
    (source / "sheets.pdf").write_bytes(a_pdf(3))
    files = package.decks(spark, str(tmp_path))
    name = F.regexp_extract("deck_id", r"([^/]+)\.\w+$", 1)
    lesson = F.when(name == "sheets", "M").otherwise("L")
    fake = lambda data, dim, font: iter([(1, "page1.png", b"shot")])
    titles = lambda: sorted(r["title"] for r in spark.read.parquet(f"{folder}/pages").collect())
    refused = lambda batch: sorted(r["n"] for r in spark.read.parquet(f"{folder}/refused/batch={batch}").select(name.alias("n")).collect())
    for _ in range(2):
        imports.submit(files, folder, "0", ImportOptions(slide_title="S {}"), lesson, fake, threshold=2)
        assert titles() == ["short 0"] and refused(0) == ["longer"]
        assert sorted(r["n"] for r in imports.waiting(spark, folder).select(name.alias("n")).collect()) == ["long", "sheets"]
    imports.submit(files.where(name == "short"), folder, "1", lesson=lesson, threshold=2)
    assert titles() == ["short 0"] and refused(1) == ["short"]
    (source / "sheets.pdf").unlink()
    assert imports.work_off(spark, folder, fake, batches=5) == 2
    assert titles() == ["long 0", "long 1", "long 2", "short 0"] and imports.waiting(spark, folder).count() == 0
    assert imports.work_off(spark, folder, fake) == 0
    imports.submit(package.decks(spark, str(source).replace("[", "\\[")).where(name == "short"), folder, "2", lesson=lesson, threshold=2)
    assert [(r["page_id"], r["next_id"]) for r in sink.read_pages(spark, folder).orderBy("page_id").collect()] == [(1, 2), (2, 3), (3, 4), (4, 5), (5, 0)]


def test_imports_prepare_their_media(spark, tmp_path):
    """Large pictures shrink, drawings become PNG, blank pictures leave the page, complex slides become pictures if wanted."""
    media = {"ppt/media/image1.png": solid(40, 30, 9, 9, 9, 255), "ppt/media/image2.png": solid(4, 3, 255, 255, 255, 255), "ppt/media/image3.wmf": wmf()}
    rels = [[("rId1", "../media/image1.png"), ("rId2", "../media/image2.png"), ("rId3", "../media/image3.wmf")], [("rId1", "../media/image1.png")]]
    at = lambda i: pic(f"rId{i}", 3000000 * i, 3000000, 900000, 900000)
    led = slide(pic("rId1", 0, 0, 10000000, 6000000), sp(para("One"), 100, 100, 900000, 900000), sp(para("Two"), 5000000, 100, 900000, 900000))
    rows = spark.createDataFrame([("d.pptx", bytearray(deck([slide(at(1), at(2), at(3)), led], rels, media)))], "deck_id string, content binary")
    fake = lambda data, dim, font: iter([(1, "page1.png", b"one"), (2, "page2.png", b"two")])
    imports.import_batch(rows, str(tmp_path), "0", ImportOptions(image_max_dim=20, smartart_images=True), renderer=fake)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tmp_path}/pages").collect()}
    stored = {(r["page_id"], r["filename"]): bytes(r["bytes"]) for r in spark.read.parquet(f"{tmp_path}/media").collect()}
    assert set(stored) == {(1, "image1.png"), (1, "image3.png"), (2, "page2.png")} and stored[2, "page2.png"] == b"two"
    assert I.png_size(stored[1, "image1.png"]) == (20, 15) and I.png_size(stored[1, "image3.png"]) == (2, 2)
    assert "image2" not in pages[1] and "page2.png" in pages[2]
