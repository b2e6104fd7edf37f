import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.sources import adapters as A
from loomspan.sources.corpus import read_jsonl, write_jsonl
from loomspan.sources.files import load_any, ocr, text_of_html


def texts(spark, path):
    return spark.read.text(str(path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def pages(spark, file, *texts_):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts_)], "file string, page_no int, text string")


def test_jsonl_round_trip_order_and_strictness(spark, tmp_path):
    doc = {"id": "", "text": " hello ", "evidence_type": "hadith", "citation": {"source_id": "k", "evidence_type": "hadith", "volume": "1"}, "tags": ["t"]}
    (tmp_path / "in/b").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_text("# note\n\n" + json.dumps(doc) + "\n" + json.dumps(doc | {"id": "x", "confidence": "high", "language": "en"}) + "\n")
    (tmp_path / "in/b/c.jsonl").write_text(json.dumps(doc | {"id": "x", "text": "later"}))
    d = read_jsonl(spark, str(tmp_path / "in")).orderBy("first_seen")
    rows = d.collect()
    assert [r.id for r in rows] == ["doc_2cf24dba5fb0a30e", "x", "x"] and rows[0].confidence == "unverified" and rows[0].language == "ar" and rows[0].citation.volume == "1"
    write_jsonl(d, str(tmp_path / "out"))
    line = json.loads(next((tmp_path / "out/source_id=k").glob("*.txt")).read_text().splitlines()[0])
    assert line["view_status"] is None and "page" not in line["citation"]
    for bad in ("{not json", json.dumps(doc | {"evidence_type": "rumour"}), json.dumps(doc | {"confidence": "sure"})):
        (tmp_path / "in/a.jsonl").write_text(bad)
        with pytest.raises(PySparkException):
            read_jsonl(spark, str(tmp_path / "in")).collect()


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.HTML").write_text("<style>x</style><p>A &amp; B</p><script>no</script><b>c")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in load_any(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain", "b.HTML": "A & B\nc"} and text_of_html(None) == ""
    (tmp_path / "c.pdf").write_text("x")
    with pytest.raises(NotImplementedError):
        load_any(spark, str(tmp_path))
    (tmp_path / "c.pdf").rename(tmp_path / "c.xyz")
    with pytest.raises(ValueError):
        load_any(spark, str(tmp_path))
    with pytest.raises(NotImplementedError):
        ocr("x")


def test_verses_join_editions(spark, tmp_path):
    for name, rows in {"ar": [(1, 1, "ب"), (2, 1, "ج"), (1, 2, "د")], "en": [(1, 1, " In the name "), (1, 2, "")], "ur": [(1, 1, "نام")]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"quran": [{"chapter": c, "verse": v, "text": t} for c, v, t in rows]}))
    e = {n: A.edition(spark, str(tmp_path / f"{n}.json")) for n in ("ar", "en", "ur")}
    (r,) = A.verses(e["ar"], e["en"], "Name", e["ur"], "Urdu").collect()
    assert (r.id, r.text, r.confidence, r.citation.arabic_text, r.citation.translation_ur, r.tags) == ("quran-1-1", "In the name", "high", "ب", "نام", ["quran", "surah-1"])
    assert A.verses(e["ar"], e["en"], "Name").first().citation.translation_ur_source is None


def test_narrations_of_a_tree(spark, tmp_path):
    def put(name, path, **verse):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"kind": "verse_detail", "data": {"verse": {"path": path, **verse}}}))

    put("1/10.json", "/b:1:3:10", text=["عن  ابي"], translations={"en.b": ["He", " said"]}, gradings=["Majlisi: <b>ضعيف</b> - W", "X: صحيح"])
    put("1/2.json", "/b:1:3:2", text={"ar": ["نص"]}, translations={}, gradings={"m": "معتبر", "n": ""})
    put("1/3.json", "/b:3", text=["x"])
    put("1/4.en.json", "/b:1:1:4", text=["x"])
    put("1/5.json", "/b:7:5", text=[], translations={"en.a": ["two", "parts"]})
    put("1/6.json", "/b:1:1:6", text=[])
    (tmp_path / "1/7.json").write_text("{broken")
    got = A.narrations(spark, str(tmp_path), "k", "Book", ("en.a", "en.b"), "T").collect()
    assert [r.id for r in got] == ["k-1-3-2", "k-1-3-10", "k-7-5"]
    assert (got[1].text, got[1].confidence, got[1].citation.grade, got[1].citation.grade_source, got[1].citation.chapter, got[1].citation.volume) == ("He said", "low", "daif", "Majlisi: ضعيف - W; X: صحيح", "Book, 3", "1")
    assert (got[0].text, got[0].language, got[0].citation.grade, got[0].confidence) == ("نص", "ar", "muwaththaq", "medium") and got[2].citation.chapter == "Book, 7" and got[2].citation.volume is None
    at = spark.createDataFrame([("/n:1:5:2",), ("/n:3:7",), ("/n",)], "p string").select(*[c.alias(k) for k, c in A.locators(F.col("p"), "T", "nahj").items()]).collect()
    assert [(r.chapter, r.hadith_number) for r in at] == [("Sermon 5", "2"), ("Saying 7", "1"), (None, None)]


def test_prayers_attach_the_next_translation(spark, tmp_path):
    long = "دعاء طويل بما يكفي للحفظ هنا"
    items = [{"type": "Text", "content": long}, {"type": "Note", "content": "-"}, {"type": "Translate", "content": "ترجمه"}, {"type": "Text", "content": "قصير"}, {"type": "Text", "content": long + " ٢"}]
    (tmp_path / "m.json").write_text(json.dumps([{"title": "Part\n1", "sections": [{"title": "", "articles": [{"title": "A", "items": items}, {"title": "", "items": [{"type": "Text", "content": "<b>" + long}]}]}]}]))
    got = A.prayers(spark, str(tmp_path / "m.json"), "m", "P").collect()
    assert [(r.id, r.citation.page, r.citation.chapter, r.citation.translation) for r in got] == [("m-1-0", "1.0", "Part 1 / A", "ترجمه"), ("m-1-4", "1.4", "Part 1 / A", None), ("m-2-0", "2.0", "Part 1 / article 2", None)]


def test_plain_volumes_and_noise(spark, tmp_path):
    lines = ["A real sentence of prose.", "Contents ......... 12", "17", "see www.site.org", "ذذذذ ذذذذذذ ذذذذذذذذذ", "", "B" * 300]
    (tmp_path / "vol3.txt").write_text("\n".join(lines))
    (r,) = A.plain_volumes(texts(spark, tmp_path), "t").collect()
    assert (r.id, r.text, r.citation.volume, r.citation.page) == ("t-v3-0", lines[0] + "\n\n" + "B" * 300, "3", "0")


def test_prose_book(spark, tmp_path):
    (tmp_path / "2-b.md").write_text("\n# Second *one*\n> quoted [link](http://x) text[^1] that is long enough to be kept.\n\n[^1]: note\n")
    (tmp_path / "10-c.md").write_text("Title\n=====\n<p>Body</p> of the tenth chapter which is also long enough to keep.")
    (tmp_path / "3-nav.md").write_text("# Short\nnothing")
    (tmp_path / "4-plain.md").write_text("No heading at all but a body that is longer than forty characters.")
    got = {r.id: r for r in A.prose_book(texts(spark, tmp_path), "b", "tafsir", "T", volume="1").collect()}
    assert set(got) == {"b-v1-2-0", "b-v1-10-0", "b-v1-4-0"} and got["b-v1-2-0"].text == "quoted link text that is long enough to be kept." and got["b-v1-2-0"].citation.chapter == "Second one"
    assert got["b-v1-10-0"].citation.chapter == "Title" and got["b-v1-10-0"].text.startswith("Body of") and got["b-v1-10-0"].citation.page == "10.0" and got["b-v1-4-0"].citation.chapter == "4-plain"


def test_marked_texts(spark, tmp_path):
    (tmp_path / "x").write_text("#META# 043.EdPUBLISHER :: Press\n#META#040.EdEDITOR:: NODATA\n#META#Header#End#\n### | [Bab one]\n# front matter without a page yet but long enough ms12\n# second para\n~~ goes on PageV01P005\n### || Two\n### $ an entry of a person with enough characters\n# last one after it PageV02P007 and on and on and on\n### | Three\n# after the last mark with quite enough characters here")
    got = A.marked_texts(texts(spark, tmp_path), "o", "biographical").orderBy("id").collect()
    assert [(r.citation.chapter, r.citation.volume, r.citation.page) for r in got] == [("Bab one", "1", "5"), ("Two", "1", "5"), ("Three", "2", "7")]
    assert got[0].text == "front matter without a page yet but long enough\nsecond para goes on" and got[0].citation.translation_source == "x, ed. Press"


def test_indented_texts(spark, tmp_path):
    (tmp_path / "r").write_text(" " * 20 + "Heading\n   First paragraph of the section\ngoes on here\n   Second paragraph [pic]\n   Third paragraph of it\n______\n" + " " * 20 + "Next\n\n   Another text with some forty characters in it.\n")
    got = A.indented_texts(texts(spark, tmp_path), "r", "historical", "T").orderBy("id").collect()
    assert [(r.citation.chapter, r.text) for r in got] == [("Heading", "First paragraph of the section goes on here\nThird paragraph of it"), ("Next", "Another text with some forty characters in it.")]


def test_footnoted_volumes(spark):
    header = r"Great Book\s+Volume\s+(\d+)\s+Page\s+(\d+)"
    body = "A long enough narration that runs on and on until its closing mark.’ "
    p1 = f"Great Book Volume 2 Page 9\n{body}{body}1\nقال الامام عليه السلام\nBegins here {body}"
    p2 = f"Great Book Volume 2 Page 10\nand ends.’ {body}2\n{body}3\n1 Great Ch 4 H 7\n2 Great Ch 4 H 8 b\n3 Great Ch 5 H 1"
    d = pages(spark, "v2.pdf", p1, p2, "Great Book Volume 2 Page 11\n" + "tail without notes " * 8)
    got = A.footnoted_volumes(d, "g", "T", header, note=r"^(\d+)\s+Great.*?Ch\s*(\d+)\s*H\s*(\d+)\s*([a-z]?)", least=60).collect()
    assert [(r.id, r.citation.page) for r in got] == [("g-v2-p11", "11"), ("g-v2-ch5-h1", "10"), ("g-v2-ch4-h7", "10"), ("g-v2-ch4-h8b", "10")]
    assert "قال الامام" in got[3].citation.arabic_text and got[3].text.startswith("Begins here")
    again = A.resplit_pages(spark.createDataFrame([("g-v2-p10", f"{body}1\n1 Great Ch 4 H 7"), ("g-v2-ch1-h1", "x")], "id string, text string"), "g", r"^(\d+)\s+Great.*?Ch\s*(\d+)\s*H\s*(\d+)\s*([a-z]?)", "T", least=20).collect()
    assert [r.id for r in again] == ["g-v2-ch4-h7"]


LONG = "a narration of sufficient length to be kept by the rule, and a little more. "


def test_chaptered_volumes(spark):
    header = r"Causes\s+Volume\s+(\d+)\s+Page\s+(\d+)"
    d = pages(spark, "V 1 P 2.pdf", f"Causes Volume 1 Page 1\n{LONG * 2}\nCHAPTER 3 – Why\nHadith 1\n{LONG * 2}", f"Hadith 2\n{LONG}\n{LONG}\nقال الصادق عليه السلام\nCHAPTER 4: Whole\n{LONG * 2}\nHadith", "short")
    got = {r.id: r for r in A.chaptered_volumes(d, "c", "T", header).collect()}
    assert set(got) == {"c-v1-p2-0", "c-v1-ch3-h1", "c-v1-ch3-h2", "c-v1-ch4"}
    assert got["c-v1-ch3-h2"].citation.chapter == "Ch 3 — Why" and got["c-v1-ch3-h2"].citation.arabic_text == "قال الصادق عليه السلام" and got["c-v1-ch3-h2"].citation.hadith_number == "2"
    assert {r.citation.page for r in got.values()} == {"2"} and {r.citation.volume for r in got.values()} == {"1"} and got["c-v1-p2-0"].citation.chapter is None
    assert got["c-v1-ch4"].text.endswith("Hadith") and got["c-v1-ch4"].language == "en"


def test_chapters_over_pages_and_long_ones_in_pieces(spark):
    header = r"Causes\s+Volume\s+(\d+)\s+Page\s+(\d+)"
    d = pages(spark, "V 2.pdf", f"Causes Volume 7 Page 5\nCHAPTER 9 -\nA Broken Title\nHadith 1\nbegins here {LONG}", f"Causes Volume 7 Page 6\nand ends here {LONG}\nHadith 1\nagain {LONG}\nHadith 2\nfew",
              f"Causes Volume 7 Page 8\nCHAPTER 10 — Long\nقال الامام كلاما طويلا\n{LONG * 30}\nCHAPTER 11 — None\n")
    rows = A.chaptered_volumes(d, "c", "T", header).collect()
    assert [r.id for r in rows] == ["c-v7-ch9-h1", "c-v7-ch10-0", "c-v7-ch10-1"]
    first, a, b = rows
    assert first.text.startswith("begins here") and "and ends here" in first.text and "again" not in first.text and first.citation.chapter == "Ch 9 — A Broken Title" and first.citation.page == "8"
    whole = (LONG * 30).strip()
    assert a.text == whole[:1500] and b.text == whole[1350:] and a.citation.arabic_text == "قال الامام كلاما طويلا" and b.citation.arabic_text is None and b.citation.translation == b.text
    assert A.chaptered_volumes(d.limit(0), "c", "T", header).count() == 0


def test_sectioned_volumes(spark):
    header = r"Means Vol\.?\s*(\d+)\s*,\s*Section\s*(\d+)"
    s = pages(spark, "ws7.pdf", f"Means Vol. 1, Section 2\nHadith 5\n{LONG}", f"{LONG}\n12\nHadith 6\n{LONG}", f"Means Vol. 1, Section 3\nno number yet\nHadith 6\nagain {LONG}\nHadith 10\n{LONG}\nHadith 9\n{LONG}")
    rows = A.sectioned_volumes(s, "w", "T", header).collect()
    assert [(r.id, r.citation.chapter) for r in rows] == [("w-v1-h5", "Section 2"), ("w-v1-h6", "Section 2"), ("w-v1-h9", "Section 3"), ("w-v1-h10", "Section 3")] and "again" not in rows[1].text
    assert rows[0].text.count("a narration") == 2 and "no number yet" not in rows[1].text and "12" not in rows[0].text
    plain = A.sectioned_volumes(pages(spark, "x/ws7_eng.pdf", f"Hadith 1\n{LONG}", f"Means Vol. 8, Section 1\nHadith 1\n{LONG}"), "w", "T", header).collect()
    assert [(r.id, r.citation.chapter) for r in plain] == [("w-v7-h1", None), ("w-v8-h1", "Section 1")]


def test_arabic_volumes_turn_numbers_and_refuse_disorder(spark):
    digits = lambda n: "".join(A.DIGITS[int(c)] for c in reversed(str(n)))
    line = lambda n: f"({digits(n)}) محمد بن يعقوب عن عدة من اصحابنا عن فلان"
    page = "باب ٢١ من الابواب\n" + "\n".join(line(n) for n in range(10001, 10041)) + "\nتتمة\n______\nحاشية"
    got = A.arabic_volumes(pages(spark, "a.pdf", page, line(90000)), "w", "3").collect()
    assert len(got) == 40 and got[0].id == "w-v3-h10001" and got[0].citation.chapter == "باب 12 من الابواب" and got[-1].text.endswith("تتمة")
    assert A.arabic_volumes(pages(spark, "a.pdf", "\n".join(line(n) for n in (10003, 10002, 10001))), "w", "3").count() == 0


def test_sayings_and_prose_pages(spark):
    got = A.numbered_sayings(pages(spark, "s.pdf", "The Virtue of Patience\n12 – He said that patience is half of faith\nقال الصبر نصف الايمان\nand certainty the whole.", "Next Theme\n3 - short"), "s", "T").collect()
    assert [(r.id, r.text, r.citation.chapter, r.citation.page) for r in got] == [("s-0", "12. He said that patience is half of faith and certainty the whole.", "The Virtue of Patience", "1")]
    d = pages(spark, "p.pdf", "14\nMy Book\nFirst line of prose that is long enough to be kept here.\nContents .... 3", "15\nThe Second Chapter\nMore prose that is also long enough to be kept as a chunk.")
    rows = A.prose_pages(d, "p", "historical", "My Book", "T", least=20).collect()
    assert [(r.citation.chapter, r.citation.page) for r in rows] == [(None, "14"), ("The Second Chapter", "15")]


def test_books_and_union(spark):
    b = A.book_files(spark.createDataFrame([("1", " A <i>b</i> ")], "book string, title string"), spark.createDataFrame([("1", "f"), ("2", "g")], "book string, file string"))
    assert [tuple(r) for r in b.collect()] == [("1", "A b", "f")]
    one = spark.createDataFrame([("a", "first"), ("b", "x")], "id string, text string")
    assert {r.id: r.text for r in A.unify(one, one.withColumn("text", F.lit("second"))).collect()} == {"a": "first", "b": "x"}
