import gzip
import io
import tarfile
import zipfile
from email.message import EmailMessage

import pytest

from weftlake.sources import extract as x
from weftlake.sources.extract import Options, extract


def zipped(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def test_clean():
    assert x.clean("  a\t b \x07\n\n c  d ") == "a b\nc d"
    assert x.clean("e\u0301") == "é"


def test_html_plain_and_structured():
    page = b"<html><head><title>no</title></head><body><h1>Top</h1><p>One <b>two</b></p><ul><li>a<li>b</ul><table><tr><th>k</th><td>v,1</td></tr></table><script>x</script><pre>code</pre></body></html>"
    assert extract("text/html", page).text == "Top\nOne two\na b\nk v,1\ncode"
    md = extract("text/html", page, x.PRESETS["markdown"]).text
    assert md.split("\n") == ["# Top", "One two", "- a", "- b", "| k | v,1 |", "| --- | --- |", "```", "code", "```"]
    assert '"v,1"' in extract("text/html", page, Options(table_format="csv")).text


def test_html_of_any_depth():
    deep = b"<body>" + b"<div>" * 5000 + b"x<b>y</b>" + b"</div>" * 5000 + b"<ol><li>a<ul><li>b</li></ul></li></ol></body>"
    assert extract("text/html", deep).text == "x y\na b"
    assert extract("text/html", deep, x.PRESETS["markdown"]).text.split("\n") == ["x y", "1. a", "- b", "2. b"]


def test_members_are_read_no_further_than_the_limit():
    big = zipped(a_dot_txt="one", b_dot_txt="x" * 5_000_000, c_dot_txt="late")
    assert [m[0] for m in x.members(big, "zip", Options(max_total=1000))] == ["a.txt"]
    assert [m[0] for m in x.members(big, "zip", Options(max_total=5_000_007))] == ["a.txt", "b.txt", "c.txt"]


def test_xml_joins_without_separator():
    assert extract("application/xml", b"<a x='1'> one <b>two</b><!-- c --></a>").text == "onetwo"


def test_json_and_ndjson():
    assert extract("application/json", b'{"a": {"b": ["x", 1, true, null, " "]}}').text == "x"
    assert extract("application/json", b'{"a": {"b": ["x", 1, true]}}', Options(formatting=True)).text == "a.b[0]: x\na.b[1]: 1\na.b[2]: true"
    e = extract("application/x-ndjson", b'{"a": "x", "b": "y"}\nbroken\n{"a": "z"}\n', Options(metadata=True))
    assert e.text == "x y\nz" and e.metadata["record_count"] == 2
    with pytest.raises(x.ExtractionError):
        extract("application/json", b"{")


def test_markdown():
    src = b"# T\n- item\n1. one\n> quote\n---\n```\ncode\n```\ntext"
    assert extract("text/markdown", src).text == "T\nitem\none\nquote\ntext"
    assert "code" in extract("text/markdown", src, Options(code=True)).text


def test_log_is_counted():
    src = b"2024-01-15 10:30:45 ERROR a\n\nplain warn\n[2024-01-15 x] info\n"
    m = extract("text/x-log", src, Options(metadata=True)).metadata
    assert (m["entry_count"], m["line_count"], m["detected_format"]) == (2, 4, "pattern_1")
    assert m["log_levels"] == {"ERROR": 1, "WARN": 1, "INFO": 1}
    assert not x.is_log("\n".join(["2024-01-01T00:00:00"] * 3 + ["x"] * 7))
    assert x.is_log("\n".join(["2024-01-01T00:00:00"] * 4 + ["x"] * 6))


def test_mail():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hi", "A <a@x.org>", "b@x.org, c@x.org"
    m.set_content("body")
    m.add_alternative("<p>html &amp;lt;</p>", subtype="html")
    m.add_attachment(b"k,v", maintype="text", subtype="csv", filename="t.csv")
    m.add_attachment(b"MZ", maintype="application", subtype="octet-stream", filename="t.exe")
    text = extract("message/rfc822", m.as_bytes()).text
    assert text.startswith("Subject: Hi\nFrom: a@x.org\nTo: b@x.org, c@x.org\nbody\nhtml <")
    assert text.endswith("--- Attachments ---\n[t.csv]\nk,v")


def test_office():
    w = '<w:document xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>'
    assert extract(x.TYPES["docx"], zipped(word__document_dot_xml=w)).text == "One\nTwo"
    s = '<sst xmlns="u"><si><t>A</t></si><si><t>B</t></si></sst>'
    assert extract(x.TYPES["xlsx"], zipped(xl__sharedStrings_dot_xml=s)).text == "A\nB"
    p = '<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:t>S</a:t></a:p></p:sld>'
    assert extract(x.TYPES["pptx"], zipped(ppt__slides__slide2_dot_xml=p.replace("S<", "2<"), ppt__slides__slide1_dot_xml=p.replace("S<", "1<"))).text == "1\n2"
    o = '<o:document-content xmlns:o="u" xmlns:t="v"><o:body><t:p>X<t:s/>y</t:p><t:p>Z</t:p></o:body></o:document-content>'
    assert extract(x.TYPES["odt"], zipped(content_dot_xml=o)).text == "X y\nZ"


def test_rtf_and_epub():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title T}}Caf\'e9 \u8364? ok\par next}"
    assert extract("application/rtf", rtf).text == "Café € ok\nnext"
    box = '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
    opf = '<package xmlns="u"><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    book = zipped(**{"META-INF__container_dot_xml": box, "o__p_dot_opf": opf, "o__a_dot_html": "<body>first</body>", "o__b_dot_html": "<body>second</body>"})
    assert extract("application/epub+zip", book).text == "first\nsecond"


def test_archives():
    inner = zipped(c_dot_txt="deep")
    z = zipped(a_dot_txt="one", b_dot_png="no", d_dot_json="{bad", n_dot_zip=inner)
    e = extract("application/zip", z, Options(metadata=True))
    assert e.text == "--- a.txt ---\none\n--- n.zip ---\n--- c.txt ---\ndeep"
    assert (e.metadata["file_count"], e.metadata["failed_count"]) == (2, 1)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        i = tarfile.TarInfo("x.txt")
        i.size = 2
        t.addfile(i, io.BytesIO(b"hi"))
    assert extract("application/gzip", out.getvalue()).text == "--- x.txt ---\nhi"
    assert extract("application/gzip", gzip.compress(b"plain")).text == "plain"
    assert extract("application/zip", zipped(a_dot_txt="x" * 20, b_dot_txt="y"), Options(max_total=10)).text == ""


def test_metadata_as_text_and_errors():
    assert x.with_metadata("t", {"page_count": 2, "ok": True, "none": None, "tags": ["a", "b"]}) == "t\n\n---\nDocument Metadata:\n\n- Ok: Yes\n- Page Count: 2\n- Tags: a, b"
    for mime, data in (("application/x-tar", b""), ("application/zip", b"no"), ("application/rtf", b"no"), ("application/msword", b"no")):
        with pytest.raises(x.ExtractionError):
            extract(mime, data)


def test_mail_headers_are_parsed_once(monkeypatch):
    from email.headerregistry import HeaderRegistry

    from weftlake.sources.extract import extract

    asked = []
    call = HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: asked.append((name, value)) or call(self, name, value))
    mail = b"Subject: Once\nFrom: A <once@x.org>\nTo: b@x.org, c@x.org\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: text/plain; charset=utf-8\n\nbody\n"
    text = extract("message/rfc822", mail).text
    assert text == "Subject: Once\nFrom: once@x.org\nTo: b@x.org, c@x.org\nDate: 2024-01-01T10:00:00+00:00\nbody"
    assert len(asked) == len(set(asked)) and extract("message/rfc822", mail).text == text


def test_small_files_of_costly_rows_are_many_tasks(spark, tmp_path):
    from weftlake.plans.made import _customers
    from weftlake.plans.registry import Tables
    from weftlake.session import TASK_ROWS

    made = spark.range(3 * TASK_ROWS).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment")
    made.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = _customers(Tables(spark, str(tmp_path)))
    assert got.rdd.getNumPartitions() == 3 and got.select("c_custkey").distinct().count() == 3 * TASK_ROWS
    assert _customers(Tables(spark, str(tmp_path))).limit(0).count() == 0


def test_plain_tags_are_not_searched_for_attributes(monkeypatch):
    from html.parser import HTMLParser

    searched = []
    whole = HTMLParser.check_for_whole_start_tag
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", lambda self, i: searched.append(self.rawdata[i:]) or whole(self, i))
    assert extract("text/html", b"<body><P>a</p><p>b<b>c</B></p></body>").text == "a\nb c" and not searched
    assert extract("text/html", b"<body><p class='x>'>a</p><script><p>no</p></script><p>b</body>").text == "a\nb"
    assert [s[:7] for s in searched] == ["<p clas", "<script"]


def test_control_characters_go_without_a_look_at_each_character(monkeypatch):
    keep = "a\tb\nc­​¡"
    text = keep + "".join(map(chr, [*range(9), 11, 12, *range(14, 32), *range(127, 160)]))
    monkeypatch.setattr(x.unicodedata, "category", None, raising=False)
    assert x.clean(text) == "a b\nc­​¡"


def test_office_parts_are_read_without_events(monkeypatch):
    monkeypatch.setattr(x.ElementTree, "iterparse", None)
    w = '<w:document xmlns:w="u"><w:p><!-- no --><w:t>On<w:i>-</w:i>e</w:t><w:tab/><w:t>x &amp;</w:t></w:p><w:p><w:br/><w:t/><w:t>Two</w:t></w:p></w:document>'
    assert extract(x.TYPES["docx"], zipped(word__document_dot_xml=w)).text == "On x &\nTwo"
    deep = "<w:p>" * 20_000 + "<w:t>low</w:t>" + "</w:p>" * 20_000
    assert extract(x.TYPES["docx"], zipped(word__document_dot_xml=f'<w:document xmlns:w="u">{deep}</w:document>')).text == "low"


def test_options_of_members_are_made_once_for_an_archive(monkeypatch):
    made, replace = [], x.replace
    monkeypatch.setattr(x, "replace", lambda o, **kw: made.append(kw) or replace(o, **kw))
    assert extract("application/zip", zipped(a_dot_txt="1", b_dot_txt="2", c_dot_txt="3")).text.count("---") == 6
    assert made == [{"depth": 1, "append_metadata": False}]


def test_pages_of_bare_tags_are_read_without_the_parsers_search(monkeypatch):
    from html.parser import HTMLParser

    pages = ["<body><h1>a &amp; b</h1><P>c<p>d<br>e &lt</p><title>t</title><script>no</script><ol><li>x<li>y</ol></body>&copy", "<script></script><table><tr><td>1<th>2</table></b>", "", "x &am"]
    monkeypatch.setattr(x._Tree, "plain", lambda self, parts: False)
    texts = [[extract("text/html", p.encode(), o).text for o in x.PRESETS.values()] for p in pages]
    monkeypatch.undo()
    odd = ["<title>a &amp; b</title>c", "<script><p>no</p></script>b", "<plaintext></plaintext>c", "<p class=x>b</p>", "a < b"]
    search, read = HTMLParser.goahead, []
    monkeypatch.setattr(HTMLParser, "goahead", lambda self, end: read.append(self.rawdata) or search(self, end))
    assert [[extract("text/html", p.encode(), o).text for o in x.PRESETS.values()] for p in pages] == texts and not read
    assert texts[0][0] == "a & b\nc\nd\ne <\nt x y" and texts[1][2] == "| 1 | 2 |\n| --- | --- |"
    for p in odd:
        extract("text/html", p.encode())
    assert [p for p in odd if p in read] == odd


def test_office_parts_are_read_by_their_places(monkeypatch):
    w = '<w:document xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>'

    def made(kind=8, name="word/document.xml", comment=b"", times=1, extra=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for _ in range(times):
                i = zipfile.ZipInfo(name)
                i.extra = extra
                z.writestr(i, w, kind)
            z.comment = comment
        return out.getvalue()

    plain = [made(), made(0)]
    odd = [made(12), made(comment=b"c"), b"before" + made(), made(extra=b"\1\2\0\0"), made(name="é/document.xml")]
    broken = made(0).replace(b"One", b"0ne")
    opened, whole = [], zipfile.ZipFile
    monkeypatch.setattr(x.zipfile, "ZipFile", lambda f: opened.append(f) or whole(f))
    assert [extract(x.TYPES["docx"], d).text for d in plain] == ["One\nTwo"] * 2 and not opened
    assert [extract(x.TYPES["docx"], d).text for d in odd] == ["One\nTwo"] * 5 and len(opened) == 5
    with pytest.raises(x.ExtractionError, match="Bad CRC-32"):
        extract(x.TYPES["docx"], broken)
    for k in range(len(plain[0])):
        with pytest.raises(x.ExtractionError):
            extract(x.TYPES["docx"], plain[0][:k])


def test_made_archives_are_whole():
    from weftlake.plans.made import zip_file

    texts = ("a" * 100_000, "é<&>", "", "".join(map(chr, range(32, 5000))))
    with zipfile.ZipFile(io.BytesIO(zip_file(("a.txt", "d/b.json", "c", "e"), texts))) as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "d/b.json", "c", "e"]
        assert tuple(z.read(n).decode() for n in z.namelist()) == texts
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED} and z.getinfo("a.txt").compress_size < 1000


def test_a_customer_without_name_has_no_file(spark, tmp_path):
    from weftlake.plans.made import extract_docx, extract_xlsx
    from weftlake.plans.registry import Tables

    spark.sql("SELECT 1L AS c_custkey, 'n' AS c_name, 's' AS c_mktsegment UNION ALL SELECT 2L, NULL, 's'").write.parquet(str(tmp_path / "customer.parquet"))
    for q in (extract_docx, extract_xlsx):
        assert sorted(map(tuple, q(Tables(spark, str(tmp_path))).collect())) == [(1, "n\ns"), (2, None)]
