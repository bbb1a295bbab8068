import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from glyphlake import settings as S
from glyphlake.sources import codec, embedding, readers


@pytest.fixture
def server():
    answers, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body(seen[-1][2]["input"]) if callable(body) else body).encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield answers, seen, f"http://127.0.0.1:{http.server_port}/v1/"
    http.shutdown()


def good(texts):
    return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)][::-1]}


def service(url, **more):
    return embedding.Service(S.EmbedSettings(base_url=url, api_key="k", **more), sleep=lambda s: None)


def test_embeds_in_order(server):
    answers, seen, url = server
    answers.append((200, good))
    got = embedding.embed_all(service(url), ["a", "bb", "ccc", "dddd", "eeeee"], 2, 3)
    assert [v[0] for v in got] == [1, 2, 3, 4, 5]
    assert seen[0][:2] == ("/v1/embeddings", "Bearer k")


def test_busy_servers_are_tried_again(server):
    answers, seen, url = server
    answers += [(500, {}), (429, {}), (200, good)]
    assert service(url)(["x"]) == [[1.0, 1.0]] and len(seen) == 3


def test_other_refusals_fail_at_once(server):
    answers, seen, url = server
    answers.append((401, {}))
    with pytest.raises(embedding.EmbedError, match="401"):
        service(url)(["x"])
    assert len(seen) == 1
    answers[:] = [(503, {})]
    with pytest.raises(embedding.EmbedError, match="503"):
        service(url)(["x"])
    assert len(seen) == 5


@pytest.mark.parametrize("vector", [None, [], [float("nan")], [True], "x", [None, 1.0]])
def test_bad_vectors_are_asked_for_again(server, vector):
    answers, seen, url = server
    bad = {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": vector}]}
    answers += [(200, bad), (200, good)]
    assert len(service(url)(["a", "b"])) == 2
    answers[:] = [(200, bad)]
    with pytest.raises(embedding.EmbedError) as e:
        service(url)(["a", "b"])
    assert e.value.bad == (1,)


def test_embedded_column(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(150)], "id int, text string")
    got = embedding.embedded(rows, embedding.HashEmbedder(128), S.EmbedSettings(batch_size=16)).collect()
    assert len(got) == 150 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in got)


@pytest.mark.parametrize("made", [codec.Codec("zlib"), codec.Codec("zstd"), codec.Codec("zstd", b"lorem ipsum dolor sit amet" * 20)])
def test_codecs(spark, made):
    assert made.decompress(made.compress("lorem ipsum é字")) == "lorem ipsum é字"
    assert codec.resolve(made.spec(), made) == (made, False)
    assert codec.resolve(None, made) == (made, False) and codec.resolve("junk", made) == (made, False)
    df = spark.createDataFrame([("a",), (None,)], "t string")
    back = df.select(codec.decompress_column(codec.compress_column(F.col("t"), made), made).alias("t"))
    assert [r["t"] for r in back.collect()] == ["a", None]
    other = codec.Codec("zlib")
    moved = df.select(codec.decompress_column(codec.recompress_column(codec.compress_column(F.col("t"), made), made, other), other).alias("t"))
    assert [r["t"] for r in moved.collect()] == ["a", None]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.TXT").write_bytes("hi".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"\xe9t\xe9")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="p"><manifest><item id="2" href="two.html"/><item id="1" href="one.html"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("O/one.html", "<p>1</p>")
        z.writestr("O/two.html", "<p>2</p>")
    (tmp_path / "e.epub").write_bytes(book.getvalue())
    got = {r["path"][-5:]: r["extracted"] for r in readers.read_books(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "é" and got["b.TXT"]["text"] == "hi" and got["c.txt"]["text"] == "été"
    assert got["d.pdf"]["kind"] == "error" and "no reader" in got["d.pdf"]["error"] and got[".epub"]["pages"] == ["<p>1</p>", "<p>2</p>"]
    own = readers.read_books(spark, str(tmp_path), {"PDF": lambda b: "pdf text"}).where("fmt = 'PDF'").first()
    assert own["extracted"]["text"] == "pdf text"


def test_library(spark):
    files = spark.createDataFrame([(1, "PDF", 5, 1), (1, "EPUB", 6, 2), (2, "LRF", 7, 3)], "book_id long, fmt string, size long, mtime long")
    assert {(r["book_id"], r["fmt"], r["size"]) for r in readers.library(files).collect()} == {(1, "EPUB", 6), (2, "LRF", 7)}


def test_library_prefers_what_can_be_read(spark):
    files = spark.createDataFrame([(1, "MOBI", 5, 1), (1, "txt", 6, 2), (2, "AZW3", 7, 3), (2, "PDF", 7, 3), (3, "DOCX", 1, 1), (3, "FB2", 1, 1), (3, "MOBI", 1, 1)], "book_id long, fmt string, size long, mtime long")
    assert {r["book_id"]: r["fmt"] for r in readers.library(files).collect()} == {1: "txt", 2: "AZW3", 3: "FB2"}
    assert {r["book_id"]: r["fmt"] for r in readers.library(files, readers={"MOBI": bytes.decode}).collect()}[1] == "MOBI"


def zipped(**files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_f", ".f"), data)
    return out.getvalue()


def test_fiction_books_and_word_documents():
    from glyphlake.operators import pages

    fb2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><book-title>x</book-title></title-info></description>
<body><title><p>The</p><p>Book</p></title><section><title><p>One</p></title><p>a &lt; <emphasis>b</emphasis></p><section><title><p>Deep</p></title><poem><stanza><v>line</v></stanza></poem></section></section><section><p>end</p></section></body><body name="notes"><section><p>note</p></section></body></FictionBook>"""
    want = [[("a < b", ["The Book", "One"]), ("line", ["The Book", "One", "Deep"]), ("end", ["The Book", "One", "Deep"])], [("note", [])]]
    for data, fmt in ((fb2.encode(), "fb2"), (zipped(book_fb2=fb2), "FBZ")):
        got = readers.extract(data, fmt)
        assert got["kind"] == "pages" and [[(p["text"], p["path"]) for p in pages.paragraphs(x)] for x in got["pages"]] == want
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>One &amp; </w:t></w:r><w:r><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:p/></w:body></w:document>'
    got = readers.extract(zipped(word__document_xml=doc), "docx")
    assert got["pages"] == ["<h1>Top</h1><p>One &amp; two<br>three</p><p></p>"]
    assert [(p["text"], p["path"]) for p in pages.paragraphs(got["pages"][0])] == [("One & twothree", ["Top"])]
    assert readers.extract(b"junk", "docx")["kind"] == readers.extract(b"<a", "fb2")["kind"] == readers.extract(b"", "mobi")["kind"] == "error"


def test_settings():
    assert S.from_json(S.to_json(S.Settings())) == S.Settings() == S.from_json("broken") == S.from_json(None)
    some = S.from_json(json.dumps({"target_chars": 5, "odd": 1, "vector_backend": "auto", "attributes": [{"name": "pov", "enabled": False}, {"name": "own"}, 3]}))
    assert some.target_chars == 5 and some.vector_backend == "sqlite" and not some.attributes[0].enabled and some.attributes[1].label == "ss_own" and len(some.attributes) == 9
    assert S.Settings().effective_target == 1000 and S.max_chunk_chars(8192, 1.25) == 32512 and S.Settings().chunk_token_cap == 6502
    prefs = {}
    S.store(prefs, some)
    assert S.load(prefs) == some
    assert S.template_kwargs('{"a": 1}') == {"a": 1} and S.template_kwargs("[1]") is None and S.template_kwargs("") is None
    with pytest.raises(ValueError):
        _ = S.Settings(embed_context_tokens=64).chunk_token_cap
