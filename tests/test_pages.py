import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.operators import packing, pages

GOLDEN = [
    # headings: each ends those of its own level and below
    ("<body><h2>Tools</h2><p>saw</p><h4>Care</h4><p>oil it</p><h3>Storage</h3><p>dry</p><h2>Wood</h2><p>oak</p><h1>End</h1><p>bye</p></body>", [("saw", ["Tools"]), ("oil it", ["Tools", "Care"]), ("dry", ["Tools", "Storage"]), ("oak", ["Wood"]), ("bye", ["End"])]),
    ("<body><h1><u>Title</u></h1><p>x</p></body>", [("Title", ["Title"]), ("x", ["Title"])]),
    ("<p>before any heading</p><h3>Late</h3><p>after</p>", [("before any heading", []), ("after", ["Late"])]),
    # what is never shown
    ("<head><title>t</title></head><body><style>b{}</style><p>seen</p><script>let q='<p>no</p>'</script></body>", [("seen", [])]),
    # an unknown element without blocks is a run of lines, parted at <br>
    ("<body><verse>roses are red<br/>violets <em>are</em> blue<br/><br/>so<br/></verse></body>", [("roses are red", []), ("violets are blue", []), ("so", [])]),
    ("<body><verse><br/>IV<br/><num>12</num><br/><img src='x'/>last</verse></body>", [("IV", []), ("12", []), ("last", [])]),
    ("<body><verse>one<style>i{}</style> word</verse></body>", [("one word", [])]),
    # blocks in blocks: the innermost that holds text counts, text beside it does not
    ("<body><section><div><q>deep</q></div></section><blockquote>quoted</blockquote></body>", [("deep", []), ("quoted", [])]),
    ("<section>lost<div>kept</div>lost as well</section>", [("kept", [])]),
    ("<div><p></p><p> </p></div><p>only this</p>", [("only this", [])]),
    # unclosed elements and lists
    ("<p>uno<p>dos<ul><li>tres<li>quatro</ul>", [("uno", []), ("dos", []), ("tres", []), ("quatro", [])]),
    ("<table><tr><th>k</th><td>v</td></tr></table>", [("kv", [])]),
    # characters
    ("<p>5 &gt; 3 &amp; caf\u00e9\u3000\u4e2d\u6587 \U0001F468\u200d\U0001F469</p>", [("5 > 3 & caf\u00e9 \u4e2d\u6587 \U0001F468\u200d\U0001F469", [])]),
    ("   ", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("html,want", GOLDEN)
def test_golden(html, want):
    assert [(p["text"], p["path"]) for p in pages.paragraphs(html)] == want


def test_lossless_keeps_text_around_blocks():
    assert [p["text"] for p in pages.paragraphs("<div>before<p>kept</p>behind</div>", lossless=True)] == ["before", "kept", "behind"]
    assert [p["text"] for p in pages.paragraphs("<h1><b>T</b></h1><p>x</p>", lossless=True)] == ["x"]


def test_deep_nesting():
    assert [p["text"] for p in pages.paragraphs("<div>" * 5000 + "deep" + "</div>" * 5000)] == ["deep"]


def test_units_and_books(spark):
    df = spark.createDataFrame([(1, 0, "<h1>C1</h1><p>alpha</p>"), (1, 1, "<h1>C2</h1><p>beta</p>"), (2, 0, None)], "book int, page int, html string")
    assert [u["kind"] for u in pages.page_units(df, "book").where("book = 1").first()["units"]] == ["heading", "para"]
    keyed = df.selectExpr("struct(book, page) as key", "html")
    found = pages.page_paragraphs(keyed, "key").select("key.book", "key.page", "paragraphs")
    books = pages.book_paragraphs(found, "book", "page")
    chunks = packing.chunk_rows(packing.pack_units(books, "book", "paragraphs", 1000, 0), "book").collect()
    assert [(c["book"], c["text"], c["chapter_path"]) for c in chunks] == [(1, "alpha\n\nbeta", ["C1"])]


def test_batches_are_worked_on_in_bounded_pieces(monkeypatch):
    """Whatever the batch Spark hands over, only about a megabyte of it becomes Python objects and results at once."""
    made = []

    class Rows:
        schema = [T.StructField("id", T.LongType())]
        select = alias = lambda self, *a: self
        mapInArrow = lambda self, f, schema: made.append(f)

    monkeypatch.setattr(F, "col", lambda name: Rows())
    pages.page_paragraphs(Rows(), "id", "html")
    pages.page_units(Rows(), "id", "html")
    html = pa.array(["<p>" + "word " * 2000 + "</p>"] * 600 + [None, "", "<p>" + "x" * 3_000_000])
    for f in made:
        out = list(f(iter([pa.RecordBatch.from_arrays([pa.array(range(603)), html], names=["id", "v"])])))
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(603))
        assert max(b.nbytes for b in out if b.num_rows > 1) <= 2 << 20 and len(out) > 5
