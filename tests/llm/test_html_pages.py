"""Hand-written pages of many layouts with the text that a reader would call the article, apart from the templates that the
classifier is fitted on."""

import time

import pytest

from glyphlake.llm import html_extract

A = "The harbour was quiet when the first boats came in, and nobody on the quay spoke."
B = "Fishermen unloaded their crates, counted them twice, and walked home through the rain."
C = "By noon the market had sold everything; only the smell of salt was left behind."
T = "A morning at the harbour"
P = f"<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = f"{T}\n{A}\n{B}\n{C}"
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact</a></li></ul>'

LAYOUTS = {
    "semantic": (f"<html><head><title>x</title></head><body><header><p>The Daily</p></header><nav>{NAV}</nav><main><article>{P}</article></main><footer>© 2021 The Daily. All rights reserved.</footer></body></html>", WANT),
    "no head end": (f"<html><head><title>x</title><body><article>{P}</article></body></html>", WANT),
    "no head end, no body": (f"<title>x</title><meta name=a content=b><article>{P}</article>", WANT),
    "form around all": (f'<body><form id="aspnetForm" method="post"><div><nav>{NAV}</nav><div>{P}</div><footer>© 2020 Us</footer></div></form></body>', WANT),
    "article in a form": (f"<form><article>{P}</article></form>", WANT),
    "page share": (f'<div class="page share">{P}</div>', WANT),
    "post tag-form": (f'<div class="post tag-form">{P}</div>', WANT),
    "side wrapper": (f'<div class="left-side">{P}</div><div id="nav">{NAV}</div>', WANT),
    "notice on body": (f'<body class="no-js notice popup">{P}</body>', WANT),
    "legal page": (f'<div id="legal"><div class="text">{P}</div></div>', WANT),
    "bare": (f"<body><div>{NAV}</div><div>{P}</div><div>© 2019 Somebody</div></body>", WANT),
    "bare with a comment": (f"<div>{P}</div><div><b>Anna</b><p>I liked this piece a lot, thank you for it.</p></div>", WANT),
    "bare with comments under a line": (f"<div>{P}</div><h3>2 comments</h3><div><p>Anna</p><p>What a fine text this is.</p></div><div><p>Bob</p><p>I was there that day as well.</p></div>", WANT),
    "bare with says": (f"<div>{P}</div><div><div><span>Carl says:</span><p>Nonsense, the boats were late.</p></div><div><span>Dora says:</span><p>They were not late at all, Carl.</p></div></div>", WANT),
    "comments inside the article": (f'<article>{P}<section id="comments"><h2>Comments</h2><div><b>Eve</b><p>So well written, I read it twice.</p></div></section></article>', WANT),
    "comments as articles": (f'<main>{P}</main><section class="comments"><article class="comment"><p>Frank: we need more of these stories.</p></article><article class="comment"><p>I do not agree with any of this.</p></article></section>', WANT),
    "disqus": (f'<div class="entry">{P}</div><div id="disqus_thread"><p>Please enable scripts to view the comments.</p></div>', WANT),
    "sidebar left": (f'<div id="sidebar"><h3>Most read</h3>{NAV}</div><div id="content">{P}</div>', WANT),
    "aside in the article": (f"<article><h1>{T}</h1><p>{A}</p><aside><h4>Read more</h4>{NAV}</aside><p>{B}</p><p>{C}</p></article>", WANT),
    "advert in the article": (f'<article><h1>{T}</h1><p>{A}</p><div class="ad-slot">Buy a boat today, ask your dealer.</div><p>{B}</p><p>{C}</p></article>', WANT),
    "long cookie notice": (f'<div class="cookie-banner">We use cookies and like techniques to make this site work for you, to measure how it is used, and to show what may be of interest. You can accept or decline them at any time, and change your choice in the settings of this site later on.</div><article><p>{A}</p></article>', A),
    "article header": (f"<article><header><h1>{T}</h1></header><p>{A}</p><p>{B}</p><p>{C}</p></article>", WANT),
    "sections": (f"<body><nav>{NAV}</nav><main><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section><section><h2>Three</h2><p>{C}</p></section></main></body>", f"One\n{A}\nTwo\n{B}\nThree\n{C}"),
    "bare sections": (f"<div>{NAV}</div><div><div><h2>One</h2><p>{A}</p></div><div><h2>Two</h2><p>{B}</p></div></div>", f"One\n{A}\nTwo\n{B}"),
    "layout table": (f'<table><tr><td class="menu">{NAV}</td><td>{P}</td></tr></table>', WANT),
    "lists are content": (f"<article><h1>{T}</h1><p>{A}</p><ul><li>Cod</li><li>Two crates of herring</li></ul><p>{B}</p></article>", f"{T}\n{A}\nCod\nTwo crates of herring\n{B}"),
    "quote and code": (f"<article><p>{A}</p><blockquote>{B}</blockquote><pre>let x = 1</pre><p>{C}</p></article>", f"{A}\n{B}\nlet x = 1\n{C}"),
    "links in prose": (f'<article><p>The <a href="x">harbour</a> was <a href="y">quiet</a> when the first <b>boats</b> came in.</p><p>{B}</p></article>', f"The harbour was quiet when the first boats came in.\n{B}"),
    "short article": ("<nav>" + NAV + "</nav><article><p>Yes.</p><p>No.</p></article><footer>© us</footer>", "Yes.\nNo."),
    "divs as paragraphs": (f"<body><div id=menu>{NAV}</div><div id=main><div>{A}</div><div>{B}</div></div></body>", f"{A}\n{B}"),
    "unclosed paragraphs": (f"<article><h1>{T}<p>{A}<p>{B}<p>{C}</article>", f"{T}\n{A}\n{B}\n{C}"),
    "unclosed button": (f"<article><h1>{T}</h1><button>Play<p>{A}</p><p>{B}</p></article>", f"{T}\nPlay\n{A}\n{B}"),
    "unclosed select": (f"<article><p>{A}</p></article><select><option>One", A),
    "entities": ("<article><p>Fish &amp; chips &#8212; caf&eacute; &lt;open&gt; now&nbsp;and   then.</p></article>", "Fish & chips — café <open> now and then."),
    "upper case tags": (f"<HTML><BODY><NAV>{NAV}</NAV><ARTICLE><H1>{T}</H1><P>{A}</P></ARTICLE></BODY></HTML>", f"{T}\n{A}"),
    "newsletter form": (f'<article>{P}<form class="newsletter"><p>Get our letter every day.</p><input><button>Send</button></form></article>', WANT),
    "related below": (f'<div class="story">{P}</div><div class="related-stories"><h3>More on this</h3><p><a href="1">The last ferry leaves at ten</a></p><p><a href="2">Why herring is dear this year</a></p></div>', WANT),
    "breadcrumbs": (f'<div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a> / Harbour</div><article>{P}</article>', WANT),
    "two articles": (f"<main><article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article></main>", f"One\n{A}\nTwo\n{B}"),
    "script in the text": (f"<article><p>{A}</p><script>document.write('<p>Bad</p>')</script><style>p{{}}</style><p>{B}</p></article>", f"{A}\n{B}"),
    "comment markup": (f"<!-- <p>no</p> --><article><p>{A}<!-- inner --></p></article><!-- open", A),
    "text about cookies": ("<article><h1>Baking cookies</h1><p>These cookies are the best that my grandmother made, with butter, sugar and a little salt.</p><p>Let the dough rest for an hour before you bake it.</p></article>", "Baking cookies\nThese cookies are the best that my grandmother made, with butter, sugar and a little salt.\nLet the dough rest for an hour before you bake it."),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    html, want = LAYOUTS[name]
    assert html_extract.main_text(html) == want


@pytest.mark.parametrize("html", ["<div>" * 60_000 + "x", "<div>a" * 20_000, "<b>" * 60_000 + "x", "<svg>" + "<g>" * 60_000 + "</svg>x", "<p>a" * 20_000, "<form><header><h2>t" * 6000, "</p>" * 60_000 + "x", "<li><ul>a" * 8000, "<button><b>" * 20_000 + "x"])
def test_nesting_takes_linear_time(html):
    half = html[: len(html) // 2]
    took = []
    for page in (half, html):
        start = time.process_time()
        html_extract.main_text(page)
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 12, took
