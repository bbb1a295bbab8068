import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import edges
from glyphlake.llm import boosting, decontaminate, fingerprints, html_extract, queries, toxicity, url_filter


# decontamination


def test_leak_query_is_its_sql(spark, sf_dir):
    assert compare.same(queries.op9_decontamination(spark, sf_dir), queries.ORACLES["op9_decontamination"], sf_dir)[2]


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("size", [32 << 20, -1])
def test_leaks_are_those_of_brute_force(spark, size):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abc") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice((1, 4, 5, 6, 20, 90))))) for i in range(25)] + [(None, "null item of some more words"), (99, None)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(r.choice((0, 3, 50, 900)))]
        for _ in range(r.randint(0, 3)):
            part = (r.choice(items)[1] or "").split()
            for _ in range(r.choice((0, 0, 1, 3))):
                if part:
                    part[r.randrange(len(part))] = word()
            at = r.randint(0, len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    docs.append((None, "x null item of some more words y"))
    want = {}
    for d, t in docs:
        for i, q in items:
            n, common = len(shingled(q)), len(shingled(t) & shingled(q))
            if n and 100 * common >= 75 * n:
                want[d, i] = (n, common)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=size).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in got} == want and len(want) > 20


def test_a_shared_phrase_makes_no_candidates(spark, monkeypatch):
    """200 items share a phrase that 500 documents hold; three documents hold an item as well."""
    phrase = " ".join(f"p{i}" for i in range(12))
    items = [(i, f"{phrase} " + " ".join(f"i{i}x{k}" for k in range(20))) for i in range(200)]
    docs = [(i, f"d{i} {phrase} e{i}") for i in range(500)] + [(1000 + i, f"before {items[i][1]} behind") for i in range(3)]
    saved = {}
    monkeypatch.setattr(decontaminate, "save", lambda df, name, save=decontaminate.save: saved.setdefault(name, save(df, name)))
    monkeypatch.setattr(decontaminate, "drop_saved", lambda *tables: None)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1000, 0), (1001, 1), (1002, 2)]
    assert saved["leak-candidates"].count() == 3


def test_leak_edges(spark):
    items = edges.rows(spark, [(1, "two three four five six"), (2, None), (3, "")], "item_id")
    leaks = decontaminate.find_leaks(edges.rows(spark), items)
    assert sorted(r["doc_id"] for r in leaks.collect()) == [1, 6]
    kept = decontaminate.keep_clean(edges.rows(spark), leaks)
    assert kept.columns == edges.rows(spark).columns and kept.count() == len(edges.ROWS) - 4
    assert decontaminate.find_leaks(edges.empty(spark), items).count() == 0
    assert decontaminate.find_leaks(edges.rows(spark), edges.empty(spark, "item_id")).count() == 0


# url filter


def test_url_query_is_its_sql(spark, sf_dir):
    assert compare.same(queries.op10_url_filter(spark, sf_dir), queries.ORACLES["op10_url_filter"], sf_dir)[2]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = ["http://A.Example.COM/en/7?x", "https://example.com/en/8#t", "x://example.net/de/8", "example.com/en/7", None, "", "ftp://com/en/", "s://badcom/en/1", "s://a..com/en/1", "s://a.com.", "s://example.net/de/8/9", "s://net/de/7", "s://u@h.org:80/es/", "s://h.org/es/", "s://h.org/ES/", "s://É.org/es/é", "http://x://com/en/", "s://" + "a." * 3000 + "com/en/x"]


@pytest.mark.parametrize("rules", [url_filter.RULES, (("block", "b.com/x"), ("allow", "b.com/x"), ("allow", "a.b.com/"), ("block", "b.com/xy"), ("block", "com/en/")), ()])
def test_urls_are_judged_as_by_brute_force(spark, rules):
    pages = edges.rows(spark, [(i % 7 or None, u) for i, u in enumerate(URLS + ["s://a.b.com/x", "s://a.b.com/xyz", "s://a.b.com/x"])], "page_id", "url")
    table = spark.createDataFrame(list(rules), "verdict string, rule string")
    want = [brute_url(r["url"], rules) for r in pages.collect()]
    for how in ({}, {"shapes": 0}, {"broadcast_bytes": -1}, {"prefix_hex": 1}):
        got = [tuple(r)[1:] for r in url_filter.judge_urls(pages, table, **how).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), how
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


# html


PAGES = {
    "<article><h1>T</h1><p>One &amp; two&nbsp;three.<p>Second<br>line.</article><footer>F</footer>": "T\nOne & two three.\nSecond line.",
    "<nav><a href=x>Home</a></nav><main><h2>Title of it</h2><p>Body text is here. And more of it.</p><ul><li>First point</li><li>Second point</li></ul></main><aside>Related things</aside>": "Title of it\nBody text is here. And more of it.\nFirst point\nSecond point",
    '<article><p>Real text of the article, with a sentence.</p><div class="advert">Buy our things now, they are very good.</div><p>More real text follows it here.</p></article><section id="comments"><p>I liked this article very much, thank you.</p></section>': "Real text of the article, with a sentence.\nMore real text follows it here.",
    "<article><p>Text before a form is kept.</p><form><label>Your name</label><input><button>Send</button></form><script>var a='</p>';</script><style>p{}</style></article>": "Text before a form is kept.",
    '<div class="cookie-notice">We use cookies. Accept all.</div><article><p>Short.</p><p>Shorter.</p></article>': "Short.\nShorter.",
    "<html><head><title>x</title></head><body></body></html>": "",
    "": "",
    "<p>": "",
    "<article><p>cut &am": "cut &am",
}


def test_pages():
    for html, want in PAGES.items():
        assert html_extract.main_text(html) == want, html


BODY = "<article><h1>Title of it</h1><p>Text of the article, with a sentence.</p></article>"


@pytest.mark.parametrize("head", ["<head><title>T</title><body>", "<head><meta charset=utf-8><style>p{}</style><script>var a='<p>';</script>", "<html><head><noscript><img src=x></noscript><template><p>Not shown.</p></template><title>T</title>\n", "<head><bgsound src=x><title>T</title><br>", "<head></head><body>", "<body><head>"])
def test_head_left_open(head):
    assert html_extract.main_text(head + BODY) == "Title of it\nText of the article, with a sentence."
    assert [b.text for b in html_extract.blocks_of("<head><title>T</title>\n Bare text<p>More")] == ["Bare text", "More"]


def test_training_pages_are_told_apart():
    wrong = total = 0
    for page, labels in html_extract.training_pages(150, seed=123):
        got = html_extract.labelled(page)
        wrong, total = wrong + sum(int(a) != b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert wrong / total < 0.04


def test_cut_is_minimal():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 7)
        terminal = [r.uniform(-3, 3) for _ in range(n)]
        joins = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda side: sum(c for c, s in zip(terminal, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(terminal, side, strict=True) if c < 0 and s) + sum(w for i, j, w in joins if side[i] != side[j])  # noqa: B023, E731
        assert cost(html_extract.source_side(terminal, joins)) == pytest.approx(min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n)))


def test_html_query_and_edges(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op5_html_text(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        r = got[p["page_id"]]
        assert r["n_chars"] == len(r["text"]) and r["text"] == html_extract.main_text(p["html"]) and r["url"] == p["url"] and r["text"]
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<div>" * 3000 + "x"), (3, "v", "<article>" + "<p>Some words here.</p>" * 5000)], "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n")
    rows = html_extract.extract(odd).collect()
    assert len(rows) == 5 and max(len(r["text"]) for r in rows) == 5000 * 17 - 1
    assert html_extract.extract(odd.limit(0)).count() == 0


# fingerprints


def test_entropies_are_exact():
    from collections import Counter
    from math import log2

    r = np.random.RandomState(1)
    for n, kinds in ((64, 2), (200, 5), (900, 120)):
        data = r.randint(0, kinds, n).astype(np.uint8)
        want = [-sum(c / 64 * log2(c / 64) for c in Counter(data[i : i + 64].tolist()).values()) for i in range(n - 63)]
        assert np.allclose(fingerprints.window_entropies(data), want, atol=1e-5)


def test_pieces_give_the_same_features(monkeypatch):
    data = edges.LONG.encode()
    whole = fingerprints.features(data)
    monkeypatch.setattr(fingerprints, "PIECE", 5000)
    assert (fingerprints.features(data) == whole).all()


def test_likeness_orders_texts():
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(600))
    a, b = text(), text()
    f = fingerprints.fingerprint
    half = fingerprints.likeness(f(a), f(fingerprints.edited_text(a, b)))
    assert fingerprints.likeness(f(a), f(a)) == 1.0 and 0.3 < half < 0.75 and fingerprints.likeness(f(a), f(b)) < 0.1
    assert fingerprints.likeness(f(a), f(b)) == fingerprints.likeness(f(b), f(a)) and fingerprints.likeness("", "") == 1.0 and fingerprints.likeness(f(a), "") == 0.0
    assert all(f(x) == f(x) for x in ("", "a", "a" * 999)) and f("") == "" and f("a" * 999)


def test_short_texts_are_covered():
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))[:n]
    f, near = fingerprints.fingerprint, fingerprints.likeness
    for n in range(40, 301, 5):
        a, b = text(n), text(n)
        assert near(f(a), f(fingerprints.edited_text(a, b))) >= 0.2 and near(f(a), f(b)) < 0.15, n
        for at in range(0, n, 7):  # no byte is under no feature
            assert f(a) != f(a[:at] + "!" + a[at + 1 :]), (n, at)
    start = text(64)
    assert near(f(start + text(80)), f(start + text(80))) < 0.8


def test_long_texts_of_little_entropy(monkeypatch):
    r = random.Random(6)
    a, b = ("".join(r.choice("ab") for _ in range(20_000)) for _ in range(2))
    f, near = fingerprints.fingerprint, fingerprints.likeness
    assert 0.3 < near(f(a), f(fingerprints.edited_text(a, b))) < 0.75 and near(f(a), f(a[:64] + b)) < 0.1
    whole = fingerprints.features(a.encode())
    monkeypatch.setattr(fingerprints, "PIECE", 3000)
    assert (fingerprints.features(a.encode()) == whole).all()


MASK = (1 << 64) - 1


def plain_hash(window):
    h = 0x9E3779B97F4A7C15
    for k in range(0, len(window), 8):
        h = (h ^ int.from_bytes(window[k : k + 8], "little")) * 0xD1342543DE82EF95 & MASK
        h ^= h >> 29
    h = h * 0x9E3779B97F4A7C15 & MASK
    return h ^ (h >> 32)


def plain_rarity(window):
    from collections import Counter
    from math import log2

    bits = log2(64) - sum(round((1 << 24) * c * log2(c)) for c in Counter(window).values()) / ((1 << 24) * 64)
    return 0 if bits < 2 else min(1 + round(abs(bits - 3.7) / 0.3 * 60_000), 1_000_000)


def plain_features(data):
    """Window by window: votes of each stretch of 64 windows, then the windows that cover texts with few features."""
    if len(data) < 8:
        return [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")] if data else []
    out = []
    n = len(data) - 63
    if n > 0:
        rare = [plain_rarity(data[i : i + 64]) for i in range(n)]
        span = min(64, n)
        votes = [0] * n
        for s in range(n - span + 1):
            votes[max(range(s, s + span), key=lambda i: (rare[i], -i))] += 1
        out = [plain_hash(data[i : i + 64]) for i in range(n) if rare[i] and votes[i] >= min(16, n - span + 1)]
    if len(set(out)) < 8 and len(data) >= 512:
        hashes = [plain_hash(data[i : i + 64]) for i in range(n)]
        taken = {0, n - 1} | {min(range(s, s + span), key=lambda i: (-rare[i], hashes[i], i)) for s in range(n - span + 1)}
        out = out + [hashes[i] for i in sorted(taken)]
        few = True
    else:
        few = len(set(out)) < 8
    if few and len(data) < 1024:
        n = len(data) - 7
        hashes = [plain_hash(data[i : i + 8]) for i in range(n)]
        span = min(8, n)
        taken = {0, n - 1} | {min(range(s, s + span), key=lambda i: (-len(set(data[i : i + 8])), hashes[i], i)) for s in range(n - span + 1)}
        out = out + [hashes[i] for i in sorted(taken)]
    return out


def plain_chain(data):
    """(number of features, set bits) of each filter."""
    distinct = list(dict.fromkeys(plain_features(data)))
    parts = [distinct[i : i + 160] for i in range(0, len(distinct), 160)]
    return [(len(p), {(h >> 12 * k) % 2048 for h in p for k in range(5)}) for p in parts]


def read_chain(text):
    import base64

    out = []
    for part in text.split(";") if text else []:
        n, _, bits = part.partition(":")
        out.append((int(n), {8 * i + 7 - b for i, byte in enumerate(base64.b64decode(bits)) for b in range(8) if byte >> b & 1}))
    return out


def plain_likeness(a, b):
    x, y = sorted((a, b), key=len)
    share = lambda p, q: min(1.0, max(0.0, (len(p & q) - len(p) * len(q) / 2048) / max(min(len(p), len(q)) - len(p) * len(q) / 2048, 1e-9)))
    return sum(max(share(p, q) for _, q in y) * len(p) for _, p in x) / sum(len(p) for _, p in x)


def test_fingerprints_are_those_of_plain_counting():
    r = random.Random(3)
    texts = ["", "a", "abcdefg", "abcdefgh", "é字" * 30, "a" * 700, "ab" * 900, *("".join(r.choice("abcdefghij klmno.,é") for _ in range(n)) for n in (9, 40, 64, 65, 100, 300, 511, 600, 1100, 6000)), "x" * 200 + "".join(r.choice("qwertz uiop") for _ in range(300)) + "x" * 400]
    for t in texts:
        assert read_chain(fingerprints.fingerprint(t)) == plain_chain(t.encode()), t[:40]
    full = [t for t in texts if len(t) > 8]
    for a, b in zip(full, full[1:], strict=False):
        edit = fingerprints.edited_text(a, b)
        if len(plain_chain(a.encode())) != len(plain_chain(edit.encode())) or a == edit:
            continue
        got = fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(edit))
        x, y = plain_chain(a.encode()), plain_chain(edit.encode())
        assert min(abs(got - plain_likeness(x, y)), abs(got - plain_likeness(y, x))) < 1e-5


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(20,3)", "date", "binary", "boolean"])
def test_fingerprints_of_ids_of_any_type(spark, kind):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(120))) for i in range(2 if kind == "boolean" else 60)]
    as_kind = "date_from_unix_date(k)" if kind == "date" else "cast(cast(k as string) as binary)" if kind == "binary" else f"cast(k as {kind})"
    df = spark.createDataFrame([*rows, (None, "no id")], "k int, text string").selectExpr(f"{as_kind} as doc_id", "text", "k as range", "k as id")
    order = df.select("doc_id", "text").orderBy(F.desc_nulls_last("doc_id"), "text").collect()
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_edits(df, parts=7).collect()}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert got[a["doc_id"]]["edited"] == fingerprints.edited_text(a["text"], b["text"])
    assert len(got) == len(order)


@pytest.mark.parametrize("parts", [None, 1, 5, 400])
def test_fingerprint_query(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    made = queries.op4_fingerprints(spark, sf_dir) if parts is None else fingerprints.fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), parts=parts)
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == len(docs)
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(d["text"])
        edit = d["text"][: n - n // 2] + after["text"][: n // 2]
        r, f = got[d["doc_id"]], fingerprints.fingerprint(d["text"])
        assert r["fingerprint"] == f and r["edited_fingerprint"] == fingerprints.fingerprint(edit) and r["n_chars"] == n
        assert r["near_next"] == fingerprints.likeness(f, fingerprints.fingerprint(after["text"]))
        assert parts is not None or r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()


def test_fingerprint_edges(spark):
    got = fingerprints.fingerprint_edits(edges.rows(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in edges.ROWS)
    assert fingerprints.fingerprint_edits(edges.empty(spark)).count() == 0 and fingerprints.fingerprints(edges.rows(spark)).count() == len(edges.ROWS)
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(None, "abcdef")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["edited"], r["near_next"]) for r in one] == [(None, "abcabc", 1.0)]


# toxicity


def test_isotonic_rises_and_is_calibrated():
    r = np.random.RandomState(0)
    raw = r.standard_normal(4000)
    y = (r.random_sample(4000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    score = boosting.isotonic(raw, y)(np.linspace(-4, 4, 200))
    assert (np.diff(score) >= 0).all() and abs(boosting.isotonic(raw, y)(raw).mean() - y.mean()) < 0.02


def test_trees_learn_what_one_cut_cannot():
    r = np.random.RandomState(1)
    x = r.random_sample((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert (((model.raw(x[2000:]) > 0) == (y[2000:] > 0)).mean()) > 0.95


def test_features_see_obfuscation():
    lexicon = toxicity.Lexicon({"lowei": 3.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon), strict=True))
    assert f("you are an IDIOT!!")["hits"] == 1 and f("you are an IDIOT!!")["near_second"] == 1 and f("ein loweischaft")["hits"] == 1
    assert all(f(f"what an {w}")["obfuscated_hits"] for w in ("1d10t", "i.d.i.o.t", "m o r o n"))
    assert f("")["hits"] == 0 and f("quite harmless words")["hits"] == 0


def toxic_table(spark, n=600):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(60)], int(i % 5 == 0)
        if toxic:
            words[5], words[20] = "zorgled" + word(), r.choice(("moron", "zorgles"))
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_words_and_holds_on_rows_it_never_saw(spark):
    df = toxic_table(spark)
    model = toxicity.train(df, df)
    assert "zorg" in model.lexicon
    got = toxicity.judged(toxicity.score(df, model)).join(df, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 220 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert toxicity.keep_clean(df, model).columns == df.columns


def by_hand(text, lexicon):
    """The features once more, word by word, in the order of FEATURES."""
    import math
    import re

    edge = lambda w: w.strip(toxicity.STRIP)
    words = [edge(w) for w in text.lower().split()]
    if not words:
        return [0.0] * 17
    known = {f"{w}$": 4.0 for w in toxicity.INSULTS} | lexicon

    def look(w):
        for term in [f"{w}$"] + [w[:n] for n in (6, 5, 4) if len(w) >= n]:
            if term in known:
                return term
        return None

    clean = lambda w: re.sub(r"(\w)\1{2,}", r"\1", "".join(c for c in w.translate(toxicity.LEET) if c.isalnum()))
    at, terms, hidden, odd = [], [], 0, 0
    for i, w in enumerate(words):
        term = look(w)
        if not term and w and not w.isalpha() and not w.isdigit():
            odd += 1
            term = look(clean(w))
            hidden += term is not None
        if term:
            at.append(i)
            terms.append(term)
    for m in re.finditer(r"(?<!\w)\w(?:[ ._*-]\w){3,}(?!\w)", text.lower()):
        term = look(re.sub(r"[ ._*-]", "", m[0]).translate(toxicity.LEET))
        if term:
            hidden += 1
            terms.append(term)
    n, size = len(words), len(text.encode())
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    count = lambda chars: sum(text.count(c) for c in chars) / size
    distinct = list(dict.fromkeys(terms))
    return [len(at) + hidden, len(distinct), (len(at) + hidden) / n, sum(known[t] for t in distinct), max([known[t] for t in distinct], default=0.0), sum(any(abs(i - j) <= 5 for j in second) for i in at), len(second) / n, hidden, odd / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("!"), count("?"), count("\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"), count("0123456789"), len(re.findall(r"(\w)\1{2,}", text)) / n, math.log1p(n), len(text) / n]


def walk(model, x):
    """The boosted trees, node by node, and the calibration between the two nearest points."""
    trees, cal = model.trees, model.calibration
    raw = trees.base
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        raw += value[node - len(feature)]
    if raw <= cal.at[0]:
        return cal.value[0]
    for a, b, v, w in zip(cal.at, cal.at[1:], cal.value, cal.value[1:], strict=False):
        if raw <= b:
            return v + (w - v) * (raw - a) / (b - a) if b > a else w
    return cal.value[-1]


def test_scores_are_those_worked_out_by_hand(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib

    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(walk(model, by_hand(t, model.lexicon)), abs=1e-9), i
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_model_does_not_depend_on_how_rows_are_dealt(spark):
    df = toxic_table(spark, 400)
    again = df.union(df.where("doc_id % 7 = 0").selectExpr("doc_id + 1000", "text", "toxic")).union(df.where("doc_id % 50 = 0"))
    models = [toxicity.train(again.repartition(n, *by), df) for n, by in ((1, ()), (16, ()), (5, ("text",)))]
    assert all(m.lexicon == models[0].lexicon for m in models) and len(models[0].lexicon) > 1
    assert all((m.trees.value == models[0].trees.value).all() and (m.calibration.at == models[0].calibration.at).all() for m in models)


def test_labels_of_the_held_out_part_change_nothing(spark):
    df = toxic_table(spark, 200)
    turned = df.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["when"]).when(toxicity.held_out("doc_id"), 1 - df["toxic"]).otherwise(df["toxic"]))
    a, b = toxicity.train(df, df), toxicity.train(df, turned)
    assert a.lexicon == b.lexicon and (a.trees.value == b.trees.value).all() and (a.calibration.value == b.calibration.value).all()


def test_a_hot_labelled_id_brings_no_more_rows(spark, monkeypatch):
    """Of ids that 500 rows share no more than the bound is fitted, whether their texts differ or not."""
    monkeypatch.setattr(toxicity, "drop_saved", lambda *tables: None)
    for text in ("'you fool'", "concat('you fool ', id)"):
        saved = {}
        monkeypatch.setattr(toxicity, "save", lambda df, name, save=toxicity.save, saved=saved: saved.setdefault(name, save(df, name)))
        docs = spark.range(2000).selectExpr("id % 4 as doc_id", f"{text} as text")
        toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int"), rows=4)
        assert 0 < saved["toxic-sample"].count() <= 4


def test_toxic_edges(spark, sf_dir):
    df = edges.rows(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        model = toxicity.train(df, labels)
        assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.0}
    assert toxicity.score(edges.empty(spark), model).count() == 0
    some = toxicity.train(toxic_table(spark, 200), toxic_table(spark, 200))
    got = toxicity.judged(toxicity.score(df, some)).collect()
    assert len(got) == len(edges.ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert queries.op8_toxicity(spark, sf_dir).count() == 200
