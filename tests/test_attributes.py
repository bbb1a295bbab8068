import pytest

from glyphlake.operators import attributes as A
from glyphlake.operators.packing import estimate
from glyphlake.settings import Attribute, Settings

FIELDS = (Attribute("gender", "ss_gender", "text", "g"), Attribute("tropes", "ss_tropes", "tags", "t"))


def settings(**more):
    return Settings(attributes=FIELDS, **more)


def chunks(spark, books):
    return spark.createDataFrame([(b, i, t) for b, texts in books.items() for i, t in enumerate(texts)], "book_id long, chunk_no int, text string")


def collected(df):
    return {r["book_id"]: r for r in df.collect()}


def test_sampled_and_errors(spark):
    def model(prompt, fields, options):
        if "bad" in prompt:
            raise RuntimeError("down")
        if "none" in prompt:
            return None
        return {"gender": " female ", "tropes": "a, b. , a (x)"}

    got = collected(A.extract_attributes(chunks(spark, {1: ["text"], 2: ["bad"], 3: ["none"]}), model, settings()))
    assert got[1]["values"] == {"gender": ["female"], "tropes": ["a", "b"]} and got[1]["error"] is None
    assert got[2]["values"] is None and "down" in got[2]["error"]
    assert got[3]["values"] == {"gender": [], "tropes": []}


def test_full_text_merges(spark):
    def model(prompt, fields, options):
        if "part 1: " in prompt:
            assert "part 1: one" in prompt and "part 2: two" in prompt
            return {"gender": "merged"} if "keep" not in prompt else {"gender": None}
        return {"gender": "one" if "first" in prompt else "two", "tropes": ["Slow Burn", "x"] if "first" in prompt else ["slow burn", "y"]}

    long = "word " * 500
    got = collected(A.extract_attributes(chunks(spark, {1: ["first " + long, "second " + long], 2: ["first " + long]}), model, settings(attr_mode="fulltext", attr_context_tokens=1700)))
    assert got[1]["values"] == {"gender": ["merged"], "tropes": ["Slow Burn", "x", "y"]}
    assert got[2]["values"] == {"gender": ["one"], "tropes": ["Slow Burn", "x"]}


def test_retries():
    calls = []

    def flaky(prompt, fields, options):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no json")
        return {"a": 1}

    assert A.answer(flaky, "", FIELDS) == {"a": 1} and len(calls) == 3
    with pytest.raises(ValueError):
        A.answer(lambda *a: (_ for _ in ()).throw(ValueError("x")), "", FIELDS)
    calls.clear()
    with pytest.raises(OSError):
        A.answer(lambda *a: (calls.append(1), (_ for _ in ()).throw(OSError("net")))[1], "", FIELDS)
    assert len(calls) == 1


def test_prompts():
    p = A.prompt("TEXT", (Attribute("a", "l", "tags", "d", language="book"), Attribute("b", "l", "text", "e", language="French")))
    assert "* a (a list of short tags, in the language the book is written in): d\n" in p and "* b (a text, in French): e\n" in p and p.endswith("TEXT")
    field, other = FIELDS
    nine = [(field, [f"v{i} " * 50 for i in range(9)]), (other, ["w0", "w1", "w2"])]
    full = A.merge_prompt(nine)
    parts = lambda text: [line.split(":")[0].strip() for line in text.split("\n") if line.startswith("  part")]
    assert parts(full) == [f"part {i}" for i in (*range(1, 10), 1, 2, 3)]
    for most in (10, 200, 250, 300, 350, 10_000):
        cut = A.merge_prompt(nine, most)
        kept = [int(x.split()[1]) for x in parts(cut)]
        longest = len(kept) - (3 if len(kept) > 4 else 2)
        assert "v0" in cut and "v8" in cut and "w0" in cut and "w2" in cut and kept[: (longest + 1) // 2] == list(range(1, (longest + 1) // 2 + 1))
        assert estimate(cut) <= most + 1 or longest == 2
    assert A.merge_prompt(nine, 10_000) == full and A.merge_prompt([], 5) and "w1" not in A.merge_prompt(nine, 10)


def test_answer_schema():
    assert A.answer_schema(FIELDS).simpleString() == "struct<gender:string,tropes:array<string>>"


def test_mirror_and_counts(spark):
    attrs = spark.createDataFrame([(1, {"gender": ["f"], "tropes": ["A b", "c"]}), (2, {"gender": [], "tropes": ["a  B"]})], "book_id long, values map<string,array<string>>")
    rows = collected(A.mirror(attrs, FIELDS))
    assert rows[1]["ss_gender"] == "f" and rows[1]["ss_tropes"] == ["A b", "c"] and rows[2]["ss_gender"] is None
    assert {r["key"]: r["n"] for r in A.tag_counts(attrs, "tropes").collect()} == {"a b": 2, "c": 1}
