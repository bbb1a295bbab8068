"""Tables with nulls, empty and long texts, ties, repeated rows and other columns of clashing names; and empty ones."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i) % 20] + str(i % 97) for i in range(40_000))
ROWS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "text without an id here at all"), (4, LONG), (5, " \n\t "), (6, "one two three four five six seven"), (6, "another text under one id"), (7, "é字\U0001F600 \x00 ß"), (8, "short")]
EXTRA = "n long, text_len long, spans string, score double, `set` binary, label long, rep long, id long, ids binary, n_tokens long, component_id string, fingerprint string, range int, own boolean, h long, ws string, leaking long, gone long, again long, `rows` long, pattern string, place long, part int, `key` string, toxic int, x double"


def rows(spark, data=None, key="doc_id", text="text"):
    """(key, text) with many more columns, all null."""
    df = spark.createDataFrame(ROWS if data is None else data, f"{key} long, {text} string")
    names = [x.split()[0].strip("`") for x in EXTRA.split(", ")]
    kinds = [x.split()[1] for x in EXTRA.split(", ")]
    return df.selectExpr("*", *[f"cast(null as {k}) as `{n}`" for n, k in zip(names, kinds, strict=True) if n not in (key, text)])


def empty(spark, key="doc_id", text="text"):
    return rows(spark, key=key, text=text).limit(0)
