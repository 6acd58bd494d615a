"""Small tables for the operators: nulls, blanks, repeats, ties, and columns whose names could clash."""

CLASH = "id bigint, key string, n int, hash bigint, fp bigint, part int, text_hash string"


def docs(spark, rows, clash=False):
    """(doc_id, text, lang, source, n_chars); ``rows`` are (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(type(v)), v) for v in t))
