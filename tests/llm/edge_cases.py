"""Small tables with every awkward case, for all operators."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P1 = "the quick brown fox jumps over the lazy dog while seven wizards box quietly near an old stone bridge"
P2 = "un petit chat noir dort sur le vieux fauteuil pendant que la pluie tombe dehors sans bruit ce soir"
P3 = "der alte mann geht langsam durch den dunklen wald und sucht seinen hund der gestern weggelaufen ist"
LONG = " ".join(f"{P1} {i}" for i in range(3000))


def documents():
    rows = [
        (1, P1, "en", "a"), (2, P1, "en", "a"), (3, P1 + " indeed", "en", "b"),
        (4, P2, "fr", None), (5, P2.upper(), "fr", "b"), (6, P3, "de", "c"),
        (7, None, None, None), (8, "", "en", "a"), (9, "  \n\t ", None, "b"), (10, "12 34 !!", "en", "c"),
        (11, LONG, "en", "a"), (12, LONG + " end", None, "a"), (13, "hi", "en", "c"), (14, "hi", "en", "c"),
        (14, "hi", "en", "c"), (None, P3 + " oh", "de", "a"), (None, None, "de", None), (15, "日本語 テスト é 😀", "ja", "c"),
        (16, f"{P1}\n{P2}\n{P3}\n{P1}", "en", "b"), (17, f"x\n{P1}\n{P2}\n{P3}", "en", "b"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC_SCHEMA)


#: Names that operators use for columns of their own.
CLASHES = ("hits", "language", "n", "node", "size", "p", "bucket", "k", "h", "copied", "doc", "place", "half", "cell", "mix_key",
           "first_id", "row_key", "component_id", "runs", "n_tokens", "start")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
