"""Documents with awkward cases, and the word rules in plain Python."""

import re
from collections import Counter

import duckdb

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h i j k",
    "Été à la plage, l’été encore ligne Σ",
    "x\n\nline one two\nline one two\n line one two\nline one two",
    "a b c d e a b c d e a b c d e f",
    "### $$$ *** a|b <c> & % d e f g h i j",
    "THE END OF ALL WORDS IS HERE AND NOW OK YES NO",
    "nul\x00byte \x1c file sep \x85 next\x0bline feed\x0c page\r\nend 🎉🎉",
    LONG,
    "same same same same same same same same same same same same",
]


def rows(texts=TEXTS, first=0):
    return [(first + i, t, "en", "src0", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]


def lower(text):
    return (text or "").translate(UPPER)


def space_words(text):
    return SPACE_WORD.findall(text or "")


def alnum_words(text):
    return ALNUM_WORD.findall(lower(text))


def same_rows(spark, folder, query, sql, **tables):
    """Assert that a registered query and its SQL give the same rows over small tables."""
    db = duckdb.connect()
    for name, (data, schema) in tables.items():
        path = str(folder / f"{name}.parquet")
        spark.createDataFrame(data, schema).write.parquet(path)
        db.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    got, want = query(spark, str(folder)), db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want.fetchall())
