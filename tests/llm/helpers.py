"""Small inputs that every operator must survive."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def from_texts(spark, texts):
    return documents(spark, [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)])
