"""Language identification with many declared languages."""

import random

from logweave.llm import langid

PAGES = "page_id long, url string, html string"


def text(language, seed):
    """Forty words of letters that no other language has."""
    rnd = random.Random(seed)
    return " ".join("".join(chr(0x4E00 + language * 16 + rnd.randrange(12)) for _ in range(4)) for _ in range(40))


def test_language_declared_besides_many(spark):
    docs = spark.createDataFrame([(i, text(i % 2, i), "ab"[i % 2] * 2) for i in range(40)], "doc_id long, text string, lang string")
    junk = ["".join(x) for x in zip("qwertyuiopasdfghjklz" * 15, [a for a in "abcdefghijklmno" for _ in range(20)], "x" * 300, strict=True)]
    assert len(set(junk)) == 300
    pages = [(i, f"http://h{i}.x{i % 9}/", f'<html lang="{x}">{text(0, i)}') for i, x in enumerate(junk)]
    pages += [(i, f"http://h{i}.x{i % 9}/", f'<html lang="bb">{text(1, i)}') for i in range(300, 340)]
    pages += [(i, f"http://h{i}.x{i % 9}/", '<html lang="bb">') for i in (340,)]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(pages, PAGES), docs).collect()}
    assert got == {i: "aa" if i < 300 else "bb" for i in range(341)}


def test_more_languages_than_are_scored_at_a_time(spark):
    n = 2 * langid.LANGUAGES + 2
    name = lambda k: "".join(chr(97 + x) for x in divmod(k, 26)) + "x"
    docs = spark.createDataFrame([(i, text(i % n, i), name(i % n)) for i in range(2 * n)] + [(9999, "", "none")], "doc_id long, text string, lang string")
    langs, table = langid.fit(docs)
    assert langs == sorted([*map(name, range(n)), "none"]) and len(table[0]) > 0
    pages = spark.createDataFrame([(k, f"http://h{k}.x{k}/", f"<html>{text(k, 7000 + k)}") for k in range(n)], PAGES)
    got = {r["page_id"]: r["lang"] for r in langid.identify(pages, docs).collect()}
    assert got == {k: name(k) for k in range(n)}
