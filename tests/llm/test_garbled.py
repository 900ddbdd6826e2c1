"""Garbled text planted in a small archive is found and restored; rare but proper text is not touched."""

import random

import pytest
from pyspark.sql import functions as F

from ligature.llm import garbled

CLEAN = {
    "de": "Die geänderte Auswertung für das Büro wurde gewählt und die öffentliche Prüfung der Größe müssten wir früh löschen",
    "fr": "La réunion générale est déjà prête et la thèse complète sera révisée après le février à l'équipe étrange",
    "es": "La decisión última está próxima mañana tendremos que enviar la petición pequeña del señor Núñez",
    "ru": "Комиссия ещё не готова поэтому справка будет повторная на странице указана подпись",
    "ja": "研究室の会議は来週の月曜日に行われますので資料を確認してください。",
    "en": "It’s “fine” — the plan doesn’t change…",
}
PROPER = ["╔══════╗ ║ menu ║ ╚══════╝", "√2 ≠ 1,5 and ∑ ≤ ∞", "See § 3 – £40 ± 2 ¶ † ‡ ‰", "Θέμα: μήκος γωνία", "ATENÇÃO: NÃO PÃES ÂNGULO AÇÃO", "ЖК-12 «Ёлка»", "สวัสดี नमस्ते ١٢٣ 👩🏽‍🔬 ộ ầ", "CAFÉ» «À É»", "plain ascii"]


def damage(text, written, read, times=1):
    for _ in range(times):
        raw = text.encode(written)
        out = []
        for b in raw:
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeError:
                out.append(chr(b))
        text = "".join(out)
    return text


DAMAGED = [
    (damage(CLEAN["de"], "utf-8", "cp1252"), "de"), (damage(CLEAN["fr"], "utf-8", "cp437"), "fr"), (damage(CLEAN["es"], "utf-8", "mac_roman"), "es"), (damage(CLEAN["ru"], "utf-8", "cp1251"), "ru"), (damage(CLEAN["ru"], "koi8-r", "cp1251"), "ru"),
    (damage(CLEAN["ru"], "cp1251", "cp1252"), "ru"), (damage(CLEAN["fr"], "cp1252", "cp437"), "fr"), (damage(CLEAN["es"], "cp1252", "cp1251"), "es"), (damage(CLEAN["ja"], "cp932", "cp1252"), "ja"), (damage(CLEAN["de"], "utf-8", "cp1252", 2), "de"), (damage(CLEAN["en"], "utf-8", "cp1252"), "en"),
]


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(1)
    texts = []
    for words in CLEAN.values():
        for _ in range(60):
            w = words.split()
            k = rng.randrange(max(1, len(w) - 6))
            texts.append("\n".join((" ".join(w[k : k + 12]), words)) if rng.random() < 0.3 else " ".join(w[k : k + 12]))
    clean = len(texts)
    texts += [f"{p}\n{rng.choice(CLEAN['en'].split())}" for p in PROPER for _ in range(4)] + [None, "", " "]
    first = len(texts)
    texts += [f"Hello,\n{t}\nbye" for t, _ in DAMAGED]
    lost = len(texts)
    texts += ["Natürlich k�nnen wir f�r das B�ro früh l�schen"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, chunk string")
    return docs, texts, clean, first, lost


def test_found(archive):
    docs, texts, _, first, lost = archive
    got = {r.doc_id for r in garbled.garbled(docs)[0].select("doc_id").distinct().collect()}
    assert got == {*range(first, lost + 1)}, [texts[k] for k in got ^ {*range(first, lost + 1)}]


def test_restored(archive):
    docs, texts, _, first, lost = archive
    got = {r.doc_id: r.text for r in garbled.restored(docs).collect()}
    right = total = 0
    for k, (_, lang) in enumerate(DAMAGED):
        want = f"Hello,\n{CLEAN[lang]}\nbye".split()
        have = got[first + k].split()
        total += len(want)
        right += sum(a == b for a, b in zip(want, have)) if len(want) == len(have) else 0
    assert right / total > 0.9, right / total
    assert "für das Büro" in got[lost]


def test_empty(spark, archive):
    docs = archive[0]
    assert garbled.garbled(docs.limit(0))[0].count() == 0
    assert garbled.garbled(docs.where(F.col("text") == "plain ascii"))[0].count() == 0


def test_long_runs_are_cut_without_loss(spark):
    text = "x" * 500 + "é" * 1000 + "abc " + "y" * 300 + " züü"
    f = spark.createDataFrame([(1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = garbled.document_chunks(f).where("doc_id = 1").collect()
    assert max(len(r.chunk) for r in got) <= 2300 and all(r.chunk in text for r in got)
    # A run of other characters stays together.
    assert {"é", "ü"} <= {c for r in got for c in r.chunk} and any("é" * 1000 in r.chunk for r in got)
    assert garbled.document_chunks(f).select("doc_id").distinct().count() == 2


def test_wildcard():
    chars = garbled.Characters({"é": 50, "ã": 5, "©": 2, "Ã": 3}, {"al": 40, "la": 40, "pa": 60, "ap": 60, "aa": 300})
    assert garbled.wildcards("cafÃ�", "cp1252", chars) == [(3, 5, "é", 1)]
    assert garbled.wildcards("caf�©", "cp1252", chars) == [(3, 5, "é", 1)]
    chars = garbled.Characters({"研": 2, "究": 1, "室": 9, "é": 1}, {"al": 40})
    raw = damage("研", "utf-8", "cp1252")
    for keep in range(3):  # two of three bytes lost; the commonest with the byte that is left
        text = "".join(c if k == keep else "�" for k, c in enumerate(raw))
        assert (0, 3) in {(i, j) for i, j, _, n in garbled.wildcards(text, "cp1252", chars) if n == 2}


@pytest.mark.parametrize("channels", [["cp1252"] * 4, ["cp1252", "cp437"], ["cp1251", "cp1252", "cp437"], ["cp932"], ["gb18030"]])
def test_any_number_and_order_of_channels(spark, archive, channels):
    docs, texts, *_ = archive
    text = "研究室の会議資料" if channels[0] in ("cp932", "gb18030") else "geänderte"
    bad = text
    for c in channels:
        bad = damage(bad, "utf-8", c) if c not in ("cp932", "gb18030") else bad.encode("utf-8").decode(c, "replace")
    more = docs.sparkSession.createDataFrame([(len(texts), bad, "")], docs.schema)
    got = [r.original for r in garbled.garbled(docs.unionByName(more))[0].where(F.col("doc_id") == len(texts)).collect()]
    assert len(got) == 1
    if "�" not in bad:
        assert got == [text]


def test_chunks_are_restored_where_they_stand():
    fixes = {"Ã©": "é", "xÃ©y": "xéy"}
    assert garbled.put_back("Ã© aÃ©b xÃ©y Ã©", fixes) == "é aÃ©b xéy é"
    long = "a" * 300 + "Ã©" + "b" * 10
    assert garbled.put_back(f"{long} {long}", {"a" * 60 + "Ã©" + "b" * 10: "a" * 60 + "é" + "b" * 10}) == " ".join(["a" * 300 + "é" + "b" * 10] * 2)


def test_pieces_in_both_languages_are_the_same(spark):
    texts = ["a" * 500 + "é" * 2500 + "b" * 400 + "ü" + "c" * 200 + "\tñ x", "é", " é\u00a0ü ", "😀" * 300 + "a😀", "a\x85b é\n\n" + "x" * 70 + "ö" * 151 + "y"]
    f = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, text in enumerate(texts):
        want = {r.chunk for r in garbled.document_chunks(f).where(F.col("doc_id") == k).collect()}
        got = set()
        for m in garbled.chunk_pattern().finditer(text):
            got.add(garbled.lead_start().sub("", m[0]) if len(m[0]) > garbled.LEAD_FROM else m[0])
        assert got == want


def test_words_decide_among_all_originals(spark):
    # Russian letters beside ASCII ones: by characters six of them explain the odd one better than the rare à does.
    letters = [t for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя" for t in (f"{c}xy", f"x{c}y", f"xy{c}") for _ in range(30)]
    texts = [*letters, *["voilà"] * 8, *["VOILÀ"] * 60, damage("voilà", "cp1252", "cp850")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.original) for r in garbled.garbled(docs)[0].collect()] == [(len(texts) - 1, "voilà")]


def test_lost_bytes_are_found_whatever_else_fails(spark):
    # é for Ã and the lost byte explains it, but gains too little for UTF-8.
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["éa"] * 3 + ["Ã"] * 3 + ["Ã�"])], "doc_id long, text string")
    assert [(r.doc_id) for r in garbled.garbled(docs)[0].collect()] == [6]


def test_rare_characters_pay_but_do_not_forbid(archive):
    # Of none of these is the first character (the fifth kanji, the face) anywhere else in the archive.
    docs, texts, *_ = archive
    odd = [("Щука", "utf-8", "cp1252"), ("会議資料鱻を確認", "utf-8", "cp1252"), ("😀", "utf-8", "cp1252")]
    more = docs.sparkSession.createDataFrame([(len(texts) + k, damage(*x), "") for k, x in enumerate(odd)], docs.schema)
    got = {r.doc_id: r.original for r in garbled.garbled(docs.unionByName(more))[0].where(F.col("doc_id") >= len(texts)).collect()}
    assert got == {len(texts) + k: t for k, (t, _, _) in enumerate(odd)}
