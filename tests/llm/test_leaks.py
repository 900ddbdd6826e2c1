"""Leaked passages against a plain search, and mails as they are stored."""

import base64
import quopri

import numpy as np
import pytest

from ligature.llm import leaks
from ligature.llm.mail import segments

ITEM = "Each lens between Alpha and Beta gathered a amber isotope of mass 789; which value fits the größer Körner of Gamma"
WORDS = leaks.words_of(ITEM)
TEN, NINE = " ".join(WORDS[3:13]), " ".join(WORDS[3:12])


def mail(body, head="", kind="text/plain; charset=utf-8", how="8bit"):
    return f"From: a@b\nSubject: x\n{head}Content-Type: {kind}\nContent-Transfer-Encoding: {how}\n\n{body}"


def nested(parts, close=True):
    body = "".join(f"--B\nContent-Type: {k}\nContent-Transfer-Encoding: {h}\n\n{b}\n" for k, h, b in parts)
    return f'From: a@b\nContent-Type: multipart/mixed;\n\tboundary="B"\n\n{body}' + ("--B--\n" if close else "")


QP = quopri.encodestring(ITEM.encode(), quotetabs=False).decode()
B64 = base64.encodebytes(ITEM.encode()).decode()
HIT = [
    TEN, f"so: {ITEM.upper()}!", TEN.replace(" ", ",\n> "), mail(ITEM), mail(QP, how="quoted-printable"), mail(B64, how="base64"), mail(ITEM).replace("\n", "\r\n"),
    mail("<p>" + TEN.replace(" ", " <b>", 1).replace("beta", "<i>be</i>ta") + "<br>", kind="text/html"), mail(TEN.replace(" ", "&nbsp;"), kind="text/html"), mail("<!-- x -->" + ITEM.replace("ö", "&ouml;"), kind="text/html"),
    nested([("text/plain", "8bit", "no"), ("text/html", "quoted-printable", QP)]), nested([("text/plain", "base64", B64)], close=False), f"From: a@b\nSubject: {TEN}\n\nbody",
    "From: a@b\nSubject: =?utf-8?B?" + base64.b64encode(TEN.encode()).decode() + "?=\n\nbody", nested([("message/rfc822", "8bit", mail(ITEM))]),
    nested([("multipart/alternative; boundary=C", "8bit", "--C\nContent-Type: text/plain\n\n" + ITEM + "\n--C--")]), mail(ITEM.encode().decode("latin-1").encode("latin-1").decode("utf-8"), kind="text/plain; charset=nonsense"),
]
MISS = [None, "", " ", NINE, TEN.replace("amber", "amber x", 1), " ".join(reversed(TEN.split())), nested([("application/pdf", "base64", B64)]), "From: a@b", nested([("text/plain", "8bit", NINE), ("text/plain", "8bit", WORDS[12])])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, ITEM + " and more words that nobody else has in here")], "item_id long, text string")


def found(docs, items, **kw):
    return {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items, **kw).collect()}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, item_id int")


def test_found(spark, items):
    got = found(frame(spark, HIT + MISS), items)
    assert got == {(k, i) for k in range(len(HIT)) for i in (1, 4)}


def test_blocks_of_items(spark, items):
    docs = frame(spark, HIT)
    assert found(docs, items, index_words=5) == found(docs, items)


def test_radius_and_similarity(spark, items):
    changed = " ".join(w if k else "other" for k, w in enumerate(WORDS[:18]))
    docs = frame(spark, [changed, " ".join(WORDS[:18]), "nothing alike at all in this text of more than ten words here"])
    near = found(docs, items, window=18, radius=3, similarity=0.5, same_words=False)
    assert near >= {(1, 1), (1, 4)} and not any(d == 2 for d, _ in near)
    assert found(docs, items, window=18, radius=3, similarity=0.5) == {(1, 1), (1, 4)}


def test_similarity_is_that_of_weighted_shingles():
    index = leaks.Index([(1, ITEM)], 10, 3, 0.8)
    a = index.passages(np.array([0]))[0]
    b = a.copy()
    b[0] = 7
    assert index.similar(a, a) and not index.similar(a, b)
    # Five of six shingles are left; the lost one on either side weighs least in a lower threshold.
    index.similarity = 0.6
    assert index.similar(a, b)


def test_deep_and_split_parts():
    text = f"Content-Type: text/plain\n\n{TEN}"
    for k in range(60):
        text = f"Content-Type: multipart/mixed; boundary=b{k}\n\n--b{k}\n{text}\n--b{k}--\n"
    assert any(TEN in s for s in segments(text))
    for k in range(60):
        text = f"Content-Type: message/rfc822\n\n{text}"
    assert any(TEN in s for s in segments(text))
    halves = [base64.b64encode(x.encode()).decode() for x in (TEN[:40], TEN[40:])]
    assert halves[0].endswith("=") and TEN in list(segments(mail("\n".join(halves), how="base64")))[1]


def test_candidates_are_complete():
    rng = np.random.default_rng(1)
    index = leaks.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 40, 60))) for k in range(5)], 10, 3, 0.8)
    prints = index.prints[rng.integers(0, len(index.prints), 500)].copy()
    for k in range(500):
        for bit in rng.integers(0, 64, rng.integers(0, 5)):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    want = {(a, b) for a in range(500) for b in range(len(index.prints)) if bin(int(prints[a]) ^ int(index.prints[b])).count("1") <= 3}
    assert set(zip(*(x.tolist() for x in index.candidates(prints)))) == want


def test_fingerprint_is_the_majority():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    bits = lambda x: np.unpackbits(np.array([x], np.uint64).view(np.uint8))
    for k, p in enumerate(leaks.fingerprints(h, 10)):
        assert (bits(p) == (np.sum([bits(x) for x in h[k : k + 10]], axis=0) * 2 > 10)).all()


def test_very_long_text(spark, items):
    filler = " ".join(f"w{k % 9973}" for k in range(150_000))
    at = " ".join(f"w{k % 9973}" for k in range(leaks.CHUNK_WORDS - 5))
    got = found(frame(spark, [f"{filler} {TEN} {filler}", f"{at} {TEN} {filler}", filler, "x" * 2_000_000]), items)
    assert got == {(k, i) for k in (0, 1) for i in (1, 4)}


def test_segments_never_fail():
    for text in ("\n\n", ":", "From:", "Content-Type: multipart/mixed; boundary=\n\n--", "Content-Type: multipart/mixed; boundary=x\n\n--x", "a: b\nContent-Transfer-Encoding: base64\n\n=", "a: b\nContent-Transfer-Encoding: quoted-printable\n\n=ZZ=", "=?x?b?!!?=", "\r"):
        list(segments(text))


def test_empty(spark, items):
    assert found(frame(spark, ["x"]).limit(0), items) == set() and found(frame(spark, HIT[:1]), items.limit(0)) == set()
