"""Name variants made by rules are linked; namesakes and sister institutions are not."""

import pytest
from pyspark.sql import functions as F

from ligature.llm import names

ORGS = {
    "u": ["University of Hirnupbakba", "The University of Hirnupbakba ", "Univ. of Hirnupbakba", "Universität Hirnupbakba", "UNIVERSIDAD DE HIRNUPBAKBA", "U. Hirnupbakba", "University, Hirnupbakba", "University of Hirnupbaka", "Univrsity of Hirnupbakba", "Dept. of Ecology, University of Hirnupbakba", "University of Hirnupbakba, Hirnupbakba"],
    "t": ["Hirnupbakba University of Technology", "TU Hirnupbakba", "Technische Universität Hirnupbakba", "Univ. Technol. Hirnupbakba", "Hirnupbakba Univ Tech."],
    "h": ["Hirnupbakba General Hospital", "Gen Hospital Hirnupbakba", "General Hosp., Hirnupbakba"],
    "v": ["University of Vadvuzgodna", "Vadvuzgodna University"],
    "i": ["Ketmashemza Institute of Marine Biology", "Inst. Marine Biol., Ketmashemza", "Institute for Marine Biology (Ketmashemza)", "Marine Biology Institute, Ketmashemza"],
    "a": ["Zotrikmezve Analytics Ltd", "Analytics Ltd (Zotrikmezve)", "Zotrikmezve Analytics", "Zotrikmezve Analytics Limited"],
}
PEOPLE = {
    "a": ["Joseph P. Mezzuhlar", "Joe Mézzuhlar", 'Joseph "Joe" Mézzuhlar', "MEZZUHLAR Joseph", "Mézzuhlar JP", "Mezzuhlar, J.", "Josepph Mézzuhlar", "Joseph Mezzulhar", "Dr. Joseph Mezzuhlar, PhD", "Joseph\xa0Mezzuhlar", "joseph mezzuhlar", "J. Mezzuhlar"],
    "b": ["Katherine Mezzuhlar", "Kate Mezzuhlar"],
    "c": ["Wei Rikpomgan", "Rikpomgan, We", "W. Rikpomgan"],
}


def frame(spark, rows):
    return spark.createDataFrame([(1_000_000_000 + k, n, o, "x") for k, (n, o) in enumerate(rows)], "article_id long, author_name string, author_org string, org string")


def test_institutions(spark):
    rows = [("n", o) for orgs in ORGS.values() for o in orgs for _ in range(3)] + [("n", o) for o in (None, "", " N/A ", "a@b.example")]
    inst, _ = names.variants(frame(spark, rows))
    got = {r.org: r.inst for r in inst.collect()}
    assert len(got) == sum(map(len, ORGS.values()))
    assert len({got[o] for orgs in ORGS.values() for o in orgs}) == len(ORGS)
    for orgs in ORGS.values():
        assert len({got[o] for o in orgs}) == 1, {o: got[o] for o in orgs}


def test_people(spark):
    rows = [(n, "University of Hirnupbakba") for ps in PEOPLE.values() for n in ps for _ in range(2)]
    rows += [("Joseph Mezzuhlar", "University of Vadvuzgodna"), (None, "University of Hirnupbakba"), ("-", "University of Hirnupbakba"), ("Single", "University of Hirnupbakba"), ("Joseph Mezzuhlar", None), ("Joseph Mezzuhlar", "j@x")]
    _, people = names.variants(frame(spark, rows))
    got = {}
    for r in people.collect():
        got.setdefault((r.name, r.inst.split("|")[1]), r.person)
    for ps in PEOPLE.values():
        assert len({got[p, "hirnupbakba"] for p in ps}) == 1, {p: got[p, "hirnupbakba"] for p in ps}
    assert len({got[ps[0], "hirnupbakba"] for ps in PEOPLE.values()}) == 3
    assert got["Joseph Mezzuhlar", "vadvuzgodna"] != got["Joe Mézzuhlar", "hirnupbakba"]


def test_links(spark):
    rows = [("Ann Lumvinges", "University of Hirnupbakba"), ("A. Lumvinges", "U. Hirnupbakba"), ("Ann Lumvinges", "U. Hirnupbakba")]
    f = frame(spark, rows)
    got = {(r.entity_kind, r.left_key, r.right_key) for r in names.linked(*names.variants(f.unionByName(f))).collect()}
    assert got == {("org", "U. Hirnupbakba", "University of Hirnupbakba"), ("person", "1000000000", "1000000001"), ("person", "1000000001", "1000000002")}


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", True), ("abc", "ab", True), ("abc", "acb", True), ("abc", "axc", True), ("abc", "cab", False), ("", "a", True), ("ab", "abcd", False)])
def test_one_edit(a, b, near):
    assert names.one_edit(a, b) == near == names.one_edit(b, a)


def test_forms():
    assert names.readings("Tabpavkap, C.F.") == [("tabpavkap", "", "c", "f")]
    assert names.readings("T.K. Rikpomgan") == [("rikpomgan", "", "t", "k")]
    assert names.readings("FIVKULNEH Łukasz") == [("fivkulneh", "lukasz", "l", "")]
    assert names.readings("Joseph Mezzuhlar") == [("mezzuhlar", "joseph", "j", ""), ("joseph", "mezzuhlar", "m", "")]
    assert names.readings("PhD") == names.readings("") == names.readings("x") == []


def test_parts_turned_round(spark):
    org = "University of Hirnupbakba"
    rows = [("Joseph Mezzuhlar", org), ("Joe Mezzuhlar", org), ("Mezzuhlar Joseph", org), ("MEZZUHLAR JOSEPH", org), ("mezzuhlar joe", org), ("Joseph Rikpomgan", org), *((f"Joseph {f}", org) for f in ("Vosvekrus", "Hirtortab")), ("Ann Lumvinges", org), ("Lumvinges Ann", org), ("Ann Ketmash", org), ("Thomas Joseph", org)]
    _, people = names.variants(frame(spark, rows))
    got = {r.name: r.person for r in people.collect()}
    assert len({got[n] for n in ("Joseph Mezzuhlar", "Joe Mezzuhlar", "Mezzuhlar Joseph", "MEZZUHLAR JOSEPH", "mezzuhlar joe")}) == 1
    assert got["Lumvinges Ann"] == got["Ann Lumvinges"] and len(set(got.values())) == 7


def test_initials_of_a_common_name_link_to_nobody(spark):
    """Where chance puts several bearers of a rewriting into an institution, it is no evidence."""
    many = [(f"{g} Smith", f"University of {c}{c}{c}rford") for c in "abcdefgh" for g in ("John", "James", "Joan", "Jill", "Jack") for _ in range(50)]
    here = [("John Smith", "University of Zzzrford"), ("J. Smith", "University of Zzzrford"), ("Ann Lumvinges", "University of Zzzrford"), ("A. Lumvinges", "University of Zzzrford")]
    inst, people = names.variants(frame(spark, many + here))
    got = {r.name: (r.person, r.score) for r in people.where("inst like '%zzzrford%'").collect()}
    assert got["J. Smith"][0] is None and got["A. Lumvinges"][0] == got["Ann Lumvinges"][0] is not None
    assert got["A. Lumvinges"][1] > got["J. Smith"][1]
    scores = {r.member_key: (r.links, r.score) for r in names.rarity(inst, people).where("entity_kind = 'person'").collect()}
    assert sorted(n for n, _ in scores.values()) == [1, 1]


def test_large_entities_meet_in_blocks(spark):
    org = "University of Hirnupbakba"
    rows = [(f"{'Dr. ' * (k % 2)}Joseph Mezzuhlar", org) for k in range(40)]
    inst, people = names.variants(frame(spark, rows))
    whole = sorted(map(tuple, names.linked(inst, people).collect()))
    assert len(whole) == 400 and whole == sorted(map(tuple, names.linked(inst, people, block=7).collect()))


def test_long_words_have_neighbours(spark):
    for n in (65, 126, 127, 128, 129, 130, 255, 256, 257, 400):
        word = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(n))
        near = [word[:k] + word[k + 1 :] for k in (0, n // 2, n - 1)] + [word[:k] + "#" + word[k:] for k in (0, n // 2, n)] + [word[:k] + "#" + word[k + 1 :] for k in (0, n // 2 - 1, n - 1)] + [word[: n // 2] + word[n // 2 + 1] + word[n // 2] + word[n // 2 + 2 :]]
        rows = [(word, 1000), *((x, 1) for x in set(near) - {word})]
        got = {r.word for r in names.heads(spark.createDataFrame(rows, "word string, n long"), []).where(F.col("head") == word).collect()}
        assert got == {x for x, _ in rows[1:]}, n


def test_very_long_and_odd_names(spark):
    rows = [("x" * 200_000 + " y", "University of " + "z" * 200_000), ("y " * 5000, "," * 1000), ("\x00", "()"), ("A. B.", "Univ"), ("O'Neil-Smith, Mary-Ann", "Univ. of X")]
    inst, people = names.variants(frame(spark, rows + rows))
    assert inst.count() == 5 and people.count() <= 5


def test_empty(spark):
    f = frame(spark, [("a b", "c")]).limit(0)
    inst, people = names.variants(f)
    assert inst.count() == 0 and people.count() == 0 and names.linked(inst, people).count() == 0


def test_institutions_without_a_place(spark):
    same = [["National Institute of Public Health", "Natl. Inst. of Public Health"], ["Medical Research Institute", "Institute for Medical Research"], ["Dept. of Ecology", "Dept of Ecology"], ["University of Marina", "Univ. of Marina"]]
    rows = [(n, o) for orgs in same for o, n in zip(orgs, ("Ann Lumvinges", "A. Lumvinges"))]
    inst, people = names.variants(frame(spark, rows))
    got = {r.org: r.inst for r in inst.collect()}
    assert all(got[a] == got[b] is not None for a, b in same) and len(set(got.values())) == len(same)
    assert sum(r.entity_kind == "person" for r in names.linked(inst, people).collect()) == len(same)


def test_errors_whatever_the_order_of_tokens(spark):
    words = spark.createDataFrame([("hagnat health", 50), ("health hgnat", 1), ("hagnat healht", 1), ("hagnathealth", 1), ("gnat health", 1)], "word string, n long")
    got = {(r.word, r.head) for r in names.heads(words, []).collect()}
    assert got >= {(w, "hagnat health") for w in ("health hgnat", "hagnat healht", "hagnathealth")}
    assert ("gnat health", "hagnat health") not in got


def test_heads_look_past_common_neighbours(spark):
    words = spark.createDataFrame([("anne", 50), ("jane", 20), ("hane", 1), *((f"{'z' * 60} {'y' * 20}{c}", n) for c, n in (("a", 9), ("b", 1)))], "word string, n long")
    got = {(r.word, r.head) for r in names.heads(words, []).collect()}
    assert got == {("hane", "jane"), (f"{'z' * 60} {'y' * 20}b", f"{'z' * 60} {'y' * 20}a")}


def test_heads_are_followed_to_the_end(spark):
    chain = [("abcdefgh", 100000), ("abcdefgx", 10000), ("abcdefyx", 1000), ("abcdeuyx", 100), ("abcdtuyx", 10)]
    got = {r.word: r.root for r in names.rooted(spark.createDataFrame(chain, "word string, n long"), []).collect()}
    assert got == {w: "abcdefgh" for w, _ in chain}
