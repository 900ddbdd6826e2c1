"""Nested records against a plain reading of the rules."""

import json

from ligature.operators import nested

AFF = {"name": "N", "organisationName": None, "address": {"city": "C"}, "departments": [{"name": "D"}, None], "new": 1}
MODEL = {"submission": {"authors": [None, {"fullName": "A", "isSubmittingAuthor": True, "primaryAffiliation": AFF, "affiliations": [None, AFF, 5]}, "x", {"email": "e", "affiliations": AFF, "roles": {"credit": {"term": "t"}}}]}}


def frame(spark, *models):
    return spark.createDataFrame([(k, m, "clash") for k, m in enumerate(models)], "id long, resource_model string, version_id string")


def keys(df):
    return sorted((r.version_id, r.author_pos, r.node, r.affil_pos) for r in df.collect())


WANT = [(1, "author", -1), (1, "primary", -1), (1, "affiliation", 1), (3, "author", -1), (3, "affiliation", 0)]


def test_positions(spark):
    whole = json.dumps(MODEL)
    outer = json.dumps({"submission": json.dumps(MODEL["submission"])})
    models = [whole, json.dumps(whole), outer, "﻿ \n" + whole + "\n ", json.dumps(json.dumps(MODEL["submission"])), None, "", "null", "[]", "{}", whole[:-3], '{"submission": []}', '{"submission": {"authors": 3}}']
    got = keys(nested.positions(frame(spark, *models)))
    assert got == sorted((v, *w) for v in (0, 1, 2, 3) for w in WANT)


def test_repeated_rows_count_once(spark):
    f = frame(spark, json.dumps(MODEL))
    assert keys(nested.positions(f.unionByName(f))) == sorted((0, *w) for w in WANT)


def test_subtypes(spark):
    nodes = nested.flatten(frame(spark, json.dumps(MODEL)))
    a = {r.author_pos: r for r in nested.subtype(nodes, "author").collect()}
    assert a[1].full_name == "A" and a[1].is_submitting and a[3].email == "e" and a[3].is_submitting is None
    f = nested.subtype(nodes, "affiliation").collect()
    assert len(f) == 3 and all(r.name == "N" and r.organisation is None and r.city == "C" and json.loads(r.extra) == {"new": 1} for r in f)
    assert [(r.affil_pos, r.item_pos, r.name) for r in nested.subtype(nodes, "department").orderBy("affil_pos", "author_pos").collect()] == [(-1, 0, "D"), (0, 0, "D"), (1, 0, "D")]
    assert [r.name for r in nested.subtype(nodes, "role").collect()] == ["t"]


def test_states():
    assert nested.state({"b": [1, "x", 2], "a": None}).name == "{a:0,b:[n|s]}"
    assert nested.state({"a": True, "b": {"c": 1.5}}).name == nested.state({"b": {"c": 2}, "a": False}).name
    a = nested.Automaton()
    first, second = a.read({"x": [1], "y": "t"}), a.read({"y": "u", "x": [2, 3]})
    assert first is second and nested.plan("author", first) is nested.plan("author", second)
    assert len(nested.state([[["x" * 300]], {"k" * 300: 1}]).name) <= nested.LONGEST_NAME


def test_rows_are_routed_by_their_states(spark, monkeypatch):
    """With every state the same, nothing has a transition and no row comes out."""
    automaton = nested.Automaton()
    assert len(list(nested.nodes_of(1, json.dumps(MODEL), automaton))) > 5
    monkeypatch.setattr(nested.Automaton, "step", lambda self, value: nested.LEAVES[str])
    assert not list(nested.nodes_of(1, json.dumps(MODEL), nested.Automaton()))


def test_unknown_variants_have_their_table(spark):
    model = {"submission": {"authors": [{"fullName": "A", "employer": {"name": "X"}, "links": [{"u": 1}], "plain": [1], "affiliations": [{"parent": {"name": "Y"}}]}]}}
    nodes = nested.flatten(frame(spark, json.dumps(model)))
    got = sorted((r.author_pos, r.affil_pos, r.name, r.extra) for r in nested.subtype(nodes, "other").collect())
    assert got == [(0, -1, "author.employer", '{"name": "X"}'), (0, -1, "author.links", '[{"u": 1}]'), (0, 0, "affiliation.parent", '{"name": "Y"}')]
    assert json.loads(nested.subtype(nodes, "author").first().extra) == {"plain": [1]}
    model = {"id": 7, "review": {"stage": {"id": 1}}, "submission": {"title": "T", "details": [{"k": 1}], "authors": []}}
    outer = nested.flatten(frame(spark, json.dumps(model)), outer=True)
    assert sorted((r.node, r.name or "", r.extra) for r in outer.collect()) == [("other", "record.review", '{"stage": {"id": 1}}'), ("other", "submission.details", '[{"k": 1}]'), ("record", "", '{"id": 7}'), ("submission", "", '{"title": "T"}')]


def test_deep_records(spark):
    deep = '{"a":' * 700 + "1" + "}" * 700
    model = '{"submission": {"authors": [{"fullName": "A", "new": ' + deep + "}]}}"
    arrays = '{"submission": {"authors": [{"fullName": "B", "new": ' + "[" * 50_000 + "]" * 50_000 + "}]}}"
    f = frame(spark, model, "[" * 100_000, arrays, arrays[:-1])
    assert keys(nested.positions(f)) == [(0, 0, "author", -1), (2, 0, "author", -1)]
    got = {r.version_id: r.extra for r in nested.subtype(nested.flatten(f), "other").collect()}
    assert json.loads(got[0]) == json.loads(deep) and got[2] == "[" * 50_000 + "]" * 50_000


def test_wrapped_many_times(spark):
    model = json.dumps({"submission": json.dumps(json.dumps(MODEL["submission"]))})
    for _ in range(10):
        model = json.dumps(model)
    assert keys(nested.positions(frame(spark, model))) == sorted((0, *w) for w in WANT)


def test_deep_reader_reads_what_the_plain_one_does():
    texts = ['{"a": [1, -2.5e3, "x\\"y", null, true, {}], "b": [], "c": {"d": [[]]}}', " [1] ", '"x"', "5", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "]", "", "[}", '{"a":1}}', "[", "tru", '{1:2}', "[,1]"]
    for text in texts:
        try:
            want = json.loads(text)
        except ValueError:
            want = "broken"
        try:
            got = nested.deep_loads(text)
        except ValueError:
            got = "broken"
        assert got == want, text
        if want != "broken":
            assert nested.deep_dumps(want) == json.dumps(want, sort_keys=True)


def test_odd_texts(spark):
    model = '{"submission": {"authors": [{"fullName": "\\ud800x", "n": ' + "9" * 5000 + "}]}}"
    assert nested.subtype(nested.flatten(frame(spark, model)), "author").first().full_name == "?x"


def test_empty(spark):
    f = frame(spark, "x").limit(0)
    assert nested.positions(f).count() == 0 and nested.flatten(f).count() == 0


def test_plain_strings_are_affiliations(spark):
    nodes = nested.flatten(frame(spark, json.dumps({"submission": {"authors": [{"primaryAffiliation": "P", "affiliations": ["A", {"name": "B"}, 7]}, {"affiliations": "C"}]}})))
    got = [(r.author_pos, r.node, r.affil_pos, r.name) for r in nested.subtype(nodes, "affiliation").orderBy("author_pos", "affil_pos").collect()]
    assert got == [(0, "primary_text", -1, "P"), (0, "affiliation_text", 0, "A"), (0, "affiliation", 1, "B"), (1, "affiliation_text", 0, "C")]
    assert json.loads(nested.subtype(nodes, "author").where("author_pos = 0").first().extra) == {"affiliations": {"2": 7}}
    assert keys(nested.positions(frame(spark, json.dumps({"submission": {"authors": {"primaryAffiliation": "P"}}})))) == [(0, 0, "author", -1)]


def test_nothing_known_is_lost(spark):
    role = {"credit": {"term": "t", "uri": "u"}}
    aff = {"name": "N", "organisationName": "O", "address": {"city": "C", "street": "S"}, "departments": ["D", {"name": "E", "code": 3}]}
    author = {"primaryEmail": "p", "email": "e", "isSubmittingAuthor": "yes", "isCorrespondingAuthor": None, "primaryAffiliation": 5, "affiliations": [aff, {"address": "here", "departments": "X"}], "roles": [role, "r", {"credit": "c"}]}
    nodes = nested.flatten(frame(spark, json.dumps({"submission": {"authors": [author]}})))
    got = {(r.node, r.affil_pos, r.item_pos): json.loads(r.extra) for r in nodes.where("extra is not null").collect()}
    assert got == {
        ("author", -1, -1): {"isSubmittingAuthor": "yes", "primaryAffiliation": 5, "roles": {"1": "r"}},
        ("affiliation", 0, -1): {"address": {"street": "S"}, "departments": {"0": "D"}},
        ("affiliation", 1, -1): {"address": "here", "departments": "X"},
        ("department", 0, 1): {"code": 3},
        ("role", -1, 0): {"credit": {"uri": "u"}},
        ("role", -1, 2): {"credit": "c"},
    }
