"""Nested JSON records as flat, typed, related tables (structural-variant tables).

Two automata run over the tree of a record. Bottom up, every value gets a state: a leaf by its type,
an array by the set of its elements' states, an object by its members and their states; states are
shared between equal shapes, so the transition table holds each shape once. Top down, the table
``ROUTES`` takes the subtype of a parent, the member a child hangs on and the sort of the child's
state, and gives the child's subtype. A variant is a subtype in a state. It is compiled once into
what its members become: columns, rows of a child subtype, rows of the table of unknown variants, or
JSON kept beside the row; every object of the variant is then written by that plan. All rows keep
the keys of the common supertype: the record and the positions of their parents. Records are
independent, so the whole operator is one map over the input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import SPACE
from ligature.runtime import spread

#: Supertype keys first, then the union of the subtypes' columns.
NODES = (
    "version_id long, author_pos int, node string, affil_pos int, item_pos int, shape string, "
    "full_name string, first_name string, middle_name string, last_name string, primary_email string, email string, "
    "is_submitting boolean, is_corresponding boolean, name string, organisation string, city string, country_code string, extra string"
)
FIELDS = [f.split()[0] for f in NODES.split(", ")]
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(f.split()[0], ARROW[f.split()[1]]) for f in NODES.split(", ")])
SUBTYPES = {
    "author": ["version_id", "author_pos", "shape", "full_name", "first_name", "middle_name", "last_name", "primary_email", "email", "is_submitting", "is_corresponding", "extra"],
    "affiliation": ["version_id", "author_pos", "node", "affil_pos", "shape", "name", "organisation", "city", "country_code", "extra"],
    "department": ["version_id", "author_pos", "affil_pos", "item_pos", "shape", "name", "extra"],
    "role": ["version_id", "author_pos", "item_pos", "shape", "name", "extra"],
    "other": ["version_id", "author_pos", "node", "affil_pos", "item_pos", "shape", "name", "extra"],
}

#: Sorts of states.
NULL, BOOL, NUMBER, TEXT, ARRAY, OBJECT = "0", "b", "n", "s", "[", "{"
#: Subtype of the parent -> member -> sort of the child's state -> subtype of the child. Elements hang on the member ``[]``.
ROUTES = {
    "record": {"submission": {OBJECT: "submission"}},
    "submission": {"authors": {ARRAY: "authors", OBJECT: "author"}},
    "authors": {"[]": {OBJECT: "author"}},
    "author": {
        "primaryAffiliation": {OBJECT: "primary", TEXT: "primary_text"},
        "affiliations": {ARRAY: "affiliations", OBJECT: "affiliation", TEXT: "affiliation_text"},
        "roles": {ARRAY: "roles", OBJECT: "role"},
    },
    "affiliations": {"[]": {OBJECT: "affiliation", TEXT: "affiliation_text"}},
    "primary": {"departments": {ARRAY: "departments", OBJECT: "department"}, "address": {OBJECT: "address"}},
    "affiliation": {"departments": {ARRAY: "departments", OBJECT: "department"}, "address": {OBJECT: "address"}},
    "departments": {"[]": {OBJECT: "department"}},
    "roles": {"[]": {OBJECT: "role"}},
    "role": {"credit": {OBJECT: "credit"}},
}
#: Subtypes whose columns belong to the parent's row.
INLINE = ("address", "credit")
#: Subtype -> member -> (column, sorts it is taken from); text columns take scalars.
ANY = BOOL + NUMBER + TEXT
PLACE = {"name": ("name", ANY), "organisationName": ("organisation", ANY)}
COLUMNS = {
    "author": {
        "fullName": ("full_name", ANY), "firstName": ("first_name", ANY), "middleName": ("middle_name", ANY), "lastName": ("last_name", ANY), "primaryEmail": ("primary_email", ANY), "email": ("email", ANY),
        "isSubmittingAuthor": ("is_submitting", BOOL), "isCorrespondingAuthor": ("is_corresponding", BOOL),
    },
    "primary": PLACE, "affiliation": PLACE, "department": {"name": ("name", ANY)},
    "address": {"city": ("city", ANY), "countryCode": ("country_code", ANY)}, "credit": {"term": ("name", ANY)},
}
#: The level whose position an element's own position is.
LEVEL = {"authors": "author_pos", "affiliations": "affil_pos", "departments": "item_pos", "roles": "item_pos"}
FIRST = {"author": "author_pos", "affiliation": "affil_pos", "affiliation_text": "affil_pos", "department": "item_pos", "role": "item_pos"}
#: States whose spelling is longer than this are named by a digest.
LONGEST_NAME = 240
#: Shapes kept between records; the table is begun anew beyond it.
KEPT_SHAPES = 100_000

# -- JSON -------------------------------------------------------------------------------------

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
WORDS = {"true": True, "false": False, "null": None}


def number(text: str) -> int | float:
    return int(text) if len(text) < 4000 and not re.search("[.eE]", text) else float(text)


def deep_loads(text: str) -> object:
    """JSON of any depth, without recursion; ValueError if it is broken."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    want, at = "value", 0
    while True:
        m = TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        mark, quoted, plain, word = m.groups()
        if want == "colon":
            if mark != ":":
                raise ValueError(f"no colon at {at}")
            want = "value"
        elif want in ("key", "key or end") and quoted is not None:
            keys[-1], want = json.loads(quoted), "colon"
        elif want == "next" and mark == "," and len(stack) > 1:
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif mark in ("}", "]") and len(stack) > 1 and want in ("next", "key or end", "value or end") and isinstance(stack[-1], dict) == (mark == "}"):
            stack.pop()
            keys.pop()
            want = "next"
        elif want in ("value", "value or end") and mark not in tuple("}],:"):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(quoted) if quoted is not None else number(plain) if plain is not None else WORDS[word]
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
            want = "next"
            if mark:
                stack.append(value)
                keys.append(None)
                want = "key or end" if mark == "{" else "value or end"
        else:
            raise ValueError(f"unexpected text at {at}")
    if len(stack) > 1 or want != "next" or text[at:].strip(" \t\n\r"):
        raise ValueError(f"broken at {at}")
    return root[0]


def deep_dumps(value: object) -> str:
    """The same text as :func:`dumps`, without recursion."""
    out: list[str] = []
    stack: list = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, Written):
            out.append(v)
        elif isinstance(v, dict):
            stack.append(Written("}"))
            for k, (name, x) in reversed(list(enumerate(sorted(v.items(), key=lambda i: i[0])))):
                stack += [x, Written((", " if k else "") + json.dumps(name, ensure_ascii=False) + ": ")]
            stack.append(Written("{"))
        elif isinstance(v, list):
            stack.append(Written("]"))
            for k, x in reversed(list(enumerate(v))):
                stack += [x, Written(", " if k else "")]
            stack.append(Written("["))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class Written(str):
    """Text that is already JSON."""


def loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return deep_loads(text)
    except ValueError as e:
        if "integer string conversion" in str(e):  # numbers of thousands of digits
            return json.loads(text, parse_int=number)
        raise


def dumps(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return deep_dumps(value)


def unwrap(text: str | None) -> object:
    """The JSON in ``text``, through byte-order marks, white space and strings that hold JSON, however often; None if it can't be read.

    Each string is longer than what it holds, so this ends.
    """
    value: object = text
    while isinstance(value, str):
        try:
            value = loads(value.strip(SPACE + "﻿"))
        except ValueError:
            return None
    return value


def text_of(value: object) -> str | None:
    return value if isinstance(value, str) else None if value is None else dumps(value)


# -- The automata -----------------------------------------------------------------------------


class State:
    """A shape: its sort, its name, and the states of its members or elements."""

    __slots__ = ("name", "parts", "plans", "sort")

    def __init__(self, sort: str, name: str, parts: tuple = ()):
        self.sort, self.name, self.parts = sort, name, parts
        self.plans: dict[str, Plan] = {}


LEAVES = {type(None): State(NULL, NULL), bool: State(BOOL, BOOL), int: State(NUMBER, NUMBER), float: State(NUMBER, NUMBER), str: State(TEXT, TEXT)}


class Automaton:
    """The bottom-up automaton: states of the values of one record, and the transitions met so far."""

    def __init__(self) -> None:
        self.transitions: dict[object, State] = {}
        self.named: dict[str, State] = {}
        self.states: dict[int, State] = {}

    def to(self, sort: str, key: object, spelled: str, parts: tuple) -> State:
        name = spelled if len(spelled) <= LONGEST_NAME else "#" + blake2b(spelled.encode("utf-8", "replace"), digest_size=12).hexdigest()
        state = self.named.get(name) or self.named.setdefault(name, State(sort, name, parts))
        self.transitions[key] = state
        return state

    def step(self, value: list | dict) -> State:
        """The transition of an array or object whose parts have states."""
        states = self.states
        if isinstance(value, dict):
            own = tuple([LEAVES.get(type(v)) or states[id(v)] for v in value.values()])
            key: object = (tuple(value), own)
            if (state := self.transitions.get(key)) is not None:
                return state
            parts = tuple(sorted(zip(value, own), key=lambda p: p[0]))
            return self.to(OBJECT, key, "{" + ",".join([f"{k}:{s.name}" for k, s in parts]) + "}", parts)
        key = frozenset([LEAVES.get(type(v)) or states[id(v)] for v in value])
        if (state := self.transitions.get(key)) is not None:
            return state
        parts = tuple(sorted(key, key=lambda s: s.name))
        return self.to(ARRAY, key, "[" + "|".join([s.name for s in parts]) + "]", parts)

    def read(self, value: object) -> State:
        """The state of ``value``; those of its parts stay known until the next record."""
        self.states = {}
        if len(self.transitions) > KEPT_SHAPES:
            self.transitions, self.named = {}, {}
        if type(value) in LEAVES:
            return LEAVES[type(value)]
        stack: list = [(value, False)]
        while stack:
            v, ready = stack.pop()
            if ready:
                self.states[id(v)] = self.step(v)
                continue
            stack.append((v, True))
            stack += [(x, False) for x in (v.values() if isinstance(v, dict) else v) if type(x) not in LEAVES]
        return self.states[id(value)]

    def of(self, value: object) -> State:
        return LEAVES.get(type(value)) or self.states[id(value)]


def state(value: object) -> State:
    """The bottom-up state of one value."""
    return Automaton().read(value)


def holds_objects(shape: State) -> bool:
    """Whether a shape is an object or an array of objects or arrays."""
    return shape.sort == OBJECT or (shape.sort == ARRAY and any(s.sort in (OBJECT, ARRAY) for s in shape.parts))


class Plan:
    """What the members of a variant become."""

    __slots__ = ("children", "columns", "others", "rest")

    def __init__(self, subtype: str, shape: State):
        routes, columns = ROUTES.get(subtype, {}), COLUMNS.get(subtype, {})
        self.columns: list[tuple[str, str]] = []
        self.children: list[tuple[str, str]] = []
        self.others: list[str] = []
        self.rest: list[str] = []
        for member, child in shape.parts:
            if child.sort == NULL:
                continue
            column, sorts = columns.get(member, (None, ""))
            if (to := routes.get(member, {}).get(child.sort)) is not None:
                self.children.append((member, to))
            elif child.sort in sorts:
                self.columns.append((member, column))
            elif member not in routes and holds_objects(child):
                self.others.append(member)
            else:
                self.rest.append(member)


def plan(subtype: str, shape: State) -> Plan:
    """The plan of a variant, compiled when it first comes."""
    return shape.plans.get(subtype) or shape.plans.setdefault(subtype, Plan(subtype, shape))


def write(automaton: Automaton, subtype: str, value: object, keys: dict, all_: bool) -> Iterator[dict]:
    """The rows of one routed value and of what hangs on it; without ``all_`` only keys of authors and affiliations."""
    shape = automaton.of(value)
    if shape.sort == TEXT:
        yield {**keys, "node": subtype, "shape": shape.name, "name": value} if all_ else {**keys, "node": subtype}
        return
    own = plan(subtype, shape)
    row = {**keys, "node": subtype}
    rest: dict = {}
    if all_:
        row["shape"] = shape.name
        for member, column in own.columns:
            v = value[member]
            row[column] = v if column.startswith("is_") else text_of(v)
        rest = {m: value[m] for m in own.rest}
    below: list = []
    for member, to in own.children:
        child = value[member]
        if to in INLINE:
            if all_:
                inner = plan(to, automaton.of(child))
                row.update((c, text_of(child[m])) for m, c in inner.columns)
                if more := {m: child[m] for m in (*inner.rest, *inner.others)}:
                    rest[member] = more
        elif to in LEVEL:
            routes, level = ROUTES[to]["[]"], LEVEL[to]
            stray = {}
            for k, x in enumerate(child):
                sort = automaton.of(x).sort
                if sort in routes:
                    below.append((routes[sort], x, {**keys, level: k}))
                elif sort != NULL:
                    stray[str(k)] = x
            if stray:
                rest[member] = stray
        else:
            below.append((to, child, {**keys, FIRST[to]: 0} if to in FIRST else keys))
    if all_ and rest:
        row["extra"] = dumps(rest)
    yield row
    for to, x, at in below:
        if all_ or to in ("primary", "affiliation"):
            yield from write(automaton, to, x, at, all_)
    if all_:
        for member in own.others:
            yield {**keys, "node": "other", "shape": automaton.of(value[member]).name, "name": f"{subtype}.{member}", "extra": dumps(value[member])}


def beside(automaton: Automaton, subtype: str, value: dict, keys: dict) -> Iterator[dict]:
    """Rows of the objects that no transition takes, and one of what else the object holds."""
    shape = automaton.of(value)
    own = plan(subtype, shape)
    for member in own.others:
        yield {**keys, "node": "other", "shape": automaton.of(value[member]).name, "name": f"{subtype}.{member}", "extra": dumps(value[member])}
    if own.rest:
        yield {**keys, "node": subtype, "shape": shape.name, "extra": dumps({m: value[m] for m in own.rest})}


def nodes_of(version_id: int, model: str | None, automaton: Automaton, all_: bool = True, outer: bool = False) -> Iterator[dict]:
    """The rows of one record, routed from its root; with ``outer`` also what lies beside the authors."""
    root = unwrap(model)
    if isinstance(root, dict) and isinstance(root.get("submission"), str):
        root["submission"] = unwrap(root["submission"])
    keys = {"version_id": version_id, "author_pos": -1, "affil_pos": -1, "item_pos": -1}
    whole = automaton.read(root)
    if whole.sort != OBJECT:
        return
    if outer:
        yield from beside(automaton, "record", root, keys)
    for member, to in plan("record", whole).children:
        if outer:
            yield from beside(automaton, to, root[member], keys)
        for name, below in plan(to, automaton.of(root[member])).children:
            value = root[member][name]
            if below == "author":
                yield from write(automaton, below, value, {**keys, "author_pos": 0}, all_)
                continue
            routes = ROUTES[below]["[]"]
            for k, x in enumerate(value):
                if (author := routes.get(automaton.of(x).sort)) is not None:
                    yield from write(automaton, author, x, {**keys, "author_pos": k}, all_)


# -- The operator -----------------------------------------------------------------------------


def column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in values], kind)


def mapped(models: DataFrame, id_col: str, model_col: str, fields: list[str], all_: bool, outer: bool = False) -> DataFrame:
    schema = pa.schema([SCHEMA.field(f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            columns: dict[str, list] = {f: [] for f in fields}
            adders = [(f, columns[f].append) for f in fields]
            for vid, model in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in nodes_of(vid, model, automaton, all_, outer):
                    for f, add in adders:
                        add(row.get(f))
            yield pa.RecordBatch.from_arrays([column(columns[f], schema.field(f).type) for f in fields], schema=schema)

    source = models.where(F.col(id_col).isNotNull() & F.col(model_col).isNotNull()).select(F.col(id_col).cast("long").alias("version_id"), F.col(model_col).alias("model"))
    kinds = dict(f.split() for f in NODES.split(", "))
    return spread(source).mapInArrow(run, ", ".join(f"{f} {kinds[f]}" for f in fields))


def flatten(models: DataFrame, id_col: str = "id", model_col: str = "resource_model", outer: bool = False) -> DataFrame:
    """The supertype table: one row per author, affiliation, department and role object of each distinct id.

    ``author_pos``, ``affil_pos`` and ``item_pos`` are positions in the parent's array from 0, null
    elements counted, -1 where the level doesn't apply; an object where an array is expected is an
    array of one. An affiliation that is a plain string is a row ``primary_text`` or ``affiliation_text`` with
    the string as its name. Objects, and arrays that hold objects, under a member that no variant knows are rows
    ``other`` with ``subtype.member`` as their name and their JSON in ``extra``; in other rows ``extra`` keeps what
    neither a column nor a row takes over, so nothing below an author is lost. With ``outer`` the same holds for the record and its submission. ``shape`` is the state of the
    object. Null, empty or broken JSON, a null id and non-object elements of ``authors`` give no rows; rows
    repeated with the same id and content give their rows once more (the subtypes drop them). Records may be
    nested and wrapped to any depth. Columns other than the two named are ignored.
    """
    return mapped(models, id_col, model_col, FIELDS, True, outer)


def positions(models: DataFrame, id_col: str = "id", model_col: str = "resource_model") -> DataFrame:
    """Distinct ``(version_id, author_pos, node, affil_pos)`` of the author and affiliation nodes: :func:`flatten` without what this doesn't need."""
    return mapped(models, id_col, model_col, ["version_id", "author_pos", "node", "affil_pos"], False).distinct()


def subtype(nodes: DataFrame, kind: str) -> DataFrame:
    """One typed table of :func:`flatten`'s rows: ``author``, ``affiliation`` (primary ones and plain strings too), ``department``, ``role`` or ``other``."""
    kinds = ["primary", "affiliation", "primary_text", "affiliation_text"] if kind == "affiliation" else [kind]
    return nodes.where(F.col("node").isin(kinds)).select(*SUBTYPES[kind]).distinct()
