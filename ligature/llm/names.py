"""Variant spellings of people and institutions, linked through canonical rewritings.

Every distinct spelling is rewritten in every way the rules allow: accents and case folded, token order
as typed and, where nothing tells it, turned round, titles and legal forms dropped, abbreviations, other
languages' words, nicknames and initials expanded. What the rules leave (places, family and given names)
is also rewritten to its forms with one letter left out. The rewritings are exploded and equi-joined: spellings
that share one are candidates. Rewritings are weighed by their rarity: a typing error follows the commonest
spelling it shares a form with only if it is rare beside it, a reading or a formal name wins by what supports
it in its institution, and a rewriting links only if so many chance bearers of it are not to be expected there.
Joins are on forms of distinct spellings, stars to one head per form, never pairs within a form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import is_blank
from ligature.runtime import cut, join_counted

# Letters that don't decompose.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i"})
# Kinds of institutions in English and other languages, with their usual abbreviations.
ORG_WORDS = {
    "university": "university univ u universitat universitaet universite universidad universidade universita universiteit uni",
    "technology": "technology technical technological technische technique tecnica technol tech",
    "university technology": "tu",
    "institute": "institute institut instituto istituto inst",
    "hospital": "hospital hosp klinik clinic",
    "college": "college coll",
    "school": "school sch",
    "centre": "centre center zentrum centro ctr",
    "academy": "academy acad akademie",
    "laboratory": "laboratory laboratories lab labs",
    "observatory": "observatory obs",
    "museum": "museum mus",
    "society": "society soc",
    "general": "general gen",
    "national": "national natl nat",
    "international": "international intl",
    "research": "research res",
    "public": "public publ",
    "applied": "applied appl",
}
# Usual abbreviations of the names of disciplines.
DISCIPLINES = {
    "agriculture": "agriculture agricultural agric",
    "anthropology": "anthropology anthropol",
    "astronomy": "astronomy astron",
    "biochemistry": "biochemistry biochem",
    "biology": "biology biol biological",
    "botany": "botany bot",
    "chemistry": "chemistry chem chemical",
    "computing": "computing computational comput comp",
    "ecology": "ecology ecol ecological",
    "economics": "economics econ economic",
    "education": "education educ",
    "engineering": "engineering eng engn",
    "environment": "environment environmental environ",
    "genetics": "genetics genet",
    "geography": "geography geogr",
    "geology": "geology geol geological",
    "history": "history hist",
    "linguistics": "linguistics linguist ling",
    "marine": "marine mar",
    "mathematics": "mathematics mathematical math",
    "mechanics": "mechanics mech mechanical",
    "medicine": "medicine medical med",
    "molecular": "molecular mol",
    "neurology": "neurology neurol",
    "nuclear": "nuclear nucl",
    "oceanography": "oceanography oceanogr",
    "pharmacology": "pharmacology pharmacol",
    "philosophy": "philosophy philos",
    "physics": "physics phys",
    "physiology": "physiology physiol",
    "politics": "politics political polit",
    "psychology": "psychology psychol",
    "science": "science sciences scientific sci",
    "sociology": "sociology sociol",
    "statistics": "statistics stat",
    "surgery": "surgery surg",
    "theoretical": "theoretical theor",
    "veterinary": "veterinary vet",
    "zoology": "zoology zool",
}
LEGAL = set("ltd limited inc incorporated gmbh ag llc corp corporation co company plc sa srl bv".split())
SMALL = set("of the for de del der die des du la le at in and und et y e a an".split())
DEPARTMENT = "department dept dep division div faculty fac section unit laboratory".split()
# Nicknames and the names they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "xander": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "chris": "christopher christine christian", "kit": "christopher", "dan": "daniel", "danny": "daniel",
    "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dima": "dmitri", "ed": "edward", "eddie": "edward", "ted": "theodore edward", "ned": "edward", "katya": "ekaterina", "liz": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "paco": "francisco", "pancho": "francisco",
    "fred": "frederick", "freddy": "frederick", "greg": "gregory", "lupe": "guadalupe", "lupita": "guadalupe", "heinz": "heinrich", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "hans": "johannes", "jo": "joseph johanna", "joe": "joseph", "joey": "joseph", "pepe": "jose", "jurgen": "jurgen",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kat": "katherine", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "marge": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael", "misha": "mikhail", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "pasha": "pavel", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "richie": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "robbie": "robert", "sam": "samuel", "sammy": "samuel", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "theo": "theodore", "tom": "thomas", "tommy": "thomas",
    "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "zach": "zachary", "steve": "steven stephen", "dave": "david", "matt": "matthew", "jeff": "jeffrey", "larry": "lawrence", "ray": "raymond", "ron": "ronald", "don": "donald", "ken": "kenneth",
}
TITLES = set("dr prof professor phd md msc bsc ma ms mr mrs mx sir jr sr ii iii dphil mph mba".split())
TOKEN_OF = {form: word for words in (ORG_WORDS, DISCIPLINES) for word, forms in words.items() for form in forms.split()}
#: A spelling follows a commoner one if it has at most this share of its uses, plus a few.
RARE_SHARE, RARE_PLUS = 0.2, 2
#: The same for family names, which are compared within one institution only and then with the given name.
RARE_PLUS_FAMILY = 10
#: Words up to this length are joined on their forms with one letter left out, longer ones on their halves.
LONGEST = 128
#: Chance bearers of a rewriting that may be expected in an institution if it is to link.
MOST_EXPECTED = 1.0
#: Bearers of other names assumed beside those seen elsewhere, so that a few institutions prove nothing.
PRIOR = 1000
#: Members of an entity that meet in one block.
BLOCK = 1000


def fold(text: str) -> str:
    """Without accents; compatibility forms resolved."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(LETTERS)) if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b, or they are equal."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def leave_one_out(word: str) -> list[str]:
    """The word and its forms with one letter left out."""
    return list(dict.fromkeys([word, *(word[:k] + word[k + 1 :] for k in range(len(word)))]))


@lru_cache(None)
def near_words() -> dict[str, list[str]]:
    """The forms, of those long enough to hold an error, that share one with a letter left out."""
    out: dict[str, list[str]] = {}
    for form in TOKEN_OF:
        if len(form) >= (4 if form in ("univ", "coll", "hosp", "inst", "tech") else 5):
            for x in leave_one_out(form):
                out.setdefault(x, []).append(form)
    return out


@lru_cache(200_000)
def org_word(token: str) -> str | None:
    """What a word of an institution stands for; a long enough one may hold one error, in doubt that of the first such word."""
    if token in TOKEN_OF:
        return TOKEN_OF[token]
    if 3 <= len(token) <= LONGEST:
        near = {form for x in leave_one_out(token) for form in near_words().get(x, ()) if one_edit(token, form)}
        return next((word for form, word in TOKEN_OF.items() if form in near), None) if near else None
    return None


def org_form(org: str) -> tuple[str, str]:
    """``(kind, place)``: the sorted kind words and the sorted other words of an institution, without departments and legal forms.

    Where these leave nothing at all, all words are the place.
    """
    text = fold(org).lower()
    parts = []
    for part in re.split(r"[,;()/|]+", text):
        tokens = re.findall(r"[^\W_]+", part)
        if not tokens or (len(tokens) > 1 and any(tokens[0] == d or (len(d) > 4 and one_edit(tokens[0], d)) for d in DEPARTMENT)):
            continue
        parts.append(tokens)
    kinds, places = set(), []
    for token in (t for tokens in parts for t in tokens):
        if token in SMALL or token in LEGAL:
            continue
        word = org_word(token)
        if word:
            kinds.update(word.split())
        elif not any(one_edit(token, p) for p in places):
            places.append(token)
    if any(len(p) > 2 for p in places):  # what is left of a mistyped small word isn't a place
        places = [p for p in places if len(p) > 2]
    if not kinds and not places:
        places = re.findall(r"[^\W_]+", text)
    return " ".join(sorted(kinds)), " ".join(sorted(places))


def readings(name: str) -> list[tuple[str, str, str, str]]:
    """``(family, given, initial, middle)`` of a name under each order of its parts that it allows, the likelier first; given is empty if only its initial is known.

    Before a comma, in capitals or before trailing initials stands the family name. Else nothing tells the order: it
    is last as a rule, and first if the parts were turned round.
    """
    text = re.sub(r"\"[^\"]*\"|“[^”]*”|\([^)]*\)", " ", fold(name))
    parts = [[t for t in re.findall(r"[^\W\d_]+", p) if t.lower() not in TITLES or (len(t) == 2 and t.isupper() and t.lower() not in ("dr", "md", "ms"))] for p in text.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return []
    initials = lambda t: len(t) <= 2 and t.isupper()
    if len(parts) > 1:
        orders = [(parts[0], [t for p in parts[1:] for t in p])]
    else:
        tokens = parts[0]
        if len(tokens) == 1:
            return []
        if initials(tokens[-1]) and not initials(tokens[0]):
            k = next(i for i, t in enumerate(tokens) if i and initials(t))
            # "Family G", "Family GM" and "Family G M"; "Given M Family" has a longer last word.
            orders = [(tokens[:k], tokens[k:])]
        elif tokens[0].isupper() and len(tokens[0]) > 2 and not all(t.isupper() for t in tokens):
            orders = [(tokens[:1], tokens[1:])]
        else:
            orders = [(tokens[-1:], tokens[:-1])]
            if len(tokens[0]) > 1 and not initials(tokens[0]):
                orders.append((tokens[:1], tokens[1:]))
    return [read(family, rest) for family, rest in orders if rest]


def read(family: list[str], rest: list[str]) -> tuple[str, str, str, str]:
    """One reading, folded."""
    name = "".join(family).lower()
    if len(name) > 4:  # accents written out
        name = re.sub("([aou])e", r"\1", name)
    if len(rest[0]) <= 2 and rest[0].isupper():
        letters = "".join(rest)
        return name, "", letters[0].lower(), letters[1:2].lower()
    first, others = rest[0].lower(), rest[1:]
    middle = others[0][0].lower() if others else ""
    return (name, "", first, middle) if len(first) == 1 else (name, first, first[0], middle)


def org_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [org_form(o) for o in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), batch.column(1)], names=["org", "kind", "place", "n"])


def person_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(inst, name, n)`` to one row per reading; ``turned`` is 1 for the order that is not the rule."""
    for batch in batches:
        found = [readings(x) for x in batch.column(1).to_pylist()]
        at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
        cols = list(zip(*(x for f in found for x in f))) or [()] * 4
        turned = pa.array([k for f in found for k in range(len(f))], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), turned, *(pa.array(c, pa.string()) for c in cols)], names=["inst", "name", "n", "turned", "family", "given", "initial", "middle"])


def one_error(a: str, b: str) -> bool:
    """Whether one edit turns a into b, or one edit of one of their tokens, whatever the tokens' order."""
    if one_edit(a, b):
        return True
    left, right = Counter(a.split(" ")), Counter(b.split(" "))
    only = [*(left - right).elements()], [*(right - left).elements()]
    return len(only[0]) == len(only[1]) == 1 and one_edit(only[0][0], only[1][0])


def edit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows whose last two columns (spelling, head) are one error apart."""
    for batch in batches:
        a, b = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        yield batch.filter(pa.array([one_error(x, y) for x, y in zip(a, b)], pa.bool_()))


def error_forms(word) -> Column:
    """Hashes of the forms that two words one edit apart share: with one letter left out, or for long words their halves.

    An edit, or a swap of neighbours, leaves one of two pieces from either end alone. The pieces' length is a
    power of two that a word of one letter more or less has among its own.
    """
    out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.xxhash64(F.concat(word.substr(F.lit(1), k - 1), word.substr(k + 1, F.length(word)))))
    size = lambda n: F.pow(F.lit(2), F.floor(F.log2((n / 2).cast("double")))).cast("int")
    halves = lambda h: F.array(F.xxhash64(F.lit("left"), word.substr(F.lit(1), h)), F.xxhash64(F.lit("right"), word.substr(F.length(word) - h + 1, h)))
    long = F.concat(halves(size(F.length(word))), halves(size(F.length(word) - 1)))
    short = F.concat(F.array(F.xxhash64(word)), out)
    # Of several tokens each is spelled with one letter left out beside the others, which stand in order.
    tokens = F.split(word, " ")
    beside = lambda k: F.array_join(F.array_sort(F.filter(tokens, lambda x, i: i != k)), " ")
    shortened = lambda t, k: F.transform(F.sequence(F.lit(1), F.length(t)), lambda j: F.xxhash64(F.lit("token"), beside(k), F.concat(t.substr(F.lit(1), j - 1), t.substr(j + 1, F.length(t)))))
    each = F.flatten(F.transform(tokens, lambda t, k: F.concat(F.array(F.xxhash64(F.lit("token"), beside(k), t)), F.when(F.length(t).between(1, LONGEST), shortened(t, k)).otherwise(F.array().cast("array<bigint>")))))
    short = F.concat(short, F.when((F.size(tokens) > 1) & (F.length(word) <= LONGEST + 1), each).otherwise(F.array().cast("array<bigint>")))
    # Words around the limit have both, so that they meet those on its other side.
    return F.array_distinct(F.when(F.length(word) < LONGEST, short).when(F.length(word) <= LONGEST + 1, F.concat(short, long)).otherwise(long))


def heads(words: DataFrame, scope: list[str], all_of_them: bool = False, plus: int = RARE_PLUS) -> DataFrame:
    """``(scope, word, head)`` of the rare spellings among ``(scope, word, n)`` that follow a commoner one, one edit away.

    All forms are exploded (as hashes) and joined; of the commoner spellings one edit away the commonest wins, or all
    are kept. Distinct spellings of one form differ in one letter, so they are few. Single letters follow nobody.
    """
    forms = words.where(F.length("word") >= 2).select(*scope, "word", "n", F.explode(error_forms(F.col("word"))).alias("form"))
    shared = cut(forms.join(forms.groupBy(*scope, "form").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c"), [*scope, "form"]))
    other = shared.select(*scope, "form", F.col("word").alias("head"), F.col("n").alias("head_n"))
    commoner = F.struct(F.col("head_n").alias("n"), F.col("head").alias("word")) > F.struct("n", "word")
    follows = shared.join(other, [*scope, "form"]).where(commoner & (F.col("n") <= F.col("head_n") * RARE_SHARE + plus)).select(*scope, "n", "head_n", "word", "head").distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in follows.schema)
    near = follows.mapInArrow(edit_pairs, schema)
    if all_of_them:
        return near.select(*scope, "word", "head")
    return near.groupBy(*scope, "word").agg(F.max(F.struct("head_n", "head")).alias("_b")).select(*scope, "word", F.col("_b.head").alias("head"))


def rooted(words: DataFrame, scope: list[str], plus: int = RARE_PLUS) -> DataFrame:
    """``(scope, word, root)`` of every spelling: itself, or the last of the heads that follow one another from it.

    Heads are ever commoner, so there are no circles; each round doubles the steps taken.
    """
    words = cut(words)
    links = cut(heads(words, scope, plus=plus))
    while True:
        next_ = links.select(*scope, F.col("word").alias("head"), F.col("head").alias("head2"))
        links = cut(links.join(next_, [*scope, "head"], "left").select(*scope, "word", F.coalesce("head2", "head").alias("head"), F.col("head2").isNotNull().alias("moved")))
        if not links.where("moved").take(1):
            break
        links = links.drop("moved")
    return words.join(links, [*scope, "word"], "left").select(*scope, "word", F.coalesce("head", "word").alias("root"))


def institutions(orgs: DataFrame) -> DataFrame:
    """``(org, inst)`` of the distinct spellings ``(org, n)``; its kind words where no place is left, null for a single kind word, which names none, or no word."""
    forms = cut(orgs.mapInArrow(org_forms, "org string, kind string, place string, n long"))
    roots = rooted(forms.where("place <> ''").groupBy(F.col("place").alias("word")).agg(F.sum("n").alias("n")), [])
    return forms.join(roots, forms.place == roots.word, "left").select("org", F.when(F.col("kind").contains(" ") | (F.col("place") != ""), F.concat_ws("|", "kind", F.coalesce("root", F.lit("")))).alias("inst"))


def ordered(forms: DataFrame) -> DataFrame:
    """One reading per ``(inst, name)`` of all readings: the rule's, unless only the turned one is somebody else's name there.

    A reading is supported by the names of the institution that read the same as a rule, given names through their
    nicknames. An order gives way to the turned one if that has more support, or as much and its
    given name is the commoner one as such.
    """
    rows = forms.withColumn("first", F.coalesce(nicknames()[F.col("given")][0], F.col("given")))
    rule = rows.where("turned = 0 and given <> ''")
    known = rule.groupBy("inst", "family", "first").agg(F.sum("n").alias("support"))
    common = rule.groupBy("first").agg(F.sum("n").alias("as_given"))
    doubtful = rows.where("turned = 1").select("inst", "name").distinct()
    told = rows.join(doubtful, ["inst", "name"], "left_semi").join(known, ["inst", "family", "first"], "left").join(common, "first", "left")
    of = lambda turned, c: F.coalesce(F.max(F.when(F.col("turned") == turned, F.col(c))), F.lit(0))
    both = told.groupBy("inst", "name").agg(of(0, "support").alias("typed"), of(1, "support").alias("turns"), of(0, "as_given").alias("typed_given"), of(1, "as_given").alias("turns_given"))
    gives_way = (F.col("turns") > F.col("typed")) | ((F.col("turns") == F.col("typed")) & (F.col("turns_given") > F.col("typed_given")))
    turn = both.where(gives_way & (F.col("turns") > 0)).select("inst", "name", F.lit(1).alias("turn"))
    return forms.join(turn, ["inst", "name"], "left").where(F.col("turned") == F.coalesce("turn", F.lit(0))).drop("turned", "turn")


def nicknames() -> Column:
    return F.create_map(*(x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))


def persons(names: DataFrame) -> DataFrame:
    """``(inst, name, person, score)`` of the distinct ``(inst, name, n)``; person is null where a name can't be told apart.

    Within an institution a family name follows its commoner spelling; a given name stands for the
    formal name that is best supported there among those its nickname or typing error allows; an
    initial stands for the only formal name with it, if need be with the same middle initial. ``score`` is the rarity
    of the rewriting a name is linked by: the negative logarithm of the bearers of it that chance puts into
    an institution of that size, as often as it occurs in the others. Below that of ``MOST_EXPECTED`` a name
    written with an initial links to nobody.
    """
    forms = names.mapInArrow(person_forms, "inst string, name string, n long, turned int, family string, given string, initial string, middle string")
    forms = cut(ordered(cut(forms)))
    roots = rooted(forms.groupBy("inst", F.col("family").alias("word")).agg(F.sum("n").alias("n")), ["inst"], RARE_PLUS_FAMILY).withColumnRenamed("word", "family")
    forms = cut(forms.join(roots, ["inst", "family"]).select("inst", "name", "n", F.col("root").alias("family"), "given", "initial", "middle"))
    # Formal names of a given name: through nicknames, and through the commoner names it may be an error for.
    given = cut(forms.where("given <> ''").groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("n")))
    stands = lambda c: F.coalesce(nicknames()[F.col(c)], F.array(F.col(c)))
    formal = given.select(F.col("word").alias("given"), F.explode(stands("word")).alias("formal"), F.lit(1).alias("plain")).unionByName(heads(given, [], all_of_them=True).select(F.col("word").alias("given"), F.explode(stands("head")).alias("formal"), F.lit(0).alias("plain"))).groupBy("given", "formal").agg(F.max("plain").alias("plain"))
    options = forms.where("given <> ''").join(formal, "given")
    support = options.groupBy("inst", "family", "formal").agg(F.sum("n").alias("support"), F.sum(F.col("n") * F.col("plain")).alias("typed"))
    choice = cut(options.join(support, ["inst", "family", "formal"]).groupBy("inst", "name", "n", "family", "middle").agg(F.max(F.struct("support", "typed", "plain", "formal")).alias("_b")).select("inst", "name", "n", "family", "middle", F.col("_b.formal").alias("formal")))
    short = forms.where("given = ''")
    own = choice.select("inst", "family", F.substring("formal", 1, 1).alias("initial"), "formal", "middle")
    by_initial = own.groupBy("inst", "family", "initial").agg(F.min("formal").alias("lo"), F.max("formal").alias("hi"))
    by_middle = own.where("middle <> ''").groupBy("inst", "family", "initial", "middle").agg(F.min("formal").alias("mlo"), F.max("formal").alias("mhi"))
    told = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("mlo") == F.col("mhi"), F.col("mlo")).when(F.col("lo").isNull(), F.concat(F.col("initial"), F.lit(".")))
    initials = short.join(by_initial, ["inst", "family", "initial"], "left").join(by_middle, ["inst", "family", "initial", "middle"], "left").select("inst", "name", "n", "family", told.alias("formal"), F.col("initial").alias("rewriting"))
    both = cut(choice.select("inst", "name", "n", "family", "formal", F.col("formal").alias("rewriting")).unionByName(initials))
    # Bearers of a rewriting, a full name bears its initial too, here and everywhere; its share of the other institutions is what chance gives here.
    totals = both.groupBy("inst").agg(F.sum("n").alias("here"))
    everywhere = totals.agg(F.sum("here")).first()[0] or 0
    bears = F.array_distinct(F.array(F.col("rewriting"), F.substring("rewriting", 1, 1)))
    formed = both.select("inst", "family", "n", F.explode(bears).alias("rewriting")).groupBy("inst", "family", "rewriting").agg(F.sum("n").alias("n_here"))
    common = formed.groupBy("family", "rewriting").agg(F.sum("n_here").alias("n_all"))
    # Half a bearer is added, so that the logarithm is finite.
    share = lambda n: n / (F.lit(everywhere) - F.col("here") + PRIOR) * F.col("here")
    elsewhere = F.col("n_all") - F.col("n_here")
    scores = formed.join(common, ["family", "rewriting"]).join(totals, "inst").select("inst", "family", "rewriting", share(elsewhere).alias("expected"), (-F.log(share(elsewhere + 0.5))).alias("score"))
    scored = both.join(scores, ["inst", "family", "rewriting"])
    links = F.col("formal").isNotNull() & ((F.col("rewriting") == F.col("formal")) | (F.col("expected") <= MOST_EXPECTED))
    return scored.select("inst", "name", F.when(links, F.concat_ws("|", "inst", "family", "formal")).alias("person"), "score")


def variants(articles: DataFrame, id_col: str = "article_id", name_col: str = "author_name", org_col: str = "author_org") -> tuple[DataFrame, DataFrame]:
    """``(org, inst)`` of every distinct institution string and ``(id, name, inst, person, score)`` of every article.

    Blank institutions and those that hold an e-mail address don't count, nor do blank names; a row with a null
    id only adds its institution; repeated rows count once. An empty table gives no rows.
    """
    rows = articles.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.col(org_col).alias("org")).distinct()
    rows = rows.where(~is_blank(F.col("org")) & ~F.col("org").contains("@"))
    rows = cut(rows)
    inst = cut(institutions(rows.groupBy("org").agg(F.count("*").alias("n"))))
    named = rows.where(F.col("id").isNotNull() & ~is_blank(F.col("name"))).join(inst.where("inst is not null"), "org")
    people = persons(named.groupBy("inst", "name").agg(F.count("*").alias("n")))
    return inst, cut(named.join(people, ["inst", "name"]).select("id", "name", "inst", "person", "score"))


def block_pairs(rows: DataFrame, entity: str, member: str, block: int = BLOCK) -> DataFrame:
    """Pairs of members of one entity, ``left_*`` and ``right_*`` of all columns, left member smaller.

    An entity of n members is cut into b blocks of about ``block``; block i meets block j in a cell of its own, so
    that no task gets a large entity: a member is sent b times, to meet n others.
    """
    rows = cut(rows.where(F.col(entity).isNotNull()))
    sizes = rows.groupBy(entity).agg(F.count("*").alias("n")).where("n > 1")
    b = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("_b").cast("long")).cast("int")
    placed = join_counted(rows, sizes, [entity], rows.count()).withColumn("_b", b).withColumn("_own", own)
    cells = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: F.least("_own", j) * F.col("_b") + F.greatest("_own", j))
    spread = placed.withColumn("_home", F.col("_own") * F.col("_b") + F.col("_own")).select(*rows.columns, "_own", "_home", F.explode(cells).alias("_cell"))
    left = spread.select(F.col(entity), "_cell", F.col("_own").alias("_i"), "_home", *(F.col(c).alias(f"left_{c}") for c in rows.columns if c != entity))
    right = spread.select(F.col(entity), "_cell", F.col("_own").alias("_j"), *(F.col(c).alias(f"right_{c}") for c in rows.columns if c != entity))
    # Two members of one block meet in its own cell only.
    meet = (F.col("_i") != F.col("_j")) | (F.col("_cell") == F.col("_home"))
    return left.join(right, [entity, "_cell"]).where(meet & (F.col(f"left_{member}") < F.col(f"right_{member}")))


def linked(inst: DataFrame, people: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(entity_kind, left_key, right_key)`` of all links: org strings of one institution, articles of one person.

    These are the pairs within the entities of :func:`rarity`, spelled out; a large entity is met block by block.
    """
    key = lambda kind, a, b: (F.lit(kind).alias("entity_kind"), F.col(a).cast("string").alias("left_key"), F.col(b).cast("string").alias("right_key"))
    orgs = block_pairs(inst.select("inst", "org"), "inst", "org", block).select(*key("org", "left_org", "right_org"))
    pairs = block_pairs(people.select("person", "id", "name"), "person", "id", block).where("left_name <> right_name").select(*key("person", "left_id", "right_id"))
    return orgs.unionByName(pairs)


def rarity(inst: DataFrame, people: DataFrame) -> DataFrame:
    """``(entity_kind, member_key, entity, links, score)`` of every linked spelling or article: the entity it belongs to, the number of its links there, and the rarity of the rewriting it is linked by.

    For an institution the score is the logarithm of all spellings over those that share the rewriting. What links alone is left out.
    """
    total = float(inst.count() or 1)
    sizes = inst.where("inst is not null").groupBy("inst").agg(F.count("*").alias("size")).where("size > 1")
    orgs = inst.join(sizes, "inst").select(F.lit("org").alias("entity_kind"), F.col("org").alias("member_key"), F.col("inst").alias("entity"), (F.col("size") - 1).alias("links"), F.log(F.lit(total) / F.col("size")).alias("score"))
    own = people.where("person is not null")
    names = own.groupBy("person", "name").agg(F.count("*").alias("same"))
    size = names.groupBy("person").agg(F.sum("same").alias("size"))
    counted = names.join(size, "person").where("size > same").select("person", "name", (F.col("size") - F.col("same")).alias("links"))
    persons_ = own.join(counted, ["person", "name"]).select(F.lit("person").alias("entity_kind"), F.col("id").cast("string").alias("member_key"), F.col("person").alias("entity"), "links", "score")
    return orgs.unionByName(persons_)
