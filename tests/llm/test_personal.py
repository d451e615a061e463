"""Personal information that occurs in no table of the project: held-out sentences of general notation."""

import random
from collections import Counter

import pytest

from evimem.llm import personal

# sentences of ordinary prose with the types of their mentions; no name, number or street of them is in the project's tables
HELD_OUT = [
    ("Yesterday John Smith sent the report to Maria Garcia.", ["name", "name"]),
    ("Emily Johnson and David Lee agreed on the plan.", ["name", "name"]),
    ("Please ask Wei Zhang, Sarah O'Connor or James Brown.", ["name", "name", "name"]),
    ("The note was written by Fatima Khan.", ["name"]),
    ("Olivia Martin lives at 1600 Pennsylvania Avenue NW, Washington, DC 20500.", ["name", "address"]),
    ("Ring +49 30 901820 before noon.", ["phone"]),
    ("Contact: nils dot berglund\nat\nexample dot com", ["email"]),
    ("Dr. Henriksen will call you back on 0171 5556677.", ["name", "phone"]),
    ("My colleague Thorsten Albrecht moved to Bergmannstr. 12, 10961 Berlin last week.", ["name", "address"]),
    ("Send it to peter.jones@firm.co.uk and copy Nkechi Adeyemi.", ["email", "name"]),
    ("The passport no. X1234567 belongs to Ivan Petrov.", ["id_number", "name"]),
    ("Her SSN is 078-05-1120 and her phone is 212-555-0199.", ["id_number", "phone"]),
    ("Call Visual Studio support at the Golden Gate office.", []),
    ("The meeting in New York was moved to Monday March 3.", []),
    ("Version 2.10.33 was built on 2024-05-01 12:00:00 with 12345678 rows.", []),
    ("M. Lindqvist from 12 Elm Street, Springfield approved it.", ["name", "address"]),
    ("Invoice 2024-000-1234 was paid on 12/05/2024.", []),
    ("Regards, Beatrix van der Meer", ["name"]),
    ("Ship to 24 rue Victor Hugo, Lyon or to Via Garibaldi 7, Torino.", ["address", "address"]),
    ("Kontakt: Frau Annegret Vogelsang, Tel. 089 12345678", ["name", "phone"]),
    ("I met Ngozi Balogun on Tuesday.", ["name"]),
    ("Hello Mr Tanaka, the build failed.", ["name"]),
    ("Customer Svetlana Kuznetsova reported the outage; reach Svetlana at svk77@proton.me.", ["name", "email"]),
    ("Tom Okonkwo signed off and so did R. J. Whitfield.", ["name", "name"]),
]
_GIVEN = "Rosalind Torvald Bettina Ottokar Ludmila Caspian".split()
_ROOTS, _ENDS = "Hollen Marsk Brann Ester Quarn Vold Pinter".split(), "dahl by worth sson feldt".split()


def corpus(n: int = 900) -> list[tuple[str, str]]:
    """Notes, one in three with a person whose given name is in no gazetteer."""
    rng = random.Random(8)
    things = "ledger pump valve tarp index router garden mirror bridge kettle".split()
    out = []
    for k in range(n):
        one, two, three = rng.sample(things, 3)
        text = rng.choice([f"The {one} was moved next to the {two} on Monday.", f"Between May and June the {one} grew while the {two} shrank.", f"Blue Harbor is the name of the {one} board.", f"Never paint the {two} before the {three} is dry."])
        if k % 3 == 0:
            name = f"{rng.choice(_GIVEN)} {rng.choice(_ROOTS)}{rng.choice(_ENDS)}"
            text += rng.choice([f" Ask {name} about the {three}.", f" {name} said that the {three} is broken.", f" It was seen by Dr. {name.split()[1]} and {name}."])
        out.append((f"c{k}", text))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(), "id string, text string")
    return personal.model(df, personal.Finder())


def test_held_out_sentences(fitted):
    want, found, wrong = Counter(), Counter(), 0
    for text, kinds in HELD_OUT:
        got = Counter(personal.TYPES[k] for k, _, _ in personal.spans(text, *fitted))
        want.update(kinds)
        for kind, n in got.items():
            found[kind] += min(n, kinds.count(kind))
            wrong += max(0, n - kinds.count(kind))
    assert all(found[k] >= 0.9 * n for k, n in want.items()), (found, want)
    assert wrong <= 2


def test_given_names_are_learned(fitted):
    finder, weights = fitted
    assert {g.lower() for g in _GIVEN} <= finder.learned and not {"blue", "between", "never"} & finder.learned
    # known by now, they are found in small letters and turned around too
    for text, start, end in [("so rosalind marskworth asked for it", 3, 22), ("then Branndahl, Ottokar went home", 5, 23)]:
        assert personal.spans(text, finder, weights) == [(4, start, end)]


def test_whole_mentions(fitted):
    text = "Olivia Martin lives at 1600 Pennsylvania Avenue NW, Washington, DC 20500. Mail nils dot berglund\nat\nexample dot com."
    assert [text[a:b] for _, a, b in personal.spans(text, *fitted)] == ["Olivia Martin", "1600 Pennsylvania Avenue NW, Washington, DC 20500", "nils dot berglund\nat\nexample dot com"]


def test_names_come_from_all_texts(spark):
    """Given names that occur in two of many thousand texts, wherever these lie, are learned (F3: a sample of 12,000 texts missed most of them)."""
    rare = [a + b for a in "Ant Bel Cor Dam Fen".split() for b in "wina orik usta elmo".split()]
    notes = [text for _, text in corpus()] + [f"Pump {k} and valve {k * 7} were moved next to the tarp." for k in range(23_000)]
    notes += [f"Ask {g} {_ROOTS[k % 7]}{_ENDS[(k + m) % 5]} about the kettle." for k, g in enumerate(rare) for m in (0, 1)]
    finder, weights = personal.model(spark.createDataFrame([(x,) for x in notes], "text string"), personal.Finder())
    assert {g.lower() for g in rare} <= finder.learned and not {"pump", "ask", "blue"} & finder.learned
    assert personal.spans("then Hollendahl, Corusta went home", finder, weights) == [(4, 5, 24)]


def test_names_with_a_hyphen_stay_found(spark):
    notes = [text for _, text in corpus(300)] + [f"Ask Torva-Linn {s}sson about the kettle." for s in _ROOTS]
    found = personal.mentions(spark.createDataFrame(list(enumerate(notes)), "id bigint, text string"), "id", ["text"])
    assert {r["mention"] for r in found.where("mention like 'Torva-Linn%'").collect()} == {f"Torva-Linn {s}sson" for s in _ROOTS}


def test_fit_by_tasks_is_the_fit_of_the_driver(spark, monkeypatch):
    texts = spark.createDataFrame(corpus(300), "id string, text string")
    _, one = personal.model(texts, personal.Finder())
    monkeypatch.setattr(personal, "LOCAL", 0)
    rounds = personal._descent
    monkeypatch.setattr(personal, "_descent", lambda gradient: rounds(gradient, 12))
    _, few = personal.model(texts, personal.Finder())
    monkeypatch.setattr(personal, "LOCAL", 10**9)
    assert abs(few - personal.model(texts, personal.Finder())[1]).max() < 1e-6 < abs(few - one).max()


def test_short_words_are_not_learned(spark):
    """Over a whole corpus some "To" stands before two unknown words with a capital; how the corpus writes it tells that it is no name."""
    notes = [text for _, text in corpus(300)] + [f"Send the ledger to pump {k}." for k in range(50)] + ["To Jordoptasi it was clear.", "To Mirfendsa it was not."]
    finder, _ = personal.model(spark.createDataFrame([(x,) for x in notes], "text string"), personal.Finder())
    assert "to" not in finder.learned and "rosalind" in finder.learned
