import random

import numpy as np

from shuffleframe.llm import decontaminate as D
from shuffleframe.llm import queries

ITEM = "Anna has 12 apples and gives 5 apples to Bert before lunch. How many apples does Anna have left after she walks 3 km home?"


def names_of(rows):
    return {(r.doc_id, r.item_id) for r in rows}


def run(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return D.contaminated(d, spark.createDataFrame(list(items), "item_id long, text string")).collect()


def filler(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 7))) for _ in range(n))


def test_template_words():
    hashes, kinds, plain, state = D.template("Dr. 3 km and Bert, -- 7% (12) km. Km the".split())
    assert kinds.tolist() == [0, D.NUMBER, D.UNIT, 0, D.NAME, D.NUMBER, D.NUMBER, D.UNIT, 0, 0]
    assert state == (False, False) and len(set(hashes[kinds == D.NUMBER])) == 1 and len(set(plain[kinds == D.NUMBER])) == 3


def test_exact_and_reparameterised(spark):
    other = ITEM.replace("Anna", "Carla").replace("Bert", "Dieter").replace("12", "40").replace("5", "17").replace("3", "9")
    wrong = "Anna has 12 apples and gives 5 apples to Bert before lunch. How many apples does Zoe have left after she walks 3 km home?"
    docs = [
        (1, f"{filler(1)} {ITEM} {filler(2)}"),
        (2, f"{filler(3)}. {other} {filler(4)}"),
        (3, f"{filler(5)} {wrong}"),
        (4, filler(6, 500)),
        (5, None),
        (6, ""),
        (None, ITEM),
        (7, ITEM.lower().replace("anna", "Anna").replace("bert", "Bert")),
        (8, f"{filler(7, 120_000)} {ITEM}"),
        (1, f"{filler(1)} {ITEM} {filler(2)}"),
    ]
    rows = run(spark, docs, [(1, ITEM), (2, ITEM), (3, None), (4, " "), (None, ITEM), (5, "Five words are not much.")])
    assert names_of(rows) == {(d, i) for d in (1, 2, 7, 8) for i in (1, 2)}
    assert {r.doc_id: r.reparameterised for r in rows} == {1: False, 2: True, 7: False, 8: False}
    assert len(rows) == 8
    assert run(spark, [(1, f"{filler(8)} five words are NOT much, {filler(9)}")], [(5, "Five words are not much.")])[0].windows == 1
    assert run(spark, docs[:1], [(3, None)]) == []
    assert D.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() == []


def test_number_tables_match_only_exactly(spark):
    item = "1 2 3 4 5 6 7 8 9 10"
    assert names_of(run(spark, [(1, f"x {item} y"), (2, "x 11 12 13 14 15 16 17 18 19 20 y")], [(1, item)])) == {(1, 1)}


def test_names_that_begin_sentences_and_dense_windows(spark):
    """Re-parameterised: names that only begin sentences, and windows with more slots than other words; wrong where a word stands for two."""
    names, dense = "Tom has 5 apples. Tom buys 3 more. Tom eats 2 apples today.", "If Tom pays 5 dollars and Anna pays 7 dollars, Bob 9 dollars"
    other = names.replace("Tom", "Bob").replace("5", "8")
    docs = [
        (1, f"{filler(20)}. {other} {filler(21)}"),
        (2, f"{filler(22)}. {dense.replace('Tom', 'Eva').replace('Anna', 'Karl').replace('Bob', 'Mia').replace('5', '11').replace('7', '13').replace('9', '17')} {filler(23)}"),
        (3, f"{filler(24)}. {other.replace('Bob eats', 'Eva eats').replace('Bob buys', 'Mia buys')} {filler(25)}"),
        (4, f"{filler(26)}. {names} {filler(27)} {dense}"),
        (5, "Eva has 4 pears. Karl sells 3 more. Mia wants 6 plums now. If 5 dollars and 7 dollars, 9 dollars"),
    ]
    rows = run(spark, docs, [(1, names), (2, dense), (3, "Tom has 5")])
    assert {(r.doc_id, r.item_id): r.reparameterised for r in rows if r.item_id < 3} == {(1, 1): True, (2, 2): True, (4, 1): False, (4, 2): False}
    assert {r.doc_id for r in rows if r.item_id == 3} == {4}  # too few other words to tell


def test_pieces_are_like_the_whole(monkeypatch):
    text = f"{filler(10, 300)} {ITEM} 5 km. {filler(11, 100)}"
    whole = D.template(text.split())
    h = D.template_windows(*whole[:3], 8)
    monkeypatch.setattr(D, "PIECE", 41)
    got = {}
    for base, *parts in D._pieces(text, 7):
        got |= {base + i: x for i, x in enumerate(D.template_windows(*parts, 8).tolist())}
    assert [got[i] for i in range(len(h))] == h.tolist()


def test_against_brute_force(spark):
    """Every document that holds an item's text word for word is found, and only those."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    norm = lambda t: " ".join(w for w in (x.strip(D._STRIP).lower() for x in t.split()) if w)
    plain = {r.doc_id: f" {norm(r.text)} " for r in docs}
    want = {(d, r.item_id) for r in items for d, t in plain.items() if f" {norm(r.text)} " in t}
    got = names_of(queries.op9_decontaminate(spark, "/root/testdata/sf0.01").collect())
    assert len(want) >= 20 and want <= got
    for d, i in got - want:  # parts of items
        item = norm(next(r.text for r in items if r.item_id == i)).split()
        assert any(" " + " ".join(item[k : k + 8]) + " " in plain[d] for k in range(len(item) - 7))
    assert np.mean([x in want for x in got]) > 0.8
