import pytest

from quarry.llm import decontamination
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def words(text):
    return [w for w in (x.strip(".,!?;:").lower() for x in text.split()) if w]


def test_query_finds_whole_items_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in docs:
        text = " " + " ".join(words(r.text)) + " "
        want[r.doc_id] = sorted(i for i, w in items if f" {' '.join(w)} " in text)
    got = {r.doc_id: r for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert sum(map(bool, want.values())) > 5 and all(r.contaminated == bool(r.item_ids) for r in got.values())
    texts, grams = {r.doc_id: words(r.text) for r in docs}, lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    by_item = dict(items)
    for k, r in got.items():
        assert set(want[k]) <= set(r.item_ids)
        for item in set(r.item_ids) - set(want[k]):  # a near copy of a text that holds the item
            assert len(grams(by_item[item]) & grams(texts[k])) >= 0.6 * len(grams(by_item[item]))


ITEM = "Yesterday the farmer Anna Berg sold 12 boxes of apples for 30 dollars and gave 5 kg of pears to Paul before he drove 7 km home with Anna Berg."
CASES = [
    ("verbatim", "intro words here. " + ITEM + " More follows.", True, True),
    (
        "reparameterised",
        ITEM.replace("12", "77").replace("30", "64").replace("Anna Berg", "Maria Luisa Costa").replace("Paul", "Otto").replace("7 km", "9 miles"),
        True,
        False,
    ),
    (
        "inconsistent",
        ITEM.replace("Anna Berg", "Maria", 1).replace("12", "3").replace("Paul", "Anna Berg").replace("with Anna Berg", "with Otto"),
        None,
        False,
    ),
    ("half", " ".join(ITEM.split()[:12]), False, None),
    ("other", "The weather was fine and nobody in town wanted to leave the market square before noon on that day.", False, None),
    ("capitals", ITEM.upper(), True, True),
    ("no marks", "so it was " + ITEM.lower().replace(".", "").replace("anna", "anna,"), True, True),
]


@pytest.mark.parametrize("sent", [0, 1000])
def test_templates(spark, sent):
    docs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM), (6, None), (None, ITEM), (7, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.leaks(docs, bench, max_sent=sent).collect()}
    for i, (_, _, found, verbatim) in enumerate(CASES):
        if found is not None:
            assert (i in got) == found
        if found and verbatim is not None:
            assert got[i].verbatim == verbatim and got[i].item_id == 5


def test_slots_have_to_agree():
    hits = [(i, i, f"3{v}", f"3{w}") for i, (v, w) in enumerate([("a", "x"), ("b", "x"), ("c", "x"), ("a", "x"), ("d", "x")])]
    assert decontamination.judge(list(hits), 5, 0.8) is None
    assert decontamination.judge([(i, i, "3a", "3x") for i in range(5)], 5, 0.8) == (1.0, False, 0, 8)
    assert decontamination.judge([(i, i, "3x", "3x") for i in range(5)], 5, 0.8)[1] is True


TRAIN = (
    "A train leaves the station at 9 with 40 people. At the first stop 12 people get on and 7 people get off. At the second stop "
    "15 people get on and 3 people get off. At the third stop 8 people get on and 21 people get off. How many people are on the train now?"
)


def test_items_that_repeat_a_window_are_found(spark):
    other = TRAIN.replace("12", "31").replace("15", "44").replace("21", "67")
    mixed = TRAIN.replace("40 people.", "40 very merry people.").replace("and 3 people", "and then 3 people")
    texts = ["Some words before. " + TRAIN + " More follows.", other, TRAIN[:90], "One more here. " + mixed, other + " " * 5 + TRAIN]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, TRAIN)], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontamination.leaks(docs, bench).collect()}
    assert got == {0: True, 1: False, 3: got.get(3), 4: True} and got[3] is not None


def test_every_stretch_is_judged():
    bad = [(i, i, f"3{v}", "3x") for i, v in enumerate("abcde")]
    good = [(100 + i, i, "3x", "3x") for i in range(5)]
    assert decontamination.judge(bad + good, 5, 0.8) == (1.0, True, 100, 108)


def test_odd_rows(spark, odd_docs, no_docs):
    text = "We keep the odd rows of a table and lose none of them here."
    docs = odd_docs.unionByName(
        odd_docs.filter("doc_id = 2").selectExpr(*[f"'{text}' as text" if c == "text" else c for c in odd_docs.columns])
    )
    bench = spark.createDataFrame([(1, text), (1, text), (2, text)], "item_id long, text string")
    got = decontamination.leaks(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(2, 1), (2, 2)]
    assert decontamination.leaks(no_docs, bench).count() == 0
    assert decontamination.leaks(odd_docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_items_without_windows_are_found_whole(spark, sent):
    items = ["What is 2+2?", "Compute 12 + 17 * 3 - 4 / 2 + 99 - 1 now", "Paris", "New York", " ".join(map(str, range(300))), "?!"]
    texts = [f"some words before. {x} And some behind it, of course." for x in items] + ["Paris", "new york!", "What is 2+3?"]
    texts += ["compute 12 17 3 4 2 99 1 now", "Compute 12 + 17 * 3 - 4 / 2 + 98 - 1 now", " ".join(map(str, range(299)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench, max_sent=sent).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 4), (6, 2), (7, 3), (9, 1)} and all(r.verbatim for r in got.values())
    assert (got[1, 1].first_word, got[1, 1].last_word) == (3, 11)


@pytest.mark.parametrize("name", ["form", "pos", "n", "window", "slots", "key", "__pair", "__key"])
def test_keys_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "so: " + ITEM)], f"`{name}` long, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item long, text string")
    assert [r[name] for r in decontamination.leaks(docs, bench, key=name, item_key="item").collect()] == [1]
