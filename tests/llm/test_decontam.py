import random
import re

from gridloom.llm import decontam

ITEMS = [
    (0, "A farmer named Maria has 12 apples and gives 5 of them to her brother Paul before the market opens at 9 in the morning."),
    (1, "The river runs for 300 km through the old valley, and the boat of Anna needs 4 hours to travel 60 km of it against the wind."),
    (2, "tiny item here"),
    (3, None),
    (4, ""),
]
FILLER = "some other plain words stand here without any meaning at all and go on like this for quite a while until they end".split()


def filler(r, n):
    return " ".join(r.choice(FILLER) for _ in range(n)) + "."


def leaks(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench).collect()}


def test_exact_and_changed_questions(spark):
    r = random.Random(1)
    wrap = lambda x: f"{filler(r, 30)} {x} {filler(r, 30)}"
    changed = ITEMS[0][1].replace("12", "37").replace("5 of", "9 of").replace("Maria", "Helga").replace("Paul", "Otto")
    inconsistent = "The river runs for 10 km through the old valley, and the boat of Zoe needs 7 hours to travel 11 km of it against the wind."
    half = " ".join(ITEMS[0][1].split()[:8])
    found = leaks(spark, [wrap(ITEMS[0][1]), wrap(changed), wrap(inconsistent), filler(r, 500), wrap(half), wrap(ITEMS[0][1].upper()), None, "", "say: tiny item here.", wrap(ITEMS[1][1]) * 2])
    assert found.keys() == {(0, 0), (1, 0), (2, 1), (5, 0), (8, 2), (9, 1)}
    assert found[0, 0].coverage == 1.0 and found[0, 0].n_changed == 0 and found[1, 0].n_changed == 4


def test_slots_must_agree(spark):
    item = [(0, "Take Bob and 7 and then give Bob back the 7 that Bob had lent to the man with 7 dogs near the mill where Bob lives.")]
    same = item[0][1].replace("Bob", "Eve").replace("7", "9")
    words, k, names = item[0][1].split(), 0, ["Ann", "Ben", "Cid", "Dan"]
    for i, w in enumerate(words):
        if w == "Bob":
            words[i], k = names[k], k + 1
        elif w == "7":
            words[i] = str(20 + i)
    mixed = " ".join(words)
    assert leaks(spark, [same, mixed], item).keys() == {(0, 0)}


def test_blocks_of_the_benchmark_and_odd_rows(spark, odd, empty, monkeypatch):
    r = random.Random(3)
    items = [(k, filler(r, 3) + " " + " ".join(f"w{r.randrange(50)}" for _ in range(20))) for k in range(12)]
    texts = [f"{filler(r, 20)} {items[k % 12][1]}" for k in range(30)]
    once = leaks(spark, texts, items).keys()
    assert once == {(k, k % 12) for k in range(30)}
    monkeypatch.setattr(decontam, "WINDOWS_AT_ONCE", 50)
    assert leaks(spark, texts, items).keys() == once
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_leaks(odd, bench).collect() == [] and decontam.find_leaks(empty, bench).collect() == []
    assert decontam.find_leaks(odd, bench.limit(0)).collect() == []
    kept = decontam.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() and decontam.drop_leaks(empty, bench).collect() == []
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(99, "clean text", 1)], "doc_id long, text string, item_id int")
    assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == [99]


def test_items_without_literal_windows(spark):
    texts = ["Who wrote Hamlet?", "12 + 34 = 46", "Is Mount Kilimanjaro in Tanzania, Kenya or Uganda?", "Give 5 apples and 7", "42"]
    items = list(enumerate(texts))
    docs = [f"some words and then {x} and other words after it" for x in texts]
    docs += ["some words and then Give 6 apples and 8 of them", "Who wrote Macbeth?", "12 + 35 = 47", "some words and then Take 5 apples and 7 of them"]
    assert leaks(spark, docs, items).keys() == {*((k, k) for k in range(5)), (5, 3)}


def test_an_item_in_two_parts(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(500)}" for _ in range(80)]
    item = [(0, " ".join(words))]
    parts = f"{' '.join(words[:28])} {filler(r, 200)} {' '.join(words[30:58])}"
    found = leaks(spark, [parts, f"{' '.join(words[:28])} {filler(r, 200)}"], item)
    assert found.keys() == {(0, 0)} and found[0, 0].n_windows == 48


def plain_template(text):
    """(token, value) of each word by the rules as README states them, read word by word."""
    out, fresh, after = [], True, False
    for word in (text or "").split():
        core = re.sub(r"^[^\w$€£%+-]+|[^\w$€£%]+$", "", word) or word
        low = core.lower()
        number = low in decontam.NUMBER_WORDS or bool(re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%$€£]?", core))
        joined = re.fullmatch(r"([+-]?\d[\d.,]*)([^\W\d]+)", core)
        if number:
            kind = "NUM"
        elif low in decontam.UNITS and after:
            kind = "UNIT"
        elif joined and joined[2].lower() in decontam.UNITS:
            kind = "QUANTITY"
        elif low not in decontam.UNITS and len(core) > 1 and core[0].isupper() and core[1:] == core[1:].lower() and not fresh:
            kind = "NAME"
        else:
            kind = None
        out.append((kind or low, low, kind))
        fresh, after = word.rstrip("\"')]}»”’")[-1:] in tuple(".!?:;…"), kind == "NUM"
    return out


def test_query_against_plain_windows(spark):
    """Registered query: what two plain readings of windows bound from both sides.

    All pairs with half of the item's windows found whatever the slots hold are an upper bound, and
    those with half of its windows found word for word a lower one.
    """
    from gridloom.llm import queries

    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: plain_template(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: plain_template(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, data).collect()}
    grams = lambda t, at, k: {tuple(x[at] for x in t[i : i + k]) for i in range(len(t) - k + 1)}
    upper, lower = set(), set()
    for i, item in items.items():
        k = min(decontam.WINDOW, len(item))
        places = [p for p in range(len(item) - k + 1) if sum(x[2] is None for x in item[p : p + k]) >= min(decontam.MIN_LITERAL, k)]
        for d, doc in docs.items():
            masked, words = grams(doc, 0, k), grams(doc, 1, k)
            if sum(tuple(x[0] for x in item[p : p + k]) in masked for p in places) >= decontam.COVERAGE * len(places) - 1:
                upper.add((d, i))
            if places and all(tuple(x[1] for x in item[p : p + k]) in words for p in range(len(item) - k + 1)):
                lower.add((d, i))
    assert lower <= found <= upper and lower
