import random

from tallyloom.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id long, hash string, pos int"
ITEM = "If Anna buys 12 apples for 3 dollars each and Anna sells 5 of them, how many dollars does she keep in the end?"
CASES = [
    (1, f"Some words before it.\n{ITEM}\nAnd after.", {7}, False),
    (2, "intro text: If Berta buys 99 apples for 44 dollars each and Berta sells 6 of them, how many dollars does she keep in the end? ok", {7}, True),
    (3, "If Berta buys 99 apples for 44 dollars each and Clara sells 6 of them, how many dollars does she keep in the end? ok", set(), None),
    (4, "If Anna buys bread she is glad and nothing else of this is about apples or dollars.", set(), None),
    (5, None, set(), None),
    (6, "", set(), None),
    (8, "the quick brown", {9}, False),
    (9, ITEM.upper(), {7}, None),
    (14, "If Clara buys 99 apples for 44 dollars each and Clara sells 6 of them, how many dollars does she keep in the end? ok", {7}, True),
    (10, "99 44 12 13 55 17 1 2 3 4 5", set(), None),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t, _, _ in CASES] + [(None, ITEM, 0, "", 0), (1, CASES[0][1], 0, "", 0)], DOCS)
    bench = spark.createDataFrame([(7, ITEM, 1), (9, "The quick brown", 2), (11, None, 3), (12, " ", 4), (13, "1 2 3", 5)], "item_id long, text string, pos int")
    got = D.find_leaks(docs, bench).collect()
    for i, _, items, reworded in CASES:
        mine = [r for r in got if r["doc_id"] == i]
        assert {r["item_id"] for r in mine} == items, i
        assert reworded is None or all(r["reworded"] == reworded for r in mine)
    assert [r["item_id"] for r in got if r["doc_id"] is None] == [7]
    left = D.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6, 10}


def test_items_without_plain_windows(spark):
    items = ["What is 12 + 45 * 3 - 7?", "Compute 3 + 4 * 5 .", "Find 2, 4, 8, 16, 32, 64, 128", "2 + 2 = 4", "the 5"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f'Some words "{q}"\nand others after it.', 0, "", 0) for i, q in enumerate(items)] + [(9, "What is 12 * 45 + 3 - 7? Compute 5 + 4 * 3 . Find 1, 2, 3, 5, 8, 13, 21", 0, "", 0)], DOCS)
    got = D.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(len(items))} and not any(r["reworded"] for r in got)


def test_names_that_open_sentences(spark):
    item = "Tom has 12 apples. Tom gives 5 apples to Ann. How many apples does Tom have left?"
    other = "She has 12 red apples in her old bag. She gives 5 of them to the boy next door at ten in the morning. How many apples are then left in the bag?"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    texts = [
        item.replace("Tom", "Bob"), "Question 7: " + item.replace("Tom", "Bob").replace("Ann", "Eve").replace("12", "31"), item.replace("Tom", "Bob", 1), item,
        other.replace("She gives", "He gives"), "Rain has come. Rain gives us water to drink. How many days does Rain have left?",
    ]
    got = D.find_leaks(spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], DOCS), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["reworded"]) for r in got} == {(0, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 2, False)}


def test_every_verbatim_passage_and_no_other(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").split()).lower()
    items = [(r["item_id"], flat(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, q in items if q in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    assert want and got == want


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, bench).collect() == []
    assert D.find_leaks(spark.createDataFrame([(1, "a b c d e f", 0, "", 0)], DOCS), bench).collect() == []
    assert D.find_leaks(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


WORDS = "river stone cloud garden window letter market bridge candle forest".split()
NAMES = "Anna Berta Clara Dora Emil Franz".split()


def parts(text):
    """Symbols of a lower-case text with names in capitals: (kind, word) with kind number, unit, name or word."""
    out = []
    for w in text.split():
        core = w.strip(".,?")
        kind = "number" if core.isdigit() else "unit" if core in ("km", "dollars") and out and out[-1][0] == "number" else "name" if core in NAMES else "word"
        out.append((kind, core.lower()))
    return out


def brute_leak(item, text):
    """The share of the item's usable windows of five that stand in the text, over alignments whose slots are filled one to one:
    with names as slots, if that leaves enough windows, or with names as words."""
    a, b = parts(item), parts(text)
    best, usable = 0, {}
    for named in (False, True):
        form = lambda x, named=named: [(k, "" if k in ("number", "unit") or (k == "name" and named) else w) for k, w in x]
        fa, fb = form(a), form(b)
        usable[named] = [p for p in range(len(a) - 4) if sum(w != "" for _, w in fa[p : p + 5]) >= 3]
        if named and len(usable[True]) < max(3, len(usable[False]) / 2):
            continue
        found = set()
        for shift in range(-len(a), len(b)):
            hit = [p for p in usable[named] if p + shift >= 0 and fb[p + shift : p + shift + 5] == fa[p : p + 5]]
            pairs = {(k, a[q][1], b[q + shift][1]) for p in hit for q in range(p, p + 5) for k in [a[q][0]] if fa[q][1] == ""}
            names = [x for x in pairs if x[0] == "name"]
            if len({x[:2] for x in pairs}) == len(pairs) and len({x[2] for x in names}) == len(names):
                found |= set(hit)
        best = max(best, len(found) / len(usable[named]) if usable[named] else 0)
    return best


def test_templates_against_brute_force(spark):
    """Word problems re-parameterised well, badly, in part, or not at all."""
    r = random.Random(4)
    sentence = lambda: " ".join(r.choice([r.choice(WORDS), r.choice(WORDS), r.choice(WORDS), f"to {r.choice(NAMES)}", f"{r.randint(2, 99)} {r.choice(['km', 'dollars', 'stones'])}"]) for _ in range(r.randint(8, 16)))
    items = [f"then {sentence()} and so" for _ in range(25)]

    def changed(text):
        number, name = {}, dict(zip(NAMES, r.sample(NAMES, len(NAMES)), strict=True))
        if r.random() < 0.3:
            name[r.choice(NAMES)] = r.choice(NAMES)  # perhaps two names become one
        out = [name.get(w, str(number.setdefault(w, r.randint(100, 999)) if r.random() < 0.9 else 5) if w.isdigit() else w) for w in text.split()]
        for _ in range(r.choice([0, 0, 1, 2])):
            out[r.randrange(len(out))] = r.choice(WORDS)
        return " ".join(out)

    texts = [f"so we {sentence()} but {changed(r.choice(items))} or {sentence()}" for _ in range(250)]
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], DOCS)
    got = {(x["doc_id"], x["item_id"]) for x in D.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    share = {(i, k): brute_leak(q, t) for i, t in enumerate(texts) for k, q in enumerate(items)}
    sure, never = {x for x, v in share.items() if v == 1}, {x for x, v in share.items() if v < 0.6}
    assert len(sure) > 80 and sure <= got and not got & never  # between them the two forms' windows count together


def test_repeated_phrases_and_very_long_texts(spark):
    phrase = "the quick brown fox jumps over it "
    docs = spark.createDataFrame([(1, phrase * 3000, 0, "", 0), (2, ("word " * 200_000) + ITEM, 0, "", 0), (3, "other words " * 1000, 0, "", 0)], DOCS)
    bench = spark.createDataFrame([(1, phrase * 40), (2, ITEM)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()} == {(1, 1), (2, 2)}
