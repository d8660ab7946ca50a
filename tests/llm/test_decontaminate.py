import pytest

from tidemark.llm import decontaminate as op

ITEMS = [
    (1, "A train leaves the old station at 40 km and arrives 3 hours later with 200 passengers who greet Alice at the gate."),
    (2, "Short text here."),
    (3, "Than and onesen erblest it hein ti inenan eranenes whan ou therouou thon the heoron eratsh."),
    (4, ""),
    (5, None),
]
DOCS = [
    (10, "Intro words come first. " + ITEMS[0][1] + " More words follow here."),
    (11, "Say: a train leaves the old station at 55 km and arrives 7 hours later with 120 passengers who greet Bob at the gate. End"),
    (12, "A train leaves the old station at 55 km and arrives 55 hours later with 55 passengers who greet Bob at the gate."),  # slots merge
    (13, "than AND onesen erblest it hein ti inenan eranenes whan ou therouou thon the heoron eratsh"),
    (14, "than and onesen erblest it hein other words fill this clean document up to the end of it"),
    (15, "we say short text here today"),
    (16, None),
    (17, ""),
    (18, "a train leaves the old station at 40 km and arrives 3 hours later with 200 passengers who greet alice at the gate"),
    (19, "Long " * 30_000 + ITEMS[2][1]),
    (None, ITEMS[2][1]),
    (13, "than AND onesen erblest it hein ti inenan eranenes whan ou therouou thon the heoron eratsh"),
]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_copies_reparameterised_and_clean(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.exact) for r in op.contaminated(docs, items, broadcast_windows=bound).collect())
    assert got == [(-1, 3, True), (10, 1, True), (11, 1, False), (13, 3, True), (13, 3, True), (15, 2, True), (18, 1, True), (19, 3, True)]
    kept = op.decontaminate(docs, items, broadcast_windows=bound)
    assert kept.columns == docs.columns and all(r.doc_id is not None for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [12, 14, 16, 17]


def test_both_joins_agree_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a = {tuple(r) for r in op.contaminated(docs, items).collect()}
    assert a == {tuple(r) for r in op.contaminated(docs, items, broadcast_windows=0).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    literal = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in (d.text or "")}
    assert literal <= {x[:2] for x in a}


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:2], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for bound in (2_000_000, 0):
        assert op.contaminated(docs, none, broadcast_windows=bound).count() == 0
    assert op.contaminated(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


SOLD = "{0} sold clips to {1} of her friends in April. {0} sold half as many clips in May. How many clips did {0} sell altogether in April and May?"
OPENED = [
    (SOLD.format("Natalia", 48), SOLD.format("Marcus", 72)),
    (SOLD.format("Natalia", 48), SOLD.format("MARCUS", 72)),
    (SOLD.format("NATALIA", 48), SOLD.format("Marcus", 72)),
    (SOLD.format("Natalia", "forty-eight"), SOLD.format("Marcus", "seven")),
    (SOLD.format("Natalia", "eight"), SOLD.format("Marcus", 72)),
    ("Ann ran home. Bob sat down. Ann ate five figs. Bob ate two figs. How many figs did Ann and Bob eat?", "Zoe ran home. Max sat down. Zoe ate nine figs. Max ate three figs. How many figs did Zoe and Max eat?"),
]


def found(spark, texts, items, bound):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (round(r.containment, 6), r.exact) for r in op.contaminated(docs, table, broadcast_windows=bound).collect()}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_names_that_open_sentences_capitals_and_number_words(spark, bound):
    got = found(spark, [f"Read this first. {copy} And then this." for _, copy in OPENED], [item for item, _ in OPENED], bound)
    assert {(i, i): got.get((i, i)) for i in range(len(OPENED))} == {(i, i): (1.0, False) for i in range(len(OPENED))}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_openers_must_agree_and_capitals_are_not_all_names(spark, bound):
    item = SOLD.format("Natalia", 48)
    mixed = "Marcus sold clips to 72 of her friends in April. Peter sold half as many clips in May. How many clips did Susan sell altogether in April and May?"
    capitals = "WE CAME TO THIS TOWN BY BOAT AND SAW ITS OLD STONE WALLS BEFORE NIGHT FELL OVER US"
    other = "NO DOG MAY RUN OFF INTO WET LAND UNLESS HIS KEEPER GOES THERE FIRST AND LEADS THEM"
    assert found(spark, [mixed, other], [item, capitals], bound) == {}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_other_passages_and_variants_do_not_hide_a_copy(spark, bound):
    words = "melons grapes plums pears limes dates nuts figs kiwis beans peas leeks yams oats beets corn rice kale chard okra".split()
    item = "we know that {} has {} {} and gives {} to {} while keeping {} for a friend who visits that farm each day".format
    items = [item("Ann", 15, w, 4, "Bob", 11, w) for w in words]
    copies = [item("Zed", 25, w, 6, "Eve", 19, w) for w in words]
    decoys = [f"they say that Ann has 30 {w} and gives 9 to nobody" for w in words]
    docs = [f"{d}. So {c}, he said." for d, c in zip(decoys, copies, strict=True)]
    variants = [" and ".join(item(n, a, w, b, m, c) for n, a, b, m, c in (("Joe", 90, 50, "Kim", 40), ("Kim", 50, 40, "Joe", 10), ("Lou", 33, 3, "Max", 30))) for w in words]
    got = found(spark, docs + variants, items, bound)
    n = len(words)
    assert {k: got.get(k) for k in [(i, i % n) for i in range(2 * n)]} == {(i, i % n): (1.0, False) for i in range(2 * n)}


def test_a_copy_with_a_sentence_put_in_is_bound_from_both_sides(spark):
    item = "first Joe walks 5 km down that long road to see his aunt and buys 7 red hats for her children then Joe rides a bus back over that bridge with 3 bags while it rains all day"
    copy = item.replace("Joe", "Tim").replace(" 5 ", " 8 ").replace(" 7 ", " 9 ").replace(" 3 ", " 4 ").replace("children then", "children (all of them are small) then")
    got = found(spark, [copy], [item], 2_000_000)
    assert got[0, 0][0] > 0.8 and not got[0, 0][1]


def test_a_text_keeps_no_list_of_its_own_words():
    from tidemark.llm import decontaminate

    cache = decontaminate._Words()
    words = decontaminate.Words(b"we met Ann in Rome on 12 May", cache)
    assert words.values is cache.values_ and words.slots(2, 5) == ("3:ann", "3:rome", "1:12")[: len(words.slots(2, 5))]


def test_plain_words_are_not_taken_one_by_one():
    cache = op._Words()
    words = op.Words(" ".join(f"word{chr(97 + k % 26)}x{k} Said{k}, (and{k})." for k in range(5000)).encode(), cache)
    assert len(words.plain) == 15_000 == len(set(words.plain.tolist())) and len(cache) == 0
    assert words.value(4) == "said1" and words.kind[4] == 3


MANY = [
    b"He ran 5", b"km to Rome. Twenty-one men\n\n saw: Ann (ANN) and U.S. troops -- \"The end.\" $5 km 7,000 min. Forty m/s",
    None, b"", b" ", b"-", b"- - Max ran", "Äpfel «the» É naïve Éa 漢字 the Straße".encode(), b"\xff\xfe The a\xc3", b"_a_ a_b \x1cx\x00 " + b"!" * 20 + b" Then",
    b"abcdefgh abcdefghi abcdefghijklmnop Abcdefghijklmnopq ABCDEFGHi " + b"(" * 9 + b"b" + b"*" * 9 + b".  Bob", b"dozen DOZEN Dozen in In IN. 1st a1 \t\x0b\x0cx.",
]


def test_words_taken_at_once_equal_each_text_alone_and_each_word_alone():
    cache = op._Words()
    many = op.Words(MANY, cache)
    for k, text in enumerate(MANY):
        alone, at = op.Words(text, cache), slice(many.first[k], many.first[k + 1])
        for name in ("plain", "templ", "templ2", "kind", "kind2", "maybe"):
            assert getattr(many, name)[at].tolist() == getattr(alone, name).tolist(), (text, name)
        tokens = [t for t in (text or b"").split() if op._EDGE.sub("", t.decode("utf-8", "replace"))]
        one = cache.look(tokens)
        assert alone.plain.tolist() == cache.codes[one].tolist() and [alone.value(i) for i in range(len(tokens))] == [cache.values_[i] for i in one]
        assert ((alone.kind == 1) == (cache.flags[one] & op._IS_NUMBER > 0)).all()
    assert many.kind[many.first[1]] == 0  # km behind the 5 of another text is no unit


def test_windows_do_not_reach_into_the_next_text():
    found = op._found(op.Words([b"a b c", b"d e f g h", None, b"i j k l m n"], op._Words()), [5])
    assert {k: sorted(j for at in of.values() for js in at.values() for j in js) for k, of in found.items()} == {1: [0, 0], 3: [0, 0, 1, 1]}


def test_values_that_were_read_do_not_pile_up():
    cache = op._Words(at_most=3)
    for k in range(10):
        words = op.Words(f"we met Ann{chr(97 + k)} and Bob{chr(97 + k)} there".encode(), cache)
        assert words.slots(0, 6) == (f"3:ann{chr(97 + k)}", f"3:bob{chr(97 + k)}") and len(cache) <= 5
