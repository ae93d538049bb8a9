import random

from ledgerlens.llm import decontamination as dec


def plain_distance(item, text):
    """Edit distance of item to the closest part of text, cell by cell."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert dec.myers(dec.letter_masks(item), len(item), text)[0] == plain_distance(item, text)


def test_pieces_make_up_the_item():
    for errors in range(6):
        cut = dec.pieces("abcdefghijk", errors)
        assert "".join(p for _, p in cut) == "abcdefghijk" and len(cut) == errors + 1


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qz")
        elif kind == 1:
            out.insert(at, rng.choice("qz"))
        else:
            del out[at]
    return "".join(out)


def random_text(rng, words):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(words))


def test_matches_equal_brute_force(spark, docs_of):
    rng = random.Random(4)
    items = [(i, random_text(rng, 12)) for i in range(6)]
    docs = []
    for n in range(40):
        item = items[n % 6][1]
        passage = edited(rng, item, rng.randint(0, len(item) // 8))
        docs.append((n, f"{random_text(rng, 30)} {passage} {random_text(rng, 30)}" if n % 4 else random_text(rng, 70)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in dec.matches(docs_of(docs), benchmark).collect()}
    wanted = {}
    for doc_id, text in docs:
        for item_id, item in items:
            d = plain_distance(dec.normal(item), dec.normal(text))
            if d <= dec.budget(dec.normal(item), dec.ERROR_RATE):
                wanted[doc_id, item_id] = d
    assert found == wanted and len(wanted) > 15
    kept = {r.doc_id for r in dec.clean(docs_of(docs), benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in wanted}
    # Blocks of items give the same matches.
    small = {(r.doc_id, r.item_id): r.distance for r in dec.matches(docs_of(docs), benchmark, block_chars=100).collect()}
    assert small == wanted


def test_noise_between_words_is_seen_through(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "A passage that every model must answer, without help.")], "item_id long, text string")
    docs = docs_of([(1, "xx A!! PASSAGE!! THAT!! EVERY!! MODEL!! MUST!! ANSWER,!! WITHOUT!! HELP.!! yy"), (2, "clean words")])
    assert [r.doc_id for r in dec.matches(docs, benchmark).collect()] == [1]


def test_odd_tables(spark, docs_of, odd_docs):
    schema = "item_id long, text string"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "same text twice"), (4, "same text twice")], schema)
    rows = dec.matches(odd_docs, odd).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(4, None), (4, 4)} and len(rows) == 2
    assert dec.clean(odd_docs, odd).count() == odd_docs.count() - 2
    none = spark.createDataFrame([], schema)
    assert dec.matches(odd_docs, none).count() == 0 and dec.clean(odd_docs, none).count() == odd_docs.count()
    assert dec.matches(docs_of([]), odd).count() == 0
    extra = odd_docs.selectExpr("*", "1 as item_id", "2 as distance", "3 as passage")
    assert dec.clean(extra, odd).columns == extra.columns and dec.matches(extra, odd).count() == 2


def test_short_items_stand_between_word_ends_and_drop_no_text(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "cat"), (2, "a"), (3, "Yes!"), (4, "quick brown fox")], "item_id long, text string")
    docs = docs_of([(1, "Concatenate banana"), (2, "the cat, a dog"), (3, "cat"), (4, " yes. "), (5, "one quick brown fox"), (6, "yesterday")])
    found = {(r.doc_id, r.item_id, r.passage) for r in dec.matches(docs, benchmark).collect()}
    assert found == {(2, 1, "cat"), (2, 2, "a"), (3, 1, "cat"), (4, 3, "yes"), (5, 4, "quick brown fox")}
    assert {r.doc_id for r in dec.clean(docs, benchmark).collect()} == {1, 2, 6}
    assert {r.doc_id for r in dec.clean(docs, benchmark, least_chars=1).collect()} == {1, 6}
