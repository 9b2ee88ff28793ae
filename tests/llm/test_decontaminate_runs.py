from claimbook.llm import decontaminate


def _found(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_matched"], r["reworded"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_slots_are_judged_by_stretches(spark):
    words = [f"lit{i}" for i in range(40)]
    long = " ".join([*words[:4], "7", *words[4:36], "7", *words[36:]])
    apples = "the farmer picks 3 apples and then 5 pears from the tall trees behind the old barn"
    pets = "yesterday we saw that Anna fed the cat while Boris washed the small dog in our garden"
    texts = [
        (1, long.replace("7", "8", 1)), (2, apples.replace("3", "4").replace("5", "4")),
        (3, pets.replace("Anna", "Clara").replace("Boris", "Clara")),
        (4, pets.replace("Anna", "Clara")), (4, pets.replace("Anna", "Dora")),
    ]
    got = _found(spark, texts, [(1, long), (2, apples), (3, pets)])
    assert set(got) == {(1, 1), (2, 2), (4, 3)}
    assert got[1, 1] == (37, True)


def test_names_that_open_sentences_are_slots(spark):
    item = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?"
    other = item.replace("Tom", "Anna").replace("3", "4").replace("5", "6")
    mixed = other.replace("Anna buys", "Clara buys")
    got = _found(spark, [(1, other), (2, item), (3, "He said that Anna sat. " + other), (4, mixed)], [(1, item)])
    assert got == {(1, 1): (14, True), (2, 1): (14, False), (3, 1): (14, True)}


def test_verbatim_copies_are_found_with_few_literal_words(spark):
    items = [(1, "John has 5 apples"), (2, "What is 12 + 7?"), (3, "5 kg 7 m 9 hours 11 Anna 3 Boris 8 days 2 miles 6 Clara 10 David"),
             (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    texts = [(i, f"we read that here: {t} and no more of it") for i, t in items] + [
        (11, "so it is said John has 6 apples now"), (12, "what is 12 + 7?")]
    got = _found(spark, texts, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (12, 2)}
    assert not any(reworded for _, reworded in got.values())
