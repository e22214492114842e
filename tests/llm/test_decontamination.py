import random

from filigree.llm.decontamination import NAME, NUM, UNIT, Item, Templates, matches, remove_contaminated
from filigree.llm.words import text_slices

import pyarrow as pa

ITEM = "If Anna Smith buys 12 apples for 3.50 dollars each and then sells 12 of them to Bob near the old market, how much money does she keep?"
SAME = "zzz yyy. Intro words here. " + ITEM + " More words follow after it."
CHANGED = "Before that. If Mary buys 7 apples for 12 euros each and then sells 7 of them to John near the old market, how much money does she keep? After that."
CLASH = "If Mary buys 7 apples for 12 euros each and then sells 9 of them to John near the old market, how much money does she keep"


def found(text, coverage=0.6):
    return look(text, ITEM, coverage)


def look(text, item, coverage=0.6):
    """Flags (equal, consistent) of the item in the last of two texts of a slice."""
    got = Item(item).find(Templates(next(text_slices(pa.array(["other text", text])))[2]), 1, coverage)
    return [got[3:]] if got else []


def test_copy_changed_and_clashing_slots():
    assert found(SAME)[0] == (True, True)
    assert found(CHANGED)[0] == (False, True)
    assert found(CLASH)[0][1] is False
    assert found("quite other words " * 50) == []


def test_rows(spark, docs, none):
    b = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (8, "two words")], "item_id long, text string")
    extra = spark.createDataFrame([(900, SAME), (901, CHANGED), (902, CLASH), (903, "two words"), (903, "two words")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = sorted((r.doc_id, r.item_id, r.verbatim) for r in matches(both, b).collect())
    assert got == [(900, 5, True), (901, 5, False), (903, 8, True), (903, 8, True)]
    kept = remove_contaminated(docs.unionByName(extra, True), b)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 903)").count() == 0 and kept.count() == docs.count() + 1
    assert matches(none, b).count() == 0 and remove_contaminated(none, b).count() == 0
    assert matches(both, b.limit(0)).count() == 0 and remove_contaminated(both, b.limit(0)).count() == both.count()


COINS = "pay 3 red coins 4 red coins 5 red coins and 6 red coins to the guard at the gate"


def test_repeated_template_and_clash_before_the_copy():
    assert look("Some words before. " + COINS + " and after", COINS) == [(True, True)]
    assert look(COINS.replace("3", "13").replace("4", "14"), COINS) == [(False, True)]
    assert look(CLASH + ". Then other words. " + ITEM, ITEM) == [(True, True)]


def test_short_items_and_items_of_slots_in_longer_documents():
    find = look
    assert find("Here one asks. What is 17 + 25? Nobody knows", "What is 17 + 25?") == [(True, True)]
    assert find("so then 17 + 25 it was", "17 + 25") == [(True, True)] and find("so then 17 + 26 it was", "17 + 25") == []
    row = "1 2 3 Anna 4 5 6 7 8 9"
    assert find("before " + row + " after it", row) == [(True, True)]
    assert find("word", "word") == [(True, True)] and find("a word of it", "word") == []


STORY = "Anna has 5 apples. Bob has 3 pears. Anna gives 2 apples to Bob. How many pieces of fruit does Bob hold after 60 km of walking?"


def test_names_at_sentence_starts_number_words_and_units():
    assert look("Text. Mary has nine apples. Tom has four pears. Mary gives one apples to Tom. How many pieces of fruit does Tom hold after 75km of walking? End.", STORY) == [(False, True)]
    assert look(STORY.replace("Bob", "Anna"), STORY)[0][1] is False  # two names never face one
    p = Templates(next(text_slices(pa.array(["The train ran 60km, then twelve miles to York. York slept."])))[2])
    assert p.kind.tolist() == [0, 0, 0, NUM, UNIT, 0, NUM, UNIT, 0, NAME, NAME, 0]


def test_against_brute_force(spark):
    r = random.Random(11)
    nouns, verbs, names = [f"noun{chr(97 + i % 26)}{'xyz'[i // 26]}" for i in range(40)], [f"verb{chr(97 + i)}s" for i in range(25)], [f"Name{chr(97 + i)}" for i in range(26)]

    def sentence(values):
        return " ".join(values[w] if w in values else w for w in r.choice(shapes))

    shapes = [["N1", r.choice(verbs), "X1", r.choice(nouns), "and", r.choice(nouns), "then", "N2", r.choice(verbs), "X2", r.choice(nouns), "near", "the", r.choice(nouns)] for _ in range(60)]
    fill = lambda: {"N1": (n := r.sample(names, 2))[0], "N2": n[1], "X1": str(r.randrange(2, 99)), "X2": str(r.randrange(100, 999))}
    items, docs = [], []
    for i in range(40):
        picked, v = r.sample(shapes, 3), fill()
        text = lambda v, picked=picked: ". ".join(" ".join(v.get(w, w) for w in s) for s in picked) + "."
        items.append((i, text(v)))
        filler = " ".join(r.choice(nouns) for _ in range(30))
        docs += [(10 * i, f"{filler}. {text(v)} {filler}"), (10 * i + 1, f"{filler}. {text(fill())} {filler}"), (10 * i + 2, f"{filler}. {sentence(fill())}. {filler}")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.item_id): x.verbatim for x in matches(d, b).collect()}
    want = {(k, i): f[0][0] for k, t in docs for i, item in items if (f := look(t, item)) and f[0][1]}
    assert got == want
    assert all(got.get((10 * i, i)) for i in range(40)) and sum(got.get((10 * i + 1, i)) is False for i in range(40)) >= 38
    assert sorted(x.doc_id for x in remove_contaminated(d, b).collect()) == sorted({k for k, _ in docs} - {k for k, _ in want})


def test_very_long_text_and_ties(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    d = spark.createDataFrame([(1, long + " " + SAME + " " + long), (2, SAME), (2, SAME)], "doc_id long, text string")
    b = spark.createDataFrame([(5, ITEM), (6, ITEM), (None, ITEM)], "item_id long, text string")
    got = sorted((x.doc_id, -1 if x.item_id is None else x.item_id) for x in matches(d, b).collect())
    assert got == [(1, -1), (1, 5), (1, 6)] + [(2, -1)] * 2 + [(2, 5)] * 2 + [(2, 6)] * 2
