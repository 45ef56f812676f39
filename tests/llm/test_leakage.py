import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tundra.llm import leakage as L


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 4))
def test_index_against_direct_search(text, k):
    t = np.array(text, dtype=np.int32)
    index = L.FMIndex(t, 3)
    phrases = np.array([[a, b, c, a][:k] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)], dtype=np.int64)
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(t) - k + 1) if (t[i : i + k] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def word(i):
    return "w" + "".join(chr(97 + int(c)) for c in str(i)) + "x"


PASSAGE = [word(i) for i in range(60)]
QUESTION = [word(i) for i in range(200, 230)]
ITEMS = [(1, "Read this.\n" + " ".join(PASSAGE) + "\n" + " ".join(QUESTION)), (2, "Read this.\n" + " ".join(PASSAGE) + "\nshort one"), (3, None), (4, "only an instruction that is long " * 9)]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int, first_word string")
    items = spark.createDataFrame([(i, t, "s") for i, t in ITEMS], "item_id bigint, text string, suite string")
    return {(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()}


def test_forms(spark):
    p = lambda a, b: PASSAGE[a:b]
    swap = lambda ws, *at: [("zz" if i in at else w) for i, w in enumerate(ws)]
    texts = [
        " ".join(p(3, 21)),                                   # 0 exactly a window
        " ".join(p(3, 20)),                                   # 1 a word short
        " ".join(swap(p(3, 21), 0, 17)),                      # 2 two changed
        " ".join(swap(p(3, 21), 0, 9, 17)),                   # 3 three changed
        "> " + "\n> ".join(" ".join(p(i, i + 5)) for i in range(0, 30, 5)).upper(),  # 4 quoted, upper case, wrapped
        "&nbsp;".join(p(10, 40)),                             # 5 entities
        " ".join(f"<b>{w}</b>," for w in p(10, 40)),          # 6 markup
        " ".join(w[:2] + "­" + w[2:] for w in p(10, 40)),  # 7 soft hyphens
        " ".join(random.Random(1).sample(p(0, 40), 40)),      # 8 shuffled
        "", None,                                             # 9, 10
        " ".join(QUESTION[5:25]),                             # 11
        " ".join(p(50, 60) + QUESTION[:10]),                  # 12 never across parts
        "only an instruction that is long " * 9,              # 13
        " ".join(swap(p(0, 18), 5, 6)) + " other " * 50 + " ".join(QUESTION[:18]),  # 14
        " ".join(["filler"] * 300_000 + p(0, 18)),            # 15 very long
        " ".join(p(0, 16)),                                   # 16 the end of the text is no word
    ]
    got = found(spark, texts)
    both = {1, 2}
    want = {(i, k) for i in (0, 2, 4, 5, 6, 7, 15) for k in both} | {(11, 1)} | {(14, k) for k in both}
    assert got == want
    assert found(spark, []) == set()


def test_random_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(150):
        a, n = r.randrange(0, 45), r.randrange(10, 26)
        ws = PASSAGE[a : a + n]
        for _ in range(r.randrange(0, 5)):
            ws[r.randrange(len(ws))] = r.choice(["zz", r.choice(PASSAGE)])
        texts.append(" ".join(["the"] * r.randrange(0, 4) + ws + ["end"] * r.randrange(0, 3)))

    def leaks(t):
        w = t.split()
        return any(sum(x != y for x, y in zip(w[i : i + 18], PASSAGE[j : j + 18])) <= 2 for i in range(len(w) - 17) for j in range(len(PASSAGE) - 17))

    assert found(spark, texts) == {(i, k) for i, t in enumerate(texts) if leaks(t) for k in (1, 2)}


def test_spans(spark):
    text = " ".join(["other"] * 40 + PASSAGE[:30] + ["other"] * 40 + PASSAGE[30:50])
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS[1:2], "item_id bigint, text string")
    # up to two changed words at each end belong to a window
    got = sorted(tuple(x) for x in L.leak_spans(docs, items).collect())
    assert len(got) == 4 and got[0][2] <= 40 and got[0][3] >= 70 and got[2][2] <= 110 and got[2][3] == 130
    assert L.leaks(docs, items).count() == 1


def test_items_in_blocks(spark, monkeypatch):
    texts = [" ".join(PASSAGE[:20]), " ".join(QUESTION[:20]), "none"]
    want = found(spark, texts)
    monkeypatch.setattr(L, "ITEM_CHARS", 150)
    assert found(spark, texts) == want == {(0, 1), (0, 2), (1, 1)}


def test_items_without_an_instruction(spark):
    words = [f"w{i}x" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "so " + " ".join(words[5:30]) + " on")], "doc_id bigint, text string")
    assert L.leaks(docs, items).count() == 0 and [tuple(r) for r in L.leaks(docs, items, instruction_lines=0).collect()] == [(7, 1)]


def test_long_markup_inside_a_passage(spark):
    words = [f"w{i}x" for i in range(40)]
    items = spark.createDataFrame([(1, "do\n" + " ".join(words) + "\nwhy")], "item_id bigint, text string")
    tag = '<span class="' + "y" * 5000 + '">'
    docs = spark.createDataFrame([(7, " ".join(words[:9]) + f" {tag}" + " ".join(words[9:18]) + "</span>")], "doc_id bigint, text string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(7, 1)]
