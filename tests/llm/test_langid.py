import random

import numpy as np
import pytest

from tundra.llm import langid as G

TEXT = {
    "en": "the old freezer was never really the right place for all of those bottles and somebody should have checked the door before the long weekend began".split(),
    "de": "der alte kühlschrank stand noch immer neben dem fenster und niemand wollte die schwere tür wegen der großen hitze öffnen obwohl alle davon wussten".split(),
    "fr": "le vieux congélateur se trouvait encore à côté de la fenêtre et personne ne voulait ouvrir cette porte pendant le long week-end malgré la chaleur".split(),
    "ru": "старый холодильник всё ещё стоял у окна и никто не хотел открывать тяжёлую дверь из-за жары хотя все об этом давно знали".split(),
}
SCHEMA = "doc_id bigint, text string, lang string, code string, label string, n_words int"


def sentence(r, lang, n):
    return " ".join(r.choice(TEXT[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    docs, truth = [], {}
    for i in range(800):
        lang = r.choice(list(TEXT))
        label = r.choice([lang, lang, lang, lang.upper(), {"en": "English", "de": "deu", "fr": "fr-CA", "ru": "Russian"}[lang], "de" if r.random() < 0.4 else lang])
        docs.append((i, " ".join(sentence(r, lang, r.randrange(6, 15)) for _ in range(4)), label, "x", "y", 1))
        truth[i] = (lang, G.canonical(label))
    df = spark.createDataFrame(docs, SCHEMA)
    return df, truth, G.train(df)


def test_labels():
    assert [G.canonical(x) for x in ("en", "EN", "en-US", "eng", "German", "fr_CA", "pt-BR", "русский", "??", "", None, "und", "xx")] == ["en", "en", "en", "en", "de", "fr", "pt", "ru", None, None, None, None, None]


def test_wrong_labels_are_found(spark, model):
    df, truth, m = model
    got = {}
    for r in G.mislabelled(df, matrix=m).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    want = {i: {lang} for i, (lang, label) in truth.items() if label != lang}
    assert len(want) > 30 and got == want


def test_cases(spark, model):
    _, _, m = model
    r = random.Random(2)
    s = lambda lang, n: sentence(r, lang, n)
    docs = [
        (1, s("en", 14) + " " + s("de", 12), "en"), (2, s("en", 14) + " " + s("de", 6) + " " + s("en", 12), "en"), (3, s("fr", 12), None), (4, s("fr", 12), "xx"), (5, s("fr", 12), "French"), (6, s("fr", 5), "en"),
        (7, "", "en"), (8, None, "en"), (9, "12 34 5.6 -- ###", None), (10, "x wrote:\n> " + s("ru", 12) + "\n\n" + s("en", 12), "en"), (11, "<p>" + s("de", 20) + "</p> http://a.b/c", "en"), (11, "<p>" + s("de", 20) + "</p>", "en"),
        (None, s("de", 20), "en"), (12, " ".join(s("de", 15) for _ in range(3000)), "de"),
    ]
    df = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], SCHEMA)
    got = sorted(tuple(x) for x in G.mislabelled(df, matrix=m).collect())
    assert got == [(1, "de"), (1, "en"), (3, "fr"), (4, "fr"), (10, "en"), (10, "ru"), (11, "de"), (11, "de")]
    seg = [x for x in G.segments(df, matrix=m).collect() if x.doc_id == 1]
    assert [(x.lang, x.n_words) for x in sorted(seg, key=lambda x: x.segment)] == [("en", 14), ("de", 12)] and all(x.confidence > 0.9 for x in seg)


def test_held_out_accuracy(spark, model):
    _, _, m = model
    r = random.Random(9)
    truth = [r.choice(list(TEXT)) for _ in range(300)]
    got = G.segments_of([sentence(r, t, 10) for t in truth], G.Scorer(m))
    assert np.mean([len(g) == 1 and G.CODES[g[0][0]] == t for g, t in zip(got, truth)]) > 0.98


def test_closing_lines_are_read(spark, model):
    """Lines below a rule at the end and lines above a quote are text like any other."""
    _, _, m = model
    r = random.Random(4)
    body, end = sentence(r, "en", 30), [" ".join(r.choice([w for w in TEXT["de"] if len(w) < 8]) for _ in range(5)) for _ in range(3)]
    docs = [(1, body + "\n--\n" + "\n".join(end), "en"), (2, body + "\n----\n" + end[0], "en"), (3, body + "\n--\n" + end[0] + "\nhttp://a.b/c/d/e/f/g/h/i/j/k/l", "en")]
    df = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], SCHEMA)
    assert max(map(len, end)) <= 60 and sorted(tuple(x) for x in G.mislabelled(df, matrix=m).collect()) == [(1, "de"), (1, "en")]
    assert len(G.words_of(docs[1][1])[0]) == len(G.words_of(docs[2][1])[0]) == 35
    assert G.words_of("Anna Kovac wrote on Monday:\n> quoted words")[0] == "anna kovac wrote on monday quoted words".split()


def test_markup_of_any_length():
    tag = '<div style="' + "x: y; " * 5000 + '">'
    assert G.words_of(f"one {tag}two</div> a < b and c > d [b]three[/b]")[0] == "one two a b and c d three".split()
    assert len(G.words_of("<" * 200_000)[0]) == 0 and len(G.words_of("<a " * 200_000)[0]) == 200_000


def test_cache_of_few_words(model):
    """Emptying the word cache between the texts of a part changes no result."""
    _, _, m = model
    r = random.Random(3)
    texts = [*(" ".join(sentence(r, lang, 12) for lang in r.sample(list(TEXT), 2)) for _ in range(40)), "", None]
    want = G.segments_of(texts, G.Scorer(m))
    assert sum(map(len, want)) > 60
    for words in (1, 5, 30, 60):
        assert G.segments_of(texts, G.Scorer(m, words)) == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text that has no label at all", None, "", "", 1)], SCHEMA)
    assert G.mislabelled(df).count() == 0 and G.mislabelled(df.limit(0)).count() == 0 and G.segments(df).count() == 0
