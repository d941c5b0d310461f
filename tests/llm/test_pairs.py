import numpy as np
import pytest

from corpus import sentences as known
from corpus import texts
from marginalia.llm import pairs


@pytest.fixture(scope="module")
def models(spark):
    rows = [(k * 1000 + i, "# T\n\n" + t, lang) for k, lang in enumerate(("en", "de", "zh")) for i, t in enumerate(texts(lang, 60))]
    frame = spark.createDataFrame(rows, "id long, text string, lang string")
    return pairs.fit(frame.select("id", "text"), frame.select("id", "lang"))


def test_held_out_languages(models):
    for i, lang in enumerate(models.languages):
        scores = pairs.language_scores([s.replace("。", "").rstrip(".") for s in known(lang)[1::3]], models.table)
        assert (scores.argmax(axis=1) == i).mean() > 0.97


def test_scores_don_t_depend_on_neighbours(models):
    both = pairs.language_scores(["the old kettle", "", "der brief"], models.table)
    assert np.allclose(both[1], 0)
    assert pairs.language_scores(["the old kettle"], models.table)[0].argmax() == both[0].argmax()


def test_ends(models):
    chance = lambda t: pairs.end_chance(pairs.stripped(t), models.seen, models.ends)
    whole = [s.rstrip(".") for s in known("en")]
    assert np.mean([chance(s) >= pairs.LEAST_END for s in whole]) > 0.95
    cut = [s[: s.rindex(" ")] for s in whole] + [s[: len(s) // 2] for s in whole]
    assert np.mean([chance(s) < pairs.LEAST_END for s in cut]) > 0.85
    assert pairs.unclosed("a (b") and pairs.unclosed("x „y") and not pairs.unclosed("a (b) c “d”")


DECLINED = [
    "I'm sorry, but I can't summarize this page.", "I cannot provide a summary for that. Please paste the text of the page.", "As an assistant, I am not able to help with this request.",
    "Unfortunately, I do not have access to the page content.", "Please provide the text of the page and I will gladly summarize it.", "This request can't be completed by an assistant like me.",
    "Leider kann ich diese Seite nicht zusammenfassen.", "Ich habe keinen Zugriff auf den Inhalt der Seite.", "Bei dieser Anfrage kann ich nicht helfen, da der Text fehlt.",
    "抱歉，我无法总结这个页面。", "对不起，我没有办法访问页面的内容。", "我不能提供摘要，请粘贴正文。",
]


def declining(spark, extra=()):
    """Notes of which a third is declined, and their pages."""
    langs = ["en"] * 6 + ["de"] * 3 + ["zh"] * 3
    notes = [(500 + i, "Old kettle", DECLINED[i % 12]) for i in range(36)] + [(600 + i, "Old kettle", known("en")[i] + " " + known("en")[i + 1]) for i in range(80)]
    pages = [(500 + i, "# Old kettle\n\n" + " ".join(known(langs[i % 12])[i : i + 9])) for i in range(36)] + [(600 + i, "# Old kettle\n\n" + " ".join(known("en")[max(0, i - 4) : i + 5])) for i in range(80)]
    notes, pages = notes + [(i, "Old kettle", s) for i, s, _ in extra], pages + [(i, p) for i, _, p in extra]
    return spark.createDataFrame(notes, "note_id long, page_title string, summary string"), spark.createDataFrame(pages, "note_id long, text string")


def test_refusals_are_told_by_what_the_page_supports(spark, models):
    en, de, zh = (" ".join(known(lang)[:8]) for lang in ("en", "de", "zh"))
    harmless = [
        (1, "I can't recommend this bakery enough; the rye bread is the best in town.", "# Bakery\n\nI can't recommend this bakery enough. The rye bread is the best in town. " + en),
        (2, "Ich kann die Messwerte ohne Sensor nicht reproduzieren, der Kessel bleibt kalt.", "# Messung\n\nOhne Sensor kann ich die Messwerte nicht reproduzieren. Der Kessel bleibt kalt. " + de),
        (3, "Asks the team: please share your page drafts and text before the winter.", "# Drafts\n\nPlease share your page drafts and text with the team before the winter. " + en),
        (4, "The neighbour's boat cannot stay, we are not able to paint it twice.", "# Boat\n\nThe neighbour's boat cannot stay near the river. We are not able to paint it twice. " + en),
        (5, "我们不能把旧水壶留在原来的地方，它还要再看一遍。", "# 水壶\n\n我们不能把旧水壶留在原来的地方。它还要再看一遍。" + zh),
        (6, "Unfortunately the old kettle was not included in the long list.", "# Kettle\n\nThe list is long. Unfortunately the old kettle was not included. " + en),
    ]
    refused = [
        (11, "As an AI, summarising this is beyond my abilities.", en), (12, "That request falls outside what this assistant does.", en),
        (13, "Diese Anfrage kann ich leider nicht beantworten, mir fehlt der Zugriff.", de), (14, "很抱歉，我无法处理这个请求。", zh),
    ]
    notes, chunks = declining(spark, harmless + [(i, s, "# T\n\n" + page) for i, s, page in refused])
    learned = pairs.learn_declining(notes, chunks, models)
    got = {r["note_id"]: r["defect"] for r in pairs.defective(notes, chunks, learned).collect()}
    assert {i for i, defect in got.items() if defect == "refusal"} == {11, 12, 13, 14, *range(500, 536)}


def test_support(spark, models):
    chunks = spark.createDataFrame([(1, "# T\n\nthe old kettle"), (1, "# T\n\nthe boat"), (2, None)], "note_id long, text string")
    asked = [(1, "kettle boat moon", "en"), (2, "kettle", "en"), (3, "", "en")]
    rows = [(i, list(w), list(w.values())) for i, t, lang in asked for w in [pairs.weighed_words(t, None, models.languages.index(lang), models)]]
    got = {r["note_id"]: r["support"] for r in pairs.support(spark.createDataFrame(rows, "note_id long, words array<long>, weights array<double>"), chunks).collect()}
    assert 0 < got[1] < 1 and got[2] == 0 and got[3] == 1


def test_posterior(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([0.0, -1.0, -2000.0], [1, 2])], "s array<float>, l array<int>")
    assert rows.select(pairs.posterior(F.col("s"), F.col("l"))).first()[0] == pytest.approx(1 / (1 + np.e))


def test_defects(spark, models):
    page = " ".join(known("en")[:8])
    good = known("en")[33] + " " + known("en")[44]
    answers = {
        1: good, 2: None, 3: " (N/A) ", 4: "I'm sorry, but I can't summarize this page.", 5: "**Old kettle**", 6: known("en")[2] + " " + known("en")[3],
        7: " ".join(known("de")[20:22]), 8: good[: good.rindex("the")], 9: good.rstrip("."), 10: "Page title: x\nContent:\n" + page, 11: good, 12: "​", 13: None,
        14: "Please paste the text of the page.", 15: "Explains why the old kettle cannot be replaced before the winter: it needs another look.",
    }
    notes = spark.createDataFrame([(i, "Old kettle", s) for i, s in answers.items()] + [(1, "Old kettle", good), (None, None, None), (40, None, good)], "note_id long, page_title string, summary string")
    rows = [(100 + i, i, "# Old kettle\n\n" + page) for i in answers if i not in (11, 13)] + [(7, 11, "# Old kettle\n\nShort."), (8, None, page), (9, 40, None), (10, 40, "# T\n\n" + page)]
    chunks = spark.createDataFrame(rows, "chunk_id long, note_id long, text string").selectExpr("*", "1 AS chars", "2 AS held")
    more_notes, more_chunks = declining(spark)
    learned = pairs.learn_declining(notes.union(more_notes), chunks.select("note_id", "text").union(more_chunks), models)
    got = {r["note_id"]: r["defect"] for r in pairs.defective(notes.selectExpr("*", "3 AS language"), chunks, learned).collect()}
    assert got == {2: "empty", 3: "empty", 4: "refusal", 5: "copy", 6: "copy", 7: "language", 8: "truncated", 10: "copy", 12: "empty", 14: "refusal"}


def test_empty_tables(spark):
    texts_, labels = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, lang string")
    models = pairs.fit(texts_, labels)
    notes = spark.createDataFrame([(1, "t", "")], "note_id long, page_title string, summary string")
    chunks = spark.createDataFrame([(1, 1, "# t\n\nsome text that is long enough")], "chunk_id long, note_id long, text string")
    models = pairs.learn_declining(notes, chunks, models)
    assert models.declining is None
    assert [r["defect"] for r in pairs.defective(notes, chunks, models).collect()] == ["empty"]
    assert pairs.defective(notes.limit(0), chunks.limit(0), models).count() == 0


def test_models_are_fitted_on_all_rows(spark):
    rows = [(i, f"# T\n\nThe kettle {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x stays near the river.", "en") for i in range(1500)]
    chunks = spark.createDataFrame(rows, "id long, text string, lang string")
    notes = spark.createDataFrame([(1, "T", "The kettle stays near the"), (2, "T", "Nothing.")], "note_id long, page_title string, summary string")
    models = pairs.fit(chunks.select("id", "text"), chunks.select("id", "lang"), notes)
    count = lambda word: models.holding[0].of(np.array([pairs.word_hash(word)]))[0]
    assert models.texts == [1500] and count("kettle") == 1500 and count("nothing") == 0 and count("river") == 0
    keys = np.array([k[-1] for k in pairs.end_keys("the kettle stays near the")])
    assert models.seen.of(keys)[3] == 1500 and not models.ends.of(keys).any()  # the six last characters
    assert len(models.seen.keys) <= len(keys)  # of what no summary asks, nothing comes back


def test_end_counts_are_not_capped():
    keys, seen, ends = pairs.count_ends(["An old kettle."] * 70_000)
    at = np.array([k[-1] for k in pairs.end_keys("an old kettle")])
    assert pairs.Counts(keys, seen).of(at).tolist() == pairs.Counts(keys, ends).of(at).tolist() == [70_000] * len(at)


def test_declining_is_learned_from_every_answer(spark, models):
    notes, chunks = declining(spark)
    once = pairs.learn_declining(notes, chunks, models).declining
    refusal = [(10_000 + i, "Old kettle", "Zyx qwv.") for i in range(10_500)]
    more = spark.createDataFrame(refusal, "note_id long, page_title string, summary string")
    pages = more.selectExpr("note_id", "'# Old kettle\n\nThe old kettle stays.' AS text")
    learned = pairs.learn_declining(notes.union(more), chunks.union(pages), models).declining
    cell = pairs.gram_cells(pairs.codes("zyx qwv."))[1][0]
    grams = 10_500 / np.exp(learned[cell])  # all grams that were counted
    assert learned[cell] > once[cell] and grams > 10_500 * 2 * len("zyx qwv.")


def test_longer_contexts_are_tried_where_shorter_ones_pass(monkeypatch):
    texts_, tried = [s for lang in ("en", "de", "zh") for s in known(lang)] + ["A kettle (old, and ours), stays (near it)."], []
    keys, seen, ends = pairs.count_ends(texts_)
    asked_for = pairs.asked_for
    monkeypatch.setattr(pairs, "asked_for", lambda keys, bits: tried.append(len(keys)) or asked_for(keys, bits))
    bits = np.zeros(1 << pairs.FILTER_BITS, dtype=bool)
    asked = np.concatenate([k[-1:] for end in ("our small garden was painted twice near the river", "a kettle (old", "an", "我们的小花园刷了两次漆") for k in pairs.end_keys(end)])
    bits[asked & ((1 << pairs.FILTER_BITS) - 1)] = True
    got = pairs.count_ends(texts_, np.packbits(bits, bitorder="little"))
    assert sum(tried) < 3 * sum(map(len, texts_))  # not six contexts at each position
    every = [pairs.Counts(keys, n).of(asked).tolist() for n in (seen, ends)]
    assert [pairs.Counts(got[0], n).of(asked).tolist() for n in got[1:]] == every and sum(map(bool, every[0])) > 12 and any(every[1])


def test_a_page_word_is_hashed_once(monkeypatch):
    hashed, word_hash = [], pairs.word_hash
    monkeypatch.setattr(pairs, "word_hash", lambda word: hashed.append(word) or word_hash(word))
    hashes = pairs.WordHashes()
    assert [hashes[w] for w in ("kettle", "boat", "kettle")] == [word_hash(w) for w in ("kettle", "boat", "kettle")] and hashed == ["kettle", "boat"]
