from collections import Counter

import numpy as np

from corpus import sentences, texts
from marginalia.llm import stuffing

SPAM = [
    "cheap kettle, kettle sale, kettle online, " * 12,
    " ".join(f"#{a}-kettle" for a in ("cheap", "red", "sale", "new")) * 8,
    "\n".join(f"- [kettle {i}](https://shop.example/k/{i})" for i in range(30)),
    "\n".join(f"https://www.shop.example/kettle/{i}" for i in range(30)),
    "brandx kettle red 12 cm; brandx kettle sale; brandx boat XL; " * 10,
    "优惠 水壶 折扣 水壶 包邮 " * 20,
]
RECORDS = [
    "\n".join(f"2020-01-{d:02d}\t10:{d:02d}\t{d / 3:.1f}" for d in range(1, 28)),
    "```\n" + "for x in y { step(); }\n" * 20 + "```",
    "\n".join(f"- {d} g old kettle" for d in range(1, 25)),
    "\n".join(f"- [ ] The kettle needs another look in room {d}." for d in range(20)),
]


def pages(spark, extra=()):
    rows = [(k * 1000 + i, "# Title\n\n" + t, lang) for k, lang in enumerate(("en", "de", "zh")) for i, t in enumerate(texts(lang, 80, 12))]
    rows += [(9000 + i, "# Kettle\n\n" + t, "en") for i, t in enumerate(SPAM)] + [(9500 + i, "# Kettle\n\n" + t, None) for i, t in enumerate(RECORDS)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_spam_is_found_and_records_are_not(spark):
    odd = [(None, SPAM[0], "en"), (9900, None, "en"), (9901, "", None), (9902, "# Only a title", "en"), (9000, "# Kettle\n\n" + SPAM[0], "en")]
    got = stuffing.stuffed_pages(pages(spark, odd).selectExpr("*", "1 AS n", "2 AS band")).collect()
    assert {r["doc_id"] for r in got} == {9000 + i for i in range(len(SPAM))}
    assert all(0.5 < r["share"] <= 1 for r in got)


def test_share_without_the_title_line():
    functions = frozenset({"the", "a", "at"})
    assert stuffing.stuffed_share("# kettle kettle kettle kettle\n\nThe kettle stays at home.", functions) == 0
    half = "The old kettle stays at the house near the river." + "\n#a1234 #b1234 #c1234"
    assert 0.2 < stuffing.stuffed_share("# x\n" + half, functions) < 0.5


def prose_of(lang="en"):
    found = stuffing.body_words(" ".join(sentences(lang)))
    n = sum(found.values())
    shares = {w: k / n for w, k in found.most_common(30)}
    whole = np.array([*shares.values(), 1 - sum(shares.values())])
    return stuffing.Prose(shares, whole[-1], frozenset(), stuffing.expected_divergence(whole))


def test_curve_equals_a_direct_fit(spark):
    frequencies = [9, 4, 4, 1, 1, 1, 1]
    text = " ".join(w for i, f in enumerate(frequencies) for w in ["abcdefgh"[i] * 3] * f)
    frame = spark.createDataFrame([(1, text, "en"), (1, "another text of that id", "en")], "doc_id long, text string, lang string")
    got = stuffing.curves(stuffing.profiles(frame, {"en": prose_of()})).orderBy("slope").first()
    ranks = np.array([1, 2.5, 2.5, 5.5, 5.5, 5.5, 5.5])
    slope, at = np.polyfit(np.log(ranks), np.log(frequencies), 1)
    assert np.isclose(got["slope"], slope)
    assert np.isclose(got["residual"], np.sqrt(np.mean((np.log(frequencies) - slope * np.log(ranks) - at) ** 2)))


def test_divergence_doesn_t_depend_on_length():
    own, rng = prose_of(), np.random.default_rng(5)
    every, near = [*own.shares, "zzz"], stuffing.holders_of({"en": own})
    p = np.array([*own.shares.values(), own.rest]) / (sum(own.shares.values()) + own.rest)
    for n in (30, 300, 3000):
        drawn = [stuffing.nearest_prose(Counter(every[i] for i in rng.choice(len(every), n, p=p)), {"en": own}, near)[1] for _ in range(20)]
        assert abs(np.mean(drawn)) < 0.03
    assert stuffing.nearest_prose(Counter({"kettle": 30, "sale": 30}), {"en": own}, near)[1] > 0.3


def test_curves_alone_tell_spam_from_prose(spark):
    flags = {r["doc_id"]: r["deviation"] for r in stuffing.flagged_pages(pages(spark)).collect()}
    assert all(flags[9000 + i] >= stuffing.EXTREME for i in range(len(SPAM)))
    assert np.mean([flags[i] >= stuffing.EXTREME for i in flags if i < 9000]) <= 0.02


def test_empty_table(spark):
    assert stuffing.stuffed_pages(pages(spark).limit(0)).count() == 0


def test_spam_in_the_majority(spark):
    honest = [(i, "# Title\n\n" + t, "en") for i, t in enumerate(texts("en", 30, 12))]
    copies = [(1000 + i, "# Kettle\n\n" + SPAM[0], "en") for i in range(60)]
    template = [(2000 + i, "# Kettle\n\n" + f"cheap kettle {i}, kettle sale, " * 12, "en") for i in range(60)]
    frame = spark.createDataFrame(honest + copies + template, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in stuffing.stuffed_pages(frame).collect()} == {d for d, _, _ in copies + template}


def test_labels_that_name_no_language(spark):
    frame = pages(spark).selectExpr("doc_id", "text", "'?' AS lang")
    assert {r["doc_id"] for r in stuffing.stuffed_pages(frame).collect()} <= {9000 + i for i in range(len(SPAM))}


def test_prose_is_fitted_on_all_labelled_pages(spark):
    rows = [(i, f"# Title\n\nOld kettle number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} stays.", "en") for i in range(2600)]
    frame = spark.createDataFrame(rows + rows[:50] + [(9000, None, "en"), (9001, "no label here", None)], "doc_id long, text string, lang string")
    counted = stuffing.counted_pages(frame)
    assert counted.count() == 2600
    own = stuffing.prose(counted)["en"]
    assert np.isclose(own.shares["kettle"], (2600 + stuffing.ADDED_WORDS / 5) / (5 * 2600 + stuffing.ADDED_WORDS))
    near = stuffing.prose(counted, {"en": own})["en"]
    assert np.isclose(near.shares["kettle"], own.shares["kettle"]) and "kettle" in near.functions


def test_a_task_passes_on_each_word_once(spark):
    rows = [("en", "# Title\n\nThe old kettle, the old boat. The end."), ("en", "# Title\n\nThe kettle of the neighbours, the kettle."), ("de", "Der Kessel"), ("de", "# Only a title")] + [("en", f"Kettle {'x' * i}") for i in range(1, 40)]
    counted = stuffing.counted_pages(spark.createDataFrame(rows * 2, "lang string, text string")).coalesce(1)
    got = {(r["lang"], r["word"]): (r["tokens"], r["pages"]) for r in stuffing.tallies(counted, None).collect()}
    assert len(got) == stuffing.tallies(counted, None).count() == 3 + 47  # not a row for each page of a word
    assert got["en", "the"] == (6, 2) and got["en", "kettle"] == (42, 41) and got["en", ""] == (8 + 7 + 78, 41) and got["de", ""] == (2, 1)
