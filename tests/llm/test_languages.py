import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import sentences as known
from corpus import texts
from marginalia.llm import languages
from marginalia.llm.tokens import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{languages.PIECES}"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocabulary():
    return languages.Vocabulary(f"{TOKENIZERS}/{languages.PIECES}")


def test_forward_sum_equals_all_segmentations(vocabulary):
    rng = np.random.default_rng(1)
    p = rng.random((vocabulary.size, 2)) / 100

    def total(text):
        if not text:
            return np.ones(2)
        return sum((p[vocabulary.ids[text[:i]]] * total(text[i:]) for i in range(1, len(text) + 1) if text[:i] in vocabulary.ids), np.zeros(2))

    for word in ("kettle", "garten", "a"):
        assert np.allclose(languages.word_score(vocabulary, p, word), np.log(total("▁" + word)))


def test_long_words_and_han_runs_are_summed_as_a_whole(vocabulary):
    rng = np.random.default_rng(2)
    p = rng.random((vocabulary.size, 2)) / 100

    def log_total(text):
        """Sum over all segmentations in logarithms, from the end."""
        rest = [None] * len(text) + [np.zeros(2)]
        for i in reversed(range(len(text))):
            ways = [np.log(p[vocabulary.ids[text[i:j]]]) + rest[j] for j in range(i + 1, len(text) + 1) if text[i:j] in vocabulary.ids and rest[j] is not None]
            rest[i] = np.logaddexp.reduce(ways) if ways else None
        return rest[0]

    for word in ("donaudampfschifffahrtsgesellschaft", "internationalization" * 30):
        assert np.allclose(languages.word_score(vocabulary, p, word), log_total("▁" + word))
    run = "".join(c for c in "我们中国人民在北京大学学习可以自己的时间没有问题" if c in vocabulary.ids) + "".join(sorted(vocabulary.joined))
    parts = vocabulary.words(run)
    assert "".join(parts) == run and any(len(c) > 1 for c in parts)
    assert np.allclose(sum(languages.word_score(vocabulary, p, c) for c in parts), log_total(run))


def test_labels_in_any_spelling(spark):
    rows = [("EN",), ("en-US",), ("deu",), ("German",), ("zh_Hans",), (" fr ",), ("und",), ("",), (None,), ("-",), ("xx",), ("sv",)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(languages.language_code(F.col("l"))).collect()]
    assert got == ["en", "en", "de", "de", "zh", "fr", None, None, None, None, None, "sv"]


def test_sentences_leave_out_what_is_no_prose():
    body = "## A heading\n\nFirst sentence here. Second sentence there!\n```\ncode here\n```\n| a | b |\nkey:: value\n- [x](http://y.test/z) Third one goes on (3 %).\n#tag [[Link only]]\nQUJD" + "A" * 60
    assert languages.sentences(body) == ["First sentence here.", "Second sentence there!", "-   Third one goes on (3 %)."]


def test_segments():
    score = lambda langs: np.eye(3)[langs]
    find = lambda langs: [s[0] for s in languages.segments(langs, score(langs))]
    assert find([0, 0, 1, 1]) == [0, 1]
    assert find([0, 0, 1, 0, 0]) == [0]
    assert find([0, 0, 1, 1, 0, 0]) == [0, 1, 0]
    assert find([0, 1, 1]) == [1]
    assert find([2]) == [2] and find([0, 1, 0]) == [0]


def test_labelled_segments(spark):
    rows, labels = [], []
    for k, lang in enumerate(("en", "de", "zh")):
        for i, text in enumerate(texts(lang, 30)):
            rows.append((k * 100 + i, "# Title\n\n" + text))
            labels.append((k * 100 + i, lang))
    mixed = " ".join(known("en")[:3]) + "\n\n" + " ".join(known("de")[:3])
    rows += [(900, "# T\n\n" + mixed), (901, "# T\n\n" + known("de")[3]), (902, None), (903, ""), (904, "# T\n\n" + " ".join(known("zh")[5:9])), (None, "x"), (904, "# T\n\n" + " ".join(known("zh")[5:9]))]
    labels += [(900, "en"), (901, "English"), (902, "en"), (904, None), (None, "en"), (0, "en")]
    chunks = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS seg", "'z' AS codes")
    got = {}
    for r in languages.labelled_segments(chunks, spark.createDataFrame(labels, "id long, lang string")).orderBy("id", "seg").collect():
        got.setdefault(r["id"], []).append((r["seg"], r["lang"], r["label_state"]))
    assert got[900] == [(0, "en", "mixed"), (1, "de", "mixed")]
    assert got[901] == [(0, "de", "wrong")] and got[904] == [(0, "zh", "missing")]
    assert 902 not in got and 903 not in got and None not in got
    assert sum(got[k * 100 + i] == [(0, lang, "right")] for k, lang in enumerate(("en", "de", "zh")) for i in range(30)) == 90


def test_nothing_labelled_and_empty_table(spark):
    texts_, labels = spark.createDataFrame([(1, "Some words are here.")], "id long, text string"), spark.createDataFrame([], "id long, lang string")
    assert [r["lang"] for r in languages.labelled_segments(texts_, labels).collect()] == ["und"]
    assert languages.labelled_segments(texts_.limit(0), labels).count() == 0


def test_quick_splitting_equals_the_pattern():
    marks = [". ", "! ", "? ", "… ", "。", ".\n", ".) ", ".\" x", ".\t", ".” ", "。」", "\n", " \n ", ".\xa0", ". \x1c", "? ", "… »", "a"]
    for a in marks:
        for b in marks:
            text = f"One{a}two and so on{b}three"
            quick, whole = ([p.strip() for p in parts if p.strip()] for parts in (languages.split_at(languages.BREAK, text), languages.SPLIT.split(text)))
            assert quick == whole, text
