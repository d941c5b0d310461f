"""Problem 7: pages made of repeated keywords, tags or links.

A page's words give its rank-frequency curve, fitted with SQL windows over its spectrum (how many words occur how often), and
its divergence from the prose of its language. Both are compared with prose of about the same length: the divergence by what
as many words drawn from that prose would show, all three by the middle and spread of that language's other pages. Pages whose
slope, residual and divergence are extreme together are flagged; an exact measure of the text then confirms that more than
half of a flagged page is stuffed.

The prose of a language is a word model fitted on all its labelled pages, first with no page counting a word more than a few
times, then without those that diverge from that; equal texts count once: so spam doesn't become normal by being frequent.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.languages import language_code
from marginalia.tables import settle

#: Words of a language's prose that pages are compared with, most frequent first, and those of them that tell the language.
PROSE_WORDS, LANGUAGE_WORDS = 400, 100
#: Label of all pages where none has one.
ANY_LANGUAGE = "zz"
#: A word in at least this share of a language's pages and tokens counts as one of its function words.
FUNCTION_PAGES, FUNCTION_TOKENS = 0.3, 0.01
#: How often a page counts a word at most when prose is sketched; words of all languages' prose added to each language's.
FIRST_CAP, ADDED_WORDS = 3, 2000
#: Words, of all labels, that a task counts before it passes its counts on.
TALLIED = 1_000_000
#: Divergence beyond what a page's length explains from which on a page doesn't count as prose.
NO_PROSE = 0.15
#: Pages of all lengths, and of all languages, added to a group of pages when its middle and spread are estimated.
ADDED_PAGES = 30
#: Least middle and spread of the divergence; weight of slope and residual, and spreads that each counts for at most.
LEAST_MIDDLE, LEAST_SPREAD, SHAPE_WEIGHT, SHAPE_MOST = 0.0, 0.02, 0.2, 3.0
#: Joint deviation, in spreads, from which on a page is flagged; divergence that a flagged page has at least.
EXTREME = 4.5
FLAGGED_LEAST = LEAST_MIDDLE + (EXTREME - 2 * SHAPE_WEIGHT * SHAPE_MOST) * LEAST_SPREAD
#: Share of the text beyond which a page is stuffed.
STUFFED = 0.5
#: Base-two logarithms of the lengths, and drawings of each, that expected divergences are computed for.
LENGTHS, DRAWINGS = np.arange(0, 17.5, 0.5), 40

WORD = re.compile(r"[^\W\d_]+")
BLANKS = {i: " " for i in range(128) if not chr(i).isalpha()}
BLANK_BYTES = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
HAN = ("\u3400", "\u9fff")
HAN_CHAR = re.compile(r"[\u3400-\u9fff]")


def unpaired_words(text: str) -> list[str]:
    """Lower-case words of a text, as WORD finds them."""
    if text.isascii():
        return text.lower().translate(BLANKS).split()
    found = text.lower().encode("utf-8", "surrogatepass").translate(BLANK_BYTES).decode("utf-8", "surrogatepass").split()
    if not "".join(found).isalpha():  # there are other marks than ASCII's
        found = [w for part in found for w in ((part,) if part.isalpha() else WORD.findall(part))]
    return found


def words(text: str) -> list[str]:
    """Lower-case words of a text; runs of Han characters, which have no blanks, give their pairs of neighbours."""
    found = unpaired_words(text)
    if text.isascii() or not HAN_CHAR.search(text):
        return found
    out = []
    for word in found:
        if HAN[0] <= word[0] <= HAN[1] and len(word) > 1:
            out += map("".join, zip(word, word[1:]))
        else:
            out.append(word)
    return out


@dataclass(frozen=True)
class Prose:
    """A language's prose: its most frequent words' shares and that of all others, the function words among them, and the
    divergence of as many words drawn from it as ``LENGTHS`` say."""

    shares: dict[str, float]
    rest: float
    functions: frozenset[str]
    expected: np.ndarray


def expected_divergence(shares: np.ndarray) -> np.ndarray:
    """Mean divergence from ``shares`` (they add up to 1) of texts drawn from them, for each of LENGTHS."""
    rng = np.random.default_rng(0)
    out = []
    for x in LENGTHS:
        n = max(1, round(2**x))
        drawn = rng.multinomial(n, shares, size=DRAWINGS) / n
        middle = (shares + drawn) / 2
        own = np.where(drawn > 0, drawn * np.log(np.where(drawn > 0, drawn, 1.0) / middle), 0.0)
        out.append(float((shares * np.log(shares / middle) + own).sum(axis=1).mean()) / 2)
    return np.array(out)


def nearest_prose(found: Counter, known: dict[str, Prose], holders: dict[str, list[tuple[str, float]]]) -> tuple[str, float]:
    """The language that a page's words (with their counts) are most like, and its divergence beyond what its length explains."""
    n, likeness = sum(found.values()), dict.fromkeys(known, 0.0)
    for w in found.keys() & holders.keys():
        for lang, root in holders[w]:
            likeness[lang] += root
    lang = max(likeness, key=likeness.get)
    own = known[lang]
    divergence, other, present, log = 0.0, n, 0.0, math.log
    for w in found.keys() & own.shares.keys():
        p, q = own.shares[w], found[w] / n
        middle = (p + q) / 2
        divergence += p * log(p / middle) + q * log(q / middle)
        present, other = present + p, other - found[w]
    p, q = own.rest, other / n
    divergence += p * log(2 * p / (p + q)) + (q * log(2 * q / (p + q)) if q else 0.0)
    divergence += max(0.0, 1 - own.rest - present) * log(2)  # what the page lacks
    return lang, divergence / 2 - float(np.interp(math.log2(n), LENGTHS, own.expected))


def holders_of(known: dict[str, Prose]) -> dict[str, list[tuple[str, float]]]:
    """Of each language's most frequent words the languages that have it, with the root of its share there."""
    out = defaultdict(list)
    for lang, own in known.items():
        for w, p in sorted(own.shares.items(), key=lambda x: (-x[1], x[0]))[:LANGUAGE_WORDS]:
            out[w].append((lang, math.sqrt(p)))
    return dict(out)


def body_words(text: str) -> Counter:
    return Counter(words(TITLE.sub("", text, count=1)))


def counted_pages(pages: DataFrame) -> DataFrame:
    """lang and text of each distinct text of a label of ``pages`` (text, lang)."""
    return pages.filter("text is not null and lang is not null").select("lang", "text").distinct()


def tallies(counted: DataFrame, known: dict[str, Prose] | None) -> DataFrame:
    """lang, word, tokens and pages with it, of each task's ``counted`` pages that have words, and of all words together (the empty word).

    Given what is ``known``, pages that aren't near the prose of their nearest language are left out; else none counts a word more
    than FIRST_CAP times.
    """
    near = None if known is None else holders_of(known)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: dict[str, Counter] = defaultdict(Counter)
        holding: dict[str, Counter] = defaultdict(Counter)

        def tallied() -> pd.DataFrame:
            rows = [(lang, w, n, holding[lang][w]) for lang, own in tokens.items() for w, n in own.items()]
            tokens.clear()
            holding.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "tokens", "pages"])

        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"]):
                if not (found := body_words(text)) or known is not None and nearest_prose(found, known, near)[1] >= NO_PROSE:
                    continue
                own = tokens[lang]
                if known is None:
                    found = {w: min(n, FIRST_CAP) for w, n in found.items()}
                for w, n in found.items():
                    own[w] += n
                own[""] += sum(found.values())
                holding[lang].update(found.keys())
                holding[lang][""] += 1
            if sum(map(len, tokens.values())) > TALLIED:
                yield tallied()
        yield tallied()

    return counted.mapInPandas(tally, "lang string, word string, tokens long, pages long")


def prose(counted: DataFrame, known: dict[str, Prose] | None = None) -> dict[str, Prose]:
    """The prose of each label of all ``counted`` pages; given what is ``known``, only from the pages near it, else a sketch in which
    a page counts no word more than FIRST_CAP times.

    Tasks count words by label; what comes back are at most PROSE_WORDS words a label. Every label's shares are mixed with
    those of all labels together, so that a label of a few pages is no prose of its own.
    """
    totals = tallies(counted, known).groupBy("lang", "word").agg(F.sum("tokens").alias("tokens"), F.sum("pages").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("word") != "", F.desc("tokens"), "word"))
    top = totals.withColumn("rank", rank).filter(F.col("rank") <= PROSE_WORDS + 1).drop("rank").collect()
    sizes = {r["lang"]: (r["tokens"], r["pages"]) for r in top if r["word"] == ""}
    everywhere, size = Counter(), sum(n for n, _ in sizes.values())
    for r in top:
        everywhere[r["word"]] += r["tokens"]
    out = {}
    for lang, (n, n_pages) in sorted(sizes.items()):
        own = {r["word"]: r for r in top if r["lang"] == lang and r["word"]}
        shares = {w: (r["tokens"] + ADDED_WORDS * everywhere[w] / size) / (n + ADDED_WORDS) for w, r in own.items()}
        functions = frozenset(w for w, r in own.items() if r["tokens"] >= FUNCTION_TOKENS * n and r["pages"] >= FUNCTION_PAGES * n_pages)
        rest = max(1e-3, 1 - sum(shares.values()))
        whole = np.array([*shares.values(), rest])
        out[lang] = Prose(shares, rest, functions, expected_divergence(whole / whole.sum()))
    return out


PROFILE = "doc_id long, page long, lang string, n long, divergence double, share double, freq array<long>, terms array<long>"


def profiles(pages: DataFrame, known: dict[str, Prose]) -> DataFrame:
    """Nearest language, words, divergence (beyond what the length explains) and spectrum (frequencies, and words of each) of each
    page (doc_id, text) that has words; ``page`` tells texts of the same doc_id apart.

    ``share`` is the stuffed share of a page that may be flagged, measured here so that texts needn't be moved; null for the others.
    """
    near = holders_of(known)
    functions = frozenset().union(*(own.functions for own in known.values()))

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, page, text in zip(rows["doc_id"], rows["page"], rows["text"]):
                if not (found := body_words(text)):
                    continue
                lang, divergence = nearest_prose(found, known, near)
                spectrum = Counter(found.values())
                share = stuffed_share(text, functions) if divergence >= FLAGGED_LEAST else None
                out.append((doc_id, page, lang, sum(found.values()), divergence, share, list(spectrum), list(spectrum.values())))
            yield pd.DataFrame(out, columns=["doc_id", "page", "lang", "n", "divergence", "share", "freq", "terms"])

    return pages.filter("text is not null").select("doc_id", F.xxhash64("text").alias("page"), "text").mapInPandas(profile, PROFILE)


def curves(profiled: DataFrame) -> DataFrame:
    """``profiled`` pages with the slope of log frequency over log rank, and the deviation of the points from the line."""
    points = profiled.select("doc_id", "page", "lang", "n", "divergence", "share", F.inline(F.arrays_zip("freq", "terms")))
    upto = F.sum("terms").over(Window.partitionBy("doc_id", "page").orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, 0))
    x, y, w = F.log(upto - (F.col("terms") - 1) / 2), F.log("freq"), F.col("terms")
    placed = points.withColumn("x", x).withColumn("y", y)
    total = lambda e: F.sum(w * e)
    sums = placed.groupBy("doc_id", "page").agg(
        *(F.first(name).alias(name) for name in ("lang", "n", "divergence", "share")), F.sum(w).alias("w"),
        *(total(e).alias(name) for name, e in (("sx", F.col("x")), ("sy", F.col("y")), ("xx", F.col("x") ** 2), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") ** 2))),
    )
    c = F.col
    vx, vy, cov = (c("xx") / c("w") - (c("sx") / c("w")) ** 2, c("yy") / c("w") - (c("sy") / c("w")) ** 2, c("xy") / c("w") - c("sx") * c("sy") / c("w") ** 2)
    slope = F.when(vx > 1e-9, cov / vx).otherwise(0.0)
    residual = F.sqrt(F.greatest(F.lit(0.0), vy - F.when(vx > 1e-9, cov**2 / vx).otherwise(0.0)))
    return sums.select("doc_id", "lang", F.floor(F.log2("n")).alias("band"), "divergence", "share", slope.alias("slope"), residual.alias("residual"))


MEASURES = ("divergence", "slope", "residual")
#: Least middles and spreads of the measures.
LEAST = {"divergence": (LEAST_MIDDLE, LEAST_SPREAD), "slope": (-math.inf, 0.02), "residual": (0.0, 0.02)}


def usual(fitted: DataFrame) -> dict[tuple[int | None, str | None], dict[str, tuple[float, float]]]:
    """Middle and spread of each measure over the prose-like pages of each (band, lang) of ``fitted``, of each band (lang None), and of all.

    A group's own leans on that of its band, and a band's on that of all, as if ADDED_PAGES of those were in it.
    """
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in MEASURES]
    rows = fitted.filter(F.col("divergence") < NO_PROSE).rollup("band", "lang").agg(F.count("*").alias("n"), *quartiles).collect()  # bands x languages
    out: dict[tuple[int | None, str | None], dict[str, tuple[float, float]]] = {(None, None): {m: (0.0, 0.0) for m in MEASURES}}
    for r in sorted(rows, key=lambda r: (r["band"] is not None, r["lang"] is not None)):
        if not r["n"]:
            continue
        above = out[(None, None) if r["lang"] is None else (r["band"], None)]
        weight = 1.0 if r["band"] is None else r["n"] / (r["n"] + ADDED_PAGES)
        out[r["band"], r["lang"]] = {m: (weight * r[m][1] + (1 - weight) * above[m][0], weight * (r[m][2] - r[m][0]) / 1.35 + (1 - weight) * above[m][1]) for m in MEASURES}
    return {key: {m: (max(x, LEAST[m][0]), max(s, LEAST[m][1])) for m, (x, s) in own.items()} for key, own in out.items()}


def deviating(fitted: DataFrame) -> DataFrame:
    """``fitted`` pages with ``deviation``: how many spreads divergence, slope and residual together are from what is usual in
    prose of the same language and length. A divergence below the usual doesn't count against the page, nor does a residual."""
    known = usual(fitted)
    names = [f"{m}_{part}" for m in MEASURES for part in ("middle", "spread")]
    flat = lambda own: [x for m in MEASURES for x in own[m]]
    schema = lambda keys: ", ".join(keys + [f"{x} double" for x in names])
    spark = fitted.sparkSession
    groups = spark.createDataFrame([(b, lang, *flat(own)) for (b, lang), own in known.items() if lang is not None], schema(["band long", "lang string"]))
    bands = spark.createDataFrame([(b, *flat(own)) for (b, lang), own in known.items() if b is not None and lang is None], schema(["band long"]))
    every = dict(zip(names, flat(known[None, None])))
    bands = bands.select("band", *(F.col(x).alias(f"{x}_of_band") for x in names))
    joined = fitted.join(F.broadcast(groups), ["band", "lang"], "left").join(F.broadcast(bands), "band", "left")  # a row for each band and language
    z = lambda m: (F.col(m) - F.coalesce(f"{m}_middle", f"{m}_middle_of_band", F.lit(every[f"{m}_middle"]))) / F.coalesce(f"{m}_spread", f"{m}_spread_of_band", F.lit(every[f"{m}_spread"]))
    shape = F.least(F.abs(z("slope")), F.lit(SHAPE_MOST)) + F.least(F.greatest(z("residual"), F.lit(0.0)), F.lit(SHAPE_MOST))
    return joined.select(*fitted.columns, (z("divergence") + SHAPE_WEIGHT * shape).alias("deviation"))


FENCE = re.compile(r"```.*?(?:```|\Z)|#\+BEGIN_QUERY.*?(?:#\+END_QUERY|\Z)", re.S | re.I)
LINK = re.compile(r"!?\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\s]*\)|<?(?:https?://|www\.)[^\s>|)]+>?|(?<![\w#])#\w[^\s,;|·]*")
#: What every FENCE and every LINK has some of.
FENCE_MARKS, LINK_MARKS = ("```", "#+"), ("[", "://", "www.", "#")
MARKER = re.compile(r"^\s*(?:[-*+>]\s+|\d+[.)]\s+|\[[ xX]\]\s*|(?:TODO|DONE|LATER|NOW|DOING)\b\s*)+")
QUANTITY = re.compile(r"\s*\d+(?:[.,]\d+)?\s*(?:g|kg|ml|l|cm|mm|m|x|×|min|h|%)?\s+\S")
CLOCK = re.compile(r"\d{4}-\d\d-\d\d|\b\d\d:\d\d\b")
END = re.compile(r"[.!?…](?=[\s\"')\]»”’]|$)|[。！？]")
HAN_GAP = re.compile(r"[\u3400-\u9fff][,，.;；|/·!?:：–-]*\s+(?:[–|/·*-]\s+)?[\u3400-\u9fff]")
TITLE = re.compile(r"^# [^\n]*$", re.M)
EDGES = " \t\r-*>|·,;/"


def is_sentence(part: str, ended: bool, functions: frozenset[str]) -> bool:
    """Whether a stretch of text reads like prose: Han text without blanks between words, or enough function
    words; a finished sentence needs none if its words hardly repeat."""
    han = 0 if part.isascii() else len(HAN_CHAR.findall(part))
    if 2 * han > len(part.replace(" ", "")):
        return ended and len(HAN_GAP.findall(part)) * 15 <= han
    found = unpaired_words(part)
    if not found:
        return True
    share, varied = sum(w in functions for w in found) / len(found), len(set(found)) / len(found)
    if ended:
        return share >= 0.1 or len(found) >= 5 and varied >= 0.75 and 4 * part.count(",") <= len(found)
    return share >= 0.15 and len(found) >= 4 and varied >= 0.6


def stuffed_share(text: str, functions: frozenset[str]) -> float:
    """Share of a page's text, without its title line, that is keywords, tags or links instead of sentences or records."""
    body = TITLE.sub("", text, count=1)
    stuffed, sound = 0, 0
    if any(mark in body for mark in FENCE_MARKS):
        sound, body = sum(len(m) for m in FENCE.findall(body)), FENCE.sub("\n", body)
    for line in body.splitlines():
        rest, links = line, 0
        if any(mark in line for mark in LINK_MARKS):
            rest, links = LINK.sub(" ", line), sum(len(m) for m in LINK.findall(line))
        stuffed += links
        plain = MARKER.sub("", rest).strip(EDGES)
        if not plain:
            continue
        if CLOCK.search(plain) or line.startswith("##") or not links and (line.lstrip().startswith("|") or QUANTITY.match(MARKER.sub("", line)) and len(plain) < 80):
            sound += len(plain)
            continue
        start = 0
        for end in [m.end() for m in END.finditer(plain)] + [len(plain)]:
            part = plain[start:end].strip(EDGES)
            if part and is_sentence(part, bool(END.search(part[-1])), functions):
                sound += len(part)
            else:
                stuffed += len(part)
            start = end
    return stuffed / (stuffed + sound) if stuffed else 0.0


def flagged_pages(pages: DataFrame) -> DataFrame:
    """The ``pages`` (doc_id, text, lang) with words, their curves, deviations and, where they may be flagged, stuffed shares.

    Labels are read as languages, whatever their spelling; those that name none don't count. Without any label all pages are
    compared with all of them.
    """
    code = language_code(F.col("lang"))
    coded = pages.filter("doc_id is not null").select("doc_id", "text", F.when(code.rlike("^[a-z]{2}$"), code).alias("lang"))
    if coded.filter("lang is not null").isEmpty():
        coded = coded.withColumn("lang", F.lit(ANY_LANGUAGE))
    counted = settle(counted_pages(coded))
    sketch = prose(counted)
    if not sketch:
        return deviating(curves(profiles(coded.limit(0), {})))
    return deviating(settle(curves(profiles(coded, prose(counted, sketch) or sketch))))


def stuffed_pages(pages: DataFrame) -> DataFrame:
    """doc_id and stuffed share of the ``pages`` (doc_id, text, lang) that are flagged and more than half stuffed.

    Null texts and texts without words are none, rows without doc_id take no part; a repeated doc_id comes out once for each
    of its texts that is stuffed.
    """
    return flagged_pages(pages).filter((F.col("deviation") >= EXTREME) & (F.col("share") > STUFFED)).select("doc_id", "share")
