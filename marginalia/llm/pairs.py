"""Problem 1: defective answers in prompt and response pairs; the prompt is a page, the response its summary.

Languages are told apart by character n-gram naive Bayes: the posterior of the page's languages for the summary must not vanish. A
summary without final stop is truncated unless the end-of-text n-grams of finished sentences say that it may end there. What
declines is learned, not listed: one more class of the same naive Bayes, fitted on summaries that hardly have a word in common
with their page; a summary is a refusal if it belongs there and its page doesn't support it either. The models are fitted on
all labelled chunks and all summaries. Of the contexts and words in the chunks, only those that summaries need are counted.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.languages import SPLIT, body_of, labelled_texts, sentences, split_at
from marginalia.llm.stuffing import words
from marginalia.tables import settle

#: Cells of the hashed n-gram table (a power of two), and the count added to each n-gram of the naive Bayes model.
LANGUAGE_BITS, ADDED = 18, 0.05
#: N-grams that ADDED refers to, at most.
SMOOTHED = 700_000
#: Cells of the filter that contexts and words pass before they are counted (a power of two); those counted in a task at once, and languages.
FILTER_BITS, COUNTED, COUNTED_LANGUAGES = 24, 1_000_000, 32
#: Contexts of an end, longest first: characters before it (0: those of the last word), and whether the words since the last
#: clause mark count too.
CONTEXTS = ((20, True), (12, True), (6, True), (6, False), (0, False), (3, False))
#: Weight of a shorter context's estimate in that of a longer one, estimate without context, and the least chance of a true end.
BACKOFF, PRIOR, LEAST_END = 3.0, 0.01, 0.02
#: Texts scored at once.
SLICE = 400
#: Code points that a page must have for its summary to be judged.
PAGE_CHARS = 16
#: Posterior of a page's languages under which a summary is in another one.
LEAST_POSTERIOR = 0.01
#: Rounds of learning what declines.
LEARNING_ROUNDS = 2
#: Summaries with their words that every task holds at most when pages are searched for them; more are joined by a shuffle.
HELD_ANSWERS = 50_000
#: A word that no text has weighs like one in so many of them, so that weights don't depend on how many texts there are.
RAREST = 600
#: Weighted share of a summary's words that its page has at least if it supports it; the share up to which declining is learned from
#: it; log odds of declining from which on it counts.
SUPPORT, LEARNED_SUPPORT, DECLINING_ODDS = 0.4, 0.2, 5.0

#: What stands for a summary that isn't there, without marks around it and in lower case.
PLACEHOLDERS = frozenset({
    "empty", "empty string", "empty page", "empty summary", "summary", "no summary", "no content", "none", "null", "nil", "n/a", "na", "nan", "blank",
    "nothing", "tbd", "todo", "leer", "kein inhalt", "sin contenido", "vacío", "vide", "aucun contenu", "vuoto", "nessun contenuto", "vazio",
    "sem conteúdo", "leeg", "geen inhoud", "пусто", "нет содержания", "空", "空页面", "空字符串", "无", "无内容",
})
#: Fixed value: the lines that the prompt around a page begins with.
PROMPT = re.compile(r"\s*page title:.*\n\s*content:", re.I)

#: Where ``fingerprints`` splits: behind a stop, or at line feeds.
PRINT_BREAK = re.compile(r"[.!?…][\"')\]»”’]*\s+|[。！？]|\n+")
HEADING = re.compile(r"[\s>*+-]*#{1,6}\s")
WORD_CHARS = re.compile(r"[\W_]+")
NO_WORD_BYTES = bytes(i for i in range(128) if not chr(i).isalnum())
STOP_CHARS, AFTER_STOP = ".!?。！？", "\"')]»”’」』）"
STOP = re.compile(rf"[{STOP_CHARS}]+[{re.escape(AFTER_STOP)}]*\s*$")
OPENERS, CLOSERS = "([{（「『„“«", {")": "([{（", "]": "[", "}": "{", "）": "（(", "」": "「", "』": "『", "”": "“„", "“": "„", "»": "«"}
ASIDE = re.compile(r"\s*[(（][^()（）]*[)）]\s*$")
#: What a clause begins behind, what it ends before, and what it ends before with or without a blank between.
MARKS, CLAUSE_ENDS, ASIDES = ",;:，；：、(（„“\"«\n", ",;，；\n", "(（"
DIGITS = re.compile(r"\d+")
#: Code point that stands before a sentence's first character; characters of a last word that count.
PAD, WORD_CONTEXT = 2, 16


def letters(text: str) -> str:
    """A text's letters and digits in lower case."""
    left = text.lower().encode("utf-8", "surrogatepass").translate(None, NO_WORD_BYTES)
    return left.decode() if left.isascii() else WORD_CHARS.sub("", left.decode("utf-8", "surrogatepass"))


def fingerprints(text: str, joined: bool = False) -> list[int]:
    """Hashes of the letters of a text's sentences and lines, each once.

    ``joined``: also those of headings together with the sentence below, which a copy on one line can't tell apart.
    """
    import xxhash

    parts = [p for p in split_at(PRINT_BREAK, text) if p and not p.isspace()]
    prints = {letters(p) for p in parts}
    if joined and "#" in text:
        prints |= {letters(a + b) for a, b in zip(parts, parts[1:]) if "#" in a and HEADING.match(a)}
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in sorted(prints) if p]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes spread over ``bits`` bits."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


# --- languages


def gram_cells(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table cells of the single characters and of the character trigrams that begin at each position."""
    after = np.concatenate([c[1:], [10, 10]]).astype(np.uint64)
    trigram = (c * np.uint64(0x1000003) + after[:-1]) * np.uint64(0x1000003) + after[1:]
    return mixed(c * np.uint64(0x9E3779B97F4A7C15), LANGUAGE_BITS), mixed(trigram * np.uint64(0x9E3779B97F4A7C15), LANGUAGE_BITS)


def language_scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log likelihood of each text in each language (columns of ``table``); empty texts score 0."""
    out = np.zeros((len(texts), table.shape[1]))
    filled = [i for i, t in enumerate(texts) if t]
    if filled:
        joined = "\n".join(texts[i].lower() for i in filled)
        lengths = [len(texts[i].lower()) + 1 for i in filled]
        one, three = gram_cells(codes(joined))
        out[filled] = np.add.reduceat(table.take(one, axis=0) + table.take(three, axis=0), np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
    return out


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the cells (of each column), given how often each was counted. ADDED weighs as in SMOOTHED n-grams if there
    are more: how unlikely what was never seen is doesn't depend on how much was read."""
    own = counts * np.minimum(1.0, SMOOTHED / np.maximum(counts.sum(axis=0), 1)) + ADDED
    return np.log(own / own.sum(axis=0)).astype(np.float32)


# --- ends


def unstopped(text: str) -> str | None:
    """What is before the final STOP of a text without outer blanks; None if it has none."""
    if text[-1:] not in STOP_CHARS:
        text = text.rstrip(AFTER_STOP)
    return text.rstrip(STOP_CHARS) if text and text[-1] in STOP_CHARS else None


def stripped(text: str) -> str:
    """A sentence without final stop and final aside, all numbers alike."""
    text = text.strip()
    if (found := unstopped(text)) is not None:
        text = found
    return DIGITS.sub("0", ASIDE.sub("", text) if text.rstrip()[-1:] in (")", "）") else text).lower()


@functools.cache
def code_points(of: Callable[[str], bool]) -> np.ndarray:
    """Whether ``of`` is true of each code point."""
    return np.array([of(chr(i)) for i in range(sys.maxunicode + 1)], dtype=bool)


#: Multiplier of the contexts' hash, its inverse (modulo 2 to the power 64), and the powers of both that were needed so far.
PRIME, INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of PRIME and of INVERSE."""
    if len(POWERS[0]) < n:
        POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, p, dtype=np.uint64)])) for p in (PRIME, INVERSE)]
    return [p[:n] for p in POWERS]


def context_keys(c: np.ndarray) -> tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray]]:
    """For each position of a text (its codes) how many characters of its word are before it, and a function of a context's number and positions
    that gives the hash of the context at each of them.

    A context is the difference of two prefix sums, so its length doesn't matter.
    """
    n = len(c)
    word = code_points(str.isalnum)[c]
    han = (c >= 0x3400) & (c <= 0x9FFF)
    begins = word & ~np.concatenate([[False], word[:-1]]) | han
    count = np.cumsum(begins)
    marks = np.isin(c, codes(MARKS))
    since = np.minimum(count - np.maximum.accumulate(np.where(marks, count, 0)), 15).astype(np.uint64)
    into = np.arange(n) - np.maximum.accumulate(np.where(begins | ~word, np.arange(n), 0))
    pad, mask = max(WORD_CONTEXT, *(k for k, _ in CONTEXTS)), (1 << 64) - 1
    up, down = powers(pad + n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate([np.full(pad, PAD, dtype=np.uint64), c]) * up[: pad + n])])

    def keys(i: int, at: np.ndarray) -> np.ndarray:
        k, clause = CONTEXTS[i]
        end = at + (pad + 1)
        own = (sums[end] - sums[end - (k or np.minimum(into[at] + 1, WORD_CONTEXT))]) * down[end - 1] * up[(k or WORD_CONTEXT) - 1]
        whole = own * np.uint64(16) + (since[at] if clause else np.uint64(0)) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & mask)
        whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (whole ^ (whole >> np.uint64(32))).view(np.int64)

    return into, keys


def end_keys(text: str) -> list[np.ndarray]:
    """For each context, the hash of it at the end of a text, as an array of one."""
    at, keys = np.array([len(text) - 1]), context_keys(codes(text))[1]
    return [keys(i, at) for i in range(len(CONTEXTS))]


def asked_for(keys: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Which ``keys`` a filter lets pass; all, if there is none."""
    if bits is None:
        return np.ones(len(keys), dtype=bool)
    cell = keys & ((1 << FILTER_BITS) - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def clause_ends(c: np.ndarray) -> np.ndarray:
    """Positions of the last characters of the clauses of a text (its codes)."""
    aside, blank = np.isin(c, codes(ASIDES)), code_points(str.isspace)[c]
    before = np.isin(c, codes(CLAUSE_ENDS)) | (aside | blank & np.append(aside[1:], False)) & ~np.append(False, blank[:-1])
    at = np.flatnonzero(before[1:])
    return at[c[at] != PAD]


def count_ends(texts: list[str], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that pass a filter, how often each occurs in finished sentences, and how often a clause ends there.

    The filter has every context of each end that it was made of. So a context is looked for only where the shorter one, which it ends
    with, passes.
    """
    found, closed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    finished = [t for s in texts if unstopped(s.rstrip()) is not None and len(t := stripped(s)) >= 5]
    gap = "\n" + chr(PAD) * max(k for k, _ in CONTEXTS)
    for first in range(0, len(finished), SLICE):
        text = "".join(gap + t for t in finished[first : first + SLICE]) + "\n"
        into, keys = context_keys(c := codes(text))
        for out, at in ((found, np.flatnonzero((c != PAD) & (c != 10))), (closed, clause_ends(c))):
            short = len(CONTEXTS) - 1
            own = keys(short, at)
            passed = asked_for(own, bits)
            out.append(own[passed])
            tried = at[passed]
            begun = at[passed | (into[at] < CONTEXTS[short][0] - 1)]  # a longer word ends with the shortest context
            for i in reversed(range(short)):
                own = keys(i, tried if CONTEXTS[i][0] else begun)
                passed = asked_for(own, bits)
                out.append(own[passed])
                tried = tried[passed] if CONTEXTS[i][0] else tried
    seen, n_seen = np.unique(np.concatenate(found), return_counts=True)
    ends, n_ends = np.unique(np.concatenate(closed), return_counts=True)
    keys = np.union1d(seen, ends)
    return keys, Counts(seen, n_seen).of(keys), Counts(ends, n_ends).of(keys)


@dataclass(frozen=True)
class Counts:
    """How often each of some sorted keys was counted."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0)


def end_chance(text: str, seen: Counts, ends: Counts) -> float:
    """Estimated chance that a sentence may end where this text does; longer contexts weigh as much as was seen of them.

    Once a context was never seen, no longer one can have been.
    """
    keys, p = np.concatenate(end_keys(text)), PRIOR
    for n_seen, n_ends in zip(reversed(seen.of(keys)), reversed(ends.of(keys))):
        if not n_seen:
            break
        p = (n_ends + BACKOFF * p) / (n_seen + BACKOFF)
    return float(p)


def last_of(text: str) -> str:
    """What a summary ends with, if its end must be judged by its context: empty if it has a final stop or aside."""
    if STOP.search(text) or ASIDE.search(text):  # nobody stops right behind a closed aside
        return ""
    return stripped(([p for p in SPLIT.split(text) if letters(p)] or [""])[-1])


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation is opened and never closed."""
    stack: list[str] = []
    for ch in text:
        if ch in CLOSERS and stack and stack[-1] in CLOSERS[ch]:
            stack.pop()
        elif ch in OPENERS:
            stack.append(ch)
    return bool(stack)


# --- models


@dataclass(frozen=True)
class Models:
    """Languages, their table of log probabilities (cell, language), the counts of contexts and ends, for each language how many
    texts it has and how many of them have each word (hashed), and the log probabilities of declining (None if unlearned)."""

    languages: list[str]
    table: np.ndarray
    seen: Counts
    ends: Counts
    texts: list[int]
    holding: list[Counts]
    declining: np.ndarray | None = None


def filter_of(notes: DataFrame) -> np.ndarray:
    """Bits of the contexts and words that the summaries of ``notes`` (page_title, summary) are judged by; its size is fixed."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << FILTER_BITS, dtype=bool)
        for rows in batches:
            known: set[str] = set()
            for text, title in zip(rows["summary"], rows["page_title"]):
                known.update(words(untitled(text, title)))
                if last := last_of(text):
                    cells[np.concatenate(end_keys(last)) & ((1 << FILTER_BITS) - 1)] = True
            cells[[word_hash(w) & ((1 << FILTER_BITS) - 1) for w in known]] = True
        yield pd.DataFrame({"cell": np.flatnonzero(cells)})

    marked = notes.filter("summary is not null").select("page_title", "summary").mapInPandas(mark, "cell int").distinct().toArrow()  # at most as many as the filter has
    cells = np.zeros(1 << FILTER_BITS, dtype=bool)
    cells[marked["cell"].to_numpy()] = True
    return np.packbits(cells, bitorder="little")


COUNTED_SCHEMA = "kind string, lang string, key long, a long, b long"


def fit(texts: DataFrame, labels: DataFrame, notes: DataFrame | None = None) -> Models:
    """Models from all ``texts`` (id, text) that have a label in ``labels`` (id, lang), wherever they are.

    What comes back are the cells that were hit, at most as many as the table has, and the counts of the contexts and words that the summaries of
    ``notes`` (page_title, summary) are judged by (a context of each length for a summary without final stop, and their vocabulary), or of all.
    """
    bits = None if notes is None else filter_of(notes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        holding: dict[str, Counter] = defaultdict(Counter)
        n_texts: Counter = Counter()

        def counted() -> pd.DataFrame:
            parts = [("text", lang, [0], [n], [0]) for lang, n in n_texts.items()]
            parts += [("gram", lang, at, own[at], 0 * at) for lang, own in grams.items() for at in [np.flatnonzero(own)]]
            for lang, own in holding.items():
                keys, n = np.array([word_hash(w) for w in own]), np.array(list(own.values()))
                passed = asked_for(keys, bits)
                parts.append(("word", lang, keys[passed], n[passed], 0 * n[passed]))
            for x in (grams, holding, n_texts):
                x.clear()
            return frame(parts)

        def frame(parts: list[tuple]) -> pd.DataFrame:
            sizes = [len(p[2]) for p in parts]
            column = lambda i: np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64)
            named = lambda i: np.repeat(np.array([p[i] for p in parts], dtype=object), sizes)
            return pd.DataFrame({"kind": named(0), "lang": named(1), "key": column(2), "a": column(3), "b": column(4)})

        for rows in batches:
            prose: dict[str, list[str]] = defaultdict(list)
            for text, lang in zip(rows["text"], rows["lang"]):
                body = body_of(text)
                prose[lang] += sentences(body)
                if own := set(words(body)):
                    holding[lang].update(own)
                n_texts[lang] += 1
            for lang, own in prose.items():
                cells = np.concatenate(gram_cells(codes("\n".join(own).lower())))
                grams[lang] = grams.get(lang, 0) + np.bincount(cells, minlength=1 << LANGUAGE_BITS)
            keys, seen, ends = count_ends([s for own in prose.values() for s in own], bits)
            yield frame([("end", "", keys, seen, ends)])
            if len(grams) > COUNTED_LANGUAGES or sum(map(len, holding.values())) > COUNTED:
                yield counted()
        yield counted()

    every = labelled_texts(texts, labels).select("text", "lang").mapInPandas(count, COUNTED_SCHEMA)
    found = every.groupBy("kind", "lang", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow().to_pandas().sort_values(["kind", "lang", "key"])
    numbers = lambda rows, name: rows[name].to_numpy()
    of = lambda kind, lang="": found[(found["kind"] == kind) & (found["lang"] == lang)]
    languages = sorted(found["lang"][found["kind"] == "text"])
    counts = np.zeros((1 << LANGUAGE_BITS, max(1, len(languages))))  # nothing is labelled: no language can be told from another
    for i, lang in enumerate(languages):
        own = of("gram", lang)
        counts[numbers(own, "key"), i] += numbers(own, "a")
    keys, seen, ends = (numbers(of("end"), name) for name in ("key", "a", "b"))
    n_texts = [int(of("text", lang)["a"].iloc[0]) for lang in languages] or [0]
    holding = [Counts(numbers(own, "key"), numbers(own, "a")) for lang in languages or [""] for own in [of("word", lang)]]
    return Models(languages or ["und"], log_shares(counts), Counts(keys, seen), Counts(keys, ends), n_texts, holding)


# --- support and declining


def untitled(text: str, title: str | None) -> str:
    """A summary without the title of its page, which says nothing about having read it."""
    return text.replace(title, " ") if title else text


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) - (1 << 63)


class WordHashes(dict):
    """The hashes of words, each computed once as long as they are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= COUNTED:
            self.clear()
        self[word] = found = word_hash(word)
        return found


def weighed_words(text: str, title: str | None, language: int, models: Models) -> dict[int, float]:
    """Hashes of a summary's words, weighing what they tell: the smaller the share of the language's texts that have a word, the more."""
    hashes = np.array([word_hash(w) for w in sorted(set(words(untitled(text, title))))], dtype=np.int64)
    n = models.texts[language]
    scale = min(n, RAREST)
    return dict(zip(hashes.tolist(), np.log((scale + 1) / (models.holding[language].of(hashes) * scale / max(n, 1) + 1)).tolist()))


def support(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """note_id and support of each row of ``asked`` (note_id, words, weights) that has a page in ``chunks`` (note_id, text): the weighted
    share of its words that the page has, 1 without words. Texts meet their note's words only; each chunk tells which it has."""

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for rows in batches:
            out = {}
            for note_id, text, wanted, weights in zip(rows["note_id"], rows["text"], rows["words"], rows["weights"]):
                own = set(map(hashes.__getitem__, set(words(body_of(text)))))
                out |= {(note_id, w): x for w, x in zip(wanted.tolist(), weights.tolist()) if w in own}
            keys = np.array(list(out), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"note_id": keys[:, 0], "word": keys[:, 1], "weight": np.array(list(out.values()), dtype=np.float64)})

    few = asked.limit(HELD_ANSWERS + 1).count() <= HELD_ANSWERS
    met = chunks.filter("text is not null").select("note_id", "text").join(F.broadcast(asked) if few else asked, "note_id")
    found = met.mapInPandas(held, "note_id long, word long, weight double").groupBy("note_id", "word").agg(F.max("weight").alias("weight"))
    sums = found.groupBy("note_id").agg(F.sum("weight").alias("held"))
    whole = F.aggregate("weights", F.lit(0.0), lambda t, x: t + x)
    share = F.when(whole > 0, F.coalesce("held", F.lit(0.0)) / whole).otherwise(1.0)
    return asked.join(sums, "note_id", "left").select("note_id", share.alias("support"))


def declining_odds(texts: list[str], scores: np.ndarray, declining: np.ndarray) -> np.ndarray:
    """Log odds of declining against the best language for texts with language ``scores``; texts without letters have none."""
    return np.where([bool(letters(t)) for t in texts], language_scores(texts, declining[:, None])[:, 0] - scores.max(axis=1), -np.inf)


def learn_declining(notes: DataFrame, chunks: DataFrame, models: Models) -> Models:
    """``models`` with the class of declining answers, learned from all ``notes`` (note_id, page_title, summary): from those that
    their pages don't support, in each round but the first only from those that declined in the last one."""
    table = models.table

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [untitled(t, title) for t, title in zip(rows["summary"], rows["page_title"])]
            best = language_scores(texts, table).argmax(axis=1)
            asked = [weighed_words(t, None, int(lang), models) for t, lang in zip(texts, best)]
            yield pd.DataFrame({"note_id": rows["note_id"], "text": texts, "words": [list(a) for a in asked], "weights": [list(a.values()) for a in asked]})

    def count(declining: np.ndarray | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros(1 << LANGUAGE_BITS, np.int64)
            for rows in batches:
                texts = np.array([t for t in rows["text"] if letters(t)], dtype=object)
                if declining is not None:
                    texts = texts[declining_odds(texts.tolist(), language_scores(texts.tolist(), table), declining) > DECLINING_ODDS]
                if len(texts):
                    found += np.bincount(np.concatenate(gram_cells(codes("\n".join(texts).lower()))), minlength=1 << LANGUAGE_BITS)
            at = np.flatnonzero(found)
            yield pd.DataFrame({"cell": at, "grams": found[at]})

        return grams

    named = F.lower(F.regexp_replace("summary", r"(?U)^[\W_]+|[\W_]+$", ""))
    told = notes.filter(F.col("summary").isNotNull() & ~named.isin("", *PLACEHOLDERS)).select("note_id", "page_title", "summary").dropDuplicates(["note_id"])
    asked = settle(told.mapInPandas(weigh, "note_id long, text string, words array<long>, weights array<double>"))
    held = support(asked.drop("text"), chunks)
    poor = settle(asked.select("note_id", "text").join(held.filter(F.col("support") < LEARNED_SUPPORT), "note_id").select("text"))
    declining = None
    for _ in range(LEARNING_ROUNDS):
        found = poor.mapInPandas(count(declining), "cell int, grams long").groupBy("cell").agg(F.sum("grams").alias("grams")).toArrow()  # cells of the table
        if not found.num_rows and declining is None:
            return models
        counts = np.zeros(1 << LANGUAGE_BITS)
        counts[found["cell"].to_numpy()] = found["grams"].to_numpy()
        declining = log_shares(counts)
    return replace(models, declining=declining)


# --- pairs


def pages(chunks: DataFrame, models: Models) -> DataFrame:
    """Of each page (``chunks``: note_id, text): chars, and the numbers of its languages.

    Its languages are those in which some chunk has a run of two sentences, or else the best one for all its text.
    """
    n, table = len(models.languages), models.table

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), SLICE):
                part = rows.iloc[start : start + SLICE]
                bodies = [body_of(t or "") for t in part["text"]]
                split = [sentences(b) or [b] for b in bodies]
                scores = language_scores([s for parts in split for s in parts], table)
                best, at, runs = scores.argmax(axis=1).tolist(), 0, []
                starts = np.cumsum([0, *map(len, split)])[:-1]
                sums = np.add.reduceat(scores, starts, axis=0)
                for parts, total in zip(split, sums):
                    own = best[at : at + len(parts)]
                    found = {a for a, b in zip(own, own[1:]) if a == b}  # runs of two sentences
                    runs.append(sorted(found) or ([int(total.argmax())] if len(own) > 1 else []))
                    at += len(parts)
                out = {"note_id": part["note_id"].to_numpy(), "chars": [len(b) for b in bodies], "runs": runs}
                yield pd.DataFrame(out | {f"l{i}": sums[:, i] for i in range(n)})

    schema = "note_id long, chars long, runs array<int>, " + ", ".join(f"l{i} double" for i in range(n))
    scored = chunks.select("note_id", "text").mapInPandas(read, schema)
    runs = F.array_distinct(F.flatten(F.collect_set("runs")))  # the few sets of languages that chunks have
    summed = scored.groupBy("note_id").agg(F.sum("chars").alias("chars"), runs.alias("runs"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(n)))
    totals = F.array(*(F.col(f"l{i}") for i in range(n)))
    best = F.array((F.array_position(totals, F.array_max(totals)) - 1).cast("int"))
    return summed.select("note_id", "chars", F.when(F.size("runs") > 0, F.col("runs")).otherwise(best).alias("languages"))


def prints(rows: DataFrame, of: str, page: bool) -> DataFrame:
    """(note_id, print) for each sentence of a text column; of ``page`` texts without their title lines, headings also joined."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            marked = [fingerprints(body_of(t), joined=True) if page else fingerprints(t) for t in part[of].fillna("")]
            yield pd.DataFrame({"note_id": part["note_id"], "prints": marked})

    marked = rows.select("note_id", of).mapInPandas(mark, "note_id long, prints array<long>")
    return marked.select("note_id", F.explode("prints").alias("print"))


ANSWERED = "note_id long, defect string, scores array<float>, declines boolean, words array<long>, weights array<double>, truncated boolean"


def answers(notes: DataFrame, models: Models) -> DataFrame:
    """What each summary (``notes``: note_id, page_title, summary) shows by itself: defect (empty, copy or none), log likelihoods of
    the languages, whether it is declining (its words and weights then show whether its page supports it), and whether it is truncated."""
    table, seen, ends = models.table, models.seen, models.ends

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t or "" for t in rows["summary"]]
            bare = [untitled(t, title) for t, title in zip(texts, rows["page_title"])]
            scores, bare_scores, out = language_scores(texts, table), language_scores(bare, table), []
            odds = np.full(len(texts), -np.inf) if models.declining is None else declining_odds(bare, bare_scores, models.declining)
            for i, (note_id, title, text) in enumerate(zip(rows["note_id"], rows["page_title"], texts)):
                plain = letters(text)
                named = re.sub(r"^[\W_]+|[\W_]+$", "", text).lower()
                defect = None
                if not plain or named in PLACEHOLDERS:
                    defect = "empty"
                elif plain == letters(title or "") or PROMPT.match(text):
                    defect = "copy"
                declines, asked = not defect and odds[i] > DECLINING_ODDS, {}
                if declines:
                    asked = weighed_words(text, title, int(bare_scores[i].argmax()), models)
                broken = False
                if not defect and unclosed(text):
                    broken = True
                elif not defect and (last := last_of(text)):
                    broken = end_chance(last, seen, ends) < LEAST_END
                out.append((note_id, defect, scores[i], bool(declines), list(asked), list(asked.values()), broken))
            yield pd.DataFrame(out, columns=["note_id", "defect", "scores", "declines", "words", "weights", "truncated"])

    return notes.select("note_id", "page_title", "summary").mapInPandas(judge, ANSWERED)


def posterior(scores: Column, languages: Column) -> Column:
    """Posterior of ``languages`` (numbers) together, given log likelihoods of all of them."""
    best = F.array_max(scores)
    likelihood = lambda s: F.exp((s - best).cast("double"))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda t, s: t + likelihood(s))
    return total(F.transform(languages, lambda i: F.element_at(scores, i + 1))) / total(scores)


def defective(notes: DataFrame, chunks: DataFrame, models: Models) -> DataFrame:
    """note_id and defect of the pairs with a defect; the first that applies of empty, refusal, copy, language, truncated.

    ``notes``: note_id, page_title, summary; ``chunks``: note_id, text. A summary whose every sentence stands in its page
    is a copy. Notes without chunks, or with less than PAGE_CHARS code points in them, aren't judged; null summaries are
    empty, null titles and texts count as empty, rows without note_id take no part. Repeated rows count once; where a note_id
    comes with several summaries, each is judged, and refused if any of the declining ones isn't supported. Without any
    labelled text no summary is in a foreign language.
    """
    notes, chunks = notes.filter("note_id is not null"), chunks.filter("note_id is not null")
    known = pages(chunks, models).filter(F.col("chars") >= PAGE_CHARS)
    held = prints(chunks, "text", page=True).distinct().withColumn("held", F.lit(1))
    asked = prints(notes, "summary", page=False).join(held, ["note_id", "print"], "left")
    repeated = asked.groupBy("note_id").agg((F.count("held") == F.count("*")).alias("repeated"))
    told = settle(answers(notes, models))
    refused = support(told.filter("declines").select("note_id", "words", "weights"), chunks).filter(F.col("support") < SUPPORT)
    refused = refused.select("note_id", F.lit(True).alias("refused")).distinct()
    both = told.drop("words", "weights").join(known, "note_id").join(repeated, "note_id", "left").join(refused, "note_id", "left")
    defect = (
        F.when(F.col("defect") == "empty", "empty")
        .when(F.col("declines") & F.col("refused"), "refusal")
        .when((F.col("defect") == "copy") | F.col("repeated"), "copy")
        .when(posterior(F.col("scores"), F.col("languages")) < LEAST_POSTERIOR, "language")
        .when(F.col("truncated"), "truncated")
    )
    return both.select("note_id", defect.alias("defect")).filter("defect is not null").distinct()
