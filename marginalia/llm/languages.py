"""Problem 3: the language of each text, and of each segment of a mixed one.

Every language is a unigram model over the pieces of one fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, found by the forward algorithm; words are independent, so a worker computes each word
once. The models are fitted by expectation maximisation on a bounded sample of labelled texts; everything else covers
all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tokens import TOKENIZERS

#: Vocabulary whose pieces the models share.
PIECES = "piece_bpe_32k.model"
#: Labelled texts of each language that its model is fitted on, at most.
SAMPLE = 600
#: Rounds of expectation maximisation; share of the probability spread evenly over all pieces.
ROUNDS, EVEN = 3, 0.05
#: Least probability of a character that is no piece, characters of a word that is learned from as a whole, and those after which sums are scaled.
UNKNOWN, WORD_CHARS, SCALED = 1e-9, 30, 16
#: Words that a worker remembers.
REMEMBERED = 400_000
#: Sentences shorter than this many characters (or Han characters) are phrases; a segment has so many sentences at least.
SENTENCE_CHARS, SENTENCE_HAN, SEGMENT_SENTENCES = 12, 4, 2

#: Three-letter codes and English names of the languages of the tables. Two-letter codes stand for themselves.
LANGUAGE_NAMES = {
    "deu": "de", "ger": "de", "german": "de",
    "eng": "en", "english": "en",
    "spa": "es", "spanish": "es",
    "fra": "fr", "fre": "fr", "french": "fr",
    "ita": "it", "italian": "it",
    "nld": "nl", "dut": "nl", "dutch": "nl",
    "por": "pt", "portuguese": "pt",
    "rus": "ru", "russian": "ru",
    "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh",
}
#: Codes that name no language.
NO_LANGUAGE = ("", "-", "und", "mul", "mis", "zxx", "xx", "unk", "unknown", "none", "null", "n/a")


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any of its spellings; null if it names no language, itself if the name isn't known."""
    plain = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_ ]*)", 1)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.when(~F.lower(F.trim(label)).isin(*NO_LANGUAGE) & ~plain.isin(*NO_LANGUAGE), F.coalesce(F.try_element_at(known, plain), plain))


# --- text to sentences


HAN = "㐀-鿿"
TITLE = re.compile(r"\A\s*# [^\n]*\n?")
BLOCK = re.compile(
    r"```.*?(?:```|\Z)|\#\+BEGIN_QUERY.*?(?:\#\+END_QUERY|\Z)"  # code and queries
    r"|^[ \t]*\|[^\n]*$|^[ \t>*+-]*\#{1,6}[ \t][^\n]*$|^[ \t]*(?:[-*][ \t]+)?[A-Za-z][\w-]*::[^\n]*$",  # tables, headings, properties
    re.S | re.M | re.I,
)
FENCE_MARKS = re.compile(r"```|#\+BEGIN_QUERY", re.I)
BLOCK_LINE = re.compile(r"[ \t]*\||[ \t>*+-]*#{1,6}[ \t]|[ \t]*(?:[-*][ \t]+)?[A-Za-z][\w-]*::", re.I)
INLINE = re.compile(r"!?\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\s]*\)|<?(?:https?://|www\.)[^\s>)]+>?|(?<!\w)#\w\S*|\(\([\w-]+\)\)|\{\{[^}\n]*\}\}|[A-Za-z0-9+/=_-]{40,}")
INLINE_MARKS, INLINE_CHARS = ("[", "#", "://", "www.", "((", "{{"), 40
SPLIT = re.compile(rf"(?<=[.!?…])[\"')\]»”’]*\s+|(?<=[。！？])[\"')\]」』”’）]*|\n+")
#: SPLIT with the stop that it stands behind, which is quicker to search for.
BREAK = re.compile(r"[.!?…][\"')\]»”’]*\s+|[。！？][\"')\]」』”’）]*|\n+")
#: What a text has if it may be split elsewhere than at line feeds and blanks behind a stop: closing marks behind stops, other blanks, Han stops.
ODD_ASCII = (*(a + b for a in ".!?" for b in "\"')]"), *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
ODD_OTHERS = (*(a + b for a in ".!?…" for b in "\"')]»”’" if not (a + b).isascii()), *(chr(i) for i in range(128, 0x10000) if chr(i).isspace()), *"。！？")
HAN_CHAR = re.compile(f"[{HAN}]")


def split_at(breaks: re.Pattern, text: str) -> list[str]:
    """Parts of a text between ``breaks`` (BREAK or one that differs behind Han stops only), some with blanks around them.

    Each break is line feeds or begins with the last character of the part before it.
    """
    if not any(x in text for x in ODD_ASCII) and (text.isascii() or not any(x in text for x in ODD_OTHERS)):
        return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").replace("… ", "…\n").split("\n")
    out, at = [], 0
    for m in breaks.finditer(text):
        start, end = m.span()
        out.append(text[at : start if text[start] == "\n" else start + 1])
        at = end
    out.append(text[at:])
    return out


def body_of(text: str) -> str:
    """A chunk's text without its title line."""
    return TITLE.sub("", text, count=1).strip()


def without_blocks(body: str) -> str:
    """A body with every BLOCK replaced by a line feed; without fences, blocks are lines and told by how these begin."""
    if "#" in body or "`" in body:
        if FENCE_MARKS.search(body):
            return BLOCK.sub("\n", body)
    elif "|" not in body and "::" not in body:
        return body
    return "\n".join("\n" if BLOCK_LINE.match(line) else line for line in body.split("\n"))


def without_inline(text: str) -> str:
    """A text with every INLINE stretch replaced by a blank; most texts have neither a mark of one nor a word that is long enough."""
    marked = lambda part: any(m in part for m in INLINE_MARKS)
    long = lambda part: max(map(len, part.split(" "))) >= INLINE_CHARS
    if not marked(text) and not long(text):
        return text
    odd = lambda line: marked(line) or long(line)
    return "\n".join(INLINE.sub(" ", line) if odd(line) else line for line in text.split("\n"))


def sentences(body: str) -> list[str]:
    """Sentences of prose, without code, queries, tables, headings, properties, links and blobs; phrases are left out."""
    parts = (p.strip() for p in split_at(BREAK, without_inline(without_blocks(body))))
    return [p for p in parts if len(p) >= SENTENCE_CHARS or len(p) >= SENTENCE_HAN and len(HAN_CHAR.findall(p)) >= SENTENCE_HAN]


# --- unigram models


class Vocabulary:
    """Pieces of the public vocabulary, and the words that texts are cut into for them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.size = len(pieces)
        self.ids = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.longest = max(map(len, self.ids))
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = {p for p in self.ids if re.fullmatch(f"[{HAN}]{{2,}}", p)}
        self.joined_sizes = sorted({len(p) for p in self.joined})
        self.word = re.compile(f"[{HAN}]+|[^\\W\\d_{HAN}]+")

    def words(self, text: str) -> list[str]:
        """Stretches of a text whose segmentations don't depend on each other: words, and the clusters of its Han text."""
        out: list[str] = []
        for word in self.word.findall(text.lower()):
            if HAN_CHAR.match(word):
                out += self.clusters(word)
            else:
                out.append(word)
        return out

    def clusters(self, run: str) -> list[str]:
        """A run of Han text, which has no word limits, cut wherever no piece spans: there every segmentation is cut."""
        out, start, reach = [], 0, 0
        for i in range(len(run)):
            if i > start and i >= reach:
                out.append(run[start:i])
                start = i
            reach = max([reach, *(i + n for n in self.joined_sizes if run[i : i + n] in self.joined)])
        return [*out, run[start:]]

    def arcs(self, word: str) -> list[tuple[int, int, list[int]]]:
        """Stretches (start, end, piece ids) of a word; a character that is no piece stands for its bytes."""
        text = word if HAN_CHAR.match(word) else "▁" + word
        out = []
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + self.longest) + 1):
                if (piece := self.ids.get(text[a:b])) is not None:
                    out.append((a, b, [piece]))
                elif b == a + 1:
                    out.append((a, b, [self.bytes[x] for x in text[a].encode("utf-8", "replace")]))
        return out


def stretches(word: str) -> list[str]:
    """A word, or its parts if it is too long to learn from as a whole."""
    return [word[i : i + WORD_CHARS] for i in range(0, len(word), WORD_CHARS)]


def arc_probability(p: np.ndarray, pieces: list[int]) -> np.ndarray:
    return p[pieces[0]] if len(pieces) == 1 else np.maximum(p[pieces].prod(axis=0), UNKNOWN)


def word_score(vocabulary: Vocabulary, p: np.ndarray, word: str) -> np.ndarray:
    """Log probability of a word in each language (columns of ``p``), summed over its segmentations, however long it is.

    Arcs come by their start, so a position's sum is complete when its first arc is reached; it is then divided out of what
    is still open, which keeps the numbers of a long word in range.
    """
    arcs, total = vocabulary.arcs(word), np.zeros(p.shape[1])
    forward = np.zeros((arcs[-1][1] + 1, p.shape[1]))
    forward[0], done = 1, 0
    for a, b, pieces in arcs:
        if a - done >= SCALED:
            scale = forward[a].copy()
            forward[a : a + vocabulary.longest + 1] /= scale
            total, done = total + np.log(scale), a
        forward[b] += forward[a] * arc_probability(p, pieces)
    return total + np.log(forward[-1])


def fit_language(vocabulary: Vocabulary, counts: dict[str, int]) -> dict[int, float]:
    """Piece probabilities of one language from its word counts, by expectation maximisation over segmentations."""
    p = np.full((vocabulary.size, 1), 1 / vocabulary.size)
    lattices = [(n, vocabulary.arcs(part)) for word, n in counts.items() for part in stretches(word)]
    for _ in range(ROUNDS):
        expected = np.zeros(vocabulary.size)
        for n, arcs in lattices:
            weights = [float(arc_probability(p, pieces)[0]) for _, _, pieces in arcs]
            end = arcs[-1][1]
            forward, backward = [1.0] + [0.0] * end, [0.0] * end + [1.0]
            for (a, b, _), w in zip(arcs, weights):
                forward[b] += forward[a] * w
            for (a, b, _), w in zip(reversed(arcs), reversed(weights)):
                backward[a] += backward[b] * w
            for (a, b, pieces), w in zip(arcs, weights):
                share = n * forward[a] * w * backward[b] / forward[-1]
                for piece in pieces:
                    expected[piece] += share
        p = (1 - EVEN) * expected[:, None] / max(expected.sum(), 1e-300) + EVEN / vocabulary.size
    seen = np.flatnonzero(expected > 0)
    return dict(zip(seen.tolist(), p[seen, 0].tolist()))


def labelled_texts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``texts`` (id, text) with each label (id, lang) that names a language."""
    named = labels.select("id", language_code(F.col("lang")).alias("lang")).filter("lang rlike '^[a-z]{2}$'").distinct()
    return texts.filter("text is not null").join(named, "id")


def training_texts(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``texts`` (id, text) with a label (id, lang) that names a language: ``sample`` of each at most, by hashed id.

    Only two-letter codes name a language that can be learned: a name that isn't known may be another word for one that is.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    named = labels.select("id", language_code(F.col("lang")).alias("lang")).filter("lang rlike '^[a-z]{2}$'").distinct()
    chosen = named.withColumn("rank", rank).filter(F.col("rank") <= sample).drop("rank")
    return texts.filter("text is not null").join(F.broadcast(chosen), "id")


def fit(texts: DataFrame, labels: DataFrame, folder: str = TOKENIZERS, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (a column each), from ``texts`` (id, text) and ``labels`` (id, lang).

    Each language is fitted on its ``training_texts`` by one task. What comes back is bounded by the vocabulary.
    """
    path = f"{folder}/{PIECES}"

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = Vocabulary(path)
        counts = Counter(w for text in rows["text"] for s in sentences(body_of(text)) for w in vocabulary.words(s))
        fitted = fit_language(vocabulary, counts) if counts else {}
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "piece": list(fitted), "p": list(fitted.values())})

    learned = training_texts(texts, labels, sample).groupBy("lang").applyInPandas(train, "lang string, piece int, p double")
    rows = learned.collect()
    languages = sorted({r["lang"] for r in rows})
    languages = languages or ["und"]  # nothing is labelled: no language can be told from another
    p = np.full((Vocabulary(path).size, len(languages)), EVEN / Vocabulary(path).size)
    for r in rows:
        p[r["piece"], languages.index(r["lang"])] = r["p"]
    return languages, p


# --- segments


def segments(langs: list[int], scores: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Segments of a text (language, summed scores) from the languages and scores of its sentences in reading order.

    Runs of at least two sentences are segments; single sentences between them neither form nor end one. A text without
    such a run is one segment in the language that scores best over all of it.
    """
    runs: list[list[int]] = []
    for i, lang in enumerate(langs):
        if runs and langs[runs[-1][0]] == lang:
            runs[-1].append(i)
        else:
            runs.append([i])
    runs = [r for r in runs if len(r) >= SEGMENT_SENTENCES]
    if not runs:
        total = scores.sum(axis=0)
        return [(int(total.argmax()), total)]
    out: list[tuple[int, np.ndarray]] = []
    for run in runs:
        lang, total = langs[run[0]], scores[run].sum(axis=0)
        if out and out[-1][0] == lang:
            out[-1] = (lang, out[-1][1] + total)
        else:
            out.append((lang, total))
    return out


SEGMENTS = "id long, chars int, segments array<struct<lang:string,confidence:double>>"


def identify(texts: DataFrame, languages: list[str], p: np.ndarray, folder: str = TOKENIZERS) -> DataFrame:
    """Language segments of each text of ``texts`` (id, text): id, chars of the body, segments (lang, confidence).

    Confidence is the posterior of the language, all being equally likely before. Null texts count as empty. Texts
    without sentences are judged by whatever letters they have; without any letter they have no segment.
    """
    path = f"{folder}/{PIECES}"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(path)
        index: dict[str, int] = {}
        table = np.zeros((1024, len(languages)))
        for rows in batches:
            if len(index) > REMEMBERED:
                index.clear()
            flat: list[int] = []
            starts, counts, chars = [], [], []
            for text in rows["text"]:
                body = body_of(text or "")
                parts = [w for s in sentences(body) if (w := vocabulary.words(s))] or [w for w in [vocabulary.words(body)] if w]
                chars.append(len(body))
                counts.append(len(parts))
                for words in parts:
                    starts.append(len(flat))
                    for word in words:
                        at = index.get(word)
                        if at is None:
                            at = index[word] = len(index)
                            if at >= len(table):
                                table = np.concatenate([table, np.zeros_like(table)])
                            table[at] = word_score(vocabulary, p, word)
                        flat.append(at)
            scores = np.add.reduceat(table[flat], starts, axis=0) if starts else np.zeros((0, len(languages)))
            best = scores.argmax(axis=1).tolist() if starts else []
            out, at = [], 0
            for n in counts:
                found = []
                for lang, total in segments(best[at : at + n], scores[at : at + n]) if n else ():
                    found.append({"lang": languages[lang], "confidence": float(1 / np.exp(total - total[lang]).sum())})
                out.append(found)
                at += n
            yield pd.DataFrame({"id": rows["id"], "chars": chars, "segments": out})

    return texts.select("id", "text").mapInPandas(judge, SEGMENTS)


def labelled_segments(texts: DataFrame, labels: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Segments of all ``texts`` (id, text) with what their ``labels`` (id, lang) say: id, chars, seg, lang, confidence, label_state.

    label_state: "right" (all labels of the text name its only language), "mixed" (the text has several segments),
    "missing" (no label, or none that names a language), "wrong". Rows without id take no part, repeated rows count once.
    Without any labelled text every language is "und".
    """
    texts = texts.filter("id is not null")
    judged = identify(texts, *fit(texts, labels, folder), folder).dropDuplicates(["id"])
    codes = labels.groupBy("id").agg(F.collect_set(language_code(F.col("lang"))).alias("codes"))  # the few labels of one text
    n, first = F.size("segments"), F.try_element_at("segments", F.lit(1))["lang"]
    state = (
        F.when(n > 1, "mixed")
        .when(F.coalesce(F.size("codes"), F.lit(0)) <= 0, "missing")
        .when(F.forall("codes", lambda c: c.eqNullSafe(first)), "right")
        .otherwise("wrong")
    )
    joined = judged.join(codes.filter("id is not null"), "id", "left").withColumn("label_state", state)
    return joined.select("id", "chars", "label_state", F.posexplode("segments").alias("seg", "s")).select("id", "chars", "seg", "s.lang", "s.confidence", "label_state")
