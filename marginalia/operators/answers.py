"""Recorded answers: event streams put together, their citations checked, the context they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators.search import with_texts
from marginalia.operators.summarize import Chat, answered
from marginalia.tables import settle

#: Score below which an answer's sources are weak, sources and question characters allowed, excerpt of a source.
CONFIDENT, MOST_SOURCES, QUESTION_CHARS, EXCERPT_CHARS = 0.020, 8, 4000, 2400
MARKER = r"\[(\d+)\]"
META = "question string, sources array<struct<n:int,note_id:bigint,title:string>>, confidence string"


def markers(answer: Column) -> Column:
    """Numbers of the [n] marks of a text, each once, ascending; numbers too large for an int are left out."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def assembled(events: DataFrame) -> DataFrame:
    """One row for each ask of ``events`` (ask_id, seq, event, data, sent_at, received_at): question, sources, answer, claimed
    citations, whether it ended, and late events.

    Exact duplicates count once. Deltas join in order of seq, however late they came; null data adds nothing.
    """
    rows = events.distinct()
    kind, data = F.col("event"), F.col("data")
    delta = F.get_json_object(F.when(kind == "delta", data), "$.text")
    late = F.col("received_at") > F.col("sent_at") + F.expr("INTERVAL 1 MINUTE")
    grouped = rows.groupBy("ask_id").agg(
        F.max(F.when(kind == "meta", data)).alias("meta"),
        F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct("seq", delta.alias("text"))))).alias("deltas"),  # the events of one answer
        F.max(F.when(kind == "done", data)).alias("done"),
        F.bool_or(kind == "error").alias("failed"),
        F.count_if(late).alias("late"),
    )
    opened, closed = F.from_json("meta", META), F.from_json("done", "answered boolean, cited array<int>")
    return grouped.select(
        "ask_id", opened["question"].alias("question"), opened["sources"].alias("sources"), F.array_join(F.col("deltas.text"), "").alias("answer"),
        closed["answered"].alias("claimed_answered"), closed["cited"].alias("claimed"), "failed", "late",
    )


def checked_citations(answers: DataFrame) -> DataFrame:
    """``answers`` with what they really cite: cited (sources that exist), invalid (that don't), answered, and whether the claim holds."""
    numbers = F.coalesce(F.transform("sources", lambda s: s["n"]), F.array().cast("array<int>"))
    named = markers(F.col("answer"))
    out = answers.withColumn("cited", F.array_intersect(named, numbers)).withColumn("invalid", F.array_except(named, numbers))
    claim = F.array_sort(F.coalesce("claimed", F.array().cast("array<int>")))
    return out.withColumn("answered", F.size("cited") > 0).withColumn("claim_holds", claim == F.col("cited"))


def cited_notes(checked: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each citation of a source that exists: ask_id, n, note_id, title, and whether a note of that id and title is stored."""
    source = F.explode(F.filter("sources", lambda s: F.array_contains(F.col("cited"), s["n"]))).alias("s")
    cited = checked.select("ask_id", source).select("ask_id", "s.n", "s.note_id", "s.title")
    plain = lambda c: F.replace(c, F.lit("%2F"), F.lit("/"))
    known = notes.select("note_id", plain(F.col("page_title")).alias("stored"))
    return cited.join(known, "note_id", "left").withColumn("known", F.coalesce(F.col("stored") == plain(F.col("title")), F.lit(False))).drop("stored")


def protocol_breaks(events: DataFrame) -> DataFrame:
    """Asks whose events, in order of seq, aren't a meta, then deltas, then done, or a single error: ask_id, events."""
    rows = events.distinct()
    code = F.when(F.col("event") == "meta", "m").when(F.col("event") == "delta", "t").when(F.col("event") == "done", "d").when(F.col("event") == "error", "e").otherwise("?")
    order = rows.groupBy("ask_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", code.alias("code")))), lambda s: s["code"]), "").alias("events"))
    return order.filter(~F.col("events").rlike("^(mt*d|mt*e|e)$"))


def contexts(hits: DataFrame, chunks: DataFrame, k: int = MOST_SOURCES) -> DataFrame:
    """What a model is shown for each query of ``hits`` (term, rank, title, chunk_id, score, summary): term, sources, context, confidence.

    At most ``k`` (1 to 8) sources, numbered from 1: title, summary if there is one, and the clipped chunk without its title.
    """
    k = min(max(k, 1), MOST_SOURCES)
    shown = with_texts(settle(hits.filter(F.col("rank") < k)), chunks)
    body = text.clipped(text.trimmed(text.without_title(F.col("text"), F.col("title"))), EXCERPT_CHARS)
    part = F.concat(
        F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")),
        F.coalesce(F.concat(F.lit("\nSummary: "), "summary"), F.lit("")), F.coalesce(F.concat(F.lit("\nExcerpt: "), body), F.lit("")),
    )
    grouped = shown.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"), F.max("score").alias("top"))
    confidence = F.when(F.col("top") < CONFIDENT, "low").otherwise("high")
    return grouped.select("term", F.size("parts").alias("sources"), F.array_join(F.col("parts.part"), "\n\n").alias("context"), confidence.alias("confidence"))


#: What a model is told before the question; the second where the sources are weak.
ANSWER_RULES = (
    "Answer the question from the numbered sources only, in the language of the question, as prose that brings the sources together. "
    "Put the numbers of the sources in square brackets behind what they support, such as [1] or [2][3], at most three for a claim. "
    "If the sources don't hold the answer, say so in one sentence and stop."
)
WEAK_RULES = (
    "The numbered sources may have little to do with the question. Say in one to three sentences, in the language of the question, what they are "
    "about, so that the reader can decide whether to open one; cite them as [1] or [2][3]. Don't answer beyond them. If none is related, say so in one sentence."
)


def ask_prompt(question: Column, context: Column, confidence: Column) -> Column:
    """What a model is asked: rules (weaker ones for low confidence), question and sources."""
    rules = F.when(confidence == "low", WEAK_RULES).otherwise(ANSWER_RULES)
    return F.concat(rules, F.lit("\n\nQuestion: "), question, F.lit("\n\nSources:\n\n"), F.coalesce(context, F.lit("")))


def asked(contexts: DataFrame, chat: Chat) -> DataFrame:
    """``contexts`` (term, sources, context, confidence) with what ``chat`` answers: error, answer, cited, invalid, answered.

    A question that can't be asked has an error and no answer, and so has one that the model fails on. cited: numbers in the answer
    that are sources, invalid: those that aren't; an answer counts if it cites a source.
    """
    checked = valid_questions(contexts.withColumn("question", F.col("term"))).drop("question")
    prompt = F.when(F.col("error").isNull(), ask_prompt(text.trimmed(F.col("term")), F.col("context"), F.col("confidence")))
    told = checked.withColumn("answer", text.without_thinking(answered(prompt, chat)))
    numbers = F.when(F.coalesce("sources", F.lit(0)) > 0, F.sequence(F.lit(1), F.col("sources"))).otherwise(F.array().cast("array<int>"))
    named = F.coalesce(markers(F.col("answer")), F.array().cast("array<int>"))
    out = told.withColumn("error", F.coalesce("error", F.when(F.col("answer").isNull(), "no answer")))
    return out.withColumn("cited", F.array_intersect(named, numbers)).withColumn("invalid", F.array_except(named, numbers)).withColumn("answered", F.size("cited") > 0)


def answer_events(told: DataFrame) -> DataFrame:
    """The event stream of each row of ``asked``: term, seq, event, data. A meta, the answer's lines as deltas, and done; or a single error."""
    json = lambda **fields: F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    deltas = F.transform(F.split("answer", r"(?<=\n)", -1), lambda part: event("delta", json(text=part)))
    opened = event("meta", json(question=F.col("term"), sources=F.col("sources"), confidence=F.col("confidence")))
    closed = event("done", json(answered=F.col("answered"), cited=F.col("cited")))
    stream = F.when(F.col("error").isNotNull(), F.array(event("error", json(message=F.col("error"))))).otherwise(F.concat(F.array(opened), deltas, F.array(closed)))
    return told.select("term", F.posexplode(stream).alias("seq", "e")).select("term", "seq", "e.event", "e.data")


def valid_questions(questions: DataFrame) -> DataFrame:
    """``questions`` (question) with ``error``: empty, too long, or null if it can be asked."""
    plain = text.trimmed(F.col("question"))
    error = F.when(F.coalesce(plain, F.lit("")) == "", "empty").when(F.length(plain) > QUESTION_CHARS, "too long")
    return questions.withColumn("error", error)


#: Code points of a page and of a query that a highlight may use.
HIGHLIGHT_PAGE, HIGHLIGHT_QUERY = 32_000, 4_000


def escaped(c: Column) -> Column:
    """A text as it may stand in HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def linked_citations(answer: Column, sources: Column) -> Column:
    """An answer as HTML in which [n] is a link to source n, if there is one; ``sources``: array of numbers."""
    parts = F.split(escaped(answer), r"(?<=\[\d{1,9}\])|(?=\[\d{1,9}\])", -1)
    number = lambda p: F.regexp_extract(p, r"^\[(\d{1,9})\]$", 1)
    link = lambda p: F.concat(F.lit('<a href="#source-'), number(p), F.lit('">'), p, F.lit("</a>"))
    known = lambda p: (number(p) != "") & F.coalesce(F.array_contains(sources, number(p).try_cast("int")), F.lit(False))
    return F.array_join(F.transform(parts, lambda p: F.when(known(p), link(p)).otherwise(p)), "")


def highlights(hits: DataFrame, chunks: DataFrame, pages: DataFrame, chat: Chat) -> DataFrame:
    """What of each hit's page a model finds to the point: term, note_id, chunk_id, highlight.

    ``hits``: term, note_id, chunk_id, title; ``chunks``: chunk_id, text; ``pages``: note_id, content. A page that isn't
    there is replaced by the chunk; a query that is too long gives an empty highlight, a model that fails the chunk's first line.
    """
    found = with_texts(settle(hits), chunks).filter("text is not null").join(pages.select("note_id", "content"), "note_id", "left")
    body = text.without_title(F.col("text"), F.col("title"))
    page = text.clipped(F.coalesce("content", body), HIGHLIGHT_PAGE)
    short = F.length("term") <= HIGHLIGHT_QUERY
    ask = F.concat(F.lit("Quote the passage of the page that answers the query.\nQuery: "), "term", F.lit("\nPage:\n"), page)
    answer = text.trimmed(answered(F.when(short, ask), chat))
    first = text.first_content_line(F.col("text"), F.col("title"))
    told = F.when(~short, "").when(F.coalesce(answer, F.lit("")) != "", answer).otherwise(first)
    return found.select("term", "note_id", "chunk_id", told.alias("highlight"))
