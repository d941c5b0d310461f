"""Deep links into notebooks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import percent_decoded

#: Month names of journal titles.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def journal_parts(title: Column) -> Column:
    """(year, month, day) of a title of ten bytes with numbers at the places of a date; null for all others.

    Separators and ranges aren't checked. A number may begin with a plus sign.
    """
    number = lambda start, n: F.when(F.substring(title, start, n).rlike(r"\A\+?[0-9]+\z"), F.substring(title, start, n).cast("int"))
    year, month, day = number(1, 4), number(6, 2), number(9, 2)
    ok = (F.octet_length(title) == 10) & (F.length(title) == 10) & year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(ok, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def journal_name(parts: Column) -> Column:
    """A date as journals are titled: Dec 14th, 2022."""
    day = parts["day"]
    ending = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    month = F.when(parts["month"].between(1, 12), F.try_element_at(F.array(*map(F.lit, MONTHS)), parts["month"])).otherwise("ErrMonth")
    return F.concat(month, F.lit(" "), day.cast("string"), ending, F.lit(", "), parts["year"].cast("string"))


def display_title(title: Column) -> Column:
    """A page title decoded once more, with the hierarchy that ``___`` stands for."""
    return F.replace(percent_decoded(title), F.lit("___"), F.lit("/"))


def outline_link(graph: Column, title: Column) -> Column:
    """Link to a page, or to the journal of the day that the title names."""
    parts = journal_parts(title)
    page = F.when(parts.isNotNull(), journal_name(parts)).otherwise(display_title(title))
    return F.concat(F.lit("logseq://graph/"), graph, F.lit("?page="), F.url_encode(page))


def prose_link(vault: Column, path: Column) -> Column:
    """Link to a note by its path without ``.md``; blanks are ``%20`` throughout."""
    file = percent_decoded(F.regexp_replace(path, r"\.md\z", ""))
    link = F.concat(F.lit("obsidian://open?vault="), F.url_encode(vault), F.lit("&file="), F.url_encode(file))
    return F.replace(link, F.lit("+"), F.lit("%20"))
