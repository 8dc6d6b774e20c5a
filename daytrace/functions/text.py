"""Text expressions: tokens, spans, stated reasons, stray numbers, wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrace import fixed


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(lowered, F.lit(phrase))
    return out


def states_a_reason(span: Column) -> Column:
    return F.coalesce(contains_any(span, fixed.INTENT_PHRASES), F.lit(False))


def is_verbatim(span: Column, text: Column) -> Column:
    """A blank span is a substring of everything, so it is refused first."""
    return F.coalesce((F.trim(span) != "") & F.contains(text, span), F.lit(False))


def opening_span(text: Column) -> Column:
    """Opening of a comment, cut at its first sentence end where one lies far enough in."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    head = F.left(body, F.lit(fixed.SPAN_MAX))
    cut = F.lit(None).cast("string")
    for mark in ("; ", ".\n", ". "):
        at = F.instr(head, mark)  # 1-based position equals the length kept
        cut = F.when(at - 1 > fixed.SPAN_MIN, F.left(body, at)).otherwise(cut)
    return F.coalesce(cut, F.regexp_replace(head, r"\s+$", ""))


def sentence_with(text: Column, terms: Column) -> Column:
    """First sentence holding one of `terms` (an array column); else the text if it holds one."""
    pieces = F.transform(
        F.split(F.regexp_replace(text, "\n", ". "), r"\. "),
        lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""),
    )

    def holds(piece: Column) -> Column:
        return F.exists(terms, lambda t: F.contains(F.lower(piece), t))

    hits = F.filter(pieces, lambda p: (p != "") & holds(p) & F.contains(text, p))
    return F.coalesce(F.get(hits, F.lit(0)), F.when(holds(text), text))


def stray_numbers(text: Column) -> Column:
    """Numbers in prose that no fact stands behind: not in names or dates, years or percentages."""
    plain = F.regexp_replace(text, fixed.WELL_NAME_IN_TEXT, "<well>")
    plain = F.regexp_replace(plain, fixed.ISO_DATE_IN_TEXT, "<date>")
    # The tail rides along as group 2 because a percent sign or word clears the number before it.
    pattern = r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)(?![\w])(?=(%|\s{0,2}percent|\s{0,1}per cent)?)"
    number = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))
    tail = F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    paired = F.filter(
        F.arrays_zip(number.alias("n"), tail.alias("t")),
        lambda p: (F.coalesce(p["t"], F.lit("")) == "") & ~p["n"].rlike(r"^(?:19|20)\d{2}$"),
    )
    return F.transform(paired, lambda p: p["n"])


def wording_above_level(narrative: Column, level: Column) -> Column:
    """Root-cause wording found in a narrative whose level does not allow it."""
    found = F.flatten(
        F.array(
            *[
                F.regexp_extract_all(narrative, F.lit("(?i)" + p), F.lit(0))
                for p in fixed.ROOT_CAUSE_WORDING
            ]
        )
    )
    return F.when(level.eqNullSafe(F.lit("documented_root_cause")), F.array().cast("array<string>")).otherwise(found)


def filled(name: str, *values: Column) -> Column:
    """A fixed text with its gaps filled."""
    pieces = fixed.TEXTS[name].split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)
