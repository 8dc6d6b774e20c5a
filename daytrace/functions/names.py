"""Well-name expressions: file token to canonical name, resolver, hold-out tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrace import fixed

TOKEN_SHAPE = r"^(\d+)_(\d+)_(.+)$"
CANONICAL_SHAPE = r"^\d+/\d+-[A-Z]?-?\d+[A-Z]?(?: [A-Z]+\d*)?$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from_token(t: Column) -> Column:
    parts = F.split(F.regexp_extract(t, TOKEN_SHAPE, 3), "_")
    head = F.concat_ws("/", F.regexp_extract(t, TOKEN_SHAPE, 1), F.regexp_extract(t, TOKEN_SHAPE, 2))

    def named(p: Column) -> Column:
        platform = F.element_at(p, 1).rlike(r"^\p{L}+$") & (F.size(p) >= 2)
        used = F.when(platform, F.lit(2)).otherwise(F.lit(1))
        bore = F.array_join(F.slice(p, used + 1, F.size(p)), " ")
        well = F.array_join(F.slice(p, F.lit(1), used), "-")
        return F.concat_ws(" ", F.concat_ws("-", head, well), F.when(F.size(p) > used, bore))

    return F.when(t.rlike(TOKEN_SHAPE), bound(parts, named))


def name_from_token(token: Column) -> Column:
    """`15_9_F_1_C` -> `15/9-F-1 C`; a token of another shape gives null."""
    return bound(F.trim(token), _from_token)


def is_canonical(name: Column) -> Column:
    return F.trim(name).rlike(CANONICAL_SHAPE)


def canonical(name: Column) -> Column:
    """Either spelling to the canonical one; null where it cannot be resolved."""
    return bound(F.trim(name), lambda t: F.when(t.rlike(CANONICAL_SHAPE), t).otherwise(_from_token(t)))


def well_of(wellbore: Column) -> Column:
    return F.substring_index(canonical(wellbore), " ", 1)


def ascii_digits(text: Column) -> Column:
    """Fold decimal digits of other scripts, and super- and subscript digits, to 0-9."""
    others = "".join(
        "".join(chr(start + d) for start in _DIGIT_BLOCKS) + chr(0x2080 + d) + _SUPERSCRIPTS[d] for d in range(10)
    )
    plain = "".join(str(d) * (len(_DIGIT_BLOCKS) + 2) for d in range(10))
    return F.translate(text, others, plain)


# fixed values: first code point (digit zero) of the decimal-digit blocks of the Unicode BMP
_DIGIT_BLOCKS = (
    0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6,
    0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0,
    0x1A80, 0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0,
    0xAA50, 0xABF0, 0xFF10,
)
_SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def bare(name: Column) -> Column:
    return F.regexp_replace(F.upper(ascii_digits(name)), "[^A-Z0-9/-]", "")


def _bare_literal(name: str) -> str:
    return "".join(c for c in name.upper() if c.isalnum() or c in "/-")


def starts_with_any(text: Column, names: Sequence[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | text.startswith(_bare_literal(name))
    return out


def is_hold_out(
    well: Column,
    hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS,
    development: Sequence[str] = fixed.DEVELOPMENT_WELLS,
) -> Column:
    """Fails closed: a name nobody can place counts as held out."""
    tidy = F.regexp_replace(F.upper(F.trim(ascii_digits(well))), r"\s+", " ")
    tidy = F.regexp_replace(tidy, "^NO ", "")

    def judged(n: Column) -> Column:
        unpadded = F.regexp_replace(n, r"0+(\d)", "$1")
        readings = F.filter(F.transform(F.array(well, n, unpadded), well_of), lambda x: x.isNotNull())
        short = F.regexp_replace(n, "[^A-Z0-9/-]", "")
        unplaced = starts_with_any(short, hold_out) | ~starts_with_any(short, development)
        known = bound(readings, lambda r: F.when(F.size(r) > 0, F.exists(r, lambda x: x.isin(*hold_out))))
        return F.coalesce(known, unplaced)

    return F.coalesce(well.isin(*hold_out) | bound(tidy, judged), F.lit(True))


def is_hold_out_label(well: Column, hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS) -> Column:
    """The audit's own match: resolve, else the hold-out name followed by a space."""

    def judged(resolved: Column) -> Column:
        prefixed = F.lit(False)
        for name in hold_out:
            prefixed = prefixed | well.startswith(name + " ")
        return F.when(resolved.isNotNull(), resolved.isin(*hold_out)).otherwise(prefixed)

    return F.coalesce(well.isin(*hold_out) | bound(well_of(well), judged), F.lit(False))


def hold_out_mentioned(text: Column, hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS) -> Column:
    """First hold-out name quoted in free text, not followed by another digit; else null."""
    body = bare(F.translate(text, "_.", "--"))
    found = F.lit(None).cast("string")
    for name in reversed(sorted(hold_out)):
        short = _bare_literal(name)
        pattern = f"(?:{short}|{short.replace('/', '-')})(?![0-9])"
        found = F.when(body.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def version_number(version: Column) -> Column:
    """The N of a trailing `vN`; null when the version has another shape."""
    digits = F.regexp_extract(F.trim(version), r"(?i)(?:^|[^A-Za-z0-9])v(0|[1-9]\d*)$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def report_token(file_name: Column) -> Column:
    """Text before the trailing date of a report file name; null for another shape."""
    return F.nullif(F.regexp_extract(file_name, REPORT_NAME, 1), F.lit(""))


def report_date(file_name: Column) -> Column:
    parts = [F.regexp_extract(file_name, REPORT_NAME, i) for i in (2, 3, 4)]
    return F.try_to_timestamp(F.nullif(F.concat_ws("-", *parts), F.lit("--")), F.lit("yyyy-MM-dd")).cast("date")


REPORT_NAME = r"^(.+)_(\d{4})_(\d{2})_(\d{2})\.[xX][mM][lL]$"
