"""Years of experience a posting asks for.

Precedence (all on title + ' ' + description, case-insensitive):
1. an entry-level phrase anywhere -> 0, even "mentor junior staff";
2. else the lower bound of the first "N-M years" range, even when a single
   "K years" appears earlier in the text;
3. else the first "N years" / "N+ years";
4. else null.
A senior-tier word in the *title* (never the description) implies 5 when no
number was found.  Numbers too large for BIGINT count as "very large" (they
must fail any cap), not as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrase patterns (must equal the reference's patterns).
# Dashes: hyphen-minus, figure dash, en dash, em dash, minus sign.
ENTRY_LEVEL_RE = (r"\b(?:entry[\s-]?level|junior|no experience required|recent graduate"
                  r"|recién egresado|sin experiencia)\b")
RANGE_RE = r"(\d+)\s*[-‒–—−]\s*(\d+)\s*(?:years?|yrs?|años?)"
YEARS_RE = r"(\d+)\+?\s*(?:years?|yrs?|años?)"
SENIOR_TITLE_RE = (r"\b(?:senior|sr\.?|staff|principal|lead|l[ií]der|arquitect[oa]|architect"
                   r"|director|head\s+of|chief|vp)\b")
SENIOR_IMPLIED_YEARS = 5

_FLAGS = "(?iU)"
_HUGE = 9223372036854775807


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_number(text: Column, pattern: str) -> Column:
    # The extraction is bound once (a one-element transform acts as "let"), so
    # the regex scans the text once although the value is tested twice.
    digits = F.array(F.regexp_extract(text, _FLAGS + pattern, 1))
    return F.get(F.transform(digits, lambda d: F.when(
        d != "", F.coalesce(d.try_cast("bigint"), F.lit(_HUGE)))), 0)


def min_years(text) -> Column:
    """Minimum years required by ``text`` or null."""
    t = _col(text)
    return (F.when(t.isNull() | (t == ""), F.lit(None).cast("bigint"))
             .when(t.rlike(_FLAGS + ENTRY_LEVEL_RE), F.lit(0).cast("bigint"))
             .otherwise(F.coalesce(_first_number(t, RANGE_RE), _first_number(t, YEARS_RE))))


def title_is_senior(title) -> Column:
    """The title carries a senior-tier word (EN + ES)."""
    return _col(title).rlike(_FLAGS + SENIOR_TITLE_RE)


def required_years(title="title", description="description") -> Column:
    """coalesce(P21(title + ' ' + description), 5 if the title is senior)."""
    text = F.concat(_col(title), F.lit(" "), F.coalesce(_col(description), F.lit("")))
    return F.coalesce(min_years(text),
                      F.when(title_is_senior(title), F.lit(SENIOR_IMPLIED_YEARS).cast("bigint")))
