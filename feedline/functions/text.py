"""String functions over Columns (all JVM-side, no Python per row).

Every regex that faces user text carries ``(?U)`` so ``\\s``, ``\\w`` and
``\\b`` are Unicode-aware like Python's, and ``(?i)`` where the original
matched case-insensitively.
"""

from __future__ import annotations

import importlib.util
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace on both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


# ---------------------------------------------------------------- P3 / P4 / P5

def title_company_lines(raw) -> Column:
    """struct(title, company) from a card's multi-line text.

    Lines are stripped and empties dropped; the title is the first line
    longer than 5 code points that does not start with "Publicado"; the
    company is the line right after it, else "".  No such line -> ("", "").
    """
    lines = F.filter(F.transform(F.split(_col(raw), "\n"), lambda x: strip(x)), lambda x: x != "")
    hits = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))),
        lambda s: (F.length(s["line"]) > 5) & ~s["line"].startswith("Publicado"),
    )
    first = F.get(hits, 0)
    title = F.coalesce(first["line"], F.lit(""))
    company = F.when(first.isNull(), F.lit("")).otherwise(
        F.coalesce(F.get(lines, first["i"] + 1), F.lit("")))
    return F.struct(title.alias("title"), company.alias("company"))


def first_line(text) -> Column:
    """First line (split on newline) of ``text``, stripped."""
    return strip(F.substring_index(_col(text), "\n", 1))


def title_company_pipes(plain) -> Column:
    """First line split on '|': >= 2 parts -> (part 2, part 1), else (line, "")."""
    line = first_line(plain)
    parts = F.split(line, r"\|")
    two = F.size(parts) >= 2
    title = F.when(two, strip(F.get(parts, 1))).otherwise(line)
    company = F.when(two, strip(F.get(parts, 0))).otherwise(F.lit(""))
    return F.struct(title.alias("title"), company.alias("company"))


def title_company_at(raw) -> Column:
    """P5: drop text up to the first ': ', then split at the **last** ' at '."""
    r = _col(raw)
    rest = F.when(F.instr(r, ": ") > 0, F.substring(r, F.instr(r, ": ") + 2, 1 << 30)).otherwise(r)
    has_at = F.instr(rest, " at ") > 0
    company_raw = F.substring_index(rest, " at ", -1)
    title_raw = F.substring(rest, F.lit(1), F.length(rest) - F.length(company_raw) - 4)
    title = F.when(has_at, strip(title_raw)).otherwise(strip(rest))
    company = F.when(has_at, strip(company_raw)).otherwise(F.lit(""))
    return F.struct(title.alias("title"), company.alias("company"))


# ---------------------------------------------------------------- P11 / P12 / P15 / P16

def slugify(c) -> Column:
    """Lower, strip, drop chars other than word/space/dash, whitespace runs -> '-'."""
    s = strip(F.lower(_col(c)))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    return F.regexp_replace(s, r"(?U)\s+", "-")


def absolutise_unless_http(href, base: str) -> Column:
    """P12 (link-card boards): keep an href starting with 'http', else prefix the base."""
    h = _col(href)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base), h))


def absolutise_if_rooted(href, base: str) -> Column:
    """P12 (article-card board): prefix the base only when the href starts with '/'."""
    h = _col(href)
    return F.when(h.startswith("/"), F.concat(F.lit(base), h)).otherwise(h)


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter, lower the rest.

    ``initcap`` only capitalises after whitespace ("o'higgins" -> "O'higgins"),
    Python also after punctuation and digits ("O'Higgins", "3D").
    """
    # Runs of letters and runs of non-letters; each letter run is capitalised.
    tokens = F.regexp_extract_all(_col(c), F.lit(r"(?U)\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)),
                                                                F.lower(F.substring(t, 2, 1 << 30)))), "")


def title_case_place(city, state) -> Column:
    """P16: "City, State" from lower-case parts; empty parts are skipped."""
    parts = [F.when(strip(_col(p)) != "", title_case(strip(_col(p)))) for p in (city, state)]
    return F.concat_ws(", ", *parts)


# ---------------------------------------------------------------- P14 / P17 / P18

def remote_flag(text) -> Column:
    """The text mentions REMOTE in any case."""
    return F.upper(_col(text)).contains("REMOTE")


def searchable_text(title="title", description="description") -> Column:
    """lower(title + ' ' + description)."""
    return F.lower(F.concat(_col(title), F.lit(" "), _col(description)))


def language_window(title="title", description="description", width: int = 500) -> Column:
    """strip(title + ' ' + description), first ``width`` code points."""
    return F.substring(strip(F.concat(_col(title), F.lit(" "), _col(description))), 1, width)


# ---------------------------------------------------------------- P20 / P25

def mailto_address(href) -> Column:
    """P20: the address of a mailto: href (scheme matched in any case), '' -> null."""
    h = _col(href)
    addr = strip(F.substring_index(F.substring(h, 8, 1 << 30), "?", 1))
    return F.when(F.lower(h).startswith("mailto:") & (addr != ""), addr)


# Phrases that mark a contact as HR (substring test on lower-cased context).
HR_CONTEXT_PHRASES = (
    "recursos humanos",
    "trabaja con nosotros",
    "bolsa de trabajo",
    "vacantes",
    "careers",
    "hr",
    "reclutamiento",
)


def literal_alternation(terms) -> str:
    """A Java regex matching any of ``terms`` literally (case-sensitive)."""
    quoted = ["\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in terms]
    return "(?:" + "|".join(quoted) + ")"


#: Terms up to this many are one alternation in the JVM, which tries them one after the other at every place.
MANY_TERMS = 200


def contains_any(text, terms) -> Column:
    """Any term is a substring of ``text``; an empty term list is false.

    Several terms become one regex alternation of literals: the text (often a
    lower-cased concatenation) is computed and scanned once, where an OR-chain
    of ``contains`` would rebuild it once per term inside a Filter.  Long lists
    become an automaton of all terms (Aho-Corasick) that reads each text once, up
    to the first term, whatever the length of the list; it runs on Arrow batches.
    """
    t = _col(text)
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(False)
    if "" in terms:  # the empty term is in every text
        return F.when(t.isNotNull(), F.lit(True))
    if len(terms) == 1:
        return t.contains(F.lit(terms[0]))
    if len(terms) > MANY_TERMS and importlib.util.find_spec("ahocorasick"):
        return _holds_any(tuple(terms))(t)
    return t.rlike(literal_alternation(terms))


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    """A worker's own automaton of a term list."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for term in terms:
        found.add_word(term)
    found.make_automaton()
    return found


def _holds_any(terms: tuple[str, ...]):
    @F.pandas_udf(T.BooleanType())
    def holds_any(col: pd.Series) -> pd.Series:
        found = _automaton(terms)
        return col.map(lambda t: None if t is None else next(found.iter(t), None) is not None).astype(object)

    return holds_any


def hr_context(context) -> Column:
    """P25: the (lower-cased) context mentions an HR phrase."""
    return contains_any(context, HR_CONTEXT_PHRASES)


# ---------------------------------------------------------------- P19 parameter lists

def _csv_items(c):
    return F.split(_col(c), ",")


def csv_keywords(c) -> Column:
    """P19 (keywords): split on ',', strip, lower -- empty items kept (they match everything)."""
    return F.transform(_csv_items(c), lambda x: F.lower(strip(x)))


def csv_list(c) -> Column:
    """P19 (other lists): split, strip, lower, drop empties."""
    return F.filter(F.transform(_csv_items(c), lambda x: F.lower(strip(x))), lambda x: x != "")


def csv_paths(c) -> Column:
    """P19 (contact paths): split, strip, drop empties, case kept."""
    return F.filter(F.transform(_csv_items(c), lambda x: strip(x)), lambda x: x != "")
