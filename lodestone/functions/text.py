"""Text expressions. White space follows Unicode, with the byte order mark counted as white space."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Fixed value: what counts as white space in captured pages.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def blank_to_null(c: Column) -> Column:
    t = collapse(c)
    return F.when(t != "", t)


def comparison_key(c: Column) -> Column:
    """Values compare by this text: collapsed, lower case, without one slash at the end."""
    return F.regexp_replace(F.lower(collapse(c.cast("string"))), "/$", "")


def singular(token: Column) -> Column:
    """A category word without its plural ending; possessives and words on -ss stay."""
    n = F.length(token)
    return (
        F.when(token.endswith("'s"), token)
        .when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, 1, n - 3), F.lit("y")))
        .when(token.rlike("(sses|ches|shes|xes|zes)$") & (n > 4), F.substring(token, 1, n - 2))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 3), F.substring(token, 1, n - 1))
        .otherwise(token)
    )


def category_key(c: Column) -> Column:
    return F.array_join(F.transform(F.split(comparison_key(c), " "), singular), " ")


def directives(c: Column) -> Column:
    """Comma-separated directives in first-seen order, trimmed and lower case."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.lower(collapse(x))), lambda x: x != ""))


def list_items(c: Column) -> Column:
    """Items of a list typed with commas or line ends."""
    return F.filter(F.transform(F.split(c, r"[\n,]"), collapse), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Runs of what is no white space, counted in place."""
    return F.regexp_count(c, F.lit(f"[^{SPACE[1:]}++"))


def description_state(c: Column, brief_below: int = 40) -> Column:
    n = F.coalesce(word_count(c), F.lit(0))
    return F.when(n == 0, "missing").when(n < brief_below, "brief").otherwise("substantive")


def excerpt(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def padded(c: Column, width: int = 6) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def email_normal(c: Column) -> Column:
    """Trimmed and lower case; null where it is no address."""
    t = F.lower(collapse(c))
    return F.when(t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), t)


def email_mask(c: Column) -> Column:
    """First and last character of the local part with two to six dots between."""
    local, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    dots = F.least(F.lit(6), F.greatest(F.lit(2), F.length(local) - 2))
    return F.concat(F.substring(local, 1, 1), F.repeat(F.lit("•"), dots), F.substring(local, -1, 1), F.lit("@"), host)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def first_match(c: Column, cases: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that c matches."""
    out = F.lit(otherwise)
    for pattern, label in reversed(cases):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def contains_tokens(text: Column, tokens: Column) -> Column:
    """Whether space-separated tokens occur in text as whole tokens."""
    return (tokens != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), tokens, F.lit(" ")))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def identity_key(c: Column) -> Column:
    """Names are the same by NFKC, without emphasis marks, case and extra white space."""
    return collapse(F.lower(F.regexp_replace(nfkc(c), r"[*_`]", "")))


def token_key(c: Column, ascii_only: bool = False) -> Column:
    """Letters and digits in lower case with single spaces; marks fall away unless the text is known as ASCII."""
    return F.trim(F.regexp_replace(F.lower(c if ascii_only else unmarked(c)), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def anchor_quote(quote: pd.Series, text: pd.Series) -> pd.Series:
    """The span of text that a quote repeats, but for emphasis marks, white space and the first letter's case; else null."""

    def find(q: str | None, t: str | None) -> str | None:
        if not q or not t:
            return None
        flat, place, gap = [], [], True
        for i, ch in enumerate(t):
            if ch in "*_`":
                continue
            if ch.isspace():
                if not gap:
                    flat.append(" ")
                    place.append(i)
                gap = True
            else:
                flat.append(ch)
                place.append(i)
                gap = False
        q = " ".join("".join(c for c in q if c not in "*_`").split())
        flat = "".join(flat)
        for form in dict.fromkeys((q, q[:1].swapcase() + q[1:])):
            if form and (at := flat.find(form)) >= 0:
                return t[place[at] : place[at + len(form) - 1] + 1]
        return None

    return pd.Series([find(q, t) for q, t in zip(quote, text, strict=True)], dtype="object")
