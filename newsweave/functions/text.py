"""Text scalar functions as Column expressions. All but ``nfkc``, which Spark has no built-in for, and what uses it stay
inside whole-stage code generation.

Null texts are treated as '' wherever a text is returned; empty token lists come back as empty arrays.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Frequent Dutch function words, removed before counting terms.
STOPWORDS = sorted(set(
    "aan af al alles als altijd andere ben bij daar dan dat de der deze die dit doch doen door dus een eens en er ge geen geweest haar had heb "
    "hebben heeft hem het hier hij hoe hun iemand iets ik in is ja je kan kon kunnen maar me meer men met mij mijn moet na naar niet niets nog nu "
    "of om omdat onder ons ook op over reeds te tegen toch toen tot u uit uw van veel voor want waren was wat werd wezen wie wil worden wordt zal ze zelf "
    "zich zij zijn zo zonder zou".split()
))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(or_empty(c), r"[ \t\n\r\f]+", " "))


@F.pandas_udf(StringType())
def _nfkc(v: pd.Series) -> pd.Series:
    return v.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(c: Column) -> Column:
    """Compatibility forms (full width, ligatures, fixed blanks) as plain ones; null as ''."""
    return _nfkc(or_empty(c))


def without_format(c: Column) -> Column:
    """Without characters that only format, such as zero-width blanks and soft hyphens."""
    return F.regexp_replace(or_empty(c), r"\p{Cf}", "")


# Entities of the characters that HTML reserves, and the fixed blank.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Tags to blanks, the reserved characters' entities decoded, blanks collapsed; case and punctuation stay."""
    t = F.regexp_replace(or_empty(c), "<[^>]*>", " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return collapse(t)


def geo_clean(c: Column) -> Column:
    """HTML to text in compatibility form, case and punctuation kept: what places are looked for in."""
    return collapse(nfkc(html_text(c)))


def raw_text(full_text: Column, title: Column, summary: Column) -> Column:
    """full_text if it isn't blank, else title and summary."""
    own = F.trim(or_empty(full_text))
    return F.when(F.length(own) > 0, or_empty(full_text)).otherwise(F.trim(F.concat_ws(" ", or_empty(title), or_empty(summary))))


def weighted_text(title: Column, summary: Column, times: int = 3) -> Column:
    return F.lower(F.concat_ws(" ", *[or_empty(title)] * times, or_empty(summary)))


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def word_tokens(c: Column, least: int = 2) -> Column:
    """Lower-cased words of ``least`` letters, digits or low lines or more, of any script."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def without_stopwords(ts: Column, stop: list[str] = STOPWORDS) -> Column:
    return F.filter(ts, lambda x: ~x.isin(*stop))


def ngrams(ts: Column, lo: int, hi: int) -> Column:
    """All runs of lo to hi tokens, in order of length and place."""

    def of(n: int) -> Column:
        starts = F.when(F.size(ts) >= n, F.sequence(F.lit(1), F.greatest(F.size(ts) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ts, i, n), " "))

    return F.concat(*[of(n) for n in range(lo, hi + 1)])


def token_clean(c: Column, compat: bool = False) -> Column:
    """Tags out and entities decoded, compatibility forms if wanted, leading ``#123 -`` out, hashtags and mentions split at capitals, other signs to blanks,
    collapsed, lower case, in this order."""
    t = html_text(c)
    t = nfkc(t) if compat else t
    t = F.regexp_replace(t, r"^#[0-9]+ - ", "")
    t = F.regexp_replace(t, "([#@][A-Za-z]*?[a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+", " ")
    return F.lower(collapse(t))


def replace_unknown(ts: Column, vocabulary: Column) -> Column:
    return F.transform(ts, lambda t: F.when(F.array_contains(vocabulary, t), t).otherwise(F.lit("<unk>")))


def capitalised(c: Column) -> Column:
    """Distinct tokens that begin with a capital, lower-cased, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens(c), lambda x: x.rlike(r"^\p{Lu}")), lambda x: F.lower(x))))


def snippet(c: Column, most: int = 220) -> Column:
    t = collapse(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)


def html_escape(c: Column) -> Column:
    t = or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def age_text(ts: Column, now: Column) -> Column:
    """``Nd Nh`` from a day on, ``Nh Nm`` from an hour on, else ``Nm``; never negative."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda x, u: F.concat(x.cast("string"), F.lit(u))
    return F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"))).when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"))).otherwise(part(m, "m"))


def parse_list(c: Column) -> Column:
    """``"['a','b']"`` to an array; anything else to an empty one."""
    inner = F.regexp_extract(or_empty(c), r"^\s*\[(.*)\]\s*$", 1)
    parts = F.regexp_extract_all(inner, F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0))
    return F.transform(parts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def place_key(c: Column) -> Column:
    return F.lower(collapse(nfkc(c)))


def html_main_text(html: Column) -> Column:
    """Scripts out, the article or main element if there is one, its paragraphs without tags, one a line."""
    t = F.regexp_replace(or_empty(html), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    inner = F.regexp_extract(t, r"(?is)<(?:article|main)[^>]*>(.*?)</(?:article|main)>", 1)
    t = F.when(F.length(inner) > 0, inner).otherwise(t)
    paras = F.regexp_extract_all(t, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|(?=<p[\s>])|$)"), F.lit(1))
    clean = F.transform(paras, lambda p: collapse(F.regexp_replace(p, "<[^>]*>", " ")))
    return F.array_join(F.filter(clean, lambda p: p != ""), "\n")
