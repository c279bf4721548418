"""Text functions as column expressions: normal forms, tokens, URLs, HTML.

Spark has no Unicode normalisation; letters are taken to their bases with translate(), from a table that Python's Unicode data give.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[str, str]:
    """The characters of the basic plane that are one other with marks in canonical decomposition, then all marks; and what the former become.

    Hangul syllables and the few letters that decompose into several aren't among them.
    """
    bases, marks = {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif not (0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3):
            left = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
            if len(left) == 1 and left[0] != c:
                bases[c] = left[0]
    return "".join([*bases, *marks]), "".join(bases.values())


COMPOSED, BASES = _decomposed()
#: Words that keys leave out.
STOP_WORDS = ("de", "da", "do", "das", "dos", "e")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_marks(c: Column | str) -> Column:
    """Letters without accents and other marks, which go too where they stand alone: canonical decomposition without its marks."""
    return F.translate(col(c), COMPOSED, BASES)


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return without_marks(F.lower(col(c)))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def text_key(c: Column | str) -> Column:
    """Folded, with single spaces; punctuation stays."""
    return squeeze(fold(c))


def graph_key(c: Column | str) -> Column:
    """Folded, punctuation and stop-words dropped."""
    words = F.split(squeeze(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), " ")


def tokens(c: Column | str) -> Column:
    """Retrieval tokens: runs of a-z, 0-9 and à-ú in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("([a-zà-ú0-9]+)"), 1)


def token_set(c: Column | str, longer_than: int = 3, stop_words: tuple[str, ...] = (), acronyms: tuple[str, ...] = ()) -> Column:
    """Distinct folded tokens that are long or acronyms, and no stop-words."""
    found = F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), 1)
    keep = F.filter(found, lambda w: ((F.length(w) > longer_than) | w.isin(*acronyms or ("",))) & ~w.isin(*stop_words or ("",)))
    return F.array_distinct(keep)


def singular(c: Column | str) -> Column:
    word = col(c)
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def path_words(url: Column | str) -> Column:
    """Words of a URL's path."""
    return F.trim(F.regexp_replace(F.parse_url(col(url), F.lit("PATH")), "[/_.-]+", " "))


def truncate_words(c: Column | str, n: int) -> Column:
    """At most n characters, cut at a space, with an ellipsis."""
    text = col(c)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), F.lit("…")))


def html_to_text(c: Column | str) -> Column:
    """Scripts and styles dropped, tags to spaces, common entities resolved, single spaces."""
    text = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return squeeze(text)


def html_title(c: Column | str) -> Column:
    """The first h1, else the title element."""

    def first(tag: str) -> Column:
        return F.nullif(html_to_text(F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))

    return F.coalesce(first("h1"), first("title"))


def site_title(c: Column | str, site: str) -> Column:
    """A page's title without what follows a dash or bar and the site's name, in any case."""
    import re

    return squeeze(F.regexp_replace(html_title(c), rf"(?i)\s*[-|]\s*{re.escape(site)}.*$", ""))


def html_links(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r'href="([^"#]+)"'), 1))


def canonical_url(c: Column | str) -> Column:
    """Without query, fragment and trailing slash; host in lower case."""
    url = col(c)
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.parse_url(url, F.lit("HOST"))), path)


def phrase(c: Column | str, *phrases: str) -> Column:
    """Whether one of the phrases stands in the text, as whole words, in any case."""
    import re

    return F.lower(col(c)).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(re.escape(p) for p in phrases) + r")($|[^\p{L}\p{N}_])")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def json_object(c: Column | str) -> Column:
    """The text from the first { to the last }."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))
