"""Text cleaning. Whole texts go through; nothing is cut except where a field has a
stated length (snippets, titles, redacted messages)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"
# Letters and marks that NFKC leaves alone: ASCII, Latin letters from U+00C0 to
# U+0131 and the main CJK block. Anything else (combining marks included) may change.
_MAY_CHANGE = r"[^\x00-\x7FÀ-ı一-鿿]"
# The shape of a credential in a message, and of a hashtag element.
SECRET = r"(?i)(authorization|cookie|token)\s*[:=]\s*[^\s,;]+"
HASHTAG = (r"""(?i)<e[^>]+type=["']hashtag["'][^>]+title=["']([^"']+)["'][^>]*/?>""")
TAG = r"<[^>]+>"


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; only texts that it may change travel to Python."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import unicodedata
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.coalesce(run(F.when(text.rlike(_MAY_CHANGE), text)), text)


def unescape(text: Column, bare: bool = True) -> Column:
    """Resolve HTML entities; only texts with an ampersand travel to Python. `bare=False` leaves those without a closing
    semicolon as they are, such as one cut in two."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import html
        import re
        from html.entities import html5
        if bare:
            return values.map(html.unescape, na_action="ignore")
        closed = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")

        def plain(found: re.Match) -> str:
            name = found.group(1)
            return html5.get(name + ";", found.group()) if name else html.unescape(found.group())

        return values.map(lambda v: closed.sub(plain, v), na_action="ignore")

    return F.coalesce(run(F.when(text.contains("&"), text)), text)


def url_unquote(text: Column) -> Column:
    """Percent-decoding that keeps `+` and leaves malformed escapes as they are."""
    kept = F.replace(text, F.lit("+"), F.lit("%2B"))
    kept = F.regexp_replace(kept, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(kept), text)).otherwise(text)


def split_terms(text: Column) -> Column:
    """Search words: split on blanks and commas (both widths), first occurrence kept."""
    return F.array_distinct(F.filter(F.split(strip(text), r"(?U)[\s,，]+"), lambda t: t != ""))


def has_real_content(title: Column, content: Column) -> Column:
    """True when something readable is left once hashtags and blanks are gone."""
    joined = url_unquote(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    plain = F.regexp_replace(joined, "(?s)#[^#]{0,60}#", " ")
    return plain.rlike("[一-鿿A-Za-z0-9]")


def normalize_term(text: Column, empty: bool = False) -> Column:
    """Dictionary form of a word; NULL for an empty word, unless `empty` keeps it as it is."""
    clean = F.regexp_replace(strip(nfkc(text)), r"(?U)\s+", " ")
    return clean if empty else F.when(clean != "", clean)


def compact(text: Column) -> Column:
    """Compatibility form, lower case, all blanks removed."""
    return F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", "")


def clean_text(text: Column, bare: bool = True) -> Column:
    """Plain text of a marked-up body: entities (see `unescape` for `bare`), hashtag elements, other tags."""
    return _without_markup(unescape(F.coalesce(text, F.lit("")), bare))


def _without_markup(plain: Column) -> Column:
    elements = F.arrays_zip(
        F.regexp_extract_all(plain, F.lit(HASHTAG), 0).alias("whole"),
        F.regexp_extract_all(plain, F.lit(HASHTAG), 1).alias("title"))
    tagged = F.reduce(
        elements, plain,
        lambda acc, e: F.replace(acc, e["whole"], F.concat(
            F.lit("#"), strip(F.btrim(url_unquote(e["title"]), F.lit("#"))))))
    tagged = F.when(plain.rlike(HASHTAG), tagged).otherwise(plain)
    return strip(F.regexp_replace(tagged, TAG, ""))


def unescape_each(texts: Column) -> Column:
    """Resolve HTML entities in every item of an array; only arrays with an ampersand travel to Python."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        import html
        return values.map(lambda v: [None if x is None else html.unescape(x) for x in v], na_action="ignore")

    return F.coalesce(run(F.when(F.exists(texts, lambda t: F.coalesce(t.contains("&"), F.lit(False))), texts)), texts)


def snippet(text: Column, term: Column, width: int = 80) -> Column:
    """`width // 2` characters on both sides of the first hit, else the first `width`."""
    return snippet_at(text, term, F.position(term, text), width)


def snippet_at(text: Column, term: Column, hit: Column, width: int = 80) -> Column:
    """The snippet when the position of the first hit (1-based, 0 for none) is known."""
    half = width // 2
    start = F.greatest(hit - half, F.lit(1))
    length = hit + F.length(term) + half - start
    return F.when(hit > 0, F.substring(text, start, length)).otherwise(F.substring(text, F.lit(1), F.lit(width)))


def redact(text: Column, limit: int = 500) -> Column:
    """Mask credentials, collapse blanks, cut to `limit`."""
    masked = F.regexp_replace(text, SECRET, "$1=[redacted]")
    return F.substring(strip(F.regexp_replace(masked, r"(?U)\s+", " ")), 1, limit)


def fill_title(title: Column, content: Column, limit: int = 500) -> Column:
    """The title, or the first line of the content when there is none."""
    first_line = F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", 2)[0]
    return F.substring(F.when(F.coalesce(title, F.lit("")) != "", title)
                       .otherwise(F.coalesce(first_line, F.lit(""))), 1, limit)


def distinct_tags(tags: Column) -> Column:
    """Non-empty tags, cleaned like any text, in first-seen order."""
    plain = unescape_each(F.coalesce(tags, F.array().cast("array<string>")))
    cleaned = F.transform(plain, lambda t: _without_markup(F.coalesce(t, F.lit(""))))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))
