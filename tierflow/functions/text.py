"""Text column expressions (JVM-side regexes, no Python per row).

Java's ``\\s`` and ``\\w`` are ASCII-only unless ``(?U)`` is given, while the
reference's regexes are Python's Unicode classes. The classes are spelled
out explicitly below so the same pattern means the same thing in Java and
in RE2 (the engine of the DuckDB oracle).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every code point Python's str.isspace() accepts.
WS = (r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"

URL_RE = rf"http[^{WS}]+|www\.[^{WS}]+"
HANDLE_RE = rf"@[{WORD}]+"
NON_ALNUM_RE = rf"[^a-z0-9{WS}']"
SPACES_RE = rf"[{WS}]+"


HANDLE_HASH_RE = rf"{HANDLE_RE}|#"
TOKEN_SPLIT_RE = r"[^a-z0-9']+"
TOKEN_RE = r"[a-z0-9']+"


def _drop(x: Column, pattern: str, signs: tuple[str, str]) -> Column:
    """``x`` without the matches of a pattern, each of which holds one of the signs: a text without them isn't searched."""
    each = lambda v: F.when(F.contains(v, F.lit(signs[0])) | F.contains(v, F.lit(signs[1])), F.regexp_replace(v, pattern, "")).otherwise(v)
    return F.get(F.transform(F.array(x), each), F.lit(0))  # a lambda's variable: x is evaluated once


def stripped_text(c: Column | str, null_as_text: bool = False) -> Column:
    """lower -> drop URLs -> drop @handles and '#' (one pass; removing '#'
    cannot create or break a handle): the runs of [a-z0-9'] in it are the tokens."""
    c = F.col(c) if isinstance(c, str) else c
    if null_as_text:
        c = F.coalesce(c, F.lit("None"))
    return _drop(_drop(F.lower(c), URL_RE, ("http", "www.")), HANDLE_HASH_RE, ("@", "#"))


def clean_tokens(c: Column | str, null_as_text: bool = False) -> Column:
    """Tokens of the cleaned text: the runs of [a-z0-9'] of ``stripped_text``.

    Replacing each other character by a space and then collapsing whitespace
    runs leaves exactly these between the spaces. They are matched, not split
    around: Java's search for the negated class took seven times as long.
    """
    return F.regexp_extract_all(stripped_text(c, null_as_text), F.lit(TOKEN_RE), 0)


def clean_text(c: Column | str, null_as_text: bool = False) -> Column:
    """lower -> drop URLs -> drop @handles -> drop '#' -> non [a-z0-9 space '] to
    space -> collapse whitespace -> trim.  NULL stays NULL unless
    ``null_as_text`` (then it becomes 'none', as ``str(None).lower()``)."""
    return F.array_join(clean_tokens(c, null_as_text), " ")


def word_tokens(clean: Column | str) -> Column:
    """Tokens of an already cleaned text: split on single spaces, no empties."""
    c = F.col(clean) if isinstance(clean, str) else clean
    return F.filter(F.split(c, " "), lambda t: t != F.lit(""))


def _accent_table() -> tuple[str, str]:
    # Rule-built (not transcribed): Latin letters whose compatibility
    # decomposition is one base letter plus combining marks.
    src, dst = [], []
    for cp in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        d = unicodedata.normalize("NFKD", ch)
        base = "".join(x for x in d if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACC_SRC, _ACC_DST = _accent_table()


def strip_accents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, _ACC_SRC, _ACC_DST)


def analyzer_tokens(c: Column | str) -> Column:
    """Vectoriser tokens: accents stripped, lower-cased, runs of word chars."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(strip_accents(c)), F.lit(rf"([{WORD}]+)"), 1)


# --- markup / preprocessing (P12-P17) ---------------------------------------

TAG_RE = r"<[^>]*>"
ENTITY_RE = r"&[a-zA-Z]+;|&#[0-9]+;"
MD_RE = r"[*_`~>#\[\]()|]+"
EMOJI_RE = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


def strip_html(c: Column | str) -> Column:
    """Remove script/style bodies, tags and entities; collapse whitespace."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    x = F.regexp_replace(x, TAG_RE, " ")
    x = F.regexp_replace(x, ENTITY_RE, " ")
    x = F.regexp_replace(x, SPACES_RE, " ")
    return F.trim(x)


def strip_for_tokens(c: Column | str) -> Column:
    """Strip HTML, URLs, markdown punctuation and emoji before scoring."""
    x = strip_html(c)
    x = F.regexp_replace(x, URL_RE, " ")
    x = F.regexp_replace(x, MD_RE, " ")
    x = F.regexp_replace(x, EMOJI_RE, " ")
    x = F.regexp_replace(x, SPACES_RE, " ")
    return F.trim(x)


def truncate(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, 1, n)


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    sw = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens, lambda t: ~F.array_contains(sw, t))


# Fixed value: default English stop words (the reference names the step
# but gives no list; this short list is our own parameter default).
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "will", "with", "i", "you", "we", "they",
]
