"""Text functions: Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import lexicon as L

# Patterns of words, of term tokens (À-ÿ holds × and ÷ too, as it always did) and of segment ends.
WORD = "[a-zàâäéèêëïîôöùûüçœæ]+"
TOKEN = "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ']*(?:-[A-Za-zÀ-ÿ']+)*"
SEGMENT_END = '[.!?;:,()\\[\\]"“”—•|]+'
_W = "A-Za-z0-9_À-ÖØ-öø-ÿ"
#: Letters, digits and underscore of any script.
WORD_CHAR = "\\p{L}\\p{N}_"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Unicode NFC; texts of Latin and Vietnamese letters, dashes and quotes alone don't change by it and don't go through the UDF."""
    return F.coalesce(nfc(F.when(text.rlike("[^\\x{0}-\\x{2FF}\\x{1E00}-\\x{1EFF}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}\\x{20AC}]"), text)), text)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def words(text: Column) -> Column:
    """Lower-case French and English words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def hits(tokens: Column, listed: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(sorted(set(listed)))))


def language(n: Column, en: Column, fr: Column, least: int = 500, share: float = 0.05, ratio: float = 3.0) -> Column:
    """en, fr, or null where the counts don't decide: too few words, shares too small or too near to each other."""
    es, fs = en / n, fr / n
    top, low = F.greatest(es, fs), F.least(es, fs)
    clear = F.when(low == 0, F.lit(True)).otherwise(top / low >= ratio)
    return F.when((n >= least) & (top >= share) & clear, F.when(es >= fs, "en").otherwise("fr"))


def tags_to_spaces(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\P{L}+", ""))


def vietnamese_letters(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, L.VIETNAMESE, ""))


def copyright_score(page: Column) -> Column:
    """Points of a page that was lower-cased and squeezed."""
    cue = lambda points, cues: sum((F.when(F.contains(page, F.lit(c)), points).otherwise(0) for c in cues), F.lit(0))
    pattern = page.rlike("copyright\\s*©|©\\s*\\d{4}|copyright\\s+\\d{4}|©\\s*[" + _W + "]+.{0,40}\\d{4}")
    return cue(2, L.STRONG_CUES) + F.when(pattern, 2).otherwise(0) + cue(1, L.WEAK_CUES)


def term_source(text: Column, fold: bool = True) -> Column:
    """Source text for terms: no markup, straight quotes, ligature fragments and hyphenated line ends joined.

    ``fold`` adds Unicode NFKC, which needs a UDF; text of ASCII, Latin-1 letters, dashes and quotes alone doesn't change by it and isn't sent there."""
    other = text.rlike("[^\\x00-\\x7FÀ-ÿ\u2013\u2014\u2018-\u201D]")
    text = F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]*\\)", " ")
    text = F.regexp_replace(tags_to_spaces(text), "(?m)^#{1,6}[ \\t]*", "")
    text = F.coalesce(nfkc(F.when(other, text)), text) if fold else text
    text = F.regexp_replace(text, "[‘’]", "'")
    text = F.regexp_replace(text, f"(?<![{_W}])(ffi|ffl|ff)[ \\t]+([a-z]{{1,20}})(?![{_W}])", "$1$2")
    text = F.regexp_replace(text, f"(?<![{_W}])([A-Za-z]*(?:fi|fl))[ \\t]+([a-z]{{1,20}})(?![{_W}])", "$1$2")
    return F.regexp_replace(text, "(?<=[a-z])-[ \\t]*\\n[ \\t]*(?=[a-z])", "")


def singular(word: Column) -> Column:
    return (
        F.when(word.endswith("ies") & (F.length(word) > 5), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text as whole words, whatever the case."""
    quoted = F.regexp_replace(F.lower(term), "([\\\\.\\[\\]{}()*+?^$|-])", "\\\\$1")
    return F.regexp_count(F.lower(text), F.concat(F.lit(f"(?<![{WORD_CHAR}])"), quoted, F.lit(f"(?![{WORD_CHAR}])")))


def entities(text: Column) -> Column:
    """Temperatures, quantities, durations, fractions: in this order, each from left to right."""
    patterns = ["(\\d+\\s?°C)", "((?i)\\d+(?:[.,]\\d+)?\\s?(?:kg|g|ml|l)\\b)", "((?i)\\d+\\s?(?:phút|phut|min|giờ|gio|h)\\b)", "(\\d+/\\d+)"]
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns))


def list_marker(line: Column) -> Column:
    """Number of a leading list marker such as ``3.`` or ``3)``; null without one."""
    return F.nullif(F.regexp_extract(line, "^\\s*(\\d{1,3})[.)]\\s+\\S", 1), F.lit("")).cast("int")


def droppable(text: Column) -> Column:
    """Content that needs no translation: nothing, digits only, one URL, a bare ISBN."""
    t = squeeze(text)
    return (t == "") | t.rlike("^[\\d\\s]+$") | t.rlike("(?i)^(https?://|www\\.)\\S+$") | t.rlike("(?i)^isbn(?:-1[03])?[\\s:-]*[\\dx][\\dx\\s-]*$")
