"""Text cleaning, tokens and terms as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from newswake.constants import PUNCTUATION, STOP_WORDS, TERM_TOKEN, URL_OR_MENTION, WORD_OR_PUNCT, WORD_TOKEN


def _letters_with_marks() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, from their Unicode decomposition."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source.append(chr(code))
            target.append(base)
    # Letters without a decomposition, and typographic signs.
    source += list("øØđĐłŁıħĦ’‘‚“”„–—")
    target += list("oOdDlLihH'',\"\"\"--")
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source) + "".join(marks), "".join(target)


_MARKED, _PLAIN = _letters_with_marks()

# One letter that becomes several.
_EXPANSIONS = [("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("þ", "th"), ("Þ", "Th"),
               ("…", "..."), ("«", "<<"), ("»", ">>"), ("€", "EUR")]


def strip_urls_mentions(text: Column) -> Column:
    return F.regexp_replace(text, URL_OR_MENTION, "")


def strip_punct(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unaccent(text: Column) -> Column:
    """Latin letters to ASCII. Letters of other scripts stay as they are."""
    for letter, plain in _EXPANSIONS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.translate(text, _MARKED, _PLAIN)


def words(text: Column) -> Column:
    """Split on whitespace; no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def remove_stopwords(tokens: Column, stop_words=STOP_WORDS) -> Column:
    """Drop the tokens whose lower form is listed."""
    return F.filter(tokens, lambda w: ~F.lower(w).isin(list(stop_words)))


def clean_title(title: Column, stop_words=STOP_WORDS) -> Column:
    plain = unaccent(collapse_ws(strip_punct(title)))
    return F.array_join(remove_stopwords(words(plain), stop_words), " ")


def tokenize_wordpunct(text: Column) -> Column:
    """Runs of word characters or of punctuation."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_PUNCT), F.lit(0))


def tokenize_terms(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without accents: the form in which texts are searched."""
    return unaccent(F.lower(text))


def search_tokens(text: Column) -> Column:
    """Folded words. ``#word`` and ``@word`` count as ``word``."""
    return F.regexp_extract_all(fold(text), F.lit(WORD_TOKEN), F.lit(0))


def sentence_tokens(text: Column) -> Column:
    """Tokens for phrases and word vectors: no links, mentions, punctuation or capitals."""
    return tokenize_wordpunct(F.lower(strip_punct(strip_urls_mentions(text))))


def canonical_term(term: Column) -> Column:
    """Unique words of a term in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(words(term))), " ")


def safe_tag(tag: Column) -> Column:
    return F.replace(tag, F.lit("/"), F.lit("§"))


def lower_tags(tags: Column) -> Column:
    return F.transform(tags, F.lower)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a blank.

    Neighbours are paired array by array, so ``tokens`` is evaluated once per
    row and not once per element.
    """
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), count)
    for offset in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, F.lit(offset + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def term_grams(tokens: Column, n_min: int, n_max: int) -> Column:
    """All n-grams with ``n_min <= n <= n_max``, each once."""
    return F.array_distinct(F.concat(*[ngrams(tokens, n) for n in range(n_min, n_max + 1)]))
