"""Text functions as Column expressions: normalisation, tokens, n-grams, phrase tests, edit distance.

All but normalize_unicode and stem_words (pandas) stay inside the JVM.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The token alphabets and patterns that the retrieval data is defined with.
TOKEN = "[0-9A-Za-zÅÄÖåäöÉéÜü]+"
WORD_TOKEN = "[0-9a-zåäö+#]+"
SEPARATORS = r"[\s\-_/(),.;:]+"
SPACE = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"https?://[^\s<>]+"
URL = LINK + r"|(?i:www\.)[^\s<>]+"
PHONE = r"(^|[^0-9A-Za-z_])(?:\+46|0)[0-9][0-9 ()/-]{6,}[0-9]"
FUZZY_LIMITS = ((9, 2), (6, 1))


def norm(x: Column) -> Column:
    """White space collapsed and trimmed, case folded (ß becomes ss)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(x, SPACE, " "))), F.lit("ß"), F.lit("ss"))


def lower_norm(x: Column) -> Column:
    """norm() without the folding of ß."""
    return F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))


@F.pandas_udf(StringType())
def normalize_unicode(x: pd.Series, form: pd.Series) -> pd.Series:
    """NFC or NFKC."""
    return pd.Series([None if v is None else unicodedata.normalize(f, v) for v, f in zip(x, form)])


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML character references decoded."""
    return x.map(lambda v: None if v is None else html.unescape(v))


def tokens(x: Column, pattern: str = TOKEN) -> Column:
    """All matches of the token pattern, lower-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def word_tokens(x: Column) -> Column:
    return F.regexp_extract_all(norm(F.coalesce(x, F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))


def split_tokens(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), SEPARATORS), lambda t: t != "")


def positions(last: Column) -> Column:
    """1 to last; empty where last < 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def char_ngrams(word: Column, n: int) -> Column:
    """All n-grams of characters of a string, repeats kept."""
    return F.transform(positions(F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))


def padded_ngrams(words: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """n-grams of every word with one space on either side."""
    return F.flatten(F.transform(words, lambda w: F.concat(*(char_ngrams(F.concat(F.lit(" "), w, F.lit(" ")), n) for n in sizes))))


def token_ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n tokens joined by a space; empty if there are fewer."""
    return F.array_distinct(F.transform(positions(F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))


def phrase_present(words: Column, phrase: Column) -> Column:
    """Whether the tokens of phrase stand in words one after the other; an empty phrase never does."""
    padded = [F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" ")) for x in (words, phrase)]
    return (F.size(phrase) > 0) & F.contains(*padded)


def has_surface(text: Column, surface: Column) -> Column:
    """Whether the normalised surface stands in the normalised text between spaces."""
    return (norm(surface) != "") & F.contains(F.concat(F.lit(" "), norm(text), F.lit(" ")), F.concat(F.lit(" "), norm(surface), F.lit(" ")))


def contains_surface(text: Column, surface: Column, least: int = 4) -> Column:
    return (F.length(norm(surface)) >= least) & F.contains(norm(text), norm(surface))


def fuzzy_limit(word: Column) -> Column:
    """Edits allowed for a word, by its length."""
    out = F.lit(0)
    for length, edits in sorted(FUZZY_LIMITS):
        out = F.when(F.length(word) >= length, edits).otherwise(out)
    return out


def bounded_levenshtein(a: Column, b: Column, limit: int) -> Column:
    """Edit distance, or limit + 1 where it exceeds the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    same = F.transform(positions(F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.size(F.filter(same, lambda s: s))


def pair_signal(a: Column, b: Column) -> Column:
    """struct(signal, specificity): 4 equal, 3 one holds the other (5 or more letters), 2 a shared beginning (6 or more
    letters both, 5 or more shared, 65 % of the shorter), 1 within the lesser fuzzy limit (6 or more both), 0 none."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    prefix, edits = common_prefix(a, b), F.levenshtein(a, b)
    signal = (
        F.when(a == b, 4)
        .when((shorter >= 5) & (F.contains(a, b) | F.contains(b, a)), 3)
        .when((shorter >= 6) & (prefix >= 5) & (prefix >= 0.65 * shorter), 2)
        .when((shorter >= 6) & (edits <= F.least(fuzzy_limit(a), fuzzy_limit(b))), 1)
        .otherwise(0)
    )
    specificity = F.when(signal == 2, prefix).when(signal == 1, longer - edits).when(signal > 0, shorter).otherwise(0)
    return F.struct(signal.alias("signal"), specificity.alias("specificity"))


def deletions(x: Column, times: int = 2) -> Column:
    """The word and all it becomes by leaving out up to `times` letters: words within so many edits share one."""
    out = F.array(x)
    for _ in range(times):
        without = F.flatten(F.transform(out, lambda w: F.transform(positions(F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, without))
    return out


def fuzzy_substring(needle: Column, text: Column) -> Column:
    """Smallest edit distance of needle to a window of text of its length give or take two (three at least)."""
    n = F.length(needle)

    def best(size: Column) -> Column:
        windows = F.transform(positions(F.length(text) - size + 1), lambda i: F.levenshtein(needle, F.substring(text, i, size)))
        return F.array_min(windows)

    sizes = F.transform(F.array(*(F.lit(d) for d in (-2, -1, 0, 1, 2))), lambda d: F.greatest(n + d, F.lit(3)))
    inner = F.array_min(F.filter(F.transform(F.array_distinct(sizes), best), lambda d: d.isNotNull()))
    return F.least(F.coalesce(inner, F.levenshtein(needle, text)), F.levenshtein(needle, text))


def fuzzy_accept(needle: Column, distance: Column) -> Column:
    return distance <= F.greatest(F.lit(2), F.floor(F.length(needle) * 0.25))


def direct_match(query: Column, label: Column) -> Column:
    """exact, prefix, word_boundary or contains; null otherwise."""
    q, s = norm(query), norm(label)
    return (
        F.when(q == s, "exact")
        .when(s.startswith(q), "prefix")
        .when(F.contains(F.concat(F.lit(" "), s), F.concat(F.lit(" "), q)), "word_boundary")
        .when(F.contains(s, q), "contains")
    )


def strip_markup(x: Column) -> Column:
    """Character references decoded, tags and URLs dropped, white space collapsed."""
    out = F.regexp_replace(unescape(x), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, LINK, " "), SPACE, " "))


def scrub(x: Column) -> Column:
    """E-mail addresses, URLs and phone numbers become a space."""
    for pattern in (EMAIL, URL):
        x = F.regexp_replace(x, pattern, " ")
    x = F.regexp_replace(x, PHONE, "$1 ")
    return F.trim(F.regexp_replace(x, SPACE, " "))


def work_slice(x: Column, markers: list[str], size: int = 1200) -> Column:
    """`size` characters from the earliest marker on; the beginning where there is none."""
    text = F.lower(x)
    found = F.filter(F.array(*(F.instr(text, m) for m in markers)), lambda p: p > 0)
    return F.substring(x, F.coalesce(F.array_min(found), F.lit(1)), F.lit(size))


def sentences(x: Column) -> Column:
    """Text cut after full stops, exclamation and question marks that white space follows."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def leak_free(x: Column, forbidden: list[str], least: int = 25, most: int = 80) -> Column:
    """The sentences without a forbidden surface, clipped to `most` words; null below `least` words."""
    kept = F.filter(sentences(x), lambda s: ~_holds(s, forbidden))
    return _sized(F.array_join(kept, " "), least, most)


def task_query(x: Column, markers: list[str], forbidden: list[str], least: int = 12, most: int = 50, span: int = 4) -> Column:
    """Of the first `span` sentences from the first one on that names a task, those without a forbidden surface; clipped
    to `most` words, null below `least` words or without such a sentence."""
    all_ = sentences(x)
    first = F.array_position(F.transform(all_, lambda s: _holds(s, markers) & ~_holds(s, forbidden)), True)
    taken = F.filter(F.slice(all_, F.greatest(first, F.lit(1)).cast("int"), F.lit(span)), lambda s: ~_holds(s, forbidden))
    return F.when(first > 0, _sized(F.array_join(taken, " "), least, most))


def _holds(sentence: Column, surfaces: list[str]) -> Column:
    out = F.lit(False)
    for s in surfaces:
        out = out | F.contains(norm(sentence), F.lit(s))
    return out


def _sized(x: Column, least: int, most: int) -> Column:
    return F.when(F.size(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " ")) >= least, clip_words(x, most))


def clip_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " "), 1, n), " ")


def without_numbers(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.rlike("^[0-9]+$"))


def real_definition(definition: Column, label: Column) -> Column:
    return F.coalesce((norm(definition) != "") & (norm(definition) != norm(label)), F.lit(False))


def terse(x: Column, boilerplate: str, least: int = 30) -> Column:
    return F.startswith(norm(x), F.lit(boilerplate)) | (F.length(norm(x)) < least)


def drop_middle(word: Column) -> Column:
    """The typo that leaves out the middle letter."""
    mid = F.floor(F.length(word) / 2).cast("int")
    return F.concat(F.substring(word, F.lit(1), mid), F.substring(word, mid + 2, F.length(word)))


def swap_middle(word: Column) -> Column:
    """The typo that swaps the two letters before and at the middle."""
    mid = F.floor(F.length(word) / 2).cast("int")
    return F.concat(F.substring(word, F.lit(1), mid - 1), F.substring(word, mid + 1, F.lit(1)), F.substring(word, mid, F.lit(1)), F.substring(word, mid + 2, F.length(word)))


def longest_word(words: Column, least: int = 5) -> Column:
    """The longest token of `least` letters or more, the first at ties."""
    return F.element_at(F.array_sort(F.filter(words, lambda w: F.length(w) >= least), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), 1)


def stable_hash(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256)


def hash_fraction(salt: str, key: Column) -> Column:
    """First eight hexadecimal digits of the stable hash as an integer."""
    return F.conv(F.substring(stable_hash(salt, key), 1, 8), 16, 10).cast("long")


def json_items(x: Column) -> Column:
    """An array of strings from `[...]` or `{"items": [...]}`."""
    return F.coalesce(F.from_json(x, "array<string>"), F.get(F.array(F.from_json(x, "struct<items:array<string>>")["items"]), 0))


# Fixed values of the Swedish Snowball stemmer (public algorithm): vowels and suffixes of its three steps.
VOWELS = "aeiouyäåö"
STEP_1 = (
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes"
    " ens arens hetens erns at andet het ast"
).split()
S_ENDINGS = "bcdfghjklmnoprtvy"
STEP_2 = ("dd", "gd", "nn", "dt", "gt", "kt", "tt")
STEP_3 = (("fullt", "full"), ("löst", "lös"), ("lig", ""), ("els", ""), ("ig", ""))


def swedish_stem(word: str) -> str:
    """Stem of a lower-case word: suffixes in the region after the first vowel-consonant pair go."""
    region = next((i + 1 for i in range(1, len(word)) if word[i] not in VOWELS and word[i - 1] in VOWELS), len(word))
    region = max(region, 3)

    def ends(suffix: str) -> bool:
        return word.endswith(suffix) and len(word) - len(suffix) >= region

    first = max((s for s in STEP_1 if ends(s)), key=len, default="")
    if first:
        word = word[: -len(first)]
    elif ends("s") and len(word) > 1 and word[-2] in S_ENDINGS:
        word = word[:-1]
    if any(ends(s) for s in STEP_2):
        word = word[:-1]
    third = max((p for p in STEP_3 if ends(p[0])), key=lambda p: len(p[0]), default=None)
    return word[: len(word) - len(third[0])] + third[1] if third else word


@F.pandas_udf(StringType())
def stem_words(x: pd.Series) -> pd.Series:
    """Swedish stems of a column of words; use it on distinct words and join back."""
    return x.map(lambda w: None if w is None else swedish_stem(w))


def adjacent_pairs(words: Column, prefix: str = "b:") -> Column:
    """Features of neighbouring words."""
    n = F.size(words)
    return F.transform(positions(n - 1), lambda i: F.concat(F.lit(prefix), F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))
