"""Normalisation, n-grams and label functions as columns."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOT_ABOVE = "̇"


def clean_sql(text: Column) -> Column:
    """Letters and marks in lower case, all else one space: the form that Catalyst compiles.

    Equals clean() except where Unicode case folding or NFC changes more than lower() and ß do.
    """
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(DOT_ABOVE), F.lit(""))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{M}]+", " "))


def cleaned(text: str | None, keep_diacritics: bool = True) -> str | None:
    """Case fold, NFC, without U+0307; categories L and M stay, all else becomes one space; no space at the ends.

    Without diacritics, the text is decomposed and its combining marks go.
    """
    if text is None:
        return None
    t = unicodedata.normalize("NFC", text.casefold()).replace(DOT_ABOVE, "")
    if not keep_diacritics:
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t).split())


def clean(keep_diacritics: bool = True):
    """cleaned() as a function of a column, in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cleaned(t, keep_diacritics))

    return run


def ngrams(text: Column, n: int = 3) -> Column:
    """All n-grams of a text in order, as an array; empty if the text is shorter than n. Linear in the text's length."""
    # an empty match that looks ahead; not inside a character beyond the 16-bit plane
    return F.regexp_extract_all(text, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n), F.lit(1))


def gram_counts(leaf: list[int], texts: list[str], n: int, weights: np.ndarray | None = None, table: int = 1 << 22, most: int = 1 << 62) -> tuple[list[int] | np.ndarray, list[str], list[int] | np.ndarray]:
    """leaf, gram and c of all n-grams of texts, of which leaf holds the numbers; none crosses texts. Linear in the characters.

    A gram is a number to the base of the distinct characters. Up to table numbers are counted in a table, more by sorting; beyond most, one by one.
    With weights, a row of whole numbers for each text, c is a matrix: the weighted counts by each column.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    m = len(points) - n + 1
    if m < 1:
        return [], [], []
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    base, owners = len(letters), max(leaf) + 1
    span = owners * base**n
    if span >= most and weights is not None:
        sums: dict = {}
        for x, t, w in zip(leaf, texts, weights, strict=True):
            for g, c in Counter(t[k : k + n] for k in range(len(t) - n + 1)).items():
                sums[x, g] = sums.get((x, g), 0) + c * w
        return [x for x, _ in sums], [g for _, g in sums], np.array(list(sums.values()), np.int64).reshape(-1, weights.shape[1])
    if span >= most:
        each = Counter((x, t[k : k + n]) for x, t in zip(leaf, texts, strict=True) for k in range(len(t) - n + 1))
        return [x for x, _ in each], [g for _, g in each], list(each.values())
    kind = np.int32 if span < 1 << 31 else np.int64
    number = np.zeros(0x110000, kind)
    number[letters] = np.arange(base, dtype=kind)
    code, key = number[points], np.repeat(np.array(leaf, kind), size)[:m]
    for k in range(n):
        key = key * kind(base) + code[k : k + m]
    whole, end = np.ones(len(points), bool), np.cumsum(size)
    for k in range(1, n):
        whole[(end - k)[size >= k]] = False
    key = key[whole[:m]]
    if weights is not None:
        key, place = np.unique(key, return_inverse=True)
        text = np.repeat(np.arange(len(texts)), size)[:m][whole[:m]]
        c = np.empty((len(key), weights.shape[1]), np.int64)
        for r in range(weights.shape[1]):  # sums of whole numbers below 2^53
            c[:, r] = np.bincount(place, weights[:, r].astype(np.float64)[text], len(key))
    elif span <= table:
        c = np.bincount(key)
        key = np.flatnonzero(c)
        c = c[key]
    else:
        key, c = np.unique(key, return_counts=True)
    chars = np.empty((len(key), n), "<u4")
    for k in range(n - 1, -1, -1):
        key, digit = np.divmod(key, base)
        chars[:, k] = letters[digit]
    grams = chars.tobytes().decode("utf-32-le")
    return key, [grams[k : k + n] for k in range(0, len(grams), n)], c


def safe(label: Column) -> Column:
    """Runs of what isn't a letter or digit become _, none at the ends; X if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("X"))


def dashes(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit("-"))


def devowel(text: Column) -> Column:
    return F.translate(text, "aeiou", "")


def char_cap(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def byte_cap(text: Column, n: int) -> Column:
    """The first n bytes in UTF-8, which may split a character."""
    return F.substring(F.encode(text, "UTF-8"), 1, n)


def shuffled(text: str | None, seed: int = 0) -> str | None:
    """What random.Random(seed).shuffle makes of a text's characters: the same draws, without a call for each but the generator's."""
    if text is None:
        return None
    x, draw, high = list(text), random.Random(seed).getrandbits, len(text) - 1
    while high > 0:
        bits = (high + 1).bit_length()
        low = max(0, (1 << bits - 1) - 2)  # down to where a draw has one bit less
        for i in range(high, low, -1):
            j = draw(bits)
            while j > i:
                j = draw(bits)
            x[i], x[j] = x[j], x[i]
        high = low
    return "".join(x)


def shuffle_chars(seed: int = 0):
    """A seeded permutation of a text's characters; its unigram counts stay."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: shuffled(t, seed))

    return run


def transliterate(table: dict[str, str]):
    """A text with each character replaced by the table's string: the interface for romanisers and phonemic transcribers, which are pluggable."""
    codes = str.maketrans(table)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.translate(codes))

    return run


def transcribed(text: Column, code: Column, tables: dict) -> Column:
    """struct(text, status): the text by the transcriber of its language code.

    tables: code to a character table or any function of a text. status: ok; no map (no code); not installed (no transcriber of that code);
    unchanged (the text came back as it was, or blank); error (the transcriber raised). text is null unless status is ok.
    """
    codes = {k: str.maketrans(t) if isinstance(t, dict) else t for k, t in tables.items()}

    def one(t: str, c: str | None) -> tuple[str | None, str]:
        if c is None:
            return None, "no map"
        if c not in codes:
            return None, "not installed"
        try:
            out = codes[c](t) if callable(codes[c]) else t.translate(codes[c])
        except Exception:  # of a pluggable function
            return None, "error"
        return (None, "unchanged") if out.strip() in ("", t.strip()) else (out, "ok")

    @F.pandas_udf("text string, status string")
    def run(t: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x or "", y) for x, y in zip(t, c, strict=True)], columns=["text", "status"])

    return run(text, code)


def asjp_tokens(form: Column) -> Column:
    """Symbols of a transcription: ~ joins the last 2 to one, $ the last 3; spaces, * and " are dropped."""
    start = F.array().cast("array<string>")

    def joined(acc, n):
        k = F.least(F.size(acc), F.lit(n))
        return F.when(k > 0, F.concat(F.slice(acc, 1, F.size(acc) - k), F.array(F.array_join(F.slice(acc, F.size(acc) - k + 1, F.greatest(k, F.lit(1))), "")))).otherwise(acc)

    def step(acc, c):
        return F.when(c.isin("", " ", "*", '"'), acc).when(c == "~", joined(acc, 2)).when(c == "$", joined(acc, 3)).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(F.split(form, ""), start, step)


def base_of(label: Column) -> Column:
    """The language part of a classifier's label such as __label__eng_Latn."""
    return F.element_at(F.split(F.replace(label, F.lit("__label__"), F.lit("")), "_"), 1)


def script_of(label: Column) -> Column:
    return F.element_at(F.split(F.replace(label, F.lit("__label__"), F.lit("")), "_"), -1)


def ndist(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def within(a: Column, b: Column, tolerance: float = 0.12) -> Column:
    return F.abs(a - b) <= tolerance


def fixed_family(family: Column) -> Column:
    """Cleaned family names: fixed renames, no (?) and NA for none."""
    return F.when(family == "Altaic", "Turkic").when(family == "Altaic(?)", "Koreanic").otherwise(F.coalesce(F.nullif(F.trim(F.replace(family, F.lit("(?)"), F.lit(""))), F.lit("")), F.lit("NA")))


def fixed_script(language: Column, script: Column) -> Column:
    """The script of a language's metadata; Icelandic's is Latin whatever they say."""
    return F.when(language == "Icelandic", "Latin").otherwise(script)
