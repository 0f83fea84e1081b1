"""Text functions: normal form, tokenizers, n-grams, corruptions, set likeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons

WORD = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"
TAXONOMY_WORD = "[a-z0-9]+(?:'[a-z0-9]+)?"
STRATA_WORD = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"


def fold_case(x: Column) -> Column:
    """Lower case with sharp s as ss, the one place where case folding differs in our texts."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold_case(x), r"\s+", " "))


def words(x: Column) -> Column:
    return F.regexp_extract_all(fold_case(x), F.lit(WORD), F.lit(0))


def taxonomy_words(x: Column) -> Column:
    return F.regexp_extract_all(fold_case(x), F.lit(TAXONOMY_WORD), F.lit(0))


def strata_words(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(STRATA_WORD), F.lit(0)), lambda w: F.lower(w))


def pieces(x: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def split_words(x: Column) -> Column:
    """Runs of non-space; none for a blank text."""
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, many).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    """n-grams of every size from low to high, size by size."""
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def punctuation_count(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, r"\p{P}", ""))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Likeness of two arrays as sets; two empty ones have the likeness `empty`."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(empty))).otherwise(F.size(F.array_intersect(a, b)) / union)


def stable_seed(*parts: Column) -> Column:
    """The first four bytes of the SHA-256 of the parts, joined by NUL, big-endian."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def case_low(x: Column) -> Column:
    """The first letter in lower case."""
    head = F.regexp_extract(x, r"^[^\p{L}]*", 0)
    at = F.length(head)
    return F.concat(head, F.lower(F.substring(x, at + 1, F.lit(1))), F.substring(x, at + 2, F.length(x)))


def case_high(x: Column) -> Column:
    return F.upper(x)


def punctuation_low(x: Column) -> Column:
    """Without the marks that end the text."""
    return F.regexp_replace(F.rtrim(x), "[.,!?;:]+$", "")


def punctuation_high(x: Column) -> Column:
    """Every mark a space."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row; what a lambda over an array refers to is computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def delete_words(x: Column, seed: Column, share: float | None) -> Column:
    """A cyclic run of words gone, from a place the seed picks: one, or that share rounded up.

    Of three words or more the first always stays; of two, one goes; a text of at most one word stays as it is.
    """
    def cut(s: Column) -> Column:
        n = F.size(s["w"])
        fixed = F.when(n > 2, 1).otherwise(0)
        places = n - fixed
        count = F.least(F.lit(1) if share is None else F.greatest(F.lit(1), F.ceil(n * share).cast("int")), places)
        start = F.pmod(s["seed"], F.greatest(places, F.lit(1)).cast("long")).cast("int")
        run = F.struct(s["w"].alias("w"), fixed.alias("fixed"), F.greatest(places, F.lit(1)).alias("places"), count.alias("count"), start.alias("start"))
        kept = lambda r: F.filter(r["w"], lambda word, i: (i < r["fixed"]) | (F.pmod(i - r["fixed"] - r["start"], r["places"]) >= r["count"]))
        return F.when(n <= 1, s["x"]).otherwise(F.array_join(bound(run, kept), " "))

    return bound(F.struct(x.alias("x"), split_words(x).alias("w"), seed.alias("seed")), cut)


def shorten(x: Column, share: float) -> Column:
    """That share of the words from the front, rounded up, at least one."""
    w = split_words(x)
    return F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.ceil(F.size(w) * share).cast("int"))), " ")


def typo(x: Column, seed: Column, high: bool = False) -> Column:
    """Two neighbouring letters swapped, at a place the seed picks among those where both are letters.

    In high severity another such place, unless it is one of the two, gets an x, or a q where an x is.
    """

    def pairs(s: Column) -> Column:
        both = lambda i: F.concat(F.get(s["chars"], i - 1), F.get(s["chars"], i))
        return F.filter(F.sequence(F.lit(1), F.greatest(F.size(s["chars"]) - 1, F.lit(1))), lambda i: F.regexp_like(both(i), F.lit(r"^\p{L}{2}$")))

    def swap(s: Column) -> Column:
        x, places = s["x"], s["places"]
        n = F.greatest(F.size(places), F.lit(1)).cast("long")
        at = F.get(places, F.pmod(s["seed"], n).cast("int"))
        swapped = F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.lit(1)), F.substring(x, at, F.lit(1)), F.substring(x, at + 2, F.length(x)))
        if high:
            other = F.get(places, F.pmod(F.floor(s["seed"] / 17) + 1, n).cast("int"))
            letter = F.when(F.lower(F.substring(swapped, other, F.lit(1))) == "x", "q").otherwise("x")
            changed = F.concat(F.substring(swapped, F.lit(1), other - 1), letter, F.substring(swapped, other + 1, F.length(swapped)))
            swapped = F.when((F.size(places) > 1) & ~other.isin(at, at + 1), changed).otherwise(swapped)
        return F.when(F.size(places) == 0, x).otherwise(swapped)

    chars = F.struct(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)).alias("chars"))
    return bound(F.struct(x.alias("x"), seed.alias("seed"), bound(chars, pairs).alias("places")), swap)


def without_token(tokens: Column, i: Column) -> Column:
    """The tokens without the i-th (from 0), joined as text; a mask if none is left."""
    text = F.array_join(F.filter(tokens, lambda t, k: k != i), " ")
    for pattern in (r"\s+([,.;!?%])", r"([(\[/{])\s+", r"\s+([)\]}])"):
        text = F.regexp_replace(text, pattern, "$1")
    return F.when(F.trim(text) == "", F.lit("[MASK]")).otherwise(F.trim(text))


def token_category(token: Column) -> Column:
    """What a token is by the fixed lists, the first that holds it."""
    low, kind = F.lower(token), F
    for name, listed in (
        ("object_heuristic", lexicons.TOKEN_OBJECTS),
        ("action_heuristic", lexicons.TOKEN_ACTIONS),
        ("attribute_heuristic", lexicons.TOKEN_ATTRIBUTES),
        ("spatial_heuristic", lexicons.TOKEN_SPATIAL),
        ("stopword_like_heuristic", lexicons.TOKEN_STOPWORDS),
    ):
        kind = kind.when(low.isin(listed), name)
    return kind.otherwise("other_token")
