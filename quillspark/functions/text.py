"""Text functions as column expressions: tokens, n-grams, header filter, decoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two or more letters, digits or underscores. Combining marks end a word.
TOKEN = r"[\p{L}\p{N}_]{2,}"
HEADER_NAMES = ("To", "From", "Date", "Cc", "Sent")


def tokens(text: Column, lower: bool = True) -> Column:
    """Words of two or more characters, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def without(words: Column, stop: Sequence[str]) -> Column:
    """The words that are not stop words."""
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def _sizes(size: tuple[int, int]) -> range:
    low, high = size
    if not 1 <= low <= high:
        raise ValueError(f"n-gram range must be 1 <= low <= high, not {size}")
    return range(low, high + 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. What a lambda refers to from outside is else
    computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(items: Column, n: int, joiner: str) -> Column:
    """Each ``n`` neighbours of an array of strings, joined."""
    empty = F.array().cast("array<string>")
    joined = lambda i: F.concat_ws(joiner, *[F.get(items, i + k) for k in range(n)])
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), joined)).otherwise(empty)


def _all_windows(items: Column, size: tuple[int, int], joiner: str) -> Column:
    sizes = _sizes(size)
    return let(items, lambda x: F.concat(*[_windows(x, n, joiner) for n in sizes]))


def ngrams(words: Column, size: tuple[int, int]) -> Column:
    """Word n-grams of all sizes, joined by a space; shorter sizes first."""
    return words if size == (1, 1) else _all_windows(words, size, " ")


def _characters(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))


def char_ngrams(text: Column, size: tuple[int, int]) -> Column:
    """Character n-grams of the lower-case text with runs of white space as one space."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s\s+", " ")
    return _all_windows(_characters(t), size, "")


def char_wb_ngrams(text: Column, size: tuple[int, int]) -> Column:
    """Character n-grams within words padded by one space on each side. A padded word that is
    no longer than n is emitted whole, at the first such n only."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    low, sizes = size[0], _sizes(size)
    empty = F.array().cast("array<string>")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        part = lambda x, n: F.when(F.size(x) >= n, _windows(x, n, "")).otherwise(F.array(F.array_join(x, "")) if n == low else empty)
        return let(_characters(padded), lambda x: F.concat(*[part(x, n) for n in sizes]))

    return F.flatten(F.transform(words, of_word))


def analyze(text: Column, analyzer: str = "word", size: tuple[int, int] = (1, 1), stop: Sequence[str] = ()) -> Column:
    """Terms of a text; stop words go before n-grams are formed."""
    if analyzer == "word":
        return ngrams(without(tokens(text), stop), size)
    if analyzer == "char":
        return char_ngrams(text, size)
    if analyzer == "char_wb":
        return char_wb_ngrams(text, size)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def ignore_headers(text: Column) -> Column:
    """The text without lines that begin, after white space, with an e-mail header name."""
    lines = F.split(text, r"\r\n|\n|\r")
    marked = rf"^\s*({'|'.join(HEADER_NAMES)}):"
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(marked)), "\n")


#: Named text filters; callers may add their own column functions.
FILTERS: dict[str, Callable[[Column], Column]] = {"emails_ignore_header": ignore_headers}


def preprocess(text: Column, filters: Sequence[str] = ()) -> Column:
    for name in filters:
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}; there are {sorted(FILTERS)}")
        text = FILTERS[name](text)
    return text


def decode_utf8(raw: Column) -> Column:
    """UTF-8 bytes as text; invalid bytes are dropped (and with them genuine U+FFFD)."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def strip_tags(html: Column) -> Column:
    """Text of mark-up by pattern only: tags become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<script\b.*?</script>|<style\b.*?</style>", " "), r"<[^>]*>", " "))


def counts(items: Column) -> Column:
    """Array of (term, tf), by term, from an array of terms: runs of the sorted array."""
    starts = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
    run = lambda x, s, i, k: F.struct(F.get(x, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(x)) - i).cast("bigint").alias("tf"))
    some = lambda x: let(starts(x), lambda s: F.transform(s, lambda i, k: run(x, s, i, k)))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.sort_array(items), lambda x: F.when(F.size(x) > 0, some(x)).otherwise(none))
