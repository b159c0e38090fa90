"""Text functions as Spark columns: Unicode-aware stripping, segmentation, counting, hashing. NULL and '' are alike."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character of Unicode, with the four separators U+001C to U+001F.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Sentence ends, full-width with the line feed, and half-width.
FULL_WIDTH_ENDS = "。！？；\n"
HALF_WIDTH_ENDS = ".!?;"


def text_of(c: str | Column) -> Column:
    """The column, '' for NULL."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def u_strip(c: str | Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(text_of(c), F.lit(WHITESPACE))


def u_squash(c: str | Column) -> Column:
    """Without any Unicode white space."""
    return F.translate(text_of(c), WHITESPACE, "")


def normalized(c: str | Column, case_sensitive: bool = True) -> Column:
    """The form that containment is tested on: squashed, lower-cased unless case counts."""
    return u_squash(c) if case_sensitive else F.lower(u_squash(c))


def is_blank(c: str | Column) -> Column:
    return u_strip(c) == ""


def segments(c: str | Column, min_length: int = 6) -> Column:
    """Array of a text's units in order: split at runs of sentence ends, stripped, at least so many characters long.

    The filter works on the array, so numbering units needs no window and no shuffle.
    """
    pieces = F.split(text_of(c), f"[{FULL_WIDTH_ENDS}]+|[{HALF_WIDTH_ENDS}]+", -1)
    return F.filter(F.transform(pieces, u_strip), lambda u: F.length(u) >= min_length)


def length_bucket(c: str | Column, short_max: int = 15, medium_max: int = 40) -> Column:
    n = F.length(u_strip(c))
    return F.when(n <= short_max, "short").when(n <= medium_max, "medium").otherwise("long")


def contains_any(c: str | Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring."""
    text = text_of(c)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def count_terms(c: str | Column, words: Iterable[str]) -> Column:
    """Occurrences of each literal term that don't overlap, added up."""
    text = text_of(c)
    each = [((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words if w]
    return reduce(lambda a, b: a + b, each, F.lit(0))


def has_url(c: str | Column) -> Column:
    return F.rlike(text_of(c), F.lit("(?i)https?://"))


def has_cjk(c: str | Column) -> Column:
    return F.rlike(text_of(c), F.lit("[\\u4e00-\\u9fff]"))


def without_fence(c: str | Column) -> Column:
    """The inside of a text that is one fenced code block, else the stripped text."""
    text = u_strip(c)
    fence = "(?s)^```[A-Za-z0-9_-]*\\s*\\n?(.*?)\\n?```$"
    return F.when(F.rlike(text, F.lit(fence)), u_strip(F.regexp_extract(text, fence, 1))).otherwise(text)


def joined_key(parts: Iterable[str | Column], separator: str = "|") -> Column:
    """Parts with a separator between; NULL stands as ''."""
    return F.concat_ws(separator, *[text_of(p) for p in parts])


def seeded(seed: str, *parts: str | Column) -> Column:
    """A pseudo-random order that depends on the values only, never on partitions."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[text_of(p).cast("string") for p in parts]), 256)


def digest_mod3(digest: Column) -> Column:
    """A hexadecimal number of up to 75 digits mod 3: 16 is 1 mod 3, so the sum of its stretches of 15 digits, which fit in a long, mod 3."""
    parts = [F.coalesce(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % 3, F.lit(0)) for at in range(1, 75, 15)]
    return F.when(digest.isNotNull(), (reduce(lambda a, b: a + b, parts) % 3).cast("int"))


def digest_divisible_by_6(digest: Column) -> Column:
    return (digest_mod3(digest) == 0) & F.right(digest, F.lit(1)).isin(*"02468ace")


def masked(c: str | Column) -> Column:
    """URLs, e-mail addresses, phone numbers and @handles replaced by placeholders."""
    out = text_of(c)
    for kind, pattern in PRIVATE_PATTERNS.items():
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return out


#: In the order in which they are masked.
PRIVATE_PATTERNS = {
    "URL": "[Hh][Tt][Tt][Pp][Ss]?://[^ \\t\\n\\r]+",
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+",
    "PHONE": "\\+?[0-9][0-9() -]{7,}[0-9]",
    "MESSENGER": "(?i)(qq|vx|wx|wechat|telegram|whatsapp)[ ]?[:=][ ]?[a-z0-9_-]{5,}",
    "HANDLE": "@[A-Za-z0-9_]{2,}",
}


def cleaned(c: str | Column) -> Column:
    """Reply headers, quote residue and image placeholders dropped, white space collapsed."""
    out = F.regexp_replace(text_of(c), "(?im)^\\s*(re|reply to|回复)\\s*[@:：][^\\n]*$", " ")
    out = F.regexp_replace(out, "(?m)^\\s*>+[^\\n]*$", " ")
    out = F.regexp_replace(out, "(?i)\\[(image|img|图片|表情)\\]", " ")
    return u_strip(F.regexp_replace(out, "(?U)[\\s\\x1c-\\x1f]+", " "))
