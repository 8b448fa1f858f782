"""Scalar functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(x: Column, digits: int) -> Column:
    """x to ``digits`` decimal places (0 to 15) by its exact binary value, ties to even: what Python's ``round`` gives.

    ``round`` of the engine goes by the shortest decimal text of x and rounds halves up. Here the error of x times a power
    of ten is found exactly by splitting both factors, so the side of the half on which the true product lies is known.
    Numbers so large that no double lies between two decimals of that length, NaN and infinities stay as they are.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be in 0..15")
    power, split = 10.0**digits, 134217729.0
    high = lambda v: v * split - (v * split - v)  # noqa: E731  the upper half of v's bits
    b1 = high(power)
    b2 = power - b1
    x = x.cast("double")
    p, a1 = x * power, high(x)
    a2 = x - a1
    error = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    floor = F.floor(p).cast("double")
    below = (p == floor) & (error < 0)
    low = F.when(below, floor - 1).otherwise(floor)
    over = F.when(below, 0.5).otherwise(p - floor - 0.5)
    up = (over > -error) | (over == -error) & (F.pmod(low, F.lit(2.0)) == 1)
    return F.when(F.abs(x) * power < 2.0**53, (low + F.when(up, 1.0).otherwise(0.0)) / power).otherwise(x)


def rounded(x: Column, digits: int | None, wide: int) -> Column:
    """x as it is shipped, to ``digits``; without them, to ``wide`` digits for the steps that follow."""
    return F.round(x, wide) if digits is None else exact_round(x, digits)


def clamp01(x: Column) -> Column:
    """x in 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hex16(h: Column) -> Column:
    """64-bit fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming_likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector is an error."""
    n = norm(a)
    return F.when(n == 0, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def digest_byte(text: Column, i: Column | int) -> Column:
    """Byte i of sha256."""
    at = (F.lit(i) if isinstance(i, int) else i) * 2 + 1
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, F.lit(2)), 16, 10).cast("int")


def fake_embedding(key: Column, size: int = 64) -> Column:
    """Deterministic stand-in for an embedding: bytes of sha256, cycled, over 255, less a half."""
    digest = F.sha2(key.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)


def length_score(title: Column) -> Column:
    """Titles of 6 to 22 code points get 2; others lose by their distance from 14; an empty one -10."""
    n = F.char_length(title)
    return F.when(n <= 0, F.lit(-10.0)).when(n.between(6, 22), F.lit(2.0)).otherwise(-F.abs(n - 14) * 0.15)


def title_score(title: Column, index: Column, subject: Column | None = None) -> Column:
    """Length, question (+1), exclamation (+0.5) and subject (+1.5), and a hash of title and index below 0.256."""
    asks = F.when(title.contains("？") | title.contains("?"), 1.0).otherwise(0.0)
    shouts = F.when(title.contains("！") | title.contains("!"), 0.5).otherwise(0.0)
    names = F.when(title.contains(subject), 1.5).otherwise(0.0) if subject is not None else F.lit(0.0)
    return length_score(title) + asks + shouts + F.coalesce(names, F.lit(0.0)) + digest_byte(F.concat(title, F.lit("#"), index.cast("string")), 0) / 1000.0


#: Names that a file can't have.
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4")


def sanitize_title(title: Column, most: int = 60) -> Column:
    """A file name from a title: without path and wildcard signs, control characters, outer blanks and dots."""
    bare = F.regexp_replace(title, r'[<>:"/\\|*\x00-\x1F]', "")
    blank = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    trim = lambda c: F.regexp_replace(c, f"^{blank}|{blank}$", "")
    name = trim(F.substring(F.regexp_replace(trim(bare), r"^\.+|\.+$", ""), 1, most))
    return F.when((name == "") | F.lower(name).isin(*RESERVED), F.lit("untitled_clip")).otherwise(name)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), r"(?<=.)\.[^.]*$", "")


def force_mp4(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".mp4"), name).otherwise(F.concat(name, F.lit(".mp4")))


#: Fixed value: what an answer that can't be read becomes.
UNCERTAIN = {"verdict": "uncertain", "parse_error": "true"}


def parse_answer(text: Column) -> Column:
    """A model's JSON object (code fence stripped) as a map of strings; anything else is UNCERTAIN."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    looks = F.trim(bare).rlike(r"(?s)^\{.*\}$")
    parsed = F.when(looks, F.from_json(bare, "map<string,string>"))
    fallback = F.create_map(*[F.lit(x) for kv in UNCERTAIN.items() for x in kv])
    return F.when(F.size(parsed) >= 0, parsed).otherwise(fallback)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
