"""Cleaning of text and prices as column expressions.

Spark has no entity decoding and no NFKC, so those two share one Arrow
function, with the removal of control characters that stands between them; all
else is built in.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that cleaning removes.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
CURRENCY = "[$€£¥₹₽₿¢₩₪]"
#: Emoji without the wide last range, which also takes CJK, kana and Hangul.
EMOJI_NARROW = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{24FF}\x{1F170}-\x{1F251}]+"
SPECIAL = r"(?U)[^\w\s.,!?-]"


@functools.cache
def _decode(decode: bool, normalize: bool):
    """One function for each pair of flags, so that a plan which decodes a text several times does it once."""
    control = re.compile(CONTROL)

    def fix(text: str | None) -> str | None:
        if not text:
            return text
        text = html.unescape(text) if decode and "&" in text else text
        text = control.sub("", text)
        return unicodedata.normalize("NFKC", text) if normalize and not text.isascii() else text

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(fix, texts.to_pylist()), pa.string())

    return run


@dataclass(frozen=True)
class Cleaner:
    """What clean() does, step by step; custom steps map a column to a column and come last."""

    decode_html: bool = True
    normalize_unicode: bool = True
    remove_emojis: bool = True
    narrow_emojis: bool = False
    remove_currency: bool = False
    strip_whitespace: bool = True
    lowercase: bool = False
    custom: tuple[Callable[[Column], Column], ...] = field(default=())

    def clean(self, text: Column) -> Column:
        """The cleaned text; null and empty give the empty string."""
        c = F.coalesce(text, F.lit(""))
        if self.decode_html or self.normalize_unicode:
            c = _decode(self.decode_html, self.normalize_unicode)(c)
        else:
            c = F.regexp_replace(c, CONTROL, "")
        if self.remove_emojis:
            c = F.regexp_replace(c, EMOJI_NARROW if self.narrow_emojis else EMOJI, "")
        if self.remove_currency:
            c = F.regexp_replace(c, CURRENCY, "")
        if self.strip_whitespace:
            c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
        if self.lowercase:
            c = F.lower(c)
        for step in self.custom:
            c = step(c)
        return c


DEFAULT = Cleaner()
STRICT = Cleaner(remove_currency=True, custom=(lambda c: F.regexp_replace(c, SPECIAL, ""),))
MINIMAL = Cleaner(remove_emojis=False)
#: Without the Arrow step, for text known to have no entities and to be in NFKC.
NATIVE = Cleaner(decode_html=False, normalize_unicode=False)


def clean_price(price: Column) -> Column:
    """The first number in a price, null if there is none; a comma is the decimal mark, and with one points group digits. The sign is lost."""
    bare = F.trim(F.regexp_replace(price, CURRENCY, ""))
    comma, point = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    plain = F.when(comma & point, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(bare)
    return F.regexp_extract(plain, "[0-9.]+", 0).try_cast("double")


def page_text(page: Column, cleaner: Cleaner = DEFAULT) -> Column:
    """Visible text of HTML, cleaned."""
    from .detect import markup_removed

    return cleaner.clean(markup_removed(page, comments=True))


def ended_references(page: Column) -> Column:
    """HTML in which only what ends in a semicolon is a character reference; other ampersands are text.

    Decoding takes `&amp` and `&copy=1` for references too, as browsers do and the cleaner by default; where text was cut, or URLs stand in it, that is not wanted.
    """
    return F.regexp_replace(page, "&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def rating_number(word: Column) -> Column:
    """One to Five as a number, null for any other word."""
    names = ["One", "Two", "Three", "Four", "Five"]
    return F.when(F.array_contains(F.array(*map(F.lit, names)), word), F.array_position(F.array(*map(F.lit, names)), word).cast("int"))


def size_reduction(original: Column, cleaned: Column) -> Column:
    """Percent of characters removed; 0 for nothing."""
    return F.when(original == 0, F.lit(0.0)).otherwise((original - cleaned) / original * 100)
