"""Text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def accent_pairs() -> tuple[str, str]:
    """Lower-case Latin letters with a combining mark, and the bare letters they decompose to."""
    marked, bare = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        kept = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if len(letter) == 1 and len(kept) == 1 and kept != letter and letter not in marked:
            marked.append(letter)
            bare.append(kept)
    return "".join(marked), "".join(bare)


def normalise_name(value: Column) -> Column:
    """Lower case, no accents, spaces and hyphens as underscores."""
    marked, bare = accent_pairs()
    plain = F.translate(F.lower(value), marked + " -", bare + "__")
    return F.regexp_replace(plain, r"[\u0300-\u036f]", "")


def blocks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, in one linear scan."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def sliding_pieces(pieces: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters starting every ``step`` characters, from ``blocks(text, step)``.

    Pass the blocks as a column of their own: then a long text is read once and not once per window.
    """
    span = -(-size // step)
    return F.transform(pieces, lambda _, i: F.left(
        F.array_join(F.slice(pieces, i + 1, F.lit(span)), ""), F.lit(size)))


def token_estimate(value: Column) -> Column:
    """0 for an empty text, else a quarter of its characters, at least 1."""
    length = F.char_length(F.coalesce(value, F.lit("")))
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / 4))).cast("int")


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded on its exact binary value."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")
