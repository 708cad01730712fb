"""Text cleaning as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented Latin letters, each with its plain letter below it.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of two or more white-space characters become one space."""
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def repaired_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read right; anything else, and what would not be valid or printable, as it is."""
    suspect = c.rlike("[ÃÂ][\u0080-¿]") & ~c.rlike("[^\u0000-ÿ]")
    back = F.try_validate_utf8(F.when(suspect, F.encode(c, "ISO-8859-1")).cast("string"))
    return F.when(suspect & back.isNotNull() & ~back.rlike(r"[\x00-\x1f\x7f]"), back).otherwise(c)


def normal_key(c: Column) -> Column:
    """The form in which values are looked up: plain lower-case letters, dots as spaces, & as e, single spaces."""
    plain = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    spaced = F.replace(F.replace(F.lower(plain), F.lit("."), F.lit(" ")), F.lit("&"), F.lit(" e "))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


@F.pandas_udf(T.StringType())
def normal_key_exact(values: pd.Series) -> pd.Series:
    """normal_key() by full Unicode decomposition, for letters beyond Latin-1. Fixed: dots as spaces, & as e."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        plain = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()
        return " ".join(plain.replace(".", " ").replace("&", " e ").split())

    return values.map(one)


def length_between(c: Column, least: int | None, most: int | None) -> Column:
    n = F.char_length(trimmed(c))
    ok = F.lit(True)
    if least is not None:
        ok = ok & (n >= least)
    if most is not None:
        ok = ok & (n <= most)
    return ok


def parsed_decimal(c: Column) -> Column:
    """struct(num, parse): 1.234,56 and 1234.56; parse is ok, empty or not_numeric."""
    s = F.trim(c)
    comma = s.rlike(r"^-?\d{1,3}(\.\d{3})*,\d+$|^-?\d+,\d+$")
    value = F.when(comma, F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).otherwise(s).try_cast("double")
    return F.struct(value.alias("num"), F.when(c.isNull() | (s == ""), "empty").when(value.isNull(), "not_numeric").otherwise("ok").alias("parse"))


def lenient_int(c: Column) -> Column:
    """The whole number that a text is but for white space around it, a sign included; null for anything else or beyond 64 bits."""
    s = F.regexp_replace(c.cast("string"), r"^[\s]+|[\s]+$", "")
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def extracted_number(c: Column, prefix: str) -> Column:
    """The digits of values that are ``prefix`` and digits as a whole, else null."""
    return F.nullif(F.regexp_extract(c, f"^{prefix}(\\d+)$", 1), F.lit("")).try_cast("bigint")


# Patterns of personal data, applied in this order.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "[id]"),
    (r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", "[id]"),
    (r"\+?\d{1,3}[ .-]?\(?\d{2,3}\)?[ .-]?\d{3,5}[ .-]?\d{4}", "[phone]"),
    (r"\d{7,}", "[number]"),
    (r"\B@[A-Za-z0-9_]{2,}", "[handle]"),
)


def slug(c: Column) -> Column:
    """Plain lower-case letters and digits, anything else a space."""
    plain = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def slug_of(value: str) -> str:
    """slug() of one value, by full Unicode decomposition. Fixed: terms are compared in this form."""
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", plain).split())


#: Lower-case words that may stand inside a name.
PARTICLES = ("da", "das", "de", "del", "der", "di", "do", "dos", "du", "e", "la", "le", "van", "von", "y")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class NameScan:
    """Finds names: two or more capitalised words in a row, with at most two particles between neighbours.

    A row of words ends at anything but white space, so a name does not go over a sign. Openers, words that begin
    sentences, are no part of a name at its front. Rows that are words in a row of an allowed term are no names; all such
    runs are indexed, so a row costs one look-up however many terms there are.
    """

    def __init__(self, allow: tuple[str, ...] = (), openers: tuple[str, ...] = (), particles: tuple[str, ...] = PARTICLES) -> None:
        self.openers, self.particles = {w.lower() for w in openers}, set(particles)
        terms = [slug_of(t).split() for t in allow]
        self.allowed = {tuple(t[i:j]) for t in terms for i in range(len(t)) for j in range(i + 1, len(t) + 1)}

    def rows(self, text: str) -> list[list[re.Match]]:
        """Words in a row: all but white space between two parts them."""
        out: list[list[re.Match]] = []
        for word in _WORD.finditer(text):
            if out and text[out[-1][-1].end() : word.start()].isspace():
                out[-1].append(word)
            else:
                out.append([word])
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = []
        for row in self.rows(text):
            name: list[re.Match] = []
            between = 0
            for word in [*row, None]:
                if word is not None and word[0][0].isupper() and not word[0].isupper():
                    name.append(word)
                    between = 0
                elif word is not None and name and word[0] in self.particles and between < 2:
                    between += 1
                else:
                    found += self._span(name)
                    name, between = [], 0
        return found

    def _span(self, name: list[re.Match]) -> list[tuple[int, int]]:
        while name and name[0][0].lower() in self.openers:
            name = name[1:]
        if len(name) < 2 or tuple(w for m in name for w in slug_of(m[0]).split()) in self.allowed:
            return []
        return [(name[0].start(), name[-1].end())]

    def hidden(self, text: str, mark: str) -> str:
        out, at = [], 0
        for a, b in self.spans(text):
            out += [text[at:a], mark]
            at = b
        return "".join(out) + text[at:]


def without_names(c: Column, allow: tuple[str, ...] = (), openers: tuple[str, ...] = (), mark: str = "[name]", particles: tuple[str, ...] = PARTICLES) -> Column:
    """Text without names, by NameScan over Arrow batches; runs behind redacted(). Null stays null."""
    scan = NameScan(allow, openers, particles)

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else scan.hidden(v, mark))

    return run(c)


def redacted(c: Column) -> Column:
    """Text without e-mail addresses, tax ids, phone numbers, long digit runs and handles."""
    for pattern, mark in REDACTIONS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def with_personal_data(c: Column) -> Column:
    return redacted(c) != c
