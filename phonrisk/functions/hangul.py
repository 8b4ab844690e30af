"""Hangul as column expressions: decompose, compose, classify. No row functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modern jamo alphabets in Unicode order, "-" = no coda, "?" = no response.
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
NUCLEI = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = "-ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
NO_CODA = "-"
NO_RESPONSE = "?"
NULL_ONSET = "ㅇ"
POSITIONS = ("onset", "nucleus", "coda")
ALPHABET = {"onset": ONSETS, "nucleus": NUCLEI, "coda": CODAS}

# Phonological classes.
PHONATION = {
    "lax": "ㄱㄷㅂㅅㅈㅎ", "tense": "ㄲㄸㅃㅆㅉ", "aspirated": "ㅊㅋㅌㅍ",
    "nasal": "ㄴㅁ", "liquid": "ㄹ", "none": "ㅇ",
}
PLACE = {
    "bilabial": "ㅁㅂㅃㅍ", "alveolar": "ㄴㄷㄸㄹㅅㅆㅌ", "alveolo_palatal": "ㅈㅉㅊ",
    "velar": "ㄱㄲㅋ", "glottal": "ㅎ", "none": "ㅇ",
}
MANNER = {
    "stop": "ㄱㄲㄷㄸㅂㅃㅋㅌㅍ", "affricate": "ㅈㅉㅊ", "fricative": "ㅅㅆㅎ",
    "nasal": "ㄴㅁ", "liquid": "ㄹ", "none": "ㅇ",
}
SHAPE = {
    "monophthong": "ㅏㅐㅓㅔㅗㅚㅜㅟㅡㅣ", "y_glide": "ㅑㅒㅕㅖㅛㅠ",
    "w_glide": "ㅘㅙㅝㅞ", "ui": "ㅢ",
}
ROUNDED = "ㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠ"
CODA_SURFACE = {
    "ㄱ": "ㄱㄲㄳㄺㅋ", "ㄴ": "ㄴㄵㄶ", "ㄷ": "ㄷㅅㅆㅈㅊㅌㅎ", "ㄹ": "ㄹㄼㄽㄾㅀ",
    "ㅁ": "ㄻㅁ", "ㅂ": "ㄿㅂㅄㅍ", "ㅇ": "ㅇ",
}
CODA_CLUSTERS = "ㄳㄵㄶㄺㄻㄼㄽㄾㄿㅀㅄ"
SURFACE_CODAS = "-ㄱㄴㄷㄹㅁㅂㅇ"
STRUCTURES = ("V", "VC", "CV", "CVC")
DESIGN_SIZE = len(ONSETS) * len(NUCLEI) * len(SURFACE_CODAS)

FIRST, LAST = 0xAC00, 0xD7A3
SYLLABLE_CLASS = "[가-힣]"


def class_of(groups: dict[str, str], symbol: str) -> str | None:
    """Name of the group a symbol falls in."""
    return next((name for name, members in groups.items() if symbol in members), None)


def is_syllable(ch: Column) -> Column:
    return F.ascii(ch).between(FIRST, LAST) & (F.char_length(ch) == 1)


def _offset(ch: Column) -> Column:
    return F.ascii(ch) - F.lit(FIRST)


def onset_index(ch: Column) -> Column:
    return (_offset(ch) / 588).cast("int")


def nucleus_index(ch: Column) -> Column:
    return (_offset(ch) % 588 / 28).cast("int")


def coda_index(ch: Column) -> Column:
    return (_offset(ch) % 28).cast("int")


def onset(ch: Column) -> Column:
    return F.substr(F.lit(ONSETS), onset_index(ch) + 1, F.lit(1))


def nucleus(ch: Column) -> Column:
    return F.substr(F.lit(NUCLEI), nucleus_index(ch) + 1, F.lit(1))


def coda(ch: Column) -> Column:
    return F.substr(F.lit(CODAS), coda_index(ch) + 1, F.lit(1))


def char_of(code: Column) -> Column:
    """Code point to string, as three UTF-8 bytes (``char`` wraps at 256)."""
    c = code.cast("int")
    bits = F.concat(
        F.lpad(F.hex(F.shiftright(c, 12).bitwiseAND(15) + 224), 2, "0"),
        F.lpad(F.hex(F.shiftright(c, 6).bitwiseAND(63) + 128), 2, "0"),
        F.lpad(F.hex(c.bitwiseAND(63) + 128), 2, "0"),
    )
    return F.decode(F.unhex(bits), "UTF-8")


def position_index(alphabet: str, symbol: Column) -> Column:
    """0-based place of ``symbol`` in ``alphabet``; null when absent."""
    at = F.call_function("locate", symbol, F.lit(alphabet))
    return F.when((at > 0) & (F.char_length(symbol) == 1), at - 1)


def compose(onset_: Column, nucleus_: Column, coda_: Column) -> Column:
    """Syllable of three jamo; null where a jamo is not in its alphabet."""
    o = position_index(ONSETS, onset_)
    n = position_index(NUCLEI, nucleus_)
    c = position_index(CODAS, coda_)
    return char_of(F.lit(FIRST) + (o * 21 + n) * 28 + c)


def structure(ch: Column) -> Column:
    """V / VC / CV / CVC, the null onset counting as no consonant."""
    return F.concat(
        F.when(onset(ch) != NULL_ONSET, "C").otherwise(""), F.lit("V"),
        F.when(coda_index(ch) > 0, "C").otherwise(""),
    )


def chars(text: Column) -> Column:
    """Every character of ``text`` in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def syllables(text: Column) -> Column:
    """The Hangul syllables of ``text`` in order, other characters left out."""
    return F.regexp_extract_all(text, F.lit(SYLLABLE_CLASS), F.lit(0))


def hangul_only(text: Column) -> Column:
    return F.array_join(syllables(text), "")


def has_hangul(text: Column) -> Column:
    return text.rlike(SYLLABLE_CLASS)


def jamo(ch: Column) -> Column:
    """``array<struct<position, symbol, idx>>`` of one syllable, always three long."""
    def slot(pos: str, sym: Column, idx: Column) -> Column:
        return F.struct(F.lit(pos).alias("position"), sym.alias("symbol"), idx.alias("idx"))

    return F.array(
        slot("onset", onset(ch), onset_index(ch)),
        slot("nucleus", nucleus(ch), nucleus_index(ch)),
        slot("coda", coda(ch), coda_index(ch)),
    )


def _case(symbol: Column, groups: dict[str, str]) -> Column:
    out = F
    for name, members in groups.items():
        out = out.when(symbol.isin(*members), F.lit(name))
    return out


def phonation(symbol: Column) -> Column:
    return _case(symbol, PHONATION)


def place(symbol: Column) -> Column:
    return _case(symbol, PLACE)


def manner(symbol: Column) -> Column:
    return _case(symbol, MANNER)


def shape(symbol: Column) -> Column:
    return _case(symbol, SHAPE)


def surface_coda(symbol: Column) -> Column:
    """Neutralised coda; ``-`` and ``?`` unchanged, anything unknown null."""
    return _case(symbol, {**CODA_SURFACE, NO_CODA: NO_CODA, NO_RESPONSE: NO_RESPONSE})


def sound_class(position: Column, symbol: Column) -> Column:
    """The class that decides whether a substitution stays inside its class."""
    return (
        F.when(position == "onset", manner(symbol))
        .when(position == "nucleus", shape(symbol))
        .otherwise(surface_coda(symbol))
    )
