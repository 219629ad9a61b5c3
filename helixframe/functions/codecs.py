"""Alphabets and symbol codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The symbols of each alphabet, in the order of their codes. Protein's order and
# the IUPAC order are those of the file formats that carry such codes.
ALPHABETS = {
    "DNA": "ACGT",
    "DNA_N": "ACGTN",
    "DNA_IUPAC": "=ACMGRSVTWYHKDBN",
    "PROTEIN": "ACDEFGHIKLMNOPQRSTVWYBZX",
    "RNA": "ACGU",
    "RNA_N": "ACGUN",
}
BITS = {"DNA": 2, "DNA_N": 4, "DNA_IUPAC": 4, "PROTEIN": 8, "RNA": 2, "RNA_N": 4}
DIGITS = "0123456789abcdefghijklmn"


def to_codes(seq: Column, alphabet: str = "DNA") -> Column:
    """The symbol codes as an array; symbols outside the alphabet take its last code + 1 (DNA, RNA) or its last code."""
    symbols = ALPHABETS[alphabet]
    other = len(symbols) if BITS[alphabet] == 2 else len(symbols) - 1
    return F.transform(F.split(seq, ""), lambda c: F.when(F.instr(F.lit(symbols), c) > 0, F.instr(F.lit(symbols), c) - 1).otherwise(other))


def to_digits(seq: Column, alphabet: str = "DNA") -> Column:
    """The codes as a string of base-n digits, one for each symbol."""
    symbols = ALPHABETS[alphabet]
    return F.translate(seq, symbols, DIGITS[: len(symbols)])


def from_digits(digits: Column, alphabet: str = "DNA") -> Column:
    symbols = ALPHABETS[alphabet]
    return F.translate(digits, DIGITS[: len(symbols)], symbols)


def complement(seq: Column) -> Column:
    """A-T and C-G swapped; other symbols stay."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


STRANDS = {
    "forward": lambda s: s,
    "reverse": F.reverse,
    "forward_complement": complement,
    "reverse_complement": reverse_complement,
}


def infix(seq: Column, begin: Column, end: Column) -> Column:
    """The half-open, 0-based stretch begin..end."""
    return F.substring(seq, begin + 1, F.greatest(end - begin, F.lit(0)))


def prefix(seq: Column, n: int) -> Column:
    return F.substring(seq, F.lit(1), F.lit(n))


def suffix(seq: Column, begin: Column | int) -> Column:
    begin = F.lit(begin) if isinstance(begin, int) else begin
    return F.substring(seq, begin + 1, F.greatest(F.length(seq) - begin, F.lit(0)))


def qgram_code(gram: Column) -> Column:
    """The code of a DNA q-gram (q <= 31): two bits a symbol, the first symbol lowest."""
    return F.conv(F.reverse(to_digits(gram)), 4, 10).cast("long")


def occurrences(seq: Column, symbol: str, most: int | None = None) -> Column:
    n = F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))
    return n if most is None else F.least(n, F.lit(most))


def dna_to_iupac16(codes: Column) -> Column:
    """A set bit for each DNA code (4, an N, sets all four)."""
    return F.transform(codes, lambda c: F.when(c > 3, F.lit(15)).otherwise(F.call_function("shiftleft", F.lit(1), c.cast("int"))))


def phred(quals: Column, offset: int = 33) -> Column:
    """ASCII qualities as numbers."""
    return F.transform(F.split(quals, ""), lambda c: F.ascii(c) - offset)


def checksum(seq: Column) -> Column:
    """CRC-32 of a sequence's symbols."""
    return F.crc32(seq.cast("binary"))
