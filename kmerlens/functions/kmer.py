"""k-mers as strings and as 2-bit codes (A 0, C 1, G 2, T 3, first base highest)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(x: Column, use) -> Column:
    """use(x) with x computed once: nested uses would double the generated code each time."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def encode(kmer: Column) -> Column:
    """Code of an ACGT string of up to 31 bases; null for other letters."""
    upper = F.upper(kmer)
    return F.when(upper.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(upper, "ACGT", "0123"), 4, 10).cast("long"))


def decode(code: Column, k: int = 16) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def reverse_complement_code(code: Column, k: int = 16) -> Column:
    """Complements every base and swaps ever larger groups of bits; all in the JVM."""
    x = code.bitwiseXOR(F.lit((1 << 2 * k) - 1))

    def swap(shift: int, mask: int):
        return lambda v: F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(mask)), shift))

    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = _let(x, swap(shift, mask))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmer_id(code: Column, k: int = 16) -> Column:
    return F.concat(F.lit(f"k{k}_"), F.lpad(F.lower(F.hex(code)), max(8, -(-k // 2)), "0"))


def is_palindrome(kmer: Column) -> Column:
    return kmer == reverse_complement(kmer)


def gc_percent(kmer: Column) -> Column:
    return 100.0 * F.length(F.translate(kmer, "AT", "")) / F.length(kmer)


def max_run(kmer: Column) -> Column:
    """Length of the longest run of one base."""
    return F.array_max(F.transform(F.regexp_extract_all(kmer, F.lit("(A+|C+|G+|T+)"), F.lit(1)), F.length))


def base_entropy(kmer: Column) -> Column:
    """Shannon entropy of the base composition, in bits."""
    n = F.length(kmer)
    total = F.lit(0.0)
    for base in "ACGT":
        p = (n - F.length(F.replace(kmer, F.lit(base), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def _stands(part: Column, text: Column, at: int) -> Column:
    """Whether part stands in text at the place ``at`` (from 1) or behind it."""
    return F.call_function("locate", part, text, F.lit(at)) > 0


def stem(kmer: Column, k: int = 16, loop: int = 4) -> Column:
    """Longest self-complementary stem: arms start at i and end at j >= i + loop and grow inwards
    while they stay apart and pair. A stem of n pairs is n bases whose reverse complement stands behind
    them, and holds shorter ones, so the greatest n that is found counts."""
    rc = reverse_complement(kmer)

    def holds(n: int) -> Column:
        gap = max(n, loop - n + 1)  # from the start of the first arm to that of the second
        found = [_stands(F.substring(rc, k - i - n + 1, n), kmer, i + gap + 1) for i in range(k - n - gap + 1)]
        return reduce(lambda x, y: x | y, found)

    out = F.lit(0)
    for n in range(1, k // 2 + 1):
        out = F.when(holds(n), n).otherwise(out)
    return out


def quality(kmer: Column) -> Column:
    """.35 gc + .20 run + .25 entropy + .20 stem, each by its ramp."""
    gc = F.greatest(F.lit(0.0), 1 - F.abs(gc_percent(kmer) / 100 - 0.5) / 0.25)
    run = F.greatest(F.lit(0.0), 1 - (max_run(kmer) - 3) / 4)
    entropy = F.least(F.lit(1.0), base_entropy(kmer) / 1.8)
    arms = F.greatest(F.lit(0.0), 1 - (stem(kmer) - 2) / 4)
    return 0.35 * gc + 0.20 * run + 0.25 * entropy + 0.20 * arms


def hamming_code(a: Column, b: Column) -> Column:
    """Number of bases in which two codes of one length differ (up to 31 bases)."""
    return _let(a.bitwiseXOR(b), lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))))


def hamming_either(a: Column, b: Column, k: int = 16) -> Column:
    """The lesser distance of b and of its reverse complement."""
    return F.least(hamming_code(a, b), hamming_code(a, reverse_complement_code(b, k)))


def mismatch_positions(a: Column, b: Column, k: int = 16) -> Column:
    """1-based places in which two strings of length k differ."""
    return F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))


def shares_substring(a: Column, b: Column, k: int = 16, n: int = 12) -> Column:
    """Whether any n bases of a occur in b or in its reverse complement."""
    rc = reverse_complement(b)
    return F.exists(F.sequence(F.lit(1), F.lit(k - n + 1)), lambda i: b.contains(F.substring(a, i, F.lit(n))) | rc.contains(F.substring(a, i, F.lit(n))))
