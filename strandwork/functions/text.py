"""Sequence and identifier text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

# The 26 residue letters accepted by the strict check.
STRICT_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# The characters that Python's str.split() treats as whitespace.
WHITESPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))


def squeeze_upper(seq: Column | str) -> Column:
    return F.upper(F.translate(as_col(seq), WHITESPACE, ""))


def mask_sequence(seq: Column | str) -> Column:
    """Upper-case, whitespace removed, every other foreign character as X."""
    return F.regexp_replace(squeeze_upper(seq), "[^A-Z]", "X")


def strict_sequence(seq: Column | str, letters: str = STRICT_LETTERS) -> Column:
    """struct(seq, issue, terminal_stop): one trailing ``*`` is tolerated."""
    raw = squeeze_upper(seq)
    stop = raw.endswith("*")
    body = F.when(stop, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    foreign = F.array_sort(F.array_distinct(F.split(F.regexp_replace(body, f"[{letters}]", ""), "")))
    foreign = F.filter(foreign, lambda c: c != "")
    issue = (
        F.when(body == "", F.lit("empty_sequence"))
        .when(F.size(foreign) > 0, F.concat(F.lit("invalid_characters:"), F.array_join(foreign, "")))
    )
    return F.struct(body.alias("seq"), issue.alias("issue"), stop.alias("terminal_stop"))


def safe_identifier(header: Column | str, index: Column | str) -> Column:
    """First header token; what is no letter, digit or ``._-`` becomes ``_``."""
    token = F.regexp_extract(as_col(header), r"^\s*(\S+)", 1)
    fallback = F.format_string("seq_%06d", as_col(index))
    return F.when(token == "", fallback).otherwise(F.regexp_replace(token, r"[^\p{L}\p{N}._-]", "_"))


def safe_name(text: Column | str) -> Column:
    """File-name rule: runs of foreign characters collapse, edges trimmed of ``_``."""
    return F.trim(F.regexp_replace(as_col(text), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def wrap_lines(seq: Column | str, width: int = 80) -> Column:
    """Insert a line break after every ``width`` characters but not at the end."""
    return F.regexp_replace(as_col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def fixed_digits(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` decimals as C's printf and Python write it: the binary
    value itself is rounded, its exact halves to the even digit.

    ``format_string`` rounds the shortest decimal form half up instead: 2.25 would
    give 2.3, and 1.15, which lies below its decimal form, 1.2. The product with
    the power of ten is kept exactly as the sum of two doubles.
    """
    scale = F.lit(float(10**digits))
    big = x * 134217729.0  # 2**27 + 1: the upper half of the digits
    high = big - (big - x)
    low = F.floor(x * scale).cast("double")
    over = (high * scale - (low + 0.5)) + (x - high) * scale
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    even = (low + F.when(up, 1.0).otherwise(0.0)) / scale
    plain = F.abs(x) < float(2**53) / 10**digits  # larger ones have no decimals
    return F.format_string(f"%.{digits}f", F.when(plain, even).otherwise(x))


def compact_number(n: Column | str) -> Column:
    """1234567 -> 1.23M, 1234 -> 1.2K, smaller as they are."""
    x = as_col(n).cast("double")
    return (
        F.when(x >= 1e6, F.concat(fixed_digits(x / 1e6, 2), F.lit("M")))
        .when(x >= 1e3, F.concat(fixed_digits(x / 1e3, 1), F.lit("K")))
        .otherwise(F.format_string("%d", x.cast("long")))
    )


def compact_number_bands(n: Column | str) -> Column:
    """Four-band variant: one decimal M, whole k from 10 000, one decimal k, plain."""
    x = as_col(n).cast("double")
    return (
        F.when(x >= 1e6, F.concat(fixed_digits(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e4, F.concat(fixed_digits(x / 1e3, 0), F.lit("k")))
        .when(x >= 1e3, F.concat(fixed_digits(x / 1e3, 1), F.lit("k")))
        .otherwise(fixed_digits(x, 0))
    )


def number_text(x: Column | str) -> Column:
    """A double in its shortest decimal form as Python and SQL engines write it:
    ``-0.0`` keeps its sign, an exponent is written below 1e-4 and from 1e16 on."""
    x = as_col(x).cast("double")
    size = F.abs(x)
    plain = F.regexp_replace(F.format_string("%.20f", x), r"(\.\d+?)0+$", "$1")
    text = F.regexp_replace(x.cast("string"), r"(\.0)?E(-?)(\d)$", "E$20$3")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E-", "e-"), r"(\.0)?E", "e+")
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < 1e-3) | (size >= 1e7) & (size < 1e16), plain)
        .otherwise(text)
    )


def structured_id(ident: Column | str) -> Column:
    """``PDBID_n_Chain`` -> struct(pdb_id, entity); null parts where it does not match."""
    pat = r"^([0-9A-Za-z]{4})_(\d+)_Chains?$"
    hit = as_col(ident).rlike(pat)
    return F.struct(
        F.when(hit, F.regexp_extract(as_col(ident), pat, 1)).alias("pdb_id"),
        F.when(hit, F.regexp_extract(as_col(ident), pat, 2).cast("int")).alias("entity"),
    )
