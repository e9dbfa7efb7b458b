"""Text normalisation, masking and tokenisation as Column functions: no UDF, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x09-\x0D\x20]"

#: Token classes of the lexer, in the order in which they are tried.
LEXER = {
    "WORD": r"\p{L}+",
    "LONG": r"(?:\d+[-/.\\]\d+[-/.\\]?)+",
    "NUM": r"\d+",
    "OPEN": r"[(\[{\"<`]",
    "CLOSE": r"[)\]}>]",
    "STOP": r"[?.:!]",
    "SEP": r"_|-|&&|~|¨|'",
    "SYM": r"[%$#€Â*£=@^]",
}


def turkish_lower(c: Column) -> Column:
    """Dotted and dotless i are kept apart."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def lower(c: Column, locale: str = "") -> Column:
    return turkish_lower(c) if locale == "tr" else F.lower(c)


def raw_tokens(c: Column, locale: str = "") -> Column:
    """What stands between blanks and ASCII punctuation, lowered."""
    return F.split(lower(c, locale), r"[\x09-\x0D\x20\p{Punct}]+")


def letters_only(rows: DataFrame, max_length: int = 25) -> DataFrame:
    """Rows whose tok passes for a training token: the filter of letter_tokens on exploded rows, inside code generation."""
    return rows.filter((F.length("tok") < max_length) & F.col("tok").rlike(r"^\p{L}+$"))


def letter_tokens(c: Column, max_length: int = 25, locale: str = "") -> Column:
    """Training tokens: split at blanks and ASCII punctuation, lowered, letters only, shorter than max_length."""
    return F.filter(raw_tokens(c, locale), lambda x: x.rlike(r"^\p{L}+$") & (F.length(x) < max_length))


def blank_tokens(c: Column) -> Column:
    return F.filter(F.split(c, BLANK + "+"), lambda x: x != "")


def mask_symbols(c: Column) -> Column:
    """Long numbers, brackets, numbers and separators become NUM, OPEN, CLOSE and -."""
    for pattern, name in (
        (r"(?:\d+[-/.\\]\d+[-/.\\]?)+", "NUM"), (r"(?:\d+[-/.\\]" + BLANK + r"\d+" + BLANK + r"[-/.\\]?)+", "NUM"),
        (r"[(\[{\"<`]", "OPEN"), (r"[)\]}>]", "CLOSE"), (r"\d+", "NUM"), (r"_|-|&&|~|¨|'|\|\|,;", "-"),
    ):
        c = F.regexp_replace(c, pattern, f" {name} ")
    return c


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BLANK + "+", " "), "^ | $", "")


def lex(c: Column) -> Column:
    """Lexemes of a masked text in order; what belongs to no class vanishes."""
    return F.regexp_extract_all(mask_symbols(c), F.lit("(" + "|".join(LEXER.values()) + ")"), F.lit(0))


def fix_punctuation(c: Column) -> Column:
    """A blank after stops, no trailing page number, plain quotes, references before stops; then number templates."""
    stop = "([:.!?]+)"
    for pattern, to in (
        (stop + r"([\"'\p{L}])", "$1 $2"), (stop + BLANK + r"+\d+$", "$1"), ("”", '"'), (stop + BLANK + r"+(\[\d+\])", "$2 $1"),
        (r"\d+\.\d+(?:,\d+)?", "000.00"), (r"\d+", "000"), (r"\d+\.\d+", "00.00"), (r"\d+:\d+", "00:00"), (r"\d+\.\d+\.\d+", "00.00.00"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def close_quote(c: Column) -> Column:
    """An odd number of quotes gets one more at the end."""
    odd = (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(odd, F.concat(c, F.lit('"'))).otherwise(c)


def fix_sentence(c: Column) -> Column:
    fixed = F.regexp_replace(close_quote(fix_punctuation(c)), '"' + BLANK + '+"', '"')
    return F.regexp_replace(F.reverse(close_quote(F.reverse(fixed))), BLANK + "+", " ")


def digits_to_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "0")


def clean_entry(c: Column) -> Column:
    """A lexicon entry without marks, its archiphonemes read as the default letters."""
    for pattern, to in (("[&$~_]", ""), ("([aıou][^aeıioöuü]*)E$", "$1a"), ("([eiöü][^aeıioöuü]*)E$", "$1e"), ("K$", "k"), ("T$", "t")):
        c = F.regexp_replace(c, pattern, to)
    return c


def surface_forms(c: Column) -> Column:
    """What an entry with archiphonemes may look like; forms that still end in one are dropped."""
    bare = F.regexp_replace(c, "[&$~_]", "")
    forms = [F.regexp_replace(bare, p, t) for p, t in (
        ("([aı][^aeıioöuü]*)E$", "$1ı"), ("([aıou][^aeıioöuü]*)E$", "$1a"), ("([ei][^aeıioöuü]*)E$", "$1i"), ("([eiöü][^aeıioöuü]*)E$", "$1e"),
        ("([öü][^aeıioöuü]*)E$", "$1ü"), ("([ou][^aeıioöuü]*)E$", "$1u"), ("K$", "ğ"), ("K$", "k"), ("T$", "d"), ("T$", "t"),
    )]
    return F.filter(F.array_distinct(F.array(*forms)), lambda x: ~x.rlike("[ETK]$"))


def harden(c: Column) -> Column:
    """A softened final consonant back to k."""
    return F.regexp_replace(c, "([^aeıioöuü][aeıioöuü])ğ$", "$1k")


def remove_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"[#$]" + BLANK + "?", "")


def characters(c: Column) -> Column:
    """Characters and a terminator."""
    return F.concat(F.filter(F.split(c, ""), lambda x: x != ""), F.array(F.lit("#")))


def stem_partitions(c: Column, stem: int = 5) -> Column:
    """Stem and suffix at every place from stem letters on, and the whole token last."""
    first = F.least(F.lit(stem), F.length(c))
    cuts = F.transform(F.sequence(first, F.length(c)), lambda i: F.when(i < F.length(c), F.concat(F.substring(c, F.lit(1), i), F.lit("#"), F.substring(c, i + 1, F.length(c)))).otherwise(c))
    return F.array_distinct(cuts)


def stem_cuts(c: Column) -> Column:
    """stem#rest with 9, 5, 4, 3, 2, 1 and no letters cut off, stems of three letters at least."""
    def cut(n: Column) -> Column:
        at = F.greatest(F.lit(3), F.length(c) - n)
        return F.concat(F.substring(c, F.lit(1), at), F.lit("#"), F.substring(c, at + 1, F.length(c)))

    return F.array_distinct(F.transform(F.array(*map(F.lit, (9, 5, 4, 3, 2, 1, 0))), cut))


def char_grams(c: Column, n: int = 5) -> Column:
    last = F.greatest(F.length(c) - n, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i + 1, F.lit(n)))


def suffix_grams(c: Column) -> Column:
    """For every stem: the stem, then the 3- to 6-grams of what is left (a shorter rest is one gram)."""
    def grams(i: Column, n: int) -> Column:
        left = F.length(c) - i
        return F.transform(F.sequence(F.lit(0), F.greatest(left - n, F.lit(0))), lambda j: F.substring(c, i + j + 1, F.lit(n)))

    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.concat(F.array(F.substring(c, F.lit(1), i)), *(grams(i, n) for n in (3, 4, 5, 6))))
    return F.filter(F.flatten(each), lambda x: x != "")


def left_pad(tokens: Column, n: int, zero: str = "zero") -> Column:
    return F.concat(F.array_repeat(F.lit(zero), F.greatest(F.lit(n) - F.size(tokens), F.lit(0))), F.slice(tokens, 1, n))


def sliding(tokens: Column, n: int, step: int = 1) -> Column:
    """Windows of n, one shorter one if there are fewer; with a step, a shorter last one is kept."""
    last = F.greatest(F.size(tokens) - n, F.lit(0))
    if step > 1:
        last = F.ceil(last / step).cast("int") * step
    starts = F.sequence(F.lit(0), last, F.lit(step)) if step > 1 else F.sequence(F.lit(0), last)
    return F.filter(F.transform(starts, lambda i: F.slice(tokens, i + 1, n)), lambda w: F.size(w) > 0)


def cartesian(alternatives: Column) -> Column:
    """All choices of one item a position, distinct items, the first position varying fastest."""
    start = F.expr("array(cast(array() as array<string>))")
    return F.aggregate(alternatives, start, lambda acc, o: F.flatten(F.transform(F.array_distinct(o), lambda x: F.transform(acc, lambda p: F.concat(p, F.array(x))))))


def distance_bucket(d: Column, near: int = 2, far: int = 5) -> Column:
    return F.when(d >= far, "dist").when(d > near, "neig").otherwise("loc")
