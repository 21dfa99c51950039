"""Measurements of a text as Spark columns, with Unicode classes spelled out.

Java's \\w, \\s, \\d and $ are not those that instructions are written for; these are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the same characters in Java and RE2.
S = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_S = "[^" + S[1:]
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"
#: The same as NOT_S and W, with what most signs are looked up first.
DENSE, LETTERS = f"[!-~{NOT_S}]", "[a-z" + W[1:]


#: The same white space, one by one: trimming by a list looks at the ends of a text alone.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: Marks that are words of their own.
MARKS = "?!;@#$%&()[]{}<>\"\u201c\u201d\u00ab\u00bb`"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def blank(x: Column) -> Column:
    """True for null as well. Read from the start to the first sign that isn't white space."""
    return F.coalesce(F.ltrim(x, F.lit(SPACES)) == "", F.lit(True))


def bind(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x made once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def count_with(x: Column, sign: str, pattern: str) -> Column:
    """count, for a pattern that can't match without a sign."""
    return F.when(F.contains(x, F.lit(sign)), count(x, pattern)).when(x.isNotNull(), F.lit(0).cast("long"))


def count(x: Column, pattern: Column | str) -> Column:
    return F.regexp_count(x, F.lit(pattern) if isinstance(pattern, str) else pattern).cast("long")


def words(x: Column) -> Column:
    return count(x, LETTERS + "+")


def tokens(x: Column) -> Column:
    return count(x, DENSE + "+")


def reach(x: Column, unit: str, gap: str, n: Column) -> Column:
    """Whether a text has n units, which gaps stand between; read no further than to the nth. n is a whole number."""
    return F.regexp(x, F.concat(F.lit(rf"\A{gap}(?:{unit}++{gap}){{"), n.cast("string"), F.lit("}+")))


def words_reach(x: Column, n: Column) -> Column:
    return reach(x, LETTERS, rf"(?:\x20(?=[a-z])|[^{LETTERS[1:]}*+)", n)


def tokens_reach(x: Column, n: Column) -> Column:
    return reach(x, DENSE, rf"(?:\x20(?=[!-~])|{S}*+)", n)


def syllables(x: Column) -> Column:
    return count(x, "[가-힣]")


def letters(x: Column, letter: Column) -> Column:
    gone, no = lambda y, *signs: F.octet_length(y) - F.octet_length(reduce(lambda z, a: F.replace(z, a, no), signs, y)), F.lit("")
    # Of the small letters of one byte only i and k have other capitals than their own.
    any_case = bind(F.lower(x), lambda low: (F.length(low) - F.length(F.replace(low, F.lower(letter), no))).cast("long"))
    return F.when(letter.rlike("^[A-HJL-Za-hjl-z]$"), gone(x, F.lower(letter), F.upper(letter)).cast("long")).otherwise(any_case)


def bullets(x: Column) -> Column:
    return count_with(x, "*", rf"(?md)^{S}*\*[^*].*$") + count_with(x, "-", rf"(?md)^{S}*-.*$")


def digit_items(x: Column) -> Column:
    return count_with(x, ")", rf"(?md)^{S}*{D}+\).*$") + count_with(x, ".", rf"(?md)^{S}*{D}+\..*$")


def placeholders(x: Column) -> Column:
    return count_with(x, "[", r"(?d)\[.*?\]")


def highlights(x: Column) -> Column:
    one = F.filter(F.regexp_extract_all(x, F.lit(r"\*[^\n\*]*\*"), 0), lambda h: ~blank(F.regexp_replace(h, r"\A\*+|\*+\z", "")))
    two = F.filter(F.regexp_extract_all(x, F.lit(r"\*\*[^\n\*]*\*\*"), 0), lambda h: ~blank(F.regexp_replace(h, r"\A\*\*|\*\*\z", "")))
    return F.when(F.contains(x, F.lit("*")), (F.size(one) + F.size(two)).cast("long")).when(x.isNotNull(), F.lit(0).cast("long"))


def sections(x: Column, splitter: Column) -> Column:
    return count(x, F.concat(F.lit(f"{S}?"), splitter, F.lit(f"{S}?{D}+{S}?")))


def has_upper_only(x: Column) -> Column:
    return x.rlike(r"\p{IsUppercase}") & ~x.rlike(r"[\p{IsLowercase}\p{Lt}]")


def has_lower_only(x: Column) -> Column:
    return x.rlike(r"\p{IsLowercase}") & ~x.rlike(r"[\p{IsUppercase}\p{Lt}]")


def cut_words(x: Column) -> Column:
    """A text with its words set apart by blanks as a tree-bank tokenizer does: at white space, at marks that stand for
    themselves, and before the ends of English contractions.

    Periods, hyphens, slashes and colons or commas between digits stay inside words."""
    marks = F.translate(x, SPACES + MARKS, " " * len(SPACES + MARKS))
    marks = F.regexp_replace(marks, r"--|\.{2,}|[:,](?![0-9\p{Nd}])", " ")
    ends = F.regexp_replace(marks, r"(?i)(?<=[^'])(n't|'(?:ll|re|ve|s|m|d))(?= |\z)", " $1")
    return F.when(F.contains(x, F.lit("'")), ends).otherwise(marks)


def capital_words(x: Column) -> Column:
    """Words with a capital and no small letter. What stands between white space without a capital is left out first."""
    small = f"[a-z!-@{NOT_S[:-1]}\\p{{IsUppercase}}]]"
    held = F.regexp_replace(x, rf"(?:{small}++\x20)++|({small}*+\p{{IsUppercase}}{DENSE}*+)|{small}++", "$1")
    return F.size(F.filter(F.split(bind(held, cut_words), " +", -1), lambda w: (w != "") & has_upper_only(w))).cast("long")


def star_paragraphs(x: Column) -> Column:
    """Number of paragraphs between ***; null if one in the middle is blank."""

    def counted(p: Column) -> Column:
        middle = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
        ends = F.when(blank(F.get(p, F.lit(0))), 1).otherwise(0) + F.when((F.size(p) > 1) & blank(F.element_at(p, -1)), 1).otherwise(0)
        return F.when(F.forall(middle, lambda y: ~blank(y)), (F.size(p) - ends).cast("long"))

    # Cut once; white space around *** only goes to the pieces, whose number and blankness it doesn't change.
    return F.when(F.contains(x, F.lit("***")), bind(F.split(x, r"\*\*\*", -1), counted)).when(x.isNotNull(), F.when(blank(x), 0).otherwise(1).cast("long"))


def two_responses(x: Column) -> Column:
    def differ(p: Column) -> Column:
        middle = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
        full = F.filter(p, lambda y: ~blank(y))
        return F.forall(middle, lambda y: ~blank(y)) & (F.size(full) == 2) & (strip(F.get(full, F.lit(0))) != strip(F.get(full, F.lit(1))))

    return F.contains(x, F.lit("******")) & bind(F.split(x, r"\*\*\*\*\*\*", -1), differ)


def double_line_paragraphs(x: Column) -> tuple[Column, Column]:
    """The pieces between empty lines, and how many aren't blank."""
    p = F.split(x, "\n\n", -1)
    return p, F.when(F.contains(x, F.lit("\n\n")), F.size(F.filter(p, lambda y: ~blank(y)))).when(x.isNotNull(), F.when(blank(x), 0).otherwise(1))


def unfenced(x: Column) -> Column:
    def bare(s: Column) -> Column:
        out = s
        for fence in ("```json", "```Json", "```JSON", "```"):
            out = F.regexp_replace(out, rf"\A{fence}", "")
        return F.when(F.startswith(s, F.lit("```")) | F.endswith(s, F.lit("```")), strip(F.regexp_replace(out, r"```\z", ""))).otherwise(s)

    return bind(strip_long(x), bare)


def is_json(x: Column) -> Column:
    """JSON, scalars, duplicate keys and the names NaN, Infinity and -Infinity included.

    String literals are put aside; outside them the three names are read as 0. The parser stops behind the first value, so
    the text has to stand in an array before a mark that it can't hold: its own hash. Needs
    spark.sql.variant.allowDuplicateKeys=true for duplicate keys."""
    plain = F.regexp_replace(x, r'("(?:[^"\\]|\\.)*")|-?Infinity|NaN', "$1~")
    numbers = F.regexp_replace(F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")~', "$1"), r'(?<![\w"~])~(?![\w"])', "0")
    mark = F.sha2(x, 256)

    def whole(y: Column) -> Column:
        held = F.try_parse_json(F.concat(F.lit("["), y, F.lit(',"'), mark, F.lit('"]')))
        return F.try_parse_json(y).isNotNull() & F.coalesce(F.try_variant_get(held, "$[1]", "string") == mark, F.lit(False))

    named = F.contains(x, F.lit("NaN")) | F.contains(x, F.lit("Infinity"))
    # No value begins with a letter but true, false, null and the names.
    return ~F.substring(x, 1, 1).rlike(r"[\p{L}&&[^tfnNI]]") & F.when(named, whole(numbers)).otherwise(whole(x))


def title(x: Column) -> Column:
    return F.contains(x, F.lit("<<")) & F.exists(F.regexp_extract_all(x, F.lit(r"<<[^\n]+>>"), 0), lambda t: ~blank(F.regexp_replace(t, r"\A<+|>+\z", "")))


def strip_long(x: Column) -> Column:
    """strip, which reads no further from the end than to the last blank before a word."""
    tail = F.substring_index(x, " ", -1)
    bare = F.rtrim(tail, F.lit(SPACES))
    cut = F.substring(x.cast("binary"), F.lit(1), F.octet_length(x) - F.octet_length(tail) + F.octet_length(bare)).cast("string")
    return F.ltrim(F.when(bare == "", F.rtrim(x, F.lit(SPACES))).when(bare == tail, x).otherwise(cut), F.lit(SPACES))


def loose_variants(x: Column) -> Column:
    """The eight texts that the lenient mode tries, without repeats; null for a null text.

    Lines are cut off by bytes, and stars removed only where there are some."""
    raw, size = x.cast("binary"), F.octet_length(x)
    first, end = F.octet_length(F.substring_index(x, "\n", 1)) + 1, size - F.octet_length(F.substring_index(x, "\n", -1)) - 1
    piece = lambda start, n: strip_long(F.substring(raw, start, n).cast("string"))
    cuts = [piece(first + 1, size), piece(F.lit(1), end), piece(first + 1, end - first)]
    whole = F.when(F.contains(x, F.lit("\n")), F.array(x, *cuts)).otherwise(F.array(x, F.lit("")))
    bare = lambda a: F.transform(a, lambda c: F.replace(c, F.lit("*"), F.lit("")))
    made = F.get(F.transform(F.array(whole), lambda a: F.when(F.contains(x, F.lit("*")), F.concat(a, bare(a))).otherwise(a)), F.lit(0))
    return F.when(x.isNotNull(), F.array_distinct(made))
