"""Text expressions: lines, rounding, tokens, naming styles, comments, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    return F.split(content, "\n")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def round_tenth(x: Column) -> Column:
    """Half up to one decimal."""
    return F.floor(x * 10 + 0.5) / 10


def numbers_where(array: Column, test) -> Column:
    """1-based numbers of the elements that pass a test."""
    return F.filter(F.transform(array, lambda x, i: F.when(test(x), i + 1)), lambda n: n.isNotNull())


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """12 hex digits that survive moves within a file."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 12)


def words(content: Column) -> Column:
    """Lower-case words, camel case taken apart."""
    spaced = F.regexp_replace(content, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-zÁÉÍÓÚáéíóúÑñ]+"), F.lit(0)), F.lower)


def naming_style(stem: Column) -> Column:
    return (
        F.when(stem.contains("-"), "kebab")
        .when(stem.contains("_"), "snake")
        .when(stem.rlike(r"^[A-Z][a-zA-Z0-9]*\z") & stem.rlike("[a-z]"), "pascal")
        .when(stem.rlike("^[a-z][a-zA-Z0-9]*[A-Z]"), "camel")
        .when(stem.rlike(r"^[a-z][a-z0-9]*\z"), "lower")
        .otherwise("other")
    )


def indentation(content: Column) -> Column:
    tabs = F.exists(lines(content), lambda x: x.startswith("\t"))
    spaces = F.exists(lines(content), lambda x: x.startswith("  "))
    return F.when(tabs & spaces, "mixed").when(tabs, "tabs").when(spaces, "spaces").otherwise("none")


def without_comments(content: Column) -> Column:
    """Script comments go; strings of all three quotes stay, even unended ones."""
    strings = "|".join(rf"{q}(?:[^{q}\\]|\\(?s:.))*+(?:{q}|\z)" for q in ("'", '"', "`"))
    return F.regexp_replace(content, rf"({strings})|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", "$1")


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.transform(F.array_distinct(chars), share)), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def snippet(content: Column, line: Column, around: int = 3) -> Column:
    """(start_line, end_line, code) of the lines about a 1-based line."""
    all_ = lines(content)
    start, end = F.greatest(F.lit(1), line - around), F.least(F.size(all_), line + around)
    return F.struct(start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice(all_, start, F.greatest(end - start + 1, F.lit(0))), "\n").alias("code"))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def wrap_text(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken between words; a longer word is a line of its own, and breaks stay."""

    def add(line_of: Column, word: Column) -> Column:
        line, done = line_of["line"], line_of["done"]
        full = (F.length(line) > 0) & (F.length(line) + F.length(word) + 1 > width)
        longer = F.when(F.length(line) > 0, F.concat(line, F.lit(" "), word)).otherwise(word)
        return F.struct(F.when(full, F.concat(done, F.array(line))).otherwise(done).alias("done"), F.when(full, word).otherwise(longer).alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    paragraph = lambda p: F.aggregate(F.split(p, r"\s+", -1), start, add, lambda end: F.concat(end["done"], F.array(end["line"])))
    return F.flatten(F.transform(F.split(text, "\n", -1), paragraph))


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version; a leading v and what follows a dash go."""
    core = F.split(F.regexp_replace(version, r"^v|[-+].*$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.coalesce(F.try_element_at(core, i).try_cast("int"), F.lit(0)))


def is_newer(current: Column, latest: Column) -> Column:
    return version_parts(latest) > version_parts(current)
