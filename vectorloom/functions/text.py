"""Column functions that normalise texts, options, paths and names of training rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PLACEHOLDER = "<|image_1|>"
DEFAULT_INSTRUCTION = "Represent the user's input."
EMPTY_ITEM = "NULL"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def _without(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def clean_placeholder(text: Column) -> Column:
    """Removes the placeholder and strips, only where there is one."""
    return F.when(F.contains(text, F.lit(PLACEHOLDER)), strip(_without(text, PLACEHOLDER))).otherwise(text)


def clean_always(text: Column) -> Column:
    """Null is empty; removes the placeholder and always strips."""
    return strip(_without(F.coalesce(text, F.lit("")), PLACEHOLDER))


def clean_with_newline(text: Column) -> Column:
    """Null is empty; removes the placeholder, with a newline after it if there is one, and strips."""
    return strip(_without(_without(F.coalesce(text, F.lit("")), PLACEHOLDER + "\n"), PLACEHOLDER))


def punctuate(instruction: Column, default: str = DEFAULT_INSTRUCTION) -> Column:
    """Stripped, with a full stop unless punctuation ends it; blank or null gives the default."""
    bare = strip(F.coalesce(instruction, F.lit("")))
    return F.when(bare == "", F.lit(default)).when(bare.rlike(r"\p{P}$"), bare).otherwise(F.concat(bare, F.lit(".")))


def colon_to_stop(instruction: Column) -> Column:
    return F.regexp_replace(instruction, ":$", ".")


def image_path(root: str, path: Column) -> Column:
    """A relative path under ``root``, without one leading ``images/``; blank gives null."""
    return F.when(strip(path) != "", F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, "^images/", "")))


def natural_key(name: Column, digits: int = 20) -> Column:
    """Sorts as the name does with its runs of digits compared as numbers of at most ``digits`` digits."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), digits, "0")).otherwise(x)), "")


def short_name(name: Column) -> Column:
    """50 characters of the stem, ``_``, 8 of the md5 of the whole name, and the extension."""
    extension = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    return F.concat(F.substring(stem, 1, 50), F.lit("_"), F.substring(F.md5(name), 1, 8), extension)


def safe_id(name: Column) -> Column:
    """Slashes become underscores, and what follows the last dot goes."""
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("_")), r"\.[^.]*$", "")


def lettered(options: Column) -> Column:
    """``(A) first``, ``(B) second``, ...; after Z the characters that follow it in Unicode."""
    letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 65), 8, "0")), "UTF-32")  # noqa: E731 (char() starts again after 255)
    return F.transform(options, lambda x, i: F.concat(F.lit("("), letter(i), F.lit(") "), x))


def last_match(options: Column, answer: Column) -> Column:
    """Place from 0 of the last option that equals the answer; -1 if none does."""
    at = F.array_position(F.reverse(options), answer)
    return F.when(at > 0, F.size(options) - at).otherwise(F.lit(-1)).cast("int")


def qa_prompt(question: Column, options: Column) -> Column:
    """The question and its lettered options, a line each."""
    return F.concat(question, F.lit("\n"), F.array_join(lettered(options), "\n"))


def option_clean(option: Column) -> Column:
    """What follows the first ``. ``, or all of it, without dots and spaces at both ends."""
    at = F.instr(option, ". ")
    return F.btrim(F.when(at > 0, F.substring(option, at + 2, F.length(option))).otherwise(option), F.lit(". "))


def letter_index(answer: Column) -> Column:
    """A is 0; another than a single letter A to Z gives -1."""
    return F.when(answer.rlike("^[A-Z]$"), F.ascii(answer) - 65).otherwise(F.lit(-1))


def yes_no_index(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(low == "yes", 0).when(low == "no", 1).otherwise(F.lit(-1))


def filled(text: Column) -> Column:
    """Null instead of an empty text."""
    return F.when(text != "", text)


def item(text: Column, image: Column, empty: str = EMPTY_ITEM) -> Column:
    """A side of a row: its text and image path without empty fields; with neither, the text is ``empty``."""
    t, i = filled(text), filled(image)
    return F.struct(F.when(t.isNull() & i.isNull(), F.lit(empty)).otherwise(t).alias("text"), i.alias("image_path"))


def positive_key(text: Column, image: Column) -> Column:
    """What makes two corpus items the same: the image's path if there is one, else the stripped text."""
    return F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit("IMG::"), image)).otherwise(F.concat(F.lit("TXT::"), strip(F.coalesce(text, F.lit("")))))


def model_kind(config: Column, path: Column) -> Column:
    """The field of a model's config, else what its path names."""
    low = F.lower(path)
    return F.coalesce(filled(config), F.when(low.contains("vl"), "vision-language").otherwise("text"))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")
