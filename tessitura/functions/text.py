"""Column functions over prompts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes, as a Java and RE2 character class.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def templated(prompt: Column, prefix: str) -> Column:
    """The prompt as a model gets it: after a system prefix, with one space at the end. Null stays null."""
    return F.concat(F.lit(prefix), prompt, F.lit(" "))


def swapped_suffix(path: Column, suffix: str) -> Column:
    """The path with its last .mid replaced; a .mid elsewhere in it stays."""
    return F.regexp_replace(path, r"\.mid\z", suffix)


def file_kind(path: Column) -> Column:
    return F.when(path.endswith(".mid"), "MIDI").otherwise("Audio")


def output_path(root: Column, output_idx: Column, kind: str = "mid") -> Column:
    return F.format_string(f"%s/gen_%d.{kind}", root, output_idx)


def prompt_directory(stamp: str | Column, prompt_idx: Column) -> Column:
    return F.format_string("%s_prompt_%d", F.lit(stamp) if isinstance(stamp, str) else stamp, prompt_idx)


def session_stamp(at: Column) -> Column:
    """The name of a session's folder, from its beginning."""
    return F.date_format(at, "yyyy-MM-dd_HHmmss")


def prompt_stamp(at: Column) -> Column:
    """The beginning of a prompt's directory."""
    return F.date_format(at, "yyyyMMdd_HHmmss")
