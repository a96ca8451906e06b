"""Source code: comments and docstrings out, runs of blank lines to one.

What a line-by-line state machine would drop is a regular language, so each stripper is a
few replacements over the whole text: linear time, no row leaves its partition. A text is
given a last line end first, so that every line ends alike, and loses it again after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = r"[ \t\r\f\x0B]"
#: A full-line comment; a docstring to the end of the line that closes it, or of the text.
_PYTHON = rf"(?dm)^{_GAP}*+(?:#[^\n]*+\n|(\"\"\"|''')(?s:.*?)\1[^\n]*+\n|(?:\"\"\"|''')(?s:.*))"
#: A full-line comment; a block closed on its line; a block to the end of the line that closes it.
_C_LIKE = (
    rf"(?dm)^{_GAP}*+(?://|\* )[^\n]*+\n"
    r"|^([^\n]*?)/\*[^\n]*?\*/([^\n]*+)\n"
    r"|^([^\n]*?)/\*[^\n]*+\n(?s:.*?\*/[^\n]*+\n|.*)"
)
#: Marks the end of a line that lost a block; a code point that no text may hold.
_MARK = "﷐"


def _one_blank(text: Column) -> Column:
    """Runs of blank lines to the first of them, and the added line end off."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?dm)^({_GAP}*+\n)(?:{_GAP}*+\n)++", "$1"), r"\n\z", "")


def strip_python(text: Column) -> Column:
    """Without full-line comments and docstrings."""
    return _one_blank(F.regexp_replace(F.concat(text, F.lit("\n")), _PYTHON, ""))


def strip_c_like(text: Column) -> Column:
    """Without full-line comments and block comments; what stands around a block stays."""
    marked = F.regexp_replace(F.concat(text, F.lit("\n")), _C_LIKE, f"$1$2$3{_MARK}\n")
    emptied = F.regexp_replace(marked, rf"(?dm)^{_GAP}*+{_MARK}\n", "")
    return _one_blank(F.regexp_replace(emptied, rf"{_GAP}*+{_MARK}\n", "\n"))


def reduce_code(df: DataFrame, language: str) -> DataFrame:
    """``df`` with ``compressed`` and ``mode``; ``language`` is python or generic."""
    make = strip_python if language == "python" else strip_c_like
    return df.withColumns({"compressed": make(F.col("text")), "mode": F.lit(f"strip_{language}")})
