"""Native column expressions for segmentation, features and small text rules.

Word characters and white space are those of Python's patterns, named by their
Unicode categories: Java's own classes also take marks and joiners for word
characters, and don't take U+001C to U+001F for white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The insides of classes: word characters (letters, all kinds of numbers, the underscore) and white space.
#: The letter beyond U+FFFF makes Java look behind by code points instead of surrogates.
WORD, SPACE = "\\p{L}\\p{N}_\U00010000", r"\s\x1C-\x1F"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
PLACEHOLDER = "__LT_[A-Z0-9_]+__"
PLACEHOLDER_MARK = "__LT_"
#: Signs of technical text. Fixed values.
TECHNICAL = ("http", "`", "${", "{{", "--")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound, so that it is evaluated once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def strip(c: Column) -> Column:
    """Without white space at the ends; `trim` alone strips blanks only."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~F.rlike(c, F.lit(rf"(?U)[^{SPACE}]"))


def _pieces(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"(?U)(?<=[.!?])[{SPACE}]+"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """The sentences of a unit; a blank unit, which has no pieces, is one sentence as it is."""
    return let(_pieces(c), lambda pieces: F.when(F.size(pieces) == 0, F.array(c)).otherwise(pieces))


def normalize_spacing(c: Column) -> Column:
    """Runs of blanks and tabs between other characters of a line become one blank."""
    return F.regexp_replace(c, rf"(?U)(?<=[^{SPACE}])[ \t]{{2,}}(?=[^{SPACE}])", " ")


def placeholder_count(c: Column) -> Column:
    """Placeholders for routing: neighbours without a gap count as one."""
    return F.regexp_count(c, F.lit(PLACEHOLDER))


def mark_count(c: Column) -> Column:
    """Placeholder marks for traces and chunks: every start counts."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(PLACEHOLDER_MARK), F.lit("")))) / len(PLACEHOLDER_MARK)).cast("int")


def technical_count(c: Column) -> Column:
    """How many of the technical signs occur."""
    total = F.lit(0)
    for sign in TECHNICAL:
        total = total + F.contains(c, F.lit(sign)).cast("int")
    return total


def has_technical(c: Column) -> Column:
    return technical_count(c) > 0


def sentence_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.size(_pieces(c)))


def placeholder_ratio(c: Column) -> Column:
    return placeholder_count(c) / F.greatest(F.lit(1), F.length(c))


def target_hits(c: Column, targets: list[str]) -> Column:
    """How many glossary entries have their target in the text."""
    total = F.lit(0)
    for t in targets:
        if t:
            total = total + F.contains(c, F.lit(t)).cast("int")
    return total


def token_budget(c: Column, mode: Column, max_tokens: int = 256) -> Column:
    """Output tokens that a post-edit may take. Fixed values: .55, .85, 16, 24."""
    ratio = F.when(mode == "safe", 0.55).otherwise(0.85)
    return F.greatest(F.lit(24), F.least(F.lit(max_tokens), F.floor(F.length(c) * ratio).cast("int") + 16))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_lower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def cased_like(match: Column, target: str) -> Column:
    """The target in capitals, with a capital, or as it is, after the match."""
    first, rest = F.substring(match, 1, 1), F.substring(match, 2, 1 << 30)
    return (
        F.when(is_upper(match), F.lit(target.upper()))
        .when(is_upper(first) & is_lower(rest), F.lit(target[:1].upper() + target[1:]))
        .otherwise(F.lit(target))
    )


def java_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Characters beyond A-Z that a letter equals when case is ignored. Fixed values.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _begin(term: str, ignore_case: bool) -> str | None:
    """The inside of a class of the characters that a term can begin with, if it begins in ASCII."""
    c = term[:1]
    if not c.isascii():
        return None
    return re.escape(c) if not (ignore_case and c.isalpha()) else c.lower() + c.upper() + _FOLDED.get(c.lower(), "")


def _looked_for(term: str, ignore_case: bool) -> str:
    quoted = f"(?iu:{java_quote(term)})" if ignore_case else java_quote(term)
    return rf"(?<![{WORD}]){quoted}(?![{WORD}])" if re.search(r"\w", term) else quoted


def term_pattern(term: str, ignore_case: bool = True) -> str:
    """A term as a Java pattern, between word boundaries if it has a word character.

    The first character is tested first, as it is far cheaper than a look behind.
    """
    return any_pattern([term], ignore_case)


def any_pattern(terms: list[str], ignore_case: bool = True) -> str:
    """Matches wherever one of the terms does."""
    begins = [_begin(t, ignore_case) for t in terms]
    return (f"(?=[{''.join(begins)}])" if all(begins) else "") + ("|".join(_looked_for(t, ignore_case) for t in terms) if len(terms) == 1 else f"(?:{'|'.join(_looked_for(t, ignore_case) for t in terms)})")


def variant_pattern(placeholder: str) -> str:
    """A placeholder with its underscores lost or turned to other separators."""
    parts = [java_quote(p) for p in placeholder.strip("_").split("_") if p]
    first = _begin(placeholder.strip("_"), True)
    return rf"(?=[_{first}])(?<![{WORD}])(?iu:_*" + r"[^\p{L}\p{N}]*".join(parts) + rf"_*)(?![{WORD}])"


def java_pattern(pattern: str) -> str:
    """A pattern in Python's syntax with its word characters, boundaries and white space spelt out for Java."""
    edge = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    alone = {"w": f"[{WORD}]", "W": f"[^{WORD}]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": edge}
    inside = {"w": WORD, "s": SPACE}
    out, k, in_class = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append((inside if in_class else alone).get(pattern[k + 1], pattern[k : k + 2]))
            k += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(c)
        k += 1
    return "".join(out)


def java_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def edge_preserved(original: Column, translated: Column) -> Column:
    """The translation between the original's white space, if it has any at its ends."""
    before, after = F.regexp_extract(original, rf"(?U)^[{SPACE}]*", 0), F.regexp_extract(original, rf"(?U)[{SPACE}]*$", 0)
    return F.when((before == "") & (after == ""), translated).otherwise(F.concat(before, strip(translated), after))


def page_normalized(c: Column) -> Column:
    """A page's lines without trailing white space and blank lines, stripped."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, rf"(?U)[{SPACE}]+$", ""))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def alphanumeric_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]", ""))


def lines(c: Column) -> Column:
    """Lines as an editor counts them: no empty one after a final line end."""
    parts = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
