"""Text cleaning and language gates as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as V

NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), V.URL_PATTERN, V.URL_TOKEN)


def mask_phones(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), V.PHONE_PATTERN, V.PHONE_TOKEN)


def mask_users(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), V.USER_PATTERN, V.USER_TOKEN)


def names_pattern(names: Sequence[str]) -> str:
    """A pattern for the first of ``names`` that a text begins with, of any number of names.

    A name that begins with an earlier one can never win. Of what is left the
    longest that fits is also the earliest, so the names are written as a tree, and
    a match takes time by its length rather than by the number of names.
    """
    tree: dict = {}
    for name in names:
        node, fresh = tree, True
        for character in name:
            if "" in node:
                fresh = False
                break
            node = node.setdefault(character, {})
        if fresh:
            node[""] = {}

    def written(node: dict) -> str:
        rest = [re.escape(c) + written(after) for c, after in node.items() if c]
        if not rest:
            return ""
        body = rest[0] if len(rest) == 1 and "" not in node else f"(?:{'|'.join(rest)})"
        return f"{body}?" if "" in node else body

    return written(tree)


def mask_bots(text: Column | str, accounts: Sequence[str]) -> Column:
    """Replace ``@name`` for the known accounts; earlier names win."""
    names = [a for a in accounts if a]
    if not names:
        return _col(text)
    return F.regexp_replace(_col(text), f"@{names_pattern(names)}", V.BOT_TOKEN)


def mask_signature(text: Column | str, signature: str = "strict") -> Column:
    return F.regexp_replace(_col(text), V.SIGNATURE_PATTERNS[signature], V.SIGNATURE_TOKEN)


def drop_disallowed(text: Column | str) -> Column:
    """Runs are dropped at once, which is the same as one character at a time."""
    return F.regexp_replace(_col(text), V.DISALLOWED_PATTERN + "+", "")


def clean_text(
    text: Column | str, accounts: Sequence[str] = (), signature: str = "strict"
) -> Column:
    """The six substitutions in their fixed order, then the outer trim.

    Phones go before user names, so a handle followed by a blank and more
    phone characters is a phone.
    """
    out = mask_phones(mask_urls(text))
    out = mask_bots(mask_users(out), accounts)
    out = drop_disallowed(mask_signature(out, signature))
    return F.btrim(out, F.lit(" \n"))


def ascii_letter_share(text: Column | str) -> Column:
    """ASCII letters over all characters; 0 for empty or NULL text."""
    t = _col(text)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))
    return F.coalesce(F.try_divide(letters, F.length(t)), F.lit(0.0))


def is_english(text: Column | str, threshold: float = V.ENGLISH_SHARE) -> Column:
    return ascii_letter_share(text) > F.lit(float(threshold))


def has_spanish(text: Column | str) -> Column:
    """Any listed word as a whole word in any case."""
    words = "|".join(V.SPANISH_WORDS)
    return _col(text).rlike(f"(?iu){NOT_WORD_BEFORE}({words}){NOT_WORD_AFTER}")


def is_empty(text: Column | str) -> Column:
    return F.length(_col(text)) == 0


def is_bad_turn(text: Column | str) -> Column:
    """A turn that rejects its whole sample: missing, empty or Spanish."""
    t = _col(text)
    return F.coalesce(is_empty(t) | has_spanish(t), F.lit(True))


def text_pieces(text: Column | str) -> Column:
    """Text between placeholders; one more piece than placeholders."""
    return F.split(_col(text), V.PLACEHOLDER_PATTERN)


def placeholder_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(V.PLACEHOLDER_PATTERN), F.lit(1))


def word_count(text: Column | str) -> Column:
    """Pieces on single blanks; a double blank counts an empty word."""
    return F.size(F.split(_col(text), " "))


def words(text: Column | str) -> Column:
    """Non-empty runs between blanks and line ends."""
    return F.filter(F.split(_col(text), "[ \n]+"), lambda w: w != "")
