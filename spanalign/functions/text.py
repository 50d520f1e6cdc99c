"""Text functions on Columns: tokens, words, sentences, markers, escaping, cutting.

Patterns are written so that they mean the same in Java and RE2: white space is an explicit class
(the Unicode White_Space property) and anchors are ``\\A`` and ``\\z``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from spanalign import fixed

WS_CHARS = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same characters as a property: one look at a table, while a class of ranges asks one after the other (ten times the time).
WS, NON_WS = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
ASCII_TOKEN = "[A-Za-z0-9]+"
UNICODE_TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
SENTENCE = r"(?s)\A[^.?!\n]*[.?!\n]|[.?!\n]*[^.?!\n]+[.?!\n]|.+"


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def squeeze(text: Column) -> Column:
    """Strip white space at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NON_WS)


def tokens_ascii(text: Column) -> Column:
    """ASCII alphanumeric runs, lower-cased after extraction (so no letter folds into ASCII)."""
    return F.transform(extract_all(text, ASCII_TOKEN), F.lower)


def tokens_unicode(text: Column) -> Column:
    return F.transform(extract_all(text, UNICODE_TOKEN), F.lower)


def split_words(text: Column) -> Column:
    return extract_all(text, f"{NON_WS}+")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NON_WS}+")).cast("long")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ASCII_TOKEN)).cast("long")


def semantic_word_count(text: Column) -> Column:
    """ASCII token count in which the four tokens ``chat g p t`` are one word."""
    padded = F.concat(F.lit(" "), F.array_join(tokens_ascii(text), "  "), F.lit(" "))
    spelled = F.regexp_count(padded, F.lit(" chat  g  p  t "))
    return (token_count(text) - 3 * spelled).cast("long")


def collapse(text: Column) -> Column:
    """White-space runs become one blank, none at the ends."""
    return squeeze(F.regexp_replace(text, f"{WS}+", " "))


def normalized_text(text: Column) -> Column:
    return F.lower(collapse(text))


def has_any_token(text: Column, words: Sequence[str]) -> Column:
    """True when one ASCII token of ``text`` is in ``words``."""
    inner = "|".join(words)
    return F.coalesce(text, F.lit("")).rlike(
        f"(?i)(?<![A-Za-z0-9])(?:{inner})(?![A-Za-z0-9])"
    )


def mentions_action(text: Column, words: Sequence[str] = fixed.ACTION_WORDS) -> Column:
    return has_any_token(text, words)


def claims_commit(text: Column, words: Sequence[str] = fixed.COMMIT_WORDS) -> Column:
    return has_any_token(text, words)


def has_cancel_label(
    hint: Column, window: Column, words: Sequence[str] = fixed.CANCEL_WORDS
) -> Column:
    return has_any_token(hint, words) | has_any_token(window, words)


def cut(text: Column, chars: int) -> Column:
    """First ``chars`` characters, with ``...`` when something was cut."""
    return F.when(
        F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def ui_hint(selected: Column, target: Column, mode: Column) -> Column:
    return cut(F.coalesce(selected, target, mode), fixed.UI_HINT_MAX_CHARS)


def escape_markdown(text: Column, plus: bool) -> Column:
    """Backslash before Markdown control characters (``+`` only when asked for)."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|!()" + ("+" if plus else "") + r"-])", r"\\$1")


# --- sentences and markers ---

def sentence_spans(text: Column) -> Column:
    """Trimmed pieces, cut after the first of each run of ``. ? !`` or newline; blanks dropped."""
    pieces = F.transform(extract_all(text, SENTENCE), squeeze)
    return F.filter(pieces, lambda piece: piece != "")


def fixed_spans(text: Column, size: int = 20) -> Column:
    """Spans of ``size`` white-space words, words joined by one blank."""
    runs = extract_all(text, f"(?:{NON_WS}+{WS}+){{0,{size - 1}}}{NON_WS}+")
    return F.transform(runs, lambda run: F.regexp_replace(run, f"{WS}+", " "))


def marker_pattern(labels: Sequence[str] = fixed.MARKER_LABELS) -> str:
    inner = "|".join(labels)
    return f"(?i)(?<![A-Za-z0-9])({inner}) marker(?![A-Za-z0-9])"


def _may_hold_marker(text: Column) -> Column:
    """Cheap test that spares most texts the label pattern."""
    return F.lower(text).contains(" marker")


def marker_labels(text: Column, labels: Sequence[str] = fixed.MARKER_LABELS) -> Column:
    """Labels of all markers in text order."""
    found = F.regexp_extract_all(text, F.lit(marker_pattern(labels)), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(_may_hold_marker(text), F.transform(found, F.lower)).otherwise(none)


def marker_pieces(text: Column, labels: Sequence[str] = fixed.MARKER_LABELS) -> Column:
    """Text cut right before every marker; piece 1 is what precedes the first marker."""
    start = f"(?={marker_pattern(labels)[4:]})"
    return F.when(_may_hold_marker(text), F.split(text, "(?i)" + start)).otherwise(F.array(text))


def label_seen(text: Column, label: Column) -> Column:
    """Label present as a marker, as a token, or as one of its three spoken aliases."""
    tokens = tokens_ascii(text)
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (
        F.array_contains(marker_labels(text), label)
        | F.array_contains(tokens, label)
        | ((label == "kilo") & F.array_contains(tokens, "keyhole"))
        | ((label == "mike") & F.array_contains(tokens, "mic"))
        | ((label == "papa") & padded.contains(" pop a "))
    )


def json_long(document: Column, path: str) -> Column:
    """Whole-number field of a JSON document, NULL when absent or of another type."""
    raw = F.get_json_object(document, path)
    return F.when(raw.rlike(r"\A-?[0-9]+\z"), raw.try_cast("bigint"))


def json_text(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)
