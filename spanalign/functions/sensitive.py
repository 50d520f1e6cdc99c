"""Sensitive-text classification and redaction as pure Column expressions.

A document stays in its row: it is split into tokens, each token gets a one-letter class, and the
class letters joined into a string are matched by one regular expression that says which tokens
follow a secret key.  No shuffle, no Python, and the work is linear in the text.

Class letters
    K  bare sensitive key           P  bare password-like key
    A  password assignment          a  password assignment that ends a phrase
    S  separator (``: = -``)        C  is / was / equals      c  the same, ending a phrase
    E  any other token that ends a phrase                     N  any other token
    e, n  the same for an ordinary word that nothing but the carry rule can touch
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanalign import fixed
from spanalign.functions.text import NON_WS, collapse, escape_markdown, extract_all


def _alternation(keys: tuple[str, ...]) -> str:
    # a key may be written with '-' or '_'; longer keys first so that none hides another
    return "|".join(k.replace("_", "[_-]") for k in sorted(keys, key=len, reverse=True))


_KEYS = _alternation(fixed.SENSITIVE_KEYS)
_PASSWORDS = _alternation(fixed.PASSWORD_KEYS)
_EDGE = "[^A-Za-z0-9_-]*"
BARE_KEY = rf"(?i)\A{_EDGE}(?:{_KEYS}){_EDGE}\z"
BARE_PASSWORD = rf"(?i)\A{_EDGE}(?:{_PASSWORDS}){_EDGE}\z"
ASSIGNMENT = rf"(?i)(?<![A-Za-z0-9_-])(?:{_KEYS})[=:]"
PASSWORD_ASSIGNMENT = rf"(?i)(?<![A-Za-z0-9_-])(?:{_PASSWORDS})[=:]"
ASSIGNED_VALUE = (
    rf"(?i)((?<![A-Za-z0-9_-])(?:{_KEYS})[=:])[^&#;]*?([,)\]}}\"']*)(?=[&#;]|\z)"
)
SEPARATOR = r"\A[:=-]+\z"
CONNECTOR = r"(?i)\A[^A-Za-z]*(?:is|was|equals)[^A-Za-z]*\z"
PHRASE_END = r"[.,;!?]\z"
ORDINARY_WORD = (
    rf"(?i)\A(?!{_EDGE}(?:{_KEYS}){_EDGE}\z)(?![^A-Za-z]*(?:is|was|equals)[^A-Za-z]*\z)"
    r"\p{L}{1,31}[.,;!?]?\z"
)
PHONE = (
    r"(?<![0-9A-Za-z])(?=[0-9+(])(?:[+\-(). \t]*[0-9]){10,15}(?:[+\-(). \t]*\))?"
    r"(?=[ \t+\-(.]*(?:[^0-9A-Za-z+\-(). \t]|\z)|[ \t+\-(.]+[A-Za-z])"
)
# Which tokens stand in a secret-carrying position, read on the class string.
_SEPARATORS_AFTER_KEY = r"(?<=K)S|(?!\A)\GS"
_CARRIED = r"(?<=[KTP]|P[SCc][NnSC]{0,7}|A[NnSC]{0,6})[NnCEecKP]"
_CARRIED_MARK = "*"
# Cheap whole-text tests.  A text without a key carries nothing from token to token; one without any of the literals
# (in lower case) and runs needs no token work.  Many literals are searched faster one by one than by one pattern.
KEY_HINT = rf"(?i)(?=[{''.join(sorted({k[0] for k in fixed.SENSITIVE_KEYS}))}])(?:{_KEYS})"
_LITERALS = tuple(k for key in fixed.SENSITIVE_KEYS for k in dict.fromkeys((key, key.replace("_", "-")))) + (
    "sk-", "ghp_", "xoxb-", "github_pat_", "akia", "asia", "@", "/users/", "/home/", "~/", "/private/", "/var/folders/")
# a literal that holds another one is found with it; keys of several words are found in any mix of '-' and '_'
_LITERALS = tuple(x for x in _LITERALS if not any(y != x and y in x for y in _LITERALS))
RUN_HINT = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{32}|\.(?<=[A-Za-z0-9_-]{8}\.)[A-Za-z0-9_-]{8}"
# The same for one token: without any of it the token has a category only by a key, of its own or before it.
_MARKS = "|".join(("sk-", "ghp_", "xoxb-", "github_pat_", "akia", "asia", "@", *fixed.PRIVATE_PATH_PREFIXES))
TOKEN_HINT = rf"(?i){_MARKS}|{RUN_HINT}"
# Tokens that can have a category in a text without keys: all but words with at most one mark behind them.
UNUSUAL = rf"(?<!{NON_WS})(?!\p{{L}}{{1,31}}[.,;!?]?(?!{NON_WS})){NON_WS}+"
# In such a text a token has a category only by one of these marks or by a core of 20 characters at least.
_FEW_MARKS, _SHORT = ("@", "/", "-", "_"), 20
_PATH_EDGE = r"!\"#$%&'()*+,:;<=>?@\[\\\]^`{|}"
PATH_TOKEN = rf"(?=[/~{_PATH_EDGE}])(?<!{NON_WS})[{_PATH_EDGE}]*(?:{'|'.join(fixed.PRIVATE_PATH_PREFIXES)}){NON_WS}*"

_CATEGORIES = "sensitive-key-value", "secret-token", "email", "private-path", "jwt-token", \
    "opaque-token"


def _core(token: Column, kept: str) -> Column:
    return F.regexp_replace(token, rf"\A[^{kept}]+|[^{kept}]+\z", "")


def is_secret_token(token: Column) -> Column:
    core = _core(token, "A-Za-z0-9_-")
    return (core.rlike(r"(?i)\A(?:sk-|ghp_|xoxb-)") & (F.octet_length(core) >= 12)) | (
        core.rlike(r"(?i)\Agithub_pat_") & (F.octet_length(core) >= 16)
    )


def is_cloud_access_key(token: Column) -> Column:
    return _core(token, "A-Za-z0-9").rlike(r"\A(?:AKIA|ASIA)[A-Z0-9]{16}\z")


def is_email(token: Column) -> Column:
    core = F.regexp_replace(_core(token, "A-Za-z0-9@._%+-"), r"[.,;:!?]+\z", "")
    return core.rlike(r"(?s)\A[^@]+@[^.].*\..*[^.]\z")


def private_path_core(token: Column) -> Column:
    """Token without outer ASCII punctuation (``/ ~ . _ -`` stay)."""
    edge = f"[{_PATH_EDGE}]+"
    return F.regexp_replace(token, rf"\A{edge}|{edge}\z", "")


def is_private_path(token: Column) -> Column:
    inner = "|".join(fixed.PRIVATE_PATH_PREFIXES)
    return private_path_core(token).rlike(rf"\A(?:{inner})")


def is_jwt(token: Column) -> Column:
    return _core(token, "A-Za-z0-9_-").rlike(r"\A[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2}\z")


def is_opaque(token: Column) -> Column:
    core = _core(token, "A-Za-z0-9_+/=-")
    return core.rlike(r"\A[A-Za-z0-9_+/=-]{32,}\z") & core.rlike(
        r"[0-9_+/=-]|[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]"
    )


def has_assignment(token: Column) -> Column:
    return (token.contains("=") | token.contains(":")) & token.rlike(ASSIGNMENT)


def is_separator(token: Column) -> Column:
    return token.rlike(SEPARATOR)


def ends_phrase(token: Column) -> Column:
    return token.rlike(PHRASE_END)


def is_connector(token: Column) -> Column:
    return token.rlike(CONNECTOR)


def redact_assignments(token: Column) -> Column:
    """Hide every value behind ``key=`` or ``key:`` inside one token."""
    return F.regexp_replace(token, ASSIGNED_VALUE, "$1[REDACTED]$2")


def keep_edges(token: Column, replacement: str) -> Column:
    """Replace the middle of a token and keep its outer punctuation."""
    kept = "A-Za-z0-9_@/~-"
    return F.when(
        token.rlike(f"[{kept}]"),
        F.concat(
            F.regexp_extract(token, rf"\A[^{kept}]*", 0),
            F.lit(replacement),
            F.regexp_extract(token, rf"[^{kept}]*\z", 0),
        ),
    ).otherwise(F.lit(replacement))


def token_class(token: Column) -> Column:
    """The class letter of a token (module docstring); most tokens are settled by one pattern."""
    ending = F.substring(token, -1, 1).isin(".", ",", ";", "!", "?")
    return (
        F.when(token.rlike(ORDINARY_WORD), F.when(ending, "e").otherwise("n"))
        .when(token.rlike(BARE_KEY), F.when(token.rlike(BARE_PASSWORD), "P").otherwise("K"))
        .when(is_separator(token), "S")
        .when(is_connector(token), F.when(ending, "c").otherwise("C"))
        .when(token.rlike(PASSWORD_ASSIGNMENT), F.when(ending, "a").otherwise("A"))
        .when(ending, "E")
        .otherwise("N")
    )


def carried_flags(tokens: Column) -> Column:
    """Array of class letters, with ``*`` where a token follows a secret key and is no separator."""
    classes = F.array_join(F.transform(tokens, token_class), "")
    marked = F.regexp_replace(
        F.regexp_replace(classes, _SEPARATORS_AFTER_KEY, "T"), _CARRIED, _CARRIED_MARK
    )
    return F.split(marked, "")


def _with_flags(tokens: Column, visit) -> Column:
    """``visit(token, flag)`` over all tokens, each sub-expression computed once per row."""
    pairs = F.arrays_zip(tokens.alias("token"), carried_flags(tokens).alias("flag"))
    # arrays_zip pads to the longer side: split() may leave one empty entry at the end
    pairs = F.slice(pairs, 1, F.size(tokens))
    return F.transform(pairs, lambda p: visit(p["token"], p["flag"]))


def redact_token(token: Column, flag: Column) -> Column:
    carried = flag == _CARRIED_MARK
    return (
        F.when(flag.isin("n", "e"), token)
        .when(has_assignment(token), redact_assignments(token))
        .when(~carried & ~token.rlike(TOKEN_HINT), token)
        .when(token.rlike(BARE_KEY), token)
        .when(
            is_secret_token(token) | is_cloud_access_key(token),
            keep_edges(token, "[REDACTED_SECRET]"),
        )
        .when(carried, keep_edges(token, "[REDACTED]"))
        .when(is_email(token), keep_edges(token, "[REDACTED_EMAIL]"))
        .when(is_private_path(token), keep_edges(token, "[REDACTED_PATH]"))
        .when(is_jwt(token) | is_opaque(token), keep_edges(token, "[REDACTED_TOKEN]"))
        .otherwise(token)
    )


def token_category(token: Column, flag: Column) -> Column:
    carried = flag == _CARRIED_MARK
    key_value, secret, email, path, jwt, opaque = _CATEGORIES
    return (
        F.when(flag.isin("n", "e"), F.lit(None).cast("string"))
        .when(has_assignment(token), key_value)
        .when(~carried & ~token.rlike(TOKEN_HINT), F.lit(None).cast("string"))
        .when(is_secret_token(token) | is_cloud_access_key(token), secret)
        .when(carried, key_value)
        .when(is_email(token), email)
        .when(is_private_path(token), path)
        .when(is_jwt(token), jwt)
        .when(is_opaque(token), opaque)
    )


def redact_phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, "[REDACTED_PHONE]")


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE)


def may_be_sensitive(text: Column) -> Column:
    """False only where no token has a category or is redacted."""
    small, found = F.lower(text), text.rlike(RUN_HINT)
    for literal in _LITERALS:
        found = small.contains(literal) | found
    return found


def _tokens(text: Column) -> Column:
    return extract_all(text, f"{NON_WS}+")


def redact_text(text: Column) -> Column:
    """Whole text with sensitive tokens replaced and every white-space run kept."""
    phones_hidden = redact_phones(text)
    gaps = F.split(phones_hidden, f"{NON_WS}+")
    shown = _with_flags(_tokens(phones_hidden), redact_token)
    rebuilt = F.concat(
        F.element_at(gaps, 1),
        F.array_join(
            F.zip_with(shown, F.slice(gaps, 2, F.size(gaps)), lambda t, g: F.concat(t, g)), ""
        ),
    )
    return F.when(may_be_sensitive(text), rebuilt).otherwise(phones_hidden)


def _marked(text: Column) -> Column:
    """Without the stretches between blanks that hold no token with a category if the text has no key; this
    costs far less than a look at each token, as the pattern of white space is slow."""
    def kept(stretch: Column) -> Column:
        found = F.octet_length(stretch) >= _SHORT
        for mark in _FEW_MARKS:
            found = found | stretch.contains(mark)
        return found

    return F.array_join(F.filter(F.split(text, " "), kept), " ")


def sensitive_categories(text: Column) -> Column:
    """Distinct categories in order of first appearance; a phone number always comes first."""
    unusual = F.transform(extract_all(_marked(text), UNUSUAL), lambda token: token_category(token, F.lit("N")))
    every = F.when(text.rlike(KEY_HINT), _with_flags(_tokens(text), token_category)).otherwise(unusual)
    found = F.array_distinct(F.array_compact(every))
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(has_phone(text), F.array(F.lit("phone-number"))).otherwise(none),
        F.when(may_be_sensitive(text), found).otherwise(none),
    )


def safe_field(text: Column) -> Column:
    """Redacted, white space collapsed, Markdown escaped (without ``+``)."""
    return escape_markdown(collapse(redact_text(text)), plus=False)


def render_untrusted(label: str, text: Column) -> Column:
    """Labelled one-line rendering of text nobody vouches for; longer input is marked ``...``."""
    limit = fixed.UNTRUSTED_TEXT_MAX_CHARS
    body = escape_markdown(collapse(redact_text(F.substring(text, 1, limit))), plus=True)
    tail = F.when(F.char_length(text) > limit, "...").otherwise("")
    return F.concat(F.lit(f"{label}: [untrusted data] "), body, tail)
