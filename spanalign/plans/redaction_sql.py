"""SQL twin of the redaction rules, written with windows over a token table.

It shares the fixed values with the Column functions but none of their method: the carry state is
found from the position of the last key and running counts instead of a pattern on class letters.
"""

from __future__ import annotations

from spanalign import fixed
from spanalign.plans.sql import NON_WS

_KEYS = "|".join(k.replace("_", "[_-]") for k in sorted(fixed.SENSITIVE_KEYS, key=len, reverse=True))
_PWD = "|".join(fixed.PASSWORD_KEYS)
_E = "[^A-Za-z0-9_-]*"
_RUN = r"[0-9+\-(). \t]"


def _core(tok: str, kept: str) -> str:
    return rf"regexp_replace({tok}, '\A[^{kept}]+|[^{kept}]+\z', '', 'g')"


def secret(tok: str) -> str:
    core = _core(tok, "A-Za-z0-9_-")
    aws = rf"regexp_matches({_core(tok, 'A-Za-z0-9')}, '\A(AKIA|ASIA)[A-Z0-9]{{16}}\z')"
    return (
        rf"((regexp_matches({core}, '(?i)\A(sk-|ghp_|xoxb-)') AND strlen({core}) >= 12)"
        rf" OR (regexp_matches({core}, '(?i)\Agithub_pat_') AND strlen({core}) >= 16) OR {aws})"
    )


def email(tok: str) -> str:
    core = rf"regexp_replace({_core(tok, 'A-Za-z0-9@._%+-')}, '[.,;:!?]+\z', '')"
    return rf"regexp_matches({core}, '(?s)\A[^@]+@[^.].*\..*[^.]\z')"


def path(tok: str) -> str:
    edge = r"""[!"#$%&''()*+,:;<=>?@\[\\\]^`{|}]+"""
    core = rf"regexp_replace({tok}, '\A{edge}|{edge}\z', '', 'g')"
    return rf"regexp_matches({core}, '\A(?:{'|'.join(fixed.PRIVATE_PATH_PREFIXES)})')"


def jwt(tok: str) -> str:
    return rf"regexp_matches({_core(tok, 'A-Za-z0-9_-')}, '\A[A-Za-z0-9_-]{{8,}}(\.[A-Za-z0-9_-]{{8,}}){{2}}\z')"


def opaque(tok: str) -> str:
    core = _core(tok, "A-Za-z0-9_+/=-")
    return (
        rf"(regexp_matches({core}, '\A[A-Za-z0-9_+/=-]{{32,}}\z') AND (regexp_matches({core}, "
        rf"'[0-9_+/=-]') OR len(regexp_extract_all({core}, '[A-Z]')) >= 4))"
    )


def assigned(tok: str) -> str:
    return rf"regexp_matches({tok}, '(?i)(\A|[^A-Za-z0-9_-])({_KEYS})[=:]')"


def bare_key(tok: str) -> str:
    return rf"regexp_matches({tok}, '(?i)\A{_E}({_KEYS}){_E}\z')"


def ending(tok: str) -> str:
    return rf"regexp_matches({tok}, '[.,;!?]\z')"


def token_class(tok: str) -> str:
    return rf"""CASE
    WHEN {bare_key(tok)} THEN
      CASE WHEN regexp_matches({tok}, '(?i)\A{_E}({_PWD}){_E}\z') THEN 'P' ELSE 'K' END
    WHEN regexp_matches({tok}, '(?i)(\A|[^A-Za-z0-9_-])({_PWD})[=:]') THEN
      CASE WHEN {ending(tok)} THEN 'a' ELSE 'A' END
    WHEN regexp_matches({tok}, '\A[:=-]+\z') THEN 'S'
    WHEN regexp_matches({tok}, '(?i)\A[^A-Za-z]*(is|was|equals)[^A-Za-z]*\z') THEN
      CASE WHEN {ending(tok)} THEN 'c' ELSE 'C' END
    WHEN {ending(tok)} THEN 'E' ELSE 'N' END"""


def keep_edges(tok: str, replacement: str) -> str:
    kept = "A-Za-z0-9_@/~-"
    return (
        rf"CASE WHEN regexp_matches({tok}, '[{kept}]') THEN regexp_extract({tok}, '\A[^{kept}]*')"
        rf" || '{replacement}' || regexp_extract({tok}, '[^{kept}]*\z') ELSE '{replacement}' END"
    )


def hide_assignments(tok: str) -> str:
    one = (
        rf"regexp_replace(part, '(?i)(\A|[^A-Za-z0-9_-])(({_KEYS})[=:])(.*?)([,)\]}}\"'']*)\z', "
        r"'\1\2[REDACTED]\5')"
    )
    return f"array_to_string(list_transform(regexp_extract_all({tok}, '[^&#;]+|[&#;]'), lambda part: {one}), '')"


def phone_ctes(name: str, source: str) -> dict[str, str]:
    """``<name>``: k, text with phone numbers hidden, and whether there was one."""
    return {
        f"{name}_pieces": rf"""
  SELECT k, i, piece, lag(piece) OVER w AS before, lead(piece) OVER w AS after
  FROM (SELECT k, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
        FROM (SELECT k, regexp_extract_all(text, '{_RUN}+|[^0-9+\-(). \t]+') AS parts FROM {source}))
  WINDOW w AS (PARTITION BY k ORDER BY i)""",
        f"{name}_starts": rf"""
  SELECT *, CASE WHEN n = length(piece) AND regexp_matches(coalesce(after, ''), '\A[A-Za-z0-9]')
    THEN NULL ELSE list_filter(range(1, n + 1), lambda s:
      regexp_matches(piece[s], '[0-9+(]')
      AND NOT regexp_matches(CASE WHEN s > 1 THEN piece[s-1] ELSE coalesce(before[-1], '') END,
                             '[A-Za-z0-9]')
      AND len(regexp_extract_all(piece[s:n], '[0-9]')) BETWEEN 10 AND 15)[1] END AS s
  FROM (SELECT *, length(regexp_replace(piece, '[ \t+\-(.]+\z', '')) AS n FROM {name}_pieces
        WHERE len(regexp_extract_all(piece, '[0-9]')) >= 10 AND regexp_matches(piece, '\A{_RUN}'))""",
        name: rf"""
  SELECT p.k, string_agg(CASE WHEN t.s IS NULL THEN p.piece ELSE
      p.piece[:t.s-1] || '[REDACTED_PHONE]' || p.piece[t.n+1:] END, '' ORDER BY p.i) AS text,
    count(t.s) > 0 AS has_phone
  FROM {name}_pieces p LEFT JOIN {name}_starts t ON p.k = t.k AND p.i = t.i GROUP BY p.k""",
    }


def token_ctes(name: str, source: str) -> dict[str, str]:
    """``<name>``: k, pos, tok, cls, carried."""
    return {
        f"{name}_raw": rf"""
  SELECT k, pos, tok, {token_class('tok')} AS cls
  FROM (SELECT k, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos
        FROM (SELECT k, regexp_extract_all(text, '{NON_WS}+') AS ts FROM {source}))""",
        f"{name}_run": f"""
  SELECT *, max(CASE WHEN cls IN ('K', 'P', 'A', 'a') THEN pos END) OVER (PARTITION BY k
      ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    sum(CAST(cls <> 'S' AS INT)) OVER (PARTITION BY k ORDER BY pos) AS words,
    sum(CAST(cls IN ('E', 'c') AS INT)) OVER (PARTITION BY k ORDER BY pos) AS ends
  FROM {name}_raw""",
        name: f"""
  SELECT t.k, t.pos, t.tok, t.cls, coalesce(t.cls <> 'S' AND CASE s.cls
    WHEN 'K' THEN t.words - CAST(t.cls <> 'S' AS INT) - s.words = 0
    WHEN 'P' THEN t.pos = s.pos + 1 OR (n.cls IN ('S', 'C', 'c') AND t.pos - n.pos <= 8
                  AND t.ends - CAST(t.cls IN ('E', 'c') AS INT) - n.ends = 0)
    WHEN 'A' THEN t.pos - s.pos <= 7 AND t.ends - CAST(t.cls IN ('E', 'c') AS INT) - s.ends = 0
    ELSE false END, false) AS carried
  FROM {name}_run t LEFT JOIN {name}_run s ON s.k = t.k AND s.pos = t.p
  LEFT JOIN {name}_run n ON n.k = t.k AND n.pos = t.p + 1""",
    }


def redacted_ctes(name: str, source: str) -> dict[str, str]:
    """``<name>``: k, text redacted.  ``source`` has columns k and text."""
    return {
        **phone_ctes(f"{name}_ph", source),
        **token_ctes(f"{name}_tk", f"{name}_ph"),
        f"{name}_gaps": f"""
  SELECT k, unnest(gs) AS gap, generate_subscripts(gs, 1) AS i
  FROM (SELECT k, regexp_split_to_array(text, '{NON_WS}+') AS gs FROM {name}_ph)""",
        name: f"""
  SELECT g.k, string_agg(coalesce(CASE
      WHEN tok IS NULL THEN ''
      WHEN {assigned('tok')} THEN {hide_assignments('tok')}
      WHEN {bare_key('tok')} THEN tok
      WHEN {secret('tok')} THEN {keep_edges('tok', '[REDACTED_SECRET]')}
      WHEN carried THEN {keep_edges('tok', '[REDACTED]')}
      WHEN {email('tok')} THEN {keep_edges('tok', '[REDACTED_EMAIL]')}
      WHEN {path('tok')} THEN {keep_edges('tok', '[REDACTED_PATH]')}
      WHEN {jwt('tok')} OR {opaque('tok')} THEN {keep_edges('tok', '[REDACTED_TOKEN]')}
      ELSE tok END, '') || gap, '' ORDER BY g.i) AS text
  FROM {name}_gaps g LEFT JOIN {name}_tk t ON t.k = g.k AND t.pos = g.i - 1 GROUP BY g.k""",
    }


def category_ctes(name: str, source: str) -> dict[str, str]:
    """``<name>``: k, comma-separated categories in order of first appearance ('' when none)."""
    return {
        **phone_ctes(f"{name}_ph", source),
        **token_ctes(f"{name}_tk", source),
        f"{name}_first": f"""
  SELECT k, category, min(pos) AS pos FROM (SELECT k, pos, CASE
      WHEN {assigned('tok')} THEN 'sensitive-key-value' WHEN {secret('tok')} THEN 'secret-token'
      WHEN carried THEN 'sensitive-key-value' WHEN {email('tok')} THEN 'email'
      WHEN {path('tok')} THEN 'private-path' WHEN {jwt('tok')} THEN 'jwt-token'
      WHEN {opaque('tok')} THEN 'opaque-token' END AS category FROM {name}_tk
    UNION ALL SELECT k, 0, 'phone-number' FROM {name}_ph WHERE has_phone)
  WHERE category IS NOT NULL GROUP BY k, category""",
        name: f"""
  SELECT s.k, coalesce(string_agg(category, ',' ORDER BY pos), '') AS categories
  FROM {source} s LEFT JOIN {name}_first f USING (k) GROUP BY s.k""",
    }
