"""SQL twins of the derived tables, as named CTEs for the cross-check."""

from __future__ import annotations

WS_CHARS = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
TOK = "[A-Za-z0-9]+"


def words(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{NON_WS}+')) AS BIGINT)"


def squeeze(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}+|{WS}+\z', '', 'g')"


def collapse(text: str) -> str:
    return squeeze(f"regexp_replace({text}, '{WS}+', ' ', 'g')")


def normalized(text: str) -> str:
    return f"lower({collapse(text)})"


def tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{TOK}'), lambda tk: lower(tk))"


def any_token(text: str, wordlist) -> str:
    inner = ", ".join(f"'{w}'" for w in wordlist)
    filled = f"coalesce({text}, '')"
    return f"list_has_any({tokens(filled)}, [{inner}])"


def utc_ms(text: str) -> str:
    shape = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z\z"
    return (
        f"CASE WHEN regexp_matches({text}, '{shape}') AND {text} NOT LIKE '0000%' THEN "
        f"epoch_ms(TRY_CAST({text}[1:19] AS TIMESTAMP)) + "
        rf"CAST(rpad(regexp_extract({text}, '\.([0-9]+)Z', 1), 3, '0')[1:3] AS BIGINT) END"
    )


def band(distance: str) -> str:
    return f"CASE WHEN {distance} <= 1000 THEN 'high' WHEN {distance} <= 3000 THEN 'medium' ELSE 'low' END"


def mmss(ms: str) -> str:
    return f"format('{{:02d}}:{{:02d}}', ({ms}) // 60000, (({ms}) // 1000) % 60)"


_NARRATED = """
CASE WHEN (conv_id + turn) % 13 = 7 THEN '  ' ELSE
  CASE turn % 8 WHEN 1 THEN 'Alpha marker. ' WHEN 3 THEN 'Bravo marker. '
                WHEN 5 THEN 'Kilo marker. ' ELSE '' END
  || text ||
  CASE (conv_id + turn) % 6 WHEN 1 THEN ' Then I clicked save.' WHEN 2 THEN ' I opened the menu.'
       WHEN 3 THEN ' My password is correct horse battery.'
       WHEN 4 THEN ' Submit it, then press close.' ELSE '' END
END"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "narrated": ((), f"""
  SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS seq, role, {_NARRATED} AS text
  FROM conversations"""),
    "te": (("narrated",), f"""
  SELECT session_id, seq,
    CASE WHEN role = 'system' OR session_id % 10 = 0 THEN 'delta' ELSE 'completed' END AS kind,
    off AS audio_offset_ms,
    CASE WHEN seq % 3 <> 0 THEN off - 120 END AS monotonic_offset_ms, text
  FROM (SELECT *, CAST(400 * sum({words('text')}) OVER (
          PARTITION BY session_id ORDER BY seq) AS BIGINT) AS off FROM narrated)"""),
    "timed": (("te",), """
  SELECT *, coalesce(monotonic_offset_ms, audio_offset_ms, 0) AS offset_ms,
    CASE WHEN monotonic_offset_ms IS NOT NULL THEN 'process-local-monotonic-offset'
         ELSE 'audio-wall-clock-offset' END AS timing_source
  FROM te"""),
    "segments": (("timed",), f"""
  SELECT session_id, segment_id, start_ms, greatest(offset_ms, start_ms) AS end_ms,
         monotonic_offset_ms, timing_source, text
  FROM (SELECT session_id,
          row_number() OVER w AS segment_id,
          coalesce(max(offset_ms) OVER (PARTITION BY session_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms,
          offset_ms, monotonic_offset_ms, timing_source, {squeeze('text')} AS text
        FROM timed WHERE kind = 'completed' AND regexp_matches(text, '{NON_WS}')
        WINDOW w AS (PARTITION BY session_id ORDER BY seq))
  UNION ALL
  SELECT session_id, 1, 0, arg_max(offset_ms, seq),
         arg_max(monotonic_offset_ms, seq) FILTER (last), arg_max(timing_source, seq),
         {squeeze("string_agg(text, '' ORDER BY seq)")}
  FROM (SELECT *, seq = max(seq) OVER (PARTITION BY session_id) AS last FROM timed
        WHERE kind = 'delta' AND session_id NOT IN (
          SELECT session_id FROM timed WHERE kind = 'completed'
            AND regexp_matches(text, '{NON_WS}')))
  GROUP BY session_id
  HAVING regexp_matches(string_agg(text, '' ORDER BY seq), '{NON_WS}')"""),
    "sessions": ((), """
  SELECT session_id, base_ms, last_ms,
    CASE WHEN session_id % 11 <> 5 THEN base_ms END AS audio_started_ms,
    CASE WHEN session_id % 4 <> 0 THEN base_ms + 40 END AS first_chunk_ms,
    CASE WHEN session_id % 13 <> 7 THEN base_ms - (session_id % 9) * 1000 END AS rec_started_ms,
    CASE WHEN session_id % 3 <> 0 THEN base_ms + n_events * 2500 + 5000 END AS rec_ended_ms,
    CASE WHEN session_id % 5 <> 0 THEN 'stopped' ELSE 'recording' END AS state,
    CASE WHEN session_id % 2 = 0 THEN 'high' ELSE 'low' END AS delay,
    CASE WHEN session_id % 6 <> 0 THEN session_id % 7 END AS drain_completed,
    CASE WHEN session_id % 4 <> 1 THEN session_id % 3 END AS drain_observed,
    CASE WHEN session_id % 10 = 0 THEN 1 ELSE 0 END AS drain_errors
  FROM (SELECT user_id AS session_id, min(epoch_us(ts) // 1000) AS base_ms, max(epoch_us(ts) // 1000) AS last_ms,
               count(*) AS n_events FROM events GROUP BY user_id)"""),
    "ui_events": (("sessions",), f"""
  SELECT session_id, seq, event_id, kind, ts_raw, {utc_ms('ts_raw')} AS unix_ms,
    CASE WHEN ts_raw IS NULL THEN 'missing' WHEN ({utc_ms('ts_raw')}) IS NULL THEN 'invalid'
         ELSE 'valid' END AS ts_status,
    'app' || CAST(k % 5 AS VARCHAR) AS app,
    ['Cancel changes', 'Main window', 'Settings - General', 'Close tab', '', NULL][k % 6 + 1]
      AS "window",
    CASE kind WHEN 'click' THEN 'Save document' WHEN 'error' THEN 'Delete row'
      WHEN 'view' THEN 'row ' || CAST(k AS VARCHAR) END AS ui_hint
  FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'bad-date'
          ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS ts_raw
        FROM (SELECT n.*, s.base_ms + (n.seq - 1) * 2500 + n.event_id % 1000 AS ms
              FROM (SELECT user_id AS session_id, event_id, event_type AS kind,
                      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
                    FROM events) n JOIN sessions s USING (session_id)))"""),
    "middles": (("segments", "sessions"), """
  SELECT g.*, s.audio_started_ms, s.audio_started_ms + (g.start_ms + g.end_ms) // 2 AS mid_ms
  FROM segments g LEFT JOIN sessions s USING (session_id)"""),
    "pairs": (("middles", "ui_events"), f"""
  SELECT m.session_id, m.segment_id, m.start_ms, m.end_ms, m.mid_ms, e.seq, e.event_id, e.kind,
    e.unix_ms, e.app, e."window", e.ui_hint, e.unix_ms - m.mid_ms AS delta_ms,
    {band('abs(e.unix_ms - m.mid_ms)')} AS confidence
  FROM middles m JOIN ui_events e ON m.session_id = e.session_id
    AND e.unix_ms BETWEEN m.mid_ms - 6000 AND m.mid_ms + 6000"""),
}


def needed(names) -> list[str]:
    """CTE names with their inputs first."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return order


def query(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named CTEs (and ``extra`` ones) ``body``."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in needed(names)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
