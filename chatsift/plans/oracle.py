"""The registered queries in plain SQL, for checking in another engine.

Written from the rules, not from the Spark code: only word lists, the time
grammar and the derived input rows are shared.
"""

from __future__ import annotations

from chatsift.config import INTENTS
from chatsift.functions import timephrase as TP
from chatsift.functions import vocab as V
from chatsift.plans import derived as D


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def has_any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def first_case(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"


def cut_prefix(text: str, prefixes: list[str], wrap=lambda x: x, other: str | None = None) -> str:
    cases = [(f"starts_with(lower({text}), {q(p)})", wrap(f"substr({text}, {len(p) + 1})")) for p in prefixes]
    return first_case(cases, other or text)


# -- scalar extractors ----------------------------------------------------------------

def amount(t: str) -> str:
    hit = f"regexp_extract({t}, {q(V.AMOUNT_PATTERN)}, 0, 'i')"
    turned = f"regexp_matches({hit}, '^\\d+\\s*\\$')"
    return f"CASE WHEN {hit} = '' THEN NULL WHEN {turned} THEN '$' || trim(replace({hit}, '$', '')) ELSE {hit} END"


def trigger(t: str) -> str:
    low = f"lower({t})"
    return first_case([
        (has_any(low, V.PAYMENT_APP_WORDS), "'payment_app'"),
        (has_any(low, V.BILL_SPLIT_WORDS), "'bill_splitting'"),
        (has_any(low, V.DEBT_WORDS), "'owing_debt'"),
        (has_any(low, V.DIRECT_AMOUNT_WORDS), "'direct_amount'"),
    ], "'general_money'")


def direction(t: str) -> str:
    low = f"lower({t})"
    return first_case([
        (has_any(low, V.OFFER_PHRASES), "'offer'"), (has_any(low, V.SPLIT_PHRASES), "'split'"),
    ], "'request'")


def phone(t: str) -> str:
    pos = f"(length(regexp_extract({t}, '^[^0-9]*', 0)) + 1)"
    window = f"substr(lower({t}), greatest(1, {pos} - 30), {pos} + 30 - greatest(1, {pos} - 30))"
    near = f"regexp_matches({t}, '[0-9]') AND {has_any(window, V.PHONE_STOP_WORDS)}"
    ind = f"regexp_replace(regexp_extract({t}, {q(V.PHONE_IN_PATTERN)}, 0), '[^0-9]', '', 'g')"
    us = f"regexp_replace(regexp_extract({t}, {q(V.PHONE_US_PATTERN)}, 0), '[^0-9]', '', 'g')"
    ind_out = f"'+91 ' || substr(right({ind}, 10), 1, 5) || ' ' || substr(right({ind}, 10), 6, 5)"
    us_out = (
        f"'+1 ' || substr(right({us}, 10), 1, 3) || ' ' || substr(right({us}, 10), 4, 3)"
        f" || ' ' || substr(right({us}, 10), 7, 4)"
    )
    return first_case([
        (near, "NULL"),
        (f"length({ind}) = 10 OR (length({ind}) = 12 AND starts_with({ind}, '91'))", ind_out),
        (f"length({us}) = 10 OR (length({us}) = 11 AND starts_with({us}, '1'))", us_out),
    ], "NULL")


def duration(t: str) -> str:
    n = f"try_cast(regexp_extract({t}, {q(V.DURATION_PATTERN)}, 1, 'i') AS BIGINT)"
    unit = f"lower(regexp_extract({t}, {q(V.DURATION_PATTERN)}, 2, 'i'))"
    return f"{n} * CASE WHEN starts_with({unit}, 'h') THEN 3600 ELSE 60 END"


def strip_phrase(t: str, phrase: str) -> str:
    return (
        f"CASE WHEN {phrase} IS NULL OR {phrase} = '' THEN {t} ELSE "
        f"trim(regexp_replace(replace({t}, {phrase}, ' '), '\\s+', ' ', 'g'), ' ,.-') END"
    )


def alarm_label(t: str, phrase: str) -> str:
    out = strip_phrase(f"({cut_prefix(t, V.ALARM_VERBS)})", phrase)
    for tail in (V.LABEL_TAIL_AT, V.LABEL_TAIL_DURATION):
        out = f"trim(regexp_replace({out}, {q(tail)}, ''), ' ,.-')"
    return f"nullif({out}, '')"


def calendar_title(t: str, phrase: str) -> str:
    out = strip_phrase(f"({cut_prefix(t, V.CALENDAR_PREFIXES)})", phrase)
    out = f"trim(regexp_replace({out}, {q(V.TITLE_TAIL)}, ''), ' ,.-')"
    out = f"trim(regexp_replace({out}, {q(V.TITLE_LEAD)}, '', 'i'))"
    return f"nullif({out}, '')"


# boundaries spelled out: \b is ASCII-only here, and some texts have accents
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

def place(t: str) -> str:
    s = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    tidy = lambda x: f"trim({x}, ' ,.-!?')"
    pattern = V.PLACE_FALLBACK_PATTERN.replace(r"\b(?:at|to|from)", _EDGE + r"(?:at|to|from)").replace(
        r"sun)\b|$)", rf"sun){_END}|$)"
    )
    verbs = sorted(V.PLACE_VERBS, key=len, reverse=True)
    fallback = first_case(
        [(f"regexp_matches({s}, {q(pattern)}, 'i')", tidy(f"regexp_extract({s}, {q(pattern)}, 1, 'i')"))],
        f"nullif({tidy(s)}, '')",
    )
    return cut_prefix(f"({s})", verbs, wrap=tidy, other=fallback)


def addressee(t: str) -> str:
    names = "(" + ", ".join(q(n) for n in V.NAMES) + ")"
    marked = f"regexp_extract(' ' || lower({t}), {q(V.ADDRESSEE_PATTERN)}, 1, 'i')"
    leading = f"lower(regexp_extract({t}, {q(V.LEADING_NAME_PATTERN)}, 1))"
    return first_case([(f"{marked} IN {names}", marked), (f"{leading} IN {names}", leading)], "NULL")


def third_party(t: str, who: str, sender: str) -> str:
    names = "(" + "|".join(V.NAMES) + ")"
    found = f"regexp_extract_all(lower({t}), {q(chr(92) + 'b' + names + chr(92) + 'b')}, 1)"
    return f"list_filter({found}, lambda x: x <> coalesce({who}, '') AND x <> lower(coalesce({sender}, '')))[1]"


def is_self(t: str) -> str:
    return has_any(f"lower({t})", V.SELF_PHRASES)


def is_mutual(t: str) -> str:
    return f"regexp_matches({t}, {q(V.MUTUAL_PATTERN)}, 'i')"


# -- time phrases ---------------------------------------------------------------------

def timed(source: str) -> str:
    """Subquery adding time_iso and time_phrase to a source with text and ts."""
    week = "['mon','tue','wed','thu','fri','sat','sun']"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    clock, daypart = q(rf"\b(?:{TP.CLOCK})"), q(rf"\b{TP.DAYPART}")
    word = q(rf"\b(?:today|tomorrow|tmrw|tonight|(?:this|next)\s+weekend|next\s+week|{TP.WEEKDAY})")
    month = q(rf"\b({TP.MONTH})\s+\d{{1,2}}\b")
    month_b = q(rf"\b\d{{1,2}}\s+({TP.MONTH})\b")
    day_a, day_b = q(rf"\b{TP.MONTH}\s+(\d{{1,2}})\b"), q(rf"\b(\d{{1,2}})\s+{TP.MONTH}\b")
    slash = lambda i: f"try_cast(regexp_extract(p, '\\b(\\d{{1,2}})/(\\d{{1,2}})(?:/(\\d{{4}}|\\d{{2}})\\b)?', {i}) AS INT)"
    parts = f"""
SELECT *, lower(phrase) AS p, CAST(ts AS DATE) AS today FROM (
  SELECT *, nullif(regexp_extract(text, {q(TP.PHRASE)}, 0, 'i'), '') AS phrase FROM ({source}) s0) s1"""
    fields = f"""
SELECT *, regexp_extract(p, {clock}, 0) AS clk, regexp_extract(p, {daypart}, 0) AS part,
  regexp_replace(regexp_extract(p, {word}, 0), '\\s+', ' ', 'g') AS dayword,
  coalesce(nullif(regexp_extract(p, {month}, 1), ''), nullif(regexp_extract(p, {month_b}, 1), '')) AS mon,
  coalesce(try_cast(regexp_extract(p, {day_a}, 1) AS INT), try_cast(regexp_extract(p, {day_b}, 1) AS INT)) AS mday,
  {slash(1)} AS s1, {slash(2)} AS s2, {slash(3)} AS sy,
  try_cast(regexp_extract(p, '^in\\s+(\\d{{1,6}})', 1) AS BIGINT) AS rel_n,
  regexp_extract(p, '^in\\s+\\d{{1,6}}\\s*([mhdw])', 1) AS rel_u
FROM ({parts}) f0"""
    numbers = f"""
SELECT *, CASE WHEN mon IS NOT NULL THEN list_position({months}, left(mon, 3))
              WHEN s1 > 12 THEN s2 ELSE s1 END AS m,
  CASE WHEN mon IS NOT NULL THEN mday WHEN s1 > 12 THEN s1 ELSE s2 END AS d,
  CASE WHEN sy < 100 THEN sy + 2000 ELSE sy END AS y,
  try_cast(regexp_extract(clk, '^\\d{{1,2}}', 0) AS INT) AS h0,
  coalesce(try_cast(regexp_extract(clk, ':(\\d\\d)', 1) AS INT), 0) AS mi,
  list_position({week}, left(regexp_replace(dayword, '^(this|next) ', ''), 3)) AS wd
FROM ({fields}) n0"""
    ymd = lambda y: f"try_cast(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE)"
    days = f"""
SELECT *, CASE WHEN y IS NOT NULL THEN {ymd('y')}
               WHEN {ymd('year(today)')} < today THEN {ymd('year(today) + 1')}
               ELSE {ymd('year(today)')} END AS cal,
  CASE WHEN clk <> '' THEN lpad(CAST(CASE WHEN right(clk, 2) = 'pm' THEN h0 % 12 + 12
         WHEN right(clk, 2) = 'am' THEN h0 % 12 ELSE h0 END AS VARCHAR), 2, '0')
         || ':' || lpad(CAST(mi AS VARCHAR), 2, '0')
       ELSE CASE part WHEN 'noon' THEN '12:00' WHEN 'midnight' THEN '00:00' WHEN 'morning' THEN '09:00'
         WHEN 'afternoon' THEN '15:00' WHEN 'evening' THEN '18:00' WHEN 'tonight' THEN '20:00' END END AS hhmm,
  today + CAST((6 - isodow(today) + 6) % 7 + 1 AS INT) AS saturday,
  strftime(ts, '%H:%M') AS own
FROM ({numbers}) d0"""
    chosen = f"""
SELECT *, CASE dayword WHEN 'today' THEN today WHEN 'tonight' THEN today
    WHEN 'tomorrow' THEN today + 1 WHEN 'tmrw' THEN today + 1
    WHEN 'this weekend' THEN saturday WHEN 'next weekend' THEN saturday + 7
    WHEN 'next week' THEN today + 7
    ELSE CASE WHEN wd IS NOT NULL THEN today + CAST((wd - isodow(today) + 6) % 7 + 1 AS INT) ELSE cal END END AS dy,
  (dayword <> '' OR d IS NOT NULL) AS has_day
FROM ({days}) c0"""
    date = lambda x: f"strftime({x}, '%Y-%m-%d') || 'T' || "
    unit = "CASE rel_u WHEN 'm' THEN 1 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 WHEN 'w' THEN 10080 END"
    iso = f"""CASE WHEN rel_n IS NOT NULL THEN strftime(ts + to_minutes(rel_n * {unit}), '%Y-%m-%dT%H:%M')
    WHEN has_day AND hhmm IS NOT NULL THEN {date('dy')} hhmm
    WHEN has_day AND dayword IN ('today', 'tomorrow', 'tmrw', 'next week') THEN {date('dy')} own
    WHEN has_day THEN {date('dy')} '00:00'
    WHEN hhmm > own THEN {date('today')} hhmm
    WHEN hhmm IS NOT NULL THEN {date('today + 1')} hhmm END"""
    return f"""
SELECT * EXCLUDE (phrase, p, today, clk, part, dayword, mon, mday, s1, s2, sy, rel_n, rel_u, m, d, y, h0, mi, wd, cal, hhmm, saturday, own, dy, has_day),
  {iso} AS time_iso, CASE WHEN {iso} IS NOT NULL THEN phrase END AS time_phrase
FROM ({chosen}) t0"""


# -- messages to decisions ----------------------------------------------------------------

MESSAGES = D.messages_sql()
ACCEPTED = f"SELECT * FROM ({MESSAGES}) a WHERE regexp_matches(coalesce(text, ''), '\\S')"


def fired(where: str = "confidence >= 0.5") -> str:
    """Long table of (message, intent) with payload fields and targeting."""
    scores = " UNION ALL ".join(
        f"SELECT seq, '{name}' AS intent, {i} AS ordinal, CASE WHEN "
        f"{has_any('lower(text)', V.INTENT_KEYWORDS[name])} THEN 0.99 ELSE 0.01 END AS confidence FROM m"
        for i, name in enumerate(INTENTS)
    )
    # word lists need a real alias, so the CTE m is the accepted messages
    def only(intent: str, value: str) -> str:
        return f"CASE WHEN intent = '{intent}' AND confidence >= 0.5 THEN {value} END"

    return f"""
SELECT x.*, {addressee('text')} AS addressee, {third_party('text', addressee('text'), 'sender')} AS third_party,
  {is_self('text')} AS is_self, {is_mutual('text')} AS is_mutual,
  {only('money', amount('text'))} AS amount, {only('money', trigger('text'))} AS trigger_type,
  {only('money', direction('text'))} AS direction,
  {only('alarm', alarm_label('text', 'time_phrase'))} AS label,
  {only('alarm', 'tm.time_iso')} AS a_iso, {only('alarm', 'tm.time_phrase')} AS a_phrase,
  {only('alarm', duration('text'))} AS seconds_from_now,
  {only('contact', phone('text'))} AS phone, {only('contact', addressee('text'))} AS name_hint,
  {only('calendar', calendar_title('text', 'time_phrase'))} AS title,
  {only('calendar', 'tm.time_iso')} AS start_iso, {only('calendar', 'tm.time_phrase')} AS start_phrase,
  {only('calendar', f"CASE WHEN tm.time_iso IS NULL THEN NULL WHEN regexp_matches(text, {q(V.SHORT_EVENT_PATTERN)}, 'i') THEN 30 ELSE 60 END")} AS duration_minutes,
  {only('maps', place('text'))} AS place
FROM (SELECT m.*, s.intent, s.ordinal, s.confidence FROM m JOIN ({scores}) s USING (seq)) x
JOIN tm ON tm.seq = x.seq WHERE {where}"""


def _js(value: str) -> str:
    return f"coalesce(CAST(to_json({value}) AS VARCHAR), 'null')"


def _opt(name: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '' ELSE ',\"{name}\":' || CAST(to_json({value}) AS VARCHAR) END"


PAYLOAD_JSON = f"""CASE intent
 WHEN 'money' THEN '{{"amount":' || {_js('amount')} || ',"trigger_type":' || {_js('trigger_type')} || ',"direction":' || {_js('direction')} || '}}'
 WHEN 'alarm' THEN '{{"label":' || {_js('label')} || {_opt('time_iso', 'a_iso')} || {_opt('time_phrase', 'a_phrase')} || {_opt('seconds_from_now', 'seconds_from_now')} || '}}'
 WHEN 'contact' THEN '{{"phone":' || {_js('phone')} || ',"name_hint":' || {_js('name_hint')} || '}}'
 WHEN 'calendar' THEN '{{"title":' || {_js('title')} || {_opt('start_iso', 'start_iso')} || {_opt('start_phrase', 'start_phrase')} || {_opt('duration_minutes', 'duration_minutes')} || '}}'
 WHEN 'maps' THEN '{{"place":' || {_js('place')} || '}}' END"""
KEY1 = ("CASE intent WHEN 'money' THEN amount WHEN 'alarm' THEN a_iso WHEN 'contact' THEN phone "
        "WHEN 'calendar' THEN start_iso WHEN 'maps' THEN nullif(place, '') END")
KEY2 = "CASE WHEN intent = 'alarm' THEN nullif(CAST(seconds_from_now AS VARCHAR), '0') END"

BASE = f"m AS MATERIALIZED ({ACCEPTED}), tm AS MATERIALIZED (SELECT seq, time_iso, time_phrase FROM ({timed('SELECT * FROM m')}) z)"
FIRED = f"{BASE}, fi AS MATERIALIZED ({fired()})"


def replay(params=D.PARAMS, key1=KEY1, key2=KEY2) -> str:
    """CTEs ending in ``dec``: one row per event with the tracker after it."""
    ev_us, gr = params.eviction * 1_000_000, params.grace * 1_000_000
    cd, dm = params.cooldown * 1_000_000, params.dismissed * 1_000_000
    intents = ", ".join(f"'{i}'" for i in INTENTS)
    return f"""{FIRED},
ctl AS (
  SELECT seq, ts, chat_id, kind, coalesce(intent, 'money') AS intent, amount AS key1, true AS scoped
  FROM ({D.controls_sql()}) c WHERE kind <> 'reset_cooldown' AND coalesce(intent, 'money') IN ({intents})
  UNION ALL SELECT seq, ts, chat_id, kind, intent, NULL, true FROM ({D.controls_sql()}) c
  WHERE kind = 'reset_cooldown' AND intent IN ({intents})
  UNION ALL SELECT seq, ts, chat_id, kind, i.intent, NULL, false FROM ({D.controls_sql()}) c,
    (SELECT unnest([{intents}]) AS intent) i WHERE kind = 'reset_cooldown' AND c.intent IS NULL),
allev AS (
  SELECT seq, ts, chat_id, intent, 'message' AS kind, {key1} AS key1, {key2} AS key2, {PAYLOAD_JSON} AS body, CAST(NULL AS BOOLEAN) AS scoped FROM fi
  UNION ALL SELECT seq, ts, chat_id, 'money', 'observe', NULL, NULL, NULL, NULL FROM m
    WHERE seq NOT IN (SELECT seq FROM fi WHERE intent = 'money')
  UNION ALL SELECT seq, ts, chat_id, intent, kind, key1, NULL,
    CASE WHEN kind = 'payment_complete' AND key1 IS NOT NULL THEN '{{"amount":' || to_json(key1) || '}}' END, scoped FROM ctl),
ev AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, dense_rank() OVER (ORDER BY chat_id, intent) AS k,
   row_number() OVER (PARTITION BY chat_id, intent ORDER BY ts, seq) AS rn
  FROM allev WHERE chat_id IS NOT NULL),
rec AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS st, CAST(NULL AS BIGINT) AS lp, CAST(NULL AS BIGINT) AS le,
    CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS pay, CAST(0 AS BIGINT) AS pc, CAST(0 AS BIGINT) AS sc,
    CAST(NULL AS VARCHAR) AS why, CAST(NULL AS BOOLEAN) AS pop, CAST(NULL AS VARCHAR) AS sup, CAST(NULL AS BIGINT) AS rem,
    CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS BOOLEAN) AS existed FROM ev
  UNION ALL
  SELECT k, rn,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN kind = 'payment_complete' THEN 'post_payment'
         WHEN kind = 'popup_dismissed' THEN 'dismissed' WHEN fire THEN 'cooldown' ELSE st END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN fire OR kind = 'popup_dismissed' THEN us
         WHEN kind = 'payment_complete' THEN coalesce(lp, us) ELSE lp END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN fire OR kind IN ('popup_dismissed', 'payment_complete') THEN us ELSE le END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN fire OR (kind = 'payment_complete' AND ek1 IS NOT NULL) THEN ek1 ELSE k1 END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN fire THEN ek2 WHEN kind = 'payment_complete' AND ek1 IS NOT NULL THEN NULL ELSE k2 END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN fire OR (kind = 'payment_complete' AND ek1 IS NOT NULL) THEN body ELSE pay END,
    CASE WHEN kind = 'reset_cooldown' THEN 0 WHEN fire THEN pc + 1 ELSE pc END,
    CASE WHEN kind = 'reset_cooldown' THEN 0 WHEN kind = 'message' AND NOT fire THEN sc + 1 ELSE sc END,
    CASE WHEN kind = 'reset_cooldown' THEN NULL WHEN kind = 'payment_complete' THEN 'payment_completed'
         WHEN kind = 'popup_dismissed' THEN 'user_dismissed_popup' WHEN fire THEN 'popup_just_fired' ELSE why END,
    CASE WHEN kind = 'message' THEN fire END,
    CASE WHEN kind = 'message' AND NOT fire THEN CASE st WHEN 'post_payment' THEN 'post_payment_grace'
         WHEN 'dismissed' THEN 'recently_dismissed' ELSE 'cooldown_active' END END,
    CASE WHEN kind = 'message' THEN CASE WHEN fire THEN 0 ELSE lft // 1000000 END END,
    coalesce(st, 'idle'), st IS NOT NULL
  FROM (
    SELECT *, kind = 'message' AND (st IS NULL OR lft <= 0 OR (st <> 'post_payment' AND
        (coalesce(k1 <> ek1, false) OR coalesce(k2 <> ek2, false)))) AS fire
    FROM (
      SELECT *, CASE st WHEN 'post_payment' THEN {gr} - (us - le) WHEN 'dismissed' THEN {dm} - (us - lp)
                ELSE {cd} - (us - lp) END AS lft
      FROM (
        SELECT e.k, e.rn, e.kind, e.us, e.key1 AS ek1, e.key2 AS ek2, e.body,
          CASE WHEN ok THEN r.st END AS st, CASE WHEN ok THEN r.lp END AS lp, CASE WHEN ok THEN r.le END AS le,
          CASE WHEN ok THEN r.k1 END AS k1, CASE WHEN ok THEN r.k2 END AS k2, CASE WHEN ok THEN r.pay END AS pay,
          CASE WHEN ok THEN r.pc ELSE 0 END AS pc, CASE WHEN ok THEN r.sc ELSE 0 END AS sc, CASE WHEN ok THEN r.why END AS why
        FROM (SELECT rec.*, ev.kind, ev.us, ev.key1, ev.key2, ev.body, ev.rn AS ern,
                (rec.st IS NOT NULL AND ev.us - rec.le <= {ev_us}) AS ok
              FROM rec JOIN ev ON ev.k = rec.k AND ev.rn = rec.rn + 1) r,
             LATERAL (SELECT r.k AS k, r.ern AS rn, r.kind AS kind, r.us AS us, r.key1 AS key1, r.key2 AS key2, r.body AS body) e
      ) a
    ) b
  ) c
),
dec AS MATERIALIZED (
  SELECT ev.seq, ev.ts, ev.chat_id, ev.intent, ev.kind, ev.scoped, pop AS should_popup, sup AS suppressed_reason,
    CAST(rem AS INT) AS cooldown_remaining_seconds, coalesce(st, 'idle') AS chat_state, prev AS previous_state, existed,
    pc AS popup_count, sc AS suppression_count, lp AS last_popup_us, le AS last_event_us, why AS state_reason, pay AS last_payload
  FROM rec JOIN ev ON ev.k = rec.k AND ev.rn = rec.rn
  UNION ALL
  SELECT seq, ts, chat_id, intent, kind, scoped, CASE WHEN kind = 'message' THEN true END, NULL,
    CASE WHEN kind = 'message' THEN 0 END, 'untracked', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM allev WHERE chat_id IS NULL AND kind IN ('message', 'observe'))"""


# -- one statement per registered query -------------------------------------------------------

from chatsift.plans import queries as Q  # noqa: E402  (derived inputs only)

_M = f"WITH {BASE}"
_F = f"WITH {FIRED}"
_R = f"WITH RECURSIVE {replay()}"
_DEC = ", ".join(Q.DECISION)
_AS_OF = f"TIMESTAMP '{Q.AS_OF}'"
_US = f"epoch_us({_AS_OF})"


def iso_us(us: str) -> str:
    whole = f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S')"
    return f"{whole} || CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END"


_SNAP = f"""snap AS (
  SELECT chat_id, intent, chat_state AS state, {iso_us('last_popup_us')} AS last_popup_at,
    {iso_us('last_event_us')} AS last_event_at, last_payload, popup_count, suppression_count,
    CAST(greatest(0, CASE chat_state WHEN 'post_payment' THEN {D.PARAMS.grace * 1000000} - ({_US} - last_event_us)
      WHEN 'dismissed' THEN {D.PARAMS.dismissed * 1000000} - ({_US} - last_popup_us)
      ELSE {D.PARAMS.cooldown * 1000000} - ({_US} - last_popup_us) END) // 1000000 AS INT) AS cooldown_remaining_seconds,
    state_reason AS reason_for_current_state
  FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, intent ORDER BY ts DESC, seq DESC) AS r
        FROM dec WHERE chat_state <> 'untracked' AND ts <= {_AS_OF}) z
  WHERE r = 1 AND last_event_us IS NOT NULL AND {_US} - last_event_us <= {D.PARAMS.eviction * 1000000})"""

_TARGET = "addressee, third_party, is_self, is_mutual"


def _sigmoid(i: int) -> str:
    return f"round(1 / (1 + exp(-CAST(embedding[{i}] AS DOUBLE))), 6)"


def _draw(seed: int, row: str, purpose: str) -> str:
    return f"CAST('0x' || left(md5('{seed}|' || CAST({row} AS VARCHAR) || '|{purpose}'), 8) AS BIGINT)"


def _chance(row: str, name: str) -> str:
    return f"{_draw(Q.SEED, row, name)} / 4294967296.0 < {V.AUGMENT_ODDS[name]}"


def _variants(t: str, row: str) -> str:
    def one_of(values, purpose):
        return "[" + ", ".join(q(v) for v in values) + f"][{_draw(Q.SEED, row, purpose)} % {len(values)} + 1]"

    words = f"string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')"
    at = f"({_draw(Q.SEED, row, 'word')} % len({words}))"
    word = f"{words}[{at} + 1]"
    cut = f"(1 + {_draw(Q.SEED, row, 'letter')} % greatest(length({word}) - 2, 1))"
    dropped = f"CASE WHEN length({word}) > 3 THEN left({word}, {cut}) || substr({word}, {cut} + 2) ELSE {word} END"
    typo = f"array_to_string(list_concat({words}[1:{at}], [{dropped}], {words}[{at} + 2:len({words})]), ' ')"
    options = ", ".join([
        t, f"CASE WHEN {_chance(row, 'lower')} THEN lower({t}) END",
        f"CASE WHEN {_chance(row, 'upper')} THEN upper({t}) END",
        f"CASE WHEN {_chance(row, 'prefix')} THEN {one_of(V.AUGMENT_PREFIXES, 'which prefix')} || {t} END",
        f"CASE WHEN {_chance(row, 'suffix')} THEN {t} || {one_of(V.AUGMENT_SUFFIXES, 'which suffix')} END",
        f"CASE WHEN {_chance(row, 'typo')} AND trim({t}) <> '' THEN {typo} END",
    ])
    return f"list_filter([{options}], lambda x: x IS NOT NULL)"


def _augmented(source: str, t: str, row: str, rest: str) -> str:
    return f"""SELECT {rest}, vs[{_draw(Q.SEED, row, 'variant')} % len(vs) + 1] AS text
FROM (SELECT *, {_variants(t, row)} AS vs FROM ({source}) a0) a1"""


def _split(source: str, row: str, rest: str) -> str:
    return f"""SELECT {rest}, CASE WHEN pos / n < 0.80 THEN 'train' WHEN pos / n < 0.90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, CAST(row_number() OVER (ORDER BY md5('{Q.SEED}|' || CAST({row} AS VARCHAR)), {row}) - 1 AS DOUBLE) AS pos,
        count(*) OVER () AS n FROM ({source}) p0) p1"""


_MULTI = """mu AS (SELECT d.doc_id AS id, source AS category,
   [quality * 0.3 + (d.doc_id * 37 + n_chars) % 1000 / 1000.0 * 0.7, toxic * 0.2 + (d.doc_id * 91 + n_chars * 7) % 1000 / 1000.0 * 0.75] AS probs,
   [quality, toxic] AS labels FROM documents d JOIN labels USING (doc_id)),
ce AS (SELECT id, n AS intent, CAST(probs[i] AS DOUBLE) AS prob, labels[i] AS label, CAST(probs[i] >= 0.5 AS INT) AS pred
   FROM mu, (VALUES (1, 'quality'), (2, 'toxic')) v(i, n))"""
_PRF = """round(CASE WHEN support = 0 OR predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS precision,
  round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support) END, 6) AS f1"""


def _names(vec: str) -> str:
    return (f"CASE WHEN {vec}[1] = 1 AND {vec}[2] = 1 THEN 'quality,toxic' WHEN {vec}[1] = 1 THEN 'quality' "
            f"WHEN {vec}[2] = 1 THEN 'toxic' ELSE 'none' END")


_PREDS = "[CAST(probs[1] >= 0.5 AS INT), CAST(probs[2] >= 0.5 AS INT)]"

_TEMPLATES = f"te AS ({Q.templates_sql()}), fl AS MATERIALIZED ({Q.fillers_sql()})"
_QUOTAS = f"""{_TEMPLATES}, gr AS (SELECT category, count(*) AS templates, any_value(money + alarm) AS flags, any_value(money) AS mo FROM te GROUP BY 1),
pe AS (SELECT *, count(*) FILTER (flags = 1) OVER (PARTITION BY mo) AS peers FROM gr),
po AS (SELECT *, CASE WHEN flags = 2 THEN 8 * templates WHEN flags = 1 AND category = 'mixed_money' THEN 600 // (2 * peers)
   WHEN flags = 1 THEN 600 // peers END AS quota FROM pe),
qu AS (SELECT category, templates, flags, CAST(coalesce(quota, floor((SELECT sum(quota) FROM po) * 0.5)) AS BIGINT) AS quota FROM po)"""
_DRAWN = f"""{_QUOTAS}, dr AS (SELECT category || '#' || CAST(i AS VARCHAR) AS id, category, templates, flags, i
   FROM (SELECT category, templates, flags, unnest(generate_series(0, quota - 1)) AS i FROM qu WHERE quota > 0) g),
dt AS MATERIALIZED (SELECT id, te.* FROM dr JOIN te ON te.category = dr.category AND te.idx = CASE WHEN flags = 2 THEN i % templates ELSE {_draw(Q.SEED, 'id', 'template')} % templates END)"""


def _filled(source: str, keep: str) -> str:
    """Each hole in turn is replaced by its own draw."""
    return f"""SELECT {keep}, string_agg(lit || coalesce(value, CASE WHEN token IS NOT NULL THEN '{{' || token || '}}' END, ''), '' ORDER BY pos) AS text
FROM (SELECT h.*, fl.value FROM (
   SELECT s.*, pos, string_split_regex(template, '\\{{\\w+\\}}')[pos + 1] AS lit, regexp_extract_all(template, '\\{{(\\w+)\\}}', 1)[pos + 1] AS token
   FROM (SELECT *, unnest(generate_series(0, len(regexp_extract_all(template, '\\{{(\\w+)\\}}', 1)))) AS pos FROM {source}) s) h
 LEFT JOIN (SELECT token, count(*) AS n FROM fl GROUP BY 1) sz ON sz.token = h.token
 LEFT JOIN fl ON fl.token = h.token AND fl.idx = CAST('0x' || left(md5('{Q.SEED}|' || id || '@' || CAST(pos AS VARCHAR) || '|filler'), 8) AS BIGINT) % sz.n) f
GROUP BY {keep}"""


_DATASET = f"""WITH {_DRAWN}, fd AS MATERIALIZED ({_filled('dt', 'id, category, money, alarm')}),
ag AS MATERIALIZED ({_augmented('SELECT * FROM fd', 'text', 'id', 'id, category, money, alarm').replace(' AS text', ' AS noisy')}),
ds AS ({_split('SELECT * FROM ag', 'id', 'id, noisy AS text, money, alarm, 0 AS contact, 0 AS calendar, 0 AS maps, category')})"""


def _encode(x: str) -> str:
    out = f"url_encode({x})"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def _esc(x: str) -> str:
    out = f"coalesce({x}, '')"
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        out = f"replace({out}, '{char}', '{entity}')"
    return out


_TO = "coalesce(third_party, addressee)"
_STAMP = "'%Y%m%dT%H%M%SZ'"
_START = "strptime(start_iso, '%Y-%m-%dT%H:%M')"
_LINK = f"""CASE intent
  WHEN 'money' THEN {q(V.PAY_URL)} || coalesce('&amount=' || {_encode("regexp_replace(amount, '^\\$', '')")}, '')
     || coalesce('&recipients=' || {_encode(_TO)}, '')
  WHEN 'contact' THEN 'tel:' || coalesce(phone, '—')
  WHEN 'calendar' THEN {q(V.CALENDAR_URL)} || '?text=' || {_encode("coalesce(title, 'Event')")}
     || coalesce('&dates=' || strftime({_START}, {_STAMP}) || '/' || strftime({_START} + to_minutes(CAST(duration_minutes AS BIGINT)), {_STAMP}), '')
  WHEN 'maps' THEN {q(V.MAPS_URL)} || {_encode("coalesce(nullif(place, ''), '—')")} END"""
_TITLE = f"""CASE intent WHEN 'money' THEN 'Send ' || coalesce(amount, '—') || ' ' || coalesce('to ' || {_TO}, '')
  WHEN 'alarm' THEN 'Set alarm: ' || coalesce(label, 'Reminder') WHEN 'contact' THEN 'Save ' || coalesce(name_hint, {_TO}, 'New contact')
  WHEN 'calendar' THEN coalesce(title, 'Event') WHEN 'maps' THEN coalesce(nullif(place, ''), '—') END"""
_SUB = """CASE intent WHEN 'money' THEN '"' || text || '"' WHEN 'alarm' THEN coalesce(a_phrase, a_iso, '—')
  WHEN 'contact' THEN coalesce(phone, '—') WHEN 'calendar' THEN coalesce(start_phrase, start_iso, '—') ELSE 'Open in maps' END"""

_MONEY_ROW = """SELECT d.seq, d.chat_id, m.message_id, m.sender, d.kind = 'message' AS is_money,
  CASE WHEN d.kind = 'message' THEN 0.99 ELSE 0.01 END AS confidence, f.trigger_type, f.direction, f.amount AS detected_amount,
  CASE WHEN d.kind = 'message' THEN d.should_popup ELSE false END AS should_popup,
  CASE WHEN d.kind = 'message' THEN d.suppressed_reason ELSE 'not_money' END AS suppressed_reason,
  coalesce(d.cooldown_remaining_seconds, 0) AS cooldown_remaining_seconds, d.chat_state
FROM dec d JOIN m ON m.seq = d.seq LEFT JOIN fi f ON f.seq = d.seq AND f.intent = 'money'
WHERE d.intent = 'money' AND d.kind IN ('message', 'observe')"""

_TJ = ("'{\"addressee\":' || coalesce(CAST(to_json(addressee) AS VARCHAR), 'null') || ',\"third_party\":' || "
       "coalesce(CAST(to_json(third_party) AS VARCHAR), 'null') || ',\"is_self\":' || is_self || ',\"is_mutual\":' || is_mutual || '}'")
_FRAMES = Q.frames_sql("events")
# the frames become messages; the replay then runs on those instead
_FRAME_MESSAGES = f"""SELECT seq, ts, CAST(NULL AS VARCHAR) AS message_id, nullif(value ->> '$.chat_id', '') AS chat_id,
  value ->> '$.sender' AS sender, value ->> '$.text' AS text, value FROM ({_FRAMES}) fr
  WHERE json_valid(value) AND regexp_matches(coalesce(value ->> '$.text', ''), '\\S')"""
_FRAME_REPLAY = replay().replace(ACCEPTED, _FRAME_MESSAGES).replace(D.controls_sql(), D.controls_sql() + " AND false")

_MEMBERS = f"SELECT DISTINCT chat_id, sender AS usr FROM ({MESSAGES}) mm WHERE chat_id IS NOT NULL AND sender IS NOT NULL"
_AUDIENCE = f"""{_R}, pops AS (SELECT f.*, CASE WHEN f.intent = 'money' THEN CASE f.direction WHEN 'request' THEN 'others' WHEN 'offer' THEN 'sender' ELSE 'everyone' END
        WHEN is_self THEN 'sender' WHEN is_mutual THEN 'everyone' WHEN addressee IS NOT NULL THEN 'addressee' END AS rule
      FROM dec d JOIN fi f ON f.seq = d.seq AND f.intent = d.intent WHERE d.kind = 'message' AND d.should_popup),
au AS (SELECT p.seq, p.chat_id, p.intent, p.rule, mb.usr AS "user" FROM pops p
      JOIN ({_MEMBERS}) mb ON mb.chat_id = p.chat_id
      WHERE rule = 'everyone' OR (rule = 'others' AND mb.usr IS DISTINCT FROM p.sender) OR (rule = 'sender' AND mb.usr = p.sender)
        OR (rule = 'addressee' AND lower(mb.usr) = p.addressee))"""


def _entry(alias: str = "d") -> str:
    nul = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
    return (
        f"'{{\"type\":\"' || {alias}.intent || '\",\"confidence\":0.99,\"should_popup\":' || {alias}.should_popup || "
        f"',\"suppressed_reason\":' || {nul(alias + '.suppressed_reason')} || ',\"cooldown_remaining_seconds\":' || "
        f"{alias}.cooldown_remaining_seconds || ',\"chat_state\":\"' || {alias}.chat_state || '\",\"payload\":' || pj || "
        f"',\"targeting\":' || tj || '}}'"
    )


_RESPONSES = f"""WITH RECURSIVE {_FRAME_REPLAY},
      en AS (SELECT d.seq, string_agg({_entry()}, ',' ORDER BY f.ordinal) AS entries FROM dec d
        JOIN (SELECT seq, intent, ordinal, {PAYLOAD_JSON} AS pj, {_TJ} AS tj FROM fi) f ON f.seq = d.seq AND f.intent = d.intent
        WHERE d.kind = 'message' GROUP BY 1),
      fm AS ({_MONEY_ROW})
      SELECT m.seq, regexp_replace(m.value, '\\}}\\s*$', '') || ',"venmo_detection":{{"is_money":' || is_money || ',"confidence":' || confidence
        || ',"trigger_type":' || {_js('trigger_type')} || ',"direction":' || {_js('direction')} || ',"detected_amount":' || {_js('detected_amount')}
        || ',"should_popup":' || should_popup || ',"suppressed_reason":' || {_js('suppressed_reason')}
        || ',"cooldown_remaining_seconds":' || cooldown_remaining_seconds || ',"chat_state":"' || chat_state || '","latency_ms":null}},"intents":['
        || coalesce(entries, '') || ']}}' AS response
      FROM fm JOIN m ON m.seq = fm.seq LEFT JOIN en ON en.seq = m.seq"""

_SESSIONS = f"""WITH RECURSIVE {replay()}, gaps AS (SELECT *, us - lag(us) OVER w AS gap FROM (SELECT *, epoch_us(ts) AS us FROM allev WHERE kind <> 'observe' AND chat_id IS NOT NULL) a
    WINDOW w AS (PARTITION BY chat_id, intent ORDER BY ts, seq)),
  se AS (SELECT *, 1 + count(*) FILTER (gap > {D.PARAMS.eviction}000000) OVER (PARTITION BY chat_id, intent ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM gaps)"""

ORACLE: dict[str, str] = {
    "trigger_totals": f"""{_F} SELECT trigger_type, direction, count(*) AS n, count(amount) AS with_amount,
      round(sum(CAST(nullif(regexp_replace(amount, '[^0-9.]', '', 'g'), '') AS DOUBLE)), 2) AS total
      FROM fi WHERE intent = 'money' GROUP BY 1, 2""",
    "amounts": f"SELECT seq, {amount('text')} AS amount, {trigger('text')} AS trigger_type, {direction('text')} AS direction FROM ({ACCEPTED}) x",
    "phones_in_documents": f"SELECT doc_id, {phone('text')} AS phone FROM documents",
    "phones_in_pages": f"SELECT page_id, {phone('html')} AS phone FROM pages",
    "phones_in_messages": f"SELECT seq, {phone('text')} AS phone FROM ({ACCEPTED}) x",
    "durations": f"SELECT seq, {duration('text')} AS seconds FROM ({ACCEPTED}) x",
    "places": f"SELECT seq, {place('text')} AS place FROM ({ACCEPTED}) x",
    "places_in_conversations": f"SELECT conv_id * 1000000000 + turn AS seq, {place('text')} AS place FROM conversations",
    "targeting": f"""SELECT seq, {addressee('text')} AS addressee, {third_party('text', addressee('text'), 'sender')} AS third_party,
      {is_self('text')} AS is_self, {is_mutual('text')} AS is_mutual FROM ({ACCEPTED}) x""",
    "time_phrases": f"""SELECT seq, time_iso, time_phrase, time_phrase IS NOT NULL AS is_valid,
      length(text) >= 3 AND (regexp_matches(text, '\\d') OR regexp_matches(lower(text),
        {q(chr(92) + 'b(?:' + '|'.join(w.replace('.', chr(92) + '.') for w in V.TIME_WORDS) + ')' + chr(92) + 'b')})) AS names_a_time
      FROM ({timed(ACCEPTED)}) x""",
    "labels_and_titles": f"""SELECT seq, {strip_phrase('text', 'time_phrase')} AS stripped, {alarm_label('text', 'time_phrase')} AS label,
      {calendar_title('text', 'time_phrase')} AS title FROM ({timed(ACCEPTED)}) x""",
    "iso_times": f"SELECT event_id, {iso_us('epoch_us(ts)')} AS iso FROM events",
    "rejected_messages": f"SELECT seq, 'text required' AS reason FROM ({MESSAGES}) x WHERE NOT regexp_matches(coalesce(text, ''), '\\S')",
    "rejected_controls": f"""SELECT seq, intent, 'unknown intent' AS reason FROM ({D.controls_sql()}) x
      WHERE intent NOT IN ({', '.join(q(i) for i in INTENTS)})""",
    "sigmoid_scores": "SELECT vec_id, " + ", ".join(f"{_sigmoid(n + 1)} AS {i}" for n, i in enumerate(INTENTS)) + " FROM embeddings",
    "reordered_scores": f"""SELECT vec_id, {_sigmoid(2)} AS money, {_sigmoid(4)} AS alarm, {_sigmoid(5)} AS contact,
      CAST(0 AS DOUBLE) AS calendar, {_sigmoid(1)} AS maps FROM embeddings""",
    "softmax_scores": """SELECT vec_id, round(exp(CAST(embedding[2] AS DOUBLE)) / (exp(CAST(embedding[1] AS DOUBLE))
      + exp(CAST(embedding[2] AS DOUBLE))), 6) AS money, CAST(0 AS DOUBLE) AS alarm FROM embeddings""",
    "fired_intents": f"{_F} SELECT seq, chat_id, intent, CAST(confidence AS DOUBLE) AS confidence, {_TARGET} FROM fi",
    "payloads": f"{_F} SELECT seq, intent, {PAYLOAD_JSON} AS payload, {KEY1} AS key1, {KEY2} AS key2 FROM fi",
    "conversation_intents": " UNION ALL ".join(
        f"SELECT conv_id * 1000000000 + turn AS seq, '{i}' AS intent FROM conversations WHERE {has_any('lower(text)', V.INTENT_KEYWORDS[i])}"
        for i in INTENTS),
    "batch_scored": "SELECT seq, " + ", ".join(
        f"CAST(CASE WHEN {has_any('lower(text)', V.INTENT_KEYWORDS[i])} THEN 0.99 ELSE 0.01 END AS DOUBLE) AS {i}"
        for i in INTENTS) + f" FROM ({ACCEPTED}) x",
    "decisions": f"{_R} SELECT {_DEC} FROM dec WHERE kind <> 'observe'",
    "hot_chat_decisions": f"{_R} SELECT {_DEC} FROM dec",
    "default_window_decisions": f"""WITH RECURSIVE {replay(Q.PolicyParams()).replace(D.controls_sql(), D.controls_sql() + ' AND false')}
      SELECT seq, intent, should_popup, suppressed_reason, cooldown_remaining_seconds, popup_count FROM dec WHERE kind = 'message'""",
    "custom_key_decisions": f"""WITH RECURSIVE {replay(key1="CASE intent WHEN 'money' THEN direction WHEN 'maps' THEN nullif(place, '') END", key2='NULL').replace(D.controls_sql(), D.controls_sql() + ' AND false')}
      SELECT seq, intent, should_popup, suppressed_reason, cooldown_remaining_seconds, popup_count FROM dec WHERE kind = 'message'""",
    "idle_sessions": f"""{_SESSIONS} SELECT seq, intent, kind, session FROM se
      UNION ALL SELECT seq, intent, kind, NULL FROM allev WHERE chat_id IS NULL AND kind <> 'observe'""",
    "session_totals": f"""{_SESSIONS} SELECT chat_id, intent, session, count(*) AS events, (max(us) - min(us)) // 1000000 AS seconds
      FROM se GROUP BY 1, 2, 3""",
    "states_as_of": f"""{_R}, lg AS (SELECT event_id AS seq, epoch_us(ts) AS us, CASE WHEN user_id % 3 = 0 THEN 'chat_hot' WHEN user_id % 7 = 1 THEN NULL
        ELSE 'chat_' || CAST(user_id % 11 AS VARCHAR) END AS chat_id FROM events),
      kn AS (SELECT *, epoch_us(ts) AS us FROM dec WHERE intent = 'money' AND kind <> 'observe' AND chat_state <> 'untracked'),
      mixed AS (SELECT chat_id, us, seq, 0 AS side, CAST(NULL AS VARCHAR) AS k FROM lg WHERE chat_id IS NOT NULL
        UNION ALL SELECT chat_id, us, seq, 1, concat_ws('/', chat_state, popup_count, suppression_count, last_event_us) FROM kn),
      told AS (SELECT seq, side, last_value(k IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY us, seq, side ROWS UNBOUNDED PRECEDING) AS k FROM mixed)
      SELECT lg.seq, split_part(k, '/', 1) AS chat_state, CAST(split_part(k, '/', 2) AS BIGINT) AS popup_count,
        CAST(split_part(k, '/', 3) AS BIGINT) AS suppression_count, CAST(nullif(split_part(k, '/', 4), '') AS BIGINT) AS last_event_us
      FROM lg LEFT JOIN told ON told.seq = lg.seq AND side = 0""",
    "stored_messages": D.messages_sql(),
    "stored_controls": f"SELECT seq, ts, chat_id, kind, intent, amount FROM ({D.controls_sql()}) c",
    "stored_replies": f"{_R} {_MONEY_ROW}",
    "stored_splits": f"{_DATASET} SELECT id, text, money, alarm, contact, calendar, maps, category, split FROM ds",
    "label_vectors": f"{_DATASET} SELECT id, concat(money, alarm, contact, calendar, maps) AS vector FROM ds",
    "control_answers": f"""{_R} SELECT seq, chat_id, intent, kind, chat_state,
      CASE WHEN kind <> 'reset_cooldown' THEN previous_state END AS previous_state,
      CASE WHEN kind = 'payment_complete' THEN popup_count END AS popup_count_total,
      CASE WHEN kind = 'payment_complete' THEN {D.PARAMS.grace} END AS grace_window_seconds,
      CASE WHEN kind = 'popup_dismissed' THEN {D.PARAMS.dismissed} END AS cooldown_seconds,
      CASE WHEN kind = 'reset_cooldown' THEN existed END AS existed
      FROM dec WHERE kind NOT IN ('message', 'observe') AND (kind <> 'reset_cooldown' OR scoped)""",
    "reset_answers": f"""{_R} SELECT seq, chat_id, coalesce(string_agg(intent, ',' ORDER BY intent) FILTER (existed), '') AS cleared_intents,
      'idle' AS chat_state FROM dec WHERE kind = 'reset_cooldown' AND NOT scoped GROUP BY 1, 2""",
    "flat_replies": f"{_R} {_MONEY_ROW}",
    "nested_replies": f"""{_R} SELECT m.seq, CAST(count(d.seq) AS INT) AS n, coalesce(string_agg(CASE WHEN d.seq IS NOT NULL THEN concat_ws('/', d.intent, '0.99',
        CAST(d.should_popup AS VARCHAR), d.suppressed_reason, d.chat_state, {PAYLOAD_JSON.replace('CASE intent', 'CASE f.intent')}, f.third_party) END, ' ' ORDER BY f.ordinal), '') AS intents
      FROM m LEFT JOIN dec d ON d.seq = m.seq AND d.kind = 'message' LEFT JOIN fi f ON f.seq = d.seq AND f.intent = d.intent GROUP BY m.seq""",
    "chat_snapshot": f"{_R}, {_SNAP} SELECT * FROM snap",
    "chat_states": f"""{_R}, {_SNAP} SELECT u.chat_id, CASE WHEN count(s.intent) = 0 THEN 'idle' END AS state,
      CASE WHEN count(s.intent) = 0 THEN 'no tracker entries — next message will popup for any detected intent' END AS message,
      string_agg(s.intent, ',' ORDER BY s.intent) AS intents, max(s.state) FILTER (s.intent = 'money') AS money_state
      FROM (SELECT DISTINCT 'chat_' || CAST(user_id % 13 AS VARCHAR) AS chat_id FROM events) u LEFT JOIN snap s USING (chat_id) GROUP BY 1""",
    "service_metrics": f"""{_R} SELECT *, round(money_detected / greatest(requests, 1), 4) AS detection_rate,
      round(popups_suppressed / greatest(popups_fired + popups_suppressed, 1), 4) AS suppression_rate
      FROM (SELECT (SELECT count(*) FROM m) AS requests, count(*) FILTER (kind = 'message' AND intent = 'money') AS money_detected,
        count(*) FILTER (kind = 'message' AND chat_state <> 'untracked' AND should_popup) AS popups_fired,
        count(*) FILTER (kind = 'message' AND NOT should_popup) AS popups_suppressed FROM dec) t""",
    "intent_counts": f"""{_F} SELECT i.intent, count(fi.seq) AS detected FROM (SELECT unnest([{', '.join(q(i) for i in INTENTS)}]) AS intent) i
      LEFT JOIN fi USING (intent) GROUP BY 1""",
    "active_trackers": f"{_R}, {_SNAP} SELECT count(*) AS active_chat_trackers FROM snap",
    "mean_latency": "SELECT round(avg(value), 2) AS avg_latency_ms FROM events",
    "windowed_metrics": f"""{_R} SELECT strftime(ts, '%Y-%m-%d') AS window_start, intent, count(*) AS detected,
      count(*) FILTER (should_popup AND chat_state <> 'untracked') AS popups_fired, count(*) FILTER (NOT should_popup) AS popups_suppressed
      FROM dec WHERE kind = 'message' GROUP BY 1, 2""",
    "audience": f"{_AUDIENCE} SELECT * FROM au",
    "popups_per_member": f"""{_AUDIENCE}, n AS (SELECT chat_id, "user", count(*) AS popups FROM au GROUP BY 1, 2)
      SELECT mb.chat_id, mb.usr AS "user", coalesce(popups, 0) AS popups FROM ({_MEMBERS}) mb
      LEFT JOIN n ON n.chat_id = mb.chat_id AND n."user" = mb.usr""",
    "parsed_frames": f"""SELECT seq, CASE WHEN json_valid(value) THEN value ->> '$.text' END AS text, CASE WHEN json_valid(value) THEN value ->> '$.chat_id' END AS chat_id,
      CASE WHEN json_valid(value) THEN value ->> '$.sender' END AS sender, CAST(NULL AS VARCHAR) AS message_id,
      CASE WHEN NOT json_valid(value) THEN 'invalid JSON' WHEN NOT regexp_matches(coalesce(value ->> '$.text', ''), '\\S') THEN 'text required' END AS error
      FROM ({_FRAMES}) f""",
    "frame_responses": f"""{_RESPONSES}
      UNION ALL SELECT seq, CASE WHEN NOT json_valid(value) THEN '{{"error":"invalid JSON"}}' ELSE '{{"error":"text required"}}' END
      FROM ({_FRAMES}) f WHERE NOT json_valid(value) OR NOT regexp_matches(coalesce(value ->> '$.text', ''), '\\S')""",
    "stream_responses": _RESPONSES,
    "stream_decisions": f"{_R} SELECT {_DEC}, false AS late FROM dec",
    "stream_late_decisions": f"""WITH RECURSIVE {replay().replace('FROM allev WHERE chat_id IS NOT NULL)', f'FROM allev WHERE chat_id IS NOT NULL AND NOT ({Q.HELD}))')}
      SELECT {_DEC}, false AS late FROM dec
      UNION ALL SELECT seq, intent, kind, {", ".join(["NULL"] * (len(Q.DECISION) - 3))}, true FROM allev WHERE {Q.HELD}""",
    "live_controls": f"{_R} SELECT {_DEC}, false AS late FROM dec",
    "live_chat_snapshot": f"{_R}, {_SNAP} SELECT * FROM snap",
    "stream_from_history": f"{_R} SELECT {_DEC}, false AS late FROM dec",
    "stream_counters": f"""WITH RECURSIVE {replay().replace('FROM allev WHERE chat_id IS NOT NULL)', f'FROM allev WHERE chat_id IS NOT NULL AND NOT ({Q.HELD}))')},
      mixed AS (SELECT ts, intent, should_popup, chat_state <> 'untracked' AS tracked, false AS late FROM dec WHERE kind = 'message'
        UNION ALL SELECT ts, intent, NULL, NULL, true FROM allev WHERE kind = 'message' AND {Q.HELD})
      SELECT strftime(ts, '%Y-%m-%d') AS window_start, intent, count(*) AS detected, count(*) FILTER (should_popup AND tracked) AS popups_fired,
        count(*) FILTER (NOT should_popup AND tracked) AS popups_suppressed, count(*) FILTER (late) AS late FROM mixed GROUP BY 1, 2""",
    "stream_metrics": f"""{_R} SELECT strftime(ts, '%Y-%m-%d') AS window_start, intent, count(*) AS detected,
      count(*) FILTER (should_popup AND chat_state <> 'untracked') AS popups_fired, count(*) FILTER (NOT should_popup) AS popups_suppressed
      FROM dec WHERE kind = 'message' GROUP BY 1, 2""",
    "eval_summary": f"""WITH {_MULTI}, x AS (SELECT id, label, prob * 0.98 + 0.01 AS p FROM ce)
      SELECT round(avg(ok), 6) AS exact_match, round((SELECT avg(CAST((p >= 0.5) = (label = 1) AS INT)) FROM x), 6) AS hamming,
        round((SELECT avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) FROM x), 6) AS loss, count(*) AS examples
      FROM (SELECT id, min(CAST((p >= 0.5) = (label = 1) AS INT)) AS ok FROM x GROUP BY id) g""",
    "eval_per_intent": f"""WITH {_MULTI}, c AS (SELECT intent, sum(label * pred) AS tp, sum(pred) AS predicted, sum(label) AS support FROM ce GROUP BY 1),
      au AS (SELECT a.intent, avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END) AS auc
        FROM ce a JOIN ce b ON a.intent = b.intent AND a.label = 1 AND b.label = 0 GROUP BY 1)
      SELECT intent, {_PRF}, round(coalesce(auc, 0), 6) AS auc, CAST(support AS BIGINT) AS support FROM c LEFT JOIN au USING (intent)""",
    "label_sets": f"WITH {_MULTI} SELECT id, {_names('labels')} AS true, {_names(_PREDS)} AS predicted FROM mu",
    "hardest_errors": f"""WITH {_MULTI} SELECT id, category, round(gap, 6) AS gap, {_names('labels')} AS true, {_names(_PREDS)} AS predicted
      FROM (SELECT *, CAST(least(abs(probs[1] - 0.5), abs(probs[2] - 0.5)) AS DOUBLE) AS gap FROM mu WHERE {_PREDS} <> labels) e ORDER BY gap, id LIMIT 15""",
    "confusion_matrix": f"""WITH {_MULTI} SELECT l AS label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1
      FROM (SELECT unnest([0, 1]) AS l) g LEFT JOIN ce ON label = l AND intent = 'quality' GROUP BY 1""",
    "class_report": f"""WITH {_MULTI}, b AS (SELECT * FROM ce WHERE intent = 'quality'),
      c AS (SELECT CAST(k AS VARCHAR) AS class, count(*) FILTER (label = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS predicted,
        count(*) FILTER (label = k) AS support FROM b, (SELECT unnest([0, 1]) AS k) g GROUP BY 1),
      r AS (SELECT class, tp / predicted AS precision, tp / support AS recall, 2 * tp / (predicted + support) AS f1, support FROM c)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
      UNION ALL SELECT 'accuracy', round(avg(CAST(label = pred AS INT)), 6), round(avg(CAST(label = pred AS INT)), 6),
        round(avg(CAST(label = pred AS INT)), 6), count(*) FROM b""",
    "binary_loss": f"""WITH {_MULTI} SELECT round(avg(CASE WHEN label = 1 THEN -ln(prob * 0.98 + 0.01) ELSE -ln(1 - (prob * 0.98 + 0.01)) END), 6) AS loss,
      round(avg(CAST(label = pred AS INT)), 6) AS accuracy FROM ce WHERE intent = 'quality'""",
    "best_candidates": """WITH h AS (SELECT CAST(left(o_orderpriority, 1) AS INT) AS candidate,
        round(avg(CAST(o_totalprice > 200000 AS INT)), 2) AS val_hamming FROM orders GROUP BY 1)
      SELECT * FROM (SELECT *, 'first' AS rule FROM h ORDER BY val_hamming DESC, candidate LIMIT 1) a
      UNION ALL SELECT * FROM (SELECT *, 'last' AS rule FROM h ORDER BY val_hamming DESC, candidate DESC LIMIT 1) b""",
    "quotas": f"WITH {_QUOTAS} SELECT category, templates, quota FROM qu",
    "drawn_templates": f"WITH {_DRAWN} SELECT id, category, template FROM dt",
    "filled_templates": f"""WITH {_TEMPLATES}, ti AS (SELECT category || '#' || CAST(idx AS VARCHAR) AS id, template FROM te)
      {_filled('ti', 'id')}""",
    "augmented_messages": _augmented(ACCEPTED, "text", "seq", "seq"),
    "exact_split": _split("SELECT doc_id AS id FROM documents", "id", "id"),
    "shuffled_documents": f"SELECT doc_id AS id, md5('{Q.SEED}|' || CAST(doc_id AS VARCHAR)) AS order_key FROM documents",
    "quick_split_sizes": f"""SELECT CASE WHEN u < 0.80 THEN 'train' WHEN u < 0.90 THEN 'val' ELSE 'test' END AS split, count(*) AS examples
      FROM (SELECT {_draw(Q.SEED, 'seq', 'split')} / 4294967296.0 AS u FROM ({ACCEPTED}) x) t GROUP BY 1""",
    "dataset": f"{_DATASET} SELECT id, text, money, alarm, contact, calendar, maps, category, split FROM ds",
    "dataset_labels": f"""{_DATASET}, w AS (SELECT sum(money) AS money, sum(alarm) AS alarm, count(*) FILTER (money + alarm = 0) AS none,
        count(*) FILTER (money + alarm >= 2) AS multi FROM ds)
      SELECT label, CAST(examples AS BIGINT) AS examples FROM (SELECT unnest(['money', 'alarm', 'contact', 'calendar', 'maps', 'none', 'multi_intent']) AS label,
        unnest([money, alarm, 0, 0, 0, none, multi]) AS examples FROM w) t""",
    "dataset_categories": f"{_DATASET} SELECT category, count(*) AS examples FROM ds GROUP BY 1",
    "dataset_splits": f"{_DATASET} SELECT split, count(*) AS examples FROM ds GROUP BY 1",
    "action_cards": f"""{_F} SELECT seq, chat_id, intent, CASE intent WHEN 'money' THEN 1 WHEN 'alarm' THEN 2 WHEN 'calendar' THEN 3
        WHEN 'contact' THEN 4 WHEN 'maps' THEN 5 END AS priority, '99%' AS confidence,
      {_esc(_TITLE)} AS title, {_esc(_SUB)} AS subtitle, {_LINK} AS link FROM fi""",
    "call_summaries": f"""{_F}, s AS (SELECT m.chat_id, (SELECT count(*) FROM fi WHERE fi.chat_id IS NOT DISTINCT FROM m.chat_id) AS actions,
        count(*) AS messages, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS duration_seconds FROM m GROUP BY 1),
      t AS (SELECT *, CAST(duration_seconds // 60 AS VARCHAR) || ':' || lpad(CAST(duration_seconds % 60 AS VARCHAR), 2, '0') AS duration FROM s)
      SELECT *, actions || ' action' || CASE WHEN actions = 1 THEN '' ELSE 's' END || ' to follow up on' AS title,
        messages || ' message' || CASE WHEN messages = 1 THEN '' ELSE 's' END || ' · ' || duration || ' duration' AS stats FROM t""",
}

ORACLE |= {
    "stream_control_answers": ORACLE["control_answers"], "stream_reset_answers": ORACLE["reset_answers"],
    "stored_nested_replies": ORACLE["nested_replies"], "array_splits": f"{_DATASET} SELECT text, money, alarm, contact, calendar, maps, category, split FROM ds",
    "stored_report": f"""WITH {_MULTI}, c AS (SELECT intent, sum(label * pred) AS tp, sum(pred) AS predicted, sum(label) AS support FROM ce GROUP BY 1),
      pr AS (SELECT intent, {_PRF}, CAST(support AS BIGINT) AS support FROM c),
      su AS (SELECT round(avg(ok), 6) AS exact, round((SELECT avg(CAST((prob >= 0.5) = (label = 1) AS INT)) FROM ce), 6) AS hamming
        FROM (SELECT id, min(CAST((prob >= 0.5) = (label = 1) AS INT)) AS ok FROM ce GROUP BY id) g)
      SELECT exact AS test_accuracy, exact AS test_exact_match, hamming AS test_hamming, q.precision AS money_precision, q.recall AS money_recall, q.f1 AS money_f1,
        t.precision AS alarm_precision, t.recall AS alarm_recall, t.f1 AS alarm_f1, t.support AS alarm_support, true AS maps_untold
      FROM su, (SELECT * FROM pr WHERE intent = 'quality') q, (SELECT * FROM pr WHERE intent = 'toxic') t""",
}


def gradient_sql(slots: int = 64, steps: int = 8, rate: float = 4.0) -> str:
    """The gradient steps of the five heads, one CTE per step."""
    label = "UNION ALL".join(
        f" SELECT seq, '{i}' AS intent, CAST({has_any('lower(text)', V.INTENT_KEYWORDS[i])} AS INT) AS y FROM m " for i in INTENTS)
    ctes = [
        f"m AS MATERIALIZED ({ACCEPTED})",
        """crc AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
          FROM range(256) r(i))""",
        "words AS (SELECT seq, unnest(regexp_extract_all(lower(text), '[a-z0-9$'']+')) AS w FROM m)",
        f"""hashed AS (SELECT w, xor(list_reduce(list_transform(range(0, length(hex(w)) // 2), lambda k: CAST('0x' || substr(hex(w), 2 * k + 1, 2) AS BIGINT)),
          lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % {slots} AS slot FROM (SELECT DISTINCT w FROM words) d, crc)""",
        f"x AS MATERIALIZED (SELECT DISTINCT seq, slot FROM words JOIN hashed USING (w) UNION ALL SELECT seq, {slots} FROM m)",
        f"y AS MATERIALIZED ({label})",
        "n AS (SELECT count(*) AS n FROM m WHERE seq % 5 <> 0)",
        "w0 AS (SELECT intent, slot, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT intent FROM y) i, (SELECT DISTINCT slot FROM x) s)",
    ]
    score = "SELECT seq, intent, 1 / (1 + exp(-sum(w))) AS p FROM x JOIN w{} USING (slot) GROUP BY 1, 2"
    for k in range(steps):
        ctes.append(f"""w{k + 1} AS MATERIALIZED (SELECT w{k}.intent, w{k}.slot, w - {rate} * coalesce(g, 0) / (SELECT n FROM n) AS w FROM w{k} LEFT JOIN (
          SELECT intent, slot, sum(p - y) AS g FROM ({score.format(k)}) s JOIN y USING (seq, intent) JOIN x USING (seq) WHERE seq % 5 <> 0 GROUP BY 1, 2
        ) g ON g.intent = w{k}.intent AND g.slot = w{k}.slot)""")
    told = ", ".join(f"round(max(p) FILTER (intent = '{i}'), 6) AS {i}" for i in INTENTS)
    return f"WITH {', '.join(ctes)} SELECT seq, {told} FROM ({score.format(steps)}) s WHERE seq % 5 = 0 GROUP BY seq"


ORACLE["gradient_scorer"] = gradient_sql()
