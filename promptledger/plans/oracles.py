"""The registered queries once more, as SQL over the plain tables.

The texts share nothing with the Spark code but constants: where Spark works on
arrays inside a row, these work on one row per message or match.
"""

from __future__ import annotations

from ..functions.catalogue import (
    DEFAULT_DETECTORS, ENTITIES, GENERIC, HIGH, JAILBREAKS, PERSONAL, SECRET, Detector,
)
from ..functions.prices import DEFAULT_PRICES
from ..operators.shrink import BREVITY_PROMPT
from .policies import (
    ARG_RULES, COMPETITORS, EVENT_BUDGET, POLICY_ROWS, RATE_LIMITS, TOOL_POLICIES, WHAT_IF_BUDGETS,
)
from .views import HISTORY_SQL, PLANTED_SQL, REQUESTS_SQL, sql_text


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_lit(v) for v in value) + "]::VARCHAR[]"
    if isinstance(value, str):
        return sql_text(value)
    return str(value)


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _with(*ctes: str, final: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + final


def words(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"


def estimate(text: str) -> str:
    return f"greatest(1, ({words(text)} * 13) // 10)"


def not_blank(text: str) -> str:
    return rf"regexp_matches({text}, '[^\s]')"


# --- prices -------------------------------------------------------------------

PRICES = _values(
    "prices", "pm, ord, rin, rout",
    [(p.model, p.ordinal, int(p.in_per_1k * 10**9), int(p.out_per_1k * 10**9)) for p in DEFAULT_PRICES],
)


def micros(tin: str, tout: str, rin: str = "rin", rout: str = "rout") -> str:
    return f"(({tin}) * {rin} + ({tout}) * {rout} + 500000) // 1000000"


def dollars(micro: str) -> str:
    return f"CAST(CAST({micro} AS BIGINT) / 1000000.0 AS DOUBLE)"


# --- spans --------------------------------------------------------------------


def _re2(d: Detector) -> str:
    pattern = d.pattern
    if d.detector == "upi_id":
        # No lookahead here: match the forbidden tail too and drop such matches.
        pattern = pattern.replace(r"(?!\.\w)", r"(?:\.\w)?")
    return ("(?i)" if d.ignore_case else "") + pattern


def spans(name: str, source: str, key: str, text: str, detectors=DEFAULT_DETECTORS) -> list[str]:
    """CTEs ending in ``name``: key, ord, entity, detector, tier, confidence, hit, s, e."""
    parts = []
    for n, d in enumerate(detectors):
        pat = sql_text(_re2(d))
        parts.append(
            f"SELECT {key}, {n} AS ord, {sql_text(d.entity)} AS entity, {sql_text(d.detector)} AS detector,"
            f" {sql_text(d.tier)} AS tier, CAST({d.confidence} AS DOUBLE) AS confidence,"
            f" regexp_extract_all({text}, {pat}) AS hits, regexp_split_to_array({text}, {pat}) AS gaps"
            f" FROM {source} WHERE regexp_matches({text}, {pat})"
        )
    raw = f"{name}_raw AS ({' UNION ALL '.join(parts)})"
    each = f"{name}_each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_raw)"
    placed = (
        f"{name}_placed AS (SELECT {key}, ord, entity, detector, tier, confidence, hits[i] AS hit,"
        " CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))"
        " + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS s"
        f" FROM {name}_each)"
    )
    ends = (
        f"{name}_all AS (SELECT *, s + length(hit) AS e FROM {name}_placed"
        r" WHERE NOT (detector = 'upi_id' AND regexp_matches(hit, '@[A-Za-z0-9]+\.\w$')))"
    )
    kept = (
        f"{name} AS (SELECT * FROM {name}_all g WHERE NOT (g.tier = '{GENERIC}' AND EXISTS"
        f" (SELECT 1 FROM {name}_all h WHERE h.{key} = g.{key} AND h.tier = '{HIGH}' AND g.s < h.e AND g.e > h.s)))"
    )
    return [raw, each, placed, ends, kept]


# Secrets come first, then the other entities in their canonical order.
RANK = (
    "CASE WHEN entity = 'secret' THEN -1 ELSE list_position("
    + _lit(list(ENTITIES)) + ", entity) END"
)


def redacted(name: str, found: str, source: str, key: str, text: str) -> list[str]:
    """CTEs ending in ``name``: key, redacted - overlapping findings in one placeholder."""
    return [
        f"{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rank, ord, s) AS pick FROM {found})",
        f"{name}_b AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, s - e, pick"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_a)",
        f"{name}_c AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END)"
        f" OVER (PARTITION BY {key} ORDER BY s, s - e, pick) AS grp FROM {name}_b)",
        f"{name}_d AS (SELECT {key}, grp, min(s) AS s, max(e) AS e,"
        f" arg_min(entity, (s - e) * 1000000000 + s * 1000 + pick) AS entity FROM {name}_c GROUP BY {key}, grp)",
        f"{name}_e AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS p FROM {name}_d)",
        f"{name} AS (SELECT t.{key}, string_agg(substr(t.{text}, p + 1, s - p) || '[' || upper(entity) || '_REDACTED]', ''"
        f" ORDER BY s) || substr(min(t.{text}), max(e) + 1) AS redacted FROM {name}_e d JOIN {source} t ON t.{key} = d.{key}"
        f" GROUP BY t.{key})",
    ]


def jailbreak_case(text: str, value: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, {sql_text('(?i)' + p.pattern)}) THEN "
        + sql_text(p.category if value == "category" else p.pattern)
        for p in JAILBREAKS
    )
    return f"CASE {whens} END"


# --- requests under their policies ----------------------------------------------

POLICY = _values("policies", "agent_id, pprovider, pmodel, entities, action, budget, max_tokens, max_history, terse", POLICY_ROWS)

ROUTED = (
    "routed AS (SELECT r.*, p.* EXCLUDE (agent_id),"
    " coalesce(lower(r.provider), p.pprovider) AS provider2,"
    " coalesce(r.model, p.pmodel, CASE coalesce(lower(r.provider), p.pprovider) WHEN 'openai' THEN 'gpt-4o-mini'"
    " WHEN 'gemini' THEN 'gemini-2.0-flash' WHEN 'anthropic' THEN 'claude-3-5-haiku-latest' END) AS model2"
    " FROM requests r JOIN policies p ON p.agent_id = r.agent_id)"
)

PRICED = (
    "priced AS (SELECT m.model2, coalesce(max(pm) FILTER (WHERE best), 'gpt-4o-mini') AS pm FROM"
    " (SELECT d.model2, pm, row_number() OVER (PARTITION BY d.model2 ORDER BY length(pm) DESC) = 1 AND pm IS NOT NULL AS best"
    " FROM (SELECT DISTINCT model2 FROM routed) d LEFT JOIN prices ON starts_with(d.model2, pm)) m GROUP BY m.model2),"
    " priced2 AS (SELECT model2, p.* FROM priced JOIN prices p USING (pm))"
)

TOKENS0 = (
    f"tokens0 AS (SELECT request_id, CAST(sum({estimate('role')} + {estimate('content')} + 4) + 2 AS BIGINT) AS original,"
    " count(*) AS n_messages FROM msgs GROUP BY request_id)"
)

STEP1 = f"s1 AS (SELECT * FROM msgs WHERE {not_blank('content')})"

STEP2 = (
    "sys2 AS (SELECT request_id, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS merged"
    " FROM s1 WHERE role = 'system' GROUP BY request_id),"
    " s2 AS (SELECT s1.* FROM s1 LEFT JOIN sys2 USING (request_id) WHERE coalesce(n, 0) <= 1 OR role <> 'system'"
    " UNION ALL SELECT request_id, -1, 'system', merged FROM sys2 WHERE n > 1)"
)


def tidy(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g')"


STEP3 = f"s3 AS (SELECT request_id, pos, role, content AS loose, {tidy('content')} AS content FROM s2)"

STEP4 = (
    "s4a AS (SELECT s3.*, max_history, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS others,"
    " row_number() OVER (PARTITION BY request_id, role <> 'system' ORDER BY pos DESC) AS back FROM s3 JOIN routed USING (request_id)),"
    " s4 AS (SELECT request_id, CASE WHEN others > max_history AND role = 'system' THEN pos - 100000 ELSE pos END AS pos, role, content,"
    " others > max_history AS trimmed FROM s4a WHERE max_history IS NULL OR others <= max_history OR role = 'system' OR back <= max_history)"
)

STEP5 = (
    "first_sys AS (SELECT request_id, min(pos) AS pos FROM s4 WHERE role = 'system' GROUP BY request_id),"
    " s5 AS (SELECT s4.request_id, s4.pos, s4.role, s4.content || CASE WHEN terse AND f.pos = s4.pos AND s4.role = 'system'"
    f" THEN chr(10) || chr(10) || {sql_text(BREVITY_PROMPT)} ELSE '' END AS content"
    " FROM s4 JOIN routed USING (request_id) LEFT JOIN first_sys f ON f.request_id = s4.request_id"
    f" UNION ALL SELECT request_id, -200000, 'system', {sql_text(BREVITY_PROMPT)} FROM routed"
    " WHERE terse AND request_id NOT IN (SELECT request_id FROM first_sys))"
)

TOKENS5 = (
    f"tokens5 AS (SELECT request_id, CAST(sum({estimate('role')} + {estimate('content')} + 4) + 2 AS BIGINT) AS tokens FROM s5 GROUP BY request_id)"
)

FLAGS = (
    "act AS (SELECT r.request_id,"
    " (SELECT count(*) FROM msgs m WHERE m.request_id = r.request_id) > (SELECT count(*) FROM s1 m WHERE m.request_id = r.request_id) AS a1,"
    " coalesce((SELECT n FROM sys2 m WHERE m.request_id = r.request_id), 0) > 1 AS a2,"
    " coalesce((SELECT bool_or(loose <> content) FROM s3 m WHERE m.request_id = r.request_id), FALSE) AS a3,"
    " coalesce((SELECT bool_or(trimmed) FROM s4 m WHERE m.request_id = r.request_id), FALSE) AS a4, r.terse AS a5 FROM routed r),"
    " acts AS (SELECT request_id, concat_ws(',', CASE WHEN a1 THEN 'remove_empty_messages' END,"
    " CASE WHEN a2 THEN 'deduplicate_system_prompts' END, CASE WHEN a3 THEN 'whitespace_normalization' END,"
    " CASE WHEN a4 THEN 'history_trim' END, CASE WHEN a5 THEN 'terse_mode_enabled' END) AS actions FROM act)"
)

SHRINK = [REQUESTS_SQL, POLICY, ROUTED, PRICES, PRICED, TOKENS0, STEP1, STEP2, STEP3, STEP4, STEP5, TOKENS5, FLAGS]

SHRUNK = (
    "shrunk AS (SELECT r.*, original, n_messages, tokens, original - tokens AS saved, actions, pm, rin, rout,"
    f" CASE WHEN original > tokens THEN {micros('original - tokens', '0')} ELSE 0 END AS saved_micros,"
    " (CASE WHEN original > 4000 THEN 1 ELSE 0 END) + (CASE WHEN max_history IS NULL AND n_messages > 10 THEN 1 ELSE 0 END) AS advice"
    " FROM routed r JOIN tokens0 USING (request_id) JOIN tokens5 USING (request_id) JOIN acts USING (request_id)"
    " JOIN priced2 USING (model2))"
)

TEXTS = (
    f"texts AS (SELECT request_id, string_agg(content, chr(10) ORDER BY pos) AS body FROM s5 WHERE {not_blank('content')} GROUP BY request_id)"
)

# Violations of the text: jailbreak first, then findings of the enabled entities.
GUARD = [
    f"jb AS (SELECT request_id, {jailbreak_case('body', 'category')} AS category FROM texts)",
    *spans("fi", "texts", "request_id", "body"),
    "found AS (SELECT f.*, r.action, r.entities, CASE WHEN entity = 'secret' THEN -1 WHEN len(r.entities) = 0 THEN list_position("
    + _lit(list(ENTITIES)) + ", entity) ELSE list_position(r.entities, entity) END AS rank FROM fi f JOIN routed r USING (request_id)"
    " WHERE len(r.entities) = 0 OR list_contains(r.entities, entity))",
    "iv AS (SELECT request_id, -2 AS rank, 0 AS ord, 0 AS s, 'jailbreak' AS type, 'critical' AS severity, 'blocked' AS act,"
    " 'Jailbreak pattern detected (' || category || ')' AS detail FROM jb WHERE category IS NOT NULL"
    " UNION ALL SELECT request_id, rank, ord, s, CASE WHEN entity = 'secret' THEN 'secret' ELSE 'pii' END,"
    " CASE WHEN entity <> 'secret' THEN 'high' WHEN confidence < 0.9 THEN 'medium' ELSE 'critical' END,"
    " CASE action WHEN 'block' THEN 'blocked' WHEN 'flag' THEN 'flagged' ELSE 'redacted' END,"
    " 'Detected ' || entity || ' in input' FROM found)",
]

ANSWERS = [
    *spans("fo", "requests", "request_id", "answer"),
    f"ov AS (SELECT request_id, {RANK} + 100 AS rank, ord, s, CASE WHEN entity = 'secret' THEN 'secret' ELSE 'output_pii' END AS type,"
    " CASE WHEN entity = 'secret' THEN 'critical' ELSE 'high' END AS severity, 'flagged' AS act,"
    " 'Detected ' || entity || ' in model output' AS detail FROM fo)",
]

SCORED = (
    "scored AS (SELECT s.*, coalesce(tokens > max_tokens, FALSE) AS over_limit,"
    " NOT coalesce(tokens > max_tokens, FALSE) AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.request_id = s.request_id AND act = 'blocked') AS passed,"
    f" coalesce(answer_tokens, {estimate('answer')}) AS out_tokens,"
    f" {micros('tokens', '0')} AS est, {micros('tokens', 'coalesce(answer_tokens, ' + estimate('answer') + ')')} AS full_micros,"
    " CAST(CAST(budget AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS budget_micros, epoch // 86400 AS day FROM shrunk s)"
)


def ledger(name: str, source: str, key: str) -> str:
    """Recursive fold over rows (key, rn, est, cost, budget): adds before, over."""
    return (
        f"{name}(k, rn, before, spend, over) AS (SELECT {key}, 0::BIGINT, 0::BIGINT, 0::BIGINT, FALSE FROM {source} GROUP BY 1"
        f" UNION ALL SELECT l.k, s.rn, l.spend, l.spend + CASE WHEN l.spend + s.est > s.budget THEN 0 ELSE s.cost END,"
        f" l.spend + s.est > s.budget FROM {name} l JOIN {source} s ON s.{key} = l.k AND s.rn = l.rn + 1)"
    )


FOLDED = [
    "foldrows AS (SELECT request_id, day, row_number() OVER (PARTITION BY day ORDER BY epoch, request_id) AS rn, est,"
    " CASE WHEN passed THEN full_micros ELSE 0 END AS cost, budget_micros AS budget FROM scored)",
    ledger("ledger", "foldrows", "day"),
    "decided AS (SELECT f.request_id, l.before, l.over FROM foldrows f JOIN ledger l ON l.k = f.day AND l.rn = f.rn)",
]

# One row per governed request, and one per surviving violation.
GOVERNED = [
    "gov AS (SELECT s.*, before, over, over_limit OR over AS limited, over_limit OR over OR NOT passed AS blocked FROM scored s JOIN decided USING (request_id))",
    "lv AS (SELECT request_id, -4 AS rank, 0 AS ord, 0 AS s, 'token_limit' AS type, 'high' AS severity, 'blocked' AS act,"
    " 'Input tokens (' || tokens || ') exceed limit (' || max_tokens || ')' AS detail FROM gov WHERE over_limit"
    " UNION ALL SELECT request_id, -3, 0, 0, 'budget_exceeded', 'critical', 'blocked',"
    " printf('Daily budget of $%.2f exceeded. Current spend: $%.2f.', budget_micros / 1000000.0, before / 1000000.0) FROM gov WHERE over)",
    "viol AS (SELECT lv.* FROM lv UNION ALL SELECT iv.* FROM iv JOIN gov USING (request_id) WHERE NOT limited AND (gov.blocked OR act = 'flagged')"
    " UNION ALL SELECT ov.* FROM ov JOIN gov USING (request_id) WHERE NOT gov.blocked)",
    "vagg AS (SELECT request_id, string_agg(type || '/' || severity || '/' || act, ',' ORDER BY rank, ord, s) AS vs,"
    " string_agg(detail, '; ' ORDER BY rank, ord, s) AS details, arg_min(type, rank * 1000000 + ord * 10000 + s) AS first_type,"
    " count(*) AS n FROM viol GROUP BY request_id)",
    "final AS (SELECT g.*, CASE WHEN g.blocked THEN 0 ELSE out_tokens END AS out2, CASE WHEN g.blocked THEN 0 ELSE full_micros END AS cost2,"
    " coalesce(vs, '') AS vs, details, first_type FROM gov g LEFT JOIN vagg USING (request_id))",
]

GOVERN = [*SHRINK, SHRUNK, TEXTS, *GUARD, *ANSWERS, SCORED, *FOLDED, *GOVERNED]


def governed(final: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*GOVERN, *more]) + " " + final


def shrink(final: str, *more: str) -> str:
    return _with(*SHRINK, SHRUNK, *more, final=final)


LINE = "string_agg(role || ': ' || content, ' | ' ORDER BY pos)"
D = "CAST({} AS DOUBLE)"
EV = (
    "gate AS (SELECT event_id, ts, user_id, value, CAST(ts AS DATE) AS day, CAST(round(value * 1000) AS BIGINT) AS cost,"
    " CAST(round(value * 1000) AS BIGINT) // 2 AS est FROM events)"
)


def event_ledger(key: str, budget: str, final: str, where: str = "TRUE") -> str:
    return (
        f"WITH RECURSIVE {EV}, foldrows AS (SELECT event_id, {key} AS k0, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn,"
        f" est, cost, CAST(CAST({sql_text(budget)} AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS budget FROM gate WHERE {where}), "
        + ledger("ledger", "foldrows", "k0")
        + f" {final}"
    )


EVENT_DECISIONS = (
    "SELECT f.event_id, CAST(l.before / 1000000.0 AS DOUBLE) AS spend_before, l.over AS over_budget"
    " FROM foldrows f JOIN ledger l ON l.k = f.k0 AND l.rn = f.rn"
)


def findings(final: str, *more: str, detectors=DEFAULT_DETECTORS) -> str:
    return _with(PLANTED_SQL, *spans("f", "planted", "doc_id", "text", detectors), *more, final=final)


AGENT_CALLS_SQL = (
    "calls AS (SELECT event_id, ts, user_id, event_type AS tool, props ->> '$.k' AS v,"
    " CASE user_id % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'research' ELSE 'default' END AS agent_id,"
    " lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last FROM events)"
)

# What a page shows: skipped elements and comments gone, tags to blanks, entities read.
PAGE_TEXT = "html"
for _tag in ("script", "style", "nav", "noscript", "template", "svg"):
    PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '<{_tag}[ >].*?</{_tag}>', ' ', 'gs')"
PAGE_TEXT = f"regexp_replace(regexp_replace({PAGE_TEXT}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '&(copy|middot|nbsp|mdash|ndash);', ' ', 'g')"
PAGE_TEXT = f"replace(replace(replace(replace({PAGE_TEXT}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _first_type(kind: str) -> str:
    if kind == "pii":
        return findings(
            "SELECT p.doc_id, x.doc_id IS NOT NULL AS blocked, coalesce(upper(x.entity), 'NONE') AS type,"
            " CASE WHEN x.doc_id IS NULL THEN 'NONE' ELSE 'HIGH' END AS severity FROM planted p LEFT JOIN"
            f" (SELECT doc_id, arg_min(entity, {RANK}) AS entity FROM f GROUP BY doc_id) x USING (doc_id)",
            detectors=PERSONAL,
        )
    secrets = tuple(d for d in DEFAULT_DETECTORS if d.entity == SECRET)
    return findings(
        "SELECT p.doc_id, x.doc_id IS NOT NULL AS blocked, CASE WHEN x.doc_id IS NULL THEN 'NONE' ELSE 'SECRET_KEY' END AS type,"
        " CASE WHEN x.doc_id IS NULL THEN 'NONE' WHEN confidence >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM planted p"
        " LEFT JOIN (SELECT doc_id, arg_min(confidence, ord * 1000000 + s) AS confidence FROM f GROUP BY doc_id) x USING (doc_id)",
        detectors=secrets,
    )


_EVENTS_LOG = (
    "log AS (SELECT request_id, CASE WHEN blocked THEN 'blocked' ELSE 'allowed' END AS event, epoch, agent_id, session_id, vs,"
    " tokens AS input_tokens, out2 AS output_tokens, cost2 AS cost, original, saved FROM final"
    " UNION ALL SELECT request_id, 'optimizer_guidance', epoch, agent_id, session_id, '', NULL, NULL, NULL, NULL, NULL"
    " FROM final, unnest(range(advice)))"
)

_LOOPS = r"""
prompts AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w
  FROM loop_turns),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM prompts),
sims AS (SELECT *, coalesce(CAST(len(list_intersect(w, p)) AS DOUBLE) / len(list_distinct(list_concat(w, p))) >= 0.9, FALSE) AS sim FROM pairs),
grp AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM sims),
brk AS (SELECT *, max(CASE WHEN NOT sim THEN n END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM grp)
"""

LOOP_TURNS_SQL = (
    "loop_turns AS (SELECT conv_id, turn * 10 + r AS turn, text || CASE WHEN r = 0 THEN '' ELSE ' again' END AS text"
    " FROM conversations, unnest(range(6)) AS t(r) WHERE role = 'user' AND (r = 0 OR conv_id % 4 = 0))"
)

ORACLES: dict[str, str] = {
    # sources
    "conversation_requests": _with(
        REQUESTS_SQL,
        final="SELECT m.request_id, count(*) AS n_messages, md5(" + LINE + ") AS digest,"
        " CAST(length(min(r.answer)) AS BIGINT) AS answer_length"
        " FROM msgs m JOIN requests r USING (request_id) GROUP BY m.request_id",
    ),
    "request_messages": _with(
        REQUESTS_SQL,
        final="SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS pos, role, content FROM msgs",
    ),
    "document_requests": "SELECT doc_id, 1 AS n_messages, 'user' AS role, md5(text) AS digest,"
    f" CAST(1 + {estimate('text')} + 6 AS BIGINT) AS tokens FROM documents",
    "batch_rows_system_split": _with(
        REQUESTS_SQL,
        "turns2 AS (SELECT request_id, pos, role, content FROM msgs WHERE role IN ('user', 'assistant')"
        " UNION ALL SELECT request_id, -1, 'user', '(context)' FROM msgs WHERE role IN ('user', 'assistant')"
        " GROUP BY request_id HAVING arg_min(role, pos) <> 'user'"
        " UNION ALL SELECT request_id, 0, 'user', '' FROM requests WHERE request_id NOT IN"
        " (SELECT request_id FROM msgs WHERE role IN ('user', 'assistant')))",
        f"sys AS (SELECT request_id, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS system FROM msgs WHERE role = 'system' AND {not_blank('content')} GROUP BY request_id)",
        final="SELECT t.request_id, min(system) AS system, count(*) AS n_turns, md5(" + LINE + ") AS digest"
        " FROM turns2 t LEFT JOIN sys USING (request_id) GROUP BY t.request_id",
    ),
    "batch_rows_role_model": _with(
        REQUESTS_SQL,
        "turns2 AS (SELECT request_id, pos, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, content FROM msgs"
        " WHERE role IN ('user', 'assistant') AND content <> ''"
        " UNION ALL SELECT request_id, 0, 'user', '' FROM requests WHERE request_id NOT IN"
        " (SELECT request_id FROM msgs WHERE role IN ('user', 'assistant') AND content <> ''))",
        "sys AS (SELECT request_id, string_agg(content, chr(10) ORDER BY pos) AS system FROM msgs WHERE role = 'system' AND content <> '' GROUP BY request_id)",
        final="SELECT t.request_id, min(system) AS system, count(*) AS n_turns, md5(" + LINE + ") AS digest"
        " FROM turns2 t LEFT JOIN sys USING (request_id) GROUP BY t.request_id",
    ),
    "recent_log_days": _with(
        HISTORY_SQL,
        final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CASE WHEN blocked THEN 'blocked' ELSE 'allowed' END AS event,"
        " count(*) AS n FROM history WHERE CAST(timestamp AS DATE) IN (SELECT DISTINCT CAST(timestamp AS DATE) AS d FROM history"
        " ORDER BY d DESC LIMIT 7) GROUP BY ALL",
    ),
    "history_log_day": _with(
        HISTORY_SQL,
        final="SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, tool, CAST(cost_usd AS DOUBLE) AS cost_usd, tokens, blocked, block_reason"
        " FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-05'",
    ),
    # tokens and prices
    "word_estimates": f"SELECT doc_id, CAST({estimate('text')} AS BIGINT) AS tokens FROM documents",
    "token_counts": "SELECT lang, source, CAST(sum(CASE WHEN doc_id % 50 = 0 THEN 0 ELSE "
    f"{estimate('text')} END) AS BIGINT) AS tokens FROM documents GROUP BY lang, source",
    "request_tokens": _with(REQUESTS_SQL, TOKENS0, final="SELECT request_id, original AS tokens FROM tokens0"),
    "tokenized_requests": _with(
        REQUESTS_SQL, POLICY, ROUTED,
        "counted AS (SELECT m.request_id, "
        f"{estimate('role')} + 4 + CASE WHEN content IS NULL THEN 0 WHEN regexp_matches(lower(model2), 'gemini|claude|anthropic|llama|mistral')"
        f" THEN {estimate('content')} WHEN content = '' THEN 1 ELSE (length(content) + 3) // 4 END AS n FROM msgs m JOIN routed USING (request_id))",
        final="SELECT request_id, CAST(sum(n) + 2 AS BIGINT) AS tokens FROM counted GROUP BY request_id",
    ),
    "request_text": _with(
        REQUESTS_SQL,
        final=f"SELECT request_id, md5(string_agg(content, chr(10) ORDER BY pos)) AS digest FROM msgs WHERE {not_blank('content')} GROUP BY request_id",
    ),
    "model_prices": _with(
        REQUESTS_SQL, POLICY, ROUTED, PRICES, PRICED,
        final="SELECT request_id, model2 AS model, p.pm AS price_model,"
        " coalesce((SELECT arg_min(q.pm, q.ord + CASE WHEN q.pm = r.model2 THEN -1000 ELSE 0 END) FROM prices q WHERE starts_with(r.model2, q.pm)), 'gpt-4o-mini') AS first_model"
        " FROM routed r JOIN priced2 p USING (model2)",
    ),
    "request_costs": _with(
        REQUESTS_SQL, POLICY, ROUTED, PRICES, PRICED, TOKENS0,
        final=f"SELECT request_id, {dollars(micros('original', estimate('answer')))} AS cost"
        " FROM routed JOIN priced2 USING (model2) JOIN tokens0 USING (request_id)",
    ),
    "resolved_models": _with(
        REQUESTS_SQL, POLICY, ROUTED, final="SELECT request_id, provider2 AS provider, model2 AS model FROM routed"
    ),
    "model_costs": _with(
        REQUESTS_SQL, PRICES, TOKENS0,
        final=f"SELECT pm AS model, count(*) AS requests, {dollars('sum(' + micros('original', estimate('answer')) + ')')} AS total_cost"
        " FROM requests JOIN tokens0 USING (request_id), prices GROUP BY pm",
    ),
    "supplier_model_costs": _with(
        REQUESTS_SQL, TOKENS0, "offered AS (SELECT 'model-' || s_suppkey AS pm, s_suppkey * 10000 AS rin, s_suppkey * 30000 AS rout FROM supplier)",
        final=f"SELECT pm AS model, count(*) AS requests, {dollars('sum(' + micros('original', estimate('answer')) + ')')} AS total_cost"
        " FROM requests JOIN tokens0 USING (request_id), offered GROUP BY pm",
    ),
    # shrinking
    "non_empty_messages": _with(
        REQUESTS_SQL, STEP1, final=f"SELECT request_id, count(*) AS n_messages, md5({LINE}) AS digest FROM s1 GROUP BY request_id"
    ),
    "merged_system_prompts": _with(
        REQUESTS_SQL, STEP1, STEP2, final=f"SELECT request_id, count(*) AS n_messages, md5({LINE}) AS digest FROM s2 GROUP BY request_id"
    ),
    "normalized_whitespace": "SELECT doc_id, md5(" + tidy("text || chr(10) || chr(10) || chr(10) || text || '  '") + ") AS digest FROM documents",
    "trimmed_history": _with(
        REQUESTS_SQL,
        "ranked AS (SELECT *, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS others,"
        " row_number() OVER (PARTITION BY request_id, role <> 'system' ORDER BY pos DESC) AS back FROM msgs)",
        "kept AS (SELECT request_id, CASE WHEN others > 2 AND role = 'system' THEN pos - 1000 ELSE pos END AS pos, role, content FROM ranked"
        " WHERE others <= 2 OR role = 'system' OR back <= 2)",
        final=f"SELECT request_id, count(*) AS n_messages, md5({LINE}) AS digest FROM kept GROUP BY request_id",
    ),
    "brevity_prompts": _with(
        REQUESTS_SQL,
        "fs AS (SELECT request_id, min(pos) AS fp FROM msgs WHERE role = 'system' GROUP BY request_id)",
        f"b AS (SELECT m.request_id, pos, role, content || CASE WHEN fp = pos AND role = 'system' THEN chr(10) || chr(10) || {sql_text(BREVITY_PROMPT)} ELSE '' END AS content"
        " FROM msgs m LEFT JOIN fs USING (request_id)"
        f" UNION ALL SELECT request_id, -1, 'system', {sql_text(BREVITY_PROMPT)} FROM requests WHERE request_id NOT IN (SELECT request_id FROM fs))",
        final=f"SELECT request_id, count(*) AS n_messages, md5({LINE}) AS digest FROM b GROUP BY request_id",
    ),
    "shrunk_requests": shrink(
        f"SELECT request_id, original AS original_tokens, tokens AS input_tokens, saved AS saved_tokens, actions, digest"
        " FROM shrunk JOIN lines USING (request_id)",
        f"lines AS (SELECT request_id, md5({LINE}) AS digest FROM s5 GROUP BY request_id)",
    ),
    "savings_metrics": shrink(
        "SELECT request_id, CAST(CAST(round(CAST(saved AS DECIMAL(18,0)) * 1000000 / original, 0) AS BIGINT) / 1000000.0 AS DOUBLE) AS savings_pct,"
        f" {dollars('saved_micros')} AS cost_saved FROM shrunk"
    ),
    "request_guidance": f"SELECT doc_id, {estimate('text')} + 7 AS tokens FROM documents WHERE {estimate('text')} + 7 > 4000",
    "savings_report": shrink(
        "SELECT agent_id, tag AS action, count(*) AS requests, CAST(sum(original) AS BIGINT) AS original_tokens, CAST(sum(tokens) AS BIGINT) AS input_tokens,"
        f" CAST(sum(saved) AS BIGINT) AS saved_tokens, {dollars('sum(saved_micros)')} AS cost_saved"
        " FROM (SELECT *, unnest(list_filter(string_split('all,' || actions, ','), lambda a: a <> '')) AS tag FROM shrunk) GROUP BY agent_id, tag"
    ),
    # detection
    "text_spans": _with(
        PLANTED_SQL, *spans("f", "planted", "doc_id", "text", tuple(d for d in PERSONAL if d.entity == "phone")),
        final="SELECT doc_id, hit AS text, s AS span_start, e AS span_end FROM f",
    ),
    "pii_findings": findings(
        "SELECT doc_id, count(*) AS n, string_agg(entity || '@' || s || '-' || e, ',' ORDER BY rank, ord, s) AS found FROM g GROUP BY doc_id",
        f"g AS (SELECT *, {RANK} AS rank FROM f)",
    ),
    "secret_findings": findings(
        "SELECT doc_id, detector, hit AS text, s AS span_start, e AS span_end, confidence FROM f",
        detectors=tuple(d for d in DEFAULT_DETECTORS if d.entity == SECRET),
    ),
    "documents_with_pii": findings("SELECT doc_id, doc_id IN (SELECT doc_id FROM f) AS has_pii FROM planted"),
    "redacted_documents": findings(
        "SELECT p.doc_id, md5(coalesce(redacted, text)) AS digest, CAST(length(coalesce(redacted, text)) AS BIGINT) AS n_chars"
        " FROM planted p LEFT JOIN red USING (doc_id)",
        f"g AS (SELECT *, {RANK} AS rank FROM f)",
        *redacted("red", "g", "planted", "doc_id", "text"),
    ),
    "redacted_documents_compat": findings(
        "SELECT doc_id, md5(arg_max(text, k)) AS digest, CAST(length(arg_max(text, k)) AS BIGINT) AS n_chars FROM walk GROUP BY doc_id",
        f"g AS (SELECT *, {RANK} AS rank FROM f)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rank, ord) AS k FROM g)",
        "walk AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS k FROM planted UNION ALL SELECT w.doc_id,"
        " substr(w.text, 1, s) || '[' || upper(entity) || '_REDACTED]' || substr(w.text, e + 1), w.k + 1"
        " FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "pii_scan": _first_type("pii"),
    "secret_scan": _first_type("secret"),
    "jailbreak_scan": _with(
        PLANTED_SQL,
        final=f"SELECT doc_id, {jailbreak_case('text', 'category')} AS category, {jailbreak_case('text', 'pattern')} AS pattern FROM planted",
    ),
    "findings_table": findings(
        "SELECT doc_id, lang, entity, detector, hit AS text, s AS span_start, e AS span_end, confidence FROM f JOIN planted p USING (doc_id)"
    ),
    "findings_report": findings(
        "SELECT lang, entity, count(DISTINCT doc_id) AS documents, count(*) AS findings FROM f JOIN planted USING (doc_id) GROUP BY lang, entity"
    ),
    "findings_by_quality": findings(
        "SELECT quality, toxic, entity, count(DISTINCT doc_id) AS documents, count(*) AS findings FROM f JOIN labels USING (doc_id) GROUP BY ALL"
    ),
    "personal_data_by_language": _with(
        *spans("f", "documents", "doc_id", "text"),
        final="SELECT lang, entity, count(DISTINCT doc_id) AS documents, count(*) AS findings FROM f JOIN documents USING (doc_id) GROUP BY lang, entity",
    ),
    "scrubbed_corpus": findings(
        "SELECT source, count(*) AS documents, count(red.doc_id) AS flagged, CAST(sum(length(coalesce(redacted, text))) AS BIGINT) AS n_chars"
        " FROM planted p LEFT JOIN red USING (doc_id) GROUP BY source",
        f"g AS (SELECT *, {RANK} AS rank FROM f)",
        *redacted("red", "g", "planted", "doc_id", "text"),
    ),
    "clean_corpus": findings("SELECT doc_id, lang, source FROM planted WHERE doc_id NOT IN (SELECT doc_id FROM f)"),
    # guards
    "agent_policies": _with(
        REQUESTS_SQL, POLICY,
        final="SELECT request_id, CAST(CAST(p.budget AS DECIMAL(18,6)) AS DOUBLE) AS daily_budget, p.max_tokens::BIGINT AS max_input_tokens, p.action AS scanner_action,"
        " array_to_string(p.entities, ',') AS entities"
        " FROM (SELECT *, CASE WHEN conv_id % 9 = 0 THEN 'unlisted' ELSE agent_id END AS agent FROM requests) r"
        " JOIN policies p ON p.agent_id = CASE WHEN r.agent = 'unlisted' THEN 'default' ELSE r.agent END",
    ),
    "input_guard": _with(
        *SHRINK, SHRUNK, TEXTS, *GUARD,
        final="SELECT t.request_id, count(iv.type) FILTER (WHERE act = 'blocked') = 0 AS allowed,"
        " coalesce(string_agg(type || '/' || severity || '/' || act, ',' ORDER BY rank, ord, s), '') AS violations"
        " FROM texts t LEFT JOIN iv USING (request_id) GROUP BY t.request_id",
    ),
    "output_guard": _with(
        PLANTED_SQL, *spans("f", "planted", "doc_id", "text"), f"g AS (SELECT *, {RANK} AS rank FROM f)",
        final="SELECT doc_id, string_agg(CASE WHEN entity = 'secret' THEN 'secret/critical' ELSE 'output_pii/high' END, ',' ORDER BY rank, ord, s) AS violations"
        " FROM g GROUP BY doc_id",
    ),
    "token_limit_gate": shrink(
        "SELECT request_id, tokens AS input_tokens, coalesce(tokens > max_tokens, FALSE) AS blocked FROM shrunk"
    ),
    "daily_budget_gate": event_ledger("day", EVENT_BUDGET, EVENT_DECISIONS),
    "large_key_budget_gate": event_ledger("day", EVENT_BUDGET, EVENT_DECISIONS),
    "redacted_requests": _with(
        *SHRINK, SHRUNK,
        "m AS (SELECT request_id || '#' || pos AS mid, * FROM s5 WHERE request_id IN (SELECT request_id FROM routed WHERE action = 'redact'))",
        *spans("f", "m", "mid", "content"),
        "g AS (SELECT f.*, CASE entity WHEN 'secret' THEN -1 WHEN 'email' THEN 1 ELSE 3 END AS rank FROM f WHERE entity IN ('email', 'secret', 'ssn'))",
        *redacted("red", "g", "m", "mid", "content"),
        final="SELECT m.request_id, md5(string_agg(role || ': ' || coalesce(redacted, content), ' | ' ORDER BY pos)) AS digest"
        " FROM m LEFT JOIN red USING (mid) GROUP BY m.request_id",
    ),
    "governed_requests": governed(
        "SELECT request_id, agent_id, provider2 AS provider, model2 AS model, blocked, vs AS violations, original AS original_tokens,"
        f" tokens AS input_tokens, CAST(out2 AS BIGINT) AS output_tokens, {dollars('cost2')} AS cost_usd, {dollars('before')} AS spend_before FROM final"
    ),
    "governed_events": governed(
        "SELECT event, strftime(make_timestamp(CAST(epoch * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS at, agent_id, session_id, vs AS violations, input_tokens,"
        f" CAST(output_tokens AS BIGINT) AS output_tokens, {dollars('cost')} AS cost, original AS original_input_tokens, saved AS saved_tokens FROM log",
        _EVENTS_LOG,
    ),
    "request_block_reasons": governed(
        "SELECT first_type AS reason, count(*) AS n FROM final WHERE blocked GROUP BY first_type"
    ),
    "block_summaries": governed(
        "SELECT f.request_id, types, details FROM final f JOIN (SELECT request_id, string_agg(DISTINCT type, ', ' ORDER BY type) AS types FROM viol GROUP BY request_id) USING (request_id)"
        " JOIN (SELECT request_id, string_agg(detail, '; ' ORDER BY rank, ord, s) AS details FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, ord, s) AS i FROM viol) WHERE i <= 3 GROUP BY request_id) d USING (request_id)"
        " WHERE blocked".replace("types, details", "types, d.details"),
    ),
    "client_tools": _with(HISTORY_SQL, final="SELECT tool, count(*) AS n FROM history GROUP BY tool"),
    "budget_what_if": (
        "WITH RECURSIVE " + EV + ", budgets(b) AS (VALUES " + ", ".join(f"('{b}')" for b in WHAT_IF_BUDGETS) + "),"
        " foldrows AS (SELECT event_id, day, b, b || '|' || day AS k0, row_number() OVER (PARTITION BY b, day ORDER BY ts, event_id) AS rn, est, cost,"
        " CAST(CAST(b AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS budget FROM gate, budgets), "
        + ledger("ledger", "foldrows", "k0")
        + " SELECT CAST(CAST(b AS DECIMAL(18,6)) AS DOUBLE) AS budget, CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE NOT over) AS admitted,"
        " count(*) FILTER (WHERE over) AS refused, coalesce(CAST(sum(cost) FILTER (WHERE NOT over) AS BIGINT), 0) / 1000000.0::DOUBLE AS admitted_spend,"
        " coalesce(CAST(sum(cost) FILTER (WHERE over) AS BIGINT), 0) / 1000000.0::DOUBLE AS refused_spend"
        " FROM foldrows f JOIN ledger l ON l.k = f.k0 AND l.rn = f.rn GROUP BY b, day"
    ),
    # reports over the history
    "daily_usage": _with(
        HISTORY_SQL,
        final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS checks, CAST(sum(CASE WHEN blocked THEN 0 ELSE cost_usd END) AS DOUBLE) AS spend"
        " FROM history GROUP BY ALL",
    ),
    "daily_spend": _with(
        HISTORY_SQL,
        final="SELECT CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS spend FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-07' AND NOT blocked",
    ),
    "usage_by_tool": _with(
        HISTORY_SQL,
        final="SELECT coalesce(tool, 'Unknown') AS tool, count(*) AS requests, CAST(sum(cost_usd) AS DOUBLE) AS cost, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,"
        " count(*) FILTER (WHERE blocked) AS blocked FROM history GROUP BY 1",
    ),
    "usage_by_tool_of_day": _with(
        HISTORY_SQL,
        final="SELECT coalesce(tool, 'Unknown') AS tool, count(*) AS requests, CAST(sum(cost_usd) AS DOUBLE) AS cost, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,"
        " count(*) FILTER (WHERE blocked) AS blocked FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-07' GROUP BY 1",
    ),
    "block_reasons": _with(
        HISTORY_SQL,
        final="SELECT coalesce(tool, 'Unknown') AS tool, coalesce(nullif(block_reason, ''), 'Unknown') AS reason, count(*) AS n FROM history WHERE blocked GROUP BY 1, 2",
    ),
    # reports over the event log
    "traffic_stats": governed(
        "SELECT count(*) AS total_requests, count(*) FILTER (WHERE event = 'blocked') AS blocked, count(*) FILTER (WHERE event = 'allowed') AS allowed,"
        " CAST((count(*) FILTER (WHERE event = 'blocked') * 2000 + count(*)) // (count(*) * 2) / 10.0 AS DOUBLE) AS block_rate_pct,"
        f" {dollars('sum(cost)')} AS total_cost_usd, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM log",
        _EVENTS_LOG,
    ),
    "violations_by_type": governed("SELECT type, count(*) AS n FROM viol GROUP BY type"),
    "violation_share": governed(
        "SELECT type, n, CAST((n * 200 + max(n) OVER ()) // (max(n) OVER () * 2) AS BIGINT) AS pct FROM (SELECT type, count(*) AS n FROM viol GROUP BY type)"
    ),
    "recent_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "tail_events": "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "token_totals": governed(
        "SELECT CAST(sum(coalesce(original, input_tokens)) AS BIGINT) AS original_input_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,"
        f" CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {dollars('sum(cost)')} AS cost FROM log",
        _EVENTS_LOG,
    ),
    "session_spend": governed(
        f"SELECT session_id, {dollars('sum(cost2)')} AS spend FROM final WHERE NOT blocked AND session_id IS NOT NULL GROUP BY session_id"
    ),
    "cost_report": governed(
        f"SELECT 'support' AS agent_id, count(DISTINCT session_id) AS sessions, {dollars('sum(cost2)')} AS total_cost FROM final"
        " WHERE NOT blocked AND session_id IS NOT NULL AND agent_id = 'support'"
    ),
    # streams
    "stream_daily_usage": _with(
        HISTORY_SQL,
        final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS checks, CAST(sum(cost_usd) AS DOUBLE) AS spend FROM history GROUP BY ALL",
    ),
    "stream_usage_by_tool": _with(
        HISTORY_SQL,
        final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, coalesce(tool, 'Unknown') AS tool, count(*) AS requests, CAST(sum(cost_usd) AS DOUBLE) AS cost,"
        " CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE blocked) AS blocked FROM history GROUP BY ALL",
    ),
    "stream_traffic_stats": _with(
        HISTORY_SQL,
        final="SELECT 'event' AS kind, CASE WHEN blocked THEN 'blocked' ELSE 'allowed' END AS name, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS cost,"
        " CAST(coalesce(sum(tokens), 0) AS BIGINT) AS input_tokens FROM history GROUP BY ALL"
        " UNION ALL SELECT 'violation', coalesce(nullif(block_reason, ''), 'unknown'), count(*), 0, 0 FROM history WHERE blocked GROUP BY ALL",
    ),
    "stream_guard": _with(
        *spans("f", "documents", "doc_id", "text"),
        f"jb AS (SELECT doc_id, {jailbreak_case('text', 'category')} AS category FROM documents)",
        final="SELECT d.doc_id, NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND entity = 'secret') AND category IS NULL AS allowed"
        " FROM documents d JOIN jb USING (doc_id)",
    ),
    "stream_event_sink": _with(
        HISTORY_SQL, final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM history GROUP BY ALL"
    ),
    "guard_event_stream": _with(
        HISTORY_SQL,
        final="SELECT CASE WHEN blocked THEN 'blocked' ELSE 'allowed' END AS event, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM history GROUP BY ALL",
    ),
    "stream_budget_gate": governed(
        f"SELECT request_id, blocked, vs AS violations, {dollars('cost2')} AS cost_usd, {dollars('before')} AS spend_before FROM final"
    ),
    "page_words": f"SELECT page_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5"
    f" FROM (SELECT page_id, regexp_extract_all({PAGE_TEXT}, '[A-Za-z\u00c0-\u024f]+') AS w FROM pages)",
    "added_entity": "SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_host"
    " FROM (SELECT doc_id, len(regexp_extract_all(text, 'mail[0-9]+\\.example')) AS n FROM documents)",
    # declared controls
    "session_limit_gate": event_ledger(
        "user_id", "0.500000",
        EVENT_DECISIONS + " UNION ALL SELECT event_id, 0.0, FALSE FROM gate WHERE user_id % 10 = 0", "user_id % 10 <> 0",
    ),
    "monthly_budget_gate": event_ledger("date_trunc('month', ts)", "50.000000", EVENT_DECISIONS),
    "auto_downgrade": _with(
        EV,
        "spent AS (SELECT event_id, cost, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " >= 4000000 AS down FROM gate)",
        final="SELECT event_id, down AS downgraded, CASE WHEN down THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS model,"
        " CAST((CASE WHEN down THEN cost // 4 ELSE cost END) / 1000000.0 AS DOUBLE) AS cost FROM spent",
    ),
    "prompt_loops": _with(
        LOOP_TURNS_SQL, _LOOPS, final="SELECT conv_id, turn, CAST(n - b AS BIGINT) AS repeats, n - b > 3 AS looping FROM brk"
    ),
    "tool_access": _with(
        _values("tp", "agent_id, tool, allowed, denied", TOOL_POLICIES),
        "calls AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'research' ELSE 'default' END AS agent_id, event_type AS tool FROM events)",
        final="SELECT event_id, NOT EXISTS (SELECT 1 FROM tp WHERE tp.agent_id = c.agent_id AND tp.tool = c.tool AND denied)"
        " AND (NOT EXISTS (SELECT 1 FROM tp WHERE tp.agent_id = c.agent_id AND allowed)"
        " OR EXISTS (SELECT 1 FROM tp WHERE tp.agent_id = c.agent_id AND tp.tool = c.tool AND allowed)) AS permitted FROM calls c",
    ),
    "rate_limit": _with(
        _values("lim", "agent_id, tool, max_calls, per, cooldown", RATE_LIMITS),
        "numbered AS (SELECT *, row_number() OVER (ORDER BY agent_id, tool, per) AS no FROM lim)",
        AGENT_CALLS_SQL,
        "hits AS (SELECT c.*, n.no, n.max_calls, n.per, n.cooldown, CASE n.per WHEN 'minute' THEN strftime(ts, '%Y%m%d%H%M') WHEN 'hour' THEN strftime(ts, '%Y%m%d%H') ELSE '' END AS bucket"
        " FROM calls c JOIN numbered n USING (agent_id, tool))",
        final="SELECT event_id, per, CAST(max_calls AS BIGINT) AS max_calls, count(*) OVER w AS call_number, count(*) OVER w > max_calls AS over_limit,"
        " coalesce(epoch_us(ts) - epoch_us(last) < cooldown * 1000000::BIGINT, FALSE) AS cooling_down FROM hits"
        " WINDOW w AS (PARTITION BY user_id, no, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    ),
    "invalid_args": _with(
        _values("rules", "agent_id, tool, arg, type, pattern, vals", ARG_RULES),
        AGENT_CALLS_SQL,
        final="SELECT event_id, arg, problem FROM (SELECT event_id, arg, CASE"
        " WHEN type = 'int' AND NOT regexp_matches(v, '^[+-]?[0-9]+$') THEN 'not an integer'"
        " WHEN type = 'enum' AND NOT list_contains(vals, v) THEN 'not an allowed value'"
        " WHEN pattern IS NOT NULL AND NOT regexp_matches(v, '^(?:' || pattern || ')') THEN 'pattern mismatch' END AS problem"
        " FROM calls JOIN rules USING (agent_id, tool)) WHERE problem IS NOT NULL",
    ),
    "competitor_mentions": "SELECT conv_id, turn, " + " + ".join(
        f"(CASE WHEN contains(lower(text), lower({sql_text(t)})) THEN 1 ELSE 0 END)" for t in COMPETITORS
    ) + " AS n_terms FROM conversations WHERE role = 'assistant'",
    "high_severity_events": governed(
        "SELECT f.request_id, count(*) AS n FROM final f JOIN viol v USING (request_id) WHERE severity IN ('high', 'critical') GROUP BY f.request_id"
    ),
    "retained_events": _with(
        HISTORY_SQL, final="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM history WHERE CAST(timestamp AS DATE) > DATE '2024-01-21' GROUP BY ALL"
    ),
    "token_warnings": shrink("SELECT request_id, coalesce(tokens >= max_tokens * 0.8, FALSE) AS warned FROM shrunk"),
}

# The same results by other ways.
ORACLES["stream_daily_usage_live"] = ORACLES["stream_daily_usage"]
ORACLES["rewritten_event_log"] = ORACLES["guard_event_stream"]
