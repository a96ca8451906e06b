"""The same results as DuckDB SQL, written apart from the operators; only patterns are shared."""

from __future__ import annotations

from ..config import PROFILES, profile
from ..operators import detect, diff, listing, logs, search
from ..sources.fixtures import oracle as fixture_sql
from . import analytics
from .queries import ALL_KINDS, DETECTED, OFFSET

NL = "chr(10)"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def fx(name: str) -> str:
    return f"({fixture_sql(name)})"


def lines(source: str) -> str:
    return f"(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM {source}))"


ALL = "(" + " UNION ALL ".join(f"SELECT doc_id + {k * OFFSET} AS doc_id, kind, text FROM {fx(n)}" for k, n in enumerate(DETECTED)) + ")"
STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def cuts(source: str, keep: str = "") -> str:
    return f"""SELECT doc_id{keep},
        CASE WHEN instr(ahead, {NL} || {NL}) > 0 THEN 2000 + instr(ahead, {NL} || {NL}) WHEN instr(ahead, {NL}) > 0 THEN 2000 + instr(ahead, {NL}) ELSE 2000 + length(ahead) END AS head_end,
        CASE WHEN length(run) > 0 THEN at_ - length(run) + 1 WHEN instr(back, {NL}) > 0 THEN at_ - instr(back, {NL}) + 1 ELSE at_ END AS tail_start
        FROM (SELECT *, regexp_extract(back, '^((?s:.*?)\\n\\n+)', 1) AS run FROM (
            SELECT *, substr(text, 2001, 200) AS ahead, reverse(substr(text, greatest(0, at_ - 200) + 1, at_ - greatest(0, at_ - 200))) AS back
            FROM (SELECT *, length(text) - 2000 AS at_ FROM {source})))"""


def prose(source: str) -> str:
    return f"""SELECT doc_id, text, CASE WHEN length(text) > 10000 THEN substr(text, 1, head_end) || {NL} || '... [middle left out: ~' || format('{{:,}}', d)
        || ' chars / ~' || format('{{:,}}', d // 5) || ' words] ...' || {NL} || substr(text, greatest(tail_start, head_end) + 1) ELSE text END AS compressed
        FROM (SELECT *, CAST(greatest(0, tail_start - head_end) AS BIGINT) AS d FROM ({cuts(source, ", text")}))"""


def accounted(source: str) -> str:
    """Of (doc_id, content_type, text, compressed)."""
    return f"""SELECT doc_id, content_type, length(text) AS original_chars, length(compressed) AS compressed_chars, ok AS was_compressed,
        CASE WHEN ok THEN length(text) - length(compressed) END AS chars_saved, CASE WHEN ok THEN (length(text) - length(compressed)) // 4 END AS est_token_savings,
        CASE WHEN ok THEN round_even((1 - length(compressed) / greatest(length(text), 1)) * 100, 1) END AS compression_pct,
        CASE WHEN ok THEN substr(sha256(text), 1, 12) END AS hash, compressed
        FROM (SELECT *, coalesce(length(compressed) < length(text), false) AS ok FROM {source})"""


DOCS_TEXT = f"(SELECT doc_id, 'text' AS content_type, text, compressed FROM ({prose('(SELECT * FROM documents WHERE n_chars > 10000)')}))"
TEXT_REDUCE = accounted(DOCS_TEXT)


def hits(kind: str) -> str:
    part = f"list_slice(l, 1, {detect.LOOKED_AT.get(kind, 15)})"
    extra = f" AND NOT regexp_matches(x, {q(detect.DATED)})" if kind == "search_results" else ""
    total = " + ".join(f"len([x for x in {part} if regexp_matches(x, {q(p)}){extra}])" for p in detect.PATTERNS[kind])
    return f"CASE WHEN {total} >= 3 THEN {total} ELSE 0 END" if kind in detect.AT_LEAST_3 else total


SCORES = f"SELECT doc_id, {', '.join(f'{hits(k)} AS hits_{k}' for k in detect.PATTERNS)} FROM (SELECT *, list_slice(string_split(text, {NL}), 1, 20) AS l FROM {ALL})"
BEST = "greatest(" + ", ".join(f"hits_{k}" for k in detect.PATTERNS) + ")"
IS_JSON = "(json_valid(text) AND regexp_matches(text, '^\\s*[\\[{]'))"
DETECT = f"""SELECT doc_id, CASE WHEN length(text) < 16 THEN 'text' WHEN {IS_JSON} THEN 'json' WHEN {BEST} = 0 THEN 'text'
    {' '.join(f"WHEN hits_{k} = {BEST} THEN '{k}'" for k in detect.PATTERNS)} END AS content_type FROM ({SCORES}) JOIN (SELECT doc_id, text FROM {ALL}) USING (doc_id)"""


def log_class(source: str) -> str:
    norm = f"regexp_replace(regexp_replace(line, {q(logs.TIMESTAMP)}, '<TS>', 'g'), {q(logs.PATH)}, '<PATH>', 'g')"
    return f"""(SELECT doc_id, pos, line, blank, CASE WHEN blank THEN '' ELSE {STRIPPED.format(norm)} END AS norm,
        NOT blank AND regexp_matches(line, {q(logs.ERROR)}) AS is_error, NOT blank AND regexp_matches(line, {q(logs.STACK)}) AS is_stack,
        CASE WHEN blank THEN 0 ELSE 10 * regexp_matches(line, {q(logs.ERROR)})::INT + 8 * regexp_matches(line, {q(logs.STACK)})::INT
            + 3 * regexp_matches(line, {q(logs.WARN)})::INT + 5 * contains(line, 'FAIL')::INT END AS score
        FROM (SELECT *, NOT regexp_matches(line, '\\S') AS blank FROM {lines(source)}))"""


def log_lines(source: str) -> str:
    return f"""WITH c AS {log_class(source)}, w AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY doc_id, norm, blank, is_stack ORDER BY pos) AS rn,
            first_value(line) OVER o AS f, last_value(line) OVER o AS t FROM c
            WINDOW g AS (PARTITION BY doc_id, norm, blank), o AS (PARTITION BY doc_id, norm, blank ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        u AS (SELECT doc_id, pos, blank, CASE WHEN blank THEN [''] WHEN is_stack OR n < 3 THEN [line] WHEN f = t THEN ['[x' || n || '] ' || f]
                ELSE ['[x' || n || '] ' || f, '[last]  ' || t] END AS outs FROM w WHERE blank OR is_stack OR rn = 1
            UNION ALL SELECT doc_id, -1, false, ['# ' || count(*) || ' lines, ' || count(DISTINCT CASE WHEN norm <> '' THEN norm END) || ' unique patterns']
                FROM c GROUP BY doc_id HAVING count(*) > 20),
        v AS (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM u),
        e AS (SELECT doc_id, pos, unnest(range(len(outs))) AS sub, unnest(outs) AS o FROM v WHERE NOT blank OR b = false),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM e)
        SELECT doc_id, string_agg(o || CASE WHEN c > 200 AND r = 100 THEN {NL} || '... ' || (c - 200) || ' more lines truncated ...' ELSE '' END, {NL} ORDER BY r) AS compressed,
            count(*) + (max(c) > 200)::INT AS compressed_lines FROM r WHERE c <= 200 OR r <= 100 OR r > c - 100 GROUP BY doc_id"""


SEARCH = f"""SELECT doc_id, pos, CASE form WHEN 1 THEN regexp_extract(line, {q(search.MATCH)}, 1) WHEN 2 THEN regexp_extract(line, {q(search.CONTEXT)}, 1)
            WHEN 3 THEN regexp_extract(line, {q(search.OTHER)}, 1) END AS file,
        coalesce(CASE form WHEN 1 THEN TRY_CAST(regexp_extract(line, {q(search.MATCH)}, 2) AS INT) WHEN 2 THEN TRY_CAST(regexp_extract(line, {q(search.CONTEXT)}, 2) AS INT) END, 0) AS lnum,
        CASE form WHEN 1 THEN regexp_extract(line, {q(search.MATCH)}, 3) WHEN 2 THEN regexp_extract(line, {q(search.CONTEXT)}, 3) WHEN 3 THEN regexp_extract(line, {q(search.OTHER)}, 2) END AS own,
        form, line FROM (SELECT *, CASE WHEN regexp_matches(line, {q(search.MATCH)}) THEN 1 WHEN regexp_matches(line, {q(search.CONTEXT)}) THEN 2
            WHEN regexp_matches(line, {q(search.OTHER)}) AND NOT regexp_matches(line, '^[^:]*\\.:') AND length(regexp_extract(line, {q(search.OTHER)}, 1)) > 2 THEN 3 ELSE 0 END AS form
        FROM {lines(fx("search_multi"))} WHERE {STRIPPED.format("line")} <> '--')"""
SEARCH_PARSE = f"""SELECT doc_id, min(pos) AS pos, any_value(file) FILTER (form > 0) AS file, any_value(lnum) FILTER (form > 0) AS lnum,
        string_agg(CASE WHEN form > 0 THEN own ELSE {STRIPPED.format("line")} END, {NL} ORDER BY pos) AS match,
        any_value(CASE WHEN form = 2 THEN s * 3 // 10 ELSE s END) FILTER (form > 0) AS score
        FROM (SELECT *, CASE WHEN regexp_matches(own, {q(search.HIGH)}) THEN 100 WHEN regexp_matches(own, {q(search.MEDIUM)}) THEN 50 WHEN regexp_matches(own, {q(search.LOW)}) THEN 10 ELSE 20 END AS s,
            sum((form > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ({SEARCH})
            WHERE form > 0 OR (regexp_matches(line, '\\S') AND starts_with(line, '   ')) OR starts_with(line, chr(9))) WHERE g > 0 GROUP BY doc_id, g"""
SEARCH_RANK = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, first_pos) AS rank FROM (
        SELECT doc_id, file, sum(score) AS total, count(*) AS n, min(pos) AS first_pos FROM ({SEARCH_PARSE}) GROUP BY doc_id, file)) WHERE rank <= 15"""
SEARCH_PICK = f"""WITH m AS ({SEARCH_PARSE}), f AS ({SEARCH_RANK}),
        a AS (SELECT m.*, rank, n, row_number() OVER (PARTITION BY doc_id, file ORDER BY m.score DESC, lnum, m.pos) AS rn FROM m JOIN f USING (doc_id, file)),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, file, lnum, match, score ORDER BY rn) AS same FROM a WHERE n <= 5 OR rn <= 3 OR rn = n),
        c AS (SELECT * FROM b WHERE n <= 5 OR rn <= 3 OR same = 1),
        k AS (SELECT doc_id, file, rank, count(*) AS k FROM c GROUP BY ALL),
        s AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY doc_id) AS n_top FROM k)
        SELECT c.doc_id, c.file, c.rank, c.n, s.k, s.n_top, c.lnum, c.match, c.rn FROM c JOIN s USING (doc_id, file) WHERE before < 30"""
SEARCH_REDUCE = f"""SELECT doc_id, string_agg('# ' || file || ' (' || k || '/' || n || ' matches)' || {NL} || body, {NL} ORDER BY rank)
            || CASE WHEN max(n_top) > count(*) THEN {NL} || '... ' || (max(n_top) - count(*)) || ' more files with matches ...' ELSE '' END AS compressed,
        max(n_top) AS compressed_files, sum(k) AS compressed_matches
        FROM (SELECT doc_id, file, rank, n, k, n_top, string_agg('  ' || lnum || ':' || match, {NL} ORDER BY lnum, rn) AS body FROM ({SEARCH_PICK}) GROUP BY ALL) GROUP BY doc_id"""

PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
COLUMNAR = f"""SELECT o_custkey % 50 AS doc_id, 'COLUMNS' || {NL} || '# id, price, st' || {NL} || string_agg(o_orderkey || ',' || {PRICE} || ',' || o_orderstatus, {NL} ORDER BY o_orderkey) AS compressed
        FROM orders GROUP BY o_custkey % 50"""
RANGES = """SELECT o_custkey % 20 AS doc_id, 0 AS place, 'id' AS key, CAST(min(o_orderkey) AS DOUBLE) AS low, CAST(max(o_orderkey) AS DOUBLE) AS high FROM orders GROUP BY o_custkey % 20
        UNION ALL SELECT o_custkey % 20, 1, 'price', floor(min(o_totalprice)), floor(max(o_totalprice)) FROM orders GROUP BY o_custkey % 20
        UNION ALL SELECT o_custkey % 20, 2, 'vip', 1.0, 1.0 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 AND o_orderkey % 3 = 0"""


def short(v: str) -> str:
    e = f"CAST(floor(log10(abs({v}))) AS INT)"
    m = f"round_even(abs({v}) / pow(10, {e}), 1)"
    e2, m2 = f"(CASE WHEN {m} >= 10 THEN {e} + 1 ELSE {e} END)", f"(CASE WHEN {m} >= 10 THEN {m} / 10 ELSE {m} END)"
    return f"""CASE WHEN {v} = 0 THEN '0' WHEN {e2} >= 2 THEN regexp_replace(printf('%.1f', {m2}), '\\.0$', '') || 'e+' || lpad(CAST({e2} AS VARCHAR), 2, '0')
        WHEN {e2} = 1 THEN CAST(CAST(round_even(abs({v}), 0) AS INT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', {m2}), '\\.0$', '') END"""


ROW_DROP = f"""WITH o AS (SELECT o_custkey % 20 AS doc_id, '{{"id":' || o_orderkey || ',"price":' || {PRICE} || CASE WHEN o_orderkey % 3 = 0 THEN ',"vip":1' ELSE '' END || '}}' AS row,
            row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey % 20) AS c FROM orders),
        r AS (SELECT doc_id, string_agg(key || ': [' || {short("low")} || '..' || {short("high")} || ']', ' | ' ORDER BY place) AS s FROM ({RANGES}) GROUP BY doc_id)
        SELECT doc_id, 'row_drop' AS mode, '[SHOWING 10 first + 10 last of ' || c || ' items]' || {NL} || '[' || head || ']' || {NL} || '... ' || (c - 20) || ' rows left out, restore='
            || substr(sha256(text), 1, 12) || {NL} || '// Ranges of all rows: ' || s || {NL} || '[' || tail || ']' || {NL} || '[/SHOWING]' AS compressed
        FROM (SELECT doc_id, max(c) AS c, string_agg(row, ',' ORDER BY rn) FILTER (rn <= 10) AS head, string_agg(row, ',' ORDER BY rn) FILTER (rn > c - 10) AS tail FROM o GROUP BY doc_id)
        JOIN r USING (doc_id) JOIN {fx("json_mixed")} f USING (doc_id)"""
BODY = f"replace(replace(replace(text, {NL}, ' '), '\"', ' '), '\\', ' ')"
#: All documents: a body of the limit or more is stored, a shorter one stays.
OBJECTS = f"""SELECT doc_id, 'compact_object' AS mode, '{{"body":' || v || ',"id":' || doc_id || ',"meta":{{"lang":"' || lang || '","note":' || v || '}}}}' AS compressed
        FROM (SELECT *, CASE WHEN length({BODY}) >= 1000 THEN '"[stored:' || substr(sha256({BODY}), 1, 12) || ']"' ELSE '"' || {BODY} || '"' END AS v FROM documents)"""

JSON_MODES = f"""SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN 'compact_array' WHEN 1 THEN 'compact_scalar' WHEN 4 THEN 'columnar' WHEN 5 THEN 'compact_array' ELSE 'passthrough' END AS mode,
        CASE p_partkey % 6 WHEN 0 THEN '[{{"a":' || p_partkey || ',"b":"x,y"}},{{"a":2,"b":null}}]' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '{{"a": ' || p_partkey
            WHEN 3 THEN '{{"a": 1}}{{"a": ' || p_partkey || '}}' WHEN 4 THEN 'COLUMNS' || {NL} || '# k, v' || {NL} || '1,"a,b"' || {NL} || '2,' || {NL} || '3,c' || {NL} || '4,' || {NL} || p_partkey || ',d e'
            ELSE '[1,2,3,4,5,' || p_partkey || ']' END AS compressed FROM part"""

DIFF = f"""(WITH a AS (SELECT *, regexp_matches(line, {q(diff.FILE)}) AS isf, regexp_matches(line, '^@@ -\\d+,?\\d* \\+\\d+,?\\d* @@') AS ish FROM {lines(fx("diff_git"))}),
        b AS (SELECT *, sum(isf::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM a),
        c AS (SELECT *, sum(ish::INT) OVER (PARTITION BY doc_id, f ORDER BY pos) AS h FROM b),
        d AS (SELECT *, CASE WHEN isf THEN 'file' WHEN f > 20 THEN 'skipped' WHEN ish THEN 'hunk' WHEN starts_with(line, '\\ No newline at end of file') THEN 'no_newline' WHEN h = 0 THEN 'outside'
            WHEN line[1] = '+' THEN 'add' WHEN line[1] = '-' THEN 'delete' WHEN line[1] = ' ' THEN 'context' ELSE 'other' END AS role FROM c),
        e AS (SELECT *, sum((role IN ('hunk', 'add', 'delete'))::INT) OVER (PARTITION BY doc_id, f ORDER BY pos) AS c FROM d),
        g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f, c, role ORDER BY pos) AS k FROM e)
        SELECT doc_id, pos, line, role, f, CASE WHEN role IN ('file', 'outside') THEN true WHEN role = 'skipped' OR h > 10 THEN false WHEN role = 'context' THEN k <= 2 ELSE true END AS kept FROM g)"""
_SIZE = f"CAST(regexp_extract(line, {q(listing.ROW)}, 4) AS BIGINT)"
LISTING = f"""SELECT doc_id, string_agg(CASE WHEN regexp_matches(line, {q(listing.TOTAL)}) THEN '[total: ' || regexp_extract(line, {q(listing.TOTAL)}, 1) || ' blocks]'
        WHEN regexp_matches(line, {q(listing.ROW)}) THEN '  ' || CASE WHEN length(sz) < 6 THEN lpad(sz, 6, ' ') ELSE sz END || ' ' || regexp_extract(line, {q(listing.ROW)}, 5) || ' ' || regexp_extract(line, {q(listing.ROW)}, 6)
            || CASE line[1] WHEN 'd' THEN '/' WHEN 'l' THEN '@' ELSE '' END ELSE line END, {NL} ORDER BY pos) AS compressed
        FROM (SELECT *, CASE WHEN NOT regexp_matches(line, {q(listing.ROW)}) THEN '' WHEN {_SIZE} >= 1048576 THEN printf('%.1f', round_even({_SIZE} / 1048576.0, 1)) || 'M'
            WHEN {_SIZE} >= 1024 THEN CAST(round_even({_SIZE} / 1024.0, 0) AS BIGINT) || 'K' ELSE CAST({_SIZE} AS VARCHAR) END AS sz FROM {lines(fx("listing"))}) GROUP BY doc_id"""


def folded(name: str, inside: str, keep: str, new: str = "line") -> str:
    """Code reduction as a recursion over line numbers: state is (inside, blank)."""
    return f"""WITH RECURSIVE l AS (SELECT *, {STRIPPED.format("line")} AS body, regexp_extract(line, '^[ \\t]*(\"\"\"|'''''')', 1) AS op,
            regexp_replace(regexp_replace(line, '(?s)/\\*.*$', '') || regexp_extract(line, '(?s)/\\*.*?\\*/(.*)$', 1), '[ \\t]+$', '') AS around FROM {lines(fx(name))}),
        x AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, '' AS ins, false AS blank, false AS kept, '' AS line FROM l WHERE pos = 0
            UNION ALL SELECT l.doc_id, l.pos, {inside}, CASE WHEN {keep} THEN NOT regexp_matches({new}, '\\S') ELSE x.blank END,
                ({keep}) AND NOT (x.blank AND NOT regexp_matches({new}, '\\S')), {new} FROM x JOIN l ON l.doc_id = x.doc_id AND l.pos = x.pos + 1)
        SELECT doc_id, string_agg(line, {NL} ORDER BY pos) AS compressed FROM x WHERE kept GROUP BY doc_id"""


PY = folded(
    "code_py",
    "CASE WHEN ins <> '' THEN CASE WHEN contains(body, ins) THEN '' ELSE ins END WHEN op <> '' AND NOT contains(substr(body, 4), op) THEN op ELSE '' END",
    "ins = '' AND op = '' AND NOT starts_with(body, '#')",
    "l.line",
)
C = folded(
    "code_c",
    "CASE WHEN ins <> '' THEN CASE WHEN contains(body, '*/') THEN '' ELSE ins END WHEN NOT (starts_with(body, '//') OR starts_with(body, '* ')) AND contains(body, '/*') AND NOT regexp_matches(l.line, '/\\*.*?\\*/') THEN '/*' ELSE '' END",
    "ins = '' AND NOT (starts_with(body, '//') OR starts_with(body, '* ')) AND NOT (contains(body, '/*') AND NOT regexp_matches(around, '\\S'))",
    "CASE WHEN contains(body, '/*') THEN around ELSE l.line END",
)
_DIFF_TEXT = f"SELECT doc_id, string_agg(line, {NL} ORDER BY pos) AS compressed FROM {DIFF} WHERE kept GROUP BY doc_id"
_REDUCED = {
    "logs_mixed": log_lines(fx("logs_mixed")), "json_uniform": COLUMNAR, "search_multi": SEARCH_REDUCE, "diff_git": _DIFF_TEXT, "listing": LISTING,
    "code_py": PY, "code_c": C, "text_blank": prose(fx("text_blank")),
}
PIPELINE = accounted("(" + " UNION ALL ".join(
    f"SELECT f.doc_id + {k * OFFSET} AS doc_id, f.kind AS content_type, f.text, r.compressed FROM {fx(n)} f JOIN ({_REDUCED[n]}) r USING (doc_id) WHERE length(f.text) > 3000"
    for k, n in enumerate(ALL_KINDS)
) + ")")

LOG_REDUCED = f"(SELECT f.doc_id, f.text, r.compressed FROM {fx('logs_iso')} f JOIN ({log_lines(fx('logs_iso'))}) r USING (doc_id))"
HISTORIES = f"""(SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN coalesce(t.text, c.text) ELSE c.text END AS text, t.compressed, t.text AS tool_text FROM conversations c
        LEFT JOIN {LOG_REDUCED} t ON t.doc_id = (conv_id * 7 + turn) % ((SELECT max(user_id) FROM events) + 1))"""
SIZES = f"SELECT conv_id, sum(length(text)) AS total_chars, sum(length(text)) > 5000 AS triggered FROM {HISTORIES} GROUP BY conv_id"
CANDIDATES = f"""SELECT h.*, CASE WHEN role = 'user' THEN compressed END AS new FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role IN ('user', 'assistant') ORDER BY turn DESC) AS back FROM {HISTORIES}) h
        JOIN ({SIZES}) USING (conv_id) WHERE triggered AND back > 2 AND role = 'user' AND length(text) >= 100"""
ACCEPTED = f"SELECT *, round_even((1 - length(new) / length(text)) * 100, 1) AS pct, substr(sha256(text), 1, 12) AS hash FROM ({CANDIDATES}) WHERE length(text) > 3000 AND tool_text IS NOT NULL AND length(new) < length(text)"
HISTORY_REWRITE = f"""SELECT h.conv_id, h.turn, h.role, CASE WHEN a.hash IS NOT NULL THEN '[Reduced: text of turn ' || h.turn || ' (' || CAST(round_even(a.pct, 0) AS INT) || '% saved), restore=' || a.hash || ']' ELSE h.text END AS text, a.hash
        FROM {HISTORIES} h LEFT JOIN ({ACCEPTED}) a ON a.conv_id = h.conv_id AND a.turn = h.turn"""
WALK = f"""SELECT conv_id AS request_id, CAST(msg AS INT) AS msg, CASE WHEN turn % 2 = 0 THEN 0 ELSE -1 END AS item, length(text) AS original_chars, length(compressed) AS compressed_chars
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg FROM {HISTORIES})
        WHERE role = 'user' AND conv_id % 5 <> 0 AND length(text) > 3000 AND tool_text IS NOT NULL AND length(compressed) < length(text)"""
ACCESS = f"(SELECT doc_id, pos, {STRIPPED.format('line')} AS line FROM {lines(fx('access_log'))})"
IPS = f"(SELECT doc_id, pos, unnest(regexp_extract_all(line, {q(analytics.IP)})) AS ip FROM {ACCESS})"


def first(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(line, {q(pattern)}, {group})"


def counted(pattern: str, name: str, value: str) -> str:
    return f"SELECT doc_id, {value} AS {name}, count(*) AS n FROM {ACCESS} WHERE regexp_matches(line, {q(pattern)}) GROUP BY ALL"


HOURS = counted(analytics.STAMP, "hour", first(analytics.STAMP))
PATHS = counted(analytics.PATH, "path", f"{first(analytics.PATH)} || ' ' || {first(analytics.PATH, 2)}")
MS = f"(SELECT doc_id, CAST(unnest(regexp_extract_all(line, {q(analytics.DURATION)}, 1)) AS DOUBLE) AS ms FROM {ACCESS})"
STATUS = f"(SELECT doc_id, CAST({first(analytics.STATUS)} AS INT) AS code FROM {ACCESS} WHERE regexp_matches(line, {q(analytics.STATUS)}))"
EVERY_TEXT = f"SELECT kind, text FROM {ALL}"
STORED = f"(SELECT substr(sha256(text), 1, 12) AS hash, min(doc_id) AS doc_id, any_value(text) AS text, any_value(compressed) AS compressed FROM {LOG_REDUCED} GROUP BY 1)"
LOG_TOTALS = f"SELECT doc_id, len(string_split(text, {NL})) AS total_lines, length(text) AS total_chars FROM {fx('access_log')}"
STATUS_CLASSES = f"SELECT doc_id, count(*) FILTER (code BETWEEN 200 AND 299) AS n_2xx, count(*) FILTER (code BETWEEN 400 AND 499) AS n_4xx, count(*) FILTER (code >= 500) AS n_5xx FROM {STATUS} GROUP BY doc_id"
_IP_TOP = f"SELECT doc_id, ip AS top_ip, n AS top_ip_n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ip) AS r FROM (SELECT doc_id, ip, count(*) AS n FROM {IPS} GROUP BY ALL)) WHERE r = 1"
_PATH_TOP = f"SELECT doc_id, path AS top_path, n AS top_path_n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, path) AS r FROM ({PATHS})) WHERE r = 1"
#: Every counted field by line, so that the lines outside the first ten can be counted apart.
_FIELDS = f"""SELECT doc_id, 'ip' AS field, ip AS key, pos FROM {IPS}
        UNION ALL SELECT doc_id, 'status', CAST(CAST({first(analytics.STATUS)} AS INT) AS VARCHAR), pos FROM {ACCESS} WHERE regexp_matches(line, {q(analytics.STATUS)})
        UNION ALL SELECT doc_id, 'path', {first(analytics.PATH)} || ' ' || {first(analytics.PATH, 2)}, pos FROM {ACCESS} WHERE regexp_matches(line, {q(analytics.PATH)})
        UNION ALL SELECT doc_id, 'level', {first(analytics.LEVEL)}, pos FROM {ACCESS} WHERE regexp_matches(line, {q(analytics.LEVEL)})
        UNION ALL SELECT doc_id, 'hour', {first(analytics.STAMP)}, pos FROM {ACCESS} WHERE regexp_matches(line, {q(analytics.STAMP)})
        UNION ALL SELECT doc_id, 'duration', CASE WHEN ms < 10 THEN '<10ms' WHEN ms < 100 THEN '10-100ms' WHEN ms < 500 THEN '100-500ms' ELSE '>500ms' END, pos
            FROM (SELECT doc_id, pos, CAST(unnest(regexp_extract_all(line, {q(analytics.DURATION)}, 1)) AS DOUBLE) AS ms FROM {ACCESS})"""
#: Blocks are what blank lines part; adjacent blocks of equal patterns form an island.
BLOCKS = f"""WITH c AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM {log_class(fx("logs_mixed"))}),
        b AS (SELECT doc_id, block, min(pos) AS pos, list(norm ORDER BY pos) AS key, string_agg(line, {NL} ORDER BY pos) AS body FROM c WHERE NOT blank GROUP BY doc_id, block),
        d AS (SELECT *, coalesce((key <> lag(key) OVER (PARTITION BY doc_id ORDER BY block))::INT, 1) AS change FROM b),
        i AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY block) AS island FROM d),
        n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n, row_number() OVER (PARTITION BY doc_id, island ORDER BY block) AS k FROM i)
        SELECT doc_id, string_agg(CASE WHEN n >= 3 THEN '[x' || n || '] ' ELSE '' END || body, {NL} ORDER BY pos) AS compressed FROM n WHERE n < 3 OR k = 1 GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {
    "size_gate": "SELECT doc_id, n_chars, n_chars // 4 AS est_tokens FROM documents WHERE n_chars > 3000",
    "text_reduce": f"SELECT *, 'text' AS compressor, 'text_summary' AS mode FROM ({TEXT_REDUCE})",
    "text_cuts": cuts(fx("text_blank")),
    "detect_scores": SCORES,
    "detect_kind": DETECT,
    "hint_override": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'logs' ELSE content_type END AS content_type FROM ({DETECT})",
    "summary_lines": f"""SELECT doc_id, CASE WHEN NOT was_compressed THEN '' ELSE '[compress ' || content_type || ': ' || format('{{:,}}', CAST(original_chars AS BIGINT)) || '→' || format('{{:,}}', CAST(compressed_chars AS BIGINT)) || ' chars (' || printf('%+.1f', compression_pct)
        || '%), saved ~' || est_token_savings || ' tokens | restore: ' || hash || ']' END AS summary FROM ({PIPELINE})""",
    "log_normalize": f"SELECT doc_id, pos, norm, is_error, is_stack FROM {log_class(fx('logs_mixed'))}",
    "log_score": f"SELECT doc_id, pos, score FROM {log_class(fx('logs_mixed'))}",
    "log_patterns": f"SELECT doc_id, norm, count(*) AS n, min(pos) AS first_pos FROM {log_class(fx('logs_mixed'))} WHERE NOT blank AND norm <> '' GROUP BY doc_id, norm",
    "log_dedup_lines": f"SELECT doc_id, compressed_lines AS n_lines FROM ({log_lines(fx('logs_mixed'))})",
    "log_dedup": log_lines(fx("logs_mixed")),
    "log_repetitions": f"SELECT doc_id, sum(CASE WHEN n >= 3 AND NOT s THEN n - 1 ELSE 0 END) AS repetitions_saved FROM (SELECT doc_id, norm, count(*) AS n, bool_and(is_stack) AS s FROM {log_class(fx('logs_iso'))} WHERE NOT blank GROUP BY ALL) GROUP BY doc_id",
    "log_blocks": BLOCKS,
    "search_parse": SEARCH_PARSE,
    "search_file_rank": SEARCH_RANK,
    "search_pick": f"SELECT doc_id, file, rank, lnum, match FROM ({SEARCH_PICK})",
    "search_reduce": SEARCH_REDUCE,
    "json_valid": f"SELECT doc_id, {IS_JSON} AS valid FROM {ALL}",
    "json_shared_keys": "SELECT DISTINCT o_custkey % 50 AS doc_id, 'id,price,st' AS keys FROM orders",
    "json_columnar": f"SELECT *, 'columnar' AS mode FROM ({COLUMNAR})",
    "json_compact": f"""SELECT o_custkey % 50 AS doc_id, '[' || string_agg('{{"id":' || o_orderkey || ',"price":' || {PRICE} || ',"st":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderkey) || ']' AS compressed FROM orders GROUP BY 1""",
    "json_row_drop": ROW_DROP,
    "json_ranges": RANGES,
    "json_large_strings": OBJECTS,
    "json_stored_strings": f"SELECT doc_id, {BODY} AS original, substr(sha256({BODY}), 1, 12) AS hash FROM documents, range(2) WHERE length({BODY}) >= 1000",
    "json_modes": JSON_MODES,
    "diff_lines": f"SELECT doc_id, role, kept, count(*) AS n FROM {DIFF} GROUP BY ALL",
    "diff_stats": f"SELECT doc_id, least(max(f), 20) AS files_affected, count(*) FILTER (role = 'add') AS additions, count(*) FILTER (role = 'delete') AS deletions, count(*) FILTER (role = 'hunk' AND kept) AS hunks_kept FROM {DIFF} GROUP BY doc_id",
    "diff_reduce": _DIFF_TEXT,
    "listing_reduce": LISTING,
    "py_strip": PY,
    "c_strip": C,
    "pipeline_all": f"SELECT doc_id, content_type, original_chars, compressed_chars, was_compressed, coalesce(est_token_savings, 0) AS est_token_savings, coalesce(compression_pct, 0) AS compression_pct, coalesce(hash, '') AS hash FROM ({PIPELINE})",
    "store_put": f"""SELECT DISTINCT substr(sha256(text), 1, 12) AS hash, length(text) AS original_chars, len(string_split(text, {NL})) AS original_lines, CASE WHEN sha256(text) < 'b' THEN 1 ELSE 2 END AS batch
        FROM {fx("logs_iso")}""",
    "store_get": f"SELECT substr(sha256(text), 1, 12) AS hash, text AS original FROM {fx('logs_iso')} UNION ALL SELECT 'none' || range, NULL FROM range(3)",
    "store_retention": f"SELECT hash FROM {STORED} ORDER BY doc_id DESC, hash LIMIT 50",
    "store_stats": f"SELECT count(*) AS entries, coalesce(sum(strlen(text) + strlen(compressed)), 0) AS total_bytes, 500 AS max_entries FROM {STORED}",
    "round_trip": f"SELECT kind, count(*) AS n, count(*) AS restored FROM ({EVERY_TEXT}) GROUP BY kind",
    "history_trigger": SIZES,
    "history_candidates": f"SELECT conv_id, turn FROM ({CANDIDATES})",
    "history_rewrite": HISTORY_REWRITE,
    "history_items": HISTORY_REWRITE,
    "history_stats": f"""SELECT s.*, coalesce(n, 0) AS compressed_count, coalesce(saved, 0) AS chars_saved, coalesce(tokens, 0) AS tokens_saved_estimate, coalesce(e, '') AS entries FROM ({SIZES}) s LEFT JOIN
        (SELECT conv_id, count(*) AS n, sum(length(text) - length(new)) AS saved, sum((length(text) - length(new)) // 4) AS tokens,
            string_agg(turn || ':' || hash || ':' || length(text) || ':' || length('[Reduced: text of turn ' || turn || ' (' || CAST(round_even(pct, 0) AS INT) || '% saved), restore=' || hash || ']'), ',' ORDER BY turn) AS e
        FROM ({ACCEPTED}) GROUP BY conv_id) USING (conv_id)""",
    "request_walk": WALK,
    "request_transform": f"""SELECT h.request_id, coalesce(n, 0) AS compressed, coalesce(saved, 0) AS total_saved, CASE WHEN request_id % 4 = 0 OR n > 0 THEN 1 ELSE 0 END AS n_tools, chars - coalesce(saved, 0) AS chars
        FROM (SELECT conv_id AS request_id, sum(length(text)) AS chars FROM {HISTORIES} GROUP BY conv_id) h
        LEFT JOIN (SELECT request_id, count(*) AS n, sum(original_chars - compressed_chars) AS saved FROM ({WALK}) GROUP BY request_id) USING (request_id)""",
    "tool_inject": "SELECT DISTINCT conv_id AS request_id, 1 AS n_tools, 'retrieve_original' AS last_tool FROM conversations",
    "resolve_calls": f"""SELECT doc_id AS call_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN substr(sha256(text), 1, 12) ELSE 'unknown' END AS hash,
        CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN length(text) ELSE 0 END AS original_chars FROM {fx("logs_iso")}""",
    "profile_detect": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{p if profile(p) else p}')" for p in PROFILES) + ") t(given, detected)",
    "log_totals": LOG_TOTALS,
    "log_ip_counts": f"SELECT doc_id, ip, count(*) AS n FROM {IPS} GROUP BY ALL",
    "log_status_classes": STATUS_CLASSES,
    "log_status_counts": f"SELECT doc_id, code, count(*) AS n FROM {STATUS} GROUP BY ALL",
    "log_paths": PATHS,
    "log_levels": counted(analytics.LEVEL, "level", first(analytics.LEVEL)),
    "log_errors": f"SELECT doc_id, pos, {first(analytics.ERROR_MESSAGE)} AS module, {first(analytics.ERROR_MESSAGE, 2)} AS message FROM {ACCESS} WHERE {first(analytics.LEVEL)} = 'ERROR' AND regexp_matches(line, {q(analytics.ERROR_MESSAGE)})",
    "log_hours": HOURS,
    "log_duration_hist": f"SELECT doc_id, CASE WHEN ms < 10 THEN '<10ms' WHEN ms < 100 THEN '10-100ms' WHEN ms < 500 THEN '100-500ms' ELSE '>500ms' END AS bucket, count(*) AS n, count(*) FILTER (ms > 100) AS slow FROM {MS} GROUP BY ALL",
    "log_peak_ips": f"""SELECT doc_id, peak_hour, count(DISTINCT ip) AS n_ips FROM (SELECT a.doc_id, p.hour AS peak_hour, unnest(regexp_extract_all(line, {q(analytics.IP)})) AS ip FROM {ACCESS} a
        JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, hour) AS r FROM ({HOURS})) p ON p.doc_id = a.doc_id AND r = 1 AND {first(analytics.STAMP)} = p.hour) GROUP BY ALL""",
    "log_report": f"""SELECT * REPLACE (coalesce(n_2xx, 0) AS n_2xx, coalesce(n_4xx, 0) AS n_4xx, coalesce(n_5xx, 0) AS n_5xx) FROM ({LOG_TOTALS}) LEFT JOIN ({_IP_TOP}) USING (doc_id)
        LEFT JOIN ({_PATH_TOP}) USING (doc_id) LEFT JOIN ({STATUS_CLASSES}) USING (doc_id)""",
    "log_slow": f"SELECT doc_id, ms FROM {MS} WHERE ms > 100",
    "analysis_diff": f"""SELECT doc_id, ip, count(*) AS n_left, count(*) FILTER (pos >= 10) AS n_right FROM {IPS} GROUP BY doc_id, ip HAVING count(*) <> count(*) FILTER (pos >= 10)""",
    "analysis_diff_all": f"SELECT doc_id, field, key, count(*) AS n_left, count(*) FILTER (pos >= 10) AS n_right FROM ({_FIELDS}) GROUP BY ALL HAVING count(*) <> count(*) FILTER (pos >= 10)",
    "merge_by_time": "SELECT 's' || (event_id % 3) AS source, ts, event_id AS seq, event_type AS line FROM events",
    "savings_rollup": f"SELECT content_type, count(*) AS n, sum(original_chars) AS original, sum(CASE WHEN was_compressed THEN compressed_chars ELSE original_chars END) AS reduced, max(compression_pct) AS best_pct, min(compression_pct) AS worst_pct, bool_and(NOT was_compressed OR hash IS NOT NULL) AS all_reversible FROM ({PIPELINE}) GROUP BY ROLLUP (content_type)",
    "cost_projection": f"SELECT t AS tokens, round(t / 1e6 * 2, 6) AS per_run, round(t / 1e6 * 2 * 100, 4) AS per_day, round(t / 1e6 * 2 * 100 * 365, 2) AS per_year FROM (SELECT sum(est_token_savings) AS t FROM ({PIPELINE}))",
    "latency_summary": "SELECT event_type AS kind, round(avg(floor(value)), 3) AS avg_ms, CAST(min(floor(value)) AS BIGINT) AS min_ms, CAST(max(floor(value)) AS BIGINT) AS max_ms, quantile_cont(floor(value), 0.5) AS p50_ms FROM events GROUP BY 1",
    "recent_list": "SELECT name, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY ts DESC, seq) AS r FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, ts, event_id AS seq FROM events)) WHERE r = 1 ORDER BY ts DESC, seq LIMIT 10",
    "field_fidelity": "SELECT count(*) AS id, count(*) AS meta, count(*) AS body, count(*) AS n FROM documents",
    "stream_text_reduce": f"SELECT doc_id, length(compressed) AS compressed_chars, CASE WHEN length(compressed) < length(text) THEN substr(sha256(text), 1, 12) END AS hash FROM ({prose(fx('text_blank'))})",
}

#: DuckDB sums integers to 128 bits; these columns are 64 bits wide in Spark.
_WIDE_SUMS = {
    "log_repetitions": ["repetitions_saved"], "search_file_rank": ["total"], "search_reduce": ["compressed_matches"], "diff_stats": ["files_affected"],
    "store_stats": ["total_bytes"], "history_trigger": ["total_chars"], "history_stats": ["total_chars", "chars_saved", "tokens_saved_estimate"],
    "request_transform": ["total_saved", "chars"], "savings_rollup": ["original", "reduced"], "cost_projection": ["tokens"],
}
for _name, _columns in _WIDE_SUMS.items():
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({ORACLE_SQL[_name]})"
