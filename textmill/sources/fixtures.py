"""Tool outputs made from the plain tables, by one SQL text for Spark and for the oracle.

``@lines(t)`` stands for the lines of a table's texts, ``@agg(x; k)`` for a text of lines
in order, ``@fmt(ts)`` for a timestamp's text; :func:`render` writes them for either engine.
Every fixture has ``doc_id``, ``kind`` and ``text``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "logs_iso": """
        SELECT user_id AS doc_id, 'logs' AS kind, @agg('[' || upper(event_type) || '] ' || @fmt(ts) || ' svc=/api/v1/' || event_type || ' done'; event_id) AS text
        FROM events GROUP BY user_id""",
    "logs_mixed": """
        SELECT doc_id, 'logs' AS kind, @agg(line; event_id) AS text FROM (
            SELECT user_id AS doc_id, event_id, CASE
                WHEN event_id % 13 = 0 THEN ''
                WHEN event_id % 17 = 0 THEN '  File "/srv/app.py", line 7'
                WHEN event_id % 19 = 0 THEN @fmt(ts) || ' ERROR ' || event_type || ' id=' || CAST(event_id AS VARCHAR(20))
                WHEN event_id % 5 = 0 THEN @fmt(ts) || ' WARN slow ' || event_type || ' /var/log/app.log:'
                ELSE '[INFO] ' || @fmt(ts) || ' ' || event_type || ' ok' END AS line FROM events) x GROUP BY doc_id""",
    "json_uniform": """
        SELECT doc_id, 'json' AS kind, '[' || @agg('{"st": "' || st || '", "id": ' || id || ', "price": ' || price || '}'; k; ', ') || ']' AS text FROM (
            SELECT o_custkey % 50 AS doc_id, o_orderkey AS k, o_orderstatus AS st, CAST(o_orderkey AS VARCHAR(20)) AS id,
                CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) AS price FROM orders) x GROUP BY doc_id""",
    "json_mixed": """
        SELECT doc_id, 'json' AS kind, '[' || @agg('{"id": ' || id || ', "price": ' || price || extra || '}'; k; ', ') || ']' AS text FROM (
            SELECT o_custkey % 20 AS doc_id, o_orderkey AS k, CAST(o_orderkey AS VARCHAR(20)) AS id,
                CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) AS price,
                CASE WHEN o_orderkey % 3 = 0 THEN ', "vip": 1' ELSE '' END AS extra FROM orders) x GROUP BY doc_id""",
    "json_object": """
        SELECT doc_id, 'json' AS kind, '{"id": ' || CAST(doc_id AS VARCHAR(20)) || ', "meta": {"lang": "' || lang || '", "note": "' || body || '"}, "body": "' || body || '"}' AS text
        FROM (SELECT doc_id, lang, replace(replace(replace(text, chr(10), ' '), '"', ' '), '\\', ' ') AS body FROM documents) x""",
    "search_multi": """
        SELECT doc_id % 20 AS doc_id, 'search_results' AS kind, @agg(CASE (doc_id * 7 + pos) % 11
            WHEN 0 THEN '--'
            WHEN 1 THEN 'src/' || source || '.txt-' || CAST(pos + 1 AS VARCHAR(20)) || '-' || line
            WHEN 2 THEN '   ' || line
            WHEN 3 THEN 'note-' || source || ': ' || line
            WHEN 4 THEN 'src/' || source || '.txt:' || CAST(pos + 1 AS VARCHAR(20)) || ':error in ' || line
            WHEN 5 THEN 'src/' || lang || '.txt:' || CAST(pos + 1 AS VARCHAR(20)) || ':TODO ' || line
            ELSE 'src/' || source || '.txt:' || CAST(pos + 1 AS VARCHAR(20)) || ':' || line END; doc_id, pos) AS text
        FROM @lines(documents) WHERE length(line) > 0 GROUP BY doc_id % 20""",
    "diff_git": """
        SELECT doc_id, 'diff' AS kind, @agg(line; f, h, k, n) AS text FROM (
            SELECT DISTINCT l_suppkey % 12 AS doc_id, l_partkey % 25 AS f, -1 AS h, 0 AS k, 0 AS n,
                'diff --git a/f' || CAST(l_partkey % 25 AS VARCHAR(9)) || '.c b/f' || CAST(l_partkey % 25 AS VARCHAR(9)) || '.c' AS line FROM lineitem
            UNION ALL SELECT DISTINCT l_suppkey % 12, l_partkey % 25, -1, 1, 0, '--- a/f' || CAST(l_partkey % 25 AS VARCHAR(9)) || '.c' FROM lineitem
            UNION ALL SELECT DISTINCT l_suppkey % 12, l_partkey % 25, -1, 2, 0, '+++ b/f' || CAST(l_partkey % 25 AS VARCHAR(9)) || '.c' FROM lineitem
            UNION ALL SELECT DISTINCT l_suppkey % 12, l_partkey % 25, CAST(l_orderkey % 12 AS INT), -1, 0,
                '@@ -1,5 +1,6 @@' || CASE WHEN l_orderkey % 12 = 4 THEN '' ELSE ' fn' || CAST(l_orderkey % 12 AS VARCHAR(9)) || '()' END FROM lineitem
            UNION ALL SELECT l_suppkey % 12, l_partkey % 25, CAST(l_orderkey % 12 AS INT), CAST(l_orderkey AS INT), l_linenumber,
                CASE WHEN (l_orderkey + l_linenumber) % 61 = 0 THEN '\\ No newline at end of file'
                ELSE CASE (l_orderkey + 3 * l_linenumber) % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END
                    || 'row ' || CAST(l_orderkey AS VARCHAR(20)) || ' ' || CAST(l_partkey AS VARCHAR(20)) END FROM lineitem) x GROUP BY doc_id""",
    "listing": """
        SELECT p_partkey % 10 AS doc_id, 'file_listing' AS kind, 'total ' || CAST(count(*) AS VARCHAR(20)) || chr(10) || @agg(
            CASE WHEN p_partkey % 13 = 0 THEN 'ls: skipped ' || CAST(p_partkey AS VARCHAR(20)) ELSE
            CASE WHEN p_partkey % 7 = 0 THEN 'd' WHEN p_partkey % 11 = 0 THEN 'l' ELSE '-' END || 'rw-r--r--  1 root staff '
            || CAST(p_partkey * p_size * 37 AS VARCHAR(20)) || ' Jun ' || CAST(1 + p_partkey % 28 AS VARCHAR(9)) || ' 22:00 part' || CAST(p_partkey AS VARCHAR(20)) END; p_partkey) AS text
        FROM part GROUP BY p_partkey % 10""",
    "code_py": """
        SELECT p_partkey % 8 AS doc_id, 'code_python' AS kind, @agg(
            CASE WHEN p_partkey % 3 = 0 THEN '# part ' || p_brand || chr(10) ELSE '' END
            || 'def f' || CAST(p_partkey AS VARCHAR(20)) || '():' || chr(10)
            || CASE p_partkey % 4 WHEN 0 THEN '    \"\"\"Short.\"\"\"' || chr(10) WHEN 1 THEN '    \"\"\"Long' || chr(10) || '    body' || chr(10) || '    \"\"\"' || chr(10) ELSE '' END
            || '    # note' || chr(10) || '    return ' || CAST(p_size AS VARCHAR(9)) || chr(10) || chr(10) || chr(10); p_partkey) AS text
        FROM part GROUP BY p_partkey % 8""",
    "code_c": """
        SELECT p_partkey % 8 AS doc_id, 'code_go' AS kind, @agg(
            CASE p_partkey % 4 WHEN 0 THEN '// one' WHEN 1 THEN '/* a */ int x;' WHEN 2 THEN '/* b' || chr(10) || ' * c' || chr(10) || ' */' ELSE '  y = 1; /* tail */' END || chr(10)
            || 'func g' || CAST(p_partkey AS VARCHAR(20)) || '() {' || chr(10) || '  return ' || CAST(p_size AS VARCHAR(9)) || chr(10) || '}' || chr(10) || chr(10) || chr(10); p_partkey) AS text
        FROM part GROUP BY p_partkey % 8""",
    "access_log": """
        SELECT user_id % 10 AS doc_id, 'logs' AS kind, @agg(CASE event_id % 3
            WHEN 0 THEN '10.0.' || CAST(user_id % 7 AS VARCHAR(9)) || '.' || CAST(event_id % 50 AS VARCHAR(9)) || ' - - [' || @nginx(ts) || ' +0000] "GET /' || event_type
                || '/' || CAST(event_id % 9 AS VARCHAR(9)) || ' HTTP/1.1" ' || CASE event_id % 4 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '503' ELSE '302' END || ' 512'
            WHEN 1 THEN '[' || @fmt(ts) || '] ' || CASE event_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END || ' [mod' || CAST(event_id % 6 AS VARCHAR(9)) || '] did '
                || event_type || ' (from 10.1.0.' || CAST(event_id % 20 AS VARCHAR(9)) || ')'
            ELSE '[' || @fmt(ts) || '] ' || CAST(event_id % 700 AS VARCHAR(9)) || '.5ms 3 rows | SELECT ' || event_type END; event_id) AS text
        FROM events GROUP BY user_id % 10""",
    "build_log": """
        SELECT user_id AS doc_id, 'build_output' AS kind, @agg(CASE event_id % 5
            WHEN 0 THEN 'error: cannot find ' || event_type
            WHEN 1 THEN 'warning: unused ' || event_type
            WHEN 2 THEN CAST(event_id % 90 AS VARCHAR(9)) || ' tests passed'
            WHEN 3 THEN 'step ' || event_type || ' FAILED'
            ELSE '   compiling ' || event_type END; event_id) AS text
        FROM events GROUP BY user_id""",
    "code_js": """
        SELECT p_partkey % 8 AS doc_id, 'code_javascript' AS kind, @agg(CASE p_partkey % 4 WHEN 0 THEN 'const a' WHEN 1 THEN 'let b' WHEN 2 THEN 'function f' ELSE 'export default g' END
            || CAST(p_partkey AS VARCHAR(20)) || ' = ' || CAST(p_size AS VARCHAR(9)) || ';'; p_partkey) AS text
        FROM part GROUP BY p_partkey % 8""",
    "code_ts": """
        SELECT p_partkey % 8 AS doc_id, 'code_typescript' AS kind, @agg(CASE p_partkey % 3 WHEN 0 THEN 'interface P' WHEN 1 THEN 'type Q' ELSE 'enum R' END
            || CAST(p_partkey AS VARCHAR(20)) || ' { size: number; name: string }'; p_partkey) AS text
        FROM part GROUP BY p_partkey % 8""",
    "code_rust": """
        SELECT p_partkey % 8 AS doc_id, 'code_rust' AS kind, @agg(CASE p_partkey % 4 WHEN 0 THEN 'pub fn f' WHEN 1 THEN 'struct S' WHEN 2 THEN '#[test] // t' ELSE 'impl T' END
            || CAST(p_partkey AS VARCHAR(20)) || ' { ' || CAST(p_size AS VARCHAR(9)) || ' }'; p_partkey) AS text
        FROM part GROUP BY p_partkey % 8""",
    "json_values": """
        SELECT p_partkey AS doc_id, 'json' AS kind, CASE p_partkey % 6
            WHEN 0 THEN '[{"b": "x,y", "a": ' || CAST(p_partkey AS VARCHAR(20)) || '}, {"a": 2, "b": null}]'
            WHEN 1 THEN CAST(p_size AS VARCHAR(9))
            WHEN 2 THEN '{"a": ' || CAST(p_partkey AS VARCHAR(20))
            WHEN 3 THEN '{"a": 1}{"a": ' || CAST(p_partkey AS VARCHAR(20)) || '}'
            WHEN 4 THEN '[{"v": "a,b", "k": 1}, {"v": null, "k": 2}, {"k": 3, "v": "c"}, {"k": 4, "v": ""}, {"k": ' || CAST(p_partkey AS VARCHAR(20)) || ', "v": "d e"}]'
            ELSE '[1, 2, 3, 4, 5, ' || CAST(p_partkey AS VARCHAR(20)) || ']' END AS text
        FROM part""",
    "text_blank": """
        SELECT doc_id, 'text' AS kind, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents WHERE n_chars > 3000""",
}

_TABLES = ["documents", "events", "orders", "lineitem", "part"]


#: Lines of a text that Spark joins at a time.
PIECE = 1024


def _in_pieces(before: str, value: str, key: str, by: str, after: str) -> str:
    """A fixture's SQL for Spark: lines are numbered by a sort, which may spill, joined to pieces, and these to the text.

    A list of all lines of a text would have to fit a task's memory, many times its text; and
    pieces are dealt out on their own between, as the two halves of an aggregate in one task
    would copy all pieces of a text a few times.
    """
    source, group = after[after.index("FROM ") :].rsplit(" GROUP BY ", 1)
    joined = lambda order: f"array_join(transform(array_sort(collect_list(struct({order}, v_))), x_ -> x_.v_), {by})"
    lines = f"SELECT {group} AS g_, {key}, {value} AS v_ {source}"
    placed = f"SELECT *, (row_number() OVER (PARTITION BY g_ ORDER BY {key}, v_) - 1) div {PIECE} AS c_ FROM ({lines})"
    pieces = f"SELECT g_, c_, count(*) AS n_, CASE WHEN count(v_) > 0 THEN {joined(key)} END AS v_ FROM ({placed}) GROUP BY g_, c_"
    kind, text = re.search(r"('\w+' AS kind), (.*)", before, re.S).groups()
    dealt = f"SELECT /*+ REPARTITION(g_, c_) */ * FROM ({pieces})"
    return f"SELECT g_ AS doc_id, {kind}, {text.replace('count(*)', 'sum(n_)')}{joined('c_')}{after[: after.index('FROM ')]} FROM ({dealt}) GROUP BY g_"


def render(sql: str, engine: str) -> str:
    """The SQL of a fixture for ``spark`` or ``duckdb``."""
    spark = engine == "spark"
    sql = re.sub(r"@fmt\((\w+)\)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss')" if spark else r"strftime(\1, '%Y-%m-%d %H:%M:%S')", sql)
    sql = re.sub(r"@nginx\((\w+)\)", r"date_format(\1, 'dd/MMM/yyyy:HH:mm:ss')" if spark else r"strftime(\1, '%d/%b/%Y:%H:%M:%S')", sql)
    lines = (
        r"(SELECT doc_id, source, lang, pos, line FROM \1 LATERAL VIEW posexplode(split(text, chr(10))) x AS pos, line)"
        if spark
        else r"(SELECT doc_id, source, lang, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM \1) z) y"
    )
    sql = re.sub(r"@lines\((\w+)\)", lines, sql)
    while (at := sql.find("@agg(")) >= 0:
        depth, end = 1, at + 5
        quoted = False
        while depth:
            ch = sql[end]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch == "(") - (ch == ")")
            end += 1
        inside = sql[at + 5 : end - 1]
        parts, quoted, last = [], False, 0
        for i, ch in enumerate(inside):
            if ch == "'":
                quoted = not quoted
            elif ch == ";" and not quoted:
                parts.append(inside[last:i])
                last = i + 1
        parts.append(inside[last:])
        value, key, by = parts[0], parts[1], parts[2].strip() if len(parts) > 2 else "chr(10)"
        sql = _in_pieces(sql[:at], value, key.strip(), by, sql[end:]) if spark else f"{sql[:at]}string_agg({value}, {by} ORDER BY {key}, {value}){sql[end:]}"
    return sql.replace("\\", "\\\\") if spark else sql


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b{t}\b", FIXTURES[name])}
    sql = render(FIXTURES[name], "spark").replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def oracle(name: str) -> str:
    return render(FIXTURES[name], "duckdb")
