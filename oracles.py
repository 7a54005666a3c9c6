"""DuckDB oracle SQL for every query registered in ``__spark_entry__``.

Each oracle re-derives the log-shaped view from the benchmark tables as a CTE
(the same view text the Spark side runs) and computes the expected result in
plain SQL, independently of the library code.  Output rules shared with the
Spark side: every column aliased, only bigint/double/string values,
timestamps as ``yyyy-MM-dd HH:mm:ss`` text, deterministic tie-breaks,
percentages by exact half-even integer arithmetic.
"""

from __future__ import annotations

from logsift import lookups
from logsift.fixtures import view_sql_for_duckdb
from logsift.schemas import IDENTITY_KEYS

TS = "'%Y-%m-%d %H:%M:%S'"


def pct_sql(n: str, t: str) -> str:
    """Exact half-even ``round(n / t * 100, 2)`` as a double."""
    s = f"(CAST({n} AS BIGINT) * 10000)"
    q = f"({s} // ({t}))"
    r = f"({s} % ({t}))"
    return f"(({q} + CASE WHEN 2 * {r} > ({t}) OR (2 * {r} = ({t}) AND {q} % 2 = 1) THEN 1 ELSE 0 END) / 100.0)"


def with_views(body: str, *names: str) -> str:
    ctes = [f"{n} AS ({view_sql_for_duckdb(n)})" for n in names]
    return "WITH " + ",\n".join(ctes) + ",\n" + body


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _rules_sql(x: str, rules) -> str:
    parts, default = [], "NULL"
    for keywords, target in rules:
        value = _rules_sql(x, target) if isinstance(target, list) else _q(target)
        if not keywords:
            default = value
            break
        cond = " OR ".join(f"strpos({x}, {_q(k)}) > 0" for k in keywords)
        parts.append(f"WHEN {cond} THEN {value}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


def classify_sql(col: str, rules, empty: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN {_q(empty)} ELSE {_rules_sql(f'lower({col})', rules)} END"


# ---------------------------------------------------------------------------
# typed CTEs over the views
# ---------------------------------------------------------------------------

VPC_TYPED = """vpcf AS (
  SELECT srcaddr, dstaddr, TRY_CAST(srcport AS BIGINT) AS srcport, TRY_CAST(dstport AS BIGINT) AS dstport,
         TRY_CAST(protocol AS BIGINT) AS protocol, TRY_CAST(packets AS BIGINT) AS packets,
         TRY_CAST(bytes AS BIGINT) AS bytes, make_timestamp(start_epoch * 1000000) AS window_start,
         make_timestamp(end_epoch * 1000000) AS window_end, action, flow_log_status
  FROM vpc)"""

PROTO = ("CASE protocol " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in lookups.PROTOCOL_NAMES.items())
         + " ELSE CAST(protocol AS VARCHAR) END")

PORTS = f"ports(port, service) AS (VALUES {_values(lookups.REMOTE_ACCESS_PORTS.items())})"

OFFSETS = f"offs(region, minutes) AS (VALUES {_values(lookups.region_offset_minutes().items())})"

CT_TYPED = OFFSETS + """,
ctb AS (
  SELECT event_id, CAST(replace(substr(event_time_text, 1, 19), 'T', ' ') AS TIMESTAMP) AS event_time,
         aws_region, event_name, source_ip AS source_ip_address, nullif(user_agent, '') AS user_agent,
         error_code, error_message, user_name, arn AS user_arn, request_parameters AS request_elements
  FROM ct),
ctf AS (
  SELECT ctb.*, CASE WHEN aws_region IS NULL THEN NULL
                     ELSE ctb.event_time + to_minutes(CAST(coalesce(offs.minutes, 0) AS BIGINT)) END AS event_time_local
  FROM ctb LEFT JOIN offs ON ctb.aws_region = offs.region)"""

# local time less its offset
S3_TIME = ("(strptime(substr(original_timestamp, 2, 20), '%d/%b/%Y:%H:%M:%S') - to_minutes(CAST(CASE "
           "WHEN contains(original_timestamp, '+0930]') THEN 570 WHEN contains(original_timestamp, '-0500]') THEN -300 ELSE 0 END AS BIGINT)))")

S3_TYPED = f"""s3f AS (
  SELECT o_orderkey, bucket_owner, bucket, original_timestamp,
         {S3_TIME} AS request_datetime,
         remote_ip, requester, request_id, operation, object_key AS key, user_agent, bytes_sent
  FROM s3)"""


def _tactics_cte(log_type: str) -> str:
    rows = lookups.tactic_rows(None, log_type)
    pick = "arg_min" if lookups.TACTIC_POLICY[log_type] == "first" else "arg_max"
    return (f"tac_raw(tactic, name, pos) AS (VALUES {_values(rows)}),\n"
            f"tac AS (SELECT name, {pick}(tactic, pos) AS tactic FROM tac_raw GROUP BY name)")


def _failure_sql(cat_names: dict | None = None) -> str:
    text = "concat_ws(chr(1), error_code, error_message, event_name)"
    arms = []
    for cat, kws in lookups.FAILURE_KEYWORDS.items():
        label = (cat_names or {}).get(cat, cat)
        arms.append(f"SELECT {_q(label)} AS category, {len(arms)} AS cat_order, * FROM ctf "
                    f"WHERE regexp_matches({text}, {_q('(?i)(' + '|'.join(kws) + ')')})")
    return "\nUNION ALL\n".join(arms)


REQ_ARN = lookups.REQUESTER_ARN_PATTERN
REQ_IP = lookups.REQUESTER_IP_PATTERN
REQUESTER_ARN = (f"CASE WHEN requester IS NULL OR requester = '' OR requester = '-' THEN 'Unknown' "
                 f"WHEN regexp_matches(requester, {_q(REQ_ARN)}) THEN regexp_extract(requester, {_q(REQ_ARN)}, 1) "
                 f"|| ':' || regexp_extract(requester, {_q(REQ_ARN)}, 2) || '/' || regexp_extract(requester, {_q(REQ_ARN)}, 3) "
                 f"WHEN regexp_matches(requester, {_q(REQ_IP)}) THEN 'N/A' ELSE requester END")
REQUESTER_IP = (f"CASE WHEN requester IS NULL OR requester = '' OR requester = '-' THEN 'Unknown' "
                f"WHEN regexp_matches(requester, {_q(REQ_ARN)}) THEN 'N/A' "
                f"WHEN regexp_matches(requester, {_q(REQ_IP)}) THEN regexp_extract(requester, {_q(REQ_IP)}, 0) "
                f"ELSE 'N/A' END")


def _vpc(body: str) -> str:
    return with_views(VPC_TYPED + ",\n" + body, "vpc")


def _ct(body: str) -> str:
    return with_views(CT_TYPED + ",\n" + body, "ct")


def _s3(body: str) -> str:
    return with_views(S3_TYPED + ",\n" + body, "s3")


# ---------------------------------------------------------------------------
# oracles
# ---------------------------------------------------------------------------

def _vpc_oracles(q: dict) -> None:
    q["vpc_parse_lines"] = with_views(f"""
x AS (SELECT 1)
SELECT '2' AS version, '123456789012' AS account_id, 'eni-0a1b2c3d' AS interface_id, srcaddr, dstaddr,
       TRY_CAST(srcport AS BIGINT) AS srcport, TRY_CAST(dstport AS BIGINT) AS dstport,
       TRY_CAST(protocol AS BIGINT) AS protocol, TRY_CAST(packets AS BIGINT) AS packets,
       TRY_CAST(bytes AS BIGINT) AS bytes,
       strftime(make_timestamp(start_epoch * 1000000), {TS}) AS window_start,
       strftime(make_timestamp(end_epoch * 1000000), {TS}) AS window_end,
       action, flow_log_status, printf('flow-%03d.log', l_orderkey % 64) AS source_file
FROM vpc""", "vpc")
    q["vpc_top_ips"] = _vpc("""
roles AS (SELECT 'Source IP' AS type, srcaddr AS ip, bytes, packets FROM vpcf
          UNION ALL SELECT 'Destination IP', dstaddr, bytes, packets FROM vpcf)
SELECT ip, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, type,
       CAST(coalesce(sum(packets), 0) AS BIGINT) AS total_packets
FROM roles WHERE ip IS NOT NULL GROUP BY type, ip
ORDER BY total_bytes DESC, ip, type LIMIT 20""")
    q["vpc_top_ports"] = _vpc(f"""
agg AS (SELECT dstport, protocol, count(*) AS flow_count, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes
        FROM vpcf WHERE dstport IS NOT NULL AND protocol IS NOT NULL GROUP BY dstport, protocol
        ORDER BY total_bytes DESC, dstport, protocol LIMIT 20)
SELECT dstport AS port, {PROTO} AS protocol, flow_count, total_bytes FROM agg""")
    q["vpc_night_remote"] = _vpc(f"""{PORTS}
SELECT srcaddr AS source_ip, dstaddr AS destination_ip, dstport AS port, {PROTO} AS protocol, service,
       CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(packets), 0) AS BIGINT) AS total_packets
FROM vpcf JOIN ports ON vpcf.dstport = ports.port
WHERE (hour(window_start) >= 22 OR hour(window_start) < 6)
  AND srcaddr IS NOT NULL AND dstaddr IS NOT NULL AND protocol IS NOT NULL
GROUP BY srcaddr, dstaddr, dstport, protocol, service""")
    q["vpc_session_duration"] = _vpc("""
d AS (SELECT *, date_diff('second', window_start, window_end) AS duration FROM vpcf)
SELECT srcaddr AS source_ip, dstaddr AS destination_ip, max(duration) AS duration_seconds,
       CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(packets), 0) AS BIGINT) AS total_packets
FROM d WHERE duration > 0 AND srcaddr IS NOT NULL AND dstaddr IS NOT NULL
GROUP BY srcaddr, dstaddr ORDER BY duration_seconds DESC, source_ip, destination_ip LIMIT 20""")
    conn = """
SELECT srcaddr AS source_ip, dstaddr AS destination_ip,
       CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes,
       CAST(coalesce(sum(packets), 0) AS BIGINT) AS total_packets, count(*) AS flow_count
FROM vpcf WHERE srcaddr IS NOT NULL AND dstaddr IS NOT NULL
GROUP BY srcaddr, dstaddr ORDER BY total_bytes DESC, source_ip, destination_ip LIMIT {n}"""
    q["vpc_top_connections"] = _vpc(conn.format(n=20))
    q["vpc_top_connections_joined"] = q["vpc_top_connections"]
    q["rpt_connection_labels"] = _vpc(f"""
c AS ({conn.format(n=10)})
SELECT source_ip || ' → ' || destination_ip AS label, total_bytes AS value FROM c""")
    q["rpt_port_labels"] = _vpc("""
c AS (SELECT dstport, protocol, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes
      FROM vpcf WHERE dstport IS NOT NULL AND protocol IS NOT NULL GROUP BY dstport, protocol
      ORDER BY total_bytes DESC, dstport, protocol LIMIT 10)
SELECT 'Port ' || CAST(dstport AS VARCHAR) AS label, total_bytes AS value FROM c""")
    q["rpt_session_hours"] = _vpc("""
d AS (SELECT *, date_diff('second', window_start, window_end) AS duration FROM vpcf),
s AS (SELECT srcaddr, dstaddr, max(duration) AS dur, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes
      FROM d WHERE duration > 0 AND srcaddr IS NOT NULL AND dstaddr IS NOT NULL
      GROUP BY srcaddr, dstaddr ORDER BY dur DESC, srcaddr, dstaddr LIMIT 20)
SELECT srcaddr || ' → ' || dstaddr AS label, srcaddr AS source_ip, dstaddr AS destination_ip,
       ((dur // 36) + CASE WHEN 2 * (dur % 36) > 36 OR (2 * (dur % 36) = 36 AND (dur // 36) % 2 = 1) THEN 1 ELSE 0 END) / 100.0
         AS duration_hours,
       total_bytes FROM s""")
    q["export_column_order"] = _vpc(f"""
x AS (SELECT 1)
SELECT strftime(window_start, {TS}) AS "window_start_(UTC+0)", strftime(window_end, {TS}) AS "window_end_(UTC+0)",
       srcaddr, dstaddr, coalesce(CAST(srcport AS VARCHAR), '') AS srcport, coalesce(CAST(dstport AS VARCHAR), '') AS dstport,
       coalesce(CAST(protocol AS VARCHAR), '') AS protocol, action,
       coalesce(CAST(packets AS VARCHAR), '') AS packets, coalesce(CAST(bytes AS VARCHAR), '') AS bytes,
       'eni-0a1b2c3d' AS interface_id, '123456789012' AS account_id, '2' AS version, flow_log_status,
       'vpc_view' AS sourceFile
FROM vpcf""")


def _s3_oracles(q: dict) -> None:
    full_cols = f"""
       bucket_owner, bucket, original_timestamp, remote_ip, requester, request_id, operation, object_key AS key,
       CASE WHEN is_full THEN 'GET ' || object_key || ' HTTP/1.1' ELSE '-' END AS request_uri,
       CAST(200 AS BIGINT) AS http_status_code, '-' AS error_code, bytes_sent,
       CAST(NULL AS BIGINT) AS object_size, CAST(NULL AS BIGINT) AS total_time, CAST(NULL AS BIGINT) AS turn_around_time,
       CASE WHEN is_full THEN '-' END AS referer, CASE WHEN is_full THEN user_agent END AS user_agent,
       CASE WHEN is_full THEN '-' END AS version_id, CASE WHEN is_full THEN 'HOSTID' END AS host_id,
       CASE WHEN is_full THEN 'SigV4' END AS signature_version,
       CASE WHEN is_full THEN 'ECDHE-RSA-AES128-GCM-SHA256' END AS cipher_suite,
       CASE WHEN is_full THEN 'AuthHeader' END AS authentication_type,
       CASE WHEN is_full THEN 's3.amazonaws.com' END AS host_header, CASE WHEN is_full THEN 'TLSv1.2' END AS tls_version,
       CASE WHEN is_full THEN '-' END AS dash1, CASE WHEN is_full THEN '-' END AS dash2,
       CASE WHEN is_full AND o_orderkey % 19 = 0 THEN 'new1 "new 2"' END AS extra_fields,
       printf('access-%02d.log', o_orderkey % 16) AS source_file,
       CASE WHEN is_full THEN 'full' ELSE 'fallback' END AS parse_status,
       strftime({S3_TIME}, {TS}) AS request_datetime"""
    q["s3_parse_lines"] = with_views(f"""
l AS (SELECT *, user_agent <> '-' AS is_full FROM s3)
SELECT {full_cols} FROM l""", "s3")
    q["s3_parse_status"] = with_views("""
l AS (SELECT CASE WHEN user_agent <> '-' THEN 'full' ELSE 'fallback' END AS parse_status FROM s3)
SELECT parse_status, count(*) AS lines FROM l GROUP BY parse_status""", "s3")
    req = f"""
r AS (SELECT {REQUESTER_ARN} AS requester_arn, coalesce(remote_ip, {REQUESTER_IP}) AS source_ip FROM s3f),
top AS (SELECT requester_arn, source_ip, count(*) AS request_count FROM r GROUP BY requester_arn, source_ip
        ORDER BY request_count DESC, requester_arn, source_ip LIMIT __N__)"""
    q["s3_requesters"] = _s3(req.replace("__N__", "20") + """
SELECT * FROM top WHERE requester_arn <> 'N/A' AND source_ip <> 'N/A'""")
    q["rpt_requester_labels"] = _s3(req.replace("__N__", "10") + """
SELECT requester_arn || ' (' || source_ip || ')' AS label, request_count AS value
FROM top WHERE requester_arn <> 'N/A' AND source_ip <> 'N/A'""")
    ops = ", ".join(_q(o) for o in lookups.S3_OBJECT_OPERATIONS)
    opq = f"""
top AS (SELECT operation, bucket, key, count(*) AS count FROM s3f
        WHERE operation IN ({ops}) AND key IS NOT NULL AND bucket IS NOT NULL
        GROUP BY operation, bucket, key ORDER BY count DESC, operation, bucket, key LIMIT {{n}})"""
    q["s3_operations"] = _s3(opq.format(n=20) + """
SELECT operation, bucket, coalesce(ltrim(key, '/'), '(root)') AS prefix, count FROM top""")
    q["rpt_operation_labels"] = _s3(opq.format(n=10) + """
SELECT operation || ' - ' || bucket AS label, count AS value FROM top""")
    ua = classify_sql("user_agent", lookups.UA_COARSE_RULES, lookups.UA_COARSE_EMPTY)
    uaq = f"""
c AS (SELECT {ua} AS user_agent_type FROM s3f),
g AS (SELECT user_agent_type, count(*) AS usage_count FROM c GROUP BY user_agent_type),
t AS (SELECT sum(usage_count) AS total FROM g),
top AS (SELECT user_agent_type, usage_count, {pct_sql('usage_count', 'total')} AS usage_pct FROM g, t
        ORDER BY usage_count DESC, user_agent_type LIMIT {{n}})"""
    q["s3_user_agents"] = _s3(uaq.format(n=20) + "\nSELECT * FROM top")
    q["rpt_ua_labels"] = _s3(uaq.format(n=10) + """
SELECT CASE WHEN length(user_agent_type) > 50 THEN substr(user_agent_type, 1, 50) || '...' ELSE user_agent_type END AS chart_label,
       CASE WHEN length(user_agent_type) > 100 THEN substr(user_agent_type, 1, 100) || '...' ELSE user_agent_type END AS table_label,
       usage_count FROM top""")
    tac = _tactics_cte("s3_access_log")
    q["s3_tactics"] = _s3(f"""{tac},
t AS (SELECT count(*) AS total FROM s3f)
SELECT tactic, operation, count(*) AS hit_count, {pct_sql('count(*)', 'max(total)')} AS operation_pct
FROM s3f JOIN tac ON s3f.operation = tac.name, t GROUP BY tactic, operation""")
    q["s3_tactic_events"] = _s3(f"""{tac}
SELECT tactic, request_id, operation, bucket, key, remote_ip, requester,
       strftime(request_datetime, {TS}) AS request_datetime, user_agent, bytes_sent
FROM s3f JOIN tac ON s3f.operation = tac.name""")
    q["rpt_s3_event_preview"] = _s3(f"""{tac}
SELECT tactic, operation, bucket,
       CASE WHEN length(key) > 50 THEN substr(key, 1, 50) || '...' ELSE key END AS key, remote_ip AS source_ip,
       strftime(request_datetime, {TS}) AS timestamp_utc, coalesce(nullif(regexp_extract(original_timestamp, '([+-][0-9]{{4}})\\]', 1), ''), '+0000') AS timezone
FROM s3f JOIN tac ON s3f.operation = tac.name
ORDER BY request_datetime NULLS LAST, request_id NULLS LAST LIMIT 20""")


def _ct_oracles(q: dict) -> None:
    def parse(ext: str) -> str:
        return with_views(OFFSETS + f""",
p AS (SELECT *, CAST(replace(substr(event_time_text, 1, 19), 'T', ' ') AS TIMESTAMP) AS t FROM ct)
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(t, {TS}) AS event_time,
       CASE WHEN aws_region IS NULL THEN NULL
            ELSE strftime(t + to_minutes(CAST(coalesce(offs.minutes, 0) AS BIGINT)), {TS}) END AS event_time_local,
       aws_region, event_name, 'iam.amazonaws.com' AS event_source, source_ip AS source_ip_address,
       nullif(user_agent, '') AS user_agent, error_code, error_message, 'IAMUser' AS user_type, arn AS user_arn,
       '123456789012' AS account_id, user_name, request_parameters AS request_elements, 'true' AS read_only,
       'Management' AS event_category, printf('ct-%04d{ext}', event_id // 50) AS source_file
FROM p LEFT JOIN offs ON p.aws_region = offs.region""", "ct")
    q["ct_parse_records"] = parse(".json")
    q["ct_parse_array"] = parse(".json")
    q["ct_parse_jsonl"] = parse(".jsonl")
    q["ct_identity_wide"] = with_views("""
x AS (SELECT 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, 'IAMUser' AS "userIdentity.type", arn AS "userIdentity.arn",
       '123456789012' AS "userIdentity.accountId", user_name AS "userIdentity.userName",
       '{"attributes":{"mfaAuthenticated":"false"}}' AS "userIdentity.sessionContext"
FROM ct""", "ct")
    q["ct_local_time"] = _ct(f"""
x AS (SELECT 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, aws_region, strftime(event_time, {TS}) AS event_time,
       strftime(event_time_local, {TS}) AS event_time_local FROM ctf""")
    q["ct_top_ips"] = _ct(f"""
x AS (SELECT 1)
SELECT source_ip_address AS ip, strftime(min(event_time), {TS}) AS first_access_utc,
       strftime(min(event_time_local), {TS}) AS first_access_local, strftime(max(event_time), {TS}) AS last_access_utc,
       strftime(max(event_time_local), {TS}) AS last_access_local, count(*) AS access_count
FROM ctf WHERE source_ip_address IS NOT NULL GROUP BY source_ip_address
ORDER BY access_count DESC, ip LIMIT 20""")
    q["ct_night_ips"] = _ct("""
x AS (SELECT 1)
SELECT source_ip_address AS ip, count(*) AS access_count FROM ctf
WHERE (hour(event_time_local) >= 22 OR hour(event_time_local) < 6) AND source_ip_address IS NOT NULL
GROUP BY source_ip_address""")

    def freq(where: str, key_expr: str, key: str, cnt: str, pc: str) -> str:
        return _ct(f"""
base AS (SELECT {key_expr} AS k FROM ctf WHERE {where}),
g AS (SELECT k, count(*) AS n FROM base GROUP BY k),
t AS (SELECT count(*) AS total FROM base)
SELECT k AS {key}, n AS {cnt}, {pct_sql('n', 'total')} AS {pc} FROM g, t WHERE k IS NOT NULL""")

    q["ct_night_events"] = freq("hour(event_time_local) >= 22 OR hour(event_time_local) <= 6", "event_name",
                                "event_name", "nightshift_event_count", "event_pct")
    q["ct_event_names"] = freq("TRUE", "event_name", "event_name", "event_count", "event_pct")
    q["ct_regions"] = freq("TRUE", "aws_region", "region", "event_count", "event_pct")
    q["ct_user_agents"] = freq("TRUE", classify_sql("user_agent", lookups.UA_DETAILED_RULES,
                                                    lookups.UA_DETAILED_EMPTY),
                               "user_agent_type", "usage_count", "usage_pct")
    ua = classify_sql("user_agent", lookups.UA_DETAILED_RULES, lookups.UA_DETAILED_EMPTY)
    q["ct_events_of_ip"] = _ct(f"""
x AS (SELECT 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, source_ip_address, event_name, strftime(event_time, {TS}) AS event_time
FROM ctf WHERE source_ip_address IN ('10.0.1.13', '10.0.3.7', '192.0.2.1')""")
    q["ct_tactics_file"] = _ct("""
f(tactic, name, pos) AS (VALUES ('Alpha', 'GetObject', 1), ('Alpha', 'ListUsers', 2), ('Beta', 'ListUsers', 3), ('Beta', 'CreateUser', 4),
    ('Beta', 'NoSuchEvent', 5), ('Gamma', 'ListUsers', 6)),
p AS (SELECT 'first' AS policy, name, arg_min(tactic, pos) AS tactic FROM f GROUP BY name
      UNION ALL SELECT 'last', name, arg_max(tactic, pos) FROM f GROUP BY name UNION ALL SELECT 'all', name, tactic FROM f),
h AS (SELECT event_name, count(*) AS hit_count FROM ctf GROUP BY event_name),
t AS (SELECT sum(hit_count) AS total FROM h)
SELECT policy, tactic, event_name, hit_count, """ + pct_sql("hit_count", "total") + """ AS event_pct
FROM p JOIN h ON h.event_name = p.name, t""")
    q["rpt_ua_top8"] = _ct(f"""
g AS (SELECT {ua} AS k, count(*) AS n FROM ctf GROUP BY k),
t AS (SELECT sum(n) AS total FROM g)
SELECT k AS user_agent_type, n AS usage_count, {pct_sql('n', 'total')} AS usage_pct FROM g, t
ORDER BY usage_count DESC, user_agent_type LIMIT 8""")
    fails = _failure_sql()
    details = f"""
hits AS ({fails}),
pairs AS (SELECT category, cat_order, 'IPs' AS dimension, source_ip_address AS value FROM hits
          UNION ALL SELECT category, cat_order, 'Users', user_name FROM hits),
d AS (SELECT category, cat_order, dimension, value, count(*) AS count FROM pairs WHERE value IS NOT NULL
      GROUP BY category, cat_order, dimension, value)"""
    q["ct_failed_details"] = _ct(details + """
SELECT category, dimension, value, count FROM d""")
    q["ct_failed_auth"] = _ct(details + """,
present AS (SELECT DISTINCT category FROM hits),
dims AS (SELECT category, dimension FROM present, (VALUES ('IPs'), ('Users')) v(dimension)),
agg AS (SELECT category, dimension, count(*) AS n FROM d GROUP BY category, dimension)
SELECT dims.category || ' - ' || dims.dimension AS category, d.value, coalesce(d.count, 0) AS count,
       coalesce(agg.n, 0) AS distinct_values
FROM dims LEFT JOIN agg ON dims.category = agg.category AND dims.dimension = agg.dimension
LEFT JOIN d ON dims.category = d.category AND dims.dimension = d.dimension""")
    q["ct_failed_preview"] = f"""
WITH f AS ({q['ct_failed_auth']}),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, value) AS rank FROM f)
SELECT category, any_value(distinct_values) AS distinct_values,
       string_agg(CASE WHEN value IS NULL THEN 'N/A' ELSE value || ' (' || count || ')' END, '; ' ORDER BY rank) AS preview
FROM r WHERE rank <= 20 GROUP BY category"""
    q["ct_failed_events"] = _ct(f"""
hits AS ({_failure_sql(lookups.FAILURE_EVENT_CATEGORY_NAMES)})
SELECT category, strftime(event_time, {TS}) AS failure_time, source_ip_address AS failure_ip,
       user_name AS failure_user, '123456789012' AS failure_account, error_code AS failure_type,
       error_message AS failure_message, event_name, CAST(event_id AS VARCHAR) AS event_id
FROM hits""")

    def logins(where: str) -> str:
        return f"""
l AS (SELECT user_name AS user, strftime(event_time, {TS}) AS event_time_utc,
             strftime(event_time_local, {TS}) AS event_time_local, source_ip_address AS source_ip,
             aws_region AS region,
             CASE WHEN error_code IS NOT NULL AND error_code <> '' THEN 'Failed' ELSE 'Success' END AS login_status,
             user_agent
      FROM ctf WHERE event_name = 'ConsoleLogin' AND user_name IS NOT NULL AND user_name <> ''
                 AND user_name <> 'Unknown' AND {where})"""

    q["ct_console_login"] = _ct(logins("TRUE") + "\nSELECT * FROM l")
    q["ct_console_login_recent"] = _ct(logins("event_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
                                       + "\nSELECT * FROM l")
    q["rpt_login_status"] = _ct(logins("event_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY") + """
SELECT login_status, count(*) AS count FROM l GROUP BY login_status""")
    created = f"""
c AS (SELECT coalesce(json_extract_string(TRY_CAST(request_elements AS JSON), '$.userName'), 'Unknown') AS created_user,
             user_arn AS created_by_arn, strftime(event_time, {TS}) AS event_time_utc,
             strftime(event_time_local, {TS}) AS event_time_local, source_ip_address AS source_ip, aws_region AS region
      FROM ctf WHERE event_name = 'CreateUser')"""
    q["ct_create_user"] = _ct(created + "\nSELECT * FROM c")
    q["rpt_creators"] = _ct(created + """
SELECT created_by_arn, count(*) AS count FROM c WHERE created_by_arn IS NOT NULL GROUP BY created_by_arn
ORDER BY count DESC, created_by_arn LIMIT 10""")
    tac = _tactics_cte("cloudtrail")
    hits = f"""{tac},
t AS (SELECT count(*) AS total FROM ctf),
h AS (SELECT tactic, event_name, count(*) AS hit_count, {pct_sql('count(*)', 'max(total)')} AS event_pct
      FROM ctf JOIN tac ON ctf.event_name = tac.name, t GROUP BY tactic, event_name)"""
    q["ct_tactics"] = _ct(hits + "\nSELECT * FROM h")
    q["rpt_tactic_totals"] = _ct(hits + """
SELECT tactic, CAST(sum(hit_count) AS BIGINT) AS total_hits FROM h GROUP BY tactic
ORDER BY total_hits DESC, tactic LIMIT 8""")
    q["ct_tactic_events"] = _ct(f"""{tac}
SELECT tactic, CAST(event_id AS VARCHAR) AS event_id, event_name, strftime(event_time, {TS}) AS event_time,
       source_ip_address, aws_region
FROM ctf JOIN tac ON ctf.event_name = tac.name""")


def _summary_oracle(q: dict) -> None:
    q["run_summary"] = with_views("""
x AS (SELECT 1)
SELECT 'cloudtrail' AS log_type, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no data' END AS status,
       count(*) AS parsed_events FROM ct
UNION ALL SELECT 'vpc', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no data' END, count(*) FROM vpc
UNION ALL SELECT 's3', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no data' END, count(*) FROM s3""", "ct", "vpc", "s3")


def _pipeline_oracles(q: dict) -> None:
    # parsing raw text is lossless for the fields these reports use
    for pipeline, direct in (("vpc_pipeline_top_connections", "vpc_top_connections"),
                             ("vpc_pipeline_night_remote", "vpc_night_remote"),
                             ("s3_pipeline_requesters", "s3_requesters"), ("s3_pipeline_tactics", "s3_tactics"),
                             ("ct_pipeline_failed_auth", "ct_failed_auth"),
                             ("ct_pipeline_night_events", "ct_night_events"),
                             # other ways to the same tables
                             ("vpc_top_connections_tput", "vpc_top_connections"), ("vpc_top_ips_tput", "vpc_top_ips"),
                             ("ct_top_ips_tput", "ct_top_ips"), ("s3_requesters_tput", "s3_requesters"),
                             ("ct_top_ips_incremental", "ct_top_ips"), ("ct_tactics_incremental", "ct_tactics"),
                             ("vpc_top_connections_incremental", "vpc_top_connections"),
                             ("s3_operations_incremental", "s3_operations"), ("ct_night_ips_landed", "ct_night_ips"),
                             ("ct_night_events_landed", "ct_night_events"), ("vpc_night_remote_landed", "vpc_night_remote")):
        q[pipeline] = q[direct]


def _without_file(sql: str) -> str:
    return f"SELECT * EXCLUDE (source_file) FROM ({sql})"


def _exported(columns: dict[str, str]) -> str:
    """Export columns (name -> SQL) with NULL as '', and their order."""
    parts = [f"coalesce({sql}, '') AS \"{name}\"" for name, sql in columns.items()]
    return ", ".join([*parts, f"{_q('|'.join(columns))} AS column_order"])


def _source_oracles(q: dict) -> None:
    q["ct_parse_dupkeys"] = q["ct_parse_bad_record"] = q["ct_parse_records"]
    q["ct_parse_single"] = (f"SELECT * EXCLUDE (source_file), 'ct-' || event_id || '.json' AS source_file FROM ({q['ct_parse_records']})")
    for name, parsed in (("vpc_files", "vpc_parse_lines"), ("vpc_files_gzip", "vpc_parse_lines"), ("load_vpc", "vpc_parse_lines"),
                         ("load_vpc_csv", "vpc_parse_lines"), ("s3_files", "s3_parse_lines"), ("s3_files_gzip", "s3_parse_lines"),
                         ("load_s3", "s3_parse_lines"), ("ct_files", "ct_parse_records"), ("ct_files_gzip", "ct_parse_records"), ("ct_files_split", "ct_parse_records"),
                         ("load_cloudtrail", "ct_parse_records")):
        q[name] = _without_file(q[parsed])
    q["ct_files_manifest"] = f"SELECT * FROM ({q['ct_files']}) WHERE substr(event_time, 1, 10) BETWEEN '2024-01-05' AND '2024-01-14'"
    for name, parsed in (("load_cloudtrail_csv", "ct_parse_records"), ("load_s3_csv", "s3_parse_lines"), ("load_s3_csv_legacy", "s3_parse_lines")):
        q[name] = _without_file(q[parsed])
    q["ct_files_lineage"] = f"""SELECT event_id, 'trail-' || replace(substr(event_time, 1, 10), '-', '') || '.json.gz' AS source_file
FROM ({q['ct_parse_records']})"""
    q["s3_time_offsets"] = with_views("""
o AS (SELECT request_id, original_timestamp, split_part(original_timestamp, ' ', 2) AS t FROM s3)
SELECT request_id, original_timestamp, substr(t, 1, 5) AS time_offset FROM o""", "s3")
    q["ct_identity_keys"] = with_views("""
k AS (SELECT unnest(['type', 'arn', 'accountId', 'sessionContext']) AS key FROM ct UNION ALL SELECT 'userName' FROM ct WHERE user_name IS NOT NULL)
SELECT key, count(*) AS events FROM k GROUP BY key""", "ct")
    ident = {"accountId": "'123456789012'", "arn": "user_arn", "type": "'IAMUser'", "userName": "coalesce(user_name, '')"}
    columns = {"eventTime": f"strftime(event_time, {TS})", "eventTimeLocal": f"coalesce(strftime(event_time_local, {TS}), '')",
               "awsRegion": "aws_region", "eventName": "event_name", "eventSource": "'iam.amazonaws.com'", "sourceIpAddress": "source_ip_address",
               "userAgent": "user_agent", "requestElements": "request_elements", "responseElements": "''"}
    columns |= {f"userIdentity.{k}": ident.get(k, "''") for k in sorted(IDENTITY_KEYS)}
    columns |= {"errorCode": "error_code", "errorMessage": "error_message", "eventID": "CAST(event_id AS VARCHAR)", "eventType": "'AwsApiCall'",
                "userIdentity": "''", "sourceFile": "'ct_view'"}
    q["export_cloudtrail"] = _ct("x AS (SELECT 1)\nSELECT " + _exported(columns) + " FROM ctf")
    columns = {"original_timestamp": "original_timestamp", "request_datetime_(UTC+0)": f"strftime(request_datetime, {TS})", "remote_ip": "remote_ip",
               "operation": "operation", "request_uri": "'GET ' || key || ' HTTP/1.1'", "http_status_code": "'200'",
               "bytes_sent": "CAST(bytes_sent AS VARCHAR)", "user_agent": "user_agent", "requester": "requester", "bucket_owner": "bucket_owner",
               "bucket": "bucket", "request_id": "request_id", "key": "key", "error_code": "'-'", "sourceFile": "'s3_view'"}
    q["export_s3"] = _s3("x AS (SELECT 1)\nSELECT " + _exported(columns) + " FROM s3f")
    q["vpc_rejects"] = with_views("""
f AS (SELECT printf('flow-%03d.log', l_orderkey % 64) AS source_file FROM vpc WHERE l_linenumber = 1)
SELECT source_file, reason, count(*) AS rejected
FROM f, (VALUES ('header'), ('comment'), ('too few fields'), ('blank')) v(reason) GROUP BY source_file, reason""", "vpc")
    q["s3_rejects"] = with_views("""
f AS (SELECT printf('access-%02d.log', o_orderkey % 16) AS source_file, o_orderkey, user_agent FROM s3)
SELECT source_file, 'fallback' AS reason, count(*) AS rejected FROM f WHERE user_agent = '-' GROUP BY source_file
UNION ALL
SELECT source_file, reason, count(*) FROM f, (VALUES ('blank'), ('comment')) v(reason) WHERE o_orderkey % 29 = 0
GROUP BY source_file, reason""", "s3")
    q["ct_rejects"] = with_views("""
f AS (SELECT DISTINCT printf('ct-%04d', event_id // 50) AS name FROM ct)
SELECT name || '.json' AS source_file, 'not an object' AS reason, CAST(3 AS BIGINT) AS rejected FROM f
UNION ALL SELECT name || '.jsonl', 'not JSON', CAST(1 AS BIGINT) FROM f""", "ct")
    q["vpc_odd_values"] = with_views("""
o AS (SELECT srcaddr, l_orderkey % 7 AS odd,
             CASE WHEN l_orderkey % 11 = 0 THEN CAST(9223372036854775000 AS HUGEINT) ELSE TRY_CAST(bytes AS BIGINT) END AS bytes FROM vpc),
g AS (SELECT srcaddr, count(*) AS flows, count(*) FILTER (WHERE odd NOT IN (0, 1, 2)) AS timed, count(*) AS ended,
             coalesce(sum(bytes), 0) AS total FROM o GROUP BY srcaddr)
SELECT srcaddr, flows, timed, ended, CASE WHEN total <= 9223372036854775807 THEN CAST(total AS BIGINT) END AS total_bytes FROM g""", "vpc")
    for name, by in (("ct_event_names", "event_count DESC, event_name"), ("ct_tactics", "tactic, hit_count DESC, event_name")):
        q[f"{name}_ordered"] = f"SELECT *, row_number() OVER (ORDER BY {by}) AS position FROM ({q[name]})"


# table of a bundle -> (the query that computes it, rows kept)
_BUNDLES = {
    "cloudtrail": {
        "Access_IP_Statistics_(Top_20)": "ct_top_ips", "Nightshift_IP_Statistics": "ct_night_ips",
        "Nightshift_EventName_Statistics": "ct_night_events", "EventName_Statistics": "ct_event_names",
        "UserAgent_Statistics": "ct_user_agents", "Failed_Auth_Statistics": "ct_failed_auth", "Region_Statistics": "ct_regions",
        "ConsoleLogin_Statistics": "ct_console_login", "CreateUser_Statistics": "ct_create_user", "Mitre_ATTACK_Tactics": "ct_tactics",
        "Mitre_ATTACK_Events": "ct_tactic_events", "Failed_Auth_Events": "ct_failed_events",
        "Report_Login_Status_30d": "rpt_login_status", "Report_Top_Creators": "rpt_creators",
        "Report_Tactic_Totals": "rpt_tactic_totals", "Report_User_Agents": "rpt_ua_top8"},
    "vpc": {
        "Access_IP_Statistics_(Top_20)": "vpc_top_ips", "Port_Protocol_Statistics": "vpc_top_ports",
        "Nightshift_Remote_Access_Events": "vpc_night_remote", "Session_Duration_Statistics": "vpc_session_duration",
        "Connection_Statistics_(Top_20)": "vpc_top_connections", "Report_Session_Hours": "rpt_session_hours",
        "Report_Connections": "rpt_connection_labels", "Report_Ports": "rpt_port_labels"},
    "s3": {
        "Access_IP_Statistics_(Top_20)": "s3_requesters", "Operation_Statistics": "s3_operations",
        "UserAgent_Statistics": "s3_user_agents", "Mitre_ATTACK_Tactics": "s3_tactics", "Mitre_ATTACK_Events": "s3_tactic_events",
        "Report_Requesters": "s3_requesters", "Report_Operations": "rpt_operation_labels",
        "Report_User_Agents": "rpt_ua_labels", "Report_Event_Preview": "rpt_s3_event_preview"},
}


# columns of the row-level tables that their queries show; of the other tables, all
BUNDLE_COLUMNS = {
    ("cloudtrail", "Mitre_ATTACK_Events"): ["tactic", "event_id", "event_name", "event_time", "source_ip_address", "aws_region"],
    ("cloudtrail", "Failed_Auth_Events"): ["category", "failure_time", "failure_ip", "failure_user", "failure_account", "failure_type",
                                           "failure_message", "event_name", "event_id"],
    ("s3", "Mitre_ATTACK_Events"): ["tactic", "request_id", "operation", "bucket", "key", "remote_ip", "requester", "request_datetime",
                                    "user_agent", "bytes_sent"],
}


def _bundle_oracles(q: dict) -> None:
    """Every row of every table as one line of its values, columns A-Z."""
    for log_type, tables in _BUNDLES.items():
        parts = []
        for name, query in tables.items():
            body = q[query]
            if (log_type, name) == ("s3", "Report_Requesters"):          # the first ten of the written table
                body = f"""SELECT requester_arn || ' (' || source_ip || ')' AS label, request_count AS value FROM ({body})
ORDER BY request_count DESC, requester_arn, source_ip LIMIT 10"""
            parts.append(f"""SELECT {_q(name)} AS table_name, array_to_string(list_transform(list_sort(map_entries(
    json_transform(to_json(r), '"MAP(VARCHAR, VARCHAR)"'))), lambda e: e.key || '=' || e.value), '|') AS line FROM ({body}) r""")
        q[f"bundle_{log_type}"] = "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    _vpc_oracles(q)
    _s3_oracles(q)
    _ct_oracles(q)
    _summary_oracle(q)
    _pipeline_oracles(q)
    _source_oracles(q)
    _bundle_oracles(q)
    return q
