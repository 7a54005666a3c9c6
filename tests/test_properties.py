"""Property tests: parse(format(row)) == row, and aggregate invariants."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift import lookups as _lk
from logsift.operators import vpc
from logsift.schemas import VPC_SCHEMA
from logsift.sources.vpc import parse_vpc_lines

# Spark jobs are slow per example: few examples, no shrinking (a failure is reported as found)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck),
                    phases=[Phase.explicit, Phase.reuse, Phase.generate])

ip = st.one_of(st.just("-"), st.tuples(*[st.integers(0, 255)] * 4).map(lambda t: ".".join(map(str, t))))
num = st.one_of(st.just(None), st.integers(0, 10**12))
flow = st.tuples(ip, ip, num, num, st.one_of(st.just(None), st.integers(0, 255)), num, num,
                 st.integers(1_600_000_000, 1_800_000_000), st.integers(0, 3600),
                 st.sampled_from(["ACCEPT", "REJECT", "-"]), st.sampled_from(["OK", "NODATA", "SKIPDATA"]))
sep = st.sampled_from([" ", "  ", "\t", " \t "])


def _text(v):
    return "-" if v is None else str(v)


def _key(t):
    return tuple((0, "") if v is None else (1, v) if isinstance(v, int) else (2, v) for v in t)


@SETTINGS
@given(rows=st.lists(st.tuples(flow, sep, sep), min_size=1, max_size=30))
def test_vpc_parse_format_round_trip(spark, rows):
    lines = []
    for f, s1, s2 in rows:
        src, dst, sp, dp, proto, pk, by, start, dur, action, status = f
        fields = ["2", "123456789012", "eni-1", src, dst, _text(sp), _text(dp), _text(proto), _text(pk), _text(by),
                  str(start), str(start + dur), action, status]
        lines.append((s1 + s2.join(fields) + s1, "f.log"))
    parsed = parse_vpc_lines(spark.createDataFrame(lines, "value string, source_file string"))
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    out = parsed.select("srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes",
                        (epoch("window_end") - epoch("window_start")).alias("dur"), "action", "flow_log_status")
    got = sorted((tuple(r) for r in out.collect()), key=_key)
    want = sorted(((f[0], f[1], f[2], f[3], f[4], f[5], f[6], f[8], f[9], f[10]) for f, _, _ in rows), key=_key)
    assert got == want


def _frame(spark, rows):
    base = {f.name: None for f in VPC_SCHEMA.fields}
    data = [tuple({**base, "srcaddr": s, "dstaddr": d, "bytes": b, "packets": p}[f.name] for f in VPC_SCHEMA.fields)
            for s, d, b, p in rows]
    return spark.createDataFrame(data, VPC_SCHEMA)


small_ip = st.sampled_from(["a", "b", "c", "-", None])
small_num = st.one_of(st.just(None), st.integers(0, 50))


@SETTINGS
@given(rows=st.lists(st.tuples(small_ip, small_ip, small_num, small_num), min_size=0, max_size=60),
       n=st.integers(1, 6))
def test_connection_counts_and_top_n_prefix(spark, rows, n):
    df = _frame(spark, rows)
    full = vpc.vpc_top_connections(df, None).collect()
    keyed = [r for r in rows if r[0] is not None and r[1] is not None]
    assert sum(r.flow_count for r in full) == len(keyed)
    assert sum(r.total_bytes for r in full) == sum(r[2] or 0 for r in keyed)
    top = vpc.vpc_top_connections(df, n).collect()
    assert top == full[:n]
    ips = vpc.vpc_top_ips(df, None).collect()
    assert sum(r.total_bytes for r in ips) == sum(r[2] or 0 for r in rows if r[0] is not None) + \
        sum(r[2] or 0 for r in rows if r[1] is not None)


# ---------------------------------------------------------------------------
# percentages: exact half-even, as Python rounds an exact fraction
# ---------------------------------------------------------------------------

@SETTINGS
@given(pairs=st.lists(st.integers(1, 10**9).flatmap(lambda t: st.tuples(st.integers(0, t), st.just(t))),
                      min_size=1, max_size=40))
def test_pct_is_exact_half_even(spark, pairs):
    from fractions import Fraction

    from logsift.functions.common import pct
    pairs = pairs + [(1, 8), (3, 8), (1, 16), (5, 16), (1, 3), (2, 3)]   # exact ties and repeating decimals
    df = spark.createDataFrame(pairs, "n long, t long")
    got = [r.p for r in df.select(pct("n", "t").alias("p")).collect()]
    want = [float(round(Fraction(n * 100, t), 2)) for n, t in pairs]
    assert got == want


# ---------------------------------------------------------------------------
# S3 access logs: full grammar and the bracket-aware fallback
# ---------------------------------------------------------------------------

word = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-_./:", min_size=1, max_size=12)
quoted = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789 -_./;()", min_size=0, max_size=20)
s3_num = st.one_of(st.just(None), st.integers(0, 10**12))
s3_time = st.tuples(st.integers(1, 28), st.sampled_from(["Jan", "Feb", "Oct", "Dec"]), st.integers(2019, 2026),
                    st.integers(0, 23), st.integers(0, 59), st.integers(0, 59),
                    st.sampled_from(["+0000", "-0700", "+0930"]))
s3_rec = st.tuples(word, word, s3_time, word, word, word, word, word, quoted, st.sampled_from(["200", "403", "-"]),
                   word, s3_num, s3_num, s3_num, s3_num, quoted, quoted, st.booleans())
_MONTHS = {"Jan": 1, "Feb": 2, "Oct": 10, "Dec": 12}


def _s3_utc(t):
    import datetime as dt
    d, mon, y, hh, mm, ss, off = t
    local = dt.datetime(y, _MONTHS[mon], d, hh, mm, ss)
    sign = 1 if off[0] == "+" else -1
    return local - sign * dt.timedelta(hours=int(off[1:3]), minutes=int(off[3:]))


@SETTINGS
@given(recs=st.lists(s3_rec, min_size=1, max_size=25))
def test_s3_parse_format_round_trip(spark, recs):
    from logsift.sources.s3 import parse_s3_lines
    lines, want = [], []
    for r in recs:
        owner, bucket, t, ip, req, rid, op, key, uri, status, err, sent, size, total, tat, ref, ua, short = r
        ts = "[%02d/%s/%d:%02d:%02d:%02d %s]" % t
        head = [owner, bucket, ts, ip, req, rid, op, key]
        nums = [_text(sent), _text(size), _text(total), _text(tat)]
        if short:
            # fallback form: no quotes, stops after the request-id/operation block
            lines.append((" ".join(head + ["-", status, err] + nums[:1]), "a.log"))
            want.append((owner, bucket, ip, req, op, key, None if status == "-" else int(status), err, sent,
                         None, None, _s3_utc(t), "fallback"))
        else:
            tail = ["-", "HOSTID", "SigV4", "TLS_AES", "AuthHeader", "s3.amazonaws.com", "TLSv1.3", "-", "-"]
            lines.append((" ".join(head + ['"' + uri + '"', status, err] + nums + ['"' + ref + '"', '"' + ua + '"']
                                   + tail), "a.log"))
            want.append((owner, bucket, ip, req, op, key, None if status == "-" else int(status), err, sent,
                         (ref or None), (ua or None), _s3_utc(t), "full"))
    lines += [("", "a.log"), ("# comment", "a.log")]
    parsed = parse_s3_lines(spark.createDataFrame(lines, "value string, source_file string"))
    got = [tuple(x) for x in parsed.select("bucket_owner", "bucket", "remote_ip", "requester", "operation", "key",
                                           "http_status_code", "error_code", "bytes_sent", "referer", "user_agent",
                                           "request_datetime", "parse_status").collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


# ---------------------------------------------------------------------------
# CloudTrail: every document shape yields every record once
# ---------------------------------------------------------------------------

ct_rec = st.fixed_dictionaries(
    {"eventID": st.uuids().map(str), "eventName": st.sampled_from(["ConsoleLogin", "CreateUser", "GetObject"])},
    optional={"sourceIPAddress": st.sampled_from(["10.0.0.1", "AWS Internal"]),
              "userIdentity": st.fixed_dictionaries({"type": st.just("IAMUser")},
                                                    optional={"userName": st.sampled_from(["alice", "bob"])})})


@SETTINGS
@given(files=st.lists(st.tuples(st.lists(ct_rec, min_size=1, max_size=6),
                                st.sampled_from(["records", "array", "jsonl", "single"])), min_size=1, max_size=6))
def test_cloudtrail_shapes_yield_every_record(spark, files):
    import json

    from logsift.sources.cloudtrail import parse_cloudtrail_docs
    docs, want = [], []
    for i, (recs, shape) in enumerate(files):
        if shape == "single":
            recs = recs[:1]
            text = json.dumps(recs[0], indent=2)
        elif shape == "records":
            text = json.dumps({"Records": recs})
        elif shape == "array":
            text = json.dumps(recs)
        else:
            text = "\n".join(json.dumps(r) for r in recs) + "\n{broken\n"
        docs.append((text, f"f{i}.json"))
        want += [(r["eventID"], r["eventName"], r.get("sourceIPAddress"), r.get("userIdentity", {}).get("userName"),
                  f"f{i}.json") for r in recs]
    parsed = parse_cloudtrail_docs(spark.createDataFrame(docs, "value string, source_file string"))
    got = [tuple(x) for x in parsed.select("event_id", "event_name", "source_ip_address", "user_name",
                                           "source_file").collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


# ---------------------------------------------------------------------------
# user-agent classifiers: first matching rule, as a plain-Python scan would find it
# ---------------------------------------------------------------------------

def _first_match(text, rules):
    for keywords, target in rules:
        if not keywords or any(k in text for k in keywords):
            return _first_match(text, target) if isinstance(target, list) else target
    return None


def _all_keywords(rules):
    out = []
    for keywords, target in rules:
        out += list(keywords)
        if isinstance(target, list):
            out += _all_keywords(target)
    return out



_ua_piece = st.one_of(st.sampled_from(sorted(set(_all_keywords(_lk.UA_DETAILED_RULES)
                                                  + _all_keywords(_lk.UA_COARSE_RULES)))),
                      st.text(alphabet="abcXYZ/ .-()_0123456789", max_size=8))
_ua = st.one_of(st.none(), st.just(""),
                st.lists(_ua_piece, min_size=1, max_size=4).map(lambda p: " ".join(p)),
                st.lists(_ua_piece, min_size=1, max_size=3).map(lambda p: "/".join(p).upper()))


@SETTINGS
@given(agents=st.lists(_ua, min_size=1, max_size=40))
def test_user_agent_classifiers_match_first_rule(spark, agents):
    from logsift.functions.classify import classify_user_agent, classify_user_agent_coarse
    df = spark.createDataFrame([(a,) for a in agents], "ua string")
    got = [(r.d, r.c) for r in df.select(classify_user_agent("ua").alias("d"),
                                         classify_user_agent_coarse("ua").alias("c")).collect()]
    want = [(_lk.UA_DETAILED_EMPTY, _lk.UA_COARSE_EMPTY) if not a else
            (_first_match(a.lower(), _lk.UA_DETAILED_RULES), _first_match(a.lower(), _lk.UA_COARSE_RULES))
            for a in agents]
    assert got == want
