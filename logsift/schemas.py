"""Canonical parsed-table schemas, legacy column names and export orders.

Parsed tables are snake_case with explicit types: ids stay strings, ``''``
becomes NULL, ``-`` stays text, times are ``TIMESTAMP_NTZ`` in UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
NTZ = T.TimestampNTZType()

CLOUDTRAIL_COLUMNS = [
    ("event_time", NTZ), ("event_time_local", NTZ), ("aws_region", S), ("event_name", S), ("event_source", S),
    ("source_ip_address", S), ("user_agent", S), ("user_identity", T.MapType(S, S)),
    ("request_elements", S), ("response_elements", S), ("event_type", S), ("event_id", S), ("error_code", S),
    ("error_message", S), ("request_id", S), ("event_category", S), ("read_only", T.BooleanType()),
    ("resources", S), ("service_event_details", S), ("additional_event_data", S), ("api_version", S),
    ("management_event", T.BooleanType()), ("insight_details", S), ("recipient_account_id", S),
    ("session_credential_duration_seconds", S), ("session_issuer", S), ("session_mfa_authenticated", S),
    ("session_context", S), ("tls_details", S), ("vpc_endpoint_id", S), ("addendum", S),
    ("edge_device_details", S), ("event_version", S), ("source_file", S),
]
# convenience projections of user_identity
IDENTITY_COLUMNS = [("user_type", "type"), ("principal_id", "principalId"), ("user_arn", "arn"),
                    ("account_id", "accountId"), ("user_name", "userName")]

# the documented elements of a record's userIdentity
IDENTITY_KEYS = ["type", "userName", "principalId", "arn", "accountId", "accessKeyId", "sessionContext", "invokedBy",
                 "sessionIssuer", "webIdFederationData", "identityProvider", "credentialId", "onBehalfOf", "inScopeOf"]

VPC_COLUMNS = [
    ("version", S), ("account_id", S), ("interface_id", S), ("srcaddr", S), ("dstaddr", S), ("srcport", L),
    ("dstport", L), ("protocol", L), ("packets", L), ("bytes", L), ("window_start", NTZ), ("window_end", NTZ),
    ("action", S), ("flow_log_status", S), ("source_file", S),
]

S3_FIELDS = [
    "bucket_owner", "bucket", "original_timestamp", "remote_ip", "requester", "request_id", "operation", "key",
    "request_uri", "http_status_code", "error_code", "bytes_sent", "object_size", "total_time",
    "turn_around_time", "referer", "user_agent", "version_id", "host_id", "signature_version", "cipher_suite",
    "authentication_type", "host_header", "tls_version", "dash1", "dash2",
]
S3_COLUMNS = [
    ("bucket_owner", S), ("bucket", S), ("original_timestamp", S), ("request_datetime", NTZ), ("remote_ip", S),
    ("requester", S), ("request_id", S), ("operation", S), ("key", S), ("request_uri", S),
    ("http_status_code", T.IntegerType()), ("error_code", S), ("bytes_sent", L), ("object_size", L),
    ("total_time", L), ("turn_around_time", L), ("referer", S), ("user_agent", S), ("version_id", S),
    ("host_id", S), ("signature_version", S), ("cipher_suite", S), ("authentication_type", S),
    ("host_header", S), ("tls_version", S), ("dash1", S), ("dash2", S), ("source_file", S),
    ("parse_status", S), ("extra_fields", S),
]


def struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns])


CLOUDTRAIL_SCHEMA = struct(CLOUDTRAIL_COLUMNS)
VPC_SCHEMA = struct(VPC_COLUMNS)
S3_SCHEMA = struct(S3_COLUMNS)
SCHEMAS = {"cloudtrail": CLOUDTRAIL_SCHEMA, "vpc": VPC_SCHEMA, "s3": S3_SCHEMA}
LOG_TYPES = ("cloudtrail", "vpc", "s3")

# ---------------------------------------------------------------------------
# FIXED VALUES: column names of the original tool's parsed CSV files, and the
# export column order it uses (priority columns, then the rest A-Z, source
# file last).  Needed to read its files and to write compatible exports.
# ---------------------------------------------------------------------------
CLOUDTRAIL_CSV_NAMES = {
    "eventTime": "event_time", "eventTimeLocal": "event_time_local", "awsRegion": "aws_region",
    "eventName": "event_name", "eventSource": "event_source", "sourceIpAddress": "source_ip_address",
    "userAgent": "user_agent", "requestElements": "request_elements", "responseElements": "response_elements",
    "eventType": "event_type", "eventID": "event_id", "errorCode": "error_code", "errorMessage": "error_message",
    "requestID": "request_id", "eventCategory": "event_category", "readOnly": "read_only",
    "resources": "resources", "serviceEventDetails": "service_event_details",
    "additionalEventData": "additional_event_data", "apiVersion": "api_version",
    "managementEvent": "management_event", "insightDetails": "insight_details",
    "recipientAccountId": "recipient_account_id",
    "sessionCredentialDurationSeconds": "session_credential_duration_seconds",
    "sessionIssuer": "session_issuer", "sessionMfaAuthenticated": "session_mfa_authenticated",
    "sessionContext": "session_context", "tlsDetails": "tls_details", "vpcEndpointId": "vpc_endpoint_id",
    "addendum": "addendum", "edgeDeviceDetails": "edge_device_details", "eventVersion": "event_version",
    "sourceFile": "source_file",
}
VPC_CSV_NAMES = {"window_start_(UTC+0)": "window_start", "window_end_(UTC+0)": "window_end",
                 "sourceFile": "source_file"}
S3_CSV_NAMES = {"request_datetime_(UTC+0)": "request_datetime", "sourceFile": "source_file"}

EXPORT_PRIORITY = {
    "cloudtrail": ["eventTime", "eventTimeLocal", "awsRegion", "eventName", "eventSource", "sourceIpAddress",
                   "userAgent", "requestElements", "responseElements"],
    "vpc": ["window_start_(UTC+0)", "window_end_(UTC+0)", "srcaddr", "dstaddr", "srcport", "dstport",
            "protocol", "action", "packets", "bytes", "interface_id", "account_id", "version", "flow_log_status"],
    "s3": ["original_timestamp", "request_datetime_(UTC+0)", "remote_ip", "operation", "request_uri",
           "http_status_code", "bytes_sent", "object_size", "user_agent", "requester", "bucket_owner", "bucket",
           "request_id", "key", "error_code", "total_time", "turn_around_time", "referer", "version_id"],
}
EXPORT_LAST = "sourceFile"
IDENTITY_PREFIX = "userIdentity."

# S3 tagged-event display names (only existing columns are renamed).
S3_EVENT_DISPLAY_NAMES = {
    "operation": "Operation", "bucket": "Bucket", "key": "Key", "remote_ip": "Source IP",
    "request_datetime": "Timestamp (UTC)", "requester": "Requester", "user_agent": "User Agent",
    "request_uri": "Request URI", "http_status_code": "HTTP Status", "error_code": "Error Code",
    "bytes_sent": "Bytes Sent", "object_size": "Object Size", "total_time": "Total Time",
    "turn_around_time": "Turn Around Time", "referer": "Referer",
}
# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


def csv_names(log_type: str) -> dict[str, str]:
    """Original CSV column name -> our column name."""
    return {"cloudtrail": CLOUDTRAIL_CSV_NAMES, "vpc": VPC_CSV_NAMES, "s3": S3_CSV_NAMES}[log_type]


def export_names(log_type: str) -> dict[str, str]:
    """Our column name -> original CSV column name (identity for unchanged names)."""
    inv = {v: k for k, v in csv_names(log_type).items()}
    return {name: inv.get(name, name) for name, _ in {"cloudtrail": CLOUDTRAIL_COLUMNS, "vpc": VPC_COLUMNS,
                                                       "s3": S3_COLUMNS}[log_type]}
