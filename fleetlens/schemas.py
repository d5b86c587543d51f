"""Schemas, as DDL text, of completion records, token tables and the JSON files."""

MESSAGE = "struct<role: string, content: string>"
USAGE = "struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>"

COMPLETION_RECORDS = (
    f"request_id string, timestamp bigint, model_name string, input_messages array<{MESSAGE}>, "
    "output_response string, latency_ms double, prompt_tokens bigint, completion_tokens bigint, "
    "total_tokens bigint, metadata map<string,string>"
)
TOKEN_JOBS = "input_tokens int, output_tokens int"

# File formats.
CHOICES = f"array<struct<index: int, message: {MESSAGE}, finish_reason: string>>"
WIRE_RESPONSE = (
    f"id string, object string, created bigint, model string, choices {CHOICES}, usage {USAGE}"
)
REQUEST = (
    f"model string, messages array<{MESSAGE}>, max_tokens int, "
    "temperature double, top_p double, n int, stream boolean, stop array<string>"
)
# Requests and responses as they were written; the readers type them.
BATCH_INPUT_RAW = "custom_id string, request string"
BATCH_OUTPUT_RAW = "job_id bigint, ordinal bigint, response string, error string"
ACCESS_LOG = (
    "requestId string, apiKeyId string, ip string, caller string, user string, requestTime string, "
    "httpMethod string, resourcePath string, status string, protocol string, responseLength string, "
    "latency string"
)
NODE_SNAPSHOT = (
    "data struct<result: struct<result: array<struct<node_id: string, node_ip: string, node_name: string, "
    "state: string, is_head_node: boolean, resources_total: map<string,double>>>>>"
)
SERVE_SNAPSHOT = (
    "applications map<string, struct<status: string, deployments: map<string, struct<status: string, "
    "replicas: array<struct<replica_id: string, node_id: string, node_ip: string, state: string, "
    "log_file_path: string>>>>>>"
)
USAGE_SNAPSHOT = (
    "data struct<clusterStatus: struct<loadMetricsReport: struct<usage: map<string, array<double>>, "
    "usageByNode: map<string, map<string, array<double>>>>>>"
)
