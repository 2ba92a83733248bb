"""SQL counterparts of the derived tables, as common table expressions."""

from __future__ import annotations

from featlake.functions.timebuckets import BUCKET_EDGES
from featlake.plans.tables import (
    BLOCK_ROWS,
    EVENT_TYPES,
    HISTORY,
    ORDER_HISTORY,
    SEGMENTS,
    STATUSES,
)


def _code(column: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values, start=1))
    return f"(CASE {column} {cases} END)::BIGINT"


EVENTS = f"""ev AS (
  SELECT event_id, user_id, event_type, value,
         json_extract_string(props, '$.k')::BIGINT AS k,
         floor(epoch(ts))::BIGINT AS timestamp,
         {_code('event_type', EVENT_TYPES)} AS type_code,
         (CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN NULL ELSE 0 END)::INTEGER
           AS label_type
  FROM events)"""

ORDERS = f"""od AS (
  SELECT o_orderkey, o_custkey AS user_id, floor(epoch(o_orderdate))::BIGINT AS timestamp,
         substr(o_orderpriority, 1, 1)::BIGINT AS priority, {_code('o_orderstatus', STATUSES)} AS status
  FROM orders)"""

SAMPLES = f"""{EVENTS},
samples AS (
  SELECT ev.event_id, ev.user_id, ev.timestamp, ev.label_type, ev.type_code, ev.k, ev.value,
         c.c_nationkey::BIGINT AS nation, {_code('c.c_mktsegment', SEGMENTS)} AS segment,
         ev.k - 1 AS shifted, ev.event_id // {BLOCK_ROWS} AS block_id
  FROM ev LEFT JOIN customer c ON ev.user_id = c.c_custkey)"""

_FRAME_A = f"(PARTITION BY user_id ORDER BY timestamp, event_id ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)"
HISTORY_A = f"""hist_a AS (
  SELECT event_id, user_id, timestamp,
         coalesce(list(type_code) OVER w, []) AS types,
         coalesce(list(timestamp) OVER w, []) AS times,
         coalesce(list(k) OVER w, []) AS ks
  FROM ev WINDOW w AS {_FRAME_A})"""

EVENT_HISTORY = f"""{EVENTS},
{HISTORY_A}"""

_FRAME_B = f"(PARTITION BY user_id ORDER BY timestamp, o_orderkey ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)"
ORDER_HISTORY_CTE = f"""{ORDERS},
hist_b AS (
  SELECT o_orderkey, user_id, timestamp,
         coalesce(list(status) OVER w, []) AS statuses,
         coalesce(list(timestamp) OVER w, []) AS times,
         coalesce(list(priority) OVER w, []) AS priorities
  FROM od WINDOW w AS {_FRAME_B})"""

WIDE = f"""{SAMPLES},
{HISTORY_A},
{ORDERS},
latest AS (
  SELECT user_id,
         list(timestamp ORDER BY rk DESC) AS b67, list(priority ORDER BY rk DESC) AS b68,
         list(status ORDER BY rk DESC) AS b69
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, o_orderkey DESC) AS rk FROM od)
  WHERE rk <= {ORDER_HISTORY} GROUP BY user_id),
wide AS (
  SELECT s.event_id, s.user_id, s.timestamp, s.label_type,
         s.shifted AS user_int_feats_1, s.nation AS user_int_feats_3, s.segment AS user_int_feats_4,
         list_slice([s.k % 10, s.k % 7 - 1, s.k - 50, s.k], 1, s.k % 5) AS user_int_feats_15,
         list_slice([s.k, 99 - s.k, s.k % 3], 1, s.k % 4) AS user_int_feats_62,
         list_slice([s.value::FLOAT, (s.value / 2)::FLOAT, (-s.value)::FLOAT], 1, s.event_id % 4) AS user_dense_feats_61,
         list_slice([(s.k / 2.0::DOUBLE)::FLOAT, (s.k / 4.0::DOUBLE)::FLOAT, 1.5::FLOAT, 2.5::FLOAT], 1,
                    s.k % 4 + CASE WHEN s.event_id % 11 = 0 THEN 1 ELSE 0 END) AS user_dense_feats_62,
         s.type_code AS item_int_feats_5,
         list_slice([s.k, s.k + 1, s.k + 2], 1, s.k % 3 + 1) AS item_int_feats_11,
         h.types AS domain_a_seq_38, h.times AS domain_a_seq_39, h.ks AS domain_a_seq_40,
         l.b67 AS domain_b_seq_67, l.b68 AS domain_b_seq_68, l.b69 AS domain_b_seq_69
  FROM samples s JOIN hist_a h ON s.event_id = h.event_id LEFT JOIN latest l ON s.user_id = l.user_id)"""

SCORES = f"""{EVENTS},
scores AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE (value - 30) / 50 END AS logit,
         (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INTEGER AS label
  FROM ev)"""

METRIC_HISTORY = """hist AS (
  SELECT user_id AS run, event_id AS step, value AS score, event_type AS note FROM events)"""

MULTIHOT = """multihot AS (
  SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
  FROM lineitem GROUP BY l_orderkey)"""

EMBEDDING_TABLE = """emb AS (
  SELECT vec_id % 2 + 1 AS fid, vec_id // 2 + 1 AS id, embedding AS vec FROM embeddings)"""

EDGES = "[" + ", ".join(str(e) for e in BUCKET_EDGES) + "]::BIGINT[]"


def bucket(sample_time: str, event_time: str) -> str:
    """Bucket id of one event time; nested in a lambda it may name bound variables."""
    elapsed = f"greatest({sample_time} - {event_time}, 0)"
    inside = f"least(len(list_filter({EDGES}, lambda b: b < {elapsed})), {len(BUCKET_EDGES) - 1}) + 1"
    return f"(CASE WHEN coalesce({event_time}, 0) = 0 THEN 0 ELSE {inside} END)"


def pad(column: str, width: int, vocab: int | None = None) -> str:
    """A list cut and padded to ``width``, ids outside the vocabulary zeroed."""
    at = f"({column})[i + 1]"
    upper = "" if vocab is None else f" AND {at} < {vocab}"
    return f"list_transform(range(0, {width}), lambda i: CASE WHEN {at} > 0{upper} THEN {at} ELSE 0 END)"


def used(column: str, width: int) -> str:
    return f"least(coalesce(len({column}), 0), {width})"


def text(column: str) -> str:
    return f"array_to_string({column}, ',')"


def r6(expression: str) -> str:
    return f"round(({expression})::DOUBLE, 6) + 0.0::DOUBLE"


SIGMOID = "CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-abs({x}))) ELSE exp(-abs({x})) / (1 + exp(-abs({x}))) END"


def sigmoid(x: str) -> str:
    return "(" + SIGMOID.format(x=x) + ")"


def bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0::DOUBLE) - {x} * ({y}) + ln(1 + exp(-abs({x}))))"


def focal(x: str, y: str, alpha: float, gamma: float) -> str:
    p = sigmoid(x)
    p_true = f"({p} * {y} + (1 - {p}) * (1 - {y}))"
    weight = f"({alpha}::DOUBLE * {y} + {1 - alpha}::DOUBLE * (1 - {y}))"
    return f"({weight} * pow(1 - {p_true}, {gamma}) * {bce(x, y)})"
