"""DuckDB SQL shared by the oracle queries (the driver's correctness check).

Every oracle reads the pre-registered ``events`` view and rebuilds the same
derived views as ``replaygate.sources.tables`` in plain SQL.
"""

GE = """
ge0 AS (
  SELECT event_id, user_id,
         'u' || CAST(user_id AS VARCHAR) AS client_id,
         event_type,
         CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % (1 + user_id % 100) AS VARCHAR) AS entity_id,
         'usecase_' || event_type AS source_topic,
         ts AS event_ts,
         epoch_us(ts) // 259200 AS us,
         event_id // 1000 AS batch_id,
         value
  FROM events
),
ge AS (
  SELECT *, source_topic AS use_case_id,
         sha256(concat_ws(':', source_topic, client_id, event_type, entity_id)) AS dedup_key
  FROM ge0
)"""


def ge_replay(name: str, topic: str) -> str:
    return f"""
{name} AS (
  SELECT r.*, sha256(concat_ws(':', source_topic, client_id, event_type, entity_id)) AS dedup_key
  FROM (
    SELECT event_id, user_id, 'u' || CAST(user_id AS VARCHAR) AS client_id, event_type,
           CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS entity_id,
           '{topic}' AS source_topic, ts AS event_ts, epoch_us(ts) // 259200 AS us,
           event_id // 1000 AS batch_id, value, copy_no
    FROM events,
         LATERAL (SELECT unnest(range(0, CASE WHEN user_id % 5 = 0 THEN 20 WHEN user_id % 5 = 1 THEN 3 ELSE 1 END)) AS copy_no)
  ) r
)"""


def ratio(dup: str, raw: str) -> str:
    return f"CASE WHEN {raw} = 0 THEN 0.0 ELSE CAST({dup} AS DOUBLE) / CAST({raw} AS DOUBLE) END"


def tier(r: str) -> str:
    risk = f"least(greatest(CAST({r} AS DOUBLE), CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE))"
    return (f"CASE WHEN {risk} < CAST(0.05 AS DOUBLE) THEN 10000 WHEN {risk} < CAST(0.30 AS DOUBLE) THEN 3000 "
            f"WHEN {risk} < CAST(0.70 AS DOUBLE) THEN 500 ELSE 50 END")


def exact_metrics(src: str, name: str = "em") -> str:
    return f"""
{name}_k AS (SELECT source_topic AS use_case_topic, client_id, dedup_key, count(*) AS n FROM {src}
             GROUP BY source_topic, client_id, dedup_key),
{name} AS (
  SELECT use_case_topic, client_id, CAST(sum(n) AS BIGINT) AS raw_events, CAST(count(*) AS BIGINT) AS unique_events,
         CAST(sum(n) - count(*) AS BIGINT) AS duplicate_events,
         {ratio('sum(n) - count(*)', 'sum(n)')} AS duplicate_ratio
  FROM {name}_k GROUP BY use_case_topic, client_id
)"""


BATCH_METRICS = """
bm0 AS (
  SELECT batch_id, source_topic AS use_case_topic, client_id, CAST(count(*) AS BIGINT) AS raw_events,
         CAST(count(DISTINCT dedup_key) AS BIGINT) AS unique_events
  FROM ge GROUP BY batch_id, source_topic, client_id
),
bt AS (SELECT batch_id, max(event_ts) AS batch_time FROM ge GROUP BY batch_id),
bm AS (
  SELECT bm0.batch_id, use_case_topic, client_id, raw_events, unique_events,
         raw_events - unique_events AS duplicate_events,
         """ + ratio("raw_events - unique_events", "raw_events") + """ AS duplicate_ratio, bt.batch_time
  FROM bm0 LEFT JOIN bt ON bm0.batch_id = bt.batch_id
)"""


def token_bucket(src: str, lim: str, name: str = "tb", key: str = "client_id", order: str = "us, event_id",
                 extra: str = "") -> str:
    """Recursive-CTE token bucket in whole numbers of 1/60,000,000 token, event by event.
    ``src`` must have client_id, us, event_id and the columns named in ``lim``/``extra``."""
    extra_sel = (", " + extra) if extra else ""
    extra_e = (", " + ", ".join("e." + c.strip() for c in extra.split(","))) if extra else ""
    take = "t >= 60000000 AS admitted, CASE WHEN t >= 60000000 THEN t - 60000000 ELSE t END AS level"
    return f"""
{name}_ev AS (
  SELECT {key} AS k, us, event_id, CAST({lim} AS INTEGER) AS lim{extra_sel},
         CAST(greatest(CAST({lim} AS INTEGER), 1) AS BIGINT) * 60000000 AS cap,
         row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
  FROM {src}
),
{name}_level AS (
  SELECT k, rn, us, event_id, lim{extra_sel}, {take}
  FROM (SELECT *, cap AS t FROM {name}_ev WHERE rn = 1) a
  UNION ALL
  SELECT k, rn, us, event_id, lim{extra_sel}, {take}
  FROM (
    SELECT e.k, e.rn, e.us, e.event_id, e.lim{extra_e},
           least(e.cap, least({name}_level.level, e.cap) + (e.us - {name}_level.us) * e.lim) AS t
    FROM {name}_level JOIN {name}_ev e ON e.k = {name}_level.k AND e.rn = {name}_level.rn + 1
  ) b
),
{name} AS (
  SELECT k, rn, us, event_id, lim{extra_sel}, admitted, CAST(level AS DOUBLE) / CAST(60000000 AS DOUBLE) AS tok FROM {name}_level
)"""
