"""The same bindings as ``fixtures.py``, as DuckDB CTE bodies for the oracles.

``with_ctes(sql, *names)`` prefixes a query with the CTEs it names (and
their dependencies), in dependency order.
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "product": """SELECT p_partkey//4 AS product_id, p_name AS name, p_type AS category,
        p_retailprice::DECIMAL(12,2)::DECIMAL(18,2) AS base_price, 'img/p'||(p_partkey//4) AS image_url
        FROM part WHERE p_partkey%4=0""",
    "variant": """SELECT p_partkey//4 AS product_id, 'SKU-'||p_partkey AS sku, p_brand AS color, p_size::VARCHAR AS size,
        CASE WHEN p_partkey%5<>0 THEN p_retailprice::DECIMAL(12,2)::DECIMAL(18,2) END AS price,
        CASE WHEN p_partkey%3<>0 THEN 'img/v'||p_partkey END AS image_url,
        CASE WHEN p_partkey%7<>0 THEN p_partkey%11<>0 END AS is_active
        FROM part WHERE p_partkey%40<>7""",
    "image": """SELECT 'SKU-'||p_partkey AS sku, 'g/'||p_partkey||'/'||i AS url
        FROM part, range(3) t(i) WHERE i < p_partkey%3""",
    "variant_req": """SELECT p_partkey//4 AS product_id, 'SKU-'||p_partkey AS sku, 'new-'||p_brand AS color,
        p_size::VARCHAR AS size,
        CASE WHEN p_partkey%2=0 THEN (p_retailprice::DECIMAL(12,2)*1.1)::DECIMAL(18,2) END AS price,
        CASE WHEN p_partkey%6=0 THEN 'new-img/'||p_partkey END AS image_url,
        CASE WHEN p_partkey%7<2 THEN p_partkey%7=0 END AS is_active,
        CASE p_partkey%3 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['n/'||p_partkey||'/1', 'n/'||p_partkey||'/0'] END AS gallery,
        (p_partkey%300 - 20)::INT AS initial_quantity
        FROM part WHERE p_partkey%4<>1 AND (p_partkey//4)%10<>0""",
    "product_req": """SELECT p_partkey//4 AS product_id, (p_partkey//4)%10<>0 AS has_list,
        CASE WHEN (p_partkey//4)%4=0 THEN 'renamed-'||(p_partkey//4) END AS name,
        CASE WHEN (p_partkey//4)%5=0 THEN (p_retailprice::DECIMAL(12,2)*2)::DECIMAL(18,2) END AS base_price,
        CASE WHEN (p_partkey//4)%6=0 THEN 'img/new'||(p_partkey//4) END AS image_url
        FROM part WHERE p_partkey%4=0""",
    "product_feed": """SELECT v AS seq,
        CASE WHEN v=1 THEN CASE WHEN p_partkey%500=4 THEN TIMESTAMP '2024-01-12' WHEN p_partkey%10=3 THEN TIMESTAMP '1996-03-01'
                                ELSE TIMESTAMP '1990-01-01' END
             WHEN v=2 THEN TIMESTAMP '1998-06-01' + to_days((p_partkey%30)::INT)
             ELSE TIMESTAMP '2024-01-08' + to_days((p_partkey%5*5)::INT) END AS ts,
        'SKU-'||p_partkey AS sku, p_name AS name,
        (CASE v WHEN 1 THEN p_retailprice::DECIMAL(12,2)::DECIMAL(18,2)
                WHEN 2 THEN (p_retailprice::DECIMAL(12,2)*1.1)::DECIMAL(18,2)
                ELSE (p_retailprice::DECIMAL(12,2)*1.2)::DECIMAL(18,2) END)::DECIMAL(18,2) AS price,
        p_brand AS color, p_size::VARCHAR AS size,
        CASE WHEN p_partkey%3<>0 THEN 'img/v'||p_partkey END AS image_url
        FROM part, range(1,4) t(v) WHERE p_partkey%100<>99
          AND (v=1 OR (v=2 AND p_partkey%2=0 AND p_partkey%500<>4) OR (v=3 AND p_partkey%7<5))""",
    "lines": """SELECT l_orderkey::VARCHAR AS order_number, 'SKU-'||l_partkey AS sku, l_quantity::INT AS qty,
        o_orderdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "changes": """SELECT 'SKU-'||p_partkey AS sku, greatest(0, p_size*20-100)::BIGINT AS chg,
        TIMESTAMP '1970-01-01' AS ts, 0::BIGINT AS l_orderkey, 0::INT AS l_linenumber, 0::BIGINT AS l_suppkey,
        'created' AS source FROM part
        UNION ALL SELECT 'SKU-'||l_partkey, (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -2 ELSE -1 END*l_quantity)::BIGINT,
        l_shipdate, l_orderkey, l_linenumber, l_suppkey, 'adjustment'
        FROM lineitem""",
    "flow_changes": """SELECT 'SKU-'||p_partkey AS sku, (p_size*6)::BIGINT AS chg, TIMESTAMP '1970-01-01' AS ts,
        0::BIGINT AS l_orderkey, 0::INT AS l_linenumber, 0::BIGINT AS l_suppkey FROM part
        UNION ALL SELECT 'SKU-'||l_partkey, (CASE l_returnflag WHEN 'A' THEN -1 ELSE 1 END*l_quantity)::BIGINT, l_shipdate,
        l_orderkey, l_linenumber, l_suppkey FROM lineitem""",
    "opening": """SELECT 'SKU-'||p_partkey AS sku, (p_size*20)::BIGINT AS stock FROM part WHERE p_partkey%50<>7""",
    "results": """SELECT order_number, sku, qty<=45 AS success,
        CASE WHEN qty>45 THEN 'Not enough stock for '||sku END AS reason,
        ts + to_seconds((l_linenumber*211 + l_partkey)%640) AS ts, l_linenumber, l_partkey, l_suppkey, qty
        FROM (SELECT l_orderkey::VARCHAR AS order_number, 'SKU-'||l_partkey AS sku, l_quantity::INT AS qty, o_orderdate AS ts,
              l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "order_items": """SELECT o_orderkey::VARCHAR AS order_number, o_orderdate AS created,
        (count(l_orderkey) + (o_orderkey%10=0)::INT)::BIGINT AS total_items
        FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey, o_orderdate""",
    "status_log": """SELECT o_orderkey::VARCHAR AS order_number, 'VALIDATED' AS kind, o_orderdate + INTERVAL 24 HOUR AS ts
        FROM orders WHERE o_orderkey%3<>0
        UNION ALL SELECT o_orderkey::VARCHAR, 'FAILED', o_orderdate + INTERVAL 36 HOUR FROM orders WHERE o_orderkey%5=0
        UNION ALL SELECT o_orderkey::VARCHAR, CASE o_orderstatus WHEN 'F' THEN 'PAID' ELSE 'PAY_FAILED' END,
        o_orderdate + CASE WHEN o_orderkey%7=0 THEN INTERVAL 12 HOUR ELSE INTERVAL 48 HOUR END
        FROM orders WHERE o_orderstatus<>'O'
        UNION ALL SELECT 'X'||o_orderkey, 'PAID', o_orderdate FROM orders WHERE o_orderkey%100=0""",
    "placed": """SELECT o_orderkey::VARCHAR AS order_number, o_custkey AS user_id, o_orderdate AS ts FROM orders""",
    "cart_ev": """SELECT user_id, ts, event_id,
        CASE event_type WHEN 'click' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'checkout' END AS kind,
        'SKU-'||(event_id%5) AS sku, (1+event_id%3)::INT AS qty
        FROM events WHERE event_type IN ('click','error','purchase')""",
    "user_patch": """SELECT user_id, ts, event_id, event_type='signup' AS is_register, (event_type='purchase' AND event_id%20=0) AS is_delete,
        CASE WHEN event_type='signup' OR (event_type='view' AND event_id%3=0) THEN 'user '||event_id END AS full_name,
        CASE WHEN event_type='signup' OR (event_type='click' AND event_id%4=0) THEN 'u'||event_id||'@example.com' END AS email,
        CASE WHEN event_type='click' OR (event_type='purchase' AND event_id%20<>0) THEN '+84-'||event_id END AS phone,
        CASE event_type WHEN 'view' THEN 'addr-'||event_id END AS address,
        CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS enabled
        FROM events""",
    "adjust_raw": """SELECT event_id, ts, CASE event_id%10 WHEN 0 THEN '{"adjustmentQuantity":5}'
        WHEN 1 THEN '{"skuCode":"SKU-'||event_id%2000||'"}'
        WHEN 2 THEN '{"skuCode":"SKU-1","adjustmentQuantity":"abc"}'
        WHEN 3 THEN '{"skuCode":"SKU-1","adjustmentQuantity":0}'
        WHEN 4 THEN '{broken'
        ELSE '{"skuCode":"SKU-'||event_id%2000||'","adjustmentQuantity":'||(value-100)::INT||'}' END AS body
        FROM events""",
    "payload_raw": """SELECT event_id, CASE event_id%4 WHEN 0 THEN '#@1'||props WHEN 1 THEN props
        WHEN 2 THEN NULL ELSE 'no brace' END AS raw FROM events""",
}

# Derived CTEs shared by several oracles (each may use the bindings above).
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "product_latest": ("""SELECT sku, max(seq) AS seq, arg_max(name, seq) AS name, arg_max(price, seq) AS price,
        arg_max(color, seq) AS color, arg_max(size, seq) AS size, arg_max(image_url, seq) AS image_url
        FROM product_feed GROUP BY sku""", ("product_feed",)),
    "product_span": ("""SELECT *, lead(ts) OVER (PARTITION BY sku ORDER BY ts, seq) AS until FROM product_feed""",
                     ("product_feed",)),
    "priced": ("""SELECT l.*, pl.price, pl.name AS product_name, pl.color, pl.size, pl.sku IS NOT NULL AS found
        FROM lines l LEFT JOIN product_span pl ON l.sku = pl.sku AND pl.ts <= l.ts AND (pl.until IS NULL OR l.ts < pl.until)""",
               ("lines", "product_span")),
    "saved": ("""SELECT * FROM placed WHERE order_number NOT IN (SELECT order_number FROM rejected)""",
              ("placed", "rejected")),
    "rejected": ("""SELECT DISTINCT order_number FROM priced WHERE NOT found""", ("priced",)),
    "accepted_lines": ("""SELECT * FROM priced WHERE order_number NOT IN (SELECT order_number FROM rejected)""",
                       ("priced", "rejected")),
    "flow_requests": ("""SELECT * FROM lines WHERE order_number NOT IN (SELECT order_number FROM rejected)""", ("lines", "rejected")),
    "flow_payments": ("""SELECT order_number, min(ts) AS ts, arg_min(kind, (ts, kind)) AS kind
        FROM (SELECT l.* FROM status_log l JOIN saved p ON p.order_number = l.order_number AND l.ts >= p.ts
              WHERE l.kind IN ('PAID', 'PAY_FAILED')) GROUP BY order_number""", ("status_log", "saved")),
    "flow_restocks": ("""SELECT r.order_number, r.sku, r.qty::BIGINT AS chg, p.ts, r.l_orderkey, r.l_linenumber, r.l_suppkey
        FROM flow_requests r JOIN flow_payments p USING (order_number) WHERE p.kind = 'PAY_FAILED'""",
                      ("flow_requests", "flow_payments")),
    "status_agg": ("""SELECT order_number,
        min(ts) FILTER (WHERE kind='VALIDATED') AS v_ts,
        min(ts) FILTER (WHERE kind='FAILED') AS f_ts,
        min(ts) FILTER (WHERE kind IN ('PAID','PAY_FAILED')) AS p_ts,
        arg_min(kind, ts) FILTER (WHERE kind IN ('PAID','PAY_FAILED')) AS p_kind
        FROM (SELECT l.order_number, l.kind, l.ts FROM status_log l JOIN saved p ON p.order_number = l.order_number AND l.ts >= p.ts)
        GROUP BY order_number""", ("status_log", "saved")),
    "status_final": ("""SELECT p.order_number, p.ts AS placed_ts, a.v_ts,
        CASE WHEN a.f_ts IS NOT NULL AND (a.v_ts IS NULL OR a.f_ts <= a.v_ts)
                  AND (a.p_ts IS NULL OR a.f_ts <= a.p_ts) THEN 'FAILED'
             WHEN a.p_ts IS NOT NULL THEN CASE a.p_kind WHEN 'PAID' THEN 'COMPLETED' ELSE 'PAYMENT_FAILED' END
        END AS term_status,
        CASE WHEN a.f_ts IS NOT NULL AND (a.v_ts IS NULL OR a.f_ts <= a.v_ts)
                  AND (a.p_ts IS NULL OR a.f_ts <= a.p_ts) THEN a.f_ts
             ELSE a.p_ts END AS term_ts
        FROM saved p LEFT JOIN status_agg a ON p.order_number = a.order_number""", ("saved", "status_agg")),
    "transitions": ("""SELECT order_number, 'PENDING' AS status, placed_ts AS ts FROM status_final
        UNION ALL SELECT order_number, 'VALIDATED', v_ts FROM status_final
          WHERE v_ts IS NOT NULL AND (term_ts IS NULL OR v_ts < term_ts)
        UNION ALL SELECT order_number, term_status, term_ts FROM status_final WHERE term_status IS NOT NULL""",
                    ("status_final",)),
    "arrivals": ("""SELECT r.*, o.total_items, coalesce(r.ts <= o.created + INTERVAL 600 SECOND, false) AS alive,
          row_number() OVER (PARTITION BY r.order_number ORDER BY r.ts, l_linenumber, l_partkey, l_suppkey, qty) AS n
        FROM (SELECT order_number, sku, success, l_linenumber, l_partkey, l_suppkey, qty, min(ts) AS ts, min(reason) AS reason
              FROM results GROUP BY ALL) r LEFT JOIN order_items o USING (order_number)""", ("results", "order_items")),
    "outcome": ("""SELECT order_number, CASE WHEN ok THEN 'VALIDATED' WHEN failed_at IS NOT NULL THEN 'FAILED' ELSE 'PENDING' END AS outcome,
          CASE WHEN NOT ok AND failed_at IS NOT NULL THEN first_reason END AS reason,
          (CASE WHEN ok THEN total_items ELSE within END)::BIGINT AS received, total_items::BIGINT AS total_items
        FROM (SELECT *, total_items >= 1 AND within >= total_items AND coalesce(failed_at > total_items, true) AS ok
              FROM (SELECT oi.order_number, oi.total_items, coalesce(a.within, 0) AS within, a.failed_at, a.first_reason
                    FROM order_items oi LEFT JOIN (
                      SELECT order_number, count(*) FILTER (WHERE alive) AS within, min(n) FILTER (WHERE NOT success) AS failed_at,
                        arg_min(reason, n) FILTER (WHERE NOT success) AS first_reason
                      FROM arrivals GROUP BY order_number) a USING (order_number)))""", ("arrivals", "order_items")),
    "failure_events": ("""SELECT order_number, arg_min(reason, n) AS reason, min(ts) AS ts FROM arrivals WHERE NOT success
        GROUP BY order_number, alive""", ("arrivals",)),
}


def _collect(names, out, seen):
    for n in names:
        if n in seen:
            continue
        if n in DERIVED:
            _collect(DERIVED[n][1], out, seen)
            body = DERIVED[n][0]
        else:
            body = CTES[n]
        seen.add(n)
        out.append(f"{n} AS ({body})")


def with_ctes(sql: str, *names: str) -> str:
    parts: list[str] = []
    _collect(names, parts, set())
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
