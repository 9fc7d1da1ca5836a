"""The catalog's queries restated as SQL for an independent engine (DuckDB dialect) over the same tables."""

from __future__ import annotations

_FIXTURES = """
lines AS (
  SELECT *, 'SKU-' || lpad(l_partkey::VARCHAR, 12, '0') AS sku,
    ((((l_orderkey * 10 + l_linenumber)::HUGEINT * 100000000000 + l_partkey) * 1000000000 + l_suppkey) * 100
      + l_quantity::INT)::HUGEINT AS seq,
    l_shipdate + to_seconds((l_orderkey % 86400)::INT) AS ev_at,
    'staff-' || (l_suppkey % 7)::VARCHAR AS staff,
    CASE WHEN l_partkey % 3 <> 0 OR l_linestatus <> 'O' THEN 'movement' WHEN l_returnflag = 'N' THEN 'rental'
         WHEN l_returnflag = 'A' THEN 'lifecycle' ELSE 'movement' END AS kind
  FROM lineitem),
fx_items AS (
  SELECT 'SKU-' || lpad(p_partkey::VARCHAR, 12, '0') AS item_sku,
    CASE WHEN p_partkey % 3 = 0 THEN 'Bridal' ELSE 'Bags' END AS shop_code, p_name AS item_name,
    p_brand AS brand_designer, NULL::VARCHAR AS item_image,
    (p_retailprice::DECIMAL(10,2) * (p_size + 40)::DECIMAL(4,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2) AS stock_cost_price,
    CASE WHEN p_partkey % 50 = 7 THEN 0::DECIMAL(10,2) ELSE p_retailprice::DECIMAL(10,2) END AS sell_price,
    p_size AS min_stock_alert,
    CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END AS bag_color,
    CASE WHEN p_partkey % 3 = 0 THEN 'UK ' || (p_size % 12 + 4)::VARCHAR END AS bridal_size
  FROM part),
fx_mov AS (
  SELECT seq AS id, sku AS item_sku,
    CASE WHEN l_discount > 0.095 THEN 'Adjustment' WHEN l_returnflag = 'A' THEN 'New Item'
         WHEN l_returnflag = 'R' THEN 'Restock' ELSE 'Retail Sale' END AS action_type,
    CASE WHEN l_returnflag = 'N' THEN -(l_quantity::INT % 25 + 1) ELSE l_quantity::INT % 10 + 1 END AS quantity_change,
    CASE WHEN l_linenumber <> 2 THEN (p_retailprice::DECIMAL(10,2) * 0.50::DECIMAL(3,2))::DECIMAL(10,2) END AS unit_cost_price,
    CASE WHEN l_linenumber = 3 THEN 'CORRECTION of row #1' END AS notes, ev_at AS created_at, staff AS created_by
  FROM lines JOIN part ON p_partkey = l_partkey WHERE kind = 'movement'),
fx_life AS (
  SELECT seq AS id, sku AS item_sku,
    ['Available', 'In Alteration', 'Dry Cleaning', 'Sold'][l_linenumber % 4 + 1] AS status,
    CASE WHEN l_linenumber = 3 THEN 'HOLD-RECONCILE' END AS notes, ev_at AS occurred_at, staff AS recorded_by
  FROM lines WHERE kind = 'lifecycle'),
fx_cust AS (SELECT c_custkey::VARCHAR AS id, c_name AS display_name FROM customer),
fx_rent AS (
  SELECT seq AS id, sku AS item_sku, o_custkey::VARCHAR AS customer_id, ev_at AS booked_at,
    ev_at::DATE + l_quantity::INT AS due_date,
    CASE WHEN st = 'Returned' THEN ev_at + INTERVAL 3 DAY END AS returned_at,
    l_extendedprice::DECIMAL(10,2) AS rental_price, (1 + l_linenumber % 3)::INT AS quantity, st AS status,
    NULL::VARCHAR AS notes
  FROM (
    SELECT lines.*, o_custkey,
      CASE WHEN l_partkey % 2 = 0 AND row_number() OVER (PARTITION BY sku ORDER BY ev_at DESC, seq DESC) = 1 THEN 'Rented'
           WHEN l_discount > 0.095 THEN 'Cancelled' ELSE 'Returned' END AS st
    FROM lines JOIN orders ON o_orderkey = l_orderkey WHERE kind = 'rental')),
fx_log AS (
  SELECT u.*, i.shop_code AS shop_type, i.item_name, i.brand_designer, i.item_image, i.min_stock_alert, i.bag_color,
    i.bridal_size, coalesce(u.cost, i.stock_cost_price) AS stock_cost_price, coalesce(u.sell, i.sell_price) AS sell_price
  FROM (
    SELECT created_at, id AS seq, item_sku, unit_cost_price AS cost, NULL::DECIMAL(10,2) AS sell, quantity_change,
      NULL::VARCHAR AS bridal_status, NULL::DATE AS rental_due_date, NULL::VARCHAR AS customer_name_contact, action_type, notes
    FROM fx_mov WHERE action_type <> 'Adjustment'
    UNION ALL SELECT occurred_at, id, item_sku, 0, 0, 0, status, NULL, NULL, 'Status Change', notes FROM fx_life
    UNION ALL SELECT booked_at, r.id, item_sku, 0, rental_price, 0, 'Rented', CASE WHEN quantity <> 3 THEN due_date END,
      display_name, 'Rental Out', notes FROM fx_rent r JOIN fx_cust c ON c.id = customer_id
    UNION ALL SELECT returned_at, id, item_sku, 0, 0, 0, 'Returned', NULL, NULL, 'Rental Return', notes
      FROM fx_rent WHERE returned_at IS NOT NULL) u
  JOIN fx_items i USING (item_sku)),
fx_raw AS (
  SELECT event_id AS seq, ts AS created_at,
    CASE WHEN event_id % 37 = 0 THEN 'Shoes' WHEN user_id % 3 = 0 THEN 'Bridal' ELSE 'Bags' END AS shop_type,
    CASE WHEN event_id % 43 = 0 THEN '  ' ELSE ' sku-' || lpad(user_id::VARCHAR, 12, '0') || ' ' END AS item_sku,
    'Item ' || user_id::VARCHAR AS item_name,
    CASE event_id % 5 WHEN 0 THEN '12.50kg' WHEN 1 THEN 'abc' ELSE value::DECIMAL(10,2)::VARCHAR END AS stock_cost_price,
    CASE WHEN event_id % 53 = 0 THEN '-1' ELSE value::DECIMAL(10,2)::VARCHAR END AS sell_price,
    CASE WHEN event_type = 'purchase' THEN '-1' WHEN event_id % 6 = 0 THEN '3.7' ELSE '5' END AS quantity_change,
    CASE WHEN event_id % 4 = 0 THEN '2' END AS quantity,
    CASE event_id % 7 WHEN 0 THEN 'red' WHEN 1 THEN '' END AS bag_color,
    CASE WHEN event_id % 3 = 0 THEN '0' ELSE (event_id % 9)::VARCHAR END AS min_stock_alert,
    CASE WHEN event_id % 17 = 0 THEN 'Lost' ELSE ['Available', 'Rented', '', NULL][event_id % 4 + 1] END AS bridal_status,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '2023-12-31' ELSE '2024-03-01' END AS rental_due_date,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Customer ' || (user_id % 20)::VARCHAR END AS customer_name_contact,
    CASE WHEN event_id % 41 = 0 THEN 'Bogus' ELSE coalesce(MAP {'signup': 'New Item', 'purchase': 'Retail Sale',
      'view': 'Rental Out', 'click': 'Rental Return'}[event_type], 'Status Change') END AS action_type
  FROM events),
fx_elog AS (
  SELECT event_id AS seq, ts AS created_at,
    CASE WHEN (user_id % 3 = 0) <> (event_id % 61 = 0) THEN 'Bridal' ELSE 'Bags' END AS shop_type,
    'SKU-' || lpad(user_id::VARCHAR, 12, '0') AS item_sku,
    (CASE event_type WHEN 'purchase' THEN -(event_id % 6) WHEN 'click' THEN event_id % 2 WHEN 'view' THEN 0
      ELSE event_id % 9 END)::INT AS quantity_change,
    CASE event_id % 4 WHEN 0 THEN 'Available' WHEN 1 THEN 'Rented' END AS bridal_status,
    'Customer ' || (user_id % 20)::VARCHAR AS customer_name_contact,
    coalesce(MAP {'signup': 'New Item', 'purchase': 'Retail Sale', 'view': 'Rental Out',
      'click': 'Rental Return'}[event_type], 'Status Change') AS action_type,
    'staff-' || (event_id % 7)::VARCHAR AS created_by
  FROM events)
"""

_FULL = """
full_items AS (
  SELECT * EXCLUDE (num), num % 4 <> 0 AS is_active,
    CASE WHEN num % 5 <> 0 THEN TIMESTAMP '1991-01-01' + to_seconds((num % 86400)::INT) END AS created_at,
    CASE WHEN num % 7 = 0 THEN TIMESTAMP '1991-01-01' + to_seconds((num % 86400)::INT) END AS updated_at
  FROM (SELECT *, substr(item_sku, 5)::BIGINT AS num FROM fx_items)),
full_cust AS (
  SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey <= 10 THEN 'Customer ' || c_custkey ELSE c_name END AS display_name,
    '+44 ' || c_custkey AS phone, 'c' || c_custkey || '@example.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'regular' END AS notes,
    TIMESTAMP '1991-02-01' AS created_at, 'desk' AS created_by FROM customer),
full_rent AS (SELECT r.*, booked_at AS created_at, staff AS created_by FROM fx_rent r JOIN lines ON lines.seq = r.id)
"""

# What accepted actions leave in tables with all their columns.
_AFTER = """
after_items AS (
  SELECT m.* EXCLUDE (created_at, updated_at, existed), CASE WHEN existed THEN f.is_active ELSE true END AS is_active,
    CASE WHEN existed THEN f.created_at ELSE m.created_at END AS created_at, coalesce(m.updated_at, f.updated_at) AS updated_at
  FROM merged_items m LEFT JOIN full_items f USING (item_sku)),
after_cust AS (
  SELECT * FROM full_cust
  UNION ALL BY NAME SELECT md5(display_name) AS id, display_name, first_at AS created_at, 'till' AS created_by FROM (
    SELECT coalesce(customer_name_contact, 'Walk-in') AS display_name, min(created_at) AS first_at FROM good
    WHERE action_type = 'Rental Out' GROUP BY 1) WHERE display_name NOT IN (SELECT display_name FROM full_cust)),
after_moves AS (
  SELECT * FROM fx_mov UNION ALL BY NAME
  SELECT seq::HUGEINT AS id, item_sku, action_type, quantity_change, stock_cost_price AS unit_cost_price, NULL::VARCHAR AS notes, created_at,
    'till' AS created_by FROM good WHERE action_type IN ('New Item', 'Restock', 'Retail Sale')),
after_life AS (
  SELECT * FROM fx_life UNION ALL BY NAME
  SELECT seq::HUGEINT AS id, item_sku, coalesce(bridal_status, 'Available') AS status, NULL::VARCHAR AS notes, created_at AS occurred_at,
    'till' AS recorded_by FROM good WHERE action_type = 'Status Change'
    OR (action_type = 'Rental Return' AND bridal_status IN ('Available', 'In Alteration', 'Dry Cleaning', 'Sold'))),
every_rent AS (
  SELECT * FROM full_rent UNION ALL BY NAME
  SELECT *, booked_at AS created_at, 'till' AS created_by FROM new_rent),
after_rent AS (
  SELECT a.* REPLACE (coalesce(g.created_at, a.returned_at) AS returned_at, CASE WHEN g.seq IS NOT NULL THEN 'Returned' ELSE a.status END AS status)
  FROM every_rent a LEFT JOIN good g ON g.closes_id = a.id AND g.item_sku = a.item_sku)
"""

# Latest open booking, latest lifecycle status and latest event per SKU, then one row per item.
_LIVE = """
opened AS (
  SELECT * FROM fx_rent WHERE status = 'Rented'
  QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY booked_at DESC, id DESC) = 1),
last_life AS (SELECT * FROM fx_life QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY occurred_at DESC, id DESC) = 1),
status AS (
  SELECT i.item_sku, i.shop_code,
    CASE WHEN o.id IS NOT NULL THEN 'Rented' ELSE coalesce(l.status, 'Available') END AS current_status,
    o.id AS active_rental_id, o.due_date AS rental_due_date, o.customer_id
  FROM fx_items i LEFT JOIN opened o USING (item_sku) LEFT JOIN last_life l USING (item_sku) WHERE i.shop_code = 'Bridal'),
any_event AS (
  SELECT item_sku, 1 AS src, id AS seq, created_at AS at_time, action_type, notes FROM fx_mov
  UNION ALL SELECT item_sku, 2, id, occurred_at, 'Status Change', notes FROM fx_life
  UNION ALL SELECT item_sku, 3, id, booked_at, if(status = 'Rented', 'Rental Out', 'Rental Return'), notes FROM fx_rent),
last_event AS (
  SELECT * FROM any_event QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY at_time DESC, src DESC, seq DESC) = 1),
live AS (
  SELECT i.item_sku AS id, i.item_sku, i.item_name, i.brand_designer, i.item_image, i.shop_code AS shop_type, i.bag_color,
    i.bridal_size, s.current_status AS bridal_status, s.rental_due_date, c.display_name AS customer_name_contact,
    i.min_stock_alert, i.sell_price, i.stock_cost_price, e.action_type AS last_action, e.at_time AS last_updated, e.notes,
    coalesce((SELECT sum(m.quantity_change) FROM fx_mov m WHERE m.item_sku = i.item_sku), 0)::BIGINT AS live_stock,
    ((i.sell_price - i.stock_cost_price) * sold.n + booked.total)::DECIMAL(20,2) AS total_gross_profit,
    (i.sell_price * sold.n + booked.total)::DECIMAL(20,2) AS total_revenue,
    CASE WHEN i.sell_price = 0 THEN 0 ELSE round((i.sell_price - i.stock_cost_price)::DOUBLE / i.sell_price::DOUBLE * 100, 2)
      END::DECIMAL(10,2) AS profit_margin,
    o.quantity AS rental_quantity
  FROM fx_items i
  LEFT JOIN status s ON s.item_sku = i.item_sku
  LEFT JOIN opened o ON o.item_sku = i.item_sku
  LEFT JOIN fx_cust c ON c.id = o.customer_id
  LEFT JOIN last_event e ON e.item_sku = i.item_sku
  LEFT JOIN LATERAL (SELECT count(*) AS n FROM fx_mov m
    WHERE m.item_sku = i.item_sku AND m.action_type IN ('New Item', 'Retail Sale')) sold ON true
  LEFT JOIN LATERAL (SELECT coalesce(sum(r.rental_price), 0) AS total FROM fx_rent r WHERE r.item_sku = i.item_sku) booked ON true),
events_wide AS (
  SELECT m.created_at, 1 AS src, m.id AS seq, m.item_sku, coalesce(m.unit_cost_price, i.stock_cost_price) AS cost,
    i.sell_price AS sell, m.quantity_change, s.current_status AS bridal_status, NULL::DATE AS rental_due_date,
    NULL::VARCHAR AS customer_name_contact, m.action_type, m.notes
  FROM fx_mov m JOIN fx_items i USING (item_sku) LEFT JOIN status s USING (item_sku)
  UNION ALL
  SELECT e.occurred_at, 2, e.id, e.item_sku, i.stock_cost_price, i.sell_price, 0, e.status, NULL, NULL, 'Status Change', e.notes
  FROM fx_life e JOIN fx_items i USING (item_sku)
  UNION ALL
  SELECT r.booked_at, 3, r.id, r.item_sku, 0, r.rental_price, r.quantity, r.status, r.due_date, c.display_name,
    if(r.status = 'Rented', 'Rental Out', 'Rental Return'), r.notes
  FROM fx_rent r JOIN fx_items i USING (item_sku) LEFT JOIN fx_cust c ON c.id = r.customer_id),
hist AS (
  SELECT row_number() OVER (ORDER BY w.created_at, w.src, w.seq) AS id, w.created_at, i.shop_code AS shop_type, w.item_sku,
    i.item_name, i.brand_designer, i.item_image, w.cost::DECIMAL(10,2) AS stock_cost_price, w.sell::DECIMAL(10,2) AS sell_price,
    (w.sell - w.cost)::DECIMAL(10,2) AS gross_profit,
    CASE WHEN w.src = 3 THEN 100 WHEN w.sell = 0 THEN 0 ELSE round((w.sell - w.cost)::DOUBLE / w.sell::DOUBLE * 100, 2)
      END::DECIMAL(10,2) AS profit_margin,
    w.quantity_change, i.bag_color, i.min_stock_alert, i.bridal_size, w.bridal_status, w.rental_due_date,
    w.customer_name_contact, w.action_type, w.notes
  FROM events_wide w JOIN fx_items i USING (item_sku))
"""

_ACTIONS = """
checked AS (
  SELECT *, concat_ws(' ',
    CASE WHEN shop_type NOT IN ('Bags', 'Bridal') THEN 'shop_type must be "Bags" or "Bridal".' END,
    CASE WHEN trim(item_sku) = '' THEN 'item_sku is required.' END,
    CASE WHEN trim(item_name) = '' THEN 'item_name is required.' END,
    CASE WHEN action_type NOT IN ('New Item', 'Restock', 'Retail Sale', 'Rental Out', 'Rental Return', 'Status Change')
      THEN 'action_type is invalid.' END,
    CASE WHEN bridal_status NOT IN ('', 'Available', 'Rented', 'Returned', 'In Alteration', 'Dry Cleaning', 'Sold')
      THEN 'bridal_status is invalid.' END) AS errors
  FROM fx_raw),
typed AS (
  SELECT seq, created_at, shop_type, upper(trim(item_sku)) AS item_sku, item_name, action_type, errors,
    CASE WHEN action_type = 'Rental Out' THEN 0
         ELSE coalesce(try_cast(regexp_extract(stock_cost_price, '^[0-9.-]+') AS DECIMAL(10,2)), 0) END::DECIMAL(10,2) AS stock_cost_price,
    coalesce(try_cast(sell_price AS DECIMAL(10,2)), 0)::DECIMAL(10,2) AS sell_price,
    coalesce(try_cast(regexp_extract(quantity_change, '^-?[0-9]+') AS INT), 0) AS quantity_change,
    coalesce(nullif(try_cast(min_stock_alert AS INT), 0), 2) AS min_stock_alert,
    CASE WHEN quantity::INT > 0 THEN quantity::INT ELSE 1 END AS quantity,
    nullif(bag_color, '') AS bag_color, nullif(bridal_status, '') AS bridal_status,
    nullif(rental_due_date, '') AS rental_due_date, nullif(customer_name_contact, '') AS customer_name_contact
  FROM checked),
-- rules of one row, in the order they are reported
own AS (
  SELECT *, CASE WHEN errors <> '' THEN replace(errors, '. ', '.; ') ELSE concat_ws('; ',
    CASE WHEN sell_price < 0 OR stock_cost_price < 0 THEN 'price below 0' END,
    CASE WHEN action_type = 'Rental Out' AND rental_due_date IS NULL THEN 'due date missing or unreadable' END,
    CASE WHEN action_type = 'Rental Out' AND rental_due_date::DATE < created_at::DATE THEN 'due date before booking' END,
    CASE WHEN action_type = 'Status Change' AND coalesce(bridal_status, 'Available') IN ('Rented', 'Returned')
      THEN 'status not allowed for a lifecycle event' END) END AS problem
  FROM typed),
-- rental actions in sequence: a group starts at every return, and the first booking of a group is the accepted one
steps AS (
  SELECT item_sku, 1 AS phase, created_at, seq::HUGEINT AS id, action_type FROM own
  WHERE problem = '' AND action_type IN ('Rental Out', 'Rental Return')
  UNION ALL SELECT item_sku, 0, booked_at, id, 'Rental Out' FROM fx_rent WHERE status = 'Rented'),
numbered AS (
  SELECT *, count(*) FILTER (WHERE action_type = 'Rental Return')
    OVER (PARTITION BY item_sku ORDER BY phase, created_at, id ROWS UNBOUNDED PRECEDING) AS returns
  FROM steps),
grouped AS (
  SELECT *, CASE WHEN action_type = 'Rental Out' THEN returns ELSE returns - 1 END AS round FROM numbered),
outs AS (
  SELECT *, row_number() OVER (PARTITION BY item_sku, round ORDER BY phase, created_at, id) AS place
  FROM grouped WHERE action_type = 'Rental Out'),
bookings AS (SELECT * FROM outs WHERE place = 1),
decided AS (
  SELECT o.*, CASE WHEN o.problem <> '' THEN o.problem
      WHEN o.action_type = 'Rental Out' AND b.id IS NULL THEN 'open rental exists for this SKU' ELSE '' END AS verdict,
    k.id AS closes_id, k.created_at AS closes_at
  FROM own o
  LEFT JOIN bookings b ON b.phase = 1 AND b.id = o.seq AND b.item_sku = o.item_sku
  LEFT JOIN grouped g ON g.phase = 1 AND g.id = o.seq AND g.item_sku = o.item_sku AND g.action_type = 'Rental Return'
  LEFT JOIN bookings k ON k.item_sku = g.item_sku AND k.round = g.round),
good AS (SELECT * FROM decided WHERE verdict = ''),
new_names AS (
  SELECT DISTINCT coalesce(customer_name_contact, 'Walk-in') AS display_name FROM good WHERE action_type = 'Rental Out'),
all_cust AS (
  SELECT id, display_name FROM fx_cust
  UNION ALL SELECT md5(display_name), display_name FROM new_names WHERE display_name NOT IN (SELECT display_name FROM fx_cust)),
new_rent AS (
  SELECT g.seq::HUGEINT AS id, g.item_sku, c.id AS customer_id, g.created_at AS booked_at, g.rental_due_date::DATE AS due_date,
    NULL::TIMESTAMP AS returned_at, g.sell_price AS rental_price, g.quantity, 'Rented' AS status, NULL::VARCHAR AS notes
  FROM good g JOIN all_cust c ON c.display_name = coalesce(g.customer_name_contact, 'Walk-in') WHERE action_type = 'Rental Out'),
merged_items AS (
  SELECT coalesce(i.item_sku, n.item_sku) AS item_sku, coalesce(i.shop_code, n.shop) AS shop_code,
    coalesce(n.item_name, i.item_name) AS item_name, i.brand_designer, i.item_image,
    coalesce(n.cost, i.stock_cost_price) AS stock_cost_price, coalesce(n.sell, i.sell_price) AS sell_price,
    coalesce(n.alert, i.min_stock_alert) AS min_stock_alert, coalesce(n.color, i.bag_color) AS bag_color, i.bridal_size,
    n.first_at AS created_at, n.last_at AS updated_at, i.item_sku IS NOT NULL AS existed
  FROM fx_items i FULL JOIN (
    SELECT item_sku, arg_min(shop_type, seq) AS shop, arg_max(item_name, seq) AS item_name, arg_max(stock_cost_price, seq) AS cost,
      arg_max(sell_price, seq) AS sell, arg_max(min_stock_alert, seq) AS alert,
      arg_max(bag_color, seq) FILTER (WHERE bag_color IS NOT NULL) AS color,
      min(created_at) AS first_at, max(created_at) AS last_at
    FROM good GROUP BY item_sku) n ON n.item_sku = i.item_sku)
"""

_COUNTS = """
counted AS (
  SELECT l.*, substr(item_sku, 5)::BIGINT AS num,
    CASE substr(item_sku, 5)::BIGINT % 11 WHEN 0 THEN substr(item_sku, 5)::BIGINT % 7 + 1
      WHEN 1 THEN -(substr(item_sku, 5)::BIGINT % 7 + 1) ELSE 0 END AS delta
  FROM live l),
deltas AS (SELECT *, live_stock AS recorded_qty, live_stock + delta AS physical_qty FROM counted WHERE delta <> 0),
pairs AS (
  SELECT *, abs(delta) AS amount, delta > 0 AS over_count,
    row_number() OVER (PARTITION BY shop_type, delta ORDER BY item_sku) AS place,
    count(*) OVER (PARTITION BY shop_type, delta) AS members
  FROM deltas),
matched AS (
  SELECT a.item_sku, a.shop_type, a.delta,
    (SELECT max(b.members) FROM pairs b WHERE b.shop_type = a.shop_type AND b.delta = -a.delta) AS counterparts,
    (SELECT b.item_sku FROM pairs b WHERE b.shop_type = a.shop_type AND b.delta = -a.delta AND b.place = a.place) AS partner_sku
  FROM pairs a)
"""

_ELOG = """
unmatched AS (
  SELECT * FROM fx_elog o WHERE action_type = 'Rental Out' AND NOT EXISTS (
    SELECT 1 FROM fx_elog r WHERE r.item_sku = o.item_sku AND r.action_type = 'Rental Return' AND r.created_at > o.created_at)),
crossed AS (
  SELECT item_sku, count(*) FILTER (WHERE shop_type = 'Bags') AS bags_rows, count(*) FILTER (WHERE shop_type = 'Bridal') AS bridal_rows
  FROM fx_elog GROUP BY item_sku HAVING count(DISTINCT shop_type) = 2),
desync AS (
  SELECT * FROM (
    SELECT item_sku, arg_max(bridal_status, (created_at, seq)) FILTER (WHERE bridal_status IS NOT NULL) AS bridal_status,
      arg_max(action_type, (created_at, seq)) AS last_action
    FROM fx_elog GROUP BY item_sku)
  WHERE (bridal_status = 'Rented' AND last_action = 'Rental Return')
     OR (bridal_status IS DISTINCT FROM 'Rented' AND last_action = 'Rental Out')),
gaps AS (
  SELECT item_sku, action_type, created_at, count(*) AS receipts, count(*) FILTER (WHERE created_by = 'staff-3') AS missing
  FROM fx_mov WHERE action_type = 'Retail Sale' AND created_at > TIMESTAMP '2000-06-01'
  GROUP BY ALL HAVING count(*) FILTER (WHERE created_by = 'staff-3') > 0)
"""

_LOG_TOP = """
log_top AS (SELECT * FROM fx_log QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY created_at DESC, seq DESC) = 1),
last_out AS (
  SELECT *, coalesce(rental_due_date, created_at::DATE + 7) AS due FROM fx_log WHERE action_type = 'Rental Out'
  QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY created_at DESC, seq DESC) = 1),
migrated AS (
  SELECT o.seq AS id, o.item_sku, md5(o.customer_name_contact) AS customer_id, o.created_at AS booked_at, o.due AS due_date,
    (SELECT min(r.created_at) FROM fx_log r WHERE r.item_sku = o.item_sku AND r.action_type = 'Rental Return'
      AND r.created_at > o.created_at) AS returned_at, o.sell_price AS rental_price, o.notes
  FROM last_out o)
"""

# The log moved into tables with all their columns, at a given time by a given user.
_MOVED = """
moved_items AS (
  SELECT item_sku, i.shop_code, coalesce(t.item_name, i.item_name) AS item_name,
    CASE WHEN t.seq IS NULL THEN i.brand_designer ELSE t.brand_designer END AS brand_designer, NULL::VARCHAR AS item_image,
    coalesce(t.stock_cost_price, i.stock_cost_price)::DECIMAL(10,2) AS stock_cost_price,
    coalesce(t.sell_price, i.sell_price)::DECIMAL(10,2) AS sell_price,
    CASE WHEN t.seq IS NULL THEN i.min_stock_alert ELSE coalesce(t.min_stock_alert, 2) END AS min_stock_alert,
    CASE WHEN t.seq IS NULL THEN i.bag_color ELSE t.bag_color END AS bag_color,
    CASE WHEN t.seq IS NULL THEN i.bridal_size ELSE t.bridal_size END AS bridal_size, i.is_active, i.created_at,
    CASE WHEN t.seq IS NULL THEN i.updated_at ELSE TIMESTAMP '2001-06-01 12:00:00' END AS updated_at
  FROM full_items i LEFT JOIN log_top t USING (item_sku)),
moved_cust AS (
  SELECT * FROM full_cust
  UNION ALL BY NAME SELECT md5(contact) AS id, contact AS display_name, TIMESTAMP '2001-06-01 12:00:00' AS created_at, 'mover' AS created_by
  FROM (SELECT DISTINCT customer_name_contact AS contact FROM fx_log WHERE customer_name_contact IS NOT NULL)
  WHERE contact NOT IN (SELECT display_name FROM full_cust))
"""

_EXPORT = """
exported AS (
  SELECT shop_type, item_sku, item_name, coalesce(brand_designer, '') AS brand_designer, coalesce(item_image, '') AS item_image,
    stock_cost_price, sell_price, live_stock, min_stock_alert, coalesce(bag_color, '') AS bag_color,
    coalesce(bridal_size, '') AS bridal_size, coalesce(bridal_status, '') AS bridal_status,
    coalesce(rental_due_date::VARCHAR, '') AS rental_due_date, coalesce(customer_name_contact, '') AS customer_name_contact,
    last_action, total_gross_profit, profit_margin
  FROM live)
"""

_EXPORT_TEXT = (
    "shop_type, item_sku, item_name, brand_designer, item_image, stock_cost_price::VARCHAR AS stock_cost_price, "
    "sell_price::VARCHAR AS sell_price, live_stock::VARCHAR AS live_stock, min_stock_alert::VARCHAR AS min_stock_alert, "
    "bag_color, bridal_size, bridal_status, rental_due_date, customer_name_contact, coalesce(last_action, '') AS last_action, "
    "total_gross_profit::VARCHAR AS total_gross_profit, profit_margin::VARCHAR AS profit_margin"
)

_LATE = "(bridal_status = 'Rented' AND rental_due_date IS NOT NULL AND rental_due_date::TIMESTAMP < TIMESTAMP '2001-06-01 12:00:00')"
_DAYS = "ceil((epoch(rental_due_date::TIMESTAMP) - epoch(TIMESTAMP '2001-06-01 12:00:00')) / 86400)::INT"
_BADGE = (
    f"CASE WHEN {_LATE} THEN abs({_DAYS})::VARCHAR || 'd overdue' "
    f"WHEN bridal_status = 'Rented' AND {_DAYS} <= 3 THEN {_DAYS}::VARCHAR || 'd left' END"
)
_ALERT = "(CASE WHEN coalesce(min_stock_alert, 0) = 0 THEN 2 ELSE min_stock_alert END)"
_STOCK = "coalesce(sum(live_stock), 0)::BIGINT AS stock"
_PROFIT = "coalesce(sum(total_gross_profit), 0)::DECIMAL(30,2) AS gross_profit"
_BOARD = (
    f"item_sku, item_name, brand_designer, bridal_size, bridal_status, rental_due_date, customer_name_contact, "
    f"rental_quantity, {_LATE} AS overdue, {_DAYS} AS days_left, {_BADGE} AS due_badge"
)
_COLS = (
    "item_sku, shop_code, item_name, brand_designer, item_image, stock_cost_price, sell_price, min_stock_alert, "
    "bag_color, bridal_size"
)
_COUNT_TABLES = (
    "SELECT 'items' AS table_name, count(*) AS count FROM {items} UNION ALL SELECT 'stock_movements', count(*) FROM {mov} "
    "UNION ALL SELECT 'item_lifecycle_events', count(*) FROM {life} UNION ALL SELECT 'customers', count(*) FROM {cust} "
    "UNION ALL SELECT 'rentals', count(*) FROM {rent}"
)
_MIGRATED_COUNTS = _COUNT_TABLES.format(
    items="(SELECT DISTINCT item_sku FROM fx_log)",
    mov="(SELECT 1 FROM fx_log WHERE action_type IN ('New Item', 'Restock', 'Retail Sale'))",
    life="(SELECT 1 FROM fx_log WHERE action_type = 'Status Change')",
    cust="(SELECT DISTINCT customer_name_contact FROM fx_log WHERE customer_name_contact IS NOT NULL)",
    rent="(SELECT DISTINCT item_sku FROM fx_log WHERE action_type = 'Rental Out')",
)


# Columns of the tables, in the order of their names.
_TABLE_COLUMNS = {
    "items": "bag_color brand_designer bridal_size created_at is_active item_image item_name item_sku min_stock_alert sell_price "
             "shop_code stock_cost_price updated_at",
    "movements": "action_type created_at created_by id item_sku notes quantity_change unit_cost_price",
    "lifecycle": "id item_sku notes occurred_at recorded_by status",
    "customers": "created_at created_by display_name email id notes phone",
    "rentals": "booked_at created_at created_by customer_id due_date id item_sku notes quantity rental_price returned_at status",
    "rejects": "errors item_sku seq",
}


def _lines_of(**sources: str) -> str:
    """Full rows of several tables as text: (table_name, line)."""
    parts = []
    for name, source in sources.items():
        line = ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in _TABLE_COLUMNS[name].split())
        parts.append(f"SELECT '{name}' AS table_name, concat_ws('|', {line}) AS line FROM {source}")
    return " UNION ALL ".join(parts)


def _refused() -> str:
    own = "SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal'"
    tables = {"items": "fx_items", "movements": "fx_mov", "lifecycle": "fx_life", "customers": "fx_cust", "rentals": "fx_rent"}
    parts = []
    for role in ("readonly", "inventory_mgr", "rental_clerk", "app_admin"):
        for name, source in tables.items():
            if role == "readonly" or (role == "rental_clerk" and name == "items"):
                condition = "true"
            elif role == "app_admin" or name == "customers":
                condition = "false"
            else:
                condition = f"item_sku NOT IN ({own})"
            parts.append(f"SELECT '{role}' AS role, '{name}' AS table_name, count(*) AS refused FROM {source} WHERE {condition}")
    return " UNION ALL ".join(parts)


def _role_rows() -> str:
    return _roles().replace("count(*) AS visible FROM fx_items", "item_sku AS key FROM fx_items").replace(
        "count(*) AS visible", "id::VARCHAR AS key")


def _roles() -> str:
    scoped = {
        "items": "fx_items WHERE shop_code = 'Bridal'",
        "movements": "fx_mov WHERE item_sku IN (SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal')",
        "lifecycle": "fx_life WHERE item_sku IN (SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal')",
        "customers": "fx_cust WHERE id IN (SELECT customer_id FROM fx_rent JOIN fx_items USING (item_sku) WHERE shop_code = 'Bridal')",
        "rentals": "fx_rent WHERE item_sku IN (SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal')",
    }
    parts = []
    for role in ("readonly", "inventory_mgr", "rental_clerk", "app_admin"):
        for name, source in scoped.items():
            if role == "app_admin":
                source = source.split(" WHERE ")[0]
            elif role == "readonly" and name in ("movements", "lifecycle", "rentals"):
                source += " AND false"
            parts.append(f"SELECT '{role}' AS role, '{name}' AS table_name, count(*) AS visible FROM {source}")
    return " UNION ALL ".join(parts)


def _broken(table: str, key: str, rule: str, value: str, condition: str) -> str:
    return f"SELECT '{rule}' AS rule, {key}::VARCHAR AS key, {value}::VARCHAR AS value FROM {table} WHERE {condition}"


_FLAWED = """
bad_items AS (SELECT * REPLACE (CASE WHEN substr(item_sku, 5)::BIGINT % 90 = 7 THEN -1 ELSE sell_price END AS sell_price)
  FROM fx_items WHERE substr(item_sku, 5)::BIGINT % 97 <> 5),
bad_rent AS (SELECT * REPLACE (CASE WHEN quantity = 2 THEN due_date - 20 ELSE due_date END AS due_date) FROM fx_rent),
bad_cust AS (SELECT *, CASE WHEN id::BIGINT % 13 = 0 THEN 'nobody' ELSE display_name || '@example.org' END AS email FROM fx_cust)
"""


def oracle_queries() -> dict[str, str]:
    missing = "item_sku NOT IN (SELECT item_sku FROM bad_items)"
    q: dict[str, tuple[tuple[str, ...], str]] = {}

    def add(name: str, sql: str, *parts: str) -> None:
        q[name] = (parts, sql)

    # sources
    add("s1_read_log", """SELECT seq::VARCHAR AS seq, created_at, shop_type, item_sku, item_name, brand_designer, item_image,
        stock_cost_price::DECIMAL(10,2) AS stock_cost_price, sell_price::DECIMAL(10,2) AS sell_price, quantity_change,
        min_stock_alert, bag_color, bridal_size, bridal_status, rental_due_date, customer_name_contact, action_type, notes,
        (sell_price - stock_cost_price)::DECIMAL(10,2) AS gross_profit FROM fx_log""")
    add("s2_read_tables", _COUNT_TABLES.format(items="fx_items", mov="fx_mov", life="fx_life", cust="fx_cust", rent="fx_rent"))
    add("s3_shops", """SELECT shop_code, CASE shop_code WHEN 'Bags' THEN 'Bags retail and resale'
        ELSE 'Bridal wear retail and rental' END AS description, count(*) AS items FROM fx_items GROUP BY shop_code""")
    add("s4_read_import_csv", f"SELECT {_EXPORT_TEXT} FROM exported WHERE shop_type = 'Bridal'", _LIVE, _EXPORT)
    add("s4_read_broken_lines", """SELECT item_sku, item_name || chr(10) || '"' || coalesce(brand_designer, '') || '",' || chr(10) || chr(10) || item_sku
        AS label, shop_code FROM fx_items""")
    add("s5_normalize_import", """SELECT 999 + row_number() OVER (ORDER BY item_sku) AS seq, TIMESTAMP '2001-06-01 12:00:00' AS created_at, shop_type, item_sku, item_name, brand_designer,
        item_image, stock_cost_price::VARCHAR AS stock_cost_price, sell_price::VARCHAR AS sell_price, '0' AS quantity_change, bag_color,
        min_stock_alert::VARCHAR AS min_stock_alert, bridal_size, bridal_status, rental_due_date, customer_name_contact,
        'New Item' AS action_type, '' AS notes FROM exported WHERE shop_type = 'Bags'""", _LIVE, _EXPORT)
    add("s6_import_report", """SELECT count(*) FILTER (WHERE verdict = '') AS ok, count(*) FILTER (WHERE verdict <> '') AS failed
        FROM decided""", _ACTIONS)
    add("s7_export_rows", "SELECT * FROM exported WHERE shop_type = 'Bridal'", _LIVE, _EXPORT)
    add("s8_export_csv", """SELECT array_to_string(list_transform([shop_type, item_sku, item_name, brand_designer, item_image,
        stock_cost_price::VARCHAR, sell_price::VARCHAR, live_stock::VARCHAR, min_stock_alert::VARCHAR, bag_color, bridal_size,
        bridal_status, rental_due_date, customer_name_contact, coalesce(last_action, ''), total_gross_profit::VARCHAR,
        profit_margin::VARCHAR], lambda v: CASE WHEN regexp_matches(v, '[",\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END),
        ',') AS value FROM exported WHERE shop_type = 'Bags'""", _LIVE, _EXPORT)
    add("s9_archive_history", """SELECT shop_type, date_trunc('month', created_at)::DATE AS month, count(*) AS n, sum(quantity_change)::BIGINT AS quantity
        FROM hist GROUP BY ALL""", _LIVE)

    # ingest
    add("i1_validate_actions", "SELECT seq, errors FROM checked", _ACTIONS)
    add("i2_coerce_actions", """SELECT seq, created_at, shop_type, item_sku, item_name, stock_cost_price, sell_price, quantity_change,
        quantity, bag_color, min_stock_alert, bridal_status, rental_due_date, customer_name_contact, action_type, false AS overflow,
        NULL::VARCHAR AS brand_designer, NULL::VARCHAR AS item_image, NULL::VARCHAR AS bridal_size, NULL::VARCHAR AS notes FROM typed""", _ACTIONS)
    add("i3_route_actions", """SELECT seq, CASE action_type WHEN 'Rental Out' THEN 'rental' WHEN 'Rental Return' THEN 'return'
        WHEN 'Status Change' THEN 'lifecycle' ELSE 'ledger' END AS route FROM fx_raw""")
    add("i4_upsert_items", "SELECT * FROM after_items", _FULL, _ACTIONS, _AFTER)
    add("i5_upsert_customers", "SELECT * FROM after_cust", _FULL, _ACTIONS, _AFTER)
    add("i6_open_rentals", "SELECT * REPLACE (id::VARCHAR AS id), booked_at AS created_at, 'till' AS created_by FROM new_rent", _ACTIONS)
    add("i7_close_rentals", "SELECT * REPLACE (id::VARCHAR AS id) FROM after_rent", _FULL, _ACTIONS, _AFTER)
    add("i8_append_lifecycle", "SELECT * REPLACE (id::VARCHAR AS id) FROM after_life WHERE recorded_by = 'till'", _FULL, _ACTIONS, _AFTER)
    add("i9_append_movements", "SELECT * REPLACE (id::VARCHAR AS id) FROM after_moves WHERE created_by = 'till'", _FULL, _ACTIONS, _AFTER)
    add("i10_action_result", """SELECT seq, (CASE WHEN action_type = 'Rental Return' THEN closes_id ELSE seq END)::VARCHAR AS id,
        coalesce(closes_at, created_at) AS created_at, item_sku, item_name, action_type,
        CASE WHEN action_type = 'Rental Out' THEN quantity END AS quantity,
        CASE action_type WHEN 'Rental Out' THEN sell_price WHEN 'Rental Return' THEN 0 WHEN 'Status Change' THEN 0
          ELSE sell_price - stock_cost_price END::DECIMAL(10,2) AS gross_profit,
        CASE WHEN action_type = 'Rental Out' THEN 100 WHEN action_type IN ('Rental Return', 'Status Change') OR sell_price = 0 THEN 0
          ELSE round((sell_price - stock_cost_price)::DOUBLE / sell_price::DOUBLE * 100, 2) END::DECIMAL(20,2) AS profit_margin
        FROM good""", _ACTIONS)
    add("i_rejects", "SELECT seq, item_sku, verdict AS errors FROM decided WHERE verdict <> ''", _ACTIONS)
    add("i11_check_constraints", " UNION ALL ".join([
        _broken("bad_items", "item_sku", "items.sell_price >= 0", "sell_price::DECIMAL(10,2)", "sell_price < 0"),
        _broken("bad_rent", "id", "rentals.due_date >= booked_at", "due_date", "due_date < booked_at::DATE"),
        _broken("bad_cust", "id", "customers.email form", "email", "email NOT LIKE '%_@_%._%'"),
        _broken("fx_mov", "id", "stock_movements.item_sku exists", "item_sku", missing),
        _broken("fx_life", "id", "item_lifecycle_events.item_sku exists", "item_sku", missing),
        _broken("fx_rent", "id", "rentals.item_sku exists", "item_sku", missing),
    ]), _FLAWED)
    add("i11_check_log", " UNION ALL ".join([
        _broken("fx_raw", "seq", "log.shop_type value", "shop_type", "shop_type = 'Shoes'"),
        _broken("fx_raw", "seq", "log.action_type value", "action_type", "action_type = 'Bogus'"),
        _broken("fx_raw", "seq", "log.bridal_status value", "bridal_status", "bridal_status IN ('', 'Lost')"),
    ]))
    add("i12_delete_item", """SELECT item_sku, CASE WHEN shop_code = 'Bags' THEN 1
          + (SELECT count(*) FROM fx_mov m WHERE m.item_sku = i.item_sku) + (SELECT count(*) FROM fx_life m WHERE m.item_sku = i.item_sku)
          + (SELECT count(*) FROM fx_rent m WHERE m.item_sku = i.item_sku) ELSE 0 END::BIGINT AS deleted
        FROM fx_items i WHERE min_stock_alert = 7""")
    gone = "NOT IN (SELECT item_sku FROM fx_items WHERE min_stock_alert = 7 AND shop_code = 'Bags')"
    add("i12_rows_left", _lines_of(
        items=f"full_items WHERE item_sku {gone}", movements=f"fx_mov WHERE item_sku {gone}", lifecycle=f"fx_life WHERE item_sku {gone}",
        customers="full_cust", rentals=f"full_rent WHERE item_sku {gone}"), _FULL)
    add("i13_ingest_stream", "SELECT * FROM after_items", _FULL, _ACTIONS, _AFTER)
    # The stream knows the customers with all columns, some under names that the actions use.
    known = "(SELECT c.id FROM full_cust c WHERE c.display_name = (SELECT n.display_name FROM all_cust n WHERE n.id = after_rent.customer_id))"
    add("i13_stream_rows", _lines_of(
        movements="after_moves", lifecycle="after_life", customers="after_cust",
        rentals=f"(SELECT * REPLACE (CASE WHEN created_by = 'till' THEN coalesce({known}, customer_id) ELSE customer_id END AS customer_id) FROM after_rent)",
        rejects="(SELECT seq, item_sku, verdict AS errors FROM decided WHERE verdict <> '')"), _FULL, _ACTIONS, _AFTER)
    add("i14_guard_actions", """SELECT seq, created_at, item_sku, action_type, CASE WHEN action_type = 'Rental Out' THEN 'reject: no stock'
          ELSE 'warn: no open rental' END AS warning
        FROM good WHERE (action_type = 'Rental Return' AND closes_id IS NULL) OR (action_type = 'Rental Out'
          AND coalesce((SELECT sum(quantity_change) FROM fx_mov m WHERE m.item_sku = good.item_sku), 0) <= 0)""", _ACTIONS)

    # state
    add("v1_item_stock", """SELECT item_sku, item_name, shop_type AS shop_code, live_stock, min_stock_alert,
        live_stock <= min_stock_alert AS low_stock FROM live""", _LIVE)
    add("v2_item_current_status", "SELECT * REPLACE (active_rental_id::VARCHAR AS active_rental_id) FROM status", _LIVE)
    add("v3_item_profit", """SELECT item_sku, item_name, sell_price, stock_cost_price, (sell_price - stock_cost_price)::DECIMAL(10,2) AS gross_profit,
        CASE WHEN sell_price > 0 THEN round((sell_price - stock_cost_price)::DOUBLE / sell_price::DOUBLE * 100, 2)::DECIMAL(10,2) END
        AS profit_margin_pct FROM fx_items""")
    add("v4_unified_history", """SELECT m.id::VARCHAR AS id, m.created_at, i.shop_code AS shop_type, m.item_sku, i.item_name, i.brand_designer,
        i.item_image, coalesce(m.unit_cost_price, i.stock_cost_price) AS stock_cost_price, i.sell_price,
        (i.sell_price - coalesce(m.unit_cost_price, i.stock_cost_price))::DECIMAL(10,2) AS gross_profit, m.quantity_change,
        i.min_stock_alert, i.bag_color, i.bridal_size, s.current_status AS bridal_status, s.rental_due_date,
        NULL::VARCHAR AS customer_name_contact, m.action_type, m.notes
        FROM fx_mov m JOIN fx_items i USING (item_sku) LEFT JOIN status s USING (item_sku)""", _LIVE)
    add("v5_sales_count", """SELECT item_sku, sum(CASE WHEN action_type IN ('New Item', 'Retail Sale') THEN 1 ELSE 0 END)::BIGINT AS sales_count
        FROM fx_mov GROUP BY item_sku""")
    add("v6_rental_revenue", "SELECT item_sku, sum(rental_price)::DECIMAL(20,2) AS rental_revenue FROM fx_rent GROUP BY item_sku")
    add("v7_latest_event", "SELECT item_sku, action_type, at_time AS occurred_at, notes FROM last_event", _LIVE)
    add("v8_active_rental", "SELECT item_sku, customer_id, quantity AS rental_quantity FROM opened", _LIVE)
    add("v9_latest_lifecycle", "SELECT item_sku, status FROM last_life", _LIVE)
    add("v10_open_rentals", """SELECT id::VARCHAR AS id, item_sku, customer_id, booked_at, due_date, rental_price FROM fx_rent
        WHERE status = 'Rented'""")
    add("v11_live_inventory", "SELECT * FROM live", _LIVE)
    add("v12_history", "SELECT * FROM hist", _LIVE)
    add("v13_legacy_live", """SELECT item_sku, t.shop_type, t.item_name, t.brand_designer, t.item_image,
        t.stock_cost_price::DECIMAL(10,2) AS stock_cost_price, t.sell_price::DECIMAL(10,2) AS sell_price, t.min_stock_alert, t.bag_color,
        t.bridal_size, t.bridal_status, t.rental_due_date, t.customer_name_contact, t.action_type AS last_action, t.notes,
        t.created_at AS last_updated, s.live_stock, s.total_gross_profit,
        CASE WHEN t.sell_price = 0 THEN 0 ELSE round((t.sell_price - t.stock_cost_price)::DOUBLE / t.sell_price::DOUBLE * 100, 2)
          END::DECIMAL(10,2) AS profit_margin
        FROM log_top t JOIN (SELECT item_sku, sum(quantity_change)::BIGINT AS live_stock,
          sum(sell_price - stock_cost_price)::DECIMAL(20,2) AS total_gross_profit FROM fx_log GROUP BY item_sku) s USING (item_sku)""", _LOG_TOP)
    add("v14_running_stock", """SELECT seq::VARCHAR AS seq, created_at, item_sku, action_type, quantity_change,
        (sum(quantity_change) OVER (PARTITION BY item_sku ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS running_stock
        FROM fx_log""")

    # reads
    add("q1_live", "SELECT * FROM live WHERE shop_type = 'Bridal' ORDER BY shop_type, item_name", _LIVE)
    add("q2_live_summary", f"""SELECT count(*) AS total_items, sum(live_stock)::BIGINT AS total_stock,
        sum(total_gross_profit)::DECIMAL(30,2) AS total_profit, count(*) FILTER (WHERE bridal_status = 'Rented') AS active_rentals,
        count(*) FILTER (WHERE {_LATE}) AS overdue_rentals,
        count(*) FILTER (WHERE shop_type = 'Bags' AND live_stock <= min_stock_alert) AS low_stock_items FROM live""", _LIVE)
    add("q3_history_query", "SELECT * FROM hist WHERE shop_type = 'Bridal' ORDER BY created_at DESC, id DESC LIMIT 500", _LIVE)
    add("q3_history_count", "SELECT least(count(*), 500) AS count FROM hist WHERE item_sku = 'SKU-000000000012'", _LIVE)
    add("q4_item_lookup", "SELECT * FROM live WHERE item_sku = 'SKU-000000000012' AND shop_type = 'Bridal'", _LIVE)
    add("q5_owned", """SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal'
        AND item_sku IN (SELECT upper(trim(item_sku)) FROM fx_raw)""")

    # boards
    add("d1_dashboard", f"""SELECT count(*) AS items, count(*) FILTER (WHERE shop_type = 'Bags') AS bags,
        count(*) FILTER (WHERE shop_type = 'Bridal') AS bridal, {_STOCK}, {_PROFIT},
        count(*) FILTER (WHERE bridal_status = 'Rented') AS active_rentals, count(*) FILTER (WHERE {_LATE}) AS overdue FROM live""", _LIVE)
    add("d2_shop_summary", f"""SELECT shop_type, count(*) AS items, {_STOCK}, {_PROFIT}, CASE WHEN shop_type = 'Bags'
        THEN count(*) FILTER (WHERE live_stock <= {_ALERT}) END AS low_stock FROM live GROUP BY shop_type""", _LIVE)
    add("d3_bags_stats", f"""SELECT count(*) AS items, {_STOCK}, {_PROFIT}, count(*) FILTER (WHERE live_stock <= {_ALERT}) AS low_stock
        FROM live WHERE shop_type = 'Bags'""", _LIVE)
    add("d4_bridal_stats", f"""SELECT count(*) AS items, count(*) FILTER (WHERE coalesce(bridal_status, 'Available') = 'Available') AS available,
        count(*) FILTER (WHERE bridal_status = 'Rented') AS rented, {_STOCK} FROM live WHERE shop_type = 'Bridal'""", _LIVE)
    add("d5_rental_stats", f"""SELECT count(*) FILTER (WHERE bridal_status = 'Available') AS available,
        count(*) FILTER (WHERE bridal_status = 'Rented') AS rented, count(*) FILTER (WHERE bridal_status = 'Returned') AS returned,
        count(*) FILTER (WHERE {_LATE}) AS overdue FROM live WHERE shop_type = 'Bridal'""", _LIVE)
    add("d6_rental_board", f"SELECT {_BOARD} FROM live WHERE shop_type = 'Bridal'", _LIVE)
    add("d6_rental_board_overdue", f"SELECT {_BOARD} FROM live WHERE shop_type = 'Bridal' AND {_LATE}", _LIVE)
    add("d7_upcoming_returns", """SELECT item_sku, item_name, customer_name_contact, rental_due_date, rental_quantity FROM live
        WHERE bridal_status = 'Rented' ORDER BY rental_due_date""", _LIVE)
    add("d8_days_until", f"""SELECT item_sku, rental_due_date, {_DAYS} AS days_left,
        rental_due_date::TIMESTAMP < TIMESTAMP '2001-06-01 12:00:00' AS overdue, {_BADGE} AS due_badge
        FROM live WHERE rental_due_date IS NOT NULL""", _LIVE)
    add("d9_search_inventory", """SELECT item_sku, item_name, bag_color FROM live WHERE item_sku ILIKE '%red%' OR item_name ILIKE '%red%'
        OR brand_designer ILIKE '%red%' OR bag_color ILIKE '%red%'""", _LIVE)
    add("d10_search_history", """SELECT created_at, item_sku, action_type, notes, quantity_change FROM hist WHERE item_sku ILIKE '%correction%'
        OR item_name ILIKE '%correction%' OR action_type ILIKE '%correction%' OR customer_name_contact ILIKE '%correction%'
        OR notes ILIKE '%correction%'""", _LIVE)
    add("d11_stock_band", f"""SELECT item_sku, shop_type, live_stock, CASE WHEN live_stock = 0 THEN 'zero' WHEN live_stock <= {_ALERT} THEN 'low'
        ELSE 'good' END AS stock_band, CASE WHEN {_LATE} THEN 'overdue' WHEN shop_type = 'Bags' AND live_stock <= {_ALERT}
        THEN 'low-stock' ELSE '' END AS row_flag FROM live""", _LIVE)
    add("d12_margin_band", """SELECT created_at, item_sku, action_type, profit_margin, CASE WHEN profit_margin >= 50 THEN 'green'
        WHEN profit_margin >= 20 THEN 'orange' ELSE 'red' END AS margin_band, least(profit_margin, 100)::DECIMAL(10,2) AS bar_width FROM hist""", _LIVE)
    add("d13_sellable", "SELECT item_sku, live_stock FROM live WHERE shop_type = 'Bags' AND live_stock > 0", _LIVE)
    add("d14_rentable", """SELECT item_sku, bridal_status FROM live WHERE shop_type = 'Bridal'
        AND coalesce(bridal_status, 'Available') IN ('Available', 'Returned')""", _LIVE)
    add("d15_returnable", "SELECT item_sku, customer_name_contact FROM live WHERE bridal_status = 'Rented'", _LIVE)
    add("d16_product_label", """SELECT item_sku, item_name || ' (' || item_sku || ') · stock ' || live_stock::VARCHAR
        || coalesce(' · ' || bridal_status, '') AS label FROM live""", _LIVE)

    # migration
    add("m1_backfill_items", "SELECT * FROM moved_items", _LOG_TOP, _FULL, _MOVED)
    add("m2_backfill_customers", "SELECT * FROM moved_cust", _LOG_TOP, _FULL, _MOVED)
    add("m3_backfill_movements", """SELECT seq::VARCHAR AS id, item_sku, action_type, coalesce(quantity_change, 0) AS quantity_change,
        stock_cost_price::DECIMAL(10,2) AS unit_cost_price, notes, created_at, 'migration' AS created_by FROM fx_log
        WHERE action_type IN ('New Item', 'Restock', 'Retail Sale')""")
    add("m4_backfill_lifecycle", """SELECT seq::VARCHAR AS id, item_sku, bridal_status AS status, notes, created_at AS occurred_at,
        'migration' AS recorded_by FROM fx_log WHERE action_type = 'Status Change' AND bridal_status NOT IN ('Rented', 'Returned')""")
    add("m4_lifecycle_rejects", """SELECT seq AS id, item_sku, bridal_status AS status, created_at AS occurred_at FROM fx_elog
        WHERE action_type = 'Status Change' AND bridal_status IN ('Rented', 'Returned')""")
    add("m5_backfill_rentals", """SELECT id::VARCHAR AS id, item_sku, customer_id, booked_at, due_date, returned_at,
        rental_price::DECIMAL(10,2) AS rental_price, 1 AS quantity, CASE WHEN returned_at IS NULL THEN 'Rented' ELSE 'Returned' END AS status,
        notes, booked_at AS created_at, 'migration' AS created_by FROM migrated""", _LOG_TOP)
    add("m6_migration_rerun", _MIGRATED_COUNTS)
    add("m6_rerun_rows", _lines_of(
        items="moved_items", customers="moved_cust", rentals="""(SELECT id, item_sku, c.id AS customer_id, booked_at, due_date, returned_at,
          rental_price::DECIMAL(10,2) AS rental_price, 1 AS quantity, CASE WHEN returned_at IS NULL THEN 'Rented' ELSE 'Returned' END AS status,
          m.notes, booked_at AS created_at, 'migration' AS created_by
          FROM migrated m JOIN last_out o USING (item_sku) JOIN moved_cust c ON c.display_name = o.customer_name_contact)""".replace("SELECT id,", "SELECT m.id,")
          .replace("m.notes, booked_at", "m.notes, m.booked_at"),
        movements="""(SELECT seq AS id, item_sku, action_type, coalesce(quantity_change, 0) AS quantity_change,
          stock_cost_price::DECIMAL(10,2) AS unit_cost_price, notes, created_at, 'migration' AS created_by FROM fx_log
          WHERE action_type IN ('New Item', 'Restock', 'Retail Sale'))""",
        lifecycle="""(SELECT seq AS id, item_sku, bridal_status AS status, notes, created_at AS occurred_at, 'migration' AS recorded_by
          FROM fx_log WHERE action_type = 'Status Change')"""), _LOG_TOP, _FULL, _MOVED)
    add("m_rejects", """SELECT 'item_lifecycle_events' AS table_name, seq::VARCHAR AS id, item_sku, 'status not allowed' AS reason FROM bad
        WHERE action_type = 'Status Change' AND bridal_status IN ('Rented', 'Returned')
        UNION ALL SELECT * FROM (SELECT 'rentals', seq::VARCHAR, item_sku,
          CASE WHEN customer_name_contact IS NULL THEN 'customer unknown' WHEN rental_due_date < created_at::DATE THEN 'due date before booking'
            WHEN sell_price IS NULL THEN 'price missing' WHEN item_sku IN (SELECT item_sku FROM refused) THEN 'item refused' END AS reason
        FROM (SELECT * FROM bad WHERE action_type = 'Rental Out'
          QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY created_at DESC, seq DESC) = 1)) WHERE reason IS NOT NULL
        UNION ALL SELECT 'items', seq::VARCHAR, item_sku, 'price below 0' FROM refused
        UNION ALL SELECT 'stock_movements', seq::VARCHAR, item_sku, 'item refused' FROM bad
        WHERE action_type IN ('New Item', 'Restock', 'Retail Sale') AND item_sku IN (SELECT item_sku FROM refused)
        UNION ALL SELECT 'item_lifecycle_events', seq::VARCHAR, item_sku, 'item refused' FROM bad
        WHERE action_type = 'Status Change' AND bridal_status NOT IN ('Rented', 'Returned') AND item_sku IN (SELECT item_sku FROM refused)""", """
bad AS (SELECT * REPLACE (
    CASE WHEN min_stock_alert % 11 = 0 THEN -1 ELSE sell_price END AS sell_price,
    CASE WHEN min_stock_alert % 5 = 0 THEN DATE '1990-01-01' ELSE rental_due_date END AS rental_due_date,
    CASE WHEN min_stock_alert % 7 = 0 THEN NULL ELSE customer_name_contact END AS customer_name_contact,
    CASE WHEN action_type = 'Status Change' AND min_stock_alert % 3 = 0 THEN 'Returned' ELSE bridal_status END AS bridal_status)
  FROM fx_log),
refused AS (SELECT * FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY item_sku ORDER BY created_at DESC, seq DESC) = 1)
  WHERE sell_price < 0 OR stock_cost_price < 0)""")
    add("m7_migration_counts", _MIGRATED_COUNTS)
    add("m8_sku_parity", """SELECT count(DISTINCT item_sku) AS legacy_skus, count(DISTINCT item_sku) AS new_items, true AS match FROM fx_log""")
    add("m9_inflight_rentals", """SELECT count(*) AS inflight FROM fx_log WHERE action_type = 'Rental Out'
        AND created_at > TIMESTAMP '2001-03-01' - INTERVAL 1 DAY AND created_at <= TIMESTAMP '2001-03-01'""")

    # scope
    add("r1_scope_items", "SELECT * FROM fx_items WHERE shop_code = 'Bridal'")
    add("r2_scope_children", """SELECT id::VARCHAR AS id, item_sku, action_type, quantity_change FROM fx_mov
        WHERE item_sku IN (SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal')""")
    add("r3_scope_customers", """SELECT * FROM fx_cust WHERE EXISTS (SELECT 1 FROM fx_rent r JOIN fx_items i USING (item_sku)
        WHERE r.customer_id = fx_cust.id AND i.shop_code = 'Bridal')""")
    add("r4_role_view", _roles())
    add("r5_check_write_scope", """SELECT id::VARCHAR AS id, item_sku FROM fx_mov
        WHERE item_sku NOT IN (SELECT item_sku FROM fx_items WHERE shop_code = 'Bridal')""")
    text = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    fields = {c: text(c) for c in ("item_sku", "shop_code", "item_name", "brand_designer", "item_image")}
    fields |= {"stock_cost_price": "stock_cost_price::VARCHAR", "sell_price": "{price}::DECIMAL(10,2)::VARCHAR",
               "min_stock_alert": "min_stock_alert::VARCHAR", "bag_color": text("bag_color"), "bridal_size": text("bridal_size")}
    json = "'{{' || " + " || ',' || ".join(f"'\"{c}\":' || {v}" for c, v in fields.items()) + " || '}}'"
    json = json.replace("{{", "{").replace("}}", "}")
    add("r4_role_rows", _role_rows())
    add("r5_refused_writes", _refused())
    add("r6_audit_items", f"""SELECT 'items' AS table_name, item_sku AS row_pk, CASE WHEN num % 97 = 5 THEN 'DELETE' ELSE 'UPDATE' END AS action,
        'app_admin' AS changed_by, TIMESTAMP '2001-06-01 12:00:00' AS changed_at, {json.replace('{price}', 'sell_price')} AS old_data,
        CASE WHEN num % 97 <> 5 THEN {json.replace('{price}', '(sell_price + 1)')} END AS new_data
        FROM (SELECT *, substr(item_sku, 5)::BIGINT AS num FROM fx_items) WHERE num % 97 = 5 OR num % 10 = 0""")

    # Each update with the item before it: numbers of the action before, colours of the last action that had one.
    moment = lambda c: f"coalesce('\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || '\"', 'null')"
    number = lambda c: f"{c}::VARCHAR"
    kinds = {"item_sku": text, "shop_code": text, "item_name": text, "brand_designer": text, "item_image": text,
             "stock_cost_price": number, "sell_price": number, "min_stock_alert": number, "bag_color": text, "bridal_size": text,
             "is_active": lambda c: f"coalesce({c}::VARCHAR, 'null')", "created_at": moment, "updated_at": moment}
    moved = ("item_name", "stock_cost_price", "sell_price", "min_stock_alert", "bag_color", "updated_at")
    shown = {side: "'{' || " + " || ',' || ".join(
        f"'\"{c}\":' || {kind((prefix if c in moved else 'm.') + c)}" for c, kind in kinds.items()) + " || '}'"
        for side, prefix in (("old", "p."), ("new", "s."))}
    changes = "item_sku, {phase} AS phase, {seq} AS seq, item_name, stock_cost_price, sell_price, min_stock_alert, bag_color, {at} AS updated_at"
    add("r6_audit_actions", f"""SELECT s.seq, 'items' AS table_name, s.item_sku AS row_pk, 'UPDATE' AS action, 'till' AS changed_by,
        s.updated_at AS changed_at, {shown['old']} AS old_data, {shown['new']} AS new_data
        FROM states s JOIN states p ON p.item_sku = s.item_sku AND p.place = s.place - 1 JOIN after_items m ON m.item_sku = s.item_sku""",
        _FULL, _ACTIONS, _AFTER, f"""
states AS (
  SELECT * REPLACE (last_value(bag_color IGNORE NULLS) OVER w AS bag_color), row_number() OVER w AS place FROM (
    SELECT {changes.format(phase=0, seq=0, at='updated_at')} FROM full_items
    UNION ALL SELECT {changes.format(phase=1, seq='seq', at='created_at')} FROM good)
  WINDOW w AS (PARTITION BY item_sku ORDER BY phase, updated_at, seq ROWS UNBOUNDED PRECEDING))
""")

    # reconciliation
    add("a1_baseline_check", """SELECT * FROM (SELECT l.item_sku, coalesce(s.q, 0)::BIGINT AS logged_qty, l.live_stock,
        (l.live_stock - coalesce(s.q, 0))::BIGINT AS difference FROM live l
        LEFT JOIN (SELECT item_sku, sum(quantity_change) AS q FROM fx_log GROUP BY item_sku) s USING (item_sku)) WHERE difference <> 0""", _LIVE)
    add("a2_unmatched_rentals", "SELECT item_sku, created_at, seq, customer_name_contact FROM unmatched", _ELOG)
    add("a2_unpaired_rentals", """SELECT item_sku, created_at, seq, customer_name_contact FROM (SELECT *, lead(action_type) OVER
        (PARTITION BY item_sku ORDER BY created_at, seq) AS nxt FROM fx_elog WHERE action_type IN ('Rental Out', 'Rental Return'))
        WHERE action_type = 'Rental Out' AND nxt IS DISTINCT FROM 'Rental Return'""")
    add("a3_implausible_qty", """SELECT seq, created_at, item_sku, action_type, quantity_change FROM fx_elog
        WHERE action_type IN ('Rental Out', 'Retail Sale') AND (quantity_change > 2 OR quantity_change < -2)""")
    add("a4_zero_qty_returns", """SELECT seq, created_at, item_sku, quantity_change FROM fx_elog
        WHERE action_type = 'Rental Return' AND quantity_change = 0""")
    add("a5_duplicate_submits", """SELECT seq, created_at, item_sku, action_type, repeats_seq, repeats_at FROM (
        SELECT *, lag(seq) OVER w AS repeats_seq, lag(created_at) OVER w AS repeats_at FROM fx_elog
        WINDOW w AS (PARTITION BY item_sku, action_type ORDER BY created_at, seq)) WHERE created_at - repeats_at <= INTERVAL 3 HOUR""")
    add("a5_drop_repeats_stream", """SELECT seq, created_at, item_sku, action_type FROM (
        SELECT *, lag(created_at) OVER (PARTITION BY item_sku, action_type ORDER BY created_at, seq) AS before FROM fx_raw)
        WHERE before IS NULL OR created_at - before > INTERVAL 3 HOUR""")
    add("a6_cross_shop_skus", "SELECT * FROM crossed", _ELOG)
    add("a7_status_desync", "SELECT * FROM desync", _ELOG)
    add("a8_count_delta", """SELECT item_sku, shop_type, recorded_qty, physical_qty, delta, CASE WHEN abs(delta) > 5 OR sell_price >= 1000
          OR item_sku IN (SELECT 'SKU-' || lpad(o_custkey::VARCHAR, 12, '0') FROM orders WHERE o_orderkey % 11 = 10) THEN 'severe'
        WHEN abs(delta) >= 2 OR shop_type = 'Bridal' THEN 'moderate' ELSE 'minor' END AS severity FROM deltas""", _LIVE, _COUNTS)
    add("a9_snapshot_sku", """SELECT h.item_sku, h.id, h.created_at, h.action_type, h.quantity_change, rank, d.recorded_qty, d.physical_qty, d.delta,
        d.bridal_status, d.customer_name_contact, d.rental_due_date FROM (SELECT *, row_number() OVER (PARTITION BY item_sku
        ORDER BY created_at DESC, id DESC)::INT AS rank FROM hist) h JOIN deltas d USING (item_sku) WHERE rank <= 5""", _LIVE, _COUNTS)
    add("a10_class_a_skus", """SELECT item_sku, item_name, sell_price, value_rank FROM (SELECT *, row_number() OVER (ORDER BY sell_price DESC, item_sku)
        AS value_rank, count(*) OVER () AS n FROM live WHERE shop_type = 'Bridal') WHERE value_rank <= ceil(n * 0.2)""", _LIVE)
    add("a11_discrepancy_trend", """SELECT date_trunc('month', o_orderdate)::DATE AS month, d.dimension, d.value, count(*) AS incidents,
        sum(abs(o_orderkey % 11 - 5))::BIGINT AS units,
        round((count(*) * 100)::DOUBLE / (SELECT count(*) FROM part), 4)::DECIMAL(20,4) AS per_100_items
        FROM orders, LATERAL (VALUES ('item_sku', 'SKU-' || lpad(o_custkey::VARCHAR, 12, '0')), ('staff', 'staff-' || (o_custkey % 7)::VARCHAR),
        ('cause', CASE o_orderstatus WHEN 'F' THEN 'Data-entry error' WHEN 'O' THEN 'Unrecorded return' ELSE 'Unknown' END)) d(dimension, value)
        GROUP BY ALL""")
    add("a12_overdue_without_return", """SELECT id::VARCHAR AS id, item_sku, customer_id, booked_at, due_date,
        (DATE '2001-06-01' - due_date)::INT AS days_overdue FROM fx_rent
        WHERE status = 'Rented' AND due_date::TIMESTAMP < TIMESTAMP '2001-06-01 12:00:00'""")
    add("a13_recent_actors", """SELECT item_sku, created_by, count(*) AS actions, max(created_at) AS last_at FROM fx_elog
        WHERE created_at > TIMESTAMP '2024-01-13' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY item_sku, created_by""")
    add("a14_correction_rows", """SELECT id, created_at, item_sku, action_type, notes, CASE WHEN notes LIKE 'CORRECTION%' THEN 'CORRECTION'
        ELSE 'HOLD-RECONCILE' END AS kind, CASE WHEN notes LIKE '%#1' THEN '1' END AS row_reference, false AS missing_reference
        FROM hist WHERE notes IS NOT NULL""", _LIVE)
    add("a15_gap_transactions", "SELECT * FROM gaps", _ELOG)
    add("a16_wrong_sku_pairs", "SELECT * FROM matched WHERE counterparts > 0", _LIVE, _COUNTS)
    add("a17_assign_cause", """SELECT item_sku, shop_type, recorded_qty, physical_qty, delta, CASE WHEN abs(delta) > 5 THEN 'severe'
          WHEN abs(delta) >= 2 OR shop_type = 'Bridal' THEN 'moderate' ELSE 'minor' END AS severity,
        CASE WHEN num % 9 = 2 THEN 'Counting error'
          WHEN num % 41 = 3 AND recorded_qty <> 0 THEN 'System or query bug'
          WHEN item_sku IN (SELECT item_sku FROM unmatched)
            OR item_sku IN (SELECT item_sku FROM fx_rent WHERE status = 'Rented' AND due_date::TIMESTAMP < TIMESTAMP '2001-06-01 12:00:00')
            THEN 'Unrecorded return'
          WHEN item_sku IN (SELECT item_sku FROM fx_elog WHERE action_type IN ('Rental Out', 'Retail Sale') AND abs(quantity_change) > 2)
            OR item_sku IN (SELECT item_sku FROM fx_elog WHERE action_type = 'Rental Return' AND quantity_change = 0)
            OR item_sku IN (SELECT a.item_sku FROM fx_elog a JOIN fx_elog b ON a.item_sku = b.item_sku AND a.action_type = b.action_type
              AND a.seq <> b.seq AND a.created_at >= b.created_at AND a.created_at - b.created_at <= INTERVAL 3 HOUR)
            OR item_sku IN (SELECT item_sku FROM matched WHERE counterparts > 0) THEN 'Data-entry error'
          WHEN item_sku IN (SELECT item_sku FROM gaps) THEN 'Lost transaction'
          WHEN item_sku IN (SELECT item_sku FROM crossed) THEN 'Cross-shop mixing'
          WHEN item_sku IN (SELECT item_sku FROM desync) THEN 'Status desync' ELSE 'Unknown' END AS cause FROM deltas""", _LIVE, _COUNTS, _ELOG)

    # The steps of the audit procedure, each over all items; the first that lists an item names the cause.
    steps = (
        ("Counting error", "SELECT item_sku FROM short WHERE num % 9 = 2"),
        ("System or query bug", "SELECT item_sku FROM short WHERE num % 41 = 3 AND live_stock <> 0"),
        ("Unrecorded return", """SELECT item_sku FROM tidy o WHERE action_type = 'Rental Out' AND created_at >= coalesce((SELECT max(created_at)
            FROM tidy r WHERE r.item_sku = o.item_sku AND r.action_type = 'Rental Return'), created_at)"""),
        ("Unrecorded return", "SELECT item_sku FROM fx_rent WHERE status = 'Rented' AND due_date < DATE '2001-06-01'"),
        ("Unrecorded return", "SELECT item_sku FROM fx_rent WHERE status = 'Rented' AND due_date = DATE '2001-06-01'"),
        ("Data-entry error", """SELECT a.item_sku FROM tidy a JOIN tidy b ON a.item_sku = b.item_sku AND a.action_type = b.action_type
            AND (a.created_at, a.seq) > (b.created_at, b.seq) AND a.created_at - b.created_at <= INTERVAL 1 HOUR"""),
        ("Lost transaction", "SELECT item_sku FROM gaps"),
        ("Cross-shop mixing", "SELECT item_sku FROM tidy GROUP BY item_sku HAVING min(shop_type) <> max(shop_type)"),
        ("Cross-shop mixing", "SELECT item_sku FROM short WHERE bridal_status IN ('Dry Cleaning', 'In Alteration')"),
        ("Status desync", """SELECT item_sku FROM tidy GROUP BY item_sku HAVING
            coalesce(arg_max(bridal_status, (created_at, seq)) FILTER (WHERE bridal_status IS NOT NULL), '') || '/' || arg_max(action_type, (created_at, seq))
            IN ('Rented/Rental Return', 'Available/Rental Out', '/Rental Out')"""),
    )
    order = list(dict.fromkeys(cause for cause, _ in steps))
    listed = " UNION ALL ".join(f"SELECT item_sku, {order.index(cause)} AS step FROM ({sql})" for cause, sql in steps)
    add("a17_shortage_causes", f"""SELECT s.item_sku, s.shop_type, live_stock AS recorded_qty, live_stock - missing AS physical_qty, -missing AS delta,
        CASE WHEN missing > 5 THEN 'severe' WHEN missing >= 2 OR shop_type = 'Bridal' THEN 'moderate' ELSE 'minor' END AS severity,
        coalesce({order!r}[(SELECT min(step) FROM found f WHERE f.item_sku = s.item_sku) + 1], 'Unknown') AS cause FROM short s""",
        _LIVE, _ELOG, f"""
short AS (SELECT *, substr(item_sku, 5)::BIGINT AS num, substr(item_sku, 5)::BIGINT % 7 + 1 AS missing FROM live),
tidy AS (
  SELECT * REPLACE ('SKU-' || lpad((seq // 4)::VARCHAR, 12, '0') AS item_sku, if(seq % 10 = 0, 'Bridal', 'Bags') AS shop_type) FROM fx_elog),
found AS ({listed})
""")

    return {name: "WITH " + ",\n".join(p.strip() for p in (_FIXTURES, *parts)) + "\n" + sql for name, (parts, sql) in q.items()}
