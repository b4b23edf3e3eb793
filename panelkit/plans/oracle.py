"""DuckDB oracle SQL for every SQL-expressible query in the catalogue.

Written independently of the Spark code, straight from the operator
definitions; the driver runs both and compares digests.
"""

from __future__ import annotations

# --- shared CTE fragments -------------------------------------------------

DAILY = """daily AS MATERIALIZED (
  SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v_min, max(value) AS v_max,
         round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS v_click
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

ANCHORS = """anchors AS MATERIALIZED (
  SELECT event_id AS row_id, user_id, CAST(ts AS DATE) AS anchor_date
  FROM events WHERE event_type = 'signup')"""

WIN = """win AS MATERIALIZED (
  SELECT a.row_id, a.user_id, a.anchor_date, CAST(o.k AS INTEGER) AS "offset", d.day,
         d.v_min, d.v_max, d.v_click
  FROM anchors a CROSS JOIN range(1, 6) o(k)
  JOIN daily d ON d.user_id = a.user_id AND d.day = a.anchor_date - CAST(o.k AS INTEGER))"""

PROF = """prof AS MATERIALIZED (
  SELECT a.row_id, a.user_id, a.anchor_date,
         count(w.day) AS n_days,
         CAST(coalesce(sum(CASE WHEN w.day IS NOT NULL AND (w.v_min IS NULL OR w.v_max IS NULL
              OR w.v_click IS NULL) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_null_days
  FROM anchors a LEFT JOIN win w ON w.row_id = a.row_id
  GROUP BY a.row_id, a.user_id, a.anchor_date),
cls AS MATERIALIZED (
  SELECT *, CASE WHEN n_days = 0 THEN 'missing' WHEN n_days < 5 THEN 'partial'
                 WHEN n_null_days > 0 THEN 'has_nulls' ELSE 'complete' END AS completeness
  FROM prof)"""


def _lags(src: str = "w") -> str:
    cols = []
    for c in ("v_min", "v_max", "v_click"):
        for k in range(5, 0, -1):
            cols.append(f'max(CASE WHEN {src}."offset" = {k} THEN {src}.{c} END) AS {c}_lag{k}')
    return ",\n         ".join(cols)


def lambert_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Same closed form as panelkit.functions.geo.geodesic_miles."""
    f = "(1e0/298.257223563e0)"
    b1 = f"atan((1e0-{f})*tan(radians({lat1})))"
    b2 = f"atan((1e0-{f})*tan(radians({lat2})))"
    dl = f"(radians({lon2})-radians({lon1}))"
    h = f"(pow(sin(({b2}-{b1})/2e0),2)+cos({b1})*cos({b2})*pow(sin({dl}/2e0),2))"
    s = f"(2e0*asin(sqrt(least(1e0,{h}))))"
    p = f"(({b1}+{b2})/2e0)"
    q = f"(({b2}-{b1})/2e0)"
    x = f"(({s}-sin({s}))*pow(sin({p})*cos({q})/cos({s}/2e0),2))"
    y = f"(({s}+sin({s}))*pow(cos({p})*sin({q})/sin({s}/2e0),2))"
    return f"(CASE WHEN {s} = 0 THEN 0e0 ELSE 6378.137e0*({s}-{f}/2e0*({x}+{y}))/1.609344e0 END)"


def _user_loc(alias: str) -> str:
    return (f"36e0 + ((({alias}.user_id % 500) + 500) % 500) / 100e0 AS lat, "
            f"-123e0 + ((({alias}.user_id * 7 % 400) + 400) % 400) / 100e0 AS lon")


def _donor_cte(need: str) -> str:
    d = lambert_sql("l.lat", "l.lon", "r.lat", "r.lon")
    return f"""loc AS MATERIALIZED (SELECT c.row_id, c.anchor_date, c.completeness, {_user_loc('c')} FROM cls c),
pairs AS (
  SELECT l.row_id, r.row_id AS donor_row_id, {d} AS dist
  FROM (SELECT * FROM loc WHERE completeness IN ({need})) l
  JOIN (SELECT * FROM loc WHERE completeness = 'complete') r
    -- a degree of latitude is over 68 miles, so nothing within 60 is lost
    ON r.anchor_date = l.anchor_date AND abs(r.lat - l.lat) <= 1e0),
best AS (
  SELECT row_id, donor_row_id, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, donor_row_id) AS rn
    FROM pairs WHERE dist <= 60e0) t WHERE rn = 1),
donors AS MATERIALIZED (
  SELECT l.row_id, b.donor_row_id, b.dist FROM loc l LEFT JOIN best b ON b.row_id = l.row_id
  WHERE l.completeness IN ({need}))"""


SQL: dict[str, str] = {}

SQL["lookback_daily"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}
SELECT row_id, user_id, anchor_date, "offset", day, v_min, v_max, v_click FROM win"""

SQL["completeness_class"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF}
SELECT row_id, user_id, anchor_date, n_days, n_null_days, completeness FROM cls"""

SQL["lag_pivot"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}
SELECT w.row_id,
         {_lags()}
FROM win w GROUP BY w.row_id"""

SQL["lag_features_join"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF}
SELECT c.row_id, c.user_id, c.anchor_date, c.completeness,
         {_lags()}
FROM cls c LEFT JOIN win w ON w.row_id = c.row_id
GROUP BY c.row_id, c.user_id, c.anchor_date, c.completeness"""

SQL["donor_assign"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF},
{_donor_cte("'missing','partial','has_nulls'")}
SELECT row_id, donor_row_id, round(dist, 6) AS distance_mi FROM donors"""

SQL["donor_copy"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF},
{_donor_cte("'missing','partial'")}
SELECT d.row_id, w."offset", w.v_min, w.v_max, w.v_click, d.donor_row_id AS source_row_id,
       true AS approximated, true AS from_donor
FROM donors d JOIN win w ON w.row_id = d.donor_row_id"""

_FILL_SELECT = """SELECT o.row_id, o."offset",
       coalesce(o.v_min, s.v_min) AS v_min, coalesce(o.v_max, s.v_max) AS v_max,
       coalesce(o.v_click, s.v_click) AS v_click,
       o.row_id AS source_row_id, true AS approximated,
       ((o.v_min IS NULL AND s.v_min IS NOT NULL) OR (o.v_max IS NULL AND s.v_max IS NOT NULL)
         OR (o.v_click IS NULL AND s.v_click IS NOT NULL)) AS from_donor
FROM win o JOIN donors d ON d.row_id = o.row_id AND d.donor_row_id IS NOT NULL
LEFT JOIN win s ON s.row_id = d.donor_row_id AND s."offset" = o."offset\""""

SQL["donor_fill"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF},
{_donor_cte("'has_nulls'")}
{_FILL_SELECT}"""

SQL["repair_union"] = f"""WITH {DAILY}, {ANCHORS}, {WIN}, {PROF},
{_donor_cte("'missing','partial','has_nulls'")}
SELECT w.row_id, w."offset", w.v_min, w.v_max, w.v_click, w.row_id AS source_row_id, false AS approximated,
       false AS from_donor
FROM win w JOIN cls c ON c.row_id = w.row_id AND c.completeness = 'complete'
UNION ALL
SELECT d.row_id, w."offset", w.v_min, w.v_max, w.v_click, d.donor_row_id, true, true
FROM donors d JOIN cls c ON c.row_id = d.row_id AND c.completeness IN ('missing', 'partial')
JOIN win w ON w.row_id = d.donor_row_id
UNION ALL
SELECT * FROM ({_FILL_SELECT.replace('FROM win o JOIN donors d', 'FROM win o JOIN cls c2 ON c2.row_id = o.row_id AND c2.completeness = ' + "'has_nulls'" + ' JOIN donors d')}) f"""

# --- sources, cleaning rules, filters, simple joins -----------------------

SQL["typed_csv_scan"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"

SQL["file_name_keys"] = """SELECT o_orderkey, o_totalprice, o_orderpriority,
       CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders"""

# expected values straight from the rendering rule: the parsed time is the
# rendered time, and the 'n/a' text (no digit) becomes the 2000-01-01 sentinel
SQL["batch_union"] = """SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS batch,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN '2000-01-01 00:00:00'
            ELSE strftime(o_orderdate + INTERVAL 7 HOUR + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') END
         AS start_time
FROM orders"""

SQL["reject_split"] = """SELECT d.doc_id, d.lang, l.quality, l.toxic,
       CASE WHEN l.quality IS NOT NULL THEN 'labelled' ELSE 'rejected' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

SQL["header_synonyms"] = """SELECT p_partkey AS part_key, p_name AS part_name, p_type AS part_type,
       p_size AS communities, p_brand AS brand FROM part"""

SQL["columns_by_regex"] = "SELECT c_custkey, c_nationkey FROM customer"

SQL["optional_filter"] = """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE upper(l_linestatus) = 'F'"""

_SUP_NAME = """regexp_replace(upper(replace(s_name, '#', ' ')) ||
    CASE WHEN s_suppkey % 7 = 0 THEN ' LINE' WHEN s_suppkey % 5 = 0 THEN ' TAP &' || chr(13) || chr(10) || ' 2'
         ELSE ' NO.  1' END, '[\\r\\n\\s]+', ' ', 'g')"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


SQL["name_filters"] = f"""WITH n AS (SELECT s_suppkey, {_SUP_NAME} AS name FROM supplier)
SELECT s_suppkey, name,
       {_strip("regexp_replace(replace(replace(name, '.', ''), ' NO', ''), '\\d', '', 'g')")} AS key_left,
       {_strip("replace(regexp_replace(name, '[\\d&]', '', 'g'), ' TAP', '')")} AS key_right
FROM n WHERE upper(name) <> 'UNKNOWN' AND NOT regexp_matches(upper(name), '^\\d')
  AND NOT suffix(upper(name), 'LINE')"""

SQL["sentinel_filter"] = """SELECT o_orderkey, o_totalprice AS total,
       round(1440e0 + (o_orderkey % 1440), 6) AS time_out_min
FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2000-01-01 00:00:00'
  AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"""

SQL["dropna_cast"] = """SELECT c_custkey, c_acctbal AS acctbal,
       CAST(floor(abs(c_acctbal)) * 100 AS DOUBLE) AS income, c_nationkey AS nation
FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0"""

SQL["null_aware_flag"] = """SELECT d.doc_id, l.label_name, (l.label_name IS DISTINCT FROM 'MISSING') AS label_present
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'MISSING' ELSE 'OK' END AS label_name
                            FROM labels) l ON l.doc_id = d.doc_id"""

_CIRCUIT = ("(upper(p_name) || ' ' || CAST(p_partkey + 1000 AS VARCHAR) || "
            "CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END)")

SQL["scalar_clean"] = f"""SELECT p_partkey,
  CASE WHEN regexp_matches({_CIRCUIT}, '\\s\\d{{4,}}')
       THEN {_strip(f"regexp_extract({_CIRCUIT}, '(.*?)\\s\\d{{4,}}', 1)")} ELSE {_CIRCUIT} END AS circuit,
  coalesce(list_max(list_transform(regexp_extract_all(p_brand, '(\\d)', 1), lambda x: CAST(x AS INTEGER))), 0) AS tier,
  -abs(-123e0 + ((p_partkey * 7) % 400) / 100e0) AS longitude,
  regexp_extract('ZCTA5 ' || CAST(p_partkey + 90000 AS VARCHAR), '\\d{{5}}', 0) AS zip5,
  {_strip("regexp_replace(p_type || '-' || CAST(p_size AS VARCHAR), '-?\\d+$', '')")} AS stem,
  split_part(p_type || ',' || p_name, ',', 2) AS second,
  upper(p_name) AS name_upper,
  round_even(p_retailprice, 0) AS price_round,
  round(sqrt(abs(p_retailprice - 1000)), 6) AS price_sqrt
FROM part"""

SQL["duration_minutes"] = """SELECT l_orderkey, l_linenumber,
  date_diff('microsecond', o_orderdate, l_shipdate) / 6e7 AS minutes,
  CAST(dayofyear(l_shipdate) AS INTEGER) AS ship_doy,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days_between,
  CAST(l_shipdate AS DATE) - 5 AS ship_minus5
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

SQL["outer_join_clean_key"] = """WITH cs AS (SELECT 'NATION' || CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n_customers,
                   round(sum(c_acctbal), 2) AS customer_balance FROM customer GROUP BY 1),
ss AS (SELECT 'NATION' || CAST(s_nationkey + 3 AS VARCHAR) AS k, count(*) AS n_suppliers,
              round(sum(s_acctbal), 2) AS supplier_balance FROM supplier GROUP BY 1)
SELECT coalesce(cs.k, ss.k) AS nation_key, n_customers, customer_balance, n_suppliers, supplier_balance
FROM cs FULL OUTER JOIN ss ON cs.k = ss.k"""

SQL["crosswalk_join"] = """SELECT c_custkey, printf('%05d', c_custkey) AS zip, printf('%05d', c_nationkey) AS zcta,
       n_name, r_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""

SQL["left_enrich"] = """SELECT o_orderkey, o_custkey, c_mktsegment,
       round(o_totalprice / nullif(c_acctbal, 0), 6) AS price_ratio
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""

SQL["join_integrity"] = """SELECT count(*) AS n_rows,
       CAST(count_if(l_orderkey IS NOT DISTINCT FROM o_orderkey) AS BIGINT) AS n_key_agree,
       CAST(count_if(CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)) AS BIGINT) AS n_date_agree,
       bool_and(l_orderkey IS NOT DISTINCT FROM o_orderkey AND CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)) AS all_agree
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

SQL["sibling_impute"] = f"""WITH r AS (
  SELECT p_partkey, p_type || '-' || CAST(p_size AS VARCHAR) AS name,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(p_size) END AS start_time,
         CASE WHEN p_partkey % 10 = 0 THEN NULL
              ELSE TIMESTAMP '2024-01-01' + to_hours(p_size) + to_minutes(p_partkey % 500 + 30) END AS end_time,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 500 + 30 AS DOUBLE) END AS minutes,
         p_brand AS communities
  FROM part),
d AS (SELECT *, {_strip("regexp_replace(name, '-?\\d+$', '')")} AS stem FROM r),
st AS (SELECT stem, avg(epoch_us(start_time)) AS s, avg(epoch_us(end_time)) AS e,
              round_even(avg(minutes), 0) AS dd,
              array_to_string(list_sort(list_distinct(list(communities))), ', ') AS t
       FROM d WHERE start_time > TIMESTAMP '2000-01-01' GROUP BY stem),
j AS (SELECT d.*, st.s, st.e, st.dd, st.t, (d.start_time IS NULL AND st.s IS NOT NULL) AS miss
      FROM d LEFT JOIN st ON st.stem = d.stem)
SELECT p_partkey, stem,
  strftime(CASE WHEN miss THEN make_timestamp(CAST(round(s) AS BIGINT)) ELSE start_time END, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
  strftime(CASE WHEN miss THEN make_timestamp(CAST(round(e) AS BIGINT)) ELSE end_time END, '%Y-%m-%d %H:%M:%S.%f') AS end_time,
  CASE WHEN miss THEN dd ELSE minutes END AS minutes,
  CASE WHEN miss THEN t ELSE communities END AS communities,
  miss AS imputed
FROM j"""

# --- fuzzy match, geo-nearest, point in polygon ----------------------------

def _tsort(x: str) -> str:
    """Token-sort normal form (same rule as functions.text.token_sort_key)."""
    return ("array_to_string(list_sort(list_filter(string_split_regex(lower(regexp_replace("
            f"regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]', ' ', 'g')), '\\s+'), "
            "lambda t: t <> '')), ' ')")


_LEFT_TXT = _strip("regexp_replace(replace(replace(upper(p_name), '.', ''), ' NO', ''), '\\d', '', 'g')")
_RIGHT_TXT = _strip("replace(regexp_replace(upper(p_name), '[\\d&]', '', 'g'), ' TAP', '')")

SQL["fuzzy_best_match"] = f"""WITH RECURSIVE
l AS (SELECT p_partkey, {_LEFT_TXT} AS match_text FROM part),
ln AS (SELECT DISTINCT match_text, {_tsort('match_text')} AS a FROM l),
r AS (SELECT p_partkey AS match_partkey, p_name AS match_name, {_tsort(_RIGHT_TXT)} AS b FROM part),
rb AS (SELECT DISTINCT b FROM r),
pairs AS (SELECT DISTINCT a, b FROM ln, rb WHERE length(a) > 0 AND length(b) > 0 AND a <> b),
dp(a, b, i, v) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM pairs
  UNION ALL
  SELECT a, b, i + 1,
         list_reduce(range(1, length(b) + 1),
           lambda acc, j: list_append(acc, CASE WHEN substring(b, j, 1) = substring(a, i + 1, 1)
                                            THEN v[j] + 1 ELSE greatest(v[j + 1], acc[j]) END), [0])
  FROM dp WHERE i < length(a)),
sc AS (SELECT a, b, CAST(round_even(200e0 * v[length(b) + 1] / (length(a) + length(b)), 0) AS INTEGER) AS s
       FROM dp WHERE i = length(a)),
cand AS (SELECT ln.match_text, sc.s, r.match_partkey, r.match_name
         FROM ln JOIN sc ON sc.a = ln.a JOIN r ON r.b = sc.b WHERE sc.s >= 80),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_text ORDER BY s DESC, match_partkey) AS rn
                        FROM cand) t WHERE rn = 1)
SELECT l.p_partkey, l.match_text, best.s AS match_score, best.match_partkey, best.match_name
FROM l LEFT JOIN best ON best.match_text IS NOT DISTINCT FROM l.match_text"""

_CUST_PT = ("36e0 + (c_custkey % 500) / 100e0 AS lat, -123e0 + ((c_custkey * 7) % 400) / 100e0 AS lon")
_SUPP_PT = ("36e0 + ((s_suppkey * 13) % 500) / 100e0 AS lat, -123e0 + ((s_suppkey * 29) % 400) / 100e0 AS lon")

SQL["geo_nearest_donor"] = f"""WITH c AS (SELECT c_custkey, c_nationkey, {_CUST_PT} FROM customer),
s AS (SELECT s_suppkey, s_nationkey, {_SUPP_PT} FROM supplier),
p AS (SELECT c.c_custkey, s.s_suppkey, {lambert_sql('c.lat', 'c.lon', 's.lat', 's.lon')} AS d
      FROM c JOIN s ON s.s_nationkey = c.c_nationkey),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rn
                     FROM p WHERE d <= 60e0) t WHERE rn = 1)
SELECT c.c_custkey, b.s_suppkey, round(b.d, 6) AS distance_mi,
       CASE WHEN b.s_suppkey IS NULL THEN 'rejected' ELSE 'matched' END AS status
FROM c LEFT JOIN b ON b.c_custkey = c.c_custkey"""


def _poly_sql() -> tuple[str, str]:
    from .match_geo_queries import POLYGONS
    edges, names = [], []
    for pid, name, ring in POLYGONS:
        names.append(f"({pid}, '{name}')")
        for i, (x1, y1) in enumerate(ring):
            x2, y2 = ring[(i + 1) % len(ring)]
            edges.append(f"({pid}, {x1}e0, {y1}e0, {x2}e0, {y2}e0)")
    e = "edges(poly_id, x1, y1, x2, y2) AS (VALUES " + ", ".join(edges) + ")"
    n = "names(poly_id, county) AS (VALUES " + ", ".join(names) + ")"
    return e, n


_EDGES, _NAMES = _poly_sql()
_PIP = f"""{_EDGES}, {_NAMES},
pts AS (SELECT c_custkey, c_acctbal, 36e0 + (c_custkey % 500) / 100e0 + 0.003e0 AS lat,
               -123e0 + ((c_custkey * 7) % 400) / 100e0 + 0.003e0 AS lon FROM customer),
cr AS (SELECT pts.c_custkey, edges.poly_id FROM pts JOIN edges
         ON (edges.y1 > pts.lat) <> (edges.y2 > pts.lat)
        WHERE pts.lon < edges.x1 + (pts.lat - edges.y1) * (edges.x2 - edges.x1) / nullif(edges.y2 - edges.y1, 0e0)),
ins AS (SELECT c_custkey, min(poly_id) AS poly_id FROM
          (SELECT c_custkey, poly_id FROM cr GROUP BY 1, 2 HAVING count(*) % 2 = 1) t GROUP BY c_custkey),
lab AS (SELECT pts.c_custkey, pts.c_acctbal, CAST(ins.poly_id AS INTEGER) AS poly_id
        FROM pts LEFT JOIN ins ON ins.c_custkey = pts.c_custkey)"""

SQL["point_in_polygon"] = f"""WITH {_PIP}
SELECT lab.c_custkey, lab.poly_id, names.county FROM lab LEFT JOIN names ON names.poly_id = lab.poly_id"""

SQL["region_total"] = f"""WITH {_PIP},
sums AS (SELECT poly_id, count(*) AS n_points, round(sum(c_acctbal), 2) AS total_balance
         FROM lab WHERE poly_id IS NOT NULL GROUP BY poly_id)
SELECT CAST(names.poly_id AS INTEGER) AS poly_id, names.county, sums.n_points, sums.total_balance,
       max(sums.total_balance) OVER () AS max_total
FROM names LEFT JOIN sums ON sums.poly_id = names.poly_id"""

# --- features, evaluation, residual contrast -------------------------------

def _hb(key: str, seed: int, buckets: int) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) % {buckets})"


_MT = f"""mt0 AS (
  SELECT CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15)) AS BIGINT) AS row_id,
         l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice,
         l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship_date,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem),
mt AS (SELECT *, CASE WHEN {_hb('row_id', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part FROM mt0),
coef AS (SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS b,
                round(regr_intercept(l_extendedprice, l_quantity), 6) AS a FROM mt WHERE part = 'train'),
pred AS (SELECT mt.*, coef.a + coef.b * mt.l_quantity AS prediction FROM mt, coef),
res AS (SELECT *, l_extendedprice - prediction AS residual, abs(l_extendedprice - prediction) AS abs_residual
        FROM pred WHERE part = 'test'),
flag AS (SELECT *, row_number() OVER (ORDER BY abs_residual DESC, row_id) <= (SELECT CAST(floor(0.1e0 * count(*)) AS BIGINT) FROM res) AS is_extreme
         FROM res)"""

SQL["hash_split"] = f"""SELECT o_orderkey, CASE WHEN {_hb('o_orderkey', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part,
       {_hb('o_orderkey', 229, 100)} AS bucket FROM orders"""

SQL["kfold_assign"] = f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn,
                  count(*) OVER () AS n FROM orders),
s AS (SELECT *, n // 5 AS q, n % 5 AS m FROM r)
SELECT o_orderkey, CAST({_hb('o_orderkey', 229, 5)} AS INTEGER) AS fold,
       CAST(CASE WHEN rn <= m * (q + 1) THEN (rn - 1) // (q + 1)
                 ELSE m + (rn - 1 - m * (q + 1)) // q END AS INTEGER) AS fold_contiguous
FROM s"""

SQL["one_hot"] = f"""WITH c AS (SELECT c_custkey, c_mktsegment,
   CASE WHEN {_hb('c_custkey', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part FROM customer)
SELECT c_custkey, part,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS seg_is_AUTOMOBILE,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS seg_is_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS seg_is_FURNITURE,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS seg_is_HOUSEHOLD,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS seg_is_MACHINERY
FROM c"""

SQL["unseen_share"] = f"""WITH p AS (SELECT p_partkey, p_name || '/' || p_brand AS cat,
   CASE WHEN {_hb('p_partkey', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part FROM part),
t AS (SELECT p.*, p.cat NOT IN (SELECT cat FROM p WHERE part = 'train') AS unseen FROM p WHERE part = 'test')
SELECT count(*) AS n_test, CAST(count_if(unseen) AS BIGINT) AS n_unseen, round(avg(CASE WHEN unseen THEN 1 ELSE 0 END), 6) AS unseen_share
FROM t"""

SQL["zscore"] = f"""WITH {_MT},
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd,
             avg(l_tax) AS mt_, stddev_pop(l_tax) AS st FROM mt WHERE part = 'train')
SELECT row_id, part,
  round((l_quantity - mq) / CASE WHEN sq = 0 OR sq IS NULL THEN 1e0 ELSE sq END, 6) AS z_l_quantity,
  round((l_discount - md) / CASE WHEN sd = 0 OR sd IS NULL THEN 1e0 ELSE sd END, 6) AS z_l_discount,
  round((l_tax - mt_) / CASE WHEN st = 0 OR st IS NULL THEN 1e0 ELSE st END, 6) AS z_l_tax
FROM mt, s"""

SQL["simple_ols"] = f"""WITH {_MT}
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM mt WHERE part = 'train'"""

SQL["residuals"] = f"""WITH {_MT}
SELECT row_id, l_extendedprice, prediction, residual FROM res"""

SQL["regression_metrics"] = f"""WITH {_MT},
r AS (SELECT part, l_extendedprice AS y, prediction AS p FROM pred)
SELECT part, count(*) AS n,
  round(1e0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse,
  round(avg(abs(y - p)), 6) AS mae,
  round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape
FROM r GROUP BY part"""

SQL["leaderboard"] = f"""WITH {_MT},
gm AS (SELECT l_returnflag, round(avg(l_extendedprice), 2) AS p FROM mt WHERE part = 'train' GROUP BY l_returnflag),
long AS (SELECT 'ols_quantity' AS model, l_extendedprice AS y, prediction AS p FROM pred WHERE part = 'test'
         UNION ALL
         SELECT 'mean_by_flag', mt.l_extendedprice, gm.p FROM mt JOIN gm ON gm.l_returnflag = mt.l_returnflag
         WHERE mt.part = 'test')
SELECT model, count(*) AS n,
  round(1e0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse,
  round(avg(abs(y - p)), 6) AS mae
FROM long GROUP BY model"""

SQL["worst_decile"] = f"""WITH {_MT},
pos AS (SELECT row_id, abs_residual, row_number() OVER (ORDER BY abs_residual DESC, row_id) AS p,
               count(*) OVER () AS n FROM res)
SELECT row_id, round(abs_residual, 6) AS abs_residual, p <= CAST(floor(0.1e0 * n) AS BIGINT) AS is_extreme,
       p > n - CAST(floor(0.9e0 * n + 1e-9) AS BIGINT) AS is_other
FROM pos"""

SQL["worst_row"] = f"""WITH {_MT}
SELECT row_id, l_quantity, l_returnflag, round(residual, 6) AS residual FROM res
ORDER BY abs_residual DESC, row_id LIMIT 1"""

_SHARES = """sh AS (
  SELECT {col}, CAST(count_if(is_extreme) AS BIGINT) AS n_extreme, count(*) AS n_all,
         count_if(is_extreme) / (SELECT CAST(count_if(is_extreme) AS DOUBLE) FROM flag) AS share_extreme,
         count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM flag) AS share_all
  FROM flag GROUP BY {col} HAVING count_if(is_extreme) > 0)"""

SQL["value_shares"] = f"""WITH {_MT}, {_SHARES.format(col='ship_date')}
SELECT ship_date, n_extreme, n_all, round(share_extreme, 6) AS share_extreme, round(share_all, 6) AS share_all FROM sh"""

SQL["share_lift"] = f"""WITH {_MT}, {_SHARES.format(col='l_suppkey')}
SELECT l_suppkey, n_extreme, n_all, round(share_extreme / share_all, 6) AS lift FROM sh
ORDER BY share_extreme / share_all DESC, l_suppkey LIMIT 25"""

_MED = """SELECT '{f}' AS feature, round(median({f}) FILTER (WHERE is_extreme), 4) AS e,
       round(median({f}) FILTER (WHERE NOT is_extreme), 4) AS o FROM flag"""

SQL["median_contrast"] = f"""WITH {_MT},
m AS ({' UNION ALL '.join(_MED.format(f=f) for f in ('l_quantity', 'l_discount', 'l_tax', 'l_extendedprice'))})
SELECT feature, e AS extreme, o AS others, round((e - o) / nullif(o, 0e0), 6) AS pct_diff FROM m"""

SQL["histogram"] = f"""WITH {_MT},
b AS (SELECT min(residual) AS lo, max(residual) AS hi FROM res),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1e0 END AS w FROM b),
h AS (SELECT CAST(least(floor((residual - w.lo) / w.w), 19) AS INTEGER) AS bin, count(*) AS n FROM res, w GROUP BY 1)
SELECT b.bin, round(w.lo + b.bin * w.w, 6) AS lo, round(w.lo + (b.bin + 1) * w.w, 6) AS hi, coalesce(h.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b CROSS JOIN w LEFT JOIN h ON h.bin = b.bin"""

SQL["category_count"] = "SELECT p_type, count(*) AS n FROM part GROUP BY p_type"

SQL["null_profile"] = """WITH j AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'doc_id' AS column_name, 'bigint' AS dtype, count(doc_id) AS non_null, count(*) - count(doc_id) AS nulls FROM j
UNION ALL SELECT 'lang', 'string', count(lang), count(*) - count(lang) FROM j
UNION ALL SELECT 'n_chars', 'bigint', count(n_chars), count(*) - count(n_chars) FROM j
UNION ALL SELECT 'quality', 'int', count(quality), count(*) - count(quality) FROM j
UNION ALL SELECT 'toxic', 'int', count(toxic), count(*) - count(toxic) FROM j"""

# --- KNN and least squares --------------------------------------------------

_KNN_Z = f"""c AS (SELECT c_custkey, c_acctbal, 36e0 + (c_custkey % 500) / 100e0 AS lat,
              -123e0 + ((c_custkey * 7) % 400) / 100e0 AS lon,
              CASE WHEN {_hb('c_custkey', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part FROM customer),
s AS (SELECT avg(lat) AS ml, stddev_pop(lat) AS sl, avg(lon) AS mo, stddev_pop(lon) AS so FROM c WHERE part = 'train'),
z AS (SELECT c.*, round((lat - ml) / CASE WHEN sl = 0 THEN 1e0 ELSE sl END, 6) AS zl,
             round((lon - mo) / CASE WHEN so = 0 THEN 1e0 ELSE so END, 6) AS zo FROM c, s)"""

SQL["knn_predict"] = f"""WITH {_KNN_Z},
p AS (SELECT q.c_custkey, r.c_acctbal AS y,
             row_number() OVER (PARTITION BY q.c_custkey
                                ORDER BY (q.zl - r.zl) * (q.zl - r.zl) + (q.zo - r.zo) * (q.zo - r.zo), r.c_custkey) AS rk
      FROM z q JOIN z r ON r.part = 'train' WHERE q.part = 'test')
SELECT c_custkey, round(avg(y), 6) AS prediction, count(*) AS n_neighbours FROM p WHERE rk <= 5 GROUP BY c_custkey"""

SQL["knn_cv"] = f"""WITH {_KNN_Z},
t AS (SELECT *, CAST({_hb('c_custkey', 42, 5)} AS INTEGER) AS fold FROM z WHERE part = 'train'),
p AS (SELECT q.c_custkey, q.fold, q.c_acctbal AS y, r.c_acctbal AS y_ref,
             row_number() OVER (PARTITION BY q.c_custkey
                                ORDER BY (q.zl - r.zl) * (q.zl - r.zl) + (q.zo - r.zo) * (q.zo - r.zo), r.c_custkey) AS rk
      FROM t q JOIN t r ON r.fold <> q.fold),
run AS (SELECT *, sum(y_ref) OVER (PARTITION BY c_custkey ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rk AS pred
        FROM p WHERE rk <= 50),
pf AS (SELECT fold, rk AS k, avg((y - pred) * (y - pred)) AS mse FROM run
       WHERE rk IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 40, 50) GROUP BY fold, rk),
cv AS (SELECT CAST(k AS INTEGER) AS k, round(avg(mse), 2) AS cv_mse FROM pf GROUP BY k)
SELECT k, cv_mse, k = first(k ORDER BY cv_mse, k) OVER () AS is_best FROM cv"""

_WIDE_D2 = " + ".join(f"(q.x{i} - r.x{i}) * (q.x{i} - r.x{i})" for i in range(25))
_WIDE = f"""wide AS MATERIALIZED (
    SELECT vec_id, CAST(label AS DOUBLE) AS y, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(25))},
           CASE WHEN {_hb('vec_id', 229, 100)} < 80 THEN 'train' ELSE 'test' END AS part,
           {_hb('vec_id', 42, 5)} AS fold FROM embeddings)"""

SQL["knn_wide_predict"] = f"""WITH {_WIDE},
p AS (SELECT q.vec_id, r.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_WIDE_D2}, r.vec_id) AS rk
      FROM wide q JOIN wide r ON r.part = 'train' WHERE q.part = 'test')
SELECT vec_id, round(avg(y), 6) AS prediction, count(*) AS n_neighbours FROM p WHERE rk <= 5 GROUP BY vec_id"""

SQL["knn_wide_cv"] = f"""WITH {_WIDE},
t AS (SELECT * FROM wide WHERE part = 'train'),
p AS (SELECT q.vec_id, q.fold, q.y, r.y AS y_ref, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_WIDE_D2}, r.vec_id) AS rk
      FROM t q JOIN t r ON r.fold <> q.fold),
run AS (SELECT *, sum(y_ref) OVER (PARTITION BY vec_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rk AS pred
        FROM p WHERE rk <= 50),
pf AS (SELECT fold, rk AS k, avg((y - pred) * (y - pred)) AS mse FROM run
       WHERE rk IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 40, 50) GROUP BY fold, rk),
cv AS (SELECT CAST(k AS INTEGER) AS k, round(avg(mse), 2) AS cv_mse FROM pf GROUP BY k)
SELECT k, cv_mse, k = first(k ORDER BY cv_mse, k) OVER () AS is_best FROM cv"""

SQL["multiple_ols"] = f"""WITH {_MT},
t AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM mt WHERE part = 'train'),
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
             covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM t),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS b_l_quantity, round(b2, 4) AS b_l_discount FROM b"""

# --- streaming --------------------------------------------------------------

SQL["stream_clean_enrich"] = """SELECT o_orderkey, o_totalprice AS total, c_mktsegment,
       round(1440e0 + (o_orderkey % 1440), 6) AS time_out_min
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2000-01-01 00:00:00'
  AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"""

SQL["stream_daily_rollup"] = """SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v_min, max(value) AS v_max,
       round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS v_click, count(*) AS n_events
FROM events
GROUP BY user_id, CAST(ts AS DATE)"""
