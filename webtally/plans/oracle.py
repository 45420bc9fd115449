"""SQL for DuckDB that states each registered query over the driver's tables, written from the definition of the
report (windows, joins and distinct counts as they read) and not from the Spark plan.

The event rows here are flat columns; the Spark side builds, stores and reads the nested form."""

from __future__ import annotations

from webtally.functions import fixed
from webtally.sources import testdata as t

WEEK_MICROS = 7 * 86_400_000_000


def rnd(x: str, places: int) -> str:
    """Rounding of the double as it reads in decimal, half away from zero (as Spark's ``round`` does)."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {places}) AS DOUBLE)"


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(24,6))) AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def pick(values: list, index: str) -> str:
    texts = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{texts}])[1 + {index}]"


def event_rows(stagger: bool = False) -> str:
    moved = f" + (user_id % 4) * {WEEK_MICROS}" if stagger else ""
    return f"""
raw AS (
  SELECT event_id AS e, user_id AS uid, event_type, value AS v, epoch_us(ts){moved} AS us,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
  FROM events
),
named AS (
  SELECT *, CASE event_type
      WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'purchase'
      WHEN 'click' THEN {pick(['click', 'view_item', 'add_to_cart', 'page_view'], 'e % 4')}
      WHEN 'error' THEN {pick(['session_start', 'session_start', 'loyalty_tier_update'], 'e % 3')}
      WHEN 'signup' THEN {pick(['signup', 'page_view'], 'e % 2')} END AS event_name,
    CASE WHEN event_type = 'purchase' THEN v END AS rev, us // 172800000000 AS sid
  FROM raw
),
ev AS (
  SELECT us AS t, e AS seq, k, v, uid, event_name, rev, sid, CAST(make_timestamp(us) AS DATE) AS day,
    strftime(make_timestamp(us), '%Y%m%d') AS event_date,
    CASE WHEN e % 50 <> 0 THEN 'u' || uid END AS usr,
    CASE WHEN e % 50 <> 0 THEN 'u' || uid || '-' || sid END AS skey,
    CAST(sid AS VARCHAR) AS session_id,
    sid - 9860 AS snum,
    CASE WHEN e % 37 <> 0 THEN '{t.HOST}' || {pick(t.PAGES, 'k % 8')} || {pick(t.EVENT_SUFFIXES, 'e % 3')} END AS page,
    CASE WHEN e % 5 <> 0 THEN '{t.HOST}' || {pick(t.PAGES, '(k + 3) % 8')} END AS referrer,
    k * 1000 + e % 1000 AS msec, k % 2 AS engaged,
    CASE WHEN event_name = 'page_view' AND k % 3 = 0 THEN 1 ELSE 0 END AS entrances,
    CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS bounce,
    {pick([c[0] for c in t.CHANNELS], 'e % 20')} AS src, {pick([c[1] for c in t.CHANNELS], 'e % 20')} AS med,
    CASE WHEN k % 10 <> 9 THEN 'camp' || (k % 5) END AS camp,
    CASE WHEN k % 20 = 0 THEN 'Cross-Network promo' ELSE 'camp' || (k % 5) END AS mcamp,
    CASE WHEN e % 11 = 0 THEN 'g' || e END AS gclid,
    CASE WHEN e % 11 = 0 THEN 'acct' || (k % 2) END AS acct, CASE WHEN e % 11 = 0 THEN 'ads' || (k % 4) END AS ads,
    {pick(['Paid Search', 'Display'], 'k % 2')} AS channel_group,
    CASE WHEN e % 4 = 0 THEN CAST(floor(rev) AS BIGINT) END AS val_int, CASE WHEN e % 2 = 1 THEN rev END AS val_dbl,
    CASE WHEN e % 4 = 2 THEN rev WHEN e % 12 = 0 AND rev IS NOT NULL THEN 2.5 END AS val_flt,
    CASE WHEN event_name = 'loyalty_tier_update' THEN {pick(['bronze', 'silver', 'gold'], 'k % 3')} END AS tier,
    CASE WHEN rev IS NOT NULL THEN 't' || e || {pick(['-live', '-test'], 'e % 2')} END AS txn,
    {pick(['desktop', 'mobile', 'tablet'], '(e // 4) % 3')} AS device,
    CASE WHEN e % 13 <> 0 THEN 'en' END AS lang, CASE WHEN e % 13 <> 0 THEN 'os' || (k % 3) END AS os,
    'NATION_' || (uid % 25) AS country,
    CASE WHEN e % 5 = 0 THEN 'No' ELSE 'Yes' END AS astore, CASE WHEN e % 10 = 0 THEN 'No' ELSE 'Yes' END AS adstore,
    CASE WHEN event_name IN ('view_item', 'add_to_cart', 'purchase') AND e % 9 <> 0 THEN 1 + e % 2 ELSE 0 END AS n_items
  FROM named
),
item AS (
  SELECT ev.*, 'i' || ((seq * 7 + j) % 40) AS item_id, 'name' || ((seq * 7 + j) % 40) AS item_name,
    CASE WHEN (seq + j) % 17 <> 0 THEN 'cat' || ((seq * 7 + j) % 5) END AS item_category,
    1 + (k + j) % 3 AS quantity, CASE WHEN j = 0 THEN v ELSE k END AS item_revenue
  FROM ev, (VALUES (0), (1)) AS entry(j) WHERE j < n_items
)"""


def on_events(body: str, stagger: bool = False) -> str:
    return f"WITH {event_rows(stagger)}{body}"


SEARCH_ROWS = f"""
allsc AS (
  SELECT CAST(l_shipdate AS DATE) AS d, CASE WHEN l_orderkey % 29 <> 0 THEN p_name END AS query, l_partkey, l_orderkey,
    CASE WHEN l_partkey % 6 = 0 THEN CASE WHEN l_orderkey % 29 <> 0 THEN p_name END || ' sale'
         ELSE CASE WHEN l_orderkey % 29 <> 0 THEN p_name END END AS search_query,
    '{t.HOST}' || {pick(t.PAGES, 'l_partkey % 8')} || {pick(t.SEARCH_SUFFIXES, 'l_suppkey % 3')} AS url,
    {pick(['DESKTOP', 'MOBILE', 'TABLET'], 'l_suppkey % 3')} AS device, 'NATION_' || (l_suppkey % 25) AS country,
    {pick(['web', 'image', 'news'], 'l_linenumber % 3')} AS traffic_source,
    CAST(CASE WHEN l_linenumber = 7 THEN 0 WHEN length(p_name) % 2 = 0 THEN 1 ELSE l_quantity END AS BIGINT) AS impressions,
    CAST(CASE WHEN l_linenumber = 7 THEN 0 WHEN length(p_name) % 2 = 0 THEN l_orderkey % 2 ELSE floor(l_quantity * l_discount) END AS BIGINT) AS clicks,
    CAST(CASE WHEN length(p_name) % 2 = 0 THEN (length(p_name) * 3 + ascii(p_name)) % 20 ELSE l_linenumber * (l_suppkey % 5) END AS DOUBLE) AS top
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
sc AS (SELECT * FROM allsc WHERE d BETWEEN DATE '1995-01-01' AND DATE '2001-12-31')"""


def flag(name: str) -> str:
    """Appearance flag as a Boolean expression, NULL where it is not known."""
    n = fixed.APPEARANCE_FLAGS.index(name)
    return f"CASE WHEN l_orderkey % {n + 3} <> 0 THEN l_partkey % {n + 2} = 0 END"


def on_search(body: str) -> str:
    return f"WITH {SEARCH_ROWS}{body}"


PROMO = fixed.PROMO_PATTERN
IS_PROMO = f"regexp_matches(page, '{PROMO}')"
RECENT = "day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
PATH = "regexp_replace(page, '^https?://[^/]+|[?].*', '', 'g')"
SOURCE = f"CASE WHEN gclid IS NOT NULL THEN '{fixed.PAID_CLICK_SOURCE}' ELSE src || ' / ' || med END"


def moves(partition: str, having: str = "") -> str:
    return on_events(f""",
p AS (SELECT usr, skey, {PATH} AS cur, t, seq FROM ev WHERE event_name = 'page_view'),
n AS (SELECT skey, coalesce(lag(cur) OVER w, '(entrance)') AS prev, cur, coalesce(lead(cur) OVER w, '(exit)') AS nxt
      FROM p WINDOW w AS (PARTITION BY {partition} ORDER BY t, seq))
SELECT prev AS previous_page, cur AS current_page, nxt AS next_page, count(DISTINCT skey) AS session_count
FROM n GROUP BY prev, cur, nxt {having}""")


PROMO_VIEWS = f"""
pp AS (SELECT usr, page, src, med, device, country, t, seq FROM ev
       WHERE event_name = 'page_view' AND {IS_PROMO} AND {RECENT}),
engagement AS (
  SELECT usr, count(DISTINCT session_id) AS sessions, count(*) AS views, count(CASE WHEN event_name = 'purchase' THEN 1 END) AS purchases,
         {money('rev')} AS revenue
  FROM ev WHERE usr IN (SELECT usr FROM pp WHERE usr IS NOT NULL) GROUP BY usr
),
touches AS (
  SELECT usr, min(CASE WHEN {IS_PROMO} THEN t END) AS first_touch, max(CASE WHEN {IS_PROMO} THEN t END) AS last_touch,
         {div(f'count(CASE WHEN {IS_PROMO} THEN 1 END)', 'count(*)')} AS score
  FROM ev GROUP BY usr
),
clicks AS (
  SELECT usr, count(CASE WHEN event_name = 'click' AND {IS_PROMO} THEN 1 END) AS promo_clicks,
         count(CASE WHEN event_name = 'page_view' AND {IS_PROMO} THEN 1 END) AS promo_views
  FROM ev GROUP BY usr
),
bounces AS (
  SELECT usr, count(CASE WHEN engaged = 0 THEN 1 END) AS bounced, count(DISTINCT session_id) AS sessions
  FROM ev WHERE usr IN (SELECT usr FROM pp WHERE usr IS NOT NULL) GROUP BY usr
),
clv AS (
  SELECT usr, {money('rev')} AS revenue, count(DISTINCT session_id) AS sessions, count(DISTINCT usr) AS users
  FROM ev WHERE event_name = 'purchase' GROUP BY usr
),
stay AS (
  SELECT usr, min(t) AS first_t, max(t) AS last_t, count(DISTINCT session_id) AS sessions,
         CAST(CAST(make_timestamp(max(t)) AS DATE) - CAST(make_timestamp(min(t)) AS DATE) AS INTEGER) AS days
  FROM ev WHERE usr IN (SELECT usr FROM pp WHERE usr IS NOT NULL) GROUP BY usr
)"""

SEARCH_SUMS = f"""{big('sum(impressions)')} AS total_impressions, {big('sum(clicks)')} AS total_clicks,
  {rnd(div('sum(clicks)', 'sum(impressions)') + ' * 100', 2)} AS ctr"""


def report_part(name: str, category: str, segment: str = "CAST(NULL AS VARCHAR)", where: str = "true") -> str:
    return (
        f"SELECT '{name}' AS report_type, {category} AS category, {segment} AS segment, {SEARCH_SUMS} "
        f"FROM sc WHERE {where} GROUP BY 2, 3"
    )


DAILY_CORRELATION = """,
q AS (SELECT d, query, sum(clicks) / nullif(CAST(sum(impressions) AS DOUBLE), 0) AS ctr,
             sum(top) / nullif(CAST(sum(impressions) AS DOUBLE), 0) + 1.0 AS pos
      FROM sc WHERE impressions > 0 AND top < 20 GROUP BY d, query),
c AS (SELECT d, CASE WHEN isnan(corr(ctr, pos)) THEN NULL ELSE corr(ctr, pos) END AS c FROM q GROUP BY d)"""

TRANSFORM = "regexp_replace(regexp_replace(regexp_replace({0}, '\\?.*$|#.*', '', 'g'), '^(https?://|ftp://)', ''), '^[^/]+/', '/')"


def found(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '{pattern}')"


def listed(column: str, names: list[str]) -> str:
    return f"lower({column}) IN ({', '.join(repr(n) for n in names)})"


def channel_case() -> str:
    """First channel whose condition holds."""
    also = {"Social": listed("med", fixed.SOCIAL_MEDIUMS), "Video": "lower(med) LIKE '%video%'", "Search": "lower(med) = 'organic'"}
    conditions = {"Direct": "src IS NULL OR med IS NULL", "Cross-network": "lower(mcamp) LIKE '%cross-network%'"}
    for name in fixed.PAID_ORDER:
        clicked = "gclid IS NOT NULL" if name == "Search" else "false"
        conditions[f"Paid {name}"] = f"{clicked} OR ({found('src', fixed.SITES[name])} AND {found('med', fixed.PAID_MEDIUMS)})"
    conditions["Display"] = listed("med", fixed.DISPLAY_MEDIUMS)
    for name in fixed.ORGANIC_ORDER:
        conditions[f"Organic {name}"] = f"{found('src', fixed.SITES[name])} OR {also.get(name, 'false')}"
    conditions["Email"] = f"{found('src', fixed.EMAIL_NAMES)} OR {found('med', fixed.EMAIL_NAMES)}"
    for name, channel in fixed.MEDIUM_CHANNELS.items():
        conditions[channel] = listed("med", [name])
    conditions["Push Notifications"] = f"lower(med) LIKE '%push%' OR {found('med', fixed.PUSH_MEDIUMS)}"
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in conditions.items()) + " ELSE 'Unassigned' END"


EVENT_KEYS = "usr AS user_pseudo_id, t AS event_timestamp, event_name"
PARAM_ROWS = ", ".join(
    f"('{key}', {text}, {whole}, {double}, {'val_flt' if key == 'value' else 'NULL'})"
    for key, text, whole, double in [
        ("ga_session_id", "NULL", "sid", "NULL"), ("ga_session_number", "NULL", "snum", "NULL"),
        ("page_location", "page", "NULL", "NULL"), ("page_referrer", "referrer", "NULL", "NULL"),
        ("engagement_time_msec", "NULL", "msec", "NULL"), ("session_engaged", "CAST(engaged AS VARCHAR)", "engaged", "NULL"),
        ("entrances", "NULL", "entrances", "NULL"), ("bounce", "NULL", "bounce", "NULL"),
        ("source", "src", "NULL", "NULL"), ("medium", "med", "NULL", "NULL"), ("campaign", "camp", "NULL", "NULL"),
        ("utm_source", "src", "NULL", "NULL"), ("utm_medium", "med", "NULL", "NULL"),
        ("utm_campaign", "camp", "NULL", "NULL"), ("traffic_source", "src", "NULL", "NULL"),
        ("value", "NULL", "val_int", "val_dbl"), ("purchase_revenue", "NULL", "NULL", "rev"),
        ("loyalty_tier", "tier", "NULL", "NULL"),
    ]
)
PARAM_COLUMNS = """key AS param_key, s AS param_string_value, CAST(i AS BIGINT) AS param_int_value,
  CAST(f AS DOUBLE) AS param_float_value, CAST(d AS DOUBLE) AS param_double_value"""
PROPERTY_COLUMNS = """key AS user_property_key, s AS user_property_string_value,
  CAST(i AS BIGINT) AS user_property_int_value, CAST(NULL AS DOUBLE) AS user_property_float_value,
  CAST(NULL AS DOUBLE) AS user_property_double_value, t - 1 AS user_property_set_timestamp"""
_KNOWN_ITEM = {
    "item_id": "item_id", "item_name": "item_name", "item_brand": "'acme'", "item_category": "item_category",
    "quantity": "quantity", "item_revenue": "item_revenue", "affiliation": "'shop'",
}
_ITEM_TYPES = {
    **dict.fromkeys(fixed.ITEM_TEXT_FIELDS, "VARCHAR"), **dict(fixed.ITEM_NUMBER_FIELDS),
    **dict.fromkeys(fixed.ITEM_LIST_FIELDS, "VARCHAR"),
}
ITEM_COLUMNS = ", ".join(f"CAST({_KNOWN_ITEM.get(n, 'NULL')} AS {kind}) AS {n}" for n, kind in _ITEM_TYPES.items())
FLATS = f""",
par AS (SELECT {EVENT_KEYS}, {PARAM_COLUMNS} FROM ev, LATERAL (VALUES {PARAM_ROWS}) AS p(key, s, i, d, f)
        WHERE s IS NOT NULL OR i IS NOT NULL OR d IS NOT NULL OR f IS NOT NULL),
prop AS (SELECT {EVENT_KEYS}, {PROPERTY_COLUMNS}
         FROM ev, LATERAL (VALUES ('plan', {pick(['free', 'pro'], 'uid % 2')}, NULL), ('visits', NULL, uid)) AS p(key, s, i)
         WHERE seq % 8 <> 0),
it AS (SELECT {EVENT_KEYS}, {ITEM_COLUMNS} FROM item)"""

DECAYED = "amount * pow(CAST(0.5 AS DOUBLE), datesub('hour', make_timestamp(touched), make_timestamp(bought)) / CAST(24 AS DOUBLE))"
DIGITS = "CAST(floor(log10(x)) - 9 AS INTEGER)"

ORACLES: dict[str, str] = {
    "page_navigation_flow": moves("skey"),
    "navigation_without_loops": moves("usr, skey", "HAVING cur <> prev AND cur <> nxt"),
    "navigation_steps": on_events(""",
base AS (
  SELECT usr, skey, t, regexp_replace(regexp_replace(lower(page), '\\?.*$', ''), '/$', '') AS pg, country, device, camp, med, src,
    regexp_replace(regexp_replace(lower(referrer), '\\?.*$', ''), '/$', '') AS ref
  FROM ev WHERE usr IS NOT NULL AND snum = 1
),
attrs AS (
  SELECT usr, skey, t, pg, first_value(country) OVER w AS country, first_value(device) OVER w AS device,
    last_value(camp) OVER w AS camp, last_value(med) OVER w AS med, last_value(src) OVER w AS src,
    last_value(ref) OVER w AS ref, lag(pg) OVER w AS prev
  FROM base WINDOW w AS (PARTITION BY skey ORDER BY t)
),
kept AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY t) AS n FROM attrs WHERE prev IS NULL OR prev <> pg),
steps AS (
  SELECT max(CASE WHEN n = 1 THEN pg END) AS stage1, max(CASE WHEN n = 2 THEN pg END) AS stage2,
    max(CASE WHEN n = 3 THEN pg END) AS stage3, max(CASE WHEN n = 4 THEN pg END) AS stage4,
    max(CASE WHEN n = 5 THEN pg END) AS stage5
  FROM kept GROUP BY usr, skey, country, device, camp, med, src, ref
)
SELECT stage1, stage2, stage3, stage4, stage5, count(*) AS navigation_frequency
FROM steps GROUP BY ALL HAVING stage1 IS NOT NULL"""),
    "navigation_steps_whole_session": on_events(""",
base AS (
  SELECT usr, skey, t, regexp_replace(regexp_replace(lower(page), '\\?.*$', ''), '/$', '') AS pg, country, device, camp, med, src,
    regexp_replace(regexp_replace(lower(referrer), '\\?.*$', ''), '/$', '') AS ref
  FROM ev WHERE usr IS NOT NULL AND snum = 1
),
attrs AS (
  SELECT usr, skey, t, pg, first_value(country) OVER w AS country, first_value(device) OVER w AS device,
    last_value(camp) OVER w AS camp, last_value(med) OVER w AS med, last_value(src) OVER w AS src,
    last_value(ref) OVER w AS ref, lag(pg) OVER w AS prev
  FROM base WINDOW w AS (PARTITION BY skey ORDER BY t)
),
kept AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY t) AS n FROM attrs WHERE prev IS NULL OR prev <> pg),
steps AS (
  SELECT max(CASE WHEN n = 1 THEN pg END) AS stage1, max(CASE WHEN n = 2 THEN pg END) AS stage2,
    max(CASE WHEN n = 3 THEN pg END) AS stage3, max(CASE WHEN n = 4 THEN pg END) AS stage4,
    max(CASE WHEN n = 5 THEN pg END) AS stage5
  FROM kept GROUP BY usr, skey
)
SELECT stage1, stage2, stage3, stage4, stage5, count(*) AS navigation_frequency
FROM steps GROUP BY ALL HAVING stage1 IS NOT NULL"""),
    "exit_pages": on_events(""",
x AS (SELECT usr, sid, first_value(page) OVER (PARTITION BY usr, sid ORDER BY t DESC, seq DESC) AS exit_page
      FROM ev WHERE event_name = 'page_view')
SELECT exit_page, count(DISTINCT usr || sid) AS session_count FROM x WHERE exit_page IS NOT NULL GROUP BY exit_page"""),
    "landing_page_conversion": on_events(""",
p AS (SELECT skey, page, row_number() OVER (PARTITION BY skey ORDER BY t, seq) AS n FROM ev WHERE event_name = 'page_view'),
b AS (SELECT skey FROM ev WHERE event_name = 'purchase')
SELECT page AS landing_page, count(*) AS total_purchases FROM b JOIN p USING (skey)
WHERE n = 1 AND page IS NOT NULL GROUP BY page"""),
    "landing_pages_top10": on_events(f""",
p AS (SELECT regexp_replace(regexp_replace(page, '\\?.*$', ''), '#.*$', '') AS landing, * FROM ev
      WHERE event_name = 'page_view' AND usr IS NOT NULL)
SELECT landing AS landing_page, src AS traffic_source, med AS traffic_medium, count(DISTINCT usr) AS unique_users,
  count(*) AS page_views, {big('sum(entrances)')} AS entrances, {rnd(div('sum(entrances)', 'count(*)'), 2)} AS entrance_rate,
  {rnd(div('sum(bounce)', 'sum(entrances)'), 2)} AS bounce_rate,
  {rnd('avg(msec) / 1000', 2)} AS avg_engagement_time_sec
FROM p WHERE landing IS NOT NULL GROUP BY landing, src, med
ORDER BY unique_users DESC, landing NULLS FIRST, src NULLS FIRST, med NULLS FIRST LIMIT 10"""),
    "average_session_duration": on_events(f""",
s AS (SELECT skey, day, max(t) - min(t) AS us FROM ev GROUP BY skey, day)
SELECT day AS event_date, {rnd(div('sum(us) / 1000000.0', 'count(DISTINCT skey)'), 2)} AS average_session_duration_seconds
FROM s GROUP BY day"""),
    "session_metrics_by_source": on_events(f""",
s AS (
  SELECT usr, skey, {SOURCE} AS source, max(engaged) AS engaged, sum(msec) / 1000 AS sec, count(CASE WHEN event_name = 'page_view' THEN 1 END) AS pv,
    count(CASE WHEN event_name = 'purchase' THEN 1 END) AS buys, count(CASE WHEN event_name = 'signup' THEN 1 END) AS signups, {money('rev')} AS rev
  FROM ev GROUP BY 1, 2, 3
)
SELECT coalesce(source, 'direct') AS traffic_source, count(DISTINCT usr) AS total_users, count(DISTINCT skey) AS total_sessions,
  count(DISTINCT CASE WHEN engaged = 1 THEN skey END) AS engaged_sessions, {rnd('avg(sec)', 2)} AS avg_engagement_time_sec,
  {rnd(div('count(DISTINCT CASE WHEN engaged = 1 THEN skey END)', 'count(DISTINCT skey)'), 3)} AS session_engagement_rate,
  {big('sum(pv)')} AS total_pageviews, {rnd(div('sum(pv)', 'count(DISTINCT skey)'), 2)} AS avg_pageviews_per_session,
  {big('sum(signups)')} AS total_signups, {big('sum(buys)')} AS total_transactions,
  {rnd('coalesce(sum(rev), 0)', 2)} AS total_revenue,
  {rnd(div('sum(buys)', 'count(DISTINCT skey)'), 3)} AS session_conversion_rate
FROM s GROUP BY source"""),
    "session_conversion_rate": on_events(f""",
a AS (SELECT day, count(DISTINCT skey) AS n FROM ev GROUP BY day),
b AS (SELECT day, count(DISTINCT skey) AS n FROM ev x
      WHERE EXISTS (SELECT 1 FROM ev y WHERE y.event_name = 'purchase' AND y.day = x.day AND y.usr = x.usr) GROUP BY day)
SELECT a.day AS event_date, a.n AS total_sessions, coalesce(b.n, 0) AS converted_sessions,
  {rnd(div('b.n', 'a.n') + ' * 100', 3)} AS session_conversion_rate
FROM a LEFT JOIN b ON a.day = b.day"""),
    "bounce_rate_by_page": on_events(f""",
a AS (SELECT day, page, count(DISTINCT skey) AS n FROM ev GROUP BY day, page),
b AS (SELECT day, page, count(DISTINCT skey) AS n FROM ev WHERE engaged = 1 GROUP BY day, page)
SELECT a.day AS event_date, a.page AS page_location, a.n AS total_sessions, coalesce(b.n, 0) AS session_engaged,
  {rnd('1 - ' + div('coalesce(b.n, 0)', 'a.n'), 2)} AS bounce_rate
FROM a LEFT JOIN b ON a.day = b.day AND a.page = b.page"""),
    "page_engagement": on_events(f"""
SELECT page AS page_location, sum(msec) / CAST(1000 AS DOUBLE) AS total_engagement_time_seconds,
  count(CASE WHEN event_name = 'page_view' THEN 1 END) AS total_page_views,
  {div('sum(msec) / CAST(1000 AS DOUBLE)', "count(CASE WHEN event_name = 'page_view' THEN 1 END)")} AS average_engagement_time_per_page
FROM ev GROUP BY page"""),
    "hourly_event_funnel": on_events(""",
h AS (SELECT *, lpad(CAST((t // 3600000000) % 24 AS VARCHAR), 2, '0') AS hour FROM ev),
s AS (SELECT day, hour, count(DISTINCT sid) AS n FROM h WHERE event_name = 'session_start' GROUP BY 1, 2),
p AS (SELECT day, hour, count(t) AS n FROM h WHERE event_name = 'page_view' GROUP BY 1, 2),
v AS (SELECT day, hour, count(DISTINCT sid) AS n FROM h WHERE event_name = 'view_item' AND n_items > 0 GROUP BY 1, 2),
c AS (SELECT day, hour, count(DISTINCT sid) AS n FROM h WHERE event_name = 'add_to_cart' AND n_items > 0 GROUP BY 1, 2),
o AS (SELECT day, hour, count(DISTINCT sid) AS n FROM h WHERE event_name = 'purchase' AND n_items > 0 GROUP BY 1, 2)
SELECT s.day AS event_date, strftime(s.day, '%W') AS iso_week_of_the_year, strftime(s.day, '%w - %A') AS weekday, s.hour,
  s.n AS sessions, p.n AS pageviews, v.n AS view_item_sessions, c.n AS add_to_cart_sessions, o.n AS order_sessions
FROM s LEFT JOIN p USING (day, hour) LEFT JOIN v USING (day, hour) LEFT JOIN c USING (day, hour) LEFT JOIN o USING (day, hour)"""),
    "attribution_first_click": on_events(f""",
f AS (SELECT usr, src, med, camp, row_number() OVER (PARTITION BY usr ORDER BY t, seq) AS n FROM ev WHERE event_name = 'session_start'),
c AS (SELECT usr, coalesce(val_int, 0) + coalesce(val_flt, 0.0) + coalesce(val_dbl, 0.0) AS amount FROM ev WHERE event_name = 'purchase')
SELECT src AS first_utm_source, med AS first_utm_medium, camp AS first_utm_campaign, {money('amount')} AS total_purchase_value
FROM f JOIN c USING (usr) WHERE n = 1 AND amount > 0 GROUP BY src, med, camp"""),
    "attribution_last_click": on_events(f""",
u AS (SELECT usr, src, camp, count(DISTINCT session_id) AS n, sum(CAST(rev AS DECIMAL(24,6))) AS r FROM ev
      WHERE event_name = 'purchase' GROUP BY usr, src, camp)
SELECT src AS traffic_source, camp AS campaign, {big('sum(n)')} AS total_conversions, {money('r')} AS total_revenue,
  {rnd(div(money('r'), 'sum(n)'), 2)} AS average_revenue_per_conversion
FROM u GROUP BY src, camp"""),
    "attribution_linear": on_events(f""",
f AS (SELECT usr, min(t) AS lo, max(t) AS hi, count(DISTINCT src) AS n FROM ev GROUP BY usr),
l AS (SELECT ev.usr, src, CAST({div('count(src)', 'n')} AS DECIMAL(28,12)) AS score, sum(CAST(rev AS DECIMAL(24,6))) AS r
      FROM ev JOIN f ON ev.usr = f.usr WHERE t BETWEEN lo AND hi GROUP BY ev.usr, src, n)
SELECT src AS traffic_source, CAST(sum(score) AS DOUBLE) AS total_attribution_score, CAST(sum(r) AS DOUBLE) AS total_revenue
FROM l GROUP BY src"""),
    "attribution_time_decay": on_events(f""",
i AS (SELECT usr, t AS touched, src, med, camp FROM ev WHERE event_name IN ('session_start', 'page_view', 'click')),
c AS (SELECT usr, t AS bought, coalesce(val_int, 0) + coalesce(val_flt, 0.0) + coalesce(val_dbl, 0.0) AS amount FROM ev WHERE event_name = 'purchase'),
s AS (SELECT src, med, camp, sum({DECAYED}) AS x FROM i JOIN c USING (usr) WHERE amount > 0 GROUP BY src, med, camp)
SELECT src AS utm_source, med AS utm_medium, camp AS utm_campaign,
  CASE WHEN {DIGITS} >= 0 THEN round(x / pow(10.0, {DIGITS})) * pow(10.0, {DIGITS})
       ELSE round(x * pow(10.0, -{DIGITS})) / pow(10.0, -{DIGITS}) END AS total_attributed_value
FROM s"""),
    "attribution_time_decay_before": on_events(f""",
i AS (SELECT usr, t AS touched, src, med, camp FROM ev WHERE event_name IN ('session_start', 'page_view', 'click')),
c AS (SELECT usr, t AS bought, coalesce(val_int, 0) + coalesce(val_flt, 0.0) + coalesce(val_dbl, 0.0) AS amount FROM ev WHERE event_name = 'purchase'),
s AS (SELECT src, med, camp, sum({DECAYED}) AS x FROM i JOIN c USING (usr) WHERE amount > 0 AND bought >= touched GROUP BY src, med, camp)
SELECT src AS utm_source, med AS utm_medium, camp AS utm_campaign,
  CASE WHEN {DIGITS} >= 0 THEN round(x / pow(10.0, {DIGITS})) * pow(10.0, {DIGITS})
       ELSE round(x * pow(10.0, -{DIGITS})) / pow(10.0, -{DIGITS}) END AS total_attributed_value
FROM s"""),
    "page_revenue_attribution": on_events(f""",
b AS (SELECT skey, t, CAST(sum(CAST(rev AS DECIMAL(24,6))) AS DOUBLE) AS amount FROM ev
      WHERE event_name = 'purchase' AND rev IS NOT NULL GROUP BY skey, t),
p AS (SELECT skey, t, regexp_replace(page, '\\?.*$', '') AS pg FROM ev WHERE event_name = 'page_view'),
j AS (SELECT p.skey || '-' || b.t AS id, amount, pg FROM p JOIN b ON p.skey = b.skey AND p.t < b.t),
a AS (SELECT id, pg, CAST({rnd(div('amount', 'count(pg) OVER (PARTITION BY id)'), 2)} AS DECIMAL(24,2)) AS part FROM j),
r AS (SELECT pg, CAST(sum(part) AS DOUBLE) AS total, count(DISTINCT id) AS influence FROM a GROUP BY pg),
n AS (SELECT pg, count(pg) AS views FROM p GROUP BY pg)
SELECT n.pg AS page_location, views, influence AS purchase_influence, {rnd('total', 2)} AS page_revenue,
  {rnd(div('total', 'views'), 3)} AS page_value
FROM n JOIN r ON n.pg = r.pg WHERE total IS NOT NULL"""),
    "source_product_revenue": on_events(f""",
z AS (SELECT usr, skey, {SOURCE} AS source, (t - 18000000000) // 1000000 AS sec, t, seq FROM ev),
s AS (SELECT usr, skey, source, min(sec) OVER (PARTITION BY skey) AS started,
             row_number() OVER (PARTITION BY skey ORDER BY sec, t, seq) AS n FROM z),
l AS (SELECT skey, last_value(source IGNORE NULLS) OVER (PARTITION BY usr ORDER BY started) AS source FROM s WHERE n = 1),
g AS (SELECT skey, item_category, item_name, sum(CAST(item_revenue AS DECIMAL(24,6))) AS price, sum(quantity) AS quantity
      FROM item WHERE event_name = 'purchase' AND txn LIKE '%live%' GROUP BY 1, 2, 3),
ct AS (SELECT item_category, item_name, {big('sum(quantity)')} AS q, {rnd('sum(price)', 2)} AS r FROM g GROUP BY 1, 2)
SELECT coalesce(l.source, 'direct') AS traffic_source, g.item_category, g.item_name, ct.q AS total_products_purchased,
  ct.r AS total_category_revenue, {big('sum(g.quantity)')} AS total_quantity_purchased,
  {rnd(div('sum(g.quantity)', 'ct.q'), 2)} AS purchase_percentage_of_total, {rnd('sum(g.price)', 2)} AS total_revenue,
  {rnd(div('CAST(sum(g.price) AS DOUBLE)', 'ct.r'), 2)} AS revenue_percentage_of_total
FROM l LEFT JOIN g ON l.skey = g.skey LEFT JOIN ct ON g.item_category = ct.item_category AND g.item_name = ct.item_name
GROUP BY coalesce(l.source, 'direct'), g.item_category, g.item_name, ct.q, ct.r"""),
    "marketing_channels": on_events(f""",
c AS (SELECT {channel_case()} AS channel, count(DISTINCT skey) AS n FROM ev GROUP BY 1)
SELECT channel AS channel_grouping, n AS session_count, {rnd(div('100 * n', 'sum(n) OVER ()'), 2)} AS session_percentage FROM c"""),
    "traffic_category": on_events("""
SELECT usr AS user_pseudo_id, src AS source, CASE WHEN src IN ('google', 'bing', 'yahoo') THEN 'Search'
  WHEN src IN ('facebook', 'instagram', 'twitter') THEN 'Social' WHEN src = 'direct' THEN 'Direct' ELSE 'Other' END AS traffic_category
FROM ev"""),
    "engagement_status": on_events("""
SELECT usr AS user_pseudo_id, session_id,
  CASE engaged WHEN 1 THEN 'Engaged' WHEN 0 THEN 'Not Engaged' ELSE 'Unknown' END AS session_status FROM ev"""),
    "clv_sessions_correlation": f"""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey, CASE k WHEN 0 THEN c_acctbal ELSE c_acctbal * 0.5 + 100 END AS r,
             coalesce(n, 0) + CASE k WHEN 0 THEN 0 ELSE c_custkey % 7 END AS n
      FROM customer LEFT JOIN o ON c_custkey = o_custkey CROSS JOIN (VALUES (0), (1)) AS days(k)),
u AS (SELECT c_custkey, max(r) AS r, max(n) AS n FROM s WHERE r > 0 GROUP BY c_custkey)
SELECT {rnd('CASE WHEN isnan(corr(r, n)) THEN NULL ELSE corr(r, n) END', 2)} AS clv_sessions_correlation FROM u""",
    "cohort_retention": on_events(""",
x AS (SELECT usr, day, first_value(day) OVER (PARTITION BY usr ORDER BY day) AS first FROM ev),
w AS (SELECT usr, strftime(first, '%G-%V') AS year_week,
             (CAST(date_trunc('week', day) AS DATE) - CAST(date_trunc('week', first) AS DATE)) // 7 AS gap FROM x)
SELECT year_week, count(DISTINCT usr) AS cohort_size, """
        + ", ".join(f"count(DISTINCT CASE WHEN gap = {n} THEN usr END) AS week_{n}" for n in range(8)) + ", "
        + ", ".join(
            f"{div(f'count(DISTINCT CASE WHEN gap = {n} THEN usr END)', 'count(DISTINCT usr)')} * 100 AS week_{n}_retention_rate"
            for n in range(1, 5)
        ) + " FROM w GROUP BY year_week", stagger=True),
    "loyalty_tiers": on_events(f""",
u AS (SELECT usr, max(CASE WHEN event_name = 'loyalty_tier_update' THEN tier END) AS tier FROM ev
      WHERE event_name IN ('purchase', 'loyalty_tier_update') GROUP BY usr),
b AS (SELECT usr FROM ev WHERE event_name = 'purchase')
SELECT tier AS membership_tier, count(DISTINCT u.usr) AS total_members, count(b.usr) AS total_purchases,
  {rnd(div('count(b.usr)', 'count(DISTINCT u.usr)'), 2)} AS avg_purchases_per_user
FROM u LEFT JOIN b ON u.usr = b.usr GROUP BY tier"""),
    "promo_user_engagement": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, sessions AS promo_sessions, views AS promo_page_views, purchases, revenue AS revenue_generated,
  {div('purchases', 'sessions')} AS session_conversion_rate FROM engagement"""),
    "promo_touch_attribution": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, first_touch, last_touch, score AS linear_attribution_score FROM touches"""),
    "promo_ctr": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, promo_clicks, promo_views, {div('promo_clicks', 'promo_views')} AS promo_ctr FROM clicks"""),
    "promo_bounce": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, bounced AS bounced_sessions, sessions AS total_sessions, {div('bounced', 'sessions')} AS bounce_rate
FROM bounces"""),
    "user_clv": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, revenue AS total_revenue, sessions AS total_sessions,
  {div('revenue', 'sessions')} AS avg_revenue_per_session, {div('revenue', 'users')} AS estimated_clv FROM clv"""),
    "promo_retention": on_events(f""",{PROMO_VIEWS}
SELECT usr AS user_pseudo_id, first_t AS first_interaction, last_t AS last_interaction, days AS retention_days,
  sessions AS session_count FROM stay"""),
    "promo_funnel": on_events(f""",{PROMO_VIEWS},{SEARCH_ROWS},
sa AS (SELECT {', '.join(f"{big(f'sum(coalesce(CAST({flag(f)} AS INTEGER), 0))')} AS {n}" for f, n in [
    ('is_amp_top_stories', 'is_amp_top_stories'), ('is_amp_blue_link', 'is_amp_blue_link'),
    ('is_job_listing', 'is_job_listing'), ('is_video', 'is_video_results'), ('is_review_snippet', 'is_review_snippet')])} FROM sc)
SELECT pp.usr AS user_pseudo_id, pp.page AS page_location, pp.src AS source, pp.med AS medium, pp.device AS device_type,
  pp.country AS user_country, e.sessions AS promo_sessions, e.views AS promo_page_views, e.purchases,
  e.revenue AS revenue_generated, {div('e.purchases', 'e.sessions')} AS session_conversion_rate, a.first_touch, a.last_touch,
  a.score AS linear_attribution_score, {div('k.promo_clicks', 'k.promo_views')} AS promo_ctr,
  {div('b.bounced', 'b.sessions')} AS bounce_rate, {div('clv.revenue', 'clv.users')} AS estimated_clv,
  s.days AS retention_days, s.sessions AS session_count, sa.*
FROM pp LEFT JOIN engagement e ON pp.usr = e.usr LEFT JOIN touches a ON pp.usr = a.usr LEFT JOIN clicks k ON pp.usr = k.usr
LEFT JOIN bounces b ON pp.usr = b.usr LEFT JOIN clv ON pp.usr = clv.usr LEFT JOIN stay s ON pp.usr = s.usr CROSS JOIN sa"""),
    "promo_users": on_events(f""",{PROMO_VIEWS}
SELECT pp.usr AS user_pseudo_id, pp.page AS page_location, pp.src AS traffic_source, pp.med AS traffic_medium,
  pp.device AS device_type, pp.country AS user_country, e.sessions AS promo_sessions, e.views AS promo_page_views,
  e.purchases AS total_purchases, e.revenue AS total_revenue,
  {rnd(div('e.purchases', 'e.sessions') + ' * 100', 2)} AS conversion_rate
FROM pp LEFT JOIN engagement e ON pp.usr = e.usr"""),
    "promo_traffic_breakdown": on_events(f"""
SELECT src AS traffic_source, count(DISTINCT usr) AS total_users, count(DISTINCT session_id) AS total_sessions
FROM ev WHERE {IS_PROMO} GROUP BY src"""),
    "promo_vs_non_promo": on_events(f"""
SELECT {IS_PROMO} AS is_promo_visit, count(DISTINCT usr) AS total_users, count(DISTINCT session_id) AS total_sessions,
  count(CASE WHEN event_name = 'purchase' THEN 1 END) AS total_purchases, {money('rev')} AS total_revenue FROM ev GROUP BY 1"""),
    "promo_user_journey": on_events(f"""
SELECT usr AS user_pseudo_id, min(CASE WHEN {IS_PROMO} THEN t END) AS first_promo_visit,
  min(CASE WHEN event_name = 'purchase' THEN t END) AS first_purchase FROM ev GROUP BY usr"""),
    "search_appearance_totals": on_search(
        " SELECT " + ", ".join(f"{big(f'sum(coalesce(CAST({flag(f)} AS INTEGER), 0))')} AS {f}" for f in fixed.APPEARANCE_FLAGS)
        + " FROM sc"),
    "search_report": on_search(" " + " UNION ALL ".join([
        report_part("Device_Country", "device", "country"),
        report_part("Traffic_Source", "traffic_source"),
        report_part("Daily_Trends", "CAST(d AS VARCHAR)"),
        report_part("Search_Query_Performance", "search_query"),
        report_part("AMP_Performance", "CASE " + " ".join(
            f"WHEN {flag(f)} THEN '{label}'" for f, label in fixed.AMP_CLASSES) + " ELSE 'Non-AMP' END"),
        report_part("Keyword_Performance", "search_query", where=f"regexp_matches(lower(search_query), '{PROMO}')"),
    ])),
    "search_keyword_promo": on_search(
        f" SELECT search_query, {SEARCH_SUMS} FROM sc WHERE regexp_matches(lower(search_query), '{PROMO}') GROUP BY search_query"),
    "ctr_by_position": on_search(f""",
q AS (SELECT sum(top) / sum(impressions) + 1.0 AS pos, sum(clicks) / nullif(CAST(sum(impressions) AS DOUBLE), 0) AS ctr
      FROM sc WHERE impressions > 0 AND top < 20 GROUP BY query)
SELECT {rnd('pos', 0)} AS position, {rnd('avg(ctr) * 100', 2)} AS avg_ctr_percentage FROM q GROUP BY 1"""),
    "search_query_device": on_search(f"""
SELECT query, device, {big('sum(impressions)')} AS impressions, {big('sum(clicks)')} AS clicks,
  {rnd(div('sum(clicks)', 'sum(impressions)'), 4)} AS ctr, {rnd(div('sum(top)', 'sum(impressions)') + ' + 1.0', 2)} AS avg_position
FROM sc WHERE query IS NOT NULL GROUP BY query, device"""),
    "ctr_position_daily_corr": on_search(f"""{DAILY_CORRELATION}
SELECT d AS data_date, {rnd('c', 4)} AS ctr_position_correlation FROM c"""),
    "ctr_position_corr_trend": on_search(f"""{DAILY_CORRELATION},
f AS (SELECT CAST(g AS DATE) AS d, coalesce(c, 0) AS c FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) s(g)
      LEFT JOIN c ON CAST(g AS DATE) = c.d),
m AS (SELECT month(d) AS m, {rnd('avg(c)', 4)} AS mean FROM f GROUP BY 1)
SELECT d AS data_date, {rnd('c', 4)} AS ctr_position_correlation,
  {', '.join(f"{rnd(f'avg(c) OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)', 4)} AS moving_avg_{n}d" for n in (7, 14, 30))},
  mean AS avg_monthly_corr
FROM f LEFT JOIN m ON month(f.d) = m.m"""),
    "ads_campaign_performance": on_events(f"""
SELECT ads AS google_ads_campaign, channel_group AS primary_channel, count(DISTINCT usr) AS unique_users,
  {money('rev')} AS total_revenue, {div(money('rev'), 'count(DISTINCT usr)')} AS revenue_per_user
FROM ev WHERE ads IS NOT NULL AND rev IS NOT NULL GROUP BY ads, channel_group"""),
    "ads_campaign_sessions": on_events(f""",
s AS (SELECT acct, ads, device, count(DISTINCT skey) AS n FROM ev WHERE acct IS NOT NULL AND ads IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT acct, ads, device, count(CASE WHEN event_name = 'purchase' THEN 1 END) AS buys, {money('rev')} AS rev FROM ev
      WHERE acct IS NOT NULL AND ads IS NOT NULL GROUP BY 1, 2, 3)
SELECT s.acct AS google_ads_account_name, s.ads AS google_ads_campaign_name, s.device AS device_type, s.n AS session_count,
  coalesce(c.buys, 0) AS total_purchases, coalesce(c.rev, 0) AS total_revenue
FROM s LEFT JOIN c ON s.acct = c.acct AND s.ads = c.ads AND s.device = c.device"""),
    "ads_revenue_transactions": on_events(f""",
d AS (SELECT event_date, ads, {money('rev')} AS rev, count(DISTINCT txn) AS n, count(DISTINCT usr) AS u FROM ev
      WHERE ads IS NOT NULL AND txn IS NOT NULL GROUP BY event_date, ads)
SELECT event_date, ads AS campaign_name, rev AS daily_revenue, n AS daily_transactions, u AS unique_users,
  {div('rev', 'u')} AS revenue_per_user, {div('n', 'u')} AS transactions_per_user,
  {rnd(div('rev', 'n'), 2)} AS average_revenue_per_transaction FROM d"""),
    "organic_query_value": on_events(f""",{SEARCH_ROWS},
c AS (SELECT usr, sid, coalesce(val_dbl, val_flt, val_int, 0) AS amount FROM ev WHERE event_name = 'purchase'),
s AS (SELECT usr, sid, page FROM ev WHERE event_name = 'session_start' AND src || '/' || med = 'google/organic'),
ga AS (SELECT {TRANSFORM.format('page')} AS url, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(24,6))) AS DOUBLE) AS amount
       FROM s JOIN c ON s.usr = c.usr AND s.sid = c.sid GROUP BY 1),
gq AS (SELECT query, {TRANSFORM.format('url')} AS url, sum(clicks) AS clicks FROM sc
       WHERE clicks > 0 AND query IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2),
w AS (SELECT query, url, clicks, sum(clicks) OVER (PARTITION BY url) AS all_clicks FROM gq),
p AS (SELECT query, {rnd(div('n * clicks', 'all_clicks'), 2)} AS credit, amount FROM w JOIN ga ON w.url = ga.url WHERE n > 0)
SELECT query AS search_query, {rnd('sum(CAST(credit AS DECIMAL(24,6)))', 2)} AS total_sov_conversion,
  {rnd('sum(CAST(credit * amount AS DECIMAL(24,6)))', 2)} AS total_purchase_value FROM p GROUP BY query"""),
    "daily_metrics": on_events(f""",
s AS (SELECT usr, sid, day, max(t) - min(t) AS us FROM ev GROUP BY usr, sid, day),
sa AS (SELECT day, count(DISTINCT usr || sid) AS sessions, {div('sum(us)', 'count(*)')} / 1000000 AS seconds FROM s GROUP BY day),
ea AS (
  SELECT day, count(DISTINCT usr) AS users, count(CASE WHEN event_name = 'page_view' THEN 1 END) AS pv, count(CASE WHEN event_name = 'purchase' THEN 1 END) AS buys,
    {money('rev')} AS rev, count(DISTINCT CASE WHEN snum = 1 THEN usr END) AS fresh,
    count(DISTINCT CASE WHEN engaged = 1 THEN usr || sid END) AS engaged, count(DISTINCT usr || sid) AS visits, count(*) AS n
  FROM ev GROUP BY day
)
SELECT ea.day AS date_formatted, sa.sessions, sa.seconds AS "averageSessionDuration_seconds", users AS "totalUsers",
  fresh AS "NewUsers", buys AS "Purchases", coalesce(rev, 0) AS "purchaseRevenue", pv AS "screenPageViews",
  engaged AS "engagedSessions", {rnd(div('engaged', 'visits') + ' * 100', 2)} AS "engagementRate_percent", n AS "eventCount"
FROM ea LEFT JOIN sa ON ea.day = sa.day"""),
    "performance_trend": on_events(f""",
d AS (SELECT day, count(DISTINCT skey) AS n, count(DISTINCT CASE WHEN event_name = 'purchase' THEN usr END) AS buyers,
             {money("CASE WHEN event_name = 'purchase' THEN val_dbl END")} AS rev FROM ev GROUP BY day)
SELECT day AS event_date, n AS total_sessions, lag(n) OVER w AS previous_sessions,
  {rnd('avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 2)} AS avg_sessions_7d,
  CASE WHEN n > lag(n) OVER w THEN 'Increase' WHEN n < lag(n) OVER w THEN 'Decrease' ELSE 'Stable' END AS session_trend,
  buyers AS purchasing_users, rev AS total_revenue
FROM d WINDOW w AS (ORDER BY day)"""),
    "consent_user_estimate": on_events(f""",
f(factor, state) AS (VALUES (2.0, 'Granted'), (3.0, 'Denied')),
d AS (SELECT CASE WHEN usr IS NOT NULL THEN 'Granted' ELSE 'Denied' END AS state, count(*) AS n, count(DISTINCT usr) AS users
      FROM ev WHERE event_name = 'page_view' GROUP BY 1)
SELECT d.state AS consent_state, n AS total_events, users AS distinct_users, {big(rnd(div('n', 'factor'), 0))} AS estimated_users,
  {rnd(div('n', 'sum(n) OVER ()'), 4)} AS event_share
FROM d LEFT JOIN f ON d.state = f.state"""),
    "consent_summary": on_events(f""",
g AS (
  SELECT astore, adstore, device, country, count(*) AS n, count(DISTINCT usr) AS users, count(DISTINCT skey) AS sessions,
    {div('sum(msec)', 'count(msec)')} / 1000 AS seconds, count(DISTINCT CASE WHEN snum = 1 THEN usr END) AS fresh,
    {money("CASE WHEN event_name = 'purchase' THEN val_dbl ELSE 0 END")} AS rev,
    count(DISTINCT CASE WHEN event_name = 'purchase' THEN usr END) AS buyers
  FROM ev GROUP BY 1, 2, 3, 4
)
SELECT astore AS analytics_storage_status, adstore AS ads_storage_status, device AS device_type, country AS user_country,
  n AS total_events, {rnd(div('n', 'sum(n) OVER ()') + ' * 100', 2)} AS event_percentage,
  users AS total_users, {rnd(div('users', 'sum(users) OVER ()') + ' * 100', 2)} AS user_percentage,
  sessions AS total_sessions, {rnd(div('sessions', 'sum(sessions) OVER ()') + ' * 100', 2)} AS session_percentage,
  seconds AS avg_engagement_time_sec, fresh AS new_users, rev AS total_revenue, buyers AS converting_users
FROM g"""),
    "non_consented_by_country": on_events("""
SELECT day AS date_formatted, country, count(*) AS total_events FROM ev WHERE astore = 'No' AND adstore = 'No' GROUP BY 1, 2"""),
    "measurement_protocol_ratio": on_events(f"""
SELECT day AS event_date,
  {rnd(div("count(CASE WHEN lang IS NULL AND os IS NULL AND device = 'desktop' THEN 1 END)", 'count(*)'), 4)} AS measurement_protocol_event_ratio
FROM ev GROUP BY day"""),
    "event_pivot": on_events(
        " SELECT usr AS user_pseudo_id, "
        + ", ".join(f"count(CASE WHEN event_name = '{n}' THEN 1 END) AS {n}" for n in fixed.PIVOT_EVENTS) + " FROM ev GROUP BY usr"),
    "flat_event_params": on_events(f"{FLATS} SELECT * FROM par"),
    "flat_user_properties": on_events(f"{FLATS} SELECT * FROM prop"),
    "flat_items": on_events(f"{FLATS} SELECT * FROM it"),
    "flat_events": on_events(f"""{FLATS}
SELECT b.*, par.* EXCLUDE (user_pseudo_id, event_timestamp, event_name), prop.* EXCLUDE (user_pseudo_id, event_timestamp, event_name),
  it.* EXCLUDE (user_pseudo_id, event_timestamp, event_name)
FROM (SELECT {EVENT_KEYS} FROM ev) b
LEFT JOIN par ON b.user_pseudo_id = par.user_pseudo_id AND b.event_timestamp = par.event_timestamp AND b.event_name = par.event_name
LEFT JOIN prop ON b.user_pseudo_id = prop.user_pseudo_id AND b.event_timestamp = prop.event_timestamp AND b.event_name = prop.event_name
LEFT JOIN it ON b.user_pseudo_id = it.user_pseudo_id AND b.event_timestamp = it.event_timestamp AND b.event_name = it.event_name"""),
    "sales_customer_asof_membership": """
WITH c AS (SELECT c_custkey, c_name, lower(c_name) || '@example.com' AS email,
                  DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS since FROM customer)
SELECT o_orderkey AS sale_id, o_custkey AS customer_id, c_name AS customer_name, email AS customer_email,
  o_orderkey % 2000 AS product_id, o_totalprice AS sale_amount
FROM orders LEFT JOIN c ON o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= since
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""",
    "monthly_partitioned_sink": on_events("""
SELECT 'web_analytics_' || strftime(day, '%Y%m') AS table_name, day AS event_date, count(*) AS row_count,
  count(DISTINCT CASE WHEN usr IS NOT NULL THEN uid END) AS users, count(DISTINCT session_id) AS sessions, max(t) AS last_event
FROM ev WHERE day >= DATE '2023-02-01' AND day < DATE '2024-02-01' GROUP BY 1, 2"""),
}
