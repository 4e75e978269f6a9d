"""The same results in SQL, written apart from the DataFrame plans."""

from __future__ import annotations

import ipaddress

from sievework.functions import fixed
from sievework.sources.batches import VERTICALS


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, pairs, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {other} END"


def _lcs(a: str, b: str) -> str:
    cell = f"CASE WHEN substr({b}, i, 1) = c THEN (CASE WHEN i = 1 THEN 0 ELSE r[i - 1] END) + 1 ELSE r[i] END"
    row = f"list_transform(range(1, len({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: {cell})))"
    return f"coalesce(list_reduce(string_split({a}, ''), lambda r, c: {row}, list_transform(range(1, len({b}) + 1), lambda z: 0))[-1], 0)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END)"


_SRC = """
base AS (
  SELECT 'batch_1' AS batch, 1 AS batch_seq, c_custkey AS k, c_nationkey AS nk, c_mktsegment AS niche FROM customer
  UNION ALL SELECT 'batch_2', 2, 1000000 + s_suppkey, s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'batch_3', 3, c_custkey, c_nationkey, NULL FROM customer WHERE c_custkey % 7 = 0),
src AS (SELECT batch, batch_seq, CAST(batch_seq * 10000000 + k AS BIGINT) AS row_id, k AS row_no, k, niche, n_name, r_name,
  CASE WHEN k % 97 = 0 THEN 'Advertiser ' || (13000000 + k) WHEN k % 11 = 1 THEN 'Dr. ' || p_name WHEN k % 11 = 2 THEN 'UNIT' || (k - k % 3) || '  ' || p_name || ' Pvt Ltd'
       WHEN k % 11 = 3 THEN 'Unit' || (k - k % 3) || ' ' || p_name || ' Clinic' ELSE 'Unit' || (k - k % 3) || ' ' || p_name END AS name,
  CASE k % 9 WHEN 0 THEN ' U' || k || '@Gmail.com ' WHEN 1 THEN 'u' || k || '@gamil.com' WHEN 2 THEN 'u' || k || '@gmaill.com' WHEN 3 THEN 'info@biz' || k || '.test' WHEN 4 THEN 'sales+x@biz' || k || '.test'
       WHEN 5 THEN 'not-an-email' WHEN 6 THEN 'u' || k || '@mailinator.com' WHEN 8 THEN 'u' || k || '@yahoo.com' END AS email,
  CASE WHEN k % 50 = 1 THEN '+91 9' || lpad(CAST(k - 1 AS VARCHAR), 9, '0') WHEN k % 23 = 5 THEN '+91 12' ELSE '+91 9' || lpad(CAST(k AS VARCHAR), 9, '0') END AS phone,
  CASE k % 8 WHEN 0 THEN 'http://www.megaportal.test/' WHEN 1 THEN 'https://linktr.ee/someone' WHEN 2 THEN NULL WHEN 3 THEN 'http://www.nodots/'
       ELSE 'HTTP://www.Biz' || (k - k % 3) || '.test//shop/?utm_source=fb&id=' || k || '&fbclid=z#top' END AS website,
  CASE WHEN k % 3 = 0 THEN 'https://www.facebook.com/' || (61500000000000 + k) ELSE 'https://facebook.com/Page.' || k || '/' END AS facebook,
  CASE k % 4 WHEN 0 THEN 'Road' WHEN 1 THEN n_name WHEN 2 THEN lower(n_name) ELSE r_name END AS city,
  CASE WHEN k % 10 = 0 THEN NULL ELSE p_type END AS fb_category,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN CAST(k + batch_seq AS VARCHAR) WHEN 3 THEN '1.4K' WHEN 4 THEN (k % 900) || 'K' ELSE 'many' END AS followers,
  CASE WHEN batch_seq = 2 THEN NULL ELSE 'query ' || ((k * batch_seq) % 171) END AS matched_query,
  CASE WHEN batch_seq = 1 THEN ['High', 'Medium', 'Low'][CAST(k % 3 + 1 AS INTEGER)] END AS relevance, batch_seq = 3 AS source_inferred
  FROM base JOIN part ON p_partkey = k % 200 JOIN nation ON n_nationkey = nk JOIN region ON r_regionkey = n_regionkey)"""

_fold = lambda c: f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_suffix = "CASE " + " ".join(f"WHEN ends_with(f, ' {s}') THEN trim(left(f, length(f) - {len(s) + 1}))" for s in fixed.LEGAL_SUFFIXES) + " ELSE f END"
_any = lambda values: "len(list_intersect(string_split(nv, ' '), [" + ", ".join(f"'{v}'" for v in values) + "])) > 0"
_classes = "CASE " + " ".join(f"WHEN host IN {_in(h)} OR dom IN {_in(h)} THEN '{n}'" for n, h in fixed.HOST_CLASSES.items()) + " END"

_NORM = rf"""
n1 AS (SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS disp, {_fold("trim(regexp_replace(name, '\\s+', ' ', 'g'))")} AS f,
  trim(regexp_replace(lower(email), '\s', '', 'g'), '.,;:<>()[]"''') AS e0, regexp_replace(phone, '[^0-9]', '', 'g') AS digits,
  lower(regexp_extract(website, '^[A-Za-z]+://([^/?#]*)', 1)) AS auth, regexp_extract(website, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(website, '^[^?#]*\?([^#]*)', 1) AS q0 FROM src),
n2 AS (SELECT *, coalesce(nullif({_suffix}, ''), lower(disp)) AS nv, CASE WHEN regexp_matches(e0, '{fixed.EMAIL_PATTERN}') THEN e0 END AS e, regexp_replace(regexp_replace(auth, ':\d*$', ''), '^www\.', '') AS host0,
  CASE WHEN length(digits) = 12 AND digits LIKE '91%' THEN digits END AS ph FROM n1),
n3 AS (SELECT *, {_case("split_part(e, '@', 2)", fixed.TYPOS.items(), "split_part(e, '@', 2)")} AS dom0, split_part(e, '@', 2) IN {_in(list(fixed.TYPOS))} AS typo0, CASE WHEN contains(host0, '.') THEN host0 END AS host FROM n2),
near AS (SELECT d, [m FOR m IN {list(fixed.MAJORS)} IF {_ratio("d", "m")} >= {fixed.LOOKALIKE_RATIO}][1] AS m FROM (SELECT DISTINCT dom0 AS d FROM n3 WHERE e IS NOT NULL) WHERE d NOT IN {_in(fixed.FREEMAIL)}),
n4 AS (SELECT *, CASE WHEN e IS NOT NULL THEN dom0 END AS email_domain, coalesce(typo0, false) AS email_typo, CASE WHEN host IS NOT NULL THEN array_to_string(string_split(host, '.')[-2:], '.') END AS dom FROM n3 LEFT JOIN near ON d = dom0 AND e IS NOT NULL AND NOT typo0),
n5 AS (SELECT *, split_part(e, '@', 1) || '@' || email_domain AS email_value, coalesce(email_domain IN {_in(fixed.FREEMAIL)}, false) AS email_free, coalesce(split_part(split_part(e, '@', 1), '+', 1) IN {_in(fixed.ROLES)}, false) AS email_role,
  coalesce(email_domain IN {_in(fixed.DISPOSABLE)}, false) AS email_disposable, m IS NOT NULL AS email_lookalike, CASE WHEN ph IS NOT NULL THEN '+' || ph END AS phone_value,
  CASE WHEN host IS NOT NULL THEN 'https://' || host || rtrim(regexp_replace(path0, '/+', '/', 'g'), '/') || CASE WHEN q1 <> '' THEN '?' || q1 ELSE '' END END AS website_value, {_classes} AS website_class
  FROM (SELECT *, array_to_string([p FOR p IN string_split(q0, '&') IF NOT regexp_matches(split_part(p, '=', 1), '{fixed.TRACKING_PATTERN}')], '&') AS q1 FROM n4)),
n6 AS (SELECT *, host IS NOT NULL AND website_class IS NULL AS website_owned, lower(regexp_extract(facebook, '^https://[^/]*/([^/?#]+)', 1)) AS facebook_handle, regexp_matches(disp, '{fixed.PLACEHOLDER_PATTERN}') AS name_placeholder,
  CASE WHEN followers IS NULL OR followers = 'many' THEN NULL WHEN followers LIKE '%K' THEN CAST(round_even(CAST(rtrim(followers, 'K') AS DOUBLE) * 1000, 0) AS BIGINT) ELSE CAST(followers AS BIGINT) END AS followers_value,
  'https://facebook.com/' || regexp_extract(facebook, '^https://[^/]*/([^/?#]+)', 1) AS facebook_value,
  CASE WHEN k % 4 IN (1, 2) THEN lower(replace(n_name, '_', '-')) WHEN k % 4 = 3 THEN lower(replace(r_name, ' ', '-')) END AS location_slug, CASE WHEN k % 4 IN (1, 2) THEN n_name WHEN k % 4 = 3 THEN r_name END AS location_name,
  CASE WHEN k % 4 > 0 THEN r_name END AS location_state, CASE WHEN k % 4 IN (1, 2) THEN 'exact' WHEN k % 4 = 3 THEN 'state' END AS location_match, CASE WHEN k % 4 IN (1, 2) THEN 1.0::DOUBLE WHEN k % 4 = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS location_confidence,
  nullif({_case("lower(fb_category)", VERTICALS)}, 'unclassified') AS fbs, nullif({_case("lower(niche)", VERTICALS)}, 'unclassified') AS ns,
  coalesce({_case("lower(fb_category)", VERTICALS)} = 'unclassified', false) OR coalesce({_case("lower(niche)", VERTICALS)} = 'unclassified', false) AS generic FROM n5),
norm AS (SELECT *, CASE WHEN {_any(fixed.BUSINESS_TOKENS)} THEN 'business' WHEN {_any(fixed.HONORIFICS)} THEN 'person' WHEN len(string_split(nv, ' ')) >= 4 THEN 'business' ELSE 'unknown' END AS name_kind,
  CASE WHEN name_placeholder THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS name_confidence, regexp_matches(facebook_handle, '^\d{{8,}}$') AS facebook_numeric, CASE WHEN website_owned THEN dom END AS company_domain,
  CASE WHEN fb_category IS NOT NULL OR niche IS NOT NULL THEN coalesce(fbs, ns, 'unclassified') END AS category_slug, CASE WHEN fbs IS NOT NULL THEN 0.9::DOUBLE WHEN ns IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS category_confidence,
  CASE WHEN e IS NULL THEN 0.0::DOUBLE WHEN email_disposable THEN 0.2::DOUBLE WHEN email_typo THEN 0.75::DOUBLE WHEN email_lookalike THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS email_confidence,
  CASE WHEN host IS NULL THEN 0.0::DOUBLE WHEN website_class IS NOT NULL THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS website_confidence FROM n6)"""

_codes = [
    ("name", "name_placeholder", "name_placeholder"), ("city", "city_address_fragment", "k % 4 = 0"), ("city", "city_resolved_to_state_only", "k % 4 = 3"),
    ("category", "category_generic", "category_slug = 'unclassified' AND generic"), ("category", "category_unmapped", "category_slug = 'unclassified' AND NOT generic"), ("followers", "followers_unparseable", "followers = 'many'"),
    ("email", "email_invalid_syntax", "email IS NOT NULL AND e IS NULL"), ("email", "email_typo_domain_corrected", "email_typo"), ("email", "email_domain_lookalike", "email_lookalike"), ("email", "email_disposable_domain", "email_disposable"),
    ("phone", "phone_impossible", "ph IS NULL"), ("website", "url_missing_host", "website IS NOT NULL AND host IS NULL"), *[("website", f"website_not_owned_{c}", f"website_class = '{c}'") for c in fixed.HOST_CLASSES], ("facebook", "profile_numeric_id_only", "facebook_numeric"),
]
_rules = [
    ("contact", "no_contact_channel", "email_value IS NULL AND phone_value IS NULL"), ("email", "email_domain_website_mismatch", "email_domain IS NOT NULL AND company_domain IS NOT NULL AND NOT email_free AND email_domain <> company_domain AND NOT ends_with(email_domain, '.' || company_domain)"),
    ("record", "thin_record", f"company_domain IS NULL AND coalesce(followers_value, 0) < {fixed.THIN_FOLLOWERS}"), ("followers", "zero_followers", "followers_value = 0"), ("facebook", "unverifiable_identity", "facebook_numeric AND name_placeholder"),
]
_union = lambda codes: " UNION ALL ".join(f"SELECT row_id, '{f}' AS field, '{c}' AS code FROM norm WHERE {w}" for f, c, w in codes)
_SEVERITY = "CASE WHEN code IN ('email_invalid_syntax','email_disposable_domain','phone_impossible','url_missing_host','no_contact_channel') THEN 'error' WHEN code IN ('profile_numeric_id_only','city_resolved_to_state_only','email_domain_website_mismatch','zero_followers') THEN 'info' ELSE 'warning' END"

_RESOLVE = f"""
ks AS (SELECT row_id, 'email' AS kind, 'email:' || email_value AS key FROM norm WHERE email_value IS NOT NULL UNION ALL SELECT row_id, 'phone', 'phone:' || phone_value FROM norm WHERE phone_value IS NOT NULL
  UNION ALL SELECT row_id, 'facebook', 'facebook:' || facebook_value FROM norm),
star AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY key) AS b FROM ks),
edge AS (SELECT DISTINCT a, b FROM star WHERE a <> b UNION SELECT DISTINCT b, a FROM star WHERE a <> b),
reach(a, b) AS (SELECT row_id, row_id FROM norm UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
rows_ AS (SELECT norm.*, c.lead_key FROM norm JOIN (SELECT a, min(b) AS lead_key FROM reach GROUP BY a) c ON c.a = norm.row_id),
iss AS (SELECT i.row_id, field, code, {_SEVERITY} AS severity, lead_key FROM ({_union(_codes + _rules)}) i JOIN rows_ USING (row_id)),
obs AS (SELECT lead_key, batch, batch_seq, arg_max(followers_value, row_no) AS value FROM rows_ WHERE followers_value IS NOT NULL GROUP BY ALL),
nm AS (SELECT lead_key, disp AS display_name, nv AS normalized_name, name_kind AS entity_kind, row_number() OVER (PARTITION BY lead_key ORDER BY name_placeholder, name_confidence DESC, length(disp) DESC, row_id) AS r FROM rows_),
lc AS (SELECT lead_key, location_slug, location_name, location_state, location_confidence, row_number() OVER (PARTITION BY lead_key ORDER BY location_confidence DESC, row_id) AS r FROM rows_ WHERE location_slug IS NOT NULL),
ct AS (SELECT lead_key, category_slug, category_confidence, row_number() OVER (PARTITION BY lead_key ORDER BY category_slug = 'unclassified', CASE WHEN category_slug <> 'unclassified' THEN category_confidence ELSE 0 END DESC, row_id) AS r FROM rows_ WHERE category_slug IS NOT NULL),
ag AS (SELECT lead_key, count(*) AS n_rows, bool_and(name_placeholder) AS is_placeholder, min(batch_seq) AS first_batch, max(batch_seq) AS last_batch, bool_or(source_inferred) AS source_inferred, min(relevance) AS relevance,
  arg_min(company_domain, row_id) FILTER (WHERE company_domain IS NOT NULL) AS company_domain, arg_max(followers_value, batch_seq * 100000000 - row_no) FILTER (WHERE followers_value IS NOT NULL) AS latest_followers FROM rows_ GROUP BY lead_key),
leads AS (SELECT ag.*, display_name, normalized_name, entity_kind, location_slug, location_name, location_state, location_confidence, category_slug, category_confidence FROM ag JOIN nm ON nm.lead_key = ag.lead_key AND nm.r = 1
  LEFT JOIN lc ON lc.lead_key = ag.lead_key AND lc.r = 1 LEFT JOIN ct ON ct.lead_key = ag.lead_key AND ct.r = 1),
id0 AS (SELECT lead_key, row_id, 'email' AS kind, email_value AS value, email_confidence AS confidence, email_domain AS domain, email_free AS free, email_role AS role, false AS owned, false AS num FROM rows_ WHERE email_value IS NOT NULL
  UNION ALL SELECT lead_key, row_id, 'phone', phone_value, 1.0, NULL, false, false, false, false FROM rows_ WHERE phone_value IS NOT NULL
  UNION ALL SELECT lead_key, row_id, 'website', website_value, website_confidence, dom, false, false, website_owned, false FROM rows_ WHERE website_value IS NOT NULL
  UNION ALL SELECT lead_key, row_id, 'facebook', facebook_value, 1.0, 'facebook.com', false, false, false, facebook_numeric FROM rows_),
id1 AS (SELECT *, row_number() OVER (PARTITION BY lead_key, kind, value ORDER BY row_id) AS r FROM id0),
ident AS (SELECT *, row_id = min(row_id) OVER (PARTITION BY lead_key, kind) AS is_primary FROM id1 WHERE r = 1),
grp AS (SELECT lead_key, host, min(row_id) AS row_id FROM rows_ WHERE website_owned GROUP BY ALL),
gsz AS (SELECT host, count(*) AS n FROM grp GROUP BY host HAVING count(*) BETWEEN 2 AND {fixed.HOST_GROUP}),
hp AS (SELECT a.lead_key AS lead_a, b.lead_key AS lead_b, a.host, n, row_number() OVER (PARTITION BY a.lead_key, b.lead_key ORDER BY least(a.row_id, b.row_id), a.host) AS r FROM grp a JOIN grp b ON a.host = b.host AND a.lead_key < b.lead_key JOIN gsz ON gsz.host = a.host),
rep AS (SELECT lead_key, nv, split_part(nv, ' ', 1) AS block FROM rows_ WHERE row_id = lead_key AND length(split_part(nv, ' ', 1)) >= 3),
bsz AS (SELECT block FROM rep GROUP BY block HAVING count(*) BETWEEN 2 AND {fixed.BLOCK_GROUP}),
np AS (SELECT a.lead_key AS lead_a, b.lead_key AS lead_b, a.nv AS x, b.nv AS y FROM rep a JOIN rep b ON a.block = b.block AND a.lead_key < b.lead_key JOIN bsz ON bsz.block = a.block)"""


def _tsr(pairs: str, keys: str) -> str:
    """CTEs ending in tsr (keys, score) for pairs (keys, x, y)."""
    return f"""
tw AS (SELECT {keys}, list_sort(list_distinct(string_split(x, ' '))) AS wx, list_sort(list_distinct(string_split(y, ' '))) AS wy FROM {pairs}),
ts AS (SELECT {keys}, list_filter(wx, lambda w: list_contains(wy, w)) AS sh, list_filter(wx, lambda w: NOT list_contains(wy, w)) AS l, list_filter(wy, lambda w: NOT list_contains(wx, w)) AS r FROM tw),
tt AS (SELECT {keys}, len(sh) AS ns, len(l) AS nl, len(r) AS nr, array_to_string(sh, ' ') AS s, array_to_string(list_concat(sh, l), ' ') AS sl, array_to_string(list_concat(sh, r), ' ') AS sr FROM ts),
tsr AS (SELECT {keys}, CASE WHEN ns > 0 AND (nl = 0 OR nr = 0) THEN 100.0::DOUBLE ELSE greatest(CASE WHEN ns > 0 THEN greatest({_ratio("s", "sl")}, {_ratio("s", "sr")}) ELSE 0.0::DOUBLE END, {_ratio("sl", "sr")}) END AS score FROM tt)"""


_CAND = f"""{_tsr("np", "lead_a, lead_b")},
fz AS (SELECT lead_a, lead_b, round_even(score / 100, 3) AS confidence FROM tsr WHERE score >= {fixed.NAME_RATIO}),
cand0 AS (SELECT lead_a, lead_b, 'shared_website' AS method, 0.4::DOUBLE AS confidence FROM hp WHERE r = 1 UNION ALL SELECT lead_a, lead_b, 'fuzzy_name', confidence FROM fz)"""

_hex = lambda c, i: f"(strpos('0123456789abcdef', substr(md5({c}), {i}, 1)) - 1)"
_VERIFY = f"""
dm AS (SELECT domain, count(*) AS n FROM ident WHERE kind = 'email' GROUP BY domain),
dc0 AS (SELECT domain, {_hex('domain', 1)} AS d FROM dm),
dc AS (SELECT domain, CASE WHEN d = 1 THEN 'unknown' WHEN d IN (0, 2) THEN 'unreachable' ELSE 'verified' END AS status, d > 2 AS has_mx, CASE WHEN d <= 2 THEN 'none' WHEN d <= 7 THEN 'google' WHEN d <= 10 THEN 'microsoft' WHEN d <= 12 THEN 'self_hosted' ELSE 'other' END AS provider,
  TIMESTAMP '2026-01-01' + to_days(CAST({_hex('domain', 2)} AS INTEGER)) AS checked_at FROM dc0),
ou AS (SELECT DISTINCT value AS url FROM ident WHERE kind = 'website' AND owned),
uc AS (SELECT url, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN d IN (2, 3) THEN 'unknown' WHEN d = 1 THEN 'unreachable' ELSE 'verified' END AS status, CASE WHEN d IN (1, 3) THEN NULL WHEN d = 2 THEN 503 ELSE 200 END AS status_code, d = 0 AS is_parked, d > 3 AS is_live,
  TIMESTAMP '2026-01-01' + to_days(CAST({_hex('url', 2)} AS INTEGER)) AS checked_at FROM (SELECT url, {_hex('url', 1)} AS d FROM ou)),
dx AS (SELECT *, checked_at + to_hours(CASE status WHEN 'unreachable' THEN 168 WHEN 'unknown' THEN 6 ELSE 720 END) > TIMESTAMP '2026-01-15' AS fresh FROM dc),
ux AS (SELECT *, checked_at + to_hours(CASE status WHEN 'unreachable' THEN 168 WHEN 'unknown' THEN 6 ELSE 720 END) > TIMESTAMP '2026-01-15' AS fresh FROM uc),
sm AS (SELECT lead_key, dc.status AS mailbox_status, provider AS mail_provider FROM ident LEFT JOIN dc USING (domain) WHERE kind = 'email' AND is_primary),
sw AS (SELECT lead_key, uc.status AS website_status, is_parked AS website_parked, is_live AS website_live FROM ident LEFT JOIN uc ON url = value WHERE kind = 'website' AND is_primary AND owned),
sig AS (SELECT coalesce(sm.lead_key, sw.lead_key) AS lead_key, mailbox_status, mail_provider, website_status, website_parked, website_live FROM sm FULL JOIN sw ON sm.lead_key = sw.lead_key)"""

_pen = " + ".join(f"(CASE WHEN len(list_filter(codes, lambda c: c IN {_in([c for c, q in fixed.PENALTY_OF_CODE.items() if q == p])})) > 0 THEN {fixed.PENALTIES[p]}.0::DOUBLE ELSE 0.0::DOUBLE END)" for p in dict.fromkeys(fixed.PENALTY_OF_CODE.values()))
_earned = " + ".join(f"coalesce(f_{n}, 0.0::DOUBLE) * {w}.0::DOUBLE" for n, w in fixed.WEIGHTS.items())
_avail = " + ".join(f"(CASE WHEN f_{n} IS NOT NULL THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END)" for n, w in fixed.WEIGHTS.items())
_count = " + ".join(f"(CASE WHEN f_{n} IS NOT NULL THEN 1 ELSE 0 END)" for n in fixed.WEIGHTS)


def _scores(prefix: str, signals: str) -> str:
    return f"""
{prefix}k AS (SELECT lead_key, list(DISTINCT kind) AS kinds FROM ident GROUP BY 1),
{prefix}c AS (SELECT lead_key, list(DISTINCT code) AS codes FROM iss GROUP BY 1),
{prefix}f AS (SELECT l.lead_key, codes, CASE WHEN is_placeholder THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f_identity_present,
  CASE WHEN m.value IS NULL AND NOT list_contains(kinds, 'phone') THEN 0.0::DOUBLE WHEN m.value IS NULL THEN 0.5::DOUBLE WHEN NOT m.free AND NOT m.role THEN 1.0::DOUBLE WHEN NOT m.free THEN 0.8::DOUBLE WHEN NOT m.role THEN 0.6::DOUBLE ELSE 0.45::DOUBLE END AS f_contact_reachable,
  CASE WHEN m.value IS NOT NULL AND mailbox_status IN ('verified', 'unreachable') THEN CASE WHEN mailbox_status <> 'verified' THEN 0.0::DOUBLE WHEN mail_provider IN {_in(fixed.MANAGED_PROVIDERS)} THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END END AS f_mailbox_verified,
  CASE WHEN company_domain IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_owned_website, CASE WHEN company_domain IS NOT NULL AND website_status IN ('verified', 'unreachable') THEN CASE WHEN website_parked THEN 0.0::DOUBLE WHEN website_live THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS f_website_live,
  CASE WHEN list_contains(kinds, 'website') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS f_channel_breadth, CASE WHEN latest_followers > 0 THEN least(1.0::DOUBLE, ln(1 + latest_followers::DOUBLE) / ln(100001.0::DOUBLE)) ELSE 0.0::DOUBLE END AS f_audience_evidence,
  coalesce(location_confidence, 0.0::DOUBLE) AS f_location_resolved, CASE WHEN coalesce(category_slug, 'unclassified') <> 'unclassified' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_category_known, CASE WHEN fb.num THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f_identity_verifiable, CASE WHEN source_inferred THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f_provenance_observed
  FROM leads l LEFT JOIN {prefix}k k ON k.lead_key = l.lead_key LEFT JOIN {prefix}c c ON c.lead_key = l.lead_key LEFT JOIN {signals} sg ON sg.lead_key = l.lead_key LEFT JOIN ident m ON m.lead_key = l.lead_key AND m.kind = 'email' AND m.is_primary LEFT JOIN ident fb ON fb.lead_key = l.lead_key AND fb.kind = 'facebook' AND fb.is_primary),
{prefix}s AS (SELECT *, {_avail} AS weight_available, {_count} AS factors_evaluated, ({_earned}) / ({_avail}) * 100 AS base, {_pen} + (CASE WHEN f_mailbox_verified = 0 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN f_website_live = 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END) AS penalty_total FROM {prefix}f),
{prefix}score AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, base - least(penalty_total, 30.0::DOUBLE))), 2) AS score FROM {prefix}s)"""


_MERGED = """
sn AS (SELECT x.lead_key, round_even(score, 1) AS s, (SELECT count(*) FROM ident i WHERE i.lead_key = x.lead_key) AS n FROM xscore x),
sv AS (SELECT lead_a, lead_b, CASE WHEN (a.s, a.n, -lead_a) >= (b.s, b.n, -lead_b) THEN lead_a ELSE lead_b END AS survivor FROM (SELECT DISTINCT lead_a, lead_b FROM cand0) JOIN sn a ON a.lead_key = lead_a JOIN sn b ON b.lead_key = lead_b),
lg AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lead_a, lead_b, method) AS i, lead_a, lead_b, method, survivor, CASE WHEN survivor = lead_a THEN lead_b ELSE lead_a END AS loser FROM cand0 JOIN sv USING (lead_a, lead_b) WHERE (lead_a + lead_b) % 5 = 0),
fd(i, m, target, why) AS (SELECT 0::BIGINT, MAP([0::BIGINT], [0::BIGINT]), NULL::BIGINT, NULL::VARCHAR UNION ALL
  SELECT i, CASE WHEN why IS NULL THEN map_concat(m, MAP([loser], [target])) ELSE m END, target, why FROM (SELECT *, CASE WHEN loser = target THEN 'already merged the other way' WHEN m[loser] <> target THEN 'already merged elsewhere' END AS why
  FROM (SELECT lg.i, loser, m, list_reduce(list_prepend(survivor, list_transform(range(16), lambda z: 0::BIGINT)), lambda x, y: coalesce(m[x], x)) AS target FROM fd JOIN lg ON lg.i = fd.i + 1))),
ap AS (SELECT lead_a, lead_b, method, loser, target, why FROM lg JOIN fd USING (i)),
cand AS (SELECT c.*, CASE WHEN (c.lead_a + c.lead_b) % 5 = 1 THEN 'rejected_distinct' WHEN ap.lead_a IS NOT NULL AND why IS NULL THEN 'confirmed_duplicate' ELSE 'pending' END AS status,
  CASE WHEN (c.lead_a + c.lead_b) % 5 = 1 OR (ap.lead_a IS NOT NULL AND why IS NULL) THEN 'r' || ((c.lead_a + c.lead_b) % 3) END AS reviewer FROM cand0 c LEFT JOIN ap ON ap.lead_a = c.lead_a AND ap.lead_b = c.lead_b AND ap.method = c.method),
gp AS (SELECT loser AS lead_key, min(target) AS p FROM ap WHERE why IS NULL GROUP BY 1),
gw(lead_key, p, hops) AS (SELECT lead_key, p, 0 FROM gp UNION ALL SELECT gw.lead_key, gp.p, hops + 1 FROM gw JOIN gp ON gp.lead_key = gw.p WHERE hops < 16),
gone AS (SELECT lead_key, arg_max(p, hops) AS merged_into FROM gw GROUP BY 1),
act AS (SELECT * FROM leads WHERE lead_key NOT IN (SELECT lead_key FROM gone))"""


_ALL = f"WITH RECURSIVE {_SRC},{_NORM},{_RESOLVE},{_CAND},{_VERIFY},{_scores('x', 'sig')},{_MERGED},{_scores('z', '(SELECT lead_key, NULL::VARCHAR AS mailbox_status, NULL::VARCHAR AS mail_provider, NULL::VARCHAR AS website_status, false AS website_parked, false AS website_live FROM sig)')}\n"
_ROWS = f"WITH RECURSIVE {_SRC},{_NORM}\n"




_pages_host = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"
_compared = [("display_name", "display_name"), ("entity_kind", "entity_kind"), ("category_slug", "category_slug"), ("location_slug", "location_slug"), ("company_domain", "company_domain"), *[(k, f"(SELECT min(value) FROM ident i WHERE i.lead_key = l.lead_key AND kind = '{k}' AND is_primary)") for k in ("email", "phone", "website")], ("score", "(SELECT printf('%.1f', round_even(score, 1)) FROM xscore x WHERE x.lead_key = l.lead_key)")]

_QUERIES = {
    "scan_union_batches": "SELECT batch, batch_seq, count(*) AS n, min(row_no) AS first_row, max(row_no) AS last_row FROM src GROUP BY ALL",
    "row_hash": "SELECT row_id, sha256(concat(" + ", ".join(f"coalesce('{c}=' || {c} || chr(10), '')" for c in sorted(["name", "email", "phone", "website", "facebook", "city", "followers"])) + ")) AS row_sha256 FROM src",
    "norm_email": "SELECT row_id, email_value, email_typo, email_confidence FROM norm",
    "email_classify": "SELECT row_id, email_domain, email_free, email_role, email_disposable FROM norm",
    "email_lookalike": "SELECT email_domain, count(*) AS n, min(m) AS resembles FROM norm WHERE email_domain IS NOT NULL GROUP BY 1",
    "norm_phone": "SELECT row_id, phone_value, CASE WHEN phone_value IS NOT NULL THEN 'IN' END AS phone_region, substr(phone_value, 4) AS phone_national, CASE WHEN phone_value IS NOT NULL THEN 'mobile' END AS phone_type, phone_value IS NOT NULL AS phone_mobile, CASE WHEN phone_value IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phone_confidence FROM norm",
    "norm_url": "SELECT row_id, website_value, host AS website_host, website_confidence FROM norm",
    "url_classify": "SELECT row_id, website_class, website_owned FROM norm",
    "url_handle": "SELECT row_id, facebook_handle, facebook_numeric FROM norm",
    "norm_followers": "SELECT row_id, followers_value, coalesce(followers_value IS NOT NULL AND NOT followers LIKE '%K', false) AS followers_exact, CASE WHEN followers_value IS NULL THEN 0.0::DOUBLE WHEN followers LIKE '%K' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS followers_confidence FROM norm",
    "norm_name": "SELECT row_id, disp AS name_display, nv AS name_value, name_placeholder, name_confidence FROM norm",
    "entity_kind": "SELECT row_id, name_kind FROM norm",
    "norm_city": "SELECT row_id, location_slug, location_state, location_match, location_confidence FROM norm",
    "norm_category": "SELECT row_id, category_slug, category_confidence FROM norm",
    "normalize_records": f"SELECT * FROM ({_union(_codes)})",
    "validate_issues": f"SELECT *, {_SEVERITY} AS severity FROM ({_union(_rules)})",
    "issues_by_code": "SELECT code, severity, count(*) AS n FROM iss GROUP BY ALL",
    "identity_keys": "SELECT * FROM ks",
    "dedup_clusters": "SELECT a.lead_key, a.n AS n_rows, CASE WHEN a.n = 1 THEN '' ELSE coalesce(kinds, '') END AS matched_by, CASE WHEN a.n = 1 THEN '' ELSE coalesce(shared, '') END AS shared_by FROM (SELECT lead_key, count(*) AS n FROM rows_ GROUP BY 1) a LEFT JOIN (SELECT lead_key, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, array_to_string(list_sort(list(DISTINCT kind) FILTER (WHERE c > 1)), ',') AS shared FROM (SELECT lead_key, kind, key, count(DISTINCT ks.row_id) AS c FROM ks JOIN rows_ USING (row_id) GROUP BY ALL) GROUP BY 1) b ON a.lead_key = b.lead_key",
    "dedup_representative": "SELECT row_id, lead_key FROM rows_",
    "reconcile": "SELECT count(*) AS rows_read, count(DISTINCT lead_key) AS leads_total, count(*) - count(DISTINCT lead_key) AS rows_merged FROM rows_",
    "pairs_shared_host": "SELECT lead_a, lead_b, 0.4::DOUBLE AS confidence, host, n AS n_sharing FROM hp WHERE r = 1",
    "pairs_fuzzy_name": "SELECT * FROM fz",
    "merge_leads": "SELECT lead_key, n_rows, display_name, normalized_name, entity_kind, is_placeholder, location_slug, location_name, location_state, location_confidence, category_slug, category_confidence, company_domain, latest_followers, first_batch, last_batch, source_inferred, relevance FROM leads",
    "merge_identifiers": "SELECT lead_key, kind, value, is_primary, CAST(confidence AS DOUBLE) AS confidence FROM ident",
    "follower_observations": "SELECT * FROM obs",
    "source_queries": "SELECT lead_key, matched_query AS query, bool_and(source_inferred) AS inferred FROM rows_ WHERE matched_query IS NOT NULL GROUP BY ALL",
    "weak_labels": "SELECT lead_key, 'relevance' AS dimension, arg_min(relevance, row_id) AS label, 'weak_relevance' AS label_source FROM rows_ WHERE relevance IS NOT NULL GROUP BY 1",
    "labels_by_source": "SELECT 'weak_relevance' AS label_source, count(DISTINCT lead_key) AS n FROM rows_ WHERE relevance IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'document_quality', count(quality) FROM labels HAVING count(quality) > 0 UNION ALL SELECT 'document_toxic', count(toxic) FROM labels HAVING count(toxic) > 0",
    "latest_followers": "SELECT lead_key, latest_followers FROM leads",
    "companies": "SELECT cn.domain, name, website, branches, branches > 1 AS multi_branch FROM cn LEFT JOIN cu ON cu.domain = cn.domain",
    "companies_page": "SELECT cn.domain, name, coalesce(n, 0) AS branch_count, locations FROM cn LEFT JOIN (SELECT company_domain, count(*) AS n, array_to_string(list_sort(list(DISTINCT location_name)), ',') AS locations FROM act GROUP BY 1) a ON a.company_domain = cn.domain WHERE coalesce(n, 0) >= 2 ORDER BY branch_count DESC, cn.domain LIMIT 50",
    "companies_multi_branch": "SELECT company_domain AS domain, count(*) AS branches FROM leads WHERE company_domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "quality_factors": "SELECT lead_key, " + ", ".join(f"round_even(f_{n}, 9) AS {n}" for n in fixed.WEIGHTS) + " FROM xscore",
    "quality_score": "SELECT lead_key, round_even(base, 6) AS base, penalty_total, factors_evaluated, weight_available, round_even(score, 1) AS score_1 FROM xscore",
    "quality_reasons": "SELECT lead_key, factor, measured, reason FROM (" + " UNION ALL ".join(f"SELECT x.lead_key, '{n}' AS factor, f_{n} IS NOT NULL AS measured, {r} AS reason FROM xscore x JOIN leads l ON l.lead_key = x.lead_key LEFT JOIN ident m ON m.lead_key = x.lead_key AND m.kind = 'email' AND m.is_primary LEFT JOIN sig g ON g.lead_key = x.lead_key" for n, r in {
        "identity_present": "CASE WHEN is_placeholder THEN 'placeholder name' ELSE 'named' END", "owned_website": "coalesce('owns ' || company_domain, 'no domain of its own')",
        "contact_reachable": "CASE WHEN m.value IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM ident p WHERE p.lead_key = x.lead_key AND p.kind = 'phone') THEN 'phone only' ELSE 'no e-mail or phone' END ELSE CASE WHEN m.free THEN 'free provider, ' ELSE 'own domain, ' END || CASE WHEN m.role THEN 'a role''s' ELSE 'a person''s' END END",
        "mailbox_verified": "CASE WHEN m.value IS NULL THEN 'no e-mail' WHEN f_mailbox_verified IS NULL THEN 'not measured' WHEN f_mailbox_verified = 0 THEN 'takes no mail' WHEN f_mailbox_verified = 1 THEN 'takes mail, managed by ' || mail_provider ELSE 'takes mail' END",
        "website_live": "CASE WHEN company_domain IS NULL THEN 'no website' WHEN f_website_live IS NULL THEN 'not measured' WHEN f_website_live = 1 THEN 'answers' WHEN website_parked THEN 'parked' ELSE 'does not answer' END", "channel_breadth": "CAST(f_channel_breadth * 4 AS INTEGER) || ' of 4 channels'",
        "audience_evidence": "CASE WHEN latest_followers IS NULL THEN 'no count' WHEN latest_followers <= 0 THEN 'no followers' ELSE latest_followers || ' followers' END", "location_resolved": "coalesce('in ' || location_name, 'not resolved')", "category_known": "CASE WHEN f_category_known = 1 THEN 'is ' || category_slug ELSE 'no category' END",
        "identity_verifiable": "CASE WHEN f_identity_verifiable = 1 THEN 'named page' ELSE 'numbered page' END", "provenance_observed": "CASE WHEN source_inferred THEN 'source inferred' ELSE 'source observed' END"}.items()) + ")",
    "quality_penalties": "SELECT lead_key, penalty, amount, triggered_by FROM (SELECT lead_key, penalty, min(code) AS triggered_by FROM (SELECT lead_key, unnest(codes) AS code FROM xscore) JOIN (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in fixed.PENALTY_OF_CODE.items()) + ") t(code, penalty) USING (code) GROUP BY 1, 2 UNION ALL SELECT lead_key, 'mailbox_domain_dead', 'mx_absent' FROM xscore WHERE f_mailbox_verified = 0 UNION ALL SELECT x.lead_key, 'website_dead', CASE WHEN website_parked THEN 'website_parked' ELSE 'website_down' END FROM xscore x LEFT JOIN sig g ON g.lead_key = x.lead_key WHERE f_website_live = 0) JOIN (VALUES " + ", ".join(f"('{p}', {a}.0::DOUBLE)" for p, a in fixed.PENALTIES.items()) + ") v(penalty, amount) USING (penalty)",
    "quality_explain": " UNION ALL ".join(f"SELECT lead_key, '{n}' AS factor, round_even(f_{n}, 4) AS value, {w}.0::DOUBLE AS weight, coalesce(round_even(f_{n} * {w}, 3), 0.0::DOUBLE) AS contribution, f_{n} IS NOT NULL AS measured FROM xscore" for n, w in fixed.WEIGHTS.items()),
    "rescore": "SELECT factors_evaluated, count(*) AS n, round_even(avg(base), 6) AS mean_base FROM zscore GROUP BY 1",
    "domains_with_counts": "SELECT domain, n FROM dm",
    "owned_urls": "SELECT url FROM ou",
    "verify_domains": "SELECT domain, status, has_mx FROM dc",
    "mail_provider": "SELECT domain, provider FROM dc",
    "verify_urls": "SELECT url, host, status, status_code, is_parked, is_live FROM uc",
    "verify_pending_first": "SELECT dm.domain, n FROM dm LEFT JOIN dx USING (domain) WHERE NOT coalesce(fresh, false) ORDER BY n DESC, dm.domain LIMIT 25",
    "verify_pending": "SELECT dm.domain, n FROM dm LEFT JOIN dx USING (domain) WHERE NOT coalesce(fresh, false)",
    "signals": "SELECT * FROM sig",
    "verify_report": "SELECT CAST(sum(n) AS BIGINT) AS addresses, count(*) AS domains, CAST(sum(n) - count(*) AS BIGINT) AS saved, count(*) FILTER (WHERE fresh) AS cache_hits FROM dm LEFT JOIN dx USING (domain)",
    "leads_active": "SELECT lead_key FROM act",
    "filter_search": "SELECT lead_key FROM act WHERE contains(lower(display_name), 'clinic') OR contains(normalized_name, 'clinic') OR lead_key IN (SELECT lead_key FROM ident WHERE contains(lower(value), 'clinic'))",
    "filter_dims": "SELECT lead_key FROM act WHERE category_slug IN ('technology', 'real_estate') AND location_state IN ('ASIA', 'EUROPE') AND location_slug IN ('china', 'japan', 'asia', 'france', 'europe')",
    "filter_location": "SELECT lead_key FROM leads WHERE location_slug IN ('asia', 'china', 'france')",
    "filter_entity_kind": "SELECT lead_key FROM act WHERE entity_kind = 'business' AND NOT is_placeholder",
    "filter_owned_website": "SELECT lead_key FROM act WHERE company_domain IS NOT NULL",
    "filter_multi_branch": "SELECT lead_key FROM (SELECT lead_key, company_domain, count(*) OVER (PARTITION BY company_domain) AS n FROM act) WHERE company_domain IS NOT NULL AND n > 1",
    "filter_company": "SELECT lead_key FROM leads WHERE company_domain = 'biz3.test'",
    "filter_has_channels": "SELECT lead_key FROM act WHERE EXISTS (SELECT 1 FROM ident i WHERE i.lead_key = act.lead_key AND kind = 'email') AND EXISTS (SELECT 1 FROM ident i WHERE i.lead_key = act.lead_key AND kind = 'website')",
    "filter_missing_channel": "SELECT lead_key FROM act WHERE NOT EXISTS (SELECT 1 FROM ident i WHERE i.lead_key = act.lead_key AND kind = 'email')",
    "filter_followers": "SELECT lead_key FROM act WHERE latest_followers BETWEEN 100 AND 50000",
    "filter_quality": "SELECT lead_key FROM act WHERE lead_key IN (SELECT lead_key FROM xscore WHERE score BETWEEN 40 AND 75)",
    "filter_mailbox_status": "SELECT lead_key FROM act WHERE lead_key IN (SELECT lead_key FROM ident JOIN dc USING (domain) WHERE kind = 'email' AND status = 'unreachable')",
    "filter_website_status": "SELECT lead_key FROM act WHERE lead_key IN (SELECT lead_key FROM ident JOIN uc ON url = value WHERE kind = 'website' AND status = 'verified')",
    "filter_mail_provider": "SELECT lead_key FROM act WHERE lead_key IN (SELECT lead_key FROM ident JOIN dc USING (domain) WHERE kind = 'email' AND provider = 'google')",
    "filter_issue_code": "SELECT lead_key FROM act WHERE lead_key IN (SELECT lead_key FROM iss WHERE code = 'thin_record')",
    "leads_count": "SELECT count(*) AS n FROM act WHERE lead_key IN (SELECT lead_key FROM ident WHERE kind = 'phone')",
    "leads_deep_page": "SELECT lead_key, display_name, latest_followers FROM act ORDER BY latest_followers DESC NULLS LAST, lead_key LIMIT 25 OFFSET 750",
    "search_index": " UNION ALL ".join(f"SELECT '{q}' AS q, lead_key FROM act WHERE contains(lower(display_name), lower('{q}')) OR contains(lower(normalized_name), lower('{q}')) OR lead_key IN (SELECT lead_key FROM ident WHERE contains(lower(value), lower('{q}')))" for q in ("clinic", "BIZ12", "@yahoo.com", "_")),
    "leads_page": "SELECT lead_key, display_name, latest_followers FROM act ORDER BY latest_followers DESC NULLS LAST, lead_key LIMIT 25 OFFSET 25",
    "lead_summary": "SELECT a.lead_key, display_name, entity_kind, channels, primary_email, primary_phone, primary_website, followers, observations, changed, coalesce(n, 0) AS issue_count, CASE WHEN primary_email IS NOT NULL THEN coalesce(mailbox_status, 'unknown') END AS mailbox_status, CASE WHEN company_domain IS NOT NULL THEN coalesce(website_status, 'unknown') END AS website_status FROM act a LEFT JOIN (SELECT lead_key, array_to_string(list_sort(list(DISTINCT kind)), ',') AS channels, min(value) FILTER (WHERE kind = 'email' AND is_primary) AS primary_email, min(value) FILTER (WHERE kind = 'phone' AND is_primary) AS primary_phone, min(value) FILTER (WHERE kind = 'website' AND is_primary) AS primary_website FROM ident GROUP BY 1) i ON i.lead_key = a.lead_key LEFT JOIN (SELECT lead_key, arg_max(value, batch_seq) AS followers, count(*) AS observations, count(DISTINCT value) > 1 AS changed FROM obs GROUP BY 1) o ON o.lead_key = a.lead_key LEFT JOIN (SELECT lead_key, count(*) AS n FROM iss GROUP BY 1) s ON s.lead_key = a.lead_key LEFT JOIN sig ON sig.lead_key = a.lead_key",
    "followers_rollup": "SELECT lead_key, arg_max(value, batch_seq) AS value, count(*) AS observations, count(DISTINCT value) > 1 AS changed FROM obs GROUP BY 1",
    "verification_tristate": "SELECT l.lead_key, CASE WHEN l.lead_key IN (SELECT lead_key FROM ident WHERE kind = 'email') THEN coalesce(mailbox_status, 'unknown') END AS mailbox_status, CASE WHEN company_domain IS NOT NULL THEN coalesce(website_status, 'unknown') END AS website_status, coalesce(company_domain IS NOT NULL AND website_live, false) AS is_live, coalesce(company_domain IS NOT NULL AND website_parked, false) AS is_parked FROM leads l LEFT JOIN sig ON sig.lead_key = l.lead_key",
    "lead_detail": """SELECT l.lead_key, display_name, entity_kind, category_slug, location_slug, company_domain,
  (SELECT array_to_string(list_sort(list(DISTINCT kind)), ',') FROM ident i WHERE i.lead_key = l.lead_key) AS channels,
  """ + ", ".join(f"(SELECT min(value) FROM ident i WHERE i.lead_key = l.lead_key AND kind = '{k}' AND is_primary) AS primary_{k}" for k in ("email", "phone", "website")) + """,
  (SELECT arg_max(value, batch_seq) FROM obs o WHERE o.lead_key = l.lead_key) AS followers, (SELECT count(*) FROM iss i WHERE i.lead_key = l.lead_key) AS issue_count,
  CASE WHEN EXISTS (SELECT 1 FROM ident i WHERE i.lead_key = l.lead_key AND kind = 'email') THEN coalesce(mailbox_status, 'unknown') END AS mailbox_status, CASE WHEN company_domain IS NOT NULL THEN coalesce(website_status, 'unknown') END AS website_status,
  nullif((SELECT count(*) FROM cand WHERE lead_a = l.lead_key OR lead_b = l.lead_key), 0) AS candidate_count,
  (SELECT string_agg(concat_ws('|', kind, value, CAST(is_primary AS VARCHAR)), ';' ORDER BY kind, value, is_primary) FROM ident i WHERE i.lead_key = l.lead_key) AS identifiers,
  (SELECT string_agg(concat_ws('|', batch_seq, value), ';' ORDER BY batch_seq, value) FROM obs o WHERE o.lead_key = l.lead_key) AS metrics,
  (SELECT string_agg(q, ';' ORDER BY q) FROM (SELECT DISTINCT matched_query AS q FROM rows_ r WHERE r.lead_key = l.lead_key AND matched_query IS NOT NULL)) AS queries,
  (SELECT string_agg(field || '|' || code, ';' ORDER BY field, code) FROM iss i WHERE i.lead_key = l.lead_key) AS issues,
  (SELECT string_agg(s.normalized_name || '|' || s.lead_key, ';' ORDER BY s.normalized_name, s.lead_key) FROM leads s WHERE s.company_domain = l.company_domain AND s.lead_key <> l.lead_key) AS siblings
  FROM leads l LEFT JOIN sig ON sig.lead_key = l.lead_key WHERE l.lead_key = 10000008""",
    "provenance": "SELECT lead_key, row_id, CASE WHEN batch_seq = 2 THEN 'supplier' ELSE 'customer' END AS source_file, batch AS source_sheet, row_no, sha256(raw) AS row_sha256, raw FROM (SELECT *, concat(" + ", ".join(f"coalesce('{c}=' || {c} || chr(10), '')" for c in sorted(["name", "email", "phone", "website", "facebook", "city", "followers"])) + ") AS raw FROM rows_)",
    "merged_leads": "SELECT lead_key, merged_into FROM gone",
    "review_fold": "SELECT lead_a, lead_b, method, CASE WHEN s = 'confirmed_duplicate' AND (lead_a + lead_b) % 15 = 0 THEN 'rejected_distinct' WHEN s = 'pending' AND (lead_a + lead_b) % 15 = 0 THEN 'rejected_distinct' ELSE s END AS status, CASE WHEN (lead_a + lead_b) % 15 = 0 THEN 'second' WHEN s = 'pending' THEN NULL ELSE 'r' || ((lead_a + lead_b) % 3) END AS reviewer, CASE WHEN s = 'confirmed_duplicate' AND (lead_a + lead_b) % 15 <> 0 THEN loser END AS applied_loser, CASE WHEN s = 'confirmed_duplicate' AND (lead_a + lead_b) % 15 <> 0 THEN target END AS applied_target, CASE WHEN (lead_a + lead_b) % 15 <> 0 THEN why END AS conflict FROM (SELECT lead_a, lead_b, method, CASE WHEN why IS NULL THEN 'confirmed_duplicate' ELSE 'pending' END AS s, loser, target, why FROM ap UNION ALL SELECT lead_a, lead_b, method, 'rejected_distinct', NULL, NULL, NULL FROM cand0 WHERE (lead_a + lead_b) % 5 = 1)",
    "cluster_sizes": "SELECT n_rows, count(*) AS leads FROM (SELECT lead_key, count(*) AS n_rows FROM rows_ GROUP BY 1) GROUP BY 1",
    "filter_rubric_version": "SELECT lead_key FROM xscore WHERE round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (coalesce(f_identity_present, 0) * 1 + coalesce(f_contact_reachable, 0) * 3 + coalesce(f_owned_website, 0) * 2) / 6.0::DOUBLE * 100 - CASE WHEN list_contains(codes, 'thin_record') THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END)), 2) >= 55",
    "reingest_match": """SELECT lead_key, arg_min(stored_key, (CASE kind WHEN 'email' THEN 0 WHEN 'phone' THEN 1 ELSE 2 END, NOT is_primary, value)) AS stored_key, count(DISTINCT stored_key) AS matches FROM id3 JOIN (SELECT kind, value, min(lead_key) AS stored_key FROM id2 GROUP BY 1, 2) USING (kind, value) GROUP BY 1""",
    "company_detail": "SELECT company_domain, string_agg(CAST(lead_key AS VARCHAR), ',' ORDER BY display_name, lead_key) AS branches FROM leads WHERE company_domain = 'biz6.test' GROUP BY 1",
    "category_counts": "SELECT v.slug, count(l.lead_key) FILTER (WHERE g.lead_key IS NULL) AS active, count(l.lead_key) AS total FROM (SELECT DISTINCT slug FROM (VALUES " + ", ".join(f"('{s}')" for _, s in VERTICALS) + ") t(slug)) v LEFT JOIN leads l ON l.category_slug = v.slug LEFT JOIN gone g ON g.lead_key = l.lead_key GROUP BY 1",
    "location_counts": "SELECT v.slug, count(l.lead_key) FILTER (WHERE g.lead_key IS NULL) AS active, count(l.lead_key) AS total FROM (SELECT lower(replace(n_name, '_', '-')) AS slug FROM nation UNION SELECT lower(replace(r_name, ' ', '-')) FROM region) v LEFT JOIN leads l ON l.location_slug = v.slug LEFT JOIN gone g ON g.lead_key = l.lead_key GROUP BY 1",
    "review_queue": "SELECT lead_a, lead_b, method, confidence FROM cand WHERE status = 'pending' ORDER BY confidence DESC, lead_a, lead_b, method LIMIT 50",
    "companies_search": "SELECT cn.domain, name, coalesce(n, 0) AS branch_count FROM cn LEFT JOIN (SELECT company_domain, count(*) AS n FROM act GROUP BY 1) a ON a.company_domain = cn.domain WHERE cn.domain ILIKE '%biz1%' OR name ILIKE '%biz1%' ORDER BY cn.domain LIMIT 10 OFFSET 10",
    "review_queue_filters": " UNION ALL ".join(f"SELECT '{n}' AS asked, * FROM (SELECT lead_a, lead_b, method, confidence FROM cand WHERE {w} ORDER BY {o}, lead_a, lead_b, method LIMIT 200)" for n, w, o in [
        ("method", "method = 'fuzzy_name'", "confidence DESC"), ("confidence", "confidence BETWEEN 0.4::DOUBLE AND 0.95::DOUBLE", "method"), ("status", "status = 'rejected_distinct'", "confidence"), ("lead", "10000008 IN (lead_a, lead_b)", "method DESC"),
    ]),
    "pair_comparison": "SELECT lead_a, lead_b, method, a.field, a.value AS value_a, b.value AS value_b, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN lower(a.value) = lower(b.value) END AS agrees FROM cand JOIN facts a ON a.lead_key = lead_a JOIN facts b ON b.lead_key = lead_b AND b.field = a.field",
    "identifiers_by_kind": "SELECT kind, count(*) AS n FROM ident GROUP BY 1",
    "leads_by_entity_kind": "SELECT entity_kind, count(*) AS n FROM act GROUP BY 1",
    "corpus_stats": "SELECT count(*) FILTER (WHERE h) AS leads_active, count(*) FILTER (WHERE NOT h) AS leads_merged, count(*) FILTER (WHERE h AND company_domain IS NOT NULL) AS with_owned_site, count(*) FILTER (WHERE h AND location_slug IS NOT NULL) AS with_location, count(*) FILTER (WHERE h AND category_slug IS NOT NULL) AS with_category, count(*) FILTER (WHERE h AND category_slug <> 'unclassified') AS classified FROM (SELECT l.*, g.lead_key IS NULL AS h FROM leads l LEFT JOIN gone g ON g.lead_key = l.lead_key)",
    "quality_stats": "SELECT count(*) AS n, round_even(round_even(avg(score), 2), 1) AS mean, round_even(list_sort(list(score))[CAST(round_even(0.1::DOUBLE * (count(*) - 1), 0) AS INTEGER) + 1], 1) AS p10, round_even(list_sort(list(score))[CAST(round_even(0.5::DOUBLE * (count(*) - 1), 0) AS INTEGER) + 1], 1) AS p50, round_even(list_sort(list(score))[CAST(round_even(0.9::DOUBLE * (count(*) - 1), 0) AS INTEGER) + 1], 1) AS p90 FROM xscore WHERE lead_key IN (SELECT lead_key FROM act)",
    "quality_histogram": "SELECT band, count(score) AS n FROM (VALUES " + ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in fixed.QUALITY_BANDS) + ") b(band, lo, hi) LEFT JOIN (SELECT score FROM xscore WHERE lead_key IN (SELECT lead_key FROM act)) ON score >= lo AND score < hi GROUP BY 1",
    "quality_deciles": "SELECT CAST(least(floor(score / 10) * 10, 90) AS BIGINT) AS bucket, count(*) AS n FROM xscore GROUP BY 1",
    "factors_coverage": "SELECT factors_evaluated, count(*) AS n FROM xscore WHERE lead_key IN (SELECT lead_key FROM act) GROUP BY 1",
    "verification_coverage": " UNION ALL ".join(f"SELECT '{n}' AS cache, count(*) AS total, count(*) FILTER (WHERE fresh) AS fresh, count(*) FILTER (WHERE NOT fresh) AS stale, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'unreachable') AS unreachable, count(*) FILTER (WHERE status = 'unknown') AS \"unknown\", count(*) FILTER (WHERE status = 'skipped') AS skipped FROM {t}" for n, t in (("domains", "dx"), ("urls", "ux"))),
    "verification_stats": f"SELECT count(DISTINCT lead_key) FILTER (WHERE status = 'verified') AS mailbox_verified, count(DISTINCT lead_key) FILTER (WHERE status = 'unreachable') AS mailbox_unreachable, count(DISTINCT lead_key) FILTER (WHERE provider IN {_in(fixed.MANAGED_PROVIDERS)} AND NOT free) AS managed_mail, (SELECT count(DISTINCT lead_key) FROM ident JOIN uc ON url = value WHERE kind = 'website' AND is_live) AS website_live FROM ident JOIN dc USING (domain) WHERE kind = 'email'",
    "review_stats": "SELECT method, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed_duplicate') AS confirmed, count(*) FILTER (WHERE status = 'rejected_distinct') AS rejected, round_even(avg(confidence), 6) AS mean_confidence, round_even(count(*) FILTER (WHERE status = 'confirmed_duplicate') / nullif(count(*) FILTER (WHERE status <> 'pending'), 0)::DOUBLE, 4) AS confirm_rate FROM cand GROUP BY 1",
    "reviewers": "SELECT reviewer, count(*) AS n FROM cand WHERE reviewer IS NOT NULL GROUP BY 1",
    "ingest_report": "SELECT 'rows' AS counter, batch AS name, count(*) AS n FROM rows_ GROUP BY 2 UNION ALL SELECT 'candidates', method, count(*) FROM cand GROUP BY 2 UNION ALL SELECT 'issues', severity, count(*) FROM iss GROUP BY 2",
    "upsert_companies": "SELECT coalesce(o.domain, n.domain) AS domain, coalesce(n.lead, o.lead) AS lead, CASE WHEN n.domain IS NOT NULL THEN 'new' ELSE 'old' END AS seen FROM (SELECT company_domain AS domain, min(lead_key) AS lead FROM leads WHERE first_batch < 3 AND company_domain IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT company_domain AS domain, CASE WHEN min(lead_key) % 2 = 0 THEN min(lead_key) END AS lead FROM leads WHERE last_batch = 3 AND company_domain IS NOT NULL GROUP BY 1) n ON o.domain = n.domain",
    "upsert_observations": "SELECT * FROM obs",
    "upsert_identifiers": "SELECT lead_key, kind, value, value = first_value(value) OVER (PARTITION BY lead_key, kind ORDER BY CASE WHEN last_row < 30000000 THEN 1 ELSE 0 END, CASE WHEN last_row < 30000000 THEN first_row ELSE new_row END, value) AS is_primary, confidence FROM (SELECT lead_key, kind, value, max(row_id) AS last_row, min(row_id) AS first_row, min(row_id) FILTER (row_id >= 30000000) AS new_row, arg_max(CAST(confidence AS DOUBLE), CASE WHEN row_id >= 30000000 THEN 1 ELSE 0 END) AS confidence FROM id0 GROUP BY 1, 2, 3)",
    "saved_merges": "SELECT lead_key, arg_max(p, hops) AS merged_into, (SELECT count(*) FROM cand0 WHERE (lead_a + lead_b) % 5 <= 1) + (SELECT count(*) FROM cand0 WHERE (lead_a + lead_b) % 15 = 0) AS stored_decisions FROM uw GROUP BY 1",
    "upsert_queries": "SELECT lead_key, matched_query AS query, bool_and(batch_seq = 3) AS inferred FROM rows_ WHERE matched_query IS NOT NULL GROUP BY ALL",
    "upsert_issues": "SELECT DISTINCT lead_key, code FROM iss WHERE row_id >= 30000000 OR lead_key NOT IN (SELECT lead_key FROM iss WHERE row_id >= 30000000)",
    "choose_survivor": "SELECT lead_a, lead_b, survivor FROM sv",
    "profile_signals": ", t AS (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS signal, {c} AS value FROM norm WHERE {c} IS NOT NULL" for c in ("phone_value", "email_value", "website_value")) + "), g AS (SELECT signal, value, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1) SELECT signal, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1 UNION ALL SELECT 'any', NULL, count(DISTINCT row_id) FROM t JOIN g USING (signal, value)",
    "profile_duplicates": "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT phone_value, count(*) AS n FROM norm WHERE phone_value IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
    "profile_overlap": "SELECT a.batch AS left, b.batch AS right, count(*) AS shared FROM (SELECT DISTINCT batch, email_value FROM norm WHERE email_value IS NOT NULL) a JOIN (SELECT DISTINCT batch, email_value FROM norm) b ON a.email_value = b.email_value AND a.batch < b.batch GROUP BY 1, 2",
    "profile_agreement": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, avg(CASE WHEN a.{f} IS NOT DISTINCT FROM b.{f} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM src a JOIN src b ON a.k = b.k AND a.batch_seq = 1 AND b.batch_seq = 3" for f in ("name", "email", "followers")),
    "profile_types": ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim(CAST({e} AS VARCHAR)) AS v FROM src" for c, e in [("serial", "k"), *[(c, c) for c in ("name", "email", "followers", "city", "matched_query", "relevance")]]) + r"""),
  t AS (SELECT "column", CASE WHEN v IS NULL OR v = '' THEN 'null' WHEN regexp_matches(lower(v), '^(true|false|yes|no)$') THEN 'boolean' WHEN regexp_matches(v, '^[+-]?\d{1,18}$') THEN 'int' WHEN regexp_matches(v, '^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$') THEN 'decimal'
    WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND TRY_CAST(v AS DATE) IS NOT NULL THEN 'date' ELSE 'text' END AS type, count(*) AS n FROM v GROUP BY ALL),
  w AS (SELECT "column" AS c, CAST(sum(n) AS BIGINT) AS total, list(type) FILTER (type <> 'null') AS ts FROM t GROUP BY 1)
SELECT "column", type, n, round_even(100 * n / total::DOUBLE, 4) AS share, CASE WHEN ts IS NULL THEN 'null' WHEN len(ts) = 1 THEN ts[1] WHEN len([x FOR x IN ts IF x NOT IN ('int', 'decimal')]) = 0 THEN 'decimal' ELSE 'text' END AS merged FROM t JOIN w ON c = "column" """,
    "profile_crosstab": "SELECT batch, fb_category, count(*) AS n FROM src WHERE fb_category IS NOT NULL GROUP BY ALL",
    "profile_completeness": "SELECT " + " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in ["email", "website", "fb_category", "niche", "followers", "matched_query"]) + " AS filled, count(*) AS n FROM src GROUP BY 1",
    "profile_regex_shares": "SELECT 'business' AS test, avg(CASE WHEN regexp_matches(name, '(?i)clinic|ltd') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM src UNION ALL SELECT 'numeric_facebook', avg(CASE WHEN regexp_matches(facebook, '/\\d{8,}$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM src",
    "flagship": "SELECT a.lead_key, display_name, entity_kind, category_slug, company_domain, factors_evaluated FROM act a JOIN xscore USING (lead_key)",
}
_ON_ROWS = {"profile_types", "profile_signals", "scan_union_batches", "row_hash", "norm_email", "email_classify", "email_lookalike", "norm_phone", "norm_url", "url_classify", "url_handle", "norm_followers", "norm_name", "entity_kind", "norm_city", "norm_category", "normalize_records", "validate_issues", "profile_duplicates", "profile_overlap", "profile_agreement", "profile_crosstab", "profile_completeness", "profile_regex_shares"}
_COMPANIES = r""",
cw AS (SELECT company_domain, lead_key, display_name, string_split(trim(regexp_replace(display_name, '\s+', ' ', 'g')), ' ') AS w FROM leads WHERE company_domain IS NOT NULL),
cs AS (SELECT company_domain, count(*) AS branches, min(len(w)) AS shortest, arg_min(display_name, lead_key) AS first_name, arg_min(w, lead_key) AS fw FROM cw GROUP BY 1),
cp AS (SELECT company_domain, min(pos) AS stop FROM (SELECT company_domain, i - 1 AS pos FROM cw, range(1, len(w) + 1) t(i) GROUP BY company_domain, i HAVING count(DISTINCT lower(w[i])) > 1) GROUP BY 1),
cn AS (SELECT cs.company_domain AS domain, CASE WHEN branches = 1 THEN first_name WHEN least(shortest, coalesce(stop, shortest)) > 0 THEN array_to_string(fw[1:least(shortest, coalesce(stop, shortest))], ' ')
  ELSE upper(left(cs.company_domain, 1)) || substr(split_part(cs.company_domain, '.', 1), 2) END AS name, branches FROM cs LEFT JOIN cp ON cp.company_domain = cs.company_domain),
cu AS (SELECT domain, value AS website FROM (SELECT domain, value, row_number() OVER (PARTITION BY domain ORDER BY lead_key, value) AS r FROM ident WHERE kind = 'website' AND owned) WHERE r = 1)
"""
_keyed = lambda n, where: f"""
k{n} AS (SELECT ks.row_id, key FROM ks JOIN norm USING (row_id) WHERE {where}),
s{n} AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY key) AS b FROM k{n}),
e{n} AS (SELECT DISTINCT a, b FROM s{n} WHERE a <> b UNION SELECT DISTINCT b, a FROM s{n} WHERE a <> b),
r{n}(a, b) AS (SELECT row_id, row_id FROM norm WHERE {where} UNION SELECT r{n}.a, e{n}.b FROM r{n} JOIN e{n} ON r{n}.b = e{n}.a),
l{n} AS (SELECT a AS row_id, min(b) AS lead_key FROM r{n} GROUP BY a),
id{n} AS (SELECT *, row_id = min(row_id) OVER (PARTITION BY lead_key, kind) AS is_primary FROM (SELECT l{n}.lead_key, kind, value, min(row_id) AS row_id FROM id0 JOIN l{n} USING (row_id) WHERE kind IN ('email', 'phone', 'facebook') GROUP BY ALL))"""  # noqa: E731
_MATCH = "," + _keyed(2, "batch_seq < 3") + "," + _keyed(3, "batch_seq = 3") + "\n"
_UNDONE = """,
up AS (SELECT loser AS lead_key, min(target) AS p FROM ap WHERE why IS NULL AND (lead_a + lead_b) % 15 <> 0 GROUP BY 1),
uw(lead_key, p, hops) AS (SELECT lead_key, p, 0 FROM up UNION ALL SELECT uw.lead_key, up.p, hops + 1 FROM uw JOIN up ON up.lead_key = uw.p WHERE hops < 16)
"""
_TAIL = {"saved_merges": _UNDONE, "companies": _COMPANIES, "companies_page": _COMPANIES, "companies_search": _COMPANIES, "reingest_match": _MATCH}
_FACTS = ",\nfacts AS (" + " UNION ALL ".join(f"SELECT lead_key, '{n}' AS field, CAST({e} AS VARCHAR) AS value FROM leads l" for n, e in _compared) + ")\n"

_RULES = "[" + ", ".join(f"'{r}'" for r in fixed.SUFFIX_RULES) + "]"
_DOMAINS = rf"""
WITH p AS (SELECT page_id, {_pages_host} AS host, string_split({_pages_host}, '.') AS l FROM pages), h AS (SELECT DISTINCT host, l, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM p),
w AS (SELECT unnest({_RULES}) AS rule UNION SELECT '*.' || two FROM h WHERE len(l) >= 3 AND ends_with(two, '.net') UNION SELECT '!' || three FROM h WHERE len(l) >= 3 AND ends_with(two, '.net') AND length(three) % 2 = 0
  UNION SELECT three FROM h WHERE len(l) >= 3 AND ends_with(two, '.org') AND length(three) % 2 = 0),
r AS (SELECT rule[1] AS c, ltrim(rule, '!*.') AS suffix FROM w),
m AS (SELECT host, c, k, len(l) AS n FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM h) JOIN r ON suffix = array_to_string(l[-k:], '.')),
d AS (SELECT host, coalesce(max(k - 1) FILTER (c = '!'), max(CASE WHEN c <> '*' THEN k WHEN n > k THEN k + 1 END)) AS depth FROM m GROUP BY 1)
SELECT page_id, p.host, array_to_string(l[-coalesce(depth, 1):], '.') AS public_suffix, CASE WHEN len(l) > coalesce(depth, 1) THEN array_to_string(l[-coalesce(depth, 1) - 1:], '.') END AS domain FROM p LEFT JOIN d ON p.host = d.host"""
_PHONE_RULES = ", ".join(f"({i}, '{c}', '{lead}', '{g}', [{', '.join(n.split())}], '^({f}|{m})$', '^({f})$', '^({m})$', '{t}', '{x}')" for i, (c, leads, g, n, f, m, t, x) in enumerate(fixed.PHONE_RULES) for lead in (leads.split() or [""]))
_PHONES = rf"""
WITH r AS (SELECT * FROM (VALUES {_PHONE_RULES}) v(i, code, lead, region, lengths, both_, fixed_, mobile_, trunk, example)),
e AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN left(example, 3) WHEN c_custkey % 17 = 0 THEN '0' || substr(example, 2) ELSE left(example, length(example) - 2) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS n, code, trunk
  FROM customer JOIN (SELECT DISTINCT i, code, trunk, example FROM r) ON i = c_custkey % {len(fixed.PHONE_RULES)}),
w AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+' || code || ' ' || n WHEN 1 THEN '00' || code || '-' || n WHEN 2 THEN '+' || code || n || ' ext. 12' WHEN 3 THEN '+' || code || ' (' || trunk || ')' || n ELSE '+' || code || '.' || n || 'x5' END AS phone FROM e),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(phone, '( ext\. 12|x5)$', ''), '^(00|\+)', ''), '[^0-9]', '', 'g') AS whole FROM w),
a AS (SELECT f.*, code, trunk, lengths, both_, substr(whole, length(code) + 1) AS rest FROM f JOIN r ON starts_with(whole, code || lead) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(code || lead) DESC) = 1),
b AS (SELECT *, CASE WHEN trunk <> '' AND starts_with(rest, trunk) AND (regexp_matches(substr(rest, length(trunk) + 1), both_) OR (list_contains(lengths, length(rest) - length(trunk)) AND NOT regexp_matches(rest, both_))) THEN substr(rest, length(trunk) + 1) ELSE rest END AS national FROM a),
c AS (SELECT c_custkey, phone, national, r.code, r.region, list_contains(r.lengths, length(national)) AS ok, regexp_matches(national, fixed_) AS fx, regexp_matches(national, mobile_) AS mb
  FROM b JOIN r ON starts_with(b.code || national, r.code || r.lead) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(r.code || r.lead) DESC) = 1)
SELECT c_custkey, phone, CASE WHEN ok THEN '+' || code || national END AS phone_value, CASE WHEN ok THEN region END AS phone_region, CASE WHEN ok THEN national END AS phone_national,
  CASE WHEN ok THEN CASE WHEN fx AND mb THEN 'fixed_line_or_mobile' WHEN mb THEN 'mobile' WHEN fx THEN 'fixed_line' ELSE 'unknown' END END AS phone_type, ok AND mb AS phone_mobile,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN fx OR mb THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS phone_confidence FROM c"""
_REDIRECTS = rf"""
WITH RECURSIVE p AS (SELECT url, min(page_id) AS id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS host FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url IS NOT NULL) GROUP BY url),
g AS (SELECT p.*, CASE WHEN id % 5 < 3 THEN (id * 3 + 1) % (SELECT count(*) FROM p) END AS goes, CASE WHEN id % 23 = 0 THEN 'connect' WHEN id % 31 = 0 THEN 'other' END AS err FROM p),
h AS (SELECT g.url, g.host, q.url AS location, g.id % 29 <> 0 AS recorded, err, CASE WHEN err IS NULL THEN CASE WHEN goes IS NOT NULL THEN 301 + g.id % 2 WHEN g.id % 7 = 0 THEN 503 ELSE 200 END END AS code FROM g LEFT JOIN p q ON q.id = goes),
s AS (SELECT *, CASE WHEN length(host) % 11 = 0 THEN 'no address' WHEN length(host) % 13 = 0 THEN 'private' WHEN NOT recorded THEN 'not recorded' WHEN err IS NOT NULL THEN err WHEN code BETWEEN 301 AND 302 AND location IS NOT NULL THEN 'goes on' ELSE 'answered' END AS why FROM h),
w(url, now, chain, hops) AS (SELECT url, url, CAST([] AS VARCHAR[]), 0 FROM s UNION ALL SELECT w.url, s.location, list_append(chain, now), hops + 1 FROM w JOIN s ON s.url = now WHERE why = 'goes on' AND hops < 5),
l AS (SELECT w.url, s.url AS final, chain, hops, CASE WHEN why = 'goes on' THEN 'redirects' ELSE why END AS why, code FROM w JOIN s ON s.url = now WHERE why <> 'goes on' OR hops = 5)
SELECT url, CASE WHEN why = 'private' THEN 'skipped' WHEN why IN ('no address', 'connect', 'redirects') THEN 'unreachable' WHEN why IN ('not recorded', 'other') OR code >= 500 THEN 'unknown' ELSE 'verified' END AS status, CASE WHEN why = 'answered' THEN CAST(code AS INTEGER) END AS status_code,
  CASE WHEN why = 'answered' THEN final END AS final_url, CAST(CASE WHEN why = 'answered' THEN hops ELSE 0 END AS BIGINT) AS redirect_count, CASE WHEN why = 'answered' THEN array_to_string(chain, ' ') ELSE '' END AS chain, CASE WHEN why <> 'answered' THEN why END AS error FROM l"""
_parked = " OR ".join(f"contains(t, '{m}')" for m in fixed.PARKED_MARKERS)
_title = r"nullif(substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 200), '')"
_ORDERS = [("o_orderkey", "bigint", "o_orderkey"), ("o_custkey", "bigint", "o_custkey"), ("o_orderstatus", "string", "o_orderstatus"), ("o_totalprice", "double", "CAST(o_totalprice AS DECIMAL(38, 6))"), ("o_orderdate", "timestamp_ntz", "o_orderdate"), ("o_orderpriority", "string", "o_orderpriority")]
_PLAIN = {
    "remap_defaults": "SELECT CAST(c_custkey AS VARCHAR) AS serial, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'Meta Ads' END AS source, 'Day_3' AS batch, 3 AS batch_seq, true AS source_inferred FROM customer",
    "clean_cells": r"SELECT p_partkey, CASE WHEN p_partkey % 7 < 3 THEN nullif(trim(p_name), '') END AS cell FROM part",
    "lookup_keys": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS key, regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT p_partkey, lower(strip_accents('  É' || p_name || ' & Çô.  #' || p_partkey || '-Ñ/')) AS t FROM part)",
    "dim_categories": "SELECT slug, count(*) AS aliases FROM (VALUES " + ", ".join(f"('{a}', '{s}')" for a, s in VERTICALS) + ") t(alias, slug) GROUP BY 1",
    "dim_locations": "SELECT lower(replace(n_name, '_', '-')) AS slug, n_name AS name, r_name AS state, 'exact' AS match FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT lower(replace(r_name, ' ', '-')), r_name, r_name, 'state' FROM region",
    "url_strip_tracking": f"SELECT page_id, q AS query, array_to_string([p FOR p IN string_split(q, '&') IF NOT regexp_matches(split_part(p, '=', 1), '{fixed.TRACKING_PATTERN}')], '&') AS kept FROM (SELECT page_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)",
    "registrable_domain": f"SELECT page_id, host, CASE WHEN array_to_string(l[-2:], '.') IN {_in(fixed.SUFFIXES)} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM (SELECT page_id, {_pages_host} AS host, string_split({_pages_host}, '.') AS l FROM pages)",
    "registrable_rules": _DOMAINS,
    "follow_redirects": _REDIRECTS.replace("\\\\", "\\"),
    "phone_regions": _PHONES.replace("\\\\", "\\"),
    "html_title": f"SELECT page_id, {_title} AS title FROM pages",
    "html_parked": f"SELECT page_id, {_parked} AS parked FROM (SELECT page_id, lower(coalesce({_title} || ' ', '') || substr(html, 1, 4000)) AS t FROM pages)",
    "token_set_ratio": "WITH p AS (SELECT DISTINCT p_name AS a FROM part), pr AS (SELECT x.a AS a, y.a AS b, x.a AS x, y.a AS y FROM p x JOIN p y ON split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1) AND x.a < y.a)," + _tsr("pr", "a, b") + " SELECT a, b, round_even(score, 6) AS ratio FROM tsr",
    "merge_root": "WITH RECURSIVE w(lead_key, p, hops) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey > 0 UNION ALL SELECT lead_key, p - (p & -p), hops + 1 FROM w WHERE p > 0 AND hops < 16) SELECT lead_key, min(p) AS root FROM w GROUP BY 1",
    "profile_columns": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(v) AS non_null, round_even(100 * count(v) / count(*)::DOUBLE, 2) AS filled, count(DISTINCT v) AS \"distinct\", CAST(max(length(v)) AS BIGINT) AS max_length, min(v) AS sample FROM (SELECT CAST({e} AS VARCHAR) AS v FROM orders)" for c, t, e in _ORDERS),
    "is_public_ip": "SELECT c_custkey, ip, NOT (" + " OR ".join(f"n BETWEEN {int(x[0])} AND {int(x[-1])}" for x in map(ipaddress.ip_network, fixed.CLOSED_NETWORKS)) + ") AS public FROM (SELECT c_custkey, (c_custkey % 224) || '.' || (c_custkey % 256) || '.' || (c_custkey % 7) || '.1' AS ip, (c_custkey % 224) * 16777216 + (c_custkey % 256) * 65536 + (c_custkey % 7) * 256 + 1 AS n FROM customer)",
    "deep_page": "SELECT l_quantity, l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 5 OFFSET 49995",
    "source_records": "SELECT 'customer' AS source_sheet, row_number() OVER () AS row_no, c_custkey AS customer, NULL AS supplier, true AS by_content FROM customer UNION ALL SELECT 'supplier', row_number() OVER (), NULL, s_suppkey, true FROM supplier",
    "profile_topk": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
    "profile_quantiles": "SELECT min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS max, round_even(avg(CASE WHEN l_extendedprice < 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_below FROM lineitem",
}

SQL = _PLAIN | {n: (_ROWS if n in _ON_ROWS else _ALL.rstrip() + (_FACTS if n == "pair_comparison" else _TAIL.get(n, "\n"))) + q for n, q in _QUERIES.items()}
