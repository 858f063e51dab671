"""Registered queries of the financial JSON route (U7, H21-H23): the extraction
and its token formula over every document, and over requests that orders and
customers make, each with a JSON Schema of its own.

The oracle's SQL is written apart from the operator: it splits a text at block
ends, ranks the markers of a sentence, and takes items with searches that DuckDB
runs in linear time."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.operators import records as REC
from verity.plans.catalog import register
from verity.sources import fixtures as X
from verity.sources.tables import table

# Reads rows of fr(id, date, text); gives one row per user block in usr.
_USERS = r"""
sen AS (SELECT id, string_split(regexp_replace(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END,
        '\.( [A-Za-z])', chr(1) || '\1', 'g'), chr(1)) AS ss FROM fr WHERE contains(text, ' earns ₹')),
one AS (SELECT id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM sen),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY i) AS following, string_split(s, ' earns ₹') AS p FROM one),
mrk AS (SELECT *, unnest(range(1, len(p))) AS j FROM nxt WHERE len(p) > 1),
par AS (SELECT *, regexp_extract(p[j], '[A-Za-z\s]+$') AS who, array_to_string(p[j + 1:], ' earns ₹') AS rest FROM mrk),
can AS (SELECT *, regexp_matches(rest, '^[\d,]+ $') AS bare FROM par
        WHERE who <> '' AND NOT contains(rest, chr(10)) AND regexp_matches(rest, '^[\d,]+ ')),
fst AS (SELECT * FROM can QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY j) = 1),
use AS (SELECT * FROM fst WHERE NOT bare OR (following IS NOT NULL AND NOT contains(following, chr(10)))),
blk AS (SELECT u.id, u.i, trim(u.who) AS name, u.who || ' earns ₹' || u.rest || CASE WHEN u.bare THEN '.' || u.following ELSE '' END AS b
        FROM use u LEFT JOIN use v ON v.id = u.id AND v.i = u.i - 1 AND v.bare WHERE v.id IS NULL),
itm AS (SELECT *, regexp_extract_all(b, 'invested ₹([\d,]+) in ([^,.]+)', 1) AS ia, regexp_extract_all(b, 'invested ₹([\d,]+) in ([^,.]+)', 2) AS ik,
        regexp_extract_all(b, '([\w\s]+) loan of ₹([\d,]+)', 2) AS la, regexp_extract_all(b, '([\w\s]+) loan of ₹([\d,]+)', 1) AS lk,
        regexp_extract_all(b, '([\w\s]+) debt of ₹([\d,]+)', 2) AS da, regexp_extract_all(b, '([\w\s]+) debt of ₹([\d,]+)', 1) AS dk,
        regexp_extract_all(b, 'savings of ₹([\d,]+) in [^,.]+', 1) AS sa, NOT contains(b, 'spends ₹') AS silent FROM blk),
kys AS (SELECT id, i, name, silent, CAST(replace(regexp_extract(b, 'earns ₹([\d,]+)', 1), ',', '') AS BIGINT) AS salary,
        TRY_CAST(replace(regexp_extract(b, 'spends ₹([\d,]+)', 1), ',', '') AS BIGINT) AS expenses,
        coalesce(CAST(replace(sa[-1], ',', '') AS BIGINT), 0) AS savings,
        list_transform(ia, lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS ia, list_transform(ik, lambda x: lower(trim(x))) AS ik,
        list_transform(la, lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS la, list_transform(lk, lambda x: lower(trim(x))) AS lk,
        list_transform(da, lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS da, list_transform(dk, lambda x: lower(trim(x))) AS dk FROM itm),
-- of equal names the last amount stays
usr AS (SELECT *, list_filter(ia, lambda x, n: NOT list_contains(ik[n + 1:], ik[n])) AS iv, list_filter(la, lambda x, n: NOT list_contains(lk[n + 1:], lk[n])) AS lv,
        list_filter(da, lambda x, n: NOT list_contains(dk[n + 1:], dk[n])) AS dv, list_filter(lk, lambda x, n: NOT list_contains(lk[n + 1:], x)) AS lu FROM kys)"""


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def _map_words(keys: str) -> str:
    return f"CASE WHEN len({keys}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct({keys}), lambda k: {_words('k')} + 1)) - 1 END"


_TALLY = f"""
tly AS (SELECT id, count(*) AS n, bool_or(silent) AS silent, sum(salary) AS salaries, string_agg(name, '|' ORDER BY i) AS names,
        sum(coalesce(list_sum(iv), 0)) AS invested, sum(coalesce(list_sum(lv), 0)) AS lent, sum(coalesce(list_sum(dv), 0)) AS owed, sum(savings) AS saved,
        sum(13 + {_words('name')} + {_map_words('ik')} + {_map_words('lk')} + {_map_words('dk')}) AS words FROM usr GROUP BY id)"""
_TOKENS = f"{_words('text')} + CASE WHEN coalesce(n, 0) = 0 THEN 4 ELSE 3 + words END"


@register("u7_financial_json", f"""WITH fr AS (SELECT doc_id AS id, text FROM documents),{_USERS},{_TALLY}
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(n, 0) END AS n_users,
       CASE WHEN d.text IS NULL OR silent THEN 'error' ELSE 'success' END AS status,
       CASE WHEN silent THEN 500 WHEN d.text IS NULL THEN 400 ELSE 200 END AS code,
       CAST(CASE WHEN d.text IS NULL OR silent THEN 0 ELSE {_TOKENS} END AS BIGINT) AS tokens_used
FROM documents d LEFT JOIN tly ON tly.id = d.doc_id""")
def u7_financial_json(spark, sf_dir):
    """U7 over every document as a JSON-route request."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("2024-01-01").alias("date"), "text")
    out = REC.process_financial_data(d)
    return out.select("doc_id", F.size("users").alias("n_users"), "status", "code", "tokens_used")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The request table, rebuilt from the given tables.
_N = "CAST(floor(o_totalprice) AS BIGINT)"


def _g(n: str) -> str:
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) ELSE CAST({n} // 1000 AS VARCHAR) || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') END"


_REQUESTS = f"""src AS (SELECT o_orderkey AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Buyer' AS who, {_g(_N)} AS n,
        {_g(_N + ' // 10')} AS tenth, {_g(_N + ' % 17000')} AS few FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
two AS (SELECT *, who || ' earns ₹' || n || ' a year, spends ₹' || tenth || ', and invested ₹' || few || ' in Bonds, with savings of ₹5 in cash' AS plain,
        'Clerk of ' || who || ' earns ₹' || tenth || ' and spends ₹10. Owes nothing. The Agent earns ₹' || n || ' or so, spends ₹' || few || ', has a car loan of ₹' || few
        || ' and Home loan of ₹7,000, a card debt of ₹12, and a card debt of ₹13' AS owing FROM src),
req AS (SELECT k AS id, CASE WHEN k % 5 <> 4 THEN '2024-01-01' END AS date, CASE WHEN k % 97 <> 96 THEN CASE k % 8
        WHEN 0 THEN 'In short. ' || plain || '. ' || owing || '.'
        WHEN 1 THEN owing || '. End of it'
        WHEN 2 THEN plain || '. Someone earns ₹' || n || ' and saves'
        WHEN 3 THEN who || ' earns ₹9 on' || chr(10) || 'many days, spends ₹1. ' || plain
        WHEN 4 THEN who || ' earns ₹' || n || ' when Partner earns ₹5 and spends ₹4. ' || plain || chr(10)
        WHEN 5 THEN who || ' earns ₹' || n || ' . Later it spends ₹' || tenth || '. ' || owing
        WHEN 6 THEN 'The order of ' || who || ' is worth ₹' || n || '. Nobody earns money'
        ELSE who || ' earns ₹x, but Other earns ₹' || n || ' and spends ₹3' END END AS text,
        CASE WHEN k % 11 = 10 THEN 'none' WHEN k % 13 = 12 THEN 'broken' ELSE ['usual', 'limits', 'types'][k % 3 + 1] END AS rules FROM two)"""
_REQ_USERS = _USERS.replace("FROM fr WHERE", "FROM req WHERE")


@register("u7_financial_requests", f"""WITH {_REQUESTS},{_REQ_USERS},{_TALLY},
plc AS (SELECT *, '$.users[' || CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS VARCHAR) || ']' AS place FROM usr),
bad AS (
  SELECT id, place || ': ''expenses'' is a required property' AS v FROM plc JOIN req USING (id) WHERE rules = 'usual' AND expenses IS NULL
  UNION ALL SELECT id, '$: ''date'' is a required property' FROM req WHERE rules = 'usual' AND date IS NULL
  UNION ALL SELECT id, '$: ''users'' is a required property' FROM req WHERE rules = 'usual' AND text IS NULL
  UNION ALL SELECT id, place || ': ''pension'' is a required property' FROM plc JOIN req USING (id) WHERE rules = 'limits'
  UNION ALL SELECT id, place || '.salary is below its minimum' FROM plc JOIN req USING (id) WHERE rules = 'limits' AND salary < 50000
  UNION ALL SELECT id, place || '.salary is above its maximum' FROM plc JOIN req USING (id) WHERE rules = 'limits' AND salary > 400000
  UNION ALL SELECT id, place || '.loans.' || name || ' is above its maximum'
            FROM (SELECT id, place, unnest(lu) AS name, unnest(lv) AS amount FROM plc JOIN req USING (id) WHERE rules = 'limits') WHERE amount > 9000
  UNION ALL SELECT id, place || '.salary is not of type string' FROM plc JOIN req USING (id) WHERE rules = 'types'
  UNION ALL SELECT id, place || '.savings is below its minimum' FROM plc JOIN req USING (id) WHERE rules = 'types' AND savings < 1),
msg AS (SELECT id, count(*) AS n_bad, string_agg(v, '; ' ORDER BY v) AS vs FROM bad GROUP BY id),
cod AS (SELECT r.id, r.text, r.rules, tly.* EXCLUDE (id), n_bad, vs, CASE WHEN silent OR rules = 'broken' THEN 500
        WHEN date IS NULL OR r.text IS NULL OR rules = 'none' OR n_bad > 0 THEN 400 ELSE 200 END AS code
        FROM req r LEFT JOIN tly ON tly.id = r.id LEFT JOIN msg ON msg.id = r.id)
SELECT id AS request_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS n_users, CASE WHEN text IS NOT NULL THEN coalesce(names, '') END AS names,
       CAST(salaries AS BIGINT) AS salaries, CAST(invested AS BIGINT) AS invested, CAST(lent AS BIGINT) AS lent, CAST(owed AS BIGINT) AS owed,
       CAST(saved AS BIGINT) AS saved, CASE WHEN rules NOT IN ('none', 'broken') THEN coalesce(vs, '') END AS violations, code,
       CAST(CASE WHEN code = 200 THEN {_TOKENS} ELSE 0 END AS BIGINT) AS tokens_used FROM cod""")
def u7_financial_requests(spark, sf_dir):
    """U7 with H21-H23 over one request per order, each response checked against
    the request's own schema."""
    out = REC.process_financial_data(X.financial_requests(spark, sf_dir), schema="schema_json")

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def of(name):
        return F.when(F.size("users") > 0, total(F.flatten(F.transform("users", lambda u: F.map_values(u[name])))))

    return out.select(
        "request_id", F.size("users").alias("n_users"), F.array_join(F.transform("users", lambda u: u["name"]), "|").alias("names"),
        F.when(F.size("users") > 0, total(F.transform("users", lambda u: u["salary"]))).alias("salaries"),
        of("investments").alias("invested"), of("loans").alias("lent"), of("debts").alias("owed"),
        F.when(F.size("users") > 0, total(F.transform("users", lambda u: u["savings"]))).alias("saved"),
        F.array_join("violations", "; ").alias("violations"), "code", "tokens_used")
