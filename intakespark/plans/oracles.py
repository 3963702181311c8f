"""SQL counterparts of the core queries, for an engine other than Spark.

Everything is computed from the raw contact columns: fields are parsed, notes cut into clauses, rules tried and points
added in SQL. The steps are named subqueries, and a query takes those it needs. The dialect knows no lookaround and no
backreference, so places are found by cutting texts at the matches. Word lists, patterns and points come from the same
tables as the operators'; the steps are written for themselves.
"""

from __future__ import annotations

import re

from ..functions import amounts, contacts, dates, fit, texts
from ..operators.lexicon import LADDERS, load_lexicon
from ..operators.scoring import DEFAULT as SCORING
from ..sources.settings import DROP
from ..sources.synthetic import contacts_sql

AS_OF = "2026-01-01"


def q(v) -> str:
    """A value as a literal; numbers with a fraction as DOUBLE."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")" if values else "(NULL)"


def rows(name: str, columns: str, data) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in data) + ")"


def case(column: str, table: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def first_of(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {q(code)}" for cond, code in pairs) + " END"


def joined(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {q(code)} END" for cond, code in pairs) + "], lambda w: w IS NOT NULL)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_of(patterns) -> str:
    return q("|".join(f"(?:{p})" for p in patterns))


def places(gaps: str, found: str) -> str:
    """Start and end of every match, from the texts between and of the matches."""
    upto = lambda part, n: f"coalesce(list_sum(list_transform({part}[1:{n}], lambda g: length(g))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': {upto(gaps, 'i')} + {upto(found, '(i - 1)')}, 'e': {upto(gaps, 'i')} + {upto(found, 'i')}}})"


S: dict[str, str] = {}
S["c"] = f"c AS ({contacts_sql()})"
S["kept"] = "kept AS (SELECT * FROM c WHERE NOT (" + " OR ".join(f"lower(trim({f})) IN {words(w)}" for f, w in DROP.items()) + "))"

# Identifiers.
S["ids"] = f"""id0 AS (SELECT *, {strip("lead_id")} AS s FROM c), id1 AS (
  SELECT *, regexp_extract(s, '^([A-Za-z]{{1,5}})?', 1) AS px, try_cast(regexp_extract(s, '^[A-Za-z]{{0,5}}[\\s_-]*([0-9]+)', 1) AS BIGINT) AS num, regexp_extract(s, '[0-9]+[\\s_-]+([A-Za-z0-9_-]+)$', 1) AS sx,
    {first_of(("s = ''", "ID_MISSING"), (f"lower(s) IN {words(contacts.ID_JUNK)}", "JUNK"), ("NOT regexp_matches(s, '[0-9]')", "ID_NO_NUMBER"), ("NOT regexp_matches(s, '^[A-Za-z]{0,5}[\\s_-]*[0-9]+([\\s_-]+[A-Za-z0-9_-]+)?$')", "ID_MALFORMED"))} AS bad FROM id0
), ids AS (SELECT seq, lead_id, bad, coalesce(bad, CASE WHEN px <> '' AND sx = '' THEN 'OK' ELSE 'OK_NORMALISED' END) AS id_code,
  CASE WHEN bad IS NULL THEN CASE WHEN px = '' THEN 'L' ELSE upper(px) END || '-' || num || CASE WHEN sx <> '' THEN '-' || sx ELSE '' END END AS id_canonical,
  CASE WHEN bad IS NULL THEN num END AS id_number, CASE WHEN bad IS NULL THEN sx END AS id_suffix, CASE WHEN bad IS NULL THEN CASE WHEN px = '' THEN 'L' ELSE upper(px) END END AS id_prefix,
  CASE WHEN bad IS NULL AND sx <> '' THEN ['ID_HAS_SUFFIX'] ELSE [] END AS id_warnings FROM id1)"""
S["dups"] = "firsts AS (SELECT id_number, min(seq) AS first FROM ids WHERE bad IS NULL AND seq IN (SELECT seq FROM kept) GROUP BY 1), dups AS (SELECT i.seq, coalesce(i.seq > f.first, false) AS is_duplicate FROM ids i LEFT JOIN firsts f USING (id_number) WHERE i.seq IN (SELECT seq FROM kept))"

# Dates.
_SEPARATORS = ("-", "/", ".")
_numeric = lambda x: "|".join(f"^[0-9]{{1,2}}{re.escape(x_)}[0-9]{{1,2}}{re.escape(x_)}([0-9]{{2}}|[0-9]{{4}})$" for x_ in x)
S["evidence"] = f"""ev0 AS (SELECT {strip("created")} AS s FROM kept), ev1 AS (SELECT regexp_extract(s, '[-/.]') AS separator, regexp_extract_all(s, '[0-9]+') AS n FROM ev0 WHERE regexp_matches(s, {q(_numeric(_SEPARATORS))})),
evidence AS (SELECT separator, count(*) FILTER (CAST(n[1] AS INT) > 12 AND CAST(n[2] AS INT) <= 12) AS day_first, count(*) FILTER (CAST(n[2] AS INT) > 12 AND CAST(n[1] AS INT) <= 12) AS month_first FROM ev1 GROUP BY 1),
evidence_all AS (SELECT * FROM evidence)"""
S["policy"] = "policy AS (SELECT separator, CASE WHEN day_first > month_first THEN 'day_first' ELSE 'month_first' END AS ord FROM evidence WHERE day_first <> month_first)"
_MONTH = "(" + "|".join(dates.MONTHS) + ")[a-z]*"
_month_names = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
_NAMED = f"({_month_names})"
S["dates"] = rf"""dt0 AS (SELECT seq, regexp_replace(trim({strip("created")}, ','), '\s+', ' ', 'g') AS s FROM c), dt1 AS (
  SELECT seq, s, lower(s) AS low, regexp_extract_all(s, '[0-9]+') AS n, CASE
    WHEN regexp_matches(s, '^[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}$') THEN 'iso' WHEN regexp_matches(s, '^[0-9]{{8}}$') THEN 'compact' WHEN regexp_matches(s, {q(_numeric(_SEPARATORS))}) THEN 'numeric'
    WHEN regexp_matches(lower(s), '^{_NAMED}\.?\s+[0-9]{{1,2}}(st|nd|rd|th)?[,\s]+([0-9]{{2}}|[0-9]{{4}})$') THEN 'mdy' WHEN regexp_matches(lower(s), '^[0-9]{{1,2}}(st|nd|rd|th)?\s+{_NAMED}\.?[,\s]+([0-9]{{2}}|[0-9]{{4}})$') THEN 'dmy'
    WHEN regexp_matches(lower(s), '^{_NAMED}\.?[,\s]+[0-9]{{4}}$') THEN 'my' WHEN regexp_matches(s, '^[0-9]{{4}}[-/][0-9]{{1,2}}$') THEN 'ym' WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') THEN 'time' END AS kind FROM dt0
), dt2 AS (SELECT d.*, list_position([{", ".join(q(m) for m in dates.MONTHS)}], substr(regexp_extract(low, '{_NAMED}'), 1, 3)) AS named, coalesce(p.ord, 'month_first') AS ord
  FROM dt1 d LEFT JOIN policy p ON d.kind = 'numeric' AND p.separator = regexp_extract(d.s, '[-/.]')
), dt3 AS (SELECT *, coalesce(kind = 'numeric' AND CAST(n[1] AS INT) <= 12 AND CAST(n[2] AS INT) <= 12, false) AS unclear FROM dt2
), dt4 AS (SELECT *, CASE WHEN kind = 'numeric' THEN CASE WHEN CAST(n[1] AS INT) > 12 AND CAST(n[2] AS INT) <= 12 OR unclear AND ord = 'day_first' THEN [n[3], n[2], n[1]] ELSE [n[3], n[1], n[2]] END
    WHEN kind IN ('iso', 'time') THEN n[1:3] WHEN kind = 'compact' THEN [substr(s, 1, 4), substr(s, 5, 2), substr(s, 7, 2)]
    WHEN kind IN ('mdy', 'dmy') THEN [n[2], CAST(named AS VARCHAR), n[1]] WHEN kind = 'my' THEN [n[1], CAST(named AS VARCHAR), '1'] WHEN kind = 'ym' THEN [n[1], n[2], '1'] END AS ymd FROM dt3
), dt5 AS (SELECT *, kind IN ('numeric', 'mdy', 'dmy', 'my') AND CAST(ymd[1] AS INT) < 100 AS short FROM dt4
), dt6 AS (SELECT *, try_cast(lpad(CAST(CASE WHEN short THEN CAST(ymd[1] AS INT) + CASE WHEN CAST(ymd[1] AS INT) <= 70 THEN 2000 ELSE 1900 END ELSE CAST(ymd[1] AS INT) END AS VARCHAR), 4, '0') || '-' || lpad(ymd[2], 2, '0') || '-' || lpad(ymd[3], 2, '0') AS DATE) AS day FROM dt5
), dt7 AS (SELECT *, {first_of(("s = ''", "EMPTY"), (f"low IN {words(dates.JUNK)}", "JUNK"), ("kind IS NULL", "DATE_UNKNOWN_FORMAT"), ("day IS NULL", "DATE_IMPOSSIBLE"), ("year(day) NOT BETWEEN 1990 AND 2100", "OUT_OF_RANGE"))} AS bad FROM dt6
), dts AS (SELECT seq, bad IS NULL AS date_ok, coalesce(bad, CASE WHEN unclear OR kind IN ('my', 'ym') THEN 'OK_ASSUMED' ELSE 'OK' END) AS date_code, CASE WHEN bad IS NULL THEN CAST(day AS VARCHAR) END AS parsed,
  CASE WHEN bad IS NULL THEN {joined(("short", "DATE_TWO_DIGIT_YEAR"), ("unclear", "DATE_AMBIGUOUS_ORDER"), (f"day > DATE '{AS_OF}'", "DATE_FUTURE"))} ELSE [] END AS date_warnings FROM dt7)"""

# E-mail addresses. The repair before a domain keeps what it looked ahead to.
_repaired = "y"
for _pattern, _sign in contacts.REPAIRS:
    _ahead = re.fullmatch(r"(.*)\(\?=(.*)\)", _pattern)
    _repaired = f"regexp_replace({_repaired}, {q(_ahead[1] + '(' + _ahead[2] + ')')}, '{_sign}\\1', 'g')" if _ahead else f"regexp_replace({_repaired}, {q(_pattern)}, {q(_sign)}, 'g')"
S["emails"] = rf"""em0 AS (SELECT seq, {strip("email")} AS s FROM c), em1 AS (SELECT *, CASE WHEN regexp_matches(s, '<[^>]+>') THEN {strip("regexp_extract(s, '<([^>]+)>', 1)")} ELSE s END AS y FROM em0),
em2 AS (SELECT *, {_repaired} AS fixed FROM em1), em3 AS (SELECT *, regexp_replace(trim({strip("fixed")}, '.,;:'), '(?i)^mailto:', '') AS x FROM em2),
em4 AS (SELECT *, string_split(x, '@') AS parts FROM em3), em5 AS (SELECT *, {strip("parts[1]")} AS part, {strip("parts[-1]")} AS dom FROM em4),
em6 AS (SELECT *, lower(dom) AS domain, lower(part) AS own, string_split(dom, '.') AS labels FROM em5),
em7 AS (SELECT *, domain IN {words(contacts.FREEMAIL)} AS free, string_split(own, '+')[1] IN {words(contacts.ROLES)} AS role, domain IN {words(contacts.DISPOSABLE)} AS gone,
  {first_of(("s = ''", "EMPTY"), (f"lower(s) IN {words(contacts.EMAIL_JUNK)}", "JUNK"), ("len(parts) = 1", "EMAIL_NO_AT"), ("len(parts) > 2", "EMAIL_MULTIPLE_AT"), ("part = ''", "EMAIL_MISSING_LOCAL"), ("dom = ''", "EMAIL_MISSING_DOMAIN"),
            (f"NOT regexp_matches(part, {q(contacts.LOCAL)}) OR part LIKE '.%' OR part LIKE '%.' OR contains(part, '..') OR contains(dom, ' ')", "EMAIL_INVALID_CHARS"), ("len(labels) = 1", "EMAIL_MISSING_TLD"),
            (f"len(list_filter(labels, lambda l: NOT regexp_matches(l, {q(contacts.LABEL)}))) > 0", "EMAIL_INVALID_CHARS"), (f"NOT regexp_matches(labels[-1], {q(contacts.TLD)})", "EMAIL_INVALID_TLD"))} AS bad FROM em6),
emails AS (SELECT seq, s AS email_raw, bad IS NULL AS email_ok, coalesce(bad, CASE WHEN fixed <> y THEN 'OK_REPAIRED' WHEN y <> s OR regexp_matches(s, '<[^>]+>') OR domain <> dom THEN 'OK_NORMALISED' ELSE 'OK' END) AS email_code, CASE WHEN bad IS NULL THEN own || '@' || domain END AS address,
  CASE WHEN bad IS NULL THEN domain END AS email_domain, bad IS NULL AND free AS freemail, bad IS NULL AND role AS role_address,
  CASE WHEN bad IS NULL THEN {joined(("free", "EMAIL_FREEMAIL"), ("gone", "EMAIL_DISPOSABLE"), ("role", "EMAIL_ROLE_ADDRESS"))} ELSE [] END AS email_warnings FROM em7)"""


def registrable(host: str) -> str:
    labels = f"string_split({host}, '.')"
    return f"CASE WHEN len({labels}) >= 3 AND array_to_string({labels}[-2:], '.') IN {words(contacts.TWO_PART_SUFFIXES)} THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END"


# Websites.
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
S["sites"] = rf"""ws0 AS (SELECT seq, trim({strip("website")}, '<>"''') AS s FROM c), ws1 AS (SELECT *, CASE WHEN regexp_matches(s, '\s') AND NOT regexp_matches(s, '(?i)^https?://') THEN regexp_extract(s, '^\S+') ELSE s END AS w FROM ws0),
ws2 AS (SELECT *, regexp_matches(w, '{_SCHEME}') AS had, contains(w, '@') AND NOT regexp_matches(s, '(?i)^https?://') AS mail, regexp_extract(regexp_replace(w, '{_SCHEME}', ''), '^[^/?#]*') AS net FROM ws1),
ws3 AS (SELECT *, lower(trim(regexp_replace(regexp_replace(net, '^.*@', ''), ':[0-9]*$', ''), '.')) AS host, CASE WHEN had THEN lower(string_split(w, '://')[1]) ELSE 'https' END AS scheme FROM ws2),
ws4 AS (SELECT *, string_split(host, '.') AS labels, host LIKE 'www.%' AS www, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS site FROM ws3),
ws5 AS (SELECT *, {first_of(("s = ''", "EMPTY"), (f"lower(s) IN {words(contacts.WEB_JUNK)}", "JUNK"), ("mail", "WEB_IS_EMAIL"), (r"host = '' OR regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$')", "WEB_INVALID_HOST"), ("len(labels) = 1", "WEB_NO_DOT"),
                            (f"len(list_filter(labels, lambda l: NOT regexp_matches(l, {q(contacts.LABEL)}))) > 0", "WEB_INVALID_HOST"), (f"NOT regexp_matches(labels[-1], {q(contacts.TLD)})", "WEB_INVALID_TLD"))} AS bad FROM ws4),
sites AS (SELECT seq, s AS site_raw, bad IS NULL AS site_ok, coalesce(bad, CASE WHEN NOT had OR www THEN 'OK_NORMALISED' ELSE 'OK' END) AS site_code, CASE WHEN bad IS NULL THEN scheme || '://' || site END AS url, CASE WHEN bad IS NULL THEN {registrable("site")} END AS site_domain,
  CASE WHEN bad IS NULL AND NOT had THEN ['WEB_SCHEME_ADDED'] ELSE [] END AS site_warnings FROM ws5)"""

# Amounts.
_times = lambda m: "CASE " + m + " WHEN '' THEN CAST(1 AS DOUBLE) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in amounts.MULTIPLIERS.items()) + " END"
_period = "CASE " + " ".join(f"WHEN regexp_matches(s, {q('(?i)' + p)}) THEN {q(n)}" for n, p in amounts.PERIODS) + " END"
_currency = f"CASE lower(regexp_extract(s, {q('(?i)' + amounts.CURRENCY)})) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in amounts.CURRENCIES.items()) + " ELSE 'USD' END"
S["amounts"] = rf"""am0 AS (SELECT seq, {strip("monthly_budget")} AS s FROM c),
am1 AS (SELECT *, trim(lower(s), ' .,;:') AS low, regexp_extract_all(s, {q(amounts.TOKEN)}, 2) AS nums, list_transform(regexp_extract_all(s, {q(amounts.TOKEN)}, 3), lambda m: lower(coalesce(m, ''))) AS mults, regexp_split_to_array(s, {q(amounts.TOKEN)})[2] AS between FROM am0),
am2 AS (SELECT *, coalesce(list_filter(mults, lambda m: m <> '')[-1], '') AS lent, len(nums) >= 2 AND regexp_full_match(coalesce(between, 'x'), {q(amounts.RANGE)}) AS is_range FROM am1),
am3 AS (SELECT *, list_transform(range(1, len(nums) + 1), lambda i: CAST(replace(nums[i], ',', '') AS DOUBLE) * CASE WHEN mults[i] = '' AND CAST(replace(nums[i], ',', '') AS DOUBLE) < 1000 THEN {_times("lent")} ELSE {_times("mults[i]")} END) AS v FROM am2),
am4 AS (SELECT *, CASE WHEN is_range THEN (v[1] + v[2]) / 2 ELSE v[1] END AS chosen, {_period} AS stated, regexp_matches(s, {q(amounts.UP_TO)}) OR regexp_matches(s, {q(amounts.FROM)}) OR s LIKE '%+' AS is_open FROM am3),
am5 AS (SELECT *, coalesce(stated, 'month') AS period, {first_of(("s = ''", "EMPTY"), (f"low IN {words(amounts.JUNK)}", "JUNK"), (f"low IN {words(amounts.PLACEHOLDERS)} OR regexp_full_match(low, {q(amounts.PLACEHOLDER_FORMS)})", "PLACEHOLDER"), ("NOT regexp_matches(s, '[0-9]')", "AMOUNT_NO_DIGITS"), ("len(nums) = 0", "NOT_A_VALUE"), ("chosen <> 0 AND chosen NOT BETWEEN 1 AND 5000000", "OUT_OF_RANGE"))} AS bad FROM am4),
am6 AS (SELECT *, CASE period WHEN 'month' THEN CAST(1 AS DOUBLE) WHEN 'week' THEN {q(4.345)} WHEN 'day' THEN {q(30.44)} WHEN 'quarter' THEN CAST(1 AS DOUBLE) / 3 WHEN 'year' THEN CAST(1 AS DOUBLE) / 12 END AS factor FROM am5),
amounts AS (SELECT seq, bad IS NULL AS amount_ok, coalesce(bad, CASE WHEN is_range OR regexp_matches(s, {q(amounts.ABOUT)}) THEN 'OK_ASSUMED' ELSE 'OK' END) AS amount_code, CASE WHEN bad IS NULL THEN chosen END AS value, CASE WHEN bad IS NULL THEN chosen * factor END AS monthly,
  CASE WHEN bad IS NULL THEN period END AS period, CASE WHEN bad IS NULL THEN {_currency} END AS currency,
  CASE WHEN bad IS NULL THEN {joined(("is_range AND v[1] > v[2]", "AMOUNT_INVERTED_RANGE"), ("is_range", "AMOUNT_RANGE"), ("NOT is_range AND is_open", "AMOUNT_OPEN_ENDED"), ("chosen = 0", "AMOUNT_ZERO"), ("stated IS NULL", "AMOUNT_NO_PERIOD"), ("factor IS NOT NULL AND period <> 'month'", "AMOUNT_PERIOD_CONVERTED"))} ELSE [] END AS amount_warnings FROM am6)"""

# Fit.
_titles = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {q(w)})' for w in ws)} THEN {q(level)}" for level, ws in fit.TITLES.items() if ws) + " END"
S["fit"] = rf"""fi0 AS (SELECT *, list_transform(regexp_extract_all(employees, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS l, lower({strip("title")}) AS t, lower(company || ' ' || notes) AS said FROM c),
fi1 AS (SELECT *, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) > 1 THEN CAST(round_even(list_sum(l) / len(l), 0) AS BIGINT) END AS head_count FROM fi0),
fit AS (SELECT seq, head_count, CASE {" ".join(f"WHEN head_count BETWEEN {low} AND {high} THEN {q(n)}" for n, low, high in fit.SIZE_BANDS)} ELSE 'unknown' END AS band, CASE WHEN t <> '' THEN {_titles} END AS level,
  {" OR ".join(f"contains(t, {q(w)})" for w in fit.NON_BUYERS)} AS non_buyer,
  CASE WHEN regexp_matches(said, {any_of(fit.PROFILE_NOT)}) THEN false WHEN regexp_matches(said, {any_of(fit.PROFILE_NOTES)}) OR regexp_matches(lower(company), {any_of(fit.PROFILE_COMPANY)}) THEN true END AS icp,
  {case("lower(trim(source))", fit.SOURCE_QUALITY, 0.4)} AS quality FROM fi1)"""

# Notes: sentences, clauses, negation.
_LEX = load_lexicon()
_plain = lambda p: p.replace("(?=", "(?:")  # noqa: E731  (nothing follows a lookahead in the table)
_ahead_of = lambda p: "(?:" + p.split("(?=", 1)[1] + "$" if "(?=" in p else ""  # noqa: E731  (what such a match holds too much)
_END = r"[.!?;]\s+|\s+-\s+"
_contrast = q(f"^(?:{'|'.join(texts.CONTRAST)})(?:[\\s,]|$)")
_SUB = r"'^(?:so|because|since|while|which|as)\b'"
_stop = q(f"(?s)^(.*?)(?:{texts.SCOPE_STOP})")
_cut = lambda flag, cond: f"list_transform(list_filter(range(1, length(seg) + 1), lambda p: {cond}), lambda p: {{'at': p - 1, 'op': {flag}}})"
S["clauses"] = rf"""no0 AS (SELECT DISTINCT notes AS note FROM c), no1 AS (SELECT note, lower(translate(note, {q(texts.FOLD_FROM)}, {q(texts.FOLD_TO)})) AS norm FROM no0),
no2 AS (SELECT *, regexp_split_to_array(norm, {q(_END)}) AS gaps, regexp_extract_all(norm, {q(_END)}) AS found FROM no1),
no3 AS (SELECT note, norm, unnest(list_transform(range(1, len(gaps) + 1), lambda i: {{'n': i, 'at': coalesce(list_sum(list_transform(gaps[1:i - 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0), 'seg': gaps[i] || CASE WHEN found[i] SIMILAR TO '[.!?;].*' THEN found[i][1] ELSE '' END}})) AS x FROM no2),
no4 AS (SELECT note, x.n AS sn, CAST(x.at AS BIGINT) AS s_at, x.seg AS seg FROM no3 WHERE x.seg <> ''),
no5 AS (SELECT *, list_sort(list_concat([{{'at': CAST(0 AS BIGINT), 'op': false}}], {_cut("true", f"regexp_matches(substr(seg, p), {_contrast}) AND (p = 1 OR regexp_matches(substr(seg, p - 1, 1), '[\\s,;]'))")}, {_cut("false", f"regexp_matches(substr(seg, p), {_SUB}) AND regexp_matches(substr(seg, 1, p - 1), ',\\s+$')")})) AS cuts FROM no4),
no6 AS (SELECT note, sn, s_at, seg, cuts, unnest(range(1, len(cuts) + 1)) AS k FROM no5),
no7 AS (SELECT note, sn, k, s_at + cuts[k].at AS b_at, cuts[k].op AS op, substr(seg, CAST(cuts[k].at + 1 AS BIGINT), CAST(coalesce(cuts[k + 1].at, length(seg)) - cuts[k].at AS BIGINT)) AS body FROM no6),
no8 AS (SELECT note, sn, k, op, b_at + length(body) - length(ltrim(body, ' ,')) AS c_at, regexp_replace(ltrim(body, ' ,'), '\s+$', '') AS text FROM no7),
no9 AS (SELECT *, regexp_split_to_array(text, {any_of(texts.NEGATION)}) AS ng, regexp_extract_all(text, {any_of(texts.NEGATION)}) AS nf, regexp_split_to_array(text, {any_of(texts.NOT_NEGATION)}) AS bg, regexp_extract_all(text, {any_of(texts.NOT_NEGATION)}) AS bf FROM no8 WHERE text <> ''),
no10 AS (SELECT *, {places("ng", "nf")} AS cues, {places("bg", "bf")} AS blocked FROM no9),
clauses AS (SELECT note, row_number() OVER (PARTITION BY note ORDER BY sn, k) AS ci, op, c_at, text, list_transform(list_filter(cues, lambda m: len(list_filter(blocked, lambda b: b.s <= m.s AND m.s < b.e)) = 0),
  lambda m: {{'s': m.e, 'e': m.e + least({texts.SCOPE}, CASE WHEN regexp_matches(substr(text, CAST(m.e + 1 AS BIGINT)), {q(texts.SCOPE_STOP)}) THEN length(regexp_extract(substr(text, CAST(m.e + 1 AS BIGINT)), {_stop}, 1)) ELSE length(text) - m.e END)}}) AS neg FROM no10)"""

# Turns of conversations, cut like notes. They hold letters beyond ASCII, which this dialect's word borders do not know.
_WORD_ENDS = r"(?:[^\pL\pN_]|$)"
S["turns"] = "c AS (SELECT coalesce(text, '') AS notes FROM conversations), " + S["clauses"].replace(_SUB, _SUB.replace(r"\b", _WORD_ENDS)) + """,
turns AS (SELECT conv_id, turn, coalesce(n, 0) AS clauses, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS words, coalesce(m, 0) AS operative
  FROM conversations t LEFT JOIN (SELECT note, count(*) AS n, count(*) FILTER (op) AS m FROM clauses GROUP BY note) x ON x.note = coalesce(t.text, ''))"""

# Notes: rules and what they say.
S["signals"] = rf"""{rows("pat", "r, p, pattern, ahead, dim, val, negated, strength, spec", [(k, i, _plain(p), _ahead_of(p), r["dimension"], r["value"], r["negated_value"], r["strength"], r["specificity"]) for k, r in enumerate(_LEX.rules) for i, p in enumerate(r["patterns"])])},
si0 AS (SELECT c.*, p.*, regexp_split_to_array(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS found FROM clauses c JOIN pat p ON regexp_matches(c.text, p.pattern)),
si1 AS (SELECT *, unnest({places("gaps", "found")}) AS m FROM si0),
si2 AS (SELECT *, CAST(m.s AS BIGINT) AS pos, len(list_filter(neg, lambda n: n.s <= m.s AND m.s < n.e)) > 0 AS is_neg FROM si1),
si3 AS (SELECT *, substr(text, greatest(pos - {texts.MODAL_WINDOW}, 0) + 1, pos + {texts.MODAL_WINDOW} - greatest(pos - {texts.MODAL_WINDOW}, 0)) AS win FROM si2),
si4 AS (SELECT *, greatest({q(0.4)}, least({q(1.2)}, CASE WHEN regexp_matches(win, {any_of(texts.HEDGES)}) THEN {q(0.75)} ELSE {q(1.0)} END * CASE WHEN regexp_matches(win, {any_of(texts.BOOSTERS)}) THEN {q(1.15)} ELSE {q(1.0)} END)) AS modal FROM si3),
signals AS (SELECT note, dim, CASE WHEN is_neg THEN negated ELSE val END AS val, op, is_neg, strength * CASE WHEN is_neg THEN {q(0.95)} ELSE {q(1.0)} END AS st, spec, least({q(1.0)}, spec * modal) * CASE WHEN is_neg THEN {q(0.9)} ELSE {q(1.0)} END AS conf, c_at + pos AS start, c_at + CAST(m.e AS BIGINT) - CASE WHEN ahead <> '' THEN length(regexp_extract(substr(text, pos + 1, CAST(m.e AS BIGINT) - pos), ahead)) ELSE 0 END AS fin, ci, r, p, pos FROM si4 WHERE NOT is_neg OR negated IS NOT NULL)"""
S["resolved"] = rf"""{rows("ladder", "dim, val, step", [(d, v, k) for d, vs in LADDERS.items() for k, v in enumerate(vs)])},
re0 AS (SELECT s.*, l.step, row_number() OVER (PARTITION BY note, s.dim ORDER BY op DESC, st DESC, spec DESC, conf DESC, start, ci, r, p, pos) AS place FROM signals s JOIN ladder l ON s.dim = l.dim AND s.val = l.val WHERE conf >= {q(float(_LEX.settings["min_signal_confidence"]))}),
resolved AS (SELECT w.note, w.dim, w.val, any_value(w.start) AS start, any_value(w.fin) AS fin, greatest({q(0.05)}, least({q(1.0)}, any_value(w.conf) + least({q(0.15)}, {q(0.05)} * (count(*) FILTER (g.val = w.val) - 1)) - CASE WHEN count(*) FILTER (g.val <> w.val AND (abs(g.step - w.step) >= 2 OR g.is_neg <> w.is_neg)) > 0 THEN {q(0.2)} ELSE {q(0.0)} END)) AS conf,
  count(*) FILTER (g.val <> w.val AND (abs(g.step - w.step) >= 2 OR g.is_neg <> w.is_neg)) > 0 AS conflict FROM re0 w JOIN re0 g ON w.note = g.note AND w.dim = g.dim WHERE w.place = 1 GROUP BY w.note, w.dim, w.val)"""
_flat = lambda table, *cols: [(k, *(e[c] for c in cols), p) for k, (e, p) in enumerate((e, p) for e in table for p in e["patterns"])]
S["notes"] = rf"""{rows("tp", "o, type, tconf, pattern", _flat(_LEX.intent_types, "type", "confidence"))}, {rows("pr", "o, label, category, pattern", [(k, e["label"], e["category"], "|".join(f"(?:{p})" for p in e["patterns"])) for k, e in enumerate(_LEX.problems)])},
{rows("nt", "o, code, severity, pattern", [(k, e["code"], e["severity"], "|".join(f"(?:{p})" for p in e["patterns"])) for k, e in enumerate(_LEX.negatives)])},
{rows("tl", "o, pattern, label, days, times", [(k, t["pattern"], t["label"], None if t["group"] else t["days"], t["multiplier"]) for k, t in enumerate(_LEX.timelines)])},
ty0 AS (SELECT note, o, type, tconf, CASE WHEN regexp_matches(norm, '(?s)^(?:' || pattern || ')') THEN 0 ELSE length(regexp_extract(norm, '(?s)^(.*?)(?:' || pattern || ')', 1)) END AS pos FROM no1 JOIN tp ON regexp_matches(norm, pattern)),
ty1 AS (SELECT t.*, coalesce((SELECT bool_or(len(list_filter(c.neg, lambda n: n.s <= t.pos - c.c_at AND t.pos - c.c_at < n.e)) > 0) FROM clauses c WHERE c.note = t.note AND c.c_at <= t.pos AND t.pos < c.c_at + length(c.text)), false) AS is_neg FROM ty0 t),
types AS (SELECT note, arg_min(type, o) AS intent_type, arg_min(tconf, o) AS tconf FROM ty1 WHERE NOT is_neg GROUP BY 1),
prob AS (SELECT note, string_agg(label, ', ' ORDER BY o) AS problems, list(category ORDER BY o) AS cats, count(*) AS n_problems FROM no1 JOIN pr ON regexp_matches(norm, pattern) GROUP BY 1),
negs AS (SELECT note, list(code ORDER BY severity DESC, o) AS codes, list(severity ORDER BY severity DESC, o) AS sevs, max(severity) AS gravest FROM no1 JOIN nt ON regexp_matches(norm, pattern) GROUP BY 1),
ti0 AS (SELECT note, o, label, coalesce(days, try_cast(regexp_extract(norm, pattern, 1) AS INT) * times) AS days, CASE WHEN days IS NULL THEN regexp_extract(norm, pattern, 1) ELSE '' END AS num FROM no1 JOIN tl ON regexp_matches(norm, pattern)),
ti1 AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY days, o) AS place FROM ti0 WHERE days IS NOT NULL),
notes AS (SELECT n.note, len(regexp_extract_all(n.note, '\S+')) AS n_words, trim(n.norm) = '' AS empty, coalesce(t.intent_type, 'UNKNOWN') AS intent_type, coalesce(t.tconf, {q(0.3)}) AS tconf, coalesce(p.problems, '') AS problems, coalesce(p.cats, []) AS cats, coalesce(p.n_problems, 0) AS n_problems, coalesce(g.codes, []) AS codes, coalesce(g.sevs, []) AS sevs, g.gravest, i.days AS timeline_days, coalesce(replace(i.label, '{{0}}', i.num), '') AS timeline,
  {", ".join(f"(SELECT any_value(val) FROM resolved r WHERE r.note = n.note AND dim = {q(d)}) AS {d}, (SELECT any_value(r.conf) FROM resolved r WHERE r.note = n.note AND dim = {q(d)}) AS conf_{d}" for d in LADDERS)},
  (SELECT count(*) FROM resolved r WHERE r.note = n.note AND conflict) AS n_conflicts
  FROM no1 n LEFT JOIN types t USING (note) LEFT JOIN prob p USING (note) LEFT JOIN negs g USING (note) LEFT JOIN ti1 i ON i.note = n.note AND i.place = 1)"""


def quoted(raw: str, start: str, end: str) -> str:
    """A stretch of a note with 24 signs on both sides, and marks where it was cut."""
    low, high = f"greatest({start} - 24, 0)", f"least({end} + 24, length({raw}))"
    body = strip(f"substr({raw}, CAST({low} + 1 AS BIGINT), CAST({high} - {low} AS BIGINT))")
    return f"CASE WHEN {start} > 24 THEN '…' ELSE '' END || replace({body}, chr(10), ' ') || CASE WHEN {end} + 24 < length({raw}) THEN '…' ELSE '' END"


# Quotes of notes: of each dimension's reading, of the problems named and of the negative signals.
S["found"] = f"""{rows("qp", "kind, o, i, label, severity, pattern", [(kind, k, i, label(e), e.get("severity", 0.0), p) for kind, part, label in (("problem", _LEX.problems, lambda e: e["label"]), ("negative", _LEX.negatives, lambda e: e["code"] + ": " + e["reason"])) for k, e in enumerate(part) for i, p in enumerate(e["patterns"])])},
qu0 AS (SELECT note, norm, kind, o, any_value(label) AS label, any_value(severity) AS severity, arg_min(pattern, i) AS pattern FROM no1 JOIN qp ON regexp_matches(norm, qp.pattern) GROUP BY ALL),
found AS (SELECT *, CAST(length(regexp_split_to_array(norm, pattern)[1]) AS BIGINT) AS s, CAST(length(regexp_extract(norm, pattern)) AS BIGINT) AS len FROM qu0)"""
S["quotes"] = f"""qu2 AS (SELECT note, kind, o, label, severity, {quoted("note", "s", "(s + len)")} AS quote FROM found),
qu3 AS (SELECT note, coalesce(string_agg(quote, '; ' ORDER BY o) FILTER (kind = 'problem'), '') AS problem_quotes, coalesce(list({{'label': label, 'quote': quote}} ORDER BY severity DESC, o) FILTER (kind = 'negative'), []) AS negative_quotes FROM qu2 GROUP BY note),
qu4 AS (SELECT note, dim, {quoted("note", "start", "fin")} AS quote FROM resolved),
quotes AS (SELECT n.note, coalesce(q.problem_quotes, '') AS problem_quotes, coalesce(q.negative_quotes, []) AS negative_quotes, {", ".join(f"(SELECT any_value(quote) FROM qu4 r WHERE r.note = n.note AND dim = {q(d)}) AS said_{d}" for d in LADDERS)} FROM no1 n LEFT JOIN qu3 q USING (note))"""
S["contradictions"] = f"""co0 AS (SELECT w.note, w.dim, w.val AS kept, g.val AS rejected, w.op AND NOT g.op AS later, w.start AS w_at, w.fin AS w_end, g.start AS g_at, g.fin AS g_end, row_number() OVER (PARTITION BY w.note, w.dim ORDER BY g.st DESC, g.ci, g.r, g.p, g.pos) AS place
  FROM re0 w JOIN re0 g ON w.note = g.note AND w.dim = g.dim WHERE w.place = 1 AND g.val <> w.val AND (abs(g.step - w.step) >= 2 OR g.is_neg <> w.is_neg)),
contradictions AS (SELECT note, dim AS dimension, kept, rejected, CASE WHEN later THEN 'post-contrast clause takes precedence' ELSE 'stronger, more specific evidence retained' END AS rule, {quoted("note", "w_at", "w_end")} AS evidence_kept, {quoted("note", "g_at", "g_end")} AS evidence_rejected FROM co0 WHERE place = 1)"""

# Notes as HTML with their evidence marked.
_safe = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
_islands = lambda name, gap, order: f"""{name}0 AS (SELECT *, coalesce(start {gap} max(fin) OVER (PARTITION BY note ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM spots),
{name}1 AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY note ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM {name}0),
{name}2 AS (SELECT note, island, min(start) AS s, max(fin) AS e, max(neg) FILTER (fresh) AS neg FROM {name}1 GROUP BY note, island)"""  # noqa: E731
S["marked"] = f"""spots AS (SELECT DISTINCT note, start, fin, 0 AS neg FROM resolved UNION SELECT note, s, s + len, 1 FROM found WHERE kind = 'negative'),
{_islands("hi", ">=", "start, fin DESC, neg")}, {_islands("me", ">", "start, fin, neg")},
hi3 AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY note ORDER BY s), 0) AS before FROM hi2),
hi4 AS (SELECT note, max(e) AS last, string_agg({_safe("substr(note, before + 1, s - before)")} || CASE WHEN neg = 1 THEN '<mark class="neg">' ELSE '<mark>' END || {_safe("substr(note, s + 1, e - s)")} || '</mark>', '' ORDER BY s) AS shown FROM hi3 GROUP BY note),
me3 AS (SELECT note, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM me2 GROUP BY note),
marked AS (SELECT n.note, coalesce(h.shown, '') || {_safe("substr(n.note, coalesce(h.last, 0) + 1)")} AS html, coalesce(m.spans, '') AS spans FROM no1 n LEFT JOIN hi4 h USING (note) LEFT JOIN me3 m USING (note))"""


def profiles(source: str, level: str) -> str:
    """Profiles of contacts: what the note says, and the job title where the note names no authority."""
    dims = list(LADDERS)
    val = lambda d: f"coalesce(n.{d}, {level}, 'UNKNOWN')" if d == "decision_authority" else f"coalesce(n.{d}, 'UNKNOWN')"
    conf = lambda d: f"CASE WHEN n.{d} IS NULL AND {level} IS NOT NULL THEN {q(0.55)} ELSE n.conf_{d} END" if d == "decision_authority" else f"n.conf_{d}"
    return f"""pf0 AS (SELECT s.seq, n.* EXCLUDE ({", ".join(dims)}), {", ".join(f"{val(d)} AS {d}" for d in dims)}, list_filter([{", ".join(conf(d) for d in dims)}], lambda x: x IS NOT NULL) AS known FROM {source} s JOIN notes n ON n.note = s.notes),
pf1 AS (SELECT *, CASE WHEN len(known) = 0 THEN {q(0.1)} ELSE {q(0.65)} * (list_sum(known) / len(known)) + {q(0.35)} * len(known) / 7 END AS b0 FROM pf0),
pf2 AS (SELECT *, CASE WHEN n_words < 6 THEN b0 * {q(0.7)} WHEN n_words > 25 THEN least({q(1.0)}, b0 * {q(1.05)}) ELSE b0 END - {q(0.05)} * n_conflicts AS b1 FROM pf1),
pf3 AS (SELECT *, CASE WHEN intent_type = 'UNKNOWN' THEN b1 * {q(0.85)} ELSE {q(0.75)} * b1 + {q(0.25)} * tconf END AS b2 FROM pf2),
pf4 AS (SELECT *, CASE WHEN intent_type NOT IN ('UNKNOWN', 'PURCHASE') THEN greatest(b2, tconf * {q(0.9)}) WHEN gravest IS NOT NULL THEN greatest(b2, gravest * {q(0.7)}) ELSE b2 END AS b3 FROM pf3),
profiles AS (SELECT *, CASE WHEN empty THEN 0 ELSE round_even(greatest(0, least(1, b3)), 3) END AS confidence,
  CASE WHEN empty THEN 'UNKNOWN' WHEN buying_stage = 'PURCHASE' THEN 'READY_TO_BUY' WHEN urgency IN ('HIGH', 'VERY_HIGH') AND buying_stage IN ('EVALUATION', 'DECISION') THEN 'CONCRETE_TIMELINE' WHEN buying_stage = 'DECISION' THEN 'CONCRETE_TIMELINE' WHEN buying_stage = 'EVALUATION' THEN 'ACTIVE_EVALUATION'
    WHEN buying_stage = 'EXPLORATION' THEN 'EXPLORATION' WHEN buying_stage = 'AWARENESS' THEN 'INTEREST' WHEN list_has_any(codes, ['NOT_A_BUYER', 'JOB_SEEKER', 'SPAM']) THEN 'NONE' ELSE 'UNKNOWN' END AS commitment,
  CASE WHEN empty THEN 6 ELSE {" + ".join(f"CAST({d} = 'UNKNOWN' AS INT)" for d in ("budget_status", "urgency", "decision_authority", "buying_stage", "pain_severity"))} + CAST(n_words < 6 AS INT) + CAST(n_problems = 0 AS INT) END AS n_missing FROM pf4)"""


# Scores.
_Q = SCORING["quality"]
_points = [(d, case(d, {k: float(v) for k, v in SCORING["intent"][d].items()}, 0.0)) for d in LADDERS]
_quality = (
    ("NOT email_ok", "invalid_email"), ("email_ok AND freemail", "freemail"), ("email_ok AND role_address", "role"), ("NOT site_ok AND site_code = 'EMPTY'", "missing_website"), ("NOT site_ok AND site_code <> 'EMPTY'", "invalid_website"),
    ("coalesce(same_domain, false)", "domain_match"), ("trim(notes) = ''", "missing_notes"), ("is_duplicate", "duplicate"), ("id_bad", "bad_id"),
)
_order = {b[0]: k for k, b in enumerate(SCORING["bands"])}
_routing = lambda k, default: "CASE intent_type " + " ".join(f"WHEN {q(t)} THEN {q(r[k])}" for t, r in SCORING["routing"].items() if r[k] is not None) + f" ELSE {q(default)} END"
_band_no = lambda k, default: "CASE intent_type " + " ".join(f"WHEN {q(t)} THEN {_order[r[k]]}" for t, r in SCORING["routing"].items() if r[k]) + f" ELSE {default} END"
_line = lambda cond, group, points: f"CASE WHEN {cond} THEN {{'g': {q(group)}, 'p': CAST({points} AS DOUBLE)}} END"
_fit_total = "size_p + icp_p + source_p + budget_p + seller_p"
S["scored"] = f"""sc0 AS (SELECT k.*, i.id_code, i.bad IS NOT NULL AS id_bad, i.id_canonical, i.id_warnings, d.is_duplicate, e.* EXCLUDE (seq), w.* EXCLUDE (seq), a.* EXCLUDE (seq), t.* EXCLUDE (seq), f.head_count, f.band AS size_band, f.non_buyer, f.icp, f.quality,
    p.* EXCLUDE (seq), coalesce(monthly, value) AS budget_monthly, CASE WHEN email_domain <> '' THEN {registrable("email_domain")} = site_domain END AS same_domain
  FROM kept k JOIN ids i USING (seq) JOIN dups d USING (seq) JOIN emails e USING (seq) JOIN sites w USING (seq) JOIN amounts a USING (seq) JOIN dts t USING (seq) JOIN fit f USING (seq) JOIN profiles p USING (seq)),
sc1 AS (SELECT *, {", ".join(f"{sql} AS p_{d}" for d, sql in _points)}, CASE WHEN n_problems > 0 THEN {q(float(SCORING["problem_bonus"]))} ELSE {q(0.0)} END AS bonus, greatest({q(SCORING["confidence_floor"])}, confidence) AS factor,
  {case("size_band", {k: float(v) for k, v in SCORING["size"].items()}, 0.0)} AS size_p, CASE WHEN icp THEN {q(float(SCORING["profile"]["true"]))} WHEN NOT icp THEN {q(float(SCORING["profile"]["false"]))} ELSE {q(0.0)} END AS icp_p, {q(float(SCORING["source_points"]))} * quality AS source_p,
  CASE WHEN budget_monthly IS NULL THEN {q(0.0)} WHEN budget_monthly > 5000 THEN {q(10.0)} WHEN budget_monthly = 5000 THEN {q(6.0)} ELSE {q(-8.0)} END AS budget_p, CASE WHEN non_buyer THEN {q(float(SCORING["non_buyer"]))} ELSE {q(0.0)} END AS seller_p,
  list_transform(range(1, len(codes) + 1), lambda i: CASE WHEN codes[i] IN {words(SCORING["already_scored"])} THEN {q(0.0)} ELSE -round_even(sevs[i] * {q(float(SCORING["negative_factor"]))}, 1) END) AS neg_p FROM sc0),
sc2 AS (SELECT *, {" + ".join(f"p_{d}" for d, _ in _points)} + bonus AS said, {" + ".join(f"CASE WHEN {c} THEN {q(float(_Q[k]))} ELSE {q(0.0)} END" for c, k in _quality)} AS quality_p, {_routing(3, 1.0)} AS times, {_routing(2, "Sales")} AS route FROM sc1),
sc3 AS (SELECT *, said * CASE WHEN factor < 1 THEN factor ELSE 1 END + ({_fit_total}) + quality_p + coalesce(list_sum(neg_p), 0) AS before FROM sc2),
sc4 AS (SELECT *, before * times AS total, list_filter(list_concat([{", ".join(_line(f"p_{d} <> 0", "Intent", f"p_{d}") for d, _ in _points)}, {_line("bonus <> 0", "Intent", "bonus")}, {_line("factor < 1 AND said <> 0", "Intent", "round_even(said * factor - said, 1)")},
    {_line("size_p <> 0", "Fit", "size_p")}, {_line("icp_p <> 0", "Fit", "icp_p")}, {_line("source_p <> 0", "Fit", "round_even(source_p, 1)")}, {_line("budget_p <> 0", "Fit", "budget_p")}, {_line("non_buyer", "Fit", "seller_p")}, {", ".join(_line(c, "Data quality", q(float(_Q[k]))) for c, k in _quality)}],
    list_transform(neg_p, lambda x: {{'g': 'Negative signal', 'p': x}}), [{_line("times <> 1", "Routing", "round_even(before * times - before, 1)")}]), lambda x: x IS NOT NULL) AS ledger FROM sc3),
sc5 AS (SELECT *, {"CASE " + " ".join(f"WHEN total >= {b[1]} THEN {k}" for k, b in enumerate(SCORING["bands"])) + f" ELSE {len(_order) - 1} END"} AS by_score, list_transform(codes, lambda x: {case("x", {c: _order[b] for c, b in SCORING["placements"].items()}, None)}) AS targets FROM sc4),
sc6 AS (SELECT *, greatest(by_score, {_band_no(0, 0)}) AS capped, list_filter(targets, lambda x: x < {_order["DISQUALIFY"]}) AS soft FROM sc5),
sc7 AS (SELECT *, least(CASE WHEN list_contains(targets, {_order["DISQUALIFY"]}) THEN {_order["DISQUALIFY"]} WHEN len(soft) > 0 THEN list_max(soft) ELSE capped END, {_band_no(1, len(_order))}) AS place FROM sc6),
scored AS (SELECT *, [{", ".join(q(b[0]) for b in SCORING["bands"])}][place + 1] AS band, [{", ".join(q(b[2]) for b in SCORING["bands"])}][place + 1] AS band_label, round_even(total, 1) + 0 AS raw_score, round_even(greatest(0, least(100, (total - {SCORING["display"][0]}) / {SCORING["display"][1] - SCORING["display"][0]} * 100)), 1) AS score,
  CAST(id_bad AS INT) + CAST(NOT date_ok AS INT) + CAST(NOT email_ok AS INT) + CAST(NOT site_ok AS INT) + CAST(NOT amount_ok AS INT) + CAST(freemail AS INT) + CAST(role_address AS INT) + CAST(list_contains(date_warnings, 'DATE_AMBIGUOUS_ORDER') AS INT) + CAST(list_contains(amount_warnings, 'AMOUNT_RANGE') AS INT) + CAST(is_duplicate AS INT) + CAST(trim(notes) = '' AS INT) AS data_issues FROM sc7)"""
S["fields"] = """fields AS (
  SELECT seq, 'Lead ID' AS field, NOT id_bad AS ok, lead_id AS raw, list_concat([id_code], id_warnings) AS codes FROM scored UNION ALL SELECT seq, 'Created', date_ok, created, list_concat([date_code], date_warnings) FROM scored UNION ALL
  SELECT seq, 'Email', email_ok, email, list_concat([email_code], email_warnings) FROM scored UNION ALL SELECT seq, 'Website', site_ok, website, list_concat([site_code], site_warnings) FROM scored UNION ALL SELECT seq, 'Budget', amount_ok, monthly_budget, list_concat([amount_code], amount_warnings) FROM scored)"""

# What the lines of the ledger say. The conditions are those under which a line has points.
_says = lambda cond, label, evidence: f"CASE WHEN {cond} THEN {{'label': {label}, 'evidence': coalesce({evidence}, '')}} END"
_dimension_says = lambda d: f"coalesce(said_{d}, '(inferred from job title)')" if d == "decision_authority" else f"said_{d}"
_quality_says = {
    "invalid_email": ("'Invalid email (' || email_code || ')'", "email_raw"), "freemail": ("'Personal email domain'", "email_domain"), "role": ("'Role mailbox'", "address"), "missing_website": ("'Website empty'", "site_raw"),
    "invalid_website": ("'Website ' || lower(replace(site_code, '_', ' '))", "site_raw"), "domain_match": ("'Email domain matches website'", "''"), "missing_notes": ("'No notes'", "''"), "duplicate": ("'Duplicate lead ID'", "lead_id"),
    "bad_id": ("'Lead ID ' || id_code", "lead_id"),
}
S["lines"] = f"""lines AS (SELECT seq, list_filter(list_concat([{", ".join(_says(f"p_{d} <> 0", q(d.replace("_", " ").capitalize() + ": ") + f" || {d}", _dimension_says(d)) for d, _ in _points)},
    {_says("bonus <> 0", "'Named problem: ' || problems", "problem_quotes")}, {_says("factor < 1 AND said <> 0", "'NLP confidence x' || printf('%.2f', factor)", "n_missing || ' field(s) not stated in the note'")},
    {_says("size_p <> 0", "'Company size: ' || size_band", "employees")}, {_says("icp_p <> 0", "CASE WHEN icp THEN 'In target profile' ELSE 'Outside target profile' END", "company")},
    {_says("source_p <> 0", "'Source: ' || coalesce(nullif(trim(source), ''), 'unknown')", "'channel quality ' || printf('%.2f', quality)")},
    {_says("budget_p <> 0", "'Stated budget ' || CASE WHEN budget_monthly > 5000 THEN 'above floor' WHEN budget_monthly = 5000 THEN 'at floor' ELSE 'below floor' END", "monthly_budget")}, {_says("non_buyer", "'Non-buying role: ' || title", "title")},
    {", ".join(_says(c, *_quality_says[k]) for c, k in _quality if _Q[k])}],
    list_transform(negative_quotes, lambda x: {{'label': x.label, 'evidence': x.quote}}), [{_says("times <> 1", "intent_type || ' multiplier x' || times", "''")}]), lambda x: x IS NOT NULL) AS says FROM scored JOIN quotes USING (note))"""

#: Steps that a step needs before it.
NEEDS = {
    "kept": ["c"], "ids": ["c"], "dups": ["kept", "ids"], "evidence": ["kept"], "policy": ["evidence"], "dates": ["policy"], "emails": ["c"], "sites": ["c"], "amounts": ["c"], "fit": ["c"], "clauses": ["c"], "signals": ["clauses"], "resolved": ["signals"], "notes": ["resolved"],
    "found": ["clauses"], "quotes": ["resolved", "found"], "contradictions": ["resolved"], "marked": ["resolved", "found"], "lines": ["scored", "quotes"],
    "note_profiles": ["notes"], "profiles": ["notes", "fit"], "scored": ["kept", "dups", "dates", "emails", "sites", "amounts", "profiles"], "fields": ["scored"],
}
S["note_profiles"] = profiles("c", "NULL")
S["profiles"] = "leads AS (SELECT c.*, f.level AS title_level FROM c JOIN fit f USING (seq)), " + profiles("leads", "s.title_level")


def sql(step: str, select: str) -> str:
    """A query over a step and all that it needs."""
    order: list[str] = []

    def need(s: str) -> None:
        for x in NEEDS.get(s, []):
            need(x)
        if s not in order:
            order.append(s)

    for s in step.split():
        need(s)
    return "WITH " + ",\n".join(S[s] for s in order) + f"\n{select}"
