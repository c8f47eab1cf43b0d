"""The same queries in SQL for a second engine, written independently.

Every text is a chain of common table expressions from the supplied tables to
the result.  Rules are stated the plain way (date parsing, casts, list
functions) and share only the fixed values with the Spark side.
"""

from __future__ import annotations

import re

from musterroll import fixed_values as V
from musterroll.contract import CONTRACT, HEADERS, NAMES
from musterroll.functions.text import BLANKS
from musterroll.plans import derived as D


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


LABEL = {f.name: f.label for f in CONTRACT}
LABELS = "CASE {c} " + " ".join(f"WHEN {q(f.name)} THEN {q(f.label)}" for f in CONTRACT) + " END"
POS = "CASE {c} " + " ".join(f"WHEN {q(f.name)} THEN {f.pos}" for f in CONTRACT) + " END"


def label(col: str) -> str:
    return LABELS.format(c=col)


# --- rules ------------------------------------------------------------------------


# Blanks of every kind, which this engine's own class leaves out.
_BLANK = r"[\s\x{0b}\x{85}\p{Z}]"


def parse(v: str, iso_dayfirst: bool = False) -> str:
    """A date in one of the spellings that the derived members use."""
    iso = "'%Y-%d-%m', '%Y-%m-%d'" if iso_dayfirst else "'%Y-%m-%d'"
    bare = f"regexp_replace({v}, '^[A-Z][a-z]+day ', '')"
    bare = f"regexp_replace({bare}, '^([0-9]+)(st|nd|rd|th)( of)? ', '\\1 ')"
    bare = f"regexp_replace(regexp_replace({bare}, 'T[0-9:+]+$', ''), '^[0-9]+[ap]m ', '')"
    named = "'%b-%d-%Y', '%Y %B %d', '%d %b %Y', '%d %B %Y', '%d/%b/%Y', '%d-%b-%y', '%d/%m/%Y %H:%M'"
    return f"try_strptime({bare}, ['%d/%m/%Y', {iso}, '%d-%m-%Y', {named}])"


def uk(expr: str) -> str:
    return f"strftime({expr}, '%d/%m/%Y')"


def norm(f, v: str, iso_dayfirst: bool = False) -> str:
    if f.kind == "email":
        return f"lower({v})"
    if f.kind == "postcode":
        t = f"regexp_replace(upper({v}), '{_BLANK}+', '', 'g')"
        return f"CASE WHEN length({t}) >= 5 THEN {t}[:-4] || ' ' || {t}[-3:] ELSE {t} END"
    if f.kind == "date":
        return f"CASE WHEN regexp_full_match({v}, '\\d\\d/\\d\\d/\\d{{4}}') THEN {v} ELSE coalesce({uk(parse(v, iso_dayfirst))}, {v}) END"
    if f.kind == "integer":
        return f"coalesce(CAST(CAST(trunc(try_cast({v} AS DOUBLE)) AS HUGEINT) AS VARCHAR), {v})"
    if f.allowed:
        return "CASE " + " ".join(f"WHEN lower({v}) = {q(a.lower())} THEN {q(a)}" for a in f.allowed) + f" ELSE {v} END"
    if f.name in V.NAME_CASE_FIELDS:
        runs = f"list_transform(regexp_extract_all({v}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1:1]) || lower(x[2:]))"
        return f"CASE WHEN lower({v}) <> upper({v}) AND {v} IN (lower({v}), upper({v})) THEN array_to_string({runs}, '') ELSE {v} END"
    return v


def full(v: str, pattern: str) -> str:
    inner = _BLANK[1:-1]
    wide = pattern.replace(r"[\d\s", "[\\d\0").replace(r"\s", _BLANK).replace("\0", inner)
    return f"regexp_matches({v}, {q(wide)}, 'i')"


def rule(f, v: str) -> tuple[str, str]:
    """Message and suggestion of a non-empty value."""
    none = "CAST(NULL AS VARCHAR)"
    if f.kind == "email":
        return f"CASE WHEN NOT {full(v, V.EMAIL_PATTERN)} THEN {q(V.MSG_EMAIL)} END", none
    if f.kind == "date":
        slash = f"regexp_full_match({v}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}')"
        dm, md = f"try_strptime({v}, '%d/%m/%Y')", f"try_strptime({v}, '%m/%d/%Y')"
        msg = (
            f"CASE WHEN {slash} THEN CASE WHEN {dm} IS NOT NULL THEN NULL WHEN {md} IS NOT NULL THEN {q(V.MSG_DATE_US)} "
            f"ELSE {q(V.MSG_DATE_RANGE)} END WHEN {parse(v)} IS NOT NULL THEN {q(V.MSG_DATE_CONVERT)} ELSE {q(V.MSG_DATE_BAD)} END"
        )
        return msg, f"CASE WHEN {slash} THEN {uk(md)} ELSE {uk(parse(v))} END"
    if f.kind == "postcode":
        t = f"replace(upper({v}), ' ', '')"
        laid = f"({t}[:-4] || ' ' || {t}[-3:])"
        good = f"length({t}) >= 5 AND {full(laid, V.POSTCODE_PATTERN)}"
        msg = (
            f"CASE WHEN {good} THEN CASE WHEN {laid} <> {v} THEN {q(V.MSG_POSTCODE_FORMAT)} END "
            f"WHEN NOT {full(v, V.POSTCODE_PATTERN)} THEN {q(V.MSG_POSTCODE)} END"
        )
        return msg, f"CASE WHEN {good} THEN {laid} END"
    if f.kind == "integer":
        i = f"trunc(try_cast({v} AS DOUBLE))"
        arms = f"WHEN {i} IS NULL THEN {q(V.MSG_NUMBER)}"
        if f.lowest is not None:
            arms += f" WHEN {i} < {f.lowest} THEN {q(V.MSG_AT_LEAST.format(limit=f.lowest))}"
        if f.highest is not None:
            arms += f" WHEN {i} > {f.highest} THEN {q(V.MSG_AT_MOST.format(limit=f.highest))}"
        return f"CASE {arms} END", none
    if f.kind == "phone":
        d = f"regexp_replace({v}, '[{_BLANK[1:-1]}\\-()+]', '', 'g')"
        return (
            f"CASE WHEN length({d}) < 10 THEN {q(V.MSG_PHONE_SHORT)} WHEN NOT regexp_full_match({d}, '[0-9]+') THEN {q(V.MSG_PHONE_CHARS)} END",
            none,
        )
    if f.allowed:
        words = V.GENDER_WORDS if f.name == "gender" else {a.lower(): a for a in f.allowed}
        note = V.MSG_GENDER if f.name == "gender" else V.MSG_CASE
        full_word = f"CASE lower({v}) " + " ".join(f"WHEN {q(w)} THEN {q(t)}" for w, t in words.items()) + " END"
        bad = q(V.MSG_ALLOWED.format(allowed=", ".join(f.allowed)))
        msg = f"CASE WHEN {full_word} IS NULL THEN {bad} WHEN {full_word} <> {v} THEN {q(note)} END"
        return msg, full_word
    return none, none


def errors_from(table: str, prefix: str, skip=()) -> str:
    parts = []
    for f in CONTRACT:
        if f.name in skip:
            continue
        v = f"{prefix}{f.name}"
        msg, fix = rule(f, v)
        missing = q(V.MSG_REQUIRED.format(label=f.label)) if f.required else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT k, file, row_idx, {q(f.name)} AS field, {v} AS value, "
            f"CASE WHEN {v} = '' THEN {missing} ELSE {msg} END AS message, CASE WHEN {v} <> '' THEN {fix} END AS fix FROM {table}"
        )
    return (
        "SELECT k, file, row_idx, field, value, message, message IN "
        f"({q(V.MSG_DATE_US)}, {q(V.MSG_DATE_CONVERT)}, {q(V.MSG_POSTCODE_FORMAT)}, {q(V.MSG_GENDER)}, {q(V.MSG_CASE)}) AS auto_fixable, "
        "CASE WHEN auto_fixable THEN fix END AS suggested FROM (" + " UNION ALL ".join(parts) + ") t WHERE message IS NOT NULL"
    )


FIX_TYPE = (
    f"CASE WHEN field = 'date_of_birth' THEN CASE WHEN message LIKE 'US date%' THEN 'us_to_uk_date' ELSE 'date_format' END "
    "WHEN field = 'postcode' THEN 'postcode_format' WHEN field = 'gender' THEN 'gender_abbreviation' ELSE 'case_normalization' END"
)

_MEMBERS = D.members_sql().format(customer="customer", nation="nation")
_KEYS = "(SELECT m.*, first_order FROM m JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) o ON k = o_custkey)"


def _norm_cte(iso_dayfirst: bool = False) -> str:
    stripped = ", ".join(f"trim({n}) AS s_{n}" for n in NAMES)
    normed = ", ".join(f"{norm(f, 's_' + f.name, iso_dayfirst)} AS {f.name}" for f in CONTRACT)
    return f"SELECT k, file, row_idx, {', '.join('s_' + n for n in NAMES)}, {normed} FROM (SELECT k, file, row_idx, {stripped} FROM m) t"


def _patch_cte() -> str:
    single = " UNION ALL ".join(
        f"SELECT file, row_idx, {q(n)} AS field, {q(v)} AS value FROM {_KEYS} t WHERE k % 17 < 8" for n, v in D.PATCH_VALUES.items()
    )
    return single + f" UNION ALL SELECT file, row_idx, 'email', 'fixed' || first_order || '@club.org' FROM {_KEYS} t WHERE k % 17 < 12"


_WORDY = (
    "len(c) > 2 AND NOT regexp_matches(c, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$') AND try_cast(replace(c, ',', '') AS DOUBLE) IS NULL "
    "AND (c LIKE '% %' OR (regexp_matches(c, '[A-Z]') AND NOT regexp_matches(c, '[a-z]')) "
    "OR (regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '(^|[^A-Za-z])[a-z]') AND NOT regexp_matches(c, '[A-Za-z][A-Z]')))"
)
_EXPECT = [h for f in CONTRACT for h in dict.fromkeys((f.header.lower(), f.label.lower()))]
_LIKELY_WORDS = " OR ".join(f"contains(lower(array_to_string(cells, ' ')), {q(w)})" for w in V.SUMMARY_WORDS)
_WHOLE_WORDS = "regexp_matches(lower(array_to_string(cells, ' ')), '\\b(" + "|".join(V.SUMMARY_WORDS) + ")\\b')"


def _header_list() -> str:
    arms = " ".join(f"WHEN {i} THEN {lst(v)}" for i, v in enumerate(D.header_variants()))
    return f"CASE WHEN file_no % 7 = 5 THEN {lst(D.unknown_headers())} ELSE CASE file_no % {len(D.header_variants())} {arms} END END"


def _spelling_rows() -> str:
    rows = []
    for f in CONTRACT:
        for i, s in enumerate((f.header, *f.spellings)):
            rows.append(f"({f.pos}, {q(f.name)}, {i}, {q(s)})")
    return ", ".join(rows)


def _hnorm(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(trim({c}), '\\*+$', '')), '[_\\-\\s]+', ' ', 'g'))"


_FIELD_ROWS = ", ".join(f"({f.pos}, {q(f.name)}, {q(f.header)}, {q(f.label)}, {str(f.required).lower()})" for f in CONTRACT)

CTES: dict[str, str] = {
    "m": _MEMBERS,
    "n": _norm_cte(),
    "n_iso": _norm_cte(True),
    "e": errors_from("n", ""),
    "er": errors_from(f"(SELECT k, file, row_idx, {', '.join(f'trim({n}) AS {n}' for n in NAMES)} FROM m) r", ""),
    "e_skip": errors_from("n", "", V.OVERRIDABLE_FIELDS),
    "d": f"SELECT file, row_idx, unnest(['date_of_birth', 'gender']) AS field, k % 5 = 0 AS accept FROM {_KEYS} t WHERE k % 5 < 2",
    "p": _patch_cte(),
    "s": f"SELECT file, row_idx FROM {_KEYS} t WHERE k % 19 = 0",
    # after fixes, refusals respected
    "fx": "SELECT e.* FROM e LEFT JOIN d USING (file, row_idx, field) WHERE auto_fixable AND coalesce(accept, true)",
    "o": "SELECT e.* FROM e ANTI JOIN fx USING (file, row_idx, field)",
    "pa": "SELECT o.*, p.value AS corrected FROM o JOIN p USING (file, row_idx, field)",
    "left_open": "SELECT o.* FROM o ANTI JOIN pa USING (file, row_idx, field)",
    "v": "SELECT n.k, n.file, n.row_idx, "
    + ", ".join(f"coalesce(p_{x}, f_{x}, n.{x}) AS {x}" for x in NAMES)
    + " FROM n LEFT JOIN (SELECT file, row_idx, "
    + ", ".join(f"max(suggested) FILTER (field = {q(x)}) AS f_{x}" for x in NAMES)
    + " FROM fx GROUP BY ALL) a USING (file, row_idx) LEFT JOIN (SELECT file, row_idx, "
    + ", ".join(f"max(corrected) FILTER (field = {q(x)}) AS p_{x}" for x in NAMES)
    + " FROM pa GROUP BY ALL) b USING (file, row_idx)",
    "cnt": "SELECT file, row_idx, coalesce(nf, 0) AS nf, coalesce(np, 0) AS np, coalesce(nl, 0) AS nl, "
    "CASE WHEN s.file IS NOT NULL THEN 'skipped' WHEN coalesce(nl, 0) = 0 THEN 'valid' ELSE 'quarantine' END AS outcome "
    "FROM n LEFT JOIN (SELECT file, row_idx, count(*) AS nf FROM fx GROUP BY ALL) a USING (file, row_idx) "
    "LEFT JOIN (SELECT file, row_idx, count(*) AS np FROM pa GROUP BY ALL) b USING (file, row_idx) "
    "LEFT JOIN (SELECT file, row_idx, count(*) AS nl FROM left_open GROUP BY ALL) c USING (file, row_idx) LEFT JOIN s USING (file, row_idx)",
    "chg": "SELECT file, row_idx, field, original, corrected FROM ("
    + " UNION ALL ".join(f"SELECT file, row_idx, {q(x)} AS field, s_{x} AS original, {x} AS corrected FROM n" for x in NAMES)
    + ") t WHERE original <> '' AND original <> corrected",
    "log": f"SELECT file, row_idx, {label('field')} AS field, original, corrected, 'normalization' AS type FROM chg "
    f"UNION ALL SELECT file, row_idx, {label('field')}, value, suggested, {FIX_TYPE} FROM fx",
    # files as cells
    "ff": "SELECT file_no, file, count(*) AS n FROM m GROUP BY ALL",
    "cells": "SELECT file, row_idx, [" + ", ".join(NAMES) + "] AS cells FROM m "
    f"UNION ALL SELECT file, i, CASE WHEN t[i + 1] = '' THEN list_resize([]::VARCHAR[], 19, '') ELSE [t[i + 1]] END FROM "
    f"(SELECT file, unnest(range(file_no % 4)) AS i, {lst(D.TOP_ROWS)} AS t FROM ff) a "
    f"UNION ALL SELECT file, file_no % 4, {_header_list()} FROM ff "
    "UNION ALL SELECT file, file_no % 4 + 1 + n, ['Total: ' || n || ' members'] FROM ff WHERE file_no % 3 = 1 "
    "UNION ALL SELECT file, file_no % 4 + 1 + n, list_resize([]::VARCHAR[], 19, '') FROM ff WHERE file_no % 3 = 2 "
    "UNION ALL SELECT file, file_no % 4 + 2 + n, ['Total', CAST(n AS VARCHAR), 'members'] FROM ff WHERE file_no % 3 = 2 "
    "UNION ALL SELECT file, file_no % 4 + 3 + n, ['Continued on sheet 2', '', ''] FROM ff WHERE file_no % 3 = 2",
    "marked": "SELECT file, row_idx, CASE WHEN row_idx % 5 = 0 AND len(cells) = 20 THEN "
    "list_transform(cells, lambda c: CASE WHEN c = 'Vertigo' THEN 'Ver\"tigo' || chr(10) || 'at height' ELSE c END) ELSE cells END AS cells FROM cells",
    "scored_rows": "SELECT file, row_idx, cells, len(list_filter(cells, lambda x: "
    + " OR ".join(
        f"lower(trim(x)) = {q(h)} OR (len(trim(x)) >= 3 AND (contains(lower(trim(x)), {q(h)}) OR contains({q(h)}, lower(trim(x)))))" for h in _EXPECT
    )
    + ")) AS score FROM cells",
    "facts": "SELECT file, row_idx, cells, list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '') AS filled FROM cells",
    "wordy": f"SELECT file, row_idx, len(filled) >= 3 AND len(list_filter(filled[:10], lambda c: {_WORDY})) >= least(3, len(filled) * 0.5) AS ok FROM facts",
    "likely": "SELECT file, row_idx, len(cells) > 0 AND len(filled) >= len(cells) * 0.3 "
    f"AND NOT ({_LIKELY_WORDS}) AND NOT (len(filled) >= 5 AND len(list_filter(filled[:5], lambda c: try_cast(regexp_replace(c, '[,£$]', '', 'g') AS DOUBLE) IS NULL)) = 0 "
    "AND len(list_filter(filled, lambda c: regexp_matches(c, '[a-zA-Z]{2,}') AND NOT regexp_matches(c, '^[0-9]+[/-][0-9]+'))) = 0) AS is_likely FROM facts",
    "b": "SELECT file, coalesce(h1, h2, 0) AS header_idx, greatest(coalesce(li, coalesce(h1, h2, 0)), coalesce(h1, h2, 0)) AS last_idx, end_idx FROM "
    "(SELECT file, min(row_idx) FILTER (score >= 3) AS h1, min(row_idx) FILTER (row_idx < 20 AND ok) AS h2, "
    "max(row_idx) FILTER (is_likely) AS li, max(row_idx) AS end_idx FROM scored_rows JOIN wordy USING (file, row_idx) JOIN likely USING (file, row_idx) GROUP BY file) t",
    "h": "SELECT file, pos - 1 AS pos, trim(cells[pos]) AS header FROM (SELECT file, cells, unnest(range(1, len(cells) + 1)) AS pos "
    "FROM cells JOIN b USING (file) WHERE row_idx = header_idx) t",
    "fields": f"SELECT * FROM (VALUES {_FIELD_ROWS}) t(field_pos, field, fheader, flabel, required)",
    "exact": "SELECT file, field, arg_min(header, tier * 1000 + pos) AS header, min(tier) AS tier, arg_min(pos, tier * 1000 + pos) AS pos FROM ("
    "SELECT file, pos, header, field, CASE WHEN header = fheader THEN 1 WHEN rtrim(header, '*') = flabel THEN 2 ELSE 3 END AS tier "
    "FROM h JOIN fields ON lower(rtrim(header, '*')) = lower(flabel)) t GROUP BY file, field",
    "sp": f"SELECT field_pos, field, i, {_hnorm('s')} AS s FROM (VALUES {_spelling_rows()}) t(field_pos, field, i, s)",
    "pairs": f"SELECT file, pos, header, field_pos, field, i, hn, s, hn = s AS eq, contains(s, hn) OR contains(hn, s) AS part, "
    "least(len(hn), len(s)) / greatest(len(hn), len(s)) * CAST(0.8 AS DOUBLE) AS ratio, "
    "len(list_intersect(string_split(hn, ' '), string_split(s, ' '))) / len(list_distinct(list_concat(string_split(hn, ' '), string_split(s, ' ')))) * CAST(0.6 AS DOUBLE) AS share "
    f"FROM (SELECT *, {_hnorm('header')} AS hn FROM h) a, sp",
    "sc": "SELECT file, pos, header, field_pos, field, CASE WHEN bool_or(eq) THEN 1.0 "
    "WHEN bool_or(part) THEN coalesce(arg_min(ratio, i) FILTER (part), 0) WHEN any_value(hn) = '' THEN 0 ELSE max(share) END::DOUBLE AS score "
    "FROM pairs GROUP BY file, pos, header, field_pos, field",
    "best_all": "SELECT file, header, arg_max(field, score * 1000 - field_pos / 1000) AS field, max(score) AS score FROM sc WHERE header <> '' AND score >= 0.5 GROUP BY file, header",
    "un": "SELECT h.* FROM h ANTI JOIN exact USING (file, header) WHERE header <> ''",
    "scored": "SELECT best_all.* FROM best_all SEMI JOIN un USING (file, header) ANTI JOIN exact USING (file, field)",
    "mp": "SELECT file, header, field, 'exact' AS how, CAST(1.0 AS DOUBLE) AS score FROM exact UNION ALL SELECT file, header, field, 'scored', score FROM scored",
    "found": "SELECT file, field, max(pos) AS pos FROM h JOIN mp USING (file, header) GROUP BY ALL",
    "missing": "SELECT file, field_pos, field, flabel AS label, required FROM (SELECT * FROM (SELECT DISTINCT file FROM h) a CROSS JOIN fields) t ANTI JOIN found USING (file, field)",
    "near": "SELECT file, field, pos, header, greatest(CASE WHEN c = t THEN 100 ELSE len(list_intersect(string_split(c, ' '), string_split(t, ' '))) "
    "/ len(list_distinct(list_concat(string_split(c, ' '), string_split(t, ' ')))) * 50 END, "
    "CASE WHEN contains(c, t) OR contains(t, c) THEN 30 ELSE 0 END, "
    "len(list_intersect(string_split(c, ''), string_split(t, ''))) / len(list_distinct(list_concat(string_split(c, ''), string_split(t, '')))) * 20) AS score "
    "FROM (SELECT file, field, pos, header, lower(header) AS c, lower(label) AS t FROM missing JOIN h USING (file) WHERE required AND header <> '') a",
    "sug": "SELECT file, field, string_agg(header, '|' ORDER BY score DESC, pos) FILTER (rn <= 3 AND score >= 15) AS suggestions FROM "
    "(SELECT *, row_number() OVER (PARTITION BY file, field ORDER BY score DESC, pos) AS rn FROM near) t GROUP BY ALL",
    # ragged rows
    "rg": "SELECT k, file, row_idx, CASE WHEN k % 11 = 0 THEN c[:5] || CASE WHEN k % 2 = 0 THEN ['Pollen', 'latex', 'iodine'] ELSE ['Pollen', 'latex'] END || c[7:] "
    "WHEN k % 13 = 0 THEN c[:19] ELSE c END AS cells FROM (SELECT k, file, row_idx, [" + ", ".join(NAMES) + "] AS c FROM m) t",
    "rx": "SELECT *, len(cells) - 20 AS extra_n, CASE WHEN len(cells) > 20 THEN array_to_string(cells[6:len(cells) - 14], ', ') END AS suggestion FROM rg",
    "rm": "SELECT *, CASE WHEN extra_n > 0 THEN cells[:5] || [suggestion] || cells[7 + extra_n:] END AS merged FROM rx",
    "rj": "SELECT *, extra_n > 0 AND (merged[7] = '' OR regexp_full_match(merged[7], '\\d{1,2}/\\d{1,2}/\\d{4}') OR "
    f"{parse('merged[7]')} IS NOT NULL) AND (merged[8] = '' OR {{adr8}}) AS shape_ok, extra_n > 0 AND (merged[7] = '' OR {{adr7}}) AS parity_ok FROM rm",
}


def address(v: str) -> str:
    return "(" + " OR ".join(full(f"lower(trim({v}))", p) for p in V.ADDRESS_PATTERNS) + ")"


CTES["rj"] = (
    CTES["rj"].replace("{adr8}", address("merged[8]")).replace("{adr7}", address("merged[7]"))
)


# Patched rows with a bad answer for one field, checked again.
CTES["v_bad"] = (
    "SELECT v.* REPLACE (CASE WHEN z.file IS NOT NULL THEN '99' ELSE school_year END AS school_year) FROM v "
    "SEMI JOIN pa USING (file, row_idx) LEFT JOIN (SELECT file, row_idx FROM pa WHERE field = 'school_year') z USING (file, row_idx)"
)
CTES["e_bad"] = errors_from("v_bad", "")

# The whole run: members as the mapping of their file sees them.
_LOST = " OR ".join(f"count(*) FILTER (field = {q(f.name)}) = 0" for f in CONTRACT if f.required and f.name not in V.MISSING_FIELD_DEFAULTS)
_TAKEN = ", ".join(
    f"CASE WHEN p_{n} IS NOT NULL THEN cells[p_{n} + 1] ELSE {q(V.MISSING_FIELD_DEFAULTS.get(n, ''))} END AS {n}" for n in NAMES
)
CTES["usable"] = (
    "SELECT file, " + ", ".join(f"max(pos) FILTER (field = {q(n)}) AS p_{n}" for n in NAMES) + f" FROM found GROUP BY file HAVING NOT ({_LOST})"
)
CTES["am"] = (
    f"SELECT 0 AS k, c.file, c.row_idx, {_TAKEN} FROM cells c JOIN b ON b.file = c.file JOIN usable u ON u.file = c.file "
    "WHERE row_idx > header_idx AND row_idx <= last_idx"
)
_RUN = ["n", "e", "fx", "o", "pa", "left_open", "v", "cnt"]


def _for_run(text: str) -> str:
    names = "|".join(_RUN)
    text = re.sub(rf"\b(FROM|JOIN) ({names})\b", r"\1 run_\2", text)
    text = re.sub(rf"\b({names})\.(?=[a-z*])", r"run_\1.", text)
    return text.replace("FROM m) t", "FROM am) t")


for _name in _RUN:
    CTES[f"run_{_name}"] = _for_run(CTES[_name])


# A run over ragged rows: what the guard or a given text repairs goes on.
CTES["rd"] = (
    "SELECT k, file, row_idx, extra_n, parity_ok, coalesce(given, false) AS given, CASE WHEN extra_n = 0 THEN cells WHEN extra_n > 0 AND parity_ok THEN merged "
    "WHEN extra_n > 0 AND given THEN cells[:5] || ['Asthma, mild'] || cells[7 + extra_n:] END AS c "
    "FROM rj LEFT JOIN (SELECT file, row_idx, true AS given FROM s) g USING (file, row_idx)"
)
CTES["rrm"] = "SELECT k, file, row_idx, " + ", ".join(f"c[{i + 1}] AS {n}" for i, n in enumerate(NAMES)) + " FROM rd WHERE c IS NOT NULL"
for _name in ("n", "e", "chg"):
    _text = re.sub(r"\bFROM (n|e)\b", r"FROM rr_\1", CTES[_name])
    CTES[f"rr_{_name}"] = _text.replace("FROM m) t", "FROM rrm) t")
CTES["rr_fx"] = "SELECT * FROM rr_e WHERE auto_fixable"
CTES["rr_cnt"] = (
    "SELECT rd.file, rd.row_idx, CASE WHEN c IS NULL THEN 'width' WHEN coalesce(nl, 0) = 0 THEN 'valid' ELSE 'quarantine' END AS outcome, "
    "coalesce(nf, 0) + CASE WHEN extra_n > 0 AND given AND NOT parity_ok THEN 1 ELSE 0 END AS nf FROM rd "
    "LEFT JOIN (SELECT file, row_idx, count(*) AS nf FROM rr_fx GROUP BY ALL) a USING (file, row_idx) "
    "LEFT JOIN (SELECT file, row_idx, count(*) AS nl FROM rr_e WHERE NOT auto_fixable GROUP BY ALL) b USING (file, row_idx)"
)


def _uses(text: str, seen: list[str]) -> list[str]:
    """Names of the tables a text needs, each after those it needs itself."""
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+)\b", text))
    for name in CTES:
        if name in words and name not in seen:
            _uses(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _wide_trim(text: str) -> str:
    """Let every ``trim`` cut blanks of all kinds, not spaces alone."""
    out = []
    for m in re.finditer(r"\btrim\(", text):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append((end - 1, f", {q(BLANKS)}"))
    for end, added in sorted(out, reverse=True):
        text = text[:end] + added + text[end:]
    return text


def sql(text: str) -> str:
    names = _uses(text, [])
    return _wide_trim("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + text if names else text)


_ROW_TEXT = "array_to_string(cells, '|') AS row_text"
_E = "file, row_idx, field, value, message, auto_fixable, suggested"
_MISSED = {**V.MISSING_FIELD_DEFAULTS, "postcode": "SW1A 1AA"}
_ADR = ", ".join(f"trim({c}) = '' OR {address(c)} AS {c}" for c in ("address1", "surname", "town_city", "date_of_birth", "email"))
_WIDE20 = "array_to_string(list_resize(cells, 20, ''), '|') AS row_text"
_SORTED_FIELDS = [f.name for f in sorted(CONTRACT, key=lambda f: (not f.required, f.label))]


def _err(where: str, table: str = "er") -> str:
    return f"SELECT {_E} FROM {table} WHERE {where}"


def _decided(policy: str) -> str:
    ok = "coalesce(accept, true)" if policy == "accept" else "coalesce(accept, false)"
    fixed = f"(SELECT e.* FROM e LEFT JOIN d USING (file, row_idx, field) WHERE auto_fixable AND {ok})"
    pick = lambda n: f"coalesce(max(fz.suggested) FILTER (fz.field = {q(n)}), any_value(n.{n})) AS {n}"
    return (
        f"SELECT {q(policy)} AS policy, n.file, n.row_idx, {pick('gender')}, {pick('date_of_birth')}, count(fz.field) AS n_fixes, "
        "any_value(coalesce(ne, 0)) - count(fz.field) AS n_open "
        f"FROM n LEFT JOIN {fixed} fz USING (file, row_idx) LEFT JOIN (SELECT file, row_idx, count(*) AS ne FROM e GROUP BY ALL) z USING (file, row_idx) GROUP BY n.file, n.row_idx"
    )


# The folder of files: six kinds in turn.
_SUFFIX = "['.csv', '.XLSX', '.txt', '.xls', ' head.csv', ' none.csv']"
_NAMED = f"(SELECT file AS member, file_no % 6 AS kind, file[:14] || ({_SUFFIX})[file_no % 6 + 1] AS file FROM ff)"
_UNREAD = "CASE kind WHEN 2 THEN 'Unsupported file format: .txt' WHEN 4 THEN 'No data found' WHEN 5 THEN 'No data found' END"
_UNFILLED = "SELECT DISTINCT file AS member FROM missing WHERE required AND field NOT IN (" + ", ".join(q(x) for x in V.MISSING_FIELD_DEFAULTS) + ")"

QUERIES: dict[str, str] = {
    "scan_ragged": f"SELECT file, len(cells) AS n_cells, {_ROW_TEXT} FROM marked",
    "row_index": f"SELECT file, row_idx, {_ROW_TEXT} FROM marked",
    "scan_xlsx": f"SELECT file, row_idx, {_WIDE20} FROM cells",
    "scan_xls": f"SELECT file, row_idx, {_WIDE20} FROM cells",
    "scan_dispatch": f"SELECT file, ['csv', 'xlsx', NULL, 'xls', 'csv', 'csv'][kind + 1] AS reader, CASE WHEN kind = 2 THEN {_UNREAD} END AS reason FROM {_NAMED} t",
    "scan_folder": f"SELECT t.file, row_idx, array_to_string(CASE WHEN kind = 0 THEN cells ELSE list_resize(cells, 20, '') END, '|') AS row_text "
    f"FROM cells JOIN {_NAMED} t ON cells.file = member WHERE kind IN (0, 1, 3) UNION ALL SELECT file, 0, {q('|'.join(HEADERS))} FROM {_NAMED} t WHERE kind = 4",
    "empty_input": f"SELECT file, {_UNREAD} AS reason FROM {_NAMED} t WHERE {_UNREAD} IS NOT NULL",
    "file_accounting": f"SELECT t.file, {_UNREAD} IS NOT NULL OR u.member IS NOT NULL AS rejected, CASE WHEN {_UNREAD} IS NOT NULL THEN 0 "
    f"WHEN u.member IS NOT NULL THEN n - 1 - (last_idx - header_idx) ELSE n - 1 END AS rows FROM {_NAMED} t LEFT JOIN ({_UNFILLED}) u USING (member) "
    "JOIN b ON b.file = t.member JOIN (SELECT file, count(*) AS n FROM cells GROUP BY file) c ON c.file = t.member",
    "sink_csv": f"SELECT {', '.join(NAMES)} FROM n",
    "sink_by_file": f"SELECT file, {', '.join(NAMES)} FROM n",
    "sink_guard": "SELECT n.file, count(*) FILTER (z.file IS NULL) AS valid_rows, valid_rows = 0 AS refused FROM n "
    "LEFT JOIN (SELECT DISTINCT file, row_idx FROM e) z USING (file, row_idx) GROUP BY n.file",
    "header_score": "SELECT file, row_idx, score FROM scored_rows",
    "is_empty_row": "SELECT file, row_idx, len(filled) = 0 AS is_empty FROM facts",
    "is_likely_data": "SELECT file, row_idx, is_likely FROM likely",
    "summary_keywords": f"SELECT file, row_idx, ({_LIKELY_WORDS}) AS inside, {_WHOLE_WORDS} AS whole_word FROM cells",
    "header_row": "SELECT file, min(row_idx) FILTER (score >= 3) AS named_idx FROM scored_rows GROUP BY file",
    "header_fallback": "SELECT file, min(row_idx) FILTER (ok AND row_idx < 20) AS wordy_idx FROM wordy GROUP BY file",
    "last_data_row": "SELECT file, last_idx FROM b",
    "detect_range": "SELECT * FROM b",
    "trim_rows": "SELECT file, row_idx, row_idx - header_idx - 1 AS data_idx, len(cells) AS n_cells FROM cells JOIN b USING (file) WHERE row_idx > header_idx AND row_idx <= last_idx",
    "trim_decision": "SELECT file, CASE WHEN even THEN 0 ELSE header_idx END AS header_idx, CASE WHEN even THEN end_idx ELSE last_idx END AS last_idx, end_idx "
    "FROM (SELECT *, CAST(file[9:14] AS INT) % 2 = 0 AS even FROM b) t",
    "trim_preview": "SELECT file, side, row_idx + 1 AS row_no, CASE WHEN len(l) > 70 THEN l[:67] || '...' ELSE l END AS preview FROM (SELECT file, row_idx, "
    "CASE WHEN row_idx < header_idx THEN 'top' ELSE 'bottom' END AS side, "
    "array_to_string(list_transform(list_filter(cells[:5], lambda c: c <> ''), lambda c: c[:20]), ' | ') AS l FROM cells JOIN b USING (file) "
    "WHERE row_idx < least(header_idx, 5) OR (row_idx > last_idx AND row_idx > end_idx - 5)) t",
    "trim_counts": "SELECT file, header_idx AS cut_top, end_idx - last_idx AS cut_bottom, last_idx - header_idx + 1 AS kept FROM b",
    "header_norm": f"SELECT file, pos, header, {_hnorm('header')} AS norm FROM h",
    "match_exact": "SELECT file, field, header, CAST(tier AS BIGINT) AS tier, pos FROM exact",
    "match_score": "SELECT file, pos, header, field, score FROM sc",
    "match_best": "SELECT file, header, field, score FROM best_all",
    "match_unmatched": "SELECT file, pos, header FROM un",
    "match_conflict": "SELECT file, header, field, score FROM scored",
    "match_decision": "SELECT file, header, field, score FROM scored WHERE CAST(file[9:14] AS INT) % 2 = 0",
    "match_manual": "SELECT file, header, field FROM (SELECT DISTINCT file, header, CASE header WHEN 'Student First Name' THEN 'first_name' WHEN 'Health Notes' THEN 'classified_as_disabled' "
    "WHEN 'Notes' THEN 'gender' WHEN 'Column B' THEN 'first_name' END AS field FROM h) t ANTI JOIN mp USING (file, header) ANTI JOIN mp USING (file, field) WHERE field IS NOT NULL",
    "match_manual_choices": f"SELECT DISTINCT file, header, array_to_string(list_filter({lst(_SORTED_FIELDS)}, lambda x: NOT list_contains(coalesce(taken, []), x)), ',') AS choices "
    "FROM h ANTI JOIN mp USING (file, header) LEFT JOIN (SELECT file, list(DISTINCT field) AS taken FROM mp GROUP BY file) t USING (file) WHERE header <> ''",
    "missing_mandatory": "SELECT file, field, label FROM missing WHERE required",
    "missing_optional": "SELECT file, field, label FROM missing WHERE NOT required",
    "missing_default": "SELECT a.file, arg_min(label, field_pos) FILTER (required AND field NOT IN (" + ", ".join(q(x) for x in _MISSED) + ")) AS unfilled, "
    "coalesce(string_agg(field, ',' ORDER BY field_pos) FILTER (field IN (" + ", ".join(q(x) for x in _MISSED) + ")), '') AS defaulted "
    "FROM (SELECT DISTINCT file FROM h) a LEFT JOIN missing USING (file) GROUP BY a.file",
    "suggest_headers": "SELECT file, field, coalesce(suggestions, '') AS suggestions FROM sug",
    "apply_mapping": "SELECT c.file, c.row_idx, " + ", ".join(f"CASE WHEN p_{n} IS NOT NULL THEN cells[p_{n} + 1] END AS {n}" for n in NAMES)
    + " FROM cells c JOIN b USING (file) LEFT JOIN (SELECT file, " + ", ".join(f"max(pos) FILTER (field = {q(n)}) AS p_{n}" for n in NAMES)
    + " FROM found GROUP BY file) f ON f.file = c.file WHERE row_idx > header_idx AND row_idx <= last_idx",
    "check_width": "SELECT file, row_idx, CAST(20 AS BIGINT) AS expected_n, len(cells) AS actual_n, extra_n FROM rx WHERE extra_n <> 0",
    "repair_commas": f"SELECT file, row_idx, array_to_string(CASE WHEN extra_n > 0 THEN merged ELSE cells END, '|') AS row_text, extra_n > 0 AS repaired FROM rj WHERE extra_n = 0 OR shape_ok",
    "looks_like_address": f"SELECT k, {_ADR} FROM m",
    "repair_guard": "SELECT file, row_idx, shape_ok AS ok, 'shape' AS guard FROM rj WHERE extra_n > 0 UNION ALL SELECT file, row_idx, parity_ok, 'parity' FROM rj WHERE extra_n > 0",
    "repair_quarantine": f"SELECT file, row_idx, CASE WHEN extra_n < 0 THEN 'too_few' ELSE 'unsafe_merge' END AS reason, suggestion, {_ROW_TEXT} FROM rj WHERE extra_n < 0 OR (extra_n > 0 AND NOT shape_ok)",
    "repair_patch": "SELECT file, row_idx, CASE WHEN parity_ok THEN 'guard' ELSE 'patch' END AS repaired_by, "
    "array_to_string(CASE WHEN parity_ok THEN merged ELSE cells[:5] || ['Asthma, mild'] || cells[7 + extra_n:] END, '|') AS row_text "
    "FROM rj LEFT JOIN (SELECT file, row_idx, true AS given FROM s) g USING (file, row_idx) WHERE extra_n > 0 AND (parity_ok OR given)",
    "repair_count": "SELECT file, count(*) FILTER (shape_ok) AS comma_repairs FROM rj GROUP BY file",
    "norm_row": f"SELECT k, {', '.join(NAMES)} FROM n",
    "norm_name_case": "SELECT k, first_name, surname FROM n",
    "norm_enum_case": "SELECT k, gender, classified_as_disabled FROM n",
    "norm_email": "SELECT k, email FROM n",
    "norm_postcode": "SELECT k, postcode FROM n",
    "norm_phone": "SELECT k, phone_number, emergency_contact_phone, emergency_contact_phone2 FROM n",
    "norm_date": "SELECT k, date_of_birth FROM n",
    "norm_date_iso_dayfirst": "SELECT k, date_of_birth FROM n_iso",
    "norm_integer": "SELECT k, school_year, course_id FROM n",
    "norm_string": "SELECT c_custkey, c_name AS padded, CASE WHEN c_custkey % 2 = 0 THEN CAST(floor(c_acctbal) + 0.5 AS VARCHAR) ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS number, "
    "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS absent FROM customer",
    "norm_date_serial": "SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(o_custkey * 7 AS INT), '%d/%m/%Y') AS date_of_birth FROM orders",
    "norm_date_object": "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_of_birth FROM orders",
    "val_dispatch": f"SELECT {_E} FROM er",
    "val_row": f"SELECT {_E} FROM e",
    "val_email": _err("field = 'email'"),
    "val_postcode": _err("field = 'postcode'"),
    "val_integer": _err("field IN ('school_year', 'course_id')"),
    "val_phone": _err("field IN ('phone_number', 'emergency_contact_phone', 'emergency_contact_phone2')"),
    "val_enum": _err("field = 'classified_as_disabled'"),
    "val_gender": _err("field = 'gender'"),
    "val_date_uk": _err(f"message IN ({q(V.MSG_DATE_US)}, {q(V.MSG_DATE_RANGE)})"),
    "val_date_convert": _err(f"message = {q(V.MSG_DATE_CONVERT)}"),
    "val_date_bad": _err(f"message = {q(V.MSG_DATE_BAD)}"),
    "val_required": _err("message LIKE '% is required'"),
    "val_pattern": f"SELECT k, {full('postcode', V.POSTCODE_PATTERN)} AS postcode_ok, {full('email', V.EMAIL_PATTERN)} AS email_ok, {full('phone_number', V.PHONE_PATTERN)} AS phone_ok FROM m",
    "row_flags": "SELECT n.file, n.row_idx, count(e.field) = 0 AS is_valid, coalesce(bool_or(e.auto_fixable), false) AS has_auto_fixable, "
    "coalesce(bool_or(NOT e.auto_fixable), false) AS has_manual FROM n LEFT JOIN e USING (file, row_idx) GROUP BY n.file, n.row_idx",
    "row_label": "SELECT file, row_idx, CASE WHEN first_name || surname = '' THEN 'Row ' || (row_idx + 1) ELSE trim(first_name || ' ' || surname) END AS row_label FROM n",
    "field_label": f"SELECT file, row_idx, field, {label('field')} AS label, {label('field')} AS by_pos FROM e",
    "val_skip_fields": f"SELECT {_E} FROM e_skip",
    "split_pending": "SELECT file, ne > 0 AS pending, count(*) AS n, CAST(sum(ne) AS BIGINT) AS n_errors FROM (SELECT n.file, n.row_idx, count(e.field) AS ne FROM n LEFT JOIN e USING (file, row_idx) GROUP BY ALL) t GROUP BY ALL",
    "fix_auto": "SELECT n.file, n.row_idx, " + ", ".join(
        f"coalesce(max(e.suggested) FILTER (e.field = {q(f.name)}), any_value(n.{f.name})) AS {f.name}" for f in CONTRACT if f.can_suggest
    ) + " FROM n LEFT JOIN e USING (file, row_idx) GROUP BY n.file, n.row_idx",
    "fix_type": f"SELECT file, row_idx, field, value, suggested, {FIX_TYPE} AS type FROM er WHERE auto_fixable",
    "fix_policy": _decided("accept") + " UNION ALL " + _decided("review"),
    "fix_manual": f"SELECT file, row_idx, {', '.join(NAMES)}, np AS n_patched, nl AS n_open FROM v JOIN cnt USING (file, row_idx)",
    "fix_manual_revalidate": "SELECT file, row_idx, field, value, message FROM e_bad UNION ALL SELECT file, row_idx, field, value, message FROM left_open ANTI JOIN pa USING (file, row_idx)",
    "full_run": f"SELECT file, row_idx, {', '.join(NAMES)} FROM run_v JOIN run_cnt USING (file, row_idx) WHERE outcome = 'valid'",
    "row_skip": "SELECT file, outcome, count(*) AS n FROM cnt GROUP BY ALL",
    "skip_filter": "SELECT n.file, n.row_idx, k FROM n ANTI JOIN s USING (file, row_idx)",
    "default_fill": "SELECT file, row_idx, CASE WHEN postcode = '' THEN 'SW1A 1AA' ELSE postcode END AS postcode, CASE WHEN email = '' THEN 'office@club.org' ELSE email END AS email, "
    "CASE WHEN classified_as_disabled = '' THEN 'No' ELSE classified_as_disabled END AS classified_as_disabled FROM n",
    "default_override": "SELECT file, row_idx, surname, 'SW1A 1AA' AS postcode, 'office@club.org' AS email FROM v JOIN cnt USING (file, row_idx) WHERE outcome = 'valid'",
    "override_check": f"SELECT k, CASE WHEN pok THEN pc END AS postcode, CASE WHEN eok THEN em END AS email, pok OR pc = '' AS postcode_ok, eok OR em = '' AS email_ok "
    f"FROM (SELECT k, pc, em, {full('pc', V.POSTCODE_PATTERN)} AS pok, {full('em', V.EMAIL_PATTERN)} AS eok FROM (SELECT k, CASE WHEN contains(upper(trim(postcode)), ' ') OR len(trim(postcode)) < 5 "
    "THEN upper(trim(postcode)) ELSE upper(trim(postcode))[:-4] || ' ' || upper(trim(postcode))[-3:] END AS pc, lower(trim(email)) AS em FROM m) a) t",
    "corrections_log": "SELECT * FROM log",
    "stats_total": "SELECT count(*) AS total FROM log",
    "stats_by_type": "SELECT type, count(*) AS n FROM log GROUP BY type",
    "stats_by_field": "SELECT field, count(*) AS n FROM log GROUP BY field",
    "stats_all": "SELECT type, field, count(*) AS n FROM log GROUP BY GROUPING SETS ((type), (field), ())",
    "error_stats": "SELECT field, message, auto_fixable, count(*) AS n FROM e GROUP BY ALL",
    "summary": "SELECT (SELECT count(*) FROM n) AS rows, (SELECT count(*) FROM cnt WHERE outcome = 'skipped') AS skipped, (SELECT count(*) FROM log) AS automatic, CAST(0 AS BIGINT) AS comma_repairs, (SELECT count(*) FROM pa) AS manual",
    "skipped_list": "SELECT file, row_idx + 2 AS sheet_row FROM cnt WHERE outcome = 'skipped'",
    "log_sorted": f"SELECT file, row_idx, {POS.format(c='name')} AS field_pos, field, original, corrected, type FROM (SELECT *, "
    "CASE field " + " ".join(f"WHEN {q(f.label)} THEN {q(f.name)}" for f in CONTRACT) + " END AS name FROM log) t",
    "manual_log_sorted": f"SELECT file, row_idx, {POS.format(c='field')} AS field_pos, {label('field')} AS field, value AS original, corrected, 'manual' AS type FROM pa",
    "review_topk": f"SELECT type, file, row_idx, field, original, corrected, place, type_total, greatest(type_total - 10, 0) AS more FROM (SELECT *, count(*) OVER (PARTITION BY type) AS type_total, "
    "row_number() OVER (PARTITION BY type ORDER BY file, row_idx, field_pos) AS place FROM "
    f"(SELECT file, row_idx, {POS.format(c='field')} AS field_pos, {label('field')} AS field, value AS original, suggested AS corrected, {FIX_TYPE} AS type FROM fx) a) t WHERE place <= 10",
    "changes_union": f"SELECT origin, field, count(*) AS n FROM (SELECT 'automatic' AS origin, {label('field')} AS field FROM fx UNION ALL SELECT 'manual', {label('field')} FROM pa) t GROUP BY ALL",
    "mapping_report": f"SELECT file, header, {label('field')} AS maps_to, coalesce(how, 'unmapped') AS how, CASE WHEN score IS NOT NULL THEN printf('%.0f%%', score * 100) END AS confidence "
    "FROM (SELECT DISTINCT file, header FROM h WHERE header <> '') a LEFT JOIN mp USING (file, header)",
    "missing_report": "SELECT sug.file, label, coalesce(replace(suggestions, '|', ', '), '') AS suggestions, headers AS found FROM sug JOIN missing USING (file, field) "
    "JOIN (SELECT file, string_agg(header, ', ' ORDER BY pos) AS headers FROM h WHERE header <> '' GROUP BY file) t USING (file)",
    "export_decision": "SELECT file, rows, valid_rows, bad_rows, total_changes, CASE WHEN valid_rows = 0 THEN 'no valid rows' WHEN bad_rows / rows > 0.5 THEN 'too many errors' ELSE 'export' END AS decision FROM "
    "(SELECT file, count(*) AS rows, count(*) FILTER (outcome = 'valid') AS valid_rows, count(*) FILTER (outcome = 'quarantine') AS bad_rows, CAST(sum(nf + np) AS BIGINT) AS total_changes FROM cnt GROUP BY file) t",
}

QUERIES["second_run"] = QUERIES["full_run"]
QUERIES["row_accounting"] = "SELECT file, count(*) AS rows FROM cells GROUP BY file"
QUERIES["summary_ragged"] = (
    "SELECT (SELECT count(*) FROM rd) AS rows, (SELECT count(*) FROM rd WHERE c IS NULL) AS skipped, "
    "(SELECT count(*) FROM rr_chg) + (SELECT count(*) FROM rr_fx) AS automatic, "
    "(SELECT count(*) FROM rd WHERE extra_n > 0 AND c IS NOT NULL) AS comma_repairs, "
    "(SELECT count(*) FROM rd WHERE extra_n > 0 AND given AND NOT parity_ok) AS manual"
)
QUERIES["export_decision_ragged"] = (
    "SELECT file, rows, valid_rows, bad_rows, total_changes, CASE WHEN valid_rows = 0 THEN 'no valid rows' WHEN bad_rows / rows > 0.8 THEN 'too many errors' "
    "ELSE 'export' END AS decision FROM (SELECT file, count(*) AS rows, count(*) FILTER (outcome = 'valid') AS valid_rows, "
    "count(*) FILTER (outcome IN ('quarantine', 'width')) AS bad_rows, CAST(sum(nf) AS BIGINT) AS total_changes FROM rr_cnt GROUP BY file) t"
)

# The same error counts over one member per order line.
_LINES = D.members_sql().format(
    customer="(SELECT l_orderkey * 8 + l_linenumber AS c_custkey, 'Part#' || l_partkey AS c_name, CAST(l_suppkey % 25 AS INT) AS c_nationkey, l_returnflag AS c_mktsegment FROM lineitem) l",
    nation="nation",
)


def oracle_sql() -> dict[str, str]:
    out = {name: sql(text) for name, text in QUERIES.items()}
    lines = sql("SELECT field, message, auto_fixable, count(*) AS n FROM e GROUP BY ALL")
    out["members_by_line"] = lines.replace(_MEMBERS, _LINES)
    return out
