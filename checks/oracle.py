"""DuckDB statements that answer the same questions with plain SQL."""

from __future__ import annotations

from dataclasses import replace

from checks import inputs as I
from spanveil import fixed_values as V
from spanveil.operators.gazetteer import WORD
from spanveil.operators.policy import Policy
from spanveil.operators.rules import Rule

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NON_BLANK = (
    r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(source: str, keys: str, text: str = "text", regex: str = LINE_BREAK,
          drop_last: bool = True, skip_blank: bool = True) -> str:
    pieces = f"string_split_regex({text}, {q(regex)})"
    kept = f"CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END" if drop_last else "p"
    rows = (
        f"SELECT {keys}, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM "
        f"(SELECT {keys}, {kept} AS p FROM (SELECT {keys}, {pieces} AS p FROM ({source})))"
    )
    if skip_blank:
        rows = f"SELECT * FROM ({rows}) WHERE regexp_matches(line, {q(NON_BLANK)})"
    return rows


_DIGITS = "regexp_replace(\"match\", '[^0-9]', '', 'g')"
_MOVED = (
    "(substr(replace(\"match\", ' ', ''), 5) || substr(replace(\"match\", ' ', ''), 1, 4))"
)
_CODE = "(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ch) - 1)"
CHECKS = {
    "luhn": (
        f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) "
        f"ELSE CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) > 4 "
        f"THEN CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) * 2 - 9 "
        f"ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) * 2 END END)) % 10 = 0"
    ),
    "ssn": "NOT regexp_matches(\"match\", '^(?:000|666|9)|-00-|-0000$')",
    "aba": (
        "list_sum(list_transform(range(1, 10), lambda i: CAST(substr(\"match\", i, 1) AS BIGINT)"
        " * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0"
    ),
    "calendar_date": (
        "CASE WHEN contains(\"match\", '/') THEN try_strptime(\"match\", '%m/%d/%Y') "
        "ELSE try_strptime(substr(\"match\", 1, 10), '%Y-%m-%d') END IS NOT NULL"
    ),
    "url_host": "regexp_matches(\"match\", '^https?://([^/?#@]*@)?[A-Za-z0-9]')",
}
# Digits of an IBAN do not fit one number; the remainder is taken digit by digit.
CHECKS["iban"] = (
    "list_reduce(list_transform(string_split(list_aggregate(list_transform("
    f"string_split({_MOVED}, ''), lambda ch: CAST({_CODE} AS VARCHAR)), 'string_agg', ''), ''), "
    "lambda x: CAST(x AS BIGINT)), lambda a, x: (a * 10 + x) % 97) = 1"
)


def matches(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {q('(?s)' + regex)})"


def findings(source: str, keys: str, rules: list[Rule], text: str) -> str:
    """keys, entity, score, rule, match, start, end for every rule over ``source``."""
    parts = []
    for rule in rules:
        value, prefix = rule.value_regex(), rule.prefix_regex()
        gap = q(f"(?s)(.*?{prefix})({value})")
        where = matches(text, prefix + value)
        if rule.lang:
            where += f" AND lang = {q(rule.lang)}"
        inner = (
            f"SELECT {keys}, regexp_extract_all({text}, {gap}, 2) AS hits, "
            f"list_transform(regexp_extract_all({text}, {gap}, 0), lambda x: length(x)) AS steps "
            f"FROM ({source}) WHERE {where}"
        )
        rows = (
            f"SELECT {keys}, {q(rule.entity)} AS entity, CAST({rule.score} AS DOUBLE) AS score, "
            f"{q(rule.name)} AS rule, unnest(hits) AS \"match\", "
            "unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(steps[1:i]))) "
            f"AS \"end\" FROM ({inner})"
        )
        if rule.validator:
            rows = f"SELECT * FROM ({rows}) WHERE {CHECKS[rule.validator]}"
        parts.append(rows)
    return (
        "SELECT *, CAST(\"end\" - length(\"match\") AS BIGINT) AS \"start\", "
        "CAST(trunc(score * 100) AS BIGINT) AS confidence FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


def line_findings(source: str, rules: list[Rule], keys: str = "doc_id", text: str = "text") -> str:
    rules = [replace(rule, pattern=rule.line_pattern) if rule.multiline else rule for rule in rules]
    return findings(lines(source, keys, text), f"{keys}, line_no", rules, "line")


FINDING = (
    'line_no, entity, "start", CAST("end" AS BIGINT) AS "end", score, confidence, "match", rule'
)


def islands(found: str, key: str = "doc_id") -> str:
    """Unions of overlapping spans with the label of the best one."""
    return f"""
    SELECT {key}, min("start") AS "start", max("end") AS "end",
      first(entity ORDER BY score DESC, "end" - "start" DESC, "start", entity) AS entity,
      max(score) AS score
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY "start", "end", entity
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY {key}
                  ORDER BY "start", "end", entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                THEN 0 ELSE 1 END AS fresh FROM ({found})))
    GROUP BY {key}, island"""


def redacted(source: str, rules: list[Rule], render: str = "'<' || entity || '>'",
             key: str = "doc_id") -> str:
    """key, text, redacted, span_count, line_numbers (joined), redacted_text."""
    found = findings(f"SELECT {key}, text FROM ({source}) s0", key, rules, "text")
    return f"""
    WITH src AS ({source}), found AS ({found}), isl AS ({islands('SELECT * FROM found', key)}),
    pieces AS (
      SELECT s.{key}, s.text, i."start", i."end", i.entity,
        substr(s.text, CAST(i."start" + 1 AS BIGINT), CAST(i."end" - i."start" AS BIGINT)) AS hit,
        lag(i."end", 1, 0) OVER (PARTITION BY s.{key} ORDER BY i."start") AS before
      FROM isl i JOIN src s USING ({key})),
    joined AS (
      SELECT {key}, string_agg(substr(text, CAST(before + 1 AS BIGINT),
          CAST("start" - before AS BIGINT)) || {render}, '' ORDER BY "start")
        || substr(any_value(text), CAST(max("end") + 1 AS BIGINT)) AS redacted_text
      FROM pieces GROUP BY {key}),
    marks AS (
      SELECT {key}, count(*) AS span_count,
        list_sort(list(DISTINCT line_no)) AS line_list
      FROM (SELECT f.{key}, length(substr(s.text, 1, f."start"))
              - length(replace(substr(s.text, 1, f."start"), chr(10), '')) + 1 AS line_no
            FROM found f JOIN src s USING ({key})) GROUP BY {key})
    SELECT s.*, j.redacted_text IS NOT NULL AS redacted,
      coalesce(m.span_count, 0) AS span_count,
      coalesce(array_to_string(m.line_list, ','), '') AS line_numbers,
      coalesce(j.redacted_text, s.text) AS redacted_text
    FROM src s LEFT JOIN joined j USING ({key}) LEFT JOIN marks m USING ({key})"""


def default_rules(rules: list[Rule], inclusive: bool = False) -> list[Rule]:
    return Policy().choose(rules, inclusive)


LABELS = "(VALUES " + ", ".join(
    f"({q(k)}, {q(a)}, {q(b)})" for k, (a, b) in V.DETECTOR_LABELS.items()
) + ") AS labels_table(entity, label, description)"

PII_DEFAULTS = "(VALUES " + ", ".join(
    f"('pii', {q(k)}, {q(k)}, {str(v).lower()})" for k, v in V.PII_DEFAULTS.items()
) + ", " + ", ".join(
    f"('credential', {q(k)}, {q(V.CREDENTIALS[k][0])}, {str(v).lower()})"
    for k, v in V.CREDENTIAL_DEFAULTS.items()
) + ") AS defaults_table(category, name, entity, enabled)"


def policy_rows(source: str, key: str) -> str:
    """Saved switches over defaults, unknown saved ones kept."""
    def saved(category: str, part: str) -> str:
        return (
            f"SELECT {key}, '{category}' AS category, unnest(json_keys(settings, '$.{part}')) AS name, "
            f"settings FROM ok WHERE json_type(settings, '$.{part}') = 'OBJECT'"
        )

    return f"""
    WITH src AS ({source}),
    ok AS (SELECT * FROM src WHERE json_valid(settings) AND settings LIKE '{{%'),
    saved AS (
      SELECT {key}, category, name, CAST(json_extract(settings,
        '$.' || CASE category WHEN 'pii' THEN 'entities' ELSE 'credential_types' END || '."'
        || name || '"') AS VARCHAR) = 'true' AS enabled
      FROM ({saved('pii', 'entities')} UNION ALL {saved('credential', 'credential_types')})),
    base AS (SELECT {key}, category, name, entity, enabled FROM src CROSS JOIN {PII_DEFAULTS})
    SELECT coalesce(s.{key}, b.{key}) AS {key}, coalesce(s.category, b.category) AS category,
      coalesce(s.name, b.name) AS name,
      coalesce(b.entity, CASE WHEN s.category = 'pii' THEN s.name END) AS entity,
      coalesce(s.enabled, b.enabled) AS enabled
    FROM base b FULL JOIN saved s
      ON s.{key} = b.{key} AND s.category = b.category AND s.name = b.name"""


def terms_in_lines(source: str, dictionary: str, keys: str = "doc_id") -> str:
    """Runs of 1..3 words that are in the dictionary, those inside a longer one dropped."""
    gap = q(f"(?s)(.*?)({WORD})")
    return f"""
    WITH ln AS ({lines(source, keys)}),
    tok AS (SELECT {keys}, line_no, line, regexp_extract_all(line, {gap}, 2) AS w,
              list_transform(regexp_extract_all(line, {gap}, 0), lambda x: length(x)) AS steps
            FROM ln),
    pos AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tok),
    run AS (SELECT *, unnest(range(1, 4)) AS n FROM pos),
    cand AS (SELECT {keys}, line_no, line, lower(array_to_string(w[i:i + n - 1], ' ')) AS term,
        list_sum(steps[1:i]) - length(w[i]) AS "start", list_sum(steps[1:i + n - 1]) AS "end"
      FROM run WHERE i + n - 1 <= len(w)),
    dict AS (
      SELECT lower(array_to_string(regexp_extract_all(term, {q(WORD)}), ' ')) AS term, entity,
        max(score) AS score FROM ({dictionary}) GROUP BY ALL),
    hit AS (SELECT c.{keys}, line_no, line, entity, score, "start", "end"
            FROM cand c JOIN dict d USING (term))
    SELECT {keys}, line_no, entity, CAST("start" AS BIGINT) AS "start",
      CAST("end" AS BIGINT) AS "end", score, CAST(trunc(score * 100) AS BIGINT) AS confidence,
      substr(line, CAST("start" + 1 AS BIGINT), CAST("end" - "start" AS BIGINT)) AS "match"
    FROM hit a WHERE NOT EXISTS (
      SELECT 1 FROM hit b WHERE b.{keys} = a.{keys} AND b.line_no = a.line_no
        AND b."start" <= a."start" AND b."end" >= a."end"
        AND b."end" - b."start" > a."end" - a."start")"""
