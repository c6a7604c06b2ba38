"""Input tables for the checked queries, as SQL both engines read alike.

The given texts hold few kinds of sensitive text, so every text gets one more line per
kind, made from a digest of its key.  The values differ from row to row and some fail
their check digits, so validators have both outcomes to decide.
"""

_M = "md5(cast(doc_id as string))"
_D = f"translate({_M}, 'abcdef', '012345')"
_NL = "chr(10)"


def _digest(length: int) -> str:
    return f"substr(concat({_M}, {_M}, {_M}), 1, {length})"


def _d(start: int, length: int) -> str:
    return f"substr({_D}, {start}, {length})"


CREDENTIAL_LINES = [
    f"'one sk-', {_digest(48)}",
    f"'two sk-proj-', {_digest(20)}",
    f"'three sk-ant-api03-', {_digest(95)}, '.'",
    f"'four hf_', {_digest(34)}",
    f"'five ghp_', {_digest(40)}",
    f"'six AIza', {_digest(35)}",
    f"'seven ya29.', {_digest(30)}",
    f"'eight AKIA', upper({_digest(16)})",
    f"'nine sk_live_', {_digest(24)}, ' rk_test_', {_digest(24)}",
    f"'ten xoxb-', {_digest(24)}",
    f"'eleven mongodb://user:', {_digest(12)}, '@db.example.com:27017/admin'",
    f"'twelve ey', {_digest(34)}, '.', {_digest(40)}, '.', {_digest(43)}",
]

PERSONAL_LINES = [
    f"'mail user.', {_digest(6)}, '@example.org,x@y.co'",
    f"'call (', {_d(1, 3)}, ') ', {_d(4, 3)}, '-', {_d(7, 4)}, ' or +44 20 ', {_d(1, 4)}, ' ', {_d(5, 4)}",
    f"'ssn ', {_d(1, 3)}, '-', {_d(4, 2)}, '-', {_d(6, 4)}",
    f"'card ', {_d(1, 4)}, ' ', {_d(5, 4)}, ' ', {_d(9, 4)}, ' ', {_d(13, 4)}",
    f"'amex ', {_d(1, 4)}, '-', {_d(5, 6)}, '-', {_d(11, 5)}",
    f"'iban DE', {_d(1, 20)}",
    f"'iban GB', {_d(1, 2)}, ' WEST ', {_d(3, 4)}, ' ', {_d(7, 4)}, ' ', {_d(11, 4)}, ' ', {_d(15, 2)}",
    f"'on 2024-0', {_d(1, 1)}, '-1', {_d(2, 1)}, ' or 1/', {_d(3, 2)}, '/2023 or 20', {_d(1, 2)}, '-12-24T10:00'",
    f"'see https://u@h', {_digest(5)}, '.example.com:8080/p?q=', {_digest(4)}, ').'",
    f"'from 10.', {_d(1, 2)}, '.0.', {_d(3, 3)}, ' and 2001:db8::', {_digest(4)}",
]

EXTRA_LINES = [
    f"'Authorization: Bearer ', {_digest(32)}, '=='",
    f"'db postgresql://user:', {_digest(8)}, '@localhost:5432/mydb'",
    f"'API_KEY = \"', {_digest(12)}, '\" done'",
    f"'mac ', substr({_M},1,2), ':', substr({_M},3,2), ':', substr({_M},5,2), ':', "
    f"substr({_M},7,2), ':', substr({_M},9,2), ':', substr({_M},11,2)",
    f"'Routing number: ', {_d(1, 9)}, ' account: ', {_d(1, 10)}",
    f"'-----BEGIN RSA PRIVATE KEY-----', {_NL}, {_digest(60)}, {_NL}, "
    "'-----END RSA PRIVATE KEY-----'",
]


def _added(lines: list[str]) -> str:
    return ", ".join(f"{_NL}, {line}" for line in lines)


# documents with one line per kind of sensitive text
RICH = (
    "select doc_id, source, lang, concat(text, "
    f"{_added(CREDENTIAL_LINES + PERSONAL_LINES + EXTRA_LINES)}) as text from documents"
)

# documents whose breaks are of many kinds, with a trailing one
BREAKS = (
    "select doc_id, concat(replace(replace(replace(text, ', ', ' '), '. ', "
    "concat(chr(13), chr(10))), ' de ', chr(28)), chr(10)) as text from documents"
)

# conversations with blank lines of several kinds between lines
GAPS = (
    "select conv_id, turn, concat(replace(text, chr(10), concat(chr(10), ' ', chr(31), "
    "' ', chr(10), chr(10))), chr(10)) as text from conversations"
)

# pages with Windows and old Mac breaks
MIXED_PAGES = (
    "select page_id, replace(replace(html, '><', concat('>', chr(13), chr(10), '<')), "
    "'. ', concat('.', chr(13))) as html from pages"
)

# one settings text per customer: readable, partial, wrong type, or not JSON
SETTINGS = """
select c_custkey as tenant, case c_mktsegment
  when 'BUILDING' then 'not json'
  when 'MACHINERY' then '[1, 2]'
  when 'HOUSEHOLD' then '{"history_limit": 0, "confidence_threshold": 0.75}'
  else concat('{"entities": {"EMAIL_ADDRESS": ', case when c_acctbal > 4000 then 'true' else 'false' end,
    ', "URL": ', case when c_acctbal > 6000 then 'true' else 'false' end,
    ', "BADGE": true}, "credential_types": {"Slack token": ',
    case when c_acctbal > 2000 then 'false' else 'true' end,
    ', "Unknown key": true}, "language": "de", "keep_history": false, "history_limit": ',
    cast(c_nationkey as string), '}')
  end as settings from customer
"""

# one settings text per document source, for tenants that are sources
SOURCE_SETTINGS = """
select source, case when max(doc_id) > 2 * max(length(source)) and max(lang) = 'fr'
  then '{"entities": {"EMAIL_ADDRESS": false, "IP_ADDRESS": true}, "credential_types": {"OpenAI API key": false}}'
  when source > 'src14' then '{"entities": {"DATE_TIME": true, "US_SSN": false}}'
  else '{"credential_types": {"Slack token": false, "Google API key": false}}' end as settings
from documents group by source
"""

# one history text per user: a JSON list, now and then something else
HISTORY_ELEMENT = """
case event_type
  when 'view' then concat('{"id": " r', cast(event_id as string), ' ", "kind": "redaction", "source": "s", "timestamp": "2024-01-0', substr(cast(event_id as string), 1, 1), '", "line_numbers": [3, "2", -1, "x", null, 3, 2.5], "original_text": "a', cast(user_id as string), '", "redacted_text": "b"}')
  when 'click' then concat('{"id": "', cast(event_id as string), '", "original_text": 5, "redacted_text": "b"}')
  when 'error' then '{"id": "  ", "original_text": "a", "redacted_text": "b"}'
  when 'signup' then cast(event_id as string)
  else concat('{"id": "p', cast(event_id as string), '", "original_text": "a", "redacted_text": null}')
end
"""

# pointers of many shapes, one per customer
POINTERS = """
select c_custkey as owner, case c_mktsegment
  when 'BUILDING' then concat('{"id": " ', cast(c_custkey as string), ' "}')
  when 'MACHINERY' then concat('{"redaction_id": "r', cast(c_custkey as string), '"}')
  when 'HOUSEHOLD' then concat('"', c_name, '"')
  when 'FURNITURE' then case when c_acctbal > 5000 then '{"id": 7}' else '{"id": "  ", "redaction_id": "x"}' end
  else 'broken {' end as pointer from customer
"""
