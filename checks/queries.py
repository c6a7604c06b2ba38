"""The checked queries: Spark on one side, DuckDB SQL on the other.

Every query reads the given tables whole.  Arrays are joined to text and counts are
long on both sides, so values compare directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks import oracle as O
from spanveil.functions import labels
from spanveil.functions.lines import explode_lines
from spanveil.functions.spans import merge_spans
from spanveil.operators import alerts as A
from spanveil.operators import detect, history, policy, redact, report
from spanveil.operators.changes import changes
from spanveil.operators.evaluate import evaluate
from spanveil.operators.gazetteer import gazetteer_detect
from spanveil.operators.rules import CUSTOM, PII, CREDENTIAL, Rule, catalog, only, register
from spanveil.plans import jobs
from spanveil.session import ensure_checkpoint_dir
from spanveil.sources import history_store
from spanveil.sources.history_store import split_redactions
from spanveil.sources.selection import read_pointers
from spanveil.sources.text import read_table, spread
from spanveil.streaming import monitor as M
from spanveil.streaming.state import changed_rows, prepare, unpaused_rows

TABLES = ("documents", "pages", "conversations", "events", "customer", "supplier", "nation",
          "labels")


# Tables of texts, with their key: work per row is high, so few input partitions are
# spread over the cores.
TEXTS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for name in tables or TABLES:
        rows = read_table(spark, f"{sf_dir}/{name}.parquet")
        if name in TEXTS:
            rows = spread(rows, *TEXTS[name])
        rows.createOrReplaceTempView(name)


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = read_table(spark, f"{sf_dir}/{name}.parquet", *columns)
    return spread(rows, *[key for key in TEXTS[name]])


def table(spark: SparkSession, sf_dir: str, statement: str, *tables: str) -> DataFrame:
    load(spark, sf_dir, *tables)
    return spark.sql(statement)


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, arrays as joined text."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        elif kind.startswith("array<"):
            column = F.array_join(column.cast("array<string>"), ",")
        out.append(column.alias(name))
    return df.select(*out)


def _scratch(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4()}"


def once(docs: DataFrame, text: str = "text") -> DataFrame:
    """Compute a derived text once per row: filters are not pushed below a generator, so
    the expression that makes the text is not repeated in each of them."""
    keys = [c for c in docs.columns if c != text]
    return docs.select(*keys, F.explode(F.array(text)).alias(text))


def rich(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    docs = table(spark, sf_dir, I.RICH, "documents")
    return once(docs.select(*(keys or ("doc_id",)), "text"))


ALL = only(catalog(), *{rule.entity for rule in catalog()})
LINE_RULES = detect.line_rules(ALL)
DEFAULT = O.default_rules(catalog())
DEFAULT_INCLUSIVE = O.default_rules(catalog(), inclusive=True)
SHOUT = Rule("SHOUTED_WORD", "Shouted word", CUSTOM, "[A-Z]{5,40}", score=0.55)
FRENCH = Rule("FRENCH_ARTICLE", "French article", CUSTOM, " (?:les|des|aux) ",
              score=0.9, lang="fr", hint="les \ndes \naux ")
SPANS = "doc_id, " + O.FINDING
DOCS = "SELECT doc_id, source, lang, text FROM documents"

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register_query(build):
        SPARK[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return register_query


# --- lines ---------------------------------------------------------------------------

@check("numbered_lines", O.lines(I.BREAKS, "doc_id", skip_blank=False))
def numbered_lines(spark, sf_dir):
    return explode_lines(table(spark, sf_dir, I.BREAKS, "documents"))


@check("nonblank_lines", O.lines(I.GAPS, "conv_id, turn"))
def nonblank_lines(spark, sf_dir):
    return explode_lines(table(spark, sf_dir, I.GAPS, "conversations"), skip_blank=True)


@check("normalized_lines", O.lines(
    I.MIXED_PAGES, "page_id",
    "replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))",
    "\n", drop_last=False, skip_blank=False))
def normalized_lines(spark, sf_dir):
    return explode_lines(table(spark, sf_dir, I.MIXED_PAGES, "pages"), "html", "normalized")


# --- findings ------------------------------------------------------------------------

@check("findings_default_policy", f"SELECT source, lang, {SPANS} FROM ("
       + O.line_findings(DOCS, DEFAULT, "doc_id, source, lang") + ")")
def findings_default_policy(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return jobs.scan(docs)


@check("findings_every_rule", f"SELECT {SPANS} FROM ({O.line_findings(I.RICH, LINE_RULES)})")
def findings_every_rule(spark, sf_dir):
    return detect.scan(rich(spark, sf_dir), LINE_RULES)


@check("findings_credentials",
       f"SELECT {SPANS} FROM ({O.line_findings(I.RICH, [r for r in ALL if r.category == CREDENTIAL])})")
def findings_credentials(spark, sf_dir):
    return detect.scan(rich(spark, sf_dir), [r for r in ALL if r.category == CREDENTIAL])


@check("findings_personal_data",
       f"SELECT {SPANS} FROM ({O.line_findings(I.RICH, [r for r in ALL if r.category == PII])})")
def findings_personal_data(spark, sf_dir):
    return detect.scan(rich(spark, sf_dir), [r for r in ALL if r.category == PII])


_DOC_FOUND = O.findings(I.RICH, "doc_id, text", ALL, "text")


@check("findings_document_unit",
       "SELECT doc_id, length(substr(text, 1, \"start\")) - length(replace(substr(text, 1, "
       "\"start\"), chr(10), '')) + 1 AS line_no, entity, \"start\", CAST(\"end\" AS BIGINT) AS "
       f"\"end\", score, confidence, \"match\", rule FROM ({_DOC_FOUND})")
def findings_document_unit(spark, sf_dir):
    return detect.scan(rich(spark, sf_dir), ALL, unit="document")


@check("findings_in_pages", f"SELECT page_id, url, {O.FINDING} FROM ("
       + O.line_findings("SELECT page_id, url, html FROM pages", LINE_RULES, "page_id, url", "html")
       + ")")
def findings_in_pages(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id", "url", "html")
    return detect.scan(pages, LINE_RULES, text="html")


@check("findings_in_urls", f"SELECT page_id, {O.FINDING} FROM ("
       + O.line_findings("SELECT page_id, url FROM pages", only(ALL, "URL"), "page_id", "url") + ")")
def findings_in_urls(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id", "url")
    return detect.scan(pages, only(ALL, "URL"), text="url")


@check("findings_custom_rules", f"SELECT lang, {SPANS} FROM ("
       + O.line_findings(DOCS, [SHOUT, FRENCH], "doc_id, lang") + ")")
def findings_custom_rules(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return detect.scan(docs, register([], SHOUT, FRENCH), lang="lang")


@check("findings_one_language", f"SELECT lang, {SPANS} FROM ("
       + O.line_findings("SELECT doc_id, lang, text FROM documents WHERE lang = 'en'", DEFAULT,
                         "doc_id, lang") + ")")
def findings_one_language(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return jobs.scan(docs, lang="lang")


@check("findings_above", f"SELECT {SPANS} FROM ({O.line_findings(I.RICH, LINE_RULES)}) "
       "WHERE score >= 0.85")
def findings_above(spark, sf_dir):
    return detect.above(detect.scan(rich(spark, sf_dir), LINE_RULES), 0.85, inclusive=True)


@check("finding_messages",
       "SELECT doc_id, 'Line ' || line_no || ': ' || entity || ' (' || confidence || '% ''' || "
       "\"match\" || ''')' AS message, substr(\"match\", 1, 4) || '...' AS preview, "
       "CASE WHEN confidence <= 85 THEN 'amber' ELSE 'red' END AS severity, "
       f"printf('%.2f', score) AS score_text FROM ({O.line_findings(I.RICH, LINE_RULES)})")
def finding_messages(spark, sf_dir):
    f = detect.scan(rich(spark, sf_dir), LINE_RULES)
    return f.select(
        "doc_id",
        labels.scan_message(F.col("line_no"), F.col("entity"), F.col("confidence"), F.col("match"))
        .alias("message"),
        labels.masked_preview(F.col("match")).alias("preview"),
        labels.severity(F.col("confidence")).alias("severity"),
        labels.score_text(F.col("score")).alias("score_text"),
    )


# --- reports -------------------------------------------------------------------------

_TYPES = "array_to_string(list_sort(list(DISTINCT entity)), '{}')"
_ENTITY_LABEL = ("array_to_string(list_transform(string_split(lower(entity), '_'), lambda w: "
                 "upper(w[1]) || w[2:]), ' ')")


@check("sensitive_lines", f"""
    WITH ln AS ({O.lines(I.RICH, 'doc_id')}),
    f AS ({O.findings('SELECT * FROM ln', 'doc_id, line_no', detect.line_rules(DEFAULT_INCLUSIVE), 'line')}),
    t AS (SELECT doc_id, line_no, {_TYPES.format(',')} AS types, {_TYPES.format(', ')} AS shown
          FROM f GROUP BY doc_id, line_no)
    SELECT doc_id, line_no, types, line,
      'Line ' || line_no || ' (' || shown || '): ' || line AS message
    FROM t JOIN ln USING (doc_id, line_no)""")
def sensitive_lines(spark, sf_dir):
    return jobs.sensitive_lines(rich(spark, sf_dir))


@check("scan_summary", f"""
    WITH src AS ({I.RICH}), f AS ({O.line_findings('SELECT * FROM src', DEFAULT_INCLUSIVE)}),
    g AS (SELECT doc_id, count(*) AS span_count, count(DISTINCT (line_no, entity)) AS line_type_count,
            {_TYPES.format(',')} AS types, count(DISTINCT line_no) AS affected_lines
          FROM f GROUP BY doc_id)
    SELECT doc_id, source, coalesce(span_count, 0) AS span_count,
      coalesce(line_type_count, 0) AS line_type_count, coalesce(types, '') AS types,
      coalesce(affected_lines, 0) AS affected_lines, length(text) AS text_length,
      span_count IS NOT NULL AS leak
    FROM src LEFT JOIN g USING (doc_id)""")
def scan_summary(spark, sf_dir):
    return jobs.scan_summary(rich(spark, sf_dir, "doc_id", "source"))


@check("scan_summary_plain_texts", f"""
    WITH f AS ({O.line_findings(DOCS, DEFAULT_INCLUSIVE)}),
    g AS (SELECT doc_id, count(*) AS span_count, count(DISTINCT (line_no, entity)) AS line_type_count,
            {_TYPES.format(',')} AS types, count(DISTINCT line_no) AS affected_lines
          FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(span_count, 0) AS span_count,
      coalesce(line_type_count, 0) AS line_type_count, coalesce(types, '') AS types,
      coalesce(affected_lines, 0) AS affected_lines, length(text) AS text_length,
      span_count IS NOT NULL AS leak
    FROM documents LEFT JOIN g USING (doc_id)""")
def scan_summary_plain_texts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return jobs.scan_summary(docs)


@check("counts_with_labels", f"""
    SELECT g.*, coalesce(label, g.entity) AS label, description FROM (
      SELECT entity, count(*) AS findings, max(confidence) AS best_confidence
      FROM ({O.line_findings(I.RICH, LINE_RULES)}) GROUP BY entity) g
    LEFT JOIN {O.LABELS} ON labels_table.entity = g.entity""")
def counts_with_labels(spark, sf_dir):
    counts = report.count_findings(detect.scan(rich(spark, sf_dir), LINE_RULES), "entity")
    return report.with_labels(counts)


@check("audit", f"""
    WITH ln AS ({O.lines(I.RICH, 'doc_id')}),
    f AS ({O.findings('SELECT * FROM ln', 'doc_id, line_no', LINE_RULES, 'line')})
    SELECT doc_id, line_no, coalesce(entity, 'Clean') AS entity, "start",
      CAST("end" AS BIGINT) AS "end", score, "match",
      'Line ' || line_no || ' | ' || coalesce('Type: ' || entity || ' | Text: ''' || "match"
        || ''' | Confidence: ' || printf('%.2f', score), 'Clean') AS message
    FROM ln LEFT JOIN f USING (doc_id, line_no)""")
def audit(spark, sf_dir):
    return jobs.audit(rich(spark, sf_dir))


@check("clean_lines", f"""
    WITH ln AS ({O.lines(I.RICH, 'doc_id')}),
    f AS ({O.findings('SELECT * FROM ln', 'doc_id, line_no', LINE_RULES, 'line')})
    SELECT doc_id, line_no, line FROM ln ANTI JOIN f USING (doc_id, line_no)""")
def clean_lines(spark, sf_dir):
    return report.clean_lines(rich(spark, sf_dir), LINE_RULES)


# --- redaction -----------------------------------------------------------------------

_ON = [r for r in catalog() if r in O.default_rules(catalog())]
_ALL_REDACT = [r for r in ALL if r.score > 0.5]
_REDACT_COLUMNS = "doc_id, text, redacted, span_count, line_numbers, redacted_text"
_KEEP_BREAKS = " || regexp_replace(hit, '[^\\n]+', '', 'g')"


@check("redacted_default_policy",
       f"SELECT doc_id, source, text, redacted, span_count, line_numbers, redacted_text FROM "
       f"({O.redacted('SELECT doc_id, source, text FROM documents', _ON)})")
def redacted_default_policy(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    return jobs.redacted(docs)


@check("redacted_every_rule",
       f"SELECT {_REDACT_COLUMNS} FROM ({O.redacted(I.RICH, _ALL_REDACT)})")
def redacted_every_rule(spark, sf_dir):
    return redact.redact(rich(spark, sf_dir), ALL)


@check("redacted_masked", f"SELECT {_REDACT_COLUMNS} FROM ("
       + O.redacted(I.RICH, _ALL_REDACT,
                    "repeat('*', CAST(length(hit) AS BIGINT))" + _KEEP_BREAKS) + ")")
def redacted_masked(spark, sf_dir):
    return redact.redact(rich(spark, sf_dir), ALL, mode="mask", preserve_newlines=True)


@check("redacted_hashed", f"SELECT {_REDACT_COLUMNS} FROM ("
       + O.redacted(I.RICH, _ALL_REDACT, "sha256('salt' || chr(30) || sha256('salt' || chr(31) || hit))") + ")")
def redacted_hashed(spark, sf_dir):
    return redact.redact(rich(spark, sf_dir), ALL, mode="hash", key="salt")


@check("redacted_dropped", f"SELECT {_REDACT_COLUMNS} FROM ("
       + O.redacted(I.RICH, _ALL_REDACT, "''") + ")")
def redacted_dropped(spark, sf_dir):
    return redact.redact(rich(spark, sf_dir), ALL, mode="drop")


@check("merged_spans", 'SELECT doc_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) '
       f'AS "end", entity, score FROM ({O.islands(O.findings(I.RICH, "doc_id", ALL, "text"))})')
def merged_spans(spark, sf_dir):
    spans = detect.document_spans(F.col("text"), ALL)
    return rich(spark, sf_dir).select("doc_id", F.inline(merge_spans(spans)))


_REQUESTS = (
    "SELECT DISTINCT event_id % (SELECT count(*) FROM documents) AS doc_id FROM events "
    "WHERE event_type = 'purchase'"
)


@check("redacted_on_request",
       f"SELECT {_REDACT_COLUMNS} FROM (" + O.redacted(
           f"SELECT doc_id, text FROM ({I.RICH}) SEMI JOIN ({_REQUESTS}) r USING (doc_id)", _ON) + ")")
def redacted_on_request(spark, sf_dir):
    requests = table(spark, sf_dir, _REQUESTS, "events", "documents")
    return redact.redact_requested(requests, rich(spark, sf_dir), _ON, ["doc_id"])


# --- policy --------------------------------------------------------------------------

def _settings(spark, sf_dir):
    # Reading a settings text costs far more than its row, so a table in few files is spread.
    return policy.read_settings(spread(table(spark, sf_dir, I.SETTINGS, "customer"), "tenant"))


@check("policy_switches", O.policy_rows(I.SETTINGS, "tenant"))
def policy_switches(spark, sf_dir):
    return policy.policy_rows(_settings(spark, sf_dir), "tenant")


@check("policy_allow_list", "SELECT DISTINCT tenant, entity FROM "
       f"({O.policy_rows(I.SETTINGS, 'tenant')}) WHERE enabled AND entity IS NOT NULL")
def policy_allow_list(spark, sf_dir):
    return policy.allow_list(_settings(spark, sf_dir), "tenant")


@check("policy_enabled_counts", f"""
    SELECT tenant, category, enabled, known, enabled = known AS all_enabled FROM (
      SELECT tenant, category, count(*) FILTER (WHERE enabled) AS enabled,
        CAST(CASE category WHEN 'pii' THEN 12 ELSE 11 END AS BIGINT) AS known
      FROM ({O.policy_rows(I.SETTINGS, 'tenant')}) GROUP BY tenant, category)""")
def policy_enabled_counts(spark, sf_dir):
    return policy.enabled_counts(_settings(spark, sf_dir), "tenant")


@check("policy_edits", f"""
    SELECT tenant, category, name, entity, CASE WHEN category = 'credential' THEN true
        WHEN name = 'URL' THEN true ELSE enabled END AS enabled,
      CAST(0.62 AS DOUBLE) AS confidence_threshold, CAST(1 AS BIGINT) AS history_limit
    FROM ({O.policy_rows(I.SETTINGS, 'tenant')})""")
def policy_edits(spark, sf_dir):
    edited = policy.set_switch(_settings(spark, sf_dir), PII, "URL", True)
    edited = policy.set_category(edited, CREDENTIAL, True)
    edited = policy.set_history_limit(policy.set_threshold_percent(edited, 62), 0)
    return policy.policy_rows(edited, "tenant", "confidence_threshold", "history_limit")


@check("policy_scalars", f"""
    WITH src AS ({I.SETTINGS}),
    v AS (SELECT tenant, CASE WHEN json_valid(settings) AND settings LIKE '{{%' THEN settings
            ELSE '{{}}' END AS s FROM src)
    SELECT tenant, coalesce(json_extract_string(s, '$.language'), 'en') AS language,
      coalesce(CAST(json_extract(s, '$.confidence_threshold') AS DOUBLE), 0.5) AS confidence_threshold,
      true AS scan_enabled,
      coalesce(CAST(json_extract(s, '$.keep_history') AS VARCHAR) = 'true', true) AS keep_history,
      greatest(1, coalesce(CAST(json_extract(s, '$.history_limit') AS BIGINT), 100)) AS history_limit
    FROM v""")
def policy_scalars(spark, sf_dir):
    return _settings(spark, sf_dir).drop("entities", "credential_types")


@check("policy_saved_and_read_again", O.policy_rows(I.SETTINGS, "tenant"))
def policy_saved_and_read_again(spark, sf_dir):
    texts = policy.settings_json(_settings(spark, sf_dir), "tenant")
    return policy.policy_rows(policy.read_settings(texts), "tenant")


@check("tenant_findings", f"""
    SELECT source, {SPANS} FROM ({O.line_findings(I.RICH, LINE_RULES, 'doc_id, source')})
    SEMI JOIN (SELECT DISTINCT source, entity FROM ({O.policy_rows(I.SOURCE_SETTINGS, 'source')})
               WHERE enabled AND entity IS NOT NULL) a USING (source, entity)""")
def tenant_findings(spark, sf_dir):
    docs = rich(spark, sf_dir, "doc_id", "source")
    settings = policy.read_settings(table(spark, sf_dir, I.SOURCE_SETTINGS, "documents"))
    found = detect.scan(docs, LINE_RULES)
    return detect.allowed(found, policy.allow_list(settings, "source"), ["source", "entity"],
                          ["doc_id", "line_no", "start"])


# --- alerts --------------------------------------------------------------------------

# Every event copies a document; a document is looked at once, however often it is copied.
_COPIED = "select event_id, user_id, ts, event_id % (select count(*) from documents) as doc_id from events"
_PAUSES = "select user_id, ts from events where event_type = 'error'"
_RED = "CASE WHEN max(confidence) <= 85 THEN 'amber' ELSE 'red' END"


@check("alerts", f"""
    WITH src AS ({_COPIED}),
    f AS (SELECT * FROM ({O.line_findings(I.RICH, DEFAULT)})),
    g AS (SELECT doc_id, count(*) AS span_count, {_TYPES.format(',')} AS types,
      {_RED} AS severity,
      'Sensitive data detected!' || chr(10) || string_agg('• Line ' || line_no || ': '
        || {_ENTITY_LABEL} || ' (' || confidence || '%)', chr(10)
        ORDER BY line_no, "start", "end", entity) AS body
      FROM f GROUP BY doc_id)
    SELECT s.event_id, s.user_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, span_count, types, severity, body
    FROM src s JOIN g USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM ({_PAUSES}) p WHERE p.user_id = s.user_id
      AND s.ts >= p.ts AND s.ts < p.ts + INTERVAL 300 SECOND)""")
def alerts(spark, sf_dir):
    copied = table(spark, sf_dir, _COPIED, "events", "documents")
    raised = copied.join(A.alerts(rich(spark, sf_dir), DEFAULT), "doc_id").drop("doc_id")
    return _clock(A.suppress_paused(raised, spark.sql(_PAUSES), "user_id", "ts", ["event_id"]))


def _clock(df: DataFrame) -> DataFrame:
    """The test clock has no zone: its wall time is compared, as text."""
    return df.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("ts")


@check("events_outside_pauses", f"""
    SELECT e.event_id, e.user_id, e.event_type, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM ({_PAUSES}) p WHERE p.user_id = e.user_id
      AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 300 SECOND)""")
def events_outside_pauses(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_id, user_id, event_type, ts from events", "events")
    return _clock(A.suppress_paused(rows, spark.sql(_PAUSES), "user_id", "ts", ["event_id"]))


# --- changes and history -------------------------------------------------------------

_CHANGED = """
    SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
      FROM events) WHERE before IS NOT NULL AND before <> event_type"""


@check("changed_values", _CHANGED)
def changed_values(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_id, user_id, event_type, ts from events", "events")
    return _clock(changes(rows, "user_id", "ts", "event_id", "event_type"))


@check("changed_turns", """
    SELECT conv_id, turn, role, text FROM (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    WHERE before IS NULL OR before <> role""")
def changed_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "select conv_id, turn, role, text from conversations",
                 "conversations")
    return changes(rows, "conv_id", "turn", "turn", "role", emit_first=True)


_RECORDS = """
    select user_id, event_id, cast(ts as string) as timestamp, event_type as source,
      cast(value as int) as finding_count from events"""


@check("newest_records", """
    SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 25""")
def newest_records(spark, sf_dir):
    rows = table(spark, sf_dir, "select user_id, event_id, ts from events", "events")
    return _clock(history.newest(rows, 25, ["user_id"], "ts", "event_id"))


@check("newest_records_large_limit", """
    SELECT event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 1500""")
def newest_records_large_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_type, event_id, ts from events", "events")
    return _clock(history.newest(rows, 1500, ["event_type"], "ts", "event_id"))


@check("newest_overall",
       "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_overall(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_id, user_id, ts from events", "events")
    return _clock(history.newest_overall(rows, 100, "ts", "event_id"))


# The record texts are the digest-bearing lines of a document, its owner is its source.
_REDACTED = O.redacted(I.RICH, _ON)


_STAMP = ("strftime(make_timestamp((1704067200 + doc_id * 61) * 1000000), "
          "'%Y-%m-%dT%H:%M:%S.%f+00:00')")
_ID = f"sha256(concat_ws(chr(31), doc_id, source, lang, {_STAMP}, source))"


@check("redaction_history", f"""
    SELECT doc_id, lang, {_ID} AS id, {_STAMP} AS timestamp, source, 'redaction' AS kind,
      line_numbers, text AS original_text, redacted_text
    FROM ({_REDACTED}) WHERE redacted""")
def redaction_history(spark, sf_dir):
    rows = jobs.redacted(rich(spark, sf_dir, "doc_id", "source", "lang"))
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 61)
    records = history.redaction_records(rows.withColumnRenamed("source", "src"), moment,
                                        F.col("src"), "doc_id", "src", "lang")
    return records.drop("src")


@check("scan_history", f"""
    WITH src AS ({I.RICH}), f AS ({O.line_findings('SELECT * FROM src', DEFAULT_INCLUSIVE)}),
    g AS (SELECT doc_id, count(DISTINCT (line_no, entity)) AS finding_count,
            {_TYPES.format(',')} AS types FROM f GROUP BY doc_id)
    SELECT doc_id, {_STAMP} AS timestamp, 'Command-line scan' AS source,
      coalesce(finding_count, 0) AS finding_count, coalesce(types, '') AS types,
      length(text) AS text_length FROM src LEFT JOIN g USING (doc_id)""")
def scan_history(spark, sf_dir):
    summary = jobs.scan_summary(rich(spark, sf_dir))
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 61)
    return jobs.summary_records(summary, moment, "doc_id")


@check("side_by_side", f"""
    WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS a,
        string_split(redacted_text, chr(10)) AS b, ',' || line_numbers || ',' AS flags
      FROM ({O.redacted(I.RICH, _ALL_REDACT)}) WHERE redacted),
    n AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line_no FROM r)
    SELECT doc_id, line_no, coalesce(a[line_no], '') AS original_line,
      coalesce(b[line_no], '') AS redacted_line,
      contains(flags, ',' || line_no || ',') AS flagged FROM n""")
def side_by_side(spark, sf_dir):
    rows = redact.redact(rich(spark, sf_dir), ALL).filter("redacted")
    return history.side_by_side(rows.withColumnRenamed("text", "original_text"), "doc_id")


def _owned(spark, sf_dir):
    """A saved history whose owners are the sources of the texts.

    Review reads its records several times, so they are written first, as a history is.
    """
    rows = jobs.redacted(rich(spark, sf_dir, "doc_id", "source")).filter("redacted")
    records = rows.select(
        F.col("source").alias("owner"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("2024-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("timestamp"),
        F.when(F.col("source") > "src15", "").otherwise(F.col("source")).alias("source"),
        F.lit("redaction").alias("kind"),
        "line_numbers", F.col("text").alias("original_text"), "redacted_text",
    )
    path = f"{_scratch(spark)}/history"
    history_store.append(records, path)
    return history_store.load(spark, path, f"owner string, {history_store.REDACTION_SCHEMA}")


_OWNED = f"""
    SELECT source AS owner, 'd' || doc_id AS id, '2024-' || lpad(CAST(doc_id AS VARCHAR), 9, '0')
      AS timestamp, CASE WHEN source > 'src15' THEN '' ELSE source END AS source, line_numbers,
      text AS original_text, redacted_text FROM ({_REDACTED}) WHERE redacted"""
_OWNER_POINTERS = """
    select source as owner, case when source < 'src11' then
        concat('{"id": "d', cast(min(doc_id) as string), '"}')
      when source < 'src14' then concat('{"redaction_id": "d', cast(min(doc_id) as string), ' "}')
      when source < 'src16' then '"gone"'
      when source < 'src18' then '{"id": 5}' else 'broken' end as pointer
    from documents group by source"""
_RESOLVED = f"""
    WITH rec AS ({_OWNED}),
    ptr AS (SELECT source AS owner, CASE WHEN source < 'src14' THEN 'd' || min(doc_id)
        WHEN source < 'src16' THEN 'gone' END AS sel FROM documents GROUP BY source),
    last AS (SELECT owner, arg_max(id, timestamp) AS newest FROM rec GROUP BY owner),
    st AS (SELECT coalesce(l.owner, p.owner) AS owner, newest, sel, EXISTS (SELECT 1 FROM rec
        WHERE rec.owner = p.owner AND rec.id = p.sel) AS known
      FROM last l FULL JOIN ptr p ON l.owner = p.owner),
    pick AS (SELECT owner, CASE WHEN known THEN sel ELSE newest END AS id,
      CASE WHEN newest IS NULL THEN '' WHEN known THEN 'Selected redaction'
        ELSE 'Most recent redaction' END AS mode,
      CASE WHEN newest IS NULL THEN 'No valid redaction records were found.' WHEN known THEN NULL
        WHEN sel IS NOT NULL THEN 'Selected ID was not found; showing the newest valid record instead.'
        ELSE 'No usable selection file; showing the newest valid record instead.' END AS note
      FROM st),
    res AS (SELECT * FROM pick LEFT JOIN rec USING (owner, id))"""


@check("review", _RESOLVED + """,
    n AS (SELECT *, string_split(original_text, chr(10)) AS a,
        string_split(redacted_text, chr(10)) AS b FROM res),
    e AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line_no FROM n)
    SELECT owner, id, mode, note, line_no, coalesce(a[line_no], '') AS original_line,
      coalesce(b[line_no], '') AS redacted_line,
      contains(',' || line_numbers || ',', ',' || line_no || ',') AS flagged FROM e""")
def review(spark, sf_dir):
    records = _owned(spark, sf_dir)
    pointers = read_pointers(table(spark, sf_dir, _OWNER_POINTERS, "documents"), "owner")
    return jobs.review(records, pointers, "owner")


@check("review_header", _RESOLVED + """
    SELECT owner, id, CASE WHEN coalesce(source, '') = '' THEN 'Clipboard redaction' ELSE source END
      AS title, mode || '  •  ' || coalesce(timestamp, 'Unknown time') || '  •  ' || k ||
      CASE WHEN k = 1 THEN ' flagged line' ELSE ' flagged lines' END AS subtitle, note
    FROM (SELECT *, CASE WHEN coalesce(line_numbers, '') = '' THEN 0
      ELSE len(string_split(line_numbers, ',')) END AS k FROM res)""")
def review_header(spark, sf_dir):
    records = _owned(spark, sf_dir)
    pointers = read_pointers(table(spark, sf_dir, _OWNER_POINTERS, "documents"), "owner")
    return history.review_header(history.resolve(records, pointers, "owner"), "owner")


_VIEW_INPUT = """
    select user_id, event_id, event_type as source,
      case when event_type = 'error' then 'no time' else
        replace(cast(ts as string), ' ', 'T') end as timestamp,
      case when event_type in ('click', 'view') then 'redaction' end as kind,
      case when event_type = 'view' then concat('r', cast(event_id as string)) end as id,
      case when event_type = 'view' then 'a' end as original_text,
      case when event_type = 'view' then concat('x', chr(10), 'y', cast(user_id as string)) end
        as redacted_text,
      case when event_type <> 'signup' then cast(floor(value) as int) end as finding_count
    from events"""


@check("history_view", f"""
    SELECT user_id, event_id, CASE WHEN source = 'error' THEN 'Unknown time' ELSE
        strftime(ts, '%d %b, %I:%M %p') END AS happened,
      'Lines: ' || CASE WHEN source = 'view' THEN '1, ' || (user_id + 2) ELSE '—' END AS line_label,
      CASE WHEN source = 'view' THEN '2 affected lines' ELSE k ||
        CASE WHEN k = 1 THEN ' affected line' ELSE ' affected lines' END END AS affected,
      replace(redacted_text, chr(10), ' ') AS preview, source, source = 'view' AS can_open
    FROM (SELECT v.*, e.ts, coalesce(v.finding_count, 0) AS k FROM ({_VIEW_INPUT}) v
          JOIN events e USING (event_id)
          QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY v.timestamp DESC, event_id) <= 100)""")
def history_view(spark, sf_dir):
    rows = table(spark, sf_dir, _VIEW_INPUT, "events")
    numbers = F.when(F.col("source") == "view",
                     F.array(F.lit(1), (F.col("user_id") + 2).cast("int")))
    return jobs.history_view(rows.withColumn("line_numbers", numbers), 100, "user_id", "event_id")


_HISTORY_TEXTS = f"""
    SELECT user_id, CASE WHEN max(value) > 200 THEN '{{"not": "a list"}}' ELSE
      concat('[', array_join(array_sort(collect_list(element)), ','), ']') END AS history
    FROM (SELECT user_id, value, {I.HISTORY_ELEMENT} AS element FROM events) GROUP BY user_id
    UNION ALL SELECT -1 - c_custkey, c_name FROM customer"""
_LISTS = "SELECT user_id FROM events GROUP BY user_id HAVING max(value) <= 200"


@check("parsed_redactions", f"""
    SELECT user_id, 'r' || event_id AS id, '2024-01-0' || substr(CAST(event_id AS VARCHAR), 1, 1)
      AS timestamp, 's' AS source, 'redaction' AS kind, CAST(NULL AS VARCHAR) AS file_name,
      CAST(NULL AS BIGINT) AS finding_count, '2,3' AS line_numbers, 'a' || user_id AS original_text,
      'b' AS redacted_text
    FROM events SEMI JOIN ({_LISTS}) l USING (user_id) WHERE event_type = 'view'""")
def parsed_redactions(spark, sf_dir):
    texts = table(spark, sf_dir, _HISTORY_TEXTS, "events", "customer")
    return split_redactions(texts)[0].drop("position")


@check("rejected_records", f"""
    SELECT user_id, CASE event_type WHEN 'signup' THEN 'not an object' WHEN 'error' THEN 'no usable id'
      WHEN 'click' THEN 'original_text is not a string' ELSE 'redacted_text is not a string' END AS reason,
      count(*) AS records
    FROM events SEMI JOIN ({_LISTS}) l USING (user_id) WHERE event_type <> 'view' GROUP BY ALL""")
def rejected_records(spark, sf_dir):
    texts = table(spark, sf_dir, _HISTORY_TEXTS, "events", "customer")
    return split_redactions(texts)[1].groupBy("user_id", "reason").agg(F.count("*").alias("records"))


@check("selection_pointers", """
    SELECT c_custkey AS owner, CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey AS VARCHAR)
      WHEN 'MACHINERY' THEN 'r' || c_custkey WHEN 'HOUSEHOLD' THEN c_name END AS selected_id
    FROM customer""")
def selection_pointers(spark, sf_dir):
    return read_pointers(table(spark, sf_dir, I.POINTERS, "customer"), "owner")


@check("cleaned_line_numbers", """
    SELECT event_id, CASE WHEN user_id = 0 THEN '7' WHEN user_id = 7 THEN '7'
      ELSE CASE WHEN user_id < 7 THEN user_id || ',7' ELSE '7,' || user_id END END AS line_numbers
    FROM events""")
def cleaned_line_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_id, array(event_type, ' 7 ', cast(user_id as string), "
                 "'-3', cast(value + 0.5 as string) || 'x', null, '7') as raw from events", "events")
    return rows.select("event_id", labels.clean_line_numbers(F.col("raw")).alias("line_numbers"))


# --- dictionaries --------------------------------------------------------------------

# Documents with the names of a customer, a supplier and their nations in a last line.
_NAMED = """
    select d.doc_id, concat(d.text, chr(10), 'Met ', c.c_name, ' and ', s.s_name, ' of ', n.n_name,
      ', Greater ', n.n_name, ' Area.') as text
    from documents d join customer c on c.c_custkey = d.doc_id
    join nation n on n.n_nationkey = c.c_nationkey
    join supplier s on s.s_suppkey = c.c_nationkey % 10"""
_DICTIONARY = """
    select c_name as term, 'PERSON' as entity, cast(0.8 as double) as score from customer
    union all select s_name, 'ORGANIZATION', cast(0.7 as double) from supplier
    union all select n_name, 'LOCATION', cast(0.75 as double) from nation
    union all select concat('greater  ', n_name, ' area'), 'LOCATION', cast(0.9 as double) from nation
    union all select n_name, 'NRP', cast(0.6 as double) from nation"""


@check("dictionary_findings", O.terms_in_lines(_NAMED, _DICTIONARY))
def dictionary_findings(spark, sf_dir):
    docs = once(table(spark, sf_dir, _NAMED, "documents", "customer", "nation", "supplier"))
    return gazetteer_detect(docs, spark.sql(_DICTIONARY), ["doc_id"])


@check("dictionary_findings_shuffled", O.terms_in_lines(_NAMED, _DICTIONARY))
def dictionary_findings_shuffled(spark, sf_dir):
    docs = once(table(spark, sf_dir, _NAMED, "documents", "customer", "nation", "supplier"))
    return gazetteer_detect(docs, spark.sql(_DICTIONARY), ["doc_id"], broadcast_rows=0)


# What strict rules find is scored against what all rules find with a checksum kept.
_PREDICTED = [r for r in LINE_RULES if r.entity not in ("STRIPE", "URL")]
_GOLD = [r for r in LINE_RULES if r.entity not in ("SLACK", "MAC_ADDRESS")]


@check("evaluation", f"""
    WITH p AS (SELECT DISTINCT doc_id, line_no, "start", "end", entity FROM ({O.line_findings(I.RICH, _PREDICTED)})),
    g AS (SELECT DISTINCT doc_id, line_no, "start", "end", entity FROM ({O.line_findings(I.RICH, _GOLD)})
      WHERE score > 0.7),
    j AS (SELECT coalesce(p.entity, g.entity) AS entity, p.doc_id IS NOT NULL AS f, g.doc_id IS NOT NULL AS g
      FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.line_no = g.line_no AND p."start" = g."start"
        AND p."end" = g."end" AND p.entity = g.entity),
    c AS (SELECT entity, count(*) FILTER (WHERE f AND g) AS hits, count(*) FILTER (WHERE f) AS found,
      count(*) FILTER (WHERE g) AS gold FROM j GROUP BY ROLLUP (entity))
    SELECT entity, hits, found, gold, hits / nullif(found, 0) AS p, hits / nullif(gold, 0) AS r,
      2 * hits / nullif(found + gold, 0) AS f FROM c""")
def evaluation(spark, sf_dir):
    docs = rich(spark, sf_dir)
    found = detect.scan(docs, _PREDICTED)
    gold = detect.scan(docs, _GOLD).filter("score > 0.7")
    return evaluate(found, gold, ["doc_id", "line_no", "start", "end"])


# --- streams -------------------------------------------------------------------------

def _event_stream(spark, sf_dir, columns):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return M.read_texts(spark, sf_dir, schema, "events.parquet").select(*columns)


def _drain(stream: DataFrame, out: str) -> DataFrame:
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


@check("stream_changed_values", _CHANGED)
def stream_changed_values(spark, sf_dir):
    prepare(spark)
    stream = _event_stream(spark, sf_dir, ["event_id", "user_id", "event_type", "ts"])
    changed = changed_rows(stream, "user_id", "ts", "event_id", "event_type")
    return _clock(_drain(changed, _scratch(spark)))


@check("stream_outside_pauses", f"""
    SELECT e.event_id, e.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events e
    WHERE event_type <> 'error' AND NOT EXISTS (
      SELECT 1 FROM ({_PAUSES}) p WHERE p.user_id = e.user_id
      AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 300 SECOND)""")
def stream_outside_pauses(spark, sf_dir):
    prepare(spark)
    stream = _event_stream(spark, sf_dir, ["event_id", "user_id", "ts", "event_type"])
    raised = stream.filter("event_type <> 'error'").drop("event_type")
    pauses = stream.filter("event_type = 'error'").select("user_id", "ts")
    return _clock(_drain(unpaused_rows(raised, pauses, "user_id", "ts", 300), _scratch(spark)))


# The watched text is an event's properties with an address made from its value.
_WATCHED = ("concat(props, chr(10), 'mail u', cast(user_id as string), '@', event_type, '.example.com', "
            "case when value > 50 then concat(' 10.0.0.', cast(user_id as string)) else '' end)")


@check("monitor_findings", f"""
    WITH w AS (SELECT event_id, user_id, ts, {_WATCHED} AS text FROM events),
    c AS (SELECT event_id, user_id, text FROM (SELECT *, lag(text) OVER (PARTITION BY user_id
        ORDER BY ts, event_id) AS before FROM w) WHERE before <> text)
    SELECT user_id, event_id, {O.FINDING} FROM
      ({O.line_findings('SELECT * FROM c', only(ALL, 'EMAIL_ADDRESS', 'IP_ADDRESS'), 'event_id, user_id')})""")
def monitor_findings(spark, sf_dir):
    return spark.read.parquet(f"{_monitored(spark, sf_dir)}/findings").drop("ts", "batch")


def _monitored(spark, sf_dir):
    """What the monitor wrote about the watched texts."""
    stream = _event_stream(spark, sf_dir, ["event_id", "user_id", "ts", "event_type", "props", "value"])
    texts = stream.select("event_id", "user_id", "ts", F.expr(_WATCHED).alias("text"))
    load(spark, sf_dir, "events")
    out = _scratch(spark)
    query = M.monitor(texts, only(ALL, "EMAIL_ADDRESS", "IP_ADDRESS"), f"{out}/out",
                      f"{out}/checkpoint", "user_id", "ts", "event_id", available_now=True,
                      pauses=lambda session: session.sql(_PAUSES), mask=False)
    query.awaitTermination()
    return f"{out}/out"


_WATCHED_CHANGES = f"""
    w AS (SELECT event_id, user_id, ts, {_WATCHED} AS text FROM events),
    c AS (SELECT event_id, user_id, ts, text FROM (SELECT *, lag(text) OVER (PARTITION BY user_id
        ORDER BY ts, event_id) AS before FROM w) WHERE before <> text)"""


# The watched text holds one address, and a second kind where the value is large.
@check("monitor_summary", f"""
    WITH {_WATCHED_CHANGES}
    SELECT event_id, user_id, CASE WHEN text LIKE '% 10.0.0.%' THEN 2 ELSE 1 END AS span_count,
      CASE WHEN text LIKE '% 10.0.0.%' THEN 'EMAIL_ADDRESS,IP_ADDRESS' ELSE 'EMAIL_ADDRESS' END AS types,
      CAST(length(text) AS BIGINT) AS text_length, true AS leak FROM c""")
def monitor_summary(spark, sf_dir):
    rows = spark.read.parquet(f"{_monitored(spark, sf_dir)}/summary")
    return rows.select("event_id", "user_id", "span_count", "types", "text_length", "leak")


@check("monitor_alerts_outside_pauses", f"""
    WITH {_WATCHED_CHANGES}
    SELECT event_id, user_id FROM c WHERE NOT EXISTS (SELECT 1 FROM ({_PAUSES}) p
      WHERE p.user_id = c.user_id AND c.ts >= p.ts AND c.ts < p.ts + INTERVAL 300 SECOND)""")
def monitor_alerts_outside_pauses(spark, sf_dir):
    return spark.read.parquet(f"{_monitored(spark, sf_dir)}/alerts").select("event_id", "user_id")


@check("monitor_history_bounded", f"""
    WITH {_WATCHED_CHANGES}
    SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS turn FROM c) WHERE turn <= 25""")
def monitor_history_bounded(spark, sf_dir):
    kept = M.bounded_history(spark, _monitored(spark, sf_dir), 25, "user_id", "event_id")
    return kept.select("event_id", "user_id")


# Values longer than any fixed length; the SQL is written by hand, not from the rules.
_LONG = """
    select doc_id, concat('mail ', repeat(md5(cast(doc_id as string)), 3), '@x.', md5(cast(doc_id as string)),
      '.aa.bb.cc.dd.ee.ff.gg.hh.example.com end', chr(10), 'token = "', repeat(sha2('t', 256), 7), '" end', chr(10),
      'db postgres://u:', repeat(md5(cast(doc_id as string)), 12), '@host/db end', chr(10),
      'see http://', repeat(md5('u'), 10), '@host.example.org/p end', chr(10), '-----BEGIN RSA PRIVATE KEY-----') as text
    from documents"""
_MD = "md5(CAST(doc_id AS VARCHAR))"


@check("findings_long_values", f"""
    SELECT doc_id, 1 AS line_no, 'EMAIL_ADDRESS' AS entity,
      repeat({_MD}, 3) || '@x.' || {_MD} || '.aa.bb.cc.dd.ee.ff.gg.hh.example.com' AS "match" FROM documents
    UNION ALL SELECT doc_id, 2, 'GENERIC_SECRET', repeat(sha256('t'), 7) FROM documents
    UNION ALL SELECT doc_id, 3, 'DB_URI', 'postgres://u:' || repeat({_MD}, 12) || '@host/db' FROM documents
    UNION ALL SELECT doc_id, 4, 'URL', 'http://' || repeat(md5('u'), 10) || '@host.example.org/p' FROM documents
    UNION ALL SELECT doc_id, 5, 'PRIVATE_KEY', '-----BEGIN RSA PRIVATE KEY-----' FROM documents""")
def findings_long_values(spark, sf_dir):
    rules = only(ALL, "EMAIL_ADDRESS", "GENERIC_SECRET", "DB_URI", "URL", "PRIVATE_KEY")
    found = detect.scan(table(spark, sf_dir, _LONG, "documents"), rules)
    # The host part of an address in a URI is an address of its own.
    return found.filter("not (entity = 'EMAIL_ADDRESS' and line_no > 1)").select("doc_id", "line_no", "entity", "match")


@check("summary_private_keys", """
    SELECT doc_id, true AS leak, 1 AS span_count, 'PRIVATE_KEY' AS types FROM documents""")
def summary_private_keys(spark, sf_dir):
    texts = table(spark, sf_dir, "select doc_id, concat('a', chr(10), '-----BEGIN RSA PRIVATE KEY-----', chr(10), "
                                 "md5(text), chr(10), '-----END RSA PRIVATE KEY-----') as text from documents", "documents")
    return report.summarize(texts, only(ALL, "PRIVATE_KEY")).select("doc_id", "leak", "span_count", "types")


@check("alerts_without_owner", f"""
    WITH e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS owner, ts, event_type FROM events)
    SELECT event_id, owner FROM e WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'error'
      AND p.owner IS NOT DISTINCT FROM e.owner AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 300 SECOND)""")
def alerts_without_owner(spark, sf_dir):
    rows = table(spark, sf_dir, "select event_id, case when user_id % 2 = 0 then user_id end as owner, ts, "
                                "event_type from events", "events")
    pauses = rows.filter("event_type = 'error'").select("owner", "ts")
    return A.suppress_paused(rows, pauses, "owner", "ts", ["event_id"]).select("event_id", "owner")


@check("findings_ipv6_forms", """
    SELECT doc_id, form AS "match" FROM documents, (VALUES ('::1'), ('fe80::'), ('::ffff:10.1.2.3'),
      ('2001:db8::8a2e:370:7334'), ('2001:db8:0:1:1:1:1:1')) AS forms(form)""")
def findings_ipv6_forms(spark, sf_dir):
    forms = "::1;fe80::;::ffff:10.1.2.3;2001:db8::8a2e:370:7334;2001:db8:0:1:1:1:1:1;std::move(x)"
    texts = table(spark, sf_dir, f"select doc_id, replace('{forms}', ';', chr(10)) as text from documents", "documents")
    rules = [r for r in only(ALL, "IP_ADDRESS") if r.name.endswith("v6")]
    return detect.scan(texts, rules).select("doc_id", "match")


@check("stream_redacted_on_request", f"""
    SELECT event_id, redacted, span_count, line_numbers, redacted_text FROM (""" + O.redacted(f"""
      SELECT event_id, {_WATCHED} AS text FROM events t WHERE EXISTS (SELECT 1 FROM events r
        WHERE r.event_type = 'click' AND r.event_id = t.event_id)""",
      only(ALL, "EMAIL_ADDRESS", "IP_ADDRESS"), key="event_id") + ")")
def stream_redacted_on_request(spark, sf_dir):
    stream = _event_stream(spark, sf_dir, ["event_id", "user_id", "ts", "event_type", "props", "value"])
    texts = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                          F.expr(_WATCHED).alias("text"))
    requests = stream.filter("event_type = 'click'").select(
        "event_id", F.col("ts").cast("timestamp").alias("asked"))
    out = M.requested_redactions(requests, texts, ["event_id"],
                                 only(ALL, "EMAIL_ADDRESS", "IP_ADDRESS"), "asked", "ts")
    rows = _drain(out, _scratch(spark))
    return rows.select("event_id", "redacted", "span_count", "line_numbers", "redacted_text")
