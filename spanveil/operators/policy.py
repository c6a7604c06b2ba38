"""Which detectors are on: saved switches over defaults, per tenant, as columns.

A tenant's settings are one JSON text.  Merging, counting and editing happen inside
its row, so a policy table of any size needs no join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.functions.arrays import let
from spanveil.operators.rules import CREDENTIAL, PII, Rule, with_threshold

CATEGORIES = {PII: "entities", CREDENTIAL: "credential_types"}
_DEFAULTS = {PII: V.PII_DEFAULTS, CREDENTIAL: V.CREDENTIAL_DEFAULTS}


def typed(value: object, default: object) -> object:
    """A saved scalar in the type of its default, also if it was saved as text; the default
    where it cannot be read so."""
    try:
        if isinstance(default, bool):
            words = {"true": True, "false": False}
            return words[value.strip().lower()] if isinstance(value, str) else default if value is None else bool(value)
        if isinstance(default, str):
            return value if isinstance(value, str) else default
        number = float(value)
        if not math.isfinite(number):
            return default
        return max(1, int(number)) if isinstance(default, int) else number
    except (KeyError, TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Policy:
    """One tenant's settings on the driver, used to choose rules for a plan."""

    entities: dict[str, bool] = field(default_factory=lambda: dict(V.PII_DEFAULTS))
    credential_types: dict[str, bool] = field(default_factory=lambda: dict(V.CREDENTIAL_DEFAULTS))
    language: str = V.SETTING_DEFAULTS["language"]
    confidence_threshold: float = V.SETTING_DEFAULTS["confidence_threshold"]
    scan_enabled: bool = V.SETTING_DEFAULTS["scan_enabled"]
    keep_history: bool = V.SETTING_DEFAULTS["keep_history"]
    history_limit: int = V.SETTING_DEFAULTS["history_limit"]

    @classmethod
    def from_json(cls, saved: str | None) -> "Policy":
        """Saved values over defaults; anything unreadable counts as nothing saved."""
        try:
            values = json.loads(saved or "{}")
        except ValueError:
            values = {}
        values = values if isinstance(values, dict) else {}
        known = {k: values[k] for k in ("entities", "credential_types") if k in values}
        known |= {k: typed(values.get(k), default) for k, default in V.SETTING_DEFAULTS.items()}
        for part, defaults in (("entities", V.PII_DEFAULTS),
                               ("credential_types", V.CREDENTIAL_DEFAULTS)):
            switches = known.get(part)
            known[part] = {**defaults, **(switches if isinstance(switches, dict) else {})}
        return cls(**known)

    def enabled(self, rule: Rule) -> bool:
        if rule.category == PII:
            return bool(self.entities.get(rule.entity, False))
        if rule.category == CREDENTIAL:
            return bool(self.credential_types.get(rule.name, False))
        return rule.enabled

    def choose(self, rules: Iterable[Rule], inclusive: bool = False) -> list[Rule]:
        """The rules that go into a plan."""
        chosen = [
            rule for rule in rules
            if self.enabled(rule) and rule.lang in (None, self.language)
        ]
        return with_threshold(chosen, self.confidence_threshold, inclusive)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def merge_switches(saved: Column, defaults: dict[str, bool]) -> Column:
    """Saved switches win, missing ones take their default, unknown ones stay."""
    def merged(kept: Column) -> Column:
        missing = F.map_filter(_literal_map(defaults), lambda k, v: ~F.map_contains_key(kept, k))
        return F.map_concat(kept, missing)

    # Bound, or the saved text would be read again for every default.
    return let(F.coalesce(saved, F.create_map().cast("map<string,boolean>")), merged)


def read_settings(table: DataFrame, settings: str = "settings", keep_unknown: bool = False) -> DataFrame:
    """JSON settings text to typed columns, defaults filled in.

    Text that is not JSON, or not an object, counts as nothing saved.  ``keep_unknown`` adds
    ``other``, a map of the top-level keys that are not known here to their JSON text, which
    ``settings_json`` writes back.
    """
    value = F.try_parse_json(F.col(settings))

    def scalar(name: str, kind: str) -> Column:
        return F.coalesce(
            F.try_variant_get(F.col("_v"), f"$.{name}", kind), F.lit(V.SETTING_DEFAULTS[name])
        ).alias(name)

    def switches(category: str) -> Column:
        part = CATEGORIES[category]
        saved = F.try_variant_get(F.col("_v"), f"$.{part}", "map<string,boolean>")
        return merge_switches(saved, _DEFAULTS[category]).alias(part)

    known = [*V.SETTING_DEFAULTS, *CATEGORIES.values()]
    saved = F.try_variant_get(F.col("_v"), "$", "map<string,variant>")
    other = F.transform_values(F.map_filter(saved, lambda k, _: ~k.isin(known)), lambda _, v: F.to_json(v))
    none = F.create_map().cast("map<string,string>")
    keys = [c for c in table.columns if c != settings]
    return table.withColumn("_v", value).select(
        *keys,
        *([F.coalesce(other, none).alias("other")] if keep_unknown else []),
        switches(PII),
        switches(CREDENTIAL),
        scalar("language", "string"),
        scalar("confidence_threshold", "double"),
        scalar("scan_enabled", "boolean"),
        scalar("keep_history", "boolean"),
        F.greatest(F.lit(1), scalar("history_limit", "int")).alias("history_limit"),
    )


def set_switch(settings: DataFrame, category: str, name: str, value: bool) -> DataFrame:
    part = CATEGORIES[category]
    rest = F.map_filter(F.col(part), lambda k, v: k != name)
    return settings.withColumn(part, F.map_concat(rest, _literal_map({name: value})))


def set_category(settings: DataFrame, category: str, value: bool) -> DataFrame:
    part = CATEGORIES[category]
    return settings.withColumn(part, F.transform_values(F.col(part), lambda k, v: F.lit(value)))


def set_threshold_percent(settings: DataFrame, percent: int) -> DataFrame:
    return settings.withColumn("confidence_threshold", F.lit(percent / 100))


def set_history_limit(settings: DataFrame, limit: int) -> DataFrame:
    return settings.withColumn("history_limit", F.lit(max(1, int(limit))))


def entity_of(category: Column, name: Column) -> Column:
    """Switch name to entity code; null for an unknown credential name."""
    codes = {name: code for name, (code, _) in V.CREDENTIALS.items()}
    return F.when(category == CREDENTIAL, F.try_element_at(_literal_map(codes), name)).otherwise(
        name
    )


def policy_rows(settings: DataFrame, *keys: str) -> DataFrame:
    """One row per tenant and switch: keys, category, name, entity, enabled."""
    def tagged(category: str, part: str) -> Column:
        return F.transform_keys(F.col(part), lambda k, v: F.concat(F.lit(category + "\n"), k))

    one = [tagged(category, part) for category, part in CATEGORIES.items()]
    rows = settings.select(*keys, F.explode(F.map_concat(*one)).alias("_key", "enabled"))
    parts = F.split("_key", "\n", 2)
    rows = rows.select(*keys, parts.getItem(0).alias("category"), parts.getItem(1).alias("name"),
                       "enabled")
    return rows.withColumn("entity", entity_of(F.col("category"), F.col("name")))


def allow_list(settings: DataFrame, *keys: str) -> DataFrame:
    """Entities each tenant wants reported: enabled personal data and credentials."""
    def entities(category: str) -> Column:
        on = F.map_keys(F.map_filter(F.col(CATEGORIES[category]), lambda k, v: v))
        return F.transform(on, lambda name: entity_of(F.lit(category), name))

    # Told apart within a tenant's row first: one row per tenant and entity goes on.
    found = F.array_distinct(F.array_compact(F.concat(*[entities(category) for category in CATEGORIES])))
    return settings.select(*keys, F.explode(found).alias("entity")).distinct()


def enabled_counts(settings: DataFrame, *keys: str) -> DataFrame:
    """Detectors on, of how many, per tenant and category."""
    per_category = [
        F.struct(
            F.lit(category).alias("category"),
            F.size(F.map_filter(F.col(part), lambda k, v: v)).alias("enabled"),
            F.lit(len(_DEFAULTS[category])).alias("known"),
        )
        for category, part in CATEGORIES.items()
    ]
    rows = settings.select(*keys, F.inline(F.array(*per_category)))
    return rows.withColumn("all_enabled", F.col("enabled") == F.col("known"))


def settings_json(settings: DataFrame, *keys: str) -> DataFrame:
    """Typed settings, and unknown ones in ``other``, back to sorted JSON text, one row per tenant."""
    def ordered(part: str) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(part))))

    def inner(value: Column, names: int) -> Column:
        """JSON text without what encloses it: ``names`` characters before, one after."""
        return F.substring(value, names + 1, F.length(value) - names - 1)

    parts = {name: inner(F.to_json(F.struct(F.col(name).alias("v"))), 5) for name in V.SETTING_DEFAULTS}
    parts |= {part: ordered(part) for part in CATEGORIES.values()}
    pairs = F.map_from_arrays(F.array(*[F.lit(name) for name in parts]), F.array(*parts.values()))
    if "other" in settings.columns:
        pairs = F.map_concat(pairs, "other")
    members = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(
        inner(F.to_json(F.array(e["key"])), 1), F.lit(":"), e["value"]
    ))
    return settings.select(*keys, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("settings"))
