"""Label, family and stage lookups as column expressions.

The tables are fixed and small (tens of entries), so they are literal maps inside the plan
instead of joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast import fixed_values as fv


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL when absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _spelling(label: Column) -> Column:
    return lookup(fv.LABEL_SPELLINGS, label)


def dataset_label_or_null(label: Column) -> Column:
    """Canonical label of a dataset row, NULL when the spelling is not known."""
    dashed = F.btrim(F.translate(label, "\x96–", "--"), F.lit(" \t\n\r\f\x0b"))
    clean = F.regexp_replace(dashed, r"(?i)\s*-\s*Attempted$", "")
    return F.coalesce(_spelling(clean), _spelling(F.lower(clean)))


def dataset_label(label: Column) -> Column:
    """Canonical label of a dataset row; missing and unknown spellings count as BENIGN."""
    return F.coalesce(dataset_label_or_null(label), F.lit("BENIGN"))


def timeline_label(label: Column) -> Column:
    """Canonical label of a reviewed interval, in any letter case; NULL when not known."""
    clean = F.btrim(label, F.lit(" \t\n\r\f\x0b"))
    lowered = {key.lower(): value for key, value in fv.LABEL_SPELLINGS.items()}
    return F.coalesce(_spelling(clean), lookup(lowered, F.lower(clean)))


def label_family(label: Column) -> Column:
    return lookup(fv.LABEL_FAMILIES, label)


def label_stage(label: Column) -> Column:
    """Campaign stage 0..5 of a label; raw dataset spellings are recognised by their wording."""
    value = F.btrim(label, F.lit(" \t\n\r\f\x0b"))
    words = F.translate(F.lower(value), " -", "__")
    by_family = lookup(fv.FAMILY_STAGES, label_family(value))
    by_wording = (
        F.when(words.contains("portscan"), 1)
        .when(words.contains("patator") | words.contains("web_") | words.contains("heartbleed"), 2)
        .when(words.contains("infiltration"), 3)
        .when(words.contains("bot"), 4)
        .when(words.contains("dos"), 5)
        .otherwise(0)
    )
    return F.when(F.upper(value) == "BENIGN", F.lit(0)).otherwise(F.coalesce(by_family, by_wording))


def label_severity(label: Column) -> Column:
    """0 benign, 1 scan, 2 credential or web attack, 3 anything heavier."""
    return (
        F.when(label == "BENIGN", 0)
        .when(label.contains("PortScan"), 1)
        .when(label.contains("Patator") | label.contains("BruteForce") | label.contains("Web"), 2)
        .otherwise(3)
    )


def stage_name(stage: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in fv.STAGES]), stage)


def stage_attack_type(stage: Column) -> Column:
    return F.coalesce(lookup(fv.STAGE_ATTACK_TYPES, stage), F.lit("UNKNOWN"))


def stage_candidates(stage: Column) -> Column:
    """Labels compatible with a stage, with their ATT&CK reference; an empty list for other stages."""

    def candidate(row: tuple) -> Column:
        names = ("label", "family", "tactic", "technique_id", "technique")
        return F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)])

    nothing = F.slice(F.array(candidate(fv.ATTACK_REFERENCE[0])), 1, 0)
    result = None
    for name, families in fv.STAGE_FAMILIES.items():
        rows = F.array(*[candidate(row) for row in fv.ATTACK_REFERENCE if row[1] in families])
        result = F.when(stage == name, rows) if result is None else result.when(stage == name, rows)
    return result.otherwise(nothing)
