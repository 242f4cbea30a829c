"""A rule engine: rules are rows of a table, in SQL, and one function judges them all."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import AuditConfig

#: What a result tells besides its status, with types; a rule gives SQL for some of it.
EVIDENCE = {"context_level": "string", "reference_count": "bigint", "reference_median": "double", "reference_mad": "double", "robust_z": "double", "fold_change": "double", "value_at_risk": "double"}
#: Fields of a result.
FIELDS = ("tier", "rule", "status", "reason", "context_level", "observed_value", "reference_count", "reference_median", "reference_mad", "robust_z", "fold_change", "value_at_risk", "severity")


class Rule(NamedTuple):
    """skip: reasons not to apply it, with their conditions, in order. Without a severity of its own a hit is graded by its value at risk."""

    tier: str
    name: str
    hit: str
    severity: str | None = None
    skip: dict[str, str] = {}
    observed: str = "null"
    evidence: dict[str, str] = {}
    #: Tables of reference that have to be joined for it.
    needs: frozenset[str] = frozenset()
    #: Types of record that it applies to, if it needs a reference.
    kinds: tuple[str, ...] = ()


def finite_sql(x: str) -> str:
    """A number, or null where it is none or not finite."""
    return f"nullif(nullif(nullif(cast({x} as double), double('NaN')), double('Infinity')), double('-Infinity'))"


def grade_sql(value: str, limits: AuditConfig) -> str:
    return f"case when {value} >= {limits.severity_high}D then 'high' when {value} >= {limits.severity_medium}D then 'medium' else 'low' end"


def out_of_scope(rule: Rule) -> Rule:
    """The rule as it is for rows of no type that it applies to: nothing but the reason."""
    return Rule(rule.tier, rule.name, "false", skip={"outside_scope": "true"})


def raw_sql(rule: Rule) -> str:
    """What the row says about a rule: why it doesn't apply, whether it would hit, and the evidence."""
    told = {n: f"cast({rule.evidence.get(n, 'null')} as {kind})" for n, kind in EVIDENCE.items()}
    why = "case " + " ".join(f"when {condition} then '{reason}'" for reason, condition in rule.skip.items()) + " end" if rule.skip else "cast(null as string)"
    fixed = f"'{rule.severity}'" if rule.severity else "null"
    own = {"tier": f"'{rule.tier}'", "rule": f"'{rule.name}'", "why": why, "hit": f"coalesce({rule.hit}, false)", "observed": f"cast({rule.observed} as double)", "fixed": f"cast({fixed} as string)"} | told
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in own.items()) + ")"


def result_sql(limits: AuditConfig) -> str:
    """The result that follows from a raw struct c, the same for every rule."""
    told = {n: f"case when c.why is null then {finite_sql(f'c.{n}') if kind == 'double' else f'c.{n}'} end" for n, kind in EVIDENCE.items()}
    field = told | {
        "tier": "c.tier", "rule": "c.rule", "reason": "c.why", "observed_value": finite_sql("c.observed"),
        "status": "case when c.why is not null then 'not_applied' when c.hit then 'flagged' else 'not_flagged' end",
        "severity": f"case when c.why is null and c.hit then coalesce(c.fixed, {grade_sql(finite_sql('c.value_at_risk'), limits)}) end",
    }
    return "named_struct(" + ", ".join(f"'{n}', {field[n]}" for n in FIELDS) + ")"


def judged(rows: DataFrame, rules: tuple[Rule, ...], limits: AuditConfig, results: str = "check_results") -> DataFrame:
    """rows with an array of each rule's result, in order; a condition that is unknown doesn't hold.

    It is one column and no more: the optimizer carries conditions on a result through every named step, and many steps would multiply them.
    """
    return rows.withColumn(results, F.expr(f"transform(array({', '.join(map(raw_sql, rules))}), c -> {result_sql(limits)})"))
