"""API-misuse rules: a rule is rows, so new checks are data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import signature_parts
from appfacts.session import local_table


@dataclass(frozen=True)
class Rule:
    """A call to one of ``callees`` whose arguments meet every condition.

    ``callees`` are whole signatures, or sub-signatures when ``by_sub_signature`` is set.  ``conditions`` maps an
    argument position to the (kind, value) pairs of which at least one has to be among the argument's values.
    """

    name: str
    message: str
    callees: tuple[str, ...]
    conditions: dict[int, list[tuple[str, str]]] = field(default_factory=dict, hash=False)
    by_sub_signature: bool = False


ECB_RULE = Rule(
    "ecb_cipher",
    "Using ECB mode!",
    tuple(K.CIPHER_GET_INSTANCE_SIGS),
    {0: [("string", s) for s in K.ECB_SCHEMES]},
)
VERIFIER_RULE = Rule(
    "allow_all_verifier", "Using wrong SSL hostname verification!", (K.SET_VERIFIER_SIG,), {1: [("string", K.ALLOW_ALL_VERIFIER)]}
)
HIDE_ICON_RULE = Rule(
    "hide_icon", "Hides the launcher icon.", (K.SET_COMPONENT_ENABLED_SUBSIG,), {2: [("int", "2")], 3: [("int", "1")]}, True
)
BUILT_IN_RULES = [ECB_RULE, VERIFIER_RULE, HIDE_ICON_RULE]


def rule_tables(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rules as a callee table and a condition table."""
    callees = local_table(
        spark,
        [(r.name, r.message, c, r.by_sub_signature, len(r.conditions)) for r in rules for c in r.callees],
        "rule string, message string, callee string, by_sub_sig boolean, n_conditions int",
    )
    conditions = local_table(
        spark,
        [(r.name, place, i, kind, value) for r in rules for place, i in enumerate(r.conditions) for kind, value in r.conditions[i]],
        "rule string, place int, arg_idx int, kind string, value string",
    )
    return callees, conditions


def match_rule_calls(call_sites: DataFrame, rules: list[Rule]) -> DataFrame:
    """Call sites whose callee a rule names, by whole signature or by sub-signature.

    With whole signatures only, the list also goes to the scan as a filter; sub-signatures are taken apart only when
    some rule needs them.  With both, a site is looked up in either list once and gets a row for each rule found.
    """
    callees, _ = rule_tables(call_sites.sparkSession, rules)
    exact = sorted({c for r in rules if not r.by_sub_signature for c in r.callees})
    if not any(r.by_sub_signature for r in rules):
        return call_sites.where(F.col("callee_sig").isin(exact)).withColumn("callee", F.col("callee_sig")).join(callees, "callee")
    sub = signature_parts("callee_sig")["sub_sig"]
    if not exact:
        return call_sites.withColumn("callee", sub).join(callees, "callee")
    listed = callees.groupBy("callee", "by_sub_sig").agg(F.collect_list(F.struct("rule", "message", "n_conditions")).alias("__rules"))
    whole, part = (
        F.broadcast(listed.where(F.col("by_sub_sig") == by).select(F.col("callee").alias(key), F.col("__rules").alias(out)))
        for by, key, out in ((False, "callee_sig", "__whole"), (True, "__sub", "__part"))
    )
    found = call_sites.withColumn("__sub", sub).join(whole, "callee_sig", "left").join(part, "__sub", "left")
    none = F.array().cast(listed.schema["__rules"].dataType)
    rules_of = F.concat(F.coalesce("__whole", none), F.coalesce("__part", none))
    return found.where("__whole is not null or __part is not null").select(*call_sites.columns, F.inline(rules_of))


#: Condition places that one whole number marks.
WORD = 62


def check_call_rules(call_sites: DataFrame, arg_values: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings: sites that break a rule.

    Both fact tables are cut down by the broadcast rule rows first; only candidate sites and candidate argument
    values meet in the shuffled join on the site key.
    """
    _, conditions = rule_tables(call_sites.sparkSession, rules)
    sites = match_rule_calls(call_sites, rules)
    hits = arg_values.join(conditions, ["arg_idx", "kind", "value"]).select("app_id", "site_id", "rule", "place")
    # Conditions met are marked as bits, which combine before the shuffle, in as many words as the longest rule needs.
    words = range(max((len(r.conditions) for r in rules), default=0) // WORD + 1)
    met = hits.groupBy("app_id", "site_id", "rule").agg(
        *[F.bit_or(F.expr(f"if(place div {WORD} = {w}, shiftleft(1L, place % {WORD}), 0L)")).alias(f"__w{w}") for w in words]
    )
    n_met = sum((F.bit_count(F.coalesce(f"__w{w}", F.lit(0))) for w in words), F.lit(0))
    return (
        sites.join(met, ["app_id", "site_id", "rule"], "left")
        .where(n_met == F.col("n_conditions"))
        .select("app_id", "site_id", "rule", "message", *[c for c in ("owner", "owner_sig", "component") if c in call_sites.columns])
        .distinct()
    )


def flagged_methods(findings: DataFrame, owner: str = "owner") -> DataFrame:
    """Methods that hold at least one finding."""
    return findings.select("app_id", "rule", owner).distinct()


def call_inventory(call_sites: DataFrame, signatures: list[str]) -> DataFrame:
    """Sites that call one of the given signatures; a listing, not a finding."""
    return call_sites.where(F.col("callee_sig").isin(signatures))


def merge_findings(*parts: DataFrame, keys: tuple[str, ...] = ("app_id", "site_id", "rule")) -> DataFrame:
    """Union of findings of several components; of equal keys the later part wins."""
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p)
    rest = [c for c in tagged.columns if c not in keys and c != "__part"]
    return (
        tagged.groupBy(*keys)
        .agg(F.max(F.struct("__part", *rest)).alias("__last"))
        .select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])
    )


class RuleBook:
    """Rules by name: rows, or a function over fact tables returning findings."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = {r.name: r for r in (BUILT_IN_RULES if rules is None else rules)}
        self.checks: dict[str, Callable[..., DataFrame]] = {}

    def register_rule(self, rule: Rule | Callable[..., DataFrame], name: str | None = None) -> None:
        if isinstance(rule, Rule):
            self.rules[rule.name] = rule
        else:
            self.checks[name or rule.__name__] = rule

    def check(self, call_sites: DataFrame, arg_values: DataFrame, **tables: DataFrame) -> DataFrame:
        """All findings of all rules and registered functions (columns app_id, site_id, rule, message)."""
        columns = ["app_id", "site_id", "rule", "message"]
        parts = [check_call_rules(call_sites, arg_values, list(self.rules.values())).select(columns)]
        parts += [fn(call_sites=call_sites, arg_values=arg_values, **tables).select(columns) for fn in self.checks.values()]
        return merge_findings(*parts)
