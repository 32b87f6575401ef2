"""API-misuse queries."""

from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.operators import rules as R
from appfacts.plans.registry import query


def _findings(f, rule):
    return R.check_call_rules(f["fx_call_sites"], f["fx_arg_values"], [rule])


_ECB = ", ".join(f"'{s}'" for s in K.ECB_SCHEMES)
_ECB_SQL = f"""
SELECT DISTINCT c.app_id, c.site_id, c.owner, 'Using ECB mode!' AS message
FROM fx_call_sites c JOIN fx_arg_values a ON a.app_id = c.app_id AND a.site_id = c.site_id
WHERE c.callee_sig LIKE 'Ljavax/crypto/Cipher;.getInstance:%' AND a.arg_idx = 0 AND a.kind = 'string' AND a.value IN ({_ECB})"""


@query("h1_ecb_cipher", _ECB_SQL)
def ecb_cipher(f):
    return _findings(f, R.ECB_RULE).drop("rule")


@query(
    "h2_allow_all_verifier",
    f"""
SELECT DISTINCT c.app_id, c.site_id, c.owner, 'Using wrong SSL hostname verification!' AS message
FROM fx_call_sites c JOIN fx_arg_values a ON a.app_id = c.app_id AND a.site_id = c.site_id
WHERE c.callee_sig LIKE '%setHostnameVerifier%' AND a.arg_idx = 1 AND a.value = '{K.ALLOW_ALL_VERIFIER}'""",
)
def allow_all_verifier(f):
    return _findings(f, R.VERIFIER_RULE).drop("rule")


@query(
    "h3_hide_icon",
    """
SELECT DISTINCT c.app_id, c.owner
FROM fx_call_sites c
JOIN fx_arg_values a ON a.app_id = c.app_id AND a.site_id = c.site_id AND a.arg_idx = 2 AND a.kind = 'int' AND a.value = '2'
JOIN fx_arg_values b ON b.app_id = c.app_id AND b.site_id = c.site_id AND b.arg_idx = 3 AND b.kind = 'int' AND b.value = '1'
WHERE c.callee_sig LIKE '%.setComponentEnabledSetting:%'""",
)
def hide_icon(f):
    return R.flagged_methods(_findings(f, R.HIDE_ICON_RULE)).drop("rule")


@query(
    "h4_log_calls",
    "SELECT app_id, site_id, owner, callee_sig FROM fx_call_sites WHERE callee_sig LIKE 'Landroid/util/Log;.i:%'",
)
def log_calls(f):
    return R.call_inventory(f["fx_call_sites"], [K.LOG_INFO_SIG]).select("app_id", "site_id", "owner", "callee_sig")


@query(
    "h5_merged_findings",
    f"""
SELECT app_id, 'allow_all_verifier' AS rule, COUNT(DISTINCT c.site_id) AS n_sites
FROM fx_call_sites c JOIN fx_arg_values a USING (app_id, site_id)
WHERE c.callee_sig LIKE '%setHostnameVerifier%' AND a.arg_idx = 1 AND a.value = '{K.ALLOW_ALL_VERIFIER}' GROUP BY 1
UNION ALL SELECT app_id, 'ecb_cipher', COUNT(DISTINCT site_id) FROM ({_ECB_SQL}) GROUP BY 1
UNION ALL SELECT c.app_id, 'hide_icon', COUNT(DISTINCT c.site_id)
FROM fx_call_sites c
JOIN fx_arg_values a ON a.app_id = c.app_id AND a.site_id = c.site_id AND a.arg_idx = 2 AND a.value = '2'
JOIN fx_arg_values b ON b.app_id = c.app_id AND b.site_id = c.site_id AND b.arg_idx = 3 AND b.value = '1'
WHERE c.callee_sig LIKE '%.setComponentEnabledSetting:%' GROUP BY 1""",
)
def merged_findings(f):
    """Findings of all rules in one pass, merged per app."""
    book = R.RuleBook()
    return book.check(f["fx_call_sites"], f["fx_arg_values"]).groupBy("app_id", "rule").agg(F.count(F.lit(1)).alias("n_sites"))
