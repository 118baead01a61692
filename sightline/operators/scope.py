"""Scope and policy decisions over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import canon, net
from sightline.functions.bind import let, trim_ws
from sightline.functions.grades import mode_rank
from sightline.operators.canonicalise import canonicalise
from sightline.operators.netjoin import NET, best_prefix, masked, suffix_pairs, with_prefix
from sightline.operators.skew import attach

NO_RULE = "no-allow-rule"


def _decide(df: DataFrame, found: DataFrame, key: str, missing: str = NO_RULE) -> DataFrame:
    """Attach the winning rule per distinct value; default deny."""
    out = attach(df, found, key)
    return (out.withColumn("allowed", F.coalesce(F.col("__w.allow"), F.lit(False)))
            .withColumn("rule", F.coalesce(F.col("__w.rule"), F.lit(missing)))
            .withColumn("matched", F.coalesce(F.col("__w.pattern"), F.lit("")))
            .withColumn("out_of_scope", ~F.col("allowed")).drop("__w"))


def _canonical_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Rules with ``pattern`` in the canonical form of ``kind``. A rule without one stops the job: dropped silently, it would widen access."""
    c = canonicalise(rules.withColumn("__kind", F.lit(kind)), "__kind", "pattern", [kind])
    bad = F.raise_error(F.concat(F.lit(f"not a valid {kind} rule: "), F.coalesce("pattern", F.lit("NULL")))).cast("string")
    return c.withColumn("pattern", F.coalesce("canonical", bad)).drop("__kind", "canonical", "entity_id", "reject_reason")


def _prefix_rules(rules: DataFrame) -> DataFrame:
    p = trim_ws(F.col("pattern"))
    bad = F.raise_error(F.concat(F.lit("not a valid cidr rule: "), F.coalesce("pattern", F.lit("NULL")))).cast("string")
    return rules.withColumn("pattern", F.when(p.contains("/") & net.prefix_struct(p).isNotNull(), p).otherwise(bad))


def domain_rules(rules: DataFrame) -> DataFrame:
    """(action, pattern) to suffix-joinable rules: ``*.x`` and ``.x`` mean strictly below x."""
    p = F.lower(trim_ws(F.col("pattern")))
    marked = rules.withColumn("__mark", F.regexp_extract(p, "^(\\*?\\.)", 1)).withColumn("pattern", F.regexp_replace(p, "^\\*?\\.", ""))
    c = _canonical_rules(marked, "domain")
    below, deny = F.col("__mark") != "", F.col("action") == "deny"
    return c.select(
        F.col("pattern").alias("suffix"), below.alias("below"), (~deny).alias("allow"), F.concat("__mark", "pattern").alias("pattern"),
        # deny exact, deny suffix, allow exact, allow suffix
        (F.when(deny, 0).otherwise(2) + below.cast("int")).alias("precedence"))


def scope_domains(df: DataFrame, rules: DataFrame, deny_regex: Sequence[str] = (), col: str = "value") -> DataFrame:
    """allowed / rule / matched / out_of_scope per host name.

    Deny regex, then deny exact, deny suffix, allow exact, allow suffix, else deny. Names
    are exploded into their label suffixes and meet the rules on equality. The regexes
    are a handful of configuration patterns and sit in the projection.
    """
    compiled = domain_rules(rules)
    pairs = suffix_pairs(df, col, compiled).where(F.col("below") == (F.col("depth") > 0))
    best = pairs.groupBy(col).agg(F.min_by(
        F.struct("allow", F.when(F.col("allow"), "allow.domains").otherwise("deny.domains").alias("rule"), "pattern"),
        F.struct("precedence", "depth")).alias("__w"))
    out = _decide(df, best, col)
    for rx in deny_regex:
        hit = F.col(col).rlike(rx)
        out = (out.withColumn("rule", F.when(hit, "deny.regex").otherwise(F.col("rule")))
               .withColumn("matched", F.when(hit, F.lit(rx)).otherwise(F.col("matched")))
               .withColumn("allowed", F.col("allowed") & ~hit).withColumn("out_of_scope", F.col("out_of_scope") | hit))
    return out


def scope_ips(df: DataFrame, rules: DataFrame, col: str = "value") -> DataFrame:
    """``rules``: (action, pattern cidr). Containment in a deny prefix wins; then the most specific allow."""
    r = _prefix_rules(rules).withColumn("allow", F.col("action") == "allow")
    best = best_prefix(df, col, r, "pattern", ["allow", "pattern"], ~F.col("allow"))
    named = best.select(col, F.struct("allow", F.when(F.col("allow"), "allow.cidrs").otherwise("deny.cidrs").alias("rule"), "pattern").alias("__w"))
    return _decide(df, named, col)


def scope_cidrs(df: DataFrame, rules: DataFrame, col: str = "value") -> DataFrame:
    """A prefix is denied when it overlaps a deny rule, allowed only when an allow rule contains it.

    Two prefixes overlap exactly when one contains the other, so both directions are
    equi-joins on a masked key: targets masked to rule lengths, rules masked to target lengths.
    """
    r = with_prefix(_prefix_rules(rules), "pattern").select("action", "pattern", *NET)
    t = with_prefix(df.select(col).where(F.col(col).isNotNull()).distinct(), col)
    rule_lengths = F.broadcast(r.select("family", F.col("bits").alias("rbits")).distinct())    # at most 162 rows
    probes = t.join(rule_lengths, "family").where("rbits <= bits").select(
        col, "family", F.col("rbits").alias("bits"), F.col("net_hi").alias("hi"), F.col("net_lo").alias("lo"))
    inside = masked(probes, "hi", "lo").join(r, NET).select(col, "action", "pattern", F.col("bits").alias("rbits"))
    target_lengths = F.broadcast(t.select("family", F.col("bits").alias("tbits")).distinct())  # at most 162 rows
    wide = r.where("action = 'deny'").join(target_lengths, "family").where("tbits < bits").select(
        "action", "pattern", F.col("bits").alias("rbits"), "family", F.col("tbits").alias("bits"),
        F.col("net_hi").alias("hi"), F.col("net_lo").alias("lo"))
    around = masked(wide, "hi", "lo").join(t, NET).select(col, "action", "pattern", "rbits")
    pairs = inside.unionByName(around).withColumn("allow", F.col("action") == "allow")
    best = pairs.groupBy(col).agg(F.min_by(
        F.struct("allow", F.when(F.col("allow"), "allow.cidrs").otherwise("deny.cidrs").alias("rule"), "pattern"),
        F.struct("allow", -F.col("rbits"), "pattern")).alias("__w"))
    return _decide(df, best, col)


def _invalid(df: DataFrame, ok: Column) -> DataFrame:
    """Rows that are not of their kind are denied as such; they are no target, in scope or out."""
    bad = ~F.coalesce(ok, F.lit(False))
    return (df.withColumn("allowed", F.col("allowed") & ~bad).withColumn("rule", F.when(bad, "invalid").otherwise(F.col("rule")))
            .withColumn("matched", F.when(bad, "").otherwise(F.col("matched"))).withColumn("out_of_scope", F.col("out_of_scope") & ~bad))


def _equal_rules(df: DataFrame, key: Column, rules: DataFrame, rule: str, kind: str) -> DataFrame:
    r = _canonical_rules(rules, kind).groupBy(F.col("pattern").alias("__k")).agg(F.lit(True).alias("allow"))
    found = r.select("__k", F.struct("allow", F.lit(rule).alias("rule"), F.col("__k").alias("pattern")).alias("__w"))
    return _decide(df.withColumn("__k", key), found, "__k").drop("__k")


def scope_asns(df: DataFrame, rules: DataFrame, col: str = "value") -> DataFrame:
    number = canon.asn(trim_ws(F.col(col)))
    return _invalid(_equal_rules(df, number, rules, "allow.asns", "asn"), number.isNotNull())


def scope_net(df: DataFrame, cidr_rules: DataFrame, asn_rules: DataFrame, type_col: str = "type",
              col: str = "value") -> DataFrame:
    """ip, cidr and asn rows of a mixed table, each by its own rule."""
    t, v = F.col(type_col), F.col(col)
    return (_invalid(scope_ips(df.where(t == "ip"), cidr_rules, col), canon.ip(v).isNotNull())
            .unionByName(_invalid(scope_cidrs(df.where(t == "cidr"), cidr_rules, col), canon.cidr(v).isNotNull()))
            .unionByName(scope_asns(df.where(t == "asn"), asn_rules, col)))


def url_host(col: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(col, "^(?s).*?://", ""), "(?s)[/?#].*$", "")
    return F.lower(F.when(h.startswith("["), F.regexp_extract(h, "^\\[([^\\]]+)\\]", 1))
                   .otherwise(F.regexp_replace(h, "(?<=.):[0-9]+$", "")))


def scope_urls(df: DataFrame, rules: DataFrame, prefixes: Sequence[str], deny_regex: Sequence[str] = (),
               col: str = "value") -> DataFrame:
    """Host first, deny regexes included; then, when path prefixes are declared, one of them has to start the URL.

    The prefixes are configuration and are compared in canonical form; one without a canonical form stops the job.
    """
    out = scope_domains(df.withColumn("__host", url_host(F.col(col))), rules, deny_regex, "__host").drop("__host")
    host_ok = F.col("allowed")
    hit = F.lit("").cast("string")
    for p in reversed(list(prefixes)):
        whole = F.coalesce(canon.url(F.lit(p.strip())), F.raise_error(F.lit(f"not a valid url prefix: {p}")).cast("string"))
        hit = F.when(F.col(col).startswith(whole), whole).otherwise(hit)
    out = out.withColumn("__hit", hit)
    need = bool(prefixes)
    rule = (F.when(~host_ok, "allow.domains (via url host)").when(F.lit(not need), F.col("rule"))
            .when(F.col("__hit") != "", "allow.url_prefixes").otherwise("no-url-prefix"))
    out = out.withColumn("rule", rule).withColumn("matched", F.when(host_ok & F.lit(need), F.col("__hit")).otherwise(F.col("matched")))
    return (out.withColumn("allowed", host_ok & ((F.col("__hit") != "") | F.lit(not need)))
            .withColumn("out_of_scope", ~F.col("allowed")).drop("__hit"))


def scope_emails(df: DataFrame, rules: DataFrame, col: str = "value") -> DataFrame:
    out = _equal_rules(df, F.regexp_extract(F.col(col), "@([^@]*)$", 1), rules, "allow.email_domains", "domain")
    return _invalid(out, F.col(col).contains("@"))


def scope_orgs(df: DataFrame, orgs: Sequence[str], col: str = "value") -> DataFrame:
    """Allowed when the name contains a listed organisation or the other way round.

    The list is configuration; the first match in list order is reported. A blank name is invalid: every entry contains it.
    """
    def pick(n: Column) -> Column:
        out = F.lit("")
        for o in reversed([x.strip().lower() for x in orgs if x.strip()]):
            out = F.when(n.contains(o) | F.lit(o).contains(n), o).otherwise(out)
        return out
    named = F.coalesce(trim_ws(F.col(col)), F.lit("")) != ""
    out = (df.withColumn("matched", F.when(named, let(F.lower(trim_ws(F.col(col))), pick)).otherwise(""))
           .withColumn("allowed", F.col("matched") != "")
           .withColumn("rule", F.when(F.col("allowed"), "allow.orgs").otherwise(NO_RULE))
           .withColumn("out_of_scope", ~F.col("allowed")))
    return _invalid(out, named)


NETWORK_TYPES = ["domain", "subdomain", "ip", "cidr", "asn", "url", "email", "org"]
DECISION = ["allowed", "rule", "matched", "out_of_scope"]


def scope_other(df: DataFrame, domain_rules_: DataFrame, url_prefixes: Sequence[str], mail_rules: DataFrame,
                orgs: Sequence[str], type_col: str = "type", col: str = "value", deny_regex: Sequence[str] = ()) -> DataFrame:
    """url, email and org rows by rule; types without a network target pass, blank values and unknown or missing types are denied."""
    t = F.col(type_col)
    cols = [*df.columns, *DECISION]
    blank = F.coalesce(trim_ws(F.col(col)), F.lit("")) == ""
    passing = t.isin([x for x in fixed.ENTITY_TYPES if x not in NETWORK_TYPES])
    rest = (df.where(~F.coalesce(t.isin(NETWORK_TYPES), F.lit(False))).withColumn("allowed", F.coalesce(passing, F.lit(False)))
            .withColumn("rule", F.when(F.col("allowed"), "not-network-target").otherwise("unknown-type")).withColumn("matched", F.lit(""))
            .withColumn("out_of_scope", F.lit(False)))
    out = _invalid(rest, ~blank).select(*cols)
    for part in (_invalid(scope_urls(df.where(t == "url"), domain_rules_, url_prefixes, deny_regex, col), ~blank),
                 scope_emails(df.where(t == "email"), mail_rules, col), scope_orgs(df.where(t == "org"), orgs, col)):
        out = out.unionByName(part.select(*cols))
    return out


@dataclass(frozen=True)
class ScopeRules:
    """All rules of a scope. Tables: domains and cidrs (action, pattern), asns and mail_domains (pattern)."""

    domains: DataFrame
    cidrs: DataFrame
    asns: DataFrame
    mail_domains: DataFrame
    url_prefixes: Sequence[str] = ()
    orgs: Sequence[str] = ()
    deny_regex: Sequence[str] = ()


def scope_all(df: DataFrame, rules: ScopeRules, type_col: str = "type", col: str = "value") -> DataFrame:
    """One decision for every row of a mixed table of canonical values: allowed, rule, matched, out_of_scope. Default deny."""
    t = F.col(type_col)
    cols = [*df.columns, *DECISION]
    blank = F.coalesce(trim_ws(F.col(col)), F.lit("")) == ""
    names = _invalid(scope_domains(df.where(t.isin("domain", "subdomain")), rules.domains, rules.deny_regex, col), ~blank)
    other = scope_other(df.where(~F.coalesce(t.isin("domain", "subdomain", "ip", "cidr", "asn"), F.lit(False))), rules.domains, rules.url_prefixes,
                        rules.mail_domains, rules.orgs, type_col, col, rules.deny_regex)
    return (names.select(*cols).unionByName(scope_net(df, rules.cidrs, rules.asns, type_col, col).select(*cols)).unionByName(other.select(*cols)))


# --- engagement and policy ---------------------------------------------------------------


@dataclass(frozen=True)
class Engagement:
    engagement_id: str = ""
    authorized_by: str = ""
    valid_from: str | None = None
    valid_until: str | None = None
    allowed_modes: Sequence[str] = ()


@dataclass(frozen=True)
class Policy:
    """Requirements per sensitivity level 0..2 and the ban and purpose lists."""

    deny_modules: Sequence[str] = ()
    allowed_purposes: Sequence[str] = ()
    default_purpose: str = ""
    default_case: str = ""
    require: dict = field(default_factory=lambda: {1: ["case"], 2: ["case", "purpose", "approval"]})
    approvers: Sequence[str] = ("lead", "admin")


def engagement_reason(mode: Column, at: Column, e: Engagement) -> Column:
    """NULL when the engagement allows ``mode`` (a rank column) at ``at``, else why not."""
    lo = F.lit(e.valid_from).cast("timestamp") if e.valid_from else None
    hi = F.lit(e.valid_until).cast("timestamp") if e.valid_until else None
    ranks = [["passive", "semi-active", "active"].index(m) for m in e.allowed_modes]
    out = F.when(F.lit(False), "")
    if not e.engagement_id:
        out = out.when(mode > 0, "no engagement id")
    if not e.authorized_by:
        out = out.when(mode > 0, "no authoriser")
    if lo is not None:
        out = out.when(at < lo, "not yet valid")
    if hi is not None:
        out = out.when(at > hi, "expired")
    if not ranks:
        return out.when(mode > 0, "no allowed modes")
    return out.when((mode > 0) & (mode > max(ranks)), "mode not allowed")


def authorisation(df: DataFrame, e: Engagement, mode_col: str = "mode", at_col: str = "at") -> DataFrame:
    reason = engagement_reason(mode_rank(F.col(mode_col)), F.col(at_col), e)
    return df.withColumn("reason", reason).withColumn("permitted", F.col("reason").isNull())


def _requires(level: Column, policy: Policy, what: str) -> Column:
    return level.isin([k for k, v in policy.require.items() if what in v] or [-1])


def authorise(requests: DataFrame, policy: Policy, approvals: DataFrame, e: Engagement) -> DataFrame:
    """First failing rule per request, ``policy-ok`` when none fails.

    ``requests``: (request_id, module, sensitivity, mode, ceiling, case_id, purpose, actor,
    allow_active, at); ``approvals``: one row per request id with granted_by array,
    granted_at, expires_at, revoked.
    """
    j = requests.join(approvals, "request_id", "left")  # a request id is unique
    s, at, actor = F.col("sensitivity"), F.col("at"), F.col("actor")
    blank = lambda c, d: F.coalesce(F.when(trim_ws(c) != "", trim_ws(c)), F.lit(d))
    purpose, case_id = blank(F.col("purpose"), policy.default_purpose), blank(F.col("case_id"), policy.default_case)
    low = F.lower(purpose)
    known = F.lit(not policy.allowed_purposes)
    for p in (x.strip().lower() for x in policy.allowed_purposes if x.strip()):
        known = known | (low == p) | low.startswith(p + " ") | low.startswith(p + ":") | low.startswith(p + ",")
    active = (~F.coalesce("revoked", F.lit(False)) & F.col("granted_at").isNotNull()
              & (F.col("expires_at").isNull() | (at <= F.col("expires_at"))) & (F.size("granted_by") > 0))
    wants_approval = _requires(s, policy, "approval")
    role_ok = F.exists("granted_by", lambda g: F.lower(g).isin([a.lower() for a in policy.approvers])) \
        if policy.approvers else F.lit(True)
    mode, ceiling = mode_rank(F.col("mode")), mode_rank(F.col("ceiling"))
    can_probe = F.lit("active" in e.allowed_modes)
    rule = (F.when(F.lower("module").isin([m.strip().lower() for m in policy.deny_modules] or [""]), "deny_modules")
            .when(_requires(s, policy, "purpose") & (purpose == ""), "missing-purpose")
            .when(_requires(s, policy, "purpose") & ~known, "purpose-not-allowed")
            .when(_requires(s, policy, "case") & (case_id == ""), "missing-case")
            .when(wants_approval & ~F.coalesce(active, F.lit(False)), "approval-required")
            .when(wants_approval & F.array_contains("granted_by", actor), "four-eyes")
            .when(wants_approval & ~role_ok, "approver-role")
            .when(mode > ceiling, "mode-ceiling")
            .when(engagement_reason(ceiling, at, e).isNotNull(), "authorization")
            .when((mode == 2) & ~F.col("allow_active"), "active-flag")
            .when((mode == 2) & ~can_probe, "active-not-authorized")
            .otherwise("policy-ok"))
    return j.withColumn("rule", rule).withColumn("allowed", F.col("rule") == "policy-ok").select(
        *requests.columns, "rule", "allowed")
