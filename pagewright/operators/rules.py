"""Domain rules and auth profiles applied to request rows by equi-joins on host keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.functions.urls import domain_keys, domain_matches, host


def header_rule_keys(rules: DataFrame) -> DataFrame:
    """(rule_no, domain, header, value) of `rules(rule_no, domains, values)`."""
    return rules.select("rule_no", F.explode("domains").alias("domain"), "values").select(
        "rule_no", F.lower("domain").alias("domain"), F.explode("values").alias("header", "value"))


def host_headers(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, header, value): headers of every host; the last matching rule wins per header.

    Hosts are expanded to the few rule keys that can match them, so the domain match is an
    equi-join however many rules there are.
    """
    keyed = hosts.select("host").distinct().select("host", F.explode(domain_keys("host")).alias("domain"))
    return keyed.join(header_rule_keys(rules), "domain").groupBy("host", "header").agg(
        F.max_by("value", "rule_no").alias("value"))


def apply_header_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """`requests(request_id, url, headers)` with rule headers merged in; request headers win.

    Rules are resolved once per distinct host, not per request; requests meet one row per host,
    and a host with very many requests is split by adaptive skew handling.
    """
    named = requests.withColumn("_host", host("url"))
    per_host = host_headers(named.select(F.col("_host").alias("host")).filter("host <> ''"), rules).groupBy(
        F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("header", "value"))).alias("_rule"))
    empty = F.create_map().cast("map<string,string>")
    own, ruled = F.coalesce("headers", empty), F.coalesce("_rule", empty)
    merged = F.map_concat(F.map_filter(ruled, lambda k, _: ~F.map_contains_key(own, k)), own)
    return named.join(per_host, "_host", "left").withColumn("headers", merged).select(*requests.columns)


def apply_auth_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with the header of their profile set, and `code` where the profile cannot be used.

    `requests(request_id, url, auth_profile, headers)`; `profiles(name, header, value,
    value_prefix, domains)`. A request without a profile passes unchanged.
    """
    known = profiles.select(F.col("name").alias("auth_profile"), "header", "value", "value_prefix",
                            "domains", F.lit(True).alias("_known"))
    joined = requests.join(known, "auth_profile", "left").withColumn("_host", host("url"))
    allowed = F.exists("domains", lambda d: domain_matches(d, F.col("_host")))
    wants = F.col("auth_profile").isNotNull()
    code = F.when(wants & F.col("_known").isNull(), "AUTH_PROFILE_NOT_FOUND").when(
        wants & ~F.coalesce(allowed, F.lit(False)), "AUTH_PROFILE_DOMAIN_MISMATCH")
    value = F.concat(F.coalesce("value_prefix", F.lit("")), F.col("value"))
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    with_auth = F.map_concat(F.map_filter(own, lambda k, _: k != F.col("header")), F.create_map("header", value))
    usable = wants & code.isNull() & F.col("value").isNotNull()
    return joined.withColumn("headers", F.when(usable, with_auth).otherwise(own)).withColumn("code", code).select(
        *requests.columns, "code")
