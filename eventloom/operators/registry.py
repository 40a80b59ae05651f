"""Company and exposure dimensions: building, query coverage, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import company_id, display_name, identity_key, nfkc_casefold, query_key, short_ascii, source_name, stripped


def build_companies(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """A4: names(pos, name), aliases(identity, terms, pos) -> company rows; alias rules are inherited by normalised identity, the first in order of pos."""
    parsed = names.withColumn("n", source_name(F.col("name"))).where("NOT n.malformed").select("pos", "name", F.col("n.current").alias("legal_name"), F.col("n.former").alias("former_name"))
    made = parsed.withColumn("identity", identity_key(F.col("legal_name"))).withColumn("display_name", display_name(F.col("legal_name"))).withColumn("company_id", company_id(F.col("legal_name")))
    rules = aliases.groupBy("identity").agg(F.min_by("terms", "pos").alias("alias_terms"))
    out = made.join(rules, "identity", "left")
    terms = F.filter(F.concat(F.array("display_name", "former_name"), F.coalesce("alias_terms", F.array().cast("array<string>"))), lambda t: t.isNotNull() & (F.trim(t) != ""))
    return out.withColumn("terms", F.array_distinct(terms)).withColumn("short_name", short_ascii(F.col("display_name"))).withColumn("matched", F.col("alias_terms").isNotNull()).drop("alias_terms")


def build_profile(companies: DataFrame) -> DataFrame:
    """I13."""
    twice = companies.groupBy("identity").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_names"))
    one = companies.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("former_name").isNotNull()).alias("former_names"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if("short_name").alias("short_names"), F.count_if(F.size("terms") == 1).alias("single_term"))
    return one.withColumn("_k", F.lit(1)).join(twice.withColumn("_k", F.lit(1)), "_k").drop("_k")


def query_owners(companies: DataFrame) -> DataFrame:
    """companies(pos, company_id, search_terms) -> distinct query keys with first shown form and owners, in registry order."""
    terms = companies.select("pos", "company_id", F.posexplode("search_terms").alias("i", "term")).withColumn("query_key", query_key(F.col("term"))).where("query_key <> ''")
    owners = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "company_id"))), lambda s: s["company_id"]))
    return terms.groupBy("query_key").agg(F.min_by("term", F.struct("pos", "i")).alias("display_query"), owners.alias("company_ids"))


def uncovered(companies: DataFrame, owners: DataFrame) -> DataFrame:
    """E2."""
    return companies.select("company_id").join(owners.select(F.explode("company_ids").alias("company_id")), "company_id", "left_anti")


def exposure_links(exposure_terms: DataFrame) -> DataFrame:
    """exposure_terms(company, exposure_id, query_term, valid_from, families) -> links by query key."""
    keyed = exposure_terms.withColumn("query_key", query_key(F.col("query_term")))
    return keyed.groupBy("query_key").agg(F.array_sort(F.collect_set(F.struct("company", "exposure_id", "valid_from"))).alias("links"))


def union_queries(routes: list[DataFrame]) -> DataFrame:
    """Route tables (pos, query) in order -> first occurrence of each key."""
    every = routes[0].withColumn("route_order", F.lit(0))
    for k, r in enumerate(routes[1:], 1):
        every = every.unionByName(r.withColumn("route_order", F.lit(k)))
    return every.withColumn("query_key", query_key(F.col("query"))).groupBy("query_key").agg(F.min_by("query", F.struct("route_order", "pos")).alias("query"), F.min("route_order").alias("route_order"))


def hashed_sample(rows: DataFrame, key: str, n: int, namespace: str) -> DataFrame:
    """E5: the n rows whose hashed key is smallest, in any input order."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{namespace}|"), F.col(key)), 256), key).limit(n)


#: Fixed value: pattern of company ids.
COMPANY_ID = "^[a-z0-9][a-z0-9-]{7,63}$"


def dimension_faults(companies: DataFrame, declared: int | None = None) -> DataFrame:
    """M1–M4: companies(company_id, name, terms) -> (check, key) of every fault; declared: the number of companies that the source tells. A term belongs to the company that has its identity key (B7), so
    that a legal form makes no difference; terms of one company are unequal after folding."""
    fault = lambda df, name, key: df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
    ids = companies.groupBy("company_id").count().where("count > 1")
    identities = companies.withColumn("identity", identity_key(F.col("name"))).groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR identity = ''")
    terms = companies.select("company_id", F.explode("terms").alias("term")).withColumn("term_key", stripped(nfkc_casefold(F.col("term")))).withColumn("identity", identity_key(F.col("term")))
    shared = terms.groupBy("identity").agg(F.count_distinct("company_id").alias("n")).where("n > 1").withColumnRenamed("identity", "term_key")
    repeated = terms.groupBy("company_id", "term_key").count().where("count > 1 OR term_key = ''").select("company_id").distinct()
    odd = companies.where(~F.coalesce(F.col("company_id").rlike(COMPANY_ID), F.lit(False)))
    counted = companies.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != declared) if declared is not None else companies.agg(F.count(F.lit(1)).alias("n")).where("false")
    return fault(counted, "M1_count", "n").union(fault(ids, "M1_id_repeated", "company_id")).union(fault(odd, "M1_id_pattern", "company_id")).union(fault(identities, "M2_identity", "identity")).union(fault(shared, "M3_term_shared", "term_key")).union(fault(repeated, "M4_term_repeated", "company_id"))


def exposure_faults(exposures: DataFrame, known_families: DataFrame, closures: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """M5, M6: exposures(company, exposure_id, families), one row an exposure, known_families(family), rules(family), closures(company, closed) -> (check, key): ids of several exposures, of one company or of
    many, unknown families, known families without a rule, and companies with both or neither of exposures and a true closure."""
    fault = lambda df, name, key: df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
    twice = exposures.groupBy("exposure_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unknown = exposures.select(F.explode("families").alias("family")).distinct().join(known_families.select("family"), "family", "left_anti")
    ruleless = known_families.select("family").distinct().join((rules if rules is not None else known_families).select("family"), "family", "left_anti")
    both = exposures.select("company", F.lit(1).alias("has")).distinct().join(closures, "company", "full").where(F.col("has").isNotNull() == F.coalesce(F.col("closed"), F.lit(False)))
    return fault(twice, "M5_exposure_repeated", "exposure_id").union(fault(unknown, "M5_family_unknown", "family")).union(fault(ruleless, "M5_family_without_rule", "family")).union(fault(both, "M6_closure", "company"))
