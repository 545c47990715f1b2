"""Relational rows to graph candidates, for all persons at once.

Each function takes tables and gives rows of one kind: nodes (node_id, node_type, name, person_id, source_id, status,
properties), relations (relation_id, start_node_id, end_node_id, relation_type, source_id, status, properties), events and
issues. What can't become data becomes an issue; a bad person's rows never stop another's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import ids, rules, strict
from quarrystone.functions.text import organization_key, parse_stock_code
from quarrystone.operators.graph import strict_relation, verification

#: Events of the record tables and their types in the graph.
ENTERPRISE_EVENTS = {"BUYBACK": "CAPITAL_OPERATION", "REGULATORY_OR_LEGAL": "REGULATORY"} | {k: k for k in ("CAPITAL_OPERATION", "CORPORATE_GOVERNANCE", "INDUSTRY_TREND", "FINANCING", "REGULATORY", "LEGAL", "OPERATING_EVENT", "INDUSTRY_POLICY")}
SOCIAL_EVENTS = {"CHARITY_ESG": "CHARITY_ACTIVITY", "CHARITY": "CHARITY_ACTIVITY", "ESG": "ESG_ACTIVITY", "ACADEMIC": "ACADEMIC_ACTIVITY", "ACADEMIC_COOPERATION": "ACADEMIC_ACTIVITY", "RESEARCH_COLLABORATION": "ACADEMIC_ACTIVITY", "PUBLIC_SERVICE": "SOCIAL_ACTIVITY", "SOCIAL_ACTIVITY": "SOCIAL_ACTIVITY"}
REPUTATION_EVENTS = {"HONOR_OR_PUBLIC_EVALUATION": "HONOR", "HONOR": "HONOR", "PUBLIC_EVALUATION": "HONOR", "MEDIA_ATTENTION": "MEDIA_ATTENTION"}
FINANCIAL_EVENTS = {k: k for k in rules.FINANCIAL_EVENTS}
MARKET = {"UPSTREAM": "HAS_UPSTREAM", "HAS_UPSTREAM": "HAS_UPSTREAM", "DOWNSTREAM": "HAS_DOWNSTREAM", "HAS_DOWNSTREAM": "HAS_DOWNSTREAM", "COMPETITOR": "COMPETES_WITH", "COMPETES_WITH": "COMPETES_WITH"}
#: Names that stand for a kind of company, never for one.
GENERIC = ("服务器供应商", "内容创作者", "游戏开发商", "c端用户", "广告主", "企业客户")


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value for an upper-case code; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(strict.clean_text(c)))


def properties(df: DataFrame, columns: Sequence[str]) -> Column:
    """Map of the columns that exist and hold something."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), strict.clean_text(F.col(c).cast("string")).alias("value")) for c in have])
    return F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull()))


def with_status(df: DataFrame, sources: DataFrame, evidence: str | None = None) -> DataFrame:
    """Adds status: CONFIRMED if the row says so, its source exists and its text doesn't speculate. sources: source_id."""
    known = sources.select("source_id", F.lit(True).alias("_known")).distinct()
    text = F.coalesce(F.col(evidence), F.lit("")) if evidence and evidence in df.columns else F.lit("")
    return df.join(known, "source_id", "left").withColumn("status", verification(F.col("verification_status"), F.col("_known").isNotNull(), text)).drop("_known")


def issue(df: DataFrame, reason: str | Column, severity: str, table: str, key: str, field: str, message: str, keep: Sequence[str] = ()) -> DataFrame:
    """An issue per row of df, with the columns to keep. The id hangs on the message, so messages are constants."""
    code = F.lit(reason) if isinstance(reason, str) else reason
    made = ids.issue_id(code, F.lit(table), F.col(key), F.lit(field), F.lit(message))
    return df.select(made.alias("issue_id"), code.alias("reason"), F.lit(severity).alias("severity"), F.lit(table).alias("source_table"), F.col(key).cast("string").alias("source_pk"), F.lit(field).alias("field_name"), F.lit(message).alias("message"), *keep)


def distinct_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["issue_id"])


def person_nodes(person: DataFrame, profile: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Person nodes with their first profile, and an issue for each person without a source."""
    first = profile.groupBy("person_id").agg(F.min_by(F.struct(*[c for c in profile.columns if c != "person_id"]), "source_id").alias("p"))
    rows = person.select("person_id", "full_name", "person_type").join(first, "person_id", "left").select("person_id", "full_name", "person_type", "p.*")
    rows = with_status(rows, sources)
    marital = strict.marital_status(F.col("marital_status"))
    birth = strict.partial_date(F.col("birth_date").cast("string"))
    props = F.map_concat(properties(rows, ["person_type", "gender", "native_place", "education_level", "school_name"]), F.map_filter(F.create_map(F.lit("marital_status"), marital.value, F.lit("birth_date"), birth.value), lambda _, v: v.isNotNull()))
    nodes = rows.select(ids.person_id(F.col("person_id")).alias("node_id"), F.lit("Person").alias("node_type"), F.col("full_name").alias("name"), "person_id", "source_id", "status", props.alias("properties"))
    lost = issue(rows.where("source_id is null"), "MISSING_SOURCE", "WARNING", "person", "person_id", "source_id", "no source row")
    doubt = rows.withColumn("_e", marital.error).where("_e is not null")
    return nodes, distinct_issues(lost, issue(doubt, F.col("_e"), "WARNING", "person_profile", "person_id", "marital_status", "marital status can't be normalized"))


def enterprise_nodes(enterprise: DataFrame, links: DataFrame, business: DataFrame, sources: DataFrame) -> DataFrame:
    """Enterprise nodes; the source is the first relation's, business lines are a sorted list. An address is no headquarters."""
    first = links.groupBy("enterprise_id").agg(F.min_by(F.struct("source_id", "verification_status"), "person_enterprise_relation_id").alias("l"))
    lines = business.groupBy("enterprise_id").agg(F.to_json(F.array_sort(F.collect_set("business_line"))).alias("business_lines"))
    rows = enterprise.drop("verification_status").join(first, "enterprise_id", "left").join(lines, "enterprise_id", "left").select("*", "l.source_id", "l.verification_status")
    office = F.col("headquarters")
    rows = rows.withColumn("headquarters", F.when((F.length(office) <= 20) & ~office.rlike("路|街|号|楼|大厦|室"), office))
    rows = with_status(rows, sources).withColumn("normalized_name", organization_key(F.col("enterprise_name"))).withColumn("stock_code", parse_stock_code(F.concat(F.lit("("), F.col("stock_code"), F.lit(")"))))
    props = properties(rows, ["normalized_name", "stock_code", "registration_date", "registration_place", "headquarters", "industry_name", "business_lines"])
    return rows.select(ids.enterprise_id(F.col("enterprise_id")).alias("node_id"), F.lit("Enterprise").alias("node_type"), F.col("enterprise_name").alias("name"), F.lit(None).cast("long").alias("person_id"), "source_id", "status", props.alias("properties"))


def family_nodes(members: DataFrame) -> DataFrame:
    """A profile per person with any member, and the members: restricted ones by alias. All stay pending."""
    pending = F.lit("PENDING").alias("status")
    empty = F.create_map().cast("map<string,string>").alias("properties")
    alias = F.coalesce(strict.clean_text(F.col("protected_alias")), F.concat(F.lit("FamilyMember:"), F.col("family_member_id").cast("string")))
    name = F.when(F.upper("public_disclosure_level") == "RESTRICTED", alias).otherwise(F.coalesce(strict.clean_text(F.col("member_name")), alias))
    people = members.groupBy("person_id").agg(F.min("source_id").alias("source_id"))
    profiles = people.select(ids.keyed("family-profile", F.col("person_id")).alias("node_id"), F.lit("FamilyProfile").alias("node_type"), F.lit("家庭").alias("name"), "person_id", "source_id", pending, empty)
    return profiles.unionByName(members.select(ids.keyed("family-member", F.col("family_member_id")).alias("node_id"), F.lit("FamilyMember").alias("node_type"), name.alias("name"), "person_id", "source_id", pending, empty))


def relation(df: DataFrame, start: Column, kind: Column, end: Column, table: str, key: str, columns: Sequence[str] = ()) -> DataFrame:
    made = ids.relation_id(start, kind, end, F.col("source_id"), F.lit(table), F.col(key))
    return df.select(made.alias("relation_id"), start.alias("start_node_id"), end.alias("end_node_id"), kind.alias("relation_type"), "source_id", "status", properties(df, columns).alias("properties"))


def enterprise_relations(links: DataFrame, sources: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Relations of persons and enterprises by type; unknown types, and strict ones that aren't confirmed, are issues.

    keep: columns of the links that their issues get; issues then come once for each row.
    """
    rows = with_status(links, sources, "raw_text").withColumn("_kind", mapped(F.col("relation_type"), rules.PERSON_ENTERPRISE))
    good = rows.where("_kind is not null")
    made = relation(good, ids.person_id(F.col("person_id")), F.col("_kind"), ids.enterprise_id(F.col("enterprise_id")), "person_enterprise_relation", "person_enterprise_relation_id", ["title", "valid_from", "valid_to", "source_level"])
    unknown = issue(rows.where("_kind is null"), "UNKNOWN_ENUM", "WARNING", "person_enterprise_relation", "person_enterprise_relation_id", "relation_type", "unknown relation type", keep)
    unsure = good.where(strict_relation(F.col("_kind"), F.col("status")).isNotNull())
    unsure = issue(unsure, "STRICT_RELATION_VERIFICATION", "WARNING", "person_enterprise_relation", "person_enterprise_relation_id", "verification_status", "control and shares must be confirmed", keep)
    return made, unknown.unionByName(unsure) if keep else distinct_issues(unknown, unsure)


def career_relations(career: DataFrame, entities: DataFrame, explicit: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Careers whose organization is a known entity: a relation for each role of the title, unless an explicit one says so already.

    entities: node_id, node_type, name in order of position; of equal names the last one counts.
    """
    known = entities.select(organization_key(F.col("name")).alias("key"), "node_id", "node_type", "position").where("key <> ''").groupBy("key").agg(F.max_by(F.struct("node_id", "node_type"), "position").alias("to"))
    rows = with_status(career, sources, "career_description").withColumn("key", organization_key(F.regexp_replace("organization_name", r"[（(][0-9A-Za-z]{4,10}\.[A-Za-z]{2}[）)]$", "")))
    rows = rows.join(known, "key", "left")
    title = F.upper(F.coalesce(strict.clean_text(F.col("position_title")), F.lit("")))
    named = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [title.contains(k) for k in keys]), code) for keys, code in rules.TITLES]))
    plain = F.when(title != "", F.array(F.when(F.col("to.node_type") == "Enterprise", "WORKS_AT").otherwise("WORKS_FOR"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("kinds", F.when(F.size(named) > 0, named).otherwise(plain))
    each = rows.where("to is not null").withColumn("start_node_id", ids.person_id(F.col("person_id"))).withColumn("end_node_id", F.col("to.node_id")).withColumn("relation_type", F.explode("kinds"))
    semantic = ["start_node_id", "relation_type", "end_node_id"]
    had = explicit.select(*semantic).distinct().withColumn("_had", F.lit(True))
    each = each.join(had, semantic, "left")
    fresh = each.where("_had is null").dropDuplicates([*semantic])
    made = relation(fresh, F.col("start_node_id"), F.col("relation_type"), F.col("end_node_id"), "person_career", "career_id", ["position_title", "start_date", "end_date", "career_description"])
    parts = (
        issue(rows.where("to is null"), "UNMATCHED_RELATION", "WARNING", "person_career", "career_id", "organization_name", "organization is no loaded entity"),
        issue(rows.where("to is not null and size(kinds) = 0"), "MAPPING_PENDING", "WARNING", "person_career", "career_id", "position_title", "no title"),
        issue(each.where("_had"), "DUPLICATE_RELATION_CANDIDATE", "INFO", "person_career", "career_id", "position_title", "an explicit relation says the same"),
    )
    return made, distinct_issues(*parts)


def social_relations(links: DataFrame, organizations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships by type; the organization must be loaded."""
    rows = with_status(links, sources, "raw_text").withColumn("_kind", F.coalesce(mapped(F.col("relation_type"), rules.SOCIAL), F.lit(None)))
    known = organizations.select("social_organization_id", F.lit(True).alias("_loaded")).distinct()
    rows = rows.join(known, "social_organization_id", "left")
    good = rows.where("_kind is not null and _loaded")
    made = relation(good, ids.person_id(F.col("person_id")), F.col("_kind"), ids.keyed("organization", F.col("social_organization_id")), "person_social_relation", "person_social_relation_id", ["role_title", "valid_from", "valid_to"])
    unknown = issue(rows.where("_kind is null"), "UNKNOWN_ENUM", "WARNING", "person_social_relation", "person_social_relation_id", "relation_type", "unknown relation type")
    return made, distinct_issues(unknown, issue(rows.where("_kind is not null and _loaded is null"), "UNMATCHED_RELATION", "WARNING", "person_social_relation", "person_social_relation_id", "social_organization_id", "organization is not loaded"))


def market_relations(market: DataFrame, enterprises: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations to counterparts, the nodes made for counterparts that are no known enterprise, and issues.

    enterprises: enterprise_id, enterprise_name. A competitor is the known enterprise of that name (of equal names the first
    id), else a pending reference, but never a generic name. Whatever is up or down the stream is a market segment.
    """
    known = enterprises.groupBy(organization_key(F.col("enterprise_name")).alias("key")).agg(F.min("enterprise_id").alias("_id"))
    rows = with_status(market, sources, "relation_description").withColumn("_name", strict.clean_text(F.col("counterpart_name"))).withColumn("key", organization_key(F.col("_name")))
    rows = rows.withColumn("_kind", mapped(F.col("relation_type"), MARKET)).join(known, "key", "left")
    generic = F.col("key").isin(*GENERIC) & F.col("_id").isNull()
    bad = F.when(F.coalesce(F.col("key"), F.lit("")) == "", "COUNTERPART_NAME_MISSING").when(F.col("_kind").isNull(), "UNKNOWN_ENUM").when(generic & (F.col("_kind") == "COMPETES_WITH"), "COUNTERPART_NOT_ENTERPRISE")
    rows = rows.withColumn("_bad", bad)
    good = rows.where("_bad is null")
    rival = F.col("_kind") == "COMPETES_WITH"
    end = F.when(~rival, ids.segment_id(F.col("_name"))).when(F.col("_id").isNotNull(), ids.enterprise_id(F.col("_id"))).otherwise(ids.reference_id(F.col("_name")))
    made = relation(good, ids.enterprise_id(F.col("enterprise_id")), F.col("_kind"), end, "enterprise_market_relation", "enterprise_market_relation_id", ["relation_description"])
    new = good.where(~rival | F.col("_id").isNull()).groupBy(end.alias("node_id"), F.when(rival, "Enterprise").otherwise("MarketSegment").alias("node_type")).agg(F.min("_name").alias("name"), F.min("source_id").alias("source_id"))
    nodes = new.select("node_id", "node_type", "name", F.lit(None).cast("long").alias("person_id"), "source_id", F.lit("PENDING").alias("status"), F.create_map(F.lit("detail_level"), F.lit("MINIMAL")).alias("properties"))
    return made, nodes, distinct_issues(issue(rows.where("_bad is not null"), F.col("_bad"), "WARNING", "enterprise_market_relation", "enterprise_market_relation_id", "counterpart_name", "counterpart can't be an end"))


def events(df: DataFrame, table: str, key: str, kind: str, types: Mapping[str, str], subject: Column, dates: Sequence[str], description: str, sources: DataFrame, pending: bool = False, link: str = "HAS_EVENT") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of one table, their links to the subject, and issues. The first date column that holds something is the date; one that is vague or a range keeps the event pending."""
    rows = with_status(df, sources, description)
    if pending:
        rows = rows.withColumn("status", F.lit("PENDING"))
    rows = rows.withColumn("_kind", mapped(F.col(kind), types)).withColumn("_subject", subject)
    rows = rows.withColumn("_date", strict.partial_date(F.coalesce(*[strict.clean_text(F.col(c).cast("string")) for c in dates if c in df.columns], F.lit(None).cast("string"))))
    vague = F.col("_date.estimated") | F.col("_date.range").isNotNull() | F.col("_date.error").isNotNull()
    rows = rows.withColumn("status", F.when(vague, "PENDING").otherwise(F.col("status")))
    good = rows.where("_kind is not null")
    made = ids.event_id(F.col("_subject"), F.col("_kind"), F.lit(table), F.col(key))
    out = good.select(made.alias("event_id"), F.col("_kind").alias("event_type"), F.col("_subject").alias("subject_node_id"), F.col("_date.value").alias("event_date"), F.col("_date.precision").alias("date_precision"), F.col(description).alias("description"), "source_id", "status")
    links = relation(good, F.col("_subject"), F.lit(link), made, table, key)
    parts = (
        issue(rows.where("_kind is null"), "UNKNOWN_ENUM", "WARNING", table, key, kind, "unknown event type"),
        issue(good.where("_date.error is not null"), "PARSE_FAILED", "WARNING", table, key, dates[0], "date can't be read"),
        issue(good.where("_date.range is not null"), "MAPPING_PENDING", "WARNING", table, key, dates[0], "date is a range"),
        issue(good.where("_date.estimated"), "MAPPING_PENDING", "INFO", table, key, dates[0], "date is an estimate"),
    )
    return out, links, distinct_issues(*parts)


def unique_partner(activities: DataFrame, organizations: DataFrame) -> DataFrame:
    """activities with node: the one organization that has the partner's name; null if there is none or more than one."""
    names = organizations.select(organization_key(F.col("organization_name")).alias("_key"), ids.keyed("organization", F.col("social_organization_id")).alias("node"))
    one = names.groupBy("_key").agg(F.min("node").alias("node"), F.countDistinct("node").alias("_n")).where("_n = 1").drop("_n")
    return activities.withColumn("_key", organization_key(F.col("partner_name"))).join(one, "_key", "left").drop("_key")
