"""The roles of the data model, filled from general tables.

The operators expect facilities, a postcode directory, district figures, verdicts
and labels. These views give each role to a table of the test set; every row of the
table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.domains import page_links
from ..sources.tables import read_parquet


# How many partitions to deal the documents over; unset, they stay as their files are split.
PARTITIONS_SETTING = "attesta.documents.partitions"


def table(
    spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None
) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", partitions)


def _lines(part: int) -> Column:
    """Every third line, so that the three array fields together hold the whole text."""
    return F.filter(F.col("lines"), lambda _, i: i % 3 == part)


# Two rounds of leases, between which the leases of one and two days end.
LEASE_TIMES = ("2024-03-01 09:00:00", "2024-03-03 09:00:00")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cleaned facilities: prose plus three text arrays and a code array."""
    asked = spark.conf.get(PARTITIONS_SETTING, None)
    raw = table(spark, sf_dir, "documents", int(asked) if asked else None)
    docs = raw.withColumn("lines", F.split("text", "\n"))
    return docs.select(
        F.col("doc_id").cast("string").alias("facility_id"),
        F.concat_ws(" ", F.lit("Document"), F.col("doc_id")).alias("name"),
        F.col("source").alias("city"),
        F.upper("lang").alias("state"),
        F.concat("lang", F.lit("-"), "source").alias("pincode"),
        (F.col("n_chars") / F.lit(100.0)).alias("latitude"),
        (F.lit(60.0) + F.length("source") * F.lit(4.0)).alias("longitude"),
        F.col("text").alias("description"),
        _lines(0).alias("capabilities"),
        _lines(1).alias("procedures"),
        _lines(2).alias("equipment"),
        F.array("source", "lang").alias("specialties"),
        F.array(F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang")).alias("source_urls"),
    )


def facility_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw facility rows, with the untidy forms that cleaning has to meet."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    quoted = lambda *cols: F.concat(
        F.lit('["'), F.concat_ws('","', *cols), F.lit('"]')
    )
    return c.select(
        F.col("c_custkey").cast("string").alias("unique_id"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"),
        F.concat(seg, F.lit(" in "), nat).alias("description"),
        F.concat(F.lit(" "), seg, F.lit(" ")).alias("organization_type"),
        F.when(seg == "MACHINERY", F.lit("   ")).otherwise(seg).alias("facilityTypeId"),
        nat.alias("operatorTypeId"),
        quoted(seg, nat, seg).alias("specialties"),
        F.when(seg == "BUILDING", F.lit("not json")).otherwise(quoted(nat, nat)).alias("procedure"),
        F.when(seg == "FURNITURE", F.lit('{"a": 1}')).otherwise(F.lit("[]")).alias("equipment"),
        F.when(seg == "HOUSEHOLD", F.lit(None)).otherwise(quoted(F.col("c_name"))).alias("capability"),
        quoted(F.concat(F.lit("http://x/"), nat), F.lit(""), F.concat(F.lit("http://x/"), seg)).alias("source_urls"),
        F.when(seg == "BUILDING", F.concat(F.lit(" "), F.col("c_nationkey"), F.lit(" ")))
        .when(seg == "MACHINERY", F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")))
        .otherwise(F.col("c_nationkey").cast("string")).alias("capacity"),
        F.when(seg == "FURNITURE", F.lit("")).otherwise(
            (F.col("c_nationkey") + 1950).cast("string")).alias("yearEstablished"),
        F.when(seg == "FURNITURE", F.lit("1e3")).otherwise(F.lit("7")).alias("numberDoctors"),
        F.lit(None).cast("string").alias("address_line1"),
        F.lit(None).cast("string").alias("address_line2"),
        F.lit(None).cast("string").alias("address_line3"),
        F.concat(F.lit(" "), seg, F.lit("   town")).alias("address_city"),
        F.regexp_replace(nat, "_", "   ").alias("address_stateOrRegion"),
        F.when(seg == "HOUSEHOLD", F.lit(" ")).otherwise(
            F.concat(F.lit(" "), F.col("c_custkey"))).alias("address_zipOrPostcode"),
        F.lit("Country").alias("address_country"),
        F.lit("CC").alias("address_countryCode"),
        F.when(seg == "AUTOMOBILE", F.lit(None)).otherwise(F.col("c_acctbal") / 100.0).alias("latitude"),
        (F.col("c_nationkey") * 4.0).alias("longitude"),
        F.lit("2024").alias("recency_of_page_update"),
        F.col("n_regionkey").cast("string").alias("distinct_social_media_presence_count"),
        F.when(seg == "BUILDING", F.lit("TRUE")).when(seg == "MACHINERY", F.lit(None))
        .otherwise(F.lit("false")).alias("affiliated_staff_presence"),
        F.when(F.col("c_acctbal") > 0, F.lit("true")).otherwise(F.lit("no")).alias("custom_logo_presence"),
        F.col("c_custkey").cast("string").alias("number_of_facts_about_the_organization"),
        F.lit(None).cast("string").alias("officialPhone"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("officialWebsite"),
        F.col("c_custkey").cast("string").alias("source_content_id"),
        seg.alias("cluster_id"),
    )


def postcode_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a postcode directory: many offices per key, untidy types and coordinates."""
    kind = F.col("event_type")
    number = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("office "), F.col("event_id")).alias("officename"),
        F.col("user_id").alias("pincode"),
        F.when(kind == "purchase", F.lit("HO")).when(kind == "signup", F.lit("po"))
        .when(kind == "click", F.lit("BO")).otherwise(kind).alias("officetype"),
        F.concat(F.lit("  zone  "), number).alias("district"),
        F.when(kind == "purchase", F.concat(F.lit(" nation "), number)).alias("statename"),
        F.when(F.col("value") < 5, F.lit("NA")).otherwise(F.col("value").cast("string")).alias("latitude"),
        F.when(F.col("value") < 5, F.lit("NA")).otherwise(F.lit("77.5")).alias("longitude"),
    )


def canonical_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as the canonical list; those of two regions are known by another spelling only."""
    name = F.initcap(F.regexp_replace("n_name", "_", " "))
    return table(spark, sf_dir, "nation").select(
        F.when(F.col("n_regionkey") <= 2, name).otherwise(F.concat(F.lit("Greater "), name)).alias("state")
    )


def district_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and balance figures per (segment, nation) as district indicators."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("l"),
    )
    share = lambda part: F.round(100.0 * F.sum(part) / F.sum("n"), 4)
    return (
        c.join(o, "c_custkey", "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(
            F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  area ")).alias("district_name"),
            F.regexp_replace("n_name", "_", "  ").alias("state_ut"),
        )
        .agg(
            share("f").alias("women_age_15_49_who_are_literate_pct"),
            share("u").alias("hh_member_covered_health_insurance_pct"),
            share("l").alias("institutional_birth_5y_pct"),
            F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*"), 4)
            .alias("births_delivered_by_csection_5y_pct"),
        )
    )


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(table(spark, sf_dir, "events"))


def verdict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, read as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return _verdicts(files.parquet(sf_dir))


def _verdicts(events: DataFrame) -> DataFrame:
    """Events as the reviewer verdict log; clicks carry a status outside the domain."""
    kind = F.col("event_type")
    number = F.get_json_object("props", "$.k")
    return events.select(
        number.alias("facility_id"),
        F.when(kind != "view", F.concat(F.lit("claim "), number)).alias("claim_id"),
        F.concat(F.lit("planner "), F.col("user_id")).alias("planner_id"),
        F.when(kind == "purchase", F.lit("verified")).when(kind == "error", F.lit("rejected"))
        .when(kind == "click", F.lit("clicked")).otherwise(F.lit("needs_info")).alias("status"),
        kind.alias("reason"),
        F.col("value").cast("string").alias("notes"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the events as reviewers of up to three claims for one to three days."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").filter(user.isNotNull()).select(
        F.concat(F.lit("planner "), user).alias("planner_id"),
        (user % 4).alias("capacity"), (user % 3 + 1).alias("lease_days"),
    ).distinct()


def note_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as reviewer notes."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("facility_id"),
        F.when(F.col("role").isNotNull(), F.concat(F.lit("planner "), F.col("conv_id"))).alias("planner_id"),
        F.col("text").alias("note"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int")))
        .alias("created_at"),
        F.col("turn").alias("seq"),
    )


def model_answers(elements: DataFrame) -> DataFrame:
    """(prompt_key, response): what a model said to each prompt, spelled out of the prompt's hash.

    Every eighth prompt has no answer, and the others name terms, also some outside any taxonomy.
    """
    digit = F.conv(F.substring("prompt_key", 1, 2), 16, 10).cast("int")
    term = F.get(F.array(*map(F.lit, ("common", "Contact ", "spa", "other", "card"))), digit % 5)
    body = F.concat(
        F.lit('{"claim_value": "'), term, F.lit('", "confidence": '), (digit / 256.0).cast("string"), F.lit("}")
    )
    return elements.select("prompt_key").distinct().select(
        "prompt_key", F.when(digit % 8 > 0, F.concat(F.lit("So: "), body)).alias("response")
    )


def scenario_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity labels as hand-made expectations for one term."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("facility_id"),
        F.lit("common").alias("claim_value"),
        F.when(F.col("toxic") == 1, F.lit("contradicted"))
        .when(F.col("quality") == 1, F.lit("verified"))
        .otherwise(F.lit("unclear")).alias("expected_status"),
        F.concat(F.lit("quality "), F.col("quality"), F.lit(" toxic "), F.col("toxic")).alias("rationale"),
    )


def district_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as districts: overlapping stars with a hole, corners on the longitudes of the customers."""
    x, y = 4.0 * F.col("n_nationkey"), 20.0 + 10.0 * (F.col("n_nationkey") % 5)
    ring = lambda corners: F.array(*[
        F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("district_id"),
        F.array(ring(STAR), ring(HOLE)).alias("rings"),
    )


# Corners of the test districts around their centre, outer ring and hole.
STAR = ((-6, -20), (0, -10), (6, -20), (4, 0), (6, 20), (0, 10), (-6, 20), (-4, 0))
HOLE = ((-1, -3), (1, -3), (1, 3), (-1, 3))


def state_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under their names, and under their first word with a title."""
    name = F.initcap(F.regexp_replace("n_name", "_", " "))
    nations = table(spark, sf_dir, "nation").select(name.alias("state"))
    return nations.select("state", F.explode(F.array("state", F.concat(F.lit("Republic of "), "state"))).alias("alias"))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as facilities on a map: two numbers of each vector, moved over the test districts."""
    at = lambda i, centre: 30.0 * F.get("embedding", F.lit(i)).cast("double") + centre
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", at(0, 48.0).alias("longitude"), at(1, 40.0).alias("latitude"))


def misspelt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the name of a nation, misspelt in ways that their numbers decide."""
    number = F.col("conv_id") + 11 * F.col("turn")
    way, at = number % 7, (3 + number % 5).cast("int")
    name = F.regexp_replace("n_name", "_", " ")
    cut = lambda s, i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s)))
    spelled = (
        F.when(way == 0, F.concat(F.lit("  "), F.lower(name), F.lit("!")))
        .when(way == 1, cut(name, at))
        .when(way == 2, cut(cut(name, at), F.lit(2)))
        .when(way == 3, F.concat(name.substr(F.lit(1), at), F.lit("q"), name.substr(at + 1, F.length(name))))
        .when(way == 4, F.concat(F.lit("Republic of"), cut(name, at)))
        .when(way == 5, F.when(number % 2 == 0, F.lit(" ")))
        .otherwise(F.initcap(name))
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    joined = turns.join(table(spark, sf_dir, "nation"), F.col("conv_id") % 25 == F.col("n_nationkey"))
    return joined.select(F.concat_ws("-", "conv_id", "turn").alias("facility_id"), spelled.alias("state_raw"))


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as saved searches, with conditions that their numbers decide."""
    k = F.col("s_suppkey")
    terms = F.array(*map(F.lit, ("permissive", "copyleft", "noncommercial", "contact", "network", "card", "common")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("search "), k).alias("search_id"),
        F.get(terms, (k % 8).cast("int")).alias("capability"),
        F.when(k % 5 == 1, F.lit("verified")).when(k % 5 == 2, F.lit("contradicted")).alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("SRC"), F.col("s_nationkey"))).when(k % 3 == 1, F.lit("f")).alias("place"),
        F.when(k % 4 > 0, (k % 10) / F.lit(10.0)).alias("min_trust"),
        F.when(k % 2 == 0, F.array(F.lit("licensed"))).when(k % 7 == 0, F.array(F.lit("english"), F.lit("reachable")))
        .alias("required"),
    )


# The suffixes under which the hosts of the test pages are registered.
HOST_SUFFIXES = ("com", "net", "org", "example.com", "example.net", "example.org")


def host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in HOST_SUFFIXES], "suffix string")


def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu links of all pages, each led on to the page that its own page's number and its length name.

    The links of the test pages stay on their hosts, which would leave a graph without edges.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = pages.count()
    led = page_links(pages.filter("page_id % 9 != 4"), keep=("page_id",))
    chars = F.length(F.regexp_replace("target", "^.*/", "")).cast("long")
    led = led.select("source", ((F.col("page_id") * 31 + chars * chars * 17) % n).alias("page_id"))
    return led.join(pages.select("page_id", F.col("url").alias("target")), "page_id").select("source", "target")


def published_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of short and of long documents by source and language, as published: few cases in brackets, very few as ``*``."""
    docs = table(spark, sf_dir, "documents").groupBy(
        F.upper("lang").alias("state"), F.concat("lang", F.lit("-"), "source").alias("district")
    )
    shares = docs.agg(
        F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("n_chars") < 1000) / F.count("*"), 1).alias("short"),
        F.round(100.0 * F.count_if(F.col("n_chars") > 3000) / F.count("*"), 1).alias("long"),
    )
    published = lambda c: (
        F.when(F.col("n") % 7 == 1, F.lit("*")).when(F.col("n") % 3 == 0, F.concat(F.lit("("), c, F.lit(")")))
        .when(F.col("n") % 3 == 1, F.concat(F.lit(" "), c, F.lit(" %"))).otherwise(F.col(c).cast("string")))
    return shares.select("state", "district", published("short").alias("short_pct"), published("long").alias("long_pct"))


def stated_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as what the fields of a facility (a part) say about its size, in words that their numbers decide."""
    n = F.col("l_quantity").cast("long")
    way = (F.col("l_orderkey") + F.col("l_suppkey")) % 9
    more, many = (n + F.col("l_linenumber")).cast("string"), F.concat((n + 1).cast("string"), F.lit(",250"))
    n = n.cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(way == 0, said("A ward of ", n, " beds."))
        .when(way == 1, said("Between ", n, "  and ", more, " beds, with over ", n, " nurses"))
        .when(way == 2, said("a ", n, "-bedded house; up to ", more, " doctors"))
        .when(way == 3, said(n, "-", more, " Beds on ", many, " sq ft"))
        .when(way == 4, said("AT LEAST ", n, " beds (", n, ".5.1 beds, 3,5 nurses)"))
        .when(way == 5, said("about ", n, " doctors and ", many, ".5 square  metres"))
        .when(way == 6, said("v", n, " beds, room ", n))
        .when(way == 7, said("minimum of ", n, " nurses, at most ", more, " nurses"))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("facility_id"),
        F.get(F.array(*map(F.lit, ("description", "capabilities", "equipment"))), F.col("l_linenumber") % 3).alias("source_field"),
        text.alias("text"),
    )
