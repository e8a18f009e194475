"""Resolving misspelt names against an alias table: an approximate string join without pairing all rows.

Both sides are reduced to distinct normalised names. Names that are at most d edits apart share a string that each
reaches by dropping at most d letters from its first ``PREFIX`` ones, so the join is by equality on
these strings, and the edit distance decides. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX = 8
# The number of letters from which one and from which two edits are forgiven.
ONE_EDIT, TWO_EDITS = 4, 8


def normal_name(c: Column) -> Column:
    """Lower case, ``&`` as a word, everything but letters, marks and digits as one space."""
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{M}\p{N}]+", " "))


def forgiven(name: Column) -> Column:
    n = F.length(name)
    return F.when(n >= TWO_EDITS, 2).when(n >= ONE_EDIT, 1).otherwise(0)


def _drop_one(s: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), s.substr(i + 1, F.length(s))),
    )


def deletions(name: Column, most: Column) -> Column:
    """The distinct strings that the beginning of a name gives with at most ``most`` (0 to 2) letters dropped."""
    head = F.substring(name, 1, PREFIX)
    once = _drop_one(head)
    twice = F.flatten(F.transform(once, _drop_one))
    none = F.array(head)
    return F.array_distinct(
        F.when(most == 0, none).when(most == 1, F.concat(none, once)).otherwise(F.concat(none, once, twice))
    )


def near_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, alias, distance) for all pairs of distinct normalised names within the edits forgiven to ``name``.

    ``aliases`` is keyed with the edits that any name could need of it. Strings shared by many names cost
    candidates only, as the two sides are distinct.
    """
    asked = names.select("name", F.explode(deletions(F.col("name"), forgiven(F.col("name")))).alias("part"))
    # A name may be up to two letters longer than its alias.
    most = F.when(F.length("alias") >= TWO_EDITS - 2, 2).when(F.length("alias") >= ONE_EDIT - 1, 1).otherwise(0)
    known = aliases.select("alias", F.explode(deletions(F.col("alias"), most)).alias("part"))
    pairs = asked.join(known, "part").select("name", "alias").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("name", "alias"))
    return pairs.filter(F.col("distance") <= forgiven(F.col("name")))


def resolve_aliases(
    rows: DataFrame, aliases: DataFrame, id_col: str = "facility_id", name_col: str = "state_raw",
    alias_col: str = "alias", canonical_col: str = "state",
) -> DataFrame:
    """(row_id, name_raw, state, distance, reason) for every row.

    ``aliases`` lists the spellings of each canonical name, its own among them. ``reason`` is ``exact`` (written as
    an alias), ``spelling`` (the same but for case, spaces and signs), ``edits`` (the only canonical name at the least
    distance), ``ambiguous`` (several at that distance, also if one alias belongs to several: left open),
    ``unknown`` or, for a NULL or blank name, ``missing``. Up to 3 letters no edit is forgiven, up to 7 one, else two. Rows
    keep their number: repeated rows and NULL ids stay. NULL or blank aliases and canonical names are ignored, and
    empty tables give no rows or only open ones. Names are compared once each, however many rows
    share one, and looked up by size-measured or split joins.
    """
    raw = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{name_col}`").alias("name_raw"))
    told = aliases.select(
        F.col(f"`{alias_col}`").alias("spelled"), normal_name(F.col(f"`{alias_col}`")).alias("alias"),
        F.col(f"`{canonical_col}`").alias("state"),
    ).filter("alias != '' AND trim(state) != ''").distinct()
    names = raw.select("name_raw", normal_name(F.col("name_raw")).alias("name")).distinct().filter("name != ''")
    near = near_names(names.select("name").distinct(), told.select("alias").distinct())
    least = (
        near.join(told.select("alias", "state").distinct(), "alias")
        .groupBy("name")
        .agg(F.min(F.struct("distance", "state")).alias("first"), F.collect_set(F.struct("distance", "state")).alias("all"))
        .select(
            "name", "first.distance", "first.state",
            (F.size(F.filter("all", lambda p: p["distance"] == F.col("first.distance"))) > 1).alias("several"),
        )
    )
    written = told.groupBy(F.col("spelled").alias("name_raw")).agg(F.lit(True).alias("written"))
    judged = (
        names.join(least, "name", "left")
        .join(written, "name_raw", "left")
        .select(
            F.col("name_raw").alias("judged_raw"),
            F.when(~F.col("several"), F.col("state")).alias("state"),
            "distance",
            F.when(F.col("several"), "ambiguous").when(F.col("written"), "exact")
            .when(F.col("distance") == 0, "spelling").when(F.col("distance") > 0, "edits")
            .otherwise("unknown").alias("reason"),
        )
    )
    # A row without a name meets nothing; it gets no key, so that such rows are not sent to one task.
    named = raw.filter(normal_name(F.col("name_raw")) != "")
    blank = raw.filter(F.coalesce(normal_name(F.col("name_raw")), F.lit("")) == "")
    found = named.join(judged, F.col("name_raw") == F.col("judged_raw")).drop("judged_raw")
    return found.unionByName(
        blank.select(
            "row_id", "name_raw", F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("distance"),
            F.lit("missing").alias("reason"),
        )
    )
