"""Groups of records linked directly or through others (connected components)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonewright.operators.graph import smallest_label
from clonewright.plans.scratch import materialise


def ordered_ids(names: DataFrame, column: str) -> DataFrame:
    """(name, id) with ids that rise in the byte order of the distinct names.

    Range partitioning sorts the names over the whole cluster, and the id is
    made of partition and position, so no count or global sort in one task is
    needed. Written at once, because a second evaluation might draw other
    range borders. Nulls get no id.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    ranged = distinct.repartitionByRange("name").sortWithinPartitions("name")
    return materialise(ranged.select("name", F.monotonically_increasing_id().alias("id")))


def named_groups(links: DataFrame) -> DataFrame:
    """(member, group_member) for links of strings ``a`` and ``b``, the group named by its smallest member.

    A member linked to nobody is given by a row whose two ends are equal.
    """
    names = ordered_ids(links.select(F.explode(F.array("a", "b")).alias("name")), "name")
    ends_a = names.select(F.col("name").alias("a"), F.col("id").alias("ia"))
    ends_b = names.select(F.col("name").alias("b"), F.col("id").alias("ib"))
    edges = links.distinct().join(ends_a, "a").join(ends_b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    labels = smallest_label(edges)
    member = names.select("id", F.col("name").alias("member"))
    group = names.select(F.col("id").alias("label"), F.col("name").alias("group_member"))
    return labels.join(member, "id").join(group, "label").select("member", "group_member")


def finding_links(findings: DataFrame) -> DataFrame:
    """(a, b) of member strings ``file:line:col``: the members of each finding linked in a star.

    The row with the greatest ``loaded_at`` is the finding. Members that are
    null or null in any part do not exist. A star links all members with as
    many rows as members, so the size of a finding is no matter.
    """
    newest = F.max(F.struct("loaded_at", "members"))["members"].alias("members")
    latest = findings.where(F.col("finding_id").isNotNull()).groupBy("finding_id").agg(newest)
    parts = ("file", "line", "col")
    whole = F.filter("members", lambda m: m.isNotNull() & m[parts[0]].isNotNull() & m[parts[1]].isNotNull() & m[parts[2]].isNotNull())
    texts = F.transform(whole, lambda m: F.concat_ws(":", m["file"], m["line"].cast("string"), m["col"].cast("string")))
    stars = latest.select(F.array_distinct(texts).alias("m")).where(F.size("m") > 0)
    return stars.select(F.element_at("m", 1).alias("a"), F.explode("m").alias("b"))
