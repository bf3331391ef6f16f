"""Pairs of submissions by shared fingerprints, and set operations on fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import kept
from .cells import meet
from .tokens import KEYS


def distinct_hashes(fingerprints: DataFrame) -> DataFrame:
    """KEYS, hash: each submission's hashes as a set."""
    return fingerprints.select(*KEYS, "hash").distinct()


def shared_hashes(sets: DataFrame, within: str | None = "assignment_id") -> DataFrame:
    """assignment_id, a, b, hash for every hash that two submissions share, a < b; within None pairs across assignments.

    An equi-join on the hash: the inverted index is the join's own shuffle,
    and adaptive execution splits a hash that many submissions hold.
    """
    a = sets.select(*([F.col(within)] if within else []), F.col("submission_id").alias("a"), "hash")
    b = sets.select(*([F.col(within)] if within else []), F.col("submission_id").alias("b"), "hash")
    return a.join(merged(b), [within, "hash"] if within else ["hash"]).where("a < b")


def set_arrays(sets: DataFrame) -> DataFrame:
    """KEYS, hashes: each submission's hashes as one sorted array, of rows (KEYS, hash) or of arrays (KEYS, hashes)."""
    found = F.flatten(F.collect_list("hashes")) if "hashes" in sets.columns else F.collect_set("hash")
    return sets.groupBy(*KEYS).agg(F.array_sort(F.array_distinct(found)).alias("hashes")).where("size(hashes) > 0")


def _class_name() -> Column:
    return F.sha2(F.array_join(F.transform("hashes", lambda h: h.cast("string")), ","), 256)


def set_classes(sets: DataFrame) -> DataFrame:
    """KEYS, class, size: submissions with equal sets have one class, named by the SHA-256 of their sorted hashes."""
    return set_arrays(sets).select(*KEYS, _class_name().alias("class"), F.size("hashes").cast("long").alias("size"))


#: Copies that are one unit of meet(); more are several.
_UNIT = 1000


def equal_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys,) all, hashes: submissions (sorted) with equal sets."""
    return set_arrays(sets).groupBy(*keys, _class_name().alias("class")).agg(F.array_sort(F.collect_list("submission_id")).alias("all"), F.any_value("hashes").alias("hashes")).drop("class")


def by_thousands(ids: str = "all") -> Column:
    """The array ids in arrays of at most _UNIT."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(ids) / _UNIT).cast("int") - 1), lambda k: F.slice(ids, k * _UNIT + 1, _UNIT))


def _units(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys,) unit, ids, size, hashes: submissions with equal sets, by thousands."""
    copies = equal_sets(sets, keys)
    return copies.select(*keys, F.explode(by_thousands()).alias("ids"), F.size("hashes").cast("long").alias("size"), "hashes").withColumn("unit", F.monotonically_increasing_id())


def class_members(sets: DataFrame, within: str | None = "assignment_id") -> DataFrame:
    """(within,) submission_id, rep, members: the class of every submission with a hash, named by its smallest submission_id, and how many have the same set."""
    keys = [within] if within else []
    named = kept(set_classes(sets))
    reps = named.groupBy(*keys, "class").agg(F.min("submission_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    return named.join(merged(reps), [*keys, "class"]).select(*keys, "submission_id", "rep", "members")


def class_pairs(sets: DataFrame, members: DataFrame, within: str | None = "assignment_id") -> DataFrame:
    """(within,) a, b, n_a, n_b, shared of all pairs of classes (of class_members()) with a common hash, a < b, and of each class of several members with itself (a = b).

    So it grows with the different sets and what they share. Each member of a
    shares so many hashes with each of b: expand_classes() writes them out.
    """
    keys = [within] if within else []
    firsts = members.where("submission_id = rep").select(*keys, F.col("rep").alias("submission_id"), "members")
    own = set_arrays(sets).join(merged(firsts), [*keys, "submission_id"]).select(*keys, F.array("submission_id").alias("ids"), F.col("members").alias("size"), "hashes")
    own = kept(own.withColumn("unit", F.monotonically_increasing_id()))
    met = meet(own, keys).select(*keys, "a", "b", F.col("size_a").alias("n_a"), F.col("size_b").alias("n_b"), "shared")
    rep = F.col("ids")[0]
    alike = own.where("size > 1").select(*keys, rep.alias("a"), rep.alias("b"), F.col("size").alias("n_a"), F.col("size").alias("n_b"), F.size("hashes").cast("long").alias("shared"))
    return met.unionByName(alike)


def expand_classes(pairs: DataFrame, members: DataFrame, within: str | None = "assignment_id") -> DataFrame:
    """candidate_pairs() of class_pairs(): (within,) a, b, shared of the members."""
    keys = [within] if within else []
    member = lambda s: members.select(*keys, F.col("rep").alias(s), F.col("submission_id").alias(f"of_{s}"))
    both = pairs.join(merged(member("a")), [*keys, "a"]).join(merged(member("b")), [*keys, "b"]).where("a < b OR of_a < of_b")
    return both.select(*keys, F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"), "shared")


def merged(frame: DataFrame) -> DataFrame:
    """A side of a join that goes through a shuffle. Rows that are derived from a small file may be a thousand times its size, which is what Spark goes by, so it would gather them on the driver and send them to every task."""
    return frame.hint("merge")


def pair_counts(sets: DataFrame, within: str | None = "assignment_id", flags: Sequence[str] = ()) -> DataFrame:
    """(within,) a, b, shared, size_a, size_b, and n_<flag>, own_<flag>_a and own_<flag>_b of all pairs with a common hash, a < b: how many hashes they share, how many either has, and how many of each bear a boolean flag of sets.

    Copies are joined once: hashes meet between one submission of each class
    of equal sets, and the counts of two classes hold for all their members
    (flags must go by assignment and hash). So a hash that many copies hold
    makes as many rows as it has pairs of different sets, and what is left
    grows with the result alone, without further joins for the sizes. Without
    flags the pairs are found by meet(), so they aren't shuffled at all.
    """
    keys = [within] if within else []
    if not flags:
        return meet(kept(_units(sets, keys)), keys)
    named = kept(set_classes(sets))
    reps = named.groupBy(*keys, "class").agg(F.min(F.struct("submission_id", "assignment_id")).alias("rep"), F.count(F.lit(1)).alias("members"))
    reps = reps.select(*keys, "class", F.col("rep.submission_id").alias("submission_id"), F.col("rep.assignment_id").alias("rep_assignment"), "members")
    own = sets.join(merged(reps.select("class", "members", "submission_id", F.col("rep_assignment").alias("assignment_id"))), list(KEYS)).select(*keys, "class", "members", "hash", *flags)
    own = kept(own)
    sums = [F.count(F.lit(1)).alias("shared"), *(F.count_if(f).alias(f"n_{f}") for f in flags)]
    counts = ["shared", *(f"n_{f}" for f in flags)]
    side = lambda s: own.select(*keys, "hash", F.col("class").alias(f"class_{s}"), *(flags if s == "a" else ()))
    met = side("a").join(merged(side("b")), [*keys, "hash"]).where("class_a < class_b").groupBy(*keys, "class_a", "class_b").agg(*sums)
    alike = own.where("members > 1").groupBy(*keys, F.col("class").alias("class_a")).agg(*sums)
    alike = alike.select(*keys, "class_a", F.col("class_a").alias("class_b"), *counts)
    if flags:  # one row a class, so the members know how many of their hashes bear a flag
        flagged = own.groupBy(*keys, "class").agg(*(F.count_if(f).alias(f"own_{f}") for f in flags))
        named = named.join(merged(flagged), [*keys, "class"])
    facts = ["submission_id", "size", *(f"own_{f}" for f in flags)]
    member = lambda s: merged(named.select(*keys, F.col("class").alias(f"class_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in facts)))
    both = lambda found: found.join(member("a"), [*keys, "class_a"]).join(member("b"), [*keys, "class_b"])
    turned = F.col("submission_id_a") > F.col("submission_id_b")
    ordered = [F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{'' if c == 'submission_id' else c + '_'}{x}") for c in facts for x, y in (("a", "b"), ("b", "a"))]
    across = both(met).select(*keys, *ordered, *counts)
    inside = both(alike).where("submission_id_a < submission_id_b").select(*keys, *ordered, *counts)
    return across.unionByName(inside)


def candidate_pairs(sets: DataFrame, within: str | None = "assignment_id") -> DataFrame:
    """Pairs with a common hash and how many they share: (assignment_id,) a, b, shared."""
    return pair_counts(sets, within).select(*([within] if within else []), "a", "b", "shared")


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """candidates with place: by shared hashes, most first, within the assignment; ids decide ties."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("assignment_id").orderBy(F.desc("shared"), "a", "b")))


def ranked_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """ranked_candidates(candidate_pairs()) of class_pairs() and class_members() within assignments: assignment_id, a, b, shared, place.

    No pair of members is sorted. Of each class and number of shared hashes
    the partners are numbered once, so the place of a pair is what comes
    before: pairs that share more, pairs of the same number whose first id is
    smaller, and of this id's own partners those up to the second.
    """
    both_ways = pairs.select("assignment_id", F.col("a").alias("rep"), F.col("b").alias("other"), "shared").unionByName(pairs.where("a <> b").select("assignment_id", F.col("b").alias("rep"), F.col("a").alias("other"), "shared"))
    group = ["assignment_id", "rep", "shared"]
    of = lambda name, rep: members.select("assignment_id", F.col("rep").alias(rep), F.col("submission_id").alias(name))
    partners = both_ways.join(merged(of("id", "other")), ["assignment_id", "other"]).select(*group, "id", F.lit(1).alias("partner"))
    firsts = both_ways.select(*group).distinct().join(merged(of("id", "rep")), ["assignment_id", "rep"]).select(*group, "id", F.lit(0).alias("partner"))
    # n: partners up to and with this id, whether it is a partner or a first one
    upto = Window.partitionBy(*group).orderBy("id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept(partners.unionByName(firsts).withColumn("n", F.sum("partner").over(upto)).withColumn("all", F.sum("partner").over(Window.partitionBy(*group))))
    a = placed.where("partner = 0").select(*group, F.col("id").alias("a"), F.col("n").alias("passed"), (F.col("all") - F.col("n")).alias("own"))
    earlier = Window.partitionBy("assignment_id").orderBy(F.desc("shared"), "a").rowsBetween(Window.unboundedPreceding, -1)
    a = a.where("own > 0").withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)) - F.col("passed"))
    b = placed.where("partner = 1").select(*group, F.col("id").alias("b"), "n")
    met = a.join(merged(b), group).where("b > a")
    return met.select("assignment_id", "a", "b", "shared", (F.col("before") + F.col("n")).cast("int").alias("place"))


def inverted_index(sets: DataFrame, block: int = 1000) -> DataFrame:
    """assignment_id, hash, block, submission_ids (sorted), n: a hash's holders, in blocks by their number, so that no list is longer than a block."""
    grouped = sets.groupBy("assignment_id", "hash", F.floor(F.col("submission_id") / block).alias("block")).agg(F.array_sort(F.collect_set("submission_id")).alias("submission_ids"))
    return grouped.withColumn("n", F.size("submission_ids").cast("long"))


def all_pairs(submissions: DataFrame) -> DataFrame:
    """How many pairs each assignment has without candidates: assignment_id, n, pairs."""
    n = F.count(F.lit(1))
    return submissions.groupBy("assignment_id").agg(n.alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def candidate_stats(submissions: DataFrame, candidates: DataFrame) -> DataFrame:
    """assignment_id, n, naive_pairs, candidates, reduction (percent, one decimal; 0 without pairs).

    candidates: pairs of submissions, or class_pairs(), whose members' pairs
    are counted without being written out.
    """
    pairs = F.lit(1)
    if "n_a" in candidates.columns:
        pairs = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.expr("n_a * n_b"))
    found = candidates.groupBy("assignment_id").agg(F.sum(pairs).alias("candidates"))
    joined = all_pairs(submissions).join(found, "assignment_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    saved = F.when(F.col("pairs") == 0, F.lit(0.0)).otherwise(F.round((1 - F.col("candidates") / F.col("pairs")) * 100, 1))
    return joined.select("assignment_id", "n", F.col("pairs").alias("naive_pairs"), "candidates", saved.alias("reduction"))


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"))


def with_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs with size_a and size_b."""
    of = lambda side: merged(sizes.select("assignment_id", F.col("submission_id").alias(side), F.col("size").alias(f"size_{side}")))
    return pairs.join(of("a"), ["assignment_id", "a"]).join(of("b"), ["assignment_id", "b"])


def jaccard(pairs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """assignment_id, a, b, intersection, union, size_a, size_b, score of candidate pairs; without sizes, of pair_counts(), which has them."""
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    sized = pairs if sizes is None else with_sizes(pairs, sizes)
    return sized.select("assignment_id", "a", "b", F.col("shared").alias("intersection"), union.alias("union"), "size_a", "size_b", (F.col("shared") / union).alias("score"))


def containment(pairs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """assignment_id, a, b, a_in_b, b_in_a: the share of one set in the other; sizes as in jaccard()."""
    sized = pairs if sizes is None else with_sizes(pairs, sizes)
    return sized.select("assignment_id", "a", "b", (F.col("shared") / F.col("size_a")).alias("a_in_b"), (F.col("shared") / F.col("size_b")).alias("b_in_a"))


def union_hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("hash").union(right.select("hash")).distinct()


def intersect_hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("hash").intersect(right.select("hash"))


def except_hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("hash").distinct().join(right.select("hash").distinct(), "hash", "left_anti")
