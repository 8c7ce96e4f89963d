"""Several systems at once: outcomes of all their lists, declared comparisons, and what a hop added to each question.

Lists are ``(system, qid, unit_id, rank)``, contexts ``(system, qid, budget, unit_id)``; systems and
comparisons are small declared tables, questions and units are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplattice.operators import graph, metrics, pack, paired
from hoplattice.operators.rank import top_k
from hoplattice.sources.tables import small, stored


def contexts(lists: DataFrame, tokens: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(system, qid, budget, place, unit_id)``: the fill of every system's lists in one pass."""
    keyed = lists.select(F.struct("system", "qid").alias("qid"), "unit_id", "rank")
    return pack.fill_contexts(keyed, tokens, budgets).select("qid.*", "budget", "place", "unit_id")


def outcomes(filled: DataFrame, systems: DataFrame, questions: DataFrame, qrels: DataFrame, budgets: DataFrame) -> DataFrame:
    """Context metrics of every system, question and budget; a system without a list for a question has zeros there."""
    gold = qrels.select("qid", "unit_id", F.lit(1).alias("is_gold")).distinct()
    found = filled.join(gold, ["qid", "unit_id"], "left").groupBy("system", "qid", "budget").agg(F.count("*").alias("units"), F.sum(F.coalesce("is_gold", F.lit(0))).alias("found"))
    cells = systems.select("system").distinct().crossJoin(budgets.select(F.col("budget").cast("long").alias("budget")))
    full = metrics.gold_counts(questions, qrels).crossJoin(F.broadcast(cells)).join(found, ["system", "qid", "budget"], "left").fillna(0, ["units", "found"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return full.select(
        "system", "qid", "budget", "units", share("found", "n_gold").alias("gold_recall"),
        ((F.col("n_gold") > 0) & (F.col("found") == F.col("n_gold"))).cast("int").alias("full_support"), share("found", "units").alias("context_precision"),
    )


def _sides(measured: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(comparison, budget, qid, a, b, recall_a, recall_b)``: a row for each comparison that a question takes part in.

    Pairs are a small table, so a question's rows meet the comparisons they take part in where they lie; one shuffle brings both
    sides together. A question that one side lacks or has twice is an error.
    """
    role = lambda c, side: F.struct(F.col(c).alias("system"), F.lit(side).alias("side"))
    roles = pairs.select("comparison", F.explode(F.array(role("candidate", "a"), role("control", "b"))).alias("r")).select("comparison", "r.*")
    both = measured.select("system", "qid", "budget", "full_support", "gold_recall").join(F.broadcast(roles), "system")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    met = both.groupBy("comparison", "budget", "qid").agg(
        F.count("*").alias("_n"), of("a", "full_support").alias("a"), of("b", "full_support").alias("b"), of("a", "gold_recall").alias("recall_a"), of("b", "gold_recall").alias("recall_b")
    )
    wrong = F.raise_error(F.concat(F.lit("not one outcome a side in "), "comparison", F.lit(", question "), F.col("qid").cast("string")))
    sound = (F.col("_n") == 2) & F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.withColumn("a", F.when(sound, F.col("a")).otherwise(wrong.cast("int"))).drop("_n")


def comparison_set(measured: DataFrame, pairs: DataFrame) -> DataFrame:
    """All declared comparisons ``(comparison, control, candidate)`` at every budget: counts, tests, label, and recall differences.

    Differences are candidate less control. A comparison whose systems have no outcomes is an error, not a missing row.
    """
    sides = _sides(measured, pairs)
    cell = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long"))
    gap = F.col("recall_a") - F.col("recall_b")
    tables = sides.groupBy("comparison", "budget").agg(
        cell(1, 1).alias("both"), cell(1, 0).alias("only_a"), cell(0, 1).alias("only_b"), cell(0, 0).alias("neither"), F.count("*").alias("n"),
        F.round(F.avg(gap), 9).alias("recall_difference"), *(F.sum(c.cast("long")).alias(name) for name, c in (("better", gap > 0), ("worse", gap < 0), ("equal", gap == 0))),
    )
    named = pairs.join(tables, "comparison", "left")
    absent = F.raise_error(F.concat(F.lit("no outcomes for comparison "), F.col("comparison")))
    return paired.compared(named.withColumn("n", F.when(F.col("n").isNull(), absent.cast("long")).otherwise(F.col("n"))))


def disagreements(measured: DataFrame, pairs: DataFrame, per_group: int = 10) -> DataFrame:
    """``(comparison, budget, winner, size, qid)``: the questions that one side alone supports, the first few of each group, and its size."""
    apart = _sides(measured, pairs).where("a <> b").select("comparison", "budget", F.when(F.col("a") == 1, "candidate").otherwise("control").alias("winner"), "qid")
    group = ("comparison", "budget", "winner")
    first = top_k(apart, per_group, group, (F.asc("qid"),)).drop("rank")
    return first.join(F.broadcast(apart.groupBy(*group).agg(F.count("*").alias("size"))), list(group)).select(*group, "size", "qid")


def differing_lists(kept: DataFrame, again: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``(*by, places, differing)`` of each list: ranks on either side, and those where unit or score differ or one side ends.

    Stored and recomputed lists meet by rank in one join; equal lists have ``differing`` 0.
    """
    side = lambda df, p: df.select(*by, "rank", F.struct("unit_id", "score").alias(p))
    met = side(kept, "kept").join(side(again, "again"), [*by, "rank"], "full")
    return met.groupBy(*by).agg(F.count("*").alias("places"), F.sum((~F.col("kept").eqNullSafe(F.col("again"))).cast("long")).alias("differing"))


def _first_units(first: DataFrame, incidence: DataFrame) -> DataFrame:
    """``(qid, p1, p1_nodes)``: the list's first unit and how many nodes it has."""
    p1 = first.where("rank = 1").select("qid", F.col("unit_id").alias("p1"))
    held = small(p1).join(incidence.select(F.col("unit_id").alias("p1"), "node_id").distinct(), "p1").groupBy("qid").agg(F.count("*").alias("p1_nodes"))
    return p1.join(held, "qid", "left").fillna(0, ["p1_nodes"])


def hop_record(questions: DataFrame, first: DataFrame, hop: DataFrame, fused: DataFrame, context: DataFrame, qrels: DataFrame, incidence: DataFrame) -> DataFrame:
    """What a hop brought each question, to stand beside its outcome.

    ``positives`` are all candidates, ``proposed`` those that the hop's list holds. Of the gold outside the first list
    (``gold_outside``): how much the hop proposes, the fused list holds and the context ``(qid, unit_id)`` holds.
    A question without a list has no first unit and zeros.
    """
    outside = qrels.select("qid", "unit_id").distinct().join(first.select("qid", "unit_id"), ["qid", "unit_id"], "left_anti")
    for df, name in ((hop, "gold_proposed"), (fused, "gold_introduced"), (context, "gold_in_context")):
        outside = outside.join(df.select("qid", "unit_id", F.lit(1).alias(name)).distinct(), ["qid", "unit_id"], "left")
    names = ("gold_proposed", "gold_introduced", "gold_in_context")
    gold = outside.groupBy("qid").agg(F.count("*").alias("gold_outside"), *(F.count(n).alias(n) for n in names))
    sizes = hop.groupBy("qid").agg(F.max("positives").alias("positives"), F.count("*").alias("proposed"))
    whole = questions.select("qid").distinct().join(_first_units(first, incidence), "qid", "left").join(sizes, "qid", "left").join(gold, "qid", "left")
    counts = ("p1_nodes", "positives", "proposed", "gold_outside", *names)
    return whole.fillna(0, list(counts)).select("qid", "p1", *(F.col(c).cast("long").alias(c) for c in counts))


def hop_diagnostics(questions: DataFrame, first: DataFrame, hop: DataFrame, context: DataFrame, control: DataFrame, incidence: DataFrame, depth: int = 100, read: int = 10) -> DataFrame:
    """One row for each question: shape of the hop's list, its overlap with the first list, and context units that this list lacks.

    ``abstained``: no two scores differ, so scaling makes them all 0 (an empty list too). ``bottom_tier``: candidates that share
    the lowest score. ``context`` and ``control`` are ``(qid, unit_id)`` of the system with the hop and of one without.
    """
    tiers = hop.groupBy("qid", "score").agg(F.count("*").alias("n"), F.max("positives").alias("positives"))
    shape = tiers.groupBy("qid").agg(F.max("positives").alias("positives"), F.sum("n").alias("size"), F.count("*").alias("tiers"), F.min_by("n", "score").alias("bottom_tier"))
    later = first.where((F.col("rank") > read) & (F.col("rank") <= depth)).select("qid", "unit_id")
    shared = later.join(hop.select("qid", "unit_id"), ["qid", "unit_id"]).groupBy("qid").agg(F.count("*").alias("overlap"))
    listed = first.where(F.col("rank") <= depth).select("qid", "unit_id")
    beyond = lambda df, name: df.select("qid", "unit_id").join(listed, ["qid", "unit_id"], "left_anti").groupBy("qid").agg(F.count("*").alias(name))
    whole = questions.select("qid").distinct()
    for part in (_first_units(first, incidence), shape, shared, beyond(context, "context_beyond"), beyond(control, "control_beyond")):
        whole = whole.join(part, "qid", "left")
    counts = ("p1_nodes", "positives", "size", "bottom_tier", "overlap", "context_beyond", "control_beyond")
    whole = whole.fillna(0, [*counts, "tiers"])
    flags = {"reaches_depth": F.col("size") == depth, "empty": F.col("size") == 0, "single": F.col("size") == 1, "abstained": F.col("tiers") <= 1}
    return whole.select("qid", "p1", *(F.col(c).cast("long").alias(c) for c in counts), *(c.cast("int").alias(n) for n, c in flags.items()))


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    """A row for each figure of ``hop_diagnostics``: total, least, mean, median and most over questions; a flag's total counts its questions."""
    figures = [c for c in diagnostics.columns if c not in ("qid", "p1")]
    long = diagnostics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("long").alias("x")) for c in figures))).alias("f")).select("f.*")
    return long.groupBy("figure").agg(
        F.count("*").alias("questions"), F.sum("x").alias("total"), F.min("x").alias("least"), F.round(F.avg("x"), 9).alias("mean"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("most")
    )


def traces(first: DataFrame, plain: DataFrame, context: DataFrame, fused: DataFrame, hop: DataFrame, seeds: DataFrame, incidence: DataFrame) -> DataFrame:
    """Where each context unit that the first list's own context ``plain`` lacks comes from.

    ``origin`` is ``hop`` for units of the hop's list, with rank, score and the nodes shared with the first unit, heaviest first,
    and ``reorder`` for units that fusion moved up. ``seeds(qid, node_id, w)`` are the first unit's nodes.
    """
    new = context.select("qid", "unit_id").join(plain.select("qid", "unit_id"), ["qid", "unit_id"], "left_anti")
    placed = new.join(fused.select("qid", "unit_id", F.col("rank").alias("fused_rank")), ["qid", "unit_id"], "left")
    own = hop.select("qid", "unit_id", F.col("rank").alias("hop_rank"), "score")
    met = placed.join(own, ["qid", "unit_id"], "left").join(first.where("rank = 1").select("qid", F.col("unit_id").alias("p1")), "qid", "left")
    nodes = graph.contributions(seeds, incidence, new.join(own, ["qid", "unit_id"], "left_semi"))
    none = F.array().cast(dict(nodes.dtypes)["nodes"])
    origin: Column = F.when(F.col("hop_rank").isNull(), "reorder").otherwise("hop")
    return met.join(nodes, ["qid", "unit_id"], "left").select("qid", "unit_id", origin.alias("origin"), "p1", "hop_rank", "score", "fused_rank", F.coalesce("nodes", none).alias("nodes"))


def twin_gold(filled: DataFrame, systems: DataFrame, qrels: DataFrame, units: DataFrame) -> DataFrame:
    """How far each system's support depends on which of several near-equal units counts as gold: a row a system.

    ``filled(system, qid, unit_id)`` are contexts at one budget, ``units(unit_id, title, opening)``; units that share title and opening are
    twins, and one without either has none. Gold units with a twin are counted as in the context, as replaced by a twin there
    (``twin_instead``) or as neither; ``flips`` are questions that only a twin completes. Contexts and gold meet by their class of twins, so a
    class of any size costs a row for each of its units and never pairs.
    """
    gold = qrels.select("qid", "unit_id").distinct()
    wanted = gold.select("unit_id").union(filled.select("unit_id")).distinct()
    sizes = units.groupBy("title", "opening").agg(F.count("*").alias("n")).where("n > 1 AND title IS NOT NULL AND opening IS NOT NULL")
    classes = units.join(small(wanted), "unit_id", "left_semi").join(sizes, ["title", "opening"]).select("unit_id", F.sha2(F.to_json(F.struct("title", "opening")), 256).alias("twins"))
    classes = stored(classes, "twins")
    marked = stored(gold.join(classes, "unit_id", "left"), "gold-twins")
    held = filled.select("system", "qid", "unit_id", F.lit(1).alias("held")).distinct()
    shown = filled.join(classes, "unit_id").select("system", "qid", "twins", F.lit(1).alias("shown")).distinct()
    cells = systems.select("system").distinct().crossJoin(marked)
    met = cells.join(held, ["system", "qid", "unit_id"], "left").join(shown, ["system", "qid", "twins"], "left").fillna(0, ["held", "shown"])
    paired_up, twin = F.col("twins").isNotNull(), (F.col("held") == 0) & (F.col("shown") == 1)
    count = lambda c: F.sum(c.cast("long"))
    per = met.groupBy("system", "qid").agg(
        count(paired_up).alias("with_twin"), count(paired_up & (F.col("held") == 1)).alias("in_context"), count(twin).alias("instead"), F.min("held").alias("strict"), F.min(F.greatest("held", "shown")).alias("lenient")
    )
    return per.groupBy("system").agg(
        count(F.col("with_twin") > 0).alias("affected"), F.sum("in_context").alias("gold_in_context"), F.sum("instead").alias("twin_instead"),
        F.sum(F.col("with_twin") - F.col("in_context") - F.col("instead")).alias("neither"), count(F.col("strict") == 1).alias("supported"), count(F.col("lenient") == 1).alias("supported_with_twins"), count(F.col("strict") != F.col("lenient")).alias("flips"),
    )
