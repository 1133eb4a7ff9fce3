"""Consensus from several annotators' labels (problem 4).

Annotators are judges as they see an item: the same judge under either position of the answers is a rater of its own, so that
a liking for one position shows as confusion and not as opinion. Label posteriors of the items and confusion matrices of the
raters are estimated in turn by expectation-maximisation (Dawid and Skene, 1979) with smoothed counts. Each round is one Spark
job: votes meet the parameters of their rater, a window over the item gives its posterior, and expected counts are summed for
each rater on the map side first. Votes stay partitioned by item; parameters are staged tables, so plans don't grow, and Spark
broadcasts them only while they are small.

Votes without an item, judge or usable label don't count; a repeated vote id counts once. Ties of posteriors go to the first
label in the order of LABELS. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.session import release, stage

LABELS = ("open_source", "closed_source", "tie")
#: Words around a choice that don't change it, and words for a tie.
FRAME = ("option", "response", "winner", "choice", "answer", "assistant", "model", "the", "is", "better", "best", "wins", "verdict", "final", "my", "result", "candidate", "side")
TIE = ("tie", "tied", "draw", "drawn", "equal", "equally", "equals", "even", "same", "both")


def usable_choice(choice: Column) -> Column:
    """A, B or tie where a free spelling clearly means it, else null."""
    words = F.array_except(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(choice), "[^a-z]+", " ")), " ")), F.array(*map(F.lit, FRAME)))
    ties = F.array_intersect(words, F.array(*map(F.lit, TIE)))
    others = F.array_except(words, F.array(*map(F.lit, TIE)))
    return (
        F.when((F.size(ties) > 0) & ((F.size(others) == 0) | (others == F.array(F.lit("a")))), "tie")
        .when((F.size(ties) == 0) & (words == F.array(F.lit("a"))), "A")
        .when((F.size(ties) == 0) & (words == F.array(F.lit("b"))), "B")
    )


def usable_votes(df: DataFrame) -> DataFrame:
    """evaluation_id, item, judge, shown (what stands at A), label: one row for each usable vote of evaluation results."""
    once = df.groupBy("evaluation_id").agg(F.max_by(F.struct("question_id", "judge_model", "judge_choice", "position_mapping"), F.coalesce("loaded_at", F.to_timestamp(F.lit("1970-01-01")))).alias("x")).select("evaluation_id", "x.*")
    choice = usable_choice(F.col("judge_choice"))
    label = F.when(choice == "tie", "tie").otherwise(F.col("position_mapping")[choice])
    return once.select(
        "evaluation_id",
        F.col("question_id").alias("item"),
        F.lower(F.trim("judge_model")).alias("judge"),
        F.coalesce(F.col("position_mapping")["A"], F.lit("")).alias("shown"),
        label.alias("label"),
    ).where(F.col("item").isNotNull() & (F.length("judge") > 0) & F.col("label").isin(*LABELS))


def _posterior(votes: DataFrame, params: DataFrame | None) -> DataFrame:
    """votes with the posterior of their item (q0, q1, ...) and the number of the item's rows."""
    item = Window.partitionBy("item")
    k = len(LABELS)
    if params is None:  # from the shares of the votes
        score = [F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).over(item) + 0.1 for i in range(k)]
        raw = votes.select("*", *[s.alias(f"s{i}") for i, s in enumerate(score)], F.count("*").over(item).alias("rows"))
        total = sum((F.col(f"s{i}") for i in range(1, k)), F.col("s0"))
        return raw.select("item", "judge", "shown", "label", "n", "rows", *[(F.col(f"s{i}") / total).alias(f"q{i}") for i in range(k)])
    met = votes.join(params, ["judge", "shown", "label"])
    raw = met.select("*", *[(F.col(f"prior{i}") + F.sum(F.col("n") * F.col(f"log{i}")).over(item)).alias(f"s{i}") for i in range(k)], F.count("*").over(item).alias("rows"))
    top = F.greatest(*[f"s{i}" for i in range(k)])
    shares = raw.select("*", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return shares.select("item", "judge", "shown", "label", "n", "rows", *[(F.col(f"e{i}") / total).alias(f"q{i}") for i in range(k)])


def _sums(posterior: DataFrame) -> DataFrame:
    """A row for each rater: expected counts c<label><true label> of its votes, and its share m<true label> of the items' posteriors."""
    k = len(LABELS)
    counts = [F.sum(F.when(F.col("label") == v, F.col("n") * F.col(f"q{i}")).otherwise(0.0)).alias(f"c{v}{i}") for v in range(k) for i in range(k)]
    return posterior.groupBy("judge", "shown").agg(*counts, *[F.sum(F.col(f"q{i}") / F.col("rows")).alias(f"m{i}") for i in range(k)])


def _parameters(sums: DataFrame, smoothing: float) -> DataFrame:
    """judge, shown, label, log0.. (of the label given each true label), prior0.. (log), from expected counts."""
    k = len(LABELS)
    every = sums.agg(*[(F.sum(f"m{i}") + 1).alias(f"t{i}") for i in range(k)])  # one row
    smooth = [[F.col(f"c{v}{i}") + smoothing * (2.0 if v == i else 1.0) for i in range(k)] for v in range(k)]
    total = [sum((smooth[v][i] for v in range(1, k)), smooth[0][i]) for i in range(k)]
    prior = [F.log(F.col(f"t{i}") / sum((F.col(f"t{j}") for j in range(1, k)), F.col("t0"))).alias(f"prior{i}") for i in range(k)]
    labels = F.array(*[F.struct(F.lit(v).alias("label"), *[F.log(smooth[v][i] / total[i]).alias(f"log{i}") for i in range(k)]) for v in range(k)])
    return sums.crossJoin(F.broadcast(every)).select("judge", "shown", *prior, F.explode(labels).alias("x")).select("judge", "shown", "x.*", *[f"prior{i}" for i in range(k)])


def estimate(votes: DataFrame, smoothing: float = 1.0, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(items, raters). votes: item, judge, shown, label.

    items: item, consensus, posterior, judges, votes, agreement (share of agreeing pairs of votes, null for one vote).
    raters: judge, shown, label, log0.. and prior0.. as in _parameters. Rounds go on until no probability of a confusion matrix
    moves by tolerance; the smoothed likelihood grows in each, so they come to an end.
    """
    number = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")).cast("int") - 1
    counted = votes.groupBy("item", "judge", "shown", number.alias("label")).agg(F.count("*").alias("n"))
    staged = stage(counted, "votes")
    counted = staged.repartition("item").persist()  # by item once: no round shuffles the votes again
    sums = stage(_sums(_posterior(counted, None)), "raters")
    params = _parameters(sums, smoothing)
    while True:
        now = stage(_sums(_posterior(counted, params)), "raters")
        new = _parameters(now, smoothing)
        both = new.alias("x").join(params.alias("y"), ["judge", "shown", "label"])
        moved = both.agg(F.max(F.greatest(*[F.abs(F.exp(f"x.log{i}") - F.exp(f"y.log{i}")) for i in range(len(LABELS))]))).first()[0]
        release(sums)
        sums, params = now, new
        if moved is None or moved < tolerance:
            break
    posterior = _posterior(counted, params)
    q = [F.max(f"q{i}").alias(f"q{i}") for i in range(len(LABELS))]
    per_label = [F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(LABELS))]
    items = posterior.groupBy("item").agg(*q, *per_label, F.count_distinct("judge").alias("judges"), F.sum("n").alias("votes"))
    top = F.greatest(*[f"q{i}" for i in range(len(LABELS))])
    consensus = F.coalesce(*[F.when(F.col(f"q{i}") == top, F.lit(x)) for i, x in enumerate(LABELS)])
    pairs = sum((F.col(f"n{i}") * (F.col(f"n{i}") - 1) for i in range(1, len(LABELS))), F.col("n0") * (F.col("n0") - 1))
    items = items.select("item", consensus.alias("consensus"), top.alias("posterior"), "judges", "votes", F.when(F.col("votes") > 1, pairs / (F.col("votes") * (F.col("votes") - 1))).alias("agreement"))
    items = stage(items, "items")
    counted.unpersist()
    release(staged)
    return items, params


def reliability(raters: DataFrame, votes: DataFrame) -> DataFrame:
    """judge, votes, accuracy (mean probability of the right label over true labels and positions), leaning (to what stands at A)."""
    own = F.coalesce(*[F.when(F.col("label") == i, F.exp(f"log{i}")) for i in range(len(LABELS))])
    at_a = F.coalesce(*[F.when((F.col("shown") == x) & (F.col("label") == i), sum((F.exp(f"log{j}") for j in range(1, len(LABELS))), F.exp("log0")) / len(LABELS)) for i, x in enumerate(LABELS[:2])], F.lit(0.0))
    at_b = F.coalesce(*[F.when((F.col("shown") == x) & (F.col("label") == 1 - i), sum((F.exp(f"log{j}") for j in range(1, len(LABELS))), F.exp("log0")) / len(LABELS)) for i, x in enumerate(LABELS[:2])], F.lit(0.0))
    each = raters.groupBy("judge", "shown").agg(F.avg(own).alias("accuracy"), F.sum(at_a - at_b).alias("leaning"))
    counts = votes.groupBy("judge").agg(F.count("*").alias("votes"))
    return each.groupBy("judge").agg(F.avg("accuracy").alias("accuracy"), F.avg("leaning").alias("leaning")).join(counts, "judge").select("judge", "votes", "accuracy", "leaning")


def chance_corrected(votes: DataFrame) -> DataFrame:
    """One row: items with two votes or more, their votes, observed and expected agreement, and Krippendorff's alpha (nominal)."""
    each = votes.groupBy("item").agg(*[F.count(F.when(F.col("label") == x, 1)).alias(f"n{i}") for i, x in enumerate(LABELS)], F.count("*").alias("votes")).where("votes > 1")
    pairs = sum((F.col(f"n{i}") * (F.col(f"n{i}") - 1) for i in range(1, len(LABELS))), F.col("n0") * (F.col("n0") - 1))
    sums = each.agg(F.count("*").alias("items"), F.sum("votes").alias("votes"), F.sum(pairs / (F.col("votes") - 1)).alias("same"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(LABELS))])
    expected = pairs / (F.col("votes") * (F.col("votes") - 1))
    return sums.select("items", "votes", (F.col("same") / F.col("votes")).alias("observed"), expected.alias("expected")).select("*", ((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("alpha"))
