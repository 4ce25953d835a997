"""Benchmark records: which count, paired comparisons, intervals, verdicts, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, AGAIN = "json-compact", "json-compact-2"
ARM = ("correct", "input_tokens", "output_tokens", "latency_ms")


def succeeded() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def counted(records: DataFrame) -> DataFrame:
    """The last successful record of each model, question and format."""
    w = Window.partitionBy("model", "question_id", "format").orderBy(F.desc("ordinal"))
    return records.where(succeeded()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def calls(records: DataFrame) -> DataFrame:
    """Per model and format: calls, questions tried, questions without any success, empty replies, calls that are gone."""
    key = ["model", "question_id", "format"]
    tried = records.groupBy(*key).agg(
        F.count("*").alias("calls"), F.bool_or(succeeded()).alias("ok"), F.count_if(F.coalesce("empty", F.lit(False))).alias("empties"), F.count_if(F.col("error") == "HTTP 410").alias("gone")
    )
    return tried.groupBy("model", "format").agg(
        F.sum("calls").alias("calls"), F.count("*").alias("tried"), F.count_if(~F.col("ok")).alias("failed"), F.sum("empties").alias("empties"), F.sum("gone").alias("gone")
    )


def _last(name: str, columns: Sequence[str]) -> Column:
    """Of a format's rows the last one's columns, as a struct; null without any."""
    return F.max_by(F.struct(*columns), F.when(F.col("format") == name, F.col("ordinal")))


def arm_pairs(records: DataFrame, arms: Sequence[str], base: str = BASE) -> DataFrame:
    """Per model, question and arm (format) with both sides: a_… of the base and b_… of the arm, each from the last success.

    A question's records meet once, already reduced to one for each format by every task: one shuffle, no join, no window."""
    rows = records.where(succeeded() & F.col("format").isin(base, *arms))
    sides = F.array(*[F.struct(F.lit(f).alias("format"), _last(f, ARM).alias("b")) for f in arms])
    whole = rows.groupBy("model", "question_id").agg(F.min("dataset").alias("dataset"), F.min("kind").alias("kind"), _last(base, ARM).alias("a"), sides.alias("s"))
    met = whole.select("model", "question_id", "dataset", "kind", "a", F.explode("s").alias("s")).where(F.col("a").isNotNull() & F.col("s.b").isNotNull())
    return met.select("model", "question_id", "dataset", "kind", "s.format", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ARM], *[F.col(f"s.b.{c}").alias(f"b_{c}") for c in ARM])


def pairs(records: DataFrame, arm: str, base: str = BASE) -> DataFrame:
    """arm_pairs() of one arm."""
    return arm_pairs(records, [arm], base).drop("format")


def paired_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = F.col("a_correct"), F.col("b_correct")
    total = lambda c: F.sum(c).cast("long").alias(c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(a).alias("ok_a"), F.count_if(b).alias("ok_b"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("won"),
        *[total(f"{x}_{c}") for c in ("input_tokens", "output_tokens") for x in "ab"],
    )


def share(over: Column, under: Column) -> Column:
    return F.when(under > 0, over.cast("double") / under.cast("double")).otherwise(F.lit(0.0))


def accuracy_change() -> Column:
    return share(F.col("ok_b") - F.col("ok_a"), F.col("n"))


def input_saving() -> Column:
    return F.lit(1.0) - share(F.col("b_input_tokens"), F.col("a_input_tokens"))


def output_change() -> Column:
    return F.when(F.col("a_output_tokens") > 0, share(F.col("b_output_tokens"), F.col("a_output_tokens")) - 1.0).otherwise(F.lit(0.0))


def net_saving(price: float = 4.0, turns: float = 1.0) -> Column:
    """Savings of cost when input is sent `turns` times and output has `price` times the price."""
    cost = lambda x: F.lit(turns) * F.col(f"{x}_input_tokens").cast("double") + F.lit(price) * F.col(f"{x}_output_tokens").cast("double")
    return F.lit(1.0) - cost("b") / cost("a")


#: Conversations of T turns in which a share c of each later turn's input is sent again.
TURNS = ((1, 1.0), (3, 1.0), (10, 1.0), (3, 0.1), (10, 0.1))


def multi_turn(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    cases = [F.struct(F.lit(t).alias("turns"), F.lit(c).alias("resent"), net_saving(turns=1 + c * (t - 1)).alias("net")) for t, c in TURNS]
    return sums.select(*keys, F.explode(F.array(*cases)).alias("x")).select(*keys, "x.*")


#: Distribution of a Poisson variable of mean 1, as whole parts of DRAWS; fixed values.
DRAWS = 1_000_003
POISSON = tuple(round(DRAWS * p) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676))


def draw(item: Column, resample: Column) -> Column:
    """How often a resample takes an item: Poisson with mean 1, from a number made of both, so that it is the same anywhere."""
    mixed = (item + 1) * 48271 % DRAWS * (resample * 7919 + 104729) % DRAWS
    u = (mixed * mixed % DRAWS * 31 + item * 69621 + resample * 16807) % DRAWS
    return sum((F.when(u >= p, F.lit(1)).otherwise(F.lit(0)) for p in POISSON), F.lit(0)).cast("long")


#: What intervals are made of, from a resample's sums.
METRICS = {"change": accuracy_change, "input_change": lambda: -input_saving(), "output_change": output_change, "net_saving": net_saving}


def bootstrap(rows: DataFrame, keys: Sequence[str], resamples: int = 2000, metrics: dict | None = None, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per key the number of pairs, and an interval of each metric (x_lo, x_hi) over resamples of its pairs by question.

    A resample weighs each pair by draw() (the Poisson bootstrap), so that pairs never meet and partial sums of a task are
    one row for each key and resample. Bounds are elements of the sorted values, not interpolated; a resample without a
    pair has no value."""
    metrics = METRICS if metrics is None else metrics
    every = rows.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    own = every.withColumn("w", draw(F.col("question_id").cast("long"), F.col("r"))).where("w > 0")
    a, b, w = F.col("a_correct").cast("int"), F.col("b_correct").cast("int"), F.col("w")
    tokens = [F.sum(F.col(f"{x}_{c}") * w).cast("long").alias(f"{x}_{c}") for c in ("input_tokens", "output_tokens") for x in "ab"]
    sums = own.groupBy(*keys, "r").agg(F.sum("w").alias("n"), F.sum(a * w).alias("ok_a"), F.sum(b * w).alias("ok_b"), *tokens)
    values = sums.select(*keys, *[m().alias(name) for name, m in metrics.items()])
    lists = values.groupBy(*keys).agg(*[F.array_sort(F.collect_list(m)).alias(m) for m in metrics])
    at = lambda m, p: F.get(m, F.floor(F.lit(p) * (F.size(m) - 1) + 0.5).cast("int"))
    bounds = [at(m, p).alias(f"{m}_{side}") for m in metrics for side, p in (("lo", low), ("hi", high))]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(lists.select(*keys, *bounds), list(keys))


VERDICTS = ("worse than JSON", "inconclusive", "non-inferior")


def verdict(margin: float = 0.03, lo: str = "change_lo", hi: str = "change_hi") -> Column:
    return F.when(F.col(lo) > -margin, VERDICTS[2]).when(F.col(hi) < -margin, VERDICTS[0]).otherwise(VERDICTS[1])


def rank(verdict: Column) -> Column:
    """From 1 for the worst verdict."""
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict)


def fail_rate(records: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per key the share of questions and formats tried that never succeeded; calls of a model that is gone don't count."""
    asked = records.where(F.coalesce(F.col("error"), F.lit("")) != "HTTP 410")
    tried = asked.groupBy(*keys, "question_id", "format").agg(F.bool_or(succeeded()).alias("ok"))
    return tried.groupBy(*keys).agg(share(F.count_if(~F.col("ok")), F.count("*")).alias("fail_rate"))


def verify_report(records: DataFrame, arms: Sequence[str], resamples: int = 2000, most_failed: float = 0.1) -> DataFrame:
    """Per model and arm against the plain form: accuracy, flips, interval and verdict (none where too many calls failed;
    the second plain arm is the noise floor), changes of tokens with intervals, and the median ratio of latencies."""
    rows = arm_pairs(records, arms)
    keys = ["model", "format"]
    ratio = F.when(F.col("a_latency_ms") > 0, F.col("b_latency_ms").cast("double") / F.col("a_latency_ms").cast("double"))
    sums = paired_sums(rows, keys).join(rows.groupBy(*keys).agg(F.median(ratio).alias("latency_ratio")), keys)
    met = sums.join(bootstrap(rows, keys, resamples).drop("n"), keys).join(fail_rate(records), "model")
    said = F.when(F.col("format") == AGAIN, "noise floor").when(F.col("fail_rate") > most_failed, "no verdict").otherwise(verdict())
    return met.select(
        *keys, "n", share(F.col("ok_a"), F.col("n")).alias("accuracy_a"), share(F.col("ok_b"), F.col("n")).alias("accuracy_b"), share(F.col("lost") + F.col("won"), F.col("n")).alias("flips"),
        accuracy_change().alias("change"), "change_lo", "change_hi", said.alias("verdict"), (-input_saving()).alias("input_change"), "input_change_lo", "input_change_hi",
        output_change().alias("output_change"), "output_change_lo", "output_change_hi", net_saving().alias("net_saving"), "net_saving_lo", "net_saving_hi", "latency_ratio", "fail_rate",
    )


def primer_report(records: DataFrame, variant: str, of: str, resamples: int = 2000) -> DataFrame:
    """Per model: is the variant cheaper than what it varies (the whole interval of the cost's change below 0), and is its
    accuracy verdict against the plain form no worse."""
    cost = {"cost": lambda: -net_saving()}
    cheaper = bootstrap(pairs(records, variant, of), ["model"], resamples, cost).select("model", "n", "cost_lo", "cost_hi", (F.col("cost_hi") < 0).alias("cheaper"))
    said = lambda arm, name: bootstrap(pairs(records, arm), ["model"], resamples, {"change": accuracy_change}).select("model", rank(verdict()).alias(name))
    return cheaper.join(said(variant, "rank"), "model").join(said(of, "base_rank"), "model")


def live_verdict(alpha: float = 0.05, least: float = 0.15) -> Column:
    """From reduction, p, lost, won, drop and noise (the share of answers that two plain runs disagree on)."""
    harmed = F.col("lost") > F.col("won")
    return (
        F.when(F.col("reduction") < least, "NO-GO").when((F.col("p") <= alpha) & harmed, "NO-GO").when((F.col("drop") > F.col("noise") + 1e-9) & harmed, "HOLD").otherwise("GO")
    )


def unfinished(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def round_robin(questions: DataFrame, kind: str, order: Column, limit: int, tie: str, seen: str) -> DataFrame:
    """A sample that takes kinds in turn, as first seen: first each kind's first question in order, then the second ones."""
    w = Window.partitionBy(kind).orderBy(order, tie)
    firsts = questions.groupBy(kind).agg(F.min(seen).alias("_first"))
    placed = questions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).join(firsts, kind)
    return placed.orderBy("_rn", "_first").limit(limit).drop("_rn", "_first")


def first_seen(records: DataFrame, name: str, order: str = "ordinal") -> DataFrame:
    """Each value of a column with its place by first appearance, from 1: the order of questions, formats and models in
    reports. Few values, so the window over all of them is small."""
    firsts = records.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("_at"))
    return firsts.select(name, F.row_number().over(Window.orderBy("_at")).alias("place"))


#: The order of formats in reports; fixed.
FORMAT_ORDER = ("json-compact-2", "toonx", "toonx-p2", "gateway", "toon", "tabular", "csv")


def format_place(name: Column, order: Sequence[str] = FORMAT_ORDER) -> Column:
    """A format's place in reports; the plain form comes first, unknown ones last."""
    at = F.array_position(F.array(*[F.lit(f) for f in order]), name)
    return F.when(name == BASE, 0).when(at > 0, at).otherwise(len(order) + 1).cast("int")


def runs_together(*runs: DataFrame) -> DataFrame:
    """Several runs' records one after another: run (from 0) comes before ordinal, so the last run's success counts."""
    out = None
    for k, r in enumerate(runs):
        own = r.withColumn("ordinal", F.struct(F.lit(k).alias("run"), F.col("ordinal").alias("ordinal")))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def sample_by_id(items: DataFrame, key: str, n: int, drawn: Column) -> DataFrame:
    """The n items that are drawn first (all if n is 0), in order of the id. drawn: a number made of the id and a seed."""
    return (items if n <= 0 else items.orderBy(drawn, key).limit(n)).orderBy(key)


def arms_together(records: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("model", "question_id")) -> DataFrame:
    """A row for each question of a model that all arms answered, the arms' outcomes side by side (x_0, x_1, …)."""
    wide = _side_by_side(records, arms, keys)
    return wide.dropna(subset=[f"correct_{k}" for k in range(len(arms))])


def _side_by_side(records: DataFrame, arms: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rows = records.where(succeeded() & F.col("format").isin(*arms)).groupBy(*keys).agg(*[_last(f, ARM).alias(f"_{k}") for k, f in enumerate(arms)])
    return rows.select(*keys, *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for k in range(len(arms)) for c in ARM])


def judged_with_arms(judged: DataFrame, records: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("model", "question_id")) -> DataFrame:
    """Each judgement with what its arms answered; arms that are gone are null."""
    return judged.join(_side_by_side(records, arms, keys), list(keys), "left")


def judge_jobs(records: DataFrame, judged: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("provider", "model", "question_id")) -> DataFrame:
    """What is left to judge: questions of a model that every arm has answered and nobody has graded yet."""
    good = records.where(succeeded() & F.col("format").isin(*arms))
    whole = good.groupBy(*keys).agg(F.count_distinct("format").alias("arms")).where(F.col("arms") == len(set(arms))).select(*keys)
    return unfinished(whole, judged.where(succeeded()), keys)


def failed_calls(records: DataFrame, longest: int = 120) -> DataFrame:
    """Every failed call with its error on one line, cut to `longest` characters: the rows that reports list after the rest."""
    line = F.regexp_replace(F.col("error"), r"\s+", " ")
    cell = F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest), F.lit("…"))).otherwise(line)
    return records.where(~succeeded()).select("model", "question_id", "format", cell.alias("error"))


#: The most that the share of answers with an error may rise, by the upper bound of its interval.
FREE_FORM_MARGIN = 0.15


def free_form_report(judged: DataFrame, records: DataFrame, arms: Sequence[str] = (BASE, AGAIN, "toonx"), resamples: int = 2000, item: Column | None = None) -> DataFrame:
    """Per model and for all: tasks, each arm's share of answers with an error and its completeness, the interval of the
    last arm's share less the first's, whether it keeps the margin, and the arms' mean tokens and failed calls.

    judged: a row for each model, question and format with errors and complete. item: a task's number in the draws, by
    default a hash of model and question."""
    base, arm = arms[0], arms[-1]
    side = lambda f, c: F.max(F.when(F.col("format") == f, c))
    wrong = (F.col("errors") > 0).cast("int")
    tasks = judged.groupBy("model", "question_id").agg(*[side(f, wrong).alias(f"wrong_{k}") for k, f in enumerate(arms)], *[side(f, F.col("complete")).alias(f"complete_{k}") for k, f in enumerate(arms)])
    every = tasks.withColumn("scope", F.explode(F.array(F.col("model"), F.lit("all models"))))
    last = len(arms) - 1
    own = every.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    item = F.pmod(F.hash("model", F.col("question_id").cast("string")), F.lit(DRAWS)).cast("long") if item is None else item
    own = own.withColumn("w", draw(item, F.col("r"))).where("w > 0").groupBy("scope", "r").agg((F.sum((F.col(f"wrong_{last}") - F.col("wrong_0")) * F.col("w")) / F.sum("w")).alias("d"))
    bounds = own.groupBy("scope").agg(F.array_sort(F.collect_list("d")).alias("d"))
    at = lambda p: F.get("d", F.floor(F.lit(p) * (F.size("d") - 1) + 0.5).cast("int"))
    shares = every.groupBy("scope").agg(
        F.count("*").alias("tasks"), *[F.avg(f"wrong_{k}").alias(f"error_share_{k}") for k in range(len(arms))], *[F.avg(f"complete_{k}").alias(f"completeness_{k}") for k in range(len(arms))]
    )
    calls_ = records.where(F.col("format").isin(*arms)).withColumn("scope", F.explode(F.array(F.col("model"), F.lit("all models")))).groupBy("scope").agg(
        F.count("*").alias("calls"), F.count_if(~succeeded()).alias("failed"),
        *[F.avg(F.when(succeeded() & (F.col("format") == f), F.col(c))).alias(f"{c}_{k}") for k, f in ((0, base), (last, arm)) for c in ("input_tokens", "output_tokens")],
    )
    met = shares.join(bounds.select("scope", at(0.025).alias("rise_lo"), at(0.975).alias("rise_hi")), "scope").join(calls_, "scope", "left")
    return met.withColumn("keeps_margin", F.col("rise_hi") <= FREE_FORM_MARGIN)


def discordant(records: DataFrame, formats: Sequence[str]) -> DataFrame:
    """Per model and question the formats' outcomes side by side, and whether they differ."""
    rows = counted(records).where(F.col("format").isin(*formats))
    wide = rows.groupBy("model", "question_id").pivot("format", list(formats)).agg(F.first("correct"))
    seen = F.array_compact(F.array(*[F.col(f"`{f}`") for f in formats]))
    return wide.withColumn("differs", F.size(F.array_distinct(seen)) > 1)


def judged_share(judged: DataFrame) -> DataFrame:
    """Error share, completeness and tasks per model and format, and pooled over all models."""
    sums = judged.groupingSets([["model", "format"], ["format"]], "model", "format").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("errors") > 0).alias("wrong"), F.sum("complete").alias("complete"), F.grouping("model").alias("g")
    )
    return sums.select(
        F.when(F.col("g") == 1, F.lit("all models")).otherwise(F.col("model")).alias("model"), "format", "tasks",
        F.round(share(F.col("wrong"), F.col("tasks")), 9).alias("error_share"), F.round(share(F.col("complete"), F.col("tasks")), 9).alias("completeness"),
    )


def label_pairs(judged: DataFrame, keys: Sequence[str], label: str, same: str) -> DataFrame:
    """Each task's pairs of labels in order, and whether their answers are the same. Labels of a task are few and fixed."""
    a = judged.select(*keys, F.col(label).alias("l1"), F.col(same).alias("_x"))
    b = judged.select(*keys, F.col(label).alias("l2"), F.col(same).alias("_y"))
    return a.join(b, list(keys)).where(F.col("l1") < F.col("l2")).select(*keys, "l1", "l2", (F.col("_x") == F.col("_y")).alias("same"))


def primer_adopted(models: DataFrame, least: int = 3, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Per variant: adopted if the cost change's upper bound is below 0 on `least` models and no verdict ranks worse, which
    is a lower rank(). Without keys all models are of one variant, whose row is there without any, with nulls."""
    better, worse = F.col("cost_hi") < 0, F.col("rank") < F.col("base_rank")
    rows = models.groupBy(*keys).agg(F.sum(better.cast("long")).alias("cheaper"), F.sum(worse.cast("long")).alias("worse"))
    return rows.withColumn("adopted", (F.col("cheaper") >= least) & (F.col("worse") == 0))


def format_tokens(records: DataFrame, formats: Sequence[str]) -> DataFrame:
    """Input tokens of each data set in each format side by side, with a row for all."""
    rows = counted(records).rollup("dataset").agg(*[F.sum(F.when(F.col("format") == f, F.col("input_tokens"))).alias(f) for f in formats])
    return rows.withColumn("dataset", F.coalesce("dataset", F.lit("all")))


def limited(questions: DataFrame, per: str, order: str, n: int) -> DataFrame:
    """The first n questions of each group in order."""
    w = Window.partitionBy(per).orderBy(order)
    return questions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
