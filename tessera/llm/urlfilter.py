"""URL filter by a ratio of character language models. DataFrame functions only.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, give every character the logarithm of the ratio of its probabilities;
their mean over the whole URL, scheme, query and fragment included, is the score,
and URLs below a calibrated threshold are rejected.

*Models.* Characters fall into ``len(ALPHABET) + 2`` classes (digits are one).
Runs of up to ``LONGEST`` classes are counted in both sets. Probabilities are
smoothed from short to long (Witten-Bell): ``(n(context, c) + t(context) *
p_shorter) / (n(context) + t(context))``, ``t`` the number of distinct
successors. A character is judged in the longest context in which it was seen
at all (``MIN_COUNT`` times), so the order varies from place to place. That choice is
made once for each of the ``classes ** LONGEST`` (about a million) possible runs, whatever
the number of URLs: the model is one array of their ratios in one row (8 MB), sent to
every task, and a URL is scored by adding up entries of it.

*What teaches.* URLs that a rule blocks and those with a word of ``REJECT_WORDS``
in the host are rejected; those that a rule allows, and those that nothing
speaks against, are accepted (the background that a rejected URL stands out
from). Repeated URLs teach once. One in ``HELD_OUT`` (by hash) does not teach.

*Calibration.* The threshold is the score that all but ``MAX_LOSS`` of the held-out
accepted URLs reach (never above 0, the point of equal likelihood), read off exact
counts of scores rounded to three places.

URLs are scored once per distinct text, so a hot URL is no hot group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import store

#: Characters with a class of their own; digits share one, everything else shares one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz/.-_"
CLASSES = len(ALPHABET) + 2
LONGEST = 4
MIN_COUNT = 2
MAX_LOSS = 0.01
#: One URL in so many is held out of training; the threshold is read off these.
HELD_OUT = 5
BLOCK_TEXTS = 1024

#: Host words of rejected sites (weak labels, for training only).
REJECT_WORDS = ["casino", "bets", "betting", "poker", "pills", "viagra", "adult", "porn", "xxx", "spam", "malware", "phish", "ads-track", "clickbait", "payday", "warez"]

#: Host (with its subdomains), start of the path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``) and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # longer ones come later and win
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def classes_of(text: Column) -> Column:
    """Class numbers of the characters: 0 pads and stands for all others, 1 digits."""
    letters = F.translate(F.lower(text), "0123456789", "0" * 10)
    each = F.filter(F.split(letters, ""), lambda c: F.length(c) > 0)
    return F.transform(each, lambda c: F.when(c == "0", 1).otherwise(F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) + 1).otherwise(0)))


def runs_of(text: Column) -> Column:
    """One number per character: its class and those of the ``LONGEST - 1`` before it."""
    pad = F.array(*[F.lit(0)] * (LONGEST - 1))

    def numbers(padded: Column) -> Column:
        number = lambda i: functools.reduce(lambda acc, k: acc * CLASSES + F.get(padded, i + k), range(1, LONGEST), F.get(padded, i))
        # sequence(0, -1) would count downwards
        return F.when(F.size(padded) < LONGEST, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(padded) - LONGEST, F.lit(0))), number))

    # a variable of a lambda is computed once; a column in one, again for every element
    return F.get(F.transform(F.array(F.concat(pad, classes_of(text))), numbers), 0)


def train(labelled: DataFrame) -> DataFrame:
    """``order, run, ratio``: log probability ratio of the last class of a run
    after the others, from distinct ``labelled(text, accepted boolean)``."""
    counts = labelled.distinct().select("accepted", F.explode(runs_of(F.col("text"))).alias("run")).groupBy("run").agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    counts = store(counts, "url-runs")
    parts = []
    shorter: DataFrame | None = None
    for order in range(1, LONGEST + 1):
        grams = counts.groupBy((F.col("run") % CLASSES**order).cast("int").alias("run")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.floor(F.col("run") / CLASSES).cast("int")
        seen = grams.groupBy(context.alias("context")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        grams = grams.withColumn("context", context).join(F.broadcast(seen), "context")
        if shorter is None:
            pa, pr = F.lit(1.0 / CLASSES), F.lit(1.0 / CLASSES)
        else:
            grams = grams.withColumn("tail", (F.col("run") % CLASSES ** (order - 1)).cast("int")).join(shorter.select(F.col("run").alias("tail"), F.col("pa").alias("sa"), F.col("pr").alias("sr")), "tail")
            pa, pr = F.col("sa"), F.col("sr")
        smooth = lambda n, total, kinds, p: F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        shorter = store(
            grams.select("run", "a", "r", smooth(F.col("a"), F.col("na"), F.col("ta"), pa).alias("pa"), smooth(F.col("r"), F.col("nr"), F.col("tr"), pr).alias("pr")),
            "url-probabilities",
        )
        parts.append(shorter.where((F.col("a") + F.col("r") >= MIN_COUNT) & (F.col("pa") > 0) & (F.col("pr") > 0)).select(F.lit(order).alias("order"), "run", F.log(F.col("pa") / F.col("pr")).alias("ratio")))
    return functools.reduce(DataFrame.union, parts)


def dense(model: DataFrame) -> DataFrame:
    """``ratios``: one row with the log ratio of every run of ``LONGEST`` classes, that of the
    longest end of the run that the models know (0 if they know none)."""
    every = model.sparkSession.range(CLASSES**LONGEST).select(F.col("id").cast("int").alias("run"))
    for order in range(LONGEST, 0, -1):
        own = model.where(F.col("order") == order).select(F.col("run").alias("tail"), F.col("ratio").alias(f"ratio{order}"))
        every = every.join(own, F.col("run") % CLASSES**order == F.col("tail"), "left").drop("tail")
    ratio = F.coalesce(*[F.col(f"ratio{k}") for k in range(LONGEST, 0, -1)], F.lit(0.0))
    rows = F.array_sort(F.collect_list(F.struct("run", ratio.alias("ratio"))))  # a fixed number of rows
    return every.agg(F.transform(rows, lambda r: r["ratio"]).alias("ratios"))


def mean_ratio(text: Column, ratios: Column) -> Column:
    """Mean log ratio per character, rounded to six places; 0 for an empty text."""
    total = F.aggregate(runs_of(text), F.lit(0.0), lambda acc, run: acc + F.get(ratios, run))
    return F.when(F.length(text) > 0, F.round(total / F.length(text), 6)).otherwise(F.lit(0.0))


def score_texts(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Distinct ``texts(text, ...)`` with their ``score``.

    Texts are scored in blocks of about ``BLOCK_TEXTS``: a joined row carries its own copy of the
    model's array, so there is one for a block, not one for a URL."""
    blocks = max(1, -(-texts.count() // BLOCK_TEXTS))
    packed = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*texts.columns)).alias("urls"))
    scored = F.transform("urls", lambda x: F.struct(*[x[c].alias(c) for c in texts.columns], mean_ratio(x["text"], F.col("ratios")).alias("score")))
    return packed.join(F.broadcast(ratios)).select(F.inline(scored))


def threshold(scored: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """Score that all but ``max_loss`` of the accepted ``scored(score)`` reach, at most 0."""
    bins = scored.groupBy(F.round("score", 3).alias("score")).agg(F.count("*").alias("n"))
    value = bins.agg(F.percentile("score", max_loss, F.col("n"))).first()[0]
    return min(0.0, value) if value is not None else 0.0


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, reject_words: list[str] = REJECT_WORDS) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` of every URL.

    ``verdict`` is the rule's where one fits, else ``block`` if the score is
    below the threshold. Rules and reject words look at host and path, the models at the
    whole URL. Null URLs and those without ``://`` have an empty host and path and no
    rule; a null URL scores 0. A row per input row (repeats and null ids
    included); other columns are ignored; an empty table gives an empty result.
    Without rejected URLs to learn from, none is blocked by its score.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("text"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", name.alias("rule"), says.alias("says"), "text")
    bad = functools.reduce(lambda acc, w: acc | F.contains(F.col("host"), F.lit(w)), reject_words, F.lit(False))
    accepted = ~(bad | F.coalesce(F.col("says") == "block", F.lit(False)))
    # dealt out to as many tasks as the shuffle has, however small the table is: the work is in the characters
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.groupBy("text").agg(F.any_value("host").alias("host"), F.any_value("says").alias("says")).repartition(spread, "text")
    teaches = F.crc32(F.col("text").cast("binary")) % HELD_OUT != 0
    texts = store(texts.select("text", accepted.alias("accepted"), teaches.alias("teaches")), "urls")
    learned = texts.where("teaches")
    ratios = store(dense(train(learned.select("text", "accepted"))), "url-model")
    scored = store(score_texts(texts, ratios), "url-scores")
    limit = threshold(scored.where("accepted AND NOT teaches")) if learned.where("NOT accepted").limit(1).count() else float("-inf")
    judged = rows.join(scored.select("text", "score"), "text")
    verdict = F.coalesce("says", F.when(F.col("score") < limit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
