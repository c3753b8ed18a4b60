"""Named queries: ``name -> f(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timezone
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.catalog.forests import ACCOUNT_FOREST, TEXT_FOREST
from accountlens.catalog.tables import events, labelled_texts, legacy_time, posts, table
from accountlens.functions import scalars
from accountlens.operators import entropy, evaluation, gaps, patterns, profiles
from accountlens.operators import posts as post_ops
from accountlens.plans import features, forest, judge, spam
from accountlens.plans.nodes import node_importances, node_table, read_nodes, score_by_nodes
from accountlens.schema import (
    ACCOUNT,
    BOT,
    CLIENTS,
    CYBORG,
    FEATURE_COLUMNS,
    HOURS,
    HUMAN,
    WEEKDAYS,
)
from accountlens.session import checkpointed, scratch_paths, stored
from accountlens.sources.posts import posts_from_lines, read_posts, read_texts
from accountlens.sources.tables import (
    compact,
    expire,
    read_rows,
    read_training_set,
    store_run,
    unexpired,
    write_training_set,
)
from accountlens.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PRECISION = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.selectExpr(
        *[f"round(double({c}), {PRECISION}) AS {c}" if c in names else c for c in df.columns]
    )


def joined(values: str, by: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), by)


# --- sources ------------------------------------------------------------------------------


@query
def json_extract(spark, sf_dir):
    """Posts written as JSON lines, two to a string, and parsed back."""
    line = F.to_json(F.struct("id", "created_at", "text", "source", "in_reply_to_status_id", "entities", "user"))
    lines = posts(spark, sf_dir).select(F.concat(line, F.lit("\n\n"), F.to_json(F.struct("id"))).alias("value"))
    return posts_from_lines(lines).select(
        "id",
        F.col("user.id").alias(ACCOUNT),
        F.col("user.followers_count").alias("k"),
        F.length("text").cast("long").alias("n_chars"),
        scalars.size_or_zero("entities.hashtags").cast("long").alias("n_hashtags"),
    )


@query
def timeline_scan(spark, sf_dir):
    """Posts written as JSON-lines files and read back through a glob."""
    with scratch_paths(spark, "timelines") as [path]:
        posts(spark, sf_dir).write.json(path)
        return checkpointed(
            read_posts(spark, f"{path}/*").select(
                "id",
                F.col("user.id").alias(ACCOUNT),
                F.col("user.screen_name").alias("nombre_usuario"),
                "source",
                F.col("in_reply_to_status_id").alias("reply_to"),
                F.length("text").cast("long").alias("n_chars"),
                scalars.size_or_zero("entities.user_mentions").cast("long").alias("n_mentions"),
            )
        )


@query
def labelled_text_scan(spark, sf_dir):
    """Two sets of JSON lines read for their text alone, and marked with their class."""
    texts = labelled_texts(spark, sf_dir)
    with scratch_paths(spark, "texts-1", "texts-0") as paths:
        classes = {}
        for label, path in zip((1, 0), paths):
            texts.where(F.col("toxic") == label).select("id", "text", "source", "n_chars").write.json(path)
            classes[float(label)] = read_texts(spark, path)
        return checkpointed(
            evaluation.label_union(classes, "label").select(
                "id", F.length("text").cast("long").alias("n_chars"), "label"
            )
        )


@query
def table_roundtrip(spark, sf_dir):
    """A feature table stored as a run and as a JSON training set, then read back."""
    rows = rounded(post_ops.weekday_profile(events(spark, sf_dir)), WEEKDAYS)
    stamped = rows.withColumn("createdAt", F.lit("2024-02-01 12:00:00").cast("timestamp"))
    with scratch_paths(spark, "runs", "training-set") as [sink, training]:
        store_run(stamped, sink, "1")
        stored_rows = read_rows(spark, sink).select(ACCOUNT, *WEEKDAYS)
        write_training_set(stored_rows, training)
        return checkpointed(read_training_set(spark, training, stored_rows.schema))


def _stamped_events(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "k", F.col("ts").cast("timestamp").alias("createdAt"))


@query
def appended_runs(spark, sf_dir):
    """Three runs of events over all days, merged by day, one of them repeated with fewer rows, merged again."""
    rows = _stamped_events(spark, sf_dir)
    with scratch_paths(spark, "runs") as [path]:
        for run in range(3):
            store_run(rows.where(F.col("k") % 3 == run), path, str(run))
        compact(spark, path)
        store_run(rows.where((F.col("k") % 3 == 1) & (F.col("k") > 50)), path, "1", overwrite=True)
        compact(spark, path, before=date(2024, 1, 20))
        found = read_rows(spark, path, schema=rows.schema)
        return checkpointed(
            found.select("event_id", F.col("run").cast("string").alias("run"), F.col("created_date").cast("string").alias("day"))
        )


@query
def expired_rows(spark, sf_dir):
    """What is left of two runs of events after expiry to the row."""
    rows = _stamped_events(spark, sf_dir)
    with scratch_paths(spark, "runs") as [path]:
        for run in range(2):
            store_run(rows.where(F.col("k") % 2 == run), path, str(run))
        expire(spark, path, 10 * scalars.SECONDS_PER_DAY, datetime(2024, 1, 25, 13, 30, tzinfo=timezone.utc))
        return checkpointed(read_rows(spark, path, schema=rows.schema).select("event_id", "run"))


@query
def retention_filter(spark, sf_dir):
    stamped = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("createdAt"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return unexpired(stamped, 3 * scalars.SECONDS_PER_DAY, as_of).select("event_id")


# --- scalar functions ---------------------------------------------------------------------


@query
def parse_created_at(spark, sf_dir):
    text = legacy_time(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.epoch_seconds(scalars.parse_created_at(text)).alias("sec")
    )


@query
def calendar_parts(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        scalars.year_of("sec").cast("long").alias("ano"),
        scalars.month_of("sec").cast("long").alias("mes"),
        scalars.weekday_name("sec").alias("dia"),
        scalars.hour_of("sec").cast("long").alias("hora"),
    )


@query
def truthy_flags(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "event_id",
        scalars.truthy_number(F.when(kind != "error", F.col("k"))).cast("long").alias("number_flag"),
        scalars.truthy_text(F.when(kind == "view", F.lit("")).when(kind != "error", kind))
        .cast("long")
        .alias("text_flag"),
        scalars.truthy_bool(F.when(kind != "click", F.col("value") > 50)).cast("long").alias("bool_flag"),
    )


@query
def guarded_ratios(spark, sf_dir):
    per_day = (
        events(spark, sf_dir)
        .groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
        .agg(
            F.count_if(F.col("event_type") == "click").alias("clicks"),
            F.count_if(F.col("event_type") == "view").alias("views"),
        )
    )
    out = per_day.withColumns(
        {
            "reputacion": scalars.reputation("clicks", "views"),
            "followers_ratio": scalars.followers_ratio("clicks", "views"),
        }
    )
    return rounded(out, ["reputacion", "followers_ratio"])


@query
def nonempty_text(spark, sf_dir):
    return (
        post_ops.nonempty(table(spark, sf_dir, "documents"))
        .groupBy("lang")
        .agg(F.count("text").alias("n_docs"))
    )


@query
def fill_zero(spark, sf_dir):
    """Every user with that day's purchases: none is 0."""
    all_events = events(spark, sf_dir)
    day = all_events.where(
        (F.to_date("ts") == F.lit("2024-01-15").cast("date")) & (F.col("event_type") == "purchase")
    )
    users = all_events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    bought = day.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_bought"), F.round(F.sum("value"), 2).alias("spent")
    )
    return evaluation.fill_zero(users.join(bought, "user_id", "left"))


# --- gaps and profiles --------------------------------------------------------------------


@query
def post_gaps(spark, sf_dir):
    out = gaps.post_gaps(events(spark, sf_dir), order=("ts", "id"))
    return out.select(ACCOUNT, F.col("id").alias("event_id"), "gap")


def _gaps(spark, sf_dir) -> DataFrame:
    return gaps.first_gaps(events(spark, sf_dir))


@query
def gap_list(spark, sf_dir):
    series = _gaps(spark, sf_dir).select(ACCOUNT, gaps.gap_series().alias("series"))
    return series.select(ACCOUNT, F.size("series").cast("long").alias("n"), joined("series").alias("series"))


@query
def min_history(spark, sf_dir):
    """Events of (user, type, half of k) groups with more than three gaps."""
    account = F.concat_ws(
        ":", F.col("user_id").cast("string"), "event_type", F.floor(F.col("k") / 50).cast("string")
    )
    rows = events(spark, sf_dir).select(account.alias("account"), "id", "sec")
    return gaps.with_min_history(rows, "account").select("account", F.col("id").alias("event_id"))


@query
def account_post_count(spark, sf_dir):
    return post_ops.account_post_count(events(spark, sf_dir), text="event_type")


@query
def weekday_profile(spark, sf_dir):
    return rounded(post_ops.weekday_profile(events(spark, sf_dir)), WEEKDAYS)


@query
def hour_profile(spark, sf_dir):
    return rounded(post_ops.hour_profile(events(spark, sf_dir)), HOURS)


@query
def client_profile(spark, sf_dir):
    rules = {"uso_web": ("click", "err"), "uso_mobil": ("view", "sign", "error")}
    return rounded(post_ops.client_profile(events(spark, sf_dir), source="event_type", rules=rules), CLIENTS)


# --- text and entities --------------------------------------------------------------------


@query
def entity_ratios(spark, sf_dir):
    """Links, list items and paragraphs per page, by language."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all("html", F.lit(pattern), F.lit(0))

    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        found('href="').alias("links"),
        found("<li>").alias("items"),
        found("<p>").alias("paragraphs"),
    )
    out = post_ops.entity_ratios(pages, "lang", urls="links", hashtags="items", mentions="paragraphs")
    return rounded(out, ["url_ratio", "avg_hashtags", "mention_ratio"])


@query
def text_features(spark, sf_dir):
    return rounded(
        post_ops.text_features(table(spark, sf_dir, "documents"), "source"), list(post_ops.text_measures())
    )


@query
def reply_ratio(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(F.col("role") == "assistant", F.col("turn")).alias("reply_to")
    )
    return rounded(post_ops.reply_ratio(turns, "conv_id", "reply_to"), ["reply_ratio"])


@query
def tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spam.tokenize(docs).select("doc_id", F.size("words").cast("long").alias("n_tokens"))


@query
def hashing_tf(spark, sf_dir):
    """Hashed word counts of every document, in long form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spam.bucket_counts(docs).select("doc_id", F.col("bucket").cast("long").alias("bucket"), "n")


@query
def word_buckets(spark, sf_dir):
    """The hash bucket of every distinct word of the documents."""
    found = spam.word_buckets(table(spark, sf_dir, "documents"))
    return found.select("word", F.col("bucket").cast("long").alias("bucket"))


@query
def hashing_tf_totals(spark, sf_dir):
    """Hashing moves counts between buckets but keeps their sum: the token count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = spam.hashed_counts(docs).select("doc_id", vector_to_array("rawFeatures").alias("tf"))
    total = F.aggregate("tf", F.lit(0.0), lambda acc, v: acc + v)
    return counts.select("doc_id", total.cast("long").alias("n_tokens"))


# --- accounts -----------------------------------------------------------------------------


@query
def latest_profile(spark, sf_dir):
    return profiles.latest_profile(posts(spark, sf_dir))


@query
def profile_features(spark, sf_dir):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = profiles.profile_features(posts(spark, sf_dir), HUMAN, as_of)
    shown = out.withColumn("cuenta_creada", F.col("cuenta_creada").cast("string")).drop("createdAt")
    return rounded(shown, ["reputacion", "followers_ratio"])


@query
def post_features(spark, sf_dir):
    return rounded(features.post_features(posts(spark, sf_dir)), features.RATIOS)


@query
def account_features(spark, sf_dir):
    """All 55 features of every account with enough history."""
    out = features.account_features(posts(spark, sf_dir)).drop("createdAt")
    shown = out.withColumn("cuenta_creada", F.col("cuenta_creada").cast("string"))
    return rounded(shown, FEATURE_COLUMNS)


@query
def account_features_labelled(spark, sf_dir):
    """Features of accounts that occur in two classes: odd and even events, by user."""
    both = _two_classes(spark, sf_dir)
    out = features.account_features(both, labelled=True)
    columns = [*WEEKDAYS, *CLIENTS, "entropia", "n_tweets", "avg_long_tweets"]
    return rounded(out.select(ACCOUNT, "categoria", "nroTweets", *columns), columns)


@query
def account_features_two_classes(spark, sf_dir):
    """All 55 features of accounts in two classes: one row per class, the posts of both."""
    out = features.account_features(_two_classes(spark, sf_dir), labelled=True).drop("createdAt")
    shown = out.withColumn("cuenta_creada", F.col("cuenta_creada").cast("string"))
    return rounded(shown, FEATURE_COLUMNS)


@query
def overlapping_accounts(spark, sf_dir):
    both = features.overlapping_accounts(_two_classes(spark, sf_dir))
    return both.select(ACCOUNT, joined("labels").alias("labels"))


def _two_classes(spark, sf_dir) -> DataFrame:
    everything = posts(spark, sf_dir)
    odd = F.col("id") % 2 == 1
    return evaluation.label_union(
        {HUMAN: everything.where(odd), BOT: everything.where(~odd)}
    )


# --- gap-series entropy -------------------------------------------------------------------


def _symbols(spark, sf_dir) -> DataFrame:
    return entropy.gap_symbols(_gaps(spark, sf_dir).withColumn("gaps", gaps.gap_series()))


@query
def gap_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).select(ACCOUNT, joined("symbols").alias("symbols"))


def _symbol_rows(spark, sf_dir) -> DataFrame:
    return checkpointed(patterns.symbol_rows(_symbols(spark, sf_dir)))


@query
def pattern_counts(spark, sf_dir):
    """Every pattern of every length; its symbols are shown for the comparison only."""
    arrays = checkpointed(_symbols(spark, sf_dir))
    counts = patterns.pattern_counts(patterns.symbol_rows(arrays))
    # a series as one text, and where each symbol begins in it: a pattern is a part of that text
    begins = F.expr("aggregate(symbols, array(1), (at, s) -> array_append(at, element_at(at, -1) + length(string(s)) + 1))")
    texts = arrays.select(ACCOUNT, joined("symbols", "-").alias("whole"), begins.alias("begins"))
    shown = F.expr("substring(whole, begins[int(pos) - 1], begins[int(pos) + l - 1] - begins[int(pos) - 1] - 1)")
    return counts.join(texts, ACCOUNT).select(
        ACCOUNT, F.col("l").cast("long").alias("l"), shown.alias("pattern"), "occurrences"
    )


def _entropies(spark, sf_dir) -> DataFrame:
    return patterns.shannon_entropy(_symbol_rows(spark, sf_dir))


@query
def shannon_entropy(spark, sf_dir):
    return rounded(_entropies(spark, sf_dir).withColumn("l", F.col("l").cast("long")), ["h"])


@query
def conditional_entropy(spark, sf_dir):
    out = patterns.conditional_entropy(checkpointed(_entropies(spark, sf_dir)))
    return rounded(out.withColumn("l", F.col("l").cast("long")), ["ce"])


@query
def corrected_entropy(spark, sf_dir):
    return rounded(entropy.corrected_entropy(_gaps(spark, sf_dir)), ["entropia"])


def _kind_gaps(spark, sf_dir) -> DataFrame:
    """Gaps between events of one type: five series, as long as the table allows."""
    return gaps.gap_rows(events(spark, sf_dir), key="event_type")


@query
def whole_series_entropy(spark, sf_dir):
    """Entropy of whole timelines of thousands of gaps, in long form."""
    return rounded(entropy.series_entropy(_kind_gaps(spark, sf_dir), ["event_type"]), ["entropia"])


@query
def whole_series_repeats(spark, sf_dir):
    """Number of repeated patterns and of their occurrences for each length of the whole timelines."""
    symbols = checkpointed(patterns.quantised(_kind_gaps(spark, sf_dir), ["event_type"]))
    found = patterns.repeated_windows(symbols, ["event_type"]).groupBy("event_type", F.col("l").cast("long").alias("l"))
    return found.agg(
        F.count_if(F.col("pos") == F.col("first")).alias("n_patterns"), F.count(F.lit(1)).alias("n_windows")
    )


# --- labels, splits, quality --------------------------------------------------------------


@query
def label_union(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    return evaluation.label_union(
        {
            HUMAN: labels.where(~toxic & (F.col("quality") == 1)).select("doc_id", "quality"),
            BOT: labels.where(toxic).select("quality", "doc_id"),
            CYBORG: labels.where(~toxic & (F.col("quality") == 0)).select("doc_id", "quality"),
        }
    )


@query
def split_train_test(spark, sf_dir):
    test, train = evaluation.split_train_test(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return test.withColumn("side", F.lit("test")).unionByName(train.withColumn("side", F.lit("train")))


def _rule_scored(spark, sf_dir) -> DataFrame:
    prediction = F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)
    return labelled_texts(spark, sf_dir).withColumn("predicted_label", prediction)


@query
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_rule_scored(spark, sf_dir), "quality", "predicted_label")


@query
def accuracy(spark, sf_dir):
    return rounded(evaluation.accuracy(_rule_scored(spark, sf_dir), "quality", "predicted_label"), ["accuracy"])


@query
def prediction_rate(spark, sf_dir):
    return rounded(post_ops.prediction_rate(_rule_scored(spark, sf_dir), "source"), ["avg_spam"])


# --- models -------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _spam_training(spark: SparkSession, sf_dir: str) -> spam.SpamTraining:
    texts = labelled_texts(spark, sf_dir)
    toxic = F.col("toxic") == 1
    return spam.train_spam(texts.where(toxic), texts.where(~toxic))


def _measured(spark: SparkSession, sf_dir: str):
    """The measures of all posts, made in one pass over the texts, for as long as the context lasts."""
    return stored(features.post_measures(posts(spark, sf_dir), _spam_training(spark, sf_dir).model), "measured-posts")


#: Account classifiers of the last sessions and folders.
_JUDGES: dict[tuple[SparkSession, str], judge.JudgeTraining] = {}


def _judge_training(spark: SparkSession, sf_dir: str, measured: DataFrame | None = None) -> judge.JudgeTraining:
    """The account classifier; ``measured`` posts, if they are at hand, are trained on as they are."""
    key = (spark, sf_dir)
    if key not in _JUDGES:
        if measured is None:
            with _measured(spark, sf_dir) as own:
                return _judge_training(spark, sf_dir, own)
        by_class = [measured.where(F.col(ACCOUNT) % 3 == c) for c in (0, 1, 2)]
        trained = judge.train_judge(*by_class, spam_model=_spam_training(spark, sf_dir).model)
        while len(_JUDGES) >= 8:
            del _JUDGES[next(iter(_JUDGES))]
        _JUDGES[key] = trained
    return _JUDGES[key]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts, scored by a classifier trained on them: one pass over the texts serves both."""
    with _measured(spark, sf_dir) as measured:
        classifier = _judge_training(spark, sf_dir, measured).model
        return checkpointed(judge.score_posts(measured, classifier, _spam_training(spark, sf_dir).model))


def _models(spark, sf_dir):
    return _spam_training(spark, sf_dir).model, _judge_training(spark, sf_dir).model


@query
def spam_model(spark, sf_dir):
    docs = labelled_texts(spark, sf_dir)
    return _spam_training(spark, sf_dir).model.transform(docs).select("id", "toxic", "predicted_label")


@query
def spam_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spam.spam_rate(docs, _spam_training(spark, sf_dir).model, "source")


@query
def cross_validate(spark, sf_dir):
    """Five folds for each bin count: mean accuracy per candidate."""
    result = _spam_training(spark, sf_dir)
    return spark.createDataFrame(
        [(float(b), a) for b, a in zip((50, 100), result.cv_accuracy, strict=True)],
        "max_bins double, accuracy double",
    )


@query
def judge_model(spark, sf_dir):
    """Confusion matrix of the trained account classifier on its held-out accounts."""
    matrix = _judge_training(spark, sf_dir).matrix
    return spark.createDataFrame(
        [(float(i), *row) for i, row in enumerate(matrix)],
        "categoria double, pred_0 long, pred_1 long, pred_2 long",
    )


@query
def feature_importance(spark, sf_dir):
    return judge.feature_importance(_judge_training(spark, sf_dir).model)


@query
def score_accounts(spark, sf_dir):
    return _scored(spark, sf_dir).drop("createdAt")


@query
def forest_scores(spark, sf_dir):
    """Accounts scored by a forest that is a table of nodes."""
    features_ = features.account_features(posts(spark, sf_dir))
    nodes = read_nodes(node_table(spark, ACCOUNT_FOREST))
    scored = score_by_nodes(features_, nodes, lambda i: F.col(FEATURE_COLUMNS[i]), "probabilidades", judge.PREDICTION)
    shown = [F.round(F.col("probabilidades")[i], PRECISION).alias(f"p_{i}") for i in range(3)]
    return scored.select(ACCOUNT, *shown, judge.PREDICTION)


@query
def forest_spam_rate(spark, sf_dir):
    """Share of each source's documents that a table of nodes over hashed words calls spam."""
    counts = spam.hashed_counts(table(spark, sf_dir, "documents").where("text is not null").select("source", "text"))
    rows = counts.select("source", vector_to_array("rawFeatures").alias("tf"))
    scored = score_by_nodes(rows, TEXT_FOREST, lambda i: F.col("tf")[i], "p", spam.PREDICTION)
    return rounded(post_ops.prediction_rate(scored, "source", spam.PREDICTION), ["avg_spam"])


@query
def node_importance(spark, sf_dir):
    """Each feature's importance in a table of nodes, beside its mean over the accounts."""
    weights = node_importances(node_table(spark, ACCOUNT_FOREST), FEATURE_COLUMNS)
    values = features.account_features(posts(spark, sf_dir)).select(*FEATURE_COLUMNS)
    means = values.select(*[F.avg(c).alias(c) for c in FEATURE_COLUMNS])
    stacked = ", ".join(f"'{c}', `{c}`" for c in FEATURE_COLUMNS)
    means = means.selectExpr(f"stack({len(FEATURE_COLUMNS)}, {stacked}) AS (feature, mean)")
    found = weights.join(means, "feature").withColumn("mean", F.round("mean", 3))
    return rounded(found, ["importance"])


@query
def out_of_fold(spark, sf_dir):
    """Mean accuracy of each candidate, from predictions by models that hadn't seen the row."""
    texts = labelled_texts(spark, sf_dir)
    rows = spam.hashed_counts(texts).select("id", F.col("toxic").cast("double").alias("label"), "rawFeatures")
    with stored(rows, "folds") as training:
        cv = forest.cross_validated_forest(
            training, "label", spam.PREDICTION, "rawFeatures", spam.SPAM_SEED, ["id"], keep_folds=True
        )
        predicted = forest.out_of_fold(cv, training, spam.SPAM_SEED, ["id"])
        return checkpointed(predicted.select("id", "label", "fold", "max_bins", spam.PREDICTION))


@query
def verdicts(spark, sf_dir):
    """Every account gets three probabilities that sum to one."""
    out = judge.verdicts(_scored(spark, sf_dir))
    total = F.aggregate("probabilidades", F.lit(0.0), lambda acc, p: acc + p)
    return out.select(
        ACCOUNT, F.size("probabilidades").cast("long").alias("n_classes"), F.round(total, PRECISION).alias("total")
    )


@query
def model_roundtrip(spark, sf_dir):
    """A saved and reloaded detector predicts what the original does."""
    model = _spam_training(spark, sf_dir).model
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = model.transform(docs).select("doc_id", F.col("predicted_label").alias("before"))
    with scratch_paths(spark, "spam-model") as [path]:
        judge.save_model(model, path)
        loaded = judge.load_model(path)
    after = loaded.transform(docs).select("doc_id", F.col("predicted_label").alias("after"))
    return before.join(after, "doc_id").select("doc_id", (F.col("before") == F.col("after")).alias("agrees"))


@query
def score_stream(spark, sf_dir):
    """Timelines in two deliveries, each with a part of every account, against one batch run.

    The last score of an account must be that of its whole timeline.
    """
    spam_detector, classifier = _models(spark, sf_dir)
    everything = posts(spark, sf_dir)
    with scratch_paths(spark, "timelines", "scores", "stream", "batch") as [source, sink, checkpoint, stage]:
        for delivery in (0, 1):
            arrived = everything.where(F.pmod(F.xxhash64("id"), F.lit(2)) == delivery)
            arrived.write.mode("append").json(source)
            scoring.score_stream(
                spark, source, sink, checkpoint, classifier, spam_detector
            ).awaitTermination()
        streamed = scoring.latest_scores(spark, sink).select(ACCOUNT, F.col("probabilidades").alias("streamed"))
        batch = judge.verdicts(
            judge.score_posts(read_posts(spark, source), classifier, spam_detector, stage_path=stage)
        )
        difference = F.aggregate(
            F.zip_with("streamed", "probabilidades", lambda a, b: F.abs(a - b)),
            F.lit(0.0),
            lambda acc, d: acc + d,
        )
        return checkpointed(
            batch.join(streamed, ACCOUNT, "left").select(
                ACCOUNT, F.coalesce(difference < 1e-9, F.lit(False)).alias("agrees")
            )
        )
