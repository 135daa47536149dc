"""Labels: scans, changes, summaries and the dimension of label groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traces import BUCKET, EVENT, KEYS, drawn, neighbours

# The buckets of normal traces, how they are grouped in reports, and the buckets of events.
BUCKETS = [str(i) for i in range(10)]
GROUPS = ["0", "1", "2", "3", "4+"]
EVENT_BUCKETS = ["0", "1", "2", "3", "4", "5", "6+"]


def label_scan(labels: DataFrame, run: int | None = None, label: str | None = None) -> DataFrame:
    """Labels in order of their keys."""
    rows = labels if run is None else labels.where(F.col("run") == run)
    rows = rows if label is None else rows.where(F.col("label") == label)
    return rows.orderBy(*[k for k in KEYS if k in labels.columns])


def label_key(family: Column, label: Column) -> Column:
    return F.concat_ws(":", family, label)


def group_key(family: Column, label: Column) -> Column:
    """The key of a label's group: normal buckets of 4 and more are one."""
    return F.when((family == "normal") & label.isin(BUCKETS[4:]), "normal:4+").otherwise(label_key(family, label))


def sanitize_label_key(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def label_title(family: Column, label: Column) -> Column:
    bucket = F.when(label == "9", "9+").otherwise(label)
    return F.when(family == "normal", F.concat(bucket, F.when(label.isin("0", "1"), " peak").otherwise(" peaks"))).otherwise(label)


def suggest_event_label(lines: Column) -> Column:
    return F.when(lines <= 0, "0").when(lines >= 6, "6+").otherwise(lines.cast("string"))


def label_dimension(strange: DataFrame) -> DataFrame:
    """(pos, series_key, title): the groups of normal labels, then the strange names in order without case."""
    spark = strange.sparkSession
    rows = ", ".join(f"({i}, 'normal:{g}', '{g} peak{'' if g in '01' else 's'}')" for i, g in enumerate(GROUPS))
    fixed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pos, series_key, title)")
    # the user's names are few: the order is one small window
    names = strange.select((F.row_number().over(Window.orderBy(F.lower("name"), "name")) + len(GROUPS) - 1).alias("pos"), F.concat(F.lit("strange:"), "name").alias("series_key"), F.col("name").alias("title"))
    return fixed.unionByName(names)


def join_labeled(traces: DataFrame, labels: DataFrame, strange: DataFrame) -> DataFrame:
    """Labelled traces of a known group, with series_key; labels of other groups are dropped."""
    keyed = labels.select(*KEYS, group_key(F.col("family"), F.col("label")).alias("series_key")).join(label_dimension(strange).select("series_key"), "series_key", "left_semi")
    return traces.join(keyed, KEYS)


def label_counts(labels: DataFrame, strange: DataFrame) -> DataFrame:
    """(run, series_key, traces): labels of each group, whether their traces exist or not; every group of each run, with 0."""
    keyed = labels.select("run", group_key(F.col("family"), F.col("label")).alias("series_key"))
    every = labels.select("run").distinct().withColumn("series_key", F.explode(F.array(*[F.lit(f"normal:{g}") for g in GROUPS]))).unionByName(_per_run(labels, strange))
    return every.join(keyed.groupBy("run", "series_key").agg(F.count("*").alias("traces")), ["run", "series_key"], "left").withColumn("traces", F.coalesce("traces", F.lit(0)))


def _per_run(labels: DataFrame, strange: DataFrame) -> DataFrame:
    # one row, which holds the names that a user gave to keys
    names = strange.agg(F.collect_list(F.concat(F.lit("strange:"), "name")).alias("names")).withColumn("one", F.lit(1))
    return labels.select("run").distinct().withColumn("one", F.lit(1)).join(F.broadcast(names), "one").select("run", F.explode("names").alias("series_key"))


def filter_review(labels: DataFrame, run: int, family: str, label: str | None = None) -> DataFrame:
    """Keys of one run's labels of a family and label, in order; of normal labels 4+ means 4 to 9, None any."""
    rows = labels.where((F.col("run") == run) & (F.col("family") == family))
    if label == "4+" and family == "normal":
        rows = rows.where(F.col("label").isin(BUCKETS[4:]))
    elif label is not None:
        rows = rows.where(F.col("label") == label)
    return rows.select(*KEYS).orderBy(*KEYS)


def apply_changes(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A new version of a label table: of each key the latest row, created when its first one was.

    Of rows of one time a change goes before what was there, then the greatest label.
    """
    rows = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    values = [c for c in existing.columns if c not in (*keys, "created_at")]
    latest = F.max_by(F.struct(*values), F.struct("updated_at", "_new", "created_at", *[c for c in values if c != "updated_at"]))
    return rows.groupBy(*keys).agg(latest.alias("_l"), F.min("created_at").alias("created_at")).select(*keys, "_l.*", "created_at").select(*existing.columns)


def apply_event_changes(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """The same for events; a bucket outside 0 to 5 and 6+ is an error."""
    checked = changes.withColumn("label", F.when(F.col("label").isin(EVENT_BUCKETS), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no such event label: "), F.coalesce("label", F.lit("null"))))))
    return apply_changes(existing, checked, EVENT)


def add_strange_labels(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(pos, name, shortcut_key, reason) of a batch (pos, name, shortcut_key); reason is null where the label is added."""
    trimmed = batch.withColumn("name", F.trim("name")).withColumn("_lower", F.lower("name"))
    names = existing.select(F.lower("name").alias("_lower"), F.lit(True).alias("_has_name")).distinct()
    used = existing.select("shortcut_key", F.lit(True).alias("_has_key")).distinct()
    by_name, by_key = Window.partitionBy("_lower").orderBy("pos"), Window.partitionBy("shortcut_key").orderBy("pos")
    rows = trimmed.join(names, "_lower", "left").join(used, "shortcut_key", "left").withColumn("_n", F.row_number().over(by_name)).withColumn("_k", F.row_number().over(by_key))
    reason = F.when(F.col("name") == "", "empty name").when(F.col("_has_name") | (F.col("_n") > 1), "duplicate name").when(F.col("_has_key") | (F.col("_k") > 1), "duplicate key")
    return rows.select("pos", "name", "shortcut_key", reason.alias("reason"))


def remove_strange_labels(existing: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """(name, used, removed): a name goes only if no trace has it; an unknown name is not removed."""
    used = labels.where("family = 'strange'").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("used"))
    known = existing.select("name", F.lit(True).alias("known"))
    return names.join(used, "name", "left").join(known, "name", "left").select("name", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) == 0).__and__(F.coalesce("known", F.lit(False))).alias("removed"))


def _fixed(df: DataFrame, buckets: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, buckets))).alias("pos", "label"))


def normal_summary(labels: DataFrame) -> DataFrame:
    counts = labels.where("family = 'normal'").groupBy("label").agg(F.count("*").alias("traces"))
    return _fixed(labels, BUCKETS).join(counts, "label", "left").select("pos", "label", label_title(F.lit("normal"), F.col("label")).alias("title"), F.coalesce("traces", F.lit(0)).alias("traces"))


def strange_summary(labels: DataFrame, strange: DataFrame) -> DataFrame:
    counts = labels.where("family = 'strange'").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("traces"))
    return strange.join(counts, "name", "left").select("name", "shortcut_key", F.coalesce("traces", F.lit(0)).alias("traces")).orderBy(F.lower("name"))


def event_label_summary(event_labels: DataFrame) -> DataFrame:
    counts = event_labels.groupBy("label").agg(F.count("*").alias("events"))
    title = F.concat("label", F.when(F.col("label") == "1", " line").otherwise(" lines"))
    return _fixed(event_labels, EVENT_BUCKETS).join(counts, "label", "left").select("pos", "label", title.alias("title"), F.coalesce("events", F.lit(0)).alias("events"))


def label_breakdown(labels: DataFrame, strange: DataFrame) -> DataFrame:
    """(series_key, title, traces, percent of its family's labels, 0 if there are none)."""
    counts = labels.groupBy(group_key(F.col("family"), F.col("label")).alias("series_key")).agg(F.count("*").alias("traces"))
    rows = label_dimension(strange).join(counts, "series_key", "left").withColumn("traces", F.coalesce("traces", F.lit(0))).withColumn("family", F.substring_index("series_key", ":", 1))
    total = F.sum("traces").over(Window.partitionBy("family"))
    return rows.select("pos", "series_key", "title", "traces", F.coalesce(F.try_divide(100.0 * F.col("traces"), total), F.lit(0.0)).alias("percent"))


def unlabeled_events(events: DataFrame, event_labels: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Event ids from each run's first to its last without a label and not shown yet."""
    spans = events.groupBy("run").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    left = spans.select("run", F.explode(F.sequence("a", "b")).alias("event_id")).join(event_labels, EVENT, "left_anti")
    return left if shown is None else left.join(shown, EVENT, "left_anti")


def sample_unlabeled_events(events: DataFrame, event_labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return unlabeled_events(events, event_labels).orderBy(drawn(EVENT, seed), *EVENT).limit(n)


def closest_labeled_event(wanted: DataFrame, event_labels: DataFrame) -> DataFrame:
    """(run, event_id, labeled_event): the least labelled event at or after the wanted one, else the last; null if the run has none.

    Both tables are ordered together within buckets of a run's event ids, so the as-of match is one window and no
    range join. Where a bucket has no later label, the next one does; only one row for each bucket is sorted by run.
    """
    marks = event_labels.select("run", "event_id", F.col("event_id").alias("_labeled"), F.lit(False).alias("_wanted"))
    rows = wanted.select("run", "event_id", F.lit(None).cast("long").alias("_labeled"), F.lit(True).alias("_wanted")).unionByName(marks)
    rows = rows.withColumn("_bucket", F.floor(F.col("event_id") / BUCKET))
    after = Window.partitionBy("run", "_bucket").orderBy("event_id").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later, whole = Window.partitionBy("run").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("run")
    edges = rows.groupBy("run", "_bucket").agg(F.min("_labeled").alias("_first"), F.max("_labeled").alias("_top"))
    edges = edges.select("run", "_bucket", F.min("_first").over(later).alias("_later"), F.max("_top").over(whole).alias("_last"))
    found = rows.withColumn("_next", F.min("_labeled").over(after)).where("_wanted").join(edges, ["run", "_bucket"])
    return found.select("run", "event_id", F.coalesce("_next", "_later", "_last").alias("labeled_event"))


def labeled_event_neighbor(event_labels: DataFrame) -> DataFrame:
    found = neighbours(event_labels.select(*EVENT), "event_id")
    return found.select(*EVENT, *[F.coalesce(f"{n}.event_id", "event_id").alias(f"{n}_event") for n in ("next", "previous")])
