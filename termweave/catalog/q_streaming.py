"""Queries that run the streaming jobs to the end of the given data and read back their tables."""

from pyspark.sql import functions as F

from termweave.catalog import q_coding as QC
from termweave.catalog import views as V
from termweave.catalog.q_sources import written
from termweave.catalog.registry import query
from termweave.catalog.sqlviews import with_ctes
from termweave.operators import review as RV
from termweave.session import scratch_path
from termweave.streaming import jobs as J

ACTIONS = {
    "signup": "encounter.received", "view": "item.scored", "click": "item.approve",
    "error": "item.scoring_failed", "purchase": "encounter.approved",
}


@query("stream_intake", with_ctes(extra=QC._TURN) + "SELECT DISTINCT 'enc-' || conv_id || '-' || turn AS encounter_id FROM ok")
def stream_intake(spark, sf):
    """All conversation turns arrive as encounter documents; repeated ids are taken once."""

    def write(path):
        arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id"))
        QC.encounter_lines(spark, sf).select("value", arrived.alias("received_at")).write.parquet(path)

    source = written(spark, sf, "encounter-stream", write)
    out, state = scratch_path(spark, "intake"), scratch_path(spark, "intake-state")
    lines = spark.readStream.schema("value string, received_at timestamp").parquet(source)
    J.stream_intake(lines, out, state).awaitTermination()
    return spark.read.parquet(f"{out}/accepted").select("encounter_id")


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"


@query(
    "stream_audit_counts",
    f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, {_CASE} AS action, count(*) AS events FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
)
def stream_audit_counts(spark, sf):
    """Hourly counts per action; windows the watermark (one day) has passed are final."""
    static = V.table(spark, sf, "events")
    events = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    named = events.select(F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))
    out, state = scratch_path(spark, "audit-counts"), scratch_path(spark, "audit-state")
    J.stream_audit_counts(named, "1 day", "1 hour", out, state).awaitTermination()
    counts = spark.read.schema("window_start timestamp, action string, events long").parquet(out)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "action", "events")


@query(
    "stream_review_state",
    QC._replay_sql() + """SELECT r.encounter_id, coalesce(any_value(closed_at), -1) AS closed_at, count(*) FILTER (WHERE reason IS NULL) AS accepted,
    count(*) FILTER (WHERE reason IS NOT NULL) AS refused FROM replay r GROUP BY 1""",
)
def stream_review_state(spark, sf):
    """The review history as a stream in two deliveries, dealt without regard to order; must end as the batch replay does."""

    def write(path):
        items = QC.item_states(spark, sf)
        billable = V.concepts(spark, sf).where("is_billable").select("code", F.lit(True).alias("is_billable"))
        needed = items.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("needed"))
        events = (
            RV.with_dotted_overrides(QC.review_events(spark, sf)).join(billable, "code", "left").join(needed, "encounter_id")
            .withColumn("is_billable", F.coalesce("is_billable", F.lit(False))).withColumn("coded", F.lit(True))
            .withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
            .select("encounter_id", "at", "item_id", F.col("seq").cast("bigint").alias("seq"), "kind", "code", "is_billable", "coded", "needed")
        )
        events = V.materialise(events, "dealt-reviews")  # read three times below
        halves = events.withColumn("half", F.pmod(F.xxhash64("encounter_id", "seq"), F.lit(2)))
        halves.where("half = 0").drop("half").write.parquet(f"{path}/first")
        # A clock row far ahead ends the stream: the watermark passes the last event.
        clock = events.agg(F.max("at").alias("last")).select(
            F.lit("").alias("encounter_id"), (F.col("last") + F.expr("INTERVAL 90 DAYS")).alias("at"), F.lit(None).cast("bigint").alias("item_id"),
            F.lit(-1).cast("bigint").alias("seq"), F.lit(J.CLOCK).alias("kind"), F.lit(None).cast("string").alias("code"),
            F.lit(False).alias("is_billable"), F.lit(False).alias("coded"), F.lit(0).cast("bigint").alias("needed"),
        )
        halves.where("half = 1").drop("half").unionByName(clock).write.parquet(f"{path}/second")

    source = written(spark, sf, "review-stream", write)
    schema = spark.read.parquet(f"{source}/first").schema
    out, state = scratch_path(spark, "review-state"), scratch_path(spark, "review-checkpoint")
    for delivery in ("first", "second"):
        # The second run resumes from the checkpoint: the glob now reaches the later files too.
        names = "first" if delivery == "first" else "{first,second}"
        events = spark.readStream.schema(schema).parquet(f"{source}/{names}")
        J.stream_review_state(events, out, state, "30 days").awaitTermination()
    final = J.latest_states(spark.read.parquet(out))
    return final.select("encounter_id", "closed_at", "accepted", "refused")
