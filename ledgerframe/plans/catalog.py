"""Every query of the event-log engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerframe.functions import ids
from ledgerframe.operators import append, fold, scan, snapshots
from ledgerframe.operators.scan import Direction
from ledgerframe.sources.tables import conversation_log, table, user_log
from ledgerframe.streaming import projection, rebuild

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

USER = 7
ENVELOPE = ["global_position", "stream_type", "stream_uuid", "stream_id", "stream_version", "event_type", "timestamp", "amount", "k", "data_content_type"]

LOG = """ev AS (
  SELECT event_id + 1 AS global_position, 'user' AS stream_type, u AS stream_uuid, 'user_' || u AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS stream_version, event_type, ts AS "timestamp",
         CAST(value AS DECIMAL(18,2)) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'application/json' AS data_content_type, user_id
  FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
        FROM (SELECT *, md5(CAST(user_id AS VARCHAR)) AS h FROM events)))"""
ALL = ", ".join('CAST(amount AS DOUBLE) AS amount' if c == "amount" else f'"{c}"' for c in ENVELOPE)


def query(sql: str, *ctes: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)  # sums are decimals, exact; what comes out is a double in either engine
            return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def _envelope(df: DataFrame) -> DataFrame:
    return df.select(*ENVELOPE)


def _stream(spark: SparkSession, d: str, **options) -> DataFrame:
    """The filter on the user reaches the file scan, below the numbering of versions, which is by user."""
    return _envelope(scan.read_stream(user_log(spark, d), F.col("user_id") == USER, **options))


def delta() -> Column:
    return F.when(F.col("event_type") == "purchase", F.col("amount")).when(F.col("event_type") == "error", -F.col("amount")).otherwise(F.lit(0))


def reset() -> Column:
    return F.col("event_type") == "signup"


DELTA = "CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END"
#: Balance after each event: the sum since the last reset.
RUNNING = f"""seg AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY stream_version) AS part FROM ev),
run AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 0 ELSE {DELTA} END) OVER (PARTITION BY stream_id, part ORDER BY stream_version) AS DOUBLE) AS balance FROM seg)"""


# --- scans


@query(f"SELECT {ALL} FROM ev", LOG)
def log_canonical(spark, d):
    return _envelope(user_log(spark, d))


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER}", LOG)
def read_stream_forward(spark, d):
    return _stream(spark, d)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} AND stream_version > 10", LOG)
def read_stream_after(spark, d):
    return _stream(spark, d, after=10)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} ORDER BY stream_version LIMIT 5", LOG)
def read_stream_count(spark, d):
    return _stream(spark, d, count=5)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} AND stream_version > 10 ORDER BY stream_version LIMIT 5", LOG)
def read_stream_after_count(spark, d):
    return _stream(spark, d, after=10, count=5)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER}", LOG)
def read_stream_reverse(spark, d):
    return _stream(spark, d, direction=Direction.REVERSE)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} AND stream_version <= 12", LOG)
def read_stream_reverse_bound(spark, d):
    return _stream(spark, d, after=12, direction=Direction.REVERSE)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} AND stream_version <= 12 ORDER BY stream_version DESC LIMIT 4", LOG)
def read_stream_reverse_count(spark, d):
    return _stream(spark, d, after=12, count=4, direction=Direction.REVERSE)


@query(f"SELECT {ALL} FROM ev WHERE user_id = {USER} AND stream_version > 1000000", LOG)
def read_stream_past_tip(spark, d):
    return _stream(spark, d, after=1_000_000)


@query(f"SELECT {ALL} FROM ev", LOG)
def read_all(spark, d):
    return _envelope(scan.read_all(user_log(spark, d)))


@query(f"SELECT {ALL} FROM ev WHERE global_position > 500", LOG)
def read_all_after(spark, d):
    return _envelope(scan.read_all(user_log(spark, d), after=500))


@query(f"SELECT {ALL} FROM ev ORDER BY global_position LIMIT 25", LOG)
def read_all_count(spark, d):
    return _envelope(scan.read_all(user_log(spark, d), count=25))


@query(f"SELECT {ALL} FROM ev WHERE global_position > 500 ORDER BY global_position LIMIT 25", LOG)
def read_all_after_count(spark, d):
    return _envelope(scan.read_all(user_log(spark, d), after=500, count=25))


@query(f"SELECT {ALL} FROM ev WHERE global_position <= 800", LOG)
def read_all_frontier(spark, d):
    return _envelope(scan.read_all(user_log(spark, d), frontier=800))


HEADS = "heads AS (SELECT stream_id, min(stream_version) AS first_version, max(stream_version) AS tip, count(*) AS n_events FROM ev GROUP BY stream_id)"


@query("SELECT * FROM heads", LOG, HEADS)
def stream_heads(spark, d):
    return scan.heads(user_log(spark, d))


# --- appends and deletion


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """An order proposes an event for the stream of a user, which may not exist, under one of four conditions."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    return o.select(
        "o_orderkey", ids.typed_id(F.lit("user"), ids.uuid_of(F.col("o_custkey") % 200)).alias("stream_id"),
        F.when(k == 0, F.lit(None)).when(k == 1, F.lit(0)).when(k == 2, 50 + F.col("o_orderkey") % 40).cast("long").alias("expect_version"), (k == 3).alias("must_not_exist"),
    )


@query(
    """SELECT p.o_orderkey, p.stream_id, coalesce(h.tip, 0) AS actual_version, p.wanted IS NULL OR p.wanted = coalesce(h.tip, 0) AS accepted,
       CASE WHEN p.wanted <> coalesce(h.tip, 0) THEN p.wanted END AS expected FROM p LEFT JOIN heads h USING (stream_id)""",
    LOG,
    HEADS,
    """m AS (SELECT *, md5(CAST(o_custkey % 200 AS VARCHAR)) AS h FROM orders),
p AS (SELECT o_orderkey, 'user_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stream_id,
      CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 50 + o_orderkey % 40 ELSE 0 END AS BIGINT) AS wanted FROM m)""",
)
def append_expect_version(spark, d):
    judged = append.judge(_proposals(spark, d), scan.heads(user_log(spark, d)))
    return judged.select("o_orderkey", "stream_id", "actual_version", "accepted", "expected")


@query(
    """SELECT event_id, stream_id, coalesce(tip, 0) + row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS stream_version,
       (SELECT max(global_position) FROM ev WHERE global_position <= 600) + row_number() OVER (ORDER BY event_id) AS global_position
       FROM (SELECT global_position - 1 AS event_id, stream_id FROM ev WHERE global_position > 600) LEFT JOIN old USING (stream_id)""",
    LOG,
    "old AS (SELECT stream_id, max(stream_version) AS tip FROM ev WHERE global_position <= 600 GROUP BY stream_id)",
)
def append_assign(spark, d):
    """The log up to position 600 is there; all later events arrive as one batch."""
    log = user_log(spark, d)
    old, batch = log.where("global_position <= 600"), log.where("global_position > 600").select((F.col("global_position") - 1).alias("event_id"), "stream_id")
    return append.assign(batch, scan.heads(old), "event_id", 600).select("event_id", "stream_id", F.col("stream_version").cast("long").alias("stream_version"), F.col("global_position").cast("long").alias("global_position"))


def _tombstones(log: DataFrame, user: int, to: int | None, at: int) -> DataFrame:
    one = log.where(F.col("user_id") == user).select("stream_id").limit(1)
    return one.select("stream_id", F.lit(to).cast("long").alias("to_version"), F.lit(at).cast("long").alias("at_position"))


CUT = ["global_position", "stream_id", "stream_version", "event_type"]
CUTS = ", ".join(CUT)
FAR = 1 << 60


@query(f"SELECT {CUTS} FROM ev WHERE user_id = {USER} AND stream_version > 20", LOG)
def truncate_stream(spark, d):
    log = user_log(spark, d)
    return append.retained(log.where(F.col("user_id") == USER), _tombstones(log, USER, 20, FAR)).select(*CUT)


@query(f"SELECT stream_id, count(*) FILTER (stream_version > 1000000) AS n_retained, max(stream_version) + 1 AS next_version FROM ev WHERE user_id = {USER} GROUP BY stream_id", LOG)
def truncate_beyond_tip(spark, d):
    """Empties the stream; the counter goes on."""
    log = user_log(spark, d)
    own = log.where(F.col("user_id") == USER)
    left = append.retained(own, _tombstones(log, USER, 1_000_000, FAR)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return scan.heads(own).join(left, "stream_id", "left").select("stream_id", F.coalesce("n", F.lit(0)).alias("n_retained"), (F.col("tip") + 1).alias("next_version"))


@query(f"SELECT stream_id, tip FROM heads WHERE stream_id NOT IN (SELECT stream_id FROM ev WHERE user_id = {USER})", LOG, HEADS)
def delete_stream(spark, d):
    """A deleted stream has no head."""
    log = user_log(spark, d)
    return scan.heads(append.retained(log, _tombstones(log, USER, None, FAR))).select("stream_id", "tip")


@query(
    f"""SELECT global_position, stream_id, row_number() OVER (ORDER BY global_position) AS stream_version, event_type
        FROM ev WHERE user_id = {USER} AND global_position > 500""",
    LOG,
)
def delete_then_reappend(spark, d):
    """Deleted at position 500: later events of the stream are a new incarnation, from version 1."""
    log = user_log(spark, d)
    left = append.retained(log.where(F.col("user_id") == USER), _tombstones(log, USER, None, 500))
    again = F.row_number().over(Window.partitionBy("stream_id").orderBy("global_position")).cast("long")
    return left.select("global_position", "stream_id", again.alias("stream_version"), "event_type")


@query(f"SELECT {CUTS} FROM ev WHERE NOT (user_id = {USER} AND stream_version <= 20) AND user_id <> {USER + 1}", LOG)
def global_after_delete(spark, d):
    log = user_log(spark, d)
    return append.retained(log, _tombstones(log, USER, 20, FAR).union(_tombstones(log, USER + 1, None, FAR))).select(*CUT)


# --- folds


LAST = "last AS (SELECT stream_id, max(stream_version) AS version FROM {0} GROUP BY stream_id)"
BALANCE = "SELECT r.stream_id, r.stream_version AS version, r.balance FROM run r JOIN last l ON r.stream_id = l.stream_id AND r.stream_version = l.version"


@query(BALANCE, LOG, RUNNING, LAST.format("ev"))
def fold_balance(spark, d):
    return fold.since_reset(user_log(spark, d, by="stream_id"), reset(), delta())


@query(BALANCE, LOG, RUNNING, LAST.format("ev"))
def fold_balance_by_expression(spark, d):
    zero = F.lit(0).cast("decimal(28,2)")

    def step(acc: Column, e: Column) -> Column:
        kind = e["event_type"]
        moved = F.when(kind == "signup", zero).when(kind == "purchase", acc + e["amount"]).when(kind == "error", acc - e["amount"]).otherwise(acc)
        return moved.cast("decimal(28,2)")

    return fold.by_expression(user_log(spark, d, by="stream_id"), ["event_type", "amount"], zero, step).withColumnRenamed("state", "balance")


@query("SELECT stream_id, event_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM ev GROUP BY ALL", LOG)
def fold_counts_by_type(spark, d):
    return user_log(spark, d, by="stream_id").groupBy("stream_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


@query(BALANCE, LOG, RUNNING, LAST.format("ev WHERE stream_version <= 25"))
def hydrate_to_version(spark, d):
    return fold.since_reset(user_log(spark, d, by="stream_id"), reset(), delta(), to_version=25)


@query(
    "SELECT r.stream_id, w.wanted AS to_version, r.stream_version AS version, r.balance FROM w JOIN run r ON r.user_id = w.user_id AND r.stream_version = least(w.wanted, w.tip)",
    LOG,
    RUNNING,
    "w AS (SELECT user_id, 10 + user_id % 60 AS wanted, max(stream_version) AS tip FROM ev GROUP BY user_id)",
)
def hydrate_batch_versions(spark, d):
    """Each stream at a version of its own; past the tip, at the tip."""
    log = user_log(spark, d).withColumn("to_version", 10 + F.col("user_id") % 60).where("stream_version <= to_version")
    wanted = log.groupBy("stream_id").agg(F.first("to_version").alias("to_version"))
    return fold.since_reset(log, reset(), delta()).join(wanted, "stream_id").select("stream_id", "to_version", "version", "balance")


@query(
    "SELECT stream_id, CAST(sum(CASE WHEN v <> coalesce(p, 0) + 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM g GROUP BY stream_id",
    LOG,
    "g AS (SELECT stream_id, stream_version AS v, lag(stream_version) OVER (PARTITION BY stream_id ORDER BY stream_version) AS p FROM ev WHERE k % 7 <> 3)",
)
def contiguity_check(spark, d):
    """Of a log with holes."""
    return fold.contiguity(user_log(spark, d, by="stream_id").where("k % 7 <> 3"))


FAILS = "event_type = 'error' AND k % 3 = 0"


@query(
    """SELECT e.stream_id, count(*) FILTER (f.v IS NULL OR e.stream_version < f.v) AS projected, CAST(max(CASE WHEN f.v IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS failed
       FROM ev e LEFT JOIN f USING (stream_id) GROUP BY e.stream_id""",
    LOG,
    f"f AS (SELECT stream_id, min(stream_version) AS v FROM ev WHERE {FAILS} GROUP BY stream_id)",
)
def fold_fail_stop(spark, d):
    return fold.until_failure(user_log(spark, d, by="stream_id"), F.expr(FAILS))


@query(f"SELECT stream_id, count(*) FILTER (NOT ({FAILS})) AS projected, count(*) FILTER ({FAILS}) AS failed FROM ev GROUP BY stream_id", LOG)
def fold_continue(spark, d):
    return fold.past_failures(user_log(spark, d, by="stream_id"), F.expr(FAILS))


@query(r"SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, json_valid(props) AS valid FROM events")
def decode_payload(spark, d):
    """Strict: a payload of the wrong type shows in the corrupt column, a missing field doesn't."""
    ev = table(spark, d, "events")
    p = F.from_json("props", "k BIGINT, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return ev.select("event_id", p.alias("p")).select("event_id", F.col("p.k").alias("k"), F.col("p._bad").isNull().alias("valid"))


@query(
    """SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'late' END, 'early') AS actor, 'c-' || CAST(user_id AS VARCHAR) AS correlation,
       CAST(2 + event_id % 2 AS INTEGER) AS n_keys FROM events"""
)
def metadata_merge(spark, d):
    """Ambient metadata over an event's own: the last write wins."""
    ev = table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    own = F.create_map(F.lit("actor"), F.lit("early"), F.lit("correlation_id"), F.concat(F.lit("c-"), F.col("user_id").cast("string")))
    ambient = F.when(even, F.create_map(F.lit("actor"), F.lit("late"))).otherwise(F.create_map(F.lit("tenant"), F.lit("t")))
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(ambient), k))
    m = F.map_concat(kept, ambient)
    return ev.select("event_id", m.alias("m")).select("event_id", F.col("m")["actor"].alias("actor"), F.col("m")["correlation_id"].alias("correlation"), F.size("m").alias("n_keys"))


RESERVED = "ledger."


@query("SELECT event_id, event_id % 5 = 0 AS reserved FROM events")
def metadata_reserved(spark, d):
    """Keys of the reserved prefix are refused at save."""
    ev = table(spark, d, "events")
    key = F.when(F.col("event_id") % 5 == 0, F.lit(f"{RESERVED}snapshot_version")).otherwise(F.lit("ledgers"))
    m = F.create_map(key, F.lit("1"))
    return ev.select("event_id", F.exists(F.map_keys(m), lambda x: F.startswith(x, F.lit(RESERVED))).alias("reserved"))


# --- snapshots

N = 10
SNAPS = f"snaps AS (SELECT stream_id, stream_version AS version, balance FROM run WHERE stream_version % {N} = 0)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    r = fold.running(user_log(spark, d, by="stream_id"), reset(), delta())
    return r.where(snapshots.every(N, F.col("stream_version"))).select("stream_id", F.col("stream_version").alias("version"), "balance")


@query("SELECT * FROM snaps", LOG, RUNNING, SNAPS)
def snapshot_policy(spark, d):
    """All snapshots that a policy takes along the log, from one job."""
    return _snapshots(spark, d)


@query("SELECT stream_id, max(version) AS version, arg_max(balance, version) AS balance FROM snaps GROUP BY stream_id", LOG, RUNNING, SNAPS)
def snapshot_latest(spark, d):
    return snapshots.newest(_snapshots(spark, d))


@query("SELECT stream_id, max(version) AS version, arg_max(balance, version) AS balance FROM snaps WHERE version <= 35 GROUP BY stream_id", LOG, RUNNING, SNAPS)
def snapshot_max_version(spark, d):
    return snapshots.newest(_snapshots(spark, d), max_version=35)


@query("SELECT stream_id, version, balance FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) AS r FROM snaps) WHERE r <= 2", LOG, RUNNING, SNAPS)
def snapshot_retention_last_n(spark, d):
    return snapshots.keep_last(_snapshots(spark, d), 2)


@query("SELECT * FROM snaps WHERE version >= 30", LOG, RUNNING, SNAPS)
def snapshot_retention_min_version(spark, d):
    return snapshots.keep_from(_snapshots(spark, d), 30)


def _with_tail(log: DataFrame, snaps: DataFrame) -> DataFrame:
    """Balance from each stream's snapshot and the events past it; streams whose snapshot is at the tip included."""
    rest = snapshots.tail(log, snaps)
    folded = fold.since_reset(rest, reset(), delta())
    cleared = rest.groupBy("stream_id").agg(F.max(reset()).alias("cleared"))
    heads = scan.heads(log).select("stream_id", "tip")
    base = heads.join(snaps.withColumnRenamed("version", "snap_version").withColumnRenamed("balance", "snap_balance"), "stream_id", "left")
    all_of = base.join(folded, "stream_id", "left").join(cleared, "stream_id", "left")
    kept = F.when(F.coalesce("cleared", F.lit(False)), F.lit(0)).otherwise(F.coalesce("snap_balance", F.lit(0)))
    return all_of.select("stream_id", F.col("tip").alias("version"), (kept + F.coalesce("balance", F.lit(0))).cast("decimal(28,2)").alias("balance"))


@query(BALANCE, LOG, RUNNING, LAST.format("ev"))
def snapshot_plus_tail(spark, d):
    """Equals the whole fold."""
    return _with_tail(user_log(spark, d), snapshots.newest(_snapshots(spark, d)))


TYPED = "typed AS (SELECT *, CASE version % 30 WHEN 0 THEN 'text/other' WHEN 10 THEN '' ELSE 'application/json' END AS content_type FROM snaps)"


@query("SELECT s.stream_id, s.version, s.content_type, s.content_type IN ('', 'application/json') AS used FROM typed s", LOG, RUNNING, SNAPS, TYPED)
def snapshot_content_type_fallback(spark, d):
    kind = F.when(F.col("version") % 30 == 0, "text/other").when(F.col("version") % 30 == 10, "").otherwise("application/json")
    typed = _snapshots(spark, d).withColumn("content_type", kind)
    return typed.select("stream_id", "version", "content_type", snapshots.usable(F.col("content_type"), "application/json").alias("used"))


STORED = "stored AS (SELECT stream_id, stream_version, CASE WHEN stream_version % 4 = 1 THEN 'x' WHEN stream_version % 4 = 2 THEN NULL ELSE CAST(stream_version * 3 AS VARCHAR) END AS captured FROM ev)"


@query(
    """SELECT stream_id, max(stream_version) AS stream_version, CAST(arg_max(captured, stream_version) AS BIGINT) AS version FROM stored
       WHERE captured IS NOT NULL AND captured <> 'x' AND CAST(CASE WHEN captured = 'x' THEN NULL ELSE captured END AS BIGINT) <= 100 GROUP BY stream_id""",
    LOG,
    STORED,
)
def snapshot_stream_read(spark, d):
    """Snapshots kept in a stream, some unreadable, with a bound."""
    v = F.col("stream_version")
    text = F.when(v % 4 == 1, "x").when(v % 4 == 2, F.lit(None)).otherwise((v * 3).cast("string"))
    return snapshots.from_stream(user_log(spark, d).select("stream_id", "stream_version", text.alias("captured")), max_version=100)


@query(BALANCE, LOG, RUNNING, LAST.format("ev"))
def latest_state_cache(spark, d):
    """Half of the streams are in the latest-state table, the others are folded."""
    log = user_log(spark, d)
    hit = F.col("user_id") % 2 == 0
    cached = fold.since_reset(log.where(hit), reset(), delta())
    missing = log.join(cached.select("stream_id"), "stream_id", "left_anti")
    return cached.unionByName(fold.since_reset(missing, reset(), delta()))


# --- projections


@query("SELECT event_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, max(global_position) AS position FROM ev GROUP BY event_type", LOG)
def projection_drain(spark, d):
    return projection.totals(user_log(spark, d))


@query("SELECT event_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, max(global_position) AS position FROM ev WHERE global_position > 700 GROUP BY event_type", LOG)
def projection_resume(spark, d):
    return projection.totals(user_log(spark, d).where("global_position > 700"))


@query(
    """SELECT CAST(b AS BIGINT) AS batch, min(gp) AS first_position, max(gp) AS last_position, count(gp) AS n FROM
       (SELECT ceil(row_number() OVER (ORDER BY event_id) / 250.0) AS b, event_id + 1 AS gp FROM events) GROUP BY b
       UNION ALL SELECT CAST(count(*) // 250 + 1 AS BIGINT), NULL, NULL, 0 FROM events HAVING count(*) % 250 = 0"""
)
def projection_batches(spark, d):
    """The reads of a drain with a batch of 250; a full last one costs an empty read."""
    return projection.batches(table(spark, d, "events").select((F.col("event_id") + 1).alias("global_position")), 250)


@query("SELECT r AS handled, gp AS position FROM (SELECT row_number() OVER (ORDER BY event_id) AS r, event_id + 1 AS gp, count(*) OVER () AS n FROM events) WHERE r % 30 = 0 OR r = n")
def checkpoint_schedule(spark, d):
    return projection.saves(table(spark, d, "events").select((F.col("event_id") + 1).alias("global_position")), 30)


@query("SELECT 'p' || CAST(user_id % 10 AS VARCHAR) AS name, CAST(user_id % 3 + 1 AS BIGINT) AS version, arg_max(CAST(value * 100 AS BIGINT), event_id) AS position, max(ts) AS updated_at FROM events GROUP BY 1, 2")
def checkpoint_last_write_wins(spark, d):
    """Saves in order; a lower position wins over a higher one before it."""
    ev = table(spark, d, "events")
    saves = ev.select(
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("name"), (F.col("user_id") % 3 + 1).alias("version"),
        F.round(F.col("value") * 100).cast("long").alias("position"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"),
    )
    return projection.latest_checkpoints(saves)


@query(f"SELECT global_position, stream_id, event_type, (SELECT max(global_position) FROM ev) AS checkpoint FROM ev WHERE {FAILS}", LOG)
def projection_dead_letters(spark, d):
    """Events whose handler failed under the policy that goes on; the checkpoint passes them."""
    return projection.dead_letters(user_log(spark, d), F.expr(FAILS)).select("global_position", "stream_id", "event_type", "checkpoint")


# --- rebuilds


def _rebuilds(spark: SparkSession, d: str) -> DataFrame:
    """A rebuild for each user; each event type stands for a step of its life."""
    log = user_log(spark, d)
    step = F.element_at(F.array(*map(F.lit, rebuild.EVENTS)), (F.col("k") % len(rebuild.EVENTS) + 1).cast("int"))
    return log.select("stream_id", "stream_version", step.alias("event_type"), F.col("timestamp").alias("at"), F.col("global_position").alias("position"), F.lit("orders").alias("name"), (F.col("k") + 1).alias("next_version"), F.col("k").alias("previous_version"), F.concat(F.lit("because "), F.col("k").cast("string")).alias("reason"))


STEPS = "['rebuildcreated', 'buildstarted', 'buildresumed', 'caughtup', 'promoted', 'rolledback', 'abandoned', 'previousretired']"
REBUILDS = f"""rb AS (SELECT stream_id, stream_version AS v, {STEPS}[k % 8 + 1] AS e, "timestamp" AS tm, global_position AS p, k FROM ev),
rp AS (SELECT *, CASE e WHEN 'rebuildcreated' THEN 'created' WHEN 'buildstarted' THEN 'building' WHEN 'buildresumed' THEN 'building' WHEN 'caughtup' THEN 'caughtup'
       WHEN 'promoted' THEN 'promoted' WHEN 'rolledback' THEN 'rolledback' WHEN 'abandoned' THEN 'abandoned' ELSE 'retired' END AS phase FROM rb)"""


@query(
    """SELECT stream_id, max(v) AS version, arg_max(phase, v) AS phase, CASE WHEN count(*) FILTER (e = 'rebuildcreated') > 0 THEN 'orders' END AS name,
       arg_max(k + 1, v) FILTER (e = 'rebuildcreated') AS next_version, arg_max(k, v) FILTER (e = 'rebuildcreated') AS previous_version,
       arg_max('because ' || CAST(k AS VARCHAR), v) FILTER (e = 'rebuildcreated') AS reason, arg_max(tm, v) FILTER (e = 'rebuildcreated') AS created_at,
       arg_max(tm, v) FILTER (e = 'caughtup') AS caught_up_at, arg_max(p, v) FILTER (e = 'caughtup') AS caught_up_position,
       arg_max(tm, v) FILTER (e = 'promoted') AS promoted_at, arg_max('because ' || CAST(k AS VARCHAR), v) FILTER (e = 'abandoned') AS abandon_cause
       FROM rp GROUP BY stream_id""",
    LOG,
    REBUILDS,
)
def rebuild_state(spark, d):
    return rebuild.state(_rebuilds(spark, d))


@query("SELECT stream_id, v AS stream_version, phase FROM rp", LOG, REBUILDS)
def rebuild_phase_history(spark, d):
    return rebuild.history(_rebuilds(spark, d)).select("stream_id", "stream_version", "phase")


# --- identities

_U = "0b96a8c8-d79c-4a50-85c9-19698889f59b"
SAMPLES = [
    f"account_{_U}", f"a_{_U}", f"my_type_{_U}", f"a__b_{_U}", f"Ünï_{_U}", f"9_{_U}", "", "account", _U, f"_{_U}", f"account{_U}", f"_account_{_U}",
    f"account__{_U}", f"account_{_U.upper()}", f"account_{_U.replace('-', '')}", f"account_{{{_U}}}", f"account_urn:uuid:{_U}", f"account_{_U[:-1]}", f"account_{_U}0", f"account_{_U[:-1]}g",
]
TYPES = ["account", "a", "a_b", "a__b", "_a", "a_", "_", "__", "", "Ü", "a b", "_a_"]
PROJECTIONS = [("orders", 1), ("a", 1), ("a_b9", 12), ("a" * 40, 1), ("a" * 41, 1), ("", 1), ("Orders", 1), ("9a", 1), ("_a", 1), ("a_", 1), ("a-b", 1), ("a b", 1), ("orders", 0), ("orders", -1), ("é", 1)]
SQL_ID = r"'([^_]|[^_].*[^_])_([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})'"


def _values(*rows: str) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


@query(
    f"""SELECT i, CASE WHEN regexp_full_match(t, {SQL_ID}) THEN regexp_extract(t, {SQL_ID}, 1) END AS type, CASE WHEN regexp_full_match(t, {SQL_ID}) THEN regexp_extract(t, {SQL_ID}, 2) END AS uuid
        FROM {_values(*(f"({i}, '{t}')" for i, t in enumerate(SAMPLES)))} v(i, t)"""
)
def typeid_parse(spark, d):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")
    return df.select("i", ids.parse_type("t").alias("type"), ids.parse_uuid("t").alias("uuid"))


@query(f"SELECT i, t <> '' AND t[1] <> '_' AND t[-1] <> '_' AS valid FROM {_values(*(f"({i}, '{t}')" for i, t in enumerate(TYPES)))} v(i, t)")
def typeid_validate(spark, d):
    return spark.createDataFrame(list(enumerate(TYPES)), "i int, t string").select("i", ids.valid_type("t").alias("valid"))


@query(
    f"""SELECT i, name || '_v' || CAST(version AS VARCHAR) AS id, regexp_full_match(name, '[a-z]([a-z0-9_]*[a-z0-9])?') AND strlen(name) <= 40 AND version >= 1 AS valid
        FROM {_values(*(f"({i}, '{n}', {v})" for i, (n, v) in enumerate(PROJECTIONS)))} v(i, name, version)"""
)
def projection_id_validate(spark, d):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PROJECTIONS)], "i int, name string, version long")
    return df.select("i", ids.projection_text(F.col("name"), F.col("version")).alias("id"), ids.valid_projection(F.col("name"), F.col("version")).alias("valid"))


@query("SELECT conv_id, max(turn) + 1 AS version, string_agg(role, '>' ORDER BY turn) AS roles, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def conversation_fold(spark, d):
    log = conversation_log(spark, d)
    turns = F.array_sort(F.collect_list(F.struct("stream_version", "role")))
    return log.groupBy("conv_id").agg(
        F.max("stream_version").alias("version"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"),
        F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"), F.sum(F.length("text").cast("long")).alias("n_chars"),
    )
