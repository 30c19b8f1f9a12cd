"""The change log of live series: numbered messages, and a reader that misses nothing.

Every message of a game has a number that grows along the log and names the one before it
(`previous`). A `snapshot` holds a series as stored and the number up to which it is complete,
`points` and `closing` hold what was added, and `reset` says that a series starts anew. A reader
may take messages in any order and more than once: the newest snapshot or reset counts, later
messages are laid over it, and a message whose predecessor is not there shows a gap. Long lists are cut
into parts, so no game becomes one huge row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.latest import latest_by

RESET, POINTS, CLOSING, SNAPSHOT = "reset", "points", "closing", "snapshot"
_PLACE = {RESET: 0, POINTS: 1, CLOSING: 2}  # within one batch
PART_POINTS = 500
MESSAGE = "game_id string, type string, source string, seq long, previous long, part long, parts long, points string"
POINT = (
    "action_id long, period int, clock_seconds double, elapsed_seconds double, score_home int, score_away int, "
    "possession int, home_win_prob double, description string"
)
_FIELDS = [f.split()[0] for f in POINT.split(", ")]


def sequence(batch_id: int, kind: str) -> int:
    """The number of a batch's messages of one kind."""
    return batch_id * 4 + _PLACE[kind]


def _parts(points: DataFrame) -> DataFrame:
    """(game_id, part, parts, points): a series in pieces of a bounded number of actions."""
    cells = points.select("game_id", F.floor(F.col("action_id") / PART_POINTS).alias("cell"), F.struct(*_FIELDS).alias("p"))
    pieces = cells.groupBy("game_id", "cell").agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("points"))
    counts = pieces.groupBy("game_id").agg(F.count(F.lit(1)).alias("parts"))
    return pieces.join(counts, "game_id").withColumnRenamed("cell", "part")


def _message(rows: DataFrame, kind: str, source: str) -> DataFrame:
    types = {f.split()[0]: f.split()[1] for f in MESSAGE.split(", ")}
    rows = rows.withColumn("type", F.lit(kind)).withColumn("source", F.lit(source))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def messages_of(points: DataFrame, kind: str, seq: int, source: str, sent: DataFrame) -> DataFrame:
    """Messages of new points; `sent` (game_id, sent) has the number of each game's last message."""
    before = sent.select("game_id", F.col("sent").alias("previous"))
    return _message(_parts(points).join(before, "game_id", "left").withColumn("seq", F.lit(seq)), kind, source)


def snapshot_of(points: DataFrame, source: str, sent: DataFrame) -> DataFrame:
    """Snapshots of whole series, complete up to the number in `sent`; a game without one has
    got no message that is not in the series."""
    numbers = sent.select("game_id", F.col("sent").alias("seq"))
    rows = _parts(points).join(numbers, "game_id", "left").withColumn("seq", F.coalesce("seq", F.lit(-1)))
    return _message(rows.withColumn("previous", F.lit(None)), SNAPSHOT, source)


def resets_of(games: DataFrame, seq: int, source: str) -> DataFrame:
    rows = games.select("game_id", F.lit(seq).alias("seq"), F.lit(None).alias("previous"))
    for name in ("part", "parts", "points"):
        rows = rows.withColumn(name, F.lit(None))
    return _message(rows, RESET, source)


def _counted(messages: DataFrame) -> DataFrame:
    """Messages from each series' newest snapshot or reset on; equal ones once. Of a snapshot and a
    reset with one number the snapshot came after."""
    series = ["game_id", "source"]
    messages = messages.dropDuplicates([*series, "type", "seq", "part"])
    begins = F.col("type").isin(RESET, SNAPSHOT)
    begin = messages.where(begins).groupBy(*series).agg(F.max(F.struct("seq", (F.col("type") == SNAPSHOT).alias("whole"))).alias("begin"))
    joined = messages.join(begin, series, "left")
    is_begin = (F.col("seq") == F.col("begin.seq")) & ((F.col("type") == SNAPSHOT) == F.col("begin.whole"))
    later = F.col("begin").isNull() | (F.col("seq") > F.col("begin.seq"))
    return joined.where(F.when(begins, is_begin).otherwise(later))


def read_series(messages: DataFrame) -> DataFrame:
    """(game_id, source, points...) as the messages leave each series."""
    told = _counted(messages).where("points IS NOT NULL")
    cells = told.select("game_id", "source", "seq", F.explode(F.from_json("points", f"array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>")).alias("p"))
    newest = latest_by(cells.select("game_id", "source", "seq", "p.*"), ["game_id", "source", "action_id"], ["seq"])
    return newest.select("game_id", "source", *_FIELDS)


def gaps(messages: DataFrame) -> DataFrame:
    """(game_id, source, seq, missing): messages whose predecessor has not come, and messages of
    which parts are missing (`missing` is their own number)."""
    told = _counted(messages)
    numbers = told.select("game_id", "source", F.col("seq").alias("missing")).distinct()
    later = told.where(~F.col("type").isin(RESET, SNAPSHOT) & F.col("previous").isNotNull())
    # What the series begins with stands for everything before it.
    open_ = later.where(F.col("begin").isNull() | (F.col("previous") > F.col("begin.seq")))
    lost = open_.select("game_id", "source", "seq", F.col("previous").alias("missing")).distinct()
    lost = lost.join(numbers, ["game_id", "source", "missing"], "left_anti").select("game_id", "source", "seq", "missing")
    held = told.where("parts IS NOT NULL").groupBy("game_id", "source", "seq", "type").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
    cut = held.where("n < parts").select("game_id", "source", "seq", F.col("seq").alias("missing"))
    return lost.unionByName(cut)
