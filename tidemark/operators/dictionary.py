"""Dictionary changes in their order, as scans over each word's history.

Whether a word exists after a change is a constant (it was added, it was renamed away) or what it was before, so a word's
existence before each change is the last constant of its history: a segmented scan over chunks of (word, seq), in which
no task holds more than CHUNK changes of a word. Words depend on each other only through renames, which need a source
that exists and a target that does not. These facts are found in rounds: histories are scanned under the facts of the
round before and give new ones, until none changes. A fact rests on earlier changes only, so it is final once those it
rests on are; the rounds number the longest chain of words that hang on each other, not the changes.

What a word carries (id, active, deleted) then belongs to a stay: from being added or renamed to, to being renamed
away. A stay begun by a rename takes over from the stay the rename ended; such chains are followed by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_term
from ..session import materialize

CHUNK = 10_000
FROM_START = -(1 << 63)  # the stay of a word that was there before the first change
COLUMNS = ("id", "keyword", "normalized_keyword", "category", "active", "deleted")


def merge_dictionary(keywords: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply dictionary changes in the order of `seq`, which is unique; (dictionary, rejected changes with a reason).

    `changes`: (seq, action, word, new_word) with actions `seed`, `create`, `rename`, `activate`, `deactivate`,
    `delete`. A seed adds a word that is unknown and leaves others alone. Mined words cannot be changed by hand, and
    unknown ones only created; a rename to a word that exists at that moment is a conflict. Words without changes stay.
    """
    clean = changes.select("seq", "action", normalize_term(F.col("word")).alias("word"), normalize_term(F.col("new_word")).alias("new_word"))
    clean = clean.where("word IS NOT NULL")
    moving = (F.col("action") == "rename") & (F.col("new_word") != F.col("word"))
    own = clean.withColumns({"comes": F.lit(False), "moves": F.coalesce(moving, F.lit(False))})
    arriving = own.where("moves").select("seq", "action", F.col("new_word").alias("word"), F.col("word").alias("new_word"), F.lit(True).alias("comes"), "moves")
    first = keywords.select(*[F.col(c).alias(f"old_{c}") for c in COLUMNS])
    events = own.unionByName(arriving).join(first, F.col("word") == F.col("old_normalized_keyword"), "left")
    events = materialize(events.withColumns({
        "chunk": F.floor(F.col("seq") / CHUNK), "there": F.col("old_normalized_keyword").isNotNull(),
        "mined": F.coalesce(F.col("old_category") == "auto", F.lit(False))}))
    judged = materialize(_judged(events))
    rejected = judged.where("NOT comes AND reason IS NOT NULL").select("seq", "action", "word", F.col("new_word"), "reason")
    untouched = keywords.select(*COLUMNS).join(events.select("word"), F.col("normalized_keyword") == F.col("word"), "left_anti")
    return untouched.unionByName(_carried(judged, keywords)), rejected


def before(events: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds `name`: the last value of the word's earlier events that is not null."""
    marked = events.withColumn("_v", value)
    upto = Window.orderBy("chunk").partitionBy("word").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy("word", "chunk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("seq"))).alias("_last")).select(
        "word", "chunk", F.last("_last", ignorenulls=True).over(upto).alias("_carry"))
    inside = Window.partitionBy("word", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (marked.join(carry, ["word", "chunk"])
            .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), "_carry")).drop("_v", "_carry"))


def _existing(events: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Adds `exists`: whether the word is there before the event, if the renames of `facts` are possible as it says."""
    added = F.when(F.col("action").isin("seed", "create"), F.lit(True))
    if facts is not None:
        events = events.join(facts, "seq", "left")
        # Away, unless the target is there; arrived, if the source is there (a word that is there already stays).
        added = F.when(F.col("comes"), F.when(F.col("source"), F.lit(True))).when(
            F.col("moves"), F.when(~F.col("target"), F.lit(False))).otherwise(added)
    else:
        added = F.when(~F.col("moves"), added)
    scanned = before(events, added, "exists")
    return scanned.withColumn("exists", F.col("mined") | F.coalesce("exists", "there"))


def _facts(scanned: DataFrame) -> DataFrame:
    """(seq, source, target): of every rename whether the source is there and may go, and whether the target is there."""
    return scanned.where("moves").groupBy("seq").agg(
        F.bool_or(F.when(~F.col("comes"), F.col("exists") & ~F.col("mined"))).alias("source"),
        F.bool_or(F.when(F.col("comes"), F.col("exists"))).alias("target"))


def _judged(events: DataFrame) -> DataFrame:
    """The events with `exists`, `done` (a rename that took place) and `reason` (null for what is accepted)."""
    # Only words of renames depend on others, and only additions and renames decide on existence.
    linked = events.join(events.where("moves").select("word").distinct(), "word", "left_semi").where(
        F.col("moves") | F.col("action").isin("seed", "create")).select("word", "chunk", "seq", "action", "comes", "moves", "there", "mined")
    linked = materialize(linked)
    facts, seen = None, None
    while True:
        new = materialize(_facts(_existing(linked, facts)))
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("seq", "source", "target").cast("decimal(38,0)"))).first())
        facts = new
        if state == seen:
            break
        seen = state
    action = F.col("action")
    scanned = _existing(events, facts).withColumn("done", F.coalesce(F.col("moves") & F.col("source") & ~F.col("target"), F.lit(False)))
    reason = (F.when(action == "seed", None).when(F.col("mined"), "mined").when(action == "create", None)
              .when(~F.col("exists"), "unknown").when((action == "rename") & F.col("new_word").isNull(), "empty")
              .when(F.col("moves") & F.col("target"), "conflict"))
    return scanned.withColumn("reason", F.when(~F.col("comes"), reason)).drop("source", "target")


def _carried(judged: DataFrame, keywords: DataFrame) -> DataFrame:
    """The words with changes that exist in the end."""
    action, accepted = F.col("action"), ~F.col("comes") & ~F.col("moves") & F.col("reason").isNull() & ~F.col("mined")
    born = accepted & action.isin("seed", "create") & ~F.col("exists")
    begins = F.when(born | (F.col("comes") & F.col("done")), F.col("seq"))
    stays = before(judged, begins, "_stay").withColumn("stay", F.coalesce(begins, "_stay", F.lit(FROM_START)))
    stays = materialize(stays)
    touched = accepted & (action != "seed")

    def last(value: Column) -> Column:
        """The last value that is set, in an array so that unset differs from null."""
        return F.max_by(F.array(value), F.when(value.isNotNull(), F.col("seq")))

    sets_active = F.when(born, F.lit(True)).when(touched, F.when(action.isin("create", "activate"), F.lit(True)).when(
        action.isin("deactivate", "delete"), F.lit(False)))
    sets_deleted = F.when(born, F.lit(False)).when(touched, F.when(action == "create", F.lit(False)).when(action == "delete", F.lit(True)))
    came = F.col("comes") & F.col("done")
    rows = stays.groupBy("word", "stay").agg(
        last(sets_active).alias("active"), last(sets_deleted).alias("deleted"),
        F.bool_or(touched).alias("touched"), F.bool_or(touched & action.isin("create", "rename")).alias("spelled"),
        F.bool_or(accepted & (action == "seed")).alias("seeded"), F.bool_or(born).alias("born"),
        F.bool_or(F.col("moves") & ~F.col("comes") & F.col("done")).alias("left"),
        F.max(F.when(came, F.col("seq"))).alias("by"), F.any_value("there").alias("there"),
        *[F.any_value(f"old_{c}").alias(f"old_{c}") for c in COLUMNS])
    rows = rows.where(F.col("by").isNotNull() | F.col("born") | ((F.col("stay") == FROM_START) & F.col("there")))
    source = stays.where("moves AND NOT comes AND done").select(F.col("seq").alias("by"), F.col("word").alias("from_word"), F.col("stay").alias("from_stay"))
    start = F.col("stay") == FROM_START
    rows = rows.join(source, "by", "left").withColumns({
        "active": F.coalesce("active", F.when(start, F.array("old_active"))),
        "deleted": F.coalesce("deleted", F.when(start, F.array(F.coalesce("old_deleted", F.lit(False))))),
        "id": F.when(F.col("by").isNull(), F.array(F.when(start, F.col("old_id"))))})
    rows = materialize(rows)
    links = rows.select(F.col("word").alias("to_word"), F.col("stay").alias("to_stay"), "id", "active", "deleted", "from_word", "from_stay")
    box = ("id", "active", "deleted")
    while not (open_ := links.where("from_word IS NOT NULL")).isEmpty():
        # What a stay does not set comes from the one before; afterwards it points twice as far back.
        back = links.select(F.col("to_word").alias("from_word"), F.col("to_stay").alias("from_stay"),
                            *[F.col(c).alias(f"b_{c}") for c in box], F.col("from_word").alias("b_word"), F.col("from_stay").alias("b_stay"))
        further = open_.join(back, ["from_word", "from_stay"]).select(
            "to_word", "to_stay", *[F.coalesce(c, f"b_{c}").alias(c) for c in box],
            F.col("b_word").alias("from_word"), F.col("b_stay").alias("from_stay"))
        links = materialize(links.where("from_word IS NULL").unionByName(further))
    ends = rows.where("NOT left").drop(*box).join(links.select(
        F.col("to_word").alias("word"), F.col("to_stay").alias("stay"), *box), ["word", "stay"])
    unchanged = start & ~F.col("touched")
    category = F.when(unchanged & ~(F.col("seeded") & (F.col("old_category") == "general") & ~F.coalesce("old_deleted", F.lit(False))),
                      F.col("old_category")).otherwise("manual")
    return ends.select(F.element_at("id", 1).alias("id"), F.when(start & ~F.col("spelled"), F.col("old_keyword")).otherwise(F.col("word")).alias("keyword"),
                       F.col("word").alias("normalized_keyword"), category.alias("category"),
                       F.element_at("active", 1).alias("active"), F.element_at("deleted", 1).alias("deleted"))
