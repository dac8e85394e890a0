"""What several feeds, or several runs of one feed, leave behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import POLICIES
from .keys import as_list


def feed_writes(feeds: Mapping[str, DataFrame], key: str, run: str, fields: Sequence[str]) -> DataFrame:
    """(key, run, turn, feed, field, value): one row per value that a feed sends, as text.

    Feeds run one after the other in the order given. A feed writes the fields it has a column for; a null is not sent.
    """
    out = []
    for turn, (name, df) in enumerate(feeds.items()):
        sent = [f for f in fields if f in df.columns]
        values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in sent])
        rows = df.select(key, F.col(run).alias("run"), F.lit(turn).alias("turn"), F.lit(name).alias("feed"), F.inline(values))
        out.append(rows.filter(F.col("value").isNotNull()))
    return reduce(DataFrame.union, out)


def feed_interference(feeds: Mapping[str, DataFrame], key: str, run: str, owners: Mapping[str, str]) -> DataFrame:
    """Values that another feed than the field's owner leaves in place.

    ``owners`` gives each field the feed it belongs to. Runs are replayed in order, and within a run the feeds in the order
    given: per key and field the last write is a maximum over (run, turn), and so is the owner's own last one, so all of
    it is one aggregate, combined before the shuffle. Listed are keys whose last writer is not the owner: 'overwritten'
    where the owner had sent another value, 'foreign' where it never sent one; the owner's value written again is no
    harm. Of several values in one turn the largest counts.
    """
    unknown = set(owners.values()) - set(feeds)
    if unknown:
        raise ValueError(f"owners {sorted(unknown)} are no feeds")
    owner = F.element_at(F.create_map(*[F.lit(t) for pair in owners.items() for t in pair]), F.col("field"))
    writes = feed_writes(feeds, key, run, list(owners)).withColumn("owner", owner)
    last = F.struct("run", "turn", "value", "feed")
    found = writes.groupBy(key, "field", "owner").agg(
        F.max(last).alias("last"), F.max(F.when(F.col("feed") == F.col("owner"), F.struct("run", "turn", "value"))).alias("own")
    )
    state = F.when(F.col("own").isNull(), "foreign").when(F.col("own.value") != F.col("last.value"), "overwritten")
    return found.filter(F.col("last.feed") != F.col("owner")).withColumn("state", state).filter(F.col("state").isNotNull()).select(
        key,
        "field",
        "owner",
        F.col("own.value").alias("owner_value"),
        F.col("own.run").alias("owner_run"),
        F.col("last.feed").alias("last_feed"),
        F.col("last.value").alias("last_value"),
        F.col("last.run").alias("last_run"),
        "state",
    )


def _digest(field: str) -> Column:
    """A number for a field's value; null has one of its own."""
    return F.when(F.col(field).isNotNull(), F.xxhash64(F.col(field).cast("string")))


def image_state(image: DataFrame, key: str | Sequence[str], fields: Sequence[str], run: int) -> DataFrame:
    """State after one run that sent ``image`` (one row per key): first and last run, and a digest per field."""
    return image.select(
        *as_list(key), F.lit(run).alias("first_run"), F.lit(run).alias("last_run"), *[_digest(f).alias(f) for f in fields]
    )


def merge_sent(state: DataFrame, image: DataFrame, key: str | Sequence[str], fields: Sequence[str], run: int) -> DataFrame:
    """The state after a further run. Keys that the run leaves out keep what was last sent for them.

    State and image are stacked and grouped by key: digests travel, wide rows do not.
    """
    key = as_list(key)
    newest = F.max(F.struct("last_run", *fields)).alias("_newest")
    both = state.unionByName(image_state(image, key, fields, run))
    merged = both.groupBy(*key).agg(F.min("first_run").alias("first_run"), newest)
    return merged.select(*key, "first_run", F.col("_newest.last_run").alias("last_run"), *[F.col(f"_newest.{f}").alias(f) for f in fields])


def state_delta(
    state: DataFrame, image: DataFrame, key: str | Sequence[str], policies: Mapping[str, str], eligible: Column | None = None
) -> DataFrame:
    """(key, reason, fields): what a run of ``image`` has to send, given all that was ever sent.

    A 'first' field goes to keys that no run sent, also when a key returns after it had left; a 'delta' field when its
    digest differs from the one last sent; a 'force' field always. ``fields`` lists them in the order of ``policies``;
    reason is 'new' or 'changed', or 'forced' where only forced fields go out. Keys with nothing to send are left out.
    """
    bad = set(policies.values()) - set(POLICIES)
    if bad:
        raise ValueError(f"unknown policy {sorted(bad)}")
    key = as_list(key)
    now = image if eligible is None else image.filter(eligible)
    digests = [_digest(f).alias(f) for f in policies]
    sent = state.select(*key, F.lit(True).alias("_known"), *[F.col(f).alias(f"_last_{f}") for f in policies])
    joined = now.select(*key, *digests).join(sent, key, "left")
    new = F.col("_known").isNull()
    changed = {f: ~F.col(f).eqNullSafe(F.col(f"_last_{f}")) for f, p in policies.items() if p == "delta"}
    send = {"force": lambda f: F.lit(True), "delta": lambda f: new | changed[f], "first": lambda f: new}
    listed = F.concat_ws(",", *[F.when(send[p](f), F.lit(f)) for f, p in policies.items()])
    any_change = reduce(Column.__or__, changed.values(), F.lit(False))
    reason = F.when(new, "new").when(any_change, "changed").otherwise("forced")
    return joined.select(*key, reason.alias("reason"), listed.alias("fields")).filter(F.col("fields") != "")
