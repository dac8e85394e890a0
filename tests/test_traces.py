"""Chains of look-ups, replayed feeds, sent state, rounds, undetermined picks and structural checks on named rows."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from feedwright import operators as op


# --- drop trace ---


def chain(frame):
    lines = frame("line int, order int", (1, 10), (2, 10), (3, 11), (4, 12), (5, 99), (6, None))
    orders = frame("id int, cust int, note string", (10, 1, "a"), (10, 1, "b"), (11, 2, "c"), (12, None, "d"))
    return lines, [op.LookUp("order", orders, "order", "id", ["cust"]), op.LookUp("customer", frame("c int", (1,)), "cust", "c")]


def test_each_lost_row_names_its_first_look_up(frame):
    lines, steps = chain(frame)
    got = rows(op.trace_look_ups(lines, steps), "line", "dropped_by")
    # An order listed twice multiplies nothing; an order without a customer is lost at the customer.
    assert got == [(1, None), (2, None), (3, "customer"), (4, "customer"), (5, "order"), (6, "order")]
    assert rows(op.drop_trace(lines, "order", steps)) == [(11, "customer", 1), (12, "customer", 1), (99, "order", 1), (None, "order", 1)]


def test_rows_in_and_out_of_every_step(frame):
    lines, steps = chain(frame)
    assert rows(op.drop_steps(lines, "order", steps)) == [(1, "order", 6, 4, 4, 3), (2, "customer", 4, 2, 3, 1)]
    seen = Observation()
    op.trace_look_ups(lines, steps, seen).collect()
    assert seen.get == {"order_in": 6, "order_out": 4, "customer_in": 4, "customer_out": 2}
    empty = lines.filter("false")
    assert rows(op.drop_trace(empty, "order", steps)) == []
    assert rows(op.drop_steps(empty, "order", steps)) == [(1, "order", 0, 0, 0, 0), (2, "customer", 0, 0, 0, 0)]


def test_a_hot_key_of_a_chain_is_split(spark):
    """A third of the rows hang on one order; its partition of the look-up is split."""
    lines = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order"), F.lit("x" * 50).alias("pad"))
    orders = spark.range(300_000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("cust"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = op.trace_look_ups(lines, [op.LookUp("order", orders, "order", "key")])
        out.write.format("noop").mode("overwrite").save()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString() or _skewed(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _skewed(df):
    df.count()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_steps_need_names_of_their_own(frame):
    lines, (step, _) = chain(frame)
    with pytest.raises(ValueError):
        op.trace_look_ups(lines, [step, step])


# --- interference ---


def test_the_last_writer_is_compared_with_the_owner(frame):
    a = frame("k string, run int, price string, label string", ("x", 1, "1", "l"), ("x", 3, "3", None), ("y", 2, "2", "l"), ("z", 1, "5", None))
    b = frame("k string, run int, price string, stock string", ("x", 2, "9", "7"), ("y", 2, "8", None), ("z", 2, "5", "1"), ("w", 1, "4", None))
    got = rows(op.feed_interference({"a": a, "b": b}, "k", "run", {"price": "a", "label": "a", "stock": "b"}))
    # x: a wrote last. y: in one run the later feed wins. z: the same value again is no harm. w: a never sent a price.
    assert got == [("w", "price", "a", None, None, "b", "4", 1, "foreign"), ("y", "price", "a", "2", 2, "b", "8", 2, "overwritten")]
    with pytest.raises(ValueError):
        op.feed_interference({"a": a}, "k", "run", {"price": "nobody"})


def test_replay_against_a_plain_replay(spark, frame):
    rng = random.Random(1)
    feeds = {n: [(rng.randint(1, 6), rng.randint(1, 4), rng.choice(["p", "q", None]), rng.choice(["s", None])) for _ in range(40)] for n in "abc"}
    frames = {n: frame("k int, run int, f string, g string", *r) for n, r in feeds.items()}
    state, owned = {}, {}
    for run in range(1, 5):
        for n, writes in feeds.items():
            values = defaultdict(list)
            for k, r, f, g in writes:
                for field, v in (("f", f), ("g", g)):
                    if r == run and v is not None:
                        values[k, field].append(v)
            for place, vs in values.items():
                state[place] = (n, max(vs), run)
                if {"f": "a", "g": "c"}[place[1]] == n:
                    owned[place] = (max(vs), run)
    expected = []
    for (k, field), (feed, value, run) in state.items():
        owner, own = {"f": "a", "g": "c"}[field], owned.get((k, field))
        if feed != owner and (own is None or own[0] != value):
            expected.append((k, field, owner, *(own or (None, None)), feed, value, run, "overwritten" if own else "foreign"))
    assert rows(op.feed_interference(frames, "k", "run", {"f": "a", "g": "c"})) == sorted(expected, key=str)


# --- sent state ---


POLICIES = {"price": "delta", "name": "first", "trace": "force"}


def test_a_key_that_comes_back_is_not_new(frame):
    schema = "k string, price int, name string, trace string"
    images = [
        frame(schema, ("a", 1, "n", "t"), ("b", 1, "n", "t"), ("c", None, "n", None)),
        frame(schema, ("a", 1, "n", "t")),
        frame(schema, ("a", 2, "m", "t"), ("b", 1, "m", "t"), ("c", 5, "n", "t"), ("d", None, None, None)),
    ]
    fields = list(POLICIES)
    state = op.merge_sent(op.image_state(images[0], "k", fields, 1), images[1], "k", fields, 2)
    assert rows(state, "k", "first_run", "last_run") == [("a", 1, 2), ("b", 1, 1), ("c", 1, 1)]
    got = rows(op.state_delta(state, images[2], "k", POLICIES))
    assert got == [("a", "changed", "price,trace"), ("b", "forced", "trace"), ("c", "changed", "price,trace"), ("d", "new", "price,name,trace")]
    # A value that is cleared is sent as a change; without forced fields a key with nothing to send is left out.
    cleared = frame(schema, ("a", None, "n", "t"), ("b", 1, "n", "t"))
    assert rows(op.state_delta(state, cleared, "k", {"price": "delta", "name": "first"})) == [("a", "changed", "price")]
    assert rows(op.state_delta(state, images[2], "k", POLICIES, F.col("k") == "d")) == [("d", "new", "price,name,trace")]
    with pytest.raises(ValueError):
        op.state_delta(state, cleared, "k", {"price": "sometimes"})


def test_state_holds_digests_not_values(frame):
    state = op.image_state(frame("k string, price string", ("a", "x" * 1000)), "k", ["price"], 1)
    assert dict(state.dtypes)["price"] == "bigint"


# --- rounds ---


def test_difference_of_reports_counts_copies(frame):
    before = frame("k string, v int", ("a", 1), ("a", 1), ("b", None), ("c", 3))
    after = frame("k string, v int", ("a", 1), ("b", None), ("d", 4), ("d", 4))
    assert rows(op.round_diff(before, after, ["k", "v"])) == [("a", 1, -1, "fixed"), ("c", 3, -1, "fixed"), ("d", 4, 2, "new")]


def test_states_over_rounds(frame):
    s = "k string, v int"
    reports = [frame(s, ("a", 1), ("b", 2)), frame(s, ("a", 1), ("a", 1), ("c", None)), frame(s, ("b", 2)), frame(s, ("x", 0)).filter("false"), frame(s, ("c", None))]
    assert rows(op.discrepancy_states(reports, ["k", "v"])) == sorted([
        ("a", 1, 1, 1, 1, "new"), ("a", 1, 2, 2, 1, "persisting"), ("a", 1, 3, 0, -2, "fixed"),
        ("b", 2, 1, 1, 1, "new"), ("b", 2, 2, 0, -1, "fixed"), ("b", 2, 3, 1, 1, "relapsed"), ("b", 2, 4, 0, -1, "fixed"),
        ("c", None, 2, 1, 1, "new"), ("c", None, 3, 0, -1, "fixed"), ("c", None, 5, 1, 1, "relapsed"),
    ], key=str)
    # The changes between two rounds are the multiset difference of their reports.
    for i in range(1, len(reports)):
        diff = {tuple(r)[:2]: r["change"] for r in op.round_diff(reports[i - 1], reports[i], ["k", "v"]).collect()}
        states = {tuple(r)[:2]: r["change"] for r in op.discrepancy_states(reports, ["k", "v"]).filter((F.col("round") == i + 1) & (F.col("change") != 0)).collect()}
        assert diff == states


# --- undetermined picks ---


def test_tied_rows_and_the_fields_they_differ_in(frame):
    df = frame(
        "k string, u date, i date, a string, b string",
        *[(k, None, None if d is None else __import__("datetime").date(2020, 1, d), a, b) for k, d, a, b in [
            ("one", 1, "x", "y"), ("same", 1, "x", "y"), ("same", 1, "x", "y"), ("older", 1, "x", "y"), ("older", 1, "z", "y"), ("older", 2, "x", "y"),
            ("tie", 2, "x", "y"), ("tie", 2, "x", None), ("tie", 1, "q", "q"), ("both", 3, "1", "2"), ("both", 3, "2", "1"), ("both", 3, "1", "2"), ("none", None, "1", "2"),
        ]],
    )
    got = rows(op.undetermined_pick(df, "k", ["u", "i"], ["a", "b"]), "k", "tied_rows", "fields")
    assert got == [("both", 3, "a,b"), ("tie", 2, "b")]


# --- catalog values ---


def test_every_amount_of_a_document(frame):
    json = '{"values":{"p":[{"scope":"x","data":[{"amount":"1.50"},{"amount":2}]},{"data":[{"amount":null}]}],"q":3,"r":{"scope":"y"},"s":[{"scope":"z","data":{"amount":"1"}}, 5]}}'
    df = frame("id string, json string", ("a", json), ("b", "no json"), ("c", None), ("d", '{"values":null}'), ("e", "[1]"), ("f", '{"values":[{"p":1}]}'))
    assert rows(op.catalog_values(df, "id")) == [("a", "p", "x", 1, "1.50"), ("a", "p", "x", 2, "2"), ("a", "p", None, 1, None)]
    plan = op.catalog_values(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "Exchange" not in plan
    # The older look-up of one attribute agrees.
    one = op.json_scope_extract(df.filter("id = 'a'"), "id", "p", "x")
    assert rows(one) == [("a", "1.50")]


def test_key_names_that_clash(frame):
    df = frame("key string, value string", ("a", '{"values":{"p":[{"scope":"x","data":[{"amount":"1"}]}]}}'))
    assert rows(op.catalog_values(df, "key", "value")) == [("a", "p", "x", 1, "1")]


# --- structure ---


def test_counts_of_counts(frame):
    df = frame(
        "ch string, o int, r string",
        ("A", 1, "x"), ("A", 1, "x"), ("a ", 2, "y"), ("B", 3, "x"), ("B", 3, "y"), ("B", 4, None), ("C", 5, "x"), (None, 6, "x"),
    )
    got = [(m, n, a, b, float(x), float(y)) for m, n, a, b, x, y in rows(op.structure_parity(df, "ch", "a", "B", "o", "r"))]
    assert got == [
        ("lines per record", 1, 1, 2, 0.5, 1.0), ("lines per record", 2, 1, 0, 0.5, 0.0),
        ("records per order", 0, 0, 1, 0.0, 0.5), ("records per order", 1, 2, 0, 1.0, 0.0), ("records per order", 2, 0, 1, 0.0, 0.5),
    ]
    one_side = rows(op.structure_parity(df, "ch", "A", "nobody", "o", "r"))
    assert {(r[3], r[5]) for r in one_side} == {(0, None)}


# --- shipment leak ---


def test_leaks_against_the_full_graph(frame):
    rng = random.Random(2)
    lines = [(o, n, rng.choice(["d1", "d2", "d3", None])) for o in range(30) for n in range(rng.randint(1, 4))]
    tracking = [(o, d) for o in range(35) for d in rng.sample(["d1", "d2", "d3", None], rng.randint(0, 3))]
    tracking += tracking[:5]
    got = rows(op.shipment_leak(frame("order_number int, line_number int, first_shipped_shipdoc string", *lines), frame("order_number int, shipping_document_number string", *tracking)))
    edges, own, docs = Counter(), Counter(), defaultdict(set)
    for o, d in set(tracking):
        docs[o] |= {d} - {None}
        for lo, _, ld in lines:
            if lo == o:
                edges[o, d] += 1
                own[o, d] += ld == d and d is not None
    assert got == sorted(((o, d, len(docs[o]), n, own[o, d], n - own[o, d]) for (o, d), n in edges.items() if n > own[o, d]), key=str)
