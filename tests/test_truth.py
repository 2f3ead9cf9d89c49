"""Hand-made rows with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn, schemas as S
from tidemark.operators import cdc, changes, facts, firsts, joins, keywords, routing, summaries, traffic
from tidemark.operators.windows import tumble, window_bounds


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- visitor repair -----------------------------------------------------------

@pytest.mark.parametrize("given, expected", [
    ([("1", 1), ("1", 1)], ["1", "1"]),
    ([("1", 1), ("1", 2)], ["1", "0"]),
    ([("0", 1)], ["0"]),
    ([("0", 1), ("1", 1)], ["0", "0"]),
    ([("0", 1), ("1", 2)], ["0", "0"]),
])
def test_repair_truth_table(spark, given, expected):
    data = [("m", flag, at(day, second=i), i) for i, (flag, day) in enumerate(given)]
    df = spark.createDataFrame(data, "mid string, is_new string, rt timestamp, n int")
    fixed = traffic.repair_is_new(df, "mid", "rt", "is_new").orderBy("n").collect()
    assert [r.is_new for r in fixed] == expected


def state_machine(sequence):
    """What a record-at-a-time job does: remember the first day, or that there was one before."""
    first, out = None, []
    for flag, day in sequence:
        if flag == "1":
            if first is None or first == day:
                first = day
            else:
                flag = "0"
        elif first is None:
            first = "before"
        out.append(flag)
    return out


def test_repair_equals_state_machine(spark):
    rng = random.Random(7)
    data, expected = [], []
    for visitor in range(300):
        days = sorted(rng.randint(1, 3) for _ in range(rng.randint(1, 6)))
        sequence = [(rng.choice("01"), d) for d in days]
        for i, ((flag, day), want) in enumerate(zip(sequence, state_machine(sequence))):
            data.append((f"m{visitor}", flag, at(day, second=i), i))
            expected.append((f"m{visitor}", i, want))
    df = spark.createDataFrame(data, "mid string, is_new string, rt timestamp, n int")
    fixed = traffic.repair_is_new(df, "mid", "rt", "is_new")
    assert rows_of(fixed, "mid", "n", "is_new") == sorted(expected)


def test_repair_keeps_rows_without_visitor(spark):
    df = spark.createDataFrame([(None, "1", at(1)), (None, "1", at(2))], "mid string, is_new string, rt timestamp")
    assert [r.is_new for r in traffic.repair_is_new(df, "mid", "rt", "is_new").collect()] == ["1", "1"]


@pytest.mark.parametrize("sent_bytes", [1 << 20, -1])
def test_log_repair_leaves_texts_where_they_lie(spark, sent_bytes):
    """Equal to the repair by a join of all records, on both ways; only records of visitors to repair may meet in a shuffle."""
    rng = random.Random(8)
    texts = ["{cut", "[1]", None, '{"common":{"is_new":"1"},"ts":5}', '{"common":{"mid":"x","is_new":"1"}}']
    for visitor in range(200):
        for _ in range(rng.randint(1, 6)):
            ms = 1_704_067_200_000 + rng.randint(0, 3) * 86_400_000 + rng.randint(0, 5) * 1000
            flag = rng.choice(['"1"', '"1"', '"0"', "null"])
            texts.append(f'{{"common":{{"mid":"m{visitor}","is_new":{flag}}},"ts":{ms},"n":{len(texts)}}}')
    heads = traffic.log_heads(spark.createDataFrame([(t,) for t in texts], "value string"))
    timed = heads.withColumn("_at", F.timestamp_millis("ts"))
    expected = traffic.repair_is_new(timed, "mid", "_at", "is_new").drop("_at")
    fixed = traffic.repair_log(heads, sent_bytes=sent_bytes)
    columns = ["value", "mid", "is_new", "ts"]
    assert fixed.columns == columns
    assert sorted(map(str, fixed.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    if sent_bytes > 0:  # no text is in an exchange
        assert "Exchange hashpartitioning" not in fixed._jdf.queryExecution().executedPlan().toString()


def test_bucketed_parts_are_joined_where_they_lie(spark, sf_dir):
    """Too large to be sent around, as tables of that kind are."""
    import workload.all  # noqa: F401
    from workload.registry import QUERIES

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = QUERIES["order_facts_in_place"](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan, plan
        rows = df.count()
    finally:
        spark.conf.set(threshold, before)
    assert rows == QUERIES["order_facts_from_log"](spark, sf_dir).count()


# --- change log ---------------------------------------------------------------

def log_of(spark, table, records):
    data = [("shop", table, kind, new, old) for kind, new, old in records]
    return spark.createDataFrame(
        data, "database string, table string, type string, data map<string,string>, old map<string,string>"
    ).withColumns({"rt": F.current_timestamp(), "pt": F.current_timestamp()})


def test_cart_delta(spark):
    log = log_of(spark, "cart_info", [
        ("insert", {"id": "1", "sku_num": "3"}, None),
        ("update", {"id": "2", "sku_num": "5"}, {"sku_num": "3"}),
        ("update", {"id": "3", "sku_num": "4"}, {"sku_num": "5"}),
        ("update", {"id": "4", "sku_num": "9"}, {"is_checked": "1"}),
        ("delete", {"id": "5", "sku_num": "9"}, None),
    ])
    assert rows_of(cdc.cart_add(log), "id", "sku_num") == [("1", "3"), ("2", "2")]
    assert cdc.cart_add(log, "other").count() == 0


def test_cancel_filter(spark):
    log = log_of(spark, "order_info", [
        ("update", {"id": "1", "order_status": "1003"}, {"order_status": "1001"}),
        ("update", {"id": "2", "order_status": "1002"}, {"order_status": "1001"}),
        ("update", {"id": "3", "order_status": "1003"}, {"tracking_no": "x"}),
        ("insert", {"id": "4", "order_status": "1003"}, {"order_status": "1001"}),
    ])
    assert rows_of(cdc.order_cancel(log), "id") == [("1",)]


def test_cdc_log_reports_bad_records(spark):
    raw = spark.createDataFrame([
        ('{"database":"shop","table":"t","type":"insert","ts":60,"data":{"id":"1"}}',),
        ('{"database":',), ("[1]",), ("",), (None,),
    ], "value string")
    good, bad = cdc.cdc_log(raw)
    assert [(r.table, r.rt, r.data) for r in good.collect()] == [
        ("t", dt.datetime(1970, 1, 1, 0, 1), {"id": "1"})
    ]
    assert rows_of(bad, "value") == [("",), ("[1]",), ('{"database":',)]


# --- joins --------------------------------------------------------------------

def test_interval_ends(spark):
    pays = spark.createDataFrame([("o", at(1, 12))], "order_id string, pay_rt timestamp")
    lines = spark.createDataFrame([
        ("o", at(1, 11, 45), "lower end"), ("o", at(1, 11, 44, 59), "before"),
        ("o", at(1, 12, 1), "upper end"), ("o", at(1, 12, 1, 1), "after"), ("x", at(1, 12), "other key"),
    ], "order_id string, rt timestamp, what string")
    joined = joins.interval_join(pays, lines, "order_id", "pay_rt", "rt", "-15 minutes", "60 seconds")
    assert rows_of(joined, "what") == [("lower end",), ("upper end",)]


@pytest.mark.parametrize("lower, upper", [("-15 minutes", "60 seconds"), ("5 seconds", "90 seconds"), ("0 seconds", "0 seconds")])
def test_interval_join_equals_brute_force_with_a_hot_key(spark, lower, upper):
    rng = random.Random(3)

    def make(n):
        return [(("hot" if rng.random() < 0.4 else f"k{rng.randint(1, 9)}"), at(1) + dt.timedelta(seconds=rng.randint(0, 7200)), i) for i in range(n)]

    left, right = make(150), make(150)
    lo, hi = (dt.timedelta(seconds=joins.seconds(s)) for s in (lower, upper))
    expected = sorted((a[2], b[2]) for a in left for b in right if a[0] == b[0] and lo <= b[1] - a[1] <= hi)
    joined = joins.interval_join(
        spark.createDataFrame(left, "k string, lt timestamp, l int"),
        spark.createDataFrame(right, "k string, rt timestamp, r int"), "k", "lt", "rt", lower, upper,
    )
    assert rows_of(joined, "l", "r") == expected


def test_lookup_drops_and_enrich_keeps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "code string, n int")
    dim = spark.createDataFrame([("a", ("Alpha",))], "rowkey string, info struct<dic_name: string>")
    values = {"name": "info.dic_name"}
    assert rows_of(joins.lookup_join(df, dim, "code", values), "n", "name") == [(1, "Alpha")]
    assert rows_of(joins.enrich(df, dim, "code", values), "n", "name") == [(1, "Alpha"), (2, None), (3, None)]


# --- first-of-key -------------------------------------------------------------

@pytest.mark.parametrize("gap, back", [(6, 0), (7, 1), (8, 1)])
def test_returning_user(spark, gap, back):
    df = spark.createDataFrame([("u", at(1, 9)), ("u", at(1, 10)), ("u", at(1 + gap, 9))], "uid string, rt timestamp")
    days = firsts.login_first_of_day(df, "uid", "rt").orderBy("rt").collect()
    assert [(r.uu, r.back) for r in days] == [(1, 0), (1, back)]


def test_returning_user_literal_rule(spark):
    df = spark.createDataFrame([("u", at(1)), ("u", at(2))], "uid string, rt timestamp")
    assert [r.back for r in firsts.login_first_of_day(df, "uid", "rt", back_days=1).orderBy("rt").collect()] == [0, 1]


def test_flag_first_of_day_with_a_hot_key(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.randint(1, 3), second=rng.randint(0, 3)), i) for i in range(200)]
    seen, expected = set(), {}
    for key, ts, i in sorted(data, key=lambda r: (r[1], r[2])):
        fresh = key is not None and (key, ts.date()) not in seen
        seen.add((key, ts.date()))
        expected[i] = int(fresh)
    df = spark.createDataFrame(data, "mid string, rt timestamp, n int")
    flagged = firsts.flag_first_of_day(df, "mid", "rt", ["n"])
    assert rows_of(flagged, "n", "uv") == sorted(expected.items())


def test_day_follows_the_zone(spark):
    df = spark.createDataFrame([("m", at(1, 15)), ("m", at(1, 17))], "mid string, rt timestamp")
    assert firsts.first_of_day(df, ["mid"], "rt").count() == 1
    assert firsts.first_of_day(df, ["mid"], "rt", tz="+08:00").count() == 2


def test_order_flags_take_day_from_creation(spark):
    df = spark.createDataFrame(
        [("u", at(2, 1), at(1).date()), ("u", at(2, 2), at(2).date()), ("u", at(2, 3), at(1).date())],
        "user_id string, rt timestamp, day date",
    )
    flags = firsts.order_first_flags(df, "user_id", "rt", "day").orderBy("rt").collect()
    assert [(r.cur_date.day, r.rt.hour, r.is_new) for r in flags] == [(1, 1, 1), (2, 2, 0)]


# --- log splitting ------------------------------------------------------------

def log_rows(spark):
    raw = [
        '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"home"},"err":{"code":7},"ts":1}',
        '{"common":{"mid":"m","is_new":"1"},"start":{"entry":"icon"},"err":{"code":8},"ts":2}',
        '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"list"},"displays":[{"item":"1","pos_id":3},'
        '{"item":"2"}],"actions":[{"action_id":"add","ts":9,"n":{"deep":[1,2]}}],"ts":3}',
    ]
    raw += [
        '{"common":{"mid":null,"is_new":"1","x":[1]},"page":{"page_id":"p","during_time":"12"},"extra":{"n":1.50},"ts":"4"}',
        '{"common":{"mid":"old","is_new":"0"},"page":{},"ts":1}', '{"common":{"mid":"old","is_new":"1","y":2},"page":{"z":null},"ts":5}',
        '{"cut', '[1]', None,
    ]
    return traffic.repair_log(traffic.log_heads(spark.createDataFrame([(r,) for r in raw], "value string")))


def test_split_log(spark):
    parts = traffic.split_log(log_rows(spark))
    assert {k: v.count() for k, v in parts.items()} == {
        "error": 2, "start": 1, "page": 5, "display": 2, "action": 1, "bad": 2,
    }


def test_split_log_records_keep_open_fields(spark):
    import json

    by_topic = {}
    for r in traffic.split_log_records(log_rows(spark)).collect():
        by_topic.setdefault(r.topic, []).append(r.value if r.topic == "dwd_traffic_bad" else json.loads(r.value))
    common = {"mid": "m", "is_new": "1"}
    shown = {"common": common, "ts": 3, "page_id": "list"}
    assert sorted(by_topic["dwd_traffic_display"], key=str) == sorted(
        [{"item": "1", "pos_id": 3, **shown}, {"item": "2", **shown}], key=str)
    assert by_topic["dwd_traffic_action"] == [{"action_id": "add", "n": {"deep": [1, 2]}, **shown}]
    first = {"common": common, "page": {"page_id": "home"}, "err": {"code": 7}, "ts": 1}
    started = {"common": common, "start": {"entry": "icon"}, "err": {"code": 8}, "ts": 2}
    order = lambda rows: sorted(rows, key=lambda r: str(r["ts"]))
    assert order(by_topic["dwd_traffic_err"]) == [first, started]
    assert by_topic["dwd_traffic_start"] == [started]
    assert order(by_topic["dwd_traffic_page"])[-3:] == [
        {"common": common, "page": {"page_id": "list"}, "ts": 3},
        {"common": {"mid": None, "is_new": "1", "x": [1]}, "page": {"page_id": "p", "during_time": "12"}, "extra": {"n": 1.5}, "ts": "4"},
        {"common": {"mid": "old", "is_new": "0", "y": 2}, "page": {"z": None}, "ts": 5},
    ]
    assert sorted(by_topic["dwd_traffic_bad"]) == ["[1]", '{"cut']


def test_log_is_parsed_whole_only_once(spark):
    plan = traffic.split_log_records(log_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson(") == 1, plan


@pytest.mark.parametrize("sent_bytes", [traffic.SENT_BYTES, 0])
def test_log_repair_parses_heads_once(spark, sent_bytes):
    heads = traffic.log_heads(spark.createDataFrame([('{"common":{"mid":"m","is_new":"1"},"ts":1}',)], "value string"))
    plan = traffic.repair_log(heads, sent_bytes=sent_bytes)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "JsonToStructs" not in plan, plan


def test_split_log_makes_only_the_rows_asked_for(spark):
    parts = traffic.split_log(log_rows(spark))
    for kind, rows in parts.items():
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert {t for t in S.LOG_TOPICS.values() if t in plan} <= {S.LOG_TOPICS[kind]}, plan
    together = rows_of(traffic.split_log_records(log_rows(spark)), "value")
    assert sorted(v for p in parts.values() for v in rows_of(p, "value")) == sorted(together)


@pytest.mark.parametrize("ordered", [False, True])
def test_split_log_clears_the_flag_wherever_it_stands(spark, ordered):
    import json

    bodies = [  # the flag stands plainly, spaced, escaped, as a number, twice, behind another field of its name, in a text
        '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"ts":1,"n":1.50}',
        '{"common":{"mid":"m","is_new" : "1"},"page":{"page_id":"p"},"ts":1}',
        '{"common":{"mid":"m","is\\u005fnew":"1"},"page":{"page_id":"p","is_new":"1"},"ts":1}',
        '{"common":{"mid":"m","is_new":1},"page":{"page_id":"p"},"ts":1}',
        '{"page":{"page_id":"p","is_new":"1"},"common":{"mid":"m","is_new":"1"},"ts":1}',
        '{"page":{"page_id":"p","is_new":"1"},"common":{"mid":"m","is_new": "1"},"ts":1}',
        '{"common":{"mid":"m","is_new":"1","said":"\\"is_new\\":\\"1\\""},"page":{"page_id":"p"},"ts":1}',
        '  {"common":{"mid":"m","is_new":"1"},"\\u0073tart":{"entry":"icon"},"ts":1}',
        '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"displays":[{"is_new":"1"},7,{"ts":9}],"ts":1}',
    ]
    heads = spark.createDataFrame([(b, "0") for b in bodies], "value string, is_new string")
    rows = traffic.split_log_records(heads, ordered=ordered).collect()
    found = [(r.topic, json.loads(r.value)) for r in rows]
    wanted = []
    for b in map(json.loads, bodies):
        b["common"]["is_new"] = "0"
        shared = {"common": b["common"], "ts": b["ts"], "page_id": b.get("page", {}).get("page_id")}
        wanted += [("dwd_traffic_display", {**(x if isinstance(x, dict) else {"element": x}), **shared}) for x in b.pop("displays", [])]
        wanted.append(("dwd_traffic_start" if "start" in b else "dwd_traffic_page", b))
    by_text = lambda found: sorted((topic, json.dumps(body, sort_keys=True)) for topic, body in found)
    assert by_text(found) == by_text(wanted)
    if ordered:
        assert all(r.value == json.dumps(json.loads(r.value), sort_keys=True, separators=(",", ":")) for r in rows)


def test_page_log_takes_quoted_numbers_and_reports_bad(spark):
    rows = ['{"common":{"mid":"m"},"page":{"page_id":"p","during_time":"12"},"ts":"1000","more":1}', "x", "[2]", None]
    good, bad = traffic.page_log(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert rows_of(good, "mid", "page_id", "during_time", "ts") == [("m", "p", 12, 1000)]
    assert rows_of(bad, "value") == [("[2]",), ("x",)]


def test_parse_json_takes_quoted_numbers(spark):
    rows = ['{"a":"1","b":{"c":"2.5","d":["3",4]},"e":"x"}', '{"a":"no","b":null,"e":null}']
    good, bad = fn.parse_json(spark.createDataFrame([(r,) for r in rows], "value string"), "a BIGINT, b STRUCT<c: DOUBLE, d: ARRAY<INT>>, e STRING")
    assert bad.count() == 0
    assert [(r.a, r.b and (r.b.c, r.b.d), r.e) for r in good.collect()] == [(1, (2.5, [3, 4]), "x"), (None, None, None)]


def test_login_and_search_pages(spark):
    df = spark.createDataFrame([
        (1, "u", None, "x", "keyword"), (2, "u", "login", "x", "sku"), (3, "u", "search", "x", "keyword"),
        (4, None, None, None, None), (5, "u", "search", None, "keyword"), (6, "u", "home", "x", "keyword"),
    ], "n int, uid string, last_page_id string, item string, item_type string")
    assert rows_of(traffic.login_pages(df), "n") == [(1,), (2,)]
    assert rows_of(traffic.search_pages(df), "n") == [(3,)]


# --- snapshots and routing ----------------------------------------------------

def merged(spark, records, snapshot=None):
    df = spark.createDataFrame(records, "rowkey string, a string, b string, gone boolean, n int")
    old = spark.createDataFrame(snapshot, "rowkey string, a string, b string") if snapshot else None
    return rows_of(changes.scd1_merge(df, "rowkey", ["a", "b"], ["n"], F.col("gone"), old), "rowkey", "a", "b")


def test_scd1_null_leaves_older_value(spark):
    assert merged(spark, [("k", "1", "2", False, 1), ("k", None, "3", False, 2)]) == [("k", "1", "3")]


def test_scd1_put_after_delete_starts_empty(spark):
    assert merged(spark, [("k", "1", "2", False, 1), ("k", None, None, True, 2), ("k", None, "4", False, 3)]) == [("k", None, "4")]


def test_scd1_with_snapshot(spark):
    old = [("kept", "1", "2"), ("gone", "1", "2"), ("part", "1", "2"), ("again", "1", "2")]
    records = [
        ("gone", None, None, True, 1), ("part", None, "9", False, 1), ("new", "5", None, False, 1),
        ("again", None, None, True, 1), ("again", "7", None, False, 2), ("never", None, None, True, 1),
        ("empty", None, None, False, 1),
    ]
    assert merged(spark, records, old) == [
        ("again", "7", None), ("empty", None, None), ("kept", "1", "2"), ("new", "5", None), ("part", "1", "9"),
    ]


def test_upsert_latest_with_deletes(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    rows = spark.createDataFrame(
        [("a", 2, 1, False), ("a", 3, 2, False), ("b", 9, 1, True), ("d", 4, 1, True), ("d", 5, 2, False)],
        "id string, v int, n int, gone boolean",
    )
    assert rows_of(changes.upsert_latest(target, rows, ["id"], ["n"], F.col("gone")), "id", "v") == [("a", 3), ("c", 1), ("d", 5)]


RULES = [
    ("user", "ALL", "dim_user", "dim", "info", "id, name", "id", None),
    ("order", "insert", "dwd_order", "dwd", None, "id", None, None),
]


def rules(spark, data=RULES):
    return spark.createDataFrame(data, S.TABLE_PROCESS)


def test_routers(spark):
    data = {"id": "1", "name": "n", "secret": "s"}
    log = spark.createDataFrame([
        ("shop", "user", "insert", data), ("shop", "user", "bootstrap-insert", data),
        ("shop", "user", "bootstrap-start", data), ("shop", "user", "bootstrap-complete", data),
        ("shop", "order", "insert", data), ("shop", "order", "update", data), ("shop", "other", "insert", data),
    ], "database string, table string, type string, data map<string,string>")
    dims = routing.dim_route(log, rules(spark)).collect()
    assert sorted((r.type, r.sink_table, r.row_key_column) for r in dims) == [
        ("bootstrap-insert", "dim_user", "id"), ("insert", "dim_user", "id"),
    ]
    assert all(r.data == {"id": "1", "name": "n"} for r in dims)
    out = routing.route_by_topic(routing.dwd_route(log, rules(spark))).collect()
    assert [(r.topic, r.value) for r in out] == [("dwd_order", '{"id":"1"}')]


def change(op, ts, before=None, after=None):
    import json

    def image(table):
        return table and {
            "source_table": table, "source_type": "insert", "sink_table": f"dwd_{table}", "sink_type": "dwd",
            "sink_columns": f"id,v{ts}",
        }

    return (json.dumps({"op": op, "ts_ms": ts, "before": image(before), "after": image(after)}),)


def test_config_changes(spark):
    raw = spark.createDataFrame([
        change("r", 1, after="a"), change("u", 2, "a", "a"), change("c", 3, after="b"), change("d", 4, before="b"),
        change("u", 5, "order", "moved"), change("c", 6, after="x"), ("{broken",),
    ], "value string")
    parsed, bad = routing.read_config_changes(raw)
    assert bad.count() == 1
    after = routing.apply_config(rules(spark), parsed, "dwd")
    assert rows_of(after, "source_table", "sink_columns") == [("a", "id,v2"), ("moved", "id,v5"), ("x", "id,v6")]


# --- words --------------------------------------------------------------------

def test_words(spark):
    df = spark.createDataFrame([(1, "Red-Widget, 2nd été"), (2, "--"), (3, None)], "n int, text string")
    assert rows_of(keywords.explode_words(df, "text"), "n", "word") == [(1, "2nd"), (1, "red"), (1, "widget"), (1, "été")]


def test_own_tokenizer_and_its_failures(spark):
    def halves(text):
        if "!" in text:
            raise ValueError(text)
        return text.split("|")

    df = spark.createDataFrame([(1, "a|b"), (2, "no!")], "n int, text string")
    got = [(r.n, r.word) for r in keywords.explode_words(df, "text", tokenizer=halves).orderBy("n", "word").collect()]
    assert got == [(1, "a"), (1, "b"), (2, None)]


def test_segmentation_keeps_overlaps_and_uncovered_characters(spark):
    known = spark.createDataFrame([(w,) for w in ["大数", "数据", "班级", "班", "级", "使用", "实时", "时数"]], "word string")
    df = spark.createDataFrame([(1, "在大数据0524班级使用Spark做实时数仓"), (2, "大数据 大数据")], "n int, text string")
    rows = keywords.segment(df.withColumnRenamed("n", "doc"), "text", known).collect()
    got = {(r.doc, r.word): r["n"] for r in rows}
    assert {w for d, w in got if d == 1} == {
        "在", "大数", "数据", "0524", "班级", "班", "级", "使用", "spark", "做", "实时", "时数", "仓",
    }
    assert {w: n for (d, w), n in got.items() if d == 2} == {"大数": 2, "数据": 2}


# --- windows and names --------------------------------------------------------

def test_window_bounds_and_offset(spark):
    df = spark.createDataFrame([(at(1, 23, 59, 59),), (at(2),)], "rt timestamp")
    days = window_bounds(tumble(df, "rt", "1 day", aggs=[F.count("*").alias("n")], offset="16 hours"), cur_date=True)
    assert rows_of(days, "stt", "edt", "n") == [("2024-01-01 16:00:00", "2024-01-02 16:00:00", 2)]


def test_province_window_takes_date_of_first_line(spark):
    df = spark.createDataFrame(
        [("p", "o1", at(1, 15, 30), "1.10"), ("p", "o2", at(1, 16, 30), "2.20"), ("p", "o1", at(1, 17), "3.30")],
        "province_id string, order_id string, rt timestamp, split_total_amount string",
    )
    row = summaries.province_order_window(df, tz="+08:00").collect()
    assert [(r.stt, r.cur_date, r.order_count, str(r.order_amount)) for r in row] == [
        ("2024-01-01 15:00:00", "2024-01-01", 2, "6.60")
    ]


def test_sku_window_names_and_nulls(spark):
    df = spark.createDataFrame(
        [("s", "later", at(1, 0, 0, 2), "5", None, "1"), ("s", "first", at(1, 0, 0, 1), "5", "2", "bad")],
        "sku_id string, sku_name string, rt timestamp, original_total_amount string, split_coupon_amount string, split_total_amount string",
    ).withColumn("split_activity_amount", F.lit(None).cast("string"))
    r = summaries.sku_order_window(df).first()
    assert (r.sku_name, r.original_amount, r.activity_amount, r.coupon_amount, r.order_amount) == ("first", 10, 0, 2, 1)


def test_naming_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3)], "orderUniqueUserCount int, category3Id int, ts int")
    assert fn.snake_case(df, drop=["ts"]).columns == ["order_unique_user_count", "category3_id"]
    assert fn.camel_case(fn.snake_case(df)).columns == df.columns


def test_wide_fact_schema():
    columns = S.order_detail_columns()
    assert len(columns) == 41 and columns[24] == "rt" and columns[-1] == "coupon_use_id"


def test_payment_status_is_optional(spark):
    log = log_of(spark, "payment_info", [
        ("insert", {"id": "1", "payment_status": "1602"}, None), ("insert", {"id": "2", "payment_status": "1601"}, None),
    ])
    assert cdc.payment_info(log).count() == 2
    assert rows_of(cdc.payment_info(log, status="1602"), "id") == [("1",)]


def test_spread_splits_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    placed = fn.spread(df, ["k"], 8, ["id"]).withColumn("p", F.spark_partition_id())
    assert placed.count() == 4000 and placed.select("p").distinct().count() > 1
    slices = placed.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(8))).groupBy("s").agg(F.count_distinct("p").alias("n"))
    assert {r.n for r in slices.collect()} == {1}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_comment_fact_columns(spark):
    log = log_of(spark, "comment_info", [("insert", {"id": "1", "appraise": "1201"}, None), ("update", {"id": "2", "appraise": "?"}, None)])
    names = spark.createDataFrame([("1201", ("good",))], "rowkey string, info struct<dic_name: string>")
    fact = facts.comment_fact(cdc.comment_info(log), names)
    assert fact.columns == S.COMMENT_FACT and rows_of(fact, "id", "appraise_name") == [("1", "good")]
