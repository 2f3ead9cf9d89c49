"""Application log: visitor-flag repair, splitting, page selections, measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.maps import put_keys
from tidemark.functions.times import day_of
from tidemark.session import written


NO_KEY = "\0none-"  # keys that begin so stand for a missing one

# Visitors to repair that are sent to every task, in bytes; beyond that their bits are: 256 bitmaps of 4 KB.
SENT_BYTES = 8 << 20
BITMAPS, BITMAP_BITS = 256, 32_768  # fixed value: bits of one bitmap of Spark's bitmap functions

# What the repair has to know of a log record.
HEAD = "common STRUCT<mid: STRING, is_new: STRING>, ts STRING, _corrupt_record STRING"


def spread_null_keys(key: Column, *values: Column | str) -> Column:
    """``key`` as text; a missing one gets a text of its own by ``values`` that matches no key.

    Rows without a key then do not meet in one partition of a join or one group.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit(NO_KEY), F.pmod(F.xxhash64(*values), F.lit(1024)).cast("string")))


def first_seen(df: DataFrame, key: str, ts: str, flag: str, *more: Column) -> DataFrame:
    """Per visitor the first time of a record that says new, and of one that does not; and ``more`` aggregates."""
    says_new = F.col(flag) == "1"
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_visitor")).agg(
        F.min(F.when(says_new, F.col(ts))).alias("_first_new"),
        F.min(F.when(~F.coalesce(says_new, F.lit(False)), F.col(ts))).alias("_first_old"),
        *more,
    )


def repair_is_new(
    df: DataFrame, key: str, ts: str, flag: str, tz: str | None = None, seen: DataFrame | None = None,
) -> DataFrame:
    """Correct the new-visitor flag of visitors who were seen before.

    ``'1'`` survives only on the visitor's first day, and only if the first
    record said ``'1'`` too; everything else that says ``'1'`` becomes ``'0'``.
    Flags that are not ``'1'`` and rows without a key stay as they are.  Of two
    records at the same instant the one that says ``'1'`` counts as earlier.

    All that has to be known of a visitor is the first time of either kind of
    record (``seen``, taken from ``df`` unless given): two timestamps per visitor,
    aggregated per task before the shuffle and joined back.  No visitor's records
    are ever sorted in one task.
    """
    says_new = F.col(flag) == "1"
    seen = first_seen(df, key, ts, flag) if seen is None else seen
    keyed = df.withColumn("_join", spread_null_keys(F.col(key), ts))
    joined = keyed.join(seen, keyed["_join"] == seen["_visitor"], "left")
    began_new = F.col("_first_old").isNull() | (F.col("_first_new") <= F.col("_first_old"))
    stays = began_new & (day_of(ts, tz) == day_of("_first_new", tz))
    repaired = F.when(
        says_new & F.col("_visitor").isNotNull() & ~stays, F.lit("0")
    ).otherwise(F.col(flag))
    return joined.withColumn(flag, repaired).select(*df.columns)


def log_heads(raw: DataFrame, value: str = "value") -> DataFrame:
    """Raw log records with what the repair needs: ``value``, ``mid``, ``is_new``, ``ts`` (ms).

    Only these fields are parsed; numbers may be quoted.  Deletion markers (null
    texts) are dropped.  A text that is no record has nulls beside it and stays.
    """
    head = F.explode(F.array(F.from_json(value, HEAD, {"columnNameOfCorruptRecord": "_corrupt_record"}))).alias("_h")
    rows = raw.filter(F.col(value).isNotNull()).select(F.col(value).alias("value"), head)
    sound = F.col("_h._corrupt_record").isNull()
    return rows.select(
        "value", F.when(sound, F.col("_h.common.mid")).alias("mid"),
        F.when(sound, F.col("_h.common.is_new")).alias("is_new"),
        F.when(sound, F.col("_h.ts").try_cast("bigint")).alias("ts"),
    )


def visitors_to_repair(seen: DataFrame, tz: str | None = None) -> DataFrame:
    """Of ``first_seen`` the visitors with a flag to clear: (_visitor, _kept_day).

    ``_here_new`` and ``_last_new`` are the first and last time of a record at hand that says new.  Their records that say new are cleared but for those of ``_kept_day`` (none if null).  Everybody else's stay.
    """
    began_new = F.coalesce(F.col("_first_old").isNull() | (F.col("_first_new") <= F.col("_first_old")), F.lit(False))
    kept = day_of("_first_new", tz)
    later = (day_of("_last_new", tz) != kept) | (day_of("_here_new", tz) != kept)
    return seen.filter(F.col("_first_new").isNotNull() & (~began_new | later)).select(
        "_visitor", F.when(began_new, kept).alias("_kept_day"))


def _visitor_bits(visitor: Column) -> tuple[Column, Column]:
    """Where a visitor stands in the bitmaps: the number of one, and the place in it."""
    h = F.xxhash64(visitor)
    return F.pmod(h, F.lit(BITMAPS)).cast("int"), F.pmod(F.shiftright(h, 16), F.lit(BITMAP_BITS))


def _in_two_paths(timed: DataFrame, repairs: DataFrame, day: Column) -> DataFrame:
    """``repair_log`` for more visitors than can be sent to every task.

    Bitmaps of the visitors' hashes, of a fixed size, go to every task.  A record that does not say
    new, or whose visitor's bit is not set, passes where it lies; the others, a few more than
    have to be changed, meet their visitor in a join.
    """
    number, place = _visitor_bits(F.col("_visitor"))
    bitmaps = F.broadcast(repairs.groupBy(number.alias("_number")).agg(F.bitmap_construct_agg(place).alias("_bits")))
    says_new = (F.col("is_new") == "1") & F.col("mid").isNotNull()
    number, place = _visitor_bits(F.col("mid"))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1") == 1, F.lit(False))
    asked = timed.filter(says_new).select("*", number.alias("_number"), place.alias("_place")).join(
        bitmaps, "_number", "left").withColumn("_byte", byte).withColumn("_hit", hit)
    met = asked.filter("_hit").select(*timed.columns).join(repairs, F.col("mid") == F.col("_visitor"), "left")
    return (
        timed.filter(~F.coalesce(says_new, F.lit(False)))
        .unionByName(asked.filter(~F.col("_hit")).select(*timed.columns))
        .unionByName(met.withColumn("is_new", _cleared(day)).select(*timed.columns)))


def _cleared(day: Column) -> Column:
    """The flag of a record that says new, beside its visitor's row of ``visitors_to_repair`` (null: nothing to clear)."""
    clear = F.col("_visitor").isNotNull() & (F.col("_kept_day").isNull() | (day != F.col("_kept_day")))
    return F.when((F.col("is_new") == "1") & clear, F.lit("0")).otherwise(F.col("is_new"))


def repair_log(
    heads: DataFrame, tz: str | None = None, sent_bytes: int = SENT_BYTES, history: DataFrame | None = None,
) -> DataFrame:
    """``repair_is_new`` on ``log_heads``; the texts ride along unparsed and stay where they lie.

    The heads are written to the shared folder, so that texts are parsed once for all passes, and the first reads no texts.
    Only visitor, time and flag are shuffled, to find the visitors with a flag to clear.
    That list is written to the shared folder and measured: up to ``sent_bytes`` it is sent to
    every task, beyond that records take two paths (``_in_two_paths``).  ``history`` is what
    ``first_seen`` gave for the records before these.
    """
    heads = written(heads, "heads")
    timed = heads.withColumn("_at", F.timestamp_millis("ts"))
    says_new = F.col("is_new") == "1"
    last = F.max(F.when(says_new, F.col("_at"))).alias("_last_new")
    seen = first_seen(timed, "mid", "_at", "is_new", last).withColumn("_here_new", F.col("_first_new"))
    if history is not None:
        before = history.select(
            F.col("_visitor").alias("_known"), F.col("_first_new").alias("_new_before"), F.col("_first_old").alias("_old_before"))
        seen = seen.join(before, seen["_visitor"] == before["_known"], "left").withColumns({
            "_first_new": F.least("_first_new", "_new_before"), "_first_old": F.least("_first_old", "_old_before")})
    repairs = written(visitors_to_repair(seen, tz), "repairs")
    size = repairs.agg(F.coalesce(F.sum(F.octet_length("_visitor") + 64), F.lit(0))).first()[0]
    day = day_of("_at", tz)
    if size > sent_bytes:
        return _in_two_paths(timed, repairs, day).select(*heads.columns)
    joined = timed.join(F.broadcast(repairs), F.col("mid") == F.col("_visitor"), "left")
    return joined.withColumn("is_new", _cleared(day)).select(*heads.columns)


def explode_events(log: DataFrame, array: str) -> DataFrame:
    """One row per element of ``array``, with the parent's common fields, time and page.

    Elements that are records become columns, elements that are maps stay one
    column named ``element``.
    """
    element = F.explode(array).alias("element")
    rows = log.select(element, "common", "ts", F.col("page.page_id").alias("page_id"))
    if rows.schema["element"].dataType.typeName() == "struct":
        return rows.select("element.*", "common", "ts", "page_id")
    return rows


def split_log_records(heads: DataFrame, kinds: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """Repaired log records as ``(topic, value)`` rows of five outputs and one for what is no record.

    A record with ``err`` goes to *error* whole and is then treated like any
    other.  A record with ``start`` goes to *start* only.  The rest are pages:
    their displays and actions become rows of their own, with the page's common
    fields, time and page id, and are taken out of the page record.

    Each text is parsed once, as an open body: fields nobody asked for go along, and
    the only value changed is a repaired ``common.is_new``.  A text that is no JSON
    object goes to *bad* as it is.  All rows come out of one pass; write them to a
    topic sink with a ``topic`` column or to files partitioned by ``topic``.
    ``kinds``: the outputs whose rows are made (all, unless given).  ``ordered``: records
    are written anew with the keys of every object in order; else texts with nothing to change stay as they are.
    """
    kinds = set(S.LOG_TOPICS if kinds is None else kinds)
    open_map = "map<string,variant>"

    def field(path: str, kind: str = "variant") -> Column:
        return F.try_variant_get("_body", f"$.{path}", kind)

    def named(name: str, text: str | Column = "_text") -> Column:
        # Only a text with this name, or with escapes, can have such a field: the others need no look into the body.
        return F.contains(text, F.lit(f'"{name}"')) | F.contains(text, F.lit("\\"))

    def present(name: str) -> Column:
        value = field(name)
        return named(name) & value.isNotNull() & ~F.is_variant_null(value)

    def once(rows: DataFrame, **columns: Column) -> DataFrame:
        # A one-element explode: what is used several times is worked out once.
        made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_o")
        return rows.select(*rows.columns, made).select(*rows.columns, "_o.*")

    def record(kind: str, value: Column) -> Column:
        return F.struct(F.lit(S.LOG_TOPICS[kind]).alias("topic"), value.alias("value"))

    # A flag that stands in the text once, and plainly, is cleared there; any other in the open body.
    says_new, says_old = F.lit('"is_new":"1"'), F.lit('"is_new":"0"')
    plain = (F.col("is_new") == "0") & F.contains("value", says_new) & ~F.contains("value", F.lit("\\"))
    alone = F.length(F.replace("value", F.lit('"is_new"'))) == F.length("value") - len('"is_new"')
    cleared = F.when(plain & alone, F.replace("value", says_new, says_old)).otherwise(F.col("value"))
    rows = once(heads.select("value", "is_new"), _text=cleared)
    rows = once(rows, _body=F.try_parse_json("_text"))
    # Of the texts that are JSON those that begin with a brace are objects.
    brace = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{"))
    rows = once(
        rows, _sound=F.col("_body").isNotNull() & brace, _started=F.coalesce(present("start"), F.lit(False)),
        _repaired=F.coalesce((F.col("is_new") == "0") & (field("common.is_new", "string") == "1"), F.lit(False)),
        **{f"_{k}": F.when(named(k), field(k, "array<variant>")) for k in ("displays", "actions")},
    )
    fixed = F.to_variant_object(put_keys(field("common", open_map), is_new=F.parse_json(F.lit('"0"'))))
    body = F.try_variant_get("_body", "$", open_map)
    body = F.when(F.col("_repaired"), put_keys(body, common=fixed)).otherwise(body)
    text_of = (lambda m: F.to_json(F.to_variant_object(m))) if ordered else F.to_json
    whole = F.when(F.col("_repaired"), text_of(body)).otherwise(F.to_json("_body") if ordered else F.col("_text"))
    holds = F.col("_displays").isNotNull() | F.col("_actions").isNotNull()
    if kinds & {"display", "action"}:
        context = F.map_filter(
            F.create_map(
                F.lit("common"), F.when(F.col("_repaired"), fixed).otherwise(field("common")), F.lit("ts"), field("ts"),
                F.lit("page_id"), field("page.page_id")),
            lambda _, v: v.isNotNull())
        rows = once(rows, _context=F.when(holds & ~F.col("_started"), context))
        shared = {} if ordered else {"_shared": F.to_json("_context")}
        rows = once(rows, _given=F.map_keys("_context"), **shared)

    def event(kind: str):
        def merged(element: Column) -> Column:
            fields = F.coalesce(F.try_variant_get(element, "$", open_map), F.create_map(F.lit("element"), element))
            return F.map_concat(F.map_filter(fields, lambda k, _: ~F.array_contains("_given", k)), F.col("_context"))

        def joined(x: Column) -> Column:
            # The record's fields as text go behind the element's, unless it has one of them itself or is no object.
            element, own = x["element"], x["own"]
            clash = F.lit(False)
            for name in ("common", "ts", "page_id"):
                clash = clash | (named(name, own) & F.try_variant_get(element, f"$.{name}", "variant").isNotNull())
            simple = F.startswith(own, F.lit('{"')) & (F.length("_shared") > 2) & ~clash
            both = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring("_shared", F.lit(2), F.length("_shared") - 1))
            return record(kind, F.when(simple, both).otherwise(text_of(merged(element))))

        if ordered:
            return F.transform(f"_{kind}s", lambda element: record(kind, text_of(merged(element))))
        texts = F.transform(f"_{kind}s", lambda element: F.struct(element.alias("element"), F.to_json(element).alias("own")))
        return F.transform(texts, joined)

    none = F.array().cast("array<struct<topic:string,value:string>>")
    started = F.col("_started")
    # What is left of a page; a record without common fields gets none.
    rest = F.map_filter(body, lambda k, v: v.isNotNull() & ~(
        ((k == "displays") & F.col("_displays").isNotNull()) | ((k == "actions") & F.col("_actions").isNotNull())))
    parts = {
        "error": F.when(present("err"), F.array(record("error", whole))),
        "start": F.when(started, F.array(record("start", whole))),
        "page": F.when(~started, F.array(record("page", F.when(holds, text_of(rest)).otherwise(whole)))),
        "display": F.when(~started, event("display")),
        "action": F.when(~started, event("action")),
    }
    made = [F.coalesce(part, none) for kind, part in parts.items() if kind in kinds]
    bad = F.array(record("bad", F.col("value"))) if "bad" in kinds else none
    records = F.when(F.col("_sound"), F.concat(*made) if made else none).otherwise(bad)
    return rows.select(F.explode(records).alias("_r")).select("_r.topic", "_r.value")


def split_log(heads: DataFrame) -> dict[str, DataFrame]:
    """The outputs of ``split_log_records`` by kind, one text column ``value`` each.

    Each reads the records and makes its own rows only: to use several, write
    ``split_log_records`` and select from that.
    """
    return {kind: split_log_records(heads, [kind]).select("value") for kind in S.LOG_TOPICS}


def page_log(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Flat page views from page records, with event time ``rt``; and the records that are none.

    Numbers may be quoted and unknown fields are passed over.
    """
    body = F.explode(F.array(F.try_parse_json(value))).alias("_body")
    rows = raw.filter(F.col(value).isNotNull()).select(value, body)
    is_object = F.startswith(F.schema_of_variant("_body"), F.lit("OBJECT"))
    good = F.col("_body").isNotNull() & F.coalesce(is_object, F.lit(False))

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("_body", f"$.{path}", kind).alias(path.split(".")[-1])

    pages = rows.filter(good).select(
        *[get(f"common.{c}") for c in ("mid", "uid", "vc", "ch", "ar", "is_new")],
        *[get(f"page.{c}") for c in ("page_id", "last_page_id", "item", "item_type")],
        get("page.during_time", "bigint"), get("ts", "bigint"),
    )
    return pages.withColumn("rt", F.timestamp_millis("ts")), rows.filter(~good).select(value)


def search_pages(df: DataFrame) -> DataFrame:
    """Pages reached by a keyword search."""
    return df.filter(
        (F.col("last_page_id") == "search")
        & F.col("item").isNotNull()
        & (F.col("item_type") == "keyword")
    )


def pages_of(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Views of the given pages."""
    return df.filter(F.col("page_id").isin(*ids))


def login_pages(df: DataFrame) -> DataFrame:
    """Views that count as a login: a known user entering directly or by the login page."""
    return df.filter(
        F.col("uid").isNotNull()
        & (F.col("last_page_id").isNull() | (F.col("last_page_id") == "login"))
    )


def traffic_measures(df: DataFrame) -> DataFrame:
    """Add ``sv`` (1 when the view starts a session) and ``pv`` (always 1)."""
    return df.withColumn(
        "sv", F.when(F.col("last_page_id").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    ).withColumn("pv", F.lit(1).cast("bigint"))
