"""Version chains, as-of resolution, amendments and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import fixed, lines, replay, text as T
from ..scale import first_per_key, last_known_in_blocks, month_block, quarter_block, sequence_in_blocks
from ..session import durable, stored
from . import structure as S


def version_chain(
    df: DataFrame, key: str, order: list[str], body: str, effective: str | None = None, block: Column | None = None
) -> DataFrame:
    """Version history per key from arriving texts.

    Repeats of a content within a key are dropped, the rest numbered in arrival order.
    With `effective` each version ends where the next one starts. Adds content_hash,
    version_id, version_number, supersedes, status (and effective_to).
    `block` slices the arrival order, by default by month of `effective`.
    """
    distinct = _distinct_texts(df, key, order, body)
    # Ids are made after the shuffle, and the neighbour only has to be there.
    distinct = distinct.withColumns({"version_id": T.sha256(F.concat_ws(":", key, "content_hash")), "_here": F.lit(True)})
    following = {"_next": "_here"}
    if effective:
        following["effective_to"] = effective
    block = block if block is not None else month_block(effective or order[0])
    chain = sequence_in_blocks(
        distinct, [key], order, block,
        number="version_number", previous={"supersedes": "version_id"}, following=following,
    )
    status = F.when(F.col("_next").isNull(), "current").otherwise("superseded")
    return chain.withColumn("status", status).drop("_next", "_here")


def _distinct_texts(df: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    # The hash is shuffled as bytes, which is half of its hexadecimal form.
    hashed = df.withColumn("content_hash", F.unhex(T.sha256(body)))
    return first_per_key(hashed, [key, "content_hash"], order).withColumn("content_hash", F.lower(F.hex("content_hash")))


def version_spans(df: DataFrame, key: str, order: list[str], body: str, effective: str, arrival: str) -> DataFrame:
    """(key, version_id, version_number, effective, effective_to) of `version_chain`, kept in the shared folder.

    What finds a version reads its history several times; here the texts are hashed and dealt once. `arrival`, the
    column that tells the arriving texts apart, is the version's id, in fewer bytes than a hash.
    """
    slim = df.select(*dict.fromkeys([key, *order, arrival, body]))
    distinct = stored(_distinct_texts(slim, key, order, body).drop("content_hash", body))
    line = sequence_in_blocks(
        distinct, [key], order, month_block(effective), number="version_number", following={"effective_to": effective}
    )
    return stored(line.select(key, F.col(arrival).alias("version_id"), "version_number", effective, "effective_to"))


def version_pairs(df: DataFrame, key: str, order: list[str], body: str, arrival: str, block: Column) -> DataFrame:
    """(key, arrival, base): every version but the first of `version_chain` and the arrival of the one it supersedes.

    `arrival` is the column that tells the arriving texts apart.
    """
    # No text and no id goes along, so that the chain is shuffled as keys.
    slim = df.select(*dict.fromkeys([key, *order, arrival, body]))
    distinct = _distinct_texts(slim, key, order, body).drop("content_hash", body)
    line = sequence_in_blocks(distinct, [key], order, block, previous={"base": arrival})
    return line.select(key, arrival, "base").filter("base IS NOT NULL")


def judgment_versions(df: DataFrame, key: str, order: list[str], body: str, block: Column) -> DataFrame:
    """Hash-deduplicated versions with the current pointer, without intervals."""
    return version_chain(df, key, order, body, None, block)


VERSION = ["version_id", "version_number", "effective_from", "effective_to"]


def _version(versions: DataFrame) -> Column:
    return F.struct(*[c for c in VERSION if c in versions.columns])


def _timeline(versions: DataFrame, key: str, disjoint: bool) -> DataFrame:
    """Rows (key, _t, _no, _mark): from `_t` on the version in `_mark.v` is in force, or none."""
    version = _version(versions)
    spans = versions.filter(
        F.col("effective_from").isNotNull()
        & (F.col("effective_to").isNull() | (F.col("effective_from") < F.col("effective_to")))
    ).select(key, version.alias("v"))
    marks = F.array(
        F.struct(F.col("v.effective_to").alias("_t"), F.lit(-1).cast("bigint").alias("_no"), F.lit(False).alias("_on")),
        F.struct(
            F.col("v.effective_from").alias("_t"), F.col("v.version_number").cast("bigint").alias("_no"),
            F.lit(True).alias("_on"),
        ),
    )
    edges = spans.select(key, "v", F.inline(marks)).filter("_t IS NOT NULL")
    in_force = F.struct(F.when(F.col("_on"), F.col("v")).alias("v"))
    simple = edges.select(key, F.col("_t").cast("timestamp").alias("_t"), "_no", in_force.alias("_mark"))
    if disjoint:
        return simple
    # Keys with overlapping intervals: the latest start among the versions in force at each edge.
    line = sequence_in_blocks(
        spans.select(key, "v", F.col("v.effective_from").alias("_from"), F.col("v.version_number").alias("_vno")),
        [key], ["_from", "_vno"], month_block("_from"), previous={"_before": "v"},
    )
    clash = F.col("_before").isNotNull() & (
        F.col("_before.effective_to").isNull() | (F.col("_before.effective_to") > F.col("_from"))
    )
    clashing = line.filter(clash).select(key).distinct()
    at_edges = edges.join(clashing, key, "left_semi").select(key, "_t").distinct()
    alive = spans.join(clashing, key, "left_semi").select(F.col(key).alias("_vk"), "v")
    covering = at_edges.join(
        alive,
        (F.col(key) == F.col("_vk"))
        & (F.col("v.effective_from") <= F.col("_t"))
        & (F.col("v.effective_to").isNull() | (F.col("_t") < F.col("v.effective_to"))),
        "left",
    )
    settled = covering.groupBy(key, "_t").agg(
        F.max_by("v", F.struct("v.effective_from", "v.version_number")).alias("v")
    )
    settled = settled.select(
        key, F.col("_t").cast("timestamp").alias("_t"), F.lit(0).cast("bigint").alias("_no"), F.struct("v").alias("_mark")
    )
    return simple.join(clashing, key, "left_anti").unionByName(settled)


def resolve_as_of(
    probes: DataFrame, versions: DataFrame, key: str = "law", at: str = "as_of", disjoint: bool = False
) -> DataFrame:
    """Attach the version in force at `at`, else the latest version of the key.

    Versions hold version_number, effective_from, effective_to and, if it is wanted, version_id. Adds those
    and `applicable`, false for the fallback. Probes and versions are merged on one time
    line in blocks of a quarter, so no key pairs all its probes with all its versions.
    `disjoint` says that no intervals of a key overlap, as in a chain ordered by date.
    """
    line = _timeline(versions, key, disjoint)
    mark_type = line.schema["_mark"].dataType
    probe = F.struct(*[F.col(c) for c in probes.columns if c != key])
    stamped = probes.select(
        F.col(key), F.col(at).cast("timestamp").alias("_t"), F.lit(2**62).cast("bigint").alias("_no"),
        F.lit(None).cast(mark_type).alias("_mark"), probe.alias("_probe"),
    )
    latest = versions.groupBy(F.col(key).alias("_lk")).agg(
        F.max_by(_version(versions), F.struct(F.col("effective_from"), F.col("version_number"))).alias("_latest")
    )
    # The latest version goes with a key's blocks, so that the probes need not be shuffled by key for it.
    merged = last_known_in_blocks(
        line.withColumn("_probe", F.lit(None).cast(stamped.schema["_probe"].dataType)).unionByName(stamped),
        [key], ["_t", "_no"], quarter_block("_t"), {"_hit": F.col("_mark")}, per_key=latest.withColumnRenamed("_lk", key),
    ).filter("_probe IS NOT NULL")
    return merged.select(
        key, "_probe.*", F.coalesce("_hit.v", "_latest").alias("_c"), F.col("_hit.v").isNotNull().alias("applicable")
    ).select(*probes.columns, "_c.*", "applicable")


def provisions_as_of(
    probes: DataFrame, versions: DataFrame, wording: DataFrame, disjoint: bool = False
) -> DataFrame:
    """Provision wording of the version each probe resolves to, in sort order columns."""
    texts = ["version_id", "node_id", "node_type", "number", "parent_article", "source_text", "sort_order"]
    # Law and number name a version in fewer bytes than its id does.
    if {"law", "version_number"} <= set(wording.columns):
        resolved = resolve_as_of(probes, versions.drop("version_id"), disjoint=disjoint)
        return resolved.join(wording.select("law", "version_number", *texts), ["law", "version_number"])
    return resolve_as_of(probes, versions, disjoint=disjoint).join(wording.select(*texts), "version_id")


def annotate_temporal(
    results: DataFrame, versions: DataFrame, ref: str, at: str, disjoint: bool = False
) -> DataFrame:
    """Applicable version and interval for law references with a query date; null for the rest."""
    keyed = results.withColumn("_law", F.when(F.col(at).isNotNull(), T.ref_law(ref)))
    versions = versions.withColumnRenamed("law", "_law").drop("version_id")
    dated = resolve_as_of(keyed.filter("_law IS NOT NULL"), versions, "_law", at, disjoint)
    dated = dated.withColumnsRenamed({
        "version_number": "applicable_version", "effective_from": "applicable_from", "effective_to": "applicable_to",
    }).drop("_law", "applicable")
    rest = keyed.filter("_law IS NULL").drop("_law")
    return dated.unionByName(rest, allowMissingColumns=True)


NODE = ["law", "node_type", "number"]


def _start() -> list[Column]:
    """The place of what is there before every event."""
    return [
        F.lit("1000-01-01").cast("date").alias("effective_date"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(0).cast("bigint").alias("_tie"), F.lit(-1).cast("bigint").alias("_no"),
    ]


#: Order of events. Those of one date and id go by their content, repeats of one content in any order.
ORDER = ["effective_date", "event_id", "_tie", "_no"]


def _told_apart(events: DataFrame) -> DataFrame:
    """Events with `_no`, which no other row has, and `_tie`, the hash of their content."""
    return stored(events.withColumns({"_tie": F.xxhash64(*events.columns), "_no": F.monotonically_increasing_id()}))


def _base_key() -> Column:
    return F.concat_ws("|", F.lit("base"), *NODE)


def _row_key(kind: Column | str, no: str) -> Column:
    return F.concat_ws("|", kind, F.col(no).cast("string"))


def _is_move() -> Column:
    return F.expr("coalesce(operation = 'RENUMBER' AND node_type IS NOT NULL AND number IS NOT NULL AND renumber_to <> number, false)")


def identify(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(_no, identity): the provision each event names, null where its number stands for none at that time.

    A provision is known under its first number until it is renumbered, then under the next; whoever took a number last
    has it, and a number whose provision has left it is free. INSERT on a free number makes a new provision.

    Only numbers that a renumbering leaves or takes need a time line. Whether a renumbering finds a provision
    depends on earlier ones: all are taken for granted at first, and those that find none are taken out until none is left,
    each time on the numbers that the last ones change. What
    an event finds then points to what was found there before, and the pointers are followed two steps at a time.
    """
    named = events.filter(F.col("operation").isin(fixed.AMENDMENT_OPERATIONS) & F.col("node_type").isNotNull() & F.col("number").isNotNull())
    moves = named.filter(_is_move())
    source, target = moves.select(*NODE), moves.select("law", "node_type", F.col("renumber_to").alias("number"))
    touched = stored(source.union(target).distinct())
    base = nodes.select(*NODE).distinct()
    order = F.struct(*ORDER)

    # Numbers no renumbering touches: the provision is there from the start, or from the first INSERT on.
    plain = named.join(touched, NODE, "left_anti")
    first = plain.filter("operation = 'INSERT'").groupBy(*NODE).agg(F.min(order).alias("_first"))
    plain = plain.join(base.withColumn("_base", F.lit(True)), NODE, "left").join(first, NODE, "left")
    there = F.col("_base").isNotNull() | (F.col("_first") <= order)
    plain = plain.select("_no", F.when(there, _base_key()).alias("identity"))

    def row(kind: Column, of: DataFrame, number: str = "number") -> DataFrame:
        return of.select("law", "node_type", F.col(number).alias("number"), *ORDER, kind.alias("kind"))

    rest = named.filter(~_is_move()).join(touched, NODE, "left_semi")
    line = row(F.lit("A"), base.join(touched, NODE, "left_semi").select("*", *_start())).union(row(F.lit("O"), moves))
    line = line.union(row(F.lit("N"), moves, "renumber_to"))
    line = stored(line.union(row(F.when(F.col("operation") == "INSERT", "I").otherwise("P"), rest)))

    def settled(rows: DataFrame) -> DataFrame:
        """(NODE, kind, _no, found): what stands under the number of each row before it; a renumbering that is `_void` does nothing."""
        holds = (F.col("kind") != "P") & F.col("_void").isNull()
        out = last_known_in_blocks(
            rows, NODE, ORDER, month_block("effective_date"), {"last": F.when(holds, F.struct("kind", "_no"))}, include_current=False,
        )
        found = F.when(F.col("last.kind") == "A", _base_key()).when(F.col("last.kind") != "O", _row_key("last.kind", "last._no"))
        return out.select(*NODE, "kind", "_no", found.alias("found"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(void.select("_no", F.lit(True).alias("_void")), "_no", "left")

    def finding_none(rows: DataFrame) -> DataFrame:
        return settled(rows).filter("kind = 'O' AND found IS NULL").select("_no", *NODE)

    # The rounds need what holds a number, and only of numbers that a renumbering asks for.
    holders = line.filter("kind <> 'P'").join(line.filter("kind = 'O'").select(*NODE).distinct(), NODE, "left_semi")
    holders, unmarked = stored(holders), F.lit(None).cast("boolean")
    void = changed = stored(finding_none(holders.withColumn("_void", unmarked)))
    while not changed.isEmpty():
        ends = line.filter("kind IN ('O', 'N')").join(changed.select("_no"), "_no", "left_semi").select(*NODE).distinct()
        ends = stored(ends)
        again = finding_none(marked(holders.join(ends, NODE, "left_semi")))
        now = stored(void.join(ends, NODE, "left_anti").unionByName(again))
        changed = stored(now.join(void, "_no", "left_anti").unionByName(void.join(now, "_no", "left_anti")))
        void = now
    # Both parts come straight from the table. Parts that are dealt by the same columns must not be put together like this:
    # Spark 4.1 takes their union for dealt by them too, though adaptive execution may have cut the parts in different places.
    others = line.filter("kind NOT IN ('O', 'N')").withColumn("_void", unmarked)
    whole = others.unionByName(marked(line.filter("kind IN ('O', 'N')")))
    found = stored(settled(whole).filter("kind <> 'A'").select("kind", "_no", "found"))

    # What a key stands for: an INSERT on a held number and a renumbering stand for what they found.
    left = found.filter("kind = 'O' AND found IS NOT NULL").select(_row_key(F.lit("N"), "_no").alias("key"), F.col("found").alias("to"))
    held = found.filter("kind = 'I' AND found IS NOT NULL").select(_row_key("kind", "_no").alias("key"), F.col("found").alias("to"))
    pointers = stored(left.unionByName(held))
    while True:
        further = pointers.select(F.col("key").alias("to"), F.col("to").alias("next"))
        moved = stored(pointers.join(further, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        pointers = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    asked = found.filter("kind <> 'N'")
    asked = asked.withColumn("found", F.when(F.col("kind") == "I", F.coalesce("found", _row_key("kind", "_no"))).otherwise(F.col("found")))
    asked = asked.join(pointers.withColumnsRenamed({"key": "found", "to": "root"}), "found", "left")
    return plain.unionByName(asked.select("_no", F.coalesce("root", "found").alias("identity")))


def number_amendments(events: DataFrame, laws: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split amendment events into (accepted, rejected); accepted ones carry the `identity` of the provision they name.

    Events need law, event_id, operation, effective_date and node_type/number/new_text/renumber_to.
    Rejected: unknown operation, unknown law, node type without number, a number no provision has
    then (INSERT makes one), anything after a REPEAL. Order is (effective_date, event_id), then by content; every row is
    an event of its own, also where several of a law have one id.
    """
    accepted, rejected = _numbered(_told_apart(events), laws, nodes)
    return accepted.drop("_tie", "_no"), rejected.drop("_tie", "_no")


def _numbered(events: DataFrame, laws: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`number_amendments` of events told apart."""
    known = F.col("operation").isin(fixed.AMENDMENT_OPERATIONS)
    has_node = F.col("node_type").isNotNull()
    order = F.struct(*ORDER)
    checked = events.join(stored(identify(events, nodes)), "_no", "left")
    checked = checked.join(laws.select("law", F.lit(True).alias("_law")).distinct(), "law", "left")
    reason = (
        F.when(~known, "unknown operation")
        .when(F.col("_law").isNull(), "legislation not found")
        .when(has_node & F.col("number").isNull(), "node number required")
        .when(has_node & F.col("identity").isNull(), "provision not found")
    )
    checked = checked.withColumn("reason", reason)
    repeal = checked.filter("reason IS NULL AND operation = 'REPEAL'").groupBy("law").agg(F.min(order).alias("_repeal"))
    checked = checked.join(repeal, "law", "left").withColumn(
        "reason", F.coalesce("reason", F.when(order > F.col("_repeal"), "no current version"))
    )
    accepted = checked.filter("reason IS NULL").select(*events.columns, "identity")
    return accepted, checked.filter("reason IS NOT NULL").select(*events.columns, "reason")


#: What the events and provisions of a law may take, each with ROW_BYTES besides its text, to be replayed in one task.
LAW_BYTES, ROW_BYTES = 32 << 20, 256
#: Groups of laws that are weighed first: only those of heavy groups are weighed one by one.
LAW_GROUPS = 1 << 14


def _large_laws(wording: DataFrame, events: DataFrame) -> DataFrame | None:
    """(law) of the laws that weigh over LAW_BYTES, or none."""

    def weights(df: DataFrame, text: str) -> DataFrame:
        group = F.pmod(F.xxhash64("law"), F.lit(LAW_GROUPS)).alias("_group")
        return df.select("law", group, (F.lit(ROW_BYTES) + F.coalesce(F.octet_length(text), F.lit(0))).cast("bigint").alias("_w"))

    def heavy(df: DataFrame, by: str) -> DataFrame:
        return stored(df.groupBy(by).agg(F.sum("_w").alias("_w")).filter(F.col("_w") > LAW_BYTES).select(by))

    rows = weights(events, "new_text").union(weights(wording, "source_text"))
    groups = heavy(rows, "_group")
    if groups.isEmpty():
        return None
    large = heavy(rows.join(groups, "_group", "left_semi").filter("law IS NOT NULL"), "law")
    return None if large.isEmpty() else large


def apply_amendments(laws: DataFrame, wording: DataFrame, events: DataFrame) -> DataFrame:
    """One row per accepted event: the version it makes, the provision it changes and the text it replaces.

    `laws` holds law, version_number (the version amended first). `wording` holds the
    base text per (law, node_type, number). REPLACE needs a live provision, DELETE leaves a
    tombstone, INSERT adds or revives, RENUMBER gives the same provision another number, COMMENCE/REPEAL carry
    every text unchanged. `next_change` is the version that next changes the text or number of the provision that
    this one has changed or renumbered.

    Events are shuffled once, by law, and each law is replayed in its order. Laws that are large go in blocks.
    """
    large = _large_laws(wording, events)
    if large is None:
        return _replayed(laws, wording, events)
    small, parts = [], []
    for df in (laws, wording, events):
        small.append(df.join(large, "law", "left_anti"))
        parts.append(df.join(large, "law", "left_semi"))
    return _replayed(*small).unionByName(_applied_in_blocks(*parts))


def _replayed(laws: DataFrame, wording: DataFrame, events: DataFrame) -> DataFrame:
    """`apply_amendments` of laws of which each fits a task."""
    rows = events.withColumns({"_kind": F.lit(replay.EVENT), "_base_no": F.lit(None).cast("bigint")})
    others = [
        laws.select("law", F.lit(replay.LAW).alias("_kind"), F.col("version_number").cast("bigint").alias("_base_no")),
        wording.select("law", F.lit(replay.PROVISION).alias("_kind"), "node_type", "number", F.col("source_text").alias("new_text")),
    ]
    for df in others:
        rows = rows.unionByName(df, allowMissingColumns=True)
    # No law, no version. The hash that orders events of one date and id is made after the shuffle.
    whole = rows.filter("law IS NOT NULL").repartition("law")
    whole = whole.sortWithinPartitions("law", "_kind", "effective_date", "event_id", F.xxhash64(*events.columns))
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    day = kind["effective_date"]
    made = replay.replayed(whole, StructType.fromDDL(
        f"law {kind['law']}, event_id {kind['event_id']}, operation string, node_type string, number string, renumber_to string, "
        f"identity string, effective_from {day}, effective_to {day}, previous_text string, new_text string, text_after string, "
        "changed boolean, version_number bigint, next_change bigint"
    ))
    return _with_status(made)


def _with_status(made: DataFrame) -> DataFrame:
    status = F.when(F.col("operation") == "REPEAL", "repealed").when(F.col("effective_to").isNull(), "current").otherwise(
        "superseded"
    )
    return made.select(
        "law", "version_number", "event_id", "operation", "node_type", "number", "renumber_to", "identity", "effective_from",
        "effective_to", status.alias("status"), "previous_text", "new_text", "text_after", "changed", "next_change",
    )


def _is_change() -> Column:
    """Whether a row of `apply_amendments` gives its provision another text or number."""
    renumbered = (F.col("operation") == "RENUMBER") & F.col("identity").isNotNull() & (F.col("renumber_to") != F.col("number"))
    return F.coalesce(F.col("changed") | renumbered, F.lit(False))


def _applied_in_blocks(laws: DataFrame, wording: DataFrame, events: DataFrame) -> DataFrame:
    """`apply_amendments` where no task holds a whole law."""
    accepted, _ = _numbered(_told_apart(events), laws, wording)
    numbered = sequence_in_blocks(
        accepted, ["law"], ORDER, month_block("effective_date"),
        number="_n", following={"effective_to": "effective_date"},
    )
    base = laws.select("law", F.col("version_number").alias("_base_no"))
    numbered = numbered.join(base, "law").withColumn("version_number", F.col("_n") + F.col("_base_no"))
    numbered = durable(numbered)

    # One time line per provision: its base text first, then its events.
    node = ["law", "identity"]
    start = wording.select(
        "law", _base_key().alias("identity"), F.lit("BASE").alias("operation"), F.col("source_text").alias("new_text"), *_start()
    )
    touched = numbered.filter("identity IS NOT NULL")
    steps = start.join(touched.select(*node).distinct(), node, "left_semi").unionByName(
        touched.select(*start.columns)
    )
    step = F.struct(*ORDER, "operation", "new_text")
    state = last_known_in_blocks(
        steps, node, ORDER, month_block("effective_date"),
        {
            "_life": F.when(F.col("operation").isin("BASE", "INSERT", "DELETE"), step),
            "_replace": F.when(F.col("operation") == "REPLACE", step),
        },
        include_current=False,
    )
    # A replacement counts only if it came after the provision was last added.
    newer = F.struct(*[f"_replace.{c}" for c in ORDER]) > F.struct(*[f"_life.{c}" for c in ORDER])
    alive = F.coalesce(F.col("_life.operation") != "DELETE", F.lit(False))
    before = F.when(alive, F.when(newer, F.col("_replace.new_text")).otherwise(F.col("_life.new_text")))
    op = F.col("operation")
    changed = op.isin("INSERT", "DELETE") | ((op == "REPLACE") & alive)
    texts = state.filter("operation <> 'BASE'").select(
        "_no", before.alias("previous_text"), changed.alias("changed"),
        F.when(op == "DELETE", F.lit(None)).when(changed, F.col("new_text")).otherwise(before).alias("text_after"),
    )
    out = numbered.join(texts, "_no", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    out = sequence_in_blocks(
        out.withColumn("_change", _is_change()), ["law", "node_type", "identity", "_change"], ["version_number"],
        F.floor(F.col("version_number") / 4096), following={"next_change": "version_number"},
    )
    out = out.withColumn("next_change", F.when(F.col("_change"), F.col("next_change")))
    return _with_status(out.withColumnRenamed("effective_date", "effective_from"))


def amended_wording(laws: DataFrame, wording: DataFrame, amended: DataFrame) -> DataFrame:
    """Number and text of each provision as version ranges: from_version inclusive, to_version exclusive or null.

    Compact form of carrying every provision into every version. A renumbered provision keeps its `identity`.
    A change tells its next one, so that no text of `amended` is shuffled; a base text ends with the first change of its provision.
    """
    node = ["law", "node_type", "identity"]
    base = wording.join(laws.select("law", F.col("version_number").alias("from_version")), "law").select(
        "law", "node_type", _base_key().alias("identity"), "number", "from_version", F.col("source_text").alias("text")
    )
    number = F.when(F.col("operation") == "RENUMBER", F.col("renumber_to")).otherwise(F.col("number")).alias("number")
    # Read twice, and written in the order of the laws, which makes it small.
    moved = stored(amended.filter(_is_change()).select(
        *node, number, F.col("version_number").alias("from_version"), F.col("text_after").alias("text"),
        F.col("next_change").alias("to_version"),
    ))
    first = moved.filter(F.col("identity").startswith("base|")).groupBy(*node).agg(F.min("from_version").alias("to_version"))
    return base.join(first, node, "left").unionByName(moved).filter("text IS NOT NULL")


def amendment_history(events: DataFrame, law: str | None = None) -> DataFrame:
    """Events by law and effective date; one law only if given."""
    rows = events if law is None else events.filter(F.col("law") == law)
    return rows.orderBy("law", "effective_date", "event_id")


def diff_versions(pairs: DataFrame, wording: DataFrame) -> DataFrame:
    """Provisions whose text differs between two versions, with the lines only one side has, in order, repeats kept.

    `pairs` holds pair_id, base_id, target_id. The lines are those of a shortest line difference (see `lines`).
    """
    texts = wording.select("version_id", "node_id", "source_text")
    base = pairs.select("pair_id", F.col("base_id").alias("version_id")).join(texts, "version_id").select(
        "pair_id", "node_id", F.col("source_text").alias("old_text")
    )
    target = pairs.select("pair_id", F.col("target_id").alias("version_id")).join(texts, "version_id").select(
        "pair_id", "node_id", F.col("source_text").alias("new_text")
    )
    return _with_lines(base.join(target, ["pair_id", "node_id"], "full_outer"))


def _with_lines(both: DataFrame) -> DataFrame:
    both = both.filter(~F.col("old_text").eqNullSafe(F.col("new_text")))
    empty = F.array().cast("array<string>")
    both = both.withColumns({"_old": F.coalesce(T.lines("old_text"), empty), "_new": F.coalesce(T.lines("new_text"), empty)})
    return lines.with_changes(both, "_old", "_new").drop("_old", "_new")


def diff_texts(pairs: DataFrame, texts: DataFrame, key: str, arrival: str, body: str) -> DataFrame:
    """`diff_versions` of each pair of `version_pairs`, from the whole texts; pair_id is the version_id of the newer one.

    Both texts of a pair meet in one row and are split there, and the provisions are matched where the row is: a text
    is shuffled as a whole, without ids, and what it is split into is not shuffled at all.
    """
    whole = texts.select(arrival, body)
    newer = pairs.join(whole, arrival).withColumnRenamed(body, "_new")
    older = whole.withColumnsRenamed({arrival: "base", body: "_old"})
    both = newer.join(older, "base").withColumn("pair_id", T.sha256(F.concat_ws(":", key, T.sha256("_new"))))
    both = S.with_provisions(S.with_provisions(both, "_old", "_olds"), "_new", "_news")

    fields = ["node_type", "number", "parent_article", "source_text"]
    empty = F.array().cast(f"array<struct<old:boolean,{','.join(f'{c}:string' for c in fields)}>>")

    def side(name: str, old: bool) -> Column:
        # A null text has no provisions.
        return F.coalesce(F.transform(name, lambda x: F.struct(F.lit(old).alias("old"), *[x[c].alias(c) for c in fields])), empty)

    rows = both.select("base", arrival, "pair_id", key, F.inline(F.concat(side("_olds", True), side("_news", False))))
    # Grouped by `base` first, which the join has put together.
    node = rows.groupBy("base", arrival, "pair_id", key, "node_type", "number", "parent_article").agg(
        F.collect_list(F.when(F.col("old"), F.struct("source_text"))).alias("_olds"),
        F.collect_list(F.when(~F.col("old"), F.struct("source_text"))).alias("_news"),
    )
    none = F.array(F.lit(None).cast("struct<source_text:string>"))

    def there(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name)).otherwise(none)

    name = S.node_key(key, F.col("node_type"), F.col("parent_article"), F.col("number")).alias("node_id")
    node = node.select("pair_id", name, there("_news").alias("_news"), F.explode(there("_olds")).alias("_o"))
    node = node.select("pair_id", "node_id", "_o", F.explode("_news").alias("_n"))
    texts_of = [F.col("_o.source_text").alias("old_text"), F.col("_n.source_text").alias("new_text")]
    return _with_lines(node.select("pair_id", "node_id", *texts_of))


def line_changes(diff: DataFrame) -> DataFrame:
    """A row per changed line of `diff_versions`: `sign` (- or +), `line_no` (0-based, in the old or new text), `line`, in hunk order `n`."""
    rows = diff.select("pair_id", "node_id", F.posexplode("changes").alias("n", "c"))
    return rows.select("pair_id", "node_id", "n", "c.sign", "c.line_no", "c.line")


def changed_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("pair_id").agg(F.count(F.lit(1)).alias("changed_nodes"))
