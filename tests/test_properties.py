"""Distributed forms against plain Python on random small inputs, with one dominant key."""

import datetime as dt
import random
import re
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lexweave import scale
from lexweave.functions import fixed
from lexweave.operators import retrieval as R, structure, temporal as X
from lexweave.session import shared_folder


def skewed(n, seed, keys=6):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}", i, rng.randrange(100)) for i in range(n)], rng


def test_sequence_in_blocks(spark):
    data, _ = skewed(500, 1)
    df = spark.createDataFrame(data, ["k", "pos", "v"])
    out = scale.sequence_in_blocks(df, ["k"], ["pos"], F.floor(F.col("pos") / 7), number="n", totals={"t": F.col("v")},
                                   previous={"p": "v"}, following={"f": "v"}).collect()
    want = set()
    for key in {d[0] for d in data}:
        mine = [d for d in data if d[0] == key]
        total = 0
        for i, (_, pos, v) in enumerate(mine):
            total += v
            want.add((key, pos, v, i + 1, total, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None))
    assert {tuple(r) for r in out} == want


def test_last_known_in_blocks(spark):
    data, rng = skewed(400, 2)
    data = [(k, p, v if rng.random() < 0.2 else None) for k, p, v in data]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    for current in (True, False):
        out = scale.last_known_in_blocks(df, ["k"], ["pos"], F.floor(F.col("pos") / 9), {"l": F.col("v")}, current).collect()
        last, want = {}, set()
        for k, p, v in data:
            before = last.get(k)
            last[k] = v if v is not None else before
            want.add((k, p, v, last[k] if current else before))
        assert {tuple(r) for r in out} == want


def test_adverse_authorities_of_one_matter_are_many_tasks(spark, monkeypatch):
    """All queries and authorities of a matter meet; no task makes more than a share of the pairs."""
    from lexweave.operators import graph

    monkeypatch.setattr(scale, "TILE_ROWS", 8)
    monkeypatch.setattr(scale, "TASK_PAIRS", 500)
    rng = random.Random(31)
    results = [(q, 0 if rng.random() < 0.8 else rng.randrange(1, 5), f"r{q % 7}", None) for q in range(120)] * 2
    matter = [(0 if rng.random() < 0.8 else rng.randrange(1, 6), f"doc-{i % 50}", "adverse" if i % 3 else "supporting", f"issue {i % 2}") for i in range(150)] * 2
    made = graph.adverse_authorities(
        spark.createDataFrame(results, "query_id long, matter_id long, canonical_ref string, case_key string"),
        spark.createDataFrame([], "source_key string, treatment string, review_status string"),
        spark.createDataFrame(matter, "matter_id long, canonical_ref string, classification string, matter_issue string"),
    )
    want = sorted((q, ref, issue) for q, m in {r[:2] for r in results} for n, ref, kind, issue in matter if n == m and kind == "adverse")
    got = made.withColumn("_task", F.spark_partition_id()).collect()
    assert sorted((r.query_id, r.canonical_ref, r.basis) for r in got) == want and len(want) > 15_000
    tasks = [r._task for r in got]
    assert max(map(tasks.count, set(tasks))) < len(want) / 8


def test_as_of_with_overlaps(spark):
    rng = random.Random(3)
    day0 = dt.date(2000, 1, 1)
    versions = []
    for key in ("hot", "a", "b"):
        for n in range(1, 12):
            start = day0 + dt.timedelta(days=rng.randrange(400))
            end = None if rng.random() < 0.2 else start + dt.timedelta(days=rng.randrange(-20, 200))
            versions.append((key, f"{key}{n}", n, start, end))
    probes = [(key, i, day0 + dt.timedelta(days=rng.randrange(-30, 700))) for i in range(200) for key in ("hot", "a", "b")]
    out = X.resolve_as_of(spark.createDataFrame(probes, ["law", "id", "as_of"]), spark.createDataFrame(
        versions, "law string, version_id string, version_number int, effective_from date, effective_to date")).collect()
    got = {(r.law, r.id): (r.version_id, r.applicable) for r in out}
    for key, i, day in probes:
        mine = sorted((v for v in versions if v[0] == key), key=lambda v: (v[3], v[2]))
        inside = [v for v in mine if v[3] <= day and (v[4] is None or day < v[4])]
        assert got[(key, i)] == ((inside or mine)[-1][1], bool(inside))


def test_version_intervals_never_overlap(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else "x", i, dt.date(2000, 1, 1) + dt.timedelta(days=i * 3), f"text {rng.randrange(40)}") for i in range(200)]
    out = X.version_chain(spark.createDataFrame(rows, ["law", "n", "day", "body"]), "law", ["day", "n"], "body", "day").collect()
    for key in ("hot", "x"):
        mine = sorted((r for r in out if r.law == key), key=lambda r: r.version_number)
        assert [r.version_number for r in mine] == list(range(1, len(mine) + 1))
        assert len({r.content_hash for r in mine}) == len(mine)
        assert all(a.effective_to == b.day and b.supersedes == a.version_id for a, b in zip(mine, mine[1:]))
        assert mine[-1].effective_to is None and mine[-1].status == "current"


EVENT = "law string, event_id long, operation string, effective_date date, node_type string, number string, new_text string, renumber_to string"


def amended(spark, base, events):
    laws = spark.createDataFrame(sorted({(b[0], 1) for b in base}), ["law", "version_number"])
    wording = spark.createDataFrame(base, ["law", "node_type", "number", "source_text"])
    rows = spark.createDataFrame(events, EVENT)
    made = X.apply_amendments(laws, wording, rows)
    return made.collect(), X.amended_wording(laws, wording, made).collect(), X.number_amendments(rows, laws, wording)[1].collect()


def test_amendments_one_by_one(spark):
    """Random events, renumberings onto free, taken and left numbers among them, against a replay of one law at a time."""
    rng = random.Random(5)
    base = [(law, "ARTICLE", str(n), f"base {n}") for law in "LM" for n in range(4)]
    ops = ["REPLACE", "DELETE", "INSERT", "RENUMBER", "RENUMBER", "COMMENCE"]
    events = []
    for i in range(240):
        op = rng.choice(ops)
        node = (None, None) if op == "COMMENCE" else ("ARTICLE", str(rng.randrange(7)))
        events.append((rng.choice("LM"), i, op, dt.date(2001, 1, 1) + dt.timedelta(days=i // 2), *node, f"text {i}", str(rng.randrange(9)) if op == "RENUMBER" else None))
    made, ranges, refused = amended(spark, base, events)
    got = {r.event_id: (r.version_number, r.previous_text, r.text_after) for r in made}
    want, spans, missing = {}, set(), set()
    for law in "LM":
        at, text, version = {}, {}, 1
        open_: dict = {}

        def say(who, number, now, law=law, open_=open_, text=text):
            if who in open_:
                spans.add((law, *open_.pop(who), now))
            if text[who] is not None:
                open_[who] = (number, text[who], now)

        for _, _, n, t in (b for b in base if b[0] == law):
            at[n], text[n] = n, t
            say(n, n, 1)
        for _, i, op, _, kind, n, new, to in (e for e in events if e[0] == law):
            who = at.get(n)
            if kind and who is None and op != "INSERT":
                missing.add(i)
                continue
            version += 1
            if who is None and op == "INSERT":
                who = at[n] = f"e{i}"
                text[who] = None
            before = text.get(who)
            if op == "INSERT" or (op == "REPLACE" and before is not None):
                text[who] = new
                say(who, n, version)
            elif op == "DELETE":
                text[who] = None
                say(who, n, version)
            elif op == "RENUMBER" and to != n:
                del at[n]
                at[to] = who
                say(who, to, version)
            want[i] = (version, before, text.get(who))
        spans |= {(law, number, t, since, None) for number, t, since in open_.values()}
    assert got == want
    assert {r.event_id for r in refused} == missing and missing
    assert {(r.law, r.number, r.text, r.from_version, r.to_version) for r in ranges} == {(a, n, t, s, e) for a, n, t, s, e in spans}


def test_renumbered_provision_is_found(spark):
    base = [("L", "ARTICLE", "5", "old")]
    days = [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]
    made, ranges, refused = amended(spark, base, [
        ("L", 1, "RENUMBER", days[0], "ARTICLE", "5", None, "50"), ("L", 2, "REPLACE", days[1], "ARTICLE", "50", "new", None)])
    assert refused == [] and {(r.from_version, r.number, r.text, r.to_version) for r in ranges} == {(1, "5", "old", 2), (2, "50", "old", 3), (3, "50", "new", None)}


def test_as_of_needs_no_version_id(spark):
    """Without ids the same versions are found; a probe without a day gets the latest one."""
    day = [dt.date(2000 + i, 1, 1) for i in range(4)]
    versions = spark.createDataFrame([("L", "a", 1, day[0], day[1]), ("L", "b", 2, day[1], None), ("M", "c", 1, day[2], None)],
                                     "law string, version_id string, version_number int, effective_from date, effective_to date")
    probes = spark.createDataFrame([(0, "L", day[0]), (1, "L", day[3]), (2, "L", None), (3, "M", day[0]), (4, "N", day[0])], "p int, law string, as_of date")
    with_id = X.resolve_as_of(probes, versions)
    got = X.resolve_as_of(probes, versions.drop("version_id"))
    assert got.columns == [c for c in with_id.columns if c != "version_id"]
    assert sorted((r.p, r.version_number, r.applicable) for r in got.collect()) == [(0, 1, True), (1, 2, True), (2, 2, False), (3, 1, False), (4, None, False)]
    assert {r.p: r.version_id for r in with_id.collect()} == {0: "a", 1: "b", 2: "b", 3: "c", 4: None}


def test_events_of_one_id_are_events_of_their_own(spark):
    base = [("L", "ARTICLE", "5", "old")]
    days = [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]
    twice = [("L", 1, "REPLACE", days[0], "ARTICLE", "5", "new", None)] * 2
    made, ranges, refused = amended(spark, base, [*twice, ("L", 1, "REPLACE", days[1], "ARTICLE", "5", "newer", None), ("L", 1, "DELETE", days[1], "ARTICLE", "6", None, None)])
    assert sorted((r.version_number, r.previous_text, r.text_after) for r in made) == [(2, "old", "new"), (3, "new", "new"), (4, "new", "newer")]
    assert sorted((r.from_version, r.to_version or 0, r.text) for r in ranges) == [(1, 2, "old"), (2, 3, "new"), (3, 4, "new"), (4, 0, "newer")]
    assert [r.reason for r in refused] == ["provision not found"]


def odd_amendments(n, seed):
    """Random events of laws of many sizes, with unknown and missing operations, laws, numbers and targets, repeats and repeals."""
    rng = random.Random(seed)
    laws = ["big", "big", "big", *"ABCD", "not there", None]
    base = [(law, kind, str(i), f"base {i}" if i else None) for law in ("big", *"ABCDE") for kind in ("ARTICLE", "PART") for i in range(3)]
    operations = ["REPLACE", "REPLACE", "DELETE", "INSERT", "RENUMBER", "RENUMBER", "RENUMBER", "COMMENCE", "ANNOTATE", None]
    events = []
    for i in range(n):
        op = "REPEAL" if rng.random() < 0.004 else rng.choice(operations)
        kind = rng.choice(["ARTICLE", "ARTICLE", "PART", None])
        number = None if rng.random() < 0.05 else str(rng.randrange(6))
        to = None if rng.random() < 0.1 else str(rng.randrange(8))
        events.append((rng.choice(laws), i // 2, op, dt.date(2001, 1, 1) + dt.timedelta(days=rng.randrange(300)), kind, number, f"text {i}" if i % 9 else None, to))
    return base, events + events[:20]


def test_large_laws_are_amended_in_blocks(spark, monkeypatch):
    """Whole laws in a task and laws in blocks give the same versions, texts and ranges; identities are names only."""
    base, events = odd_amendments(500, 51)
    whole = amended(spark, base, events)
    for most in (0, 100 * X.ROW_BYTES):
        monkeypatch.setattr(X, "LAW_BYTES", most)
        monkeypatch.setattr(X, "LAW_GROUPS", 4)
        blocks = amended(spark, base, events)
        for one, other in zip(whole, blocks, strict=True):
            plain = [sorted(repr({k: v for k, v in r.asDict().items() if k != "identity"}) for r in rows) for rows in (one, other)]
            assert plain[0] == plain[1] and len(plain[0]) > 30
        names = {(r.law, r.version_number): r.identity for r in whole[0]}
        pairs = {(r.law, names[r.law, r.version_number], r.identity) for r in blocks[0]}
        assert len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}) == len(pairs)


def test_laws_are_weighed_by_rows_and_texts(spark, monkeypatch):
    laws = [("many", "x")] * 40 + [("long", "x" * 9000)] + [("small", "x")] * 3 + [(None, "x")] * 50
    events = spark.createDataFrame(laws, "law string, new_text string")
    wording = spark.createDataFrame([("wide", "x")] * 40, "law string, source_text string")
    monkeypatch.setattr(X, "LAW_BYTES", 30 * X.ROW_BYTES)
    assert {r.law for r in X._large_laws(wording, events).collect()} == {"many", "long", "wide"}
    monkeypatch.setattr(X, "LAW_BYTES", 60 * X.ROW_BYTES)
    assert X._large_laws(wording, events) is None


def test_amendments_shuffle_events_once(spark):
    import __spark_entry__ as entry

    for name, most in (("apply_amendments", 1), ("amended_wording", 4)):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        below = plan.optimizedPlan().toString()
        assert plan.sparkPlan().toString().count("Exchange") <= 1 and below.count("Window") == 0
        assert plan.executedPlan().toString().count("Exchange hashpartitioning") + plan.executedPlan().toString().count("BroadcastExchange") <= most


def test_line_differences(spark):
    from lexweave.functions import lines

    rng = random.Random(21)
    for _ in range(400):
        a, b = (rng.choices("abcde", k=rng.randrange(0, 14)) for _ in range(2))
        gone, come = lines.changed_lines(a, b)
        assert [x for i, x in enumerate(a) if i not in gone] == [x for i, x in enumerate(b) if i not in come]
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert len(gone) == len(a) - longest[-1][-1] and len(come) == len(b) - longest[-1][-1]
        # The hunks in order turn the old lines into the new ones.
        out, at = [], 0
        for c in lines.hunks(a, b):
            keep = (c["line_no"] - at) if c["sign"] == "-" else (c["line_no"] - len(out))
            out += a[at : at + keep]
            at += keep
            if c["sign"] == "-":
                at += 1
            else:
                out.append(c["line"])
        assert out + a[at:] == b
    texts = spark.createDataFrame([("1", "n", "x\nx\ny"), ("2", "n", "x\ny"), ("1", "m", "only\nold"), ("2", "k", None)], "version_id string, node_id string, source_text string")
    pairs = spark.createDataFrame([("p", "1", "2")], ["pair_id", "base_id", "target_id"])
    diff = X.diff_versions(pairs, texts)
    assert {(r.node_id, tuple(r.removed_lines), tuple(r.added_lines)) for r in diff.collect()} == {("n", ("x",), ()), ("m", ("only", "old"), ())}
    assert sorted((r.node_id, r.sign, r.line) for r in X.line_changes(diff).collect()) == [("m", "-", "old"), ("m", "-", "only"), ("n", "-", "x")]


def test_text_pairs_are_split_where_they_meet(spark):
    """The diff of whole texts against the diff of their provisions, headings that come twice among them."""
    rng = random.Random(12)
    heads = ["Article 1", "Article 2", "Article 3", "Article 2"]

    def text():
        return "\n".join(x for h in heads if rng.random() < 0.8 for x in [h, *[f"(1)para {rng.randrange(2)}", f"body {rng.randrange(2)}"][: rng.randrange(3)]])

    rows = [("hot" if rng.random() < 0.5 else "x", i, dt.date(2000, 1, 1) + dt.timedelta(days=i * 20), text()) for i in range(60)]
    texts = spark.createDataFrame([*rows, ("x", 60, dt.date(2010, 1, 1), None)], ["law", "n", "day", "body"])
    chain = X.version_chain(texts, "law", ["day", "n"], "body", "day")
    named = structure.with_node_ids(structure.split_provisions(chain, "body"))
    old = chain.filter("supersedes IS NOT NULL").select(F.col("version_id").alias("pair_id"), F.col("supersedes").alias("base_id"), F.col("version_id").alias("target_id"))
    want = X.diff_versions(old, named).collect()
    made = X.diff_texts(X.version_pairs(texts, "law", ["day", "n"], "body", "n", scale.month_block("day")), texts, "law", "n", "body")

    def plain(rows):
        return sorted(map(repr, ((r.pair_id, r.node_id, r.old_text, r.new_text, [tuple(c) for c in r.changes]) for r in rows)))

    assert len(want) > 50 and plain(made.collect()) == plain(want)


def test_spread_bounds_the_rows_of_a_task(spark):
    one = spark.range(1000).coalesce(1)
    assert scale.spread(one, 10).rdd.getNumPartitions() == 100
    assert scale.spread(one.groupBy("id").count(), 10).rdd.getNumPartitions() == 100
    many = spark.range(0, 1000, 1, 200)
    assert scale.spread(many, 10) is many


def test_provision_nodes_shuffle_no_ids(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["provision_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not any("node_id" in x for x in dealt)


def test_tree_expand_orders_laws_not_provisions(spark):
    rng = random.Random(15)
    laws = ["N-1", "N-10", "N-100", "N-11", "N-2", "Ν-7", "none"]
    nodes = [("legislation_node", law, f"law-{law}-art-{i}") for law in laws[:-1] for i in range(300 if law == "N-10" else rng.randrange(4))]
    named = [(q, f"law-{rng.choice(laws)}-art-1") for q in range(5) for _ in range(4)] + [(9, "judgment-x")]
    entries = spark.createDataFrame(nodes, ["kind", "ref_law", "canonical_ref"])
    out = R.tree_expand(spark.createDataFrame(named, ["query_id", "canonical_ref"]), entries)
    want = set()
    for q in range(5):
        mine = {ref[4:-6] for i, ref in named if i == q}
        want |= {(q, ref, n + 1) for n, (_, ref) in enumerate(sorted((law, ref) for _, law, ref in nodes if law in mine))}
    assert {tuple(r) for r in out.collect()} == want
    ordered = re.findall(r"windowspecdefinition\(query_id#[^)]*\)", out._jdf.queryExecution().optimizedPlan().toString())
    assert ordered and not any("canonical_ref" in x for x in ordered)


def test_rejected_amendments_write_little(spark):
    """What is kept between the steps is small beside the events, which a plain checkpoint writes whole."""
    rng = random.Random(14)
    base = [("L", "ARTICLE", str(n), "base") for n in range(5)]
    events = [("L", i, rng.choice(["RENUMBER", "REPLACE", "INSERT"]), dt.date(2000, 1, 1) + dt.timedelta(days=i), "ARTICLE", str(rng.randrange(9)), "x" * 4000,
               str(rng.randrange(9))) for i in range(1000)]
    shared = Path(urlparse(shared_folder(spark)).path)

    def size():
        return sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())

    before = size()
    laws = spark.createDataFrame([("L", 1)], ["law", "version_number"])
    rejected = X.number_amendments(spark.createDataFrame(events, EVENT), laws, spark.createDataFrame(base, ["law", "node_type", "number", "source_text"]))[1]
    numbers, want = {str(n) for n in range(5)}, set()
    for _, i, operation, _, _, number, _, to in events:
        if operation == "INSERT":
            numbers.add(number)
        elif number not in numbers:
            want.add(i)
        elif operation == "RENUMBER":
            numbers = numbers - {number} | {to}
    assert {r.event_id for r in rejected.collect()} == want
    assert size() - before < 2_000_000


def test_changed_counts_shuffle_whole_texts_only(spark):
    """What the texts are split into is not shuffled, nor are the ids of versions and provisions."""
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["diff_versions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = set(re.findall(r"hashpartitioning\((.*?), \d+\)", plan))
    assert dealt and not any(x in y for x in ("version_id", "node_id", "pair_id") for y in dealt)


def fold(s):
    return s.lower().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO))


def words(s):
    out, cur = [], ""
    for ch in s:
        if ch.isalnum() or ch == "_":
            cur += ch
        elif cur:
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


def test_lexical_scores_brute_force(spark):
    rng = random.Random(6)
    vocab = ["a", "an", "nat", "naïve", "law", "laws", "Άρθρο", "αρθρο", "x1", "zeta", "the", "them"]
    entries = [("d", f"r{i}", " ".join(rng.choices(vocab, k=2)), ", ".join(rng.choices(vocab, k=rng.randrange(1, 14))), str(i % 4), "law", None, None)
               for i in range(60)]
    queries = [(i, " " + " ".join(rng.choices(vocab, k=rng.randrange(1, 5)))) for i in range(12)] + [(50, "3"), (51, "..."), (52, "law, a")]
    out = R.lexical_scores(spark.createDataFrame(queries, ["query_id", "query"]), spark.createDataFrame(
        entries, "kind string, canonical_ref string, title string, body string, ref_article string, ref_law string, ecli string, case_number string")).collect()
    got = {(r.query_id, r.canonical_ref): (round(r.score, 6), r.phrase) for r in out}
    want = {}
    for qid, query in queries:
        q = query.strip().lower()
        toks = words(q)
        for _, ref, title, body, article, law, _, _ in entries:
            folded = {fold(t) for t in toks}
            hits = sum(w in folded for w in words(fold(body)))
            low = body.lower()
            overlap = sum(t in low for t in toks)
            if not hits or (len(toks) >= 2 and overlap < 2):
                continue
            score = overlap + 0.1 * hits + 3 * (q in low) + 2 * (q in title.lower()) + 4 * sum(q in x for x in (article, law))
            want[(qid, ref)] = (round(score, 6), q in low)
    assert got == want


def test_dense_topk_brute_force(spark):
    rng = random.Random(7)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    chunks = [(i, vec(3 if i % 17 == 0 else 4)) for i in range(300)] + [(900, []), (901, [0.0] * 4)]
    queries = [(i, vec()) for i in range(5)]
    out = R.dense_topk(spark.createDataFrame(queries, ["query_id", "vector"]).repartition(2),
                       spark.createDataFrame(chunks, "chunk_id int, vector array<double>").repartition(5), 10).collect()

    def cos(a, b):
        if len(a) != len(b):
            return 0.0
        na, nb = sum(x * x for x in a) ** 0.5 or 1.0, sum(x * x for x in b) ** 0.5 or 1.0
        return sum(x * y for x, y in zip(a, b)) / (na * nb)

    for qid, q in queries:
        best = sorted(((round(cos(q, v), 9), -c) for c, v in chunks if v), reverse=True)[:10]
        assert [(r.chunk_id, round(r.similarity, 6)) for r in sorted((r for r in out if r.query_id == qid), key=lambda r: r.rank)] == [
            (-c, round(s, 6)) for s, c in best]


def test_query_batches_keep_every_query(spark):
    df = spark.range(500).withColumnRenamed("id", "query_id")
    parts = scale.query_batches(df, "query_id", 90)
    assert len(parts) == 6 and sorted(r[0] for p in parts for r in p.collect()) == list(range(500))


def test_rrf_ignores_list_order(spark):
    rows = [(1, n, f"r{i % 5}", i + 1) for n in "abc" for i in range(8)]
    one = spark.createDataFrame(rows, ["query_id", "list", "canonical_ref", "rank"])
    two = spark.createDataFrame(rows[::-1], ["query_id", "list", "canonical_ref", "rank"])
    f = lambda d: sorted((r[1], round(r[2], 12)) for r in R.rrf_fuse(d).collect())
    assert f(one) == f(two)
    assert dict(f(one))["r0"] == round(3 * (1 / 61 + 1 / 66), 12)


def test_spans_brute_force(spark):
    """Mentions, facts and events of random Greek and Latin texts: the same as each pattern over the whole text."""
    import regex

    rng = random.Random(15)
    words_ = ["Άρθρο", "ΆΡΘΡΟ", "Article", "αρ.", "ΑΡ.", " ", "  ", " ", "5", "IV", "vi", "(2a)", "(α)", "(Σ)", "ΚΕΦ.", "κεφάλαιο", "Chapter", "Ν. ", "Law ", "νόμοσ ",
              "123", "(I)", "/", " / ", "2020", "20201", "ECLI:CY:AD:2019:A1", "xECLI:cy:AD:2019:A1", "45/2018", ".", "\n", "𝒳", "€5,000.50", "$ 12", "shall", "shall pay",
              "SHALL", "agrees to", "Delivered", "signed on", "1/2/2020", "31/02/2020", "John Smith", "John Smith Brown Doe", "The", "Εταιρεία", "Mary Ann", "ABC", "İ "]
    texts = ["".join(rng.choice(words_) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(800)] + [""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")], "i int, t string, kind2 string")
    flags = regex.I | regex.U
    kinds = {"article": fixed.MENTION_ARTICLE, "chapter": fixed.MENTION_CHAPTER, "law": fixed.MENTION_LAW, "judgment_ecli": fixed.ECLI, "judgment_case": fixed.MENTION_CASE}
    from lexweave.operators import graph as G, matter as M

    got = sorted((r.i, r.kind, r.start, r.end) for r in G.reference_mentions(df, "t").collect())
    assert got == sorted((i, k, *m.span()) for i, t in enumerate(texts) for k, p in kinds.items() for m in regex.finditer(p, t, flags))
    facts = M.extract_facts(df, "t")
    assert facts.columns == ["i", "kind2", "kind", "text", "char_start", "char_end", "confidence"]
    duties = sorted((r.i, r.char_end - 40) for r in facts.collect() if r.kind == "obligation")
    assert duties == sorted((i, m.start()) for i, t in enumerate(texts) for w in fixed.OBLIGATIONS for m in regex.finditer(regex.escape(w), t.lower()))
    names = [(r.i, r.text.lower()) for r in facts.collect() if r.kind == "party"]
    assert len(names) == len(set(names)) > 100
    days = sorted((r.i, r.char_start) for r in M.extract_events(df, "t").collect() if r.event_date)
    assert days == sorted((i, m.start()) for i, t in enumerate(texts) for m in regex.finditer(fixed.SLASH_DATE, t, regex.U) if m.group() == "1/2/2020")


def test_alias_classes(spark):
    """Names that chain in any direction are one case; a chain of 200 rows too."""
    from lexweave.operators import graph as G

    rng = random.Random(41)
    rows = [(f"a{rng.randrange(120)}", f"a{rng.randrange(120)}") for _ in range(70)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [(None, "a1"), ("a2", None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.name: r.case_class for r in G.alias_classes(spark.createDataFrame(rows, "alias string, canonical_id string")).collect()}
    assert got == {x: find(x) for x in root}


def test_version_spans_are_those_of_the_chain(spark):
    """Repeated texts, several of a day, one dominant law: numbers and intervals as in the chain, under the arrival."""
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.5 else f"L{rng.randrange(4)}", dt.date(2000 + rng.randrange(3), 1 + rng.randrange(12), 1), i, f"text {rng.randrange(60)}")
            for i in range(400)]
    df = spark.createDataFrame(rows + [("null", dt.date(2000, 1, 1), 400, None), ("null", dt.date(2000, 1, 2), 401, None)],
                               "law string, effective_from date, arrival int, body string")
    order = ["effective_from", "arrival"]
    chain = X.version_chain(df, "law", order, "body", "effective_from").withColumn("version_id", F.col("arrival"))
    got = X.version_spans(df, "law", order, "body", "effective_from", "arrival")
    assert got.columns == ["law", "version_id", "version_number", "effective_from", "effective_to"]
    assert sorted(map(str, got.collect())) == sorted(map(str, chain.select(*got.columns).collect()))
    hashes = X.version_chain(df, "law", order, "body", "effective_from").select("content_hash", F.sha2("body", 256).alias("want"))
    assert hashes.filter("NOT content_hash <=> coalesce(want, sha2('', 256)) AND NOT content_hash <=> want").isEmpty()
