"""Small literal cases with known answers."""

import datetime as dt

from pyspark.sql import Row, functions as F

from lexweave.functions import fixed, text as T
from lexweave.operators import evaluate as E, governance as V, graph as G, matter as M, procedure as P, similarity as S, structure as D, temporal as X
from lexweave.sources import records as R, sinks

MENTIONS = "Άρθρο 15(2)(α), ΚΕΦ. 6, Κεφ. 148, Ν. 123(I)/2020, ECLI:CY:AD:2019:A1, 45/2018"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_mentions(spark):
    found = G.reference_mentions(spark.createDataFrame([(MENTIONS,)], ["t"]), "t").collect()
    assert {r.kind for r in found} == {"article", "chapter", "law", "judgment_ecli", "judgment_case"}
    article = next(r for r in found if r.kind == "article")
    assert (article.article, article.sub, article.para) == ("15", "2", "α")
    assert all(MENTIONS[r.start:r.end] == r.text for r in found)


def test_spans_with_mark_characters(spark):
    text = "x \ufdd0 Article 7 \ufdd1 y Κεφ. 9 and 1/2020 tail"
    plain = text.replace("\ufdd0", "-").replace("\ufdd1", "-")
    found = G.reference_mentions(spark.createDataFrame([(text,), (plain,)], ["t"]).withColumn("u", F.col("t")), "t").collect()
    assert all(r.u[r.start:r.end] == r.text for r in found)
    assert sorted((r.kind, r.start) for r in found if r.u == text) == sorted((r.kind, r.start) for r in found if r.u == plain)
    assert len(found) == 8


def test_classify_citations(spark):
    texts = ["Article 5 of Law 261 of 2004", "ECLI:CY:AD:2019:A123", "Civil Appeal 45/2018", "some prose", "", None]
    out = G.classify_citations(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    by = {r.t: r for r in out}
    assert (by[texts[0]].kind, by[texts[0]].article, by[texts[0]].law) == ("legislation_article", "5", "261")
    assert by[texts[1]].ecli == texts[1]
    assert (by[texts[2]].kind, by[texts[2]].case_number) == ("judgment", "45/2018")
    assert by["some prose"].kind == by[""].kind == by[None].kind == "unknown"


def test_citation_check(spark):
    entries = spark.createDataFrame([("law-261-art-5", "261", "5", None, None)],
                                    "canonical_ref string, ref_law string, ref_article string, ecli string, case_number string")
    out = G.validate_citations(spark.createDataFrame([("Article 99 of Law 54321",), ("Article 5 of Law 261",)], ["cite"]), entries)
    assert rows(out, "cite", "parsed", "exists", "matches") == [
        ("Article 5 of Law 261", True, True, 1), ("Article 99 of Law 54321", True, False, 0)
    ]


def rule(key, mode, days=0, dom=None, direction="after", ambiguous=False):
    return Row(rule_key=key, calculate_mode=mode, base_days=days, day_of_month=dom, direction=direction, ambiguous=ambiguous,
               source_note="note", law_ref="law", limit_type="maximum")


def test_deadlines(spark):
    d = dt.date
    rules = [rule("b14", "business_days", 14), rule("c30", "calendar_days", 30), rule("amb", "calendar_days", 5, ambiguous=True),
             rule("b1", "business_days", 1), rule("back", "business_days", 2, direction="before"), rule("odd", "lunar"),
             rule("dom31", "day_of_month", dom=31), rule("end", "last_day_month", direction="before")]
    schema = ("rule_key string, calculate_mode string, base_days int, day_of_month int, direction string, ambiguous boolean, "
              "source_note string, law_ref string, limit_type string")
    triggers = [(1, "b14", d(2021, 3, 5)), (2, "c30", d(2021, 3, 5)), (3, "amb", d(2021, 3, 5)), (4, "b1", d(2021, 3, 6)),
                (5, "back", d(2021, 3, 8)), (6, "odd", d(2021, 3, 8)), (7, "dom31", d(2021, 1, 31)), (8, "end", d(2021, 3, 8))]
    out = P.deadline_schedule(spark.createDataFrame(triggers, "trigger_id int, rule_key string, trigger_date date"),
                              spark.createDataFrame(rules, schema))
    got = {r.trigger_id: (r.certainty, r.deadline) for r in out.collect()}
    assert got[1] == ("DETERMINED", d(2021, 3, 26))
    assert got[2] == ("DETERMINED", d(2021, 4, 4))
    assert got[3] == ("REVIEW_REQUIRED", None)
    assert got[4] == ("DETERMINED", d(2021, 3, 8))
    assert got[5] == ("DETERMINED", d(2021, 3, 4))
    assert got[6] == ("REVIEW_REQUIRED", None)
    assert got[7] == ("DETERMINED", d(2021, 2, 28))
    assert got[8] == ("DETERMINED", d(2021, 2, 28))


def test_business_days_against_steps(spark):
    start, rules, want = dt.date(2020, 12, 20), [], {}
    for n in range(-15, 16):
        rules.append(rule(f"r{n}", "business_days", abs(n), direction="after" if n >= 0 else "before"))
        for shift in range(20):
            day = begin = start + dt.timedelta(days=shift)
            left = abs(n)
            while left:
                day += dt.timedelta(days=1 if n > 0 else -1)
                left -= day.weekday() < 5 and (day.month, day.day) not in fixed.HOLIDAYS
            want[(f"r{n}", begin)] = day
    schema = ("rule_key string, calculate_mode string, base_days int, day_of_month int, direction string, ambiguous boolean, "
              "source_note string, law_ref string, limit_type string")
    triggers = [(i, k, b) for i, (k, b) in enumerate(want)]
    out = P.deadline_schedule(spark.createDataFrame(triggers, "trigger_id int, rule_key string, trigger_date date"),
                              spark.createDataFrame(rules, schema)).collect()
    assert {(r.rule_key, r.trigger_date): r.deadline for r in out} == want


def test_split_provisions(spark):
    text = "Preamble\nArticle 5\nFirst.\n(1)A duty\n(2) loose\nΆρθρο 6.\n\nSecond.\nArticle IV text on the heading is dropped\nThird"
    df = spark.createDataFrame([("x", text)], ["law", "raw_text"])
    assert [tuple(r)[1:] for r in D.split_provisions(df).collect()] == [
        ("PARAGRAPH", "1", "5", "(1)A duty", 0), ("ARTICLE", "5", None, "First.\n(2) loose", 1),
        ("ARTICLE", "6", None, "Second.", 2), ("ARTICLE", "IV", None, "Third", 3),
    ]
    loose = D.split_provisions(df, strict_paragraphs=False).filter("node_type = 'PARAGRAPH'")
    assert rows(loose, "number") == [("1",), ("2",)]


def test_segment_judgments(spark):
    text = "Intro line\n\nThe Facts:\nA fell.\nB saw it.\nHOLDING.\nDismissed with costs"
    out = D.segment_judgments(spark.createDataFrame([("c", text)], ["case_id", "text"]), "case_id", "text")
    assert rows(out, "section_no", "section_type", "para_number", "text") == [
        (0, "body", 1, "Intro line"), (1, "facts", 2, "A fell."), (1, "facts", 3, "B saw it."), (2, "holding", 4, "Dismissed with costs"),
    ]


def test_as_of(spark):
    versions = spark.createDataFrame([("L", "v1", 1, dt.date(2020, 1, 1), dt.date(2022, 6, 1)), ("L", "v2", 2, dt.date(2022, 6, 1), None)],
                                     "law string, version_id string, version_number int, effective_from date, effective_to date")
    probes = spark.createDataFrame([("L", dt.date(2019, 1, 1)), ("L", dt.date(2021, 6, 1)), ("L", dt.date(2023, 6, 1)), ("M", dt.date(2023, 6, 1))], ["law", "as_of"])
    got = [(str(r.as_of), r.law, r.version_number, r.applicable) for r in X.resolve_as_of(probes, versions).collect()]
    assert sorted(got, key=str) == [("2019-01-01", "L", 2, False), ("2021-06-01", "L", 1, True), ("2023-06-01", "L", 2, True), ("2023-06-01", "M", None, False)]


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], ["query_id"])
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], ["query_id", "canonical_ref", "rank"])
    gold = spark.createDataFrame([(1, "a"), (2, "a")], ["query_id", "canonical_ref"])
    out = {r.query_id: r for r in E.ranking_metrics(q, ranked, gold).collect()}
    assert (out[1].mrr, out[1].recall_10, out[1].ndcg_10, out[1].precision_10) == (1.0, 1.0, 1.0, 0.333)
    assert (out[2].mrr, out[2].recall_10) == (0.0, 0.0)


def test_remedy_similarity(spark):
    cases = spark.createDataFrame([("a", "X"), ("b", "X")], ["id", "court"])
    paras = spark.createDataFrame([("a", "order", 1, "Damages and specific"), ("a", "order", 2, "performance; costs"),
                                   ("b", "order", 1, "damages, costs, specific performance")], ["id", "section_type", "para_number", "text"])
    pairs = spark.createDataFrame([(1, "a", "b")], ["pair_id", "a_id", "b_id"])
    out = S.compare_cases(pairs, cases, paras, spark.createDataFrame([], "id string, target_key string"))
    scores = {r.dimension: r.score for r in out.collect()}
    assert len(scores) == 5 and scores["REMEDY_SIMILARITY"] == 1.0 and scores["PROCEDURAL_SIMILARITY"] == 0.5
    assert all(0 <= v <= 1 for v in scores.values())


def test_metering_limit(spark):
    day = dt.datetime(2024, 1, 1, 9)
    calls = spark.createDataFrame([(i, "o", "search_per_day", day + dt.timedelta(minutes=i * 7)) for i in range(26)], ["call_id", "org_id", "key", "ts"])
    out = V.usage_metering(calls, spark.createDataFrame([("o", "free")], ["org_id", "plan"])).collect()
    assert sum(r.allowed for r in out) == 25 and min(r.remaining for r in out) == 0
    paid = V.usage_metering(calls, spark.createDataFrame([("o", "Pro")], ["org_id", "plan"])).collect()
    assert all(r.allowed and r.remaining is None for r in paid)


def test_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        '"Decision No.","Decision Summary","Legislation on which Decision was based","Affected Company/Organisations","Download_URL","Decision Date"\n'
        '"ΥΠΚ 1/2020","Fined\nheavily","Law 1","Acme","","1/2/2020"\n"  ","x","y","z","",""\n', encoding="utf-8")
    out = R.read_decisions(spark, str(tmp_path / "d.csv")).collect()
    assert len(out) == 1 and out[0].canonical_key == "consumer-decision-p-1-2020"
    assert out[0].body == "Decision ΥΠΚ 1/2020\nFined\nheavily\nStatutory basis: Law 1\nAffected undertaking: Acme"
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.txt").write_bytes(b"ok \xff")
    (files / "b.bin").write_bytes(b"a\x00b")
    (files / "c.bin").write_bytes("Ω".encode())
    (files / "d.dat").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in R.read_text_documents(spark, str(files)).collect()}
    assert got == {"a.txt": "ok �", "b.bin": "", "c.bin": "Ω", "d.dat": ""}


def test_audit_columns(spark, tmp_path):
    cols = [*sinks.AUDIT_CSV, "detail"]
    df = spark.createDataFrame([tuple("x" for _ in cols)], cols)
    sinks.write_audit(df, str(tmp_path / "j"))
    sinks.write_audit(df, str(tmp_path / "c"), "csv")
    assert set(spark.read.json(str(tmp_path / "j")).columns) == set(cols)
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == sinks.AUDIT_CSV


def test_facts_and_events(spark):
    text = "On 5/3/2021 Alpha Trading signed. It shall pay €1,200.50; 31/2/2021 is no date. The Court of Beta Gamma Delta Epsilon filed it"
    df = spark.createDataFrame([(1, text)], ["id", "t"])
    facts = M.extract_facts(df, "t").collect()
    assert [f.text for f in facts if f.kind == "amount"] == ["€1,200.50"]
    assert {f.text for f in facts if f.kind == "party"} == {"Alpha Trading", "It", "The Court"}
    assert len([f for f in facts if f.kind == "obligation"]) == 2
    events = M.extract_events(df, "t").collect()
    dated = [e for e in events if e.event_date]
    assert [(str(e.event_date), e.description) for e in dated] == [("2021-03-05", "5/3/2021 Alpha Trading signed")]
    assert len([e for e in events if not e.event_date]) == 1


def test_lawyer_decision_wins(spark):
    schema = ("org_id int, matter_id int, canonical_ref string, event_id int, ts int, action string, value string, basis string, jurisdiction string, "
              "authority_type string, source_scope string, authority_name string, lawyer_note string, matter_issue string, evidence string")
    log = [(1, 1, "r", i, i, a, v, None, None, None, None, n, None, None, None) for i, (a, v, n) in enumerate(
        [("save", "supporting", "first"), ("classify", "adverse", None), ("suggest", "supporting", None), ("save", "neutral", None)])]
    row = M.authority_state(spark.createDataFrame(log, schema)).first()
    assert (row.classification, row.suggestion, row.suggestion_provenance, row.authority_name) == ("adverse", "supporting", "MODEL_INFERENCE", "first")
    row = M.authority_state(spark.createDataFrame(log[:1] + log[2:], schema)).first()
    assert row.classification == "supporting"


def test_word_helpers(spark):
    df = spark.createDataFrame([("Élan Ναός α_1",)], ["t"])
    assert df.select(T.folded_tokens("t")).first()[0] == ["elan", "ναος", "α_1"]
    assert df.select(T.slug(F.lit(" Law 68/82 π "))).first()[0] == "law-68-82-p"


RULE = "rule_key string, calculate_mode string, base_days int, day_of_month int, direction string, ambiguous boolean, limit_type string, source_note string, law_ref string"


def test_deadline_source_and_long_closures(spark):
    rules = spark.createDataFrame(
        [
            ("lunar", "lunar", 3, None, "after", False, "maximum", None, "law-9"),
            ("unsure", "calendar_days", 3, None, "after", True, "maximum", None, "law-9"),
            ("plain", "calendar_days", 3, None, "after", False, "maximum", None, "law-9"),
            ("closed", "business_days", 1, None, "after", False, "maximum", "note", "law-9"),
        ], RULE,
    )
    triggers = spark.createDataFrame([(k, k, dt.date(2021, 7, 30)) for k in ("lunar", "unsure", "plain", "closed")],
                                     "trigger_id string, rule_key string, trigger_date date")
    closed = [((dt.date(2021, 7, 31) + dt.timedelta(days=k)).month, (dt.date(2021, 7, 31) + dt.timedelta(days=k)).day) for k in range(50)]
    got = {r.rule_key: r for r in P.deadline_schedule(triggers, rules, closed).collect()}
    assert got["lunar"].source is None and got["unsure"].source == "law-9" and got["plain"].source == "law-9"
    assert got["closed"].deadline == dt.date(2021, 9, 20) and got["closed"].certainty == "DETERMINED"


def test_empty_courts_are_not_the_same_court(spark):
    cases = spark.createDataFrame([("a", ""), ("b", ""), ("c", "X"), ("d", "X")], "id string, court string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "pair_id int, a_id string, b_id string")
    paragraphs = spark.createDataFrame([], "id string, section_type string, para_number bigint, text string")
    citations = spark.createDataFrame([], "id string, target_key string")
    rows = S.compare_cases(pairs, cases, paragraphs, citations).where("dimension = 'PROCEDURAL_SIMILARITY'").collect()
    assert {r.pair_id: r.score for r in rows} == {1: 0.0, 2: 0.5}


def test_issue_words_over_several_facts(spark):
    facts = [
        (1, 1, "he owed a Duty", "accepted"), (1, 2, "another matter", "proposed"), (1, 3, "of", "accepted"), (1, 9000, "care to her", "accepted"),
        (2, 1, "a duty", "accepted"), (2, 2, "", "accepted"), (2, 3, "of care", "accepted"), (3, 1, "duty", "accepted"), (4, 1, "of care", "accepted"),
        (5, 1, None, "accepted"), (5, 2, "insolvency", "accepted"),
    ]
    existing = spark.createDataFrame([], "matter_id int, text string, status string")
    got = M.suggest_issues(spark.createDataFrame(facts, "matter_id int, fact_id long, text string, status string"), existing)
    assert rows(got, "matter_id", "text") == [(1, fixed.ISSUE_RULES[1][1]), (5, fixed.ISSUE_RULES[0][1])]
