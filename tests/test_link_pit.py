import random
from datetime import date, datetime

from conftest import rows
from pyspark.sql import functions as F

from pitlake.operators import context, link, pit, prefix

LEFT = "id string, ticker string, company_name string"


def linked(spark, left):
    keyed = spark.createDataFrame([("o1", "ABC", "Alfa A.Ş."), ("o2", "DUP", "Beta"), ("o3", "DUP", "Gama"), ("o4", None, "Delta A.Ş.")], "record_id string, ticker string, company_name string")
    named = spark.createDataFrame([("a1", "Delta Anonim Şirketi"), ("a2", "Epsilon")], "record_id string, company_name string")
    return rows(link.link_records(spark.createDataFrame(left, LEFT), keyed, named), "id", "record_id", "match_method")


def test_link_records(spark):
    got = linked(spark, [("1", " abc ", "x"), ("2", "ZZZ", "Alfa"), ("3", "DUP", "Beta"), ("4", "", "ALFA AŞ"), ("5", None, "Delta"), ("6", None, "Epsilon A.Ş."), ("7", None, "A.Ş."), ("8", " ", "Epsilon")])
    assert got == [("1", "o1", "ticker"), ("2", None, "unmatched"), ("3", None, "unmatched"), ("4", "o1", "company_name"), ("5", None, "unmatched"),
                   ("6", "a2", "company_name"), ("7", None, "unmatched"), ("8", None, "unmatched")]


def test_link_registered_allows_fallback(spark):
    sources = spark.createDataFrame([("ABC", "Alfa"), ("XYZ", "Beta A.Ş."), ("QQQ", "Yok")], "ticker string, company_name string")
    offers = spark.createDataFrame([("o2", "abc", 2), ("o1", "ABC", 1)], "record_id string, ticker string, position int")
    apps = spark.createDataFrame([("a1", "BETA", 5)], "record_id string, company_name string, position int")
    assert rows(link.link_registered(sources, offers, apps), "ticker", "record_id") == [("ABC", "o1"), ("QQQ", None), ("XYZ", "a1")]


def test_attach_application_and_normalize_flag(spark):
    dis = spark.createDataFrame([("e", "Alfa A.Ş.")], "record_id string, company_name string")
    apps = spark.createDataFrame([("a2", " alfa a.ş. ", date(2024, 1, 2), 2), ("a1", "Alfa", date(2024, 1, 1), 1)], "application_id string, company_name string, application_date date, position int")
    assert rows(link.attach_application(dis, apps), "application_id") == [("a2",)]
    assert rows(link.attach_application(dis, apps, normalize=True), "application_id") == [("a1",)]


def test_first_run_announces_nothing_but_remembers_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    announce, seen = link.emit_new(df, None, "k")
    assert announce.count() == 0 and rows(seen) == [("a",), ("b",)]
    announce, seen = link.emit_new(df, df.where("k = 'a'"), "k")
    assert rows(announce) == [("b",)] and rows(seen) == [("a",), ("b",)]
    assert link.emit_new(df, None, "k", send_existing=True)[0].count() == 2


def test_fallback_fill(spark):
    schema = "e string, f string, status string, v int"
    p = spark.createDataFrame([("e", "a", "conflicting", None), ("e", "b", "not_found", None), ("e", "c", "extracted", 1), ("e", "x", "not_found", None)], schema)
    f = spark.createDataFrame([("e", "a", "extracted", 9), ("e", "b", "extracted", 9), ("e", "c", "extracted", 9), ("e", "d", "extracted", 9)], schema)
    assert rows(link.fallback_fill(p, f, ["e", "f"])) == [("e", "a", "conflicting", None), ("e", "b", "extracted", 9), ("e", "c", "extracted", 1), ("e", "d", "extracted", 9), ("e", "x", "not_found", None)]


def test_skip_known_content_equals_in_order_pass(spark):
    random.seed(8)
    types = ["A", "B", "C"]
    docs = [(e, random.choice([*types, "Z"]), i, f"d{i}", random.choice("pqrstu")) for e in "xy" for i in range(random.randrange(4, 14))]
    known = {"p"}
    want = []
    for e in "xy":
        seen, done = set(known), set()
        for _, kind, _, doc, body in (d for d in docs if d[0] == e):
            if kind in types and kind not in done and body not in seen:
                seen.add(body)
                done.add(kind)
                want.append((e, doc))
    df = spark.createDataFrame(docs, "entity_id string, document_type string, position bigint, doc_id string, content string")
    known_df = spark.createDataFrame([("p",)], "c string").select(F.sha2("c", 256).alias("content_hash"))
    accepted, duplicates = link.skip_known_content(df, known_df, types)
    assert rows(accepted, "entity_id", "doc_id") == sorted(want)
    assert duplicates.count() == sum(d[4] == "p" and d[1] in types for d in docs)


def test_grounding_and_citations(spark):
    claims = spark.createDataFrame([("e", "Güçlü NET_MARGIN"), ("e", "başka"), ("f", "net_margin")], "entity_id string, claim string")
    vocabulary = spark.createDataFrame([("e", "net_margin"), ("f", "")], "entity_id string, term string")
    assert rows(link.validate_grounding(claims, vocabulary)) == [("e", "başka"), ("f", "net_margin")]
    outputs = spark.createDataFrame([("o", [("d", 1), ("d", 2)])], "output_id string, citations array<struct<doc_id:string,page_no:int>>")
    allowed = spark.createDataFrame([("o", "d", 1), ("other", "d", 2)], "output_id string, doc_id string, page_no int")
    assert rows(link.validate_citations(outputs, allowed)) == [("o", "d", 2)]


def test_identity_precedence(spark):
    e = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "record_id string")
    offers = spark.createDataFrame([("r1", "Offer", "")], "record_id string, company_name string, ticker string")
    apps = spark.createDataFrame([("r2", "App")], "record_id string, company_name string")
    t = datetime(2024, 1, 1)
    dis = spark.createDataFrame([("r1", "other", t, "1", "Dis", "T1"), ("r3", "other", t, "1", "Any", ""), ("r3", "investor_sale_announcement", datetime(2024, 2, 1), "2", "Ann", "T3")],
                                "record_id string, document_type string, published_at timestamp_ntz, disclosure_id string, company_name string, ticker string")
    assert rows(link.resolve_identity(e, offers, apps, dis)) == [("r1", "Offer", "T1"), ("r2", "App", None), ("r3", "Ann", "T3"), ("r4", "r4", None)]


def test_budget_stops_at_the_first_overflow(spark):
    data = [("e", i, "risk faktorleri " + "x" * n) for i, n in enumerate([10, 50, 5])] + [("e", 9, "konu yok")]
    df = spark.createDataFrame(data, "entity_id string, place int, text string")
    got = context.budgeted_selection(df, ["place"], total_chars=60).collect()
    assert [r["category"] for r in got] == ["risk_factors"]


def test_budget_over_one_hot_entity(spark):
    """One entity holds nearly all rows: its order is cut into slices of like size, and only those under the budget are gone through."""
    random.seed(4)
    data = [("hot", i, "risk " + "x" * random.randrange(30)) for i in random.sample(range(4000), 4000)]
    data += [("cold", i, "riskler " * 3) for i in range(5)] + [(None, i, "riskler") for i in range(3)] + [("cold", 9, None), ("none", 1, "konu yok")]
    df = spark.createDataFrame(data, "entity_id string, place int, text string").repartition(6)
    words = (("risk", ("risk",)),)
    got = {}
    for r in context.budgeted_selection(df, ["place"], words, total_chars=3000, slices=16).collect():
        got.setdefault(r["entity_id"], []).append((r["place"], r["section"], r["chars_so_far"]))
    for entity in ("hot", "cold", None):
        want, total = [], 0
        for _, place, text in sorted((d for d in data if d[0] == entity and d[2]), key=lambda d: d[1]):
            total += len(text.strip())
            if total > 3000:
                break
            want.append((place, text.strip(), total))
        assert sorted(got[entity]) == want
    assert set(got) == {"hot", "cold", None}

    lengths = df.where("text is not null").select("entity_id", "place", F.length("text").alias("n"))
    cut = prefix.sliced(lengths, ["entity_id"], ["place"], 16).cache()
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * 4000 / 16
    opened = prefix.offsets(cut, ["entity_id"], {"n": F.col("n")}).where("n <= 3000 and entity_id = 'hot'")
    assert opened.count() <= 3
    plan = prefix.running_sums(lengths, ["entity_id"], ["place"], {"upto": F.col("n")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert sum("_slice" in w.split("],")[1] for w in windows) >= 1 and len(windows) == 2


def test_running_sums_equal_brute_force(spark):
    random.seed(11)
    data = [(random.choice(["a", "b", None]), i, random.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, n int").repartition(5)
    got = {r["i"]: (r["upto"], r["ones"]) for r in prefix.running_sums(df, ["g"], ["i"], {"upto": F.col("n"), "ones": F.lit(1)}, slices=7).collect()}
    for g, i, _ in data:
        same = [n for h, j, n in data if h == g and j <= i]
        assert got[i] == (sum(same), len(same))
    assert prefix.running_sums(df.limit(0), ["g"], ["i"], {"upto": F.col("n")}).count() == 0


def test_rank_candidates_over_slices(spark):
    random.seed(9)
    docs = [(random.choice("ab"), f"d{i}", random.choice([None, 1, 2, 11]), datetime(2024, random.randrange(1, 4), random.randrange(1, 28))) for i in range(60)]
    df = spark.createDataFrame(docs, "entity_id string, doc_id string, part_number int, published_at timestamp_ntz")
    got = {r["doc_id"]: r["candidate_rank"] for r in context.rank_candidates(df).collect()}
    for e in "ab":
        ordered = sorted((d for d in docs if d[0] == e), key=lambda d: (d[2] is None, -(d[2] or 0), d[3], d[1]))
        assert [got[d[1]] for d in ordered] == list(range(1, len(ordered) + 1))


EV = "entity_id string, tier int, cutoff_date date, doc_id string, source string"


def test_cutoff_tiers_never_fall_through(spark):
    a, b = date(2024, 1, 1), date(2024, 1, 2)
    ev = spark.createDataFrame([("x", 1, a, "d2", "s1"), ("x", 1, a, "d1", "s1"), ("x", 2, b, "d3", "s2"), ("y", 1, a, "d1", "s1"), ("y", 1, b, "d2", "s1"), ("y", 2, a, "d3", "s2"), ("z", 3, b, "d9", "s3")], EV)
    entities = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "entity_id string")
    got = rows(pit.resolve_cutoff(entities, ev), "entity_id", "cutoff_status", "cutoff_date", "cutoff_source", "evidence_doc_id")
    assert got == [("w", "missing", None, None, None), ("x", "resolved", a, "s1", "d1"), ("y", "conflicting", None, None, None), ("z", "resolved", b, "s3", "d9")]


def test_end_of_cutoff_day_is_included_and_a_second_later_is_not(spark):
    cut = spark.createDataFrame([("e", date(2024, 1, 5)), ("f", None)], "entity_id string, cutoff_date date")
    df = spark.createDataFrame([("e", 1, datetime(2024, 1, 5, 23, 59, 59)), ("e", 2, datetime(2024, 1, 5, 23, 59, 59, 500000)), ("e", 3, datetime(2024, 1, 6)), ("f", 4, datetime(2020, 1, 1))],
                               "entity_id string, i int, at timestamp_ntz")
    judged = pit.as_of_filter(df, cut, "at")
    assert rows(judged, "i", "considered") == [(1, True), (2, False), (3, False), (4, False)]
    assert pit.leak_check(judged, cut, "at").count() == 0
    assert pit.leak_check(df.withColumn("considered", F.lit(True)), cut, "at").count() == 3


def test_lifecycle_window(spark):
    df = spark.createDataFrame([(1, date(2024, 5, 1), date(2024, 6, 1), date(2024, 7, 1)), (2, None, None, None), (3, date(2020, 1, 1), None, date(2024, 7, 1))],
                               "i int, application_date date, period_start date, listing_date date")
    got = rows(pit.lifecycle_window(df, "2024-12-31"), "i", "window_from", "window_to")
    assert got == [(1, date(2023, 12, 4), date(2024, 7, 31)), (2, date(2023, 11, 27), date(2024, 12, 31)), (3, date(2023, 6, 27), date(2024, 7, 31))]


def test_leak_check_rebuild(spark):
    """Good code is untouched by the future; a count over everything, a row that appears and a null entity are found."""
    day = date(2024, 1, 10)
    cut = spark.createDataFrame([("a", day), ("b", day), ("c", None)], "entity_id string, cutoff_date date")
    late, early = datetime(2024, 1, 11), datetime(2024, 1, 10, 23, 59, 59)
    schema = "entity_id string, ts timestamp_ntz, n int, name string, flag boolean, day date, items array<int>"
    data = [("a", early, 1, "x", True, day, [1]), ("a", late, None, None, None, day, None), ("b", early, 5, "y", False, None, None), ("c", early, 1, "z", True, day, [2]), (None, early, 7, "q", None, None, None)]
    inputs = {"facts": spark.createDataFrame(data, schema), "rates": spark.createDataFrame([(3,)], "rate int")}

    def good(tables):
        known = pit.as_of_filter(tables["facts"], cut, "ts").where("considered").drop("considered")
        return known.crossJoin(tables["rates"].limit(1))

    def run(rebuild):
        return sorted((str(r["entity_id"]), r["perturbation"]) for r in pit.leak_check_rebuild(inputs, cut, rebuild, {"facts": "ts"}).collect())

    assert run(good) == []
    assert run(lambda t: t["facts"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))) == [(e, "future dropped") for e in ("None", "a", "c")]
    for column in ("n", "name", "flag", "day"):
        leaks = run(lambda t, c=column: good(t).unionByName(t["facts"].where("ts > '2024-01-11' or ts = '2024-01-11'").select("entity_id", F.col(c).cast("string").alias("name")), allowMissingColumns=True))
        assert leaks == [("a", "future changed"), ("a", "future dropped")], column
    altered = {r["entity_id"]: r for r in pit.with_changed_future(inputs["facts"], cut, "ts", "entity_id").where(f"ts >= '{late}'").collect()}
    assert tuple(altered["a"]) == ("a", late, 0, "~", True, date(2024, 1, 11), None)


def test_content_hashes_ignore_order_and_count_repeats(spark):
    def of(*values):
        return pit.content_hashes(spark.createDataFrame([("e", v, None) for v in values], "entity_id string, v int, w string").repartition(3), "entity_id").collect()[0]["content"]

    assert of(1, 2, 3) == of(3, 1, 2) and len({of(1, 2), of(1, 1, 2), of(1, 2, 2), of(2), of(1, 1, 2, 2), of(None, 2)}) == 6
