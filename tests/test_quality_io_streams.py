import json
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pitlake.operators import pages, quality
from pitlake.plans import history
from pitlake.sources import html, readers, sinks, state_table
from pitlake.streaming import outbox, records


def test_strict_records(spark):
    def read(**values):
        lines = spark.createDataFrame([(json.dumps(values),)], "value string")
        return readers.strict_records(lines, readers.OFFERING_FIELDS).first()

    got = read(ay=3, borsaKodu="ABC", halkaArzFiyatiTl=5, borsadaIslemGormeTarihi="2024-03-01T10:00:00")
    assert (got["ay"], got["halkaArzFiyatiTl"], got["borsadaIslemGormeTarihi"]) == (3, 5.0, datetime(2024, 3, 1, 10))
    assert got["donem"] is None
    for bad in (dict(ay=3, yeni=1), dict(ay=True), dict(ay=None), dict(borsaKodu="A"), dict(ay=3, donem=7), dict(ay=3, halkaArzOrani=True), dict(ay=3, ortakSatisBinTl=1.5)):
        with pytest.raises(Exception):
            read(**bad)


def test_bulletin(spark, tmp_path):
    header = "TARIH;KOD;GRUP;PAZAR;ACILIS;DUSUK;YUKSEK;KAPANIS;HACIM;ADET;X\nTRADE DATE;INSTRUMENT SERIES CODE;INSTRUMENT GROUP;MARKET;OPENING PRICE;LOWEST PRICE;HIGHEST PRICE;CLOSING PRICE;TOTAL TRADED VALUE;TOTAL TRADED VOLUME;EXTRA\n"
    (tmp_path / "a.csv").write_text(header + "2024-01-02;ABC.E;EQT;MSPOT;1;0.5;2;1.5;100;10.0;z\n2024-01-02;ABC.F;EQT;MOTHER;1;1;1;1;1;1;z\n")
    raw = readers.read_bulletin(spark, str(tmp_path), 11)
    assert rows(readers.filter_equity_bulletin(raw)) == [(date(2024, 1, 2), "ABC", 1.0, 2.0, 0.5, 1.5, 10, 100.0)]
    with pytest.raises(Exception):
        readers.filter_equity_bulletin(raw.withColumn("instrument_code", F.lit("ABC"))).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("a;b\nc;d\n")
    with pytest.raises(Exception, match="missing column TRADE DATE"):
        readers.read_bulletin(spark, str(tmp_path / "b"), 2).collect()


def test_each_bulletin_file_has_its_own_columns(spark, tmp_path):
    first = "TRADE DATE;INSTRUMENT SERIES CODE;INSTRUMENT GROUP;MARKET;OPENING PRICE;LOWEST PRICE;HIGHEST PRICE;CLOSING PRICE;TOTAL TRADED VALUE;TOTAL TRADED VOLUME"
    other = ";".join(reversed(first.split(";")))
    (tmp_path / "1.csv").write_text(";" * 9 + f"\n{first}\n2024-01-02;A.E;EQT;MSPOT;1;2;3;4;5;6\n")
    (tmp_path / "2.csv").write_text(";" * 9 + f"\n{other}\n6;5;4;3;2;1;MSPOT;EQT;B.E;2024-01-03\n")
    got = readers.read_bulletin(spark, str(tmp_path), 10).select("trade_date", "instrument_code", "open", "close", "volume")
    assert rows(got) == [("2024-01-02", "A.E", "1", "4", "6"), ("2024-01-03", "B.E", "1", "4", "6")]


def test_disclosures(spark):
    item = {"disclosureBasic": {"disclosureId": " 7 ", "publishDate": "05.04.2024 23:59:59", "stockCode": "A, B", "relatedStocks": "C", "title": "x", "attachmentCount": 2}}
    bad = {"disclosureBasic": {"disclosureId": "8", "publishDate": "31.02.2024 10:00:00", "stockCode": "A", "relatedStocks": ""}}
    df = spark.createDataFrame([(json.dumps(item),), (json.dumps(bad),), ("broken",)], "item string")
    got = readers.normalize_disclosures(df).select("disclosure_id", "published_at", "ticker", "attachment_count")
    assert rows(got) == [("7", datetime(2024, 4, 5, 23, 59, 59), "C", 2), ("8", None, "A", 0), (None, None, None, 0)]


TABLE = "<table><tr><th>No</th><th>ŞİRKET şirket</th><th>Tarih</th></tr><tr><td></td></tr><tr><td>1</td><td><b>A</b> Ltd</td><td> 05.04.2024 </td></tr><tr><td>B</td><td>31.02.2024</td></tr><tr><td></td><td>x</td></tr><tr><td>yalnız</td></tr></table>"


def test_html_rows_and_table_choice(spark):
    web = spark.createDataFrame([(1, "<table><tr><td>menu</td></tr></table>" + TABLE), (2, "<p>no</p><table><tr><td>x</td></tr></table>"), (3, TABLE + TABLE)], "page_id bigint, html string")
    got = rows(html.application_rows(web), "page_id", "row_index", "company_name", "application_date", "reason")
    assert got == [
        (1, 1, "ALtd", date(2024, 4, 5), None), (1, 2, "B", None, "not a calendar date"), (1, 3, "", None, "empty name"), (1, 4, None, None, "too few cells"),
        (2, 0, None, None, "no fitting table"), (3, 0, None, None, "several fitting tables")]
    assert html.html_table_rows(web).where("page_id = 2").select("table_no", "row_no", "cells").collect() == [(0, 1, ["x"])]


def test_plain_pages_are_split_without_the_parser(monkeypatch):
    def parsed(page):
        tables = html._Tables()
        tables.feed(page)
        tables.close()
        return tables.rows

    odd = ["<table><tr><td>a<!-- <td>b --></td><td>c</td></tr></table>", "<table><tr><td>1 < 2</td></tr></table>", "<table><tr><td><script>'</td>'</script>x</td></tr></table>",
           "<table><tr><td a='>'>x<td/>y</tr>", "<tr><td>out</td></tr><table><td>no row</td><tr><td>open", ""]
    plain = [TABLE, "<TABLE border=\"1\"><tr>\n<Td class=\"a b\" >x &amp; <b>y</b>&lt<td> z </tr><tr><td>1<table><tr><th>in</th></tr></table>2</td></tr></table>", "no &amp; table"]
    want = {page: parsed(page) for page in odd + plain}
    assert {page: html.read_tables(page) for page in odd + plain} == want
    monkeypatch.setattr(html._Tables, "feed", lambda self, page: pytest.fail("parsed: " + page))
    assert {page: html.read_tables(page) for page in plain} == {page: want[page] for page in plain}


def test_pages_without_html_keep_their_row(spark):
    web = spark.createDataFrame([(1, None), (2, "<p>no</p>"), (3, "<table></table>")], "page_id int, html string")
    assert rows(html.page_tables(web)) == [(1, []), (2, []), (3, [])]


def test_links(spark):
    body = ('<a href="/a/izahname.pdf">Onaylı İzahname</a><a href="https://ir.firma.com/f.pdf"><i>Fon Kullanım</i> Raporu</a><a href="/a/izahname.pdf">İzahname</a>'
            '<a href="https://kotu.com/izahname.pdf">İzahname</a><a href="https://xfirma.com/i.pdf">İzahname</a><a href="#x.pdf">İzahname</a><a href="c.pdf">Menü</a><a href="d.pdf">finansal tablolar</a>')
    web = spark.createDataFrame([(1, "https://www.firma.com/yatirim/sayfa.html?x=1", body, "firma.com")], "page_id int, url string, html string, allowed_domain string")
    rules = [("izahname", "approved_prospectus"), (r"fon\w*\s+kullan", "use_of_proceeds_report"), ("finansal tablolar", "financial_statement_attachment")]
    got = rows(pages.discover_links(web, rules, regex=True), "link_url", "document_type", "position")
    assert got == [("https://ir.firma.com/f.pdf", "use_of_proceeds_report", 1), ("https://www.firma.com/a/izahname.pdf", "approved_prospectus", 0),
                   ("https://www.firma.com/yatirim/d.pdf", "financial_statement_attachment", 7)]


def test_page_shape(spark):
    page = "<html><head><title> A &amp; B </title></head><body><script>var u='/api/spec.json';</script><!-- c --><p> hi&nbsp; </p><a href='/x.pdf'>d</a><table></table></body></html>"
    got = pages.page_shape(spark.createDataFrame([(1, "https://s.com/p", page)], "page_id int, url string, html string")).first()
    assert (got["page_title"], got["table_count"], got["link_count"], got["needs_scripts"]) == ("A & B", 1, 1, True)
    assert got["download_links"] == ["https://s.com/api/spec.json", "https://s.com/x.pdf"]


def test_flatten_skips_single_bad_cells(spark):
    df = spark.createDataFrame([("05-01-2024", "1.5", None), ("6-1-2024", "x", "2"), ("2024-3", "7", "8"), (None, "1", "1"), ("31-02-2024", "1", "1")], "d string, a string, b string")
    out = quality.flatten_wide_series(df, "d", [("day", "a", "daily", "u"), ("month", "b", "monthly", "u")])
    assert rows(out, "series", "obs_date", "value") == [("day", date(2024, 1, 5), 1.5), ("month", date(2024, 3, 1), 8.0)]


def test_ordering_comparison(spark):
    a = spark.createDataFrame([(0, "x", None), (1, "y", 1)], "p int, v string, w int")
    same = quality.compare_ordering(a, a, "p").first()
    assert same["stable"] and same["same_length"] and same["first_divergence"] is None
    shorter = quality.compare_ordering(a, a.where("p = 0"), "p").first()
    assert not shorter["same_length"] and not shorter["stable"]
    assert quality.compare_ordering(a, a.withColumn("w", F.lit(1)), "p").first()["first_divergence"] == 0


def test_snapshot_dataset_versions_are_independent(spark, tmp_path):
    path = str(tmp_path / "ds")
    df = spark.createDataFrame([("e", "resolved")], "entity_id string, cutoff_status string")
    sinks.write_snapshot_dataset(df, path, "v1")
    sinks.write_snapshot_dataset(df.unionByName(df), path, "v2")
    sinks.write_snapshot_dataset(df, path, "v1")
    assert (sinks.read_snapshot_dataset(spark, path, "v1").count(), sinks.read_snapshot_dataset(spark, path, "v2").count()) == (1, 2)


def test_append_first_writes_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "series string, obs_date date, value double"
    sinks.append_first_writes(path, spark.createDataFrame([("s", date(2024, 1, 1), 1.0), ("s", date(2024, 1, 1), 0.5)], schema), ["series", "obs_date"], ["value"], "obs_date")
    sinks.append_first_writes(path, spark.createDataFrame([("s", date(2024, 1, 1), 9.0), ("s", date(2024, 2, 1), 2.0)], schema), ["series", "obs_date"], ["value"], "obs_date")
    assert rows(spark.read.parquet(path), "obs_date", "value") == [(date(2024, 1, 1), 0.5), (date(2024, 2, 1), 2.0)]


def test_state_table_is_never_shuffled(spark, tmp_path):
    """Two batches and a replay equal one pass in order; looking up has an exchange above the batch alone, also after compaction."""
    rng = random.Random(3)
    schema, name = "k long, g string, v int", "state_points"
    batches = [[(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice("xy"), i) for i in range(n * 100, n * 100 + 60)] for n in range(2)]
    spark.sql(f"drop table if exists {name}")
    for batch in (*batches, batches[1]):
        state_table.append_unseen(spark.createDataFrame(batch, schema), name, ["k", "g"], ["v"], str(tmp_path / "t"), buckets=4)
    want = {}
    for k, g, v in (r for b in batches for r in sorted(b, key=lambda r: r[2])):
        if k is not None:
            want.setdefault((k, g), v)
    assert {(r["k"], r["g"]): r["v"] for r in spark.table(name).collect()} == want and spark.table(name).count() == len(want)
    more = spark.createDataFrame([(1, "x", 0), (99, "x", 0), (None, "x", 0)], schema)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            found = state_table.unseen(more, name, ["k", "g"])
            assert {r["k"] for r in found.collect()} == {99, None} | ({1} if (1, "x") not in want else set())
            plan = found._jdf.queryExecution().sparkPlan().toString() and found._jdf.queryExecution().executedPlan().toString()
            initial = plan.split("Initial Plan")[-1]
            assert initial.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in initial
            assert state_table.seen(more, name, ["k", "g"]).count() == ((1, "x") in want)
            state_table.compact(spark, name, ["k", "g"], str(tmp_path / f"c{_}"))
        assert {(r["k"], r["g"]): r["v"] for r in spark.table(name).collect()} == want and state_table.buckets_of(spark, name) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"drop table if exists {name}")
    assert state_table.unseen(more, "no_such_table", ["k", "g"]).count() == 3 and state_table.seen(more, "no_such_table", ["k", "g"]).count() == 0


def source(spark, folder):
    return spark.readStream.schema("k string, h string, v int").json(folder)


def feed(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip("khv", i, strict=True))) for i in items))


def test_first_run_is_silent_and_restart_announces_only_new(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feed(src, "1.json", ("a", "x", 1), ("a", "y", 2), ("b", "x", 1))
    records.finish(records.stream_new_records(source(spark, str(src)), ["k"], out, state), state)
    feed(src, "2.json", ("a", "z", 3), ("c", "x", 1))
    records.finish(records.stream_new_records(source(spark, str(src)), ["k"], out, state), state)
    assert rows(spark.read.parquet(out), "k", "announced") == [("a", False), ("b", False), ("c", True)]


def test_first_run_that_died_goes_on_unannounced(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feed(src, "1.json", ("a", "x", 1))
    records.stream_new_records(source(spark, str(src)), ["k"], out, state).awaitTermination()  # no mark: died before it finished
    feed(src, "2.json", ("b", "x", 1))
    records.finish(records.stream_new_records(source(spark, str(src)), ["k"], out, state), state)
    feed(src, "3.json", ("c", "x", 1))
    records.finish(records.stream_new_records(source(spark, str(src)), ["k"], out, state), state)
    assert rows(spark.read.parquet(out), "k", "announced") == [("a", False), ("b", False), ("c", True)]


def test_only_the_batch_months_of_the_target_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "series string, obs_date date, value double"
    old = spark.createDataFrame([("s", date(2024, m, 1), 1.0) for m in range(1, 7)], schema)
    sinks.append_first_writes(path, old, ["series", "obs_date"], ["value"], "obs_date")
    staged = spark.createDataFrame([("s", date(2024, 2, 1), 2.0)], schema).withColumn("month", F.date_format("obs_date", "yyyy-MM"))
    plan = sinks.months_of(spark.read.parquet(path), staged)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan


def test_reverted_content_is_not_resent(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for i, h in enumerate("xyx"):
        feed(src, f"{i}.json", ("a", h, i))
        records.stream_changed(source(spark, str(src)), ["k"], "h", out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "k", "h") == [("a", "x"), ("a", "y")]


def test_failed_delivery_is_tried_again(spark, tmp_path):
    src, sent, state = tmp_path / "in", str(tmp_path / "sent"), str(tmp_path / "state")
    tried = []

    def deliver(batch):
        tried.append(rows(batch, "k"))
        return batch.where("v > 0")

    feed(src, "1.json", ("a", "x", 1), ("b", "x", 0))
    records.deliver_changed(source(spark, str(src)), ["k"], "h", sent, state, deliver).awaitTermination()
    feed(src, "2.json", ("a", "x", 1), ("b", "x", 1))
    records.deliver_changed(source(spark, str(src)), ["k"], "h", sent, state, deliver).awaitTermination()
    assert tried == [[("a",), ("b",)], [("b",)]]
    assert rows(spark.read.parquet(sent), "k", "h") == [("a", "x"), ("b", "x")]


def test_late_rows_go_to_a_reject_table(spark, tmp_path):
    """Runs from one checkpoint: repeats in time are dropped, late and timeless rows are kept apart, forgotten keys are new again, a replay changes nothing."""
    src, out, late, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state")
    src.mkdir()

    def arrive(name, *items):
        (src / name).write_text("\n".join(json.dumps({"k": k, "t": f"2024-01-{d:02d}T00:00:00", "v": v} if d else {"k": k, "v": v}) for k, d, v in items))
        stream = spark.readStream.schema("k string, t timestamp_ntz, v int").json(str(src))
        records.stream_in_time(stream, ["k"], "t", timedelta(days=3), ["v"], out, late, state).awaitTermination()

    arrive("1.json", ("a", 10, 2), ("a", 10, 1), ("b", 12, 1), (None, 11, 1), ("x", None, 9))
    arrive("2.json", ("a", 11, 3), ("b", 9, 4), ("c", 8, 5), (None, 12, 6), ("d", 20, 7))
    arrive("3.json", ("a", 17, 8), ("a", 16, 9), ("d", 25, 10))
    assert rows(spark.read.parquet(out), "k", "v", "batch") == [("a", 1, 0), ("a", 8, 2), ("b", 1, 0), ("d", 7, 1), (None, 1, 0)]
    assert rows(spark.read.parquet(late), "k", "v", "reason") == [("a", 9, "late"), ("c", 5, "late"), ("x", 9, "no event time")]
    before = rows(spark.read.parquet(out))
    (tmp_path / "state" / "commits" / "2").unlink()  # the last batch died before its commit
    for crc in (tmp_path / "state" / "commits").glob(".2*"):
        crc.unlink()
    arrive("3.json", ("a", 17, 8), ("a", 16, 9), ("d", 25, 10))
    assert rows(spark.read.parquet(out)) == before and spark.read.parquet(late).count() == 3


MINUTE = timedelta(minutes=1)


def outbox_brute(items, live, retry, attempts, upto):
    """(key, outcome, attempt, minute) of each key's rows in order, and of its timers up to the watermark."""
    out = []
    for key in {k for k, _, _ in items}:
        now = None
        for at, confirmed in [*sorted((t, c) for k, t, c in items if k == key), (upto, None)]:
            while now and now[2] <= at:
                if now[0] == "sent":
                    now = None
                elif now[1] < attempts:
                    now = ("waiting", now[1] + 1, now[2] + retry)
                    out.append((key, "send", now[1], now[2] - retry))
                else:
                    out.append((key, "given_up", now[1], now[2]))
                    now = None
            if confirmed:
                now = ("sent", 0, max(at + live, now[2] if now and now[0] == "sent" else 0))
            elif confirmed is False and now is None:
                out.append((key, "send", 1, at))
                now = ("waiting", 1, at + retry)
    return sorted(out)


def test_timed_delivery_expires_retries_and_restarts(spark, tmp_path):
    """Random content and confirmations in time order over several runs from one checkpoint, against a walk over each key."""
    rng = random.Random(8)
    items = sorted(((rng.choice("abcd"), t, rng.random() < 0.4) for t in rng.sample(range(1000), 120)), key=lambda i: i[1])
    items = [(k, t, c and k != "d") for k, t, c in items]
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    start = datetime(2024, 1, 1)
    runs = [items[:40], items[40:41], items[41:90], items[90:]]
    for i, part in enumerate(runs):
        lines = [json.dumps({"k": k, "t": (start + t * MINUTE).isoformat(), "ok": c or None}) for k, t, c in part]
        (src / f"{i}.json").write_text("\n".join(lines + ([json.dumps({"k": "a", "t": None, "ok": None})] if i == 1 else [])))
        stream = spark.readStream.schema("k string, t timestamp, ok boolean").json(str(src)).withColumn("h", F.lit("x"))
        due = outbox.timed_delivery(stream, ["k"], "h", "t", "ok", "0 seconds", 90 * MINUTE, 25 * MINUTE, attempts=3)
        outbox.run(due, out, state)
    got = sorted((r["k"], r["outcome"], r["attempt"], (r["due"] - start) // MINUTE) for r in spark.read.parquet(out).collect())
    assert got == outbox_brute(items, 90, 25, 3, items[-1][1])
    assert {o for _, o, _, _ in got} == {"send", "given_up"} and spark.conf.get(outbox.STATE_STORE) != outbox.ROCKS_DB


def test_stream_first_write_wins_over_batches(spark, tmp_path):
    src, target, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    for i, v in enumerate((5, 1)):
        feed(src, f"{i}.json", ("a", "2024-01-01", v), ("a", f"2024-02-0{i + 1}", v))
        stream = source(spark, str(src)).withColumn("day", F.to_date("h"))
        records.stream_first_write_wins(stream, ["k", "day"], ["v"], "day", target, state).awaitTermination()
    assert rows(spark.read.parquet(target), "day", "v") == [(date(2024, 1, 1), 5), (date(2024, 2, 1), 5), (date(2024, 2, 2), 1)]


OBS = "entity_id string, field string, source_type string, published_at timestamp_ntz, doc_id string, page_no int, method string, value_num double, value_str string, value_date date"


def snapshot(spark, extra_obs=(), extra_docs=(), outcomes=None):
    t = datetime(2024, 4, 1)
    obs = [("e", "subscription_end_date", "approved_prospectus", t, "d1", 1, "digital", None, None, date(2024, 4, 5)), ("e", "offering_price", "approved_prospectus", t, "d1", 1, "digital", 10.0, None, None),
           ("g", "offering_price", "approved_prospectus", t, "d9", 1, "digital", 10.0, None, None), *extra_obs]
    docs = [("e", "d1", "approved_prospectus", "İzahname", t, True), ("g", "d9", "approved_prospectus", "İzahname", t, True), *extra_docs]
    index = spark.createDataFrame([(date(2024, 4, 1), 100.0)], "obs_date date, value double")
    fin = spark.createDataFrame([], "entity_id string, metric string, value double, currency string, scale string, period_start date, period_end date, period_type string, consolidation_scope string, "
                                    "inflation_adjusted boolean, document_type string, doc_id string, page_no int, place int, published_at timestamp_ntz")
    out = history.build_snapshots(
        spark.createDataFrame([("e", "standard"), ("g", "standard")], "entity_id string, sector string"),
        spark.createDataFrame(docs, "entity_id string, doc_id string, document_type string, title string, published_at timestamp_ntz, usable boolean"), spark.createDataFrame(obs, OBS),
        spark.createDataFrame([], "entity_id string, cutoff_date date, doc_id string, source string"), fin, (index, {"policy_rate": index, "tlref_rate": index}, index), outcomes=outcomes)
    return {r["entity_id"]: r for r in out.collect()}


def test_snapshots_ignore_everything_after_the_cutoff(spark):
    base = snapshot(spark)
    assert (base["e"]["cutoff_status"], base["e"]["cutoff_date"], base["e"]["considered_documents"]) == ("resolved", date(2024, 4, 5), 1)
    assert base["g"]["cutoff_status"] == "missing" and base["g"]["signal"] is None and base["g"]["excluded_documents"] == 1
    late = datetime(2024, 4, 6)
    more = snapshot(spark, [("e", "offering_price", "investor_sale_announcement", late, "d2", 1, "digital", 99.0, None, None)], [("e", "d2", "approved_prospectus", "Halka Arzın İptali", late, True)],
                    spark.createDataFrame([("e", 5.0)], "entity_id string, return_1d double"))
    assert (more["e"]["considered_documents"], more["e"]["excluded_documents"], more["e"]["return_1d"]) == (1, 1, 5.0)
    for column in ("signal", "total_score", "confidence_score"):
        assert more["e"][column] == base["e"][column]


def test_snapshots_broadcast_no_row_per_entity(spark, monkeypatch):
    """Cutoffs look small in their files at any size, so the joins by entity leave nothing to estimates."""
    class Seen(Exception):
        pass

    def look(*tables):
        raise Seen(tables)

    monkeypatch.setattr(history, "decide_entities", look)
    with pytest.raises(Seen) as seen:
        snapshot(spark)
    entities, documents, _, fin, _, context = seen.value.args[0][:6]
    for df in (entities, documents, fin):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "BuildLeft" not in context._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]


def test_cutoffs_search_for_the_end_of_the_subscription_only(spark):
    """All fields are read only from documents that are considered at a cutoff."""
    from workload import plans

    d = "/root/testdata/sf0.001"
    observed = plans.snapshot_inputs(spark, d)[2]
    assert {r.field for r in observed.select("field").distinct().collect()} == {"subscription_end_date"}
    cutoffs = plans.history.build_cutoffs(*[plans.snapshot_inputs(spark, d)[i] for i in (0, 2, 3)])
    every = plans.snapshot_observations(plans.offering_pages(spark, d))
    want = plans.pit.as_of_filter(every, cutoffs, "published_at").where("considered").drop("considered")
    got = plans.known_observations(spark, d, cutoffs)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []
