"""Summaries and tools on hand-made facts (traps T1, T6, T8, T17, T18, A6, A7, J1, J6)."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltframe.operators import summaries as S
from voltframe.operators import tools as TL
from voltframe.operators.ordinal import row_number_in_group

T0 = dt.datetime(2024, 1, 1, 0)


def gen(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(hours=h), r, f"{r} name", (f or "")[:3].upper(), f, "megawatthours", v) for r, h, f, v in rows],
        "period timestamp_ntz, respondent string, respondent_name string, fueltype string, type_name string, "
        "value_units string, value double",
    )


def reg(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(hours=h), r, f"{r} name", t, t, "megawatthours", v) for r, h, t, v in rows],
        "period timestamp_ntz, respondent string, respondent_name string, type string, type_name string, "
        "value_units string, value double",
    )


def test_fuel_mix_null_group_ties_and_shares(spark):
    facts = gen(spark, [
        ("A", 0, "Gas", 10.0), ("A", 1, "Solar", 10.0), ("A", 2, "Wind", None), ("A", 3, "Wind", None),
        ("Z", 0, "Gas", 0.0), ("Z", 1, "Coal", 0.0),
    ])
    mix = {(r.respondent, r.type_name): r for r in S.fuel_share(S.fuel_mix(facts)).collect()}
    assert mix[("A", "Wind")].mwh == 0.0                       # T1: all-null sums to 0
    assert mix[("A", "Gas")].fuel_rank == 1 and mix[("A", "Solar")].fuel_rank == 2  # T8 tie -> name
    assert mix[("A", "Gas")].share_pct == 50.0
    assert mix[("Z", "Gas")].share_pct == 0.0                   # total 0 -> 0 share


def test_range_summary_and_mix_summary(spark):
    facts = gen(spark, [("A", 0, "Gas", 3.0), ("A", 5, "Solar", 1.0)])
    r = S.range_summary(facts).first()
    assert (r.rows, r.period_start, r.period_end) == (2, "2024-01-01 00:00:00", "2024-01-01 05:00:00")
    m = S.mix_summary(facts).first()
    assert (m.region, m.top_fuel, m.top_fuel_pct) == ("A", "Gas", 75.0)
    assert m.summary_text == "A: Gas is the largest of 2 fuels at 75.0% of net generation."


def test_interchange_and_net_position(spark):
    facts = reg(spark, [
        ("A", 0, "D", 5.0), ("A", 0, "NG", 4.0), ("A", 0, "TI", -1.0),
        ("B", 0, "D", 5.0), ("B", 0, "TI", 0.0),
        ("C", 0, "D", 1.0), ("C", 0, "X", 9.0),
    ])
    np_ = {r.respondent: r for r in S.net_position(facts).collect()}
    assert np_["A"].position == "net importer" and np_["A"].total_interchange_mwh == -1.0
    assert np_["B"].position == "balanced" and np_["B"].net_generation_mwh is None
    assert np_["C"].position is None and np_["C"].total_interchange_mwh is None
    labels = {(r.respondent, r.type): r.series for r in S.interchange_totals(facts).collect()}
    assert labels[("A", "D")] == "demand_mwh" and labels[("C", "X")] == "X"  # fall-through


def _requests(spark, rows):
    return spark.createDataFrame(
        [(i, tool, json.dumps({"region": r, "start": s, "end": e})) for i, tool, r, s, e in rows],
        "request_id long, tool string, args string",
    )


def test_tools_dispatch_aliases_and_no_data(spark):
    facts = gen(spark, [("CISO", 0, "Gas", 1.25), ("CISO", 30, "Gas", 2.0), ("CISO", 50, "Solar", 0.15)])
    regf = reg(spark, [("CISO", 0, "D", 3.0), ("CISO", 0, "TI", 2.0), ("CISO", 0, "Q", 1.0)])
    req = _requests(spark, [
        (1, "get_generation", "caiso", "2024-01-01", "2024-01-02"),
        (2, "get_generation", "CISO", "2024-01-03", "2024-01-01"),     # reversed -> no data
        (3, "get_generation", "XXXX", "2024-01-01", "2024-01-05"),     # unknown region -> no data
        (4, "get_forecast", "CISO", "2024-01-01", "2024-01-02"),       # unknown tool
        (5, "get_demand_and_interchange", "cAiSo", "2024-01-01", "2024-01-01"),
        (6, "get_generation", "CISO", "2024-1-1", "2024-01-02"),       # not strict ISO -> no data
    ])
    out = TL.dispatch_requests(req, facts, regf)
    g = {(r.request_id, r.type_name): r for r in out["get_generation"].collect()}
    assert set(g) == {(1, "Gas")}                                    # hour 50 is on day 3
    assert g[(1, "Gas")].mwh == 3.3 and g[(1, "Gas")].rows == 2
    i = {r.type: r for r in out["get_demand_and_interchange"].collect()}
    assert set(i) == {"D", "TI"} and i["TI"].series == "total_interchange_mwh"   # facet drops Q
    assert [(r.request_id, r.error) for r in out["unknown"].collect()] == [(4, "unknown tool get_forecast")]
    nd = {r.request_id: r.note for r in out["no_data"].collect()}
    assert nd == {2: "no data for this range", 3: "no data for this range", 6: "no data for this range"}
    bounds = TL.tool_generation(TL.parse_requests(req.where("request_id = 1")), facts, bounds=True).first()
    assert (bounds.period_start, bounds.period_end) == ("2024-01-01 00:00:00", "2024-01-02 06:00:00")
    js = TL.tool_results_json(TL.tool_generation(TL.parse_requests(req.where("request_id = 1")), facts)).first()
    assert json.loads(js.result)["generation_mwh_by_fuel"] == {"Gas": 3.3}


def test_row_number_in_group_equals_window(spark):
    df = spark.range(0, 20000).select(
        (F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 11)).alias("g"),
        ((F.col("id") * 7919) % 20000).alias("k"),
    )
    got = row_number_in_group(df, ["g"], F.floor(F.col("k") / 64), ["k"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("g", "k", "rn").exceptAll(want.select("g", "k", F.col("rn").cast("long"))).count() == 0
    assert got.count() == 20000


def test_parse_requests_bad_json_gives_one_row_of_nulls(spark):
    reqs = spark.createDataFrame(
        [(1, "get_generation", json.dumps({"region": "caiso", "start": "2024-01-02", "end": "2024-01-03"})),
         (2, "get_generation", "not json"),
         (3, "get_generation", None)],
        "request_id long, tool string, args string",
    )
    got = {r.request_id: r for r in TL.parse_requests(reqs).collect()}
    assert len(got) == 3
    assert (got[1].region, got[1].start, got[1].end) == ("CISO", dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    for i in (2, 3):
        assert (got[i].region_raw, got[i].region, got[i].start, got[i].end) == (None, None, None, None)


def test_sums_of_tiny_and_huge_values(spark):
    tiny = gen(spark, [("A", h, "Gas", 4e-7) for h in range(10)])
    assert S.fuel_mix(tiny).first().mwh == 4e-6
    huge = gen(spark, [("A", 0, "Gas", 1e23), ("A", 1, "Gas", 2.0)])
    assert S.fuel_mix(huge).first().mwh == 2.0  # validation rejects such a record; here it counts as missing


def test_position_follows_the_reported_total(spark):
    from voltframe.plans.sql_functions import register_tool_functions

    facts = reg(spark, [("CISO", 0, "TI", 0.04), ("ERCO", 0, "TI", 0.06), ("PJM", 0, "TI", -0.05)])
    got = {r.respondent: r.position for r in S.net_position(facts).collect()}
    assert got == {"CISO": "balanced", "ERCO": "net exporter", "PJM": "net importer"}
    register_tool_functions(spark, gen(spark, [("CISO", 0, "Gas", 1.0)]), facts)
    for region, want in got.items():
        row = spark.sql(f"SELECT position FROM get_demand_and_interchange('{region}', '2024-01-01', '2024-01-02')").first()
        assert row.position == want


def test_summary_lines(spark):
    facts = gen(spark, [("A", 0, "Gas", 1234567.5), ("A", 5, "A very long fuel name indeed", 0.5)])
    lines = [r.line for r in S.summary_lines(facts).orderBy("line_no").collect()]
    assert lines == [
        "A: 2 rows",
        "  period:  2024-01-01 00:00:00 \u2192 2024-01-01 05:00:00",
        f"    {'Gas':<22} {1234567.5:>14,.0f} MWh  ({100.0:4.1f}%)",
        f"    {'A very long fuel name indeed':<22} {0.5:>14,.0f} MWh  ({0.0:4.1f}%)",
    ]


def test_a_request_for_thousands_of_years_makes_one_row(spark):
    facts = gen(spark, [("CISO", 0, "Gas", 1.0), ("CISO", 30, "Gas", 2.0)])
    req = _requests(spark, [(1, "get_generation", "CISO", "0001-01-01", "9999-12-31"), (2, "get_generation", "PJM", "0001-01-01", "9999-12-31")])
    parsed = TL.parse_requests(req)
    found = TL.range_totals(parsed.select("region", "start", "end"), facts, "type_name")
    assert found.count() == 1
    assert [r.rows for r in TL.tool_generation(parsed, facts).collect()] == [2]
    assert [r.request_id for r in TL.tool_no_data(parsed, facts, reg(spark, [("CISO", 0, "D", 1.0)])).collect()] == [2]


def test_dispatch_results_of_every_kind(spark):
    facts, regf = gen(spark, [("CISO", 0, "Gas", 1.26), ("CISO", 1, "Sun", 5.0)]), reg(spark, [("CISO", 0, "D", 3.0), ("CISO", 0, "TI", -2.0)])
    req = _requests(spark, [(1, "get_generation", "caiso", "2024-01-01", "2024-01-01"), (2, "get_demand_and_interchange", "CISO", "2024-01-01", "2024-01-01"),
                            (3, "get_generation", "PJM", "2024-01-01", "2024-01-01"), (4, "other", "PJM", "2024-01-01", "2024-01-01"), (5, None, "PJM", "x", "y")])
    got = {r.request_id: json.loads(r.result) for r in TL.dispatch_results(req, facts, regf).collect()}
    assert got[1] == {"region": "CISO", "rows": 2, "generation_mwh_by_fuel": {"Sun": 5.0, "Gas": 1.3}}
    assert got[2]["totals"] == {"demand_mwh": 3.0, "total_interchange_mwh": -2.0} and got[2]["convention"]
    assert got[3] == {"region": "PJM", "rows": 0, "note": TL.NOTE_NO_DATA}
    assert got[4] == {"error": "unknown tool other"} and got[5] == {"error": "unknown tool None"}
    single = {r.request_id: json.loads(r.result) for r in TL.dispatch_results(req, facts, regf, True, TL.NOTE_NO_DATA_RETURNED).collect()}
    assert single[1]["period_start"] == "2024-01-01 00:00:00" and single[3]["note"] == TL.NOTE_NO_DATA_RETURNED


def test_range_totals_equal_a_scan_per_request(spark):
    """Random sparse facts (days without any, null values, null fuels) and random ranges, repeated ids included."""
    rng = random.Random(4)
    hours = [(rng.choice("AB"), rng.choice([0, 24 * 3, 24 * 3 + 1, 24 * 40, 24 * 41 + 5, 24 * 400, 24 * 402]), rng.choice(["Gas", "Sun", None]), rng.choice([1.5, -2.5, None, 1e6])) for _ in range(60)]
    facts = gen(spark, hours)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in (-3, 0, 1, 3, 4, 39, 40, 41, 100, 400, 402, 500)]
    asked = [(i % 50, "get_generation", rng.choice("ABC"), str(rng.choice(days)), str(rng.choice(days))) for i in range(150)]
    parsed = TL.parse_requests(_requests(spark, asked))
    want = []
    for i, _, region, start, end in asked:
        inside = [(h, fuel, v) for r, h, fuel, v in hours if r == region and start <= str((dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)).date()) <= end]
        for fuel in {f for _, f, _ in inside}:
            own = [v for _, f, v in inside if f == fuel]
            at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h, _, _ in inside]
            want.append((i, region, len(inside), str(min(at)), str(max(at)), fuel, round(sum(v or 0.0 for v in own), 1) + 0.0))
    got = [(r.request_id, r.region, r.rows, r.period_start, r.period_end, r.type_name, r.mwh) for r in TL.tool_generation(parsed, facts).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    inside = lambda region, start, end: any(r == region and start <= str((dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)).date()) <= end for r, h, _, _ in hours)
    nothing = TL.tool_no_data(parsed, facts, reg(spark, [("A", 0, "D", 1.0)])).collect()
    assert sorted(r.request_id for r in nothing) == sorted(i for i, _, *rng_ in asked if not inside(*rng_))


def test_plans_of_the_tools_explode_no_days(spark):
    facts, regf = gen(spark, [("CISO", 0, "Gas", 1.0)]), reg(spark, [("CISO", 0, "D", 3.0)])
    parsed = TL.parse_requests(_requests(spark, [(1, "get_generation", "CISO", "2024-01-01", "2024-01-09")]))
    for df in (TL.tool_generation(parsed, facts), TL.tool_interchange(parsed, regf), TL.tool_no_data(parsed, facts, regf)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "BroadcastNestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
