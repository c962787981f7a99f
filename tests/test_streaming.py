from tallyloom.streaming import intake


def test_rows_are_routed_as_they_arrive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "PMT_NO,INV_NO,CUST_ID,PMT_DT,AMT,PMT_METHOD_CD\n"
    out = [f"{tmp_path}/{x}" for x in ("clean", "bad", "check")]
    for k, body in enumerate(["P1,I1,C1,2024-01-01,5,CASH\nP2,I1,C1,TBD,5,CASH\n", "P3,I1,C1,01/02/2024,x,--\n"]):
        (source / f"{k}.csv").write_text(head + body)
        intake.route(intake.read_stream(spark, str(source), "payment"), "payment", "erp", *out).awaitTermination()
    assert [(r.business_key, str(r.payment_date)) for r in spark.read.parquet(out[0]).collect()] == [("P1", "2024-01-01")]
    assert sorted(r.reason_code for r in spark.read.parquet(out[1]).collect()) == ["schema_invalid", "unparseable_date"]
