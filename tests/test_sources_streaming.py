import hashlib
import json
from datetime import date, datetime
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, quality
from tidemark.sources import actions, filings_files, layout, quotes
from tidemark.streaming import events


def test_quote_line(spark, tmp_path):
    line = "01" + "20260821" + "02" + "TEST3".ljust(12) + "010" + "AÇÃO".ljust(12) + "ON NM".ljust(10) + "   " + "R$  "
    line += "0" * 13 * 4 + "0000000001280" + "0" * 26 + "00123" + "000000000000010000" + "000000000123450000" + "0" * 13 + " " + "99991231" + "0000001" + "0" * 13
    line += "BRTESTACNOR1" + "001"
    assert len(line) == 245
    (tmp_path / "q.txt").write_bytes((line + "\n" + "99" + line[2:] + "\n" + line[:100] + "\n" + line.replace("010AÇ", "020AÇ") + "\n").encode("latin-1"))
    row, = quotes.read_quotes(spark, str(tmp_path / "q.txt")).collect()
    assert (row["trade_date"], row["ticker"], row["close"], row["trades"], row["quantity"]) == (date(2026, 8, 21), "TEST3", 12.8, 123, 10000)
    assert row["traded_value_brl"] == row["volume"] == 1_234_500.0 and row["issuer_short_name"] == "AÇÃO" and row["distribution_number"] == 1


def test_action_payload_shapes(spark, tmp_path):
    body = {
        "cashDividends": [{"label": " dividendo", "rate": "5,00", "lastDatePrior": "02/01/2024", "assetIssued": "brx"}, {"label": "OTHER", "rate": "1", "lastDatePrior": "02/01/2024", "assetIssued": "BRX"},
                          {"label": "DIVIDENDO", "rate": "0", "lastDatePrior": "02/01/2024", "assetIssued": "BRX"}],
        "stockDividends": [{"label": "DESDOBRAMENTO", "factor": "1.100,00", "lastDatePrior": "2024-01-03", "isinCode": "BRX"}],
    }
    for name, text in (("ABCD_1.json", json.dumps(body)), ("ABCD_2.json", json.dumps([body])), ("ABCD_3.json", json.dumps(json.dumps(body)))):
        (tmp_path / name).write_text(text)
    out = actions.read_action_payloads(spark, str(tmp_path)).orderBy("last_date_prior").collect()
    assert [(r["isin"], r["action_type"], r["last_date_prior"], r["cash_amount"], r["share_factor"]) for r in out] == [
        ("BRX", "cash_dividend", date(2024, 1, 2), 5.0, None), ("BRX", "stock_split", date(2024, 1, 3), None, 1100.0)
    ]
    assert out[0]["issuer_root"] == "ABCD"


HEADER = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;CD_CONTA;DS_CONTA;VL_CONTA;MOEDA;ESCALA_MOEDA\n"


def test_statements(spark, tmp_path):
    (tmp_path / "s").mkdir()
    rows = '1;2023-12-31;1;Á;9;3.01;Receita "líquida;1000,00;REAL;MIL\n1;2023-12-31;1;Á;9;3.11;Lucro;2.500,00;REAL;UNIDADE\n'
    (tmp_path / "s" / "dfp_cia_aberta_DRE_con_2023.csv").write_bytes((HEADER + rows).encode("latin-1"))
    (tmp_path / "meta.csv").write_bytes(b"CNPJ_CIA;DT_REFER;VERSAO;DT_RECEB\n1;2023-12-31;1;2024-03-10\n1;2023-12-31;1;2024-03-01\n")
    out = filings_files.read_statements(spark, str(tmp_path / "s"), str(tmp_path / "meta.csv")).orderBy("CD_CONTA").collect()
    assert [r["VL_CONTA"] for r in out] == [1_000_000.0, 2500.0] and [r["raw_VL_CONTA"] for r in out] == [1000.0, 2500.0]
    assert out[0]["DT_RECEB"] == date(2024, 3, 1) and out[0]["DS_CONTA"] == 'Receita "líquida' and out[0]["STATEMENT_TYPE"] == "DRE" and out[0]["year"] == 2023
    (tmp_path / "s" / "dfp_cia_aberta_BPA_con_2023.csv").write_bytes((HEADER + "1;2023-12-31;1;A;9;1;Ativo;1,0;DOLAR;MIL\n").encode("latin-1"))
    with pytest.raises(quality.DataQualityError, match="currency"):
        filings_files.read_statements(spark, str(tmp_path / "s"), str(tmp_path / "meta.csv"))


def test_empty_statement_and_period_word(spark, tmp_path):
    (tmp_path / "x_DRE_con_2023.csv").write_text(HEADER)
    (tmp_path / "meta.csv").write_text("CNPJ_CIA;DT_REFER;VERSAO;DT_RECEB\n")
    out = filings_files.read_statements(spark, str(tmp_path / "x_DRE_con_2023.csv"), str(tmp_path / "meta.csv"))
    assert out.count() == 0 and dict(out.dtypes)["VERSAO"] == "bigint"
    words = spark.createDataFrame([("ÚLTIMO", 1.0), ("PENÚLTIMO", 2.0), ("ULT", 3.0)], "ORDEM_EXERC string, VL_CONTA double")
    assert sorted(r["value"] for r in filings_files.to_facts(words).collect()) == [1.0, 3.0]


def test_registry_bridge(spark, tmp_path):
    files = {
        "cad": "CNPJ_CIA;CD_CVM;DENOM_SOCIAL;DT_REG;DT_CANCEL\n11.111.111/0001-11;88888;OLD;1990-01-01;2000-01-01\n11.111.111/0001-11;99999;NEW;2010-01-01;\n",
        "val": "CNPJ_Companhia;Código_Negociação;Mercado;Data_Inicio_Negociacao;Data_Fim_Negociacao;Data_Referencia\n11.111.111/0001-11;abcd3;B;2012-01-01;;2013-01-01\n11.111.111/0001-11;BAD;B;2012-01-01;;2013-01-01\n",
        "ger": "CNPJ_Companhia;Data_Referencia;Setor_Atividade\n11.111.111/0001-11;2011-06-01;Indústria\n11.111.111/0001-11;2015-06-01;Other\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode("latin-1"))
    b = filings_files.historical_bridge(
        filings_files.read_registry(spark, str(tmp_path / "cad.csv")), filings_files.read_ticker_history(spark, str(tmp_path / "val.csv")), filings_files.read_sector_history(spark, str(tmp_path / "ger.csv"))
    )
    row, = b.collect()
    assert (row["ticker"], row["issuer_id"], row["sector"], row["valid_to"]) == ("ABCD3", "99999", "Indústria", date(2999, 12, 31))


def test_reviewed_bridge_and_macro(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,CD_CVM,valid_from,valid_to,sector\nT,123,2020-01-01,2023-01-01,S\nT,456,2022-01-01,,S\n")
    with pytest.raises(quality.DataQualityError, match="overlapping"):
        filings_files.read_bridge(spark, str(tmp_path / "b.csv"))
    (tmp_path / "m.json").write_text(json.dumps([{"data": "02/01/2025", "valor": "12,25"}]))
    row, = filings_files.read_macro(spark, str(tmp_path / "m.json"), "432").collect()
    assert (row["date"], row["value"], row["series_code"]) == (date(2025, 1, 2), 12.25, "432")


def test_layout(spark, tmp_path):
    root = str(tmp_path / "p")
    a = spark.createDataFrame([("A", 2020, 1.0), ("B", 2021, 2.0)], "ticker string, year int, close double")
    layout.write_partitioned(a, root)
    layout.write_partitioned(spark.createDataFrame([("C", 2021, 3.0, 9)], "ticker string, year int, close double, extra long"), root)
    got = sorted((r["ticker"], r["year"], r["extra"]) for r in layout.read_partitions(spark, str(tmp_path / "none"), root).collect())
    assert got == [("A", 2020, None), ("C", 2021, 9)]
    with pytest.raises(FileNotFoundError):
        layout.read_partitions(spark, str(tmp_path / "none"))
    snap = str(tmp_path / "snap")
    for day, score in (("2024-01-31", 1.0), ("2024-02-29", 2.0), ("2024-01-31", 5.0)):
        layout.publish_snapshot(spark.createDataFrame([(day, "A", score)], "as_of string, ticker string, score double"), snap)
    assert sorted(r["score"] for r in spark.read.parquet(snap).collect()) == [2.0, 5.0]
    exp = str(tmp_path / "exp")
    ids = {layout.append_experiment(spark, exp, ["f"], {"a": 1}, {}, [2020], {"ic": 0.1}) for _ in range(2)}
    assert {r["experiment_id"] for r in spark.read.parquet(exp).collect()} == ids
    (tmp_path / "f.bin").write_bytes(b"abc")
    row, = layout.file_manifest(spark, str(tmp_path / "f.bin")).collect()
    assert row["bytes"] == 3 and row["sha256"].startswith("ba7816bf")


def test_manifest_reads_files_in_blocks(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    bodies = {"empty.zip": b"", "a b%20c.gz": b"\xef\xbb\xbfnot packed\r\n", "large.bin": bytes(range(256)) * (layout.DIGEST_BLOCK // 128) + b"x"}
    for name, body in bodies.items():
        (landed / name).write_bytes(body)
    got = {unquote(r["source"].rsplit("/", 1)[1]): (r["sha256"], r["bytes"]) for r in layout.file_manifest(spark, str(landed)).collect()}
    assert got == {name: (hashlib.sha256(body).hexdigest(), len(body)) for name, body in bodies.items()}


def test_a_retried_run_leaves_one_record(spark, tmp_path):
    root, log = str(tmp_path / "snap"), str(tmp_path / "runs")
    record = dict(features=["f"], parameters={"a": 1}, training_window={}, validation_folds=[2020], metrics={"ic": 0.1})
    rows = "as_of string, ticker string, score double"
    layout.publish_run(spark.createDataFrame([("2024-01-31", "A", 1.0), ("2024-02-29", "A", 2.0)], rows), root, log, "007", **record)
    for _ in range(2):
        layout.publish_run(spark.createDataFrame([("2024-02-29", "B", 3.0)], rows), root, log, "1e5", **record)
    assert sorted((r["ticker"], r["score"]) for r in spark.read.parquet(root).collect()) == [("A", 1.0), ("B", 3.0)]
    runs = layout.read_experiments(spark, log).collect()
    assert sorted(r["experiment_id"] for r in runs) == ["007", "1e5"] and all(r["features"] == ["f"] for r in runs)


def test_quarantine(spark):
    rows = [(date(2024, 1, 1), "AAAA3", 1.0), (date(2024, 1, 1), "AAAA3", 0.0), (date(2024, 1, 2), "BBBB3", None), (date(2024, 1, 2), "AAAA3", 2.0)]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, close double")
    good, side = layout.quarantine_prices(df)
    assert [r["close"] for r in good.collect()] == [2.0] and side.count() == 2
    kept, out = layout.quarantine_issuers(df, spark.createDataFrame([("BBBB",)], "issuer_root string"))
    assert kept.count() == 3 and [r["quarantine_reason"] for r in out.collect()] == ["missing_action_coverage"]


EVENT = "day date, user_id long, ts timestamp, value double"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 1, 0, 2, 2)])
def test_upsert_does_not_depend_on_arrival(spark, tmp_path, order):
    files = [
        [(date(2024, 1, 1), 1, datetime(2024, 1, 1, 1), 1.0), (date(2024, 1, 2), 1, datetime(2024, 1, 2, 1), 1.5)],
        [(date(2024, 1, 1), 1, datetime(2024, 1, 1, 9), 2.0)],
        [(date(2024, 1, 1), 1, datetime(2024, 1, 1, 5), 3.0), (date(2024, 1, 1), 2, datetime(2024, 1, 1, 5), 4.0)],
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    for i in order:
        spark.createDataFrame(files[i], EVENT).coalesce(1).write.mode("append").parquet(source)
        events.ingest(spark.readStream.schema(EVENT).parquet(source), root, str(tmp_path / "state"), "day", ["day", "user_id"], ["ts"])
    got = sorted((str(r["day"]), r["user_id"], r["value"]) for r in spark.read.parquet(root).collect())
    assert got == [("2024-01-01", 1, 2.0), ("2024-01-01", 2, 4.0), ("2024-01-02", 1, 1.5)]


def test_streaming_hysteresis_equals_batch(spark, tmp_path):
    schema = "strategy string, trade_date date, ticker string, rank long"
    batches = [[("s", date(2024, m, 28), t, i + 1) for i, t in enumerate(ts)] for m, ts in ((1, "ABCD"), (2, "CADB"), (3, "DEFA"))]
    source = str(tmp_path / "in")
    collected = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = events.hysteresis_stream(spark.readStream.schema(schema).parquet(source), 2, 1)
        query = stream.writeStream.foreachBatch(lambda df, _: collected.extend((r["trade_date"], r["ticker"]) for r in df.collect())).outputMode("append")
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(collected) == sorted((r["trade_date"], r["ticker"]) for r in book.hysteresis_selection(whole, 2, 1).collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_late_events_are_not_lost(spark, tmp_path, order):
    days = [[(date(2024, 1, 1 + 9 * f), u, datetime(2024, 1, 1 + 9 * f, h), 1.0) for u in range(4) for h in (3, 5)] for f in range(3)]
    source = str(tmp_path / "in")
    for i in order:
        spark.createDataFrame(days[i], EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    events.ingest(stream, str(tmp_path / "table"), str(tmp_path / "state"), "day", ["day", "user_id"], ["ts"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 12
    query = events.deduplicated(stream, ["day", "user_id"]).writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "s2"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 12


def test_event_queries_read_a_folder_of_files(spark, tmp_path):
    from tidemark.plans import QUERIES

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.orderBy(F.col("ts").desc()).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    expected = table.select("user_id", "event_type", F.col("ts").cast("date")).distinct().count()
    assert QUERIES["stream_dedupe"](spark, str(tmp_path)).count() == QUERIES["stream_upsert"](spark, str(tmp_path)).count() == expected


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tidemark import session

    context = SimpleNamespace(master="spark://head:7077", getConf=lambda: {}, applicationId="x")
    with pytest.raises(ValueError, match="share"):
        session.shared_folder(SimpleNamespace(conf={}, sparkContext=context))


def test_checked_join_stops_on_a_repeated_key(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k long, y string")
    assert quality.checked_join(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="right side has a key more than once"):
        quality.checked_join(left, right.unionAll(right), ["k"]).collect()
    with pytest.raises(Exception, match="left side has a key more than once"):
        quality.checked_join(left, right, ["k"], one_to_one=True).collect()
