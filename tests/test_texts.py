"""Request texts, sheets and their files, against lists of what each line says."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quotemill.functions import tokens
from quotemill.operators import records, requests, sheets, text_requests
from quotemill.sources import files, sinks


def _items(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    return text_requests.parsed(frame).orderBy("doc_id", "line_no").collect()


LINES = [
    ("STM32F103C8T6 x 500", "STM32F103C8T6", 500), ("500 pcs STM32F103C8T6", "STM32F103C8T6", 500), ("STM32F103C8T6, qty: 500", "STM32F103C8T6", 500),
    ("quantity 500 of STM32F103C8T6", "STM32F103C8T6", 500), ("need 500 STM32F103C8T6", "STM32F103C8T6", 500), ("STM32F103C8T6\t500", "STM32F103C8T6", 500),
    ("STM32F103C8T6; 500; asap", "STM32F103C8T6", 500), ("1) LM358N x 20", "LM358N", 20), ("* LM358N x 30", "LM358N", 30), ("LM358N x 1,000", "LM358N", 1000),
    ("BZX84-C10,215 x 5000", "BZX84-C10,215", 5000), ("LM358N target $2.50 need 40", "LM358N", 40), ("LM358N at $1,200 pcs", "LM358N", None),
    ("LM358N x 1,200.50", "LM358N", None), ("LM358N x 0 need 7", "LM358N", 7), ("LM358N", "LM358N", None), ("please quote soon", None, None), ("12 pcs", None, None),
]


def test_lines(spark):
    got = _items(spark, *[text for text, *_ in LINES])
    assert [(r.input_string, r.quantity) for r in got] == [(part, n) for _, part, n in LINES]


def test_whole_text(spark):
    text = "From: a@b.c\r\nSubject: LM358N\nHi,\n\nLM358N x 3\n> ABC123-X x 4\nOn Friday Bo wrote:\n=====\nPart number  Qty\nABC123-X x 5\nRegards,\n--\nXYZ999-A x 6\n"
    got = _items(spark, text, None, "", "LM358N x 1\rABC123-X x 2")
    kinds = [(r.doc_id, r.line_no, r.kind) for r in got]
    assert kinds[:11] == [(0, 1, "header"), (0, 2, "header"), (0, 3, "greeting"), (0, 5, "item"), (0, 6, "quoted"), (0, 7, "quoted"), (0, 8, "rule"), (0, 9, "table_header"), (0, 10, "item"), (0, 11, "sign_off"), (0, 12, "signature")]
    assert [k for d, _, k in kinds if d == 0][11:] == ["signature"] and kinds[12:] == [(3, 1, "item"), (3, 2, "item")]
    frame = spark.createDataFrame([(0, text)], "doc_id long, raw_text string")
    told = text_requests.diagnostics(frame).first()
    assert (told.lines_read, told.quoted_lines, told.signature_stripped) == (13, 2, True)
    assert [r.kind for r in text_requests.parsed(spark.createDataFrame([(0, "LM358N\n" * 4)], "doc_id long, raw_text string"), most=2).collect()].count("over") == 2


@pytest.mark.parametrize("token", ["STM32F103C8T6", "1N4148W", "BZX84-C10,215", "lm358n", "MCP645-I/SN", "(LM317T)"])
def test_parts_are_told(spark, token):
    row = spark.range(1).select(tokens.token_score(tokens.stripped(F.lit(token))).alias("s")).first()
    assert row.s >= 0.5


@pytest.mark.parametrize("token", ["hello", "12345", "$2.50", "2024-01-05", "10:30", "a@b.co", "www.x1.com", "500pcs", "COVID19", "ROHS", "+1 555 123 4567", "abc", "x" * 20 + "1" * 20])
def test_others_are_not(spark, token):
    assert spark.range(1).select(tokens.token_score(tokens.stripped(F.lit(token))).alias("s")).first().s < 0.5


CLEAN = [("MPN", "Desc", "Qty"), ("STM32F103C8T6", "mcu", 500), ("LM358N", "amp", 2500), ("BZX84C10", "zener", 10000)]
MESSY = [("ACME",), (), ("Quote 2024",), (), ("Qty", "Part #", "Each"), (10, "LM358N", 2.5), (20, "ABC123-X", 3), ("", "note", ""), (30, "XYZ99-1A", 4)]


def _workbook(path, tables, merged=()):
    def cell(r, c, v):
        at = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{float(v)}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as pack:
        names = list(tables)
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        pack.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        pack.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = "".join("<row>" + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(tables[n]))
            more = "<mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells>" if merged else ""
            pack.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData>{more}</worksheet>")


def test_workbooks_and_texts(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", {"Clean": CLEAN, "Notes": [("nothing", "here")]})
    _workbook(tmp_path / "b.bin", {"Rev A": [("LM358N", "x")], "Rev C": MESSY}, merged=("B6:B7",))
    (tmp_path / "c.txt").write_bytes("LM358N x 3 für 5 €".encode())
    (tmp_path / "d.eml").write_bytes("LM358N für".encode("latin-1"))
    (tmp_path / "e.xlsx").write_bytes(b"no workbook")
    found = files.uploads(spark, str(tmp_path))
    assert {r.raw_text for r in files.texts(found).collect()} == {"LM358N x 3 für 5 €", "LM358N für"}
    cells = files.sheet_cells(found).select("file", F.concat_ws("/", F.element_at(F.split("file", "/"), -1), "sheet").alias("sheet"), "position", "row", "col", "text").persist()
    layout = {r.sheet: r for r in sheets.layout(cells).collect()}
    assert set(layout) == {"a.xlsx/Clean", "b.bin/Rev A", "b.bin/Rev C"}
    clean, messy = layout["a.xlsx/Clean"], layout["b.bin/Rev C"]
    assert (clean.part_letter, clean.quantity_letter, clean.first_row, clean.part_header, clean.quantity_header) == ("A", "C", 1, "MPN", "Qty")
    assert (messy.part_letter, messy.quantity_letter, messy.first_row, messy.quantity_header) == ("B", "A", 5, "Qty")
    items = sorted((r.sheet, r.row, r.input_string, r.quantity) for r in sheets.items(cells).collect())
    assert items[:3] == [("a.xlsx/Clean", 2, "STM32F103C8T6", 500), ("a.xlsx/Clean", 3, "LM358N", 2500), ("a.xlsx/Clean", 4, "BZX84C10", 10000)]
    assert items[3] == ("b.bin/Rev A", 1, "LM358N", None) and [x[3] for x in items[4:]] == [10, 20, 30]
    counts = sheets.items(cells).groupBy("sheet").agg(F.count("*").alias("items"))
    each = cells.select("file", "sheet", "position").distinct().join(counts, "sheet", "left").fillna({"items": 0})
    assert {r.sheet for r in sheets.best_sheet(each).collect()} == {"a.xlsx/Clean", "b.bin/Rev C"}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "cases.json").write_text('{"cases": [{"id": 1, "input": "lm358", "expected_mpn": "LM358N", "kind": "truncation"}, {"id": 2, "input": "q", "kind": "nonexistent"}]}')
    assert [(r.id, r.expected_mpn) for r in files.cases(spark, str(tmp_path / "cases.json")).orderBy("id").collect()] == [(1, "LM358N"), (2, None)]
    found = spark.createDataFrame([("A", 78, "naive", 1.23456789, 2.0, "Active", "SRAM", True), ("A", 79, "gbm", 1.0, 2.0, "EOL", "", None)], "part_mpn string, week_index int, model string, actual double, predicted double, lifecycle string, category string, during_spike boolean")
    sinks.predictions(found, str(tmp_path / "p"))
    assert sorted((r.week_index, r.actual, r.during_spike) for r in files.predictions(spark, str(tmp_path / "p")).collect()) == [(78, 1.234568, 1), (79, 1.0, 0)]
    parts = spark.createDataFrame([("A", 1), ("B", 2)], "mpn string, n int")
    sinks.catalog(parts, str(tmp_path / "catalog"))
    with pytest.raises(ValueError, match="A"):
        sinks.catalog(parts.unionByName(parts.limit(1)), str(tmp_path / "catalog"))
    assert spark.read.parquet(str(tmp_path / "catalog")).count() == 2
    lines = spark.createDataFrame([(1, 0, 0.0, [("x", 5)]), (1, 1, 2.0, None)], "rfq_id int, place int, price_p50 double, risk_reasons array<struct<code:string,points:int>>")
    sinks.requests(lines, str(tmp_path / "lines"))
    assert sorted((r.line_no, r.price_p50, r.risk_reasons) for r in spark.read.parquet(str(tmp_path / "lines")).collect()) == [(1, None, '[{"code":"x","points":5}]'), (2, 2.0, "[]")]
    assert requests.restored(spark.read.parquet(str(tmp_path / "lines"))).where("line_no = 1").first().risk_reasons[0].points == 5
    assert spark.range(1).select(sinks.raw_input(F.lit("a.xlsx"), F.array(F.lit("x"), F.lit(None), F.lit(""), F.lit("y"))).alias("t")).first().t == "a.xlsx\nx\ny"
    assert files.counts(spark, ["no_such_table"]) == {"no_such_table": None}
    q = spark.createDataFrame([("B", 2), ("A", 1)], "part_mpn string, week_start int")
    sinks.quotes(q, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_records_of_a_feed(spark, tmp_path):
    page = '{"Parts": [{"ManufacturerPartNumber": "R1", "Category": "Thin Film Resistors", "Description": "RCA0402 22K 5% 200 ET7", "ProductAttributes": []}, {"ManufacturerPartNumber": "R1", "Category": "SRAM"}, {"Category": "SRAM"}, {"ManufacturerPartNumber": "K1", "Category": "Resistor Kits"}, {"ManufacturerPartNumber": "S1", "Category": "SRAM", "Description": "x"}]}'
    (tmp_path / "p1.json").write_text(page)
    got = records.parts(files.feed(spark, str(tmp_path))).collect()
    assert [(r.mpn, r.category, r.specs, r.lifecycle_status, r.authorized_stock, r.price_tier) for r in got] == [("R1", "Fixed Resistors", {"tolerance_pct": 5.0}, "Active", 0, "mid")]


DESCRIPTIONS = [
    ("Fixed Resistors", "0603 thin film res, 0.1%, 25ppm 2KOhm", {"tolerance_pct": 0.1, "tcr_ppm": 25.0, "resistance_ohm": 2000.0}),
    ("Fixed Resistors", "ERJ-PC3B2001V .680 Ohm 60-V", {"resistance_ohm": 0.68, "voltage_rating_v": 60.0}),
    ("Fixed Capacitors", "330UF   50V 10%  T4R esr 5 mOhm", {"capacitance_pf": 330e6, "voltage_rating_v": 50.0, "tolerance_pct": 10.0, "esr_mohm": 5.0}),
    ("Voltage Regulators", "output voltage 1.8V, dropout voltage of 300 mV", {"output_voltage_v": 1.8, "input_voltage_max_v": 1.8, "dropout_mv": 300.0}),
    ("Power FETs", "60-V P-channel, gate threshold 1.5V, Qg 20 nC, leakage 1 uA", {"vds_max_v": 60.0, "vgs_threshold_v": 1.5, "gate_charge_nc": 20.0}),
    ("Microcontrollers", "MCU 32KB,20MHz,85C,1.62V", {"flash_kb": 32.0, "max_freq_mhz": 20.0, "operating_voltage.min_v": 1.62, "temp_range.max_c": 85.0}),
    ("Crystal Oscillators", "38.4000MHZ 20ppm tolerance at room temperature, stability 10 PPM -40C", {"frequency_mhz": 38.4, "frequency_tolerance_ppm": 20.0, "stability_ppm": 10.0, "temp_range.min_c": -40.0}),
    ("SRAM", "4 V", {}),
]


def test_descriptions(spark):
    from quotemill.functions import descriptions

    tried = spark.createDataFrame(descriptions.patterns(), descriptions.PATTERNS)
    rows = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(DESCRIPTIONS)], "i int, category string, text string").join(tried, "category", "left")
    got = {r.i: r.found for r in rows.select("i", descriptions.described(F.col("text"), F.col("patterns")).alias("found")).collect()}
    for i, (_, text, want) in enumerate(DESCRIPTIONS):
        assert got[i] == want, text


def test_requests_and_lines_are_saved_together(spark, tmp_path, monkeypatch):
    """A writer killed between both leaves nothing; names are unique over all saves; of two at once one checks anew."""
    store = sinks.RequestStore(spark, str(tmp_path / "store"))
    heads = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "rfq_id long, raw_input string")
    lines = lambda *rows: spark.createDataFrame([(i, p, 0.0, ["r"]) for i, p in rows], "rfq_id long, place int, price_p50 double, risk_reasons array<string>")
    assert store.headers() is None and store.lines() is None
    assert store.save(heads(1, 2), lines((1, 0), (1, 1), (2, 0))) == 1

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.save(heads(3), lines((3, 0)))
    assert {r.rfq_id for r in store.headers().collect()} == {1, 2} and store.lines().count() == 3
    for bad in ((heads(2), lines()), (heads(4, 4), lines()), (heads(4), lines((4, 0), (4, 0))), (heads(4), lines((5, 0)))):
        with pytest.raises(ValueError):
            store.save(*bad)
    own, overtaken = store._publish, []

    def slow(number, batch):
        if not overtaken:
            overtaken.append(number)
            sinks.RequestStore(spark, store.folder).save(heads(7), lines((7, 0)))
        return own(number, batch)

    monkeypatch.setattr(store, "_publish", slow)
    assert store.save(heads(3), lines((3, 0), (3, 1))) == 3
    assert {r.rfq_id for r in store.headers().collect()} == {1, 2, 3, 7}
    row = store.lines().where("rfq_id = 3 AND line_no = 2").first()
    assert row.price_p50 is None and row.risk_reasons == '["r"]'
    overtaken.clear()
    with pytest.raises(ValueError):
        store.save(heads(7), lines((7, 0)))
