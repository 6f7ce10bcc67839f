"""Distributors' records to catalog parts: category, lifecycle, stock, tier, and specs from attributes and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import descriptions, units

#: Names of a supply voltage's low end, its high one, and both, in the order in which they are asked for.
_OPERATING = (
    ["supplyvoltagemin", "operatingsupplyvoltagemin", "voltagesupplymin"], ["supplyvoltagemax", "operatingsupplyvoltagemax", "voltagesupplymax"],
    ["supplyvoltage", "operatingsupplyvoltage", "voltagesupply"],
)
_SUPPLY = (
    ["supplyvoltagemin", "voltagesupplymin", "operatingsupplyvoltagemin"], ["supplyvoltagemax", "voltagesupplymax", "operatingsupplyvoltagemax"],
    ["supplyvoltage", "voltagesupply", "operatingsupplyvoltage"],
)
#: By category and field, names of the attribute that tells it, the scale to the field's unit, and whether it is a whole number.
FIELDS: dict[str, dict[str, tuple[list[str], float, bool]]] = {
    "Microcontrollers": {
        "flash_kb": (["programmemorysize", "flashsize", "programmemory", "memorysize"], 1e-3, False), "ram_kb": (["ramsize", "datarammemorysize", "ram"], 1e-3, False),
        "max_freq_mhz": (["maximumclockfrequency", "clockfrequency", "cpuspeed", "speed"], 1e-6, False),
        "gpio_count": (["numberofios", "numberofiolines", "numberofinputsoutputs"], 1.0, True), "adc_bits": (["adcresolution", "resolution", "dataconverters"], 1.0, True),
    },
    "Operational Amplifiers": {
        "channels": (["numberofchannels", "numberofcircuits", "numberofamplifiers"], 1.0, True), "gbw_mhz": (["gainbandwidthproduct", "gainbandwidth", "bandwidth"], 1e-6, False),
        "slew_rate_v_us": (["slewrate"], 1.0, False), "input_offset_uv": (["inputoffsetvoltage", "offsetvoltage"], 1e6, False),
        "quiescent_current_ua": (["currentquiescent", "quiescentcurrent", "supplycurrent"], 1e6, False),
    },
    "Fixed Capacitors": {
        "capacitance_pf": (["capacitance"], 1e12, False), "tolerance_pct": (["capacitancetolerance", "tolerance"], 1.0, False),
        "voltage_rating_v": (["voltageratingdc", "dcvoltagerating", "voltagerating", "ratedvoltage"], 1.0, False), "esr_mohm": (["equivalentseriesresistance", "esr"], 1e3, False),
    },
    "Fixed Resistors": {
        "resistance_ohm": (["resistance"], 1.0, False), "tolerance_pct": (["resistancetolerance", "tolerance"], 1.0, False), "power_rating_w": (["powerrating", "powerdissipation", "power"], 1.0, False),
        "tcr_ppm": (["temperaturecoefficient", "tcr"], 1.0, False), "voltage_rating_v": (["maximumworkingvoltage", "workingvoltage", "voltagerating"], 1.0, False),
    },
    "Logic Gates": {
        "channels": (["numberofcircuits", "numberofelements", "numberofgates", "numberofchannels"], 1.0, True),
        "propagation_delay_ns": (["propagationdelaytime", "propagationdelay"], 1e9, False), "output_current_ma": (["outputcurrent", "outputcurrenthigh", "currentoutput"], 1e3, False),
    },
    "Zener Diodes": {
        "zener_voltage_v": (["zenervoltage", "nominalzenervoltage", "voltagezener", "breakdownvoltage"], 1.0, False), "power_dissipation_mw": (["powerdissipation", "power"], 1e3, False),
        "tolerance_pct": (["zenervoltagetolerance", "tolerance"], 1.0, False), "reverse_leakage_ua": (["reverseleakagecurrent", "leakagecurrent"], 1e6, False), "forward_voltage_v": (["forwardvoltage"], 1.0, False),
    },
    "Power FETs": {
        "vds_max_v": (["drainsourcevoltagevdss", "drainsourcevoltage", "drainsourcebreakdownvoltage", "vdss"], 1.0, False),
        "id_continuous_a": (["continuousdraincurrentid", "currentcontinuousdrain", "draincurrent"], 1.0, False), "rds_on_mohm": (["drainsourceonresistancerdson", "onresistance", "rdson"], 1e3, False),
        "vgs_threshold_v": (["gatethresholdvoltage", "gatesourcevoltage", "vgsth"], 1.0, False), "gate_charge_nc": (["totalgatecharge", "gatecharge", "qg"], 1e9, False),
    },
    "Voltage Regulators": {
        "output_voltage_v": (["outputvoltage", "voltageoutput", "outputvoltagefixed"], 1.0, False), "input_voltage_max_v": (["maximuminputvoltage", "inputvoltagemax", "voltageinputmax", "inputvoltage"], 1.0, False),
        "output_current_max_a": (["maximumoutputcurrent", "outputcurrent", "currentoutput"], 1.0, False), "dropout_mv": (["dropoutvoltage"], 1e3, False),
        "efficiency_pct": (["efficiency"], 1.0, False), "quiescent_current_ua": (["quiescentcurrent", "currentquiescent"], 1e6, False),
    },
    "FPGAs": {
        "logic_elements": (["numberoflogicelementscells", "numberoflogicelements", "numberoflogicblocks", "logiccells"], 1.0, True), "block_ram_kb": (["totalrambits", "rambits", "embeddedmemory"], 1e-3, False),
        "dsp_blocks": (["numberofdspblocks", "dspblocks", "numberofmultipliers"], 1.0, True), "user_io_count": (["numberofuserios", "numberofios", "numberofinputsoutputs"], 1.0, True),
        "core_voltage_v": (["corevoltage", "voltagesupplycore", "supplyvoltagecore"], 1.0, False),
    },
    "SRAM": {"density_kbit": (["memorysize", "density", "memorydensity"], 1e-3, False), "access_time_ns": (["maximumaccesstime", "accesstime"], 1e9, False)},
    "Flash Memory": {
        "density_mbit": (["memorysize", "density", "memorydensity"], 1e-6, False), "max_clock_mhz": (["maximumclockfrequency", "clockfrequency", "frequency", "speed"], 1e-6, False),
        "erase_cycles": (["endurance", "erasecycles", "writecycles"], 1.0, True), "page_size_bytes": (["pagesize"], 1.0, True), "data_retention_years": (["dataretention"], 1.0, True),
    },
    "MIL-Spec Circular Connectors": {
        "shell_size": (["shellsize"], 1.0, True), "contact_count": (["numberofcontacts", "numberofpositions", "contactcount"], 1.0, True),
        "service_rating_v": (["servicerating", "voltagerating"], 1.0, False), "mating_cycles": (["matingcycles", "durability"], 1.0, True),
    },
    "Crystal Oscillators": {
        "frequency_mhz": (["nominalfrequency", "outputfrequency", "frequency"], 1e-6, False), "frequency_tolerance_ppm": (["frequencytolerance", "tolerance"], 1.0, False),
        "load_capacitance_pf": (["loadcapacitance"], 1e12, False), "esr_ohm": (["equivalentseriesresistance", "esr"], 1.0, False), "stability_ppm": (["frequencystability", "stability"], 1.0, False),
    },
}
#: Fields of two ends, by the categories that have them: names of the low end, of the high one, and of both in one text.
RANGES = [
    ("operating_voltage", ["Microcontrollers"], ("min_v", "max_v"), *_OPERATING),
    ("supply_voltage", ["Operational Amplifiers"], ("min_v", "max_v"), *_OPERATING),
    ("supply_voltage", ["Logic Gates", "SRAM"], ("min_v", "max_v"), *_SUPPLY),
    (
        "temp_range",
        [c for c in FIELDS if c not in ("Operational Amplifiers", "Logic Gates")], ("min_c", "max_c"), ["minimumoperatingtemperature", "operatingtemperaturemin"],
        ["maximumoperatingtemperature", "operatingtemperaturemax"], ["operatingtemperaturerange", "operatingtemperature", "temperaturerange"],
    ),
]


def fields() -> list[tuple]:
    """category and its fields: name, names of attributes, scale, whether it is whole, names of a range, its end."""
    rows = {name: [(f, names, scale, whole, [], "") for f, (names, scale, whole) in own.items()] for name, own in FIELDS.items()}
    for field, categories, ends, low, high, both in RANGES:
        for name in categories:
            rows[name] += [(f"{field}.{ends[0]}", low, 1.0, False, both, "low"), (f"{field}.{ends[1]}", high, 1.0, False, both, "high")]
    return list(rows.items())


_FIELD_ROWS = "category string, fields array<struct<field:string,names:array<string>,scale:double,whole:boolean,both:array<string>,side:string>>"


def attribute_specs(attrs: Column, asked: Column) -> Column:
    """map of dotted field to value, for the fields that attributes tell."""

    def value(f: Column) -> Column:
        scaled = units.let(units.si_value(units.looked_up(attrs, f["names"])) * f["scale"], lambda v: F.when(f["whole"], F.bround(v, 0)).otherwise(F.round(v, 6)))
        span = units.let(units.si_range(units.looked_up(attrs, f["both"])), lambda r: F.when(f["side"] == "low", r["low"]).when(f["side"] == "high", r["high"]))
        return F.coalesce(scaled, span)

    found = F.transform(asked, lambda f: F.struct(f["field"].alias("k"), value(f).alias("v")))
    return units.first_of_each(F.filter(found, lambda r: r["v"].isNotNull()))


def with_described(records: DataFrame) -> DataFrame:
    """records with category and described, what their descriptions tell."""
    spark = records.sparkSession
    tried = F.broadcast(spark.createDataFrame(descriptions.patterns(), descriptions.PATTERNS))  # a row a category
    rows = records.withColumn("category", units.category(F.col("Category"))).join(tried, "category", "left")
    return rows.withColumn("described", descriptions.described(F.trim(F.coalesce("Description", F.lit(""))), F.col("patterns"))).drop("patterns")


def parts(records: DataFrame) -> DataFrame:
    """Catalog rows: mpn, category, description, lifecycle_status, authorized_stock, is_defense_grade, package,
    price_tier, specs. What attributes tell goes before descriptions, field by field. Records of no category and those
    without specs go."""
    asked = F.broadcast(records.sparkSession.createDataFrame(fields(), _FIELD_ROWS))  # a row a category
    rows = with_described(records.withColumn("attrs", units.attributes(F.col("ProductAttributes"))))
    rows = rows.join(asked, "category").withColumn("told", attribute_specs(F.col("attrs"), F.col("fields")))
    rest = F.map_filter("described", lambda k, _: ~F.map_contains_key("told", k))
    rows = rows.withColumn("specs", F.map_concat("told", rest)).where(F.size("specs") > 0)
    mpn = F.col("ManufacturerPartNumber")
    return rows.select(
        mpn.alias("mpn"), "category", F.col("Description").alias("description"), units.lifecycle(F.col("LifecycleStatus")).alias("lifecycle_status"),
        units.stock(F.col("Availability"), F.col("FactoryStock")).alias("authorized_stock"),
        units.is_defense(mpn, F.col("category"), F.col("Description")).alias("is_defense_grade"), F.coalesce(units.package(F.col("attrs")), F.lit("")).alias("package"),
        units.price_tier(units.unit_price(F.col("PriceBreaks"))).alias("price_tier"), "specs",
    )
