"""Two sides derived from `orders`, by SQL that Spark and DuckDB read alike but for a few marked words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from exactdiff.operators.diff import Diff, Side

TOTAL = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"

#: Header: expression of side A, expression of side B, in A's import order.
COLUMNS = {
    "status": ("o_orderstatus", "CASE WHEN o_orderkey % 7 = 0 THEN LOWER(o_orderstatus) ELSE o_orderstatus END"),
    "priority": ("o_orderpriority", "CASE WHEN o_orderkey % 5 = 0 THEN CONCAT(' ', o_orderpriority) ELSE o_orderpriority END"),
    "mixed": ("o_orderpriority", "CASE WHEN o_orderkey % 5 = 1 THEN CONCAT(' ', LOWER(o_orderpriority)) ELSE o_orderpriority END"),
    "total": (TOTAL, f"CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('$', {TOTAL}) ELSE {TOTAL} END"),
    "amount": (TOTAL, f"CASE WHEN o_orderkey % 9 = 0 THEN CONCAT({TOTAL}, '0') ELSE {TOTAL} END"),
    "odate": (DAY, f"REPLACE({DAY}, '-', '')"),
    "cust": ("CAST(o_custkey AS STRING)", "CONCAT('00', CAST(o_custkey AS STRING))"),
    "flag": ("''", "'0'"),
    "yn": ("CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END"),
    "share": ("CONCAT(CAST(o_orderkey % 100 AS STRING), '%')", "CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('0.', LPAD(CAST(o_orderkey % 100 AS STRING), 2, '0')) ELSE CONCAT(CAST(o_orderkey % 100 AS STRING), '%') END"),
    "loss": (f"CONCAT('-', {TOTAL})", f"CASE WHEN o_orderkey % 3 = 1 THEN CONCAT('(', {TOTAL}, ')') ELSE CONCAT('-', {TOTAL}) END"),
    "serial": (DAY, f"CASE WHEN o_orderkey % 4 = 1 THEN CAST(<days> AS STRING) ELSE {DAY} END"),
    "note": ("CONCAT('lot ', o_orderpriority)", "CASE WHEN o_orderkey % 6 = 1 THEN CONCAT('lot  ', o_orderpriority) ELSE CONCAT('lot ', o_orderpriority) END"),
    "code": ("CONCAT('P-', CAST(o_custkey % 50 AS STRING))", "CASE WHEN o_orderkey % 6 = 2 THEN CONCAT('P–', CAST(o_custkey % 50 AS STRING)) ELSE CONCAT('P-', CAST(o_custkey % 50 AS STRING)) END"),
    "place": ("CASE WHEN o_custkey % 3 = 0 THEN 'Orléans' ELSE 'Málaga' END", "CASE WHEN o_orderkey % 6 = 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Orleans' ELSE 'Malaga' END WHEN o_custkey % 3 = 0 THEN 'Orléans' ELSE 'Málaga' END"),
    "stamp": (DAY, f"CASE WHEN o_orderkey % 4 = 2 THEN CONCAT({DAY}, 'T00:00:00') ELSE {DAY} END"),
    "memo": (f"CASE o_orderkey % 7 WHEN 0 THEN {DAY} WHEN 1 THEN '012' WHEN 2 THEN 'x y' WHEN 3 THEN 'ab' WHEN 4 THEN '1–2' WHEN 5 THEN '7' ELSE '44927' END", f"CASE o_orderkey % 7 WHEN 0 THEN CONCAT(REPLACE({DAY}, '-', ''), CHR(10)) WHEN 1 THEN CONCAT('12', CHR(10)) WHEN 2 THEN CONCAT('x', CHR(160), 'y') WHEN 3 THEN CONCAT(CHR(9), 'ab') WHEN 4 THEN '1—2' WHEN 5 THEN CONCAT('7', CHR(10)) ELSE CONCAT('44927', CHR(10)) END"),
}
KEY = "CAST(o_orderkey AS STRING)"
KEYS = ["okey", "bucket"]
EXTRA_A = {"ship_code": "'x'"}
EXTRA_B = {"Ship Code": "CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'y' END"}

#: The side's value that a later reading has for some rows: what refresh sees.
MOVED = "CASE WHEN o_orderkey % 14 = 0 THEN CONCAT(LOWER(o_orderstatus), '!') WHEN o_orderkey % 7 = 0 THEN LOWER(o_orderstatus) ELSE o_orderstatus END"


def sql(side: str, engine: str = "spark", later: bool = False) -> str:
    """The SELECT of side A or B; engine: spark or duckdb; later: as a second reading finds it."""
    quote = "`" if engine == "spark" else '"'
    days = "DATEDIFF(CAST(o_orderdate AS DATE), DATE '1899-12-30')" if engine == "spark" else "(CAST(o_orderdate AS DATE) - DATE '1899-12-30')"
    at = 0 if side == "A" else 1
    values = {h: x[at] for h, x in COLUMNS.items()} | (EXTRA_A if side == "A" else EXTRA_B)
    if later and side == "B":
        values["status"] = MOVED
    keys = {"okey": KEY, "bucket": "CAST(o_orderkey % 5 AS STRING)"}
    columns = ", ".join(f"{x} AS {quote}{h}{quote}" for h, x in (keys | values).items())
    kept = "o_orderkey % 13 <> 0" if side == "A" else "o_orderkey % 11 <> 0"
    return f"SELECT {columns} FROM orders WHERE {kept}".replace("<days>", days)


def side(spark: SparkSession, sf_dir: str, which: str, later: bool = False) -> Side:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Side.of(spark.sql(sql(which, later=later).replace("FROM orders", "FROM {orders}"), orders=orders))


def diff(spark: SparkSession, sf_dir: str, later: bool = False) -> Diff:
    return Diff(side(spark, sf_dir, "A"), side(spark, sf_dir, "B", later), KEYS)


def accepted_cells(found: Diff) -> DataFrame:
    """What the queries take as accepted: case differences of status in some rows."""
    return found.tall(found.matched, ["status"]).where("val_a <> val_b and k1 in ('0', '1', '2')")
