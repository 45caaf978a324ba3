"""A deterministic table of case lines, derived from the star-schema tables.

The tables hold no Chinese text; these lines make every rule fire, with
overlaps, shadowing and near misses. The statement runs in Spark and in others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES_SQL = """
SELECT 'c' || cast(c_custkey AS string) AS line_id,
 '申请人' || c_name || '，手机号138' || lpad(cast(c_custkey AS string),8,'0') || '，邮箱u' || cast(c_custkey AS string) || '@example.com，身份证号11010119900101' || lpad(cast(c_custkey % 10000 AS string),4,'0') || '，月工资' || cast(c_custkey % 50000 AS string) || '元。护照E' || lpad(cast(c_custkey AS string),8,'0') AS text FROM customer
UNION ALL SELECT 's' || cast(s_suppkey AS string),
 '统一社会信用代码91440300MA5H' || lpad(cast(s_suppkey AS string),5,'0') || 'B，开户行平安银行深圳江苏大厦支行，账号' || lpad(cast(s_suppkey AS string),14,'1') || '，电话0755-2' || lpad(cast(s_suppkey AS string),7,'0') || '，车牌粤B' || lpad(cast(s_suppkey AS string),5,'0') || '，银行卡622202' || lpad(cast(s_suppkey AS string),13,'0') FROM supplier
UNION ALL SELECT 'o' || cast(o_orderkey AS string),
 '案号(' || cast(year(o_orderdate) AS string) || ')京0101民初' || cast(o_orderkey AS string) || '号，执行(' || cast(year(o_orderdate) AS string) || ')京' || cast(o_orderkey AS string) || '号，合同编号[2026]律代字第' || cast(o_orderkey AS string) || '号，编号26SZ-A' || cast(o_orderkey AS string) || '，工号' || lpad(cast(o_orderkey AS string),12,'7') || '，于' || cast(year(o_orderdate) AS string) || '年' || cast(month(o_orderdate) AS string) || '月' || cast(day(o_orderdate) AS string) || '日，元年' || cast(year(o_orderdate) AS string) || '元年' FROM orders
UNION ALL SELECT 'p' || cast(p_partkey AS string),
 '（粤）不动产权第' || cast(p_partkey AS string) || '号，密钥sk-' || lpad(cast(p_partkey AS string),24,'a') || '，13' || lpad(cast(p_partkey AS string),9,'0') || '元，人民币伍仟元整' FROM part
"""


#: The columns that lines are made of.
COLUMNS = {"customer": ["c_custkey", "c_name"], "supplier": ["s_suppkey"], "orders": ["o_orderkey", "o_orderdate"], "part": ["p_partkey"]}
_PART = 1 << 17


def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, in parts of like size: the tables' narrow rows are dealt, not their lines.

    A table is often one file with few splits, whatever its rows. Parts follow
    the tables' sizes, four a core at least.
    """
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c) for n, c in COLUMNS.items()}
    size = {n: max(1, int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) for n, t in tables.items()}
    total = sum(size.values())
    parts = max(4 * spark.sparkContext.defaultParallelism, total // _PART)
    sql = LINES_SQL
    for n, t in tables.items():
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
        tables[n] = t.repartition(-(-parts * size[n] // total))
    return spark.sql(sql, **tables)
