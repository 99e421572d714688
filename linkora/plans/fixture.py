"""Entity-resolution views over the driver's tables: entities s1, and records with planted noise and their owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import spread

S1_SQL = """
select 'S1-' || cast(c.c_custkey as varchar(20)) as entity_id,
       p.p_name || ' ' || lower(p.p_brand) || ' ' || c.c_mktsegment ||
         case when c.c_custkey%4=0 then ' Pvt. Ltd.' when c.c_custkey%4=1 then ', L.L.C.'
              when c.c_custkey%4=2 then ' Inc' else '' end as business_name,
       cast(100+(c.c_custkey*37)%900 as varchar(20)) || ' ' || p.p_type || ' St, ' || n.n_name || ', ' || r.r_name as business_address,
       r.r_name as country
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
join {part} p on p.p_partkey = c.c_custkey"""

REC_SQL = """
select case when o.o_orderkey%2=0 then 'S2-' else 'S3-' end || cast(o.o_orderkey as varchar(20)) as entity_id,
       case when o.o_orderkey%7=0 then translate(s.business_name,'ge','63') when o.o_orderkey%7=1 then upper(s.business_name)
            when o.o_orderkey%7=4 then 'Zed Holdings a/k/a ' || s.business_name
            when o.o_orderkey%7=5 then 'www.' || replace(split_part(s.business_name,' brand',1),' ','') || '.com'
            when o.o_orderkey%7=6 then 'Unrelated ' || cast(o.o_orderkey as varchar(20)) else s.business_name end as business_name,
       case when o.o_orderkey%7=2 then '##0' || s.business_address || ', null' when o.o_orderkey%7=3 then ''
            when o.o_orderkey%7=6 then cast(o.o_orderkey%1000 as varchar(20)) || ' Nowhere Rd, ' || s.country
            else s.business_address end as business_address,
       s.country as country,
       case when o.o_orderkey%7=6 then cast(null as varchar(20)) else s.entity_id end as true_s1
from {orders} o join {s1} s on s.entity_id = 'S1-' || cast(o.o_custkey as varchar(20))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region", "part")}
    return spark.sql(S1_SQL, **tables)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    return spark.sql(REC_SQL, orders=orders, s1=entities(spark, sf_dir))
