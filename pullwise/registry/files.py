"""Export directories written from the tables, and what is made of them: reports, read order, pruned fetches, gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.registry.base import query, with_views
from pullwise.session import shared_folder
from pullwise.sources.exports import ExportDirectory
from pullwise.sources.tables import add_view

# registration rows with commas, quotes and line breaks in names, dates in five forms, missing marks
add_view("file_people", """
select c_custkey as k, 'P' || lpad(cast(c_custkey as string), 9, '0') as mrn,
 case c_custkey % 4 when 0 then c_name || ', "the ' || cast(c_custkey % 7 as string) || 'th"' when 1 then c_name || chr(10) || 'of ' || cast(c_nationkey as string) else c_name end as full_name,
 case c_custkey % 5 when 0 then d when 1 then substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4) when 2 then d || 'T12:30:00Z' when 3 then 'unknown' else 'NA' end as raw_birth,
 case c_custkey % 5 when 3 then 'unknown' when 4 then null else d end as date_of_birth,
 case when c_custkey % 6 = 0 then 'n/a' else cast(9800000000 + c_custkey as string) end as raw_phone, case when c_custkey % 6 = 0 then null else cast(9800000000 + c_custkey as string) end as phone
from (select *, cast(date '1950-01-01' + cast(c_custkey % 20000 as int) as string) as d from {customer}) c""")
add_view("file_areas", """
select c_custkey as k, 'P' || lpad(cast(c_custkey as string), 9, '0') as mrn, cast(10000 + c_nationkey as string) as pincode, c_mktsegment as remark
from {customer} where c_custkey % 3 = 0""")
add_view("file_visits", """
select o_orderkey as k, 'P' || lpad(cast(o_custkey as string), 9, '0') as mrn, o_orderpriority as primary_diagnosis,
 substr(cast(o_orderdate as string), 1, 10) || 'T00:00:00' as encounter_datetime, case when o_orderkey % 4 = 1 then 'when?' else substr(cast(o_orderdate as string), 1, 10) || ' 00:00:00' end as raw_time
from {orders}""")
add_view("file_notes", "select o_orderkey as k, cast(o_orderkey as string) as ticket, o_orderstatus as raised_by from {orders} where o_orderkey % 5 = 0")

FILES = {
    "area": ("file_areas", {"mrn": "mrn", "pincode": "pincode", "remark": "remark"}),
    "notes": ("file_notes", {"ticket": "ticket", "raised_by": "raised_by"}),
    "reg": ("file_people", {"mrn": "mrn", "full_name": "full_name", "date_of_birth": "raw_birth", "phone": "raw_phone"}),
    "visit": ("file_visits", {"mrn": "mrn", "primary_diagnosis": "primary_diagnosis", "encounter_datetime": "raw_time"}),
}


def write_files(t) -> str:
    """A directory of CSV files named reg_00000.csv and so on, each kind in the order of its keys."""
    spark = t.spark
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/export-{uuid.uuid4().hex}"
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for kind, (view, columns) in FILES.items():
        rows = t[view].repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")
        rows.select(*[F.col(c).alias(h) for h, c in columns.items()]).write.option("header", True).option("escape", '"').csv(f"{folder}/parts/{kind}")
        files = path(folder).getFileSystem(conf)
        for status in files.listStatus(path(f"{folder}/parts/{kind}")):            # a rename a file, as an exporting system would name them
            name = status.getPath().getName()
            if name.startswith("part-"):
                files.mkdirs(path(f"{folder}/in"))
                files.rename(status.getPath(), path(f"{folder}/in/{kind}_{name[5:10]}.csv"))
    return f"{folder}/in"


def kind(column: str = "source_file"):
    return F.regexp_extract(column, "^[a-z]+", 0)


@query("file_order", with_views("""
select 'area' as kind, row_number() over (order by k) - 1 as row_ix, mrn, null as full_name, null as date_of_birth, null as phone from file_areas
union all select 'reg', (select count(*) from file_areas) + row_number() over (order by k) - 1, mrn, full_name, date_of_birth, phone from file_people""",
    "file_areas", "file_people"))
def file_order(t):
    """The registration rows of several files, numbered in the order of files and lines however they are split."""
    table = ExportDirectory(t.spark, write_files(t)).layer(dims.PA, numbered=True)
    return table.select(kind().alias("kind"), "row_ix", "mrn", "full_name", "date_of_birth", "phone")


@query("file_report", with_views(f"""
select 'area' as kind, '{dims.PA}' as layer, 0.667 as confidence, null as reason, count(*) as rows, 0 as unparsed, '' as unparsed_fields, 'remark' as not_understood from file_areas
union all select 'notes', null, 0.0, 'no catalogue field', null, null, null, 'ticket,raised_by'
union all select 'reg', '{dims.PA}', 1.0, null, count(*), count(*) filter (where raw_birth = 'unknown'), 'date_of_birth', '' from file_people
union all select 'visit', '{dims.EHR}', 1.0, null, count(*), count(*) filter (where raw_time = 'when?'), 'encounter_datetime', '' from file_visits""",
    "file_areas", "file_people", "file_visits"))
def file_report(t):
    """What was made of each kind of file: layer, confidence, refusal, rows, values that couldn't be parsed and where."""
    report = ExportDirectory(t.spark, write_files(t)).report()
    fields = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("unparsed_fields", lambda x: x["field"]))))), ",")
    return report.groupBy(kind("file").alias("kind"), "layer", "confidence", "reason", F.array_join("not_understood", ",").alias("not_understood")).agg(
        F.sum("rows").alias("rows"), F.sum("unparsed").alias("unparsed"), F.when(F.sum("rows").isNotNull(), fields).alias("unparsed_fields"))


@query("file_fetch", with_views("""
select 'pincode' as ask, 'area' as kind, count(*) as rows, count(pincode) as filled from file_areas
union all select 'phone and pincode', 'area', count(*), 0 from file_areas union all select 'phone and pincode', 'reg', count(*), count(phone) from file_people
union all select 'key', 'area', count(*), 0 from file_areas union all select 'key', 'reg', count(*), 0 from file_people
union all select 'one subject', 'reg', count(*), count(phone) from file_people where mrn = 'P000000003'""", "file_areas", "file_people"))
def file_fetch(t):
    """Rows that fetches read by kind of file: only files that carry something asked for are read at all."""
    src = ExportDirectory(t.spark, write_files(t))

    def ask(name, fields, value=None, where=None):
        got = src.fetch(dims.PA, fields, where)
        filled = F.count(value).alias("filled") if value else F.lit(0).cast("bigint").alias("filled")
        return got.groupBy(kind().alias("kind")).agg(F.count(F.lit(1)).alias("rows"), filled).select(F.lit(name).alias("ask"), "kind", "rows", "filled")
    return ask("pincode", ["mrn", "pincode"], "pincode").unionAll(ask("phone and pincode", ["phone", "pincode"], "phone")).unionAll(
        ask("key", ["mrn"])).unionAll(ask("one subject", ["phone"], "phone", {"mrn": "P000000003"}))


GAPS = [(layer, f) for layer, have in ((dims.PA, ("mrn", "full_name", "date_of_birth", "phone", "pincode")), (dims.EHR, ("mrn", "primary_diagnosis", "encounter_datetime")))
        for f in dims.FIELD_CATALOGUE[layer] if f not in have]


@query("file_gaps", with_views(" union all ".join(
    f"select '{layer}' as layer, '{f}' as field, " + ("(select count(*) from file_areas) + (select count(*) from file_people)" if layer == dims.PA else "(select count(*) from file_visits)")
    + " as rows" for layer, f in GAPS), "file_areas", "file_people", "file_visits"))
def file_gaps(t):
    """Catalogue fields that no file of a layer carries, with the rows that go without."""
    src = ExportDirectory(t.spark, write_files(t))
    sizes = src.report().where("reason is null").groupBy("layer").agg(F.sum("rows").alias("rows"))
    return src.absent().join(sizes, "layer").select("layer", "field", "rows")
