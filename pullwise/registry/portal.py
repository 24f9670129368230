"""Pages, split layers, drift between crawls, requests in plain words, and the streamed log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.operators import access, drift, recognise, split
from pullwise.registry.base import query, with_views
from pullwise.session import written
from pullwise.sources import pages
from pullwise.sources.tables import add_view, values
from pullwise.streaming import daily


LINKS_SQL = r"""
with a as (select page_id, url, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')))) as ord,
 unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) as a from pages),
b as (select page_id, url, ord::int as ord, trim(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g')) as text, regexp_extract(a, '(?is)href="([^"]*)"', 1) as h from a)
select page_id, ord, text, case when h = '' then url when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h when h like '//%' then regexp_extract(url, '^([A-Za-z]+:)', 1) || h
 when h like '/%' then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h else regexp_extract(url, '^(.*/)[^/]*$', 1) || h end as href from b"""


@query("page_links", LINKS_SQL)
def page_links(t):
    """Every link of every page, absolute."""
    return pages.page_links(t["pages"])


@query("page_outline", f"""
select p.url, count(l.ord)::int as n_links, coalesce(string_agg(l.text || '>' || l.href, '|' order by l.ord), '') as links,
 len(regexp_extract_all(any_value(p.html), '(?i)<t[hd][ >]'))::int as n_cells, len(regexp_extract_all(any_value(p.html), '(?i)<button[ >]'))::int as n_controls
from pages p left join ({LINKS_SQL}) l using (page_id) group by p.page_id, p.url""")
def page_outline(t):
    """What the page parser makes of every page: its links in order, table cells and controls."""
    p = pages.parse_pages(t["pages"])
    cells = F.size("headers") + F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(r))
    return p.select("url", F.size("links").alias("n_links"), F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["text"], x["href"])), "|").alias("links"),
                    cells.alias("n_cells"), F.size("controls").alias("n_controls"))


# A list page per order (its lines) and a record page per order, in a portal's mark-up.
def order_pages(t):
    o, li = t["orders"], t["lineitem"]
    url = lambda k: F.concat(F.lit("https://his.example/m/orders/"), k.cast("string"))
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", cell(F.col("l_returnflag")).alias("flag"))
    row = lambda x: F.concat(F.lit("<tr>"), cell(F.concat(F.lit("MRN"), x["l_partkey"])), cell(F.concat(F.lit(" ORD-"), x["l_linenumber"], F.lit(" "))),
                             x["flag"], F.lit('<td><a href="/m/orders/'), F.col("l_orderkey").cast("string"), F.lit("/record/"),
                             x["l_linenumber"].cast("string"), F.lit('">Open</a></td></tr>'))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count(F.lit(1)).alias("n"))
    rows = lines.select("l_orderkey", F.array_join(F.transform("lines", row), "").alias("rows"), "n")
    page = F.concat(
        F.lit("<html><body><nav><a href='/'>Home</a></nav><main><form action='/m/orders'><input type='search' name='q'><button>Find</button></form>"
              "<table><thead><tr><th>Patient  Number</th><th>order_id</th><th>Specimen</th><th> </th></tr></thead><tbody>"), F.col("rows"),
        F.lit("</tbody></table><p>"), F.col("n").cast("string"), F.lit(" records, page 1 of 2</p><a href='?page=2'>Next</a><button>New lab  request</button></main></body></html>"))
    lists = rows.select(url(F.col("l_orderkey")).alias("url"), page.alias("html"))
    record = F.concat(F.lit("<html><body><main><table><tbody><tr><th>Patient Number</th><td>MRN"), F.col("o_custkey"), F.lit("</td></tr><tr><th>imaging_modality</th><td>"),
                      F.col("o_orderstatus"), F.lit("</td></tr><tr><th>result_value</th><td>"), F.col("o_orderpriority"),
                      F.lit("</td></tr></tbody></table><input type='submit' value='Record observation'></main></body></html>"))
    first = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("ln"))
    records = o.join(first, "o_orderkey").select(F.concat(url(F.col("o_orderkey")), F.lit("/record/"), F.col("ln").cast("string")).alias("url"), record.alias("html"))
    return lists, records


add_view("page_aliases", values("shown, field", [("patient number", "mrn"), ("specimen", "specimen_type")]))


@query("page_tables", """
select 'https://his.example/m/orders/' || l_orderkey::varchar as url, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::int as row,
 'MRN' || l_partkey::varchar as mrn, 'ORD-' || l_linenumber::varchar as order_id, l_returnflag as specimen_type,
 'https://his.example/m/orders/' || l_orderkey::varchar || '/record/' || l_linenumber::varchar as link from lineitem""")
def page_tables(t):
    """Records of list pages, headers mapped to fields, each with its record link."""
    lists, _ = order_pages(t)
    r = pages.records(pages.parse_pages(lists), t["page_aliases"])
    cell = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return r.groupBy("url", "row").agg(cell("mrn"), cell("order_id"), cell("specimen_type"), F.max("link").alias("link"))


@query("navigation_map", """
select 'https://his.example/m/orders/' || l_orderkey::varchar as url, 'ancillary_departmental' as layer, 1.0::double as confidence, 'mrn,order_id,specimen_type' as list_fields,
 'mrn,imaging_modality,result_value' as detail_fields, count(*)::int as record_count, 2::int as page_count, 'New lab request' as list_controls, 'Record observation' as record_controls,
 'https://his.example/m/orders' as search_action, 'q' as search_param from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey""")
def navigation_map(t):
    """Modules discovered from list and record pages: fields, controls, search form and layer."""
    lists, records = order_pages(t)
    parsed = written(pages.parse_pages(lists.unionAll(records)), "pages")
    titles = lists.select("url", F.lit("Orders").alias("title"))
    m = pages.discover(parsed, titles, t["page_aliases"])
    joined = [F.array_join(c, ",").alias(c) for c in ("list_fields", "detail_fields", "list_controls", "record_controls")]
    return m.select("url", "layer", "confidence", *joined, "record_count", "page_count", "search_action", "search_param")


add_view("split_left", """
select 'MRN' || lpad(cast(o_custkey as string),7,'0') as mrn, o_orderkey as ord, 'INV' || cast(o_orderkey as string) as invoice_id, o_totalprice as billed_amount from {orders}""")
add_view("split_right", """
select 'MRN' || lpad(cast(o_custkey as string),7,'0') as mrn, 900000000 - o_orderkey as ord, o_orderstatus as payer_name, 'PL' || cast(o_orderkey as string) as insurance_policy_no
from {orders} where o_orderkey % 5 <> 0""")


@query("split_layer_join", with_views("""
select l.mrn, l.ord, l.invoice_id, l.billed_amount, r.payer_name, r.insurance_policy_no
from (select *, row_number() over (partition by mrn order by ord) as n from split_left) l
left join (select *, row_number() over (partition by mrn order by ord) as n from split_right) r on r.mrn = l.mrn and r.n = l.n""", "split_left", "split_right"))
def split_layer_join(t):
    """Billing kept by two modules: each record paired with the n-th of its patient on the other side."""
    return split.paired_join(t["split_left"], t["split_right"], "mrn", "ord",
                             ["mrn", "ord", "invoice_id", "billed_amount", "payer_name", "insurance_policy_no"])


@query("page_lists", """
select url as list_url, 1 as pages, 0 as rows, true as complete, 0 as fields from (select distinct url from pages)""")
def page_lists(t):
    """The given pages as lists: pages that continue each other, rows and fields found, and whether all that is announced is there. None of
    them holds a table, so each is a list of its own without rows."""
    parsed = written(pages.parse_pages(t["pages"]).dropDuplicates(["url"]), "parsed")
    of = written(pages.chains(parsed), "lists")
    fields = pages.list_records(parsed, of).groupBy("list_url").agg(F.count(F.lit(1)).alias("fields"))
    return pages.list_totals(parsed, of).select("list_url", "pages", "rows", "complete").join(fields, "list_url", "left").fillna(0, ["fields"])


@query("module_read", with_views("""
select l.mrn, l.invoice_id, r.payer_name from split_left l join split_right r on r.insurance_policy_no = 'PL' || substr(l.invoice_id, 4) where r.payer_name = 'F'""", "split_left", "split_right"))
def module_read(t):
    """A module read whose record pages are needed for one field and one filter."""
    left = t["split_left"].withColumn("k", F.substring("invoice_id", 4, 20))
    right = t["split_right"].select(F.substring("insurance_policy_no", 3, 20).alias("k"), "payer_name")
    return split.read_module(left, right, ["mrn", "invoice_id", "payer_name"], "k", {"payer_name": "F"})


# --- two crawls of every site ---------------------------------------------------------------------------
MODULES = ("ord, title, path, layer", [
    (0, "Patient Registration", "/m/registration", dims.PA), (1, "Clinical Records", "/m/clinical", dims.EHR),
    (2, "Departmental Orders", "/m/departments", dims.ANC), (3, "Billing", "/m/billing", dims.FIN),
    (4, "Audit Log", "/m/integration", dims.INF), (5, "Insurance Desk", "/m/payers", dims.FIN), (6, "Messages", "/m/messages", dims.INF)])
add_view("module_dims", values(*MODULES), each=MODULES)
add_view("nav_modules", """
select c_custkey as site, 'before' as crawl, m.ord, m.title, m.path, m.layer from {customer} [[module_dims m]] where m.ord < 5
union all
select c_custkey as site, 'after' as crawl, m.ord,
 case when m.ord = 3 and c_custkey % 3 = 0 then 'Accounts' when (c_custkey + m.ord) % 4 = 1 then m.title || ' Desk' else m.title end as title,
 case when (c_custkey + m.ord) % 3 = 1 then replace(m.path, '/m/', '/app/') else m.path end as path, m.layer
from {customer} [[module_dims m]]
where (m.ord < 4 or (m.ord = 4 and c_custkey % 7 <> 3) or (m.ord = 5 and c_custkey % 3 = 0) or (m.ord = 6 and c_custkey % 7 = 3))""")
add_view("nav_fields", """
select c_custkey as site, 'before' as crawl, c.layer_ord as ord, case when c.field_ord < 4 then 'list page' else 'record page' end as screen, c.field_ord as f_ord,
 c.field as name, case when c.field = 'mrn' then 'MRN' else replace(c.field, '_', ' ') end as label from {customer} [[field_catalogue c]]
union all
select site, 'after' as crawl, ord, screen, f_ord, case when dropped then 'Col ' || field else field end as name,
 case when (site + f_ord) % 5 = 0 then 'New ' || field else case when field = 'mrn' then 'MRN' else replace(field, '_', ' ') end end as label from (
 select c_custkey as site, c.field_ord as f_ord, c.field, c.field <> 'mrn' and (c_custkey * 3 + c.layer_ord * 7 + c.field_ord) % 11 = 0 as dropped,
  case when c.layer_ord = 3 and c_custkey % 3 = 0 and c.field in ('payer_name', 'insurance_policy_no') then 5 when c.layer_ord = 4 and c_custkey % 7 = 3 then 6 else c.layer_ord end as ord,
  case when ((c_custkey + c.field_ord) % 6 = 2) = (c.field_ord < 4) then 'record page' else 'list page' end as screen
 from {customer} [[field_catalogue c]] where not (c.layer_ord = 4 and c_custkey % 7 = 3 and c.field not in ('source_system', 'subject_mrn'))) x
where not (dropped and site % 2 = 1)
union all
select c_custkey as site, 'after' as crawl, 5 as ord, 'list page' as screen, 0 as f_ord, 'mrn' as name, 'MRN' as label from {customer} where c_custkey % 3 = 0""")
add_view("nav_controls", """
select c_custkey as site, 'before' as crawl, case when n.action_ord < 12 then 0 when n.action_ord < 15 then 1 when n.action_ord < 17 then 2 else 3 end as ord,
 case when n.action_ord % 3 = 0 then 'list page' else 'record page' end as screen, n.action_ord as c_ord, n.shown as label from {customer} [[action_names n]] where n.name_ord = 0
union all
select c_custkey as site, 'after' as crawl, case when n.action_ord < 12 then 0 when n.action_ord < 15 then 1 when n.action_ord < 17 then 2 else 3 end as ord,
 case when ((c_custkey + n.action_ord) % 7 = 3) = (n.action_ord % 3 = 0) then 'record page' else 'list page' end as screen, n.action_ord as c_ord,
 case when (c_custkey + n.action_ord) % 4 = 3 then 'Zz ' || n.action else n.shown end as label
from {customer} [[action_names n]] where n.name_ord = case when (c_custkey + n.action_ord) % 4 = 2 then 1 else 0 end and not ((c_custkey + n.action_ord) % 4 = 3 and c_custkey % 2 = 1)""")

NAV = ("nav_modules", "nav_fields", "nav_controls", "field_catalogue", "action_names")
DRIFT_SQL = """
known as (select f.*, m.title, m.path, m.layer from nav_fields f join nav_modules m using (site, crawl, ord) join field_catalogue c on c.layer = m.layer and c.field = f.name),
mk as (select m.site, m.crawl, m.ord, m.title, m.layer, list(distinct k.name) filter (where k.name is not null) as ks from nav_modules m
 left join known k on k.site = m.site and k.crawl = m.crawl and k.ord = m.ord group by 1, 2, 3, 4, 5),
pairs as (select a.site, a.ord, b.ord as old_ord, len(list_intersect(a.ks, b.ks)) * 1.0 / len(list_distinct(list_concat(a.ks, b.ks))) as ov, a.title = b.title as same
 from mk a join mk b on a.site = b.site and a.layer = b.layer and a.crawl = 'after' and b.crawl = 'before'),
origin as (select site, ord, old_ord from (select *, row_number() over (partition by site, ord order by ov desc, same desc, old_ord) as rn from pairs) where rn = 1 and ov > 0),
called as (select m.site, m.ord as old_ord, m.title, m.path, m.layer, count(a.ord) as n, min(a.title) as t1, min(a.path) as p1,
  string_agg(a.title || ' (' || a.path || ')', ' and ' order by a.ord) as parts, case when count(a.ord) = 1 then min(a.title) else m.title end as now_title
 from nav_modules m left join origin o on o.site = m.site and o.old_ord = m.ord left join nav_modules a on a.site = m.site and a.crawl = 'after' and a.ord = o.ord
 where m.crawl = 'before' group by 1, 2, 3, 4, 5),
acts as (select c.*, m.title, m.path, m.layer, n.action from nav_controls c join nav_modules m using (site, crawl, ord)
 left join action_names n on array_to_string(regexp_extract_all(lower(n.shown), '[a-z0-9]+'), ' ') = array_to_string(regexp_extract_all(lower(c.label), '[a-z0-9]+'), ' ')),
firsts as (select * from (select *, row_number() over (partition by site, crawl, action order by ord, screen, c_ord) as rn from acts where action is not null) where rn = 1),
both_layers as (select site, layer from nav_modules group by 1, 2 having count(distinct crawl) = 2),
was as (select k.site, k.layer, k.name, arg_min(k.label, k.ord) as label, list_sort(list(distinct c.now_title || ', ' || k.screen)) as places, list_sort(list(distinct c.now_title)) as titles,
  len(list(distinct c.now_title || ', ' || k.screen)) as np
 from known k join called c on c.site = k.site and c.old_ord = k.ord where k.crawl = 'before' group by 1, 2, 3),
now as (select site, layer, name, arg_min(label, ord) as label, list_sort(list(distinct title || ', ' || screen)) as places, list_sort(list(distinct title)) as titles from known where crawl = 'after' group by 1, 2, 3),
fp as (select coalesce(w.site, n.site) as site, coalesce(w.layer, n.layer) as layer, coalesce(w.name, n.name) as name, w.label as wl, n.label as nl, w.places as wp, n.places as np, w.titles as wt, n.titles as nt
 from was w full join now n on n.site = w.site and n.layer = w.layer and n.name = w.name),
fch as (select f.* from fp f join both_layers b on b.site = f.site and b.layer = f.layer),
fchange as (
 select site, layer, name as field, 'gone' as change, wl as detail from fch where np is null
 union all select site, layer, name, 'new', array_to_string(np, '; ') from fch where wp is null
 union all select site, layer, name, 'relabelled', wl || ' -> ' || nl from fch where lower(wl) <> lower(nl)
 union all select site, layer, name, 'moved screen', array_to_string(np, '; ') from fch where name <> 'mrn' and wp <> np and wt = nt
 union all select site, layer, name, 'moved', array_to_string(wp, '; ') || ' -> ' || array_to_string(np, '; ') from fch where name <> 'mrn' and wp <> np and wt <> nt)
"""


def crawls(t):
    return drift.Crawls(t["nav_modules"], t["nav_fields"], t["nav_controls"])


@query("drift_modules", with_views("""
select site, title, case when n = 0 then 'gone' when n > 1 then 'split' when t1 <> title and p1 <> path then 'renamed and moved' when t1 <> title then 'renamed' else 'moved' end as change,
 case when n = 0 then path when n > 1 then parts when t1 <> title and p1 <> path then t1 || ': ' || path || ' -> ' || p1 when t1 <> title then t1 else path || ' -> ' || p1 end as detail
from called where n <> 1 or t1 <> title or p1 <> path
union all select m.site, m.title, 'new', m.path from nav_modules m where crawl = 'after' and not exists (select 1 from origin o where o.site = m.site and o.ord = m.ord)""", *NAV, extra=DRIFT_SQL))
def drift_modules(t):
    """Modules gone, split, renamed, moved or new, per site."""
    return drift.module_changes(crawls(t))


@query("drift_fields", with_views("select * from fchange", *NAV, extra=DRIFT_SQL))
def drift_fields(t):
    """Fields gone, new, relabelled or moved, per site."""
    return drift.field_changes(crawls(t))


@query("drift_buttons", with_views("""
select * from (select coalesce(w.site, n.site) as site, coalesce(w.action, n.action) as action,
 case when n.action is null then 'gone' when w.action is null then 'new' when w.label <> n.label and (c.now_title <> n.title or w.screen <> n.screen) then 'renamed and moved'
  when w.label <> n.label then 'renamed' when c.now_title <> n.title or w.screen <> n.screen then 'moved' end as change,
 w.label as old_label, n.label as new_label, coalesce(n.title, w.title) as module, coalesce(n.screen, w.screen) as screen
from (select * from firsts where crawl = 'before') w full join (select * from firsts where crawl = 'after') n on n.site = w.site and n.action = w.action
left join called c on c.site = w.site and c.old_ord = w.ord) where change is not null""", *NAV, extra=DRIFT_SQL))
def drift_buttons(t):
    """Buttons gone, new, renamed or moved, per site."""
    return drift.button_changes(crawls(t))


@query("drift_unmapped", with_views("""
select u.site, 'header' as kind, u.title as module, u.screen, u.name as shown,
 (select case when count(distinct g.field) = 1 then min(g.field) end from fchange g where g.site = u.site and g.layer = u.layer and g.change = 'gone'
   and (o.old_ord is null or exists (select 1 from known k where k.site = u.site and k.crawl = 'before' and k.ord = o.old_ord and k.name = g.field))) as proposal
from (select f.*, m.title, m.layer from nav_fields f join nav_modules m using (site, crawl, ord) where crawl = 'after' and f.name not in (select field from field_catalogue)) u
left join origin o on o.site = u.site and o.ord = u.ord
union all
select a.site, 'button', a.title, a.screen, a.label,
 (select case when count(*) = 1 then min(w.action) end from firsts w where w.crawl = 'before' and w.site = a.site and w.screen = a.screen
   and not exists (select 1 from firsts n where n.crawl = 'after' and n.site = w.site and n.action = w.action) and (w.title = a.title or w.ord = o.old_ord))
from acts a left join origin o on o.site = a.site and o.ord = a.ord where a.crawl = 'after' and a.action is null""", *NAV, extra=DRIFT_SQL))
def drift_unmapped(t):
    """Headers and buttons not understood, with the one candidate that vanished."""
    return drift.unmapped(crawls(t))


@query("drift_merged", with_views("""
select site, 'field' as kind, min(x) as text, string_agg(distinct layer, ',' order by layer) as tags from (select site, layer, case field when 'mrn' then 'MRN' when 'insurance_policy_no' then 'policy number'
 when 'billed_amount' then 'amount' when 'payer_name' then 'payer' when 'admission_ward' then 'ward' else replace(field, '_', ' ') end || ' ' || change as x from fchange) group by site, lower(x)""", *NAV, extra=DRIFT_SQL))
def drift_merged(t):
    """The same change in several layers said once."""
    m = drift.merged_changes(drift.change_texts(crawls(t)))
    return m.select("site", "kind", "text", F.array_join("tags", ",").alias("tags"))


IMPACT = DRIFT_SQL + """,
spots as (select site, layer, name, coalesce(string_agg(distinct title || path || screen || label, '|' order by title || path || screen || label) filter (where crawl = 'before'), '') as w,
 coalesce(string_agg(distinct title || path || screen || label, '|' order by title || path || screen || label) filter (where crawl = 'after'), '') as n from known group by 1, 2, 3),
bspots as (select coalesce(w.site, n.site) as site, coalesce(w.action, n.action) as action, coalesce(w.title || w.path || w.screen || w.label, '') as w, coalesce(n.title || n.path || n.screen || n.label, '') as n
 from (select * from firsts where crawl = 'before') w full join (select * from firsts where crawl = 'after') n on n.site = w.site and n.action = w.action),
sites as (select distinct site from nav_modules),
ids as (select distinct function_id from function_steps),
lost as (select s.site, f.function_id from sites s cross join function_fields f where not exists (select 1 from spots p where p.site = s.site and p.layer = f.layer and p.name = f.field and p.n <> '')
 union select s.site, f.function_id from sites s cross join function_steps f where f.action is not null and not exists (select 1 from bspots b where b.site = s.site and b.action = f.action and b.n <> '')),
differs as (select p.site, f.function_id from spots p join function_fields f on f.layer = p.layer and f.field = p.name where p.w <> p.n
 union select b.site, f.function_id from bspots b join function_steps f on f.action = b.action where b.w <> b.n),
impact as (select s.site, i.function_id, case when l.site is not null then 'withheld' when d.site is not null then 're-worded' else 'unchanged' end as status
 from sites s cross join ids i left join lost l on l.site = s.site and l.function_id = i.function_id left join differs d on d.site = s.site and d.function_id = i.function_id)
"""


@query("drift_impact", with_views("select * from impact", *NAV, "function_steps", "function_fields", extra=IMPACT))
def drift_impact(t):
    """Functions withheld, re-worded or unchanged by an update, per site."""
    return drift.impact(crawls(t))


@query("drift_roles", with_views("""
select site, role, count(*) filter (where status = 'unchanged') as unchanged, count(*) filter (where status = 're-worded') as re_worded, count(*) filter (where status = 'withheld') as withheld
from impact i join may using (function_id) group by 1, 2""", *NAV, "function_steps", "function_fields", "functions", "role_purposes", "role_artefacts", "function_artefacts", "function_categories", "purpose_allowed",
    extra=IMPACT + """,
may as (select p.role, f.function_id from functions f join role_purposes p using (purpose)
 where not exists (select 1 from function_categories c where c.function_id = f.function_id and not exists (select 1 from purpose_allowed x where x.purpose = f.purpose and x.category = c.category))
 and not exists (select 1 from function_artefacts g where g.function_id = f.function_id and not exists (select 1 from role_artefacts y where y.role = p.role and y.artefact = g.artefact)))"""))
def drift_roles(t):
    """What an update means for each role's functions, per site."""
    return drift.impact_by_role(drift.impact(crawls(t)))


MAY = """
may as (select p.role, f.function_id from functions f join role_purposes p using (purpose)
 where not exists (select 1 from function_categories c where c.function_id = f.function_id and not exists (select 1 from purpose_allowed x where x.purpose = f.purpose and x.category = c.category))
 and not exists (select 1 from function_artefacts g where g.function_id = f.function_id and not exists (select 1 from role_artefacts y where y.role = p.role and y.artefact = g.artefact)))"""
BUTTONS_SQL = """
bchange as (select * from (select coalesce(w.site, n.site) as site, coalesce(w.action, n.action) as action,
 case when n.action is null then 'gone' when w.action is null then 'new' when w.label <> n.label and (c.now_title <> n.title or w.screen <> n.screen) then 'renamed and moved'
  when w.label <> n.label then 'renamed' when c.now_title <> n.title or w.screen <> n.screen then 'moved' end as change, w.label as old_label, n.label as new_label
from (select * from firsts where crawl = 'before') w full join (select * from firsts where crawl = 'after') n on n.site = w.site and n.action = w.action
left join called c on c.site = w.site and c.old_ord = w.ord) where change is not null)"""


@query("drift_relevant", with_views("""
select site, role, kind, count(*) as changes, count(distinct what) as things from (
 select c.site, r.role, 'field' as kind, c.field as what from fchange c join (select distinct role, field from may join function_fields using (function_id)) r using (field)
 union all select b.site, r.role, 'button', b.action from bchange b join (select distinct role, action from may join function_steps using (function_id)) r using (action)
 union all select m.site, r.role, 'module', m.title from (select site, title, layer from called where n <> 1 or t1 <> title or p1 <> path
   union all select m.site, m.title, m.layer from nav_modules m where crawl = 'after' and not exists (select 1 from origin o where o.site = m.site and o.ord = m.ord)) m
  join (select distinct role, layer from may join function_steps using (function_id)) r using (layer)) group by 1, 2, 3""",
    *NAV, "function_steps", "function_fields", "functions", "role_purposes", "role_artefacts", "function_artefacts", "function_categories", "purpose_allowed",
    extra=DRIFT_SQL + "," + BUTTONS_SQL + "," + MAY))
def drift_relevant(t):
    """Changes of every kind that touch what a role's functions use, per site and role."""
    return drift.relevant_changes(crawls(t)).groupBy("site", "role", "kind").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("what").alias("things"))


# --- three crawls: what the second release called anew, the third did again -------------------------------
add_view("past_modules", """
select site, case crawl when 'before' then '2024' else '2025' end as crawl, ord, title, path, layer from {nav_modules}
union all select site, '2026' as crawl, ord, title, path, layer from {nav_modules} where crawl = 'after'""")
add_view("past_fields", """
select site, case crawl when 'before' then '2024' else '2025' end as crawl, ord, screen, f_ord, name, label from {nav_fields}
union all select site, '2026' as crawl, ord, screen, f_ord, replace(name, 'Col ', 'Column for ') as name, label from {nav_fields} where crawl = 'after'""")
add_view("past_controls", """
select site, case crawl when 'before' then '2024' else '2025' end as crawl, ord, screen, c_ord, label from {nav_controls}
union all select site, '2026' as crawl, ord, screen, c_ord, replace(label, 'Zz ', 'Do: ') as label from {nav_controls} where crawl = 'after'""")
add_view("confirmed", """
select distinct site, '2025' as version, label as shown, substr(label, 4) as means from {nav_controls} where label like 'Zz %' and site % 5 <> 0
union all select distinct site, '2026' as version, replace(label, 'Zz ', 'Do: ') as shown, lower(label) as means from {nav_controls} where label like 'Zz %' and site % 5 <> 0
union all select distinct site, '2025' as version, name as shown, substr(name, 5) as means from {nav_fields} where name like 'Col %' and site % 5 <> 0
union all select distinct site, '2026' as version, replace(name, 'Col ', 'Column for ') as shown, name as means from {nav_fields} where name like 'Col %' and site % 5 <> 0""")
PAST_SQL = """
h_modules as (select * replace (case crawl when '2024' then 'before' else 'after' end as crawl) from past_modules where crawl <> '2025'),
h_fields as (select * replace (case crawl when '2024' then 'before' else 'after' end as crawl, case when site % 5 <> 0 then replace(name, 'Column for ', '') else name end as name)
 from past_fields where crawl <> '2025'),
h_controls as (select * replace (case crawl when '2024' then 'before' else 'after' end as crawl), case when label like 'Do: %' and site % 5 <> 0 then substr(label, 5) end as meant
 from past_controls where crawl <> '2025'),""" + (DRIFT_SQL + "," + BUTTONS_SQL).replace("nav_modules", "h_modules").replace("nav_fields", "h_fields").replace(
    "nav_controls", "h_controls").replace("m.title, m.path, m.layer, n.action from h_controls", "m.title, m.path, m.layer, coalesce(n.action, c.meant) as action from h_controls")


@query("drift_history", with_views("""
select site, 'field' as kind, field as what, change, detail from fchange
union all select site, 'button', action, change, concat_ws(' -> ', old_label, new_label) from bchange""",
    "past_modules", "past_fields", "past_controls", "field_catalogue", "action_names", extra=PAST_SQL))
def drift_history(t):
    """The first of three stored crawls against the third, through labels that were renamed, and confirmed, twice."""
    c = drift.between(t["past_modules"], t["past_fields"], t["past_controls"], t["confirmed"], "2024", "2026")
    return drift.field_changes(c).select("site", F.lit("field").alias("kind"), F.col("field").alias("what"), "change", "detail").unionByName(
        drift.button_changes(c).select("site", F.lit("button").alias("kind"), F.col("action").alias("what"), "change", F.concat_ws(" -> ", "old_label", "new_label").alias("detail")))


@query("artefact_pages", with_views("""
select site, a.artefact, m.path from (select * from (select *, row_number() over (partition by site, layer order by ord desc) as rn from nav_modules where crawl = 'after') where rn = 1) m
join (select distinct artefact, layer from artefacts) a using (layer)""", "nav_modules", "artefacts"))
def artefact_pages(t):
    """The page where each artefact's steps happen, per site."""
    return access.layer_pages(t["nav_modules"].where("crawl = 'after'"))


# --- requests in plain words ------------------------------------------------------------------------------
STEM = """case when length(w) > 5 and w like '%ing' then left(w, -3) when length(w) > 4 and w like '%ed' then left(w, -2) when length(w) > 4 and w like '%ies' then left(w, -3) || 'y'
 when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, -1) else w end"""
STOP = "(" + ", ".join(f"'{w}'" for w in dims.STOPWORDS) + ")"


def recognise_sql(utterances: str, vocabulary: str) -> str:
    return f"""
u as ({utterances}), v as ({vocabulary}),
ut as (select distinct id, {STEM} as t from (select id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from u) where w not in {STOP}),
vt as (select distinct function_id, {STEM} as s from (select function_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as w from v) where w not in {STOP}),
close as (select t, s from (select distinct t from ut) a, (select distinct s from vt) b where t = s or (least(length(t), length(s)) >= 5 and abs(length(t) - length(s)) <= 1 and levenshtein(t, s) <= 1)),
ov as (select ut.id, vt.function_id, count(distinct ut.t) as points from ut join close using (t) join vt using (s) group by 1, 2),
ph as (select distinct function_id, array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') as p from v),
un as (select id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as said from u),
bo as (select un.id, ph.function_id, 2 * count(*) as points from un join ph on contains(ph.p, ' ') and contains(un.said, ' ' || ph.p || ' ') where exists (select 1 from ut where ut.id = un.id) group by 1, 2),
sc as (select id, function_id, sum(points)::bigint as score from (select * from ov union all select * from bo) group by 1, 2),
recognised as (select id, function_id, score from (select *, rank() over (partition by id order by score desc) as r from sc) where r = 1)"""


@query("recognise", "with " + recognise_sql("select conv_id * 100 + turn as id, text from conversations", "select 'item-' || item_id::varchar as function_id, text as name from benchmark")
       + "\nselect * from recognised")
def recognise_query(t):
    """Which items each turn of a conversation could mean, ties kept."""
    utt = t["conversations"].select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    voc = t["benchmark"].select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("function_id"), F.col("text").alias("name"))
    return recognise.recognise(utt, voc)


add_view("requests_said", """
select event_id as id, case event_id % 3 when 0 then 'reception' when 1 then 'nurse' else 'administrator' end as role,
 'Please ' || case cast(floor(event_id / 32.0) as bigint) % 4 when 0 then replace(f.function_id, '_', ' ') when 1 then replace(f.function_id, '_', ' and then ') || 'ing'
  when 2 then substr(f.function_id, 1, 5) || 'x' || substr(replace(f.function_id, '_', ' '), 6) else 'the ' || substr(f.function_id, 2) end as text
from {events} join {functions} f on f.fn_ord = event_id % 32""")
VOCAB = "select function_id, replace(function_id, '_', ' ') as name from functions"


@query("recognise_requests", with_views("""
select id, role, count(function_id) as matches, count(*) filter (where ok) as permitted,
 case when count(function_id) = 0 then 'unrecognised' when count(*) filter (where ok) = 1 then 'begin' when count(*) = 1 then 'declined' else 'choose' end as decision,
 case when count(*) filter (where ok) = 1 then min(function_id) filter (where ok) when count(*) = 1 then min(function_id) end as function_id,
 case when count(function_id) > 1 and count(*) filter (where ok) <> 1 then case when count(*) filter (where ok) > 1
  then string_agg(function_id, ',' order by function_id) filter (where ok) else string_agg(function_id, ',' order by function_id) end end as options
from (select q.id, q.role, r.function_id, r.function_id is not null and exists (select 1 from may m where m.role = q.role and m.function_id = r.function_id) as ok
 from requests_said q left join recognised r using (id)) group by 1, 2""",
    "requests_said", "functions", "role_purposes", "role_artefacts", "function_artefacts", "function_categories", "purpose_allowed",
    extra=recognise_sql("select id, text from requests_said", VOCAB) + """,
may as (select p.role, f.function_id from functions f join role_purposes p using (purpose)
 where not exists (select 1 from function_categories c where c.function_id = f.function_id and not exists (select 1 from purpose_allowed x where x.purpose = f.purpose and x.category = c.category))
 and not exists (select 1 from function_artefacts g where g.function_id = f.function_id and not exists (select 1 from role_artefacts y where y.role = p.role and y.artefact = g.artefact)))"""))
def recognise_requests(t):
    """Requests recognised, ties narrowed to what the asker's role may use, and decided."""
    said = t["requests_said"]
    voc = t["functions"].select("function_id", F.replace("function_id", F.lit("_"), F.lit(" ")).alias("name"))
    found = recognise.recognise(said.select("id", "text"), voc)
    return recognise.gate(found, said.select("id", "role")).drop("rule_id")


# --- the log as a stream ------------------------------------------------------------------------------------
@query("audit_stream_daily", with_views("""
select strftime(at_day, '%Y-%m-%d') as day, purpose, count(*) as events, count(*) filter (where event = 'extraction') as extractions, count(*) filter (where event = 'export') as exports,
 count(*) filter (where event = 'purge') as purges, sum(records)::bigint as records
from (select *, date_trunc('day', e.at) as at_day from audit_events e) group by 1, 2""", "audit_events"))
def audit_stream_daily(t):
    """The log streamed from its files: activity per day and purpose, open days included."""
    spark = t.spark
    raw = daily.read_log(spark, t.sf_dir, t["events"].schema, glob="events.parquet", fmt="parquet")
    kind = F.when(F.col("event_id") % 4 == 3, "purge").when(F.col("event_id") % 4 == 2, "export").otherwise("extraction")
    purpose = F.when(F.col("event_id") % 3 == 0, dims.CARE).when(F.col("event_id") % 3 == 1, dims.BILL).otherwise(dims.REG)
    events = raw.select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("event"), purpose.alias("purpose"),
                        F.floor("value").cast("int").alias("records"))
    return daily.run_available(daily.daily_activity(events))
