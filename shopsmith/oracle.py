"""DuckDB-side definitions of the derived catalog inputs, for the SQL oracle.

Written as plain SQL over the driver's tables and prepended to each oracle query
as ``WITH`` clauses.  They state the same fixed derivation rules as
``sources/fixtures.py`` (which builds them with the DataFrame API).
"""

from __future__ import annotations

# The derivation rules of the catalog inputs.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_products": ((), """
select p_partkey as product_key,
  'https://shop.example.com/' || lower(p_type) || '/' || replace(p_name,' ','-') || '-'
    || lpad(cast(p_partkey as varchar),12,'0') || '.html' as url,
  p_name as name, case when p_partkey % 50 = 7 then 'Default' else p_brand end as brand,
  cast(p_retailprice as double) as price, p_size as size_no,
  p_type as l1, split_part(p_name,' ',2) as l2, split_part(p_name,' ',1) as l3
from part"""),
    "v_categories": (("v_products",), """
select product_key, 1 as level, l1 as name from v_products where product_key % 20 <> 11
union all select product_key, 2, l2 from v_products where product_key % 20 <> 9
union all select product_key, 3, l3 from v_products where product_key % 20 <> 9 and product_key % 4 <> 1"""),
    "v_skus": ((), """
select l_partkey as product_key, l_partkey * 100000000 + l_suppkey as sku_id, l_suppkey as variant_no,
  case (l_partkey + l_suppkey) % 9 when 0 then null when 1 then cast(0 as double) else min(p_retailprice) end as price,
  max(l_extendedprice) as list_price
from lineitem join part on p_partkey = l_partkey where l_partkey % 10 <> 3 group by l_partkey, l_suppkey"""),
    "v_images": (("v_products",), """
select product_key, n as seq,
  'https://img.example.com/product/' || cast(product_key as varchar) || '/' || cast(n as varchar)
   || case when n = 2 then '.PNG?w=1200' when n = 3 then '-1200Wx1200H.webp' else '.jpeg' end as image_url
from v_products cross join (values (1),(2),(3),(4)) as v(n) where n <= size_no % 5"""),
    "v_specs": (("v_products",), """
select product_key, 1 as seq, 'SIZE' as name, cast(size_no as varchar) as value from v_products
union all select product_key, 2, ' line ', l1 from v_products
union all select product_key, 3, 'finish', '' from v_products where product_key % 2 = 0"""),
    "v_warehouses": ((), """
select '1_' || cast(s_nationkey as varchar) as id, min(s_name) as name from supplier group by s_nationkey"""),
    "v_existing_l1": (("v_products",), """
select cast(row_number() over (order by l1) as bigint) as id, cast(0 as bigint) as parent_id, l1 as name
from (select distinct l1 from v_products where l1 <> 'PROMO') t"""),
    "v_existing_l2": (("v_products", "v_existing_l1"), """
select cast(100 + row_number() over (order by e.id, t.l2) as bigint) as id, e.id as parent_id, t.l2 as name
from (select distinct l1, l2 from v_products where length(l2) % 2 = 0) t join v_existing_l1 e on e.name = t.l1"""),
    "v_existing_categories": (("v_existing_l1", "v_existing_l2"), """
select * from v_existing_l1 union all select * from v_existing_l2"""),
    "v_existing_brands": ((), """
select cast(row_number() over (order by p_brand) as bigint) as id, upper(p_brand) as name
from (select distinct p_brand from part where length(p_brand) = 8) t"""),
    "v_existing_products": (("v_products",), """
select product_key as id, 'old ' || name as name, product_key % 2 = 0 as is_active, false as is_visible
from v_products where product_key % 3 = 0"""),
    "v_outcomes": (("v_skus", "v_images"), """
select s.sku_id, i.seq,
  case when (s.sku_id + i.seq) % 7 = 0 then 'failed' when (s.sku_id + i.seq) % 7 = 1 then 'already_exists'
       else 'associated' end as status,
  case when (s.sku_id + i.seq) % 7 = 0 then 'HTTP 500 for sku ' || cast(s.sku_id as varchar) end as error
from v_skus s join v_images i on i.product_key = s.product_key where (s.sku_id + i.seq) % 11 <> 0"""),
    "v_listing": ((), """
select distinct l_suppkey as category_no, l_linenumber as page, l_partkey as product_key,
  case when (l_suppkey + l_linenumber) % 13 = 0 then 500 else 200 end as status from lineitem"""),
    "v_links": ((), """
select src, dst, min(pos) as pos from (
 select p.page_id as src, 2*p.page_id+1 as dst, 1 as pos from pages p
 union all select page_id, 2*page_id+2, 2 from pages
 union all select page_id, (page_id*7+3) % 40, 3 from pages) t
where dst in (select page_id from pages) group by src, dst"""),
    "v_attempts": ((), """
select user_id as run_id, event_id as pos,
  case event_type when 'error' then 'rate_limit' when 'click' then 'non_200' when 'signup' then 'other_error'
  else 'ok' end as outcome from events"""),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views (and what they depend on) as CTEs."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
