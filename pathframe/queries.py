"""Queries over the standard tables: an expression, and the SQL that it equals.

Each is compiled from its text.  ``tables`` are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathframe.api import Expression, compile_all, compile_library, run_cases
from pathframe.api import compile as compile_expression
from pathframe.errors import EvalError, code_of


@dataclass(frozen=True)
class Query:
    expression: str
    tables: str
    sql: str | None
    #: A table with rows nested in it, made for the query.
    prepare: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None


def _with_lines(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Orders with their lines, ordered by number, as an array of structs."""
    lines = tables["lineitem"].groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("lines")
    )
    return {"orders": tables["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")}


Q = Query
QUERIES: dict[str, Query] = {
    # navigation and projection
    "field_path": Q("lineitem.l_orderkey", "lineitem", "select l_orderkey from lineitem"),
    "project": Q('orders.{"k": o_orderkey, "t": o_totalprice * 2}', "orders", "select o_orderkey k, o_totalprice * 2 t from orders"),
    "array_filter": Q('nation.{"n": $count([n_nationkey, n_regionkey][$ > 3])}', "nation", "select ((n_nationkey > 3)::int + (n_regionkey > 3)::int)::double n from nation"),
    "wildcard": Q('part.{"k": p_partkey, "v": $join({"a": p_name, "b": p_brand}.*, "|")}', "part", "select p_partkey k, p_name || '|' || p_brand v from part"),
    "descendants": Q('orders.{"o": o_orderkey, "q": $sum(**.l_quantity)}', "orders lineitem", "select o_orderkey o, (select sum(l_quantity) from lineitem where l_orderkey = o_orderkey) q from orders", _with_lines),
    "expression_step": Q("orders.(o_totalprice / 2)", "orders", "select o_totalprice / 2 as value from orders"),
    "array_step": Q('nation.{"v": [n_nationkey, n_regionkey]}', "nation", "select [n_nationkey, n_regionkey] v from nation"),
    "unnest": Q('orders.lines.{"q": l_quantity, "n": l_linenumber}', "orders lineitem", "select l_quantity q, l_linenumber n from lineitem join orders on l_orderkey = o_orderkey", _with_lines),
    "parent": Q('orders.lines.{"o": %.o_orderkey, "ln": l_linenumber}', "orders lineitem", "select o_orderkey o, l_linenumber ln from orders join lineitem on l_orderkey = o_orderkey", _with_lines),
    "position": Q('customer^(c_custkey)#$i.{"k": c_custkey, "i": $i}', "customer", "select c_custkey k, (row_number() over (order by c_custkey) - 1)::double i from customer"),
    "block_variables": Q("(  $rate := 0.1; $fee := function($p) { $p * $rate }; orders.{\"k\": o_orderkey, \"fee\": $fee(o_totalprice)} )", "orders", "select o_orderkey k, o_totalprice * 0.1 fee from orders"),
    # filters
    "filter": Q('lineitem[l_quantity > 45 and l_returnflag = "R"].{"o": l_orderkey, "n": l_linenumber}', "lineitem", "select l_orderkey o, l_linenumber n from lineitem where l_quantity > 45 and l_returnflag = 'R'"),
    "filter_or": Q('part[p_size < 5 or p_retailprice > 1900].p_partkey', "part", "select p_partkey from part where p_size < 5 or p_retailprice > 1900"),
    "filter_in_list": Q('orders[o_orderstatus in ["O", "P"]].o_orderkey', "orders", "select o_orderkey from orders where o_orderstatus in ('O', 'P')"),
    "index_per_parent": Q('orders.{"o": o_orderkey, "first": lines^(l_linenumber)[0].l_linenumber}', "orders lineitem", "select o_orderkey o, (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey) as first from orders", _with_lines),
    "index_list": Q('orders.{"o": o_orderkey, "n": $count(lines[[0..1]])}', "orders lineitem", "select o_orderkey o, least(2, (select count(*) from lineitem where l_orderkey = o_orderkey))::double n from orders", _with_lines),
    "conditional": Q('orders.{"k": o_orderkey, "b": o_totalprice > 100000 ? "big" : "small"}', "orders", "select o_orderkey k, case when o_totalprice > 100000 then 'big' else 'small' end b from orders"),
    "default_operator": Q('events.{"k": event_id, "v": (value > 50 ? value) ?: -1}', "events", "select event_id k, case when value > 50 then value else -1 end v from events"),
    "coalesce_operator": Q('orders.{"k": o_orderkey, "n": lines[l_quantity > 49][0].l_linenumber ?? 0}', "orders lineitem", "select o_orderkey k, coalesce((select min(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_quantity > 49), 0)::double n from orders", _with_lines),
    # joins
    "join_equi": Q('orders@$o.customer@$c[$o.o_custkey = $c.c_custkey].{"k": $o.o_orderkey, "n": $c.c_name}', "orders customer", "select o_orderkey k, c_name n from orders join customer on o_custkey = c_custkey"),
    "join_implicit": Q('orders@$o.customer[$o.o_custkey = c_custkey].{"k": $o.o_orderkey, "n": c_name}', "orders customer", "select o_orderkey k, c_name n from orders join customer on o_custkey = c_custkey"),
    "join_multi": Q('lineitem@$l.orders@$o[$l.l_orderkey = $o.o_orderkey].customer@$c[$o.o_custkey = $c.c_custkey].nation@$n[$c.c_nationkey = $n.n_nationkey].{"o": $o.o_orderkey, "l": $l.l_linenumber, "n": $n.n_name}', "lineitem orders customer nation", "select o_orderkey o, l_linenumber l, n_name n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"),
    "join_theta": Q('nation@$a.nation@$b[$a.n_nationkey < $b.n_nationkey and $a.n_regionkey = $b.n_regionkey].{"a": $a.n_name, "b": $b.n_name}', "nation", "select a.n_name a, b.n_name b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey"),
    "join_range": Q('part@$p.supplier@$s[$p.p_retailprice <= $s.s_acctbal and $s.s_acctbal < $p.p_retailprice + 40].{"p": $p.p_partkey, "s": $s.s_suppkey}', "part supplier", "select p_partkey p, s_suppkey s from part join supplier on p_retailprice <= s_acctbal and s_acctbal < p_retailprice + 40"),
    "join_range_levels": Q('supplier@$s.customer@$c[$c.c_acctbal >= $s.s_acctbal - $s.s_nationkey * 5 and $c.c_acctbal <= $s.s_acctbal + $s.s_suppkey / 10].{"s": $s.s_suppkey, "c": $c.c_custkey}', "supplier customer", "select s_suppkey s, c_custkey c from supplier join customer on c_acctbal >= s_acctbal - s_nationkey * 5 and c_acctbal <= s_acctbal + s_suppkey / 10"),
    "join_cross": Q('region@$r.nation@$n.{"r": $r.r_name, "n": $n.n_name}', "region nation", "select r_name r, n_name n from region cross join nation"),
    "join_positional": Q('customer@$c#$i.supplier@$s#$j[$i = $j].{"i": $i}', "customer supplier", "select (row_number() over () - 1)::double i from supplier"),
    "join_group": Q('orders@$o.customer@$c[$o.o_custkey = $c.c_custkey]{$c.c_mktsegment: {"n": $count($o), "t": $round($sum($o.o_totalprice), 0)}}', "orders customer", "select c_mktsegment as key, count(*)::double n, round_even(sum(o_totalprice::decimal(18,2)), 0)::double t from orders join customer on o_custkey = c_custkey group by 1"),
    "semi_join": Q("customer[c_custkey in $$.orders.o_custkey].c_custkey", "customer orders", "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "anti_join": Q("orders[$not(o_orderkey in $$.lineitem.l_orderkey)].o_orderkey", "orders lineitem", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "lookup_left": Q('customer.($k := c_custkey; {"k": $k, "n": $count($$.orders[o_custkey = $k])})', "customer orders", "select c_custkey k, (select count(*) from orders where o_custkey = c_custkey)::double n from customer"),
    # aggregates and groups
    "agg_sum": Q("$sum(lineitem.l_quantity)", "lineitem", "select sum(l_quantity) as value from lineitem"),
    "agg_average": Q("$round($average(orders.o_totalprice), 2)", "orders", "select round_even(avg(o_totalprice), 2) as value from orders"),
    "agg_min_max": Q('{"lo": $min(part.p_retailprice), "hi": $max(part.p_retailprice), "n": $count(part)}', "part", "select min(p_retailprice) lo, max(p_retailprice) hi, count(*)::double n from part"),
    "group_by": Q('lineitem{l_returnflag: {"n": $count($), "q": $sum(l_quantity)}}', "lineitem", "select l_returnflag as key, count(*)::double n, sum(l_quantity) q from lineitem group by 1"),
    "group_filtered": Q('lineitem[l_quantity > 45]{l_returnflag: {"n": $count($), "hi": $max(l_extendedprice)}}', "lineitem", "select l_returnflag as key, count(*)::double n, max(l_extendedprice) hi from lineitem where l_quantity > 45 group by 1"),
    "filtered_agg": Q('lineitem{l_linestatus: $count($[l_returnflag = "R"])}', "lineitem", "select l_linestatus as key, (count(*) filter (l_returnflag = 'R'))::double as value from lineitem group by 1"),
    "group_pairs": Q('orders{o_orderstatus: $count($), "p" & o_orderpriority: $count($)}', "orders", "select o_orderstatus as key, count(*)::double as value from orders group by 1 union all select 'p' || o_orderpriority, count(*)::double from orders group by 1"),
    "scan_fusion": Q('( $x := lineitem[l_quantity > 10]; {"n": $count($x), "q": $sum($x.l_quantity), "hi": $max($x.l_extendedprice), "r": $count($x[l_returnflag = "R"])} )', "lineitem", "select count(*)::double n, sum(l_quantity) q, max(l_extendedprice) hi, (count(*) filter (l_returnflag = 'R'))::double r from lineitem where l_quantity > 10"),
    "distinct": Q("$distinct(events.event_type)", "events", "select distinct event_type from events"),
    "count_distinct": Q("$count($distinct(orders.o_custkey))", "orders", "select count(distinct o_custkey)::double as value from orders"),
    "join_agg": Q('orders{o_orderstatus: $join($sort($distinct(o_orderpriority)), "|")}', "orders", "select o_orderstatus as key, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as value from orders group by 1"),
    "group_distinct": Q('orders{o_orderpriority: $count($distinct(o_custkey))}', "orders", "select o_orderpriority as key, count(distinct o_custkey)::double as value from orders group by 1"),
    # order, limits, sets
    "sort_limit": Q("orders^(>o_totalprice, o_orderkey)[[0..9]].{\"k\": o_orderkey, \"t\": o_totalprice}", "orders", "select o_orderkey k, o_totalprice t from orders order by o_totalprice desc, o_orderkey limit 10"),
    "top_one": Q("part^(>p_retailprice, p_partkey)[0].p_partkey", "part", "select p_partkey from part order by p_retailprice desc, p_partkey limit 1"),
    "last_one": Q("part^(p_retailprice, p_partkey)[-1].p_partkey", "part", "select p_partkey from part order by p_retailprice desc, p_partkey desc limit 1"),
    "page": Q("customer^(c_custkey)[[20..29]].c_name", "customer", "select c_name from customer order by c_custkey limit 10 offset 20"),
    "sort_array": Q('embeddings.{"k": vec_id, "lo": $sort(embedding)[0], "last": $reverse(embedding)[0]}', "embeddings", "select vec_id k, list_sort(embedding)[1] lo, list_reverse(embedding)[1] as last from embeddings"),
    "sort_by_function": Q('embeddings.{"k": vec_id, "hi": $sort(embedding, function($a, $b) { $a < $b })[0]}', "embeddings", "select vec_id k, list_max(embedding) hi from embeddings"),
    "union": Q("[customer.c_name, supplier.s_name]", "customer supplier", "select c_name from customer union all select s_name from supplier"),
    "union_distinct": Q("$distinct($append(customer.c_nationkey, supplier.s_nationkey))", "customer supplier", "select c_nationkey from customer union select s_nationkey from supplier"),
    "except": Q("$distinct(nation[$not(n_nationkey in $$.supplier.s_nationkey)].n_nationkey)", "nation supplier", "select n_nationkey from nation except select s_nationkey from supplier"),
    "intersect": Q("$distinct(customer[c_nationkey in $$.supplier.s_nationkey].c_nationkey)", "customer supplier", "select c_nationkey from customer intersect select s_nationkey from supplier"),
    "range": Q("[1..100]", "region", "select unnest(range(1, 101))::double as value"),
    # text
    "string_functions": Q('part.{"k": p_partkey, "u": $uppercase(p_name), "l": $lowercase(p_brand), "n": $length(p_name), "s": $substring(p_name, 2, 3), "b": $substringBefore(p_name, " "), "a": $substringAfter(p_type, " ")}', "part", "select p_partkey k, upper(p_name) u, lower(p_brand) l, length(p_name)::double n, substring(p_name, 3, 3) s, split_part(p_name, ' ', 1) b, case when instr(p_type, ' ') > 0 then substring(p_type, instr(p_type, ' ') + 1) else p_type end a from part"),
    "concat": Q('nation.(n_name & "-" & n_nationkey & "-" & nothing)', "nation", "select n_name || '-' || n_nationkey || '-' as value from nation"),
    "number_text": Q('part.{"k": p_partkey, "s": $string(p_retailprice), "t": $string(p_retailprice / 8)}', "part", "select p_partkey k, rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') s, rtrim(rtrim(printf('%.6f', p_retailprice / 8), '0'), '.') t from part"),
    "encode_url": Q('pages.{"k": page_id, "d": $decodeUrl($encodeUrl(url)), "e": $decodeUrl("%7Ea%2Fb%20" & page_id & "+%3d")}', "pages", "select page_id k, url d, '~a%2Fb ' || page_id || '+%3d' e from pages"),
    "replace_signs": Q('part.{"k": p_partkey, "s": $replace(p_type, /[aeiou]/, "\\\\$$")}', "part", "select p_partkey k, regexp_replace(p_type, '[aeiou]', '\\\\$', 'g') s from part"),
    # positions, ties and groups
    "sort_ties": Q('customer^(c_nationkey)[[0..29]].{"k": c_custkey}', "customer", "select c_custkey k from (select *, row_number() over () as place from customer) order by c_nationkey, place limit 30"),
    "sort_ties_first": Q('orders^(>o_orderpriority)[0].o_orderkey', "orders", "select o_orderkey from (select *, row_number() over () as place from orders) order by o_orderpriority desc, place limit 1"),
    "page_ties": Q('customer[c_acctbal > 0]^(>c_mktsegment)[[40..59]].c_custkey', "customer", "select c_custkey from (select *, row_number() over () as place from customer) where c_acctbal > 0 order by c_mktsegment desc, place limit 20 offset 40"),
    "position_ties": Q('supplier^(s_nationkey)#$i.{"k": s_suppkey, "i": $i}', "supplier", "select s_suppkey k, (row_number() over (order by s_nationkey, place) - 1)::double i from (select *, row_number() over () as place from supplier)"),
    "last_two": Q('part^(p_size)[-2].p_partkey', "part", "select p_partkey from (select *, row_number() over () as place from part) order by p_size desc, place desc limit 1 offset 1"),
    "computed_position": Q('nation^(n_name)[n_regionkey].n_name', "nation", "select n_name from (select *, row_number() over (order by n_name) - 1 as place from nation) where place = n_regionkey"),
    "computed_position_from_end": Q('customer^(c_custkey)[-(c_nationkey + 1)].c_custkey', "customer", "select c_custkey from (select *, row_number() over (order by c_custkey desc) as back from customer) where back = c_nationkey + 1"),
    "constant_position": Q('customer^(c_custkey)[2 * 3 + 1].c_name', "customer", "select c_name from customer order by c_custkey limit 1 offset 7"),
    "group_pairs_values": Q('orders{o_orderstatus: {"n": $count($), "t": $max(o_totalprice)}, "all": {"n": $count($[o_totalprice > 100000])}}', "orders", "select o_orderstatus as key, count(*)::double n, max(o_totalprice) t from orders group by 1 union all select 'all', (count(*) filter (o_totalprice > 100000))::double, null from orders"),
    "bucket_append": Q('orders{o_orderstatus: {"n": $count(lines.l_linenumber), "q": $sum(lines.l_quantity), "hi": $max(lines.l_quantity), "a": $round($average(lines.l_quantity), 6)}}', "orders lineitem", "select o_orderstatus as key, count(l_linenumber)::double n, sum(l_quantity) q, max(l_quantity) hi, round_even(avg(l_quantity), 6) a from orders left join lineitem on l_orderkey = o_orderkey group by 1", _with_lines),
    "bucket_append_values": Q('orders[o_orderkey < 100]{o_orderstatus: $sort(lines.l_linenumber)}', "orders lineitem", "select o_orderstatus as key, list(l_linenumber order by l_linenumber) as value from orders join lineitem on l_orderkey = o_orderkey where o_orderkey < 100 group by 1", _with_lines),
    "bucket_reduce": Q('lineitem{l_returnflag: $reduce(l_quantity, function($a, $b) { $a > $b ? $a : $b })}', "lineitem", "select l_returnflag as key, max(l_quantity) as value from lineitem group by 1"),
    "bucket_reduce_lambda": Q('( $most := function($x) { $reduce($x, function($a, $b) { $a > $b ? $a : $b }) }; orders{o_orderstatus: {"hi": $most(o_totalprice)}} )', "orders", "select o_orderstatus as key, max(o_totalprice) hi from orders group by 1"),
    # bound rows
    "variable_step": Q('orders@$o.customer@$c[$o.o_custkey = $c.c_custkey].$c.c_name', "orders customer", "select c_name from orders join customer on o_custkey = c_custkey"),
    "dynamic_after_join": Q('orders@$o.customer@$c[$o.o_custkey = $c.c_custkey].$formatNumber($o.o_totalprice, "#,##0.00")', "orders customer", "select '\"' || format('{:,.2f}', o_totalprice) || '\"' as value from orders join customer on o_custkey = c_custkey"),
    "dynamic_with_position": Q('nation^(n_nationkey)#$i.$formatInteger($i + n_regionkey, "000")', "nation", "select '\"' || lpad((n_nationkey + n_regionkey)::varchar, 3, '0') || '\"' as value from nation"),
    "dynamic_with_parent": Q('orders[o_orderkey < 50].lines.$formatInteger(%.o_orderkey * 10 + l_linenumber, "00000")', "orders lineitem", "select '\"' || lpad((o_orderkey * 10 + l_linenumber)::varchar, 5, '0') || '\"' as value from orders join lineitem on l_orderkey = o_orderkey where o_orderkey < 50", _with_lines),
    "lookup_first": Q('customer.($k := c_custkey; {"k": $k, "first": $$.orders[o_custkey = $k]^(o_orderdate, o_orderkey)[0].o_orderkey})', "customer orders", "select c_custkey k, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate, o_orderkey limit 1) as first from customer"),
    "lookup_last": Q('customer.($k := c_custkey; {"k": $k, "t": $$.orders[o_custkey = $k]^(o_totalprice, o_orderkey)[-1].o_totalprice})', "customer orders", "select c_custkey k, (select max(o_totalprice) from orders where o_custkey = c_custkey) t from customer"),
    "lookup_any": Q('supplier.($k := s_nationkey; {"k": s_suppkey, "n": $$.nation[n_nationkey = $k][0].n_name})', "supplier nation", "select s_suppkey k, n_name n from supplier left join nation on n_nationkey = s_nationkey"),
    "lookup_all": Q('region.($k := r_regionkey; {"k": $k, "n": $$.nation[n_regionkey = $k]^(n_name).n_name})', "region nation", "select r_regionkey k, (select list(n_name order by n_name) from nation where n_regionkey = r_regionkey) n from region"),
    # functions
    "shadowing": Q('( $sum := function($x) { $x * 7 }; $floor := function($x) { "f" & $x }; nation.{"k": n_nationkey, "v": $sum(n_regionkey), "f": $floor(n_regionkey)} )', "nation", "select n_nationkey k, n_regionkey * 7.0::double v, 'f' || n_regionkey f from nation"),
    "unnest_function": Q('( $both := function($x) { [$x, $x * 10] }; nation.$both(n_nationkey) )', "nation", "select unnest([n_nationkey, n_nationkey * 10])::double as value from nation"),
    "comments": Q('/* names */ nation /* of */ . /* all */ n_name /* done */', "nation", "select n_name from nation"),    "trim": Q("documents.$trim(text)", "documents", "select trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') as value from documents"),
    "pad": Q('nation.{"r": $pad(n_name, 12, "*"), "l": $pad(n_name, -12)}', "nation", "select case when length(n_name) >= 12 then n_name else rpad(n_name, 12, '*') end r, case when length(n_name) >= 12 then n_name else lpad(n_name, 12, ' ') end l from nation"),
    "split": Q('part.{"k": p_partkey, "w": $split(p_type, " ", 2)}', "part", "select p_partkey k, string_split(p_type, ' ')[1:2] w from part"),
    "replace": Q('part.{"k": p_partkey, "s": $replace(p_name, "a", "-"), "r": $replace(p_type, /([A-Z])/, "<$1>")}', "part", "select p_partkey k, replace(p_name, 'a', '-') s, regexp_replace(p_type, '([A-Z])', '<\\1>', 'g') r from part"),
    "regex_contains": Q("documents[$contains(text, /[0-9]{3}/)].doc_id", "documents", "select doc_id from documents where regexp_matches(text, '[0-9]{3}')"),
    "match": Q('part.{"k": p_partkey, "m": $match(p_type, /([A-Z]+)/).match}', "part", "select p_partkey k, regexp_extract_all(p_type, '[A-Z]+') m from part"),
    "base64": Q('nation.{"e": $base64encode(n_name), "d": $base64decode($base64encode(n_name))}', "nation", "select base64(encode(n_name)) e, n_name d from nation"),
    "url_encode": Q('pages.{"k": page_id, "e": $encodeUrlComponent(url), "d": $decodeUrlComponent($encodeUrlComponent(url))}', "pages", "select page_id k, url_encode(url) e, url d from pages"),
    "format_base": Q('customer.{"k": c_custkey, "h": $formatBase(c_custkey, 16)}', "customer", "select c_custkey k, lower(hex(c_custkey)) h from customer"),
    # numbers
    "arithmetic": Q('lineitem.{"o": l_orderkey, "n": l_linenumber, "v": l_quantity * 2 - 1, "m": l_quantity % 7, "g": -l_quantity, "d": l_quantity / 4}', "lineitem", "select l_orderkey o, l_linenumber n, l_quantity * 2 - 1 v, l_quantity % 7 m, -l_quantity g, l_quantity / 4 d from lineitem"),
    "round": Q("lineitem.$round(l_extendedprice, 1)", "lineitem", "select round_even(cast(l_extendedprice as decimal(18,2)), 1)::double as value from lineitem"),
    "numeric_functions": Q('customer.{"k": c_custkey, "a": $abs(c_acctbal), "f": $floor(c_acctbal), "c": $ceil(c_acctbal), "s": $round($sqrt($abs(c_acctbal)), 6), "p": $power(c_nationkey, 2)}', "customer", "select c_custkey k, abs(c_acctbal) a, floor(c_acctbal) f, ceil(c_acctbal) c, round_even(sqrt(abs(c_acctbal)), 6) s, power(c_nationkey, 2)::double p from customer"),
    "number_parse": Q('part.{"k": p_partkey, "n": $number($substringAfter(p_brand, "#")), "t": $type($number("12.5"))}', "part", "select p_partkey k, cast(split_part(p_brand, '#', 2) as double) n, 'number' t from part"),
    "booleans": Q('customer.{"k": c_custkey, "b": $boolean(c_nationkey), "n": $not(c_acctbal > 0), "e": $exists(c_name), "x": $exists(nothing)}', "customer", "select c_custkey k, c_nationkey <> 0 b, not (c_acctbal > 0) n, true e, false x from customer"),
    # dates
    "to_millis": Q('events.{"k": event_id, "m": $toMillis(ts)}', "events", "select event_id k, (epoch_us(ts) // 1000)::double m from events"),
    "from_millis": Q('events.{"k": event_id, "t": $fromMillis($toMillis(ts)), "d": $fromMillis($toMillis(ts), "[Y0001]/[M01]/[D01]")}', "events", "select event_id k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') t, strftime(ts, '%Y/%m/%d') d from events"),
    # arrays, objects and functions as values
    "filter_array": Q('embeddings.{"k": vec_id, "n": $count($filter(embedding, function($x) { $x > 0 }))}', "embeddings", "select vec_id k, len(list_filter(embedding, lambda x: x > 0))::double n from embeddings"),
    "map_array": Q('embeddings.{"k": vec_id, "s": $round($sum($map(embedding, function($x) { $x * $x })), 3)}', "embeddings", "select vec_id k, round_even(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 3) s from embeddings"),
    "map_index": Q('embeddings.{"k": vec_id, "i": $map(embedding, function($x, $i) { $i })[-1]}', "embeddings", "select vec_id k, (len(embedding) - 1)::double i from embeddings"),
    "map_index_values": Q('embeddings.{"k": vec_id, "s": $round($sum($map(embedding[[0..3]], function($x, $i) { $x * $i })), 4)}', "embeddings", "select vec_id k, round_even(embedding[2]::double + 2 * embedding[3]::double + 3 * embedding[4]::double, 4) s from embeddings"),
    "reduce": Q('embeddings.{"k": vec_id, "m": $reduce(embedding, function($a, $b) { $a > $b ? $a : $b })}', "embeddings", "select vec_id k, list_max(embedding)::double m from embeddings"),
    "zip": Q('embeddings.{"k": vec_id, "z": $zip(embedding[[0..2]], embedding[[1..5]])}', "embeddings", "select vec_id k, [[embedding[1], embedding[2]], [embedding[2], embedding[3]], [embedding[3], embedding[4]]] z from embeddings"),
    "single": Q('nation.{"k": n_nationkey, "v": $single([n_nationkey], function($x) { $x >= 0 })}', "nation", "select n_nationkey k, n_nationkey v from nation"),
    "merge": Q('nation.$merge([{"k": n_nationkey, "a": 1}, {"a": n_name}])', "nation", "select n_nationkey k, n_name a from nation"),
    "each": Q('nation.{"k": n_nationkey, "v": $each({"a": n_name, "b": "x"}, function($v, $k) { $k & "=" & $v })}', "nation", "select n_nationkey k, ['a=' || n_name, 'b=x'] v from nation"),
    "sift": Q('nation.$sift({"k": n_nationkey, "r": n_regionkey}, function($v) { $v > 2 })', "nation", "select case when n_nationkey > 2 then n_nationkey end k, case when n_regionkey > 2 then n_regionkey end r from nation"),
    "keys_lookup": Q('nation.{"k": $keys({"a": n_nationkey, "b": n_name}), "v": $lookup({"a": n_nationkey}, "a")}', "nation", "select ['a', 'b'] k, n_nationkey v from nation"),
    "spread": Q('nation.{"k": n_nationkey, "n": $count($spread({"a": n_name, "b": n_name})), "v": $join($spread({"a": n_name, "b": "x"}).*, "|")}', "nation", "select n_nationkey k, 2::double n, n_name || '|x' v from nation"),
    "flatten": Q('nation.{"k": n_nationkey, "v": $flatten([[n_nationkey, 1], [2, 3]])}', "nation", "select n_nationkey k, [n_nationkey, 1, 2, 3]::double[] v from nation"),
    "partial_application": Q('( $half := function($x, $y) { $x / $y }; $by2 := $half(?, 2); orders.{"k": o_orderkey, "h": $by2(o_totalprice)} )', "orders", "select o_orderkey k, o_totalprice / 2 h from orders"),
    "chain": Q('part.{"k": p_partkey, "s": p_name ~> $uppercase() ~> $substringBefore(" ")}', "part", "select p_partkey k, split_part(upper(p_name), ' ', 1) s from part"),
    "compose": Q('( $f := $trim ~> $uppercase; part.{"k": p_partkey, "s": $f(p_name)} )', "part", "select p_partkey k, upper(trim(p_name)) s from part"),
    "transform": Q('orders ~> |$|{"o_orderstatus": $lowercase(o_orderstatus), "flag": o_totalprice > 100000}, ["o_orderdate", "o_orderpriority"]|', "orders", "select o_orderkey, o_custkey, lower(o_orderstatus) o_orderstatus, o_totalprice, o_totalprice > 100000 flag from orders"),
    "transform_nested": Q('orders.{"o": o_orderkey, "s": $sum(($ ~> |lines[l_quantity > 40]|{"l_quantity": 40.0}|).lines.l_quantity)}', "orders lineitem", "select o_orderkey o, (select sum(least(l_quantity, 40)) from lineitem where l_orderkey = o_orderkey) s from orders", _with_lines),
    "eval_inline": Q('orders.{"k": o_orderkey, "v": $eval("o_totalprice + 1")}', "orders", "select o_orderkey k, o_totalprice + 1 v from orders"),
    "step_stage": Q('nation.([n_nationkey, n_regionkey, 7])[1]', "nation", "select n_regionkey::double as value from nation"),
    "index_per_item": Q("orders.lines[0].l_linenumber", "orders lineitem", "select min(l_linenumber) l_linenumber from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey", _with_lines),
    "index_of_stream": Q("(orders.lines)^(l_extendedprice, l_partkey, l_linenumber)[0].l_linenumber", "orders lineitem", "select l_linenumber from lineitem join orders on l_orderkey = o_orderkey order by l_extendedprice, l_partkey, l_linenumber limit 1", _with_lines),
    "append_arrays": Q('embeddings.{"k": vec_id, "n": $count($append(embedding, [1, 2]))}', "embeddings", "select vec_id k, (len(embedding) + 2)::double n from embeddings"),
    "lambda_signature": Q('( $add := function($x, $y)<nn:n> { $x + $y }; supplier.{"k": s_suppkey, "v": $add(s_acctbal, 1)} )', "supplier", "select s_suppkey k, s_acctbal + 1 v from supplier"),
    "inline_rows": Q('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}].{"s": a * 2, "b": b}', "region", "select * from (values (2::double, 'x'), (4::double, 'y')) t(s, b)"),
    "root_scalar": Q('{"nations": $count($$.nation), "regions": $count($$.region)}', "nation region", "select (select count(*) from nation)::double nations, (select count(*) from region)::double regions"),
    "assert_rows": Q('supplier.{"k": s_suppkey, "a": $exists($assert(s_suppkey >= 0, "negative"))}', "supplier", "select s_suppkey k, false a from supplier"),
    "join_text": Q('part.{"k": p_partkey, "j": $join($split(p_type, " "), "/")}', "part", "select p_partkey k, replace(p_type, ' ', '/') j from part"),
    "join_lookup_group": Q('supplier@$s.nation@$n[$s.s_nationkey = $n.n_nationkey].region@$r[$n.n_regionkey = $r.r_regionkey]{$r.r_name: {"n": $count($s), "hi": $max($s.s_acctbal)}}', "supplier nation region", "select r_name as key, count(*)::double n, max(s_acctbal) hi from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"),
    "membership": Q('embeddings.{"k": vec_id, "b": label in [1, 3, 5]}', "embeddings", "select vec_id k, label in (1, 3, 5) b from embeddings"),
}


#: Expressions that are bound, or given functions, from outside: name to (expression, tables, what is given, SQL).
GIVEN: dict[str, tuple[str, str, Callable[[Expression], Expression], str]] = {
    "assigned_variable": (
        'lineitem[l_quantity > $least and l_returnflag = $flag].{"o": l_orderkey, "n": l_linenumber}', "lineitem",
        lambda e: e.assign("least", 40).assign("flag", "A"),
        "select l_orderkey o, l_linenumber n from lineitem where l_quantity > 40 and l_returnflag = 'A'",
    ),
    "registered_column": (
        'part.{"k": p_partkey, "v": $tagged(p_brand)}', "part",
        lambda e: e.register_column("tagged", lambda c: F.concat(F.lit("<"), c, F.lit(">")), "string"),
        "select p_partkey k, '<' || p_brand || '>' v from part",
    ),
    "registered_aggregate": (
        'lineitem{l_returnflag: $spreadOf(l_quantity)}', "lineitem",
        lambda e: e.register_column("spreadOf", lambda c: F.array_max(c) - F.array_min(c), "double"),
        "select l_returnflag as key, max(l_quantity) - min(l_quantity) as value from lineitem group by 1",
    ),
}


#: Expressions over tables that end in an error, and its code.
FAILING: dict[str, tuple[str, str, str]] = {
    "group_clash": ('orders{o_orderstatus: $count($), "O": $max(o_totalprice)}', "orders", "D1009"),
    "error_function": ('nation[n_nationkey = 3].$error("stop at " & n_name)', "nation", "D3137"),
    "assertion": ('nation.$assert(n_nationkey < 20, "too many")', "nation", "D3141"),
    "bare_call": ("nation.(sum([n_nationkey]))", "nation", "T1005"),
    "wrong_types": ('nation.(n_name * 2)', "nation", "T2001"),
    "key_type": ("nation{n_nationkey: n_name}", "nation", "T1003"),
    "root_of_negative": ("nation.$sqrt(-n_nationkey - 1)", "nation", "D3060"),
}

#: One expression for each code of an error over documents, beside those above; ``bare`` ones fail when compiled.
CODES: dict[str, str] = {
    "'a": "S0101", "1e999": "S0102", r"'\y'": "S0103", r"'\u12'": "S0104", "`a": "S0105", "/* a": "S0106", "1 2": "S0201", "(1]": "S0202", "[1": "S0203", "function(x){1}": "S0208",
    "a{'x': 1}{'y': 2}": "S0210", "1 := 2": "S0212", "a.1": "S0213", "a@b": "S0214", "a[0]@$b": "S0215", "%": "S0217", "//": "S0301", "/a": "S0302",
    "-'a'": "D1002", "{'a': 1, 'a' & '': 2}": "D1009", "[1..20000000]": "D2014", "1/0 & ''": "D3001", "$replace('a', '', 'b')": "D3010", "$replace('a', 'a', 'b', -1)": "D3011",
    "$replace('a', /a/, function($m) { 1 })": "D3012", "$split('a', 'b', -1)": "D3020", "$number('x')": "D3030", "$match('a', /a/, -1)": "D3040", "$reduce([1, 2], function($x) { 1 })": "D3050",
    "$sqrt(-1)": "D3060", "$power(10, 400)": "D3061", "$sort([1, 'a'])": "D3070", "$formatNumber(1, '0;0;0')": "D3080", "$formatNumber(1, '0.0.0')": "D3081", "$formatNumber(1, '0%%')": "D3082",
    "$formatNumber(1, '0‰‰')": "D3083", "$formatNumber(1, '0%‰')": "D3084", "$formatNumber(1, '.')": "D3085", "$formatNumber(1, '0a0')": "D3086", "$formatNumber(1, '0,.0')": "D3087",
    "$formatNumber(1, '0,')": "D3088", "$formatNumber(1, '0,,0')": "D3089", "$formatNumber(1, '0#')": "D3090", "$formatNumber(1, '0.#0')": "D3091", "$formatNumber(1, '0e0%')": "D3092",
    "$formatNumber(1, '0e#')": "D3093", "$formatBase(1, 40)": "D3100", "$toMillis('x')": "D3110", "$eval('1 +')": "D3120", "$eval('1 + \"a\"')": "D3121", "$formatInteger(1, '#')": "D3130",
    "$formatInteger(1, '0٠')": "D3131", "$fromMillis(1, '[q]')": "D3132", "$fromMillis(1, '[YN]')": "D3133", "$fromMillis(1, '[Z000000]')": "D3134", "$fromMillis(1, '[Y')": "D3135",
    "$toMillis('2020:10', '[Y]:[m]')": "D3136", "$error('no')": "D3137", "$single([1, 2])": "D3138", "$single([1, 2], function($x) { $x > 2 })": "D3139", "$decodeUrl('%E0%A4%A')": "D3140",
    "$assert(false)": "D3141", "$sum('a')": "T0412", "$uppercase(1)": "T0410", "{1: 2}": "T1003", "sum(1)": "T1005", "$nothere(1)": "T1006", "sum(?, 1)": "T1007", "$nothere(?, 1)": "T1008",
    "$match('a', function($s) { 1 })": "T1010", "'a' + 1": "T2001", "1 + 'a'": "T2002", "[1.5..2]": "T2003", "[1..2.5]": "T2004", "1 ~> 2": "T2006", "[{'a': 1}, {'a': 'x'}]^(a)": "T2007",
    "[{'a': true}, {'a': false}]^(a)": "T2008", "1 < 'a'": "T2009", "true < 1": "T2010", "{'a': 1} ~> |$|1|": "T2011", "{'a': 1} ~> |$|{}, 1|": "T2012", "($clone := 1; {'a': 1} ~> |$|{}|)": "T2013",
    "($f := function() { 1 + $f() }; $f())": "U1001",
}


def _given(expression: str, tables: str, prepare: Callable[[Expression], Expression]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: prepare(compile_expression(expression)).on({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()})


def _failing(expression: str, tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """The code of the error in which the expression ends, when planned or when run."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        code = None
        try:
            compile_expression(expression).on({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}).write.format("noop").mode("overwrite").save()
        except Exception as e:  # the code is the result
            code = code_of(e)
        return spark.range(1).select(F.lit(code).cast("string").alias("code"))

    return query


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each expression's code, as the batch interface gives it on workers."""
    rows = spark.createDataFrame([(t,) for t in CODES], "expression string")

    @F.pandas_udf("string")
    def code(texts: pd.Series) -> pd.Series:
        got = run_cases([{"id": str(i), "expr": t, "input": {}} for i, t in enumerate(texts)])
        return pd.Series([got[str(i)].get("err", "none").split(":")[-1] for i in range(len(texts))])

    return rows.select("expression", code("expression").alias("code"))


def _compile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compiled together: those that fail are listed, the others' results follow."""
    got = compile_all({"sum": "$sum([1..4])", "open": "[1", "name": "'a' & 1", "literal": "a.1"})
    rows = [(k, e.evaluate_json(None), None) for k, e in got.results.items()] + [(k, None, e.code) for k, e in got.failures.items()]
    return spark.createDataFrame(rows, "name string, result string, code string")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a library over documents, and the code of a call after it was closed."""
    library = compile_library({"twice": "function($x) { $x * 2 }", "label": "function($s) { '<' & $s & '>' }"})
    e = compile_expression("$label($twice(n))").use_library(library)
    rows = [(str(n), e.evaluate({"n": n})) for n in range(5)]
    library.close()
    try:
        e.evaluate({"n": 1})
    except EvalError as x:
        rows.append(("closed", x.code))
    return spark.createDataFrame(rows, "k string, v string")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of an evaluation that takes too long and of one that goes too deep; one within its limits ends."""
    endless = "($f := function($n) { $f($n + 1) }; $f(0))"
    deep = "($f := function($n) { $n = 0 ? 0 : 1 + $f($n - 1) }; $f({}))"
    rows = []
    for name, e in (
        ("time", compile_expression(endless).set_timeout(100)),
        ("depth", compile_expression(deep.replace("{}", "60")).set_max_depth(50)),
        ("within", compile_expression(deep.replace("{}", "40")).set_max_depth(50).set_timeout(10_000)),
    ):
        try:
            rows.append((name, str(e.evaluate())))
        except EvalError as x:
            rows.append((name, x.code))
    return spark.createDataFrame(rows, "k string, v string")


def _values(rows: list[tuple[str | None, ...]], columns: str) -> str:
    shown = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


#: Queries of the interface, and their SQL.
INTERFACE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "error_codes": (_codes, _values(list(CODES.items()), "expression, code")),
    "compile_all": (_compile_all, _values([("sum", "10", None), ("open", None, "S0203"), ("name", '"a1"', None), ("literal", None, "S0213")], "name, result, code")),
    "library": (_library, _values([*((str(n), f"<{2 * n}>") for n in range(5)), ("closed", "T2006")], "k, v")),
    "limits": (_limits, _values([("time", "U1001"), ("depth", "U1001"), ("within", "40")], "k, v")),
}


def _run(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in q.tables.split()}
        return compile_expression(q.expression).on(q.prepare(tables) if q.prepare else tables)

    return query


# -- the document evaluator over JSON text -----------------------------------------

# SQL of numbers in words.
_UNITS = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_DECADES = "['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
_ORDERED = (
    "['zeroth', 'first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth', 'eleventh', 'twelfth', 'thirteenth', 'fourteenth', 'fifteenth', 'sixteenth', "
    "'seventeenth', 'eighteenth', 'nineteenth']"
)
_IN_WORDS = f"case when n_nationkey < 20 then {_UNITS}[n_nationkey + 1] when n_nationkey % 10 = 0 then 'twenty' else 'twenty-' || {_UNITS}[n_nationkey % 10 + 1] end"
_LOW = "(c_custkey % 100)"
_ORDINAL = (
    f"(case when c_custkey >= 100 then {_UNITS}[c_custkey // 100 + 1] || ' hundred' || case when {_LOW} = 0 then 'th' else ' and ' end else '' end || "
    f"case when {_LOW} = 0 then '' when {_LOW} < 20 then {_ORDERED}[{_LOW} + 1] when {_LOW} % 10 = 0 then replace({_DECADES}[{_LOW} // 10 - 1], 'ty', 'tieth') "
    f"else {_DECADES}[{_LOW} // 10 - 1] || '-' || {_ORDERED}[{_LOW} % 10 + 1] end)"
)


DOCUMENT_QUERIES: dict[str, tuple] = {
    # name: expression, table, columns of the document, SQL of (k, v), rows that are meant
    "json_eval": ("$eval(props).k", "events", ["event_id", "props"], "select event_id k, cast(cast(props->>'$.k' as bigint) as varchar) v from events"),
    "json_recursion": (
        "( $fact := function($n) { $n <= 1 ? 1 : $n * $fact($n - 1) }; $fact(c_custkey % 10) )",
        "customer",
        ["c_custkey"],
        "select c_custkey k, cast(cast(factorial((c_custkey % 10)::int) as bigint) as varchar) v from customer",
    ),
    "json_format_number": ('$formatNumber(o_totalprice, "#,##0.00")', "orders", ["o_orderkey", "o_totalprice"], "select o_orderkey k, '\"' || format('{:,.2f}', o_totalprice) || '\"' v from orders"),
    "json_format_integer": ('$formatInteger(n_nationkey, "w")', "nation", ["n_nationkey"], f"select n_nationkey k, '\"' || {_IN_WORDS} || '\"' v from nation"),
    "json_format_ordinal": (
        '$formatInteger(c_custkey, "w;o") & " " & $formatInteger(c_custkey, "1;o")',
        "customer",
        ["c_custkey"],
        f"""select c_custkey k, '"' || {_ORDINAL} || ' ' || c_custkey || case when c_custkey % 100 in (11, 12, 13) then 'th' when c_custkey % 10 = 1 then 'st'
        when c_custkey % 10 = 2 then 'nd' when c_custkey % 10 = 3 then 'rd' else 'th' end || '"' v from customer where c_custkey between 1 and 999""",
        "c_custkey between 1 and 999",
    ),
    "json_parse_words": ('$parseInteger($formatInteger(o_orderkey * 7919, "w"), "w") = o_orderkey * 7919', "orders", ["o_orderkey"], "select o_orderkey k, 'true' v from orders"),
    "json_parse_ordinals": ('$parseInteger($formatInteger(o_orderkey, "Ww;o"), "w") & "," & $parseInteger($formatInteger(o_orderkey, "1;o"), "1;o")', "orders", ["o_orderkey"], "select o_orderkey k, '\"' || o_orderkey || ',' || o_orderkey || '\"' v from orders"),
    "json_empty_head": ("$count([].n_name) & $type([].n_name) & $count([n_name, n_name].$)", "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '\"0array2\"' v from nation"),
    "json_string_of_object": (
        '$string({"a": n_name, "n": n_regionkey / 4, "l": [n_nationkey, "x", true, null]})', "nation", ["n_nationkey", "n_name", "n_regionkey"],
        """select n_nationkey k, to_json('{"a":"' || n_name || '","n":' || case when n_regionkey % 4 = 0 then (n_regionkey // 4)::varchar else rtrim((n_regionkey / 4)::varchar, '0') end
        || ',"l":[' || n_nationkey || ',"x",true,null]}')::varchar v from nation""",
    ),
    "json_keep_array": ("[n_regionkey[], $count(n_name[])]", "nation", ["n_nationkey", "n_name", "n_regionkey"], "select n_nationkey k, '[' || n_regionkey || ',1]' v from nation"),
    "json_keep_single": ("n_name[]", "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '[\"' || n_name || '\"]' v from nation"),
    "json_bucket_append": ('[{"k": "a", "v": [1, 2]}, {"k": "a", "v": n_nationkey}, {"k": "b", "v": 0}]{k: v}', "nation", ["n_nationkey"], """select n_nationkey k, '{"a":[1,2,' || n_nationkey || '],"b":0}' v from nation"""),
    "json_regex_function": ("/([A-Z])N/(n_name).groups", "nation", ["n_nationkey", "n_name"], """select n_nationkey k, '["' || regexp_extract(n_name, '([A-Z])N', 1) || '"]' v from nation where regexp_matches(n_name, '[A-Z]N')"""),
    "json_matcher_function": (
        '( $first := function($s) { $s != "" ? {"match": $substring($s, 0, 1), "start": 0, "end": 1, "groups": [], "next": function() { nothing }} }; $replace(n_name, $first, "*") )',
        "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '\"*' || substr(n_name, 2) || '\"' v from nation",
    ),
    "json_clone": ('( $x := {"a": n_name}; $y := $clone($x) ~> |$|{"a": 1}|; $x.a & $y.a )', "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '\"' || n_name || '1\"' v from nation"),
    "json_now": ('[$type($now()), $type($millis()), $toMillis($now()) = $millis(), $millis() > 1700000000000]', "nation", ["n_nationkey"], """select n_nationkey k, '["string","number",true,true]' v from nation"""),
    "json_now_picture": ('$length($now("[Y0001]-[M01]")) = 7 and $number($now("[Y]")) > 2023', "nation", ["n_nationkey"], "select n_nationkey k, 'true' v from nation"),
    "json_to_millis_picture": (
        '$toMillis($formatInteger(n_nationkey + 1, "1;o") & " March 2024 " & n_regionkey & ":05", "[D1o] [MNn] [Y0001] [H]:[m01]")', "nation", ["n_nationkey", "n_regionkey"],
        "select n_nationkey k, cast(epoch_ms(make_timestamp(2024, 3, n_nationkey + 1, n_regionkey, 5, 0)) as varchar) v from nation",
    ),
    "json_far_dates": (
        '$fromMillis(n_nationkey * 40000000000000, "[Y]-[M01]-[D01] [F1] [H01]:[m01]")', "nation", ["n_nationkey"],
        """select n_nationkey k, '"' || year(d) || '-' || lpad(month(d)::varchar, 2, '0') || '-' || lpad(day(d)::varchar, 2, '0') || ' ' || isodow(d) || ' ' || lpad(hour(d)::varchar, 2, '0') || ':'
        || lpad(minute(d)::varchar, 2, '0') || '"' v from (select n_nationkey, epoch_ms(n_nationkey::bigint * 40000000000000) d from nation)""",
    ),
    "json_tail_calls": ("( $f := function($n, $a) { $n = 0 ? $a : $f($n - 1, $a + $n) }; $f(3000 + n_nationkey, 0) )", "nation", ["n_nationkey"], "select n_nationkey k, cast((3000 + n_nationkey) * (3001 + n_nationkey) // 2 as varchar) v from nation"),
    "json_shadowing": ("( $max := function($x) { 'mine ' & $x }; $max(n_regionkey) )", "nation", ["n_nationkey", "n_regionkey"], "select n_nationkey k, '\"mine ' || n_regionkey || '\"' v from nation"),
    "json_comments": ("/* a */ n_name /* b */ & /* c */ '!'", "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '\"' || n_name || '!\"' v from nation"),
    "json_match_index": ("$match(p_type, /[A-Z]+/)[0].index", "part", ["p_partkey", "p_type"], "select p_partkey k, cast(length(regexp_extract(p_type, '^[^A-Z]*')) as varchar) v from part where regexp_matches(p_type, '[A-Z]')"),
    "json_replace_function": ("$replace(n_name, /[AEIOU]/, function($m) { $lowercase($m.match) })", "nation", ["n_nationkey", "n_name"], "select n_nationkey k, '\"' || translate(n_name, 'AEIOU', 'aeiou') || '\"' v from nation"),
    "json_picture": (
        '$fromMillis(event_id * 86400000, "[FNn], [D1o] [MNn] [Y] W[W01]")',
        "events",
        ["event_id"],
        """select event_id k, '"' || strftime(d, '%A, ') || day(d) || case when day(d) in (11, 12, 13) then 'th' when day(d) % 10 = 1 then 'st' when day(d) % 10 = 2 then 'nd'
        when day(d) % 10 = 3 then 'rd' else 'th' end || strftime(d, ' %B %Y W%V') || '"' v from (select event_id, date '1970-01-01' + event_id::int as d from events)""",
    ),
    "json_random": ("$count($shuffle([1..5])) + ($random() < 1 ? 0 : 1)", "nation", ["n_nationkey"], "select n_nationkey k, '5' v from nation"),
    "json_parse_integer": ('$parseInteger($formatInteger(n_nationkey, "I"), "I")', "nation", ["n_nationkey"], "select n_nationkey k, cast(n_nationkey as varchar) v from nation where n_nationkey > 0"),
}


def _documents_run(expression: str, table: str, columns: list[str], rows_of: str = "true") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(rows_of).select(F.col(columns[0]).alias("k"), F.to_json(F.struct(*columns)).alias("d"))
        return compile_expression(expression).on_json(rows, "d", "v").select("k", "v").where("v is not null")

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _run(q) for name, q in QUERIES.items()}
    found |= {name: _documents_run(e, t, c, *rows) for name, (e, t, c, _, *rows) in DOCUMENT_QUERIES.items()}
    found |= {name: _given(e, t, f) for name, (e, t, f, _) in GIVEN.items()}
    found |= {name: _failing(e, t) for name, (e, t, _) in FAILING.items()}
    found |= {name: f for name, (f, _) in INTERFACE.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: q.sql for name, q in QUERIES.items() if q.sql}
    found |= {name: sql for name, (_, _, _, sql, *_) in DOCUMENT_QUERIES.items() if sql}
    found |= {name: sql for name, (_, _, _, sql) in GIVEN.items()}
    found |= {name: f"select '{code}' as code" for name, (_, _, code) in FAILING.items()}
    return found | {name: sql for name, (_, sql) in INTERFACE.items()}
