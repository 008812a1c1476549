"""The registered query of :mod:`fleet_audit.llm.prefix_trie`, and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.prefix_trie import numbered_turns, prefix_trie
from fleet_audit.llm.shared import kept, table

FAMILY, LONGEST_HEAD = 100, 5


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (LONGEST_HEAD + 1)


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, digest, chars``: the head of each conversation's family, then its own turns behind as many."""
    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    families = convs.select("conv", base, _head(F.col("conv")).alias("head"))
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("place") <= LONGEST_HEAD))
    # A family has at most 199 members and a head at most five turns.
    taken = families.join(heads.withColumnRenamed("conv", "base"), "base").filter("place <= head").select("conv", F.col("place").alias("depth"), "digest", "chars")
    sizes = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    shift = families.join(sizes, "base", "left").select("conv", "head", F.least(F.col("head"), F.coalesce("base_turns", F.lit(0))).alias("shift"))
    own = turns.join(shift, "conv").filter("place > head").select("conv", (F.col("place") - F.col("head") + F.col("shift")).alias("depth"), "digest", "chars")
    return taken.unionByName(own)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = numbered_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie(kept(rebuilt(turns, convs), "rebuilt"), convs)


# The head's CRC-32 is the exclusive or of what each digit contributes by its distance from the end, and of a constant of the length.
op12_sql = r"""
with recursive raw as (
    select conv_id, turn, length(coalesce(text, '')) as chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null),
turns as (select conv_id as conv, chars, digest, row_number() over (partition by conv_id order by turn nulls first, digest) as place from raw),
convs as (select conv, count(*) as n, conv::varchar as name from turns group by conv),
bit(b, v) as (
    select k, (select v from (
        with recursive s(i, v) as (select 0, (1::bigint << k) union all select i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from s where i < 8)
        select v from s where i = 8)) from range(8) t(k)),
step as (select c, coalesce((select bit_xor(v) from bit where (c >> b) & 1 = 1), 0)::bigint as v from range(256) t(c)),
basis(d, k, v) as (
    select 0, k, 1::bigint << k from range(32) t(k)
    union all
    select d + 1, k, xor(s.v, basis.v >> 8) from basis join step s on s.c = basis.v & 255 where d < 20),
contribution as (
    select d - 1 as d, c, coalesce(bit_xor(basis.v) filter (where (c >> k) & 1 = 1), 0)::bigint as v from basis, range(256) t(c) where d >= 1 and k < 8 group by d, c),
fixed as (select d as n, bit_xor(v)::bigint as v from basis group by d),
heads as (
    select conv, xor(bit_xor(c.v)::bigint, xor(any_value(f.v), 4294967295)) % 6 as head
    from (select conv, length(name) as n, length(name) - 1 - p as d, ascii(substr(name, p + 1, 1)) as c from (select *, unnest(range(length(name))) as p from convs)) b
    join contribution c using (d, c) join fixed f on f.n = b.n group by conv),
rebuilt as (
    select h.conv, t.place as depth, t.digest, t.chars from heads h join turns t on t.conv = h.conv - h.conv % 100 and t.place <= h.head
    union all
    select t.conv, t.place - h.head + least(h.head, coalesce(b.n, 0)), t.digest, t.chars
    from turns t join heads h using (conv) left join convs b on b.conv = h.conv - h.conv % 100 where t.place > h.head),
member as (
    select conv, depth, chars, sha256(string_agg(digest, ',') over (partition by conv order by depth)) as prefix, count(*) over (partition by conv) as n from rebuilt),
spots as (
    select conv, depth, prefix, chars, n, coalesce(lag(prefix) over (partition by conv order by depth), '') as above from member
    union all
    select conv, 0, '', 0, coalesce(m.n, 0), null from convs left join (select conv, count(*) as n from rebuilt group by conv) m using (conv)),
nodes as (
    select depth, prefix, min(conv) as conv, count(*) as n, any_value(above) as above, any_value(chars) as chars,
        sha256(coalesce(string_agg(conv::varchar, ',' order by conv) filter (where n = depth), '')) as ends
    from spots group by depth, prefix),
children as (select depth - 1 as depth, above as prefix, count(*) as n from nodes where depth > 0 group by 1, 2),
leafy as (select x.*, coalesce(c.n, 0) as n_children from nodes x left join children c using (depth, prefix)),
below as (
    select s.depth, s.prefix, count(*) filter (where x.n_children = 0) as n_leaves, sum((x.n - 1) * x.chars)::bigint as saved
    from leafy x join spots s on s.conv = x.conv and s.depth <= x.depth group by 1, 2)
select x.conv as conv_id, x.depth::bigint as depth, p.conv as parent_conv_id, x.n as n_convs, x.n_children, b.n_leaves, b.saved as saved_tokens, x.ends as ends_sha256
from leafy x join below b using (depth, prefix) left join nodes p on p.depth = x.depth - 1 and p.prefix = x.above
"""
