"""The registered query of :mod:`fleet_audit.llm.importance`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleet_audit.llm.importance import importance_ranks
from fleet_audit.llm.shared import table


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return importance_ranks(docs, table(spark, sf_dir, "benchmark", "text"), percent=25, least_words=20, seed=7)


# A CRC-32 is the exclusive or of what each byte contributes by its value and its distance from the end, and of a constant of the length.
op11_sql = r"""
with recursive docs as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from documents),
items as (
    select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from benchmark),
doc_features as (
    select r, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as feature from docs),
item_features as (
    select unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as feature from items),
features as (select distinct feature from (select feature from doc_features union all select feature from item_features)),
bytes as (
    select feature, hex(encode(feature)) as h, length(hex(encode(feature))) // 2 as n from features),
bit(b, v) as (
    select k, (select v from (
        with recursive s(i, v) as (select 0, (1::bigint << k) union all select i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from s where i < 8)
        select v from s where i = 8)) from range(8) t(k)),
step as (
    select c, coalesce((select bit_xor(v) from bit where (c >> b) & 1 = 1), 0)::bigint as v from range(256) t(c)),
longest as (select coalesce(max(n), 0) as n from bytes),
basis(d, k, v) as (
    select 0, k, 1::bigint << k from range(32) t(k)
    union all
    select d + 1, k, xor(s.v, basis.v >> 8) from basis join step s on s.c = basis.v & 255 where d < (select n from longest)),
contribution as (
    select d - 1 as d, c, coalesce(bit_xor(basis.v) filter (where (c >> k) & 1 = 1), 0)::bigint as v
    from basis, range(256) t(c) where d >= 1 and k < 8 group by d, c),
fixed as (select d as n, bit_xor(v)::bigint as v from basis group by d),
crcs as (
    select feature, xor(bit_xor(c.v)::bigint, xor(any_value(f.v), 4294967295)) % 10000 as bucket
    from (select feature, n, n - 1 - p as d, ('0x' || substr(h, 2 * p + 1, 2))::int as c from (select *, unnest(range(n)) as p from bytes)) b
    join contribution c using (d, c) join fixed f on f.n = b.n group by feature),
s as (select bucket, count(*) as n from doc_features join crcs using (feature) group by bucket),
t as (select bucket, count(*) as n from item_features join crcs using (feature) group by bucket),
gains as (
    select bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
        / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
    from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)),
weights as (
    select r, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
    from doc_features join crcs using (feature) join gains using (bucket) group by r),
scored as (
    select docs.r, doc_id, len(words) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from docs left join weights using (r)),
ranked as (
    select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank
from scored left join ranked using (r)
"""
